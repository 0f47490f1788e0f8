"""Command line: ask, list, build, show logs, health, regression cases against the engine's own answers."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from fathom import ask as engine
from fathom.plans import registry
from fathom.sources import files, sinks

COMMANDS = {
    "ask": ["root", "question"],
    "list": ["root"],
    "build": ["root", "store", "product"],
    "recent": ["log"],
    "misses": ["log"],
    "errors": ["log"],
    "health": ["root", "store"],
    "regression": ["root", "cases"],
}


def rules() -> engine.Rules:
    """The rules of the registered queries."""
    sections = {name: (words, ["\n\n"]) for name, words in registry.ROUTES} | {registry.DEFAULT_ROUTE: (["。", "."], ["\n\n"])}
    projects = [(p, a, i) for p, names in registry.PROJECTS for i, a in enumerate(names)]
    return engine.Rules(
        registry.ROUTES, sections, registry.CASE_ROUTES, registry.DEFAULT_ROUTE, registry.NOTE, registry.SEPARATORS, keep=registry.WORDS, budgets=registry.BUDGETS, times=registry.TIMES, symptoms=registry.WORDS, projects=projects
    )


def run(spark: SparkSession, args: argparse.Namespace) -> int:
    if args.command == "ask":
        asked = spark.createDataFrame([(0, args.question)], "id bigint, q string")
        media = files.array_json(spark, args.media, files.MEDIA).withColumnRenamed("type", "media_type") if args.media else None
        said = engine.ask(spark, args.root, asked, rules(), key="id", question="q", mode=args.mode, media=media).first()
        print(said["answer"])
        for m in said["media"]:
            print(f"{m['media_type']}: {m['title']} {m['url']}".rstrip())
    elif args.command == "list":
        files.catalog(spark, args.root).show(truncate=False)
    elif args.command == "build":
        sinks.rebuild(spark, args.root, args.store, args.product, packed=args.packed).show(truncate=False)
    elif args.command == "health":
        files.health(spark, root=args.root, store=args.store).show(truncate=False)
    elif args.command in ("recent", "misses", "errors"):
        schema = {"recent": files.QA_LOG, "misses": files.MISS_LOG, "errors": files.ERROR_LOG}[args.command]
        files.recent(files.log(spark, args.log, schema), "ts", limit=args.limit).show(args.limit, truncate=False)
    else:
        cases = files.array_json(spark, args.cases, files.CASES)
        done = engine.regression(spark, args.root, cases, rules(), mode=args.mode)
        counts = done.agg(F.count("*").alias("n"), F.count_if("passed").alias("passed")).first()
        print(f"passed {counts['passed']} of {counts['n']}")
        return int(counts["passed"] < counts["n"])
    return 0


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="fathom")
    sub = out.add_subparsers(dest="command", required=True)
    for name, arguments in COMMANDS.items():
        p = sub.add_parser(name)
        for a in arguments:
            p.add_argument(a)
        if name in ("ask", "regression"):
            p.add_argument("--mode", default="brief", help="brief or full; anything else is brief")
        if name == "ask":
            p.add_argument("--media", help="JSON array of media items")
        if name == "build":
            p.add_argument("--packed", action="store_true", help="title-aware packing instead of fixed windows")
        if name in ("recent", "misses", "errors"):
            p.add_argument("--limit", type=int, default=20)
    return out


def main() -> int:
    return run(SparkSession.builder.appName("fathom").getOrCreate(), parser().parse_args())


if __name__ == "__main__":
    raise SystemExit(main())
