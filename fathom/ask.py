"""Questions answered from knowledge folders ``root/<product>/{main,faq,alias}.txt``: rewriting, search, sections, answer, media."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.functions import text as X
from fathom.operators import answer, chunk, search, understand
from fathom.sources import files


@dataclass
class Rules:
    """What one business asks for; all of it is data."""

    routes: list[tuple[str, list[str]]]
    sections: dict[str, tuple[list[str], list[str]]]
    titles: dict[str, str]
    default_route: str
    note: str
    separators: list[str]
    keep: list[str] = field(default_factory=list)
    budgets: dict[str, dict[str, int]] = field(default_factory=dict)
    steps: dict[str, list[str]] = field(default_factory=dict)
    times: list[str] = field(default_factory=list)
    symptoms: list[str] = field(default_factory=list)
    projects: list[tuple[str, str, int]] = field(default_factory=list)
    risk: tuple[str, str] | None = None
    default_product: str | None = None


def vocabulary(texts: DataFrame) -> DataFrame:
    """(product_id, alias, alias_ord) from the lines of the alias files, and the product's own name after them."""
    names = texts.where("source_type = 'alias'").select("product_id", F.posexplode(X.lines(F.col("text"))).alias("alias_ord", "alias"))
    own = texts.select("product_id").distinct().select("product_id", F.lit(2**31 - 1).alias("alias_ord"), F.col("product_id").alias("alias"))
    return names.unionByName(own).select("product_id", "alias", "alias_ord")


def ask(spark: SparkSession, root: str, questions: DataFrame, rules: Rules, *, key: str, question: str, mode: str | None = "brief", media: DataFrame | None = None, model=lambda: search.hashed_embedding) -> DataFrame:
    """(key, ok, answer, media) for a batch of questions; a mode other than brief or full is brief."""
    mode = mode if mode in ("brief", "full") else "brief"
    texts = files.knowledge(spark, root)
    aliases = vocabulary(texts)
    projects = spark.createDataFrame(rules.projects, "project_id string, alias string, alias_ord int")
    main = texts.where("source_type in ('main', 'faq')")
    windows = chunk.records(main, ["product_id", "source_file", "source_type"], "text", chunk.fixed_windows(F.col("text")))
    chunks = windows.withColumn("id", F.xxhash64("product_id", "source_file", "chunk_id"))

    def expand(parts: DataFrame) -> DataFrame:
        r = understand.rewrite(parts, "_part", aliases, projects, times=rules.times, symptoms=rules.symptoms, separators=rules.separators, out="_r")
        return r.withColumns({"_query": F.col("_r.expanded"), "_products": F.col("_r.products")}).drop("_r")

    said = answer.answers(
        questions, main, aliases, key=key, question=question, separators=rules.separators, routes=rules.routes, sections=rules.sections, titles=rules.titles, note=rules.note, default_route=rules.default_route, keep=rules.keep,
        most_lines={r: rules.budgets.get(r, {"brief": 12, "full": 20})[mode] for r in rules.titles}, steps=rules.steps, mode=mode, risk=rules.risk, default_product=understand.default_product(main, rules.default_product), expand=expand, search_in=chunks, model=model,
    )
    media = spark.createDataFrame([], "ord bigint, title string, media_type string, url string, keywords array<string>") if media is None else media
    return answer.respond(questions, said, media, key=key, question=question)


def regression(spark: SparkSession, root: str, cases: DataFrame, rules: Rules, *, mode: str = "brief") -> DataFrame:
    """The cases (q, expect_any) with passed: whether the engine's own answer to the question holds one of the expected texts."""
    asked = cases.select("q").where("q is not null").distinct().withColumn("_id", F.xxhash64("q"))
    own = ask(spark, root, asked, rules, key="_id", question="q", mode=mode).join(asked, "_id")
    return answer.regression(cases, own, "q")
