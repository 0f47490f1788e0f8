"""Understanding of questions: entities, routes, expansion, media; the vocabularies are arguments."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathom.functions import text as X

#: Entries of a vocabulary that one task should hold; a larger one is joined to the parts of the texts.
MOST_ENTRIES = 2_000_000


def _automaton(entries: list[tuple[str, str, int]]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import ahocorasick

        words, always = ahocorasick.Automaton(), []
        keys: dict[str, list[tuple[int, str]]] = {}
        for term, key, order in entries:
            (keys.setdefault(term.lower(), []) if term else always).append((order, key))
        for term in keys:
            words.add_word(term, term)
        if keys:
            words.make_automaton()
        for rows in batches:
            out = []
            for text in rows["_text"]:
                found = dict.fromkeys(k for _, k in always)
                hits = sorted(x for t in {t for _, t in words.iter(text.lower())} for x in keys[t]) if keys and text else []
                out.append(list(found | dict.fromkeys(k for _, k in hits)))
            yield rows.assign(_found=out).drop(columns="_text")

    return run


def detect(df: DataFrame, text: str, vocabulary: DataFrame, *, key: str, term: str, order: Column, out: str = "detected") -> DataFrame:
    """``df`` with the keys whose terms the text contains, letter case aside, in the vocabulary's order, each once.

    All terms are matched in one pass by an automaton; a vocabulary of more than ``MOST_ENTRIES`` is joined to the substrings
    of the different texts that have the length of a term.  Null texts give an empty list; a null
    term or key matches nothing, an empty term every text.
    """
    known = vocabulary.where(F.col(term).isNotNull() & F.col(key).isNotNull()).select(F.col(term).alias("t"), F.col(key).alias("k"), order.cast("bigint").alias("o"))
    if vocabulary.count() > MOST_ENTRIES:
        return _joined(df, text, known, out)
    entries = [(r[0], r[1], r[2]) for r in known.collect()]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + ", _found array<string>"
    return df.withColumn("_text", F.col(text)).mapInPandas(_automaton(entries), fields).withColumnRenamed("_found", out)


def _joined(df: DataFrame, text: str, known: DataFrame, out: str) -> DataFrame:
    known = known.withColumn("t", F.lower("t"))
    always = known.where("t = ''").groupBy("k").agg(F.min("o").alias("o")).orderBy("o", "k").select("k").collect()  # keys with an empty term: a few
    lengths = [r[0] for r in known.where("t <> ''").select(F.length("t")).distinct().collect()]
    texts = df.select(F.lower(F.col(text)).alias("_low")).where("_low is not null").distinct()
    parts = texts.select("_low", F.explode(F.array(*map(F.lit, lengths)) if lengths else F.array().cast("array<int>")).alias("_n")).where("_n <= length(_low)")
    parts = parts.select("_low", F.explode(F.sequence(F.lit(1), F.length("_low") - F.col("_n") + 1)).alias("_p"), "_n").select("_low", F.substring("_low", F.col("_p"), F.col("_n")).alias("t")).distinct()
    hits = parts.join(known, "t").groupBy("_low", "k").agg(F.min("o").alias("o"))
    lists = hits.groupBy("_low").agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "k"))), lambda x: x["k"]).alias("_found"))  # bounded by the length of the text
    first = F.array(*[F.lit(r[0]) for r in always]) if always else F.array().cast("array<string>")
    found = F.array_distinct(F.concat(first, F.coalesce("_found", F.array().cast("array<string>"))))
    rows = df.withColumn("_low", F.lower(F.col(text))).join(lists, "_low", "left").withColumn(out, found)
    return rows.drop("_low", "_found") if out != "_found" else rows.drop("_low")


def route(question: Column, routes: list[tuple[str, list[str]]], default: str) -> Column:
    """The first route, by priority, one of whose words the question contains, letter case aside."""
    low, out = F.lower(F.coalesce(question, F.lit(""))), F.lit(default)
    for name, words in reversed(routes):
        out = F.when(X.contains_any(low, [w.lower() for w in words]), name).otherwise(out)
    return out


def expand(question: Column, aliases: Column, words: list[str], *, most: int = 4) -> Column:
    """The question with up to ``most`` aliases and the listed words it contains, each once, joined by blanks."""
    q = F.coalesce(question, F.lit(""))
    return F.array_join(X.unique(F.concat(F.array(q), F.slice(F.coalesce(aliases, F.array().cast("array<string>")), 1, most), X.contained(q, words))), " ")


def rewrite(df: DataFrame, question: str, products: DataFrame, projects: DataFrame, *, times: list[str], symptoms: list[str], separators: list[str], most: tuple[int, int] = (4, 3), out: str = "rewrite") -> DataFrame:
    """``df`` with a struct of the question: original (trimmed), expanded, products, projects, times, symptoms, sub_questions.

    Products and projects are those whose aliases (product_id or project_id, alias, alias_ord) the question contains, in the order of their ids;
    the expanded question adds the first aliases of each (``most``) and the words for times and symptoms that it contains, each once.
    """
    q = X.utrim(F.coalesce(F.col(question), F.lit("")))
    rows, names, lists = df.withColumn("_asked", q), [], []
    for key, vocabulary, n in (("product_id", products, most[0]), ("project_id", projects, most[1])):
        own = vocabulary.where(F.col(key).isNotNull() & F.col("alias").isNotNull())
        first = F.slice(F.transform(F.array_sort(F.collect_list(F.struct("alias_ord", "alias"))), lambda x: x["alias"]), 1, n)
        packed = own.groupBy(key).agg(F.concat_ws("\x1f", F.array(key), first).alias("_packed"))  # a key travels with its first aliases
        rank = F.dense_rank().over(Window.orderBy(key))  # of the vocabulary
        rows = detect(rows, "_asked", own.join(packed, key).withColumn("_o", rank), key="_packed", term="alias", order=F.col("_o"), out=f"_{key}")
        parts = F.transform(f"_{key}", lambda k: F.split(k, "\x1f"))
        names.append(F.transform(parts, lambda p: p[0]))
        lists.append(F.flatten(F.transform(parts, lambda p: F.slice(p, 2, n))))  # noqa: B023
    time, symptom = X.contained(F.col("_asked"), times), X.contained(F.col("_asked"), symptoms)
    expanded = F.array_join(X.unique(F.concat(F.array("_asked"), *lists, time, symptom)), " ")
    struct = F.struct(F.col("_asked").alias("original"), expanded.alias("expanded"), names[0].alias("products"), names[1].alias("projects"), X.unique(time).alias("times"), X.unique(symptom).alias("symptoms"), X.split_questions(F.col("_asked"), separators).alias("sub_questions"))
    return rows.withColumn(out, struct).drop("_asked", "_product_id", "_project_id")


def default_product(known: DataFrame, preferred: str | None = None) -> str | None:
    """``preferred`` if it is among the product ids of ``known``, else the first of them by name, else ``preferred``."""
    row = known.agg(F.min("product_id").alias("first"), F.max(F.col("product_id") == F.lit(preferred)).alias("there")).first()
    return preferred if row["there"] or row["first"] is None else row["first"]


def mode_of(mode: Column, default: str = "brief") -> Column:
    """``brief`` or ``full``; anything else is the default."""
    return F.when(mode.isin("brief", "full"), mode).otherwise(F.lit(default))


def media_for(df: DataFrame, text: str, key: str, media: DataFrame, *, most: int = 6) -> DataFrame:
    """(key, media_order, title, media_type, url): up to ``most`` media items, in their order, one of whose keywords the text contains.

    ``media`` has ord, title, media_type, url, keywords; it is a small configured list whose
    size is checked.  A null url becomes empty.
    """
    words = media.select(F.col("ord").cast("string").alias("k"), "ord", F.explode("keywords").alias("w"))
    found = detect(df.select(key, text), text, words, key="k", term="w", order=F.col("ord"))
    hits = found.select(key, F.explode(F.slice("detected", 1, most)).alias("k"))
    items = media.select(F.col("ord").cast("string").alias("k"), "ord", "title", "media_type", F.coalesce("url", F.lit("")).alias("url"))
    return hits.join(items, "k").select(key, F.col("ord").cast("bigint").alias("media_order"), "title", "media_type", "url")
