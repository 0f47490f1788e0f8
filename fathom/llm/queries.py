"""The queries of the numbered problems, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.sources import tables

from . import covering, forms, garble, leaks, packing, pairs, pieces, privacy


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return tables.table(spark, folder, name)


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    links, members = covering.near_duplicates(_table(spark, folder, "docs"), "ord", "text", similarity=0.6, skip_garbled=True)
    return covering.all_pairs(links, members).select(F.col("id_a").alias("ord_a"), F.col("id_b").alias("ord_b"))


def p1_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Every row with its class and the number of links of its text; texts too short for a run are one class where their letters are equal, those without letters stay alone."""
    docs = _table(spark, folder, "docs")
    links, members = covering.near_duplicates(docs, "ord", "text", similarity=0.6, least=5)
    found = covering.classes(links, members).unionByName(covering.short_classes(docs, "ord", "text", least=5)).withColumnRenamed("id", "ord")
    every = docs.select(F.col("ord").cast("bigint").alias("ord")).join(found, "ord", "left")
    return every.select("ord", F.coalesce("class_id", "ord").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    parts = [("docs", "ord", "text"), ("qa_log", "qa_id", "answer")]
    rows = [_table(spark, folder, t).where(garble.garbled(F.col(c))).select(F.lit(t).alias("source_table"), F.col(k).cast("bigint").alias("row_id")) for t, k, c in parts]
    return rows[0].unionByName(rows[1])


def p2_repaired(spark: SparkSession, folder: str) -> DataFrame:
    parts = [("docs", "ord", "text"), ("qa_log", "qa_id", "answer")]
    rows = [garble.repair_text(_table(spark, folder, t), c).where("original is not null").select(F.lit(t).alias("source_table"), F.col(k).cast("bigint").alias("row_id"), "original") for t, k, c in parts]
    return rows[0].unionByName(rows[1])


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return pairs.broken_pairs(_table(spark, folder, "qa_log"), "question", "answer", "hit").select(F.col("qa_id").cast("bigint").alias("qa_id"), "defect")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return privacy.find(_table(spark, folder, "qa_log"), "qa_id", ["question", "answer"]).withColumnRenamed("id", "qa_id")


def p4_redacted(spark: SparkSession, folder: str) -> DataFrame:
    return privacy.redact(_table(spark, folder, "qa_log"), "qa_id", ["question", "answer"]).withColumnRenamed("id", "qa_id")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "docs").where(forms.is_disguised(F.col("text"))).where(~garble.garbled(F.col("text")))
    qa = _table(spark, folder, "qa_log").where(forms.is_disguised(F.col("question")))
    return docs.select(F.lit("docs").alias("source_table"), F.col("ord").cast("bigint").alias("row_id")).unionByName(
        qa.select(F.lit("qa_log").alias("source_table"), F.col("qa_id").cast("bigint").alias("row_id"))
    )


def p5_forms(spark: SparkSession, folder: str) -> DataFrame:
    parts = [("docs", "ord", "text"), ("qa_log", "qa_id", "question")]
    rows = [forms.unify(_table(spark, folder, t), c).select(F.lit(t).alias("source_table"), F.col(k).cast("bigint").alias("row_id"), "form", "is_disguised") for t, k, c in parts]
    return rows[0].unionByName(rows[1])


def p5_groups(spark: SparkSession, folder: str) -> DataFrame:
    parts = [("docs", "ord", "text"), ("qa_log", "qa_id", "question")]
    rows = [_table(spark, folder, t).select(F.lit(t).alias("source_table"), F.col(k).cast("bigint").alias("row_id"), F.col(c).alias("text")) for t, k, c in parts]
    return forms.look_alike_groups(rows[0].unionByName(rows[1]), ["source_table", "row_id"], "text")


def p6_packed(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(_table(spark, folder, "documents"), "doc_id", "text").withColumnRenamed("id", "doc_id")


def p8_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.split(_table(spark, folder, "documents"), "doc_id", "text").withColumnRenamed("id", "doc_id")


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return leaks.leaked(_table(spark, folder, "documents"), "doc_id", "text", _table(spark, folder, "regression_cases")).withColumnRenamed("id", "doc_id")


def p7_paraphrases(spark: SparkSession, folder: str) -> DataFrame:
    return leaks.reworded(_table(spark, folder, "documents"), "doc_id", "text", _table(spark, folder, "regression_cases")).withColumnRenamed("id", "doc_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_groups, p2_found, p2_repaired, p3_found, p4_found, p4_redacted, p5_found, p5_forms, p5_groups, p6_packed, p7_found, p7_paraphrases, p8_pieces)
}
_LETTERS = r"regexp_replace(lower({}), '[^\p{{L}}\p{{N}}]+', '', 'g')"
ORACLE: dict[str, str] = {
    "p7_found": f"""with d as (select doc_id, {_LETTERS.format("text")} as s from documents where text is not null),
        r as (select case_id, case when lang = 'zh' then 24 else 60 end as k, {_LETTERS.format("reference")} as s from regression_cases where reference is not null),
        rw as (select distinct case_id, k, substring(s, i, k) as w from (select *, unnest(range(1, length(s) - k + 2)) as i from r)),
        dw as (select distinct doc_id, k, substring(s, i, k) as w from (select doc_id, s, k, unnest(range(1, length(s) - k + 2)) as i from d, (values (24), (60)) t(k)))
        select distinct doc_id, case_id from dw join rw using (k, w)""",
}
