"""Writers: the chunk store by product, JSON lines export, append-only logs."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.functions import text as X
from fathom.functions import vector as V
from fathom.operators import chunk, search

from . import files


def write_store(rows: DataFrame, path: str) -> None:
    """Overwrites the partitions of the products in ``rows`` and no others."""
    rows.write.partitionBy("product_id").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)


def read_store(spark: SparkSession, path: str, product: str | None = None) -> DataFrame:
    """The store, or one product's partition of it."""
    rows = spark.read.parquet(path)
    return rows if product is None else rows.where(F.col("product_id") == product)


def rebuild(spark: SparkSession, root: str, store: str, product: str, *, model=lambda: search.hashed_embedding, packed: bool = False) -> DataFrame:
    """Reads, chunks, embeds and stores one product; returns (source_file, chunks) of what was stored."""
    if not re.fullmatch(r"[\w-]+", product or ""):
        raise ValueError(f"no product id: {product!r}")
    texts = files.knowledge(spark, root).where(F.col("product_id") == product)
    windows = chunk.packed(F.col("text")) if packed else F.when(F.col("source_type") == "alias", F.array("text")).otherwise(chunk.fixed_windows(F.col("text")))
    rows = chunk.records(texts, ["product_id", "source_file", "source_type"], "text", windows)
    rows = search.embed(rows, "text", model=model).withColumn("embedding", V.normalize(F.col("embedding")))
    rows = rows.withColumn("id", F.concat_ws("", "product_id", F.lit("/"), "source_file", F.lit("::chunk_"), (F.col("chunk_id") - 1).cast("string")))
    write_store(rows, store)
    done = read_store(spark, store, product)
    if done.isEmpty():
        raise ValueError(f"no texts for {product}")
    return done.groupBy("source_file").agg(F.count("*").alias("chunks")).orderBy("source_file")


def export_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def stamped(rows: DataFrame) -> DataFrame:
    """With ts, seconds without zone, unless the rows bring their own."""
    now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss")
    return rows.withColumn("ts", F.coalesce("ts", now) if "ts" in rows.columns else now)


def log_qa(rows: DataFrame, qa_path: str, miss_path: str, mode: str = "append") -> None:
    """Appends (or, by ``mode``, overwrites) all rows to the question log, and those without a hit, projected, to the miss log."""
    full = stamped(rows).withColumns({c: F.coalesce(c, F.lit("")) for c in ("question", "rewritten_query", "answer")}).withColumn("hit", F.coalesce("hit", F.lit(False)))
    full.write.mode(mode).json(qa_path)
    full.where(~F.col("hit")).select("ts", "question", "rewritten_query", "meta").write.mode(mode).json(miss_path)


def log_error(rows: DataFrame, path: str) -> None:
    stamped(rows).write.mode("append").json(path)


def answer_text(answer):
    """An answer as it is written out: trimmed, with a line end."""
    return F.concat(X.utrim(F.coalesce(answer, F.lit(""))), F.lit("\n"))
