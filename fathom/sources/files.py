"""Readers: knowledge texts with encoding fallback, JSON documents, media lists, logs, regression cases, catalogs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathom.functions import text as X

CHUNKS = "id string, text string, meta struct<product_id: string, source_file: string, source_type: string, chunk_id: int>"
QA_LOG = "ts string, question string, rewritten_query string, answer string, hit boolean, latency_ms int, matched_sources array<map<string,string>>, meta map<string,string>"
MISS_LOG = "ts string, question string, rewritten_query string, meta map<string,string>"
ERROR_LOG = "ts string, stage string, error string, meta map<string,string>"
MEDIA = "title string, type string, url string, keywords array<string>"
CASES = "q string, expect_any array<string>"


@F.pandas_udf(T.StringType())
def _gbk(raw: pd.Series) -> pd.Series:
    def decode(b: bytes | None) -> str | None:
        if b is None:
            return None
        try:
            return b.decode("gbk")
        except UnicodeDecodeError:
            return b.decode("utf-8", "ignore")

    return raw.map(decode)


def decoded(content):
    """Bytes as text: UTF-8 with or without byte order mark, else GBK, else what of UTF-8 can be read."""
    return F.when(F.is_valid_utf8(content.cast("string")), F.regexp_replace(content.cast("string"), "^\\x{FEFF}", "")).otherwise(_gbk(content))


def empty_files(spark: SparkSession, root: str) -> list[str]:
    """Paths of the files without content, which Spark's readers pass over; from the listing alone."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(path, True)
    out = []
    while found.hasNext():
        if (f := found.next()).getLen() == 0:
            out.append(f.getPath().toString())
    return out


def _with_empty(spark: SparkSession, files: DataFrame, root: str, *columns) -> DataFrame:
    empty = empty_files(spark, root)
    return files.unionByName(spark.createDataFrame([(p, *columns) for p in empty], files.schema)) if empty else files


def knowledge(spark: SparkSession, root: str) -> DataFrame:
    """(product_id, source_file, source_type, text) of ``root/<product>/{main,faq,alias}.txt``; empty files count, missing ones don't."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").option("recursiveFileLookup", "true").load(root).select("path", "content")
    files = _with_empty(spark, files, root, bytearray())
    name = F.regexp_extract("path", r"([^/]+)/([^/]+)\.txt$", 2)
    rows = files.select(F.regexp_extract("path", r"([^/]+)/([^/]+)\.txt$", 1).alias("product_id"), F.concat(name, F.lit(".txt")).alias("source_file"), name.alias("source_type"), decoded(F.col("content")).alias("text"))
    return rows.where(F.col("source_type").isin("main", "faq", "alias"))


def knowledge_text(spark: SparkSession, root: str, wanted: DataFrame, *, trimmed: bool = False) -> DataFrame:
    """``wanted`` (product_id, source_file) with text, an empty one where the file is missing; ``trimmed``: without white space at both ends."""
    text = F.coalesce("text", F.lit(""))
    found = knowledge(spark, root).select("product_id", "source_file", "text")
    return wanted.join(found, ["product_id", "source_file"], "left").withColumn("text", X.utrim(text) if trimmed else text)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether the path exists, on whatever file system it names."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def health(spark: SparkSession, **paths: str) -> DataFrame:
    """One row (status, <name>_exists ...) for named paths."""
    return spark.createDataFrame([("ok", *(exists(spark, p) for p in paths.values()))], "status string" + "".join(f", {n}_exists boolean" for n in paths))


def documents_json(spark: SparkSession, path: str) -> DataFrame:
    """Chunk records of a JSON lines file; a malformed line fails the read, blank ones are skipped."""
    return spark.read.schema(CHUNKS).option("mode", "FAILFAST").json(path)


def array_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The entries of one JSON array, with ord from 0; a file that is missing or can't be read as such is empty."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema).withColumn("ord", F.lit(0).cast("bigint"))
    return spark.read.schema(schema).option("multiLine", "true").option("mode", "DROPMALFORMED").json(path).withColumn("ord", F.monotonically_increasing_id())


def parsed(lines: DataFrame, schema: str) -> DataFrame:
    """Text lines as JSON rows; blank and malformed lines, bare scalars among them, are dropped."""
    row = F.from_json("value", f"{schema}, _corrupt_record string", {"columnNameOfCorruptRecord": "_corrupt_record"}).alias("r")
    return lines.where(F.trim("value") != "").select(row).where("r._corrupt_record is null").select("r.*").drop("_corrupt_record")


def log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON lines log without its malformed lines; a missing one is empty."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return parsed(spark.read.text(path), schema)


def recent(rows: DataFrame, *order, limit: int, most: int = 10_000) -> DataFrame:
    """The newest rows first by ``order``; a limit below 1 counts as 1, one above ``most`` as that."""
    return rows.orderBy(*[F.desc(o) for o in order]).limit(min(most, max(1, limit)))


def products(spark: SparkSession, root: str) -> DataFrame:
    """(product_id) sorted: the names of the folders with files."""
    return catalog(spark, root).select("product_id")


def catalog(spark: SparkSession, root: str) -> DataFrame:
    """(product_id, files) sorted, from the listing alone: contents are not read."""
    paths = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")
    paths = _with_empty(spark, paths, root)
    parts = paths.select(F.regexp_extract("path", r"([^/]+)/([^/]+)$", 1).alias("product_id"), F.regexp_extract("path", r"([^/]+)/([^/]+)$", 2).alias("file"))
    return parts.groupBy("product_id").agg(F.array_sort(F.collect_set("file")).alias("files")).orderBy("product_id")
