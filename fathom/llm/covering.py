"""Near-duplicate records by covering locality-sensitive hashing (problem 1).

A text becomes the set of runs of ``width`` letters and digits of its consistent form.
MinHash turns the set into symbols, so that similarity becomes Hamming distance over
symbols.  Structured bit masks then replace random bands: the symbols of a part are
spread over the nonzero vectors m of F_2^(radius+1), and table v (each nonzero v) keeps
the symbols whose inner product <m, v> is 1.  Any up to ``radius`` differing classes
leave some v orthogonal to all of them, so every pair within the radius collides in a
table of the part, without exception.  There are ``PARTS`` parts with symbols of their own: a pair
misses all tables only if more than ``RADIUS`` classes differ in every part, so by the pigeonhole
principle up to ``PARTS * (RADIUS + 1) - 1`` differing classes (15 of 24) always collide.  An exact
comparison of the sets follows and decides.

Equal texts are one class: only its first row is hashed.  Candidate pairs are joined
on the table's key and tested inside the join against a sketch of two bits per symbol.  A
bucket of more than ``HOT`` rows is cut into blocks, and each two blocks meet in a cell of their
own, so no task has the pairs of a hot bucket (or of a hot group of copies); nothing is gathered or capped.

Null, short (under ``least`` letters and digits) and excluded texts, and rows without a
key, form no pairs.  Only the key and the text column are read, so others may clash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .forms import consistent
from .garble import is_garbled
from .store import written

RADIUS, PER_CLASS, PARTS, SKETCH = 1, 2, 8, 64
#: Rows of a bucket that are paired in one place.
HOT = 4096
_OTHER = re.compile(r"[\W_]+")


def letters(text: str | None) -> str:
    """Letters and digits of the consistent form, lower-cased."""
    return _OTHER.sub("", consistent(text).lower()) if text else ""


def masks(radius: int = RADIUS, per_class: int = PER_CLASS) -> list[list[int]]:
    """Of each table of a part, the symbols that its mask keeps: symbol i belongs to the nonzero vector i // per_class + 1."""
    vectors = range(1, 2 ** (radius + 1))
    return [[(m - 1) * per_class + k for m in vectors if (m & v).bit_count() % 2 for k in range(per_class)] for v in vectors]


def hash_runs(texts: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of all texts in a row, and where each text's runs begin and end (interleaved); texts are at least ``width`` long."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4").astype(np.uint64)
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    h = np.zeros(len(codes) - width + 1, np.uint64)
    for k in range(width):
        h = h * np.uint64(0x9E3779B97F4A7C15) + codes[k : len(codes) - width + 1 + k]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    begin = np.cumsum(size) - size
    edges = np.empty(2 * len(texts), np.int64)
    edges[::2], edges[1::2] = begin, begin + size - width + 1
    return (h >> np.uint64(32)).astype(np.uint32), edges


def min_hashes(texts: list[str], width: int, n: int) -> np.ndarray:
    """n MinHash symbols of each text (texts x n, 32 bits)."""
    h, edges = hash_runs(texts, width)
    h = np.append(h, np.uint32(0xFFFFFFFF))  # the last end may lie past the last run
    rng = np.random.default_rng(20240101)
    a = rng.integers(0, 2**32, n, np.uint32) | np.uint32(1)
    b = rng.integers(0, 2**32, n, np.uint32)
    out = np.empty((len(texts), n), np.uint32)
    for k in range(n):
        x = h * a[k] + b[k]
        x ^= x >> np.uint32(15)
        out[:, k] = np.minimum.reduceat(x, edges)[::2]
    return out


def _groups(rows: pd.DataFrame, width: int, least: int, skip_garbled: bool) -> Iterator[list[tuple[int, str]]]:
    """Rows that take part, with their letters, about a quarter of a million letters at a time; texts stay whole."""
    kept, size = [], 0
    for i, t in zip(rows["id"], rows["text"]):
        if len(s := letters(t)) >= max(least, width) and not (skip_garbled and is_garbled(t)):
            kept.append((i, s))
            size += len(s)
            if size > 250_000:
                yield kept
                kept, size = [], 0
    if kept:
        yield kept


def _signatures(width: int, least: int, skip_garbled: bool):
    n = PARTS * PER_CLASS * (2 ** (RADIUS + 1) - 1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for kept in _groups(rows, width, least, skip_garbled):
                texts = [s for _, s in kept]
                symbols = min_hashes(texts, width, n + SKETCH)
                two = (symbols[:, n:] & 3).astype(np.uint64) << (2 * np.arange(SKETCH, dtype=np.uint64) % 64)
                yield pd.DataFrame(
                    {
                        "id": [i for i, _ in kept],
                        "same": [md5(s.encode()).digest() for s in texts],
                        "symbols": [r.tobytes() for r in symbols[:, :n].astype("<u2")],
                        "s1": np.bitwise_or.reduce(two[:, : SKETCH // 2], axis=1).astype(np.int64),
                        "s2": np.bitwise_or.reduce(two[:, SKETCH // 2 :], axis=1).astype(np.int64),
                    }
                )

    return run


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _keys(symbols: pd.Series) -> pd.Series:
    n = PER_CLASS * (2 ** (RADIUS + 1) - 1)
    all_symbols = np.frombuffer(b"".join(symbols), "<u2").reshape(len(symbols), -1).astype(np.uint64)
    out = []
    for part in range(PARTS):
        for keep in masks():
            h = np.full(len(all_symbols), part * 64 + len(out), np.uint64)
            for i in keep:
                h = (h ^ all_symbols[:, part * n + i]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(32)
            out.append((h & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32))
    return pd.Series(list(np.stack(out, axis=1)))


@F.pandas_udf(T.BooleanType())
def _alike(a: pd.Series, b: pd.Series, width: pd.Series, least: pd.Series) -> pd.Series:
    w, t, out, last, runs_a = int(width.iloc[0]) if len(width) else 0, float(least.iloc[0]) if len(least) else 0, [], None, set()
    for x, y in zip(a, b):
        if x is not last:
            s = letters(x)
            last, runs_a = x, {s[i : i + w] for i in range(len(s) - w + 1)}
        s = letters(y)
        runs_b = {s[i : i + w] for i in range(len(s) - w + 1)}
        shared = len(runs_a & runs_b)
        out.append(shared >= t * (len(runs_a) + len(runs_b) - shared) - 1e-9)
    return pd.Series(out, dtype=bool)


@F.pandas_udf(T.StringType())
def _letters(text: pd.Series) -> pd.Series:
    return text.map(letters)


def short_classes(df: DataFrame, key: str, text: str, *, least: int) -> DataFrame:
    """(id, class_id, links) of texts with fewer than ``least`` letters and digits but at least one: equal letters are a class, by its first id."""
    rows = df.select(F.col(key).cast("bigint").alias("id"), _letters(F.col(text)).alias("s")).where("id is not null and s <> ''").where(F.length("s") < least)
    firsts = rows.groupBy("s").agg(F.min("id").alias("class_id"))
    return rows.join(firsts, "s").select("id", "class_id", F.lit(0).cast("bigint").alias("links"))


def paired(rows: DataFrame, group: str, test: Column | None = None) -> DataFrame:
    """Pairs (id_a < id_b) of rows of one group that pass the test on ``a`` and ``b``: in place up to ``HOT`` rows, else by pairs of blocks."""
    every = Window.partitionBy(group)
    numbered = rows.withColumn("_r", F.row_number().over(every.orderBy("id"))).withColumn("_n", F.count("*").over(every)).where("_n > 1")
    out = lambda a, b, on: a.alias("a").join(b.alias("b"), on if test is None else on & test).select(F.col("a.id").alias("id_a"), F.col("b.id").alias("id_b"))
    cold, hot = numbered.where(F.col("_n") <= HOT), numbered.where(F.col("_n") > HOT).withColumn("_b", F.floor((F.col("_r") - 1) / HOT))
    same = F.expr(f"a.{group} = b.{group} and a._r < b._r")
    left = hot.withColumn("_i", F.col("_b")).withColumn("_j", F.explode(F.sequence("_b", F.floor((F.col("_n") - 1) / HOT))))
    right = hot.withColumn("_j", F.col("_b")).withColumn("_i", F.explode(F.sequence(F.lit(0).cast("bigint"), "_b")))
    return out(cold, cold, same).unionByName(out(left, right, same & F.expr("a._i = b._i and a._j = b._j")))


def near_duplicates(df: DataFrame, key: str, text: str, *, similarity: float = 0.8, width: int = 5, least: int = 40, skip_garbled: bool = False) -> tuple[DataFrame, DataFrame]:
    """(links, members): links (id_a, id_b) between different texts at ``similarity`` or more, each text by its first row;
    members (id, same_as) has every row that takes part, with the first row of equal text.  ``key`` is a unique bigint."""
    source = df.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("text")).where(F.col("text").isNotNull() & F.col("id").isNotNull())
    rows = written(source.mapInPandas(_signatures(width, least, skip_garbled), "id bigint, same binary, symbols binary, s1 bigint, s2 bigint"), "signatures")
    firsts = rows.groupBy("same").agg(F.min_by(F.struct("id", "symbols", "s1", "s2"), "id").alias("r"), F.count("*").alias("n"))
    shared = firsts.where("n > 1").select("same", F.col("r.id").alias("same_as"))
    members = rows.select("id", "same").join(shared, "same", "left").select("id", F.coalesce("same_as", "id").alias("same_as"))
    tables = firsts.select("r.*").select("id", "s1", "s2", F.posexplode(_keys("symbols")).alias("t", "k"))
    tables = tables.select((F.shiftleft(F.col("t").cast("bigint"), 32) + F.col("k").cast("bigint")).alias("k"), "id", "s1", "s2")
    fold = lambda c: f"bit_count(((a.{c} ^ b.{c}) | shiftrightunsigned(a.{c} ^ b.{c}, 1)) & 6148914691236517205L)"
    agree = similarity + (1 - similarity) / 4  # two random bits agree once in four
    most = SKETCH * (1 - agree) + 3.2 * (SKETCH * agree * (1 - agree)) ** 0.5
    pairs = paired(tables, "k", F.expr(f"{fold('s1')} + {fold('s2')} <= {most}")).distinct()
    left = pairs.join(source.select(F.col("id").alias("id_a"), F.col("text").alias("text_a")), "id_a")
    both = left.join(source.select(F.col("id").alias("id_b"), F.col("text").alias("text_b")), "id_b")
    links = both.where(_alike("text_a", "text_b", F.lit(width), F.lit(similarity))).select("id_a", "id_b")
    return links, members


def all_pairs(links: DataFrame, members: DataFrame) -> DataFrame:
    """Every pair (id_a < id_b) of rows, copies included; only for results that ask for pairs of copies."""
    copies = members.where("id <> same_as")
    full = written(links.select("id_a", "id_b"), "links")
    group = copies.select("id", F.col("same_as").alias("rep")).unionByName(copies.select(F.col("same_as").alias("id"), F.col("same_as").alias("rep")).distinct())
    group = written(group, "copies")
    across = full.join(group.select(F.col("rep").alias("id_a"), F.col("id").alias("x")), "id_a", "left").join(group.select(F.col("rep").alias("id_b"), F.col("id").alias("y")), "id_b", "left")
    across = across.select(F.coalesce("x", "id_a").alias("x"), F.coalesce("y", "id_b").alias("y"))
    within = paired(group, "rep").select(F.col("id_a").alias("x"), F.col("id_b").alias("y"))
    both = across.unionByName(within)
    return both.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))


def classes(links: DataFrame, members: DataFrame) -> DataFrame:
    """One row per member (id, class_id, links): connected classes by label propagation with pointer jumping.

    ``class_id`` is the least id of the class, ``links`` the number of links of the row's text to other texts.
    Every round is a join and a partial aggregation, written to the shared folder; hubs are only
    ever aggregated, never gathered.  The loop ends when no label changes: labels only fall.
    """
    full = written(links.select("id_a", "id_b"), "links")
    ways = full.unionByName(full.select(F.col("id_b").alias("id_a"), F.col("id_a").alias("id_b")))
    labels = written(ways.groupBy("id_a").agg(F.least(F.min("id_b"), F.col("id_a")).alias("label")), "labels")
    while True:
        near = ways.join(labels.select(F.col("id_a").alias("id_b"), "label"), "id_b").groupBy("id_a").agg(F.min("label").alias("m"))
        step = labels.join(near, "id_a").select("id_a", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        jump = step.join(step.select(F.col("id_a").alias("label"), F.col("label").alias("further")), "label", "left")
        new = written(jump.select("id_a", "old", F.coalesce("further", "label").alias("label")), "labels")
        labels = new.select("id_a", "label")
        if new.where("old <> label").isEmpty():
            break
    degree = ways.groupBy("id_a").agg(F.count("*").alias("links"))
    known = labels.join(degree, "id_a").withColumnRenamed("id_a", "same_as")
    return members.join(known, "same_as", "left").select("id", F.coalesce("label", "same_as").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))
