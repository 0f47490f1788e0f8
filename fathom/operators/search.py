"""Exact vector search, keyword search and their hybrid."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathom.functions import text as X

K, FINAL_K, VECTOR_WEIGHT, KEYWORD_WEIGHT = 12, 8, 0.65, 0.35
#: Queries, and terms in them, that go to every task; more meet the corpus in cells of ``BLOCK`` queries and ``ROWS`` rows.
BLOCK, TERMS, ROWS = 4096, 1_000_000, 65_536


def _unit(v: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(v, axis=1, keepdims=True)
    return np.divide(v, n, out=v.copy(), where=n > 0)


def _top(query: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The best k of each query, by score and id, of rows (query, id, score)."""
    order = np.lexsort((ids, -score, query))
    query, ids, score = query[order], ids[order], score[order]
    first = np.searchsorted(query, query, "left")
    keep = np.arange(len(query)) - first < k
    return query[keep], ids[keep], score[keep]


def _near(queries: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, score) of the best k rows of each query, ties at the last place included."""
    s = queries @ rows.T
    least = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k, None] if s.shape[1] > k else -np.inf
    q, r = np.nonzero(s >= least)
    return _top(q, ids[r], s[q, r], k)


def _vectors(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    rows = rows[rows["v"].notna()]
    return rows["id"].to_numpy(np.int64), _unit(np.stack(rows["v"].to_numpy()).astype(np.float64)) if len(rows) else np.zeros((0, 0))


def _best(queries: np.ndarray, names: np.ndarray, k: int):
    """Per task, the best k of its rows for each query: a partial top-k before the shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        for rows in batches:
            ids, v = _vectors(rows)
            if len(ids):
                best = _top(*map(np.concatenate, zip(best, _near(queries, v, ids, k))), k)
        yield pd.DataFrame({"qid": names[best[0]], "id": best[1], "score": best[2]})

    return run


def _cells(queries: DataFrame, blocks: int, corpus: DataFrame, work, schema: str, by: bool = False) -> DataFrame:
    """``work`` (queries, rows → hits) over every block of queries with every block of the corpus, each pair in a task of its own; ``by``: only within equal ``_by``."""
    number = lambda n: F.pmod(F.monotonically_increasing_id(), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), (n - 1).cast("int")))
    if by:  # a group has as many blocks as its size asks for
        size = lambda rows, n: rows.groupBy("_by").agg(F.ceil(F.count("*") / n).alias("n"))
        blocks_of = size(queries, BLOCK).withColumnRenamed("n", "_nq").join(size(corpus, ROWS).withColumnRenamed("n", "_nc"), "_by")
        queries, corpus, keys, nq, nc = queries.join(blocks_of, "_by"), corpus.join(blocks_of, "_by"), ["_by", "_q", "_c"], F.col("_nq"), F.col("_nc")
    else:
        keys, nq, nc = ["_q", "_c"], F.lit(blocks), F.lit(max(1, -(-corpus.count() // ROWS)))
    left = queries.withColumn("_q", number(nq)).withColumn("_c", every(nc)).drop("_nq", "_nc").groupBy(*keys)
    right = corpus.withColumn("_c", number(nc)).withColumn("_q", every(nq)).drop("_nq", "_nc").groupBy(*keys)
    return left.cogroup(right).applyInPandas(work, schema)


def vector_topk(queries: DataFrame, corpus: DataFrame, *, qid: str, qvec: str, key: str, vec: str, k: int = K, min_score: float | None = None, by: str | None = None) -> DataFrame:
    """(qid, id, score, rank): the k rows of largest cosine for each query, exactly; ties by id.

    Up to ``BLOCK`` queries go to every task, which multiplies them with its own rows and keeps k;
    more are cut into blocks that meet the blocks of the corpus in cells.  Only k rows per query and task or cell are shuffled.
    ``by``: a column of both sides; rows count only where it is equal, and each group meets in cells of its own.
    Null vectors are left out on both sides; zero vectors score 0; negative scores count, unless ``min_score`` is given.
    """
    hits = "qid bigint, id bigint, score double"
    group = [F.col(by).alias("_by")] if by else []
    rows = corpus.where(F.col(vec).isNotNull()).select(F.col(key).cast("bigint").alias("id"), F.col(vec).alias("v"), *group)
    stated = queries.where(F.col(qvec).isNotNull()).select(F.col(qid).cast("bigint").alias("id"), F.col(qvec).alias("v"), *group)
    n = 0 if by else stated.count()
    if n <= BLOCK and not by:
        names, q = _vectors(stated.toPandas())
        found = rows.mapInPandas(_best(q, names, k), hits) if n else rows.where("false").select(F.col("id").alias("qid"), "id", F.lit(0.0).alias("score"))
    else:

        def cell(asked: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
            names, q = _vectors(asked)
            ids, v = _vectors(own)
            i, ids, score = _near(q, v, ids, k) if len(names) and len(ids) else (np.zeros(0, np.int64),) * 3
            return pd.DataFrame({"qid": names[i], "id": ids, "score": score.astype(np.float64)})

        found = _cells(stated, -(-n // BLOCK), rows, cell, hits, bool(by))
    return _ranked(found if min_score is None else found.where(F.col("score") >= min_score), k, F.col("id"))


def _ranked(scored: DataFrame, k: int, *ties) -> DataFrame:
    best = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), *ties))
    return scored.withColumn("rank", best.cast("bigint")).where(F.col("rank") <= k)


def keyword_score(query, text, strong: list[str] = (), boost: float = 0.0):
    """Share of the query's terms that the text contains, letter case aside; 0 where there are no terms.

    Each word of ``strong`` that query and text both hold adds ``boost``.
    """
    t = X.terms(query)
    low, asked = F.lower(F.coalesce(text, F.lit(""))), F.lower(F.coalesce(query, F.lit("")))
    share = F.when(F.size(t) > 0, F.size(F.filter(t, lambda w: F.contains(low, w))) / F.size(t)).otherwise(0.0)
    if not strong:
        return share
    both = F.filter(F.array(*[F.lit(w.lower()) for w in strong]), lambda w: F.contains(asked, w) & F.contains(low, w))
    return share + F.size(both) * F.lit(boost)


def keyword_topk(queries: DataFrame, corpus: DataFrame, *, qid: str, query: str, key: str, text: str, k: int = K, by: str | None = None) -> DataFrame:
    """(qid, id, score, rank): the k rows with the largest share of terms above 0; ties by id.

    One automaton over the terms of up to ``BLOCK`` queries reads the rows where they are; more queries are cut into
    blocks that meet the blocks of the corpus in cells.  Only the k best of a task or cell are shuffled further.
    """
    group = [F.col(by).alias("_by")] if by else []
    q = queries.select(F.col(qid).cast("bigint").alias("qid"), X.terms(F.col(query)).alias("terms"), *group).where(F.size("terms") > 0)
    rows = corpus.select(F.col(key).cast("bigint").alias("id"), F.lower(F.coalesce(F.col(text), F.lit(""))).alias("low"), *group)
    hits = "qid bigint, id bigint, score double"
    size = {"n": 0, "t": 0} if by else q.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("terms")), F.lit(0)).alias("t")).first()
    if not by and size["n"] <= BLOCK and size["t"] <= TERMS:
        found = rows.mapInPandas(_hits([(r["qid"], list(r["terms"])) for r in q.collect()], k), hits)
    else:

        def cell(asked: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
            return next(_hits(list(zip(asked["qid"].tolist(), map(list, asked["terms"]))), k)(iter([own])))

        found = _cells(q, max(-(-size["n"] // BLOCK), -(-size["t"] // TERMS)), rows, cell, hits, bool(by))
    return _ranked(found, k, F.col("id"))


def _hits(stated: list[tuple[int, list[str]]], k: int):
    """The best k rows of each stated query (id, terms) by the share of its terms that a row contains; a repeated term counts each time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import ahocorasick

        words, uses = ahocorasick.Automaton(), {}
        for n, (_, terms) in enumerate(stated):
            for t in terms:
                uses.setdefault(t, []).append(n)
        for i, t in enumerate(uses):
            words.add_word(t, i)
        if uses:
            words.make_automaton()
        of_term = [np.array(v) for v in uses.values()]
        names, size = np.array([i for i, _ in stated], np.int64), np.array([max(1, len(t)) for _, t in stated])
        best = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        new, waiting = [best], 0
        for rows in batches if uses else ():
            for i, low in zip(rows["id"], rows["low"]):
                if held := {t for _, t in words.iter(low)}:
                    count = np.bincount(np.concatenate([of_term[t] for t in held]), minlength=len(names))
                    q = np.flatnonzero(count)
                    new.append((q, np.full(len(q), i, np.int64), count[q] / size[q]))
                    waiting += len(q)
                if waiting > 500_000:
                    new, waiting = [_top(*map(np.concatenate, zip(*new)), k)], 0
        q, ids, score = _top(*map(np.concatenate, zip(*new)), k)
        yield pd.DataFrame({"qid": names[q], "id": ids, "score": score})

    return run


def merge_hybrid(vector: DataFrame, keyword: DataFrame, *, k: int = FINAL_K, vector_weight: float = VECTOR_WEIGHT, keyword_weight: float = KEYWORD_WEIGHT, min_score: float | None = None, min_scores: DataFrame | None = None) -> DataFrame:
    """(qid, text, id, vector_score, keyword_score, hybrid_score, rank) of both hit lists (qid, text, id, score, rank), by equal text.

    Equal texts among vector hits: the first place, the score and id of the last.  Among keyword
    hits: scores add up in rank order, the id of the first.  A text only keywords found has
    vector score 0.  Hits below ``min_score``, or below that of their query (``min_scores``: qid, min_score), are left out.  Ties: vector hits first, in their order, then keyword hits in theirs.
    """
    v = vector.groupBy("qid", "text").agg(F.max_by("score", "rank").alias("vs"), F.max_by("id", "rank").alias("vid"), F.min("rank").alias("vp"))
    add = F.aggregate(F.array_sort(F.collect_list(F.struct("rank", "score"))), F.lit(0.0), lambda s, x: s + x["score"])
    w = keyword.groupBy("qid", "text").agg(add.alias("ks"), F.min_by("id", "rank").alias("kid"), F.min("rank").alias("kp"))
    both = v.join(w, ["qid", "text"], "full_outer")
    vs, ks = F.coalesce("vs", F.lit(0.0)), F.coalesce("ks", F.lit(0.0))
    merged = both.select(
        "qid", "text", F.coalesce("vid", "kid").alias("id"), vs.alias("vector_score"), ks.alias("keyword_score"), (vs * vector_weight + ks * keyword_weight).alias("score"), F.col("vp").isNull().alias("late"), F.coalesce("vp", "kp").alias("place")
    )
    if min_scores is not None:
        merged = merged.join(min_scores.select("qid", F.col("min_score").alias("_least")), "qid", "left").where(F.col("_least").isNull() | (F.col("score") >= F.col("_least"))).drop("_least")
    if min_score is not None:
        merged = merged.where(F.col("score") >= min_score)
    return _ranked(merged, k, F.col("late"), F.col("place")).drop("late", "place").withColumnRenamed("score", "hybrid_score")


def hashed_embedding(texts: list[str | None], size: int = 64, n: int = 3) -> np.ndarray:
    """A deterministic embedding of character n-grams (texts x size), for where no model is at hand; the zero vector for no text."""
    out = np.zeros((len(texts), size), np.float32)
    codes = [np.frombuffer(" ".join((t or "").lower().split()).encode("utf-32-le", "replace"), "<u4") for t in texts]
    runs = np.array([max(0, len(c) - n + 1) for c in codes])
    if not runs.sum():
        return out
    h = np.zeros(int(runs.sum()), np.uint64)
    for k in range(n):
        h = h * np.uint64(0x9E3779B97F4A7C15) + np.concatenate([c[k : k + r] for c, r in zip(codes, runs)]).astype(np.uint64)
    h ^= h >> np.uint64(31)
    sign = np.where(h >> np.uint64(40) & np.uint64(1), 1.0, -1.0)
    cell = np.repeat(np.arange(len(texts)), runs) * size + (h % np.uint64(size)).astype(np.int64)
    return np.bincount(cell, sign, len(texts) * size).reshape(out.shape).astype(np.float32)


def embed(df: DataFrame, text: str, out: str = "embedding", *, model: Callable[[], Callable[[list[str | None]], np.ndarray]] = lambda: hashed_embedding, batch: int = 1024) -> DataFrame:
    """``df`` with the embedding of ``text``: ``model`` is a loader, called once per worker task, of a function from a list of texts to an array (texts x size).

    Questions and texts are embedded by the same call; at most ``batch`` texts go to the model at a time.
    """

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = model()
        for texts in batches:
            own = texts.where(texts.notna(), None).tolist()
            vectors = [np.asarray(encode(own[i : i + batch]), np.float32) for i in range(0, len(own), batch)]
            yield pd.Series([v for part in vectors for v in part], dtype=object)

    return df.withColumn(out, run(F.col(text)))
