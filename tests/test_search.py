"""Search and merging against brute force; nulls, ties, repeated rows, empty tables."""

import numpy as np
from pyspark.sql import functions as F

from fathom.operators import search


def test_vector_topk_is_exact(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.standard_normal(8).astype(float).tolist(), "x") for i in range(200)] + [(200, None, "n"), (201, [0.0] * 8, "z"), (202, rng.standard_normal(8).tolist(), "r")]
    rows += [(203, rows[0][1], "tie")]
    df = spark.createDataFrame(rows, "id bigint, v array<double>, score string").repartition(5)
    hits = search.vector_topk(df.where("id % 20 = 0"), df, qid="id", qvec="v", key="id", vec="v", k=7).collect()
    unit = {i: np.array(v) / (np.linalg.norm(v) or 1) for i, v, _ in rows if v}
    for q in {h["qid"] for h in hits}:
        own = sorted((h["rank"], h["id"]) for h in hits if h["qid"] == q)
        want = sorted(unit, key=lambda i: (-round(float(unit[q] @ unit[i]), 12), i))[:7]
        assert [i for _, i in own] == want
    assert {h["qid"] for h in hits} == {i for i in unit if i % 20 == 0}


def test_least_score(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [-1.0, 0.0])], "id bigint, v array<double>")
    hits = search.vector_topk(df, df, qid="id", qvec="v", key="id", vec="v", min_score=0.5).collect()
    assert {(h["qid"], h["id"]) for h in hits} == {(1, 1), (2, 2), (3, 3)}


def test_vector_topk_on_nothing(spark):
    none = spark.createDataFrame([], "id bigint, v array<double>")
    assert search.vector_topk(none, none, qid="id", qvec="v", key="id", vec="v").collect() == []


def test_blocks_of_queries(spark, monkeypatch):
    monkeypatch.setattr(search, "BLOCK", 3)
    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(12)], "id bigint, v array<double>")
    blocks = search.vector_topk(df, df, qid="id", qvec="v", key="id", vec="v", k=2)
    monkeypatch.setattr(search, "ROWS", 5)
    cells = search.vector_topk(df, df, qid="id", qvec="v", key="id", vec="v", k=2)
    monkeypatch.setattr(search, "BLOCK", 4096)
    sent = search.vector_topk(df, df, qid="id", qvec="v", key="id", vec="v", k=2)
    plain = lambda d: sorted((r["qid"], r["rank"], r["id"], round(r["score"], 9)) for r in d.collect())
    assert len(plain(sent)) == 24 and plain(blocks) == plain(cells) == plain(sent)


def test_keyword_cells(spark, monkeypatch):
    docs = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(i % 7))) for i in range(60)], "d bigint, t string")
    queries = spark.createDataFrame([(i, f"w{i} w{i + 1} zz") for i in range(9)] + [(20, None)], "q bigint, t string")
    ask = lambda: sorted(map(tuple, search.keyword_topk(queries, docs, qid="q", query="t", key="d", text="t", k=4).collect()))
    sent = ask()
    monkeypatch.setattr(search, "BLOCK", 2)
    monkeypatch.setattr(search, "ROWS", 17)
    assert sent and ask() == sent


def test_ties_of_equal_rows(spark):
    df = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(50)] + [(7, [1.0, 0.0])], "id bigint, v array<double>").repartition(4)
    got = search.vector_topk(df.where("id = 3"), df, qid="id", qvec="v", key="id", vec="v", k=10).orderBy("rank").collect()
    assert [r["id"] for r in got] == [0, 1, 2, 3, 4, 5, 6, 7, 7, 8]


def test_keyword_topk(spark):
    queries = spark.createDataFrame([(1, "a b a"), (2, None), (3, "ZZ"), (4, "，")], "q bigint, t string")
    docs = spark.createDataFrame([(1, "A x"), (2, "b"), (3, "ab"), (4, None), (5, ""), (3, "ab")], "d bigint, t string")
    got = [tuple(r) for r in search.keyword_topk(queries, docs, qid="q", query="t", key="d", text="t", k=3).orderBy("rank").collect()]
    assert [(g[1], round(g[2], 3)) for g in got] == [(3, 1.0), (3, 1.0), (1, 0.667)]


def brute_merge(vector, keyword, k):
    merged = {}
    for text, i, s in vector:
        place = merged[text]["place"] if text in merged else (0, len(merged))
        merged[text] = {"id": i, "v": s, "k": 0.0, "place": place}
    for n, (text, i, s) in enumerate(keyword):
        row = merged.setdefault(text, {"id": i, "v": 0.0, "k": 0.0, "place": (1, n)})
        row["k"] += s
    order = sorted(merged, key=lambda t: (-(0.65 * merged[t]["v"] + 0.35 * merged[t]["k"]), merged[t]["place"]))
    return [(t, merged[t]["id"]) for t in order[:k]]


def test_merge_hybrid(spark):
    rng = np.random.default_rng(3)
    lists, rows = {}, {"v": [], "k": []}
    for q in range(60):
        for side in "vk":
            n = int(rng.integers(0, 6))
            hits = [(str(rng.integers(0, 5)), int(rng.integers(0, 99)), float(rng.choice([-0.5, 0.0, 0.5, 1.0]))) for _ in range(n)]
            lists[q, side] = hits
            rows[side] += [(q, t, i, s, r + 1) for r, (t, i, s) in enumerate(hits)]
    schema = "qid bigint, text string, id bigint, score double, rank bigint"
    got = search.merge_hybrid(spark.createDataFrame(rows["v"], schema), spark.createDataFrame(rows["k"], schema), k=4).orderBy("qid", "rank").collect()
    for q in range(60):
        assert [(r["text"], r["id"]) for r in got if r["qid"] == q] == brute_merge(lists[q, "v"], lists[q, "k"], 4)


def test_least_scores_of_the_merge(spark):
    schema = "qid bigint, text string, id bigint, score double, rank bigint"
    v = spark.createDataFrame([(1, "a", 1, 1.0, 1), (1, "b", 2, 0.5, 2), (2, "a", 1, 0.5, 1)], schema)
    k = spark.createDataFrame([(1, "c", 3, 1.0, 1)], schema)
    ids = lambda **x: sorted((r["qid"], r["id"]) for r in search.merge_hybrid(v, k, **x).collect())
    assert ids() == [(1, 1), (1, 2), (1, 3), (2, 1)] and ids(min_score=0.34) == [(1, 1), (1, 3)]
    assert ids(min_scores=spark.createDataFrame([(1, 0.6)], "qid bigint, min_score double")) == [(1, 1), (2, 1)]


def test_strong_words(spark):
    df = spark.createDataFrame([("neck lip x", "the Neck and LIP"), ("neck", "none"), (None, None)], "q string, t string")
    got = [r[0] for r in df.select(search.keyword_score(F.col("q"), F.col("t"), ["NECK", "lip"], 0.25)).collect()]
    assert [round(g, 6) for g in got] == [round(2 / 3 + 0.5, 6), 0.0, 0.0]


def test_embedding_is_stable(spark):
    df = spark.createDataFrame([("abc def",), (None,), ("",)], "t string")
    v = [r[0] for r in search.embed(df, "t").select("embedding").collect()]
    assert v[0] == search.hashed_embedding(["abc  DEF"])[0].tolist() and not any(v[1]) and not any(v[2])
    assert [i for i, x in enumerate(search.hashed_embedding(["abc"], 8)[0]) if x] == [int(i) for i in np.flatnonzero(search.hashed_embedding(["ABC "], 8)[0])]


def test_model_is_loaded_once_a_task_and_called_by_batches(spark):
    def load():
        calls = []

        def encode(texts):
            calls.append(len(texts))
            return np.array([[float(len(t or "")), float(len(calls)), float(max(calls))] for t in texts])

        return encode

    df = spark.createDataFrame([("x" * i,) for i in range(10)], "t string").coalesce(1)
    got = [r[0] for r in search.embed(df, "t", model=load, batch=4).select("embedding").collect()]
    assert [g[0] for g in got] == list(range(10)) and [g[1] for g in got] == [1, 1, 1, 1, 2, 2, 2, 2, 3, 3] and max(g[2] for g in got) == 4


def test_keyword_score(spark):
    df = spark.createDataFrame([("a b", "B"), ("", "x"), (None, None)], "q string, t string")
    assert [r[0] for r in df.select(search.keyword_score(F.col("q"), F.col("t"))).collect()] == [0.5, 0.0, 0.0]
