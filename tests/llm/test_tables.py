"""Operators over whole tables against brute force: near-duplicates, leaks, packing, pieces."""

import random

import pytest
from pyspark.sql import functions as F

from fathom.llm import covering, leaks, packing, pieces, queries, tokens

WORDS = [f"w{i:03d}xyz"[: 3 + i % 5] + chr(97 + i % 26) for i in range(400)]


def texts(n, rng):
    out = []
    for _ in range(n):
        out.append(" ".join(rng.choices(WORDS, k=60)))
        for _ in range(rng.randint(0, 2)):
            words = out[-1].split()
            for _ in range(rng.randint(1, 9)):
                words[rng.randrange(len(words))] = rng.choice(WORDS)
            out.append(" ".join(words))
    return out


def runs(t, w=5):
    s = covering.letters(t)
    return {s[i : i + w] for i in range(len(s) - w + 1)}


def brute(rows, similarity):
    sets = {i: runs(t) for i, t in rows if t and len(covering.letters(t)) >= 40}
    ids = sorted(sets)
    return {(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b])}


def test_masks_cover_the_radius():
    for radius, per_class in ((1, 2), (2, 1)):
        tables = covering.masks(radius, per_class)
        classes = 2 ** (radius + 1) - 1
        import itertools

        for differing in itertools.combinations(range(classes), radius):
            assert any(all(i // per_class not in differing for i in keep) for keep in tables)


def test_pigeonhole_over_all_parts():
    """Up to 15 of 24 differing classes leave a table equal, whichever they are; some 16 leave none."""
    per_part, classes = 2 ** (covering.RADIUS + 1) - 1, covering.PARTS * (2 ** (covering.RADIUS + 1) - 1)
    tables = covering.masks()
    rng = random.Random(2)

    def collides(differing):
        return any(all(part * per_part + i // covering.PER_CLASS not in differing for i in keep) for part in range(covering.PARTS) for keep in tables)

    most = covering.PARTS * (covering.RADIUS + 1) - 1
    assert most == 15 and all(collides(set(rng.sample(range(classes), most))) for _ in range(2000))
    assert not collides({part * per_part + i for part in range(covering.PARTS) for i in range(2)})


@pytest.mark.parametrize("hot", [4096, 7, 1])
def test_hot_buckets_are_split_without_loss(spark, monkeypatch, hot):
    monkeypatch.setattr(covering, "HOT", hot)
    rows = [(i, 1) for i in range(40)] + [(100 + i, 2) for i in range(3)] + [(200, 3)]
    got = [tuple(r) for r in covering.paired(spark.createDataFrame(rows, "id bigint, g int"), "g").collect()]
    want = {(a, b) for a, x in rows for b, y in rows if a < b and x == y}
    assert len(got) == len(want) and set(got) == want


def test_masks_find_the_pairs(spark, copies, monkeypatch):
    """Without the tables of the masks no pair of different texts is found."""
    _, df = copies
    monkeypatch.setattr(covering, "masks", lambda *a: [])
    monkeypatch.setattr(covering, "_keys", lambda c: covering.F.array().cast("array<int>"))
    links, _ = covering.near_duplicates(df, "id", "text", similarity=0.6)
    assert links.isEmpty()


@pytest.fixture(scope="module")
def copies(spark):
    rng = random.Random(5)
    base = texts(120, rng)
    rows = list(enumerate(base)) + [(1000 + i, base[0]) for i in range(4)] + [(2000, base[3].upper() + " !"), (2001, None), (2002, ""), (2003, "short"), (None, base[0])]
    return rows, spark.createDataFrame([(i, t, "c", 1) for i, t in rows], "id bigint, text string, same string, id_a int").repartition(3)


def test_near_duplicates(copies):
    rows, df = copies
    want = brute([r for r in rows if r[0] is not None], 0.6)
    got = covering.all_pairs(*covering.near_duplicates(df, "id", "text", similarity=0.6)).collect()
    found = {tuple(r) for r in got}
    assert len(found) == len(got) and found <= want
    assert len(found) >= 0.98 * len(want)


def test_classes(copies):
    rows, df = copies
    links, members = covering.near_duplicates(df, "id", "text", similarity=0.8)
    got = {r["id"]: (r["class_id"], r["links"]) for r in covering.classes(links, members).collect()}
    parent = {i: i for i in got}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in {tuple(r) for r in covering.all_pairs(links, members).collect()}:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    assert {i: c for i, (c, _) in got.items()} == {i: root(i) for i in got}


def test_near_duplicates_of_nothing(spark):
    none = spark.createDataFrame([], "id bigint, text string")
    links, members = covering.near_duplicates(none, "id", "text")
    assert covering.all_pairs(links, members).isEmpty() and covering.classes(links, members).isEmpty()


def test_hot_group(spark):
    rng = random.Random(9)
    hot = " ".join(rng.choices(WORDS, k=60))
    rows = [(i, hot) for i in range(300)] + [(1000 + i, t) for i, t in enumerate(texts(30, rng))]
    links, members = covering.near_duplicates(spark.createDataFrame(rows, "id bigint, text string"), "id", "text")
    got = covering.classes(links, members).where("id < 1000").select("class_id").distinct().collect()
    assert [r[0] for r in got] == [0]


def test_leaks(spark):
    rng = random.Random(3)
    han = [chr(0x4E00 + i) for i in range(0, 4000, 3)]
    refs = [(i, "zh", "".join(rng.choices(han, k=120))) for i in range(12)] + [(20, "en", " ".join(rng.choices(WORDS, k=80))), (21, "zh", None), (None, "zh", "x"), (22, None, ""), (23, "zh", "短")]
    docs = []
    for i in range(80):
        t = "".join(rng.choices(han, k=rng.choice([0, 10, 300, 3000])))
        if i % 3 == 0:
            r = rng.choice(refs[:13])[2]
            a = rng.randrange(0, len(r) - 25)
            t = t[: len(t) // 2] + "。" + r[a : a + rng.choice([15, 23, 24, 25, 40, 90])] + "，" + t[len(t) // 2 :]
        docs.append((i, t, "x"))
    docs += [(100, None, "x"), (None, refs[0][2], "x"), (101, refs[0][2], "x"), (101, refs[0][2], "x")]
    letters = {i: leaks.letters(t) for i, t, _ in docs if i is not None}
    want = set()
    for c, lang, ref in refs:
        k, s = (24 if lang == "zh" else 60), leaks.letters(ref)
        own = {s[p : p + k] for p in range(len(s) - k + 1)}
        want |= {(i, c) for i, t in letters.items() if c is not None and any(t[p : p + k] in own for p in range(len(t) - k + 1))}
    cases = spark.createDataFrame(refs, "case_id bigint, lang string, reference string")
    df = spark.createDataFrame(docs, "id bigint, text string, case_id string").repartition(3)
    assert {tuple(r) for r in leaks.leaked(df, "id", "text", cases).collect()} == want
    assert {tuple(r) for r in leaks.leaked(df, "id", "text", cases, block_size=5).collect()} == want
    assert leaks.leaked(df, "id", "text", cases.where("false")).isEmpty()
    assert leaks.leaked(df.where("false"), "id", "text", cases).isEmpty()


def test_singular_vectors_of_the_sketch():
    import numpy as np

    rng = np.random.default_rng(1)
    a = rng.standard_normal((400, 12)) @ rng.standard_normal((12, 90)) * 3 + 0.01 * rng.standard_normal((400, 90))
    omega = rng.standard_normal((90, 30))
    basis, values = leaks.singular(a.T @ (a @ omega), omega, 12)
    _, s, v = np.linalg.svd(a, full_matrices=False)
    assert np.allclose(values, s[:12], rtol=1e-3)
    assert np.allclose(np.linalg.svd(basis @ v[:12].T)[1], 1, atol=1e-3)  # the same space


def test_cosine_decides_what_is_checked(spark):
    rng = random.Random(13)
    han = [chr(0x4E00 + i) for i in range(0, 4000, 3)]
    ref = "".join(rng.choices(han, k=90))
    cases = spark.createDataFrame([(1, "zh", ref)], "case_id bigint, lang string, reference string")
    df = spark.createDataFrame([(1, ref[10:50]), (2, "".join(rng.choices(han, k=90)))], "id bigint, text string")
    assert [tuple(r) for r in leaks.leaked(df, "id", "text", cases).collect()] == [(1, 1)]
    assert leaks.leaked(df, "id", "text", cases, least_cosine=1.5).isEmpty()  # without the search nothing is found


def test_rewordings_against_all_pairs(spark):
    rng = random.Random(17)
    han = [chr(0x4E00 + i) for i in range(0, 4000, 3)]
    refs = [(i, "zh", "".join(rng.choices(han, k=70)), [f"{5000 + 7 * i}", f"{91000 + i}"]) for i in range(15)]
    refs = [(i, lang, r[:20] + a[0] + r[20:40] + a[1] + r[40:], a) for i, lang, r, a in refs] + [(90, "zh", None, ["1"]), (91, "zh", refs[0][2], None)]
    docs, planted = [], set()
    for i in range(120):
        text = "".join(rng.choices(han, k=rng.choice([0, 50, 400])))
        if i % 2 == 0:
            c, _, r, a = refs[i // 2 % 15]
            words = list(r)
            if i % 4 == 0:  # every ninth letter another, the answers kept
                words = [w if n % 9 or w.isdigit() else rng.choice(han) for n, w in enumerate(words)]
                planted.add((i, c))
            else:  # other answers
                words = list(r.replace(a[0], "4444").replace(a[1], "88888"))
                words = [w if n % 9 or w.isdigit() else rng.choice(han) for n, w in enumerate(words)]
            text = text + "。" + "".join(words) + "，" + text[:30]
        docs.append((i, text))
    docs += [(200, None), (None, refs[0][2]), (201, refs[3][2])]  # the last is an exact leak
    df = spark.createDataFrame(docs, "id bigint, text string").repartition(3)
    cases = spark.createDataFrame(refs, "case_id bigint, lang string, reference string, expect_any array<string>")
    found = {tuple(r) for r in leaks.reworded(df, "id", "text", cases).collect()}
    assert {f for f in found if f[1] < 90} <= planted and len(found & planted) >= 0.9 * len(planted)
    assert leaks.common("abcdef", "xaybzcd") == 4 and leaks.common("", "a") == 0


def test_run_hashes():
    text = "abcdefghij" * 7
    h = leaks.run_hashes(text, [24, 60])
    assert [len(h[24]), len(h[60])] == [47, 11] and h[24][0] == h[24][10] != h[24][1] and h[60][0] == h[60][10]
    assert not len(leaks.run_hashes("ab", [24])[24])


def test_filling_is_the_best():
    import itertools

    rng = random.Random(2)
    for _ in range(60):
        counts = {rng.randint(1, 30): rng.randint(1, 3) for _ in range(5)}
        room = rng.randint(1, 60)
        items = [s for s, n in counts.items() for _ in range(n)]
        best = max(sum(c) for k in range(len(items) + 1) for c in itertools.combinations(items, k) if sum(c) <= room)
        used = packing.best_filling(room, counts)
        assert sum(s * n for s, n in used.items()) == best and all(n <= counts[s] for s, n in used.items())


def test_pack(spark):
    rng = random.Random(4)
    docs = [(i, " ".join(rng.choices(WORDS, k=rng.choice([0, 1, 5, 9, 9, 9, 20, 70])))) for i in range(300)] + [(500, None), (None, "x"), (7, "again")]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "id bigint, text string, size int, container int").repartition(4)
    got = packing.pack(df, "id", "text", capacity=100).collect()
    held: dict = {}
    for r in got:
        if r["container"] >= 0:
            held.setdefault(r["container"], []).append((r["position"], r["size"]))
    assert sorted(held) == list(range(len(held)))
    assert all(sum(s for _, s in v) <= 100 and sorted(p for p, _ in v) == list(range(len(v))) for v in held.values())
    total = sum(tokens.count(t) for i, t in docs if i is not None)
    assert sum(r["size"] for r in got) == total
    assert -(-total // 100) <= len(held) <= 1.05 * total / 100 + 1
    assert {r["id"] for r in got if r["part"] > 0} == {i for i, t in docs if t and tokens.count(t) > 100}
    assert packing.pack(df.where("false"), "id", "text").isEmpty()


def whole(rows, text, limit):
    done = 0
    for n, r in enumerate(rows):
        assert r["piece"] == n and r["begin"] <= done < r["end"] and r["text"] == text[r["begin"] : r["end"]] and r["tokens"] <= limit
        assert n == 0 or r["begin"] > rows[n - 1]["begin"]
        done = r["end"]
    assert done == len(text)


@pytest.mark.parametrize("range_chars", [10**6, 700])
def test_split(spark, range_chars, monkeypatch):
    monkeypatch.setattr(pieces, "BLOCK", 3)
    rng = random.Random(6)
    para = lambda k: "。".join("".join(rng.choices("门店反馈称颈部厚度读数平均持续", k=20)) for _ in range(k)) + "。\n\n"
    docs = {1: "".join(para(4) for _ in range(30)), 2: "x" * 4000, 3: " ".join(rng.choices(WORDS, k=3000)), 4: "短。", 5: "", 7: "# 标题\n" + para(40) + "| a | b |\n" * 200, 8: "🙏" * 900}
    df = spark.createDataFrame([(i, t, 0) for i, t in docs.items()] + [(6, None, 0), (None, docs[1], 0)], "id bigint, text string, begin int")
    got = pieces.split(df, "id", "text", range_chars=range_chars).orderBy("id", "piece").collect()
    assert {r["id"] for r in got} == {i for i, t in docs.items() if tokens.count(t) > 512}
    for i in {r["id"] for r in got}:
        rows = [r for r in got if r["id"] == i]
        whole(rows, docs[i], 512)
        assert all(20 <= r["overlap"] <= 110 for r in rows[1:]), (i, [(r["piece"], r["begin"], r["end"], r["overlap"], r["tokens"]) for r in rows if not 20 <= r["overlap"] <= 110])


def test_split_counts_pieces_exactly_and_keeps_repeated_rows(spark):
    rng = random.Random(11)
    text = "".join(rng.choice(["。", "，", "\n", "\n\n", " ", ". ", "it's ", "’", "  \n ", "“", "7"]) + "".join(rng.choices("门店反馈称颈部abcde", k=rng.randint(1, 30))) for _ in range(3000))
    df = spark.createDataFrame([(1, text), (1, text)], "id bigint, text string")
    got = pieces.split(df, "id", "text", range_chars=900).orderBy("piece").collect()
    whole(got[::2], text, 512)
    assert got[::2] == got[1::2] and all(r["tokens"] == tokens.count(r["text"]) for r in got)
    assert sum(r["tokens"] for r in got[::2]) > 0.75 * 512 * (len(got) // 2 - 1)


def test_ranges_yield_all_pieces(spark, monkeypatch):
    """Without the tables of the ranges there are no pieces: no text goes another way."""
    text = "门店反馈称，颈部的厚度读数平均持续七周。" * 200
    df = spark.createDataFrame([(1, text), (2, "短。" * 60)], "id bigint, text string")
    (ranges,) = pieces._tables(512, 64, 500, 64, tokens.FOLDER, tokens.FILE)(iter([df.selectExpr("id as row", "id", "text").toPandas()]))
    assert set(ranges["id"]) == {1} and "".join(ranges["own"]) == text and len(ranges) == 8
    monkeypatch.setattr(pieces, "_tables", lambda *a: lambda batches: (b[:0] for b in ()))
    assert pieces.split(df, "id", "text").isEmpty()


def test_split_files(spark, tmp_path):
    rng = random.Random(8)
    text = "".join("".join(rng.choices("门店反馈称颈部厚度é", k=rng.randint(5, 40))) + "。\n" for _ in range(900))
    (tmp_path / "big.txt").write_text(text, encoding="utf-8")
    got = pieces.split_files(spark, str(tmp_path), range_bytes=5000).orderBy("piece").collect()
    whole(got, text, 512)


def test_queries_on_the_smallest_tables(spark, data):
    for name in ("p1_groups", "p2_repaired", "p3_found", "p4_redacted", "p5_forms", "p5_groups"):
        assert queries.QUERIES[name](spark, data).limit(1).collect()
    found = {n: queries.QUERIES[n](spark, data) for n in ("p1_found", "p2_found", "p3_found", "p4_found", "p5_found", "p7_found")}
    assert {n: df.columns for n, df in found.items()} == {
        "p1_found": ["ord_a", "ord_b"], "p2_found": ["source_table", "row_id"], "p3_found": ["qa_id", "defect"], "p4_found": ["qa_id", "field_name", "pii_type"], "p5_found": ["source_table", "row_id"], "p7_found": ["doc_id", "case_id"],
    }
    for df in found.values():
        assert df.count() == df.distinct().count() > 0
        assert all(t == ("bigint" if c in ("ord_a", "ord_b", "row_id", "qa_id", "doc_id", "case_id") else "string") for c, t in df.dtypes)


def test_p1_groups_has_every_row(spark, data):
    got = queries.p1_groups(spark, data).collect()
    docs = {r["ord"] for r in spark.read.parquet(f"{data}/docs.parquet").select("ord").collect()}
    assert sorted(r["ord"] for r in got) == sorted(docs) and all(r["class_id"] <= r["ord"] for r in got)


def test_p1_groups_by_links_of_p1_and_short_texts(spark, tmp_path):
    rng = random.Random(12)
    base = rng.choices(WORDS, k=60)
    near = [w if i % 8 else WORDS[i] for i, w in enumerate(base)]
    alike = len(runs(" ".join(base)) & runs(" ".join(near))) / len(runs(" ".join(base)) | runs(" ".join(near)))
    assert 0.62 < alike < 0.78
    rows = [(5, " ".join(base)), (7, " ".join(near)), (1, "Ab"), (2, "a b!"), (3, "。"), (4, "。"), (6, None), (8, "ac")]
    spark.createDataFrame(rows, "ord bigint, text string").write.parquet(f"{tmp_path}/docs.parquet")
    got = {r["ord"]: (r["class_id"], r["links"]) for r in queries.p1_groups(spark, str(tmp_path)).collect()}
    assert got == {5: (5, 1), 7: (5, 1), 1: (1, 0), 2: (1, 0), 3: (3, 0), 4: (4, 0), 6: (6, 0), 8: (8, 0)}


def test_p5_groups_across_both_tables(spark, tmp_path):
    spark.createDataFrame([(1, "Alpha"), (2, "other"), (3, None)], "ord bigint, text string").write.parquet(f"{tmp_path}/docs.parquet")
    spark.createDataFrame([(1, "Αlphа"), (2, None)], "qa_id bigint, question string").write.parquet(f"{tmp_path}/qa_log.parquet")
    got = queries.p5_groups(spark, str(tmp_path)).collect()
    sizes = {(r["source_table"], r["row_id"]): (r["group_size"], r["n_forms"]) for r in got}
    assert sizes == {("docs", 1): (2, 2), ("qa_log", 1): (2, 2), ("docs", 2): (1, 1)}
    assert len({r["skeleton_hash"] for r in got}) == 2


def test_p1_against_brute_force(spark, data):
    from fathom.llm import garble

    docs = [(r["ord"], r["text"]) for r in spark.read.parquet(f"{data}/docs.parquet").where(F.col("text").isNotNull()).collect()]
    want = brute([(i, t) for i, t in docs if not garble.is_garbled(t)], 0.6)
    assert {tuple(r) for r in queries.p1_found(spark, data).collect()} == want
