"""Understanding, extraction, answers on small fixtures."""

from pyspark.sql import functions as F

from fathom.operators import answer, extract, understand

ROUTES = [("risk", ["allerg"]), ("dose", ["how much", "多少"])]


def test_detect_keeps_the_order_of_the_vocabulary(spark):
    words = spark.createDataFrame([("q", "Beta", 2), ("p", "alpha", 1), ("p", "al", 1), ("r", None, 3), (None, "x", 4)], "k string, t string, o int")
    df = spark.createDataFrame([(1, "BETA and Alpha"), (2, None), (3, ""), (1, "beta")], "detected bigint, t string")
    got = understand.detect(df, "t", words, key="k", term="t", order=F.col("o"), out="found").collect()
    assert [r["found"] for r in got] == [["p", "q"], [], [], ["q"]]


def test_detect_by_join(spark, monkeypatch):
    words = spark.createDataFrame([("q", "Beta", 2), ("p", "alpha", 1), ("p", "al", 1), ("r", None, 3), (None, "x", 4), ("z", "", 5)], "k string, t string, o int")
    df = spark.createDataFrame([(1, "BETA and Alpha"), (2, None), (3, ""), (1, "beta"), (1, "beta")], "detected bigint, t string")
    ask = lambda: sorted((r["detected"], r["t"] or "", r["found"]) for r in understand.detect(df, "t", words, key="k", term="t", order=F.col("o"), out="found").collect())
    sent = ask()
    monkeypatch.setattr(understand, "MOST_ENTRIES", 0)
    assert ask() == sent and len(sent) == 5


def test_route_by_priority(spark):
    df = spark.createDataFrame([("How much, and allergic?",), ("用多少",), ("x",), (None,)], "t string")
    assert [r[0] for r in df.select(understand.route(F.col("t"), ROUTES, "basic")).collect()] == ["risk", "dose", "basic", "basic"]


def test_media(spark):
    media = spark.createDataFrame([(0, "A", "image", None, ["x"]), (1, "B", "video", "u", ["Y", "z"])], "ord bigint, title string, media_type string, url string, keywords array<string>")
    df = spark.createDataFrame([(1, "y and X"), (2, "none"), (3, None)], "id bigint, t string")
    assert [tuple(r) for r in understand.media_for(df, "t", "id", media).orderBy("media_order").collect()] == [(1, 0, "A", "image", ""), (1, 1, "B", "video", "u")]


def test_steps(spark):
    text = "before\nSTEP 1 lost\n- a\na\nstep ２\nb\nSTEP 6\nc\n注意\n- n1\nn2\nn3\nSTEP 0\nd"
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "id bigint, t string")
    rows = extract.step_lines(df, "id", "t", notes=["注意"])
    got = [(r["bucket"], r["line"]) for r in rows.orderBy("pos").collect()]
    assert got == [(None, "before"), (1, "a"), (1, "a"), (2, "b"), (None, "c"), (0, "n1"), (0, "n2"), (0, "n3"), (None, "d")]
    lines = {r["bucket"]: r["lines"] for r in extract.step_answer(rows, "id", brief=True).collect()}
    assert lines == {1: ["a"], 2: ["b"], 0: ["n1", "n2"]}


def test_bullets(spark):
    s = "t\n- keep this\n【Q】 keep not\n1) head\nlonger than short\nkeep this"
    df = spark.createDataFrame([(s,), (None,)], "t string")
    got = [r[0] for r in df.select(extract.bullets(F.col("t"), keep=["keep"], short=2, drop=["not"])).collect()]
    assert got == [["t", "keep this", "1) head"], []]


def test_batch_answers(spark):
    questions = spark.createDataFrame([(1, "alpha how much；alpha how much。beta allergic"), (2, None), (3, "who")], "qid bigint, q string")
    texts = spark.createDataFrame([("p", "Dose\n- two drops\nEnd\nother"), ("b", "nothing")], "product_id string, text string")
    words = spark.createDataFrame([("p", "alpha", 1), ("b", "beta", 2)], "product_id string, alias string, alias_ord int")
    got = answer.answers(
        questions, texts, words, key="qid", question="q", separators=["；", "。"], routes=ROUTES, sections={"dose": (["Dose"], ["End"])}, titles={"dose": "D", "risk": "R"}, note="n", default_route="dose", keep=["drops"]
    )
    rows = {r["qid"]: r["answer"] for r in got.collect()}
    assert rows[1] == "D（资料提取）：\n结论：\n- Dose\n- two drops\n注意事项：\n- n\n\nR（资料提取）：\n结论：\n- 暂无对应资料。\n注意事项：\n- n"
    assert rows[2] == "" and "暂无" in rows[3]


def test_answers_from_all_chunks(spark):
    hit = [{"source_file": "main.txt", "chunk_id": "2", "source_type": "main"}]
    questions = spark.createDataFrame([(1, "alpha how much", hit), (2, "beta how much", []), (3, "gamma how much", None)], "qid bigint, q string, hits array<map<string,string>>")
    rows = [("p", "main", 1, "other"), ("p", "main", 10, "Dose drops ten"), ("p", "main", 2, "x\nDose\ndrops two"), ("p", "main", 3, "drops three\nEnd\ndrops four"), ("p", "faq", 1, "Dose drops faq"),
            ("b", "main", 1, "nothing"), ("b", "faq", 1, "drops none"), ("b", "faq", 2, "Dose\ndrops b\nEnd"), ("b", "faq", 3, "drops c"), ("g", "main", 1, "none")]
    texts = spark.createDataFrame(rows, "product_id string, source_type string, chunk_id bigint, text string").repartition(3)
    words = spark.createDataFrame([("p", "alpha", 1), ("b", "beta", 2), ("g", "gamma", 3)], "product_id string, alias string, alias_ord int")
    evidence = F.transform("hits", lambda m: answer.evidence_line(m["source_file"], m["chunk_id"], m["source_type"]))
    got = answer.answers(
        questions, texts, words, key="qid", question="q", separators=["；"], routes=ROUTES, sections={"dose": (["Dose"], ["End"])}, titles={"dose": "D"}, note="n", default_route="dose", keep=["drops"], evidence=evidence
    )
    said = {r["qid"]: r["answer"] for r in got.collect()}
    assert said[1] == "D（资料提取）：\n结论：\n- Dose\n- drops two\n- drops three\n依据：\n- 来源文件：main.txt｜段落：2｜类型：main\n注意事项：\n- n"
    assert said[2] == "D（资料提取）：\n结论：\n- Dose\n- drops b\n- End\n- drops c\n注意事项：\n- n"
    assert "暂无" in said[3]


def test_evidence_from_search_and_risk_note(spark):
    questions = spark.createDataFrame([(1, "alpha how much drops"), (2, "alpha allergic"), (3, "who knows"), (4, "beta how much")], "qid bigint, q string")
    rows = [("p", "main", "main.txt", 1, 10, "Dose\n- two drops\nEnd"), ("p", "main", "main.txt", 2, 11, "how much drops alpha"), ("p", "faq", "faq.txt", 1, 12, "other words"), ("p", "faq", "faq.txt", 2, 13, "other words"), ("b", "main", "main.txt", 1, 14, None)]
    texts = spark.createDataFrame(rows, "product_id string, source_type string, source_file string, chunk_id bigint, id bigint, text string").repartition(3)
    words = spark.createDataFrame([("p", "alpha", 1), ("b", "beta", 2)], "product_id string, alias string, alias_ord int")
    got = answer.answers(
        questions, texts, words, key="qid", question="q", separators=["；"], routes=ROUTES, sections={"dose": (["Dose"], ["End"])}, titles={"dose": "D", "risk": "R"}, note="n", default_route="dose", keep=["drops"], search_in=texts, risk=("risk", "ask a doctor"), fallback=["a", "b"]
    )
    said = {r["qid"]: r["answer"].split("\n") for r in got.collect()}
    lines = [x for x in said[1] if x.startswith("- 来源文件")]
    assert len(lines) == 3 and set(lines) >= {"- 来源文件：main.txt｜段落：1｜类型：main", "- 来源文件：main.txt｜段落：2｜类型：main"}  # equal texts once
    assert lines[0] == "- 来源文件：main.txt｜段落：2｜类型：main"  # the words of the question
    assert said[2][-2:] == ["需医生评估项：", "- ask a doctor"] and said[2][2:4] == ["- a", "- b"] and "依据：" in said[2]
    assert "依据：" not in said[3] and "依据：" not in said[4]


def test_steps_by_route_and_mode(spark):
    text = "Keep\nSTEP 1\n- a\n- b\nSTEP 2\nc\nSTEP 7\nx\nNotes\nn1\nn2\nn3"
    questions = spark.createDataFrame([(1, "alpha how much"), (2, "beta how much")], "qid bigint, q string")
    texts = spark.createDataFrame([("p", text), ("b", "Keep nothing")], "product_id string, text string")
    words = spark.createDataFrame([("p", "alpha", 1), ("b", "beta", 2)], "product_id string, alias string, alias_ord int")
    ask = lambda mode: {r["qid"]: r["answer"] for r in answer.answers(questions, texts, words, key="qid", question="q", separators=["；"], routes=ROUTES, sections={"dose": (["Keep"], [])}, titles={"dose": "D"}, note="n", default_route="dose", keep=[], steps={"dose": ["Notes"]}, mode=mode).collect()}
    assert ask("brief")[1] == "D（资料提取）：\n结论：\n- 【步骤】\n- STEP 1：\n- a\n- STEP 2：\n- c\n- 【注意事项】\n- n1\n- n2\n注意事项：\n- n"
    full = ask("full")
    assert "- a\n- b\n- STEP 2" in full[1] and "- n3" in full[1] and "暂无" in full[2]


def test_filters_and_budgets_of_routes(spark):
    text = "T\nkeep 1 mm\nkeep noise mm\nkeep two\nkeep 3 mm\nkeep 3 mm\nlonger than short mm"
    pieces = spark.createDataFrame([("p", "a", 1, text), ("p", "b", 1, "T"), ("p", "c", 1, text), ("q", "a", 1, "")], "product_id string, _route string, _n bigint, _text string")
    got = answer.section_lines(pieces, keep=["keep"], short={"c": 30}, most={"a": 3, "b": 5, "c": 2}, drop={"a": ["noise"]}, only={"a": ["mm"]}, append={"a": "see a doctor", "b": "see a doctor"})
    assert {(r["product_id"], r["_route"]): r["_lines"] for r in got.collect()} == {("p", "a"): ["keep 1 mm", "keep 3 mm", "see a doctor"], ("p", "b"): ["see a doctor"], ("p", "c"): ["T", "keep 1 mm"]}


def test_rewrite(spark):
    products = spark.createDataFrame([("p", "Alpha", 1), ("p", "al", 2), ("p", "x1", 3), ("p", "x2", 4), ("p", "x3", 5), ("b", "alpha", 1), (None, "q", 1), ("c", None, 1)], "product_id string, alias string, alias_ord int")
    projects = spark.createDataFrame([("eyes", "eye", 0), ("eyes", "lid", 1)], "project_id string, alias string, alias_ord int")
    df = spark.createDataFrame([(1, " ALPHA eye today, numb；why "), (2, None), (3, "none")], "id bigint, q string")
    got = {r["id"]: r["rewrite"].asDict() for r in understand.rewrite(df, "q", products, projects, times=["today", "day"], symptoms=["numb"], separators=["；"]).collect()}
    assert got[1] == {
        "original": "ALPHA eye today, numb；why", "expanded": "ALPHA eye today, numb；why alpha Alpha al x1 x2 eye lid today day numb", "products": ["b", "p"], "projects": ["eyes"], "times": ["today", "day"], "symptoms": ["numb"], "sub_questions": ["ALPHA eye today, numb", "why"],
    }
    assert got[2]["original"] == got[2]["expanded"] == "" and got[2]["sub_questions"] == [] and got[3]["expanded"] == "none"


def test_default_product(spark):
    known = spark.createDataFrame([("b",), ("a",), (None,)], "product_id string")
    assert [understand.default_product(known, p) for p in ("b", "x", None)] == ["b", "a", "a"] and understand.default_product(known.where("false"), "x") == "x"


def test_mode(spark):
    df = spark.createDataFrame([("brief",), ("full",), ("Full",), (None,)], "m string")
    assert [r[0] for r in df.select(understand.mode_of(F.col("m"))).collect()] == ["brief", "full", "brief", "brief"]


def test_section_of_the_other_text(spark):
    df = spark.createDataFrame([("T a S b", "T x S y"), ("none", "T x S y"), (None, None)], "m string, o string")
    assert [r[0] for r in df.select(extract.section_or(F.col("m"), F.col("o"), ["T"], ["S"])).collect()] == ["T a", "T x S y", ""]


def test_respond(spark):
    media = spark.createDataFrame([(0, "A", "image", None, ["x"])], "ord bigint, title string, media_type string, url string, keywords array<string>")
    asked = spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "id bigint, q string")
    said = spark.createDataFrame([(1, "a"), (2, None)], "id bigint, answer string")
    got = {r["id"]: (r["ok"], r["answer"], [tuple(m) for m in r["media"]]) for r in answer.respond(asked, said, media, key="id", question="q").collect()}
    assert got == {1: (True, "a", [("A", "image", "")]), 2: (False, "", []), 3: (False, "", [])}


def test_awkward_tables(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "x" * 100_000), (3, "x" * 100_000)], "id bigint, t string").selectExpr("*", "t as line", "id as pos", "t as state")
    lines = extract.numbered_lines(df, "id", "t")
    assert lines.count() == 2 and extract.carried(lines, "id", F.lit(None).cast("string")).count() == 2
    none = df.where("false")
    words = spark.createDataFrame([], "k string, t string, o int")
    assert understand.detect(none, "t", words, key="k", term="t", order=F.col("o")).isEmpty()
    assert understand.detect(df, "t", words, key="k", term="t", order=F.col("o")).count() == 4
    assert extract.step_lines(none, "id", "t", notes=["n"]).isEmpty()


def test_regression(spark):
    cases = spark.createDataFrame([(1, ["a", "b"]), (2, ["z"]), (3, None)], "id bigint, expect_any array<string>")
    done = answer.regression(cases, spark.createDataFrame([(1, "xb"), (2, "y")], "id bigint, answer string"), "id")
    assert {r["id"]: r["passed"] for r in done.collect()} == {1: True, 2: False, 3: False}
