"""Registered queries over whole tables, and their oracle SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fathom.functions import text as X
from fathom.functions import vector as V
from fathom.operators import answer, chunk, extract, search, understand
from fathom.sources import files, shared, tables

# What parts of a question are divided by.
SEPARATORS = ["；", ";", "。", "，另外", "并且", "同时", "还有"]
ROUTES = [
    ("risk", ["孕期", "过敏", "抗凝", "pregnan", "allerg"]),
    ("combination", ["一起用", "先做哪个", "可以配", "mix", "be used with", "mêler", "Verträgt"]),
    ("aftercare", ["洗澡", "紧绷", "怎么办", "shower", "What should I do", "Was tun", "duschen", "doucher"]),
    ("dose", ["多少", "毫升", "浓度", "How much", "contain", "deep"]),
    ("storage", ["开封", "储存", "温度", "keep at", "hält", "garder"]),
    ("origin", ["批次", "原装", "是不是", "Who makes", "lot ", "vérifier"]),
]
DEFAULT_ROUTE, DEFAULT_PRODUCT, BOOST = "basic", "mozella", 0.15
WORDS = ["眼周", "面颊", "颈部", "唇周", "泪沟", "cheeks", "neck", "lip"]
TIMES = ["多久", "几天", "小时", "hours", "weeks", "Stunden", "heures"]
PROJECTS = [("eyes", ["眼周", "泪沟", "眼下", "眉间"]), ("neck", ["颈部", "锁骨区", "neck"]), ("lips", ["唇周", "唇缘", "lip"])]
TITLES, STOPS = ["用量", "Dose", "Mengen", "【Q】"], ["来源", "存放", "Storage", "【A】"]
MARKERS = r"^(#{1,6} |[一二三四五六七八九十]、|【问】|Q: |Frage: )"
CASE_ROUTES = {"risk": "人群提醒", "combination": "组合安排", "aftercare": "护理提示", "dose": "用量说明", "storage": "储存须知", "origin": "来源核验", "basic": "品类介绍"}
NOTE = "以上为资料整理结果，不替代现场评估。"


def _t(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return tables.table(spark, folder, name) if name in ("documents", "docs", "qa_log") else spark.read.parquet(f"{folder}/{name}.parquet")


def l2_normalize(spark: SparkSession, folder: str) -> DataFrame:
    v = _t(spark, folder, "embeddings").withColumn("u", V.normalize(F.col("embedding")))
    return v.select("vec_id", F.round(V.norm(F.col("embedding")), 6).alias("norm"), F.round(V.norm(F.col("u")), 6).alias("unit"), F.round(F.col("u")[0], 6).alias("first"))


def vector_topk(spark: SparkSession, folder: str) -> DataFrame:
    e = _t(spark, folder, "embeddings")
    hits = search.vector_topk(e.where("vec_id % 20 = 0"), e, qid="vec_id", qvec="embedding", key="vec_id", vec="embedding")
    return hits.select("qid", "id", F.round("score", 6).alias("score"), "rank")


def keyword_topk(spark: SparkSession, folder: str) -> DataFrame:
    cases = _t(spark, folder, "regression_cases").where("case_id % 20 = 0")
    cases = cases.withColumn("query", F.concat_ws(" ", F.col("q"), F.array_join("expect_any", " ")))
    hits = search.keyword_topk(cases, _t(spark, folder, "documents"), qid="case_id", query="query", key="doc_id", text="text")
    return hits.select("qid", "id", F.round("score", 6).alias("score"), "rank")


def hybrid_topk(spark: SparkSession, folder: str) -> DataFrame:
    """Rewritten questions with the vector of their number, against the documents."""
    docs, vectors = _t(spark, folder, "documents").select("doc_id", "text"), _t(spark, folder, "embeddings")
    rows = docs.join(vectors, F.col("doc_id") == F.col("vec_id"))
    asked = _t(spark, folder, "qa_log").where("qa_id % 20 = 0").select("qa_id", "rewritten_query").join(vectors, F.col("qa_id") == F.col("vec_id"))
    vector = search.vector_topk(asked, rows, qid="qa_id", qvec="embedding", key="doc_id", vec="embedding")
    keyword = search.keyword_topk(asked, docs, qid="qa_id", query="rewritten_query", key="doc_id", text="text")
    texts = docs.select(F.col("doc_id").alias("id"), "text")
    with_text = lambda h: h.join(texts.where(F.col("text").isNotNull()), "id").select("qid", "text", "id", "score", "rank")
    merged = search.merge_hybrid(with_text(vector), with_text(keyword))
    return merged.select("qid", "id", F.round("vector_score", 6).alias("vector_score"), F.round("keyword_score", 6).alias("keyword_score"), F.round("hybrid_score", 6).alias("hybrid_score"), "rank")


def keyword_score(spark: SparkSession, folder: str) -> DataFrame:
    q = _t(spark, folder, "qa_log")
    return q.select("qa_id", F.round(search.keyword_score(F.col("rewritten_query"), F.col("answer")), 6).alias("score"))


def chunk_fixed(spark: SparkSession, folder: str) -> DataFrame:
    rows = chunk.records(_t(spark, folder, "documents"), ["doc_id"], "text", chunk.fixed_windows(F.col("text")))
    return rows.select("doc_id", "chunk_id", F.length("text").cast("bigint").alias("n"), F.md5("text").alias("digest"))


def chunk_counts(spark: SparkSession, folder: str) -> DataFrame:
    rows = _t(spark, folder, "documents").select(F.coalesce("product_id", F.lit("")).alias("product_id"), F.size(chunk.fixed_windows(F.col("text"))).alias("n"))
    return rows.groupBy("product_id").agg(F.sum("n").cast("bigint").alias("chunks"), F.count("*").alias("files"))


def chunk_packed(spark: SparkSession, folder: str) -> DataFrame:
    return chunk.records(_t(spark, folder, "documents"), ["doc_id"], "text", chunk.packed(F.col("text")))


def normalize_lines(spark: SparkSession, folder: str) -> DataFrame:
    return extract.numbered_lines(_t(spark, folder, "documents"), "doc_id", "text")


def unique_lines(spark: SparkSession, folder: str) -> DataFrame:
    d = _t(spark, folder, "documents").select("doc_id", F.posexplode(X.unique(F.split(F.coalesce(X.normalize_newlines(F.col("text")), F.lit("")), "\n"))).alias("p", "line"))
    return d.select("doc_id", (F.col("p") + 1).cast("bigint").alias("pos"), "line")


def section_block(spark: SparkSession, folder: str) -> DataFrame:
    s = F.col("section")
    cut = _t(spark, folder, "documents").select("doc_id", X.section(F.col("text"), TITLES, STOPS).alias("section"))
    return cut.select("doc_id", F.length(s).cast("bigint").alias("n"), F.md5(s).alias("digest"))


def detect_terms(spark: SparkSession, folder: str) -> DataFrame:
    vocabulary = _t(spark, folder, "product_aliases").groupBy("product_id", "alias").agg(F.min("alias_ord").alias("o"))
    rank = F.dense_rank().over(Window.orderBy("product_id"))  # the vocabulary has one size at every scale
    found = understand.detect(_t(spark, folder, "qa_log").select("qa_id", "question"), "question", vocabulary.withColumn("o", rank), key="product_id", term="alias", order=F.col("o"))
    return found.select("qa_id", F.array_join("detected", ",").alias("products"))


def resolved_products(spark: SparkSession, folder: str) -> DataFrame:
    """The first product of every question, else the default one if there are texts of it, else the first by name."""
    default = understand.default_product(_t(spark, folder, "docs").select("meta.product_id"), DEFAULT_PRODUCT)
    first = F.try_element_at(F.filter(F.split("products", ","), lambda p: p != ""), F.lit(1))
    return detect_terms(spark, folder).select("qa_id", F.coalesce(first, F.lit(default)).alias("product_id"))


def strong_score(spark: SparkSession, folder: str) -> DataFrame:
    q = _t(spark, folder, "qa_log")
    return q.select("qa_id", F.round(search.keyword_score(F.col("rewritten_query"), F.col("answer"), WORDS, BOOST), 6).alias("score"))


def ambiguous_questions(spark: SparkSession, folder: str) -> DataFrame:
    found = detect_terms(spark, folder).withColumn("n", F.size(F.split("products", ",")).cast("bigint"))
    return found.where("n > 1").select("qa_id", "n")


def detect_route(spark: SparkSession, folder: str) -> DataFrame:
    return _t(spark, folder, "qa_log").select("qa_id", understand.route(F.col("question"), ROUTES, DEFAULT_ROUTE).alias("route"))


def route_counts(spark: SparkSession, folder: str) -> DataFrame:
    q = _t(spark, folder, "qa_log").select(understand.route(F.col("question"), ROUTES, DEFAULT_ROUTE).alias("route"), "hit", "latency_ms")
    ok = F.when(F.col("latency_ms") >= 0, F.col("latency_ms"))
    return q.groupBy("route").agg(F.count("*").alias("n"), F.count_if(~F.coalesce("hit", F.lit(False))).alias("misses"), F.round(F.avg(ok), 4).alias("latency"), F.max(ok).cast("bigint").alias("slowest"))


def split_questions(spark: SparkSession, folder: str) -> DataFrame:
    q = _t(spark, folder, "qa_log").select("qa_id", F.posexplode(X.split_questions(F.col("question"), SEPARATORS)).alias("p", "part"))
    return q.select("qa_id", (F.col("p") + 1).cast("bigint").alias("pos"), "part")


def rewrite_expand(spark: SparkSession, folder: str) -> DataFrame:
    aliases = _t(spark, folder, "product_aliases").groupBy("product_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("alias_ord", "alias"))), lambda x: x["alias"]).alias("aliases"))
    q = _t(spark, folder, "qa_log").select("qa_id", "question", F.col("meta")["product_id"].alias("product_id")).join(aliases, "product_id", "left")
    return q.select("qa_id", understand.expand(F.col("question"), F.col("aliases"), WORDS).alias("expanded"))


def _projects(spark: SparkSession) -> DataFrame:
    rows = [F.struct(F.lit(p).alias("project_id"), F.lit(a).alias("alias"), F.lit(i).alias("alias_ord")) for p, names in PROJECTS for i, a in enumerate(names)]
    return spark.range(1).select(F.inline(F.array(*rows)))


def rewrite_struct(spark: SparkSession, folder: str) -> DataFrame:
    """Every question rewritten by what is detected in it."""
    products = _t(spark, folder, "product_aliases").select("product_id", "alias", "alias_ord")
    r = understand.rewrite(_t(spark, folder, "qa_log").select("qa_id", "question"), "question", products, _projects(spark), times=TIMES, symptoms=WORDS, separators=SEPARATORS)
    joined = lambda c: F.array_join(f"rewrite.{c}", ",").alias(c)
    return r.select("qa_id", "rewrite.original", "rewrite.expanded", joined("products"), joined("projects"), joined("times"), joined("symptoms"), F.size("rewrite.sub_questions").cast("bigint").alias("parts"))


def media_route(spark: SparkSession, folder: str) -> DataFrame:
    media = _t(spark, folder, "media_items").withColumn("ord", F.row_number().over(Window.orderBy("title")))
    return understand.media_for(_t(spark, folder, "qa_log").where("question is not null"), "question", "qa_id", media)


def state_fill(spark: SparkSession, folder: str) -> DataFrame:
    lines = extract.numbered_lines(_t(spark, folder, "documents"), "doc_id", "text")
    return extract.carried(lines, "doc_id", F.when(F.col("line").rlike(MARKERS), F.col("line"))).select("doc_id", "pos", "state")


def step_lines(spark: SparkSession, folder: str) -> DataFrame:
    return extract.step_lines(_t(spark, folder, "docs"), "ord", "text", notes=["注意", "Notes", "Hinweis"]).select("ord", "pos", "bucket", "line")


def step_answer(spark: SparkSession, folder: str) -> DataFrame:
    rows = extract.step_lines(_t(spark, folder, "docs"), "ord", "text", notes=["注意", "Notes", "Hinweis"])
    return extract.step_answer(rows, "ord", brief=True).select("ord", "bucket", F.array_join("lines", "\n").alias("lines"))


def bullets(spark: SparkSession, folder: str) -> DataFrame:
    lines = extract.bullets(X.section(F.col("text"), TITLES, STOPS), keep=WORDS, short=60)
    return _t(spark, folder, "documents").select("doc_id", F.array_join(lines, "\n").alias("lines")).where("lines <> ''")


def _keyed(docs: DataFrame) -> DataFrame:
    """Records of both builders under one key, with the number of the chunk from 1 and the base name of its file."""
    d = docs.select("ord", "id", "text", "meta.*", "built_at")
    name = F.element_at(F.split("source_file", "/"), -1)
    made = F.concat(F.coalesce("product_id", F.lit("unknown")), F.lit("/"), F.coalesce(name, F.lit("unknown")), F.lit("::chunk_"), F.coalesce((F.col("chunk_id") - 1).cast("string"), F.lit("?")))
    number = F.coalesce("chunk_id", F.nullif(F.regexp_extract("id", r"::chunk_(\d+)$", 1), F.lit("")).cast("int") + 1).cast("bigint")
    return d.select("ord", "built_at", "product_id", "source_type", F.coalesce("id", made).alias("chunk_key"), number.alias("chunk_id"), name.alias("source_file"), "text")


def _unified(spark: SparkSession, folder: str) -> DataFrame:
    n = F.coalesce(F.length("text"), F.lit(0)).cast("bigint").alias("n")
    return _keyed(_t(spark, folder, "docs")).select("ord", "built_at", "chunk_key", "chunk_id", "source_file", n)


def unified_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return _unified(spark, folder).drop("built_at")


def latest_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return _unified(spark, folder).groupBy("chunk_key").agg(F.max_by("ord", F.struct("built_at", "ord")).alias("ord"), F.count("*").alias("versions"))


def evidence(spark: SparkSession, folder: str) -> DataFrame:
    lines = F.transform(F.slice("matched_sources", 1, answer.EVIDENCE), lambda m: answer.evidence_line(m["source_file"], m["chunk_id"], m["source_type"]))
    return _t(spark, folder, "qa_log").where(F.size("matched_sources") > 0).select("qa_id", F.array_join(lines, "\n").alias("evidence"))


def answer_format(spark: SparkSession, folder: str) -> DataFrame:
    q = _t(spark, folder, "qa_log").withColumn("route", understand.route(F.col("question"), ROUTES, DEFAULT_ROUTE))
    title = F.lit(CASE_ROUTES[DEFAULT_ROUTE])
    for name, text in CASE_ROUTES.items():
        title = F.when(F.col("route") == name, text).otherwise(title)
    ev = F.transform("matched_sources", lambda m: answer.evidence_line(m["source_file"], m["chunk_id"], m["source_type"]))
    body = F.array(F.coalesce(F.col("rewritten_query"), F.lit("")))
    return q.select("qa_id", answer.formatted(title, body, ev, NOTE, F.when(F.col("route") == "risk", "请先咨询医生。")).alias("answer"))


def recent_qa(spark: SparkSession, folder: str) -> DataFrame:
    return files.recent(_t(spark, folder, "qa_log"), "ingested_at", "qa_id", limit=20).select("qa_id", "ts", F.coalesce("question", F.lit("")).alias("question"))


def recent_errors(spark: SparkSession, folder: str) -> DataFrame:
    return files.recent(_t(spark, folder, "error_log").select("ts", "stage", F.coalesce("error", F.lit("")).alias("error")), "ts", "stage", "error", limit=20)


def error_stages(spark: SparkSession, folder: str) -> DataFrame:
    e = _t(spark, folder, "error_log")
    return e.groupBy("stage").agg(F.count("*").alias("n"), F.count_distinct(F.coalesce("error", F.lit(""))).alias("errors"), F.max("ts").alias("last"))


def miss_log(spark: SparkSession, folder: str) -> DataFrame:
    q = _t(spark, folder, "qa_log").where(F.col("hit") == False)  # noqa: E712
    return q.select("ts", F.coalesce("question", F.lit("")).alias("question"), F.coalesce("rewritten_query", F.lit("")).alias("rewritten_query"), F.coalesce(F.col("meta")["product_id"], F.lit("")).alias("product_id"))


def resent_rows(spark: SparkSession, folder: str) -> DataFrame:
    q = _t(spark, folder, "qa_log").groupBy("ts", "question", "answer").agg(F.min("qa_id").alias("qa_id"), F.count("*").alias("copies"))
    return q.where("copies > 1").select("qa_id", "copies")


def late_rows(spark: SparkSession, folder: str) -> DataFrame:
    q = _t(spark, folder, "qa_log").where("ingested_at is not null and ts is not null").select(F.to_date(F.substring("ts", 1, 10)).cast("string").alias("day"), F.col("ingested_at").cast("timestamp_ntz").alias("i"), F.try_to_timestamp("ts").cast("timestamp_ntz").alias("t"))
    late = F.col("i") > F.col("t") + F.expr("interval 1 hour")
    return q.groupBy("day").agg(F.count("*").alias("n"), F.count_if(late).alias("late"))


def shared_aliases(spark: SparkSession, folder: str) -> DataFrame:
    a = _t(spark, folder, "product_aliases").groupBy("alias").agg(F.count_distinct("product_id").alias("products"), F.min("product_id").alias("first"))
    return a.where("products > 1")


def catalog(spark: SparkSession, folder: str) -> DataFrame:
    d = _t(spark, folder, "documents").groupBy(F.coalesce("source", F.lit("")).alias("source")).agg(F.array_join(F.array_sort(F.collect_set("lang")), ",").alias("langs"), F.count("*").alias("n"))
    return d


def regression_pass(spark: SparkSession, folder: str) -> DataFrame:
    c = _t(spark, folder, "regression_cases")
    done = answer.regression(c, c.select("case_id", F.col("reference").alias("answer")), "case_id")
    return done.groupBy("lang").agg(F.count("*").alias("n"), F.count_if("passed").alias("passed"))


def regression_answers(spark: SparkSession, folder: str) -> DataFrame:
    """Each case against every logged answer of the same normal question text."""
    q = _t(spark, folder, "qa_log").where("question is not null and answer is not null").select(X.collapse_space(F.lower("question")).alias("k"), "answer")
    c = _t(spark, folder, "regression_cases").select("case_id", X.collapse_space(F.lower("q")).alias("k"), "expect_any")
    held = F.exists("expect_any", lambda w: F.contains(F.col("answer"), w))
    return c.join(q, "k", "left").groupBy("case_id").agg(F.count("answer").alias("answers"), F.count_if(held).alias("passed"))


BUDGETS = {"aftercare": {"brief": 20, "full": 28}, "dose": {"brief": 16, "full": 24}, "risk": {"brief": 12, "full": 18}}
STEP_NOTES = {"storage": ["注意", "Notes", "Hinweis"]}


def asked(spark: SparkSession, folder: str, questions: DataFrame, key: str, question: str, mode: str = "brief", *, search_in: bool = True, evidence=None) -> DataFrame:
    """(key, answer) of questions through the whole plan, on the newest main and faq chunks of their products."""
    if mode not in ("brief", "full"):
        mode = "brief"
    d = _t(spark, folder, "docs").where("meta.source_type in ('main', 'faq') and meta.product_id is not null and trim(text) <> ''")
    newest = F.struct("built_at", "ord")
    texts = _keyed(d).groupBy("product_id", "source_type", "chunk_key").agg(*[F.max_by(c, newest).alias(c) for c in ("text", "chunk_id", "ord", "source_file")])
    texts = shared.written(texts, "chunks")
    aliases = _t(spark, folder, "product_aliases").where("alias is not null")
    order = aliases.groupBy("product_id", "alias").agg(F.min("alias_ord").alias("alias_ord"))

    def expand(parts: DataFrame) -> DataFrame:
        r = understand.rewrite(parts, "_part", aliases.select("product_id", "alias", "alias_ord"), _projects(spark), times=TIMES, symptoms=WORDS, separators=SEPARATORS, out="_r")
        return r.withColumns({"_query": F.col("_r.expanded"), "_products": F.col("_r.products")}).drop("_r")

    sections = {name: (["：", ":", "，", ","], ["\n"]) for name, _ in ROUTES} | {DEFAULT_ROUTE: (["。", "."], ["\n\n"]), "storage": (["STEP"], [])}
    return answer.answers(
        questions, texts, order, key=key, question=question, separators=SEPARATORS, routes=ROUTES, sections=sections, titles=CASE_ROUTES, note=NOTE, default_route=DEFAULT_ROUTE, keep=WORDS,
        most_lines={r: BUDGETS.get(r, {"brief": 12, "full": 20})[mode] for r in CASE_ROUTES}, steps=STEP_NOTES, mode=mode, risk=("risk", "请先咨询医生。"),
        expand=expand, search_in=texts.withColumn("id", F.col("ord")) if search_in else None, evidence=evidence,
    )


def batch_answers(spark: SparkSession, folder: str) -> DataFrame:
    """Every question of the log through the whole answer plan; evidence is what a hybrid search finds among the product's chunks."""
    return asked(spark, folder, _t(spark, folder, "qa_log"), "qa_id", "question")


def logged_answers(spark: SparkSession, folder: str) -> DataFrame:
    """As ``batch_answers`` in full, with the evidence that the log says was hit."""
    hits = F.transform("matched_sources", lambda m: answer.evidence_line(m["source_file"], m["chunk_id"], m["source_type"]))
    return asked(spark, folder, _t(spark, folder, "qa_log"), "qa_id", "question", "full", search_in=False, evidence=hits)


def regression_own(spark: SparkSession, folder: str) -> DataFrame:
    """The regression cases against this engine's own answers to their questions."""
    c = _t(spark, folder, "regression_cases")
    done = answer.regression(c, asked(spark, folder, c, "case_id", "q"), "case_id")
    return done.groupBy("lang").agg(F.count("*").alias("n"), F.count_if("passed").alias("passed"))


def embed_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Every chunk text by the hashing embedder, normalised; digests of the vector instead of its floats."""
    rows = search.embed(_t(spark, folder, "docs").select("ord", "text"), "text").withColumn("u", V.normalize(F.col("embedding")))
    weighted = F.aggregate(F.transform("u", lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x)
    return rows.select("ord", F.round(V.norm(F.col("u")), 6).alias("unit"), F.round(weighted, 6).alias("digest"), F.round(F.array_max("u"), 6).alias("largest"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        l2_normalize, vector_topk, keyword_score, keyword_topk, hybrid_topk, chunk_fixed, chunk_counts, chunk_packed, normalize_lines, unique_lines, section_block, detect_terms, resolved_products, strong_score, ambiguous_questions, detect_route, route_counts,
        split_questions, rewrite_expand, media_route, state_fill, step_lines, step_answer, bullets, unified_chunks, latest_chunks, evidence, answer_format, recent_qa, recent_errors, error_stages, miss_log,
        resent_rows, late_rows, shared_aliases, catalog, regression_pass, regression_answers, rewrite_struct, batch_answers, logged_answers, regression_own, embed_texts,
    )
}
