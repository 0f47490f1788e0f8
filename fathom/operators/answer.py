"""Answers to batches of questions: formatting, evidence, fallback, optional rewriting."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathom.functions import text as X
from fathom.sources import shared

from . import extract, search, understand

EVIDENCE = 6


def evidence_line(source_file: Column, chunk: Column, kind: Column) -> Column:
    """One line of evidence; missing parts are ``unknown`` or ``?``."""
    some = lambda c, d: F.coalesce(X.empty_as_null(c.cast("string")), F.lit(d))
    return F.concat(F.lit("- 来源文件："), some(source_file, "unknown"), F.lit("｜段落："), some(chunk, "?"), F.lit("｜类型："), some(kind, "unknown"))


# The words of the answer's layout below.
def formatted(title: Column, body: Column, evidence: Column, note: str, risk_note: Column | None = None) -> Column:
    """Title, conclusion with a dash per body line, evidence if any (at most six), notes, and a risk note where given."""
    dash = lambda a: F.transform(F.coalesce(a, F.array().cast("array<string>")), lambda x: F.concat(F.lit("- "), x))
    first = F.slice(F.coalesce(evidence, F.array().cast("array<string>")), 1, EVIDENCE)
    parts = [F.array(F.concat(title, F.lit("（资料提取）：")), F.lit("结论：")), dash(body)]
    parts += [F.when(F.size(first) > 0, F.concat(F.array(F.lit("依据：")), first)).otherwise(F.array().cast("array<string>")), F.array(F.lit("注意事项："), F.lit(f"- {note}"))]
    if risk_note is not None:
        parts.append(F.when(risk_note.isNotNull(), F.array(F.lit("需医生评估项："), F.concat(F.lit("- "), risk_note))).otherwise(F.array().cast("array<string>")))
    return F.array_join(F.concat(*parts), "\n")


def section_pieces(texts: DataFrame, sections: dict[str, tuple[list[str], list[str]]]) -> DataFrame:
    """(product_id, _route, _n, _text): the pieces of each route's section in the files of each product, by number of chunk.

    A row of ``texts`` (product_id, text and, where a file has several rows, chunk_id and source_type) is one
    chunk; the chunks of a product and type in their order, each ending a line, are its file.  A section
    begins at the first title of the file ``main`` and goes on through later chunks to the first stop; where
    ``main`` has no title, it is that of the other file, up to its end.  Only the place of a section is
    aggregated (a row per product and route, joined to the chunks), so no file is put together anywhere.
    """
    number = F.coalesce(F.col("chunk_id").cast("bigint"), F.lit(2**62)) if "chunk_id" in texts.columns else F.lit(0)
    other = F.col("source_type") != "main" if "source_type" in texts.columns else F.lit(False)
    body = F.concat(X.utrim(X.normalize_newlines(F.col("text"))), F.lit("\n"))
    chunks = texts.where("product_id is not null and text is not null").select("product_id", other.alias("_other"), number.alias("_n"), body.alias("_text"))
    each = lambda f: F.filter(F.array(*[F.struct(F.lit(name).alias("_route"), f(*rule).alias("_v")) for name, rule in sections.items()]), lambda x: x["_v"].isNotNull())
    ended = each(lambda titles, stops: X.closed(F.col("_text"), titles, stops))
    starts = chunks.select("product_id", "_other", "_n", F.explode(ended).alias("_e")).groupBy("product_id", "_e._route")
    starts = starts.agg(F.min(F.struct("_other", "_n", (F.col("_e._v") & ~F.col("_other")).alias("_closed"))).alias("_s"))
    within = chunks.join(starts.select("product_id", "_route", "_s"), "product_id").where("_other = _s._other and (_n = _s._n or _n > _s._n and not _s._closed)")
    none = F.struct(F.lit("").alias("text"), F.lit(False).alias("closed"))
    piece = none
    for name, (titles, stops) in sections.items():
        first = lambda ends: F.struct(X.section(F.col("_text"), titles, ends).alias("text"), F.lit(False).alias("closed"))  # noqa: B023, E731
        later = F.when(F.col("_other"), F.struct(F.col("_text").alias("text"), F.lit(False).alias("closed"))).otherwise(X.until(F.col("_text"), stops))
        own = F.when(F.col("_n") > F.col("_s._n"), later).when(F.col("_other"), first([])).otherwise(first(stops))
        piece = F.when(F.col("_route") == name, own).otherwise(piece)
    pieces = within.select("product_id", "_route", "_n", piece.alias("_p"))
    ends = pieces.where("_p.closed").groupBy("product_id", "_route").agg(F.min("_n").alias("_end"))
    inside = pieces.join(ends, ["product_id", "_route"], "left").where("_end is null or _n <= _end")
    return inside.select("product_id", "_route", "_n", F.col("_p.text").alias("_text"))


def _by_route(values: dict[str, object], other) -> Column:
    out = F.lit(other)
    for name, value in values.items():
        out = F.when(F.col("_route") == name, F.lit(value)).otherwise(out)
    return out


def section_lines(pieces: DataFrame, *, keep: list[str], short: dict[str, int] | int = 60, most: dict[str, int] | int = 12, drop: dict[str, list[str]] = {}, only: dict[str, list[str]] = {}, append: dict[str, str] = {}) -> DataFrame:  # noqa: B006
    """(product_id, _route, _lines): the bullets of each section, up to the route's budget.

    Of a route, lines with a word of ``drop`` are left out and those without one of ``only``; the line ``append`` follows the others if it
    isn't among them.  ``short`` is the length up to which any line counts.  Only the first lines of a section are gathered.
    """
    budget = _by_route(most, 12) if isinstance(most, dict) else F.lit(most)
    length = _by_route(short, 0) if isinstance(short, dict) else F.lit(short)
    bullets = extract.bullets(F.col("_text"), keep=keep, short=length, most=2**31 - 1)
    lines = pieces.where("_text <> ''").select("product_id", "_route", "_n", F.posexplode_outer(bullets).alias("_i", "_line"))  # a section without lines keeps a row
    unwanted = F.lit(False)
    for route, words in drop.items():
        unwanted = unwanted | ((F.col("_route") == route) & X.contains_any(F.col("_line"), words))
    for route, words in only.items():
        unwanted = unwanted | ((F.col("_route") == route) & ~X.contains_any(F.col("_line"), words))
    lines = lines.withColumn("_line", F.when(~unwanted, F.col("_line"))) if drop or only else lines
    lines = lines.groupBy("product_id", "_route", "_line").agg(F.min(F.struct("_n", "_i")).alias("_at"))
    rank = F.row_number().over(Window.partitionBy("product_id", "_route").orderBy(F.col("_line").isNull(), "_at", "_line"))
    best = lines.withColumn("_rank", rank).where(F.col("_rank") <= budget)
    none = F.array().cast("array<string>")
    own = F.transform(F.array_sort(F.collect_list(F.when(F.col("_line").isNotNull(), F.struct("_rank", "_line")))), lambda x: x["_line"])
    last = _by_route(append, None).cast("string") if append else F.lit(None).cast("string")
    every = F.array_distinct(F.concat(F.col("_own"), F.when(last.isNotNull(), F.array(last)).otherwise(none)))
    return best.groupBy("product_id", "_route").agg(own.alias("_own")).select("product_id", "_route", F.slice(every, F.lit(1), budget).alias("_lines"))


def step_body(pieces: DataFrame, notes: list[str], *, brief: bool, head: str = "【步骤】", note_head: str = "【注意事项】", steps: int = 5) -> DataFrame:
    """(product_id, _route, _lines): of sections with steps, a head, ``STEP n：`` with its lines for each step, and the notes under their own head; none where there are no steps."""
    numbered = pieces.select("product_id", "_route", "_n", F.posexplode(X.lines(F.col("_text"))).alias("_i", "line"))
    key = F.struct("product_id", "_route").alias("_key")
    rows = extract.step_buckets(numbered.select(key, F.struct("_n", "_i").alias("pos"), "line"), "_key", notes=notes, steps=steps)
    lists = extract.step_answer(rows, "_key", brief=brief, steps=steps)
    none = F.array().cast("array<string>")
    titled = F.concat(F.when(F.col("bucket") > 0, F.array(F.concat(F.lit("STEP "), F.col("bucket").cast("string"), F.lit("：")))).otherwise(F.array(F.lit(note_head))), F.coalesce("lines", none))
    order = F.when(F.col("bucket") > 0, F.col("bucket")).otherwise(steps + 1)
    parts = lists.where(F.size("lines") > 0).groupBy("_key").agg(F.array_sort(F.collect_list(F.struct(order.alias("o"), titled.alias("t")))).alias("p"), F.max("bucket").alias("m"))
    return parts.where("m > 0").select("_key.product_id", "_key._route", F.concat(F.array(F.lit(head)), F.flatten(F.transform("p", lambda x: x["t"]))).alias("_lines"))


def hybrid_evidence(asked: DataFrame, chunks: DataFrame, *, model=lambda: search.hashed_embedding) -> DataFrame:
    """(product_id, _query, _evidence): evidence lines of the best hits of each query (product_id, _query) among its product's chunks (product_id, id, text, source_file, chunk_id, source_type).

    Equal queries of a product are searched once; the vector and the keyword hits are merged by equal text.
    """
    queries = asked.where("product_id is not null and _query <> ''").select("product_id", "_query").distinct().withColumn("qid", F.xxhash64("product_id", "_query"))
    corpus = chunks.where("product_id is not null and text is not null")
    embedded = lambda rows, c: search.embed(rows, c, "_v", model=model)
    vector = search.vector_topk(embedded(queries, "_query"), embedded(corpus, "text"), qid="qid", qvec="_v", key="id", vec="_v", by="product_id")
    keyword = search.keyword_topk(queries, corpus, qid="qid", query="_query", key="id", text="text", by="product_id")
    texts = corpus.select("id", F.md5("text").alias("text"))  # equal texts have equal digests
    with_text = lambda hits: hits.join(texts, "id").select("qid", "text", "id", "score", "rank")
    merged = search.merge_hybrid(with_text(vector), with_text(keyword)).where(F.col("rank") <= EVIDENCE)
    shown = merged.join(corpus.select("id", "source_file", "chunk_id", "source_type"), "id")
    line = F.struct("rank", evidence_line(F.col("source_file"), F.col("chunk_id"), F.col("source_type")).alias("l"))
    lists = shown.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["l"]).alias("_evidence"))  # at most six
    return queries.join(lists, "qid").select("product_id", "_query", "_evidence")


def answers(
    questions: DataFrame,
    texts: DataFrame,
    vocabulary: DataFrame,
    *,
    key: str,
    question: str,
    separators: list[str],
    routes: list[tuple[str, list[str]]],
    sections: dict[str, tuple[list[str], list[str]]],
    titles: dict[str, str],
    note: str,
    default_route: str,
    keep: list[str],
    most_parts: int = 4,
    most_lines: dict[str, int] | int = 12,
    short: dict[str, int] | int = 60,
    drop: dict[str, list[str]] = {},  # noqa: B006
    only: dict[str, list[str]] = {},  # noqa: B006
    append: dict[str, str] = {},  # noqa: B006
    steps: dict[str, list[str]] = {},  # noqa: B006
    mode: str = "brief",
    risk: tuple[str, str] | None = None,
    default_product: str | None = None,
    expand: Callable[[DataFrame], DataFrame] | None = None,
    search_in: DataFrame | None = None,
    model=lambda: search.hashed_embedding,
    rewrite: Callable[[Column], Column] | None = None,
    evidence: Column | None = None,
    fallback: list[str] = ["暂无对应资料。"],  # noqa: B006
) -> DataFrame:
    """(key, answer): one plan for a batch of questions.

    Questions are split (up to ``most_parts``), each part gets its first product of
    ``vocabulary`` (product_id, alias, alias_ord) and its route, the section of that route is
    taken from the product's ``texts`` (see ``section_pieces``; once per product and route), as bullets or, for the routes of
    ``steps`` (route → markers of notes), as steps, and
    equal answers of a question are given once, in order.  Parts without a product take
    ``default_product``; those without a section get the ``fallback`` lines, which ``rewrite`` does not see.  ``risk`` is a route and the
    note that its answers end with.  Blank questions get an empty answer.

    Evidence is what a hybrid search in the product's chunks finds for the part (``search_in``; ``expand`` adds the column _query to the
    parts, else it is the part; it may add _products, the products in their order), or what ``questions`` holds already (``evidence``), the same for all parts.
    """
    none = F.array().cast("array<string>")
    asked = questions.select(key, F.col(question).alias("_q"), (none if evidence is None else evidence).alias("_logged"))
    parts = asked.select(key, "_logged", F.posexplode(F.slice(X.split_questions(F.col("_q"), separators), 1, most_parts)).alias("_n", "_part"))
    found = expand(parts) if expand else parts.withColumn("_query", F.col("_part"))
    if "_products" not in found.columns:
        found = understand.detect(found, "_part", vocabulary, key="product_id", term="alias", order=F.col("alias_ord"), out="_products")
    routed = found.select(key, "_n", "_logged", "_query", F.coalesce(F.try_element_at("_products", F.lit(1)), F.lit(default_product)).alias("product_id"), understand.route(F.col("_part"), routes, default_route).alias("_route"))
    routed = shared.written(routed, "parts")  # detected once, read by every branch below
    lines = questions.sparkSession.createDataFrame([], "product_id string, _route string, _lines array<string>")
    if plain := {r: rule for r, rule in sections.items() if r not in steps}:
        lines = section_lines(section_pieces(texts, plain), keep=keep, short=short, most=most_lines, drop=drop, only=only, append=append)
    for name, notes in steps.items():
        lines = lines.unionByName(step_body(section_pieces(texts, {name: sections[name]}), notes, brief=mode == "brief"))
    known = routed.where("product_id is not null").join(lines, ["product_id", "_route"], "left")  # a row per product and route; parts without a product stay out
    joined = known.unionByName(routed.where("product_id is null").withColumn("_lines", F.lit(None).cast("array<string>")))
    if search_in is not None:
        hits = hybrid_evidence(routed, search_in, model=model)
        joined = joined.join(hits, ["product_id", "_query"], "left")
    shown = F.coalesce("_evidence", "_logged") if search_in is not None else F.col("_logged")
    title = F.lit(titles.get(default_route, "回答"))
    for name, text in titles.items():
        title = F.when(F.col("_route") == name, text).otherwise(title)
    note_of = F.when(F.col("_route") == risk[0], risk[1]) if risk else None
    body = formatted(title, F.col("_lines"), shown, note, note_of)
    said = F.when(F.size("_lines") > 0, rewrite(body) if rewrite else body).otherwise(formatted(title, F.array(*map(F.lit, fallback)), shown, note, note_of))
    each = F.array_sort(F.collect_list(F.struct("_n", "_a")))  # at most ``most_parts``
    whole = joined.select(key, "_n", said.alias("_a")).groupBy(key).agg(F.array_join(F.array_distinct(F.transform(each, lambda x: x["_a"])), "\n\n").alias("_all"))
    return asked.join(whole, key, "left").select(key, F.coalesce("_all", F.lit("")).alias("answer"))


def respond(questions: DataFrame, said: DataFrame, media: DataFrame, *, key: str, question: str) -> DataFrame:
    """(key, ok, answer, media): answers with their media items (title, media_type, url) in order.

    ``ok`` tells whether there is an answer; a question without one gets an empty text, one
    without media an empty array.
    """
    hits = understand.media_for(questions, question, key, media)
    item = F.struct("media_order", "title", "media_type", "url")
    lists = hits.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(item)), lambda m: F.struct(m["title"].alias("title"), m["media_type"].alias("media_type"), m["url"].alias("url"))).alias("media"))
    text = F.coalesce(F.col("answer"), F.lit(""))
    rows = questions.select(key).join(said.select(key, "answer"), key, "left").join(lists, key, "left")
    none = F.array().cast("array<struct<title:string,media_type:string,url:string>>")
    return rows.select(key, (text != "").alias("ok"), text.alias("answer"), F.coalesce("media", none).alias("media"))


def regression(cases: DataFrame, answers: DataFrame, key: str) -> DataFrame:
    """``cases`` with passed: the answer holds one of expect_any; no answer or no expectation does not pass."""
    held = F.exists("expect_any", lambda w: F.contains(F.coalesce("answer", F.lit("")), w))
    return cases.join(answers.select(key, "answer"), key, "left").withColumn("passed", F.coalesce(held, F.lit(False)))
