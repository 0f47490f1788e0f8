"""Readers, writers and streams on files in a temporary folder."""

import json

import pytest
from pyspark.sql import functions as F

from fathom.sources import files, sinks
from fathom.streaming import logs


@pytest.fixture
def root(tmp_path):
    kb = tmp_path / "kb"
    for product, name, raw in (("p", "main", "﻿一段\n\n二段".encode()), ("p", "faq", "问答".encode("gbk")), ("p", "alias", b""), ("q", "main", b"other"), ("q", "note", b"skip")):
        (kb / product).mkdir(parents=True, exist_ok=True)
        (kb / product / f"{name}.txt").write_bytes(raw)
    return kb


def test_knowledge(spark, root):
    got = {(r["product_id"], r["source_type"]): r["text"] for r in files.knowledge(spark, str(root)).collect()}
    assert got == {("p", "main"): "一段\n\n二段", ("p", "faq"): "问答", ("p", "alias"): "", ("q", "main"): "other"}
    assert [(r["product_id"], r["files"]) for r in files.catalog(spark, str(root)).collect()] == [("p", ["alias.txt", "faq.txt", "main.txt"]), ("q", ["main.txt", "note.txt"])]


def test_point_reads_and_probes(spark, root, tmp_path):
    wanted = spark.createDataFrame([("p", "main.txt"), ("p", "alias.txt"), ("x", "main.txt")], "product_id string, source_file string")
    got = {(r["product_id"], r["source_file"]): r["text"] for r in files.knowledge_text(spark, str(root), wanted).collect()}
    assert got == {("p", "main.txt"): "一段\n\n二段", ("p", "alias.txt"): "", ("x", "main.txt"): ""}
    assert [r[0] for r in files.products(spark, str(root)).collect()] == ["p", "q"]
    assert files.health(spark, root=str(root), store=str(tmp_path / "none")).first().asDict() == {"status": "ok", "root_exists": True, "store_exists": False}
    assert files.array_json(spark, str(tmp_path / "none.json"), files.MEDIA).columns[-1] == "ord"
    assert files.array_json(spark, str(tmp_path / "none.json"), files.MEDIA).isEmpty() and files.log(spark, str(tmp_path / "none"), files.QA_LOG).isEmpty()


def test_exports(spark, tmp_path):
    rows = spark.createDataFrame([("p/main.txt::chunk_0", "文本", ("p", "main.txt", "main", 1))], files.CHUNKS)
    sinks.export_json(rows, str(tmp_path / "out"))
    sinks.export_json(rows, str(tmp_path / "out"))
    assert "文本" in "".join(f.read_text() for f in (tmp_path / "out").glob("*.json")) and files.documents_json(spark, str(tmp_path / "out")).count() == 1
    said = spark.createDataFrame([(" a\u3000\n",), (None,)], "a string").select(sinks.answer_text(F.col("a")))
    assert [r[0] for r in said.collect()] == ["a\n", "\n"]


def knowledge_base(tmp_path):
    kb = tmp_path / "kb"
    for product, name, text in (("p", "main", "用量说明：多少\n每次两滴，颈部适用\n\n其他"), ("p", "alias", "甲号\nalpha"), ("q", "main", "无"), ("q", "faq", "批次号在盒底，颈部附近。")):
        (kb / product).mkdir(parents=True, exist_ok=True)
        (kb / product / f"{name}.txt").write_text(text)
    return str(kb)


def test_ask_and_commands(spark, tmp_path, capsys):
    from fathom import __main__ as cli

    kb = knowledge_base(tmp_path)
    (tmp_path / "cases.json").write_text(json.dumps([{"q": "甲号用多少", "expect_any": ["两滴"]}, {"q": "q 的批次", "expect_any": ["盒底"]}]))
    (tmp_path / "media.json").write_text(json.dumps([{"title": "图", "type": "image", "url": "", "keywords": ["甲"]}]))
    (tmp_path / "miss.jsonl").write_text('{"ts":"2024-01-02T00:00:00","question":"late"}\n{"ts":"2024-01-01T00:00:00","question":"early"}\n')

    def said(*args):
        code = cli.run(spark, cli.parser().parse_args(args))
        return code, capsys.readouterr().out

    code, out = said("ask", kb, "甲号用多少", "--mode", "odd", "--media", str(tmp_path / "media.json"))
    assert code == 0 and "- 每次两滴，颈部适用" in out and "来源文件：main.txt｜段落：1｜类型：main" in out and "image: 图" in out
    assert said("regression", kb, str(tmp_path / "cases.json")) == (0, "passed 2 of 2\n")
    assert "late" in said("misses", str(tmp_path / "miss.jsonl"), "--limit", "1")[1] and "early" not in said("misses", str(tmp_path / "miss.jsonl"), "--limit", "1")[1]
    assert "true" in said("health", kb, str(tmp_path))[1] and "main.txt" in said("list", kb)[1]


def test_a_batch_tried_again_is_written_once(spark, tmp_path):
    rows = spark.createDataFrame([("2024-01-01T00:10:00", "q1", "r", "a", True), ("2024-01-01T00:20:00", "q2", "r", "a", False)], "ts string, question string, rewritten_query string, answer string, hit boolean").withColumn("meta", F.create_map(F.lit("k"), F.lit("v")))
    for _ in range(2):
        sinks.log_qa(rows, str(tmp_path / "qa" / "batch=3"), str(tmp_path / "miss" / "batch=3"), mode="overwrite")
    assert files.log(spark, str(tmp_path / "qa"), files.QA_LOG).count() == 2 and files.log(spark, str(tmp_path / "miss"), files.MISS_LOG).count() == 1


def test_rebuild_leaves_other_products(spark, root, tmp_path):
    store = str(tmp_path / "store")
    sinks.rebuild(spark, str(root), store, "p")
    sinks.rebuild(spark, str(root), store, "q")
    done = sinks.rebuild(spark, str(root), store, "p", packed=True)
    assert {r["source_file"] for r in done.collect()} == {"main.txt", "faq.txt"}
    assert {r["product_id"] for r in sinks.read_store(spark, store).collect()} == {"p", "q"}
    with pytest.raises(ValueError):
        sinks.rebuild(spark, str(root), store, "../p")


def test_json(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps([{"title": "t", "type": "image", "url": "", "keywords": ["a"]}]))
    assert files.array_json(spark, str(tmp_path / "m.json"), files.MEDIA).count() == 1
    log = tmp_path / "log.jsonl"
    log.write_text('{"ts":"2024-01-01T00:00:00","stage":"s"}\n\nbad{\n{"ts":"2024-01-02T00:00:00","stage":"t"}\n')
    rows = files.log(spark, str(log), files.ERROR_LOG)
    assert [r["stage"] for r in files.recent(rows, "ts", limit=0).collect()] == ["t"]
    assert rows.count() == 2
    docs = tmp_path / "d.jsonl"
    docs.write_text('{"id":"a","text":"t"}\n')
    assert files.documents_json(spark, str(docs)).collect()[0]["text"] == "t"
    docs.write_text("bad{\n")
    with pytest.raises(Exception):
        files.documents_json(spark, str(docs)).collect()


def test_qa_log_and_stream(spark, tmp_path):
    rows = spark.createDataFrame([("2024-01-01T00:10:00", "q1", None, "a", True), ("2024-01-01T00:20:00", "q2", None, None, False), ("2024-01-01T01:20:00", "q3", "r", "a", None)], "ts string, question string, rewritten_query string, answer string, hit boolean")
    rows = rows.withColumn("latency_ms", F.lit(None).cast("int")).withColumn("matched_sources", F.lit(None).cast("array<map<string,string>>")).withColumn("meta", F.create_map(F.lit("product_id"), F.lit("p")))
    qa, miss = str(tmp_path / "qa"), str(tmp_path / "miss")
    sinks.log_qa(rows, qa, miss)
    assert files.log(spark, qa, files.QA_LOG).count() == 3
    assert {r["question"] for r in files.log(spark, miss, files.MISS_LOG).collect()} == {"q2", "q3"}
    stream = logs.read_log(spark, qa)
    counts = logs.misses_by_hour(stream).writeStream.format("memory").queryName("by_hour").outputMode("complete").trigger(availableNow=True).start()
    counts.awaitTermination(120)
    assert sorted((r["n"], r["misses"]) for r in spark.table("by_hour").collect()) == [(1, 1), (2, 1)]
    copy = logs.split_sinks(logs.once(stream, ["ts", "question"]), str(tmp_path / "qa2"), str(tmp_path / "miss2"), str(tmp_path / "cp"))
    copy.awaitTermination(120)
    assert files.log(spark, str(tmp_path / "miss2"), files.MISS_LOG).count() == 2
    sinks.log_error(spark.createDataFrame([("s", "e")], "stage string, error string"), str(tmp_path / "err"))
    assert files.log(spark, str(tmp_path / "err"), files.ERROR_LOG).collect()[0]["ts"]
