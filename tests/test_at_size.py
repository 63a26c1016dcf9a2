"""Steps that grew with the table: places in a run, gaps of a text, rows a task, first occurrences, outputs of files."""

import json
import re

from pyspark.sql import functions as F

from maskloom.functions import columns as C
from maskloom.functions.patterns import REGEX_REGISTRY
from maskloom.operators import detect, restore, strategies
from maskloom.plans import catalog, inputs
from maskloom.sources import files


def test_place_of_a_match_that_stands_twice_in_its_run(spark):
    # the first place of its text is not its place: digits stand before it there
    data = ["913800138000-13800138000", "13800138000", "11:11:11:1", "1.2.3.45.1.2.3.4", "a@b.c1a@b.c", "x13800138000", "\U0001d7ce/12:30", "12:30/12:30"]
    docs = spark.createDataFrame([*enumerate(data)], "doc_id long, text string")
    got = {}
    for r in detect.detect_regex_entities(docs, "text", ["doc_id"]).orderBy("doc_id", "seq").collect():
        got.setdefault(r.doc_id, []).append((r.type, r.start, r.end, r.span))
    want = {k: [(t, m.start(), m.end(), m.group()) for t, p in REGEX_REGISTRY.items() for m in re.finditer(p, x)] for k, x in enumerate(data)}
    assert got == {k: v for k, v in want.items() if v}
    # before, every match was sought with a second pattern
    plan = detect.with_offset_entities(docs, "text", ["doc_id"])._jdf.queryExecution().optimizedPlan().toString()
    assert "position(" in plan or "locate(" in plan


def test_masks_at_the_ends_and_beside_each_other(spark):
    reverse = spark.createDataFrame([("某人 1", "Ann", 1), ("某人 10", "Bob", 1), ("某人 2", "?", 2)], "mask_text string, original string, n_originals long")
    data = ["某人 1", "某人 1某人 10", "a某人 10b某人 2 c", "某人 x", "", None, "某人 1\n某人 1 "]
    docs = spark.createDataFrame([*enumerate(data)], "doc_id long, t string")
    out = {r.doc_id: r.restored for r in strategies.unmask_hybrid(docs, "t", ["doc_id"], reverse).collect()}
    assert [out[i] for i in range(len(data))] == ["Ann", "AnnBob", "aBobb某人 2 c", "某人 x", "", None, "Ann\nAnn "]
    known = spark.createDataFrame([("<1>", "x")], "mask string, original string")
    cut = restore.replace_matches(docs, {"t": "o"}, "<[0-9]>", known, ["doc_id"])
    plan = cut._jdf.queryExecution().optimizedPlan().toString()
    assert r"[\s\S]*?" not in plan and cut.count() == len(data)


def test_rows_of_a_task_are_bounded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(inputs, "RECORDS_A_TASK", 100)
    monkeypatch.setattr(inputs, "TEXTS_A_TASK", 100)
    slots = spark.sparkContext.defaultParallelism
    n = 100 * (inputs.RECORD_TASKS * slots + 5)
    spark.range(n).coalesce(1).selectExpr("id as o_orderkey", "id as o_custkey", "1.5D as o_totalprice", "timestamp'2024-01-02 03:04:05' as o_orderdate").write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(n).coalesce(1).selectExpr("id as doc_id", "concat('t', id) as text").write.parquet(f"{tmp_path}/documents.parquet")
    for df in (inputs.pii_texts(spark, str(tmp_path)), inputs.documents(spark, str(tmp_path))):
        assert df.rdd.getNumPartitions() == n // 100 and df.count() == n


def test_consistency_scans_bounded_tasks(spark, tmp_path, monkeypatch):
    for bound in ("RECORDS_A_TASK", "TEXTS_A_TASK"):
        monkeypatch.setattr(inputs, bound, 100, raising=False)
    n = 200 * max(8, spark.sparkContext.defaultParallelism)
    ids = spark.range(n).coalesce(1)  # one row group each
    ids.selectExpr("id as o_orderkey", "id % 7 as o_custkey", "1.5D as o_totalprice", "timestamp'2024-01-02 03:04:05' as o_orderdate").write.parquet(f"{tmp_path}/orders.parquet")
    ids.selectExpr("id as doc_id", "concat('mail a', id % 5, '@b.cd or 13800138000') as text").write.parquet(f"{tmp_path}/documents.parquet")
    occ = catalog.q_strategy_token(spark, str(tmp_path))
    held = occ.groupBy("src", F.spark_partition_id()).agg(F.count_distinct("doc_id").alias("texts")).collect()
    assert max(r.texts for r in held) <= 100 and sum(r.texts for r in held) == 2 * n
    tokens = {}
    for r in occ.collect():
        tokens.setdefault((r.type, r.span), set()).add(r.token)
    got = catalog.QUERIES["token_consistency"](spark, str(tmp_path)).collect()
    assert sorted((r.entity_type, r.original, r.n_tokens) for r in got) == sorted((*k, len(v)) for k, v in tokens.items())


def test_first_occurrences_of_a_frequent_text(spark):
    occ = spark.range(3000).select(
        (F.lit(2999) - F.col("id")).alias("doc_id"), F.lit(0).alias("seq"),
        F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("w"), (F.col("id") % 60).cast("string"))).alias("span"),
        F.when(F.col("id") == 2999, "ORG").otherwise("PER").alias("type"),
    )
    got = {r.original: r for r in strategies.hybrid_mapping(occ, ["doc_id"]).collect()}
    assert len(got) == 21 and got["hot"].entity_type == "ORG" and got["hot"].ordinal == 1 and got["hot"].first_pos.doc_id == 0
    rows = sorted((r.first_pos.doc_id, r.ordinal) for r in got.values() if r.entity_type == "PER")
    assert [n for _, n in rows] == list(range(1, 21))


def test_outputs_come_from_items_gathered_once(spark, tmp_path):
    lists = [("/a/x.json", '[{"type":"title","title":"T","n":1},{"type":"text","text":"b\\nc"},{"type":"text","text":null}]'), ("/b/x.json", "[]"), ("/c/x.json", '[{"type":7}]')]
    items = files.scan_content_list(spark.createDataFrame(lists, "path string, content string"))
    gathered = files.gather_items(items)
    cols = ["path", "item_idx", "type", "text", "title", "keys"]
    assert sorted(map(str, files.gathered_rows(gathered).select(cols).collect())) == sorted(map(str, items.select(cols).collect()))
    files.write_outputs(gathered, str(tmp_path), "masked")
    got = {k: {r.path: r.content for r in files.read_outputs(spark, str(tmp_path), k).collect()} for k in ("lists", "markdown")}
    assert {p: json.loads(c) for p, c in got["lists"].items()} == {p: json.loads(c) for p, c in lists if c != "[]"}
    assert got["markdown"] == {"/a/x.json": "# T\n\nb\nc\n\n\n\n", "/c/x.json": "\n\n"}


def test_documents_without_a_saved_list_keep_their_items(spark):
    a = spark.createDataFrame([("p", 0, "x"), ("q", 0, "y"), ("q", 1, "z"), (None, 0, "n")], "path string, item_idx int, text string")
    saved = spark.createDataFrame([("p", 0, "X"), (None, 0, "N")], "path string, item_idx int, text string")
    got = sorted((str(r.path), r.text, r.source) for r in files.choose_unmask_source(a, saved, ["path"]).collect())
    assert got == [("None", "N", "masked_list"), ("None", "n", "original"), ("p", "X", "masked_list"), ("q", "y", "original"), ("q", "z", "original")]
