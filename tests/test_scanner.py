"""One scan for all built-in patterns: the same matches and places as each pattern alone."""

import random
import re

import pytest
from pyspark.sql import functions as F

from maskloom.functions import columns as C
from maskloom.functions.patterns import REGEX_REGISTRY
from maskloom.operators import detect, mask

PARTS = [
    "13800138001", "0755-12345678", "01012345678", "11111111111111111X", "6222020200112233", "6222020200112233445", "a.b@mail.com", "x@y-z.org.", "10.0.0.1", "1.2.3.4.5",
    "2024-01-02", "2024年1月2日", "2024/1-2", "12:30", "1:2:3", "12元", "3.5万元", "7亿元", "9美元", "1.2欧元", "@", ".", "-", "/", ":", "元", "年", "月", "日", "万", "0", "1", "13", "٣٤", "𝟞",
    " ", "，", "word", "é", "\n", "_", "+", "X", "𝄞", "", "",
]


def slow(text):
    out = []
    for t, p in REGEX_REGISTRY.items():
        out += [(t, m.start(), m.end(), m.group()) for m in re.finditer(p, text)]
    return out


def texts(seed, n):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 25))) for _ in range(n)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_scan_equals_every_pattern_alone(spark, seed):
    data = texts(seed, 700)
    docs = spark.createDataFrame(list(enumerate(data)), "doc_id long, text string").repartition(4)
    got = {}
    for r in detect.detect_regex_entities(docs, "text", ["doc_id"]).orderBy("doc_id", "seq").collect():
        got.setdefault(r.doc_id, []).append((r.type, r.start, r.end, r.span))
    assert all(got.get(k, []) == slow(t) for k, t in enumerate(data))
    spans = docs.select("doc_id", C.regex_entities("text").alias("e")).collect()
    assert all([(e.type, e.span) for e in r.e] == [(t, s) for t, _, _, s in slow(data[r.doc_id])] for r in spans)


def test_custom_patterns_beside_the_scan(spark):
    reg = detect.registry_with({"WORD": r"wo\w+", "IP": r"\d+\.\d+"})
    data = [*texts(5, 200), "word 1.2.3.4 wo", ""]
    docs = spark.createDataFrame([*enumerate(data), (999, None)], "doc_id long, text string")
    got = {}
    for r in detect.detect_regex_entities(docs, "text", ["doc_id"], reg).orderBy("doc_id", "seq").collect():
        got.setdefault(r.doc_id, []).append((r.type, r.start, r.end, r.span))
    want = {k: [(t, m.start(), m.end(), m.group()) for t, p in reg.items() for m in re.finditer(p, x)] for k, x in enumerate(data)}
    assert got == {k: v for k, v in want.items() if v}


def test_the_text_is_scanned_once(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    for df in (detect.detect_regex_entities(docs, "text", ["doc_id"]), mask.mask_spans(docs, "text", ["doc_id"], "s")):
        plan = df._jdf.queryExecution().executedPlan().toString()
        # every pattern sees runs (lambda variables); the column itself is cut once
        assert len(re.findall(r"(?:split|regexp_extract_all|rlike|RLIKE)\(_?text#", plan)) == 1 and plan.count(C.PIECE_RE) == 1


def test_runs_of_a_text(spark):
    df = spark.createDataFrame([("see 12:30 and a@b, x",), ("",), (None,), ("no match here",), ("1",)], "text string")
    got = [r.r for r in df.select(C.text_runs("text").alias("r")).collect()]
    assert [[(x.start, x.s) for x in r] if r is not None else None for r in got] == [[(0, "see"), (4, "12:30"), (14, "a@b")], [], None, [(0, "no")], [(0, "1")]]


def test_items_masked_by_the_entities_of_their_document(spark):
    from maskloom.operators import jobs, restore

    rows = [(1, 0, "title", None, "call 13800138001"), (1, 1, "text", "no digits: x13800138001234", None), (2, 0, "text", "x13800138001234", None), (None, 0, "text", "13800138001", None), (1, 2, "text", None, None)]
    items = spark.createDataFrame(rows, "doc_id long, item_idx int, type string, text string, title string")
    masked, v = jobs.mask_items_job(items, ["doc_id", "item_idx"], "s", scope="document")
    got = {(r.doc_id, r.item_idx): (r.text, r.title) for r in masked.collect()}
    token = v.first().token
    assert v.count() == 1 and got[1, 0] == (None, f"call {token}") and got[1, 1] == (f"no digits: x{token}234", None)
    assert got[2, 0] == ("x13800138001234", None) and got[None, 0] == (token, None) and got[1, 2] == (None, None)
    back = restore.unmask_columns(masked, {"text": "text", "title": "title"}, ["doc_id", "item_idx"], v, keep_cols=["type"])
    cols = ["doc_id", "item_idx", "text", "title"]
    assert sorted(map(str, back.select(cols).collect())) == sorted(map(str, items.select(cols).collect()))


def test_custom_masks_that_collide(spark):
    from maskloom.operators import strategies

    occ = spark.range(400).select(F.col("id").alias("doc_id"), F.lit(0).alias("seq"), F.concat(F.lit("w"), (F.col("id") % 200).cast("string")).alias("span"), F.lit("PER").alias("type"))
    first = strategies.custom_delta(occ, spark.createDataFrame([], "original string, replacement string, priority long"), "s", 2)
    assert first.select("replacement").distinct().count() == first.count() == 200  # 256 masks of two digits
    held = first.limit(50).select("original", "replacement", F.lit(1).cast("long").alias("priority"))
    more = strategies.custom_delta(occ, held, "s", 2)
    assert more.count() == 150 and more.join(held, "replacement").count() == 0
    masks = strategies.custom_masks(occ, held, "s", 2).groupBy("span").agg(F.countDistinct("masked").alias("n"), F.first("masked").alias("m")).collect()
    assert all(r.n == 1 for r in masks) and len({r.m for r in masks}) == 200
