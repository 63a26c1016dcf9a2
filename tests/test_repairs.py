"""Faults that rows of plain tokens cannot show: collision rounds, doubled tokens, types, ranges, failed parses."""

import pytest
from pyspark.sql import functions as F

from maskloom.functions import columns as C
from maskloom.operators import detect, ner, restore, vault, words

SCHEMA = "token string, original string, entity_type string"


def test_every_entity_keeps_one_token_over_several_rounds(spark):
    # two hex digits: 60 entities on 256 tokens need several rounds
    rows = spark.range(60).select(F.col("id").cast("string").alias("original"), F.lit("PHONE").alias("entity_type"))
    delta = rows.select(C.token("entity_type", "original", "s", 2).alias("token"), "original", "entity_type")
    old = spark.createDataFrame([(r.token, "old" + r.token, "PHONE") for r in delta.limit(5).collect()], SCHEMA).distinct()
    got = vault.resolve_collisions(delta, "s", old, hex_len=2).collect()
    assert sorted(r.original for r in got) == sorted(str(i) for i in range(60))
    tokens = [r.token for r in got] + [r.token for r in old.collect()]
    assert len(tokens) == len(set(tokens))


def test_doubled_and_ambiguous_tokens(spark):
    v = spark.createDataFrame(
        [("__MASKED_ip_00000001__", "a", "IP"), ("__MASKED_ip_00000001__", "a", "IP"), ("__MASKED_ip_00000002__", "b", "IP"), ("__MASKED_ip_00000002__", "c", "IP")],
        SCHEMA,
    )
    df = spark.createDataFrame([(1, "x __MASKED_ip_00000001__ y __MASKED_ip_00000002__")], "doc_id long, masked string")
    assert restore.unmask_text(df, "masked", ["doc_id"], v).first().restored == "x a y __MASKED_ip_00000002__"


def test_types_that_a_token_cannot_hold(spark):
    with pytest.raises(ValueError):
        detect.registry_with({"ORDER_NO": r"\d+"})
    assert list(detect.registry_with({"ORDERNO": r"\d+"}))[-1] == "ORDERNO"


@pytest.mark.parametrize("bits, segment", [(6, 3), (20, 4096)])
def test_dictionary_rounds_compose(spark, monkeypatch, bits, segment):
    monkeypatch.setattr(words, "MARK_BITS_LOG2", bits)
    monkeypatch.setattr(words, "SEGMENT", segment)
    pairs = [(f"w{i}", f"w{i + 1}", i) for i in range(20)] + [("w20x", "end", 99)]
    d = spark.createDataFrame(pairs, "original string, replacement string, priority long")
    docs = spark.createDataFrame([(1, "w0x w5 w19"), (2, None)], "doc_id long, text string")
    want = "w0x w5 w19"
    for a, b, _ in pairs:
        want = want.replace(a, b)
    assert {r.doc_id: r.text for r in words.apply_custom_words(docs, "text", d).collect()} == {1: want, 2: None}


def test_remask_without_words_masks_all(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    old = spark.createDataFrame([(1, "stale")], "doc_id long, masked string")
    none = spark.createDataFrame([], "original string, replacement string, priority long")
    out = words.remask_incremental(docs, "text", ["doc_id"], old, none, lambda df: df.withColumn("masked", F.upper("text")))
    assert {r.doc_id: r.masked for r in out.collect()} == {1: "A", 2: "B"}


def test_text_behind_the_array_voids_the_response(spark):
    rows = [(1, 0, '[{"span":"a","type":"T"}] note [1]'), (2, 0, 'ok: [{"span":"a","type":"T"}] done')]
    df = spark.createDataFrame(rows, "doc_id long, chunk int, response string")
    assert [r.doc_id for r in ner.parse_responses(df, ["doc_id"]).collect()] == [2]
