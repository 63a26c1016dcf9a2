"""Mask jobs with model entities: order of detections, failing models, types, collisions."""

import pytest
from pyspark.sql import functions as F

from maskloom.functions import columns as C
from maskloom.operators import jobs, ner, restore

ENT = "doc_id long, seq long, span string, type string"


def test_model_entities_come_first_and_restore(spark):
    docs = spark.createDataFrame([(1, "Alice at 10.0.0.1, Alice!"), (2, None), (3, "")], "doc_id long, text string")
    ents = spark.createDataFrame([(1, 0, "Alice", "PER"), (1, 1, "10.0.0.1", "LOC")], ENT)
    masked, v = jobs.mask_job(docs, ["doc_id"], "s", model_entities=ents)
    rows = {r.doc_id: r for r in masked.collect()}
    assert [tuple(e) for e in rows[1].entities] == [("Alice", "PER"), ("10.0.0.1", "LOC"), ("10.0.0.1", "IP")]
    # the first entity of a span decides its token
    assert rows[1].masked.count("__MASKED_per_") == 2 and "__MASKED_loc_" in rows[1].masked and "__MASKED_ip_" not in rows[1].masked
    assert rows[2].masked is None and rows[3].masked == ""
    back = {r.doc_id: r.restored for r in restore.unmask_text(masked, "masked", ["doc_id"], v).collect()}
    assert back == {1: "Alice at 10.0.0.1, Alice!", 2: None, 3: ""}


def test_types_of_the_model_are_checked_before_masking(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    for bad in ("ORDER_NO", "人名", "A\n", None):
        with pytest.raises(ValueError):
            jobs.mask_job(docs, ["doc_id"], "s", model_entities=spark.createDataFrame([(1, 0, "a", bad)], ENT))


def test_failing_model(spark):
    def model(chunk):
        if "bad" in chunk:
            raise RuntimeError("no answer")
        return "[]"

    docs = spark.createDataFrame([(1, "good"), (2, "fine. bad"), (3, None)], "doc_id long, text string")
    scored = ner.score_chunks(ner.chunk_text(docs, "text", ["doc_id"], 5), model, ["doc_id", "chunk_idx"])
    with pytest.raises(RuntimeError, match="1 texts"):
        jobs.admit_scored(docs, ["doc_id"], scored)
    ok, held = jobs.admit_scored(docs, ["doc_id"], scored, "quarantine")
    assert sorted(r.doc_id for r in ok.collect()) == [1, 3] and [r.doc_id for r in held.collect()] == [2]
    with pytest.raises(ValueError):
        jobs.admit_scored(docs, ["doc_id"], scored, "ignore")


def test_custom_words_go_first_and_colliding_tokens_are_told_apart(spark, monkeypatch):
    plain = C.token_hex
    monkeypatch.setattr(C, "token_hex", lambda t, s, salt, *_: F.rpad(F.substring(plain(t, s, salt), 1, 1), 8, "0"))
    text = " ".join(f"10.0.0.{i}" for i in range(40))
    docs = spark.createDataFrame([(1, "secret " + text), (2, "nothing")], "doc_id long, text string")
    words = spark.createDataFrame([("secret", "code", 1)], "original string, replacement string, priority long")
    masked, v = jobs.mask_job(docs, ["doc_id"], "s", custom_words=words)
    assert v.count() == v.select("token").distinct().count() == 40
    back = {r.doc_id: r.restored for r in restore.unmask_text(masked, "masked", ["doc_id"], v).collect()}
    assert back == {1: "code " + text, 2: "nothing"}
