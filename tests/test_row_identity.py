"""Texts that hold placeholder characters, rows without or with repeated ids, tokens that stand in every row."""

import random
import re

import pytest
from pyspark.sql import functions as F

from maskloom.functions import columns as C
from maskloom.operators import jobs, mask, restore, strategies, vault

OWN = "\ue000\ue001\ue002\ue010\ue011\ue01f"


def round_trip(spark, texts):
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    masked, v = jobs.mask_job(docs, ["doc_id"], "s")
    back = restore.unmask_text(masked, "masked", ["doc_id"], v)
    key = lambda r: (r[0] is not None, r[0] or 0, r[1] or "")
    assert sorted(map(tuple, back.collect()), key=key) == sorted(texts, key=key)
    return masked


def test_a_text_that_looks_like_a_placeholder_restores(spark):
    probe = "\ue000\ue010\ue001 13800138001"
    masked = round_trip(spark, [(1, probe), (2, "13800138001"), (3, OWN * 3), (4, OWN + "a@b.com" + OWN + "10.1.2.3 10.1.2.3" + OWN)])
    assert [r.masked for r in masked.where("doc_id = 1").collect()][0].startswith("\ue000\ue010\ue001 __MASKED_phone_")


def slow_fold(text, pairs):
    """The two-phase fold with markers no string can match: lists of characters and indexes."""
    items = list(text)
    for k, (span, _) in enumerate(pairs):
        out, i, s = [], 0, list(span)
        while i < len(items):
            if items[i : i + len(s)] == s:
                out.append(k)
                i += len(s)
            else:
                out.append(items[i])
                i += 1
        items = out
    return "".join(pairs[x][1] if isinstance(x, int) else x for x in items)


def test_fold_of_texts_and_spans_with_placeholder_characters(spark):
    rng = random.Random(1)
    word = lambda n: "".join(rng.choice("ab" + OWN) for _ in range(rng.randint(1, n)))
    pairs = [(word(3), word(2)) for _ in range(20)]
    texts = [word(40) for _ in range(150)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    arr = F.array(*[F.struct(F.lit(a).alias("span"), F.lit(b).alias("repl")) for a, b in pairs])
    got = [r.o for r in df.select(C.literal_replace("t", arr).alias("o")).collect()]
    assert got == [slow_fold(t, pairs) for t in texts]


def test_escaped_texts_come_back(spark):
    texts = [OWN, "", "x" + OWN + "𝄞\n", "plain"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r.o for r in df.select(C.unescaped(C.escaped(F.col("t"))).alias("o")).collect()] == texts


def test_null_and_repeated_ids_restore(spark):
    texts = [(None, "mail a@b.com"), (None, "mail c@d.com and a@b.com"), (None, None), (7, "10.0.0.1"), (7, "10.0.0.2 x@y.org"), (7, "10.0.0.1"), (8, ""), (9, "nothing")]
    round_trip(spark, texts)


def test_null_ids_with_collision_losers(spark, monkeypatch):
    monkeypatch.setattr(C, "TOKEN_HEX_LEN", 2)  # 256 tokens a type: losers in every job
    docs = spark.createDataFrame([(None if i % 2 else 1, f"a{i}@mail.com and 10.0.0.{i}") for i in range(60)], "doc_id long, text string")
    masked, v = jobs.mask_job(docs, ["doc_id"], "s")
    assert v.count() == v.select("token").distinct().count() == 120
    texts = [r.masked for r in masked.collect()]
    assert len(texts) == len(set(texts)) == 60
    known = {r.token: r.original for r in v.collect()}
    back = [re.sub("__MASKED_[a-z]+_[0-9a-f]{2}__", lambda m: known[m.group()], t) for t in texts]
    assert sorted(back) == sorted(r.text for r in docs.collect())


def test_several_columns_of_a_row(spark):
    v = spark.createDataFrame([("__MASKED_ip_00000001__", "A", "IP"), ("__MASKED_ip_00000002__", "B", "IP")], vault.VAULT_SCHEMA)
    rows = [(1, "__MASKED_ip_00000001__ x", None), (1, None, "__MASKED_ip_00000002____MASKED_ip_00000009__"), (None, "__MASKED_ip_00000002__", "__MASKED_ip_00000001__"), (2, "a", "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, title string")
    got = restore.unmask_columns(df, {"text": "text", "title": "title"}, ["doc_id"], v)
    assert sorted(map(str, got.collect())) == sorted(map(str, [
        *spark.createDataFrame([(1, "A x", None), (1, None, "B__MASKED_ip_00000009__"), (None, "B", "A"), (2, "a", "b")], df.schema).collect()
    ]))


def test_a_token_in_every_row_meets_the_vault_once_a_block(spark):
    hot = "__MASKED_ip_00000001__"
    df = spark.range(5000).select("id", F.concat(F.lit(hot + " "), F.col("id").cast("string")).alias("m")).repartition(4)
    v = spark.createDataFrame([(hot, "H", "IP")], vault.VAULT_SCHEMA)
    out = restore.unmask_text(df, "m", ["id"], v)
    assert out.where(F.col("restored") != F.concat(F.lit("H "), F.col("id").cast("string"))).count() == 0 and out.count() == 5000
    plan = out._jdf.queryExecution().executedPlan().toString()
    # rows are grouped to one a block and token before they are dealt out by token, and come back by both
    assert re.search(r"HashAggregate\(keys=\[block#\d+L?, mask#\d+\]", plan) and re.search(r"Join \[block#\d+L?, mask#\d+\], \[block#\d+L?, mask#\d+\]", plan)


@pytest.mark.parametrize("templates", [None, {"PER": "X", "ORG": "Y", "LOC": "Z", "GPE": "W", "DEFAULT": "*"}])
def test_strategy_masks_go_back_before_tokens(spark, templates):
    t = templates or strategies.TYPE_TEMPLATES
    texts = [(None, f"{t['PER']} 1 and {t['PER']} 10, __MASKED_ip_00000001__, client9"), (None, f"{t['PER']} 2"), (3, "client99 client9"), (4, None)]
    df = spark.createDataFrame(texts, "doc_id long, masked string")
    reverse = spark.createDataFrame([(f"{t['PER']} 1", "Ann", 1), (f"{t['PER']} 10", "Bob", 1), (t["LOC"], "many", 2), ("client9", "u9", 1), ("client99", "u99", 1)], "mask_text string, original string, n_originals long")
    words = spark.createDataFrame([("u9", "client9", 1), ("u99", "client99", 2)], "original string, replacement string, priority long")
    v = spark.createDataFrame([("__MASKED_ip_00000001__", "10.0.0.1", "IP")], vault.VAULT_SCHEMA)
    got = restore.unmask_text(df, "masked", ["doc_id"], v, reverse=reverse, custom_words=words, templates=templates)
    want = [(None, "Ann and Bob, 10.0.0.1, u9"), (None, f"{t['PER']} 2"), (3, "u99 u9"), (4, None)]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_overrides_of_repeated_ids(spark):
    over = spark.createDataFrame([("a@b.com", "EMAIL", "__MASKED_email_11111111__")], "original string, entity_type string, token string")
    docs = spark.createDataFrame([(1, "a@b.com"), (1, "so a@b.com"), (None, "to a@b.com")], "doc_id long, text string")
    got = sorted(r.masked for r in mask.mask_text(docs, "text", ["doc_id"], "s", overrides=over).collect())
    # ids join with ids, so each row of an id gets the id's overrides, once
    assert got == ["__MASKED_email_11111111__", "so __MASKED_email_11111111__", "to __MASKED_email_11111111__"]
