"""Masking semantics (literal mode quirks), tokens, vault, restore, round trip."""

import re

from pyspark.sql import functions as F

from maskloom.functions import columns as C
from maskloom.functions.patterns import TOKEN_RE
from maskloom.operators import mask, restore, vault

SALT = "s"


def _mask(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return mask.mask_text(df, "text", ["doc_id"], SALT).orderBy("doc_id").collect()


def test_token_format_and_value(spark):
    df = spark.createDataFrame([("BANK", "123")], "t string, s string")
    tok = df.select(C.token("t", "s", SALT).alias("k")).first().k
    assert re.fullmatch(TOKEN_RE, tok) and tok.startswith("__MASKED_bank_")
    import hashlib

    assert tok == "__MASKED_bank_" + hashlib.sha256(b"s|BANK|123").hexdigest()[:8] + "__"


def test_literal_mode_phone_before_email(spark):
    out = _mask(spark, ["13800138000@qq.com"])[0].masked
    assert out.endswith("@qq.com") and out.startswith("__MASKED_phone_")


def test_literal_mode_shorter_span_breaks_longer(spark):
    out = _mask(spark, ["联系13800138000@qq.com或1.2.3.4、1.2.3.45"])[0].masked
    toks = re.findall(TOKEN_RE, out)
    # P@qq.com 或 I1、I1 5  (the trailing 5 stays in clear)
    assert re.fullmatch(r"联系__MASKED_phone_[0-9a-f]{8}__@qq\.com或(__MASKED_ip_[0-9a-f]{8}__)、(?:\1)5", out)
    assert len(toks) == 3


def test_empty_and_null(spark):
    rows = _mask(spark, ["", None, "plain words"])
    assert rows[0].masked == "" and rows[1].masked is None and rows[2].masked == "plain words"


def test_span_mode_only_at_offsets(spark):
    df = spark.createDataFrame([(0, "1.2.3.4、1.2.3.45")], "doc_id long, text string")
    out = mask.mask_spans(df, "text", ["doc_id"], SALT).first().masked
    assert "5" not in re.sub(TOKEN_RE, "", out) and len(re.findall(TOKEN_RE, out)) == 2


def test_restore_unknown_and_old_tokens(spark):
    v = spark.createDataFrame([("__MASKED_0123abcd__", "old", "X")], vault.VAULT_SCHEMA)
    df = spark.createDataFrame(
        [(1, "a __MASKED_0123abcd__ b __MASKED_per_ffffffff__ c"), (2, "no tokens")], "doc_id long, masked string"
    )
    out = {r.doc_id: r.restored for r in restore.unmask_text(df, "masked", ["doc_id"], v).collect()}
    assert out == {1: "a old b __MASKED_per_ffffffff__ c", 2: "no tokens"}


def test_collision_overrides_round_trip(spark):
    texts = ["卡6222020200112233 and 6222020200112244", "again 6222020200112244"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    # force a collision: pretend the second bank number lost and got another token
    over = spark.createDataFrame([("6222020200112244", "BANK", "__MASKED_bank_00000000__")], "original string, entity_type string, token string")
    m = mask.mask_text(df, "text", ["doc_id"], SALT, overrides=over)
    got = {r.doc_id: r.masked for r in m.collect()}
    assert "__MASKED_bank_00000000__" in got[0] and "__MASKED_bank_00000000__" in got[1]
    ents = mask.entities_of(m, ["doc_id"])
    assign = vault.assign_tokens(ents, SALT).filter(F.col("original") != "6222020200112244").select("token", "original", "entity_type")
    v = assign.unionByName(over.select("token", "original", "entity_type"))
    back = {r.doc_id: r.restored for r in restore.unmask_text(m, "masked", ["doc_id"], v).collect()}
    assert back == dict(enumerate(texts))


def test_resolve_collisions_makes_tokens_unique(spark):
    delta = spark.createDataFrame(
        [("__MASKED_x_00000000__", "a", "X"), ("__MASKED_x_00000000__", "b", "X"), ("__MASKED_x_11111111__", "c", "X")],
        vault.VAULT_SCHEMA,
    )
    prior = spark.createDataFrame([("__MASKED_x_11111111__", "z", "X")], vault.VAULT_SCHEMA)
    out = vault.resolve_collisions(delta, SALT, prior).collect()
    toks = [r.token for r in out]
    assert len(out) == 3 and len(set(toks)) == 3 and "__MASKED_x_11111111__" not in toks
    assert {r.original: r.token for r in out}["a"] == "__MASKED_x_00000000__"
