"""Collision overrides: a join on the entity rows, whatever their number."""

import re

from maskloom.functions import columns as C
from maskloom.functions.patterns import TOKEN_RE
from maskloom.operators import documents, jobs, mask, restore, vault

SALT = "s"
TEXTS = ["卡6222020200112233 and 6222020200112244", "again 6222020200112244 x@y.com", "none here"]


def _overrides(spark):
    return spark.createDataFrame(
        [("6222020200112244", "BANK", "__MASKED_bank_00000000__"), ("x@y.com", "EMAIL", "__MASKED_email_11111111__")],
        "original string, entity_type string, token string",
    )


def test_mask_text_takes_override_tokens(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    joined = {r.doc_id: r.masked for r in mask.mask_text(df, "text", ["doc_id"], SALT, overrides=_overrides(spark)).collect()}
    plain = {r.doc_id: r.masked for r in mask.mask_text(df, "text", ["doc_id"], SALT).collect()}
    assert "__MASKED_bank_00000000__" in joined[0] and "__MASKED_email_11111111__" in joined[1]
    assert joined[2] == "none here"
    assert {k: re.sub(TOKEN_RE, "T", v) for k, v in joined.items()} == {k: re.sub(TOKEN_RE, "T", v) for k, v in plain.items()}


def test_markdown_rows_equal_the_narrow_form(spark):
    md = "\n\n".join(TEXTS) + "\r\n\r\n\n\n  \n\ntail 6222020200112244"
    df = spark.createDataFrame([(1, md), (2, None), (3, "")], "doc_id long, md string")
    over = _overrides(spark)
    narrow = documents.mask_markdown(df, "md", ["doc_id"], SALT, with_entities=True)
    none = documents.mask_markdown(df, "md", ["doc_id"], SALT, over.limit(0), with_entities=True)
    assert sorted(map(tuple, narrow.collect())) == sorted(map(tuple, none.collect()))
    joined = {r.doc_id: r.masked for r in documents.mask_markdown(df, "md", ["doc_id"], SALT, over).collect()}
    assert joined[2] is None and joined[3] == ""
    assert joined[1].count("__MASKED_bank_00000000__") == 3
    assert re.sub(TOKEN_RE, "T", joined[1]).count("\n\n") == md.count("\n\n")


def test_item_and_markdown_jobs_patch_only_collision_losers(spark, monkeypatch):
    monkeypatch.setattr(C, "TOKEN_HEX_LEN", 2)  # 256 tokens a type: losers in every job
    texts = [f"a{i}@mail.com and 10.0.0.{i}" for i in range(30)]
    items = spark.createDataFrame([(1, i, t, t.upper(), "kept") for i, t in enumerate(texts)], "doc_id long, item_idx int, text string, title string, extra string")
    masked, v = jobs.mask_items_job(items, ["doc_id", "item_idx"], SALT)
    assert v.count() == v.select("token").distinct().count() == 90
    assert masked.columns == items.columns and masked.count() == 30
    md = spark.createDataFrame([(i, t + "\n\n" + t) for i, t in enumerate(texts)], "doc_id long, md string")
    out, v = jobs.mask_markdown_job(md, ["doc_id"], SALT)
    assert out.count() == 30 and v.count() == v.select("token").distinct().count() == 60
    assert len({r.masked for r in out.collect()}) == 30


def test_join_path_round_trip(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    over = _overrides(spark)
    m = mask.mask_text(df, "text", ["doc_id"], SALT, overrides=over)
    plain = vault.assign_tokens(mask.entities_of(m, ["doc_id"]), SALT).select("token", "original", "entity_type")
    v = plain.join(over.select("original"), "original", "left_anti").unionByName(over.select("token", "original", "entity_type"))
    back = {r.doc_id: r.restored for r in restore.unmask_text(m, "masked", ["doc_id"], v).collect()}
    assert back == dict(enumerate(TEXTS))
