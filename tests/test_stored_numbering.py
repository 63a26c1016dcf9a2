"""Numbered strategies over a stored mapping: known texts keep their masks, numbers go on."""

from maskloom.operators import strategies as S

OCC = "doc_id long, seq long, span string, type string"


def _occ(spark, rows):
    return spark.createDataFrame(rows, OCC)


def test_context_run_continues_a_stored_mapping(spark):
    first = _occ(spark, [(1, 0, "张三", "PER"), (1, 1, "北京", "LOC"), (2, 0, "李四", "PER")])
    prior = S.context_mapping(first, ["doc_id"]).select("original", "entity_type", "mask_text")
    assert {r.original: r.mask_text for r in prior.collect()} == {"张三": "某人 1", "北京": "某地点 1", "李四": "某人 2"}
    # 张三 comes with an unnumbered type and before any numbered one, yet is known
    again = _occ(spark, [(5, 0, "张三", "EMAIL"), (5, 1, "王五", "PER"), (6, 0, "北京", "LOC"), (7, 0, "赵六", "PER"), (7, 1, "某公司", "ORG")])
    masks = S.context_masks(again, ["doc_id"], prior=prior).collect()
    assert {r.span: r.masked for r in masks} == {"张三": "某人 1", "王五": "某人 3", "北京": "某地点 1", "赵六": "某人 4", "某公司": "某机构 1"}
    assert {r.original for r in S.context_mapping(again, ["doc_id"], prior=prior).collect()} == {"王五", "赵六", "某公司"}
    empty = prior.limit(0)
    assert {r.span: r.masked for r in S.context_masks(first, ["doc_id"], prior=empty).collect()}["李四"] == "某人 2"


def test_hybrid_run_returns_new_rows_only(spark):
    words = spark.createDataFrame([("机密", "代号", 1)], "original string, replacement string, priority long")
    first = _occ(spark, [(1, 0, "张三", "PER"), (1, 1, "机密", "PER"), (1, 2, "a@b.c", "EMAIL")])
    prior = S.hybrid_mapping(first, ["doc_id"], words).select("original", "entity_type", "mask_text")
    assert {r.original: r.mask_text for r in prior.collect()} == {"张三": "某人 1", "机密": "代号", "a@b.c": "电子邮箱"}
    again = _occ(spark, [(2, 0, "a@b.c", "PER"), (2, 1, "李四", "PER"), (2, 2, "机密", "PER")])
    new = S.hybrid_mapping(again, ["doc_id"], words, prior=prior).collect()
    assert [(r.original, r.mask_text, r.is_custom) for r in new] == [("李四", "某人 2", False)]


def test_remembered_misses_restore(spark):
    words = spark.createDataFrame([("a", "b", 1)], "original string, replacement string, priority long")
    occ = _occ(spark, [(1, 0, "a", "PER"), (1, 1, "x", "PER"), (2, 0, "x", "LOC")])
    delta = S.custom_delta(occ, words, "s").collect()
    assert [r.original for r in delta] == ["x"]
    masked = {r.span: r.masked for r in S.custom_masks(occ, words, "s").collect()}
    assert masked == {"a": "b", "x": delta[0].replacement}
    assert delta[0].replacement != S.custom_delta(occ, words, "t").first().replacement
