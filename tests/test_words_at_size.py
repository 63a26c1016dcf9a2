"""Dictionaries at size: a text meets only the words that it holds."""

from maskloom.operators import words
from maskloom.session import stored


def test_a_word_is_its_own_anchor(spark):
    pairs = [(f"客户{i}", f"u{i}@m", i) for i in range(10_000, 10_400)] + [("x" * 70, "long", 0)]
    d = words.anchored_words(spark.createDataFrame(pairs, words.WORDS_SCHEMA)).collect()
    assert all(r.anchor == (r.original if len(r.original) <= words.ANCHOR_MAX else "x" * words.ANCHOR_MAX) for r in d) and len(d) == 401


def test_marks_grow_with_the_dictionary(spark):
    n = 200_000  # before, 2 ** 20 bits for 600,000 marks
    pairs = spark.range(n).selectExpr("concat('客户', 100000 + id) as original", "'r' as replacement", "id as priority")
    anchors = words._Anchors(stored(words.anchored_words(pairs), "anchors"))
    texts = spark.range(200).selectExpr("concat('电话', 7000000 + id, '客户', 100000 + id, 'y客户900001，卡', 8000000000 + 7919 * id) as t", "concat('客户', 100000 + id) as w")
    got = texts.select("w", anchors(texts["t"]).alias("hits")).collect()
    assert all(r.w in r.hits for r in got) and sum(len(r.hits) for r in got) < 250
