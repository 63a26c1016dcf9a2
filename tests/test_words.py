"""The dictionary as a table: joined word lists equal the plain chained replace."""

import random
import re

import pytest
from pyspark.sql import functions as F

from maskloom.operators import words

SCHEMA = "original string, replacement string, priority long"
PYTHON_NODES = ("ArrowEvalPython", "BatchEvalPython", "MapInPandas", "PythonUDF", "FlatMapGroupsInPandas", "MapInArrow")


def chained(text, pairs):
    if text is None:
        return None
    for _, a, b in sorted((p, a, b) for a, b, p in pairs):
        text = text.replace(a, b)
    return text


def applied(spark, texts, pairs):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = words.apply_custom_words(docs, "text", spark.createDataFrame(pairs, SCHEMA))
    assert out.columns == ["doc_id", "text"]
    return [r.text for r in out.orderBy("doc_id").collect()]


@pytest.mark.parametrize("letters, longest, seed", [("ab", 3, 1), ("ab", 6, 2), ("abé", 5, 3), ("ab客𝄞\uffff", 9, 4)])
def test_equals_the_plain_chain(spark, letters, longest, seed):
    """Few letters: replacements make words, also across their borders, and words share anchors."""
    rng = random.Random(seed)
    word = lambda n: "".join(rng.choice(letters) for _ in range(rng.randint(1, n)))
    originals = {word(longest) for _ in range(12)}
    pairs = [(w, word(longest), rng.randint(0, 6)) for w in sorted(originals)]
    texts = [word(60) for _ in range(60)] + ["", None, "\n".join(word(30) for _ in range(5))]
    assert applied(spark, texts, pairs) == [chained(t, pairs) for t in texts]


def test_special_characters_and_invalid_words(spark):
    pairs = [("a.b*", "X\\E$1", 1), ("\\E", "[q]", 2), ("\\Qx", "y", 3), ("", "never", 0), ("kept", "", 0), ("gone", None, 0), ("(", ")", 4)]
    texts = ["a.b* \\E \\Qx ( kept gone", "aXb*", None]
    want = [chained(t, [p for p in pairs if p[0] and p[1]]) for t in texts]
    assert applied(spark, texts, pairs) == want


def test_words_of_one_prefix_or_suffix_do_not_all_meet(spark):
    pairs = [(f"http://one.host/{i}", f"<{i}>", i) for i in range(400)] + [(f"{i}@one.host", f"[{i}]", 1000 + i) for i in range(400)]
    d = words.anchored_words(spark.createDataFrame(pairs, SCHEMA))
    assert d.groupBy("anchor").count().agg(F.max("count")).first()[0] <= 20
    texts = ["see http://one.host/12 and http://one.host/399x or 7@one.host, 42@one.hos"]
    assert applied(spark, texts, pairs) == [chained(t, pairs) for t in texts]


def test_long_texts_are_scanned_in_segments(spark, monkeypatch):
    monkeypatch.setattr(words, "SEGMENT", 10)
    pairs = [("across the border", "ACROSS", 1), ("x", "yy", 2), ("yyb", "Z", 3)]
    texts = ["." * k + "across the border" + "-" * 30 + "xb" for k in range(25)]
    assert applied(spark, texts, pairs) == [chained(t, pairs) for t in texts]


def test_columns_rows_and_plan(spark):
    rows = [(None, "a b", 1, "r"), (None, "a b", 1, "r"), (3, None, 2, None), (4, "", 3, "q"), (5, "none", 4, "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, place long, row string")
    d = spark.createDataFrame([("a", "b", 0), ("b b", "c", 1)], SCHEMA)
    out = words.apply_custom_words(docs, "text", d, out_col="done", keep_cols=["doc_id", "place", "row", "text"])
    assert out.columns == ["doc_id", "place", "row", "text", "done"]
    got = sorted(map(str, out.collect()))
    assert len(got) == 5 and sum("done='c'" in g for g in got) == 2
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not any(n in plan for n in PYTHON_NODES)
    none = words.apply_custom_words(docs, "text", d.limit(0), keep_cols=["doc_id"])
    assert none.columns == ["doc_id", "text"] and none.count() == 5


def test_dictionary_never_passes_the_driver():
    import inspect

    source = inspect.getsource(words)
    assert not re.search("toLocalIterator|toPandas|broadcast|mapIn", source)
