"""One long text: block-wise scans equal the plain ones, and their work grows in proportion."""

import re
import time

import pytest
from pyspark.sql import functions as F

from maskloom.functions import columns as C
from maskloom.operators import detect, mask, ner


def _addresses(n):
    return " ".join(f"x 10.{i // 62500}.{i // 250 % 250}.{i % 250} é" for i in range(n))


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 512, 1300])
def test_exclusive_sums(spark, n):
    lens = [i % 7 for i in range(n)]
    df = spark.createDataFrame([(lens,)], "a array<int>")
    assert df.select(C.exclusive_sums(F.col("a")).alias("o")).first().o == [sum(lens[:i]) for i in range(n)]


@pytest.mark.parametrize("n", [1, 256, 700])
def test_offsets_and_spans_over_block_borders(spark, n):
    text = _addresses(n)
    docs = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    found = [r for r in detect.detect_regex_entities(docs, "text", ["doc_id"], {"IP": detect.REGEX_REGISTRY["IP"]}).collect()]
    assert len(found) == n and all(text[r.start : r.end] == r.span for r in found)
    rows = {r.doc_id: r for r in mask.mask_spans(docs, "text", ["doc_id"], "s", {"IP": detect.REGEX_REGISTRY["IP"]}).collect()}
    assert (rows[2].masked, rows[3].masked, rows[1].n_replaced) == (None, "", n)
    plain = re.sub(r"__MASKED_ip_[0-9a-f]{8}__", "T", rows[1].masked)
    assert plain == re.sub(r"10\.\d+\.\d+\.\d+", "T", text)
    offsets = [(r.offset, r.chunk) for r in ner.chunk_text(docs, "text", ["doc_id"], 5).orderBy("chunk_idx").collect()]
    assert all(text[o : o + len(c)] == c for o, c in offsets) and "".join(c for _, c in offsets) == text


def test_placeholders_keep_private_use_characters_of_the_text(spark):
    docs = spark.createDataFrame([(1, "\ue000 a \ue000\ue010 b \ue001a")], "doc_id long, text string")
    pairs = F.array(*[F.struct(F.lit(s).alias("span"), F.lit(r).alias("repl")) for s, r in (("a", "b"), ("b", "c"))])
    got = docs.select(C.literal_replace("text", pairs).alias("t")).first().t
    assert got == "\ue000 b \ue000\ue010 c \ue001b"


def test_work_in_one_text_grows_in_proportion(spark):
    def seconds(n):
        docs = spark.createDataFrame([(1, _addresses(n))], "doc_id long, text string")
        start = time.monotonic()
        mask.mask_spans(docs, "text", ["doc_id"], "s").collect()
        ner.chunk_text(docs, "text", ["doc_id"], 5).count()
        ner.chunk_text(docs, "text", ["doc_id"], 5).agg(F.sum("offset")).collect()
        return time.monotonic() - start

    seconds(1000)  # warm-up
    small, large = seconds(10_000), seconds(20_000)
    print(f"10,000: {small:.1f} s, 20,000: {large:.1f} s")
    assert large < 3 * small + 2
