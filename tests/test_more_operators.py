"""Golden vectors and laws for chunks, model responses, documents, strategies,
dictionaries, files and streaming."""

import hashlib
import re

from pyspark.sql import functions as F

from maskloom.functions.patterns import TOKEN_RE
from maskloom.operators import detect, documents, mask, ner, strategies as S, words as W
from maskloom.session import scratch_path
from maskloom.sources import files as FS


def test_chunk_laws(spark):
    long_text = "😀" * 460 + "." + "x" * 500
    rows = [(1, "short text."), (2, long_text), (3, "a。" * 300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    ch = ner.chunk_text(df, "text", ["doc_id"]).orderBy("doc_id", "chunk_idx").collect()
    by = {}
    for r in ch:
        by.setdefault(r.doc_id, []).append(r)
    for doc_id, text in rows:
        parts = by[doc_id]
        assert "".join(p.chunk for p in parts) == text
        assert all(len(p.chunk) <= 450 for p in parts)
        off = 0
        for p in parts:
            assert p.offset == off
            off += len(p.chunk)
    assert [p.chunk for p in by[1]] == ["short text."]


def _reference_chunks(text, n=450):
    out, start = [], 0
    while start < len(text):
        if start + n >= len(text):
            out.append(text[start:])
            break
        window = text[start:start + n]
        ends = [m.end() for m in re.finditer(r"[。！？；.!?;]", window)]
        cut = start + ends[-1] if ends else start + n
        out.append(text[start:cut])
        start = cut
    return out


def test_chunks_equal_greedy_loop(spark, ):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    got = {}
    for r in ner.chunk_text(d, "text", ["doc_id"]).collect():
        got.setdefault(r.doc_id, []).append((r.chunk_idx, r.chunk))
    for r in d.collect():
        assert [c for _, c in sorted(got.get(r.doc_id, []))] == _reference_chunks(r.text or "")


def test_parse_responses_edge_vectors(spark):
    rows = [
        (1, 0, "ab a", 'x [{"span":"a","type":"PER"}] y'),
        (2, 0, "a", '[1,"x",{"span":"a","type":"T"}]'),
        (3, 0, "a", '{"span":"a"}'),
        (4, 0, "a", "[1,2"),
        (5, 0, "a", '[{"span":"a",}]'),
    ]
    df = spark.createDataFrame(rows, "doc_id long, chunk_idx long, chunk string, response string")
    parsed = ner.default_prob(ner.fill_offsets(ner.parse_responses(df, ["doc_id", "chunk_idx"])))
    got = sorted((r.doc_id, r.span, r.start, r.end, r.prob) for r in parsed.collect())
    assert got == [(1, "a", 0, 1, 0.95), (2, "a", 0, 1, 0.95)]


def test_paragraph_split_vector(spark):
    df = spark.createDataFrame([(1, "a\n\nb\r\n\r\n\n\n\nc")], "doc_id long, md string")
    paras = [r.text for r in documents.paragraphs(df, "md", ["doc_id"]).orderBy("para_idx").collect()]
    assert paras == ["a", "b", "\nc"]
    m = documents.mask_markdown(df, "md", ["doc_id"], "s").first().masked
    assert m == "a\n\nb\r\n\r\n\n\n\nc"


def test_strategy_vectors(spark):
    df = spark.createDataFrame([("张三", "PER")], "span string, type string")
    sp, ty = F.col("span"), F.col("type")
    r = df.select(
        S.type_based(S.templates_with({"PER": "张某"}))(sp, ty).alias("t"),
        S.replacement()(sp, ty).alias("r"),
        S.hashed()(sp, ty).alias("h"),
        S.hashed("my_secret_salt")(sp, ty).alias("hs"),
    ).first()
    assert (r.t, r.r, r.h, r.hs) == ("张某", "***", "615db57a", hashlib.md5("张三my_secret_salt".encode()).hexdigest()[:8])


def test_context_numbering(spark):
    occ = spark.createDataFrame(
        [(1, 0, "张三", "PER"), (1, 1, "李四", "PER"), (2, 0, "张三", "PER"), (2, 1, "13800138000", "PHONE")],
        "doc_id long, seq long, span string, type string",
    )
    got = [r.masked for r in S.context_masks(occ, ["doc_id"]).orderBy("doc_id", "seq").collect()]
    assert got == ["某人 1", "某人 2", "某人 1", "电话号码"]


def test_custom_strategy(spark):
    occ = spark.createDataFrame([(1, 0, "张三", "PER"), (1, 1, "王五", "PER")], "doc_id long, seq long, span string, type string")
    words = spark.createDataFrame([("张三", "张某某", 0), ("李四", "李某", 1)], W.WORDS_SCHEMA)
    got = [r.masked for r in S.custom_masks(occ, words).orderBy("seq").collect()]
    assert got[0] == "张某某" and re.fullmatch(r"__CUSTOM_[0-9a-f]{8}__", got[1])


def test_chained_words_both_paths(spark):
    df = spark.createDataFrame([(1, "abab")], "doc_id long, text string")
    small = spark.createDataFrame([("a", "b", 0), ("b", "c", 1)], W.WORDS_SCHEMA)
    assert W.apply_custom_words(df, "text", small).first().text == "cccc"
    filler = [(f"zz{i}q", "y", 10 + i) for i in range(261)]
    big = spark.createDataFrame([("a", "b", 0), ("b", "c", 1)] + filler, W.WORDS_SCHEMA)
    assert W.apply_custom_words(df, "text", big).first().text == "cccc"


def test_upsert_rejects_empty_and_keeps_place(spark):
    words = spark.createDataFrame([("a", "1", 1), ("b", "2", 2)], W.WORDS_SCHEMA)
    upd = spark.createDataFrame([("a", "9", 1), ("", "x", 2), ("c", "", 3), ("d", "4", 4)], W.WORDS_SCHEMA)
    got = sorted((r.priority, r.original, r.replacement) for r in W.upsert_words(words, upd).collect())
    assert got == [(1, "a", "9"), (2, "b", "2"), (6, "d", "4")]


def test_routing_and_admission(spark):
    m = spark.createDataFrame(
        [("/x/a.PDF", "a.PDF"), ("/x/report_docx", "report_docx"), ("/x/.bashrc", ".bashrc"), ("/x/b.txt", "b.txt"), ("/x/c", "c")],
        "path string, name string",
    )
    r = {row.path: (row.ext, row.route) for row in FS.route_files(m).collect()}
    assert r["/x/a.PDF"] == ("pdf", "pdf") and r["/x/report_docx"] == ("doc", "office")
    assert r["/x/b.txt"] == ("txt", "text") and r["/x/c"] == ("", "unknown")
    a = {row.name: row.admitted for row in FS.admit_files(m).collect()}
    assert a == {"a.PDF": True, "report_docx": False, ".bashrc": False, "b.txt": True, "c": False}


def test_stream_epoch_retry_is_idempotent(spark):
    from maskloom.streaming.masking_stream import mask_batch

    base = scratch_path(spark, "stream-test")
    batch = spark.createDataFrame([(1, "卡6222020200112233"), (2, "x@y.com")], "page_id long, html string")
    for _ in range(2):  # the same epoch twice, as after a failure
        mask_batch(spark, batch, 0, "html", ["page_id"], "s", base + "/out", base + "/vault")
    assert spark.read.parquet(base + "/out").count() == 2
    assert spark.read.parquet(base + "/vault").count() == 2
    later = spark.createDataFrame([(3, "卡6222020200112233 again")], "page_id long, html string")
    mask_batch(spark, later, 1, "html", ["page_id"], "s", base + "/out", base + "/vault")
    assert spark.read.parquet(base + "/vault").count() == 2  # nothing new
    toks = {r.page_id: re.findall(TOKEN_RE, r.masked) for r in spark.read.parquet(base + "/out").collect()}
    assert toks[1] == toks[3]
