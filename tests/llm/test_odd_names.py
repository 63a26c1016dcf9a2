"""Columns of any name pass through every stage; texts that once ended a job or took square time."""

import time

import pytest
from pyspark.sql import functions as F

from maskloom.llm import decontaminate, line_dedup, pii, simhash, toxicity

#: Names that operators use inside.
NAMES = ["n_words", "n_hit", "__hit_items", "__hit_words", "pii_spans", "row", "__row", "Score", "__score", "n_chars_", "h1", "first", "label", "toxic_", "__boxed_"]


@pytest.fixture(scope="module")
def named(spark):
    rows = [(k, f"text number {k} with some words of its own, mail a{k}@b.org", *[f"ORIG{k}"] * len(NAMES)) for k in range(12)]
    rows += [(None, None, *[None] * len(NAMES)), (3, "the benchmark asks ten words in one row to be found here again", *["x"] * len(NAMES))]
    return spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in NAMES))


def same(out, source, columns=None):
    """``out`` holds rows of ``source``, columns and order of columns included."""
    assert out.columns[: len(source.columns)] == source.columns
    cols = [F.col(f"`{c}`") for c in (columns or source.columns)]
    got, all_ = [sorted(map(str, d.select(*cols).collect())) for d in (out, source)]
    assert set(got) <= set(all_)
    return len(got)


def test_decontaminated_keeps_own_columns(spark, named):
    bench = spark.createDataFrame([("i", "the benchmark asks ten words in one row to be found")], "item_id string, text string")
    assert same(decontaminate.decontaminated(named, bench), named) == 13


def test_one_per_group_keeps_own_columns(named):
    assert same(simhash.one_per_group(named), named) >= 2


def test_mask_pii_keeps_own_columns(named):
    out = pii.mask_pii(named)
    assert same(out, named, [c for c in named.columns if c != "text"]) == 14
    assert out.where("text like '%[EMAIL]%'").count() == 12
    with pytest.raises(ValueError, match="pii_spans"):
        pii.with_spans(named)
    assert pii.with_spans(named, name="found").columns[-1] == "found"


def test_mask_pii_brings_n_chars_up_to_date(spark):
    df = spark.createDataFrame([(1, "a@b.org x", 9), (2, None, 5)], "doc_id long, text string, n_chars int")
    assert sorted(map(tuple, pii.mask_pii(df).collect())) == [(1, "[EMAIL] x", 9), (2, None, 5)]
    assert pii.mask_pii(df).schema == df.schema


def test_without_toxic_keeps_own_columns(spark, named):
    many = named
    labels = spark.createDataFrame([(k, 0, k % 2) for k in range(12)], "doc_id long, quality int, toxic int")
    assert 0 <= same(toxicity.without_toxic(many, labels), named) <= 14


def test_dedup_lines_keeps_own_columns(named):
    both = named.unionByName(named)
    assert same(line_dedup.dedup_lines(both), named, [c for c in named.columns if c != "text"]) == 28
    for c in ("removed", "n_units", "N_removed"):
        with pytest.raises(ValueError, match=c):
            line_dedup.dedup_lines(named.withColumn(c, F.lit(1)))


def test_long_digit_runs_are_no_error(spark):
    texts = ["1" * 5000 + ".1.1.1", "0" * 5000 + "1.2.3.4 a@b.org", "1.2.3." + "0" * 5000, "1.2.3." + "9" * 5000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_ip, r.n_email) for r in pii.pii_digest(df).collect()}
    assert got == {0: (0, 0), 1: (1, 1), 2: (1, 0), 3: (0, 0)}


def test_urls_in_long_texts_take_one_pass():
    automaton = pii._automaton()

    def seconds(text):
        start = time.perf_counter()
        pii.find_spans(text, automaton)
        return time.perf_counter() - start

    for unit in ("://", "x://", "x://a.b", "x://)"):
        small, large = min(seconds(unit * 8000) for _ in range(2)), min(seconds(unit * 32000) for _ in range(2))
        assert large < 12 * small + 0.2, unit
    urls = lambda t: [(a, e) for k, a, e in pii.find_spans(t, automaton) if k == "url"]
    assert urls("see http://a.b/c. And x://nodot/ftp://b.c), ://none.of ") == [(4, 16), (32, 41)]
    assert urls("x://y://z.org/w") == [(4, 15)]


# -- token ids: the piece table, and one id on many rows --------------------------


def test_piece_table_equals_a_dictionary():
    import numpy as np

    from maskloom.llm.token_ids import PieceTable

    rng = np.random.default_rng(2)
    table, plain = PieceTable(), {}
    for n in (10, 5000, 100_000, 300_000):
        # many hashes share their low bits, so probes run on
        fresh = np.unique(rng.integers(1, 1 << 40, n, dtype=np.uint64) << np.uint64(8) | rng.integers(0, 3, n, dtype=np.uint64))
        fresh = fresh[table.get(fresh) < 0]
        table.put(fresh)
        plain.update({int(h): len(plain) + k for k, h in enumerate(fresh)})
        known = np.fromiter(plain, np.uint64, len(plain))
        assert (table.get(known) == np.fromiter(plain.values(), np.int64, len(plain))).all()
        assert (table.get(known + np.uint64(64)) == [plain.get(int(h) + 64, -1) for h in known]).all()


def test_one_id_on_many_rows_is_dealt_to_many_parts(spark, tmp_path):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from maskloom.llm import token_ids

    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    path = str(tmp_path / "tokens")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # the rows are few
    try:
        token_ids.write_tokens(rows, path, public_tokenizers.path("byte_bpe_50k.json"))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    out = token_ids.read_tokens(spark, path)
    assert out.where("doc_id = 7").select("part").distinct().count() > 1
    most = out.groupBy("part").count().agg(F.max("count")).first()[0]
    assert out.count() == 3000 and most < 900
    upto = 0
    for r in sorted(out.select("start", "n_tokens", "doc_id").collect()):
        assert r.start == upto
        upto += r.n_tokens
    ids = [r.doc_id for r in out.orderBy("start").collect()]
    assert ids == sorted(ids)
