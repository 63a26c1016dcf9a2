"""The registered queries of this folder, each its operator over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, grace_dedup, hmm_lm, line_dedup, packing, pii, quality, sharding, simhash, spelling, token_ids, toxicity, whitening
from .common import table


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return c.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), "contaminated",
    )


def op4_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_ids.token_table(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_digest(table(spark, sf_dir, "documents"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return d.select("doc_id", simhash.fingerprint_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_hmm_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm_lm.language_model_scores(table(spark, sf_dir, "documents"))


def op9_extendible_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    spans = F.transform("removed", lambda r: F.concat_ws(":", r["start"].cast("string"), r["end"].cast("string"), r["kept_doc"].cast("string")))
    return d.select("doc_id", "text", "n_units", "n_removed", F.array_join(spans, ",").alias("removed"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


def op12_grace_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grace_dedup.copies(table(spark, sf_dir, "documents"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        op1_best_fit_packing, op2_quality_rules, op3_decontamination, op4_token_ids, op5_pii, op6_simhash, op7_toxicity, op8_hmm_lm,
        op9_extendible_shards, op10_line_dedup, op11_embedding_whitening, op12_grace_dedup, op13_spelling_variants, pipeline,
    )
}
_KEY = sharding.KEY_BITS
#: Numerator, denominator and factor of each quality signal.
_RATES = {
    "symbols": ("n_symbols", "word_chars", 1000), "shouts": ("n_shouts", "word_chars", 1000), "capitals": ("n_capitals", "word_chars", 1000),
    "dup_lines": ("n_dup_lines", "n_lines", 1000), "repeats": ("n_repeat_words", "n_words", 1000), "word_length": ("word_chars", "n_words", 100),
}


def _inside(signal: str) -> str:
    low = f" AND {signal} >= {signal}_low" if signal in quality.TWO_SIDED else ""
    return f"{signal} <= {signal}_high{low}"


_QUALITY_SQL = rf"""WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS t FROM documents),
c AS (SELECT doc_id, lang, source, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls,
  length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars, (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  (length(t) - length(regexp_replace(t, '[!?]', '', 'g')))::BIGINT AS n_shouts, (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')))::BIGINT AS n_capitals FROM d),
w AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS k FROM c),
g AS (SELECT doc_id, k, count(*) OVER (PARTITION BY doc_id, g) AS n FROM (SELECT doc_id, k, w || ' ' || lead(w) OVER o || ' ' || lead(w, 2) OVER o AS g FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY k)) x WHERE g IS NOT NULL),
r AS (SELECT doc_id, count(DISTINCT p)::BIGINT AS n FROM (SELECT doc_id, unnest(range(k, k + 3)) AS p FROM g WHERE n > 1) x GROUP BY doc_id),
b AS (SELECT c.*, len(ws)::BIGINT AS n_words, len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words FROM c LEFT JOIN r USING (doc_id)),
m AS (SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words AS base_failed,
  {', '.join(f"CASE WHEN {of} > 0 THEN ({by} * {n}) // {of} ELSE 0 END::BIGINT AS {s}" for s, (n, of, by) in _RATES.items())} FROM b),
v AS ({' UNION ALL '.join(f"SELECT lang, source, '{s}' AS signal, {slack} AS slack, {s} AS x FROM m WHERE NOT base_failed" for s, slack in quality.SLACK.items())}),
k AS (SELECT lang, source, signal, slack, (x >> greatest(len(bin(x)) - {quality.EXACT_BITS}, 0)) << greatest(len(bin(x)) - {quality.EXACT_BITS}, 0) AS x FROM v),
l AS (SELECT 0 AS level, lang AS l, source AS s, signal, slack, x FROM k UNION ALL SELECT 1, lang, NULL, signal, slack, x FROM k UNION ALL SELECT 2, NULL, NULL, signal, slack, x FROM k),
q AS (SELECT level, l, s, signal, slack, min(x) FILTER (upto * 4 >= size) AS q1, min(x) FILTER (upto * 4 >= size * 3) AS q3, any_value(size) AS size
  FROM (SELECT *, count(*) OVER (PARTITION BY level, l, s, signal ORDER BY x) AS upto, count(*) OVER (PARTITION BY level, l, s, signal) AS size FROM l) x GROUP BY ALL),
f AS (SELECT a.lang, a.source, q.signal, arg_min(q1 - {quality.FENCE} * (q3 - q1) - slack, level) AS low, arg_min(q3 + {quality.FENCE} * (q3 - q1) + slack, level) AS high
  FROM (SELECT DISTINCT lang, source FROM k) a JOIN q ON (q.size >= {quality.MIN_GROUP} OR level = 2) AND (level = 2 OR q.l IS NOT DISTINCT FROM a.lang) AND (level > 0 OR q.s IS NOT DISTINCT FROM a.source)
  GROUP BY ALL),
t AS (SELECT lang, source, {', '.join(f"any_value(low) FILTER (signal = '{s}') AS {s}_low, any_value(high) FILTER (signal = '{s}') AS {s}_high" for s in quality.SLACK)} FROM f GROUP BY ALL)
SELECT m.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, {', '.join(quality.SLACK)},
  NOT base_failed AND coalesce({' AND '.join(_inside(s) for s in quality.SLACK)}, false) AS kept
FROM m LEFT JOIN t ON t.lang IS NOT DISTINCT FROM m.lang AND t.source IS NOT DISTINCT FROM m.source"""

#: crc32 of an id, a colon and a run of letters up to U+00FF, over UTF-8 bytes.
_CRC_TABLE = "list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i))"
_UTF8 = "flatten(list_transform(string_split(s, ''), lambda ch: CASE WHEN ord(ch) < 128 THEN [ord(ch)::BIGINT] ELSE [(192 + (ord(ch) >> 6))::BIGINT, (128 + (ord(ch) & 63))::BIGINT] END))"
_CRC = f"xor(list_reduce({_UTF8}, lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]), 4294967295), 4294967295)"
_SPELLING_SQL = rf"""WITH RECURSIVE tab AS MATERIALIZED (SELECT {_CRC_TABLE} AS tab),
r AS (SELECT doc_id::VARCHAR AS id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{spelling.UPPER}', '{spelling.LOWER}'), '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents),
k AS MATERIALIZED (SELECT run, id || ':' || run AS s, count(*) AS m FROM r WHERE length(run) >= {spelling.MIN_LENGTH} GROUP BY ALL),
c AS (SELECT run, m, {_CRC} AS h FROM k, tab),
v AS (SELECT CASE WHEN h % {spelling.DELETE_ONE_IN} = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, m FROM c),
w AS MATERIALIZED (SELECT word, sum(m)::BIGINT AS n FROM v WHERE length(word) >= {spelling.MIN_LENGTH} GROUP BY word HAVING sum(m) >= {spelling.MIN_COUNT}),
d AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w) x),
e AS (SELECT a.word, b.word AS near, b.n FROM d a JOIN d b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT d.word, w.word, w.n FROM d JOIN w ON w.word = d.rest UNION SELECT w.word, d.word, d.n FROM d JOIN w ON w.word = d.rest),
b AS (SELECT word, count(*)::BIGINT AS n_near, max(n) AS top, arg_min(near, (-n, near)) AS near FROM e GROUP BY word),
f AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN top >= {spelling.FORM_RATIO} * w.n THEN near END AS form, CASE WHEN top >= {spelling.FORM_RATIO} * w.n THEN top END::BIGINT AS form_n
  FROM w LEFT JOIN b USING (word)),
way AS (SELECT word, coalesce(form, word) AS root FROM f UNION SELECT way.word, f.form FROM way JOIN f ON f.word = way.root WHERE f.form IS NOT NULL)
SELECT f.word, f.form, way.root, f.n, f.n_near, f.form_n FROM f JOIN way USING (word) JOIN f AS g ON g.word = way.root WHERE g.form IS NULL"""

#: DuckDB twins, for tables whose doc_id is unique and whose rows all fit a shard.
ORACLE: dict[str, str] = {
    "op2_quality_rules": _QUALITY_SQL,
    "op3_decontamination": rf"""WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
iw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
i AS (SELECT item_id, ws, least({decontaminate.SPAN}, len(ws)) AS n FROM iw WHERE len(ws) > 0),
win AS (SELECT DISTINCT item_id, n, array_to_string(ws[k:k + n - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(ws) - n + 2)) AS k FROM i) x),
dg AS (SELECT doc_id, n, k, array_to_string(ws[k:k + n - 1], ' ') AS g
  FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS k FROM dw JOIN (SELECT DISTINCT n FROM win) s ON len(ws) >= n) y),
m AS (SELECT doc_id, k, n, item_id FROM dg JOIN win USING (n, g)),
h AS (SELECT doc_id, count(DISTINCT p)::BIGINT AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM m) z GROUP BY doc_id),
c AS (SELECT doc_id, count(*)::BIGINT AS n_items, string_agg(s, ',' ORDER BY s) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM m) q GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN h USING (doc_id) LEFT JOIN c USING (doc_id)""",
    "op9_extendible_shards": rf"""WITH a AS (SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS bytes, ('0x' || substr(md5(doc_id::VARCHAR), 1, {_KEY // 4}))::BIGINT AS h FROM documents),
p AS (SELECT d.depth, (h >> ({_KEY} - d.depth)) AS p, sum(bytes)::BIGINT AS b, count(*) AS n FROM a, (SELECT unnest(range(0, {_KEY} + 1)) AS depth) d GROUP BY ALL),
f AS (SELECT doc_id, bytes, h, min(p.depth) AS depth FROM a JOIN p ON p.p = (a.h >> ({_KEY} - p.depth)) AND p.b <= {sharding.LIMIT} GROUP BY ALL)
SELECT doc_id, bytes, CASE WHEN f.depth = 0 THEN '' ELSE right(bin((1::BIGINT << {_KEY}) | h), {_KEY})[1:f.depth] END AS shard, f.depth::BIGINT AS depth, p.b AS shard_bytes, p.n AS shard_rows, false AS oversize
FROM f JOIN p ON p.depth = f.depth AND p.p = (f.h >> ({_KEY} - f.depth))""",
    "op10_line_dedup": rf"""WITH u AS (SELECT doc_id, text, generate_subscripts(string_split(text, chr(10)), 1) AS k, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL),
w AS (SELECT doc_id, k, line, regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws,
  coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS a FROM u),
r AS (SELECT *, CASE WHEN len(ws) >= {line_dedup.MIN_WORDS} THEN row_number() OVER (PARTITION BY array_to_string(ws, ' ') ORDER BY doc_id, k) ELSE 1 END AS n,
  first_value(doc_id) OVER (PARTITION BY array_to_string(ws, ' ') ORDER BY doc_id, k) AS kept FROM w),
g AS (SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (n = 1), '') AS text, count(*)::BIGINT AS n_units, (count(*) FILTER (n > 1))::BIGINT AS n_removed,
  coalesce(string_agg(a || ':' || (a + length(line)) || ':' || kept, ',' ORDER BY k) FILTER (n > 1), '') AS removed FROM r GROUP BY doc_id)
SELECT d.doc_id, g.text, coalesce(g.n_units, 0)::BIGINT AS n_units, coalesce(g.n_removed, 0)::BIGINT AS n_removed, coalesce(g.removed, '') AS removed FROM documents d LEFT JOIN g USING (doc_id)""",
    "op12_grace_dedup": """WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, (count(*) OVER w)::BIGINT AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256 FROM t WINDOW w AS (PARTITION BY t)""",
    "op13_spelling_variants": _SPELLING_SQL,
}
