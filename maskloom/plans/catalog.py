"""Registered queries: one Spark plan and (where SQL can express it) one DuckDB
oracle per inventory key.  Every query reads the given tables or tables Spark
derives from them, over the whole table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.patterns import REGEX_REGISTRY
from ..operators import detect, jobs, mask, restore, vault
from . import duck as D
from ..session import stored
from .inputs import DUCK_CORPUS, DUCK_DOCS, SALT, corpus, documents

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

CORPUS_KEYS = ["src", "doc_id"]
CUSTOM_PATTERN = {"ORDERNO": r"订单\d+"}


def register(name: str, sql: str | None = None):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return deco


# ---------------------------------------------------------------------------
# shared Spark building blocks
# ---------------------------------------------------------------------------

def masked_corpus(spark: SparkSession, sf: str) -> DataFrame:
    return mask.mask_text(corpus(spark, sf), "text", CORPUS_KEYS, SALT)


def corpus_vault(spark: SparkSession, sf: str, masked: DataFrame | None = None) -> DataFrame:
    ents = mask.entities_of(masked if masked is not None else masked_corpus(spark, sf), CORPUS_KEYS)
    return vault.assign_tokens(ents, SALT).select("token", "original", "entity_type")


def mask_job(docs: DataFrame, keys: list[str], prior_vault: DataFrame | None = None, **options) -> tuple[DataFrame, DataFrame]:
    """:func:`jobs.mask_job` with the test salt."""
    return jobs.mask_job(docs, keys, SALT, prior_vault=prior_vault, **options)


def mask_run(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """A mask job over the corpus: what a later restore job reads."""
    return mask_job(corpus(spark, sf), CORPUS_KEYS)


# ---------------------------------------------------------------------------
# shared DuckDB building blocks
# ---------------------------------------------------------------------------

DUCK_MASKED = (
    f"(SELECT src, doc_id, text, {D.literal_fold('text', D.entity_list('text'), SALT)} AS masked "
    f"FROM {DUCK_CORPUS} c0)"
)
DUCK_VAULT = (
    f"(SELECT DISTINCT {D.token('e.ty', 'e.s', SALT)} AS token, e.s AS original, e.ty AS entity_type "
    f"FROM (SELECT unnest({D.entity_list('text')}) AS e FROM {DUCK_CORPUS} c1) u)"
)


# ---------------------------------------------------------------------------
# One type at a time
# ---------------------------------------------------------------------------

def _detect_query(entity_type: str) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return detect.detect_type(corpus(spark, sf), "text", entity_type, CORPUS_KEYS)

    return run


def _detect_sql(entity_type: str, t: str = "text", pattern_sql: str | None = None) -> str:
    lst = pattern_sql or D.spans(t, entity_type)
    return (
        f"SELECT src, doc_id, unnest(range(0, len(l)))::BIGINT AS seq, unnest(l) AS span "
        f"FROM (SELECT src, doc_id, {lst} AS l FROM {DUCK_CORPUS} c) x"
    )


for _t in REGEX_REGISTRY:
    register(f"detect_{_t.lower()}", _detect_sql(_t))(_detect_query(_t))


@register(
    "detect_custom_pattern",
    _detect_sql("ORDERNO", pattern_sql=f"regexp_extract_all(text, {D.q(CUSTOM_PATTERN['ORDERNO'])}, 0)"),
)
def q_detect_custom_pattern(spark, sf):
    reg = detect.registry_with(CUSTOM_PATTERN)
    return detect.detect_type(corpus(spark, sf), "text", "ORDERNO", CORPUS_KEYS, pattern=reg["ORDERNO"])


@register(
    "detect_regex_entities",
    f"""SELECT src, doc_id, unnest(range(0, len(l)))::BIGINT AS seq, unnest(l) AS e
    FROM (SELECT src, doc_id, {D.offset_entity_list('text')} AS l FROM {DUCK_CORPUS} c) x""",
)
def q_detect_regex_entities(spark, sf):
    return detect.detect_regex_entities(corpus(spark, sf), "text", CORPUS_KEYS)


ORACLE["detect_regex_entities"] = (
    "SELECT src, doc_id, seq, e.type AS type, e.start::INTEGER AS start, e.end::INTEGER AS \"end\", "
    "e.span AS span, 1.0::DOUBLE AS prob FROM (" + ORACLE["detect_regex_entities"] + ") y"
)


# ---------------------------------------------------------------------------
# M10 token, R2 literal mask, R1 mask_text, R3 span mask
# ---------------------------------------------------------------------------

@register(
    "strategy_token",
    f"""SELECT src, doc_id, unnest(range(0, len(l)))::BIGINT AS seq,
      unnest(list_transform(l, lambda e: e.ty)) AS type, unnest(list_transform(l, lambda e: e.s)) AS span,
      unnest(list_transform(l, lambda e: {D.token('e.ty', 'e.s', SALT)})) AS token
    FROM (SELECT src, doc_id, {D.entity_list('text')} AS l FROM {DUCK_CORPUS} c) x""",
)
def q_strategy_token(spark, sf):
    flagged = corpus(spark, sf).select(*CORPUS_KEYS, "text", C.digit_flag("text").alias("_dig"))
    arr = flagged.select(*CORPUS_KEYS, C.regex_entities("text", has_digit=F.col("_dig")).alias("l"))
    return C.posexplode_rows(arr, CORPUS_KEYS, F.col("l"), "seq", "e").select(
        *CORPUS_KEYS,
        "seq",
        F.col("e.type").alias("type"),
        F.col("e.span").alias("span"),
        C.token(F.col("e.type"), F.col("e.span"), SALT).alias("token"),
    )


@register("mask_literal", f"SELECT src, doc_id, masked FROM {DUCK_MASKED} m")
def q_mask_literal(spark, sf):
    return masked_corpus(spark, sf).select(*CORPUS_KEYS, "masked")


@register(
    "mask_text",
    f"""SELECT doc_id, {D.literal_fold('text', D.entity_list('text'), SALT)} AS masked,
      len(list_distinct({D.entity_list('text')}))::BIGINT AS n_entities FROM {DUCK_DOCS} d""",
)
def q_mask_text(spark, sf):
    m, _ = mask_job(documents(spark, sf), ["doc_id"])
    return m.select("doc_id", "masked", "n_entities")


def _duck_span_mask(t: str) -> str:
    ol = D.offset_entity_list(t)
    order = (
        f"list_sort(list_transform({ol}, lambda e, i: {{'start': e.start, 'neg_end': -e.end, 'rank': i, "
        f"'end': e.end, 'span': e.span, 'type': e.type}}))"
    )
    kept = (
        f"list_reduce({order}, lambda acc, e: CASE WHEN e.start >= acc.cut THEN "
        f"{{'cut': e.end, 'k': list_append(acc.k, {{'start': e.start, 'end': e.end, 'span': e.span, 'type': e.type}})}} "
        f"ELSE acc END, {{'cut': 0, 'k': []::STRUCT(start INTEGER, \"end\" INTEGER, span VARCHAR, type VARCHAR)[]}}).k"
    )
    rebuilt = (
        f"list_reduce(k, lambda acc, e: {{'pos': e.end, 'out': acc.out || substr({t}, acc.pos + 1, e.start - acc.pos) || "
        f"{D.token('e.type', 'e.span', SALT)}}}, {{'pos': 0, 'out': ''}})"
    )
    return kept, rebuilt


_SPAN_KEPT, _SPAN_REBUILT = _duck_span_mask("text")


@register(
    "mask_spans",
    f"""SELECT src, doc_id, CASE WHEN text IS NULL THEN NULL ELSE r.out || substr(text, r.pos + 1) END AS masked,
      len(k)::BIGINT AS n_replaced
    FROM (SELECT src, doc_id, text, k, {_SPAN_REBUILT} AS r
          FROM (SELECT src, doc_id, text, {_SPAN_KEPT} AS k FROM {DUCK_CORPUS} c) a) b""",
)
def q_mask_spans(spark, sf):
    return mask.mask_spans(corpus(spark, sf), "text", CORPUS_KEYS, SALT)


# ---------------------------------------------------------------------------
# V1–V5, V8 vault operators
# ---------------------------------------------------------------------------

_DUCK_DOC_VAULT = (
    f"(SELECT DISTINCT e.s AS original, e.ty AS entity_type "
    f"FROM (SELECT unnest({D.entity_list('text')}) AS e FROM {DUCK_DOCS} d1) u)"
)


@register(
    "assign_tokens",
    f"""SELECT v.entity_type, v.original, {D.token('v.entity_type', 'v.original', SALT)} AS token,
      (d.original IS NULL) AS is_new
    FROM (SELECT DISTINCT entity_type, original FROM {DUCK_VAULT} a) v
    LEFT JOIN {_DUCK_DOC_VAULT} d ON d.original = v.original AND d.entity_type = v.entity_type""",
)
def q_assign_tokens(spark, sf):
    # the vault of an earlier run over ``documents``; this run covers the corpus
    earlier = vault.assign_tokens(
        mask.entities_of(mask.mask_text(documents(spark, sf), "text", ["doc_id"], SALT), ["doc_id"]), SALT
    ).select("token", "original", "entity_type")
    ents = mask.entities_of(masked_corpus(spark, sf), CORPUS_KEYS)
    return vault.assign_tokens(ents, SALT, earlier)


@register(
    "vault_delta",
    f"""SELECT v.token, v.original, v.entity_type FROM {DUCK_VAULT} v
    ANTI JOIN {_DUCK_DOC_VAULT} d ON d.original = v.original AND d.entity_type = v.entity_type""",
)
def q_vault_delta(spark, sf):
    earlier = vault.assign_tokens(
        mask.entities_of(mask.mask_text(documents(spark, sf), "text", ["doc_id"], SALT), ["doc_id"]), SALT
    ).select("token", "original", "entity_type")
    ents = mask.entities_of(masked_corpus(spark, sf), CORPUS_KEYS)
    return vault.vault_delta(ents, SALT, earlier)


@register(
    "token_consistency",
    f"""SELECT e.ty AS entity_type, e.s AS original, count(DISTINCT {D.token('e.ty', 'e.s', SALT)})::BIGINT AS n_tokens
    FROM (SELECT unnest({D.entity_list('text')}) AS e FROM {DUCK_CORPUS} c) u GROUP BY 1, 2""",
)
def q_token_consistency(spark, sf):
    occ = q_strategy_token(spark, sf)  # one token per occurrence, in every text
    return vault.token_consistency(occ.select(F.col("type").alias("entity_type"), F.col("span").alias("original"), "token"))


@register(
    "token_collisions",
    f"""SELECT token, count(*)::BIGINT AS n_rows, count(DISTINCT (original, entity_type))::BIGINT AS n_entities
    FROM {DUCK_VAULT} v GROUP BY token HAVING count(DISTINCT (original, entity_type)) > 1""",
)
def q_token_collisions(spark, sf):
    return vault.token_collisions(corpus_vault(spark, sf)).select(
        "token", F.col("n_rows").cast("long").alias("n_rows"), F.col("n_entities").cast("long").alias("n_entities")
    )


#: Digits of a token in the collision queries: few enough that values collide.
SHORT_HEX = 5
_DUCK_SHORT = f"SELECT DISTINCT original, entity_type, {D.token('entity_type', 'original', SALT, SHORT_HEX)} AS token FROM {DUCK_VAULT} v"


def short_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """Every distinct entity of the corpus with a token of ``SHORT_HEX`` digits."""
    new = corpus_vault(spark, sf).select("original", "entity_type").distinct()
    return new.withColumn("token", C.token("entity_type", "original", SALT, SHORT_HEX))


@register(
    "token_collisions_short",
    f"SELECT token, count(*)::BIGINT AS n_rows, count(*)::BIGINT AS n_entities FROM ({_DUCK_SHORT}) s GROUP BY token HAVING count(*) > 1",
)
def q_token_collisions_short(spark, sf):
    """The audit where tokens do collide."""
    return vault.token_collisions(short_tokens(spark, sf)).withColumn("n_rows", F.col("n_rows").cast("long")).withColumn(
        "n_entities", F.col("n_entities").cast("long")
    )


def _duck_rounds(rounds: int) -> str:
    """The rounds of :func:`vault.resolve_collisions`, unrolled; entities of ``documents`` are the earlier vault."""
    old = f"SELECT token, original, entity_type FROM ({_DUCK_SHORT}) a SEMI JOIN {_DUCK_DOC_VAULT} d ON a.original = d.original AND a.entity_type = d.entity_type"
    ctes = [
        f"old AS MATERIALIZED (SELECT * FROM ({old}) o QUALIFY row_number() OVER (PARTITION BY token ORDER BY entity_type, original) = 1)",
        f"new AS MATERIALIZED (SELECT s.* FROM ({_DUCK_SHORT}) s ANTI JOIN old ON s.original = old.original AND s.entity_type = old.entity_type)",
        "contested AS MATERIALIZED (SELECT token FROM new GROUP BY token HAVING count(*) > 1 UNION SELECT new.token FROM new SEMI JOIN old ON new.token = old.token)",
        "win0 AS MATERIALIZED (SELECT token, original, entity_type FROM new ANTI JOIN contested ON new.token = contested.token)",
        "todo1 AS MATERIALIZED (SELECT token, original, entity_type FROM new SEMI JOIN contested ON new.token = contested.token)",
        "taken1 AS MATERIALIZED (SELECT token FROM old UNION ALL SELECT token FROM win0)",
    ]
    for k in range(1, rounds + 1):
        ctes += [
            f"win{k} AS MATERIALIZED (SELECT * FROM todo{k} ANTI JOIN taken{k} ON todo{k}.token = taken{k}.token QUALIFY row_number() OVER (PARTITION BY token ORDER BY entity_type, original) = 1)",
            f"todo{k + 1} AS MATERIALIZED (SELECT {D.token('entity_type', 'original', SALT, SHORT_HEX, k)} AS token, original, entity_type FROM todo{k} ANTI JOIN win{k} ON todo{k}.original = win{k}.original AND todo{k}.entity_type = win{k}.entity_type)",
            f"taken{k + 1} AS MATERIALIZED (SELECT token FROM taken{k} UNION ALL SELECT token FROM win{k})",
        ]
    return "WITH " + ", ".join(ctes) + " ".join([" SELECT * FROM win0", *(f"UNION ALL SELECT * FROM win{k}" for k in range(1, rounds + 1))])


@register("resolve_collisions", _duck_rounds(8))
def q_resolve_collisions(spark, sf):
    """New entities of the corpus against the vault of an earlier run over ``documents``."""
    every = stored(short_tokens(spark, sf), "short_tokens")
    seen = mask.entities_of(mask.mask_text(documents(spark, sf), "text", ["doc_id"], SALT), ["doc_id"])
    known = every.join(vault.distinct_entities(seen), ["original", "entity_type"], "left_semi")
    first = F.min_by(F.struct("original", "entity_type"), F.struct("entity_type", "original"))
    old = stored(known.groupBy("token").agg(first.alias("e")).select("token", "e.original", "e.entity_type"), "short_vault")
    new = every.join(old, ["original", "entity_type"], "left_anti")
    return vault.resolve_collisions(new, SALT, old, hex_len=SHORT_HEX)


# ---------------------------------------------------------------------------
# U1, U2, U6, V4, V5 restore operators
# ---------------------------------------------------------------------------

@register(
    "extract_tokens",
    f"""SELECT src, doc_id, unnest(range(0, len(l)))::BIGINT AS pos, unnest(l) AS token
    FROM (SELECT src, doc_id, {D.token_list('masked')} AS l FROM {DUCK_MASKED} m) x""",
)
def q_extract_tokens(spark, sf):
    m, _ = mask_run(spark, sf)
    return restore.extract_tokens(m, "masked", CORPUS_KEYS)


_DUCK_RESTORED = f"""(WITH m AS {DUCK_MASKED}, v AS {DUCK_VAULT},
  t AS (SELECT src, doc_id, unnest(list_distinct({D.token_list('masked')})) AS token FROM m),
  r AS (SELECT t.src, t.doc_id, list({{'s': v.token, 'ty': v.original}}) AS pairs FROM t JOIN v ON v.token = t.token GROUP BY ALL)
  SELECT m.src, m.doc_id, m.text,
    CASE WHEN r.pairs IS NULL THEN m.masked
         ELSE list_reduce(r.pairs, lambda acc, e: {{'s': replace(acc.s, e.s, e.ty), 'ty': ''}}, {{'s': m.masked, 'ty': ''}}).s
    END AS restored
  FROM m LEFT JOIN r ON r.src = m.src AND r.doc_id = m.doc_id)"""


@register("unmask_text", f"SELECT src, doc_id, restored FROM {_DUCK_RESTORED} x")
def q_unmask_text(spark, sf):
    m, v = mask_run(spark, sf)
    return restore.unmask_text(m, "masked", CORPUS_KEYS, v)


@register(
    "round_trip",
    f"""SELECT count(*)::BIGINT AS n_texts, sum(CASE WHEN restored IS NOT DISTINCT FROM text THEN 1 ELSE 0 END)::BIGINT AS n_equal
    FROM {_DUCK_RESTORED} x""",
)
def q_round_trip(spark, sf):
    m, v = mask_run(spark, sf)
    restored = restore.unmask_text(m, "masked", CORPUS_KEYS, v)
    return restore.round_trip_summary(restore.round_trip_flags(corpus(spark, sf), restored, "text", CORPUS_KEYS))


@register(
    "masked_entities",
    f"""WITH m AS {DUCK_MASKED}, v AS {DUCK_VAULT},
    t AS (SELECT src, doc_id, unnest(range(0, len(l)))::BIGINT AS pos, unnest(l) AS token
          FROM (SELECT src, doc_id, {D.token_list('masked')} AS l FROM m) a)
    SELECT t.src, t.doc_id, min(t.pos)::BIGINT AS first_pos, t.token, v.original, v.entity_type
    FROM t JOIN v ON v.token = t.token GROUP BY t.src, t.doc_id, t.token, v.original, v.entity_type""",
)
def q_masked_entities(spark, sf):
    m, v = mask_run(spark, sf)
    return vault.masked_entities(m, "masked", CORPUS_KEYS, v)


@register(
    "token_coverage",
    f"""WITH m AS {DUCK_MASKED}, v AS (SELECT DISTINCT token FROM {DUCK_VAULT} v0),
    t AS (SELECT src, doc_id, unnest({D.token_list('masked')}) AS token FROM m)
    SELECT t.src, t.doc_id, count(t.token)::BIGINT AS n_found, count(v.token)::BIGINT AS n_resolved
    FROM t LEFT JOIN v ON v.token = t.token GROUP BY t.src, t.doc_id""",
)
def q_token_coverage(spark, sf):
    m, v = mask_run(spark, sf)
    return vault.token_coverage(m, "masked", CORPUS_KEYS, v)


# ---------------------------------------------------------------------------
# Chunking and the model-based detection data path
# ---------------------------------------------------------------------------

from ..functions.patterns import chunk_pattern  # noqa: E402
from ..operators import ner, scoring  # noqa: E402
from . import standin  # noqa: E402

NER_ALLOWED = ["PER", "LOC", "ORG", "PHONE", "ID", "BANK", "EMAIL", "IP", "TIME"]


def doc_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return ner.chunk_text(documents(spark, sf), "text", ["doc_id"])


def doc_responses(spark: SparkSession, sf: str) -> DataFrame:
    """Model responses per chunk, derived from the chunks by the stand-in rule."""
    return doc_chunks(spark, sf).select(
        "doc_id", "chunk_idx", "offset", "chunk", standin.spark_response(F.col("chunk")).alias("response")
    )


def doc_ner_entities(spark: SparkSession, sf: str) -> DataFrame:
    return ner.batch_entities(doc_responses(spark, sf), ["doc_id"])


_CHUNK_RE = chunk_pattern()
DUCK_CHUNKS = f"""(SELECT doc_id, unnest(range(0, len(l)))::BIGINT AS chunk_idx, unnest(l) AS chunk,
    unnest(list_transform(l, lambda x, i: coalesce(list_sum(list_transform(l[1:i-1], lambda y: length(y))), 0)))::BIGINT AS "offset"
  FROM (SELECT doc_id, regexp_extract_all(text, {D.q(_CHUNK_RE)}, 0) AS l FROM documents) a)"""
DUCK_RESPONSES = f"""(SELECT doc_id, chunk_idx, "offset", chunk, {standin.duck_response('chunk')} AS response FROM {DUCK_CHUNKS} c)"""
_BODY = r"CASE WHEN regexp_matches(response, '\[[\s\S]*\]') THEN regexp_extract(response, '\[[\s\S]*\]', 0) ELSE response END"
DUCK_PARSED = f"""(SELECT doc_id, chunk_idx, "offset", chunk, unnest(range(0, len(l)))::BIGINT AS ent_idx, unnest(l) AS j
  FROM (SELECT doc_id, chunk_idx, "offset", chunk,
          list_filter(CASE WHEN json_valid(body) AND ltrim(body) LIKE '[%' THEN from_json(body, '["JSON"]') END,
                      lambda j: json_type(j) = 'OBJECT' AND json_exists(j, '$.span') AND json_exists(j, '$.type')) AS l
        FROM (SELECT doc_id, chunk_idx, "offset", chunk, {_BODY} AS body FROM {DUCK_RESPONSES} r) b) c)"""
_HAS_SE = "(json_exists(j, '$.start') AND json_exists(j, '$.end'))"
DUCK_FIELDS = f"""(SELECT doc_id, chunk_idx, "offset", chunk, ent_idx,
    json_extract_string(j, '$.span') AS span, json_extract_string(j, '$.type') AS type,
    CASE WHEN {_HAS_SE} THEN json_extract(j, '$.start')::INTEGER END AS start,
    CASE WHEN {_HAS_SE} THEN json_extract(j, '$.end')::INTEGER END AS "end",
    CASE WHEN json_exists(j, '$.prob') THEN json_extract(j, '$.prob')::DOUBLE END AS prob,
    json_exists(j, '$.prob') AS has_prob, NOT {_HAS_SE} AS miss
  FROM {DUCK_PARSED} p)"""
DUCK_FILLED = f"""(SELECT doc_id, chunk_idx, "offset", chunk, ent_idx, span, type,
    CASE WHEN miss THEN instr(chunk, span) - 1 ELSE start END::INTEGER AS start,
    CASE WHEN miss THEN instr(chunk, span) - 1 + length(span) ELSE "end" END::INTEGER AS "end",
    CASE WHEN has_prob THEN prob ELSE 0.95 END AS prob
  FROM {DUCK_FIELDS} f WHERE NOT miss OR instr(chunk, span) > 0)"""
DUCK_REBASED = f"""(SELECT doc_id, chunk_idx, ent_idx, span, type, (start + "offset")::INTEGER AS start,
    ("end" + "offset")::INTEGER AS "end", prob,
    (row_number() OVER (PARTITION BY doc_id ORDER BY chunk_idx, ent_idx) - 1)::BIGINT AS seq
  FROM {DUCK_FILLED} f)"""
DUCK_DEDUP = f"""(SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY first_seq) - 1)::BIGINT AS seq,
    type, start, "end", span, prob
  FROM (SELECT *, min(seq) OVER (PARTITION BY doc_id, span, type) AS first_seq,
               row_number() OVER (PARTITION BY doc_id, span, type ORDER BY prob DESC, seq) AS rk
        FROM {DUCK_REBASED} r) g WHERE rk = 1)"""


@register(
    "chunk_text",
    f"SELECT doc_id, chunk_idx, chunk, length(chunk)::BIGINT AS n_chars FROM {DUCK_CHUNKS} c",
)
def q_chunk_text(spark, sf):
    return doc_chunks(spark, sf).select("doc_id", "chunk_idx", "chunk", "n_chars")


@register("chunk_offsets", f'SELECT doc_id, chunk_idx, "offset" FROM {DUCK_CHUNKS} c')
def q_chunk_offsets(spark, sf):
    return doc_chunks(spark, sf).select("doc_id", "chunk_idx", "offset")


@register(
    "build_requests",
    f"""SELECT doc_id, chunk_idx, 0::BIGINT AS msg_idx, 'system' AS role, {D.q(ner.SYSTEM_PROMPT)} AS content FROM {DUCK_CHUNKS} a
    UNION ALL SELECT doc_id, chunk_idx, 1::BIGINT AS msg_idx, 'user' AS role,
      replace({D.q(ner.USER_PROMPT)}, '{{text}}', chunk) AS content FROM {DUCK_CHUNKS} b""",
)
def q_build_requests(spark, sf):
    req = ner.build_requests(doc_chunks(spark, sf), ["doc_id", "chunk_idx"])
    return C.posexplode_rows(req, ["doc_id", "chunk_idx"], F.col("messages"), "msg_idx", "m").select(
        "doc_id", "chunk_idx", "msg_idx", F.col("m.role").alias("role"), F.col("m.content").alias("content")
    )


@register("score_chunks", f'SELECT doc_id, chunk_idx, "offset", chunk, response, NULL::VARCHAR AS error FROM {DUCK_RESPONSES} r')
def q_score_chunks(spark, sf):
    """The Arrow-batched model hook over every chunk (stand-in model)."""
    return ner.score_chunks(doc_chunks(spark, sf), standin.python_model, ["doc_id", "chunk_idx"])


@register("score_chunks_stored", f'SELECT doc_id, chunk_idx, "offset", chunk, response, NULL::VARCHAR AS error FROM {DUCK_RESPONSES} r')
def q_score_chunks_stored(spark, sf):
    """Scoring over a store that an earlier job left with the results of the first chunk of each document."""
    chunks, store = doc_chunks(spark, sf), scratch_path(spark, "scores")
    scoring.score_missing(chunks.where("chunk_idx = 0"), standin.python_model, store, "standin")
    return scoring.score_chunks_stored(chunks, standin.python_model, ["doc_id", "chunk_idx"], store, "standin")


@register(
    "parse_responses",
    f"""SELECT doc_id, chunk_idx, ent_idx, span, type, start, "end", prob, has_prob FROM {DUCK_FIELDS} f""",
)
def q_parse_responses(spark, sf):
    return ner.parse_responses(doc_responses(spark, sf), ["doc_id", "chunk_idx"]).select(
        "doc_id", "chunk_idx", "ent_idx", "span", "type", "start", "end", "prob", "has_prob"
    )


@register("fill_offsets", f'SELECT doc_id, chunk_idx, ent_idx, span, type, start, "end" FROM {DUCK_FILLED} f')
def q_fill_offsets(spark, sf):
    parsed = ner.parse_responses(doc_responses(spark, sf), ["doc_id", "chunk_idx"])
    return ner.fill_offsets(parsed).select("doc_id", "chunk_idx", "ent_idx", "span", "type", "start", "end")


@register("default_prob", f"SELECT doc_id, chunk_idx, ent_idx, span, prob FROM {DUCK_FILLED} f")
def q_default_prob(spark, sf):
    parsed = ner.parse_responses(doc_responses(spark, sf), ["doc_id", "chunk_idx"])
    return ner.default_prob(ner.fill_offsets(parsed)).select("doc_id", "chunk_idx", "ent_idx", "span", "prob")


@register("rebase_offsets", f'SELECT doc_id, chunk_idx, ent_idx, span, start, "end" FROM {DUCK_REBASED} r')
def q_rebase_offsets(spark, sf):
    parsed = ner.parse_responses(doc_responses(spark, sf), ["doc_id", "chunk_idx"])
    return ner.rebase_offsets(ner.default_prob(ner.fill_offsets(parsed))).select(
        "doc_id", "chunk_idx", "ent_idx", "span", "start", "end"
    )


@register("dedup_entities", f'SELECT doc_id, seq, type, start, "end", span, prob FROM {DUCK_DEDUP} d')
def q_dedup_entities(spark, sf):
    return doc_ner_entities(spark, sf)


@register(
    "batch_entities",
    f"""SELECT d.doc_id, count(e.span)::BIGINT AS n_entities FROM documents d LEFT JOIN {DUCK_DEDUP} e ON e.doc_id = d.doc_id
    GROUP BY d.doc_id""",
)
def q_batch_entities(spark, sf):
    ents = doc_ner_entities(spark, sf).groupBy("doc_id").agg(F.count("*").cast("long").alias("n"))
    docs = documents(spark, sf).select("doc_id")
    return docs.join(ents, "doc_id", "left").select("doc_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_entities"))


@register(
    "corpus_entities",
    f"""SELECT span, type, doc_id AS first_doc_id, start, "end", best_prob AS prob, n_occurrences
    FROM (SELECT *, row_number() OVER (PARTITION BY span, type ORDER BY prob DESC, doc_id, seq) AS rk,
                 max(prob) OVER (PARTITION BY span, type) AS best_prob,
                 count(*) OVER (PARTITION BY span, type)::BIGINT AS n_occurrences
          FROM {DUCK_DEDUP} d) x WHERE rk = 1""",
)
def q_corpus_entities(spark, sf):
    return ner.corpus_entities(doc_ner_entities(spark, sf), ["doc_id"])


_DUCK_ALIAS = "CASE " + " ".join(
    f"WHEN type = {D.q(k)} THEN {D.q(v)}" for k, v in detect.TYPE_ALIASES.items()
) + " ELSE type END"
DUCK_NER_FILTERED = f"""(SELECT doc_id, seq, {_DUCK_ALIAS} AS type, start, "end", span, prob FROM {DUCK_DEDUP} d
  WHERE ({_DUCK_ALIAS}) IN ({', '.join(D.q(t) for t in NER_ALLOWED)}))"""


@register("filter_types", f'SELECT doc_id, seq, type, start, "end", span, prob FROM {DUCK_NER_FILTERED} f')
def q_filter_types(spark, sf):
    return detect.filter_types(doc_ner_entities(spark, sf), NER_ALLOWED)


DUCK_DOC_REGEX = f"""(SELECT doc_id, unnest(range(0, len(l)))::BIGINT AS seq, unnest(l) AS e
  FROM (SELECT doc_id, {D.offset_entity_list('text')} AS l FROM documents) x)"""


@register(
    "merge_detections",
    f"""SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY src, seq) - 1)::BIGINT AS seq,
      type, start, "end", span, prob
    FROM (SELECT doc_id, 0 AS src, seq, type, start, "end", span, prob FROM {DUCK_NER_FILTERED} n
          UNION ALL SELECT doc_id, 1 AS src, seq, e.type, e.start::INTEGER, e.end::INTEGER, e.span, 1.0::DOUBLE FROM {DUCK_DOC_REGEX} r) u""",
)
def q_merge_detections(spark, sf):
    model = detect.filter_types(doc_ner_entities(spark, sf), NER_ALLOWED)
    regex = detect.detect_regex_entities(documents(spark, sf), "text", ["doc_id"])
    return detect.merge_detections(model, regex, ["doc_id"])


# ---------------------------------------------------------------------------
# R1, U6 with model entities: chunk → score → parse → alias → merge → mask → restore
# ---------------------------------------------------------------------------


def model_mask_run(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """A mask job over the documents whose entities come from the model hook and the patterns."""
    docs = documents(spark, sf)
    scored = stored(ner.score_chunks(ner.chunk_text(docs, "text", ["doc_id"]), standin.python_model, ["doc_id", "chunk_idx"]), "scored_chunks")
    admitted, _ = jobs.admit_scored(docs, ["doc_id"], scored)
    model = detect.filter_types(ner.batch_entities(scored, ["doc_id"]), NER_ALLOWED)
    return mask_job(admitted, ["doc_id"], model_entities=model)


DUCK_MODEL_PAIRS = f"""(SELECT d.doc_id, d.text, list_concat(coalesce(m.l, []), coalesce({D.entity_list('d.text')}, [])) AS l FROM documents d
  LEFT JOIN (SELECT doc_id, list({{'s': span, 'ty': type}} ORDER BY seq) AS l FROM {DUCK_NER_FILTERED} f GROUP BY doc_id) m USING (doc_id))"""
DUCK_MODEL_MASKED = f"""(SELECT doc_id, text, l, CASE WHEN len(l) = 0 THEN text ELSE {D.placeholder_fold('text', 'r')} END AS masked
  FROM (SELECT *, list_transform(l, lambda e: {{'s': e.s, 'r': {D.token('e.ty', 'e.s', SALT)}}}) AS r FROM {DUCK_MODEL_PAIRS} p) x)"""


@register("mask_text_model", f"SELECT doc_id, masked, len(list_distinct(l))::BIGINT AS n_entities FROM {DUCK_MODEL_MASKED} m")
def q_mask_text_model(spark, sf):
    masked, _ = model_mask_run(spark, sf)
    return masked.select("doc_id", "masked", "n_entities")


@register(
    "round_trip_model",
    """SELECT count(*)::BIGINT AS n_texts, count(*)::BIGINT AS n_equal FROM documents""",
)
def q_round_trip_model(spark, sf):
    masked, v = model_mask_run(spark, sf)
    restored = restore.unmask_text(masked, "masked", ["doc_id"], v)
    return restore.round_trip_summary(restore.round_trip_flags(documents(spark, sf), restored, "text", ["doc_id"]))


# ---------------------------------------------------------------------------
# Content lists and Markdown
# ---------------------------------------------------------------------------

from ..functions.patterns import PARAGRAPH_SEP_RE  # noqa: E402
from ..operators import documents as docops  # noqa: E402
from .inputs import DUCK_MARKDOWN, content_items, markdown_docs  # noqa: E402

ITEM_KEYS = ["doc_id", "item_idx"]


def items_mask_job(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(original items, stored masked items, stored vault) — one content-list mask job."""
    items = content_items(spark, sf)
    return items, *jobs.mask_items_job(items, ITEM_KEYS, SALT)


def markdown_mask_job(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(stored masked Markdown, stored vault) — one Markdown mask job."""
    return jobs.mask_markdown_job(markdown_docs(spark, sf), ["doc_id"], SALT)


DUCK_ITEMS = """(SELECT doc_id, (i - 1)::INTEGER AS item_idx, CASE WHEN i = 1 THEN 'title' ELSE 'text' END AS type,
    CASE WHEN i = 1 THEN NULL ELSE line END AS text, CASE WHEN i = 1 THEN line END AS title, 1 AS page
  FROM (SELECT doc_id, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS i
        FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents) a) b)"""
DUCK_MASKED_ITEMS = f"""(SELECT doc_id, item_idx, type,
    {D.literal_fold('text', D.entity_list('text'), SALT)} AS text,
    {D.literal_fold('title', D.entity_list('title'), SALT)} AS title, page
  FROM {DUCK_ITEMS} i)"""


@register("mask_document", f"SELECT doc_id, item_idx, type, text, title, page FROM {DUCK_MASKED_ITEMS} m")
def q_mask_document(spark, sf):
    _, m, _ = items_mask_job(spark, sf)
    return m


_DUCK_DOC_RANK = "CASE ty " + " ".join(f"WHEN {D.q(t)} THEN {i}" for i, t in enumerate(REGEX_REGISTRY)) + " END"
_DUCK_DOC_FOUND = f"""SELECT doc_id, s, ty, min(({_DUCK_DOC_RANK}, item_idx, field, seq)) AS place FROM (
    SELECT doc_id, item_idx, field, unnest(range(0, len(l))) AS seq, unnest(list_transform(l, lambda e: e.s)) AS s, unnest(list_transform(l, lambda e: e.ty)) AS ty
    FROM (SELECT doc_id, item_idx, 0 AS field, {D.entity_list('text')} AS l FROM {DUCK_ITEMS} a WHERE text IS NOT NULL
      UNION ALL SELECT doc_id, item_idx, 1, {D.entity_list('title')} FROM {DUCK_ITEMS} b WHERE title IS NOT NULL) u) w GROUP BY doc_id, s, ty"""
_DUCK_DOC_LISTS = f"""SELECT doc_id, list({{'s': s, 'r': {D.token('ty', 's', SALT)}}} ORDER BY place) AS pairs FROM ({_DUCK_DOC_FOUND}) f GROUP BY doc_id"""


@register(
    "mask_document_scope",
    f"""SELECT i.doc_id, item_idx, type, CASE WHEN pairs IS NULL THEN text ELSE {D.placeholder_fold('text', 'pairs')} END AS text,
      CASE WHEN pairs IS NULL THEN title ELSE {D.placeholder_fold('title', 'pairs')} END AS title, page
    FROM {DUCK_ITEMS} i LEFT JOIN ({_DUCK_DOC_LISTS}) l ON l.doc_id = i.doc_id""",
)
def q_mask_document_scope(spark, sf):
    """An entity found in one item of a document is masked in all its items."""
    masked, _ = jobs.mask_items_job(content_items(spark, sf), ITEM_KEYS, SALT, scope="document")
    return masked


@register(
    "document_text",
    f"""SELECT doc_id, string_agg(
        CASE WHEN coalesce(length(text), 0) > 0 THEN text || chr(10) || chr(10) ELSE '' END ||
        CASE WHEN coalesce(length(title), 0) > 0 THEN title || chr(10) || chr(10) ELSE '' END, '' ORDER BY item_idx) AS all_text
    FROM {DUCK_ITEMS} i GROUP BY doc_id""",
)
def q_document_text(spark, sf):
    return docops.document_text(content_items(spark, sf))


@register(
    "render_markdown",
    f"""SELECT doc_id, string_agg(CASE WHEN type = 'title' THEN '# ' || coalesce(title, '') || chr(10) || chr(10)
        ELSE coalesce(text, '') || chr(10) || chr(10) END, '' ORDER BY item_idx) AS markdown
    FROM {DUCK_MASKED_ITEMS} m GROUP BY doc_id""",
)
def q_render_markdown(spark, sf):
    _, m, _ = items_mask_job(spark, sf)
    return docops.render_markdown(m)


@register("unmask_document", f"SELECT doc_id, item_idx, type, text, title, page FROM {DUCK_ITEMS} i")
def q_unmask_document(spark, sf):
    _, m, v = items_mask_job(spark, sf)
    return docops.unmask_document(m, v)


@register(
    "paragraphs",
    f"""SELECT doc_id, para_idx, text FROM (
      SELECT doc_id, unnest(range(0, len(l)))::BIGINT AS para_idx, unnest(l) AS text
      FROM (SELECT doc_id, string_split_regex(md, {D.q(PARAGRAPH_SEP_RE)}) AS l FROM {DUCK_MARKDOWN} m) a) b
    WHERE regexp_matches(text, '\\S')""",
)
def q_paragraphs(spark, sf):
    return docops.paragraphs(markdown_docs(spark, sf), "md", ["doc_id"])


@register(
    "mask_markdown",
    f"""SELECT doc_id, CASE WHEN md IS NULL THEN NULL ELSE array_to_string(list_transform(
        string_split_regex(md, {D.q(PARAGRAPH_SEP_RE)}),
        lambda p, i: {D.literal_fold('p', D.entity_list('p'), SALT)} ||
                     coalesce(regexp_extract_all(md, {D.q(PARAGRAPH_SEP_RE)}, 0)[i], '')), '') END AS masked
    FROM {DUCK_MARKDOWN} m""",
)
def q_mask_markdown(spark, sf):
    m, _ = markdown_mask_job(spark, sf)
    return m


@register("unmask_markdown", f"SELECT doc_id, md AS restored FROM {DUCK_MARKDOWN} m")
def q_unmask_markdown(spark, sf):
    m, v = markdown_mask_job(spark, sf)
    return docops.unmask_markdown(m, "masked", ["doc_id"], v)


# ---------------------------------------------------------------------------
# strategies
# ---------------------------------------------------------------------------

from ..functions.patterns import NUMBERED_TYPES, TYPE_TEMPLATES  # noqa: E402
from ..operators import strategies as S  # noqa: E402
from .inputs import DUCK_PII, pii_texts, table  # noqa: E402

OVERRIDE_TEMPLATES = {"PER": "张某", "BANK": "卡号"}
_NUM_SQL = ", ".join(D.q(t) for t in NUMBERED_TYPES)


def _strategy_sql(repl_sql: str) -> str:
    """Corpus masked with a per-entity replacement ``repl_sql`` over e.s / e.ty."""
    pairs = f"list_transform({D.entity_list('text')}, lambda e: {{'s': e.s, 'r': {repl_sql}}})"
    return f"SELECT src, doc_id, {D.placeholder_fold('text', pairs)} AS masked FROM {DUCK_CORPUS} c"


def _strategy_query(strategy: S.Strategy):
    def run(spark, sf):
        return S.mask_with_strategy(corpus(spark, sf), "text", CORPUS_KEYS, strategy)

    return run


register("strategy_replacement", _strategy_sql("'***'"))(_strategy_query(S.replacement()))
register("strategy_hash", _strategy_sql("substr(md5(e.s || ''), 1, 8)"))(_strategy_query(S.hashed()))
register("strategy_type", _strategy_sql(D.template("e.ty", TYPE_TEMPLATES)))(_strategy_query(S.type_based()))
register(
    "strategy_type_override", _strategy_sql(D.template("e.ty", S.templates_with(OVERRIDE_TEMPLATES)))
)(_strategy_query(S.type_based(S.templates_with(OVERRIDE_TEMPLATES))))
_DISPATCH = S.dispatch(
    {"PHONE": S.hashed("k", 6), "BANK": S.replacement("****"), "EMAIL": S.type_based()}, S.token_strategy(SALT)
)
register(
    "strategy_dispatch",
    _strategy_sql(
        "CASE WHEN e.ty = 'PHONE' THEN substr(md5(e.s || 'k'), 1, 6) WHEN e.ty = 'BANK' THEN '****' "
        f"WHEN e.ty = 'EMAIL' THEN {D.template('e.ty', TYPE_TEMPLATES)} ELSE {D.token('e.ty', 'e.s', SALT)} END"
    ),
)(_strategy_query(_DISPATCH))


def corpus_occurrences(spark: SparkSession, sf: str) -> DataFrame:
    """Entity occurrences in corpus order: documents (model + regex, merged)
    then the order records (regex).  ``src, doc_id, seq, span, type``."""
    docs = q_merge_detections(spark, sf).select(F.lit("doc").alias("src"), "doc_id", "seq", "span", "type")
    pii = pii_texts(spark, sf)
    flagged = pii.select("doc_id", "text", C.digit_flag("text").alias("_dig"))
    arr = flagged.select("doc_id", C.regex_entities("text", has_digit=F.col("_dig")).alias("l"))
    ords = C.posexplode_rows(arr, ["doc_id"], F.col("l"), "seq", "e").select(
        F.lit("ord").alias("src"), "doc_id", "seq", F.col("e.span").alias("span"), F.col("e.type").alias("type")
    )
    # consumed twice (mapping, then per occurrence): detect once, read twice
    return stored(docs.unionByName(ords), "occurrences")


def custom_dictionary(spark: SparkSession, sf: str) -> DataFrame:
    """Custom words from ``customer``: each customer's mail address → a label."""
    c = table(spark, sf, "customer")
    return c.select(
        F.concat(F.lit("u"), F.col("c_custkey").cast("string"), F.lit("@mail.example.com")).alias("original"),
        F.concat(F.lit("客户"), F.col("c_custkey").cast("string")).alias("replacement"),
        F.col("c_custkey").alias("priority"),
    )


DUCK_OCC = f"""(SELECT src, doc_id, seq, span, type, row_number() OVER (ORDER BY src, doc_id, seq) AS gpos FROM (
    SELECT 'doc' AS src, doc_id, seq, span, type FROM ({ORACLE['merge_detections']}) m
    UNION ALL SELECT 'ord' AS src, doc_id, unnest(range(0, len(l)))::BIGINT AS seq,
      unnest(list_transform(l, lambda e: e.s)) AS span, unnest(list_transform(l, lambda e: e.ty)) AS type
    FROM (SELECT doc_id, {D.entity_list('text')} AS l FROM {DUCK_PII} p) x) u)"""
DUCK_CW = """(SELECT 'u' || CAST(c_custkey AS VARCHAR) || '@mail.example.com' AS original,
    '客户' || CAST(c_custkey AS VARCHAR) AS replacement, c_custkey AS priority FROM customer)"""
DUCK_CTX_FIRST = f"""(SELECT *, row_number() OVER (PARTITION BY ftype ORDER BY fpos) AS n FROM (
    SELECT span, min(gpos) AS fpos, arg_min(type, gpos) AS ftype FROM {DUCK_OCC} o WHERE type IN ({_NUM_SQL}) GROUP BY span) f)"""


@register(
    "strategy_context",
    f"""SELECT o.src, o.doc_id, o.seq, o.span, o.type,
      CASE WHEN n.fpos IS NOT NULL AND o.gpos >= n.fpos THEN {D.template('n.ftype', TYPE_TEMPLATES)} || ' ' || CAST(n.n AS VARCHAR)
           ELSE {D.template('o.type', TYPE_TEMPLATES)} END AS masked
    FROM {DUCK_OCC} o LEFT JOIN {DUCK_CTX_FIRST} n ON n.span = o.span""",
)
def q_strategy_context(spark, sf):
    return S.context_masks(corpus_occurrences(spark, sf), CORPUS_KEYS)


@register(
    "rebuild_counters",
    f"SELECT ftype AS entity_type, max(n)::BIGINT AS counter FROM {DUCK_CTX_FIRST} n GROUP BY ftype",
)
def q_rebuild_counters(spark, sf):
    mapping = S.context_mapping(corpus_occurrences(spark, sf), CORPUS_KEYS)
    return S.rebuild_counters(stored(mapping.select("original", "entity_type", "mask_text"), "context_mapping"))


@register("strategy_custom")
def q_strategy_custom(spark, sf):
    return S.custom_masks(corpus_occurrences(spark, sf), custom_dictionary(spark, sf)).select(
        *CORPUS_KEYS, "seq", "span", "type", "masked"
    )


DUCK_HYBRID = f"""(WITH f AS (SELECT span, min(gpos) AS fpos, arg_min(type, gpos) AS ftype FROM {DUCK_OCC} o GROUP BY span),
  g AS (SELECT * FROM f WHERE span NOT IN (SELECT original FROM {DUCK_CW} c)),
  nn AS (SELECT *, row_number() OVER (PARTITION BY ftype ORDER BY fpos) AS n FROM g WHERE ftype IN ({_NUM_SQL}))
  SELECT original, NULL::VARCHAR AS entity_type, NULL::BIGINT AS ordinal, replacement AS mask_text, true AS is_custom,
         0 AS k1, '' AS k2, priority AS k3, 0::BIGINT AS k4 FROM {DUCK_CW} c
  UNION ALL SELECT span, ftype, n::BIGINT, {D.template('ftype', TYPE_TEMPLATES)} || ' ' || CAST(n AS VARCHAR), false,
         1, '', fpos, 0 FROM nn
  UNION ALL SELECT span, ftype, NULL::BIGINT, {D.template('ftype', TYPE_TEMPLATES)}, false, 1, '', fpos, 0
    FROM g WHERE ftype NOT IN ({_NUM_SQL}))"""


def hybrid_table(spark: SparkSession, sf: str) -> DataFrame:
    return S.hybrid_mapping(corpus_occurrences(spark, sf), CORPUS_KEYS, custom_dictionary(spark, sf))


@register(
    "strategy_hybrid",
    f"SELECT original, entity_type, ordinal, mask_text, is_custom FROM {DUCK_HYBRID} h",
)
def q_strategy_hybrid(spark, sf):
    return hybrid_table(spark, sf).select("original", "entity_type", "ordinal", "mask_text", "is_custom")


# An earlier run over the English documents has stored its mapping; this run goes on over the whole corpus.
EARLIER_LANG = "en"


def earlier_occurrences(spark: SparkSession, sf: str, occ: DataFrame) -> DataFrame:
    ids = table(spark, sf, "documents").where(F.col("lang") == EARLIER_LANG).select(F.lit("doc").alias("src"), "doc_id")
    return occ.join(ids.hint("merge"), CORPUS_KEYS, "left_semi")  # as many ids as documents: never through the driver


DUCK_EARLIER = f"""(SELECT o.* FROM {DUCK_OCC} o JOIN documents d ON o.src = 'doc' AND o.doc_id = d.doc_id AND d.lang = {D.q(EARLIER_LANG)})"""


def _duck_incremental(occ_filter: str, custom: bool) -> str:
    """``original, ftype, fpos, n, run``: texts numbered by the earlier run (0), then by this one (1)."""
    words = f"span NOT IN (SELECT original FROM {DUCK_CW} c)" if custom else "true"
    first = f"SELECT span, min(gpos) AS fpos, arg_min(type, gpos) AS ftype FROM %s o WHERE {occ_filter} AND {words} GROUP BY span"
    return f"""(WITH p AS (SELECT *, row_number() OVER (PARTITION BY ftype ORDER BY fpos) AS n FROM ({first % DUCK_EARLIER}) f),
      c AS (SELECT ftype, max(n) AS c FROM p GROUP BY ftype),
      q AS (SELECT *, row_number() OVER (PARTITION BY ftype ORDER BY fpos) AS n FROM ({first % DUCK_OCC}) f WHERE span NOT IN (SELECT span FROM p))
      SELECT span AS original, ftype, fpos, n, 0 AS run FROM p
      UNION ALL SELECT q.span, q.ftype, q.fpos, q.n + coalesce(c.c, 0), 1 FROM q LEFT JOIN c USING (ftype))"""


@register(
    "strategy_context_incremental",
    f"""SELECT o.src, o.doc_id, o.seq, o.span, o.type,
      CASE WHEN n.run = 0 OR o.gpos >= n.fpos THEN {D.template('n.ftype', TYPE_TEMPLATES)} || ' ' || CAST(n.n AS VARCHAR)
           ELSE {D.template('o.type', TYPE_TEMPLATES)} END AS masked
    FROM {DUCK_OCC} o LEFT JOIN {_duck_incremental(f"type IN ({_NUM_SQL})", False)} n ON n.original = o.span""",
)
def q_strategy_context_incremental(spark, sf):
    occ = corpus_occurrences(spark, sf)
    prior = stored(S.context_mapping(earlier_occurrences(spark, sf, occ), CORPUS_KEYS).select("original", "entity_type", "mask_text"), "context_prior")
    return S.context_masks(occ, CORPUS_KEYS, prior=prior)


@register(
    "strategy_hybrid_incremental",
    f"""SELECT original, ftype AS entity_type, CASE WHEN ftype IN ({_NUM_SQL}) THEN n::BIGINT END AS ordinal,
      {D.template('ftype', TYPE_TEMPLATES)} || CASE WHEN ftype IN ({_NUM_SQL}) THEN ' ' || CAST(n AS VARCHAR) ELSE '' END AS mask_text
    FROM {_duck_incremental("true", True)} h WHERE run = 1""",
)
def q_strategy_hybrid_incremental(spark, sf):
    """The rows this run adds to the mapping that the earlier run stored."""
    occ, words = corpus_occurrences(spark, sf), custom_dictionary(spark, sf)
    prior = stored(S.hybrid_mapping(earlier_occurrences(spark, sf, occ), CORPUS_KEYS, words).select("original", "entity_type", "mask_text"), "hybrid_prior")
    return S.hybrid_mapping(occ, CORPUS_KEYS, words, prior=prior).select("original", "entity_type", "ordinal", "mask_text")


@register("strategy_custom_delta")
def q_strategy_custom_delta(spark, sf):
    return S.custom_delta(corpus_occurrences(spark, sf), custom_dictionary(spark, sf), SALT)


def _duck_custom_rounds(rounds: int, salt: str | None, hex_len: int) -> str:
    """The rounds of :func:`strategies.custom_delta`, unrolled."""
    salted = "" if salt is None else f"{D.q(salt)} || '|' || "
    mask = lambda k: f"'__CUSTOM_' || substr(sha256({salted}original{'' if k is None else f" || '#{k}'"}), 1, {hex_len}) || '__'"
    ctes = [
        f"new AS MATERIALIZED (SELECT original, {mask(None)} AS token FROM (SELECT DISTINCT span AS original FROM {DUCK_OCC} o WHERE span NOT IN (SELECT original FROM {DUCK_CW} c)) d)",
        f"held AS MATERIALIZED (SELECT replacement AS token FROM {DUCK_CW} c)",
        "contested AS MATERIALIZED (SELECT token FROM new GROUP BY token HAVING count(*) > 1 UNION SELECT new.token FROM new SEMI JOIN held ON new.token = held.token)",
        "win0 AS MATERIALIZED (SELECT token, original FROM new ANTI JOIN contested ON new.token = contested.token)",
        "todo1 AS MATERIALIZED (SELECT token, original FROM new SEMI JOIN contested ON new.token = contested.token)",
        "taken1 AS MATERIALIZED (SELECT token FROM held UNION ALL SELECT token FROM win0)",
    ]
    for k in range(1, rounds + 1):
        ctes += [
            f"win{k} AS MATERIALIZED (SELECT * FROM todo{k} ANTI JOIN taken{k} ON todo{k}.token = taken{k}.token QUALIFY row_number() OVER (PARTITION BY token ORDER BY original) = 1)",
            f"todo{k + 1} AS MATERIALIZED (SELECT {mask(k)} AS token, original FROM todo{k} ANTI JOIN win{k} ON todo{k}.original = win{k}.original)",
            f"taken{k + 1} AS MATERIALIZED (SELECT token FROM taken{k} UNION ALL SELECT token FROM win{k})",
        ]
    wins = " UNION ALL ".join(f"SELECT original, token AS replacement FROM win{k}" for k in range(rounds + 1))
    return "WITH " + ", ".join(ctes) + " " + wins


ORACLE["strategy_custom"] = f"""SELECT o.src, o.doc_id, o.seq, o.span, o.type, m.replacement AS masked
  FROM {DUCK_OCC} o JOIN (SELECT original, replacement FROM {DUCK_CW} c UNION ALL SELECT * FROM ({_duck_custom_rounds(3, None, 8)}) d) m ON m.original = o.span"""
ORACLE["strategy_custom_delta"] = _duck_custom_rounds(3, SALT, 8)


@register("strategy_custom_short", _duck_custom_rounds(8, SALT, SHORT_HEX))
def q_strategy_custom_short(spark, sf):
    """Masks of five digits, which do collide: no two words share one."""
    return S.custom_delta(corpus_occurrences(spark, sf), custom_dictionary(spark, sf), SALT, SHORT_HEX)


@register(
    "reverse_mapping",
    f"""SELECT mask_text, arg_max(original, (k1, k3)) AS original, count(DISTINCT original)::BIGINT AS n_originals
    FROM {DUCK_HYBRID} h GROUP BY mask_text""",
)
def q_reverse_mapping(spark, sf):
    h = hybrid_table(spark, sf)
    cw = custom_dictionary(spark, sf).select("original", F.col("priority").alias("_p"))
    fp = F.col("first_pos")
    ordered = h.join(cw, "original", "left").withColumn(
        "seq",
        F.when(F.col("is_custom"), F.struct(F.lit(0).alias("k"), F.lit("").alias("a"), F.col("_p").cast("long").alias("b"), F.lit(0).cast("long").alias("c")))
        .otherwise(F.struct(F.lit(1).alias("k"), fp["src"].alias("a"), fp["doc_id"].cast("long").alias("b"), fp["seq"].cast("long").alias("c"))),
    )
    return S.reverse_mapping(ordered)


# ---------------------------------------------------------------------------
# Custom-word dictionaries
# ---------------------------------------------------------------------------

from ..operators import words as W  # noqa: E402

REMASK_WORDS = [("成交", "交易"), ("订单", "单据")]  # a caller's small dictionary


def _segment_words(spark, sf, segment: str, label: str) -> DataFrame:
    c = table(spark, sf, "customer").filter(F.col("c_mktsegment") == segment)
    return c.select(
        F.concat(F.lit("u"), F.col("c_custkey").cast("string"), F.lit("@mail.example.com")).alias("original"),
        F.concat(F.lit(label), F.col("c_custkey").cast("string")).alias("replacement"),
        F.col("c_custkey").alias("priority"),
    )


def _duck_segment_words(segment: str, label: str) -> str:
    return (
        f"(SELECT 'u' || CAST(c_custkey AS VARCHAR) || '@mail.example.com' AS original, "
        f"{D.q(label)} || CAST(c_custkey AS VARCHAR) AS replacement, c_custkey AS priority "
        f"FROM customer WHERE c_mktsegment = {D.q(segment)})"
    )


def _updates(spark, sf) -> DataFrame:
    n = table(spark, sf, "nation")
    nations = n.select(
        F.col("n_name").alias("original"), F.concat(F.lit("国家"), F.col("n_nationkey").cast("string")).alias("replacement"),
        (F.lit(100_000_000) + F.col("n_nationkey")).cast("long").alias("priority"),
    )
    return _segment_words(spark, sf, "BUILDING", "建筑客户").unionByName(nations)


_DUCK_UPDATES = f"""({_duck_segment_words('BUILDING', '建筑客户')} UNION ALL
  SELECT n_name AS original, '国家' || CAST(n_nationkey AS VARCHAR) AS replacement, (100000000 + n_nationkey)::BIGINT AS priority FROM nation)"""


@register(
    "upsert_words",
    f"""WITH w AS {DUCK_CW}, u AS (SELECT original, arg_max(replacement, priority) AS r, min(priority) AS p
        FROM {_DUCK_UPDATES} x WHERE length(original) > 0 AND length(replacement) > 0 GROUP BY original),
      b AS (SELECT coalesce(max(priority), 0) AS m FROM w)
    SELECT coalesce(w.original, u.original) AS original, coalesce(u.r, w.replacement) AS replacement,
      coalesce(w.priority, (SELECT m FROM b) + u.p)::BIGINT AS priority
    FROM w FULL OUTER JOIN u ON u.original = w.original""",
)
def q_upsert_words(spark, sf):
    return W.upsert_words(custom_dictionary(spark, sf), _updates(spark, sf))


@register(
    "remove_words",
    f"""SELECT w.original, w.replacement, w.priority FROM {DUCK_CW} w
    WHERE w.original NOT IN (SELECT 'u' || CAST(c_custkey AS VARCHAR) || '@mail.example.com' FROM customer WHERE c_acctbal < 0)""",
)
def q_remove_words(spark, sf):
    neg = table(spark, sf, "customer").filter(F.col("c_acctbal") < 0).select(
        F.concat(F.lit("u"), F.col("c_custkey").cast("string"), F.lit("@mail.example.com")).alias("original")
    )
    return W.remove_words(custom_dictionary(spark, sf), neg)


@register(
    "list_words",
    f"SELECT original, replacement, (row_number() OVER (ORDER BY priority) - 1)::BIGINT AS position FROM {DUCK_CW} w",
)
def q_list_words(spark, sf):
    return W.list_words(custom_dictionary(spark, sf))


@register(
    "sync_words",
    f"""WITH l AS {_duck_segment_words('BUILDING', 'B')}, s AS {DUCK_CW}, b AS (SELECT coalesce(max(priority), 0) AS m FROM l)
    SELECT coalesce(l.original, s.original) AS original, coalesce(l.replacement, s.replacement) AS replacement,
      coalesce(l.priority, (SELECT m FROM b) + s.priority)::BIGINT AS priority
    FROM l FULL OUTER JOIN s ON s.original = l.original""",
)
def q_sync_words(spark, sf):
    return W.sync_words(_segment_words(spark, sf, "BUILDING", "B"), custom_dictionary(spark, sf))


@register(
    "merge_words",
    f"""WITH t AS (SELECT *, 0 AS layer FROM {_duck_segment_words('BUILDING', 'S')} a
        UNION ALL SELECT *, 1 AS layer FROM {DUCK_CW} b
        UNION ALL SELECT *, 2 AS layer FROM {_duck_segment_words('MACHINERY', 'M')} c)
    SELECT original, arg_max(replacement, {{'l': layer, 'p': priority}}) AS replacement,
      min({{'l': layer, 'p': priority}}).l AS layer, min({{'l': layer, 'p': priority}}).p AS layer_priority
    FROM t GROUP BY original""",
)
def q_merge_words(spark, sf):
    return W.merge_words([
        _segment_words(spark, sf, "BUILDING", "S"), custom_dictionary(spark, sf), _segment_words(spark, sf, "MACHINERY", "M"),
    ]).select("original", "replacement", F.col("layer").cast("int").alias("layer"), "layer_priority")


@register(
    "apply_custom_words",
    f"""SELECT doc_id, list_reduce((SELECT list({{'s': original, 'r': replacement}} ORDER BY priority) FROM {DUCK_CW} w),
      lambda acc, p: {{'s': replace(acc.s, p.s, p.r), 'r': ''}}, {{'s': text, 'r': ''}}).s AS text
    FROM {DUCK_PII} p""",
)
def q_apply_custom_words(spark, sf):
    return W.apply_custom_words(pii_texts(spark, sf), "text", custom_dictionary(spark, sf))


def _remask_words(spark) -> DataFrame:
    return spark.createDataFrame([(o, r, i) for i, (o, r) in enumerate(REMASK_WORDS)], W.WORDS_SCHEMA)


@register(
    "remask_incremental",
    f"""SELECT p.doc_id, CASE WHEN o.o_orderstatus = 'F' THEN
        {'replace(' * len(REMASK_WORDS)}{D.literal_fold('p.text', D.entity_list('p.text'), SALT)}{''.join(f", {D.q(a)}, {D.q(b)})" for a, b in REMASK_WORDS)}
      ELSE {D.literal_fold('p.text', D.entity_list('p.text'), SALT)} END AS masked
    FROM {DUCK_PII} p JOIN orders o ON o.o_orderkey = p.doc_id""",
)
def q_remask_incremental(spark, sf):
    pii = pii_texts(spark, sf)
    done = table(spark, sf, "orders").filter(F.col("o_orderstatus") == "F").select(F.col("o_orderkey").alias("doc_id"))
    previous, earlier = mask_job(pii.join(done, "doc_id", "left_semi"), ["doc_id"])  # an earlier run's stored output

    def full_mask(df):
        m, _ = mask_job(df, ["doc_id"], earlier)
        return m

    return W.remask_incremental(pii, "text", ["doc_id"], previous, _remask_words(spark), full_mask)


# ---------------------------------------------------------------------------
# Files and the stored vault
# ---------------------------------------------------------------------------

from ..session import scratch_path  # noqa: E402
from ..sources import files as FS  # noqa: E402

# How the test manifest names each document's file, by language (a rule over
# the table, so every document gets a name): text, upper-case Markdown, PDF,
# and a name without a dot that only mentions its type.
_LANG_SUFFIX = {"en": ".txt", "fr": ".MD", "de": ".pdf", "es": "_docx"}


def manifest(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", "text", "lang", "source")
    suffix = F.lit("")
    expr = None
    for k, v in _LANG_SUFFIX.items():
        expr = F.when(F.col("lang") == k, F.lit(v)) if expr is None else expr.when(F.col("lang") == k, F.lit(v))
    suffix = expr.otherwise(F.lit(".bin"))
    name = F.concat(F.lit("report_"), F.col("doc_id").cast("string"), suffix)
    return d.select("doc_id", "text", F.concat(F.lit("/in/"), F.col("source"), F.lit("/"), name).alias("path"), name.alias("name"))


_DUCK_SUFFIX = "CASE " + " ".join(f"WHEN lang = {D.q(k)} THEN {D.q(v)}" for k, v in _LANG_SUFFIX.items()) + " ELSE '.bin' END"
DUCK_MANIFEST = f"""(SELECT doc_id, text, '/in/' || source || '/' || name AS path, name FROM (
    SELECT doc_id, text, source, 'report_' || CAST(doc_id AS VARCHAR) || {_DUCK_SUFFIX} AS name FROM documents) a)"""
_DBASE = "regexp_extract(path, '([^/\\\\]*)$', 1)"
_DSTRIP = f"regexp_replace({_DBASE}, '^\\.+', '')"
_DEXT = f"lower(CASE WHEN instr({_DSTRIP}, '.') > 0 THEN string_split({_DSTRIP}, '.')[-1] ELSE '' END)"
_DPROBE = "CASE " + " ".join(f"WHEN instr(lower({_DBASE}), {D.q(e)}) > 0 THEN {D.q(e)}" for e in FS.ROUTE_PROBE_ORDER) + " ELSE '' END"
_DROUTE_EXT = f"(CASE WHEN {_DEXT} <> '' THEN {_DEXT} ELSE {_DPROBE} END)"


@register(
    "route_files",
    f"""SELECT doc_id, path, {_DROUTE_EXT} AS ext,
      CASE WHEN {_DROUTE_EXT} IN ('pdf') THEN 'pdf' WHEN {_DROUTE_EXT} IN ({', '.join(D.q(e) for e in FS.OFFICE_EXTENSIONS)}) THEN 'office'
           WHEN {_DROUTE_EXT} IN ('txt', 'md') THEN 'text' ELSE 'unknown' END AS route
    FROM {DUCK_MANIFEST} m""",
)
def q_route_files(spark, sf):
    return FS.route_files(manifest(spark, sf)).select("doc_id", "path", "ext", "route")


@register(
    "admit_files",
    f"""SELECT doc_id, name, (instr(name, '.') > 0 AND lower(string_split(name, '.')[-1]) IN
      ({', '.join(D.q(e) for e in FS.ADMITTED_EXTENSIONS)})) AS admitted FROM {DUCK_MANIFEST} m""",
)
def q_admit_files(spark, sf):
    return FS.admit_files(manifest(spark, sf)).select("doc_id", "name", "admitted")


_DSTEM = f"(CASE WHEN instr({_DSTRIP}, '.') > 0 THEN regexp_replace({_DBASE}, '\\.[^.]*$', '') ELSE {_DBASE} END)"


@register(
    "output_names",
    f"""SELECT doc_id, stem, stem || '_masked.md' AS masked_md, stem || '_masked_content_list.json' AS masked_json,
      stem || '_unmasked.md' AS unmasked_md, stem || '_unmasked_content_list.json' AS unmasked_json,
      replace(stem || '_masked.md', '_masked.md', '') || '_unmasked.md' AS restore_md_web,
      CASE WHEN stem || '_masked' LIKE '%\\_masked' ESCAPE '\\' THEN replace(stem || '_masked', '_masked', '') ELSE stem || '_masked' END
        || '_unmasked.md' AS restore_md_gui
    FROM (SELECT doc_id, {_DSTEM} AS stem FROM {DUCK_MANIFEST} m) s""",
)
def q_output_names(spark, sf):
    return FS.output_names(manifest(spark, sf)).select(
        "doc_id", "stem", "masked_md", "masked_json", "unmasked_md", "unmasked_json", "restore_md_web", "restore_md_gui"
    )


def uploads(spark: SparkSession, sf: str) -> DataFrame:
    """The documents as uploaded files (``path, content``)."""
    return manifest(spark, sf).where("text is not null").select("path", F.col("text").cast("binary").alias("content"))


def mixed_uploads(spark: SparkSession, sf: str) -> DataFrame:
    """:func:`uploads` in three encodings: an ASCII text may get two GBK characters or
    two Latin-1 letters (no GBK) in front."""
    ascii_only = ~F.col("text").rlike(r"[^\x00-\x7F]")
    front = (
        F.when(ascii_only & (F.col("doc_id") % 3 == 1), F.unhex(F.lit("D6D0CEC4")))
        .when(ascii_only & (F.col("doc_id") % 3 == 2), F.unhex(F.lit("E9FF")))
        .otherwise(F.lit(b""))
    )
    return manifest(spark, sf).where("text is not null").select("path", F.concat(front, F.col("text").cast("binary")).alias("content"))


_DUCK_ASCII = "NOT regexp_matches(text, '[^\\x00-\\x7F]')"
_FILE_TEXT = "regexp_replace(text, '\\r\\n?', chr(10), 'g')"


@register(
    "scan_text_files",
    f"SELECT name, 0 AS item_idx, 'text' AS type, {_FILE_TEXT} AS text, NULL::VARCHAR AS title FROM {DUCK_MANIFEST} m WHERE text IS NOT NULL",
)
def q_scan_text_files(spark, sf):
    return FS.scan_text_files(uploads(spark, sf)).select(FS.base_name(F.col("path")).alias("name"), "item_idx", "type", "text", "title")


@register(
    "decode_bytes",
    f"""SELECT name, CASE WHEN {_DUCK_ASCII} AND doc_id % 3 = 1 THEN '中文' WHEN {_DUCK_ASCII} AND doc_id % 3 = 2 THEN 'éÿ' ELSE '' END || text AS text,
      CASE WHEN {_DUCK_ASCII} AND doc_id % 3 = 1 THEN 'gbk' WHEN {_DUCK_ASCII} AND doc_id % 3 = 2 THEN 'latin-1' ELSE 'utf-8' END AS encoding
    FROM {DUCK_MANIFEST} m WHERE text IS NOT NULL""",
)
def q_decode_bytes(spark, sf):
    return FS.decode_bytes(mixed_uploads(spark, sf)).select(FS.base_name(F.col("path")).alias("name"), "text", "encoding")


def text_route_items(spark: SparkSession, sf: str) -> DataFrame:
    """R8 front half: route by path, read the text-routed files."""
    return FS.scan_text_files(FS.text_files(uploads(spark, sf)))


def file_mask_job(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, str]:
    """R8 over the uploads: (masked items, vault, output folder)."""
    out_dir = scratch_path(spark, "outputs")
    return *jobs.mask_files(text_route_items(spark, sf), SALT, out_dir), out_dir


_DUCK_TEXT_ROUTE = f"(SELECT * FROM {DUCK_MANIFEST} m WHERE {_DROUTE_EXT.replace('path', 'm.path')} IN ('txt', 'md') AND text IS NOT NULL)"


@register(
    "process_documents_mask",
    f"""SELECT name, {_DSTEM.replace('path', 't.path')} || '_masked.md' AS out_name,
      {D.literal_fold('text', D.entity_list('text'), SALT)} || chr(10) || chr(10) AS markdown
    FROM {_DUCK_TEXT_ROUTE} t""",
)
def q_process_documents_mask(spark, sf):
    _, _, out_dir = file_mask_job(spark, sf)
    md = FS.read_outputs(spark, out_dir, "markdown")
    return md.select(FS.base_name(F.col("path")).alias("name"), "out_name", F.col("content").alias("markdown"))


@register(
    "scan_content_list",
    f"""SELECT name, 0 AS item_idx, 'text' AS type, {D.literal_fold('text', D.entity_list('text'), SALT)} AS text, NULL::VARCHAR AS title
    FROM {_DUCK_TEXT_ROUTE} t""",
)
def q_scan_content_list(spark, sf):
    _, _, out_dir = file_mask_job(spark, sf)
    items = FS.scan_content_list(FS.read_outputs(spark, out_dir, "lists"))
    return items.select(FS.base_name(F.col("path")).alias("name"), "item_idx", "type", "text", "title")


@register(
    "process_documents_unmask",
    f"""SELECT name, {_DSTEM.replace('path', 't.path')} || '_unmasked.md' AS out_name, text || chr(10) || chr(10) AS markdown
    FROM {_DUCK_TEXT_ROUTE} t""",
)
def q_process_documents_unmask(spark, sf):
    """Prefer the saved masked content list (S6), restore (U3), render (K1)."""
    _, v, out_dir = file_mask_job(spark, sf)
    saved = FS.scan_content_list(FS.read_outputs(spark, out_dir, "lists"))
    back = scratch_path(spark, "restored")
    jobs.unmask_files(text_route_items(spark, sf), saved, v, back)
    md = FS.read_outputs(spark, back, "markdown")
    return md.select(FS.base_name(F.col("path")).alias("name"), "out_name", F.col("content").alias("markdown"))


_DUCK_FILE_MASKED = D.literal_fold('text', D.entity_list('text'), SALT)


@register(
    "choose_unmask_source",
    f"""SELECT name, 0 AS item_idx, 'text' AS type, CASE WHEN saved THEN {_DUCK_FILE_MASKED} ELSE {_FILE_TEXT} END AS text,
      NULL::VARCHAR AS title, CASE WHEN saved THEN 'masked_list' ELSE 'original' END AS source
    FROM (SELECT *, {_DROUTE_EXT} IN ('txt', 'md') AS saved FROM {DUCK_MANIFEST} m WHERE text IS NOT NULL) t""",
)
def q_choose_unmask_source(spark, sf):
    """Saved masked lists exist for every text-routed file; the rest of the
    manifest falls back to its original items."""
    _, _, out_dir = file_mask_job(spark, sf)
    saved = FS.scan_content_list(FS.read_outputs(spark, out_dir, "lists"))
    chosen = FS.choose_unmask_source(FS.scan_text_files(uploads(spark, sf)), saved, ["path"])
    return chosen.select(FS.base_name(F.col("path")).alias("name"), "item_idx", "type", "text", "title", "source")


@register(
    "write_content_list",
    f"""SELECT {_DSTEM.replace('path', 't.path')} || '_masked_content_list.json' AS out_name, name, 1::BIGINT AS n_items,
      'type,text' AS keys, {_DUCK_FILE_MASKED} AS text
    FROM {_DUCK_TEXT_ROUTE} t""",
)
def q_write_content_list(spark, sf):
    """The written content lists read back, one row a document."""
    _, _, out_dir = file_mask_job(spark, sf)
    lists = FS.read_outputs(spark, out_dir, "lists").withColumn("l", F.from_json("content", "array<map<string,string>>"))
    return lists.select(
        "out_name", FS.base_name(F.col("path")).alias("name"), F.size("l").cast("long").alias("n_items"),
        F.array_join(F.map_keys(F.get("l", F.lit(0))), ",").alias("keys"), F.get("l", F.lit(0))["text"].alias("text"),
    )


def saved_lists(spark: SparkSession, sf: str) -> DataFrame:
    """Every document as a saved content list with keys the masker does not know; all
    files have one stem."""
    item = F.struct("type", "text", "title", "page", F.array(F.col("item_idx"), F.lit(7)).alias("bbox"), F.struct(F.col("doc_id").alias("id")).alias("meta"))
    items = content_items(spark, sf).select("doc_id", F.struct("item_idx", item.alias("i")).alias("s"))
    lists = items.groupBy("doc_id").agg(F.array_sort(F.collect_list("s")).alias("a"))
    path = F.concat(F.lit("/in/"), F.col("doc_id").cast("string"), F.lit("/report.json"))
    return lists.select(path.alias("path"), F.to_json("a.i").alias("content"))


def _list_rows(lists: DataFrame) -> DataFrame:
    schema = "array<struct<type:string,text:string,title:string,page:int,bbox:array<int>,meta:struct<id:long>>>"
    rows = lists.select("path", "out_name", F.posexplode(F.from_json("content", schema)).alias("item_idx", "i"))
    return rows.select("path", "out_name", "item_idx", "i.type", "i.text", "i.title", "i.page", F.to_json("i.bbox").alias("bbox"), F.col("i.meta.id").alias("meta_id"))


def _duck_lists(items: str, operation: str) -> str:
    return f"""SELECT '/in/' || doc_id || '/report.json' AS path, 'report_{operation}_content_list.json' AS out_name, item_idx, type, text, title,
      page, '[' || item_idx || ',7]' AS bbox, doc_id AS meta_id FROM {items} m"""


@register("process_lists_mask", _duck_lists(DUCK_MASKED_ITEMS, "masked"))
def q_process_lists_mask(spark, sf):
    """R8 over saved content lists: many items a document, unknown keys, one stem."""
    out_dir = scratch_path(spark, "outputs")
    jobs.mask_files(FS.scan_content_list(saved_lists(spark, sf)), SALT, out_dir)
    return _list_rows(FS.read_outputs(spark, out_dir, "lists"))


@register("process_lists_unmask", _duck_lists(DUCK_ITEMS, "unmasked"))
def q_process_lists_unmask(spark, sf):
    """U5 over the masked lists of :func:`q_process_lists_mask`."""
    out_dir, back = scratch_path(spark, "outputs"), scratch_path(spark, "restored")
    originals = FS.scan_content_list(stored(saved_lists(spark, sf), "saved_lists"))  # both jobs read them
    _, v = jobs.mask_files(originals, SALT, out_dir)
    jobs.unmask_files(originals, FS.scan_content_list(FS.read_outputs(spark, out_dir, "lists")), v, back)
    return _list_rows(FS.read_outputs(spark, back, "lists"))


@register("write_entities", f'SELECT doc_id, seq AS pos, type, start, "end", span, prob FROM {DUCK_DEDUP} d')
def q_write_entities(spark, sf):
    """Per-document NER results written as JSON and read back."""
    path = scratch_path(spark, "entities")
    FS.write_entities(doc_ner_entities(spark, sf), path)
    saved = spark.read.schema("doc_id long, output array<struct<type:string,start:int,end:int,span:string,prob:double>>").json(path)
    return C.posexplode_rows(saved, ["doc_id"], F.col("output"), "pos", "e").select("doc_id", "pos", "e.*")


@register("load_vault", f"SELECT token, original, entity_type FROM {DUCK_VAULT} v")
def q_load_vault(spark, sf):
    _, v = mask_run(spark, sf)
    return vault.load_vault(spark, v.inputFiles()[0].rsplit("/", 1)[0])


@register("save_vault", f"SELECT token, original, entity_type FROM {DUCK_VAULT} v")
def q_save_vault(spark, sf):
    """Two runs appending to one vault: documents first, then the corpus delta."""
    path = scratch_path(spark, "vault_saved")
    docs = documents(spark, sf)
    _, first = mask_job(docs, ["doc_id"])
    vault.save_vault(first, path)
    prior = vault.load_vault(spark, path)
    _, second = mask_job(corpus(spark, sf), CORPUS_KEYS, prior_vault=prior)
    vault.save_vault(second, path)
    return vault.load_vault(spark, path)


@register("vault_commit", f"SELECT token, original, entity_type FROM {DUCK_VAULT} v")
def q_vault_commit(spark, sf):
    """Two jobs commit to one vault; the second runs again in full, as after a lost acknowledgement."""
    committed = vault.CommittedVault(spark, scratch_path(spark, "vault_committed"))
    runs = [("documents", documents(spark, sf), ["doc_id"]), ("corpus", corpus(spark, sf), CORPUS_KEYS), ("corpus", corpus(spark, sf), CORPUS_KEYS)]
    for job, docs, keys in runs:
        _, delta = mask_job(docs, keys, prior_vault=committed)
        committed.commit(delta, job, SALT)
    return committed.rows()


@register("clear_vault", f"SELECT token, original, entity_type FROM {DUCK_VAULT} v WHERE 1 = 0")
def q_clear_vault(spark, sf):
    _, v = mask_run(spark, sf)
    path = scratch_path(spark, "vault_cleared")
    vault.save_vault(v, path)
    return vault.clear_vault(spark, path)


@register(
    "export_vault",
    f"SELECT token, to_json({{'original_text': original, 'entity_type': entity_type}})::VARCHAR AS value FROM {DUCK_VAULT} v",
)
def q_export_vault(spark, sf):
    _, v = mask_run(spark, sf)
    return vault.export_vault(v)


# ---------------------------------------------------------------------------
# Streaming mask job over ``pages``
# ---------------------------------------------------------------------------

from ..streaming.masking_stream import run_mask_stream  # noqa: E402


@register(
    "stream_mask",
    f"""SELECT page_id, {D.literal_fold('html', D.entity_list('html'), SALT)} AS masked,
      len(list_distinct({D.entity_list('html')}))::BIGINT AS n_entities FROM pages""",
)
def q_stream_mask(spark, sf):
    """Raw web pages arrive as a stream (the table's Parquet files); every
    page is masked and the vault grows per micro-batch."""
    base = scratch_path(spark, "stream")
    run_mask_stream(
        spark, f"{sf.rstrip('/')}/pages*.parquet", "page_id long, url string, html string",
        "html", ["page_id"], SALT, base + "/masked", base + "/vault", base + "/checkpoint",
    )
    return spark.read.parquet(base + "/masked").select("page_id", "masked", "n_entities")


# ---------------------------------------------------------------------------
# M8: restore a hybrid-masked corpus
# ---------------------------------------------------------------------------


def hybrid_run(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(stored hybrid-masked corpus, stored reverse mapping)."""
    occ = corpus_occurrences(spark, sf)
    cw = custom_dictionary(spark, sf)
    mapping = stored(S.hybrid_mapping(occ, CORPUS_KEYS, cw), "hybrid_mapping")
    masked = stored(S.mask_with_mapping(corpus(spark, sf), "text", CORPUS_KEYS, occ, mapping), "hybrid_masked")
    fp = F.col("first_pos")
    ordered = mapping.join(cw.select("original", F.col("priority").alias("_p")), "original", "left").withColumn(
        "seq",
        F.when(F.col("is_custom"), F.struct(F.lit(0).alias("k"), F.lit("").alias("a"), F.col("_p").cast("long").alias("b"), F.lit(0).cast("long").alias("c")))
        .otherwise(F.struct(F.lit(1).alias("k"), fp["src"].alias("a"), fp["doc_id"].cast("long").alias("b"), fp["seq"].cast("long").alias("c"))),
    )
    return masked, stored(S.reverse_mapping(ordered), "hybrid_reverse")


_DUCK_HYB_EXPECT = f"""(SELECT o.src, o.doc_id, list({{'s': o.span,
      'r': CASE WHEN h.is_custom OR h.ordinal IS NOT NULL THEN o.span ELSE h.mask_text END}} ORDER BY o.seq) AS pairs
    FROM {DUCK_OCC} o JOIN {DUCK_HYBRID} h ON h.original = o.span GROUP BY o.src, o.doc_id)"""


@register(
    "unmask_hybrid",
    f"""SELECT c.src, c.doc_id, CASE WHEN p.pairs IS NULL THEN c.text ELSE {D.placeholder_fold('c.text', 'p.pairs')} END AS restored
    FROM {DUCK_CORPUS} c LEFT JOIN {_DUCK_HYB_EXPECT} p ON p.src = c.src AND p.doc_id = c.doc_id""",
)
def q_unmask_hybrid(spark, sf):
    masked, reverse = hybrid_run(spark, sf)
    return S.unmask_hybrid(masked, "masked", CORPUS_KEYS, reverse, custom_dictionary(spark, sf))


# ---------------------------------------------------------------------------
# U2 with M8 before it: strategy masks and tokens in one text
# ---------------------------------------------------------------------------


def mixed_run(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(stored corpus, stored vault, reverse mapping): custom words and numbered
    types carry the masks of the hybrid strategy, all other entities tokens."""
    occ = corpus_occurrences(spark, sf)
    named = stored(
        S.hybrid_mapping(occ, CORPUS_KEYS, custom_dictionary(spark, sf)).where("is_custom or ordinal is not null").select("original", "mask_text"), "mixed_mapping"
    )
    rest = occ.join(named.select(F.col("original").alias("span")), "span", "left_anti").groupBy("span").agg(F.min("type").alias("type"))
    _, tokens = vault.plan_tokens(rest, SALT)
    mapping = named.unionByName(tokens.select("original", F.col("token").alias("mask_text")))
    masked = stored(S.mask_with_mapping(corpus(spark, sf), "text", CORPUS_KEYS, occ, mapping), "mixed_masked")
    reverse = named.groupBy("mask_text").agg(F.max("original").alias("original"), F.countDistinct("original").cast("long").alias("n_originals"))
    return masked, tokens, stored(reverse, "mixed_reverse")


@register("unmask_text_strategy", f"SELECT src, doc_id, text AS restored FROM {DUCK_CORPUS} c")
def q_unmask_text_strategy(spark, sf):
    """The strategy's masks are restored first, then the tokens."""
    masked, tokens, reverse = mixed_run(spark, sf)
    return restore.unmask_text(masked, "masked", CORPUS_KEYS, tokens, reverse=reverse, custom_words=custom_dictionary(spark, sf))
