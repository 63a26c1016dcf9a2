"""Model-based detection as batch Spark steps (inventory N1–N8, N10, N11).

Texts are cut into sentence-aware chunks by one built-in regex, each chunk
becomes a request row, a caller-supplied model scores chunks in Arrow
batches (``mapInPandas``), and the responses are parsed, completed, rebased
and de-duplicated with built-in column functions.  The HTTP client of the
original tool is deliberately not part of this: any callable can be the model.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.patterns import DEFAULT_CHUNK_SIZE, DEFAULT_PROB, chunk_pattern

RAW_ENTITY = "struct<span:string,type:string,start:int,end:int,prob:double>"

# ---------------------------------------------------------------------------
# FIXED VALUES — default prompt (system prompt and user template)
# ---------------------------------------------------------------------------
SYSTEM_PROMPT = (
    "你是一个专业的命名实体识别助手。请识别文本中的敏感信息，包括：人名、地名、机构名、手机号、身份证号、"
    "银行卡号、电子邮箱、IPv4地址、时间。"
)
USER_PROMPT = (
    "请识别以下文本中的实体信息，返回JSON格式，包含字段：span(实体文本), type(实体类型), start(起始位置), "
    "end(结束位置), prob(置信度0-1)。\n\n文本：{text}\n\n要求：\n1. 返回格式必须是标准JSON数组\n"
    "2. 每个实体必须包含所有字段\n3. start和end是字符位置索引\n4. 只返回JSON数组，不要其他说明"
)


def chunk_array(text, max_chunk_size: int = DEFAULT_CHUNK_SIZE) -> Column:
    """N1 as one expression: the greedy sentence-aware chunks of a text."""
    return F.regexp_extract_all(C._col(text), F.lit(chunk_pattern(max_chunk_size)), 0)


def chunk_text(docs: DataFrame, text_col: str, id_cols: Sequence[str], max_chunk_size: int = DEFAULT_CHUNK_SIZE) -> DataFrame:
    """N1 + N2: ``ids…, chunk_idx, chunk, offset, n_chars``.

    Offsets are a running sum computed inside the row (prefix sum over the
    chunk lengths), so no window or shuffle is needed.
    """
    arr = docs.select(*id_cols, chunk_array(text_col, max_chunk_size).alias("_c"))
    offs = C.exclusive_sums(F.transform(F.col("_c"), F.char_length))
    with_off = arr.select(*id_cols, F.arrays_zip(F.col("_c").alias("chunk"), offs.alias("offset")).alias("_z"))
    return C.posexplode_rows(with_off, id_cols, F.col("_z"), "chunk_idx", "z").select(
        *id_cols,
        "chunk_idx",
        F.col("z.chunk").alias("chunk"),
        F.col("z.offset").cast("long").alias("offset"),
        F.char_length("z.chunk").cast("long").alias("n_chars"),
    )


def build_requests(chunks: DataFrame, key_cols: Sequence[str], system_prompt: str = SYSTEM_PROMPT,
                   user_prompt: str = USER_PROMPT) -> DataFrame:
    """Chat messages per chunk: system prompt, then the user template with
    ``{text}`` replaced literally (no other brace handling)."""
    user = F.replace(F.lit(user_prompt), F.lit("{text}"), F.col("chunk"))
    msgs = F.array(
        F.struct(F.lit("system").alias("role"), F.lit(system_prompt).alias("content")),
        F.struct(F.lit("user").alias("role"), user.alias("content")),
    )
    return chunks.select(*key_cols, msgs.alias("messages"))


def score_chunks(chunks: DataFrame, model: Callable[[str], str], key_cols: Sequence[str],
                 text_col: str = "chunk", passthrough: Sequence[str] = ("offset",)) -> DataFrame:
    """Run a caller-supplied model over chunks in Arrow batches.

    ``model(chunk) -> response text``.  A failure is recorded in ``error``
    (the original tool silently treated it as "no entities", i.e. fail-open);
    callers can quarantine or fail on non-null errors.
    """
    keys = list(key_cols) + [c for c in passthrough if c in chunks.columns]
    schema = chunks.select(*keys).schema.simpleString()[len("struct<"):-1]
    out_schema = f"{schema},{text_col}:string,response:string,error:string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            responses, errors = [], []
            for t in pdf[text_col]:
                try:
                    responses.append(model(t))
                    errors.append(None)
                except Exception as exc:  # noqa: BLE001 — recorded, not swallowed
                    responses.append(None)
                    errors.append(f"{type(exc).__name__}: {exc}")
            yield pdf[keys + [text_col]].assign(response=responses, error=errors)

    return chunks.select(*keys, text_col).mapInPandas(run, out_schema)


def parse_responses(responses: DataFrame, key_cols: Sequence[str], response_col: str = "response") -> DataFrame:
    """``ids…, ent_idx, span, type, start, end, prob`` (raw, offsets may be null).

    Greedy first '[' to last ']' if present, else the whole response; the
    array elements are parsed one by one, keeping objects with both ``span``
    and ``type``.  Two steps so one bad element does not void the array.
    """
    body = F.when(
        F.col(response_col).rlike(r"(?s)\[.*\]"), F.regexp_extract(F.col(response_col), r"(?s)\[.*\]", 0)
    ).otherwise(F.col(response_col))
    # inside an object, so that text behind the array makes the whole malformed
    elems = F.from_json(F.concat(F.lit('{"a":'), body, F.lit("}")), "a array<string>")["a"]
    objs = F.transform(
        F.filter(elems, lambda x: F.ltrim(x).startswith("{")),
        lambda x: F.struct(
            F.from_json(x, RAW_ENTITY).alias("e"),
            F.from_json(x, "map<string,string>").alias("m"),
        ),
    )
    kept = F.filter(objs, lambda o: F.map_contains_key(o["m"], "span") & F.map_contains_key(o["m"], "type"))
    ents = F.transform(
        kept,
        lambda o: F.struct(
            o["e"]["span"].alias("span"),
            o["e"]["type"].alias("type"),
            F.when(F.map_contains_key(o["m"], "start") & F.map_contains_key(o["m"], "end"), o["e"]["start"]).alias("start"),
            F.when(F.map_contains_key(o["m"], "start") & F.map_contains_key(o["m"], "end"), o["e"]["end"]).alias("end"),
            F.when(F.map_contains_key(o["m"], "prob"), o["e"]["prob"]).alias("prob"),
            F.map_contains_key(o["m"], "prob").alias("has_prob"),
        ),
    )
    extra = [c for c in ("offset",) if c in responses.columns]
    rows = C.posexplode_rows(
        responses.select(*key_cols, *extra, "chunk", ents.alias("_e")), [*key_cols, *extra, "chunk"], F.col("_e"), "ent_idx", "x"
    )
    return rows.select(
        *key_cols, *extra, "chunk", "ent_idx",
        F.col("x.span").alias("span"), F.col("x.type").alias("type"),
        F.col("x.start").alias("start"), F.col("x.end").alias("end"),
        F.col("x.prob").alias("prob"), F.col("x.has_prob").alias("has_prob"),
    )


def fill_offsets(parsed: DataFrame, chunk_col: str = "chunk") -> DataFrame:
    """Missing offsets → first occurrence of the span in the chunk (code
    points); entities whose span is absent are dropped; given offsets are kept."""
    flagged = parsed.withColumn("_miss", F.col("start").isNull() | F.col("end").isNull())
    found = F.instr(F.col(chunk_col), F.col("span")) - 1  # 1-based, code points
    out = flagged.withColumn("start", F.when(F.col("_miss"), found).otherwise(F.col("start")).cast("int"))
    out = out.withColumn(
        "end", F.when(F.col("_miss"), F.col("start") + F.char_length("span")).otherwise(F.col("end")).cast("int")
    )
    return out.filter(~F.col("_miss") | (F.col("start") >= 0)).drop("_miss")


def default_prob(entities: DataFrame, prob: float = DEFAULT_PROB) -> DataFrame:
    """A missing confidence becomes ``prob`` (0.95)."""
    return entities.withColumn(
        "prob", F.when(F.col("has_prob"), F.col("prob")).otherwise(F.lit(float(prob)))
    ).drop("has_prob")


def rebase_offsets(entities: DataFrame, offset_col: str = "offset") -> DataFrame:
    """Chunk offsets → text offsets."""
    return entities.withColumn("start", (F.col("start") + F.col(offset_col)).cast("int")).withColumn(
        "end", (F.col("end") + F.col(offset_col)).cast("int")
    )


def batch_entities(responses: DataFrame, id_cols: Sequence[str]) -> DataFrame:
    """Per text, parsed → filled → default prob → rebased → de-duplicated.

    ``responses``: ``ids…, chunk_idx, offset, chunk, response`` (offset rides
    along from :func:`chunk_text`, so no join is needed).  Output ``ids…,
    seq, type, start, end, span, prob`` keyed by the text id (never by
    completion order).
    """
    from .detect import dedup_entities

    parsed = parse_responses(responses, [*id_cols, "chunk_idx"])
    rebased = rebase_offsets(default_prob(fill_offsets(parsed)))
    ordered = rebased.withColumn(
        "seq", (F.row_number().over(Window.partitionBy(*id_cols).orderBy("chunk_idx", "ent_idx")) - 1).cast("long")
    )
    return dedup_entities(ordered.select(*id_cols, "seq", "type", "start", "end", "span", "prob"), id_cols)


def corpus_entities(entities: DataFrame, id_cols: Sequence[str]) -> DataFrame:
    """One row per (span, type) over the whole corpus: the best-prob
    occurrence (first in (text, seq) order wins ties) and how often it occurs.

    A plain grouped aggregate: partial aggregation collapses a hot (span,
    type) map-side, so no group is ever collected whole.
    """
    ranked = entities.select("span", "type", *id_cols, "seq", "start", "end", "prob")
    agg = ranked.groupBy("span", "type").agg(
        F.max("prob").alias("best_prob"),
        F.count("*").cast("long").alias("n_occurrences"),
        F.min_by(F.struct(*id_cols, "seq", "start", "end"), F.struct(-F.col("prob"), *id_cols, "seq")).alias("b"),
    )
    return agg.select(
        "span", "type",
        *[F.col(f"b.{c}").alias(f"first_{c}") for c in id_cols],
        F.col("b.start").alias("start"), F.col("b.end").alias("end"),
        F.col("best_prob").alias("prob"), "n_occurrences",
    )
