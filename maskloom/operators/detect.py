"""Detection operators (inventory D1–D10, N9, N12, N13).

Texts stay in their partitions: every detector is a narrow projection built
from ``regexp_extract_all``/``split`` plus an ``explode``.  Only the
de-duplication steps group, and they group small entity rows, never texts.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.columns import exclusive_sums, guard, guarded, let, posexplode_rows, regex_spans
from ..functions.patterns import REGEX_REGISTRY, TYPE_ALIASES, java_pattern

OFFSETS_STRUCT = "struct<type:string,start:int,end:int,span:string,prob:double>"
ENTITY_COLUMNS = ("seq", "type", "start", "end", "span", "prob")


def registry_with(
    extra: Mapping[str, str] | None = None, base: Mapping[str, str] | None = None
) -> dict[str, str]:
    """Add or overwrite patterns.  A new type is appended to the order, an
    existing type keeps its place with the new pattern (plain ``dict`` update).

    A type name must be ASCII letters (an alias is looked up first): the token
    grammar holds no other name, so its tokens could not be restored."""
    reg = dict(REGEX_REGISTRY if base is None else base)
    for t, p in (extra or {}).items():
        name = TYPE_ALIASES.get(t, t)
        if not (name.isascii() and name.isalpha()):
            raise ValueError(f"entity type {t!r} cannot be written in a token; use ASCII letters")
        reg[t] = p
    return reg


def detect_type(
    df: DataFrame, text_col: str, entity_type: str, id_cols: Sequence[str], pattern: str | None = None
) -> DataFrame:
    """One row per match of one type: ``ids…, seq, span``; seq = match order."""
    pat = pattern if pattern is not None else REGEX_REGISTRY[entity_type]
    arr = guarded(regex_spans(text_col, pat), guard(entity_type, pat, text_col), "string")
    return posexplode_rows(df, id_cols, arr, "seq", "span")


def _offsets_tag(entity_type: str):
    def tag(span: Column, start: Column) -> Column:
        return F.struct(
            F.lit(entity_type).alias("type"),
            start.alias("start"),
            (start + F.char_length(span)).alias("end"),
            span.alias("span"),
            F.lit(1.0).alias("prob"),
        )

    return tag


def with_offset_entities(
    df: DataFrame,
    text_col: str,
    keep_cols: Sequence[str],
    registry: Mapping[str, str] | None = None,
    out_col: str = "ents",
) -> DataFrame:
    """Add ``out_col`` = array<struct<type,start,end,span,prob>> of all matches.

    Order is (registry order, position).  One scan cuts the text into the
    runs that can hold matches (:func:`columns.text_runs`); the built-in
    patterns then look at those only.  A custom or changed pattern scans the
    text itself.
    """
    reg = REGEX_REGISTRY if registry is None else registry
    builtin = {t: p for t, p in reg.items() if C.is_builtin(t, p)}
    names = {t: f"_t{i}" for i, t in enumerate(reg) if t not in builtin}
    cols = [C.text_runs(text_col).alias("_runs")] if builtin else []
    for t, n in names.items():
        cols.append(F.regexp_extract_all(F.col(text_col), F.lit(java_pattern(reg[t])), 0).alias(n + "m"))
        cols.append(F.transform(F.split(F.col(text_col), java_pattern(reg[t]), -1), F.char_length).alias(n + "g"))
    stage1 = df.select(*keep_cols, *cols)
    parts = []
    for t, p in reg.items():
        if t in builtin:
            parts.append(C.run_matches(F.col("_runs"), t, p, _offsets_tag(t), OFFSETS_STRUCT))
        else:
            m, g = F.col(names[t] + "m"), F.col(names[t] + "g")
            parts.append(F.zip_with(m, _prefix_starts(g, F.transform(m, F.char_length)), _offsets_tag(t)))
    arr = parts[0] if len(parts) == 1 else F.concat(*parts)
    return stage1.select(*keep_cols, F.coalesce(arr, F.array().cast(f"array<{OFFSETS_STRUCT}>")).alias(out_col))


def detect_regex_entities(
    df: DataFrame,
    text_col: str,
    id_cols: Sequence[str],
    registry: Mapping[str, str] | None = None,
) -> DataFrame:
    """Every match of every registered type with code-point offsets.

    Output ``ids…, seq, type, start, end, span, prob``; ``seq`` follows
    (registry order, position).
    """
    arr = with_offset_entities(df, text_col, id_cols, registry)
    return posexplode_rows(arr, id_cols, F.col("ents"), "seq", "e").select(
        *id_cols,
        "seq",
        F.col("e.type").alias("type"),
        F.col("e.start").alias("start"),
        F.col("e.end").alias("end"),
        F.col("e.span").alias("span"),
        F.col("e.prob").alias("prob"),
    )


def _prefix_starts(gap_lens: Column, match_lens: Column) -> Column:
    """Linear prefix sum: starts[i] = sum(gap_lens[..i]) + sum(match_lens[..i-1])."""
    def starts(g: Column) -> Column:
        # one gap more than matches: the last gap has no start
        steps = F.filter(F.zip_with(match_lens, g, lambda m, x: m + x), lambda x: x.isNotNull())
        return F.filter(F.zip_with(exclusive_sums(steps), g, lambda before, x: before + x), lambda x: x.isNotNull())

    return let(gap_lens, starts)


def dedup_entities(entities: DataFrame, key_cols: Sequence[str]) -> DataFrame:
    """Per text, one entity per (span, type): highest prob, first seen wins ties.

    The kept entity's rank is where its key was first seen (dict insertion
    order).  Groups small entity rows by (text key, span, type); partial
    aggregation collapses hot keys map-side.
    """
    best = entities.groupBy(*key_cols, "span", "type").agg(
        F.min("seq").alias("first_seq"),
        F.max_by(
            F.struct("start", "end", "prob", "seq"),
            F.struct(F.coalesce(F.col("prob"), F.lit(0.0)), -F.col("seq")),
        ).alias("b"),
    )
    w = Window.partitionBy(*key_cols).orderBy("first_seq")
    return best.select(
        *key_cols,
        (F.row_number().over(w) - 1).cast("long").alias("seq"),
        "type",
        F.col("b.start").alias("start"),
        F.col("b.end").alias("end"),
        "span",
        F.col("b.prob").alias("prob"),
    )


def merge_detections(model_entities: DataFrame, regex_entities: DataFrame, key_cols: Sequence[str]) -> DataFrame:
    """Model entities first, then regex entities; one ``seq`` over both."""
    cols = [*key_cols, "seq", "type", "start", "end", "span", "prob"]
    both = model_entities.select(*cols).withColumn("src", F.lit(0)).unionByName(
        regex_entities.select(*cols).withColumn("src", F.lit(1))
    )
    w = Window.partitionBy(*key_cols).orderBy("src", "seq")
    return both.select(
        *key_cols,
        (F.row_number().over(w) - 1).cast("long").alias("seq"),
        "type", "start", "end", "span", "prob",
    )


def alias_type(type_col: Column, aliases: Mapping[str, str] | None = None) -> Column:
    """Map model type names onto short types; unknown names pass through."""
    aliases = TYPE_ALIASES if aliases is None else aliases
    expr = None
    for k, v in aliases.items():
        expr = (F.when(type_col == k, F.lit(v))) if expr is None else expr.when(type_col == k, F.lit(v))
    return type_col if expr is None else expr.otherwise(type_col)


def filter_types(entities: DataFrame, allowed: Iterable[str], aliases: Mapping[str, str] | None = None) -> DataFrame:
    """Alias model type names, then keep only the allowed types."""
    allowed = list(allowed)
    out = entities.withColumn("type", alias_type(F.col("type"), aliases))
    return out.filter(F.col("type").isin(allowed))
