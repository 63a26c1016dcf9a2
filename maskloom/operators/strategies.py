"""Replacement strategies (inventory M1–M9, V6, S8).

A per-entity strategy is a function ``(span, type) -> Column`` built from
built-ins; :func:`mask_with_strategy` plugs it into the same literal fold the
token masking uses.  The stateful strategies (running numbers, custom
dictionaries) are set operations over the entity occurrences of a whole
corpus: first-seen order is a global position ``(doc, seq)``, numbering is a
distributed rank, and the mapping is a table joined back by text.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.patterns import (
    DEFAULT_HASH_LEN,
    DEFAULT_REPLACEMENT,
    NUMBERED_TYPES,
    TYPE_TEMPLATES,
)
from ..session import stored

Strategy = Callable[[Column, Column], Column]


# ---------------------------------------------------------------------------
# Per-entity strategies
# ---------------------------------------------------------------------------

def replacement(text: str = DEFAULT_REPLACEMENT) -> Strategy:
    """M1: a constant."""
    return lambda span, typ: F.lit(text)


def hashed(salt: str = "", length: int = DEFAULT_HASH_LEN) -> Strategy:
    """M2: the first ``length`` hex chars of md5(span + salt); 1 ≤ length ≤ 32."""
    if not 1 <= int(length) <= 32:
        raise ValueError("hash length must be within 1..32")
    return lambda span, typ: F.substring(F.md5(F.concat(span, F.lit(salt))), 1, int(length))


def templates_with(overrides: Mapping[str, str] | None = None) -> dict[str, str]:
    """M4: the type templates with ``set_template`` overrides applied."""
    t = dict(TYPE_TEMPLATES)
    t.update(overrides or {})
    return t


def _template_map(templates: Mapping[str, str]) -> Column:
    keys = list(templates)
    return F.map_from_arrays(F.array(*[F.lit(k) for k in keys]), F.array(*[F.lit(templates[k]) for k in keys]))


def template_of(typ: Column, templates: Mapping[str, str] | None = None) -> Column:
    t = TYPE_TEMPLATES if templates is None else templates
    return F.coalesce(F.element_at(_template_map(t), typ), F.lit(t["DEFAULT"]))


def type_based(templates: Mapping[str, str] | None = None) -> Strategy:
    """M3: the label of the entity type, ``DEFAULT`` for unknown types."""
    return lambda span, typ: template_of(typ, templates)


def token_strategy(salt: str) -> Strategy:
    """The reversible token (what masking emits by default)."""
    return lambda span, typ: C.token(typ, span, salt)


def dispatch(per_type: Mapping[str, Strategy], default: Strategy) -> Strategy:
    """M9: the strategy registered for the type, else the default."""

    def run(span: Column, typ: Column) -> Column:
        expr = None
        for t, s in per_type.items():
            expr = F.when(typ == t, s(span, typ)) if expr is None else expr.when(typ == t, s(span, typ))
        return default(span, typ) if expr is None else expr.otherwise(default(span, typ))

    return run


def mask_with_strategy(docs: DataFrame, text_col: str, id_cols: Sequence[str], strategy: Strategy,
                       registry: Mapping[str, str] | None = None, out_col: str = "masked") -> DataFrame:
    """R1 with a chosen strategy instead of tokens (documented intent, Q1):
    every detected span is replaced by the strategy's value in list order."""
    from .mask import entity_column

    flagged = docs.select(*id_cols, F.col(text_col).alias("_t"), C.digit_flag(text_col).alias("_dig"))
    ents = flagged.select(*id_cols, "_t", entity_column(F.col("_t"), registry, has_digit=F.col("_dig")).alias("_e"))
    pairs = ents.select(
        *id_cols, "_t",
        C.placeholder_pairs(F.col("_e"), lambda e: strategy(e["span"], e["type"])).alias("_p"),
    )
    return pairs.select(
        *id_cols, F.when(F.size("_p") == 0, F.col("_t")).otherwise(C.fold_pairs("_t", F.col("_p"))).alias(out_col)
    )


# ---------------------------------------------------------------------------
# distributed first-seen rank (no single-partition window)
# ---------------------------------------------------------------------------

def rank_within(df: DataFrame, group_col: str, order_col: str, out_col: str = "rank") -> DataFrame:
    """1-based rank of ``order_col`` within ``group_col`` without one window
    over a whole group (a group may hold a third of all rows).

    Rows are range-partitioned on (group, order) and written to the shared
    checkpoint folder (partition ids must not change between uses); per
    (partition, group) counts — at most partitions × groups rows, a proven
    bound — give each partition's starting offset, broadcast back and added
    to a partition-local row number.  ``order_col`` must be unique per group.
    """
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    ranged = df.repartitionByRange(n, group_col, order_col).withColumn("_pid", F.spark_partition_id())
    ranged = stored(ranged, "ranked")
    counts = ranged.groupBy("_pid", group_col).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(group_col).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", group_col, F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    local = Window.partitionBy("_pid", group_col).orderBy(order_col)
    with_local = ranged.withColumn("_loc", F.row_number().over(local))
    return with_local.join(F.broadcast(offsets), ["_pid", group_col]).select(
        *[c for c in df.columns], (F.col("_off") + F.col("_loc")).cast("long").alias(out_col)
    )


# ---------------------------------------------------------------------------
# Numbered mappings
# ---------------------------------------------------------------------------

def rebuild_counters(mapping: DataFrame, templates: Mapping[str, str] | None = None,
                     mask_col: str = "mask_text") -> DataFrame:
    """Per numbered type, the largest trailing number among stored masks
    that start with the type's template (unparsable numbers are ignored)."""
    t = TYPE_TEMPLATES if templates is None else templates
    rows = [F.struct(F.lit(ty).alias("entity_type"), F.lit(t[ty]).alias("tpl")) for ty in NUMBERED_TYPES if t.get(ty)]
    m = mapping.select(F.col(mask_col).alias("_m"), F.explode(F.array(*rows)).alias("_t"))
    m = m.filter(F.col("_m").startswith(F.col("_t.tpl")))
    last = F.regexp_extract(F.col("_m"), r"(?U)(\S+)\s*$", 1)  # last whitespace-separated token
    num = last.try_cast("bigint")
    return m.select(F.col("_t.entity_type").alias("entity_type"), num.alias("_n")).groupBy("entity_type").agg(
        F.max("_n").cast("long").alias("counter")
    ).filter(F.col("counter").isNotNull())


def _positions(occurrences: DataFrame, id_cols: Sequence[str]) -> DataFrame:
    return occurrences.withColumn("pos", F.struct(*[F.col(c) for c in id_cols], F.col("seq")))


#: Parts over which the occurrences of one text are dealt before its first one is sought.
FIRST_PARTS = 16


def _first_seen(occ: DataFrame) -> DataFrame:
    """``span, fpos, ftype`` of every text's first occurrence, stored.

    Places are structs, which Spark aggregates by sorting, a whole task at a
    time; tasks that read a compressed table hold any number of rows.  So the
    rows are dealt out first, those of a frequent text over ``FIRST_PARTS`` tasks.
    """
    dealt = occ.select("span", "type", "pos").repartition("span", F.pmod(F.xxhash64("pos"), F.lit(FIRST_PARTS)))
    first = dealt.groupBy("span").agg(F.min("pos").alias("fpos"), F.min_by("type", "pos").alias("ftype"))
    return stored(first, "first_seen")


def _number(first: DataFrame, counters: DataFrame | None, templates: Mapping[str, str]) -> DataFrame:
    """first(span, ftype, fpos) for numbered types → + ordinal, mask_text."""
    ranked = rank_within(first, "ftype", "fpos", "ordinal")
    if counters is not None:
        ranked = ranked.join(F.broadcast(counters.withColumnRenamed("entity_type", "ftype")), "ftype", "left")
        ranked = ranked.withColumn("ordinal", F.col("ordinal") + F.coalesce(F.col("counter"), F.lit(0))).drop("counter")
    return ranked.withColumn(
        "mask_text", F.concat(template_of(F.col("ftype"), templates), F.lit(" "), F.col("ordinal").cast("string"))
    )


def _without(df: DataFrame, known: DataFrame, col: str) -> DataFrame:
    """Rows of ``df`` whose ``col`` is no ``original`` of ``known``, which may hold as many texts as a corpus or a dictionary.

    Such a table is small as a compressed file, by which the planner would send it whole through the driver to every
    task; both sides are therefore sorted at every size."""
    return df.join(known.select(F.col("original").alias(col)).hint("merge"), col, "left_anti")


def _unknown(first: DataFrame, prior: DataFrame | None, counters: DataFrame | None,
             templates: Mapping[str, str]) -> tuple[DataFrame, DataFrame | None]:
    """Texts without a stored mask, and the counters to go on from (by default
    those of the stored mapping)."""
    if prior is None:
        return first, counters
    fresh = _without(first, prior, "span")
    return fresh, rebuild_counters(prior, templates) if counters is None else counters


def context_mapping(occurrences: DataFrame, id_cols: Sequence[str], counters: DataFrame | None = None,
                    templates: Mapping[str, str] | None = None, prior: DataFrame | None = None) -> DataFrame:
    """M5 mapping: one row per text whose first numbered-type occurrence
    defines ``{template} {n}`` (n = per-type order of first appearance,
    continuing stored counters).  ``original, entity_type, ordinal,
    mask_text, first_pos``.

    ``prior`` (``original, mask_text``) is the stored mapping of earlier runs:
    its texts keep their masks, so only the new rows are returned."""
    t = TYPE_TEMPLATES if templates is None else templates
    first = _first_seen(_positions(occurrences, id_cols).filter(F.col("type").isin(list(NUMBERED_TYPES))))
    first, counters = _unknown(first, prior, counters, t)
    numbered = _number(first, counters, t)
    return numbered.select(
        F.col("span").alias("original"), F.col("ftype").alias("entity_type"), "ordinal", "mask_text",
        F.col("fpos").alias("first_pos"),
    )


def context_masks(occurrences: DataFrame, id_cols: Sequence[str], counters: DataFrame | None = None,
                  templates: Mapping[str, str] | None = None, prior: DataFrame | None = None) -> DataFrame:
    """M5 per occurrence: the stored mask once the text has been numbered (in
    an earlier run, or here), else the bare template of the occurrence's own
    type (not stored)."""
    t = TYPE_TEMPLATES if templates is None else templates
    mapping = context_mapping(occurrences, id_cols, counters, t, prior)
    occ = _positions(occurrences, id_cols)
    j = occ.join(mapping.select(F.col("original").alias("span"), "mask_text", "first_pos"), "span", "left")
    masked = F.when(F.col("first_pos").isNotNull() & (F.col("pos") >= F.col("first_pos")), F.col("mask_text")).otherwise(
        template_of(F.col("type"), t)
    )
    if prior is not None:
        j = j.join(prior.select(F.col("original").alias("span"), F.col("mask_text").alias("_stored")), "span", "left")
        masked = F.coalesce("_stored", masked)
    return j.select(*id_cols, "seq", "span", "type", masked.alias("masked"))


def hybrid_mapping(occurrences: DataFrame, id_cols: Sequence[str], custom_words: DataFrame | None = None,
                   counters: DataFrame | None = None, templates: Mapping[str, str] | None = None,
                   prior: DataFrame | None = None) -> DataFrame:
    """M7 mapping: custom words first (they win and are never numbered); every
    other text is stored at its first occurrence: numbered types get
    ``{template} {n}``, other types their bare template.
    ``original, entity_type, ordinal, mask_text, is_custom, first_pos``.

    With ``prior``, the stored mapping of earlier runs, only new rows are
    returned: its texts (its custom words too) keep their masks and the
    numbers go on."""
    t = TYPE_TEMPLATES if templates is None else templates
    first = _first_seen(_positions(occurrences, id_cols))
    first, counters = _unknown(first, prior, counters, t)
    if prior is not None and custom_words is not None:
        custom_words = _without(custom_words, prior, "original")
    if custom_words is not None:
        first = _without(first, custom_words, "span")
    num = _number(first.filter(F.col("ftype").isin(list(NUMBERED_TYPES))), counters, t)
    bare = first.filter(~F.col("ftype").isin(list(NUMBERED_TYPES))).select(
        "span", "fpos", "ftype", F.lit(None).cast("long").alias("ordinal"), template_of(F.col("ftype"), t).alias("mask_text")
    )
    auto = num.select("span", "fpos", "ftype", "ordinal", "mask_text").unionByName(bare).select(
        F.col("span").alias("original"), F.col("ftype").alias("entity_type"), "ordinal", "mask_text",
        F.lit(False).alias("is_custom"), F.col("fpos").alias("first_pos"),
    )
    if custom_words is None:
        return auto
    custom = custom_words.select(
        "original", F.lit(None).cast("string").alias("entity_type"), F.lit(None).cast("long").alias("ordinal"),
        F.col("replacement").alias("mask_text"), F.lit(True).alias("is_custom"), F.lit(None).alias("first_pos"),
    )
    return custom.unionByName(auto.withColumn("first_pos", F.col("first_pos")), allowMissingColumns=True)


def custom_masks(occurrences: DataFrame, custom_words: DataFrame, salt: str | None = None, hex_len: int | None = None) -> DataFrame:
    """M6 per occurrence: the dictionary replacement, else a stable
    ``__CUSTOM_{8 hex}__`` derived from the word (the same word always gets
    the same replacement, in every text; no two words and no stored
    replacement share one).  Pass a secret ``salt``: without one, short words
    can be guessed back from their hash."""
    missed = custom_delta(occurrences, custom_words, salt, hex_len)
    d = custom_words.select("original", "replacement").unionByName(missed).select(F.col("original").alias("span"), F.col("replacement").alias("masked"))
    return occurrences.join(d, "span", "left")


def custom_delta(occurrences: DataFrame, custom_words: DataFrame, salt: str | None = None, hex_len: int | None = None) -> DataFrame:
    """M6: the remembered misses, ``original, replacement``: rows to add to the
    dictionary so that their masks can be restored.  A mask that two misses
    share, or that the dictionary holds, is given to one word only, by the
    rounds that settle colliding tokens (:func:`vault.resolve_collisions`)."""
    from .vault import resolve_collisions

    words = occurrences.select(F.col("span").alias("original")).distinct()
    missed = words.join(custom_words.select("original"), "original", "left_anti")
    new = stored(missed.select(C.custom_token("original", salt, hex_len).alias("token"), "original", F.lit("").alias("entity_type")), "custom_misses")
    held = custom_words.select(F.col("replacement").alias("token"), "original", F.lit("").alias("entity_type"))
    settled = resolve_collisions(new, "", held, hex_len=hex_len, retoken=lambda k, digits: C.custom_token("original", salt, digits, k))
    return settled.select("original", F.col("token").alias("replacement"))


def reverse_mapping(mapping: DataFrame, order_col: str = "seq") -> DataFrame:
    """V6: mask → original; when several originals share a mask, the last
    inserted wins (``order_col`` = insertion order).  ``n_originals`` > 1
    marks masks that cannot be restored unambiguously (Q4)."""
    return mapping.groupBy("mask_text").agg(
        F.max_by("original", order_col).alias("original"), F.countDistinct("original").cast("long").alias("n_originals")
    )


# ---------------------------------------------------------------------------
# masking with a stored mapping, and M8: restoring it
# ---------------------------------------------------------------------------

def mask_with_mapping(docs: DataFrame, text_col: str, id_cols: Sequence[str], occurrences: DataFrame,
                      mapping: DataFrame, out_col: str = "masked") -> DataFrame:
    """Replace each text's entity occurrences (in ``seq`` order) by their
    stored mask (``mapping``: original → mask_text).  The per-text
    replacement list is built from small entity rows (join on the text,
    regroup by text key) and joined back to the texts once."""
    occ = occurrences.select(*id_cols, "seq", "span").join(
        mapping.select(F.col("original").alias("span"), F.col("mask_text").alias("repl")), "span", "inner"
    )
    per_text = occ.groupBy(*id_cols).agg(
        F.array_sort(F.collect_list(F.struct("seq", "span", "repl"))).alias("_o")
    )
    j = docs.select(*id_cols, F.col(text_col).alias("_t")).join(per_text, list(id_cols), "left")
    pairs = C.placeholder_pairs(F.transform(F.coalesce("_o", F.array().cast("array<struct<seq:long,span:string,repl:string>>")),
                                            lambda o: F.struct(o["span"].alias("span"), o["repl"].alias("repl"))))
    folded = C.let(pairs, lambda p: F.when(F.size(p) == 0, F.col("_t")).otherwise(C.fold_pairs("_t", p)))  # the pairs once a text
    return j.select(*id_cols, folded.alias(out_col))


def numbered_mask_re(templates: Mapping[str, str] | None = None) -> str:
    t = TYPE_TEMPLATES if templates is None else templates
    import re as _re

    alts = "|".join(_re.escape(t[ty]) for ty in NUMBERED_TYPES if t.get(ty))
    return f"(?:{alts}) [0-9]+"


def unmask_hybrid(masked: DataFrame, text_col: str, id_cols: Sequence[str], reverse: DataFrame,
                  custom_words: DataFrame | None = None, templates: Mapping[str, str] | None = None,
                  out_col: str = "restored") -> DataFrame:
    """M8: put originals back for every mask that maps to exactly one
    original (V6 ``n_originals == 1``); shared masks (bare templates) stay.

    Numbered masks are found with one regex (greedy digits, so ``某人 1``
    never eats the start of ``某人 10``) and resolved like tokens
    (:func:`restore.replace_matches`).  Custom replacements are then reversed
    with the dictionary operator, longest first (``客户1`` cannot break ``客户12``).
    """
    from .restore import replace_matches
    from .words import apply_custom_words

    inj = reverse.filter(F.col("n_originals") == 1).select(F.col("mask_text").alias("mask"), "original")
    t = TYPE_TEMPLATES if templates is None else templates
    heads = [f"{t[ty]} " for ty in NUMBERED_TYPES if t.get(ty)]
    out = replace_matches(masked, {text_col: out_col}, numbered_mask_re(templates), inj, id_cols, heads)
    if custom_words is None:
        return out
    back = custom_words.join(inj.select(F.col("mask").alias("replacement"), "original"), ["replacement", "original"], "left_semi")
    reverse_words = back.select(
        F.col("replacement").alias("original"), F.col("original").alias("replacement"),
        (-F.char_length("replacement") * F.lit(1 << 40) + F.col("priority")).cast("long").alias("priority"),
    )
    return apply_custom_words(out, out_col, reverse_words, out_col=out_col, keep_cols=[*id_cols, out_col])
