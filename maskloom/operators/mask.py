"""Masking operators (inventory R1–R3, R9, M10 wiring).

``mask_text`` is one narrow projection over the documents: detection, token
generation and the two-phase literal replacement all happen inside the row,
because tokens are a pure function of (salt, type, span).  Nothing about the
texts is shuffled.  The vault delta is a separate, pre-aggregated distinct.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.patterns import REGEX_REGISTRY


def _tokenize(ents: Column, salt: str) -> Column:
    """array<struct<span,type>> → array<struct<span,type,repl>> with tokens."""
    return F.transform(
        ents,
        lambda e: F.struct(
            e["span"].alias("span"), e["type"].alias("type"), C.token(e["type"], e["span"], salt).alias("repl")
        ),
    )


def entity_column(
    text: str | Column,
    registry: Mapping[str, str] | None = None,
    model_col: str | None = None,
    has_digit: Column | None = None,
) -> Column:
    """R1 detection list: model entities first (if any), then regex entities.

    Exact (span, type) repeats are dropped (first kept): a repeated span is a
    no-op in the literal fold, so this only shortens the array.
    """
    reg = REGEX_REGISTRY if registry is None else registry
    arr = C.regex_entities(text, reg, has_digit)
    if model_col is not None:
        model = F.transform(
            F.coalesce(F.col(model_col), F.array().cast(f"array<{C.ENTITY_STRUCT}>")),
            lambda e: F.struct(e["span"].alias("span"), e["type"].alias("type")),
        )
        arr = F.concat(model, arr)
    return F.array_distinct(arr)


def _key(span: Column, entity_type: Column) -> Column:
    return F.concat_ws("\u0000", entity_type, span)


def token_pairs(ents: Column, salt: str, lookup: Column | None = None) -> Column:
    """Entities → placeholder pairs (span, token, ph), ready for the fold.

    ``lookup`` (map<type\0span, token>) supplies the tokens of collision
    losers; everything else gets the plain hash token.
    """

    def tok(e: Column) -> Column:
        plain = C.token(e["type"], e["span"], salt)
        return plain if lookup is None else F.coalesce(F.element_at(lookup, _key(e["span"], e["type"])), plain)

    return C.placeholder_pairs(ents, tok)


def mask_text(
    docs: DataFrame,
    text_col: str,
    id_cols: Sequence[str],
    salt: str,
    registry: Mapping[str, str] | None = None,
    model_col: str | None = None,
    custom_words: DataFrame | None = None,
    overrides: DataFrame | None = None,
    keep_cols: Sequence[str] = (),
    out_col: str = "masked",
    with_entities: bool = True,
) -> DataFrame:
    """``ids…, masked, n_entities, entities`` per text.

    ``entities`` (array<struct<span,type>>) is kept so the vault delta can be
    derived without re-running detection.  With ``custom_words`` the ordered
    dictionary (R9) is applied to each text first.

    ``overrides`` (original, entity_type, token) are the collision losers of
    :func:`vault.plan_tokens`: the small exploded entity rows are joined with
    them and each text's map is joined back by key.  This shuffles ``docs``,
    so jobs pass only the texts that hold a loser.
    """
    keep = [c for c in keep_cols if c not in id_cols]
    src = docs
    txt = F.col(text_col)
    if custom_words is not None:
        from .words import apply_custom_words

        src = apply_custom_words(docs, text_col, custom_words, out_col="_cw_text")
        txt = F.col("_cw_text")
    model = [model_col] if model_col else []
    with_ents = src.select(*id_cols, *keep, *model, txt.alias("_text"), C.digit_flag(txt).alias("_dig")).withColumn(
        "entities", entity_column(F.col("_text"), registry, model_col, F.col("_dig"))
    ).drop("_dig")
    lookup = None
    if overrides is not None:
        ents = C.posexplode_rows(with_ents, id_cols, F.col("entities"), "_seq", "e")
        hits = ents.join(
            overrides.select(F.col("original").alias("_o"), F.col("entity_type").alias("_t"), "token"),
            (F.col("e.span") == F.col("_o")) & (F.col("e.type") == F.col("_t")),
        )
        per_text = hits.groupBy(*id_cols).agg(
            # rows of one id may hold the same loser
            F.map_from_entries(F.collect_set(F.struct(_key(F.col("_o"), F.col("_t")), F.col("token")))).alias("_lookup")
        )
        with_ents = C.join_keys(with_ents, per_text, list(id_cols), "left")
        lookup = F.col("_lookup")
    with_pairs = with_ents.withColumn("_pairs", token_pairs(F.col("entities"), salt, lookup))
    extra = [F.size("entities").cast("long").alias("n_entities"), F.col("entities")] if with_entities else []
    return with_pairs.select(
        *id_cols,
        *keep,
        F.when(F.size("_pairs") == 0, F.col("_text")).otherwise(C.fold_pairs("_text", F.col("_pairs"))).alias(out_col),
        *extra,
    )


def mask_parts(text: Column, salt: str, registry: Mapping[str, str] | None = None) -> Column:
    """R1 as one expression, ``struct<masked, entities>``, for use inside other
    expressions (per paragraph in ``transform``); detection is evaluated once."""

    def masked(ents: Column) -> Column:
        done = F.when(F.size(ents) == 0, text).otherwise(C.fold_pairs(text, token_pairs(ents, salt)))
        return F.struct(done.alias("masked"), ents.alias("entities"))

    return C.let(entity_column(text, registry), masked)


def entities_of(masked: DataFrame, id_cols: Sequence[str]) -> DataFrame:
    """Exploded ``ids…, seq, span, type`` from the ``entities`` array of ``mask_text``."""
    return C.posexplode_rows(masked, id_cols, F.col("entities"), "seq", "e").select(
        *id_cols, "seq", F.col("e.span").alias("span"), F.col("e.type").alias("type")
    )


# ---------------------------------------------------------------------------
# Span-safe replacement
# ---------------------------------------------------------------------------

_KEPT = "array<struct<start:int,end:int,span:string,type:string>>"


def mask_spans(
    docs: DataFrame,
    text_col: str,
    id_cols: Sequence[str],
    salt: str,
    registry: Mapping[str, str] | None = None,
) -> DataFrame:
    """Replace each match only at its own offsets (no literal re-matching).

    Overlaps are resolved by (start, longest, registry order): the per-text
    entity array is sorted on that key and swept once, keeping an entity only
    if it starts at or after the end of the last kept one.  Narrow: offsets,
    sweep and rebuild all happen inside the row.
    """
    from .detect import with_offset_entities

    base = docs.select(*id_cols, F.col(text_col).alias("_text"))
    withe = with_offset_entities(base, "_text", [*id_cols, "_text"], registry, out_col="ents")
    order = F.array_sort(
        F.transform(
            F.col("ents"),
            lambda e, i: F.struct(
                e["start"].alias("start"), (-e["end"]).alias("neg_end"), i.alias("rank"),
                e["end"].alias("end"), e["span"].alias("span"), e["type"].alias("type"),
            ),
        )
    )
    def sweep(part: Column, cut: Column) -> Column:
        """Kept entities of a run of ``order`` and the end of the last one."""
        return F.aggregate(
            part,
            F.struct(cut.alias("cut"), F.array().cast(_KEPT).alias("k")),
            lambda acc, e: F.when(
                e["start"] >= acc["cut"],
                F.struct(
                    e["end"].alias("cut"),
                    F.concat(
                        acc["k"],
                        F.array(F.struct(e["start"].alias("start"), e["end"].alias("end"),
                                         e["span"].alias("span"), e["type"].alias("type"))),
                    ).alias("k"),
                ),
            ).otherwise(acc),
        )

    def swept(parts: Column) -> Column:
        return F.aggregate(
            parts,
            F.struct(F.lit(0).alias("cut"), F.array().cast(_KEPT).alias("k")),
            lambda acc, part: C.let(
                sweep(part, acc["cut"]), lambda s: F.struct(s["cut"].alias("cut"), F.concat(acc["k"], s["k"]).alias("k"))
            ),
            lambda acc: acc["k"],
        )

    short = lambda a: F.size(a) <= C.SCAN_BLOCK
    kept = C.let(order, lambda o: F.when(short(o), sweep(o, F.lit(0))["k"]).otherwise(swept(C.blocks(o))))
    planned = withe.select(*id_cols, "_text", kept.alias("kept"))

    def rebuilt(part: Column, base: Column) -> Column:
        """Gap and token of each entity of ``part``, whose text starts at ``base``."""
        segment = F.col("_text").substr(base + 1, F.element_at(part, -1)["end"] - base)  # cut once, then short pieces of it

        def pieces(seg: Column) -> Column:
            end = lambda i: F.when(i == 0, base).otherwise(F.get(part, i - 1)["end"])
            return F.transform(
                part, lambda e, i: F.concat(seg.substr(end(i) - base + 1, e["start"] - end(i)), C.token(e["type"], e["span"], salt))
            )

        return F.array_join(C.let(segment, pieces), "")

    before = lambda b: F.when(b == 0, F.lit(0)).otherwise(F.get(F.col("kept"), b * C.SCAN_BLOCK - 1)["end"])
    pieces = F.transform(C.blocks(F.col("kept")), lambda part, b: C.let(before(b), lambda base: rebuilt(part, base)))
    masked = F.when(short("kept"), rebuilt(F.col("kept"), F.lit(0))).otherwise(F.array_join(pieces, ""))
    last_end = F.coalesce(F.element_at(F.col("kept"), -1)["end"], F.lit(0))
    tail = F.col("_text").substr(last_end + 1, F.lit(2147483647))
    return planned.select(
        *id_cols,
        F.when(F.col("_text").isNull(), F.lit(None).cast("string"))
        .when(F.size("kept") == 0, F.col("_text"))
        .otherwise(F.concat(masked, tail))
        .alias("masked"),
        F.size("kept").cast("long").alias("n_replaced"),
    )
