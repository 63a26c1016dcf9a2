"""Content lists and Markdown (inventory R4–R7, U3, U4, K1).

Items are one row each (``doc_id, item_idx, type, text, title, page``); a
Markdown document is one string.  Masking happens inside each row — every
field, every paragraph — so nothing is regrouped to mask.  Only the two
per-document renderings (joined pass-1 text, Markdown output) gather a
document's items, and a document's items are exactly one source document.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.patterns import PARAGRAPH_SEP_RE, REGEX_REGISTRY
from . import mask, restore

ITEM_KEYS = ("doc_id", "item_idx")
_NONBLANK = r"(?U)\S"


def mask_document(items: DataFrame, salt: str, overrides: DataFrame | None = None,
                  fields: Sequence[str] = ("text", "title"), keys: Sequence[str] = ITEM_KEYS,
                  registry: Mapping[str, str] | None = None, with_entities: bool = False,
                  scope: str = "item") -> DataFrame:
    """Mask ``text`` and ``title`` of every item with the entities found
    in that field (empty and null fields stay as they are); other columns
    pass through untouched.  Item order is the key, never completion order.
    ``with_entities`` adds the ``entities`` array of all fields.

    ``scope="document"`` masks every field with the entities of its whole
    document (the first of ``keys``), so one found in one item is masked in
    all others: see :func:`document_entities`.
    """
    if scope not in ("item", "document"):
        raise ValueError("scope must be 'item' or 'document'")
    if scope == "document":
        return _mask_by_document(items, salt, overrides, fields, keys, registry, with_entities)
    cols = items.columns
    out = items.withColumn("_all", F.array().cast(f"array<{C.ENTITY_STRUCT}>"))
    for f in fields:
        others = [c for c in out.columns if c not in keys and c != f]
        out = mask.mask_text(out, f, list(keys), salt, registry=registry, overrides=overrides, keep_cols=others, out_col=f)
        out = out.withColumn("_all", F.concat("_all", "entities")).drop("entities", "n_entities")
    return out.select(*cols, *([F.array_distinct("_all").alias("entities")] if with_entities else []))


def document_entities(items: DataFrame, fields: Sequence[str] = ("text", "title"), keys: Sequence[str] = ITEM_KEYS,
                      registry: Mapping[str, str] | None = None) -> DataFrame:
    """``document key, entities``: the distinct entities of all fields of a document, in the
    order of their types in the registry, then of items, fields and places.

    Only entity rows are gathered, no texts; a document's list is no longer
    than its own entities.
    """
    reg = REGEX_REGISTRY if registry is None else registry
    doc = keys[0]
    found = None
    for n, f in enumerate(fields):
        arr = items.select(*keys, F.array_distinct(C.regex_entities(f, reg)).alias("_e"))
        rows = C.posexplode_rows(arr, keys, F.col("_e"), "_seq", "e").select(*keys, F.lit(n).alias("_field"), "_seq", "e")
        found = rows if found is None else found.unionByName(rows)
    rank = F.array_position(F.array(*[F.lit(t) for t in reg]), F.col("e.type"))
    place = F.struct(rank.alias("rank"), *[F.col(k) for k in keys[1:]], "_field", "_seq")
    first = found.groupBy(doc, "e").agg(F.min(place).alias("at"))
    lists = first.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct("at", "e"))).alias("_a"))
    return lists.select(doc, F.transform("_a", lambda x: x["e"]).alias("entities"))


def _mask_by_document(items: DataFrame, salt: str, overrides: DataFrame | None, fields: Sequence[str], keys: Sequence[str],
                      registry: Mapping[str, str] | None, with_entities: bool) -> DataFrame:
    doc, cols = keys[0], items.columns
    lists = document_entities(items, fields, keys, registry)
    if overrides is not None:
        rows = C.posexplode_rows(lists, [doc], F.col("entities"), "_seq", "e").select(doc, "_seq", "e.span", "e.type")
        over = overrides.select(F.col("original").alias("span"), F.col("entity_type").alias("type"), "token")
        rows = rows.join(over, ["span", "type"], "left").select(doc, F.struct("_seq", "span", "type", "token").alias("r"))
        lists = rows.groupBy(doc).agg(F.array_sort(F.collect_list("r")).alias("entities"))
    else:
        token = lambda e: F.struct(e["span"].alias("span"), e["type"].alias("type"), F.lit(None).cast("string").alias("token"))
        lists = lists.select(doc, F.transform("entities", token).alias("entities"))
    pair = lambda e: F.struct(e["span"].alias("span"), F.coalesce(e["token"], C.token(e["type"], e["span"], salt)).alias("repl"))
    lists = lists.select(doc, C.placeholder_pairs(F.transform("entities", pair)).alias("_pairs"), F.transform("entities", lambda e: F.struct(e["span"].alias("span"), e["type"].alias("type"))).alias("_ents"))
    out = C.join_keys(items, lists, [doc], "left")
    holds = lambda e: reduce(or_, [F.coalesce(F.contains(F.col(f), e["span"]), F.lit(False)) for f in fields])
    none = F.array().cast(f"array<{C.ENTITY_STRUCT}>")
    out = out.withColumn("_ents", F.filter(F.coalesce("_ents", none), holds))  # of the document's, those of this item
    for f in fields:
        out = out.withColumn(f, F.when(F.col("_pairs").isNull(), F.col(f)).otherwise(C.fold_pairs(f, F.col("_pairs"))))
    return out.select(*cols, *([F.col("_ents").alias("entities")] if with_entities else []))


def document_text(items: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Per document every non-empty ``text`` then ``title`` followed by
    a blank line, in item order (the text a whole-document scan sees)."""
    piece = F.concat(
        F.when(F.coalesce(F.char_length("text"), F.lit(0)) > 0, F.concat(F.col("text"), F.lit("\n\n"))).otherwise(F.lit("")),
        F.when(F.coalesce(F.char_length("title"), F.lit(0)) > 0, F.concat(F.col("title"), F.lit("\n\n"))).otherwise(F.lit("")),
    )
    return _gather(items, keys, piece, "all_text")


def markdown_piece(of: Callable[[str], Column] = F.col) -> Column:
    """K1 of one item; ``of``: a column of the item by its name."""
    return F.when(
        of("type") == "title", F.concat(F.lit("# "), F.coalesce(of("title"), F.lit("")), F.lit("\n\n"))
    ).otherwise(F.concat(F.coalesce(of("text"), F.lit("")), F.lit("\n\n")))


def render_markdown(items: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """K1: ``# {title}\\n\\n`` for title items, else ``{text}\\n\\n`` (null → empty)."""
    return _gather(items, keys, markdown_piece(), "markdown")


def _gather(items: DataFrame, keys: Sequence[str], piece: Column, out: str) -> DataFrame:
    parts = items.select(*keys, F.struct(F.col("item_idx"), piece.alias("p")).alias("_s"))
    agg = parts.groupBy(*keys).agg(F.array_sort(F.collect_list("_s")).alias("_a"))
    return agg.select(*keys, F.array_join(F.transform("_a", lambda s: s["p"]), "").alias(out))


def paragraphs(docs: DataFrame, md_col: str, id_cols: Sequence[str]) -> DataFrame:
    """``ids…, para_idx, text`` for the non-blank paragraphs (blank lines
    and the separators themselves are not paragraphs)."""
    rows = C.posexplode_rows(docs, id_cols, F.split(F.col(md_col), PARAGRAPH_SEP_RE, -1), "para_idx", "text")
    return rows.filter(F.col("text").rlike(_NONBLANK))


def mask_markdown(docs: DataFrame, md_col: str, id_cols: Sequence[str], salt: str, overrides: DataFrame | None = None,
                  out_col: str = "masked", registry: Mapping[str, str] | None = None, with_entities: bool = False) -> DataFrame:
    """Mask each paragraph on its own; separators and blank paragraphs
    are untouched and the document is re-joined exactly.  Narrow: the
    paragraphs never leave their row, unless there are collision
    ``overrides`` (jobs pass only the documents that hold a loser).
    ``with_entities`` adds the ``entities`` array of all paragraphs.
    """
    if overrides is not None:
        out = _mask_markdown_rows(docs, md_col, id_cols, salt, overrides, out_col, registry)
        return out if with_entities else out.drop("entities")
    md = F.col(md_col)
    nothing = F.array().cast(f"array<{C.ENTITY_STRUCT}>")
    blank = lambda p: F.struct(p.alias("masked"), nothing.alias("entities"))
    done = F.transform(
        F.split(md, PARAGRAPH_SEP_RE, -1),
        lambda p: F.when(p.rlike(_NONBLANK), mask.mask_parts(p, salt, registry)).otherwise(blank(p)),
    )
    rows = docs.select(*id_cols, done.alias("_done"), F.regexp_extract_all(md, F.lit(PARAGRAPH_SEP_RE), 0).alias("_seps"))
    joined = F.array_join(F.zip_with("_done", "_seps", lambda p, s: F.concat(p["masked"], F.coalesce(s, F.lit("")))), "")
    ents = F.coalesce(F.array_distinct(F.flatten("_done.entities")), nothing)
    return rows.select(*id_cols, joined.alias(out_col), *([ents.alias("entities")] if with_entities else []))


def _mask_markdown_rows(docs: DataFrame, md_col: str, id_cols: Sequence[str], salt: str, overrides: DataFrame,
                        out_col: str, registry: Mapping[str, str] | None) -> DataFrame:
    """R6 with collision overrides: the paragraphs (with their following
    separator) become rows, are masked by :func:`mask.mask_text`, and are
    re-joined per document in paragraph order.  Blank paragraphs hold no
    match, so masking them is a no-op."""
    parts = F.split(F.col(md_col), PARAGRAPH_SEP_RE, -1)
    seps = F.regexp_extract_all(F.col(md_col), F.lit(PARAGRAPH_SEP_RE), 0)
    zipped = docs.select(*id_cols, F.arrays_zip(parts.alias("p"), seps.alias("s")).alias("_z"))
    rows = C.posexplode_rows(zipped, id_cols, F.col("_z"), "_pi", "z").select(
        *id_cols, "_pi", F.col("z.p").alias("_p"), F.coalesce(F.col("z.s"), F.lit("")).alias("_s")
    )
    masked = mask.mask_text(rows, "_p", [*id_cols, "_pi"], salt, registry, overrides=overrides, keep_cols=["_s"], out_col="_m")
    part = F.struct("_pi", F.concat("_m", "_s").alias("x"), F.col("entities").alias("e"))
    agg = masked.groupBy(*id_cols).agg(F.array_sort(F.collect_list(part)).alias("_a"))
    text = F.array_join(F.transform("_a", lambda e: e["x"]), "")
    out = agg.select(*id_cols, text.alias(out_col), F.array_distinct(F.flatten("_a.e")).alias("entities"))
    nulls = docs.filter(F.col(md_col).isNull()).select(
        *id_cols, F.col(md_col).alias(out_col), F.array().cast(f"array<{C.ENTITY_STRUCT}>").alias("entities")
    )
    return out.unionByName(nulls)


def unmask_document(items: DataFrame, vault: DataFrame, fields: Sequence[str] = ("text", "title"),
                    keys: Sequence[str] = ITEM_KEYS) -> DataFrame:
    """Restore ``text`` and ``title`` of every item with one lookup per item."""
    cols = items.columns
    out = restore.unmask_columns(items, {f: f for f in fields}, list(keys), vault, keep_cols=cols)
    return out.select(*cols)


def unmask_markdown(docs: DataFrame, md_col: str, id_cols: Sequence[str], vault: DataFrame,
                    out_col: str = "restored") -> DataFrame:
    """U4: tokens never span a separator and blank paragraphs hold none, so a
    single pass over the whole string equals the per-paragraph restore."""
    return restore.unmask_text(docs, md_col, id_cols, vault, out_col=out_col)
