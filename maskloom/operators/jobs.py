"""Whole mask jobs: detection, collision-free tokens, replacement, vault rows.

A job's outputs are tables in the shared scratch folder; the texts are read
once to be masked and once more only where they hold a collision loser.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..session import stored
from ..sources import files
from . import documents as docops
from . import mask, vault


def with_model_entities(docs: DataFrame, id_cols: Sequence[str], entities: DataFrame, out_col: str = "_model") -> DataFrame:
    """``docs`` with the array of their model entities (``ids…, seq, span, type``) in ``seq`` order.

    Groups small entity rows by text (a text's own entities, no more); texts without any keep a null.
    """
    rows = F.array_sort(F.collect_list(F.struct("seq", "span", "type")))
    per_text = entities.groupBy(*id_cols).agg(rows.alias("_a")).select(
        *id_cols, F.transform("_a", lambda e: F.struct(e["span"].alias("span"), e["type"].alias("type"))).alias(out_col)
    )
    return C.join_keys(docs, per_text, list(id_cols), "left")


def check_types(entities: DataFrame) -> None:
    """Refuse types that the token grammar cannot hold, before anything is masked."""
    bad = entities.where(~F.coalesce(F.col("type").rlike(r"\A[A-Za-z]+\z"), F.lit(False))).select("type").head()
    if bad is not None:
        raise ValueError(f"entity type {bad['type']!r} cannot be written in a token; alias it to ASCII letters")


def admit_scored(docs: DataFrame, id_cols: Sequence[str], scored: DataFrame, on_error: str = "fail") -> tuple[DataFrame, DataFrame]:
    """``(texts to mask, texts held back)`` by the ``error`` column of scored chunks.

    A text with a failed chunk would leave with its names in clear.  ``fail``
    ends the job, ``quarantine`` holds such texts back.
    """
    if on_error not in ("fail", "quarantine"):
        raise ValueError("on_error must be 'fail' or 'quarantine'")
    failed = stored(scored.where("error is not null").groupBy(*id_cols).agg(F.min("error").alias("error")), "failed_texts")
    first = failed.head()
    if first is not None and on_error == "fail":
        raise RuntimeError(f"the model failed on {failed.count()} texts, first: {first['error']}")
    return C.join_keys(docs, failed, list(id_cols), "left_anti"), C.join_keys(docs, failed, list(id_cols), "left_semi")


def mask_job(
    docs: DataFrame,
    id_cols: Sequence[str],
    salt: str,
    text_col: str = "text",
    prior_vault: DataFrame | vault.CommittedVault | None = None,
    model_entities: DataFrame | None = None,
    custom_words: DataFrame | None = None,
    registry: Mapping[str, str] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """The full mask job: ``(masked texts, new vault rows)``, both stored.

    One detection pass: texts are masked with the plain hash tokens and their
    entity arrays stored alongside (``model_entities`` go before the pattern
    matches, ``custom_words`` are applied first).  The vault is planned from
    those stored entities (distinct pairs only).  Texts holding a collision
    loser — a tiny set — are masked again from their source with the override
    tokens and replace their first version.
    """
    keys, model = list(id_cols), None
    if model_entities is not None:
        model = "_model"
        model_entities = stored(model_entities.select(*keys, "seq", "span", "type"), "model_entities")
        check_types(model_entities)
        docs = with_model_entities(docs, keys, model_entities, model)
    options = {"registry": registry, "model_col": model, "custom_words": custom_words}
    first = stored(mask.mask_text(docs, text_col, keys, salt, **options), "masked_first")

    def again(hits: DataFrame, over: DataFrame) -> DataFrame:
        return mask.mask_text(C.join_keys(docs, hits, keys, "left_semi"), text_col, keys, salt, overrides=over, **options)

    return _settle(first, keys, salt, prior_vault, again)


def mask_items_job(
    items: DataFrame,
    keys: Sequence[str],
    salt: str,
    fields: Sequence[str] = ("text", "title"),
    prior_vault: DataFrame | vault.CommittedVault | None = None,
    registry: Mapping[str, str] | None = None,
    scope: str = "item",
) -> tuple[DataFrame, DataFrame]:
    """The mask job over content-list items: ``(masked items, new vault rows)``.

    Each field is masked with its own entities (``scope="document"``: with
    those of its document); all other columns pass through.
    """
    options = {"fields": fields, "keys": tuple(keys), "registry": registry, "with_entities": True, "scope": scope}
    first = stored(docops.mask_document(items, salt, **options), "masked_items")

    def again(hits: DataFrame, over: DataFrame) -> DataFrame:
        # the other items of a document add to its entities
        shared = keys[:1] if scope == "document" else keys
        again_ = docops.mask_document(C.join_keys(items, hits.select(*shared).distinct(), list(shared), "left_semi"), salt, over, **options)
        return C.join_keys(again_, hits, list(keys), "left_semi")

    masked, delta = _settle(first, list(keys), salt, prior_vault, again)
    return masked.select(*items.columns), delta


def mask_markdown_job(
    docs: DataFrame,
    id_cols: Sequence[str],
    salt: str,
    md_col: str = "md",
    prior_vault: DataFrame | vault.CommittedVault | None = None,
    registry: Mapping[str, str] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """The mask job over Markdown documents: ``(ids…, masked; new vault rows)``."""
    keys, options = list(id_cols), {"registry": registry, "with_entities": True}
    first = stored(docops.mask_markdown(docs, md_col, keys, salt, **options), "masked_markdown")

    def again(hits: DataFrame, over: DataFrame) -> DataFrame:
        return docops.mask_markdown(C.join_keys(docs, hits, keys, "left_semi"), md_col, keys, salt, over, **options)

    masked, delta = _settle(first, keys, salt, prior_vault, again)
    return masked.drop("entities"), delta


def mask_files(items: DataFrame, salt: str, out_dir: str, prior_vault: DataFrame | vault.CommittedVault | None = None) -> tuple[DataFrame, DataFrame]:
    """Mask the items of files or saved content lists (:mod:`..sources.files`)
    and write their Markdown and content lists; ``(masked items, new vault rows)``."""
    masked, delta = mask_items_job(items, files.ITEM_KEYS, salt, prior_vault=prior_vault)
    files.write_outputs(files.gather_items(masked), out_dir, "masked")
    return masked, delta


def unmask_files(originals: DataFrame, saved: DataFrame, vault_rows: DataFrame, out_dir: str) -> DataFrame:
    """Restore the saved masked items, or the original ones of a document
    without, and write Markdown and content lists; the restored items."""
    chosen = files.choose_unmask_source(originals, saved, ["path"]).drop("source")
    gathered = files.gather_items(docops.unmask_document(chosen, vault_rows, keys=files.ITEM_KEYS))
    files.write_outputs(gathered, out_dir, "unmasked")
    return files.gathered_rows(gathered).select(*chosen.columns)


def _settle(
    first: DataFrame, keys: list[str], salt: str, prior_vault: DataFrame | vault.CommittedVault | None, again: Callable[[DataFrame, DataFrame], DataFrame]
) -> tuple[DataFrame, DataFrame]:
    """Plan the vault from the entities of a first pass; ``again(keys, overrides)``
    masks the rows that hold a collision loser, which replace their first version."""
    ents = mask.entities_of(first, keys)
    assignments, delta = vault.plan_tokens(ents, salt, prior_vault)
    over = stored(vault.overrides_of(assignments, salt), "overrides")
    if over.isEmpty():
        return first, delta
    losers = over.select(F.col("original").alias("span"), F.col("entity_type").alias("type"))
    hits = stored(ents.join(losers, ["span", "type"], "left_semi").select(*keys).distinct(), "override_hits")
    redo = stored(again(hits, over), "masked_redo")
    return C.join_keys(first, hits, keys, "left_anti").unionByName(redo), delta
