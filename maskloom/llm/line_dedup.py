"""Line deduplication by global digests.

A text's units are its lines.  A unit is normalised (A-Z lower-cased,
runs of white space one blank, none at the ends) and digested to 128 bits.  Of
all units with one digest the earliest stays: smallest doc_id, then the row's
place in the input, then the unit's place in the text.  All others go, from
whichever document; what stays keeps its original text, and every removed unit
its original code point offsets and the document that keeps it.  Units of fewer
than ``MIN_WORDS`` words are never removed.

Only ids and digests are shuffled to find repeats: a digest's first occurrence
is an aggregate (combined before the shuffle) joined back, so a line that a
third of the documents share is split by the join, not gathered.

Nulls: a null text has no units and stays null; rows with a null doc_id rank
last.  Repeated rows are told apart by their place: all but the first lose
their units.  A text whose units all go becomes empty.  Extra columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .common import boxed, lower_ascii, not_space, pieces, text_bytes, unboxed, word_spans
from .xxh64 import xxh64_spans

MIN_WORDS = 5
_UNIT_SCHEMA = "row long, doc_id long, unit int, start int, end int, h1 long, h2 long"


def _units(data: np.ndarray, offsets: np.ndarray, min_words: int):
    """Of texts laid end to end, every line of enough words: its text, number,
    code point borders and digest."""
    n = len(offsets) - 1
    buf = lower_ascii(np.insert(data, offsets[1:], 10))  # a line break closes every text
    close = offsets[1:] + np.arange(n)
    end = np.flatnonzero(buf == 10)
    begin = np.r_[0, end[:-1] + 1]
    doc = np.searchsorted(close, end)
    number = np.arange(len(end)) - np.searchsorted(doc, doc)
    is_word = not_space(buf)
    starts, ends, _ = word_spans(is_word, np.array([0, len(buf)]))
    size = ends - starts
    to = np.cumsum(size + 1) - (size + 1)
    joined = np.full(int((size + 1).sum()), 32, np.uint8)  # all words with one blank between
    slots = np.ones(len(joined), bool)
    slots[to + size] = False
    joined[slots] = buf[is_word]
    a, b = np.searchsorted(starts, begin), np.searchsorted(starts, end)
    keep = np.flatnonzero(b - a >= min_words)
    a, b, doc, number = a[keep], b[keep], doc[keep], number[keep]
    chars = np.r_[0, np.cumsum((buf & 0xC0) != 0x80)]
    base = chars[np.r_[0, close + 1][doc]]
    digest = [xxh64_spans(joined, to[a], to[b - 1] + size[b - 1], seed).view(np.int64) for seed in (1, 2)]
    return doc, [x.astype(np.int32) for x in (number, chars[begin[keep]] - base, chars[end[keep]] - base)], digest


def _unit_batches(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(2))
            for i, j in pieces(offsets):
                doc, places, digest = _units(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], min_words)
                own = [batch.column(c).take(pa.array(doc + i)) for c in (0, 1)]
                yield pa.RecordBatch.from_arrays([*own, *map(pa.array, places), *map(pa.array, digest)], ["row", "doc_id", "unit", "start", "end", "h1", "h2"])

    return run


def repeated_lines(rows: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``row, unit, start, end, kept_doc``: every line that repeats an earlier one.

    ``rows`` has ``row`` (the place of the row), ``doc_id`` and ``text``.
    """
    units = rows.select("row", F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    units = stored(units.mapInArrow(_unit_batches(min_words), _UNIT_SCHEMA), "line_units")
    rank = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row", "unit")
    first = units.groupBy("h1", "h2").agg(F.min(rank).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    again = units.join(first, ["h1", "h2"])
    return again.where((F.col("row") != F.col("first.row")) | (F.col("unit") != F.col("first.unit"))).select(
        "row", "unit", "start", "end", F.col("first.doc_id").alias("kept_doc")
    )


def _cut_batches(text_at: int, gone_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, units = batch.column(text_at).to_pylist(), []
            for i, gone in enumerate(batch.column(gone_at)):
                if texts[i] is None:
                    units.append(0)
                    continue
                lines = texts[i].split("\n")
                units.append(len(lines))
                if gone.is_valid and len(gone):
                    out = {g["unit"] for g in gone.as_py()}
                    texts[i] = "\n".join(x for k, x in enumerate(lines) if k not in out)
            columns = batch.columns
            columns[text_at] = pa.array(texts, batch.schema.field(text_at).type)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(units, pa.int64())], [*batch.schema.names, "n_units"])

    return run


_ADDED = ("n_units", "removed", "n_removed")


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with repeated lines cut from ``text``, and ``n_units``, ``n_removed`` and
    ``removed`` (``unit, start, end, kept_doc`` of each, in order; offsets in the original text).

    An own column with one of these three names is refused with an error;
    columns of any other name pass through."""
    clash = [c for c in docs.columns if c.lower() in _ADDED]
    if clash:
        raise ValueError(f"documents have columns {clash} that the result adds; rename them")
    rows = stored(boxed(docs).withColumns({"doc_id": F.col("row.doc_id"), "__row": F.monotonically_increasing_id()}), "line_rows")
    gone = (
        repeated_lines(rows.select(F.col("__row").alias("row"), "doc_id", "text"), min_words)
        .groupBy(F.col("row").alias("__row")).agg(F.sort_array(F.collect_list(F.struct("unit", "start", "end", "kept_doc"))).alias("removed"))
    )
    both = rows.select("row", "text", "__row").join(gone, "__row", "left").drop("__row")
    schema = both.withColumn("n_units", F.lit(0).cast("long")).schema
    out = both.mapInArrow(_cut_batches(both.columns.index("text"), both.columns.index("removed")), schema)
    none = F.array().cast(both.schema["removed"].dataType)
    out = out.withColumns({"removed": F.coalesce("removed", none), "n_removed": F.when(F.col("removed").isNull(), 0).otherwise(F.size("removed")).cast("long")})
    return unboxed(out, docs, *_ADDED)
