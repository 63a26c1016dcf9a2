"""Exact duplicates by Grace hash partitioning.

1. *Collapse*: every task puts its texts through an open-addressing table that
   compares complete contents, so a text copied a million times leaves a task
   once per table.  The rows go to a stored table; only the first row of a
   content keeps its text.
2. *Partition*: the kept texts are dealt to buckets by the leading bits of
   their digest.  The number of bits comes from the bytes there are; a bucket
   whose distinct contents exceed ``BUCKET_BYTES`` is split on ``MORE_BITS``
   more bits, again and again, until it fits (or one digest is left, which
   holds one text unless two texts share a SHA-256).  The directory is counted
   on digests and sizes alone, so a text moves once, to its last bucket.
   A digest that very many tables hold is salted: its rows meet in several
   buckets first, and one row of each in a second round.
3. *Match*: a task streams its buckets, one after the other, through a table of
   the same kind that holds one bucket's distinct contents.
4. The per-table counts and best rows are joined along the matches; no list
   of copies is ever gathered.

Defined cases: a null text counts as empty; of equal texts the row with the
largest ``id`` stays, a null id is below every other, and of rows with the
same id the first in storage order stays; equal rows are copies of each
other; an empty table gives no rows; a text longer than ``BUCKET_BYTES`` has
a table for itself; other columns are carried by :func:`without_copies`,
whatever their names, and not read by :func:`copies`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored

#: Bytes of distinct content that one table holds.
BUCKET_BYTES = 64 << 20
#: Digest bits by which an oversized bucket splits, and the bits there are.
MORE_BITS = 4
ALL_BITS = 62
#: Rows of one digest that meet in one bucket before its rows are salted.
SALT_ROWS = 4096


class OpenTable:
    """Open addressing with linear probing over 64-bit digest prefixes; two
    entries are one only if their complete contents are equal."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.slots = np.full(1 << 10, -1, np.int64)
        self.hashes: list[int] = []
        self.contents: list[bytes] = []
        self.names: list[int] = []
        self.bytes = 0

    def _grow(self) -> None:
        self.slots = np.full(2 * len(self.slots), -1, np.int64)
        mask = len(self.slots) - 1
        for entry, h in enumerate(self.hashes):
            at = h & mask
            while self.slots[at] >= 0:
                at = (at + 1) & mask
            self.slots[at] = entry

    def put(self, h: int, content: bytes, name: int) -> int:
        """Name of the entry with this content; a new entry gets ``name``."""
        mask = len(self.slots) - 1
        at = h & mask
        while (entry := self.slots[at]) >= 0:
            if self.hashes[entry] == h and self.contents[entry] == content:
                return self.names[entry]
            at = (at + 1) & mask
        self.slots[at] = len(self.names)
        self.hashes.append(h)
        self.contents.append(content)
        self.names.append(name)
        self.bytes += len(content)
        if 3 * len(self.names) > 2 * len(self.slots):
            self._grow()
        return name


def collapsed(rows: DataFrame, id_type: str, bucket_bytes: int) -> DataFrame:
    """``id, place, ref, digest, h, text`` of ``id, place, text``: ``ref`` is the place of the
    table's first row with this content, which alone keeps ``text``; h: 62 bits of the digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = OpenTable()
        for b in batches:
            places, texts = b.column(1).to_pylist(), b.column(2).cast(pa.large_binary())
            refs, digests, hashes, kept = [], [], [], []
            for place, text in zip(places, texts):
                content = text.as_py() or b""
                if table.bytes and table.bytes + len(content) > bucket_bytes:
                    table.clear()
                digest = hashlib.sha256(content).digest()
                h = int.from_bytes(digest[:8], "big") >> 2
                ref = table.put(h, content, place)
                refs.append(ref)
                digests.append(digest)
                hashes.append(h)
                kept.append(content if ref == place else None)
            yield pa.record_batch(
                [b.column(0), b.column(1), pa.array(refs, pa.int64()), pa.array(digests, pa.binary()), pa.array(hashes, pa.int64()), pa.array(kept, pa.binary())],
                ["id", "place", "ref", "digest", "h", "content"],
            )

    return rows.mapInArrow(run, f"id {id_type}, place long, ref long, digest binary, h long, content binary")


def _prefix(bits: Column) -> Column:
    """A bucket: its bits, and the leading bits of the digest (as one number)."""
    return F.expr("shiftright(h, cast(%d as int) - bits)" % ALL_BITS) * 64 + bits


def directory(firsts: DataFrame, bucket_bytes: int) -> tuple[int, DataFrame | None]:
    """``(bits, splits)``: bits of every bucket, and the buckets (``bucket, bits``, by the
    prefix they split from) that need more.  Counts digests and sizes only."""
    sizes = stored(firsts.groupBy("h").agg(F.max(F.octet_length("content")).alias("size")), "grace_sizes")
    total = sizes.agg(F.sum(F.col("size") + 64)).first()[0] or 0
    bits = min(ALL_BITS, max(0, (2 * total // bucket_bytes).bit_length()))
    splits, level, open_ = [], bits, sizes.withColumn("bits", F.lit(bits))
    while level < ALL_BITS:
        buckets = open_.withColumn("bucket", _prefix(F.col("bits"))).groupBy("bucket").agg(F.sum("size").alias("size"), F.count("*").alias("n"))
        over = stored(buckets.where((F.col("size") > bucket_bytes) & (F.col("n") > 1)).select("bucket"), "grace_over")
        if over.isEmpty():
            break
        open_ = open_.withColumn("bucket", _prefix(F.col("bits"))).join(over, "bucket", "left_semi").drop("bucket")
        splits.append(over)
        level = min(ALL_BITS, level + MORE_BITS)
        open_ = open_.withColumn("bits", F.lit(level))
    return bits, splits


def dealt(firsts: DataFrame, bits: int, splits: list[DataFrame]) -> DataFrame:
    """``firsts`` with their last ``bucket``."""
    out = firsts.withColumn("bits", F.lit(bits)).withColumn("bucket", _prefix(F.col("bits")))
    for over in splits:
        split = F.least(F.col("bits") + MORE_BITS, F.lit(ALL_BITS))
        out = out.join(over.withColumn("_over", F.lit(True)), "bucket", "left").withColumn("bits", F.when(F.col("_over"), split).otherwise(F.col("bits")))
        out = out.withColumn("bucket", _prefix(F.col("bits"))).drop("_over")
    return out.drop("bits")


def matched(buckets: DataFrame) -> DataFrame:
    """``ref, first`` of ``bucket, salt, ref, h, content``: ``first`` is the ref of the bucket's first row with this content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, now = OpenTable(), None
        for b in batches:
            keys = zip(b.column(0).to_pylist(), b.column(1).to_pylist())
            firsts = []
            for key, ref, h, content in zip(keys, b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4)):
                if key != now:
                    table.clear()
                    now = key
                firsts.append(table.put(h, content.as_py(), ref))
            yield pa.record_batch([b.column(2), pa.array(firsts, pa.int64())], ["ref", "first"])

    lined = buckets.select("bucket", "salt", "ref", "h", "content").repartition("bucket", "salt").sortWithinPartitions("bucket", "salt")
    return lined.mapInArrow(run, "ref long, first long")


def classes(rows: DataFrame, bucket_bytes: int, salt_rows: int) -> DataFrame:
    """``ref, class``: the tables' first rows, one ``class`` (a ref) for equal contents."""
    firsts = rows.where(F.col("place") == F.col("ref")).select("ref", "h", "content")
    bits, splits = directory(firsts, bucket_bytes)
    buckets = dealt(firsts, bits, splits)
    hot = stored(
        firsts.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > salt_rows).select("h", F.ceil(F.col("n") / salt_rows).alias("salts")), "grace_hot"
    )
    if hot.isEmpty():
        return matched(buckets.withColumn("salt", F.lit(0))).select("ref", F.col("first").alias("class"))
    salted = buckets.join(hot, "h", "left").withColumn("salt", F.pmod(F.xxhash64("ref"), F.coalesce("salts", F.lit(1))).cast("int"))
    one = stored(matched(salted), "grace_first_round")
    again = buckets.join(hot, "h", "left_semi").join(one.where("ref = first").select("ref"), "ref", "left_semi")
    two = matched(again.withColumn("salt", F.lit(0))).select(F.col("ref").alias("first"), F.col("first").alias("class"))
    return one.join(two, "first", "left").select("ref", F.coalesce("class", "first").alias("class"))


def _groups(docs: DataFrame, id_col: str, text_col: str, bucket_bytes: int, salt_rows: int) -> DataFrame:
    """``id, place, digest, group_size, keep_id, keep_place``; ``docs`` has ``__place``."""
    source = docs.select(F.col(id_col).alias("id"), F.col("__place").alias("place"), F.col(text_col).alias("text"))
    id_type = source.schema[0].dataType.simpleString()
    rows = stored(collapsed(source, id_type, bucket_bytes), "grace_rows")
    best = F.max(F.struct("id", (-F.col("place")).alias("place")))  # a null id is the smallest
    tables = rows.groupBy("ref").agg(F.count("*").alias("n"), best.alias("best"))
    parts = classes(rows, bucket_bytes, salt_rows).join(tables, "ref")
    parts = stored(parts, "grace_parts")
    whole = parts.groupBy("class").agg(F.sum("n").alias("group_size"), F.max("best").alias("best"))
    found = parts.select("ref", "class").join(whole, "class").select("ref", "group_size", F.col("best.id").alias("keep_id"), (-F.col("best.place")).alias("keep_place"))
    return rows.select("id", "place", "ref", "digest").join(found, "ref").drop("ref")


def copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = BUCKET_BYTES, salt_rows: int = SALT_ROWS) -> DataFrame:
    """One row a document: ``<id>, keep_id, group_size, kept, text_sha256`` (cases: see the module)."""
    placed = docs.select(F.col(id_col), F.col(text_col)).withColumn("__place", F.monotonically_increasing_id())
    g = _groups(placed, id_col, text_col, bucket_bytes, salt_rows)
    return g.select(
        F.col("id").alias(id_col), "keep_id", "group_size", (F.col("place") == F.col("keep_place")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = BUCKET_BYTES, salt_rows: int = SALT_ROWS) -> DataFrame:
    """The rows that stay, with all their columns."""
    fields = [F.col(c) for c in docs.columns]
    placed = stored(docs.select(F.struct(*fields).alias("row"), F.monotonically_increasing_id().alias("__place")), "grace_input")
    source = placed.select(F.col("row")[id_col].alias("id"), F.col("row")[text_col].alias("text"), "__place")
    g = _groups(source, "id", "text", bucket_bytes, salt_rows)
    stay = g.where(F.col("place") == F.col("keep_place")).select(F.col("place").alias("__place"))
    return placed.join(stay, "__place", "left_semi").select("row.*")
