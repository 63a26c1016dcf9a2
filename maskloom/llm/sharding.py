"""Extendible hashing: shards of bounded size, from built-in columns alone.

A row's address is the first 40 bits of md5(key) followed by 22 bits of its
place in the input.  The directory is indexed by a prefix of the address: it
starts as one bucket of no bits, and a bucket whose rows exceed ``limit`` bytes
splits on the next bit, only it, until every bucket fits.  A bucket's prefix
(its bits as text) is the shard's name, so a key's shard is found from the key
and the directory.  The bits of the row's place come last: only rows with one key are
split by them, which spreads a hot key over as many as four million shards.

Sizes are aggregated per address prefix (combined before the shuffle), several
bits at a time: a round sums the bytes of all prefixes of its bits, and a
bucket is a prefix that fits below one that does not.  The stored directory
has one row a bucket.  Only rows of prefixes that still do not fit take part
in the next round.  A single row above ``limit`` cannot be
split; its shard reaches the full address and is marked ``oversize``.

Nulls: a null key is the key ``''``; a null text has no bytes.  Repeated rows
are placed each.  Empty input: no shards.  Extra columns are written with their row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored

LIMIT = 32 << 20
KEY_BITS, PLACE_BITS = 40, 22
BITS = KEY_BITS + PLACE_BITS
#: Bits that a round resolves.
ROUND = 10


def address(key: Column, place: Column) -> Column:
    """The ``BITS`` address bits as a non-negative long."""
    h = F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, KEY_BITS // 4), 16, 10).cast("long")
    p = F.pmod(F.xxhash64(place), F.lit(1 << PLACE_BITS))
    return F.shiftleft(h, PLACE_BITS).bitwiseOR(p)


def prefix(depth: Column) -> Column:
    """The first ``depth`` bits of ``address``."""
    return F.call_function("shiftright", F.col("address"), (F.lit(BITS) - depth).cast("int"))


def bits(value: Column, depth: Column) -> Column:
    return F.when(depth == 0, F.lit("")).otherwise(F.lpad(F.bin(value), depth, "0"))


def directory(rows: DataFrame, limit: int = LIMIT) -> DataFrame:
    """One row a bucket of rows ``address, bytes``: ``depth, prefix, shard, shard_bytes, shard_rows, oversize``.

    ``prefix`` holds the first ``depth`` bits of the addresses of the bucket, ``shard`` the same as text.
    """
    out, base, left = None, 0, rows
    while True:
        top = min(base + ROUND, BITS)
        cells = left.groupBy(prefix(F.lit(top)).alias("cell")).agg(F.sum("bytes").alias("b"), F.count("*").alias("n"))
        # the bytes of every prefix from this round's first bit on
        depth = F.explode(F.sequence(F.lit(base if base == 0 else base + 1), F.lit(top))).alias("depth")
        up = F.call_function("shiftright", F.col("cell"), (F.lit(top) - F.col("depth")).cast("int"))
        sums = cells.select("cell", "b", "n", depth).groupBy("depth", up.alias("prefix")).agg(F.sum("b").alias("b"), F.sum("n").alias("n"))
        fits = (F.col("b") <= limit) | ((F.col("depth") == top) & (F.lit(top == BITS) | (F.col("n") == 1)))
        sums = stored(sums.withColumn("fits", fits), "shard_prefixes")
        # a bucket is a prefix that fits below one that does not
        halved = sums.where(~F.col("fits")).select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("above"))
        found = sums.where("fits").withColumn("above", F.call_function("shiftright", F.col("prefix"), F.lit(1)))
        first = F.col("depth") == (base if base == 0 else base + 1)  # what stands above is known not to fit
        found = found.where(first).unionByName(found.where(~first).join(halved, ["depth", "above"], "left_semi"))
        found = found.select(
            "depth", "prefix", bits(F.col("prefix"), F.col("depth")).alias("shard"),
            F.col("b").alias("shard_bytes"), F.col("n").alias("shard_rows"), (F.col("b") > limit).alias("oversize"),
        )
        out = found if out is None else out.unionByName(found)
        cut = sums.where((F.col("depth") == top) & ~F.col("fits")).select(F.col("prefix").alias("__cell"))
        if top == BITS or cut.isEmpty():
            return stored(out, "shard_directory")
        left = left.join(cut, prefix(F.lit(top)) == F.col("__cell"), "left_semi")
        base = top


def _bucketed(rows: DataFrame, limit: int) -> DataFrame:
    """``rows`` with the columns of their buckets; each row meets the buckets of a depth by its prefix of that depth."""
    buckets = directory(rows, limit)
    out = None
    for depth in sorted(r.depth for r in buckets.select("depth").distinct().collect()) or [0]:  # BITS + 1 at most
        some = buckets.where(F.col("depth") == depth)
        part = rows.withColumn("prefix", prefix(F.lit(depth))).join(some, "prefix")
        out = part if out is None else out.unionByName(part)
    return out


def assign_shards(docs: DataFrame, limit: int = LIMIT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``key, bytes, shard, depth, shard_bytes, shard_rows, oversize``."""
    rows = docs.select(
        F.col(key), F.coalesce(F.octet_length(F.col(text).cast("string")), F.lit(0)).cast("long").alias("bytes"), F.monotonically_increasing_id().alias("place")
    )
    rows = stored(rows.select(key, "bytes", address(F.col(key), F.col("place")).alias("address")), "shard_rows")
    return _bucketed(rows, limit).select(key, "bytes", "shard", F.col("depth").cast("long").alias("depth"), "shard_bytes", "shard_rows", "oversize")


def shard_rows(docs: DataFrame, limit: int = LIMIT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row of ``docs`` once, all its columns and ``shard``.  Rows meet their
    bucket by their place, never by the key, so null and repeated keys stay whole."""
    if "shard" in map(str.lower, docs.columns):
        raise ValueError("a column is named like the shard")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.monotonically_increasing_id().alias("place"))
    size = F.coalesce(F.octet_length(F.col("row")[text].cast("string")), F.lit(0)).cast("long")
    rows = stored(rows.select("row", "place", size.alias("bytes"), address(F.col("row")[key], F.col("place")).alias("address")), "shard_rows")
    bucket = _bucketed(rows.select("place", "bytes", "address"), limit)
    return rows.select("row", "place").join(bucket.select("place", "shard"), "place").select("row.*", "shard")


def write_shards(docs: DataFrame, path: str, limit: int = LIMIT, key: str = "doc_id", text: str = "text") -> None:
    """Write the rows of ``docs`` as one folder a shard, ``shard=b`` and its bits (so that they are
    read back as text, also none); a shard is one task's work by its byte limit."""
    rows = shard_rows(docs, limit, key, text).withColumn("shard", F.concat(F.lit("b"), "shard"))
    rows.repartition("shard").write.partitionBy("shard").parquet(path)
