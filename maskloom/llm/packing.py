"""Variable-capacity best-fit packing of documents into training sequences.

Several sequence lengths are permitted, each with a cost.  Pieces go, longest
first, into the open bin that they leave the least room in; if none fits, the
bin size of least cost per token it can still receive is opened.  Each block is
packed once for every choice of the largest size that may be opened, and the
cheapest outcome stays, so the sizes are chosen jointly.  At the end a bin
shrinks to the cheapest size that holds its contents.

A document longer than the largest size is cut into full pieces, each a bin of
its own, and a rest; nothing is truncated or dropped.  Only ``(place, doc_id,
length)`` rows move: they are spread over blocks of about ``BLOCK`` rests by a hash of
the row's place (so no key can make a block large), and a block is one
group's work.  A block wastes at most its few last bins.

Nulls: a null or empty text has its end token alone; null and repeated
doc_ids are packed row by row.  Empty input: no bins.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from heapq import heappop, heappush

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .common import SPACE_CLASS

CAPACITIES = (512, 1024, 2048, 4096)
#: A bin costs its length plus this.
OVERHEAD = 32
BLOCK = 10_000


def word_length(text: Column) -> Column:
    """Words of the text and one end token."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    return (F.size(F.filter(F.split(t, SPACE_CLASS), lambda w: w != "")) + 1).cast("long")


def best_fit(lengths: list[int], costs: dict[int, float], largest: int) -> list[list[int]]:
    """Bins (indices into ``lengths``, which falls) when sizes up to ``largest`` may be opened;
    a longer piece opens the smallest size that holds it."""
    sizes = sorted(costs)
    rest = sum(lengths)
    spaces: list[int] = []  # sorted distinct free spaces of open bins
    open_: dict[int, list[int]] = {}
    bins: list[list[int]] = []
    for i, n in enumerate(lengths):
        k = bisect_left(spaces, n)
        if k < len(spaces):
            space = spaces[k]
            b = heappop(open_[space])  # the oldest of them
            if not open_[space]:
                del open_[space], spaces[k]
        else:
            fits = [c for c in sizes if c >= n]
            fits = [c for c in fits if c <= largest] or fits[:1]
            space = min(fits, key=lambda c: (costs[c] / min(c, rest), c))
            b = len(bins)
            bins.append([])
        bins[b].append(i)
        rest -= n
        if left := space - n:
            if left not in open_:
                insort(spaces, left)
                open_[left] = []
            heappush(open_[left], b)
    return bins


def pack(lengths: list[int], costs: dict[int, float]) -> list[tuple[int, list[int]]]:
    """``(capacity, indices)`` of each bin of the cheapest joint choice."""

    def shrunk(bins):
        out = []
        for b in bins:
            used = sum(lengths[i] for i in b)
            out.append((min((c for c in costs if c >= used), key=lambda c: (costs[c], c)), b))
        return out

    tries = [shrunk(best_fit(lengths, costs, c)) for c in sorted(costs, reverse=True)]
    return min(tries, key=lambda bins: sum(costs[c] for c, _ in bins))


_SCHEMA = "doc_id long, piece int, start long, n_tokens long, bin string, capacity int, pos int, bin_tokens int"


def _pack_block(costs: dict[int, float]):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["n_tokens", "place"], ascending=[False, True], kind="stable").reset_index(drop=True)
        lengths = rows["n_tokens"].tolist()
        name, cap, pos, used = ([None] * len(rows) for _ in range(4))
        for b, (capacity, items) in enumerate(pack(lengths, costs)):
            at, total = 0, sum(lengths[i] for i in items)
            for i in items:
                name[i], cap[i], pos[i], used[i] = f"{rows['block'][0]}-{b}", capacity, at, total
                at += lengths[i]
        return rows.assign(bin=name, capacity=cap, pos=pos, bin_tokens=used)[["doc_id", "piece", "start", "n_tokens", "bin", "capacity", "pos", "bin_tokens"]]

    return run


def pack_documents(docs: DataFrame, capacities: tuple[int, ...] = CAPACITIES, overhead: float = OVERHEAD, length: Column | None = None, block: int = BLOCK) -> DataFrame:
    """One row a piece: ``doc_id, piece, start, n_tokens, bin, capacity, pos, bin_tokens``.

    ``length`` is the tokens of a row (default: words and an end token).
    """
    costs = {c: c + overhead for c in sorted(set(capacities))}
    top = max(costs)
    n = word_length(F.col("text")) if length is None else length
    rows = docs.select(F.monotonically_increasing_id().alias("place"), F.col("doc_id").cast("long").alias("doc_id"), n.cast("long").alias("n"))
    rows = stored(rows, "pack_lengths")
    full = rows.where(F.col("n") >= top).select(
        "place", "doc_id", F.explode(F.sequence(F.lit(0), F.floor(F.col("n") / top).cast("int") - 1)).alias("piece")
    )
    full = full.select(
        "doc_id", "piece", F.col("piece").cast("long") * top, F.lit(top).cast("long"), F.concat_ws("-", F.lit("full"), "place", "piece"),
        F.lit(top), F.lit(0), F.lit(top),
    )
    rest = rows.where(F.col("n") % top > 0).select(
        "place", "doc_id", F.floor(F.col("n") / top).cast("int").alias("piece"), (F.floor(F.col("n") / top) * top).alias("start"), (F.col("n") % top).alias("n_tokens")
    )
    blocks = max(1, -(-rest.count() // block))
    rest = rest.withColumn("block", F.pmod(F.xxhash64("place"), F.lit(blocks)))
    return rest.groupBy("block").applyInPandas(_pack_block(costs), _SCHEMA).union(full)
