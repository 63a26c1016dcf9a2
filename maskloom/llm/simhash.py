"""SimHash near-duplicates through a byte-position inverted index.

A document's fingerprint is the bitwise majority of the XXH64 hashes of its
word shingles.  Two fingerprints at ``MAX_BITS`` (3) or fewer differing bits
differ in at most 3 of their 8 bytes, so they share at least ``MIN_SHARED``
(5) positional bytes: that is the guaranteed minimum of the count filter.

Postings of one (position, byte) alone hold 1/256 of all fingerprints, and
tallying their pairs is quadratic.  The index therefore intersects postings
four at a time: its keys are the values at 4 of the 8 positions (70 sets).  A
pair that meets under a key has a tally of at least four; its bytes at the other
positions are tallied too, pairs that stay at four are dropped, and the others
are verified by their Hamming distance.  A linked pair meets under five keys or more.

Only *distinct* fingerprints are indexed, so a group of copies, however
large, is one entry.  Inside a key's posting list no pair is ever emitted:
the list is reduced to a spanning forest of its verified links.  A list of more
than ``direct`` members is not solved as it stands but handed on, row by row,
to be split by the byte at each of the other positions: a part shares five
bytes, so its members differ in 24 bits only and any length of it is solved
exactly over that 24-bit cube, in memory that does not depend on its length.
Components of the forests are found by alternating large-star / small-star
rounds on the edge table.

Nulls: a null text has no words and the fingerprint zero, linked like any
other; a null doc_id takes part in linking but is never a component's id (a
component of such rows alone has a null id).  Repeated rows each get a row.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .common import boxed, lower_ascii, not_space, pieces, text_bytes, unboxed, word_spans
from .xxh64 import xxh64_spans

SHINGLE = 3
MAX_BITS = 3
BYTES = 8
MIN_SHARED = BYTES - MAX_BITS
#: Positional bytes in a key of the index, one less than the tally asks for.
INDEXED = MIN_SHARED - 1
SEED = 42
#: Hashes whose bits are counted at a time.
_VOTES = 1 << 16
#: Posting lists up to here are compared directly, longer ones split by one more byte.
_DIRECT = 8192
#: Lists up to here are first looked through for any link, many lists at a time.
_SMALL = 64


# ---------------------------------------------------------------------------
# fingerprints
# ---------------------------------------------------------------------------

def _fingerprints(data: np.ndarray, offsets: np.ndarray, k: int) -> np.ndarray:
    n_docs = len(offsets) - 1
    low = lower_ascii(data)
    starts, ends, n_words = word_spans(not_space(low), offsets)
    # the words of a piece joined by one space: a shingle is then one byte span
    size = ends - starts
    new_start = np.cumsum(size + 1) - (size + 1)
    joined = np.full(int((size + 1).sum()), 32, np.uint8)
    keep = not_space(low)
    slots = np.ones(len(joined), bool)
    slots[new_start + size] = False
    joined[slots] = low[keep]
    new_end = new_start + size
    n_shingles = np.where(n_words >= k, n_words - k + 1, np.minimum(n_words, 1))
    doc = np.repeat(np.arange(n_docs), n_shingles)
    first_word = np.cumsum(n_words) - n_words
    first = np.cumsum(n_shingles) - n_shingles
    a = first_word[doc] + (np.arange(len(doc)) - first[doc])
    b = a + np.minimum(k, n_words[doc]) - 1
    ones = np.zeros((n_docs, 64), np.int64)
    for lo in range(0, len(doc), _VOTES):
        hi = min(lo + _VOTES, len(doc))
        h = xxh64_spans(joined, new_start[a[lo:hi]], new_end[b[lo:hi]], SEED)
        bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        d = doc[lo:hi]
        cut = np.flatnonzero(np.r_[True, d[1:] != d[:-1]])
        ones[d[cut]] += np.add.reduceat(bits, cut, axis=0, dtype=np.int32)
    major = (2 * ones > n_shingles[:, None]).astype(np.uint8)
    return np.packbits(major, axis=1, bitorder="little").view("<u8")[:, 0].astype(np.uint64)


def _fingerprint_batches(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *own, text = batch.columns
            data, offsets = text_bytes(text)
            out = np.zeros(batch.num_rows, np.uint64)
            for i, j in pieces(offsets):
                out[i:j] = _fingerprints(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], k)
            yield pa.RecordBatch.from_arrays([*own, pa.array(out.view(np.int64))], [*batch.schema.names[:-1], "fp"])

    return run


def fingerprints(docs: DataFrame, k: int = SHINGLE, *places: str) -> DataFrame:
    """``doc_id``, the long columns ``places`` and ``fp`` (the 64 bits as a long), one row per document."""
    ids = ["doc_id", *places]
    d = docs.select(*(F.col(c).cast("long").alias(c) for c in ids), F.col("text").cast("string").alias("text"))
    return d.mapInArrow(_fingerprint_batches(k), "".join(f"{c} long, " for c in ids) + "fp long")


# ---------------------------------------------------------------------------
# index, count filter, verified links
# ---------------------------------------------------------------------------

def _shared_bytes(x: np.ndarray) -> np.ndarray:
    """Positional bytes two fingerprints share, from their XOR."""
    return sum(((x >> np.uint64(8 * p)) & np.uint64(255) == 0).astype(np.int8) for p in range(BYTES))


def _linked(x: np.ndarray) -> np.ndarray:
    """Count filter, then the Hamming check, on XORs of pairs."""
    return (_shared_bytes(x) >= MIN_SHARED) & (np.bitwise_count(x) <= MAX_BITS)


def _forest_direct(fps: np.ndarray) -> list[tuple[int, int]]:
    """Spanning forest of the links inside a short posting list."""
    left = np.ones(len(fps), bool)
    edges = []
    while left.any():
        root = int(np.argmax(left))
        left[root] = False
        todo = [root]
        while todo:
            i = todo.pop()
            rest = np.flatnonzero(left)
            if not len(rest):
                break
            near = rest[_linked(fps[rest] ^ fps[i])]
            left[near] = False
            todo += near.tolist()
            edges += [(int(fps[i]), int(fps[j])) for j in near]
    return edges


def _forest_cube(fps: np.ndarray, free: tuple[int, ...]) -> list[tuple[int, int]]:
    """The same for a list of any length: its members differ only in the bytes
    ``free``, so smallest labels spread over that cube, three single-bit steps
    (a ball of radius ``MAX_BITS``) at a time, until nothing changes."""
    bits = 8 * len(free)
    cell = np.zeros(len(fps), np.int64)
    for i, p in enumerate(free):
        cell |= ((fps >> np.uint64(8 * p)) & np.uint64(255)).astype(np.int64) << (8 * i)
    none = np.uint32(0xFFFFFFFF)
    label = np.full(1 << bits, none, np.uint32)
    label[cell] = np.arange(len(fps), dtype=np.uint32)
    while True:
        ball = label
        for _ in range(MAX_BITS):
            grown = ball.copy()
            for b in range(bits):
                a, g = ball.reshape(-1, 2, 1 << b), grown.reshape(-1, 2, 1 << b)
                np.minimum(g, a[:, ::-1, :], out=g)
            ball = grown
        new = ball[cell]
        if (new == label[cell]).all():
            break
        label[cell] = new
    root = label[cell].astype(np.int64)
    me = np.arange(len(fps))
    return [(int(fps[r]), int(fps[i])) for r, i in zip(root, me) if r != i]


#: Sets of positions: the keys of the index, and those that reach the tally.
_SETS = {n: list(combinations(range(BYTES), n)) for n in (INDEXED, MIN_SHARED)}


def _mask(positions) -> int:
    m = sum(0xFF << (8 * p) for p in positions)
    return m - (1 << 64) if m >= 1 << 63 else m


def _with_links(fp: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Which of the posting lists hold a linked pair (members ``step`` apart are compared, for all lists at once)."""
    list_of = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(len(list_of)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    member = np.repeat(starts, sizes) + at
    found = np.zeros(len(sizes), bool)
    for step in range(1, int(sizes.max(initial=0))):
        i = at + step < sizes[list_of]
        list_of, at, member = list_of[i], at[i], member[i]
        found[list_of[_linked(fp[member] ^ fp[member + step])]] = True
    return found


def _forest_batches(width: int, direct: int):
    """Sorted ``(positions, bytes, fp)`` rows of an index with ``width`` bytes a key in; forest edges ``(-1, a, b)``
    out, and the members of lists that are too long for this width as ``(positions, fp, null)``."""
    split = width < MIN_SHARED
    sets = _SETS[width]

    def rows(s, a, b=None) -> pa.RecordBatch:
        b = pa.nulls(len(a), pa.int64()) if b is None else pa.array(b)
        return pa.RecordBatch.from_arrays([pa.array(s), pa.array(a), b], ["s", "a", "b"])

    def solve(s, key, fp) -> Iterator[pa.RecordBatch]:
        cut = np.r_[np.flatnonzero(np.r_[True, (s[1:] != s[:-1]) | (key[1:] != key[:-1])]), len(s)]
        start, size = cut[:-1], np.diff(cut)
        small = (size > 1) & (size <= _SMALL)
        todo = size > _SMALL
        todo[np.flatnonzero(small)[_with_links(fp, start[small], size[small])]] = True
        edges = []
        for i in np.flatnonzero(todo):
            run = fp[cut[i] : cut[i + 1]]
            if len(run) <= direct:
                edges += _forest_direct(run)
            elif split:
                yield rows(s[cut[i] : cut[i + 1]], run.view(np.int64))
            else:
                edges += _forest_cube(run, tuple(p for p in range(BYTES) if p not in sets[int(s[cut[i]])]))
        e = np.array(edges, np.uint64).reshape(-1, 2).view(np.int64)
        if len(e):
            yield rows(np.full(len(e), -1, np.int8), e[:, 0].copy(), e[:, 1].copy())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        long_list = None  # the list whose members are handed on as they come
        for batch in batches:
            s, key, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            fp = fp.view(np.uint64)
            if long_list is not None:
                n = int(np.argmin(np.r_[(s == long_list[0]) & (key == long_list[1]), False]))
                if n:
                    yield rows(s[:n], fp[:n].view(np.int64))
                s, key, fp = s[n:], key[n:], fp[n:]
            if not len(s):
                continue
            long_list = None
            held.append((s, key, fp))
            if (held[0][0][0], held[0][1][0]) == (s[-1], key[-1]):  # still inside one posting list
                if split and sum(len(x[0]) for x in held) > direct:
                    long_list = (s[-1], key[-1])
                    for x, _, f in held:
                        yield rows(x, f.view(np.int64))
                    held = []
                continue
            s, key, fp = (np.concatenate(x) for x in zip(*held))
            last = int(np.flatnonzero((s != s[-1]) | (key != key[-1]))[-1]) + 1
            held = [(s[last:], key[last:], fp[last:])]
            yield from solve(s[:last], key[:last], fp[:last])
        if held:
            yield from solve(*(np.concatenate(x) for x in zip(*held)))

    return run


def _solved(postings: DataFrame, width: int, direct: int) -> DataFrame:
    """``s, a, b`` of the posting lists of ``s, key, fp``."""
    return postings.repartition("s", "key").sortWithinPartitions("s", "key").mapInArrow(_forest_batches(width, direct), "s byte, a long, b long")


def _posting(width: int, i: int) -> Column:
    return F.struct(F.lit(i).cast("byte").alias("s"), F.col("fp").bitwiseAND(F.lit(_mask(_SETS[width][i]))).alias("key"))


def links(distinct: DataFrame, direct: int = _DIRECT) -> DataFrame:
    """``a, b``: a spanning forest of the links between distinct fingerprints ``fp``;
    posting lists of more than ``direct`` members are split before they are solved."""
    entries = F.array(*[_posting(INDEXED, i) for i in range(len(_SETS[INDEXED]))])
    index = distinct.select("fp", F.explode(entries).alias("e")).select("e.s", "e.key", "fp")
    first = stored(_solved(index, INDEXED, direct), "posting_lists")
    edges, long_lists = first.where("s < 0"), first.where("s >= 0").select("s", F.col("a").alias("fp"))
    # a member of a long list goes under every set of one more position
    wider = [F.array(*[_posting(MIN_SHARED, j) for j, big in enumerate(_SETS[MIN_SHARED]) if set(few) < set(big)]) for few in _SETS[INDEXED]]
    parts = long_lists.select("fp", F.explode(F.element_at(F.array(*wider), F.col("s").cast("int") + 1)).alias("e"))
    parts = parts.select("e.s", "e.key", "fp").distinct()
    return edges.unionByName(_solved(parts, MIN_SHARED, _DIRECT)).select("a", "b")


# ---------------------------------------------------------------------------
# connected components of the edge table
# ---------------------------------------------------------------------------

def components(edges: DataFrame) -> DataFrame:
    """``node, root``: the smallest node reachable, by large-star / small-star
    rounds until the edge table is a set of stars.  Each round is written to
    the shared folder.  The smallest neighbour is an aggregate joined back, so
    no node's neighbours are ever gathered in one place."""

    def star(e: DataFrame, large: bool) -> DataFrame:
        if large:
            n = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        else:
            n = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = n.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        j = n.join(low, "u")
        if large:
            new = j.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            new = j.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(j.select("u", F.col("m").alias("v")))
        return new.where(F.col("u") != F.col("v")).distinct()

    def state(e: DataFrame):
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    cur = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    was = state(cur)
    while was[0]:
        cur = stored(star(star(cur, True), False), "links")
        now = state(cur)
        if now == was:
            break
        was = now
    return cur.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _components(fps: DataFrame, rank: Column) -> DataFrame:
    """``fp, root, first`` of the distinct fingerprints: ``first`` is the smallest ``rank`` of the component's rows."""
    distinct = stored(fps.groupBy("fp").agg(F.min(rank).alias("low")), "distinct_fps")
    root = components(links(distinct))
    member = stored(
        distinct.join(root, distinct["fp"] == root["node"], "left").select("fp", "low", F.coalesce("root", "fp").alias("root")), "members"
    )
    # only components of several fingerprints need their smallest document gathered
    many = member.where(F.col("root") != F.col("fp")).select("root").distinct()
    lows = member.join(many, "root", "left_semi").groupBy("root").agg(F.min("low").alias("first"))
    named = member.join(lows, "root", "left").select("fp", "root", F.coalesce("first", "low").alias("first"))
    return stored(named, "components")


def near_duplicates(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """``doc_id, fp, component_id``, one row per row of ``docs``."""
    fps = stored(fingerprints(docs, k), "fingerprints")
    named = _components(fps, F.col("doc_id"))
    return fps.join(named, "fp").select("doc_id", "fp", F.col("first").alias("component_id"))


def one_per_group(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """The rows of ``docs`` that represent their component: of its rows with the
    smallest doc_id the first in the input (rows without doc_id come last).  Rows
    are told apart by their place, so a doc_id may be shared within and across components."""
    rows = stored(boxed(docs).select("row", "text", F.col("row.doc_id").alias("doc_id"), F.monotonically_increasing_id().alias("__row")), "rows_by_place")
    fps = stored(fingerprints(rows, k, "__row"), "fingerprints")
    named = _components(fps, F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "__row"))
    keep = named.select("first.__row").distinct()
    return rows.join(keep.hint("merge"), "__row", "left_semi").transform(unboxed, docs)  # as many rows as documents


def fingerprint_hex(fp: Column) -> Column:
    """16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
