"""Benchmark decontamination by winnowing.

Words are lower-cased (A-Z) runs of ASCII letters, digits and non-ASCII
characters.  Both sides keep, of every ``SPAN - K + 1`` neighbouring word
``K``-grams, the one with the smallest hash (the rightmost on ties).  Two texts
that share ``SPAN`` words in a row share that choice, so every such span is
found by a common fingerprint.  A document's fingerprints that hit the
benchmark's are then extended: each ``SPAN``-word window around a hit is looked
up among the item windows and compared byte by byte; all its words are marked.
An item of fewer words is one window of its own length; such lengths have no
winnowing guarantee, so for them every window of a document is looked up.

The benchmark is the stated query set.  It is read in blocks of a proven size
(``BLOCK_BYTES`` of text, whatever the table's size), each shipped to the tasks
as sorted arrays; documents stream past a block inside one narrow stage, so
texts are never shuffled and no group or row is ever gathered.  More blocks
chain as further narrow steps of the same stage, carrying the marked words.

Nulls: null text has no words; a null item_id still marks words but is not
listed; repeated item rows list an id once.  Empty benchmark: nothing is hit.
Extra columns of ``docs`` pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SpanHash, boxed, lower_ascii, pieces, text_bytes, unboxed, word_spans

SPAN = 10
K = 5
#: Text bytes of a block of the benchmark (a longer item is a block of its own).
BLOCK_BYTES = 2 << 20
MARKS, ITEMS = "__hit_words", "__hit_items"

_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True


class Words:
    """The words of a run of texts: places, hashes, text of each."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.low = lower_ascii(data)
        self.starts, self.ends, self.count = word_spans(_WORD[self.low], offsets)
        self.first = np.cumsum(self.count) - self.count
        self.doc = np.repeat(np.arange(len(self.count)), self.count)
        self.hash = SpanHash(self.low)(self.starts, self.ends)
        self.runs = SpanHash(self.hash)

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the ``n`` words from each word on, and whether one text holds them all."""
        a = np.arange(max(0, len(self.doc) - n + 1))
        return self.runs(a, a + n), self.doc[a] == self.doc[a + n - 1]

    def winnowed(self, k: int, span: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and hashes of the selected ``k``-grams."""
        g, ok = self.grams(k)
        w = span - k + 1
        n = len(g) - w + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        least, at = g[:n].copy(), np.arange(n)
        for j in range(1, w):
            x = g[j : j + n]
            new = x <= least
            least[new] = x[new]
            at[new] += j - (at[new] - np.flatnonzero(new))
        whole = self.doc[:n] == self.doc[span - 1 : span - 1 + n]
        pick = np.zeros(len(g), bool)
        pick[at[whole]] = True
        place = np.flatnonzero(pick)
        return place, g[place]

    def bytes(self, a: int, n: int) -> bytes:
        return b" ".join(self.low[s:e].tobytes() for s, e in zip(self.starts[a : a + n], self.ends[a : a + n]))


class Windows:
    """Item windows of one length: sorted hashes, and where each occurs."""

    def __init__(self, words: Words, at: np.ndarray, n: int):
        self.n, self.words = n, words
        h = words.runs(at, at + n)
        order = np.argsort(h, kind="stable")
        self.at = at[order]
        self.hash, self.begin = np.unique(h[order], return_index=True)
        self.begin = np.r_[self.begin, len(order)]

    def find(self, h: np.ndarray) -> np.ndarray:
        """Index of each hash, -1 if no item has it."""
        i = np.minimum(np.searchsorted(self.hash, h), len(self.hash) - 1)
        return np.where(self.hash[i] == h, i, -1)

    def items(self, index: int, text: bytes) -> set[int]:
        """Items with this very window."""
        places = self.at[self.begin[index] : self.begin[index + 1]]
        return {int(self.words.doc[p]) for p in places if self.words.bytes(int(p), self.n) == text}


class Block:
    """Fingerprints and windows of a bounded run of benchmark items."""

    def __init__(self, ids: list, texts: list, span: int, k: int):
        self.ids, self.span, self.k = ids, span, k
        data, offsets = text_bytes(pa.array(texts, pa.string()))
        w = Words(data, offsets)
        self.prints = np.unique(w.winnowed(k, span)[1])
        self.windows = []
        a = np.arange(max(0, len(w.doc) - span + 1))
        a = a[w.doc[a] == w.doc[a + span - 1]]
        if len(a):
            self.windows.append(Windows(w, a, span))
        for n in range(1, span):
            at = w.first[w.count == n]
            if len(at):
                self.windows.append(Windows(w, at, n))

    def scan(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, dict[int, tuple[np.ndarray, set]]]:
        """Words of each document, and for those with hits the marked words and items."""
        w = Words(data, offsets)
        marks, items = np.zeros(len(w.doc) + 1, np.int32), {}
        for win in self.windows:
            g, ok = w.grams(win.n)
            if win.n == self.span:
                place, h = w.winnowed(self.k, self.span)
                i = np.minimum(np.searchsorted(self.prints, h), len(self.prints) - 1)
                place = place[self.prints[i] == h] if len(self.prints) else place[:0]
                reach = np.zeros(len(g) + self.span, bool)  # extend each hit to the windows around it
                for j in range(self.span - self.k + 1):
                    p = place - j
                    reach[p[p >= 0]] = True
                at = np.flatnonzero(reach[: len(g)] & ok)
            else:
                at = np.flatnonzero(ok)
            found = win.find(g[at])
            for a, f in zip(at[found >= 0].tolist(), found[found >= 0].tolist()):
                if got := win.items(f, w.bytes(a, win.n)):
                    marks[a] += 1
                    marks[a + win.n] -= 1
                    items.setdefault(int(w.doc[a]), set()).update(got)
        marked = np.cumsum(marks[:-1]) > 0
        return w.count, {d: (marked[w.first[d] : w.first[d] + w.count[d]], s) for d, s in items.items()}


def _pass(block: Broadcast, text_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b: Block = block.value
        for batch in batches:
            names = batch.schema.names
            marks = batch.column(names.index(MARKS)).to_pylist()
            items = batch.column(names.index(ITEMS)).to_pylist()
            words = np.zeros(batch.num_rows, np.int64)
            data, offsets = text_bytes(batch.column(text_at))
            for i, j in pieces(offsets):
                words[i:j], hits = b.scan(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                for d, (mark, got) in hits.items():
                    packed = np.packbits(mark)
                    if marks[i + d]:
                        packed |= np.frombuffer(marks[i + d], np.uint8)
                    marks[i + d] = packed.tobytes()
                    items[i + d] = sorted({*(items[i + d] or ()), *(b.ids[x] for x in got if b.ids[x] is not None)})
            hit = [int.from_bytes(m).bit_count() if m else 0 for m in marks]
            new = {"n_words": pa.array(words), "n_hit": pa.array(hit, pa.int64()), MARKS: pa.array(marks, pa.binary()), ITEMS: pa.array(items, pa.list_(pa.string()))}
            yield pa.RecordBatch.from_arrays([new.get(c, batch.column(k)) for k, c in enumerate(names)], names)

    return run


def _blocks(benchmark: DataFrame, limit: int) -> Iterator[tuple[list, list]]:
    ids, texts, size = [], [], 0
    rows = benchmark.select(F.col("item_id").cast("string").alias("i"), F.col("text").cast("string").alias("t")).where("t is not null")
    for r in rows.toLocalIterator():
        n = len(r.t.encode())
        if ids and size + n > limit:
            yield ids, texts
            ids, texts, size = [], [], 0
        ids.append(r.i)
        texts.append(r.t)
        size += n
    if ids:
        yield ids, texts


def scan_benchmark(docs: DataFrame, benchmark: DataFrame, span: int = SPAN, k: int = K, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with ``n_words``, ``n_hit``, ``__hit_words`` (a bit per word) and
    ``__hit_items`` (ids of the items with a window in the text, sorted)."""
    sc = docs.sparkSession.sparkContext
    none = F.lit(0).cast("long")
    out = docs.withColumns(
        {"n_words": none, "n_hit": none, MARKS: F.lit(None).cast("binary"), ITEMS: F.lit(None).cast("array<string>")}
    )
    schema, text_at = out.schema, out.columns.index("text")
    blocks = iter(_blocks(benchmark, block_bytes))
    for ids, texts in chain([next(blocks, ([], []))], blocks):  # no benchmark: one empty block, for the word counts
        out = out.mapInArrow(_pass(sc.broadcast(Block(ids, texts, span, k)), text_at), schema)
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_words, n_hit, items`` (sorted ids), ``contaminated``."""
    s = scan_benchmark(docs.select("doc_id", F.col("text").cast("string").alias("text")), benchmark, **options)
    return s.select(
        "doc_id", "n_words", "n_hit", F.coalesce(ITEMS, F.array().cast("array<string>")).alias("items"), (F.col("n_hit") > 0).alias("contaminated")
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that share no window with the benchmark, columns as they are."""
    return scan_benchmark(boxed(docs), benchmark, **options).where("n_hit = 0").transform(unboxed, docs)
