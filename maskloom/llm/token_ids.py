"""Token ids in ORC: encode, write in document order, read back.

Files: one row per document, ``doc_id``, ``part``, ``start_in_part``,
``n_tokens`` and ``ids array<int>`` (end id last).  ORC stores the integers in
its run-length encoding, keeps row indexes, and gets a Bloom filter on
``doc_id``, so readers take stripes in parallel, skip stripes and row groups by
their statistics, and find single documents without reading the rest.
Parts are ranges of ``doc_id`` in ascending order, sorted inside, so a
document's global ``start`` is the sum of the parts before it (one number a
part, read from the ``n_tokens`` column alone) plus ``start_in_part``.

Encoding: the byte-level pre-tokenizer cuts a text into pieces that the
vocabulary encodes independently, and pieces repeat.  Cutting is done on whole
blocks of texts at once by character class; the ``tokenizers`` library encodes
each piece the first time a Python worker meets it, and the ids are then
copied.  (Tests compare with the library's ids of whole texts.)  A text with a
character whose class could differ between Unicode versions is given to the
library as a whole.

Nulls: a null text is empty (the end id alone); rows with a null doc_id come
first; rows with equal doc_id are ordered by the first ``ORDER_CHARS`` characters
of their text, then as they are stored.
"""

from __future__ import annotations

import os
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch_path, stored
from .common import SpanHash, pieces, text_bytes, text_codes

END_ID = 2
#: Pieces a worker remembers; beyond them it starts anew (ids do not depend on it).
MEMORY = 3_000_000
ROW_INDEX_STRIDE = 1000
ORDER_CHARS = 32
_OTHER, _LETTER, _NUMBER, _SPACE, _UNSURE = range(5)
# White_Space property (fixed values)
_WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]

_state: dict = {}


def _byte_chars() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others follow from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(256 + i) for i, b in enumerate(rest)}


_BYTE_CHARS = _byte_chars()
_BYTE_CODES = np.array([ord(_BYTE_CHARS.get(b, chr(b))) for b in range(256)], np.uint32)


def _classes() -> np.ndarray:
    """Character class of every code point; unassigned ones may be assigned elsewhere."""
    if "classes" not in _state:
        kind = {"L": _LETTER, "N": _NUMBER}
        t = np.full(0x110000, _OTHER, np.uint8)
        for c in range(0x110000):
            g = unicodedata.category(chr(c))
            t[c] = _UNSURE if g == "Cn" else kind.get(g[0], _OTHER)
        t[_WHITE] = _SPACE
        _state["classes"] = t
    return _state["classes"]


def cut(codes: np.ndarray, kind: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """Starts of the pre-tokenizer's pieces in texts laid end to end.

    ``'s|'t|'re|'ve|'m|'ll|'d| ?letters+| ?numbers+| ?others+|spaces+(?!\\S)|spaces+``
    """
    n = len(codes)
    if n == 0:
        return np.zeros(0, np.int64)
    first = np.zeros(n + 1, bool)
    first[borders] = True
    last = first[1:].copy()
    last[-1] = True
    first = first[:n]
    first[0] = True
    blank = (codes == 32)
    after_blank = np.r_[False, blank[:-1]] & ~first
    run = first | np.r_[True, kind[1:] != kind[:-1]]
    space = kind == _SPACE
    start = run & ~(~space & after_blank)
    # of a run of spaces before something else, the last stands alone or joins what follows
    start |= space & ~last & np.r_[~space[1:], False]
    quote = np.flatnonzero(start & (codes == 39))
    if len(quote):
        pad = np.r_[codes, 0, 0, 0]
        end = np.r_[last, True, True, True]
        a, b = pad[quote + 1], pad[quote + 2]
        one = ~end[quote] & np.isin(a, [115, 116, 109, 100])
        two = ~end[quote] & ~end[quote + 1] & (((a == 114) | (a == 118)) & (b == 101) | (a == 108) & (b == 108))
        start[quote[one | two] + 1] = False
        stop = np.r_[quote[one] + 2, quote[two] + 3]
        # a new piece begins behind, unless a space there has its own rule
        stop = stop[stop < n]
        start[stop[~space[stop]]] = True
    return np.flatnonzero(start)


class PieceTable:
    """Numbers of 64-bit hashes, in order of their first put: open addressing,
    looked up and filled for many hashes at once."""

    def __init__(self) -> None:
        self.keys, self.values, self.n = np.zeros(1 << 17, np.uint64), np.zeros(1 << 17, np.int32), 0  # key 0: free

    def get(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each hash, -1 where there is none."""
        mask, out = np.uint64(len(self.keys) - 1), np.full(len(hashes), -1, np.int64)
        at = hashes & mask
        key = self.keys[at]
        hit = key == hashes
        out[hit] = self.values[at[hit]]
        open_ = np.flatnonzero(~hit & (key != 0))
        while len(open_):
            at[open_] = (at[open_] + np.uint64(1)) & mask
            slot, want = at[open_], hashes[open_]
            key = self.keys[slot]
            hit = key == want
            out[open_[hit]] = self.values[slot[hit]]
            open_ = open_[~hit & (key != 0)]
        return out

    def put(self, hashes: np.ndarray) -> None:
        """Add distinct hashes that are not in the table yet."""
        numbers = np.arange(self.n, self.n + len(hashes), dtype=np.int32)
        self.n += len(hashes)
        if 2 * self.n > len(self.keys):
            held = self.keys != 0
            hashes, numbers = np.r_[self.keys[held], hashes], np.r_[self.values[held], numbers]
            size = 1 << (4 * self.n).bit_length()
            self.keys, self.values = np.zeros(size, np.uint64), np.zeros(size, np.int32)
        mask = np.uint64(len(self.keys) - 1)
        at = hashes & mask
        while len(hashes):
            free = self.keys[at] == 0
            self.keys[at[free]] = hashes[free]  # of several for one slot the last stays
            mine = free & (self.keys[at] == hashes)
            self.values[at[mine]] = numbers[mine]
            hashes, numbers, at = hashes[~mine], numbers[~mine], (at[~mine] + np.uint64(1)) & mask


class Encoder:
    """Ids of whole texts, through a memory of pieces."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True  # their names in a text are ordinary text
        self.clear()

    def clear(self) -> None:
        self.places = PieceTable()
        self.begin, self.size = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32)
        self.flat, self.used = np.zeros(1 << 18, np.int32), 0

    def whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch(texts, add_special_tokens=False)]

    def learn(self, hashes: np.ndarray, codes: np.ndarray, sizes: np.ndarray) -> None:
        """Ids of single pieces, laid end to end in ``codes``, from the library's vocabulary model."""
        k, tokenize = self.places.n, self.library.model.tokenize
        utf8 = np.frombuffer(codes.tobytes().decode("utf-32-le").encode(), np.uint8)
        letters = _BYTE_CODES[utf8].tobytes().decode("utf-32-le")
        first = np.r_[np.flatnonzero((utf8 & 0xC0) != 0x80), len(utf8)]
        border = first[np.r_[0, np.cumsum(sizes)]].tolist()
        ids = [[x.id for x in tokenize(letters[a:b])] for a, b in zip(border, border[1:])]
        sizes = np.fromiter(map(len, ids), np.int32, len(ids))
        new = np.fromiter((x for i in ids for x in i), np.int32, int(sizes.sum()))
        while k + len(ids) > len(self.begin):
            self.begin, self.size = np.resize(self.begin, 2 * len(self.begin)), np.resize(self.size, 2 * len(self.size))
        while self.used + len(new) > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        self.begin[k : k + len(ids)] = self.used + np.cumsum(sizes) - sizes
        self.size[k : k + len(ids)] = sizes
        self.flat[self.used : self.used + len(new)] = new
        self.used += len(new)
        self.places.put(hashes)

    def encode(self, data: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts laid end to end, each closed by ``end_id``, and the ids per text."""
        codes, chars = text_codes(data, offsets)
        kind = _classes()[codes]
        unsure = np.flatnonzero(kind == _UNSURE)
        odd = np.unique(np.searchsorted(chars, unsure, side="right") - 1)
        starts = cut(codes, kind, chars[:-1])
        ends = np.r_[starts[1:], len(codes)]
        h = np.maximum(SpanHash(codes)(starts, ends), np.uint64(1))
        if self.places.n > MEMORY:
            self.clear()
        at = self.places.get(h)
        miss = np.flatnonzero(at < 0)
        if len(miss):
            new, i = np.unique(h[miss], return_index=True)
            i = miss[i]
            sizes = ends[i] - starts[i]
            self.learn(new, codes[np.repeat(starts[i] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())], sizes)
            at[miss] = self.places.get(h[miss])
        size = self.size[at].astype(np.int64)
        total = int(size.sum())
        ids = self.flat[np.repeat(self.begin[at] - (np.cumsum(size) - size), size) + np.arange(total)]
        upto = np.r_[0, np.cumsum(size)][np.searchsorted(starts, chars)]
        count = np.diff(upto)
        if len(odd):
            parts = np.split(ids, upto[1:-1])
            for d, own in zip(odd, self.whole([codes[chars[d] : chars[d + 1]].tobytes().decode("utf-32-le") for d in odd])):
                parts[d], count[d] = np.array(own, np.int32), len(own)
            ids, total = np.concatenate(parts), int(count.sum())
        out = np.empty(total + len(count), np.int32)
        out[np.arange(total) + np.repeat(np.arange(len(count)), count)] = ids
        out[np.cumsum(count + 1) - 1] = end_id
        return out, count + 1


def _encode_batches(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if _state.get("path") != path:
            _state.update(path=path, encoder=Encoder(path))
        enc, start = _state["encoder"], 0
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            for i, j in pieces(offsets):
                ids, count = enc.encode(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], end_id)
                begin = np.cumsum(count) - count
                rows = pa.ListArray.from_arrays(pa.array(np.r_[begin, len(ids)].astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(start + begin), pa.array(count), rows], ["doc_id", "start_in_part", "n_tokens", "ids"]
                )
                start += len(ids)

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID) -> None:
    """Encode ``text`` and write ORC files to ``path`` in ascending ``doc_id`` order."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # the beginning of the text and the place let a range end inside the rows of one id
    order = ["doc_id", "begin", "place"]
    d = d.withColumns({"begin": F.substring("text", 1, ORDER_CHARS), "place": F.monotonically_increasing_id()})
    d = d.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    rows = d.mapInArrow(_encode_batches(tokenizer, end_id), "doc_id long, start_in_part long, n_tokens long, ids array<int>")
    (
        rows.select("doc_id", F.spark_partition_id().alias("part"), "start_in_part", "n_tokens", "ids")
        .write.option("compression", "zstd")
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.row.index.stride", str(ROW_INDEX_STRIDE))
        .orc(path)
    )


_FILE_SCHEMA = "doc_id long, part int, start_in_part long, n_tokens long, ids array<int>"


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the files with each document's global ``start``."""
    files = spark.read.schema(_FILE_SCHEMA).orc(path)
    sums = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))  # one row a part
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = stored(sums.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")), "part_starts")
    return files.join(before, "part").withColumn("start", F.col("before") + F.col("start_in_part")).drop("before")


def _digest_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids = b.column(2)
        at = ids.offsets.to_numpy()
        flat = np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False), "<u4")
        crc = [zlib.crc32(flat[i:j]) for i, j in zip(at[:-1], at[1:])]
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), pa.array(np.diff(at).astype(np.int64)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"]
        )


def token_digest(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of the files, from the ids themselves."""
    rows = read_tokens(spark, path).select("doc_id", "start", "ids")
    return rows.mapInArrow(_digest_batches, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_table(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """Write to a fresh folder of the shared scratch space and digest what is read back."""
    spark = docs.sparkSession
    path = scratch_path(spark, "token_ids")
    write_tokens(docs, path, tokenizer, end_id)
    return token_digest(spark, path)
