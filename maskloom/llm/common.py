"""Small helpers the operators of this folder share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of the whitespace contracts: everything but space and \t \n \v \f \r.
SPACE_CLASS = r"[\x20\x09-\x0D]+"
WORD_CLASS = r"[^\x20\x09-\x0D]+"

#: Bytes of text that a task works on at a time (one longer document is one piece).
CHUNK_BYTES = 2 << 20


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the package to the executors' Python through Spark's own file
    server, once per application, so that it need not be installed there."""
    sc = spark.sparkContext
    if sc.applicationId not in _SHIPPED:
        package = Path(__file__).resolve().parents[1]
        d = tempfile.mkdtemp(prefix="maskloom-package-")  # the driver's own copy, served as long as it lives
        atexit.register(shutil.rmtree, d, ignore_errors=True)
        sc.addPyFile(shutil.make_archive(f"{d}/{package.name}", "zip", package.parent, package.name))
        _SHIPPED.add(sc.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def boxed(docs: DataFrame) -> DataFrame:
    """``row`` (all columns of ``docs`` but the text) and ``text``: beside them no name
    that an operator adds can meet one of the caller's."""
    others = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    return docs.select(F.struct(*others, F.lit(0).alias("__boxed")).alias("row"), F.col("text").cast("string").alias("text"))


def unboxed(rows: DataFrame, docs: DataFrame, *added: str, **changed: Column) -> DataFrame:
    """The rows of :func:`boxed` with the columns of ``docs`` in their order, some ``changed``, and ``added`` ones."""
    text = F.col("text").cast(docs.schema["text"].dataType)
    own = [changed.get(c, text if c == "text" else F.col("row")[c]).alias(c) for c in docs.columns]
    return rows.select(*own, *added)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row.

    A lambda variable is bound once; a plain reference would be copied into
    every lambda that mentions it and evaluated per element.
    """
    return F.transform(F.array(value), body)[0]


def doc_bucket(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n`` (null id: null)."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and its n+1 offsets; null counts as empty."""
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    a = pc.fill_null(a.cast(pa.large_string()), "")
    offsets = np.frombuffer(a.buffers()[1], dtype=np.int64)[a.offset : a.offset + len(a) + 1]
    data = a.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def text_codes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts of a piece, and their offsets in them."""
    codes = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    return codes, np.r_[0, np.cumsum((data & 0xC0) != 0x80)][offsets]


def pieces(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of documents ``[i, j)`` of at most ``limit`` bytes, or a single longer one."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def word_spans(is_word: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the words of each document, and the words per document.

    ``is_word`` flags the bytes of a piece, ``offsets`` are the document
    borders inside it; a word never crosses a border.
    """
    n = len(is_word)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets) - 1, np.int64)
    border = np.zeros(n + 1, bool)
    border[offsets] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = is_word[:-1]
    starts = np.flatnonzero(is_word & (~before | border[:n]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = is_word[1:]
    ends = np.flatnonzero(is_word & (~after | border[1:])) + 1
    at = np.searchsorted(starts, offsets)
    return starts, ends, np.diff(at)


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_NOT_SPACE = np.ones(256, bool)
_NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z, every other byte as it is."""
    return _LOWER[data]


def not_space(data: np.ndarray) -> np.ndarray:
    return _NOT_SPACE[data]


_BASE = 0x9E3779B97F4A7C15
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = max(n, CHUNK_BYTES + 1)
        for name, b in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            _POWERS[name] = np.multiply.accumulate(p)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def mix64(h: np.ndarray) -> np.ndarray:
    """Bit finaliser (the public MurmurHash3 one)."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


class SpanHash:
    """64-bit hashes of any spans of a code array: one prefix sum, then O(1) a span."""

    def __init__(self, codes: np.ndarray):
        up, self.down = _powers(len(codes) + 1)
        self.prefix = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * up[:-1], out=self.prefix[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        h = (self.prefix[ends] - self.prefix[starts]) * self.down[starts]
        return mix64(h + (ends - starts).astype(np.uint64))
