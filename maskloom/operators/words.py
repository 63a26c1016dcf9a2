"""Custom-word dictionary operators (inventory W1–W6, R9, R10).

The dictionary is a table ``custom_words(original, replacement, priority)``;
insertion order is semantic, so it is an explicit ``priority`` column.
Applying it is a chained literal replace in priority order (a→b then b→c
turns a into c).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..session import stored

WORDS_SCHEMA = "original string, replacement string, priority long"
_WORD = "struct<priority:bigint,original:string,replacement:string>"

#: Characters of the longest anchor of a word; a shorter word is its own anchor.
ANCHOR_MAX = 64
#: Logarithm of the most bits that mark anchors (2 ** 27: 16 MiB, one word in eleven
#: bits at 12 million words); bits that mark one, and times their number that there are bits for it.
MARK_BITS_LOG2, MARKS, BITS_A_MARK = 27, 3, 8
#: Logarithm of the bits that mark the first two characters of anchors; they stand behind the others.
LEAD_BITS_LOG2 = 20
#: Characters of texts whose grams are taken at a time.
SEGMENT = 1 << 18
#: Stands where text far from replacements is left out (a text that holds it itself is looked through whole).
CUT = "\uffff"


def _valid(words: DataFrame) -> DataFrame:
    return words.filter(
        (F.coalesce(F.char_length("original"), F.lit(0)) > 0) & (F.coalesce(F.char_length("replacement"), F.lit(0)) > 0)
    )


def upsert_words(words: DataFrame, updates: DataFrame) -> DataFrame:
    """Add or replace words; empty originals or replacements are rejected.
    A replaced word keeps its place; new words follow, in update order; the
    last update of a word wins."""
    upd = _valid(updates).groupBy("original").agg(
        F.max_by("replacement", "priority").alias("_r"), F.min("priority").alias("_p")
    )
    top = words.agg(F.max("priority").alias("m")).first()["m"]  # one scalar
    base = int(top) if top is not None else 0
    j = words.join(upd, "original", "full_outer")
    return j.select(
        "original",
        F.coalesce(F.col("_r"), F.col("replacement")).alias("replacement"),
        F.coalesce(F.col("priority"), F.lit(base) + F.col("_p")).cast("long").alias("priority"),
    )


def remove_words(words: DataFrame, originals: DataFrame) -> DataFrame:
    """Drop the given originals."""
    return words.join(originals.select("original").distinct(), "original", "left_anti")


def list_words(words: DataFrame) -> DataFrame:
    """The words in insertion order with their 0-based position (a
    distributed rank, not one window over the whole dictionary)."""
    from .strategies import rank_within

    ranked = rank_within(words.select("original", "replacement", "priority", F.lit(0).alias("_g")), "_g", "priority", "_rk")
    return ranked.select("original", "replacement", (F.col("_rk") - 1).cast("long").alias("position"))


def sync_words(local: DataFrame, strategy: DataFrame) -> DataFrame:
    """Union of both; the local dictionary wins conflicts; words only the
    strategy has are appended after the local ones."""
    top = local.agg(F.max("priority").alias("m")).first()["m"]
    base = int(top) if top is not None else 0
    s = strategy.select("original", F.col("replacement").alias("_sr"), F.col("priority").alias("_sp"))
    j = local.join(s, "original", "full_outer")
    return j.select(
        "original",
        F.coalesce(F.col("replacement"), F.col("_sr")).alias("replacement"),
        F.coalesce(F.col("priority"), F.lit(base) + F.col("_sp")).cast("long").alias("priority"),
    )


def merge_words(layers: Sequence[DataFrame]) -> DataFrame:
    """Stored ← strategy ← call argument: a later layer's value wins, a
    word keeps the place where it first appeared (lowest layer, its order)."""
    tagged = None
    for i, d in enumerate(layers):
        t = d.select("original", "replacement", "priority", F.lit(i).alias("layer"))
        tagged = t if tagged is None else tagged.unionByName(t)
    agg = tagged.groupBy("original").agg(
        F.max_by("replacement", F.struct("layer", "priority")).alias("replacement"),
        F.min(F.struct("layer", "priority")).alias("_pos"),
    )
    return agg.select("original", "replacement", "_pos.layer", F.col("_pos.priority").alias("layer_priority"))


# ---------------------------------------------------------------------------
# Apply the dictionary
# ---------------------------------------------------------------------------

def anchored_words(words: DataFrame) -> DataFrame:
    """``original, replacement, priority, anchor``: every word with the gram by which texts find it.

    That is the word itself, so a text meets no words that it does not hold.
    Of a word of over ``ANCHOR_MAX`` characters it is the gram of that size at
    its beginning or its end that fewer words share.
    """
    w = _valid(words).select("original", "replacement", F.col("priority").cast("long").alias("priority"))
    size = F.least(F.char_length("original"), F.lit(ANCHOR_MAX))
    ends = w.withColumn("_g", F.array(F.substring("original", F.lit(1), size), F.substring("original", F.char_length("original") - size + 1, size)))
    each = ends.select("*", F.posexplode("_g").alias("_at", "_gram"))
    shared = each.groupBy("_gram").agg(F.count("*").alias("_n"))
    best = F.min(F.struct("_n", "_at", F.col("_gram").alias("anchor")))
    picked = each.join(shared, "_gram").groupBy("original", "replacement", "priority").agg(best.alias("_b"))
    return picked.select("original", "replacement", "priority", F.col("_b.anchor").alias("anchor"))


def _gram_finder(sizes: Sequence[int], log2: int) -> tuple[Callable, Callable]:
    """``(places, grams)``: the places that mark the anchors of a list, and the marked grams of each text.

    The hash of a gram is put together from those of its first and its last
    2^k characters, which are the same for all sizes; so a text is hashed once
    per power of two, and each size takes one more look.  Where few places of a text
    hold the first two characters of an anchor, only what stands there is hashed.
    """
    one = lambda n: np.uint64(n)
    lead = min(2, sizes[0])

    def mixed(x: np.ndarray) -> np.ndarray:
        x = (x ^ (x >> one(32))) * one(0xD6E8FEB86659FD93)
        return x ^ (x >> one(29))

    pair = lambda a, b: mixed(a * one(0x9E3779B97F4A7C15) + (b ^ (b >> one(31))))
    codes_of = lambda text: np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)

    def leads(codes: np.ndarray) -> np.ndarray:
        """Per character the place that marks it and the next as the first two of an anchor."""
        h = codes[: max(len(codes) - lead + 1, 0)] * np.uint32(0x9E3779B1)
        if lead == 2:
            h += codes[1:] * np.uint32(0x85EBCA6B)
        return h >> np.uint32(32 - LEAD_BITS_LOG2)

    def hashes(codes: np.ndarray) -> list[np.ndarray]:
        """Per size the hash of the gram that begins at each character."""
        h = mixed(codes.astype(np.uint64) + one(1))
        out, length, n = [], len(h), 1
        for size in sizes:
            while 2 * n <= size and len(h) > n:
                h, n = pair(h[:-n], h[n:]), 2 * n
            out.append(h[:0] if length < size else pair(h[: length - size + 1], h[size - n :][: length - size + 1]) + one(size))
        return out

    def hashes_at(codes: np.ndarray, begins: np.ndarray) -> list[np.ndarray]:
        """The same at some characters only (beyond the end of the text: of anything)."""
        padded = np.concatenate([codes, np.zeros(sizes[-1], np.uint32)])
        h = mixed(padded[begins[:, None] + np.arange(sizes[-1])].astype(np.uint64) + one(1))
        out, n = [], 1
        for size in sizes:
            while 2 * n <= size:
                h, n = pair(h[:, :-n], h[:, n:]), 2 * n
            out.append(pair(h[:, 0], h[:, size - n]) + one(size))
        return out

    def at(h: np.ndarray) -> list[np.ndarray]:
        mask = one((1 << log2) - 1)
        return [h & mask, (h >> one(37)) & mask, mixed(h) & mask][:MARKS]

    def places(anchors: list[str]) -> np.ndarray:
        found = []
        for a in anchors:
            codes = codes_of(a)
            found += [np.stack(at(hashes(codes)[sizes.index(len(a))][:1])).ravel(), leads(codes)[:1].astype(np.uint64) + one(1 << log2)]
        return np.concatenate(found) if found else np.zeros(0, np.uint64)

    def grams(texts: Sequence[str], bits: np.ndarray) -> list[list[str]]:
        """Distinct marked grams of each text."""
        out, first = [dict() for _ in texts], 0
        leading = np.unpackbits(bits[1 << (log2 - 3) :], bitorder="little").view(bool)
        while first < len(texts):
            last, room = first + 1, SEGMENT - len(texts[first])
            while last < len(texts) and len(texts[last]) <= room:
                room -= len(texts[last])
                last += 1
            whole = "".join(texts[first:last])
            ends = np.cumsum([len(x) for x in texts[first:last]])
            codes = codes_of(whole)
            led = np.flatnonzero(leading[leads(codes)])
            few = len(led) * sizes[-1] <= len(codes)
            for size, h in zip(sizes, () if len(led) == 0 else hashes_at(codes, led) if few else hashes(codes)):
                begins = np.arange(len(h))
                for p in at(h):
                    p = p[begins]
                    begins = begins[(bits[p >> one(3)] >> (p & one(7)).astype(np.uint8)) & 1 == 1]
                begins = led[begins] if few else begins
                owner = np.searchsorted(ends, begins, "right")
                inside = begins + size <= ends[owner] if len(begins) else begins
                for b, o in zip(begins[inside].tolist(), owner[inside].tolist()) if len(begins) else ():
                    out[first + o][whole[b : b + size]] = None
            first = last
        return [list(d) for d in out]

    return places, grams


class _Anchors:
    """The grams of texts that may be anchors.

    Bits mark the hashes of all anchors (a Bloom filter, sent along with the
    functions that look through texts).  They only keep grams of no word away from the join, which decides.
    """

    def __init__(self, dictionary: DataFrame):
        of = dictionary.agg(F.count("*").alias("n"), F.collect_set(F.char_length("anchor")).alias("sizes")).first()  # ANCHOR_MAX sizes at most
        self.sizes = sorted(of["sizes"])
        if not self.sizes:
            return
        log2 = min(max((MARKS * BITS_A_MARK * of["n"]).bit_length(), 10), MARK_BITS_LOG2)
        places, self.grams = _gram_finder(self.sizes, log2)

        def marked(anchor: pa.Array) -> pa.Array:
            at = pa.array(places(anchor.to_pylist()).astype(np.int64))
            return pa.ListArray.from_arrays(pa.array(np.arange(len(anchor) + 1) * (MARKS + 1), pa.int32()), at)

        marks = dictionary.select(F.explode(F.arrow_udf(marked, "array<long>")("anchor")).alias("at"))
        marks = marks.select(F.shiftright("at", 6).cast("int").alias("i"), (F.col("at") % 64).cast("int").alias("b"), F.expr("1L").alias("one"))
        table = marks.groupBy("i").agg(F.bit_or(F.expr("shiftleft(one, b)")).alias("m")).toArrow()  # at most 2 ** (MARK_BITS_LOG2 - 6) rows, and those of LEAD_BITS_LOG2
        longs = np.zeros((1 << (log2 - 6)) + (1 << (LEAD_BITS_LOG2 - 6)), np.dtype("<i8"))
        longs[table["i"].to_numpy()] = table["m"].to_numpy()
        self.bits = longs.view(np.uint8)

    def __call__(self, text: Column) -> Column:
        """Distinct marked grams of a text (of a null one: none)."""
        grams, bits = self.grams, self.bits

        def found(texts: pa.Array) -> pa.Array:
            return pa.array(grams([x or "" for x in texts.to_pylist()], bits), pa.list_(pa.string()))

        return F.arrow_udf(found, "array<string>")(text)


def _chain(text: Column, found: Column, known: Column, anchors: _Anchors) -> Column:
    """``struct<t, at, stop>``: the words of ``found`` replaced in order, up to the first
    replacement beside which a marked gram arises that is not in ``known``; ``at``: place of the last word replaced."""
    reach, grams, bits = max(anchors.sizes) - 1, anchors.grams, anchors.bits

    def beside(pieces: list[str], repl: str, whole: str) -> list[str]:
        """What stands near the replacements: inner text further away is cut out."""
        if CUT in whole:
            return [whole]
        short = lambda p: p[:reach] + CUT + p[len(p) - reach :] if len(p) > 2 * reach else p
        return repl.join(map(short, pieces)).split(CUT)

    def rows_of(lists: pa.Array, field: str | None = None) -> list[list]:
        """The lists of a batch, of structs only a field: through one flat array, as a value at a time is slow."""
        flat = lists.flatten()
        values = (flat if field is None else flat.field(field)).to_numpy(zero_copy_only=False).tolist()
        ends = np.cumsum(lists.value_lengths().fill_null(0).to_numpy()).tolist()
        return [values[a:b] for a, b in zip([0, *ends], ends)]

    def run(texts: pa.Array, lists: pa.Array, marked: pa.Array) -> pa.Array:
        t, known = texts.to_pylist(), [set(k) for k in rows_of(marked)]
        words = [[*zip(*w)] for w in zip(rows_of(lists, "original"), rows_of(lists, "replacement"))]
        at, stop, rest, going = [-1] * len(t), [False] * len(t), [0] * len(t), list(range(len(t)))
        while going:  # the next replacement in every text, then one look at all that stands beside them
            near, owner = [], []
            for k in going:
                for j in range(rest[k], len(words[k])):
                    original, repl = words[k][j]
                    if original in t[k]:
                        pieces = t[k].split(original)
                        t[k], at[k], rest[k] = repl.join(pieces), j, j + 1
                        beside_it = beside(pieces, repl, t[k])
                        near += beside_it
                        owner += [k] * len(beside_it)
                        break
            for k, arisen in zip(owner, grams(near, bits)):
                stop[k] = stop[k] or not known[k].issuperset(arisen)
            going = [k for k in dict.fromkeys(owner) if not stop[k]]
        return pa.StructArray.from_arrays([pa.array(t, pa.string()), pa.array(at, pa.int32()), pa.array(stop, pa.bool_())], ["t", "at", "stop"])

    return F.arrow_udf(run, "struct<t:string,at:int,stop:boolean>")(text, found, known)


def apply_custom_words(docs: DataFrame, text_col: str, words: DataFrame, out_col: str = "text",
                       keep_cols: Sequence[str] | None = None) -> DataFrame:
    """Chained literal replace of every word, in order of priority (ties: of the word).

    The dictionary stays a table.  Each text's grams that are marked as
    anchors are joined with it, and the text gets the short ordered list of
    the words it may hold.  That list is replaced in order; where a
    replacement lets a gram arise beside it that may be the anchor of a word
    not on the list, the text waits with the priority it has reached and is
    joined again in the next round.  So the result equals the plain chained
    replace, and the rounds are as many as the longest such chain, not as many
    as there are words.  Texts without a marked gram are not shuffled.
    """
    keep = [c for c in (list(docs.columns) if keep_cols is None else keep_cols) if c != out_col]
    dictionary = stored(anchored_words(words), "words")
    anchors = _Anchors(dictionary)
    if not anchors.sizes:
        return docs.select(*keep, F.col(text_col).alias(out_col))
    text = F.col("t")
    row = F.struct(*[F.col(c) for c in keep], F.lit(0).alias("_"))
    placed = docs.select(row.alias("row"), F.col(text_col).alias("t")).withColumn("hits", anchors(text))
    first = stored(placed.withColumn("place", F.monotonically_increasing_id()).withColumn("last", F.lit(None).cast(_WORD)), "words_round")
    rounds, todo = [first.where(F.size("hits") == 0)], first.where(F.size("hits") > 0)
    while not todo.isEmpty():
        met = C.explode_rows(todo, ["place", "last"], F.col("hits"), "anchor").join(dictionary, "anchor")
        word = F.struct("priority", "original", "replacement")
        lists = met.where(F.col("last").isNull() | (word > F.col("last"))).groupBy("place").agg(F.sort_array(F.collect_list(word)).alias("found"))
        listed = todo.join(lists, "place", "left").withColumn("found", F.coalesce("found", F.array().cast(f"array<{_WORD}>")))
        chained = listed.withColumn("c", _chain(text, F.col("found"), F.col("hits"), anchors))
        last = F.when(F.col("c.at") >= 0, F.get("found", F.col("c.at")))
        moved = chained.select("row", F.col("c.t").alias("t"), "place", last.alias("last"), F.col("c.stop").alias("stop"))
        again = stored(moved.withColumn("hits", anchors(F.when(F.col("stop"), text))), "words_round")
        rounds.append(again.where(~F.col("stop")))
        todo = again.where("stop").drop("stop")
    done = reduce(DataFrame.unionByName, [r.select("row", "t") for r in rounds])
    return done.select(*[F.col("row")[c].alias(c) for c in keep], F.col("t").alias(out_col))


def remask_incremental(docs: DataFrame, text_col: str, id_cols: Sequence[str], previous: DataFrame,
                       words: DataFrame, mask_fn) -> DataFrame:
    """A text that already has a masked output gets only the custom
    words applied to that output (when there are custom words); every other
    text (without custom words: every text) goes through the full mask ``mask_fn(df) -> df(ids…, masked)``."""
    if words.isEmpty():
        return mask_fn(docs).select(*id_cols, "masked")
    prev = previous.select(*id_cols, F.col("masked").alias("_prev"))
    j = docs.join(prev, list(id_cols), "left")
    redo = j.filter(F.col("_prev").isNull()).drop("_prev")
    fresh = mask_fn(redo).select(*id_cols, "masked")
    again = j.filter(F.col("_prev").isNotNull()).select(*id_cols, F.col("_prev").alias("masked"))
    again = apply_custom_words(again, "masked", words, out_col="masked", keep_cols=list(id_cols))
    return fresh.unionByName(again)
