"""Spelling variants by pivotal grams.

Words that differ by one inserted, deleted or replaced code point are near.
Bigrams are ranked by how many words hold them, the rarest first.  A word's
*prefix* is its three rarest bigram positions, with every further position of
the last one's gram; among three positions two are disjoint, and a dynamic
program picks the two disjoint *pivots* that the fewest words hold.  One edit
touches at most one of two disjoint pivots, so of two near words the one whose
prefix ends first in rank has a pivot in the other's prefix.

Position limits: the edit lies on one side of the surviving pivot, so up to
its end, or from its start on, the words are equal, their lengths differ by one
at most, and of the rest of the word one half is equal as well.  The index
therefore holds each prefix gram under hashes of (the text up to the gram's end
or from its start on, a half of the rest, the length), and the pivots probe it
with three lengths.  The gram and its place are part of such a key.  Pairs that
meet are verified with the edit distance.

Defined cases: a null text has no words, a null id counts as an empty one;
equal rows count as often as they occur; an empty table gives no rows; other
columns of the input are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored

#: Runs of letters; shorter runs than ``MIN_LENGTH`` cannot become words.
LETTERS = r"[A-Za-zÀ-ÿ]"
MIN_LENGTH, MIN_COUNT, FORM_RATIO = 7, 2, 10
DELETE_ONE_IN = 31
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Pivots a word, and positions of its prefix: a gram length of two times one edit, and one more.
PIVOTS, PREFIX = 2, 3


def words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``word, n``: the runs of all texts, each 31st by checksum short of one
    code point, that are long and frequent enough."""
    runs = F.regexp_extract_all(F.col(text_col), F.lit(LETTERS + "{%d,}" % MIN_LENGTH), 0)
    # an inner explode would have its array tested, and so computed, a second time below it
    low = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode_outer(runs).alias("run"))
    low = low.select("id", F.translate("run", UPPER, LOWER).alias("run")).where(F.col("run").isNotNull())
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    at = (F.col("h") % F.char_length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
    word = low.withColumn("h", h).select(F.when(F.col("h") % DELETE_ONE_IN == 0, cut).otherwise(F.col("run")).alias("word"))
    counts = word.where(F.char_length("word") >= MIN_LENGTH).groupBy("word").agg(F.count("*").alias("n"))
    return counts.where(F.col("n") >= MIN_COUNT)


def _grams(word: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.char_length(word) - 1), lambda i: F.substring(word, i, F.lit(2)))


def gram_ranks(vocabulary: DataFrame) -> DataFrame:
    """``gram, held``: words that hold each bigram.  At most 90 * 90 rows (a-z and
    the 64 letters from U+00C0 on), a proven bound."""
    return vocabulary.select(F.explode(F.array_distinct(_grams(F.col("word")))).alias("gram")).groupBy("gram").agg(F.count("*").alias("held"))


def pivots(prefix: list[tuple[int, int]], count: int = PIVOTS) -> list[int]:
    """Positions of ``count`` disjoint bigrams of the least total weight.  ``prefix``
    holds (position, weight) by rising position; ``least[k]`` is the best choice of k
    grams among those passed, ``history`` keeps it as it was after each of them."""
    none = (float("inf"), [])
    history: list[tuple[int, list]] = []
    least = [(0, [])] + [none] * count
    for at, weight in prefix:
        base = [(0, [])] + [none] * count
        for place, best in history:  # the choices that end at least two places before this gram
            if place <= at - 2:
                base = best
        new = list(least)
        for k in range(1, count + 1):
            total = base[k - 1][0] + weight
            if total < new[k][0]:
                new[k] = (total, [*base[k - 1][1], at])
        least = new
        history.append((at, least))
    return least[count][1]


def signatures(vocabulary: DataFrame) -> DataFrame:
    """``word, n, ends, prefix, pivot``: ``ends`` is the rank of the prefix's last gram, the
    rarest gram being 0, ``prefix`` and ``pivot`` are positions from 0."""
    grams = sorted((r["held"], r["gram"]) for r in gram_ranks(vocabulary).collect())  # at most 8,100 rows
    ranks = vocabulary.sparkSession.sparkContext.broadcast({g: (k, h) for k, (h, g) in enumerate(grams)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = ranks.value
        for b in batches:
            ends, prefixes, chosen = [], [], []
            for w in b.column(0).to_pylist():
                grams = [rank[w[i : i + 2]] for i in range(len(w) - 1)]
                last = sorted(grams)[PREFIX - 1]
                prefix = [i for i, g in enumerate(grams) if g <= last]
                ends.append(last[0])
                prefixes.append(prefix)
                # the prefix beyond three positions only repeats its last gram, which weighs no less
                chosen.append(pivots([(i, grams[i][1]) for i in prefix]))
            lists = pa.list_(pa.int32())
            yield pa.record_batch([b.column(0), b.column(1), pa.array(ends, pa.int32()), pa.array(prefixes, lists), pa.array(chosen, lists)], ["word", "n", "ends", "prefix", "pivot"])

    return vocabulary.select("word", "n").mapInArrow(run, "word string, n long, ends int, prefix array<int>, pivot array<int>")


def _keys(word: Column, at: Column, size: Column) -> Column:
    """Hashes under which a word and a near one of ``size`` characters meet if the pivot at ``at`` survives.

    The edit is behind the gram or before it (side "<" or ">"), in the rest
    of the word; cut in two as the other word's rest is, at least one half of
    the rest is equal too.
    """
    n = F.char_length(word)
    sides = [
        ("<", F.substring(word, F.lit(1), at + 2), F.substring(word, at + 3, n), n - at - 2),
        (">", F.substring(word, at + 1, n), F.substring(word, F.lit(1), at), at),
    ]
    out = []
    for side, equal, rest, here in sides:
        there = here + size - n  # length of the other word's rest
        front = F.floor(there / 2).cast("int")
        back = there - front
        out.append(F.xxhash64(F.lit(side + "front"), equal, F.substring(rest, F.lit(1), front), size))
        out.append(F.xxhash64(F.lit(side + "back"), equal, F.substring(rest, F.greatest(here - back, F.lit(0)) + 1, back), size))
    return F.array(*out)


def near_pairs(vocabulary: DataFrame) -> DataFrame:
    """``word, n, near, near_n``: every pair of near words, in both directions."""
    s = stored(signatures(vocabulary), "spelling_signatures")
    size = F.char_length("word")
    index = s.select("word", "n", "ends", F.explode("prefix").alias("at")).select(
        F.col("word").alias("near"), F.col("n").alias("near_n"), F.col("ends").alias("near_ends"), F.explode(_keys(F.col("word"), F.col("at"), size)).alias("key")
    )
    probes = s.select("word", "n", "ends", F.explode("pivot").alias("at")).select("word", "n", "ends", "at", F.explode(F.array(size - 1, size, size + 1)).alias("size"))
    probes = probes.select("word", "n", "ends", F.explode(_keys(F.col("word"), F.col("at"), F.col("size"))).alias("key"))
    met = probes.join(index, "key").where((F.col("near_ends") >= F.col("ends")) & (F.col("word") != F.col("near")))
    here, there = F.struct("word", "n"), F.struct(F.col("near").alias("word"), F.col("near_n").alias("n"))
    near = met.where(F.levenshtein("word", "near", 1) == 1).select(F.least(here, there).alias("a"), F.greatest(here, there).alias("b")).distinct()
    both = near.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("p"))
    return both.select("p.a.word", "p.a.n", F.col("p.b.word").alias("near"), F.col("p.b.n").alias("near_n"))


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every word: ``word, form, root, n, n_near, form_n``.

    ``form`` is the most frequent near word (ties: the smallest in code-point
    order) if it occurs at least ten times as often, else null.  ``root``
    follows the forms to the last.
    """
    vocabulary = stored(words(docs, id_col, text_col), "spelling_words")
    best = F.min(F.struct((-F.col("near_n")).alias("k"), F.col("near").alias("form")))
    found = near_pairs(vocabulary).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("b"))
    j = vocabulary.join(found, "word", "left").withColumn("form_n", -F.col("b.k"))
    is_form = F.col("form_n") >= FORM_RATIO * F.col("n")
    table = stored(
        j.select("word", F.when(is_form, F.col("b.form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("form_n")).alias("form_n")),
        "spelling_forms",
    )
    roots = stored(table.where("form is not null").select("word", F.col("form").alias("root")), "spelling_roots")
    while True:
        # each step doubles the way; counts rise tenfold a form, so a way has at most 19 and five steps do
        on = roots.join(roots.select(F.col("word").alias("root"), F.col("root").alias("further")), "root", "left")
        roots = stored(on.select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "spelling_roots")
        if roots.where("moved").isEmpty():
            break
        roots = roots.drop("moved")
    return table.join(roots.select("word", "root"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
