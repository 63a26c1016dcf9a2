"""Quality rules with adaptive thresholds, in built-in columns alone.

Each text gets integer signals (per-mille rates).  Per language and source the
signals are summarised in a mergeable quantile sketch: a count per log-linear
bucket (values keep their five leading bits, so a quantile is off by at most
1/32).  Bucket counts add up exactly, whatever the partitioning or merge
order, and roll up from (lang, source) to lang to everything.  Thresholds are
fences around the quartiles of the finest group that holds ``MIN_GROUP``
documents, ``FENCE`` interquartile ranges away plus the signal's ``SLACK`` (a
group whose documents all agree has no spread).  Documents are joined with
the thresholds of their group and kept inside all fences.

Documents that fail the base rule neither enter the sketches nor are kept.
Nulls: a null text has no words and fails the base rule; a null lang or source
is a group of its own.  Repeated rows each count.  Empty input: no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from .common import SPACE_CLASS, WORD_CLASS, let

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MIN_GROUP = 100
FENCE = 3
EXACT_BITS = 5
LAST = 2
#: Signals and the distance from the quartiles that is always allowed.
SLACK = {"symbols": 10, "shouts": 10, "capitals": 100, "dup_lines": 400, "repeats": 250, "word_length": 100}
#: Signals whose low values are suspicious as well.
TWO_SIDED = ("word_length",)


def _repeat_words(words: Column) -> Column:
    """Words inside three-word windows that the text holds at least twice."""

    def covered(w: Column) -> Column:
        keys = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2]))

        def count(k: Column) -> Column:
            # windows ordered by key, then place: neighbours with one key are repeats
            s = F.array_sort(F.transform(k, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

            def places(o: Column) -> Column:
                n = F.size(o)
                same = F.filter(
                    F.transform(
                        o,
                        lambda x, j: F.when(
                            ((j > 0) & (F.get(o, j - 1)["h"] == x["h"])) | ((j < n - 1) & (F.get(o, j + 1)["h"] == x["h"])), x["i"]
                        ),
                    ),
                    lambda x: x.isNotNull(),
                )
                # each window adds the words that the one before it has not covered
                first = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n"))
                step = lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(3), p - acc["last"])).alias("n"))
                return F.aggregate(F.array_sort(same), first, step, lambda acc: acc["n"])

            return F.when(F.size(F.array_distinct(k)) == F.size(k), 0).otherwise(let(s, places))

        return F.when(F.size(w) < 3, 0).otherwise(let(keys, count))

    return covered(words)


def base_counts(docs: DataFrame) -> DataFrame:
    """Adds the base counts, the further counts of the signals, and ``base_failed``."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    not_blank = lambda a: F.filter(a, lambda x: x != "")
    words = not_blank(F.split(text, SPACE_CLASS))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD_CLASS))
    length = lambda t: F.length(t).cast("long")
    without = lambda pattern: length(text) - length(F.regexp_replace(text, pattern, ""))
    per_words = let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _repeat_words(w).cast("long").alias("n_repeat_words")))
    per_lines = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    out = docs.withColumns(
        {
            "__w": per_words, "__l": per_lines, "word_chars": length(F.regexp_replace(text, SPACE_CLASS, "")),
            "n_symbols": without(r"[#*$%&|<>]+"), "__shouts": without(r"[!?]+"), "__capitals": without("[A-Z]+"),
        }
    )
    out = out.withColumns(
        {
            "n_words": F.col("__w.n_words"), "n_repeat_words": F.col("__w.n_repeat_words"), "n_lines": F.col("__l.n_lines"),
            "n_dup_lines": F.col("__l.n_dup_lines"), "n_shouts": F.col("__shouts"), "n_capitals": F.col("__capitals"),
        }
    ).drop("__w", "__l", "__shouts", "__capitals")
    return out.withColumn(
        "base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    )


def signals() -> dict[str, Column]:
    def rate(n: str, of: str, by: int = 1000) -> Column:
        return F.when(F.col(of) > 0, F.floor(F.lit(by) * F.col(n) / F.col(of))).otherwise(0).cast("long")

    return {
        "symbols": rate("n_symbols", "word_chars"),
        "shouts": rate("n_shouts", "word_chars"),
        "capitals": rate("n_capitals", "word_chars"),
        "dup_lines": rate("n_dup_lines", "n_lines"),
        "repeats": rate("n_repeat_words", "n_words"),
        "word_length": rate("word_chars", "n_words", 100),
    }


def bucket(v: Column) -> Column:
    """The value with all but its ``EXACT_BITS`` leading bits cleared."""
    drop = F.greatest(F.length(F.bin(v)) - EXACT_BITS, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", v, drop), drop)


def sketches(measured: DataFrame) -> DataFrame:
    """``lang, source, signal, bucket, n`` of documents with the columns of ``signals``."""
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("signal"), bucket(F.col(s)).alias("bucket")) for s in SLACK]))
    return measured.select("lang", "source", each.alias("x")).groupBy("lang", "source", "x.signal", "x.bucket").agg(F.count("*").alias("n"))


def thresholds(sketch: DataFrame) -> DataFrame:
    """``lang, source`` and ``low_<signal>`` / ``high_<signal>`` of every group, from the
    finest level with ``MIN_GROUP`` documents."""
    # a sketch row counts for its group, its language and the whole: level and the key columns of that level
    def levels(lang: Column, source: Column) -> Column:
        none = F.lit(None).cast("string")
        keys = [(0, lang, source), (1, lang, none), (LAST, none, none)]
        return F.explode(F.array(*[F.struct(F.lit(i).alias("level"), a.alias("l"), b.alias("s")) for i, a, b in keys]))

    key = ["level", "l", "s"]
    lang, source = F.col("lang").cast("string"), F.col("source").cast("string")
    each = sketch.select("signal", "bucket", "n", levels(lang, source).alias("k")).select("k.*", "signal", "bucket", "n")
    merged = each.groupBy(*key, "signal", "bucket").agg(F.sum("n").alias("n"))
    w = Window.partitionBy(*key, "signal")
    run = merged.withColumns({"upto": F.sum("n").over(w.orderBy("bucket")), "size": F.sum("n").over(w)})
    quartile = lambda q: F.min(F.when(F.col("upto") * 4 >= F.col("size") * q, F.col("bucket")))
    fences = run.groupBy(*key, "signal").agg(quartile(1).alias("q1"), quartile(3).alias("q3"), F.first("size").alias("size"))
    fences = fences.where((F.col("size") >= MIN_GROUP) | (F.col("level") == LAST))
    groups = sketch.select("lang", "source").distinct().select("lang", "source", levels(lang, source).alias("k")).select("lang", "source", "k.*")
    on = [groups[c].eqNullSafe(fences[c]) for c in key]
    usable = groups.join(fences, on[0] & on[1] & on[2]).select("lang", "source", groups["level"], "signal", "q1", "q3")
    best = usable.groupBy("lang", "source", "signal").agg(F.min(F.struct("level", "q1", "q3")).alias("f"))
    slack = F.create_map(*[F.lit(x) for kv in SLACK.items() for x in kv])[F.col("signal")]
    reach = F.lit(FENCE) * (F.col("f.q3") - F.col("f.q1")) + slack
    lines = best.select("lang", "source", "signal", (F.col("f.q1") - reach).alias("low"), (F.col("f.q3") + reach).alias("high"))
    return lines.groupBy("lang", "source").pivot("signal", list(SLACK)).agg(F.first("low").alias("low"), F.first("high").alias("high"))


def quality(docs: DataFrame) -> DataFrame:
    """Per row: ``doc_id``, base counts, ``base_failed``, signals and ``kept``."""
    counted = base_counts(docs.select("doc_id", "text", "lang", "source"))
    rows = stored(counted.select("doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                                 *[c.alias(s) for s, c in signals().items()]), "quality_rows")
    fences = stored(thresholds(sketches(rows.where(~F.col("base_failed")))), "quality_fences")
    inside = F.lit(True)
    for s in SLACK:
        inside = inside & (F.col(s) <= F.col(f"{s}_high"))
        if s in TWO_SIDED:
            inside = inside & (F.col(s) >= F.col(f"{s}_low"))
    f = fences.withColumnsRenamed({"lang": "__lang", "source": "__source"})
    both = rows.join(f, rows["lang"].eqNullSafe(f["__lang"]) & rows["source"].eqNullSafe(f["__source"]), "left")
    return both.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", *SLACK,
        (~F.col("base_failed") & F.coalesce(inside, F.lit(False))).alias("kept"),
    )
