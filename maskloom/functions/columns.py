"""Column-expression building blocks.

Every helper returns a ``Column`` built only from built-in Spark functions,
so whole plans stay inside the JVM (no Python in the row path).
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from operator import and_, or_
from string import ascii_letters, digits

from pyspark.sql import Column
from pyspark.sql import functions as F

from .patterns import (
    CUSTOM_PREFIX,
    REGEX_REGISTRY,
    TOKEN_HEX_LEN,
    TOKEN_PREFIX,
    TOKEN_RE,
    TOKEN_SUFFIX,
    java_pattern,
)

# Private-use code points for transient placeholders.  A text that holds one of
# them itself is escaped first, with its spans (see :func:`escaped`), so that no
# span can match across or inside a placeholder and none is taken for one.
_PH_OPEN = "\ue000"
_PH_CLOSE = "\ue001"
_PH_ESCAPE = "\ue002"
_PH_DIGITS = "".join(chr(0xE010 + i) for i in range(16))
_PH_OWN = _PH_OPEN + _PH_CLOSE + _PH_ESCAPE + _PH_DIGITS

ENTITY_STRUCT = "struct<span:string,type:string>"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def regex_spans(text, pattern: str) -> Column:
    """All non-overlapping leftmost matches (group 0) of ``pattern``."""
    return F.regexp_extract_all(_col(text), F.lit(java_pattern(pattern)), 0)


# Any Unicode decimal digit: every built-in pattern except EMAIL needs one.
DIGIT_RE = r"(?U)\d"


def digit_flag(text) -> Column:
    """One cheap scan per text; materialise it before :func:`regex_entities`."""
    return F.coalesce(_col(text).rlike(DIGIT_RE), F.lit(False))


def guard(entity_type: str, pattern: str, text, has_digit: Column | None = None) -> Column | None:
    """A cheap necessary condition for any match of a built-in pattern.

    Derived from the patterns themselves: EMAIL needs '@'; the others need a
    digit, TIME also ':' and MONEY also '元'.  Custom or changed patterns get
    no guard.  Only skips rows that cannot match, so results are unchanged.
    """
    if REGEX_REGISTRY.get(entity_type) != pattern:
        return None
    t = _col(text)
    if entity_type == "EMAIL":
        return t.contains("@")
    dig = has_digit if has_digit is not None else t.rlike(DIGIT_RE)
    if entity_type == "TIME":
        return dig & t.contains(":")
    if entity_type == "MONEY":
        return dig & t.contains("元")
    return dig


def guarded(arr: Column, cond: Column | None, elem_type: str) -> Column:
    if cond is None:
        return arr
    return F.when(cond, arr).otherwise(F.array().cast(f"array<{elem_type}>"))


def _tag(entity_type: str):
    # A closure per type: two-argument lambdas would bind the index instead.
    def tag(span: Column) -> Column:
        return F.struct(span.alias("span"), F.lit(entity_type).alias("type"))

    return tag


def regex_entities(text, registry: Mapping[str, str] | None = None, has_digit: Column | None = None) -> Column:
    """array<struct<span,type>> in (registry order, position) order.

    ``has_digit``: a materialised :func:`digit_flag` column, so the guard scan
    runs once per text rather than once per type.
    """
    registry = REGEX_REGISTRY if registry is None else registry
    def listed(runs: Column | None) -> Column:
        parts = []
        for t, pat in registry.items():
            if runs is None or not is_builtin(t, pat):
                part = guarded(F.transform(regex_spans(text, pat), _tag(t)), guard(t, pat, text, has_digit), ENTITY_STRUCT)
            else:
                part = run_spans(runs, t, pat, _tag(t))
            parts.append(part)
        return parts[0] if len(parts) == 1 else F.concat(*parts)

    if not registry:
        return F.array().cast(f"array<{ENTITY_STRUCT}>")
    # one type alone is found as fast by its own pattern
    scan = sum(is_builtin(t, p) for t, p in registry.items()) > 1
    arr = let(run_texts(text), listed) if scan else listed(None)
    return F.coalesce(arr, F.array().cast(f"array<{ENTITY_STRUCT}>"))


#: Elements that a scan inside a row keeps together.  Appending to an array copies
#: it, so scans append within short blocks and join the blocks at the end.
SCAN_BLOCK = 256


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row (a lambda variable is bound once)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def blocks(arr: Column) -> Column:
    """A non-empty array cut into runs of ``SCAN_BLOCK`` elements."""
    last = F.floor((F.size(arr) - 1) / SCAN_BLOCK).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(arr, b * SCAN_BLOCK + 1, F.lit(SCAN_BLOCK)))


def exclusive_sums(lens: Column) -> Column:
    """Per element the sum of all before it."""

    def scan(a: Column) -> Column:
        return F.aggregate(
            a,
            F.struct(F.lit(0).alias("pos"), F.array().cast("array<int>").alias("o")),
            lambda acc, n: F.struct((acc["pos"] + n).alias("pos"), F.concat(acc["o"], F.array(acc["pos"])).alias("o")),
            lambda acc: acc["o"],
        )

    def by_blocks(bl: Column) -> Column:
        totals = F.transform(bl, lambda x: F.aggregate(x, F.lit(0), lambda acc, n: acc + n))
        shifted = lambda base: F.transform(bl, lambda x, i: F.transform(scan(x), lambda v: v + F.get(base, i)))
        return F.flatten(let(scan(totals), shifted))

    return let(lens, lambda a: F.when(F.size(a) <= SCAN_BLOCK, scan(a)).otherwise(let(blocks(a), by_blocks)))


# ---------------------------------------------------------------------------
# one scan for all built-in patterns
# ---------------------------------------------------------------------------

#: Every character that a match of a built-in pattern can hold: letters and signs of
#: EMAIL, any decimal digit, separators of IP, DATE and TIME, and the units of MONEY.
#: Java keeps characters that are named one by one in a bit set; every range, and every character beyond U+00FF, is one
#: more test a character. So the bit set comes first, in a class of its own, and one test parts the rest from other ASCII.
_SPAN_ASCII = ascii_letters + r"_.+\-/:"
_SPAN_UNITS = "年月日元万亿美欧"
_SPAN_CHARS_PLAIN = rf"[{_SPAN_ASCII}][\u0100-\uffff&&[{_SPAN_UNITS}]]"  # without '@' and digits, of which every match holds one
_SPAN_CHARS = rf"[{_SPAN_ASCII}@{digits}][\u0100-\x{{10ffff}}&&[{_SPAN_UNITS}\p{{Nd}}]]"
#: A piece of a text: a run of such characters (group 1), then everything up to the next run with an '@' or a digit.
PIECE_RE = rf"([{_SPAN_CHARS}]*+)(?:[^{_SPAN_CHARS}]++(?:[{_SPAN_CHARS_PLAIN}]++(?![@{digits}\p{{Nd}}]))?+)*+"
RUN_RE = rf"\A[{_SPAN_CHARS}]*+"
#: Characters that every match of a type holds, one of each string, and its least length in bytes.
_RUN_NEEDS: dict[str, tuple[tuple[str, ...], int]] = {
    "PHONE": ((), 10),
    "ID": ((), 18),
    "BANK": ((), 16),
    "EMAIL": (("@", "."), 5),
    "IP": ((".",), 7),
    "DATE": (("-/年", "-/月"), 8),
    "TIME": ((":",), 3),
    "MONEY": (("元",), 4),
}


def is_builtin(entity_type: str, pattern: str) -> bool:
    return entity_type in _RUN_NEEDS and REGEX_REGISTRY.get(entity_type) == pattern


def _pieces(text) -> Column:
    """The pieces of a text, which make up the text (a last one may be empty).
    Spark compiles the pattern of ``split`` anew for every row, that of an extraction once."""
    return F.regexp_extract_all(_col(text), F.lit(PIECE_RE), 0)


def text_runs(text) -> Column:
    """array<struct<start, s>>: the runs of a text that can hold matches, from one scan.

    A match of a built-in pattern holds characters of one class only, among
    them an '@' or a digit, and its look-around asks for digits only.  So the
    matches of a text are those of its runs of that class, and only runs with
    an '@' or a digit need a look.  The text is cut where such a run begins;
    each piece holds its run in front.
    """
    def runs(pieces: Column) -> Column:
        starts = exclusive_sums(F.transform(pieces, F.char_length))
        cut = lambda p, at: F.struct(at.alias("start"), F.regexp_extract(p, RUN_RE, 0).alias("s"))
        return F.filter(F.zip_with(pieces, starts, cut), lambda r: F.octet_length(r["s"]) > 0)

    return let(_pieces(text), runs)


def run_texts(text) -> Column:
    """array<string>: the runs of :func:`text_runs` without their places (some may be empty)."""
    return F.regexp_extract_all(_col(text), F.lit(PIECE_RE), 1)


def gaps_before(text, pattern: str) -> Column:
    """What stands before each match of a Java pattern, since the match before it."""
    return F.regexp_extract_all(_col(text), F.lit(rf"([\s\S]*?)(?:{pattern})"), 1)


def run_spans(runs: Column, entity_type: str, pattern: str, tag: Callable[[Column], Column]) -> Column:
    """``tag(span)`` of every match of a built-in type in the runs, in order.

    No match holds a line break and none has one's neighbourhood in its
    look-around, so the runs are laid end to end and scanned at once.
    """
    held = F.array_join(F.filter(runs, lambda r: _may_hold(entity_type, r)), "\n")
    return F.transform(F.regexp_extract_all(held, F.lit(java_pattern(pattern)), 0), tag)


def _may_hold(entity_type: str, run: Column) -> Column:
    needs, size = _RUN_NEEDS[entity_type]
    cond = F.octet_length(run) >= size
    for chars in needs:
        one = [F.contains(run, F.lit(c)) for c in chars]
        cond = cond & reduce(or_, one)
    return cond


def run_matches(runs: Column, entity_type: str, pattern: str, match: Callable[[Column, Column], Column], elem_type: str) -> Column:
    """``match(span, start)`` of every match of a built-in type in the runs, in order."""
    java = java_pattern(pattern)

    def of_run(r: Column) -> Column:
        def placed(spans: Column) -> Column:
            def many(steps: Column) -> Column:
                ends = F.zip_with(exclusive_sums(steps), steps, lambda before, step: before + step)
                return F.zip_with(spans, ends, lambda x, e: match(x, r["start"] + e - F.char_length(x)))

            def behind(gaps: Column) -> Column:
                steps = F.zip_with(F.transform(spans, F.char_length), gaps, lambda m, g: m + g)
                return F.when(F.size(spans) == 1, F.array(match(spans[0], r["start"] + gaps[0]))).otherwise(let(steps, many))

            none = F.array().cast(f"array<{elem_type}>")
            first = F.position(spans[0], r["s"])
            alone = (F.size(spans) == 1) & (F.position(spans[0], r["s"], first + 1) == 0)  # its text stands in the run once, so that is its place
            found = F.when(F.size(spans) == 0, none).when(alone, F.array(match(spans[0], r["start"] + first - 1)))
            return found.otherwise(let(F.transform(gaps_before(r["s"], java), F.char_length), behind))

        return let(F.regexp_extract_all(r["s"], F.lit(java), 0), placed)

    held = F.filter(runs, lambda r: _may_hold(entity_type, r["s"]))
    return F.flatten(F.transform(held, of_run))


def token_hex(entity_type, span, salt: str, hex_len: int | None = None) -> Column:
    """First hex chars (8 if not told) of sha256(salt|type|span)."""
    key = F.concat_ws("|", F.lit(salt), _col(entity_type), _col(span))
    return F.substring(F.sha2(key, 256), 1, hex_len or TOKEN_HEX_LEN)


def _token(entity_type, hashed: Column) -> Column:
    return F.concat(F.lit(TOKEN_PREFIX), F.lower(_col(entity_type)), F.lit("_"), hashed, F.lit(TOKEN_SUFFIX))


def token(entity_type, span, salt: str, hex_len: int | None = None) -> Column:
    """``__MASKED_{lower(type)}_{8 hex}__`` — deterministic, so no lookup is needed.
    Another ``hex_len`` is outside the token grammar."""
    return _token(entity_type, token_hex(entity_type, span, salt, hex_len))


def token_with_nonce(entity_type, span, salt: str, nonce, hex_len: int | None = None) -> Column:
    """Token of a collision loser: the hash input gets ``#nonce`` appended."""
    key = F.concat_ws("|", F.lit(salt), _col(entity_type), _col(span))
    key = F.concat(key, F.lit("#"), _col(nonce).cast("string"))
    return _token(entity_type, F.substring(F.sha2(key, 256), 1, hex_len or TOKEN_HEX_LEN))


def custom_token(span, salt: str | None = None, hex_len: int | None = None, nonce: Column | None = None) -> Column:
    """``__CUSTOM_{8 hex}__`` for dictionary misses (hash of the word, salted if a salt is given;
    the hash input of a collision loser gets ``#nonce`` appended)."""
    key = _col(span) if salt is None else F.concat_ws("|", F.lit(salt), _col(span))
    if nonce is not None:
        key = F.concat(key, F.lit("#"), nonce.cast("string"))
    return F.concat(
        F.lit(CUSTOM_PREFIX),
        F.substring(F.sha2(key, 256), 1, hex_len or TOKEN_HEX_LEN),
        F.lit(TOKEN_SUFFIX),
    )


#: Placeholders that are looked up, and pairs up to which each is filled by a replacement
#: of its own; beyond, they are computed, and filled in one pass.
FEW_PAIRS = 32


def placeholder(index: Column) -> Column:
    """Transient marker for entity ``index`` made of private-use characters only."""
    code = lambda i: _PH_OPEN + "".join(_PH_DIGITS[int(d, 16)] for d in f"{i:X}") + _PH_CLOSE
    first = F.array(*[F.lit(code(i)) for i in range(FEW_PAIRS)])
    computed = F.concat(
        F.lit(_PH_OPEN),
        F.translate(F.hex(index), "0123456789ABCDEF", _PH_DIGITS),
        F.lit(_PH_CLOSE),
    )
    return F.when(index < FEW_PAIRS, F.get(first, index)).otherwise(computed)


def placeholder_pairs(pairs: Column, repl: Callable[[Column], Column] = lambda p: p["repl"]) -> Column:
    """array<struct<span, repl>> → array<struct<span, repl, ph>> without empty spans;
    ``repl`` gives the replacement of an element that does not hold it.

    Empty spans are dropped (Spark's ``replace`` would no-op, Python's would
    insert between characters).  Materialise this in its own projection so
    both folds of :func:`fold_pairs` read it instead of recomputing it.
    """
    pairs = F.filter(pairs, lambda p: F.char_length(p["span"]) > 0)
    return F.transform(
        pairs,
        lambda p, i: F.struct(
            p["span"].alias("span"), repl(p).alias("repl"), placeholder(i).alias("ph")
        ),
    )


def escaped(text: Column) -> Column:
    """Each placeholder character as the escape character and two digits.

    The escape character only ever opens such a code and digits only ever
    follow it, so an escaped span is found in an escaped text exactly where
    the span is in the text, and never inside a placeholder.
    """
    def code(x: Column) -> Column:
        i = F.instr(F.lit(_PH_OWN), x) - 1
        digit = lambda d: F.substring(F.lit(_PH_DIGITS), d.cast("int") + 1, F.lit(1))
        return F.when((i < 0) | (F.char_length(x) == 0), x).otherwise(F.concat(F.lit(_PH_ESCAPE), digit(F.floor(i / 16)), digit(i % 16)))

    return F.array_join(F.transform(F.split(text, f"(?<=[{_PH_OWN}])|(?=[{_PH_OWN}])", -1), code), "")


def unescaped(text: Column) -> Column:
    """The text whose :func:`escaped` form this is."""
    def piece(x: Column, i: Column) -> Column:
        own = F.conv(F.translate(F.substring(x, 1, 2), _PH_DIGITS, "0123456789ABCDEF"), 16, 10).cast("int")
        return F.when(i == 0, x).otherwise(F.concat(F.substring(F.lit(_PH_OWN), own + 1, F.lit(1)), x.substr(F.lit(3), F.char_length(x))))

    return F.array_join(F.transform(F.split(text, _PH_ESCAPE, -1), piece), "")


def fold_pairs(text, indexed: Column) -> Column:
    """Sequential literal replacement over placeholder pairs.

    For each pair in order every literal occurrence of ``span`` becomes its
    unique placeholder, then each placeholder becomes ``repl``.  The first
    pair with a given span wins; a shorter earlier span can break a longer
    later one.
    """
    t = _col(text)

    def phase1(x: Column, span: Callable[[Column], Column], ix: Column) -> Column:
        return F.aggregate(ix, x, lambda acc, p: F.replace(acc, span(p["span"]), p["ph"]))

    def folded(ix: Column) -> Column:
        marked = phase1(t, lambda s: s, ix)
        # no ``repl`` opens a placeholder (nor is null), so those left are the ones set in phase 1
        alone = (F.size(ix) <= FEW_PAIRS) & ~F.exists(ix, lambda p: F.coalesce(F.contains(p["repl"], F.lit(_PH_OPEN)), F.lit(True)))
        one_by_one = F.aggregate(ix, marked, lambda acc, p: F.replace(acc, p["ph"], p["repl"]))
        plain = F.when(alone, one_by_one).otherwise(_fill_placeholders(marked, ix, lambda x: x))
        safe = _fill_placeholders(phase1(escaped(t), escaped, ix), ix, unescaped)
        return F.when(t.rlike(f"[{_PH_OPEN}-{_PH_DIGITS[-1]}]"), safe).otherwise(plain)  # one range, which holds them all

    return let(indexed, folded)


def _fill_placeholders(text: Column, indexed: Column, rest: Callable[[Column], Column]) -> Column:
    """Each placeholder → the ``repl`` of its pair, in one pass over the text; ``rest``
    is applied to what stands between."""

    def piece(x: Column, i: Column) -> Column:
        close = F.instr(x, _PH_CLOSE)
        index = F.conv(F.translate(x.substr(F.lit(1), close - 1), _PH_DIGITS, "0123456789ABCDEF"), 16, 10).cast("int")
        filled = F.concat(F.get(indexed, index)["repl"], rest(x.substr(close + 1, F.char_length(x))))
        return F.when(i == 0, rest(x)).otherwise(filled)

    return F.array_join(F.transform(F.split(text, _PH_OPEN, -1), piece), "")


def literal_replace(text, pairs: Column) -> Column:
    """One-expression form of :func:`placeholder_pairs` + :func:`fold_pairs`."""
    return fold_pairs(text, placeholder_pairs(pairs))


def token_spans(text) -> Column:
    return F.regexp_extract_all(_col(text), F.lit(TOKEN_RE), 0)


def join_keys(left, right, keys: Sequence[str], how: str):
    """``left`` joined with ``right`` on the caller's key columns, where null equals null."""
    names = [f"_key{i}" for i in range(len(keys))]
    other = right.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], *[c for c in right.columns if c not in keys])
    return left.join(other, reduce(and_, [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names)]), how).drop(*names)


def posexplode_rows(df, keep_cols, arr: Column, pos_name: str = "pos", val_name: str = "value"):
    """``keep…, pos, value`` per array element (pos as long).

    Uses the outer generator plus a filter on its own output: a plain
    ``posexplode`` makes Catalyst infer ``size(arr) > 0`` and push it below
    projections and exchanges, which would evaluate ``arr`` (often a set of
    regex scans) twice.  A filter on generator output cannot be pushed down.
    """
    out = df.select(*keep_cols, F.posexplode_outer(arr).alias(pos_name, val_name))
    return out.filter(F.col(pos_name).isNotNull()).withColumn(pos_name, F.col(pos_name).cast("long"))


def explode_rows(df, keep_cols, arr: Column, val_name: str = "value"):
    """``keep…, value`` per array element; same pushdown guard as :func:`posexplode_rows`."""
    out = df.select(*keep_cols, F.posexplode_outer(arr).alias("_p", val_name))
    return out.filter(F.col("_p").isNotNull()).drop("_p")
