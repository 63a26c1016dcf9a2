"""Personal data by anchor expansion.

One Aho-Corasick automaton reports the anchors of a text: at-signs, plus signs,
digits, URL schemes and identifier cues.  A deterministic local parser expands
each anchor to its boundaries and validates what it found.  Every parser looks
at the surroundings of its anchor alone, so a text costs one pass plus the
candidates.

Kinds with a fixed grammar (leftmost, non-overlapping per kind; a match that
fails its check is dropped, its characters stay consumed):

* email  ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``
* ip     four dotted numbers, each at most 255
* card   digits with single blanks or hyphens between, 13 to 19 of them, Luhn
* phone  ``\\+[0-9][\\x20().0-9-]+[0-9]``, 9 to 15 digits

Kinds the method adds: ``account`` (the value behind a cue such as ``password=``
or ``account:``, six characters or more with a digit), ``iban`` (behind its cue,
checksum 97) and ``url`` (around ``://``, host with a dot).

Offsets are code points, end exclusive.  Null and empty texts have no spans
(a null text stays null when masked).  Extra columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import boxed, unboxed

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "account", "iban", "url")
CUES = ("account", "acct", "api_key", "apikey", "iban", "passport", "passwd", "password", "secret", "ssn", "token")
MIN_VALUE = 6

_DIGITS = frozenset("0123456789")
_LABEL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-")
_LOCAL = _LABEL | frozenset("._%+")
_PHONE = _DIGITS | frozenset(" ().-")
_SCHEME = _LABEL | frozenset("+.")
_VALUE = _LABEL | frozenset("_")
_URL_STOP = frozenset(" \t\n\r\v\f\"'`<>{}|\\^")
_TRAILING = ".,;:!?)]"


def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for word, kind in [("@", "@"), ("+", "+"), ("://", "url"), *((d, "0") for d in "0123456789")]:
        a.add_word(word, (kind, len(word)))
    for cue in CUES:
        for form in {cue, cue.upper(), cue.capitalize()}:
            a.add_word(form, ("cue", len(cue)))
    a.make_automaton()
    return a


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _run(t: str, i: int, chars: frozenset) -> int:
    n = len(t)
    while i < n and t[i] in chars:
        i += 1
    return i


def _email(t: str, at: int, low: int) -> tuple[int, int] | None:
    a = at
    while a > low and t[a - 1] in _LOCAL:
        a -= 1
    e = _run(t, at + 1, _LABEL)
    if a == at or e == at + 1:
        return None
    dots = 0
    while e < len(t) and t[e] == "." and (nxt := _run(t, e + 1, _LABEL)) > e + 1:
        e, dots = nxt, dots + 1
    return (a, e) if dots else None


def _ip(t: str, at: int) -> tuple[int, int, bool] | None:
    e = _run(t, at, _DIGITS)
    parts = [t[at:e]]
    while len(parts) < 4:
        nxt = _run(t, e + 1, _DIGITS)
        if e >= len(t) or t[e] != "." or nxt == e + 1:
            return None
        parts.append(t[e + 1 : nxt])
        e = nxt
    return at, e, all(len(p := x.lstrip("0")) <= 3 and int(p or "0") <= 255 for x in parts)


def _card(t: str, at: int) -> tuple[int, int, bool] | None:
    n, e, digits = len(t), at + 1, 1
    while e < n:
        if t[e] in _DIGITS:
            e += 1
        elif t[e] in " -" and e + 1 < n and t[e + 1] in _DIGITS:
            e += 2
        else:
            break
        digits += 1
    if digits < 2:
        return None
    return at, e, 13 <= digits <= 19 and luhn("".join(c for c in t[at:e] if c in _DIGITS))


def _phone(t: str, at: int) -> tuple[int, int, bool] | None:
    if at + 1 >= len(t) or t[at + 1] not in _DIGITS:
        return None
    e = _run(t, at + 2, _PHONE)
    while e > at + 3 and t[e - 1] not in _DIGITS:
        e -= 1
    if e <= at + 3:
        return None
    return at, e, 9 <= sum(c in _DIGITS for c in t[at:e]) <= 15


def _behind_cue(t: str, end: int) -> int | None:
    """Place of the value behind ``cue [quote] :|=|# [quote]``."""
    n, i = len(t), end
    while i < n and t[i] in " \t\"'":
        i += 1
    if i >= n or t[i] not in ":=#":
        return None
    i += 1
    while i < n and t[i] in " \t\"'":
        i += 1
    return i


def _iban(t: str, at: int) -> tuple[int, int] | None:
    chars, e, i = [], at, at
    while i < len(t) and len(chars) < 34 and t[i].isascii() and (t[i].isalnum() or t[i] == " "):
        if t[i] != " ":
            chars.append(t[i].upper())
            e = i + 1
            s = "".join(chars)
        i += 1
    while len(chars) >= 15:
        s = "".join(chars)
        if s[:2].isalpha() and s[2:4].isdigit() and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1:
            return at, e
        chars.pop()
        e -= 1
        while t[e - 1] == " ":
            e -= 1
    return None


def _url(t: str, at: int, low: int, read: list[int]) -> tuple[int, int] | None:
    """``read`` keeps the end of the last stretch that was read and its end less
    trailing signs, so that no stretch is read again for a later "://" in it."""
    a = at
    while a > low and t[a - 1] in _SCHEME:
        a -= 1
    while a < at and not t[a].isalpha():
        a += 1
    if a == at:
        return None
    if at + 3 > read[0]:
        e, n = at + 3, len(t)
        while e < n and t[e] not in _URL_STOP:
            e += 1
        read[0] = e
        while e > at + 3 and t[e - 1] in _TRAILING:
            e -= 1
        read[1] = e
    e = max(at + 3, read[1])
    slash = t.find("/", at + 3, e)
    return (a, e) if "." in t[at + 3 : slash if slash >= 0 else e].strip(".") else None


def find_spans(text: str, automaton: ahocorasick.Automaton) -> list[tuple[str, int, int]]:
    """``(kind, start, end)`` by kind as listed, then start."""
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    free = dict.fromkeys(KINDS, 0)
    read = [0, 0]

    def take(kind: str, a: int, e: int, ok: bool = True) -> None:
        free[kind] = e
        if ok:
            found[kind].append((a, e))

    for last, (anchor, size) in automaton.iter(text):
        at = last - size + 1
        if anchor == "0":
            if at >= free["ip"] and (at == 0 or text[at - 1] not in _DIGITS) and (m := _ip(text, at)):
                take("ip", *m)
            if at >= free["card"]:
                if m := _card(text, at):
                    take("card", *m)
                else:
                    free["card"] = at + 1
        elif anchor == "@":
            if m := _email(text, at, free["email"]):
                take("email", *m)
        elif anchor == "+":
            if at >= free["phone"] and (m := _phone(text, at)):
                take("phone", *m)
        elif anchor == "url":
            if at >= free["url"] and (m := _url(text, at, free["url"], read)):
                take("url", *m)
        elif not (at and text[at - 1].isalnum()) and (v := _behind_cue(text, last + 1)) is not None:
            if text[at : last + 1].lower() == "iban" and v >= free["iban"] and (m := _iban(text, v)):
                take("iban", *m)
            elif v >= free["account"]:
                e = _run(text, v, _VALUE)
                if e - v >= MIN_VALUE and any(c in _DIGITS for c in text[v:e]):
                    take("account", v, e)
    return [(k, a, e) for k in KINDS for a, e in found[k]]


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """Every stretch that spans cover becomes ``[KIND]`` of the span that opens it."""
    out, done, open_to = [], 0, -1
    for kind, a, e in sorted(spans, key=lambda s: (s[1], -s[2], KINDS.index(s[0]))):
        if a >= open_to:
            out += [text[done:a], f"[{kind.upper()}]"]
        open_to = max(open_to, e)
        done = open_to
    return "".join(out) + text[done:]


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])


def _find_batches(text_at: int, replace: bool, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton()
        for batch in batches:
            texts = batch.column(text_at).to_pylist()
            spans = [find_spans(t, automaton) if t else [] for t in texts]
            columns = batch.columns
            if replace:
                columns[text_at] = pa.array([masked(t, s) if s else t for t, s in zip(texts, spans)], batch.schema.field(text_at).type)
            rows = [[{"kind": k, "start": a, "end": e} for k, a, e in s] for s in spans]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(rows, pa.list_(_SPAN))], [*batch.schema.names, name])

    return run


def with_spans(docs: DataFrame, replace: bool = False, name: str = "pii_spans") -> DataFrame:
    """``docs`` with the spans as column ``name``, which no own column may have (an
    error says so); with ``replace`` the spans are masked in ``text``."""
    if name.lower() in (c.lower() for c in docs.columns):
        raise ValueError(f"documents have a column {name!r}; choose another name for the spans")
    schema = docs.withColumn(name, F.lit(None).cast("array<struct<kind:string,start:int,end:int>>")).schema
    return docs.mapInArrow(_find_batches(docs.columns.index("text"), replace, name), schema)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def pii_digest(docs: DataFrame) -> DataFrame:
    """Per row: ``doc_id``, counts of the base kinds, ``base_sha256``, ``spans``."""
    s = with_spans(docs.select("doc_id", F.col("text").cast("string").alias("text")))
    all_ = F.col("pii_spans")
    return s.select(
        "doc_id",
        *[_count(all_, k).alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(_joined(F.filter(all_, lambda x: x["kind"].isin(*BASE_KINDS))), 256).alias("base_sha256"),
        _joined(all_).alias("spans"),
    )


def mask_pii(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data masked and ``n_chars`` (if any) brought up to date;
    all other columns, whatever their names, as they are."""
    out = with_spans(boxed(docs), replace=True)
    if "n_chars" not in docs.columns:
        return unboxed(out, docs)
    kind = docs.schema["n_chars"].dataType
    return unboxed(out, docs, n_chars=F.when(F.col("text").isNull(), F.col("row.n_chars")).otherwise(F.length("text").cast(kind)))
