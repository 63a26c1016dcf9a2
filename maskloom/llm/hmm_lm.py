"""Hidden Markov language model over words, trained by Baum-Welch.

Tokens are the lower-cased (A-Z) words of a text and one end token.  A state
emits a word *class* (a hash of the word's last bytes; the end token is its own
class), a class emits its words by smoothed training counts:

    P(text) = sum over state paths of  pi(s1) prod A(s, s') B(s, class)  *  prod P(word | class)

The word part needs the count of every training word, so what is gathered from
the corpus grows with its vocabulary; the latent part is a model of fixed size.

* ``blocks``: every task cuts its documents into blocks of about
  ``BLOCK_TOKENS`` tokens and writes one row a block: its own dictionary, its
  documents as local word numbers, its training counts.
* word counts are summed over all blocks (a word is at most one row a block, so
  no word is a hot key) and return to their blocks in dictionary order.
* Baum-Welch: each round runs scaled forward-backward over the training
  documents of all blocks; expected counts are kept in fixed point (so their sum does
  not depend on the order of addition), summed per task, then over partitions.
* scoring: scaled forward recursion over every whole text.

Documents with crc32(doc_id as text) mod 10 of 0 are held out of all counts.
Nulls: a null text is the end token alone; a null doc_id is a training
document.  Repeated rows are scored (and counted) each.  Without training
documents N and V are 0 and every word has the smoothing mass alone.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from .common import SpanHash, doc_bucket, lower_ascii, not_space, pieces, text_bytes, word_spans

STATES = 8
CLASSES = 2048
SUFFIX = 4
ROUNDS = 3
SMOOTH = 0.1
HELD_OUT = (10, 0)
BLOCK_TOKENS = 1 << 20
#: Tokens (padding included) that go through the recursions side by side.
GROUP_TOKENS = 1 << 18
#: Fixed point of the expected counts.
UNIT = 1 << 20
END = b""


def held_out(doc_id: Column) -> Column:
    return F.coalesce(doc_bucket(doc_id, HELD_OUT[0]) == HELD_OUT[1], F.lit(False))


def word_class(word: bytes) -> int:
    return 0 if word == END else 1 + zlib.crc32(word[-SUFFIX:]) % (CLASSES - 1)


# ---------------------------------------------------------------------------
# blocks: local dictionaries and documents as local word numbers
# ---------------------------------------------------------------------------

_BLOCK_SCHEMA = "block long, doc_ids array<long>, held array<boolean>, sizes array<int>, ids binary, classes binary, words array<string>, counts array<int>"


class _Block:
    def __init__(self):
        self.words: dict[bytes, int] = {END: 0}
        self.doc_ids, self.held, self.sizes, self.ids = [], [], [], []
        self.tokens = 0

    def add(self, doc_ids: list, held: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> None:
        low = lower_ascii(data)
        starts, ends, count = word_spans(not_space(low), offsets)
        n = len(count)
        out = np.zeros(len(starts) + n, np.int32)
        if len(starts):
            _, first, inverse = np.unique(SpanHash(low)(starts, ends), return_index=True, return_inverse=True)
            raw, known = low.tobytes(), self.words
            local = np.fromiter(
                (known.setdefault(raw[s:e], len(known)) for s, e in zip(starts[first].tolist(), ends[first].tolist())), np.int32, len(first)
            )
            out[np.arange(len(starts)) + np.repeat(np.arange(n), count)] = local[inverse]
        self.doc_ids += doc_ids
        self.held.append(held)
        self.sizes.append((count + 1).astype(np.int32))
        self.ids.append(out)
        self.tokens += len(out)

    def row(self, block: int) -> pa.RecordBatch:
        ids, sizes, held = np.concatenate(self.ids), np.concatenate(self.sizes), np.concatenate(self.held)
        counts = np.bincount(ids[np.repeat(~held, sizes)], minlength=len(self.words)).astype(np.int32)
        classes = np.fromiter(map(word_class, self.words), np.uint16, len(self.words))
        one = lambda x, t: pa.array([x], t)
        return pa.RecordBatch.from_arrays(
            [
                one(block, pa.int64()), one(self.doc_ids, pa.list_(pa.int64())), one(held, pa.list_(pa.bool_())), one(sizes, pa.list_(pa.int32())),
                one(ids.tobytes(), pa.binary()), one(classes.tobytes(), pa.binary()),
                one([w.decode() for w in self.words], pa.list_(pa.string())), one(counts, pa.list_(pa.int32())),
            ],
            ["block", "doc_ids", "held", "sizes", "ids", "classes", "words", "counts"],
        )


def _block_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part = TaskContext.get().partitionId() << 32
    block = _Block()
    for batch in batches:
        doc_ids, held = batch.column(0).to_pylist(), batch.column(1).to_numpy(zero_copy_only=False)
        data, offsets = text_bytes(batch.column(2))
        for i, j in pieces(offsets):
            block.add(doc_ids[i:j], held[i:j], data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            if block.tokens >= BLOCK_TOKENS:
                yield block.row(part)
                part, block = part + 1, _Block()
    if block.doc_ids:
        yield block.row(part)


def blocks(docs: DataFrame) -> DataFrame:
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held"), F.col("text").cast("string").alias("text"))
    return d.mapInArrow(_block_batches, _BLOCK_SCHEMA)


# ---------------------------------------------------------------------------
# corpus counts of every word, back in the order of the block dictionaries
# ---------------------------------------------------------------------------

def _gather_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``block, local, c, first`` sorted by both -> one row a block."""

    def row(block: int, parts: list) -> pa.RecordBatch:
        c, known, cls = (np.concatenate(x) for x in zip(*parts))
        seen, words = np.bincount(cls, np.where(known, c, 0), CLASSES), np.bincount(cls, known, CLASSES)
        one = lambda x, t: pa.array([x], t)
        return pa.RecordBatch.from_arrays(
            [one(block, pa.int64()), one(c.tobytes(), pa.binary()), one(seen.astype(np.int64), pa.list_(pa.int64())), one(words.astype(np.int64), pa.list_(pa.int64()))],
            ["block", "c", "class_tokens", "class_words"],
        )

    now, parts = None, []
    for b in batches:
        if not b.num_rows:
            continue
        block, c, first, cls = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 2, 3, 4))
        cut = np.r_[np.flatnonzero(np.r_[True, block[1:] != block[:-1]]), len(block)]
        for i, j in zip(cut[:-1], cut[1:]):
            if block[i] != now and parts:
                yield row(now, parts)
                parts = []
            now = int(block[i])
            parts.append((c[i:j].astype(np.int64), first[i:j] & (c[i:j] > 0), cls[i:j]))
    if parts:
        yield row(now, parts)


def word_counts(blocks_: DataFrame) -> DataFrame:
    """``block, c`` (training count of each dictionary word, int64) and per class
    the tokens and words that this block is the first to hold."""
    words = blocks_.select("block", F.posexplode(F.arrays_zip("words", "counts")).alias("local", "w")).select(
        "block", "local", F.col("w.words").alias("word"), F.col("w.counts").alias("n")
    )
    same = Window.partitionBy("word")
    cls = F.when(F.col("word") == "", 0).otherwise(
        1 + F.crc32(F.expr(f"substring(encode(word, 'UTF-8'), greatest(octet_length(word) - {SUFFIX - 1}, 1), {SUFFIX})")) % (CLASSES - 1)
    )
    rows = words.select(
        "block", "local", F.sum("n").over(same).alias("c"), (F.min("block").over(same) == F.col("block")).alias("first"), cls.cast("int").alias("cls")
    )
    rows = rows.repartition("block").sortWithinPartitions("block", "local")
    return rows.mapInArrow(_gather_batches, "block long, c binary, class_tokens array<long>, class_words array<long>")


def class_totals(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Training tokens and distinct training words of each class (``CLASSES`` rows)."""
    t = (
        counts.select(F.posexplode(F.arrays_zip("class_tokens", "class_words")).alias("cls", "x"))
        .groupBy("cls").agg(F.sum("x.class_tokens").alias("t"), F.sum("x.class_words").alias("v")).collect()
    )
    tokens, words = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
    for r in t:
        tokens[r.cls], words[r.cls] = r.t, r.v
    return tokens, words


# ---------------------------------------------------------------------------
# the hidden Markov part
# ---------------------------------------------------------------------------

def _groups(sizes: np.ndarray) -> Iterator[np.ndarray]:
    """Documents by falling length, in runs of at most ``GROUP_TOKENS`` padded tokens."""
    order = np.argsort(-sizes, kind="stable")
    i = 0
    while i < len(order):
        n = max(1, GROUP_TOKENS // int(sizes[order[i]]))
        yield order[i : i + n]
        i += n


def _forward(x: np.ndarray, live: np.ndarray, model, keep: bool):
    """Scaled forward recursion of documents side by side: ``x[t]`` their classes
    at step ``t``, the first ``live[t]`` of them still running."""
    pi, a, b = model
    alpha = pi * b[x[0]]
    scale = alpha.sum(1)
    alpha /= scale[:, None]
    log_p = np.log10(scale)
    alphas, scales = [alpha], [scale]
    for t in range(1, len(live)):
        n = live[t]
        alpha = alpha[:n] @ a
        alpha *= b[x[t, :n]]
        scale = alpha.sum(1)
        alpha /= scale[:, None]
        log_p[:n] += np.log10(scale)
        if keep:
            alphas.append(alpha)
            scales.append(scale)
    return log_p, alphas, scales


def _padded(ids: np.ndarray, begin: np.ndarray, sizes: np.ndarray, group: np.ndarray):
    n = sizes[group]
    t = np.arange(int(n[0]))
    x = ids[np.minimum(begin[group][None, :] + t[:, None], len(ids) - 1)]
    return x, np.searchsorted(-n, -t, side="left")


def _expected(classes: np.ndarray, sizes: np.ndarray, model, sums) -> None:
    """Adds the documents' expected counts to ``sums`` (start, moves, emissions)."""
    pi, a, b = model
    begin = np.cumsum(sizes) - sizes
    start, moves, emits = sums
    for group in _groups(sizes):
        x, live = _padded(classes, begin, sizes, group)
        _, alphas, scales = _forward(x, live, model, True)
        beta = np.ones((live[-1], len(pi)))
        gammas = [alphas[-1]]
        for t in range(len(live) - 2, -1, -1):
            n, m = live[t], live[t + 1]
            back = b[x[t + 1, :m]] * beta
            back /= scales[t + 1][:, None]
            moves += a * (alphas[t][:m].T @ back)
            new = np.ones((n, len(pi)))
            new[:m] = back @ a.T
            beta = new
            gammas.append(alphas[t] * beta)
        start += gammas[-1].sum(0)
        flat = np.concatenate(gammas[::-1])
        seen = np.concatenate([x[t, :n] for t, n in enumerate(live)])
        for s in range(len(pi)):
            emits[s] += np.bincount(seen, flat[:, s], CLASSES)


def _unpack(b: pa.RecordBatch, i: int):
    get = lambda c: b.column(b.schema.names.index(c))[i]
    sizes = get("sizes").values.to_numpy(zero_copy_only=False).astype(np.int64)
    ids = np.frombuffer(get("ids").as_buffer(), np.int32)
    classes = np.frombuffer(get("classes").as_buffer(), np.uint16)
    return get("held").values.to_numpy(zero_copy_only=False), sizes, ids, classes


def _expect_batches(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pi, a, b = model.value
        sums = np.zeros(len(pi)), np.zeros(a.shape), np.zeros((len(pi), CLASSES))
        for batch in batches:
            for i in range(batch.num_rows):
                held, sizes, ids, classes = _unpack(batch, i)
                own = np.repeat(~held, sizes)
                if own.any():
                    _expected(classes[ids[own]], sizes[~held], (pi, a, b), sums)
        flat = np.rint(np.concatenate([x.ravel() for x in sums]) * UNIT).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([flat], pa.list_(pa.int64()))], ["sums"])

    return run


def _first_model(blocks_: DataFrame, states: int):
    """Emissions from single training documents of the first block, each the
    farthest from those before it; self transitions preferred."""
    low = blocks_.agg(F.min("block")).first()[0]
    b = np.full((states, CLASSES), 1.0 / CLASSES)
    if low is not None:
        t = blocks_.where(F.col("block") == low).select("held", "sizes", "ids", "classes").toArrow().to_batches()[0]
        held, sizes, ids, classes = _unpack(t, 0)
        end = np.cumsum(sizes)
        docs = [d for d in range(len(sizes)) if not held[d] and sizes[d] >= 20][:400] or [d for d in range(len(sizes)) if not held[d]][:400]
        if docs:
            h = np.array([np.bincount(classes[ids[end[d] - sizes[d] : end[d]]], minlength=CLASSES) / sizes[d] for d in docs])
            root = np.sqrt(h)
            chosen = [0]
            far = ((root - root[0]) ** 2).sum(1)
            while len(chosen) < states:
                chosen.append(int(np.argmax(far)))
                far = np.minimum(far, ((root - root[chosen[-1]]) ** 2).sum(1))
            b = 0.5 * h[chosen] + 0.4 * h.mean(0) + 0.1 / CLASSES
    stay = 0.9
    a = np.full((states, states), (1 - stay) / max(1, states - 1))
    np.fill_diagonal(a, stay if states > 1 else 1.0)
    return np.full(states, 1.0 / states), a, np.ascontiguousarray((b / b.sum(1, keepdims=True)).T)


def baum_welch(blocks_: DataFrame, states: int = STATES, rounds: int = ROUNDS):
    """Start, transition and class emission (class x state) probabilities after ``rounds`` rounds over all training documents."""
    sc = blocks_.sparkSession.sparkContext
    pi, a, b = _first_model(blocks_, states)
    rows = blocks_.select("held", "sizes", "ids", "classes")
    for _ in range(rounds):
        sums = rows.mapInArrow(_expect_batches(sc.broadcast((pi, a, b))), "sums array<long>")
        total = sums.select(F.posexplode("sums").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).toArrow()
        flat = np.zeros(states + states * states + states * CLASSES)
        flat[total["i"].to_numpy()] = total["x"].to_numpy() / UNIT
        start, moves, emits = np.split(flat, [states, states + states * states])
        pi = (start + SMOOTH) / (start + SMOOTH).sum()
        a = moves.reshape(states, states) + SMOOTH
        a /= a.sum(1, keepdims=True)
        b = emits.reshape(states, CLASSES) + SMOOTH
        b = np.ascontiguousarray((b / b.sum(1, keepdims=True)).T)
    return pi, a, b


# ---------------------------------------------------------------------------
# scoring
# ---------------------------------------------------------------------------

def _score_batches(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, tokens, words = sent.value
        n, v = int(tokens.sum()), int(words.sum())
        in_class = tokens + SMOOTH * (words + 1)
        in_class[0] = 0
        for batch in batches:
            for i in range(batch.num_rows):
                held, sizes, ids, classes = _unpack(batch, i)
                c = np.frombuffer(batch.column(batch.schema.names.index("c"))[i].as_buffer(), np.int64)
                begin = np.cumsum(sizes) - sizes
                add = lambda x: np.add.reduceat(x[ids], begin)
                base = add(np.log10((c + SMOOTH) / (n + SMOOTH * (v + 1))))
                # the end token is alone in its class
                word = add(np.where(classes == 0, 0.0, np.log10((c + SMOOTH) / np.where(classes == 0, 1.0, in_class[classes]))))
                latent = np.zeros(len(sizes))
                cls = classes[ids]
                for group in _groups(sizes):
                    x, live = _padded(cls, begin, sizes, group)
                    latent[group] = _forward(x, live, model, False)[0]
                doc_ids = batch.column(batch.schema.names.index("doc_ids"))[i].values
                yield pa.RecordBatch.from_arrays(
                    [doc_ids, pa.array(held), pa.array(sizes), pa.array(add((c > 0).astype(np.int64))), pa.array(np.full(len(sizes), n)), pa.array(base), pa.array(latent + word)],
                    ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return run


def language_model_scores(docs: DataFrame, states: int = STATES, rounds: int = ROUNDS) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row."""
    held = stored(blocks(docs), "lm_blocks")
    counts = stored(word_counts(held), "lm_counts")
    tokens, words = class_totals(counts)
    model = baum_welch(held, states, rounds)
    sent = docs.sparkSession.sparkContext.broadcast((model, tokens, words))
    rows = held.drop("words", "counts").join(counts.select("block", "c"), "block")
    return rows.mapInArrow(
        _score_batches(sent), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )
