"""Every operator against a brute-force version, on given tables and on odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from maskloom.llm import decontaminate, hmm_lm, line_dedup, packing, pii, quality, sharding, simhash, token_ids, toxicity
from maskloom.llm.common import table
from maskloom.llm.queries import QUERIES
from maskloom.llm.xxh64 import xxh64_spans

SF = "/root/testdata/sf0.001"
P = pytest.importorskip("public_tokenizers")
TOKENIZER = P.path("byte_bpe_50k.json")
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOW = str.maketrans(UPPER, UPPER.lower())


def low_words(t):
    return re.findall("[^\x20\x09-\x0d]+", (t or "").translate(LOW))


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, SF, "documents")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}


# -- 1 best-fit packing -----------------------------------------------------

def naive_best_fit(lengths, costs, largest):
    bins, rest = [], sum(lengths)
    for i, n in enumerate(lengths):
        open_ = [(b[0], -k) for k, b in enumerate(bins) if b[0] >= n]
        if open_:
            space = min(open_)[0]
            b = next(b for b in bins if b[0] == space)
        else:
            fits = [c for c in sorted(costs) if c >= n]
            fits = [c for c in fits if c <= largest] or fits[:1]
            b = [min(fits, key=lambda c: (costs[c] / min(c, rest), c)), []]
            bins.append(b)
        b[0] -= n
        b[1].append(n)
        rest -= n
    return sorted(sorted(b[1]) for b in bins)


def test_best_fit_equals_naive():
    rng = random.Random(1)
    for _ in range(200):
        costs = {c: c + 3 for c in rng.sample([8, 16, 24, 32, 64], 3)}
        lengths = sorted((rng.randint(1, max(costs)) for _ in range(rng.randint(0, 60))), reverse=True)
        for top in costs:
            got = packing.best_fit(lengths, costs, top)
            assert sorted(sorted(lengths[i] for i in b) for b in got) == naive_best_fit(lengths, costs, top)
        bins = packing.pack(lengths, costs)
        assert sorted(i for _, b in bins for i in b) == list(range(len(lengths)))
        assert all(c == min(x for x in costs if x >= sum(lengths[i] for i in b)) for c, b in bins)


def check_bins(rows, want):
    by_doc, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append((r.start, r.n_tokens))
        bins[r.bin].append(r)
    assert sorted((d, sum(n for _, n in p)) for d, p in by_doc.items() if d is not None) == want
    for b in bins.values():
        at = 0
        for r in sorted(b, key=lambda r: r.pos):
            assert r.pos == at and r.bin_tokens == sum(x.n_tokens for x in b) <= r.capacity
            at += r.n_tokens


def test_packing_keeps_every_token(docs, odd, none, texts):
    check_bins(packing.pack_documents(docs, block=37).collect(), sorted((d, len(low_words(t)) + 1) for d, t in texts.items()))
    total = Counter()
    for r in odd.collect():
        total[r.doc_id] += len(low_words(r.text)) + 1
    check_bins(packing.pack_documents(odd).collect(), sorted((d, n) for d, n in total.items() if d is not None))
    assert packing.pack_documents(none).count() == 0


# -- 2 quality rules ---------------------------------------------------------

def base_of(t):
    t = t or ""
    w = re.findall("[^\x20\x09-\x0d]+", t)
    seen, hit = Counter(zip(w, w[1:], w[2:])), [False] * len(w)
    for i in range(len(w) - 2):
        if seen[tuple(w[i : i + 3])] > 1:
            hit[i : i + 3] = [True] * 3
    lines = [x for x in t.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", t)), len(lines) - len(set(lines)), sum(hit)


@pytest.mark.parametrize("odd_rows", [False, True])
def test_quality_base_and_fences(spark, docs, odd, odd_rows):
    d = odd if odd_rows else docs
    rows = quality.quality(d).collect()
    src = Counter((r.doc_id, *base_of(r.text)) for r in d.collect())
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows) == src
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) for r in rows)
    assert not any(r.kept and r.base_failed for r in rows)
    if odd_rows:
        return
    # fences again, from sorted bucketed values
    group = {r.doc_id: (r.lang, r.source) for r in d.collect()}
    good = [r for r in rows if not r.base_failed]
    cut = lambda v: v >> max(0, len(bin(v)) - 2 - quality.EXACT_BITS) << max(0, len(bin(v)) - 2 - quality.EXACT_BITS)
    for r in good:
        inside = True
        for s, slack in quality.SLACK.items():
            levels = [[x for x in good if group[x.doc_id] == group[r.doc_id]], [x for x in good if group[x.doc_id][0] == group[r.doc_id][0]], good]
            pool = sorted(cut(x[s]) for x in next(x for i, x in enumerate(levels) if len(x) >= quality.MIN_GROUP or i == 2))
            q1, q3 = pool[-(-len(pool) // 4) - 1], pool[-(-3 * len(pool) // 4) - 1]
            reach = quality.FENCE * (q3 - q1) + slack
            inside &= r[s] <= q3 + reach and (s not in quality.TWO_SIDED or r[s] >= q1 - reach)
        assert r.kept == inside


def test_quality_empty(none):
    assert quality.quality(none).count() == 0


# -- 3 decontamination ---------------------------------------------------------

def naive_hits(text, items):
    cut = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW).encode())
    windows = defaultdict(set)
    for i, t in items:
        w = cut(t)
        n = min(10, len(w))
        for a in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[a : a + n])].add(i)
    w, found = cut(text), set()
    hit = [False] * len(w)
    for n in {len(k) for k in windows}:
        for a in range(len(w) - n + 1):
            if ids := windows.get(tuple(w[a : a + n])):
                hit[a : a + n] = [True] * n
                found |= ids
    return len(w), sum(hit), sorted(str(x) for x in found if x is not None)


@pytest.mark.parametrize("block_bytes", [1 << 21, 3000])
def test_decontamination(spark, docs, odd, none, block_bytes):
    bench = table(spark, SF, "benchmark").select("item_id", "text")
    short = spark.createDataFrame([(9001, "The the."), (9001, "cat sat"), (9002, ""), (9003, None), (None, "and")], "item_id long, text string")
    bench = bench.withColumn("item_id", bench["item_id"].cast("long")).unionByName(short)
    items = [(r.item_id, r.text) for r in bench.collect()]
    for d in (docs, odd):
        got = Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in decontaminate.contamination(d, bench, block_bytes=block_bytes).collect())
        want = Counter((r.doc_id, *(tuple(x) if isinstance(x, list) else x for x in naive_hits(r.text, items))) for r in d.collect())
        assert got == want
    assert decontaminate.contamination(none, bench).count() == 0
    assert decontaminate.decontaminated(odd, bench.limit(0)).count() == odd.count()
    assert decontaminate.decontaminated(odd, bench).columns == odd.columns


def test_winnowing_finds_every_shared_span():
    rng = random.Random(2)
    for _ in range(100):
        a, b = ([rng.choice("abc") for _ in range(40)] for _ in range(2))
        at = rng.randint(0, 30)
        b[5:15] = a[at : at + 10]
        block = decontaminate.Block(["i"], [" ".join(a)], 10, 5)
        data = np.frombuffer(" ".join(b).encode(), np.uint8)
        _, hits = block.scan(data, np.array([0, len(data)]))
        assert hits[0][0][5:15].all()


# -- 4 token ids ---------------------------------------------------------------

def test_token_files(spark, docs, odd, none):
    enc = token_ids.Encoder(TOKENIZER)
    for d in (docs, odd):
        rows = sorted(((r.doc_id is not None, r.doc_id or 0, r.text is not None, r.text or "") for r in d.collect()))
        start, want = 0, []
        for known, doc_id, _, t in rows:
            ids = [*enc.whole([t])[0], 2]
            want.append((doc_id if known else None, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            start += len(ids)
        got = token_ids.token_table(d, TOKENIZER).collect()
        key = lambda x: (x[0] is not None, x[0] or 0, x[1])
        assert sorted(map(tuple, got), key=key) == want
    assert token_ids.token_table(none, TOKENIZER).count() == 0


def test_pieces_equal_library():
    enc = token_ids.Encoder(TOKENIZER)
    rng = random.Random(3)
    parts = ["'", "s", "re", "ll", " ", "  ", "\n", "\t", "a", "B", "é", "1", "²", ".", "''", "\xa0", "\x1c", "日", "́", "😀", "͸", "<|endoftext|>"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 12))) for _ in range(5000)]
    raw = [t.encode() for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    ids, count = enc.encode(data, np.r_[0, np.cumsum([len(x) for x in raw])], 2)
    assert [x.tolist() for x in np.split(ids, np.cumsum(count)[:-1])] == [[*x, 2] for x in enc.whole(texts)]


# -- 5 personal data -------------------------------------------------------------

def naive_pii(t):
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 13 <= len(d) <= 19 and pii.luhn(d):
            out.append(("card", m.start(), m.end()))
    return out + [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.findall("[0-9]", m[0])) <= 15]


def test_pii_parsers_equal_the_grammar():
    rng, auto = random.Random(4), pii._automaton()
    parts = ["@", "a.b", ".", "-", "+", "1", "22", "256", " ", "a", "_", "é", "(", "+49 30 1234567", "4111 1111 1111 1111", "1.2.3.4", "x@y.zz", "\n", "٣", "token=", "://"]
    for _ in range(20000):
        t = "".join(rng.choices(parts, k=rng.randint(0, 12)))
        assert [s for s in pii.find_spans(t, auto) if s[0] in pii.BASE_KINDS] == naive_pii(t)
    found = pii.find_spans('iban: DE89 3704 0044 0532 0130 00, token = "6cfd1f" http://a.b/c.', auto)
    assert found == [("account", 44, 50), ("iban", 6, 33), ("url", 52, 64)]
    assert pii.masked("a x@y.zz b 1.2.3.4!", pii.find_spans("a x@y.zz b 1.2.3.4!", auto)) == "a [EMAIL] b [IP]!"


def test_pii_digest(docs, odd, none):
    for d in (docs, odd):
        want = Counter()
        for r in d.collect():
            b = naive_pii(r.text or "")
            digest = hashlib.sha256(",".join(f"{k}:{a}:{e}" for k, a, e in b).encode()).hexdigest()
            want[(r.doc_id, *(sum(x[0] == k for x in b) for k in pii.BASE_KINDS), digest)] += 1
        got = Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in pii.pii_digest(d).collect())
        assert got == want
    assert pii.pii_digest(none).count() == 0
    m = pii.mask_pii(odd)
    assert m.columns == odd.columns and {r.text for r in m.where("doc_id = 10").collect()} == {"mail [EMAIL] or [IP] é + 日本語 'll"}


# -- 6 SimHash -------------------------------------------------------------------

def naive_fp(t):
    w = low_words(t)
    s = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def naive_components(fps):
    """Smallest id of each row's component; rows are (id, fp)."""
    values = sorted({f for _, f in fps})
    a, up = np.array(values, np.uint64), {v: v for v in values}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, v in enumerate(values):
        for j in np.flatnonzero(np.bitwise_count(a ^ a[i]) <= 3):
            x, y = find(v), find(values[j])
            up[max(x, y)] = min(x, y)
    low = defaultdict(lambda: None)
    for d, f in fps:
        r = find(f)
        low[r] = d if low[r] is None else low[r] if d is None else min(low[r], d)
    return Counter((d, f, low[find(f)]) for d, f in fps)


def test_simhash(docs, odd, none):
    for d in (docs, odd):
        want = naive_components([(r.doc_id, naive_fp(r.text)) for r in d.collect()])
        assert Counter((r.doc_id, r.fp % (1 << 64), r.component_id) for r in simhash.near_duplicates(d).collect()) == want
    assert simhash.near_duplicates(none).count() == 0


def test_links_of_random_fingerprints(spark):
    rng = random.Random(5)
    flip = lambda v, n: v ^ sum(1 << b for b in rng.sample(range(64), n))
    base = [rng.getrandbits(64) for _ in range(40)] + [0, (1 << 64) - 1]
    fps = [(i, v) for i, v in enumerate(flip(b, rng.randint(0, 5)) for b in base for _ in range(12))]
    df = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in {v for _, v in fps}], "fp long")
    want = defaultdict(set)
    for (_, f, low), _ in naive_components(fps).items():
        want[low].add(f)
    for direct in (simhash._DIRECT, 3):  # also with nearly every posting list split by one more byte
        root = {r.node % (1 << 64): r.root for r in simhash.components(simhash.links(df, direct)).collect()}
        groups = defaultdict(set)
        for i, v in fps:
            groups[root.get(v, v - (1 << 64) if v >> 63 else v)].add(v)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_tally_of_shared_bytes_decides():
    """Four shared bytes bring a pair under one key only; it is dropped by its tally, whatever its distance."""
    a, four, five = 0, 0x01010101_00000000, 0x00010101_00000000
    x = np.array([a ^ four, a ^ five], np.uint64)
    assert simhash._shared_bytes(x).tolist() == [4, 5] and simhash._linked(x).tolist() == [False, True]
    under = [sum(v & simhash._mask(p) == 0 for p in simhash._SETS[simhash.INDEXED]) for v in (four, five)]
    assert under == [1, 5]


def test_members_of_long_lists_are_handed_on_whole():
    """A list over any number of batches comes out as it is or as a forest, and none of its members twice."""
    keys = [1] * 5 + [2] * 40 + [3] * 3 + [4] * 20
    fps = [i % 7 for i in range(len(keys))]
    cols = [np.zeros(len(keys), np.int8), np.array(keys), np.array(fps)]
    for size in (1, 4, 9, 100):
        batches = [pa.RecordBatch.from_arrays([pa.array(c[i : i + size]) for c in cols], ["s", "key", "fp"]) for i in range(0, len(keys), size)]
        out = [r for b in simhash._forest_batches(simhash.INDEXED, 10)(iter(batches)) for r in b.to_pylist()]
        assert Counter(r["a"] for r in out if r["s"] == 0) == Counter(f for k, f in zip(keys, fps) if k in (2, 4))
        assert sum(r["s"] < 0 for r in out) == 4 + 2  # the forests of the lists 1 and 3


def test_long_posting_list_over_the_cube():
    rng = random.Random(6)
    fps = set()
    for _ in range(300):
        v = 0xABCDEF
        for b in rng.sample(range(24), rng.randint(0, 9)):
            v ^= 1 << b
        fps.add(v)
    fps = np.array(sorted(fps), np.uint64)

    def parts(edges):
        up = {int(f): int(f) for f in fps}

        def find(x):
            while up[x] != x:
                x = up[x]
            return x

        for a, b in edges:
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
        return [find(int(f)) for f in fps]

    assert parts(simhash._forest_direct(fps)) == parts(simhash._forest_cube(fps, (0, 1, 2)))


def test_one_per_group(docs, odd):
    kept = [r.doc_id for r in simhash.one_per_group(docs).collect()]
    assert sorted(kept) == sorted({c for _, _, c in naive_components([(r.doc_id, naive_fp(r.text)) for r in docs.collect()])})
    # 3, 4, 9 and a row without id are empty; 5 is there twice; the first text has a copy without id
    assert sorted(r.doc_id for r in simhash.one_per_group(odd).collect()) == [1, 2, 3, 5, 10]
    bare = simhash.one_per_group(odd.where("doc_id is null"))
    assert bare.count() == 2 and bare.columns == odd.columns


def test_one_per_group_with_shared_ids(spark):
    """A doc_id shared by rows of different components: each component keeps one row of its own."""
    far = [(7, " ".join(hashlib.md5(f"{i}.{k}".encode()).hexdigest() for k in range(40))) for i in range(30)]
    near = [(d, far[0][1]) for d in (7, 8, None)] + [(9, far[1][1]), (3, far[2][1]), (3, far[2][1])]
    got = simhash.one_per_group(spark.createDataFrame(far + near, "doc_id long, text string")).collect()
    assert {i == low for i, _, low in naive_components([(i, naive_fp(t)) for i, (_, t) in enumerate(far)])} == {True}  # no two are near
    assert Counter(map(tuple, got)) == Counter([*far[:2], (3, far[2][1]), *far[3:]])


def test_xxh64_equals_library():
    rng = np.random.default_rng(7)
    data = rng.integers(0, 256, 20000).astype(np.uint8)
    starts = rng.integers(0, 15000, 500)
    ends = starts + np.r_[rng.integers(0, 100, 490), rng.integers(100, 5000, 10)]
    got = xxh64_spans(data, starts, ends)
    assert [int(x) for x in got] == [xxhash.xxh64_intdigest(data[s:e].tobytes(), 42) for s, e in zip(starts, ends)]


# -- 7 toxicity ---------------------------------------------------------------

def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    d, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    rows = toxicity.toxicity(d, labels).join(labels, "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    good = sum(r.predicted == r.toxic for r in held) / len(held)
    caught = sum(r.predicted for r in held if r.toxic) / sum(r.toxic for r in held)
    assert good > 0.95 and caught > 0.75


def test_toxicity_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (77, 0)], "doc_id long, toxic int")
    rows = toxicity.toxicity(odd, labels).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.toxicity(none, labels).count() == 0
    kept = toxicity.without_toxic(odd, labels.limit(0))
    assert kept.columns == odd.columns and kept.count() == odd.count()


# -- 8 language model -----------------------------------------------------------

@pytest.mark.parametrize("odd_rows", [False, True])
def test_language_model_base(docs, odd, odd_rows):
    d = odd if odd_rows else docs
    src = [(r.doc_id, [*low_words(r.text), ""], r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 10 == 0) for r in d.collect()]
    c = Counter(w for _, t, held in src if not held for w in t)
    n, v = sum(c.values()), len(c)
    rows = hmm_lm.language_model_scores(d, rounds=1).collect()
    key = lambda x: (x[0] is not None, x[0] or 0, x[2])
    want = sorted(((i, h, len(t), sum(c[w] > 0 for w in t), n, sum(np.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t)) for i, t, h in src), key=key)
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in rows), key=key)
    assert [x[:5] for x in got] == [x[:5] for x in want]
    assert np.allclose([x[5] for x in got], [x[5] for x in want])
    if not odd_rows:  # the latent states help on texts they have not seen
        assert sum(r.score for r in rows if r.held_out) > sum(r.base_score for r in rows if r.held_out)


def test_forward_is_the_sum_over_paths():
    rng = np.random.default_rng(8)
    s = 3
    pi, a, b = rng.dirichlet(np.ones(s)), rng.dirichlet(np.ones(s), s), rng.dirichlet(np.ones(hmm_lm.CLASSES), s).T.copy()
    docs = [rng.integers(0, hmm_lm.CLASSES, n) for n in (5, 3, 1)]
    sizes = np.array([len(x) for x in docs])
    flat = np.concatenate(docs)
    x, live = hmm_lm._padded(flat, np.cumsum(sizes) - sizes, sizes, np.arange(3))
    got = hmm_lm._forward(x, live, (pi, a, b), False)[0]
    sums = np.zeros(s), np.zeros((s, s)), np.zeros((s, hmm_lm.CLASSES))
    hmm_lm._expected(flat, sizes, (pi, a, b), sums)
    want = np.zeros(s), np.zeros((s, s)), np.zeros((s, hmm_lm.CLASSES))
    for d, g in zip(docs, got):
        paths = {}
        for p in np.ndindex(*([s] * len(d))):
            q = pi[p[0]] * b[d[0], p[0]]
            for t in range(1, len(d)):
                q *= a[p[t - 1], p[t]] * b[d[t], p[t]]
            paths[p] = q
        total = sum(paths.values())
        assert np.isclose(np.log10(total), g)
        for p, q in paths.items():
            want[0][p[0]] += q / total
            for t, state in enumerate(p):
                want[2][state, d[t]] += q / total
                if t:
                    want[1][p[t - 1], state] += q / total
    assert all(np.allclose(x, y) for x, y in zip(sums, want))


def test_language_model_empty(none):
    assert hmm_lm.language_model_scores(none).count() == 0


# -- 9 sharding ------------------------------------------------------------------

@pytest.mark.parametrize("limit", [1 << 30, 20000, 2000])
def test_sharding(docs, limit):
    rows = sharding.assign_shards(docs, limit).collect()
    size, n = Counter(), Counter()
    for r in rows:
        size[r.shard] += r.bytes
        n[r.shard] += 1
    up = Counter()
    for s, b in size.items():
        for k in range(len(s)):
            up[s[:k]] += b
    assert len(rows) == docs.count() and not set(up) & set(size)  # no shard is a prefix of another
    assert all(up[s[:-1]] > limit for s in size if s)  # only oversized buckets were split
    assert all(b <= limit or n[s] == 1 for s, b in size.items())
    for r in rows:
        key = bin(1 << 48 | int(hashlib.md5(str(r.doc_id).encode()).hexdigest()[:12], 16))[3:]
        assert key.startswith(r.shard[:48]) and (r.shard_bytes, r.shard_rows, r.depth) == (size[r.shard], n[r.shard], len(r.shard))


def test_sharding_splits_a_hot_key(spark, odd, none):
    hot = spark.range(300).selectExpr("7L doc_id", "repeat('x', 100) text")
    rows = sharding.assign_shards(hot, 2000).collect()
    assert len(rows) == 300 and not any(r.oversize for r in rows) and len({r.shard for r in rows}) >= 15
    assert sharding.assign_shards(odd, 1000).count() == odd.count()
    assert sharding.assign_shards(none).count() == 0


def test_directory_has_one_row_a_bucket(docs):
    """Its prefixes cover every address once."""
    rows = docs.select(F.octet_length("text").cast("long").alias("bytes"), sharding.address(F.col("doc_id"), F.monotonically_increasing_id()).alias("address"))
    for limit in (1 << 40, 20_000, 2_000):
        found = sharding.directory(rows.fillna(0), limit).collect()
        assert len({r.shard for r in found}) == len(found) and sum(r.shard_rows for r in found) == docs.count()
        spans = sorted((r.prefix << (sharding.BITS - r.depth), (r.prefix + 1) << (sharding.BITS - r.depth)) for r in found)
        assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:])) and all(r.shard == (f"{r.prefix:0{r.depth}b}" if r.depth else "") for r in found)


def test_written_shards_hold_every_row_once(spark, odd, tmp_path):
    hot = spark.range(300).selectExpr("7L doc_id", "lpad(id, 100, 'x') text")
    plain = odd.select("doc_id", "text").where("length(text) < 1000 or text is null").unionByName(hot)
    sharding.write_shards(plain, str(tmp_path / "plain"), 2000)
    got = spark.read.parquet(str(tmp_path / "plain")).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter(map(tuple, plain.collect()))
    size = Counter()
    for r in got:
        size[r.shard] += len((r.text or "").encode())
    assert len(size) >= 15 and max(size.values()) <= 2000
    assert not any(a != b and b.startswith(a) for a in size for b in size)
    sharding.write_shards(odd, str(tmp_path / "one"))
    back = spark.read.parquet(str(tmp_path / "one"))
    assert {r.shard for r in back.collect()} == {"b"} and back.columns == [*odd.columns, "shard"]
    assert Counter(map(tuple, back.drop("shard").collect())) == Counter(map(tuple, odd.collect()))


# -- 10 line dedup ------------------------------------------------------------

def naive_lines(rows):
    seen, out = {}, []
    for doc_id, text in rows:
        keep, gone, at = [], [], 0
        for k, line in enumerate([] if text is None else text.split("\n")):
            w = low_words(line)
            first = seen.setdefault(" ".join(w), (len(out), k, doc_id)) if len(w) >= line_dedup.MIN_WORDS else (len(out), k, doc_id)
            if first[:2] == (len(out), k):
                keep.append(line)
            else:
                gone.append((k, at, at + len(line), first[2]))
            at += len(line) + 1
        out.append((doc_id, None if text is None else "\n".join(keep), tuple(gone)))
    return Counter(out)


def test_line_dedup(docs, odd, none):
    for d in (docs, odd):
        rows = sorted(((r.doc_id is None, r.doc_id, r.text) for r in d.collect()), key=lambda x: (x[0], x[1] or 0, x[2] is None))
        got = line_dedup.dedup_lines(d).collect()
        assert Counter((r.doc_id, r.text, tuple(map(tuple, r.removed))) for r in got) == naive_lines([x[1:] for x in rows])
        assert all(r.n_removed == len(r.removed) and r.n_units == (0 if r.text is None else r.n_units) for r in got)
    assert line_dedup.dedup_lines(none).count() == 0


# -- the queries and the pipeline --------------------------------------------------

CONTRACT = {
    "op3_decontamination": "doc_id n_words n_hit n_items items_sha256 contaminated",
    "op4_token_ids": "doc_id start n_tokens ids_crc32",
    "op6_simhash": "doc_id fingerprint component_id",
    "op7_toxicity": "doc_id held_out score predicted",
}


@pytest.mark.parametrize("name", [q for q in QUERIES if q not in ("pipeline", "op11_embedding_whitening", "op13_spelling_variants")])
def test_query_covers_its_table(spark, docs, name):
    rows = QUERIES[name](spark, SF).collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in docs.select("doc_id").collect()}
    assert name not in CONTRACT or rows[0].__fields__ == CONTRACT[name].split()


def test_queries_without_documents_rows(spark, docs):
    """Contracts without doc_id: a row for each vector and component, a row for each word."""
    rows = QUERIES["op11_embedding_whitening"](spark, SF).collect()
    assert {r.vec_id for r in rows} == {r.vec_id for r in table(spark, SF, "embeddings").select("vec_id").collect()}
    assert len({(r.vec_id, r.component) for r in rows}) == len(rows) and {r.component for r in rows} == set(range(1, 9))
    words = [r.word for r in QUERIES["op13_spelling_variants"](spark, SF).collect()]
    texts = "\n".join(r.text or "" for r in docs.select("text").collect())
    runs = {re.sub("[A-Z]", lambda m: m.group().lower(), x) for x in re.findall("[A-Za-z\u00c0-\u00ff]+", texts)}
    assert words and len(set(words)) == len(words) and sum(w in runs for w in words) > 0.5 * len(words)


def test_pipeline_equals_brute_force(spark, docs):
    """The classifier's own verdicts, then each further stage by its brute-force version."""
    labels = table(spark, SF, "labels")
    d = docs.collect()
    toxic = {r.doc_id for r in toxicity.toxicity(docs, labels).collect() if r.predicted}
    left = [r for r in d if r.doc_id not in toxic]
    reps = {c for _, _, c in naive_components([(r.doc_id, naive_fp(r.text)) for r in left])}
    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    left = [r for r in left if r.doc_id in reps and naive_hits(r.text, items)[1] == 0]
    auto = pii._automaton()
    want = sorted((r.doc_id, len(low_words(pii.masked(r.text, pii.find_spans(r.text, auto)) if r.text else "")) + 1) for r in left)
    check_bins(corpus_pipeline.run(spark, SF).collect(), want)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_near_dedup", "benchmark_decontamination", "pii", "best_fit_packing"]


def test_stages_on_odd_rows(spark, odd, none):
    for d in (odd, none):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            d = stage(spark, d, SF)
            assert d.columns == odd.columns
        corpus_pipeline.STAGES[-1][1](spark, d, SF).collect()
