"""Whitening, Grace deduplication and spelling variants against slow versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest

from maskloom.llm import grace_dedup, spelling, whitening
from maskloom.llm.common import table
from maskloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOW = str.maketrans(UPPER, UPPER.lower())


# -- 11 whitening ---------------------------------------------------------------


def usable(rows):
    out = [(r[0], r[1]) for r in rows if r[1] is not None and len(r[1]) and all(c is not None and math.isfinite(c) for c in r[1])]
    dim = max((len(v) for _, v in out), default=0)
    return [(i, [math.floor(1024 * float(c)) + 100000 for c in v]) for i, v in out if len(v) == dim]


def check_whitening(rows, source, components=8):
    xs = usable(source)
    n, dim = len(xs), len(xs[0][1])
    sums = [sum(x[k] for _, x in xs) for k in range(dim)]
    x = np.array([x for _, x in xs], float) - np.array([s / n for s in sums])
    cov = x.T @ x / n
    e, v = np.linalg.eigh(cov)
    e, v = e[::-1], v[:, ::-1]
    assert len(rows) == n * min(components, dim)
    assert Counter(r.vec_id for r in rows) == Counter({i: c * min(components, dim) for i, c in Counter(i for i, _ in xs).items()})
    deviations = Counter((i, sum((n * a - s) ** 2 for a, s in zip(v_, sums))) for i, v_ in xs)
    assert Counter((r.vec_id, r.deviation) for r in rows if r.component == 1) == deviations
    assert all(r.n == n and int(r.deviation_exact) == r.deviation for r in rows)
    scale = max(e[0], 1e-9)
    want = defaultdict(list)
    for k in range(min(components, dim)):
        mine = [r for r in rows if r.component == k + 1]
        if e[k] <= 1e-9 * scale:
            assert all(r.whitened is None for r in mine)
            continue
        assert all(abs(r.explained - e[k] / np.trace(cov)) <= 1e-9 for r in mine)
        single = all(abs(e[k] - e[j]) > 1e-6 * scale for j in range(dim) if j != k)
        if single:
            axis = x @ v[:, k] / math.sqrt(e[k])
            for (i, _), w in zip(xs, axis):
                want[i, k].append(abs(w))
            for i in {i for i, _ in xs}:
                assert np.allclose(sorted(abs(r.whitened) for r in mine if r.vec_id == i), sorted(want[i, k]), rtol=1e-6, atol=1e-6)
    errors = {r.identity_error for r in rows}
    assert len(errors) == 1 and (errors == {None} or errors.pop() < 1e-8)


def test_whitening_equals_eigh(spark):
    rows = QUERIES["op11_embedding_whitening"](spark, SF).collect()
    check_whitening(rows, table(spark, SF, "embeddings").select("vec_id", "embedding").collect())


def test_whitening_signs_are_the_same_for_all_rows(spark):
    rows = QUERIES["op11_embedding_whitening"](spark, SF).collect()
    xs = usable(table(spark, SF, "embeddings").select("vec_id", "embedding").collect())
    x = np.array([v for _, v in sorted(xs)], float)
    x -= x.mean(axis=0)
    e, v = np.linalg.eigh(x.T @ x / len(x))
    for k in range(8):
        got = np.array([r.whitened for r in sorted((r for r in rows if r.component == k + 1), key=lambda r: r.vec_id)])
        want = x @ v[:, -1 - k] / math.sqrt(e[-1 - k])
        assert min(np.abs(got - want).max(), np.abs(got + want).max()) < 1e-6


ODD = "vec_id long, embedding array<float>, component string, n int, Whitened string, i int"


def test_whitening_of_odd_rows(spark):
    rng = random.Random(3)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(4)], "x", 1, "ORIG", 2) for i in range(30)]
    rows += [(7, [0.5, 0.25, None, 0.1], None, None, None, None), (108, None, "", 0, "", 0), (109, [float("nan")] * 4, "", 0, "", 0), (110, [1.0, float("inf"), 0.0, 0.0], "", 0, "", 0)]
    rows += [(11, [], "", 0, "", 0), (12, [0.5], "", 0, "", 0), (None, [0.1, 0.2, 0.3, 0.4], None, None, None, None), rows[0], rows[0]]
    df = spark.createDataFrame(rows, ODD)
    check_whitening(whitening.whitened(df).collect(), [(r[0], r[1]) for r in df.collect()])
    assert whitening.whitened(df.limit(0)).count() == 0
    assert whitening.whitened(df.where("vec_id in (108, 109, 110)")).count() == 0
    assert whitening.whitened(df.limit(0)).columns == whitening.whitened(df).columns


def test_whitening_with_zero_and_multiple_eigenvalues(spark):
    one = spark.createDataFrame([(1, [0.5, 0.25])], "vec_id long, embedding array<double>")
    rows = whitening.whitened(one).collect()
    assert [(r.component, r.whitened, r.explained, r.deviation, r.identity_error) for r in sorted(rows, key=lambda r: r.component)] == [(1, None, None, 0, None), (2, None, None, 0, None)]
    # a cross: two equal eigenvalues, one of zero
    cross = [(1, [1.0, 0.0, 2.0]), (2, [-1.0, 0.0, 2.0]), (3, [0.0, 1.0, 2.0]), (4, [0.0, -1.0, 2.0])]
    rows = whitening.whitened(spark.createDataFrame(cross, "vec_id long, embedding array<double>")).collect()
    assert len(rows) == 12 and all(r.identity_error < 1e-9 for r in rows)
    assert all(r.whitened is None and r.explained == 0 for r in rows if r.component == 3)
    assert all(abs(r.explained - 0.5) < 1e-12 for r in rows if r.component < 3)
    # few vectors in many dimensions
    rng = random.Random(5)
    few = [(i, [rng.uniform(-1, 1) for _ in range(12)]) for i in range(5)]
    check_whitening(whitening.whitened(spark.createDataFrame(few, "vec_id long, embedding array<double>")).collect(), few)


def test_whitening_of_large_entries_is_exact(spark):
    rng = random.Random(6)
    big = [(i, [rng.uniform(-(2**29), 2**29) for _ in range(3)]) for i in range(40)]
    rows = whitening.whitened(spark.createDataFrame(big, "vec_id long, embedding array<double>")).collect()
    xs = usable(big)
    sums = [sum(x[k] for _, x in xs) for k in range(3)]
    want = {i: sum((40 * a - s) ** 2 for a, s in zip(x, sums)) for i, x in xs}
    assert all(int(r.deviation_exact) == want[r.vec_id] and (r.deviation is None) == (want[r.vec_id] >= 2**63) for r in rows)
    assert any(r.deviation is None for r in rows) and all(r.identity_error < 1e-8 for r in rows)


def test_scatter_is_exact():
    rng = np.random.default_rng(1)
    for top in (10, 1 << 21, 1 << 40):
        z = rng.integers(-top, top, (5000, 3))
        assert (whitening.scatter(z) == z.astype(object).T @ z.astype(object)).all()


def slow_characteristic(m):
    """Faddeev-LeVerrier with fractions."""
    d = len(m)
    a = np.array([[Fraction(v) for v in r] for r in m], object)
    c, b = [Fraction(1)], np.array([[Fraction(int(i == j)) for j in range(d)] for i in range(d)], object)
    for k in range(1, d + 1):
        ab = a.dot(b)
        c.append(-sum(ab[i, i] for i in range(d)) / k)
        b = ab + np.array([[c[-1] * int(i == j) for j in range(d)] for i in range(d)], object)
    return [int(x) for x in reversed(c)]


def test_characteristic_polynomial_and_roots(spark):
    rng = random.Random(2)
    rows = spark.range(1)
    for d, rank in ((1, 1), (2, 2), (5, 5), (6, 3)):
        x = np.array([[rng.randint(-9, 9) for _ in range(d)] for _ in range(rank)], object)
        m = x.T.dot(x).tolist()
        poly = whitening.characteristic(rows, m)
        assert poly == slow_characteristic(m)
        trace = sum(m[i][i] for i in range(d))
        if trace == 0:
            continue
        roots, _ = whitening.largest_roots(poly, trace, d)
        want = sorted(np.linalg.eigvalsh(np.array(m, float)), reverse=True)
        got = [float(r.value) for r in roots for _ in range(r.multiple)]
        assert np.allclose(got, want, atol=1e-6)


def test_squarefree_part():
    def times(a, b):
        out = [0] * (len(a) + len(b) - 1)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                out[i + j] += x * y
        return out

    a, b, c = [-3, 1], [-10, 1], [0, 1]
    assert whitening.squarefree(times(times(times(a, a), times(b, b)), times(b, c))) == times(times(a, b), c)
    assert whitening.squarefree(times(a, b)) == times(a, b)


# -- 12 Grace deduplication --------------------------------------------------------


def slow_copies(rows):
    """rows: (id, text) in storage order."""
    groups = defaultdict(list)
    for k, (i, t) in enumerate(rows):
        groups[t or ""].append((i is not None, i or 0, -k))
    out = Counter()
    for t, members in groups.items():
        best = max(members)
        for m in members:
            out[(m[1] if m[0] else None, best[1] if best[0] else None, len(members), m == best, hashlib.sha256(t.encode()).hexdigest())] += 1
    return out


def found_copies(df):
    assert df.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    return Counter(tuple(r) for r in df.collect())


def test_copies_equal_groups(spark):
    docs = table(spark, SF, "documents")
    assert found_copies(QUERIES["op12_grace_dedup"](spark, SF)) == slow_copies([(r.doc_id, r.text) for r in docs.collect()])


@pytest.mark.parametrize("bucket_bytes, salt_rows", [(64 << 20, 4096), (400, 1), (40, 2)])
def test_copies_split_and_salted(spark, bucket_bytes, salt_rows):
    rng = random.Random(4)
    rows = [(rng.randint(0, 400), rng.choice(["a", "b" * 300, f"t{rng.randint(0, 120)}", "", None, "hot " * 20, "hot " * 20])) for _ in range(900)]
    rows += [(None, "hot " * 20), (None, None), (None, "only here"), rows[0], rows[0]]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6).cache()
    got = found_copies(grace_dedup.copies(df, bucket_bytes=bucket_bytes, salt_rows=salt_rows))
    want = slow_copies([(r.doc_id, r.text) for r in df.collect()])
    # which of several rows with the largest id stays is free between partitions; one of each group does
    assert got == want
    df.unpersist()


def test_equal_digests_are_compared_whole():
    t = grace_dedup.OpenTable()
    names = [t.put(5, c, k) for k, c in enumerate([b"x", b"y", b"x", b"", b"y"])]
    assert names == [0, 1, 0, 3, 1]
    many = [t.put(h, str(h).encode(), 100 + h) for h in range(5000)]
    assert many == [100 + h for h in range(5000)] and t.put(5, b"y", 9) == 1


def test_directory_splits_until_buckets_fit(spark):
    rows = [(k, hashlib.sha256(str(k).encode()).digest()[0] << 54 | k, b"z" * 100) for k in range(300)]
    rows = [(k, (h if k % 2 else (7 << 54) | k), c) for k, h, c in rows]  # half of all under one prefix
    firsts = spark.createDataFrame(rows, "ref long, h long, content binary")
    bits, splits = grace_dedup.directory(firsts, 2000)
    assert splits
    sizes = grace_dedup.dealt(firsts, bits, splits).groupBy("bucket").count().collect()
    assert sum(r["count"] for r in sizes) == 300 and max(r["count"] for r in sizes) <= 20


def test_copies_odd_rows(odd, none):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert found_copies(grace_dedup.copies(odd)) == slow_copies(rows)
    assert grace_dedup.copies(none).count() == 0 and grace_dedup.without_copies(none).count() == 0
    named = odd.select("*", *[odd.score.cast("string").alias(c) for c in ("id", "place", "ref", "digest", "row", "__place", "text_sha256", "kept", "Kept_")])
    assert found_copies(grace_dedup.copies(named)) == slow_copies(rows)
    stay = grace_dedup.without_copies(named)
    assert stay.columns == named.columns
    best = {t: max((i is not None, i or 0) for i, x in rows if (x or "") == t) for t in {t or "" for _, t in rows}}
    assert Counter((r.text or "", r.doc_id is not None, r.doc_id or 0) for r in stay.collect()) == Counter((t, *b) for t, b in best.items())


# -- 13 spelling variants ------------------------------------------------------------


def slow_words(rows):
    seen = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(LOW)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            seen[run] += 1
    return {w: n for w, n in seen.items() if len(w) >= 7 and n >= 2}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def slow_variants(words):
    by_length = defaultdict(list)
    for w in words:
        by_length[len(w)].append(w)
    out, form = {}, {}
    for w, n in words.items():
        near = [x for d in (-1, 0, 1) for x in by_length[len(w) + d] if one_edit(w, x)]
        best = min(near, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 10 * n else None
        out[w] = (n, len(near), words[form[w]] if form[w] else None)
    res = set()
    for w, (n, k, f) in out.items():
        root = w
        while form[root]:
            root = form[root]
        res.add((w, form[w], root, n, k, f))
    return res


def found_variants(df):
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_variants_equal_all_pairs(spark):
    rows = [(r.doc_id, r.text) for r in table(spark, SF, "documents").select("doc_id", "text").collect()]
    got = found_variants(QUERIES["op13_spelling_variants"](spark, SF))
    assert got == slow_variants(slow_words(rows)) and any(r[1] for r in got)


def test_variants_of_crowded_words(spark):
    """Few letters, so that words repeat their bigrams and are near many others."""
    rng = random.Random(8)
    for letters in ("ab", "aé", "xyzÿ"):
        text = " ".join("".join(rng.choice(letters) for _ in range(rng.randint(7, 10))) for _ in range(1500))
        rows = [(k, text if k % 2 else text + " " + "abababab " * 40) for k in range(3)]
        df = spark.createDataFrame(rows, "doc_id long, text string")
        assert found_variants(spelling.variants(df)) == slow_variants(slow_words(rows))


def test_roots_follow_forms(spark):
    counts = {"international": 9000, "internationol": 800, "internatiomol": 70, "intermatiomol": 6, "elsewhere": 5}
    docs = [(k, " ".join([w] * n)) for k, (w, n) in enumerate(counts.items())]
    want = slow_variants(slow_words(docs))
    assert {r[0]: r[2] for r in want}["intermatiomol"] == "international"
    assert found_variants(spelling.variants(spark.createDataFrame(docs, "doc_id long, text string"))) == want


def test_pivots_are_the_lightest_disjoint_pair():
    rng = random.Random(9)
    for _ in range(300):
        at = sorted(rng.sample(range(12), rng.randint(3, 6)))
        prefix = [(i, rng.randint(1, 9)) for i in at]
        weight = dict(prefix)
        got = spelling.pivots(prefix)
        best = min(weight[i] + weight[j] for i in at for j in at if j - i >= 2)
        assert got[1] - got[0] >= 2 and weight[got[0]] + weight[got[1]] == best


def test_variants_odd_rows(odd, none):
    assert found_variants(spelling.variants(odd)) == slow_variants(slow_words([(r.doc_id, r.text) for r in odd.collect()]))
    assert spelling.variants(none).count() == 0
    named = odd.select("*", *[odd.score.alias(c) for c in ("word", "n", "run", "id", "h")])
    assert spelling.variants(named).count() == spelling.variants(odd).count()
