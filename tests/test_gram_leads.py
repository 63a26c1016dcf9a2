"""Grams are hashed only where the first characters of an anchor stand (F1, F2)."""

import random

import numpy as np
import pytest

from maskloom.operators import words


@pytest.mark.parametrize("alphabet, most", [("abc", 30), ("abcdefghijklmnopqrstuvwxyz客户0123456789\U0001f600", 12)])
def test_grams_by_their_first_characters(alphabet, most, monkeypatch):
    r = random.Random(3)
    for size in (1, 2):
        anchors = sorted({"".join(r.choice(alphabet) for _ in range(r.randint(size, 9))) for _ in range(most)})
        places, grams = words._gram_finder(sorted({len(a) for a in anchors}), 16)
        bits = np.zeros((1 << 13) + (1 << words.LEAD_BITS_LOG2 - 3), np.uint8)
        for p in places(anchors).tolist():
            bits[p >> 3] |= 1 << (p & 7)
        texts = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 300))) for _ in range(30)] + [anchors[0], "a" + anchors[-1]]
        for t, found in zip(texts, grams(texts, bits)):
            assert {a for a in anchors if a in t} <= set(found) and all(x in t for x in found)
    # a text whose characters begin no anchor is not hashed; before, every character of it was
    places, grams = words._gram_finder([3], 16)
    bits = np.zeros((1 << 13) + (1 << words.LEAD_BITS_LOG2 - 3), np.uint8)
    for p in places(["客户1"]).tolist():
        bits[p >> 3] |= 1 << (p & 7)
    hashed, arange = [], np.arange
    monkeypatch.setattr(words.np, "arange", lambda *a: hashed.append(a) or arange(*a))
    assert grams(["plain text " * 50], bits) == [[]] and not hashed
    assert grams(["plain 客户1 text " * 50], bits) == [["客户1"]]
