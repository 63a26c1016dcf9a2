"""XXH64 of many byte spans at once, after the published xxHash specification."""

from __future__ import annotations

import numpy as np

_P1, _P2, _P3, _P4, _P5 = (
    np.uint64(p)
    for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)
)


def _rot(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _round(acc, lane):
    return _rot(acc + lane * _P2, 31) * _P1


def xxh64_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 42) -> np.ndarray:
    """Unsigned hash of ``data[s:e]`` for every span."""
    with np.errstate(over="ignore"):
        buf = np.concatenate([data, np.zeros(8, np.uint8)])
        u8 = np.ndarray(shape=(len(data) + 1,), dtype="<u8", buffer=buf, strides=(1,))
        u4 = np.ndarray(shape=(len(data) + 1,), dtype="<u4", buffer=buf, strides=(1,))
        size = ends - starts
        acc = np.full(len(starts), np.uint64(seed) + _P5, np.uint64)
        pos = starts.astype(np.int64)
        long = np.flatnonzero(size >= 32)
        if len(long):
            stripes = size[long] >> 5
            order = np.argsort(-stripes, kind="stable")
            long, stripes = long[order], stripes[order]
            s = np.uint64(seed)
            v = [np.full(len(long), x, np.uint64) for x in (s + _P1 + _P2, s + _P2, s, s - _P1)]
            at = pos[long]
            for t in range(int(stripes[0])):
                n = int(np.searchsorted(-stripes, -t, side="left"))  # spans with more than t stripes come first
                for i in range(4):
                    v[i][:n] = _round(v[i][:n], u8[at[:n] + 8 * i])
                at[:n] += 32
            h = _rot(v[0], 1) + _rot(v[1], 7) + _rot(v[2], 12) + _rot(v[3], 18)
            for x in v:
                h = (h ^ _round(np.zeros_like(x), x)) * _P1 + _P4
            acc[long] = h
            pos[long] = at
        acc += size.astype(np.uint64)
        rest = size & 31
        for _ in range(3):
            i = np.flatnonzero(rest >= 8)
            if not len(i):
                break
            lane = u8[pos[i]]
            acc[i] = _rot(acc[i] ^ _round(np.zeros_like(lane), lane), 27) * _P1 + _P4
            pos[i] += 8
            rest[i] -= 8
        i = np.flatnonzero(rest >= 4)
        if len(i):
            acc[i] = _rot(acc[i] ^ (u4[pos[i]].astype(np.uint64) * _P1), 23) * _P2 + _P3
            pos[i] += 4
            rest[i] -= 4
        for _ in range(3):
            i = np.flatnonzero(rest >= 1)
            if not len(i):
                break
            acc[i] = _rot(acc[i] ^ (buf[pos[i]].astype(np.uint64) * _P5), 11) * _P1
            pos[i] += 1
            rest[i] -= 1
        acc ^= acc >> np.uint64(33)
        acc *= _P2
        acc ^= acc >> np.uint64(29)
        acc *= _P3
        acc ^= acc >> np.uint64(32)
    return acc
