"""Operator 13 against plain k-means in integers."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest

from tessera.llm import vector_codes as V

SCHEMA = "vec_id long, label int, embedding array<float>, code string, error string"
LARGEST = 1 << 24


def brute(rows, parts=4, entries=256, rounds=4, scale=1024.0):
    sound = [(i, label, [float(np.float32(c)) for c in x]) for i, label, x, *_ in rows if x and all(c is not None and math.isfinite(c) for c in x)]
    sound.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    sound = [r for r in sound if len(r[2]) == len(sound[0][2])]
    if not sound:
        return []
    dim = len(sound[0][2])
    edges = [round(p * dim / parts) for p in range(parts + 1)]
    ints = [[max(-LARGEST, min(LARGEST, math.floor(scale * c))) for c in r[2]] for r in sound]
    cut = [[x[a:b] for a, b in zip(edges, edges[1:])] for x in ints]
    books = [[list(x[p]) for x in cut[:entries]] for p in range(parts)]

    def best(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), k) for k, c in enumerate(books[p]))

    for _ in range(rounds):
        own = [[best(p, x[p])[1] for x in cut] for p in range(parts)]
        for p in range(parts):
            for k in range(len(books[p])):
                some = [x[p] for x, m in zip(cut, own[p]) if m == k]
                if some:
                    books[p][k] = [sum(c) // len(some) for c in zip(*some)]
    final = [[best(p, x[p]) for p in range(parts)] for x in cut]
    sums: dict = {}
    for (_, label, _), f in zip(sound, final):
        sums[label] = sums.get(label, 0) + sum(d for d, _ in f)
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted(((i, "".join(f"{k:02x}" for _, k in f), sum(d for d, _ in f), sums[label], sha) for (i, label, _), f in zip(sound, final)), key=repr)


def found(spark, rows, **how):
    return sorted(map(tuple, V.vector_codes(spark.createDataFrame(rows, SCHEMA), **how).collect()), key=repr)


def made(n, dim, seed, step=None):
    r = np.random.default_rng(seed)
    x = r.standard_normal((9, dim))[r.integers(0, 9, n)] / 8 + r.standard_normal((n, dim)) / 30
    if step:
        x = np.round(x / step) * step
    return [(i, None if i % 11 == 0 else int(r.integers(0, 3)), [float(c) for c in x[i]], "clash", "clash") for i in range(n)]


@pytest.mark.parametrize("step", [None, 0.125])
def test_matches_plain_k_means_also_with_many_ties(spark, step):
    rows = made(400, 12, 3, step)
    assert found(spark, rows) == brute(rows)
    assert found(spark, rows, entries=20, rounds=2) == brute(rows, entries=20, rounds=2)


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = made(60, 8, 4)
    rows += [(100, 1, None, "", ""), (101, 1, [0.1] * 7 + [None], "", ""), (102, 1, [nan] * 8, "", ""), (103, 1, [-inf] + [0.0] * 7, "", ""), (104, 1, [0.5] * 4, "", ""), (105, 1, [], "", "")]
    rows += [rows[5], rows[5], (6, 2, [0.3] * 8, "", ""), (None, None, [0.2] * 8, "", ""), (106, None, [3e38, -3e38] * 4, "", ""), (-5, 1, [0.0] * 8, "", ""), (107, 0, [-0.0] * 8, "", "")]
    assert found(spark, rows, entries=16) == brute(rows, entries=16)


@pytest.mark.parametrize("dim", [1, 5, 6])
def test_lengths_that_the_parts_do_not_divide(spark, dim):
    rows = made(50, dim, 5)
    assert found(spark, rows, entries=8) == brute(rows, entries=8)


def test_empty(spark):
    assert found(spark, []) == [] and found(spark, [(1, 1, None, "", ""), (2, 2, [None], "", "")]) == []


def test_hot_label_and_copies(spark):
    rows = [(i, 0, x if i % 3 else made(1, 8, 9)[0][2], "", "") for i, _, x, *_ in made(300, 8, 6)]
    assert found(spark, rows, entries=32) == brute(rows, entries=32)


@pytest.mark.parametrize("size", [1, 300, 2**24])
def test_bounds_hold_and_filter(size):
    r = np.random.default_rng(2)
    centre = r.integers(-size, size + 1, (256, 16))
    x = np.clip(centre[r.integers(0, 256, 500)] + r.integers(-size // 8 - 1, size // 8 + 2, (500, 16)), -size, size)
    exact = ((x[:, None, :] - centre[None, :, :]) ** 2).sum(2)
    for seg in (16, V.SEGMENT):
        low, room = V.bounds(V.outline(x, seg), V.outline(centre, seg))
        assert (low <= exact + room[:, None]).all()
    k, d, taken = V.Codebook(centre).nearest(x)
    assert (d == exact.min(1)).all() and (k == exact.argmin(1)).all()
    assert size == 1 or taken < 0.1 * exact.size
