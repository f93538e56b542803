"""Operator 12 against scores of all pairs."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import hard_negatives as H

SCHEMA = "vec_id long, label int, embedding array<float>, positive_id string, e string"


def brute(rows, every=10, scale=256.0, k=5, low=80, high=100):
    kept = {}
    for i, label, x, *_ in rows:
        if i is None or label is None or x is None or any(c is None or not math.isfinite(c) for c in x):
            continue
        x = [float(np.float32(c)) for c in x]
        if i not in kept or (label, x) < kept[i]:
            kept[i] = (label, x)
    ints = {i: (label, [max(-H.LARGEST, min(H.LARGEST, math.floor(scale * c))) for c in x]) for i, (label, x) in kept.items()}
    out = []
    for a, (label, x) in ints.items():
        if a % every:
            continue
        scores = [(-sum(p * q for p, q in zip(x, y)), i, other) for i, (other, y) in ints.items() if i != a and len(y) == len(x) and len(x)]
        for p, pos, _ in sorted(s for s in scores if s[2] == label)[:k]:
            fits = sorted(s for s in scores if s[2] != label and low * -p <= 100 * -s[0] <= high * -p)[:k]
            out += [(a, pos, n + 1, i, -p, -s) for n, (s, i, _) in enumerate(fits)]
    return sorted(out)


def found(spark, rows, every=10, **how):
    df = spark.createDataFrame(rows, SCHEMA)
    return sorted(map(tuple, H.hard_negatives(df, F.col("vec_id") % every == 0, **how).collect()))


def made(n, dim, labels, seed, step=None):
    r = np.random.default_rng(seed)
    centre = r.standard_normal((labels, dim))
    x = (centre[r.integers(0, labels, n)] + 0.7 * r.standard_normal((n, dim))) / dim
    if step:
        x = np.round(x / step) * step
    return [(i, int(r.integers(0, labels)), [float(c) for c in x[i]], "clash", "clash") for i in range(n)]


@pytest.mark.parametrize("step", [None, 0.05])
def test_matches_all_pairs_also_with_many_ties(spark, step):
    rows = made(700, 12, 4, 5, step)
    assert found(spark, rows) == brute(rows)


def test_many_blocks_and_chunks(spark, monkeypatch):
    monkeypatch.setattr(H, "LEAST", 40)
    monkeypatch.setattr(H, "AIM", 1 << 20)
    rows = made(500, 8, 3, 6)
    assert H.blocks(500) == 13 and found(spark, rows, every=3) == brute(rows, every=3)


def test_one_label_holds_most(spark):
    rows = [(i, 0 if i % 5 else label, x, *more) for i, label, x, *more in made(600, 10, 6, 7)]
    assert found(spark, rows, low=50, high=90) == brute(rows, low=50, high=90)


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = made(120, 6, 3, 8)
    rows += [(None, 1, [0.1] * 6, "", ""), (130, None, [0.1] * 6, "", ""), (140, 1, None, "", ""), (150, 1, [0.1, None, 0.1, 0.1, 0.1, 0.1], "", ""), (160, 2, [nan] * 6, "", ""), (170, 2, [0.1] * 5 + [inf], "", "")]
    rows += [(180, 1, [0.5] * 4, "", ""), (181, 1, [0.4] * 4, "", ""), (182, 2, [0.35] * 4, "", ""), (183, 2, [0.45] * 4, "", ""), (190, 0, [], "", ""), (191, 0, [], "", "")]
    rows += [(200, 2, [3e38, -3e38, 0.0, 1.0, -1.0, 2.0], "", ""), (201, 2, [1e38] + [0.0] * 5, "", ""), (202, 1, [9e37] + [0.0] * 5, "", "")]
    rows += [(10, 2, [0.2] * 6, "", ""), (10, 0, [-0.2] * 6, "", ""), (11, 1, rows[11][2], "", ""), rows[20], rows[20], (-30, 1, [-0.1] * 6, "", ""), (0, 1, [0.0] * 6, "", "")]
    assert found(spark, rows) == brute(rows)
    assert any(r[0] == 180 for r in found(spark, rows))


def test_few_or_no_partners(spark):
    one = [(10, 1, [0.5, 0.5], "", ""), (11, 1, [0.5, 0.4], "", ""), (12, 2, [0.5, 0.39], "", "")]
    assert found(spark, one) == brute(one) == [(10, 11, 1, 12, 128 * 128 + 128 * 102, 128 * 128 + 128 * 99)]
    assert found(spark, one[:2]) == [] and found(spark, []) == []
    negative = [(10, 1, [0.5], "", ""), (11, 1, [-0.5], "", ""), (12, 2, [-0.45], "", "")]
    assert found(spark, negative) == brute(negative) == []


def test_planes_add_up_and_bounds_hold():
    r = np.random.default_rng(1)
    x, a = r.integers(-300, 300, (50, 7)), r.integers(-300, 300, (9, 7))
    planes = H.Planes(x)
    assert (sum(planes.plane(j, "i8") << j for j in range(planes.bits + 1)) - (1 << planes.bits) == x).all()
    s, exact, step = np.repeat(H.Anchors(a, planes).base[:, None], 50, 1), a @ x.T, H.Anchors(a, planes)
    width = []
    while step.j:
        step.matrix(s, slice(0, 50))
        low, high = step.slack()
        assert (s + low[:, None] <= exact).all() and (s + high[:, None] >= exact).all()
        width.append(int((high - low).max()))
    assert (s == exact).all() and width == sorted(width, reverse=True) and width[-1] == 0


def test_candidates_are_dropped_before_the_last_plane():
    rows = made(4000, 16, 5, 9)
    x = H.scaled(np.array([r[2] for r in rows]), 2560)
    planes, seen = H.Planes(x), []
    whole = H.Anchors.pairs
    try:
        H.Anchors.pairs = lambda self, s, i, k: (seen.append((self.j, len(i))), whole(self, s, i, k))[1]
        i, q, v = H.nearest(x[:20], np.arange(20), planes, np.arange(4000), slice(0, 4000), 5)
    finally:
        H.Anchors.pairs = whole
    exact = x[:20] @ x.T
    for n in range(20):
        others = sorted((-int(exact[n, m]), m) for m in range(4000) if m != n)[:5]
        assert sorted((-int(b), int(a)) for a, b in zip(q[i == n], v[i == n])) == others
    assert seen and seen[0][1] < 20 * 4000 * H.SPARSE and seen[-1][1] < 2000
