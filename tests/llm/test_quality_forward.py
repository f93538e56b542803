"""Operator 9's forward pass against loops over all positions, chunks and units of a text."""

from __future__ import annotations

import numpy as np
import pytest

from tessera.llm import quality as Q


def plainly(net, text):
    raw = text.encode() if text else b""
    hops = -(-(len(raw) + Q.WIDTH) // (2 * Q.HOP))
    raw = raw.ljust(hops * 2 * Q.HOP, b"\0") + bytes(Q.WIDTH)
    tops = np.full((hops, Q.FILTERS), -np.inf)
    for h in range(hops):
        for p in range(Q.HOP):
            at = 2 * (h * Q.HOP + p)
            for f in range(Q.FILTERS):
                tops[h, f] = max(tops[h, f], sum(float(net.w[k, raw[at + k], f]) if at + k < hops * 2 * Q.HOP else float(net.w[k, 0, f]) for k in range(Q.WIDTH)))
    units = []
    for h in range(hops):  # a chunk is two hops and overlaps the next one by half
        x = np.maximum(tops[h], tops[h + 1]) if h + 1 < hops else tops[h]
        units.append([max(0.0, sum(max(0.0, x[f] + net.b[f]) * net.a[f, u] for f in range(Q.FILTERS)) + net.c[u]) for u in range(Q.HIDDEN)])
    units = np.array(units)
    doc = [*units.max(0), *(units.sum(0) / hops)]
    return sum(d * u for d, u in zip(doc, net.u)) + net.d[0]


@pytest.mark.parametrize("text", [None, "", "a", "x" * 57, "x" * 58, "x" * 59, "Some text of words. " * 6, "ünï\n" * 40, "a b c\0d " * 17])
def test_one_text(text):
    net = Q.Network(seed=5)
    assert abs(float(net.logits([text])[0]) - plainly(net, text)) < 1e-3


def test_texts_of_a_batch_do_not_touch_each_other():
    """A text's score is the same whatever stands beside it in a batch."""
    net, texts = Q.Network(seed=6), ["one", None, "two " * 50, "", "three" * 13, "zz" * 29]
    together = net.logits(texts)
    alone = np.array([net.logits([t])[0] for t in texts])
    assert np.abs(together - alone).max() < 1e-4 and np.abs(alone - [plainly(net, t) for t in texts]).max() < 1e-3


def test_blocks_of_long_texts(monkeypatch):
    net, text = Q.Network(seed=7), "The quick brown fox, and then 12 more. " * 300
    whole = net.logits([text])[0]
    monkeypatch.setattr(Q, "BLOCK", Q.HOP * 4)
    assert abs(net.logits([text])[0] - whole) < 1e-4
    scores = net.scores([text, None])
    assert ((scores >= 0) & (scores <= 1)).all()
