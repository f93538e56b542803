"""Operator 6: values of assignments, long runs, and searches that are remembered."""

from __future__ import annotations

import random
import time

import pytest

from tessera.llm import secret_scan as S


@pytest.fixture(scope="module")
def models():
    return S.models()


def found(models, text):
    return [(m.start() + a, m.start() + b) for m in S.CANDIDATE.finditer(text) for a, b in models.found(m[0], S.SET_TO.search(text, max(0, m.start() - 80), m.start()) is not None)]


def test_models_are_fitted_once(models):
    assert S.models() is models


def test_secrets_of_the_table_with_the_base_patterns_hidden(models, spark):
    """The automata alone find the table's own secrets and leave its other runs alone."""
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect() + spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("text").where("doc_id < 4000").collect()
    hit = every = outside = 0
    for (text,) in rows:
        base, own = S.base_spans(text or ""), found(models, text or "")
        every += len(base)
        hit += sum(any(c < b and a < d for c, d in own) for a, _, b in base)
        outside += sum(not any(a < d and c < b for a, _, b in base) for c, d in own)
    assert every > 50 and hit > 0.85 * every and outside < 0.01 * len(rows)


def test_values_and_bare_runs(models):
    r = random.Random(5)
    digests = ["".join(r.choices(S.HEXA, k=40)) for _ in range(100)]
    assert sum(bool(found(models, f'auth = "{d}"')) for d in digests) > 85
    assert sum(bool(found(models, f"see objects/{d}.txt")) for d in digests) < 10
    fresh = [t for t in (S.ordinary(random.Random(900 + i)) for i in range(1000)) if len(t) >= 16]
    assert sum(bool(models.found(t, False)) for t in fresh) < 0.03 * len(fresh) and sum(bool(models.found(t, True)) for t in fresh) < 0.08 * len(fresh)
    keys = [S.credential(r, f) for f in S.FORMATS for _ in range(20)]
    assert sum(bool(found(models, f"session_key={k} x")) for k in keys) > 0.9 * len(keys)


@pytest.mark.parametrize("piece", [".", "a/", "a=", "0123456789abcdef-", "ab.cd/ef=", "x1-Y2.z3/", "="])
def test_a_megabyte_in_seconds(models, piece):
    run = (piece * 1_000_000)[:1_000_000]
    start = time.perf_counter()
    models.found(run, False)
    assert time.perf_counter() - start < 20


def test_long_random_runs_in_seconds(models):
    r = random.Random(6)
    for alphabet, size, by in ((S.BASE64, 64, " "), (S.ALNUM, 40, "="), (S.HEXA, 8, "-"), (S.ALNUM, 5, "/")):
        run = by.strip().join("".join(r.choices(alphabet, k=size)) for _ in range(400_000 // size))
        start = time.perf_counter()
        models.found(run, True)
        assert time.perf_counter() - start < 20


def test_remembered_searches_change_nothing(models):
    """Against every start searched anew."""
    r, model = random.Random(7), models.bare

    def anew(run):
        out, at = [], 0
        while at <= len(run) - model.LEAST:
            if at == 0 or not run[at - 1].isalnum():
                _, end, _ = model.best(run, at)
                if end > at:
                    out.append((at, end))
                    at = end
                    continue
            at += 1
        return out

    pieces = ["a/", "..", "1-", "ab.", "Qx9_", "ghp_", *(S.credential(r, f) for f in S.FORMATS[:6])]
    for _ in range(150):
        run = "".join(r.choice(pieces) * r.randint(1, 60) for _ in range(r.randint(1, 5)))
        assert model.found(run) == anew(run)


def test_values_within_a_run_and_extreme_texts(models):
    r = random.Random(8)
    keys = [S.credential(r, S.FORMATS[0]) for _ in range(20)]
    assert sum(found(models, f"a=1=zz={k}") == [(7, 47)] for k in keys) > 17
    for text in ("", "=", "=" * 15, "=" * 16, "a=" * 8 + "=", ": " + "é" * 20):
        assert S.spans(text, models)[1] == S.base_spans(text)
