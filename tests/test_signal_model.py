"""The model of signals: weights by plain Python, and the same answers after saving and loading."""

from __future__ import annotations

import math
import re

from tessera import ml

TEXTS = ["Alfa acquires Beta for growth", "Alfa sells Beta", "Gamma acquires Delta and Beta", "join our team today", "our team is hiring today", "hiring hiring hiring analysts", "", "x", "Beta joins Alfa"]


def rows_of(spark):
    cases = [(i, t, float(i % 3), None if i == 8 else int(i < 3), None if i in (6, 7) else ("deal" if i < 3 or i == 8 else "job")) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(cases, "id long, text string, size double, keep int, type string")


def test_weights_against_plain_python(spark):
    model = ml.smooth_vectors(rows_of(spark), ["size"], least=2.0, share=0.95)
    vocabulary = model.stages[3].vocabulary
    grams = []
    for t in TEXTS:
        w = re.findall(r"[a-z0-9à-öø-ÿ']{2,}", t.lower())
        grams.append(w + [" ".join(p) for p in zip(w, w[1:])])
    df = {g: sum(g in x for x in grams) for x in grams for g in x}
    assert sorted(vocabulary) == sorted(g for g, n in df.items() if n >= 2)
    for r in model.transform(rows_of(spark)).select("id", "size", "vector").collect():
        weights = [grams[r.id].count(g) * (math.log((1 + len(TEXTS)) / (1 + df[g])) + 1) for g in vocabulary]
        length = math.sqrt(sum(x * x for x in weights)) or 1
        assert all(abs(a - b) < 1e-9 for a, b in zip(r.vector.toArray(), [*(x / length for x in weights), r.size]))


def test_saved_and_loaded(spark, tmp_path):
    from pyspark.ml import PipelineModel

    rows = rows_of(spark)
    model = ml.signal_model(rows, ["size"])
    model.write().overwrite().save(str(tmp_path / "model"))
    new = rows.select("id", "text", "size").union(spark.createDataFrame([(9, None, 0.0)], "id long, text string, size double"))
    before = sorted(map(tuple, ml.classified(model, new).collect()))
    assert before == sorted(map(tuple, ml.classified(PipelineModel.load(str(tmp_path / "model")), new).collect())) and len(before) == 10
    said = {r.id: r for r in ml.classified(model, new, 0.5, 0.5).collect()}
    assert [said[i].keep for i in range(6)] == [True] * 3 + [False] * 3 and [said[i].type_label for i in range(6)] == ["deal"] * 3 + ["job"] * 3
    for r in said.values():
        assert r.keep == (r.keep_prob >= 0.5) and r.keep_confidence == max(r.keep_prob, 1 - r.keep_prob) and r.confidence == min(r.keep_confidence, r.type_prob) and r.keep_confident and r.type_confident


def test_texts_are_read_twice(spark):
    """Once for the vocabulary and once for the counts, which the weights and both fits share; the model's weights are those of ``smooth_vectors``."""
    from pyspark.sql import functions as F

    seen = spark.sparkContext.accumulator(0)

    def counted(text):
        seen.add(1)
        return text

    rows = rows_of(spark).withColumn("text", F.udf(counted, "string").asNondeterministic()("text"))
    model = ml.signal_model(rows, ["size"])
    assert seen.value == 2 * len(TEXTS)
    assert model.stages[4].getScalingVec() == ml.smooth_vectors(rows_of(spark), ["size"]).stages[4].getScalingVec()
