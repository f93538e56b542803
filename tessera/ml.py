"""Text classification with pyspark.ml: 1- and 2-gram TF-IDF and balanced logistic regression."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import IDF, CountVectorizer, ElementwiseProduct, HashingTF, IndexToString, NGram, Normalizer, RegexTokenizer, SQLTransformer, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def balanced(rows: DataFrame) -> DataFrame:
    """Adds a weight that makes classes count alike; classes are few."""
    n = rows.groupBy("label").agg(F.count("*").alias("_n"))
    total = n.agg(F.sum("_n").alias("_all"), F.count("*").alias("_k"))
    return rows.join(F.broadcast(n.join(F.broadcast(total))), "label").withColumn("weight", F.col("_all") / (F.col("_k") * F.col("_n"))).drop("_n", "_all", "_k")


def text_classifier(rows: DataFrame, features: int = 1 << 14, iterations: int = 12) -> PipelineModel:
    """Fits on rows(text, label)."""
    stages = [
        RegexTokenizer(inputCol="text", outputCol="words", pattern=r"[^a-z0-9#%&*$|]+"), NGram(n=2, inputCol="words", outputCol="pairs"),
        HashingTF(inputCol="words", outputCol="tf1", numFeatures=features), HashingTF(inputCol="pairs", outputCol="tf2", numFeatures=features),
        IDF(inputCol="tf1", outputCol="f1", minDocFreq=2), IDF(inputCol="tf2", outputCol="f2", minDocFreq=2), VectorAssembler(inputCols=["f1", "f2"], outputCol="features"),
        LogisticRegression(labelCol="label", weightCol="weight", maxIter=iterations, regParam=0.01),
    ]
    return Pipeline(stages=stages).fit(balanced(rows.where("text is not null and label is not null")))


def predicted(model: PipelineModel, rows: DataFrame) -> DataFrame:
    return model.transform(rows.where("text is not null"))


def f1(rows: DataFrame) -> float:
    return MulticlassClassificationEvaluator(labelCol="label", predictionCol="prediction", metricName="f1").evaluate(rows)


def stratified(rows: DataFrame, id_: str, label: str, train: float = 0.8, validation: float = 0.1) -> DataFrame:
    """Adds ``part``: train, validation or test, in these shares of each class. Rows are cut at quantiles of a hash of their id within the class,
    one number each from a combining aggregation, so no task holds a class."""
    h = F.xxhash64(F.lit(5), id_)
    cuts = rows.groupBy(label).agg(F.percentile_approx(h, [train, train + validation], 10_000).alias("_cut"))
    cut = F.broadcast(cuts)  # a row for each class
    part = F.when(h <= F.col("_cut")[0], "train").when(h <= F.col("_cut")[1], "validation").otherwise("test")
    return rows.join(cut, label).withColumn("part", part).drop("_cut")


def class_report(rows: DataFrame, by: list[str]) -> DataFrame:
    """by, label, n, precision, recall, f1 of rows(label, prediction), from one count of each pair; null where a class was never predicted."""
    pairs = rows.groupBy(*by, F.col("label").cast("long").alias("label"), F.col("prediction").cast("long").alias("guess")).count()
    of = lambda c, name: pairs.groupBy(*by, F.col(c).alias("label")).agg(F.sum("count").alias(name))
    hit = pairs.where("label = guess").select(*by, "label", F.col("count").alias("_hit"))
    x = of("label", "n").join(of("guess", "_said"), [*by, "label"], "left").join(hit, [*by, "label"], "left").na.fill(0, ["_hit"])
    precision, recall = F.col("_hit") / F.col("_said"), F.col("_hit") / F.col("n")
    f1 = 2.0 * F.col("_hit") / (F.col("n") + F.coalesce("_said", F.lit(0)))
    return x.select(*by, "label", "n", F.round(precision, 4).alias("precision"), F.round(recall, 4).alias("recall"), F.round(f1, 4).alias("f1"))


#: Patterns of what a text has, by the name of the feature.
HAS = {
    "has_amount": r"(?i)(?:€|\$|£)\s*\d+|\b\d+(?:[.,]\d+)?\s*(?:m|mn|mln|million|m€|bn|billion)\b",
    "has_date": r"(?i)\b\d{4}-\d{2}-\d{2}\b|\b\d{1,2}\s+(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)\w*\b",
    "has_percent": r"(?i)\b\d+(?:[.,]\d+)?\s*%\b",
    "has_deal_kw": r"(?i)\b(acquis|acquire|acquisition|invest|investment|deal|rileva|entra in|enters?)\b",
    "has_exit_kw": r"(?i)\b(exit|divest|sale|sold|cessione|ced(e|e?))\b",
    "has_fund_kw": r"(?i)\b(fund|fondo|fundraising|close|closing|lancia|lancio|nasce|launch)\b",
    "has_people_kw": r"(?i)\b(appoint|appointed|joins?|joined|promot|nominat|nomina|team)\b",
    "has_job_kw": r"(?i)\b(job|career|careers|lavora con noi|position|opening)\b",
}
PAGES = ["NEWS", "PORTFOLIO", "TEAM", "CAREERS"]


def one_line(*texts: Column) -> Column:
    """Texts joined, white space collapsed; null ones are empty."""
    return F.trim(F.regexp_replace(F.concat_ws(" ", *(F.coalesce(t, F.lit("")) for t in texts)), r"\s+", " "))


def extra_features(text: Column, page: Column, local: Column, relevance: Column) -> dict[str, Column]:
    """The 18 numbers beside a text's words: lengths, what it has, its page, place and relevance."""
    p, n = F.upper(F.coalesce(page, F.lit(""))), F.char_length(text)
    count = F.when(text == "", 0).otherwise(F.size(F.split(text, " ")))
    one = lambda c: F.when(c, 1.0).otherwise(0.0)
    out = {"char_len": n.cast("double"), "token_len": count.cast("double"), "avg_token_len": F.coalesce(n / F.nullif(count, F.lit(0)), F.lit(0.0))}
    out |= {name: one(F.rlike(text, F.lit(pattern))) for name, pattern in HAS.items()}
    out |= {f"is_{x.lower()}": one(p == x) for x in PAGES} | {"is_other": one(~p.isin(PAGES))}
    return out | {"italy_relevant": one(F.coalesce(local, F.lit(False))), "relevance_score": F.coalesce(relevance.cast("double"), F.lit(0.0))}


def signal_vectors(rows: DataFrame, extras: list[str], most: int = 20_000, least: float = 2.0, share: float = 0.95) -> PipelineModel:
    """Fits the vectors of rows(text, extras): TF-IDF of words and pairs, the ``most`` frequent ones that ``least`` texts and not more than ``share`` of
    them have, and the numbers of ``extras``; column ``vector``."""
    stages = [
        RegexTokenizer(inputCol="text", outputCol="words", pattern=r"[a-z0-9à-öø-ÿ']{2,}", gaps=False), NGram(n=2, inputCol="words", outputCol="pairs"),
        SQLTransformer(statement="SELECT *, concat(words, pairs) AS grams FROM __THIS__"), CountVectorizer(inputCol="grams", outputCol="tf", vocabSize=most, minDF=least, maxDF=share),
        IDF(inputCol="tf", outputCol="tfidf"), VectorAssembler(inputCols=["tfidf", *extras], outputCol="vector"),
    ]
    return Pipeline(stages=stages).fit(rows)


def smooth_vectors(rows: DataFrame, extras: list[str], most: int = 20_000, least: float = 2.0, share: float = 0.95) -> PipelineModel:
    """``signal_vectors`` with smoothed weights and unit length: a gram weighs its count times ln((1 + texts) / (1 + texts with it)) + 1, and a text's weights are
    divided by their length; the numbers of ``extras`` follow as they are. All stages are Spark's own, so the model can be saved, loaded and put into other pipelines."""
    grams = gram_counts(rows, most, least, share)
    return PipelineModel([*grams.stages, *smoothed(grams.transform(rows), extras)])


def gram_counts(rows: DataFrame, most: int, least: float = 2.0, share: float = 0.95) -> PipelineModel:
    """Fits the counts of rows(text)'s words and pairs; column ``tf``."""
    return Pipeline(stages=[
        RegexTokenizer(inputCol="text", outputCol="words", pattern=r"[a-z0-9à-öø-ÿ']{2,}", gaps=False), NGram(n=2, inputCol="words", outputCol="pairs"),
        SQLTransformer(statement="SELECT *, concat(words, pairs) AS grams FROM __THIS__"), CountVectorizer(inputCol="grams", outputCol="tf", vocabSize=most, minDF=least, maxDF=share),
    ]).fit(rows)


def smoothed(counted: DataFrame, extras: list[str]) -> list:
    """Fits what follows the counts of rows(tf, extras): smoothed weights, unit length, the numbers of ``extras`` behind them."""
    weights = IDF(inputCol="tf", outputCol="_").fit(counted).idf.toArray() + 1
    weighted = ElementwiseProduct(scalingVec=Vectors.dense(weights), inputCol="tf", outputCol="weighted")
    return [weighted, Normalizer(inputCol="weighted", outputCol="tfidf"), VectorAssembler(inputCols=["tfidf", *extras], outputCol="vector")]


def signal_model(rows: DataFrame, extras: list[str], most: int = 20_000, iterations: int = 20) -> PipelineModel:
    """Fits rows(text, keep, type, extras): whether a signal is kept (0 or 1, null: not known) and its type (null: not known), as one pipeline that can be saved and loaded."""
    rows = rows.where("text is not null")
    grams = gram_counts(rows, most)
    # Texts are read twice, for the vocabulary and for these counts; the weights and both fits read the counts.
    counted = grams.transform(rows).select("keep", "type", "tf", *extras).persist()
    ends = smoothed(counted, extras)
    seen = PipelineModel(ends).transform(counted).select("keep", "type", "vector")
    own = lambda name: dict(featuresCol="vector", predictionCol=f"{name}_prediction", probabilityCol=f"{name}_probability", rawPredictionCol=f"{name}_raw", weightCol="weight", maxIter=iterations, regParam=0.01)
    names = StringIndexer(inputCol="type", outputCol="label", stringOrderType="alphabetAsc").fit(seen.where("type is not null"))
    keep = LogisticRegression(**own("keep"), family="binomial").fit(balanced(seen.where("keep is not null").withColumn("label", F.col("keep").cast("double"))))
    kind = LogisticRegression(**own("type"), family="multinomial").fit(balanced(names.transform(seen.where("type is not null"))))
    counted.unpersist()
    return PipelineModel([*grams.stages, *ends, keep, kind, IndexToString(inputCol="type_prediction", outputCol="type_label", labels=names.labels)])


def classified(model: PipelineModel, rows: DataFrame, keep_threshold: float = 0.8, type_threshold: float = 0.6) -> DataFrame:
    """The rows with what a fitted or loaded ``signal_model`` says: keep, keep_prob, keep_confidence, keep_confident, type_label, type_prob, type_confident, confidence. A null text is read as an empty one."""
    said = model.transform(rows.withColumn("text", F.coalesce("text", F.lit(""))))
    p, q = F.get(vector_to_array("keep_probability"), 1), F.array_max(vector_to_array("type_probability"))
    sure = F.greatest(p, 1 - p)
    own = [c for c in rows.columns if c not in ("keep", "keep_prob", "keep_confidence", "keep_confident", "type_label", "type_prob", "type_confident", "confidence")]
    return said.select(
        *own, (p >= 0.5).alias("keep"), p.alias("keep_prob"), sure.alias("keep_confidence"), (sure >= keep_threshold).alias("keep_confident"), "type_label", q.alias("type_prob"),
        (q >= type_threshold).alias("type_confident"), F.least(sure, q).alias("confidence"),
    )
