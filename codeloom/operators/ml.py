"""Difficulty model: synthetic training rows, boosted trees of one class against the rest, and the arithmetic around a prediction."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, OneVsRest
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions import text as X
from codeloom.operators.metrics import dimension_scores

#: Features in order, each with the range it is clamped to.
FEATURES = {
    "total_loc": (0, 50_000), "file_count": (0, 500), "avg_cc": (0, 30), "max_cc": (0, 80), "total_funcs": (0, 600), "folder_depth": (0, 12), "dep_chain_length": (0, 15), "circular_dep_count": (0, 25),
    "route_count": (0, 400), "async_count": (0, 800), "class_count": (0, 200), "error_handler_count": (0, 300), "maintainability": (0, 100), "comment_percent": (0, 50),
}
#: Levels with colour, hours to learn (least, most) and years of experience.
LEVELS = (("Beginner", "#22c55e", 2.0, 8.0, "< 1 year"), ("Intermediate", "#3b82f6", 8.0, 40.0, "1-3 years"), ("Advanced", "#f59e0b", 40.0, 160.0, "3-6 years"), ("Expert", "#ef4444", 160.0, 500.0, "6+ years"))
#: Rows of each class in the training set, and each feature's least and most in the four classes, with decimal places.
ROWS = (300, 300, 300, 200)
CLASS_RANGES = {
    "total_loc": ((10, 150), (100, 1000), (600, 15000), (8000, 50000), 0),
    "file_count": ((1, 12), (8, 40), (25, 250), (100, 500), 0),
    "avg_cc": ((1.0, 4.5), (3.0, 9.0), (7.0, 20.0), (12.0, 30.0), 2),
    "max_cc": ((2, 9), (7, 24), (18, 60), (35, 80), 0),
    "total_funcs": ((2, 15), (12, 60), (50, 300), (200, 600), 0),
    "folder_depth": ((1, 3), (2, 6), (4, 9), (7, 12), 0),
    "dep_chain_length": ((1, 3), (2, 6), (4, 10), (7, 15), 0),
    "circular_dep_count": ((0, 1), (0, 4), (0, 10), (2, 25), 0),
    "route_count": ((0, 6), (5, 40), (30, 200), (150, 400), 0),
    "async_count": ((0, 12), (10, 60), (50, 300), (200, 800), 0),
    "class_count": ((0, 3), (2, 15), (10, 60), (40, 200), 0),
    "error_handler_count": ((2, 20), (15, 80), (60, 250), (200, 300), 0),
    "maintainability": ((75, 100), (45, 80), (20, 55), (8, 40), 1),
    "comment_percent": ((2, 25), (5, 30), (4, 35), (2, 30), 1),
}


def training_set(spark: SparkSession, rows: tuple[int, ...] = ROWS, seed: int = 42) -> DataFrame:
    """Rows drawn evenly from the range of each feature in their class: whole numbers with both ends, others rounded to the feature's places."""
    edges = [sum(rows[:k + 1]) for k in range(len(rows))]
    label = F.lit(len(rows) - 1)
    for k in reversed(range(len(rows) - 1)):
        label = F.when(F.col("id") < edges[k], k).otherwise(label)
    base = spark.range(0, sum(rows), 1, 1).withColumn("label", label.cast("double"))
    of_class = lambda xs: F.element_at(F.array(*[F.lit(float(x)) for x in xs]), F.col("label").cast("int") + 1)
    for j, name in enumerate(FEATURES):
        *ends, places = CLASS_RANGES[name]
        low, high = of_class([a for a, _ in ends]), of_class([b for _, b in ends])
        draw = F.rand(seed + 97 * j)
        base = base.withColumn(name, F.round(low + (high - low) * draw, places) if places else low + F.floor((high - low + 1) * draw).cast("double"))
    return base.drop("id")


def features(metrics: DataFrame, mi_zero_is_100: bool = True) -> DataFrame:
    """Missing features are 0, a missing maintainability is 100, and so is one of 0 unless told otherwise."""
    have = set(metrics.columns)
    cols = {name: F.coalesce(F.col(name).cast("double"), F.lit(100.0 if name == "maintainability" else 0.0)) if name in have else F.lit(100.0 if name == "maintainability" else 0.0) for name in FEATURES}
    out = metrics.withColumns(cols)
    return out.withColumn("maintainability", F.when(F.col("maintainability") == 0, 100.0).otherwise(F.col("maintainability"))) if mi_zero_is_100 else out


def scaled(metrics: DataFrame) -> DataFrame:
    return metrics.withColumns({f"{n}_s": X.min_max(n, float(a), float(b)) for n, (a, b) in FEATURES.items()})


def train(rows: DataFrame, trees: int = 15, depth: int = 4, seed: int = 42) -> tuple[PipelineModel, dict[str, float]]:
    """(model, accuracy on both parts of an 80/20 split, importance of each feature): boosted trees tell each class from the rest."""
    fit, held = (x.cache() for x in scaled(rows).randomSplit([0.8, 0.2], seed))
    boosted = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.3, subsamplingRate=0.85, seed=seed)
    stages = [VectorAssembler(inputCols=[f"{n}_s" for n in FEATURES], outputCol="features"), OneVsRest(classifier=boosted, labelCol="label", parallelism=len(LEVELS))]
    model = Pipeline(stages=stages).fit(fit)
    score = MulticlassClassificationEvaluator(labelCol="label", metricName="accuracy")
    found = {"train_accuracy": score.evaluate(model.transform(fit)), "test_accuracy": score.evaluate(model.transform(held))}
    for part in (fit, held):
        part.unpersist()
    each = [m.featureImportances.toArray() for m in model.stages[-1].models]
    return model, found | {f"importance_{n}": float(sum(v[k] for v in each) / len(each)) for k, n in enumerate(FEATURES)}


def probabilities(raw: str = "rawPrediction") -> Column:
    """Chances of the classes out of their margins: each one's own by the logistic link of boosted trees, then scaled to a sum of one."""
    own = F.transform(vector_to_array(raw), lambda m: 1.0 / (1.0 + F.exp(-2.0 * m)))
    return F.transform(own, lambda x: x / F.aggregate(own, F.lit(0.0), lambda a, b: a + b))


def per_class(predicted: DataFrame) -> DataFrame:
    """precision, recall and support of each label."""
    hit = F.count_if(F.col("label") == F.col("prediction"))
    r = predicted.groupBy("label").agg(F.count("*").alias("support"), hit.alias("h"))
    p = predicted.groupBy(F.col("prediction").alias("label")).agg(F.count("*").alias("n_predicted"))
    return r.join(p, "label", "left").select("label", "support", (F.col("h") / F.col("support")).alias("recall"), (F.col("h") / F.col("n_predicted")).alias("precision"))


def difficulty(metrics: DataFrame, level: str = "level_no", confidence: str = "confidence") -> DataFrame:
    """Adds score, level, colour, hours and experience to rows with a class and its confidence."""
    pick = lambda k: F.element_at(F.array(*[F.lit(x[k]) for x in LEVELS]), (F.col(level) + 1).cast("int"))
    load = (F.least(F.lit(1.0), F.col("total_loc") / 10_000.0) + F.least(F.lit(1.0), F.col("avg_cc") / 15.0)) / 2.0
    return metrics.withColumns({
        "score": F.bround(X.clamp((F.col(level) + 1) * 2.5 + 1.5 * F.col(confidence), F.lit(1.0), F.lit(10.0)), 1), "level": pick(0), "color": pick(1),
        "learning_hours": F.bround(pick(2) + (pick(3) - pick(2)) * load, 0), "experience": pick(4)})


def predict(metrics: DataFrame, model: PipelineModel) -> DataFrame:
    """Rows of metrics with level, confidence, probabilities, score, hours and the five dimension scores."""
    got = model.transform(scaled(features(metrics))).withColumn("probabilities", probabilities()).withColumn("level_no", F.col("prediction").cast("int"))
    got = got.withColumn("confidence", F.bround(F.array_max("probabilities"), 3)).drop("features", "rawPrediction", "prediction", *[f"{n}_s" for n in FEATURES])
    return dimension_scores(difficulty(got))
