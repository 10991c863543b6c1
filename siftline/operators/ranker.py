"""Rankers on pair features: gradient-boosted trees from Spark's library, averaged over seeds."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline import staging
from siftline.functions import math as M
from siftline.operators.retrieval import top_k

#: Training pairs a task: a round's jobs cost more than this many rows do.
TASK_ROWS = 200_000


def fit(pairs: DataFrame, features: list[str], seeds: list[int], rounds: int = 200, depth: int = 5, fraction: float = 0.9, step: float = 0.1) -> list[PipelineModel]:
    """One model a seed; ``pairs`` has label and weight. Missing values count as -999.

    Each round takes a dozen small jobs, so the pairs are written once, in as few partitions as their rows need, and the
    seeds are fitted side by side."""
    spark = pairs.sparkSession
    written = staging.stage(_filled(pairs, features).select(*features, F.col("label").cast("double").alias("label"), F.col("weight").cast("double").alias("weight")), "ranker-pairs")
    parts = -(-max(1, written.count()) // TASK_ROWS)
    rows = written.repartitionByRange(parts, *features, "label", "weight").sortWithinPartitions(*features, "label", "weight") if parts > 1 else written.coalesce(1).sortWithinPartitions(*features, "label", "weight")
    rows = VectorAssembler(inputCols=features, outputCol="features").transform(rows).select("features", "label", "weight").persist(StorageLevel.MEMORY_AND_DISK)
    rows.count()
    assembler = VectorAssembler(inputCols=features, outputCol="features")

    @inheritable_thread_target(spark)
    def one(seed: int) -> PipelineModel:
        trees = GBTClassifier(labelCol="label", featuresCol="features", weightCol="weight", maxIter=rounds, maxDepth=depth, subsamplingRate=fraction, stepSize=step, maxBins=127, seed=seed)
        return PipelineModel([assembler, trees.fit(rows)])

    with ThreadPoolExecutor(max(1, len(seeds))) as pool:
        models = list(pool.map(one, seeds))
    rows.unpersist()
    staging.drop(written)
    return models


def _filled(pairs: DataFrame, features: list[str]) -> DataFrame:
    return pairs.withColumns({f: M.not_a_number_to(F.col(f).cast("double"), -999.0) for f in features})


def predict(pairs: DataFrame, models: list[PipelineModel], features: list[str], k: int = 50) -> DataFrame:
    """query_id, item_id, score (the mean probability), rank of the k best."""
    out = _filled(pairs, features)
    for j, model in enumerate(models):
        out = model.transform(out).withColumn(f"_p{j}", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")
    mean = reduce(lambda a, b: a + b, [F.col(f"_p{j}") for j in range(len(models))]) / len(models)
    return top_k(out.select("query_id", "item_id", mean.alias("score")), k)


def importance(models: list[PipelineModel], features: list[str], top: int = 15) -> list[tuple[str, float]]:
    """The features of largest mean importance."""
    total = dict.fromkeys(features, 0.0)
    for model in models:
        for name, x in zip(features, model.stages[-1].featureImportances.toArray()):
            total[name] += float(x) / len(models)
    return sorted(total.items(), key=lambda x: (-x[1], x[0]))[:top]


def line_search(evaluate, start: dict[str, float], grid: dict[str, list[float]], least_gain: float = 1e-5, passes: int = 3) -> tuple[dict[str, float], float]:
    """Coordinate search: each setting in turn takes its best value, until a pass gains nothing. ``evaluate`` scores settings."""
    best, score = dict(start), evaluate(start)
    for _ in range(passes):
        before = score
        for name, values in grid.items():
            for v in values:
                if v != best[name] and (s := evaluate(best | {name: v})) > score + least_gain:
                    best, score = best | {name: v}, s
        if score <= before + least_gain:
            break
    return best, score
