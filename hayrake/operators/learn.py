"""MLlib's pointwise ranker, soft targets and class masks; listwise rankers are in ``boost``, class models in ``classes`` and ``neural``.

Encoders and cross-encoders are not built here: their vectors and scores come in as columns.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def fit_ranker(sample: DataFrame, features: list[str], label: str = "y", weight: str | None = "weight", trees: int = 20, depth: int = 4, seed: int = 7) -> PipelineModel:
    assembler = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep")
    booster = GBTClassifier(labelCol=label, featuresCol="features", maxIter=trees, maxDepth=depth, stepSize=0.1, seed=seed)
    if weight:
        booster = booster.setWeightCol(weight)
    return PipelineModel([assembler, booster.fit(assembler.transform(sample))])


def score(model: PipelineModel, rows: DataFrame) -> DataFrame:
    return model.transform(rows).withColumn("score", vector_to_array("probability")[1])


def soft_targets(pairs: DataFrame, key: str, label: str) -> DataFrame:
    """(key, label, n, share, weight): labels of a text with their shares and evidence weights."""
    n = pairs.groupBy(key, label).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(key))
    return n.select(key, label, "n", (F.col("n") / total).alias("share"), (F.col("n") / total * F.least(F.sqrt(total), F.lit(16.0))).alias("weight"))


def masked(probabilities: DataFrame, key: str, supported: DataFrame, label: str) -> DataFrame:
    """Unsupported classes at zero, the others scaled to a sum of one."""
    marked = probabilities.join(supported.select(label).distinct().withColumn("ok", F.lit(1)), label, "left")
    p = F.when(F.col("ok") == 1, F.col("p")).otherwise(0.0)
    total = F.sum(p).over(Window.partitionBy(key))
    return marked.withColumn("p", F.when(total > 0, p / total).otherwise(0.0)).drop("ok")
