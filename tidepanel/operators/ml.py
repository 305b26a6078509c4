"""Model training and scoring with Spark ML (ML1 to ML7)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.functions.windows import clip


def features_of(df: DataFrame) -> list[str]:
    return sorted(c for c in df.columns if c.endswith("_ranked"))


def train_direction(df: DataFrame, trees: int = 20, depth: int = 5, seed: int = 3) -> PipelineModel:
    """Three-class forest on the ranked features of a table with `label` (-1, 0, 1) and `weight`; gaps count as 0.5."""
    names = features_of(df)
    x = df.fillna(0.5, names).withColumn("_y", F.col("label") + 1.0)
    forest = RandomForestClassifier(featuresCol="features", labelCol="_y", weightCol="weight", numTrees=trees, maxDepth=depth, seed=seed, probabilityCol="class_p", rawPredictionCol="class_raw", predictionCol="class")
    return Pipeline(stages=[VectorAssembler(inputCols=names, outputCol="features"), forest]).fit(x)


def train_meta(df: DataFrame, direction: PipelineModel, trees: int = 20, depth: int = 4, seed: int = 4) -> PipelineModel:
    """Was the direction model right? A binary forest with classes weighted equally."""
    x = direction.transform(df.fillna(0.5, features_of(df))).withColumn("_right", (F.col("class") == F.col("label") + 1).cast("double"))
    share = x.agg(F.avg("_right").alias("r"))
    x = x.join(F.broadcast(share)).withColumn("_w", F.col("weight") * F.when(F.col("_right") == 1, 0.5 / F.greatest("r", F.lit(1e-6))).otherwise(0.5 / F.greatest(1 - F.col("r"), F.lit(1e-6))))
    forest = RandomForestClassifier(featuresCol="features", labelCol="_right", weightCol="_w", numTrees=trees, maxDepth=depth, seed=seed, probabilityCol="meta_p", rawPredictionCol="meta_raw", predictionCol="meta")
    return Pipeline(stages=[forest]).fit(x)


def calibrate(df: DataFrame, score: str, label: str):
    """Logistic curve over a score, to be fitted on rows that the score has not been trained on."""
    line = VectorAssembler(inputCols=[score], outputCol="_s")
    return Pipeline(stages=[line, LogisticRegression(featuresCol="_s", labelCol=label, probabilityCol="calibrated_p", rawPredictionCol="calibrated_raw", predictionCol="calibrated")]).fit(df)


def rescale_probability(df: DataFrame, column: str, low: float = 0.15, high: float = 0.85) -> DataFrame:
    """Linear map of a column's range onto [low, high]; the middle where it does not vary."""
    ends = df.agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))
    x = df.join(F.broadcast(ends))
    width = F.col("_hi") - F.col("_lo")
    return x.withColumn("p_success", F.when(width > 1e-12, low + (F.col(column) - F.col("_lo")) / width * (high - low)).otherwise((low + high) / 2)).drop("_lo", "_hi")


def score_panel(df: DataFrame, direction: PipelineModel, meta: PipelineModel) -> DataFrame:
    """p_bear, p_neutral, p_bull, raw and rescaled success probability for every row."""
    x = meta.transform(direction.transform(df.fillna(0.5, features_of(df))))
    p = vector_to_array("class_p")
    x = x.withColumns({"p_bear": p[0], "p_neutral": p[1], "p_bull": p[2], "p_raw": vector_to_array("meta_p")[1], "predicted": F.col("class").cast("int") - 1})
    return x.withColumn("p_success", clip(0.15 + (F.col("p_raw") - 0.28) / (0.81 - 0.28 + 1e-5) * 0.70, 0, 1)).drop("features", "class", "class_p", "class_raw", "meta", "meta_p", "meta_raw")


def champion_challenger(df: DataFrame, models: dict[str, PipelineModel]) -> DataFrame:
    """Held-out accuracy of each model and which one is kept (ties: the first name); df is scored by all in one pass."""
    x = df.fillna(0.5, features_of(df))
    for name, model in models.items():
        scored = model.transform(x)
        x = scored.withColumn(f"_ok_{name}", (F.col("class") == F.col("label") + 1).cast("double")).select(*x.columns, f"_ok_{name}")
    row = x.agg(*[F.avg(f"_ok_{n}").alias(n) for n in models])
    out = row.unpivot([], list(models), "model", "accuracy")
    best = out.agg(F.min(F.struct((-F.col("accuracy")).alias("less"), "model"))["model"].alias("kept"))
    return out.join(F.broadcast(best)).withColumn("kept", F.col("model") == F.col("kept"))


def per_asset_model(df: DataFrame, features: list[str], target: str, key: str = "symbol", ridge: float = 1e-3) -> DataFrame:
    """Ridge coefficients of each asset: its normal equations are sums of products, solved per asset from those sums.

    Rows with a null in a feature or the target do not count.
    """
    cols = [F.lit(1.0), *[F.col(f) for f in features]]
    k = len(cols)
    sums = [F.sum(cols[i] * cols[j]).alias(f"x{i}_{j}") for i in range(k) for j in range(i, k)] + [F.sum(cols[i] * F.col(target)).alias(f"y{i}") for i in range(k)]
    normal = df.dropna(subset=[*features, target]).groupBy(key).agg(F.count("*").alias("n"), *sums)

    def solve(batches):
        for rows in batches:
            a, b = np.zeros((len(rows), k, k)), np.stack([rows[f"y{i}"] for i in range(k)], 1)
            for i in range(k):
                for j in range(i, k):
                    a[:, i, j] = a[:, j, i] = rows[f"x{i}_{j}"]
            w = np.linalg.solve(a + ridge * np.eye(k), b[:, :, None])[:, :, 0] if len(rows) else np.zeros((0, k))
            yield pd.DataFrame({key: rows[key], "n": rows["n"], "intercept": w[:, 0], **{f"w_{f}": w[:, i + 1] for i, f in enumerate(features)}})

    return normal.mapInPandas(solve, f"{key} {dict(df.dtypes)[key]}, n long, intercept double, " + ", ".join(f"w_{f} double" for f in features))
