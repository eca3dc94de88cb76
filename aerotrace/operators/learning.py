"""Models on Spark ML: boosted trees for delays, a linear autoencoder for track anomalies."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import PCA, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerotrace.operators.network import NODE_FEATURES
from aerotrace.operators.schedule import ETA_FEATURES, ETA_TARGET
from aerotrace.operators.tracks import KEY

CATEGORICAL = ("carrier", "origin", "dest")
MIN_ROWS = 50
TASK_ROWS = 100_000  # rows of a model's input that one task holds
EMBEDDING_DIM = 64


def spread(rows: DataFrame, n: int) -> DataFrame:
    """``n`` rows dealt evenly to tasks: a fold may lie in a single file, and small files hold many rows."""
    tasks = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(max(tasks if n > MIN_ROWS * tasks else 1, -(-n // TASK_ROWS)))


def fit_eta(
    train: DataFrame, val: DataFrame, max_iter: int = 50, step: float = 0.1
) -> PipelineModel:
    """Boosted trees on the arrival-delay features: absolute loss, stopped on the validation fold.

    The number of bins follows from the largest category, so any number of airports fits.
    """
    data = train.withColumn("_is_val", F.lit(False)).unionByName(
        val.withColumn("_is_val", F.lit(True))
    )
    numeric = [c for c in ETA_FEATURES if c not in CATEGORICAL]
    indexer = StringIndexer(
        inputCols=list(CATEGORICAL),
        outputCols=[f"{c}_ix" for c in CATEGORICAL],
        handleInvalid="keep",
    ).fit(data)
    max_bins = max(32, *(len(labels) + 1 for labels in indexer.labelsArray))
    stages = [
        indexer,
        VectorAssembler(
            inputCols=[*numeric, *[f"{c}_ix" for c in CATEGORICAL]], outputCol="features"
        ),
        GBTRegressor(
            labelCol=ETA_TARGET,
            lossType="absolute",
            validationIndicatorCol="_is_val",
            maxIter=max_iter,
            maxBins=max_bins,
            maxDepth=5,
            stepSize=step,
            seed=42,
        ),
    ]
    return Pipeline(stages=stages).fit(spread(data, data.count()))


def network_table(long: DataFrame) -> DataFrame:
    """Feature vector per (airport, bucket, horizon) row of a long target table."""
    skip = ("airport", "bucket", "horizon", "y", "fold")
    cols = [c for c in long.columns if c not in skip]
    return VectorAssembler(inputCols=cols, outputCol="features").transform(long)


def fit_network(
    train: DataFrame, horizons: tuple[int, ...], max_iter: int = 20
) -> dict[int, GBTRegressionModel]:
    """One model per horizon on local features, neighbour delay and diffused features.

    A horizon with fewer than 50 rows is skipped.
    """
    table = network_table(train)
    rows = {r["horizon"]: r["count"] for r in table.groupBy("horizon").count().collect()}
    model = GBTRegressor(labelCol="y", lossType="absolute", maxIter=max_iter, seed=42)
    return {
        h: model.fit(spread(table.where(F.col("horizon") == h), rows[h]))
        for h in horizons
        if rows.get(h, 0) >= MIN_ROWS
    }


def predict_network(models: dict[int, GBTRegressionModel], test: DataFrame) -> DataFrame:
    """Predictions of every horizon that has a model, as one long table."""
    table, out = network_table(test), None
    for h, model in models.items():
        part = model.transform(table.where(F.col("horizon") == h)).select(
            "airport", "bucket", "horizon", "y", F.col("prediction").alias("pred")
        )
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no horizon has enough rows")
    return out


def track_vectors(samples: DataFrame) -> DataFrame:
    """One vector per segment from its resampled points (a fixed number per segment)."""
    chans = ["east_m", "north_m", "alt_ft", "gs_kt"]
    flat = F.flatten(
        F.transform(
            F.sort_array(F.collect_list(F.struct("k", F.array(*chans).alias("v")))),
            lambda x: x["v"],
        )
    )
    return samples.groupBy(KEY, "segment_start").agg(array_to_vector(flat).alias("raw"))


def track_anomaly_score(
    train: DataFrame, test: DataFrame, k: int = EMBEDDING_DIM
) -> DataFrame:
    """Reconstruction error of test segments under a linear autoencoder fitted on ``train``.

    Standardise each coordinate, keep ``k`` principal components, measure what is lost.
    """
    scaler = StandardScaler(inputCol="raw", outputCol="z", withMean=True, withStd=True)
    model = Pipeline(stages=[scaler, PCA(k=k, inputCol="z", outputCol="code")]).fit(train)
    components = model.stages[1].pc.toArray()

    @F.pandas_udf("double")
    def lost(z: pd.Series, code: pd.Series) -> pd.Series:
        seen, kept = np.stack(z.to_numpy()), np.stack(code.to_numpy())
        return pd.Series(np.abs(seen - kept @ components.T).mean(axis=1))

    return model.transform(test).select(
        KEY, "segment_start", lost(vector_to_array("z"), vector_to_array("code")).alias("score")
    )
