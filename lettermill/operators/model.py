"""The convolutional scorer, and a trainable linear substitute."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LENGTH, FILTERS, WIDTHS, HIDDEN, CLASSES = 100, 128, (2, 3, 4, 5), 32, 2


def random_weights(vectors: np.ndarray, seed: int = 0) -> dict[str, np.ndarray]:
    """Weights of the right shapes for an embedding matrix; no trained ones are published."""
    rng = np.random.default_rng(seed)
    dim = vectors.shape[1]
    w = {"embedding": vectors.astype(np.float32)}
    for k in WIDTHS:
        w[f"conv{k}"] = (rng.standard_normal((k * dim, FILTERS)) / np.sqrt(k * dim)).astype(np.float32)
        w[f"bias{k}"] = np.zeros(FILTERS, np.float32)
    w["dense"] = (rng.standard_normal((FILTERS * len(WIDTHS), HIDDEN)) / np.sqrt(FILTERS * len(WIDTHS))).astype(np.float32)
    w["dense_bias"] = np.zeros(HIDDEN, np.float32)
    w["out"] = (rng.standard_normal((HIDDEN, CLASSES)) / np.sqrt(HIDDEN)).astype(np.float32)
    w["out_bias"] = np.zeros(CLASSES, np.float32)
    return w


def forward(ids: np.ndarray, w: dict[str, np.ndarray]) -> np.ndarray:
    """Outputs (records x 2) of encoded sequences (records x length): four convolutions, their maxima, two dense layers, sigmoid.

    Id 0 is a row of the matrix like any other; ids beyond the matrix read row 0.
    """
    vectors = w["embedding"][np.where((ids >= 0) & (ids < len(w["embedding"])), ids, 0)]
    pooled = []
    for k in WIDTHS:
        windows = np.concatenate([vectors[:, i : vectors.shape[1] - k + 1 + i] for i in range(k)], axis=2)
        pooled.append(np.maximum(windows @ w[f"conv{k}"] + w[f"bias{k}"], 0).max(1))
    hidden = np.maximum(np.concatenate(pooled, 1) @ w["dense"] + w["dense_bias"], 0)
    return 1 / (1 + np.exp(-(hidden @ w["out"] + w["out_bias"])))


def score(rows: DataFrame, ids_col: str, weights: dict[str, np.ndarray], batch: int = 64) -> DataFrame:
    """Adds score, the percentage of the spam output; 50 where it is no number from 0 to 100. Weights are broadcast once: they are a model, not data."""
    sent = rows.sparkSession.sparkContext.broadcast(weights)

    def run(batches):
        for rb in batches:
            lists = rb.column(ids_col).to_pylist()
            out = []
            for at in range(0, len(lists), batch):
                ids = np.zeros((len(lists[at : at + batch]), LENGTH), np.int64)
                for r, xs in enumerate(lists[at : at + batch]):
                    xs = [x or 0 for x in (xs or [])][:LENGTH]
                    ids[r, : len(xs)] = xs
                y = forward(ids, sent.value).astype(np.float64)
                with np.errstate(all="ignore"):
                    p = y[:, 0] * 100 / y.sum(1)
                out.append(np.where((p >= 0) & (p <= 100), p, 50.0))
            yield rb.append_column("score", pa.array(np.concatenate(out) if out else np.zeros(0)))

    schema = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes) + ", score double"
    return rows.mapInArrow(run, schema)


def train_linear(rows: DataFrame, tokens: str, label: str, buckets: int = 1 << 14, **params):
    """A logistic regression on hashed token counts: a distributed substitute for training the convolutional model."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import HashingTF

    stages = [HashingTF(inputCol=tokens, outputCol="_features", numFeatures=buckets), LogisticRegression(featuresCol="_features", labelCol=label, **({"maxIter": 20, "regParam": 0.01} | params))]
    return Pipeline(stages=stages).fit(rows.where(F.col(label).isNotNull() & F.col(tokens).isNotNull()))


def evaluate(scored: DataFrame, label: str, prediction: str = "prediction", probability: str = "probability") -> DataFrame:
    """One row (n, accuracy, loss): the share of right predictions and the mean cross entropy."""
    from pyspark.ml.functions import vector_to_array

    p = F.element_at(vector_to_array(probability), F.col(label).cast("int") + 1)
    return scored.where(F.col(label).isNotNull()).agg(F.count("*").alias("n"), F.avg((F.col(prediction) == F.col(label)).cast("int")).alias("accuracy"), F.avg(-F.ln(F.greatest(p, F.lit(1e-12)))).alias("loss"))


def result_line(score, label, position, total, text):
    """A line of the validation dump."""
    return F.format_string("%3d %%  [%d/%d]   %8.5f / %8.5f  %s", score.cast("int"), position, total, score / 100, label.cast("double"), text)


def save_weights(spark, weights: dict[str, np.ndarray], path: str) -> None:
    """Weights as a table (name, shape, values), which can be read without running anything that it holds."""
    rows = [(name, list(w.shape), [float(x) for x in w.ravel()]) for name, w in weights.items()]
    spark.createDataFrame(rows, "name string, shape array<int>, values array<float>").coalesce(1).write.mode("overwrite").parquet(path)


def load_weights(spark, path: str) -> dict[str, np.ndarray]:
    """The weights that save_weights wrote: a dozen rows."""
    return {r.name: np.array(r["values"], np.float32).reshape(r["shape"]) for r in spark.read.parquet(path).limit(1000).collect()}
