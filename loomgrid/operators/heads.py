"""A classifier with several heads in numpy: one shared layer, a softmax for each head, candidates and confidences.

Trained on a bounded sample whose grey values are quantised to bytes; kept as one JSON artifact in any file system."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship

#: Rows of the training sample, at most; width of the shared layer; steps and rate of the training.
SAMPLE_ROWS, SHARED, STEPS, RATE = 20_000, 32, 300, 0.02


def quantised(values) -> F.Column:
    """Grey values in [-1, 1] as bytes."""
    return F.transform(values, lambda v: F.least(F.lit(255), F.greatest(F.lit(0), F.floor((v.cast("double") + 1) * 127.5 + 0.5))).cast("int"))


def training_sample(df: DataFrame, key: str, grey: str, heads: list[str]) -> DataFrame:
    """key, heads, gray (bytes as ints) of the rows with the smallest hashes: what a sample cache holds."""
    share = (F.xxhash64(key).cast("double") + 2.0**63) / 2.0**64
    least = min(1.0, 2 * SAMPLE_ROWS / max(1, df.count()))
    return df.where(share < least if least < 1 else F.lit(True)).orderBy(F.xxhash64(key), key).limit(SAMPLE_ROWS).select(key, *heads, quantised(F.col(grey)).alias("gray"))


class Heads:
    """Labels and weights of each head over a shared rectified layer."""

    def __init__(self, labels: dict[str, list], inputs: int, seed: int = 4) -> None:
        rng = np.random.default_rng(seed)
        self.labels = labels
        self.p = {"w": rng.normal(0, 1 / np.sqrt(inputs), (inputs, SHARED)), "b": np.zeros(SHARED)}
        self.p |= {f"o:{h}": rng.normal(0, 0.1, (SHARED, len(v))) for h, v in labels.items()} | {f"c:{h}": np.zeros(len(v)) for h, v in labels.items()}

    def probabilities(self, x: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        shared = np.maximum(x @ self.p["w"] + self.p["b"], 0)
        out = {}
        for h in self.labels:
            z = shared @ self.p[f"o:{h}"] + self.p[f"c:{h}"]
            z = np.exp(z - z.max(axis=1, keepdims=True))
            out[h] = z / z.sum(axis=1, keepdims=True)
        return shared, out

    def fit(self, x: np.ndarray, y: dict[str, np.ndarray]) -> Heads:
        """Adam on the sum of the heads' cross-entropies, all rows at once."""
        m, v = {k: np.zeros_like(a) for k, a in self.p.items()}, {k: np.zeros_like(a) for k, a in self.p.items()}
        for step in range(1, STEPS + 1):
            shared, out = self.probabilities(x)
            g, back = {}, np.zeros_like(shared)
            for h, p in out.items():
                p[np.arange(len(x)), y[h]] -= 1
                p /= len(x)
                g[f"o:{h}"], g[f"c:{h}"] = shared.T @ p, p.sum(axis=0)
                back += p @ self.p[f"o:{h}"].T
            back *= shared > 0
            g["w"], g["b"] = x.T @ back + 1e-3 * self.p["w"], back.sum(axis=0)
            for k, a in self.p.items():
                m[k] += 0.1 * (g[k] - m[k])
                v[k] += 0.001 * (g[k] * g[k] - v[k])
                a -= RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        return self


def scaled(gray: np.ndarray) -> np.ndarray:
    return gray / 127.5 - 1


def train_heads(sample: DataFrame, key: str, heads: list[str]) -> Heads:
    """A model of a training sample; the order of its rows does not matter."""
    rows = sample.toArrow().sort_by(key)
    x = scaled(np.array(rows.column("gray").to_pylist(), dtype=np.float64))
    labels = {h: sorted(set(rows.column(h).to_pylist())) for h in heads}
    return Heads(labels, x.shape[1]).fit(x, {h: np.array([labels[h].index(v) for v in rows.column(h).to_pylist()]) for h in heads})


def predict_heads(df: DataFrame, key: str, grey: str, model: Heads) -> DataFrame:
    """key, and for each head its label (as a string) and confidence."""
    ship(df.sparkSession)
    held = df.sparkSession.sparkContext.broadcast(model)
    schema = f"{key} long, " + ", ".join(f"`{h}` string, `{h}_confidence` double" for h in model.labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = scaled(batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1).astype(np.float64))
            columns, names = [batch.column(0).cast(pa.int64())], [key]
            for h, p in own.probabilities(x)[1].items():
                best = p.argmax(axis=1)
                columns += [pa.array([str(own.labels[h][i]) for i in best]), pa.array(p.max(axis=1))]
                names += [h, f"{h}_confidence"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return df.select(key, quantised(F.col(grey)).alias("gray")).mapInArrow(run, schema)


def save_heads(spark: SparkSession, model: Heads, path: str) -> None:
    """The model as one row of JSON."""
    text = json.dumps({"labels": model.labels, "weights": {k: v.tolist() for k, v in model.p.items()}})
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_heads(spark: SparkSession, path: str) -> Heads:
    found = json.loads(spark.read.text(path).first()["value"])
    model = Heads(found["labels"], len(found["weights"]["w"]))
    model.p = {k: np.array(v) for k, v in found["weights"].items()}
    return model
