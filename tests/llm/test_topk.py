import numpy as np
from pyspark.sql import functions as F

from loomgrid.llm import topk

SCHEMA = "id long, v array<double>, vector string, score long, rank int"


def brute(rows, k, every):
    ints = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            ints.setdefault(i, []).append([int(np.floor(256 * x)) for x in v])
    out = []
    for q in sorted(i for i in ints if i % every == 0):
        own = min(ints[q])
        scored = sorted((-sum(a * b for a, b in zip(own, v)), i) for i, vs in ints.items() if i != q for v in vs)
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return out


def run(spark, rows, k=5, every=5):
    df = spark.createDataFrame([(i, v, "x", 1, 2) for i, v in rows], SCHEMA).repartition(4)
    vectors = df.select("id", topk.quantised(F.col("v")).alias("vector"))
    return sorted(tuple(r) for r in topk.exact_top_k(vectors, vectors.where(f"id % {every} = 0"), k).collect())


def test_equals_brute_force(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(0, 0.2, 64).tolist()) for i in range(300)]
    rows += [(400 + i, rows[3][1]) for i in range(20)]  # ties
    rows += [(3, rows[3][1]), (10, rows[11][1])]  # repeated identifiers
    rows += [(500, None), (505, []), (510, [0.1] * 63 + [None]), (515, [float("nan")] * 64), (520, [float("inf")] * 64), (None, rows[1][1]), (525, [0.5, -0.5]), (530, [0.0] * 64)]
    assert run(spark, rows) == brute(rows, 5, 5)


def test_few_candidates_blocks_and_large_components(spark, monkeypatch):
    rows = [(0, [1.0, 2.0]), (5, [-1.0, 0.5])]
    assert run(spark, rows) == brute(rows, 5, 5)
    big = [(i, [4e5 * (i + 1), -3e5 * i, 0.25]) for i in range(12)]
    assert [r[:3] for r in run(spark, big)] == [r[:3] for r in brute(big, 5, 5)]
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(0, 1, 20).tolist()) for i in range(120)]
    monkeypatch.setattr(topk, "QUERY_BYTES", 7 * 20 * 8)
    monkeypatch.setattr(topk, "CHUNK", 16)
    assert run(spark, rows, 3, 2) == brute(rows, 3, 2)


def test_empty(spark):
    assert run(spark, []) == []
