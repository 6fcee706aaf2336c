import numpy as np
from pyspark.sql import functions as F

from pluvia.llm import topk as K


def brute(rows, asks, k=5):
    own = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            own[i] = [int(np.floor(256 * float(np.float32(x)))) for x in v]
    out = []
    for q, v in own.items():
        if asks(q):
            scores = [(-sum(a * b for a, b in zip(v, w)), i) for i, w in own.items() if i != q]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k])]
    return sorted(out)


def test_equals_brute_force(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    got = K.top_k(df, F.col("vec_id") % 50 == 0, shard_rows=17, block_rows=2)
    assert sorted(map(tuple, got.collect())) == brute(rows, lambda q: q % 50 == 0)


def test_ties_and_odd_vectors(spark, rng):
    rows = [(i, rng.normal(size=4).round(1).tolist()) for i in range(60)]
    rows += [(i, [0.5, 0.5, 0.5, 0.5]) for i in range(100, 160)]
    rows += [(200, None), (201, [1.0, None, 0.0, 0.0]), (202, [float("nan")] * 4), (203, [float("inf"), 0.0, 0.0, 0.0])]
    rows += [(None, [1.0] * 4), (204, [2.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    df = df.unionByName(df.where("vec_id = 7")).withColumn("score", F.lit(1)).withColumn("v", F.lit("x"))
    for shard_rows in (4, 1000):
        got = K.top_k(df, F.col("vec_id") % 10 == 0, shard_rows=shard_rows, block_rows=3)
        assert sorted(map(tuple, got.collect())) == brute(rows, lambda q: q % 10 == 0)
    assert K.top_k(df.limit(0), F.col("vec_id") % 10 == 0).count() == 0
    assert K.top_k(df.where("vec_id = 10"), F.col("vec_id") % 10 == 0).count() == 0
    few = K.top_k(df.where("vec_id in (10, 11)"), F.col("vec_id") % 10 == 0).collect()
    assert [(r.query_id, r["rank"], r.vec_id) for r in few] == [(10, 1, 11)]
