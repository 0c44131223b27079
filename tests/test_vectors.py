"""Inverted-file search against comparing all vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions import vectors


def exact(x, ids, asked, n):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for a in asked:
        s = np.maximum(0, u @ u[a])
        out[ids[a]] = [ids[k] for k in sorted(range(len(x)), key=lambda k: (-round(float(s[k]), 9), ids[k]))[:n]]
    return out


def recall(got, want):
    mine = {}
    for r in got:
        mine.setdefault(r["query_id"], set()).add(r["vec_id"])
    return sum(len(mine.get(q, set()) & set(w)) for q, w in want.items()) / sum(map(len, want.values()))


def run(spark, rows, asked, **more):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3).cache()
    q = vectors.fit(df, "vec_id", "embedding", more.pop("lists", None))
    indexed = vectors.index(df, "vec_id", "embedding", q).cache()
    queries = df.where(F.col("vec_id").isin(asked)).select(F.col("vec_id").alias("query_id"), "embedding")
    return indexed, vectors.search(indexed, df, queries, "vec_id", "embedding", "query_id", q, **more).collect()


def test_recall_and_exact_scores(spark):
    rng = np.random.default_rng(1)
    middles = rng.normal(size=(12, 32))
    x = (middles[rng.integers(0, 12, 3000)] + 0.6 * rng.normal(size=(3000, 32))).astype(np.float32)
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(9001, None), (9002, []), (9003, [0.0] * 32), (9004, [1.0] * 31), (9005, [float("nan")] * 32)]
    asked = list(range(0, 3000, 100))
    indexed, got = run(spark, rows, asked)
    assert indexed.count() == 3000 and indexed.select("list").distinct().count() > 20
    want = exact(x.astype(np.float64), list(range(3000)), asked, 10)
    assert recall(got, want) >= 0.9
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for r in got[:50]:
        assert r["score"] == pytest.approx(max(0, float(u[r["query_id"]] @ u[r["vec_id"]])), abs=1e-5)
    _, every = run(spark, rows, asked, probes=10**6)
    assert recall(every, want) > 0.999


def test_one_very_common_vector_is_dealt_over_slices(spark, monkeypatch):
    monkeypatch.setattr(vectors, "SLICE", 100)
    rng = np.random.default_rng(2)
    x = np.concatenate((np.tile([1.0, 0.5, 0.0, 0.2], (500, 1)), rng.normal(size=(700, 4)))).astype(np.float32)
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    _, got = run(spark, rows, [3, 600], lists=4, n=5, probes=4)
    assert [r["vec_id"] for r in sorted(got, key=lambda r: r["vec_id"]) if r["query_id"] == 3] and all(r["score"] > 0.999 for r in got if r["query_id"] == 3)
    assert recall([r for r in got if r["query_id"] == 600], exact(x.astype(np.float64), list(range(1200)), [600], 5)) == 1


def test_no_vectors(spark):
    df = spark.createDataFrame([(1, None), (2, [])], "vec_id long, embedding array<float>")
    assert vectors.fit(df, "vec_id", "embedding") is None


def test_recall_of_the_registered_query(spark):
    from lodestone.plans import registry

    sf = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids = [r["vec_id"] for r in rows]
    asked = [k for k, i in enumerate(ids) if i % 100 == 0]
    want = exact(np.array([r["embedding"] for r in rows], np.float64), ids, asked, 10)
    got = registry.queries()["q18_vector_index"](spark, sf).collect()
    found = [{"query_id": 100 * r["item_id"], "vec_id": r["doc_id"]} for r in got]
    share = recall(found, want)
    print("recall at 10:", share)
    assert share >= 0.9 and len(got) == 10 * len(asked)
