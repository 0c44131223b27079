"""Pruned retrieval against scoring all pairs."""

import random

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions import retrieval, text


def corpus(seed, docs=400, queries=12):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(300)]
    weights = [1 / (k + 1) for k in range(300)]
    rows = [(k, " ".join(rng.choices(words, weights, k=rng.choice([3, 10, 40, 200])))) for k in range(docs)]
    asked = []
    for q in range(queries):
        passage = rng.choice(rows)[1].split()[:8] + rng.choices(words[50:], k=3)
        asked += [(q, w, passage.count(w)) for w in set(passage)]
        rows += [(len(rows), " ".join(passage + rng.choices(words, weights, k=5))) for _ in range(3)]
    return rows, asked


def both(spark, rows, asked, k):
    index = text.postings(spark.createDataFrame(rows, "doc_id long, body string").repartition(3), "doc_id", F.split("body", " ")).cache()
    query = spark.createDataFrame(asked, "item_id long, token string, qf long")
    impact = retrieval.impacts(index, "doc_id", text.K1, text.B).cache()
    n = index.select("doc_id").distinct().count()
    df = index.groupBy("token").agg(F.count("*").alias("df"))
    weights = query.join(df, "token").select("item_id", "token", (F.col("qf") * text.idf(F.lit(n), F.col("df"))).alias("weight"))
    found = retrieval.top_k(impact, retrieval.maxima(impact), weights, "doc_id", "item_id", k)
    scored = text.bm25(index, "doc_id", query, "item_id")
    order = W.partitionBy("item_id").orderBy(F.desc(F.round("score", 6)), "doc_id")
    want = scored.withColumn("k", F.row_number().over(order)).where(F.col("k") <= k)
    plain = lambda df: sorted((r["item_id"], r["doc_id"], round(r["score"], 5)) for r in df.collect())
    return found, plain(found.best), plain(want), scored.count()


def test_best_equal_full_scoring_with_fewer_pairs(spark):
    for seed in range(2):
        found, got, want, pairs = both(spark, *corpus(seed), 3)
        assert got == want
        counts = found.counts()
        assert counts["scored"] <= counts["candidates"] < pairs
        print(seed, pairs, counts)


def test_fewer_documents_than_asked_for(spark):
    rows = [(k, "a b" if k % 2 else "a c") for k in range(5)]
    found, got, want, _ = both(spark, rows, [(1, "a", 1), (1, "c", 2), (2, "nowhere", 1)], 9)
    assert got == want and {r[0] for r in got} == {1} and len(got) == 5


def test_ties_go_to_the_smaller_key(spark):
    rows = [(k, "x y z") for k in range(40)] + [(100 + k, "x q") for k in range(40)]
    _, got, want, _ = both(spark, rows, [(1, "x", 1), (1, "y", 1)], 4)
    assert got == want and [r[1] for r in got] == [0, 1, 2, 3]


def test_rows_of_query_token_and_block_are_neither_moved_nor_written(spark, monkeypatch):
    """Maxima meet the queries in the task that holds their block; what is written has no row for each of them."""
    written = {}
    keep = retrieval.materialise
    monkeypatch.setattr(retrieval, "materialise", lambda df, name: written.setdefault(name, keep(df, name)))
    found, got, want, pairs = both(spark, *corpus(5), 3)
    assert got == want
    assert not {"asked-blocks", "split-tokens"} & set(written)
    assert all({"token", "block"} - set(df.columns) for df in written.values())


def test_many_queries_are_joined_without_a_broadcast(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "MOST_SENT", 0)
    _, got, want, _ = both(spark, *corpus(7, docs=150, queries=5), 3)
    assert got == want
