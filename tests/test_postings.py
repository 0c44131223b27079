"""Signed deltas against a rebuild."""

import random

from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.session import scratch_path
from lodestone.streaming.postings import PostingStore

SCHEMA = "doc_id long, body string"


def tokens():
    return F.filter(F.split("body", " "), lambda w: w != "")


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def same(spark, store, docs):
    fresh = PostingStore(spark, scratch_path(spark, "fresh"))
    fresh.rebuild(spark.createDataFrame(sorted(docs.items()), SCHEMA), tokens())
    assert rows(store.postings(), "doc_id", "token", "tf") == rows(fresh.postings(), "doc_id", "token", "tf")
    assert rows(store.frequencies(), "token", "df", "tf") == rows(fresh.frequencies(), "token", "df", "tf")
    plain = T.postings(spark.createDataFrame(sorted(docs.items()), SCHEMA), "doc_id", tokens())
    assert rows(store.frequencies(), "token", "df", "tf") == rows(plain.groupBy("token").agg(F.count("*").alias("df"), F.sum("tf").alias("tf")), "token", "df", "tf")
    assert rows(store.totals(), "docs", "total") == rows(plain.agg(F.countDistinct("doc_id").alias("docs"), F.coalesce(F.sum("tf"), F.lit(0)).alias("total")), "docs", "total")


def test_epochs_equal_a_rebuild(spark):
    rng = random.Random(4)
    text = lambda: " ".join(rng.choices("abcdefg", k=rng.choice([0, 1, 3, 6])))
    docs = {k: text() for k in range(20)}
    store = PostingStore(spark, scratch_path(spark, "postings"))
    store.rebuild(spark.createDataFrame([*docs.items(), (None, "a b")], SCHEMA), tokens())
    for epoch in (1, 2):
        changed = {k: text() for k in rng.sample(range(30), 8)}
        gone = [k for k in rng.sample(range(40), 6) if k not in changed]
        args = (epoch, spark.createDataFrame(sorted(changed.items()), SCHEMA), tokens(), spark.createDataFrame([(k,) for k in gone], "doc_id long"))
        store.apply(*args)
        docs = {k: v for k, v in (docs | changed).items() if k not in gone}
        if epoch == 2:
            store.apply(*args)  # a repeated epoch is there once
    same(spark, store, docs)
    same(spark, store.compact(scratch_path(spark, "compact")), docs)


def test_all_documents_deleted(spark):
    store = PostingStore(spark, scratch_path(spark, "postings"))
    store.rebuild(spark.createDataFrame([(1, "a b"), (2, "a")], SCHEMA), tokens())
    store.apply(1, spark.createDataFrame([], SCHEMA), tokens(), spark.createDataFrame([(1,), (2,)], "doc_id long"))
    assert rows(store.totals(), "docs", "total") == [(0, 0)] and store.frequencies().count() == 0 and store.postings().count() == 0
