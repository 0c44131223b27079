"""The ranker's fuzzy and module legs: work bounded by the candidates, results of the plain form."""

import random

from pyspark import AccumulatorParam
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from lodestone.functions import text as T
from lodestone.operators import relational as R
from lodestone.plans import texts
from lodestone.plans.core import Data


class Listed(AccumulatorParam):
    def zero(self, value):
        return []

    def addInPlace(self, a, b):  # noqa: N802
        a += b
        return a


def test_a_pair_of_tokens_is_compared_once(spark, monkeypatch):
    seen = spark.sparkContext.accumulator([], Listed())
    plain = T.fuzzy.func

    @F.pandas_udf(DoubleType())
    def counted(a, b):
        seen.add(list(zip(a, b)))
        return plain(a, b)

    monkeypatch.setattr(T, "fuzzy", counted)
    words = ["configuration", "configurations", "confuguration", "cofniguration", "configurration", "xconfiguration"]
    frame = spark.createDataFrame([(w,) for w in words * 2], "token string")
    got = [tuple(r)[:2] for r in T.fuzzy_pairs(frame, 0.88).collect()]
    assert len(got) == len(set(got)) > 8 and ("configuration", "configurations") in got
    assert seen.value and len(seen.value) == len(set(seen.value))
    # What begins the other needs no comparison.
    assert not any(a.startswith(b) or b.startswith(a) for a, b in seen.value)


def test_fuzzy_leg_compares_tokens_of_candidates_alone(spark, monkeypatch):
    data = Data(spark, "/root/testdata/sf0.001")
    words = {}
    pairs = T.fuzzy_pairs
    monkeypatch.setattr(T, "fuzzy_pairs", lambda w, *rest: words.update(left={r["token"] for r in w.collect()}) or pairs(w, *rest))
    pool = spark.createDataFrame([(1, 4), (1, 9), (2, 9)], "item_id long, doc_id long")
    texts._fuzzy_leg(data, pool).collect()
    heads = {r["token"] for r in texts._index(data, "head").where("doc_id in (4, 9)").collect()}
    assert heads and words["left"] == heads


def test_module_leg_holds_what_can_be_among_the_best(spark, monkeypatch):
    monkeypatch.setattr(texts, "POOL", 5)
    rng = random.Random(1)
    # Some ids stand in two rows, of two modules or twice of one.
    docs = [(k, f"s{rng.randrange(4)}") for k in range(300)] + [(k, f"s{rng.randrange(4)}") for k in range(0, 300, 6)]
    units = spark.createDataFrame(docs, "doc_id long, source string")
    scored = [(i, f"s{s}", 1.0 + (i * s) % 3) for i in range(4) for s in range(4 if i else 1)]
    modules = spark.createDataFrame(scored, "item_id long, source string, score double")
    leg = spark.createDataFrame([(i, rng.randrange(300), rng.random()) for i in range(4) for _ in range(4)], "item_id long, doc_id long, score double")
    other = texts._normal(leg, 0.05)

    def best(parts):
        total = parts.unionByName(other).groupBy("item_id", "doc_id").agg(F.sum("part").alias("base"))
        return {(r["item_id"], r["doc_id"], round(r["base"], 9), r["place"]) for r in R.top_n(total, ["item_id"], [F.desc(F.round("base", 6)), "doc_id"], 5).collect()}

    whole = texts._normal(modules.join(units, "source").select("item_id", "doc_id", "score"), texts.LEGS["module"][0])
    some = texts._module_parts(modules, units, [leg])
    assert best(some) == best(whole) and len(best(whole)) == 20
    assert some.count() < whole.count() / 2
