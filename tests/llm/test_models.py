import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.llm import language_model, shard_tree

from .conftest import sorted_rows
from .test_dedup import ascii_lower


def brute_model(rows):
    """Counts of orders one to three, and the probability of a token after a list of tokens; 1 is the start, 0 the end."""
    c, pairs, triples, starts = Counter(), Counter(), Counter(), 0
    for i, t in rows:
        if i is not None and zlib.crc32(str(i).encode()) % 7 == 2:
            continue
        w = [1, *ascii_lower(t).split(), 0]
        c.update(w[1:])
        starts += 1
        pairs.update(zip(w, w[1:]))
        triples.update(zip(w, w[1:], w[2:]))
    n, v = sum(c.values()), len(c)

    def p(before, x):
        out = (c[x] + 1) / (n + v + 1)
        v1 = before[-1]
        seen = starts if v1 == 1 else c[v1]
        if seen:
            out = (pairs[v1, x] + 5 * out) / (seen + 5)
        if len(before) > 1 and pairs[before[-2], v1]:
            out = (triples[before[-2], v1, x] + 2 * out) / (pairs[before[-2], v1] + 2)
        return out

    return c, n, v, p


def brute_scores(rows):
    c, n, v, p = brute_model(rows)
    out = []
    for i, t in rows:
        w = ascii_lower(t).split() + [0]
        held = i is not None and zlib.crc32(str(i).encode()) % 7 == 2
        base = sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w)
        score = sum(math.log10(p([1, *w[:k]][-2:], x)) for k, x in enumerate(w))
        out.append((i, held, len(w), sum(c[x] > 0 for x in w), n, round(base, 3), round(score, 3)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("chunk_bytes", [1500, 1 << 22])
def test_scores_match_brute_force(docs, corpus, chunk_bytes):
    got = language_model.score(docs, chunk_bytes=chunk_bytes)
    columns = ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    rounded = got.withColumn("base_score", F.round("base_score", 3)).withColumn("score", F.round("score", 3))
    assert sorted_rows(rounded, *columns) == brute_scores(corpus)


def test_scores_empty(empty):
    assert language_model.score(empty).collect() == []


def test_stretches_carry_the_state(docs, corpus, monkeypatch):
    want = {tuple(r) for r in language_model.score(docs).select("doc_id", "n_tokens", F.round("score", 6)).collect()}
    monkeypatch.setattr(language_model, "STRETCH", 7)
    columns = language_model.score(docs).select("doc_id", "n_tokens", F.round("score", 6))
    assert {tuple(r) for r in columns.collect()} == want


def chunk_automaton(rows, more=()):
    """The automaton of one chunk that holds ``rows`` and, held out, ``more``."""
    free = (k for k in range(10_000) if zlib.crc32(str(k).encode()) % 7 != 2)
    held = (k for k in range(10_000) if zlib.crc32(str(k).encode()) % 7 == 2)
    table = pa.table({"doc_id": [next(free) for _ in rows] + [next(held) for _ in more], "text": [*rows, *more]})
    tokens = language_model.Tokens(table, 7, 2)
    counts = language_model.Counts.__new__(language_model.Counts)
    counts.type, counts.pair = tokens.type_count, tokens.pair_count
    real = np.delete(tokens.type_count, tokens.start_type)
    counts.types, counts.total = int((real > 0).sum()), int(real.sum())
    triples = tokens.triples(counts.pair)
    total = np.bincount(triples[2][tokens.train[triples[0]]], minlength=len(triples[1]))
    return tokens, language_model.Automaton(tokens, counts, triples, total, (5.0, 2.0)), counts


def test_probabilities_of_a_state_sum_to_one():
    """From every state, the probabilities of all tokens and of one never seen sum to one; the states are those of all orders."""
    tokens, model, counts = chunk_automaton(["a b a c", "b a b a b", "c c a b a", "a b c"], ["zzz"])
    types = [k for k in range(len(tokens.types)) if k != tokens.start_type]
    unseen = [k for k in types if not counts.type[k]]
    assert len(unseen) == 1
    reached, todo = set(), [model.start]
    while todo:
        state = todo.pop()
        if state in reached:
            continue
        reached.add(state)
        after, weights = model.step(np.full(len(types), state), np.array(types))
        assert sum(10.0**weights) == pytest.approx(1.0)
        # Nothing follows the end.
        todo += [int(a) for a, k in zip(after, types) if tokens.types[k] != language_model.END]
    n = len(tokens.types)
    assert 0 in reached and any(0 < s <= n for s in reached) and any(s > n for s in reached)


def test_keys_are_whole():
    rng = np.random.default_rng(4)
    for bits in (6, 10, 16, 20):
        keys = np.unique(rng.integers(0, 1 << 63, 5000, dtype=np.uint64) * np.uint64(2) + np.uint64(1))
        edges = language_model._edges(keys, bits)
        for b in np.flatnonzero(np.diff(edges))[:200].tolist():
            mine = keys[edges[b] : edges[b + 1]]
            data = language_model.pack_keys(mine, bits)
            assert len(data) == language_model._key_bytes(data, len(mine), bits)
            assert (language_model.unpack_keys(data, bits, b) == mine).all()


def test_shards_hold_their_law(docs, corpus, empty):
    rows = shard_tree.shard(docs, 24, bucket_rows=3).collect()
    want = sorted([(i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in corpus], key=repr)
    assert sorted([(r["doc_id"], r["size"], r["text_crc32"]) for r in rows], key=repr) == want
    for s in {r["shard"] for r in rows}:
        slots = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert slots == list(range(len(slots)))
    assert all(r["grown_shard"] in (r["shard"], 24) and r["law"] == "key" and 0 <= r["shard"] < 24 for r in rows)
    assert shard_tree.shard(empty).collect() == []


@pytest.mark.parametrize("n", [1, 2, 5, 24, 25, 30])
def test_growth_moves_rows_into_the_new_shard_only(spark, n):
    ids = spark.range(20_000).withColumnRenamed("id", "doc_id")
    layout = shard_tree.tree(n)
    assert layout.size == n
    if n >= 24:
        assert shard_tree.tree(n + 1) == layout.grow()
    both = shard_tree.assign(shard_tree.assign(ids, F.col("doc_id"), layout, "a"), F.col("doc_id"), layout.grow(), "b")
    moved = both.where("a <> b").groupBy("b").count().collect()
    assert [r["b"] for r in moved] == [n]
    assert abs(moved[0]["count"] - 20_000 / (n + 1)) < 6 * math.sqrt(20_000 / (n + 1))


@pytest.mark.parametrize("n", [24, 200])
def test_a_filter_on_a_shard_does_not_multiply_the_draws(spark, n):
    ids = spark.range(1000).withColumnRenamed("id", "doc_id")
    layout = shard_tree.tree(n)
    both = shard_tree.assign(shard_tree.assign(ids, F.col("doc_id"), layout, "shard"), F.col("doc_id"), layout.grow(), "grown")
    for filtered, most in ((both, 6), (both.where("shard = 3"), 9), (both.where("shard <> grown"), 12)):
        assert filtered._jdf.queryExecution().optimizedPlan().toString().count("xxhash64") <= most


def brute_shard(spark, ids, layout):
    """Descent by explicit loops; the hashes are Spark's."""
    names = [f"region {i}" for i in range(len(layout.weights))]
    names += [f"rack {i} {j}" for i, r in enumerate(layout.weights) for j in range(len(r))]
    names += [f"shard {i} {j} {k}" for i, r in enumerate(layout.weights) for j, x in enumerate(r) for k in range(len(x))]
    hashes = spark.createDataFrame([(i,) for i in ids], "doc_id long").select("doc_id", *[F.xxhash64("doc_id", F.lit(x)).alias(x) for x in names]).collect()

    def best(row, children):
        u = lambda x: (((row[x] & (2**64 - 1)) >> 12) + 0.5) / 2**52
        return max((math.log(u(x)) / w, -k) for k, (x, w) in enumerate(children) if w > 0)[1] * -1

    out, first = {}, {}
    for i, r in enumerate(layout.weights):
        for j, x in enumerate(r):
            first[i, j] = sum(len(y) for q in layout.weights[:i] for y in q) + sum(len(y) for y in r[:j])
    for row in hashes:
        i = best(row, [(f"region {a}", sum(map(sum, r))) for a, r in enumerate(layout.weights)])
        j = best(row, [(f"rack {i} {a}", sum(x)) for a, x in enumerate(layout.weights[i])])
        out[row["doc_id"]] = first[i, j] + best(row, [(f"shard {i} {j} {a}", w) for a, w in enumerate(layout.weights[i][j])])
    return out


@pytest.mark.parametrize("layout", [shard_tree.tree(24), shard_tree.tree(26), shard_tree.Tree((((1.0, 0.0, 2.0), (0.5,)), ((3.0,),)))])
def test_shards_match_brute_force(spark, layout):
    ids = list(range(-50, 250))
    got = shard_tree.assign(spark.createDataFrame([(i,) for i in ids], "doc_id long"), F.col("doc_id"), layout, "shard").collect()
    assert {r["doc_id"]: r["shard"] for r in got} == brute_shard(spark, ids, layout)


def test_rows_of_one_id_have_slots_of_their_own(spark):
    rows = [(7, "same", 1)] * 500 + [(None, None, 2)] * 300
    got = shard_tree.shard(spark.createDataFrame(rows, "doc_id long, text string, row int").repartition(3), 24, bucket_rows=5).collect()
    for s in {r["shard"] for r in got}:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))


def test_weights_decide_shares_and_confine_movement(spark):
    ids = spark.range(20_000).withColumnRenamed("id", "doc_id")
    before = shard_tree.Tree((((1.0, 1.0), (2.0,)), ((1.0, 3.0),)))
    after = shard_tree.Tree((((1.0, 1.0), (2.0,)), ((1.0, 6.0),)))
    both = shard_tree.assign(shard_tree.assign(ids, F.col("doc_id"), before, "a"), F.col("doc_id"), after, "b")
    share = {r["a"]: r["count"] / 20_000 for r in both.groupBy("a").count().collect()}
    assert all(abs(share[k] - w / 8) < 0.02 for k, w in enumerate((1, 1, 2, 1, 3)))
    # Only the second region's weight grew: nothing moves out of it, and nothing moves within the first.
    assert both.where("a <> b and (b < 3 or (a = 4))").count() == 0
