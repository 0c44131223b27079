import random

import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import relational as R
from lodestone.sources import descriptors as X
from lodestone.sources import parsers as P
from lodestone.streaming import incremental as I


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_limits_and_offsets():
    assert [R.clamp_limit(x, 50, 100) for x in (None, "7", 0, 1000, "x")] == [50, 7, 1, 100, 50]
    assert [R.clamp_offset(x) for x in (None, -3, "4", "x")] == [0, 0, 4, 0]


def test_page_looks_ahead(spark):
    df = spark.range(7)
    first, more, following = R.page(df, ["id"], 3)
    assert rows(first, "id") == [(0,), (1,), (2,)] and more and following == 3
    last, more, following = R.page(df, ["id"], 3, 6)
    assert rows(last, "id") == [(6,)] and not more and following is None


def test_upserts(spark):
    df = spark.createDataFrame([("a", 1, "x", 1), ("a", 2, "y", None), ("b", 5, "z", 3)], "k string, seq int, v string, w int")
    assert rows(R.latest(df, ["k"], "seq"), "k", "v", "w")[0] == ("a", "y", None)
    assert rows(R.first_written(df, ["k"], "seq"), "k", "v")[0] == ("a", "x")


def test_islands_and_best_window(spark):
    df = spark.createDataFrame([("a", n) for n in (1, 2, 3, 3, 5, 7, 8)], "k string, n long")
    assert rows(R.islands(df, ["k"], "n"), "lo", "hi") == [(1, 3), (5, 5), (7, 8)]
    scored = spark.createDataFrame([("p", k, s) for k, s in enumerate([1.0, 5.0, 5.0, 1.0, 6.0])], "p string, k int, s double")
    assert rows(R.best_window(scored, "p", "k", "s", 3), "window_start", "window_score") == [(2, 12.0)]


def test_degenerate_normalisation(spark):
    df = spark.createDataFrame([("a", 2.0), ("a", 2.0), ("b", 1.0), ("b", 3.0)], "g string, s double")
    assert rows(df.select("g", R.min_max("s", ["g"], 1.0).alias("x")), "g", "x") == [("a", 1.0), ("a", 1.0), ("b", 0.0), ("b", 1.0)]


def test_quota_interleave_fills_by_score(spark):
    df = spark.createDataFrame([(g, r, 100.0 - 10 * g - r) for g in (1, 2, 3) for r in (1, 2, 3)], "g int, r int, s double")
    got = R.interleave(df, "g", "r", [2, 1, 0], 5, [F.desc("s")])
    assert [(r["g"], r["r"]) for r in got.orderBy("slot").collect()] == [(1, 1), (1, 2), (2, 1), (1, 3), (2, 2)]


def test_bm25_against_a_plain_computation(spark):
    import math

    docs = {1: "alpha beta beta", 2: "beta gamma", 3: "delta delta delta delta"}
    query = "beta beta delta"
    frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    asked = T.postings(spark.createDataFrame([(9, query)], "q long, text string"), "q", T.tokens("text")).withColumnRenamed("tf", "qf")
    got = {r["doc_id"]: r["score"] for r in T.bm25(T.postings(frame, "doc_id", T.tokens("text")), "doc_id", asked, "q").collect()}
    average = sum(len(t.split()) for t in docs.values()) / 3
    for k, t in docs.items():
        w = t.split()
        want = 0.0
        for q in query.split():
            df = sum(q in x.split() for x in docs.values())
            tf = w.count(q)
            want += math.log(1 + (3 - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / average))
        assert abs(got.get(k, 0.0) - want) < 1e-9


def test_fusion_clamps_and_counts_missing_legs_as_zero(spark):
    a = spark.createDataFrame([(1, 10, 4.0), (1, 11, 2.0)], "q long, d long, score double")
    b = spark.createDataFrame([(1, 11, 0.5)], "q long, d long, score double")
    got = {r["d"]: r["score"] for r in T.fuse(a, b, ["q", "d"], ["q"], 1.0).collect()}
    assert got == pytest.approx({10: 0.8, 11: 0.4 + 0.2})
    rrf = {r["d"]: r["score"] for r in T.fuse(a, b, ["q", "d"], ["q"], 0.5, "rrf").collect()}
    assert rrf == pytest.approx({10: 0.5 / 61, 11: 0.5 / 62 + 0.5 / 61})


def test_tokens_and_stems(spark):
    df = spark.createDataFrame([("getUserName andThe x1 ab foo_bar", "creation")], "t string, w string")
    r = df.select(T.tokens("t").alias("a"), T.stem(F.col("w")).alias("b")).first()
    assert r["a"] == ["get", "user", "name", "foo_bar"] and r["b"] == "creation"
    assert df.select(T.stem(F.lit("formation")).alias("s")).first()["s"] == "form"


def test_chunks_cover_the_text(spark):
    text = ("Sentence one is here. " * 30 + "\n\n") * 5 + "x" * 3000
    spans = T.split_text(text, 500, 50)
    assert spans[0][0] == 0 and spans[-1][1] == len(text)
    assert all(b - a <= 500 for a, b in spans) and all(a2 <= b1 and a2 > a1 for (a1, b1), (a2, _) in zip(spans, spans[1:]))
    assert T.split_text("", 10, 2) == []
    out = T.chunk(spark.createDataFrame([("k", text), ("n", None)], "k string, t string"), "k", "t", 500, 50).collect()
    assert [r["chunk"] for r in out] == [text[a:b] for a, b in spans]


def test_fuzzy_similarity(spark):
    df = spark.createDataFrame([("abcd", "abcd"), ("abcd", "abcdef"), ("abcd", "abxd"), (None, "x")], "a string, b string")
    assert [round(r[0], 3) for r in df.select(T.fuzzy("a", "b")).collect()] == [1.0, 0.94, 0.75, 0.0]


def test_markup_and_code_parsers(spark):
    page = spark.createDataFrame([(1, "<html><body id='b'><p>x<br>y</p><script>z</script></body></html>")], "k long, h string")
    assert [(r["tag"], r["depth"], r["parent"]) for r in P.elements(page, "k", "h").orderBy("number").collect()] == [("html", 0, None), ("body", 1, 0), ("p", 2, 1), ("br", 3, 2), ("script", 2, 1)]
    assert page.select(P.html_text(F.col("h"))).first()[0] == "x y"
    code = "&OnServer\nProcedure Run(a, b = 1) Export\n  Common.Call(a, b);\nEndProcedure"
    got = P.code_scan(spark.createDataFrame([(1, code)], "k long, t string"), "k", "t").collect()
    assert [(r["kind"], r["name"], r["qualifier"], r["arguments"], r["line"]) for r in got] == [
        ("directive", "OnServer", None, 0, 1), ("routine", "Run", "export", 2, 2), ("parameter", "a", None, 0, 2), ("parameter", "b", None, 0, 2), ("call", "Call", "Common", 2, 3),
    ]
    assert [r["detail"] for r in got if r["kind"] == "parameter"] == [None, "1"]
    odd = "x = A(); y = B(C(1, \"), (\"), D(2,,3)); // E(1)\nz = F(\nWhile (a) Do"
    got = P.code_scan(spark.createDataFrame([(1, odd), (2, None), (3, "")], "k long, t string"), "k", "t").collect()
    assert [(r["name"], r["arguments"]) for r in got] == [("A", 0), ("B", 2), ("C", 2), ("D", 3), ("F", 0)]
    report = 'a:\n  b: 1\n  c: "two\nlines"\nd: 3'
    got = P.indented(spark.createDataFrame([(1, report)], "k long, t string"), "k", "t").collect()
    assert [(r["path"], r["value"]) for r in got] == [("a", ""), ("a/b", "1"), ("a/c", "two\nlines"), ("d", "3")]


def test_files_that_are_no_markup_give_no_rows(spark):
    rows = [(1, None), (2, ""), (3, "<Rights><object>"), (4, "plain"), (5, "<Rights/>")]
    files = spark.createDataFrame(rows, "k long, f string")
    for parse in (X.objects, X.forms, X.rights, X.predefined, X.subscriptions, X.identifiers):
        assert parse(files.where("k < 5"), "k", "f").collect() == []
        assert parse(files.where("false"), "k", "f").collect() == []
    assert X.rights(files, "k", "f").collect() == []


def test_nearest_in_blocks(spark, monkeypatch):
    rng = random.Random(2)
    vectors = spark.createDataFrame([(k, [rng.random() - 0.5 for _ in range(4)]) for k in range(300)], "id long, v array<double>")
    queries = vectors.where("id % 10 = 0").withColumnRenamed("id", "q")
    one = {tuple(r) for r in T.nearest(vectors, queries, "id", "v", "q", 5).select("q", "id", F.round("score", 9)).collect()}
    monkeypatch.setattr(T, "QUERY_BLOCK", 7)
    assert {tuple(r) for r in T.nearest(vectors, queries, "id", "v", "q", 5).select("q", "id", F.round("score", 9)).collect()} == one
    assert len(one) == 150 and all((k, k, 1.0) in one for k in range(0, 300, 10))


def test_a_consumer_that_fails_opens_the_circuit():
    calls = []

    def put(batch, epoch):
        calls.append(epoch)
        if epoch == 2 or len(calls) == 1:
            raise ValueError

    consume = I.guarded(put)
    consume(None, 1)
    with pytest.raises(I.CircuitOpen):
        consume(None, 2)
    assert calls == [1, 1, 2, 2, 2]


def test_sniffed_encodings(spark):
    data = [("é".encode(),), (b"\xef\xbb\xbfabc",), ("Привет".encode("cp1251"),)]
    got = [r[0] for r in spark.createDataFrame(data, "b binary").select(P.sniffed(F.col("b"))).collect()]
    assert got == ["é", "abc", "Привет"]


def test_epochs(spark, tmp_path):
    store = I.EpochStore(spark, f"file://{tmp_path}/epochs")
    assert store.current() == 0
    one, two = spark.range(3), spark.range(5)
    assert store.publish(one) == 1 and store.read(one.schema).count() == 3
    assert store.publish(two) == 2 and store.read(two.schema).count() == 5
    store.publish(one)
    assert store.collectable() == [1]


def test_routine_states(spark):
    schema = "id int, signature string, body string, doc string, line int, file string"
    old = spark.createDataFrame([(k, "s", "b", "d", 1, "f") for k in range(1, 8)], schema)
    new = spark.createDataFrame([(1, "s", "b", "d", 1, "f"), (2, "S", "B", "d", 1, "f"), (3, "s", "B", "D", 1, "f"), (4, "s", "b", "D", 2, "f"), (5, "s", "b", "d", 2, "f"), (6, "s", "b", "d", 1, "g"), (9, "s", "b", "d", 1, "f")], schema)
    got = dict(rows(I.routine_delta(old, new), "id", "state"))
    assert got == {1: "unchanged", 2: "signature_changed", 3: "body_changed", 4: "doc_changed", 5: "line_only", 6: "body_changed", 7: "deleted", 9: "added"}


def test_fuzzy_pairs_are_those_of_all_pairs(spark):
    import random
    from difflib import SequenceMatcher

    rng = random.Random(3)
    base = ["information", "application", "redistribution", "configuration", "data", "datas", "database", "abcde", "aaaaaaaab", "x_1"]
    words = {*base, "imformation", "xapplication", "dat", "abcd", "bcde", "baaaaaaaa", "informationinformation"}
    for _ in range(300):
        w = list(rng.choice(base))
        for _ in range(rng.randrange(3)):
            k = rng.randrange(len(w))
            w[k : k + rng.randrange(2)] = rng.choice(["", "a", "e", "7", "xy"])
        words.add("".join(w))

    def ratio(x, y):
        return 0.94 if x.startswith(y) or y.startswith(x) else SequenceMatcher(None, x, y).ratio()

    words = sorted(x for x in words if len(x) >= 3)
    want = {(x, y, round(ratio(x, y), 6)) for x in words for y in words if x < y and round(ratio(x, y), 6) >= 0.88}
    got = [tuple(r) for r in T.fuzzy_pairs(spark.createDataFrame([(x,) for x in words * 2], "token string"), 0.88).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert {("imformation", "information"), ("application", "xapplication"), ("abcd", "abcde")} <= {g[:2] for g in got}
    some, rest = words[::3], words[1::2]
    want = {(x, y, round(ratio(x, y), 6)) for x in some for y in rest if x != y and round(ratio(x, y), 6) >= 0.88}
    frames = [spark.createDataFrame([(x,) for x in z], "token string") for z in (some, rest)]
    assert {tuple(r) for r in T.fuzzy_pairs(frames[0], 0.88, frames[1]).collect()} == want



def test_rerank_reads_whole_texts(spark, tmp_path):
    from lodestone.plans import registry

    start = "alpha beta " * 10
    docs = [(1, start + "gamma"), (2, start + "delta"), (3, start + "gamma delta epsilon"), (4, "nothing here")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, start + "gamma epsilon")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r["doc_id"]: r["rerank"] for r in registry.queries()["q34_rerank"](spark, str(tmp_path)).collect()}
    assert got == {1: 0.75, 2: 0.5, 3: 1.0}


def test_fuzzy_leg_against_brute_force(spark):
    from difflib import SequenceMatcher

    from lodestone.plans import texts
    from lodestone.plans.core import Data

    data = Data(spark, "/root/testdata/sf0.001")
    heads, asked = {}, {}
    for r in texts._index(data, "head").where("doc_id < 40").collect():
        heads.setdefault(r["doc_id"], []).append(r["token"])
    for r in texts._asked(data).where("item_id < 12").collect():
        asked.setdefault(r["item_id"], []).append(r["token"])

    def ratio(x, y):
        return 1.0 if x == y else 0.94 if x.startswith(y) or y.startswith(x) else SequenceMatcher(None, x, y).ratio()

    best = lambda t, q: max((r for r in (ratio(t, y) for y in q) if r >= texts.FUZZY_LEAST), default=0.0)
    want = {(i, k): sum(best(t, q) for t in h) / len(h) for i, q in asked.items() for k, h in heads.items()}
    pool = spark.createDataFrame(list(want), "item_id long, doc_id long")
    got = {(r["item_id"], r["doc_id"]): r["score"] for r in texts._fuzzy_leg(data, pool).collect()}
    assert got.keys() == {k for k, v in want.items() if v > 0}
    assert all(got[k] == pytest.approx(want[k], abs=1e-5) for k in got)


def test_overlapping_ranges_pair_once_without_a_shuffle_of_pairs(spark, tmp_path, monkeypatch):
    from lodestone.plans import core, registry

    monkeypatch.setattr(core, "CLASS_SLICE", 3)
    parts = [(k % 60, (k * 7) % 50 + 1) for k in range(90)] + [(11, 4)] * 20 + [(None, 3), (21, None)]
    sites = [(k % 25, (k * 5) % 25) for k in range(40)] + [(None, 3), (1, None)]
    spark.createDataFrame(parts, "p_partkey long, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame(sites, "s_suppkey long, s_nationkey int").write.parquet(f"{tmp_path}/supplier.parquet")
    df = registry.queries()["jn15_overlapping_arity"](spark, str(tmp_path))
    want = {(p, s) for p, size in parts for s, n in sites if None not in (p, s, size, n) and p % 10 == s % 10 and size <= n + 3 and n <= size + 2}
    got = [tuple(r) for r in df.collect()]
    assert len(got) == len(want) and set(got) == want
    # The pairs are the last thing made: nothing above their join groups or moves them.
    top = df._jdf.queryExecution().optimizedPlan().toString().splitlines()[:2]
    assert "Project" in top[0] and "Join" in top[1]


def test_nearest_is_the_sum_in_order_on_odd_vectors(spark):
    """Copies, nulls, other sizes, infinities and blocks: the pairs and scores of the plain expression; no pair of the answer is scored by one."""
    rng = random.Random(5)
    base = [[rng.uniform(-1, 1) for _ in range(9)] for _ in range(60)]
    rows = [(k, base[k % 60]) for k in range(200)] + [(300, None), (301, [1.0]), (302, [None] + base[0][1:]), (303, [-x for x in base[3]]), (304, [float("inf")] + base[1][1:]), (305, [])]
    v = spark.createDataFrame(rows, "id long, v array<float>")
    q = spark.createDataFrame([(k, base[k]) for k in range(0, 60, 7)] + [(90, None), (91, [0.5]), (92, [float("nan")] + base[2][1:])], "q long, v array<float>")
    pairs = v.crossJoin(q.withColumnRenamed("v", "y")).select("q", "id", F.greatest(F.lit(0.0), T.cosine(F.col("v"), F.col("y"))).alias("score"))
    for n in (4, 30, 250):
        want = R.top_n(pairs, ["q"], [F.desc(F.round("score", 9)), "id"], n).select("q", "id", "score")
        df = T.nearest(v, q, "id", "v", "q", n).select("q", "id", "score")
        assert sorted(map(repr, df.collect())) == sorted(map(repr, want.collect()))
        assert "CartesianProduct" not in df._jdf.queryExecution().toString() and "NestedLoop" not in df._jdf.queryExecution().toString()
