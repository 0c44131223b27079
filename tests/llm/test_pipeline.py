import hashlib

import pytest
import sentencepiece

from lodestone.llm import queries

from .test_dedup import brute_jaccard, brute_substring
from .test_filters import brute_hits, brute_posteriors, brute_votes

SF = "/root/testdata/sf0.001"


def test_queries_are_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10
    assert "pipeline" in names and set(queries.queries()) <= set(names)


def test_pipeline_against_brute_force(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    source = spark.read.parquet(f"{SF}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    docs = source
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        out = stage(spark, docs, SF).cache()
        rows = list(before.items())
        if name == "quality rules":
            kept = {r["doc_id"] for r in out.collect()}
            votes = [brute_votes(t) for _, t in rows]
            assert kept == {i for (i, _), (_, failed), p in zip(rows, votes, brute_posteriors(votes)) if not failed and p >= 0.5}
            assert len(kept) > 0.6 * len(rows)
        elif name == "n-gram Jaccard join":
            assert {r["doc_id"] for r in out.collect()} == {i for i, _, c in brute_jaccard(rows) if i == c}
        elif name == "substring dedup":
            got = {r["doc_id"]: r["text"] for r in out.collect()}
            for i, _, n, digest in brute_substring(rows):
                assert got[i] == before[i] if not n else hashlib.sha256(got[i].encode()).hexdigest() == digest
            assert all(r["n_chars"] == len(r["text"]) for r in out.collect())
        elif name == "benchmark decontamination":
            assert {r["doc_id"] for r in out.collect()} == {r[0] for r in brute_hits(rows, items) if not r[-1]}
        else:
            library = sentencepiece.SentencePieceProcessor(model_file=queries.vocabulary("piece_bpe_32k.model"))
            got = {r["doc_id"]: r for r in out.collect()}
            assert set(got) == set(before)
            for i, t in rows:
                ids = library.encode(t or "") + [library.eos_id()]
                assert (got[i]["ids"], got[i]["n_tokens"]) == (ids, len(ids))
                assert got[i]["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == source.columns
        docs = out


def test_stages_on_odd_rows(spark, docs, empty):
    """Nulls, empty and long texts, repeated ids, columns of clashing names, and a table without rows."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    extra = docs.selectExpr("*", "'r' as row", "1 as size", "'t' as token", "'n' as norm", "'k' as row_key")
    for table in (extra, extra.where("false"), extra.where("text is null or length(trim(text)) = 0")):
        now = table
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, now, SF)
            assert out.columns == table.columns, name
            now = out.cache()
        assert corpus_pipeline.STAGES[-1][1](spark, now, SF).count() == now.count()
    assert now.count() == 0
