"""Token counts of prefixes against the library, which encodes every prefix as a text of its own."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from lodestone.llm import token_counts

from .conftest import sorted_rows
from .test_tokens import long_units, odd_texts

BYTES = public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    "x'll we've they're 'l a'r !'s",
    "a   b \n c　　d \xa0 e ",
    "aa!<|endoftext|><|endoftext|> <|endof<|endoftext|>  <|endoftext|>x  ",
    "<|endoftext|>",
    "",
    "a  \tb   ",
    "\x1c\x1d a \x85b ",
    "é 🎉🎉 ﬁ 12٠3 ",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(BYTES)


def size(library, text):
    return len(library.encode(text, add_special_tokens=False).ids)


def test_every_prefix_equals_library(library):
    texts = ODD + odd_texts(150)
    at, offsets = token_counts.counter(BYTES).counts(pa.array(texts))
    for t, a in zip(texts, offsets[:-1].tolist()):
        got = [int(at[a + len(t[:i].encode()) - 1]) for i in range(1, len(t) + 1)]
        assert got == [size(library, t[:i]) for i in range(1, len(t) + 1)], t


def test_long_units_equal_library(library):
    texts = list(long_units())
    at, offsets = token_counts.counter(BYTES).counts(pa.array(texts))
    assert at[offsets[1:] - 1].tolist() == [size(library, t) for t in texts]
    rng = random.Random(5)
    for t, a in zip(texts, offsets[:-1].tolist()):
        for i in rng.sample(range(1, min(len(t), 3000)), 20):
            assert at[a + len(t[:i].encode()) - 1] == size(library, t[:i])


def longest(library, text, limit):
    return max(i for i in range(len(text) + 1) if size(library, text[:i]) <= limit)


def test_totals(docs, corpus, empty, library):
    want = []
    for i, t in corpus:
        n = size(library, t or "")
        want.append((i, len((t or "").encode()), n, n > 1024))
    got = token_counts.totals(docs, BYTES)
    assert sorted_rows(got, "doc_id", "n_bytes", "n_tokens", "over_limit") == sorted(want, key=repr)
    assert token_counts.totals(empty, BYTES).collect() == []
    for r in got.where("over_limit").collect():
        text = next(t for i, t in corpus if i == r["doc_id"] and t and len(t.encode()) == r["n_bytes"])
        head = text.encode()[: r["cut_bytes"]].decode()
        assert size(library, head) <= 1024
        assert all(size(library, text[: len(head) + k]) > 1024 for k in range(1, 40) if len(head) + k <= len(text))


def test_truncation_and_spans_from_stored_counts(spark, library):
    texts = ODD + odd_texts(30)
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    stored = token_counts.store(rows, BYTES).cache()
    assert all(len(r["counts"]) == 4 * len(r["text"].encode()) for r in stored.collect())
    for r in token_counts.truncate(stored, [3, 17]).collect():
        i = longest(library, texts[r["doc_id"]], r["max_tokens"])
        assert (r["text"], r["n_tokens"]) == (texts[r["doc_id"]][:i], size(library, texts[r["doc_id"]][:i]))
    spans = {}
    for r in sorted(token_counts.spans_within(stored, 10).collect(), key=lambda r: r["span"]):
        spans.setdefault(r["doc_id"], []).append(r)
    for k, t in enumerate(texts):
        data, at, had = t.encode(), 0, 0
        for r in spans.get(k, []):
            assert r["start"] == at < r["stop"]
            at = r["stop"]
            now = size(library, data[:at].decode())
            assert r["tokens"] == now - had and (now - had <= 10 or len(data[r["start"] : at].decode()) == 1)
            had = now
        assert at == len(data)


def test_a_token_may_follow_another_or_not():
    count = token_counts.counter(BYTES)
    assert count.piece(b"the")[-1] == 1
    assert count.piece(b"thethe")[-1] == len(count.single(b"thethe"))
    assert np.all(np.array(count.piece(b"ab" * 50)) > 0)
