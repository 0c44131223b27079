import hashlib
import random
import string
import time
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from lodestone.llm import pieces, token_files

from .conftest import sorted_rows

PIECES = public_tokenizers.path("piece_bpe_32k.model")
BYTES = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


def odd_texts(n=400):
    rng = random.Random(3)
    fixed = ["", " ", "   ", "a ", " a", "▁", " ▁ ", "a▁b", "a" * 700, "-" * 90 + " " * 40, "</s><unk>", "<|endoftext|> a <|endoftext|>", "don't  it's\n\n x", "\x00 \x1c a", "a　b  c\x85 d"]
    return fixed + ["".join(rng.choice("ab .,'s\n\t  é日🎉12-") for _ in range(rng.randint(1, 200))) for _ in range(n)]


def test_pieces_equal_library(library):
    texts = odd_texts()
    got = [x.tolist() for x in pieces.encoder(PIECES).encode(texts)]
    assert got == [ids + [library.eos_id()] for ids in library.encode(texts)]
    model = pieces.encoder(PIECES).model
    assert [model.decode(np.array(x)).decode("utf-8", "replace") for x in got] == library.decode(got)


def long_units():
    rng = random.Random(9)
    draw = lambda letters, n: "".join(rng.choices(letters, k=n))
    small = string.ascii_lowercase + string.digits
    yield from (draw(small, 300_000), draw("ACGT", 100_000), draw("ab", 20_000), draw("日本語のé🎉", 20_000), "the" * 10_000, "-" * 5_000 + "=" * 5_000, "ha" * 9_999 + "é")
    yield from (draw(string.ascii_letters + "+/", 50_000), " ".join(draw(small, rng.randint(200, 900)) for _ in range(60)), "aab" * 700 + "日" + "ing" * 400)


def test_long_units_equal_library(library):
    texts = list(long_units())
    got = [x.tolist() for x in pieces.encoder(PIECES).encode(texts)]
    assert got == [ids + [library.eos_id()] for ids in library.encode(texts)]


def test_a_megabyte_without_blanks(library):
    text = "".join(random.Random(1).choices(string.ascii_lowercase + string.digits, k=1_000_000))
    began = time.perf_counter()
    got = pieces.encoder(PIECES).encode([text])[0].tolist()
    assert time.perf_counter() - began < 30
    assert got == library.encode(text) + [library.eos_id()]


def test_pieces_digest(docs, corpus, empty, library):
    want = []
    for i, t in corpus:
        ids = library.encode(t or "") + [library.eos_id()]
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    assert sorted_rows(pieces.digest(docs, PIECES), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=repr)
    assert pieces.digest(empty, PIECES, with_ids=True).collect() == []


def test_pieces_round_trip(docs, corpus):
    back = pieces.decode(pieces.encode(docs, PIECES), PIECES)
    assert sorted_rows(back, "doc_id", "text") == sorted([(i, t or "") for i, t in corpus], key=repr)


def test_byte_bpe_equals_library():
    texts = odd_texts()
    whole = Tokenizer.from_file(BYTES)
    ids, edges = token_files.coder(BYTES).encode(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(edges[:-1], edges[1:])] == [whole.encode(t, add_special_tokens=False).ids for t in texts]


def test_token_files_round_trip(docs, corpus, tmp_path):
    whole = Tokenizer.from_file(BYTES)
    got = token_files.round_trip(docs, BYTES, f"file://{tmp_path}/out").collect()
    by_place = sorted(got, key=lambda r: r["start"])
    at = 0
    for r in by_place:
        assert r["start"] == at
        at += r["n_tokens"]
    assert [r["doc_id"] for r in by_place] == sorted((i for i, _ in corpus), key=lambda i: (i is not None, i))
    want = []
    for i, t in corpus:
        ids = whole.encode(t or "", add_special_tokens=False).ids + [0]
        want.append((i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    assert sorted([(r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got], key=repr) == sorted(want, key=repr)


def test_token_files_of_odd_and_frequent_ids(spark, tmp_path):
    """The smallest integer is an id; rows of one id or none fill several parts."""
    low = -(2**63)
    rows = [(low, "least")] * 3 + [(None, f"none {k}") for k in range(400)] + [(5, "same")] * 400 + [(7, f"seven {k}") for k in range(400)] + [(2**63 - 1, "most")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    uri = f"file://{tmp_path}/odd"
    manifest = token_files.write(docs, uri, BYTES, part_bytes=2000)
    assert max(r["docs"] for r in manifest.collect()) < 700
    got = sorted(token_files.read(spark, manifest, uri, token_files.vocabulary_dtype(BYTES)).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [None] * 400 + [low] * 3 + [5] * 400 + [7] * 400 + [2**63 - 1]
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(got, got[1:]))


def test_token_files_empty(empty, tmp_path):
    assert token_files.round_trip(empty, BYTES, f"file://{tmp_path}/none").collect() == []
