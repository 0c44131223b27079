import hashlib
from collections import Counter, defaultdict

import pytest

from lodestone.llm import components, jaccard, substring

from .conftest import sorted_rows


def ascii_lower(text):
    return bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())


def brute_substring(rows):
    words = [((t or "").encode().split()) for _, t in rows]
    first = {}
    for (i, _), w in zip(rows, words):
        if i is not None:
            for k in range(len(w) - 12):
                key = tuple(w[k : k + 13])
                first[key] = min(first.get(key, i), i)
    out = []
    for (i, _), w in zip(rows, words):
        hit = [False] * len(w)
        if i is not None:
            for k in range(len(w) - 12):
                if first[tuple(w[k : k + 13])] < i:
                    hit[k : k + 13] = [True] * 13
        kept = b" ".join(x for x, h in zip(w, hit) if not h)
        out.append((i, len(w), sum(hit), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("chunk_bytes", [2000, 1 << 22])
def test_substring_matches_brute_force(docs, corpus, chunk_bytes):
    got = substring.covered_words(docs, substring._digests, substring.RESULT, chunk_bytes)
    assert sorted_rows(got, "doc_id", "n_words", "n_removed", "kept_sha256") == brute_substring(corpus)


def test_substring_rewrite_keeps_columns(docs):
    out = substring.rewrite(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    changed = substring.dedup(docs).where("n_removed > 0").count()
    assert changed > 0
    assert out.where("text is null").count() == docs.where("text is null").count()


def test_substring_empty(empty):
    assert substring.dedup_digest(empty).collect() == [] and substring.rewrite(empty).collect() == []


def test_cover_meets_every_shift():
    p, d = substring.PERIOD, substring.COVER
    assert all(any((i + k) % p in d and (j + k) % p in d for k in range(p)) for i in range(p) for j in range(p))
    assert substring.ANCHOR + p - 1 == substring.WIDTH


def shingles(text):
    w = ascii_lower(text).split()
    if len(w) < 5:
        return frozenset([tuple(w)] if w else [])
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4))


def brute_jaccard(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in sets if i is not None}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    index = defaultdict(list)
    for k, (i, s) in enumerate(sets):
        if i is not None:
            for g in s:
                index[g].append(k)
    for k, (i, s) in enumerate(sets):
        common = Counter(j for g in s if i is not None for j in index[g] if j < k)
        for j, n in common.items():
            if 100 * n >= 75 * (len(s) + len(sets[j][1]) - n):
                a, b = find(i), find(sets[j][0])
                parent[max(a, b)] = min(a, b)
    return sorted([(i, len(s), None if i is None else find(i)) for i, s in sets], key=repr)


@pytest.mark.parametrize("chunk_bytes", [2000, 1 << 22])
def test_jaccard_matches_brute_force(docs, corpus, chunk_bytes):
    got = jaccard.join(docs, chunk_bytes)
    assert sorted_rows(got, "doc_id", "n_shingles", "component_id") == brute_jaccard(corpus)


@pytest.mark.parametrize("block", [jaccard.BLOCK, 3])
def test_jaccard_tiles_find_what_stars_miss(spark, monkeypatch, block):
    """Without any star, all links must come from the tiles, and from every two slices of a large one."""
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "star_pairs", lambda live: spark.createDataFrame([], "a long, b long"))
    words = [f"w{k}" for k in range(60)]
    rows = [(k, " ".join(words[:k] + [f"new{k}"] + words[k + 1 :])) for k in range(0, 40, 4)] + [(100, " ".join(words)), (101, " ".join(words[:55]))]
    got = jaccard.join(spark.createDataFrame(rows, "doc_id long, text string"), 300)
    assert sorted_rows(got, "doc_id", "n_shingles", "component_id") == brute_jaccard(rows)


def test_large_tiles_are_cut_and_lose_no_pair(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 10)
    rows = spark.createDataFrame([(1, 0, k) for k in range(95)] + [(2, 0, k) for k in range(10)], "token long, band int, doc_id long")
    tiles = {}
    for r in jaccard._sliced(rows).collect():
        tiles.setdefault((r["token"], r["a"], r["b"]), []).append((r["doc_id"], r["side"]))
    met = Counter()
    for (token, a, b), found in tiles.items():
        assert len(found) < 50
        for i, (x, s) in enumerate(found):
            met.update((token, *sorted((x, y))) for y, t in found[i + 1 :] if a == b or s != t)
    assert set(met) == {(1, i, j) for i in range(95) for j in range(i + 1, 95)} | {(2, i, j) for i in range(10) for j in range(i + 1, 10)}
    assert set(met.values()) == {1}


def test_jaccard_keep_first_and_empty(docs, empty, corpus):
    kept = jaccard.keep_first(docs)
    assert kept.columns == docs.columns
    brute = brute_jaccard(corpus)
    assert kept.count() == sum(c is None or i == c for i, _, c in brute)
    assert jaccard.join(empty).collect() == []


def test_components_chain_and_cycle(spark):
    edges = [(k, k + 1) for k in range(1, 30)] + [(50, 51), (51, 52), (52, 50), (7, 7), (None, 3)]
    got = {r[0]: r[1] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 1 for k in range(1, 31)}, 50: 50, 51: 50, 52: 50}
