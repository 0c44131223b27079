"""Adaptive fusion against plain Python."""

import random

import pytest

from lodestone.functions import fusion


def percentile(values, p):
    s = sorted(values)
    at = p * (len(s) - 1)
    low = int(at)
    return s[low] + (at - low) * (s[min(low + 1, len(s) - 1)] - s[low])


def brute(text, vector, words, depth):
    out = {}
    for q, n in words.items():
        legs = []
        for leg in (text, vector):
            mine = dict(sorted(((k, s) for (a, k), s in leg.items() if a == q), key=lambda r: (-round(r[1], 9), r[0]))[:depth])
            mid, high, top = (percentile(mine.values(), 0.5), percentile(mine.values(), 0.95), max(mine.values())) if mine else (0, 0, 0)
            scale = (lambda x: (x - mid) / (high - mid)) if high - mid > 1e-9 else (lambda x: x / (top if top > 0 else 1))
            legs.append({k: min(1, max(0, scale(x))) for k, x in mine.items()})
        t, v = legs
        a = 0.7 if n <= 2 else 0.3
        if t and not v:
            a = 1
        elif v and not t:
            a = 0
        else:
            a = min(a + 0.1, 1) if len(v) / depth < 0.3 else a
            a = max(a - 0.1, 0) if len(t) / depth < 0.3 else a
        a = min(0.8, max(0.2, a))
        out |= {(q, k): a * t.get(k, 0) + (1 - a) * v.get(k, 0) for k in t.keys() | v.keys()}
    return out


def test_fusion_equals_brute_force(spark):
    rng = random.Random(3)
    sizes = {1: (30, 30), 2: (0, 12), 3: (12, 0), 4: (2, 30), 5: (30, 2), 6: (0, 0), 7: (8, 8)}
    words = {1: 5, 2: 1, 3: 9, 4: 2, 5: 3, 6: 4, 7: 0}
    text = {(q, k): round(rng.random() * 9, 3) for q, (n, _) in sizes.items() for k in rng.sample(range(50), n)}
    vector = {(q, k): round(rng.random(), 1) for q, (_, n) in sizes.items() for k in rng.sample(range(50), n)}
    text |= {(7, k): 4.0 for k in range(3)}
    vector |= {key: 0.0 for key in vector if key[0] == 7}  # all scores alike
    frame = lambda leg: spark.createDataFrame([(q, k, s) for (q, k), s in leg.items()], "item long, doc long, score double")
    for depth in (20, 10):
        got = fusion.adaptive(frame(text), frame(vector), spark.createDataFrame(sorted(words.items()), "item long, words int"), "item", "doc", depth).collect()
        want = brute(text, vector, words, depth)
        assert {(r["item"], r["doc"]): r["score"] for r in got} == pytest.approx(want)
