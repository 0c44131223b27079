import random

import pytest

WORDS = [a + b for a in ("ba", "ke", "li", "mo", "nu", "Ra", "sé", "to") for b in ("n", "r", "st", "X", "li", "mo9")]
SCHEMA = "doc_id long, text string, lang string, chunk long, payload string, n_words string, kept string, bucket int, score string, label int"


def prose(rng: random.Random, n: int) -> str:
    out = []
    for k in range(n):
        out.append(rng.choice(WORDS) + rng.choice(["", "", "", ",", "."]))
        out.append(rng.choice([" ", " ", " ", " ", "  ", "\n", "\t"]) if k % 9 == 0 else " ")
    return "".join(out)


@pytest.fixture(scope="session")
def corpus():
    """Rows with copies, near copies, shared passages, nulls, empty and long texts; columns with awkward names."""
    rng = random.Random(7)
    base = [prose(rng, rng.randint(1, 120)) for _ in range(40)]
    passage = " ".join(rng.choice(WORDS) for _ in range(30))
    texts = list(base)
    texts += [base[3]] * 6
    for k in range(8):
        w = base[k].split(" ")
        if len(w) > 3:
            w[rng.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    texts += [base[k] + " " + passage + " " + base[k + 1] for k in range(6)]
    texts += [passage, passage.upper(), None, "", " ", "\n\t ", "one", "one two", "one two", "ein é 日本 🎉", "x" * 5000, "a " * 3000, prose(rng, 60_000)]
    texts.append(texts[-1] + " tail")
    rng.shuffle(texts)
    ids = [k * 3 for k in range(len(texts))]
    rows = [(i, t) for i, t in zip(ids, texts)]
    rows += [rows[0], rows[1], (None, base[5]), (None, None), (ids[2], base[9])]
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame([(i, t, "en", 1, "p", "w", "k", 2, "s", 3) for i, t in corpus], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(docs):
    return docs.where("false")


def sorted_rows(df, *columns):
    return sorted([tuple(r) for r in df.select(*columns).collect()], key=repr)
