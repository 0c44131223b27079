"""Quality rules as weak supervision, in DataFrame functions only.

Each rule votes good (+1) or bad (-1), or abstains (0), by a measure of the
text: good in the range of ordinary prose, bad well outside, nothing between.
The rules overlap and contradict each other: a text of odd symbols has good
line lengths, a short note has good letters. No rule is trusted as such.
Expectation-maximisation over all documents that pass the base rule estimates
the share of good documents and, for each rule, how often it votes good, votes
bad or abstains on good and on bad documents. A document is kept if the
posterior probability that it is good, given all votes, is at least one half. So
votes that come together on the same documents gain weight, and a rule that
votes alike on both classes loses it, whatever the majority says.

Votes take few values, so the data for the estimate are the counts of the vote
patterns, at most 3 to the number of rules whatever the input; the iterations
run on those. Features are computed once and written to shared storage; the
posterior is then a sum of literals by vote.

The estimate has a prior of ``PRIOR`` documents: the share ``GOOD_SHARE``, and
for each class the vote shares in ``EXPECTED``, by which rules are more often
right than wrong. It settles empty and tiny inputs and keeps the classes from
changing places.

Defined cases: a null text has no words; so has an empty one: both fail the base
rule. Documents that fail it are given the posterior of their votes, too, and are
not kept. Repeated rows and ids are judged each on its own. Other columns are
kept by ``keep_good`` and ignored by ``judge``.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.session import materialise

SPACE = r"[ \t-\r]+"
SYMBOLS = r"[^#*$%&|<>]+"
#: Documents' worth of belief in what follows.
PRIOR = 10.0
GOOD_SHARE = 0.8
#: Expected shares of votes (bad, none, good) on bad and on good documents.
EXPECTED = ((0.3, 0.3, 0.4), (0.02, 0.3, 0.68))
ROUNDS, SETTLED = 200, 1e-9
KEEP_AT = 0.5


def _ratio(a: str, b: str) -> Column:
    return F.col(a) / F.greatest(F.col(b), F.lit(1))


@dataclass(frozen=True)
class Rule:
    """Votes good where ``good`` holds, else bad where ``bad`` holds, else abstains."""

    name: str
    good: Column
    bad: Column

    def vote(self) -> Column:
        return F.when(self.good, F.lit(1)).when(self.bad, F.lit(-1)).otherwise(F.lit(0))


def _within(x: Column, low: float, high: float) -> Column:
    return (x >= low) & (x <= high)


def _outside(x: Column, low: float, high: float) -> Column:
    return (x < low) | (x > high)


def rules() -> list[Rule]:
    symbols, repeats = _ratio("n_symbols", "n_words"), _ratio("n_repeat_words", "n_words")
    copies, length = _ratio("n_dup_lines", "n_lines"), _ratio("word_chars", "n_words")
    capitals, shouts, stops = _ratio("n_upper", "word_chars"), _ratio("n_shouts", "n_words"), _ratio("n_stops", "n_words")
    line = _ratio("n_words", "n_lines")
    odd = (F.col("n_symbols") + F.col("n_shouts")) / F.greatest(F.col("word_chars"), F.lit(1))
    return [
        Rule("symbols", symbols < 0.02, symbols > 0.2),
        Rule("odd characters", odd < 0.004, odd > 0.04),
        Rule("word length", _within(length, 4.2, 6.0), _outside(length, 3.5, 6.8)),
        Rule("punctuation", _within(stops, 0.08, 0.25), _outside(stops, 0.04, 0.5)),
        Rule("capitals", _within(capitals, 0.005, 0.04), capitals > 0.2),
        Rule("shouts", F.lit(False), shouts > 0.2),
        Rule("repeated words", repeats < 0.05, repeats > 0.3),
        Rule("repeated lines", (F.col("n_lines") >= 3) & (copies < 0.05), copies > 0.3),
        Rule("line length", _within(line, 12, 100), _outside(line, 6, 300)),
        Rule("length", F.col("n_words") >= 150, F.col("n_words") < 80),
    ]


def features(rows: DataFrame) -> DataFrame:
    """The columns ``row`` and the counts that the rules read, of (row, text); a projection of each row.

    Words of 3-word windows that stand twice in a text: window hashes are
    compared as a set first; only a text in which a hash repeats is sorted.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    out = rows.withColumn("__words", F.array_remove(F.split(text, SPACE), "")).withColumn(
        "__lines", F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^ \t-\r]"))
    )
    words, n = F.col("__words"), F.size("__words")
    window = F.when(
        n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    ).otherwise(F.array().cast("array<bigint>"))
    out = out.withColumn("__h", window)
    h = F.col("__h")
    placed = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    out = out.withColumn("__s", F.when(F.size(F.array_distinct(h)) < F.size(h), placed))
    s = F.col("__s")
    twice = F.filter(s, lambda x, j: (F.get(s, j - 1)["h"] == x["h"]) | (F.get(s, j + 1)["h"] == x["h"]))
    out = out.withColumn("__t", F.transform(twice, lambda x: x["i"]))
    t = F.col("__t")
    cover = F.array_distinct(F.concat(t, F.transform(t, lambda i: i + 1), F.transform(t, lambda i: i + 2)))
    joined = F.array_join(words, "")
    return out.select(
        "row",
        n.cast("long").alias("n_words"),
        F.length(joined).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(joined, SYMBOLS, "")).cast("long").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.when(t.isNull(), F.lit(0)).otherwise(F.size(cover)).cast("long").alias("n_repeat_words"),
        F.size("__lines").cast("long").alias("n_lines"),
        F.length(F.regexp_replace(joined, "[^A-Z]+", "")).cast("long").alias("n_upper"),
        F.length(F.regexp_replace(joined, "[^!]+", "")).cast("long").alias("n_shouts"),
        F.length(F.regexp_replace(joined, "[^.,;:?]+", "")).cast("long").alias("n_stops"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (F.lit(100) * F.col("n_repeat_words") > F.lit(50) * F.col("n_words"))


@dataclass(frozen=True)
class VoteModel:
    """Share of good documents, and the shares of votes (bad, none, good) by class (bad, good) and rule."""

    good: float
    votes: tuple[tuple[tuple[float, float, float], ...], ...]

    def weights(self) -> tuple[float, list[tuple[float, float, float]]]:
        """Log odds of good: the constant, and what each vote of a rule adds."""
        bad, good = self.votes
        return math.log(self.good / (1 - self.good)), [tuple(math.log(g / b) for g, b in zip(x, y)) for x, y in zip(good, bad)]

    def accuracies(self) -> list[float]:
        """Chance that a rule's vote is right, where it votes."""
        bad, good = self.votes
        right = [self.good * g[2] + (1 - self.good) * b[0] for g, b in zip(good, bad)]
        cast = [self.good * (g[0] + g[2]) + (1 - self.good) * (b[0] + b[2]) for g, b in zip(good, bad)]
        return [r / c for r, c in zip(right, cast)]


def _chance(odds: float) -> float:
    return 1 / (1 + math.exp(-odds)) if odds > -700 else 0.0


def fit(patterns: Sequence[tuple[tuple[int, ...], int]], n_rules: int, rounds: int = ROUNDS) -> VoteModel:
    """Expectation-maximisation over (votes, count) patterns."""
    model = VoteModel(GOOD_SHARE, tuple((EXPECTED[y],) * n_rules for y in (0, 1)))
    total = PRIOR + sum(n for _, n in patterns)
    for _ in range(rounds):
        start, each = model.weights()
        seen = [[[PRIOR * e for e in EXPECTED[y]] for _ in range(n_rules)] for y in (0, 1)]
        good = PRIOR * GOOD_SHARE
        for votes, count in patterns:
            p = _chance(start + sum(w[v + 1] for w, v in zip(each, votes)))
            good += count * p
            for k, v in enumerate(votes):
                seen[0][k][v + 1] += count * (1 - p)
                seen[1][k][v + 1] += count * p
        was, model = model.good, VoteModel(good / total, tuple(tuple(tuple(x / sum(row) for x in row) for row in y) for y in seen))
        if abs(model.good - was) < SETTLED:
            break
    return model


def posterior(model: VoteModel, votes: list[Column]) -> Column:
    start, each = model.weights()
    odds = F.lit(start)
    for w, v in zip(each, votes):
        odds = odds + F.when(v > 0, F.lit(w[2])).when(v < 0, F.lit(w[0])).otherwise(F.lit(w[1]))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-odds))


def _rows(docs: DataFrame, *columns: str) -> DataFrame:
    """(row, text): the named columns, or all, as one struct, whatever their names."""
    names = columns or tuple(docs.columns)
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col("text"))


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts, base_failed, kept and the posterior; texts are read once and not written again."""
    table = _verdicts(materialise(features(_rows(docs, "doc_id")), "quality"))
    return table.select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns kept, that the rules keep."""
    return _verdicts(materialise(features(_rows(docs)), "quality")).where("kept").select("row.*")


def _verdicts(table: DataFrame) -> DataFrame:
    votes = [r.vote() for r in rules()]
    named = [f"v{k}" for k in range(len(votes))]
    counted = table.where(~base_failed()).select(*[v.alias(k) for k, v in zip(named, votes)]).groupBy(*named).count()
    patterns = sorted((tuple(int(x) for x in r[:-1]), int(r[-1])) for r in counted.collect())
    model = fit(patterns, len(votes))
    return (
        table.withColumn("base_failed", base_failed())
        .withColumn("quality", posterior(model, votes))
        .withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= KEEP_AT))
    )
