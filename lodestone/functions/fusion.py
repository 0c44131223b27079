"""Hybrid fusion with robust scaling and a text weight for each query.

A leg is cut to its ``depth`` best rows of a query first, so what follows is bounded for each query. Scores are
scaled from the leg's median to its 95th percentile and clamped to 0 and 1; where these two are equal,
by the largest score. The weight of the text leg starts at ``ALPHA``; it is raised for short queries, taken whole or to
nothing where a leg is empty, moved by ``STEP`` towards the other leg where one is sparse, and clamped.

Defined cases: a missing row of a leg counts 0; a query without rows in either leg has none; scores that are all
0 or less are 0; ties in a leg go to the smaller key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# The settings of the fusion.
ALPHA, SHORT_ALPHA, SHORT_TOKENS = 0.3, 0.7, 2
SPARSE, STEP = 0.3, 0.1
LEAST, MOST = 0.2, 0.8
TOKEN = "[A-Za-zА-Яа-яЁё0-9]+"


def tokens(text: Column) -> Column:
    """Words of a query, as the weight counts them."""
    return F.size(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)))


def _cut(leg: DataFrame, query: str, key: str, depth: int) -> DataFrame:
    order = W.partitionBy(query).orderBy(F.desc(F.round("score", 9)), key)
    return leg.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= depth).select(query, key, "score")


def scaled(leg: DataFrame, query: str, key: str) -> tuple[DataFrame, DataFrame]:
    """(query, key, value) scaled from median to 95th percentile, and the rows of each query."""
    stats = leg.groupBy(query).agg(F.percentile("score", F.lit(0.5)).alias("_mid"), F.percentile("score", F.lit(0.95)).alias("_high"), F.max("score").alias("_top"), F.count("*").alias("rows"))
    spread = F.col("_high") - F.col("_mid")
    value = F.when(spread > 1e-9, (F.col("score") - F.col("_mid")) / spread).otherwise(F.col("score") / F.when(F.col("_top") > 0, F.col("_top")).otherwise(1.0))
    return leg.join(stats, query).select(query, key, F.least(F.lit(1.0), F.greatest(F.lit(0.0), value)).alias("value")), stats.select(query, "rows")


def alpha(words: Column, text_rows: Column, vector_rows: Column, depth: int) -> Column:
    """Weight of the text leg of a query."""
    start = F.when(words <= SHORT_TOKENS, F.lit(max(ALPHA, SHORT_ALPHA))).otherwise(F.lit(ALPHA))
    up = F.when(vector_rows / depth < SPARSE, F.least(start + STEP, F.lit(1.0))).otherwise(start)
    down = F.when(text_rows / depth < SPARSE, F.greatest(up - STEP, F.lit(0.0))).otherwise(up)
    chosen = F.when((vector_rows == 0) & (text_rows > 0), F.lit(1.0)).when((text_rows == 0) & (vector_rows > 0), F.lit(0.0)).otherwise(down)
    return F.least(F.lit(MOST), F.greatest(F.lit(LEAST), chosen))


def adaptive(text_leg: DataFrame, vector_leg: DataFrame, words: DataFrame, query: str, key: str, depth: int = 200) -> DataFrame:
    """(query, key, score) of both legs; ``words`` has the query and ``words``, how many it has."""
    t, t_rows = scaled(_cut(text_leg, query, key, depth), query, key)
    v, v_rows = scaled(_cut(vector_leg, query, key, depth), query, key)
    weight = words.join(t_rows.withColumnRenamed("rows", "_t"), query, "left").join(v_rows.withColumnRenamed("rows", "_v"), query, "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    weight = weight.select(query, alpha(F.col("words"), zero("_t"), zero("_v"), depth).alias("alpha"))
    both = t.withColumnRenamed("value", "t").join(v.withColumnRenamed("value", "v"), [query, key], "full").join(weight, query)
    none = F.lit(0.0)
    return both.select(query, key, (F.col("alpha") * F.coalesce("t", none) + (1 - F.col("alpha")) * F.coalesce("v", none)).alias("score"))
