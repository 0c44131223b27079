"""Text functions, lexical and hybrid retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions import fusion as U
from lodestone.functions import retrieval as V
from lodestone.functions import text as T
from lodestone.functions import vectors as N
from lodestone.operators import relational as R
from lodestone.plans.core import Data, add
from lodestone.session import materialise
from lodestone.sources.projection import once

_STOP = "('the', 'and', 'for', 'that', 'with', 'this')"


def _toks(column: str) -> str:
    return f"list_filter(regexp_extract_all(lower(regexp_replace({column}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[a-z0-9_]{{3,}}'), lambda w: w NOT IN {_STOP})"


add("tx01_tokenise", f"SELECT doc_id, len({_toks('text')}) AS n, array_to_string({_toks('text')}[1:8], ' ') AS head FROM documents", lambda d: d.documents.withColumn("w", T.tokens("text")).select("doc_id", F.size("w").cast("long").alias("n"), F.array_join(F.slice("w", 1, 8), " ").alias("head")))
add(
    "tx02_synonyms",
    "SELECT item_id, array_to_string(flatten(list_transform(regexp_extract_all(lower(text), '[a-z0-9_]{3,}'), lambda w: CASE w WHEN 'the' THEN ['the', 'der', 'les'] WHEN 'with' THEN ['with', 'mit', 'avec'] WHEN 'from' THEN ['from', 'von'] ELSE [w] END)), ' ') AS expanded FROM benchmark",
    lambda d: d.benchmark.select("item_id", F.array_join(T.expand_synonyms(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9_]{3,}"), F.lit(0))), " ").alias("expanded")),
)
_POST = f"post AS (SELECT doc_id, token, count(*) AS tf FROM (SELECT doc_id, unnest({_toks('text')}) AS token FROM documents) x GROUP BY doc_id, token)"
_STATS = "stats AS (SELECT count(DISTINCT doc_id) AS docs, sum(tf) AS total FROM post), lens AS (SELECT doc_id, sum(tf) AS len FROM post GROUP BY doc_id), dfs AS (SELECT token, count(*) AS df FROM post GROUP BY token)"
_QUERY = f"query AS (SELECT item_id, token, count(*) AS qf FROM (SELECT item_id, unnest({_toks('text')}) AS token FROM benchmark) x GROUP BY item_id, token)"
_BM25 = f"{_POST}, {_STATS}, {_QUERY}, scored AS (SELECT q.item_id, p.doc_id, sum(q.qf * ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / (total / docs)))) AS score FROM post p JOIN dfs USING (token) JOIN lens USING (doc_id) JOIN query q USING (token), stats GROUP BY q.item_id, p.doc_id)"


#: Indexed fields of a document: the text, its first line, and its source.
FIELDS = {"text": "text", "head": "split_part(text, '\n', 1)", "source": "source"}


def _index(d: Data, field: str = "text") -> DataFrame:
    """Postings of a field, tokenised and stored once."""
    return once(d.spark, d.sf_dir, f"postings-{field}", ("documents",), lambda: T.postings(d.documents, "doc_id", T.tokens(F.expr(FIELDS[field]))))


def _asked(d: Data) -> DataFrame:
    return once(d.spark, d.sf_dir, "asked", ("benchmark",), lambda: T.postings(d.benchmark, "item_id", T.tokens("text")).withColumnRenamed("tf", "qf"))


def _scored(d: Data) -> DataFrame:
    return T.bm25(_index(d), "doc_id", _asked(d), "item_id")


add("tx03_idf", f"WITH {_POST}, {_STATS} SELECT token, round(ln(1 + (docs - df + 0.5) / (df + 0.5)), 6) AS idf FROM dfs, stats", lambda d: (lambda p: p.groupBy("token").agg(F.count("*").alias("df")).crossJoin(F.broadcast(p.agg(F.countDistinct("doc_id").alias("n")))).select("token", F.round(T.idf(F.col("n"), F.col("df")), 6).alias("idf")))(_index(d)))
add("tx04_bm25", f"WITH {_BM25} SELECT item_id, doc_id, round(score, 5) AS score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 6) DESC, doc_id) AS k FROM scored) x WHERE k <= 5", lambda d: R.top_n(_scored(d), ["item_id"], [F.desc(F.round("score", 6)), "doc_id"], 5).select("item_id", "doc_id", F.round("score", 5).alias("score")))


def _block_max(d: Data, postings: DataFrame, name: str, weight, frequency: str = "tf") -> DataFrame:
    """The five best documents of each item by pruned scoring; impacts and their maxima by block are stored."""
    impact = once(d.spark, d.sf_dir, f"impacts-{name}", ("documents",), lambda: V.impacts(postings, "doc_id", T.K1, T.B, frequency))
    tops = once(d.spark, d.sf_dir, f"maxima-{name}", ("documents",), lambda: V.maxima(impact))
    asked = _asked(d)
    df = tops.join(asked.select("token").distinct(), "token", "left_semi").groupBy("token").agg(F.sum("df").alias("df"))
    docs = postings.agg(F.countDistinct("doc_id").alias("docs"))
    weights = asked.join(df, "token").crossJoin(F.broadcast(docs)).select("item_id", "token", weight(F.col("qf"), F.col("docs"), F.col("df")).alias("weight"))
    return V.top_k(impact, tops, weights, "doc_id", "item_id", 5).best.select("item_id", "doc_id", F.round("score", 5).alias("score"))


add(
    "tx04_block_max",
    f"WITH {_BM25} SELECT item_id, doc_id, round(score, 5) AS score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 6) DESC, doc_id) AS k FROM scored) x WHERE k <= 5",
    lambda d: _block_max(d, _index(d), "text", lambda qf, docs, df: qf * T.idf(docs, df)),
)


def _best(scored: DataFrame, n: int) -> DataFrame:
    """The n best documents of each item."""
    return R.top_n(scored, ["item_id"], [F.desc(F.round("score", 6)), "doc_id"], n).select("item_id", "doc_id", F.round("score", 5).alias("score"))


def _best_sql(scored: str, n: int) -> str:
    return f"SELECT item_id, doc_id, round(score, 5) AS score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 6) DESC, doc_id) AS k FROM {scored}) x WHERE k <= {n}"


#: Weights of the fields, and of the columns of the full-text table.
FIELD_WEIGHTS = {"text": 1.0, "head": 3.5, "source": 2.0}
COLUMN_WEIGHTS = {"text": 1.0, "head": 4.3, "source": 1.7}


def _field_postings(fields: dict[str, float]) -> str:
    """Postings of each field by name, with the field's weight."""
    parts = [f"SELECT doc_id, token, '{f}' AS field, CAST({w} AS DOUBLE) AS weight, count(*) AS tf FROM (SELECT doc_id, unnest({_toks(FIELDS[f])}) AS token FROM documents) x GROUP BY doc_id, token" for f, w in fields.items()]
    return "fpost AS MATERIALIZED (" + " UNION ALL ".join(parts).replace("'\n'", "chr(10)") + ")"


#: Scores of each field by itself: item_id, doc_id, field, score.
_FIELD_SCORES = """fstats AS (SELECT field, count(DISTINCT doc_id) AS docs, sum(tf) AS total FROM fpost GROUP BY field), flens AS (SELECT field, doc_id, sum(tf) AS len FROM fpost GROUP BY field, doc_id), fdfs AS (SELECT field, token, count(*) AS df FROM fpost GROUP BY field, token),
    fscored AS MATERIALIZED (SELECT q.item_id, p.doc_id, p.field, any_value(p.weight) AS weight, sum(q.qf * ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / (total / docs)))) AS score FROM fpost p JOIN fdfs USING (field, token) JOIN flens USING (field, doc_id) JOIN fstats USING (field) JOIN query q USING (token) GROUP BY q.item_id, p.doc_id, p.field)"""

add(
    "tx05_field_bm25",
    f"""WITH {_QUERY}, {_field_postings(FIELD_WEIGHTS)}, stats AS (SELECT field, count(DISTINCT doc_id) AS docs, sum(tf) AS total FROM fpost GROUP BY field), lens AS (SELECT field, doc_id, sum(tf) AS len FROM fpost GROUP BY field, doc_id), dfs AS (SELECT field, token, count(*) AS df FROM fpost GROUP BY field, token),
    scored AS (SELECT q.item_id, p.doc_id, sum(p.weight * q.qf * ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / (total / docs)))) AS score FROM fpost p JOIN dfs USING (field, token) JOIN lens USING (field, doc_id) JOIN stats USING (field) JOIN query q USING (token) GROUP BY q.item_id, p.doc_id)
    {_best_sql("scored", 3)}""",
    lambda d: _best(T.field_bm25({f: (_index(d, f), w) for f, w in FIELD_WEIGHTS.items()}, "doc_id", _asked(d), "item_id"), 3),
)
add(
    "tx06_weighted_columns",
    f"""WITH {_QUERY}, {_field_postings(COLUMN_WEIGHTS)}, rows_ AS (SELECT doc_id, token, sum(tf) AS tf, sum(tf * weight) AS f FROM fpost GROUP BY doc_id, token), stats AS (SELECT count(DISTINCT doc_id) AS docs, sum(tf) AS total FROM rows_), lens AS (SELECT doc_id, sum(tf) AS len FROM rows_ GROUP BY doc_id), dfs AS (SELECT token, count(*) AS df FROM rows_ GROUP BY token),
    scored AS (SELECT q.item_id, p.doc_id, sum(greatest(1e-6, ln((docs - df + 0.5) / (df + 0.5))) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len / (total / docs)))) AS score FROM rows_ p JOIN dfs USING (token) JOIN lens USING (doc_id) JOIN query q USING (token), stats GROUP BY q.item_id, p.doc_id)
    {_best_sql("scored", 3)}""",
    lambda d: _best(T.column_bm25({f: (_index(d, f), w) for f, w in COLUMN_WEIGHTS.items()}, "doc_id", _asked(d), "item_id"), 3),
)
add("tx07_sanitise", "SELECT item_id, array_to_string(list_slice(list_transform(list_sort(list_transform(list_distinct(w), lambda x: [list_position(w, x)::VARCHAR.lpad(6, '0'), x])), lambda y: y[2]), 1, 12), ' OR ') AS terms FROM (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9_]{3,}') AS w FROM benchmark) q".replace("list_position(w, x)::VARCHAR.lpad(6, '0')", "lpad(CAST(list_position(w, x) AS VARCHAR), 6, '0')"), lambda d: d.benchmark.select("item_id", T.sanitise(F.col("text")).alias("terms")))
add("tx08_escape", r"""SELECT page_id, regexp_replace(url, '([+\-!(){}\[\]^"~*?:\\/&|])', '\\\1', 'g') AS escaped FROM pages""", lambda d: d.pages.select("page_id", T.escape_query(F.col("url")).alias("escaped")))
add("tx09_overlap", "SELECT c.item_id AS a, e.item_id AS b, round(len(list_intersect(string_split(c.text, ' '), string_split(e.text, ' '))) / len(list_distinct(string_split(c.text, ' '))), 6) AS ratio FROM benchmark c JOIN benchmark e ON c.item_id + 1 = e.item_id", lambda d: d.benchmark.select(F.col("item_id").alias("a"), F.split("text", " ").alias("x")).join(d.benchmark.select((F.col("item_id") - 1).alias("a"), F.col("item_id").alias("b"), F.split("text", " ").alias("y")), "a").select("a", "b", F.round(T.overlap(F.col("x"), F.col("y")), 6).alias("ratio")))
add("tx10_boost", "SELECT p_partkey, (CASE WHEN contains(lower(p_name), 'ing') THEN 2.0 ELSE 0.0 END + CASE WHEN starts_with(p_type, 'S') THEN 1.0 ELSE 0.0 END) * CASE WHEN p_brand IN ('Brand#11', 'Brand#12') THEN 0.5 ELSE 1.0 END::DOUBLE AS boost FROM part", lambda d: d.part.select("p_partkey", ((F.when(F.lower("p_name").contains("ing"), 2.0).otherwise(0.0) + F.when(F.col("p_type").startswith("S"), 1.0).otherwise(0.0)) * F.when(F.col("p_brand").isin("Brand#11", "Brand#12"), 0.5).otherwise(1.0)).alias("boost")))
_STEM = "CASE " + " ".join(f"WHEN ends_with(w, '{s}') AND length(w) - {len(s)} >= 4 THEN substring(w, 1, length(w) - {len(s)})" for s in T.SUFFIXES) + " ELSE w END"
add("tx11_stem", f"SELECT DISTINCT w, {_STEM} AS stem FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM benchmark) x", lambda d: d.benchmark.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("w")).distinct().select("w", T.stem(F.col("w")).alias("stem")))
add("tx12_fuzzy", None, lambda d: T.fuzzy_pairs(d.benchmark.select(F.explode(T.tokens("text")).alias("token")), 0.88))
add("tx13_quoted", "SELECT p_partkey, len(regexp_extract_all('\"' || p_type || '\" x \"' || p_brand || '\"', '\"([^\"]+)\"', 1)) AS phrases, regexp_extract('\"' || p_type || '\" x', '\"([^\"]+)\"', 1) = p_type AS boosted FROM part", lambda d: d.part.withColumn("q", F.regexp_extract_all(F.concat(F.lit('"'), "p_type", F.lit('" x "'), "p_brand", F.lit('"')), F.lit('"([^"]+)"'), F.lit(1))).select("p_partkey", F.size("q").cast("long").alias("phrases"), (F.get("q", F.lit(0)) == F.col("p_type")).alias("boosted")))
add("tx14_prefix_or_edit", "SELECT c_custkey FROM customer WHERE starts_with(lower(c_mktsegment), 'build') OR levenshtein(lower(c_mktsegment), 'machinerx') <= 1", lambda d: d.customer.where(F.lower("c_mktsegment").startswith("build") | (F.levenshtein(F.lower("c_mktsegment"), F.lit("machinerx")) <= 1)).select("c_custkey"))
add("tx15_joined_name", "SELECT o_orderkey, translate(lower(o_orderpriority), 'ё _-', 'е') AS joined FROM orders", lambda d: d.orders.select("o_orderkey", T.joined_name(F.col("o_orderpriority")).alias("joined")))
add("tx16_canonical_category", "SELECT DISTINCT c_custkey, k.canon FROM customer JOIN (VALUES ('BUILDING', 'construction'), ('BUILDING', 'housing'), ('MACHINERY', 'industry'), ('HOUSEHOLD', 'housing')) k(seg, canon) ON c_mktsegment = k.seg", lambda d: d.customer.join(F.broadcast(d.spark.createDataFrame([("BUILDING", ["construction", "housing"]), ("MACHINERY", ["industry"]), ("HOUSEHOLD", ["housing"])], "c_mktsegment string, canon array<string>")), "c_mktsegment").select("c_custkey", F.explode("canon").alias("canon")).distinct())
#: A line of code for each part.
_CODE = """concat('Sel = Catalogs.Part', CAST(p_partkey AS STRING), '.Find("x', CAST(p_size AS STRING), '"); Query.Text = "SELECT * FROM Document.D', CAST(p_size AS STRING), '"; Lib.Run(Sel); Total = Sum(Sel); Run(Total); Doc = Documents.D', CAST(p_size AS STRING), '; Sum(Doc);')"""
_terms = lambda kind: f"regexp_extract_all(code, '{T.TERMS[kind]}', 1)"
add(
    "tx17_structural_terms",
    "SELECT p_partkey, " + ", ".join(f"array_to_string({_terms(k)}, ',') AS {k}" for k in T.TERMS) + f" FROM (SELECT p_partkey, {_CODE} AS code FROM part) c",
    lambda d: d.part.select("p_partkey", F.expr(_CODE).alias("code")).select("p_partkey", *[F.array_join(T.structural_terms(F.col("code"), k), ",").alias(k) for k in T.TERMS]),
)
add("tx17_markup_terms", "SELECT page_id, array_to_string(list_sort(list_distinct(regexp_extract_all(html, '<([a-z0-9]+)', 1))), ',') AS terms FROM pages", lambda d: d.pages.select("page_id", F.array_join(F.array_sort(F.array_distinct(F.regexp_extract_all("html", F.lit("<([a-z0-9]+)"), F.lit(1)))), ",").alias("terms")))
add("tx18_line_features", "SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '^[A-Z]'))) AS headers, len(list_filter(string_split(text, chr(10)), lambda l: contains(l, '|'))) AS tables FROM documents", lambda d: d.documents.select("doc_id", F.size(F.filter(F.split("text", "\n"), lambda x: x.rlike("^[A-Z]"))).cast("long").alias("headers"), F.size(F.filter(F.split("text", "\n"), lambda x: x.contains("|"))).cast("long").alias("tables")))
add("tx19_search_text", "SELECT doc_id, sha256(repeat(lang || ' ', 6) || repeat(source || ' ', 6) || text) AS h FROM documents", lambda d: d.documents.select("doc_id", F.sha2(F.concat(F.repeat(F.concat("lang", F.lit(" ")), 6), F.repeat(F.concat("source", F.lit(" ")), 6), "text"), 256).alias("h")))
add("tx20_chunks", None, lambda d: T.chunk(d.documents, "doc_id", "text", 1000, 100))
add("tx20_fixed_width", "SELECT doc_id, i AS part, substring(text, CAST(i * 900 + 1 AS BIGINT), 1000) AS chunk FROM (SELECT doc_id, text, unnest(range(0, CAST(ceil(length(text) / 900.0) AS BIGINT))) AS i FROM documents) x", lambda d: d.documents.select("doc_id", "text", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.length("text") / 900.0) - 1, F.lit(0)).cast("int"))).alias("i")).where("length(text) > 0").select("doc_id", F.col("i").cast("long").alias("part"), F.substring("text", F.col("i") * 900 + 1, F.lit(1000)).alias("chunk")))
add("tx21_sliding_split", None, lambda d: T.chunk(d.documents, "doc_id", "text", 3600, 720, 480).unionByName(T.chunk(d.documents, "doc_id", "text", 2200, 440, 300)))
add("tx22_lexical_dedup", "SELECT item_id, CASE WHEN length(short) < length(text) THEN short ELSE text END AS packed FROM (SELECT item_id, text, array_to_string(list_transform(list_sort(list_transform(list_distinct(w), lambda x: [lpad(CAST(list_position(w, x) AS VARCHAR), 6, '0'), x])), lambda y: y[2]), ' ') AS short FROM (SELECT item_id, text, string_split(text, ' ') AS w FROM benchmark) q) z", lambda d: d.benchmark.withColumn("short", F.array_join(F.array_distinct(F.split("text", " ")), " ")).select("item_id", F.when(F.length("short") < F.length("text"), F.col("short")).otherwise(F.col("text")).alias("packed")))
add("tx23_context_prefix", "SELECT doc_id, concat_ws(' > ', lang, source, CAST(doc_id AS VARCHAR)) || chr(10) || text AS embed_text FROM documents", lambda d: d.documents.select("doc_id", F.concat(F.concat_ws(" > ", "lang", "source", F.col("doc_id").cast("string")), F.lit("\n"), "text").alias("embed_text")))
add("tx24_line_slice", "SELECT doc_id, array_to_string(list_slice(string_split(text, chr(10)), 2, 3), chr(10)) AS lines FROM documents", lambda d: d.documents.select("doc_id", T.line_slice(F.col("text"), 2, 3).alias("lines")))
_COSINE = "list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))"
add(
    "tx25_cosine",
    f"SELECT query_id, vec_id, round(similarity, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(similarity, 9) DESC, vec_id) AS k FROM (SELECT q.vec_id AS query_id, v.vec_id, greatest(0, {_COSINE}) AS similarity FROM embeddings v, embeddings q WHERE q.vec_id % 100 = 0) p) x WHERE k <= 20",
    lambda d: T.nearest(d.embeddings, d.embeddings.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id"), "vec_id", "embedding", "query_id", 20).select("query_id", "vec_id", F.round("score", 6).alias("similarity")),
)
add("tx26_object_hash", "SELECT n_nationkey, sha256('{\"k\":' || CAST(n_nationkey AS VARCHAR) || ',\"name\":\"' || n_name || '\"}') AS h FROM nation", lambda d: d.nation.select("n_nationkey", F.sha2(F.to_json(F.struct(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"))), 256).alias("h")))
add("tx27_routine_hashes", "SELECT p_partkey, sha256(p_name) AS doc_hash, sha256(concat_ws('|', p_brand, p_type)) AS signature_hash, sha256(concat_ws('|', p_name, p_brand, p_type, CAST(p_size AS VARCHAR))) AS state_hash FROM part", lambda d: d.part.select("p_partkey", F.sha2("p_name", 256).alias("doc_hash"), F.sha2(F.concat_ws("|", "p_brand", "p_type"), 256).alias("signature_hash"), F.sha2(F.concat_ws("|", "p_name", "p_brand", "p_type", F.col("p_size").cast("string")), 256).alias("state_hash")))
add("tx28_canonical_markup", "SELECT page_id, sha256(lower(regexp_replace(regexp_replace(html, ' id=\"[^\"]*\"', '', 'g'), '[ \\t\\r\\n]+', ' ', 'g'))) AS h FROM pages", lambda d: d.pages.select("page_id", F.sha2(F.lower(F.regexp_replace(F.regexp_replace("html", ' id="[^"]*"', ""), r"[ \t\r\n]+", " ")), 256).alias("h")))
add("tx29_type_display", "SELECT p_type, array_to_string(list_sort(list_distinct(string_split(p_type || ',' || replace(p_type, 'A', 'B'), ','))), ' | ') AS display, count(*) AS n FROM part GROUP BY p_type", lambda d: d.part.groupBy("p_type").agg(F.count("*").alias("n")).select("p_type", F.array_join(F.array_sort(F.array_distinct(F.split(F.concat("p_type", F.lit(","), F.replace("p_type", F.lit("A"), F.lit("B"))), ","))), " | ").alias("display"), "n"))
add("tx30_translation", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'Завершён' WHEN 'O' THEN 'Открыт' ELSE o_orderstatus END AS status_ru FROM orders", lambda d: d.orders.withColumn("m", F.create_map(F.lit("F"), F.lit("Завершён"), F.lit("O"), F.lit("Открыт"))).select("o_orderkey", F.coalesce(F.col("m")[F.col("o_orderstatus")], "o_orderstatus").alias("status_ru")))
add("tx31_dictionary_encoding", "SELECT c_custkey, '@seg:' || CAST(dense_rank() OVER (ORDER BY f) AS VARCHAR) AS code FROM (SELECT c_custkey, min(c_custkey) OVER (PARTITION BY c_mktsegment) AS f FROM customer) x", lambda d: (lambda first: d.customer.join(F.broadcast(first.withColumn("no", F.dense_rank().over(W.orderBy("f")))), "c_mktsegment").select("c_custkey", F.concat(F.lit("@seg:"), F.col("no").cast("string")).alias("code")))(d.customer.groupBy("c_mktsegment").agg(F.min("c_custkey").alias("f"))))
add("tx32_best_prefix", "SELECT prefix, n, gain FROM (SELECT prefix, count(*) AS n, count(*) * (length(prefix) - 3) AS gain FROM (SELECT unnest([substring(c_name, 1, 6), substring(c_name, 1, 10), substring(c_name, 1, 14), substring(c_name, 1, 16)]) AS prefix FROM customer) x GROUP BY prefix HAVING count(*) >= 2) y ORDER BY gain DESC, prefix LIMIT 1", lambda d: d.customer.select(F.explode(F.array(*[F.substring("c_name", 1, k) for k in (6, 10, 14, 16)])).alias("prefix")).groupBy("prefix").agg(F.count("*").alias("n")).where("n >= 2").withColumn("gain", F.col("n") * (F.length("prefix") - 3)).orderBy(F.desc("gain"), "prefix").limit(1))
add("tx33_drop_empty", "SELECT n_nationkey, concat_ws(';', CASE WHEN n_regionkey > 0 THEN 'region=' || CAST(n_regionkey AS VARCHAR) END, 'name=' || n_name) AS kept FROM nation", lambda d: d.nation.select("n_nationkey", F.array_join(F.transform(F.filter(F.array(F.struct(F.lit("region").alias("k"), F.when(F.col("n_regionkey") > 0, F.col("n_regionkey").cast("string")).alias("v")), F.struct(F.lit("name").alias("k"), F.col("n_name").alias("v"))), lambda e: e["v"].isNotNull() & (e["v"] != "")), lambda e: F.concat_ws("=", e["k"], e["v"])), ";").alias("kept")))
add(
    "tx34_code_facts",
    f"""WITH c AS (SELECT p_partkey, {_CODE} AS code FROM part), f AS ({" UNION ALL ".join(f"SELECT p_partkey, {prio} AS prio, i, '{mark}:' || l[i] AS fact FROM (SELECT p_partkey, {_terms(kind)} AS l FROM c) t, unnest(range(1, len(l) + 1)) u(i)" for prio, (kind, mark) in enumerate(T.FACTS))}),
    once AS (SELECT p_partkey, fact, min(prio * 1000 + i) AS place FROM f GROUP BY p_partkey, fact)
    SELECT p_partkey, string_agg(fact, ';' ORDER BY place) AS facts FROM (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY place) AS k FROM once) x WHERE k <= 6 GROUP BY p_partkey""",
    lambda d: d.part.select("p_partkey", F.array_join(T.code_facts(F.expr(_CODE), 6), ";").alias("facts")),
)
add("tx35_time_window", "SELECT event_id, (hour(ts) * 60 + minute(ts) >= 1380 OR hour(ts) * 60 + minute(ts) < 300) AS at_night FROM events", lambda d: (lambda m: d.events.select("event_id", ((m >= 1380) | (m < 300)).alias("at_night")))(F.hour("ts") * 60 + F.minute("ts")))
add("tx36_embedding_format", "SELECT item_id, CASE WHEN item_id % 2 = 0 THEN 'query: ' ELSE 'passage: ' END || text AS formatted FROM benchmark", lambda d: d.benchmark.select("item_id", F.concat(F.when(F.col("item_id") % 2 == 0, "query: ").otherwise("passage: "), "text").alias("formatted")))

# --- retrieval -------------------------------------------------------------------------------------------------------

#: Query vectors are those of ids divisible by 100; the k-th of them belongs to the k-th item.
_VEC = f"vec AS (SELECT q.vec_id // 100 AS item_id, v.vec_id AS doc_id, greatest(0, {_COSINE}) AS score FROM embeddings v, embeddings q WHERE q.vec_id % 100 = 0)"


def _vector_leg(d: Data, keep: DataFrame | None = None, n: int = 200) -> DataFrame:
    """The n vectors nearest to every query vector, of all or of the documents ``keep``."""
    queries = d.embeddings.where("vec_id % 100 = 0").select((F.col("vec_id") / 100).cast("long").alias("item_id"), "embedding")
    vectors = d.embeddings.select(F.col("vec_id").alias("doc_id"), "embedding")
    return T.nearest(vectors if keep is None else vectors.join(keep, "doc_id", "left_semi"), queries, "doc_id", "embedding", "item_id", n)


def _similar(d: Data, pool: DataFrame) -> DataFrame:
    """Cosine of the pairs in ``pool`` alone."""
    queries = d.embeddings.where("vec_id % 100 = 0").select((F.col("vec_id") / 100).cast("long").alias("item_id"), F.col("embedding").alias("asked"))
    vectors = d.embeddings.select(F.col("vec_id").alias("doc_id"), "embedding")
    pairs = pool.join(vectors, "doc_id").join(queries, "item_id")
    return pairs.select("item_id", "doc_id", F.greatest(F.lit(0.0), T.cosine(F.col("embedding"), F.col("asked"))).alias("score"))


def _vector_index(d: Data) -> DataFrame:
    """The ten nearest of every query vector by an inverted file that holds every vector; fitted and stored once."""
    vectors = d.embeddings.select(F.col("vec_id").alias("doc_id"), "embedding")
    queries = d.embeddings.where("vec_id % 100 = 0").select((F.col("vec_id") / 100).cast("long").alias("item_id"), "embedding")
    fitted = N.fit(vectors, "doc_id", "embedding")
    indexed = once(d.spark, d.sf_dir, "vector-index", ("embeddings",), lambda: N.index(vectors, "doc_id", "embedding", fitted), "list")
    return N.search(indexed, vectors, queries, "doc_id", "embedding", "item_id", fitted, 10).select("item_id", "doc_id", F.round("score", 6).alias("score"))


def _hybrid(d: Data, method: str, filters=None, alpha: float = 0.6) -> DataFrame:
    text_leg = _scored(d)
    if filters is None:
        vector_leg = _vector_leg(d)
    else:
        # The filter goes before the search, so that no leg is short of rows that pass it.
        keep = d.documents.where(filters).select("doc_id")
        text_leg = text_leg.join(keep, "doc_id", "left_semi")
        vector_leg = _vector_leg(d, keep)
    fused = T.fuse(text_leg, vector_leg, ["item_id", "doc_id"], ["item_id"], alpha, method)
    return R.top_n(fused, ["item_id"], [F.desc(F.round("score", 7)), "doc_id"], 10).select("item_id", "doc_id", F.round("score", 6).alias("score"))


def _hybrid_sql(method: str, where: str | None = None, alpha: float = 0.6) -> str:
    beta = round(1 - alpha, 6)
    keep = f" WHERE doc_id IN (SELECT doc_id FROM documents WHERE {where})" if where else ""
    legs = []
    for name, src in (("t", "scored"), ("v", "vec")):
        value = "CASE WHEN max(s.score) OVER (PARTITION BY item_id) > 0 THEN s.score / max(s.score) OVER (PARTITION BY item_id) ELSE 0 END" if method == "weighted" else "1.0::DOUBLE / (60 + leg_rank)"
        legs.append(f"{name} AS (SELECT item_id, doc_id, {value} AS value FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS leg_rank FROM {src}{keep}) s WHERE leg_rank <= 200)")
    return f"WITH {_BM25}, {_VEC}, {', '.join(legs)} SELECT item_id, doc_id, round(score, 6) AS score FROM (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 7) DESC, doc_id) AS k FROM (SELECT coalesce(t.item_id, v.item_id) AS item_id, coalesce(t.doc_id, v.doc_id) AS doc_id, {alpha} * coalesce(t.value, 0) + {beta} * coalesce(v.value, 0) AS score FROM t FULL JOIN v ON t.item_id = v.item_id AND t.doc_id = v.doc_id) f) r WHERE k <= 10"


add("q18_hybrid_weighted", _hybrid_sql("weighted"), lambda d: _hybrid(d, "weighted"))
add("q18_hybrid_rrf", _hybrid_sql("rrf"), lambda d: _hybrid(d, "rrf"))
def _leg_sql(name: str, source: str) -> str:
    cut = f"{name} AS (SELECT * FROM (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS k FROM {source}) x WHERE k <= 200)"
    stats = f"{name}s AS (SELECT item_id, quantile_cont(score, 0.5) AS mid, quantile_cont(score, 0.95) AS high, max(score) AS top, count(*) AS n FROM {name} GROUP BY item_id)"
    value = "greatest(0.0, least(1.0, CASE WHEN high - mid > 1e-9 THEN (score - mid) / (high - mid) ELSE score / CASE WHEN top > 0 THEN top ELSE 1.0 END END))"
    return f"{cut}, {stats}, {name}n AS (SELECT item_id, doc_id, {value} AS value FROM {name} JOIN {name}s USING (item_id))"


add(
    "q18_hybrid_adaptive",
    f"""WITH {_BM25}, {_VEC}, {_leg_sql("t", "scored")}, {_leg_sql("v", "vec")},
    c AS (SELECT item_id, len(regexp_extract_all(text, '{U.TOKEN}')) AS words, coalesce(ts.n, 0) AS tn, coalesce(vs.n, 0) AS vn FROM benchmark LEFT JOIN ts USING (item_id) LEFT JOIN vs USING (item_id)),
    a AS (SELECT *, CASE WHEN words <= 2 THEN 0.7 ELSE 0.3 END AS a0 FROM c), b AS (SELECT *, CASE WHEN vn / 200 < 0.3 THEN least(a0 + 0.1, 1.0) ELSE a0 END AS a1 FROM a),
    w AS (SELECT item_id, greatest(0.2, least(0.8, CASE WHEN vn = 0 AND tn > 0 THEN 1.0 WHEN tn = 0 AND vn > 0 THEN 0.0 WHEN tn / 200 < 0.3 THEN greatest(a1 - 0.1, 0.0) ELSE a1 END))::DOUBLE AS alpha FROM b),
    f AS (SELECT item_id, doc_id, alpha * coalesce(tn.value, 0) + (1 - alpha) * coalesce(vn.value, 0) AS score FROM tn FULL JOIN vn USING (item_id, doc_id) JOIN w USING (item_id))
    SELECT item_id, doc_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 7) DESC, doc_id) AS k FROM f) x WHERE k <= 10""",
    lambda d: R.top_n(U.adaptive(_scored(d), _vector_leg(d), d.benchmark.select("item_id", U.tokens(F.col("text")).alias("words")), "item_id", "doc_id"), ["item_id"], [F.desc(F.round("score", 7)), "doc_id"], 10).select("item_id", "doc_id", F.round("score", 6).alias("score")),
)
# An index may miss a neighbour, which SQL cannot foresee; a test measures its recall against all pairs.
add("q18_vector_index", None, _vector_index)
add("q18_vector", f"WITH {_VEC} SELECT item_id, doc_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 7) DESC, doc_id) AS k FROM vec) x WHERE k <= 10", lambda d: R.top_n(_vector_leg(d), ["item_id"], [F.desc(F.round("score", 7)), "doc_id"], 10).select("item_id", "doc_id", F.round("score", 6).alias("score")))
add("q19_filtered_hybrid", _hybrid_sql("weighted", "lang = 'en' AND n_chars > 300"), lambda d: _hybrid(d, "weighted", "lang = 'en' and n_chars > 300"))
add("q02_description", f"WITH {_BM25} SELECT item_id, doc_id, round(score, 5) AS score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 6) DESC, doc_id) AS k FROM scored WHERE score >= 1) x WHERE k <= 10", lambda d: R.top_n(_scored(d).where("score >= 1"), ["item_id"], [F.desc(F.round("score", 6)), "doc_id"], 10).select("item_id", "doc_id", F.round("score", 5).alias("score")))
add("q13_description", f"WITH {_BM25} SELECT item_id, doc_id, k = 6 AS has_more FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 6) DESC, doc_id) AS k FROM scored) x WHERE k <= 6", lambda d: R.top_n(_scored(d), ["item_id"], [F.desc(F.round("score", 6)), "doc_id"], 6).select("item_id", "doc_id", (F.col("place") == 6).alias("has_more")))
add("q20_code_search_lexical", f"WITH {_BM25} SELECT item_id, source, round(max(score), 5) AS score, count(*) AS units FROM (SELECT s.*, d.source, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 6) DESC, s.doc_id) AS k FROM scored s JOIN documents d USING (doc_id)) x WHERE k <= 50 GROUP BY item_id, source", lambda d: R.top_n(_scored(d).join(d.documents.select("doc_id", "source"), "doc_id"), ["item_id"], [F.desc(F.round("score", 6)), "doc_id"], 50).groupBy("item_id", "source").agg(F.round(F.max("score"), 5).alias("score"), F.count("*").alias("units")))
add("q21_objects_by_summary", _hybrid_sql("weighted", None, 0.7), lambda d: _hybrid(d, "weighted", None, 0.7))


#: Weight and depth of the ranker's legs, the routes (word in the query, then fields and weights), and the blend.
LEGS = {"search": (1.0, 500), "module": (0.1, 20), "structural": (0.1, 250), "local": (0.05, 3), "fuzzy": (0.6, 200)}
LOCAL_MODULES, FUZZY_POOL, FUZZY_LEAST, POOL, RANKED = 5, 120, 0.88, 100, 50
ROUTES = (("the", {"head": 0.45, "source": 0.12}), ("with", {"text": 0.3, "head": 0.1}), ("and", {"source": 0.22, "text": 0.22}))
ROUTE_WEIGHT = 0.4
BLEND = {"vector": 0.35, "lexical": 0.25, "field": 0.15, "boost": 0.1, "fuzzy": 0.1, "quoted": 0.05}


def _by_field(d: Data, field: str) -> DataFrame:
    return T.bm25(_index(d, field), "doc_id", _asked(d), "item_id")


def _normal(leg: DataFrame, weight: float) -> DataFrame:
    """A leg's scores scaled to [0, 1] for each item, times its weight."""
    return leg.select("item_id", "doc_id", (R.min_max("score", ["item_id"], 1.0) * F.lit(weight)).alias("part"))


def _depth(leg: DataFrame, n: int, keys: tuple[str, ...] = ("item_id",), key: str = "doc_id") -> DataFrame:
    return R.top_n(leg, list(keys), [F.desc(F.round("score", 9)), key], n).drop("place")


def _fuzzy_leg(d: Data, pool: DataFrame) -> DataFrame:
    """Mean over the tokens of a candidate's first line of the best similarity to a query token, where that is ``FUZZY_LEAST`` or more.

    Similar tokens are found once for all candidates, among the distinct tokens of the queries and of the candidates' first lines;
    those of other documents are not compared. A query's best for a token is known before it meets the candidates.
    """
    heads, asked = _index(d, "head").select("doc_id", "token"), _asked(d).select("item_id", F.col("token").alias("other"))
    mine = materialise(pool.select("item_id", "doc_id").join(heads, "doc_id"), "candidate-tokens")
    words = materialise(mine.select("token").distinct(), "tokens")
    near = T.fuzzy_pairs(words, FUZZY_LEAST, asked.select(F.col("other").alias("token")))
    same = words.select("token", F.col("token").alias("other"), F.lit(1.0).alias("ratio"))
    similar = materialise(near.unionByName(same), "similar")
    best = asked.join(similar, "other").groupBy("item_id", "token").agg(F.max("ratio").alias("s"))
    means = mine.join(best, ["item_id", "token"], "left").groupBy("item_id", "doc_id").agg((F.sum("s") / F.count("*")).alias("score"))
    return means.where(F.col("score").isNotNull())


def _by_module(d: Data, units: DataFrame) -> DataFrame:
    """Scores of modules: a module's tokens are those of its documents. Of its postings, those of the queries' tokens are made alone."""
    asked, index = _asked(d), _index(d)
    found = index.join(asked.select("token").distinct(), "token", "left_semi")
    postings = materialise(found.join(units, "doc_id").groupBy("source", "token").agg(F.sum("tf").alias("tf")), "module-postings")
    lengths = index.groupBy("doc_id").agg(F.sum("tf").alias("len")).join(units, "doc_id").groupBy("source").agg(F.sum("len").alias("len"))
    return T.bm25(postings, "source", asked, "item_id", lengths)


def _module_parts(modules: DataFrame, units: DataFrame, legs: list[DataFrame]) -> DataFrame:
    """The module leg's parts, for the documents that can be among the ``POOL`` best.

    A document in no other leg has the part of its module alone, as have all of that module, and ties go to the
    smaller id: only a module's first ``POOL`` documents can be among the best. (An id may stand in several rows: then the documents of the same modules tie.)
    """
    kinds = units.groupBy("doc_id").agg(F.array_sort(F.collect_list("source")).alias("sources"))
    first = R.top_n(kinds, ["sources"], ["doc_id"], POOL).select("doc_id", F.explode("sources").alias("source"))
    pairs = first.join(modules, "source").select("item_id", "doc_id")
    for leg in legs:
        pairs = pairs.unionByName(leg.select("item_id", "doc_id"))
    # Every module has a document, so the scores of modules have the range of the whole leg.
    scaled = modules.select("item_id", "source", (R.min_max("score", ["item_id"], 1.0) * F.lit(LEGS["module"][0])).alias("part"))
    return pairs.distinct().join(units, "doc_id").join(scaled, ["item_id", "source"]).select("item_id", "doc_id", "part")


def _intent(d: Data, fuzzy: bool) -> DataFrame:
    """Legs over texts, modules (sources), first lines and lines within the best modules; the best by their sum, then reranked by routes."""
    # Read by several legs and by the routes.
    scores = {f: materialise(_by_field(d, f), "scores") for f in FIELDS}
    search, structural = _depth(scores["text"], LEGS["search"][1]), _depth(scores["head"], LEGS["structural"][1])
    units = d.documents.select("doc_id", "source")
    modules = materialise(R.top_n(_by_module(d, units), ["item_id"], [F.desc(F.round("score", 9)), "source"], LEGS["module"][1], "module_place"), "modules")
    inside = scores["head"].join(units, "doc_id").join(modules.where(F.col("module_place") <= LOCAL_MODULES).select("item_id", "source"), ["item_id", "source"])
    local = _depth(inside, LEGS["local"][1], ("item_id", "source")).select("item_id", "doc_id", "score")
    # Legs are a few hundred rows of an item; they are read by the sum, the module leg and the fuzzy leg.
    legs = {name: materialise(leg, "leg") for name, leg in {"search": search, "structural": structural, "local": local}.items()}
    if fuzzy:
        pool = None
        for leg in legs.values():
            part = _depth(leg, FUZZY_POOL).select("item_id", "doc_id")
            pool = part if pool is None else pool.unionByName(part)
        legs["fuzzy"] = materialise(_depth(_fuzzy_leg(d, pool.distinct()), LEGS["fuzzy"][1]), "leg")
    parts = _module_parts(modules, units, list(legs.values()))
    for name, leg in legs.items():
        parts = parts.unionByName(_normal(leg, LEGS[name][0]))
    base = materialise(R.top_n(parts.groupBy("item_id", "doc_id").agg(F.sum("part").alias("base")), ["item_id"], [F.desc(F.round("base", 6)), "doc_id"], POOL, "base_rank"), "pool")
    routed = None
    for field in FIELDS:
        weights = [F.when(F.array_contains("words", w), F.lit(ROUTE_WEIGHT * by[field])).otherwise(0.0) for w, by in ROUTES if field in by]
        total = weights[0]
        for w in weights[1:]:
            total = total + w
        share = d.benchmark.select("item_id", F.split(F.lower("text"), " ").alias("words")).select("item_id", total.alias("weight"))
        mine = scores[field].join(base.select("item_id", "doc_id"), ["item_id", "doc_id"])
        part = _normal(mine, 1.0).join(share, "item_id").select("item_id", "doc_id", (F.col("part") * F.col("weight")).alias("part"))
        routed = part if routed is None else routed.unionByName(part)
    routed = routed.groupBy("item_id", "doc_id").agg(F.sum("part").alias("routed"))
    final = base.join(routed, ["item_id", "doc_id"], "left").withColumn("composite", F.lit(1.0) / F.col("base_rank") + F.coalesce("routed", F.lit(0.0)))
    return R.top_n(final, ["item_id"], [F.desc(F.round("composite", 6)), "doc_id"], RANKED).select("item_id", "doc_id", F.round("composite", 5).alias("composite"))


def _intent_sql() -> str:
    scale = lambda src: f"SELECT item_id, doc_id, CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 1 END AS part FROM {src} WINDOW w AS (PARTITION BY item_id)"
    best = lambda src, n, by="item_id": f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY round(score, 9) DESC, doc_id) AS k FROM {src}) z WHERE k <= {n}) y"
    legs = {
        "search": best("(SELECT item_id, doc_id, score FROM fscored WHERE field = 'text') a", LEGS["search"][1]),
        "structural": best("(SELECT item_id, doc_id, score FROM fscored WHERE field = 'head') a", LEGS["structural"][1]),
        "module": "(SELECT m.item_id, d.doc_id, m.score FROM modules m JOIN documents d USING (source)) y",
        "local": best(f"(SELECT f.item_id, f.doc_id, f.score, d.source FROM fscored f JOIN documents d USING (doc_id) JOIN modules m ON m.item_id = f.item_id AND m.source = d.source AND m.k <= {LOCAL_MODULES} WHERE f.field = 'head') a", LEGS["local"][1], "item_id, source"),
    }
    parts = " UNION ALL ".join(f"SELECT item_id, doc_id, {LEGS[n][0]} * part AS part FROM ({scale(src)}) p" for n, src in legs.items())
    shares = " UNION ALL ".join(
        f"SELECT item_id, '{f}' AS field, " + " + ".join(f"CASE WHEN list_contains(string_split(lower(text), ' '), '{w}') THEN {ROUTE_WEIGHT * by[f]} ELSE 0 END" for w, by in ROUTES if f in by) + " AS weight FROM benchmark" for f in FIELDS
    )
    return f"""WITH {_QUERY}, {_field_postings(FIELD_WEIGHTS)}, {_FIELD_SCORES},
    mpost AS (SELECT source, token, sum(tf) AS tf FROM fpost JOIN documents USING (doc_id) WHERE field = 'text' GROUP BY source, token), mstats AS (SELECT count(DISTINCT source) AS docs, sum(tf) AS total FROM mpost), mlens AS (SELECT source, sum(tf) AS len FROM mpost GROUP BY source), mdfs AS (SELECT token, count(*) AS df FROM mpost GROUP BY token),
    mscored AS (SELECT q.item_id, p.source, sum(q.qf * ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / (total / docs)))) AS score FROM mpost p JOIN mdfs USING (token) JOIN mlens USING (source) JOIN query q USING (token), mstats GROUP BY q.item_id, p.source),
    modules AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, source) AS k FROM mscored) z WHERE k <= {LEGS["module"][1]}),
    base AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(base, 6) DESC, doc_id) AS base_rank FROM (SELECT item_id, doc_id, sum(part) AS base FROM ({parts}) u GROUP BY item_id, doc_id) v) w WHERE base_rank <= {POOL}),
    shares AS ({shares}),
    routed AS (SELECT item_id, doc_id, sum(part * weight) AS routed FROM (SELECT item_id, field, doc_id, CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 1 END AS part FROM (SELECT f.item_id, f.field, f.doc_id, f.score FROM fscored f JOIN base b USING (item_id, doc_id)) c WINDOW w AS (PARTITION BY item_id, field)) n JOIN shares USING (item_id, field) GROUP BY item_id, doc_id)
    SELECT item_id, doc_id, round(composite, 5) AS composite FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(composite, 6) DESC, doc_id) AS k FROM (SELECT b.item_id, b.doc_id, 1.0::DOUBLE / base_rank + coalesce(routed, 0) AS composite FROM base b LEFT JOIN routed r ON r.item_id = b.item_id AND r.doc_id = b.doc_id) f) g WHERE k <= {RANKED}"""


add("q32_intent_ranker", _intent_sql(), lambda d: _intent(d, False))
# The fuzzy leg's matching blocks are beyond SQL; the leg is held against brute force by a test.
add("q32_intent_ranker_fuzzy", None, lambda d: _intent(d, True))


def _blend(d: Data, fuzzy: bool) -> DataFrame:
    """Hybrid code search: the pool of both legs, six components scaled over it, their weighted mean, and the best unit's line.

    The query's first two words are its quoted phrase.
    """
    scores = {f: materialise(_by_field(d, f), "scores") for f in FIELDS}
    lexical, vector = _depth(scores["text"], 50), _depth(materialise(_vector_leg(d, n=50), "near"), 50)
    pool = materialise(lexical.select("item_id", "doc_id").unionByName(vector.select("item_id", "doc_id")).distinct(), "pool")
    key = ["item_id", "doc_id"]
    near = _similar(d, pool)
    field = None
    for f, w in FIELD_WEIGHTS.items():
        part = scores[f].join(pool, key, "left_semi").select(*key, (F.col("score") * F.lit(w)).alias("score"))
        field = part if field is None else field.unionByName(part)
    field = field.groupBy(*key).agg(F.sum("score").alias("score"))
    asked = d.benchmark.select("item_id", T.tokens("text").alias("q"), F.lower(F.array_join(F.slice(F.split("text", " "), 1, 2), " ")).alias("phrase"))
    units = d.documents.select("doc_id", "source", "text", T.tokens(F.expr(FIELDS["head"])).alias("head"), T.tokens("source").alias("names"))
    told = pool.join(asked, "item_id").join(units, "doc_id")
    told = told.select(*key, "source", (T.overlap(F.col("q"), F.col("head")) + F.lit(0.6) * T.overlap(F.col("q"), F.col("names"))).alias("boost"), F.lower("text").contains(F.col("phrase")).cast("double").alias("quoted"))
    rows = told
    parts = {"lexical": scores["text"], "vector": near, "field": field}
    if fuzzy:
        parts["fuzzy"] = _fuzzy_leg(d, pool)
    for name, leg in parts.items():
        rows = rows.join(leg.join(pool, key, "left_semi").select(*key, F.col("score").alias(name)), key, "left").withColumn(name, F.coalesce(name, F.lit(0.0)))
    used = [n for n in BLEND if fuzzy or n != "fuzzy"]
    total = F.lit(0.0)
    for n in used:
        total = total + R.min_max(n, ["item_id"], 0.0) * F.lit(BLEND[n])
    rows = rows.withColumn("score", total / F.lit(sum(BLEND[n] for n in used)))
    best = R.top_n(rows, ["item_id", "source"], [F.desc(F.round("score", 6)), "doc_id"], 1)
    return R.top_n(best.drop("place"), ["item_id"], [F.desc(F.round("score", 6)), "doc_id"], 10).select("item_id", "doc_id", "source", F.round("score", 5).alias("score"))


def _blend_sql() -> str:
    used = [n for n in BLEND if n != "fuzzy"]
    scaled = " + ".join(f"{BLEND[n]} * CASE WHEN max({n}) OVER w > min({n}) OVER w THEN ({n} - min({n}) OVER w) / (max({n}) OVER w - min({n}) OVER w) ELSE 0 END" for n in used)
    share = lambda a, b: f"len(list_intersect({a}, {b})) / greatest(len(list_distinct({a})), 1)"
    head = FIELDS["head"].replace("'\\n'", "chr(10)")
    top = lambda src: f"SELECT item_id, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS k FROM {src}) z WHERE k <= 50"
    return f"""WITH {_BM25}, {_VEC}, {_field_postings(FIELD_WEIGHTS)}, {_FIELD_SCORES},
    pool AS MATERIALIZED ({top("scored")} UNION {top("vec")}),
    told AS (SELECT p.item_id, p.doc_id, d.source, {share(_toks("b.text"), _toks(head.replace("text", "d.text")))} + 0.6 * {share(_toks("b.text"), _toks("d.source"))} AS boost, CAST(contains(lower(d.text), lower(array_to_string(string_split(b.text, ' ')[1:2], ' '))) AS DOUBLE) AS quoted FROM pool p JOIN benchmark b USING (item_id) JOIN documents d USING (doc_id)),
    all_ AS (SELECT t.*, coalesce(s.score, 0) AS lexical, coalesce(v.score, 0) AS vector, coalesce(f.score, 0) AS field FROM told t LEFT JOIN scored s ON s.item_id = t.item_id AND s.doc_id = t.doc_id LEFT JOIN vec v ON v.item_id = t.item_id AND v.doc_id = t.doc_id
        LEFT JOIN (SELECT item_id, doc_id, sum(weight * score) AS score FROM fscored GROUP BY item_id, doc_id) f ON f.item_id = t.item_id AND f.doc_id = t.doc_id),
    blended AS (SELECT item_id, doc_id, source, ({scaled}) / {sum(BLEND[n] for n in used)} AS score FROM all_ WINDOW w AS (PARTITION BY item_id))
    SELECT item_id, doc_id, source, round(score, 5) AS score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 6) DESC, doc_id) AS k FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id, source ORDER BY round(score, 6) DESC, doc_id) AS u FROM blended) x WHERE u = 1) y) r WHERE k <= 10"""


add("q20_code_search_hybrid", _blend_sql(), lambda d: _blend(d, False))
add("q20_code_search_fuzzy", None, lambda d: _blend(d, True))


def _reranked(d: Data) -> DataFrame:
    """The five best documents of an item, scored anew: the share of the item's tokens that the whole text holds."""
    top = R.top_n(_scored(d), ["item_id"], [F.desc(F.round("score", 6)), "doc_id"], 5).select("item_id", "doc_id")
    asked, texts = d.benchmark.select("item_id", F.col("text").alias("q")), d.documents.select("doc_id", F.col("text").alias("t"))
    return top.join(texts, "doc_id").join(asked, "item_id").select("item_id", "doc_id", F.round(T.overlap(T.tokens("q"), T.tokens("t")), 6).alias("rerank"))


add("q34_rerank", None, _reranked)
