"""DuckDB SQL of the operators that SQL can express over whole tables."""

from __future__ import annotations

import math

from lodestone.llm import license_scan

_LOWER = f"translate(coalesce(text, ''), '{license_scan.UPPER}', '{license_scan.LOWER}')"
_PLAIN = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
_SPACED = r"'[^\x20\x09-\x0D]+'"

SUBSTRING = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_SPACED}) AS w FROM documents),
win AS (SELECT doc_id, k, array_to_string(w[k:k + 12], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS k FROM d WHERE len(w) >= 13) x),
least_doc AS (SELECT g, min(doc_id) AS m FROM win GROUP BY g),
hit AS (SELECT DISTINCT doc_id, unnest(range(k, k + 13)) AS p FROM win JOIN least_doc USING (g) WHERE m < doc_id),
word AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t FROM word ANTI JOIN hit USING (doc_id, p) GROUP BY doc_id),
lost AS (SELECT doc_id, count(*) AS n FROM hit GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(lost.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN lost USING (doc_id)"""

DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_PLAIN}) AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOWER}, {_PLAIN}) AS w FROM benchmark),
wi AS (SELECT DISTINCT item, n, array_to_string(w[k:k + n - 1], ' ') AS g FROM (SELECT item, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS k FROM i WHERE len(w) > 0) x),
wd AS (SELECT doc_id, n, k, array_to_string(w[k:k + n - 1], ' ') AS g FROM (SELECT doc_id, w, s.n, unnest(range(1, len(w) - s.n + 2)) AS k FROM d, (SELECT DISTINCT n FROM wi) s WHERE len(w) >= s.n) x),
hits AS (SELECT doc_id, wd.n, k, item FROM wd JOIN wi ON wd.g = wi.g AND wd.n = wi.n),
cover AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM hits) x GROUP BY doc_id),
found AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hits GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN cover USING (doc_id) LEFT JOIN found USING (doc_id)"""

JACCARD = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_SPACED}) AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS k FROM d WHERE len(w) > 0) x),
size AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pair AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
link AS (SELECT x, y FROM pair JOIN size s ON x = s.doc_id JOIN size t ON y = t.doc_id WHERE 100 * o >= 75 * (s.n + t.n - o)),
edge AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
reach AS (SELECT x AS node, x AS other FROM edge UNION SELECT r.node, e.y FROM reach r JOIN edge e ON r.other = e.x),
part AS (SELECT node, min(other) AS c FROM reach GROUP BY node)
SELECT d.doc_id, CAST(coalesce(size.n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(part.c, d.doc_id)) AS component_id
FROM d LEFT JOIN size USING (doc_id) LEFT JOIN part ON part.node = d.doc_id"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _license() -> str:
    places = []
    for phrase, label in license_scan.PHRASES:
        p = phrase.split()
        same = " AND ".join(f"w[k + {j}] = {_quoted(x)}" for j, x in enumerate(p))
        places.append(f"SELECT doc_id, k - 1 AS place, {_quoted(label)} AS label FROM pos WHERE {same}")
    templates = []
    for label, text in license_scan.TEMPLATES:
        t = license_scan.tokens(text)
        need = math.ceil(license_scan.CONTAINED * len(t) - 1e-9)
        templates.append(f"({_quoted(label)}, [{', '.join(map(_quoted, t))}], {need})")
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all({_LOWER}, {_PLAIN}) AS w FROM documents),
pos AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS k FROM d),
base AS ({' UNION ALL '.join(places)}),
line AS (SELECT doc_id, list_distinct(regexp_extract_all({_LOWER}, {_PLAIN})) AS have FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS text FROM d) x),
template(label, words, need) AS (VALUES {', '.join(templates)}),
met AS (SELECT doc_id, label, len(list_intersect(have, words)) / len(words) AS overlap FROM line, template WHERE len(have) >= need AND len(list_intersect(have, words)) >= need),
b AS (SELECT doc_id, count(*) AS n, min(place) AS first_word, max(place) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM base GROUP BY doc_id),
every AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM base UNION ALL SELECT doc_id, label FROM met) x GROUP BY doc_id),
m AS (SELECT doc_id, max(overlap) AS overlap FROM met GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(b.n, 0) AS BIGINT) AS n_base, CAST(b.first_word AS BIGINT) AS first_word, CAST(b.last_word AS BIGINT) AS last_word,
    coalesce(b.labels, '') AS base_labels, coalesce(every.labels, '') AS labels, CAST(CASE WHEN b.n > 0 THEN 1.0 ELSE coalesce(m.overlap, 0) END AS DOUBLE) AS score
FROM d LEFT JOIN b USING (doc_id) LEFT JOIN every USING (doc_id) LEFT JOIN m USING (doc_id)"""


ORACLES = {
    "op3_substring_dedup": SUBSTRING,
    "op5_decontamination": DECONTAMINATION,
    "op7_ngram_jaccard": JACCARD,
    "op10_license_scan": _license(),
}
