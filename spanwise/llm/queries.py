"""The subpackage's registered queries, and DuckDB SQL for those that SQL expresses."""

from __future__ import annotations

from . import bpe, decontam, exact_dedup, filter_audit, langid, licenses, line_dedup, lm, phrases, quality, simhash, suffixes, token_counts
from .licenses import ORDER, PHRASES, TEMPLATES, THRESHOLD

QUERIES = {
    "op1_bpe_codec": bpe.op1_bpe_codec,
    "op2_decontamination": decontam.op2_decontamination,
    "op3_token_counts": token_counts.op3_token_counts,
    "op4_lm_score": lm.op4_lm_score,
    "op5_license_scan": licenses.op5_license_scan,
    "op6_exact_dedup": exact_dedup.op6_exact_dedup,
    "op7_language_id": langid.op7_language_id,
    "op8_simhash": simhash.op8_simhash,
    "op9_line_dedup": line_dedup.op9_line_dedup,
    "op10_quality": quality.op10_quality,
    "op11_suffix_dedup": suffixes.op11_suffix_dedup,
    "op12_phrases": phrases.op12_phrases,
    "op13_filter_audit": filter_audit.op13_filter_audit,
}

_LOW = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all(" + _LOW + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP2 = f"""
WITH dw AS (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents),
bw AS (SELECT item_id, {_WORDS.format("text")} AS w FROM benchmark),
bwin AS (
  SELECT DISTINCT item_id, k, array_to_string(w[i : i + k - 1], ' ') AS g
  FROM (SELECT item_id, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM (SELECT item_id, w, least(10, len(w)) AS k FROM bw WHERE len(w) > 0))),
dwin AS (
  SELECT doc_id, i, k, array_to_string(w[i : i + k - 1], ' ') AS g
  FROM (SELECT doc_id, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM dw, (SELECT DISTINCT k FROM bwin) WHERE len(w) >= k)),
hits AS (SELECT doc_id, i, k, item_id FROM dwin JOIN bwin USING (k, g)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + k - 1)) AS p FROM hits) GROUP BY doc_id),
found AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(dw.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)
"""


def _rows(pairs: dict[str, str]) -> str:
    return ", ".join("('{}', '{}')".format(*(x.replace("'", "''") for x in pair)) for pair in pairs.items())


_PAIRS = "list_transform(generate_series(1, len({0}) - 1), lambda i: {0}[i] || ' ' || {0}[i + 1])"
OP5 = f"""
WITH dw AS (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents),
phrases AS (SELECT string_split(phrase, ' ') AS p, label FROM (VALUES {_rows(PHRASES)}) t(phrase, label)),
bodies AS (SELECT label, {_WORDS.format("body")} AS x FROM (VALUES {_rows(TEMPLATES)}) t(label, body)),
templates AS (SELECT label, list_distinct(x) AS t, list_distinct({_PAIRS.format("x")}) AS pairs, len(x) AS n, (len(x) + 3) // 4 AS step FROM bodies),
places AS (
  SELECT doc_id, label, i - 1 AS place
  FROM (SELECT doc_id, w, p, label, unnest(generate_series(1, len(w) - len(p) + 1)) AS i FROM dw, phrases WHERE len(w) >= len(p))
  WHERE w[i : i + len(p) - 1] = p),
base AS (
  SELECT doc_id, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word
  FROM places GROUP BY doc_id),
blocks AS (SELECT doc_id, label, t, pairs, w[b * step + 1 : b * step + n + step] AS b FROM (SELECT *, unnest(generate_series(0, len(w) // step)) AS b FROM dw, templates)),
held AS (SELECT doc_id, label, pairs, b, len(list_intersect(list_distinct(b), t)) / len(t) AS share FROM blocks WHERE len(list_intersect(list_distinct(b), t)) >= ceil({THRESHOLD} * len(t) - 1e-9)),
met AS (SELECT doc_id, label, share FROM held WHERE len(list_intersect(list_distinct({_PAIRS.format("b")}), pairs)) >= ceil({ORDER} * len(pairs) - 1e-9)),
best AS (SELECT doc_id, max(share) AS share FROM met GROUP BY doc_id),
base_names AS (SELECT doc_id, string_agg(label, ',' ORDER BY label) AS base_labels FROM (SELECT DISTINCT doc_id, label FROM places) GROUP BY doc_id),
contained AS (
  SELECT doc_id, sum(n) AS n_blocks, string_agg(label, ',' ORDER BY label) AS contained
  FROM (SELECT doc_id, label, count(*) AS n FROM held GROUP BY doc_id, label) GROUP BY doc_id),
names AS (SELECT doc_id, string_agg(label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM places UNION SELECT doc_id, label FROM met) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(share, 0.0) END AS DOUBLE) AS score,
  coalesce(contained, '') AS contained, CAST(coalesce(n_blocks, 0) AS BIGINT) AS n_blocks
FROM dw LEFT JOIN base USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN base_names USING (doc_id) LEFT JOIN names USING (doc_id) LEFT JOIN contained USING (doc_id)
"""

ORACLES = {"op2_decontamination": OP2, "op5_license_scan": OP5, "op6_exact_dedup": exact_dedup.SQL, "op12_phrases": phrases.SQL, "op13_filter_audit": filter_audit.SQL}
