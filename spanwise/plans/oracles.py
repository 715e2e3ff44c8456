"""DuckDB SQL of the named queries: one chain of common table expressions, and a final SELECT for each query."""

from __future__ import annotations

from ..functions.columns import ERFC, OPIOID_TERMS
from ..sources.claims import CLAIM_CODES, EVENT_CODES, QUERY_BRANDS
from .queries import GRACE, K, LOOKBACK, MAX_CODES, MAX_DRUGS, MIN_LARGER, MIN_LEN, MIN_N, WINDOW


def _strings(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


_PREFIXES = " OR ".join(f"starts_with(code_value, '{p}')" for _, p, _ in EVENT_CODES)
_FLAT = "spell_id, member_id, entry_date, raw_exit_date, extended_exit_date, spell_length_days, followup_end_date, had_ae, first_ae_date, first_ae_code"

CHAIN = f"""
WITH rx AS (
  SELECT o_custkey AS member_id, CAST(l_shipdate AS DATE) AS filldate, lpad(CAST(p_partkey AS VARCHAR), 11, '0') AS ndc11code,
    CAST(l_quantity AS INTEGER) * CASE WHEN p_partkey % 10 = 0 THEN 8 ELSE 2 END AS supplydayscount
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey),
atc AS (SELECT CAST(p_partkey AS VARCHAR) AS ndc, CAST(1000000 + p_partkey AS VARCHAR) AS rxcui, p_name AS rxnorm_description, p_brand AS atc_3_code, 'CLASS ' || p_brand AS atc_3_name FROM part),
listed AS (SELECT DISTINCT lpad(CAST(p_partkey AS VARCHAR), 11, '0') AS ndc11 FROM part WHERE p_brand IN ({_strings(QUERY_BRANDS)})),
fills AS (
  SELECT member_id, atc_3_code AS drug, filldate AS s, filldate + supplydayscount - 1 AS e, CAST(ndc11 IS NOT NULL AS INTEGER) AS q
  FROM rx LEFT JOIN atc ON ndc11code = lpad(ndc, 11, '0') LEFT JOIN listed ON ndc11code = ndc11
  WHERE atc_3_code IS NOT NULL AND filldate IS NOT NULL AND supplydayscount IS NOT NULL),
marked AS (
  SELECT *, max(e) OVER (PARTITION BY member_id, drug ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS so_far FROM fills),
islands AS (
  SELECT *, sum(CASE WHEN so_far IS NULL OR s > so_far + 1 + {GRACE} THEN 1 ELSE 0 END) OVER (PARTITION BY member_id, drug ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM marked),
merged AS (SELECT member_id, drug, min(s) AS s, max(e) AS e, max(q) AS q FROM islands GROUP BY member_id, drug, island),
iv AS (SELECT member_id, drug, s, e, max(q) OVER (PARTITION BY member_id, drug) AS is_op FROM merged),
points AS (
  SELECT member_id, d, sum(c) AS c, sum(cq) AS cq
  FROM (SELECT member_id, s AS d, 1 AS c, is_op AS cq FROM iv UNION ALL SELECT member_id, e + 1, -1, -is_op FROM iv) GROUP BY member_id, d),
sweep AS (
  SELECT member_id, d, sum(c) OVER w AS n, sum(cq) OVER w AS nq, max(d) OVER (PARTITION BY member_id) AS last_day
  FROM points WINDOW w AS (PARTITION BY member_id ORDER BY d ROWS UNBOUNDED PRECEDING)),
ups AS (SELECT *, n >= {K} AND nq > 0 AS up, lag(n >= {K} AND nq > 0) OVER (PARTITION BY member_id ORDER BY d) AS was FROM sweep),
turns AS (SELECT member_id, d, up, last_day FROM ups WHERE was IS NULL OR was <> up),
runs AS (SELECT *, coalesce(lead(d) OVER (PARTITION BY member_id ORDER BY d) - d, last_day - d + 1) AS len FROM turns),
starts AS (
  SELECT *, CASE WHEN up AND (coalesce(sum(CAST(up AS INTEGER)) OVER (PARTITION BY member_id ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0
    OR lag(len) OVER (PARTITION BY member_id ORDER BY d) >= {GRACE}) THEN 1 ELSE 0 END AS fresh FROM runs),
grouped AS (SELECT *, sum(fresh) OVER (PARTITION BY member_id ORDER BY d ROWS UNBOUNDED PRECEDING) AS g FROM starts),
raw_spells AS (
  SELECT member_id, g, min(d) AS entry_date, CASE WHEN NOT arg_max(up, d) AND arg_max(len, d) >= {GRACE} THEN max(d) - 1 ELSE max(last_day) END AS raw_exit_date
  FROM grouped WHERE g > 0 GROUP BY member_id, g),
long_spells AS (SELECT *, raw_exit_date + {GRACE} AS extended_exit_date, raw_exit_date + {GRACE} - entry_date + 1 AS spell_length_days FROM raw_spells WHERE raw_exit_date + {GRACE} - entry_date + 1 >= {MIN_LEN + GRACE}),
spells AS (
  SELECT member_id, member_id * 1000 + row_number() OVER (PARTITION BY member_id ORDER BY entry_date) AS spell_id, entry_date, raw_exit_date, extended_exit_date, spell_length_days FROM long_spells),
changes AS (
  SELECT * FROM (
    SELECT s.member_id, spell_id, iv.s AS date, 'add' AS change_type, drug AS atc_3_code, is_op, entry_date, extended_exit_date FROM spells s JOIN iv ON s.member_id = iv.member_id AND iv.e >= entry_date - {LOOKBACK} AND iv.s <= extended_exit_date
    UNION ALL
    SELECT s.member_id, spell_id, iv.e + 1, 'drop', drug, is_op, entry_date, extended_exit_date FROM spells s JOIN iv ON s.member_id = iv.member_id AND iv.e >= entry_date - {LOOKBACK} AND iv.s <= extended_exit_date)
  WHERE date BETWEEN entry_date - {LOOKBACK} AND extended_exit_date),
enroll1 AS (
  SELECT c_custkey AS member_id, DATE '1994-07-01' + CAST(120 * (c_custkey % 5) AS INTEGER) AS eff,
    DATE '1994-07-01' + CAST(120 * (c_custkey % 5) AS INTEGER) + CAST(CASE WHEN c_custkey % 13 = 0 THEN 200 ELSE 1800 + 300 * (c_custkey % 3) END AS INTEGER) AS term FROM customer),
enrollment AS (SELECT * FROM enroll1 UNION ALL SELECT member_id, term + 60, term + 460 FROM enroll1 WHERE member_id % 7 = 0),
censored AS (
  SELECT s.*, f.followup_end_date FROM spells s JOIN (
    SELECT spell_id, max(least(term, extended_exit_date)) AS followup_end_date FROM spells JOIN enrollment USING (member_id)
    WHERE eff <= extended_exit_date AND term >= entry_date AND term >= eff GROUP BY spell_id) f USING (spell_id)),
washed AS (SELECT * FROM censored c WHERE EXISTS (SELECT 1 FROM enrollment e WHERE e.member_id = c.member_id AND eff <= entry_date - 180 AND term >= entry_date)),
claim AS (SELECT o_orderkey AS claim_id, o_custkey AS member_id, CAST(o_orderdate AS DATE) AS service_date FROM orders),
claim_code AS (SELECT o_orderkey AS claim_id, CASE WHEN o_orderkey % 11 = 0 THEN 99 ELSE 17 END AS code_type, ([{_strings(CLAIM_CODES)}])[CAST(o_orderkey % 8 AS INTEGER) + 1] AS code_value FROM orders),
diagnoses AS (SELECT member_id, service_date, code_value FROM claim JOIN claim_code USING (claim_id) WHERE code_type IN (17, 18, 22, 23, 24)),
ae AS (SELECT member_id, service_date - 1 AS d, code_value AS code FROM diagnoses WHERE {_PREFIXES}),
ae_seen AS (SELECT member_id, code, min(d) AS first_seen FROM ae GROUP BY ALL),
ae_met AS (
  SELECT w.spell_id, w.entry_date, a.d, a.code, s.first_seen FROM washed w JOIN ae a ON a.member_id = w.member_id AND a.d BETWEEN w.entry_date AND w.followup_end_date
  JOIN ae_seen s ON s.member_id = a.member_id AND s.code = a.code),
ae_first AS (SELECT spell_id, first(d ORDER BY d, code) AS first_ae_date, first(code ORDER BY d, code) AS first_ae_code, first(first_seen < entry_date ORDER BY d, code) AS known FROM ae_met GROUP BY spell_id),
ae_new AS (SELECT spell_id, string_agg(code, '+' ORDER BY code) AS ae_codes FROM (SELECT DISTINCT spell_id, code FROM ae_met WHERE first_seen >= entry_date) GROUP BY spell_id),
labelled AS (
  SELECT w.*, f.spell_id IS NOT NULL AS had_ae, f.first_ae_date, coalesce(n.ae_codes, '') AS ae_codes, f.first_ae_code
  FROM washed w LEFT JOIN ae_first f USING (spell_id) LEFT JOIN ae_new n USING (spell_id) WHERE NOT coalesce(f.known, FALSE)),
ended AS (SELECT *, least(extended_exit_date, coalesce(first_ae_date, followup_end_date, extended_exit_date)) AS stop FROM labelled),
adds AS (
  SELECT spell_id, date, lead(date) OVER w AS nxt, row_number() OVER w AS seq
  FROM (SELECT DISTINCT e.spell_id, c.date FROM ended e JOIN changes c ON c.spell_id = e.spell_id AND change_type = 'add' AND c.date BETWEEN e.entry_date AND e.stop)
  WINDOW w AS (PARTITION BY spell_id ORDER BY date)),
cut AS (SELECT e.*, a.date, a.nxt, a.seq, greatest(least(coalesce(nxt - 1, stop), stop), date) AS fin FROM ended e LEFT JOIN adds a USING (spell_id)),
segments AS (
  SELECT member_id, spell_id, coalesce(date, entry_date) AS entry_date, coalesce(CASE WHEN date IS NOT NULL THEN fin END, raw_exit_date) AS raw_exit_date, coalesce(CASE WHEN date IS NOT NULL THEN fin END, extended_exit_date) AS extended_exit_date,
    CASE WHEN date IS NULL THEN spell_length_days ELSE fin - date + 1 END AS spell_length_days, followup_end_date,
    CASE WHEN date IS NULL THEN had_ae ELSE coalesce(fin = first_ae_date, FALSE) END AS had_ae, CASE WHEN date IS NULL OR fin = first_ae_date THEN first_ae_date END AS first_ae_date, ae_codes, first_ae_code,
    coalesce(seq, 1) AS split_seq, CASE WHEN date IS NULL THEN 'no_adds' WHEN nxt IS NOT NULL THEN 'next_add' WHEN coalesce(stop = first_ae_date, FALSE) THEN 'ae' ELSE 'followup_end' END AS segment_end_reason
  FROM cut),
status AS (
  SELECT g.spell_id, g.split_seq, c.atc_3_code, arg_max(CASE WHEN change_type = 'add' THEN 1 ELSE 0 END, (c.date - DATE '1900-01-01') * 2 + CASE WHEN change_type = 'add' THEN 1 ELSE 0 END) AS active
  FROM segments g JOIN changes c ON c.spell_id = g.spell_id AND c.date <= g.entry_date GROUP BY ALL),
combo AS (SELECT spell_id, split_seq, list(atc_3_code ORDER BY atc_3_code) AS drugs FROM status WHERE active = 1 GROUP BY ALL),
combos AS (SELECT g.*, coalesce(drugs, []) AS drugs FROM segments g LEFT JOIN combo USING (spell_id, split_seq)),
windows AS (SELECT DISTINCT g.member_id, spell_id, split_seq, code_value FROM segments g JOIN diagnoses d ON d.member_id = g.member_id AND service_date BETWEEN entry_date - {LOOKBACK} AND entry_date - 1),
clusters AS (
  SELECT member_id, spell_id, split_seq, list(DISTINCT substr(c, 1, 3) ORDER BY substr(c, 1, 3)) AS icd
  FROM (SELECT *, regexp_replace(upper(code_value), '[^0-9A-Z]', '', 'g') AS c FROM windows) WHERE regexp_full_match(c, '[A-Z][0-9A-Z]{{2,6}}') GROUP BY ALL),
people AS (
  SELECT c_custkey AS member_id, CASE WHEN c_custkey % 97 = 0 THEN NULL WHEN c_custkey % 89 = 0 THEN 1850 ELSE 1930 + c_custkey % 70 END AS birthyear,
    CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'M' WHEN c_mktsegment <> 'FURNITURE' THEN 'F' END AS gendercode, (['01', '02', '04', '06', '09', '11'])[c_nationkey % 6 + 1] AS race, n_name AS statecode
  FROM customer JOIN nation ON c_nationkey = n_nationkey),
c_size AS (SELECT * FROM combos WHERE len(drugs) >= 3),
c_entry AS (SELECT * FROM c_size WHERE NOT coalesce(first_ae_date = entry_date, FALSE)),
c_length AS (SELECT *, CAST(coalesce(had_ae AND first_ae_date <= entry_date + {WINDOW}, FALSE) AS INTEGER) AS y FROM c_entry WHERE had_ae OR spell_length_days >= 15),
c_dedup AS (SELECT * FROM c_length QUALIFY row_number() OVER (PARTITION BY member_id, drugs ORDER BY y DESC, spell_id, split_seq) = 1),
c_leak AS (
  SELECT d.*, p.birthyear, p.gendercode, p.race, p.statecode, coalesce(icd, []) AS icd, year(entry_date) - birthyear AS age
  FROM c_dedup d LEFT JOIN people p USING (member_id) LEFT JOIN clusters k USING (spell_id, split_seq)
  WHERE NOT coalesce(had_ae AND regexp_matches(first_ae_code, '^[A-Za-z][0-9][0-9]') AND list_contains(list_filter(icd, lambda x: regexp_matches(x, '^[A-Za-z][0-9][0-9]')), substr(first_ae_code, 1, 3)), FALSE)),
c_age AS (SELECT * FROM c_leak WHERE age <= 120),
cohort AS (SELECT * FROM c_age WHERE gendercode IS NOT NULL),
names AS (SELECT DISTINCT atc_3_code AS code, atc_3_name AS name FROM atc),
dims AS (SELECT vec_id, i, CAST(embedding[i] AS DOUBLE) AS x FROM (SELECT *, unnest(generate_series(1, len(embedding))) AS i FROM embeddings)),
vectors AS (SELECT code, list(x ORDER BY i) AS vec FROM (SELECT 'Brand#' || CAST(vec_id % 25 + 1 AS VARCHAR) AS code, i, avg(x) AS x FROM dims GROUP BY ALL) GROUP BY code),
icd_vectors AS (SELECT code, list(x ORDER BY i) AS vec FROM (SELECT ([{_strings(c[:3] for c in CLAIM_CODES)}])[vec_id % {len(CLAIM_CODES)} + 1] AS code, i, avg(x) AS x FROM dims GROUP BY ALL) GROUP BY code),
scored AS (SELECT event_id AS row_id, round(value / (1 + value), 3) AS score, CAST(event_type = 'error' AS INTEGER) AS y FROM events),
folded AS (SELECT score, count(*) AS n, CAST(sum(y) AS BIGINT) AS tp FROM scored GROUP BY score),
ranked AS (SELECT *, sum(n) OVER w AS cn, sum(tp) OVER w AS ctp FROM folded WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
totals AS (SELECT count(*) AS all_n, sum(y) AS pos FROM scored),
curve AS (SELECT score AS threshold, round(ctp / cn, 6) AS precision, round(ctp / pos, 6) AS recall, round(2 * (ctp / cn) * (ctp / pos) / (ctp / cn + ctp / pos + 1e-12), 6) AS f1 FROM ranked, totals)
"""


def _erfc(z: str) -> str:
    tail = str(ERFC[-1])
    for c in reversed(ERFC[:-1]):
        tail = f"({c} + t * {tail})"
    return f"t * exp(-{z} * {z} + {tail})"


def _mined(size: int | None, where: str = "", select: str = "") -> str:
    keys = ["items"] if size is None else [f"item{i + 1}" for i in range(size)]
    if size is None:
        rows = "SELECT array_to_string(drugs, '+') AS items, had_ae FROM cohort"
    else:
        unnest = "SELECT drugs, had_ae, unnest(generate_series(1, len(drugs))) AS i FROM cohort"
        pairs = f"SELECT drugs, had_ae, i, unnest(generate_series(i + 1, len(drugs))) AS j FROM ({unnest}) WHERE i < len(drugs)"
        rows = f"SELECT drugs[i] AS item1, drugs[j] AS item2, had_ae FROM ({pairs})"
        if size == 3:
            trios = f"SELECT drugs, had_ae, i, j, unnest(generate_series(j + 1, len(drugs))) AS k FROM ({pairs}) WHERE j < len(drugs)"
            rows = f"SELECT drugs[i] AS item1, drugs[j] AS item2, drugs[k] AS item3, had_ae FROM ({trios})"
    names = "" if size is None else "".join(f", m{i + 1}.name AS name{i + 1}" for i in range(size))
    joins = "" if size is None else "".join(f" LEFT JOIN names m{i + 1} ON m{i + 1}.code = item{i + 1}" for i in range(size))
    k = ", ".join(keys)
    select = select or f"{k}, CAST(n_total AS BIGINT) AS n_total, n_ae, round(rate, 6) AS rate, round(chi2, 4) AS chi2, p_adj < 0.05 AS significant, p_adj < 0.05 AND rate > all_ae / all_n AS signal{names}, round(-log10(greatest(p_value, 1e-300)), 4) AS log_p, round(p_adj, 5) AS p_adj"
    return f"""{CHAIN},
counted AS (SELECT {k}, count(*) AS n_total, CAST(sum(CAST(had_ae AS INTEGER)) AS BIGINT) AS n_ae FROM ({rows}) GROUP BY ALL HAVING count(*) >= {MIN_N if size == 2 else MIN_LARGER}),
overall AS (SELECT CAST(count(*) AS DOUBLE) AS all_n, CAST(sum(CAST(had_ae AS INTEGER)) AS DOUBLE) AS all_ae FROM cohort),
cells AS (SELECT *, CAST(n_ae AS DOUBLE) AS a, CAST(n_total - n_ae AS DOUBLE) AS b, all_ae - n_ae AS c, all_n - all_ae - (n_total - n_ae) AS d FROM counted, overall),
chi AS (SELECT *, a / n_total AS rate, CASE WHEN (a + b) * (c + d) * (a + c) * (b + d) > 0 THEN all_n * greatest(abs(a * d - b * c) - all_n / 2, 0) * greatest(abs(a * d - b * c) - all_n / 2, 0) / ((a + b) * (c + d) * (a + c) * (b + d)) END AS chi2 FROM cells),
tested AS (SELECT *, coalesce({_erfc("z")}, 1.0) AS p_value FROM (SELECT *, sqrt(chi2 / 2) AS z, 1 / (1 + sqrt(chi2 / 2) / 2) AS t FROM chi)),
ranks AS (SELECT *, row_number() OVER (ORDER BY p_value, {k}) AS r, count(*) OVER () AS m FROM tested),
adjusted AS (SELECT *, least(1.0, min(p_value * m / r) OVER (ORDER BY r DESC ROWS UNBOUNDED PRECEDING)) AS p_adj, least(1.0, min(p_value * m / r) OVER (ORDER BY r ROWS UNBOUNDED PRECEDING)) AS p_forward FROM ranks)
SELECT {select} FROM adjusted{joins} {where}"""


def _describe(column: str, source: str, by: str = "") -> str:
    head = f"{by}, " if by else ""
    tail = f" GROUP BY {by}" if by else ""
    return f"""SELECT {head}count({column}) AS n, round(avg({column}), 6) AS mean, round(stddev_samp({column}), 6) AS std, CAST(min({column}) AS DOUBLE) AS min,
      round(quantile_cont({column}, 0.25), 6) AS p25, round(quantile_cont({column}, 0.5), 6) AS p50, round(quantile_cont({column}, 0.75), 6) AS p75, CAST(max({column}) AS DOUBLE) AS max FROM {source}{tail}"""


_GAPS = "(SELECT member_id, spell_id, entry_date - lag(raw_exit_date) OVER (PARTITION BY member_id ORDER BY entry_date, spell_id) AS gap_days FROM spells QUALIFY gap_days IS NOT NULL)"
_SEGMENT = "member_id, spell_id, entry_date, raw_exit_date, extended_exit_date, CAST(spell_length_days AS INTEGER) AS spell_length_days, followup_end_date, had_ae, first_ae_date, ae_codes, first_ae_code"
_RACE = "CASE race WHEN '01' THEN 'White' WHEN '02' THEN 'Black or African American' WHEN '04' THEN 'Asian or Pacific Islander' WHEN '06' THEN 'Some Other Race' WHEN '09' THEN 'Unknown' WHEN '11' THEN 'Hispanic or Latino' ELSE 'Other/Unmapped' END"
_TOP2 = "(SELECT first_ae_code FROM ({pool}) WHERE first_ae_code IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 2)"
_DESCRIBED = "CASE " + " ".join(f"WHEN starts_with(code_value, '{p}') THEN '{d}'" for _, p, d in EVENT_CODES) + " ELSE 'Unknown AE code' END"
_STEPS = (("segments", "combos"), ("size", "c_size"), ("entry_day", "c_entry"), ("length", "c_length"), ("dedup", "c_dedup"), ("leakage", "c_leak"), ("age", "c_age"), ("gender", "cohort"))
_RACES = ("White", "Black or African American", "Hispanic or Latino", "Asian or Pacific Islander", "Some Other Race", "Unknown")
_TABLE1 = [
    ("N spells", "CAST(count(*) AS DOUBLE)"), ("N patients", "CAST(count(DISTINCT member_id) AS DOUBLE)"), ("Female, %", "round(100.0 * avg(CAST(gendercode = 'F' AS INTEGER)), 6)"), ("Male, %", "round(100.0 * avg(CAST(gendercode = 'M' AS INTEGER)), 6)"),
    ("Other/Unknown gender, %", "round(100.0 * avg(CAST(NOT coalesce(gendercode IN ('F', 'M'), FALSE) AS INTEGER)), 6)"), *((f"{r}, %", f"round(100.0 * avg(CAST({_RACE} = '{r}' AS INTEGER)), 6)") for r in _RACES),
    *((f"Age p{p}", f"round(quantile_cont(age, {p / 100}), 6)") for p in (25, 50, 75)), *((f"ICD10 codes p{p}", f"round(quantile_cont(len(icd), {p / 100}), 6)") for p in (25, 50, 75)),
]
_AGE = "CASE WHEN age >= 75 THEN '75+' WHEN age >= 65 THEN '65-74' WHEN age >= 55 THEN '55-64' WHEN age >= 45 THEN '45-54' WHEN age >= 35 THEN '35-44' WHEN age >= 25 THEN '25-34' WHEN age IS NOT NULL THEN '18-24' END"
_VOCAB = "(SELECT code, row_number() OVER (ORDER BY code) + 1 AS idx FROM (SELECT DISTINCT unnest(drugs) AS code FROM cohort))"


def _top(k: int) -> str:
    return f"""SELECT array_to_string(drugs, '+') AS drug_combo, n, array_to_string(list_sort(list_transform(drugs, lambda x: 'CLASS ' || x)), ', ') AS names
      FROM (SELECT drugs, count(*) AS n FROM combos WHERE len(drugs) = {k} GROUP BY drugs ORDER BY n DESC, drugs LIMIT 10)"""


def _items(k: int) -> str:
    return ", ".join(f"item{i + 1}" for i in range(k))


def _pooled(items: str, vectors: str) -> str:
    return f"""SELECT spell_id, CAST(split_seq AS INTEGER) AS split_seq, CAST(i - 1 AS INTEGER) AS dim, round(avg(vec[i]), 5) AS value
      FROM (SELECT spell_id, split_seq, vec, unnest(generate_series(1, len(vec))) AS i FROM (SELECT spell_id, split_seq, unnest({items}) AS code FROM cohort) JOIN {vectors} USING (code)) GROUP BY ALL"""


def _report() -> str:
    cells = "(SELECT count(*) FILTER (y = 0 AND score < 0.5) AS n00, count(*) FILTER (y = 0 AND score >= 0.5) AS n01, count(*) FILTER (y = 1 AND score < 0.5) AS n10, count(*) FILTER (y = 1 AND score >= 0.5) AS n11 FROM scored)"
    rates = f"(SELECT *, coalesce(n00 / nullif(n00 + n10, 0), 0) AS p0, coalesce(n00 / nullif(n00 + n01, 0), 0) AS r0, coalesce(n11 / nullif(n01 + n11, 0), 0) AS p1, coalesce(n11 / nullif(n10 + n11, 0), 0) AS r1, n00 + n01 AS s0, n10 + n11 AS s1 FROM {cells})"
    full = f"(SELECT *, coalesce(2 * p0 * r0 / nullif(p0 + r0, 0), 0) AS f0, coalesce(2 * p1 * r1 / nullif(p1 + r1, 0), 0) AS f1, (n00 + n11) / (s0 + s1) AS acc FROM {rates})"
    line = "SELECT '{}' AS label, round(CAST({} AS DOUBLE), 6) AS precision, round(CAST({} AS DOUBLE), 6) AS recall, round(CAST({} AS DOUBLE), 6) AS f1, CAST({} AS BIGINT) AS support FROM t"
    mean = lambda x: f"({x}0 * s0 + {x}1 * s1) / (s0 + s1)"
    parts = [("0", "p0", "r0", "f0", "s0"), ("1", "p1", "r1", "f1", "s1"), ("macro", "(p0 + p1) / 2", "(r0 + r1) / 2", "(f0 + f1) / 2", "s0 + s1"), ("weighted", mean("p"), mean("r"), mean("f"), "s0 + s1"), ("accuracy", "acc", "acc", "acc", "s0 + s1")]
    return f", t AS {full} " + " UNION ALL ".join(line.format(*p) for p in parts)


_PLAIN = {
    "view_rx_fills": "SELECT * FROM rx",
    "view_enrollment": "SELECT member_id, eff AS effectivedate, term AS terminationdate FROM enrollment",
    "view_demographics": "SELECT member_id, CAST(birthyear AS INTEGER) AS birthyear, gendercode, race AS raceethnicitytypecode, statecode FROM people",
    "eligible_members": ", e AS (SELECT member_id, max(CAST(ndc11 IS NOT NULL AS INTEGER)) AS l, count(DISTINCT ndc11code) AS n_drugs FROM rx LEFT JOIN listed ON ndc11code = ndc11 WHERE supplydayscount IS NOT NULL GROUP BY member_id) SELECT member_id, n_drugs FROM e WHERE l = 1 AND n_drugs >= 3",
    "semi_join_members": ", e AS (SELECT member_id FROM rx LEFT JOIN listed ON ndc11code = ndc11 WHERE supplydayscount IS NOT NULL GROUP BY member_id HAVING max(CAST(ndc11 IS NOT NULL AS INTEGER)) = 1 AND count(DISTINCT ndc11code) >= 3) SELECT member_id, count(*) AS n_claims, min(service_date) AS first_date FROM claim WHERE member_id IN (SELECT member_id FROM e) GROUP BY member_id",
    "distinct_query_drugs": "SELECT ndc11 FROM listed",
    "clean_map": "SELECT ndc, rxcui, least(rxnorm_description, 'zz') AS rxnorm_description, atc_3_code, atc_3_name FROM atc",
    "enrich_atc": "SELECT rx.*, rxcui, rxnorm_description, atc_3_code, atc_3_name FROM rx LEFT JOIN (SELECT * FROM atc WHERE CAST(ndc AS BIGINT) % 50 <> 0) a ON ndc11code = lpad(ndc, 11, '0')",
    "match_rate": "SELECT count(*) AS n_rows, count(ndc) AS n_matched, round(count(ndc) / count(*), 6) AS share FROM rx LEFT JOIN (SELECT * FROM atc WHERE CAST(ndc AS BIGINT) % 50 <> 0) a ON ndc11code = lpad(ndc, 11, '0')",
    "ae_prefix_filter": f"SELECT code_value, count(*) AS n FROM claim_code WHERE {_PREFIXES} GROUP BY code_value",
    "code_type_filter": "SELECT code_type, count(*) AS n FROM claim_code WHERE code_type IN (17, 18, 22, 23, 24) GROUP BY code_type",
    "opioid_products": f"SELECT '0' || lpad(CAST(p_partkey AS VARCHAR), 10, '0') AS ndc11, p_name AS brand_name, CASE WHEN p_size % 5 = 0 THEN 'OXYCODONE ' ELSE '' END || p_name || ' ' || p_type || ', ACETAMINOPHEN ' || p_size || ' mg' AS strength, CASE WHEN p_size % 2 = 0 THEN 'ORAL, RECTAL' ELSE 'ORAL' END AS route, p_brand AS labeler_name FROM part WHERE p_size % 5 = 0 OR regexp_matches(lower(p_name), '{'|'.join(OPIOID_TERMS)}')",
    "coalesce_intervals": 'SELECT member_id, drug AS atc_3_code, s AS start, e AS "end", is_op FROM iv',
    "concurrency_sweep": "SELECT member_id, d AS day, CAST(n AS BIGINT) AS n, CAST(nq AS BIGINT) AS n_flagged FROM sweep",
    "detect_spells": "SELECT member_id, spell_id, entry_date, raw_exit_date, extended_exit_date, CAST(spell_length_days AS INTEGER) AS spell_length_days FROM spells",
    "drug_changes": "SELECT member_id, spell_id, date, change_type, atc_3_code, is_op FROM changes",
    "censor_enrollment": "SELECT member_id, spell_id, entry_date, raw_exit_date, extended_exit_date, CAST(spell_length_days AS INTEGER) AS spell_length_days, followup_end_date FROM censored",
    "washout": "SELECT member_id, spell_id, entry_date, raw_exit_date, extended_exit_date, CAST(spell_length_days AS INTEGER) AS spell_length_days, followup_end_date FROM washed",
    "washout_bridged": """, b1 AS (SELECT *, max(term) OVER (PARTITION BY member_id ORDER BY eff, term ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS so FROM enrollment),
      b2 AS (SELECT *, sum(CASE WHEN so IS NULL OR eff > so + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY member_id ORDER BY eff, term ROWS UNBOUNDED PRECEDING) AS i FROM b1), b3 AS (SELECT member_id, min(eff) AS eff, max(term) AS term FROM b2 GROUP BY member_id, i)
      SELECT member_id, spell_id, entry_date, raw_exit_date, extended_exit_date, CAST(spell_length_days AS INTEGER) AS spell_length_days, followup_end_date FROM censored c WHERE EXISTS (SELECT 1 FROM b3 e WHERE e.member_id = c.member_id AND eff <= entry_date - 180 AND term >= entry_date)""",
    "label_first_event": f"SELECT {_SEGMENT} FROM labelled",
    "split_at_adds": f"SELECT {_SEGMENT}, CAST(split_seq AS INTEGER) AS split_seq, segment_end_reason FROM segments",
    "latest_change": "SELECT g.spell_id, CAST(split_seq AS INTEGER) AS split_seq, c.date, c.change_type, c.atc_3_code FROM segments g LEFT JOIN changes c ON g.spell_id = c.spell_id AND c.date <= g.entry_date QUALIFY row_number() OVER (PARTITION BY g.spell_id, split_seq ORDER BY c.date DESC NULLS LAST, change_type DESC, atc_3_code DESC) = 1",
    "filled_status": "SELECT g.spell_id, CAST(split_seq AS INTEGER) AS split_seq, c.atc_3_code, arg_max(CAST(change_type = 'add' AS INTEGER), c.date * 2 + CAST(change_type = 'add' AS INTEGER)) AS is_on FROM segments g JOIN (SELECT spell_id, atc_3_code, change_type, date - DATE '1900-01-01' AS date FROM changes) c ON g.spell_id = c.spell_id AND c.date <= g.entry_date - DATE '1900-01-01' GROUP BY g.spell_id, split_seq, c.atc_3_code",
    "label_combo": "SELECT spell_id, CAST(split_seq AS INTEGER) AS split_seq, array_to_string(drugs, '+') AS drug_combo FROM combos",
    "label_combo_exact": "SELECT g.spell_id, CAST(g.split_seq AS INTEGER) AS split_seq, coalesce(string_agg(DISTINCT drug, '+' ORDER BY drug), '') AS drug_combo FROM segments g LEFT JOIN iv ON iv.member_id = g.member_id AND iv.s <= g.entry_date AND iv.e >= g.entry_date GROUP BY ALL",
    "diagnosis_windows": "SELECT member_id, spell_id, CAST(split_seq AS INTEGER) AS split_seq, code_value FROM windows",
    "cluster_codes": "SELECT member_id, spell_id, CAST(split_seq AS INTEGER) AS split_seq, array_to_string(icd, '+') AS icd10_codes FROM clusters",
    "finalize_cohort": "SELECT member_id, spell_id, CAST(split_seq AS INTEGER) AS split_seq, entry_date, CAST(spell_length_days AS INTEGER) AS spell_length_days, had_ae, first_ae_date, array_to_string(drugs, '+') AS drug_combo, array_to_string(icd, '+') AS icd10_codes, y, CAST(age AS INTEGER) AS age, gendercode, race AS raceethnicitytypecode, statecode FROM cohort",
    "attrition": " UNION ALL ".join(f"SELECT {i} AS step, '{name}' AS name, count(*) AS n_rows, count(DISTINCT member_id) AS n_members FROM {cte}" for i, (name, cte) in enumerate(_STEPS)),
    "spell_gaps": f"SELECT member_id, spell_id, CAST(gap_days AS INTEGER) AS gap_days FROM {_GAPS}",
    "describe_gaps": _describe("gap_days", _GAPS),
    "describe_lengths": _describe("spell_length_days", "segments", "segment_end_reason"),
    "hist_gaps": f"SELECT CAST(least(floor(gap_days / (200.0::DOUBLE / 60)), 59) AS BIGINT) AS bin, count(*) AS n FROM {_GAPS} WHERE gap_days BETWEEN 0 AND 200 GROUP BY 1",
    "hist_ae_timing": f"SELECT CASE WHEN first_ae_code IN {_TOP2.format(pool='SELECT first_ae_code FROM labelled WHERE had_ae')} THEN first_ae_code ELSE 'Other' END AS grp, CAST(least(first_ae_date - entry_date, 59) AS BIGINT) AS bin, count(*) AS n FROM labelled WHERE had_ae AND first_ae_date - entry_date BETWEEN 0 AND 60 GROUP BY ALL",
    "top_ae_codes": "SELECT value, n, round(100.0 * n / sum(n) OVER (), 6) AS share FROM (SELECT first_ae_code AS value, count(*) AS n FROM labelled WHERE first_ae_code IS NOT NULL GROUP BY 1 ORDER BY n DESC, value LIMIT 10)",
    "ae_by_description": f"SELECT {_DESCRIBED} AS description, count(*) AS n FROM diagnoses GROUP BY 1",
    "top_combos_k3": _top(3),
    "top_combos_k4": _top(4),
    "category_shares": """, ev AS (SELECT DISTINCT member_id FROM segments WHERE had_ae), non AS (SELECT DISTINCT member_id FROM segments WHERE member_id NOT IN (SELECT member_id FROM ev)),
      a AS (SELECT statecode AS value, count(*) AS n FROM people WHERE member_id IN (SELECT member_id FROM ev) GROUP BY 1), b AS (SELECT statecode AS value, count(*) AS n FROM people WHERE member_id IN (SELECT member_id FROM non) GROUP BY 1)
      SELECT value, coalesce(round(100.0 * a.n / (SELECT sum(n) FROM a), 6), 0) AS ae_pct, coalesce(round(100.0 * b.n / (SELECT sum(n) FROM b), 6), 0) AS non_ae_pct FROM a FULL JOIN b USING (value)""",
    "table1": " UNION ALL ".join(f"SELECT y AS grp, '{item}' AS item, {sql} AS value FROM cohort GROUP BY y" for item, sql in _TABLE1),
    "total_and_members": "SELECT count(*) AS n_rows, count(DISTINCT member_id) AS n_members, round(count(*) / count(DISTINCT member_id), 6) AS ratio FROM segments",
    "non_event_members": "SELECT DISTINCT member_id FROM segments WHERE member_id NOT IN (SELECT member_id FROM segments WHERE had_ae)",
    "member_code_counts": "SELECT member_id, count(DISTINCT c) AS n_codes FROM (SELECT member_id, unnest(icd) AS c FROM clusters) GROUP BY member_id",
    **{f"top_member_codes_{n}": f"SELECT c AS code, count(DISTINCT member_id) AS n_members FROM (SELECT member_id, unnest(icd) AS c FROM clusters) GROUP BY c ORDER BY n_members DESC, c LIMIT {n}" for n in (20, 500)},
    "adds_per_spell": "SELECT n_events, count(*) AS n FROM (SELECT spell_id, count(*) AS n_events FROM changes WHERE change_type = 'add' GROUP BY 1) GROUP BY 1",
    "ae_by_split_seq": "SELECT CAST(split_seq AS INTEGER) AS split_seq, count(*) AS n FROM segments WHERE had_ae GROUP BY 1",
    "days_into_spell": "SELECT spell_id, CAST(first_ae_date - entry_date AS INTEGER) AS days FROM labelled WHERE had_ae",
    "top_other_bucket": f"SELECT CASE WHEN first_ae_code IN {_TOP2.format(pool='SELECT first_ae_code FROM labelled UNION ALL SELECT first_ae_code FROM segments WHERE had_ae')} THEN first_ae_code ELSE 'Other' END AS grp, count(*) AS n FROM labelled WHERE had_ae GROUP BY 1",
    "multi_hot_long": """, h AS (SELECT spell_id, split_seq, unnest(icd) AS c FROM cohort), k AS (SELECT c FROM h GROUP BY c HAVING count(*) >= 50)
      SELECT spell_id, CAST(split_seq AS INTEGER) AS split_seq, 'DRUG_' || unnest(drugs) AS feature, 1 AS value FROM cohort UNION ALL SELECT spell_id, CAST(split_seq AS INTEGER), 'ICD_' || c, 1 FROM h WHERE c IN (SELECT c FROM k)""",
    "one_hot_long": "SELECT member_id, 'gendercode_' || coalesce(gendercode, 'NaN') AS feature, 1 AS value FROM people UNION ALL SELECT member_id, 'raceethnicitytypecode_' || coalesce(race, 'NaN'), 1 FROM people",
    "age_buckets": f"SELECT {_AGE} AS bucket, {_RACE} AS race, count(*) AS n FROM cohort GROUP BY ALL",
    "vocab_index": f"SELECT code, CAST(idx AS INTEGER) AS idx FROM {_VOCAB}",
    "encode_sequence": f""", v AS (SELECT * FROM {_VOCAB} WHERE code <> 'Brand#7'), p AS (SELECT spell_id, split_seq, unnest(generate_series(1, least(len(drugs), {MAX_DRUGS}))) AS i, drugs FROM cohort),
      e AS (SELECT spell_id, split_seq, list(coalesce(idx, 1) ORDER BY i) AS ids FROM p LEFT JOIN v ON v.code = drugs[i] GROUP BY ALL)
      SELECT spell_id, CAST(split_seq AS INTEGER) AS split_seq, array_to_string(list_resize(ids, {MAX_DRUGS}, 0), ' ') AS ids FROM e""",
    "pooled_embedding": _pooled("drugs", "vectors"),
    "pooled_icd_embedding": _pooled("icd", "icd_vectors"),
    "flattened_embedding": f"""SELECT spell_id, CAST(split_seq AS INTEGER) AS split_seq, CAST(place AS INTEGER) AS place, round(list_sum(vec), 4) AS total FROM (
        SELECT spell_id, split_seq, i - 1 AS place, vec FROM (SELECT *, unnest(generate_series(1, least(len(icd), {MAX_CODES}))) AS i FROM cohort) JOIN icd_vectors ON code = icd[i]
        UNION ALL SELECT spell_id, split_seq, {MAX_CODES} + i - 1, vec FROM (SELECT *, unnest(generate_series(1, least(len(drugs), {MAX_DRUGS}))) AS i FROM cohort) JOIN vectors ON code = drugs[i])""",
    "stratified_split": """SELECT y, is_train, count(*) AS n FROM (
        SELECT y, row_number() OVER (PARTITION BY y ORDER BY CAST('0x' || substr(md5(CAST(spell_id AS VARCHAR) || '|' || CAST(split_seq AS VARCHAR)), 1, 8) AS BIGINT), spell_id, split_seq) <= floor(count(*) OVER (PARTITION BY y) * 0.8) AS is_train FROM cohort) GROUP BY ALL""",
    "class_weights": """SELECT y, n, round(t.all_n / (2 * n), 6) AS balanced, CASE WHEN y = 1 THEN round((t.all_n - pos) / pos, 6) ELSE 1.0 END AS pos_weight, CASE WHEN y = 1 THEN round(least((t.all_n - pos) / pos, 50), 6) ELSE 1.0 END AS capped, CASE WHEN y = 1 THEN round(sqrt((t.all_n - pos) / pos), 6) ELSE 1.0 END AS root
      FROM (SELECT y, count(*) AS n FROM scored GROUP BY y), totals t""",
    "median_age": "SELECT round(CAST(median(age) AS DOUBLE), 6) AS median FROM cohort",
    "average_precision": "SELECT round(sum(tp / pos * ctp / cn), 6) AS average_precision FROM ranked, totals",
    "roc_auc": "SELECT round(sum(tp * ((all_n - pos) - (cn - ctp) + (n - tp) / 2) / pos / (all_n - pos)), 6) AS roc_auc FROM ranked, totals",
    "precision_at_fraction": ", o AS (SELECT *, row_number() OVER (ORDER BY score DESC, row_id) AS r FROM scored, totals) " + " UNION ALL ".join(f"SELECT CAST({f} AS DOUBLE) AS fraction, count(*) AS k, round(avg(y), 6) AS precision, round(sum(y) / max(pos), 6) AS recall, round(avg(y) / (max(pos) / max(all_n)), 6) AS enrichment FROM o WHERE r <= floor({f}::DOUBLE * all_n)" for f in (0.001, 0.01, 0.05, 0.1)),
    "pr_curve": "SELECT * FROM curve",
    "best_f1": "SELECT * FROM curve ORDER BY f1 DESC, threshold LIMIT 1",
    "threshold_for_precision": " UNION ALL ".join(f"(SELECT CAST({t} AS DOUBLE) AS target, score AS threshold, round(ctp / cn, 6) AS precision, round(ctp / pos, 6) AS recall FROM ranked, totals WHERE ctp / cn >= {t} ORDER BY score LIMIT 1)" for t in (0.05, 0.1, 0.2)),
    "f1_sweep": "SELECT i / 100 AS threshold, round(coalesce(2 * s.ctp / nullif(s.cn + pos, 0), 0), 6) AS f1 FROM (SELECT i, (SELECT count(*) FROM scored WHERE score + 1e-11 >= i / 100) AS cn, (SELECT coalesce(sum(y), 0) FROM scored WHERE score + 1e-11 >= i / 100) AS ctp FROM (SELECT unnest(generate_series(0, 100)) AS i)) s, totals",
    "class_report": _report(),
    "key_range_batches": ", k AS (SELECT DISTINCT member_id FROM rx), r AS (SELECT member_id, row_number() OVER (ORDER BY member_id) AS rank FROM k) SELECT member_id, rank, CAST((rank - 1) // 200 AS BIGINT) AS batch FROM r",
    "json_file_vectors": "SELECT code, CAST(len(vec) AS INTEGER) AS n, round(list_sum(list_transform(vec, lambda x: CAST(CAST(x AS FLOAT) AS DOUBLE))), 3) AS total FROM vectors",
    "batched_extract": ", k AS (SELECT DISTINCT member_id FROM rx), r AS (SELECT member_id, CAST((row_number() OVER (ORDER BY member_id) - 1) // 200 AS BIGINT) AS batch FROM k) SELECT batch, count(*) AS n_rows, count(DISTINCT member_id) AS n_members FROM rx JOIN r USING (member_id) GROUP BY batch",
    "sketched_lengths": "SELECT segment_end_reason, count(*) AS n_rows, count(DISTINCT member_id) AS n_members, true AS close_members, true AS close_quartiles FROM segments GROUP BY segment_end_reason",
    "hash_buckets": "SELECT member_id % 100 AS bucket, count(*) AS n_rows, count(DISTINCT member_id) AS n_keys FROM rx GROUP BY 1",
    "json_explode": """, d AS (SELECT *, lpad(CAST(p_partkey AS VARCHAR), 10, '0') AS n FROM part), e AS (SELECT *, n[1:4] || '-' || n[5:8] || '-' || n[9:10] AS package_ndc FROM d)
      SELECT package_ndc, 0 AS place, CASE WHEN p_size % 5 = 0 THEN 'OXYCODONE ' ELSE '' END || p_name AS ingredient, p_type AS strength FROM e UNION ALL SELECT package_ndc, 1, 'ACETAMINOPHEN', p_size || ' mg' FROM e""",
    "validate_dataset": "SELECT 'rows' AS \"check\", count(*) AS value FROM people UNION ALL SELECT 'columns', 5 UNION ALL SELECT 'has:member_id', 1 UNION ALL SELECT 'has:zip3value', 0" + "".join(f" UNION ALL SELECT 'nulls:{a}', count(*) FILTER ({b} IS NULL) FROM people" for a, b in (("member_id", "member_id"), ("birthyear", "birthyear"), ("gendercode", "gendercode"), ("raceethnicitytypecode", "race"), ("statecode", "statecode"))),
}

ORACLES: dict[str, str] = {name: CHAIN + sql for name, sql in _PLAIN.items()} | {
    "combo_pairs": _mined(2),
    "combo_pairs_containing": _mined(2, "WHERE contains(item1, 'Brand#7') OR contains(item2, 'Brand#7') OR contains(m1.name, 'Brand#7') OR contains(m2.name, 'Brand#7')"),
    "combo_trios": _mined(3),
    "combo_sets": _mined(None),
    **{f"top_{name}_by_rate": _mined(k, "ORDER BY adjusted.rate DESC, " + _items(k) + " LIMIT 10", _items(k) + ", CAST(n_total AS BIGINT) AS n_total, n_ae, round(rate, 6) AS rate") for k, name in ((2, "pairs"), (3, "trios"))},
    **{f"top_{name}_by_count": _mined(k, "WHERE p_adj < 0.05 AND adjusted.rate > all_ae / all_n ORDER BY n_ae DESC, " + _items(k) + " LIMIT 10", _items(k) + ", CAST(n_total AS BIGINT) AS n_total, n_ae, round(rate, 6) AS rate") for k, name in ((2, "pairs"), (3, "trios"))},
    "bh_forward_cummin": _mined(2, select="item1, item2, round(p_forward, 5) AS p_adj"),
}
# The same rows another way.
ORACLES |= {"json_file_products": ORACLES["json_explode"], "bucketed_spells": ORACLES["detect_spells"]}
