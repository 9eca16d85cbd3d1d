"""DuckDB SQL for the registered queries, written independently of the operators."""

from __future__ import annotations

from ..operators.extract import Windows
from ..operators.pages import ANY
from . import config as C


def values(rows, columns: str) -> str:
    lit = lambda x: "NULL" if x is None else str(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x).lower() if isinstance(x, bool) else "[" + ", ".join(map(lit, x)) + "]::VARCHAR[]" if isinstance(x, (list, tuple)) else "'" + x.replace("'", "''") + "'"
    return "(VALUES " + ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows) + f") AS {columns}"


def blank(c: str) -> str:
    return f"coalesce(lower(trim({c})) IN ('', 'nan'), true)"


def stub(c: str) -> str:
    return f"({blank(c)} OR coalesce(contains(lower(trim({c})), 'see link'), false))"


def strict(c: str) -> str:
    return f"TRY_CAST(CASE WHEN regexp_matches(trim(split_part({c}, '-', 1)), '^[+-]?[0-9]+$') THEN trim(split_part({c}, '-', 1)) END AS INTEGER)"


EV = """
ev AS (
  SELECT lpad(l_orderkey::VARCHAR, 12, '0') || '|' || lpad(l_linenumber::VARCHAR, 3, '0') || '|' || lpad(l_partkey::VARCHAR, 12, '0') || '|' || lpad(l_suppkey::VARCHAR, 9, '0') || '|' || lpad(cents::VARCHAR, 14, '0') || '|' ||
      lpad(l_quantity::BIGINT::VARCHAR, 6, '0') || '|' || lpad(round(l_discount * 100)::BIGINT::VARCHAR, 3, '0') || '|' || lpad(round(l_tax * 100)::BIGINT::VARCHAR, 3, '0') || '|' || l_returnflag || '|' || l_linestatus || '|' || strftime(l_shipdate, '%Y-%m-%d') AS _ord,
    r_name AS indication, 'demand_' || lower(p_type) AS metric,
    CASE WHEN m = 0 OR p_type = 'SMALL' THEN 'See link https://example.org/item/' || l_partkey WHEN m = 1 THEN format('{:,}', cents // 100) || ' (count)' WHEN m = 2 THEN num || ' (share); 4 (parts)'
      WHEN m = 3 THEN CASE WHEN l_linenumber % 2 = 0 THEN 'nan' END WHEN m = 4 THEN (cents // 100)::VARCHAR ELSE num END AS value,
    s_name || CASE s % 5 WHEN 0 THEN ' (https://data.example.org/s/' || s || ').' WHEN 1 THEN ' PMID: 1234' || lpad(s::VARCHAR, 9, '0') WHEN 2 THEN ' National Ledger' WHEN 3 THEN ' open registry note' ELSE '' END AS source_citation,
    CASE s % 4 WHEN 0 THEN 'gold' WHEN 1 THEN 'silver' WHEN 2 THEN ' Bronze' ELSE 'platinum' END AS source_tier,
    CASE WHEN l_partkey % 3 <> 0 THEN p_name END AS definition, CASE WHEN l_orderkey % 13 = 0 THEN '' ELSE c_mktsegment END AS population,
    CASE l_partkey % 7 WHEN 0 THEN y || '-' || (y + 1) WHEN 1 THEN 'FY' || y WHEN 2 THEN y || '.0' WHEN 3 THEN NULL ELSE y::VARCHAR END AS year_or_range,
    n_name AS geography, CASE l_returnflag WHEN 'R' THEN 'segment' WHEN 'N' THEN 'age band' END AS split_logic,
    CASE s % 7 WHEN 0 THEN 'https://kept.example.org/' WHEN 1 THEN '' END AS source_url,
    CASE l_linenumber % 5 WHEN 0 THEN 'High' WHEN 1 THEN '0.72' WHEN 2 THEN '0.4' WHEN 3 THEN 'low' END AS confidence
  FROM (SELECT *, round(l_extendedprice * 100)::BIGINT AS cents, l_orderkey % 10 AS m, year(l_shipdate) AS y, l_suppkey AS s,
          (round(l_extendedprice * 100)::BIGINT // 100)::VARCHAR || '.' || lpad((round(l_extendedprice * 100)::BIGINT % 100)::VARCHAR, 2, '0') AS num FROM lineitem) l
  JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ns ON s_nationkey = ns.n_nationkey
  JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN (SELECT n_nationkey AS hk, r_name FROM nation JOIN region ON n_regionkey = r_regionkey) h ON c_nationkey = hk)
"""

NUM = rf"CASE WHEN NOT {stub('value')} THEN TRY_CAST(replace(regexp_extract(regexp_replace(value, '\s*\([^)]*\)\s*', ' ', 'g'), '(\d{{1,3}}(?:,\d{{3}})+(?:\.\d+)?|\d+(?:\.\d+)?)', 1), ',', '') AS DOUBLE) END"
URL = r"""CASE WHEN regexp_extract(source_citation, '(https?://[^\s)\]"'']+)', 1) <> '' THEN regexp_replace(regexp_extract(source_citation, '(https?://[^\s)\]"'']+)', 1), '[.,;)]+$', '')
 WHEN regexp_extract(source_citation, '(?i)PMID[:\s]+(\d{6,10})', 1) <> '' THEN 'https://pubmed.ncbi.nlm.nih.gov/' || regexp_extract(source_citation, '(?i)PMID[:\s]+(\d{6,10})', 1) || '/' """ + " ".join(f"WHEN contains(lower(source_citation), '{k}') THEN '{u}'" for k, u in C.URL_KEYS) + " END"
LEGACY = """CASE WHEN lower(trim(confidence)) IN ('high', 'medium', 'low') THEN lower(trim(confidence))
 WHEN TRY_CAST(trim(confidence) AS DOUBLE) BETWEEN 0 AND 1 THEN CASE WHEN TRY_CAST(trim(confidence) AS DOUBLE) >= 0.7 THEN 'high' WHEN TRY_CAST(trim(confidence) AS DOUBLE) >= 0.4 THEN 'medium' ELSE 'low' END ELSE confidence END"""
_recent = r"TRY_CAST(nullif(regexp_extract(year_or_range, '(20\d{2}|19\d{2})', 1), '') AS INTEGER)"
SCORE = f"""greatest(0, least(100, CASE lower(trim(source_tier)) WHEN 'gold' THEN 35 WHEN 'silver' THEN 22 ELSE 15 END + CASE WHEN {stub('value')} THEN 0 ELSE 30 END
 + {" + ".join(f"CASE WHEN {blank(c)} THEN 0 ELSE 6 END" for c in ("definition", "year_or_range", "geography", "population"))}
 + CASE WHEN {_recent} >= {C.AS_OF - 1} THEN 5 WHEN {_recent} >= {C.AS_OF - 5} THEN 3 ELSE 0 END + CASE WHEN {blank('source_url')} THEN 0 ELSE 5 END))::BIGINT"""
_m, _b = "lower(trim(metric))", "regexp_replace(lower(trim(metric)), '^[^_]*_', '')"
CLUSTER = "CASE " + " ".join(f"WHEN {x} = '{k}' THEN '{c}'" for x in (_m, _b) for k, c in C.CLUSTERS.items()) + " " + " ".join(f"WHEN contains({_m}, '{p}') THEN '{c}'" for p, c in C.CLUSTER_PATTERNS) + " ELSE 'unknown' END"
CLUSTER_LABEL = "CASE cluster " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in C.CLUSTER_LABELS.items()) + " END"

EN = f"""{EV},
e1 AS (SELECT * REPLACE (CASE WHEN {blank('source_url')} THEN {URL} ELSE source_url END AS source_url, {LEGACY} AS confidence) FROM ev),
e2 AS (SELECT *, {SCORE} AS computed_confidence_score, {CLUSTER} AS cluster, {NUM} AS value_num, CASE lower(trim(source_tier)) WHEN 'gold' THEN 0 WHEN 'silver' THEN 1 ELSE 2 END AS tier_rank FROM e1),
en AS (SELECT *, CASE WHEN computed_confidence_score >= 70 THEN 'high' WHEN computed_confidence_score >= 40 THEN 'medium' ELSE 'low' END AS computed_confidence, {CLUSTER_LABEL} AS cluster_label FROM e2),
req AS (SELECT * FROM {values(C.METRICS, "t(metric_id, label, required, evidence_ids)")})
"""

CARD = f"""{EN},
own AS (SELECT metric_id, metric_id AS metric, true AS own FROM req WHERE metric_id IN (SELECT metric FROM en)
  UNION ALL SELECT metric_id, unnest(list_distinct(evidence_ids)), false FROM req WHERE metric_id NOT IN (SELECT metric FROM en)),
rw AS (SELECT metric_id, own, en.* FROM en JOIN own USING (metric)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY metric_id, value_num IS NULL ORDER BY tier_rank, value_num DESC, _ord) AS k, row_number() OVER (PARTITION BY metric_id ORDER BY _ord) AS f,
  row_number() OVER (PARTITION BY metric_id, value_num IS NULL ORDER BY value_num) AS p, count(value_num) OVER (PARTITION BY metric_id) AS n FROM rw),
med AS (SELECT metric_id, max(value_num) AS med FROM ranked WHERE value_num IS NOT NULL AND p = n // 2 + 1 GROUP BY 1),
agr AS (SELECT metric_id, count(*) AS n, count(*) FILTER (CASE WHEN med = 0 THEN value_num = 0 ELSE abs(value_num - med) / med <= 0.2 END) AS a FROM ranked JOIN med USING (metric_id) WHERE value_num IS NOT NULL GROUP BY 1),
sums AS (SELECT metric_id, count(DISTINCT source_citation) AS n_sources, count(value_num) AS n_with_value, min(value_num) AS range_min, max(value_num) AS range_max,
  max(CASE WHEN value_num IS NOT NULL AND k = 1 THEN value_num END) AS best_value, max(CASE WHEN value_num IS NOT NULL AND k = 1 THEN source_citation END) AS bs, max(CASE WHEN f = 1 THEN source_citation END) AS fs,
  bool_or(own AND computed_confidence = 'high') AS high, bool_or(value_num IS NOT NULL AND tier_rank = 0) AS gold FROM ranked GROUP BY 1),
card AS (SELECT metric_id, label, required, best_value, coalesce(bs, fs) AS best_source, range_min, range_max, coalesce(n_sources, 0) AS n_sources, coalesce(n_with_value, 0) AS n_with_value,
  CASE WHEN n_sources IS NULL THEN 'no data' WHEN n_with_value = 0 THEN 'no numeric values' WHEN n < 2 THEN n || ' source(s)' ELSE a || ' of ' || n || ' agree' || CASE WHEN n > a THEN '; ' || (n - a) || ' outlier(s)' ELSE '' END END AS agreement_flag,
  CASE WHEN coalesce(n_sources, 0) = 0 THEN 'No source' WHEN n_with_value > 0 AND (n < 2 OR n = a) AND (high OR gold) THEN 'Ready' ELSE 'Needs review' END AS validation_status
  FROM req LEFT JOIN sums USING (metric_id) LEFT JOIN agr USING (metric_id))
"""

COVER = f"""{EN},
cv AS (SELECT metric, count(DISTINCT source_citation) AS n_sources, count(*) FILTER (NOT {stub('value')}) AS n_with_value, count(*) FILTER ({stub('value')} AND value IS NOT NULL) AS n_stub,
  left(array_to_string(list_slice(list_sort(list(DISTINCT source_citation) FILTER (NOT {stub('value')})), 1, 10), '; '), 500) AS source_list FROM en GROUP BY 1),
cover AS (SELECT metric_id, label, coalesce(n_sources, 0) AS n_sources, coalesce(n_with_value, 0) AS n_with_value, coalesce(n_stub, 0) AS n_stub, coalesce(source_list, '') AS source_list,
  CASE WHEN n_with_value > 0 THEN 'Has value' WHEN n_stub > 0 OR n_sources > 0 THEN 'Stub only' ELSE 'Missing' END AS coverage_status FROM req LEFT JOIN cv ON metric_id = metric)
"""

TREND = f"""{EV},
pt AS (SELECT metric, _ord, {strict('year_or_range')} AS y, TRY_CAST(trim(value) AS DOUBLE) AS v FROM ev WHERE {strict('year_or_range')} IS NOT NULL AND TRY_CAST(trim(value) AS DOUBLE) IS NOT NULL AND lower(trim(value)) <> 'nan'),
rk AS (SELECT DISTINCT * FROM pt),
r2 AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY y DESC, _ord DESC, v DESC) AS k FROM rk),
lst AS (SELECT a.metric, a.y AS last_year, a.v AS v2, b.y AS y1, b.v AS v1, (SELECT arg_min(v, _ord) FROM pt WHERE pt.metric = a.metric AND pt.y = a.y) AS last_value FROM r2 a LEFT JOIN r2 b ON a.metric = b.metric AND b.k = 2 WHERE a.k = 1),
gr AS (SELECT *, CASE WHEN last_year > y1 AND v1 > 0 THEN pow(v2 / v1, 1.0 / (last_year - y1)) - 1 ELSE 0 END AS g FROM lst)
"""


def with_(ctes: str, query: str) -> str:
    return f"WITH {ctes} {query}"


YEARS = list(range(1995, 2002))
_scan = "lower(trim(source_tier))"

ORACLES: dict[str, str] = {
    "evidence_scan_tiered": with_(EV, f"SELECT _ord, indication, metric, value, source_citation, {_scan} AS tier, CASE {_scan} WHEN 'gold' THEN 0 WHEN 'silver' THEN 1 ELSE 2 END::BIGINT AS tier_order FROM ev WHERE {_scan} IN ('gold', 'silver', 'bronze')"),
    "tier_log": with_(EV, f"SELECT {_scan} AS tier, count(*) AS n_rows, CASE WHEN {_scan} IN ('gold', 'silver', 'bronze') THEN 'kept' ELSE 'dropped' END AS status FROM ev GROUP BY 1"),
    "run_rows": with_(EV, f"SELECT indication, metric, CASE WHEN NOT {blank('value')} THEN trim(value) END AS value, coalesce(CASE WHEN NOT {blank('source_citation')} THEN trim(source_citation) END, 'upload') AS source_citation, 'Everywhere' AS geography, CASE WHEN NOT {blank('population')} THEN trim(population) END AS population FROM ev WHERE NOT {stub('value')}"),
    "numeric_extract": with_(EV, f"SELECT _ord, value, {stub('value')} AS is_stub, {NUM} AS value_num FROM ev"),
    "year_parsers": with_(EV, rf"SELECT _ord, year_or_range, TRY_CAST(nullif(regexp_extract(replace(year_or_range, '-', ' '), '(?:^|\s)(\d{{4}})', 1), '') AS BIGINT) AS loose, {strict('year_or_range')}::BIGINT AS strict, {_recent}::BIGINT AS recent FROM ev"),
    "confidence_score": with_(EN, "SELECT _ord, computed_confidence_score, computed_confidence FROM en"),
    "legacy_confidence": with_(EV, f"SELECT confidence AS given, {LEGACY} AS confidence, count(*) AS n_rows FROM ev GROUP BY ALL"),
    "url_resolve": with_(EN, "SELECT _ord, source_citation, source_url FROM en"),
    "url_coverage": with_(EN, f"SELECT indication, count(*) AS n_rows, count(*) FILTER ({blank('source_url')}) AS n_without, round(100.0 * count(*) FILTER ({blank('source_url')}) / count(*), 1)::DOUBLE AS pct_without FROM en GROUP BY 1"),
    "cluster_assign": with_(EN, "SELECT metric, cluster, cluster_label, count(*) AS n_rows FROM en GROUP BY ALL"),
    "cluster_summary": with_(EN, "SELECT indication, cluster, count(*) AS n_rows, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY indication), 1)::DOUBLE AS pct FROM en GROUP BY 1, 2"),
    "kpi_scorecard": with_(CARD, "SELECT * FROM card"),
    "coverage_matrix": with_(COVER, "SELECT * FROM cover"),
    "white_space_counts": with_(COVER, "SELECT coverage_status, count(*) AS n_metrics FROM cover GROUP BY 1"),
    "conflicts": with_(EV, """, c AS (SELECT _ord, metric, coalesce(year_or_range, '') AS year_or_range, coalesce(population, '') AS population, trim(value) AS v, source_citation FROM ev WHERE trim(coalesce(value, '')) <> ''),
        o AS (SELECT *, row_number() OVER (PARTITION BY metric, year_or_range, population ORDER BY _ord, source_citation) AS k FROM c),
        d AS (SELECT metric, year_or_range, population, v, min(_ord) AS first_at FROM c GROUP BY ALL),
        dk AS (SELECT *, row_number() OVER (PARTITION BY metric, year_or_range, population ORDER BY first_at, v) AS k, count(*) OVER (PARTITION BY metric, year_or_range, population) AS n FROM d)
        SELECT metric, year_or_range, population, a.v AS value_1, b.v AS value_2, s1.source_citation AS source_1, s2.source_citation AS source_2, a.n AS n_values
        FROM dk a JOIN dk b USING (metric, year_or_range, population) JOIN o s1 USING (metric, year_or_range, population) JOIN o s2 USING (metric, year_or_range, population) WHERE a.k = 1 AND b.k = 2 AND s1.k = 1 AND s2.k = 2"""),
    "reconciliation": with_(EN, """, r AS (SELECT metric AS metric_id, label, coalesce(year_or_range, '') AS year_or_range, coalesce(geography, '') AS geography, _ord, source_citation, value_num, tier_rank FROM en JOIN req ON metric = metric_id WHERE value_num IS NOT NULL)
        SELECT metric_id, label, year_or_range, geography, left(string_agg(source_citation || ': ' || format('{:,.2f}', value_num), '; ' ORDER BY _ord, source_citation, value_num), 1000) AS value_by_source, min(value_num) AS range_min, max(value_num) AS range_max,
        first(value_num ORDER BY tier_rank, _ord, value_num) AS recommended_value, first(source_citation ORDER BY tier_rank, _ord, value_num) AS recommended_source, count(*) AS n_rows FROM r GROUP BY 1, 2, 3, 4 HAVING count(*) >= 2 AND count(DISTINCT round(value_num, 4)) >= 2"""),
    "insights_summary": with_(CARD, f""", i AS (SELECT metric, count(value) AS n_values, string_agg(DISTINCT {_scan}, ', ' ORDER BY {_scan}) AS tiers, min({strict('year_or_range')})::BIGINT AS min_year, max({strict('year_or_range')})::BIGINT AS max_year,
        metric IN (SELECT metric_id FROM card WHERE validation_status = 'No source') AS has_gap FROM en GROUP BY 1)
        SELECT *, metric || ': ' || n_values || ' value(s)' || CASE WHEN min_year IS NULL THEN '' WHEN min_year = max_year THEN ' for ' || min_year ELSE ' for ' || min_year || ' to ' || max_year END || ' from ' || tiers || CASE WHEN has_gap THEN ' (gap)' ELSE '' END AS insight FROM i"""),
    "tidy_table": with_(EV, f"SELECT _ord, indication, metric, value, {strict('year_or_range')}::BIGINT AS year, source_citation AS source, CASE WHEN NOT {blank('split_logic')} THEN 'stage' END AS split_type, CASE WHEN NOT {blank('split_logic')} THEN trim(split_logic) END AS split_value, 'Base' AS scenario_label, '' AS growth_label FROM ev"),
    "wide_pivot": with_(EV, f", t AS (SELECT _ord, coalesce(split_logic, metric) AS parameter, value, {strict('year_or_range')} AS y FROM ev) SELECT row_number() OVER (ORDER BY parameter) AS sr_no, parameter, "
        + ", ".join(f"first(value ORDER BY _ord, value) FILTER (y = {y} AND value IS NOT NULL) AS y{y}" for y in YEARS) + " FROM t WHERE y IS NOT NULL GROUP BY parameter"),
    "one_column": with_(EV, "SELECT coalesce(split_logic, metric) AS parameter, first(value ORDER BY _ord, value) AS value FROM ev GROUP BY 1"),
    "forecast_auto": with_(TREND, "SELECT metric, (last_year + h)::BIGINT AS year, round(last_value * pow(1 + g, h), 2) AS forecast, round(g, 6) AS growth FROM gr, generate_series(1, 5) AS s(h)"),
    "forecast_rates": with_(TREND, f"SELECT metric, (last_year + h)::BIGINT AS year, round(last_value * pow(1 + coalesce(r, g), h), 2) AS forecast, round(coalesce(r, g), 6) AS growth FROM gr LEFT JOIN {values([(k, float(v)) for k, v in C.GROWTH.items()], 'x(xm, r0)')} ON metric = xm, LATERAL (SELECT r0::DOUBLE AS r), generate_series(1, 5) AS s(h)"),
    "forecast_scenarios": with_(TREND, f"SELECT metric, scenario, (last_year + h)::BIGINT AS year, round(last_value * pow(1 + r::DOUBLE, h), 2) AS forecast FROM gr, {values([(i, r) for i, _, r in C.SCENARIOS], 'x(scenario, r)')}, generate_series(1, 5) AS s(h)"),
    "validation_findings": with_(EV, f""", t AS (SELECT *, {_scan} NOT IN ('gold', 'silver', 'bronze') AS bad FROM ev), k AS (SELECT count(*) AS n FROM ev GROUP BY metric, coalesce(year_or_range, ''), coalesce(geography, ''))
        SELECT 'error' AS level, 'invalid_tier' AS code, 'unknown tiers: ' || string_agg(DISTINCT {_scan}, ', ' ORDER BY {_scan}) AS message, count(*) AS n_rows FROM t WHERE bad HAVING count(*) > 0
        UNION ALL SELECT 'warning', 'blank_metric', 'blank metric', count(*) FROM t WHERE {blank('metric')} HAVING count(*) > 0
        UNION ALL SELECT 'warning', 'blank_value', 'blank value', count(*) FROM t WHERE {blank('value')} HAVING count(*) > 0
        UNION ALL SELECT 'warning', 'blank_source_citation', 'blank source_citation', count(*) FROM t WHERE {blank('source_citation')} HAVING count(*) > 0
        UNION ALL SELECT 'warning', 'repeated_key', 'repeated metric, year and geography', sum(n)::BIGINT FROM k WHERE n > 1 HAVING count(*) > 0"""),
    "output_validation": with_(EN, "SELECT CASE WHEN count(*) FILTER (cluster = 'unknown') > 0.2 * count(*) THEN 'warning' ELSE 'info' END AS level, CASE WHEN count(*) FILTER (cluster = 'unknown') > 0.2 * count(*) THEN 'cluster_nulls' ELSE 'ok' END AS code, count(*) FILTER (cluster = 'unknown') || ' of ' || count(*) || ' rows without cluster' AS message, count(*) FILTER (cluster = 'unknown') AS n_rows FROM en"),
    "fill_rates": with_(EV, " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) AS n_rows, round(100.0 * count(*) FILTER (NOT {blank(c)}) / count(*), 1)::DOUBLE AS filled FROM ev" for c in ("value", "definition", "population", "source_url", "confidence"))),
    "top_sources": with_(EV, "SELECT source_citation, count(*) AS n_rows FROM ev GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5"),
    "confidence_mix": with_(EN, "SELECT computed_confidence, count(*) AS n_rows FROM en GROUP BY 1"),
    "phrasing_best": "WITH c AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY 1, 2) SELECT source, max(n) AS best_count, first(lang ORDER BY n DESC, lang DESC) AS best_label, count(*) AS n_tried FROM c GROUP BY 1",
    "indicator_series": "SELECT event_type AS series, arg_min(round(value, 2), event_id) AS first_value, left(min(ts)::VARCHAR, 4)::BIGINT AS year, count(*) AS n_rows FROM events WHERE value IS NOT NULL GROUP BY 1",
    "run_summary": with_(EN, "SELECT count(DISTINCT indication) AS n_runs, count(DISTINCT indication) FILTER (value_num IS NOT NULL) AS n_succeeded FROM en"),
    "synonym_match": f"""WITH l AS (SELECT DISTINCT p_name AS label, lower(trim(p_name)) AS s FROM part), d AS (SELECT * FROM {values([(m, s, i) for i, (m, s) in enumerate((m, s) for m, ss in C.SYNONYMS.items() for s in ss)], 'd(m, syn, pos)')}),
        x AS (SELECT label, s, m, pos, CASE WHEN s = syn THEN 0.95::DOUBLE WHEN contains(s, syn) THEN 0.75 + 0.15::DOUBLE * length(syn) / length(s) WHEN contains(syn, s) THEN 0.65::DOUBLE ELSE 0::DOUBLE END AS sc FROM l, d),
        b AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY sc DESC, pos) AS k FROM x)
        SELECT label, CASE WHEN s = '' THEN 'unknown' WHEN sc >= 0.5 THEN m ELSE trim(regexp_replace(lower(label), '[^a-z0-9]+', '_', 'g'), '_') END AS metric_id, CASE WHEN s <> '' AND sc >= 0.5 THEN round(sc, 4) ELSE 0 END AS score, CASE WHEN s = '' THEN 'blank' WHEN sc >= 0.5 THEN 'synonym' ELSE 'slug' END AS how FROM b WHERE k = 1""",
    "embedding_match": """WITH u AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), a AS (SELECT label, i, avg(x) AS x FROM u GROUP BY ALL), p AS (SELECT label, list(x ORDER BY i) AS v FROM a GROUP BY 1),
        c AS (SELECT vec_id, p.label AS matched, round(list_cosine_similarity(embedding::DOUBLE[], v), 6) AS sc FROM embeddings, p), b AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY sc DESC, matched) AS k FROM c) SELECT vec_id, matched, round(sc, 4) AS score FROM b WHERE k = 1""",
    "abstract_relevance": "WITH w AS (SELECT doc_id, lower(text) AS t, list_distinct(regexp_extract_all(lower(text), '[a-zA-Z]{3,}')) AS a, list_distinct(regexp_extract_all('" + C.RELEVANCE_BLOB + "', '[a-zA-Z]{3,}')) AS b FROM documents) SELECT doc_id, CASE WHEN len(a) = 0 THEN 0 ELSE round(len(list_intersect(a, b))::DOUBLE / (len(a) + len(b) - len(list_intersect(a, b))) + 0.07 * least(6, " + " + ".join(f"contains(t, '{w}')::INT" for w in C.RELEVANCE_TERMS) + "), 6) END AS relevance FROM w",
    "alias_resolve": f"SELECT n_name AS place, coalesce(canon, lower(trim(n_name))) AS canonical, coalesce(c, CASE WHEN length(trim(n_name)) = 2 THEN upper(trim(n_name)) END) AS code FROM nation LEFT JOIN {values(C.PLACES, 'p(a, canon, c)')} ON lower(trim(n_name)) = a",
    "catalogue_links": "SELECT * FROM (VALUES ('s5', 'Archive', 'gold', 'demand_medium', 'https://archive.example.org/', 3::BIGINT), ('s1', 'Open ledger', 'gold', 'demand_standard', 'https://ledger.example.org/?q=red+widget+%26+co&c=Nation_0', 2), ('s2', 'Market notes', 'bronze', 'demand_large', 'https://notes.example.org/Nation_0', 99)) AS t(id, name, tier, metric, url, priority)",
    "links_to_fetch": "SELECT * FROM (VALUES ('s5', 'demand_medium', 3::BIGINT), ('s2', 'demand_large', 99)) AS t(id, metric, priority)",
    "label_candidates": "SELECT DISTINCT p_name, array_to_string(list_filter([" + ", ".join("CASE WHEN " + " OR ".join(f"contains(lower(trim(p_name)), '{w}')" for w in words) + f" THEN '{name}' END" for words, name in C.RULES) + "], lambda x: x IS NOT NULL), ',') AS candidates FROM part",
    "query_expansion": "SELECT r_name AS subject, unnest(['data', 'data ' || r_name, 'data for ' || r_name, r_name]) AS query FROM region",
    "curated_explode": f"""WITH {EV}, k AS (SELECT indication, metric || CASE WHEN year_or_range IS NULL THEN '' ELSE '_' || year_or_range END AS key, max(value) AS value FROM ev WHERE regexp_matches(coalesce(year_or_range, '1999'), '^[0-9]{{4}}$') GROUP BY 1, 2)
        SELECT indication, regexp_replace(key, '_[0-9]{{4}}$', '') AS metric, nullif(regexp_extract(key, '_([0-9]{{4}})$', 1), '') AS year, value, 'gold' AS tier, 'high' AS confidence FROM k""",
    "trend_sheet": with_(EN, ", k AS (SELECT metric, year_or_range::BIGINT AS year, max(value_num) AS v FROM en WHERE regexp_matches(year_or_range, '^[0-9]{4}$') GROUP BY 1, 2) SELECT year, max(v) FILTER (metric = 'demand_standard') AS demand_standard, max(v) FILTER (metric = 'demand_large') AS demand_large FROM k GROUP BY 1"),
    "curated_upsert": """WITH o AS (SELECT c_custkey AS key, round(c_acctbal, 2) AS value FROM customer), n AS (SELECT o_custkey AS key, max(o_totalprice) AS value FROM orders GROUP BY 1)
        SELECT coalesce(n.key, o.key) AS key, coalesce(n.value, o.value) AS value, CASE WHEN o.key IS NULL THEN 'added' WHEN n.key IS NOT NULL AND n.value IS DISTINCT FROM o.value THEN 'updated' ELSE 'kept' END AS change FROM o FULL JOIN n ON o.key = n.key""",
    "write_back": """WITH c AS (SELECT 'B' || p_partkey AS cell, CASE WHEN p_partkey % 2 = 0 THEN 'x' || p_size END AS excel_id, 'm' || p_size AS metric_id, CASE WHEN p_partkey % 5 = 0 THEN 0.5 ELSE p_retailprice END AS old FROM part),
        v AS (SELECT CASE WHEN s % 2 = 0 THEN 'x' ELSE 'm' END || s AS id, 10.0::DOUBLE * s AS value, 'S' || s AS source FROM generate_series(1, 30) AS g(s)),
        j AS (SELECT cell, old, coalesce(a.value, b.value) AS raw, CASE WHEN a.value IS NOT NULL THEN a.source ELSE b.source END AS source FROM c LEFT JOIN v a ON excel_id = a.id LEFT JOIN v b ON metric_id = b.id),
        k AS (SELECT cell, old, source, CASE WHEN old BETWEEN 0 AND 1 AND raw > 1 THEN raw / 100 ELSE raw END AS n FROM j), w AS (SELECT cell, old, source, CASE WHEN old BETWEEN 0 AND 1 AND n > 1.5 THEN NULL ELSE round(n, 4) END AS new FROM k)
        SELECT cell, old::DOUBLE AS old, new, source FROM w WHERE new IS NOT NULL AND (old IS NULL OR abs(new - old) / greatest(abs(old), 1e-6) > 0.001)""",
    "preferred_value": "SELECT 'demand_promo' AS metric_id, max(value_num) AS value FROM (WITH " + EN + " SELECT * FROM en) WHERE metric = 'demand_promo'",
    "sheet_refresh": with_(EV, f"SELECT metric AS \"Metric\", coalesce(CASE WHEN NOT {blank('value')} THEN trim(value) END, '') AS \"Value\", coalesce(CASE WHEN NOT {blank('source_url')} THEN trim(source_url) END, trim(source_citation)) AS \"Source\", '' AS \"Owner\" FROM ev WHERE indication = 'ASIA'"),
    "registry_rows": "SELECT c_mktsegment || '-' || c_custkey AS key, CASE WHEN c_custkey % 2 = 0 THEN c_custkey::DOUBLE ELSE 7 END AS value FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 <> 0",
    "renamed_table": "SELECT r_regionkey, r_name, CASE r_name WHEN 'ASIA' THEN 'Asia and Pacific' ELSE r_name END AS full_name FROM region",
    "manifest": "SELECT 'region' AS table_name, count(*) AS n_rows, 2::BIGINT AS n_columns, 'r_regionkey, r_name' AS columns FROM region UNION ALL SELECT 'nation', count(*), 3, 'n_nationkey, n_name, n_regionkey' FROM nation UNION ALL SELECT 'supplier', count(*), 4, 's_suppkey, s_name, s_nationkey, s_acctbal' FROM supplier",
    "data_dictionary": "SELECT * FROM (VALUES ('nation', 0::BIGINT, 'n_nationkey', 'int'), ('nation', 1, 'n_name', 'string'), ('nation', 2, 'n_regionkey', 'int'), ('region', 0, 'r_regionkey', 'int'), ('region', 1, 'r_name', 'string')) AS t(table_name, position, column_name, data_type)",
    "run_checksums": "WITH h AS (SELECT n_regionkey, sha256(n_nationkey || chr(31) || n_name || chr(31) || n_regionkey) AS s FROM nation), a AS (SELECT n_regionkey, count(*) AS n_rows, sum(('0x' || left(s, 12))::UBIGINT::HUGEINT) AS a, sum(('0x' || s[13:24])::UBIGINT::HUGEINT) AS b FROM h GROUP BY 1) SELECT n_regionkey, n_rows, left(sha256(n_rows || ':' || a || ':' || b), 16) AS checksum FROM a",
    "source_log": with_(EV, f"SELECT {_scan} AS tier, count(*) AS n_rows, CASE WHEN {_scan} IN ('gold', 'silver', 'bronze') THEN 'kept' ELSE 'dropped' END AS status, NULL::VARCHAR AS error FROM ev GROUP BY 1 UNION ALL SELECT 'silver', 0, NULL, 'service not reachable'"),
    "stale_partitions": "SELECT DISTINCT n_name AS geography, r_name AS indication FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 4 = 0",
    "crawl_frontier": r"""WITH RECURSIVE p AS (SELECT page_id, url, regexp_extract(url, '^[a-z]+://(?:[^/?#]*[.])?([^./?#]+[.][^./?#]+)', 1) AS site FROM pages),
        l AS (SELECT a.url AS src, b.url AS dst FROM p a JOIN p b ON b.page_id IN (2 * a.page_id + 1, 2 * a.page_id + 2) AND a.site = b.site),
        f(url, depth) AS (SELECT arg_min(url, page_id), 0 FROM p GROUP BY site UNION SELECT dst, depth + 1 FROM f JOIN l ON f.url = l.src WHERE depth < 4) SELECT url, min(depth)::BIGINT AS depth FROM f GROUP BY 1""",
    "white_space_report": with_(COVER, "SELECT coverage_status AS section, row_number() OVER (PARTITION BY coverage_status ORDER BY metric_id) AS ord, '- ' || label || ' (' || metric_id || ')' || CASE coverage_status WHEN 'Has value' THEN ': ' || n_sources || ' source(s), ' || n_with_value || ' with value' WHEN 'Stub only' THEN ': ' || n_sources || ' source(s), look up by hand' ELSE '' END AS line FROM cover"),
    "report_lines": with_(CARD, """, mix AS (SELECT computed_confidence, count(*) AS n FROM en GROUP BY 1), tops AS (SELECT source_citation, count(*) AS n FROM ev GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5)
        SELECT 'key numbers' AS section, row_number() OVER (ORDER BY metric_id) AS ord, label || ': ' || format('{:,.2f}', best_value) || ' (' || validation_status || ')' AS line FROM card WHERE best_value IS NOT NULL
        UNION ALL SELECT 'confidence', row_number() OVER (ORDER BY n DESC, computed_confidence), upper(computed_confidence[1]) || computed_confidence[2:] || ': ' || n || ' row(s)' FROM mix
        UNION ALL SELECT 'top sources', row_number() OVER (ORDER BY n DESC, source_citation), source_citation || ': ' || n || ' row(s)' FROM tops
        UNION ALL SELECT 'caveats', row_number() OVER (ORDER BY metric_id), label || ': ' || agreement_flag FROM card WHERE validation_status <> 'Ready'"""),
}
_dictionary = values([(m, s, i) for i, (m, s) in enumerate((m, s) for m, ss in C.SYNONYMS.items() for s in ss)], "d(m, syn, pos)")
ORACLES |= {
    "curated_for_place": "SELECT r_name AS indication, n_name AS metric, CASE WHEN n_nationkey % 3 <> 0 THEN n_name END AS geography, n_nationkey::VARCHAR AS value FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 3 = 0 OR lower(trim(n_name)) IN ('nation_1', 'n1', 'first nation')",
    "label_match": f"""WITH l AS (SELECT CASE WHEN p_partkey % 2 = 0 THEN p_name || ' ' || p_partkey ELSE 'item ' || p_partkey END AS label, embedding FROM part JOIN embeddings ON p_partkey = vec_id),
        d AS (SELECT * FROM {_dictionary}), x AS (SELECT label, m, pos, CASE WHEN lower(trim(label)) = syn THEN 0.95::DOUBLE WHEN contains(lower(trim(label)), syn) THEN 0.75 + 0.15::DOUBLE * length(syn) / length(trim(label)) WHEN contains(syn, lower(trim(label))) THEN 0.65::DOUBLE ELSE 0::DOUBLE END AS sc FROM l, d),
        b AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY sc DESC, pos) AS k FROM x), u AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), a AS (SELECT label, i, avg(x) AS x FROM u GROUP BY ALL), p AS (SELECT label AS g, list(x ORDER BY i) AS v FROM a GROUP BY 1),
        c AS (SELECT label, g, round(list_cosine_similarity(embedding::DOUBLE[], v), 6) AS cs FROM l, p), n AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY cs DESC, g) AS j FROM c)
        SELECT b.label, CASE WHEN sc >= 0.5 THEN m WHEN cs > 0 THEN g::VARCHAR ELSE trim(regexp_replace(lower(b.label), '[^a-z0-9]+', '_', 'g'), '_') END AS metric_id, CASE WHEN sc >= 0.5 THEN round(sc, 4) WHEN cs > 0 THEN round(cs, 4) ELSE 0 END AS score,
        CASE WHEN sc >= 0.5 THEN 'synonym' WHEN cs >= 0.6 THEN 'vector' WHEN cs > 0 THEN 'weak vector' ELSE 'slug' END AS how FROM b JOIN n ON b.label = n.label WHERE k = 1 AND j = 1""",
}
_any = lambda c, words: "(" + " OR ".join(f"contains({c}, '{w}')" for w in words) + ")"
_class = lambda classes: "CASE " + " ".join(f"WHEN {_any('near', ws)} THEN '{name}'" for name, ws in classes) + " ELSE 'value' END"


def _found(kind: str, pattern: str, near: int, wide: int) -> str:
    """CTEs with every match of a pattern: its place follows from the lengths of the gaps and matches in front."""
    around = lambda n: f"lower(substr(t, greatest(s - {n}, 0) + 1, s + length(hit) + {n} - greatest(s - {n}, 0)))"
    return f"""{kind}_a AS (SELECT id, t, regexp_extract_all(t, '{pattern}') AS hs, regexp_split_to_array(t, '{pattern}') AS gs FROM chosen),
      {kind}_b AS (SELECT id, t, unnest(hs) AS hit, generate_subscripts(hs, 1) AS i, list_transform(gs, lambda g: length(g)) AS gl, list_transform(hs, lambda h: length(h)) AS hl FROM {kind}_a),
      {kind}_c AS (SELECT id, t, hit, i, (list_sum(gl[1:i]) + coalesce(list_sum(hl[1:i - 1]), 0))::BIGINT AS s FROM {kind}_b),
      {kind}_d AS (SELECT id, i - 1 AS pos, hit, replace(replace(hit, ',', ''), ' ', '') AS plain, {around(near)} AS near, {around(wide)} AS wide FROM {kind}_c)"""


def points(rows: str, classes=C.CLASSES, w: Windows = Windows()) -> str:
    """CTEs up to points (id, pos, kind, label, found) of rows (id, t)."""
    words = [x for _, ws in classes for x in ws]
    names = f"AND {_any('lower(t)', C.ALIASES)}" if w.alias else ""
    version = "AND NOT regexp_full_match(plain, '[0-9]+[.][0-9]{4}')" if w.versions else ""
    return f"""chosen AS (SELECT id, t FROM ({rows}) WHERE {_any('lower(t)', words)} AND regexp_matches(t, '[0-9]') {names}),
  {_found('percent', '[0-9]+(?:[.][0-9]+)?[ \\t\\n\\f\\r]*%', w.percent, 1)}, {_found('number', '[0-9]{1,3}(?:,[0-9]{3})+(?:[.][0-9]+)?|[0-9]+(?:[.][0-9]+)?', w.number, w.alias or 1)},
  points AS (SELECT id, pos, 'percent' AS kind, {f"'{w.percent_label}'" if w.percent_label else _class(classes)} AS label, regexp_extract(hit, '^[0-9.]+') || '%' AS found FROM percent_d WHERE TRY_CAST(regexp_extract(hit, '^[0-9.]+') AS DOUBLE) BETWEEN 0 AND 100
    UNION ALL SELECT id, pos, 'number', {_class(classes)}, hit FROM number_d WHERE TRY_CAST(plain AS DOUBLE) >= 0.01 AND NOT (TRY_CAST(plain AS DOUBLE) BETWEEN {w.years[0]} AND {w.years[1]} AND NOT contains(plain, '.'))
      {version} AND {_any('near', words)} {f"AND {_any('wide', C.ALIASES)}" if w.alias else ""})"""


POINTS = points("SELECT doc_id AS id, text AS t FROM documents")
_labels = ("incidence", "prevalence", "mortality", "survival", "rate", "value")
_rank = "CASE label " + " ".join(f"WHEN '{x}' THEN {i}" for i, x in enumerate(_labels)) + " ELSE 6 END"
ORACLES |= {
    "text_datapoints": f"WITH {POINTS} SELECT id, pos::BIGINT AS pos, kind, label, found FROM points",
    "dedupe_datapoints": f"""WITH {POINTS}, r AS (SELECT *, regexp_replace(found, '[, %]', '', 'g') AS plain, {_rank} AS r, CASE kind WHEN 'percent' THEN 0 ELSE 1 END AS k FROM points),
        f AS (SELECT *, row_number() OVER (PARTITION BY id, plain ORDER BY r, k, pos, found, label) AS nth FROM r WHERE NOT (label = 'value' AND TRY_CAST(plain AS DOUBLE) < 10)),
        o AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY r, k, pos, found, label) AS place, count(*) OVER (PARTITION BY id) AS n FROM f WHERE nth = 1)
        SELECT id, CASE WHEN max(n) = 1 THEN max(found) ELSE string_agg(found || ' (' || label || ')', '; ' ORDER BY place) FILTER (place <= 15) END AS summary FROM o GROUP BY id""",
    "safe_names": "SELECT DISTINCT p_name || ', ' || p_type AS name, replace(replace(p_name || ', ' || p_type, ' ', '_'), ',', '') AS safe FROM part",
    "label_keys": "SELECT r_name, CASE WHEN r_name IN ('ASIA', 'EUROPE') THEN r_name WHEN r_name = 'AMERICA' THEN 'AM' WHEN r_name = 'AFRICA' THEN 'AF' END AS key FROM region",
    "context_aliases": "SELECT DISTINCT p_name, CASE " + " ".join(f"WHEN contains(lower(trim(p_name)), '{k}') THEN '{','.join(names)}'" for k, names in C.CONTEXTS) + " ELSE lower(trim(p_name)) END AS aliases FROM part",
    "page_extractors": "SELECT page_id, url, CASE " + " ".join(f"WHEN contains(lower(url), '{p}') THEN '{name}'" for p, name in C.PAGE_KINDS) + " ELSE 'page' END AS extractor FROM pages",
    "synonym_explain": f"WITH m AS ({ORACLES['synonym_match']}), d AS (SELECT * FROM {values([(m, s, i) for i, (m, s) in enumerate((m, s) for m, ss in C.SYNONYMS.items() for s in ss)], 'd(mid, syn, pos)')}), v AS (SELECT label, list(syn ORDER BY pos) AS vs FROM m JOIN d ON mid = metric_id AND (contains(lower(trim(label)), syn) OR contains(syn, lower(trim(label)))) GROUP BY 1) SELECT m.label, m.label || ' -> ' || metric_id || ' (score ' || format('{{:.2f}}', score) || ', ' || how || CASE WHEN vs IS NOT NULL THEN ', via ' || array_to_string(vs[1:2], ', ') ELSE '' END || ')' AS explanation FROM m LEFT JOIN v ON m.label = v.label",
    "catalogue_enabled": "SELECT * FROM (VALUES ('g1', 'link'), ('g2', 'api'), ('g5', 'link'), ('g7', 'link')) AS t(id, kind)",
    "sources_by_tier": with_(EV, f", u AS (SELECT {_scan} AS tier, 'upload' AS source_name, 0 AS nth FROM ev UNION ALL SELECT {_scan}, 'notes', 1 FROM ev WHERE split_logic IS NOT NULL), o AS (SELECT *, CASE tier WHEN 'gold' THEN 0 WHEN 'silver' THEN 1 WHEN 'bronze' THEN 2 END AS r FROM u) SELECT (2 * r + nth)::BIGINT AS _at, tier, source_name, count(*) AS n_rows FROM o WHERE r IS NOT NULL GROUP BY ALL"),
    "landed_answers": "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN '0' ELSE user_id::VARCHAR END AS value, CASE WHEN event_id % 5 = 0 THEN '0 item(s)' ELSE 'ids (sample): ' || array_to_string(list_transform(range(1, least(event_id % 12 + 1, 8) + 1), lambda i: i::VARCHAR), ', ') || CASE WHEN event_id % 12 + 1 > 8 THEN ' (+' || (event_id % 12 - 7) || ' more)' ELSE '' END END AS notes FROM events",
    "options_flat": "SELECT * FROM (VALUES ('growth', 'g_base', 'Base growth', 0.02::DOUBLE), ('growth', 'g_low', 'Low growth', 0.01), ('split', 's_a', 'Split A', NULL)) AS t(scenario_type, option_id, label, value)",
    "change_log": """WITH c AS (SELECT 'B' || p_partkey AS cell, CASE WHEN p_partkey % 2 = 0 THEN 'x' || p_size END AS i0, 'm' || p_size AS i1, CASE p_type WHEN 'MEDIUM' THEN 'm3' WHEN 'SMALL' THEN 'm4' END AS i2, CASE WHEN p_partkey % 5 = 0 THEN 0.5 ELSE p_retailprice END::DOUBLE AS old FROM part),
        v AS (SELECT CASE WHEN s % 2 = 0 THEN 'x' ELSE 'm' END || s AS id, 10.0::DOUBLE * s AS value, 'S' || s AS source, CASE WHEN s % 3 <> 0 THEN 'high' ELSE '' END AS confidence FROM generate_series(1, 30) AS g(s) UNION ALL SELECT 'm4', 44.0, 'S4m', 'low'),
        k AS (SELECT cell, old, 0 AS nth, i0 AS id FROM c WHERE i0 IS NOT NULL UNION ALL SELECT cell, old, CASE WHEN i0 IS NULL THEN 0 ELSE 1 END, i1 FROM c UNION ALL SELECT cell, old, CASE WHEN i0 IS NULL THEN 1 ELSE 2 END, i2 FROM c WHERE i2 IS NOT NULL),
        j AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY nth) AS r FROM k JOIN v USING (id)), n AS (SELECT *, CASE WHEN old BETWEEN 0 AND 1 AND value > 1 THEN value / 100 ELSE value END AS x FROM j WHERE r = 1), w AS (SELECT *, CASE WHEN old BETWEEN 0 AND 1 AND x > 1.5 THEN NULL ELSE round(x, 4) END AS new FROM n)
        SELECT id AS metric_id, cell, old, new, source, confidence, 'dry_run' AS status FROM w WHERE new IS NOT NULL AND (old IS NULL OR abs(new - old) / greatest(abs(old), 1e-6) > 0.001)""",
}
_PLACES = "'n0', 'nation_0'"
SUPPLIERS = r"""su AS (SELECT 's' || s_suppkey AS id, s_name AS name, CASE WHEN s_suppkey % 4 = 0 THEN 'gold' ELSE 'bronze' END AS tier, CASE WHEN s_suppkey % 5 = 4 THEN 'api' ELSE 'link' END AS kind,
    CASE s_suppkey % 3 WHEN 0 THEN 'https://ledger.example.org/?q=red+widget+%26+co&c=Nation_0' WHEN 1 THEN 'https://notes.example.org/Nation_0/red widget & co' ELSE 'https://archive.example.org/' || s_suppkey END AS url,
    CASE s_suppkey % 3 WHEN 0 THEN 'demand_standard' WHEN 1 THEN 'demand_none' ELSE 'demand_medium' END AS metric, coalesce(nullif(s_suppkey % 4, 0), 99)::BIGINT AS priority, s_suppkey % 2 = 1 OR n_name = 'NATION_0' OR lower(n_name) IN ('n0', 'nation_0') AS fits,
    CASE WHEN s_suppkey % 10 = 4 THEN 'counts' WHEN s_suppkey % 20 = 9 THEN 'trials' END AS connector, CASE s_suppkey % 7 WHEN 0 THEN 'use_counts' WHEN 1 THEN 'use_links' WHEN 2 THEN 'other' END AS gate FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""


def _dropped(h: str, names: str) -> str:
    """The page's text without comments, elements of these names, and what its end cuts off; elements leave a border."""
    out = f"regexp_replace(regexp_replace(regexp_replace({h}, '<!--.*?-->', '', 'gs'), '<!--.*$', '', 's'), '<[^>]*$', '')"
    for name in names.split():
        out = f"regexp_replace(regexp_replace({out}, '<{name}\\b[^>]*>.*?</{name}>', '<x>', 'gs'), '<{name}\\b.*$', '<x>', 's')"
    return out


def _runs(names: str) -> str:
    """CTE runs (page_id, url, i, tag, t): the text after each tag; inline tags are gone, and references decoded."""
    text = "trim(regexp_replace(regexp_replace(replace(replace(replace(replace(x, '&quot;', chr(34)), '&copy;', chr(169)), '&middot;', chr(183)), '&amp;', '&'), '&amp$', '&'), '\\s+', ' ', 'g'))"
    return f"""ht AS (SELECT page_id, url, regexp_replace(regexp_replace({_dropped("coalesce(html, '')", names)}, '</?b>', '', 'g'), '<br>', ' ', 'g') AS h FROM pages),
      tg AS (SELECT page_id, url, unnest(regexp_extract_all(h, '<(/?[a-z0-9]+|!DOCTYPE)[^>]*>([^<]*)', 1)) AS tag, unnest(regexp_extract_all(h, '<(/?[a-z0-9]+|!DOCTYPE)[^>]*>([^<]*)', 2)) AS x, generate_subscripts(regexp_extract_all(h, '<(/?[a-z0-9]+|!DOCTYPE)[^>]*>([^<]*)', 1), 1) AS i FROM ht),
      runs AS (SELECT page_id, url, i, tag, {text} AS t FROM tg)"""


_KIND = "CASE " + " ".join(f"WHEN contains(lower(url), '{p}') THEN '{name}'" for p, name in C.PAGE_KINDS) + " ELSE 'page' END"
_rules = {"page": ANY, **C.PAGE_RULES}
_in = lambda tags: "(" + ", ".join(f"'{t}'" for t in tags) + ")"
ELEMENTS = f"""{_runs("script style title nav footer header aside noscript")}, nth AS (SELECT *, {_KIND} AS extractor, {", ".join(f"count(*) FILTER (tag IN {_in(r.tags)}) OVER (PARTITION BY page_id ORDER BY i) AS n_{k}" for k, r in _rules.items())} FROM runs),
  el AS (SELECT page_id, url, extractor, row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS pos, tag AS element, t AS text FROM nth WHERE {" OR ".join(f"extractor = '{k}' AND tag IN {_in(r.tags)} AND length(t) > {r.longer_than}" + (f" AND n_{k} <= {r.limit}" if r.limit else "") for k, r in _rules.items())})"""
BLOCKS = f"""{_runs("script style nav footer header aside noscript")}, bl AS (SELECT page_id, url, row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS block, t FROM runs WHERE length(t) > 30)"""
_at = lambda block: f"SELECT {{'p': page_id, 'b': {block}}} AS id, {'text' if block == 'pos' else 't'} AS t FROM {'el' if block == 'pos' else 'bl'}"
_points_of = "SELECT id.p AS page_id, id.b::BIGINT AS block, pos::BIGINT AS pos, kind, label, found FROM points"
_summed = lambda id_: f"""sr AS (SELECT *, {id_} AS sid, regexp_replace(found, '[, %]', '', 'g') AS plain, {_rank} AS r, CASE kind WHEN 'percent' THEN 0 ELSE 1 END AS k FROM points),
        sf AS (SELECT *, row_number() OVER (PARTITION BY sid, plain ORDER BY r, k, pos, found, label) AS nth FROM sr WHERE NOT (label = 'value' AND TRY_CAST(plain AS DOUBLE) < 10)),
        so AS (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY r, k, pos, found, label) AS place, count(*) OVER (PARTITION BY sid) AS n FROM sf WHERE nth = 1),
        sums AS (SELECT sid, CASE WHEN max(n) = 1 THEN max(found) ELSE string_agg(found || ' (' || label || ')', '; ' ORDER BY place) FILTER (place <= 15) END AS summary FROM so GROUP BY sid)"""  # noqa: E731
_match = lambda ways, none: "(" + " OR ".join("(" + " AND ".join(f"contains(s, '{w}')" for w in way) + ")" for way in ways) + ")" + "".join(f" AND NOT contains(s, '{w}')" for w in none)
ORACLES |= {
    "catalogue_links": f"WITH {SUPPLIERS} SELECT id, name, tier, metric, url, priority FROM su WHERE kind = 'link' AND fits",
    "links_to_fetch": f"WITH {EV}, {SUPPLIERS} SELECT id, metric, priority FROM su WHERE kind = 'link' AND fits AND NOT (metric = 'demand_standard' AND EXISTS (SELECT 1 FROM ev WHERE metric = 'demand_standard' AND NOT {stub('value')}))",
    "catalogue_enabled": f"WITH {SUPPLIERS} SELECT id, kind FROM su WHERE coalesce(gate, '') <> 'use_counts' AND (kind <> 'api' OR coalesce(connector = 'counts', false))",
    "options_flat": "SELECT r_name AS scenario_type, 'o' || n_nationkey AS option_id, n_name AS label, CASE WHEN n_nationkey % 4 <> 0 THEN n_nationkey / 100 END AS value FROM nation JOIN region ON n_regionkey = r_regionkey",
    "label_match": ORACLES["label_match"].replace("FROM part JOIN embeddings ON p_partkey = vec_id", "FROM part LEFT JOIN embeddings ON p_partkey = vec_id").replace("FROM l, p)", "FROM l, p WHERE embedding IS NOT NULL)").replace("FROM b JOIN n ON b.label = n.label WHERE k = 1 AND j = 1", "FROM b LEFT JOIN n ON b.label = n.label AND j = 1 WHERE k = 1"),
    "page_datapoints": f"WITH {BLOCKS}, {points(_at('block'))} {_points_of}",
    "page_elements": f"WITH {ELEMENTS} SELECT page_id, extractor, pos, element, text FROM el",
    "element_datapoints": f"WITH {ELEMENTS}, {points(_at('pos'))} {_points_of}",
    "near_datapoints": f"WITH {points('SELECT doc_id AS id, text AS t FROM documents', C.NEAR_CLASSES, C.NEAR)} SELECT id, pos::BIGINT AS pos, kind, label, found FROM points",
    "crawl_frontier": f"""WITH {BLOCKS}, {points(_at('block'))}, enough AS (SELECT url FROM (SELECT id.p AS page_id FROM points GROUP BY 1 HAVING count(*) >= 2) JOIN pages USING (page_id)),
        an AS (SELECT url, unnest(list_slice(regexp_extract_all({_dropped("coalesce(html, '')", "")}, '<a href="([^"]*)"', 1), 1, 150)) AS href FROM pages),
        li AS (SELECT DISTINCT regexp_extract(url, '^[a-z]+://[^/?#]*') || replace(href, '&amp;', '&') AS dst FROM an WHERE url NOT IN (SELECT url FROM enough WHERE url IS NOT NULL) AND starts_with(href, '/'))
        SELECT url, 0::BIGINT AS depth FROM (SELECT DISTINCT url FROM pages) UNION ALL SELECT dst, 1 FROM li WHERE dst NOT IN (SELECT url FROM pages WHERE url IS NOT NULL)""",
    "registry_tables": """WITH y AS (SELECT o_custkey AS id, year(o_orderdate)::VARCHAR AS key, count(*) AS n, max(trunc(o_totalprice)::BIGINT) AS m FROM orders GROUP BY 1, 2)
        SELECT id, 'count' AS metric, key, CASE WHEN n % 2 = 0 THEN 10 * n ELSE n END::VARCHAR AS value, CASE WHEN n % 2 = 0 THEN 3 ELSE 1 END::BIGINT AS "column" FROM y UNION ALL SELECT id, 'share', key, m::VARCHAR, 4 FROM y
        UNION ALL SELECT o_custkey, 'orders', CASE o_orderstatus WHEN 'O' THEN 'open' ELSE 'filled' END, count(*)::VARCHAR, 1 FROM orders WHERE o_orderstatus IN ('O', 'F') GROUP BY o_custkey, o_orderstatus""",
    "search_phrases": "SELECT p_name, CASE " + " ".join(f"WHEN {_match(ways, none)} THEN '{'|'.join(out)}'" for ways, none, out in C.PHRASES) + " ELSE p_name || '|' || p_name || ' part' END AS phrases FROM (SELECT DISTINCT p_name, lower(trim(p_name)) AS s FROM part)",
    "phrasing_notes": """WITH c AS (SELECT source, lang, CASE WHEN lang <> 'es' THEN count(*) END AS n FROM documents GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY source, n IS NULL ORDER BY lang) AS r FROM c)
        SELECT source, coalesce(max(n), 0)::BIGINT AS best_count, first(lang ORDER BY n DESC NULLS LAST, lang) FILTER (n > 0) AS best_label, count(*) AS n_tried,
          coalesce(max(n), 0) || ' found (best of ' || count(*) || ' phrasings). ' || coalesce(string_agg(left(lang, 48) || ': ' || n, '; ' ORDER BY lang) FILTER (n IS NOT NULL AND r <= 4), '') AS notes FROM k GROUP BY 1""",
    "cascade_cells": """WITH c AS (SELECT p_partkey AS row, 'C' || p_partkey AS cell, CASE p_partkey % 3 WHEN 0 THEN p_type WHEN 1 THEN lower(p_type) ELSE p_name END AS label, p_retailprice AS old FROM part),
        v AS (SELECT p_type, 'm_' || lower(p_type) AS metric_id, max(p_retailprice) AS new, 'of ' || count(*) AS source FROM part GROUP BY 1),
        f AS (SELECT label, arg_min(cell, row) AS cell, arg_min(old, row) AS old FROM c GROUP BY 1)
        SELECT 'option' AS step, cell, metric_id, old, new, source FROM v JOIN f ON p_type = label WHERE p_type IN ('SMALL', 'PROMO') UNION ALL SELECT 'core', cell, metric_id, old, new, source FROM v JOIN f ON p_type = label WHERE p_type = 'MEDIUM'
        UNION ALL SELECT 'core', cell, metric_id, old, new, source FROM v, c WHERE p_type = 'LARGE' AND row = 7 UNION ALL SELECT 'label', cell, metric_id, old, new, source FROM c JOIN v ON lower(label) = lower(p_type)""",
    "rubric_lines": with_(EN, """, n AS (SELECT computed_confidence AS l, count(*) AS n FROM en GROUP BY 1)
        SELECT * FROM (VALUES ('factors', 1::BIGINT, 'Source tier: up to 35 points (gold 35, silver 22, others 15)'), ('factors', 2, 'Extraction: 30 points for a value, none for a link'), ('factors', 3, 'Completeness: 6 points each for definition, year, geography and population'),
          ('factors', 4, 'Recency: 5 points within a year, 3 within five'), ('factors', 5, 'URL: 5 points')) AS t(section, ord, line)
        UNION ALL SELECT 'labels', o, t || coalesce(n, 0) || ' row(s)' FROM (VALUES ('high', 1, '70 to 100: high, '), ('medium', 2, '40 to 69: medium, '), ('low', 3, '0 to 39: low, ')) AS x(name, o, t) LEFT JOIN n ON l = name"""),
    "connector_rows": """WITH c AS (SELECT c_custkey % 4 AS k, c_name, round(c_acctbal * 100)::BIGINT::VARCHAR AS p FROM customer)
        SELECT 'gold' AS tier, 'ledger' AS source, c_name AS subject, 'balance' AS metric, p AS value, 'of ' || c_name AS notes FROM c WHERE k = 0
        UNION ALL SELECT 'silver', 'signs', c_name, 'digit_' || i, substr(p, i + 1, 1), NULL FROM c, range(2) AS t(i) WHERE k = 1 AND NOT starts_with(p, '-') AND i < length(p)""",
    "connector_log": """WITH c AS (SELECT c_custkey % 4 AS k, c_name, round(c_acctbal * 100)::BIGINT::VARCHAR AS p FROM customer)
        SELECT 'gold' AS tier, 'ledger' AS source, count(DISTINCT c_name) AS n_requests, count(*) AS n_rows, 0::BIGINT AS n_failed, 'ok' AS status, NULL::VARCHAR AS error FROM c WHERE k = 0
        UNION ALL SELECT 'silver', 'signs', count(DISTINCT c_name), sum(least(length(p), 2)) FILTER (NOT starts_with(p, '-'))::BIGINT, count(*) FILTER (starts_with(p, '-')), 'partly failed', 'ValueError: debt' FROM c WHERE k = 1
        UNION ALL SELECT 'silver', 'away', count(DISTINCT c_name), 0, count(*), 'error', 'OSError: not reachable' FROM c WHERE k = 2""",
    "exploration": f"""WITH {ELEMENTS}, {points(_at('pos'))}, {_summed('id.p')},
        pa AS (SELECT 'demand_' || lower(p_type) AS metric, count(*)::VARCHAR AS value FROM part GROUP BY 1),
        s AS (SELECT page_id AS id, url, 'Page ' || page_id AS name, CASE WHEN page_id % 3 = 0 THEN 'gold' ELSE 'bronze' END AS tier, page_id % 10 = 9 AS api, CASE page_id % 4 WHEN 0 THEN 'incidence' WHEN 1 THEN 'demand_standard' ELSE page_id || '_links' END AS metric,
          coalesce(nullif(page_id % 5, 0), 99) AS priority FROM pages WHERE page_id % 7 <> 0),
        l AS (SELECT *, row_number() OVER (ORDER BY priority, id) AS nth, metric IN (SELECT metric FROM pa) AS known FROM s WHERE NOT api AND id % 6 <> 1),
        by_url AS (SELECT url, min(summary) AS summary FROM sums JOIN pages ON sid = page_id GROUP BY 1)
        SELECT 'curated' AS part, NULL AS id, metric, value, 'Parts' AS source_citation, 'gold' AS tier, NULL AS url, NULL AS notes FROM pa
        UNION ALL SELECT 'link', l.id::VARCHAR, metric, CASE WHEN nth <= 100 AND NOT known THEN coalesce(summary, 'See link for values') ELSE 'See link for values' END, name, tier, l.url,
          CASE WHEN known THEN 'curated value available' WHEN nth > 100 THEN 'not looked into' WHEN summary IS NOT NULL THEN 'value extracted' ELSE 'no datapoints found' END FROM l LEFT JOIN by_url ON l.url = by_url.url
        UNION ALL SELECT 'answer', id::VARCHAR, 'region_' || r_regionkey, length(r_name)::VARCHAR, name, tier, NULL, r_name FROM s, region WHERE api AND id % 20 = 9""",
    "csv_evidence": with_(EV, "SELECT NULL::VARCHAR AS indication, " + ", ".join(f"CASE WHEN NOT {blank(c)} THEN trim({c}) END AS {c}" for c in ("metric", "value", "source_citation", "source_tier", "population")) + " FROM ev"),
    "csv_order": with_(EV, "SELECT metric, count(*) AS n_rows, 0::BIGINT AS n_wrong FROM ev GROUP BY 1"),
    "run_partitions": with_(EV, "SELECT indication, count(*) AS n_rows, count(DISTINCT metric) AS n_metrics FROM ev WHERE indication <> 'ASIA' OR metric = 'demand_standard' GROUP BY 1"),
    "polite_fetch": "SELECT url, CASE WHEN NOT contains(url, '?') THEN upper(url) END AS body, CASE WHEN contains(url, '?') THEN 'queries are not fetched' END AS error FROM pages",
}
for _name, _sql in list(ORACLES.items()):
    ORACLES[_name] = " ".join(_sql.split("\n")).strip()
