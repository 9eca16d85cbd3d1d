"""Registered queries of the evidence operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import build, curated, enrich, evaluate, extract, insights, match, pages, quality, report, sinks
from ..session import shared_dir, ship, stored, tuned
from ..sources import evidence as E
from ..sources import explore as P
from . import config as C
from .oracles import ORACLES, YEARS

QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def raw(spark: SparkSession, sf: str) -> DataFrame:
    return E.from_star(tuned(spark), sf)


def enriched(spark: SparkSession, sf: str) -> DataFrame:
    return enrich.enrich(raw(spark, sf), C.AS_OF, C.URL_KEYS, C.CLUSTERS, C.CLUSTER_PATTERNS, C.CLUSTER_LABELS)


def required(spark: SparkSession) -> DataFrame:
    return E.metrics_dim(spark, C.METRICS)


def card(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.scorecard(enriched(spark, sf), required(spark))


def places(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(C.PLACES, "alias string, canonical string, code string")


@query
def evidence_scan_tiered(spark, sf):
    kept, _ = E.route_tiers(raw(spark, sf))
    return kept.select("_ord", "indication", "metric", "value", "source_citation", "tier", F.col("tier_order").cast("long").alias("tier_order"))


@query
def tier_log(spark, sf):
    return E.route_tiers(raw(spark, sf))[1]


@query
def run_rows(spark, sf):
    rows = E.keep_informative(E.for_run(raw(spark, sf), "upload", "Everywhere"))
    return rows.select("indication", "metric", "value", "source_citation", "geography", "population")


@query
def numeric_extract(spark, sf):
    return raw(spark, sf).select("_ord", "value", X.is_stub("value").alias("is_stub"), X.first_number("value").alias("value_num"))


@query
def year_parsers(spark, sf):
    y = "year_or_range"
    return raw(spark, sf).select("_ord", y, X.loose_year(y).cast("long").alias("loose"), X.strict_year(y).cast("long").alias("strict"), X.recent_year(y).cast("long").alias("recent"))


@query
def confidence_score(spark, sf):
    return enriched(spark, sf).select("_ord", "computed_confidence_score", "computed_confidence")


@query
def legacy_confidence(spark, sf):
    return raw(spark, sf).groupBy(F.col("confidence").alias("given")).agg(F.count("*").alias("n_rows")).select("given", X.legacy_confidence("given").alias("confidence"), "n_rows")


@query
def url_resolve(spark, sf):
    return enrich.add_urls(raw(spark, sf), C.URL_KEYS).select("_ord", "source_citation", "source_url")


@query
def url_coverage(spark, sf):
    return insights.url_coverage(enriched(spark, sf))


@query
def cluster_assign(spark, sf):
    return enrich.add_clusters(raw(spark, sf).groupBy("metric").agg(F.count("*").alias("n_rows")), C.CLUSTERS, C.CLUSTER_PATTERNS, C.CLUSTER_LABELS).select("metric", "cluster", "cluster_label", "n_rows")


@query
def cluster_summary(spark, sf):
    return insights.cluster_summary(enriched(spark, sf))


@query
def kpi_scorecard(spark, sf):
    return card(spark, sf)


@query
def coverage_matrix(spark, sf):
    return evaluate.coverage(enriched(spark, sf), required(spark))


@query
def white_space_counts(spark, sf):
    return evaluate.white_space_counts(evaluate.coverage(enriched(spark, sf), required(spark)))


@query
def conflicts(spark, sf):
    return evaluate.conflicts(raw(spark, sf))


@query
def reconciliation(spark, sf):
    return evaluate.reconciliation(enriched(spark, sf), required(spark))


@query
def insights_summary(spark, sf):
    facts = evaluate.facts(enriched(spark, sf), years=["metric", "source_tier", "year_or_range"])
    return insights.insights(facts.where(F.col("kind") == "years"), evaluate.scorecard_of(facts, required(spark)), "n_values")


@query
def tidy_table(spark, sf):
    return build.tidy(raw(spark, sf))


@query
def wide_pivot(spark, sf):
    return build.wide(build.tidy(raw(spark, sf)), YEARS)


@query
def one_column(spark, sf):
    return build.one_column(build.tidy(raw(spark, sf)))


@query
def forecast_auto(spark, sf):
    return build.trend(raw(spark, sf))


@query
def forecast_rates(spark, sf):
    return build.trend(raw(spark, sf), rates=spark.createDataFrame(list(C.GROWTH.items()), "metric string, rate double"))


@query
def forecast_scenarios(spark, sf):
    return build.scenarios(raw(spark, sf), C.SCENARIOS)


@query
def validation_findings(spark, sf):
    return quality.validate_evidence(raw(spark, sf))


@query
def output_validation(spark, sf):
    return quality.validate_output(enriched(spark, sf), ["metric", "value", "cluster"])


@query
def fill_rates(spark, sf):
    return quality.fill_rates(raw(spark, sf), ["value", "definition", "population", "source_url", "confidence"])


@query
def top_sources(spark, sf):
    return insights.top_sources(raw(spark, sf))


@query
def confidence_mix(spark, sf):
    return insights.distribution(enriched(spark, sf), "computed_confidence")


@query
def phrasing_best(spark, sf):
    counts = E.read(spark, sf, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))
    return insights.best_of(counts, "source", "n", "lang")


@query
def indicator_series(spark, sf):
    return E.indicator(E.read(spark, sf, "events"), "event_type", "value", "event_id", "ts")


@query
def run_summary(spark, sf):
    return enriched(spark, sf).agg(F.countDistinct("indication").alias("n_runs"), F.countDistinct(F.when(F.col("value_num").isNotNull(), F.col("indication"))).alias("n_succeeded"))


@query
def synonym_match(spark, sf):
    return match.match_synonyms(E.read(spark, sf, "part"), "p_name", C.SYNONYMS)


@query
def embedding_match(spark, sf):
    vectors = E.read(ship(spark), sf, "embeddings")
    return match.match_vectors(vectors, match.prototypes(vectors))


@query
def text_datapoints(spark, sf):
    return extract.datapoints(E.read(spark, sf, "documents"), "doc_id", "text", C.CLASSES, C.ALIASES)


@query
def dedupe_datapoints(spark, sf):
    return extract.summarise(text_datapoints(spark, sf))


@query
def page_datapoints(spark, sf):
    return extract.page_datapoints(E.read(ship(spark), sf, "pages"), C.CLASSES, C.ALIASES)


@query
def abstract_relevance(spark, sf):
    return E.read(spark, sf, "documents").select("doc_id", F.round(X.relevance("text", F.lit(C.RELEVANCE_BLOB), C.RELEVANCE_TERMS), 6).alias("relevance"))


@query
def alias_resolve(spark, sf):
    return E.resolve_places(E.read(spark, sf, "nation").select(F.col("n_name").alias("place")), places(spark), "place")


def suppliers(spark: SparkSession, sf: str) -> DataFrame:
    """A source catalogue from the suppliers: link and API sources with URL templates, places, priorities and gates."""
    k, place = F.col("s_suppkey"), F.lower("n_name")
    rows = E.read(spark, sf, "supplier").join(E.read(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    url = F.when(k % 3 == 0, "https://ledger.example.org/?q={subject_q}&c={place}").when(k % 3 == 1, "https://notes.example.org/{place_q}/{subject}").otherwise(F.concat(F.lit("https://archive.example.org/"), k.cast("string")))
    return rows.select(
        F.concat(F.lit("s"), k.cast("string")).alias("id"), F.col("s_name").alias("name"), F.when(k % 4 == 0, "gold").otherwise("bronze").alias("tier"), F.when(k % 5 == 4, "api").otherwise("link").alias("kind"), url.alias("url"),
        F.when(k % 3 == 0, "demand_standard").when(k % 3 == 1, "demand_none").otherwise("demand_medium").alias("metric"), F.nullif(k % 4, F.lit(0)).alias("priority"),
        F.when(k % 2 == 0, F.array(place)).otherwise(F.array().cast("array<string>")).alias("places"), F.when(k % 10 == 4, "counts").when(k % 20 == 9, "trials").alias("connector"), F.when(k % 7 == 0, "use_counts").when(k % 7 == 1, "use_links").when(k % 7 == 2, "other").alias("enabled_when"),
    )


@query
def catalogue_links(spark, sf):
    return E.catalogue_links(suppliers(spark, sf), places(spark), "red widget & co", "Nation_0")


@query
def links_to_fetch(spark, sf):
    known = raw(spark, sf).where((F.col("metric") == "demand_standard") & ~X.is_stub("value"))
    return E.still_to_fetch(catalogue_links(spark, sf), known).select("id", "metric", "priority")


@query
def label_candidates(spark, sf):
    return E.read(spark, sf, "part").select("p_name").distinct().select("p_name", F.array_join(X.candidates("p_name", C.RULES), ",").alias("candidates"))


@query
def query_expansion(spark, sf):
    regions = E.read(spark, sf, "region")
    return regions.select(F.col("r_name").alias("subject"), F.explode(E.expand_queries(["data", "data for"], [F.col("r_name")], alone=True)).alias("query"))


@query
def curated_explode(spark, sf):
    rows = raw(spark, sf).where(F.coalesce("year_or_range", F.lit("1999")).rlike(r"^[0-9]{4}$"))
    entry = F.struct(F.col("value"), F.lit(None).cast("string").alias("year"), F.lit(None).cast("string").alias("geography"), F.lit(None).cast("string").alias("tier"), F.lit(None).cast("string").alias("confidence"))
    one = rows.groupBy("indication", F.concat("metric", F.coalesce(F.concat(F.lit("_"), F.col("year_or_range")), F.lit(""))).alias("key")).agg(F.max("value").alias("value"))
    maps = one.groupBy("indication").agg(F.map_from_entries(F.collect_list(F.struct("key", entry))).alias("entries"))
    return E.explode_curated(maps).select("indication", "metric", "year", "value", "tier", "confidence")


@query
def trend_sheet(spark, sf):
    rows = enriched(spark, sf).where(F.col("year_or_range").rlike(r"^[0-9]{4}$"))
    return curated.trend_table(rows.withColumn("key", F.concat_ws("_", "metric", "year_or_range")), "key", "value_num", ["demand_standard", "demand_large"])


@query
def curated_upsert(spark, sf):
    old = E.read(spark, sf, "customer").select(F.col("c_custkey").alias("key"), F.round("c_acctbal", 2).alias("value"))
    new = E.read(spark, sf, "orders").groupBy(F.col("o_custkey").alias("key")).agg(F.max("o_totalprice").alias("value"))
    return curated.upsert(old, new, "key", "value")


@query
def write_back(spark, sf):
    k, size = F.col("p_partkey"), F.col("p_size").cast("string")
    cells = E.read(spark, sf, "part").select(
        F.concat(F.lit("B"), k.cast("string")).alias("cell"), F.when(k % 2 == 0, F.concat(F.lit("x"), size)).alias("excel_id"), F.concat(F.lit("m"), size).alias("metric_id"), F.when(k % 5 == 0, 0.5).otherwise(F.col("p_retailprice")).alias("old")
    )
    values = spark.createDataFrame([(("x" if s % 2 == 0 else "m") + str(s), 10.0 * s, f"S{s}") for s in range(1, 31)], "id string, value double, source string")
    return curated.write_back(cells, values)


@query
def preferred_value(spark, sf):
    best = enriched(spark, sf).groupBy(F.col("metric").alias("metric_id")).agg(F.max("value_num").alias("value"))
    return curated.preferred(best, ["demand_bulk", "demand_promo", "demand_large"])


@query
def sheet_refresh(spark, sf):
    return curated.refresh(raw(spark, sf), {"Metric": ["metric"], "Value": ["value"], "Source": ["source_url", "source_citation"], "Owner": ["owner"]}, F.trim("indication") == "ASIA")


@query
def registry_rows(spark, sf):
    k = F.col("c_custkey")
    cells = F.array(F.concat_ws("-", "c_mktsegment", k.cast("string")), F.when(k % 2 == 0, F.concat(k.cast("string"), F.lit(" %"))).otherwise("-"), F.when(k % 3 == 0, "n/a").otherwise("7"))
    rows = E.read(spark, sf, "customer").select(cells.alias("cells"))
    return curated.registry_rows(rows, [1, 2])


@query
def renamed_table(spark, sf):
    return curated.renamed(E.read(spark, sf, "region"), {"ASIA": "Asia and Pacific"}, "r_name")


@query
def manifest(spark, sf):
    return sinks.manifest({n: E.read(spark, sf, n) for n in ("region", "nation", "supplier")})


@query
def data_dictionary(spark, sf):
    return sinks.data_dictionary(spark, {n: E.read(spark, sf, n) for n in ("nation", "region")})


@query
def run_checksums(spark, sf):
    return sinks.checksums(E.read(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey"), "n_regionkey")


@query
def source_log(spark, sf):
    failed = spark.createDataFrame([("silver", 0, "service not reachable")], "tier string, n_rows long, error string")
    return sinks.source_log(E.route_tiers(raw(spark, sf))[1], failed)


@query
def stale_partitions(spark, sf):
    nation, region = E.read(spark, sf, "nation"), E.read(spark, sf, "region")
    have = nation.join(region, nation.n_regionkey == region.r_regionkey).select(F.col("r_name").alias("indication"), F.col("n_name").alias("geography"), "n_nationkey")
    return sinks.stale(have, have.where(F.col("n_nationkey") % 4 != 0), ["indication", "geography"])


@query
def crawl_frontier(spark, sf):
    held = E.read(ship(spark), sf, "pages")
    links = pages.page_links(held, most=150)
    given = page_datapoints(spark, sf).groupBy("page_id").agg(F.count("*").alias("n")).where("n >= 2").join(held.select("page_id", "url"), "page_id")
    return extract.crawl(held, links, held.select("url"), held_only=False, enough=given)


@query
def white_space_report(spark, sf):
    return report.white_space(evaluate.coverage(enriched(spark, sf), required(spark)))


@query
def report_lines(spark, sf):
    facts = evaluate.facts(enriched(spark, sf), mix=["source_citation", "computed_confidence"])
    counts = facts.where(F.col("kind") == "mix")
    return report.evidence_summary(evaluate.scorecard_of(facts, required(spark)), insights.distribution(counts, "computed_confidence", "n"), insights.top_sources(counts, n_rows="n"))


@query
def safe_names(spark, sf):
    rows = E.read(spark, sf, "part").select(F.concat("p_name", F.lit(", "), "p_type").alias("name")).distinct()
    return rows.select("name", X.safe_name("name").alias("safe"))


@query
def label_keys(spark, sf):
    return E.read(spark, sf, "region").select("r_name", X.mapped_key("r_name", C.KEYS, C.KEY_NAMES).alias("key"))


@query
def context_aliases(spark, sf):
    return E.read(spark, sf, "part").select("p_name").distinct().select("p_name", F.array_join(X.aliases_of("p_name", C.CONTEXTS), ",").alias("aliases"))


@query
def page_extractors(spark, sf):
    return extract.with_extractor(E.read(spark, sf, "pages").select("page_id", "url"), C.PAGE_KINDS)


@query
def synonym_explain(spark, sf):
    return match.explain(synonym_match(spark, sf), C.SYNONYMS).select("label", "explanation")


@query
def catalogue_enabled(spark, sf):
    return E.enabled(suppliers(spark, sf), C.FLAGS, C.CONNECTORS).select("id", "kind")


@query
def sources_by_tier(spark, sf):
    rows = raw(spark, sf)
    return E.union_by_tier([("upload", rows), ("notes", rows.where(F.col("split_logic").isNotNull()))])[0].groupBy("_at", "tier", "source_name").agg(F.count("*").alias("n_rows"))


@query
def landed_answers(spark, sf):
    ids = F.transform(F.sequence(F.lit(1), (F.col("event_id") % 12 + 1).cast("int")), lambda i: i.cast("string"))
    body = F.when(F.col("event_id") % 5 == 0, F.lit("{}")).otherwise(F.to_json(F.struct(F.col("user_id").cast("string").alias("count"), ids.alias("ids"))))
    return E.landed_counts(E.read(spark, sf, "events").select("event_id", body.alias("body")), "body").select("event_id", "value", "notes")


@query
def options_flat(spark, sf):
    k = F.col("n_nationkey")
    option = F.struct(F.concat(F.lit("o"), k.cast("string")).alias("option_id"), F.col("n_name").alias("label"), F.when(k % 4 != 0, k / 100).alias("value_numeric"))
    rows = E.read(spark, sf, "nation").join(E.read(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    types = rows.groupBy("r_name").agg(F.collect_list(option).alias("options"))  # a setting: a nation each
    return E.scenario_options(types.agg(F.map_from_entries(F.collect_list(F.struct("r_name", "options"))).alias("scenario_types")), C.OPTION_DEFAULTS)


@query
def change_log(spark, sf):
    k, size = F.col("p_partkey"), F.col("p_size").cast("string")
    cells = E.read(spark, sf, "part").select(
        F.concat(F.lit("B"), k.cast("string")).alias("cell"), F.when(k % 2 == 0, F.concat(F.lit("x"), size)).alias("excel_id"), F.concat(F.lit("m"), size).alias("metric_id"),
        F.col("p_type").alias("label"), F.when(k % 5 == 0, 0.5).otherwise(F.col("p_retailprice")).alias("old"),
    )
    values = spark.createDataFrame([(("x" if s % 2 == 0 else "m") + str(s), 10.0 * s, f"S{s}", "high" if s % 3 else None) for s in range(1, 31)] + [("m4", 44.0, "S4m", "low")], "id string, value double, source string, confidence string")
    return curated.change_log(cells, values, C.CELL_LABELS)


@query
def curated_for_place(spark, sf):
    nation, region = E.read(spark, sf, "nation"), E.read(spark, sf, "region")
    null = F.lit(None).cast("string")
    entry = F.struct(F.col("n_nationkey").cast("string").alias("value"), null.alias("year"), F.when(F.col("n_nationkey") % 3 != 0, F.col("n_name")).alias("geography"), null.alias("tier"), null.alias("confidence"))
    rows = nation.join(region, nation["n_regionkey"] == region["r_regionkey"])
    maps = rows.groupBy(F.col("r_name").alias("indication")).agg(F.map_from_entries(F.collect_list(F.struct("n_name", entry))).alias("entries"))
    return E.explode_curated(maps, places=places(spark), place="First Nation").select("indication", "metric", "geography", "value")


@query
def label_match(spark, sf):
    vectors = E.read(ship(spark), sf, "embeddings")
    items = E.read(spark, sf, "part").join(vectors, F.col("p_partkey") == F.col("vec_id"), "left")
    labels = items.select(F.when(F.col("p_partkey") % 2 == 0, F.concat("p_name", F.lit(" "), F.col("p_partkey").cast("string"))).otherwise(F.concat(F.lit("item "), F.col("p_partkey").cast("string"))).alias("label"), "embedding")
    return match.match_labels(labels, "label", "embedding", C.SYNONYMS, match.prototypes(vectors))


@query
def page_elements(spark, sf):
    kinds = extract.with_extractor(E.read(ship(spark), sf, "pages"), C.PAGE_KINDS)
    return pages.page_elements(kinds, C.PAGE_RULES).withColumnRenamed("id", "page_id")


@query
def element_datapoints(spark, sf):
    keyed = page_elements(spark, sf).select(F.struct("page_id", "pos").alias("at"), "text")
    return extract.datapoints(keyed, "at", "text", C.CLASSES, C.ALIASES).select("id.page_id", F.col("id.pos").alias("block"), "pos", "kind", "label", "found")


@query
def near_datapoints(spark, sf):
    return extract.datapoints(E.read(spark, sf, "documents"), "doc_id", "text", C.NEAR_CLASSES, [], C.NEAR)


def registry_pages(spark: SparkSession, sf: str) -> DataFrame:
    """A page for each customer with orders, as a registry lands it: a table by year, whose headings span, and one by status."""
    td = lambda *cells: F.concat(F.lit("<tr>"), *[F.concat(F.lit("<td> "), c.cast("string"), F.lit("</td>")) for c in cells], F.lit("</tr>\n"))
    orders, n = E.read(spark, sf, "orders"), F.col("n")
    years = orders.groupBy("o_custkey", F.year("o_orderdate").alias("y")).agg(F.count("*").alias("n"), F.max(F.col("o_totalprice").cast("long")).alias("m"))
    year = td(F.col("y"), n, n + 1, F.when(n % 2 == 0, (10 * n).cast("string")).otherwise("-"), F.concat(F.col("m").cast("string"), F.lit(" %")))
    trend = years.groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_list(year)), "").alias("trend"))
    statuses = orders.groupBy("o_custkey", "o_orderstatus").agg(F.count("*").alias("n"))
    groups = statuses.groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_list(td(F.col("o_orderstatus"), n))), "").alias("groups"))
    head = '<table id="trend"><thead><tr><th rowspan="2">Year<th colspan="2">A<th>B<th>Share</tr><tr><th>Seen<th>Modelled<th>Seen<th>%</tr></thead>'
    html = F.concat(F.lit(head), "trend", F.lit('</table><p>By status</p><table id="groups"><caption>Status</caption>'), "groups", F.lit("</table>"))
    return trend.join(groups, "o_custkey").select(F.col("o_custkey").alias("page_id"), html.alias("html"))


@query
def registry_tables(spark, sf):
    tables = pages.html_tables(registry_pages(ship(spark), sf))
    trend = pages.registry_entries(tables, "trend", [("count", [3, 1]), ("share", [4])])
    return trend.unionByName(pages.registry_entries(tables, "groups", [("orders", [1])], {"O": "open", "F": "filled"}))


@query
def search_phrases(spark, sf):
    return E.read(spark, sf, "part").select("p_name").distinct().select("p_name", F.array_join(X.phrases("p_name", C.PHRASES, "part"), "|").alias("phrases"))


@query
def phrasing_notes(spark, sf):
    rows = E.read(spark, sf, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))
    tried = rows.select("source", "lang", F.when(F.col("lang") != "es", F.col("n")).alias("n"))
    return insights.best_with_notes(tried, "source", "lang", "n", "lang")


@query
def cascade_cells(spark, sf):
    part, k = E.read(spark, sf, "part"), F.col("p_partkey")
    cells = part.select(F.concat(F.lit("C"), k.cast("string")).alias("cell"), k.alias("row"), F.when(k % 3 == 0, F.col("p_type")).when(k % 3 == 1, F.lower("p_type")).otherwise(F.col("p_name")).alias("label"), F.col("p_retailprice").alias("old"))
    best = part.groupBy("p_type").agg(F.max("p_retailprice").alias("value"), F.count("*").alias("n"))
    values = best.select(F.concat(F.lit("m_"), F.lower("p_type")).alias("metric_id"), F.initcap("p_type").alias("label"), "value", F.concat(F.lit("of "), F.col("n").cast("string")).alias("source"))
    return curated.cascade(cells, values, C.OPTIONS, C.CORE)


@query
def rubric_lines(spark, sf):
    return report.rubric(insights.distribution(enriched(spark, sf), "computed_confidence"))


def _balance(subject, payload):
    yield {"metric": "balance", "value": payload, "notes": f"of {subject}"}


def _signs(subject, payload):
    if payload.startswith("-"):
        raise ValueError("debt")
    return [{"metric": f"digit_{i}", "value": d} for i, d in enumerate(payload[:2])]


def _unreachable(subject, payload):
    raise OSError("not reachable")


def connected(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    k = F.col("c_custkey")
    source = F.when(k % 4 == 0, "ledger").when(k % 4 == 1, "signs").when(k % 4 == 2, "away").otherwise("unknown")
    requests = E.read(ship(spark), sf, "customer").select(F.when(k % 4 == 0, "gold").otherwise("silver").alias("tier"), source.alias("source"), F.col("c_name").alias("subject"), F.round(F.col("c_acctbal") * 100).cast("long").cast("string").alias("payload"))
    return P.run_connectors(requests, {"gold:ledger": _balance, "silver:signs": _signs, "silver:away": _unreachable})


@query
def connector_rows(spark, sf):
    return connected(spark, sf)[0]


@query
def connector_log(spark, sf):
    return connected(spark, sf)[1]


@query
def exploration(spark, sf):
    k, page = F.col("page_id"), E.read(ship(spark), sf, "pages")
    sources = page.select(
        k.alias("id"), F.concat(F.lit("Page "), k.cast("string")).alias("name"), F.when(k % 3 == 0, "gold").otherwise("bronze").alias("tier"), F.when(k % 10 == 9, "api").otherwise("link").alias("kind"), "url",
        F.when(k % 4 == 0, "incidence").when(k % 4 == 1, "demand_standard").when(k % 4 == 2, "other").alias("metric"), F.nullif(k % 5, F.lit(0)).alias("priority"),
        F.when(k % 6 == 0, F.array(F.lit("n0"))).when(k % 6 == 1, F.array(F.lit("elsewhere"))).otherwise(F.array().cast("array<string>")).alias("places"), F.when(k % 20 == 9, "counts").alias("connector"), F.when(k % 7 == 0, "use_counts").alias("enabled_when"),
    )
    part = E.read(spark, sf, "part").groupBy(F.concat(F.lit("demand_"), F.lower("p_type")).alias("metric")).agg(F.count("*").cast("string").alias("value"))
    known = part.select("metric", "value", F.lit("Parts").alias("source_citation"), F.lit("gold").alias("tier"))
    points = element_datapoints(spark, sf)
    found = extract.summarise(points.withColumnRenamed("page_id", "id")).join(page.select(k.alias("id"), "url"), "id")
    answers = E.read(spark, sf, "region").select(F.lit("counts").alias("connector"), F.concat(F.lit("region_"), F.col("r_regionkey").cast("string")).alias("metric"), F.length("r_name").cast("string").alias("value"), F.col("r_name").alias("notes"))
    return P.explore(sources, known, found, places(spark), "red widget", "Nation_0", C.FLAGS, C.LINK_METRICS, 100, answers)


def scratch(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{what}-{uuid.uuid4().hex}"


@query
def csv_evidence(spark, sf):
    """Evidence written as CSV under other headers, and read by the CSV source."""
    path, given = scratch(spark, "csv"), ["metric", "value", "source_citation", "source_tier", "population"]
    raw(spark, sf).select(*[F.col(c).alias(c.replace("_", " ").title()) for c in given], F.lit("x").alias("Extra")).write.option("header", True).option("escape", '"').csv(path)
    return E.read_csv(spark, path).select("indication", *given)


@query
def csv_order(spark, sf):
    """Rows of the sorted CSV sink by metric, and how many stand before a greater one in their file."""
    path = scratch(spark, "sorted")
    sinks.write_by_metric(raw(ship(spark), sf).select("_ord", "metric", "value"), path, "gzip")
    read = spark.read.csv(path, header=True).withColumn("_file", F.input_file_name())
    marked = sinks.out_of_order(read, "_file", ["metric", "_ord"])
    return marked.groupBy("metric").agg(F.count("*").alias("n_rows"), F.count_if("wrong").alias("n_wrong"))


@query
def run_partitions(spark, sf):
    """Rows by run after a second write that replaces one run's partition."""
    path, rows = scratch(spark, "runs"), raw(spark, sf).select("indication", "metric", "value")
    sinks.write_table(rows, path, ["indication"])
    sinks.write_table(rows.where((F.col("indication") == "ASIA") & (F.col("metric") == "demand_standard")), path, ["indication"])
    return spark.read.parquet(path).groupBy("indication").agg(F.count("*").alias("n_rows"), F.countDistinct("metric").alias("n_metrics"))


def _fetched(url):
    if "?" in url:
        raise ValueError("queries are not fetched")
    return url.upper()


@query
def polite_fetch(spark, sf):
    return extract.polite(E.read(ship(spark), sf, "pages").select("url"), _fetched, pause=0.0)
