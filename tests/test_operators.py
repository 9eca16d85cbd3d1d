"""Hand-made cases for the evidence operators, one for each rule that is easily got wrong."""

import gzip
import re

import pyarrow as pa
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallystone.functions import exprs as X
from tallystone.operators import build, curated, enrich, evaluate, extract, insights, match, pages, quality, report, sinks
from tallystone.plans import pipeline
from tallystone.sources import evidence as E
from tallystone.sources import explore as P
from tallystone.streaming import ingest


def values(spark, texts, column):
    return [r[0] for r in spark.createDataFrame([(t,) for t in texts], "v string").select(column).collect()]


def test_first_number(spark):
    texts = ["1,234 (new)", "6.5 (share); 4 (parts)", "12,34", "-5", "0", "2019", "See link x", "", "nan", None, "1e5", "1234,567", "(7) 8"]
    assert values(spark, texts, X.first_number("v")) == [1234.0, 6.5, 12.0, 5.0, 0.0, 2019.0, None, None, None, None, 1.0, 1234.0, 8.0]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="0123456789,.() -ab", max_size=14), min_size=20, max_size=40))
def test_first_number_against_python(spark, texts):
    def expected(t):
        if t.strip(" ").lower() in ("", "nan"):
            return None
        m = re.search(r"(\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+(?:\.\d+)?)", re.sub(r"\s*\([^)]*\)\s*", " ", t))
        return float(m[1].replace(",", "")) if m else None

    assert values(spark, texts, X.first_number("v")) == [expected(t) for t in texts]


def test_years(spark):
    texts = ["2019", "2018-2022", "2019.0", "FY2019", " 2020 ", "20201", "1899", None, ""]
    assert values(spark, texts, X.loose_year("v")) == [2019, 2018, 2019, None, 2020, 2020, 1899, None, None]
    assert values(spark, texts, X.strict_year("v")) == [2019, 2018, None, None, 2020, 20201, 1899, None, None]
    assert values(spark, texts, X.recent_year("v")) == [2019, 2018, 2019, 2019, 2020, 2020, None, None, None]


def test_plain_number_and_legacy_confidence(spark):
    assert values(spark, ["21,000", "2.5", "nan", None], X.plain_number("v")) == [None, 2.5, None, None]
    assert values(spark, [".7", ".4", ".39", "1.2", "HIGH", "odd", None], X.legacy_confidence("v")) == ["high", "medium", "low", "1.2", "high", "odd", None]


def test_resolve_url(spark):
    keys = [("nci", "u1"), ("ash", "u2")]
    texts = ["see https://a.b/c).", "PMID: 1234567", "incidence", "washington and nci", "none", None]
    assert values(spark, texts, X.resolve_url("v", keys)) == ["https://a.b/c", "https://pubmed.ncbi.nlm.nih.gov/1234567/", "u1", "u1", None, None]
    assert values(spark, ["incidence", "the nci"], X.resolve_url("v", keys, whole_words=True)) == [None, "u1"]


def test_score_stays_in_range(spark):
    row = spark.createDataFrame([("gold", "12", "u", "2001", "d", "g", "p"), (None, None, None, None, None, None, None)], "source_tier string, value string, source_url string, year_or_range string, definition string, geography string, population string")
    assert [r[0] for r in row.select(X.confidence_score(2001)).collect()] == [99, 15]


def test_plausible_numbers_and_percent(spark):
    assert values(spark, ["1950", "1950.5", "2.2025", "0.001", "3", "12,000", "x"], X.plausible_number("v")) == [False, True, False, False, True, True, False]
    rows = spark.createDataFrame([(40.0, 0.5), (400.0, 0.5), (40.0, 50.0), (0.4, 0.5)], "n double, o double")
    assert [r[0] for r in rows.select(X.same_percent("n", "o")).collect()] == [0.4, None, 40.0, 0.4]


def test_clusters_take_underscores_literally(spark):
    exact, patterns = {"core_a": "one", "b": "two"}, [("x_y", "three"), ("xzy", "four")]
    assert values(spark, ["core_a", "pre_b", "axzyb", "ax_yb", "zz", "", None], enrich.cluster_of("v", exact, patterns)) == ["one", "two", "four", "three", "unknown", "unknown", "unknown"]


def evidence(spark, rows):
    """rows: metric, value, source, tier, confidence[, year, geography, population]"""
    full = [(f"{i:03}", *r, *[None] * (8 - len(r))) for i, r in enumerate(rows)]
    df = spark.createDataFrame(full, "_ord string, metric string, value string, source_citation string, source_tier string, computed_confidence string, year_or_range string, geography string, population string")
    return df.withColumn("value_num", X.first_number("value")).withColumn("tier_rank", X.tier_rank("source_tier"))


def dim(spark, *metrics):
    return E.metrics_dim(spark, [(m, m.upper(), True, ids) for m, ids in metrics])


def test_scorecard(spark):
    rows = evidence(spark, [
        ("stubs", "See link", "S", "gold", "high"), ("one", "5", "S", "bronze", "low"), ("agree", "100", "A", "silver", "high"), ("agree", "110", "B", "bronze", "low"),
        ("out", "100", "A", "gold", "low"), ("out", "100", "B", "gold", "low"), ("out", "500", "C", "bronze", "low"), ("zero", "0", "A", "gold", "low"), ("zero", "0", "B", "gold", "low"),
        ("even", "10", "A", "gold", "low"), ("even", "20", "B", "gold", "low"), ("alias", "7", "A", "gold", "high"), ("tie", "3", "Z", "gold", "low"), ("tie", "3", "A", "gold", "low"),
    ])
    got = {r.metric_id: r for r in evaluate.scorecard(rows, dim(spark, ("none", []), ("stubs", []), ("one", []), ("agree", []), ("out", []), ("zero", []), ("even", []), ("named", ["alias"]), ("tie", []))).collect()}
    assert (got["none"].validation_status, got["none"].agreement_flag, got["none"].n_sources) == ("No source", "no data", 0)
    assert (got["stubs"].validation_status, got["stubs"].agreement_flag, got["stubs"].best_source) == ("Needs review", "no numeric values", "S")
    assert (got["one"].validation_status, got["one"].agreement_flag) == ("Needs review", "1 source(s)")
    assert (got["agree"].validation_status, got["agree"].best_value, got["agree"].best_source) == ("Ready", 100.0, "A")
    assert (got["out"].validation_status, got["out"].agreement_flag) == ("Needs review", "2 of 3 agree; 1 outlier(s)")
    assert (got["zero"].validation_status, got["even"].agreement_flag) == ("Ready", "1 of 2 agree; 1 outlier(s)")  # the upper median of 10 and 20 is 20
    assert (got["named"].best_value, got["named"].validation_status) == (7.0, "Ready")  # gold counts, high confidence of an alias doesn't
    assert got["tie"].best_source == "Z"
    assert evaluate.scorecard(rows.limit(0), dim(spark, ("a", []))).collect()[0].validation_status == "No source"


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(-50, 50), min_size=1, max_size=60))
def test_upper_median(spark, numbers):
    counts = spark.createDataFrame([("g", float(x)) for x in numbers], "g string, v double").groupBy("g", "v").agg(F.count("*").alias("n"))
    assert evaluate.upper_median(counts, ["g"], "v", "n", buckets=7).first().median == sorted(numbers)[len(numbers) // 2]
    assert evaluate.upper_median(counts, ["g"], "v", "n", most=len(numbers)).first().median == sorted(numbers)[len(numbers) // 2]


def test_facts(spark):
    """Nulls are groups of their own, repeated rows are counted, and an empty table gives no facts."""
    rows = evidence(spark, [("m", "5", "B", "gold", "high"), ("m", "5", "A", "gold", "low"), ("m", "5", "A", "gold", "low"), ("m", None, None, "silver", "low"), (None, "9", "A", "bronze", "low")])
    got = evaluate.facts(rows, mix=["source_citation", "computed_confidence"]).collect()
    values = {(r.metric, r.value_num): r for r in got if r.kind == "value"}
    assert {k: (r.n, r.n_values) for k, r in values.items()} == {("m", 5.0): (3, 3), ("m", None): (1, 0), (None, 9.0): (1, 1)}
    assert values["m", 5.0].best.source_citation == values["m", 5.0]["first"].source_citation == "B" and values["m", 5.0].high and values["m", 5.0].gold
    assert {(r.metric, r.source_citation): r.n for r in got if r.kind == "source"} == {("m", "A"): 2, ("m", "B"): 1, ("m", None): 1, (None, "A"): 1}
    assert sum(r.n for r in got if r.kind == "mix") == 5
    assert evaluate.facts(rows.limit(0)).count() == 0


def test_scorecard_counts_a_source_of_two_evidence_ids_once(spark):
    rows = evidence(spark, [("a", "4", "S", "gold", "low"), ("b", "4", "S", "gold", "low"), ("b", "40", "T", "bronze", "low")])
    [r] = evaluate.scorecard(rows, dim(spark, ("named", ["a", "b", "b"]))).collect()
    assert (r.n_sources, r.n_with_value, r.best_value, r.best_source, r.agreement_flag) == (2, 3, 4.0, "S", "2 of 3 agree; 1 outlier(s)")


def test_conflicts(spark):
    rows = evidence(spark, [("m", "100", "A", "gold", "x", "2001"), ("m", "100.0", "B", "gold", "x", "2001"), ("m", "7", "C", "gold", "x", "2001"), ("n", "1", "A", "gold", "x"), ("n", "1", "B", "gold", "x"), (None, "1", "A", "gold", "x"), (None, "2", "B", "gold", "x"), ("p", "1", "A", "gold", "x")])
    [r] = evaluate.conflicts(rows).collect()
    assert (r.metric, r.value_1, r.value_2, r.source_1, r.source_2, r.n_values) == ("m", "100", "100.0", "A", "B", 3)


def test_reconciliation(spark):
    rows = evidence(spark, [("m", "1.00001", "A", "gold", "x"), ("m", "1.00002", "B", "gold", "x"), ("k", "5", "A", None, "x"), ("k", "6", "B", "silver", "x"), ("k", "7", "C", "silver", "x")])
    [r] = evaluate.reconciliation(rows, dim(spark, ("m", []), ("k", []))).collect()
    assert (r.metric_id, r.recommended_value, r.recommended_source, r.range_min, r.range_max) == ("k", 6.0, "B", 5.0, 7.0)
    assert r.value_by_source == "A: 5.00; B: 6.00; C: 7.00"


def test_coverage(spark):
    rows = evidence(spark, [("m", str(i), f"S{i:02}", "gold", "x") for i in range(12)] + [("m", "See link", "S99", "gold", "x"), ("s", "See link", "A", "gold", "x"), ("s", None, "A", "gold", "x")])
    got = {r.metric_id: r for r in evaluate.coverage(rows, dim(spark, ("m", []), ("s", []), ("z", []))).collect()}
    assert (got["m"].n_sources, got["m"].n_with_value, got["m"].n_stub, got["m"].source_list) == (13, 12, 1, "; ".join(f"S{i:02}" for i in range(10)))
    assert (got["s"].coverage_status, got["s"].n_stub, got["z"].coverage_status) == ("Stub only", 1, "Missing")


def test_wide_takes_the_first_value(spark):
    rows = spark.createDataFrame([("1", "m", None, 2001, None), ("2", "m", "a", 2001, None), ("3", "m", "b", 2001, None), ("4", "m", "c", None, None), ("5", "m", "d", 2002, "part")], "_ord string, metric string, value string, year int, split_value string")
    assert [tuple(r) for r in build.wide(rows, [2001, 2002]).collect()] == [(1, "m", "a", None), (2, "part", None, "d")]
    assert {tuple(r) for r in build.one_column(rows).collect()} == {("m", None), ("part", "d")}


def test_trend(spark):
    rows = spark.createDataFrame([("1", "a", "100", "2000"), ("2", "a", "121", "2002"), ("3", "b", "5", "2001"), ("4", "c", "0", "2000"), ("5", "c", "9", "2001"), ("6", "d", "10", "2001"), ("7", "d", "30", "2001"), ("8", "e", "21,000", "2001"), ("9", "f", "nan", "2001")], "_ord string, metric string, value string, year_or_range string")
    got = {r.metric: (r.year, r.forecast, r.growth) for r in build.trend(rows, 1).collect()}
    assert got == {"a": (2003, 133.1, 0.1), "b": (2002, 5.0, 0.0), "c": (2002, 9.0, 0.0), "d": (2002, 10.0, 0.0)}  # d: two rows in the last year, so no growth, from the first
    rates = spark.createDataFrame([("b", 0.5)], "metric string, rate double")
    assert {r.metric: r.forecast for r in build.trend(rows, 1, rates=rates).collect()}["b"] == 7.5


def test_insights_and_gap(spark):
    rows = evidence(spark, [("m", "1", "A", "gold", "x", "2001-2002"), ("m", None, "A", "silver", "x", "FY2003")])
    card = spark.createDataFrame([("m", "No source")], "metric_id string, validation_status string")
    r = insights.insights(rows, card).first()
    assert (r.n_values, r.tiers, r.min_year, r.max_year, r.has_gap) == (1, "gold, silver", 2001, 2001, True)


def test_quality(spark):
    good = spark.createDataFrame([("i", "m", "1", "A", "gold", "2001", None)], "indication string, metric string, value string, source_citation string, source_tier string, year_or_range string, geography string")
    assert quality.validate_evidence(good).count() == 0
    quality.ensure(quality.validate_evidence(good))
    bad = good.unionByName(good).unionByName(good.withColumn("source_tier", F.lit("platinum")).withColumn("value", F.lit(" ")))
    found = {r.code: r for r in quality.validate_evidence(bad).collect()}
    assert set(found) == {"invalid_tier", "blank_value", "repeated_key"} and found["blank_value"].n_rows == 1 and found["repeated_key"].n_rows == 3
    with pytest.raises(ValueError, match="platinum"):
        quality.ensure(quality.validate_evidence(bad))
    assert quality.validate_evidence(good.limit(0)).first().code == "empty"
    assert quality.validate_evidence(good.drop("value")).first().code == "missing_columns"
    assert quality.validate_file(spark, "/nowhere/x.csv", E.read_csv).first().code == "file_missing"
    clusters = spark.createDataFrame([("a",)] * 4 + [(None,)], "cluster string")
    assert quality.validate_output(clusters, ["cluster"]).first().code == "ok"
    assert quality.validate_output(clusters.limit(4).union(clusters.where("cluster is null")).union(clusters.where("cluster is null")), ["cluster"]).first().level == "warning"


def test_synonyms(spark):
    labels = spark.createDataFrame([("Red",), ("big red box",), ("cri",), ("  ",), ("other thing!",)], "l string")
    got = {r.label: (r.metric_id, round(r.score, 3), r.how) for r in match.match_synonyms(labels, "l", {"m1": ["red", "crimson"], "m2": ["box", "red"]}).collect()}
    assert got == {"Red": ("m1", 0.95, "synonym"), "big red box": ("m1", 0.791, "synonym"), "cri": ("m1", 0.65, "synonym"), "  ": ("unknown", 0.0, "blank"), "other thing!": ("other_thing", 0.0, "slug")}


CLASSES = [("incidence", ["incid"]), ("rate", ["rate"])]


def brute_datapoints(text):
    out, low = [], text.lower()
    for n, m in enumerate(re.finditer(r"\d+(?:\.\d+)?\s*%", text)):
        v = re.match(r"[\d.]+", m[0])[0]
        near = low[max(0, m.start() - 100) : m.end() + 100]
        if 0 <= float(v) <= 100:
            out.append(("percent", n, next((c for c, ws in CLASSES if any(w in near for w in ws)), "value"), v + "%"))
    for n, m in enumerate(re.finditer(extract.NUMBER, text)):
        near, wide, v = low[max(0, m.start() - 200) : m.end() + 200], low[max(0, m.start() - 500) : m.end() + 500], float(m[0].replace(",", ""))
        if v >= 0.01 and not (1900 <= v <= 2050 and "." not in m[0]) and not re.match(r"^\d+\.\d{4}$", m[0]) and any(w in near for _, ws in CLASSES for w in ws) and "topic" in wide:
            out.append(("number", n, next(c for c, ws in CLASSES if any(w in near for w in ws)), m[0]))
    return sorted(out)


def test_datapoints(spark):
    texts = ["The topic has incidence 12.5% and 1,234 cases in 2019, rate 7.", "topic rate " + "x " * 300 + " 55 far away; rate 3 topic 2.2025 and 120 %", "no subject: incidence 5%", "", None, "topic Ünïcode é incidence 1 2 3 " * 60]
    got = extract.datapoints(spark.createDataFrame(list(enumerate(texts)), "id int, text string"), "id", "text", CLASSES, ["topic"])
    by = {}
    for r in got.collect():
        by.setdefault(r.id, []).append((r.kind, r.pos, r.label, r.found))
    for i, t in enumerate(texts):
        expected = brute_datapoints(t) if t and "topic" in t else []
        assert sorted(by.get(i, [])) == expected
    assert extract.summarise(got).where("id = 0").first().summary.startswith("12.5% (incidence); ")


def test_summary(spark):
    rows = spark.createDataFrame([(1, 0, "number", "value", "5"), (1, 1, "number", "rate", "5"), (1, 2, "number", "incidence", "1,000"), (1, 3, "number", "rate", "1000"), (2, 0, "percent", "rate", "4%")], "id int, pos long, kind string, label string, found string")
    assert {r.id: r.summary for r in extract.summarise(rows).collect()} == {1: "1,000 (incidence); 5 (rate)", 2: "4%"}
    many = spark.createDataFrame([(1, i, "number", "rate", str(100 + i)) for i in range(20)], "id int, pos long, kind string, label string, found string")
    assert extract.summarise(many).first().summary.count(";") == 14


PAGE = "<nav>topic 1</nav><h2>About topic</h2><table><caption>Topic table</caption><tr><th>Incidence</th><td>77</td></tr></table><p>Short.</p><script>x=5</script><p>This topic paragraph has an incidence of 12 a year.</p>"


def test_page_blocks_and_datapoints(spark):
    pages = spark.createDataFrame([(1, PAGE), (2, None), (3, "<p>unclosed")], "page_id int, html string")
    blocks = [(r.kind, r.text, r.context) for r in extract.page_blocks(pages).orderBy("id", "pos").collect()]
    assert blocks == [("block", "This topic paragraph has an incidence of 12 a year.", ""), ("row", "Incidence 77", "Topic table About topic")]
    assert {(r.label, r.found) for r in extract.page_datapoints(pages, CLASSES, ["topic"]).collect()} == {("incidence", "12"), ("incidence", "77")}


def test_polite_fetch_logs_errors(spark):
    def fetch(url):
        if "bad" in url:
            raise OSError("no route")
        return "body of " + url

    urls = spark.createDataFrame([("http://a/1",), ("http://a/bad",)], "url string")
    got = {r.url: (r.body, r.error) for r in extract.polite(urls, fetch, pause=0.01).collect()}
    assert got == {"http://a/1": ("body of http://a/1", None), "http://a/bad": (None, "no route")}


def test_curated(spark):
    old = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "k string, v double")
    new = spark.createDataFrame([("b", 3.0), ("c", 4.0)], "k string, v double")
    assert {tuple(r) for r in curated.upsert(old, new, "k", "v").collect()} == {("a", 1.0, "kept"), ("b", 3.0, "updated"), ("c", 4.0, "added")}
    rows = spark.createDataFrame([({"m_2001": ("1", None, "n0"), "x": ("2", "1999", "Elsewhere"), "y": ("3", None, None)},)], "entries map<string, struct<value:string,year:string,geography:string>>")
    rows = rows.select(F.transform_values("entries", lambda k, e: F.struct(e["value"].alias("value"), e["year"].alias("year"), e["geography"].alias("geography"), F.lit(None).cast("string").alias("tier"), F.lit(None).cast("string").alias("confidence"))).alias("entries"))
    places = spark.createDataFrame([("n0", "north", "N"), ("north", "north", "N")], "alias string, canonical string, code string")
    got = {(r.metric, r.year, r.tier) for r in E.explode_curated(rows, places=places, place="North").collect()}
    assert got == {("m", "2001", "gold"), ("y", None, "gold")}
    cells = spark.createDataFrame([(["2001 ", "-", "12 %"],), (["2002", "5", "9"],), (["-", "5", "9"],)], "cells array<string>")
    assert {tuple(r) for r in curated.registry_rows(cells, [1, 2]).collect()} == {("2001", 12.0), ("2002", 5.0)}
    picked = curated.preferred(spark.createDataFrame([("b", 1.0), ("a", None), ("c", 2.0)], "metric_id string, value double"), ["a", "b", "c"])
    assert tuple(picked.first()) == ("b", 1.0)


def test_csv_round_trip(spark, tmp_path):
    (tmp_path / "in.csv").write_text('Indication, Metric ,value,Source Citation,source_tier,extra\nI,m,"1,5",A,gold,x\nI,m,nan,B,platinum,y\n')
    rows = E.read_csv(spark, str(tmp_path / "in.csv"))
    assert rows.columns == ["_ord", *E.COLUMNS]
    assert [(r.metric, r.value, r.source_citation) for r in rows.orderBy("_ord").collect()] == [("m", None, "B"), ("m", "1,5", "A")]
    kept, log = E.route_tiers(rows)
    assert kept.count() == 1 and {(r.tier, r.status) for r in log.collect()} == {("gold", "kept"), ("platinum", "dropped")}
    sinks.write_by_metric(rows.drop("notes"), str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out"), header=True).count() == 2


def test_order_of_sorted_files_is_checked_without_a_shuffle(spark, tmp_path):
    """Each file's rows are compared with the one before, over batches, and not over files; nulls come first, and keys column by column."""
    folder = tmp_path / "f"
    folder.mkdir()
    for name, rows in (("a", ["a,9", "ab,1", "b,1", "b,0", "c,5"]), ("b", ["b,2", ",1", ",0", "b,2"])):
        with gzip.open(folder / f"{name}.csv.gz", "wt") as f:
            f.write("\n".join(["metric,_ord", *rows]) + "\n")
    read = spark.read.csv(str(folder), header=True).withColumn("_file", F.input_file_name())
    given = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        got = sinks.out_of_order(read, "_file", ["metric", "_ord"]).groupBy("metric").agg(F.count("*"), F.count_if("wrong")).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", given)
    assert {tuple(r) for r in got} == {("a", 1, 0), ("ab", 1, 0), ("b", 4, 1), ("c", 1, 0), (None, 2, 2)}
    sinks.write_by_metric(read.select("metric", "_ord"), str(tmp_path / "out"), "gzip")
    assert not list((tmp_path / "out").glob("*.csv")) and spark.read.csv(str(tmp_path / "out"), header=True).count() == 9


def test_pages_are_parsed_in_parts(monkeypatch):
    """However many pages a batch holds, few bytes of them are parsed before their rows are sent on; no page is lost or cut."""
    made = [pa.record_batch([pa.array(range(7)), pa.array(["x" * 400, None, "y" * 5000, "", "z" * 400, "z" * 400, "z" * 400])], names=["id", "html"])]
    parts = [p.column(0).to_pylist() for p in pages.slices(made[0], 1, 1000)]
    assert parts == [[0, 1], [2], [3, 4, 5], [6]]
    assert list(pages.slices(made[0].slice(0, 0), 1)) == []


def test_partitioned_sink_keeps_other_runs(spark, tmp_path):
    df = lambda i, n: spark.createDataFrame([(i, n)], "run string, n int")
    for i, n in (("a", 1), ("ab", 2), ("a", 3)):
        sinks.write_table(df(i, n), str(tmp_path / "t"), ["run"])
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "t")).select("run", "n").collect()} == {("a", 3), ("ab", 2)}


def test_checksum_ignores_row_order(spark):
    df = spark.createDataFrame([("a", i) for i in range(20)], "k string, n int")
    one, two = (d.select("checksum").first()[0] for d in (sinks.checksums(df, "k"), sinks.checksums(df.orderBy(F.desc("n")).repartition(3), "k")))
    assert one == two != sinks.checksums(df.limit(19), "k").first().checksum


def test_pipeline(spark, sf_dir, tmp_path):
    rows = E.from_star(spark, sf_dir)
    config = pipeline.Config(2001, [("demand_standard", "Standard", True, []), ("none", "None", True, [])], years=[2000, 2001], growth={"demand_standard": 0.1})
    result = pipeline.run(spark, rows, config)
    try:
        result.write(str(tmp_path / "run"), {"run": "r1"})
        assert spark.read.parquet(str(tmp_path / "run/kpi_scorecard")).count() == 2
        assert {r.table_name for r in spark.read.parquet(str(tmp_path / "run/manifest")).collect()} == set(result.tables)
        assert report.render(result.tables["summary"], "T").startswith("# T\n\n## Caveats")
    finally:
        result.close()


def exchanges_above(df, scanned):
    """How many shuffles the rows of a scan go through: the exchanges among its ancestors in the plan."""
    above, lines = [], df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1].splitlines()
    for line in lines:
        depth = len(line) - len(line.lstrip(" :+-"))
        above = [(d, n) for d, n in above if d < depth] + [(depth, line)]
        if "FileScan" in line and scanned in line:
            return sum(" Exchange " in f" {n.lstrip(' :+-')}" for _, n in above)
    raise AssertionError(f"no scan of {scanned}")


def test_star_join_shuffles_lines_once_for_a_large_table_of_orders(spark, sf_dir):
    """Where nothing is broadcast: by order, part, supplier and nation, and neither for their customers nor to be dealt out."""
    given = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert exchanges_above(E.from_star(spark, sf_dir), "l_orderkey") == 4
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", given)


def test_strict_pipeline_stops_on_errors(spark, sf_dir):
    rows = E.from_star(spark, sf_dir)
    pipeline.run(spark, rows, pipeline.Config(2001, [("a", "A", True, [])], strict=True)).close()
    with pytest.raises(ValueError, match="missing_columns"):
        quality.ensure(quality.validate_evidence(rows.drop("value")))


def test_results_do_not_depend_on_partitions(spark, sf_dir):
    rows = enrich.enrich(E.from_star(spark, sf_dir), 2001, [], {}, [], {})
    need = dim(spark, ("demand_standard", []), ("demand_large", []))
    a, b = (sorted(map(str, evaluate.scorecard(r, need).collect())) for r in (rows, rows.repartition(7)))
    assert a == b


def test_stream_ingest(spark, tmp_path):
    (tmp_path / "in").mkdir()
    header = ",".join(E.COLUMNS)
    for i in range(2):
        (tmp_path / "in" / f"{i}.csv").write_text(f"{header}\ni,m,{i},A,gold,,,,,,,,high\n")
        q = ingest.append(ingest.read_stream(spark, str(tmp_path / "in")), lambda d: d.withColumn("n", X.first_number("value")), str(tmp_path / "out"), str(tmp_path / "ck"))
        q.awaitTermination(60)
    assert sorted(r.n for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [0.0, 1.0]
    counts = ingest.event_counts(spark.read.parquet("/root/testdata/sf0.001/events.parquet"))
    assert counts.agg(F.sum("n_rows")).first()[0] == spark.read.parquet("/root/testdata/sf0.001/events.parquet").count()


def test_options_default_only_where_there_are_none(spark):
    kind = "scenario_types map<string, array<struct<option_id: string, label: string, value_numeric: double>>>"
    spare = [("growth", "d", "Default", 0.02)]
    assert [r.option_id for r in E.scenario_options(spark.createDataFrame([({},)], kind), spare).collect()] == ["d"]
    assert [r.option_id for r in E.scenario_options(spark.createDataFrame([({"growth": [("a", "A", 0.1)]},)], kind), spare).collect()] == ["a"]


def test_median_beside_an_outlier(spark):
    rows = [("a", 1.0 + i / 1e6, 1 + i % 3) for i in range(5000)] + [("a", 1e300, 1), ("b", 0.0, 4), ("b", 7.0, 3), ("c", -2.0, 1)]
    got = {r.g: r.median for r in evaluate.upper_median(spark.createDataFrame(rows, "g string, v double, n long"), ["g"], "v", "n").collect()}
    flat = sorted(v for g, v, n in rows if g == "a" for _ in range(n))
    assert got == {"a": flat[len(flat) // 2], "b": 0.0, "c": -2.0}


def test_broken_pages(spark):
    pages = spark.createDataFrame([(1, "<![x[ y ]]><p>" + "words of a block that is long enough to count</p><!-- never closed")], "page_id long, html string")
    assert [r.text for r in extract.page_blocks(pages).collect()] == ["words of a block that is long enough to count"]


def test_pipeline_unites_named_sources(spark, sf_dir):
    rows = E.from_star(spark, sf_dir).limit(400)
    config = pipeline.Config(as_of=2001, metrics=[("demand_standard", "Standard demand", True, [])])
    one, two = pipeline.run(spark, rows, config), pipeline.run(spark, [("a", rows), ("b", rows)], config)
    try:
        assert two.held.count() == 2 * one.held.count() > 0 and two.held.columns == one.held.columns
    finally:
        one.close()
        two.close()


def page_rows(spark, texts, kinds=None):
    return spark.createDataFrame([(i, t, (kinds or {}).get(i, "page"), f"http://h.example/{i}/x") for i, t in enumerate(texts)], "page_id long, html string, extractor string, url string")


LONG = "a text of more than thirty characters, surely"


def test_elements_by_rule(spark):
    texts = [
        f"<title>{LONG}</title><nav><p>{LONG}</nav><h1>Head</h1><p>{LONG} one<b> bold</b><br>line<p>{LONG} two<div>{LONG} three<p>short</p> tail of the div that is long enough</div>",
        f"<ul><li>{LONG} 1<li>{LONG} 2</ul><table><tr><td>{LONG} 3<td>x</table>",
        f"<div><nav>{LONG} lost</div><p>{LONG} kept: the element around ends what is dropped",
        f"<p>{LONG} &amp; more&am", f"<p>{LONG}<!-- cut", f"<p>{LONG}<a href=", None, "", "plain", f"<P CLASS=x>{LONG}</P></div></p></p>",
    ]
    rules = {"few": pages.Rule(("p", "li"), 1, 10), "heads": pages.Rule(("h1",), None, 3)}
    rows = page_rows(spark, texts, {1: "few"})
    got = {}
    for r in pages.page_elements(rows.union(rows.where("page_id = 0").withColumn("page_id", F.lit(100).cast("long")).withColumn("extractor", F.lit("heads"))), rules).orderBy("id", "pos").collect():
        got.setdefault(r.id, []).append((r.element, r.text))
    assert got[0] == [("p", f"{LONG} one bold line"), ("p", f"{LONG} two"), ("div", f"{LONG} three"), ("div", "tail of the div that is long enough")]
    assert got[1] == [("li", f"{LONG} 1")] and got[100] == [("h1", "Head")]
    assert got[2] == [("p", f"{LONG} kept: the element around ends what is dropped")]
    assert got[3] == [("p", f"{LONG} & more&am")] and got[4] == got[5] == got[9] == [("p", LONG)]
    assert set(got) == {0, 1, 2, 3, 4, 5, 9, 100}


def test_references_need_their_semicolons(spark):
    """A heading cut within a reference keeps what is left of it; a cut `&amp` is an ampersand. Whole references count anywhere."""
    ends = {"&quot;": '"', "&quot": "&quot", "&copy": "&copy", "&middot": "&middot", "&amp": "&", "&am": "&am", "&": "&", "&amp;": "&", "&#39;": "'", "&#x27;": "'", "&#39": "&#39", "&eacute;": "é", "&nope;": "&nope;", "&ampx;": "&ampx;"}
    rows = page_rows(spark, [f"<h1>{LONG} {end}</h1><p>{LONG} {end}<b> on</b>, {end}" for end in ends])
    got = {}
    for r in pages.page_elements(rows, {}).orderBy("id", "pos").collect():
        got.setdefault(r.id, []).append(r.text)
    inside = {"&amp": "&amp"}
    expected = [[f"{LONG} {text}", f"{LONG} {inside.get(end, text)} on, {text}"] for end, text in ends.items()]
    assert [got[i] for i in range(len(ends))] == expected
    blocks = [r.text for r in extract.page_blocks(rows).orderBy("id", "pos").collect()]
    assert blocks == [t for ts in expected for t in ts]


def test_tables(spark):
    texts = [
        '<table id=t><tr><th rowspan=2>Y<th colspan=2>A</tr><tr><th>1<th>2</tr><tr><td>2001<td rowspan=2>5 %<td>-</tr><tr><td>2002<td>7</tr></table>',
        "<table><tr><td>a<table id=in><tr><td>b</table>c<td>d</table>", "<table id=t><tr><td colspan=x>1<td rowspan=0>2<tr><td>3", "no table", None, "<td>stray</td><tr></tr></table>",
        '<table id="t"><tr><td>Late one</td><td>9</td></tr><tr><td>other</td><td>8</td></tr><tr><td>2003</td><td></td><td>n/a for all</td></tr></table>',
    ]
    tables = pages.html_tables(page_rows(spark, texts))
    rows = [(r.id, r.table_no, r.table_id, r.row_no, r.is_header, r.cells) for r in tables.collect()]
    assert [r[3:] for r in sorted(rows) if r[0] == 0] == [(0, True, ["Y", "A", "A"]), (1, True, ["Y", "1", "2"]), (2, False, ["2001", "5 %", "-"]), (3, False, ["2002", "5 %", "7"])]
    assert sorted(r[1:3] + r[5:] for r in rows if r[0] == 1) == [(0, "", ["ac", "d"]), (1, "in", ["b"])]
    assert [r[5] for r in sorted(rows) if r[0] == 2] == [["1", "2"], ["3"]] and not {3, 4, 5} & {r[0] for r in rows}
    got = {tuple(r) for r in pages.registry_entries(tables, "t", [("m", [2, 1])]).collect()}
    assert got == {(0, "m", "2001", "5", 1), (0, "m", "2002", "7", 2), (6, "m", "2003", "n/a for all", 2), (2, "m", "1", "2", 1)}
    assert not pages.registry_entries(tables, "t", [("m", [2])], skip="for all").where("id = 6").count()
    assert {tuple(r) for r in pages.registry_entries(tables, "t", [("m", [1])], {"late": "stage_late"}, starts=True).collect()} == {(6, "m", "stage_late", "9", 1)}
    assert {r.key for r in pages.registry_entries(tables, "t", [("m", [1])], {"other": "o", "late": "no"}).collect()} == {"o"}


@pytest.mark.parametrize("page", ["<table>" * 3000, "<table><tr><td colspan=1000 rowspan=65534>x" * 20, "<b>" * 20000 + "<p>x" * 20000, "<div>x" * 20000 + "</p>" * 20000, "<!--" * 20000, "<a href=x" * 20000])
def test_hostile_pages_end(page):
    for reader in (pages.Elements(pages.ANY), pages.Tables(), pages.Links()):
        reader.read(page)


def test_links_and_crawl(spark):
    texts = ['<a href="/1/x">a</a><a href=y#z>b</a><a href="mailto:a@b">c</a><a href="http://[bad">d</a><a>e</a><a href="#top">f</a><A HREF=" http://other.example/q ">g</A><a href="/1/x">again</a>', '<a href="/2/x">n</a><a href="/gone">n</a>', '<a href="/0/x">back</a>', None]
    rows = page_rows(spark, texts)
    links = pages.page_links(rows)
    assert [(r.nth, r.dst) for r in links.where("id = 0").orderBy("nth").collect()] == [(0, "http://h.example/1/x"), (1, "http://h.example/0/y"), (2, "http://h.example/0/x"), (3, "http://other.example/q")]
    assert pages.page_links(rows, most=1).where("id = 0").count() == 1
    start = rows.where("page_id = 0").select("url")
    go = lambda **how: {(r.url.removeprefix("http://h.example/"), r.depth) for r in extract.crawl(rows, links, start, **how).collect()}
    assert go() == {("0/x", 0), ("1/x", 1), ("2/x", 2)}
    assert go(held_only=False) == {("0/x", 0), ("1/x", 1), ("0/y", 1), ("2/x", 2), ("gone", 2)}
    assert go(enough=rows.where("page_id = 1").select("url")) == {("0/x", 0), ("1/x", 1)}


def test_windows(spark):
    texts = [(0, "9 things and 2030 of them " + "x" * 100 + " 12% " + "y" * 200 + " 31 things, 2.2025 also, 2031 too")]
    rows = spark.createDataFrame(texts, "id long, text string")
    plain = extract.Windows(number=20, alias=None, percent_label="percent", years=(1900, 2030), versions=False)
    got = [(r.kind, r.label, r.found) for r in extract.datapoints(rows, "id", "text", [("incidence", ["thing"])], [], plain).orderBy("pos").collect()]
    assert sorted(got) == [("number", "incidence", "2.2025"), ("number", "incidence", "31"), ("number", "incidence", "9"), ("percent", "percent", "12%")]
    short = extract.datapoints(rows, "id", "text", [("incidence", ["thing"])], [], plain._replace(most=30))
    assert [r.found for r in short.collect()] == ["9"]
    assert extract.datapoints(rows, "id", "text", [("incidence", ["thing"])], ["absent"]).count() == 0


def test_phrases(spark):
    rules = [([["a b", "c"], ["x"]], ["not"], ["First", "Second"]), ([["c"]], [], ["Third"])]
    texts = ["c and A B", "x", "x not", "A B not c", "", None, " plain (in braids) label "]
    assert values(spark, texts, X.phrases("v", rules, "part")) == [["First", "Second"], ["First", "Second"], ["x not", "x not part"], ["Third"], ["part"], ["part"], ["plain label", "plain label part"]]


def test_phrasing_notes(spark):
    rows = [("s", f"phrase {i} " + "z" * 60, n, i) for i, n in enumerate([3, None, 9, 9, 1, 2])] + [("none", "p", 0, 0), ("failed", "p", None, 0)]
    got = {r.s: r for r in insights.best_with_notes(spark.createDataFrame(rows, "s string, p string, n long, i int"), "s", "p", "n", "i").collect()}
    name = lambda i: (f"phrase {i} " + "z" * 60)[:48]
    assert got["s"].notes == "9 found (best of 6 phrasings). " + "; ".join(f"{name(i)}: {n}" for i, n in ((0, 3), (2, 9), (3, 9), (4, 1)))
    assert (got["s"].best_label[:9], got["s"].n_tried) == ("phrase 2 ", 6)
    assert (got["none"].best_count, got["none"].best_label, got["none"].notes) == (0, None, "0 found (best of 1 phrasings). p: 0") and got["failed"].notes == "0 found (best of 1 phrasings). "


def test_cascade(spark):
    cells = spark.createDataFrame([("B1", 1, "Late", 1.0), ("B2", 2, "Late", 2.0), ("B3", 3, "rate of all", None), ("B4", 4, None, 4.0)], "cell string, row long, label string, old double")
    vals = spark.createDataFrame([("late", "x", 10.0, "S1"), ("core", "", 20.0, "S2"), ("named", "Rate of All", 30.0, "S3"), ("named2", "RATE OF ALL", 31.0, "S4"), ("empty", "late", None, "S5"), ("odd", "Late", float("nan"), "S6")], "metric_id string, label string, value double, source string")
    got = {tuple(r) for r in curated.cascade(cells, vals, {"late": "Late", "empty": "Late"}, {"core": 4, "named": "Late", "absent": 1}).collect()}
    assert got == {("option", "B1", "late", 1.0, 10.0, "S1"), ("core", "B4", "core", 4.0, 20.0, "S2"), ("core", "B1", "named", 1.0, 30.0, "S3"), ("label", "B3", "named", None, 30.0, "S3")}
    assert curated.cascade(cells, vals, {}, {}).where("step <> 'label'").count() == 0


def test_one_failing_connector_leaves_the_rest(spark):
    def good(subject, payload):
        return [{"metric": "n", "value": len(payload)}, {"metric": "m", "value": None}] if payload else []

    def bad(subject, payload):
        raise OSError("down") if subject == "b" else ValueError("x" * 900)

    requests = spark.createDataFrame([("gold", "good", s, p) for s, p in (("a", "12"), ("b", ""))] + [("gold", "bad", "a", ""), ("gold", "bad", "b", ""), ("gold", "none", "a", "")], "tier string, source string, subject string, payload string")
    rows, log = P.run_connectors(requests, {"gold:good": good, "gold:bad": bad})
    assert {tuple(r) for r in rows.collect()} == {("gold", "good", "a", "n", "2", None), ("gold", "good", "a", "m", None, None)}
    got = {r.source: tuple(r)[2:] for r in log.collect()}
    assert got == {"good": (2, 2, 0, "ok", None), "bad": (2, 0, 2, "error", "OSError: down")}
    assert P.run_connectors(requests.limit(0), {"gold:good": good})[1].count() == 0


def test_exploration(spark):
    kinds = "id string, name string, tier string, kind string, url string, metric string, priority int, places array<string>, connector string, enabled_when string"
    sources = spark.createDataFrame([("a", "A", "gold", "link", "http://x/{place}", "rate", 2, [], None, None), ("b", "B", "gold", "link", "http://y", "odd", 1, [], None, None), ("c", "C", "gold", "link", "http://z", "rate", None, ["n0"], None, None), ("d", "D", "gold", "link", "http://x/Here", "rate", 1, ["far"], None, None), ("e", "E", "gold", "link", "http://w", "rate", 1, [], None, "off"), ("f", "F", "silver", "api", None, None, None, [], "svc", None), ("g", "G", "silver", "api", None, None, None, [], "gone", None)], kinds)
    known = spark.createDataFrame([("share", "5", "K", "gold")], "metric string, value string, source_citation string, tier string")
    found = spark.createDataFrame([("http://x/Here", "7 (rate)"), ("http://y", "8"), ("http://z", " ")], "url string, summary string")
    places = spark.createDataFrame([("n0", "here", "H"), ("here", "here", "H")], "alias string, canonical string, code string")
    answers = spark.createDataFrame([("svc", "count", "3", "n")], "connector string, metric string, value string, notes string")
    got = lambda **how: {(r.part, r.id, r.metric, r.value, r.notes) for r in P.explore(sources, known, found, places, "s", "Here", {"off": False}, ["rate", "share"], **how).collect()}
    links = {("curated", None, "share", "5", None), ("link", "a", "rate", "7 (rate)", "value extracted"), ("link", "b", "b_links", "8", "value extracted"), ("link", "c", "rate", P.STUB, "no datapoints found")}
    assert got() == links and got(answers=answers) == links | {("answer", "f", "count", "3", "n")}
    assert ("link", "a", "rate", P.STUB, "not looked into") in got(most_dives=1)
    taken = P.explore(sources, known.withColumn("metric", F.lit("rate")), found, places, "s", "Here", {}, ["rate"])
    assert {r.notes for r in taken.where("part = 'link' AND metric = 'rate'").collect()} == {"curated value available"}


def test_labels_without_vector(spark):
    labels = spark.createDataFrame([("red", [1.0, 0.0]), ("odd", None), ("near", [0.0, 2.0])], "label string, v array<double>")
    protos = spark.createDataFrame([("p", [0.0, 1.0])], "label string, proto array<double>")
    got = {r.label: (r.metric_id, r.how) for r in match.match_labels(labels, "label", "v", {"m": ["red"]}, protos).collect()}
    assert got == {"red": ("m", "synonym"), "odd": ("odd", "slug"), "near": ("p", "vector")}


def test_score_needs_no_url_expression(spark):
    """has_url() says what resolve_url() finds."""
    texts = ["see https://a.b/c).", "PMID: 1234567", "pmid 12345", "the Ledger of notes", "nothing", "", None, "http://", "HTTPS://X"]
    keys = [("ledger", "u")]
    both = spark.createDataFrame([(t,) for t in texts], "v string").select(X.has_url("v", keys).alias("has"), X.resolve_url("v", keys).isNotNull().alias("made")).collect()
    assert all(r.has == r.made for r in both)
