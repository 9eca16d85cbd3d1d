"""Every registered evidence query against its SQL, on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from tallystone.operators import evaluate
from tallystone.plans import catalogue

ROWS_ONLY: set[str] = set()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    return None if isinstance(v, float) and math.isnan(v) else round(v, 6) if isinstance(v, float) else v


def table(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(plain(r[i]) for i in order) for r in rows], key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, sf_dir, name):
    df = catalogue.QUERIES[name](spark, sf_dir)
    rows = df.collect()
    assert len(set(df.columns)) == len(df.columns)
    if name in ROWS_ONLY:
        assert name not in catalogue.ORACLES
        return
    found = duck.execute(catalogue.ORACLES[name])
    columns = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(columns)
    assert table(rows, df.columns) == table(found.fetchall(), columns)


@pytest.mark.parametrize("name", ["page_elements", "element_datapoints", "page_datapoints"])
def test_pages_with_headings_cut_within_references(spark, tmp_path, name):
    """Headings are cut after so many characters, wherever that is; `&quot` in place of a quote makes one long enough to be a block."""
    text = "The rate of things, and the thing at hand was 45 or 12 %"
    heads = [("x" * n + f" {ref}")[:end] for ref in ("a &quot;", "a &copy;", "a &middot;", "a &amp;") for n in (14, 24, 34) for end in range(n + 3, n + 12)]
    rows = [(i, f"http://{('a.example.org/de', 'a.example.org', 'a.example.net', 'a.example.com')[(i + i // len(heads)) % 4]}/{i}", f"<body><h1>{h}</h1><p>{text} &quot;{i}&quot;</p></body>") for i, h in enumerate(heads * 4)]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    df = catalogue.QUERIES[name](spark, str(tmp_path))
    found = con.execute(catalogue.ORACLES[name])
    columns = [d[0] for d in found.description]
    expected = table(found.fetchall(), columns)
    assert expected and table(df.collect(), df.columns) == expected


def test_registry_rows_of_all_customers(spark, duck, sf_dir):
    """Odd keys divisible by 3 have no usable cell; all others give a row."""
    rows = duck.execute("SELECT c_mktsegment, c_custkey FROM customer").fetchall()
    expected = {(f"{m}-{k}", float(k) if k % 2 == 0 else 7.0) for m, k in rows if k % 2 == 0 or k % 3 != 0}
    assert {tuple(r) for r in catalogue.QUERIES["registry_rows"](spark, sf_dir).select("key", "value").collect()} == expected


def test_upsert_of_all_orders_into_all_customers(spark, duck, sf_dir):
    old = dict(duck.execute("SELECT c_custkey, round(c_acctbal, 2) FROM customer").fetchall())
    new = dict(duck.execute("SELECT o_custkey, max(o_totalprice) FROM orders GROUP BY 1").fetchall())
    change = lambda k: "added" if k not in old else "updated" if k in new and new[k] != old[k] else "kept"
    expected = {(k, new.get(k, old.get(k)), change(k)) for k in old.keys() | new.keys()}
    assert {tuple(r) for r in catalogue.QUERIES["curated_upsert"](spark, sf_dir).select("key", "value", "change").collect()} == expected


def test_bench_knows_every_name():
    import __spark_entry__ as entry
    import bench

    names = bench.chosen(entry.queries())
    assert len(names) == len(set(names)) and set(bench.HEADLINE) <= set(entry.queries())
    assert bench.chosen(["options_flat", "op10_b", "op2_a", "open"])[len(bench.HEADLINE) :] == ["op2_a", "op10_b"]


def test_every_oracle_has_a_query():
    assert set(catalogue.ORACLES) == set(catalogue.QUERIES) - ROWS_ONLY


def test_scalar_operators_stay_in_the_jvm(spark, sf_dir):
    for name in ("confidence_score", "numeric_extract", "year_parsers", "url_resolve", "kpi_scorecard", "text_datapoints"):
        plan = catalogue.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan


def test_scan_reads_only_what_it_needs(spark, sf_dir):
    plan = catalogue.QUERIES["cluster_assign"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "l_tax" not in plan and "c_acctbal" not in plan


@pytest.mark.parametrize("name", ["kpi_scorecard", "conflicts", "reconciliation", "forecast_auto", "report_lines", "insights_summary"])
def test_evidence_is_read_once(spark, sf_dir, name):
    """What these queries read several times is stored: the star join is planned once at most in the end."""
    plan = catalogue.QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [l_orderkey") <= 1


@pytest.mark.parametrize("name", ["kpi_scorecard", "report_lines", "insights_summary"])
def test_evidence_is_read_once_over_all_steps(spark, sf_dir, name, monkeypatch):
    """Counts the star join in what is stored on the way, too, and not in the last plan alone."""
    plan_of = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    steps, stored = [], evaluate.stored
    monkeypatch.setattr(evaluate, "stored", lambda df, what: (steps.append(plan_of(df)), stored(df, what))[1])
    steps.append(plan_of(catalogue.QUERIES[name](spark, sf_dir)))
    assert sum(p.count("Relation [l_orderkey") for p in steps) == 1
