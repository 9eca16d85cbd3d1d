"""Evidence rows: their schema, and adapters that make them from files, nested settings and the star schema."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import exprs as X

COLUMNS = (
    "indication metric value source_citation source_tier definition population year_or_range geography split_logic source_url notes confidence".split()
)
REQUIRED = ("indication", "metric", "value", "source_citation", "source_tier")
SCHEMA = T.StructType([T.StructField("_ord", T.StringType()), *[T.StructField(c, T.StringType()) for c in COLUMNS]])


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """df, dealt out by key if it comes from fewer files than there are cores: a file's rows are often one task's. Tables of many files are left as they are.

    A join by that key needs no shuffle of its own then.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(key) if len(df.inputFiles()) < cores else df


def with_columns(df: DataFrame, columns: tuple[str, ...] | list[str]) -> DataFrame:
    """The columns in order, matched by trimmed lower-case header; missing ones are null, others dropped, all text."""
    have = {c.strip().lower().replace(" ", "_"): c for c in reversed(df.columns)}
    pick = lambda c: F.col(f"`{have[c]}`").cast("string") if c in have else F.lit(None).cast("string")
    return df.select(*[pick(c).alias(c) for c in columns])


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Evidence from CSV files with a header. Types are never inferred; blanks and `nan` become null.

    _ord orders the rows by all their columns, so that it doesn't depend on how files are split.
    """
    rows = with_columns(spark.read.csv(path, header=True, inferSchema=False, multiLine=True, escape='"'), COLUMNS)
    rows = rows.select(*[X.blank_to_null(c).alias(c) for c in COLUMNS])
    return rows.select(F.concat_ws("\x1f", *[F.coalesce(c, F.lit("")) for c in COLUMNS]).alias("_ord"), *COLUMNS)


def from_star(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence rows from order lines, one for each, with all the irregularities that real evidence has.

    Dimension tables join by key, without hints: their sizes decide how. Orders meet their customers first, as narrow rows,
    so that the lines are shuffled once for their orders, and once more for parts that are too many to be broadcast.
    """
    t = lambda name: read(spark, sf_dir, name)
    line = t("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")
    line = spread(line, "l_orderkey")
    nation, region = t("nation"), t("region")
    homes = nation.join(region, nation.n_regionkey == region.r_regionkey).select(F.col("n_nationkey").alias("home_key"), "r_name")
    bought = (
        t("orders").select("o_orderkey", "o_custkey")
        .join(t("customer").select("c_custkey", "c_nationkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
        .join(homes, F.col("c_nationkey") == F.col("home_key")).select("o_orderkey", "r_name", "c_mktsegment")
    )
    rows = (
        line.join(bought, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(t("part").select("p_partkey", "p_name", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
        .join(t("supplier").select("s_suppkey", "s_name", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(nation.select("n_nationkey", "n_name"), F.col("s_nationkey") == F.col("n_nationkey"))
    )
    text = lambda c: F.col(c).cast("string")
    pad = lambda c, n: F.lpad(c.cast("string"), n, "0")
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    whole, rest = F.expr("cast(round(l_extendedprice * 100) as bigint) div 100"), cents % 100
    number = F.concat(whole.cast("string"), F.lit("."), pad(rest, 2))
    stub = F.concat(F.lit("See link https://example.org/item/"), text("l_partkey"))
    m, y, s = F.col("l_orderkey") % 10, F.year("l_shipdate"), F.col("l_suppkey")
    order = F.concat_ws(
        "|", pad(F.col("l_orderkey"), 12), pad(F.col("l_linenumber"), 3), pad(F.col("l_partkey"), 12), pad(F.col("l_suppkey"), 9), pad(cents, 14),
        pad(F.col("l_quantity").cast("long"), 6), pad(F.round(F.col("l_discount") * 100).cast("long"), 3), pad(F.round(F.col("l_tax") * 100).cast("long"), 3),
        "l_returnflag", "l_linestatus", F.date_format("l_shipdate", "yyyy-MM-dd"),
    )
    value = (
        F.when((m == 0) | (F.col("p_type") == "SMALL"), stub).when(m == 1, F.concat(F.format_number(whole, 0), F.lit(" (count)")))
        .when(m == 2, F.concat(number, F.lit(" (share); 4 (parts)"))).when(m == 3, F.when(F.col("l_linenumber") % 2 == 0, "nan"))
        .when(m == 4, whole.cast("string")).otherwise(number)
    )
    year = (
        F.when(F.col("l_partkey") % 7 == 0, F.concat(y.cast("string"), F.lit("-"), (y + 1).cast("string"))).when(F.col("l_partkey") % 7 == 1, F.concat(F.lit("FY"), y.cast("string")))
        .when(F.col("l_partkey") % 7 == 2, F.concat(y.cast("string"), F.lit(".0"))).when(F.col("l_partkey") % 7 == 3, F.lit(None).cast("string")).otherwise(y.cast("string"))
    )
    tail = (
        F.when(s % 5 == 0, F.concat(F.lit(" (https://data.example.org/s/"), s.cast("string"), F.lit(").")))
        .when(s % 5 == 1, F.concat(F.lit(" PMID: 1234"), pad(s, 9))).when(s % 5 == 2, " National Ledger").when(s % 5 == 3, " open registry note").otherwise("")
    )
    return rows.select(
        order.alias("_ord"), F.col("r_name").alias("indication"), F.concat(F.lit("demand_"), F.lower("p_type")).alias("metric"), value.alias("value"),
        F.concat(F.col("s_name"), tail).alias("source_citation"), F.when(s % 4 == 0, "gold").when(s % 4 == 1, "silver").when(s % 4 == 2, " Bronze").otherwise("platinum").alias("source_tier"),
        F.when(F.col("l_partkey") % 3 != 0, F.col("p_name")).alias("definition"), F.when(F.col("l_orderkey") % 13 == 0, "").otherwise(F.col("c_mktsegment")).alias("population"),
        year.alias("year_or_range"), F.col("n_name").alias("geography"), F.when(F.col("l_returnflag") == "R", "segment").when(F.col("l_returnflag") == "N", "age band").alias("split_logic"),
        F.when(s % 7 == 0, F.lit("https://kept.example.org/")).when(s % 7 == 1, "").alias("source_url"), F.lit(None).cast("string").alias("notes"),
        F.when(F.col("l_linenumber") % 5 == 0, "High").when(F.col("l_linenumber") % 5 == 1, "0.72").when(F.col("l_linenumber") % 5 == 2, "0.4").when(F.col("l_linenumber") % 5 == 3, "low").alias("confidence"),
    )


def metrics_dim(spark: SparkSession, metrics: list[tuple]) -> DataFrame:
    """Required metrics: id, label, required, evidence_ids, and _pos, their order."""
    return spark.createDataFrame([(i, *m) for i, m in enumerate(metrics)], "_pos int, metric_id string, label string, required boolean, evidence_ids array<string>")


def route_tiers(df: DataFrame, tiers: tuple[str, ...] = X.TIERS) -> tuple[DataFrame, DataFrame]:
    """Rows of known tiers with tier and its rank, and a log of tier, rows, status: rows of unknown tiers are dropped, but counted."""
    tier = X.key("source_tier")
    rank = reduce(lambda w, it: w.when(tier == it[1], it[0]), enumerate(tiers), F.when(F.lit(False), 0))
    marked = df.withColumn("tier", tier).withColumn("tier_order", rank)
    log = marked.groupBy(F.coalesce("tier", F.lit("")).alias("tier")).agg(F.count("*").alias("n_rows"), F.max(F.when(F.col("tier_order").isNull(), "dropped").otherwise("kept")).alias("status"))
    return marked.where(F.col("tier_order").isNotNull()), log


def for_run(df: DataFrame, source: str, geography: str | None = None) -> DataFrame:
    """Rows of one run: texts trimmed, blanks null, the citation defaulting to the source's name, the geography overridden if given."""
    rows = df.select(*[c for c in df.columns if c not in COLUMNS], *[X.blank_to_null(c).alias(c) for c in COLUMNS])
    rows = rows.withColumn("source_citation", F.coalesce("source_citation", F.lit(source)))
    return rows.withColumn("geography", F.lit(geography)) if geography else rows


def keep_informative(df: DataFrame, keep_links: bool = False) -> DataFrame:
    """Without stubs, and without `_links` metrics unless keep_links is set."""
    out = df.where(~X.is_stub("value"))
    return out if keep_links else out.where(~F.endswith(F.col("metric"), F.lit("_links")))


def explode_curated(df: DataFrame, entries: str = "entries", places: DataFrame | None = None, place: str | None = None) -> DataFrame:
    """Rows of a map column metric -> struct. A trailing _yyyy moves from the metric to the year, unless a year is given.

    With place, entries of other places are dropped; an entry without geography is for all.
    """
    rows = df.select(*[c for c in df.columns if c != entries], F.explode(entries).alias("key", "e")).select("*", "e.*").drop("e")
    suffix = F.regexp_extract("key", r"_(\d{4})$", 1)
    rows = rows.withColumn("metric", F.regexp_replace("key", r"_\d{4}$", "")).withColumn("year", F.coalesce(X.blank_to_null("year"), F.when(suffix != "", suffix)))
    rows = rows.withColumn("tier", F.coalesce("tier", F.lit("gold"))).withColumn("confidence", F.coalesce("confidence", F.lit("high")))
    if places is None or place is None:
        return rows
    names = places.where(F.col("canonical") == canonical(places, place)).select(F.col("alias").alias("_alias"))
    matched = rows.join(F.broadcast(names), X.key("geography") == F.col("_alias"), "left")
    return matched.where(X.is_blank("geography") | F.col("_alias").isNotNull()).drop("_alias")


def canonical(places: DataFrame, place: str) -> str:
    """The canonical name of a place, or the place itself."""
    row = places.where(F.col("alias") == place.strip().lower()).select("canonical").first()
    return row[0] if row else place.strip().lower()


def resolve_places(df: DataFrame, places: DataFrame, column: str) -> DataFrame:
    """Adds canonical and code; unknown places keep their trimmed lower-case name, and two letters are a code themselves."""
    small = places.select(F.col("alias").alias("_alias"), F.col("canonical").alias("_canonical"), F.col("code").alias("_code"))
    joined = df.join(F.broadcast(small), X.key(column) == F.col("_alias"), "left")
    code = F.coalesce("_code", F.when(F.length(F.trim(column)) == 2, F.upper(F.trim(column))))
    return joined.withColumn("canonical", F.coalesce("_canonical", X.key(column))).withColumn("code", code).drop("_alias", "_canonical", "_code")


def catalogue_links(sources: DataFrame, places: DataFrame, subject: str, place: str) -> DataFrame:
    """The link sources for a place in order of priority, with their templates filled. A source without places is for all."""
    aliases = F.array(*[F.lit(r[0]) for r in places.where(F.col("canonical") == canonical(places, place)).select("alias").collect()], F.lit(place.lower()))
    fits = (F.size("places") == 0) | F.arrays_overlap("places", aliases)
    links = sources.where((F.col("kind") == "link") & fits)
    return links.select("id", "name", "tier", "metric", X.fill_template("url", {"subject": subject, "place": place}).alias("url"), F.coalesce("priority", F.lit(99)).cast("long").alias("priority"))


def expand_queries(phrases: list[str], variants: list[str | Column], alone: bool = False, most: int = 12) -> Column:
    """The first `most` different search texts, phrase by phrase: a phrase alone, and with every place name. With alone the names follow by themselves.

    Phrases that end in a preposition only come with a name.
    """
    name = lambda v: v if isinstance(v, Column) else F.lit(v)
    every = [q for p in phrases for q in ([] if p.split()[-1] in ("for", "in", "of") else [F.lit(p)]) + [F.concat(F.lit(p + " "), name(v)) for v in variants]]
    return F.slice(F.array_distinct(F.array(*every, *([name(v) for v in variants] if alone else []))), 1, most)


def indicator(events: DataFrame, series: str, value: str, order: str, ts: str) -> DataFrame:
    """series, first_value, year, n_rows of every series with values: the first value by order and the first year."""
    rows = events.where(F.col(value).isNotNull())
    return rows.groupBy(F.col(series).alias("series")).agg(F.min_by(F.round(value, 2), order).alias("first_value"), F.year(F.min(ts)).cast("long").alias("year"), F.count("*").alias("n_rows"))


def still_to_fetch(links: DataFrame, known: DataFrame) -> DataFrame:
    """The links whose metric no known row has: curated values spare the fetch."""
    return links.join(known.select("metric").distinct(), "metric", "left_anti")


def enabled(sources: DataFrame, flags: dict[str, bool], connectors: list[str]) -> DataFrame:
    """Catalogue entries that may run: their enabled_when is no flag that is off, and API entries have a known connector."""
    off = [k for k, on in flags.items() if not on]
    wanted = ~F.coalesce(F.col("enabled_when"), F.lit("")).isin(off) if off else F.lit(True)
    return sources.where(wanted & ((F.col("kind") != "api") | F.coalesce(F.col("connector").isin(connectors), F.lit(False))))


def union_by_tier(frames: list[tuple[str, DataFrame]], tiers: tuple[str, ...] = X.TIERS) -> tuple[DataFrame, DataFrame]:
    """All rows of named frames, with source_name and _at, their place by tier, then by the frames' order; and a log of tier, source_name, n_rows.

    Rows of unknown tiers are left out. The union keeps repeated rows and moves nothing; sort by _at where order matters.
    """
    every = reduce(DataFrame.unionByName, [df.select("*", F.lit(name).alias("source_name"), F.lit(i).alias("_nth")) for i, (name, df) in enumerate(frames)])
    kept, _ = route_tiers(every, tiers)
    rows = kept.withColumn("_at", (F.col("tier_order") * len(frames) + F.col("_nth")).cast("long")).drop("_nth")
    return rows, rows.groupBy("tier", "source_name").agg(F.count("*").alias("n_rows"))


def landed_counts(answers: DataFrame, body: str, sample: int = 8) -> DataFrame:
    """Adds value (the count as text, 0 where the answer has none) and notes (the first ids, and how many more) from a service's landed JSON answers."""
    parsed = answers.withColumn("_a", F.from_json(body, "count string, ids array<string>"))
    n = F.coalesce(F.size("_a.ids"), F.lit(0))
    more = F.when(n > sample, F.concat(F.lit(" (+"), (n - sample).cast("string"), F.lit(" more)"))).otherwise("")
    notes = F.when(n > 0, F.concat(F.lit("ids (sample): "), F.array_join(F.slice("_a.ids", 1, sample), ", "), more))
    count = F.coalesce(F.col("_a.count").try_cast("long"), F.lit(0)).cast("string")
    return parsed.select(*answers.columns, count.alias("value"), F.coalesce(notes, F.concat(count, F.lit(" item(s)"))).alias("notes"))


def scenario_options(settings: DataFrame, defaults: list[tuple[str, str, str, float | None]], types: str = "scenario_types") -> DataFrame:
    """scenario_type, option_id, label, value from a map of types to arrays of options; the defaults where there is none."""
    flat = settings.select(F.explode(types).alias("scenario_type", "_os")).select("scenario_type", F.inline("_os")).select("scenario_type", "option_id", "label", F.col("value_numeric").alias("value"))
    spare = settings.sparkSession.createDataFrame(defaults, "scenario_type string, option_id string, label string, value double")
    return flat.unionByName(spare.join(flat.select(F.lit(True).alias("_some")).limit(1), F.lit(True), "left_anti"))
