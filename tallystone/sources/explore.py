"""Exploration of a source catalogue as one plan: gated links with their stubs, what their pages give, and connectors."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..session import stored
from . import evidence as E

STUB = "See link for values"


def run_connectors(requests: DataFrame, registry: dict[str, Callable[[str, str], Iterable[dict]]]) -> tuple[DataFrame, DataFrame]:
    """Rows that connectors give, and a log of them.

    requests: tier, source, subject, payload (what the connector works on, such as a landed answer). registry: `tier:source` to
    connector(subject, payload), which gives dicts of metric, value and notes; it runs on the executors, each source's
    requests together, dealt out by source and subject. A request that raises gives no rows but a log row with the
    error; the others are whole. Requests without connector are left out of both.
    Returns (tier, source, subject, metric, value, notes) and (tier, source, n_requests, n_rows, n_failed, status, error: the least). Each connector runs once: its
    answers are stored.
    """
    known = requests.where(F.concat(F.col("tier"), F.lit(":"), F.col("source")).isin(list(registry)))
    schema = "tier string, source string, subject string, metric string, value string, notes string, error string"
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        for batch in batches:
            out: list[tuple] = []
            for tier, source, subject, payload in zip(*[batch.column(i).to_pylist() for i in range(4)]):
                try:
                    made = [(tier, source, subject, *[None if r.get(k) is None else str(r[k]) for k in ("metric", "value", "notes")], None) for r in registry[f"{tier}:{source}"](subject, payload)]
                    out += made or [(tier, source, subject, None, None, None, None)]
                except Exception as e:  # one source's fault is logged and leaves the rest whole
                    out.append((tier, source, subject, None, None, None, f"{type(e).__name__}: {e}"[:500]))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.string()) for i in range(7)], names=names)

    dealt = known.select("tier", "source", "subject", F.col("payload").cast("string").alias("payload")).repartition("tier", "source", "subject")
    got = stored(dealt.mapInArrow(run, schema), "answers")
    n = F.count("metric")
    failed = F.count("error")
    status = F.when(failed == 0, "ok").when(n > 0, "partly failed").otherwise("error")
    log = got.groupBy("tier", "source").agg(F.countDistinct("subject").alias("n_requests"), n.alias("n_rows"), failed.alias("n_failed"), status.alias("status"), F.min("error").alias("error"))
    return got.where(F.col("metric").isNotNull()).drop("error"), log


def explore(sources: DataFrame, curated: DataFrame, found: DataFrame, places: DataFrame, subject: str, place: str, flags: dict[str, bool], metrics: list[str], most_dives: int = 100, answers: DataFrame | None = None) -> DataFrame:
    """part, id, metric, value, source_citation, tier, url, notes: curated rows, then links, then what connectors answered.

    sources: id, name, tier, kind, url, metric, priority, places, connector, enabled_when; curated: metric, value, source_citation, tier. Links that are
    enabled and for the place come with a stub as value, under their own metric if it is one of metrics, else as `<id>_links`.
    The first `most_dives` by priority and id are looked into, unless a curated row has their metric: their value is what found (url, summary) has for their
    page. answers: id, metric, value, notes of connectors. The plan is one union; only the first links' ids are cut off, by a top-k.
    """
    open_ = E.enabled(sources, flags, [])
    links = E.catalogue_links(open_, places, subject, place)
    named = links.withColumn("metric", F.when(F.lower("metric").isin(metrics), F.col("metric")).otherwise(F.concat(F.col("id").cast("string"), F.lit("_links"))))
    taken = curated.select("metric").distinct().withColumn("_curated", F.lit(True))
    first = named.orderBy("priority", "id").limit(most_dives).select("id", F.lit(True).alias("_first"))
    pages = found.groupBy("url").agg(F.min("summary").alias("_summary"))
    joined = named.join(taken, "metric", "left").join(first, "id", "left").join(pages, "url", "left")
    dives = F.col("_first").isNotNull() & F.col("_curated").isNull()
    value = F.coalesce(F.when(dives, X.blank_to_null("_summary")), F.lit(STUB))
    notes = F.when(F.col("_curated").isNotNull(), "curated value available").when(~dives, "not looked into").when(value != STUB, "value extracted").otherwise("no datapoints found")
    columns = lambda part, key, url, note: [F.lit(part).alias("part"), key.cast("string").alias("id"), "metric", "value", "source_citation", "tier", url.alias("url"), note.alias("notes")]
    null = F.lit(None).cast("string")
    out = curated.select(*columns("curated", null, null, null)).unionByName(joined.withColumn("value", value).withColumn("source_citation", F.col("name")).select(*columns("link", F.col("id"), F.col("url"), notes)))
    if answers is None:
        return out
    api = E.enabled(sources, flags, [r[0] for r in answers.select("connector").distinct().limit(1000).collect()]).where(F.col("kind") == "api")
    got = api.select("id", "name", "tier", "connector").join(answers, "connector").withColumn("source_citation", F.col("name"))
    return out.unionByName(got.select(*columns("answer", F.col("id"), null, F.col("notes"))))
