"""Metric names for free labels: synonyms, else vector similarity, else a slug."""

from __future__ import annotations


from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import exprs as X


def synonyms_dim(spark: SparkSession, synonyms: dict[str, list[str]]) -> DataFrame:
    rows = [(m, s, i) for i, (m, s) in enumerate((m, s) for m, ss in synonyms.items() for s in ss)]
    return spark.createDataFrame(rows, "metric_id string, synonym string, _pos int")


def match_synonyms(labels: DataFrame, column: str, synonyms: dict[str, list[str]], threshold: float = 0.5) -> DataFrame:
    """label, metric_id, score, how of the distinct labels.

    An exact synonym scores 0.95, one within the label 0.75 plus 0.15 times its share of the label, a label within a
    synonym 0.65; the first best in the dictionary's order counts. Blank labels are unknown, unmatched ones a slug.
    The dictionary is settings, not data: it is a literal array in the expression, so labels are matched without a join.
    """
    entries = [(m, s) for m, ss in synonyms.items() for s in ss]
    dictionary = F.array(*[F.struct(F.lit(m).alias("m"), F.lit(s).alias("s"), F.lit(-i).alias("p")) for i, (m, s) in enumerate(entries)])
    distinct = labels.select(F.col(column).alias("label")).distinct().withColumn("_l", X.key("label"))
    score = lambda e: (
        F.when(F.col("_l") == e["s"], F.lit(0.95)).when(F.contains(F.col("_l"), e["s"]), 0.75 + 0.15 * F.length(e["s"]) / F.length("_l")).when(F.contains(e["s"], F.col("_l")), F.lit(0.65)).otherwise(F.lit(0.0))
    )
    best = F.array_max(F.transform(dictionary, lambda e: F.struct(score(e).alias("score"), e["p"].alias("p"), e["m"].alias("m"))))
    found = distinct.withColumn("_b", best)
    blank, hit = F.coalesce(F.col("_l") == "", F.lit(True)), F.col("_b.score") >= threshold
    return found.select(
        "label", F.when(blank, "unknown").when(hit, F.col("_b.m")).otherwise(X.slug("label")).alias("metric_id"), F.when(blank, 0.0).when(hit, F.round("_b.score", 4)).otherwise(0.0).alias("score"),
        F.when(blank, "blank").when(hit, "synonym").otherwise("slug").alias("how"),
    )


def match_labels(labels: DataFrame, column: str, vector: str, synonyms: dict[str, list[str]], protos: DataFrame, name: str = "label", threshold: float = 0.5, near: float = 0.6) -> DataFrame:
    """label, metric_id, score, how: by synonyms; else by the nearest prototype, `vector` from a cosine of near on and `weak vector` under it; else a slug.

    labels: one row for each label, with its vector (null: none). Only labels that no synonym matches are compared.
    """
    found = match_synonyms(labels, column, synonyms, threshold)
    rest = labels.select(F.col(column).alias("label"), F.col(vector).alias("_vector")).join(found.where(F.col("how") == "slug").select("label"), "label", "left_semi")
    by_vector = match_vectors(rest, protos, "label", "_vector", name).select("label", F.col("matched").cast("string").alias("_id"), F.col("score").alias("_score"))
    both = found.join(by_vector, "label", "left")
    hit = F.coalesce(F.col("_score") > 0, F.lit(False))
    how = F.when(hit & (F.col("_score") >= near), "vector").when(hit, "weak vector").otherwise(F.col("how"))
    return both.select("label", F.when(hit, F.col("_id")).otherwise(F.col("metric_id")).alias("metric_id"), F.when(hit, F.col("_score")).otherwise(F.col("score")).alias("score"), how.alias("how"))


def explain(matches: DataFrame, synonyms: dict[str, list[str]]) -> DataFrame:
    """Adds explanation to match_synonyms(): the name, its score, how it was found, and the first two synonyms that the label meets."""
    dictionary = F.array(*[F.struct(F.lit(m).alias("m"), F.lit(s).alias("s")) for m, ss in synonyms.items() for s in ss])
    label = X.key("label")
    met = F.filter(dictionary, lambda e: (e["m"] == F.col("metric_id")) & (F.contains(label, e["s"]) | F.contains(e["s"], label)))
    via = F.array_join(F.transform(F.slice(met, 1, 2), lambda e: e["s"]), ", ")
    return matches.withColumn("explanation", F.concat(F.col("label"), F.lit(" -> "), F.col("metric_id"), F.lit(" (score "), F.format_number("score", 2), F.lit(", "), F.col("how"), F.when(via != "", F.concat(F.lit(", via "), via)).otherwise(""), F.lit(")")))


def prototypes(vectors: DataFrame, label: str = "label", vector: str = "embedding") -> DataFrame:
    """The mean vector of each label: one row for each label and dimension on the way, one for each label in the end."""
    each = vectors.select(label, F.posexplode(vector).alias("i", "x")).groupBy(label, "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return each.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("proto"))


def match_vectors(vectors: DataFrame, protos: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", most_labels: int = 100_000) -> DataFrame:
    """key, matched, score: the label whose vector has the highest cosine; ties go to the least label.

    Labels are a stated set; their number is checked before their vectors are broadcast. A batch of rows is compared
    with all labels by one matrix product.
    """
    rows = protos.select(label, "proto").orderBy(label).limit(most_labels + 1).collect()
    if len(rows) > most_labels:
        raise ValueError(f"match_vectors() compares with {most_labels} labels at most")
    label_type = to_arrow_schema(protos.select(label).schema)[0].type
    shared = vectors.sparkSession.sparkContext.broadcast(([r[0] for r in rows], np.array([r[1] for r in rows], np.float64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, table = shared.value
        table = table / np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1e-300)
        for batch in batches:
            v = np.array(batch.column(1).to_pylist(), np.float64)
            cosine = np.round(v @ table.T / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300), 6)
            best = cosine.argmax(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([names[i] for i in best], label_type), pa.array(cosine.max(axis=1))], names=[key, "matched", "score"])

    kinds = dict(vectors.dtypes)
    found = vectors.where(F.col(vector).isNotNull()).select(key, vector).mapInArrow(run, f"{key} {kinds[key]}, matched {dict(protos.dtypes)[label]}, score double")
    return found.withColumn("score", F.round("score", 4))
