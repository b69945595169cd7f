"""Exact deduplication by skew-safe combining.

Every task first combines its own equal texts, then the survivors meet per (digest, salt), then the winners of the
salts meet per digest. The whole text is part of the grouping key each time, so two texts count as equal only if their
full contents are, whatever their digests. A text that makes up a third of the corpus reaches the second stage once per
task and the third at most ``salts`` times.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarn.session import store

from .common import ascii_lower, cache_of, keyed, one_of_each


def _normalised(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, norm): texts with A-Z lower-cased, null as empty."""
    import pyarrow as pa

    def lower(batches):
        cache_of("exact_dedup")
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), ascii_lower(b.column(1))], ["doc_id", "norm"])

    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("norm"))
    return rows.mapInArrow(lower, T.StructType([T.StructField("doc_id", rows.schema[0].dataType), T.StructField("norm", T.StringType())]))


def _combined(keyed: DataFrame, salts: int) -> DataFrame:
    """One row per different text: digest, norm, keep_id, group_size."""
    salted = keyed.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
    winners = salted.groupBy("digest", "salt", "norm").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    return winners.repartition("digest").groupBy("digest", "norm").agg(
        F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16, digest=None) -> DataFrame:
    """Every row of ``docs`` with its group of equal texts: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as empty, and empty texts form a group as any
    other. The row with the largest id stays. Rows that repeat an id and its text are rows of the same group and are all
    listed; those with the largest id are all marked as kept. A null id is smaller than any other; if a group has
    only null ids, keep_id is null and its rows are kept. Other columns are ignored, whatever their names. An empty
    table gives an empty result. ``digest`` (a function of the text column, by default SHA-256) only deals out the texts.
    """
    digest = digest or (lambda c: F.sha2(c, 256))
    keyed = _normalised(docs, id_col, text_col).withColumn("digest", digest(F.col("norm")))
    per_digest = _combined(keyed, salts).groupBy("digest").agg(
        F.count("*").alias("texts"), F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    shared = store(per_digest.filter("group_size > 1"))

    own = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    sha = F.sha2("norm", 256).alias("text_sha256")
    rows = keyed.select("doc_id", "digest", sha)
    found = rows.join(shared, "digest", "left").select(
        "doc_id", "text_sha256", "texts",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"))
    result = found.select("doc_id", "keep_id", "group_size", own.alias("kept"), "text_sha256", "texts")
    collided = shared.filter("texts > 1").select("digest")
    if not collided.isEmpty():  # different texts under one digest: these few are told apart by their contents
        part = keyed.join(collided, "digest", "left_semi")
        apart = part.join(store(_combined(part, salts)), ["digest", "norm"]).select(
            "doc_id", "keep_id", "group_size", own.alias("kept"), sha, F.lit(2).cast("long").alias("texts"))
        result = result.filter("texts IS NULL OR texts = 1").unionByName(apart)
    return result.drop("texts")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of equal texts, with all its columns.

    It is the row with the largest id, null being smaller than any other; of rows with equal ids, any. Rows are told apart by
    themselves, not by their ids: of a repeated id's rows with different texts, each belongs to its own group.
    """
    rows, key = keyed(docs)
    groups = exact_groups(rows, key, text_col).filter("group_size > 1").select(F.col("doc_id").alias(key), F.col("keep_id").alias("group"))
    return one_of_each(rows, key, id_col, groups, largest=True)
