"""Scans and sinks: instrument CSV folders, sheets, metadata, community tables, hand-off tables."""

from __future__ import annotations

import csv
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LATIN1 = "ISO-8859-1"
MAX_HEADERS = 10_000


def union_by_name(frames: list[DataFrame]) -> DataFrame:
    """Stack tables by column name; a column one table lacks is NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def _files_by_header(spark: SparkSession, path: str, encoding: str) -> dict[str, list[str]]:
    """Distinct header line -> files having it; only file names and header lines reach the driver."""
    lines = spark.read.option("encoding", encoding).text(path)
    # a file's first split is read in order within one partition, so the smallest row number is its first line
    first = (
        lines.select("value", "_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("at"))
        .filter(F.col("file_block_start") == 0)
        .groupBy("file_path")
        .agg(F.min_by("value", "at").alias("header"))
    )
    grouped = first.groupBy("header").agg(F.collect_list("file_path").alias("files"))
    rows = grouped.limit(MAX_HEADERS + 1).collect()
    if len(rows) > MAX_HEADERS:
        raise ValueError("too many different header lines; the folder does not hold one kind of sheet")
    return {r["header"]: r["files"] for r in rows}


def scan_csv_dir(
    spark: SparkSession, path: str, glob: str = "*.csv", encoding: str = LATIN1, uniform: bool = False,
    lineage: bool = False,
) -> DataFrame:
    """Every CSV of a folder as text columns, stacked by column name.

    Files with the same header are one scan. ``uniform=True`` promises a single header and saves the
    header pass. ``lineage`` adds the ``source_file`` column.
    """
    where = f"{path.rstrip('/')}/{glob}"
    groups = {None: [where]} if uniform else _files_by_header(spark, where, encoding)

    def read(header, files):
        reader = spark.read.option("header", True).option("encoding", encoding).option("inferSchema", False)
        if header is not None:
            names = next(csv.reader([header]))
            reader = reader.schema(", ".join(f"`{n.strip()}` STRING" for n in names))
        out = reader.csv(files)
        return out.withColumn("source_file", F.col("_metadata.file_path")) if lineage else out

    return union_by_name([read(h, f) for h, f in sorted(groups.items(), key=lambda g: g[0] or "")])


def scan_csv(spark: SparkSession, path: str, schema=None, encoding: str = LATIN1) -> DataFrame:
    """One sheet; without a schema the types are inferred (an extra pass)."""
    reader = spark.read.option("header", True).option("encoding", encoding)
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    out = reader.csv(path)
    return out.drop(*[c for c in ("X1", "_c0") if c in out.columns])


def scan_tsv(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """Tab-separated sample metadata."""
    reader = spark.read.option("header", True).option("sep", "\t")
    return (reader.schema(schema) if schema is not None else reader.option("inferSchema", True)).csv(path)


def sink_csv(df: DataFrame, path: str, sort_keys: list[str] | None = None) -> str:
    """Write with a header and without an index column; sorted by key where asked."""
    out = df.orderBy(*sort_keys) if sort_keys else df
    out.write.mode("errorifexists").option("header", True).csv(path)
    return path


def sink_tsv(df: DataFrame, path: str) -> str:
    df.write.mode("errorifexists").option("header", True).option("sep", "\t").csv(path)
    return path


def hand_off(df: DataFrame, path: str) -> DataFrame:
    """Persist a stage's table as parquet and read it back; also cuts the lineage."""
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def literal_set(spark: SparkSession, name: str, values) -> DataFrame:
    """An in-code list as a one-column table, for semi and anti joins with long lists."""
    return spark.createDataFrame([(v,) for v in values], f"{name} string")
