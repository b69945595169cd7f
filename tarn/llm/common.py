"""Helpers that the corpus operators share."""

from __future__ import annotations

import ctypes
import gc

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.session import store

#: Keys of 8 bytes that are broadcast; more are joined by shuffling.
KEYS = 500_000
#: White space between words; everything else belongs to a word.
WORD = r"[^\x20\x09-\x0D]+"


_CACHES: dict[str, dict] = {}


def release() -> None:
    """Hand memory that this worker has freed back to the system: allocators keep it otherwise, for as long as the worker is reused."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def cache_of(kind: str) -> dict:
    """What tasks of one kind keep in a reused worker for the next one; a task of another kind drops it.

    Every Python task of these operators asks for its kind's cache as it starts, so a worker holds the tables of one operator only.
    """
    if kind not in _CACHES:
        _CACHES.clear()
        gc.collect()
        release()
    return _CACHES.setdefault(kind, {})


def without(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """``rows`` without those whose ``key`` is in ``gone`` (stored). Few keys are broadcast, so that whole rows stay where they are."""
    return rows.join(F.broadcast(gone) if gone.count() <= KEYS else gone, key, "left_anti")


def ascii_lower(texts):
    """Lower-case A-Z and nothing else, for an Arrow string array."""
    import pyarrow.compute as pc

    return pc.ascii_lower(pc.fill_null(texts, ""))


def positions(df: DataFrame, *order: Column) -> DataFrame:
    """``df`` with the 0-based place ``at`` of every row in the total order, stored.

    A range sort places the rows; only one count per partition reaches the driver, so no task sees more than its range.
    Rows equal in all of ``order`` take neighbouring places in any order.
    """
    df = store(df)  # the range bounds are sampled first: without this, the rows would be worked out twice
    placed = store(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33)
    start, starts = 0, []
    for row in placed.groupBy(part.alias("p")).agg(F.count("*").alias("n")).orderBy("p").collect():
        starts.append((row.p, start - (row.p << 33)))
        start += row.n
    if not starts:
        return placed
    shift = df.sparkSession.createDataFrame(starts, "part_ int, shift_ long")
    return (placed.withColumn("part_", part.cast("int")).join(F.broadcast(shift), "part_")
            .withColumn("at", F.col("at") + F.col("shift_")).drop("part_", "shift_"))


def keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a number of its own for every row, and the name of that column, which no other column has.

    A table read from files is not copied: its rows are numbered by file and place there. Anything else is stored.
    """
    key = "row_"
    while key in map(str.lower, docs.columns):
        key += "_"
    return _in_place(docs, key) or store(docs.withColumn(key, F.monotonically_increasing_id())), key


def _in_place(docs: DataFrame, key: str) -> DataFrame | None:
    """``docs`` numbered by file and place, if it is a plain read of files that tell these, and of no file twice."""
    path = F.col("_metadata.file_path")
    if "_metadata" in map(str.lower, docs.columns) or not docs._jdf.queryExecution().analyzed().children().isEmpty():
        return None
    try:
        files = docs.select(path.alias(f"{key}path")).distinct()
        placed = docs.select("*", path.alias(f"{key}path"), F.col("_metadata.row_index").alias(f"{key}at"))
    except AnalysisException:
        return None
    files = store(files.coalesce(1).withColumn(key, F.monotonically_increasing_id()))
    rows = placed.join(F.broadcast(files), f"{key}path").withColumn(key, F.shiftleft(key, 40) + F.col(f"{key}at")).drop(f"{key}path", f"{key}at")
    return rows if rows.groupBy(key).count().filter("count > 1").isEmpty() else None


def one_of_each(rows: DataFrame, key: str, id_col: str, groups: DataFrame, largest: bool) -> DataFrame:
    """``rows`` without ``key``, and of each group (``groups``: key, group; rows without one stay) only one row.

    That is the row with the largest id, null being smaller than any other, or with the smallest, null being larger.
    """
    ids = groups.join(rows.select(key, F.col(f"`{id_col}`").alias("id")), key)
    best = F.max_by(key, F.struct("id", key)) if largest else F.min_by(key, F.struct(F.isnull("id"), "id", key))
    chosen = ids.groupBy("group").agg(best.alias(key)).select(key)
    gone = store(groups.select(key).join(chosen, key, "left_anti"))
    return without(rows, gone, key).drop(key)


def block_edges(rows: DataFrame, block_bytes: int) -> np.ndarray:
    """Ids that cut ``rows`` (doc_id, text) into ranges of about ``block_bytes``; only these reach the driver.

    Ids below the first edge are range 0; an edge belongs to the range that it begins.
    """
    total = rows.agg(F.sum(F.octet_length("text") + 100).alias("b")).first().b or 0
    n = int(total // block_bytes) + 1
    if n == 1:
        return np.zeros(0, dtype=np.int64)
    cuts = rows.agg(F.percentile_approx("doc_id", [k / n for k in range(1, n)], 20 * n).alias("q")).first().q
    return np.array(sorted(set(cuts or [])), dtype=np.int64)
