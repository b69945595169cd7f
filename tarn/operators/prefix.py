"""Places and running sums within groups of any size."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def running(rows: DataFrame, value: str, group: str, key: str) -> DataFrame:
    """``rows`` with their 0-based place ``at`` in their group and the sum ``before`` of the values before them there.

    The order within a group is any, but always the same. A group is dealt out by the hash of ``key`` (unique in a group), in about as
    many parts as a part has rows; the parts' sums are added up by themselves, so no task sees a whole large group.
    """
    parts = math.isqrt(rows.count()) + 1
    dealt = rows.withColumn("part_", F.pmod(F.xxhash64(key), F.lit(parts)).cast("int"))
    sums = dealt.groupBy(group, "part_").agg(F.count("*").alias("n_"), F.sum(value).alias("s_"))
    so_far = Window.partitionBy(group).orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(group, "part_", *[F.coalesce(F.sum(c).over(so_far), F.lit(0)).alias(c) for c in ("n_", "s_")])
    own = Window.partitionBy(group, "part_").orderBy(key)
    upto = own.rowsBetween(Window.unboundedPreceding, 0)
    inside = dealt.withColumns({"at": F.row_number().over(own) - 1, "before": F.sum(value).over(upto) - F.col(value)})
    return (inside.join(sums, [group, "part_"])
            .withColumns({"at": F.col("at") + F.col("n_"), "before": F.col("before") + F.col("s_")}).drop("part_", "n_", "s_"))
