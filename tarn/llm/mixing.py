"""Mixing sources to target weights by entropy balancing.

Among all non-negative document rates that meet the token target of each source and repeat no document more than ``most``
times, the one nearest to "every document once" in relative entropy tilts exponentially with the document's size:
rate = min(most, exp(tilt * size / mean size of the source)). The tilts solve the convex dual, by safeguarded Newton
steps for all sources at once. Documents of a source that have the same size share their rate, so every step reads one row
per (source, size). Rates are rounded to copies from the largest size down, carrying the words still owed on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.session import store

from .common import WORD, positions

WEIGHTS = (5, 2, 1)
SHARE, MOST = 1.5, 2
STEPS = 200


def targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``sources`` (source, source_size; one row each) with ``target``: ``share`` of all sizes dealt by weight.

    Weights repeat over the sources by code point, null last. A target stops at ``most`` times its source's size; the excess
    is dealt to the others by weight, until none is above.
    """
    placed = positions(sources, F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod("at", F.lit(len(weights))) + 1).cast("int"))
    rows = store(placed.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * float(most)).alias("cap")))
    level, before = 0.0, -1
    while True:
        full = F.col("cap") <= F.col("weight") * F.lit(level)
        s = rows.agg(F.count(F.when(full, 1)).alias("full"), F.sum(F.when(full, F.col("cap")).otherwise(0.0)).alias("given"),
                     F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("open"), F.sum("source_size").alias("all")).first()
        if s.full == before or not s.open:
            break
        before = s.full
        level = (share * s["all"] - s.given) / s.open
    return rows.withColumn("target", F.least("cap", F.col("weight") * F.lit(level)))


def tilts(groups: DataFrame, goals: DataFrame, most: float = MOST, tolerance: float = 1e-9, steps: int = STEPS) -> DataFrame:
    """``groups`` (source, size, n, start) with ``rate``, the copies wanted of each document.

    Raises if a source has not come within ``tolerance`` of its target after ``steps`` steps.
    """
    means = groups.filter("size > 0").groupBy("source").agg(
        (F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean"), F.min("size").alias("least"))
    goals = goals.join(means, goals["source"].eqNullSafe(means["source"]), "left").drop(means["source"])
    cells = store(groups.join(goals, groups["source"].eqNullSafe(goals["source"])).drop(goals["source"])
                  .withColumn("z", F.col("size") / F.col("mean")))
    top = F.log(F.lit(float(most))) * F.col("mean") / F.col("least")  # every document is repeated ``most`` times from here on
    # a full source needs no search: the cap decides all its rates
    state = store(goals.select("source", "target", (F.col("target") >= F.col("cap")).alias("done"),
                               F.when(F.col("target") >= F.col("cap"), F.lit(float("inf"))).otherwise(F.lit(0.0)).alias("tilt"),
                               F.lit(float("-inf")).alias("low"), top.alias("high")))
    for _ in range(steps):
        if state.filter("NOT done").isEmpty():
            break
        tilt = state.filter("NOT done").select(F.col("source").alias("of"), "tilt")
        rate = F.exp(F.col("tilt") * F.col("z"))
        words = F.col("n") * F.col("size")
        sums = (cells.filter("size > 0").join(tilt, F.col("source").eqNullSafe(F.col("of"))).groupBy("of")
                .agg(F.sum(words * F.least(rate, F.lit(float(most)))).alias("given"),
                     F.sum(F.when(rate < most, words * F.col("z") * rate).otherwise(0.0)).alias("slope")))
        over = F.col("given") - F.col("target")
        low, high = F.when(over < 0, F.col("tilt")).otherwise(F.col("low")), F.when(over > 0, F.col("tilt")).otherwise(F.col("high"))
        newton = F.col("tilt") - F.col("over") / F.col("slope")
        middle = F.when(F.col("low") == float("-inf"), F.least(F.col("high") * 2, F.col("high") - 1)).otherwise((F.col("low") + F.col("high")) / 2)
        stepped = state.join(sums, F.col("source").eqNullSafe(F.col("of")), "left").withColumns({"over": over, "low": low, "high": high})
        met = F.col("done") | F.col("over").isNull() | (F.abs("over") <= tolerance * F.greatest("target", F.lit(1.0)))
        inside = (F.col("slope") > 0) & (newton > F.col("low")) & (newton < F.col("high"))
        state = store(stepped.select("source", "target", met.alias("done"),
                                     F.when(met, F.col("tilt")).when(inside, newton).otherwise(middle).alias("tilt"), "low", "high"))
    else:
        raise RuntimeError(f"no balance after {steps} steps")
    found = state.select(F.col("source").alias("of"), "tilt")
    rate = F.when(F.col("size") == 0, 0.0).when(F.col("tilt") == float("inf"), float(most)).otherwise(F.least(F.exp(F.col("tilt") * F.col("z")), F.lit(float(most))))
    return cells.join(found, F.col("source").eqNullSafe(F.col("of"))).select("source", "size", "n", "start", "source_size", "target", rate.alias("rate"))


def copies(rated: DataFrame, most: int = MOST) -> DataFrame:
    """``rated`` with ``m``: the copies that the documents of each (source, size) take together.

    One task walks the sizes of a source, largest first, and gives each size the copies that bring the words taken nearest to
    those owed. It sees one row per different size: a source of w words has fewer than sqrt(2 w) of them, however many
    documents it has.
    """

    def walk(frame):
        frame = frame.sort_values("size", ascending=False, ignore_index=True)
        owed, taken, out = 0.0, 0, []
        for size, n, rate in zip(frame["size"].tolist(), frame["n"].tolist(), frame["rate"].tolist(), strict=True):
            owed += n * rate * size
            m = min(max(round((owed - taken) / size), 0), most * n) if size else 0
            taken += m * size
            out.append(m)
        return frame.assign(m=out)

    return rated.groupBy("source").applyInPandas(walk, "source string, size long, n long, start long, source_size long, target double, rate double, m long")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights=WEIGHTS, share: float = SHARE, most: int = MOST, key_col: str | None = None) -> DataFrame:
    """What the mix takes of every row: doc_id, size, source_size, target, copies, taken (= copies * size).

    A text's size is its number of words; null, empty and blank texts have size 0 and are not taken. A null source is a source. Rows
    that repeat an id each count. Documents of one source and size are dealt their copies by id, evenly; of equal ids, in
    any order, or in that of ``key_col``, a column to hand on as well. Other columns are ignored. An empty table gives an empty result; if all sizes are 0, all targets are.
    """
    sized = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{source_col}`").alias("source"),
                        F.coalesce(F.regexp_count(F.col(f"`{text_col}`"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
                        *([F.col(f"`{key_col}`").alias("key")] if key_col else []))
    key = sized.columns[3:]
    placed = store(positions(sized, F.col("source").asc_nulls_last(), F.col("size").desc(), F.col("doc_id").asc(), *key))
    groups = store(placed.groupBy("source", "size").agg(F.count("*").alias("n"), F.min("at").alias("start")))
    sources = groups.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    goals = store(targets(sources, weights, share, most))
    dealt = store(copies(tilts(groups, goals, most), most)).withColumnsRenamed({"source": "source_", "size": "size_"})
    rank, n, m = F.col("at") - F.col("start"), F.col("n"), F.col("m")
    upto = lambda r: F.call_function("div", r * m, n)
    own = upto(rank + 1) - upto(rank)
    joined = placed.join(dealt, F.col("source").eqNullSafe(F.col("source_")) & (F.col("size") == F.col("size_")))
    return joined.select("doc_id", "size", "source_size", "target", own.alias("copies"), (own * F.col("size")).alias("taken"), *[F.col(c).alias(key_col) for c in key])
