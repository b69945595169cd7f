"""Feature counts with taxonomy, tree and sample data: alignment, filters, sums, diversity.

Counts are long, ``(feature_id, sample_id, count)``; an absent cell is a zero. Every "share of the
samples" therefore divides by the number of samples and never by the number of rows. Sums per
feature and per sample are partial before they shuffle, so a sample or feature that owns a third of
the cells costs no more than another.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.compat import join_on
from ..session import cut_lineage
from .order_stats import positions

CELL = ["feature_id", "sample_id", "count"]


@dataclass(frozen=True)
class Community:
    """Four aligned tables: counts, taxonomy by ``feature_id``, tree edges, sample data by ``sample_id``."""

    counts: DataFrame
    taxonomy: DataFrame
    tree: DataFrame
    samples: DataFrame

    def with_counts(self, counts: DataFrame) -> "Community":
        return replace(self, counts=counts)


def load_community(spark: SparkSession, path: str) -> Community:
    """Read the four exported tables below ``path`` and align them."""
    read = lambda name: spark.read.parquet(f"{path.rstrip('/')}/{name}")
    return align(Community(read("counts"), read("taxonomy"), read("tree"), read("samples")))


def store_community(c: Community, path: str) -> str:
    for name in ("counts", "taxonomy", "tree", "samples"):
        getattr(c, name).write.mode("errorifexists").parquet(f"{path.rstrip('/')}/{name}")
    return path


def align(c: Community) -> Community:
    """Keep features that counts, taxonomy and tree share, and samples that counts and sample data share."""
    tips = c.tree.filter("is_tip").select(F.col("node").alias("feature_id"))
    counts = (
        c.counts.join(c.taxonomy.select("feature_id"), "feature_id", "left_semi")
        .join(tips, "feature_id", "left_semi")
        .join(c.samples.select("sample_id"), "sample_id", "left_semi")
        .select(*CELL)
    )
    taxonomy = c.taxonomy.join(counts.select("feature_id"), "feature_id", "left_semi")
    samples = c.samples.join(counts.select("sample_id"), "sample_id", "left_semi")
    return Community(counts, taxonomy, c.tree, samples)


def wide_to_long(wide: DataFrame, key: str = "feature_id") -> DataFrame:
    """A matrix with features as rows and samples as columns, as long cells without the zeros."""
    samples = [c for c in wide.columns if c != key]
    long = wide.unpivot(key, samples, "sample_id", "count")
    return long.filter(F.col("count") != 0).select(F.col(key).alias("feature_id"), "sample_id", "count")


def rank_names(taxonomy: DataFrame) -> list[str]:
    return [c for c in taxonomy.columns if c != "feature_id"]


def n_samples(counts: DataFrame) -> int:
    return counts.agg(F.count_distinct("sample_id")).first()[0]


# --- sums ---------------------------------------------------------------------------------------


def sum_by_feature(counts: DataFrame) -> DataFrame:
    return counts.groupBy("feature_id").agg(F.sum("count").alias("total"))


def sum_by_sample(counts: DataFrame) -> DataFrame:
    return counts.groupBy("sample_id").agg(F.sum("count").alias("total"))


def prevalence(counts: DataFrame, taxonomy: DataFrame | None = None) -> DataFrame:
    """Samples a feature occurs in and its total, with its taxonomy when given."""
    out = counts.groupBy("feature_id").agg(
        F.count_if(F.col("count") > 0).alias("Prevalence"), F.sum("count").alias("TotalAbundance")
    )
    return out.join(taxonomy, "feature_id", "left") if taxonomy is not None else out


def prevalence_by(prev: DataFrame, rank: str = "Phylum") -> DataFrame:
    return prev.groupBy(rank).agg(F.avg("Prevalence").alias("mean_prevalence"), F.sum("Prevalence").alias("sum_prevalence"))


def sum_by_group(counts: DataFrame, taxonomy: DataFrame, rank: str) -> DataFrame:
    """Total per group of a rank; features without that rank are skipped."""
    per_feature = sum_by_feature(counts)
    named = taxonomy.filter(F.col(rank).isNotNull()).select("feature_id", rank)
    return per_feature.join(named, "feature_id").groupBy(rank).agg(F.sum("total").alias("total"))


def abundance_by(counts: DataFrame, taxonomy: DataFrame, rank: str, samples: DataFrame | None = None, label: str = "sample_id") -> DataFrame:
    """Summed abundance per sample label and group of a rank (stacked-bar data)."""
    out = counts.join(taxonomy.select("feature_id", rank), "feature_id", "left")
    if samples is not None:
        out = out.join(samples.select("sample_id", label).distinct(), "sample_id", "left")
    return out.groupBy(label, rank).agg(F.sum("count").alias("abundance"))


def agglomerate(c: Community, rank: str = "Genus", drop_null: bool = True) -> Community:
    """Sum the features that share the whole lineage down to ``rank``.

    The merged feature carries the name of its most abundant member (ties: the smaller name).
    """
    names = rank_names(c.taxonomy)
    lineage = names[: names.index(rank) + 1]
    taxonomy = c.taxonomy.filter(F.col(rank).isNotNull()) if drop_null else c.taxonomy
    totals = taxonomy.join(sum_by_feature(c.counts), "feature_id")
    heads = totals.groupBy(*lineage).agg(
        F.min(F.struct((-F.col("total")).alias("t"), F.col("feature_id").alias("f")))["f"].alias("head"),
    )
    member = join_on(taxonomy.select("feature_id", *lineage), heads, lineage, "inner").select("feature_id", "head")
    counts = (
        c.counts.join(member, "feature_id")
        .groupBy(F.col("head").alias("feature_id"), "sample_id")
        .agg(F.sum("count").alias("count"))
    )
    kept = heads.select(F.col("head").alias("feature_id"), *lineage, *[F.lit(None).cast("string").alias(r) for r in names if r not in lineage])
    return Community(counts, kept, c.tree, c.samples)


def melt(c: Community) -> DataFrame:
    """One row per cell with the feature's taxonomy and the sample's data."""
    out = c.counts.withColumnRenamed("count", "Abundance")
    return out.join(c.taxonomy, "feature_id").join(c.samples, "sample_id")


# --- filters ------------------------------------------------------------------------------------


def keep_features(counts: DataFrame, keep: DataFrame) -> DataFrame:
    return counts.join(keep.select("feature_id"), "feature_id", "left_semi").select(*CELL)


def keep_samples(counts: DataFrame, keep: DataFrame) -> DataFrame:
    return counts.join(keep.select("sample_id"), "sample_id", "left_semi").select(*CELL)


def drop_samples(counts: DataFrame, drop: DataFrame) -> DataFrame:
    return counts.join(drop.select("sample_id"), "sample_id", "left_anti").select(*CELL)


def features_where(counts: DataFrame, predicate: Column) -> DataFrame:
    """Features for which an aggregate over their cells holds."""
    return counts.groupBy("feature_id").agg(predicate.alias("__keep")).filter("__keep").select("feature_id")


def filter_features(counts: DataFrame, min_count: float = 3, min_frac: float = 0.5, total_samples: int | None = None) -> DataFrame:
    """Features counted more than ``min_count`` times in more than ``min_frac`` of the samples."""
    n = n_samples(counts) if total_samples is None else total_samples
    return keep_features(counts, features_where(counts, F.count_if(F.col("count") > min_count) > min_frac * n))


def filter_features_by_total(counts: DataFrame, min_sum: float) -> DataFrame:
    return keep_features(counts, features_where(counts, F.sum("count") > min_sum))


def filter_prevalence(counts: DataFrame, frac: float = 0.05, allowed: DataFrame | None = None, total_samples: int | None = None) -> DataFrame:
    """Features present in at least ``frac`` of the samples, among the allowed features."""
    n = n_samples(counts) if total_samples is None else total_samples
    src = keep_features(counts, allowed) if allowed is not None else counts
    return keep_features(src, features_where(src, F.count_if(F.col("count") > 0) >= frac * n))


def filter_top_fraction(
    counts: DataFrame, p: float = 0.1, min_samples: float | None = None,
    total_samples: int | None = None, total_features: int | None = None,
) -> DataFrame:
    """Features among the top ``p`` of a sample's features in at least ``min_samples`` samples (default half).

    A sample's cut is its ceil(features * p)-th largest count, where absent features count as zero and
    values equal to the cut are in. Features of the table are those with a cell in it.
    """
    if total_features is None:
        total_features = counts.agg(F.count_distinct("feature_id")).first()[0]
    n = n_samples(counts) if total_samples is None else total_samples
    need = n / 2 if min_samples is None else min_samples
    k = math.ceil(total_features * p - 1e-9)
    present = counts.filter(F.col("count") > 0)
    # position from the top of the last cell of each distinct value
    pos = positions(present, "count", ["sample_id"]).withColumn("from_top", F.col("n") - F.col("lo") - F.col("cnt") + 2)
    reached = pos.filter((F.col("n") >= k) & (F.col("from_top") <= k))
    cut = cut_lineage(reached.groupBy(F.col("sample_id").alias("__s")).agg(F.min("count").alias("__cut")))
    # a sample with fewer than k present features has a cut of zero, which every feature meets
    at_zero = n - cut.count()
    if at_zero >= need:
        return counts.select(*CELL)
    inside = present.join(cut, (F.col("sample_id") == F.col("__s")) & (F.col("count") >= F.col("__cut")))
    hits = inside.groupBy("feature_id").agg(F.count(F.lit(1)).alias("hits"))
    return keep_features(counts, hits.filter(F.col("hits") + at_zero >= need))


def rank_in_sample(counts: DataFrame) -> DataFrame:
    """Cells with the number of larger counts in their sample, plus one (ties share it)."""
    pos = positions(counts, "count", ["sample_id"]).select(
        F.col("sample_id").alias("__s"), F.col("count").alias("__c"),
        (F.col("n") - F.col("lo") - F.col("cnt") + 2).alias("rank"))
    same = (F.col("sample_id") == F.col("__s")) & (F.col("count") == F.col("__c"))
    return counts.join(pos, same).select(*CELL, "rank")


def subset_taxa(c: Community, predicate: Column) -> Community:
    taxonomy = c.taxonomy.filter(predicate)
    return replace(c, taxonomy=taxonomy, counts=keep_features(c.counts, taxonomy))


def subset_samples(c: Community, predicate: Column) -> Community:
    samples = c.samples.filter(predicate)
    return replace(c, samples=samples, counts=keep_samples(c.counts, samples))


def filter_samples_by_depth(counts: DataFrame, min_reads: float) -> DataFrame:
    return keep_samples(counts, sum_by_sample(counts).filter(F.col("total") > min_reads))


def top_features(counts: DataFrame, k: int) -> DataFrame:
    """The ``k`` most abundant features, ties by name."""
    return sum_by_feature(counts).orderBy(F.desc("total"), "feature_id").limit(k)


def top_groups(counts: DataFrame, taxonomy: DataFrame, rank: str, k: int) -> DataFrame:
    return sum_by_group(counts, taxonomy, rank).orderBy(F.desc("total"), rank).limit(k)


def keep_top_groups(c: Community, rank: str = "Phylum", k: int = 5) -> Community:
    groups = top_groups(c.counts, c.taxonomy, rank, k).select(rank)
    taxonomy = c.taxonomy.join(F.broadcast(groups), rank, "left_semi").select(*c.taxonomy.columns)
    return replace(c, taxonomy=taxonomy, counts=keep_features(c.counts, taxonomy))


# --- transforms ---------------------------------------------------------------------------------


def relative_abundance(counts: DataFrame, scale: float = 1.0) -> DataFrame:
    """Share of the sample total: a partial sum per sample joined back, no window over a whole sample."""
    joined = counts.join(sum_by_sample(counts).withColumnRenamed("total", "__t"), "sample_id")
    return joined.select("feature_id", "sample_id", (F.col("count") * scale / F.col("__t")).alias("count"))


def transform_counts(counts: DataFrame, fn) -> DataFrame:
    """Apply ``fn: Column -> Column`` with fn(0) = 0 to every count."""
    return counts.withColumn("count", fn(F.col("count")))


def log_transform_counts(counts: DataFrame) -> DataFrame:
    return transform_counts(counts, F.log1p)


def prepare(
    c: Community, min_count: float = 3, min_frac: float = 0.5, rank: str = "Phylum", k: int = 5,
    keep_sample: Column | None = None, scale: float = 100.0,
) -> Community:
    """Filter features, subset samples, keep the top groups, convert to percent."""
    out = c.with_counts(filter_features(c.counts, min_count, min_frac))
    if keep_sample is not None:
        out = subset_samples(out, keep_sample)
    out = keep_top_groups(out, rank, k)
    return out.with_counts(relative_abundance(out.counts, scale))


# --- diversity ----------------------------------------------------------------------------------

NEWTON_STEPS = 40


def _fisher_alpha(s: Column, n: Column) -> Column:
    """alpha of S = alpha ln(1 + N/alpha), by Newton steps on ln(alpha) in one array fold."""
    start = F.lit(0.0)

    def step(log_a: Column, _: Column) -> Column:
        a = F.exp(log_a)
        f = a * F.log1p(n / a) - s
        slope = a * F.log1p(n / a) - a * n / (a + n)
        return log_a - F.greatest(F.lit(-2.0), F.least(F.lit(2.0), f / slope))

    return F.when(s < n, F.exp(F.aggregate(F.sequence(F.lit(1), F.lit(NEWTON_STEPS)), start, step)))


def richness(counts: DataFrame, measures: list[str] | None = None, rare: int = 10) -> DataFrame:
    """Observed, Chao1, ACE, Shannon, Simpson, InvSimpson and Fisher per sample.

    Chao1 is the bias-corrected form. ACE takes counts up to ``rare`` as rare; without rare individuals
    other than singletons its coverage is zero and it is NaN. Fisher is NULL where every individual is a
    species of its own.
    """
    present = counts.filter(F.col("count") > 0)
    x = F.col("count")
    # sum of x ln x gives Shannon without a second look at the cells: ln N - sum(x ln x)/N
    sums = present.groupBy("sample_id").agg(
        F.count(F.lit(1)).cast("double").alias("S"),
        F.sum(x).cast("double").alias("N"),
        F.sum(x * F.ln(x)).alias("xlx"),
        F.sum(x * x).cast("double").alias("xx"),
        F.count_if(x == 1).cast("double").alias("f1"),
        F.count_if(x == 2).cast("double").alias("f2"),
        F.count_if(x <= rare).cast("double").alias("s_rare"),
        F.sum(F.when(x <= rare, x).otherwise(0.0)).alias("n_rare"),
        F.sum(F.when(x <= rare, x * (x - 1)).otherwise(0.0)).alias("ii_rare"),
    )
    S, N = F.col("S"), F.col("N")
    f1, f2, s_rare, n_rare = (F.col(c) for c in ("f1", "f2", "s_rare", "n_rare"))
    coverage = F.when(n_rare > 0, 1 - f1 / n_rare)
    gamma = F.greatest(
        F.when((coverage > 0) & (n_rare > 1), s_rare / coverage * F.col("ii_rare") / (n_rare * (n_rare - 1)) - 1),
        F.lit(0.0),
    )
    ace = F.when(s_rare == 0, S).when(
        coverage > 0, S - s_rare + s_rare / coverage + f1 / coverage * gamma
    ).otherwise(F.lit(float("nan")))
    forms = {
        "Observed": S,
        "Chao1": S + f1 * (f1 - 1) / (2 * (f2 + 1)),
        "ACE": ace,
        "Shannon": F.ln(N) - F.col("xlx") / N,
        "Simpson": 1 - F.col("xx") / (N * N),
        "InvSimpson": N * N / F.col("xx"),
        "Fisher": _fisher_alpha(S, N),
    }
    return sums.select("sample_id", *[forms[m].alias(m) for m in (measures or forms)])
