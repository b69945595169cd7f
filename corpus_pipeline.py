"""A corpus from raw documents: language ID, exact dedup, near-dedup, source mix, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next one's ``docs``.
All but the last return the columns of ``documents``. Stages decide about rows, not ids: every row that they read gets a number
of its own, so repeated ids and null ids are rows like any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm import exact_dedup, language, mixing, near_dedup, packing
from tarn.llm.common import keyed, without
from tarn.session import store

#: Least posterior of the predicted language.
CONFIDENCE = 0.5
#: Least Jaccard similarity of near-duplicates' sets of five-word runs.
SIMILARITY = 0.8


def in_a_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a recognised language: texts without a letter, or with no language more likely than all others together, go."""
    rows, key = keyed(docs)
    gone = language.identify(rows, key_col=key).filter((F.col("lang_pred") == language.UNKNOWN) | (F.col("score") < CONFIDENCE)).select(key)
    return without(rows, store(gone), key).drop(key)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest id (null is the smallest)."""
    return exact_dedup.keep_one(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates, the row with the smallest id (null is the largest)."""
    return near_dedup.keep_one(docs, similarity=SIMILARITY)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; rows without words are not taken."""
    rows, key = keyed(docs)
    taken = mixing.mix(rows, key_col=key).filter("copies > 0").select(key, F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return rows.join(store(taken.select(key)), key).drop(key)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes: see ``tarn.llm.packing.pack``."""
    return packing.pack(docs, added=packing.added_tokens())


STAGES = [
    ("language_id", in_a_language), ("exact_dedup", without_copies), ("near_dedup", without_near_copies),
    ("source_mix", mixed), ("best_fit_packing", packed),
]
#: SQL can't express the classifier, the near-duplicates' order of work or the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written and read again, on ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
