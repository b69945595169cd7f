"""The corpus operators as queries, with the SQL that some of them are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .divergence import AUDIT_SQL, audit
from .exact_dedup import exact_groups
from .fingerprint import edited_fingerprints
from .language import identify
from .licences import scan, scan_sql
from .mixing import mix
from .near_dedup import near_groups
from .packing import added_tokens, pack
from .suffix_dedup import remove_repeats
from .tiers import pack_tiers
from .url_filter import judge, judge_sql
from .warc import round_trip
from .whitening import whiten

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


EXACT_SQL = """WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents),
g AS (SELECT doc_id, max(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size, norm FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM g"""


@query("op1_exact_dedup", EXACT_SQL)
def op1(spark, sf_dir):
    return exact_groups(documents(spark, sf_dir))


@query("op2_suffix_dedup")
def op2(spark, sf_dir):
    return remove_repeats(documents(spark, sf_dir), keep_text=False).drop("kept")


@query("op3_fingerprints")
def op3(spark, sf_dir):
    return edited_fingerprints(documents(spark, sf_dir))


@query("op4_best_fit_packing")
def op4(spark, sf_dir):
    return pack(documents(spark, sf_dir), added=added_tokens())


@query("op5_source_mix")
def op5(spark, sf_dir):
    return mix(documents(spark, sf_dir))


@query("op6_license_scan", scan_sql())
def op6(spark, sf_dir):
    return scan(documents(spark, sf_dir)).select("doc_id", "canonical_sha256", "licence", "notices")


@query("op7_warc_round_trip")
def op7(spark, sf_dir):
    return round_trip(pages(spark, sf_dir))


@query("op8_language_id")
def op8(spark, sf_dir):
    return identify(documents(spark, sf_dir))


@query("op9_near_dedup")
def op9(spark, sf_dir):
    return near_groups(documents(spark, sf_dir), similarity=0.85)


@query("op10_url_filter", judge_sql())
def op10(spark, sf_dir):
    return judge(pages(spark, sf_dir)).select("page_id", "host", "path", "rule", "verdict")


@query("op11_source_divergence", AUDIT_SQL)
def op11(spark, sf_dir):
    return audit(documents(spark, sf_dir))


@query("op12_embedding_whitening")
def op12(spark, sf_dir):
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


@query("op13_tiered_packing")
def op13(spark, sf_dir):
    return pack_tiers(documents(spark, sf_dir), added=added_tokens())
