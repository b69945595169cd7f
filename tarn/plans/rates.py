"""Queries for the incubation time courses and the tables joined from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.compat import strict_avg
from ..operators import incubation as I
from ..operators import mastersheet as M
from ..operators import tables as T
from ..operators.community import keep_top_groups, prepare
from .registry import check, query


def _means(v):
    return I.replicate_means(v.incub)


def _rate_sql(window: int) -> str:
    """Slope by the normal equations; NULL with a single time."""
    keep = "WHERE time <> 48" if window == 24 else ""
    slope = lambda y: f"""CASE WHEN count(DISTINCT time) > 1 THEN (count(*) * sum(time * {y}) - sum(time) * sum({y})) /
        (count(*) * sum(time * time) - sum(time) ** 2) END"""
    return f"SELECT lake_name, {slope('c199')} AS methylation, {slope('ln198')} AS demethylation FROM v_fixed {keep} GROUP BY lake_name"


def _constant_sql(window: int) -> str:
    return f"""SELECT coalesce(r.lake_name, s.lake_name) AS lake_name, methylation AS methylation_{window},
        CASE WHEN demethylation >= 0 THEN 0 ELSE demethylation END AS demethylation_{window},
        CASE WHEN spike <> 0 THEN methylation / spike * 24 WHEN spike = 0 AND methylation > 0 THEN CAST('Infinity' AS DOUBLE)
          WHEN spike = 0 AND methylation < 0 THEN CAST('-Infinity' AS DOUBLE) WHEN spike = 0 AND methylation = 0 THEN CAST('NaN' AS DOUBLE) END AS km_{window},
        CASE WHEN demethylation >= 0 THEN 0 ELSE demethylation * -24 END AS kd_{window}
        FROM (SELECT * FROM ({_rate_sql(window)}) WHERE methylation IS NOT NULL AND demethylation IS NOT NULL) r
        FULL JOIN v_spike s ON r.lake_name = s.lake_name"""


@query("a1_mean_by", check("SELECT lake_name, avg(moisture) AS moisture FROM v_moist WHERE moisture IS NOT NULL GROUP BY 1", "moisture", "lake_name"))
def _(v):
    m = I.clean_moisture(v.raw_moisture).withColumn("moisture", F.col("Moisture_Content").try_cast("double"))
    return T.mean_by(m, "moisture", ["lake_name"])


@query("a2_strict_mean_by", check("""SELECT nation, CASE WHEN count(price) = count(*) THEN avg(price) END AS price, avg(balance) AS balance FROM v_master GROUP BY 1""", "price balance", "nation"))
def _(v):
    return v.master.groupBy("nation").agg(strict_avg("price").alias("price"), strict_avg("balance").alias("balance"))


@query("a2_replicate_means", check("SELECT lake_name, time, c199, c198, ln198 FROM v_means", "time c199 c198 ln198", "lake_name"))
def _(v):
    return _means(v).withColumnsRenamed({"X199_corrected_fixed_Conc": "c199", "X198_corrected_fixed_Conc": "c198", "ln_198": "ln198"})


@query("a12_slope_by", check(_rate_sql(24), "methylation demethylation", "lake_name"))
def _(v):
    return I.rates(_means(v), 24)


RECOVERY = """SELECT m.lake_name, CASE WHEN s.lake_name IS NULL THEN NULL WHEN spike = 0 AND c198 > 0 THEN CAST('Infinity' AS DOUBLE)
    WHEN spike = 0 THEN CAST('NaN' AS DOUBLE) ELSE c198 / spike * 100 END AS recovery
    FROM (SELECT lake_name, max(CASE WHEN time = 0 THEN c198 END) AS c198 FROM v_means GROUP BY lake_name) m
    LEFT JOIN {spike} s ON m.lake_name = s.lake_name"""


@query("a13_recovery_by", check(RECOVERY.format(spike="v_spike"), "recovery", "lake_name"))
def _(v):
    return I.spike_recovery(_means(v), v.spike)


@query("x20_rate_constants", check(_constant_sql(48), "methylation_48 demethylation_48 km_48 kd_48", "lake_name"))
def _(v):
    return I.rate_constants(I.rates(_means(v), 48), v.spike, 48)


CLEAN = """SELECT event_id, lake_name, treatment, time, strftime(date, '%Y-%m-%d') AS date, rep, spiked_con FROM v_clean"""


@query("c1_clean_incubations", check(CLEAN, "spiked_con", "event_id lake_name treatment time date rep"))
def _(v):
    out = I.clean_incubations(v.raw_with_id)
    return out.select("event_id", "lake_name", "treatment", "time", F.col("date").cast("string").alias("date"), F.col("Rep").alias("rep"), "spiked_con")


@query("c2_moisture_correct", check("""SELECT event_id, factor, CASE WHEN x199 < 0 THEN 0 ELSE x199 END AS x199, CASE WHEN x198 < 0 THEN 0 ELSE x198 END AS x198, x202,
    CASE WHEN x198 <= 0 THEN CAST('-Infinity' AS DOUBLE) ELSE ln(x198) END AS ln198 FROM v_corr""", "factor x199 x198 x202 ln198", "event_id"))
def _(v):
    out = I.moisture_correct(I.clean_incubations(v.raw_with_id), I.clean_moisture(v.raw_moisture))
    return out.select("event_id", F.col("moisture_factor").alias("factor"), F.col("X199_corrected_fixed_Conc").alias("x199"),
                      F.col("X198_corrected_fixed_Conc").alias("x198"), F.col("corrected_202").alias("x202"), F.col("ln_198").alias("ln198"))


DILUTED = "CASE WHEN mass <> 0 THEN volume * {c} / mass WHEN {c} > 0 THEN CAST('Infinity' AS DOUBLE) END"
SPIKES = f"""SELECT r.lake_name, {DILUTED.format(c='ma')} AS ma300, {DILUTED.format(c='icp')} AS icp, moisture FROM v_rspike r
    LEFT JOIN (SELECT lake_name, avg(moisture) AS moisture FROM v_moist WHERE moisture IS NOT NULL GROUP BY 1) m ON r.lake_name = m.lake_name"""


@query("c3_spike_table", check(SPIKES, "ma300 icp moisture", "lake_name"))
def _(v):
    out = I.spike_table(v.raw_spike, I.clean_moisture(v.raw_moisture))
    return out.select("lake_name", F.col("corrected_MA300").alias("ma300"), F.col("corrected_ICP").alias("icp"), F.col("Moisture_Content").alias("moisture"))


def _recovery_sql(instrument: str) -> str:
    spike = f"(SELECT lake_name, coalesce({instrument}, 0) AS spike FROM ({SPIKES}))"
    return check(f"""SELECT m.lake_name, CASE WHEN c198 IS NULL OR spike IS NULL THEN NULL WHEN spike = 0 AND c198 > 0 THEN CAST('Infinity' AS DOUBLE)
        WHEN spike = 0 THEN CAST('NaN' AS DOUBLE) WHEN isinf(spike) THEN 0 ELSE c198 / spike * 100 END AS recovery
        FROM (SELECT lake_name, avg(CASE WHEN time = '0' THEN x198 END) AS c198 FROM (SELECT lake_name, time,
          CASE WHEN count(x) = count(*) THEN avg(x) END AS x198 FROM (SELECT lake_name, time, CASE WHEN x198 < 0 THEN 0 ELSE x198 END AS x
          FROM v_corr WHERE NOT contains(treatment, 'USP')) GROUP BY lake_name, time) GROUP BY lake_name) m
        LEFT JOIN {spike} s ON m.lake_name = s.lake_name""", "recovery", "lake_name")


def _from_raw(v):
    moisture = I.clean_moisture(v.raw_moisture)
    spiked = I.spiked_only(I.moisture_correct(I.clean_incubations(v.raw), moisture))
    return I.replicate_means(spiked), I.spike_table(v.raw_spike, moisture)


@query("c4_spike_recovery_ma300", _recovery_sql("ma300"))
def _(v):
    means, spikes = _from_raw(v)
    return I.spike_recovery(means, I.instrument_spike(spikes, "corrected_MA300"))


@query("c4_spike_recovery_icp", _recovery_sql("icp"))
def _(v):
    means, spikes = _from_raw(v)
    return I.spike_recovery(means, I.instrument_spike(spikes, "corrected_ICP"))


@query("c5_rates_24", check(_rate_sql(24), "methylation demethylation", "lake_name"))
def _(v):
    return I.rates(_means(v), 24)


@query("c5_rates_48", check(_rate_sql(48), "methylation demethylation", "lake_name"))
def _(v):
    return I.rates(_means(v), 48)


@query("c6_rate_constants", check(_constant_sql(24), "methylation_24 demethylation_24 km_24 kd_24", "lake_name"))
def _(v):
    return I.rate_constants(I.rates(_means(v), 24), v.spike, 24)


RATE_COLUMNS = " ".join(f"{c}_{w}" for w in (24, 48) for c in ("methylation", "demethylation", "km", "kd"))
RATE_TABLE = f"""SELECT coalesce(a.lake_name, b.lake_name) AS lake_name, {RATE_COLUMNS.replace(' ', ', ')}
    FROM ({_constant_sql(24)}) a FULL JOIN ({_constant_sql(48)}) b ON a.lake_name = b.lake_name"""


@query("c7_rate_table", check(RATE_TABLE, RATE_COLUMNS, "lake_name"))
def _(v):
    return I.incubation_rate_table(_means(v), v.spike)


MASTER = f"""SELECT c.lake_name, c."Year", "DOC", "pH", "Sulphate", km_24, kd_24, "SUVA", 10 ** (-"pH") * 1000000 AS proton_um FROM v_chem c
    LEFT JOIN (SELECT coalesce(t.lake_name, y.lake_name) AS lake_name, "Year", km_24, kd_24 FROM ({RATE_TABLE}) t FULL JOIN v_years y
      ON t.lake_name = y.lake_name) r ON c.lake_name = r.lake_name AND c."Year" = r."Year"
    LEFT JOIN v_suva s ON c.lake_name = s.lake_name WHERE c.lake_name NOT IN ('L3', 'L77')"""
MASTER_DOUBLES, MASTER_KEEP = "DOC pH Sulphate km_24 kd_24 SUVA proton_um", 'lake_name "Year"'


def _mastersheet(v, require=None):
    out = M.mastersheet(v.chem, I.incubation_rate_table(_means(v), v.spike), v.years, v.suva, exclude=("L3", "L77"), require_rate=require)
    return out.select("lake_name", "Year", "DOC", "pH", "Sulphate", "km_24", "kd_24", "SUVA", (F.col("proton_M") * 1000000).alias("proton_um"))


@query("c8_mastersheet", check(MASTER, MASTER_DOUBLES, MASTER_KEEP))
def _(v):
    return _mastersheet(v)


@query("c8_mastersheet_with_rate", check(f"SELECT * FROM ({MASTER}) WHERE km_24 IS NOT NULL AND NOT isnan(km_24)", MASTER_DOUBLES, MASTER_KEEP))
def _(v):
    return _mastersheet(v, "km_24")


@query("c8_detected", check(f"SELECT CASE WHEN kd_24 <> 0 THEN 'YES' ELSE 'NO' END AS kd_observed, count(*) AS n FROM ({MASTER}) WHERE kd_24 IS NOT NULL GROUP BY 1", "", "kd_observed n"))
def _(v):
    return M.detected(_mastersheet(v)).groupBy("kd_observed").agg(F.count(F.lit(1)).alias("n"))


@query("c9_env_table", check(f"""SELECT c.lake_name, c."Year", "DOC", km_24, "SUVA" FROM v_chem c
    LEFT JOIN (SELECT replace(coalesce(t.lake_name, y.lake_name), 'L2', 'L2_2016') AS lake_name, "Year", km_24 FROM ({RATE_TABLE}) t FULL JOIN v_years y
      ON t.lake_name = y.lake_name) r ON c.lake_name = r.lake_name AND c."Year" = r."Year"
    LEFT JOIN v_suva s ON c.lake_name = s.lake_name WHERE c.lake_name NOT IN ('L4', 'L5')""", "DOC km_24 SUVA", MASTER_KEEP))
def _(v):
    return M.env_table(v.chem, I.incubation_rate_table(_means(v), v.spike), v.years, v.suva,
                       ["lake_name", "Year", "DOC", "km_24", "SUVA"], {"L2": "L2_2016"}, exclude=("L4", "L5"))


@query("c10_community_prepare", check("""SELECT feature_id, sample_id, 100 * "count" / sum("count") OVER (PARTITION BY sample_id) AS "count" FROM (
    SELECT f.* FROM (SELECT * FROM v_counts WHERE feature_id IN (SELECT feature_id FROM v_counts GROUP BY 1
      HAVING count(CASE WHEN "count" > 35 THEN 1 END) > 0.3 * (SELECT count(DISTINCT sample_id) FROM v_counts))) f
    JOIN v_env USING (sample_id) JOIN v_tax USING (feature_id) WHERE region <> 'ASIA' AND "Phylum" IN (
      SELECT "Phylum" FROM (SELECT * FROM v_counts WHERE feature_id IN (SELECT feature_id FROM v_counts GROUP BY 1
        HAVING count(CASE WHEN "count" > 35 THEN 1 END) > 0.3 * (SELECT count(DISTINCT sample_id) FROM v_counts)))
      JOIN v_env USING (sample_id) JOIN v_tax USING (feature_id) WHERE region <> 'ASIA' AND "Phylum" IS NOT NULL
      GROUP BY 1 ORDER BY sum("count") DESC, "Phylum" LIMIT 3))""", '"count"', "feature_id sample_id"))
def _(v):
    c = v.community.with_counts(v.stored_counts)
    return prepare(c, min_count=35, min_frac=0.3, k=3, keep_sample=F.col("region") != "ASIA").counts


@query("t2_prune_to_top_groups", check("""SELECT c.* FROM v_counts c JOIN v_tax USING (feature_id) WHERE "Phylum" IN (SELECT "Phylum" FROM v_counts
    JOIN v_tax USING (feature_id) WHERE "Phylum" IS NOT NULL GROUP BY 1 ORDER BY sum("count") DESC, "Phylum" LIMIT 2)""", "", 'feature_id sample_id "count"'))
def _(v):
    return keep_top_groups(v.community, "Phylum", 2).counts
