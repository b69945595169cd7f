"""Views over the star-schema tables that stand for the field tables, in DataFrame and in SQL form.

``events`` plays the incubations, ``orders`` and ``customer`` the chemistry sheets, ``lineitem`` summed per
nation and part the feature counts, ``part`` taxonomy and tree, nations the samples.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.compat import clamp_low, r_ln
from ..operators.community import Community
from ..operators.distance import unifrac
from ..operators.tree import interval_proportions, tree_intervals
from ..session import store


class Views:
    """The tables of one folder and the views over them."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")

    @cached_property
    def events(self) -> DataFrame:
        day = F.dayofmonth("ts")
        hours = F.when(day <= 10, 0).when(day <= 20, 24).otherwise(48)
        return self.table("events").select(
            "event_id", "user_id", "event_type", "value", day.alias("day"), hours.alias("hours"), "ts",
            F.concat(F.lit("L"), F.col("user_id").cast("string")).alias("lake_name"))

    @cached_property
    def incub(self) -> DataFrame:
        """Corrected incubation rows."""
        c198 = clamp_low(F.col("value") - 1)
        return self.events.select(
            "lake_name", F.col("event_type").alias("treatment"), F.col("hours").cast("double").alias("time"),
            (F.col("event_id") % 3).alias("Rep"), (F.col("value") / 7).alias("X199_corrected_fixed_Conc"),
            c198.alias("X198_corrected_fixed_Conc"), r_ln(c198).alias("ln_198"))

    @cached_property
    def raw(self) -> DataFrame:
        """Instrument rows as text, with standards, blanks, controls and malformed years."""
        return self.raw_with_id.drop("event_id")

    @cached_property
    def raw_with_id(self) -> DataFrame:
        """The instrument rows with the number of the event they come from."""
        e, text = F.col("event_id"), lambda c: c.cast("string")
        name = (
            F.when(e % 29 == 0, F.concat("lake_name", F.lit(" 198 standard SP")))
            .when((F.col("event_type") == "signup") & (e % 13 == 0), F.concat("lake_name", F.lit("BLANK")))
            .when(F.col("event_type") == "error", F.concat("lake_name", F.lit(" USP"), text(F.col("hours"))))
            .otherwise(F.concat("lake_name", F.lit(" SP"), text(F.col("hours"))))
        )
        return self.events.select(
            "event_id", name.alias("Sample_Name"), text(F.col("day")).alias("Day"),
            F.when(e % 2 == 0, text(F.month("ts"))).otherwise(F.date_format("ts", "MMMM")).alias("Month"),
            F.when(e % 41 == 0, F.lit("20. 24")).otherwise(text(F.year("ts"))).alias("Year"),
            text(e % 3).alias("Rep"), text(1 + e % 7).alias("Volume"), text(F.col("value")).alias("Spike_Conc"),
            text(e % 5).alias("Weight_sample"), text(F.col("value") - 1).alias("198_Hg_ug_kg"),
            text(F.col("value")).alias("199_Hg_ug_Kg"),
            F.when(e % 11 == 0, F.lit("n/a")).otherwise(text(F.col("value") / 2)).alias("202_Hg_ug_kg"))

    @cached_property
    def raw_moisture(self) -> DataFrame:
        u, rep = F.col("user_id"), F.col("event_id") % 3
        kind = F.when(F.col("event_type") == "error", F.lit(" USP")).otherwise(F.lit(" SP"))
        content = F.when((u + F.col("day")) % 19 == 0, F.lit("wet")).otherwise(((u * 7 + F.col("day") + rep) % 60).cast("string"))
        return self.events.select(
            F.concat("lake_name", kind).alias("Sample_Name"), F.col("day").cast("string").alias("Day"),
            F.month("ts").cast("string").alias("Month"), F.year("ts").cast("string").alias("Year"),
            rep.cast("string").alias("Rep"), content.alias("Moisture_Content")).distinct()

    @cached_property
    def raw_spike(self) -> DataFrame:
        u = F.col("user_id")
        return (
            self.events.groupBy("user_id", "lake_name").agg(F.avg("value").alias("Spike_MA"), F.max("value").alias("m"))
            .filter(u % 6 != 0)  # lakes without a spike row, for the outer joins
            .select("lake_name", (1 + u % 4).cast("double").alias("Volume"), (u % 5).cast("double").alias("Mass"), "Spike_MA",
                    F.when(u % 7 != 3, F.col("m")).alias("Spike_ICP")))

    @cached_property
    def spike(self) -> DataFrame:
        """``lake_name, spike`` of one instrument, missing as zero; some lakes have no row."""
        return self.raw_spike.select("lake_name", F.coalesce(F.when(F.col("Spike_ICP").isNotNull(), F.col("Spike_MA")), F.lit(0.0)).alias("spike"))

    @cached_property
    def chem(self) -> DataFrame:
        return self.table("orders").groupBy(F.col("o_custkey").alias("k"), F.year("o_orderdate").alias("Year")).agg(
            (F.avg("o_totalprice") / 9973).alias("DOC"), F.count(F.lit(1)).cast("double").alias("Sulphate"),
        ).select(F.concat(F.lit("L"), F.col("k").cast("string")).alias("lake_name"), "Year", "DOC", "Sulphate",
                 (F.lit(4.0) + (F.col("k") % 40) / 10).alias("pH"))

    @cached_property
    def years(self) -> DataFrame:
        return self.chem.groupBy("lake_name").agg(F.min("Year").alias("Year"))

    @cached_property
    def suva(self) -> DataFrame:
        return self.table("customer").select(
            F.concat(F.lit("L"), F.col("c_custkey").cast("string")).alias("lake_name"),
            F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal") / 1000).alias("SUVA"))

    @cached_property
    def priced(self) -> DataFrame:
        """One row per customer: balance and mean order price; every seventh customer misses the price."""
        money = self.table("orders").groupBy(F.col("o_custkey").alias("k")).agg((F.avg("o_totalprice") / 997).alias("price"))
        money = money.withColumn("price", F.when(F.col("k") % 7 != 0, F.col("price")))
        nation = self.table("nation").join(self.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        nation = nation.select("n_nationkey", F.col("n_name").alias("nation"), F.col("r_name").alias("region"))
        cust = self.table("customer").select(
            F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("n_nationkey"), (F.col("c_acctbal") / 1000).alias("balance"),
            F.col("c_mktsegment").alias("segment"))
        return cust.join(nation, "n_nationkey").join(money, "k", "left").drop("n_nationkey")

    @cached_property
    def master(self) -> DataFrame:
        """The priced customers with the means of their orders' lines."""
        lines = self.table("lineitem").select("l_orderkey", "l_quantity", "l_discount")
        per_order = lines.join(self.table("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        items = per_order.groupBy(F.col("o_custkey").alias("k")).agg(
            F.avg("l_quantity").alias("qty"), (F.avg("l_discount") * 100).alias("disc"))
        return self.priced.join(items, "k", "left")

    @cached_property
    def counts(self) -> DataFrame:
        """Units per part (feature) and nation (sample)."""
        orders = self.table("orders").select("o_orderkey", "o_custkey")
        cust = self.table("customer").select("c_custkey", "c_nationkey")
        lines = self.table("lineitem").select("l_orderkey", "l_partkey", "l_quantity")
        joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(cust, F.col("o_custkey") == F.col("c_custkey"))
        summed = joined.groupBy("l_partkey", "c_nationkey").agg(F.sum("l_quantity").alias("count"))
        nation = self.table("nation").select("n_nationkey", F.col("n_name").alias("sample_id"))
        return summed.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
            F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("feature_id"), "sample_id", "count")

    @cached_property
    def stored_counts(self) -> DataFrame:
        """The counts written once, for queries that read them more than once."""
        return store(self.counts)

    @cached_property
    def customer_counts(self) -> DataFrame:
        """Units per part (feature) and customer (sample): as many samples as there are customers."""
        orders = self.table("orders").select("o_orderkey", "o_custkey")
        lines = self.table("lineitem").select("l_orderkey", "l_partkey", "l_quantity")
        summed = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey", "l_partkey").agg(F.sum("l_quantity").alias("count"))
        return summed.select(F.col("o_custkey").alias("sample_id"), F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("feature_id"), "count")

    @cached_property
    def customer_shares(self) -> DataFrame:
        """Branch proportions of every customer."""
        return interval_proportions(store(self.customer_counts), self.intervals)

    @cached_property
    def lineages(self) -> DataFrame:
        """``feature_id, lineage``: type;brand;name, the name missing for some parts."""
        name = F.when(F.col("p_size") % 10 != 0, F.concat(F.lit(";"), F.col("p_name"))).otherwise(F.lit(""))
        return self.table("part").select(
            F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("feature_id"),
            F.concat("p_type", F.lit(";"), "p_brand", name).alias("lineage"))

    @cached_property
    def tax(self) -> DataFrame:
        """Ranks: Phylum (type, missing for some), Class (brand), Genus (name, missing for some)."""
        return self.table("part").select(
            F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("feature_id"),
            F.when(F.col("p_size") % 13 != 0, F.col("p_type")).alias("Phylum"), F.col("p_brand").alias("Class"),
            F.when(F.col("p_size") % 10 != 0, F.col("p_name")).alias("Genus"))

    @cached_property
    def tree(self) -> DataFrame:
        """Root, type, type and brand, part; branch lengths 2, 1, 1 + size % 7."""
        p = self.table("part")
        types = p.select(F.col("p_type").alias("node"), F.lit("root").alias("parent"), F.lit(2.0).alias("length"), F.lit(False).alias("is_tip")).distinct()
        brands = p.select(F.concat_ws("|", "p_type", "p_brand").alias("node"), F.col("p_type").alias("parent"),
                          F.lit(1.0).alias("length"), F.lit(False).alias("is_tip")).distinct()
        tips = p.select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("node"),
                        F.concat_ws("|", "p_type", "p_brand").alias("parent"),
                        (1 + F.col("p_size") % 7).cast("double").alias("length"), F.lit(True).alias("is_tip"))
        return types.unionByName(brands).unionByName(tips)

    @cached_property
    def env(self) -> DataFrame:
        """One row per nation: means over its customers."""
        return self.master.groupBy(F.col("nation").alias("sample_id"), "region").agg(
            F.avg("balance").alias("balance"), F.avg("price").alias("price"), F.avg("qty").alias("qty"), F.avg("disc").alias("disc"))

    @cached_property
    def xy(self) -> DataFrame:
        """Two coordinates per nation."""
        return self.env.select("sample_id", (F.col("balance") * 10).alias("lat"), (F.col("price") / 10).alias("lon"))

    @cached_property
    def community(self) -> Community:
        return Community(self.stored_counts, self.tax, self.tree, self.env)

    @cached_property
    def intervals(self) -> DataFrame:
        """The tree with its tips in a row."""
        return tree_intervals(self.tree)

    @cached_property
    def deep_tree(self) -> DataFrame:
        """A tree as deep as there are parts: each inner node has the next one and a part below it."""
        k, text = F.col("p_partkey"), lambda c: c.cast("string")
        p = self.table("part").select(k)
        inner = p.select(F.concat(F.lit("I"), text(k)).alias("node"), F.concat(F.lit("I"), text(k - 1)).alias("parent"), F.lit(1.0).alias("length"), F.lit(False).alias("is_tip"))
        tips = p.select(F.concat(F.lit("P"), text(k)).alias("node"), F.concat(F.lit("I"), text(k)).alias("parent"), (k % 5).cast("double").alias("length"), F.lit(True).alias("is_tip"))
        return inner.unionByName(tips)

    @cached_property
    def shares(self) -> DataFrame:
        """Branch proportions of every nation."""
        return interval_proportions(self.stored_counts, self.intervals)

    @cached_property
    def wunifrac(self) -> DataFrame:
        return store(unifrac(self.shares))


# The same views in SQL; a view may use those above it.
SQL_VIEWS: dict[str, str] = {
    "v_events": """SELECT event_id, user_id, event_type, value, ts, day(ts) AS day,
        CASE WHEN day(ts) <= 10 THEN 0 WHEN day(ts) <= 20 THEN 24 ELSE 48 END AS hours,
        'L' || CAST(user_id AS VARCHAR) AS lake_name FROM events""",
    "v_incub": """SELECT lake_name, event_type AS treatment, CAST(hours AS DOUBLE) AS time, event_id % 3 AS rep,
        value / 7 AS c199, greatest(value - 1, 0) AS c198,
        CASE WHEN value - 1 <= 0 THEN CAST('-Infinity' AS DOUBLE) ELSE ln(value - 1) END AS ln198 FROM v_events""",
    "v_raw": """SELECT event_id, user_id, lake_name, upper(CASE WHEN event_id % 29 = 0 THEN lake_name || ' 198 standard SP'
        WHEN event_type = 'signup' AND event_id % 13 = 0 THEN lake_name || 'BLANK'
        WHEN event_type = 'error' THEN lake_name || ' USP' || CAST(hours AS VARCHAR)
        ELSE lake_name || ' SP' || CAST(hours AS VARCHAR) END) AS name,
        CASE WHEN event_id % 29 = 0 THEN '' WHEN event_type = 'error' THEN 'USP' ELSE 'SP' END AS treatment,
        CAST(hours AS VARCHAR) AS time, CASE WHEN event_id % 41 = 0 THEN NULL ELSE CAST(ts AS DATE) END AS date,
        CAST(event_id % 3 AS VARCHAR) AS rep, value, 1 + event_id % 7 AS volume, event_id % 5 AS weight,
        CASE WHEN event_id % 11 = 0 THEN NULL ELSE value / 2 END AS hg202 FROM v_events""",
    "v_clean": """SELECT *, CASE WHEN weight = 0 THEN CAST('Infinity' AS DOUBLE) ELSE volume * value / weight END AS spiked_con
        FROM v_raw WHERE contains(name, 'SP') AND NOT contains(name, '198')""",
    "v_moist": """SELECT DISTINCT lake_name, CASE WHEN event_type = 'error' THEN 'USP' ELSE 'SP' END AS treatment,
        CAST(ts AS DATE) AS date, CAST(event_id % 3 AS VARCHAR) AS rep,
        CASE WHEN (user_id + day) % 19 = 0 THEN NULL ELSE CAST((user_id * 7 + day + event_id % 3) % 60 AS DOUBLE) END AS moisture
        FROM v_events""",
    "v_corr": """SELECT c.*, (100 - m.moisture) / 100 AS factor, (100 - m.moisture) / 100 * (value - 1) AS x198,
        (100 - m.moisture) / 100 * value AS x199, (100 - m.moisture) / 100 * hg202 AS x202
        FROM v_clean c LEFT JOIN v_moist m ON c.lake_name = m.lake_name AND c.treatment = m.treatment
        AND c.date IS NOT DISTINCT FROM m.date AND c.rep = m.rep""",
    "v_rspike": """SELECT user_id, lake_name, CAST(1 + user_id % 4 AS DOUBLE) AS volume, CAST(user_id % 5 AS DOUBLE) AS mass,
        avg(value) AS ma, CASE WHEN user_id % 7 <> 3 THEN max(value) END AS icp
        FROM v_events GROUP BY user_id, lake_name HAVING user_id % 6 <> 0""",
    "v_spike": "SELECT lake_name, CASE WHEN icp IS NULL THEN 0.0 ELSE ma END AS spike FROM v_rspike",
    "v_means": """SELECT lake_name, time, avg(c199) AS c199, avg(c198) AS c198,
        CASE WHEN bool_or(c198 = 0) THEN CAST('-Infinity' AS DOUBLE) ELSE avg(CASE WHEN c198 > 0 THEN ln198 END) END AS ln198
        FROM v_incub GROUP BY lake_name, time""",
    "v_fixed": "SELECT lake_name, time, c199, c198, CASE WHEN isinf(ln198) THEN ln(0.0000001) ELSE ln198 END AS ln198 FROM v_means",
    "v_chem": """SELECT 'L' || CAST(o_custkey AS VARCHAR) AS lake_name, CAST(year(o_orderdate) AS INTEGER) AS "Year",
        avg(o_totalprice) / 9973 AS "DOC", CAST(count(*) AS DOUBLE) AS "Sulphate", 4.0 + (o_custkey % 40) / 10.0 AS "pH"
        FROM orders GROUP BY o_custkey, year(o_orderdate)""",
    "v_years": """SELECT lake_name, min("Year") AS "Year" FROM v_chem GROUP BY lake_name""",
    "v_suva": "SELECT 'L' || CAST(c_custkey AS VARCHAR) AS lake_name, CASE WHEN c_acctbal >= 0 THEN c_acctbal / 1000 END AS \"SUVA\" FROM customer",
    "v_master": """SELECT c_custkey AS k, c_acctbal / 1000 AS balance, c_mktsegment AS segment, n_name AS nation, r_name AS region,
        price, qty, disc FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
        LEFT JOIN (SELECT o_custkey, CASE WHEN o_custkey % 7 <> 0 THEN avg(o_totalprice) / 997 END AS price FROM orders GROUP BY o_custkey) a ON a.o_custkey = c_custkey
        LEFT JOIN (SELECT o_custkey, avg(l_quantity) AS qty, avg(l_discount) * 100 AS disc FROM lineitem JOIN orders ON l_orderkey = o_orderkey
          GROUP BY o_custkey) b ON b.o_custkey = c_custkey""",
    "v_full": "SELECT * FROM v_master WHERE price IS NOT NULL AND qty IS NOT NULL",
    "v_counts": """SELECT 'P' || CAST(l_partkey AS VARCHAR) AS feature_id, n_name AS sample_id, sum(l_quantity) AS "count"
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
        JOIN nation ON c_nationkey = n_nationkey GROUP BY l_partkey, n_name""",
    "v_tax": """SELECT 'P' || CAST(p_partkey AS VARCHAR) AS feature_id, CASE WHEN p_size % 13 <> 0 THEN p_type END AS "Phylum",
        p_brand AS "Class", CASE WHEN p_size % 10 <> 0 THEN p_name END AS "Genus" FROM part""",
    "v_tree": """SELECT DISTINCT p_type AS node, 'root' AS parent, 2.0 AS length, false AS is_tip FROM part
        UNION ALL SELECT DISTINCT p_type || '|' || p_brand, p_type, 1.0, false FROM part
        UNION ALL SELECT 'P' || CAST(p_partkey AS VARCHAR), p_type || '|' || p_brand, 1.0 + p_size % 7, true FROM part""",
    "v_closure": """SELECT 'P' || CAST(p_partkey AS VARCHAR) AS tip,
        unnest([p_type, p_type || '|' || p_brand, 'P' || CAST(p_partkey AS VARCHAR)]) AS branch,
        unnest([2.0, 1.0, 1.0 + p_size % 7]) AS length FROM part""",
    "v_share": """SELECT sample_id, branch, any_value(length) AS length, sum("count") / any_value(t) AS p
        FROM v_counts JOIN v_closure ON feature_id = tip
        JOIN (SELECT sample_id, sum("count") AS t FROM v_counts GROUP BY sample_id) USING (sample_id) GROUP BY sample_id, branch""",
    "v_units": """SELECT o_custkey AS sample_id, 'P' || CAST(l_partkey AS VARCHAR) AS feature_id, sum(l_quantity) AS "count"
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey, l_partkey""",
    "v_parts": """SELECT sample_id, branch, any_value(length) AS length, sum("count") / any_value(t) AS p
        FROM v_units JOIN v_closure ON feature_id = tip
        JOIN (SELECT sample_id, sum("count") AS t FROM v_units GROUP BY sample_id) USING (sample_id) GROUP BY sample_id, branch""",
    "v_env": """SELECT nation AS sample_id, region, avg(balance) AS balance, avg(price) AS price, avg(qty) AS qty, avg(disc) AS disc
        FROM v_master GROUP BY nation, region""",
    "v_xy": "SELECT sample_id, balance * 10 AS lat, price / 10 AS lon FROM v_env",
    "v_euclid": """SELECT a.sample_id AS i, b.sample_id AS j, sqrt((a.lat - b.lat) ** 2 + (a.lon - b.lon) ** 2) AS d
        FROM v_xy a JOIN v_xy b ON a.sample_id < b.sample_id""",
    "v_wuf": """SELECT n.i, n.j, 1 - 2 * s / (ti.t + tj.t) AS d FROM
        (SELECT a.sample_id AS i, b.sample_id AS j, sum(a.length * least(a.p, b.p)) AS s
          FROM v_share a JOIN v_share b ON a.branch = b.branch AND a.sample_id < b.sample_id GROUP BY a.sample_id, b.sample_id) n
        JOIN (SELECT sample_id, sum(length * p) AS t FROM v_share GROUP BY sample_id) ti ON ti.sample_id = n.i
        JOIN (SELECT sample_id, sum(length * p) AS t FROM v_share GROUP BY sample_id) tj ON tj.sample_id = n.j""",
}
