"""Queries for scans, sinks, projections, filters, joins, sorts, sets and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import compat as K
from ..functions import text as X
from ..operators import community as C
from ..operators import tables as T
from ..operators.incubation import LOG_FLOOR, clean_incubations, clean_moisture, moisture_correct
from ..operators.pairs import pair_sums
from ..session import scratch_path
from ..sources import files as S
from .registry import check, query

RAW_CHECK = check(
    "SELECT name, rep, CAST(volume AS VARCHAR) AS volume, value FROM v_raw", "value", "name rep volume")


# --- scans and sinks ----------------------------------------------------------------------------


@query("s1_scan_csv_dir", RAW_CHECK)
def _(v):
    """A folder of instrument sheets with two different headers, stacked by name."""
    path = scratch_path(v.spark, "sheets")
    raw = v.raw.withColumn("odd", F.col("Rep") == "1")
    raw.filter("odd").drop("odd").coalesce(2).write.option("header", True).csv(f"{path}/a")
    raw.filter("not odd").drop("odd", "Day").select("Rep", "Sample_Name", "Volume", "199_Hg_ug_Kg").write.option("header", True).csv(f"{path}/b")
    df = S.scan_csv_dir(v.spark, path, "*/*.csv")
    return df.select(F.upper("Sample_Name").alias("name"), F.col("Rep").alias("rep"), F.col("Volume").alias("volume"),
                     K.num("199_Hg_ug_Kg").alias("value"))


@query("s2_scan_csv", check('SELECT lake_name, "Year", "DOC", "Sulphate", "pH" FROM v_chem', "DOC Sulphate pH", 'lake_name "Year"'))
def _(v):
    path = S.sink_csv(v.chem, scratch_path(v.spark, "chem"))
    return S.scan_csv(v.spark, path, "lake_name STRING, Year INT, DOC DOUBLE, Sulphate DOUBLE, pH DOUBLE")


@query("s3_scan_tsv", check("SELECT sample_id, region, balance, price FROM v_env", "balance price", "sample_id region"))
def _(v):
    path = S.sink_tsv(v.env.select("sample_id", "region", "balance", "price"), scratch_path(v.spark, "metadata"))
    return S.scan_tsv(v.spark, path)


COUNT_CHECK = check('SELECT feature_id, sample_id, "count" FROM v_counts', "", 'feature_id sample_id "count"')


@query("s4_load_community", COUNT_CHECK)
def _(v):
    return C.load_community(v.spark, C.store_community(v.community, scratch_path(v.spark, "community"))).counts


@query("s5_wide_to_long", COUNT_CHECK)
def _(v):
    names = [r[0] for r in v.table("nation").select("n_name").distinct().orderBy("n_name").collect()]
    wide = v.counts.groupBy("feature_id").pivot("sample_id", names).agg(F.sum("count")).na.fill(0.0)
    return C.wide_to_long(wide)


@query("s6_sink_csv", check("SELECT lake_name, spike FROM v_spike", "spike", "lake_name"))
def _(v):
    path = S.sink_csv(v.spike, scratch_path(v.spark, "spike"), sort_keys=["lake_name"])
    return S.scan_csv(v.spark, path, "lake_name STRING, spike DOUBLE")


@query("s7_hand_off", check("SELECT lake_name, spike FROM v_spike", "spike", "lake_name"))
def _(v):
    return S.hand_off(v.spike, scratch_path(v.spark, "stage"))


@query("s8_literal_set", "SELECT user_id, count(*) AS n FROM events WHERE event_type IN ('click', 'view') GROUP BY user_id")
def _(v):
    """A name list used as a filter through a semi join."""
    names = S.literal_set(v.spark, "event_type", ["click", "view"])
    return v.table("events").join(F.broadcast(names), "event_type", "left_semi").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


# --- projections --------------------------------------------------------------------------------


@query("p1_select_everything", check("SELECT lake_name, spike FROM v_spike", "spike", "lake_name"))
def _(v):
    return T.select_first(v.spike.select("spike", "lake_name"), ["lake_name"])


@query("p2_drop", check('SELECT lake_name, "DOC" FROM v_chem', "DOC", "lake_name"))
def _(v):
    return v.chem.drop("Year", "Sulphate", "pH")


@query("p3_rename", check('SELECT sample_id AS lake, balance AS "space.vector" FROM v_env', '"space.vector"', "lake"))
def _(v):
    return v.env.select("sample_id", "balance").withColumnsRenamed({"sample_id": "lake", "balance": "space.vector"})


@query("p4_mutate", check('SELECT lake_name, "Year", "DOC" * 2 AS twice, "DOC" + "Sulphate" AS summed FROM v_chem', "twice summed", 'lake_name "Year"'))
def _(v):
    return v.chem.withColumns({"twice": F.col("DOC") * 2, "summed": F.col("DOC") + F.col("Sulphate")}).select("lake_name", "Year", "twice", "summed")


@query("p5_upper_all", check("SELECT upper(segment) AS segment, upper(nation) AS nation, balance FROM v_master", "balance", "segment nation"))
def _(v):
    return X.upper_all(v.master.select("segment", "nation", "balance"))


@query("p6_add_constant", check("SELECT lake_name, spike, 'Group_1' AS \"Group\" FROM v_spike", "spike", 'lake_name "Group"'))
def _(v):
    return v.spike.withColumn("Group", F.lit("Group_1"))


@query("p7_as_string", check('SELECT lake_name, CAST("Year" AS VARCHAR) AS "Year" FROM v_chem', "", 'lake_name "Year"'))
def _(v):
    return v.chem.select("lake_name", F.col("Year").cast("string").alias("Year"))


@query("p8_set_key", check("SELECT k, nation FROM v_master", "", "k nation"))
def _(v):
    return T.set_key(v.master.select("k", "nation"), "k")


@query("p9_lookup_scalar", check("""SELECT lake_name, max(CASE WHEN time = 0 THEN c198 END) AS start, max(CASE WHEN time = 48 THEN c198 END) AS finish
    FROM v_means GROUP BY lake_name""", "start finish", "lake_name"))
def _(v):
    means = v.incub.groupBy("lake_name", "time").agg(K.strict_avg("X198_corrected_fixed_Conc").alias("c"))
    return means.groupBy("lake_name").agg(
        T.value_at("c", F.col("time") == 0).alias("start"), T.value_at("c", F.col("time") == 48).alias("finish"))


@query("p10_percent_label", check("""SELECT sample_id, 'CAP 1 (' || regexp_replace(CAST(round(price / (SELECT sum(price) FROM v_env) * 100, 2) AS VARCHAR), '\\.0$', '')
    || ' % of fitted, ' || regexp_replace(CAST(round(qty / 100 * 100, 2) AS VARCHAR), '\\.0$', '') || ' % of total variation)' AS label FROM v_env""", "", "sample_id label"))
def _(v):
    total = v.env.agg(F.sum("price")).first()[0]
    return v.env.select("sample_id", X.percent_label("CAP 1", F.col("price") / total, F.col("qty") / 100).alias("label"))


@query("p11_rank_names_and_samples", check("""SELECT r AS rank, n FROM (SELECT unnest(['Phylum', 'Class', 'Genus']) AS r) a,
    (SELECT count(DISTINCT sample_id) AS n FROM v_counts) b""", "", "rank n"))
def _(v):
    n = C.n_samples(v.counts)
    return v.spark.createDataFrame([(r, n) for r in C.rank_names(v.tax)], "rank string, n long")


# --- filters ------------------------------------------------------------------------------------


@query("f1_contains", check("SELECT name, count(*) AS n FROM v_raw WHERE contains(name, 'SP') AND NOT contains(name, '198') GROUP BY name", "", "name n"))
def _(v):
    raw = v.raw.select(F.upper("Sample_Name").alias("name"))
    return raw.filter(F.col("name").contains("SP") & ~F.col("name").contains("198")).groupBy("name").agg(F.count(F.lit(1)).alias("n"))


@query("f2_equals", check("SELECT lake_name, time, c199 FROM v_means WHERE time <> 48", "time c199", "lake_name"))
def _(v):
    means = v.incub.groupBy("lake_name", "time").agg(F.avg("X199_corrected_fixed_Conc").alias("c199"))
    return means.filter(F.col("time") != 48)


@query("f3_in_not_in", check("""SELECT "Phylum", count(*) AS n FROM v_tax WHERE "Phylum" NOT IN ('ECONOMY', 'SMALL') OR "Phylum" IS NULL GROUP BY "Phylum" """, "", '"Phylum" n'))
def _(v):
    return T.freq_table(v.tax.filter(K.not_in("Phylum", ["ECONOMY", "SMALL"])), "Phylum")


@query("f4_drop_na", check("SELECT k, price FROM v_master WHERE price IS NOT NULL", "price", "k"))
def _(v):
    return v.master.select("k", "price").na.drop(subset=["price"])


@query("f5_complete_cases", check("SELECT k, price, qty, disc, balance FROM v_full", "price qty disc balance", "k"))
def _(v):
    return K.complete_cases(v.master.select("k", "price", "qty", "disc", "balance"))


@query("f6_threshold", check('SELECT * FROM v_counts WHERE "count" > 40', "", 'feature_id sample_id "count"'))
def _(v):
    return v.counts.filter(F.col("count") > 40)


@query("f7_known", check("""SELECT "Genus", count(*) AS n FROM v_tax WHERE "Genus" IS NOT NULL AND "Genus" NOT IN ('', 'uncharacterized') GROUP BY "Genus" """, "", '"Genus" n'))
def _(v):
    return T.freq_table(v.tax.filter(T.known("Genus")), "Genus")


@query("f8_split_by", check("""SELECT CASE WHEN price > 250 THEN 'high' ELSE 'low' END AS "group", count(*) AS n, avg(balance) AS balance
    FROM v_master GROUP BY 1""", "balance", '"group" n'))
def _(v):
    return T.split_by(v.master, F.col("price") > 250, "high", "low").groupBy("group").agg(
        F.count(F.lit(1)).alias("n"), F.avg("balance").alias("balance"))


FEATURES_SEEN = """SELECT * FROM v_counts WHERE feature_id IN (SELECT feature_id FROM v_counts GROUP BY feature_id
    HAVING count(CASE WHEN "count" > 35 THEN 1 END) > 0.3 * (SELECT count(DISTINCT sample_id) FROM v_counts))"""


@query("f9_filter_features", check(FEATURES_SEEN, "", 'feature_id sample_id "count"'))
def _(v):
    return C.filter_features(v.stored_counts, min_count=35, min_frac=0.3)


@query("f9_filter_features_default", check("""SELECT feature_id, count(*) AS n FROM v_counts WHERE feature_id IN (SELECT feature_id FROM v_counts
    GROUP BY feature_id HAVING count(CASE WHEN "count" > 3 THEN 1 END) > 0.5 * (SELECT count(DISTINCT sample_id) FROM v_counts)) GROUP BY 1""", "", "feature_id n"))
def _(v):
    return C.filter_features(v.stored_counts).groupBy("feature_id").agg(F.count(F.lit(1)).alias("n"))


@query("f10_filter_features_by_total", check('SELECT * FROM v_counts WHERE feature_id IN (SELECT feature_id FROM v_counts GROUP BY 1 HAVING sum("count") > 700)', "", 'feature_id sample_id "count"'))
def _(v):
    return C.filter_features_by_total(v.stored_counts, 700)


@query("f11_filter_prevalence", check("""SELECT s.* FROM v_counts s JOIN v_tax USING (feature_id) WHERE "Phylum" IN ('ECONOMY', 'SMALL', 'LARGE')
    AND feature_id IN (SELECT feature_id FROM v_counts GROUP BY 1 HAVING count(*) >= 0.7 * (SELECT count(DISTINCT sample_id) FROM v_counts))""", "", 'feature_id sample_id "count"'))
def _(v):
    allowed = v.tax.filter(F.col("Phylum").isin("ECONOMY", "SMALL", "LARGE"))
    n = C.n_samples(v.stored_counts)
    return C.filter_prevalence(v.stored_counts, 0.7, allowed, total_samples=n)


IN_TOP = """(SELECT sample_id, min("count") AS cut FROM (SELECT sample_id, "count", row_number() OVER (PARTITION BY sample_id ORDER BY "count" DESC) AS r
    FROM v_counts) WHERE r <= ceil((SELECT count(DISTINCT feature_id) FROM v_counts) * 0.1) GROUP BY sample_id)"""


@query("f12_filter_top_fraction", check(f"""SELECT c.* FROM v_counts c WHERE feature_id IN (SELECT feature_id FROM v_counts x JOIN {IN_TOP} t
    ON x.sample_id = t.sample_id AND x."count" >= t.cut GROUP BY feature_id HAVING count(*) >= 4)""", "", 'feature_id sample_id "count"'))
def _(v):
    return C.filter_top_fraction(v.stored_counts, 0.1, min_samples=4)


@query("f13_subset_samples", check("""SELECT c.* FROM v_counts c JOIN v_env USING (sample_id) WHERE region <> 'ASIA' AND sample_id NOT IN ('NATION_1', 'NATION_7')""", "", 'feature_id sample_id "count"'))
def _(v):
    out = C.subset_samples(v.community, F.col("region") != "ASIA").counts
    return C.drop_samples(out, S.literal_set(v.spark, "sample_id", ["NATION_1", "NATION_7"]))


@query("f14_subset_taxa", check("""SELECT c.* FROM v_counts c JOIN v_tax USING (feature_id) WHERE "Class" = 'Brand#4'""", "", 'feature_id sample_id "count"'))
def _(v):
    return C.subset_taxa(v.community, F.col("Class") == "Brand#4").counts


@query("f15_filter_samples_by_depth", check("""SELECT sample_id, sum("count") AS total FROM v_counts GROUP BY 1 HAVING sum("count") >
    (SELECT avg(t) FROM (SELECT sum("count") AS t FROM v_counts GROUP BY sample_id))""", "total", "sample_id"))
def _(v):
    mean = C.sum_by_sample(v.stored_counts).agg(F.avg("total")).first()[0]
    return C.sum_by_sample(C.filter_samples_by_depth(v.stored_counts, mean))


# --- joins --------------------------------------------------------------------------------------


@query("j1_left_join_four_keys", check("""SELECT c.event_id, m.moisture FROM v_clean c LEFT JOIN v_moist m ON c.lake_name = m.lake_name
    AND c.treatment = m.treatment AND c.date IS NOT DISTINCT FROM m.date AND c.rep = m.rep""", "moisture", "event_id"))
def _(v):
    joined = K.join_on(clean_incubations(v.raw_with_id), clean_moisture(v.raw_moisture), ["lake_name", "treatment", "date", "Rep"])
    return joined.select("event_id", K.num("Moisture_Content").alias("moisture"))


@query("j2_left_join_two_keys", check("""SELECT c.lake_name, c."Year", c."DOC", y.lake_name AS sampled FROM v_chem c LEFT JOIN v_years y
    ON c.lake_name = y.lake_name AND c."Year" = y."Year" """, "DOC", 'lake_name "Year" sampled'))
def _(v):
    years = v.years.withColumn("sampled", F.col("lake_name"))
    return K.join_on(v.chem.select("lake_name", "Year", "DOC"), years, ["lake_name", "Year"])


@query("j3_left_join_one_key", check('SELECT c.lake_name, "Year", "SUVA" FROM v_chem c LEFT JOIN v_suva s ON c.lake_name = s.lake_name', "SUVA", 'lake_name "Year"'))
def _(v):
    return K.join_on(v.chem.select("lake_name", "Year"), v.suva, ["lake_name"])


@query("j4_full_join", check("""SELECT coalesce(s.lake_name, y.lake_name) AS lake_name, spike, "Year" FROM v_spike s FULL JOIN v_years y
    ON s.lake_name = y.lake_name""", "spike", 'lake_name "Year"'))
def _(v):
    return K.join_on(v.spike, v.years, ["lake_name"], "full")


@query("j4_full_join_null_keys", check("""SELECT coalesce(a."Phylum", b."Phylum") AS "Phylum", n, brands FROM
    (SELECT "Phylum", count(*) AS n FROM v_tax WHERE "Class" = 'Brand#4' GROUP BY 1) a FULL JOIN
    (SELECT "Phylum", count(DISTINCT "Class") AS brands FROM v_tax GROUP BY 1) b ON a."Phylum" IS NOT DISTINCT FROM b."Phylum" """, "", '"Phylum" n brands'))
def _(v):
    """A missing key matches a missing key."""
    a = v.tax.filter(F.col("Class") == "Brand#4").groupBy("Phylum").agg(F.count(F.lit(1)).alias("n"))
    b = v.tax.groupBy("Phylum").agg(F.count_distinct("Class").alias("brands"))
    return K.join_on(a, b, ["Phylum"], "full")


@query("j5_full_join_row_key", check("""SELECT coalesce(a.sample_id, b.sample_id) AS sample_id, balance, lat FROM
    (SELECT sample_id, balance FROM v_env WHERE balance > 4.5) a FULL JOIN v_xy b ON a.sample_id = b.sample_id""", "balance lat", "sample_id"))
def _(v):
    return K.join_on(v.env.filter("balance > 4.5").select("sample_id", "balance"), v.xy.select("sample_id", "lat"), ["sample_id"], "full")


@query("j6_align", check("""SELECT c.* FROM v_counts c JOIN v_tax USING (feature_id) JOIN v_env USING (sample_id)
    JOIN v_tree ON node = feature_id AND is_tip WHERE "Phylum" IS NOT NULL AND region <> 'AFRICA'""", "", 'feature_id sample_id "count"'))
def _(v):
    part = C.Community(v.counts, v.tax.filter("Phylum is not null"), v.tree, v.env.filter("region <> 'AFRICA'"))
    return C.align(part).counts


@query("j7_semi_join", check("""SELECT c.* FROM v_counts c WHERE feature_id IN (SELECT feature_id FROM v_tax WHERE "Genus" IS NULL)""", "", 'feature_id sample_id "count"'))
def _(v):
    return C.keep_features(v.counts, v.tax.filter("Genus is null"))


@query("j8_anti_join", check("""SELECT c.* FROM v_counts c WHERE sample_id NOT IN (SELECT sample_id FROM v_env WHERE region = 'EUROPE')""", "", 'feature_id sample_id "count"'))
def _(v):
    return C.drop_samples(v.counts, v.env.filter("region = 'EUROPE'"))


@query("j9_melt", check("""SELECT feature_id, sample_id, "count" AS "Abundance", "Phylum", "Class", "Genus", region FROM v_counts
    JOIN v_tax USING (feature_id) JOIN v_env USING (sample_id)""", "", 'feature_id sample_id "Abundance" "Phylum" "Class" "Genus" region'))
def _(v):
    return C.melt(v.community).drop("balance", "price", "qty", "disc")


@query("j10_pair_sums", check("""SELECT a.sample_id AS i, b.sample_id AS j, sum(least(a."count", b."count")) AS s FROM v_counts a JOIN v_counts b
    ON a.feature_id = b.feature_id AND a.sample_id < b.sample_id GROUP BY 1, 2""", "s", "i j"))
def _(v):
    return pair_sums(v.counts, "sample_id", "feature_id", "count", "min")


# --- sorts, limits, sets ------------------------------------------------------------------------


@query("t1_top_features", check('SELECT feature_id, sum("count") AS total FROM v_counts GROUP BY 1 ORDER BY total DESC, feature_id LIMIT 30', "total", "feature_id"))
def _(v):
    return C.top_features(v.counts, 30)


@query("t1_prune_to_top_features", check("""SELECT c.* FROM v_counts c WHERE feature_id IN (SELECT feature_id FROM v_counts GROUP BY 1
    ORDER BY sum("count") DESC, feature_id LIMIT 50)""", "", 'feature_id sample_id "count"'))
def _(v):
    return C.keep_features(v.stored_counts, C.top_features(v.stored_counts, 50))


@query("t2_top_groups", check("""SELECT "Phylum", sum("count") AS total FROM v_counts JOIN v_tax USING (feature_id) WHERE "Phylum" IS NOT NULL
    GROUP BY 1 ORDER BY total DESC, "Phylum" LIMIT 5""", "total", '"Phylum"'))
def _(v):
    return C.top_groups(v.counts, v.tax, "Phylum", 5)


@query("t3_sort_keys", check("SELECT lake_name, spike FROM v_spike", "spike", "lake_name"))
def _(v):
    return v.spike.orderBy("lake_name")


@query("u1_union_by_name", check("""SELECT lake_name, spike, NULL AS "Year" FROM v_spike UNION ALL SELECT lake_name, NULL, "Year" FROM v_years""", "spike", 'lake_name "Year"'))
def _(v):
    return S.union_by_name([v.spike, v.years])


@query("u2_union_all", check("""SELECT lake_name, c199, time FROM v_means WHERE time = 0 UNION ALL SELECT lake_name, c199, time FROM v_means WHERE time = 24""", "c199 time", "lake_name"))
def _(v):
    means = v.incub.groupBy("lake_name", "time").agg(F.avg("X199_corrected_fixed_Conc").alias("c199"))
    return means.filter("time = 0").unionByName(means.filter("time = 24"))


@query("u3_set_difference_and_intersection", check("""SELECT lake_name, CASE WHEN lake_name IN (SELECT lake_name FROM v_spike) THEN 'both' ELSE 'left' END AS side
    FROM v_years""", "", "lake_name side"))
def _(v):
    keys = v.years.select("lake_name")
    both = keys.join(v.spike, "lake_name", "left_semi").withColumn("side", F.lit("both"))
    return both.unionByName(keys.join(v.spike, "lake_name", "left_anti").withColumn("side", F.lit("left")))


# --- scalar functions ---------------------------------------------------------------------------


@query("x1_regex_test", check("SELECT name, count(*) AS n FROM v_raw WHERE regexp_matches(name, 'SP[0-9]+$') GROUP BY 1", "", "name n"))
def _(v):
    return v.raw.select(F.upper("Sample_Name").alias("name")).filter(F.col("name").rlike("SP[0-9]+$")).groupBy("name").agg(F.count(F.lit(1)).alias("n"))


PARTS_SQL = """SELECT name, CASE WHEN regexp_matches(name, ' ') THEN regexp_extract(name, '([A-Za-z0-9]*)[ \\t]', 1) END AS part, count(*) AS n FROM v_raw GROUP BY 1, 2"""


@query("x2_lake_of", check(PARTS_SQL, "", "name part n"))
def _(v):
    s = v.raw.select(F.upper("Sample_Name").alias("name"))
    return s.select("name", X.lake_of("name").alias("part")).groupBy("name", "part").agg(F.count(F.lit(1)).alias("n"))


@query("x3_condition_of", check("""SELECT name, CASE WHEN regexp_matches(name, ' ') THEN regexp_extract(name, '[ \\t]([A-Za-z0-9]*)', 1) END AS part, count(*) AS n
    FROM v_raw GROUP BY 1, 2""", "", "name part n"))
def _(v):
    s = v.raw.select(F.upper("Sample_Name").alias("name"))
    return s.select("name", X.condition_of("name").alias("part")).groupBy("name", "part").agg(F.count(F.lit(1)).alias("n"))


@query("x4_time_and_treatment", check("""SELECT c, regexp_extract(c, '[0-9]*$') AS time, regexp_extract(c, '^[A-Za-z]*') AS treatment, count(*) AS n FROM
    (SELECT CASE WHEN regexp_matches(name, ' ') THEN regexp_extract(name, '[ \\t]([A-Za-z0-9]*)', 1) END AS c FROM v_raw) GROUP BY 1, 2, 3""", "", "c time treatment n"))
def _(v):
    c = v.raw.select(X.condition_of(F.upper("Sample_Name")).alias("c"))
    return c.groupBy("c", X.time_of("c").alias("time"), X.treatment_of("c").alias("treatment")).agg(F.count(F.lit(1)).alias("n"))


@query("x5_upper", "SELECT DISTINCT upper(event_type) AS event_type FROM events")
def _(v):
    return v.table("events").select(F.upper("event_type").alias("event_type")).distinct()


@query("x6_concat", check('SELECT lake_name || \'-\' || CAST("Year" AS VARCHAR) AS label, "DOC" FROM v_chem', "DOC", "label"))
def _(v):
    return v.chem.select(F.concat_ws("-", "lake_name", F.col("Year").cast("string")).alias("label"), "DOC")


@query("x7_replace_in_name", check("SELECT lake_name, replace(lake_name, 'L1', 'L1_2016') AS renamed FROM v_years", "", "lake_name renamed"))
def _(v):
    """A name prefix also changes the longer names that hold it."""
    return v.years.select("lake_name", F.replace("lake_name", F.lit("L1"), F.lit("L1_2016")).alias("renamed"))


@query("x8_split_lineage", """SELECT 'P' || CAST(p_partkey AS VARCHAR) AS feature_id, p_type AS "Kingdom", p_brand AS "Phylum",
    CASE WHEN p_size % 10 <> 0 THEN p_name END AS "Class", CAST(NULL AS VARCHAR) AS "Order" FROM part""")
def _(v):
    return X.split_lineage(v.lineages, "lineage").select("feature_id", "Kingdom", "Phylum", "Class", "Order")


@query("x9_day_month_year", check("SELECT event_id, CASE WHEN date IS NULL THEN NULL ELSE strftime(date, '%Y-%m-%d') END AS date FROM v_raw", "", "event_id date"))
def _(v):
    return v.raw_with_id.select("event_id", X.day_month_year("Day", "Month", "Year").cast("string").alias("date"))


@query("x10_num", check("SELECT event_id, hg202 FROM v_raw", "hg202", "event_id"))
def _(v):
    return v.raw_with_id.select("event_id", K.num("202_Hg_ug_kg").alias("hg202"))


@query("x11_logarithms", check("""SELECT k, CASE WHEN balance = 0 THEN CAST('-Infinity' AS DOUBLE) WHEN balance < 0 THEN CAST('NaN' AS DOUBLE) ELSE ln(balance) END AS ln_b,
    ln(price + 1) AS ln1p_p, log10(price + 1) AS log10_p, ln(price + 1) ** 2 AS ln2_p FROM v_master""", "ln_b ln1p_p log10_p ln2_p", "k"))
def _(v):
    p = F.col("price")
    return v.master.select("k", K.r_ln("balance").alias("ln_b"), F.log1p(p).alias("ln1p_p"), F.log10(p + 1).alias("log10_p"),
                           F.pow(F.ln(p + 1), F.lit(2)).alias("ln2_p"))


@query("x12_sqrt", check("SELECT k, sqrt(price) AS root FROM v_master", "root", "k"))
def _(v):
    return v.master.select("k", F.sqrt("price").alias("root"))


@query("x13_power_of_ten", check('SELECT lake_name, "Year", 10 ** (-"pH") * 1000000 AS proton_um FROM v_chem', "proton_um", 'lake_name "Year"'))
def _(v):
    return v.chem.select("lake_name", "Year", (F.pow(F.lit(10.0), -F.col("pH")) * 1000000).alias("proton_um"))


@query("x14_clamp", check("SELECT k, CASE WHEN balance < 0 THEN 0 ELSE balance END AS low, CASE WHEN price - 250 >= 0 THEN 0 ELSE price - 250 END AS high FROM v_master", "low high", "k"))
def _(v):
    return v.master.select("k", K.clamp_low("balance").alias("low"), K.clamp_high(F.col("price") - 250).alias("high"))


@query("x15_replace_sentinel", check("SELECT lake_name, time, ln198 FROM v_fixed", "time ln198", "lake_name"))
def _(v):
    means = v.incub.groupBy("lake_name", "time").agg(K.strict_avg("ln_198").alias("m"))
    return means.select("lake_name", "time", K.replace_value("m", float("-inf"), LOG_FLOOR).alias("ln198"))


@query("x16_null_to_zero", check("SELECT k, coalesce(price, 0) AS price FROM v_master", "price", "k"))
def _(v):
    return v.master.select("k", F.coalesce("price", F.lit(0.0)).alias("price"))


@query("x17_round", check("SELECT k, round(price * 1.0001, 2) AS price FROM v_master", "price", "k"))
def _(v):
    return v.master.select("k", F.round(F.col("price") * 1.0001, 2).alias("price"))


@query("x18_moisture_factor", check("SELECT event_id, factor, x199 FROM v_corr", "factor x199", "event_id"))
def _(v):
    out = moisture_correct(clean_incubations(v.raw_with_id), clean_moisture(v.raw_moisture))
    return out.select("event_id", F.col("moisture_factor").alias("factor"), F.col("corrected_199").alias("x199"))


@query("x19_dilution", check("SELECT event_id, spiked_con FROM v_clean", "spiked_con", "event_id"))
def _(v):
    return clean_incubations(v.raw_with_id).select("event_id", "spiked_con")


@query("x21_bin_labels", check("""SELECT band, count(*) AS n FROM (SELECT CASE WHEN price > 0 AND price <= 75 THEN 'cheap' WHEN price > 75 AND price <= 150 THEN 'middling'
    WHEN price > 150 AND price <= 275 THEN 'dear' END AS band FROM v_master) GROUP BY 1""", "", "band n"))
def _(v):
    band = X.bin_label("price", [0, 75, 150, 275], ["cheap", "middling", "dear"])
    return v.master.groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("n"))
