"""Hand-checked fixtures for the missing-value rules, parsing, sources and the incubation flow."""

import math

import pytest
from pyspark.sql import functions as F

from tarn.functions import compat as K, text as X
from tarn.operators import incubation as I, mastersheet as M, tables as T
from tarn.session import cut_lineage, shared_dir
from tarn.sources import files as S

INF, NAN = float("inf"), float("nan")


def column(spark, values, kind, fn):
    rows = list(enumerate(values))
    df = spark.createDataFrame(rows, f"k int, v {kind}")
    return [r[0] for r in df.select("k", fn(F.col("v")).alias("o")).orderBy("k").select("o").collect()]


def test_logarithm_and_division(spark):
    got = column(spark, [0.0, -1.0, math.e, None], "double", K.r_ln)
    assert got[0] == -INF and math.isnan(got[1]) and got[2] == 1 and got[3] is None
    df = spark.createDataFrame([(1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (NAN, 0.0), (1.0, 2.0), (None, 0.0), (1.0, None)], "a double, b double")
    got = [r[0] for r in df.select(K.r_div("a", "b")).collect()]
    assert got[:2] == [INF, -INF] and math.isnan(got[2]) and math.isnan(got[3]) and got[4:] == [0.5, None, None]


def test_means_lists_and_casts(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("b", 2.0), ("b", -INF), ("c", None)], "g string, v double")
    got = {r["g"]: r["m"] for r in df.groupBy("g").agg(K.strict_avg("v").alias("m")).collect()}
    assert got == {"a": None, "b": -INF, "c": None}
    assert {r["g"] for r in T.mean_by(df, "v", ["g"]).collect()} == {"a", "b"}
    assert column(spark, ["x", "y", None], "string", lambda c: K.not_in(c, ["x"])) == [False, True, True]
    assert column(spark, ["1.5", "abc", "", None], "string", K.num) == [1.5, None, None, None]
    assert column(spark, [-1.0, 2.0, None], "double", K.clamp_low) == [0.0, 2.0, None]
    assert column(spark, [-1.0, 2.0, None], "double", K.clamp_high) == [-1.0, 0.0, None]


def test_complete_cases_keeps_infinities(spark):
    df = spark.createDataFrame([(1.0, INF), (NAN, 1.0), (None, 1.0)], "a double, b double")
    assert K.complete_cases(df).count() == 1


def test_null_keys_match(spark):
    a = spark.createDataFrame([("x", 1), (None, 2), ("z", 3)], "k string, a int")
    b = spark.createDataFrame([("x", 10), (None, 20), ("w", 30)], "k string, b int")
    left = {(r["k"], r["a"], r["b"]) for r in K.join_on(a, b, ["k"]).collect()}
    assert left == {("x", 1, 10), (None, 2, 20), ("z", 3, None)}
    full = {(r["k"], r["a"], r["b"]) for r in K.join_on(a, b, ["k"], "full").collect()}
    assert full == left | {("w", None, 30)}
    assert K.join_on(a, b, ["k"], "left_anti").collect()[0]["k"] == "z"
    with pytest.raises(ValueError):
        K.join_on(a, a, ["k"])


def test_names(spark):
    names = ["FRAME SP24", "YK-42 SP0", "BC18 USP48", "RAT SP", "NOBLANK", " SP1", None]
    assert column(spark, names, "string", X.lake_of) == ["FRAME", "42", "BC18", "RAT", None, "", None]
    cond = column(spark, names, "string", X.condition_of)
    assert cond == ["SP24", "SP0", "USP48", "SP", None, "SP1", None]
    assert column(spark, cond, "string", X.time_of) == ["24", "0", "48", "", None, "1", None]
    assert column(spark, cond, "string", X.treatment_of) == ["SP", "SP", "USP", "SP", None, "SP", None]


def test_dates_lineages_labels(spark):
    df = spark.createDataFrame([("3", "7", "2018"), ("03", "July", "2018"), ("3", "7", "20. 19")], "d string, m string, y string")
    got = [str(r[0]) for r in df.select(X.day_month_year("d", "m", "y")).collect()]
    assert got == ["2018-07-03", "2018-07-03", "None"]
    lin = spark.createDataFrame([("f", "a;b;c;d;e;f;g;h;i"), ("s", "a; b;c")], "feature_id string, lineage string")
    rows = {r["feature_id"]: r for r in X.split_lineage(lin, "lineage").collect()}
    assert rows["f"]["Species"] == "g" and rows["s"]["Phylum"] == " b" and rows["s"]["Order"] is None
    assert X.split_lineage(lin, "lineage", trim=True).filter("feature_id = 's'").first()["Phylum"] == "b"
    label = spark.range(1).select(X.percent_label("CAP 1", F.lit(0.61204), F.lit(0.5))).first()[0]
    assert label == "CAP 1 (61.2 % of fitted, 50 % of total variation)"
    assert column(spark, [100.0, 100.5, 0.0], "double", lambda c: X.bin_label(c, [0, 100, 200], ["low", "mid"])) == ["low", "mid", None]


def test_keys_and_splits(spark):
    ok = spark.createDataFrame([("a", 1), ("b", None)], "k string, v int")
    assert T.set_key(ok, "k").count() == 2
    for bad in ([("a", 1), ("a", 2)], [(None, 1)]):
        with pytest.raises(Exception, match="is no key"):
            T.set_key(spark.createDataFrame(bad, "k string, v int"), "k").collect()
    got = {(r["k"], r["group"]) for r in T.split_by(ok, F.col("v") == 1, "y", "n").collect()}
    assert got == {("a", "y"), ("b", "n")}


def test_sources(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.csv").write_bytes("Sample_Name,Rep\nLac \xe9 SP0,1\n".encode("latin1"))
    (tmp_path / "in" / "2.csv").write_bytes(b"Rep,Sample_Name,Volume\n2,X SP24,7\n")
    (tmp_path / "in" / "3.csv").write_bytes(b"Sample_Name,Rep\nY SP48,3\n")
    df = S.scan_csv_dir(spark, str(tmp_path / "in"), lineage=True)
    got = {(r["Sample_Name"], r["Rep"], r["Volume"]) for r in df.collect()}
    assert got == {("Lac \xe9 SP0", "1", None), ("X SP24", "2", "7"), ("Y SP48", "3", None)}
    assert df.select("source_file").distinct().count() == 3
    sheet = spark.createDataFrame([("a", 1.5), ("b", None)], "lake_name string, v double")
    back = S.scan_csv(spark, S.sink_csv(sheet, str(tmp_path / "out"), ["lake_name"]), "lake_name STRING, v DOUBLE")
    assert sorted(back.collect()) == sorted(sheet.collect())
    assert S.scan_csv(spark, str(tmp_path / "out")).dtypes == [("lake_name", "string"), ("v", "double")]
    assert S.hand_off(sheet, str(tmp_path / "stage")).count() == 2
    assert S.scan_tsv(spark, S.sink_tsv(sheet, str(tmp_path / "tsv"))).count() == 2
    with pytest.raises(Exception):
        S.sink_csv(sheet, str(tmp_path / "out"))


def test_lineage_is_cut_in_the_shared_folder(spark):
    df = cut_lineage(spark.range(5))
    assert df.count() == 5 and spark.sparkContext.getCheckpointDir()
    assert shared_dir(spark)


RAW = "Sample_Name string, Day string, Month string, Year string, Rep string, Volume string, Spike_Conc string, Weight_sample string," \
      " `198_Hg_ug_kg` string, `199_Hg_ug_Kg` string, `202_Hg_ug_kg` string"


def test_clean_and_correct(spark):
    rows = [
        ("Frame SP0", "1", "7", "2018", "1", "2", "3", "6", "4", "8", "1"),
        ("Frame USP24", "1", "7", "2018", "1", "2", "3", "0", "-4", "8", "x"),
        ("198 std SP0", "1", "7", "2018", "1", "2", "3", "6", "4", "8", "1"),
        ("Frame BLANK", "1", "7", "2018", "1", "2", "3", "6", "4", "8", "1"),
    ]
    raw = spark.createDataFrame(rows, RAW)
    moist = spark.createDataFrame([("frame SP", "1", "July", "2018", "1", "25"), ("frame USP", "1", "7", "2018", "1", "50")],
                                  "Sample_Name string, Day string, Month string, Year string, Rep string, Moisture_Content string")
    clean = I.clean_incubations(raw)
    assert {(r["lake_name"], r["treatment"], r["time"], r["spiked_con"]) for r in clean.collect()} == {
        ("FRAME", "SP", "0", 1.0), ("FRAME", "USP", "24", INF)}
    out = {r["treatment"]: r for r in I.moisture_correct(clean, I.clean_moisture(moist)).collect()}
    assert out["SP"]["corrected_199"] == 6 and out["SP"]["X198_corrected_fixed_Conc"] == 3 and math.isclose(out["SP"]["ln_198"], math.log(3))
    assert out["USP"]["X198_corrected_fixed_Conc"] == 0 and out["USP"]["ln_198"] == -INF and out["USP"]["corrected_202"] is None
    assert I.spiked_only(I.moisture_correct(clean, I.clean_moisture(moist))).count() == 1
    spikes = spark.createDataFrame([("frame", 2.0, 4.0, 6.0, None), ("rat", 2.0, 0.0, 6.0, 1.0)],
                                   "lake_name string, Volume double, Mass double, Spike_MA double, Spike_ICP double")
    table = {r["lake_name"]: r for r in I.spike_table(spikes, I.clean_moisture(moist)).collect()}
    assert table["FRAME"]["corrected_MA300"] == 3 and table["FRAME"]["corrected_ICP"] is None and table["FRAME"]["Moisture_Content"] == 37.5
    assert table["RAT"]["corrected_ICP"] == INF and table["RAT"]["Moisture_Content"] is None


@pytest.fixture(scope="module")
def curve(spark):
    rows = []
    for lake, t, values in [("A", 0.0, (10.0, 10.0)), ("A", 24.0, (5.0, 5.0)), ("A", 48.0, (0.0, 4.0)),
                            ("B", 0.0, (1.0, None)), ("B", 24.0, (2.0, 2.0)), ("C", 0.0, (3.0, 3.0))]:
        rows += [(lake, t, v, v, None if v is None else (-INF if v == 0 else math.log(v))) for v in values]
    return I.replicate_means(spark.createDataFrame(
        rows, "lake_name string, time double, X199_corrected_fixed_Conc double, X198_corrected_fixed_Conc double, ln_198 double"))


@pytest.fixture(scope="module")
def spike(spark):
    return spark.createDataFrame([("A", 10.0), ("B", 0.0), ("D", 2.0)], "lake_name string, spike double")


def test_rates_by_hand(curve, spike):
    means = {(r["lake_name"], r["time"]): r for r in curve.collect()}
    assert means[("A", 48.0)]["ln_198"] == -INF and means[("B", 0.0)]["ln_198"] is None
    got = {r["lake_name"]: r for r in I.incubation_rate_table(curve, spike).collect()}
    assert math.isclose(got["A"]["kd_24"], math.log(2)) and math.isclose(got["A"]["km_24"], -5 / 24 / 10 * 24)
    floor = math.log(1e-7)
    ys = [math.log(10), math.log(5), floor]
    slope = (ys[2] - ys[0]) / 48
    assert math.isclose(got["A"]["demethylation_48"], slope) and math.isclose(got["A"]["kd_48"], -24 * slope)
    # one complete time point, or one time point at all: no slope; a lake without rates keeps its spike row
    assert got["B"]["km_24"] is None and "C" not in got and got["D"]["km_24"] is None


def test_one_pass_equals_two_windows(curve, spike):
    two = I.rate_table(I.rate_constants(I.rates(curve, 24), spike, 24), I.rate_constants(I.rates(curve, 48), spike, 48))
    key = lambda r: r["lake_name"]
    assert sorted(two.collect(), key=key) == sorted(I.incubation_rate_table(curve, spike).collect(), key=key)


def test_recovery(curve, spike):
    got = {r["lake_name"]: r["recovery"] for r in I.spike_recovery(curve, spike).collect()}
    assert got == {"A": 100.0, "B": None, "C": None}
    zero = I.spike_recovery(curve.filter("lake_name = 'A'"), spike.withColumn("spike", F.lit(0.0))).first()
    assert zero["recovery"] == INF


def test_mastersheet(spark):
    chem = spark.createDataFrame([("A", 2018, 7.0), ("A", 2019, 6.0), ("VEE", 2018, 5.0), (None, 2018, 4.0)], "lake_name string, Year int, pH double")
    rate = spark.createDataFrame([("A", 0.5, 0.0), ("Z", 1.0, 1.0)], "lake_name string, km_24 double, kd_24 double")
    years = spark.createDataFrame([("A", 2019)], "lake_name string, Year int")
    suva = spark.createDataFrame([("A", 2.0)], "lake_name string, SUVA double")
    got = {(r["lake_name"], r["Year"]): r for r in M.mastersheet(chem, rate, years, suva, exclude=["VEE"]).collect()}
    assert set(got) == {("A", 2018), ("A", 2019), (None, 2018)}
    assert got[("A", 2019)]["km_24"] == 0.5 and got[("A", 2018)]["km_24"] is None and got[("A", 2018)]["SUVA"] == 2
    assert math.isclose(got[("A", 2018)]["proton_M"], 1e-7)
    assert M.mastersheet(chem, rate, years, suva, require_rate="km_24").count() == 1
    seen = {r["lake_name"]: r["kd_observed"] for r in M.detected(rate).collect()}
    assert seen == {"A": "NO", "Z": "YES"}
