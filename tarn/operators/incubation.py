"""Time-course incubations: raw instrument rows to spike recoveries and rate constants."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..functions.compat import (
    clamp_low, complete_cases, is_present, join_on, num, r_div, r_ln, replace_value, strict_avg,
)
from .tables import mean_by, select_first

# The concentration assumed for a mean of zero, and the hours a rate constant is given for.
LOG_FLOOR = math.log(0.0000001)
HOURS = 24.0

MEASURES = {"conc199": "X199_corrected_fixed_Conc", "conc198": "X198_corrected_fixed_Conc", "ln198": "ln_198"}


def parse_names(df: DataFrame, with_time: bool) -> DataFrame:
    """Sample name to lake, treatment (and time); day, month, year to a date; text upper-cased."""
    out = df.withColumns(
        {
            "date": text.day_month_year("Day", "Month", "Year"),
            "lake_name": text.lake_of("Sample_Name"),
            "__condition": text.condition_of("Sample_Name"),
        }
    ).withColumn("treatment", text.treatment_of("__condition"))
    keys = ["lake_name", "treatment"]
    if with_time:
        out = out.withColumn("time", text.time_of("__condition"))
        keys.append("time")
    return text.upper_all(select_first(out, keys, ["Day", "Month", "Year", "__condition", "Sample_Name"]))


def clean_incubations(raw: DataFrame, standard: str = "198") -> DataFrame:
    """Spiked and control rows without the standards, keys parsed, spike concentration computed."""
    kept = raw.filter(F.col("Sample_Name").contains("SP") & ~F.col("Sample_Name").contains(standard))
    return parse_names(kept, with_time=True).withColumn(
        "spiked_con", r_div(num("Volume") * num("Spike_Conc"), num("Weight_sample"))
    )


def clean_moisture(raw: DataFrame) -> DataFrame:
    return parse_names(raw, with_time=False)


def moisture_correct(incubations: DataFrame, moisture: DataFrame) -> DataFrame:
    """Wet-weight to dry-weight concentrations, negatives set to zero, logarithm per replicate."""
    joined = join_on(incubations, moisture, ["lake_name", "treatment", "date", "Rep"], "left")
    factor = (100 - num("Moisture_Content")) / 100
    corrected = joined.withColumn("moisture_factor", factor).withColumns(
        {
            "corrected_198": F.col("moisture_factor") * num("198_Hg_ug_kg"),
            "corrected_199": F.col("moisture_factor") * num("199_Hg_ug_Kg"),
            "corrected_202": F.col("moisture_factor") * num("202_Hg_ug_kg"),
        }
    )
    return corrected.withColumns(
        {
            "X199_corrected_fixed_Conc": clamp_low("corrected_199"),
            "X198_corrected_fixed_Conc": clamp_low("corrected_198"),
        }
    ).withColumn("ln_198", r_ln("X198_corrected_fixed_Conc"))


def spiked_only(corrected: DataFrame, control: str = "USP") -> DataFrame:
    return corrected.filter(~F.col("treatment").contains(control))


def spike_table(spikes: DataFrame, moisture: DataFrame) -> DataFrame:
    """Nominal spike concentration per lake for both instruments, with the lake's mean moisture."""
    numeric = moisture.withColumn("Moisture_Content", num("Moisture_Content"))
    mean_moisture = mean_by(numeric, "Moisture_Content", ["lake_name"])
    return join_on(text.upper_all(spikes), mean_moisture, ["lake_name"], "left").withColumns(
        {
            "corrected_MA300": r_div(num("Volume") * num("Spike_MA"), num("Mass")),
            "corrected_ICP": r_div(num("Volume") * num("Spike_ICP"), num("Mass")),
        }
    )


def instrument_spike(spikes: DataFrame, column: str) -> DataFrame:
    """``lake_name, spike`` of one instrument; a missing concentration counts as zero."""
    return spikes.select("lake_name", F.coalesce(F.col(column), F.lit(0.0)).alias("spike"))


def replicate_means(incubations: DataFrame) -> DataFrame:
    """Mean over replicates per lake and time; a missing replicate makes the mean missing."""
    return (
        incubations.groupBy("lake_name", num("time").alias("time"))
        .agg(*[strict_avg(c).alias(c) for c in MEASURES.values()])
    )


def spike_recovery(means: DataFrame, spike: DataFrame, digits: int = 6) -> DataFrame:
    """Percent of the nominal spike found at time zero; missing where the lake has no spike row."""
    start = means.groupBy("lake_name").agg(
        F.max(F.when(F.col("time") == 0, F.col("X198_corrected_fixed_Conc"))).alias("__start")
    )
    # an infinite or undefined ratio has no digits to round
    ratio = r_div("__start", "spike") * 100
    finite = F.abs(ratio) < float("inf")
    return join_on(start, spike, ["lake_name"], "left").select(
        "lake_name", F.when(finite, F.round(ratio, digits)).otherwise(ratio).alias("recovery")
    )


def _slopes(rows: DataFrame, windows) -> DataFrame:
    """Both slopes per lake for every window, in one pass over the replicate means."""
    fixed = rows.withColumn("ln_198", replace_value("ln_198", float("-inf"), LOG_FLOOR))
    aggs = []
    for w in windows:
        # the 24-hour window leaves the 48-hour samples out
        pick = (lambda c: F.when(F.col("time") != 48, F.col(c))) if w == 24 else F.col
        aggs += [
            F.regr_slope(pick("X199_corrected_fixed_Conc"), F.col("time")).alias(f"methylation_{w}"),
            F.regr_slope(pick("ln_198"), F.col("time")).alias(f"demethylation_{w}"),
        ]
    return fixed.groupBy("lake_name").agg(*aggs)


def rates(means: DataFrame, window: int = 24) -> DataFrame:
    """Slope of concentration and of log concentration on time, per lake.

    NULL when a lake has fewer than two times in the window.
    """
    kept = means.filter(F.col("time") != 48) if window == 24 else means
    slopes = _slopes(kept, [window])
    return slopes.withColumnsRenamed({f"methylation_{window}": "methylation", f"demethylation_{window}": "demethylation"})


def _constants(window: int) -> list:
    """The four columns of one window, from its slopes and ``spike``."""
    up, down = F.col(f"methylation_{window}"), F.col(f"demethylation_{window}")
    return [
        up.alias(f"methylation_{window}"),
        F.when(down >= 0, 0.0).otherwise(down).alias(f"demethylation_{window}"),
        (r_div(up, "spike") * HOURS).alias(f"km_{window}"),
        F.when(down >= 0, 0.0).otherwise(down * -HOURS).alias(f"kd_{window}"),
    ]


def rate_constants(rate: DataFrame, spike: DataFrame, window: int = 24) -> DataFrame:
    """Methylation and demethylation constants per lake; every lake of either table is kept."""
    complete = complete_cases(rate).withColumnsRenamed({c: f"{c}_{window}" for c in ("methylation", "demethylation")})
    return join_on(complete, spike, ["lake_name"], "full").select("lake_name", *_constants(window))


def rate_table(rates_24: DataFrame, rates_48: DataFrame) -> DataFrame:
    return join_on(rates_24, rates_48, ["lake_name"], "full")


def incubation_rate_table(means: DataFrame, spike: DataFrame) -> DataFrame:
    """What joining both windows' constants gives, from one aggregate and one join."""
    windows = (24, 48)
    slopes = _slopes(means, windows)
    complete = {w: is_present(f"methylation_{w}") & is_present(f"demethylation_{w}") for w in windows}
    # a window with a missing slope has no row, so both its slopes are missing
    slopes = slopes.select("lake_name", *[
        F.when(complete[w], F.col(f"{c}_{w}")).alias(f"{c}_{w}") for w in windows for c in ("methylation", "demethylation")])
    some = slopes.filter(F.col("methylation_24").isNotNull() | F.col("methylation_48").isNotNull())
    both = join_on(some, spike, ["lake_name"], "full")
    return both.select("lake_name", *[c for w in windows for c in _constants(w)])
