"""What the plans of the hot paths must look like at any scale."""

import re

import pytest

from tarn.operators import community as C, gram as G, incubation as I, linmod as L
from tarn.plans import QUERIES
from tarn.plans.bindings import Views

from test_queries import SF, pytestmark  # noqa: F401


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def views(spark):
    return Views(spark, SF)


def test_rates_stay_in_the_jvm_and_aggregate_before_they_shuffle(spark):
    text = plan(QUERIES["c7_rate_table"](spark, SF))
    assert "Python" not in text and "InPandas" not in text and "Window" not in text
    assert text.count("partial_regr_slope") and text.count("partial_avg")
    # one pass over the incubations serves both windows, one scan is left for the spikes
    assert len(re.findall(r"FileScan parquet", text)) == 2


def test_only_needed_columns_are_read(spark, views):
    text = plan(QUERIES["a12_slope_by"](spark, SF))
    schema = re.search(r"ReadSchema: struct<([^>]*)>", text).group(1)
    assert "props" not in schema and "event_type" not in schema and "value" in schema
    text = plan(C.sum_by_sample(views.counts))
    assert "l_extendedprice" not in text and "o_totalprice" not in text and "c_name" not in text


def test_filters_reach_the_scan(views):
    # through the view's renamed column
    text = plan(views.incub.filter("treatment = 'purchase'"))
    assert re.search(r"PushedFilters: \[[^\]]*EqualTo\(event_type,purchase\)", text)
    # a filter on a grouping key moves below the aggregate
    text = plan(I.replicate_means(views.incub).filter("lake_name = 'L3'"))
    assert text.index("HashAggregate") < text.index("Filter") < text.index("FileScan")


def test_no_window_over_a_whole_sample_or_feature(views):
    for df in (C.relative_abundance(views.counts), C.filter_features(views.stored_counts), C.richness(views.counts)):
        assert "Window" not in plan(df)


def test_group_models_shuffle_only_sums(views):
    rows = G.gram_rows(views.master, G.columns_of([G.var("price"), G.var("qty")]), ["segment"])
    text = plan(rows)
    assert "partial_covar_pop" in text and "InPandas" not in text


def test_a_fit_and_its_search_read_the_data_once(views, monkeypatch):
    reads = []
    original = L.gram
    monkeypatch.setattr(L, "gram", lambda *a, **k: reads.append(1) or original(*a, **k))
    m = L.ols(views.master, G.var("price"), G.full_factorial([G.var("qty"), G.var("balance"), G.var("disc")]))
    chosen, path = L.step_aic(m)
    assert len(path) > 1 and L.anova_nested(chosen, m)["f"] >= 0 and len(reads) == 1
