"""Every registered query against its SQL at the smallest scale; the views are shared between queries."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tools.check_oracle import duck, norm  # noqa: E402

from tarn.plans import ORACLES, QUERIES  # noqa: E402
from tarn.plans.bindings import Views  # noqa: E402

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables absent")


@pytest.fixture(scope="module")
def views(spark):
    return Views(spark, SF)


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, views, con):
    got = QUERIES[name].on_views(views)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    rows = got.collect()
    assert rows
    if name not in ORACLES:
        return
    rel = con.sql(ORACLES[name])
    cols = sorted(got.columns)
    assert cols == sorted(rel.columns)
    at = [rel.columns.index(c) for c in cols]
    assert sorted(tuple(norm(r[c]) for c in cols) for r in rows) == sorted(tuple(norm(r[k]) for k in at) for r in rel.fetchall())


def test_entry(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.columns[0] == "lake_name" and df.count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
