"""Every registered query against its SQL, on the smallest sample."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))

from compare import compare, connect  # noqa: E402

from spindle.catalog import ORACLE, QUERIES  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    return connect(FOLDER)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, sql, name):
    df = QUERIES[name](spark, FOLDER)
    if name in ORACLE:
        assert compare(df, sql, ORACLE[name]) == ""
    else:
        assert df.count() >= 0


def test_only_p_values_texts_and_bundles_lack_sql():
    assert set(QUERIES) - set(ORACLE) == {
        "torque_trend_significance",
        "torque_trend_summary",
        "mann_whitney_test",
        "anomaly_reasons",
        "kruskal_wallis_test",
        "torque_success_correlation_test",
        "hour_of_day_test",
        "report_anomaly",
        "report_head_comparison",
        "report_kpi",
        "analytics_suite",
    }
