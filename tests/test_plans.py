"""The physical plans have the shape that holds on large tables."""

import pytest

from __spark_entry__ import queries
from catalog.base import REGISTRY

FOLDER = "/root/testdata/sf0.001"
# Queries that do no work before they are asked for rows; ``test_oracle`` looks at the plans of the others.
LAZY = [n for module in ("cases", "icu", "places", "reportviews", "texts") for n, q in REGISTRY.items() if q.module == f"catalog.{module}" and q.sql]
LAZY = [n for n in LAZY if n not in ("stored_sections",)]


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", LAZY)
def test_no_pairwise_join_and_no_row_wise_python(spark, name):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(queries()[name](spark, FOLDER))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "CartesianProduct" not in text and "NestedLoop" not in text
    assert "BatchEvalPython" not in text


def test_flagship_windows_share_one_shuffle_and_sort(spark):
    text = plan(queries()["weekly_incidence"](spark, FOLDER))
    assert text.count("Window [") == 3
    between = text[text.index("Window ["):]
    assert between.split("Exchange")[0].count("Sort [") == 1
    assert "partial_count" in text


def test_scans_read_only_the_columns_they_need(spark):
    text = plan(queries()["occupancy"](spark, FOLDER))
    scan = [line for line in text.splitlines() if "lineitem.parquet" in line][0]
    assert "l_extendedprice" not in scan and "l_tax" not in scan and "l_comment" not in scan


def test_county_filter_reaches_a_stored_table(spark, tmp_path):
    from wardwatch.operators.filters import by_county

    queries()["weekly_incidence"](spark, FOLDER).write.parquet(str(tmp_path / "h"))
    text = plan(by_county(spark.read.parquet(str(tmp_path / "h")), "05000"))
    assert "EqualTo(gemeinde,05000)" in text
