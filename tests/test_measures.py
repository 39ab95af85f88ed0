import datetime

import pytest
from pyspark.sql import functions as F

from quillon.operators import visuals
from quillon.operators.measures import Measure, kpi, measure_rows, measures, time_intelligence, write_measures
from quillon.operators.modeling import suggest_fields
from quillon.operators.catalog import catalog_of
from tests.conftest import rows


def test_measures_follow_blank_rules(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("b", 3.0), ("b", 3.0)], "g string, v double")
    got = measures(df, [Measure("v"), Measure("v", "AVERAGE", "mean"), Measure("v", "COUNT", "n"),
                        Measure("v", "DISTINCTCOUNT", "d"), Measure("v", "MIN", "lo"), Measure("v", "MAX", "hi")], ["g"])
    assert "Total V" in got.columns
    # a blank counts as one more distinct value, and not as a counted one
    assert rows(got, "g") == [("a", 1.0, 1.0, 1, 2, 1.0, 1.0), ("b", 6.0, 3.0, 2, 1, 3.0, 3.0)]


def test_measure_table_is_partitioned_by_category(spark, tmp_path):
    df = spark.createDataFrame([(2.0,), (3.0,)], "sales_amount double")
    specs = [Measure("sales_amount"), Measure("sales_amount", "MAX", "Peak", "KPI")]
    write_measures(measure_rows(measures(df, specs), specs), str(tmp_path / "m"))
    assert sorted(p.name for p in (tmp_path / "m").glob("category=*")) == ["category=Basic Measures", "category=KPI"]
    assert rows(spark.read.parquet(str(tmp_path / "m")).select("measure", "value", "format")) == [
        ("Peak", 3.0, "Currency"), ("Total Sales Amount", 5.0, "Currency")]


def test_kpi_edges(spark):
    actuals = spark.createDataFrame([("low", 94.0), ("under", 95.0), ("over", 105.0), ("zero", 5.0), ("none", 1.0)],
                                    "measure string, actual double")
    targets = spark.createDataFrame([("low", 100.0), ("under", 100.0), ("over", 100.0), ("zero", 0.0), ("none", None)],
                                    "measure string, target double")
    got = {r.measure: (r.variance, r.variance_pct, r.status) for r in kpi(actuals, targets).collect()}
    assert got == {"low": (-6.0, -0.06, "Below Target"), "under": (-5.0, -0.05, "On Target"),
                   "over": (5.0, 0.05, "Above Target"), "zero": (5.0, None, "Below Target")}


def test_time_intelligence_with_gaps(spark):
    data = [("x", datetime.date(2022, 1, 5), 10.0), ("x", datetime.date(2022, 3, 5), 30.0),
            ("x", datetime.date(2023, 2, 1), 5.0), ("x", datetime.date(2023, 3, 1), 45.0), ("x", datetime.date(2023, 3, 9), 15.0)]
    df = spark.createDataFrame(data, "g string, d date, v double")
    got = {(r.year, r.period): (r.value, r.prior_year, r.ytd, r.pytd, r.yoy)
           for r in time_intelligence(df, "d", ["g"], "v").collect()}
    assert got == {
        (2022, 1): (10.0, None, 10.0, None, None), (2022, 3): (30.0, None, 40.0, None, None),
        # no February before: its prior value is blank, the prior year to date is January's
        (2023, 2): (5.0, None, 5.0, 10.0, None), (2023, 3): (60.0, 30.0, 65.0, 40.0, 1.0)}


def test_leap_day_has_no_twin(spark):
    days = [datetime.date(2023, 2, 28), datetime.date(2024, 2, 28), datetime.date(2024, 2, 29), datetime.date(2025, 2, 28)]
    df = spark.createDataFrame([(d, 1.0) for d in days], "d date, v double")
    got = {(r.year, r.period): r.prior_year for r in time_intelligence(df, "d", [], "v", "day").collect()}
    assert got == {(2023, 228): None, (2024, 228): 1.0, (2024, 229): None, (2025, 228): 1.0}


@pytest.fixture(scope="module")
def sales(spark):
    return spark.createDataFrame([
        (datetime.date(2024, 1, 3), "a", "N", 10.0, 1), (datetime.date(2024, 1, 9), "b", "N", 20.0, 2),
        (datetime.date(2024, 2, 1), "a", "S", 30.0, 3), (datetime.date(2023, 1, 31), "a", "S", 40.0, 4)],
        "day date, product_type string, region string, amount double, quantity int")


SPECS = [Measure("amount"), Measure("quantity")]


def test_single_visuals(sales):
    assert rows(visuals.visual(sales, "line", ["day"], SPECS), "period")[0] == (datetime.date(2023, 1, 1), 40.0, 4)
    assert rows(visuals.visual(sales, "column", ["product_type"], SPECS)) == [("a", 80.0, 8), ("b", 20.0, 2)]
    assert rows(visuals.visual(sales, "pie", ["product_type"], SPECS)) == [("a", 80.0, 0.8), ("b", 20.0, 0.2)]
    assert rows(visuals.visual(sales, "map", ["region"], SPECS)) == [("N", 30.0), ("S", 70.0)]
    assert rows(visuals.visual(sales, "card", [], SPECS)) == [(100.0, 10)]
    matrix = rows(visuals.visual(sales, "matrix", ["region", "product_type"], SPECS[:1]))
    assert (None, None, 3, 100.0) in matrix and ("N", None, 1, 30.0) in matrix and len(matrix) == 7 - 1
    assert visuals.visual(sales, "table", ["region"], SPECS).columns == ["amount", "quantity", "region"]
    assert rows(visuals.pivot_visual(sales, ["region"], "product_type", ["a", "b"], SPECS[0])) == \
        [("N", 10.0, 20.0), ("S", 70.0, None)]
    with pytest.raises(ValueError):
        visuals.visual(sales, "gauge", [], SPECS)


def test_bundle_equals_the_single_visuals(sales):
    got = {(r.visual, r.category, r.measure): r.value
           for r in visuals.visual_bundle(sales, SPECS, "day", "product_type", "region").collect()}
    assert got["line", "2024-01", "Total Amount"] == 30.0 and got["column", "b", "Total Quantity"] == 2.0
    assert got["pie", "a", "Total Amount"] == 0.8 and got["map", "S", "Total Amount"] == 70.0
    assert got["card", None, "Total Quantity"] == 10.0 and ("map", "S", "Total Quantity") not in got
    assert len(got) == 3 * 2 + 2 * 2 + 2 + 2 + 2
    assert rows(visuals.visual_bundle(sales, SPECS).select("visual", "value")) == [("card", 10.0), ("card", 100.0)]


def test_filters(sales):
    year = [{"type": "date_range", "field": "day", "range": "last_12_months"}]
    assert visuals.apply_filters(sales, year).count() == 3
    both = year + [{"type": "dropdown", "field": "product_type", "values": ["b"]}]
    assert visuals.apply_filters(sales, both).count() == 1
    span = [{"type": "date_range", "field": "day", "start": "2023-01-01", "end": "2023-12-31"}]
    assert visuals.apply_filters(sales, span).count() == 1
    with pytest.raises(ValueError):
        visuals.apply_filters(sales, [{"type": "slider", "field": "day"}])


def test_suggested_visuals(spark, sales):
    fields = suggest_fields(catalog_of(spark, {"sales": sales, "names": sales.select("region")}))
    got = {(r.table, r.visual): (r.priority, r.measures, r.dimension) for r in visuals.suggest_visuals(fields).collect()}
    assert got["sales", "line"] == (1, "amount,quantity", "day") and got["sales", "map"] == (2, "amount", "region")
    assert got["sales", "pie"] == (3, "amount", "product_type") and got["names", "table"] == (4, "", None)
    assert ("names", "card") not in got


def test_pie_total_needs_no_single_task_window(sales):
    plan = visuals.pie_visual(sales.withColumn("x", F.lit(1)), "region", SPECS[0])._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan.split("Subquery")[0] or "Window" not in plan
