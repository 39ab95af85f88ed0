import pytest

from quillon.plans import guard, service_queries
from quillon.plans.report import build_report
from quillon.session import load_all

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("sql", [
    "SELECT created_at, updated_by FROM t", "with a as (select 1 x) select x from a;", "SELECT 'DROP TABLE; --' AS text",
    "SELECT `delete` FROM t", "select \"insert\" from t",
])
def test_allowed(sql):
    assert guard.check_sql(sql)


@pytest.mark.parametrize("sql", [
    "", "  ;", "DROP TABLE t", "SELECT 1; SELECT 2", "SELECT 1 -- note", "SELECT /* x */ 1", "UPDATE t SET a = 1",
    "WITH a AS (SELECT 1) INSERT INTO t SELECT * FROM a", "SELECT xp_cmdshell('x')", "SHOW TABLES", "SELECT * FROM t WHERE EXEC = 1",
    "selection FROM t",
])
def test_refused(sql):
    with pytest.raises(ValueError):
        guard.check_sql(sql)


def test_batch_isolates_failures(spark):
    tables = {"numbers": spark.range(5).toDF("n")}
    status, results = guard.run_batch(spark, [
        {"id": "a", "query": "SELECT count(*) AS c FROM numbers", "data_source": "s"},
        {"id": "b", "query": "DROP TABLE numbers", "data_source": "s"},
        {"id": "c", "query": "SELECT nothing FROM numbers", "data_source": "s"},
        {"id": "d", "query": "SELECT 1", "data_source": "unknown"},
        {"id": "e", "query": "SELECT max(n) AS m FROM numbers", "data_source": "s"}], {"s": tables})
    assert [s["status"] for s in status] == ["success", "error", "error", "error", "success"]
    assert results["a"].first().c == 5 and results["e"].first().m == 4 and set(results) == {"a", "e"}
    assert status[0]["columns"] == ["c"]


def test_report(spark, tmp_path):
    tables = load_all(spark, SF, ("orders", "customer", "part", "region"))
    tables["orders"] = tables["orders"].withColumnRenamed("o_custkey", "custkey")
    tables["customer"] = tables["customer"].withColumnRenamed("c_custkey", "custkey")
    path = str(tmp_path / "snap")
    report = build_report(spark, tables, "orders by customer", path)
    assert report["tables"].orderBy("rank").first().table in ("orders", "customer")
    assert report["joined"].count() == 1500 and report["dataset"].first().row_count == 1500
    assert report["drift"].count() == 0
    assert 0 <= report["score"].first().score <= 100 and report["insights"].count() > 0
    assert {r.visual for r in report["visual_data"].collect()} >= {"line", "card"}
    again = build_report(spark, {**tables, "customer": tables["customer"].drop("c_acctbal")}, "orders by customer", path)
    assert [r.type for r in again["drift"].collect()] == ["column_removed"]


def test_report_without_measures_is_a_table(spark):
    report = build_report(spark, {"names": spark.createDataFrame([("a",)], "label string")}, "nothing fits")
    assert report["visual_data"].columns == ["label"]


def test_forest_rows_are_joined_once(spark, tmp_path):
    spark.sql("SELECT id AS o_orderkey, id % 3 AS o_custkey, 'F' AS o_orderstatus, CAST(id AS DOUBLE) AS o_totalprice, "
              "TIMESTAMP '2024-02-01' AS o_orderdate, '1-URGENT' AS o_orderpriority FROM range(14)").write.parquet(f"{tmp_path}/orders.parquet")
    data = service_queries._forest_rows(spark, str(tmp_path))
    # training reads the rows many times: each would join them again
    assert "Join" not in data._jdf.queryExecution().optimizedPlan().toString()
    assert data.count() == 14 and data.where("known_price IS NULL").count() == 2 and data.agg({"price": "sum"}).first()[0] == 91
