import json
import os

import pytest
from pyspark.sql import functions as F

from quillon.sources import files, registry, rest
from tests.conftest import rows

REFERENCE_TYPES = ("sql_server", "postgresql", "mysql", "csv", "excel", "api", "bigquery", "salesforce", "s3", "redshift",
                   "onelake", "oracle", "snowflake", "mongodb", "synapse", "kafka", "event_hub")


def test_every_type_is_known():
    assert set(REFERENCE_TYPES) <= set(registry.SOURCES)
    for unknown in ("semantic_model", "ftp", None):
        with pytest.raises(ValueError, match="unsupported"):
            registry.source_spec({"type": unknown})


@pytest.mark.parametrize("kind, url, driver", [
    ("sql_server", "jdbc:sqlserver://h:1433;databaseName=d", "com.microsoft.sqlserver.jdbc.SQLServerDriver"),
    ("synapse", "jdbc:sqlserver://h:1433;databaseName=d", "com.microsoft.sqlserver.jdbc.SQLServerDriver"),
    ("postgresql", "jdbc:postgresql://h:5432/d", "org.postgresql.Driver"),
    ("mysql", "jdbc:mysql://h:3306/d", "com.mysql.cj.jdbc.Driver"),
    ("oracle", "jdbc:oracle:thin:@//h:1521/d", "oracle.jdbc.OracleDriver"),
    ("redshift", "jdbc:redshift://h:5439/d", "com.amazon.redshift.jdbc42.Driver"),
])
def test_database_options(kind, url, driver):
    got = registry.jdbc_options({"type": kind, "host": "h", "database": "d", "username": "u", "password": "p"}, "s.t")
    assert (got["url"], got["driver"], got["dbtable"], got["user"], got["password"]) == (url, driver, "s.t", "u", "p")


def test_other_options():
    snow = registry.jdbc_options({"type": "snowflake", "account": "a", "database": "d", "warehouse": "w"}, "t")
    assert snow["url"] == "jdbc:snowflake://a.snowflakecomputing.com/?db=d&schema=PUBLIC&warehouse=w"
    assert registry.bigquery_options({"type": "bigquery", "project_id": "p", "dataset": "d"}, "t")["table"] == "p.d.t"
    assert registry.mongodb_options({"type": "mongodb", "connection_string": "c", "database": "d"}, "t")["collection"] == "t"
    kafka = registry.kafka_options({"type": "kafka", "bootstrap_servers": ["a:1", "b:2"], "batch_size": 100}, "topic")
    assert kafka == {"kafka.bootstrap.servers": "a:1,b:2", "startingOffsets": "earliest", "failOnDataLoss": "true",
                     "subscribe": "topic", "maxOffsetsPerTrigger": "100"}
    hub = registry.event_hub_options({"type": "event_hub", "namespace": "n", "connection_string": "cs", "eventhub_name": "e"}, None)
    assert hub["kafka.bootstrap.servers"] == "n.servicebus.windows.net:9093" and hub["subscribe"] == "e"
    assert hub["kafka.security.protocol"] == "SASL_SSL" and "cs" in hub["kafka.sasl.jaas.config"]
    with pytest.raises(ValueError, match="needs host"):
        registry.jdbc_options({"type": "mysql", "database": "d"}, "t")


@pytest.mark.parametrize("name", ["t; DROP x", "1t", "a b", "", "t--"])
def test_bad_table_names(name):
    with pytest.raises(ValueError):
        registry.check_table_name(name)


def test_partitioned_reads_need_all_options():
    cfg = {"type": "postgresql", "host": "h", "database": "d", "partitionColumn": "id"}
    with pytest.raises(ValueError, match="partitioned"):
        registry.jdbc_options(cfg, "t")
    full = {**cfg, "lowerBound": 0, "upperBound": 10, "numPartitions": 4}
    assert registry.jdbc_options(full, "t")["numPartitions"] == "4"


def test_embedded_database(spark):
    cfg = {"type": "jdbc", "url": "jdbc:derby:memory:unit;create=true", "driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    data = spark.range(20).select(F.col("id").cast("int").alias("ID"), F.concat(F.lit("n"), "id").alias("NM"))
    data.write.format("jdbc").options(url=cfg["url"], driver=cfg["driver"], dbtable="T1").save()
    assert registry.read_source(spark, cfg, "T1").count() == 20
    got = registry.read_source(spark, cfg, "T1", ["NM"], "ID >= 15", 3)
    assert got.columns == ["NM"] and got.count() == 3
    plan = registry.read_source(spark, cfg, "T1", ["NM"], "ID >= 15")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [*IsNotNull(ID), *GreaterThanOrEqual(ID,15)]" in plan
    split = {**cfg, "partitionColumn": "ID", "lowerBound": 0, "upperBound": 20, "numPartitions": 4}
    parts = registry.read_source(spark, split, "T1")
    assert parts.count() == 20 and parts.select(F.spark_partition_id().alias("p")).distinct().count() == 4
    assert rows(registry.run_query(spark, cfg, "SELECT COUNT(*) AS N FROM T1")) == [(20,)]
    assert [r.column for r in registry.read_catalog(spark, cfg).orderBy("position").collect()] == ["ID", "NM"]
    with pytest.raises(Exception):
        registry.read_source(spark, cfg, "MISSING").count()


def test_files(spark, tmp_path):
    (tmp_path / "csv").mkdir()
    (tmp_path / "csv" / "items.csv").write_text("id,name\n1,a\n2,b\n3,c\n")
    cfg = {"type": "csv", "path": str(tmp_path / "csv"), "extension": ".csv"}
    assert rows(registry.read_source(spark, cfg, "items", where="id > 1", limit=5)) == [(2, "b"), (3, "c")]
    assert list(registry.read_tables(spark, cfg)) == ["items"]
    catalog = rows(registry.read_catalog(spark, cfg).select("table", "column", "type"))
    assert catalog == [("items", "id", "int"), ("items", "name", "string")]
    both = registry.union_catalogs({"x": registry.read_catalog(spark, cfg), "y": registry.read_catalog(spark, cfg)})
    assert both.count() == 4


def test_filter_comes_before_limit(spark):
    df = registry.apply_cuts(spark.range(100), where="id >= 90", limit=5)
    assert df.count() == 5 and df.where("id < 90").count() == 0


def test_mixed_folder(spark, tmp_path):
    base = tmp_path / "bucket" / "sales"
    (base / "deep").mkdir(parents=True)
    (base / "a.csv").write_text("id,name\n1,x\n")
    (base / "deep" / "b.json").write_text('{"id": 2, "extra": true}\n')
    (base / "c.txt").write_text("not read")
    got = registry.read_source(spark, {"type": "s3", "path": str(tmp_path / "bucket")}, "sales")
    assert rows(got.select("id", "name", "extra")) == [(1, "x", None), (2, None, True)]
    (tmp_path / "empty").mkdir()
    with pytest.raises(ValueError, match="no csv or json"):
        registry.read_source(spark, {"type": "s3", "path": str(tmp_path / "empty")})


def write_pages(folder, pages):
    for i, page in enumerate(pages, 1):
        (folder / f"page={i}.json").write_text(json.dumps(page))


def test_rest_pages(spark, tmp_path):
    pages = [[{"id": 10 * p + i, "v": 0.5, "tag": None} for i in range(4)] for p in range(1, 8)]
    write_pages(tmp_path, pages + [[]])
    cfg = {"type": "api", "endpoint": str(tmp_path), "fetcher": "tests.pages:fetch_page", "paginate": "true", "parallelism": 3}
    df = registry.read_source(spark, cfg)
    assert dict(df.dtypes) == {"id": "bigint", "v": "double", "tag": "string"} and df.rdd.getNumPartitions() == 3
    assert sorted(r.id for r in df.collect()) == sorted(r["id"] for p in pages for r in p)
    limited = registry.read_source(spark, {**cfg, "limit": 2, "schema": "id bigint", "strict": False}, where="id > 0", limit=2)
    assert limited.count() == 2
    with pytest.raises(Exception, match="fields that the schema lacks"):
        registry.read_source(spark, {**cfg, "schema": "id bigint"}).collect()


def calls(folder):
    return sorted(p.name for p in folder.glob("call-*"))


def test_a_limit_stops_the_pages(spark, tmp_path):
    write_pages(tmp_path, [[{"id": 10 * p + i} for i in range(4)] for p in range(1, 30)])
    cfg = {"type": "api", "endpoint": str(tmp_path), "fetcher": "tests.pages:fetch_counted", "paginate": "true", "schema": "id bigint"}
    assert registry.read_source(spark, cfg, limit=10).count() == 10
    assert [c.split("-")[1] for c in calls(tmp_path)] == ["page=1", "page=2", "page=3"]
    assert registry.read_source(spark, cfg, limit=0).count() == 0 and len(calls(tmp_path)) == 3
    # a filter may need all pages
    assert registry.read_source(spark, cfg, where="id >= 290", limit=3).count() == 3


def test_filters_go_to_the_endpoint(spark, tmp_path):
    write_pages(tmp_path, [[{"id": 1, "kind": "a"}, {"id": 2, "kind": "b"}], []])
    cfg = {"type": "api", "endpoint": str(tmp_path), "fetcher": "tests.pages:fetch_counted", "paginate": "true", "schema": "id bigint, kind string",
           "filter_params": json.dumps({"kind": "k"})}
    assert rows(registry.read_source(spark, cfg, where="kind = 'b' AND id > 0")) == [(2, "b")]
    assert all('{"k": "b"}' in c.read_text() for c in tmp_path.glob("call-*"))


def test_salesforce_gets_columns_and_conditions(spark):
    cfg = {"type": "salesforce", "instance_url": "https://x", "access_token": "t", "fetcher": "tests.pages:fetch_predicate",
           "read_schema": "Id string, Amount bigint, Name string, Closed boolean"}
    got = registry.read_source(spark, cfg, "Account", ["Id"], "Amount > 3 AND Amount <= 9 AND Closed IS NULL", 7)
    assert got.columns == ["Id"]
    (text,) = [r.Id for r in got.collect()]
    assert text.startswith("SELECT Id, Amount, Closed FROM Account WHERE ")
    assert all(c in text for c in ("(Amount > 3)", "(Amount <= 9)", "(Closed = NULL)", "(Amount != NULL)"))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Amount#" not in plan.split("BatchScan")[0].split("Filter")[-1] or "Filter" not in plan


def test_conditions_keep_their_meaning():
    from pyspark.sql.datasource import EqualTo, GreaterThan, In, IsNotNull, IsNull, Not, StringContains

    assert rest.soql_condition(EqualTo(("Name",), "O'Brien \\ co")) == "Name = 'O\\'Brien \\\\ co'"
    assert rest.soql_condition(In(("A",), (1, 2))) == "A IN (1, 2)" and rest.soql_condition(GreaterThan(("Flag",), True)) == "Flag > true"
    assert rest.soql_condition(GreaterThan(("Name",), "x")) is None  # the order of texts differs
    assert rest.soql_condition(Not(IsNull(("A",)))) == rest.soql_condition(IsNotNull(("A",))) == "A != NULL"
    assert rest.soql_condition(Not(EqualTo(("A",), 1))) is None and rest.soql_condition(StringContains(("A",), "x")) is None


def test_rest_single_answers(spark, tmp_path):
    cfg = {"type": "api", "endpoint": str(tmp_path), "fetcher": "tests.pages:fetch_page", "schema": "id int, n string"}
    (tmp_path / "all.json").write_text('{"id": 1, "n": {"deep": 2}}')
    assert rows(registry.read_source(spark, cfg)) == [(1, '{"deep": 2}')]
    (tmp_path / "all.json").write_text('[{"id": 1}, {"id": 2, "n": "x"}]')
    assert rows(registry.read_source(spark, cfg)) == [(1, None), (2, "x")]
    (tmp_path / "page=1.json").write_text('{"id": 9, "n": "one"}')
    assert rows(registry.read_source(spark, {**cfg, "paginate": "true"})) == [(9, "one")]


def test_salesforce_slices(spark):
    cfg = {"type": "salesforce", "instance_url": "https://x", "access_token": "t", "fetcher": "tests.pages:fetch_predicate",
           "predicates": json.dumps(["A < 1", "A >= 1"]), "where": "B = 2"}
    got = registry.read_source(spark, cfg, "Account")
    assert "attributes" not in got.columns
    assert sorted(r.Id for r in got.collect()) == [
        "SELECT FIELDS(ALL) FROM Account WHERE (B = 2) AND (A < 1)",
        "SELECT FIELDS(ALL) FROM Account WHERE (B = 2) AND (A >= 1)"]


def test_retries_end_in_the_error(monkeypatch):
    calls = []

    def broken(*args, **kwargs):
        calls.append(1)
        raise OSError("down")

    monkeypatch.setattr(rest.urllib.request, "urlopen", broken)
    monkeypatch.setattr(rest.time, "sleep", lambda s: None)
    with pytest.raises(OSError):
        rest._get("http://nowhere", {})
    assert len(calls) == rest.RETRIES


def test_streams_are_not_tables(spark):
    with pytest.raises(ValueError, match="read_stream"):
        registry.read_source(spark, {"type": "kafka", "bootstrap_servers": "x"}, "t")


@pytest.mark.skipif(files.excel_engine() is None, reason="openpyxl is not installed")
def test_workbooks(spark, tmp_path):
    import pandas as pd

    pd.DataFrame({"a": [1, 2]}).to_excel(os.fspath(tmp_path / "b.xlsx"), sheet_name="one", index=False)
    assert rows(files.read_excel(spark, str(tmp_path), "one", "a bigint")) == [(1,), (2,)]


def test_workbooks_need_their_package(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "excel_engine", lambda: None)
    with pytest.raises(ImportError):
        files.read_excel(spark, str(tmp_path), "one", "a bigint")
