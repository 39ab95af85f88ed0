"""Catalogs of databases, services and lakehouses, from an embedded database, recorded answers and files."""

import json

from quillon.operators import drift
from quillon.sources import catalogs, registry
from tests.conftest import rows

DERBY = {"type": "jdbc", "url": "jdbc:derby:memory:catalog;create=true", "driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}


def statement(spark, sql):
    connection = spark._jvm.java.sql.DriverManager.getConnection(DERBY["url"])
    connection.createStatement().execute(sql)
    connection.close()


def test_a_database(spark):
    spark.range(1).write.format("jdbc").options(url=DERBY["url"], driver=DERBY["driver"], dbtable="SEED").save()
    for sql in ("CREATE SCHEMA SHOP", "CREATE TABLE SHOP.ITEMS (ID INT NOT NULL, NAME VARCHAR(20), PRICE DECIMAL(10,2) NOT NULL)",
                "CREATE TABLE ITEMS (ID BIGINT)"):
        statement(spark, sql)
    found = catalogs.catalog_rows(spark, DERBY)
    assert found.columns == catalogs.FIELDS
    # a task per schema
    assert found.rdd.getNumPartitions() == len({r.schema for r in found.collect()}) == 2
    items = found.where("qualified = 'SHOP.ITEMS'").select("column", "type", "nullable", "max_length", "precision", "scale", "position")
    assert rows(items, "position") == [("ID", "integer", False, None, None, None, 1), ("NAME", "varchar", True, 20, None, None, 2),
                                       ("PRICE", "decimal", False, None, 10, 2, 3)]
    # two tables of one name are told apart, listed and read by their qualified names
    assert {"APP.ITEMS", "SHOP.ITEMS"} <= set(registry.list_source_tables(spark, DERBY))
    assert registry.read_source(spark, DERBY, "SHOP.ITEMS").columns == ["ID", "NAME", "PRICE"]
    # a change of nullability is drift
    before = catalogs.as_drift_catalog(found).persist()
    before.count()
    statement(spark, "ALTER TABLE SHOP.ITEMS ALTER COLUMN NAME NOT NULL")
    after = catalogs.as_drift_catalog(catalogs.catalog_rows(spark, DERBY))
    assert rows(drift.schema_diff(before, after, nullable=True).select("type", "table", "column")) == [("nullable_changed", "SHOP.ITEMS", "NAME")]


def test_a_warehouse_service(spark):
    cfg = {"type": "bigquery", "project_id": "p", "endpoint": "https://bq", "getter": "tests.pages:recorded"}
    found = catalogs.catalog_rows(spark, cfg)
    assert found.rdd.getNumPartitions() == 2  # a task per data set
    assert rows(found.drop("schema", "table"), "qualified", "position") == [
        ("sales.items", "tags", "array<string>", True, None, None, None, None, 1),
        ("sales.orders", "id", "integer", False, None, None, None, None, 1),
        ("sales.orders", "note", "string", True, "'-'", 40, None, None, 2),
        ("sales.orders", "amount", "numeric", True, None, None, 10, 2, 3),
        ("sales.orders", "to", "record", True, None, None, None, None, 4),
        ("sales.orders", "to.city", "string", False, None, None, None, None, 5)]
    assert registry.list_source_tables(spark, cfg) == ["sales.items", "sales.orders"]
    sized = catalogs.as_drift_catalog(found).where("table = 'sales.orders'").select("type")
    assert [r.type for r in sized.collect()] == ["integer", "string(40)", "numeric(10,2)", "record", "string"]


def test_an_object_service(spark):
    cfg = {"type": "salesforce", "instance_url": "https://sf", "access_token": "t", "getter": "tests.pages:recorded"}
    assert rows(catalogs.catalog_rows(spark, cfg), "position") == [
        (None, "Account", "Account", "Id", "id", False, None, 18, None, None, 1),
        (None, "Account", "Account", "Amount", "currency", True, "0", None, 18, 2, 2)]


def test_a_lakehouse(spark, tmp_path):
    plain = spark.createDataFrame([(1, "x", None)], "id bigint not null, name string, price decimal(7,3)")
    plain.write.parquet(str(tmp_path / "plain"))
    log = tmp_path / "logged" / "_delta_log"
    log.mkdir(parents=True)
    schema = {"type": "struct", "fields": [
        {"name": "id", "type": "long", "nullable": False, "metadata": {}},
        {"name": "code", "type": "string", "nullable": True, "metadata": {"__CHAR_VARCHAR_TYPE_STRING": "varchar(12)", "CURRENT_DEFAULT": "'n'"}},
        {"name": "tags", "type": {"type": "array", "elementType": "string", "containsNull": True}, "nullable": True, "metadata": {}}]}
    first = dict(schema, fields=schema["fields"][:1])
    (log / "00000000000000000000.json").write_text(json.dumps({"metaData": {"schemaString": json.dumps(first)}}) + "\n")
    (log / "00000000000000000001.json").write_text('{"add": {}}\n' + json.dumps({"metaData": {"schemaString": json.dumps(schema)}}) + "\n")
    (tmp_path / "_hidden").mkdir()
    found = catalogs.catalog_rows(spark, {"type": "onelake", "path": str(tmp_path), "schema_name": "lake"})
    assert rows(found.select("qualified", "column", "type", "nullable", "default", "max_length", "precision", "scale", "position"), "qualified", "position") == [
        ("lake.logged", "id", "long", False, None, None, None, None, 1), ("lake.logged", "code", "string", True, "'n'", 12, None, None, 2),
        ("lake.logged", "tags", "array", True, None, None, None, None, 3),
        ("lake.plain", "id", "long", False, None, None, None, None, 1), ("lake.plain", "name", "string", True, None, None, None, None, 2),
        ("lake.plain", "price", "decimal(7,3)", True, None, None, 7, 3, 3)]


def test_sources_without_a_catalog(spark):
    import pytest
    with pytest.raises(ValueError, match="no catalog"):
        catalogs.catalog_rows(spark, {"type": "kafka", "bootstrap_servers": "x"})
