"""Catalogs of any source as rows: every column with its qualified table, nullability, default, length and precision."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quillon.sources import rest

CATALOG = ("schema string, table string, qualified string, column string, type string, nullable boolean, default string, "
           "max_length long, precision int, scale int, position int")
FIELDS = [c.split()[0] for c in CATALOG.split(", ")]

# The columns of a database's tables, as schema, table, column, type, nullable, default, max_length, precision, scale, position.
STANDARD_COLUMNS = """SELECT table_schema AS s, table_name AS t, column_name AS c, data_type AS k, is_nullable AS n, column_default AS d,
 character_maximum_length AS l, numeric_precision AS p, numeric_scale AS q, ordinal_position AS o FROM information_schema.columns
 WHERE table_schema NOT IN ('information_schema', 'pg_catalog', 'sys', 'mysql', 'performance_schema')"""
COLUMN_QUERIES = {
    "oracle": """SELECT owner AS s, table_name AS t, column_name AS c, data_type AS k, nullable AS n, CAST(NULL AS VARCHAR2(1)) AS d,
 char_length AS l, data_precision AS p, data_scale AS q, column_id AS o FROM all_tab_columns
 WHERE owner NOT IN ('SYS', 'SYSTEM', 'XDB', 'MDSYS', 'CTXSYS')""",
    "derby": """SELECT s.schemaname AS s, t.tablename AS t, c.columnname AS c, CAST(c.columndatatype AS VARCHAR(200)) AS k, CAST(NULL AS VARCHAR(3)) AS n,
 CAST(NULL AS VARCHAR(1)) AS d, CAST(NULL AS INT) AS l, CAST(NULL AS INT) AS p, CAST(NULL AS INT) AS q, c.columnnumber AS o
 FROM sys.syscolumns c JOIN sys.systables t ON c.referenceid = t.tableid JOIN sys.sysschemas s ON t.schemaid = s.schemaid WHERE t.tabletype = 'T'""",
}
SCHEMA_QUERIES = {
    "oracle": "SELECT DISTINCT owner AS s FROM all_tab_columns WHERE owner NOT IN ('SYS', 'SYSTEM', 'XDB', 'MDSYS', 'CTXSYS')",
    "derby": "SELECT DISTINCT s.schemaname AS s FROM sys.systables t JOIN sys.sysschemas s ON t.schemaid = s.schemaid WHERE t.tabletype = 'T'",
}
STANDARD_SCHEMAS = f"SELECT DISTINCT x.s FROM ({STANDARD_COLUMNS}) x"


def jdbc_catalog(spark: SparkSession, cfg: dict) -> DataFrame:
    """The catalog of a database, a task per schema. Types that state a length and nullability in their text are taken apart."""
    from quillon.sources.registry import jdbc_options, run_query

    dialect = "derby" if str(cfg.get("url", "")).startswith("jdbc:derby") else cfg["type"]
    # schema names only: bounded by the database's catalog
    schemas = sorted(r[0] for r in run_query(spark, cfg, SCHEMA_QUERIES.get(dialect, STANDARD_SCHEMAS)).collect())
    predicates = ["x.s = '" + s.replace("'", "''") + "'" for s in schemas] or ["1 = 0"]
    options = jdbc_options(cfg, None)
    url = options.pop("url")
    found = spark.read.jdbc(url, f"({COLUMN_QUERIES.get(dialect, STANDARD_COLUMNS)}) x", predicates=predicates, properties=options)
    found = found.toDF(*"stckndlpqo")
    text = F.col("k")
    size = F.nullif(F.regexp_extract(text, r"\((\d+)", 1), F.lit("")).cast("int")
    scale = F.nullif(F.regexp_extract(text, r"\(\d+,\s*(\d+)\)", 1), F.lit("")).cast("int")
    bare = F.lower(F.trim(F.regexp_replace(F.regexp_replace(text, r"\(.*?\)", ""), "(?i) NOT NULL", "")))
    chars = bare.contains("char")
    said = F.upper(F.col("n").cast("string"))
    return found.select(
        F.col("s").alias("schema"), F.col("t").alias("table"), F.concat_ws(".", "s", "t").alias("qualified"), F.col("c").alias("column"),
        bare.alias("type"), F.coalesce(said.isin("YES", "Y"), ~text.rlike("(?i) NOT NULL$")).alias("nullable"), F.col("d").cast("string").alias("default"),
        F.coalesce(F.col("l").cast("long"), F.when(chars, size).cast("long")).alias("max_length"),
        F.coalesce(F.col("p").cast("int"), F.when(~chars, size)).alias("precision"), F.coalesce(F.col("q").cast("int"), scale).alias("scale"),
        F.col("o").cast("int").alias("position"))


def _row(schema: str | None, table: str, column: str, kind: str, nullable: bool, position: int, default=None, length=None,
         precision=None, scale=None) -> tuple:
    def number(value):
        return int(value) if value not in (None, "", 0, "0") else None
    return (schema, table, f"{schema}.{table}" if schema else table, column, kind.lower(), nullable, None if default is None else str(default),
            number(length), number(precision), number(scale), position)


# --- sources that are no databases: list(options) names the parts, rows(options, part) yields the columns of one --------------

def bigquery_parts(options: dict, get: Callable) -> list[str]:
    answer = get(f"{options['endpoint']}/projects/{options['project']}/datasets")
    return [d["datasetReference"]["datasetId"] for d in answer.get("datasets", [])]


def bigquery_rows(options: dict, part: str, get: Callable) -> Iterator[tuple]:
    """All tables of a dataset; fields of records have their path as a name."""
    base = f"{options['endpoint']}/projects/{options['project']}/datasets/{part}/tables"
    token = ""
    while token is not None:
        answer = get(base + (f"?pageToken={token}" if token else ""))
        for entry in answer.get("tables", []):
            name = entry["tableReference"]["tableId"]
            position = 0

            def fields(found: list[dict], path: str = "", within: bool = True) -> Iterator[tuple]:
                nonlocal position
                for f in found:
                    position += 1
                    free = within and f.get("mode", "NULLABLE") != "REQUIRED"
                    kind = f"array<{f['type']}>" if f.get("mode") == "REPEATED" else f["type"]
                    yield _row(part, name, path + f["name"], kind, free, position, f.get("defaultValueExpression"), f.get("maxLength"),
                               f.get("precision"), f.get("scale"))
                    yield from fields(f.get("fields", []), f"{path}{f['name']}.", within)

            yield from fields(get(f"{base}/{name}").get("schema", {}).get("fields", []))
        token = answer.get("nextPageToken")


SALESFORCE = "services/data/v59.0/sobjects"


def salesforce_parts(options: dict, get: Callable) -> list[str]:
    answer = get(f"{options['endpoint']}/{SALESFORCE}")
    return [o["name"] for o in answer["sobjects"] if o.get("queryable", True)]


def salesforce_rows(options: dict, part: str, get: Callable) -> Iterator[tuple]:
    fields = get(f"{options['endpoint']}/{SALESFORCE}/{part}/describe")["fields"]
    for i, f in enumerate(fields, 1):
        yield _row(None, part, f["name"], f["type"], bool(f["nillable"]), i, f.get("defaultValue"), f.get("length"), f.get("precision"), f.get("scale"))


def _store(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(path if re.match(r"[a-z0-9]+://", path) else f"file://{path}")


def lakehouse_parts(options: dict, get: Callable) -> list[str]:
    """Folders (or parquet files) directly below the path."""
    store, path = _store(options["endpoint"])
    found = store.get_file_info(pyarrow.fs.FileSelector(path))
    return sorted(f.base_name for f in found if not f.base_name.startswith(("_", ".")) and (
        f.type == pyarrow.fs.FileType.Directory or f.base_name.endswith(".parquet")))


def lakehouse_rows(options: dict, part: str, get: Callable) -> Iterator[tuple]:
    """The columns of a table by its last transaction that states them, or by the footer of one of its files."""
    store, base = _store(f"{options['endpoint'].rstrip('/')}/{part}")
    table = part.removesuffix(".parquet")
    files = [base] if store.get_file_info(base).type == pyarrow.fs.FileType.File else sorted(
        f.path for f in store.get_file_info(pyarrow.fs.FileSelector(base, recursive=True)) if f.type == pyarrow.fs.FileType.File)
    spark_schema = None
    for log in [f for f in files if re.search(r"/_delta_log/\d+\.json$", f)]:
        for line in store.open_input_stream(log).read().decode().splitlines():
            spark_schema = json.loads(line).get("metaData", {}).get("schemaString", spark_schema)
    data = [f for f in files if f.endswith(".parquet") and "/_" not in f.removeprefix(base)]
    if spark_schema is None and data:
        schema = pq.read_schema(store.open_input_file(data[0]))
        spark_schema = (schema.metadata or {}).get(b"org.apache.spark.sql.parquet.row.metadata")
        if spark_schema is None:
            for i, f in enumerate(schema, 1):
                decimal = pa.types.is_decimal(f.type)
                yield _row(options.get("schema"), table, f.name, str(f.type), f.nullable, i, None, None, f.type.precision if decimal else None,
                           f.type.scale if decimal else None)
            return
    for i, f in enumerate(json.loads(spark_schema or '{"fields": []}')["fields"], 1):
        kind = f["type"] if isinstance(f["type"], str) else f["type"]["type"]
        decimal = re.fullmatch(r"decimal\((\d+),(\d+)\)", kind)
        extra = f.get("metadata", {})
        chars = re.search(r"\((\d+)\)", extra.get("__CHAR_VARCHAR_TYPE_STRING", ""))
        yield _row(options.get("schema"), table, f["name"], kind, f["nullable"], i, extra.get("CURRENT_DEFAULT"), chars[1] if chars else None,
                   decimal[1] if decimal else None, decimal[2] if decimal else None)


KINDS = {"bigquery": (bigquery_parts, bigquery_rows), "salesforce": (salesforce_parts, salesforce_rows),
         "lakehouse": (lakehouse_parts, lakehouse_rows)}


def http_get(options: dict) -> Callable[[str], dict]:
    """A function from an address to its JSON answer; ``getter`` (``module:function``) replaces the network."""
    if options.get("getter"):
        return rest._load(options["getter"])
    headers = {"Authorization": "Bearer " + options["token"]} if options.get("token") else {}
    return lambda url: rest._get(url, headers)


class Part(InputPartition):
    def __init__(self, name: str):
        super().__init__(None)
        self.name = name


class CatalogReader(DataSourceReader):
    """A partition per schema, data set, object or table, as the source lists them."""

    def __init__(self, options: dict):
        self.options = options
        self.parts, self.rows = KINDS[options["kind"]]

    def partitions(self) -> list[InputPartition]:
        return [Part(name) for name in self.parts(self.options, http_get(self.options))]

    def read(self, partition: Part) -> Iterator[tuple]:
        yield from self.rows(self.options, partition.name, http_get(self.options))


class CatalogDataSource(DataSource):
    """``spark.read.format("catalog")`` with ``kind`` (see ``KINDS``), ``endpoint`` and what the kind needs."""

    @classmethod
    def name(cls) -> str:
        return "catalog"

    def schema(self) -> str:
        return ", ".join(f"`{c.split()[0]}` {c.split()[1]}" for c in CATALOG.split(", "))

    def reader(self, schema) -> CatalogReader:
        return CatalogReader(dict(self.options))


def catalog_rows(spark: SparkSession, cfg: dict) -> DataFrame:
    """The catalog of a source of any type that has one, in the columns of ``CATALOG``."""
    from quillon.sources.registry import _need, source_spec

    kind = cfg["type"]
    if source_spec(cfg).format == "jdbc":
        return jdbc_catalog(spark, cfg)
    if kind == "bigquery":
        (project,) = _need(cfg, "project_id")
        options = {"kind": kind, "endpoint": cfg.get("endpoint", "https://bigquery.googleapis.com/bigquery/v2"), "project": project}
    elif kind == "salesforce":
        (endpoint,) = _need(cfg, "instance_url")
        options = {"kind": kind, "endpoint": endpoint.rstrip("/")}
    elif source_spec(cfg).kind == "files":
        (path,) = _need(cfg, "path")
        options = {"kind": "lakehouse", "endpoint": path}
    else:
        raise ValueError(f"{kind} has no catalog of its own; name its tables")
    for key, name in (("access_token", "token"), ("getter", "getter"), ("schema_name", "schema")):
        if cfg.get(key):
            options[name] = cfg[key]
    spark.dataSource.register(CatalogDataSource)
    return spark.read.format("catalog").options(**options).load()


def as_drift_catalog(rows: DataFrame) -> DataFrame:
    """Catalog rows in the columns that drift reports compare: tables by their qualified names, types with their sizes."""
    sizes = F.when(F.col("max_length").isNotNull(), F.concat(F.lit("("), "max_length", F.lit(")"))).when(
        F.col("precision").isNotNull() & ~F.col("type").contains("("),
        F.concat(F.lit("("), F.concat_ws(",", "precision", "scale"), F.lit(")"))).otherwise("")
    return rows.select(F.col("qualified").alias("table"), "column", F.concat("type", sizes).alias("type"), "nullable", "position")
