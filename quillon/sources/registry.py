"""Source types, the reader options of each, and reading a table with pushed-down cuts."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from quillon.operators.catalog import catalog_of

# Fixed value: what a table may be called.
TABLE_NAME = re.compile(r"[a-zA-Z_][a-zA-Z0-9_.]*")


@dataclass(frozen=True)
class SourceSpec:
    """Reader format of a source type and the function that builds its options."""

    format: str
    options: Callable[[dict, str | None], dict[str, str]]
    kind: str = "table"  # table, files or stream


def check_table_name(name: str) -> str:
    if not TABLE_NAME.fullmatch(name):
        raise ValueError(f"not a table name: {name!r}")
    return name


def _need(cfg: dict, *keys: str) -> list:
    missing = [k for k in keys if cfg.get(k) in (None, "")]
    if missing:
        raise ValueError(f"source {cfg.get('type')!r} needs {', '.join(missing)}")
    return [cfg[k] for k in keys]


# JDBC drivers and address forms of the databases.
JDBC = {
    "sql_server": ("com.microsoft.sqlserver.jdbc.SQLServerDriver",
                   "jdbc:sqlserver://{host}:{port};databaseName={database}", 1433),
    "synapse": ("com.microsoft.sqlserver.jdbc.SQLServerDriver",
                "jdbc:sqlserver://{host}:{port};databaseName={database}", 1433),
    "postgresql": ("org.postgresql.Driver", "jdbc:postgresql://{host}:{port}/{database}", 5432),
    "mysql": ("com.mysql.cj.jdbc.Driver", "jdbc:mysql://{host}:{port}/{database}", 3306),
    "oracle": ("oracle.jdbc.OracleDriver", "jdbc:oracle:thin:@//{host}:{port}/{database}", 1521),
    "redshift": ("com.amazon.redshift.jdbc42.Driver", "jdbc:redshift://{host}:{port}/{database}", 5439),
    "snowflake": ("net.snowflake.client.jdbc.SnowflakeDriver",
                  "jdbc:snowflake://{account}.snowflakecomputing.com/?db={database}&schema={schema}&warehouse={warehouse}",
                  443),
}
PARTITION_OPTIONS = ("partitionColumn", "lowerBound", "upperBound", "numPartitions")


def jdbc_options(cfg: dict, table: str | None) -> dict[str, str]:
    """Reader options of a database; ``url`` replaces the built address.

    A large table is read in parallel with ``partitionColumn``, ``lowerBound``,
    ``upperBound`` and ``numPartitions``, which belong together.
    """
    kind = cfg["type"]
    driver, pattern, port = JDBC.get(kind, (cfg.get("driver"), None, None))
    if cfg.get("url"):
        url = cfg["url"]
    elif kind == "snowflake":
        account, database = _need(cfg, "account", "database")
        url = pattern.format(account=account, database=database, schema=cfg.get("schema", "PUBLIC"),
                             warehouse=cfg.get("warehouse", ""))
    else:
        host, database = _need(cfg, "host", "database")
        url = pattern.format(host=host, port=cfg.get("port", port), database=database)
    options = {"url": url, "fetchsize": str(cfg.get("fetchsize", 10_000)), "pushDownLimit": "true",
               "pushDownAggregate": "true"}
    if cfg.get("driver") or driver:
        options["driver"] = cfg.get("driver") or driver
    for key, name in (("user", "user"), ("username", "user"), ("password", "password")):
        if cfg.get(key):
            options[name] = str(cfg[key])
    if cfg.get("query"):
        options["query"] = cfg["query"]
    elif table:
        options["dbtable"] = check_table_name(table)
    given = [k for k in PARTITION_OPTIONS if cfg.get(k) is not None]
    if given:
        if len(given) != len(PARTITION_OPTIONS) or cfg.get("query"):
            raise ValueError("a partitioned read needs a table and " + ", ".join(PARTITION_OPTIONS))
        options.update({k: str(cfg[k]) for k in PARTITION_OPTIONS})
    return options


def bigquery_options(cfg: dict, table: str | None) -> dict[str, str]:
    project, dataset = _need(cfg, "project_id", "dataset")
    options = {"parentProject": project}
    if table:
        options["table"] = f"{project}.{dataset}.{check_table_name(table)}"
    if cfg.get("credentials_path"):
        options["credentialsFile"] = cfg["credentials_path"]
    return options


def mongodb_options(cfg: dict, table: str | None) -> dict[str, str]:
    uri, database = _need(cfg, "connection_string", "database")
    options = {"connection.uri": uri, "database": database}
    if table:
        options["collection"] = check_table_name(table)
    return options


def rest_options(cfg: dict, table: str | None) -> dict[str, str]:
    (endpoint,) = _need(cfg, "endpoint")
    options = {"endpoint": endpoint}
    if table:
        options["resource"] = check_table_name(table)
    for key in ("fetcher", "paginate", "parallelism", "headers", "params", "limit", "filter_params"):
        if cfg.get(key) is not None:
            options[key] = str(cfg[key])
    return options


def salesforce_options(cfg: dict, table: str | None) -> dict[str, str]:
    endpoint, token = _need(cfg, "instance_url", "access_token")
    options = {"endpoint": endpoint, "token": token, "paginate": "false", "pushdown": "soql",
               "fetcher": cfg.get("fetcher", "quillon.sources.rest:fetch_salesforce")}
    if table:
        options["resource"] = check_table_name(table)
    for key in ("columns", "predicates", "where", "limit"):
        if cfg.get(key) is not None:
            options[key] = str(cfg[key])
    return options


def csv_options(cfg: dict, table: str | None) -> dict[str, str]:
    options = {"header": str(cfg.get("header", True)).lower(), "sep": cfg.get("delimiter", ","),
               "encoding": cfg.get("encoding", "UTF-8")}
    if not cfg.get("schema"):
        options["inferSchema"] = "true"
    return options


def kafka_options(cfg: dict, table: str | None) -> dict[str, str]:
    (servers,) = _need(cfg, "bootstrap_servers")
    topic = table or cfg.get("topic")
    options = {"kafka.bootstrap.servers": servers if isinstance(servers, str) else ",".join(servers),
               "startingOffsets": cfg.get("starting_offsets", "earliest"),
               "failOnDataLoss": str(cfg.get("fail_on_data_loss", True)).lower()}
    if topic:
        options["subscribe"] = topic
    if cfg.get("batch_size"):
        options["maxOffsetsPerTrigger"] = str(cfg["batch_size"])
    return options


def event_hub_options(cfg: dict, table: str | None) -> dict[str, str]:
    """An event hub through its Kafka endpoint."""
    namespace, connection = _need(cfg, "namespace", "connection_string")
    hub = table or cfg.get("eventhub_name")
    login = ('org.apache.kafka.common.security.plain.PlainLoginModule required '
             f'username="$ConnectionString" password="{connection}";')
    options = kafka_options({"bootstrap_servers": f"{namespace}.servicebus.windows.net:9093", "topic": hub,
                             "batch_size": cfg.get("batch_size")}, None)
    options.update({"kafka.security.protocol": "SASL_SSL", "kafka.sasl.mechanism": "PLAIN",
                    "kafka.sasl.jaas.config": login})
    return options


def log_options(cfg: dict, table: str | None) -> dict[str, str]:
    """An append-only log behind an address, see :mod:`quillon.sources.log_stream`."""
    (endpoint,) = _need(cfg, "endpoint")
    options = {"endpoint": endpoint, "start": cfg.get("starting_offsets", "earliest")}
    for key, name in (("batch_size", "records_per_batch"), ("progress", "progress"), ("records_per_task", "records_per_task"),
                      ("fetcher", "fetcher"), ("headers", "headers")):
        if cfg.get(key) is not None:
            options[name] = str(cfg[key])
    return options


def _plain(cfg: dict, table: str | None) -> dict[str, str]:
    return {k: str(v) for k, v in cfg.get("options", {}).items()}


SOURCES: dict[str, SourceSpec] = {
    **{name: SourceSpec("jdbc", jdbc_options) for name in JDBC},
    "jdbc": SourceSpec("jdbc", jdbc_options),
    "bigquery": SourceSpec("bigquery", bigquery_options),
    "mongodb": SourceSpec("mongodb", mongodb_options),
    "api": SourceSpec("rest", rest_options),
    "salesforce": SourceSpec("rest", salesforce_options),
    "csv": SourceSpec("csv", csv_options, "files"),
    "json": SourceSpec("json", _plain, "files"),
    "parquet": SourceSpec("parquet", _plain, "files"),
    "excel": SourceSpec("excel", _plain, "files"),
    "s3": SourceSpec("mixed", csv_options, "files"),
    "onelake": SourceSpec("parquet", _plain, "files"),
    "kafka": SourceSpec("kafka", kafka_options, "stream"),
    "event_hub": SourceSpec("kafka", event_hub_options, "stream"),
    "log": SourceSpec("log", log_options, "stream"),
}


def source_spec(cfg: dict) -> SourceSpec:
    kind = cfg.get("type")
    if kind not in SOURCES:
        raise ValueError(f"unsupported source type {kind!r}; known: {', '.join(sorted(SOURCES))}")
    return SOURCES[kind]


def apply_cuts(df: DataFrame, columns: list[str] | None = None, where: str | None = None,
               limit: int | None = None) -> DataFrame:
    """Filter, then columns, then limit, for every source alike; the optimizer pushes them down."""
    if where:
        df = df.where(where)
    if columns and list(columns) != ["*"]:
        df = df.select(*columns)
    return df.limit(limit) if limit is not None else df


def read_source(spark: SparkSession, cfg: dict, table: str | None = None, columns: list[str] | None = None,
                where: str | None = None, limit: int | None = None) -> DataFrame:
    """One table of a source as a frame. Errors are raised, never turned into an empty frame."""
    from quillon.sources import files, rest

    spec = source_spec(cfg)
    if spec.kind == "stream":
        raise ValueError(f"{cfg['type']} is read with quillon.streaming.runner.read_stream")
    if spec.kind == "files":
        df = files.read_files(spark, cfg, spec, table)
    else:
        if spec.format == "rest":
            rest.register(spark)
        if spec.format == "rest" and limit is not None and not where and cfg.get("limit") is None:
            cfg = {**cfg, "limit": limit}  # without a filter the pages beyond the limit need not be read
        # a database has schemas of its own, so what it is read as has another key there
        read_as = cfg.get("read_schema") or (cfg.get("schema") if spec.format == "rest" else None)
        options = spec.options(cfg, table)
        if cfg["type"] == "salesforce" and read_as and columns and list(columns) != ["*"] and not cfg.get("columns"):
            read_as = narrowed(read_as, columns, where)
            options["columns"] = ", ".join(read_as.names)
        reader = spark.read.format(spec.format).options(**options)
        if read_as:
            reader = reader.schema(read_as)
            if spec.format == "rest":
                reader = reader.option("strict", str(cfg.get("strict", cfg["type"] != "salesforce")).lower())
        df = reader.load()
        if spec.format == "rest" and cfg.get("limit") is not None:
            df = df.limit(int(cfg["limit"]))  # a slice of its own may have as many
    if cfg["type"] == "salesforce" and "attributes" in df.columns:
        df = df.drop("attributes")
    return apply_cuts(df, columns, where, limit)


def narrowed(schema: StructType | str, columns: list[str], where: str | None) -> StructType:
    """The fields that a read needs: the wanted ones, and those that the filter names."""
    schema = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    wanted = {*columns, *re.findall(r"\w+", where or "")}
    return StructType([f for f in schema.fields if f.name in wanted])


def run_query(spark: SparkSession, cfg: dict, sql: str) -> DataFrame:
    """A query the database itself runs."""
    if source_spec(cfg).format != "jdbc":
        raise ValueError(f"{cfg['type']} runs no SQL of its own; register its tables and use guarded_sql")
    return read_source(spark, {**cfg, "query": sql})


def read_tables(spark: SparkSession, cfg: dict, tables: list[str] | None = None) -> dict[str, DataFrame]:
    """All wanted tables of a source (default: those the configuration names)."""
    names = tables or cfg.get("tables")
    if not names:
        from quillon.sources import files

        names = files.list_tables(spark, cfg) if source_spec(cfg).kind == "files" else list_source_tables(spark, cfg)
    return {name: read_source(spark, cfg, name) for name in names}


def list_source_tables(spark: SparkSession, cfg: dict) -> list[str]:
    """The qualified names of a source's tables, from its catalog: bounded by the size of that."""
    from quillon.sources.catalogs import catalog_rows

    return sorted(r[0] for r in catalog_rows(spark, cfg).select("qualified").distinct().collect())


def read_catalog(spark: SparkSession, cfg: dict, tables: list[str] | None = None) -> DataFrame:
    """Catalog rows of a source, from the schemas Spark reads for its tables."""
    return catalog_of(spark, read_tables(spark, cfg, tables))


def union_catalogs(catalogs: dict[str, DataFrame]) -> DataFrame:
    """One catalog of several sources, with the source's name."""
    return reduce(DataFrame.unionByName, [c.withColumn("source", F.lit(s)) for s, c in catalogs.items()])
