"""REST endpoints as a Spark data source: pages are read in parallel by the tasks."""

from __future__ import annotations

import datetime
import importlib
import json
import time
import urllib.parse
import urllib.request
from collections.abc import Iterable, Iterator
from itertools import islice

from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull,
    LessThan, LessThanOrEqual, Not,
)
from pyspark.sql.types import (
    BooleanType, DataType, DoubleType, LongType, NullType, StringType, StructField, StructType,
)

RETRIES = 3


def _get(url: str, headers: dict[str, str]):
    """A decoded JSON answer, tried again with growing pauses."""
    for attempt in range(RETRIES):
        try:
            with urllib.request.urlopen(urllib.request.Request(url, headers=headers), timeout=60) as answer:
                return json.load(answer)
        except OSError:
            if attempt == RETRIES - 1:
                raise
            time.sleep(2 ** attempt)


def fetch_http(options: dict[str, str], page: int | None):
    """One page of ``endpoint/resource``; without a page number the whole answer."""
    url = options["endpoint"].rstrip("/") + ("/" + options["resource"] if options.get("resource") else "")
    params = json.loads(options.get("params", "{}"))
    if page is not None:
        params["page"] = page
    if params:
        url += "?" + urllib.parse.urlencode(params)
    return _get(url, json.loads(options.get("headers", "{}")))


def soql(options: dict[str, str], predicate: str | None) -> str:
    """The object query of a scan."""
    conditions = [c for c in (options.get("where"), predicate, *json.loads(options.get("pushed", "[]"))) if c]
    text = f"SELECT {options.get('columns', 'FIELDS(ALL)')} FROM {options['resource']}"
    text += " WHERE " + " AND ".join(f"({c})" for c in conditions) if conditions else ""
    return text + (f" LIMIT {int(options['limit'])}" if int(options.get("limit", -1)) >= 0 else "")


def soql_value(value) -> str | None:
    """A value as the object query language writes it; none for types that it compares otherwise than Spark."""
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, (int, float)):
        return repr(value)
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    if isinstance(value, datetime.datetime):
        return value.astimezone(datetime.timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ") if value.tzinfo and not value.microsecond else None
    return value.isoformat() if isinstance(value, datetime.date) else None


#: Comparisons with the same meaning on both sides. Texts are compared without regard to case there, which only lets more
#: rows through, so equality is tested again by Spark.
COMPARISONS = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}


def soql_condition(f: Filter) -> str | None:
    """A filter as a condition, or none if it has to stay with Spark."""
    if isinstance(f, Not):
        inner = f.child
        return f"{'.'.join(inner.attribute)} != NULL" if isinstance(inner, IsNull) else None
    name = ".".join(f.attribute) if hasattr(f, "attribute") else ""
    if isinstance(f, IsNotNull):
        return f"{name} != NULL"
    if isinstance(f, IsNull):
        return f"{name} = NULL"
    if isinstance(f, In):
        values = [soql_value(v) for v in f.value]
        return f"{name} IN ({', '.join(values)})" if values and None not in values else None
    if type(f) in COMPARISONS:
        value = soql_value(f.value)
        # the order of texts is the server's own
        if value is not None and (isinstance(f, EqualTo) or not isinstance(f.value, str)):
            return f"{name} {COMPARISONS[type(f)]} {value}"
    return None


def fetch_salesforce(options: dict[str, str], predicate: str | None):
    """All records of one predicate, following the links to the next batch."""
    base, headers = options["endpoint"].rstrip("/"), {"Authorization": "Bearer " + options["token"]}
    query = urllib.parse.urlencode({"q": soql(options, predicate)})
    url = f"{base}/services/data/v59.0/query?{query}"
    while url:
        answer = _get(url, headers)
        yield from answer["records"]
        url = base + answer["nextRecordsUrl"] if answer.get("nextRecordsUrl") else None


class Stripe(InputPartition):
    """Every ``step``-th page from ``first`` on."""

    def __init__(self, first: int, step: int):
        super().__init__(None)
        self.first, self.step = first, step


class Slice(InputPartition):
    """The rows of one predicate (or of the whole resource)."""

    def __init__(self, predicate: str | None):
        super().__init__(None)
        self.predicate = predicate


def _load(name: str):
    module, _, attribute = name.partition(":")
    return getattr(importlib.import_module(module), attribute)


def _records(answer) -> Iterator[dict]:
    """A list or an iterator holds the rows; a single object is one row; anything else is no data."""
    if isinstance(answer, dict):
        yield answer
    elif answer is not None and not isinstance(answer, (str, int, float, bool)):
        yield from answer


class RestReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]):
        self.schema, self.options = schema, options

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Conditions that the server can test go with the request.

        An object query takes comparisons. A plain endpoint takes equality on the fields that ``filter_params`` (JSON, field to
        parameter) names. Spark tests what may let too many rows through again.
        """
        names = json.loads(self.options.get("filter_params", "{}"))
        objects = self.options.get("pushdown") == "soql"
        conditions, params, rest = [], {}, []
        for f in filters:
            condition = soql_condition(f) if objects else None
            if condition:
                conditions.append(condition)
            elif not objects and isinstance(f, EqualTo) and ".".join(f.attribute) in names and isinstance(f.value, (str, int)):
                params[names[".".join(f.attribute)]] = f.value
            if not condition or isinstance(f, (EqualTo, In)):
                rest.append(f)
        if conditions:
            self.options["pushed"] = json.dumps(conditions)
        if params:
            self.options["params"] = json.dumps(json.loads(self.options.get("params", "{}")) | params)
        return rest

    def partitions(self) -> list[InputPartition]:
        if self.options.get("paginate", "false").lower() == "true":
            # a limit needs no more pages than hold its rows: they are read one after the other, and none beside them
            step = 1 if int(self.options.get("limit", -1)) >= 0 else int(self.options.get("parallelism", "8"))
            return [Stripe(first, step) for first in range(1, step + 1)]
        return [Slice(p) for p in json.loads(self.options.get("predicates", "[null]"))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        fetch = _load(self.options.get("fetcher", "quillon.sources.rest:fetch_http"))
        left = int(self.options.get("limit", -1))
        if isinstance(partition, Slice):
            rows = map(self._row, _records(fetch(self.options, partition.predicate)))
            yield from islice(rows, left) if left >= 0 else rows
            return
        page = partition.first
        while left != 0:
            answer = fetch(self.options, page)
            if isinstance(answer, dict) and page == 1:
                yield self._row(answer)
                return
            # pages end at the first one that is empty
            if not answer and (answer is None or isinstance(answer, list)):
                return
            if not isinstance(answer, list):
                raise ValueError(f"page {page} is no list of records: {json.dumps(answer)[:200]}")
            for record in answer[:left] if left > 0 else answer:
                yield self._row(record)
            left = max(left - len(answer), 0) if left > 0 else left
            page += partition.step

    def _row(self, record: dict) -> tuple:
        if self.options.get("strict", "true").lower() == "true":
            unknown = sorted(set(record) - {f.name for f in self.schema.fields})
            if unknown:
                raise ValueError(f"fields that the schema lacks: {', '.join(unknown)}; pass a schema with them, "
                                 "or strict=false to leave them out")
        return tuple(_as(record.get(f.name), f.dataType.typeName()) for f in self.schema.fields)


def _as(value, kind: str):
    if value is None:
        return None
    if kind == "string":
        return value if isinstance(value, str) else json.dumps(value)
    if kind in ("long", "integer") and (isinstance(value, bool) or not isinstance(value, int)) or (
            kind == "boolean" and not isinstance(value, bool)) or (
            kind in ("double", "float") and (isinstance(value, bool) or not isinstance(value, (int, float)))):
        raise ValueError(f"{json.dumps(value)[:100]} is no {kind}; pass a schema that fits")
    return float(value) if kind in ("double", "float") else value


def _kind(value) -> DataType:
    if value is None:
        return NullType()
    if isinstance(value, bool):
        return BooleanType()
    return LongType() if isinstance(value, int) else DoubleType() if isinstance(value, float) else StringType()


class RestDataSource(DataSource):
    """``spark.read.format("rest")`` with the options ``endpoint``, ``resource``, ``paginate``,
    ``parallelism`` (pages read side by side), ``headers`` and ``params`` (JSON), ``strict``
    (``false`` leaves out fields that the schema lacks instead of failing), ``limit`` (rows to read; pages
    beyond them are not fetched), ``filter_params`` (fields that the server can filter) and ``fetcher`` (``module:function``, to read something other than HTTP)."""

    @classmethod
    def name(cls) -> str:
        return "rest"

    def schema(self) -> StructType:
        """Types of the records of the first answer, when no schema is given.

        A later record with another field or a value that does not fit its type is an error.
        """
        fetch = _load(self.options.get("fetcher", "quillon.sources.rest:fetch_http"))
        paged = self.options.get("paginate", "false").lower() == "true"
        rows = list(_records(fetch(dict(self.options), 1 if paged else None)))
        if not rows:
            raise ValueError("the endpoint returned no record to infer a schema from; pass one")
        found: dict[str, DataType] = {}
        for name, value in (cell for row in rows for cell in row.items()):
            kind = _kind(value)
            old = found.setdefault(name, NullType())
            if isinstance(old, NullType):
                found[name] = kind
            elif not isinstance(kind, NullType) and kind != old:
                numbers = {kind, old} <= {LongType(), DoubleType()}
                found[name] = DoubleType() if numbers else StringType()
        return StructType([StructField(n, StringType() if isinstance(k, NullType) else k) for n, k in found.items()])

    def reader(self, schema: StructType) -> RestReader:
        return RestReader(schema, dict(self.options))


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RestDataSource)
