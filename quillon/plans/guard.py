"""Read-only SQL over registered frames."""

from __future__ import annotations

import re

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

# Words that a report query may not hold, outside of quotes.
FORBIDDEN = ("DROP", "DELETE", "TRUNCATE", "ALTER", "CREATE", "INSERT", "UPDATE", "EXEC", "EXECUTE")
FORBIDDEN_PREFIXES = ("XP_", "SP_")
COMMENT_MARKS = ("--", "/*", "*/")
FORBIDDEN_CALLS = ("REFLECT", "JAVA_METHOD", "TRY_REFLECT")
FILES_AS_TABLES = "spark.sql.runSQLOnFiles"

_QUOTED = re.compile(r"'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.)*\"|`[^`]*`", re.S)


def check_sql(sql: str) -> str:
    """The text without a closing semicolon, or ``ValueError``.

    Whole words count, so that a column ``created_at`` passes; quoted text is not looked at.
    """
    text = (sql or "").strip().rstrip(";").strip()
    if not text:
        raise ValueError("the query is empty")
    bare = _QUOTED.sub("''", text)
    found = [m for m in COMMENT_MARKS if m in bare]
    for word in re.findall(r"\w+", bare.upper()):
        if word in FORBIDDEN + FORBIDDEN_CALLS or word.startswith(FORBIDDEN_PREFIXES):
            found.append(word)
    # a function keeps its meaning in backquotes
    found += [name for name in re.findall(r"`([^`]*)`", text) if name.strip().upper() in FORBIDDEN_CALLS]
    if found:
        raise ValueError(f"not allowed in a query: {', '.join(sorted(set(found)))}")
    if ";" in bare:
        raise ValueError("one statement only")
    if not re.match(r"(SELECT|WITH)\b", bare, re.I):
        raise ValueError("a query starts with SELECT or WITH")
    return text


def relations(spark: SparkSession, text: str) -> set[str]:
    """The tables that a query names, also in its subqueries, less those that it defines itself by WITH."""
    bare = _QUOTED.sub(lambda m: m[0] if m[0][0] == "`" else "''", text)  # no quoted text can look like a plan
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(bare).toString()
    named = {part.replace("`", "").replace(", ", ".").lower() for part in re.findall(r"'UnresolvedRelation \[([^\]]*)\]", plan)}
    own = {name.strip().lower() for part in re.findall(r"(?m)^[ :+-]*CTE \[([^\]]*)\]", plan) for name in part.split(",")}
    return named - own


def guarded_sql(spark: SparkSession, sql: str, views: dict[str, DataFrame] | None = None) -> DataFrame:
    """Run a checked query over ``views`` and nothing else: no other view or table of the session, and no path.

    The names hold while the query is analysed, which binds it to these frames. Other temporary views are out of sight
    meanwhile; all views that the session has come back afterwards.
    """
    text = check_sql(sql)
    views = views or {}
    strange = relations(spark, text) - {v.lower() for v in views}
    if strange:
        raise ValueError(f"not a registered frame: {', '.join(sorted(strange))}")
    # a name of a WITH may hide one of these, but must not stand for it
    held = {t.name: spark.table(t.name) for t in spark.catalog.listTables() if t.isTemporary and not t.namespace}
    files = spark.conf.get(FILES_AS_TABLES)
    spark.conf.set(FILES_AS_TABLES, "false")
    try:
        for name in held:
            spark.catalog.dropTempView(name)
        for name, df in views.items():
            df.createOrReplaceTempView(name)
        return spark.sql(text)
    finally:
        spark.conf.set(FILES_AS_TABLES, files)
        for name in views:
            spark.catalog.dropTempView(name)
        for name, df in held.items():
            df.createOrReplaceTempView(name)


def run_batch(spark: SparkSession, queries: list[dict], sources: dict[str, dict[str, DataFrame]] | None = None,
              ) -> tuple[list[dict], dict[str, DataFrame]]:
    """``(status, results)`` of queries ``{id, query, data_source}``, each on its own.

    A query that fails is reported in its status; the others still run. Results stay frames.
    """
    status, results = [], {}
    for q in queries:
        try:
            views = (sources or {})[q["data_source"]] if q.get("data_source") else None
            df = guarded_sql(spark, q["query"], views)
            results[q["id"]] = df
            status.append({"id": q["id"], "status": "success", "columns": df.columns, "error": None})
        except (ValueError, KeyError, PySparkException) as error:
            status.append({"id": q["id"], "status": "error", "columns": [], "error": str(error)})
    return status, results
