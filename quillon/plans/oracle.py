"""The expected results in plain SQL for an independent engine, one statement per query."""

from __future__ import annotations

import re

# The columns of the test tables with their Spark types.
COLUMNS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
                "l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}
SCHEMA = {t: [tuple(c.split(" ")) for c in cols.split(", ")] for t, cols in COLUMNS.items()}


def _key_columns() -> dict[str, list[str]]:
    """Columns that are keys by name: a part of it is id, key or pk, or a part ends in key or pk."""
    rule = re.compile(r"(^|_)(id|key|pk)(_|$)|(key|pk)(_|$)")
    return {t: [c for c, _ in cols if rule.search(c)] for t, cols in SCHEMA.items()}


KEY_COLUMNS = _key_columns()


def _edges() -> list[tuple[str, str, str, str]]:
    """Edges that names suggest: to the first key of a table, from the first column of another one that is called like
    it, prefixes of one or two letters aside. Whether that key is unique is for the data to say (``_unique``)."""
    out = []
    for to, keys in KEY_COLUMNS.items():
        bare = re.sub("^[a-z]{1,2}_", "", keys[0])
        for source, cols in SCHEMA.items():
            named = [c for c, _ in cols if re.sub("^[a-z]{1,2}_", "", c) in (bare, f"{to}_{bare}", f"{to}id")]
            if source != to and named:
                out.append((source, named[0], to, keys[0]))
    return out


EDGES = _edges()

REV = "CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4))"
PRICE = "CAST(o_totalprice AS DECIMAL(18,4))"
BLANKED = """blanked AS (
    SELECT o_orderkey, o_custkey, o_orderstatus, o_orderdate,
           CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS o_totalprice,
           CASE WHEN o_orderkey % 2 <> 0 THEN o_orderpriority END AS o_orderpriority FROM orders)"""
USER_REF = "CASE WHEN event_id % 5 = 0 THEN event_type ELSE CAST(user_id AS VARCHAR) END"


def _union(parts) -> str:
    return " UNION ALL ".join(parts)


def _pct(part: str, whole: str) -> str:
    return f"CAST(round_even(CAST({part} AS DOUBLE) * 100 / CAST({whole} AS DOUBLE), 2) AS DOUBLE)"


def _counts(source: str, columns) -> str:
    """Column counts of a relation."""
    return _union(
        f"""SELECT '{c}' AS "column", count(*) AS row_count, count(*) - count({c}) AS null_count,
            count(DISTINCT {c}) AS unique_count FROM {source}""" for c in columns)


def _names(table: str) -> list[str]:
    return [c for c, _ in SCHEMA[table]]


def _fill(tables) -> str:
    return _union(
        f"""SELECT '{t}' AS "table", '{c}' AS "column", count(*) AS row_count, count({c}) AS value_count FROM {t}"""
        for t in tables for c in _names(t))


def _issues(source: str) -> str:
    """CTE bodies of the counts and threshold findings of a relation."""
    return f"""
      pct AS (SELECT *, {_pct('null_count', 'row_count')} AS null_percentage,
                     {_pct('row_count - unique_count', 'row_count')} AS duplicate_percentage FROM ({source})),
      found AS (
        SELECT "column", 'high_null_percentage' AS type,
               CASE WHEN null_percentage > 50 THEN 'error' ELSE 'warning' END AS severity,
               null_percentage AS percentage, CAST(30 AS DOUBLE) AS threshold FROM pct WHERE null_percentage > 30
        UNION ALL
        SELECT "column", 'high_duplicate_percentage', 'warning', duplicate_percentage, CAST(10 AS DOUBLE)
        FROM pct WHERE duplicate_percentage > 10)"""


def _score(table: str, source: str, strict: bool) -> str:
    n1, n2, d1, d2 = (30, 10, 20, 5) if strict else (15, 5, 10, 3)
    return f"""SELECT '{table}' AS "table", {str(strict).lower()} AS strict, i.issue_count, i.error_count,
        CAST(greatest(0, least(100, 100 - 20 * error_count - 5 * (issue_count - error_count) - points)) AS DOUBLE) AS score
      FROM (WITH {_issues(source)} SELECT count(*) AS issue_count,
                 count(*) FILTER (severity = 'error') AS error_count FROM found) i,
           (WITH {_issues(source)} SELECT sum(
               CASE WHEN null_percentage > 50 THEN {n1} WHEN null_percentage > 20 THEN {n2} ELSE 0 END
             + CASE WHEN duplicate_percentage > 50 THEN {d1} WHEN duplicate_percentage > 20 THEN {d2} ELSE 0 END)
             AS points FROM pct) p"""


def _moments(table: str, column: str) -> str:
    c = f"CAST({column} AS DOUBLE)"
    return f"""SELECT '{column}' AS "column",
        round(avg(power(x - m, 3)) / power(avg(power(x - m, 2)), 1.5), 6) AS skewness,
        round(avg(power(x - m, 4)) / power(avg(power(x - m, 2)), 2) - 3, 6) AS kurtosis
      FROM (SELECT {c} AS x, (SELECT avg({c}) FROM {table}) AS m FROM {table})"""


def _numeric(source: str, column: str, extra: str) -> str:
    return f"""SELECT '{column}' AS "column", count({column}) AS count, CAST(min({column}) AS DOUBLE) AS min,
        CAST(max({column}) AS DOUBLE) AS max, round(avg({column}), 4) AS mean,
        round(stddev_samp({column}), 4) AS std, {extra} FROM {source}"""


def _quantile(column: str, p: float) -> str:
    return f"round(quantile_cont(CAST({column} AS DOUBLE), {p}), 4)"


def _top(table: str, column: str) -> str:
    return f"""SELECT '{column}' AS "column", '{table}' AS "table", value, rows, rank FROM (
        SELECT *, row_number() OVER (ORDER BY rows DESC, value) AS rank
        FROM (SELECT {column} AS value, count(*) AS rows FROM {table} WHERE {column} IS NOT NULL GROUP BY 1))
      WHERE rank <= 10"""


def _text(table: str, column: str) -> str:
    return f"""SELECT '{column}' AS "column", count(*) AS unique_count,
        CASE WHEN stddev_samp(rows) < 1 THEN 'uniform' ELSE 'skewed' END AS value_distribution,
        round(CAST(sum(rows * length(value)) AS DOUBLE) / CAST(sum(rows) AS DOUBLE), 6) AS avg_length,
        CAST(max(length(value)) AS BIGINT) AS max_length, CAST(min(length(value)) AS BIGINT) AS min_length
      FROM (SELECT {column} AS value, count(*) AS rows FROM {table} WHERE {column} IS NOT NULL GROUP BY 1)"""


def _fences(table: str, column: str) -> str:
    return f"""SELECT quantile_cont(CAST({column} AS DOUBLE), 0.25) AS q1,
        quantile_cont(CAST({column} AS DOUBLE), 0.75) AS q3 FROM {table}"""


def _outlier_share(table: str, column: str) -> str:
    return f"""SELECT '{column}' AS "column", count(*) AS outlier_count,
        {_pct('count(*)', f'(SELECT count(*) FROM {table})')} AS outlier_percentage
      FROM {table}, ({_fences(table, column)}) q
      WHERE {column} < q1 - 1.5 * (q3 - q1) OR {column} > q3 + 1.5 * (q3 - q1)"""


def _correlation() -> str:
    cols = {"l_quantity": "l_quantity", "l_extendedprice": "l_extendedprice", "l_discount": "l_discount",
            "l_tax": "l_tax", "net_price": "l_extendedprice * (1 - l_discount)", "constant": "CAST(1 AS DOUBLE)"}
    names, parts = list(cols), []
    for i, a in enumerate(names):
        for b in names[i + 1:]:
            r = f"corr({cols[a]}, {cols[b]})"
            parts.append(f"SELECT '{a}' AS column_a, '{b}' AS column_b, CASE WHEN NOT isnan({r}) THEN round({r}, 6) END AS r FROM lineitem")
    return f"SELECT *, abs(r) > 0.7 AS is_high FROM ({_union(parts)})"


TIMED = f"""
    totals AS (SELECT o_orderpriority, year(o_orderdate) AS year, month(o_orderdate) AS period,
                      sum({PRICE}) AS value FROM orders GROUP BY ALL)"""


def _timed(what: str) -> str:
    return f"WITH {TIMED} SELECT t.o_orderpriority, t.year, t.period, {what}"


PRIOR = """ FROM totals t LEFT JOIN totals p
    ON t.o_orderpriority = p.o_orderpriority AND t.year = p.year + 1 AND t.period = p.period"""


def _to_date(shift: int) -> str:
    return f"""(SELECT CAST(sum(p.value) AS DOUBLE) FROM totals p WHERE p.o_orderpriority = t.o_orderpriority
        AND p.year = t.year - {shift} AND p.period <= t.period)"""


ORDER_REVENUE = f"""
    sold AS (SELECT o_orderkey, o_custkey, o_orderdate, o_orderpriority, revenue, units FROM orders JOIN (
        SELECT l_orderkey, sum({REV}) AS revenue, sum(CAST(l_quantity AS DECIMAL(18,4))) AS units
        FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey)"""
PART_REVENUE = f"""
    sold AS (SELECT p_partkey, p_name, p_type, p_brand, l_returnflag, {REV} AS revenue,
                    CAST(l_quantity AS DECIMAL(18,4)) AS units
             FROM lineitem JOIN part ON l_partkey = p_partkey)"""
NATION_OF = """JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    JOIN region ON n_regionkey = r_regionkey"""
CUSTOMER_MONTHS = """
    months AS (SELECT o_custkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, count(*) AS order_count
               FROM orders GROUP BY ALL),
    active AS (SELECT *, min(month) OVER (PARTITION BY o_custkey) AS first_month FROM months)"""
CUSTOMER_FACTS = f"""
    facts AS (SELECT o_custkey, max(CAST(o_orderdate AS DATE)) AS last_day, count(*) AS frequency,
                     CAST(sum({PRICE}) AS DOUBLE) AS spend FROM orders GROUP BY 1)"""


def _held_edges() -> str:
    """Edges, either way round, along which every key has a partner."""
    ways = [(e, e[2:]) for e in EDGES] + [((c, d, a, b), (c, d)) for a, b, c, d in EDGES]
    return "SELECT DISTINCT a, b FROM (" + _union(
        f"SELECT '{a}' AS a, '{c}' AS b WHERE {_unique(*key)} AND NOT EXISTS (SELECT 1 FROM {a} WHERE {b} NOT IN (SELECT {d} FROM {c}))"
        for (a, b, c, d), key in ways) + ")"


def _cycles() -> str:
    return f"""WITH RECURSIVE edges AS MATERIALIZED ({_held_edges()}),
      walk AS (
        SELECT a AS start, b AS here, [a, b] AS path, 1 AS steps FROM edges WHERE b >= a
        UNION ALL
        SELECT start, b, list_append(path, b), steps + 1 FROM walk JOIN edges ON here = a
        WHERE here <> start AND (b = start OR (b > start AND NOT list_contains(path, b))) AND steps < {len(SCHEMA)})
      SELECT array_to_string(path, ' -> ') AS cycle, CAST(steps AS BIGINT) AS length FROM walk WHERE here = start"""


def _unique(table: str, column: str) -> str:
    return f"(SELECT count(*) = count(DISTINCT {column}) FROM {table})"


def _classified() -> str:
    measures = {"part": 1, "orders": 1, "lineitem": 2, "events": 1}
    parts = []
    for t, keys in KEY_COLUMNS.items():
        foreign = " + ".join(f"CASE WHEN {_unique(t, k)} THEN 0 ELSE 1 END" for k in keys)
        parts.append(f"""SELECT '{t}' AS "table", CAST({measures.get(t, 0)} AS BIGINT) AS measure_count,
            CAST({foreign} AS BIGINT) AS foreign_key_count, '{keys[0]}' AS primary_key, '{','.join(keys)}' AS keys""")
    return f"""SELECT "table", CASE WHEN measure_count > 0 AND foreign_key_count > 0 THEN 'fact' ELSE 'dimension' END
        AS kind, measure_count, foreign_key_count, primary_key,
        CASE WHEN measure_count > 0 AND foreign_key_count > 0 THEN keys END AS grain FROM ({_union(parts)})"""


def _model_score() -> str:
    no_key = " + ".join(
        "CASE WHEN " + " OR ".join(_unique(t, k) for k in keys) + " THEN 0 ELSE 1 END" for t, keys in KEY_COLUMNS.items())
    m2m = " + ".join(
        f"""CASE WHEN {_unique(c, d)} AND NOT {_unique(a, b)} AND NOT {_unique(c, d)} THEN 1 ELSE 0 END""" for a, b, c, d in EDGES)
    wrong = " + ".join(f"CASE WHEN {_unique(c, d)} AND {_unique(a, b)} THEN 1 ELSE 0 END" for a, b, c, d in EDGES
                       if a in ("orders", "lineitem", "events") and c not in ("orders", "lineitem", "events"))
    return f"""WITH s AS (SELECT CAST({no_key} AS BIGINT) AS tables_without_key, CAST({m2m} AS BIGINT) AS many_to_many,
          (SELECT count(*) FROM ({_cycles()})) AS cycles, ({wrong}) = 0 AS is_compliant)
        SELECT *, CAST(greatest(0, 100 - CASE WHEN cycles > 0 THEN 20 ELSE 0 END - 10 * tables_without_key
               - 5 * many_to_many - CASE WHEN is_compliant THEN 0 ELSE 5 END) AS BIGINT) AS score FROM s"""


def _suggested() -> str:
    measures = [("part", "p_retailprice"), ("orders", "o_totalprice"), ("lineitem", "l_quantity"),
                ("lineitem", "l_extendedprice"), ("events", "value")]
    category = [("part", "p_type"), ("events", "event_type")]
    rows = []
    for t in SCHEMA:
        for c, kind in SCHEMA[t]:
            if (t, c) in measures:
                rows.append((t, c, "measure", "SUM"))
            elif kind == "timestamp_ntz":
                rows.append((t, c, "dimension", "time"))
            elif kind == "string":
                rows.append((t, c, "dimension", "category" if (t, c) in category else "attribute"))
    return _union(
        f"""SELECT '{t}' AS "table", '{c}' AS "column", '{r}' AS role, '{s}' AS suggestion, count(*) AS row_count,
            count({c}) AS value_count FROM {t}""" for t, c, r, s in rows)


def _relevance() -> str:
    names = ", ".join(f"('{t}', '{c}')" for t in SCHEMA for c in _names(t))
    words = ("sales", "revenue", "customer", "product", "order", "transaction")
    bonus = " + ".join(f"CASE WHEN contains(t, '{w}') THEN 3 ELSE 0 END" for w in words)
    return rf"""WITH cat(t, c) AS (VALUES {names}), tabs AS (SELECT DISTINCT t FROM cat),
      said AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+')) AS word FROM documents),
      counted AS (SELECT doc_id, word, count(*) AS n FROM said GROUP BY ALL),
      vocabulary AS (SELECT DISTINCT word FROM counted),
      weights AS (SELECT word, t, sum(points) AS weight FROM (
          SELECT word, t, 2 AS points FROM vocabulary JOIN tabs ON contains(t, word)
          UNION ALL SELECT word, t, 1 FROM vocabulary JOIN cat ON contains(c, word)) GROUP BY ALL),
      scored AS (SELECT doc_id, t, sum(points) AS score FROM (
          SELECT doc_id, t, n * weight AS points FROM counted JOIN weights USING (word)
          UNION ALL SELECT doc_id, t, {bonus} FROM documents, tabs) GROUP BY ALL HAVING sum(points) > 0)
      SELECT doc_id, t AS "table", CAST(score AS BIGINT) AS score, rank FROM (
          SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, t) AS rank FROM scored)
      WHERE rank <= 5"""


def _redacted() -> str:
    space = r"\s\x0B\x1C-\x1F\x{85}\p{Z}"
    text = "text"
    for name in ("api[_-]?key", "password", "token", "secret"):
        text = (f"""regexp_replace({text}, '({name}["{space}]*[:=]["{space}]*)[^{space}"]+', """
                r"""'\1***REDACTED***', 'gi')""")
    return f"SELECT doc_id, {text} AS text FROM documents"


def _bundle() -> str:
    page = f"WITH {ORDER_REVENUE}, page AS (SELECT * FROM sold {NATION_OF}) "
    total = {"Revenue": "sum(revenue)", "Units": "sum(units)", "Orders": "count(o_orderkey)"}

    def part(priority: int, kind: str, category: str, names, share: bool = False) -> list[str]:
        group = "" if category == "NULL" else f" GROUP BY {category}"
        out = []
        for n in names:
            value = f"round(CAST({total[n]} AS DOUBLE), 6)"
            if share:
                value = f"round(CAST({total[n]} AS DOUBLE) / (SELECT CAST({total[n]} AS DOUBLE) FROM page), 6)"
            out.append(f"""SELECT CAST({priority} AS BIGINT) AS priority, '{kind}' AS visual,
                CAST({category} AS VARCHAR) AS category, '{n}' AS measure, {value} AS value FROM page{group}""")
        return out

    every = list(total)
    return page + _union(
        part(1, "line", "strftime(o_orderdate, '%Y-%m')", every) + part(1, "column", "o_orderpriority", every[:2])
        + part(3, "pie", "o_orderpriority", every[:1], True) + part(2, "map", "r_name", every[:1])
        + part(1, "card", "NULL", every))


def _chunks() -> str:
    numbered = "(SELECT *, (row_number() OVER (ORDER BY o_orderkey) - 1) // 5000 AS chunk FROM orders)"
    return _union(
        f"""SELECT chunk, '{c}' AS "column", count({c}) AS count, round(avg({c}), 4) AS mean,
            round(stddev_samp({c}), 4) AS std, CAST(min({c}) AS DOUBLE) AS min, {_quantile(c, 0.5)} AS median,
            CAST(max({c}) AS DOUBLE) AS max FROM {numbered} GROUP BY chunk""" for c in ("o_totalprice", "o_custkey"))


def _memory() -> str:
    width = {"int": 4, "bigint": 8, "double": 8, "timestamp_ntz": 8}
    parts = []
    for t in ("orders", "lineitem", "documents", "events"):
        fixed = sum(width.get(k, 0) for _, k in SCHEMA[t])
        text = "".join(f" + sum(strlen({c}))" for c, k in SCHEMA[t] if k == "string")
        parts.append(f"""SELECT count(*) AS row_count, CAST({len(SCHEMA[t])} AS BIGINT) AS column_count,
            CAST(count(*) * {fixed}{text} AS BIGINT) AS memory_bytes, '{t}' AS "table" FROM {t}""")
    return _union(parts)


def _datetime(table: str, column: str) -> str:
    stamp = "'%Y-%m-%dT%H:%M:%S.%f'"
    return f"""SELECT '{column}' AS "column", strftime(min({column}), {stamp}) AS min_date,
        strftime(max({column}), {stamp}) AS max_date,
        CAST((epoch_us(max({column})) - epoch_us(min({column}))) // 86400000000 AS BIGINT) AS date_range_days FROM {table}"""


def _checked(rule: str, column: str, severity: str, bad: str, source: str, value: str | None = None) -> str:
    value = value or column
    return f"""SELECT '{rule}' AS rule, '{column}' AS "column", '{severity}' AS severity, count({value}) AS checked,
        count(*) FILTER ({bad}) AS violations FROM {source}"""


def statements() -> dict[str, str]:
    fill, counts = _fill(SCHEMA), _union(f"""SELECT '{t}' AS "table", count(*) AS row_count FROM {t}""" for t in SCHEMA)
    types = ", ".join(f"('{t}', '{c}', '{k}', CAST({i + 1} AS BIGINT))"
                      for t, cols in SCHEMA.items() for i, (c, k) in enumerate(cols))
    widest = sorted(SCHEMA, key=lambda t: (-len(SCHEMA[t]), t))[:4]
    summary = ", ".join(
        f"('{t}', '{c}', CAST({i + 1} AS BIGINT), CAST({r + 1} AS BIGINT), CAST({len(SCHEMA[t])} AS BIGINT))"
        for r, t in enumerate(widest) for i, c in enumerate(_names(t)[:5]))
    cells = " + ".join(f"(SELECT count(*) FROM {t}) * {len(SCHEMA[t])}" for t in SCHEMA)
    model_rows = " + ".join(f"(SELECT count(*) FROM {t})" for t in SCHEMA)
    model_columns = sum(len(SCHEMA[t]) for t in SCHEMA)
    return {
        "scan_csv_roundtrip": """SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice,
            CAST(o_orderdate AS DATE) AS o_orderdate, o_orderpriority FROM orders""",
        "scan_json_multi": """SELECT c_custkey AS party_key, c_name AS name, c_acctbal AS balance FROM customer
            UNION ALL SELECT s_suppkey, s_name, s_acctbal FROM supplier""",
        "union_files": """SELECT c_custkey AS party_key, c_name AS name, c_mktsegment AS segment,
            CAST(NULL AS DOUBLE) AS balance FROM customer
            UNION ALL SELECT s_suppkey, s_name, NULL, s_acctbal FROM supplier""",
        "flatten_json_props": """SELECT event_id, user_id AS "source.user_id", event_type AS "source.event.event_type",
            value AS "source.event.value", CAST(json_extract(props, '$.k') AS BIGINT) AS "details.k" FROM events""",
        "project_filter_limit": """SELECT l_orderkey, l_partkey, l_linenumber, l_extendedprice FROM lineitem
            WHERE l_quantity >= 45 AND l_returnflag = 'R'
            ORDER BY l_extendedprice DESC, l_orderkey, l_partkey, l_linenumber LIMIT 100""",
        "sample_rows": """SELECT o_orderkey, o_custkey, o_totalprice, o_orderstatus FROM orders
            ORDER BY o_orderkey LIMIT 1000""",
        "cast_plan_events": _union([
            """SELECT 'event_id' AS "column", 'decimal(20,2)' AS target_type, count(event_id) AS value_count,
               count(*) FILTER (TRY_CAST(event_id AS DECIMAL(20,2)) IS NULL) AS failed_count FROM events""",
            "SELECT 'value', 'bigint', count(value), count(*) FILTER (TRY_CAST(value AS BIGINT) IS NULL) FROM events",
            "SELECT 'event_type', 'date', count(event_type), count(*) FILTER (TRY_CAST(event_type AS DATE) IS NULL) FROM events",
            "SELECT 'props', 'bigint', count(props), count(*) FILTER (TRY_CAST(props AS BIGINT) IS NULL) FROM events",
            f"SELECT 'user_ref', 'bigint', count({USER_REF}), count(*) FILTER (TRY_CAST({USER_REF} AS BIGINT) IS NULL) FROM events"]),
        "cast_rows_events": f"SELECT event_id, TRY_CAST({USER_REF} AS BIGINT) AS user_ref, event_type FROM events",
        "filter_last_12_months": """SELECT o_orderkey, CAST(o_orderdate AS DATE) AS o_orderdate, o_orderpriority, o_totalprice
            FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM') AND CAST(o_orderdate AS DATE) >=
                (SELECT CAST(max(CAST(o_orderdate AS DATE)) - INTERVAL 12 MONTH AS DATE) FROM orders)""",
        "visual_table": """SELECT l_quantity, l_extendedprice, l_discount, l_tax, l_orderkey, l_partkey, l_suppkey,
            l_linenumber, l_returnflag, l_linestatus FROM lineitem""",
        "chunk_summary": _chunks(),
        "natural_join_fold": """SELECT n_name, count(*) AS row_count,
                count(*) FILTER (o.custkey IS NULL) AS blank_keys,
                CAST(sum(CAST(o_totalprice AS DECIMAL(18,4))) AS DOUBLE) AS total, 'events' AS skipped_tables
            FROM (SELECT CASE WHEN o_custkey % 100 <> 0 THEN o_custkey END AS custkey, o_totalprice FROM orders) o
            JOIN (SELECT CASE WHEN c_custkey <> 0 THEN c_custkey END AS custkey, c_nationkey FROM customer) c
                ON o.custkey IS NOT DISTINCT FROM c.custkey
            JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""",
        "detect_key_columns": _union(
            f"""SELECT '{t}' AS "table", '{k}' AS "column", '{kind}' AS category, count(*) AS row_count,
                count(*) - count({k}) AS null_count, count(DISTINCT {k}) AS unique_count,
                (SELECT max(n) FROM (SELECT count(*) AS n FROM {t} GROUP BY {k})) AS largest_group,
                count(*) = count(DISTINCT {k}) AS is_unique FROM {t}"""
            for t, keys in KEY_COLUMNS.items() for k in keys for kind in ("primary_key", "foreign_key_candidate")),
        "classify_tables": _classified(),
        "suggest_measures_dims": _suggested(),
        "infer_relationships": _union(
            f"""SELECT '{a}' AS from_table, '{b}' AS from_column, '{c}' AS to_table, '{d}' AS to_column,
                count(*) FILTER ({b} IN (SELECT {d} FROM {c})) AS matched_rows,
                count(*) FILTER ({b} NOT IN (SELECT {d} FROM {c})) AS orphan_rows FROM {a} HAVING {_unique(c, d)}"""
            for a, b, c, d in EDGES),
        "relationship_cardinality": "SELECT *, " + """CASE WHEN from_largest > 1 AND to_largest > 1 THEN 'many_to_many'
                WHEN from_largest > 1 THEN 'many_to_one' WHEN to_largest > 1 THEN 'one_to_many' ELSE 'one_to_one' END
                AS cardinality, 'single' AS filter_direction FROM (""" + _union(
            f"""SELECT '{a}' AS from_table, '{b}' AS from_column, '{c}' AS to_table, '{d}' AS to_column,
                (SELECT max(n) FROM (SELECT count(*) AS n FROM {a} GROUP BY {b})) AS from_largest,
                (SELECT max(n) FROM (SELECT count(*) AS n FROM {c} GROUP BY {d})) AS to_largest WHERE {_unique(c, d)}"""
            for a, b, c, d in EDGES) + ")",
        "relationship_cycles": _cycles(),
        "model_score": _model_score(),
        "verify_primary_key": """SELECT 'o_orderkey' AS key, count(*) AS row_count, count(DISTINCT o_orderkey) AS unique_count,
                count(*) FILTER (o_orderkey IS NULL) AS null_count, count(*) = count(DISTINCT o_orderkey) AS is_primary_key
            FROM orders UNION ALL
            SELECT 'l_orderkey,l_linenumber', CAST(sum(n) AS BIGINT), count(*), CAST(0 AS BIGINT), sum(n) = count(*)
            FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)""",
        "fk_orphans": """SELECT doc_id AS key, count(*) AS row_count FROM documents
            WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY doc_id""",
        "upsert_customers": """WITH last AS (SELECT o_custkey, max_by(o_totalprice, o_orderkey) AS price FROM orders
                WHERE o_orderpriority = '1-URGENT' GROUP BY 1)
            SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer
                WHERE c_custkey NOT IN (SELECT o_custkey FROM last)
            UNION ALL SELECT o_custkey, 'changed', 0, price, '1-URGENT' FROM last
            UNION ALL SELECT s_suppkey + 1000000000, s_name, s_nationkey, s_acctbal, 'SUPPLIER' FROM supplier""",
        "catalog_columns": f"""SELECT v.*, row_count, value_count FROM (VALUES {types}) v("table", "column", type, position)
            JOIN ({fill}) f ON f."table" = v."table" AND f."column" = v."column" """,
        "catalog_row_counts": counts,
        "catalog_summary": f"""SELECT v.*, row_count, value_count
            FROM (VALUES {summary}) v("table", "column", position, table_rank, column_count)
            JOIN ({_fill(widest)}) f ON f."table" = v."table" AND f."column" = v."column" """,
        "schema_drift_diff": f"""SELECT type, c."table", "column", old_type, new_type, severity, b.row_count AS old_rows,
                a.row_count AS new_rows FROM (VALUES
                ('table_added', 'supplier', NULL, NULL, NULL, 'info'), ('table_removed', 'part', NULL, NULL, NULL, 'warning'),
                ('column_added', 'customer', 'c_country', NULL, NULL, 'info'),
                ('column_removed', 'orders', 'o_orderpriority', NULL, NULL, 'warning'),
                ('column_type_changed', 'orders', 'o_totalprice', 'double', 'decimal(18,2)', 'warning'))
                c(type, "table", "column", old_type, new_type, severity)
            LEFT JOIN ({counts}) b ON b."table" = c."table" AND c."table" <> 'supplier'
            LEFT JOIN ({counts}) a ON a."table" = c."table" AND c."table" <> 'part'""",
        "catalog_set_ops": f"""SELECT "table", "column", value_count, CASE WHEN "table" = 'part' OR "column" = 'o_orderpriority'
                THEN 'only_old' WHEN "table" = 'supplier' THEN 'only_new' ELSE 'both' END AS membership
            FROM ({_fill(("customer", "orders", "part", "supplier"))})
            UNION ALL SELECT 'customer', 'c_country', count(*), 'only_new' FROM customer""",
        "table_relevance": _relevance(),
        "model_complexity": f"""SELECT CAST({len(SCHEMA)} AS BIGINT) AS table_count,
            CAST({model_columns} AS BIGINT) AS column_count, CAST(6 AS BIGINT) AS measure_count,
            CAST({model_rows} AS BIGINT) AS row_count, CAST({cells} AS BIGINT) AS cell_count,
            CAST(least(100, floor({len(SCHEMA)} * 2 + {model_columns} * 0.1 + 6 * 1.5)) AS BIGINT) AS complexity_score,
            CAST(({cells}) // 1000 AS BIGINT) AS size_estimate_mb""",
        "profile_dataset": _memory(),
        "profile_nulls": f"""WITH {BLANKED} SELECT "column", row_count, null_count,
            {_pct('null_count', 'row_count')} AS null_percentage FROM ({_counts('blanked', _names('orders'))})""",
        "profile_distinct": f"""WITH {BLANKED} SELECT "column", unique_count, row_count - unique_count AS duplicate_count,
            {_pct('row_count - unique_count', 'row_count')} AS duplicate_percentage FROM (
            {_counts('blanked', _names('orders'))} UNION ALL {_counts('documents', _names('documents'))})""",
        "profile_numeric": f"WITH {BLANKED} " + _union(
            _numeric("blanked", c, f"{_quantile(c, 0.5)} AS median") for c in ("o_orderkey", "o_custkey", "o_totalprice")),
        "profile_moments": _union([
            _moments("events", "value"), _moments("documents", "n_chars"), _moments("lineitem", "l_quantity"),
            _moments("lineitem", "l_extendedprice"), _moments("lineitem", "l_discount")]),
        "profile_top_values": _union([
            _top("orders", "o_orderstatus"), _top("orders", "o_orderpriority"), _top("documents", "lang"),
            _top("documents", "source"), _top("documents", "text")]),
        "profile_text": _union(
            _text(t, c) for t in ("customer", "part", "documents") for c, k in SCHEMA[t] if k == "string"),
        "profile_datetime": _union([
            _datetime("orders", "o_orderdate"), _datetime("lineitem", "l_shipdate"), _datetime("events", "ts")]),
        "describe_numeric": _union(
            _numeric("lineitem", c, ", ".join(f"{_quantile(c, p)} AS p{int(p * 100)}" for p in (0.25, 0.5, 0.75)))
            for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")),
        "outliers_zscore": """SELECT event_id, 'value' AS "column", value, round(abs(value - m) / s, 6) AS score
            FROM events, (SELECT avg(value) AS m, stddev_pop(value) AS s FROM events) WHERE abs(value - m) / s > 3""",
        "outliers_iqr": f"""SELECT doc_id, 'n_chars' AS "column", CAST(n_chars AS DOUBLE) AS value,
                round(q1 - 1.5 * (q3 - q1), 4) AS lower_bound, round(q3 + 1.5 * (q3 - q1), 4) AS upper_bound
            FROM documents, ({_fences('documents', 'n_chars')}) q
            WHERE n_chars < q1 - 1.5 * (q3 - q1) OR n_chars > q3 + 1.5 * (q3 - q1)""",
        "quality_issues": f"WITH {BLANKED}, {_issues(_counts('blanked', _names('orders')))} SELECT * FROM found",
        "quality_score": f"WITH {BLANKED} " + _union(
            _score(t, _counts(source, _names(t)), strict)
            for t, source in (("orders", "blanked"), ("part", "part")) for strict in (False, True)),
        "rule_type_consistency": _union([
            _checked("type_consistency", "user_ref", "warning", "TRY_CAST(user_ref AS BIGINT) IS NULL",
                     f"(SELECT {USER_REF} AS user_ref FROM events)"),
            _checked("type_consistency", "event_id", "warning", "TRY_CAST(event_id AS BIGINT) IS NULL", "events")]),
        "rule_negative_values": _union([
            _checked("non_negative", "l_quantity", "warning", "l_quantity - 5 < 0", "lineitem"),
            _checked("non_negative", "order_id", "warning", "l_orderkey < 0", "lineitem", "l_orderkey"),
            _checked("non_negative", "l_discount", "warning", "l_discount < 0", "lineitem")]),
        "rule_column_pattern": _union([
            *[_checked("column_pattern", c, "warning", f"NOT regexp_matches({c}, '^(?:[A-Za-z0-9_]+$)')", "part")
              for c in ("p_name", "p_brand", "p_type")],
            _checked("column_pattern", "p_brand", "error", "NOT regexp_matches(p_brand, '^(?:Brand#[12])')", "part")]),
        "insight_missing": f"""WITH {BLANKED}, c AS ({_counts('blanked', _names('orders'))})
            SELECT max(row_count) AS row_count, CAST(sum(null_count) AS BIGINT) AS missing_count,
                round(CAST(sum(null_count) AS DOUBLE) * 100 / CAST(sum(row_count) AS DOUBLE), 6) AS missing_percentage,
                CASE WHEN sum(null_count) * 100 / sum(row_count) > 20 THEN 'warning' ELSE 'info' END AS severity FROM c""",
        "insight_correlation": _correlation(),
        "insight_outliers": _union([_outlier_share("events", "value"), _outlier_share("documents", "n_chars")]),
        "insight_cardinality": "SELECT * FROM (" + _union(
            f"""SELECT '{c}' AS "column", count(DISTINCT {c}) AS unique_count FROM {t}"""
            for t in ("customer", "part", "documents") for c, k in SCHEMA[t] if k == "string") + ") WHERE unique_count > 10",
        "insight_imbalance": "SELECT * FROM (" + _union(
            f"""(SELECT '{name}' AS "column", {e} AS value, count(*) AS top_rows,
                round(CAST(count(*) AS DOUBLE) * 100 / (SELECT count(*) FROM lineitem), 6) AS top_percentage
                FROM lineitem GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 1)""" for name, e in (
                ("size", "CASE WHEN l_quantity >= 48 THEN 'bulk' ELSE 'normal' END"),
                ("price", "CASE WHEN l_discount > 0 THEN 'reduced' ELSE 'full' END"),
                ("l_linestatus", "l_linestatus"))) + ") WHERE top_percentage > 80",
        "trend_slope": f"""SELECT count(*) AS periods, round(regr_slope(total, number), 3) AS slope,
                round(regr_r2(total, number), 6) AS r2, round(avg(total), 3) AS mean_total
            FROM (SELECT CAST(year(o_orderdate) * 12 + month(o_orderdate) AS DOUBLE) AS number,
                         CAST(sum({PRICE}) AS DOUBLE) AS total FROM orders GROUP BY 1)""",
        "measure_basic": f"""WITH {BLANKED} SELECT o_orderstatus, CAST(sum({PRICE}) AS DOUBLE) AS total_price,
                round(avg(o_totalprice), 4) AS average_price, count(o_totalprice) AS price_count,
                count(DISTINCT o_orderpriority) + CASE WHEN count(*) > count(o_orderpriority) THEN 1 ELSE 0 END AS priorities
            FROM blanked GROUP BY o_orderstatus""",
        "visual_minmax": """SELECT o_orderpriority, min(o_totalprice) AS smallest, max(o_totalprice) AS largest
            FROM orders GROUP BY 1""",
        "format_measures": """SELECT l_returnflag,
                '$' || format('{:,.2f}', CAST(sum(CAST(l_extendedprice AS DECIMAL(18,4))) AS DOUBLE)) AS total_price,
                format('{:,}', CAST(sum(l_quantity) AS BIGINT)) AS quantity,
                format('{:.2f}%', CAST(count(*) FILTER (l_discount > 0.05) AS DOUBLE) / count(*) * 100) AS discount_rate,
                strftime(max(l_shipdate), '%m/%d/%Y') AS last_ship FROM lineitem GROUP BY 1""",
        "measure_prior_year": _timed("CAST(t.value AS DOUBLE) AS value, CAST(p.value AS DOUBLE) AS prior_year") + PRIOR,
        "measure_yoy": _timed("""CASE WHEN p.value <> 0 THEN
            round(CAST(t.value - p.value AS DOUBLE) / CAST(p.value AS DOUBLE), 6) END AS yoy""") + PRIOR,
        "measure_ytd": _timed(f"{_to_date(0)} AS ytd") + " FROM totals t",
        "measure_pytd": _timed(f"{_to_date(0)} AS ytd, {_to_date(1)} AS pytd") + " FROM totals t",
        "date_dimension": """WITH days AS (SELECT CAST(unnest(generate_series(
                (SELECT min(CAST(o_orderdate AS DATE)) FROM orders), (SELECT max(CAST(o_orderdate AS DATE)) FROM orders),
                INTERVAL 1 DAY)) AS DATE) AS date)
            SELECT d.date, year(d.date) AS year, 'Q' || quarter(d.date) AS quarter, month(d.date) AS month,
                strftime(d.date, '%B') AS month_name, strftime(d.date, '%b') AS month_short, day(d.date) AS day,
                isodow(d.date) AS day_of_week, strftime(d.date, '%A') AS day_name, strftime(d.date, '%a') AS day_short,
                weekofyear(d.date) AS week_of_year, isodow(d.date) >= 6 AS is_weekend,
                strftime(d.date, '%Y-%m') AS year_month, year(d.date) || '-Q' || quarter(d.date) AS year_quarter,
                coalesce(n, 0) AS order_count
            FROM days d LEFT JOIN (SELECT CAST(o_orderdate AS DATE) AS date, count(*) AS n FROM orders GROUP BY 1) o
                ON o.date = d.date""",
        "retain_last_n": """SELECT event_type, event_id, user_id, value FROM (SELECT *, row_number() OVER (
                PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 100""",
        "redact_documents": _redacted(),
        "label_encode": f"""WITH {BLANKED} SELECT b.o_orderpriority, code, count(*) AS row_count FROM blanked b LEFT JOIN (
                SELECT o_orderpriority, row_number() OVER (ORDER BY o_orderpriority) - 1 AS code
                FROM (SELECT DISTINCT o_orderpriority FROM blanked WHERE o_orderpriority IS NOT NULL)) c
                ON b.o_orderpriority = c.o_orderpriority GROUP BY ALL""",
        "train_test_split": """SELECT o_orderkey, CASE WHEN CAST('0x' || substr(md5('42|' || o_orderkey), 1, 8) AS BIGINT) % 10 < 8
                THEN 'train' ELSE 'test' END AS part FROM orders""",
        "regression_metrics": """SELECT count(*) AS n, round(avg(power(y - p, 2)), 2) AS mse,
                round(sqrt(avg(power(y - p, 2))), 4) AS rmse, round(1 - avg(power(y - p, 2)) / var_pop(y), 6) AS r2
            FROM (SELECT l_extendedprice AS y, l_quantity * CAST(1500 AS DOUBLE) AS p FROM lineitem)""",
        "guarded_sql": """SELECT c_mktsegment, count(*) AS order_count,
                CAST(sum(CAST(o_totalprice AS DECIMAL(18,4))) AS DOUBLE) AS total
            FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderpriority = '1-URGENT' GROUP BY 1""",
        "stream_process_events": """SELECT event_id, event_type, CAST(ts AS DATE) AS day, round(value * 2, 2) AS doubled
            FROM events""",
        "stream_counts": """SELECT count(*) FILTER (event_type <> 'error') AS processed,
            count(*) FILTER (event_type = 'error') AS failed FROM events""",
        "stream_hourly_rate": """SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type,
            count(*) AS records FROM events GROUP BY ALL""",
        "measure_table": _union([
            """SELECT 'Total L Quantity' AS measure, round(sum(l_quantity), 2) AS value, 'Whole Number' AS format,
               'Basic Measures' AS category FROM lineitem""",
            """SELECT 'Total L Extendedprice', round(CAST(sum(CAST(l_extendedprice AS DECIMAL(18,4))) AS DOUBLE), 2),
               'Currency', 'Basic Measures' FROM lineitem""",
            "SELECT 'Average Tax Rate', round(avg(l_tax), 2), 'General Number', 'Basic Measures' FROM lineitem"]),
        "visual_bundle": _bundle(),
        "monthly_revenue_by_type": f"""SELECT strftime(o_orderdate, '%Y-%m') AS month, p_type,
                CAST(sum({REV}) AS DOUBLE) AS revenue
            FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2""",
        "star_join_revenue": f"""SELECT p_brand, CAST(sum({REV}) AS DOUBLE) AS revenue, count(*) AS line_count
            FROM lineitem LEFT JOIN part ON l_partkey = p_partkey GROUP BY 1""",
        "visual_line_month": f"""WITH {ORDER_REVENUE} SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS period,
            CAST(sum(revenue) AS DOUBLE) AS revenue, count(*) AS order_count FROM sold GROUP BY 1""",
        "visual_column": f"""WITH {PART_REVENUE} SELECT p_type, CAST(sum(revenue) AS DOUBLE) AS revenue,
            CAST(sum(units) AS DOUBLE) AS units FROM sold GROUP BY 1""",
        "visual_pie": f"""WITH {PART_REVENUE} SELECT p_type, CAST(sum(revenue) AS DOUBLE) AS revenue,
            round(CAST(sum(revenue) AS DOUBLE) / (SELECT CAST(sum(revenue) AS DOUBLE) FROM sold), 6) AS share
            FROM sold GROUP BY 1""",
        "visual_map": f"""WITH {ORDER_REVENUE} SELECT r_name, n_name, CAST(sum(revenue) AS DOUBLE) AS revenue,
            count(DISTINCT o_custkey) AS customer_count FROM sold {NATION_OF} GROUP BY 1, 2""",
        "quarterly_by_region": f"""WITH {ORDER_REVENUE} SELECT CAST(date_trunc('quarter', o_orderdate) AS DATE) AS quarter,
            r_name, CAST(sum(revenue) AS DOUBLE) AS revenue FROM sold {NATION_OF} GROUP BY 1, 2""",
        "visual_card": f"""WITH {ORDER_REVENUE} SELECT CAST(sum(revenue) AS DOUBLE) AS revenue,
            CAST(sum(units) AS DOUBLE) AS units, count(*) AS order_count, count(DISTINCT o_custkey) AS customer_count,
            round(CAST(sum(revenue) AS DOUBLE) / count(*), 4) AS average_order_value FROM sold""",
        "visual_matrix_rollup": f"""WITH {PART_REVENUE} SELECT p_type, p_brand,
            CAST(GROUPING(p_type, p_brand) AS BIGINT) AS level, CAST(sum(revenue) AS DOUBLE) AS revenue,
            CAST(sum(units) AS DOUBLE) AS units FROM sold GROUP BY ROLLUP (p_type, p_brand)""",
        "visual_pivot": f"""WITH {PART_REVENUE} SELECT p_type, """ + ", ".join(
            f"CAST(sum(revenue) FILTER (l_returnflag = '{f}') AS DOUBLE) AS revenue_{f.lower()}" for f in "ANR")
            + " FROM sold GROUP BY 1",
        "top5_parts": f"""WITH {PART_REVENUE} SELECT p_partkey, p_name, p_type, CAST(sum(revenue) AS DOUBLE) AS revenue
            FROM sold GROUP BY 1, 2, 3 ORDER BY sum(revenue) DESC, 1 LIMIT 5""",
        "top10_customers": f"""WITH {ORDER_REVENUE} SELECT c_custkey, c_name, c_mktsegment,
            CAST(sum(revenue) AS DOUBLE) AS revenue, count(*) AS order_count FROM sold JOIN customer ON o_custkey = c_custkey
            GROUP BY 1, 2, 3 ORDER BY sum(revenue) DESC, 1 LIMIT 10""",
        "product_lifecycle": f"""SELECT l_partkey AS p_partkey, CAST(min(l_shipdate) AS DATE) AS first_sale,
            CAST(max(l_shipdate) AS DATE) AS last_sale, count(DISTINCT date_trunc('month', l_shipdate)) AS active_months,
            CAST(sum({REV}) AS DOUBLE) AS revenue FROM lineitem GROUP BY 1""",
        "price_vs_net_scatter": """SELECT l_partkey AS p_partkey, round(avg(l_extendedprice / l_quantity), 4) AS average_price,
            round(avg(l_extendedprice / l_quantity * (1 - l_discount)), 4) AS average_net, count(*) AS line_count
            FROM lineitem GROUP BY 1""",
        "rfm_segments": f"""WITH {CUSTOMER_FACTS},
            aged AS (SELECT date_diff('day', last_day, (SELECT max(CAST(o_orderdate AS DATE)) FROM orders)) AS recency,
                            frequency, spend FROM facts),
            cuts AS (SELECT """ + ", ".join(
            f"quantile_cont(CAST({c} AS DOUBLE), {p}) AS {c[0]}{i}"
            for c in ("recency", "frequency", "spend") for i, p in ((1, 0.25), (2, 0.5), (3, 0.75))) + """ FROM aged),
            scored AS (SELECT 4 - (recency > r1)::BIGINT - (recency > r2)::BIGINT - (recency > r3)::BIGINT AS r,
                1 + (frequency > f1)::BIGINT + (frequency > f2)::BIGINT + (frequency > f3)::BIGINT AS f,
                1 + (spend > s1)::BIGINT + (spend > s2)::BIGINT + (spend > s3)::BIGINT AS m, spend FROM aged, cuts)
            SELECT r, f, m, CASE WHEN r >= 3 AND f >= 3 AND m >= 3 THEN 'best' WHEN f >= 3 THEN 'loyal'
                WHEN r >= 3 THEN 'recent' ELSE 'at risk' END AS segment, count(*) AS customer_count,
                CAST(sum(CAST(spend AS DECIMAL(18,4))) AS DOUBLE) AS spend FROM scored GROUP BY ALL""",
        "acquisition_retention": f"""WITH {CUSTOMER_MONTHS} SELECT month, count(*) FILTER (month = first_month) AS new_customers,
            count(*) FILTER (month <> first_month) AS returning_customers, CAST(sum(order_count) AS BIGINT) AS order_count
            FROM active GROUP BY 1""",
        "cohort_matrix": f"""WITH {CUSTOMER_MONTHS}, aged AS (SELECT strftime(first_month, '%Y-%m') AS cohort,
                date_diff('month', first_month, month) AS age FROM active)
            SELECT cohort, """ + ", ".join(f"count(*) FILTER (age = {i}) AS m{i}" for i in range(12))
            + ", count(*) FILTER (age >= 12) AS later FROM aged GROUP BY 1",
        "clv_distribution": f"""WITH {CUSTOMER_FACTS}, span AS (SELECT min(spend) AS lo, max(spend) AS hi FROM facts)
            SELECT CAST(least(floor((spend - lo) / (hi - lo) * 10) + 1, 10) AS BIGINT) AS bucket, count(*) AS customer_count,
                CAST(sum(CAST(spend AS DECIMAL(18,4))) AS DOUBLE) AS spend, min(spend) AS smallest, max(spend) AS largest
            FROM facts, span GROUP BY 1""",
        "sales_by_type_country": f"""SELECT p_type, n_name, CAST(sum({REV}) AS DOUBLE) AS revenue FROM lineitem
            JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey
            JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2""",
        "kpi_status": f"""WITH yearly AS (SELECT c_mktsegment AS measure, year(o_orderdate) AS year,
                CAST(sum({PRICE}) AS DOUBLE) AS actual FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
            v AS (SELECT a.measure, a.year, a.actual, b.actual * CAST(1.05 AS DOUBLE) AS target FROM yearly a
                  JOIN yearly b ON a.measure = b.measure AND a.year = b.year + 1)
            SELECT measure, year, actual, round(target, 4) AS target, round(actual - target, 4) AS variance,
                round((actual - target) / target, 6) AS variance_pct,
                CASE WHEN (actual - target) / target >= 0.05 THEN 'Above Target'
                     WHEN (actual - target) / target >= -0.05 THEN 'On Target' ELSE 'Below Target' END AS status FROM v""",
    }
