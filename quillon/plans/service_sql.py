"""The expected results of the service queries in plain SQL."""

from __future__ import annotations

import re
from itertools import combinations

from quillon.plans.oracle import BLANKED, SCHEMA, _counts, _issues, _names, _score, _union
from quillon.plans.service_queries import BATCH

DECIMAL = "CAST(o_totalprice AS DECIMAL(18,4))"


def _gate() -> str:
    """Advice per table: the overall score below 80, then one line per finding; the gate is above 75."""
    parts, scores = [], []
    for name, source in (("orders", "blanked"), ("part", "part")):
        counts = _counts(source, _names(name))
        scores.append(f'SELECT "table", score FROM ({_score(name, counts, False)})')
        parts.append(f"""SELECT '{name}' AS "table", CASE type WHEN 'high_null_percentage' THEN 'fill or explain the missing values'
            ELSE 'check whether repeated values are expected' END AS advice FROM (WITH {_issues(counts)} SELECT type FROM found)""")
    return f"""WITH {BLANKED}, s AS ({_union(scores)} UNION ALL SELECT 'none', 0.0),
        a AS ({_union(parts)} UNION ALL SELECT 'none', 'check the connection and the query'
              UNION ALL SELECT "table", 'clean the data: the overall score is low' FROM s WHERE score < 80)
        SELECT a."table", advice, count(*) AS findings, any_value(score) > 75 AS passed FROM a JOIN s ON a."table" = s."table"
        GROUP BY ALL"""


def _batch() -> str:
    known = {"counts": ("o_orderstatus,n", "(SELECT count(DISTINCT o_orderstatus) FROM orders)"),
             "parts": ("p_partkey", "(SELECT count(*) FROM part WHERE p_size > 10)")}
    return _union(f"SELECT '{i}' AS id, '{'success' if i in known else 'error'}' AS status, "
                  f"'{known.get(i, ('',))[0]}' AS columns, {known[i][1] if i in known else 'CAST(NULL AS BIGINT)'} AS row_count"
                  for i, _, _ in BATCH)


MEASURE_WORDS = ("amount", "total", "sum", "count", "quantity", "price", "value")
ACCIDENTS = ("discount", "account", "country", "county", "consume", "summary", "assume")
NUMBERS = ("int", "bigint", "double")


def _suggestions() -> str:
    """The visuals by the rules on names and types, per table, with its rows."""
    rows = []
    for table, columns in SCHEMA.items():
        def plain(name: str) -> str:
            return re.sub("|".join(ACCIDENTS), "", name)
        measures = [c for c, k in columns if k in NUMBERS and any(w in plain(c) for w in MEASURE_WORDS)]
        texts = [c for c, k in columns if k == "string"]
        time = [c for c, k in columns if k.startswith("timestamp")]
        place = [c for c in texts if any(w in c for w in ("country", "region", "city", "state", "location"))]
        kind = [c for c in texts if c not in place and any(w in c for w in ("category", "type", "class", "group"))]
        if not (measures or texts or time):
            continue  # a table without fields has no visual
        shown = [("table", 4, measures[:10], None)]
        if measures:
            shown.append(("card", 1, measures[:4], None))
            shown += [("line", 1, measures[:3], time[0])] if time else []
            shown += [("map", 2, measures[:1], place[0])] if place else []
            shown += [("column", 1, measures[:2], kind[0]), ("pie", 3, measures[:1], kind[0])] if kind else []
        for visual, priority, fields, dimension in shown:
            rows.append(f"""SELECT '{table}' AS "table", '{visual}' AS visual, CAST({priority} AS BIGINT) AS priority,
                '{','.join(fields)}' AS measures, {f"'{dimension}'" if dimension else 'CAST(NULL AS VARCHAR)'} AS dimension,
                count(*) AS row_count FROM {table}""")
    return _union(rows)


def _grains() -> str:
    """All sets of up to three columns whose values never repeat, without those that hold a smaller one."""
    sets = []
    for table, columns in SCHEMA.items():
        plain = sorted(c for c, k in columns if k in ("int", "bigint", "string") or k.startswith("timestamp"))
        for size in (1, 2, 3):
            for s in combinations(plain, size):
                cells = ", ".join(f'c{i} := "{c}"' for i, c in enumerate(s))
                sets.append(f"""SELECT '{table}' AS "table", '{",".join(s)}' AS columns, CAST({size} AS BIGINT) AS size, count(*) AS row_count,
                    count(DISTINCT struct_pack({cells})) = count(*) AS ok FROM "{table}" """)
    return f"""WITH k AS (SELECT * FROM ({_union(sets)}) WHERE ok)
        SELECT "table", columns, size, row_count FROM k WHERE NOT EXISTS (SELECT 1 FROM k s WHERE s."table" = k."table" AND s.size < k.size
            AND len(list_intersect(string_split(s.columns, ','), string_split(k.columns, ','))) = s.size)"""


def _report() -> str:
    """Column counts of orders and customers on the customer's key."""
    names = ["custkey", *[c for c in _names("orders") if c != "o_custkey"], *[c for c in _names("customer") if c != "c_custkey"]]
    return f"""WITH j AS (SELECT o_custkey AS custkey, o.* EXCLUDE (o_custkey), c.* EXCLUDE (c_custkey)
        FROM orders o JOIN customer c ON o_custkey = c_custkey)
        SELECT *, CAST({len(names)} AS BIGINT) AS column_count, true AS whole FROM ({_counts("j", names)})"""


def statements() -> dict[str, str]:
    return {
        "predict_rows": """SELECT o_orderstatus, count(*) AS row_count, count(*) AS predicted,
            count(DISTINCT o_orderkey) AS orders, true AS beats_mean FROM orders GROUP BY 1""",
        "classify_rows": """WITH m AS (SELECT (min(o_totalprice) + max(o_totalprice)) / 2 AS middle FROM orders)
            SELECT CASE WHEN o_totalprice < middle THEN 'lower' ELSE 'upper' END AS half, count(*) AS row_count, true AS mostly_right
            FROM orders, m GROUP BY 1""",
        "saved_model_rows": """SELECT count(*) AS row_count, CAST(0 AS BIGINT) AS different, CAST(5 AS BIGINT) AS features
            FROM orders""",
        "stream_profile": _counts("events", _names("events")),
        "stream_publish": "SELECT event_id, user_id, event_type FROM events",
        "encrypted_customers": "SELECT c_custkey, c_name, true AS hidden FROM customer",
        "chunk_function": """SELECT l_returnflag, count(*) AS row_count, sum(l_quantity) * 2 AS quantity FROM lineitem
            GROUP BY 1""",
        "period_anomalies": f"""WITH m AS (SELECT strftime(o_orderdate, '%Y-%m') AS period,
                CAST(sum({DECIMAL}) AS DOUBLE) AS value FROM orders GROUP BY 1),
            s AS (SELECT avg(value) AS mean, stddev_pop(value) AS deviation FROM m)
            SELECT period, 'total' AS "column", round(value, 4) AS value, round(abs(value - mean) / deviation, 4) AS score
            FROM m, s WHERE abs(value - mean) / deviation > 1.5""",
        "query_batch": _batch(),
        "quality_gate": _gate(),
        "visual_suggestions": _suggestions(),
        "json_documents": "SELECT page_id, url FROM pages",
        "versioned_upsert": """WITH c AS (SELECT c_custkey, c_name, c_mktsegment FROM customer),
            n AS (SELECT -c_custkey AS c_custkey, c_name, c_mktsegment FROM c WHERE c_custkey % 50 = 1)
            SELECT c_custkey, c_name, CASE WHEN c_custkey % 10 = 0 THEN lower(c_mktsegment) ELSE c_mktsegment END AS c_mktsegment,
              CAST(CASE WHEN c_custkey % 10 = 0 THEN 2 ELSE 1 END AS BIGINT) AS version FROM c WHERE c_custkey % 100 <> 3
            UNION ALL SELECT c_custkey, c_name, c_mktsegment, 2 FROM n""",
        "table_grains": _grains(),
        "chunk_errors": """SELECT l_returnflag, count(*) AS row_count, CAST(sum(l_orderkey) AS BIGINT) AS keys, true AS counted
            FROM lineitem GROUP BY 1""",
        "report_columns": _report(),
    }
