"""The expected results of the stream queries in plain SQL."""

from __future__ import annotations

# A session is over when the watermark, an hour behind the newest event, has passed its end.
SESSIONS = """
WITH e AS (SELECT user_id, ts, value, lag(ts) OVER w AS before FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(CASE WHEN ts - before <= INTERVAL 6 HOUR THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts
    ROWS UNBOUNDED PRECEDING) AS n FROM e),
t AS (SELECT user_id, min(ts) AS a, max(ts) + INTERVAL 6 HOUR AS b, count(*) AS events, round(sum(value), 2) AS total
    FROM s GROUP BY user_id, n)
SELECT user_id, strftime(a, '%Y-%m-%d %H:%M:%S.%f') AS session_start, strftime(b, '%Y-%m-%d %H:%M:%S.%f') AS session_end, events, total
FROM t WHERE b <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)"""

TYPES = {"event_id": 1, "ts": 0, "user_id": 1, "event_type": 0, "value": 1, "props": 0}


def statements() -> dict[str, str]:
    profile = " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(*) AS row_count, count(*) - count({c}) AS null_count, true AS distinct_within,
            {'true' if number else 'CAST(NULL AS BOOLEAN)'} AS median_within, CAST(4 AS BIGINT) AS batches FROM events"""
        for c, number in TYPES.items())
    heavy = " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", CAST(sum(n) AS BIGINT) AS rows, max(n) AS most FROM (
            SELECT count(*) AS n FROM events GROUP BY {c} ORDER BY n DESC LIMIT 5)""" for c in ("event_type", "props"))
    return {"stream_distinct_events": "SELECT event_type, count(*) AS events, count(*) AS ids FROM events GROUP BY 1",
            "stream_sessions": SESSIONS, "stream_keyed_sessions": SESSIONS,
            "stream_sketch_profile": profile, "stream_heavy_values": heavy}
