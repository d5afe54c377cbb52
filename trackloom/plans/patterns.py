"""Row patterns over ordered events."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackloom.operators import patterns
from trackloom.plans.registry import Query, query, single

_EVENTS = "event_type", "user_id", "event_id", "value"


def _by_user(t):
    return t.events.select(*_EVENTS)


QUERIES: dict[str, Query] = {
    "npath_repeated_high_values": query(
        lambda t: patterns.npath(
            _by_user(t), ["user_id"], ["event_id"], "HIGH.HIGH+", {"HIGH": F.col("value") > 10},
        ).select("user_id", "event_id", "path_start", "path_size"),
        "WITH n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS path_start, "
        "count(*) OVER (PARTITION BY user_id) AS total FROM events), "
        "u AS (SELECT *, coalesce(min(CASE WHEN NOT value > 10 THEN path_start END) OVER (PARTITION BY user_id "
        "ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), total + 1) AS stop FROM n) "
        "SELECT user_id, event_id, path_start, stop - path_start AS path_size FROM u WHERE stop - path_start >= 2"),
    "npath_view_clicks_purchase": query(
        lambda t: patterns.npath(
            _by_user(t), ["user_id"], ["event_id"], "VIEW.CLICK*.BUY",
            {"VIEW": F.col("event_type") == "view", "CLICK": F.col("event_type") == "click",
             "BUY": F.col("event_type") == "purchase"},
        ).select("user_id", "event_id", "path_size"),
        "WITH s AS (SELECT user_id, string_agg(event_type[1], '' ORDER BY event_id) AS letters, "
        "list(event_id ORDER BY event_id) AS ids FROM events GROUP BY user_id), "
        "p AS (SELECT user_id, letters, unnest(ids) AS event_id, generate_subscripts(ids, 1) AS i FROM s), "
        "m AS (SELECT user_id, event_id, length(regexp_extract(substr(letters, i), '^vc*p')) AS path_size FROM p) "
        "SELECT user_id, event_id, path_size FROM m WHERE path_size > 0"),
    # Five event types: each holds a fifth of all rows.
    "npath_large_partitions": query(
        lambda t: patterns.npath(
            _by_user(t), ["event_type"], ["event_id"], "HIGH+.LOW", {
                "HIGH": F.col("value") > 10, "LOW": F.col("value") <= 10},
        ).select("event_type", "event_id", "path_size"),
        "WITH n AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS i FROM events), "
        "u AS (SELECT *, min(CASE WHEN NOT value > 10 THEN i END) OVER (PARTITION BY event_type "
        "ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS stop FROM n) "
        "SELECT event_type, event_id, stop - i + 1 AS path_size FROM u WHERE stop > i"),
    "npath_path_columns": query(
        lambda t: patterns.npath(
            _by_user(t), ["user_id"], ["event_id"], "VIEW.CLICK*.BUY",
            {"VIEW": F.col("event_type") == "view", "CLICK": F.col("event_type") == "click",
             "BUY": F.col("event_type") == "purchase"},
            {"first_value": ("first", F.col("value") * 2), "last_event": ("last", F.col("event_id")),
             "path": ("list", F.concat_ws(":", "event_type", "event_id"))},
        ).select("user_id", "event_id", "path_size", "first_value", "last_event", "path"),
        "WITH s AS (SELECT user_id, string_agg(event_type[1], '' ORDER BY event_id) AS letters, "
        "list(events ORDER BY event_id) AS rows FROM events GROUP BY user_id), "
        "p AS (SELECT user_id, letters, rows, unnest(range(1, len(rows) + 1)) AS i FROM s), "
        "m AS (SELECT *, length(regexp_extract(substr(letters, i), '^vc*p')) AS path_size FROM p) "
        "SELECT user_id, rows[i].event_id AS event_id, path_size, rows[i].value * 2 AS first_value, "
        "rows[i + path_size - 1].event_id AS last_event, list_transform(rows[i:i + path_size - 1], "
        "lambda r: r.event_type || ':' || r.event_id) AS path FROM m WHERE path_size > 0"),
    # Every row of a long run begins a match: five types, low values only now and then.
    "npath_path_aggregates": query(
        lambda t: patterns.npath(
            _by_user(t), ["event_type"], ["event_id"], "SMALL+.LARGE", {
                "SMALL": F.col("value") <= 90, "LARGE": F.col("value") > 90},
            {"total": ("sum", F.col("value")), "mean": ("avg", F.col("value")), "least": ("min", F.col("value")),
             "most": ("max", F.when(F.col("value") <= 90, F.col("value"))),
             "even": ("count", F.when(F.col("event_id") % 2 == 0, 1))},
        ).select("event_type", "event_id", "path_size", single("total").alias("total"),
                 single("mean").alias("mean"), "least", "most", "even"),
        "WITH n AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS i FROM events), "
        "u AS (SELECT *, min(CASE WHEN NOT value <= 90 THEN i END) OVER (PARTITION BY event_type "
        "ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS stop FROM n) "
        "SELECT u.event_type, u.event_id, u.stop - u.i + 1 AS path_size, "
        "CAST(CAST(sum(n.value) AS FLOAT) AS DOUBLE) AS total, CAST(CAST(avg(n.value) AS FLOAT) AS DOUBLE) AS mean, "
        "min(n.value) AS least, max(n.value) FILTER (n.value <= 90) AS most, count(*) FILTER (n.event_id % 2 = 0) AS even "
        "FROM u JOIN n ON n.event_type = u.event_type AND n.i BETWEEN u.i AND u.stop WHERE u.stop > u.i GROUP BY ALL"),
    "noop_partitioned": query(
        lambda t: patterns.noop(t.part.select("p_brand", "p_partkey"), ["p_brand"], ["p_partkey"]),
        "SELECT p_brand, p_partkey FROM part"),
}
