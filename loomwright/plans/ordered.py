"""Registered queries that follow a state through events in their order."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from loomwright.operators import folds
from loomwright.plans.catalog import query, t
from loomwright.sources.scratch import shared_dir
from loomwright.streaming import alerts

ORDER = ["ts", "event_id"]


def _tracks() -> dict[str, folds.Track]:
    return {"mean_value": folds.average(F.col("value")), "error_share": folds.average((F.col("event_type") == "error").cast("double"), 0.03, 0.2)}


def _sql_average(values: str, alpha: float, start: float) -> str:
    return f"list_reduce({values}, lambda a, v: CASE WHEN v IS NULL THEN a ELSE {1 - alpha}::DOUBLE * a + {alpha}::DOUBLE * v END, {start}::DOUBLE)"


_SQL_ERROR = "CASE WHEN event_type = 'error' THEN 1 ELSE 0 END::DOUBLE"


@query("ema_by_type", f"""SELECT event_type, count(*) AS n, round({_sql_average("list(value ORDER BY ts, event_id)", 0.1, 0)}, 6) AS mean_value, round({_sql_average(f"list({_SQL_ERROR} ORDER BY ts, event_id)", 0.03, 0.2)}, 6) AS error_share FROM events GROUP BY 1""")
def ema_by_type(spark, sf):
    """Exponential averages after the last event of each type; each type holds a fifth of all rows."""
    found = folds.final(t(spark, sf, "events"), ["event_type"], ORDER, _tracks())
    return found.select("event_type", "n", *(F.round(c, 6).alias(c) for c in _tracks()))


@query("ema_running", f"""SELECT event_id, round({_sql_average("list(value) OVER w", 0.1, 0)}, 6) AS mean_value, round({_sql_average(f"list({_SQL_ERROR}) OVER w", 0.03, 0.2)}, 6) AS error_share
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""")
def ema_running(spark, sf):
    """Exponential averages after each event of a user."""
    rows = folds.running(t(spark, sf, "events"), ["user_id"], ORDER, _tracks())
    return rows.select("event_id", *(F.round(c, 6).alias(c) for c in _tracks()))


@query("adaptive_fallback", """WITH r AS (SELECT *, row_number() OVER o AS n, avg((value > 60)::INT) OVER w AS fallback, avg((event_type <> 'error')::INT) OVER w AS success FROM events
        WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id), w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS 49 PRECEDING)),
    s AS (SELECT user_id, ts, event_id, n, CASE WHEN n < 20 THEN 0 WHEN fallback > 0.3 THEN 1 WHEN fallback < 0.24 THEN -1 ELSE 0 END AS a, n >= 20 AND success < 0.8 AS poor FROM r)
    SELECT event_id, n, round(list_reduce(list({'a': a, 'p': poor}) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING),
        lambda x, m: least(CASE WHEN m.p THEN 1 ELSE 2 END, greatest(0, least(1, x + 0.05 * m.a)) + CASE WHEN m.p THEN 0.05 ELSE 0 END)::DOUBLE, 0.5::DOUBLE), 6) AS threshold FROM s""")
def adaptive_fallback(spark, sf):
    """A user's confidence threshold after each event, moved by the last 50."""
    rows = folds.adaptive_threshold(t(spark, sf, "events"), ["user_id"], ORDER, F.col("value") > 60, F.col("event_type") != "error", 0.5, 0.3, 0.8, 0.05)
    return rows.select("event_id", "n", F.round("threshold", 6).alias("threshold"))


RULES = [
    alerts.Rule("high_error", ">", 60, "critical", 0, 6 * 3600, {"event_type": "error"}),
    alerts.Rule("long_click", ">", 20, "warning", 1800, 0, {"event_type": "click"}),
    alerts.Rule("low_view", "<=", 50, "info", 3600, 7200, {"event_type": "view"}),
]
_SQL_RULES = ", ".join(f"('{r.name}', '{r.severity}', '{r.labels['event_type']}', '{r.op}', {r.threshold}, {r.lasts}, {r.limit})" for r in RULES)


@query("lasting_alerts", f"""WITH RECURSIVE rules(rule, severity, label, op, threshold, lasts, most) AS (VALUES {_SQL_RULES}),
    n AS MATERIALIZED (SELECT rule, severity, ts, epoch_us(ts) AS us, event_id AS seq, value, CASE op WHEN '>' THEN value > threshold ELSE value <= threshold END AS hit, (lasts * 1000000::BIGINT)::BIGINT AS lasts, (most * 1000000::BIGINT)::BIGINT AS most,
        row_number() OVER (PARTITION BY rule ORDER BY ts, event_id) AS i FROM events JOIN rules ON event_type = label WHERE value IS NOT NULL),
    f(rule, severity, i, since, last, active, kind, ts, seq, value) AS (
        SELECT rule, severity, 0::BIGINT, NULL::BIGINT, NULL::BIGINT, false, NULL::VARCHAR, NULL::TIMESTAMP, NULL::BIGINT, NULL::DOUBLE FROM rules
        UNION ALL SELECT rule, severity, i, CASE WHEN hit THEN began END, CASE WHEN alert THEN us ELSE last END, alert OR (active AND hit), CASE WHEN alert THEN 'alert' WHEN active AND NOT hit THEN 'recovered' END, ts, seq, value
        FROM (SELECT n.*, last, active, coalesce(since, us) AS began, hit AND us - coalesce(since, us) >= lasts AND (last IS NULL OR us - last >= most) AS alert FROM f JOIN n ON n.rule = f.rule AND n.i = f.i + 1))
    SELECT rule, severity, kind, ts AS at, seq, value FROM f WHERE kind IS NOT NULL""")
def lasting_alerts(spark, sf):
    """Alerts and recoveries of the rules over all events, read as a stream."""
    events = t(spark, sf, "events").select("event_id", "ts", "event_type", "value").withColumn("ts", F.col("ts").cast("timestamp"))
    at = f"{shared_dir(spark)}/alerts-{uuid.uuid4().hex}"
    # as a pattern, since a stream's plain path has to be a folder
    read = spark.readStream.schema(t(spark, sf, "events").schema).parquet(f"{sf}/events.parque[t]")
    ends = spark.readStream.schema(events.schema).parquet(f"{at}/[c]losing")
    stream = read.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "value").union(ends)
    end = alerts.closing(events, "ts", "value")
    for _ in range(2):
        # the first end moves the watermark; the second run starts from the checkpoint and takes out what waited
        end.write.mode("append").parquet(f"{at}/closing")
        alerts.watch_to(stream, RULES, f"{at}/found", f"{at}/state", "31 days")
    found = spark.read.schema("rule string, severity string, kind string, at timestamp, seq long, value double").parquet(f"{at}/found")
    return found.withColumn("at", F.col("at").cast("timestamp_ntz"))
