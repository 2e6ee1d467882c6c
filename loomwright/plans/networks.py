"""Registered queries over graphs made from events."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomwright.operators import graphs
from loomwright.plans.catalog import query, t

CLOSE = 60
LONGEST = 4


def _hand_overs(spark, sf):
    """An edge from a user to the next one who does the same within CLOSE seconds."""
    w = Window.partitionBy("event_type").orderBy("ts", "event_id")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = t(spark, sf, "events").select(F.col("user_id").alias("src"), F.lead("user_id").over(w).alias("dst"), (F.lead(at).over(w) - at).alias("gap"))
    return rows.where(F.col("gap") <= CLOSE * 1_000_000)


@query("strong_components", f"""WITH RECURSIVE e AS (SELECT DISTINCT src, dst FROM (SELECT user_id AS src, lead(user_id) OVER w AS dst, epoch_us(lead(ts) OVER w) - epoch_us(ts) AS gap FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)) WHERE gap <= {CLOSE * 1_000_000}),
    r(a, b) AS (SELECT src, dst FROM e UNION SELECT a, dst FROM r JOIN e ON b = src)
    SELECT x.a AS node, min(x.b) AS component FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY 1""")
def strong_components(spark, sf):
    """Users on cycles of quick hand-overs, by strongly connected component."""
    return graphs.strong_components(_hand_overs(spark, sf))


@query("state_cycles", f"""WITH RECURSIVE e AS (SELECT DISTINCT src, dst FROM (SELECT event_type AS src, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events) WHERE dst IS NOT NULL),
    p AS (SELECT [src] AS path, dst AS last FROM e WHERE dst >= src UNION ALL SELECT list_append(path, last), dst FROM p JOIN e ON last = src WHERE last <> path[1] AND NOT list_contains(path, last) AND dst >= path[1] AND len(path) < {LONGEST})
    SELECT array_to_string(path, '>') AS cycle, len(path)::INT AS length FROM p WHERE last = path[1]""")
def state_cycles(spark, sf):
    """Cycles of at most LONGEST states in the changes of users' states."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    edges = t(spark, sf, "events").select(F.col("event_type").alias("src"), F.lead("event_type").over(w).alias("dst"))
    return graphs.cycles(edges, LONGEST).select(F.array_join("cycle", ">").alias("cycle"), F.col("length").cast("int").alias("length"))
