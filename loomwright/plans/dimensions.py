"""Registered queries: quality dimensions, time features, geometry, complexity, price tables, related nodes, shifted copies."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomwright.functions import geometry
from loomwright.operators import dimensions
from loomwright.plans.catalog import query, t


@query("factuality", r"""WITH r AS (SELECT conv_id, lower(coalesce(text, '')) AS x, nullif(lower(role), '') AS v, nullif(regexp_extract(lower(coalesce(text, '')), '^[a-z]+', 0), '') AS o FROM conversations),
    s AS (SELECT conv_id, list(DISTINCT v) FILTER (v IS NOT NULL) AS vs, list(DISTINCT o) FILTER (o IS NOT NULL) AS os FROM r GROUP BY 1),
    f AS (SELECT conv_id, avg((len(list_filter(coalesce(vs, []), lambda y: contains(x, y))) > 0)::INT) AS verbs, avg((len(list_filter(coalesce(os, []), lambda y: contains(x, y))) > 0)::INT) AS things, bool_or(vs IS NOT NULL) AS hv, bool_or(os IS NOT NULL) AS ho, bool_or(trim(x) <> '') AS hc FROM r JOIN s USING (conv_id) GROUP BY 1),
    i AS (SELECT *, (NOT hv)::INT + (NOT ho)::INT + (NOT hc)::INT + (hv AND verbs < 0.5)::INT + (ho AND things < 0.5)::INT AS issues FROM f)
    SELECT conv_id, round(verbs, 6) AS verbs, round(things, 6) AS things, issues, round(greatest(0, 0.5 + CASE WHEN hv AND ho THEN 0.2 ELSE 0 END + CASE WHEN verbs > 0.7 THEN 0.15 ELSE 0 END + CASE WHEN things > 0.7 THEN 0.15 ELSE 0 END - issues * 0.1), 6)::DOUBLE AS score FROM i""")
def factuality(spark, sf):
    """A turn's verb is its role, its thing the word it begins with."""
    rows = t(spark, sf, "conversations").withColumn("thing", F.regexp_extract(F.lower(F.coalesce("text", F.lit(""))), "^[a-z]+", 0))
    return dimensions.factuality(rows, "conv_id", "text", "role", "thing")


@query("object_grounding", """WITH g AS (SELECT l_orderkey, count(*) FILTER (l_returnflag <> 'N') AS objects, count(*) FILTER (l_returnflag <> 'N' AND l_linestatus = 'O') AS b, count(*) FILTER (l_returnflag <> 'N' AND l_quantity > 10) AS s, count(*) FILTER (l_returnflag <> 'N' AND l_quantity > 10 AND l_discount * 10 > 0.7) AS h FROM lineitem GROUP BY 1)
    SELECT l_orderkey, objects, round(coalesce(b / nullif(objects, 0), 0), 6) AS boxed, round(coalesce(s / nullif(objects, 0), 0), 6) AS sure, round(coalesce(h / nullif(objects, 0), 0), 6) AS high,
    round(CASE WHEN objects = 0 THEN 0.3 ELSE least(1, 0.4 + b / objects * 0.3 + s / objects * 0.15 + h / objects * 0.15) END, 6)::DOUBLE AS score FROM g""")
def object_grounding(spark, sf):
    made = {"thing": F.when(F.col("l_returnflag") != "N", F.col("l_partkey")), "box": F.when(F.col("l_linestatus") == "O", F.array("l_quantity")), "sure": F.when(F.col("l_quantity") > 10, F.col("l_discount") * 10)}
    return dimensions.object_grounding(t(spark, sf, "lineitem").withColumns(made), "l_orderkey", "thing", "box", "sure")


@query("action_grounding", """WITH a AS (SELECT l_orderkey, l_returnflag, CASE WHEN l_linestatus = 'O' THEN l_quantity - 20 END AS d FROM lineitem), g AS (SELECT l_orderkey, count(*) FILTER (l_returnflag <> 'N') AS actions, count(d) FILTER (l_returnflag <> 'N') AS n, avg(d) FILTER (l_returnflag <> 'N' AND d > 0) AS mean FROM a GROUP BY 1)
    SELECT l_orderkey, actions, round(coalesce(n / nullif(actions, 0), 0), 6) AS timed, round(mean, 6) AS mean, CASE WHEN mean < 0.5 THEN 'too short' WHEN mean > 30 THEN 'too long' END AS pace,
    round(CASE WHEN actions = 0 THEN 0.3 ELSE least(1, 0.5 + n / actions * 0.3 + CASE WHEN mean IS NOT NULL THEN 0.2 ELSE 0 END) END, 6)::DOUBLE AS score FROM g""")
def action_grounding(spark, sf):
    made = {"action": F.when(F.col("l_returnflag") != "N", "act"), "start": F.lit(20.0), "end": F.when(F.col("l_linestatus") == "O", F.col("l_quantity"))}
    return dimensions.action_grounding(t(spark, sf, "lineitem").withColumns(made), "l_orderkey", "action", "start", "end")


@query("time_features", """WITH s AS (SELECT user_id, ts, event_id, epoch_us(ts) / 1e6 AS a, epoch_us(ts) / 1e6 + value * 60 AS b FROM events WHERE value IS NOT NULL), g AS (SELECT *, b - a AS d, greatest(0, a - lag(b) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS first_gap, lag(b) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM s)
    SELECT user_id, count(*) AS segments, round(avg(d), 4) AS mean, round(stddev_pop(d), 4) AS sd, round(coalesce(avg(first_gap) FILTER (before IS NOT NULL), 0), 4) AS mean_gap, round(coalesce(max(first_gap) FILTER (before IS NOT NULL), 0), 4) AS largest_gap FROM g GROUP BY 1""")
def time_features(spark, sf):
    start = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    rows = t(spark, sf, "events").where("value is not null").select("user_id", "ts", "event_id", start.alias("a"), (start + F.col("value") * 60).alias("b"))
    return dimensions.time_features(rows, "user_id", ["ts", "event_id"], "a", "b")


@query("geometry_measures", """SELECT l_orderkey, l_linenumber, round(greatest(0, l_quantity - 10) * greatest(0, l_discount - l_tax), 6) AS area, round(greatest(0, l_quantity - 10) * greatest(0, l_discount - l_tax) * l_linenumber, 6) AS volume, round(sqrt(l_discount ** 2 + l_tax ** 2), 6) AS magnitude,
    round(CASE WHEN sqrt(l_discount ** 2 + l_tax ** 2) <= 1e-6 THEN 0 ELSE l_discount / sqrt(l_discount ** 2 + l_tax ** 2) END, 6)::DOUBLE AS x, round(CASE WHEN sqrt(l_discount ** 2 + l_tax ** 2) <= 1e-6 THEN 1 ELSE l_tax / sqrt(l_discount ** 2 + l_tax ** 2) END, 6)::DOUBLE AS y, l_quantity BETWEEN 5 AND 40 AS within FROM lineitem""")
def geometry_measures(spark, sf):
    """Boxes, forces and their direction from each line's numbers, and whether a force is in its range."""
    force = [F.col("l_discount"), F.col("l_tax")]
    low, high = [F.lit(10.0), F.col("l_tax"), F.lit(0.0)], [F.col("l_quantity"), F.col("l_discount"), F.col("l_linenumber").cast("double")]
    rows = t(spark, sf, "lineitem").withColumn("d", geometry.direction(force))
    return rows.select("l_orderkey", "l_linenumber", F.round(geometry.extent(low[:2], high[:2]), 6).alias("area"), F.round(geometry.extent(low, high), 6).alias("volume"), F.round(geometry.magnitude(force), 6).alias("magnitude"), F.round(F.col("d")[0], 6).alias("x"), F.round(F.col("d")[1], 6).alias("y"), F.col("l_quantity").between(5, 40).alias("within"))


@query("complexity_scores", "SELECT l_orderkey, round((least(1, sum(l_quantity) / 100) + least(1, count(*) / 5) + least(1, max(l_tax) / 0.08) + least(1, count(DISTINCT l_suppkey) / 4)) / 4, 6)::DOUBLE AS complexity FROM lineitem GROUP BY 1")
def complexity_scores(spark, sf):
    rows = t(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("size"), F.count("*").alias("n"), F.max("l_tax").alias("motion"), F.count_distinct("l_suppkey").alias("kinds"))
    return rows.select("l_orderkey", F.round(geometry.complexity([(F.col("size"), 100), (F.col("n"), 5), (F.col("motion"), 0.08), (F.col("kinds"), 4)]), 6).alias("complexity"))


@query("price_comparison", """WITH p AS (SELECT s_suppkey, abs(s_acctbal) / 1000 AS rate FROM supplier WHERE s_suppkey % 9 <> 0) SELECT l_orderkey, l_linenumber, l_suppkey, round(coalesce(l_quantity / 10 * rate + l_linenumber, -1), 6) AS cost FROM lineitem LEFT JOIN p ON s_suppkey = l_suppkey""")
def price_comparison(spark, sf):
    """Each line's cost by its supplier's rate, -1 where no rate is known."""
    rates = t(spark, sf, "supplier").where("s_suppkey % 9 <> 0").select(F.col("s_suppkey").alias("l_suppkey"), (F.abs("s_acctbal") / 1000).alias("rate"))
    cost = F.col("l_quantity") / 10 * F.col("rate") + F.col("l_linenumber")
    return t(spark, sf, "lineitem").join(rates, "l_suppkey", "left").select("l_orderkey", "l_linenumber", "l_suppkey", F.round(F.coalesce(cost, F.lit(-1.0)), 6).alias("cost"))


@query("related_nodes", """SELECT DISTINCT 'part' || l_partkey AS node, 'supplied_by' AS relation, 'supplier' || l_suppkey AS other FROM lineitem WHERE l_partkey % 50 = 0 UNION ALL SELECT DISTINCT 'supplier' || l_suppkey, 'inverse_supplied_by', 'part' || l_partkey FROM lineitem WHERE l_suppkey % 50 = 0""")
def related_nodes(spark, sf):
    """Edges out of the asked nodes (ids divisible by 50), and those into them under an inverse name."""
    edges = t(spark, sf, "lineitem").select("l_partkey", "l_suppkey").distinct()
    part, supplier = F.concat(F.lit("part"), F.col("l_partkey").cast("string")), F.concat(F.lit("supplier"), F.col("l_suppkey").cast("string"))
    out = edges.where("l_partkey % 50 = 0").select(part.alias("node"), F.lit("supplied_by").alias("relation"), supplier.alias("other"))
    return out.unionByName(edges.where("l_suppkey % 50 = 0").select(supplier.alias("node"), F.lit("inverse_supplied_by").alias("relation"), part.alias("other")))


@query("shifted_segments", "SELECT event_id || '_shifted' AS id, round(value * 0.95, 6) AS start, round(least((value + 5) * 1.05, 100), 6)::DOUBLE AS stop FROM events WHERE value IS NOT NULL")
def shifted_segments(spark, sf):
    """Copies of segments that start a little earlier and end a little later, within the whole's length."""
    value = F.col("value")
    return t(spark, sf, "events").where("value is not null").select(F.concat(F.col("event_id").cast("string"), F.lit("_shifted")).alias("id"), F.round(value * 0.95, 6).alias("start"), F.round(F.least((value + 5) * 1.05, F.lit(100.0)), 6).alias("stop"))
