"""Registered queries: drift, windows, rollouts, costs, sequences, typed redaction, metric lines, exports by standard."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomwright.functions import text as tx
from loomwright.operators import reports
from loomwright.plans import registry
from loomwright.plans.catalog import SQL_LATE, late, query, t

# ---- drift, windows, rollouts, costs

_SD = ", ".join(f"round({f}(value) FILTER ({c}), 6) AS {k}_{n}" for n, c in (("reference", f"NOT ({SQL_LATE})"), ("current", SQL_LATE)) for f, k in (("avg", "mean"), ("stddev_pop", "sd")))


@query("drift_report", f"""WITH k AS ({registry.oracle_sql()["ks_stat"]}), p AS ({registry.oracle_sql()["psi"]}),
    f AS (SELECT event_type, count(value) FILTER (NOT ({SQL_LATE})) AS n_reference, count(value) FILTER ({SQL_LATE}) AS n_current, {_SD} FROM events WHERE value IS NOT NULL GROUP BY 1)
    SELECT f.*, ks, psi, coalesce(n_current >= 30 AND n_reference > 0 AND ks > 1.3581 * sqrt((n_reference + n_current) / (n_reference * n_current)), false) AS ks_drift, coalesce(n_current >= 30 AND n_reference > 0 AND psi > 0.25, false) AS psi_drift FROM f LEFT JOIN k USING (event_type) LEFT JOIN p USING (event_type)""")
def drift_report(spark, sf):
    return reports.drift(t(spark, sf, "events"), "event_type", "value", late())


@query("score_window", """SELECT user_id, count(*) AS n, round(avg(value), 6) AS mean, min(value) AS least, max(value) AS most, round(count(*) FILTER (value >= 50) / count(*), 6) AS pass_rate
    FROM (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS place FROM events WHERE value IS NOT NULL) WHERE place <= 10 GROUP BY 1""")
def score_window(spark, sf):
    return reports.last_window(t(spark, sf, "events"), "user_id", ["ts", "event_id"], "value", 10, 50.0)


@query("trend_points", """WITH r AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, greatest(1, count(*) OVER (PARTITION BY user_id) // 8) AS step FROM events)
    SELECT user_id, event_id, value, (i // step)::INT AS point FROM r WHERE i % step = 0 AND i // step < 8""")
def trend_points(spark, sf):
    return reports.thinned(t(spark, sf, "events").select("user_id", "event_id", "ts", "value"), "user_id", ["ts", "event_id"], 8).drop("ts")


@query("canary_rollback", """WITH m AS (SELECT l_suppkey, count(*) AS n, avg(l_discount * 10) AS quality, count(*) FILTER (l_returnflag = 'R') / count(*) AS failures, avg(l_quantity) AS latency FROM lineitem GROUP BY 1)
    SELECT l_suppkey, n, round(quality, 6) AS quality, round(failures, 6) AS failures, round(latency, 6) AS latency, CASE WHEN n < 5 THEN NULL WHEN quality < 0.48 THEN 'quality' WHEN failures > 0.35 THEN 'errors' WHEN latency > 26 THEN 'latency' END AS reason FROM m""")
def canary_rollback(spark, sf):
    rows = t(spark, sf, "lineitem").withColumn("q", F.col("l_discount") * 10)
    return reports.rollback(rows, "l_suppkey", "q", F.col("l_returnflag") == "R", "l_quantity", 5, 0.48, 0.35, 26.0)


@query("prompt_rollup", "SELECT lang, source, count(*) AS n, round(avg(n_chars), 6) AS mean, arg_min(doc_id, (-n_chars, doc_id)) AS best, arg_min(doc_id, (n_chars, doc_id)) AS worst FROM documents WHERE n_chars IS NOT NULL GROUP BY ALL")
def prompt_rollup(spark, sf):
    return reports.best_and_worst(t(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars"), ["lang", "source"], "n_chars", "doc_id")


@query("cost_savings", """WITH m AS (SELECT l_returnflag, avg(l_extendedprice) AS a, avg(l_extendedprice * (1 - l_discount)) AS b FROM lineitem GROUP BY 1)
    SELECT l_returnflag, round(a, 4) AS old, round(b, 4) AS new, round(a - b, 4) AS saved, round(100 * (a - b) / nullif(a, 0), 4) AS percent, round((a - b) * 1000, 1) AS per_thousand FROM m""")
def cost_savings(spark, sf):
    price = F.col("l_extendedprice")
    return reports.savings(t(spark, sf, "lineitem"), "l_returnflag", price, price * (1 - F.col("l_discount")))


@query("action_consistency", "SELECT l_suppkey, l_returnflag || '_' || l_linestatus AS action, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 3")
def action_consistency(spark, sf):
    """Actions that occur more than three times."""
    rows = t(spark, sf, "lineitem").groupBy("l_suppkey", F.concat("l_returnflag", F.lit("_"), "l_linestatus").alias("action"))
    return rows.agg(F.count("*").alias("n")).where("n > 3")


@query("confidence_distribution", "SELECT l_returnflag, least(4, floor(coalesce(l_discount * 10, 0) * 5))::INT AS bucket, count(*) AS n FROM lineitem GROUP BY ALL")
def confidence_distribution(spark, sf):
    """Five equal buckets; a missing confidence is 0, and one of 1 or more is in the last."""
    bucket = F.least(F.lit(4), F.floor(F.coalesce(F.col("l_discount") * 10, F.lit(0.0)) * 5)).cast("int")
    return t(spark, sf, "lineitem").groupBy("l_returnflag", bucket.alias("bucket")).agg(F.count("*").alias("n"))


@query("lowest_dimensions", """WITH d AS (UNPIVOT (SELECT l_orderkey, avg(l_discount * 10) AS discount, avg(l_tax * 12) AS tax, avg(l_quantity / 50) AS quantity FROM lineitem GROUP BY 1) ON discount, tax, quantity INTO NAME dimension VALUE score)
    SELECT l_orderkey, dimension, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY round(score, 9), dimension) AS place FROM d) WHERE place = 1""")
def lowest_dimensions(spark, sf):
    dims = {"discount": F.col("l_discount") * 10, "tax": F.col("l_tax") * 12, "quantity": F.col("l_quantity") / 50}
    wide = t(spark, sf, "lineitem").groupBy("l_orderkey").agg(*(F.avg(c).alias(n) for n, c in dims.items()))
    low = F.array_min(F.array(*(F.struct(F.round(n, 9).alias("score"), F.lit(n).alias("dimension")) for n in dims)))
    return wide.select("l_orderkey", low.alias("x")).select("l_orderkey", "x.dimension", F.round("x.score", 6).alias("score"))


# ---- sequences and spans


@query("state_sequence", "SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::INT AS place, event_type AS state FROM events UNION ALL SELECT DISTINCT user_id, 0, 'initial' FROM events")
def state_sequence(spark, sf):
    return reports.state_sequence(t(spark, sf, "events"), "user_id", ["ts", "event_id"], "event_type")


@query("transitions_between", "SELECT user_id, event_id, ts, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-08' AND ts <= TIMESTAMP '2024-01-12' AND user_id % 10 = 3")
def transitions_between(spark, sf):
    low, high = (F.lit(x).cast("timestamp_ntz") for x in ("2024-01-08", "2024-01-12"))
    return t(spark, sf, "events").where((F.col("ts") >= low) & (F.col("ts") <= high) & (F.col("user_id") % 10 == 3)).select("user_id", "event_id", "ts", "event_type")


@query("graph_spans", "SELECT user_id, count(*) AS events, round(max(epoch_us(ts) / 1e6 + coalesce(value, 0)) - min(epoch_us(ts) / 1e6), 4) AS span, round(sum(coalesce(value, 0)), 4) AS busy FROM events GROUP BY 1")
def graph_spans(spark, sf):
    start, lasts = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6, F.coalesce("value", F.lit(0.0))
    return t(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("events"), F.round(F.max(start + lasts) - F.min(start), 4).alias("span"), F.round(F.sum(lasts), 4).alias("busy"))


# ---- typed redaction, metric lines


def _sql_typed() -> str:
    text = "text"
    for kind, pattern in tx.PII.items():
        text = f"regexp_replace({text}, '{pattern}', '[{kind.upper()}_REDACTED]', 'g')"
    return text


@query("pii_typed", f"SELECT doc_id, md5({_sql_typed()}) AS digest FROM documents")
def pii_typed(spark, sf):
    return t(spark, sf, "documents").select("doc_id", F.md5(tx.redact_typed(F.col("text"))).alias("digest"))


BOUNDS = [1.0, 5.0, 10.0, 25.0, 50.0, 75.0]


@query("metric_lines", " UNION ALL ".join(
    [f"""SELECT event_type, {i} AS place, 'seconds_bucket{{event_type="' || event_type || '",le="{b}"}} ' || count(*) FILTER (value <= {b}) AS line FROM events WHERE value IS NOT NULL GROUP BY 1""" for i, b in enumerate(BOUNDS)]
    + [f"""SELECT event_type, {len(BOUNDS)}, 'seconds_bucket{{event_type="' || event_type || '",le="+Inf"}} ' || count(*) FROM events WHERE value IS NOT NULL GROUP BY 1""", f"""SELECT event_type, {len(BOUNDS) + 1}, 'seconds_count{{event_type="' || event_type || '"}} ' || count(*) FROM events WHERE value IS NOT NULL GROUP BY 1"""]))
def metric_lines(spark, sf):
    return reports.exposition(t(spark, sf, "events"), "seconds", "event_type", "value", BOUNDS)


# ---- exports by standard


def _segments(spark, sf):
    action = F.struct(F.col("l_returnflag").alias("verb"), F.col("l_linestatus").alias("noun"), F.lit("unknown").alias("hand"))
    segment = F.struct("l_linenumber", (F.col("l_linenumber") * 2).alias("start_time"), (F.col("l_linenumber") * 2 + 2).alias("end_time"), F.array(action).alias("actions"), "l_partkey")
    return t(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(segment)).alias("s"))


def _epic(spark, sf):
    kept = F.transform("s", lambda x: F.struct(x["start_time"].alias("start_time"), x["end_time"].alias("end_time"), x["actions"].alias("actions")))
    record = F.struct(F.col("l_orderkey").cast("string").alias("id"), kept.alias("segments"))
    return _segments(spark, sf).select("l_orderkey", F.to_json(record).alias("record"))


@query("epic_export", """SELECT l_orderkey, to_json({'id': l_orderkey::VARCHAR, 'segments': list({'start_time': l_linenumber * 2, 'end_time': l_linenumber * 2 + 2, 'actions': [{'verb': l_returnflag, 'noun': l_linestatus, 'hand': 'unknown'}]} ORDER BY l_linenumber, l_returnflag, l_linestatus)})::VARCHAR AS record FROM lineitem GROUP BY 1""")
def epic_export(spark, sf):
    return _epic(spark, sf)


@query("epic_import", "SELECT l_orderkey::VARCHAR AS id, (l_linenumber * 2)::INT AS start_time, (l_linenumber * 2 + 2)::INT AS end_time, l_returnflag AS verb, l_linestatus AS noun FROM lineitem")
def epic_import(spark, sf):
    """Records read back: one row for each action of a segment."""
    shape = "id string, segments array<struct<start_time: int, end_time: int, actions: array<struct<verb: string, noun: string, hand: string>>>>"
    rows = _epic(spark, sf).select(F.from_json("record", shape).alias("r")).select("r.id", F.explode("r.segments").alias("s"))
    return rows.select("id", "s.start_time", "s.end_time", F.explode("s.actions").alias("a")).select("id", "start_time", "end_time", "a.verb", "a.noun")


@query("openx_export", """WITH c AS (SELECT conv_id, list({'turn': turn, 'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn, coalesce(role, ''), coalesce(text, '')) AS t FROM conversations GROUP BY 1)
    SELECT conv_id, to_json({'episode_id': conv_id::VARCHAR, 'steps': list_transform(t, lambda x, i: {'observation': {'state': x.role}, 'language_instruction': x.text, 'is_terminal': i = len(t), 'timestamp': {'start': x.turn, 'end': x.turn + 1}, 'discount': 1, 'reward': 0})})::VARCHAR AS record FROM c""")
def openx_export(spark, sf):
    turns = F.array_sort(F.collect_list(F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))))
    times = lambda x: F.struct(x["turn"].alias("start"), (x["turn"] + 1).alias("end"))
    step = lambda x, i: F.struct(F.struct(x["role"].alias("state")).alias("observation"), x["text"].alias("language_instruction"), (i == F.size("t") - 1).alias("is_terminal"), times(x).alias("timestamp"), F.lit(1).alias("discount"), F.lit(0).alias("reward"))
    rows = t(spark, sf, "conversations").groupBy("conv_id").agg(turns.alias("t"))
    return rows.select("conv_id", F.to_json(F.struct(F.col("conv_id").cast("string").alias("episode_id"), F.transform("t", step).alias("steps"))).alias("record"))
