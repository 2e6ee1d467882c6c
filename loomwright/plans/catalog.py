"""The registered queries: each operator bound to tables, with DuckDB SQL that states the same result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomwright.functions import text as tx
from loomwright.operators import changes, measures, select, series, vectors
from loomwright.plans.registry import register


def t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def put(plan):
        register(name, plan, sql)
        return plan

    return put


MIDDLE = "2024-01-15"


def late() -> Column:
    return F.col("ts") >= F.lit(MIDDLE).cast("timestamp_ntz")


SQL_LATE = f"ts >= TIMESTAMP '{MIDDLE}'"


# ---- filters, pages, ranking, policies


@query("filter_page", "SELECT doc_id, source, n_chars FROM documents WHERE lang = 'en' AND n_chars >= 200 AND n_chars <= 5000 ORDER BY n_chars DESC, doc_id LIMIT 50 OFFSET 20")
def filter_page(spark, sf):
    rows = select.Filter(equal={"lang": "en"}, at_least={"n_chars": 200}, at_most={"n_chars": 5000})
    return select.page(t(spark, sf, "documents").select("doc_id", "source", "n_chars", "lang"), rows, [F.desc("n_chars"), F.col("doc_id")], 20, 50).drop("lang")


@query("source_stats", "SELECT coalesce(source, 'unknown') AS source, lang, count(*) AS n, round(avg(n_chars), 6) AS mean_chars, max(n_chars) AS max_chars FROM documents GROUP BY 1, 2")
def source_stats(spark, sf):
    return t(spark, sf, "documents").groupBy(F.coalesce("source", F.lit("unknown")).alias("source"), "lang").agg(F.count("*").alias("n"), F.round(F.avg("n_chars"), 6).alias("mean_chars"), F.max("n_chars").alias("max_chars"))


@query("quality_agg", "SELECT lang, count(*) AS n, round(avg(quality), 6) AS mean_quality, sum(toxic)::BIGINT AS toxic FROM documents JOIN labels USING (doc_id) GROUP BY lang")
def quality_agg(spark, sf):
    return t(spark, sf, "documents").select("doc_id", "lang").join(t(spark, sf, "labels"), "doc_id").groupBy("lang").agg(F.count("*").alias("n"), F.round(F.avg("quality"), 6).alias("mean_quality"), F.sum("toxic").alias("toxic"))


@query("score_buckets", """SELECT l_returnflag, CASE WHEN s >= .9 THEN 'excellent' WHEN s >= .8 THEN 'good' WHEN s >= .7 THEN 'fair' WHEN s >= .6 THEN 'poor' ELSE 'bad' END AS bucket, count(*) AS n
    FROM (SELECT l_returnflag, l_discount * 10 AS s FROM lineitem) GROUP BY ALL""")
def score_buckets(spark, sf):
    bucket = select.levels(F.col("l_discount") * 10, [(0.9, "excellent"), (0.8, "good"), (0.7, "fair"), (0.6, "poor")], "bad")
    return t(spark, sf, "lineitem").groupBy("l_returnflag", bucket.alias("bucket")).agg(F.count("*").alias("n"))


@query("leaderboard", """SELECT s_nationkey, s_suppkey, revenue, row_number() OVER (PARTITION BY s_nationkey ORDER BY revenue DESC, s_suppkey) AS rank FROM (
    SELECT s_nationkey, s_suppkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY ALL)""")
def leaderboard(spark, sf):
    rows = t(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))
    return select.leaderboard(t(spark, sf, "supplier").select("s_nationkey", "s_suppkey").join(rows, "s_suppkey"), ["s_nationkey"], [F.desc("revenue"), F.col("s_suppkey")])


@query("minmax_scores", "SELECT c_custkey, round(CASE WHEN hi > lo THEN (c_acctbal - lo) / (hi - lo) ELSE 1 END, 6) AS score FROM customer JOIN (SELECT c_mktsegment, min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer GROUP BY 1) USING (c_mktsegment)")
def minmax_scores(spark, sf):
    rows = t(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    ends = rows.groupBy("c_mktsegment").agg(F.min("c_acctbal").alias("lo"), F.max("c_acctbal").alias("hi"))
    return rows.join(ends, "c_mktsegment").select("c_custkey", F.round(F.when(F.col("hi") > F.col("lo"), (F.col("c_acctbal") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(1.0), 6).alias("score"))


@query("policy_eval", "SELECT doc_id, coalesce(quality >= 1, false) AS good, coalesce(toxic = 0, false) AS safe, quality IS NULL AS unlabelled FROM documents LEFT JOIN labels USING (doc_id)")
def policy_eval(spark, sf):
    rows = t(spark, sf, "documents").select("doc_id").join(t(spark, sf, "labels"), "doc_id", "left")
    return rows.select("doc_id", select.policy("ge", "quality", 1).alias("good"), select.policy("eq", "toxic", 0).alias("safe"), select.policy("missing", "quality", None).alias("unlabelled"))


@query("acceptance_levels", """SELECT CASE WHEN n_chars >= 5000 THEN 'gold' WHEN n_chars >= 1000 THEN 'silver' WHEN n_chars >= 200 THEN 'bronze' ELSE 'reject' END AS level, count(*) AS n FROM documents GROUP BY 1""")
def acceptance_levels(spark, sf):
    level = select.levels(F.col("n_chars"), [(5000, "gold"), (1000, "silver"), (200, "bronze")], "reject")
    return t(spark, sf, "documents").groupBy(level.alias("level")).agg(F.count("*").alias("n"))


@query("dpo_pairs", """SELECT a.l_orderkey, a.l_linenumber AS winner, b.l_linenumber AS loser FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey
    AND (a.l_extendedprice > b.l_extendedprice OR (a.l_extendedprice = b.l_extendedprice AND a.l_linenumber < b.l_linenumber))""")
def dpo_pairs(spark, sf):
    return select.ordered_pairs(t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice"), "l_orderkey", "l_linenumber", "l_extendedprice")


@query("retention_expired", "SELECT event_type, count(*) AS expired FROM events WHERE ts < TIMESTAMP '2024-01-31' - INTERVAL 7 DAY AND event_type <> 'error' GROUP BY 1")
def retention_expired(spark, sf):
    old = F.col("ts") < F.expr("TIMESTAMP_NTZ '2024-01-31' - INTERVAL 7 DAY")
    return t(spark, sf, "events").where(old & (F.col("event_type") != "error")).groupBy("event_type").agg(F.count("*").alias("expired"))


# ---- order and time


@query("latency_percentiles", """WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
    SELECT event_type, max(n) AS n, max(CASE WHEN i = floor(n * 0.5) THEN value END) AS p50, max(CASE WHEN i = least(floor(n * 0.95), n - 1) THEN value END) AS p95, max(CASE WHEN i = least(floor(n * 0.99), n - 1) THEN value END) AS p99 FROM r GROUP BY 1""")
def latency_percentiles(spark, sf):
    return series.nearest_rank(t(spark, sf, "events"), ["event_type"], "value", {"p50": 0.5, "p95": 0.95, "p99": 0.99})


@query("prom_histogram", "SELECT event_type, le, (SELECT count(*) FROM events e WHERE e.event_type = k.event_type AND e.value <= le) AS n FROM (SELECT DISTINCT event_type FROM events) k, (VALUES (1.0::DOUBLE), (5.0), (10.0), (50.0), (100.0)) AS b(le)")
def prom_histogram(spark, sf):
    bounds = (1.0, 5.0, 10.0, 50.0, 100.0)
    wide = t(spark, sf, "events").groupBy("event_type").agg(*(F.count_if(F.col("value") <= b).alias(f"n{i}") for i, b in enumerate(bounds)))
    cells = F.inline(F.array(*(F.struct(F.lit(b).alias("le"), F.col(f"n{i}").alias("n")) for i, b in enumerate(bounds))))
    return wide.select("event_type", cells)


@query("metric_trend", """WITH r AS (SELECT event_type, value, floor((epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY event_type)) / 3600000000.0)::BIGINT AS bucket FROM events),
    s AS (SELECT *, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY event_type, bucket) AS n FROM r WINDOW w AS (PARTITION BY event_type, bucket ORDER BY value))
    SELECT event_type, bucket, count(*) AS n, round(avg(value), 6) AS mean, min(value) AS low, max(value) AS high, max(CASE WHEN i = floor(n / 2.0) THEN value END) AS p50 FROM s GROUP BY ALL""")
def metric_trend(spark, sf):
    return series.trend(t(spark, sf, "events").select("event_type", "ts", "value"), "event_type", "ts", "value", 3600)


@query("running_rate", "SELECT event_id, round(avg((event_type = 'purchase')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 6) AS rate FROM events")
def running_rate(spark, sf):
    return series.running_rate(t(spark, sf, "events").select("event_id", "user_id", "ts", "event_type"), "user_id", ["ts", "event_id"], F.col("event_type") == "purchase").select("event_id", "rate")


@query("trend_slope", """WITH r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS b FROM events),
    s AS (SELECT user_id, count(*) AS n, round(regr_slope(value, -b), 6) AS slope FROM r WHERE b <= 20 GROUP BY 1)
    SELECT *, CASE WHEN slope > 0.001 THEN 'improving' WHEN slope < -0.001 THEN 'declining' ELSE 'stable' END AS direction FROM s""")
def trend_slope(spark, sf):
    return series.last_slope(t(spark, sf, "events").select("user_id", "ts", "event_id", "value"), "user_id", ["ts", "event_id"], "value", 20)


@query("half_trend", """WITH r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events),
    s AS (SELECT user_id, max(n) AS n, round(avg(CASE WHEN i <= n // 2 THEN value END), 6) AS first_mean, round(avg(CASE WHEN i > n // 2 THEN value END), 6) AS second_mean FROM r GROUP BY 1)
    SELECT *, CASE WHEN n < 3 THEN 'stable' WHEN second_mean - first_mean > 0.05 THEN 'improving' WHEN second_mean - first_mean < -0.05 THEN 'declining' ELSE 'stable' END AS direction FROM s""")
def half_trend(spark, sf):
    return series.half_trend(t(spark, sf, "events").select("user_id", "ts", "event_id", "value"), "user_id", ["ts", "event_id"], "value")


def _intervals(spark, sf) -> DataFrame:
    start = series.seconds("ts")
    return t(spark, sf, "events").select("event_id", "user_id", start.alias("start"), (start + F.floor("value") * 600).alias("stop"))


_SQL_INTERVALS = "iv AS (SELECT event_id, user_id, epoch_us(ts) / 1e6 AS start, epoch_us(ts) / 1e6 + floor(value) * 600 AS stop FROM events)"


@query("parallel_groups", f"""WITH {_SQL_INTERVALS}, m AS (SELECT *, max(stop) OVER (PARTITION BY user_id ORDER BY start, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS upto FROM iv)
    SELECT event_id, sum((upto IS NULL OR start >= upto)::INT) OVER (PARTITION BY user_id ORDER BY start, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS island FROM m""")
def parallel_groups(spark, sf):
    return series.islands(_intervals(spark, sf), "user_id", "start", "stop", "event_id").select("event_id", "island")


@query("correlated_sessions", f"""WITH {_SQL_INTERVALS}, g AS (SELECT *, coalesce((start - lag(start) OVER w > 86400)::INT, 1) AS new FROM iv WINDOW w AS (PARTITION BY user_id ORDER BY start, event_id)),
    s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY start, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS session FROM g)
    SELECT user_id, session, count(*) AS n, min(event_id) AS first_key FROM s GROUP BY ALL HAVING count(*) > 1""")
def correlated_sessions(spark, sf):
    return series.sessions(_intervals(spark, sf), "user_id", "start", "event_id", 86400)


@query("asof_state", """SELECT p.event_id, coalesce((SELECT max_by(v.event_type, (v.ts, v.event_type)) FROM events v WHERE v.user_id = p.user_id AND v.event_type IN ('view', 'click') AND v.ts <= p.ts), 'unknown') AS state FROM events p WHERE p.event_type = 'purchase'""")
def asof_state(spark, sf):
    rows = t(spark, sf, "events").select("event_id", "user_id", "ts", "event_type")
    marks = rows.where(F.col("event_type").isin("view", "click")).withColumnRenamed("event_type", "said")
    return series.as_of(rows.where("event_type = 'purchase'").drop("event_type"), marks, "user_id", "ts", "said", "unknown").select("event_id", "state")


@query("interval_relations", f"""WITH {_SQL_INTERVALS}, d AS (SELECT *, floor(start / 86400) AS day FROM iv)
    SELECT * FROM (SELECT a.event_id AS a, b.event_id AS b, CASE WHEN a.start = b.start AND a.stop = b.stop THEN 'EQUALS' WHEN a.stop = b.start THEN 'MEETS' WHEN a.start < b.start AND b.start < a.stop THEN 'OVERLAPS' WHEN a.stop < b.start THEN 'BEFORE' END AS relation
    FROM d a JOIN d b ON a.user_id = b.user_id AND a.day = b.day AND a.event_id < b.event_id) WHERE relation IS NOT NULL""")
def interval_relations(spark, sf):
    rows = _intervals(spark, sf).withColumn("day", F.floor(F.col("start") / 86400))
    return series.relations(rows, ["user_id", "day"], "event_id", "start", "stop")


@query("interval_relations_all", f"""WITH {_SQL_INTERVALS}
    SELECT * FROM (SELECT a.event_id AS a, b.event_id AS b, CASE WHEN a.start = b.start AND a.stop = b.stop THEN 'EQUALS' WHEN a.stop = b.start THEN 'MEETS' WHEN a.start < b.start AND b.start < a.stop THEN 'OVERLAPS' WHEN a.stop < b.start THEN 'BEFORE' END AS relation
    FROM iv a JOIN iv b ON a.user_id = b.user_id AND a.event_id < b.event_id) WHERE relation IS NOT NULL""")
def interval_relations_all(spark, sf):
    return series.relations(_intervals(spark, sf), ["user_id"], "event_id", "start", "stop")


@query("transition_matrix", """WITH p AS (SELECT event_type AS after, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)
    , c AS (SELECT before, after, count(*) AS n FROM p WHERE before IS NOT NULL GROUP BY ALL) SELECT before, after, n, round(n / sum(n) OVER (PARTITION BY before), 6) AS p FROM c""")
def transition_matrix(spark, sf):
    return series.transitions(t(spark, sf, "events").select("user_id", "ts", "event_id", "event_type"), "user_id", ["ts", "event_id"], "event_type")


@query("pareto", """SELECT p_brand, p_partkey, p_retailprice, p_size FROM (SELECT *, max(p_size) OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_size DESC, p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM part) WHERE best IS NULL OR p_size > best""")
def pareto(spark, sf):
    return series.pareto(t(spark, sf, "part").select("p_brand", "p_partkey", "p_retailprice", "p_size"), "p_brand", "p_retailprice", "p_size", "p_partkey")


# ---- statistics


@query("zscore_outliers", """SELECT doc_id, lang, n_chars, round((n_chars - m) / s, 6) AS z FROM documents JOIN (SELECT lang, avg(n_chars) AS m, stddev_pop(n_chars) AS s FROM documents GROUP BY 1) USING (lang) WHERE s > 0 AND abs((n_chars - m) / s) > 2.5""")
def zscore_outliers(spark, sf):
    return measures.outliers(t(spark, sf, "documents").select("doc_id", "lang", "n_chars"), "lang", "n_chars")


def _sql_bins(joint: bool) -> str:
    inside = "true" if joint else f"NOT ({SQL_LATE})"
    return f"""WITH s AS (SELECT event_type, min(value) FILTER ({inside}) AS lo, max(value) FILTER ({inside}) AS hi, count(*) FILTER (NOT ({SQL_LATE})) AS n0, count(*) FILTER ({SQL_LATE}) AS n1 FROM events WHERE value IS NOT NULL GROUP BY 1),
    c AS (SELECT event_type, least(floor((value - lo) / (hi - lo) * 10), 9)::BIGINT AS bin, count(*) FILTER (NOT ({SQL_LATE})) / max(n0) AS p, count(*) FILTER ({SQL_LATE}) / max(n1) AS q FROM events JOIN s USING (event_type) WHERE value BETWEEN lo AND hi GROUP BY ALL),
    f AS (SELECT event_type, bin, coalesce(p, 0) AS p, coalesce(q, 0) AS q FROM (SELECT event_type, unnest(range(10)) AS bin FROM s) LEFT JOIN c USING (event_type, bin))"""


@query("psi", _sql_bins(False) + " SELECT event_type, round(sum((greatest(q, 1e-10) - greatest(p, 1e-10)) * ln(greatest(q, 1e-10) / greatest(p, 1e-10))), 6) AS psi FROM f GROUP BY 1")
def psi(spark, sf):
    return measures.psi(measures.binned(t(spark, sf, "events"), "event_type", "value", late(), joint=False), "event_type")


@query("hellinger", _sql_bins(True) + " SELECT event_type, round(sqrt(sum((sqrt(p) - sqrt(q)) ** 2) / 2), 6) AS hellinger FROM f GROUP BY 1")
def hellinger(spark, sf):
    return measures.hellinger(measures.binned(t(spark, sf, "events"), "event_type", "value", late(), joint=True), "event_type")


@query("ks_stat", f"""WITH c AS (SELECT event_type, value, count(*) FILTER (NOT ({SQL_LATE})) AS a, count(*) FILTER ({SQL_LATE}) AS b FROM events WHERE value IS NOT NULL GROUP BY ALL),
    g AS (SELECT event_type, abs(sum(a) OVER w / sum(a) OVER p - sum(b) OVER w / sum(b) OVER p) AS gap FROM c WINDOW w AS (PARTITION BY event_type ORDER BY value), p AS (PARTITION BY event_type))
    SELECT event_type, round(max(gap), 6) AS ks FROM g GROUP BY 1""")
def ks_stat(spark, sf):
    return measures.ks(t(spark, sf, "events"), "event_type", "value", late())


@query("cohen_kappa", """WITH r AS (SELECT lang, quality AS a, toxic AS b FROM documents JOIN labels USING (doc_id)), n AS (SELECT lang, count(*) AS t, avg((a = b)::INT) AS po FROM r GROUP BY 1),
    x AS (SELECT lang, a AS k, count(*) AS x FROM r GROUP BY ALL), y AS (SELECT lang, b AS k, count(*) AS y FROM r GROUP BY ALL), e AS (SELECT lang, sum(x * y) AS xy FROM x JOIN y USING (lang, k) GROUP BY 1)
    SELECT lang, round(CASE WHEN coalesce(xy, 0) / t / t >= 1 THEN 0 ELSE greatest(-1, least(1, (po - coalesce(xy, 0) / t / t) / (1 - coalesce(xy, 0) / t / t))) END, 6)::DOUBLE AS kappa FROM n LEFT JOIN e USING (lang)""")
def cohen_kappa(spark, sf):
    rows = t(spark, sf, "documents").select("doc_id", "lang").join(t(spark, sf, "labels"), "doc_id")
    return measures.cohen_kappa(rows, "lang", "quality", "toxic")


@query("spearman_ordinal", """WITH r AS (SELECT p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) AS a, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) AS b FROM part) SELECT p_brand, round(corr(a, b), 6) AS rho FROM r GROUP BY 1""")
def spearman_ordinal(spark, sf):
    return measures.spearman(t(spark, sf, "part"), "p_brand", "p_size", "p_retailprice", "p_partkey")


@query("ece", """WITH c AS (SELECT l_linestatus, least(floor(c * 10), 9) AS bin, count(*) AS n, abs(avg(c) - avg(r)) AS gap FROM (SELECT l_linestatus, l_discount * 10 AS c, (l_returnflag = 'R')::INT AS r FROM lineitem) GROUP BY ALL) SELECT l_linestatus, round(sum(n * gap) / sum(n), 6) AS ece FROM c GROUP BY 1""")
def ece(spark, sf):
    return measures.calibration_error(t(spark, sf, "lineitem"), "l_linestatus", F.col("l_discount") * 10, F.col("l_returnflag") == "R")


def _sql_bucket(x: str) -> str:
    out = "0"
    for i in (1, 9, 17, 25):
        out = f"(({out}) * 296 + ('0x' || substr(md5({x}), {i}, 8))::BIGINT % 1000) % 1000"
    return out


@query("ab_assign", f"SELECT CASE WHEN b < 500 THEN 'control' WHEN b < 900 THEN 'treatment' ELSE 'holdout' END AS variant, count(*) AS users FROM (SELECT {_sql_bucket('''('exp1:' || user_id)''')} AS b FROM (SELECT DISTINCT user_id FROM events)) GROUP BY 1")
def ab_assign(spark, sf):
    b = measures.hash_bucket(F.concat(F.lit("exp1:"), F.col("user_id").cast("string")))
    users = t(spark, sf, "events").select("user_id").distinct().withColumn("b", b)
    return users.groupBy(F.when(F.col("b") < 500, "control").when(F.col("b") < 900, "treatment").otherwise("holdout").alias("variant")).agg(F.count("*").alias("users"))


@query("ab_compare", """WITH r AS (SELECT user_id % 2 = 1 AS b, value AS v FROM events), s AS (SELECT count(v) FILTER (NOT b) AS n0, count(v) FILTER (b) AS n1, avg(v) FILTER (NOT b) AS m0, avg(v) FILTER (b) AS m1, var_samp(v) FILTER (NOT b) AS v0, var_samp(v) FILTER (b) AS v1 FROM r)
    SELECT n0, n1, round(m0, 6) AS mean0, round(m1, 6) AS mean1, round(v0, 6) AS var0, round(v1, 6) AS var1, round((m1 - m0) / sqrt(v0 / n0 + v1 / n1), 6) AS t FROM s""")
def ab_compare(spark, sf):
    return measures.ab_compare(t(spark, sf, "events"), F.col("user_id") % 2 == 1, "value")


@query("entropy_balance", """WITH c AS (SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL), s AS (SELECT lang, n / sum(n) OVER (PARTITION BY lang) AS p FROM c) SELECT lang, count(*) AS k, round(least(sum(-p * ln(p)) / ln(count(*) + 1), 1), 6) AS balance FROM s GROUP BY 1""")
def entropy_balance(spark, sf):
    return measures.entropy_balance(t(spark, sf, "documents"), "lang", "source")


_SQL_WORDS = r"regexp_extract_all(lower(coalesce({}, '')), '[\p{{L}}\p{{N}}_]+')"


@query("vocab_stats", f"WITH w AS (SELECT lang, unnest({_SQL_WORDS.format('text')}) AS w FROM documents) SELECT lang, count(*) AS total, count(DISTINCT w) AS distinct_words, round(count(DISTINCT w) / count(*), 6) AS diversity FROM w GROUP BY 1")
def vocab_stats(spark, sf):
    return measures.vocabulary(t(spark, sf, "documents"), "lang", "text")


def _sql_bleu(n: int) -> str:
    return f"""WITH p AS (SELECT a.item_id, {_SQL_WORDS.format('a.text')} AS r, {_SQL_WORDS.format('b.text')} AS h FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id + 1),
    g AS (SELECT item_id, unnest([array_to_string(r[i:i + {n - 1}], ' ') for i in range(1, len(r) - {n} + 2)]) AS g, 1 AS a, 0 AS b FROM p
        UNION ALL SELECT item_id, unnest([array_to_string(h[i:i + {n - 1}], ' ') for i in range(1, len(h) - {n} + 2)]), 0, 1 FROM p),
    c AS (SELECT item_id, sum(m) AS hits FROM (SELECT item_id, g, least(sum(a), sum(b)) AS m FROM g GROUP BY ALL) GROUP BY 1)
    SELECT item_id, round(CASE WHEN len(h) < {n} THEN 0 ELSE (CASE WHEN len(h) >= len(r) THEN 1 ELSE exp(1 - len(r) / len(h)) END) * coalesce(hits, 0) / len(h) END, 6)::DOUBLE AS bleu_{n} FROM p LEFT JOIN c USING (item_id)"""


def _bleu(n: int):
    def plan(spark, sf):
        items = t(spark, sf, "benchmark").select("item_id", "text")
        pairs = items.join(items.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("said")), "item_id")
        return measures.bleu(pairs, "item_id", "text", "said", n)

    return plan


for _n in (1, 2):
    query(f"bleu_{_n}", _sql_bleu(_n))(_bleu(_n))


# ---- changes


@query("exact_duplicates", "SELECT sha256(coalesce(text, '')) AS digest, min(doc_id) AS kept, count(*) AS copies, count(*) - 1 AS removed FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_duplicates(spark, sf):
    return changes.exact_duplicates(t(spark, sf, "documents"), "doc_id", ["text"])


@query("version_diff", f"""WITH v AS (SELECT user_id, {SQL_LATE} AS late, count(*) AS n FROM events GROUP BY ALL), o AS (SELECT user_id, n FROM v WHERE NOT late), w AS (SELECT user_id, n FROM v WHERE late)
    SELECT user_id, CASE WHEN o.n IS NULL THEN 'added' WHEN w.n IS NULL THEN 'removed' ELSE 'changed' END AS change, o.n AS before, w.n AS after FROM o FULL JOIN w USING (user_id) WHERE o.n IS DISTINCT FROM w.n""")
def version_diff(spark, sf):
    rows = t(spark, sf, "events").groupBy("user_id", late().alias("late")).agg(F.count("*").alias("n"))
    return changes.diff(rows.where("not late"), rows.where("late"), "user_id", "n")


@query("orphans", "SELECT lang, count(*) AS n FROM documents ANTI JOIN labels USING (doc_id) GROUP BY 1")
def orphans(spark, sf):
    return changes.orphans(t(spark, sf, "documents").select("doc_id", "lang"), t(spark, sf, "labels"), "doc_id").groupBy("lang").agg(F.count("*").alias("n"))


@query("regression_alerts", f"""WITH m AS (SELECT user_id, avg(value) FILTER ({SQL_LATE}) AS now, avg(value) FILTER (NOT ({SQL_LATE})) AS base FROM events GROUP BY 1),
    c AS (SELECT user_id, round((coalesce(now, 0) - base) / abs(base), 6) AS change FROM m WHERE base <> 0) SELECT user_id, change, CASE WHEN change < -0.5 THEN 'critical' ELSE 'warning' END AS severity FROM c WHERE change < -0.1""")
def regression_alerts(spark, sf):
    rows = t(spark, sf, "events").select("user_id", "value", late().alias("late"))
    mean = lambda side: rows.where(side).groupBy("user_id").agg(F.avg("value").alias("v"))
    return changes.regressions(mean("late"), mean("not late"), "user_id", "v", 0.1, 0.5)


# ---- texts, exports, vectors


@query("pii_counts", "SELECT lang, " + ", ".join(f"sum(len(regexp_extract_all(coalesce(text, ''), '{p}')))::BIGINT AS n_{k}" for k, p in tx.PII.items()) + " FROM documents GROUP BY 1")
def pii_counts(spark, sf):
    return t(spark, sf, "documents").groupBy("lang").agg(*(F.sum(tx.pii_count(F.col("text"), k)).alias(f"n_{k}") for k in tx.PII))


def _sql_redacted() -> str:
    out = "text"
    for pattern in tx.PII.values():
        out = f"regexp_replace({out}, '{pattern}', '[REDACTED]', 'g')"
    return out


@query("pii_redact", f"SELECT doc_id, sha256({_sql_redacted()}) AS redacted FROM documents")
def pii_redact(spark, sf):
    return t(spark, sf, "documents").select("doc_id", F.sha2(tx.redact(F.col("text")), 256).alias("redacted"))


@query("sanitize_text", r"""SELECT page_id, sha256(replace(replace(replace(replace(replace(trim(regexp_replace(html, '[\x00-\x08\x0B-\x1F\x7F]', '', 'g'), ' '), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;')) AS clean FROM pages""")
def sanitize_text(spark, sf):
    return t(spark, sf, "pages").select("page_id", F.sha2(tx.sanitize(F.col("html")), 256).alias("clean"))


@query("llava_export", "SELECT conv_id, string_agg(CASE WHEN role = 'user' THEN 'human' ELSE 'gpt' END || ': ' || coalesce(text, ''), chr(10) ORDER BY turn) AS conversations FROM conversations GROUP BY 1")
def llava_export(spark, sf):
    said = F.concat(F.when(F.col("role") == "user", "human").otherwise("gpt"), F.lit(": "), F.coalesce("text", F.lit("")))
    rows = t(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", said.alias("said")))).alias("turns"))
    return rows.select("conv_id", F.array_join(F.transform("turns", lambda x: x["said"]), "\n").alias("conversations"))


@query("next_observation", "SELECT conv_id, turn, role, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role, lead(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS next_chars FROM conversations")
def next_observation(spark, sf):
    by = Window.partitionBy("conv_id").orderBy("turn")
    return t(spark, sf, "conversations").select("conv_id", "turn", "role", F.lead("role").over(by).alias("next_role"), F.lead(F.length("text")).over(by).cast("long").alias("next_chars"))


_SQL_SCORES = {"cosine": "list_cosine_similarity", "inner": "list_inner_product", "l2": "-list_distance"}


def _search(metric: str):
    def plan(spark, sf):
        rows = t(spark, sf, "embeddings")
        return vectors.top_k(rows, rows.where("vec_id % 50 = 0"), "vec_id", "embedding", 5, metric)

    return plan


for _m, _f in _SQL_SCORES.items():
    query(f"vector_topk_{_m}", f"""WITH p AS (SELECT q.vec_id AS query, r.vec_id AS id, round({_f}(q.embedding::DOUBLE[], r.embedding::DOUBLE[]), 6) AS score FROM embeddings q, embeddings r WHERE q.vec_id % 50 = 0 AND q.vec_id <> r.vec_id)
        SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM p QUALIFY rank <= 5""")(_search(_m))


@query("pricing_summary", """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS n
    FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""")
def pricing_summary(spark, sf):
    rows = t(spark, sf, "lineitem").where("l_shipdate <= TIMESTAMP_NTZ '1998-09-02'")
    price = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(price), 2).alias("sum_disc_price"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))


@query("revenue_by_nation", """SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY 1""")
def revenue_by_nation(spark, sf):
    lines = t(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("r"))
    orders = lines.join(t(spark, sf, "orders").select("o_orderkey", "o_custkey"), "o_orderkey").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum("r").alias("r"))
    named = orders.join(t(spark, sf, "customer").select("c_custkey", "c_nationkey"), "c_custkey").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.sum("r").alias("r"))
    return named.join(t(spark, sf, "nation").select("n_nationkey", "n_name"), "n_nationkey").groupBy("n_name").agg(F.round(F.sum("r"), 2).alias("revenue"))


@query("event_properties", "SELECT event_type, count(*) AS n, round(avg((props->>'$.k')::DOUBLE), 6) AS mean_k FROM events GROUP BY 1")
def event_properties(spark, sf):
    return t(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg(F.get_json_object("props", "$.k").cast("double")), 6).alias("mean_k"))
