"""Registered queries on choosing samples, thresholds and versions, with DuckDB SQL for the same result."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomwright.operators import selection
from loomwright.plans.catalog import _SQL_WORDS, _sql_bucket, query, t


@query("uncertainty_topk", """WITH p AS (SELECT p_partkey, greatest(0.001, least(0.999, p_retailprice / 2500)) AS p FROM part)
    SELECT p_partkey, round(-(p * log2(p) + (1 - p) * log2(1 - p)), 6) AS score FROM p ORDER BY score DESC, p_partkey LIMIT 50""")
def uncertainty_topk(spark, sf):
    rows = t(spark, sf, "part").select("p_partkey", F.round(selection.uncertainty(F.col("p_retailprice") / 2500), 6).alias("score"))
    return selection.best(rows, "p_partkey", 50)


@query("expected_change_topk", r"""SELECT doc_id, round((1 - coalesce(quality, 0.5)) * ln(1 + len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\r\f]+'))), 6)::DOUBLE AS score
    FROM documents LEFT JOIN labels USING (doc_id) ORDER BY score DESC, doc_id LIMIT 50""")
def expected_change_topk(spark, sf):
    rows = t(spark, sf, "documents").select("doc_id", "text").join(t(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    return selection.best(rows.select("doc_id", F.round(selection.expected_change(F.col("quality"), F.col("text")), 6).alias("score")), "doc_id", 50)


@query("qbc_entropy", """WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL), s AS (SELECT user_id, n / sum(n) OVER (PARTITION BY user_id) AS p FROM c)
    SELECT user_id, round(sum(-p * log2(p)), 6) AS score FROM s GROUP BY 1 ORDER BY score DESC, user_id LIMIT 50""")
def qbc_entropy(spark, sf):
    return selection.best(selection.vote_entropy(t(spark, sf, "events"), "user_id", "event_type"), "user_id", 50)


@query("threshold_opt", """WITH r AS (SELECT least(floor((l_discount * 10 - 0.1) / (0.85 / 49) + 1e-9), 49)::BIGINT AS level, (l_returnflag = 'R')::INT AS r FROM lineitem)
    SELECT i AS step, round(0.1 + i * (0.85 / 49), 6)::DOUBLE AS threshold, round(sum(r) / count(*), 6)::DOUBLE AS accuracy, round(count(*) / (SELECT count(*) FROM r), 6)::DOUBLE AS coverage, round(sum(r) / (SELECT count(*) FROM r), 6)::DOUBLE AS expected_accuracy
    FROM range(50) g(i) JOIN r ON level >= i GROUP BY i""")
def threshold_opt(spark, sf):
    return selection.thresholds(t(spark, sf, "lineitem"), F.col("l_discount") * 10, F.col("l_returnflag") == "R")


@query("temperature_grid", """WITH g AS (SELECT i AS step, 0.5 + i * (1.5 / 49) AS temp FROM range(50) g(i)), c AS (SELECT greatest(0.01, least(0.99, l_discount * 10)) AS c, (l_returnflag = 'R')::INT AS r FROM lineitem),
    s AS (SELECT step::INT AS step, temp, r, 1 / (1 + exp(-ln(c / (1 - c)) / temp)) AS s FROM c, g), b AS (SELECT step, temp, least(floor(s * 10), 9) AS bin, count(*) AS n, abs(sum(s) - sum(r)) AS gap FROM s GROUP BY ALL)
    SELECT step, round(sum(gap) / sum(n), 6)::DOUBLE AS ece, round(temp, 6)::DOUBLE AS temperature FROM b GROUP BY step, temp""")
def temperature_grid(spark, sf):
    return selection.temperatures(t(spark, sf, "lineitem"), F.col("l_discount") * 10, F.col("l_returnflag") == "R")


@query("canary_route", f"SELECT CASE WHEN b / 1000 <= 0.9 THEN 'stable' ELSE 'canary' END AS version, count(*) AS requests FROM (SELECT {_sql_bucket('event_id::VARCHAR')} AS b FROM events) GROUP BY 1")
def canary_route(spark, sf):
    to = selection.route(F.col("event_id").cast("string"), {"stable": 0.9, "canary": 0.1})
    return t(spark, sf, "events").groupBy(to.alias("version")).agg(F.count("*").alias("requests"))


@query("meteor", f"""WITH p AS (SELECT a.item_id, list_distinct({_SQL_WORDS.format('a.text')}) AS r, list_distinct({_SQL_WORDS.format('b.text')}) AS h FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id + 1),
    m AS (SELECT item_id, len(list_intersect(r, h)) AS m, len(r) AS nr, len(h) AS nh FROM p)
    SELECT item_id, round(CASE WHEN m = 0 THEN 0 ELSE (m / nh) * (m / nr) / (0.9 * (m / nh) + (1 - 0.9) * (m / nr)) * (1 - 0.5 * (1 - m / greatest(nr, nh))) END, 6)::DOUBLE AS meteor FROM m""")
def meteor(spark, sf):
    items = t(spark, sf, "benchmark").select("item_id", "text")
    pairs = items.join(items.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("said")), "item_id")
    return selection.meteor(pairs, "item_id", "text", "said")


@query("fleiss_kappa", """WITH r AS (SELECT doc_id, quality AS c FROM labels UNION ALL SELECT doc_id, toxic FROM labels), k AS (SELECT doc_id, c, count(*) AS n FROM r WHERE c IS NOT NULL GROUP BY ALL),
    i AS (SELECT doc_id, sum(n * (n - 1)) AS same FROM k GROUP BY 1 HAVING sum(n) = 2), s AS (SELECT c, sum(n) AS n FROM k SEMI JOIN i USING (doc_id) GROUP BY 1),
    v AS (SELECT (SELECT sum(same) / (count(*) * 2.0) FROM i)::DOUBLE AS p, (SELECT sum(n * n)::DOUBLE / (sum(n) * sum(n))::DOUBLE FROM s) AS pe)
    SELECT round(CASE WHEN pe >= 1 THEN 0 ELSE greatest(-1, least(1, (p - pe) / (1 - pe))) END, 6)::DOUBLE AS kappa FROM v""")
def fleiss_kappa(spark, sf):
    labels = t(spark, sf, "labels")
    said = labels.select("doc_id", F.explode(F.array("quality", "toxic")).alias("label"))
    return selection.fleiss_kappa(said, "doc_id", "label", 2)
