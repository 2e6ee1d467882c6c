"""Registered queries: dataset and timeline quality, diverse choice, combined scores, periods, narrations."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomwright.operators import quality, selection, series, summaries
from loomwright.plans.catalog import query, t

_SQL_WORDS = r"regexp_extract_all(lower(coalesce({0}, '')), '\S+')"


@query("dataset_quality", f"""WITH s AS (SELECT conv_id, coalesce(text, '') AS c, role AS v FROM conversations), v AS (SELECT v, count(*) AS n FROM s WHERE v <> '' GROUP BY 1),
    e AS (SELECT count(*) AS k, sum(n) AS said, ln(sum(n)) - sum(n * ln(n)) / sum(n) AS h FROM v), w AS (SELECT count(DISTINCT w) AS words FROM (SELECT unnest({_SQL_WORDS.format("c")}) AS w FROM s)),
    p AS (SELECT count(DISTINCT conv_id) AS items, count(*) AS n, avg(length(c)) AS len, sum((c = '')::INT + coalesce(v = '', true)::INT) AS missing FROM s)
    SELECT items, round(n / items, 6) AS segments_per_item, round(len, 6) AS caption_length, words AS vocabulary, round(k / said, 6) AS verb_diversity, round(least(h / ln(k + 1), 1), 6) AS balance, round(missing / (n * 2 + items), 6) AS missing_rate FROM p, w, e""")
def dataset_quality(spark, sf):
    return quality.dataset_quality(t(spark, sf, "conversations"), "conv_id", "text", "role")


def _sql_top(kind: str) -> str:
    return f"(SELECT string_agg(w || ':' || n, ',' ORDER BY n DESC, w) FROM (SELECT w, n FROM c WHERE kind = '{kind}' ORDER BY n DESC, w LIMIT 10))"


@query("vocabulary_features", f"""WITH x AS (SELECT 'v' AS kind, p_brand AS w FROM part UNION ALL SELECT 'n', p_type FROM part), c AS (SELECT kind, w, count(*) AS n FROM x WHERE w IS NOT NULL GROUP BY ALL)
    SELECT count(DISTINCT w) AS unique_words, sum(n)::BIGINT AS total_words, count(DISTINCT w) FILTER (kind = 'v') AS unique_verbs, count(DISTINCT w) FILTER (kind = 'n') AS unique_nouns, {_sql_top("v")} AS top_verbs, {_sql_top("n")} AS top_nouns, round(count(DISTINCT w) / sum(n), 6) AS diversity FROM c""")
def vocabulary_features(spark, sf):
    return quality.vocabulary(t(spark, sf, "part"), "p_brand", "p_type")


@query("temporal_consistency", """WITH s AS (SELECT user_id, event_id, event_type, epoch_us(ts) / 1e6 AS a, epoch_us(ts) / 1e6 + value * 600 AS b FROM events WHERE value >= 0),
    p AS (SELECT *, lead(a) OVER (PARTITION BY user_id ORDER BY a, event_id) AS nx FROM s), k AS (SELECT user_id, event_type, count(*) AS n, stddev_samp(b - a) AS s, avg(b - a) AS m FROM p WHERE event_type IS NOT NULL GROUP BY ALL),
    u AS (SELECT user_id, count(*) FILTER (n >= 3 AND m > 0 AND s / m > 0.5) AS uneven_actions FROM k GROUP BY 1),
    o AS (SELECT user_id, count(*) AS segments, count(*) FILTER (b > nx) AS "overlaps", count(*) FILTER (nx - b > 5) AS large_gaps FROM p GROUP BY 1), j AS (SELECT o.*, coalesce(uneven_actions, 0) AS uneven_actions FROM o LEFT JOIN u USING (user_id))
    SELECT *, round(CASE WHEN segments < 2 THEN 0.7 ELSE greatest(0, 1 - "overlaps" * 0.05::DOUBLE - large_gaps * 0.03::DOUBLE - uneven_actions * 0.05::DOUBLE - 0.1::DOUBLE * (("overlaps" > segments * 0.5)::INT + (large_gaps > segments * 0.3)::INT + (uneven_actions > 2)::INT)) END, 6)::DOUBLE AS score FROM j""")
def temporal_consistency(spark, sf):
    start = series.seconds("ts")
    rows = t(spark, sf, "events").where("value >= 0").select("user_id", "event_id", "event_type", start.alias("start"), (start + F.col("value") * 600).alias("end"))
    return quality.temporal_consistency(rows, "user_id", "event_id", "start", "end", "event_type")


@query("stability_score", f"""WITH p AS (SELECT list_distinct({_SQL_WORDS.format("a.text")}) AS x, list_distinct({_SQL_WORDS.format("b.text")}) AS y FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id + 1)
    SELECT count(*) AS n, round(avg(coalesce(len(list_intersect(x, y)) / nullif(len(list_distinct(x || y)), 0), 0)), 6) AS score FROM p""")
def stability_score(spark, sf):
    items = t(spark, sf, "benchmark").select("item_id", "text")
    pairs = items.join(items.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("other")), "item_id")
    return quality.token_iou(pairs, "text", "other")


@query("krippendorff_alpha", """WITH r AS (SELECT doc_id, quality AS c FROM labels UNION ALL SELECT doc_id, toxic FROM labels), k AS (SELECT doc_id, c, count(*) AS n FROM r WHERE c IS NOT NULL GROUP BY ALL),
    i AS (SELECT doc_id, sum(n * (n - 1)) AS same FROM k GROUP BY 1 HAVING sum(n) = 2), s AS (SELECT c, sum(n) AS n FROM k SEMI JOIN i USING (doc_id) GROUP BY 1),
    v AS (SELECT (SELECT sum(same) / (count(*) * 2.0) FROM i)::DOUBLE AS p, (SELECT sum(n * n)::DOUBLE / (sum(n) * sum(n))::DOUBLE FROM s) AS pe)
    SELECT round(CASE WHEN pe >= 1 THEN 0 ELSE greatest(0, least(1, (p - pe) / (1 - pe))) END, 6)::DOUBLE AS alpha FROM v""")
def krippendorff_alpha(spark, sf):
    """Fleiss' kappa, 0 at least, which stands in for the full alpha."""
    said = t(spark, sf, "labels").select("doc_id", F.explode(F.array("quality", "toxic")).alias("label"))
    return selection.fleiss_kappa(said, "doc_id", "label", 2).select(F.greatest(F.lit(0.0), "kappa").alias("alpha"))


_PICKS = 5
_SQL_PICKS = ", ".join(
    f"p{i} AS (SELECT {i} AS rank, e.vec_id, e.u, round(least({', '.join(f'list_distance(e.u, p{j}.u)' for j in range(1, i))}), 9) AS s FROM e, {', '.join(f'p{j}' for j in range(1, i))} WHERE e.vec_id NOT IN ({', '.join(f'p{j}.vec_id' for j in range(1, i))}) ORDER BY s DESC, e.vec_id LIMIT 1)"
    for i in range(2, _PICKS + 1))


@query("diversity_kcenter", f"""WITH n AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE embedding IS NOT NULL), e AS (SELECT vec_id, sqrt(list_dot_product(v, v)) AS norm, list_transform(v, lambda x: x / (sqrt(list_dot_product(v, v)) + 1e-8)) AS u FROM n),
    p1 AS (SELECT 1 AS rank, vec_id, u, round(norm, 9) AS s FROM e ORDER BY s DESC, vec_id LIMIT 1), {_SQL_PICKS}
    {" UNION ALL ".join(f"SELECT rank::BIGINT AS rank, vec_id, round(s, 6) AS score FROM p{i}" for i in range(1, _PICKS + 1))}""")
def diversity_kcenter(spark, sf):
    return quality.k_center(t(spark, sf, "embeddings"), "vec_id", "embedding", _PICKS)


@query("overall_scores", """WITH q AS (SELECT s_suppkey AS k, 0.4 * s_acctbal / 10000 AS p FROM supplier), c AS (SELECT l_suppkey AS k, 0.3 * avg(1 - l_discount) AS p FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1), l AS (SELECT l_suppkey AS k, 0.3 * avg(l_tax) AS p FROM lineitem WHERE l_quantity > 45 GROUP BY 1)
    SELECT k AS s_suppkey, round(sum(coalesce(p, 0)), 6)::DOUBLE AS overall FROM (FROM q UNION ALL FROM c UNION ALL FROM l) GROUP BY 1""")
def overall_scores(spark, sf):
    lines = t(spark, sf, "lineitem").withColumnRenamed("l_suppkey", "s_suppkey")
    scores = {
        "quality": t(spark, sf, "supplier").select("s_suppkey", (F.col("s_acctbal") / 10000).alias("score")),
        "cost": lines.where("l_returnflag = 'R'").groupBy("s_suppkey").agg(F.avg(1 - F.col("l_discount")).alias("score")),
        "latency": lines.where("l_quantity > 45").groupBy("s_suppkey").agg(F.avg("l_tax").alias("score")),
    }
    return quality.combined(scores, "s_suppkey", {"quality": 0.4, "cost": 0.3, "latency": 0.3})


@query("nightly_comparison", """WITH d AS (SELECT ts::DATE AS day, count(*) AS n, round(count(*) FILTER (event_type = 'error') / count(*), 6) AS rate FROM events GROUP BY 1)
    SELECT a.day, b.day IS NOT NULL AS compared, a.n - b.n AS n_change, round(a.rate - b.rate, 6) AS rate_change FROM d a LEFT JOIN d b ON b.day = a.day - 1""")
def nightly_comparison(spark, sf):
    days = summaries.rates(t(spark, sf, "events"), [F.to_date("ts").alias("day")], F.col("event_type") == "error")
    return quality.against_earlier(days, "day", ["n", "rate"])


@query("narration_export", """WITH c AS (SELECT conv_id, list({'start_time': turn::DOUBLE, 'end_time': turn + 1.0::DOUBLE, 'timestamp': (turn + (turn + 1.0::DOUBLE)) / 2, 'narration_text': coalesce(text, ''), 'actions': [{'verb': 'say', 'noun': coalesce(role, '')}], 'scene_context': {'scene_type': 'unknown', 'lighting': 'unknown'},
    'hand_tracking': {'left_hand': {'visible': false}, 'right_hand': {'visible': false}}, 'object_interactions': CASE WHEN coalesce(role, '') = '' THEN [] ELSE [{'action': 'say', 'object': role}] END} ORDER BY turn, coalesce(text, ''), coalesce(role, '')) AS n FROM conversations GROUP BY 1)
    SELECT conv_id, len(n) AS narrations, to_json({'video_id': conv_id::VARCHAR, 'annotation_standard': 'ego4d', 'narrations': n})::VARCHAR AS record FROM c""")
def narration_export(spark, sf):
    start, text, role = F.col("turn").cast("double"), F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    actions = F.array(F.struct(F.lit("say").alias("verb"), role.alias("noun")))
    said = F.struct("turn", text.alias("t"), role.alias("r"), quality.narration(start, start + 1, text, actions).alias("x"))
    rows = t(spark, sf, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(said)), lambda s: s["x"]).alias("narrations"))
    record = F.struct(F.col("conv_id").cast("string").alias("video_id"), F.lit("ego4d").alias("annotation_standard"), "narrations")
    return rows.select("conv_id", F.size("narrations").cast("long").alias("narrations"), F.to_json(record).alias("record"))
