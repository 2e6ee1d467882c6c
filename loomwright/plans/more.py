"""Further registered queries: summaries, text metrics, search, exports, walks, versions and checks."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from loomwright.functions import text as tx
from loomwright.operators import graphs, measures, summaries, textmetrics
from loomwright.plans.catalog import query, t

UNTIL, WEEK = "2024-01-30", 7 * 86400
_SQL_UNTIL = f"TIMESTAMP '{UNTIL}'"


def _words(column: str) -> str:
    return rf"regexp_extract_all(lower(coalesce({column}, '')), '[\p{{L}}\p{{N}}_]+')"


# ---- totals, shares, rates


@query("cost_by_flag", """SELECT l_returnflag, l_linestatus, count(l_extendedprice) AS n, round(sum(l_extendedprice), 6) AS sum, round(avg(l_extendedprice), 6) AS mean, min(l_extendedprice) AS least, max(l_extendedprice) AS most,
    round(sum(l_extendedprice) / (SELECT sum(l_extendedprice) FROM lineitem), 6) AS share FROM lineitem GROUP BY ALL""")
def cost_by_flag(spark, sf):
    return summaries.totals(t(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice")


@query("cost_components", "SELECT l_returnflag, round(sum(l_extendedprice * (1 - l_discount)), 4) AS net, round(sum(l_extendedprice * l_discount), 4) AS discount, round(sum(l_extendedprice * (1 - l_discount) * l_tax), 4) AS tax FROM lineitem GROUP BY 1")
def cost_components(spark, sf):
    price, off = F.col("l_extendedprice"), F.col("l_discount")
    parts = {"net": price * (1 - off), "discount": price * off, "tax": price * (1 - off) * F.col("l_tax")}
    return t(spark, sf, "lineitem").groupBy("l_returnflag").agg(*(F.round(F.sum(c), 4).alias(n) for n, c in parts.items()))


@query("most_expensive", "SELECT l_suppkey, count(*) AS n, round(sum(l_extendedprice), 4) AS total FROM lineitem GROUP BY 1 ORDER BY total DESC, l_suppkey LIMIT 10")
def most_expensive(spark, sf):
    return t(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 4).alias("total")).orderBy(F.desc("total"), "l_suppkey").limit(10)


@query("cost_since", "SELECT o_orderpriority, count(*) AS n, round(sum(o_totalprice), 4) AS total FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' GROUP BY 1")
def cost_since(spark, sf):
    rows = t(spark, sf, "orders").where(F.col("o_orderdate") >= F.lit("1996-01-01").cast("timestamp_ntz"))
    return rows.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 4).alias("total"))


@query("failure_rate", "SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'error') AS hits, round(count(*) FILTER (event_type = 'error') / count(*), 6) AS rate FROM events GROUP BY 1")
def failure_rate(spark, sf):
    return summaries.rates(t(spark, sf, "events"), [F.col("user_id")], F.col("event_type") == "error")


@query("failure_trend", "SELECT date_trunc('day', ts)::DATE AS day, count(*) AS n, count(*) FILTER (event_type = 'error') AS hits, round(count(*) FILTER (event_type = 'error') / count(*), 6) AS rate FROM events GROUP BY 1")
def failure_trend(spark, sf):
    return summaries.rates(t(spark, sf, "events"), [F.to_date("ts").alias("day")], F.col("event_type") == "error")


@query("top_reasons", "SELECT event_type, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, event_type LIMIT 3")
def top_reasons(spark, sf):
    return t(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "event_type").limit(3)


@query("window_throughput", f"SELECT event_type, count(*) AS n, round(count(*) / {WEEK}, 6) AS per_second, round(avg(value), 6) AS mean FROM events WHERE ts <= {_SQL_UNTIL} AND ts > {_SQL_UNTIL} - INTERVAL {WEEK} SECOND GROUP BY 1")
def window_throughput(spark, sf):
    return summaries.throughput(t(spark, sf, "events"), ["event_type"], "ts", "value", UNTIL, WEEK)


@query("slow_rows", "SELECT event_id, event_type, value FROM events WHERE value > 90 ORDER BY value DESC, event_id LIMIT 25")
def slow_rows(spark, sf):
    return t(spark, sf, "events").where("value > 90").select("event_id", "event_type", "value").orderBy(F.desc("value"), "event_id").limit(25)


@query("degradation", f"""WITH m AS (SELECT user_id, avg(value) FILTER (ts > {_SQL_UNTIL} - INTERVAL {WEEK} SECOND) AS a, avg(value) FILTER (ts <= {_SQL_UNTIL} - INTERVAL {WEEK} SECOND) AS b
    FROM events WHERE ts <= {_SQL_UNTIL} AND ts > {_SQL_UNTIL} - INTERVAL {3 * WEEK} SECOND GROUP BY 1)
    SELECT user_id, round(a, 6) AS recent, round(b, 6) AS baseline, round(a - b, 6) AS change, b - a > 5 AS degraded FROM m WHERE a IS NOT NULL AND b IS NOT NULL""")
def degradation(spark, sf):
    return summaries.degradation(t(spark, sf, "events"), ["user_id"], "ts", "value", UNTIL, WEEK, 2 * WEEK, 5.0)


@query("growth_rate", """WITH m AS (SELECT user_id, arg_min(value, (ts, event_id)) AS first, arg_max(value, (ts, event_id)) AS last, epoch_us(max(ts)) - epoch_us(min(ts)) AS d FROM events WHERE value IS NOT NULL GROUP BY 1)
    SELECT user_id, first, last, round(coalesce((last - first) * 1e6 / nullif(d, 0), 0), 6) AS per_second FROM m""")
def growth_rate(spark, sf):
    return summaries.growth(t(spark, sf, "events").where("value is not null"), ["user_id"], "ts", "value", "event_id")


@query("latest_anomalies", """WITH m AS (SELECT user_id, arg_max(value, (ts, event_id)) AS latest, avg(value) AS mean, stddev_pop(value) AS s FROM events WHERE value IS NOT NULL GROUP BY 1)
    SELECT user_id, latest, round(mean, 6) AS mean, round(abs(latest - mean) / s, 6) AS z FROM m WHERE s <> 0 AND abs(latest - mean) / s > 1.5""")
def latest_anomalies(spark, sf):
    return summaries.latest_anomalies(t(spark, sf, "events").where("value is not null"), "user_id", ["ts", "event_id"], "value", 1.5)


@query("daily_snapshot", "SELECT event_type, ts::DATE AS day, count(value) AS n, round(avg(value), 6) AS mean, min(value) AS least, max(value) AS most, round(count(*) FILTER (value >= 50) / count(*), 6) AS passing FROM events GROUP BY ALL")
def daily_snapshot(spark, sf):
    passing = F.count_if(F.col("value") >= 50) / F.count("*")
    rows = t(spark, sf, "events").groupBy("event_type", F.to_date("ts").alias("day"))
    return rows.agg(F.count("value").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.min("value").alias("least"), F.max("value").alias("most"), F.round(passing, 6).alias("passing"))


@query("quality_rollup", "SELECT lang, source, (grouping(lang) + grouping(source))::INT AS level, count(quality) AS n, round(avg(quality), 6) AS mean FROM documents JOIN labels USING (doc_id) GROUP BY ROLLUP (lang, source)")
def quality_rollup(spark, sf):
    rows = t(spark, sf, "documents").select("doc_id", "lang", "source").join(t(spark, sf, "labels"), "doc_id")
    return summaries.rollup_mean(rows, ["lang", "source"], "quality")


@query("status_counts", "SELECT o_orderpriority, count(*) AS n, count(*) FILTER (o_orderstatus = 'O') AS n_o, count(*) FILTER (o_orderstatus = 'F') AS n_f, count(*) FILTER (o_orderstatus = 'P') AS n_p FROM orders GROUP BY 1")
def status_counts(spark, sf):
    return summaries.pivot_counts(t(spark, sf, "orders"), "o_orderpriority", "o_orderstatus", ["O", "F", "P"])


@query("reviewer_stats", """SELECT o_custkey, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS approved, round(count(*) FILTER (o_orderstatus = 'F') / count(*), 6) AS approval, round(avg(o_totalprice), 6) AS mean,
    round(date_diff('second', min(o_orderdate), max(o_orderdate)) / 3600.0, 6) AS hours FROM orders GROUP BY 1""")
def reviewer_stats(spark, sf):
    seconds = F.unix_micros(F.max("o_orderdate").cast("timestamp")) / 1e6 - F.unix_micros(F.min("o_orderdate").cast("timestamp")) / 1e6
    yes = F.count_if(F.col("o_orderstatus") == "F")
    return t(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), yes.alias("approved"), F.round(yes / F.count("*"), 6).alias("approval"), F.round(F.avg("o_totalprice"), 6).alias("mean"), F.round(seconds / 3600, 6).alias("hours"))


@query("trace_summary", "SELECT conv_id, count(*) AS spans, count(DISTINCT role) AS roles, sum(length(coalesce(text, '')))::BIGINT AS chars, min(turn) AS first, max(turn) AS last FROM conversations GROUP BY 1")
def trace_summary(spark, sf):
    rows = t(spark, sf, "conversations").groupBy("conv_id")
    return rows.agg(F.count("*").alias("spans"), F.count_distinct("role").alias("roles"), F.sum(F.length(F.coalesce("text", F.lit("")))).alias("chars"), F.min("turn").alias("first"), F.max("turn").alias("last"))


@query("distinct_values", "SELECT lang, count(DISTINCT source) AS sources, string_agg(DISTINCT source, ',' ORDER BY source) AS names FROM documents WHERE lang IS NOT NULL GROUP BY 1")
def distinct_values(spark, sf):
    names = F.array_sort(F.collect_set("source"))
    return t(spark, sf, "documents").where("lang is not null").groupBy("lang").agg(F.count_distinct("source").alias("sources"), F.array_join(names, ",").alias("names"))


# ---- agreement


@query("confusion_matrix", "SELECT quality, toxic, count(*) AS n FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL GROUP BY ALL")
def confusion_matrix(spark, sf):
    return summaries.confusion(t(spark, sf, "labels"), "quality", "toxic")


@query("class_agreement", "SELECT quality, count(*) AS n, round(avg((quality = toxic)::INT), 6) AS agreement FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL GROUP BY 1")
def class_agreement(spark, sf):
    return summaries.class_agreement(t(spark, sf, "labels"), "quality", "toxic")


@query("label_agreement", "SELECT count(*) AS n, round(avg((quality = toxic)::INT), 6) AS equal, round(corr(quality, toxic), 6) AS pearson FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL")
def label_agreement(spark, sf):
    return summaries.agreement(t(spark, sf, "labels"), "quality", "toxic")


_SQL_LENGTH = "CASE WHEN n_chars < 500 THEN 'short' WHEN n_chars < 2000 THEN 'medium' ELSE 'long' END"


def _length() -> Column:
    return F.when(F.col("n_chars") < 500, "short").when(F.col("n_chars") < 2000, "medium").otherwise("long")


@query("agreement_by_difficulty", f"SELECT {_SQL_LENGTH} AS difficulty, count(*) AS n, round(avg((quality = toxic)::INT), 6) AS agreement FROM documents JOIN labels USING (doc_id) GROUP BY 1")
def agreement_by_difficulty(spark, sf):
    rows = t(spark, sf, "documents").select("doc_id", _length().alias("difficulty")).join(t(spark, sf, "labels"), "doc_id")
    return rows.groupBy("difficulty").agg(F.count("*").alias("n"), F.round(F.avg((F.col("quality") == F.col("toxic")).cast("int")), 6).alias("agreement"))


@query("duration_categories", f"SELECT {_SQL_LENGTH} AS category, count(*) AS n, round(avg(n_chars), 6) AS mean FROM documents GROUP BY 1")
def duration_categories(spark, sf):
    return t(spark, sf, "documents").groupBy(_length().alias("category")).agg(F.count("*").alias("n"), F.round(F.avg("n_chars"), 6).alias("mean"))


@query("exact_accuracy", "SELECT count(*) AS n, round(avg((trim(l.source) = trim(r.source))::INT), 6) AS accuracy FROM documents l JOIN documents r ON r.doc_id = l.doc_id + 1")
def exact_accuracy(spark, sf):
    docs = t(spark, sf, "documents").select("doc_id", "source")
    pairs = docs.join(docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("source").alias("said")), "doc_id")
    return pairs.agg(F.count("*").alias("n"), F.round(F.avg((F.trim("source") == F.trim("said")).cast("int")), 6).alias("accuracy"))


@query("moment_overlap", """WITH i AS (SELECT event_id, user_id, epoch_us(ts) / 1e6 AS a, epoch_us(ts) / 1e6 + value * 600 AS b FROM events WHERE value >= 0),
    p AS (SELECT user_id, a, b, lead(a) OVER w AS a2, lead(b) OVER w AS b2 FROM i WINDOW w AS (PARTITION BY user_id ORDER BY a, event_id)),
    o AS (SELECT user_id, coalesce(greatest(0, least(b, b2) - greatest(a, a2)) / nullif(greatest(b, b2) - least(a, a2), 0), 0) AS iou FROM p WHERE a2 IS NOT NULL)
    SELECT user_id, count(*) AS n, round(avg(iou), 6) AS mean_iou, round(avg((iou >= 0.5)::INT), 6) AS recall FROM o GROUP BY 1""")
def moment_overlap(spark, sf):
    start = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    rows = t(spark, sf, "events").where("value >= 0").select("event_id", "user_id", start.alias("a"), (start + F.col("value") * 600).alias("b"))
    after = Window.partitionBy("user_id").orderBy("a", "event_id")
    pairs = rows.select("user_id", "a", "b", F.lead("a").over(after).alias("a2"), F.lead("b").over(after).alias("b2")).where("a2 is not null")
    shares = pairs.select("user_id", summaries.overlap_share(F.col("a"), F.col("b"), F.col("a2"), F.col("b2")).alias("iou"))
    return shares.groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.avg("iou"), 6).alias("mean_iou"), F.round(F.avg((F.col("iou") >= 0.5).cast("int")), 6).alias("recall"))


@query("temporal_coherence", f"""WITH w AS (SELECT conv_id, turn, list_distinct({_words("text")}) AS w FROM conversations), p AS (SELECT conv_id, w, lag(w) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM w)
    SELECT conv_id, count(*) AS pairs, round(avg(CASE WHEN len(w) + len(b) = 0 THEN 1 ELSE len(list_intersect(w, b)) / len(list_distinct(list_concat(w, b))) END), 6) AS coherence FROM p WHERE b IS NOT NULL GROUP BY 1""")
def temporal_coherence(spark, sf):
    return textmetrics.adjacent_jaccard(t(spark, sf, "conversations"), "conv_id", "turn", "text")


# ---- text metrics, search, duplicates

_SQL_PAIRS = f"p AS (SELECT a.item_id, {_words('a.text')} AS r, {_words('b.text')} AS h FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id + 1)"


def _sql_grams(side: str, n: int) -> str:
    words = " || ' ' || ".join(f"{side}[i{f' + {j}' if j else ''}]" for j in range(n))
    return f"list_transform(range(1, len({side}) - {n - 1} + 1), lambda i: {words})"


def _pairs(spark, sf):
    items = t(spark, sf, "benchmark").select("item_id", "text")
    return items.join(items.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("said")), "item_id")


def _sql_hits(n: int) -> str:
    return f"""WITH {_SQL_PAIRS}, gr AS (SELECT item_id, unnest({_sql_grams("r", n)}) AS g FROM p), gh AS (SELECT item_id, unnest({_sql_grams("h", n)}) AS g FROM p),
        m AS (SELECT item_id, sum(least(x.n, y.n)) AS hits FROM (SELECT item_id, g, count(*) AS n FROM gr GROUP BY ALL) x JOIN (SELECT item_id, g, count(*) AS n FROM gh GROUP BY ALL) y USING (item_id, g) GROUP BY 1)"""


def _bleu(n: int) -> None:
    sql = f"""{_sql_hits(n)} SELECT item_id, round(CASE WHEN len(h) < {n} THEN 0 ELSE (CASE WHEN len(h) >= len(r) THEN 1 ELSE exp(1 - len(r) / len(h)) END) * coalesce(hits, 0) / len(h) END, 6)::DOUBLE AS bleu_{n} FROM p LEFT JOIN m USING (item_id)"""
    query(f"bleu_{n}", sql)(lambda spark, sf: measures.bleu(_pairs(spark, sf), "item_id", "text", "said", n))


def _rouge(n: int) -> None:
    sql = f"""{_sql_hits(n)} SELECT item_id, round(coalesce(2 * hits / nullif(greatest(0, len(r) - {n - 1}) + greatest(0, len(h) - {n - 1}), 0), 0), 6)::DOUBLE AS rouge_{n} FROM p LEFT JOIN m USING (item_id)"""
    query(f"rouge_{n}", sql)(lambda spark, sf: textmetrics.rouge(_pairs(spark, sf), "item_id", "text", "said", n))


for _n in (3, 4):
    _bleu(_n)
for _n in (1, 2):
    _rouge(_n)


@query("rouge_l", f"""WITH RECURSIVE {_SQL_PAIRS}, d AS (SELECT item_id, r, h, 0 AS i, list_transform(range(len(h) + 1), lambda x: 0::BIGINT) AS best FROM p UNION ALL
    SELECT item_id, r, h, i + 1, list_transform(c, lambda x, j: list_max(c[1:j])) FROM (SELECT item_id, r, h, i, list_transform(best, lambda x, j: CASE WHEN j > 1 AND h[j - 1] = r[i + 1] THEN greatest(x, best[j - 1] + 1) ELSE x END) AS c FROM d WHERE i < len(r)))
    SELECT item_id, round(coalesce(2 * best[len(h) + 1] / nullif(len(r) + len(h), 0), 0), 6)::DOUBLE AS rouge_l FROM d WHERE i = len(r)""")
def rouge_l(spark, sf):
    return textmetrics.rouge_l(_pairs(spark, sf), "item_id", "text", "said")


@query("cider", f"""WITH {_SQL_PAIRS}, gr AS ({" UNION ALL ".join(f"SELECT item_id, {n} AS n, unnest({_sql_grams('r', n)}) AS g FROM p" for n in range(1, 5))}),
    gh AS ({" UNION ALL ".join(f"SELECT item_id, {n} AS n, unnest({_sql_grams('h', n)}) AS g FROM p" for n in range(1, 5))}),
    cr AS (SELECT item_id, n, g, count(*) AS r FROM gr GROUP BY ALL), ch AS (SELECT item_id, n, g, count(*) AS h FROM gh GROUP BY ALL), df AS (SELECT n, g, count(*) AS df FROM cr GROUP BY ALL),
    v AS (SELECT item_id, n, coalesce(r, 0) * ln((SELECT count(*) FROM p) / coalesce(df, 1)) AS r, coalesce(h, 0) * ln((SELECT count(*) FROM p) / coalesce(df, 1)) AS h FROM cr FULL JOIN ch USING (item_id, n, g) LEFT JOIN df USING (n, g)),
    s AS (SELECT item_id, n, CASE WHEN sum(r * r) > 0 AND sum(h * h) > 0 THEN sum(r * h) / sqrt(sum(r * r)) / sqrt(sum(h * h)) ELSE 0 END AS c FROM v GROUP BY ALL)
    SELECT item_id, round(coalesce(sum(c) / 4, 0), 6)::DOUBLE AS cider FROM p LEFT JOIN s USING (item_id) GROUP BY 1""")
def cider(spark, sf):
    return textmetrics.cider(_pairs(spark, sf), "item_id", "text", "said")


TERMS = ["the", "license", "password", "and"]


@query("bm25_search", f"""WITH w AS (SELECT doc_id, {_words("text")} AS t FROM documents), r AS (SELECT doc_id, len(t) AS size, {", ".join(f"len(list_filter(t, lambda x: x = '{w}')) AS tf{i}" for i, w in enumerate(TERMS))} FROM w),
    f AS (SELECT count(*) AS docs, avg(size) AS mean, {", ".join(f"count(*) FILTER (tf{i} > 0) AS df{i}" for i in range(len(TERMS)))} FROM r)
    SELECT doc_id, round({" + ".join(f"ln(1 + (docs - df{i} + 0.5) / (df{i} + 0.5)) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * size / mean))" for i in range(len(TERMS)))}, 6) AS score
    FROM r, f WHERE {" OR ".join(f"tf{i} > 0" for i in range(len(TERMS)))} ORDER BY score DESC, doc_id LIMIT 20""")
def bm25_search(spark, sf):
    return textmetrics.search(t(spark, sf, "documents"), "doc_id", "text", TERMS, 20)


@query("jaccard_dups", f"""WITH w AS (SELECT min(doc_id) AS id, count(*) AS n, w FROM (SELECT doc_id, list_sort(list_distinct({_words("text")})) AS w FROM documents) WHERE len(w) > 0 GROUP BY w),
    p AS (SELECT a.id AS id_a, b.id AS id_b, a.n AS n_a, b.n AS n_b, len(list_intersect(a.w, b.w)) AS m, len(a.w) + len(b.w) AS s FROM w a JOIN w b ON a.id < b.id AND 100 * least(len(a.w), len(b.w)) >= 85 * greatest(len(a.w), len(b.w)))
    SELECT id_a, id_b, n_a, n_b, round(m / (s - m), 6) AS jaccard FROM p WHERE 100 * m >= 85 * (s - m)""")
def jaccard_dups(spark, sf):
    return textmetrics.jaccard_pairs(t(spark, sf, "documents"), "doc_id", "text", 85)


@query("language_clarity", rf"""WITH c AS (SELECT doc_id, len({_words("text")}) AS words, len(regexp_extract_all(coalesce(text, ''), '[.!?]')) AS sentences FROM documents)
    SELECT doc_id, words::INT AS words, sentences::INT AS sentences, round(CASE WHEN words = 0 THEN 0 ELSE 0.4 * least(1, words / 20.0) + 0.6 * (CASE WHEN sentences > 0 AND words / sentences BETWEEN 5 AND 30 THEN 1 ELSE 0.5 END) END, 6)::DOUBLE AS clarity FROM c""")
def language_clarity(spark, sf):
    words, ends = F.size(measures.tokens(F.col("text"))), F.size(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[.!?]"), F.lit(0)))
    rows = t(spark, sf, "documents").select("doc_id", words.alias("words"), ends.alias("sentences"))
    even = F.when((F.col("sentences") > 0) & (F.col("words") / F.col("sentences")).between(5, 30), 1.0).otherwise(0.5)
    return rows.withColumn("clarity", F.round(F.when(F.col("words") == 0, 0.0).otherwise(0.4 * F.least(F.lit(1.0), F.col("words") / 20) + 0.6 * even), 6))


# ---- personal data, names, checks


@query("pii_more", "SELECT doc_id, " + ", ".join(f"len(regexp_extract_all(coalesce(text, ''), '{p}')) AS {k}" for k, p in tx.MORE_PII.items()) + " FROM documents")
def pii_more(spark, sf):
    return t(spark, sf, "documents").select("doc_id", *(tx.count_of(F.col("text"), p).alias(k) for k, p in tx.MORE_PII.items()))


@query("anonymised_paths", r"SELECT page_id, regexp_replace(regexp_replace(url, '^(https?://)[^/]+', '\1[HOST]'), '[0-9]+', '#', 'g') AS path, substr(sha256(url), 1, 16) AS token FROM pages")
def anonymised_paths(spark, sf):
    path = F.regexp_replace(F.regexp_replace("url", "^(https?://)[^/]+", "$1[HOST]"), "[0-9]+", "#")
    return t(spark, sf, "pages").select("page_id", path.alias("path"), F.substring(F.sha2("url", 256), 1, 16).alias("token"))


@query("file_names", r"SELECT page_id, left(trim(regexp_replace(regexp_replace(url, '[^A-Za-z0-9._-]+', '_', 'g'), '[.]{2,}', '.', 'g'), '._'), 80) AS name FROM pages")
def file_names(spark, sf):
    return t(spark, sf, "pages").select("page_id", tx.file_name(F.col("url"), 80).alias("name"))


_XSS, _INJECTION = "(?i)<script|javascript:|onerror *=|onload *=", "(?i)union +select|drop +table|or +1 *= *1|;--"


@query("input_checks", f"SELECT page_id, regexp_matches(coalesce(html, ''), '{_XSS}') AS script, regexp_matches(coalesce(url, ''), '{_INJECTION}') AS injection, regexp_matches(coalesce(url, ''), '[.][.]/|^/etc|~') AS path FROM pages")
def input_checks(spark, sf):
    has = lambda c, p: F.coalesce(F.col(c), F.lit("")).rlike(p)
    return t(spark, sf, "pages").select("page_id", has("html", _XSS).alias("script"), has("url", _INJECTION).alias("injection"), has("url", "[.][.]/|^/etc|~").alias("path"))


# ---- exports


def _turns(spark, sf, then):
    """A record of each conversation from its turns in order."""
    turns = F.array_sort(F.collect_list(F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))))
    return t(spark, sf, "conversations").groupBy("conv_id").agg(turns.alias("t")).select("conv_id", F.to_json(then).alias("record"))


def _sql_turns(item: str, record: str) -> str:
    return f"WITH c AS (SELECT conv_id, list({item} ORDER BY turn, coalesce(role, ''), coalesce(text, '')) AS t FROM conversations GROUP BY 1) SELECT conv_id, to_json({record})::VARCHAR AS record FROM c"


_SQL_SPEAKER = "CASE WHEN coalesce(role, '') = 'assistant' THEN 'gpt' ELSE 'human' END"


@query("openai_export", _sql_turns("{'role': coalesce(role, ''), 'content': coalesce(text, '')}", "{'id': conv_id::VARCHAR, 'messages': t}"))
def openai_export(spark, sf):
    messages = F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content")))
    return _turns(spark, sf, F.struct(F.col("conv_id").cast("string").alias("id"), messages.alias("messages")))


@query("sharegpt_export", _sql_turns(f"{{'from': {_SQL_SPEAKER}, 'value': coalesce(text, '')}}", "{'id': conv_id::VARCHAR, 'conversations': t}"))
def sharegpt_export(spark, sf):
    said = F.transform("t", lambda x: F.struct(F.when(x["role"] == "assistant", "gpt").otherwise("human").alias("from"), x["text"].alias("value")))
    return _turns(spark, sf, F.struct(F.col("conv_id").cast("string").alias("id"), said.alias("conversations")))


@query("llava_records", _sql_turns(f"{{'from': {_SQL_SPEAKER}, 'value': CASE WHEN coalesce(role, '') = 'assistant' THEN coalesce(text, '') ELSE '<video>' || chr(10) || coalesce(text, '') END}}", "{'id': conv_id::VARCHAR, 'video': 'videos/' || conv_id || '.mp4', 'conversations': t}"))
def llava_records(spark, sf):
    bot = lambda x: x["role"] == "assistant"
    said = F.transform("t", lambda x: F.struct(F.when(bot(x), "gpt").otherwise("human").alias("from"), F.when(bot(x), x["text"]).otherwise(F.concat(F.lit("<video>\n"), x["text"])).alias("value")))
    video = F.concat(F.lit("videos/"), F.col("conv_id").cast("string"), F.lit(".mp4"))
    return _turns(spark, sf, F.struct(F.col("conv_id").cast("string").alias("id"), video.alias("video"), said.alias("conversations")))


@query("rlds_steps", """SELECT conv_id, turn, row_number() OVER w - 1 AS step, row_number() OVER w = 1 AS is_first, lead(turn) OVER w IS NULL AS is_last, 0.0::DOUBLE AS reward, CASE WHEN lead(turn) OVER w IS NULL THEN 0.0 ELSE 1.0 END::DOUBLE AS discount,
    coalesce(text, '') AS observation, lead(coalesce(text, '')) OVER w AS next_observation FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, coalesce(role, ''), coalesce(text, ''))""")
def rlds_steps(spark, sf):
    text = F.coalesce("text", F.lit(""))
    w = Window.partitionBy("conv_id").orderBy("turn", F.coalesce("role", F.lit("")), text)
    last = F.lead("turn").over(w).isNull()
    n = F.row_number().over(w)
    rows = t(spark, sf, "conversations")
    return rows.select("conv_id", "turn", (n - 1).cast("long").alias("step"), (n == 1).alias("is_first"), last.alias("is_last"), F.lit(0.0).alias("reward"), F.when(last, 0.0).otherwise(1.0).alias("discount"), text.alias("observation"), F.lead(text).over(w).alias("next_observation"))


# ---- walks


@query("lineage_ancestors", """WITH RECURSIVE w AS (SELECT doc_id AS start, doc_id AS node, 0 AS depth FROM documents WHERE doc_id % 50 = 0 UNION ALL
    SELECT start, doc_id // 2, depth + 1 FROM w JOIN documents ON doc_id = node WHERE doc_id > 0) SELECT start, node, depth FROM w""")
def lineage_ancestors(spark, sf):
    docs = t(spark, sf, "documents").select("doc_id")
    edges = docs.where("doc_id > 0").select(F.col("doc_id").alias("src"), F.floor(F.col("doc_id") / 2).alias("dst"))
    return graphs.walk(edges, docs.where("doc_id % 50 = 0").withColumnRenamed("doc_id", "start"))


def _causes(spark, sf):
    """An event causes the user's next one if that comes within four hours."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = t(spark, sf, "events").select(F.col("event_id").alias("src"), F.lead("event_id").over(w).alias("dst"), (F.lead(at).over(w) - at).alias("gap"))
    return rows.where("gap <= 14400000000").select("src", "dst")


@query("causal_chain", """WITH RECURSIVE e AS (SELECT src, dst FROM (SELECT event_id AS src, lead(event_id) OVER w AS dst, epoch_us(lead(ts) OVER w) - epoch_us(ts) AS gap FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE gap <= 14400000000),
    c AS (SELECT event_id AS start, event_id AS node, 0 AS depth FROM events WHERE event_id % 50 = 0 UNION ALL SELECT start, dst, depth + 1 FROM c JOIN e ON src = node) SELECT start, node, depth FROM c""")
def causal_chain(spark, sf):
    return graphs.walk(_causes(spark, sf), t(spark, sf, "events").where("event_id % 50 = 0").select(F.col("event_id").alias("start")))


@query("next_state", """WITH s AS (SELECT event_type AS state, lead(event_type) OVER w AS next, ts, event_id FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    c AS (SELECT state, next, count(*) AS n, min((ts, event_id)) AS seen FROM s WHERE next IS NOT NULL GROUP BY ALL)
    SELECT state, next, n FROM (SELECT *, row_number() OVER (PARTITION BY state ORDER BY n DESC, seen) AS place FROM c) WHERE place = 1""")
def next_state(spark, sf):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    steps = t(spark, sf, "events").select(F.col("event_type").alias("state"), F.lead("event_type").over(w).alias("next"), "ts", "event_id").where("next is not null")
    counts = steps.groupBy("state", "next").agg(F.count("*").alias("n"), F.min(F.struct("ts", "event_id")).alias("seen"))
    place = F.row_number().over(Window.partitionBy("state").orderBy(F.desc("n"), "seen"))
    return counts.withColumn("place", place).where("place = 1").select("state", "next", "n")


@query("events_at", "SELECT event_id, user_id FROM events WHERE ts <= TIMESTAMP '2024-01-10 12:00:00' AND ts + INTERVAL 1 MINUTE * floor(value)::INT >= TIMESTAMP '2024-01-10 12:00:00'")
def events_at(spark, sf):
    at = F.lit("2024-01-10 12:00:00").cast("timestamp_ntz")
    end = F.col("ts") + F.make_dt_interval(mins=F.floor("value").cast("int"))
    return t(spark, sf, "events").where((F.col("ts") <= at) & (end >= at)).select("event_id", "user_id")


# ---- frontiers, prices, routing

_SQL_FRONT = "f AS (SELECT p_size AS c, max(p_retailprice) AS q FROM part GROUP BY 1), o AS (SELECT c, q, max(q) OVER (ORDER BY c ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM f), front AS (SELECT c, q FROM o WHERE best IS NULL OR q > best)"


def _front(spark, sf):
    points = t(spark, sf, "part").groupBy(F.col("p_size").alias("c")).agg(F.max("p_retailprice").alias("q"))  # at most one a size
    best = F.max("q").over(Window.orderBy("c").rowsBetween(Window.unboundedPreceding, -1))
    return points.withColumn("best", best).where("best is null or q > best").select("c", "q")


@query("pareto_area", f"WITH {_SQL_FRONT} SELECT round(coalesce(sum((c2 - c) * (q2 + q) / 2), 0), 6)::DOUBLE AS area FROM (SELECT c, q, lead(c) OVER (ORDER BY c, q) AS c2, lead(q) OVER (ORDER BY c, q) AS q2 FROM front)")
def pareto_area(spark, sf):
    return summaries.pareto_area(_front(spark, sf), "c", "q")


@query("tradeoff_slopes", f"WITH {_SQL_FRONT} SELECT c, q, round((q - lag(q) OVER (ORDER BY c)) / nullif(c - lag(c) OVER (ORDER BY c), 0), 6) AS slope, round(q / nullif(c, 0), 6) AS efficiency FROM front")
def tradeoff_slopes(spark, sf):
    w = Window.orderBy("c")
    slope = (F.col("q") - F.lag("q").over(w)) / F.nullif(F.col("c") - F.lag("c").over(w), F.lit(0))
    return _front(spark, sf).select("c", "q", F.round(slope, 6).alias("slope"), F.round(F.col("q") / F.nullif("c", F.lit(0)), 6).alias("efficiency"))


@query("best_for_budget", "SELECT p_brand, arg_max(p_partkey, (p_retailprice, -p_partkey)) AS best, arg_min(p_partkey, (p_size, p_partkey)) FILTER (p_retailprice >= 1200) AS cheapest FROM part WHERE p_size <= 20 GROUP BY 1")
def best_for_budget(spark, sf):
    rows = t(spark, sf, "part").where("p_size <= 20").groupBy("p_brand")
    return rows.agg(F.max(F.struct("p_retailprice", -F.col("p_partkey"))).alias("b"), F.min(F.when(F.col("p_retailprice") >= 1200, F.struct("p_size", "p_partkey"))).alias("c")).select("p_brand", (-F.col("b.col2")).alias("best"), F.col("c.p_partkey").alias("cheapest"))


@query("usage_costs", """SELECT l_orderkey, l_linenumber, c AS nanos, c // 2 AS batch_nanos FROM (SELECT l_orderkey, l_linenumber, round(l_quantity * 3000000)::BIGINT + round(l_extendedprice * 15000)::BIGINT + l_linenumber * 1000000 AS c FROM lineitem)""")
def usage_costs(spark, sf):
    """What each line costs by its input, output and image prices, in billionths, and half of it in a batch."""
    cost = F.round(F.col("l_quantity") * 3000000).cast("long") + F.round(F.col("l_extendedprice") * 15000).cast("long") + F.col("l_linenumber") * 1000000
    return t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", cost.alias("nanos"), F.floor(cost / 2).alias("batch_nanos"))


_SQL_HARD = "(least(1, n_chars / 6000.0) + least(1, len(string_split(coalesce(text, ''), chr(10))) / 10.0)) / 2"


@query("route_balanced", f"SELECT CASE WHEN h < 0.3 THEN 'local' WHEN h < 0.6 THEN 'middle' ELSE 'top' END AS route, count(*) AS n, round(avg(h), 6) AS complexity FROM (SELECT {_SQL_HARD} AS h FROM documents WHERE n_chars IS NOT NULL) GROUP BY 1")
def route_balanced(spark, sf):
    lines = F.size(F.split(F.coalesce("text", F.lit("")), "\n", -1))
    hard = (F.least(F.lit(1.0), F.col("n_chars") / 6000) + F.least(F.lit(1.0), lines / 10)) / 2
    route = F.when(F.col("h") < 0.3, "local").when(F.col("h") < 0.6, "middle").otherwise("top")
    return t(spark, sf, "documents").where("n_chars is not null").select(hard.alias("h")).groupBy(route.alias("route")).agg(F.count("*").alias("n"), F.round(F.avg("h"), 6).alias("complexity"))


@query("review_priority", "SELECT CASE WHEN s < 0.3 THEN 'critical' WHEN s < 0.5 THEN 'high' WHEN s < 0.7 THEN 'medium' ELSE 'low' END AS priority, count(*) AS n FROM (SELECT l_discount * 10 AS s FROM lineitem) GROUP BY 1")
def review_priority(spark, sf):
    level = F.when(F.col("s") < 0.3, "critical").when(F.col("s") < 0.5, "high").when(F.col("s") < 0.7, "medium").otherwise("low")
    return t(spark, sf, "lineitem").select((F.col("l_discount") * 10).alias("s")).groupBy(level.alias("priority")).agg(F.count("*").alias("n"))


@query("gate_eval", """WITH d AS (SELECT doc_id, coalesce(quality, 0)::DOUBLE AS quality, 1 - coalesce(toxic, 1)::DOUBLE AS safety, least(1, n_chars / 1000.0)::DOUBLE AS size FROM documents LEFT JOIN labels USING (doc_id))
    SELECT doc_id, quality >= 0.5 AND safety >= 0.5 AND size >= 0.2 AS passed, round(0.4 * quality + 0.4 * safety + 0.2 * size, 6) AS score,
    concat_ws(',', CASE WHEN quality < 0.5 THEN 'quality' END, CASE WHEN safety < 0.5 THEN 'safety' END, CASE WHEN coalesce(size, 0) < 0.2 THEN 'size' END) AS failures FROM d""")
def gate_eval(spark, sf):
    rows = t(spark, sf, "documents").select("doc_id", "n_chars").join(t(spark, sf, "labels"), "doc_id", "left")
    dims = rows.select("doc_id", F.coalesce("quality", F.lit(0)).cast("double").alias("quality"), (1 - F.coalesce("toxic", F.lit(1)).cast("double")).alias("safety"), F.least(F.lit(1.0), F.col("n_chars") / 1000).alias("size"))
    least = {"quality": 0.5, "safety": 0.5, "size": 0.2}
    passed = (F.col("quality") >= 0.5) & (F.col("safety") >= 0.5) & (F.col("size") >= 0.2)
    failures = F.concat_ws(",", *(F.when(F.coalesce(k, F.lit(0.0)) < v, k) for k, v in least.items()))
    return dims.select("doc_id", passed.alias("passed"), F.round(0.4 * F.col("quality") + 0.4 * F.col("safety") + 0.2 * F.col("size"), 6).alias("score"), failures.alias("failures"))


# ---- versions


@query("latest_versions", "SELECT o_custkey, count(*) AS versions, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey, max(o_orderdate) AS o_orderdate, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS o_orderstatus FROM orders GROUP BY 1")
def latest_versions(spark, sf):
    return summaries.latest(t(spark, sf, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"], ["o_orderkey", "o_orderdate", "o_orderstatus"])


@query("version_list", "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)::INT AS version FROM orders")
def version_list(spark, sf):
    return summaries.versions(t(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), "o_custkey", ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "version")


@query("restore_as_of", "SELECT o_custkey, count(*) AS versions, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey, max(o_orderdate) AS o_orderdate FROM orders WHERE o_orderdate <= TIMESTAMP '1996-06-30' GROUP BY 1")
def restore_as_of(spark, sf):
    rows = t(spark, sf, "orders").where(F.col("o_orderdate") <= F.lit("1996-06-30").cast("timestamp_ntz"))
    return summaries.latest(rows, "o_custkey", ["o_orderdate", "o_orderkey"], ["o_orderkey", "o_orderdate"])


@query("upsert_rows", "SELECT p_partkey, p_brand, CASE WHEN p_size > 40 THEN p_retailprice * 2 ELSE p_retailprice END AS p_retailprice FROM part UNION ALL SELECT s_suppkey + 1000000000, 'new', s_acctbal FROM supplier")
def upsert_rows(spark, sf):
    part = t(spark, sf, "part")
    rows = part.select("p_partkey", "p_brand", "p_retailprice")
    changed = part.where("p_size > 40").select("p_partkey", "p_brand", (F.col("p_retailprice") * 2).alias("p_retailprice"))
    new = t(spark, sf, "supplier").select((F.col("s_suppkey") + 1000000000).alias("p_partkey"), F.lit("new").alias("p_brand"), F.col("s_acctbal").alias("p_retailprice"))
    return summaries.upsert(rows, changed.unionByName(new), "p_partkey")


@query("record_ages", "SELECT o_orderpriority, count(*) AS n, round(avg(date_diff('day', o_orderdate::DATE, DATE '2000-01-01')), 6) AS mean_days, count(*) FILTER (o_orderstatus = 'O' AND date_diff('day', o_orderdate::DATE, DATE '2000-01-01') > 1500) AS overdue FROM orders GROUP BY 1")
def record_ages(spark, sf):
    age = F.date_diff(F.lit("2000-01-01").cast("date"), F.to_date("o_orderdate"))
    return t(spark, sf, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.round(F.avg(age), 6).alias("mean_days"), F.count_if((F.col("o_orderstatus") == "O") & (age > 1500)).alias("overdue"))
