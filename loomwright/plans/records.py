"""Registered queries: paths, forces, contacts, nested records, differences, votes, parsed outputs, hashed features."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomwright.functions import hashes, parsing
from loomwright.operators import motion, records
from loomwright.plans.catalog import query, t

# ---- paths, forces, contacts

_SQL_POINTS = "SELECT event_id, user_id, ts, epoch_us(ts) / 1e6 AS sec, value AS x, (event_id % 17)::DOUBLE AS y FROM events WHERE value IS NOT NULL"


def _points(spark, sf):
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return t(spark, sf, "events").where("value is not null").select("event_id", "user_id", "ts", at.alias("at"), F.col("value").alias("x"), (F.col("event_id") % 17).cast("double").alias("y"))


@query("trajectory_length", f"""WITH p AS ({_SQL_POINTS}), s AS (SELECT *, sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2) AS step FROM p WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
    SELECT user_id, count(*) AS points, round(coalesce(sum(step), 0), 4) AS length, round(sqrt((arg_min(x, (ts, event_id)) - arg_max(x, (ts, event_id))) ** 2 + (arg_min(y, (ts, event_id)) - arg_max(y, (ts, event_id))) ** 2), 4) AS direct FROM s GROUP BY 1""")
def trajectory_length(spark, sf):
    return motion.path_length(_points(spark, sf), "user_id", ["ts", "event_id"], ["x", "y"])


TIMES = [1704067200.0, 1704888000.0, 1705708800.0, 1706500000.0, 1707000000.0]


@query("trajectory_at", f"""WITH p AS ({_SQL_POINTS}), q AS (SELECT unnest({TIMES})::DOUBLE AS t),
    n AS (SELECT user_id, t, arg_max(x, (sec, event_id)) FILTER (sec <= t) AS xa, arg_min(x, (sec, event_id)) FILTER (sec > t) AS xb, max(sec) FILTER (sec <= t) AS ta, min(sec) FILTER (sec > t) AS tb FROM p, q GROUP BY ALL)
    SELECT user_id, t AS "at", round(coalesce(xa + (xb - xa) * ((t - ta) / (tb - ta)), xa, xb), 6) AS value FROM n""")
def trajectory_at(spark, sf):
    return motion.points_at(_points(spark, sf), "user_id", "at", "event_id", "x", TIMES)


@query("motion_errors", f"""WITH p AS ({_SQL_POINTS}), s AS (SELECT *, 2 * lag(x, 1) OVER w - lag(x, 2) OVER w AS px, 2 * lag(y, 1) OVER w - lag(y, 2) OVER w AS py FROM p WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    d AS (SELECT *, sqrt((x - px) ** 2 + (y - py) ** 2) AS gap FROM s WHERE px IS NOT NULL)
    SELECT user_id, count(*) AS n, round(avg(gap), 4) AS ade, round(arg_max(gap, (ts, event_id)), 4) AS fde, round(avg(gap * gap), 4) AS mse, round(sqrt(avg(gap * gap)), 4) AS rmse FROM d GROUP BY 1""")
def motion_errors(spark, sf):
    """A point is foretold from the two before it at constant speed."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    said = {f"p{c}": 2 * F.lag(c, 1).over(w) - F.lag(c, 2).over(w) for c in ("x", "y")}
    return motion.displacement(_points(spark, sf).withColumns(said), "user_id", ["ts", "event_id"], ["x", "y"], ["px", "py"])


@query("force_totals", """SELECT l_orderkey, round(coalesce(sum(l_quantity * s), 0), 7) AS impulse_0, round(coalesce(sum(l_discount * s), 0), 7) AS impulse_1, round(coalesce(sum(l_tax * s), 0), 7) AS impulse_2, round(max(sqrt(l_quantity ** 2 + l_discount ** 2 + l_tax ** 2)), 6) AS peak, round(coalesce(sum(s), 0), 7) AS contact
    FROM (SELECT *, CASE WHEN l_linestatus = 'O' THEN l_extendedprice / 1000 END AS s FROM lineitem) GROUP BY 1""")
def force_totals(spark, sf):
    rows = t(spark, sf, "lineitem").withColumn("s", F.when(F.col("l_linestatus") == "O", F.col("l_extendedprice") / 1000))
    return motion.forces(rows, "l_orderkey", ["l_quantity", "l_discount", "l_tax"], "s")


@query("contact_scores", f"""WITH p AS ({_SQL_POINTS}), e AS (SELECT p.event_id, p.user_id, p.sec, event_type FROM p JOIN events USING (event_id)), a AS (SELECT * FROM e WHERE event_id % 2 = 0), b AS (SELECT * FROM e WHERE event_id % 2 = 1),
    x AS (SELECT count(*) AS said, count(*) FILTER (EXISTS (SELECT 1 FROM b WHERE b.user_id = a.user_id AND b.event_type = a.event_type AND abs(a.sec - b.sec) <= 3600)) AS hit FROM a),
    y AS (SELECT count(*) AS real, count(*) FILTER (EXISTS (SELECT 1 FROM a WHERE b.user_id = a.user_id AND b.event_type = a.event_type AND abs(a.sec - b.sec) <= 3600)) AS found FROM b)
    SELECT said, hit AS "right", real, found, round(hit / said, 6) AS precision, round(found / real, 6) AS recall, round(coalesce(2 * (hit / said) * (found / real) / nullif(hit / said + found / real, 0), 0), 6) AS f1 FROM x, y""")
def contact_scores(spark, sf):
    rows = t(spark, sf, "events").where("value is not null").select("event_id", "user_id", "event_type", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"))
    return motion.contact_scores(rows.where("event_id % 2 = 1"), rows.where("event_id % 2 = 0"), ["user_id", "event_type"], "at", 3600.0)


@query("scene_boundaries", """WITH s AS (SELECT user_id, event_id, ts, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 6) AS smooth FROM events WHERE value IS NOT NULL),
    p AS (SELECT *, smooth > lag(smooth) OVER w AND smooth > lead(smooth) OVER w AS peak FROM s WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    r AS (SELECT user_id, event_id, smooth, row_number() OVER (PARTITION BY user_id ORDER BY smooth DESC, ts, event_id)::INT AS place FROM p WHERE peak) SELECT * FROM r WHERE place <= 4""")
def scene_boundaries(spark, sf):
    rows = t(spark, sf, "events").where("value is not null").select("user_id", "event_id", "ts", "value")
    return motion.boundaries(rows, "user_id", ["ts", "event_id"], "value", 4).select("user_id", "event_id", "smooth", "place")


@query("pose_errors", """WITH p AS (SELECT a.label, sqrt(list_sum(list_transform(range(1, 4), lambda i: (a.embedding[i]::DOUBLE - b.embedding[i]) ** 2))) AS pos, sqrt(list_sum(list_transform(range(4, 7), lambda i: (a.embedding[i]::DOUBLE - b.embedding[i]) ** 2))) AS rot
    FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 WHERE len(a.embedding) >= 6 AND len(b.embedding) >= 6)
    SELECT label, count(*) AS n, round(avg(pos), 6) AS position, round(stddev_pop(pos), 6) AS position_sd, round(avg(rot), 6) AS rotation, round(stddev_pop(rot), 6) AS rotation_sd FROM p GROUP BY 1""")
def pose_errors(spark, sf):
    """Position (first three) and rotation (next three) of each vector against the one after it; those of under six parts are left out."""
    rows = t(spark, sf, "embeddings").where(F.size("embedding") >= 6).select("vec_id", "label", F.slice(F.col("embedding").cast("array<double>"), 1, 6).alias("e"))
    pairs = rows.join(rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("e").alias("f")), "vec_id")
    apart = lambda at: motion.distance([F.col("e")[i] for i in at], [F.col("f")[i] for i in at])
    found = pairs.select("label", apart(range(3)).alias("pos"), apart(range(3, 6)).alias("rot"))
    return found.groupBy("label").agg(F.count("*").alias("n"), *(F.round(f(c), 6).alias(n) for f, c, n in ((F.avg, "pos", "position"), (F.stddev_pop, "pos", "position_sd"), (F.avg, "rot", "rotation"), (F.stddev_pop, "rot", "rotation_sd"))))


# ---- nested records


def _orders(spark, sf):
    """A record of each order with its lines in an array."""
    line = F.struct("l_linenumber", F.col("l_returnflag").alias("kind"), F.col("l_linestatus").alias("validity"), F.array("l_partkey", "l_suppkey").alias("alternatives"), F.col("l_quantity").alias("size"))
    return t(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("lines"))


@query("counterfactuals", """SELECT l_orderkey, count(*) FILTER (l_linestatus = 'O')::INT AS valid, count(*) FILTER (l_returnflag = 'R')::INT AS returned, coalesce(string_agg(l_partkey || ',' || l_suppkey, ',' ORDER BY l_linenumber, l_linestatus, l_partkey, l_suppkey) FILTER (l_returnflag = 'A'), '') AS alternatives FROM lineitem GROUP BY 1""")
def counterfactuals(spark, sf):
    lines = F.col("lines")
    others = records.inner(records.of_kind(lines, "kind", ["A"]), "alternatives")
    return _orders(spark, sf).select("l_orderkey", F.size(records.of_kind(lines, "validity", ["O"])).alias("valid"), F.size(records.of_kind(lines, "kind", ["R"])).alias("returned"), F.array_join(others, ",").alias("alternatives"))


@query("primary_regions", """SELECT l_orderkey, arg_min(l_linenumber, (-l_quantity, l_linenumber)) AS region, max(l_quantity) AS area, count(*) FILTER (l_returnflag = 'N') > 0 AS graspable FROM lineitem GROUP BY 1""")
def primary_regions(spark, sf):
    rows = _orders(spark, sf).select("l_orderkey", records.largest(F.col("lines"), "size").alias("r"), F.exists("lines", lambda x: x["kind"] == "N").alias("graspable"))
    return rows.select("l_orderkey", F.col("r.l_linenumber").alias("region"), F.col("r.size").alias("area"), "graspable")


@query("counterfactual_summary", "SELECT l_returnflag AS kind, count(*) AS n, count(*) FILTER (l_linestatus = 'O') AS valid, count(*) FILTER (l_linestatus = 'F') AS invalid FROM lineitem GROUP BY 1")
def counterfactual_summary(spark, sf):
    lines = _orders(spark, sf).select(F.explode("lines").alias("x")).select("x.*")
    return lines.groupBy("kind").agg(F.count("*").alias("n"), F.count_if(F.col("validity") == "O").alias("valid"), F.count_if(F.col("validity") == "F").alias("invalid"))


@query("segment_diff", """WITH a AS (SELECT conv_id, turn, text FROM conversations), b AS (SELECT conv_id - 1 AS conv_id, turn, text FROM conversations)
    SELECT conv_id, count(*) FILTER (ia IS NULL) AS added, count(*) FILTER (ib IS NULL) AS removed, count(*) FILTER (ia AND ib AND ta IS DISTINCT FROM tb) AS modified, count(*) FILTER (ia AND ib AND ta IS NOT DISTINCT FROM tb) AS unchanged
    FROM (SELECT conv_id, turn, text AS ta, true AS ia FROM a) FULL JOIN (SELECT conv_id, turn, text AS tb, true AS ib FROM b) USING (conv_id, turn) GROUP BY 1""")
def segment_diff(spark, sf):
    rows = t(spark, sf, "conversations").select("conv_id", "turn", "text")
    return records.by_position(rows, rows.withColumn("conv_id", F.col("conv_id") - 1), "conv_id", "turn", "text")


@query("integrity_check", """WITH s AS (SELECT doc_id, md5(text) AS d FROM documents WHERE doc_id % 10 <> 0), i AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'old' ELSE md5(text) END AS d FROM documents WHERE doc_id % 11 <> 0)
    SELECT doc_id, CASE WHEN i.doc_id IS NULL THEN 'not indexed' WHEN s.doc_id IS NULL THEN 'not stored' ELSE 'differs' END AS problem FROM s FULL JOIN i USING (doc_id) WHERE i.doc_id IS NULL OR s.doc_id IS NULL OR s.d IS DISTINCT FROM i.d""")
def integrity_check(spark, sf):
    """A store without every tenth text against an index without every eleventh, in which every seventh digest is outdated."""
    rows = t(spark, sf, "documents").select("doc_id", F.md5("text").alias("d"))
    index = rows.where("doc_id % 11 <> 0").withColumn("d", F.when(F.col("doc_id") % 7 == 0, "old").otherwise(F.col("d")))
    return records.integrity(rows.where("doc_id % 10 <> 0"), index, "doc_id", "d")


@query("majority_vote", """WITH v AS (SELECT l_orderkey, l_returnflag AS vote, count(*) AS n, min(l_linenumber) AS first, round(coalesce(sum(l_discount), 0), 6) AS w FROM lineitem WHERE l_returnflag IS NOT NULL GROUP BY ALL)
    SELECT l_orderkey, sum(n)::BIGINT AS votes, arg_min(vote, (-n, first, vote)) AS winner, round(max(n) / sum(n), 6) AS share, arg_min(vote, (-w, first, vote)) AS weighted FROM v GROUP BY 1""")
def majority_vote(spark, sf):
    return records.majority(t(spark, sf, "lineitem"), "l_orderkey", "l_linenumber", "l_returnflag", "l_discount")


@query("duplicate_frames", "SELECT doc_id, source FROM documents WHERE source <> 'src2' AND md5(text) IN (SELECT md5(text) FROM documents WHERE source = 'src2' AND text IS NOT NULL)")
def duplicate_frames(spark, sf):
    rows = t(spark, sf, "documents").select("doc_id", "source", F.md5("text").alias("digest"))
    return records.elsewhere(rows, "digest", "source", "src2").select("doc_id", "source")


# ---- digests, hashed features, hidden characters, names


@query("hash_distances", """WITH d AS (SELECT doc_id, substr(md5(coalesce(text, '')), 1, 8) AS h FROM documents), p AS (SELECT a.doc_id, a.h AS a, b.h AS b, ('0x' || a.h)::BIGINT AS x, ('0x' || b.h)::BIGINT AS y FROM d a JOIN d b ON b.doc_id = a.doc_id + 1)
    SELECT doc_id, hamming(a, b)::INT AS digits, bit_count(xor(x, y))::INT AS bits, round(1 - bit_count(xor(x, y)) / 32.0, 6)::DOUBLE AS similarity FROM p""")
def hash_distances(spark, sf):
    rows = t(spark, sf, "documents").select("doc_id", F.substring(F.md5(F.coalesce("text", F.lit(""))), 1, 8).alias("a"))
    pairs = rows.join(rows.select((F.col("doc_id") - 1).alias("doc_id"), F.col("a").alias("b")), "doc_id")
    bits = hashes.bits_apart(F.col("a"), F.col("b"))
    return pairs.select("doc_id", hashes.digits_apart(F.col("a"), F.col("b")).alias("digits"), bits.alias("bits"), F.round(1 - bits / 32, 6).alias("similarity"))


_SQL_TRIGRAMS = """g AS (SELECT item_id, unnest(list_transform(range(1, greatest(1, length(t) - 1)), lambda i: substr(t, i, 3))) AS g FROM (SELECT item_id, lower(coalesce(text, '')) AS t FROM benchmark)),
    c AS (SELECT item_id, ('0x' || substr(md5(g), 27, 6))::BIGINT % 64 AS dim, count(*) AS n FROM g GROUP BY ALL), v AS (SELECT item_id, dim, n / sqrt(sum(n * n) OVER (PARTITION BY item_id)) AS value FROM c)"""


@query("trigram_embed", f"WITH {_SQL_TRIGRAMS} SELECT item_id, dim::INT AS dim, round(value, 6) AS value FROM v")
def trigram_embed(spark, sf):
    return hashes.trigram_features(t(spark, sf, "benchmark"), "item_id", "text").select("item_id", "dim", F.round("value", 6).alias("value"))


@query("example_search", f"""WITH {_SQL_TRIGRAMS}, s AS (SELECT q.item_id AS query, r.item_id AS found, round(sum(q.value * r.value), 6) AS score FROM v q JOIN v r ON q.dim = r.dim AND q.item_id <> r.item_id WHERE q.item_id % 50 = 0 GROUP BY ALL)
    SELECT query, found, score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, found) AS place FROM s) WHERE place <= 5""")
def example_search(spark, sf):
    """The five items whose trigrams are nearest to those of each query (ids divisible by 50)."""
    rows = hashes.trigram_features(t(spark, sf, "benchmark"), "item_id", "text")
    asked = rows.where("item_id % 50 = 0").select(F.col("item_id").alias("query"), "dim", F.col("value").alias("q"))
    met = rows.join(asked, "dim").where("item_id <> query")
    scores = met.groupBy("query", F.col("item_id").alias("found")).agg(F.round(F.sum(F.col("q") * F.col("value")), 6).alias("score"))
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "found"))
    return scores.withColumn("place", place).where("place <= 5").drop("place")


@query("hashed_names", "SELECT doc_id, substr(sha256('pepper:' || doc_id), 1, 16) AS token, 'h_' || substr(sha256('pepper:' || source), 1, 12) AS owner FROM documents")
def hashed_names(spark, sf):
    return t(spark, sf, "documents").select("doc_id", hashes.token(F.col("doc_id"), "pepper").alias("token"), F.concat(F.lit("h_"), hashes.token(F.col("source"), "pepper", 12)).alias("owner"))


@query("hidden_marks", r"SELECT doc_id, regexp_matches(text, '[\x{200b}\x{200c}\x{200d}\x{feff}]') AS marked, length(regexp_replace(text, '[\x{200b}\x{200c}\x{200d}\x{feff}]', '', 'g'))::INT AS n_chars FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN chr(8203) || text || chr(8205) ELSE text END AS text FROM documents)")
def hidden_marks(spark, sf):
    """Whether texts hold zero-width marks, and their length without; every third text is marked first."""
    marked = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("\u200b"), "text", F.lit("\u200d"))).otherwise(F.col("text"))
    return t(spark, sf, "documents").select("doc_id", marked.alias("text")).select("doc_id", F.col("text").rlike(hashes.HIDDEN).alias("marked"), F.length(hashes.without_hidden(F.col("text"))).alias("n_chars"))


@query("id_checks", r"SELECT page_id, coalesce(length(url) BETWEEN 3 AND 256 AND regexp_matches(url, '^[A-Za-z0-9_.:/-]+$') AND NOT contains(url, '..'), false) AS valid FROM pages")
def id_checks(spark, sf):
    url = F.col("url")
    fine = F.length(url).between(3, 256) & url.rlike("^[A-Za-z0-9_.:/-]+$") & ~F.contains(url, F.lit(".."))
    return t(spark, sf, "pages").select("page_id", F.coalesce(fine, F.lit(False)).alias("valid"))


# ---- parsed outputs

_FENCED = """{"scene_description": "%s", "objects": ["cup", {"name": "%s"}, {"state": "x"}], "steps": [{"action": "take", "details": "it"}], "actions": [{"verb": "move", "noun": "%s"}]}"""
_SQL_OUTPUTS = f"""SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'Result:' || chr(10) || '```json' || chr(10) || format('{_FENCED.replace("{", "{{").replace("}", "}}").replace("%s", "{}")}', user_id::VARCHAR, event_type, event_type) || chr(10) || '```'
    WHEN 1 THEN 'Scene: user ' || user_id || chr(10) || 'Actions:' || chr(10) || '- open the ' || event_type || chr(10) || '2. wait' || chr(10) || 'Objects: cup, - ' || event_type || ' '
    WHEN 2 THEN 'so {{"caption": "' || event_type || '"}} it is' WHEN 3 THEN 'broken {{"a": ' WHEN 4 THEN event_type END AS text FROM events""".replace("so {{", "so {").replace('"}} it', '"} it').replace("broken {{", "broken {")


def _outputs(spark, sf):
    user, kind, line = F.col("user_id").cast("string"), F.col("event_type"), F.lit("\n")
    fenced = F.concat(F.lit("Result:\n```json\n"), F.format_string(_FENCED, user, kind, kind), F.lit("\n```"))
    sections = F.concat(F.lit("Scene: user "), user, F.lit("\nActions:\n- open the "), kind, line, F.lit("2. wait\nObjects: cup, - "), kind, F.lit(" "))
    text = F.when(F.col("event_id") % 6 == 0, fenced).when(F.col("event_id") % 6 == 1, sections).when(F.col("event_id") % 6 == 2, F.concat(F.lit('so {"caption": "'), kind, F.lit('"} it is')))
    return t(spark, sf, "events").select("event_id", text.when(F.col("event_id") % 6 == 3, 'broken {"a": ').when(F.col("event_id") % 6 == 4, kind).alias("text"))


# lines with the section that the last heading opened, and a document between the fence or the outermost braces
_ITEM = "trim(trim({0}), '- *1234567890. ')"
_SQL_PARSED = rf"""o AS ({_SQL_OUTPUTS}), f AS (SELECT event_id, coalesce(text, '') AS x, string_split(coalesce(text, ''), '```') AS cut FROM o),
    j AS (SELECT *, CASE WHEN len(cut) >= 3 THEN regexp_replace(cut[2], '^json', '') WHEN contains(x, '{{') AND contains(x, '}}') THEN x[strpos(x, '{{'):len(x) - strpos(reverse(x), '}}') + 1] ELSE '' END AS part FROM f),
    l AS (SELECT event_id, i, line, lower(split_part(ltrim(line), ':', 1)) AS head FROM (SELECT event_id, unnest(string_split(x, chr(10))) AS line, generate_subscripts(string_split(x, chr(10)), 1) AS i FROM f)),
    m AS (SELECT *, last_value(CASE WHEN contains(line, ':') AND head IN ('scene', 'actions', 'objects') THEN head END IGNORE NULLS) OVER (PARTITION BY event_id ORDER BY i) AS part FROM l),
    t AS (SELECT event_id, part, trim(string_agg(CASE WHEN head = part THEN substr(ltrim(line), len(head) + 2) ELSE line END, chr(10) ORDER BY i), ' ' || chr(10)) AS said FROM m WHERE part IS NOT NULL GROUP BY ALL),
    u AS (SELECT event_id, max(said) FILTER (part = 'scene') AS scene, max(said) FILTER (part = 'actions') AS acts, max(said) FILTER (part = 'objects') AS objs FROM t GROUP BY 1),
    k AS (SELECT j.*, scene, acts, objs, CASE WHEN trim(x) = '' THEN 'empty_input' WHEN json_valid(j.part) AND j.part <> '' THEN 'json_block' WHEN scene IS NOT NULL OR acts IS NOT NULL OR objs IS NOT NULL THEN 'structured_text' ELSE 'plain_text' END AS method FROM j LEFT JOIN u USING (event_id)),
    r AS (SELECT *, CASE WHEN method = 'json_block' THEN part::JSON END AS d, list_filter(list_transform(string_split(coalesce(objs, ''), ',')[:10], lambda y: {_ITEM.format("y")}), lambda y: y <> '') AS things,
        list_transform(list_filter(list_transform(string_split(coalesce(acts, ''), chr(10))[:10], lambda y: {_ITEM.format("y")}), lambda y: y <> ''), lambda y: string_split(y, ' ')) AS said FROM k),
    s AS (SELECT event_id, x, method, d, scene, CASE method WHEN 'json_block' THEN list_transform(coalesce(d->'$.objects[*]', []), lambda y: CASE WHEN json_type(y) = 'OBJECT' THEN coalesce(y->>'$.name', 'unknown') ELSE y->>'$' END) WHEN 'structured_text' THEN things ELSE [] END AS objects,
        CASE method WHEN 'json_block' THEN list_transform(coalesce(d->'$.actions[*]', []), lambda y: (y->>'$.verb') || ' ' || (y->>'$.noun')) WHEN 'structured_text' THEN list_transform(said, lambda w: CASE WHEN len(w) > 1 THEN w[1] || ' ' || w[-1] ELSE w[1] END) ELSE [] END AS actions,
        CASE WHEN method = 'json_block' THEN len(coalesce(d->'$.steps[*]', []))::INT ELSE 0 END AS n_qa FROM r)"""


@query("parse_outputs", rf"""WITH {_SQL_PARSED} SELECT event_id, method, n_qa, array_to_string(objects, '|') AS objects, array_to_string(actions, '|') AS actions,
    CASE method WHEN 'empty_input' THEN '' WHEN 'json_block' THEN coalesce(d->>'$.scene_description', d->>'$.description', d->>'$.caption', left(x, 500)) WHEN 'structured_text' THEN scene ELSE left(x, 2000) END AS description,
    CASE method WHEN 'empty_input' THEN 0 WHEN 'json_block' THEN round(0.3 + CASE WHEN d->>'$.scene_description' IS NOT NULL THEN 0.2 ELSE 0 END + CASE WHEN n_qa > 0 THEN 0.2 ELSE 0 END + CASE WHEN len(objects) > 0 THEN 0.15 ELSE 0 END + CASE WHEN len(actions) > 0 THEN 0.15 ELSE 0 END, 2)
        WHEN 'structured_text' THEN CASE WHEN len(objects) + len(actions) > 0 THEN 0.5 ELSE 0.3 END ELSE 0.1 END::DOUBLE AS confidence FROM s""")
def parse_outputs(spark, sf):
    rows = _outputs(spark, sf).select("event_id", parsing.parsed(F.col("text")).alias("p")).select("event_id", "p.*")
    return rows.withColumns({c: F.array_join(c, "|") for c in ("objects", "actions")})


@query("parse_failures", f"WITH {_SQL_PARSED} SELECT method, count(*) AS n, sum(len(objects))::BIGINT AS objects, sum(len(actions))::BIGINT AS actions FROM s GROUP BY 1")
def parse_failures(spark, sf):
    rows = _outputs(spark, sf).select(parsing.parsed(F.col("text")).alias("p")).select("p.*")
    return rows.groupBy("method").agg(F.count("*").alias("n"), F.sum(F.size("objects")).alias("objects"), F.sum(F.size("actions")).alias("actions"))
