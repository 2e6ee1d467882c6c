"""Registered queries: things and actions of scenes, uses for robots, confidence, calibration, poses, merged answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomwright.functions import objects
from loomwright.operators import dimensions, measures, motion, selection, world
from loomwright.plans.catalog import query, t

VERBS = "open close fill pour empty turn_on stop push lift cut pick place stir Open unlock wipe".split()
NOUNS = ["glass bottle", "wooden drawer", "kitchen knife", "metal pot", "cabinet door", "rubber button", "plastic cup", "table lamp", "counter", "spoon", "cloth", "frying pan", "phone book", "container lid"]
NAMES = "bottle drawer knife pot door button cup table counter spoon pan lid glass book liquid".split()
TIMES = [86400.0 * d for d in (1, 7, 15, 31, 400)]


def _pick(words, number):
    return F.element_at(F.array(*map(F.lit, words)), (number % len(words) + 1).cast("int"))


def _actions(spark, sf):
    """A line is an action of its order's scene: verb by part, noun by supplier, the tool of a returned one by quantity."""
    made = {"verb": _pick(VERBS, F.col("l_partkey")), "noun": _pick(NOUNS, F.col("l_suppkey")), "tool": F.when(F.col("l_returnflag") == "R", _pick(NAMES, F.col("l_quantity")))}
    return t(spark, sf, "lineitem").withColumns(made)


def _things(spark, sf):
    """A line is a thing of its order's scene too, named by quantity."""
    return t(spark, sf, "lineitem").select("l_orderkey", _pick(NAMES, F.col("l_quantity")).alias("name"), "l_linenumber", F.when(F.col("l_linestatus") == "O", "open").alias("state"))


def _sql_pick(words, number):
    return f"{words!r}[({number})::INT % {len(words)} + 1]"


SQL_ACTIONS = f"SELECT l_orderkey, l_linenumber, l_partkey, {_sql_pick(VERBS, 'l_partkey')} AS verb, {_sql_pick(NOUNS, 'l_suppkey')} AS noun, CASE WHEN l_returnflag = 'R' THEN {_sql_pick(NAMES, 'l_quantity')} END AS tool, l_linestatus, l_discount, l_tax FROM lineitem"
SQL_THINGS = f"SELECT l_orderkey, {_sql_pick(NAMES, 'l_quantity')} AS name, l_linenumber AS place, CASE WHEN l_linestatus = 'O' THEN 'open' END AS state FROM lineitem"
SQL_FIRST = f"SELECT l_orderkey, name, place, state FROM ({SQL_THINGS}) QUALIFY row_number() OVER (PARTITION BY l_orderkey, name ORDER BY place, state NULLS FIRST) = 1"


def _sql_any(name, words):
    return "(" + " OR ".join(f"contains({name}, '{w}')" for w in words) + ")"


def _sql_first(name, table, otherwise):
    return "CASE " + " ".join(f"WHEN contains({name}, '{w}') THEN {v}" for w, v in table.items()) + f" ELSE {otherwise} END"


SQL_STATE = "CASE lower(verb) " + " ".join(f"WHEN '{v}' THEN '{s}'" for v, s in objects.STATES.items()) + " END"
SQL_GIVES = "list_concat(" + ", ".join(f"CASE WHEN {_sql_any('n', w)} THEN {list(g)!r} ELSE [] END" for w, g in objects.AFFORDANCES.items()) + ")"


@query("thing_properties", f"""SELECT p_partkey, n AS name, round({_sql_first('n', objects.MASSES, objects.MASS)}, 6)::DOUBLE AS mass, round({_sql_first('n', objects.FRICTIONS, objects.FRICTION)}, 6)::DOUBLE AS friction, array_to_string(list_sort(list_distinct({SQL_GIVES})), ',') AS affordances
    FROM (SELECT p_partkey, lower({_sql_pick(NOUNS, 'p_partkey')} || ' ' || coalesce(p_name, '')) AS n FROM part)""")
def thing_properties(spark, sf):
    """Mass, friction and affordances by name."""
    name = F.lower(F.concat(_pick(NOUNS, F.col("p_partkey")), F.lit(" "), F.coalesce("p_name", F.lit(""))))
    rows = t(spark, sf, "part").select("p_partkey", name.alias("name"))
    return rows.select("*", objects.mass(F.col("name")).alias("mass"), objects.friction(F.col("name")).alias("friction"), F.array_join(objects.affordances(F.col("name")), ",").alias("affordances"))


@query("scene_states", f"""WITH a AS ({SQL_ACTIONS}), h AS ({SQL_FIRST}), n AS (SELECT DISTINCT l_orderkey, noun FROM a),
    m AS (SELECT n.l_orderkey, n.noun, h.name FROM n JOIN h ON h.l_orderkey = n.l_orderkey AND contains(n.noun, h.name) QUALIFY row_number() OVER (PARTITION BY n.l_orderkey, n.noun ORDER BY h.place, h.name) = 1),
    d AS (SELECT m.l_orderkey, m.name, a.l_linenumber, a.l_partkey, {SQL_STATE} AS put, CASE lower(verb) WHEN 'push' THEN 1 WHEN 'move' THEN 1 WHEN 'slide' THEN 1 WHEN 'lift' THEN 2 WHEN 'pick_up' THEN 2 WHEN 'raise' THEN 2 END AS moved FROM a JOIN m USING (l_orderkey, noun)),
    g AS (SELECT l_orderkey, name, count(*) AS actions, last(put ORDER BY l_linenumber, l_partkey) FILTER (put IS NOT NULL) AS put, last(moved ORDER BY l_linenumber, l_partkey) FILTER (moved IS NOT NULL) AS moved FROM d GROUP BY ALL)
    SELECT l_orderkey, name, coalesce(state, 'unknown') AS before, coalesce(put, state, 'unknown') AS after, coalesce(state, 'unknown') <> coalesce(put, state, 'unknown') AS changed, coalesce(actions, 0) AS actions, CASE moved WHEN 1 THEN 0.1 ELSE 0 END::DOUBLE AS vx, CASE moved WHEN 2 THEN 0.1 ELSE 0 END::DOUBLE AS vy FROM h LEFT JOIN g USING (l_orderkey, name)""")
def scene_states(spark, sf):
    """Things before and after an order's actions."""
    rows = world.states_after(_actions(spark, sf), _things(spark, sf), "l_orderkey", ["l_linenumber", "l_partkey"], "verb", "noun", "name", "l_linenumber", "state")
    return rows.select("*", F.col("velocity")[0].alias("vx"), F.col("velocity")[1].alias("vy")).drop("velocity")


@query("scene_relations", f"""WITH h AS (SELECT l_orderkey, name, min(place) AS place FROM ({SQL_THINGS}) GROUP BY ALL), p AS (SELECT a.l_orderkey, b.name AS thing, a.name AS holder,
    CASE WHEN {_sql_any('a.name', objects.CONTAINERS)} AND {_sql_any('b.name', objects.CONTENTS)} THEN 'contained_by' WHEN {_sql_any('a.name', objects.SUPPORTS)} THEN 'supported_by' END AS relation FROM h a JOIN h b ON a.l_orderkey = b.l_orderkey AND (a.place < b.place OR (a.place = b.place AND a.name < b.name)))
    SELECT l_orderkey, thing, relation, holder FROM p WHERE relation IS NOT NULL""")
def scene_relations(spark, sf):
    return world.relations(_things(spark, sf), "l_orderkey", "name", "l_linenumber")


@query("scene_causes", f"""WITH a AS ({SQL_ACTIONS}), h AS (SELECT DISTINCT l_orderkey, name FROM ({SQL_THINGS}))
    SELECT l_orderkey, verb || ' ' || noun AS cause, name || ' state change' AS effect, 'action_effect' AS kind, count(*) AS actions FROM a JOIN h USING (l_orderkey) WHERE contains(noun, name) GROUP BY ALL
    UNION ALL SELECT l_orderkey, 'grasp ' || tool, 'enable ' || verb, 'enablement', count(*) FROM a WHERE tool IS NOT NULL GROUP BY ALL""")
def scene_causes(spark, sf):
    return world.causes(_actions(spark, sf), _things(spark, sf), "l_orderkey", "verb", "noun", "tool", "name")


SQL_OPPOSITE = "CASE verb " + " ".join(f"WHEN '{a}' THEN '{b}'" for p in objects.OPPOSITES for a, b in (p, p[::-1])) + " END"
SQL_OUTCOME = "CASE v " + " ".join(f"WHEN '{v}' THEN '{o}'" for v, o in objects.OUTCOMES.items()) + f" ELSE '{objects.OUTCOME}' END"


@query("counterfactuals", f"""WITH a AS ({SQL_ACTIONS}), o AS (SELECT verb, noun, list_filter([{SQL_OPPOSITE}, CASE WHEN verb NOT IN ('push', 'pull') THEN 'push' END, CASE WHEN verb NOT IN ('push', 'pull') THEN 'pull' END], lambda x: x IS NOT NULL) AS vs FROM a),
    e AS (SELECT verb, noun, unnest(vs) AS v, generate_subscripts(vs, 1) - 1 AS place FROM o)
    SELECT place::INT AS place, v || ' ' || noun AS "if", 'the ' || noun || ' ' || {SQL_OUTCOME} AS "then", verb || ' ' || noun AS instead_of, count(*) AS actions FROM e GROUP BY ALL""")
def counterfactuals(spark, sf):
    """Alternatives to all actions, counted."""
    return world.counterfactuals(_actions(spark, sf), "verb", "noun", []).groupBy("place", "if", "then", "instead_of").agg(F.count("*").alias("actions"))


@query("event_sets", f"""WITH g AS (SELECT DISTINCT l_orderkey, noun AS v FROM ({SQL_ACTIONS}) WHERE l_linestatus = 'O'), s AS (SELECT DISTINCT l_orderkey, noun AS v FROM ({SQL_ACTIONS}) WHERE l_discount >= 0.04),
    c AS (SELECT l_orderkey, count(g.v) AS expected, count(s.v) AS given, count(*) FILTER (g.v IS NOT NULL AND s.v IS NOT NULL) AS hits FROM g FULL JOIN s USING (l_orderkey, v) GROUP BY 1), r AS (SELECT *, coalesce(hits / nullif(given, 0), 0) AS p, coalesce(hits / nullif(expected, 0), 0) AS r FROM c)
    SELECT l_orderkey, expected, given, hits, round(p, 6)::DOUBLE AS precision, round(r, 6)::DOUBLE AS recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6)::DOUBLE AS f1 FROM r""")
def event_sets(spark, sf):
    """Found nouns (by discount) against real ones (by status) of each order."""
    rows = _actions(spark, sf)
    return world.set_scores(rows.where("l_linestatus = 'O'"), rows.where("l_discount >= 0.04"), "l_orderkey", "noun")


@query("turn_sequences", """WITH p AS (SELECT c.conv_id, c.turn, c.role AS t, CASE WHEN c.turn % 5 = 4 THEN upper(c.role) ELSE c.role END AS s, c.turn % 7 <> 6 AS here FROM conversations c),
    g AS (SELECT conv_id, bool_and(here AND t IS NOT DISTINCT FROM s) AS eq, count(*) FILTER (here) AS n FROM p GROUP BY 1)
    SELECT count(*) AS cases, coalesce(sum(eq::INT), 0)::BIGINT AS equal, sum(n)::BIGINT AS places, sum(n)::BIGINT AS "right", round(sum(eq::INT) / count(*), 6)::DOUBLE AS sequence_accuracy, 1.0::DOUBLE AS action_accuracy FROM g""")
def turn_sequences(spark, sf):
    """Roles in order against a copy that lacks every seventh turn and writes every fifth in capitals."""
    rows = t(spark, sf, "conversations").select("conv_id", "turn", "role")
    said = rows.where("turn % 7 <> 6").withColumn("role", F.when(F.col("turn") % 5 == 4, F.upper("role")).otherwise(F.col("role")))
    return world.sequence_scores(rows, said, "conv_id", "turn", "role")


SQL_FITS = "(" + " OR ".join(f"(lower(verb) = '{v}' AND {_sql_any('lower(noun)', w)})" for v, w in objects.FITTING.items()) + ")"


@query("affordance_quality", f"""WITH g AS (SELECT l_orderkey, count(*) FILTER (l_linenumber > 1) AS actions, count(*) FILTER (l_linenumber > 1 AND l_tax > 0.03) AS p, count(*) FILTER (l_linenumber > 1 AND {SQL_FITS}) AS f FROM ({SQL_ACTIONS}) GROUP BY 1)
    SELECT l_orderkey, actions, round(coalesce(p / nullif(actions, 0), 0), 6) AS physical, round(coalesce(f / nullif(actions, 0), 0), 6) AS fitting, round(CASE WHEN actions = 0 THEN 0.5 ELSE least(1, 0.4 + p / actions * 0.3 + f / actions * 0.3) END, 6)::DOUBLE AS score FROM g""")
def affordance_quality(spark, sf):
    """The first line of an order is no action."""
    rows = _actions(spark, sf).select("l_orderkey", F.when(F.col("l_linenumber") > 1, F.col("verb")).alias("verb"), "noun", F.when(F.col("l_tax") > 0.03, F.col("l_tax")).alias("physical"))
    return dimensions.affordance(rows, "l_orderkey", "verb", "noun", "physical")


@query("robotic_usefulness", f"""WITH g AS (SELECT l_orderkey, count(*) FILTER (l_linenumber > 1) AS n, count(*) FILTER (l_linenumber > 1 AND lower(verb) IN {objects.MANIPULATION!r}) AS h, count(*) FILTER (l_linenumber > 1 AND l_discount > 0.03) AS e, count(*) FILTER (l_linenumber > 1 AND l_discount > 0.03 AND l_linestatus = 'O') AS k, count(*) FILTER (l_linenumber > 1 AND l_tax > 0.03) AS p FROM ({SQL_ACTIONS}) GROUP BY 1),
    s AS (SELECT l_orderkey, n, coalesce(h / nullif(n, 0), 0) AS h, coalesce(e / nullif(n, 0), 0) AS e, coalesce(k / nullif(n, 0), 0) AS k, coalesce(p / nullif(n, 0), 0) AS p FROM g)
    SELECT l_orderkey, n AS actions, round(h, 6)::DOUBLE AS handling, round(e, 6)::DOUBLE AS embodied, round(k, 6)::DOUBLE AS gripping, round(p, 6)::DOUBLE AS physical, round(CASE WHEN n = 0 THEN 0.3 ELSE least(1, 0.2 + h * 0.3 + e * 0.2 + k * 0.15 + p * 0.15) END, 6)::DOUBLE AS score FROM s""")
def robotic_usefulness(spark, sf):
    made = {"verb": F.when(F.col("l_linenumber") > 1, F.col("verb")), "physical": F.when(F.col("l_tax") > 0.03, F.col("l_tax")), "body": F.when(F.col("l_discount") > 0.03, F.col("l_discount")), "grip": F.when(F.col("l_linestatus") == "O", "close").otherwise("")}
    return dimensions.robotic_usefulness(_actions(spark, sf).withColumns(made), "l_orderkey", "verb", "physical", "body", "grip")


@query("item_confidence", """WITH s AS (SELECT user_id, CASE WHEN event_type <> 'error' THEN event_id END AS seg, CASE WHEN event_type = 'click' THEN 4 WHEN event_type = 'view' THEN 1 END AS a, CASE WHEN value > 20 THEN 3 ELSE 0 END AS o, CASE WHEN event_type = 'purchase' AND value > 60 THEN 1 END AS x FROM events),
    g AS (SELECT user_id, count(seg) AS n, coalesce(sum(a) FILTER (seg IS NOT NULL), 0) AS a, coalesce(sum(o) FILTER (seg IS NOT NULL), 0) AS o, coalesce(sum(x) FILTER (seg IS NOT NULL), 0) AS x, count(*) FILTER (seg IS NOT NULL AND a > 0) AS sa, count(*) FILTER (seg IS NOT NULL AND o > 0) AS so, CASE WHEN user_id % 3 = 0 THEN user_id % 10 / 10 END AS q, CASE WHEN user_id % 4 = 0 THEN user_id % 7 / 6 WHEN user_id % 4 = 1 THEN 0.5 END AS p FROM s GROUP BY user_id)
    SELECT user_id, n AS segments, round(least(1, greatest(coalesce(p, q, 0.5), (coalesce(sa / nullif(n, 0), 0) + coalesce(so / nullif(n, 0), 0)) / 2)), 6)::DOUBLE AS parsing,
    round(((n > 0)::INT + (a >= greatest(n, 1))::INT + (o >= greatest(n, 1))::INT + (x > 0)::INT + (q IS NOT NULL)::INT) / 5, 6)::DOUBLE AS reviewer FROM g""")
def item_confidence(spark, sf):
    """Users as items and their events as segments; errors are none."""
    kind, user = F.col("event_type"), F.col("user_id")
    metrics = F.when(user % 4 == 0, F.create_map(F.lit("parse_confidence"), user % 7 / 6)).when(user % 4 == 1, F.create_map(F.lit("other"), F.lit(1.0)))
    rows = t(spark, sf, "events").select(
        "user_id", F.when(kind != "error", F.col("event_id")).alias("seg"), F.when(kind == "click", 4).when(kind == "view", 1).alias("a"), F.when(F.col("value") > 20, 3).otherwise(0).alias("o"),
        F.when((kind == "purchase") & (F.col("value") > 60), 1).alias("x"), F.when(user % 3 == 0, user % 10 / 10).alias("q"), metrics.alias("m"))
    return dimensions.confidences(rows, "user_id", "seg", "a", "o", "x", "q", "m")


SQL_SURE = "SELECT l_linestatus, l_discount * 10 AS c, (l_returnflag = 'R')::INT::DOUBLE AS r FROM lineitem"


@query("calibration_report", f"""WITH r AS ({SQL_SURE}), b AS (SELECT *, greatest(1e-10, least(1 - 1e-10, c)) AS k FROM r), g AS (SELECT l_linestatus, least(floor(c * 10), 9) AS bin, count(*) AS n, abs(avg(c) - avg(r)) AS gap FROM r GROUP BY ALL)
    SELECT l_linestatus, rows, ece, mce, nll, brier FROM (SELECT l_linestatus, sum(n)::BIGINT AS rows, round(sum(n * gap) / sum(n), 6) AS ece, round(max(gap), 6) AS mce FROM g GROUP BY 1) JOIN (SELECT l_linestatus, round(-avg(r * ln(k) + (1 - r) * ln(1 - k)), 6) AS nll, round(avg((c - r) ** 2), 6) AS brier FROM b GROUP BY 1) USING (l_linestatus)""")
def calibration_report(spark, sf):
    return measures.calibration_report(t(spark, sf, "lineitem"), "l_linestatus", F.col("l_discount") * 10, F.col("l_returnflag") == "R")


@query("reliability_bins", f"""WITH r AS ({SQL_SURE} WHERE l_discount < 0.07), g AS (SELECT l_linestatus, least(floor(c * 10), 9)::INT AS bin, count(*) AS n, avg(c) AS c, avg(r) AS r FROM r GROUP BY ALL)
    SELECT s.l_linestatus, i::INT AS bin, coalesce(n, 0) AS rows, round(coalesce(c, (i + 0.5) / 10), 6)::DOUBLE AS confidence, round(coalesce(r, 0), 6)::DOUBLE AS accuracy FROM (SELECT DISTINCT l_linestatus FROM g) s CROSS JOIN range(10) x(i) LEFT JOIN g ON g.l_linestatus = s.l_linestatus AND g.bin = i""")
def reliability_bins(spark, sf):
    return measures.reliability(t(spark, sf, "lineitem").where("l_discount < 0.07"), "l_linestatus", F.col("l_discount") * 10, F.col("l_returnflag") == "R")


@query("threshold_target", """WITH r AS (SELECT least(floor((l_discount * 10 - 0.1) / (0.85 / 49) + 1e-9), 49)::BIGINT AS level, (l_returnflag = 'R')::INT AS r FROM lineitem),
    m AS (SELECT i AS step, round(0.1 + i * (0.85 / 49), 6)::DOUBLE AS threshold, round(sum(r) / count(*), 6)::DOUBLE AS accuracy, round(count(*) / (SELECT count(*) FROM r), 6)::DOUBLE AS coverage, round(sum(r) / (SELECT count(*) FROM r), 6)::DOUBLE AS expected_accuracy FROM range(50) g(i) JOIN r ON level >= i GROUP BY i)
    SELECT *, accuracy >= 0.2 AND round(1 - coverage, 6) <= 0.4 AS met FROM m ORDER BY met DESC, expected_accuracy DESC, step LIMIT 1""")
def threshold_target(spark, sf):
    return selection.threshold_for(selection.thresholds(t(spark, sf, "lineitem"), F.col("l_discount") * 10, F.col("l_returnflag") == "R"), 0.2, 0.4)


@query("merged_answers", f"""WITH a AS (SELECT *, l_discount * 10 AS c, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_discount * 10 DESC NULLS LAST, l_linenumber, noun) AS k FROM ({SQL_ACTIONS})),
    p AS (SELECT l_orderkey, max(noun) FILTER (k = 1) AS a, max(noun) FILTER (k = 2) AS b, max(c) FILTER (k = 1) AS c, max(c) FILTER (k = 2) AS d FROM a WHERE k <= 2 GROUP BY 1), m AS (SELECT *, coalesce(c <= 0.9 AND c - d < 0.2, false) AS merged FROM p)
    SELECT l_orderkey, merged, c AS confidence, CASE WHEN merged THEN a || chr(10) || chr(10) || '[Additional perspective]: ' || b ELSE a END AS answer FROM m""")
def merged_answers(spark, sf):
    rows = _actions(spark, sf).withColumn("sure", F.col("l_discount") * 10)
    return selection.merged_answers(rows, "l_orderkey", "noun", "sure", "l_linenumber")


@query("poses_at_times", f"""WITH e AS (SELECT user_id, event_id, epoch_us(ts) / 1e6 - 1704067200 AS s, value AS x, value * 2 + event_id % 3 AS y, (event_id % 7) * 0.2 AS h FROM events WHERE value IS NOT NULL AND ts IS NOT NULL), u AS (SELECT DISTINCT user_id FROM e), g AS (SELECT user_id, unnest({TIMES!r})::DOUBLE AS moment FROM u),
    a AS (SELECT g.user_id, g.moment, arg_max({{'s': s, 'x': x, 'y': y, 'h': h}}, (s, event_id)) AS a FROM g JOIN e ON e.user_id = g.user_id AND s <= moment GROUP BY ALL), b AS (SELECT g.user_id, g.moment, arg_min({{'s': s, 'x': x, 'y': y, 'h': h}}, (s, event_id)) AS b FROM g JOIN e ON e.user_id = g.user_id AND s > moment GROUP BY ALL),
    p AS (SELECT *, (moment - a.s) / (b.s - a.s) AS f FROM g LEFT JOIN a USING (user_id, moment) LEFT JOIN b USING (user_id, moment)), q AS (SELECT user_id, moment, coalesce(a.x + (b.x - a.x) * f, a.x, b.x) AS x, coalesce(a.y + (b.y - a.y) * f, a.y, b.y) AS y, coalesce(a.h + (b.h - a.h) * f, a.h, b.h) AS h FROM p)
    SELECT user_id, moment, round(x, 5)::DOUBLE AS x, round(y, 5)::DOUBLE AS y, round(sin(h), 5)::DOUBLE AS qz, round(cos(h), 5)::DOUBLE AS qw FROM q""")
def poses_at_times(spark, sf):
    """Users' places and turns about one axis; half angles are up to 1.2, so the turn at a share of the way has that share of the angle."""
    half = F.col("event_id") % 7 * 0.2
    rows = t(spark, sf, "events").select("user_id", "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 - 1704067200).alias("s"), F.col("value").alias("x"), (F.col("value") * 2 + F.col("event_id") % 3).alias("y"), F.array(F.lit(0.0), F.lit(0.0), F.sin(half) * 3, F.cos(half) * 3).alias("q"))
    poses = motion.poses_at(rows, "user_id", "s", "event_id", ["x", "y"], "q", TIMES)
    return poses.select("user_id", F.col("at").alias("moment"), *(F.round(F.col(c)[i], 5).alias(n) for n, c, i in (("x", "position", 0), ("y", "position", 1), ("qz", "orientation", 2), ("qw", "orientation", 3))))
