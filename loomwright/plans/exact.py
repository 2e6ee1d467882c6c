"""Registered queries: tests with p-values, personal data by spans, nested rewrites, marks, snapshots, rotations, stems."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomwright.functions import diffs, nested, pii, rotations, watermarks
from loomwright.operators import experiments, textmetrics
from loomwright.plans.catalog import MIDDLE, SQL_LATE, late, query, t
from loomwright.plans.more import _pairs
from loomwright.sources.scratch import shared_dir
from loomwright.sources.snapshots import Snapshots

# ---- tests

_STEPS = 4000
# two tails beyond |t|: one minus the density's integral by Simpson's rule
_SQL_T = f"""greatest(0, 1 - 2 * abs(t) / {_STEPS} / 3 * exp(lgamma((df + 1) / 2) - lgamma(df / 2)) / sqrt(pi() * df)
    * list_sum(list_transform(range({_STEPS} + 1), lambda i: CASE WHEN i IN (0, {_STEPS}) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * pow(1 + pow(t * i / {_STEPS}, 2) / df, -(df + 1) / 2))))"""
_Z = 1.959963984540054
# the expansion of the t quantile around the normal one
_SQL_BOUND = f"({_Z} + (pow({_Z}, 3) + {_Z}) / 4 / df + (5 * pow({_Z}, 5) + 16 * pow({_Z}, 3) + 3 * {_Z}) / 96 / pow(df, 2) + (3 * pow({_Z}, 7) + 19 * pow({_Z}, 5) + 17 * pow({_Z}, 3) - 15 * {_Z}) / 384 / pow(df, 3))"


@query("ab_test", f"""WITH r AS (SELECT event_type, user_id % 2 = 1 AS b, value AS v FROM events WHERE value IS NOT NULL),
    s AS (SELECT event_type, count(*) FILTER (NOT b) AS n_a, count(*) FILTER (b) AS n_b, avg(v) FILTER (NOT b) AS mean_a, avg(v) FILTER (b) AS mean_b, stddev_pop(v) FILTER (NOT b) AS std_a, stddev_pop(v) FILTER (b) AS std_b,
        var_samp(v) FILTER (NOT b) AS s_a, var_samp(v) FILTER (b) AS s_b FROM r GROUP BY 1),
    u AS (SELECT *, (n_a + n_b - 2)::DOUBLE AS df, (mean_a - mean_b) / sqrt(((n_a - 1) * s_a + (n_b - 1) * s_b) / (n_a + n_b - 2) * (1 / n_a + 1 / n_b)) AS t, sqrt((std_a * std_a + std_b * std_b) / 2) AS even FROM s WHERE n_a >= 2 AND n_b >= 2),
    p AS (SELECT *, {_SQL_T} AS p, {_SQL_BOUND} * even * sqrt(1 / n_a + 1 / n_b) AS width, (mean_b - mean_a) / (even + 1e-10) AS effect FROM u)
    SELECT event_type, n_a, n_b, round(t, 6) AS t, round(p, 6) AS p, round(effect, 6) AS effect, round(mean_b - mean_a - width, 4) AS low, round(mean_b - mean_a + width, 4) AS high,
        CASE WHEN p < 0.05 THEN CASE WHEN effect > 0 THEN 'b' ELSE 'a' END END AS winner FROM p""")
def ab_test(spark, sf):
    """Students' t-test of users with odd numbers against the others, for each type of event."""
    found = experiments.ab_test(t(spark, sf, "events"), ["event_type"], F.col("user_id") % 2 == 1, "value")
    return found.select("event_type", "n_a", "n_b", *(F.round(c, 6).alias(c) for c in ("t", "p", "effect")), F.round("low", 4).alias("low"), F.round("high", 4).alias("high"), "winner")


@query("ks_drift", f"""WITH c AS (SELECT event_type, value, count(*) FILTER (NOT ({SQL_LATE})) AS a, count(*) FILTER ({SQL_LATE}) AS b FROM events WHERE value IS NOT NULL GROUP BY 1, 2),
    g AS (SELECT event_type, abs(sum(a) OVER w / sum(a) OVER p - sum(b) OVER w / sum(b) OVER p) AS gap FROM c WINDOW w AS (PARTITION BY event_type ORDER BY value), p AS (PARTITION BY event_type)),
    k AS (SELECT event_type, max(gap) AS ks FROM g GROUP BY 1), f AS (SELECT event_type, sum(a)::BIGINT AS n_reference, sum(b)::BIGINT AS n_current FROM c GROUP BY 1 HAVING sum(b) >= 30 AND sum(a) > 0),
    p AS (SELECT *, least(1, greatest(0, 2 * list_sum(list_transform(range(1, 101), lambda i: CASE WHEN i % 2 = 1 THEN 1 ELSE -1 END * exp(-2 * i * i * ks * ks * n_reference * n_current / (n_reference + n_current)))))) AS p FROM k JOIN f USING (event_type))
    SELECT event_type, n_reference, n_current, round(ks, 6) AS ks, round(p, 6) AS p, p < 0.05 AS drift FROM p""")
def ks_drift(spark, sf):
    """Whether values of the second half of the month are distributed as those of the first, for each type of event."""
    found = experiments.ks_drift(t(spark, sf, "events"), ["event_type"], "value", late())
    return found.select("event_type", "n_reference", "n_current", F.round("ks", 6).alias("ks"), F.round("p", 6).alias("p"), "drift")


# ---- personal data


def _sql_claims() -> str:
    """A step for each kind: its matches in what is left, and what is left after it."""
    steps, left = ["x0 AS (SELECT doc_id, coalesce(text, '') AS x FROM documents)"], "x0"
    for i, (kind, pattern) in enumerate(pii.KINDS.items(), 1):
        p = pattern.replace("'", "''")
        had = ", ".join(list(pii.KINDS)[: i - 1])
        steps.append(f"x{i} AS (SELECT doc_id, {had + ', ' if had else ''}len(regexp_extract_all(x, '{p}')) AS {kind}, regexp_replace(x, '{p}', chr(1) || '{i}' || chr(1), 'g') AS x FROM {left})")
        left = f"x{i}"
    marks = "x"
    for i, kind in enumerate(pii.KINDS, 1):
        marks = f"replace({marks}, chr(1) || '{i}' || chr(1), '[{kind.upper()}_REDACTED]')"
    return f"WITH {', '.join(steps)} SELECT doc_id, {', '.join(f'{k}::INT AS {k}' for k in pii.KINDS)}, sha256({marks}) AS redacted_sha256 FROM {left}"


@query("pii_spans", _sql_claims())
def pii_spans(spark, sf):
    """Findings of each kind in each document, each character claimed once, and the text without them."""
    rows = t(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("found", pii.spans(F.col("text")))
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).alias(kind)
    return rows.select("doc_id", *map(count, pii.KINDS), F.sha2(pii.redacted(F.col("text"), F.col("found")), 256).alias("redacted_sha256"))


# ---- whole documents

KEY = "pepper"
# HMAC of x under KEY
_INNER, _OUTER = (bytes(b ^ by for b in KEY.encode().ljust(64, b"\0")).hex() for by in (0x36, 0x5C))


def _sql_hmac(x: str) -> str:
    return f"sha256(unhex('{_OUTER}') || unhex(sha256(unhex('{_INNER}') || encode({x}))))"


@query("masked_documents", f"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, text FROM conversations)
    SELECT conv_id, substr({_sql_hmac("conv_id::VARCHAR")}, 1, 16) AS name, count(*) AS n_turns, string_agg(CASE role WHEN 'user' THEN '[MASKED]' ELSE upper(role) END, '|' ORDER BY turn, role, text) AS roles,
        sha256(coalesce(string_agg(regexp_replace(text, '[0-9]', '#', 'g'), '|' ORDER BY turn, role, text), '')) AS texts_sha256 FROM c GROUP BY 1""")
def masked_documents(spark, sf):
    """Conversations as nested documents, every string leaf rewritten by its path: names by keyed digest, roles and texts each in their way."""
    turn = F.struct(F.coalesce("turn", F.lit(0)).alias("at"), F.struct(F.coalesce("role", F.lit("")).alias("role"), F.create_map(F.lit("text"), F.col("text")).alias("body")).alias("said"), F.col("text").alias("order"))
    docs = t(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(turn["at"].alias("at"), turn["said"]["role"].alias("role"), turn["order"].alias("order")))).alias("turns"))
    said = F.transform("turns", lambda x: F.struct(x["at"].alias("at"), F.struct(x["role"].alias("role"), F.create_map(F.lit("text"), x["order"]).alias("body")).alias("said")))
    docs = docs.select("conv_id", F.struct(F.col("conv_id").cast("string").alias("name"), said.alias("turns")).alias("doc"))

    def rewrite(leaf, path):
        if path == "doc.name":
            return nested.keyed_digest(leaf, KEY)
        return F.when(leaf == "user", "[MASKED]").otherwise(F.upper(leaf)) if path.endswith(".role") else F.regexp_replace(leaf, "[0-9]", "#")

    out = nested.rewrite_all(docs, rewrite)
    texts = F.array_compact(F.transform("doc.turns", lambda x: x["said"]["body"]["text"]))
    return out.select("conv_id", "doc.name", F.size("doc.turns").cast("long").alias("n_turns"), F.array_join(F.transform("doc.turns", lambda x: x["said"]["role"]), "|").alias("roles"), F.sha2(F.array_join(texts, "|"), 256).alias("texts_sha256"))


@query("signed_marks", f"""SELECT doc_id, length(text) > 0 AS marked, CASE WHEN length(text) > 0 THEN 'copy ' || doc_id END AS payload, CASE WHEN length(text) > 0 THEN doc_id % 3 > 0 END AS valid,
    CASE WHEN length(text) > 0 THEN substr({_sql_hmac("'copy ' || doc_id")}, 1, 16) END AS signature, sha256(coalesce(text, '')) AS bare_sha256 FROM documents""")
def signed_marks(spark, sf):
    """Each text marked, every third mark signed with another key, and what is read back."""
    payload = F.concat(F.lit("copy "), F.col("doc_id").cast("string"))
    put = lambda key: watermarks.marked(F.col("text"), payload, key)
    rows = t(spark, sf, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, put("other")).otherwise(put(KEY)).alias("text"))
    bare = F.sha2(F.coalesce(watermarks.without_marks(F.col("text")), F.lit("")), 256)
    # an array of one struct or none: inline reads the mark once
    found = F.filter(F.array(watermarks.read(F.col("text"), KEY)), lambda x: x.isNotNull())
    rows = rows.select("doc_id", (F.length("text") > 0).alias("marked"), bare.alias("bare_sha256"), F.inline_outer(found))
    signature = F.substring(nested.hmac_sha256(KEY, F.col("payload")), 1, 16)
    return rows.select("doc_id", "marked", "payload", "valid", signature.alias("signature"), "bare_sha256")


@query("snapshot_rollback", """SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer UNION ALL
    SELECT c_custkey + 1000000000, c_name, c_nationkey, c_acctbal, 'NEW' FROM customer WHERE c_nationkey = 3""")
def snapshot_rollback(spark, sf):
    """Customers after changes, removals and additions, put back to the first version; what was added stays."""
    first = t(spark, sf, "customer")
    store = Snapshots(spark, f"{shared_dir(spark)}/snapshots-{uuid.uuid4().hex}", "c_custkey")
    one = store.create(first, "first")
    changed = first.where("c_nationkey <> 7").withColumn("c_acctbal", F.when(F.col("c_custkey") % 7 == 0, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal")))
    added = first.where("c_nationkey = 3").withColumns({"c_custkey": F.col("c_custkey") + 1_000_000_000, "c_mktsegment": F.lit("NEW")})
    now = changed.unionByName(added)
    store.create(now, "second")
    return store.rollback(now, one)


@query("snapshot_plan", """WITH n AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 7 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS v FROM customer WHERE c_nationkey <> 7 UNION ALL SELECT c_custkey + 1000000000, c_acctbal FROM customer WHERE c_nationkey = 3)
    SELECT CASE WHEN n.k IS NULL THEN 'restored' WHEN c_custkey IS NULL THEN 'kept' WHEN v = c_acctbal THEN 'unchanged' ELSE 'replaced' END AS action, count(*) AS n FROM customer FULL JOIN n ON k = c_custkey GROUP BY 1""")
def snapshot_plan(spark, sf):
    """What the rollback of snapshot_rollback would do."""
    first = t(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    store = Snapshots(spark, f"{shared_dir(spark)}/snapshots-{uuid.uuid4().hex}", "c_custkey")
    one = store.create(first, "first")
    changed = first.where("c_nationkey <> 7").withColumn("c_acctbal", F.when(F.col("c_custkey") % 7 == 0, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal")))
    return store.rollback_plan(changed.unionByName(first.where("c_nationkey = 3").withColumn("c_custkey", F.col("c_custkey") + 1_000_000_000)), one)


# ---- rotations

_PARTS = ("l_quantity - 25", "l_discount * 100 - 5", "l_tax * 100 - 4", "l_linenumber - 3")
SHARE = 0.3


def _sql_unit(prefix: str) -> str:
    return ", ".join(f"{prefix}{i} / sqrt({' + '.join(f'{prefix}{j} * {prefix}{j}' for j in range(4))}) AS {prefix}{i}" for i in range(4))


@query("rotations_between", f"""WITH r AS (SELECT l_orderkey, l_linenumber, {", ".join(f"({p})::DOUBLE AS p{i}" for i, p in enumerate(_PARTS))} FROM lineitem),
    s AS (SELECT *, {", ".join(f"lead(p{i}) OVER w AS q{i}" for i in range(4))} FROM r WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, p0, p1, p2)),
    u AS (SELECT l_orderkey, l_linenumber, {_sql_unit("p")}, {_sql_unit("q")} FROM s WHERE q0 IS NOT NULL AND p0 * p0 + p1 * p1 + p2 * p2 + p3 * p3 > 0 AND q0 * q0 + q1 * q1 + q2 * q2 + q3 * q3 > 0),
    d AS (SELECT *, {" + ".join(f"p{i} * q{i}" for i in range(4))} AS c FROM u), e AS (SELECT *, acos(least(1, abs(c))) AS a, CASE WHEN c < -1e-12 THEN -1 ELSE 1 END AS s FROM d),
    m AS (SELECT *, {", ".join(f"CASE WHEN abs(c) > 0.9995 THEN p{i} + {SHARE} * (s * q{i} - p{i}) ELSE p{i} * (sin({1 - SHARE} * a) / sin(a)) + s * q{i} * (sin({SHARE} * a) / sin(a)) END AS m{i}" for i in range(4))} FROM e)
    SELECT l_orderkey, l_linenumber, {", ".join(f"round(m{i} / sqrt(m0 * m0 + m1 * m1 + m2 * m2 + m3 * m3), 5) + 0.0 AS m{i}" for i in range(4))}, round(2 * a, 5) AS angle FROM m""")
def rotations_between(spark, sf):
    """Quaternions from line items, between each and the order's next one, and the angle to it."""
    q = F.array(*[F.expr(p).cast("double") for p in _PARTS])
    rows = t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", q.alias("p"))
    rows = rows.withColumn("q", F.lead("p").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "p"))).where(rotations.dot(F.col("q"), F.col("q")) > 0).where(rotations.dot(F.col("p"), F.col("p")) > 0)
    rows = rows.select("l_orderkey", "l_linenumber", rotations.between(F.col("p"), F.col("q"), F.lit(SHARE)).alias("m"), rotations.angle(F.col("p"), F.col("q")).alias("angle"))
    return rows.select("l_orderkey", "l_linenumber", *[(F.round(F.col("m")[i], 5) + 0.0).alias(f"m{i}") for i in range(4)], F.round("angle", 5).alias("angle"))


# ---- stems


@query("rouge_1_stemmed")
def rouge_1_stemmed(spark, sf):
    """ROUGE-1 of the words' stems. SQL has no stemmer; tests hold it against plain loops."""
    return textmetrics.rouge(_pairs(spark, sf), "item_id", "text", "said", 1, stem=True)


@query("version_diffs", """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL AND NOT contains(text, '[edited]')),
    k AS (SELECT doc_id, count(*) AS n, count(*) FILTER (i % 3 > 0) AS stay, string_agg(line, chr(10) ORDER BY i) FILTER (i % 3 > 0) AS said FROM l GROUP BY 1)
    SELECT doc_id, 1 AS added, (n - stay)::INT AS removed, stay::INT AS kept, sha256(said || chr(10) || '[edited]') AS new_sha256 FROM k""")
def version_diffs(spark, sf):
    """Documents against a version without every third line and with a new one at the end: lines added, removed and kept, and the new text put together from the script."""
    docs = t(spark, sf, "documents").where("text is not null and not contains(text, '[edited]')").select("doc_id", F.concat("text", F.lit("\n")).alias("old"), F.split("text", "\n", -1).alias("lines"))
    stay = F.concat(F.filter("lines", lambda _, i: (i + 1) % 3 > 0), F.array(F.lit("[edited]")))
    rows = docs.select("doc_id", "old", F.concat(F.array_join(stay, "\n"), F.lit("\n")).alias("new"))
    found = rows.select("doc_id", diffs.compared(F.col("old"), F.col("new"), with_ratio=False).alias("d")).select("doc_id", "d.*")
    put = F.array_join(F.transform(F.filter("script", lambda s: s["op"] != "-"), lambda s: s["line"]), "\n")
    return found.select("doc_id", F.size("added").alias("added"), F.size("removed").alias("removed"), F.size("kept").alias("kept"), F.sha2(put, 256).alias("new_sha256"))
