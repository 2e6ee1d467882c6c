"""Registered queries over a stored index of the documents."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from loomwright.operators.fulltext import Index
from loomwright.plans.catalog import query, t
from loomwright.plans.more import _words
from loomwright.sources.scratch import shared_dir

PHRASES = ["the anea eriner", "the the the"]
REQUIRED, EXCLUDED = ["the", "and", "of"], ["license", "password"]


def _new_path(spark) -> str:
    return f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"


def _index(spark, sf) -> Index:
    return Index.create(t(spark, sf, "documents").select("doc_id", "text"), "doc_id", "text", _new_path(spark), 16)


# BM25 of df texts among n, tf occurrences in a text of `size` words
_BM25 = "ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean))"
_SQL_FACTS = "f AS (SELECT count(*) AS n, avg(len(t)) AS mean FROM w WHERE len(t) > 0)"


def _sql_phrase(words: list[str], phrase: str) -> str:
    """(phrase, doc_id, hits, score) of a phrase in w (doc_id, t)."""
    said = "[" + ", ".join(f"'{x}'" for x in words) + "]"
    return f"""SELECT '{phrase}' AS phrase, doc_id, tf::INT AS hits, round({_BM25}, 6) AS score
        FROM (SELECT doc_id, len(t) AS size, len(list_filter(range(1, len(t) + 1), lambda i: t[i] = '{words[0]}' AND t[i:i + {len(words) - 1}] = {said})) AS tf FROM w), f, (SELECT count(*) AS df FROM w WHERE len(list_filter(range(1, len(t) + 1), lambda i: t[i] = '{words[0]}' AND t[i:i + {len(words) - 1}] = {said})) > 0) WHERE tf > 0"""


def _phrases(index: Index):
    found = None
    for said in PHRASES:
        rows = index.phrase(index.terms_of(said)).select(F.lit(said).alias("phrase"), F.col("key").alias("doc_id"), "hits", F.round("score", 6).alias("score"))
        found = rows if found is None else found.union(rows)
    return found


@query("fts_phrase", f"WITH w AS (SELECT doc_id, {_words('text')} AS t FROM documents), {_SQL_FACTS} " + " UNION ALL ".join(_sql_phrase(p.split(), p) for p in PHRASES))
def fts_phrase(spark, sf):
    """Texts that have a phrase, from the index."""
    return _phrases(_index(spark, sf))


_SQL_ALL = f"""s AS (SELECT doc_id, len(t) AS size, unnest({REQUIRED}) AS term, t FROM w WHERE NOT list_has_any(t, {EXCLUDED})),
    c AS (SELECT unnest({REQUIRED}) AS term), d AS (SELECT term, count(*) AS df FROM c JOIN w ON list_contains(t, term) GROUP BY 1),
    p AS (SELECT doc_id, term, size, len(list_filter(t, lambda x: x = term)) AS tf FROM s WHERE list_has_all(t, {REQUIRED}))
    SELECT doc_id, round(sum({_BM25}), 6) AS score FROM p JOIN d USING (term), f GROUP BY 1"""


@query("fts_all_terms", f"WITH w AS (SELECT doc_id, {_words('text')} AS t FROM documents), {_SQL_FACTS}, {_SQL_ALL}")
def fts_all_terms(spark, sf):
    """Texts that have all required terms and none of the excluded ones, from the index."""
    return _index(spark, sf).match(all_of=REQUIRED, none_of=EXCLUDED).select(F.col("key").alias("doc_id"), F.round("score", 6).alias("score"))


_SQL_CHANGED = f"w AS (SELECT doc_id, {_words('text')} AS t FROM (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN coalesce(text, '') || ' the anea eriner' ELSE text END AS text FROM documents WHERE doc_id % 11 > 0))"


@query("fts_after_upsert", f"WITH {_SQL_CHANGED}, {_SQL_FACTS} " + " UNION ALL ".join(_sql_phrase(p.split(), p) for p in PHRASES))
def fts_after_upsert(spark, sf):
    """As fts_phrase, after every seventh text was written again with a longer text and every eleventh was removed."""
    docs = t(spark, sf, "documents").select("doc_id", "text")
    longer = docs.where("doc_id % 7 = 0").select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.lit(" the anea eriner")).alias("text"))
    return _phrases(_index(spark, sf).upsert(longer, "doc_id", "text").remove(docs.where("doc_id % 11 = 0"), "doc_id"))
