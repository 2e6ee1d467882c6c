"""Metrics of texts against references, ranked search and word-set duplicates."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwright.functions.stems import stemmed
from loomwright.operators.measures import tokens
from loomwright.operators.wordsets import jaccard_pairs  # noqa: F401


def grams(t: Column, n: int) -> Column:
    return F.when(F.size(t) >= n, F.transform(F.sequence(F.lit(1), F.size(t) - n + 1), lambda i: F.array_join(F.slice(t, i, n), " "))).otherwise(F.array().cast("array<string>"))


def rouge(df: DataFrame, key: str, reference: str, hypothesis: str, n: int, stem: bool = False) -> DataFrame:
    """F measure of clipped n-gram matches; with `stem`, of the words' Porter stems."""
    said = df.select(key, *(tokens(F.col(c)).alias(s) for c, s in ((reference, "r"), (hypothesis, "h"))))
    if stem:
        said = said.withColumns({s: stemmed(F.col(s)) for s in "rh"})
    rows = said.select(key, grams(F.col("r"), n).alias("r"), grams(F.col("h"), n).alias("h"))
    count = lambda side: rows.select(key, F.explode(side).alias("g")).groupBy(key, "g").agg(F.count("*").alias(side))
    hits = count("r").join(count("h"), [key, "g"]).groupBy(key).agg(F.sum(F.least("r", "h")).alias("hits"))
    return rows.join(hits, key, "left").select(key, F.round(F.coalesce(2 * F.col("hits") / F.nullif(F.size("r") + F.size("h"), F.lit(0)), F.lit(0.0)), 6).alias(f"rouge_{n}"))


def common_length(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, a word of `a` at a time against all of `b` as the bits of one number."""
    at: dict[str, int] = {}
    for i, word in enumerate(b):
        at[word] = at.get(word, 0) | 1 << i
    row = whole = (1 << len(b)) - 1
    for word in a:
        met = row & at.get(word, 0)
        row = (row + met | row - met) & whole
    return len(b) - row.bit_count()


def longest_common(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of two arrays; nulls count as empty."""

    def run(one: pd.Series, two: pd.Series) -> pd.Series:
        return pd.Series([0 if x is None or y is None else common_length(list(x), list(y)) for x, y in zip(one, two, strict=True)], dtype="int32")

    run.__annotations__ = {"one": pd.Series, "two": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "int")(a, b)


def rouge_l(df: DataFrame, key: str, reference: str, hypothesis: str) -> DataFrame:
    """F measure of the longest common subsequence of words."""
    rows = df.select(key, tokens(F.col(reference)).alias("r"), tokens(F.col(hypothesis)).alias("h"))
    return rows.select(key, F.round(F.coalesce(2 * longest_common(F.col("r"), F.col("h")) / F.nullif(F.size("r") + F.size("h"), F.lit(0)), F.lit(0.0)), 6).alias("rouge_l"))


def cider(df: DataFrame, key: str, reference: str, hypothesis: str) -> DataFrame:
    """Mean over n = 1 to 4 of the cosine of tf-idf n-gram vectors; idf = ln(references / references with the gram), 1 reference where there is none."""
    said = df.select(key, tokens(F.col(reference)).alias("r"), tokens(F.col(hypothesis)).alias("h"))
    part = lambda side: said.select(key, F.explode(F.array(*(F.struct(F.lit(n).alias("n"), grams(F.col(side), n).alias("g")) for n in range(1, 5)))).alias("x")).select(key, "x.n", F.explode("x.g").alias("g")).groupBy(key, "n", "g").agg(F.count("*").alias(side))
    both = part("r").join(part("h"), [key, "n", "g"], "full")
    often = both.groupBy("n", "g").agg(F.count("r").alias("df"))
    every = said.agg(F.count("*").alias("refs"))
    idf = F.ln(F.col("refs") / F.greatest("df", F.lit(1)))
    vector = both.join(often, ["n", "g"]).join(F.broadcast(every)).select(key, "n", *((F.coalesce(side, F.lit(0)) * idf).alias(side) for side in ("r", "h")))
    sums = vector.groupBy(key, "n").agg(F.sum(F.col("r") * F.col("h")).alias("rh"), F.sum(F.col("r") * F.col("r")).alias("rr"), F.sum(F.col("h") * F.col("h")).alias("hh"))
    cosine = F.when((F.col("rr") > 0) & (F.col("hh") > 0), F.col("rh") / F.sqrt(F.col("rr")) / F.sqrt(F.col("hh"))).otherwise(0.0)
    scores = sums.groupBy(key).agg((F.sum(cosine) / 4).alias("s"))
    return said.select(key).join(scores, key, "left").select(key, F.round(F.coalesce("s", F.lit(0.0)), 6).alias("cider"))


def search(df: DataFrame, key: str, text: str, terms: list[str], k: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """The k rows of the highest BM25 score for the terms; equal scores by key. Lengths and document counts are over all rows."""
    count = lambda term: F.size(F.filter("t", lambda word: word == term))
    rows = df.select(key, tokens(F.col(text)).alias("t")).select(key, F.size("t").alias("size"), *(count(x).alias(f"tf{i}") for i, x in enumerate(terms)))
    facts = rows.agg(F.count("*").alias("docs"), F.avg("size").alias("mean"), *(F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))))
    idf = lambda i: F.ln(1 + (F.col("docs") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5))
    tf = lambda i: F.col(f"tf{i}") * (k1 + 1) / (F.col(f"tf{i}") + k1 * (1 - b + b * F.col("size") / F.col("mean")))
    score = sum((idf(i) * tf(i) for i in range(len(terms))), F.lit(0.0))
    found = rows.where(" or ".join(f"tf{i} > 0" for i in range(len(terms)))).join(F.broadcast(facts)).select(key, F.round(score, 6).alias("score"))
    return found.orderBy(F.desc("score"), key).limit(k)


def adjacent_jaccard(df: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """Mean Jaccard similarity of the word sets of consecutive rows of a key; two empty sets are equal."""
    words = df.select(key, order, F.array_distinct(tokens(F.col(text))).alias("w")).withColumn("before", F.lag("w").over(Window.partitionBy(key).orderBy(order)))
    union = F.size(F.array_union("w", "before"))
    same = F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect("w", "before")) / union)
    return words.where("before is not null").groupBy(key).agg(F.count("*").alias("pairs"), F.round(F.avg(same), 6).alias("coherence"))
