"""The corpus pipeline: five stages over documents, each written as Parquet and read again.

Toxic documents go, one document of each near-duplicate group stays,
documents contaminated by the benchmark go, secrets in texts are replaced
by a mark, and what is left is encoded. A row with a null doc_id is in no
near-duplicate group and passes that stage. Rows are judged one by one
wherever ids or rows repeat; null and empty texts are clean and stay (equal
rows count once in the near-duplicate stage); further columns are kept by
all stages but the last, whatever their names; an empty table gives an
empty one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.llm import bpe, decontam, minhash, secrets, toxicity
from loomwright.llm.common import stored

#: Scores from here on count as toxic.
TOXIC = 0.5


def _vocabulary() -> str:
    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def _free(docs: DataFrame, name: str) -> str:
    """The name, longer by as many marks as it takes to be no column of docs."""
    while name in {c.lower() for c in docs.columns}:
        name += "_"
    return name


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network, trained on the labelled rows of docs that aren't held out, scores below TOXIC."""
    net = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = _free(docs, "score")
    return toxicity.toxicity(docs, net, docs.columns, to=score).where(F.col(score) < TOXIC).select(docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the smallest id, then key, of each near-duplicate group, by five-word shingles at a similarity of 0.8; one of rows with equal id and text."""
    # rows are told apart by id and text, so that a text isn't dropped for another that shares its id
    key = _free(docs, "key")
    id, text = F.col("doc_id").cast("string"), F.col("text").cast("string")
    keys = docs.where("doc_id is not null").select(F.xxhash64(id, text).alias("key"), F.xxhash64(F.lit("row"), id, text).alias("other"))
    # a key of 64 bits that different rows have names none of them: these few stay
    clash = stored(keys.groupBy("key").agg(F.min("other").alias("low"), F.max("other").alias("high")).where("low <> high").select(F.col("key").alias(key)), "clashing-keys")
    keyed = docs.withColumn(key, F.when(id.isNotNull(), F.xxhash64(id, text)))
    named = keyed.where("doc_id is not null").join(clash, key, "left_anti")
    passed = keyed.join(clash, key, "left_semi").select(docs.columns).union(docs.where("doc_id is null"))
    groups = minhash.near_duplicates(named, key, k=5, percent=80).select(F.col(key).alias("key"), "component_id").distinct()
    members = named.select(F.col(key).alias("key"), "doc_id").join(groups, "key")
    kept = members.groupBy("component_id").agg(F.min(F.struct("doc_id", "key")).alias("least")).select(F.col("least.key").alias(key))
    return named.join(kept, key, "left_semi").dropDuplicates([key]).select(docs.columns).union(passed)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of whose words fewer than a twentieth lie in a 13-word window of the benchmark; null and empty texts stay."""
    found = decontam.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    key = _free(docs, "key")
    bad = found.where("contaminated").select(F.col("key").alias(key)).distinct()
    return docs.withColumn(key, decontam.row_key(F.col("doc_id"), F.col("text"))).join(bad, key, "left_anti").select(docs.columns)


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each secret in their texts replaced by a mark; n_chars, where it is a column, follows the text."""
    spans = _free(docs, "spans")
    found = secrets.find_secrets(docs, _vocabulary(), public_tokenizers.PATTERN, docs.columns, to=spans)
    text = F.when(F.size(spans) > 0, secrets.redact(F.col("text"), F.col(spans))).otherwise(F.col("text"))
    found = found.withColumn("text", text)
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"]))
    return found.select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids and the byte at which each token starts."""
    encoded = bpe.encode(docs, _vocabulary(), ["doc_id", "lang", "source"])
    return encoded.withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near duplicates", one_of_each_group),
    ("decontamination", drop_contaminated),
    ("secrets", hide_secrets),
    ("encoding", encode),
]

#: SQL can express neither the network nor the encoding; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
