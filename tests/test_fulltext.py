"""The stored index against scans of the texts, its buckets, upserts, removals and merges."""

import re
import shutil
from collections import Counter

import pytest
from pyspark.sql import functions as F

from loomwright.operators.fulltext import Index, bucket_of

TEXTS = {1: "the cat sat on the mat", 2: "The the THE cat", 3: None, 4: "", 5: "a mat, the cat; über-cat 42_x", 6: "cat the", 7: "sat on the mat on the mat"}


def _words(text):
    return re.findall(r"\w+", (text or "").lower())


def _hits(texts, phrase):
    n = len(phrase)
    return {k: h for k, t in texts.items() if (h := sum(_words(t)[i : i + n] == phrase for i in range(len(_words(t)))))}


@pytest.fixture
def index(spark, tmp_path):
    rows = spark.createDataFrame(list(TEXTS.items()) + [(None, "the cat")], "id long, text string")
    return Index.create(rows, "id", "text", str(tmp_path / "index"), 8)


def _same(index, texts):
    for said in ("the cat", "the the", "on the mat", "cat", "mat on the mat", "no such words"):
        assert {r.key: r.hits for r in index.phrase(index.terms_of(said)).collect()} == _hits(texts, said.split())
    full = {k: set(_words(t)) for k, t in texts.items()}
    found = {r.key for r in index.match(all_of=["the", "cat"], none_of=["sat"]).collect()}
    assert found == {k for k, w in full.items() if {"the", "cat"} <= w and "sat" not in w}
    assert {r.key for r in index.match(any_of=["sat", "42_x"]).collect()} == {k for k, w in full.items() if w & {"sat", "42_x"}}
    assert index.texts == sum(map(bool, full.values())) and index.words == sum(len(_words(t)) for t in texts.values())


def test_phrases_and_terms(index):
    _same(index, TEXTS)
    assert index.match().collect() == [] and index.phrase([]).collect() == []


def test_writes_equal_a_rebuilt_index(spark, index, tmp_path):
    changed = {2: "the mat", 8: "the cat on the mat", 4: "cat the cat"}
    after = index.upsert(spark.createDataFrame(list(changed.items()), "id long, text string"), "id", "text")
    texts = TEXTS | changed
    _same(after, texts)
    after = after.remove(spark.createDataFrame([(1,), (99,)], "k long"), "k")
    texts.pop(1)
    _same(after, texts)
    again = after.upsert(spark.createDataFrame([(1, "the cat is back")], "id long, text string"), "id", "text")
    texts[1] = "the cat is back"
    _same(again, texts)
    merged = again.merge()
    _same(merged, texts)
    assert len(merged.segments) == 1
    new = Index.create(spark.createDataFrame(list(texts.items()), "id long, text string"), "id", "text", str(tmp_path / "new"), 8)
    rows = lambda ix: Counter((r.term, r.key, r.size, tuple(r.positions)) for r in ix._live(ix._raw(ix.segments)).collect())
    assert rows(merged) == rows(again) == rows(new)
    scores = lambda ix: sorted((r.key, round(r.score, 9)) for r in ix.match(any_of=["cat", "mat"]).collect())
    assert scores(merged) == scores(again) == scores(new)
    _same(index, TEXTS)  # a reader that was open before sees what it saw


def test_only_the_terms_buckets_are_read(spark, index, tmp_path):
    """All other buckets' folders can be gone."""
    keep = {bucket_of(t, 8) for t in ("on", "the", "mat")}
    folder = tmp_path / "index" / "postings" / "segment=1"
    gone = [p for p in folder.iterdir() if p.name.startswith("bucket=") and int(p.name[7:]) not in keep]
    assert gone
    for p in gone:
        shutil.rmtree(p)
    assert {r.key: r.hits for r in index.phrase(["on", "the", "mat"]).collect()} == {1: 1, 7: 2}


def test_ranking_is_bm25(index):
    import math

    full = {k: _words(t) for k, t in TEXTS.items() if _words(t)}
    mean = sum(map(len, full.values())) / len(full)
    df = sum("cat" in w for w in full.values())
    want = {k: math.log(1 + (len(full) - df + 0.5) / (df + 0.5)) * w.count("cat") * 2.2 / (w.count("cat") + 1.2 * (0.25 + 0.75 * len(w) / mean)) for k, w in full.items() if "cat" in w}
    assert {r.key: pytest.approx(r.score) for r in index.match(any_of=["cat"]).collect()} == want


def test_empty_table(spark, tmp_path):
    none = Index.create(spark.createDataFrame([], "id string, text string"), "id", "text", str(tmp_path / "none"))
    assert none.texts == 0 and none.match(any_of=["a"]).collect() == []
    one = none.upsert(spark.createDataFrame([("x", "a b")], "id string, text string"), "id", "text")
    assert [r.key for r in one.phrase(["a", "b"]).collect()] == ["x"]


def test_a_hot_term_in_several_files(spark, tmp_path):
    """Half of all words are one term; its bucket is cut by size."""
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    try:
        rows = spark.range(20_000).select(F.col("id"), F.concat(F.lit("hot "), F.col("id").cast("string")).alias("text"))
        index = Index.create(rows, "id", "text", str(tmp_path / "hot"), 2)
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    folder = tmp_path / "hot" / "postings" / "segment=1" / f"bucket={bucket_of('hot', 2)}"
    assert len(list(folder.glob("*.parquet"))) > 1
    assert index.match(any_of=["hot"]).count() == 20_000
