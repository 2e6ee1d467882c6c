"""Word-set pairs: what they shuffle, odd keys, frequent words and large families, by brute force."""

import random
import re

from pyspark.sql import functions as F

from loomwright.operators import wordsets


def _brute(rows, percent):
    sets = {}
    for i, text in rows:
        if words := frozenset(re.findall(r"\w+", (text or "").lower())):
            sets.setdefault(words, []).append(i)
    sets = [(w, min((i for i in ids if i is not None), default=None), len(ids)) for w, ids in sets.items()]
    sets = [s for s in sets if s[1] is not None]
    return sorted((i, j, m, n, round(len(a & b) / len(a | b), 6)) for a, i, m in sets for b, j, n in sets if i < j and 100 * len(a & b) >= percent * len(a | b))


def _found(spark, rows, percent):
    return sorted(tuple(r) for r in wordsets.jaccard_pairs(spark.createDataFrame(rows, "id long, text string").repartition(3), "id", "text", percent).collect())


def _texts(n, seed, words=400):
    rng = random.Random(seed)
    said = [f"w{int(words * rng.random() ** 3)}" for _ in range(20 * words)]
    out = []
    for i in range(n):
        if out and i % 3:
            near = rng.choice(out).split()
            for _ in range(rng.choice([0, 1, 2, 5])):
                near[rng.randrange(len(near))] = rng.choice(said)
            out.append(" ".join(near))
        else:
            out.append(" ".join(rng.choice(said) for _ in range(rng.choice([1, 2, 3, 5, 30, 90]))))
    return out


def test_pairs_by_brute_force_at_several_thresholds(spark):
    rows = list(enumerate(_texts(240, 1))) + [(300, None), (301, " ,.")]
    for percent in (100, 85, 61):
        want = _brute(rows, percent)
        assert _found(spark, rows, percent) == want
        assert want or percent == 100


def test_ids_that_repeat_or_are_null(spark):
    texts = _texts(120, 2)
    rows = [(None if i % 11 == 0 else i // 2, t) for i, t in enumerate(texts)]
    assert _found(spark, rows, 80) == _brute(rows, 80)


def test_frequent_words_in_parts_and_small_pieces_of_work(spark, monkeypatch):
    rows = list(enumerate(_texts(150, 3, words=60)))
    want = _brute(rows, 75)
    for name, value in (("PART", 4), ("MEMBERS", 2), ("MOST_BROADCAST", 3)):
        monkeypatch.setattr(wordsets, name, value)
    assert _found(spark, rows, 75) == want


def test_pieces_of_any_size_are_the_same(monkeypatch):
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(4)
    n = 500
    key, size = rng.integers(0, 20, n), rng.integers(5, 60, n)
    order = np.lexsort((np.arange(n), size, key))
    columns = [key, np.arange(n), size.astype(np.int32), (rng.integers(1, 5, n) << 2 | rng.integers(1, 4, n)).astype(np.int32), rng.integers(0, 3, n)]
    batch = pa.RecordBatch.from_arrays([pa.array(c[order]) for c in columns], ["key", "k", "size", "place", "before"])

    def run(step):
        found = {}
        for out in wordsets._met(85)(batch.slice(i, step) for i in range(0, n, step)):
            for x, y, w in zip(*(c.to_pylist() for c in out.columns), strict=True):
                found[x, y] = found.get((x, y), 0) + w
        return found

    want = run(n)
    assert want
    monkeypatch.setattr(wordsets, "PAIRS", 3)
    assert run(7) == run(n) == want


def test_words_are_not_shuffled(spark):
    """Texts without near copies cost little more than rows of their first words; whole words were shuffled three times."""
    rng = random.Random(5)
    rows = [(i, " ".join(f"w{int(20000 * rng.random() ** 2)}" for _ in range(150))) for i in range(1500)]
    df = spark.createDataFrame(rows, "id long, text string").repartition(4)
    sc = spark.sparkContext
    stages = lambda: sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    written = lambda: {(s.stageId(), s.attemptId()): s.shuffleWriteBytes() for s in (stages().apply(i) for i in range(stages().size()))}
    size = df.agg(F.sum(F.octet_length("text"))).first()[0]
    df.count()
    before = set(written())
    assert wordsets.jaccard_pairs(df, "id", "text", 85).count() == 0
    assert sum(n for s, n in written().items() if s not in before) < 2 * size
