"""Line dedup, centroid clustering and periodic runs against brute force and edge cases."""

import hashlib
from collections import Counter

import numpy as np
import pytest

from loomwright.llm import centroids, lines, queries, runs

BLANKS = " \t\n\x0b\x0c\r"


def _lower(s):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in s)


def _drop(docs, least, first=False):
    """(kept text, n_lines, n_dropped) of each row, by plain counting."""
    keys = [[_lower(x.strip(BLANKS)) for x in (t or "").split("\n")] for _, t in docs]
    named = {(i, t or ""): k for (i, t), k in zip(docs, keys, strict=True)}
    df = Counter(k for ks in named.values() for k in set(ks) if k)
    kept = []
    for (_, t), ks in zip(docs, keys, strict=True):
        stay = [x for x, k in zip((t or "").split("\n"), ks, strict=True) if df[k] < least]
        kept.append(("\n".join(stay), len(ks), len(ks) - len(stay)))
    return kept


LINE_DOCS = (
    [(i, f"Head \n own {i}\n\n\tHEAD\nfoot") for i in range(12)]
    + [(100, None), (101, ""), (102, "\n\n"), (None, "head\nx"), (None, "head\ny"), (103, "É\né"), (103, "\x0bhead\x0c"), (104, "head\n" * 300)]
    + [(105, "own 1"), (105, "own 1"), (106, "foot\nhead\nfoot")]
)


@pytest.mark.parametrize("least_rows", [1, 100])
def test_shared_lines_by_brute_force(spark, monkeypatch, least_rows):
    """With least_rows = 1 every hash is a hot one."""
    monkeypatch.setattr(lines, "LEAST_ROWS", least_rows)
    rows = spark.createDataFrame([(i, t, "x", 1) for i, t in LINE_DOCS], "doc_id long, text string, keep string, docs int")
    for least in (2, 10):
        found = lines.drop_shared_lines(rows, least_docs=least).collect()
        got = sorted((str(r.doc_id), r.kept, r.n_lines, r.n_dropped) for r in found)
        assert got == sorted((str(i), *k) for (i, _), k in zip(LINE_DOCS, _drop(LINE_DOCS, least), strict=True))


@pytest.mark.parametrize("least_rows", [1, 100])
def test_first_lines_stay(spark, monkeypatch, least_rows):
    monkeypatch.setattr(lines, "LEAST_ROWS", least_rows)
    rows = spark.createDataFrame([(2, "a\nb\nA"), (1, "c\na"), (3, "b\nd\n\n")], "doc_id long, text string")
    found = {r.doc_id: r.kept for r in lines.drop_shared_lines(rows, least_docs=2, keep_first=True).collect()}
    assert found == {1: "c\na", 2: "b", 3: "d\n\n"}


def test_bitmaps(spark):
    rows = spark.createDataFrame([(1, "a\nx\na\na\ny\nz"), (2, "a"), (3, "q")], "doc_id long, text string")
    found = {r.doc: list(r.keep) for r in lines.keep_bitmaps(rows, least_docs=2).collect()}
    assert found == {1: [0, 1, 1, 2], 2: [0, 1]}
    assert lines.drop_shared_lines(rows.limit(0)).collect() == []


def test_line_plan_has_no_python(spark):
    rows = spark.createDataFrame([(1, "a\nb")], "doc_id long, text string")
    plan = lines.drop_shared_lines(rows)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan.replace("ArrowEvalPython", "Python")


def _plain_clusters(ids, xs, k, rounds, seed=1):
    order = sorted(range(len(ids)), key=lambda i: (hashlib.sha256(f"{seed}:{'' if ids[i] is None else ids[i]}".encode()).hexdigest(), xs[i]))
    c = [list(xs[i]) for i in order[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(x, m, strict=True)), j) for j, m in enumerate(c)) for x in xs]

    for _ in range(rounds):
        now = assign()
        for j in range(len(c)):
            mine = [x for x, (_, w) in zip(xs, now, strict=True) if w == j]
            if mine:
                c[j] = [sum(col) // len(mine) for col in zip(*mine, strict=True)]
    return [(j, d) for d, j in assign()], c


@pytest.mark.parametrize("case", range(4))
def test_clusters_by_brute_force(spark, case):
    """Few different values give many ties, empty clusters and equal vectors."""
    rng = np.random.default_rng(case)
    spread, n, k, rounds = [(2, 300, 16, 3), (30, 400, 10, 6), (1, 50, 16, 3), (1000, 9, 16, 3)][case]
    made = rng.integers(-spread, spread + 1, (n, 4))
    if case == 1:
        made += rng.integers(0, 5, (n, 1)) * 40
    rows = [(int(i), [float(v) / 64 for v in x]) for i, x in enumerate(made)] + [(None, [0.0] * 4), (3, [float(v) / 64 for v in made[3]])]
    bad = [(90, None), (91, []), (92, [1.0] * 3), (93, [1.0, None, 1.0, 1.0]), (94, [float("nan")] * 4), (95, [float("inf"), 0.0, 0.0, 0.0])]
    df = spark.createDataFrame([(i, e, 7) for i, e in rows + bad], "vec_id long, embedding array<float>, cluster int")
    state, c = centroids.cluster(df, k=k, rounds=rounds, dims=4)
    ids, xs = [i for i, _ in rows], [[int(np.floor(64 * v)) for v in e] for _, e in rows]
    want, middle = _plain_clusters(ids, xs, k, rounds)
    assert c.tolist() == middle
    got = centroids.with_inertia(state, c).collect()
    assert sorted((str(r.vec_id), r.cluster, r.distance) for r in got) == sorted((str(i), j, d) for i, (j, d) in zip(ids, want, strict=True))
    assert {r.inertia for r in got} == {sum(d for _, d in want)}
    assert {(r.cluster, r.cluster_inertia) for r in got} == {(j, sum(d for i, d in want if i == j)) for j, _ in want}


def test_clusters_of_nothing(spark):
    df = spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<float>")
    assert centroids.with_inertia(*centroids.cluster(df)).collect() == []


def test_bounds_save_distances():
    """On separate clouds nearly all vectors are settled by the global filter."""
    rng = np.random.default_rng(0)
    c = rng.integers(-500, 500, (16, 8))
    x = np.repeat(c, 50, 0) + rng.integers(-3, 4, (800, 8))
    group = centroids.group_centroids(c)
    best, upper, lower = centroids._full(x, c, group, group.max() + 1)
    measured = []
    plain, centroids.squared = centroids.squared, lambda a, b: measured.append(len(a)) or plain(a, b)
    try:
        again, _, _ = centroids._filtered(x, c + 1, np.full(16, np.sqrt(8.0)), group, best, upper, lower)
    finally:
        centroids.squared = plain
    assert (again == best).all() and sum(measured) < len(x)


def _plain_runs(w, exponent, least):
    out = {}
    for q in range(1, len(w) // exponent + 1):
        i = 0
        while i + q < len(w):
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            n = i + q - s
            if i > s and n >= max(least, exponent * q):
                out.setdefault((s, n), q)
            i += i == s
    return sorted((s, n, q) for (s, n), q in out.items())


def _plain_collapsed(w, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


@pytest.mark.parametrize("exponent,least", [(4, 6), (2, 2), (3, 5), (2, 9)])
def test_runs_by_brute_force(spark, exponent, least):
    rng = np.random.default_rng(exponent * 10 + least)
    texts = [None, "", "  \t", "a a a a a a", "a a a a a", "aa a aa a aa a aa a", "A a A a A a A a", "x " * 3000, "é é é é é é é", "a b\nc a b\x0bc a b c a b c d"]
    for _ in range(300):
        n = int(rng.integers(0, 90))
        w = ["abcdef"[i] for i in rng.integers(0, int(rng.integers(1, 7)), n)]
        if n and rng.random() < 0.6:
            a, p = int(rng.integers(0, n)), int(rng.integers(1, 12))
            w = w[:a] + [w[a + (i - a) % p] if a + (i - a) % p < n else "z" for i in range(a, n)]
        if rng.random() < 0.3:
            w += (texts[-1] or "").split()
        texts.append(" ".join(w))
    rows = spark.createDataFrame([(i, t, 5, "r") for i, t in enumerate(texts)], "doc_id long, text string, n_words int, runs string")
    for r in runs.periodic_runs(rows, ["doc_id", "n_words"], exponent=exponent, least=least).collect():
        w = (texts[r.doc_id] or "").split()
        want = _plain_runs(w, exponent, least)
        assert [tuple(x) for x in r.runs] == want, texts[r.doc_id]
        assert r.collapsed == _plain_collapsed(w, want) and r.n_words == len(w)
    assert runs.periodic_runs(rows.limit(0), ["doc_id"]).collect() == []


def test_long_periods_and_long_texts(spark):
    """A period of thousands of words, found again later in the text, and a text of one word a hundred thousand times."""
    rng = np.random.default_rng(5)
    block = [f"w{i}" for i in rng.integers(0, 50, 3000)]
    once = [f"v{i}" for i in range(10)]
    texts = [" ".join(once + block * 5 + once + block * 4 + block[:100]), "x " * 100_000]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: [tuple(x) for x in r.runs] for r in runs.periodic_runs(rows, ["doc_id"]).collect()}
    assert (10, 15000, 3000) in found[0] and (15020, 12100, 3000) in found[0]
    assert found[1] == [(0, 100_000, 1)]


def test_repeats_of_the_query(spark):
    import zlib

    docs = [(i, f" {i} b\tc d e f g h i j k l m n o p ") for i in range(60)] + [(None, "a b c"), (7, None)]
    found = {(r.doc_id, r.text is None): r.text for r in queries.with_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for i, t in docs:
        h = zlib.crc32(b"" if i is None else str(i).encode())
        w, got = (t or "").split(), (found[(i, t is None)] or "").split()
        if h % 10 == 0 and w:
            n, g = len(w), h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [x if k < a else w[a + (k - a) % p] for k, x in enumerate(w)]
        assert got == w
