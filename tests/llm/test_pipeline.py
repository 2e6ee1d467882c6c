"""The pipeline against a plain version of its stages."""

import re

import public_tokenizers
import tiktoken

import corpus_pipeline
from loomwright.llm import bpe, queries, secrets, toxicity

SF = "/root/testdata/sf0.001"


def _words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_run_is_the_plain_version(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    net = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    toxic = {r.doc_id for r in toxicity.toxicity(docs, net, ["doc_id"]).where("score >= 0.5").collect()}
    left = {r.doc_id: r.text or "" for r in docs.collect() if r.doc_id not in toxic}
    # near duplicates
    sets = {}
    for i, t in left.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(len(w) - 4, 1))} if w else set()
    up = {i: i for i in left}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(left)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(sets[a] & sets[b])
            if both and 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    left = {i: t for i, t in left.items() if root(i) == i}
    # decontamination
    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = _words(r.text)
        windows |= {tuple(w[j : j + 13]) for j in range(max(len(w) - 12, 1))} if w else set()
    sizes = {len(x) for x in windows}
    clean = {}
    for i, t in left.items():
        w, hit = _words(t), set()
        for n in sizes:
            for j in range(len(w) - n + 1):
                if tuple(w[j : j + n]) in windows:
                    hit |= set(range(j, j + n))
        if not hit or 20 * len(hit) < len(w):
            clean[i] = t
    # secrets and encoding
    ranks = bpe.load_ranks(queries.vocabulary())
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {}
    for i, t in clean.items():
        base, runs = secrets.find(t)
        spans = sorted([(a, b) for a, _, b in base] + [(a, b) for a, b in runs if b - a < secrets.LEAST_RATIO * len(enc.encode_ordinary(t[a:b]))])
        out, at = [], 0
        for a, b in spans:
            if a > at or (a == at == 0):
                out += [t[at:a], "[SECRET]"]
            at = max(at, b)
        want[i] = enc.encode_ordinary("".join([*out, t[at:]]))
    assert {r.doc_id: r.ids for r in corpus_pipeline.run(spark, SF).collect()} == want


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(50)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns


def test_near_duplicates_keep_other_texts_of_an_id(spark):
    one, two, three = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(1, one), (1, two), (1, two), (2, one), (3, three), (3, one + " more"), (4, ""), (None, one)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = corpus_pipeline.one_of_each_group(spark, docs, SF).collect()
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, [(1, one), (1, two), (3, three), (4, ""), (None, one)]))


def test_stages_keep_odd_rows_and_clashing_columns(spark):
    rows = [(1, "one text", 1.0, "s", "k"), (1, "another text", 2.0, "s", "k"), (2, None, 3.0, "s", "k"), (3, "", 4.0, "s", "k"), (None, "no id", 5.0, "s", "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double, spans string, key string")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, docs, SF)
        assert found.columns == docs.columns
        if name != "toxicity":  # no labelled row: the score of a text is that of an untrained network
            assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, rows))
        assert stage(spark, docs.limit(0), SF).count() == 0
