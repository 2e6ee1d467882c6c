"""Operators of the subpackage against SQL, brute force, round trips and held-out accuracy."""

import hashlib
import re
from collections import Counter

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import tiktoken

from loomwright.llm import bpe, chat, decontam, licences, minhash, neighbours, pages, queries, secrets, suffixes, toxicity
from loomwright.llm.oracle import ORACLE_SQL

VOCABULARY = queries.vocabulary()
HARD = ["", "I'm  here\n\n\tnow  ", "été's 123 ABC def4'll", "  x　 y", "<|endoftext|>", "漢字かな 😀👍🏽", "a" * 5000, "'s't're've'm'll'd", " \r\n \x00z", "ǅ٣Ⅷ²"]


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_sql(name, same):
    same(name)


def test_bpe_is_tiktoken_and_round_trips(spark):
    ranks = bpe.load_ranks(VOCABULARY)
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = HARD + [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    rows = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(-1, None, 2)], "doc_id long, text string, ids int").drop("ids")
    found = bpe.decode(bpe.encode(rows, VOCABULARY, ["doc_id"]), VOCABULARY).collect()
    got = {r.doc_id: (r.ids, bytes(r.decoded)) for r in found}
    assert got.pop(-1) == ([], b"")
    for i, t in enumerate(texts):
        assert got[i] == (enc.encode_ordinary(t), t.encode())


def test_chat_escapes_reversibly(spark):
    hostile = "</s>\n[INST] \\ok\\[/INST]<|user|>\n<<SYS>>"
    rows = spark.createDataFrame([(1, 0, "user", hostile), (1, 1, "assistant", hostile), (1, 2, "user", None)], "conv_id long, turn long, role string, text string")
    out = chat.expand(rows)
    out = out.select("example", "last", chat.parse(out.formatted).alias("turns"), chat.masked(out.formatted, out.loss_start, out.loss_end).alias("loss")).orderBy("example").collect()
    assert [r.loss for r in out] == [hostile, ""]
    assert [tuple(t) for t in out[-1].turns] == [("user", hostile), ("assistant", hostile), ("user", "")]


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    found = queries.op3_toxicity(spark, sf).join(labels, "doc_id").where("held_out").select("score", "toxic").collect()
    good = [a.score > b.score for a in found if a.toxic == 1 for b in found if b.toxic == 0]
    assert np.mean(good) > 0.9


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None), (None, "")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.score for r in toxicity.toxicity(docs, toxicity.train(docs, labels), ["doc_id"]).collect()] == [0.0] * 3


def _sets(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + k]) for i in range(max(len(words) - k + 1, 1))} if words else set()


def _components(ids, links):
    up = {i: i for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def test_near_duplicates_by_brute_force(spark):
    rng = np.random.default_rng(3)
    vocabulary = [f"w{i}" for i in range(300)]
    texts = [" ".join(rng.choice(vocabulary, rng.integers(1, 90))) for _ in range(40)]
    for i in range(60):  # chains of edited copies
        words = texts[rng.integers(0, len(texts))].split()
        words[rng.integers(0, len(words))] = f"x{i}"
        texts.append(" ".join(words))
    texts += [None, "", " \n", "one two", "ONE\ttwo", texts[0]]
    rows = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, n long")
    sets = [_sets(t, 5) for t in texts]
    links = [(a, b) for a in range(len(texts)) for b in range(a) if sets[a] & sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    want = _components(range(len(texts)), links)
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(rows).collect()} == want
    assert minhash.near_duplicates(rows.limit(0)).count() == 0


def test_one_large_family_of_edits_costs_few_pairs(spark, monkeypatch):
    """2000 copies of one text with words replaced, dropped and added, and 200 texts around one passage."""
    rng = np.random.default_rng(5)
    base, texts = [f"b{i}" for i in range(120)], []
    for n in range(2000):
        words = list(base)
        for _ in range(rng.integers(0, 9)):
            at, kind = rng.integers(0, len(words)), rng.integers(0, 4)
            words[at : at + 1] = [[f"x{rng.integers(0, 400)}"], [f"y{n}"], [], [words[at], f"z{rng.integers(0, 50)}"]][kind]
        texts.append(" ".join(words))
    texts += [" ".join([*(f"p{i}" for i in range(60)), *(f"q{n % 150}.{i}" for i in range(rng.integers(0, 90)))]) for n in range(200)]
    sets = [_sets(t, 5) for t in texts]
    names = {g: i for i, g in enumerate({g for s in sets for g in s})}
    held = np.zeros((len(sets), len(names)), np.float32)
    for i, s in enumerate(sets):
        held[i, [names[g] for g in s]] = 1
    both, size = held @ held.T, held.sum(axis=1)
    a, b = np.nonzero(100 * both >= 80 * (size[:, None] + size - both))
    want = _components(range(len(texts)), zip(a.tolist(), b.tolist(), strict=True))
    monkeypatch.setattr(minhash, "PART", 300)
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(rows, k=5).collect()} == want
    assert len({*want.values()}) > 300  # many of them are near the others, but not linked


def _family(g, seed=1):
    """A template of 120 words with 7 slots of 6 values."""
    rng = np.random.default_rng(seed)
    return [" ".join(f"s{i}.{rng.integers(0, 6)}" if i % 17 == 8 else f"w{i}" for i in range(120)) for _ in range(g)]


@pytest.mark.parametrize("g,part", [(300, 1500), (600, 100), (1200, 1500)])
def test_templates_cost_few_rows(spark, monkeypatch, g, part):
    """Most members are near the centre and each other, few are linked: what is returned stays below three rows a member and part (a member can have several centres)."""
    texts = _family(g)
    sets = [_sets(t, 4) for t in texts]
    names = {x: i for i, x in enumerate({x for s in sets for x in s})}
    held = np.zeros((g, len(names)), np.float32)
    for i, s in enumerate(sets):
        held[i, [names[x] for x in s]] = 1
    both, size = held @ held.T, held.sum(axis=1)
    a, b = np.nonzero(100 * both >= 80 * (size[:, None] + size - both))
    want = _components(range(g), zip(a.tolist(), b.tolist(), strict=True))
    found, plain = [], minhash.residual_links
    monkeypatch.setattr(minhash, "PART", part)
    monkeypatch.setattr(minhash, "residual_links", lambda *x: found.append(plain(*x).cache()) or found[-1])
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(rows, k=4).collect()} == want
    assert 0 < found[0].count() <= 3 * g * -(-g // part)


def test_parts_find_all_links():
    """Against plain sets: members that add to and lack from a centre of 30."""
    rng = np.random.default_rng(6)
    for _ in range(60):
        c = set(range(30))
        sets = [(c - set(rng.choice(30, rng.integers(0, 12)).tolist())) | set(rng.integers(30, 60, rng.integers(0, 9)).tolist()) for _ in range(40)]
        node = rng.permutation(1000)[:40]
        component = np.where(rng.random(40) < 0.3, 7, node)
        arrays = lambda xs: [np.array(sorted(x), np.int64) for x in xs]
        side = lambda at: {"added": arrays(sets[i] - c for i in at), "removed": arrays(c - sets[i] for i in at), "size": np.array([len(sets[i]) for i in at]), "node": node[at], "component": component[at]}
        one, two = np.arange(0, 25), np.arange(10, 40)
        found = minhash.linked_parts(side(one), side(two), 80)
        links = [(int(node[i]), int(node[j])) for i in one for j in two if component[i] != component[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
        assert _components(node.tolist(), found) == _components(node.tolist(), links)


def test_repeats_by_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(0)
    make = lambda n: bytes(rng.integers(97, 123, n).astype(np.uint8)).decode()
    texts = [make(n) for n in rng.integers(0, 1200, 30)]
    for _ in range(40):
        a, b = (texts[i] for i in rng.integers(0, 30, 2))
        texts.append(a[rng.integers(0, 300) :][: rng.integers(100, 900)] + b[: rng.integers(0, 900)])
    texts += ["from " * 300, "from " * 150, "a" * 1000, "a" * 399, "", None, "é" * 300, texts[3]]
    raw = [(t or "").encode() for t in texts]
    seen = Counter(t[i : i + 400] for t in raw for i in range(len(t) - 399))
    want = {}
    for n, t in enumerate(raw):
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - 399):
            if seen[t[i : i + 400]] > 1:
                gone[i : i + 400] = True
        want[n] = bytes(np.frombuffer(t, np.uint8)[~gone])
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for most in (2000, 1):  # sorted in tasks, and counted over all tasks
        monkeypatch.setattr(suffixes, "MOST_BLOCKS", most)
        assert {r.doc_id: bytes(r.kept) for r in suffixes.remove_repeats(rows).collect()} == want


def _shuffled(plan) -> list[int]:
    """Rows written by each exchange of an executed plan."""
    kind = plan.getClass().getSimpleName()
    below = [plan.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [plan.plan()] if kind.endswith("QueryStageExec") else [plan.children().apply(i) for i in range(plan.children().size())]
    own = [plan.metrics().apply("shuffleRecordsWritten").value()] if kind == "ShuffleExchangeExec" else []
    return own + [n for x in below for n in _shuffled(x)]


def test_copies_of_a_text_are_not_dealt_to_one_task(spark, monkeypatch):
    """Bytes of blocks come from one row of each text; tasks drop the copies before a shuffle."""
    shared, found, plain = "A shared passage of the text. " * 20, [], suffixes.stored

    def seen(df, name):
        if name == "block-bytes":
            df.collect()
            found.extend(_shuffled(df._jdf.queryExecution().executedPlan()))
        return plain(df, name)

    monkeypatch.setattr(suffixes, "stored", seen)
    rows = spark.createDataFrame([(n, shared + "one end") for n in range(300)] + [(300, "another start " + shared)], "doc_id long, text string")
    out = suffixes.remove_repeats(rows).select("doc_id", "n_bytes", "spans").collect()
    assert len(out) == 301 and all(r.spans for r in out)
    assert found and max(found) < 100


def test_blocks_of_a_bucket_are_dealt_by_text(spark, monkeypatch):
    """Many different blocks with one anchor: what is fetched of them isn't dealt by the anchor."""
    passage = "".join(chr(97 + (n * n * 7 + n // 3) % 26) for n in range(380))
    plans, plain = {}, suffixes.stored

    def seen(df, name):
        df.collect()
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return plain(df, name)

    monkeypatch.setattr(suffixes, "stored", seen)
    monkeypatch.setattr(suffixes, "MOST_BLOCKS", 50)
    texts = [f"{n:030}{passage}{n * 7919:030}" for n in range(200)] + [f"{n % 2:020}{passage}{passage[:20]}" for n in range(4)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: len(r.kept) for r in suffixes.remove_repeats(rows).collect()}
    seen_before = Counter(t[i : i + 400] for t in texts for i in range(len(t) - 399))
    gone = lambda t: len({j for i in range(len(t) - 399) if seen_before[t[i : i + 400]] > 1 for j in range(i, i + 400)})
    assert found == {n: len(t) - gone(t) for n, t in enumerate(texts)}
    assert "hashpartitioning(d1" in plans["block-bytes"] and "hashpartitioning(anchor" not in plans["block-bytes"]


def test_difference_cover_orders_suffixes():
    data = np.frombuffer(b"abracadabra" * 40 + b"banana" * 60 + b"abracadabra" * 40, np.uint8)
    starts = np.arange(0, len(data) - 400)
    order, _ = suffixes.suffix_order(data, starts, 400)
    text = data.tobytes()
    assert [text[i : i + 400] for i in order] == sorted(text[i : i + 400] for i in starts)


PAGE = """<html><head><title>t</title></head><body><div class="site-header">Head</div><div class="cookie-notice">We use cookies</div>
<div class="post-9"><h1>T&amp;C&nbsp;x</h1><p>One two three four five six seven, long text <a href=x>link</a> more.<p>Second <b>bold</b> text<br>line &lt;tag&gt;
<ul><li>a<li>b</ul><div class="share-buttons">Share</div><table><tr><td>c1<td>c2</table></div>
<div class="comments"><p>Great post! A reader comment that goes on and on and on and on and on and on and on and on and on and on and on</div>
<aside>x</aside><form>f<input></form><script>if(a<b){}</script><footer>foot</footer></body></html>"""


def test_pages(spark):
    rows = spark.createDataFrame([(1, "http://h.example/a", PAGE, 0), (2, None, PAGE, 0), (3, "http://h.example/b", None, 0), (4, "x", "", 0)], "page_id long, url string, html string, text int")
    found = {r.page_id: r.text for r in pages.main_text(rows, ["page_id", "url"]).collect()}
    want = "T&C x\nOne two three four five six seven, long text link more.\nSecond bold text line <tag>\na\nb\nc1\nc2"
    assert found == {1: want, 2: want, 3: "", 4: ""}


def test_pages_with_layout_classes_and_leads():
    words = "A sentence of the main text that goes on for a while. " * 8
    body = f"<h1>Title</h1><p>{words}</p>"
    side = "<div class=sidebar><p>Some other words</p></div><ul class=menu><li><a href=x>Home</a></ul>"
    want = "Title\n" + words.strip()
    shapes = [
        f'<body><div class="content no-sidebar"><article>{body}</article>{side}</div></body>',
        f'<body><div class="page header-fixed"><div>{body}</div>{side}</div></body>',
        f'<body class=x><div class="page header-fixed">{side}<div class="comments"><p>{words[:120]}</p></div><div class=in>{body}</div></div></body>',
    ]
    assert [pages.extract(s, None) for s in shapes] == [want] * 3
    post = f"<body><div class=post><h1>Title</h1><p>The lead.</p><ul><li><a href=x>Share this</a></ul><div class=entry><p>{words}</p></div></div></body>"
    assert pages.extract(post, None) == "Title\nThe lead.\n" + words.strip()
    assert pages.extract(post, pages.best_path(post)[0]) == pages.extract(post, None)


TEXT = "A sentence of the main text that goes on for a while. " * 8


def test_titles_beside_the_text_that_repeat_on_the_host(spark):
    """A site's name goes wherever it stands; a page's own title stays before, after and without it, also if pages of the host are copies."""
    shapes = {"a": "<h1>Site</h1><h1>Title {n}</h1>{text}", "b": "<h1>Title {n}</h1><h1>Site</h1>{text}", "c": "<h1>Site</h1>{text}", "d": "<h1>Title {n}</h1>{text}", "e": "<div class=banner><h1>Title {n}</h1></div><h1>Site</h1>{text}"}
    rows, want = [], {}
    for host, shape in shapes.items():
        for n in (0, 1, 2, 3, 3):
            at, text = len(rows), f"Part {n} of {host}. {TEXT}".strip()
            rows.append((at, f"http://{host}.example/{at}", "<body>" + shape.format(n=n, text=f"<article><p>{text}</p></article>") + "</body>"))
            want[at] = ("" if host == "c" else f"Title {n}\n") + text
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.page_id: r.text for r in pages.main_text(df, ["page_id"]).collect()} == want


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f'<article><h1>T</h1><p>{TEXT}</p><h2 class="section-header">Second part</h2><p>End.</p></article>', f"T\n{TEXT.strip()}\nSecond part\nEnd."),
        (f'<article><p>{TEXT}</p><section class="related-work"><p>Others did it.</p></section></article>', f"{TEXT.strip()}\nOthers did it."),
        (f'<article><p>{TEXT}</p><p class="legal">By law.</p></article>', f"{TEXT.strip()}\nBy law."),
        (f'<article><p>{TEXT}</p><blockquote class="comment">As they say.</blockquote></article>', f"{TEXT.strip()}\nAs they say."),
        (f'<article><p>{TEXT}</p><table class="form-table"><tr><td>cell</table></article>', f"{TEXT.strip()}\ncell"),
        (f"<article><p>{TEXT}</p><aside>A word aside.</aside></article>", f"{TEXT.strip()}\nA word aside."),
        (f'<article><p>{TEXT}</p><aside><a href=x>More about this</a></aside><div class="share">Share</div></article>', TEXT.strip()),
        (f'<div class="page-header"><h1>Title</h1></div><div class="entry"><p>{TEXT}</p></div>', f"Title\n{TEXT.strip()}"),
        (f'<div class="site-header"><h1>The Site</h1></div><div class="entry"><h2>Title</h2><p>{TEXT}</p></div>', f"Title\n{TEXT.strip()}"),
        (f'<div class=story><p>{TEXT}</p></div><div class="comments"><p>{TEXT * 3}</p></div>', TEXT.strip()),
        (f'<article><p>{TEXT}</p><section id="comments"><article class="comment"><p>{TEXT * 3}</p></article></section></article>', TEXT.strip()),
        (f'<div class=post><p>{TEXT}</p><ol class="commentlist"><li><p>{TEXT * 9}</p></ol></div>', TEXT.strip()),
        (f'<div id="page" class="comments-open hidden-sidebar"><article><p>{TEXT}</p></article></div>', TEXT.strip()),
    ],
)
def test_pages_keep_what_an_article_holds(page, want):
    """Whatever else is on the page: alone, and with other parts around it."""
    assert pages.extract(f"<body>{page}</body>", None) == want
    around = "<nav><a href=x>Home</a></nav>{}<div class=sidebar><p>Some words beside the text.</p></div><footer>foot</footer>"
    assert pages.extract(f"<body>{around.format(page)}</body>", None) == want


def test_hosts_say_what_an_area_is(spark):
    """The same element is furniture where its text repeats on the host's pages, and content where it differs; on one host with titles in their headers."""
    rows = []
    for n in range(6):
        text = f"Sentence {n} of the text that goes on for a while, and then some more of it. " * 6
        note, tip = "Read our terms before you use this.", f"Tip {n}: look at the numbers again."
        rows.append((n, f"http://a.example/{n}", f'<body><h1 class=x>Site</h1><article><p>{text}</p><aside>{note}</aside><div class="alert">{tip}</div></article></body>', f"{text.strip()}\n{tip}"))
        rows.append((10 + n, f"http://b.example/{n}", f'<body><div class="banner"><h1>Title {n}</h1></div><div class=post><p>{text}</p><div class="notice">{tip}</div><div class="alert">{note}</div><div class="sidebar">Side {n}</div></div></body>', f"Title {n}\n{text.strip()}\n{tip}"))
    df = spark.createDataFrame([r[:3] for r in rows], "page_id long, url string, html string")
    for most in (20_000, 0):  # the hosts' paths broadcast, and by a shuffle
        before, pages.MOST_BROADCAST = pages.MOST_BROADCAST, most
        try:
            found = {r.page_id: r.text for r in pages.main_text(df, ["page_id"]).collect()}
        finally:
            pages.MOST_BROADCAST = before
        assert found == {r[0]: r[3] for r in rows}
    assert pages.main_text(df.limit(0), ["page_id"]).collect() == []
    twice = pages.main_text(df.union(df), ["page_id"]).collect()
    assert sorted((r.page_id, r.text) for r in twice) == sorted((r[0], r[3]) for r in rows * 2)


def test_broken_pages_take_linear_time():
    import time

    took = []
    for n in (4000, 16000):
        start = time.perf_counter()
        assert pages.extract("<body><p>text</p>" + "<svg>" * n + "<script>" * n, None) == "text"
        took.append(time.perf_counter() - start)
    assert took[1] < 12 * took[0] + 0.5


def test_pages_of_the_table(spark):
    import html

    sf = "/root/testdata/sf0.01"
    source = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in queries.op7_page_text(spark, sf).collect():
        article = re.search(r"<article>(.*?)(</article>|$)", source[r.page_id], re.S)[1]
        blocks = (" ".join(html.unescape(re.sub(r"<[^>]*>", " ", p)).split()) for p in re.split(r"<p>|</p>|<h1>|</h1>", article))
        assert r.text == "\n".join(b for b in blocks if b)


def test_licences(spark):
    mit = next(e.split("\n", 1)[1] for e in licences.KNOWN.strip().split("\n\n"))
    texts = [mit.upper().replace(",", " , "), "Copyright (c) 2020 A. Person\nAll rights reserved.\n\n" + mit.replace("\n", "\n\n"), mit + " more", None, ""]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    digests = licences.known_digests(licences.known_licences(spark))
    assert {r.doc_id: r.licence for r in licences.scan(rows, digests, ["doc_id"]).collect()} == {0: "MIT", 1: "MIT", 2: None, 3: None, 4: None}
    shuffled = licences.known_digests(licences.known_licences(spark), 0)
    assert licences.scan_lines(rows, shuffled, ["doc_id"]).count() == licences.scan_lines(rows, digests, ["doc_id"]).count()


def test_whole_licences_and_headers(spark):
    paths = sorted(licences.TEXTS.glob("*.txt"))
    want = [p.name.removesuffix(".txt").removesuffix(".header") for p in paths]
    assert {"Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "GPL-2.0-only", "GPL-3.0-only", "LGPL-2.1-only", "AGPL-3.0-or-later", "MPL-2.0", "Unlicense", "CC0-1.0", "CC-BY-SA-4.0"} <= set(want)
    texts = ["Copyright (c) 2020 A. Person\n\n" + p.read_text().replace("http://", "https://") for p in paths]
    apache = (licences.TEXTS / "Apache-2.0.txt").read_text()
    bsd = (licences.TEXTS / "BSD-3-Clause.txt").read_text()
    texts += [apache.replace("[yyyy] [name of copyright owner]", "2020 A. Person"), apache[: apache.index("APPENDIX")], "BSD 3-Clause License\n\nCopyright (c) 2020, A. Person\nAll rights reserved.\n\n" + bsd, apache[:-200]]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = licences.scan(rows, licences.known_digests(licences.known_licences(spark)), ["doc_id"])
    assert [r.licence for r in found.orderBy("doc_id").collect()] == [*want, "Apache-2.0", "Apache-2.0", "BSD-3-Clause", None]


def test_near_vectors_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "PART", 40)
    rng = np.random.default_rng(0)
    e = rng.normal(size=(300, 64)).astype(np.float32)
    e[50:150] = rng.normal(size=64) + rng.normal(size=(100, 64)) * 0.25
    e[150:180] = e[150]
    e[180:220] = e[:40] + rng.normal(size=(40, 64)) * 0.4
    rows = [(i * 3, [float(x) for x in v]) for i, v in enumerate(e)]
    rows += [(9001, None), (9002, [0.0] * 64), (9003, [None] + [1.0] * 63), (9004, [float("nan")] * 64), (9005, [float("inf")] * 64)]
    unit = neighbours.unit(e.astype(float))
    linked = unit @ unit.T >= 0.9
    np.fill_diagonal(linked, False)
    components = _components(range(300), zip(*np.nonzero(linked), strict=True))
    want = {i * 3: (int(linked[i].sum()), components[i] * 3) for i in range(300)} | {i: (0, i) for i in range(9001, 9006)}
    df = spark.createDataFrame([(*r, 5, 6) for r in rows], "vec_id long, embedding array<float>, node int, component_id int")
    found = neighbours.near_vectors(df)
    assert {r.vec_id: (r.n_links, r.component_id) for r in found.collect()} == want
    assert neighbours.near_vectors(df.limit(0)).collect() == []
    # a null id has no name; an id that comes twice counts each vector
    odd = spark.createDataFrame([(None, rows[0][1]), (1, rows[0][1]), (1, rows[0][1]), (2, rows[1][1])], "vec_id long, embedding array<float>")
    assert sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in neighbours.near_vectors(odd).collect()) == [("1", 1, "1", True)] * 2 + [("2", 0, "2", True), ("None", 0, "None", True)]


@pytest.mark.parametrize("d", [1, 7, 64, 200])
def test_codes_leave_few_pairs_open_and_lose_none(d):
    """Pairs at every cosine from 0.9 on stay open; of unrelated ones few do."""
    rng = np.random.default_rng(d)
    x, z = neighbours.unit(rng.normal(size=(600, d))), rng.normal(size=(600, d))
    cosine = np.linspace(0.9, 1, 600)[:, None]
    z = neighbours.unit(z - np.einsum("ij,ij->i", z, x)[:, None] * x) if d > 1 else x
    y = cosine * x + np.sqrt(1 - cosine**2) * z
    y = neighbours.unit(y)
    one, two = neighbours.pack(x), neighbours.pack(y)
    assert one.shape[1] == 12 + -(-d // 8) + -(-d // 2)
    found = neighbours.undecided(one, two, d, 0.9)
    assert found.diagonal().all() and (found | (x @ y.T < 0.9)).all()
    if d >= 64:
        far = x @ y.T < 0.7
        assert found[far].mean() < 0.02
    assert (neighbours.undecided(two, one, d, 0.9) == found.T).all()


def test_one_large_bucket_alone(spark, monkeypatch):
    """All vectors near each other: every bucket is a large one, in one part or in several, and no small one is left."""
    rng = np.random.default_rng(4)
    e = rng.normal(size=16) + rng.normal(size=(150, 16)) * 0.02
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(e)], "vec_id long, embedding array<double>")
    for part in (1500, 100):
        monkeypatch.setattr(neighbours, "PART", part)
        assert {(r.n_links, r.component_id) for r in neighbours.near_vectors(df).collect()} == {(149, 0)}
    empty = neighbours.pack(e)[:0]
    assert neighbours.undecided(empty, neighbours.pack(neighbours.unit(e)), 16, 0.9).shape == (0, 150)


def test_near_vectors_of_two_lengths(spark):
    rng = np.random.default_rng(1)
    rows, want = [], {}
    for first, d in ((0, 64), (1, 32)):  # ids of both lengths alternate
        e = rng.normal(size=(20, d)).repeat(6, axis=0) + rng.normal(size=(120, d)) * 0.2
        unit = neighbours.unit(e)
        linked = unit @ unit.T >= 0.9
        np.fill_diagonal(linked, False)
        components = _components(range(120), zip(*np.nonzero(linked), strict=True))
        rows += [(2 * i + first, [float(x) for x in v]) for i, v in enumerate(e)]
        want |= {2 * i + first: (int(linked[i].sum()), 2 * components[i] + first) for i in range(120)}
    found = neighbours.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(1))
    assert {r.vec_id: (r.n_links, r.component_id) for r in found.collect()} == want


def test_near_vectors_finds_planted_pairs(spark):
    rng = np.random.default_rng(2)
    x = neighbours.unit(rng.normal(size=(20000, 48)))
    z = rng.normal(size=(1000, 48))
    z = neighbours.unit(z - np.einsum("ij,ij->i", z, x[:1000])[:, None] * x[:1000])
    cosine = np.linspace(0.901, 0.95, 1000)[:, None]
    every = np.concatenate([x, cosine * x[:1000] + np.sqrt(1 - cosine**2) * z])
    table = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(len(every)), "embedding": every.tolist()}))
    found = neighbours.near_vectors(table).where("n_links > 0").toPandas()
    assert (found.vec_id - found.component_id).isin([0, 20000]).all() and (found.component_id < 1000).all()
    assert found.component_id.nunique() >= 998 and len(found) == 2 * found.component_id.nunique()


@pytest.mark.parametrize("d", [1, 2, 3, 7, 64, 200])
def test_keys_of_any_length(d):
    x = neighbours.unit(np.random.default_rng(d).normal(size=(50, d)))
    bits = neighbours.key_bits(50)
    keys = neighbours.keys_of(x, bits, neighbours.tables_for(bits, 0.9, d))
    assert (keys == neighbours.keys_of(3 * x, bits, keys.shape[1])).all() and len(np.unique(keys[:, 0])) >= min(2**d, 10) / 2


def _base(text):
    kinds = [("assign", r"""(?ai:(?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 8), ("access", r"AKIA[A-Z0-9]+", 0, 16), ("hex", r"[0-9a-f]+", 0, 32)]
    spans = [(m.start(), n, m.end()) for n, (_, p, g, least) in enumerate(kinds) for m in re.finditer(p, text) if len(m[g]) >= least]
    return ",".join(f"{kinds[k][0]}:{a}:{b}" for a, k, b in sorted(spans))


def test_secrets(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in queries.op10_secret_scan(spark, sf).collect():
        assert r.base_sha256 == hashlib.sha256(_base(texts[r.doc_id]).encode()).hexdigest()
    made = ["Token = 'abcdefgh1' API_KEY:\"x\"", "é AKIA" + "B2" * 8, "0" * 31 + " " + "ab12" * 8, "key q7Zx9Lw2Rt8Vb4Nm1Kj6", "internationalization_of_things", None]
    rows = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")
    found = {r.doc_id: [s.kind for s in r.spans] for r in secrets.find_secrets(rows, VOCABULARY, public_tokenizers.PATTERN, ["doc_id"]).collect()}
    assert found[0] == ["assign"] and "access" in found[1] and "hex" in found[2] and found[3] == ["random"] and found[4] == found[5] == []


def test_secrets_of_letters_and_of_hex(spark):
    digest = hashlib.sha1(b"x").hexdigest().upper()
    secret = ["qZxLwRtVbNmKjHgPyDfS", "xkqzjvwpbtrmhgdnflcs", "qZxLwRtVbNmKjHgP12", "key " + digest, digest[:32]]
    plain = ["SHA-1: " + digest, "checksum=" + hashlib.sha256(b"").hexdigest().upper(), hashlib.md5(b"").hexdigest().upper(), "AbstractSingletonProxyFactoryBean", "get_user_by_name_and_value", "internationalization"]
    rows = spark.createDataFrame(list(enumerate(secret + plain)), "doc_id long, text string")
    found = secrets.find_secrets(rows, VOCABULARY, public_tokenizers.PATTERN, ["doc_id"]).orderBy("doc_id").collect()
    assert [[s.kind for s in r.spans] for r in found] == [["random"]] * len(secret) + [[]] * len(plain)


def test_decontamination_without_items(spark):
    docs = spark.createDataFrame([(1, "a b c"), (None, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert {(r.n_words, r.n_hit, r.contaminated) for r in decontam.contamination(docs, none).collect()} == {(3, 0, False), (0, 0, False)}
    assert decontam.contamination(docs.limit(0), docs.withColumnRenamed("doc_id", "item_id")).count() == 0


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<body><script>for(i=0;i<n;i++){f(\"x\")}</script><article><p>One main text.</p></article></body>", "One main text."),
        ("<body><script>if(a<b){x()}</script><p>One main text.</p>", "One main text."),
        ("<body><article><p class=it's>b text</p></article></body>", "b text"),
        ("<body><header><h1>Site</h1></header><article><header><h1>Title</h1></header><p>A text of its own.</p></article></body>", "Title\nA text of its own."),
        ("<body><article><div class=\"entry-header\"><h1>Title</h1></div><p>A text of its own.</p></article></body>", "Title\nA text of its own."),
        ("<body><div class=legal-news><p>The long text of a page about the law, and then some more of it.</p></div><div class=x>short</div></body>", "The long text of a page about the law, and then some more of it."),
        ("<body><article><svg><g><svg></svg><text>no</text></g></svg><p>yes<!--> and<!-- no --!> more</p></article></body>", "yes and more"),
        ("<body><article><p>kept<select><option>no</article>", "keptno"),
        ("<body><article><p title='a > b' data-class=sidebar>kept</p></article>", "kept"),
    ],
)
def test_page_text_by_hand(page, want):
    assert pages.extract(page, None) == want


def test_columns_named_like_results_are_replaced(spark):
    row = "1 as doc_id, 'password: abcdefgh12' as text, 5 as ids, 6 as offsets, 7 as score, 8 as spans, 9 as digest, 10 as notices, 'http://a.b/' as url, '<p>x</p>' as html, 11 as host, 12 as path, 13 as decoded"
    df = spark.sql(f"SELECT {row}")
    every = df.columns
    encoded = bpe.encode(df, VOCABULARY, every)
    assert encoded.first().ids and bytes(bpe.decode(encoded, VOCABULARY).first().decoded) == b"password: abcdefgh12"
    assert toxicity.toxicity(df, None, every).first().score == 0
    assert len(secrets.find_secrets(df, VOCABULARY, public_tokenizers.PATTERN, every).first().spans) == 1
    found = pages.main_text(df, every).first()
    assert (found.text, found.host, found.path, found.html) == ("x", 11, 12, "<p>x</p>")
    digests = licences.known_digests(licences.known_licences(spark))
    assert licences.scan(df, digests, every).first().notices == []


def test_notices_of_every_row_are_its_own(spark, monkeypatch):
    digests = licences.known_digests(licences.known_licences(spark))
    mark = "Licensed under the MIT License."
    known = spark.createDataFrame([("X", mark), ("Y", "under the y licence")], "licence string, text string")
    digests = licences.known_digests(known)
    rows = spark.createDataFrame([(1, mark), (1, f"{mark}\n \nUnder the Y license"), (None, f"a\n{mark}"), (2, None), (2, "")], "doc_id long, text string")
    want = sorted([(1, "X", [(0, "X")]), (1, None, [(0, "X"), (2, "Y")]), (-1, None, [(1, "X")]), (2, None, []), (2, None, [])], key=repr)
    for most in (10_000, 1):  # looked up in the row, and by a shuffled join
        monkeypatch.setattr(licences, "MOST_IN_ROW", most)
        found = licences.scan(rows, digests, ["doc_id"]).collect()
        assert sorted([(-1 if r.doc_id is None else r.doc_id, r.licence, [tuple(n) for n in r.notices]) for r in found], key=repr) == want
    assert licences.scan(rows.limit(0), digests, ["doc_id"]).count() == 0


def test_decontamination_in_blocks_of_items(spark, monkeypatch):
    """Many items for a document, overlapping hits of several blocks, items that share a text, repetitive texts; fingerprints broadcast and shuffled."""
    base = [f"w{i}" for i in range(120)]
    items = [(n, " ".join(base[n % 100 : n % 100 + 14])) for n in range(160)] + [(500, "go " * 60), (501, "Go on"), (502, None), (None, "go on")]
    docs = [(1, "x " * 20 + " ".join(base) + " y"), (2, "go " * 3000), (3, "we GO-on and go, on"), (4, None), (5, " ".join(base[:13]))]
    docs += [docs[0]]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())
    want = {}
    for i, t in docs:
        w, hit, names = words(t), set(), set()
        for n, said in items:
            v = words(said)
            size = min(13, len(v))
            if not v or n is None:
                continue
            windows = {tuple(v[j : j + size]) for j in range(len(v) - size + 1)}
            at = [j for j in range(len(w) - size + 1) if tuple(w[j : j + size]) in windows]
            if at:
                names.add(str(n))
                hit.update(x for j in at for x in range(j, j + size))
        want[i] = (len(w), len(hit), sorted(names))
    for block, most in ((64, 250_000), (7, 0)):
        monkeypatch.setattr(decontam, "BLOCK", block)
        monkeypatch.setattr(decontam, "MOST_BROADCAST", most)
        found = decontam.contamination(d, b).collect()
        assert len(found) == len(docs) and {r.doc_id: (r.n_words, r.n_hit, list(r.items)) for r in found} == want


def _random_strings(rng):
    """Labelled runs: random keys of several alphabets and lengths, and words, paths, identifiers, numbers and digests in context."""
    letters, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    alphabets = [letters + letters.upper() + digits, letters + letters.upper() + digits + "_-", letters + digits, letters.upper() + "234567", letters + letters.upper() + digits + "+/"]
    secret = ["".join(rng.choice(list(a), n)) for a in alphabets for n in (20, 24, 32, 40, 64) for _ in range(20)]
    words = "the configuration manager request handler update service account payment history customer report invoice delivery session builder network connection document".split()
    pick = lambda n: list(rng.choice(words, n))
    plain = ["_".join(pick(3)) for _ in range(100)] + ["/".join(["usr", "share", *pick(3)]) for _ in range(100)] + ["-".join(pick(3)) + "-2024" for _ in range(100)]
    plain += ["".join(w.capitalize() for w in pick(3)) for _ in range(100)] + [f"2024-01-{d:02d}-{h:02d}-00-00-000" for d in range(1, 21) for h in range(5)]
    plain += [f"sha256: {hashlib.sha256(str(i).encode()).hexdigest()}" for i in range(50)] + [f"commit {hashlib.sha1(str(i).encode()).hexdigest()}" for i in range(50)]
    return secret, plain


def test_random_strings_are_found_by_their_tokens(spark):
    secret, plain = _random_strings(np.random.default_rng(8))
    rows = spark.createDataFrame([(i, f"see {t} there") for i, t in enumerate(secret + plain)], "doc_id long, text string")
    found = secrets.find_secrets(rows, VOCABULARY, public_tokenizers.PATTERN, ["doc_id"])
    hit = {r.doc_id for r in found.collect() if any(s.kind == "random" for s in r.spans)}
    right = sum(i < len(secret) for i in hit)
    assert right >= 0.95 * len(secret)
    assert right >= 0.98 * len(hit)


PLAIN = """get-user-by-id-and-name-v2 com/wp-content/uploads/2020/03/IMG_20200315_123456 2024-01-15T10-22-33Z-backup-daily KLMNOPQ-1234-XX-2020
ABCDEFGHIJKLMNOPQRSTUVWXYZ https://www.example.com/en/products/item-2023-11-07_large/v10/index http://cdn.example.org/assets/js/jquery-3-min_v2
usr/local/share/doc/python3/html/library/os-path MAX_RETRY_COUNT_2 __init_subclass__ ubuntu-22-04-server-amd64 release_2021-03-04_rc1 20240115T102233Z_snapshot_0001
model-2024-05-13-preview-128k chapter-12/section-03/figure-7b test_user_can_not_log_in_with_old_password PART-NO-4471-REV-B-2019 id_card_front_image_url_v3""".split()


def test_plain_names_are_no_secrets(spark):
    """URLs, paths, dates, versions and part numbers; and random strings of every alphabet are still found, with marks between."""
    rng = np.random.default_rng(12)
    secret, _ = _random_strings(rng)
    secret += ["-".join(x[i : i + 8] for i in range(0, len(x), 8)) for x in secret if len(x) >= 32]
    rows = spark.createDataFrame([(i, f"see {t} there") for i, t in enumerate(PLAIN + secret)], "doc_id long, text string")
    found = secrets.find_secrets(rows, VOCABULARY, public_tokenizers.PATTERN, ["doc_id"])
    hit = {r.doc_id for r in found.collect() if any(s.kind == "random" for s in r.spans)}
    assert [PLAIN[i] for i in sorted(hit) if i < len(PLAIN)] == []
    assert sum(i >= len(PLAIN) for i in hit) >= 0.97 * len(secret)


def test_gradient_and_forward_pass_of_the_network():
    rng = np.random.default_rng(2)
    net = toxicity.Network(np.arange(1, 6, dtype=np.uint64), np.arange(1, 9, dtype=np.uint64), 3)
    net.p = {k: rng.normal(0, 0.5, v.shape) for k, v in net.p.items()}
    inputs = np.concatenate((np.zeros((1, toxicity.WORD + toxicity.CHAR)), rng.normal(0, 1, (4, toxicity.WORD + toxicity.CHAR))))
    index = np.array([[1, 2, 3, 0], [4, 4, 1, 2]])
    logit, kept = net.forward(inputs, index, keep=True)
    h, p, sigmoid = toxicity.HIDDEN, net.p, lambda x: 1 / (1 + np.exp(-x))
    for w in range(2):  # a plain loop over words
        states = {}
        for way, places in (("f", range(4)), ("b", range(3, -1, -1))):
            s = np.zeros(h)
            for t in places:
                x, u = inputs[index[w, t]] @ p[f"in_{way}"] + p[f"bias_{way}"], s @ p[f"state_{way}"]
                z, r = sigmoid(x[:h] + u[:h]), sigmoid(x[h : 2 * h] + u[h : 2 * h])
                s = (1 - z) * np.tanh(x[2 * h :] + r * u[2 * h :]) + z * s
                states[way, t] = s
        both = [np.concatenate((states["f", t], states["b", t])) for t in range(4)]
        mark = np.array([np.tanh(x @ p["attend"] + p["attend_b"]) @ p["point"] for x in both])
        share = np.exp(mark - mark.max()) / np.exp(mark - mark.max()).sum()
        assert abs(sum(a * x for a, x in zip(share, both, strict=True)) @ p["out"] + p["out_b"][0] - logit[w]) < 1e-5
    g, d = net.back(np.array([1.0, -0.5]), inputs, index, kept)
    loss = lambda: float(net.forward(inputs, index)[0] @ np.array([1.0, -0.5]))
    for name in ("in_f", "state_b", "bias_f", "attend", "point", "out"):
        at = tuple(rng.integers(0, n) for n in p[name].shape)
        keep, e = p[name][at], 1e-3
        p[name][at] = keep + e
        up = loss()
        p[name][at] = keep - e
        down, p[name][at] = loss(), keep
        assert abs((up - down) / (2 * e) - g[name][at]) < 2e-3
