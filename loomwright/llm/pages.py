"""Main text of web pages by consensus paths of their hosts.

Each page's containers are scored by the text they hold outside links.
A container's path is its tags with their generalised classes from the
page's root. Pages vote, per host and in Spark, for the path of their best
container; a page that has the host's winning path is extracted from
there, any other from its own best container.

Class names are evidence, not a verdict: text in an area whose name says
menu, advert or sidebar counts less for the containers around it, an area
around the winner is part of it whatever its name, and what an area inside
the winner is, the host's other pages say: text that comes again on them
is furniture, text that differs is content. Only reader comments go by
their name alone.
"""

from __future__ import annotations

import bisect
import hashlib
import html
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, fields, others, slices, stored

# Elements by their part in a page.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template svg math iframe object audio video canvas textarea title select".split())
BLOCKS = set("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
OUTSIDE = set("nav header footer aside form menu dialog button fieldset head".split())
CONTAINERS = set("article main section div td body blockquote".split())
# Words of class and id names: reader comments, what is never part of an article, what may be.
COMMENTS = set("comment comments commentlist discussion disqus replies reply respond".split())
FOREIGN = set("""ad ads adv advert adverts advertisement advertising sponsor sponsored promo promoted nav navbar navigation menu menubar
breadcrumb breadcrumbs topbar toolbar pagination pager cookie cookies consent gdpr popup modal overlay newsletter subscribe subscription
signup login share sharing social search hidden skip""".split())
DOUBTFUL = set("""banner banners header masthead footer foot copyright legal sidebar aside rail widget widgets related recommended
recommendations notice notices alert reviews form toc tags""".split())
#: Of the doubtful ones, those that stand beside a text, not in it.
BESIDE = set("header masthead footer foot copyright sidebar rail widget widgets form toc".split())
#: Names of a site's own title.
SITE = set("site masthead logo brand branding top".split())
#: Only these are areas; a paragraph, heading, quotation or table is part of the text around it, whatever its name.
AREAS = set("div section aside ul ol li dl article header main td figure".split())
#: What text in an area counts for the containers around it, and what containers in an area count.
INSIDE = {"comments": 0.0, "foreign": 0.0, "doubtful": 0.5}
AROUND = {"comments": 0.05, "foreign": 0.2, "doubtful": 0.6}
#: Closing of these is implied by the start of one of those.
IMPLIED = {"p": BLOCKS - {"caption", "tbody", "td", "tfoot", "th", "thead", "tr", "html", "body", "legend", "summary"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "tr": {"tr"}, "option": {"option"}}
#: What bounds the search for an open element to close.
SCOPE = {"table", "td", "th", "ul", "ol", "dl", "article", "section", "main", "aside", "nav", "div", "body", "html", "form", "header", "footer"}
#: Quotes count only where a value begins; elsewhere they belong to a name or an unquoted value.
TOKEN = re.compile(r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<![^>]*>|<\?[^>]*>|</?[a-zA-Z](?:=\s*"[^"]*"|=\s*'[^']*'|[^>])*+>|[^<]+|<""", re.S)
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
NAMES = re.compile(r"""(?<![\w-])(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
#: Raw elements whose content is text up to their own end tag; the others may hold elements of their own name.
PLAIN = {"script", "style", "textarea", "title", "noscript", "iframe"}
#: A header of these is part of the main text.
OWN_HEADER = {"article", "post", "entry", "story", "content"}


def generalise(name: str) -> str:
    """A class name without what numbers pages or variants: digits become 0."""
    return re.sub(r"\d+", "0", name.lower())


def words_of(names: list[str]) -> set[str]:
    """The words of class, id and role names; an article's own header is none."""
    out: set[str] = set()
    for name in " ".join(names).split():
        parts = set(re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", name).lower()))
        out |= parts - {"header"} if parts & OWN_HEADER else parts
    return out


def kind_of(words: set[str]) -> str | None:
    """What an area's name says, the surest first."""
    if words & COMMENTS:
        return "comments"
    return "foreign" if words & FOREIGN else "doubtful" if words & DOUBTFUL else None


class Ends:
    """Where raw elements end: all tags of a name are looked for once, however many elements of that name a page has."""

    def __init__(self, page: str):
        self.page, self.known = page, {}

    def after(self, name: str, at: int) -> int:
        """The end of the element whose start tag ends at `at`. A script or style without an end tag takes the rest of the page, another element nothing."""
        if name not in self.known:
            ends, match, opened = [], {}, []
            for m in re.finditer(rf"<(/?){name}(?=[\s/>])[^>]*>", self.page, re.I):
                if m[1]:
                    ends.append((m.start(), m.end()))
                    if opened:
                        match[opened.pop()] = m.end()
                elif not m[0].endswith("/>"):
                    opened.append(m.end())
            self.known[name] = ends, match
        ends, match = self.known[name]
        if name not in PLAIN:
            return match.get(at, at)
        i = bisect.bisect_left(ends, (at, 0))
        return ends[i][1] if i < len(ends) else len(self.page) if name in ("script", "style") else at


class Block(NamedTuple):
    text: str
    own: int  # container
    linked: int  # characters in links
    areas: tuple[int, ...]
    title: bool  # an h1


class Area(NamedTuple):
    kind: str
    path: str
    words: frozenset[str]
    article: bool  # inside an article or main


class Parsed(NamedTuple):
    blocks: list[Block]
    paths: list[str]
    parents: list[int]
    within: list[tuple[int, ...]]  # areas around a container, its own included
    areas: list[Area]


def parse(page: str) -> Parsed:
    """Blocks, containers and areas of a page.

    Unclosed elements close where HTML implies it or with their parent;
    an inline element that was never closed ends with its block. Text in
    dropped elements (menus, forms, scripts ...) is left out; headers and
    asides are left out unless an article or main is around them.
    """
    blocks: list[Block] = []
    paths, parents, within, areas = [""], [-1], [()], []
    stack: list[tuple[str, int, bool, tuple[int, ...], bool]] = [("", 0, False, (), False)]  # tag, container, dropped, areas, in an article
    buffer: list[str] = []
    linked = in_link = 0
    ends = Ends(page)

    def flush() -> None:
        nonlocal linked
        if buffer:
            text = " ".join(html.unescape("".join(buffer)).split())
            buffer.clear()
            if text:
                blocks.append(Block(text, stack[-1][1], linked, stack[-1][3], any(x[0] == "h1" for x in stack[-3:])))
        linked = 0

    over = 0  # where the raw element at hand ends
    for m in TOKEN.finditer(page):
        if m.start() < over:
            continue
        token = m[0]
        tag = TAG.match(token) if token[0] == "<" else None
        if tag is None:
            if token[0] == "<" and len(token) > 1:
                continue  # a comment or declaration
            if not stack[-1][2]:
                buffer.append(token)
                if in_link:
                    linked += len(token)
            continue
        closes, name = tag[1] == "/", tag[2].lower()
        if name == "a":
            in_link = 0 if closes else 1
            continue
        if name in VOID:
            if name in ("br", "hr", "img") and not stack[-1][2]:
                buffer.append(" ")
            continue
        if closes:
            if name in BLOCKS or name in OUTSIDE:
                at = len(stack) - 1
                while at > 0 and stack[at][0] != name:
                    at = 0 if name in ("p", "li", "td", "th", "tr", "dd", "dt") and stack[at][0] in SCOPE - {name} else at - 1
                flush()
                if at > 0:
                    del stack[at:]
            continue
        if name in RAW:
            if name in PLAIN or not token.endswith("/>"):
                over = ends.after(name, m.end())
            continue
        if name not in BLOCKS and name not in OUTSIDE:
            continue  # inline: its text belongs to the block
        flush()
        in_link = 0
        at = len(stack) - 1
        while at > 0 and name in IMPLIED.get(stack[at][0], ()):
            del stack[at:]
            at -= 1
        names = [(k.lower(), v.strip("\"'")) for k, v in NAMES.findall(token)] if len(token) > len(name) + 2 else []
        _, own, drop, around, article = stack[-1]
        drop = drop or (name in OUTSIDE and not (article and name in ("header", "aside")))
        words = words_of([v for _, v in names]) | ({"aside"} if name == "aside" else set())
        kind = kind_of(words) if name in AREAS and not drop and words else None
        classes = ".".join(sorted({generalise(c) for k, v in names if k == "class" for c in v.split()}))
        path = f"{paths[own]}/{name}" + (f".{classes}" if classes else "")
        if kind:
            around = (*around, len(areas))
            areas.append(Area(kind, path, frozenset(words), article))
        article = article or (name in ("article", "main") and not kind)
        if name in CONTAINERS and not drop:
            paths.append(path)
            parents.append(own)
            within.append(around)
            own = len(paths) - 1
        stack.append((name, own, drop, around, article))
    flush()
    return Parsed(blocks, paths, parents, within, areas)


def best_path(page: str | Parsed) -> tuple[str, float] | None:
    """Path and score of the page's best container: what it holds itself and in containers below, less for each level up and for areas between."""
    found = parse(page) if isinstance(page, str) else page
    if not found.blocks:
        return None
    score = [0.0] * len(found.paths)
    for b in found.blocks:
        own, worth = b.own, max(0, len(b.text) - 3 * b.linked)
        while own >= 0 and worth > 0.5:
            between = 1.0
            for area in b.areas[len(found.within[own]) :]:
                between *= INSIDE[found.areas[area].kind]
            score[own] += worth * between
            own, worth = found.parents[own], worth * 0.8
    for i, areas in enumerate(found.within):
        for area in areas:
            score[i] *= AROUND[found.areas[area].kind]
    # a named article or main element is worth more than a nameless one of the same text
    named = [s * (1.5 if re.search(r"/(article|main)[^/]*$", p) else 1.0) for s, p in zip(score, found.paths, strict=True)]
    at = max(range(len(named)), key=lambda i: (named[i], -i))
    return found.paths[at], named[at]


def title_paths(found: Parsed) -> dict[int, str]:
    """Paths of the blocks that are titles. The first one in a container and the later ones differ: a site's name may stand before a page's own title."""
    out: dict[int, str] = {}
    met: set[int] = set()
    for n, b in enumerate(found.blocks):
        if b.title:
            out[n] = f"{found.paths[b.own]}/h1" + ("+" if b.own in met else "")
            met.add(b.own)
    return out


def evidence(found: Parsed) -> list[tuple[str, str]]:
    """(path, digest of the text) of the page's doubtful areas and titles, to be compared with the host's other pages."""
    said: dict[int, list[str]] = {}
    out, titles = [], title_paths(found)
    for n, b in enumerate(found.blocks):
        for area in b.areas:
            if found.areas[area].kind == "doubtful":
                said.setdefault(area, []).append(b.text)
        if b.title:
            out.append((titles[n], hashlib.md5(b.text.encode()).hexdigest()))
    return out + [(found.areas[a].path, hashlib.md5("\n".join(texts).encode()).hexdigest()) for a, texts in said.items()]


def extract(page: str | Parsed, path: str | None, known: dict[str, bool] | None = None) -> str:
    """The page's main text: blocks in or below containers of the path (of its own best container if it has none of the
    path), of their parents' own blocks those that aren't mostly links nor titles that repeat on the host, and a title
    that stands elsewhere before them.

    known says of paths of areas and titles that other pages of the host have whether their text repeats there.
    Areas around a container of the path are part of the text; inside, comments and foreign areas go. A
    doubtful area goes if it is mostly links or repeats on the host; in an article it stays otherwise, elsewhere
    only if its text is known to differ and its name isn't one that stands beside a text.
    """
    found = parse(page) if isinstance(page, str) else page
    known = known or {}
    wins = [i for i, p in enumerate(found.paths) if p == path and path is not None]
    if not wins:
        own = best_path(found)
        wins = [i for i, p in enumerate(found.paths) if own is not None and p == own[0]]
    if not wins:
        return ""
    inside = [False] * len(found.paths)
    for i in wins:
        inside[i] = True
    above = {found.parents[i] for i in wins}  # headings and leads stand there
    for i, parent in enumerate(found.parents):
        inside[i] = inside[i] or (parent >= 0 and inside[parent])
    around = {area for i in wins for area in found.within[i]}
    size: dict[int, list[int]] = {}
    for b in found.blocks:
        for area in b.areas:
            total = size.setdefault(area, [0, 0])
            total[0] += len(b.text)
            total[1] += b.linked

    def stays(area: int) -> bool:
        if area in around:
            return True
        kind, at, words, article = found.areas[area]
        total, linked = size[area]
        if kind != "doubtful" or 2 * linked > total or known.get(at):
            return False
        return article or (known.get(at) is False and not words & BESIDE)

    kept = {area: stays(area) for area in size}
    titles = title_paths(found)
    beside = lambda n, b: b.own in above and 2 * b.linked < len(b.text) and not (b.title and known.get(titles[n]))
    taken = [(inside[b.own] or beside(n, b)) and all(kept[a] for a in b.areas) for n, b in enumerate(found.blocks)]
    if True in taken and not any(t and b.title for t, b in zip(taken, found.blocks, strict=True)):
        for i in range(taken.index(True) - 1, -1, -1):
            b = found.blocks[i]
            areas = [found.areas[a] for a in b.areas if a not in around]
            if b.title and not known.get(titles[i]) and 2 * b.linked < len(b.text) and all(a.kind == "doubtful" for a in areas):
                taken[i] = titles[i] in known or not any(a.words & SITE for a in areas)
                break
    return "\n".join(b.text for t, b in zip(taken, found.blocks, strict=True) if t)


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each page's best path, with its score, and one for each piece of evidence, with its digest."""
    for batch in slices(batches, "html"):
        rows = []
        for host, text in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
            found = parse(text or "")
            best = best_path(found)
            if best is not None:
                rows.append((host, *best, None, None))
                whole = hashlib.md5(text.encode()).hexdigest()
                rows += [(host, path, None, digest, whole) for path, digest in evidence(found)]
        columns = list(zip(*rows, strict=True)) if rows else [()] * 5
        kinds = (pa.string(), pa.string(), pa.float64(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["host", "path", "score", "digest", "page"])


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "__html"):
        facts = (batch.column(c).to_pylist() for c in ("__html", "__path", "__same", "__other"))
        texts = [extract(t or "", p, dict.fromkeys(same or (), True) | dict.fromkeys(other or (), False)) for t, p, same, other in zip(*facts, strict=True)]
        kept = [n for n in batch.schema.names if n not in ("__html", "__path", "__same", "__other")]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), pa.array(texts, pa.string())], [*kept, "text"])


#: Hosts up to which their winning paths are broadcast; beyond, the join is shuffled.
MOST_BROADCAST = 20_000


def main_text(df: DataFrame, columns: list[str], url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The named columns of df with text, the main text of each page, a line for each block.

    Null and empty pages have the text ''. Pages without a host (a null or
    odd url) vote for nothing and use their own best container. Ties
    between paths go to the smaller path. Repeated rows vote and are
    extracted each, and count as one page where texts are compared; columns that are not named are dropped, a named one
    called text is replaced by the result; an empty table gives an empty
    one. A page of any length is read whole.
    """
    columns = others(columns, "text")
    host = F.lower(F.regexp_extract(F.col(url_col).cast("string"), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    pages = df.select(*columns, F.when(host != "", host).alias("__host"), F.col(html_col).cast("string").alias("__html"))
    votes = stored(pages.select(F.col("__host").alias("host"), F.col("__html").alias("html")).where("host is not null").mapInArrow(_votes, "host string, path string, score double, digest string, page string"), "votes")
    counted = votes.where("digest is null").groupBy("host", "path").agg(F.count("*").alias("n"), F.round(F.sum("score"), 3).alias("score"))
    best = counted.groupBy("host").agg(F.max(F.struct("n", "score")).alias("top"))
    tied = counted.join(best, "host").where((F.col("n") == F.col("top.n")) & (F.col("score") == F.col("top.score")))
    paths = tied.groupBy("host").agg(F.min("path").alias("path"))
    # a path that one page alone has says nothing, and copies of a page are one; the others' text repeats if half of the pages share theirs
    texts = votes.where("digest is not null").select("host", "path", "digest", "page").distinct().groupBy("host", "path", "digest").agg(F.count("*").alias("n"))
    seen = texts.groupBy("host", "path").agg(F.sum("n").alias("pages"), F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("again")).where("pages > 1")
    same = 2 * F.col("again") >= F.col("pages")
    # one entry for each kind of named area that a host's layout has
    areas = seen.groupBy("host").agg(F.collect_list(F.when(same, F.col("path"))).alias("same"), F.collect_list(F.when(~same, F.col("path"))).alias("other"))
    winners = stored(paths.join(areas, "host", "left"), "host-paths")
    discard(votes)
    named = winners.select(F.col("host").alias("__of"), F.col("path").alias("__path"), F.col("same").alias("__same"), F.col("other").alias("__other"))
    few = winners.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    joined = pages.join(F.broadcast(named) if few else named, F.col("__host") == F.col("__of"), "left")
    return joined.select(*columns, "__html", "__path", "__same", "__other").mapInArrow(_extracted, f"{fields(df, columns)}text string")
