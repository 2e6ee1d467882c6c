"""Secret scans: fixed kinds by pattern, and random strings by their token efficiency.

Words and identifiers take few tokens of a trained vocabulary for their
length; random strings take nearly one a character or two. A run of
secret-like characters whose characters per token stay below a threshold
is reported, unless it is a digest that the text names or an identifier.

Whether a run is an identifier is judged by its parts between marks: words
by their own ratio, short words, numbers, and words with a short number.
Runs of fewer than 16 characters are never tested.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import load_ranks
from .common import fields, others, slices

#: Kinds in the order in which spans of one start are listed.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
#: Every access key, hex string and random string lies in one such run, whose characters include all of theirs.
RUN = re.compile(r"[A-Za-z0-9+/_.=-]{16,}")
#: What the token test looks at.
STRING = re.compile(r"[A-Za-z0-9+/_-]{16,}")
#: Hex lengths of MD5, SHA-1, SHA-224, SHA-256, SHA-384 and SHA-512.
DIGESTS = {32, 40, 56, 64, 96, 128}
IDENTIFIER = re.compile(
    r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}"  # UUID
    r"|[0-9+/_-]+"  # numbers, dates, rules
)
#: What stands before a digest that the text names.
NAMED = re.compile(r"(?ai:(?<![a-z0-9])(?:md5|sha[-_]?(?:1|2|224|256|384|512)|digest|checksum|hash|commit|etag|fingerprint)(?:sum)?[^a-z0-9\n]{1,4}\Z)")
#: Digests of nothing.
WELL_KNOWN = {hashlib.new(n).hexdigest() for n in ("md5", "sha1", "sha224", "sha256", "sha384", "sha512")}
#: A time in the basic or extended form of ISO 8601, behind its date.
TIME = re.compile(r"(?<=[0-9])T[0-9]{2}[-_]?[0-9]{2}(?:[-_]?[0-9]{2})?Z?(?![A-Za-z0-9])")
#: A part between marks: letters or a number with at most a few of the other kind at its end.
PART = re.compile(r"(?:([A-Za-z]+)[0-9]{0,4}|[0-9]{1,14}|[0-9]{1,4}[A-Za-z]{1,2})")
#: Words of a part: capitals, or small letters with at most one capital before them.
WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
#: Fewer characters than this for each token are taken for random; words have three and more, random base64 1.3 to 1.7.
LEAST_RATIO = 1.9


@lru_cache(2)
def _encoding(path: str, pattern: str):
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=load_ranks(path), special_tokens={})


def _candidate(text: str, a: int, b: int) -> bool:
    run = text[a:b]
    if b - a in DIGESTS and re.fullmatch("[0-9a-fA-F]+", run):
        return run.lower() not in WELL_KNOWN and not NAMED.search(text[max(0, a - 24) : a])
    return not IDENTIFIER.fullmatch(run)


def parts_of(run: str) -> list[str] | None:
    """The words that must be words for a run to be an identifier, in small letters; None if it can't be one.

    Words of up to three letters are none to be judged, if marks, numbers or
    the run's ends are around them; letters in the order of the alphabet are
    no random string.
    """
    words = []
    for part in re.split("[+/_-]+", TIME.sub("", run)):
        found = PART.fullmatch(part) if part else None
        if part and not found:
            return None
        letters = found[1] if found else None
        if not letters or len(letters) < 4:
            continue
        for word in WORD.findall(letters):
            low = word.lower()
            if len(low) < 3:
                return None
            if any(ord(y) - ord(x) != 1 for x, y in zip(low, low[1:], strict=False)):
                words.append(low)
    return words


def find(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int]]]:
    """Base spans (start, kind, end) of a text, and its runs that may be random."""
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    runs = []
    for run in RUN.finditer(text):
        a, b = run.span()
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text, a, b) if m.end() - m.start() >= 16]
        if b - a >= 32:
            spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text, a, b) if m.end() - m.start() >= 32]
        runs += [m.span() for m in STRING.finditer(text, a, b) if _candidate(text, *m.span())]
    return sorted(spans), runs


def _scan(path: str, pattern: str, to: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(path, pattern)

        def sparse(words: list[str]) -> list[str]:
            return [w for w, ids in zip(words, encoding.encode_ordinary_batch(words, num_threads=1), strict=True) if len(w) < LEAST_RATIO * len(ids)]

        for batch in slices(batches, "__text"):
            texts = [t or "" for t in batch.column("__text").to_pylist()]
            found = [find(t) for t in texts]
            words = list({t[a:b] for t, (_, runs) in zip(texts, found, strict=True) for a, b in runs})
            random = set(sparse(words))
            parts = {w: ps for w in random if (ps := parts_of(w)) is not None}
            broken = set(sparse(list({p for ps in parts.values() for p in ps})))
            random -= {w for w, ps in parts.items() if broken.isdisjoint(ps)}
            rows = []
            for t, (spans, runs) in zip(texts, found, strict=True):
                more = [(a, 3, b) for a, b in runs if t[a:b] in random]
                rows.append([{"kind": KINDS[k], "start": a, "end": b} for a, k, b in sorted(spans + more)])
            kept = [n for n in batch.schema.names if n != "__text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), pa.array(rows, SPANS)], [*kept, to])

    return run


SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def find_secrets(df: DataFrame, vocabulary: str, pattern: str, columns: list[str], text_col: str = "text", to: str = "spans") -> DataFrame:
    """The named columns of df with spans: array of (kind, start, end) in code points, end exclusive, by start, then kind.

    Spans of different kinds may overlap; those of one kind never do.
    `vocabulary` is the path of a tiktoken rank file, `pattern` its split
    pattern. Null and empty texts have no spans, texts of any length are
    read whole. Rows are independent: repeated rows give repeated results,
    an empty table an empty one. Columns that are not named are dropped, a
    named one called like the result (`to`) is replaced by it.
    """
    columns = others(columns, to)
    kept = df.select(*columns, F.col(text_col).cast("string").alias("__text"))
    return kept.mapInArrow(_scan(vocabulary, pattern, to), f"{fields(df, columns)}`{to}` array<struct<kind: string, start: int, end: int>>")


def redact(text: F.Column, spans: F.Column, mark: str = "[SECRET]") -> F.Column:
    """The text with each maximal run of overlapping spans replaced by the mark."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").cast("string").alias("done"))

    def take(acc: F.Column, s: F.Column) -> F.Column:
        before = F.when(s["start"] > acc["at"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"])).otherwise(F.lit(""))
        new = F.when((s["start"] < acc["at"]) | ((s["start"] == acc["at"]) & (acc["at"] > 0)), F.lit("")).otherwise(F.lit(mark))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["done"], before, new).alias("done"))

    return F.aggregate(spans, start, take, lambda acc: F.concat(acc["done"], F.substring(text, acc["at"] + 1, F.length(text))))


def spans_text(spans: F.Column) -> F.Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
