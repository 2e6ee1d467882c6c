"""Lines that many documents share, dropped by compressed per-document keep bitmaps.

Only hashes of lines are moved: a row (hash, document, position) for each
line that has a key. The rows are partitioned by ranges of the hash and
sorted by document and position inside; a stream over them flags the first
occurrence of a hash in each document, and the flags of a hash add up to
its number of documents. What comes back is a bitmap for each document
that loses lines, as lengths of alternating runs of kept and dropped lines.

A hash that holds more than one in MOST_HOT of all rows (so there are at
most MOST_HOT of them, few enough to broadcast) is partitioned by hash and
document instead, and its flags are summed over all partitions.

The main path is DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, stored

#: `[\x20\x09-\x0D]`
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Hashes that every task may hold as hot ones, 16 bytes each.
MOST_HOT = 10_000
#: Rows below which a hash is never hot.
LEAST_ROWS = 100
#: Counters of the first pass that looks for hot hashes.
COUNTERS = 1 << 16
_SEED = "line"


def line_key(line: Column) -> Column:
    """The line without blanks at both ends, A-Z in lower case; other letters stay (lower() would change them)."""
    bare = F.btrim(line, F.lit(BLANKS))
    return F.when(F.octet_length(bare) == F.length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def text_lines(text: Column) -> Column:
    return F.split(F.coalesce(text.cast("string"), F.lit("")), "\n", -1)


def _named(docs: DataFrame, id: str, text: str) -> DataFrame:
    """(doc, t1, t2, text): rows are told apart by id and a 128-bit hash of the text."""
    said = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.select(F.col(id).alias("doc"), F.xxhash64(said).alias("t1"), F.xxhash64(F.lit(_SEED), said).alias("t2"), said.alias("text"))


def line_hashes(docs: DataFrame, id: str = "doc_id", text: str = "text", least_chars: int = 1) -> DataFrame:
    """(h1, h2, doc, t1, t2, pos) of each line whose key has least_chars code points."""
    rows = _named(docs, id, text).select("doc", "t1", "t2", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    keyed = rows.select("doc", "t1", "t2", "pos", line_key(F.col("line")).alias("key")).where(F.length("key") >= least_chars)
    return keyed.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(_SEED), "key").alias("h2"), "doc", "t1", "t2", "pos")


def hot_hashes(lines: DataFrame, total: int) -> DataFrame:
    """Hashes of at least one in MOST_HOT of all rows: counted in COUNTERS classes first, then by themselves in the full classes only."""
    share = max(-(-total // MOST_HOT), LEAST_ROWS)
    counter = F.pmod("h1", F.lit(COUNTERS)).alias("counter")
    full = lines.groupBy(counter).agg(F.count("*").alias("n")).where(F.col("n") >= share).select("counter")
    near = lines.select("h1", "h2", counter).join(F.broadcast(full), "counter", "left_semi")
    return near.groupBy("h1", "h2").agg(F.count("*").alias("n")).where(F.col("n") >= share).select("h1", "h2")


def first_occurrences(lines: DataFrame, by: list[str]) -> DataFrame:
    """The rows by ranges of `by`, sorted by document and position, each with first: no earlier row of its hash has its document."""
    order = Window.partitionBy(*by).orderBy(*[c for c in ("doc", "t1", "t2", "pos") if c not in by])
    row = F.struct("doc", "t1", "t2")
    if "doc" in by:
        return lines.repartitionByRange(*by).withColumn("first", F.row_number().over(order) == 1)
    return lines.repartitionByRange(*by).withColumn("first", ~row.eqNullSafe(F.lag(row).over(order)))


def dropped_lines(lines: DataFrame, least_docs: int, keep_first: bool = False) -> DataFrame:
    """(doc, t1, t2, pos) of the lines to drop: all whose hash is in least_docs documents, or all but the first of them."""
    hot = stored(hot_hashes(lines, lines.count()), "hot")
    place = F.struct("doc", "t1", "t2", "pos")
    key = ["h1", "h2"]
    cold = first_occurrences(lines.join(F.broadcast(hot), key, "left_anti"), key)
    group = Window.partitionBy(*key)
    cold = cold.withColumn("docs", F.sum(F.col("first").cast("long")).over(group)).withColumn("start", F.min(place).over(group))
    warm = lines.join(F.broadcast(hot), key, "left_semi")
    counted = first_occurrences(warm, [*key, "doc", "t1", "t2"]).groupBy(*key).agg(F.sum(F.col("first").cast("long")).alias("docs"), F.min(place).alias("start"))
    # one row for each hot hash
    warm = warm.join(F.broadcast(counted), key)
    out = ["doc", "t1", "t2", "pos", "docs", "start"]
    found = cold.select(out).union(warm.select(out)).where(F.col("docs") >= least_docs)
    if keep_first:
        found = found.where(place != F.col("start"))
    return found.select("doc", "t1", "t2", "pos")


def run_lengths(positions: Column) -> tuple[Column, Column]:
    """First and last positions of the runs of consecutive numbers in a sorted array."""
    first = F.filter(positions, lambda x, i: (i == 0) | (F.get(positions, i - 1) != x - 1))
    last = F.filter(positions, lambda x, i: (i == F.size(positions) - 1) | (F.get(positions, i + 1) != x + 1))
    return first, last


def keep_bitmaps(docs: DataFrame, id: str = "doc_id", text: str = "text", least_docs: int = 10, least_chars: int = 1, keep_first: bool = False) -> DataFrame:
    """(doc, t1, t2, keep) for each document that loses lines.

    doc is the id, t1 and t2 tell texts of one id apart, keep is the bitmap:
    lengths of runs of lines, kept and dropped in turn, starting with kept
    (0 if the first line goes); lines after the last run are kept. A line's
    key is line_key(); keys shorter than least_chars are never dropped.
    Keys in least_docs documents lose all their lines, or with keep_first
    all but the first by (id, text hash, position).

    Rows of equal id and text count as one document and share a bitmap;
    rows that share only the id are different documents; a null id is an id
    like others; a null text is an empty one; an empty table gives none.
    """
    lines = stored(line_hashes(docs, id, text, least_chars), "lines")
    gone = dropped_lines(lines, least_docs, keep_first)
    found = gone.groupBy("doc", "t1", "t2").agg(F.sort_array(F.collect_set("pos")).alias("gone"))
    first, last = run_lengths(F.col("gone"))
    found = stored(found.select("doc", "t1", "t2", first.alias("first"), last.alias("last")), "runs")
    discard(lines)
    runs = F.transform("first", lambda s, i: F.array(s - F.when(i == 0, 0).otherwise(F.get("last", i - 1) + 1), F.get("last", i) - s + 1))
    return found.select("doc", "t1", "t2", F.flatten(runs).alias("keep"))


def kept_text(text: Column, keep: Column) -> Column:
    """The lines that a bitmap keeps, joined again; a null bitmap keeps all."""
    text = F.coalesce(text, F.lit(""))
    flags = F.flatten(F.transform(keep, lambda n, i: F.array_repeat(i % 2 == 0, n)))
    marked = F.filter(F.arrays_zip(text_lines(text).alias("line"), flags.alias("flag")), lambda z: F.coalesce(z["flag"], F.lit(True)))
    return F.when(keep.isNull(), text).otherwise(F.array_join(F.transform(marked, lambda z: z["line"]), "\n"))


def drop_shared_lines(docs: DataFrame, id: str = "doc_id", text: str = "text", least_docs: int = 10, least_chars: int = 1, keep_first: bool = False) -> DataFrame:
    """A row for each row of docs: the id, n_lines (before dropping), n_dropped, keep (see keep_bitmaps; null: all) and kept, the text that stays.

    Texts are split at \\n only. A text of which all lines go is empty. Very
    long texts stay in one row; nothing else of a text is moved than its
    hashes and, for kept, the text once to its bitmap.
    """
    maps = keep_bitmaps(docs, id, text, least_docs, least_chars, keep_first)
    rows, m = _named(docs, id, text), maps.select(*[F.col(c).alias(f"m_{c}") for c in maps.columns])
    on = F.col("doc").eqNullSafe(F.col("m_doc")) & (F.col("t1") == F.col("m_t1")) & (F.col("t2") == F.col("m_t2"))
    n_lines = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    n_dropped = F.aggregate(F.filter("m_keep", lambda n, i: i % 2 == 1), F.lit(0), lambda a, n: a + n)
    return rows.join(m, on, "left").select(
        F.col("doc").alias(id),
        n_lines.cast("long").alias("n_lines"),
        F.coalesce(n_dropped, F.lit(0)).cast("long").alias("n_dropped"),
        F.col("m_keep").alias("keep"),
        kept_text(F.col("text"), F.col("m_keep")).alias("kept"),
    )
