"""Ordered folds of a group's rows as running compositions of maps, so that one large group is many tasks.

Each row is a map of the state before it to the state after it, of a kind
that is closed under composition:

    affine   x -> a * x + b                       (a, b)
    clamp    x -> least(hi, greatest(lo, x + c))  (c, lo, hi)

Rows are partitioned by ranges of key and order, which cuts a large key
between partitions. Inside a partition the maps of a key are composed by an
associative scan; a partition's composition of a key is one row, and these
few rows give each partition the state that it starts from.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwright.sources.scratch import stored


def _affine(later: list[np.ndarray], earlier: list[np.ndarray]) -> list[np.ndarray]:
    return [later[0] * earlier[0], later[0] * earlier[1] + later[1]]


def _clamp(later: list[np.ndarray], earlier: list[np.ndarray]) -> list[np.ndarray]:
    c, lo, hi = later
    bound = lambda x: np.minimum(hi, np.maximum(lo, x + c))
    return [earlier[0] + c, bound(earlier[1]), bound(earlier[2])]


@dataclass(frozen=True)
class Kind:
    compose: Callable[[list[np.ndarray], list[np.ndarray]], list[np.ndarray]]
    apply: Callable[[list[Column], Column], Column]
    size: int


AFFINE = Kind(_affine, lambda m, x: m[0] * x + m[1], 2)
CLAMP = Kind(_clamp, lambda m, x: F.least(m[2], F.greatest(m[1], x + m[0])), 3)


@dataclass(frozen=True)
class Track:
    """A state to follow: its kind, each row's map and the state before the first row."""

    kind: Kind
    maps: tuple[Column, ...]
    start: float = 0.0


def average(value: Column, alpha: float = 0.1, start: float = 0.0) -> Track:
    """The exponential average (1 - alpha) * state + alpha * value; a null value leaves the state."""
    return Track(AFFINE, (F.when(value.isNull(), 1.0).otherwise(1 - alpha), F.coalesce(alpha * value, F.lit(0.0))), start)


def total(value: Column) -> Track:
    """The sum so far."""
    return Track(AFFINE, (F.lit(1.0), F.coalesce(value.cast("double"), F.lit(0.0))))


def scan(maps: list[np.ndarray], first: np.ndarray, compose: Callable) -> list[np.ndarray]:
    """Running compositions in log2(n) steps; first[i] is where the group of row i starts."""
    at, shift = np.arange(len(first)), 1
    while shift < len(first):
        i = at[at - shift >= first]
        if not len(i):
            break
        new = compose([m[i] for m in maps], [m[i - shift] for m in maps])
        for m, v in zip(maps, new, strict=True):
            m[i] = v
        shift *= 2
    return maps


def _codes(column: pa.Array) -> np.ndarray:
    return column.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)


def running(df: DataFrame, key: list[str], order: list[str], tracks: dict[str, Track]) -> DataFrame:
    """df with a column for each track: the state after the row, in the order of `order` among rows of equal `key`.

    `order` must tell the rows of a key apart. A null key is a key, a null in
    the order comes first; an empty table gives an empty one.
    """
    names = {t: [f"__{t}_{i}" for i in range(track.kind.size)] for t, track in tracks.items()}
    made = [m.cast("double").alias(n) for t, track in tracks.items() for m, n in zip(track.maps, names[t], strict=True)]
    rows = df.select("*", *made).repartitionByRange(*key, *order).sortWithinPartitions(*key, *order)
    schema = rows.select("*", F.lit(0).alias("__part")).schema
    how = {t: track.kind.compose for t, track in tracks.items()}

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, carried = TaskContext.get().partitionId(), None, {}
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            new = np.zeros(n, bool)
            new[0] = True
            for c in key:
                codes = _codes(batch.column(c))
                new[1:] |= codes[1:] != codes[:-1]
            first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
            same = [batch.column(c)[0].as_py() for c in key] == last
            out = {}
            for t, joined in how.items():
                maps = [batch.column(c).to_numpy(zero_copy_only=False).copy() for c in names[t]]
                if same:
                    # the batch before ended in this key
                    for m, v in zip(maps, joined([m[:1] for m in maps], carried[t]), strict=True):
                        m[:1] = v
                maps = scan(maps, first, joined)
                carried[t] = [m[-1:] for m in maps]
                out |= dict(zip(names[t], map(pa.array, maps), strict=True))
            last = [batch.column(c)[n - 1].as_py() for c in key]
            columns = [out.get(c, batch.column(i)) for i, c in enumerate(batch.schema.names)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.full(n, part, np.int32))], [*batch.schema.names, "__part"])

    done = stored(rows.mapInArrow(compose, schema), "fold")
    every = [c for t in tracks for c in names[t]]
    ends = done.groupBy(*key, "__part").agg(F.max_by(F.struct(*every), F.struct(*order)).alias("m"))
    # a key has at most as many rows here as there are partitions
    before = Window.partitionBy(*key).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("before", F.collect_list("m").over(before))

    def state(t: str) -> Column:
        return F.aggregate("before", F.lit(tracks[t].start).cast("double"), lambda x, m: tracks[t].kind.apply([m[c] for c in names[t]], x))

    starts = ends.select(*[F.col(c).alias(f"__k_{c}") for c in key], F.col("__part").alias("__p"), *[state(t).alias(f"__s_{t}") for t in tracks])
    on = F.col("__part") == F.col("__p")
    for c in key:
        on = on & F.col(c).eqNullSafe(F.col(f"__k_{c}"))
    met = done.join(starts, on)
    return met.select(*df.columns, *[track.kind.apply([F.col(c) for c in names[t]], F.col(f"__s_{t}")).alias(t) for t, track in tracks.items()])


def final(df: DataFrame, key: list[str], order: list[str], tracks: dict[str, Track]) -> DataFrame:
    """The states after each key's last row, and n, its rows."""
    rows = running(df.select(*key, *order, *[F.struct(*track.maps).alias(f"__m_{t}") for t, track in tracks.items()]), key, order, {t: Track(track.kind, tuple(F.col(f"__m_{t}.{f}") for f in _fields(df, track)), track.start) for t, track in tracks.items()})
    return rows.groupBy(*key).agg(F.count("*").alias("n"), *[F.max_by(t, F.struct(*order)).alias(t) for t in tracks])


def _fields(df: DataFrame, track: Track) -> list[str]:
    return df.select(F.struct(*track.maps).alias("m")).schema["m"].dataType.names


def adaptive_threshold(df: DataFrame, key: list[str], order: list[str], fallback: Column, success: Column, start: float, target_fallback: float, target_success: float, rate: float, window: int = 50, least: int = 20) -> DataFrame:
    """df with n and threshold after each row.

    Once a key has `least` rows, the shares of fallbacks and successes over
    its last `window` rows move the threshold: up where there are more
    fallbacks than the target, down below four fifths of it, and up again
    where there are too few successes; it stays between 0 and 1.
    """
    sums = stored(running(df, key, order, {"n": total(F.lit(1)), "__f": total(fallback.cast("int")), "__s": total(success.cast("int"))}), "sums")
    old = sums.select(*[F.col(c).alias(f"__o_{c}") for c in key], (F.col("n") + window).alias("__o_n"), F.col("__f").alias("__o_f"), F.col("__s").alias("__o_s"))
    on = F.col("n") == F.col("__o_n")
    for c in key:
        on = on & F.col(c).eqNullSafe(F.col(f"__o_{c}"))
    rows = sums.join(old, on, "left")
    size = F.least("n", F.lit(float(window)))
    share = lambda c: (F.col(f"__{c}") - F.coalesce(f"__o_{c}", F.lit(0.0))) / size
    ready, free = F.col("n") >= least, float("inf")
    up, down = ready & (share("f") > target_fallback), ready & (share("f") < target_fallback * 0.8)
    poor = ready & (share("s") < target_success)
    c = F.when(up, rate).when(down, -rate).otherwise(0.0)
    lo, hi = F.when(down, 0.0).otherwise(-free), F.when(up, 1.0).otherwise(free)
    step = F.when(poor, rate).otherwise(0.0)
    top = lambda x: F.when(poor, F.least(F.lit(1.0), x + step)).otherwise(x)
    rows = rows.select(*df.columns, F.col("n").cast("long").alias("n"), (c + step).alias("__c"), top(lo).alias("__lo"), top(hi).alias("__hi"))
    out = running(rows, key, order, {"threshold": Track(CLAMP, (F.col("__c"), F.col("__lo"), F.col("__hi")), start)})
    return out.drop("__c", "__lo", "__hi")
