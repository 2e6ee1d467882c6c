"""Alerts that need a condition to last, are limited in rate and say when they end: state by rule, over a stream.

Rows of a rule wait until the watermark has passed them and are then taken
in the order of (time, sequence), so what comes out doesn't depend on how
rows are cut into batches, and a stream that is stopped goes on from its
checkpoint as if it hadn't been.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: State of this kind needs this store.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
OUT = "rule string, severity string, kind string, us long, seq long, value double"


@dataclass(frozen=True)
class Rule:
    """value `op` threshold, on rows whose columns have the labels' values, true for `lasts` seconds at least; one alert in `limit` seconds at most."""

    name: str
    op: str
    threshold: float
    severity: str = "warning"
    lasts: float = 0.0
    limit: float = 0.0
    labels: dict[str, object] = field(default_factory=dict)

    def holds(self, value: Column) -> Column:
        limit = F.lit(self.threshold)
        return {">": value > limit, ">=": value >= limit, "<": value < limit, "<=": value <= limit, "==": value == limit}[self.op]


def matched(events: DataFrame, rules: list[Rule], ts: str, seq: str, value: str) -> DataFrame:
    """(rule, at, us, seq, value, hit) for each row and each rule whose labels it has; rows without a value or time are left out."""
    x = F.col(value).cast("double")

    def one(rule: Rule) -> Column:
        # every condition names the time, or it would be moved before the watermark and hide rows from it
        fits = F.col(ts).isNotNull() & x.isNotNull()
        for column, wanted in rule.labels.items():
            fits = fits & (F.col(column) == F.lit(wanted))
        return F.when(fits, F.struct(F.lit(rule.name).alias("rule"), rule.holds(x).alias("hit")))

    found = events.select(F.col(ts).alias("at"), F.col(seq).cast("long").alias("seq"), x.alias("value"), F.explode(F.array_compact(F.array(*map(one, rules)))).alias("r"))
    return found.select("r.rule", "at", F.unix_micros("at").alias("us"), "seq", "value", "r.hit")


class Watch(StatefulProcessor):
    """One rule's state: since when its condition holds, its last alert, whether that is still on; and the rows that wait."""

    def __init__(self, rules: dict[str, Rule]):
        self.rules = rules

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "since long, last long, on boolean")
        self.waiting = handle.getListState("waiting", "us long, seq long, value double, hit boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        latest = None
        for part in rows:
            us = part["us"]
            self.waiting.appendList([tuple(r) for r in zip(us.tolist(), part["seq"].tolist(), part["value"].tolist(), part["hit"].tolist(), strict=True)])
            top = int(us.max()) // 1000 + 1
            latest = top if latest is None else max(latest, top)
        if latest is not None:
            self.handle.registerTimer(latest)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        rows = sorted(tuple(r) for r in self.waiting.get())
        ready = [r for r in rows if r[0] <= passed]
        if not ready:
            return
        self.waiting.put([r for r in rows if r[0] > passed]) if len(ready) < len(rows) else self.waiting.clear()
        rule = self.rules[key[0]]
        since, last, on = self.state.get() if self.state.exists() else (-1, -1, False)
        found = []
        for us, seq, value, hit in ready:
            if hit:
                since = us if since < 0 else since
                if us - since >= rule.lasts * 1e6 and (last < 0 or us - last >= rule.limit * 1e6):
                    last, on = us, True
                    found.append((rule.name, rule.severity, "alert", us, seq, value))
            else:
                if on:
                    found.append((rule.name, rule.severity, "recovered", us, seq, value))
                since, on = -1, False
        self.state.update((since, last, on))
        if found:
            yield pd.DataFrame(found, columns=["rule", "severity", "kind", "us", "seq", "value"])

    def close(self) -> None:
        pass


def watch(events: DataFrame, rules: list[Rule], ts: str = "ts", seq: str = "event_id", value: str = "value", late: str = "10 minutes") -> DataFrame:
    """(rule, severity, kind, at, seq, value): alerts, and `recovered` for the first row after an alert on which its condition fails.

    A condition holds since the first of its rows in a row; with `lasts`, an
    alert comes at the first row at least so much later. Alerts of a rule
    are `limit` seconds apart at least; the last alert counts after a
    recovery too. Rows up to `late` behind the latest one are put in order,
    later ones are left out. Rows come out once the watermark has passed
    them: a stream ends with a row that lies beyond all others (see closing()),
    and what still waits comes out with the batch after that row's.

    A rule is one key, as its order is one sequence; rows without a rule
    don't reach the shuffle. Needs the state store in STORE.
    """
    names = {r.name: r for r in rules}
    if len(names) < len(rules):
        raise ValueError("rules have different names")
    # the watermark is that of all rows, so a quiet rule's rows get through too
    rows = matched(events.withWatermark(ts, late), rules, ts, seq, value)
    found = rows.groupBy("rule").transformWithStateInPandas(Watch(names), outputStructType=OUT, outputMode="append", timeMode="EventTime")
    return found.select("rule", "severity", "kind", F.timestamp_micros("us").alias("at"), "seq", "value")


def watch_to(events: DataFrame, rules: list[Rule], path: str, checkpoint: str, late: str = "10 minutes") -> None:
    """Runs watch() over what a stream holds and stops; a later call with the same folders goes on from there."""
    spark = events.sparkSession
    former = {k: spark.conf.get(k, None) for k in STORE}
    for k, v in STORE.items():
        spark.conf.set(k, v)
    try:
        sink = watch(events, rules, late=late).writeStream.outputMode("append").format("parquet")
        sink.option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        for k, v in former.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def closing(events: DataFrame, ts: str, value: str, after: str = "366 days") -> DataFrame:
    """One row of the events' schema, without a value, beyond the latest of them."""
    last = events.agg((F.max(ts) + F.expr(f"interval {after}")).alias(ts))
    return last.select(*[F.col(c) if c == ts else F.lit(None).cast(kind).alias(c) for c, kind in events.dtypes])
