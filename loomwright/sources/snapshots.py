"""Versions of a table in a store that keeps each distinct row once.

    path/rows/version=3        digest and columns of rows that no version before had
    path/versions/version=3    key and digest of every row of the version
    path/log/version=3         name and number of rows; written last, so a version without it doesn't exist

A version costs its changed rows and a digest for each other row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def digest(columns: list[str]) -> F.Column:
    """SHA-256 of a row's values, by name."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


class Snapshots:
    """A store at `path` of rows that `key` names; a null key is a row like others, of repeated keys one row is kept (the least digest)."""

    def __init__(self, spark: SparkSession, path: str, key: str):
        self.spark, self.path, self.key = spark, path, key

    # ---- versions

    def versions(self) -> DataFrame:
        """(version, name, n) of all versions, the oldest first."""
        if not self._exists("log"):
            return self.spark.createDataFrame([], "version int, name string, n long")
        return self.spark.read.schema("name string, n long, version int").parquet(f"{self.path}/log").select("version", "name", "n").orderBy("version")

    def create(self, df: DataFrame, name: str) -> int:
        """Stores the table as a new version and returns its number."""
        number = max([r.version for r in self.versions().collect()] + self._numbers("versions") + self._numbers("rows"), default=0) + 1
        rows = df.withColumn("__digest", digest(df.columns))
        place = rows.groupBy(self.key).agg(F.min("__digest").alias("__digest"))
        place.write.parquet(f"{self.path}/versions/version={number}")
        listed = self.spark.read.parquet(f"{self.path}/versions/version={number}")
        new = rows.join(listed.select("__digest").distinct(), "__digest", "left_semi").dropDuplicates(["__digest"])
        stored = self._rows()
        if stored is not None:
            new = new.join(stored.select("__digest"), "__digest", "left_anti")
        new.write.parquet(f"{self.path}/rows/version={number}")
        self.spark.createDataFrame([(name, listed.count())], "name string, n long").coalesce(1).write.parquet(f"{self.path}/log/version={number}")
        return number

    def restore(self, version: int) -> DataFrame:
        """The table as it was."""
        self._check(version)
        listed = self.spark.read.parquet(f"{self.path}/versions/version={version}")
        return self._rows().join(listed.select("__digest").distinct(), "__digest", "left_semi").drop("__digest")

    def delete(self, version: int) -> None:
        """Forgets a version; its rows stay until vacuum()."""
        self._check(version)
        for part in ("log", "versions"):
            self._remove(f"{part}/version={version}")

    def vacuum(self) -> int:
        """Removes rows that no version lists any more, and leftovers of versions that weren't finished; returns the number of rows."""
        known = [r.version for r in self.versions().collect()]
        for number in set(self._numbers("versions")) - set(known):
            self._remove(f"versions/version={number}")
        gone = 0
        listed = None
        for number in known:
            rows = self.spark.read.parquet(f"{self.path}/versions/version={number}").select("__digest")
            listed = rows if listed is None else listed.union(rows)
        for number in self._numbers("rows"):
            rows = self.spark.read.parquet(f"{self.path}/rows/version={number}")
            live = rows.join(listed.distinct(), "__digest", "left_semi") if listed is not None else rows.limit(0)
            kept, n = live.count(), rows.count()
            if kept < n:
                # written beside, then put in place: a reader finds one of both
                live.write.mode("overwrite").parquet(f"{self.path}/rows.new/version={number}")
                self._remove(f"rows/version={number}")
                self._rename(f"rows.new/version={number}", f"rows/version={number}")
                gone += n - kept
        return gone

    # ---- going back

    def rollback(self, current: DataFrame, version: int) -> DataFrame:
        """The current table with every row of the version put back; rows that came after it stay."""
        old = self.restore(version)
        later = current.join(old.select(F.col(self.key).alias("__key")), F.col(self.key).eqNullSafe(F.col("__key")), "left_anti")
        return old.select(current.columns).union(later)

    def rollback_plan(self, current: DataFrame, version: int) -> DataFrame:
        """What rollback() would do, without doing it: (action, n) of rows that would be restored, replaced, unchanged or kept as later ones."""
        old = self.restore(version)
        now = current.select(F.col(self.key).alias("__k"), digest(current.columns).alias("__now"), F.lit(True).alias("__here"))
        then = old.select(F.col(self.key).alias("__o"), digest(current.columns).alias("__then"), F.lit(True).alias("__there"))
        both = now.join(then, F.col("__k").eqNullSafe(F.col("__o")), "full")
        action = F.when(F.col("__here").isNull(), "restored").when(F.col("__there").isNull(), "kept").when(F.col("__now") == F.col("__then"), "unchanged").otherwise("replaced")
        return both.groupBy(action.alias("action")).agg(F.count("*").alias("n"))

    def rollback_row(self, current: DataFrame, version: int, key) -> DataFrame:
        """The current table with one row of the version put back; unknown keys change nothing."""
        old = self.restore(version).where(F.col(self.key) == F.lit(key))
        rest = current.join(old.select(F.col(self.key).alias("__key")), F.col(self.key) == F.col("__key"), "left_anti")
        return old.select(current.columns).union(rest)

    # ---- files

    def _rows(self) -> DataFrame | None:
        """Stored rows of finished versions and deleted ones; columns that a version lacks are null."""
        numbers = self._numbers("rows")
        done = self.versions().collect()
        last = max((r.version for r in done), default=0)
        paths = [f"{self.path}/rows/version={n}" for n in numbers if n <= last]
        return self.spark.read.option("mergeSchema", True).parquet(*paths).dropDuplicates(["__digest"]) if paths and done else None

    def _check(self, version: int) -> None:
        if self.versions().where(F.col("version") == version).isEmpty():
            raise ValueError(f"there is no version {version}")

    def _at(self, part: str):
        jvm, conf = self.spark._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{part}")
        return path.getFileSystem(conf), path

    def _exists(self, part: str) -> bool:
        fs, path = self._at(part)
        return fs.exists(path)

    def _numbers(self, part: str) -> list[int]:
        if not self._exists(part):
            return []
        fs, path = self._at(part)
        names = [f.getPath().getName() for f in fs.listStatus(path)]
        return sorted(int(n.removeprefix("version=")) for n in names if n.startswith("version="))

    def _remove(self, part: str) -> None:
        fs, path = self._at(part)
        fs.delete(path, True)

    def _rename(self, part: str, to: str) -> None:
        fs, path = self._at(part)
        fs.rename(path, self._at(to)[1])
