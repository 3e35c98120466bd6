"""Changed rows per micro-batch, merged with the base snapshot on reading.

A micro-batch writes only the rows it changed, into a folder named by its id.
Running a batch again overwrites the same folder, so replays change nothing,
and the large base is rewritten only by ``compact``. Base and changes lie in
parts by name hash: a batch reads the parts its names fall into, no others.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assetloom.operators.maintenance import COLUMNS
from assetloom.operators.ranking import PLACE, at_places, latest_stored, placed

_BEFORE_FIRST = -1
# Parts of a log unless it is told otherwise; a batch of few names reads few of them.
PARTS = 64


@dataclass(frozen=True)
class ChangeLog:
    """``base`` and the changes below ``path``, both with a column ``part``; made by ``ChangeLog.over``."""

    path: str
    base: DataFrame
    parts: int

    @staticmethod
    def over(path: str, functions: DataFrame, parts: int = PARTS) -> ChangeLog:
        """Lay ``functions`` out as the base of a new log below ``path``.

        Adaptive execution splits a part that is too large for one file. An
        empty first entry of changes keeps reading from meeting a missing folder.
        """
        spark, target = functions.sparkSession, f"{path}/base"
        laid = functions.withColumn("part", part_of(F.col("name"), parts))
        laid.hint("rebalance", "part").write.mode("errorifexists").partitionBy("part").parquet(target)
        log = ChangeLog(path, spark.read.schema(laid.schema).parquet(target), parts)
        log._put(_BEFORE_FIRST, log.base.limit(0))
        return log

    def _folder(self, batch_id: int) -> str:
        return f"{self.path}/changes/batch={batch_id}"

    def _put(self, batch_id: int, rows: DataFrame) -> None:
        # An empty batch leaves no part folder, but its own. As in the base, a part too large for one task is split.
        dealt = rows.withColumn("part", part_of(F.col("name"), self.parts)).hint("rebalance", "part")
        dealt.write.mode("overwrite").partitionBy("part").parquet(self._folder(batch_id))

    def write(self, batch_id: int, rows: DataFrame) -> DataFrame:
        """Log the rows a batch changed; give them back as they are stored."""
        self._put(batch_id, rows.select(*self._columns()))
        reader = self.base.sparkSession.read.schema(self.base.schema).option("basePath", self._folder(batch_id))
        return reader.parquet(self._folder(batch_id)).select(*self._columns())

    def _columns(self) -> list[str]:
        return [c for c in self.base.columns if c != "part"]

    def touched(self, names: DataFrame) -> list[int]:
        """The parts that hold any of ``names``; ``parts`` numbers at most."""
        found = names.select(part_of(F.col("name"), self.parts).alias("part")).distinct()
        return sorted(r.part for r in found.collect())

    def changes(self, before: int | None = None, parts: list[int] | None = None) -> DataFrame:
        """Every logged row with its ``batch``; only earlier batches and only some parts when asked."""
        schema = self.base.select(*self._columns(), F.lit(0).alias("batch"), F.lit(0).alias("part")).schema
        folder = f"{self.path}/changes"
        rows = self.base.sparkSession.read.schema(schema).option("basePath", folder).parquet(folder)
        rows = rows if before is None else rows.filter(F.col("batch") < before)
        return rows if parts is None else rows.filter(F.col("part").isin(parts))

    def compact(self, folder: str) -> ChangeLog:
        """Write what stands now as a new log below ``folder``, without changes.

        Call it between runs of the stream: later batches go to the new log.
        """
        return ChangeLog.over(folder, self.current(), self.parts)

    def current(self, before: int | None = None, names: DataFrame | None = None) -> DataFrame:
        """The functions table as it stands after the logged batches.

        With ``names``, only the parts these fall into are read: rows of all of
        ``names`` and of some others. Of the changes of one asset the last batch
        is found from names and batches, and replaced rows of the base from
        names; only then are whole rows read, and none of them moves.
        """
        parts = None if names is None else self.touched(names)
        changes = self.changes(before, parts)
        last = latest_stored(changes, "true", "name", "batch", label="change-places").drop("batch", "part")
        base = placed(self.base if parts is None else self.base.filter(F.col("part").isin(parts)))
        gone = base.select("name", *PLACE).join(changes.select("name"), "name", "left_semi")
        kept = at_places(base, gone.select(*PLACE), "gone-places", there=False)
        return kept.select(*COLUMNS).unionByName(last.select(*COLUMNS))


def part_of(name: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(name), F.lit(parts)).cast("int")
