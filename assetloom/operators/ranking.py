"""Row numbers inside groups that may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assetloom.session import cut_lineage


def ranked(df: DataFrame, group: list[str], order: list[str], label: str) -> DataFrame:
    """Add ``rank`` (from 1) by ``order`` within ``group``, splitting hot groups.

    Rows are range-partitioned on group *and* order, so a hot group is spread
    over many tasks. Each slice is numbered on its own and shifted by the sizes
    of the group's earlier slices; only those sizes (at most one per group and
    slice) meet in one place.
    """
    sliced = df.repartitionByRange(*group, *order).withColumn("_slice", F.spark_partition_id())
    sliced = cut_lineage(sliced, label)
    keys = [*group, "_slice"]
    before = Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    shifts = (
        sliced.groupBy(*keys).count().withColumn("_shift", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    )
    within = Window.partitionBy(*keys).orderBy(*order)
    numbered = sliced.withColumn("_rn", F.row_number().over(within)).join(shifts, keys)
    return numbered.withColumn("rank", F.col("_rn") + F.col("_shift")).drop("_slice", "_rn", "_shift")


def running_total(df: DataFrame, group: list[str], order: list[str], amount: str, label: str) -> DataFrame:
    """Add ``before``: the sum of ``amount`` over the earlier rows of the group, hot groups split as in ``ranked``."""
    sliced = df.repartitionByRange(*group, *order).withColumn("_slice", F.spark_partition_id())
    sliced = cut_lineage(sliced, label)
    keys = [*group, "_slice"]
    earlier = Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sliced.groupBy(*keys).agg(F.sum(amount).alias("_total"))
    shifts = shifts.select(*keys, F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_shift"))
    within = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = sliced.withColumn("_own", F.coalesce(F.sum(amount).over(within), F.lit(0))).join(shifts, keys)
    return placed.withColumn("before", F.col("_own") + F.col("_shift")).drop("_slice", "_own", "_shift")


def latest(df: DataFrame, key: str, order: list) -> DataFrame:
    """Last row per key. Partial aggregation folds hot keys before the shuffle."""
    rest = [c for c in df.columns if c != key]
    winner = F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(key).agg(winner).select(*[key if c == key else F.col(f"_row.{c}").alias(c) for c in df.columns])


PLACE = ["_file", "_row"]
_BITS = 32768  # of one of Spark's bitmaps
_COPIED = 16384  # bitmaps copied to all tasks: 64 MiB, for up to 500 million rows


def placed(stored: DataFrame) -> DataFrame:
    """The rows of a written table with their place in its files."""
    return stored.select(*stored.columns, F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))


def at_places(numbered: DataFrame, places: DataFrame, label: str, there: bool = True) -> DataFrame:
    """The ``placed`` rows whose place is among ``places``, or those whose place is not; whole rows stay where they are.

    Places become bitmaps, a bit a row, which are written first. Bitmaps too
    many to be copied to all tasks meet the rows by a shuffle.
    """
    number, position = F.col("_row") + 1, F.pmod(F.col("_row"), F.lit(_BITS))
    bits = places.groupBy("_file", F.bitmap_bucket_number(number).alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(number)).alias("_bits"))
    bits = cut_lineage(bits.withColumnsRenamed({"_file": "_in", "_bucket": "_at"}), label)
    bits = F.broadcast(bits) if bits.count() <= _COPIED else bits
    met = numbered.join(bits, (F.col("_file") == F.col("_in")) & (F.bitmap_bucket_number(number) == F.col("_at")), "left")
    byte = F.conv(F.hex(F.substring("_bits", F.floor(position / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    named = F.coalesce(F.getbit(byte, (position % 8).cast("int")) == 1, F.lit(False))
    return met.filter(named if there else ~named).select(*numbered.columns)


def latest_stored(stored: DataFrame, condition: str, key: str, order: str | list, label: str | None = None) -> DataFrame:
    """Of the rows of a written table that meet ``condition``, the last per key; of equal ones any, but one.

    The winner is found from key, order and place in the files alone; only then
    are whole rows read, and met by a semi-join. With a ``label`` they are found
    by ``at_places``, so that whole rows do not move.
    """
    numbered = placed(stored.filter(condition))
    best = numbered.groupBy(key).agg(F.max(F.struct(*([order] if isinstance(order, str) else order), *PLACE)).alias("_best"))
    winner = best.select("_best._file", "_best._row")
    if label is not None:
        return at_places(numbered, winner, label).select(*stored.columns)
    return numbered.join(winner, PLACE, "left_semi").select(*stored.columns)
