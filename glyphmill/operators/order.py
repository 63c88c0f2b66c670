"""Global positions without a global window: rows are range-partitioned and sorted, numbered within
their partition, and the partitions' offsets (one small row each) are added."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.tables import SharedTable, shuffle_partitions


def enumerated(df: DataFrame, name: str = "pos", keep: list[SharedTable] | None = None) -> DataFrame:
    """``df``, kept in the shared folder, with the 0-based number of each row: partitions follow each other,
    rows in the order of their partition. ``keep`` receives the table, to be dropped when done with."""
    table = SharedTable(df.withColumn("__at", F.monotonically_increasing_id()))
    if keep is not None:
        keep.append(table)
    kept = table.df.withColumn("__part", F.shiftright("__at", 33)).withColumn("__row", F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = kept.groupBy("__part").agg(F.count("*").alias("__n"))
    # one row a partition
    before = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    return kept.join(F.broadcast(before), "__part").withColumn(name, F.col("__before") + F.col("__row")).drop("__part", "__at", "__row", "__before")


def numbered(df: DataFrame, order: list[Column], name: str = "pos", keep: list[SharedTable] | None = None) -> DataFrame:
    """``df`` with the 0-based position of each row in ``order`` (ties: in any fixed order)."""
    ranged = df.repartitionByRange(shuffle_partitions(df.sparkSession), *order).sortWithinPartitions(*order)
    return enumerated(ranged, name, keep)


def cumulative(df: DataFrame, order: list[Column], weight: str, name: str = "upto") -> DataFrame:
    """``df`` with the sum of ``weight`` up to and with each row in ``order``: running sums in each range, and
    what the ranges before hold (one row a range)."""
    ranged = df.repartitionByRange(shuffle_partitions(df.sparkSession), *order).sortWithinPartitions(*order)
    kept = SharedTable(ranged.withColumn("__at", F.monotonically_increasing_id())).df.withColumn("__part", F.shiftright("__at", 33))
    sums = kept.groupBy("__part").agg(F.sum(weight).alias("__n"))
    before = sums.select("__part", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    here = F.sum(weight).over(Window.partitionBy("__part").orderBy("__at").rowsBetween(Window.unboundedPreceding, 0))
    return kept.join(F.broadcast(before), "__part").withColumn(name, F.col("__before") + here).drop("__part", "__at", "__before")


def strided(df: DataFrame, order: list[Column], show: int) -> DataFrame:
    """Every max(1, n // max(1, show))-th row from the first on."""
    n = df.count()
    step = max(1, n // max(1, show))
    return numbered(df, order, "__pos").where(F.col("__pos") % step == 0).drop("__pos")


def seeded(df: DataFrame, key: Column, seed: int) -> DataFrame:
    """A shuffle that depends on key and seed only: same seed, same order; any seed, same rows."""
    return df.withColumn("__draw", F.xxhash64(F.lit(seed), key)).orderBy("__draw", key).drop("__draw")


def seeded_positions(df: DataFrame, key: Column, seed: int, name: str = "pos") -> DataFrame:
    """``df`` with the 0-based position of each row in the order of ``seeded``."""
    drawn = df.withColumn("__draw", F.xxhash64(F.lit(seed), key)).withColumn("__key", key)
    return numbered(drawn, [F.col("__draw"), F.col("__key")], name).drop("__draw", "__key")


def batches(df: DataFrame, order: list[Column], size: int, partial: bool, pos: str | None = None, max_batches: int | None = None) -> DataFrame:
    """``df`` with its batch number (and its position as ``pos``); without ``partial`` the ragged last batch is dropped;
    ``max_batches`` keeps the first."""
    d = numbered(df, order, "__pos").withColumn("batch", F.floor(F.col("__pos") / size).cast("bigint"))
    if not partial:
        d = d.where(F.col("batch") < F.lit(df.count() // size))
    if max_batches is not None:
        d = d.where(F.col("batch") < max_batches)
    return d.drop("__pos") if pos is None else d.withColumnRenamed("__pos", pos)
