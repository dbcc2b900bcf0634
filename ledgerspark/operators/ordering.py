"""Slices of a global order and samples in hash order, without sorting everything in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerspark.session import materialise

HASH_DIGITS = 3


def slice_in_order(df: DataFrame, order_by: Sequence[str], offset: int = 0, limit: int | None = None) -> tuple[DataFrame, int]:
    """Rows offset .. offset + limit of df in ascending order of the columns, and the number of all rows.

    The rows are range-partitioned and written once; the driver gets one count per range. Whole ranges inside the slice are
    taken as they are, and only the two ranges at its ends are numbered. Equal rows are told apart by their place, so many
    of them spread over ranges like others.
    """
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [*order_by, "_place"]
    placed = df.withColumn("_place", F.monotonically_increasing_id()).repartitionByRange(ranges, *order)
    placed = materialise(placed.withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = sorted((r["_range"], r["count"]) for r in placed.groupBy("_range").count().collect())
    total = sum(n for _, n in sizes)
    stop = total if limit is None else min(total, offset + limit)
    whole, ends, before = [], [], 0
    for part, n in sizes:
        first, last = max(offset - before, 0), min(stop - before, n)
        if first < last:
            (whole if (first, last) == (0, n) else ends).append((part, first, last))
        before += n
    out = placed.filter(F.col("_range").isin([p for p, _, _ in whole])) if whole else placed.filter(F.lit(False))
    for part, first, last in ends:
        number = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
        cut = placed.filter(F.col("_range") == part).withColumn("_n", number).filter(F.col("_n").between(first + 1, last))
        out = out.unionByName(cut.drop("_n"))
    return out.drop("_place", "_range"), total


def first_by_hash(df: DataFrame, key: Column, n: int | Column, strata: Sequence[str] = (), ties: Sequence[str] = ()) -> DataFrame:
    """The first n rows in order of a hexadecimal hash, per stratum if any are named.

    Rows are counted per leading digits of the hash (even groups), the counts are summed up, and only the one group per
    stratum in which the n-th row lies is sorted. n may be a column of the strata's counts, which have _size.
    """
    strata = list(strata)
    hashed = df.withColumn("_hash", key).withColumn("_lead", F.substring("_hash", 1, HASH_DIGITS))
    counts = hashed.groupBy(*strata, "_lead").agg(F.count(F.lit(1)).alias("_n"))
    base = Window.partitionBy(*strata) if strata else Window.partitionBy(F.lit(0))  # 16 ** HASH_DIGITS rows per stratum
    before = F.coalesce(F.sum("_n").over(base.orderBy("_lead").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    wanted = F.lit(n) if isinstance(n, int) else n
    room = counts.withColumns({"_before": before, "_size": F.sum("_n").over(base)}).withColumn("_left", wanted - F.col("_before"))
    room = room.filter("_left > 0").select(*[F.col(c).alias(f"_s{i}") for i, c in enumerate(strata)], F.col("_lead").alias("_l"), "_n", "_left")
    same = F.col("_lead") == F.col("_l")
    for i, c in enumerate(strata):
        same = same & F.col(c).eqNullSafe(F.col(f"_s{i}"))
    near = hashed.join(room, same)
    whole = near.filter("_n <= _left")
    rank = F.row_number().over(Window.partitionBy(*strata, "_lead").orderBy("_hash", *ties))
    cut = near.filter("_n > _left").withColumn("_rank", rank).filter("_rank <= _left").drop("_rank")
    return whole.unionByName(cut).select(*df.columns)
