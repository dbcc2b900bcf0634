"""Results out: Parquet with nested columns, flat CSV, verdict id lists. A run never overwrites another."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

NESTED = (T.StructType, T.ArrayType, T.MapType)


def flat_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if not isinstance(f.dataType, NESTED)]


def write_result(
    df: DataFrame, root: str, run: str, partition_by: Sequence[str] = (), csv: bool = True
) -> dict[str, str]:
    """<root>/<run>/parquet and <root>/<run>/csv (nested columns dropped), and the run named in <root>/latest.

    An existing run is an error, not overwritten. The CSV is made from the written Parquet, so the
    plan runs once.
    """
    spark = df.sparkSession
    paths = {"parquet": f"{root}/{run}/parquet"}
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(paths["parquet"])
    if csv:
        paths["csv"] = f"{root}/{run}/csv"
        back = spark.read.parquet(paths["parquet"])
        back.select(*flat_columns(back)).write.mode("errorifexists").option("header", True).csv(paths["csv"])
    spark.createDataFrame([(run,)], "run string").coalesce(1).write.mode("overwrite").text(f"{root}/latest")
    return paths


def latest_run(spark: SparkSession, root: str) -> str:
    return spark.read.text(f"{root}/latest").first()[0]


def write_verdict_lists(df: DataFrame, path: str, id_col: str = "CompanyID", verdict_col: str = "recommendation") -> DataFrame:
    """One sorted id list per verdict (a folder each), and the counts.

    Rows are range-partitioned by (verdict, id), so a large verdict is many files, each in order.
    """
    ids = df.select(F.col(verdict_col), F.col(id_col).cast("string").alias("value"))
    ids.repartitionByRange(verdict_col, "value").sortWithinPartitions(verdict_col, "value").write.mode(
        "errorifexists").partitionBy(verdict_col).text(path)
    return df.groupBy(verdict_col).agg(F.count(F.lit(1)).alias("n"))
