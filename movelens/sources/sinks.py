"""Writing results: stage tables, exports, fitted statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from movelens.functions.numeric import nan_to_null


def write_stage(df: DataFrame, path: str, columns: Sequence[str], by: str, partition_year: bool = True) -> None:
    """A stage's table with fixed columns, partitioned by year and sorted within files.

    Rows of a year go to as many tasks as their volume asks for: the split by
    year only groups files, it does not bring a year's rows together.
    """
    out = df.select(*columns)
    if partition_year:
        out = out.withColumn("year", F.year(by)).sortWithinPartitions("year", by)
        out.write.mode("overwrite").partitionBy("year").parquet(path)
    else:
        out.sortWithinPartitions(by).write.mode("overwrite").parquet(path)


def export_csv(df: DataFrame, path: str, order: Sequence[Column] | None = None) -> None:
    """The whole result as CSV files with a header, in order over the files; no page limit."""
    (df.orderBy(*order) if order else df).write.mode("overwrite").option("header", True).csv(path)


def save_fitted(tables: dict[str, DataFrame], path: str) -> None:
    """Fitted statistics, one Parquet table each."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path.rstrip('/')}/{name}")


def load_fitted(spark: SparkSession, path: str, names: Sequence[str]) -> dict[str, DataFrame]:
    """The tables written by :func:`save_fitted`."""
    return {n: spark.read.parquet(f"{path.rstrip('/')}/{n}") for n in names}


def as_json(df: DataFrame, out: str = "json") -> DataFrame:
    """Rows as JSON documents; NaN becomes null, and nulls are kept."""
    clean = [
        (nan_to_null(F.col(f.name)) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name)).alias(f.name)
        for f in df.schema.fields
    ]
    return df.select(F.to_json(F.struct(*clean), {"ignoreNullFields": "false"}).alias(out))
