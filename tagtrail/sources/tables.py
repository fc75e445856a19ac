"""Scans of sensor tables."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, functions as F

from tagtrail.functions.text import slug
from tagtrail.session import finite


def sensor_table(raw: DataFrame, on_bad_ts: str = "fail", ts: str = "Timestamp") -> DataFrame:
    """Wide sensor table with a parsed ``Timestamp``.

    ``on_bad_ts``: ``fail`` raises on a time that cannot be parsed, ``drop`` leaves the row out.
    """
    if ts not in raw.columns:
        raise ValueError(f"column {ts} is missing")
    parsed = F.col(ts).try_cast("timestamp_ntz")
    if on_bad_ts == "drop":
        return raw.withColumn(ts, parsed).where(F.col(ts).isNotNull())
    if on_bad_ts == "fail":
        bad = F.raise_error(F.concat(F.lit("bad timestamp: "), F.coalesce(F.col(ts).cast("string"), F.lit("null"))))
        return raw.withColumn(ts, F.when(parsed.isNotNull(), parsed).otherwise(bad.cast("timestamp_ntz")))
    raise ValueError("on_bad_ts must be fail or drop")


def finite_numbers(df: DataFrame) -> DataFrame:
    """NaN and infinities of every floating column become null."""
    kinds = dict(df.dtypes)
    return df.select(*(finite(F.col(c)).alias(c) if kinds[c] in ("double", "float") else F.col(c) for c in df.columns))


def table_folder(spark: SparkSession, paths: dict[str, str]) -> Iterator[tuple[str, DataFrame, bool]]:
    """Each parquet table of a set as ``(name, rows, is_empty)``."""
    for name in sorted(paths):
        df = spark.read.parquet(paths[name])
        yield name, df, df.isEmpty()


def persist_sheets(spark: SparkSession, paths: dict[str, str], out: str) -> DataFrame:
    """Write every non-empty table under ``out`` and report ``sheet, slug, columns, is_empty``."""
    report = []
    for name, df, empty in table_folder(spark, paths):
        if not empty:
            df.write.mode("overwrite").parquet(f"{out}/{name}")
        report.append((name, len(df.columns), empty))
    found = spark.createDataFrame(report, "sheet string, columns int, is_empty boolean")
    return found.withColumn("slug", slug(F.col("sheet")))
