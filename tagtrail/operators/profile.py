"""Column, timestamp and sheet profiles of a table, and the evidence they give about its sensors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tagtrail.functions.tags import family_by_pattern, family_by_pattern_or_prefix
from tagtrail.operators.ordering import exact_quantiles, with_blocks, with_position
from tagtrail.session import finite, staged

# Fixed values of the profile.
TIMESTAMP_NAMES = ["timestamp", "time", "datetime", "date"]
SAMPLE_VALUES = 5
HEAD_ROWS = 1000
TOP_INTERVALS = 5
MEAN_FLOOR = 1e-12


def numeric_columns(df: DataFrame, skip: Sequence[str] = ("Timestamp", "ts")) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in skip]


def unpivot_sensors(df: DataFrame, ids: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Wide table to ``ids, tag, value``."""
    return df.select(*ids, *(finite(F.col(c)).alias(c) for c in columns)).unpivot(
        list(ids), list(columns), "tag", "value"
    )


def to_number(text: Column) -> Column:
    """Text to double; what is no finite number becomes null."""
    return finite(text.try_cast("double"))


def numeric_profile(readings: DataFrame) -> DataFrame:
    """Per tag: min, max, mean, sample deviation, median and 1 % / 99 % quantiles of the non-null values."""
    basics = readings.groupBy("tag").agg(
        F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
    )
    named = {"median": 0.5, "q01": 0.01, "q99": 0.99}
    return basics.join(exact_quantiles(readings, ["tag"], "value", named), "tag", "left")


def column_profile(df: DataFrame, order: Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """One row per column: type, missing and distinct counts, first values in ``order``, family hint."""
    columns = list(columns or df.columns)
    cells = df.select(*(F.col(c).cast("string").alias(c) for c in columns)).unpivot([], columns, "column", "cell")
    counts = cells.groupBy("column").agg(
        F.count("*").alias("rows"), F.count("cell").alias("filled"), F.countDistinct("cell").alias("unique_count")
    )
    samples = _first_values(df, order, columns)
    kinds = {f.name: f.dataType for f in df.schema}
    dtype = F.create_map(*(F.lit(x) for c in columns for x in (c, kinds[c].simpleString())))
    numeric = F.array(*(F.lit(c) for c in columns if isinstance(kinds[c], T.NumericType)), F.lit(""))
    missing = F.col("rows") - F.col("filled")
    return counts.join(samples, "column", "left").select(
        "column",
        dtype[F.col("column")].alias("dtype"),
        F.array_contains(numeric, F.col("column")).alias("is_numeric"),
        missing.alias("missing_count"),
        (missing / F.col("rows")).alias("missing_fraction"),
        "unique_count",
        F.coalesce("sample_values", F.array().cast("array<string>")).alias("sample_values"),
        family_by_pattern_or_prefix(F.col("column")).alias("tag_family_hint"),
        "rows",
    )


def _first_values(df: DataFrame, order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """``column, sample_values``: the first non-null values of each column as text, in ``order``.

    The first rows of the table hold them for most columns; only a column with too few there is searched by itself.
    """
    text = df.select(
        F.struct(*order).alias("_at"), *(F.col(c).cast("string").alias(c) for c in columns)
    )
    head = staged(text.orderBy("_at").limit(HEAD_ROWS), "head")
    filled = head.agg(F.count("*").alias("_rows"), *(F.count(F.col(f"`{c}`")).alias(c) for c in columns)).first()
    cells = head.unpivot(["_at"], list(columns), "column", "cell").where(F.col("cell").isNotNull())
    for c in columns:
        if filled["_rows"] == HEAD_ROWS and filled[c] < SAMPLE_VALUES:
            found = text.where(F.col(f"`{c}`").isNotNull()).orderBy("_at").limit(SAMPLE_VALUES)
            cells = cells.where(F.col("column") != c).unionByName(
                found.select("_at", F.lit(c).alias("column"), F.col(f"`{c}`").alias("cell"))
            )
    first = F.slice(F.array_sort(F.collect_list(F.struct("_at", "cell"))), 1, SAMPLE_VALUES)
    return cells.groupBy("column").agg(first.alias("found")).select("column", F.col("found")["cell"].alias("sample_values"))


def timestamp_candidates(profile: DataFrame) -> DataFrame:
    """Columns whose trimmed, lowercased name says they hold the time."""
    return profile.where(F.lower(F.trim("column")).isin(TIMESTAMP_NAMES)).select("column")


def sheet_profile(profile: DataFrame) -> DataFrame:
    """Roll-up of a column profile to one row."""
    return profile.agg(
        F.max("rows").alias("rows"),
        F.count("*").alias("columns"),
        F.count_if("is_numeric").alias("numeric_column_count"),
        F.count_if(~F.col("is_numeric")).alias("non_numeric_column_count"),
        F.sum("missing_count").alias("total_missing_cells"),
    )


def sensor_profile(profile: DataFrame, statistics: DataFrame) -> DataFrame:
    """Flat table of the numeric columns: their column profile and statistics."""
    return profile.where("is_numeric").join(
        statistics.withColumnRenamed("tag", "column"), "column", "left"
    ).select(
        F.col("column").alias("tag"), "tag_family_hint", "dtype", "missing_count", "missing_fraction", "unique_count",
        "min", "max", "mean", "std", "median", "q01", "q99",
    )


def series_profile(readings: DataFrame) -> DataFrame:
    """Column profile of long readings: one row per tag."""
    first = Window.partitionBy("tag").orderBy("ts", "rid")
    samples = (
        readings.where(F.col("value").isNotNull())
        .withColumn("place", F.row_number().over(first))
        .where(F.col("place") <= SAMPLE_VALUES)
        .groupBy("tag")
        .agg(F.sort_array(F.collect_list(F.struct("place", "value"))).alias("found"))
        .select("tag", F.col("found.value").alias("sample_values"))
    )
    missing = F.col("row_count") - F.col("filled")
    return (
        readings.groupBy("tag")
        .agg(F.count("*").alias("row_count"), F.count("value").alias("filled"),
             F.countDistinct("value").alias("unique_count"))
        .join(samples, "tag", "left")
        .select(
            "tag", family_by_pattern(F.col("tag")).alias("tag_family_hint"), F.lit("double").alias("data_type"),
            F.lit(True).alias("numeric"), "row_count", missing.alias("missing_count"),
            (missing / F.col("row_count")).alias("missing_fraction"), "unique_count",
            F.coalesce("sample_values", F.array().cast("array<double>")).alias("sample_values"),
        )
    )


def sensor_evidence(readings: DataFrame) -> DataFrame:
    """Profile, statistics and relative deviation of each sensor (null when the mean is about zero)."""
    size = F.abs("mean")
    return series_profile(readings).join(numeric_profile(readings), "tag", "left").withColumn(
        "relative_std", F.when(size > MEAN_FLOOR, F.col("std") / size)
    )


def family_counts(sensors: DataFrame) -> DataFrame:
    """Sensors per family, those without one under ``UNKNOWN``."""
    return sensors.groupBy(F.coalesce("tag_family_hint", F.lit("UNKNOWN")).alias("family")).agg(
        F.count("*").alias("sensors")
    )


def intervals(df: DataFrame, keys: Sequence[str], ts: str = "ts") -> DataFrame:
    """Microseconds between neighbouring non-null timestamps, per group, with their counts.

    Equal timestamps are counted first and give intervals of 0; only distinct ones are put in order.
    """
    times = df.where(F.col(ts).isNotNull()).groupBy(*keys, ts).agg(F.count("*").alias("copies"))
    placed = with_position(times, keys, [ts])
    by_pos = Window.partitionBy(*keys, "block").orderBy("pos")
    gap = F.timestamp_diff("MICROSECOND", F.lag(ts).over(by_pos), F.col(ts))
    steps = (
        with_blocks(placed, 1)
        .withColumn("interval_us", gap)
        .where(~F.col("halo") & F.col("interval_us").isNotNull())
        .select(*keys, "interval_us", F.lit(1).cast("bigint").alias("n"))
    )
    same = placed.where("copies > 1").select(*keys, F.lit(0).cast("bigint").alias("interval_us"), (F.col("copies") - 1).alias("n"))
    return steps.unionByName(same).groupBy(*keys, "interval_us").agg(F.sum("n").alias("n"))


def sampling(counted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Most common interval (the shorter of equally common ones), number of distinct ones, longest, shortest."""
    return counted.groupBy(*keys).agg(
        F.max_by("interval_us", F.struct(F.col("n"), -F.col("interval_us"))).alias("most_common_us"),
        F.max("n").alias("most_common_count"),
        F.count("*").alias("unique_intervals"),
        F.max("interval_us").alias("largest_us"),
        F.min("interval_us").alias("smallest_us"),
    )


def top_intervals(counted: DataFrame, keys: Sequence[str], k: int = TOP_INTERVALS) -> DataFrame:
    """The ``k`` most common intervals of each group."""
    common = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(F.desc("n"), "interval_us")
    return counted.withColumn("place", F.row_number().over(common)).where(F.col("place") <= k)


def timestamp_quality(df: DataFrame, column: str) -> DataFrame:
    """Parse failures, repeated timestamps (all failures count as one value), first and last."""
    ts = F.col(column).try_cast("timestamp_ntz")
    return df.select(ts.alias("ts")).agg(
        F.count_if(F.col("ts").isNull()).alias("parse_failures"),
        (F.count("*") - F.countDistinct("ts") - F.max(F.col("ts").isNull().cast("int"))).alias("duplicate_timestamps"),
        F.min("ts").alias("min_ts"),
        F.max("ts").alias("max_ts"),
    )


def timestamp_profile(df: DataFrame, column: str) -> DataFrame:
    """Quality and sampling of a time column as one row."""
    parsed = df.select(F.col(column).try_cast("timestamp_ntz").alias("ts"))
    blocks = sampling(intervals(parsed, []), [])
    block = blocks.select(F.struct(*blocks.columns).alias("s")).scalar()
    return timestamp_quality(df, column).withColumn("s", block).select("*", "s.*").drop("s")
