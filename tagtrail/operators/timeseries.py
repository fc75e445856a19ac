"""Spikes, change points, trends and summaries of sensor readings ``(tag, ts, rid, value)``.

Row order within a sensor is (ts, rid). All window work runs on fixed-size blocks of a sensor's rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tagtrail.functions.tags import family_by_substring
from tagtrail.operators.ordering import BLOCK_ROWS, exact_quantiles, with_blocks, with_position
from tagtrail.session import staged

# Fixed values of the analysis.
MAD_FACTOR = 0.6745
SPIKE_Z = 6.0
CHANGE_SCORE = 3.0
WINDOW_ROWS = 96
CHANGE_POINTS_PER_SENSOR = 20
STD_FLOOR = 1e-12
#: Shares of a sensor whose newest readings are taken first.
SHARES = 64
SPIKE_NOTE = (
    "Statistical outlier relative to this sensor's historical distribution; engineering meaning requires validation."
)
CHANGE_NOTE = (
    "A large shift between rolling means was detected. This is not proof of a fault or causal event."
)

ORDER = ["ts", "rid"]


def positioned(readings: DataFrame) -> DataFrame:
    """Readings with their row position ``pos`` within the sensor; nulls keep their place."""
    return with_position(readings, ["tag"], ORDER)


def robust_center(readings: DataFrame) -> DataFrame:
    """Per sensor: exact median and exact median absolute deviation."""
    medians = staged(exact_quantiles(readings, ["tag"], "value", {"median": 0.5}), "medians")
    deviations = readings.join(medians, "tag").select("tag", F.abs(F.col("value") - F.col("median")).alias("dev"))
    return medians.join(exact_quantiles(deviations, ["tag"], "dev", {"mad": 0.5}), "tag")


def robust_zscore(readings: DataFrame, center: DataFrame | None = None) -> DataFrame:
    """Add ``robust_z``: 0.6745 (x - median) / MAD; 0 on every row of a sensor whose MAD is null or 0."""
    center = staged(robust_center(readings), "center") if center is None else center
    scaled = F.lit(MAD_FACTOR) * (F.col("value") - F.col("median")) / F.nullif(F.col("mad"), F.lit(0.0))
    flat = F.col("mad").isNull() | (F.col("mad") == 0)
    return (
        readings.join(center, "tag", "left")
        .withColumn("robust_z", F.when(flat, F.lit(0.0)).otherwise(scaled))
        .drop("median", "mad")
    )


def spike_events(positions: DataFrame, threshold: float = SPIKE_Z, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Runs of consecutive rows with |z| at or over the threshold, one event per run.

    Runs are built inside blocks; only runs that touch a block edge are looked at again to join neighbours, so no
    window holds more than one block's hits or two runs per block.
    """
    hits = robust_zscore(positions).where(F.abs("robust_z") >= threshold)
    block = F.floor((F.col("pos") - 1) / block_rows)
    island = F.col("pos") - F.row_number().over(Window.partitionBy("tag", "block").orderBy("pos"))
    peak = F.struct(
        F.abs("robust_z").alias("size"), (-F.col("pos")).alias("early"), F.col("ts").alias("at"),
        F.col("value").alias("value"), F.col("robust_z").alias("z"),
    )
    runs = (
        hits.withColumn("block", block)
        .withColumn("island", island)
        .groupBy("tag", "block", "island")
        .agg(
            F.min("pos").alias("first"), F.max("pos").alias("last"), F.min("ts").alias("start"),
            F.max("ts").alias("end"), F.max(peak).alias("peak"), F.count("*").alias("sample_count"),
        )
    )
    at_edge = ((F.col("first") - 1) % block_rows == 0) | (F.col("last") % block_rows == 0)
    by_first = Window.partitionBy("tag").orderBy("first")
    broken = (F.col("first") != F.lag("last").over(by_first) + 1) | F.lag("last").over(by_first).isNull()
    joined = (
        runs.where(at_edge)
        .withColumn("broken", broken.cast("int"))
        .withColumn("chain", F.sum("broken").over(by_first))
        .groupBy("tag", "chain")
        .agg(
            F.min("start").alias("start"), F.max("end").alias("end"), F.max("peak").alias("peak"),
            F.sum("sample_count").alias("sample_count"),
        )
        .drop("chain")
    )
    kept = runs.where(~at_edge).select(*joined.columns)
    return kept.unionByName(joined).select(
        F.lit("statistical_spike").alias("event_type"),
        F.col("tag").alias("sensor_tag"),
        "start",
        "end",
        F.col("peak.at").alias("peak_timestamp"),
        F.col("peak.value").alias("peak_value"),
        F.col("peak.z").alias("peak_robust_z"),
        F.when(F.col("peak.z") > 0, "high_spike").otherwise("low_spike").alias("direction"),
        "sample_count",
        F.lit("candidate").alias("status"),
        F.lit(SPIKE_NOTE).alias("interpretation"),
    )


def _full_frame(agg: Column, count: Column, rows: int) -> Column:
    return F.when(count == rows, agg)


def rolling_stats(positions: DataFrame, rows: int = WINDOW_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Mean and sample deviation over the last ``rows`` rows; null unless every one of them has a value."""
    return _rolling(positions, rows, rows - 1, block_rows).where(~F.col("halo")).drop("block", "halo")


def _rolling(positions: DataFrame, rows: int, before: int, block_rows: int) -> DataFrame:
    frame = Window.partitionBy("tag", "block").orderBy("pos").rowsBetween(1 - rows, 0)
    full = F.count("value").over(frame)
    return with_blocks(positions, before, block_rows).select(
        "*",
        _full_frame(F.avg("value").over(frame), full, rows).alias("rolling_mean"),
        _full_frame(F.stddev_samp("value").over(frame), full, rows).alias("rolling_std"),
    )


def change_scores(positions: DataFrame, rows: int = WINDOW_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Shift of the rolling mean against the one ``rows`` rows earlier, in units of the current deviation."""
    by_pos = Window.partitionBy("tag", "block").orderBy("pos")
    shift = F.abs(F.col("rolling_mean") - F.lag("rolling_mean", rows).over(by_pos))
    return (
        _rolling(positions, rows, 2 * rows - 1, block_rows)
        .withColumn("change_score", shift / F.nullif(F.col("rolling_std"), F.lit(0.0)))
        .where(~F.col("halo"))
        .drop("block", "halo")
    )


def change_points(
    positions: DataFrame,
    threshold: float = CHANGE_SCORE,
    per_sensor: int = CHANGE_POINTS_PER_SENSOR,
    rows: int = WINDOW_ROWS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """The strongest change points of each sensor; equal scores go by time."""
    strongest = Window.partitionBy("tag").orderBy(F.desc("change_score"), "ts", "rid")
    return (
        change_scores(positions, rows, block_rows)
        .where(F.col("change_score") >= threshold)
        .withColumn("strength", F.row_number().over(strongest))
        .where(F.col("strength") <= per_sensor)
        .select(
            F.lit("change_point_candidate").alias("event_type"),
            F.col("tag").alias("sensor_tag"),
            F.col("ts").alias("timestamp"),
            "change_score",
            F.lit("candidate").alias("status"),
            F.lit(CHANGE_NOTE).alias("interpretation"),
        )
    )


def trends(readings: DataFrame, rows: int = WINDOW_ROWS) -> DataFrame:
    """Compare the first and last ``rows`` non-null values of each sensor, in units of its deviation."""
    values = readings.where(F.col("value").isNotNull())

    def edge(descending: bool, name: str) -> DataFrame:
        order = [F.desc(c) if descending else F.asc(c) for c in ORDER]
        place = F.row_number().over(Window.partitionBy("tag").orderBy(*order))
        return (
            values.select("tag", *ORDER, "value").withColumn("place", place).where(F.col("place") <= rows)
            .groupBy("tag").agg(F.avg("value").alias(name))
        )

    spread = values.groupBy("tag").agg(F.count("*").alias("valid"), F.stddev_samp("value").alias("std"))
    enough = F.col("valid") >= 2 * rows
    difference = F.col("end_mean") - F.col("start_mean")
    normalized = F.when(F.col("std") > STD_FLOOR, F.abs(difference) / F.col("std")).otherwise(F.lit(0.0))
    return (
        spread.join(edge(False, "start_mean"), "tag")
        .join(edge(True, "end_mean"), "tag")
        .withColumn("difference", difference)
        .withColumn("normalized_change", normalized)
        .select(
            "tag",
            F.when(~enough, "insufficient_data")
            .when(F.col("normalized_change") < 1.0, "stable")
            .when(F.col("difference") > 0, "rising")
            .otherwise("falling")
            .alias("label"),
            *(F.when(enough, F.col(c)).alias(c) for c in ("start_mean", "end_mean", "difference", "normalized_change")),
        )
    )


def all_events(positions: DataFrame, spike_z: float = SPIKE_Z, change_score: float = CHANGE_SCORE) -> DataFrame:
    """Spikes and change points as one table; fields of the other kind are null."""
    return spike_events(positions, spike_z).unionByName(
        change_points(positions, change_score), allowMissingColumns=True
    )


def sensor_summary(readings: DataFrame, spike_z: float = SPIKE_Z, change_score: float = CHANGE_SCORE) -> DataFrame:
    """One row per sensor: counts, statistics, trend and event counts; a short row if it has no value at all."""
    basics = readings.groupBy("tag").agg(
        F.count("*").alias("rows"),
        F.count("value").alias("valid_count"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
    )
    positions = positioned(readings)
    spikes = spike_events(positions, spike_z).groupBy("sensor_tag").agg(F.count("*").alias("spikes"))
    changes = change_points(positions, change_score).groupBy("sensor_tag").agg(F.count("*").alias("changes"))
    medians = exact_quantiles(readings, ["tag"], "value", {"median": 0.5})
    some = F.col("valid_count") > 0
    joined = (
        basics.join(medians, "tag", "left")
        .join(trends(readings), "tag", "left")
        .join(spikes.withColumnRenamed("sensor_tag", "tag"), "tag", "left")
        .join(changes.withColumnRenamed("sensor_tag", "tag"), "tag", "left")
    )
    missing = F.col("rows") - F.col("valid_count")
    return joined.select(
        "tag",
        family_by_substring(F.col("tag")).alias("tag_family"),
        F.when(some, F.col("rows")).otherwise(F.lit(0)).alias("count"),
        F.when(some, F.col("valid_count")).alias("valid_count"),
        missing.alias("missing_count"),
        F.when(some, missing / F.col("rows")).alias("missing_fraction"),
        "min", "max", "mean", "std", "median",
        F.col("label").alias("trend_label"),
        "start_mean", "end_mean", "difference", "normalized_change",
        F.when(some, F.coalesce("spikes", F.lit(0))).alias("spike_event_count"),
        F.when(some, F.coalesce("changes", F.lit(0))).alias("change_point_candidate_count"),
    )


def recent_values(readings: DataFrame, rows: int) -> DataFrame:
    """The last ``max(1, rows)`` readings of each sensor, nulls included, with ``recency`` 1 for the newest.

    Spark keeps the first rows of a group in each task before they are shuffled, as long as their number is below a limit of
    its own; so many tasks times ``rows`` are then ordered together. For more rows than that, the newest of each of ``SHARES``
    shares of a sensor come first. Either way no task orders a whole sensor.
    """
    order = [F.desc("ts"), F.desc("rid")]
    newest = Window.partitionBy("tag").orderBy(*order)
    shares = Window.partitionBy("tag", F.pmod(F.xxhash64("ts", "rid"), F.lit(SHARES))).orderBy(*order)
    most = int(readings.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000"))
    out = readings
    for window in [newest] if rows < most else [shares, newest]:
        out = out.withColumn("recency", F.row_number().over(window)).where(F.col("recency") <= max(1, rows))
    return out


def trend_points(readings: DataFrame, rows: int) -> DataFrame:
    """The last ``rows`` readings (10 to 5000), then without the nulls among them."""
    if not 10 <= rows <= 5000:
        raise ValueError("rows must be between 10 and 5000")
    return recent_values(readings, rows).where(F.col("value").isNotNull())


def tool_summary(readings: DataFrame, ts_bounds: DataFrame | None = None) -> DataFrame:
    """Per sensor statistics with the population deviation; the time range is that of the whole table."""
    bounds = ts_bounds or readings.agg(F.min("ts").alias("first_timestamp"), F.max("ts").alias("last_timestamp"))
    stats = readings.where(F.col("value").isNotNull()).groupBy("tag").agg(
        F.count("*").alias("rows"), F.min("value").alias("min"), F.max("value").alias("max"),
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"),
    )
    one_row = bounds.select(F.struct("first_timestamp", "last_timestamp").alias("range")).scalar()
    return (
        stats.join(exact_quantiles(readings, ["tag"], "value", {"median": 0.5}), "tag")
        .withColumn("range", one_row)
        .select("*", "range.*")
        .drop("range")
    )


def sensor_events(events: DataFrame, limit: int) -> DataFrame:
    """The latest ``max(1, limit)`` events of each sensor, by text of start or timestamp, newest first.

    ``events`` may name its sensor in any of the four alias columns; the first filled one counts.
    """
    aliases = [c for c in ("sensor_tag", "sensor", "entity_id", "source_column") if c in events.columns]
    name = F.coalesce(*(F.nullif(F.col(c), F.lit("")) for c in aliases))
    when = F.coalesce("start", "timestamp", F.lit(""))
    newest = Window.partitionBy("sensor_key").orderBy(F.desc("sort_key"), "event_id")
    return (
        events.withColumn("sensor_key", F.lower(name))
        .where(F.col("sensor_key").isNotNull())
        .withColumn("sort_key", when)
        .withColumn("recency", F.row_number().over(newest))
        .where(F.col("recency") <= max(1, limit))
    )


def dataset_extent(readings: DataFrame) -> DataFrame:
    """Rows, sensors, start and end of an analysed table."""
    return readings.agg(
        F.count("*").alias("rows"), F.countDistinct("tag").alias("sensors"),
        F.min("ts").alias("start"), F.max("ts").alias("end"),
    )
