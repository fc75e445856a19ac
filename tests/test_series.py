"""Ordering, events, trends and correlations against plain Python on small tables."""

from __future__ import annotations

import datetime as dt
import random
import statistics

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tagtrail.operators import correlation, ordering, profile, timeseries as ts

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "tag string, ts timestamp_ntz, rid bigint, value double"


def series(spark, values, tag="a", shuffle=True):
    rows = [(tag, T0 + dt.timedelta(minutes=i), i, None if v is None else float(v)) for i, v in enumerate(values)]
    if shuffle:
        random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA)


def noisy(n, seed=7):
    rng = random.Random(seed)
    return [rng.gauss(10, 1) for _ in range(n)]


def test_position_spans_partitions_of_a_hot_key(spark):
    rows = [("hot", i) for i in range(900)] + [(f"k{i % 7}", i) for i in range(100)]
    random.Random(2).shuffle(rows)
    got = ordering.with_position(spark.createDataFrame(rows, "k string, x int"), ["k"], ["x"], partitions=6).toPandas()
    for _, group in got.groupby("k"):
        group = group.sort_values("x")
        assert group["pos"].tolist() == list(range(1, len(group) + 1))


def test_position_without_keys(spark):
    got = ordering.with_position(spark.range(500).select((500 - F.col("id")).alias("x")), [], ["x"], partitions=5)
    assert got.where("pos <> x").count() == 0


def test_blocks_carry_the_rows_before(spark):
    df = spark.range(1, 11).select(F.col("id").alias("pos"))
    rows = ordering.with_blocks(df, before=2, block_rows=4).collect()
    got = {b: sorted((r.pos, r.halo) for r in rows if r.block == b) for b in (0, 1, 2)}
    assert [p for p, h in got[1] if h] == [3, 4] and [p for p, h in got[1] if not h] == [5, 6, 7, 8]
    assert [p for p, h in got[2] if h] == [7, 8]
    with pytest.raises(ValueError):
        ordering.with_blocks(df, before=5, block_rows=4)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 99, 100, 101, 150, 4001])
def test_exact_quantiles(spark, n):
    rng = random.Random(n)
    values = [round(rng.expovariate(0.1), 1 if n % 2 else 6) for _ in range(n)]
    df = spark.createDataFrame([("a", v) for v in values] + [("b", None)], "tag string, value double")
    named = {"q01": 0.01, "median": 0.5, "q99": 0.99, "top": 1.0}
    # A coarse sketch, so that brackets really cut the data.
    for accuracy in (10_000, 200):
        got = ordering.exact_quantiles(df, ["tag"], "value", named, accuracy).collect()
        assert len(got) == 1
        for name, q in named.items():
            assert got[0][name] == pytest.approx(pd.Series(values).quantile(q), abs=1e-9)


def plain_spikes(values, threshold):
    known = [v for v in values if v is not None]
    median = statistics.median(known)
    mad = statistics.median(abs(v - median) for v in known)
    if mad == 0:
        return []
    z = [None if v is None else 0.6745 * (v - median) / mad for v in values]
    runs = []
    for i, score in enumerate(z):
        if score is not None and abs(score) >= threshold:
            if runs and runs[-1][-1] == i - 1:
                runs[-1].append(i)
            else:
                runs.append([i])
    return [(r[0], r[-1], max(r, key=lambda i: (abs(z[i]), -i)), len(r)) for r in runs]


@pytest.mark.parametrize("block_rows", [1, 3, 7, 1000])
def test_spike_runs_across_blocks(spark, block_rows):
    values = noisy(60)
    for i in (2, 3, 4, 5, 6, 7, 8, 20, 21, 23, 35, 59):
        values[i] = 40.0 + (i % 3)
    values[22] = None
    got = ts.spike_events(ts.positioned(series(spark, values)), 3.0, block_rows).collect()
    minute = lambda t: int((t - T0).total_seconds() // 60)
    rows = sorted((minute(r.start), minute(r.end), minute(r.peak_timestamp), r.sample_count) for r in got)
    assert rows == plain_spikes(values, 3.0)
    assert len(rows) >= 4


def test_flat_sensor_has_zero_scores_and_no_spike(spark):
    flat = series(spark, [5.0] * 30 + [9.0])
    assert ts.robust_zscore(flat).where("robust_z <> 0").count() == 0
    assert ts.spike_events(ts.positioned(flat), 1.0).count() == 0


@pytest.mark.parametrize("block_rows", [20, 64, 1000])
def test_rolling_and_change_scores_match_pandas(spark, block_rows):
    values = noisy(150) + [v + 6 for v in noisy(150, 8)]
    values[40] = None
    w = 10
    got = ts.change_scores(ts.positioned(series(spark, values)), w, block_rows).orderBy("rid").toPandas()
    s = pd.Series([np.nan if v is None else v for v in values])
    mean, std = s.rolling(w, min_periods=w).mean(), s.rolling(w, min_periods=w).std()
    score = (mean - mean.shift(w)).abs() / std.replace(0, np.nan)
    np.testing.assert_allclose(got["rolling_mean"], mean, equal_nan=True)
    np.testing.assert_allclose(got["rolling_std"], std, equal_nan=True)
    np.testing.assert_allclose(got["change_score"].astype(float), score, equal_nan=True)
    top = ts.change_points(ts.positioned(series(spark, values)), 3.0, rows=w, block_rows=block_rows)
    assert 0 < top.count() <= 20


def test_trend_labels(spark):
    short = series(spark, noisy(150), "short")
    up = series(spark, [i / 10 for i in range(300)], "up")
    down = series(spark, [-i / 10 for i in range(300)], "down")
    flat = series(spark, [3.0] * 300, "flat")
    df = short.union(up).union(down).union(flat)
    labels = {r.tag: r.label for r in ts.trends(df).collect()}
    assert labels == {"short": "insufficient_data", "up": "rising", "down": "falling", "flat": "stable"}


def test_summary_of_a_sensor_without_values(spark):
    df = series(spark, [None] * 5, "dead").union(series(spark, noisy(40), "75PI1.pv"))
    rows = {r.tag: r for r in ts.sensor_summary(df).collect()}
    assert rows["dead"]["count"] == 0 and rows["dead"].missing_count == 5 and rows["dead"].mean is None
    assert rows["75PI1.pv"]["count"] == 40 and rows["75PI1.pv"].tag_family == "PI"


def test_recent_values_keep_nulls_and_trend_points_drop_them_after(spark):
    df = series(spark, [1.0] * 15 + [None, 2.0])
    assert ts.recent_values(df, 10).count() == 10
    assert ts.trend_points(df, 10).count() == 9
    with pytest.raises(ValueError):
        ts.trend_points(df, 9)


def test_pairs_with_nulls_and_no_variance(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(1e6, 1, 200)
    frame = pd.DataFrame({"a": x, "b": x * 2 + rng.normal(0, 0.1, 200), "c": 0.1, "d.e": rng.normal(0, 1, 200)})
    frame.loc[::3, "b"] = None
    wide = spark.createDataFrame(frame.astype(object).where(frame.notna(), None), "a double, b double, c double, `d.e` double")
    got = {(r.sensor_a, r.sensor_b): r for r in correlation.pair_correlations(wide, list(frame.columns)).collect()}
    want = frame.corr()
    assert got["a", "b"].correlation == pytest.approx(want.loc["a", "b"], abs=1e-9)
    assert got["a", "b"].n == frame["b"].notna().sum()
    assert got["a", "d.e"].correlation == pytest.approx(want.loc["a", "d.e"], abs=1e-9)
    assert got["a", "c"].correlation is None
    assert [(r.sensor_a, r.sensor_b) for r in correlation.correlated_pairs(wide, list(frame.columns)).collect()] == [("a", "b")]
    assert correlation.correlated_pairs(wide.limit(0), list(frame.columns)).count() == 0


@pytest.mark.parametrize("tile", [2, 4, 100])
def test_long_pairs_match_pandas(spark, tile):
    rng = random.Random(5)
    rows = [
        (f"s{k}", T0 + dt.timedelta(hours=h, minutes=rng.randrange(60)), h * 10 + k, rng.random())
        for h in range(80) for k in range(6) if rng.random() < 0.7
    ]
    got = correlation.sensor_pair_correlations(spark.createDataFrame(rows, SCHEMA), "hour", tile).collect()
    frame = pd.DataFrame(rows, columns=["tag", "ts", "rid", "value"])
    wide = frame.assign(h=frame["ts"].dt.floor("h")).pivot_table(index="h", columns="tag", values="value")
    want = wide.corr(min_periods=2)
    assert len(got) == 15
    for r in got:
        assert r.correlation == pytest.approx(want.loc[r.sensor_a, r.sensor_b], abs=1e-9)


def test_intervals_count_copies_as_zero(spark):
    times = [0, 0, 0, 60, 120, 120, 300]
    df = spark.createDataFrame([(T0 + dt.timedelta(seconds=s),) for s in times] + [(None,)], "ts timestamp_ntz")
    got = {r.interval_us: r.n for r in profile.intervals(df, []).collect()}
    assert got == {0: 3, 60_000_000: 2, 180_000_000: 1}
    row = profile.timestamp_profile(df.select(F.col("ts").cast("string").alias("t")), "t").first()
    assert (row.parse_failures, row.duplicate_timestamps, row.most_common_us) == (1, 3, 0)


def test_column_samples_beyond_the_first_rows(spark):
    df = spark.range(3000).select(
        (2999 - F.col("id")).alias("n"), F.when(F.col("id") < 700, F.col("id").cast("string")).alias("late"),
        F.lit(None).cast("double").alias("never"),
    )
    rows = {r["column"]: r for r in profile.column_profile(df, ["n"], ["n", "late", "never"]).collect()}
    assert rows["n"].sample_values == ["0", "1", "2", "3", "4"] and rows["n"].is_numeric
    assert rows["late"].sample_values == ["699", "698", "697", "696", "695"] and rows["late"].missing_count == 2300
    assert rows["never"].sample_values == [] and rows["never"].unique_count == 0
