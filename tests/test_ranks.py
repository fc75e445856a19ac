"""Quantiles of large groups by narrowed brackets, and the newest readings of a hot sensor."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagtrail.operators import ordering, timeseries as ts


@pytest.mark.parametrize("values", ["distinct", "few", "mixed"])
def test_narrowed_brackets_give_exact_quantiles(spark, monkeypatch, values):
    monkeypatch.setattr(ordering, "BRACKET_VALUES", 20)
    monkeypatch.setattr(ordering, "GRID", 16)
    rng = np.random.default_rng(4)
    groups = {"hot": 9000, None: 3000, "small": 3}
    rows = []
    for tag, n in groups.items():
        own = {"distinct": rng.normal(size=n), "few": rng.integers(0, 3, n), "mixed": np.where(rng.random(n) < 0.6, 1.5, rng.normal(size=n))}[values]
        rows += [(tag, float(x)) for x in own] + [(tag, None)]
    df = spark.createDataFrame(rows, "tag string, value double").repartition(6)
    got = {r["tag"]: r for r in ordering.exact_quantiles(df, ["tag"], "value", {"low": 0.05, "mid": 0.5, "high": 0.75}, accuracy=100).collect()}
    assert set(got) == set(groups)
    for tag in groups:
        own = [x for t, x in rows if t == tag and x is not None]
        for name, q in (("low", 0.05), ("mid", 0.5), ("high", 0.75)):
            assert got[tag][name] == pytest.approx(np.quantile(own, q), abs=1e-12)


def test_brackets_shrink(spark, monkeypatch):
    monkeypatch.setattr(ordering, "BRACKET_VALUES", 50)
    monkeypatch.setattr(ordering, "GRID", 16)
    df = spark.range(20_000).select(F.lit("a").alias("tag"), (F.col("id") * 7919 % 20_000).cast("double").alias("_v"))
    sketch = df.groupBy("tag").agg(F.percentile_approx("_v", [0.4, 0.6], 50).alias("_b"), F.count("*").alias("_size"))
    low, high = ordering._narrowed(df, sketch, ["tag"], [0.5], 1000).first()["_b"]
    assert low <= 9999 and 10_000 <= high and high - low < 100


@pytest.mark.parametrize("rows", [1, 7, 2000])
def test_newest_readings_of_a_hot_sensor(spark, rows):
    df = spark.range(9000).select(
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 != 1, F.concat(F.lit("s"), F.col("id") % 20)).alias("tag"),
        F.expr("timestamp '2024-01-01' + make_interval(0, 0, 0, 0, 0, 0, id * 7919 % 3000)").alias("ts"), F.col("id").alias("rid"), F.when(F.col("id") % 4 > 0, F.col("id").cast("double")).alias("value"),
    ).repartition(8)
    got = ts.recent_values(df, rows).collect()
    groups = {}
    for r in df.collect():
        groups.setdefault(r["tag"], []).append((r["ts"], r["rid"]))
    want = {(t, rid, n) for t, own in groups.items() for n, (_, rid) in enumerate(sorted(own, reverse=True)[:rows], 1)}
    assert {(r["tag"], r["rid"], r["recency"]) for r in got} == want and len(got) == len(want)


def test_a_task_passes_on_no_more_than_it_keeps(spark):
    df = spark.range(4000).select((F.col("id") % 2).cast("string").alias("tag"), F.col("id").cast("timestamp").alias("ts"), F.col("id").alias("rid"), F.lit(1.0).alias("value"))
    plan = ts.recent_values(df, 10)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
