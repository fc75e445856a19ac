"""Row numbering, fixed-size blocks and exact quantiles that never put one whole group into one task.

One sensor may own a third of all readings, so ``row_number() over (partition by tag)`` or ``percentile`` would send
that third to a single task. The three functions here split such groups.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tagtrail.operators.joins import same_keys_join
from tagtrail.session import shuffle_width, staged

BLOCK_ROWS = 65_536
#: Different values around a wanted rank that one task may order, and the pieces into which a wider bracket is cut.
BRACKET_VALUES, GRID = 500_000, 256


def with_position(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "pos", partitions: int | None = None
) -> DataFrame:
    """Add the 1-based position of each row within its group ``keys`` in the order ``order``.

    The table is range-partitioned by (keys, order), so a big group spans many partitions; only one count per
    (group, partition) goes through a window. Staging fixes the partition ids the numbering is built on. Rows whose
    keys are null form a group like others.
    """
    ordered = staged(
        df.repartitionByRange(partitions or shuffle_width(df.sparkSession), *keys, *order)
        .sortWithinPartitions(*keys, *order)
        .withColumn("_row", F.monotonically_increasing_id()),
        "ordered",
    ).withColumn("_part", F.shiftright("_row", 33))
    runs = ordered.groupBy(*keys, "_part").agg(F.count("*").alias("_n"), F.min("_row").alias("_first"))
    earlier = (
        Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    )
    shifts = runs.select(
        *keys, "_part", (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first") + 1).alias("_shift")
    )
    return (
        same_keys_join(ordered, shifts, [*keys, "_part"])
        .withColumn(name, F.col("_row") + F.col("_shift"))
        .drop("_row", "_part", "_shift")
    )


def with_blocks(df: DataFrame, before: int, block_rows: int = BLOCK_ROWS, pos: str = "pos") -> DataFrame:
    """Cut numbered groups into blocks of ``block_rows`` rows and give each block the ``before`` rows ahead of it.

    Adds ``block`` and ``halo``; rows with ``halo`` true are copies that feed a window frame and must be dropped
    after it. A window partitioned by (group, block) then sees at most ``block_rows + before`` rows.
    """
    if before > block_rows:
        raise ValueError("a block must hold at least the rows carried over")
    offset = F.col(pos) - 1
    block = F.floor(offset / block_rows)
    copies = F.array(F.struct(block.alias("block"), F.lit(False).alias("halo")))
    if before:
        carried = F.array(F.struct((block + 1).alias("block"), F.lit(True).alias("halo")))
        copies = F.when(offset % block_rows >= block_rows - before, F.concat(copies, carried)).otherwise(copies)
    return df.select("*", F.inline(copies))


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, named: Mapping[str, float], accuracy: int = 10_000
) -> DataFrame:
    """Exact quantiles with linear interpolation, one row per group (null keys too) that has a non-null value.

    A mergeable sketch brackets each wanted rank; values inside a bracket are counted one by one, all others only as
    lumps between brackets. What is shuffled is the sketch and the counts, about ``10 / accuracy`` of a big group. Where
    that may still be more than BRACKET_VALUES different values, brackets are narrowed first, so that however large a
    group is, no task orders more than that for each rank.
    """
    values = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    margin = 5.0 / accuracy
    bounds = [p for q in named.values() for p in (max(0.0, q - margin), min(1.0, q + margin))]
    # Staged: as a written table its size is known, so a small one is sent to the values and they need no shuffle.
    sketch = staged(
        values.groupBy(*keys).agg(
            F.percentile_approx("_v", bounds, accuracy).alias("_b"), F.count("*").alias("_size")
        ),
        "sketch",
    )
    largest = sketch.agg(F.max("_size")).first()[0] or 0
    if 2 * margin * largest > BRACKET_VALUES:
        sketch = _narrowed(values, sketch, keys, list(named.values()), accuracy)
    v, b = F.col("_v"), F.col("_b")
    inside = F.lit(False)
    for i in range(0, len(bounds), 2):
        inside = inside | v.between(b[i], b[i + 1])
    segment = sum(((v > b[i]).cast("int") for i in range(len(bounds))), F.lit(0))
    counted = (
        same_keys_join(values, sketch, list(keys))
        .groupBy(*keys, "_size", F.when(inside, v).alias("_exact"), F.when(~inside, segment).alias("_lump"))
        .agg(F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    )
    upto = Window.partitionBy(*keys).orderBy("_lo").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counted.withColumn("_upto", F.sum("_n").over(upto))

    def at(rank: Column) -> Column:
        first, last, lo, hi = F.col("_upto") - F.col("_n") + 1, F.col("_upto"), F.col("_lo"), F.col("_hi")
        picked = (
            F.when((lo == hi) | (rank == first), lo)
            .when(rank == last, hi)
            .otherwise(F.raise_error(F.lit("quantile sketch missed its bracket")).cast("double"))
        )
        return F.max(F.when(rank.between(first, last), picked))

    outs = []
    for name, q in named.items():
        place = F.lit(q) * (F.col("_size") - 1)
        low, frac = F.floor(place), place - F.floor(place)
        below, above = at(low + 1), at(F.least(low + 2, F.col("_size")))
        outs.append((name, below, above, F.max(frac)))
    parts = [c.alias(f"_{name}_{k}") for name, *cs in outs for k, c in zip("abf", cs)]
    return ranked.groupBy(*keys).agg(*parts).select(
        *keys,
        *(
            (F.col(f"_{n}_a") + (F.col(f"_{n}_b") - F.col(f"_{n}_a")) * F.col(f"_{n}_f")).alias(n)
            for n in named
        ),
    )


def _narrowed(values: DataFrame, sketch: DataFrame, keys: Sequence[str], shares: Sequence[float], accuracy: int) -> DataFrame:
    """``sketch`` with brackets (the bounds ``_b``, two per rank) of about BRACKET_VALUES different values at most.

    A round counts the values below and inside each bracket, cuts it at GRID quantiles of its own values, and keeps the cuts
    around the wanted rank. Brackets that a few values fill do not shrink, and need not.
    """
    v, b = F.col("_v"), F.col("_b")
    before = None
    while True:
        joined = same_keys_join(values, sketch, list(keys))
        inside = [v.between(b[2 * i], b[2 * i + 1]) for i in range(len(shares))]
        told = []
        for i, own in enumerate(inside):
            told += [F.count_if(v < b[2 * i]).alias(f"_below{i}"), F.count_if(own).alias(f"_in{i}"), F.approx_count_distinct(F.when(own, v)).alias(f"_different{i}")]
        counts = staged(joined.groupBy(*keys).agg(*told), "brackets")
        now = counts.agg(*[F.sum(F.greatest(F.col(f"_different{i}") - BRACKET_VALUES, F.lit(0))) for i in range(len(shares))]).first()
        if not any(now) or now == before:
            return sketch
        before = now
        cuts = [k / GRID for k in range(GRID + 1)]
        grid = staged(joined.groupBy(*keys).agg(*[F.percentile_approx(F.when(own, v), cuts, accuracy).alias(f"_cuts{i}") for i, own in enumerate(inside)]), "cuts")
        new = []
        for i, q in enumerate(shares):
            cut, n = F.col(f"_cuts{i}"), F.col(f"_in{i}")
            place = F.floor(F.lit(q) * (F.col("_size") - 1)) - F.col(f"_below{i}")  # of the value at the rank, among those inside
            low = F.greatest(F.floor(place * GRID / n) - 1, F.lit(0)).cast("int")
            high = F.least(F.ceil((place + 2) * GRID / n) + 1, F.lit(GRID)).cast("int")
            wide = (F.col(f"_different{i}") > BRACKET_VALUES) & (place >= 0) & (place + 2 <= n)
            new += [F.when(wide, cut[low]).otherwise(b[2 * i]), F.when(wide, cut[high]).otherwise(b[2 * i + 1])]
        whole = same_keys_join(same_keys_join(sketch, counts, list(keys)), grid, list(keys))
        sketch = staged(whole.select(*keys, F.array(*new).alias("_b"), "_size"), "sketch")
