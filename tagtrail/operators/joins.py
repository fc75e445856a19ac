"""Joins in which one key, or no key at all, may hold a large part of the rows.

``split_join`` finds the hot keys of the left side by a counting sketch of fixed size and deals their rows out over
several tasks; the few right rows of those keys are copied to each. All other keys go through the same ordinary
shuffle with salt 0. ``same_keys_join`` is the plain join that also matches null with null.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tagtrail.session import shuffle_width

#: A key is hot if the sketch sees it in more than 1 / (HOT_SHARE * shuffle width) of the rows.
HOT_SHARE = 2
#: Entries that the counting sketch keeps, and so the bound on what reaches the driver.
SKETCH_ITEMS = 8192
TOP = 512


def same_keys_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join by equal keys, null being equal to null; the key columns are those of ``left`` and come first."""
    named = right.withColumnsRenamed({k: f"_right_{n}" for n, k in enumerate(keys)})
    same = F.lit(True)
    for n, k in enumerate(keys):
        same = same & left[k].eqNullSafe(named[f"_right_{n}"])
    joined = left.join(named, same, how)
    if how in ("left_semi", "left_anti"):
        return joined.select(*left.columns)
    return joined.select(*keys, *[c for c in left.columns if c not in keys], *[c for c in right.columns if c not in keys])


def hot_hashes(rows: DataFrame, key: Column, parts: int) -> dict[int, int]:
    """Hashes that the sketch finds in more than 1 / parts of the rows, TOP of them at most, with the pieces to cut each into.

    The sketch keeps SKETCH_ITEMS counters and merges over tasks, so a key of that share is never missed while ``parts``
    is below SKETCH_ITEMS. A key too many costs copies of its right rows and changes no result. A key is cut into pieces
    of about 1 / (2 * parts) of all rows, so all keys together are cut into few more than 2 * parts.
    """
    found = rows.select(key.alias("_hash")).agg(
        F.expr(f"approx_top_k(_hash, {TOP}, {SKETCH_ITEMS})").alias("top"), F.count("*").alias("n")
    ).first()
    shares = {r["item"]: r["count"] / found["n"] for r in found["top"] or [] if r["item"] is not None}
    return {item: math.ceil(2 * parts * share) for item, share in shares.items() if share * parts > 1}


def split_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left", spread: Sequence[str] | None = None,
    parts: int | None = None, null_safe: bool = False, counted: DataFrame | None = None,
) -> DataFrame:
    """``left`` joined with ``right`` by ``keys`` without a task that holds all rows of a hot key.

    ``how`` is inner, left, left_semi or left_anti. Rows of a hot key, and rows that have no key, are dealt out by a hash
    of the columns ``spread`` (by default all of ``left`` but maps; name what tells rows apart). The right side may hold
    several rows per key. With ``null_safe`` null keys match null keys. Column names other than the keys must differ.
    ``counted`` is what hot keys are looked for in, by default ``left``: a cheaper table with the same keys.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"no split join of kind {how}")
    clash = set(left.columns) & set(right.columns) - set(keys) if how in ("inner", "left") else set()
    if clash:
        raise ValueError(f"both sides have columns {sorted(clash)}")
    parts = parts or shuffle_width(left.sparkSession)
    key_hash = F.xxhash64(*keys)
    null = F.lit(False)
    for k in keys:
        null = null | F.col(k).isNull()
    # Rows without a key need no place among the hot ones: they are spread in any case, or match nothing.
    counted = left if counted is None else counted
    counted = counted if null_safe else counted.where(~null)
    hot = hot_hashes(counted, key_hash, HOT_SHARE * parts)
    table = F.create_map(*[F.lit(v) for pair in hot.items() for v in pair])
    is_hot = key_hash.isin(list(hot)) if hot else F.lit(False)
    pieces = F.when(is_hot, table[key_hash]) if hot else F.lit(None).cast("int")
    dealt = F.xxhash64(F.lit(29), *(spread or [f.name for f in left.schema if "map<" not in f.dataType.simpleString()]))
    none = F.lit(False) if null_safe else null
    salt = F.when(is_hot, F.pmod(dealt, pieces)).when(none, F.pmod(dealt, F.lit(HOT_SHARE * parts))).otherwise(F.lit(0)).cast("int")
    if not null_safe:
        right = right.where(~null)
    copies = F.when(is_hot, F.sequence(F.lit(0), pieces - 1)).otherwise(F.array(F.lit(0)))
    salted = left.withColumn("_salt", salt)
    copied = right.withColumn("_salt", F.explode(copies))
    by = [*keys, "_salt"]
    joined = same_keys_join(salted, copied, by, how) if null_safe else salted.join(copied, by, how)
    out = [*left.columns, *([c for c in right.columns if c not in keys] if how in ("inner", "left") else [])]
    return joined.select(*out)
