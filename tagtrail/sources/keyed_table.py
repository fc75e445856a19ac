"""A table with one row per key, in versions: merges write what they change, readers see one version whole.

A version is a manifest, ``versions/<number>.json``, that names for each bucket of keys the segments it is made of: a base
and the changes after it, oldest first. A segment is a folder ``data/<id>/bucket=<n>`` that is written once and never
touched again. A merge writes the rows it changes or adds as one more segment of their buckets, and its manifest refers
to all other segments as they are. A bucket whose changes have grown beyond MAX_CHANGES segments, or to COMPACT times its
base, is written anew by the merge that finds it so, and it alone.

The manifest is the commit: it is written last, and only if no other writer has taken its number, so that a job that
fails leaves the version before it, and of two writers at once one gets an error and can start again. ``vacuum`` deletes
segments that no kept version names.

Keys are equal if all their columns are, null being equal to null. A merge twice over gives the same table. Columns that
only the incoming rows have are added, null for older rows; columns they lack become null in rows they replace.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tagtrail.operators.graph import duplicate_keys, latest_per_key
from tagtrail.operators.joins import same_keys_join
from tagtrail.session import list_names, passing, remove, staged, write_new

BUCKETS = 32
#: Segments of changes, and changed rows as a part of the base, from which on a bucket is written anew.
MAX_CHANGES, COMPACT = 8, 0.5
_BUCKET = "keyed_bucket"


@dataclass(frozen=True)
class Version:
    """What a manifest says. ``segments`` maps a bucket to its segments, each with its number of rows."""

    number: int
    keys: list[str]
    buckets: int
    schema: T.StructType
    segments: dict[int, list[tuple[str, int]]] = field(default_factory=dict)

    def text(self) -> str:
        own = {"number": self.number, "keys": self.keys, "buckets": self.buckets, "schema": self.schema.jsonValue()}
        return json.dumps(own | {"segments": {str(b): s for b, s in sorted(self.segments.items())}})

    @staticmethod
    def of(text: str) -> Version:
        own = json.loads(text)
        segments = {int(b): [(s, n) for s, n in found] for b, found in own["segments"].items()}
        return Version(own["number"], own["keys"], own["buckets"], T.StructType.fromJson(own["schema"]), segments)


def _manifest(path: str, number: int) -> str:
    return f"{path}/versions/{number:08d}.json"


def version_numbers(spark: SparkSession, path: str) -> list[int]:
    names = list_names(spark, f"{path}/versions")
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[:-5].isdigit())


def version(spark: SparkSession, path: str, number: int | None = None) -> Version:
    """The named version, or the latest."""
    if number is None:
        numbers = version_numbers(spark, path)
        if not numbers:
            raise ValueError(f"no table at {path}")
        number = numbers[-1]
    return Version.of(spark.read.text(_manifest(path, number), wholetext=True).first()[0])


def _with_bucket(df: DataFrame, keys: Sequence[str], buckets: int) -> DataFrame:
    return df.withColumn(_BUCKET, F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))


def _write(df: DataFrame, path: str) -> tuple[str, dict[int, int]]:
    """Write rows with their buckets as a new segment; its id, and the rows per bucket."""
    name = uuid.uuid4().hex
    folder = f"{path}/data/{name}"
    df.hint("rebalance", _BUCKET).write.partitionBy(_BUCKET).parquet(folder)
    back = df.sparkSession.read.schema(df.schema).parquet(folder)
    counts = back.groupBy(_BUCKET).count().collect()  # one row per bucket
    return name, {r[_BUCKET]: r["count"] for r in counts}


def _read(spark: SparkSession, path: str, schema: T.StructType, wanted: list[tuple[str, int]]) -> DataFrame:
    """The rows of the segments (id, bucket), with their buckets."""
    own = T.StructType([*schema.fields, T.StructField(_BUCKET, T.IntegerType())])
    if not wanted:
        return spark.createDataFrame([], own)
    folders = [f"{path}/data/{s}/{_BUCKET}={b}" for s, b in wanted]
    # One read for all segments: base paths differ, so the bucket is taken from the keys' folders.
    number = F.regexp_extract(F.input_file_name(), rf"/{_BUCKET}=(\d+)/", 1).cast("int")
    return spark.read.schema(schema).parquet(*folders).withColumn(_BUCKET, number)


def _rows(spark: SparkSession, path: str, v: Version, buckets: Sequence[int] | None = None) -> DataFrame:
    """The rows of a version, of some buckets or all, with their buckets."""
    chosen = {b: s for b, s in v.segments.items() if buckets is None or b in buckets}
    base = _read(spark, path, v.schema, [(s[0][0], b) for b, s in chosen.items()])
    later = [(name, n, b) for b, s in chosen.items() for n, (name, _) in enumerate(s) if n]
    if not later:
        return base
    # Changes are few: the last of each key is found among them alone, and the base gives up the keys they hold.
    parts = []
    for place in sorted({n for _, n, _ in later}):
        parts.append(_read(spark, path, v.schema, [(name, b) for name, n, b in later if n == place]).withColumn("_place", F.lit(place)))
    changes = parts[0]
    for part in parts[1:]:
        changes = changes.unionByName(part)
    last = latest_per_key(changes, [*v.keys, _BUCKET], ["_place"]).drop("_place").select(*base.columns)
    return same_keys_join(base, last.select(*v.keys), v.keys, "left_anti").unionByName(last)


def read_table(spark: SparkSession, path: str, number: int | None = None) -> DataFrame:
    """The rows of the latest or the named version."""
    return _rows(spark, path, version(spark, path, number)).drop(_BUCKET)


def create_table(df: DataFrame, path: str, keys: Sequence[str], buckets: int = BUCKETS) -> Version:
    """Write ``df`` as version 1 of a new table. Two rows of one key are an error."""
    spark = df.sparkSession
    if not duplicate_keys(df, list(keys)).isEmpty():
        raise ValueError(f"some keys {list(keys)} have several rows")
    name, rows = _write(_with_bucket(df, keys, buckets), path)
    return _commit(spark, path, Version(1, list(keys), buckets, df.schema, {b: [(name, n)] for b, n in rows.items()}))


def _commit(spark: SparkSession, path: str, v: Version) -> Version:
    if not write_new(spark, _manifest(path, v.number), v.text()):
        raise RuntimeError(f"version {v.number} of {path} was written by another job; merge again")
    return v


def _widened(schema: T.StructType, incoming: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType) for f in schema] + [T.StructField(f.name, f.dataType) for f in incoming if f.name not in schema.names])


def merge(spark: SparkSession, path: str, incoming: DataFrame, order: Sequence[str], create_only: bool = False) -> Version:
    """Merge ``incoming`` by key as a new version; of several rows of a key the last in ``order`` counts.

    A key that exists gets the incoming row, or with ``create_only`` stays as it is; other keys are added.
    """
    old = version(spark, path)
    schema = _widened(old.schema, incoming.schema)
    own = [*old.keys]
    with passing(spark):
        latest = latest_per_key(incoming, own, order)
        given = [F.col(f.name).cast(f.dataType) if f.name in incoming.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema]
        change = staged(_with_bucket(latest.select(*given), own, old.buckets), "changes")
        touched = {r[_BUCKET] for r in change.select(_BUCKET).distinct().collect()}  # one row per bucket
        if create_only:
            existing = _rows(spark, path, old, sorted(touched)).select(*own)
            change = staged(same_keys_join(change, existing, own, "left_anti"), "changes")
        name, rows = _write(change, path)
    segments = {b: list(s) for b, s in old.segments.items()}
    for b, n in rows.items():
        segments.setdefault(b, []).append((name, n))
    new = Version(old.number + 1, old.keys, old.buckets, schema, segments)
    return _commit(spark, path, _compacted(spark, path, new))


def _compacted(spark: SparkSession, path: str, v: Version) -> Version:
    """``v`` with a new base for the buckets that have too many changes."""
    full = [b for b, s in v.segments.items() if len(s) > 1 + MAX_CHANGES or sum(n for _, n in s[1:]) > COMPACT * s[0][1]]
    if not full:
        return v
    name, rows = _write(_rows(spark, path, v, full), path)
    return Version(v.number, v.keys, v.buckets, v.schema, v.segments | {b: [(name, rows[b])] for b in full})


def vacuum(spark: SparkSession, path: str, keep: int = 1) -> list[str]:
    """Delete all versions but the last ``keep`` and the segments that only they name; the ids of these.

    Not while a reader is still at an older version, or a merge is running.
    """
    numbers = version_numbers(spark, path)
    held = {name for n in numbers[-keep:] for s in version(spark, path, n).segments.values() for name, _ in s}
    gone = [name for name in list_names(spark, f"{path}/data") if name not in held]
    for n in numbers[:-keep]:
        remove(spark, _manifest(path, n))
    for name in gone:
        remove(spark, f"{path}/data/{name}")
    return gone
