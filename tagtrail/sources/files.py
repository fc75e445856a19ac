"""Scans of files: documents, digests, JSON lines, event files, CSV."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from tagtrail.functions.ids import document_id
from tagtrail.functions.sha256 import Sha256
from tagtrail.functions.text import normalize_lines
from tagtrail.session import one_split_order, staged

# Keys an event file may keep its list under.
EVENT_KEYS = ["events", "event_candidates", "candidates", "items"]

#: Bytes of files whose pages a parser holds at once.
PARSE_BYTES = 8 << 20

#: Files of more bytes than this are hashed split by split, and so many of them at once.
WHOLE_BYTES, HASHED_FILES = 128 << 20, 48
#: Endings that make Spark's readers of lines decompress a file, and the mark that they leave out at its start.
PACKED, BOM = re.compile(r"\.(deflate|gz|bz2|snappy|lz4|zst|zstd|lzo|passthrough)$", re.IGNORECASE), b"\xef\xbb\xbf"


def binary_files(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """Files under ``path`` as ``path, file_name, length, content``."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(path).select(
        "path", F.element_at(F.split("path", "/"), -1).alias("file_name"), "length", "content"
    )


@dataclass
class Hashed:
    """A file of which the first ``taken`` bytes are in ``state``; ``begun`` if a line was."""

    path: str
    length: int
    state: bytes
    taken: int = 0
    begun: bool = False


def _take_up(nth: int, at: Hashed) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Hashes the lines of a split, each with the line feed before it, on top of what lies before the split."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, taken, begun = Sha256(at.state), at.taken, at.begun
        for batch in batches:
            lines = batch.column("line")
            if not len(lines):
                continue
            _, offsets, data = lines.buffers()
            ends = np.frombuffer(offsets, np.int64 if pa.types.is_large_binary(lines.type) else np.int32)
            # The first line of a file has no line feed before it.
            first, last = int(ends[lines.offset]) + (not begun), int(ends[lines.offset + len(lines)])
            found.update(data.address + first, last - first)
            taken, begun = taken + last - first, True
        yield pa.RecordBatch.from_pydict(
            {"nth": pa.array([nth], pa.int32()), "taken": pa.array([taken], pa.int64()), "begun": [begun], "state": [found.state]}
        )

    return run


def _literal(path: str) -> str:
    """A path in which no character stands for others."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def _hash_in_splits(spark: SparkSession, files: list[Hashed]) -> None:
    """Brings each file to its end: a job per split, in which each file has one task that goes on from the state before.

    A file is read as lines, since these can be read in splits; lines are bytes here, whatever they hold. Only the states
    come back, some hundred bytes a file.
    """
    sc, line = spark.sparkContext, F.concat(F.lit(b"\n"), F.col("value").cast("binary")).alias("line")
    with one_split_order(spark):
        lines = [spark.read.text(_literal(f.path), lineSep="\n").select(line) for f in files]
        splits = [own.rdd.getNumPartitions() for own in lines]
        for r in range(max(splits)):
            left = [nth for nth, n in enumerate(splits) if r < n]
            parts = [lines[nth].mapInArrow(_take_up(nth, files[nth]), "nth int, taken long, begun boolean, state binary").rdd for nth in left]
            starts = np.cumsum([0, *(splits[nth] for nth in left)])[:-1]
            for row in sc.runJob(sc.union(parts), list, [int(start) + r for start in starts]):
                files[row.nth].taken, files[row.nth].begun, files[row.nth].state = row.taken, row.begun, bytes(row.state)


def split_digests(spark: SparkSession, sized: Sequence[tuple[str, int]], at_once: int = HASHED_FILES) -> list[tuple[str, str]]:
    """(path, SHA-256) of files ``(path, bytes)`` of any size, of which no task reads more than a split."""
    sized, out = sorted(sized, key=lambda f: -f[1]), []
    for first in range(0, len(sized), at_once):
        waiting = [Hashed(path, length, Sha256().state) for path, length in sized[first : first + at_once]]
        _hash_in_splits(spark, waiting)
        short = [f for f in waiting if f.length - f.taken in (len(BOM), len(BOM) + 1)]
        for f in short:
            # Readers leave out such a mark: once more, from behind it.
            f.state, f.taken, f.begun = _with(Sha256(), BOM).state, len(BOM), False
        if short:
            _hash_in_splits(spark, short)
        for f in waiting:
            if f.length - f.taken not in (0, 1):
                raise OSError(f"{f.path}: {f.taken} of {f.length} bytes could be read")
            # What is left is the line feed at the end.
            out.append((f.path, _with(Sha256(f.state), b"\n" * (f.length - f.taken)).hexdigest()))
    return out


def _with(found: Sha256, more: bytes) -> Sha256:
    found.update(pa.py_buffer(more).address, len(more))
    return found


def with_sha256(files: DataFrame, whole: int = WHOLE_BYTES) -> DataFrame:
    """``files`` with ``sha256`` in the place of ``content``; more than ``whole`` bytes are hashed split by split.

    Only compressed files by their name are read whole whatever their size, as readers of lines would decompress them.
    """
    spark = files.sparkSession
    small = files.where(F.col("length") <= whole).withColumn("sha256", F.sha2("content", 256)).drop("content")
    large = [(f.path, f.length) for f in files.where(F.col("length") > whole).select("path", "length").collect()]
    if not large:
        return small
    digests = split_digests(spark, [f for f in large if not PACKED.search(f[0])])
    found = spark.createDataFrame(digests, "path string, sha256 string")
    for path, _ in large:
        if PACKED.search(path):
            found = found.unionByName(binary_files(spark, _literal(path)).select("path", F.sha2("content", 256).alias("sha256")))
    return small.unionByName(files.where(F.col("length") > whole).drop("content").join(found, "path"))


def file_digests(files: DataFrame) -> DataFrame:
    """SHA-256 and size of each file."""
    return with_sha256(files).select("file_name", "sha256", F.col("length").alias("size_bytes"))


def split_parser(mark: str) -> Callable[[bytes], list[str]]:
    """A page parser for plain text: every ``mark`` ends a page."""
    return lambda content: content.decode("utf-8").split(mark)


def by_bytes(batch: pa.RecordBatch, column: str, most: int = PARSE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose values of a column hold about ``most`` bytes together; a larger value is a part of its own."""
    start, held = 0, 0
    for row, value in enumerate(batch.column(column)):
        size = len(value.as_buffer() or b"")
        if row > start and held + size > most:
            yield batch.slice(start, row - start)
            start, held = row, 0
        held += size
    if batch.num_rows > start:
        yield batch.slice(start)


def document_pages(
    files: DataFrame,
    parser: Callable[[bytes], list[str]],
    source_type: str = "pdf",
    method: str = "page_parser",
    keep: Sequence[str] = (),
) -> DataFrame:
    """One row per page of each file ``(file_name, content)``.

    ``parser`` turns the bytes of one file into its page texts; everything else is done by built-in functions.
    """
    named = files.select(
        "file_name", *keep, document_id(F.col("file_name"), F.sha2("content", 256)).alias("document_id"), "content"
    )
    raw = T.StructType(
        [f for f in named.schema if f.name != "content"]
        + [T.StructField("page", T.LongType()), T.StructField("raw", T.StringType())]
    )

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, "content"):
                pages = [parser(content.as_py()) for content in part.column("content")]
                owner = pa.array([i for i, own in enumerate(pages) for _ in own], pa.int64())
                rows = {n: part.column(n).take(owner) for n in part.schema.names if n != "content"}
                rows["page"] = pa.array([n for own in pages for n in range(1, len(own) + 1)], pa.int64())
                rows["raw"] = pa.array([text for own in pages for text in own], pa.string())
                yield pa.RecordBatch.from_pydict(rows)

    text = named.mapInArrow(parse, raw).withColumn("text", normalize_lines(F.col("raw"))).drop("raw")
    location = F.struct(F.col("file_name").alias("file"), "page")
    return text.select(
        "document_id", "file_name", *keep, "page", "text", F.length("text").alias("char_count"),
        F.lit(source_type).alias("source_type"),
        F.struct(
            F.col("document_id").alias("source_id"), F.lit(source_type).alias("source_type"),
            location.alias("location"), F.lit(method).alias("extraction_method"),
        ).alias("provenance"),
    )


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files as ``value, file, line``, ``line`` counting from 1 in each file, blank lines included.

    A file may be read in several splits. The lines of each split are counted first, in a pass that parses nothing; what
    lies before a split is a sum over the earlier splits of its file, and the rows of a split stand in order.
    """
    meta = {"file": "_metadata.file_path", "start": "_metadata.file_block_start"}
    rows = spark.read.text(path).select("value", *[F.col(c).alias(n) for n, c in meta.items()]).withColumn("nth", F.monotonically_increasing_id())
    splits = rows.groupBy("file", "start").agg(F.count("*").alias("lines"), F.min("nth").alias("first"))
    earlier = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    before = staged(splits.select("file", "start", (F.coalesce(F.sum("lines").over(earlier), F.lit(0)) - F.col("first") + 1).alias("shift")), "splits")
    return rows.join(before, ["file", "start"]).select("value", "file", (F.col("nth") + F.col("shift")).alias("line"))


def read_jsonl(spark: SparkSession, path: str, schema: str | T.StructType, strict: bool = True) -> DataFrame:
    """JSON lines; blank lines are skipped. A bad line raises with its file and number.

    With ``strict=False`` it is kept in ``_corrupt_record``, with ``_file`` and ``_line``, which are null for good lines.
    """
    kept = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    whole = T.StructType([*kept.fields, T.StructField("_corrupt_record", T.StringType())])
    lines = numbered_lines(spark, path).where(F.trim("value") != "")
    parsed = lines.withColumn("_row", F.from_json("value", whole, {"columnNameOfCorruptRecord": "_corrupt_record"}))
    broken = F.when(F.col("_row").isNull(), F.col("value")).otherwise(F.col("_row._corrupt_record"))
    columns = [F.col("_row")[f.name].alias(f.name) for f in kept.fields]
    if strict:
        where = F.concat(F.col("file"), F.lit(", line "), F.col("line").cast("string"), F.lit(": no such JSON: "), F.substring("value", 1, 200))
        # The check is part of the row, so that it is made whichever columns are read.
        checked = parsed.withColumn("_row", F.when(broken.isNull(), F.col("_row")).otherwise(F.raise_error(where).cast(whole)))
        return checked.select(*columns)
    bad = broken.isNotNull()
    return parsed.select(
        *columns, broken.alias("_corrupt_record"), F.when(bad, F.col("file")).alias("_file"), F.when(bad, F.col("line")).alias("_line")
    )


def read_events(spark: SparkSession, path: str, event_schema: str) -> DataFrame:
    """Events from JSON files holding a bare list or an object with the list under one of ``EVENT_KEYS``."""
    listed = f"array<struct<{event_schema}>>"
    text = spark.read.text(path, wholetext=True).select(F.trim("value").alias("value"))
    wrapped = F.from_json("value", "struct<" + ", ".join(f"{k}: {listed}" for k in EVENT_KEYS) + ">")
    bare = F.when(F.col("value").startswith("["), F.from_json("value", listed))
    found = F.coalesce(bare, *(wrapped[k] for k in EVENT_KEYS))
    missing = F.raise_error(F.lit("no event list in the file")).cast(listed)
    return text.select(F.inline(F.coalesce(found, missing)))


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", "true").option("mode", "FAILFAST").csv(path)
