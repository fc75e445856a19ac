"""Arrow passes over whole texts, in slices of bounded size, and the word views that the operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Bytes of text that one pass holds as Python objects; a longer text is a slice of its own.
SLICE_BYTES = 2 << 20

#: Words as every contract here counts them: runs of anything but the space and the control characters 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"


def slices(batch: pa.RecordBatch, text: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut a batch where its texts reach SLICE_BYTES, so that memory follows the slice and not the batch."""
    lengths = pyarrow.compute.fill_null(pyarrow.compute.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths)
    start = 0
    while start < len(lengths):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + SLICE_BYTES, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def map_texts(
    df: DataFrame,
    fn: Callable[[list[str], pa.RecordBatch], dict[str, Sequence]],
    fields: str,
    text: str = "text",
    carry: Sequence[str] = (),
    keep: str | None = None,
) -> DataFrame:
    """Add the columns ``fields`` (a DDL string) that ``fn`` computes from whole texts, row by row of a slice.

    ``carry`` names the input columns to return; one that has the name of a new column gives way to it. A null text
    reaches ``fn`` as the empty text. With ``keep``, only rows for which that new boolean column is true come back.
    """
    spark_fields = T.StructType.fromDDL(fields)
    new = spark_fields.fieldNames()
    carried = [c for c in carry if c not in new]
    source = df.select(*dict.fromkeys([*carried, text, *(c for c in carry if c not in carried)]))
    schema = T.StructType([*(df.schema[c] for c in carried), *spark_fields.fields])
    types = [to_arrow_type(f.dataType) for f in spark_fields.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                got = fn([t or "" for t in part.column(text).to_pylist()], part)
                columns = [part.column(c) for c in carried]
                columns += [pa.array(got[n], type=t) for n, t in zip(new, types)]
                out = pa.RecordBatch.from_arrays(columns, names=[*carried, *new])
                yield out.filter(pa.array(got[keep], type=pa.bool_())) if keep else out

    return source.mapInArrow(run, schema)


def split_words(text: str) -> list[bytes]:
    """The WORD runs of a text in UTF-8; ``bytes.split`` cuts at exactly those six characters."""
    return text.encode("utf-8", "surrogatepass").split()


def offsets_of(lengths: Sequence[int]) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(np.asarray(lengths, dtype=np.int64))])


def hash_words(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(crc32, words), dtype=np.uint64, count=len(words))


def segment_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of each segment; a segment's sum depends on its own values only. Empty segments give 0."""
    out = np.zeros((len(offsets) - 1, *values.shape[1:]), dtype=np.float64)
    full = np.flatnonzero(offsets[1:] > offsets[:-1])
    if len(full):
        out[full] = np.add.reduceat(values, offsets[:-1][full], axis=0)
    return out


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, rows: int, where: Column | None = None, seed: int = 7) -> DataFrame:
    """At most ``rows`` labelled documents, by the order of a hash of their ids: (doc_id, text, n_chars, label, part).

    Documents with contradicting labels are left out, repeated labels count once. Of several documents of one id the one
    with the smallest hash of its text is taken. ``part`` is a number of 0 to 9 that
    depends on the id alone, for holding rows out. The bound is on labelled rows for fitting only.
    """
    one = (
        labels.select("doc_id", F.col(label).cast("int").alias("label"))
        .where("doc_id is not null and label is not null")
        .groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("other"))
        .where("label = other").drop("other")
    )
    one = one.where(where) if where is not None else one
    order = F.xxhash64(F.lit(seed), "doc_id")
    chosen = one.orderBy(order, "doc_id").limit(rows).withColumn("part", F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id"), F.lit(10)).cast("int"))
    joined = documents.drop("label", "part").join(chosen, "doc_id")
    # The order of rows that agree in id and text is that of their counts of characters.
    order = F.struct(F.xxhash64("text"), *[c for c in ("n_chars",) if c in documents.columns])
    one_row = joined.groupBy("doc_id").agg(F.min_by(F.struct(*[c for c in joined.columns if c != "doc_id"]), order).alias("_row"))
    return one_row.select("doc_id", "_row.*")


def flat_rows(table: pa.Table, at: str = "at", value: str = "value") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions and values of all rows in a row, and where each row begins, without Python numbers."""
    # A single chunk is used as it is: copies of the sample would stand in the driver side by side.
    lists = [table[c].chunk(0) if table[c].num_chunks == 1 else pa.concat_arrays(table[c].chunks) if table[c].num_chunks else pa.array([], table[c].type) for c in (at, value)]
    sizes = lists[0].value_lengths().to_numpy(zero_copy_only=False)
    return lists[0].flatten().to_numpy(), lists[1].flatten().to_numpy(), offsets_of(sizes)
