"""Line dedup by a segment-partition edit join.

Lines (cut at line feeds, blanks at their ends taken off) of at least ``least`` code points take part: MIN_CHARS, or 1 for
all that are not blank. Equal lines are a class. Classes whose lines differ by at most DISTANCE edits are linked; where the
shorter line has under MIN_CHARS code points, by at most one edit for each PER_EDIT of them. A line is split into one
segment more than it may have edits, one of which any near line must hold unchanged, near its place. Each class puts its segments into an index by (length,
segment number, hash); it probes the index of each length from DISTANCE below its own up to its own with the substrings
that can be that segment, where edits before and after it cannot exceed the total. Pairs that meet are verified by the
banded bit-parallel edit distance.

A key that more than HOT index entries share would pair them all. Its entries and probes take a longer key instead: the
longer side of the line, beside the shared segment, is split into as many parts again, of which one must be unchanged
too. Which keys are hot is told by a bitmap, alike for both sides. Entries and probes carry counts of their
line's characters, and the join passes on only pairs whose counts allow so few edits: variants of one line with other
words in other places share keys, but meet no further.

A line is kept if it is the first of its class, by (doc_id, line number), and no class linked to it begins earlier.
Null or empty text has no lines that take part. Null ids come last. Rows that agree in id and text are one document.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from tagtrail.llm.bitmap import bitmap, may_hold
from tagtrail.llm.edit_distance import within
from tagtrail.llm.texts import offsets_of, slices
from tagtrail.session import staged

DISTANCE = 2
MIN_CHARS = 20
PER_EDIT = 10
HOT = 64
_BLANKS = " \t\r\x0b\x0c"


def lines_of(text: str, least: int = MIN_CHARS) -> list[tuple[int, str]]:
    """(number, line) of the lines that take part."""
    found = ((n, line.strip(_BLANKS)) for n, line in enumerate(text.split("\n")))
    return [(n, line) for n, line in found if len(line) >= least]


def edits(length: int, most: int) -> int:
    """Edits by which a line of ``length`` may differ from one that is not shorter."""
    return most if length >= MIN_CHARS else min(most, length // PER_EDIT)


def segments(length: int, parts: int) -> list[tuple[int, int]]:
    """(start, size) of ``parts`` segments of a line, sizes differing by one at most, the longer ones last."""
    small, longer = divmod(length, parts)
    out, at = [], 0
    for k in range(parts):
        size = small + (k >= parts - longer)
        out.append((at, size))
        at += size
    return out


def places(length: int, of: int, number: int, start: int, size: int, most: int) -> range:
    """Where in a line of ``length`` the segment of a line of ``of`` (not longer) can lie.

    Edits before the segment number at most its number of earlier segments, or else an earlier one is the witness; the
    same holds behind it.
    """
    more = length - of
    low = max(0, start - number, start + more - (most - number))
    high = min(length - size, start + number, start + more + (most - number))
    return range(low, high + 1)


@functools.lru_cache(maxsize=8192)
def index_plan(length: int, most: int) -> list[tuple[int, int, int, int, int]]:
    """(seed, start, start, size, length) of each segment of a line of this length, none if it may have no edits."""
    own = edits(length, most)
    return [(length * 64 + k, a, a, n, length) for k, (a, n) in enumerate(segments(length, own + 1))] if own else []


@functools.lru_cache(maxsize=8192)
def probe_plan(length: int, most: int) -> list[tuple[int, int, int, int, int]]:
    """(seed, start here, start there, size, length there) of what can be a segment of a line that is not longer."""
    out = []
    for of in range(max(1, length - most), length + 1):
        own = edits(of, most)
        if own and length - of <= own:
            for k, (a, n) in enumerate(segments(of, own + 1)):
                out += [(of * 64 + k, p, a, n, of) for p in places(length, of, k, a, n, own)]
    return out


def planned_keys(lines: list[str], plan, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The keys that ``plan`` gives for each line, in a row, and where each line's begin."""
    keys, sizes, digest = [], [], xxhash.xxh64_intdigest
    for line in lines:
        data, steps = line.encode("utf-32-le", "surrogatepass"), plan(len(line), most)
        keys += [digest(data[4 * p : 4 * (p + n)], seed) for seed, p, _, n, _ in steps]
        sizes.append(len(steps))
    return np.array(keys, dtype=np.uint64), offsets_of(sizes)


def longer_keys(key: int, line: str, start: int, there: int, size: int, of: int, most: int, probe: bool) -> list[int]:
    """Keys that a hot key gives way to; of the index side if not ``probe``. The side is chosen by the line of the index."""
    most = edits(of, most)
    right = of - there - size >= there
    side = line[start + size :] if right else line[:start]
    length = of - there - size if right else there
    out = []
    for k, (a, n) in enumerate(segments(length, most + 1)):
        for p in range(max(0, a - most), min(len(side) - n, a + most) + 1) if probe else (a,):
            out.append(xxhash.xxh64_intdigest(side[p : p + n].encode("utf-8", "surrogatepass"), (key + k) & ((1 << 64) - 1)))
    return out


def line_ids(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hi, lo) of each line: a 64-bit hash, and how often each of 16 classes of characters occurs, modulo 16.

    Together they are the identity of a line. The counts also tell lines apart before any text is read: an edit changes
    two of them at most.
    """
    hi = np.fromiter((xxhash.xxh3_64_intdigest(x.encode("utf-8", "surrogatepass")) for x in lines), dtype=np.uint64, count=len(lines))
    codes = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), dtype="<u4") & np.uint32(15)
    owner = np.repeat(np.arange(len(lines), dtype=np.int64) * 16, [len(x) for x in lines])
    counts = np.bincount(owner + codes, minlength=16 * len(lines)).reshape(-1, 16).astype(np.uint64) & np.uint64(15)
    return hi, (counts << (np.arange(16, dtype=np.uint64) * np.uint64(4))).sum(axis=1, dtype=np.uint64)


def _similar(a: Column, b: Column, most: int) -> Column:
    """No more than twice ``most`` of the 16 counts differ."""
    differ = a.bitwiseXOR(b)
    for width in (1, 2):
        differ = differ.bitwiseOR(F.shiftrightunsigned(differ, width))
    return F.bit_count(differ.bitwiseAND(F.lit(0x1111111111111111))) <= 2 * most


def _signed(values: list[int] | np.ndarray) -> pa.Array:
    return pa.array(np.asarray(values, dtype=np.uint64).view(np.int64))


def _lines(documents: DataFrame, text: str, columns: str, rows, least: int, carry: list[Column] = ()) -> DataFrame:
    """Run ``rows(lines, part)``, which gives one array per column, over slices of documents; lines: (row, number, line)."""
    names = [c.split(" ")[0] for c in columns.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text"):
                lines = [(k, n, line) for k, t in enumerate(part.column("_text").to_pylist()) for n, line in lines_of(t or "", least)]
                yield pa.RecordBatch.from_arrays(rows(lines, part), names=names)

    return documents.select(*carry, F.col(text).alias("_text")).mapInArrow(run, columns)


def _occurrences(documents: DataFrame, doc_id: str, text: str, least: int) -> DataFrame:
    kind = documents.schema[doc_id].dataType.simpleString()

    def rows(lines, part):
        hi, lo = line_ids([line for _, _, line in lines])
        keys = part.select(["doc_id", "doc_hash"]).take(pa.array([k for k, _, _ in lines], pa.int64()))
        return [*keys.columns, pa.array([n for _, n, _ in lines], pa.int32()), _signed(hi), _signed(lo)]

    carry = [F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("doc_hash")]
    return _lines(documents, text, f"doc_id {kind}, doc_hash bigint, line_no int, hi bigint, lo bigint", rows, least, carry)


def _fresh(lines):
    """Each line once per slice."""
    return list(dict.fromkeys(line for _, _, line in lines))


def _rows(lines: list[str], keys: np.ndarray, offsets: np.ndarray, more: list[tuple[int, int]] = ()) -> list[pa.Array]:
    """Columns key, hi, lo of the keys of each line, and of ``more``, pairs of a key and the number of its line."""
    hi, lo = line_ids(lines)
    at = np.concatenate([np.repeat(np.arange(len(lines)), np.diff(offsets)), np.array([n for _, n in more], dtype=np.int64)])
    return [_signed(np.concatenate([keys, np.array([k for k, _ in more], dtype=np.uint64)])), _signed(hi[at]), _signed(lo[at])]


_KEYED = "key bigint, hi bigint, lo bigint"


def candidates(documents: DataFrame, text: str, most: int, hot: int, least: int = MIN_CHARS) -> DataFrame:
    """Pairs of different classes that share a key: (a_hi, a_lo, b_hi, b_lo), each once, a < b."""
    context = documents.sparkSession.sparkContext
    least = max(least, PER_EDIT)  # shorter lines have no edits, so no keys

    def entry(lines, part):
        fresh = _fresh(lines)
        return _rows(fresh, *planned_keys(fresh, index_plan, most))

    index = staged(_lines(documents, text, _KEYED, entry, least).distinct(), "segments")
    heated = staged(index.groupBy("key").count().where(F.col("count") > hot).select("key"), "hot")
    bits = bitmap(heated, "key")
    shared = context.broadcast(bits)

    def longer(lines: list[str], keys: np.ndarray, offsets: np.ndarray, plan, probe: bool) -> list[tuple[int, int]]:
        """The longer keys in place of the hot ones, each with the number of its line."""
        out = {}
        at = np.flatnonzero(may_hold(shared.value, keys))
        for k, n in zip(at.tolist(), (np.searchsorted(offsets, at, side="right") - 1).tolist()):
            _, here, there, size, of = plan(len(lines[n]), most)[k - offsets[n]]
            out |= dict.fromkeys((x, n) for x in longer_keys(int(keys[k]), lines[n], here, there, size, of, most, probe))
        return list(out)

    def probe(lines, part):
        fresh = _fresh(lines)
        keys, offsets = planned_keys(fresh, probe_plan, most)
        return _rows(fresh, keys, offsets, longer(fresh, keys, offsets, probe_plan, True))

    def rekeyed(lines, part):
        fresh = _fresh(lines)
        keys, offsets = planned_keys(fresh, index_plan, most)
        return _rows(fresh, keys[:0], np.zeros(len(fresh) + 1, dtype=np.int64), longer(fresh, keys, offsets, index_plan, False))

    entries = index
    if bits.any():  # what the bitmap takes for hot without need gets longer keys besides its own
        entries = index.join(heated, "key", "left_anti").unionByName(_lines(documents, text, _KEYED, rekeyed, least).distinct())
    probes = _lines(documents, text, _KEYED, probe, least)
    a, b = (x.select("key", F.col("hi").alias(f"{n}_hi"), F.col("lo").alias(f"{n}_lo")) for x, n in ((entries, "x"), (probes, "y")))
    met = a.join(b, "key").where(F.expr("x_hi <> y_hi or x_lo <> y_lo") & _similar(F.col("x_lo"), F.col("y_lo"), most))
    first = (F.col("x_hi") < F.col("y_hi")) | ((F.col("x_hi") == F.col("y_hi")) & (F.col("x_lo") < F.col("y_lo")))
    side = lambda one, other, n: F.when(first, F.col(f"{one}_{n}")).otherwise(F.col(f"{other}_{n}"))
    return met.select(*[side(*xy, n).alias(f"{to}_{n}") for to, xy in (("a", ("x", "y")), ("b", ("y", "x"))) for n in ("hi", "lo")]).distinct()


def _texts(documents: DataFrame, text: str, wanted: DataFrame, least: int) -> DataFrame:
    """(hi, lo, line) of the classes of ``wanted``, and of few others."""
    shared = documents.sparkSession.sparkContext.broadcast(bitmap(wanted, "hi"))

    def rows(lines, part):
        fresh = _fresh(lines)
        hi, lo = line_ids(fresh)
        at = np.flatnonzero(may_hold(shared.value, hi))
        return [_signed(hi[at]), _signed(lo[at]), pa.array([fresh[k] for k in at], pa.string())]

    return _lines(documents, text, "hi bigint, lo bigint, line string", rows, least).groupBy("hi", "lo").agg(F.first("line").alias("line"))


def links(documents: DataFrame, text: str = "text", most: int = DISTANCE, hot: int = HOT, least: int = MIN_CHARS) -> DataFrame:
    """Pairs of different lines within ``most`` edits, or as few as the shorter line may have: (a_hi, a_lo, b_hi, b_lo, distance), each once."""
    pairs = staged(candidates(documents, text, most, hot, least), "pairs")
    wanted = pairs.select(F.col("a_hi").alias("hi"), F.col("a_lo").alias("lo")).unionByName(pairs.select(F.col("b_hi").alias("hi"), F.col("b_lo").alias("lo"))).distinct()
    texts = staged(_texts(documents, text, wanted, least), "texts")
    a, b = (texts.select(F.col("hi").alias(f"{n}_hi"), F.col("lo").alias(f"{n}_lo"), F.col("line").alias(n)) for n in "ab")
    work = pairs.join(a, ["a_hi", "a_lo"]).join(b, ["b_hi", "b_lo"]).select("a_hi", "a_lo", "b_hi", "b_lo", "a", "b")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                a, b = part.column("a").to_pylist(), part.column("b").to_pylist()
                found = within(a, b, most)
                near = found <= np.array([edits(min(len(x), len(y)), most) for x, y in zip(a, b)], dtype=np.int64)
                yield pa.RecordBatch.from_arrays([*part.columns[:4], pa.array(found)], names=["a_hi", "a_lo", "b_hi", "b_lo", "distance"]).filter(pa.array(near))

    return work.mapInArrow(verify, "a_hi bigint, a_lo bigint, b_hi bigint, b_lo bigint, distance bigint")


def repeated_lines(
    documents: DataFrame, doc_id: str = "doc_id", text: str = "text", most: int = DISTANCE, hot: int = HOT, least: int = MIN_CHARS
) -> DataFrame:
    """Each line that takes part: doc_id, doc_hash, line_no, class_doc and class_line (the first line of its class),
    n_links (lines of other classes within ``most`` edits, counted as classes), near_doc and near_line (the first
    line of the linked class that begins earliest, null without links), kept."""
    lines = staged(_occurrences(documents, doc_id, text, least), "lines")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "line_no")
    classes = staged(lines.groupBy("hi", "lo").agg(F.min(place).alias("first"), F.count("*").alias("n")), "classes")
    near = staged(links(documents, text, most, hot, least), "links")
    ends = near.select(*[F.col(f"a_{n}").alias(n) for n in ("hi", "lo")], *[F.col(f"b_{n}").alias(f"to_{n}") for n in ("hi", "lo")])
    ends = ends.unionByName(near.select(*[F.col(f"b_{n}").alias(n) for n in ("hi", "lo")], *[F.col(f"a_{n}").alias(f"to_{n}") for n in ("hi", "lo")]))
    other = classes.select(F.col("hi").alias("to_hi"), F.col("lo").alias("to_lo"), F.col("first").alias("to_first"))
    linked = ends.join(other, ["to_hi", "to_lo"]).groupBy("hi", "lo").agg(F.count("*").alias("n_links"), F.min("to_first").alias("near"))
    # A class of one line without links needs no look-up: the line is its own first.
    told = classes.join(linked, ["hi", "lo"], "left").where("n > 1 or n_links is not null").select("hi", "lo", "first", "n_links", "near")
    joined = lines.join(told, ["hi", "lo"], "left").withColumn("own", place)
    first = F.coalesce("first", "own")
    kept = (F.col("own") == first) & F.coalesce(first < F.col("near"), F.lit(True))
    return joined.select(
        "doc_id", "doc_hash", "line_no", first["doc_id"].alias("class_doc"), first["line_no"].alias("class_line"), F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.col("near.doc_id").alias("near_doc"), F.col("near.line_no").alias("near_line"), kept.alias("kept"),
    )


def without_repeats(
    documents: DataFrame, doc_id: str = "doc_id", text: str = "text", n_chars: str | None = "n_chars", least: int = MIN_CHARS
) -> DataFrame:
    """``documents`` with the lines that are not kept taken out of their texts, and ``n_chars`` set to the new length.

    A document that loses all its lines stays with an empty text; a document that loses none stays as it is.
    """
    found = repeated_lines(documents, doc_id, text, least=least).where(~F.col("kept"))
    gone = staged(found.select(F.col("doc_id").alias("_doc"), F.col("doc_hash").alias("_hash"), "line_no").distinct().groupBy("_doc", "_hash").agg(F.collect_list("line_no").alias("_gone")), "repeats")
    joined = documents.join(gone, F.col(doc_id).eqNullSafe(F.col("_doc")) & F.xxhash64(text).eqNullSafe(F.col("_hash")), "left")
    lines = F.split(text, "\n")
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "_gone")
    rest = F.array_join(F.transform(left, lambda k: F.get(lines, k)), "\n")
    new = {text: F.when(F.col("_gone").isNull(), F.col(text)).otherwise(rest)}
    changed = joined.withColumns(new)
    if n_chars in documents.columns:
        changed = changed.withColumn(n_chars, F.when(F.col("_gone").isNull(), F.col(n_chars)).otherwise(F.length(text)).cast(documents.schema[n_chars].dataType))
    return changed.select(*documents.columns)
