"""Many phrases at once in many texts: an automaton with failure links that reads each text once.

The phrases of a dictionary are cut by hash into parts of at most PART_PHRASES. A part goes to the tasks as a list, and
each Python worker builds its automaton once for all tasks that it runs. Dictionaries beyond one part read the texts once
per part. Phrases and texts are compared as they are given: lower-case both for matches in any case. Null and empty
phrases match nothing; a null text has no matches; repeated phrases count once.
"""

from __future__ import annotations

import uuid
from collections import OrderedDict
from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

PART_PHRASES = 200_000
#: Fixed value: the characters of tags. A match that continues in one of them is part of another word.
TAG_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_.-")

Span = tuple[int, int]
_built: OrderedDict[str, ahocorasick.Automaton | None] = OrderedDict()


def automaton(phrases: list[str], name: str | None = None) -> ahocorasick.Automaton | None:
    """The automaton of a list, None for an empty one. With a name it is kept in this process; the last four are."""
    if name is not None and name in _built:
        return _built[name]
    found = ahocorasick.Automaton()
    for phrase in phrases:
        found.add_word(phrase, len(phrase))
    if len(found):
        found.make_automaton()
    else:
        found = None
    if name is not None:
        _built[name] = found
        while len(_built) > 4:
            _built.popitem(last=False)
    return found


def all_spans(machine: ahocorasick.Automaton | None, text: str | None) -> list[Span]:
    """Start and end of each occurrence of each phrase, those that lie in others included."""
    return [(end + 1 - size, end + 1) for end, size in machine.iter(text)] if machine and text else []


def whole_word_spans(machine: ahocorasick.Automaton | None, text: str | None) -> list[Span]:
    """Those occurrences that no tag character precedes or follows."""
    n = len(text or "")
    return [(a, b) for a, b in all_spans(machine, text) if (a == 0 or text[a - 1] not in TAG_CHARS) and (b == n or text[b] not in TAG_CHARS)]


def leftmost_longest(spans: list[Span]) -> list[Span]:
    """Of the spans those that a reader from the left takes, who takes the longest at each place and goes on behind it."""
    out, at = [], 0
    for a, b in sorted(set(spans), key=lambda s: (s[0], -s[1])):
        if a >= at:
            out.append((a, b))
            at = b
    return out


def parts_of(phrases: DataFrame, column: str, most: int = PART_PHRASES) -> list[list[str]]:
    """The different phrases, in lists of about ``most``; each list alone is read by the driver."""
    named = phrases.select(F.col(column).alias("phrase")).where(F.length("phrase") > 0).distinct()
    parts = -(-named.count() // most)
    dealt = named.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(max(1, parts))))
    return [[r.phrase for r in dealt.where(F.col("part") == p).select("phrase").collect()] for p in range(parts)]


def find(
    texts: DataFrame, key: str, text: str, phrases: DataFrame, column: str, spans: Callable[[ahocorasick.Automaton | None, str | None], list[Span]] = all_spans,
    most: int = PART_PHRASES,
) -> DataFrame:
    """(key, spans) of each text with occurrences, one row per text and part; ``spans`` are starts and ends in code points."""
    spark = texts.sparkSession
    schema = T.StructType([texts.schema[key], T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])))])
    source = texts.select(key, F.col(text).alias("_text"))

    def run_part(part: list[str]):
        shared, name = spark.sparkContext.broadcast(part), uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            machine = automaton(shared.value, name)
            for batch in batches:
                found = [spans(machine, t) for t in batch.column("_text").to_pylist()]
                rows = [k for k, s in enumerate(found) if s]
                kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
                listed = pa.array([[{"start": a, "end": b} for a, b in found[k]] for k in rows], type=kind)
                yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(rows, pa.int64())), listed], names=[key, "spans"])

        return source.mapInArrow(run, schema)

    out = spark.createDataFrame([], schema)
    for n, part in enumerate(parts_of(phrases, column, most)):
        found = run_part(part)
        out = found if n == 0 else out.unionByName(found)
    return out


def phrases_in(texts: DataFrame, key: str, text: str, phrases: DataFrame, column: str, most: int = PART_PHRASES) -> DataFrame:
    """(key, phrase) of every phrase that occurs anywhere in a text."""
    found = find(texts, key, text, phrases, column, all_spans, most)
    own = texts.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    held = F.array_distinct(F.transform("spans", lambda s: F.substring("_text", s["start"] + 1, s["end"] - s["start"])))
    return found.join(own, found[key].eqNullSafe(own["_key"])).select(key, F.explode(held).alias("phrase")).distinct()


def taken(spans: DataFrame, key: str) -> DataFrame:
    """(key, place, start, end): of the occurrences of each text, over all parts, those of ``leftmost_longest``."""
    merged = spans.groupBy(key).agg(F.flatten(F.collect_list("spans")).alias("spans"))
    schema = T.StructType([spans.schema[key], *[T.StructField(n, T.IntegerType()) for n in ("place", "start", "end")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chosen = [leftmost_longest([(s["start"], s["end"]) for s in own]) for own in batch.column("spans").to_pylist()]
            rows = [(k, n, a, b) for k, own in enumerate(chosen) for n, (a, b) in enumerate(own)]
            keys = batch.column(key).take(pa.array([r[0] for r in rows], pa.int64()))
            yield pa.RecordBatch.from_arrays([keys, *[pa.array([r[n] for r in rows], pa.int32()) for n in (1, 2, 3)]], names=[key, "place", "start", "end"])

    return merged.mapInArrow(run, schema)
