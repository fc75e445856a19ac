"""Pages to chunks, and the tags a chunk mentions."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tagtrail.functions.ids import chunk_id
from tagtrail.functions.text import NOT_TAG_CHARS, TAG_CHARS_ONLY, collapse_ws, strip
from tagtrail.operators import matcher
from tagtrail.operators.joins import split_join
from tagtrail.session import small_or_none, staged
from tagtrail.sources.files import by_bytes

# Fixed values of chunking.
MAX_CHARS = 1600
OVERLAP_CHARS = 250

#: Pages that a split holds as Python strings at once.
SPLIT_ROWS = 128

#: So many named entities or tags are sent to all tasks; more are joined by a shuffle.
BROADCAST_ROWS = 200_000

#: Bytes of texts whose words are looked up at once.
LOOKED_UP_BYTES = 1 << 20


def split_chunks(text: Column, max_chars: int = MAX_CHARS, overlap_chars: int = OVERLAP_CHARS) -> Column:
    """Array of overlapping pieces of a collapsed text, each at most ``max_chars`` long.

    A piece ends at the last space of its second half if there is one; the next starts ``overlap_chars`` before.
    Each cut depends on the one before, so this runs as an Arrow-batched function (a fold of built-in functions
    gives the same pieces and took 25 times as long).
    """
    if max_chars <= 0:
        raise ValueError("max_chars must be greater than 0")
    if not 0 <= overlap_chars < max_chars:
        raise ValueError("overlap_chars must be >= 0 and < max_chars")

    half, listed = max_chars // 2, pa.list_(pa.string())

    def cuts(line: str) -> list[tuple[int, int]]:
        """(start, end) of each piece. The last space before a limit is looked up in the sorted places of all spaces."""
        spaces = np.flatnonzero(np.frombuffer(line.encode("utf-32-le", "surrogatepass"), dtype="<u4") == 32)
        bounds = [(0, len(line))]
        while (start := bounds[-1][0]) + max_chars < len(line):
            nth = np.searchsorted(spaces, start + max_chars) - 1
            at_space = nth >= 0 and spaces[nth] >= start + max(half, 1)
            end = int(spaces[nth]) if at_space else start + max_chars
            bounds[-1] = (start, end)
            bounds.append((max(end - overlap_chars, start + 1), len(line)))
        return bounds

    def pieces(line: str | None) -> list[str]:
        stripped = (line[a:b].strip() for a, b in cuts(line)) if line else ()
        return [piece for piece in stripped if piece]

    @F.arrow_udf("array<string>")
    def split(lines: pa.Array) -> pa.Array:
        # A batch may hold very many pages: only SPLIT_ROWS of them are Python strings at once.
        parts = (lines.slice(start, SPLIT_ROWS) for start in range(0, len(lines), SPLIT_ROWS))
        return pa.concat_arrays([pa.array([], listed), *(pa.array([pieces(line) for line in part.to_pylist()], listed) for part in parts)])

    return split(text)


def chunk_pages(
    pages: DataFrame,
    max_chars: int = MAX_CHARS,
    overlap_chars: int = OVERLAP_CHARS,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Pages to chunks with stable ids; pages without text give none."""
    flat = pages.select("document_id", "file_name", "page", *keep, collapse_ws(F.col("text")).alias("text"))
    pieces = flat.withColumn("pieces", split_chunks(F.col("text"), max_chars, overlap_chars)).drop("text")
    # The outer form keeps the optimizer from running the split once more to drop pages without pieces.
    numbered = pieces.select(
        "*", F.size("pieces").alias("chunk_count_on_page"), F.posexplode_outer("pieces").alias("chunk_index", "text")
    )
    return numbered.where(F.col("text").isNotNull()).select(
        chunk_id(F.col("document_id"), F.col("page"), F.col("chunk_index")).alias("chunk_id"),
        "document_id", "file_name", "page", *keep, "chunk_index", "chunk_count_on_page", "text",
        F.length("text").alias("char_count"),
    )


def with_chunk_provenance(chunks: DataFrame, source_type: str = "pdf", method: str = "page_text") -> DataFrame:
    location = F.struct(F.col("file_name").alias("file"), "page", "chunk_index")
    return chunks.withColumn(
        "provenance",
        F.struct(
            F.col("document_id").alias("source_id"), F.lit(source_type).alias("source_type"),
            location.alias("location"), F.lit(method).alias("extraction_method"),
        ),
    )


def page_text_counts(pages: DataFrame) -> DataFrame:
    """How many pages have text and how many have none."""
    empty = F.length(collapse_ws(F.coalesce("text", F.lit("")))) == 0
    return pages.agg(
        F.count("*").alias("pages"), F.count_if(empty).alias("empty_pages"), F.count_if(~empty).alias("text_pages")
    )


def document_catalog(pages: DataFrame) -> DataFrame:
    return pages.groupBy("document_id", "file_name").agg(
        F.count("*").alias("page_count"),
        F.sum(F.length("text")).alias("total_characters"),
    ).withColumn("status", F.lit("parsed"))


def _words(chunks: DataFrame) -> DataFrame:
    return chunks.select("chunk_id", F.posexplode(F.split("text", NOT_TAG_CHARS)).alias("place", "word"))


def _whole_tags(tags: DataFrame) -> DataFrame:
    """Lower-cased tags of which a spelling is made only of tag characters, as ``key``."""
    # Decided per key by an aggregate, so that the pattern is not also tried on every word of the text.
    whole = F.max(F.col("tag").rlike(TAG_CHARS_ONLY))
    return tags.groupBy(F.lower("tag").alias("key")).agg(whole.alias("whole")).where("whole").select("key")


def _first_places(texts: pa.BinaryArray, tags: pa.Array) -> pa.ListArray:
    """Of each text the first ``(place, tag, matched)`` of each tag in it, in order of place.

    Texts are cut as bytes: no byte of a character beyond ASCII belongs to a tag. Java's patterns took ten times as long.
    """
    words = pc.split_pattern_regex(texts, NOT_TAG_CHARS)
    flat, sizes = words.flatten().cast(tags.type), pc.list_value_length(words).fill_null(0).to_numpy()
    rows, starts = np.repeat(np.arange(len(words)), sizes), np.cumsum(sizes, dtype=np.int64) - sizes
    which = pc.index_in(pc.ascii_lower(flat), value_set=tags).fill_null(-1).to_numpy().astype(np.int64)
    held = np.flatnonzero(which >= 0)
    first = np.sort(held[np.unique(rows[held] * len(tags) + which[held], return_index=True)[1]])
    ends = np.concatenate([[0], np.cumsum(np.bincount(rows[first], minlength=len(words)))])
    found = pa.StructArray.from_arrays(
        [pa.array(first - starts[rows[first]], pa.int32()), tags.take(pa.array(which[first])), flat.take(pa.array(first))], names=["place", "tag", "matched"]
    )
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), found)


def _first_mentions(spark: SparkSession, text: Column, keys: list) -> Column:
    """``place, tag, matched`` of each of the tags in a text, found where the text stands."""
    shared = spark.sparkContext.broadcast([k.key for k in keys])

    @F.arrow_udf("array<struct<place: int, tag: string, matched: string>>")
    def look_up(texts: pa.Array) -> pa.Array:
        tags = pa.array(shared.value, pa.string())
        parts = by_bytes(pa.RecordBatch.from_arrays([texts], names=["text"]), "text", LOOKED_UP_BYTES)
        # The first one, of no rows, has the type where there are no parts.
        return pa.concat_arrays([_first_places(texts.slice(0, 0), tags), *(_first_places(part.column("text"), tags) for part in parts)])

    return look_up(text.cast("binary"))


def mentions(chunks: DataFrame, tags: DataFrame) -> DataFrame:
    """Chunks that contain a tag as a whole word, any case: ``chunk_id, tag, matched, place``.

    ``matched`` is the spelling first seen and ``place`` where. Tags made only of tag characters are whole words of
    the text, so this is a look-up of words, or an equality join where the tags are many; see ``phrase_mentions`` for others.
    """
    whole = _whole_tags(tags)
    few = small_or_none(whole, BROADCAST_ROWS)
    if few is None:
        found = _words(chunks).withColumn("key", F.lower("word")).join(whole, "key").select("chunk_id", F.col("key").alias("tag"), F.col("word").alias("matched"), "place")
    else:
        found = chunks.select("chunk_id", F.inline(_first_mentions(chunks.sparkSession, F.col("text"), few)))
    return found.groupBy("chunk_id", "tag").agg(F.min_by("matched", "place").alias("matched"), F.min("place").alias("place"))


def mentioned_entities(chunks: DataFrame, tags: DataFrame, entities: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """``mention_edges`` of ``mentions``, with the columns ``keep`` of the chunk; a repeated chunk gives its edges again.

    The words of a chunk meet the entities where the chunk stands, so that nothing but rare large tables of entities makes
    a shuffle, and the edges of a chunk stay together.
    """
    named = entities.select("entity_id", F.lower(F.coalesce("source_column", "entity_id")).alias("tag"))
    named = staged(named.join(_whole_tags(tags).withColumnRenamed("key", "tag"), "tag", "left_semi"), "named")
    words = F.array_distinct(F.transform(F.split("text", NOT_TAG_CHARS), lambda w: F.lower(w)))
    found = chunks.select("chunk_id", *keep, F.explode(words).alias("tag"))
    if named.count() <= BROADCAST_ROWS:
        return found.join(F.broadcast(named), "tag").select("chunk_id", "entity_id", *keep)
    return split_join(staged(found, "words"), named, ["tag"], "inner", spread=["chunk_id"]).select("chunk_id", "entity_id", *keep)


def phrase_mentions(chunks: DataFrame, tags: DataFrame) -> DataFrame:
    """As ``mentions`` for tags that may hold other characters (spaces, slashes), longest match first.

    Each text is read once by an automaton of all tags; ``place`` is the number of the match in its chunk.
    """
    keys = tags.select(F.lower("tag").alias("tag"))
    low = chunks.select("chunk_id", "text", F.lower("text").alias("low"))
    found = matcher.taken(matcher.find(low, "chunk_id", "low", keys, "tag", matcher.whole_word_spans), "chunk_id")
    # Where lower-casing changes the length of a text, its spelling is that of the lower-cased text.
    spelt = F.when(F.length("low") == F.length("text"), F.col("text")).otherwise(F.col("low"))
    part = lambda c: F.substring(c, F.col("start") + 1, F.col("end") - F.col("start"))
    words = found.join(low, "chunk_id").select("chunk_id", "place", part(spelt).alias("word"), part(F.col("low")).alias("tag"))
    return words.groupBy("chunk_id", "tag").agg(F.min_by("word", "place").alias("matched"), F.min("place").alias("place"))


def linked_chunks(chunks: DataFrame, tags: DataFrame) -> DataFrame:
    """``chunk_links`` of ``mentions``, made where the chunk stands. The chunks are read twice, so stage them.

    Rows that share an id have their mentions together, so where there are such, and where the tags are many, these are
    gathered by id.
    """
    few = small_or_none(_whole_tags(tags), BROADCAST_ROWS)
    shared_ids = chunks.groupBy("chunk_id").agg(F.count("*").alias("n")).where((F.col("n") > 1) | F.col("chunk_id").isNull())
    if few is None or not shared_ids.isEmpty():
        return chunk_links(chunks, mentions(chunks, tags))
    return _links(chunks.withColumn("found", _first_mentions(chunks.sparkSession, F.col("text"), few)))


def chunk_links(chunks: DataFrame, found: DataFrame) -> DataFrame:
    """Every chunk with the tags it mentions, in order of appearance; an empty list if none."""
    tags = found.groupBy("chunk_id").agg(F.sort_array(F.collect_list(F.struct("place", "matched"))).alias("found"))
    return _links(chunks.join(tags, "chunk_id", "left"))


def _links(found: DataFrame) -> DataFrame:
    return found.select(
        "chunk_id", "document_id", "file_name", "page",
        F.coalesce(F.col("found")["matched"], F.array().cast("array<string>")).alias("matched_sensor_tags"),
        F.lit("exact_text_match").alias("match_method"),
        F.lit("candidate").alias("status"),
    )


def mention_edges(found: DataFrame, entities: DataFrame) -> DataFrame:
    """Mentions to entities whose source column, or id where there is none, is the tag."""
    named = entities.select("entity_id", F.lower(F.coalesce("source_column", "entity_id")).alias("tag"))
    tagged = staged(found.select("chunk_id", F.lower("tag").alias("tag")), "tagged")
    return split_join(tagged, named, ["tag"], "inner", spread=["chunk_id"]).select("chunk_id", "entity_id")


def dictionary_tags(tags: DataFrame) -> DataFrame:
    """Distinct tags, longest first."""
    return tags.select("tag").distinct().orderBy(F.desc(F.length("tag")), "tag")
