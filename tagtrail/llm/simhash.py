"""SimHash near-dedup: fingerprints of 3-word shingles, linked by pigeonring filtering.

Two fingerprints link if at most DISTANCE of their 64 bits differ. The bits form a ring of SEGMENTS segments. If the
differences of all segments sum to at most d, some segment starts a chain whose first l segments sum to at most
l * d / SEGMENTS for every l. With 2 differences and 7 segments the first three segments of that chain are equal, the
first six differ in one bit at most. Equal segments are the join key, so each start of a chain is one key; the longer
prefixes of the chain are checked in the join, and only what passes meets the full Hamming distance.

Equal fingerprints are one node from the start, so that a third of all rows with one text are one row of the join.
Null or empty text and texts without words have fingerprint zero and link like others. Repeated rows get the same class.
Null ids are rows like others; a class whose ids are all null has a null class id.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from tagtrail.llm.components import connected_components
from tagtrail.llm.texts import map_texts, split_words
from tagtrail.operators.joins import split_join
from tagtrail.session import staged

DISTANCE = 2
SEGMENTS = 7
SHINGLE = 3
SEED = 42
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def shingle_hashes(text: str, shingle: int) -> list[int]:
    """Hash of each run of ``shingle`` words, lower-cased; a shorter text is one run, a text without words has none."""
    joined = b" ".join(w for w in split_words(text))
    if not joined:
        return []
    joined = joined.translate(_LOWER)
    blanks = np.flatnonzero(np.frombuffer(joined, dtype=np.uint8) == 32)
    starts = np.concatenate([[0], blanks + 1])
    ends = np.concatenate([blanks, [len(joined)]])
    digest = xxhash.xxh64_intdigest
    if len(starts) <= shingle:
        return [digest(joined, SEED)]
    pairs = zip(starts[: len(starts) - shingle + 1].tolist(), ends[shingle - 1 :].tolist())
    return [digest(joined[a:b], SEED) for a, b in pairs]


def majority_bits(hashes: np.ndarray) -> int:
    """The number whose bit b is set if it is set in over half of the 64-bit hashes; as a signed 64-bit number, 0 for none."""
    set_bits = np.zeros(64, dtype=np.int64)
    packed = np.ascontiguousarray(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8)
    for part in range(0, len(packed), 8192):  # bits of so many shingles at once
        set_bits += np.unpackbits(packed[part : part + 8192], axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    bits = np.packbits(2 * set_bits > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprint(text: str) -> int:
    """Bit b is set if it is set in over half of the shingles' hashes; as a signed 64-bit number."""
    return majority_bits(np.array(shingle_hashes(text, SHINGLE), dtype=np.uint64))


def fingerprints(documents: DataFrame, text: str = "text", carry=("doc_id",)) -> DataFrame:
    """``fingerprint`` (64 bits as a bigint) of every row."""
    return map_texts(documents, lambda texts, part: {"fingerprint": [fingerprint(t) for t in texts]}, "fingerprint bigint", text, carry)


def _bounds(segments: int) -> list[tuple[int, int]]:
    edges = [round(64 * k / segments) for k in range(segments + 1)]
    return list(zip(edges[:-1], edges[1:]))


def _mask(start: int, length: int, segments: int) -> int:
    """Bits of ``length`` segments from ``start`` on around the ring, as a signed number."""
    bits = 0
    for k in range(start, start + length):
        low, high = _bounds(segments)[k % segments]
        bits |= ((1 << (high - low)) - 1) << low
    return bits - (1 << 64) if bits >> 63 else bits


def _chain_starts(prints: DataFrame, equal: int, segments: int, *carry: str) -> DataFrame:
    """(fingerprint, carried columns, start, key) for each start of a chain; the key is the first ``equal`` segments from there on."""
    starts = F.array(*[F.struct(F.lit(s).alias("start"), F.col("fingerprint").bitwiseAND(F.lit(_mask(s, equal, segments))).alias("key")) for s in range(segments)])
    return prints.select("fingerprint", *carry, F.explode(starts).alias("k")).select("fingerprint", *carry, "k.start", "k.key")


def _equal_segments(distance: int, segments: int) -> int:
    return max(l for l in range(segments + 1) if l * distance < segments)


def links(prints: DataFrame, distance: int = DISTANCE, segments: int = SEGMENTS) -> DataFrame:
    """Pairs (a, b), a < b, of different fingerprints of the column ``fingerprint`` with at most ``distance`` differing bits."""
    equal = _equal_segments(distance, segments)
    keyed = _chain_starts(prints, equal, segments)
    a, b = keyed.withColumnRenamed("fingerprint", "a"), keyed.withColumnRenamed("fingerprint", "b")
    differ = F.col("a").bitwiseXOR(F.col("b"))
    # Many near copies may share a key: their rows are dealt over tasks on one side.
    pairs = split_join(a, b, ["start", "key"], "inner", spread=["a"], counted=keyed).where((F.col("a") < F.col("b")) & _viable(differ, equal, distance, segments))
    return pairs.where(F.bit_count(differ) <= distance).select("a", "b").distinct()


def star_links(prints: DataFrame, node: str = "node", distance: int = DISTANCE, segments: int = SEGMENTS) -> DataFrame:
    """Pairs (a, b), a < b, of nodes whose fingerprints are equal or near, of each chain start only those with its smallest fingerprint.

    As many rows as there are keys at most, however many near copies share one. Nodes that are near each other and not near that
    one are left out, so this is for where a link is checked and those others are found in another way; see ``links``.
    """
    equal = _equal_segments(distance, segments)
    keyed = staged(_chain_starts(prints.select("fingerprint", F.col(node).alias("node")), equal, segments, "node"), "chains")
    least = keyed.groupBy("start", "key").agg(F.min(F.struct("fingerprint", "node")).alias("least"), F.count("*").alias("n")).where("n > 1").drop("n")
    met = split_join(keyed, least, ["start", "key"], "inner", spread=["node"]).where(F.col("node") != F.col("least.node"))
    differ = F.col("fingerprint").bitwiseXOR(F.col("least.fingerprint"))
    near = met.where(_viable(differ, equal, distance, segments) & (F.bit_count(differ) <= distance))
    return near.select(F.least("node", "least.node").alias("a"), F.greatest("node", "least.node").alias("b")).distinct()


def _viable(differ: Column, equal: int, distance: int, segments: int) -> Column:
    """The chain that starts at the pair's key keeps within its budget at each length beyond the equal ones."""
    checks = F.lit(False)
    for s in range(segments):
        chain = F.col("start") == s
        for length in range(equal + 1, segments):
            chain = chain & (F.bit_count(differ.bitwiseAND(F.lit(_mask(s, length, segments)))) <= length * distance // segments)
        checks = checks | chain
    return checks


def near_duplicates(documents: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per row of ``documents``: its id, ``fingerprint`` and ``component_id``, the smallest id of its class."""
    marked = staged(fingerprints(documents, text, [doc_id]), "fingerprints")
    nodes = staged(marked.groupBy("fingerprint").agg(F.min(doc_id).alias("first_id")), "nodes")
    classes = connected_components(links(nodes))
    first = (
        nodes.join(classes, F.col("fingerprint") == F.col("node"))
        .groupBy("component").agg(F.min("first_id").alias("component_id"))
    )
    moved = classes.join(first, "component").select(F.col("node").alias("fingerprint"), "component_id")
    known = nodes.join(moved, "fingerprint", "left").select("fingerprint", F.coalesce("component_id", "first_id").alias("component_id"))
    # A third of all rows may have one fingerprint.
    told = split_join(marked.select(F.col(doc_id).alias("_id"), "fingerprint"), known, ["fingerprint"], "inner", spread=["_id"])
    return told.select(F.col("_id").alias(doc_id), "fingerprint", "component_id")


def without_near_duplicates(documents: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``documents`` with one row per class of near-duplicates: that of the smallest id, null ids last.

    Several rows of that id in the class are told apart by a hash of the text, and rows that agree in that too are one.
    """
    prints = staged(fingerprints(documents.withColumn("_hash", F.xxhash64(text)), text, [doc_id, "_hash"]), "fingerprints")
    rank = F.struct(F.col(doc_id).isNull().alias("none"), F.col(doc_id).alias("id"), F.col("_hash").alias("hash"))
    nodes = staged(prints.groupBy("fingerprint").agg(F.min(rank).alias("first")), "nodes")
    classes = staged(connected_components(links(nodes)), "classes")
    grouped = nodes.join(classes, F.col("fingerprint") == F.col("node"), "left")
    firsts = grouped.groupBy(F.coalesce("component", "fingerprint").alias("class")).agg(F.min("first").alias("first"))
    kept = staged(firsts.select(F.col("first.id").alias("_kept"), F.col("first.hash").alias("_kept_hash")).distinct(), "kept")
    same = F.col(doc_id).eqNullSafe(F.col("_kept")) & F.xxhash64(text).eqNullSafe(F.col("_kept_hash"))
    return documents.join(kept, same, "left_semi").dropDuplicates([doc_id, text])
