"""Benchmark decontamination by greedy string tiling.

Texts are words (runs of letters, digits and underscores, lower case). A document and an item are compared if they share
a seed, five words in a row; of an item shorter than that, all its words. From each document only the stretches that
seeds cover go on, as every tile lies in them. Running Karp-Rabin then finds tiles: windows of a length are hashed by
differences of prefix sums, the longest length with a common window of unmarked words is found by bisection, and all
such windows that do not overlap are marked, item order first; then the next shorter length, down to the seed length.
A tile covers words once on each side, in any order, so that moved sentences count. An item leaks into a document if
tiles cover at least ``COVERAGE`` of its words.

Seeds meet in a join whose document side passes a bitmap of fixed size, made from the item seeds. Null or empty texts
and items have no words and never match. Repeated rows of a document or an item are one. Ids may be null; two texts
under one id are kept apart by a hash of the text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tagtrail.llm.bitmap import bitmap, may_hold
from tagtrail.llm.texts import offsets_of, slices
from tagtrail.session import staged

SEED_WORDS = 5
COVERAGE = 0.8
_TOKEN = re.compile(r"\w+")
_PRIME = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def tokens(text: str) -> list[str]:
    return _TOKEN.findall(text.lower())


def token_hashes(words: list[str]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))


def window_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """Hash of each run of ``length`` words."""
    n = max(0, len(words) - length + 1)
    h = np.full(n, np.uint64(length))
    for k in range(length):
        h = h * np.uint64(_PRIME) + words[k : k + n]
    h ^= h >> np.uint64(29)
    return h * np.uint64(0xBF58476D1CE4E5B9)


class _Windows:
    """Karp-Rabin hashes of any window length from one pass of prefix sums, modulo 2**64."""

    def __init__(self, words: list[str | None], powers: np.ndarray):
        self.words = words
        hashed = np.array([0 if w is None else xxhash.xxh64_intdigest(w) for w in words], dtype=np.uint64)
        self.powers = powers
        self.sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(hashed * powers[: len(words)], dtype=np.uint64)])
        self.marked = np.array([w is None for w in words], dtype=bool)

    def unmarked(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts and hashes of the windows without a marked word."""
        held = np.concatenate([[0], np.cumsum(self.marked)])
        starts = np.flatnonzero(held[length:] == held[: len(held) - length])
        top = len(self.powers) - 1
        return starts, (self.sums[starts + length] - self.sums[starts]) * self.powers[top - starts]


def tiles(pattern: list[str], stretches: list[list[str]], shortest: int) -> list[tuple[int, int, int]]:
    """(start in pattern, start in the stretches joined with gaps of one, length) of the tiles."""
    text: list[str | None] = []
    for part in stretches:
        text += [*part, None]
    size = max(len(pattern), len(text)) + 1
    powers = np.full(size + 1, _PRIME, dtype=np.uint64)
    powers[0] = 1
    powers = np.cumprod(powers, dtype=np.uint64)
    a, b = _Windows(pattern, powers), _Windows(text, powers)
    found: list[tuple[int, int, int]] = []

    def common(length: int) -> bool:
        return bool(np.isin(a.unmarked(length)[1], b.unmarked(length)[1]).any())

    longest = min(len(pattern), len(text))
    while longest >= shortest and common(shortest):
        low, high = shortest, longest
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if common(middle) else (low, middle - 1)
        found += _mark(a, b, low)
        longest = low - 1  # one pass marks all it can of a length
    return found


def _places(b: _Windows, length: int) -> dict[int, list[int]]:
    at: dict[int, list[int]] = {}
    starts, hashes = b.unmarked(length)
    for s, h in zip(starts[::-1].tolist(), hashes[::-1].tolist()):
        at.setdefault(h, []).append(s)
    return at


def _mark(a: _Windows, b: _Windows, length: int) -> list[tuple[int, int, int]]:
    at, found = _places(b, length), []
    starts, hashes = a.unmarked(length)
    for s, h in zip(starts.tolist(), hashes.tolist()):
        if h not in at or a.marked[s : s + length].any():
            continue
        places = at[h]
        while places:
            t = places.pop()
            if not b.marked[t : t + length].any() and a.words[s : s + length] == b.words[t : t + length]:
                a.marked[s : s + length] = b.marked[t : t + length] = True
                found.append((s, t, length))
                break
    return found


def _items(benchmark: DataFrame, item_id: str, text: str) -> DataFrame:
    """(item, item_hash, words, seeds, seed_words) of each item with words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [tokens(t or "") for t in batch.column("_text").to_pylist()]
            size = [min(SEED_WORDS, len(w)) for w in words]
            seeds = [np.unique(window_hashes(token_hashes(w), k)).view(np.int64) if k else [] for w, k in zip(words, size)]
            columns = [batch.column("item"), batch.column("item_hash"), pa.array(words, pa.list_(pa.string())), pa.array(seeds, pa.list_(pa.int64())), pa.array(size, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=["item", "item_hash", "words", "seeds", "seed_words"])

    source = benchmark.select(F.col(item_id).alias("item"), F.xxhash64(text).alias("item_hash"), F.col(text).alias("_text"))
    kind = source.schema["item"].dataType.simpleString()
    found = source.mapInArrow(run, f"item {kind}, item_hash bigint, words array<string>, seeds array<bigint>, seed_words int")
    return found.where("seed_words > 0").dropDuplicates(["item", "item_hash"])


def _covered(documents: DataFrame, doc_id: str, text: str, held: np.ndarray, lengths: list[int]) -> DataFrame:
    """(doc, doc_hash, seeds, stretches) of the documents with a window that the bitmap holds."""
    shared = documents.sparkSession.sparkContext.broadcast((held, lengths))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, sizes = shared.value
        for batch in batches:
            for part in slices(batch, "_text"):
                docs = [tokens(t or "") for t in part.column("_text").to_pylist()]
                starts = offsets_of([len(d) for d in docs])
                flat = token_hashes([w for d in docs for w in d])
                cover = np.zeros(len(flat) + 1, dtype=np.int64)
                hits = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64))]
                for k in sizes:
                    hashed = window_hashes(flat, k)
                    at = np.flatnonzero(may_hold(bits, hashed))
                    at = at[np.searchsorted(starts, at, side="right") == np.searchsorted(starts, at + k - 1, side="right")]
                    np.add.at(cover, at, 1)
                    np.add.at(cover, at + k, -1)
                    hits.append((at, hashed[at]))
                inside = np.cumsum(cover[:-1]) > 0
                where, found = np.concatenate([h[0] for h in hits]), np.concatenate([h[1] for h in hits])
                owner = np.searchsorted(starts, where, side="right") - 1
                rows, seeds, stretches = [], [], []
                for d in np.unique(owner).tolist():
                    own = inside[starts[d] : starts[d + 1]]
                    edges = np.flatnonzero(np.diff(np.concatenate([[0], own.astype(np.int8), [0]])))
                    rows.append(d)
                    seeds.append(np.unique(found[owner == d]).view(np.int64))
                    stretches.append([docs[d][x:y] for x, y in edges.reshape(-1, 2).tolist()])
                keys = part.select(["doc", "doc_hash"]).take(pa.array(rows, pa.int64()))
                yield pa.RecordBatch.from_arrays([*keys.columns, pa.array(seeds, pa.list_(pa.int64())), pa.array(stretches, pa.list_(pa.list_(pa.string())))], names=["doc", "doc_hash", "seeds", "stretches"])

    source = documents.select(F.col(doc_id).alias("doc"), F.xxhash64(text).alias("doc_hash"), F.col(text).alias("_text"))
    kind = source.schema["doc"].dataType.simpleString()
    return source.mapInArrow(run, f"doc {kind}, doc_hash bigint, seeds array<bigint>, stretches array<array<string>>")


def leaks(
    documents: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", coverage: float = COVERAGE
) -> DataFrame:
    """(doc_id, doc_hash, item_id, item_words, tiled_words, n_tiles, coverage) of each item that leaks into a document."""
    items = staged(_items(benchmark, item_id, item_text), "items")
    seeds = items.select("item", "item_hash", F.explode("seeds").alias("seed"))
    lengths = [r[0] for r in items.select("seed_words").distinct().collect()]  # at most SEED_WORDS rows
    held = bitmap(seeds, "seed")
    found = staged(_covered(documents, doc_id, text, held, sorted(lengths)).dropDuplicates(["doc", "doc_hash"]), "covered")
    pairs = found.select("doc", "doc_hash", F.explode("seeds").alias("seed")).join(seeds, "seed").select("doc", "doc_hash", "item", "item_hash").distinct()
    own_items = items.select(F.col("item").alias("_item"), F.col("item_hash").alias("_item_hash"), "words", "seed_words")
    own_docs = found.select(F.col("doc").alias("_doc"), F.col("doc_hash").alias("_doc_hash"), "stretches")
    work = pairs.join(own_items, F.col("item").eqNullSafe(F.col("_item")) & F.col("item_hash").eqNullSafe(F.col("_item_hash")))
    work = work.join(own_docs, F.col("doc").eqNullSafe(F.col("_doc")) & F.col("doc_hash").eqNullSafe(F.col("_doc_hash")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                rows = zip(part.column("words").to_pylist(), part.column("stretches").to_pylist(), part.column("seed_words").to_pylist())
                got = [(len(w), tiles(w, s, n)) for w, s, n in rows]
                covered = [sum(t[2] for t in own) for _, own in got]
                columns = [*part.select(["doc", "doc_hash", "item"]).columns, pa.array([n for n, _ in got], pa.int64()), pa.array(covered, pa.int64()), pa.array([len(own) for _, own in got], pa.int64()), pa.array([c / n for c, (n, _) in zip(covered, got)], pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "doc_hash", "item_id", "item_words", "tiled_words", "n_tiles", "coverage"])

    kinds = [documents.schema[doc_id].dataType.simpleString(), benchmark.schema[item_id].dataType.simpleString()]
    tiled = work.select("doc", "doc_hash", "item", "words", "stretches", "seed_words").mapInArrow(
        run, f"doc_id {kinds[0]}, doc_hash bigint, item_id {kinds[1]}, item_words bigint, tiled_words bigint, n_tiles bigint, coverage double"
    )
    return tiled.where(F.col("coverage") >= coverage)


def without_leaks(documents: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """``documents`` without the rows into whose text an item leaks."""
    bad = staged(leaks(documents, benchmark, coverage=coverage).select(F.col("doc_id").alias("_bad"), F.col("doc_hash").alias("_bad_hash")).distinct(), "leaks")
    return documents.join(bad, F.col("doc_id").eqNullSafe(F.col("_bad")) & F.xxhash64("text").eqNullSafe(F.col("_bad_hash")), "left_anti")
