"""A vector index in files: an inverted file of cells that is written once, opened later and searched cell by cell.

Centroids are fitted by a few rounds of k-means on at most SAMPLE_ROWS vectors, taken by the order of a hash of their
keys; every vector is then assigned to its nearest centroid and written, with its metadata, in the folder of that cell.
A cell is known by its centroid, its number of vectors and its radius, the largest distance from the centroid. The
descriptor is written last: a folder without one is no index.

A search first visits, for each question, the ``probes`` cells whose centroids are nearest, and takes the k-th score found
there. A second pass visits every other cell that may hold a better vector. As q.v = q.c + q.(v - c), no vector of a cell
scores above q.c + |q| * radius; with ``exact`` the cells whose bound is below that k-th score are left out, and the result
is that of a scan of everything, whatever the vectors are. Else the bound takes |q| * radius * ``sigmas`` / sqrt(dims)
instead: so far a difference of length radius reaches along q if its direction has nothing to do with q. ``sigmas`` None
visits the nearest cells only.

Recall is measured, not assumed: see ``recall``. The more vectors there are, the further out are the best ones of a cell, so
one value of ``sigmas`` finds less in a larger index; ``fitted_sigmas`` takes it from the exact hits of a bounded sample of
the questions.

Few questions travel to all tasks, and only the folders of visited cells are read, in place. Questions beyond ``block``
meet slices of cells of bounded size, so that neither a cell that holds a third of all vectors nor a cell that every
question visits is one task.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from tagtrail.operators.retrieval import CORPUS_SLICE, QUESTION_BLOCK, TopK, _scored_schema, index_mismatch, matrix_of, nearest_of_group, ranked
from tagtrail.session import small_or_none, staged

SAMPLE_ROWS = 20_000
MAX_CELLS = 4096
ROUNDS = 8
PROBES = 4
SIGMAS = 1.6
#: So many questions are answered exactly to fit ``sigmas``, and the part of their hits that is to be found.
TRIAL_QUESTIONS, TRIAL_RECALL = 64, 0.95
#: Distances from centroids, and scores, that a worker holds at once.
HELD_DISTANCES = 1 << 19
#: What rounding of scores may hide.
_SLACK = 1e-6


def _distances(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances, less the part that is the same for all centroids of a vector."""
    return (centroids**2).sum(axis=1)[None, :] - 2 * (vectors @ centroids.T)


def _parts(vectors: np.ndarray, centroids: int) -> Iterator[np.ndarray]:
    """So many vectors at a time that their distances from all centroids stay small."""
    step = max(1, HELD_DISTANCES // max(1, centroids))
    return (vectors[k : k + step] for k in range(0, len(vectors), step))


def fit_centroids(vectors: DataFrame, key: str, cells: int, sample_rows: int = SAMPLE_ROWS, rounds: int = ROUNDS, seed: int = 17) -> np.ndarray:
    """At most ``cells`` centroids, from a bounded sample; fewer if the sample has fewer different vectors."""
    order = F.xxhash64(F.lit(seed), key)
    sample = vectors.select(F.col("embedding").cast("array<double>").alias("embedding"), order.alias("_order"), key)
    points = matrix_of(sample.orderBy("_order", key).limit(sample_rows).toArrow())
    if not len(points):
        return np.zeros((0, 0))
    _, first = np.unique(points, axis=0, return_index=True)
    centroids = points[np.sort(first)[:cells]]
    for _ in range(rounds):
        nearest = np.concatenate([_distances(part, centroids).argmin(axis=1) for part in _parts(points, len(centroids))])
        counts = np.bincount(nearest, minlength=len(centroids))
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, points)
        centroids = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centroids)
    return centroids


def assigned(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``vectors`` with ``cell`` and ``distance``, the number of the nearest centroid and the distance from it."""
    shared = vectors.sparkSession.sparkContext.broadcast(centroids)
    schema = T.StructType([*vectors.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("distance", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells, distances = [np.zeros(0, dtype=np.int32)], [np.zeros(0)]
            for own in _parts(matrix_of(batch), len(shared.value)):
                cell = _distances(own, shared.value).argmin(axis=1)
                cells.append(cell.astype(np.int32))
                distances.append(np.linalg.norm(own - shared.value[cell], axis=1))
            columns = [*batch.columns, pa.array(np.concatenate(cells)), pa.array(np.concatenate(distances))]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "cell", "distance"])

    return vectors.mapInArrow(run, schema)


def write_index(
    vectors: DataFrame, path: str, key: str = "chunk_id", metadata: DataFrame | None = None, cells: int | None = None,
    metric: str = "cosine", sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """Write ``vectors`` (key, embedding and other columns) as an index; return its descriptor.

    ``metadata`` has one row per key; a key that only one side has is an error. Vectors that are null are not indexed.
    ``cells`` is the square root of the number of vectors by default, MAX_CELLS at most.
    """
    spark = vectors.sparkSession
    # The vectors, which an encoder may have to make, are made once; counting and fitting need no metadata.
    known = own = staged(vectors.where(F.col("embedding").isNotNull()), "vectors")
    if metadata is not None:
        gaps = index_mismatch(known, metadata, key).first()
        if gaps["without_metadata"] or gaps["without_vector"]:
            raise ValueError(f"{gaps['without_metadata']} vectors without metadata, {gaps['without_vector']} metadata rows without a vector")
        known = known.join(metadata, key)
    centroids = fit_centroids(own, key, min(MAX_CELLS, max(1, cells or round(own.count()**0.5))), sample_rows)
    # Rebalancing joins small cells to one task and cuts large ones into several.
    placed = assigned(known, centroids).hint("rebalance", "cell")
    placed.write.mode("overwrite").partitionBy("cell").parquet(f"{path}/vectors")
    written = _vectors(spark, path, T.StructType([*known.schema.fields, T.StructField("distance", T.DoubleType()), T.StructField("cell", T.IntegerType())]))
    found = written.groupBy("cell").agg(F.count("*").alias("vectors"), F.max("distance").alias("radius")).collect()  # MAX_CELLS rows at most
    rows = [(r["cell"], r["vectors"], r["radius"], centroids[r["cell"]].tolist()) for r in found]
    spark.createDataFrame(rows, "cell int, vectors bigint, radius double, centroid array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/cells")
    descriptor = spark.createDataFrame(
        [(sum(r[1] for r in rows), centroids.shape[1] or None, metric, len(rows), key, known.schema.json())],
        "vectors bigint, dims int, metric string, cells int, key string, columns string",
    )
    descriptor.coalesce(1).write.mode("overwrite").json(f"{path}/descriptor")
    return open_index(spark, path).descriptor()


def _vectors(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(f"{path}/vectors")


class Index(NamedTuple):
    """An index that is written; its cells, of which there are MAX_CELLS at most, are at hand."""

    spark: SparkSession
    path: str
    key: str
    schema: T.StructType
    about: dict
    numbers: np.ndarray
    sizes: np.ndarray
    radii: np.ndarray
    centroids: np.ndarray

    def descriptor(self) -> DataFrame:
        row = tuple(self.about[c] for c in ("vectors", "dims", "metric", "cells"))
        return self.spark.createDataFrame([row], "vectors bigint, dims int, metric string, cells int")

    def rows(self, cells: list[int] | None = None) -> DataFrame:
        """The vectors with their metadata and cells; of some cells only their folders are read."""
        own = T.StructType([*self.schema.fields, T.StructField("distance", T.DoubleType()), T.StructField("cell", T.IntegerType())])
        found = _vectors(self.spark, self.path, own)
        return found if cells is None else found.where(F.col("cell").isin(cells))


def open_index(spark: SparkSession, path: str) -> Index:
    about = spark.read.schema("vectors bigint, dims int, metric string, cells int, key string, columns string").json(f"{path}/descriptor").first().asDict()
    cells = spark.read.parquet(f"{path}/cells").orderBy("cell").collect()
    column = lambda name, kind: np.array([r[name] for r in cells], dtype=kind)
    schema = T.StructType.fromJson(json.loads(about["columns"]))
    centroids = np.array([r["centroid"] for r in cells], dtype=float).reshape(len(cells), about["dims"] or 0)
    return Index(spark, path, about["key"], schema, about, column("cell", int), column("vectors", int), column("radius", float), centroids)


def search(
    index: Index, questions: DataFrame, k: int, probes: int = PROBES, sigmas: float | None = SIGMAS, exact: bool = False,
    block: int = QUESTION_BLOCK, corpus_slice: int = CORPUS_SLICE,
) -> DataFrame:
    """The ``k`` indexed vectors of largest dot product with each question: question_id, chunk_id, doc_id, rank, score.

    ``questions`` has ``question_id`` and ``embedding``; scores count to nine digits, equal ones go by the index key.
    The index must hold ``doc_id`` beside its key, which is returned as ``chunk_id``.
    """
    asked = staged(questions.select("question_id", F.col("embedding").cast("array<double>").alias("embedding")), "questions")
    near = _visited(index, asked.withColumn("floor", F.lit(None).cast("double")), probes, None)
    first = staged(ranked(_scored(index, near, k, block, corpus_slice), k), "hits")
    if not exact and sigmas is None or probes >= len(index.numbers):
        return first
    reach = 1.0 if exact else min(1.0, sigmas / max(1, index.centroids.shape[1]) ** 0.5)
    # With fewer than k hits nothing is ruled out.
    floors = first.where(F.col("rank") == k).select("question_id", F.col("score").alias("floor"))
    rest = _visited(index, asked.join(floors, "question_id", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf")))), probes, reach)
    more = _scored(index, rest, k, block, corpus_slice)
    return ranked(first.drop("rank").unionByName(more), k)


def fitted_sigmas(
    index: Index, questions: DataFrame, k: int, probes: int = PROBES, wanted: float = TRIAL_RECALL, trial: int = TRIAL_QUESTIONS, seed: int = 17
) -> float:
    """The least ``sigmas``, SIGMAS at least, by which ``search`` finds the part ``wanted`` of the exact hits of some questions.

    ``trial`` questions, taken by the order of a hash of their ids, are searched exactly. A hit outside the nearest cells is
    found once the bound of its cell reaches the k-th score of these, which tells the ``sigmas`` that it takes.
    """
    order = F.xxhash64(F.lit(seed), "question_id")
    asked = staged(questions.select("question_id", "embedding").orderBy(order, "question_id").limit(trial), "trial")
    first = search(index, asked, k, probes, sigmas=None)
    floors = first.where(F.col("rank") == k).select("question_id", F.col("score").alias("floor"))
    exact = staged(search(index, asked, k, probes, exact=True), "truth")
    wide = exact.join(first.select("question_id", "chunk_id", F.lit(True).alias("near")), ["question_id", "chunk_id"], "left")
    wide = wide.join(floors, "question_id", "left").join(asked, "question_id")
    cells = index.rows().select(F.col(index.key).alias("chunk_id"), "cell")
    hits = cells.join(F.broadcast(wide), "chunk_id").select("near", "floor", "cell", F.col("embedding").cast("array<double>").alias("embedding")).toArrow()
    if not hits.num_rows:
        return SIGMAS
    vectors, place = matrix_of(hits), np.searchsorted(index.numbers, hits.column("cell").to_numpy())
    ahead = hits.column("floor").to_numpy() - _SLACK - (vectors * index.centroids[place]).sum(axis=1)
    reach = np.linalg.norm(vectors, axis=1) * index.radii[place] / vectors.shape[1] ** 0.5
    takes = np.divide(ahead, reach, out=np.zeros(len(ahead)), where=reach > 0)
    # Where fewer than k hits were near, every cell is visited.
    takes[hits.column("near").is_valid().to_numpy() | np.isnan(ahead)] = 0.0
    enough = np.sort(takes)[max(0, math.ceil(wanted * len(takes)) - 1)]
    return float(min(max(SIGMAS, enough * (1 + 1e-9)), max(SIGMAS, vectors.shape[1] ** 0.5)))


def visited_cells(index: Index, vectors: np.ndarray, floors: np.ndarray, probes: int, reach: float | None) -> list[np.ndarray]:
    """Per question the places of the cells to visit: the nearest ones, or, with the part of the radius that counts, those
    others whose bound reaches the floor."""
    order = np.argsort(_distances(vectors, index.centroids), axis=1, kind="stable")
    if reach is None:
        return list(order[:, :probes])
    bounds = vectors @ index.centroids.T + reach * np.linalg.norm(vectors, axis=1)[:, None] * index.radii[None, :]
    return [rest[bound[rest] >= floor - _SLACK] for rest, bound, floor in zip(order[:, probes:], bounds, floors)]


def _visited(index: Index, questions: DataFrame, probes: int, reach: float | None) -> DataFrame:
    """(question_id, embedding, cells) of each question with the numbers of the cells that it visits."""
    shared = questions.sparkSession.sparkContext.broadcast(index._replace(spark=None))
    schema = T.StructType([questions.schema["question_id"], questions.schema["embedding"], T.StructField("cells", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                part = batch.slice(k, 1024)
                floors = part.column("floor").to_numpy(zero_copy_only=False)
                cells = visited_cells(own, matrix_of(part), floors, probes, reach) if len(own.numbers) else [np.zeros(0, dtype=int)] * part.num_rows
                numbers = pa.array([own.numbers[c].astype(np.int32) for c in cells], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column("question_id"), part.column("embedding"), numbers], names=["question_id", "embedding", "cells"])

    return staged(questions.select("question_id", "embedding", "floor").mapInArrow(run, schema).where(F.size("cells") > 0), "visits")


def _corpus(index: Index, visits: DataFrame) -> DataFrame:
    """The vectors of all cells that some question visits."""
    cells = sorted(r[0] for r in visits.select(F.explode("cells")).distinct().collect())  # MAX_CELLS rows at most
    rows = index.rows(None if len(cells) == len(index.numbers) else cells)
    return rows.select(F.col(index.key).alias("chunk_id"), "doc_id", "embedding", "cell")


def _scored(index: Index, visits: DataFrame, k: int, block: int, corpus_slice: int) -> DataFrame:
    corpus = _corpus(index, visits)
    few = small_or_none(visits, block)
    return _scan_cells(visits, corpus, few, k) if few is not None else _grid_cells(index, visits, corpus, k, block, corpus_slice)


def _scan_cells(visits: DataFrame, corpus: DataFrame, few: list, k: int) -> DataFrame:
    schema = _scored_schema(visits, corpus)
    if not few:
        return visits.sparkSession.createDataFrame([], schema)
    kind = to_arrow_type(schema["question_id"].dataType)
    by_cell: dict[int, list[int]] = {}
    for n, r in enumerate(few):
        for cell in r.cells:
            by_cell.setdefault(cell, []).append(n)
    sent = visits.sparkSession.sparkContext.broadcast(
        ([r.question_id for r in few], np.array([r.embedding for r in few], dtype=float), {c: np.array(n) for c, n in by_cell.items()})
    )

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, matrix, askers = sent.value
        found = TopK(len(names), k)
        for batch in batches:
            cells = batch.column("cell").to_numpy(zero_copy_only=False)
            for cell in np.unique(cells).tolist():
                asked = askers[cell]
                part = batch if (cells == cell).all() else batch.take(pa.array(np.flatnonzero(cells == cell)))
                step = max(k + 1, HELD_DISTANCES // len(asked))
                for start in range(0, part.num_rows, step):
                    own = part.slice(start, step)
                    found.add(matrix[asked] @ matrix_of(own).T, own, asked)
        out = found.best(names, kind)
        if out is not None:
            yield from out.combine_chunks().to_batches()

    return corpus.mapInArrow(nearest, schema)


def _grid_cells(index: Index, visits: DataFrame, corpus: DataFrame, k: int, block: int, corpus_slice: int) -> DataFrame:
    """Blocks of questions against slices of cells; every (cell, slice, block) is one bounded task."""
    blocks = max(1, -(-visits.count() // block))
    slices = {int(n): -(-int(size) // corpus_slice) for n, size in zip(index.numbers, index.sizes)}
    large = {n: s for n, s in slices.items() if s > 1}
    of_cell = F.lit(1)
    if large:
        of_cell = F.coalesce(F.create_map(*[F.lit(v) for pair in large.items() for v in pair])[F.col("cell")], F.lit(1))
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    asked = visits.select("question_id", "embedding", F.explode("cells").alias("cell"), F.pmod(F.xxhash64("question_id"), F.lit(blocks)).cast("int").alias("block"))
    asked = asked.withColumn("slice", every(of_cell))
    chunks = corpus.withColumn("slice", F.pmod(F.xxhash64("chunk_id"), of_cell).cast("int")).withColumn("block", every(F.lit(blocks)))
    keys = ["cell", "slice", "block"]
    schema = _scored_schema(visits, corpus)
    return asked.groupBy(*keys).cogroup(chunks.groupBy(*keys)).applyInArrow(nearest_of_group(k, schema), schema)


def recall(found: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: ``questions``, ``wanted`` and ``hit`` rows of ``truth`` that ``found`` has, and ``recall``."""
    same = found.select("question_id", "chunk_id", F.lit(True).alias("hit"))
    return truth.select("question_id", "chunk_id").join(same, ["question_id", "chunk_id"], "left").agg(
        F.count_distinct("question_id").alias("questions"), F.count("*").alias("wanted"), F.count("hit").alias("hit"),
        F.try_divide(F.count("hit"), F.count("*")).alias("recall"),
    )
