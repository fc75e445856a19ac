"""The vector index: what is written, exact search against a scan, recall of probing, hot cells."""

import os
from urllib.parse import urlparse

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagtrail.operators import retrieval, vector_index
from tagtrail.session import scratch_path


def points(n, dims=16, seed=1, groups=12):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(groups, dims))
    found = middles[rng.integers(0, groups, n)] + 0.35 * rng.normal(size=(n, dims))
    return found / np.linalg.norm(found, axis=1, keepdims=True)


def frame(spark, vectors, start=0):
    rows = [(f"c{start + k:05d}", k % 7, [float(x) for x in v]) for k, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "chunk_id string, doc_id int, embedding array<float>")


def asked(spark, vectors):
    return spark.createDataFrame([(k, [float(x) for x in v]) for k, v in enumerate(vectors)], "question_id int, embedding array<float>")


def rows(found):
    return sorted(map(tuple, found.collect()))


@pytest.fixture(scope="module")
def built(spark):
    vectors = np.concatenate([points(1500), np.tile(points(1, seed=5), (700, 1)), np.zeros((3, 16))])
    corpus = frame(spark, vectors)
    path = scratch_path(spark, "index")
    metadata = corpus.select("chunk_id", F.concat(F.lit("file "), "chunk_id").alias("file_name"))
    descriptor = vector_index.write_index(corpus, path, metadata=metadata, cells=24)
    return corpus, path, descriptor


def test_an_index_is_written_by_cell_with_its_metadata(spark, built):
    corpus, path, descriptor = built
    assert descriptor.first()[:3] == (2203, 16, "cosine")
    index = vector_index.open_index(spark, path)
    folders = [f for f in os.listdir(urlparse(path).path + "/vectors") if f.startswith("cell=")]
    assert len(folders) == len(index.numbers) == descriptor.first()["cells"] and sum(index.sizes) == 2203
    one = index.rows([int(index.numbers[0])])
    assert one.count() == index.sizes[0] and one.where("file_name <> concat('file ', chunk_id)").count() == 0
    assert len(one.inputFiles()) < len(index.rows().inputFiles()) or "cell" in one._jdf.queryExecution().toString()
    far = index.rows().groupBy("cell").agg(F.max("distance").alias("d")).collect()
    assert {r["cell"]: r["d"] for r in far} == dict(zip(index.numbers.tolist(), index.radii.tolist()))


@pytest.mark.parametrize("block, piece", [(4096, 50_000), (5, 100)])
def test_exact_search_equals_a_scan(spark, built, block, piece):
    corpus, path, _ = built
    questions = asked(spark, np.concatenate([points(20, seed=2), points(1, seed=5), np.zeros((1, 16))]))
    index = vector_index.open_index(spark, path)
    want = rows(retrieval.top_k_chunks(questions, corpus, 9))
    assert rows(vector_index.search(index, questions, 9, probes=2, exact=True, block=block, corpus_slice=piece)) == want
    assert rows(vector_index.search(index, questions, 9, probes=24, block=block, corpus_slice=piece)) == want


def test_probing_finds_nine_in_ten(spark, built):
    corpus, path, _ = built
    questions = asked(spark, points(60, seed=3))
    index = vector_index.open_index(spark, path)
    truth = retrieval.top_k_chunks(questions, corpus, 8)
    got = {s: vector_index.recall(vector_index.search(index, questions, 8, sigmas=s), truth).first()["recall"] for s in (None, vector_index.SIGMAS)}
    assert got[vector_index.SIGMAS] >= 0.9 and got[None] <= got[vector_index.SIGMAS]


def test_bounds_leave_out_cells_and_lose_nothing(spark, built):
    index = vector_index.open_index(spark, built[1])
    q = points(30, seed=4)
    data = index.rows().toPandas()
    vectors = np.array(data["embedding"].tolist(), dtype=float)
    floors = np.sort(q @ vectors.T, axis=1)[:, -8]
    left_out = 0
    for n, cells in enumerate(vector_index.visited_cells(index, q, floors, 1, 1.0)):
        first = vector_index.visited_cells(index, q, floors, 1, None)[n]
        seen = set(index.numbers[np.concatenate([cells, first])].tolist())
        best = data["cell"][q[n] @ vectors.T >= floors[n]]
        assert set(best) <= seen
        left_out += len(index.numbers) - len(seen)
    assert left_out > 0


def test_fewer_vectors_than_asked_for_and_none(spark):
    path = scratch_path(spark, "index")
    small = frame(spark, points(3))
    vector_index.write_index(small, path)
    index = vector_index.open_index(spark, path)
    questions = asked(spark, points(2, seed=9))
    assert vector_index.search(index, questions, 8, probes=1, exact=True).count() == 6
    assert vector_index.search(index, questions.limit(0), 8, exact=True).count() == 0
    other = scratch_path(spark, "index")
    assert vector_index.write_index(small.limit(0), other).first()[:2] == (0, None)
    assert vector_index.search(vector_index.open_index(spark, other), questions, 8, exact=True).count() == 0


def test_a_key_without_metadata_is_an_error(spark):
    small = frame(spark, points(3))
    with pytest.raises(ValueError, match="1 vectors without metadata"):
        vector_index.write_index(small, scratch_path(spark, "index"), metadata=small.select("chunk_id").where("chunk_id <> 'c00001'"))


def test_top_k_keeps_ties_by_id(spark):
    corpus = frame(spark, np.tile(points(1), (40, 1))).repartition(3)
    got = retrieval.top_k_chunks(asked(spark, points(2)), corpus, 5).collect()
    assert {(r["question_id"], r["rank"], r["chunk_id"]) for r in got} == {(q, k + 1, f"c{k:05d}") for q in (0, 1) for k in range(5)}


def test_vectors_are_encoded_once(spark, tmp_path):
    """Writing an index and scanning in blocks read the vectors several times; the encoder sees each text once."""
    seen = spark.sparkContext.accumulator(0)

    def encoder(texts):
        seen.add(len(texts))
        return np.array([[1.0, len(t), ord(t[0])] for t in texts])

    rows = [(f"c{k:03d}", k, f"{'abcdef'[k % 6]} text {k}" * (1 + k % 5)) for k in range(90)]
    chunks = spark.createDataFrame(rows, "chunk_id string, doc_id bigint, text string")
    vectors = retrieval.encode_chunks(chunks, encoder, keep=["doc_id"])
    vector_index.write_index(vectors, str(tmp_path / "index"), metadata=chunks.select("chunk_id", "text"), cells=5)
    assert seen.value == 90
    questions = spark.createDataFrame([(k, [1.0, float(k), 97.0]) for k in range(9)], "question_id bigint, embedding array<double>")
    blocks = retrieval.top_k_chunks(questions, vectors, 4, block=4, corpus_slice=20)
    assert blocks.count() == 36 and seen.value == 180
    assert sorted(blocks.collect()) == sorted(retrieval.top_k_chunks(questions, vectors, 4).collect())


def test_sigmas_are_fitted_where_the_default_finds_too_little(spark):
    """Vectors without any cells of their own: the best ones stand far out in each cell, beyond the default bound."""
    rng = np.random.default_rng(8)
    cloud = lambda n: (v := rng.normal(size=(n, 8))) / np.linalg.norm(v, axis=1, keepdims=True)
    path, corpus, questions = scratch_path(spark, "index"), frame(spark, cloud(6000)), asked(spark, cloud(90))
    vector_index.write_index(corpus, path, cells=24)
    index = vector_index.open_index(spark, path)
    truth = retrieval.top_k_chunks(questions, corpus, 8)
    fitted = vector_index.fitted_sigmas(index, questions, 8, probes=1, trial=30)
    got = {s: vector_index.recall(vector_index.search(index, questions, 8, probes=1, sigmas=s), truth).first()["recall"] for s in (vector_index.SIGMAS, fitted)}
    assert got[vector_index.SIGMAS] < 0.9 <= got[fitted] and fitted < 8**0.5
    assert vector_index.fitted_sigmas(index, questions.limit(0), 8) == vector_index.SIGMAS
