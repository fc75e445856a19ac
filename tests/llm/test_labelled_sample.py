"""The bound of the labelled sample is on rows, however often an id repeats."""

import numpy as np

from tagtrail.llm import quality_rules, texts
from tests.llm import data


def test_repeated_ids_give_one_row(spark):
    rows = [(1, f"text {k}", "en", "s", k) for k in range(50)] + [(2, "same", "en", "s", 4)] * 20 + [(3, None, "en", "s", None), (4, "other", "en", "s", 5)]
    docs = spark.createDataFrame(rows, data.DOCUMENTS)
    marks = data.labels(spark, [(k, k % 2, 0) for k in range(1, 5)])
    got = texts.labelled_sample(docs, marks, "quality", 3).collect()
    assert len(got) <= 3
    every = {r["doc_id"]: r for r in texts.labelled_sample(docs, marks, "quality", 10).collect()}
    again = texts.labelled_sample(docs.repartition(7, "n_chars"), marks, "quality", 10).collect()
    assert sorted(every) == [1, 2, 3, 4] and {r["doc_id"]: r for r in again} == every and len(again) == 4
    least = docs.where("doc_id = 1").selectExpr("min_by(struct(text, n_chars), xxhash64(text)) as r").first()["r"]
    assert (every[1]["text"], every[1]["n_chars"], every[1]["label"]) == (least["text"], least["n_chars"], 1)


def test_fit_in_parts_equals_fit_at_once(monkeypatch):
    """Few entries are multiplied at once, texts without any stand anywhere, and not a bit of the model changes."""
    rng = np.random.default_rng(1)
    sizes = rng.integers(0, 400, 120)
    sizes[[0, 5, 118, 119]] = 0
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    column = rng.integers(0, quality_rules.BAGS << quality_rules.BITS, offsets[-1]).astype(np.int32)
    sample = column, rng.random(offsets[-1]).astype(np.float32), offsets, (rng.random(120) < 0.5).astype(float), rng.integers(0, 10, 120)
    whole = quality_rules.fit_rows(*sample, 10)
    for entries in (300, int(offsets[-1]), int(offsets[-1]) - 1):
        monkeypatch.setattr(quality_rules, "FIT_ENTRIES", entries)
        parts = quality_rules.fit_rows(*sample, 10)
        assert np.array_equal(parts.weights, whole.weights) and (parts.bias, parts.slope, parts.shift) == (whole.bias, whole.slope, whole.shift)


def test_fit_brings_no_bags_to_the_driver(spark, monkeypatch):
    """The sample is fitted in a task: the driver gets one row of weights, whatever the texts hold, and the same model."""
    docs = spark.createDataFrame([(k, f"{'good fine' if k % 2 else 'bad poor'} words {k} " * 9, "en", "s", k) for k in range(60)], data.DOCUMENTS)
    marks = data.labels(spark, [(k, k % 2, 0) for k in range(60)])
    sample = texts.labelled_sample(docs, marks, "quality", 50)
    got = texts.map_texts(sample, quality_rules.sparse_rows, "at array<int>, value array<float>", carry=["doc_id", "label", "part"]).toArrow().sort_by("doc_id")
    want = quality_rules.fit_rows(*texts.flat_rows(got), np.array(got["label"], dtype=float), np.array(got["part"]), 20)
    monkeypatch.setattr(type(docs), "toArrow", lambda self: 1 / 0)
    model = quality_rules.fit(docs, marks, 50, 20)
    assert model.known and np.array_equal(model.weights, want.weights) and (model.bias, model.slope, model.shift) == (want.bias, want.slope, want.shift)
    assert not quality_rules.fit(docs, data.labels(spark, []), 50).known
