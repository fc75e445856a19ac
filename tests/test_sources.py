"""Bad JSON lines with their numbers, pages of large files, encoders that are set up once."""

import json
import os

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from tagtrail.operators.retrieval import encode_chunks
from tagtrail.sources import files


@pytest.fixture
def small_splits(spark):
    names = {"spark.sql.files.maxPartitionBytes": "4096", "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}
    before = {n: spark.conf.get(n, None) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    yield
    for n, v in before.items():
        spark.conf.unset(n) if v is None else spark.conf.set(n, v)


def written(tmp_path, name, n, bad):
    lines = []
    for k in range(1, n + 1):
        lines.append("{broken" if k in bad else "" if k % 7 == 0 else json.dumps({"id": k, "text": "x" * (k % 90)}))
    (tmp_path / name).write_text("\n".join(lines) + "\n")
    return [k for k in range(1, n + 1) if k not in bad and k % 7]


def test_bad_lines_have_their_numbers_over_splits(spark, tmp_path, small_splits):
    good = written(tmp_path, "a.jsonl", 600, {1, 301, 302, 600}) + written(tmp_path, "b.jsonl", 900, {450, 893})
    lines = files.numbered_lines(spark, str(tmp_path))
    assert lines.rdd.getNumPartitions() > 4
    found = files.read_jsonl(spark, str(tmp_path), "id bigint, text string", strict=False).collect()
    assert sorted(r["id"] for r in found if r["_corrupt_record"] is None) == sorted(good)
    bad = {(os.path.basename(r["_file"]), r["_line"]) for r in found if r["_corrupt_record"] is not None}
    assert bad == {("a.jsonl", 1), ("a.jsonl", 301), ("a.jsonl", 302), ("a.jsonl", 600), ("b.jsonl", 450), ("b.jsonl", 893)}
    assert all(r["_line"] is None for r in found if r["_corrupt_record"] is None)


def test_strict_reading_names_file_and_line(spark, tmp_path, small_splits):
    written(tmp_path, "a.jsonl", 600, {577})
    with pytest.raises(Exception, match=r"a\.jsonl, line 577: no such JSON: \{broken"):
        files.read_jsonl(spark, str(tmp_path), "id bigint, text string").select("id").collect()
    good = written(tmp_path, "a.jsonl", 600, set())
    assert sorted(r["id"] for r in files.read_jsonl(spark, str(tmp_path), "id bigint, text string").collect()) == good


def test_wrong_types_and_other_values_are_bad_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": 1}\n{"id": "one"}\n\n[1]\n7\nnull\n{"id": 2, "more": 3}\n')
    found = files.read_jsonl(spark, str(tmp_path), "id bigint", strict=False).collect()
    assert sorted(r["id"] for r in found if r["_corrupt_record"] is None) == [1, 2]
    assert {r["_line"] for r in found if r["_corrupt_record"] is not None} == {2, 4, 5, 6}


def test_files_are_parsed_in_bounded_parts():
    batch = pa.RecordBatch.from_arrays([pa.array([b"a" * n for n in (10, 30, 5, 200, 1, 0)] + [None])], names=["content"])
    parts = [p.num_rows for p in files.by_bytes(batch, "content", 40)]
    assert parts == [2, 1, 1, 3] and list(files.by_bytes(batch.slice(0, 0), "content")) == []


def test_an_encoder_is_set_up_once_in_each_worker(spark, tmp_path):
    folder = str(tmp_path)

    def factory():
        with open(os.path.join(folder, "set-ups"), "a") as out:
            out.write(f"{os.getpid()}\n")

        def encode(texts: pd.Series) -> np.ndarray:
            with open(os.path.join(folder, f"calls-{os.getpid()}"), "a") as out:
                out.write(f"{len(texts)} {texts.str.len().max() - texts.str.len().min()}\n")
            return np.stack([[len(t), 1.0] for t in texts])

        return encode

    chunks = spark.range(2000).selectExpr("id as chunk_id", "repeat('word ', cast(id % 40 as int) + 1) as text", "id % 3 as doc_id").repartition(16)
    got = {r["chunk_id"]: (r["embedding"], r["doc_id"]) for r in encode_chunks(chunks, factory=factory, keep=["doc_id"]).collect()}
    pids = (tmp_path / "set-ups").read_text().split()
    assert len(pids) == len(set(pids)) <= 8
    sizes = [int(line.split()[0]) for f in tmp_path.glob("calls-*") for line in f.read_text().splitlines()]
    assert max(sizes) == 32 and sum(sizes) == 2000
    for k, (v, doc) in got.items():
        n = 5 * (k % 40 + 1)
        assert v == pytest.approx([n / (n * n + 1) ** 0.5, 1 / (n * n + 1) ** 0.5], rel=1e-6) and doc == k % 3


def test_empty_texts_and_missing_encoders_are_errors(spark):
    with pytest.raises(ValueError):
        encode_chunks(spark.createDataFrame([("c", "t")], "chunk_id string, text string"))
    with pytest.raises(Exception, match="without text"):
        encode_chunks(spark.createDataFrame([("c", " ")], "chunk_id string, text string"), lambda t: np.ones((len(t), 2))).collect()


def ids_of(folder, field):
    out = []
    for name in sorted(n for n in os.listdir(folder) if n.startswith("part-")):
        out += [json.loads(line)[field] for line in open(os.path.join(folder, name))]
    return out


def test_exports_are_in_order_over_their_files(spark, tmp_path):
    from tagtrail.sources import sinks

    frame = spark.range(400).selectExpr("format_string('%04d', id * 7919 % 400) as id", "if(id % 3 = 0, 'a', 'b') as split").repartition(5)
    sinks.write_splits(frame, f"{tmp_path}/splits")
    for split, n in (("a", 134), ("b", 266)):
        got = ids_of(f"{tmp_path}/splits/split={split}", "id")
        assert got == sorted(got) and len(got) == n
    nodes = frame.selectExpr("id", "array('Entity') as labels", "map('name', id) as properties")
    edges = frame.selectExpr("id as src", "'RELATED_TO' as type", "'x' as dst", "map('name', id) as properties")
    sinks.write_graph(nodes, edges, f"{tmp_path}/graph")
    for part in ("nodes", "edges"):
        got = ids_of(f"{tmp_path}/graph/{part}", "element_id")
        assert got == sorted(got) and len(got) == 400


def test_digests_and_manifest_are_those_of_the_files(spark, tmp_path):
    import hashlib

    from tagtrail.operators import package

    folder = "/root/testdata/sf0.001"
    want = {n: (hashlib.sha256(open(f"{folder}/{n}", "rb").read()).hexdigest(), os.path.getsize(f"{folder}/{n}")) for n in os.listdir(folder) if n.endswith(".parquet")}
    got = {r["file_name"]: (r["sha256"], r["size_bytes"]) for r in files.file_digests(files.binary_files(spark, folder, "*.parquet")).collect()}
    assert got == want and len(got) > 10
    for part, text in (("document_chunks", "one"), ("embeddings", "two")):
        (tmp_path / part).mkdir()
        (tmp_path / part / "part-0.json").write_text(text)
    rows = package.package_manifest(spark, str(tmp_path)).collect()
    assert {(r["sha256"], r["size_bytes"]) for r in rows} == {(hashlib.sha256(t.encode()).hexdigest(), 3) for t in ("one", "two")}


def test_a_large_file_is_hashed_split_by_split(spark, tmp_path):
    import gzip
    import hashlib
    import random

    draw = random.Random(3)
    held = {
        "any.parquet": draw.randbytes(5000), "any bytes [1].parquet": draw.randbytes(3001) + b"\n", "mark.json": b"\xef\xbb\xbf" + b"a\r\nb\n" * 100,
        "mark2.json": b"\xef\xbb\xbf\xef\xbb\xbf" + b"x" * 300, "feeds.json": b"\n" * 700, "one.json": b"x" * 2000, "packed.json.gz": gzip.compress(draw.randbytes(900)),
        "begins.json": b"\n\nab" * 90 + b"\n\n", "small.json": b"s", "exact.json": (b"y" * 99 + b"\n") * 8,
    }
    for name, content in held.items():
        (tmp_path / name).write_bytes(content)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    try:
        one = spark.read.text(f"{tmp_path}/any.parquet", lineSep="\n")
        assert one.rdd.getNumPartitions() == 17
        sliced = files.with_sha256(files.binary_files(spark, str(tmp_path)), whole=200)
        got = {r["file_name"]: (r["sha256"], r["length"]) for r in sliced.collect()}
        assert got == {name: (hashlib.sha256(content).hexdigest(), len(content)) for name, content in held.items()}
        few = files.split_digests(spark, [(f"{tmp_path}/{n}", len(held[n])) for n in ("one.json", "any.parquet", "feeds.json")], at_once=2)
        assert {os.path.basename(p): d for p, d in few} == {n: got[n][0] for n in ("one.json", "any.parquet", "feeds.json")}
        with pytest.raises(OSError, match="of 4990 bytes"):
            files.split_digests(spark, [(f"{tmp_path}/any.parquet", 4990)])
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_a_graph_is_written_compressed_on_demand(spark, tmp_path):
    from tagtrail.sources import sinks

    nodes = spark.range(50).selectExpr("concat('n', id) as id", "array('Entity') as labels", "map('name', 'x') as properties")
    edges = nodes.selectExpr("id as src", "'RELATED_TO' as type", "'n0' as dst", "properties")
    sinks.write_graph(nodes, edges, f"{tmp_path}/graph", "gzip")
    for part in ("nodes", "edges"):
        names = [n for n in os.listdir(f"{tmp_path}/graph/{part}") if n.startswith("part-")]
        assert names and all(n.endswith(".json.gz") for n in names)
        assert spark.read.json(f"{tmp_path}/graph/{part}").count() == 50
