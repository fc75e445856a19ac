"""Upsert, gates, validation, examples, split and sources."""

from __future__ import annotations

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from tagtrail.functions import citations as c, ids
from tagtrail.operators import graph, knowledge as kg, package, training as tr
from tagtrail.sources import files, sinks, tables


def sensors(spark):
    return spark.createDataFrame(
        [("75PI1.pv", "PI", "double", 0.0, 5, 9), ("odd", None, "double", 0.5, 2, 0)],
        "tag string, tag_family_hint string, data_type string, missing_fraction double, unique_count bigint, row_count bigint",
    )


def test_entities_and_relations(spark):
    ents = {r.id: r for r in kg.sensor_entities(sensors(spark), "w.xlsx").collect()}
    id = "sensor_" + hashlib.sha1(b"75PI1.pv").hexdigest()[:12]
    assert ents[id].candidate_class == "PressureSensor" and ents[id].confidence == 0.7
    assert ents[id].provenance.location.data_rows.end == 10
    odd = ents["sensor_" + hashlib.sha1(b"odd").hexdigest()[:12]]
    assert odd.candidate_class == "Sensor" and odd.confidence == 0.4 and odd.provenance.location.data_rows is None
    rels = kg.structural_relations(kg.sensor_entities(sensors(spark), "w.xlsx")).collect()
    assert len(rels) == 4 and {r.relation for r in rels} == {"INSTANCE_OF", "HAS_MEASUREMENT"}


def test_domain_ties_keep_declared_order(spark):
    schema = "dataset int, file_name string, families array<string>, numeric_columns int, has_timestamp boolean, start string, end string"
    df = spark.createDataFrame([(1, "plain", [], 0, False, None, None), (2, "RCSD.x", ["PI"], 9, True, "a", "b")], schema)
    rows = {r.dataset: r for r in kg.domain_hypothesis(df).collect()}
    assert rows[1].candidate_domain == "industrial_process" and rows[1].confidence == 0.0 and rows[1].alternatives == []
    assert rows[2].confidence == 0.8 and rows[2].alternatives[0].score == 0.35
    assert [e.strength for e in rows[2].evidence] == ["medium", "medium", "weak", "weak"]


def test_event_ids_do_not_shift_on_nulls(spark):
    df = spark.createDataFrame([("t", "s", None, None, "x", None), ("t", "s", None, "x", None, None)],
                               "event_type string, sensor_tag string, start string, `end` string, timestamp string, peak_timestamp string")
    got = {r.event_id for r in kg.with_event_ids(df).collect()}
    assert got == {"event_" + hashlib.sha1(p).hexdigest()[:16] for p in (b"t|s|||x|", b"t|s||x||")}


def test_upsert_twice_is_once(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "id string, v int")
    new = spark.createDataFrame([("b", 3), ("b", 4), ("c", 5)], "id string, v int")
    once = graph.upsert(old, new, ["id"], ["v"])
    twice = graph.upsert(once, new, ["id"], ["v"])
    want = [("a", 1), ("b", 4), ("c", 5)]
    assert sorted(map(tuple, once.collect())) == want and sorted(map(tuple, twice.collect())) == want
    assert graph.duplicate_keys(twice, ["id"]).count() == 0


def test_edge_types(spark):
    df = spark.createDataFrame([(" instance_of ",), ("CAUSES",), (None,)], "relation string")
    assert [(r.edge_type, r.accepted) for r in graph.check_edge_types(df).collect()] == [
        ("INSTANCE_OF", True), ("CAUSES", False), (None, False),
    ]
    with pytest.raises(Exception, match="unsupported relation type"):
        graph.check_edge_types(df, strict=True).collect()


def test_event_gate(spark):
    ents = kg.sensor_entities(sensors(spark), "w.xlsx")
    events = spark.createDataFrame(
        [("statistical_spike", "odd", "a", "b", None), ("statistical_spike", "odd", None, "b", None), ("x", "who", None, None, None)],
        "event_type string, sensor_tag string, start string, `end` string, timestamp string",
    )
    row = kg.event_gate(kg.resolve_event_sensors(events, ents)).first()
    assert (row.events, row.rejected, row.may_load) == (3, 2, False)


def test_bucket_and_split(spark):
    df = spark.createDataFrame([(" A ", "b\n"), ("a", "B"), ("c", "d")], "i string, r string")
    key = ids.pair_key(F.col("i"), F.col("r"))
    rows = df.select(key.alias("k"), ids.hash_bucket(key).alias("b")).collect()
    want = hashlib.sha256(b"a\nb").hexdigest()
    assert rows[0].k == rows[1].k == want
    assert rows[0].b == int(hashlib.sha256(want.encode()).hexdigest()[:16], 16) / 2**64
    with pytest.raises(ValueError):
        tr.split_examples(df, 0.8, 0.3, 0.1)


def events(spark, n=3):
    return spark.createDataFrame(
        [(f"event_{i}", "s", "statistical_spike", "candidate", "note", "a", None, 1.5, None) for i in range(n)],
        "event_id string, sensor_tag string, event_type string, status string, interpretation string, start string, "
        "`end` string, peak_value double, peak_robust_z double",
    )


def chunk_rows(spark):
    return spark.createDataFrame(
        [("c1", "d", "f", 1, 0, "one two"), ("c2", "d", "f", 1, 1, "  "), ("c3", "d", "f", 2, 0, "three")],
        "chunk_id string, document_id string, file_name string, page int, chunk_index int, text string",
    )


def test_examples_are_valid_and_limits_come_before_filters(spark):
    ents = kg.sensor_entities(sensors(spark), "w.xlsx")
    links = spark.createDataFrame([("c1", ["75PI1.pv"])], "chunk_id string, matched_sensor_tags array<string>")
    assert [r.context[0]["chunk_id"] for r in tr.document_examples(chunk_rows(spark), links, 2).collect()] == ["c1"]
    made = tr.all_examples(ents, chunk_rows(spark), links, events(spark))
    assert made.count() == 8 + 2 + 3 + 3
    checked = tr.validate_examples(
        made, chunk_rows(spark).select(F.col("chunk_id").alias("id")), ents.select("id"), events(spark).select(F.col("event_id").alias("id"))
    )
    assert checked.where("status <> 'passed'").count() == 0
    split = tr.split_examples(made, checked=checked)
    rows = tr.chat_rows(split, "SYS").collect()
    assert len(rows) == 16 and all([m.role for m in r.messages] == ["system", "user", "assistant"] for r in rows)
    user = next(r.messages[1].content for r in rows if r.metadata.example_id == "hard_negative_assignment")
    parts = user.split("\n")
    assert parts[2] == "EVIDENCE CONTEXT" and json.loads(parts[3])[0]["type"] == "policy"
    bad = checked.withColumn("status", F.lit("failed"))
    with pytest.raises(Exception, match="invalid examples"):
        tr.split_examples(made, checked=bad).collect()


def test_event_example_without_end(spark):
    row = tr.event_examples(events(spark, 1)).first()
    assert "The recorded time window is a to unspecified." in row.response and "z-score" not in row.response


def test_prompt_without_assistant(spark):
    m = F.array(F.struct(F.lit("user").alias("role"), F.lit("hi").alias("content")))
    row = spark.range(1).select(c.prompt_text(m).alias("p"), c.reference_text(m).alias("r")).first()
    assert (row.p, row.r) == ("USER: hi\n\nASSISTANT:", "")


def test_json_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"x": 1}\n\n{bad\n{"x": 2}\n')
    lenient = files.read_jsonl(spark, str(tmp_path), "x int", strict=False).collect()
    assert sorted(r.x for r in lenient if r.x) == [1, 2] and [r._corrupt_record for r in lenient if not r.x] == ["{bad"]
    with pytest.raises(Exception):
        files.read_jsonl(spark, str(tmp_path), "x int").collect()


def test_event_files(spark, tmp_path):
    for name, body in {"a": [{"id": "1"}], "b": {"events": [{"id": "2"}]}, "c": {"items": [{"id": "3"}, {"id": "4"}]}}.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(body, indent=1))
    assert sorted(r.id for r in files.read_events(spark, str(tmp_path), "id: string").collect()) == ["1", "2", "3", "4"]
    (tmp_path / "d.json").write_text('{"other": []}')
    with pytest.raises(Exception, match="no event list"):
        files.read_events(spark, str(tmp_path), "id: string").collect()


def test_sensor_table(spark):
    raw = spark.createDataFrame([("2024-01-01 00:00:00", 1.0), ("soon", 2.0)], "Timestamp string, a double")
    assert tables.sensor_table(raw, "drop").count() == 1
    with pytest.raises(Exception, match="bad timestamp"):
        tables.sensor_table(raw).collect()
    with pytest.raises(ValueError):
        tables.sensor_table(raw.drop("Timestamp"))


def test_document_pages(spark, tmp_path):
    (tmp_path / "m.txt").write_bytes("one\n\n\n two \f three".encode())
    (tmp_path / "n.txt").write_bytes(b" ")
    raw = files.binary_files(spark, str(tmp_path), "*.txt")
    rows = sorted(files.document_pages(raw, files.split_parser("\f")).collect(), key=lambda r: (r.file_name, r.page))
    assert [(r.file_name, r.page, r.text) for r in rows] == [("m.txt", 1, "one\n\ntwo"), ("m.txt", 2, "three"), ("n.txt", 1, "")]


def test_package_manifest(spark, tmp_path):
    at = str(tmp_path / "package")
    sinks.write_jsonl(spark.range(3), f"{at}/embeddings")
    manifest = package.package_manifest(spark, at)
    assert {r.artifact for r in manifest.collect()} == {"embeddings"}
    missing = {r.artifact for r in package.missing_artifacts(manifest).collect()}
    assert len(missing) == len(package.REQUIRED_ARTIFACTS) - 1 and "embeddings" not in missing
