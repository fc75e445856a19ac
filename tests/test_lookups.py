"""Look-ups, merged edges and evaluation summaries against plain Python on small tables."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from tagtrail.operators import evaluation as ev, evidence, graph, package, retrieval, timeseries as ts


def test_graph_lookup_gives_few_rows_per_token_where_all_ids_share_a_prefix(spark):
    n = 1000
    ents = spark.range(n).select(
        F.format_string("sensor_%05d", "id").alias("entity_id"), F.format_string("75PI%04d.pv", "id").alias("source_column"),
        F.lit("Sensor").alias("candidate_class"), F.lit("PI").alias("tag_family"),
    )
    qs = spark.createDataFrame(
        [(1, "which sensor"), (2, "sensor 75pi0999.pv"), (3, "the of"), (4, "sensor_0001 or 0002"), (5, None)],
        "question_id int, question string",
    )
    words = retrieval.question_tokens(qs)
    values = ents.select(F.col("entity_id").alias("value"), "entity_id")
    per_token = retrieval.first_per_token(words, values.select("value"), values, [F.col("entity_id")], 20)
    assert per_token.groupBy("token").count().agg(F.max("count")).first()[0] <= 20
    got: dict[int, list[str]] = {}
    for r in retrieval.graph_lookup(qs, ents).orderBy("question_id", "rank").collect():
        got.setdefault(r.question_id, []).append(r.entity_id)
    rows, want = ents.collect(), {}
    for q in qs.collect():
        tokens = [t for t in re.split(r"[^A-Za-z0-9_.-]+", (q.question or "").lower()) if len(t) >= 3]
        hits = sorted(e.entity_id for e in rows if any(t in v.lower() for t in tokens for v in e))[:20]
        if hits:
            want[q.question_id] = hits
    assert got == want


def test_identify_sensors_keeps_named_and_best(spark):
    tags = spark.createDataFrame([(f"75PI{i:03d}.pv",) for i in range(60)] + [("pump.speed",)], "tag string")
    qs = spark.createDataFrame([(1, "75PI007.pv and .pv and 75pi"), (2, "pump or 75pi05")], "question_id int, question string")
    got = retrieval.identify_sensors(qs, tags, 10).orderBy("question_id", "rank").collect()
    first = [(r.tag, r.found_by) for r in got if r.question_id == 1]
    assert first[0] == ("75PI007.pv", "named") and len(first) == 10
    assert [t for t, _ in first[1:]] == [f"75PI{i:03d}.pv" for i in range(10) if i != 7]
    assert {r.tag for r in got if r.question_id == 2} == {f"75PI{i:03d}.pv" for i in range(50, 60)}  # ties by tag


def test_recent_values_are_the_newest_with_ties_by_id(spark):
    df = spark.range(5000).select(
        F.when(F.col("id") < 4000, "hot").otherwise("cold").alias("tag"), (F.col("id") % 97).alias("ts"), F.col("id").alias("rid"),
        F.col("id").cast("double").alias("value"),
    )
    got = ts.recent_values(df, 2000).collect()
    rows = df.collect()
    for tag in ("hot", "cold"):
        want = sorted(((r.ts, r.rid) for r in rows if r.tag == tag), reverse=True)[:2000]
        assert [(r.ts, r.rid) for r in sorted((r for r in got if r.tag == tag), key=lambda r: r.recency)] == want


def test_merged_edges_need_both_ends_and_come_once(spark):
    nodes = spark.createDataFrame([("a",), ("b",)], "id string")
    edges = spark.createDataFrame(
        [("a", "T", "b", {"n": "1"}), ("a", "T", "b", {"n": "2"}), ("a", "T", "x", {}), ("x", "T", "b", {}), ("b", "T", "a", None)],
        "src string, type string, dst string, properties map<string,string>",
    )
    got = sorted((r.src, r.dst, (r.properties or {}).get("n")) for r in graph.merged_edges(edges, nodes).collect())
    assert got == [("a", "b", "2"), ("b", "a", None)]


def test_upsert_create_only_keeps_what_is_there(spark):
    old = spark.createDataFrame([("a", "old")], "id string, v string")
    new = spark.createDataFrame([("a", "new"), ("b", "1"), ("b", "2")], "id string, v string")
    got = {r.id: r.v for r in graph.upsert(old, new, ["id"], ["v"], create_only=True).collect()}
    assert got == {"a": "old", "b": "2"}


def test_summaries_of_evaluations(spark):
    answers = spark.createDataFrame(
        [(1, "Answer: x Evidence: [DOC:a] Uncertainty: insufficient"), (2, "Answer: y"), (3, "")], "case int, answer string"
    )
    shown = spark.createDataFrame([(1, "DOC:a"), (1, "ENTITY:e")], "case int, key string")
    scores = spark.createDataFrame([(1, 0.25), (1, 0.75), (9, 1.0)], "case int, score double")
    checked = ev.system_evaluation(answers, shown, "case", ["case"])
    row = ev.retrieval_summary(checked, scores, "case").first()
    assert (row.average_top_document_score, round(row.average_documents, 6), round(row.average_entities, 6)) == (0.75, 0.333333, 0.333333)
    empty = ev.retrieval_summary(checked.limit(0), scores, "case").first()
    assert tuple(empty) == (0.0, 0.0, 0.0)
    made = {r.case: (r.non_empty_prediction, r.required_structure) for r in ev.prediction_evaluation(answers).collect()}
    assert made == {1: (True, True), 2: (True, False), 3: (False, False)}


def test_bundles_carry_the_rules(spark):
    qs = spark.createDataFrame([(1, "a"), (2, "b")], "question_id int, question string")
    rows = evidence.policy_rows(qs, package.ANSWER_POLICY).collect()
    assert len(rows) == 2 * len(package.ANSWER_POLICY) and {r.kind for r in rows} == {"policy"}
    lines = evidence.policy_lines(qs, package.EVIDENCE_POLICY).where("question_id = 1").orderBy("n").collect()
    assert [r.line for r in lines] == package.EVIDENCE_POLICY


def test_a_token_of_a_third_of_all_values_is_done_after_the_first_blocks(spark, monkeypatch):
    rows = spark.range(3000).select(
        F.format_string("e%05d", (F.col("id") * 7919) % 3000).alias("entity_id"),
        F.when(F.col("id") % 3 == 0, F.concat(F.lit("pump-"), "id")).when(F.col("id") == 2501, "rare thing").otherwise(F.concat(F.lit("unit"), "id")).alias("value"),
    )
    words = spark.createDataFrame([("pump",), ("rare",), ("unit1",), ("none",)], "token string")
    want = {tuple(r) for r in retrieval.first_per_token(words, rows.select("value"), rows, [F.col("entity_id")], 20).collect()}
    asked, search = [], retrieval.token_hits
    monkeypatch.setattr(retrieval, "FIRST_ROWS", 100)
    monkeypatch.setattr(retrieval, "token_hits", lambda w, v: asked.append({r.token for r in w.select("token").distinct().collect()}) or search(w, v))
    got = {tuple(r) for r in retrieval.first_per_token(words, rows.select("value"), rows, [F.col("entity_id")], 20).collect()}
    assert got == want and sum(t == "pump" for t, _ in got) == 20 and sum(t == "rare" for t, _ in got) == 1
    assert len(asked) > 2 and "pump" in asked[0] and "pump" not in asked[1] and "rare" in asked[-1]


def test_edges_are_shuffled_once_by_source_and_a_hot_source_is_dealt(spark):
    nodes = spark.range(300).select(F.concat(F.lit("n"), "id").alias("id"))
    one = lambda src, dst: F.struct(src.alias("src"), F.lit("T").alias("type"), dst.alias("dst"))
    ends = F.array(one(F.lit("n0"), F.concat(F.lit("n"), F.col("id") % 310)), one(F.concat(F.lit("n"), F.col("id") % 300), F.lit("n1")), one(F.lit(None).cast("string"), F.lit("n1")))
    edges = spark.range(900).select("id", F.inline(ends)).select("src", "type", "dst", F.create_map(F.lit("k"), F.format_string("%04d", "id")).alias("properties"))
    found = graph.merged_edges(edges, nodes)
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    want: dict = {}
    for k in range(900):
        for e in [("n0", f"n{k % 310}"), (f"n{k % 300}", "n1")]:
            if int(e[1][1:]) < 300:
                want[e] = max(want.get(e, ""), f"{k:04d}")
    assert sorted((r.src, r.dst, r.properties["k"]) for r in found.collect()) == sorted((*e, v) for e, v in want.items())


def edge_table(spark):
    """Edges of many sources, none of them hot, each twice and some to an end that is no node, with nodes whose ids begin alike."""
    nodes = spark.range(400).select(F.concat(F.lit("n"), "id").alias("id"))
    ends = spark.range(400).select("id", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("k")).select(
        F.concat(F.lit("n"), "id").alias("src"), F.lit("T").alias("type"), F.concat(F.lit("n"), (F.col("id") * 7 + F.col("k")) % 405).alias("dst"), "k"
    )
    twice = ends.select("src", "type", "dst", F.explode(F.array(F.lit("a"), F.lit("b"))).alias("v"))
    return twice.select("src", "type", "dst", F.create_map(F.lit("k"), "v").alias("properties")), nodes


def test_edges_without_a_hot_source_are_shuffled_once_too(spark):
    found = graph.merged_edges(*edge_table(spark))
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert found.count() == found.where("properties['k'] = 'b'").count() > 2000


def test_exported_edges_are_merged_and_put_in_order_by_one_shuffle(spark, tmp_path):
    import json

    from tagtrail.sources import sinks

    edges, nodes = edge_table(spark)
    found = graph.exported_edges(edges, nodes)
    plan = found.orderBy("element_id")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange rangepartitioning") == 1 and "Exchange hashpartitioning" not in plan
    want = graph.export_edges(graph.merged_edges(edges, nodes))
    assert found.columns == want.columns and sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))
    sinks.write_graph(nodes.selectExpr("id", "array('Entity') as labels", "map('name', id) as properties"), found, f"{tmp_path}/graph")
    names = sorted(p for p in (tmp_path / "graph" / "edges").iterdir() if p.name.startswith("part-"))
    got = [json.loads(line)["element_id"] for p in names for line in p.open()]
    assert len(names) > 1 and got == sorted(got) and len(got) == want.count()


def test_mentioned_entities_are_the_edges_of_mentions_with_columns_of_the_chunk(spark):
    from tagtrail.operators import documents

    chunks = spark.createDataFrame([("c1", "Pump-1 and pump-1, valve"), ("c2", "none"), ("c3", None), ("c4", "VALVE a b")], "chunk_id string, text string").withColumn("page", F.lit(7))
    tags = spark.createDataFrame([("PUMP-1",), ("valve",), ("a b",)], "tag string")
    ents = spark.createDataFrame([("e1", "pump-1"), ("e2", "Pump-1"), ("valve", None), ("e4", "a b")], "entity_id string, source_column string")
    got = documents.mentioned_entities(chunks, tags, ents, ["page"])
    assert "Exchange hashpartitioning" not in got._jdf.queryExecution().executedPlan().toString()
    plain = documents.mention_edges(documents.mentions(chunks, tags), ents).collect()
    assert sorted(map(tuple, got.collect())) == sorted((*r, 7) for r in map(tuple, plain)) == [("c1", "e1", 7), ("c1", "e2", 7), ("c1", "valve", 7), ("c4", "valve", 7)]
