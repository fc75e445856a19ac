"""Chunks, mentions, look-ups and nearest chunks against plain Python."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tagtrail.functions import citations as c, text, vectors
from tagtrail.operators import documents, retrieval


@pytest.mark.parametrize("size,overlap", [(40, 10), (40, 0), (40, 30), (7, 6)])
def test_chunks(spark, size, overlap):
    rng = random.Random(4)
    lines = ["", "x" * size, "x" * (size + 1), "a b " * 60, "é" * 100] + [
        " ".join("w" * rng.randint(1, 15) for _ in range(rng.randint(1, 80))) for _ in range(20)
    ]
    df = spark.createDataFrame(list(enumerate(lines)), "n int, text string")
    got = {r.n: r.p for r in df.select("n", documents.split_chunks(F.col("text"), size, overlap).alias("p")).collect()}
    for n, line in enumerate(lines):
        assert all(0 < len(p) <= size and p == p.strip() for p in got[n])
        assert set("".join(got[n]).replace(" ", "")) == set(line.replace(" ", ""))
        assert len(got[n]) >= len(line.strip()) / size and (got[n] or not line.strip())


def test_chunks_by_hand(spark):
    df = spark.createDataFrame([("aaaa bbbb cccc dddd",), ("abcdefghij",)], "text string")
    got = [r.p for r in df.select(documents.split_chunks(F.col("text"), 10, 2).alias("p")).collect()]
    assert got == [["aaaa bbbb", "bb cccc", "cc dddd"], ["abcdefghij"]]


def test_chunk_arguments():
    with pytest.raises(ValueError):
        documents.split_chunks(F.lit("a"), 0, 0)
    with pytest.raises(ValueError):
        documents.split_chunks(F.lit("a"), 10, 10)


def test_text_functions(spark):
    alphabet = st.text(alphabet=st.sampled_from("ab \t\n\r\x0b  é."), max_size=60)
    seen = []

    @given(st.lists(alphabet, min_size=50, max_size=50))
    @settings(max_examples=1, database=None)
    def collect(values):
        seen.extend(values)

    collect()
    rng = random.Random(9)
    seen.extend("".join(rng.choice("ab \t\n\r  é") for _ in range(rng.randint(0, 60))) for _ in range(300))
    df = spark.createDataFrame(list(enumerate(seen)), "n int, t string")
    t = F.col("t")
    rows = df.select("n", text.strip(t).alias("s"), text.collapse_ws(t).alias("c"), text.normalize_lines(t).alias("l")).collect()
    for r in rows:
        assert r.s == seen[r.n].strip()
        assert r.c == " ".join(seen[r.n].split())
        lines = r.l.split("\n")
        assert all(x == x.strip() for x in lines) and "\n\n\n" not in r.l and r.l == r.l.strip()
        assert [x for x in lines if x] == [x.strip() for x in seen[r.n].splitlines() if x.strip()]


def test_excerpt_and_slugs(spark):
    long = " ".join(["word"] * 200)
    df = spark.createDataFrame([(long,), ("x" * 800,), ("short",)], "t string")
    got = [r.e for r in df.select(text.excerpt(F.col("t")).alias("e")).collect()]
    assert got == [long[:700].rsplit(" ", 1)[0] + "...", "x" * 700 + "...", "short"]
    row = spark.createDataFrame([("  Why, é? ",)], "t string").select(
        text.slug(F.col("t")).alias("a"), text.query_slug(F.col("t")).alias("b"), text.char_slug(F.col("t")).alias("c"),
        text.query_slug(F.lit("??")).alias("d"),
    ).first()
    assert (row.a, row.b, row.c, row.d) == ("Why", "why", "why__é", "query")


def test_mentions_by_hand(spark):
    tags = ["75PI823.pv", "75TI1", "a-b"]
    phrases = tags + ["Pump A", "Pump A/1", "#12 valve", "a.*b"]
    texts = [
        "see 75pi823.PV, and (75TI1) not 75TI10", "75PI823.pv.old 75PI823.pv-", "a-b A-B a-b-c", "pump a/1 and Pump A.",
        "Pump A, pump A", "open #12 VALVE now a.*b", "nothing",
    ]
    chunks = spark.createDataFrame([(str(i), x) for i, x in enumerate(texts)], "chunk_id string, text string")

    def run(fn, names):
        df = spark.createDataFrame([(x,) for x in names], "tag string")
        return {(r.chunk_id, r.tag): r.matched for r in fn(chunks, df).collect()}

    by_tag = {("0", "75pi823.pv"): "75pi823.PV", ("0", "75ti1"): "75TI1", ("2", "a-b"): "a-b"}
    assert run(documents.mentions, tags) == by_tag
    more = {("3", "pump a/1"): "pump a/1", ("4", "pump a"): "Pump A", ("5", "#12 valve"): "#12 VALVE", ("5", "a.*b"): "a.*b"}
    assert run(documents.phrase_mentions, phrases) == by_tag | more


@pytest.mark.parametrize("ids", ["own", "shared", "null"])
def test_links_made_where_the_chunk_stands_are_those_of_the_join(spark, monkeypatch, tmp_path, ids):
    rng = random.Random(5)
    words = ["a", "A", "b-c", "B-C", "d.e", "D.E", "f_", "", " ", "é", "ßA", "\n", "\x85", "x", "75TI1", "İ", "K", "a\U0001f600a"]
    texts = [None, "", " ", "a", "A", " a", "a ", ",,a,,"] + [
        "".join(rng.choice(words) + rng.choice([" ", ",", "", " \u2003"]) for _ in range(rng.randint(1, 60))) for _ in range(1300)
    ]
    name = {"own": lambda i: f"c{i}", "shared": lambda i: f"c{i // 3}", "null": lambda i: None if i in (20, 21) else f"c{i}"}[ids]
    rows = [(name(i), "d", "f", i, x) for i, x in enumerate(texts)]
    spark.createDataFrame(rows, "chunk_id string, document_id string, file_name string, page long, text string").write.parquet(f"{tmp_path}/chunks")
    chunks = spark.read.parquet(f"{tmp_path}/chunks")

    def seen(links, found):
        """Rows that share an id may have two spellings of a tag at one place, of which either may be taken."""
        if ids == "shared":
            return sorted((r.chunk_id, r.page, sorted(map(str.lower, r.matched_sensor_tags))) for r in links.collect()), sorted((r.chunk_id, r.tag, r.place) for r in found.collect())
        return sorted(map(str, links.collect())), sorted(map(str, found.collect()))

    for known in (["a", "B-c", "D.e", "F_", "75ti1", "é", "k", "a b", "", None, "A"], ["a b"], []):
        tags = spark.createDataFrame([(t,) for t in known], "tag string")
        quick = documents.linked_chunks(chunks, tags)
        assert ids != "own" or "Exchange" not in quick._jdf.queryExecution().executedPlan().toString()
        got = seen(quick, documents.mentions(chunks, tags))
        monkeypatch.setattr(documents, "BROADCAST_ROWS", -1)
        assert got == seen(documents.linked_chunks(chunks, tags), documents.mentions(chunks, tags))
        monkeypatch.undo()


def test_nearest_chunks_both_ways(spark):
    rng = np.random.default_rng(1)
    q = rng.normal(size=(7, 8))
    v = rng.normal(size=(60, 8))
    v[10:20] = v[0]
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    q, v = unit(q), unit(v)
    questions = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(q)], "question_id bigint, embedding array<double>")
    corpus = spark.createDataFrame(
        [(f"c{i:03d}", i, x.tolist()) for i, x in enumerate(v)], "chunk_id string, doc_id bigint, embedding array<double>"
    ).repartition(5)
    scores = np.round(q @ v.T, 9)
    want = {
        (i, rank + 1, f"c{j:03d}")
        for i in range(7)
        for rank, j in enumerate(sorted(range(60), key=lambda j: (-scores[i, j], j))[:12])
    }
    for options in ({}, {"block": 2, "corpus_slice": 7}):
        got = retrieval.top_k_chunks(questions, corpus, 12, **options).collect()
        assert {(r.question_id, r.rank, r.chunk_id) for r in got} == want
    assert retrieval.top_k_chunks(questions.limit(0), corpus, 3).count() == 0
    assert retrieval.top_k_chunks(questions, corpus, 100).count() == 7 * 60


def test_zero_vectors(spark):
    df = spark.createDataFrame([([0.0, 0.0],), ([3.0, 4.0],)], "v array<double>")
    assert [r.n for r in df.select(vectors.l2_normalize(F.col("v")).alias("n")).collect()] == [[0.0, 0.0], [0.6, 0.8]]
    with pytest.raises(Exception, match="zero length"):
        df.select(vectors.query_vector(F.col("v"))).collect()


def test_encoder_rejects_empty_text(spark):
    import pandas as pd

    def encoder(texts):
        return pd.Series([[float(len(t)), 1.0] for t in texts])

    good = spark.createDataFrame([("a", "hello"), ("b", "x")], "chunk_id string, text string")
    rows = retrieval.encode_chunks(good, encoder, batch=1).collect()
    assert all(abs(sum(x * x for x in r.embedding) - 1) < 1e-6 for r in rows)
    with pytest.raises(Exception, match="without text"):
        retrieval.encode_chunks(good.withColumn("text", F.lit(" ")), encoder).collect()


def test_sensor_identification(spark):
    tags = spark.createDataFrame([(t,) for t in ("75PI801.pv", "75PI802.pv", "75TI9.pv", "flow_rate")], "tag string")
    qs = spark.createDataFrame(
        [(1, "Compare 75pi802.pv with flow flow"), (2, "what about 75PI80 and FLOW"), (3, "of")], "question_id int, question string"
    )
    got = {(r.question_id, r.rank): (r.tag, r.found_by) for r in retrieval.identify_sensors(qs, tags).collect()}
    assert got[1, 1] == ("75PI802.pv", "named") and got[1, 2] == ("flow_rate", "token")
    assert [got[2, i][0] for i in (1, 2, 3)] == ["75PI801.pv", "75PI802.pv", "flow_rate"]
    assert not [k for k in got if k[0] == 3]
    explicit = {(r.question_id, r.tag) for r in retrieval.explicit_sensors(qs, tags).collect()}
    assert (1, "75PI802.pv") in explicit and (1, "flow_rate") not in explicit and (2, "flow_rate") in explicit


def test_event_lookup_order_and_silent_questions(spark):
    events = spark.createDataFrame(
        [(f"e{i}", "s1", "col", "spike" if i % 2 else "shift", "note", None if i % 5 == 0 else f"2024-01-{i:02d}") for i in range(1, 12)],
        "event_id string, entity_id string, source_column string, event_type string, interpretation string, start string",
    )
    qs = spark.createDataFrame([(1, "a spike?"), (2, "?"), (3, "nomatch")], "question_id int, question string")
    rows = retrieval.event_lookup(qs, events, limit=3).collect()
    got = {q: [r.event_id for r in sorted(rows, key=lambda r: r.rank) if r.question_id == q] for q in (1, 2, 3)}
    assert got == {1: ["e5", "e11", "e9"], 2: ["e10", "e5", "e11"], 3: []}


def test_citations(spark):
    df = spark.createDataFrame([("[DOC:a p.1 chunk:x] [TS:SUMMARY:s] [EVENT:1] [EVENT:1]",)], "answer string")
    a = F.col("answer")
    row = df.select(
        c.citations(a).alias("plain"), c.citations(a, True).alias("all"),
        c.invalid_citations(c.citations(a, True), F.array(F.lit("DOC:a p.1 chunk:x"))).alias("bad"),
    ).first()
    assert row.plain == ["DOC:a p.1 chunk:x", "EVENT:1", "EVENT:1"]
    assert row.bad == ["TS:SUMMARY:s", "EVENT:1", "EVENT:1"]


def test_a_split_holds_few_pages_at_once(spark, monkeypatch):
    from pyspark.sql import functions as F

    from tagtrail.operators import documents

    made = {}
    monkeypatch.setattr(documents.F, "arrow_udf", lambda kind: lambda f: made.setdefault("split", f) and (lambda column: column))
    documents.split_chunks(F.lit("x"), 10, 2)

    import pyarrow as pa

    whole = pa.array(["word " * 7, None, "", "one"] * 100)
    got = made["split"](whole)
    assert got.slice(0, 4).to_pylist() == got.slice(396, 4).to_pylist() and len(got) == 400
    assert got[3].as_py() == ["one"] and got[1].as_py() == [] and len(made["split"](whole.slice(0, 0))) == 0
