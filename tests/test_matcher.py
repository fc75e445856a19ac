"""The phrase matcher: against regular expressions, with a large dictionary, over several parts."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tagtrail.operators import documents, matcher, retrieval

SPANS = "[A-Za-z0-9_.-]"


def pattern(phrases):
    listed = "|".join(re.escape(p) for p in sorted(phrases, key=lambda p: (-len(p), p)))
    return re.compile(f"(?<!{SPANS})({listed})(?!{SPANS})")


def test_taken_spans_are_those_of_a_pattern():
    rng = random.Random(1)
    letters = "ab -/ü"
    for _ in range(300):
        phrases = {"".join(rng.choices(letters, k=rng.randrange(1, 6))) for _ in range(rng.randrange(1, 12))}
        machine = matcher.automaton(sorted(phrases))
        text = "".join(rng.choices(letters, k=rng.randrange(0, 60)))
        got = matcher.leftmost_longest(matcher.whole_word_spans(machine, text))
        assert got == [m.span() for m in pattern(phrases).finditer(text)], (phrases, text)


def test_no_phrases_and_no_text():
    assert matcher.automaton([]) is None and matcher.all_spans(None, "text") == []
    assert matcher.all_spans(matcher.automaton(["a"]), None) == [] and matcher.all_spans(matcher.automaton(["a"]), "") == []


@pytest.mark.parametrize("most", [200_000, 30_000])
def test_a_hundred_thousand_phrases(spark, most):
    rng = random.Random(2)
    phrases = [f"unit {k % 5000} / valve {k}" for k in range(99_000)] + [f"P-{k}" for k in range(1000)]
    texts = [(k, " , ".join(rng.sample(phrases, 20)) + f" and unit 7 / valve {k}x") for k in range(200)]
    dictionary = spark.createDataFrame([(p,) for p in phrases], "tag string")
    frame = spark.createDataFrame(texts, "chunk_id int, text string")
    found = matcher.taken(matcher.find(frame, "chunk_id", "text", dictionary, "tag", matcher.whole_word_spans, most), "chunk_id")
    got = {(r["chunk_id"], r["start"], r["end"]) for r in found.collect()}
    known = set(phrases)
    want = set()
    for k, t in texts:
        at = 0
        for piece in re.split(" , | and ", t):
            at = t.index(piece, at)
            if piece in known:
                want.add((k, at, at + len(piece)))
            at += len(piece)
    assert got == want and len(got) == 4000


def test_phrase_mentions_keep_the_spelling(spark):
    chunks = spark.createDataFrame([("c1", "The Main Pump and main pump 2, MAIN PUMP 2 too"), ("c2", None), ("c3", "İ main pump"), ("c4", "domain pump")], "chunk_id string, text string")
    tags = spark.createDataFrame([("main pump",), ("Main Pump 2",), (None,), ("",), ("main pump",)], "tag string")
    got = {(r["chunk_id"], r["tag"]): r["matched"] for r in documents.phrase_mentions(chunks, tags).collect()}
    assert got == {("c1", "main pump"): "Main Pump", ("c1", "main pump 2"): "main pump 2", ("c3", "main pump"): "main pump"}


def test_tags_inside_questions(spark):
    questions = spark.createDataFrame([(1, "Why is PUMP-12a hot?"), (2, None), (3, "nothing"), (1, "again pump-1")], "question_id int, question string")
    tags = spark.createDataFrame([("Pump-1",), ("pump-12",), ("12a h",), ("pump-2",)], "tag string")
    got = {(r["question_id"], r["tag"]) for r in retrieval._named_in(questions, tags).collect()}
    assert got == {(1, "Pump-1"), (1, "pump-12"), (1, "12a h")}
    assert retrieval._named_in(questions, tags.limit(0)).count() == 0
