"""Lines of any length in line dedup: exact classes for all that are not blank, links by length."""

import random

import pytest

from tagtrail.llm import line_dedup
from tests.llm import data
from tests.llm.test_groups import edited, plain_distance


def plain(rows):
    """As the operator says it, line by line: first of the class, links, kept."""
    lines = [(i, n, line.strip(" \t\r\x0b\x0c")) for i, t in rows for n, line in enumerate((t or "").split("\n"))]
    lines = [x for x in lines if x[2]]
    first = {}
    for i, n, line in lines:
        first.setdefault(line, (i, n))
    allowed = lambda a, b: 2 if min(len(a), len(b)) >= 20 else min(len(a), len(b)) // 10
    near = {a: [b for b in first if a != b and abs(len(a) - len(b)) <= 2 and plain_distance(a, b) <= allowed(a, b)] for a in first}
    rank = {line: k for k, line in enumerate(first)}
    return {(i, n): (*first[x], len(near[x]), first[x] == (i, n) and not any(rank[b] < rank[x] for b in near[x])) for i, n, x in lines}


@pytest.mark.parametrize("hot", [64, 1])
def test_short_lines_equal_brute_force(spark, hot):
    rng = random.Random(hot)
    bases = ["".join(rng.choice("abc ") for _ in range(n)) for n in range(6, 26)]
    pool = [edited(rng, rng.choice(bases), rng.randrange(0, 3)) for _ in range(170)] + ["a", "}", "Home", "Share this article"]
    rows = [(k, "\n".join(rng.choices(pool, k=5) + ["", " \t"])) for k in range(50)]
    got = line_dedup.repeated_lines(data.documents(spark, [t for _, t in rows]), hot=hot, least=1).collect()
    want = plain(rows)
    assert {(r["doc_id"], r["line_no"]): (r["class_doc"], r["class_line"], r["n_links"], r["kept"]) for r in got} == want
    assert sum(w[2] > 0 for w in want.values()) > 30


def test_query_and_stage_take_short_repeats(spark, tmp_path):
    import corpus_pipeline
    from tagtrail.llm import queries

    texts = ["Home\nShare this article\nA story of its own that is told once.", "Home\n\nShare this article!\nAnother story."]
    docs = data.documents(spark, texts)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r["doc_id"], r["line_no"]): r["kept"] for r in queries.op5_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {(0, 0): True, (0, 1): True, (0, 2): True, (1, 0): False, (1, 2): False, (1, 3): True}
    kept = {r["doc_id"]: r["text"] for r in corpus_pipeline.line_repeats(spark, docs, str(tmp_path)).collect()}
    assert kept == {0: texts[0], 1: "\nAnother story."}
