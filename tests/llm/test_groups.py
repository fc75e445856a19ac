"""Operators that compare or gather rows: tiling, archives, mixing, line dedup, near-duplicates, components."""

import hashlib
import random
from collections import defaultdict

import pytest
import xxhash
from hypothesis import given, settings, strategies as st

from tagtrail.llm import arc, components, edit_distance, line_dedup, mixing, simhash, tiling
from tests.llm import data

# --- edit distance


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.text("abü", max_size=14), st.text("abü", max_size=14)), max_size=6), st.integers(0, 5))
def test_banded_distance(pairs, most):
    got = edit_distance.within([a for a, _ in pairs], [b for _, b in pairs], most)
    assert got.tolist() == [min(plain_distance(a, b), most + 1) for a, b in pairs]


# --- line dedup


def edited(rng, line, edits):
    for _ in range(edits):
        k = rng.randrange(len(line) + 1)
        line = rng.choice([line[:k] + rng.choice("abc ") + line[k:], line[:k] + line[k + 1 :], line[:k] + rng.choice("abc ") + line[k + 1 :]])
    return line


def plain_lines(rows):
    """(doc_id, line_no, line) in the order of the operator, the classes and links of the lines."""
    lines = sorted(((i is None, i, n, line) for i, t in rows for n, line in line_dedup.lines_of(t or "")), key=lambda r: (r[0], r[1] or 0, r[2]))
    first = {}
    for _, i, n, line in lines:
        first.setdefault(line, (i, n))
    every = list(first)
    near = {a: [b for b in every if a != b and abs(len(a) - len(b)) <= 2 and plain_distance(a, b) <= 2] for a in every}
    rank = {line: k for k, line in enumerate(every)}
    out = {}
    for _, i, n, line in lines:
        kept = first[line] == (i, n) and not any(rank[b] < rank[line] for b in near[line])
        out[i, n] = (*first[line], len(near[line]), kept)
    return out


@pytest.mark.parametrize("hot", [64, 1])
def test_line_links_equal_brute_force(spark, hot):
    rng = random.Random(hot)
    bases = ["".join(rng.choice("abc ") for _ in range(rng.randrange(20, 40))) for _ in range(12)] + ["x" * 30, "ab" * 15]
    pool = [edited(rng, rng.choice(bases), rng.randrange(0, 4)) for _ in range(160)]
    rows = [(k, "\n".join(rng.choices(pool, k=4) + ["short", ""])) for k in range(50)] + [(None, pool[0] + "\n" + pool[1])]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], data.DOCUMENTS)
    got = line_dedup.repeated_lines(docs, hot=hot).collect()
    want = plain_lines(rows)
    assert {(r["doc_id"], r["line_no"]): (r["class_doc"], r["class_line"], r["n_links"], r["kept"]) for r in got} == want
    assert sum(w[2] > 0 for w in want.values()) > 50


def test_lines_leave_texts(spark):
    a, b, c = "the first line of the text here", "the second line of the text here", "quite another line that stands alone"
    docs = data.documents(spark, [f"{a}\nshort\n{b}", f"{b}!\n{c}\nshort", a, "short\n\nshort"])
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in line_dedup.without_repeats(docs).collect()}
    assert got == {0: (f"{a}\nshort\n{b}", len(a) + len(b) + 7), 1: (f"{c}\nshort", len(c) + 6), 2: ("", 0), 3: ("short\n\nshort", 12)}


def test_lines_awkward(spark):
    docs = data.awkward(spark)
    out = line_dedup.without_repeats(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert out.where("text is null").count() == 1 and out.where("doc_id = 7").first()["text"] == "" and out.where("doc_id = 6 and text <> ''").count() == 2
    assert line_dedup.repeated_lines(data.empty(spark)).count() == 0 and line_dedup.without_repeats(data.empty(spark)).count() == 0


# --- components and near-duplicates


def plain_components(pairs):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    return {x: root(x) for x in parent}


def test_components(spark):
    rng = random.Random(4)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(1000, 1040)] + [(2000, k) for k in range(2001, 2200)]
    pairs = [(a, b) for a, b in pairs if a != b]
    got = components.connected_components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()
    assert {r["node"]: r["component"] for r in got} == plain_components(pairs) and len(got) == len(plain_components(pairs))


def plain_fingerprint(text):
    words = [w.translate({k: k + 32 for k in range(65, 91)}) for w in data_words(text)]
    if not words:
        return 0
    runs = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(r.encode(), seed=42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def data_words(text):
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.mark.parametrize("text", ["", "One", "A b", "A B c", "É a b C d a b c", "x y z\tq", " ".join(map(str, range(9000)))])
def test_fingerprint(text):
    assert simhash.fingerprint(text) % (1 << 64) == plain_fingerprint(text)


def test_links_equal_all_pairs(spark):
    rng = random.Random(9)
    prints = {rng.getrandbits(64) for _ in range(150)}
    for p in list(prints)[:100]:
        for flips in (1, 2, 3):
            prints.add(p ^ sum(1 << b for b in rng.sample(range(64), flips)))
    prints = sorted(p - (1 << 64) if p >> 63 else p for p in prints)
    got = {(r["a"], r["b"]) for r in simhash.links(spark.createDataFrame([(p,) for p in prints], "fingerprint bigint")).collect()}
    want = {(a, b) for k, a in enumerate(prints) for b in prints[k + 1 :] if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 2}
    assert got == want and len(want) > 100


def test_near_duplicates(spark):
    rng = random.Random(2)
    base = [" ".join(str(rng.randrange(10**6)) for _ in range(300)) for _ in range(8)]
    texts = [*base, *(t.replace(" 1", " 2", 1) for t in base), *(t.upper() for t in base), "", " \n", None, "tiny text"]
    docs = data.documents(spark, texts)
    got = simhash.near_duplicates(docs).collect()
    prints = {k: plain_fingerprint(t) for k, t in enumerate(texts)}
    pairs = [(a, b) for a in prints for b in prints if (prints[a] ^ prints[b]).bit_count() <= 2]
    classes = plain_components(pairs)
    assert {r["doc_id"]: (r["fingerprint"] % (1 << 64), r["component_id"]) for r in got} == {k: (prints[k], classes[k]) for k in prints}
    assert sorted(r["doc_id"] for r in simhash.without_near_duplicates(docs).collect()) == sorted(set(classes.values()))


def test_near_duplicates_awkward(spark):
    docs = data.awkward(spark)
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == docs.count() and {r["component_id"] for r in got if r["doc_id"] in (1, 2, 4)} == {1}
    kept = simhash.without_near_duplicates(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 3, 5, 6, 10]
    assert simhash.near_duplicates(data.empty(spark)).count() == 0 and simhash.without_near_duplicates(data.empty(spark)).count() == 0


# --- tiling


def plain_tiles(pattern, text, shortest):
    """Tiled words by greedy string tiling as it is defined: longest unmarked match first, by position."""
    a, b, total = [False] * len(pattern), [False] * len(text), 0
    while True:
        best = (shortest - 1, 0, 0)
        for i in range(len(pattern)):
            for j in range(len(text)):
                k = 0
                while i + k < len(pattern) and j + k < len(text) and text[j + k] is not None and pattern[i + k] == text[j + k] and not a[i + k] and not b[j + k]:
                    k += 1
                if k > best[0]:
                    best = (k, i, j)
        if best[0] < shortest:
            return total
        total += best[0]
        for k in range(best[0]):
            a[best[1] + k] = b[best[2] + k] = True


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=16), st.lists(st.lists(st.sampled_from("abc"), max_size=12), max_size=3), st.integers(1, 4))
def test_tiles_equal_definition(pattern, stretches, shortest):
    text = [w for s in stretches for w in [*s, None]]
    got = tiling.tiles(pattern, stretches, shortest)
    assert sum(n for _, _, n in got) == plain_tiles(pattern, text, shortest)
    assert all(pattern[a : a + n] == text[b : b + n] for a, b, n in got)


def test_leaks_also_moved_about(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"
    words = item.split()
    moved = " ".join(words[10:] + ["between"] + words[:10])
    half = " ".join(words[:10])
    docs = data.documents(spark, [f"Before, {item.upper()}! After.", f"So: {moved}.", f"Only {half} of it", "Nothing.", f"{half} {half} {half}", "It says: one two."])
    bench = spark.createDataFrame([(1, item), (2, "One two."), (3, None), (4, ""), (5, "?!")], "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]): r["coverage"] for r in tiling.leaks(docs, bench).collect()}
    assert got == {(0, 1): 1.0, (1, 1): 1.0, (5, 2): 1.0}
    assert sorted(r["doc_id"] for r in tiling.without_leaks(docs, bench).collect()) == [2, 3, 4]


def test_leaks_awkward(spark):
    item = "several words that the long awkward rows do not have"
    bench = spark.createDataFrame([(None, item), (1, item), (1, item), (1, "other words under the same id as before"), (2, None)], "item_id bigint, text string")
    docs = data.awkward(spark, [item, f"x {item} y"])
    got = tiling.leaks(docs, bench).collect()
    assert sorted((r["doc_id"], r["item_id"] or 0) for r in got) == [(10, 0), (10, 1), (11, 0), (11, 1)]
    clean = tiling.without_leaks(docs, bench)
    assert clean.columns == docs.columns and clean.count() == docs.count() - 2
    assert tiling.leaks(data.empty(spark), bench).count() == 0 and tiling.leaks(docs, bench.limit(0)).count() == 0
    assert tiling.without_leaks(docs, bench.limit(0)).count() == docs.count()


# --- archives


def test_archive_round_trip(spark):
    rows = data.page_rows()
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3)
    got = {r["page_id"]: r for r in arc.archive_round_trip(pages).collect()}
    assert len(got) == len(rows)
    for page, _, html in rows:
        body = (html or "").encode()
        same = sorted(p for p, _, h in rows if h == html and p is not None)
        first = same[0] if len(body) >= 100 else page
        r = got[page]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(body), hashlib.sha256(body).hexdigest())
        assert (r["record_type"], r["refers_to"]) == (("response", None) if page == first else ("revisit", first))


@pytest.mark.parametrize("version", [1, 2])
def test_arc_headers_are_read_by_version(version):
    import io

    body = b"HTTP/1.1 200 OK\r\nX-Page-Id: 7\r\n\r\n\n\nhttp://x 0 0 0 5\n"
    opening = arc.arc_opening("n.arc", version, "20010203040506")
    record = arc.arc_record("http://a/b", "20010203040506", body, version, "n.arc", len(opening) + 1, b"")
    got = list(arc.arc_records(io.BufferedReader(io.BytesIO(opening + b"\n" + record + b"\n" + record + b"\n"))))
    assert [(r["archive"], r["url"], r["date"], r["block"]) for r in got] == [("n.arc", "http://a/b", "20010203040506", body)] * 2
    assert got[0]["offset"] == len(opening) + 1
    with pytest.raises(ValueError, match="ends after"):
        list(arc.arc_records(io.BufferedReader(io.BytesIO(opening + b"\n" + record[:-3]))))


def test_archive_of_nothing_and_of_repeated_rows(spark):
    kind = "page_id bigint, url string, html string, record_id string, payload string"
    assert arc.archive_round_trip(spark.createDataFrame([], kind)).count() == 0
    row = (1, "http://a/", "v" * 150, None, None)
    got = arc.archive_round_trip(spark.createDataFrame([row, row], kind)).collect()
    assert sorted((r["record_type"], r["refers_to"]) for r in got if r["refers_to"]) == [("revisit", 1)] and len(got) == 2


# --- mixing


def plain_targets(sizes, weights=(5, 2, 1)):
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    left, free, target = 1.5 * sum(sizes.values()), set(sizes), {}
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 2 * sizes[s]]
        target |= share
        for s in over:
            target[s] = 2 * sizes[s]
            left -= target[s]
        free -= set(over)
        if not over:
            break
    return target


def mixed_rows(spark, rows):
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    return mixing.mix(frame), frame


def test_mix_meets_targets(spark):
    rng = random.Random(6)
    rows = [(k, " ".join("w" for _ in range(rng.randrange(0, 60))), rng.choice(["a", "b", "B", "é", None, "hot", "hot", "hot", "hot", "hot"])) for k in range(3000)]
    mixed, frame = mixed_rows(spark, rows)
    got = mixed.collect()
    sizes, taken = defaultdict(int), defaultdict(int)
    for i, t, s in rows:
        sizes[s] += len(t.split())
    want = plain_targets(sizes)
    assert len(got) == len(rows)
    for r in got:
        assert r["size"] == len(r["text"].split()) and r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]]) and 0 <= r["copies"] <= 2
        taken[r["source"]] += r["copies"] * r["size"]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 60
    again = mixing.mix(frame.repartition(7)).collect()
    assert {r["doc_id"]: r["copies"] for r in again} == {r["doc_id"]: r["copies"] for r in got}
    longer = [r["copies"] for r in got if r["source"] == "hot" and r["size"] > 40]
    shorter = [r["copies"] for r in got if r["source"] == "hot" and 0 < r["size"] < 10]
    assert sum(longer) / len(longer) > sum(shorter) / len(shorter)


def test_mix_takes_with_the_stated_probability(spark):
    rows = [(k, "w " * 10, "a") for k in range(4000)] + [(4000 + k, "w " * 10, "b") for k in range(4000)]
    mixed, _ = mixed_rows(spark, rows)
    copies = {s: [r["copies"] for r in mixed.where(f"source = '{s}'").collect()] for s in "ab"}
    assert sum(copies["a"]) == 8000 and sum(copies["b"]) == 4000 and set(copies["b"]) <= {0, 1, 2}


@pytest.mark.parametrize("seed", [1, 2, 3, 4])
def test_a_source_of_ten_documents_comes_near_its_target(spark, seed):
    """One document holds a third of the words; what the cut leaves is filled from those that follow."""
    rng = random.Random(seed)
    sizes = [300, *(rng.randrange(20, 120) for _ in range(9))]
    rows = [(k, "w " * n, "a") for k, n in enumerate(sizes)] + [(100 + k, "w " * 50, "b") for k in range(40)] + [(300 + k, "w " * 200, "c") for k in range(60)]
    mixed = mixing.mix(spark.createDataFrame(rows, "doc_id bigint, text string, source string"), seed=seed).collect()
    target = {r["source"]: r["target"] for r in mixed}
    taken = {s: sum(r["copies"] * r["size"] for r in mixed if r["source"] == s) for s in "abc"}
    assert target["a"] == pytest.approx(min(2 * sum(sizes), target["a"])) and 0 <= target["a"] - taken["a"] <= max(20, 0.05 * target["a"])
    assert max(r["copies"] for r in mixed) <= 2 and 0 <= target["c"] - taken["c"] <= 200


def test_mix_awkward(spark):
    docs = data.awkward(spark)
    got = mixing.mix(docs).collect()
    assert len(got) == docs.count() and all(r["copies"] <= 2 for r in got)
    assert len({r["copies"] for r in got if r["doc_id"] == 6}) == 1
    assert mixing.mix(data.empty(spark)).count() == 0


def test_mix_takes_the_first_of_the_pareto_order(spark, monkeypatch):
    """Unequal documents: inclusion over many seeds follows the stated rate, and what is taken heads a plain sort."""
    rng = random.Random(8)
    sizes = [rng.randrange(5, 60) for _ in range(400)]
    frame = spark.createDataFrame([(k, "w " * n, "a") for k, n in enumerate(sizes)] + [(1000 + k, "w " * 40, "b") for k in range(100)], "doc_id bigint, text string, source string").cache()
    want = plain_targets({"a": sum(sizes), "b": 4000})["a"]
    factor = want / sum(n * n**0.5 for n in sizes)
    assert max(factor * n**0.5 for n in sizes) < 2
    taken = defaultdict(int)
    for seed in range(12):
        for r in mixing.mix(frame, seed=seed, keep=["doc_id", "source"]).where("source = 'a'").collect():
            taken[r["doc_id"]] += r["copies"]
    for low, high in ((5, 15), (15, 30), (30, 45), (45, 60)):
        own = [k for k, n in enumerate(sizes) if low <= n < high]
        assert sum(taken[k] for k in own) / 12 == pytest.approx(sum(factor * sizes[k] ** 0.5 for k in own), rel=0.12)


@pytest.mark.parametrize("most", [0, 10**6])
def test_a_page_that_is_a_third_of_all_is_archived_over_many_tasks(spark, monkeypatch, most):
    """Revisits are found and resolved alike whether they are sent to all tasks or joined by a shuffle."""
    monkeypatch.setattr(arc, "BROADCAST_ROWS", most)
    rows = [(k, f"http://h/{k}", "c" * 300 if k % 3 == 0 else f"page {k} " * 30) for k in range(900)] + [(5000, None, None), (None, "http://n/", "c" * 300)]
    out = arc.archive_round_trip(spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(8)).collect()
    assert len(out) == len(rows)
    for r in out:
        own = next(h for i, _, h in rows if i == r["page_id"]) or ""
        again = own[:1] == "c" and r["page_id"] != 0
        assert (r["payload_bytes"], r["payload_digest"]) == (len(own), hashlib.sha256(own.encode()).hexdigest())
        assert (r["record_type"], r["refers_to"]) == (("revisit", 0) if again else ("response", None))
