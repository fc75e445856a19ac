"""Fill-in-the-middle, Merkle manifest and URL filter: against SQL, plain Python and planted changes."""

import hashlib
import random

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tagtrail.llm import fill_in_middle as fim, merkle, url_filter
from tagtrail.llm.manifest_sql import MANIFEST_SQL
from tagtrail.llm.text_sql import MIDDLE_SQL, URL_SQL
from tests.llm import data
from tools import check

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_fill_in_middle", "op12_merkle_manifest", "op13_url_filter"])
def test_registered_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"create view {t} as from '{SF}/{t}.parquet'")
    got, want = entry.queries()[name](spark, SF).toPandas(), con.sql(entry.oracle_sql()[name]).df()
    assert len(got) and check.canonical(got) == check.canonical(want)


# --- fill in the middle


def mixed_texts(n=60):
    rng = random.Random(3)
    letters = ["a", "b ", "é", "漢", "\U0001f600", "<", ">", "P", "<P", "word ", "\n"]
    shared = "".join(rng.choices(letters[:5], k=3000))
    return ["", "x", "é", *("".join(rng.choices(letters, k=rng.randrange(1, 900))) + rng.choice(["", shared]) for _ in range(n))]


def test_chunk_counts_find_every_code_point():
    cache = fim.ChunkCache()
    for text in mixed_texts(20):
        known = fim.chunked(text, cache)
        assert known.whole.units == len(text) and known.whole.marked == any(m in text for m in ("<P>", "<S>", "<M>"))
        data_ = text.encode()
        for unit in {0, 1, len(text) // 3, len(text) - 1, len(text), *range(0, len(text), 97)} & set(range(len(text) + 1)):
            assert data_[: known.byte_of(unit)].decode() == text[:unit]


def test_markers_across_seams_are_seen(monkeypatch):
    for at in range(1, 3):
        whole = b"x" * 200 + b"<S>" + b"y" * 200
        parts = [whole[: 200 + at], whole[200 + at :]]
        assert fim.summary_of(parts[0]).then(fim.summary_of(parts[1])).marked
    one_byte = fim.EMPTY
    for byte in b"ab<M>c":
        one_byte = one_byte.then(fim.summary_of(bytes([byte])))
    assert one_byte.marked and one_byte.units == 6


def test_shared_passages_are_counted_once_and_the_cache_is_bounded():
    rng = random.Random(1)
    passage = "".join(rng.choices("abcdefgh é", k=40_000))
    cache = fim.ChunkCache()
    fim.chunked("first " + passage, cache)
    misses = cache.misses
    fim.chunked("another beginning, of other length " + passage, cache)
    assert cache.hits > 0.9 * misses and cache.misses - misses < 0.1 * misses
    small = fim.ChunkCache(5000)
    fim.chunked(passage, small)
    assert small.held <= 5000 and small.held == sum(map(len, small.known))
    sizes = [b - a for a, b in zip([0, *fim.cut_points(passage.encode())], fim.cut_points(passage.encode()))]
    assert max(sizes) <= fim.MAX_CHUNK and min(sizes[:-1]) >= fim.MIN_CHUNK and len(sizes) > 20


def test_every_output_gives_its_text_back(spark):
    texts = [*mixed_texts(), "a <P> b", "<S>", "text <M", "<", None]
    out = fim.restore(fim.transform(data.documents(spark, texts))).collect()
    assert {r["form"] for r in out} == {"plain", "psm", "spm"}
    for r in out:
        assert r["restored"] == (r["text"] or "") and r["n"] == len(r["text"] or "")
        if r["form"] != "plain":
            assert len(r["output"]) == r["n"] + 9 and r["output"].count("<M>") == 1
    everything = fim.transform(data.documents(spark, texts), rate=100, spm_rate=100).collect()
    assert {r["form"] for r in everything if r["text"] and not any(m in r["text"] for m in ("<P>", "<S>", "<M>"))} == {"spm"}


def test_middle_awkward(spark):
    docs = data.awkward(spark).withColumns({"n": F.lit("own"), "form": F.lit("own"), "output": F.lit("own"), "_own": F.lit(1)})
    out = fim.restore(fim.transform(docs)).collect()
    assert sorted(r["doc_id"] or 0 for r in out) == [0, 1, 2, 3, 4, 5, 6, 6, 7, 10] and all(r["restored"] == (r["text"] or "") for r in out)
    assert {r["_own"] for r in out} == {1} and "hi" in out[0].asDict()
    documents = data.awkward(spark).select("doc_id", "text").toArrow()  # noqa: F841  read by the statement
    want = duckdb.connect().sql(MIDDLE_SQL.replace("from documents", "from (select cast(doc_id as bigint) as doc_id, text from documents)")).df()
    got = fim.restore(fim.transform(data.awkward(spark), carry=["doc_id"])).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))
    assert check.canonical(got.toPandas()) == check.canonical(want)
    assert fim.restore(fim.transform(data.empty(spark))).count() == 0


# --- Merkle manifest


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row):
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def plain_up(nodes):
    levels = []
    while len(nodes) > 1:
        levels.append(nodes)
        nodes = [sha(*nodes[k : k + 16]) for k in range(0, len(nodes), 16)]
    return levels, nodes[0]


def plain_path(levels, at):
    for nodes in levels:
        run = nodes[at // 16 * 16 : at // 16 * 16 + 16]
        yield at % 16, run
        at //= 16


def plain_manifest(rows, tampered):
    groups, roots, out = {}, {}, []
    for r in rows:
        groups.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, plain_leaf(r), plain_leaf(tampered(r))))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in names:
        roots[g] = plain_up([m[2] for m in sorted(groups[g])])
    top, root = plain_up([roots[g][1] for g in names])
    for g in names:
        for at, (known, i, digest, shown) in enumerate(sorted(groups[g])):
            path = [*plain_path(roots[g][0], at), *plain_path(top, names.index(g))]
            proof = sha(*(d for slot, run in path for k, d in enumerate(run) if k != slot))
            node = shown
            for slot, run in path:
                node = sha(*run[:slot], node, *run[slot + 1 :])
            out.append((i if known else None, digest, roots[g][1], root, proof, node, node == root))
    return out


def low(row):
    text = row[4] if row[0] is None or row[0] % 5 or row[4] is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in row[4])
    return (*row[:4], text)


SHOWN = "case when doc_id % 5 = 0 then translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') else text end"
OUT = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def same_rows(got, want):
    return sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want))


def test_manifest_equals_plain_trees(spark):
    sizes = {None: 1, "a": 300, "B": 17, "é": 16, "": 2, "z": 33, **{f"s{k}": 1 for k in range(14)}}
    rows = [(i, g, "en", i, f"Text {i} of {g}") for i, g in enumerate(g for g, n in sizes.items() for _ in range(n))]
    random.Random(2).shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, lang string, n_chars bigint, text string")
    got = merkle.manifest(docs, F.expr(SHOWN)).select(*OUT).collect()
    assert same_rows(got, plain_manifest(rows, low)) and len({r["root"] for r in got}) == 1
    assert {r["verified"] for r in got if r["doc_id"] % 5} == {True} and {r["verified"] for r in got if r["doc_id"] % 5 == 0} == {False}


@pytest.mark.parametrize("sizes", [[1], [16], [17], [2, 1], [257]])
def test_small_trees(spark, sizes):
    rows = [(10 * g + k * 1000, f"g{g}", None, None, f"T{k}") for g, n in enumerate(sizes) for k in range(n)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, lang string, n_chars bigint, text string")
    assert same_rows(merkle.manifest(docs, F.expr(SHOWN)).select(*OUT).collect(), plain_manifest(rows, low))


def test_manifest_awkward(spark):
    docs = data.awkward(spark).withColumns({"at": F.lit(1), "digest": F.lit(1), "up": F.lit(1), "grp": F.lit(2), "shown": F.lit(3)})
    rows = [tuple(r) for r in docs.select("doc_id", "source", "lang", "n_chars", "text").collect()]
    assert same_rows(merkle.manifest(docs).select(*OUT).collect(), plain_manifest(rows, lambda r: r))
    assert merkle.manifest(data.empty(spark)).count() == 0
    documents = docs.select("doc_id", "text", "source", "lang", "n_chars").toArrow()  # noqa: F841  read by the statement
    want = duckdb.connect().sql(MANIFEST_SQL).df()
    shown = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(F.col("text"))
    assert check.canonical(merkle.manifest(docs, shown).select(*OUT).toPandas()) == check.canonical(want)


def test_states_fold_to_the_parent():
    run = [hashlib.sha256(b"%d" % k).digest() for k in range(16)]
    for slot, kept in enumerate(merkle.retained(run)):
        other = [*run[:slot], b"\x01" * 32, *run[slot + 1 :]]
        assert merkle.folded(kept, run, slot, b"\x01" * 32).hex() == sha(*(d.hex() for d in other))


# --- URL filter


def plain_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, path = rest[:end], rest[end:]
    path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


URLS = [
    None, "", "no scheme/en/", "://", "http://net", "http://net/", "http://NET/x", "http://inet/x", "http://a.b.net/en/", "https://Example.NET/en/1", "https://m.example.net/en", "x://www.example.com/de/1?q=1#f",
    "http://example.org/fr/a", "http://org/fr/", "http://example.org?/fr/", "http://example.org/fr/a", "http://x.org/p/?b=2&a=1&utm_source=q#t", "https://x.org:443/p?a=1&b=2", "http://É.org/fr/é", "http://a..net/", "ftp://h/://net/",
    "http://long.example/" + "p/" * 20_000,
]


def test_urls_against_plain_rules(spark):
    rules = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"), ("org", "/fr/a", "block"), (None, "/", "block"), ("long.example", "/p/p", "block")]
    pages = spark.createDataFrame(list(enumerate(URLS)), "page_id bigint, url string").withColumns({"key": F.lit("own"), "rule": F.lit(1), "row": F.lit(2), "possible": F.lit(2), "canonical": F.lit(3)})
    listed = spark.createDataFrame([("https://x.org/p/?utm_campaign=z&b=2&a=1",), (None,)], "url string")
    got = {r["page_id"]: r for r in url_filter.judge(pages, spark.createDataFrame(rules, "host string, path string, verdict string"), listed).collect()}
    for i, url in enumerate(URLS):
        host, path = plain_url(url)
        fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule, verdict = max(fits)[2:] if fits else (None, "block" if i in (16, 17) else "allow")
        assert (got[i]["host"], got[i]["path"], got[i]["rule"], got[i]["verdict"], got[i]["key"]) == (host, path, rule, verdict, "own"), url


def test_false_positives_are_removed(spark, monkeypatch):
    """A filter of one word lets nearly every key pass; the result stays that of the lists."""
    monkeypatch.setattr(url_filter, "MAX_BLOCK_BITS", 0)
    listed = spark.range(3000).select(F.concat(F.lit("http://h/"), F.col("id")).alias("url"))
    pages = spark.range(2000, 4000).select(F.col("id").alias("page_id"), F.concat(F.lit("https://h/"), F.col("id"), F.lit("/?ref=x")).alias("url"))
    rules = spark.createDataFrame([("net", "/", "block")], "host string, path string, verdict string")
    out = url_filter.judge(pages, rules, listed)
    assert {r["page_id"] for r in out.where("verdict = 'block'").collect()} == set(range(2000, 3000)) and out.count() == 2000


def test_the_filter_holds_all_its_keys(spark):
    keys = spark.range(5000).select(F.col("id").cast("string").alias("key"))
    bits = url_filter.block_bits_for(5000)
    words = url_filter.bloom_filter(keys, bits).first()["words"]
    assert len(words) == 1 << bits
    placed = spark.range(10_000).select(F.col("id").cast("string").alias("key"), *[c.alias(n) for c, n in zip(url_filter._place(F.col("id").cast("string"), bits), ("block", "bits"))]).collect()
    passed = [words[r["block"]] & r["bits"] == r["bits"] for r in placed]
    assert all(passed[:5000]) and sum(passed[5000:]) < 500


def test_urls_awkward(spark):
    pages = spark.createDataFrame(data.page_rows() * 2, "page_id bigint, url string, html string")
    rules = spark.createDataFrame([("example", "/", "block")], "host string, path string, verdict string")
    out = url_filter.judge(pages, rules, url_filter.mirrored(pages))
    assert out.count() == 2 * len(data.page_rows()) and set(out.columns) == {"page_id", "url", "html", "host", "path", "rule", "verdict"}
    assert url_filter.judge(pages.limit(0), rules, url_filter.mirrored(pages)).count() == 0
    bare = url_filter.judge(pages, rules.limit(0), pages.select("url").limit(0)).collect()
    assert {r["verdict"] for r in bare} == {"allow"} and {r["rule"] for r in bare} == {None}
    frame = spark.createDataFrame([(k, u, f"<p>{min(k, 9)}") for k, u in enumerate(URLS)] + [(None, "http://x/n", "<p>9"), (30, None, None)], "page_id bigint, url string, html string")
    pages = frame.toArrow()  # noqa: F841  read by the statement
    rules = spark.createDataFrame([("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")], "host string, path string, verdict string")
    got = url_filter.judge(frame, rules, url_filter.mirrored(frame)).select("page_id", "host", "path", "rule", "verdict").toPandas()
    assert check.canonical(got) == check.canonical(duckdb.connect().sql(URL_SQL).df())
