"""URL filter: a blocked Bloom filter passes possible hits to an exact hash join.

Two lists are applied. Rules name a host and the beginning of a path; a rule fits its host and all subdomains, and the
longest fitting rule decides. Listed URLs are blocked where no rule fits, in canonical form: without scheme, fragment,
default port and tracking parameters, parameters sorted, host in lower case, no slash at the end of a path.

The keys that could hit a URL are few: each suffix of its host with each beginning of its path that has the length of
some rule's path, and its canonical form. The filter has one word of 64 bits per block; a key sets BITS_PER_KEY bits of
the word that its hash names. It is built from the lists by ``bit_or``, has 2**MAX_BLOCK_BITS words at most (1 MB) and
goes to the tasks as one value of that bound. Rows none of whose keys pass are settled without a join. The others are
joined exactly with the lists, which removes false positives; lists that outgrow the filter let more rows through and
change no result. Hot keys of that join are dealt over tasks.

Everything is DataFrame functions. A null URL, or one without ``://``, has an empty host and path, fits no rule and is
allowed. Very long URLs are treated whole. Repeated rows give repeated rows. An empty table, and empty lists, give
empty results and no hits. Of rules that are given twice the first verdict in code point order counts; of fitting rules
of equal length that with the longer host. Extra columns are kept; one that has the name of a new column gives way.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tagtrail.operators.joins import split_join
from tagtrail.session import staged

#: log2 of the largest number of words, the bits that a key sets, and keys per word that the size is chosen for.
MAX_BLOCK_BITS, BITS_PER_KEY, KEYS_PER_WORD = 17, 4, 6
#: Distinct lengths of rule paths and of hosts (in labels) that are tried; more raise an error.
MAX_LENGTHS = 4096

# Parameters that name a campaign and not a page, and default ports.
TRACKING = r"^(utm_[^=]*|gclid|fbclid|ref)(=|$)"
PORTS = r":(80|443)$"

#: A listed URL's key begins with a character that no host has, so that it is never taken for a rule.
_URL = "="


def host_of(url: Column) -> Column:
    """What stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A to Z in lower case; else empty."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """The form in which URLs are listed; null where there is no ``://``."""
    host = F.regexp_replace(host_of(url), PORTS, "")
    path = F.regexp_replace(path_of(url), r"/+\z", "")
    query = F.split(F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1), "&")
    kept = F.array_sort(F.filter(query, lambda p: (p != "") & ~p.rlike(TRACKING)))
    return F.when(url.contains("://"), F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")))


def rule_keys(rules: DataFrame) -> DataFrame:
    """(key, rule, verdict) of a table of rules (host, path, verdict); a path is what follows the host, from its slash on."""
    named = rules.where("host is not null and path is not null").select(F.concat("host", "path").alias("rule"), "host", "path", "verdict")
    # Host and path are apart in the key: of "a" + "b/" and "ab" + "/" only one can be meant.
    return named.groupBy(F.concat_ws("\x00", "host", "path").alias("key")).agg(F.min("rule").alias("rule"), F.min("verdict").alias("verdict"))


def listed_keys(listed: DataFrame, url: str = "url") -> DataFrame:
    keys = listed.select(F.concat(F.lit(_URL), canonical(F.col(url))).alias("key")).where("key is not null").distinct()
    return keys.select("key", F.lit(None).cast("string").alias("rule"), F.lit("block").alias("verdict"))


def possible_keys(host: Column, path: Column, canonical_url: Column, path_lengths: list[int]) -> Column:
    """All keys that could hit, those of longer rules first: (length, host length, key)."""
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    starts = F.filter(F.array(*[F.lit(n) for n in path_lengths]).cast("array<int>"), lambda n: n <= F.length(path))
    entry = lambda s, n: F.struct((F.length(s) + n).alias("length"), F.length(s).alias("host"), F.concat(s, F.lit("\x00"), F.substring(path, F.lit(1), n)).alias("key"))
    of_rules = F.flatten(F.transform(suffixes, lambda s: F.transform(starts, lambda n: entry(s, n))))
    of_url = F.array(F.struct(F.lit(-1).alias("length"), F.lit(-1).alias("host"), F.concat(F.lit(_URL), canonical_url).alias("key")))
    return F.sort_array(F.filter(F.concat(of_rules, of_url), lambda k: k["key"].isNotNull()), asc=False)


def _place(key: Column, block_bits: int) -> tuple[Column, Column]:
    """Number of the word, and the bits that must be set in it."""
    h = F.xxhash64(key)
    block = F.shiftrightunsigned(h, 64 - block_bits).cast("int") if block_bits else F.lit(0)
    bits = F.lit(0).cast("bigint")
    for k in range(BITS_PER_KEY):
        at = F.shiftright(h, 6 * k).bitwiseAND(F.lit(63)).cast("int")
        bits = bits.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), at))
    return block, bits


def bloom_filter(keys: DataFrame, block_bits: int) -> DataFrame:
    """One row with ``words``, 2**block_bits numbers of 64 bits."""
    block, bits = _place(F.col("key"), block_bits)
    found = keys.groupBy(block.alias("block")).agg(F.bit_or(bits).alias("word"))
    every = keys.sparkSession.range(1 << block_bits).select(F.col("id").cast("int").alias("block"))
    dense = every.join(found, "block", "left").select(F.struct("block", F.coalesce("word", F.lit(0).cast("bigint")).alias("word")).alias("w"))
    return dense.agg(F.sort_array(F.collect_list("w"))["word"].alias("words"))


def block_bits_for(n: int) -> int:
    return min(MAX_BLOCK_BITS, max(6, (n // KEYS_PER_WORD).bit_length()))


def judge(pages: DataFrame, rules: DataFrame, listed: DataFrame | None = None, url: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` (null if none fits) and ``verdict``."""
    new = ("host", "path", "rule", "verdict")
    kept = [c for c in pages.columns if c not in new]
    entries = rule_keys(rules)
    if listed is not None:
        entries = entries.unionByName(listed_keys(listed))
    lengths = sorted(r[0] for r in rules.where("host is not null and path is not null").select(F.length("path")).distinct().limit(MAX_LENGTHS + 1).collect())
    if len(lengths) > MAX_LENGTHS:
        raise ValueError(f"rules have paths of more than {MAX_LENGTHS} lengths")
    block_bits = block_bits_for(entries.count())
    words = bloom_filter(entries, block_bits).scalar()

    def passes(key: Column) -> Column:
        block, bits = _place(key, block_bits)
        return F.element_at("_words", block + 1).bitwiseAND(bits) == bits

    # The row travels in one column, so that its names meet no name used here.
    row = F.struct(*kept, host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path")).alias("row")
    parsed = pages.select(row, canonical(F.col(url)).alias("canonical"), words.alias("_words"))
    keys = possible_keys(F.col("row.host"), F.col("row.path"), F.col("canonical"), lengths)
    found = parsed.select("row", F.filter(keys, lambda k: passes(k["key"])).alias("possible"))
    none = F.lit(None).cast("string").alias("rule")
    judged = found.where(F.size("possible") == 0).select("row", none, F.lit(default).alias("verdict"))
    judged = judged.unionByName(_confirmed(found.where(F.size("possible") > 0), entries, default))
    return judged.select(*[F.col("row")[c].alias(c) for c in (*kept, "host", "path")], "rule", "verdict")


def _confirmed(rows: DataFrame, entries: DataFrame, default: str) -> DataFrame:
    """Rows with the entry of their first key that is listed indeed.

    A round joins each row by one key. Rows whose key was a false positive go on with their next one; as these are a
    small part of the part before, a few rounds end it.
    """
    done, rows = [], staged(rows, "url-keys")
    while True:
        rest = F.slice("possible", 2, F.greatest(F.size("possible") - 1, F.lit(0)))
        tried = rows.select("row", F.col("possible")[0]["key"].alias("key"), rest.alias("possible"))
        joined = staged(split_join(tried, entries, ["key"], "left", spread=["row"]), "url-keys")
        over = F.col("verdict").isNotNull() | (F.size("possible") == 0)
        done.append(joined.where(over).select("row", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict")))
        rows = joined.where(~over).select("row", "possible")
        if rows.isEmpty():
            return reduce(DataFrame.unionByName, done)


def mirrored(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(url) of the pages whose html, if there is any, is that of a page with a smaller id. Null ids come last."""
    rank = F.struct(F.col(page_id).isNull().alias("none"), F.col(page_id).alias("id"))
    narrow = pages.where(F.length(html) > 0).select(F.col(url).alias("url"), rank.alias("rank"), F.sha2(html, 256).alias("digest"))
    firsts = narrow.groupBy("digest").agg(F.min("rank").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    return split_join(narrow, firsts, ["digest"], "inner", spread=["url", "rank"]).where("rank > first").select("url")
