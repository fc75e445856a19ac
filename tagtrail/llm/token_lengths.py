"""Token counts: the exact histogram of encoded lengths, and what its suffix sums answer.

Each text is encoded whole; the corpus is then one row per length that occurs. For a context limit L, documents over
it, tokens in all, and tokens after truncation follow from the suffix sums at L, exactly and for any number of limits,
without touching the documents again.

Null or empty text: length 0. Repeated rows count each. An empty table has an empty histogram, totals of 0 and null
quantiles. The histogram has at most as many rows as the longest document has tokens.
"""

from __future__ import annotations

import base64
import functools

import tiktoken
from pyspark.sql import DataFrame, Window, functions as F

from tagtrail.llm.texts import map_texts
from tagtrail.session import staged

# Fixed value: the pattern that cuts texts before the merges of these rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Lengths of one block; suffix sums run inside blocks and over blocks.
BLOCK = 4096


@functools.lru_cache(maxsize=2)
def encoding(path: str, pattern: str) -> tiktoken.Encoding:
    """A byte-level encoding from a file of ranks, once per Python worker."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("corpus", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def token_counts(documents: DataFrame, path: str, pattern: str = PATTERN, text: str = "text", carry=("doc_id",)) -> DataFrame:
    """``n_tokens`` of every row. ``path`` must be readable on each executor, like the library itself."""

    def run(texts: list[str], part) -> dict:
        encode = encoding(path, pattern).encode_ordinary
        return {"n_tokens": [len(encode(t)) if t else 0 for t in texts]}

    return map_texts(documents, run, "n_tokens bigint", text, carry)


def histogram(counts: DataFrame) -> DataFrame:
    """One row per length of ``n_tokens``.

    n_docs and n_tokens at this length; docs_from, tokens_from: at it or above; truncated_tokens: what is left of the
    corpus when every document is cut at this length.
    """
    # Written once, so that no text goes through the tokenizer a second time.
    lengths = staged(counts.groupBy(F.col("n_tokens").alias("length")).agg(F.count("*").alias("n_docs")), "lengths")
    lengths = lengths.withColumns({"n_tokens": F.col("length") * F.col("n_docs"), "block": F.floor(F.col("length") / BLOCK)})
    blocks = lengths.groupBy("block").agg(F.sum("n_docs").alias("block_docs"), F.sum("n_tokens").alias("block_tokens"))
    above = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    below = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(
        "block",
        F.coalesce(F.sum("block_docs").over(above), F.lit(0)).alias("docs_above"),
        F.coalesce(F.sum("block_tokens").over(above), F.lit(0)).alias("tokens_above"),
        F.coalesce(F.sum("block_tokens").over(below), F.lit(0)).alias("tokens_below"),
    )
    up = Window.partitionBy("block").orderBy("length").rowsBetween(Window.unboundedPreceding, -1)
    down = Window.partitionBy("block").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, 0)
    joined = lengths.join(blocks, "block")
    docs_from = F.sum("n_docs").over(down) + F.col("docs_above")
    shorter = F.coalesce(F.sum("n_tokens").over(up), F.lit(0)) + F.col("tokens_below")
    return joined.select(
        "length", "n_docs", "n_tokens", docs_from.alias("docs_from"),
        (F.sum("n_tokens").over(down) + F.col("tokens_above")).alias("tokens_from"),
        (shorter + F.col("length") * docs_from).alias("truncated_tokens"),
    )


def at_limits(hist: DataFrame, limits: list[int]) -> DataFrame:
    """For each context limit: documents and tokens in all, documents over the limit, tokens after truncation.

    The suffix sums of the first length over the limit answer it: what is longer is cut to the limit, the rest is whole.
    """
    first = {x: F.min_by(F.struct("docs_from", "tokens_from"), F.when(F.col("length") > x, F.col("length"))).alias(f"over_{x}") for x in dict.fromkeys(limits)}
    totals = hist.agg(F.coalesce(F.sum("n_docs"), F.lit(0)).alias("n_docs"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n_tokens"), *first.values())
    over = lambda x, c: F.coalesce(F.col(f"over_{x}")[c], F.lit(0))
    rows = [
        F.struct(
            F.lit(x).cast("bigint").alias("context"), over(x, "docs_from").alias("docs_over"),
            (F.col("n_tokens") - over(x, "tokens_from") + F.lit(x) * over(x, "docs_from")).alias("truncated_tokens"),
        )
        for x in limits
    ]
    return totals.select("n_docs", "n_tokens", F.inline(F.array(*rows))).select("context", "n_docs", "n_tokens", "docs_over", "truncated_tokens")


def quantiles(hist: DataFrame, shares: list[float]) -> DataFrame:
    """For each share the smallest length that at least this share of the documents do not exceed."""
    total = hist.agg(F.coalesce(F.sum("n_docs"), F.lit(0))).first()[0]
    reached = F.lit(total) - F.col("docs_from") + F.col("n_docs")
    return hist.agg(*[F.min(F.when(reached >= F.lit(s) * total, F.col("length"))).alias(f"q{s}") for s in shares])
