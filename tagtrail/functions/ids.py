"""Stable ids from content, and the hash buckets that decide a split."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tagtrail.functions.text import strip


def _joined(sep: str, parts: list[Column]) -> Column:
    # concat_ws would drop nulls and so shift the parts.
    return F.concat_ws(sep, *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))


def prefixed_sha1(prefix: str, value: Column, digits: int) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha1(value), 1, digits))


def document_id(name: Column, sha256: Column) -> Column:
    return prefixed_sha1("doc_", _joined("|", [name, sha256]), 16)


def chunk_id(document: Column, page: Column, index: Column) -> Column:
    return prefixed_sha1("chunk_", _joined("|", [document, page, index]), 16)


def knowledge_id(prefix: str, value: Column) -> Column:
    return prefixed_sha1(f"{prefix}_", value, 12)


def event_id(*parts: Column) -> Column:
    return prefixed_sha1("event_", _joined("|", list(parts)), 16)


def example_id(prefix: str, *parts: Column) -> Column:
    return prefixed_sha1(f"{prefix}_", _joined("||", list(parts)), 12)


def pair_key(instruction: Column, response: Column) -> Column:
    """SHA-256 of the trimmed, lowercased instruction and response; equal for exact duplicates."""
    clean = [F.lower(strip(F.coalesce(c, F.lit("")))) for c in (instruction, response)]
    return F.sha2(F.concat_ws("\n", *clean), 256)


def hash_bucket(key: Column) -> Column:
    """A number in [0, 1): the first 16 hex digits of the key's SHA-256 over 2^64."""
    digits = F.conv(F.substring(F.sha2(key, 256), 1, 16), 16, 10)
    return digits.cast("decimal(20,0)").cast("double") / F.lit(float(2**64))


def split_name(bucket: Column, train: float = 0.8, validation: float = 0.1) -> Column:
    return (
        F.when(bucket < train, "train").when(bucket < train + validation, "validation").otherwise("test")
    )
