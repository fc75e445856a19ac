"""One query per operator, over whole tables and with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tagtrail.llm import (
    arc, factor_machine, fill_in_middle, licences, line_dedup, merkle, mixing, quality_rules, secrets, simhash, tiling, token_lengths, url_filter,
)
from tagtrail.llm.licence_sql import LICENCE_SQL
from tagtrail.llm.manifest_sql import MANIFEST_SQL
from tagtrail.llm.text_sql import MIDDLE_SQL, URL_SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES = {"op1_licences": LICENCE_SQL, "op11_fill_in_middle": MIDDLE_SQL, "op12_merkle_manifest": MANIFEST_SQL, "op13_url_filter": URL_SQL}
#: Host, path and verdict of the rules for page URLs.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
#: Where the rank files of public tokenizers lie on each machine.
TOKENIZERS = "/opt/tokenizers"


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"))


@query
def op2_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiling.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("doc_hash")


@query
def op3_arc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arc.archive_round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


@query
def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.repeated_lines(table(spark, sf_dir, "documents"), least=1).drop("doc_hash")


@query
def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return quality_rules.judge(documents, quality_rules.fit(documents, table(spark, sf_dir, "labels")))


@query
def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op8_token_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{TOKENIZERS}/byte_bpe_multi_50k.tiktoken"
    return token_lengths.histogram(token_lengths.token_counts(table(spark, sf_dir, "documents"), path))


@query
def op9_factor_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, out = table(spark, sf_dir, "documents"), factor_machine.held_out()
    machine = factor_machine.fit(documents, table(spark, sf_dir, "labels"), ~out)
    return factor_machine.score(documents, machine).select("doc_id", out.alias("held_out"), "score", "predicted")


@query
def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    own = lambda *kinds: F.filter("secrets", lambda s: s["kind"].isin(*kinds))
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return found.select(
        "doc_id", *[F.size(own(k)).cast("bigint").alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(listed(own("assign", "access", "hex")), 256).alias("base_sha256"), listed(F.col("secrets")).alias("spans"),
    )


@query
def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle.transform(table(spark, sf_dir, "documents"), carry=["doc_id"])
    return fill_in_middle.restore(made).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256")
    )


@query
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    shown = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, lowered).otherwise(F.col("text"))
    return merkle.manifest(documents, shown).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


@query
def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.judge(pages.select("page_id", "url"), rules, url_filter.mirrored(pages)).select("page_id", "host", "path", "rule", "verdict")
