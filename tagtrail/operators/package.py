"""The knowledge package: file manifest, required parts, summary, and consistency checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tagtrail.sources.files import binary_files, file_digests, with_sha256

# Parts a package must have, and the rules that evidence carries.
REQUIRED_ARTIFACTS = [
    "domain_hypothesis", "ontology_candidate", "validated_knowledge", "validation_report", "timeseries_profile",
    "sensor_timeseries_summary", "event_candidates", "document_catalog", "document_chunks", "document_entity_links",
    "embedding_index", "embeddings", "chunk_metadata",
]
ANSWER_POLICY = [
    "must_use_only_retrieved_evidence", "must_preserve_source_provenance", "statistical_event_is_not_confirmed_fault",
    "document_mention_is_not_physical_assignment", "correlation_is_not_causation",
    "express_uncertainty_when_evidence_is_insufficient",
]
EVIDENCE_POLICY = [
    "statistical_event_is_not_confirmed_fault", "document_mention_is_not_physical_assignment",
    "correlation_is_not_causation", "insufficient_evidence_must_be_stated",
]


def package_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Every file of a written package with its artifact (first folder), size and SHA-256."""
    files = with_sha256(binary_files(spark, path, "part-*"))
    root = path.rstrip("/").rsplit("/", 1)[-1]
    inside = F.substring_index("path", f"{root}/", -1)
    return files.select(
        F.substring_index(inside, "/", 1).alias("artifact"), inside.alias("package_path"),
        F.col("length").alias("size_bytes"), "sha256",
    )


def missing_artifacts(manifest: DataFrame) -> DataFrame:
    """Required parts the manifest lacks; a package is complete only if this is empty."""
    spark = manifest.sparkSession
    required = spark.createDataFrame([(a,) for a in REQUIRED_ARTIFACTS], "artifact string")
    return required.join(manifest.select("artifact").distinct(), "artifact", "left_anti")


def package_summary(
    classes: DataFrame, relations: DataFrame, entities: DataFrame, report: DataFrame, vectors: DataFrame,
    nodes: DataFrame, edges: DataFrame,
) -> DataFrame:
    """One row: sizes of the ontology, the graph and the vector index, and the validation status."""

    def count(df: DataFrame):
        return df.agg(F.count("*")).scalar()

    shape = vectors.agg(F.count("*").alias("vectors"), F.max(F.size("embedding")).cast("bigint").alias("dims"))
    return shape.select(
        count(classes).alias("class_count"), count(relations).alias("relation_count"),
        count(entities).alias("entity_count"), report.select("status").scalar().alias("validation_status"),
        "vectors", "dims", count(nodes).alias("nodes"), count(edges).alias("edges"),
    )


__all__ = ["binary_files", "file_digests", "missing_artifacts", "package_manifest", "package_summary"]
