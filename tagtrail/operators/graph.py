"""The knowledge graph as node and edge tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tagtrail.operators.joins import hot_hashes, split_join
from tagtrail.session import shuffle_width, staged

#: So many ends that are no nodes are sent to all tasks; more are joined by a shuffle. Rows that a task merges.
BROADCAST_ROWS, MERGE_ROWS = 1_000_000, 1_000_000

# Relation types an edge may have.
EDGE_TYPES = [
    "INSTANCE_OF", "HAS_MEASUREMENT", "HAS_COMPONENT", "HAS_SUBSYSTEM", "MONITORED_BY", "MEASURES", "HAS_CONDITION",
    "DOCUMENTED_BY", "RELATED_TO", "HAS_MAINTENANCE",
]
EVENT_CONSTANTS = {
    "source_type": "time_series_analysis",
    "analysis_method": "statistical",
    "analysis_artifact": "event_candidates",
}
EVENT_OPTIONAL = [
    "start", "end", "peak_timestamp", "timestamp", "direction", "sample_count", "peak_value", "peak_robust_z",
    "change_score",
]


def _or(c: Column | str, default) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(c, default if isinstance(default, Column) else F.lit(default))


def _origin() -> list[Column]:
    where = F.col("provenance.location")
    return [
        F.col("provenance.source_id").alias("source_id"), F.col("provenance.source_type").alias("source_type"),
        where["sheet"].alias("source_sheet"), where["column"].alias("source_column"),
        where["data_rows"]["start"].alias("source_row_start"), where["data_rows"]["end"].alias("source_row_end"),
        F.col("provenance.extraction_method").alias("extraction_method"),
    ]


def node_properties(entities: DataFrame) -> DataFrame:
    """Entities flattened to node properties, defaults filled in."""
    return entities.select(
        "id", _or("label", F.col("id")).alias("label"), _or("entity_type", "Entity").alias("entity_type"),
        _or("candidate_class", "Entity").alias("candidate_class"), _or("status", "candidate").alias("status"),
        _or("confidence", 0.0).alias("confidence"), F.col("attributes.source_tag").alias("source_tag"),
        F.col("attributes.tag_family").alias("tag_family"), *_origin(),
    )


def edge_properties(relations: DataFrame) -> DataFrame:
    """Relations flattened to edge properties, defaults filled in."""
    return relations.select(
        "id", _or("status", "candidate").alias("status"), _or("confidence", 0.0).alias("confidence"), "evidence_type",
        *_origin(),
    )


def event_properties(events: DataFrame, source_id: str) -> DataFrame:
    """Events flattened to node properties; optional fields the event lacks are null."""
    optional = [F.col(c) if c in events.columns else F.lit(None).alias(c) for c in EVENT_OPTIONAL]
    return events.select(
        F.col("event_id").alias("id"), "event_type", "sensor_tag", _or("status", "candidate").alias("status"),
        "interpretation", F.lit(source_id).alias("source_id"),
        *(F.lit(v).alias(k) for k, v in EVENT_CONSTANTS.items()), *optional,
    )


def edge_type(relation: Column) -> Column:
    return F.upper(F.trim(relation))


def check_edge_types(relations: DataFrame, strict: bool = False) -> DataFrame:
    """Add the clean ``edge_type`` and ``accepted``; ``strict`` raises on a type that is not allowed."""
    kind = edge_type(F.col("relation"))
    known = F.coalesce(kind.isin(EDGE_TYPES), F.lit(False))
    if strict:
        kind = F.when(known, kind).otherwise(
            F.raise_error(F.concat(F.lit("unsupported relation type: "), _or(kind, "null"))).cast("string")
        )
    return relations.withColumn("edge_type", kind).withColumn("accepted", known)


def class_nodes(relations: DataFrame) -> DataFrame:
    """A class for every INSTANCE_OF target."""
    return (
        relations.where((edge_type(F.col("relation")) == "INSTANCE_OF") & (F.col("target") != ""))
        .select(F.col("target").alias("name"))
        .distinct()
        .select("name", F.lit("candidate").alias("status"), F.lit("ontology_candidate").alias("source"))
    )


def upsert(
    existing: DataFrame, incoming: DataFrame, keys: Sequence[str], order: Sequence[str], create_only: bool = False
) -> DataFrame:
    """``existing`` with ``incoming`` merged in by ``keys``; of several incoming rows the last in ``order`` wins.

    With ``create_only``, rows that exist stay as they are and only new keys are added.
    """
    latest = latest_per_key(incoming, keys, order)
    if create_only:
        new = latest.join(existing.select(*keys), list(keys), "left_anti")
        return existing.unionByName(new, allowMissingColumns=True)
    return existing.join(latest.select(*keys), list(keys), "left_anti").unionByName(
        latest, allowMissingColumns=True
    )


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key, the last in ``order``; copies are folded before the shuffle."""
    fields = [c for c in df.columns if c not in keys]
    if not fields:
        return df.distinct()
    return df.groupBy(*keys).agg(F.max_by(F.struct(*fields), F.struct(*order)).alias("v")).select(*keys, "v.*")


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that break uniqueness; empty for a sound table."""
    return df.groupBy(*keys).agg(F.count("*").alias("copies")).where(F.col("copies") > 1)


def _properties(df: DataFrame, skip: Sequence[str]) -> Column:
    """Non-null columns as a string map."""
    names = [c for c in df.columns if c not in skip]
    entries = F.array(*(F.struct(F.lit(c).alias("key"), F.col(c).cast("string").alias("value")) for c in names))
    return F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))


def node_rows(df: DataFrame, key: str, label: str) -> DataFrame:
    """Rows as nodes ``id, labels, properties``."""
    return df.select(F.col(key).alias("id"), F.array(F.lit(label)).alias("labels"), _properties(df, [key]).alias("properties"))


def graph_nodes(
    entities: DataFrame, classes: DataFrame, events: DataFrame, chunks: DataFrame, source_id: str
) -> DataFrame:
    """All nodes as ``id, labels, properties``."""
    return (
        node_rows(node_properties(entities), "id", "Entity")
        .unionByName(node_rows(classes, "name", "Class"))
        .unionByName(node_rows(event_properties(events, source_id), "id", "Event"))
        .unionByName(node_rows(chunks.select("chunk_id", "document_id", "file_name", "page", "text"), "chunk_id",
                               "DocumentChunk"))
    )


def merged_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose two ends are among ``nodes``, one per ``src, type, dst``.

    Of several the one with the greatest properties, compared as sorted JSON, stays. Edges are shuffled once, by their source,
    so that those of one source stand together; the ends that are no nodes are looked up among the different ends.
    """
    edges, counted, parts = _known_edges(edges, nodes)
    hot = hot_hashes(counted, F.xxhash64("src"), shuffle_width(edges.sparkSession))
    dealt = F.pmod(F.xxhash64("type", "dst"), F.lit(parts)).cast("int")
    # A constant would fall out of the grouping, which then would ask for a shuffle of its own.
    keys = ["src", "_deal"] if hot else ["src"]
    spread = edges.withColumn("_deal", F.when(F.xxhash64("src").isin(list(hot)), dealt).otherwise(0)) if hot else edges
    merged = spread.repartition(parts, *keys).groupBy(*keys, "type", "dst")
    return merged.agg(F.max_by("properties", _sorted_json("properties")).alias("properties")).select("src", "type", "dst", "properties")


def exported_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``export_edges`` of ``merged_edges`` in ranges of the element id, so that merging and order take one shuffle together."""
    known, _, parts = _known_edges(edges.withColumn("properties", _sorted_json("properties")), nodes)
    named = known.select(edge_id(F.col("src"), F.col("type"), F.col("dst")).alias("element_id"), "src", "type", "dst", "properties")
    merged = named.repartitionByRange(parts, "element_id").groupBy("element_id", "src", "type", "dst").agg(F.max("properties").alias("properties"))
    return merged.select("element_id", F.col("src").alias("start_element_id"), F.col("dst").alias("end_element_id"), "type", "properties")


def _known_edges(edges: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """Edges whose two ends are among ``nodes``, all edges with two ends as a written table, and partitions to merge them in."""
    edges = counted = staged(edges.where(F.col("src").isNotNull() & F.col("dst").isNotNull()), "edges")
    ids = staged(nodes.select(F.col("id").alias("end")).distinct(), "ids")
    ends = edges.select(F.col("src").alias("end")).distinct().unionByName(edges.select(F.col("dst").alias("end")).distinct()).distinct()
    unknown = staged(ends.join(ids, "end", "left_anti"), "unknown")
    few, rows = unknown.count() <= BROADCAST_ROWS, edges.count()
    # Most edges may lead to one class or sensor: the rows of such an end are dealt over tasks.
    for end, other in (("src", "dst"), ("dst", "src")):
        own = unknown.withColumnRenamed("end", end)
        edges = edges.join(F.broadcast(own), end, "left_anti") if few else split_join(edges, own, [end], "left_anti", spread=[other, "type"], counted=counted)
    return edges, counted, max(shuffle_width(edges.sparkSession), rows // MERGE_ROWS)


def graph_edges(relations: DataFrame, detected_by: DataFrame, mentions: DataFrame, source_id: str) -> DataFrame:
    """All edges as ``src, type, dst, properties``; only relations of an allowed type are taken.

    ``detected_by`` holds ``event_id, entity_id``; ``mentions`` holds ``chunk_id, entity_id, file_name, page``.
    """
    checked = check_edge_types(relations).where("accepted")
    structural = checked.select(
        F.col("source").alias("src"), F.col("edge_type").alias("type"), F.col("target").alias("dst"), "id",
        _or("status", "candidate").alias("status"), _or("confidence", 0.0).alias("confidence"), "evidence_type",
        *_origin(),
    )

    def edges(df: DataFrame) -> DataFrame:
        return df.select("src", "type", "dst", _properties(df, ["src", "type", "dst"]).alias("properties"))

    detected = detected_by.select(
        F.col("event_id").alias("src"), F.lit("DETECTED_BY").alias("type"), F.col("entity_id").alias("dst"),
        F.lit("candidate").alias("status"), F.lit(source_id).alias("source_id"),
        F.lit("time_series_analysis").alias("evidence_type"),
        F.lit(EVENT_CONSTANTS["analysis_artifact"]).alias("analysis_artifact"),
    )
    mentioned = mentions.select(
        F.col("chunk_id").alias("src"), F.lit("MENTIONS").alias("type"), F.col("entity_id").alias("dst"),
        F.lit("exact_text_match").alias("evidence_type"), F.lit("candidate").alias("status"),
        F.col("file_name").alias("source_id"), "page",
    )
    return edges(structural).unionByName(edges(detected)).unionByName(edges(mentioned))


def edge_id(src: Column, kind: Column, dst: Column) -> Column:
    return F.concat_ws("|", src, kind, dst)


def export_nodes(nodes: DataFrame) -> DataFrame:
    """Rows of a node file: id, labels, properties as JSON with sorted keys."""
    return nodes.select(F.col("id").alias("element_id"), "labels", _sorted_json("properties").alias("properties"))


def export_edges(edges: DataFrame) -> DataFrame:
    return edges.select(
        edge_id(F.col("src"), F.col("type"), F.col("dst")).alias("element_id"),
        F.col("src").alias("start_element_id"), F.col("dst").alias("end_element_id"), "type",
        _sorted_json("properties").alias("properties"),
    )


def _sorted_json(name: str) -> Column:
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(name))))


def graph_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes, edges and distinct labels as one row."""
    labels = nodes.select(F.explode("labels").alias("label")).agg(F.countDistinct("label").alias("labels"))
    return nodes.agg(F.count("*").alias("nodes")).select(
        "nodes", edges.agg(F.count("*")).scalar().alias("edges"), labels.scalar().alias("labels")
    )
