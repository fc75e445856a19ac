"""Domain hypothesis, ontology, entities, relations, and the checks on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tagtrail.functions.ids import event_id, knowledge_id
from tagtrail.functions.tags import FAMILIES, class_confidence, sensor_class
from tagtrail.operators.joins import split_join
from tagtrail.session import staged

# The universal core classes.
CORE_CLASSES = {
    "Asset": "A physical industrial asset being monitored or operated.",
    "Component": "A physical sub-part of an asset.",
    "Subsystem": "A functional subsystem associated with an asset.",
    "Sensor": "An instrument or signal used to observe a physical quantity.",
    "Measurement": "A value produced by a sensor at a point in time.",
    "Process": "An industrial process or operating activity.",
    "Event": "A temporally bounded event derived from observations or records.",
    "Condition": "An observed operating or equipment condition.",
    "Maintenance": "A maintenance activity or maintenance record.",
    "Document": "A source document containing technical or operational knowledge.",
}
# Classes added for a domain or subdomain, as (domain, name, parent, confidence).
DOMAIN_CLASSES = [
    ("industrial_process", "IndustrialEquipment", "Asset", 0.75),
    ("industrial_process", "IndustrialMeasurement", "Measurement", 0.75),
    ("rotating_equipment", "RotatingEquipment", "IndustrialEquipment", 0.60),
    ("rotating_equipment", "Compressor", "RotatingEquipment", 0.55),
    ("rotating_equipment", "Bearing", "Component", 0.50),
    ("rotating_equipment", "LubricationSystem", "Subsystem", 0.50),
]
# Relation types as (name, domain, range).
RELATION_TYPES = [
    ("HAS_COMPONENT", "Asset", "Component"),
    ("HAS_SUBSYSTEM", "Asset", "Subsystem"),
    ("MONITORED_BY", "Asset", "Sensor"),
    ("MEASURES", "Sensor", "Measurement"),
    ("HAS_MEASUREMENT", "Asset", "Measurement"),
    ("OBSERVED_DURING", "Measurement", "Event"),
    ("HAS_CONDITION", "Asset", "Condition"),
    ("DOCUMENTED_BY", "Asset", "Document"),
    ("RELATED_TO", "Event", "Event"),
    ("HAS_MAINTENANCE", "Asset", "Maintenance"),
]
# Domains in order of preference and the score each kind of evidence adds.
DOMAINS = ["industrial_process", "rotating_equipment", "manufacturing", "aerospace"]
CONFIDENCE_CAP = 0.85
SERIES_CONFIDENCE = 0.95
TAG_MAPPING = "deterministic_tag_and_column_mapping"


# --- discovery ----------------------------------------------------------------------------------------------------


def domain_hypothesis(datasets: DataFrame) -> DataFrame:
    """One hypothesis per dataset ``(dataset, file_name, families, numeric_columns, has_timestamp, start, end)``."""
    matched = F.array_intersect(F.array_sort("families"), F.array(*map(F.lit, sorted(FAMILIES))))
    hinted = F.size(matched) > 0
    regular = F.col("has_timestamp") & (F.col("numeric_columns") >= 5)
    named = F.lower("file_name").rlike("compress|rotat|rcsd")
    ranged = F.col("start").isNotNull() & F.col("end").isNotNull()

    def points(condition: Column, amount: float) -> Column:
        return F.when(condition, F.lit(amount)).otherwise(F.lit(0.0))

    def statement(condition: Column, strength: str, text: Column) -> Column:
        return F.when(condition, F.struct(text.alias("statement"), F.lit(strength).alias("strength")))

    scores = {
        "industrial_process": points(hinted, 0.55) + points(regular, 0.20) + points(ranged, 0.05),
        "rotating_equipment": points(regular, 0.10) + points(named, 0.25),
        "manufacturing": F.lit(0.0),
        "aerospace": F.lit(0.0),
    }
    ranked = F.array_sort(
        F.array(
            *(
                F.struct((-scores[d]).alias("below"), F.lit(i).alias("place"), F.lit(d).alias("domain"),
                         scores[d].alias("score"))
                for i, d in enumerate(DOMAINS)
            )
        )
    )
    best = F.col("ranked")[0]
    others = F.filter(F.slice("ranked", 2, len(DOMAINS)), lambda r: r["score"] > 0)
    return datasets.withColumn("ranked", ranked).select(
        "dataset",
        F.lit("hypothesis").alias("status"),
        best["domain"].alias("candidate_domain"),
        F.when(best["domain"] == "rotating_equipment", best["domain"]).alias("candidate_subdomain"),
        F.round(F.least(best["score"], F.lit(CONFIDENCE_CAP)), 2).alias("confidence"),
        F.array_compact(
            F.array(
                statement(hinted, "medium", F.concat(
                    F.lit("The dataset contains industrial instrument-tag family hints: "),
                    F.array_join(matched, ", "), F.lit("."))),
                statement(regular, "medium", F.concat(
                    F.lit("The dataset contains "), F.col("numeric_columns").cast("string"),
                    F.lit(" numeric measurement columns organized as timestamped observations."))),
                statement(named, "weak", F.concat(
                    F.lit("The source filename '"), F.col("file_name"),
                    F.lit("' contains a rotating-equipment/compressor-related naming hint."))),
                statement(ranged, "weak", F.lit(
                    "The source contains a continuous time-indexed measurement record.")),
            )
        ).alias("evidence"),
        F.transform(others, lambda r: F.struct(r["domain"].alias("domain"), F.round(r["score"], 2).alias("score")))
        .alias("alternatives"),
    )


def core_classes(spark) -> DataFrame:
    return spark.createDataFrame(
        [(n, None, None, d, "project_universal_core") for n, d in CORE_CLASSES.items()],
        "name string, parent string, confidence double, description string, source string",
    )


def sensor_classes(sensors: DataFrame) -> DataFrame:
    """One candidate class per observed family."""
    family = F.col("tag_family_hint")
    return sensors.where(family.isNotNull() & (family != "")).select(family.alias("tag_family")).distinct().select(
        sensor_class(F.col("tag_family"), F.concat("tag_family", F.lit("Sensor"))).alias("name"),
        F.lit("Sensor").alias("parent"),
        "tag_family",
        F.lit("candidate").alias("status"),
        F.lit(0.70).alias("confidence"),
        F.concat(F.lit("Observed "), "tag_family", F.lit(" industrial instrument-tag family in the dataset.")).alias(
            "evidence"
        ),
    )


def domain_classes(hypotheses: DataFrame) -> DataFrame:
    """Classes that come with the domain or subdomain found."""
    known = hypotheses.sparkSession.createDataFrame(
        DOMAIN_CLASSES, "domain string, name string, parent string, confidence double"
    )
    found = hypotheses.select(
        F.explode(F.array_compact(F.array(
            F.when(F.col("candidate_domain") == "industrial_process", F.col("candidate_domain")),
            F.when(F.col("candidate_subdomain") == "rotating_equipment", F.col("candidate_subdomain")),
        ))).alias("domain")
    ).distinct()
    return known.join(found, "domain", "left_semi").select(
        "name", "parent", "confidence", F.lit("candidate").alias("status")
    )


def ontology_classes(sensors: DataFrame, hypotheses: DataFrame) -> DataFrame:
    """Core, then sensor, then domain classes; a name already taken is skipped."""
    layers = [core_classes(sensors.sparkSession), sensor_classes(sensors), domain_classes(hypotheses)]
    stacked = None
    for i, layer in enumerate(layers):
        layer = layer.withColumn("layer", F.lit(i))
        stacked = layer if stacked is None else stacked.unionByName(layer, allowMissingColumns=True)
    fields = [c for c in stacked.columns if c != "name"]
    first = F.min_by(F.struct(*fields), F.struct("layer", F.coalesce("tag_family", F.lit(""))))
    return stacked.groupBy("name").agg(first.alias("c")).select("name", "c.*")


def orphan_parents(classes: DataFrame) -> DataFrame:
    """Classes whose parent is no class of the ontology."""
    names = classes.select(F.col("name").alias("parent"))
    return classes.where(F.col("parent").isNotNull()).join(names, "parent", "left_anti").select("name", "parent")


def relation_types(spark) -> DataFrame:
    return spark.createDataFrame(RELATION_TYPES, "name string, domain string, range string").select(
        "*", F.lit("candidate").alias("status"), F.lit(True).alias("requires_evidence")
    )


def entity_candidates(sensors: DataFrame) -> DataFrame:
    family = F.col("tag_family_hint")
    return sensors.select(
        F.col("tag").alias("candidate_id"), sensor_class(family).alias("class"), F.col("tag").alias("source_tag"),
        F.lit("candidate").alias("status"), class_confidence(family).alias("confidence"),
    )


# --- entities and relations ---------------------------------------------------------------------------------------


def provenance(
    source_id: Column, sheet: Column, column: Column, method: str, confidence: Column,
    row_start: Column | None = None, row_end: Column | None = None, source_type: str = "xlsx",
) -> Column:
    """Provenance record; the row range is there only if both ends are."""
    start = F.lit(None).cast("bigint") if row_start is None else row_start.cast("bigint")
    end = F.lit(None).cast("bigint") if row_end is None else row_end.cast("bigint")
    rows = F.when(start.isNotNull() & end.isNotNull(), F.struct(start.alias("start"), end.alias("end")))
    return F.struct(
        source_id.alias("source_id"), F.lit(source_type).alias("source_type"),
        F.struct(sheet.alias("sheet"), column.alias("column"), rows.alias("data_rows")).alias("location"),
        F.lit(method).alias("extraction_method"), confidence.alias("confidence"),
    )


def sensor_entities(sensors: DataFrame, source_id: str, sheet: str = "Sheet1") -> DataFrame:
    """Two entities per sensor: the sensor itself and its measurement series."""
    family, tag, rows = F.col("tag_family_hint"), F.col("tag"), F.col("row_count")
    confidence = class_confidence(family)
    origin = provenance(
        F.lit(source_id), F.lit(sheet), tag, TAG_MAPPING, confidence,
        F.when(rows > 0, F.lit(2)), F.when(rows > 0, rows + 1),
    )

    def entity(prefix: str, kind: str, label: Column, name: Column, attributes: list[Column]) -> Column:
        return F.struct(
            knowledge_id(prefix, tag).alias("id"), F.lit(kind).alias("entity_type"), label.alias("label"),
            name.alias("candidate_class"), F.lit("candidate").alias("status"), confidence.alias("confidence"),
            F.struct(*attributes).alias("attributes"), origin.alias("provenance"),
        )

    def attributes(measured: bool) -> list[Column]:
        def only(mine: bool, c: Column, kind: str, name: str) -> Column:
            return (c if mine else F.lit(None)).cast(kind).alias(name)

        return [
            tag.alias("source_tag"),
            only(not measured, family, "string", "tag_family"),
            only(not measured, F.col("data_type"), "string", "data_type"),
            only(not measured, F.col("missing_fraction"), "double", "missing_fraction"),
            only(not measured, F.col("unique_count"), "bigint", "unique_count"),
            only(measured, F.lit("Timestamp"), "string", "timestamp_column"),
            only(measured, rows, "bigint", "row_count"),
        ]

    pair = F.array(
        entity("sensor", "Sensor", tag, sensor_class(family), attributes(False)),
        entity("series", "MeasurementSeries", F.concat(tag, F.lit(" measurement series")), F.lit("Measurement"),
               attributes(True)),
    )
    return sensors.select(F.inline(pair))


def structural_relations(entities: DataFrame) -> DataFrame:
    """INSTANCE_OF its class and HAS_MEASUREMENT its series, for each sensor."""
    source = F.col("id")

    def relation(name: str, target: Column, confidence: Column) -> Column:
        return F.struct(
            knowledge_id("rel", F.concat_ws("|", source, F.lit(name), target)).alias("id"),
            source.alias("source"), F.lit(name).alias("relation"), target.alias("target"),
            F.lit("candidate").alias("status"), confidence.alias("confidence"), F.col("provenance"),
            F.lit("dataset_structure").alias("evidence_type"),
        )

    return entities.where(F.col("entity_type") == "Sensor").select(
        F.inline(
            F.array(
                relation("INSTANCE_OF", F.col("candidate_class"), F.col("confidence")),
                relation("HAS_MEASUREMENT", knowledge_id("series", F.col("attributes.source_tag")),
                         F.lit(SERIES_CONFIDENCE)),
            )
        )
    )


def with_event_ids(events: DataFrame) -> DataFrame:
    """Add ``event_id`` from type, sensor and times; timestamps are written as ISO text with six digits."""
    iso = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
    kinds = dict(events.dtypes)
    parts = [
        F.date_format(c, iso) if kinds[c].startswith("timestamp") else F.col(c)
        for c in ("event_type", "sensor_tag", "start", "end", "timestamp", "peak_timestamp")
    ]
    return events.withColumn("event_id", event_id(*parts))


def first_per_event(events: DataFrame, order: list[str]) -> DataFrame:
    """Keep the first event of each id in the given order."""
    fields = [c for c in events.columns if c != "event_id"]
    return events.groupBy("event_id").agg(F.min_by(F.struct(*fields), F.struct(*order)).alias("e")).select(
        "event_id", "e.*"
    )


def event_reason(events: DataFrame) -> DataFrame:
    """Add ``valid`` and ``reason`` (empty if valid)."""

    def blank(name: str) -> Column:
        c = F.col(name).cast("string")
        return c.isNull() | (c == "")

    reason = (
        F.when(blank("event_type"), "missing event_type")
        .when(blank("sensor_tag"), "missing sensor_tag")
        .when((F.col("event_type") == "statistical_spike") & (blank("start") | blank("end")),
              "spike event missing start/end")
        .when((F.col("event_type") == "change_point_candidate") & blank("timestamp"),
              "change point missing timestamp")
        .otherwise("")
    )
    return events.withColumn("reason", reason).withColumn("valid", F.col("reason") == "")


def resolve_event_sensors(events: DataFrame, entities: DataFrame) -> DataFrame:
    """Attach the sensor entity of each event; ``entity_id`` is null and ``unresolved`` says why if there is none."""
    known = entities.where(F.col("entity_type") == "Sensor").select(
        F.col("attributes.source_tag").alias("sensor_tag"), F.col("id").alias("entity_id")
    )
    checked = event_reason(events).join(known, "sensor_tag", "left")
    unresolved = F.when(~F.col("valid"), F.col("reason")).when(
        F.col("entity_id").isNull(), F.concat(F.lit("no sensor entity for "), F.col("sensor_tag"))
    )
    return checked.withColumn("unresolved", unresolved)


def event_gate(resolved: DataFrame) -> DataFrame:
    """All or nothing: events may be loaded only if every one of them is valid and resolved."""
    bad = F.col("unresolved").isNotNull()
    return resolved.agg(
        F.count("*").alias("events"), F.count_if(bad).alias("rejected"), (F.count_if(bad) == 0).alias("may_load")
    )


# --- validation ---------------------------------------------------------------------------------------------------


def _issue(severity: str, category: str, message: Column | str, object_id: Column) -> Column:
    text = F.lit(message) if isinstance(message, str) else message
    return F.struct(
        F.lit(severity).alias("severity"), F.lit(category).alias("category"), text.alias("message"),
        object_id.alias("object_id"),
    )


def _blank(c: Column) -> Column:
    return c.isNull() | (c == "")


def confidence_issue(confidence: Column, object_id: Column) -> Column:
    """Missing confidence is a warning, one outside [0, 1] an error, else null."""
    return F.when(
        confidence.isNull(), _issue("warning", "confidence", "Confidence is missing.", object_id)
    ).when(
        ~confidence.between(0, 1), _issue("error", "confidence", "Confidence is outside [0, 1].", object_id)
    )


def locate_sources(entities: DataFrame, catalog: DataFrame) -> DataFrame:
    """Add ``path, sheet_known, column_known, max_row`` from the catalog ``(file, sheet, column, max_row)``.

    A source is found by its exact path, else by its file name (the first path in order).
    """

    def base(c: Column) -> Column:
        return F.element_at(F.split(c, "/"), -1)

    files = catalog.select(F.col("file").alias("path")).distinct()
    wanted = entities.select(F.col("provenance.source_id").alias("wanted")).where("wanted is not null").distinct()
    by_name = files.groupBy(base(F.col("path")).alias("name")).agg(F.min("path").alias("named"))
    resolved = (
        wanted.join(files.withColumnRenamed("path", "exact"), F.col("wanted") == F.col("exact"), "left")
        .join(by_name, base(F.col("wanted")) == F.col("name"), "left")
        .select("wanted", F.coalesce("exact", "named").alias("path"))
    )
    sheets = catalog.groupBy(F.col("file").alias("s_path"), F.col("sheet").alias("s_sheet")).agg(
        F.max("max_row").alias("max_row")
    )
    columns = catalog.select(
        F.col("file").alias("c_path"), F.col("sheet").alias("c_sheet"), F.col("column").alias("c_column")
    ).distinct()
    sheet, column = F.col("provenance.location.sheet"), F.col("provenance.location.column")
    return (
        entities.join(resolved, F.col("provenance.source_id") == F.col("wanted"), "left")
        .join(sheets, (F.col("path") == F.col("s_path")) & (sheet == F.col("s_sheet")), "left")
        .join(columns, (F.col("path") == F.col("c_path")) & (sheet == F.col("c_sheet")) & (column == F.col("c_column")),
              "left")
        .withColumn("sheet_known", F.col("s_sheet").isNotNull())
        .withColumn("column_known", F.col("c_column").isNotNull())
        .drop("wanted", "s_path", "s_sheet", "c_path", "c_sheet", "c_column")
    )


def validate_entities(entities: DataFrame, catalog: DataFrame) -> DataFrame:
    """Add ``issues`` in order of the checks and ``validation_status``; some failures end the checks of an entity."""
    origin = F.col("provenance")
    rows = F.col("provenance.location.data_rows")
    object_id = F.col("id")
    has_id, has_origin, found = ~_blank(object_id), origin.isNotNull(), F.col("path").isNotNull()
    past_origin = has_id & has_origin
    past_source = past_origin & found
    past_sheet = past_source & F.col("sheet_known")
    past_column = past_sheet & F.col("column_known")
    bad_range = rows.isNotNull() & (
        rows["start"].isNull() | rows["end"].isNull() | (rows["start"] < 2) | (rows["end"] < rows["start"])
    )
    too_long = rows.isNotNull() & ~bad_range & (rows["end"] > F.col("max_row"))

    def when(condition: Column, severity: str, category: str, message: Column | str) -> Column:
        return F.when(condition, _issue(severity, category, message, object_id))

    issues = F.array_compact(
        F.array(
            F.when(~has_id, _issue("error", "entity_schema", "no id",
                                   F.lit(None).cast("string"))),
            when(has_id & _blank(F.col("entity_type")), "error", "entity_schema", "field entity_type is blank"),
            when(has_id & ~has_origin, "error", "provenance", "field provenance is null"),
            when(past_origin & _blank(origin["source_id"]), "error", "provenance", "provenance names no source_id"),
            when(past_origin & _blank(origin["location"]["sheet"]), "error", "provenance",
                 "location names no sheet"),
            when(past_origin & _blank(origin["location"]["column"]), "error", "provenance",
                 "location names no column"),
            F.when(past_origin, confidence_issue(origin["confidence"], object_id)),
            when(past_origin & ~found, "warning", "source_file", "source not in the catalog"),
            when(past_source & ~F.col("sheet_known"), "error", "sheet", "sheet not in the source"),
            when(past_sheet & ~F.col("column_known"), "error", "column", "column not in the sheet"),
            when(past_column & bad_range, "error", "row_range", "first data row after the last"),
            when(past_column & too_long, "error", "row_range", "data rows beyond the sheet"),
        )
    )
    valid = past_column & ~F.coalesce(bad_range, F.lit(False)) & ~F.coalesce(too_long, F.lit(False))
    return (
        locate_sources(entities, catalog)
        .withColumn("issues", issues)
        .withColumn("validation_status", F.when(valid, "source_validated").otherwise("needs_review"))
        .drop("path", "sheet_known", "column_known", "max_row")
    )


def relation_endpoints(
    relations: DataFrame, entities: DataFrame, classes: DataFrame | None = None
) -> DataFrame:
    """Add ``source_ok`` and ``target_ok``: the endpoint is an entity id or a class name.

    Without ``classes`` every non-empty target counts as a class name, so only sources can be unknown.
    """
    ids = entities.where(~_blank(F.col("id"))).select(F.col("id").alias("known"))
    targets = relations.where(~_blank(F.col("target"))).select(F.col("target").alias("known"))
    names = targets if classes is None else classes.select(F.col("name").alias("known"))
    known = staged(ids.unionByName(names).distinct(), "known-ids")
    # One sensor or class may be an end of very many relations: its rows are dealt over tasks.
    own = staged(relations, "relations")
    told = F.lit(True)
    sources = known.select(F.col("known").alias("source"), told.alias("source_ok"))
    out = split_join(own, sources, ["source"], "left", counted=own)
    if classes is None:
        target_ok = ~_blank(F.col("target"))
    else:
        targets = known.select(F.col("known").alias("target"), told.alias("target_found"))
        out = split_join(out, targets, ["target"], "left", spread=relations.columns, counted=own)
        target_ok = F.coalesce("target_found", F.lit(False))
    return out.withColumn("source_ok", F.coalesce("source_ok", F.lit(False))).withColumn(
        "target_ok", target_ok
    ).drop("target_found")


def validate_relations(
    relations: DataFrame, entities: DataFrame, classes: DataFrame | None = None
) -> DataFrame:
    """Add ``issues`` and ``validation_status``; pass ``classes`` to have unknown targets reported."""
    object_id, origin = F.col("id"), F.col("provenance")
    has_id = ~_blank(object_id)

    def when(condition: Column, category: str, message: Column | str) -> Column:
        return F.when(has_id & condition, _issue("error", category, message, object_id))

    issues = F.array_compact(
        F.array(
            F.when(~has_id, _issue("error", "relation_schema", "no id",
                                   F.lit(None).cast("string"))),
            when(_blank(F.col("source")), "relation_schema", "field source is blank"),
            when(_blank(F.col("relation")), "relation_schema", "field relation is blank"),
            when(_blank(F.col("target")), "relation_schema", "field target is blank"),
            when(origin.isNull(), "provenance", "field provenance is null"),
            F.when(has_id & origin.isNotNull(), confidence_issue(origin["confidence"], object_id)),
            when(~F.col("source_ok"), "relation_endpoint",
                 F.concat(F.lit("source is no known id: "), F.coalesce("source", F.lit("null")))),
            when(~F.col("target_ok"), "relation_endpoint",
                 F.concat(F.lit("target is no known id: "), F.coalesce("target", F.lit("null")))),
        )
    )
    valid = (
        has_id & ~_blank(F.col("source")) & ~_blank(F.col("target")) & ~_blank(F.col("relation"))
        & origin.isNotNull() & F.col("source_ok") & F.col("target_ok")
    )
    return (
        relation_endpoints(relations, entities, classes)
        .withColumn("issues", issues)
        .withColumn("validation_status", F.when(valid, "structurally_validated").otherwise("needs_review"))
    )


def validation_report(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """One row of totals over validated entities and relations; passed if there is no error."""

    def count(severity: str) -> Column:
        return F.sum(F.size(F.filter("issues", lambda i: i["severity"] == severity)))

    both = entities.select(F.lit("entity").alias("kind"), "validation_status", "issues").unionByName(
        relations.select(F.lit("relation").alias("kind"), "validation_status", "issues")
    )
    totals = both.agg(
        F.count_if(F.col("kind") == "entity").alias("entities_total"),
        F.count_if(F.col("validation_status") == "source_validated").alias("entities_source_validated"),
        F.count_if(F.col("kind") == "relation").alias("relations_total"),
        F.coalesce(count("error"), F.lit(0)).alias("errors"),
        F.coalesce(count("warning"), F.lit(0)).alias("warnings"),
    )
    clean = F.col("errors") == 0
    return totals.select(
        "*",
        F.when(clean, "passed").otherwise("needs_review").alias("status"),
        F.when(clean, "knowledge_graph_build").otherwise("fix_validation_errors").alias("next_stage"),
    )


def payload_check(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """Structural faults as ``(rule, faults)``; a loader must stop if any count is over zero."""
    ids = entities.where(~_blank(F.col("id"))).select(F.col("id").alias("source")).distinct()
    unknown = relations.where(F.col("relation") != "INSTANCE_OF").join(ids, "source", "left_anti")

    def as_rows(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
        counted = df.agg(*(F.count_if(c).alias(r) for r, c in rules.items()))
        return counted.unpivot([], list(rules), "rule", "faults")

    return (
        as_rows(entities, {
            "entity_missing_id": _blank(F.col("id")), "entity_missing_type": _blank(F.col("entity_type")),
        })
        .unionByName(as_rows(relations, {
            "relation_missing_id": _blank(F.col("id")), "relation_missing_source": _blank(F.col("source")),
            "relation_missing_target": _blank(F.col("target")), "relation_missing_type": _blank(F.col("relation")),
        }))
        .unionByName(as_rows(unknown, {"relation_unknown_source": ~_blank(F.col("source"))}))
    )


def provenance_index(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """Flat provenance of every entity and relation."""

    def flat(df: DataFrame, kind: str) -> DataFrame:
        where = F.col("provenance.location")
        return df.select(
            F.lit(kind).alias("kind"), F.col("id").alias("object_id"),
            F.col("provenance.source_id").alias("source_id"), F.col("provenance.source_type").alias("source_type"),
            where["sheet"].alias("source_sheet"), where["column"].alias("source_column"),
            where["data_rows"]["start"].alias("source_row_start"), where["data_rows"]["end"].alias("source_row_end"),
            F.col("provenance.extraction_method").alias("extraction_method"), "confidence", "status",
        )

    return flat(entities, "entity").unionByName(flat(relations, "relation"))
