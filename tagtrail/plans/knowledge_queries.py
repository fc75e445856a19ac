"""Registered queries over entities, relations, events and the graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagtrail.functions.tags import FAMILIES, SENSOR_CLASSES, class_confidence, family_by_pattern, sensor_class
from tagtrail.operators import graph, knowledge as kg, package, retrieval
from tagtrail.plans import bindings as b
from tagtrail.operators.documents import mention_edges, mentioned_entities, mentions
from tagtrail.plans.registry import query
from tagtrail.session import staged
from tagtrail.sources import keyed_table, sinks

SOURCE = "plant.xlsx"
CLASS_CASE = "case {0} " + " ".join(f"when '{f}' then '{c}'" for f, c in SENSOR_CLASSES.items()) + " else {1} end"
ORIGIN = ["source_id", "source_type", "source_sheet", "source_column", "source_row_start", "source_row_end",
          "extraction_method"]

b.SQL["ents"] = f"""select concat('sensor_', substring(sha1(tag), 1, 12)) as id, 'Sensor' as entity_type, tag as label,
    {CLASS_CASE.format('family', "'Sensor'")} as candidate_class, 'candidate' as status,
    case when family is null then 0.4 else 0.7 end::double as confidence, tag as source_tag, family as tag_family,
    'double' as data_type, 0.0::double as missing_fraction, unique_count, cast(null as varchar) as timestamp_column,
    cast(null as bigint) as row_count, '{SOURCE}' as source_id, 'xlsx' as source_type, 'Sheet1' as source_sheet,
    tag as source_column, 2::bigint as source_row_start, row_count + 1 as source_row_end,
    'deterministic_tag_and_column_mapping' as extraction_method, user_id from sensors
  union all select concat('series_', substring(sha1(tag), 1, 12)), 'MeasurementSeries', concat(tag, ' measurement series'),
    'Measurement', 'candidate', case when family is null then 0.4 else 0.7 end, tag, null, null, null, null, 'Timestamp',
    row_count, '{SOURCE}', 'xlsx', 'Sheet1', tag, 2, row_count + 1, 'deterministic_tag_and_column_mapping', user_id
    from sensors"""
b.NEEDS["ents"] = ["sensors"]
b.SQL["rels"] = """select concat('rel_', substring(sha1(concat(source, '|', relation, '|', target)), 1, 12)) as id, *,
    'candidate' as status, 'dataset_structure' as evidence_type from (
  select id as source, 'INSTANCE_OF' as relation, candidate_class as target, confidence, source_id, source_type,
    source_sheet, source_column, source_row_start, source_row_end, extraction_method, user_id from ents
    where entity_type = 'Sensor'
  union all select id, 'HAS_MEASUREMENT', concat('series_', substring(sha1(source_tag), 1, 12)), 0.95::double, source_id,
    source_type, source_sheet, source_column, source_row_start, source_row_end, extraction_method, user_id from ents
    where entity_type = 'Sensor')"""
b.NEEDS["rels"] = ["ents"]
# Entities with one planted fault in ten of eleven users.
b.SQL["faulty"] = """select case when f = 1 then null else id end as id, case when f = 2 then '' else entity_type end as
  entity_type, f <> 3 as has_provenance, case when f = 4 then 'missing.xlsx' else source_id end as source_id,
  case when f = 5 then 'Other' else source_sheet end as sheet, case when f = 6 then 'nope' else source_column end as col,
  case when f = 7 then 1 else source_row_start end as row_start,
  case when f = 8 then 1000000000000 else source_row_end end as row_end,
  case when f = 9 then null when f = 10 then 1.5 else confidence end as confidence, source_tag, kind
  from (select *, user_id % 11 as f, entity_type as kind from ents)"""
b.NEEDS["faulty"] = ["ents"]
b.SQL["checked"] = """select *, case when id is null then 'error:entity_schema' else concat_ws(',',
    case when entity_type = '' then 'error:entity_schema' end,
    case when not has_provenance then 'error:provenance' else nullif(concat_ws(',',
      case when confidence is null then 'warning:confidence' when confidence > 1 then 'error:confidence' end,
      case when source_id <> 'plant.xlsx' then 'warning:source_file' when sheet <> 'Sheet1' then 'error:sheet'
        when col <> source_tag then 'error:column' when row_start < 2 then 'error:row_range'
        when row_end > (select max(row_count) + 1 from sensors) then 'error:row_range' end), '') end) end as issues,
  case when id is not null and has_provenance and source_id = 'plant.xlsx' and sheet = 'Sheet1' and col = source_tag
    and row_start >= 2 and row_end <= (select max(row_count) + 1 from sensors) then 'source_validated'
    else 'needs_review' end as validation_status from faulty"""
b.NEEDS["checked"] = ["faulty"]
b.SQL["faulty_rels"] = """select case when f = 1 then null else id end as id, case when f = 2 then '' when f = 8 then
    'ghost' else source end as source,
  case when f = 3 then null when f = 9 then ' has_measurement ' when f = 10 then 'CAUSES' else relation end as relation,
  case when f = 4 then '' when f = 5 then 'Unheard' else target end as target, f <> 6 as has_provenance,
  case when f = 7 then -0.5 else entity_confidence end as confidence, source_tag, kind
  from (select r.*, r.user_id % 11 as f, r.relation as kind, r.source_column as source_tag,
    case when tag_family is null then 0.4 else 0.7 end as entity_confidence from rels r join ents e on e.id = r.source)"""
b.NEEDS["faulty_rels"] = ["rels"]


def entities(spark, d):
    return kg.sensor_entities(b.sensors(spark, d), SOURCE)


def relations(spark, d):
    return kg.structural_relations(entities(spark, d))


def source_catalog(spark, d):
    rows = b.sensors(spark, d)
    largest = rows.agg(F.max("row_count") + 1).scalar()
    return rows.select(
        F.lit(f"raw/{SOURCE}").alias("file"), F.lit("Sheet1").alias("sheet"), F.col("tag").alias("column"),
    ).withColumn("max_row", largest)


def fault(tag):
    return (F.regexp_extract(tag, r"(\d+)\.pv$", 1).cast("int") - 800) % 11


def faulty_entities(spark, d):
    f, origin, null = fault(F.col("attributes.source_tag")), F.col("provenance"), F.lit(None)
    where, rows = origin["location"], origin["location"]["data_rows"]
    changed = F.struct(
        F.when(f == 4, "missing.xlsx").otherwise(origin["source_id"]).alias("source_id"),
        origin["source_type"].alias("source_type"),
        F.struct(
            F.when(f == 5, "Other").otherwise(where["sheet"]).alias("sheet"),
            F.when(f == 6, "nope").otherwise(where["column"]).alias("column"),
            F.struct(
                F.when(f == 7, 1).otherwise(rows["start"]).alias("start"),
                F.when(f == 8, 1_000_000_000_000).otherwise(rows["end"]).alias("end"),
            ).alias("data_rows"),
        ).alias("location"),
        origin["extraction_method"].alias("extraction_method"),
        F.when(f == 9, null).when(f == 10, 1.5).otherwise(origin["confidence"]).alias("confidence"),
    )
    return entities(spark, d).withColumns(
        {
            "kind": F.col("entity_type"), "source_tag": F.col("attributes.source_tag"),
            "id": F.when(f != 1, F.col("id")), "entity_type": F.when(f == 2, "").otherwise(F.col("entity_type")),
            "provenance": F.when(f != 3, changed),
        }
    )


def faulty_relations(spark, d):
    tag, origin = F.col("provenance.location.column"), F.col("provenance")
    f = fault(tag)
    changed = F.when(f == 7, origin.withField("confidence", F.lit(-0.5))).when(f != 6, origin)
    return relations(spark, d).withColumns(
        {
            "kind": F.col("relation"), "source_tag": tag,
            "id": F.when(f != 1, F.col("id")),
            "source": F.when(f == 2, "").when(f == 8, "ghost").otherwise(F.col("source")),
            "relation": F.when(f == 9, " has_measurement ").when(f == 10, "CAUSES").when(f != 3, F.col("relation")),
            "target": F.when(f == 4, "").when(f == 5, "Unheard").otherwise(F.col("target")),
            "provenance": changed,
        }
    )


def issue_names(column="issues"):
    return F.array_join(F.transform(column, lambda i: F.concat_ws(":", i["severity"], i["category"])), ",")


# --- discovery ----------------------------------------------------------------------------------------------------

DATASETS_SQL = r"""datasets as (select user_id % 25 as dataset, concat(case (user_id % 25) % 3 when 0 then 'Compressor_'
    when 1 then 'rotary-' else 'plain' end, cast(user_id % 25 as varchar), '.csv') as file_name,
  case when (user_id % 25) % 4 = 0 then [] else list_sort(list(distinct regexp_extract(upper(tag),
    '\d+(PDI|PI|TI|XI|ZI|SI)', 1))) end as families, count(distinct tag) as numeric_columns,
  (user_id % 25) % 5 <> 0 as has_timestamp, min(ts) as "start", case when (user_id % 25) % 7 <> 0 then max(ts) end as "end"
  from read150 group by user_id % 25),
points as (select *, len(families) > 0 as hinted, has_timestamp and numeric_columns >= 5 as regular,
  regexp_matches(lower(file_name), 'compress|rotat|rcsd') as named, "start" is not null and "end" is not null as ranged
  from datasets),
scored as (select *, (case when hinted then 0.55 else 0 end)::double + (case when regular then 0.2 else 0 end)::double
  + (case when ranged then 0.05 else 0 end)::double as process,
  (case when regular then 0.1 else 0 end)::double + (case when named then 0.25 else 0 end)::double as rotating from points)"""


def datasets(spark, d):
    ds = (F.col("user_id") % 25).alias("dataset")
    k = F.col("dataset")
    r = b.read150(spark, d)
    return (
        r.groupBy(ds)
        .agg(
            F.collect_set(family_by_pattern(F.col("tag"))).alias("families"), F.countDistinct("tag").alias("numeric_columns"),
            F.min("ts").alias("start"), F.max("ts").alias("end"),
        )
        .withColumns(
            {
                "file_name": F.concat(
                    F.when(k % 3 == 0, "Compressor_").when(k % 3 == 1, "rotary-").otherwise("plain"),
                    k.cast("string"), F.lit(".csv"),
                ),
                "families": F.when(k % 4 == 0, F.array().cast("array<string>")).otherwise(F.col("families")),
                "has_timestamp": k % 5 != 0,
                "end": F.when(k % 7 != 0, F.col("end")),
            }
        )
    )


@query("agg_domain_scores", b.ctes("read150").rstrip() + ", " + DATASETS_SQL + """ select dataset,
  case when rotating > process then 'rotating_equipment' else 'industrial_process' end as candidate_domain,
  case when rotating > process then 'rotating_equipment' end as candidate_subdomain,
  round(least(greatest(process, rotating), 0.85::double), 2) as confidence,
  concat_ws('; ', case when hinted then concat('medium: The dataset contains industrial instrument-tag family hints: ',
    array_to_string(families, ', '), '.') end, case when regular then concat('medium: The dataset contains ',
    cast(numeric_columns as varchar), ' numeric measurement columns organized as timestamped observations.') end,
    case when named then concat('weak: The source filename ''', file_name,
    ''' contains a rotating-equipment/compressor-related naming hint.') end,
    case when ranged then 'weak: The source contains a continuous time-indexed measurement record.' end) as evidence,
  case when rotating > process and process > 0 then concat('industrial_process=', cast(round(process, 2) as varchar))
    when rotating <= process and rotating > 0 then concat('rotating_equipment=', cast(round(rotating, 2) as varchar))
    else '' end as alternatives from scored""")
def agg_domain_scores(spark, d):
    return kg.domain_hypothesis(datasets(spark, d)).select(
        "dataset", "candidate_domain", "candidate_subdomain", "confidence",
        F.array_join(F.transform("evidence", lambda e: F.concat_ws(": ", e["strength"], e["statement"])), "; ").alias(
            "evidence"
        ),
        F.array_join(
            F.transform("alternatives", lambda a: F.concat_ws("=", a["domain"], a["score"].cast("string"))), ","
        ).alias("alternatives"),
    )


@query("set_family_intersection", b.ctes("read150").rstrip() + ", " + DATASETS_SQL
       + " select dataset, array_to_string(families, ',') as matched from datasets")
def set_family_intersection(spark, d):
    known = F.array_sort(F.array_intersect("families", F.array(*map(F.lit, FAMILIES))))
    return datasets(spark, d).select("dataset", F.array_join(known, ",").alias("matched"))


@query("prj_sensor_class", b.ctes("sensors") + f"""select tag, {CLASS_CASE.format('family', "'Sensor'")} as sensor_class,
  case when family is null then 0.4 else 0.7 end::double as confidence from (select tag, case when user_id % 10 = 0 then
  null when user_id % 10 = 1 then 'ZZ' else family end as family from sensors)""")
def prj_sensor_class(spark, d):
    ten = F.col("user_id") % 10
    family = F.when(ten == 1, "ZZ").when(ten != 0, F.col("tag_family_hint"))
    return b.sensors(spark, d).select(
        "tag", sensor_class(family).alias("sensor_class"), class_confidence(family).alias("confidence")
    )


FAMILY_CLASS = CLASS_CASE.format("family", "concat(family, 'Sensor')")
MIXED_SENSORS_SQL = "mixed as (select tag, case when user_id % 10 = 1 then 'ZZ' else family end as family from sensors)"


def mixed_sensors(spark, d):
    odd = F.when(F.col("user_id") % 10 == 1, "ZZ").otherwise(F.col("tag_family_hint"))
    return b.sensors(spark, d).withColumn("tag_family_hint", odd)


@query("agg_sensor_classes", b.ctes("sensors").rstrip() + ", " + MIXED_SENSORS_SQL + f""" select {FAMILY_CLASS} as name,
  'Sensor' as parent, family as tag_family, 'candidate' as status, 0.7::double as confidence, concat('Observed ', family,
  ' industrial instrument-tag family in the dataset.') as evidence from (select distinct family from mixed
  where family is not null)""")
def agg_sensor_classes(spark, d):
    return kg.sensor_classes(mixed_sensors(spark, d))


CORE_VALUES = ", ".join(f"('{n}')" for n in kg.CORE_CLASSES)


@query("kg_ontology", b.ctes("read150", "sensors").rstrip() + ", " + MIXED_SENSORS_SQL + ", " + DATASETS_SQL + f""",
  hyp as (select dataset, case when rotating > process then 'rotating_equipment' else 'industrial_process' end as dom from scored),
  layered as (select name, cast(null as varchar) as parent, cast(null as double) as confidence, 0 as layer
    from (values {CORE_VALUES}) t(name)
  union all select {FAMILY_CLASS}, 'Sensor', 0.7, 1 from (select distinct family from mixed where family is not null)
  union all select name, parent, confidence, 2 from (values {", ".join(str(c) for c in kg.DOMAIN_CLASSES)})
    t(domain, name, parent, confidence) where domain in (select dom from hyp)),
  classes as (select name, parent, confidence from layered qualify row_number() over (partition by name order by layer) = 1)
  select 'class' as kind, name, parent as a, cast(confidence as double) as confidence, parent is not null and parent not in
    (select name from classes) as orphan from classes
  union all select 'relation', name, concat(domain, '>', range), null, false from (values
    {", ".join(str(r) for r in kg.RELATION_TYPES)}) t(name, domain, range)
  union all select 'entity', tag, {CLASS_CASE.format('family', "'Sensor'")}, case when family is null then 0.4 else 0.7 end,
    false from mixed""")
def kg_ontology(spark, d):
    sensors = mixed_sensors(spark, d)
    classes = kg.ontology_classes(sensors, kg.domain_hypothesis(datasets(spark, d)))
    orphans = kg.orphan_parents(classes).select("name", F.lit(True).alias("orphan"))
    null = F.lit(None).cast("double")
    return (
        classes.join(orphans, "name", "left")
        .select(F.lit("class").alias("kind"), "name", F.col("parent").alias("a"), "confidence",
                F.coalesce("orphan", F.lit(False)).alias("orphan"))
        .unionByName(kg.relation_types(spark).select(
            F.lit("relation").alias("kind"), "name", F.concat_ws(">", "domain", "range").alias("a"),
            null.alias("confidence"), F.lit(False).alias("orphan")))
        .unionByName(kg.entity_candidates(sensors).select(
            F.lit("entity").alias("kind"), F.col("candidate_id").alias("name"), F.col("class").alias("a"), "confidence",
            F.lit(False).alias("orphan")))
    )


# --- entities and relations ---------------------------------------------------------------------------------------


@query("kg_entities", b.ctes("ents") + "select * exclude (user_id) from ents")
def kg_entities(spark, d):
    out = entities(spark, d)
    return out.select(
        "id", "entity_type", "label", "candidate_class", "status", "confidence", "attributes.*", *graph._origin()
    )


@query("kg_relations", b.ctes("rels") + "select id, source, relation, target, status, confidence, evidence_type, source_column from rels")
def kg_relations(spark, d):
    return relations(spark, d).select(
        "id", "source", "relation", "target", "status", "confidence", "evidence_type",
        F.col("provenance.location.column").alias("source_column"),
    )


@query("fn_provenance", b.ctes("sensors") + """select tag, 'plant.xlsx' as source_id, 'xlsx' as source_type, tag as col,
  case when row_count % 2 = 0 then 2::bigint end as row_start, case when row_count % 2 = 0 then row_count + 1 end as row_end,
  row_count % 2 = 0 as has_rows from sensors""")
def fn_provenance(spark, d):
    even = F.col("row_count") % 2 == 0
    record = kg.provenance(
        F.lit(SOURCE), F.lit("Sheet1"), F.col("tag"), "mapping", F.lit(0.7), F.lit(2), F.when(even, F.col("row_count") + 1)
    )
    out = b.sensors(spark, d).select("tag", record.alias("p"))
    rows = F.col("p.location.data_rows")
    return out.select(
        "tag", "p.source_id", "p.source_type", F.col("p.location.column").alias("col"), rows["start"].alias("row_start"),
        rows["end"].alias("row_end"), rows.isNotNull().alias("has_rows"),
    )


@query("fn_confidence_check", """select event_id, case when c is null then 'warning' when c < 0 or c > 1 then 'error' end
  as severity from (select event_id, case when event_id % 5 = 0 then null else value / 100 - 0.1 end as c from events)""")
def fn_confidence_check(spark, d):
    c = F.when(F.col("event_id") % 5 != 0, F.col("value") / 100 - 0.1)
    return b.table(spark, d, "events").select(
        "event_id", kg.confidence_issue(c, F.col("event_id").cast("string"))["severity"].alias("severity")
    )


@query("prj_node_properties", b.ctes("faulty") + """select source_tag, kind, coalesce(id, '-') as id,
  coalesce(case when confidence is null then null else concat(source_tag, case when kind = 'Sensor' then '' else
  ' measurement series' end) end, id) as label, entity_type, coalesce(case when has_provenance then source_id end, '-')
  as source_id, case when has_provenance then sheet end as source_sheet, case when has_provenance then col end as source_column,
  case when has_provenance then row_start end as source_row_start, case when has_provenance then row_end end as source_row_end
  from faulty""")
def prj_node_properties(spark, d):
    found = faulty_entities(spark, d)
    nine = fault(F.col("source_tag")) == 9
    found = found.withColumn("label", F.when(~nine, F.col("label")))
    keep = graph.node_properties(found.withColumn("id", F.concat_ws("|", "source_tag", "kind", F.coalesce("id", F.lit("-")))))
    part = F.split("id", r"\|")
    return keep.select(
        part[0].alias("source_tag"), part[1].alias("kind"), part[2].alias("id"),
        F.when(F.col("label").contains("|"), part[2]).otherwise(F.col("label")).alias("label"), "entity_type",
        F.coalesce("source_id", F.lit("-")).alias("source_id"), "source_sheet", "source_column", "source_row_start",
        "source_row_end",
    )


@query("prj_edge_properties", b.ctes("rels") + """select id, status, case when user_id % 11 = 3 then 0.0 else confidence
  end::double as confidence, evidence_type, source_id, source_type, source_sheet, source_column, source_row_start,
  source_row_end, extraction_method from rels""")
def prj_edge_properties(spark, d):
    three = fault(F.col("provenance.location.column")) == 3
    found = relations(spark, d).withColumn("confidence", F.when(~three, F.col("confidence")))
    return graph.edge_properties(found.withColumn("status", F.when(~three, F.col("status"))))


@query("flt_edge_type", b.ctes("faulty_rels") + """select source_tag, kind, upper(trim(relation)) as edge_type,
  coalesce(upper(trim(relation)) in ('INSTANCE_OF', 'HAS_MEASUREMENT', 'HAS_COMPONENT', 'HAS_SUBSYSTEM', 'MONITORED_BY',
  'MEASURES', 'HAS_CONDITION', 'DOCUMENTED_BY', 'RELATED_TO', 'HAS_MAINTENANCE'), false) as accepted from faulty_rels""")
def flt_edge_type(spark, d):
    return graph.check_edge_types(faulty_relations(spark, d)).select("source_tag", "kind", "edge_type", "accepted")


# --- validation ---------------------------------------------------------------------------------------------------


@query("join_provenance_lookup", b.ctes("faulty") + """select source_tag, kind, source_id = 'plant.xlsx' as found,
  source_id = 'plant.xlsx' and sheet = 'Sheet1' as sheet_known,
  source_id = 'plant.xlsx' and sheet = 'Sheet1' and col = source_tag as column_known,
  case when source_id = 'plant.xlsx' and sheet = 'Sheet1' then (select max(row_count) + 1 from sensors) end as max_row
  from faulty where has_provenance""")
def join_provenance_lookup(spark, d):
    found = kg.locate_sources(faulty_entities(spark, d).where("provenance is not null"), source_catalog(spark, d))
    return found.select(
        "source_tag", "kind", F.col("path").isNotNull().alias("found"), "sheet_known", "column_known", "max_row"
    )


@query("kg_validate_entities", b.ctes("checked") + "select source_tag, kind, issues, validation_status from checked")
def kg_validate_entities(spark, d):
    checked = kg.validate_entities(faulty_entities(spark, d), source_catalog(spark, d))
    return checked.select("source_tag", "kind", issue_names().alias("issues"), "validation_status")


RELATION_CHECK = """relchecked as (select *, coalesce(source in (select id from faulty where id is not null) or source in
    ({known}), false) and source <> '' as source_ok, {target} as target_ok from faulty_rels)"""
LOOSE = RELATION_CHECK.format(known="select target from faulty_rels where target <> ''", target="target <> ''")
CLASS_NAMES = "select distinct candidate_class from ents where entity_type = 'Sensor'"
STRICT = RELATION_CHECK.format(known=CLASS_NAMES, target=f"target in (select id from faulty where id is not null) "
                               f"or target in ({CLASS_NAMES})")
RELATION_ISSUES = """case when id is null then 'error:relation_schema' else concat_ws(',',
  case when source = '' then 'error:relation_schema' end, case when relation is null then 'error:relation_schema' end,
  case when target = '' then 'error:relation_schema' end, case when not has_provenance then 'error:provenance'
    when confidence < 0 then 'error:confidence' end,
  case when not source_ok then 'error:relation_endpoint' end, case when not target_ok then 'error:relation_endpoint' end) end
  as issues, case when id is not null and source <> '' and target <> '' and relation is not null and has_provenance and source_ok
  and target_ok then 'structurally_validated' else 'needs_review' end as validation_status"""


@query("join_relation_endpoints", b.ctes("faulty", "faulty_rels").rstrip() + ", " + STRICT
       + " select source_tag, kind, source_ok, target_ok from relchecked")
def join_relation_endpoints(spark, d):
    classes = entities(spark, d).where("entity_type = 'Sensor'").select(F.col("candidate_class").alias("name")).distinct()
    found = kg.relation_endpoints(faulty_relations(spark, d), faulty_entities(spark, d), classes)
    return found.select("source_tag", "kind", "source_ok", "target_ok")


@query("kg_validate_relations", b.ctes("faulty", "faulty_rels").rstrip() + ", " + LOOSE
       + f" select source_tag, kind, {RELATION_ISSUES} from relchecked")
def kg_validate_relations(spark, d):
    checked = kg.validate_relations(faulty_relations(spark, d), faulty_entities(spark, d))
    return checked.select("source_tag", "kind", issue_names().alias("issues"), "validation_status")


@query("agg_validation_report", b.ctes("checked", "faulty_rels").rstrip() + ", " + LOOSE + f""",
  every as (select 'e' as k, validation_status, issues from checked union all select 'r', validation_status, issues from
    (select {RELATION_ISSUES} from relchecked)),
  tot as (select count(*) filter (k = 'e') as entities_total, count(*) filter (validation_status = 'source_validated') as
    entities_source_validated, count(*) filter (k = 'r') as relations_total,
    sum(len(regexp_extract_all(issues, 'error:')))::bigint as errors,
    sum(len(regexp_extract_all(issues, 'warning:')))::bigint as warnings from every)
  select *, case when errors = 0 then 'passed' else 'needs_review' end as status, case when errors = 0 then
    'knowledge_graph_build' else 'fix_validation_errors' end as next_stage from tot""")
def agg_validation_report(spark, d):
    checked = kg.validate_entities(faulty_entities(spark, d), source_catalog(spark, d))
    return kg.validation_report(checked, kg.validate_relations(faulty_relations(spark, d), faulty_entities(spark, d)))


@query("kg_payload_check", b.ctes("faulty", "faulty_rels") + """select 'entity_missing_id' as rule, count(*) filter (id is null)
    as faults from faulty
  union all select 'entity_missing_type', count(*) filter (entity_type = '') from faulty
  union all select 'relation_missing_id', count(*) filter (id is null) from faulty_rels
  union all select 'relation_missing_source', count(*) filter (source = '') from faulty_rels
  union all select 'relation_missing_target', count(*) filter (target = '') from faulty_rels
  union all select 'relation_missing_type', count(*) filter (relation is null) from faulty_rels
  union all select 'relation_unknown_source', count(*) filter (source <> '' and relation <> 'INSTANCE_OF' and source not in
    (select id from faulty where id is not null)) from faulty_rels""")
def kg_payload_check(spark, d):
    return kg.payload_check(faulty_entities(spark, d), faulty_relations(spark, d))


@query("kg_provenance_index", b.ctes("ents", "rels") + "select 'entity' as kind, id as object_id, " + ", ".join(ORIGIN)
       + ", confidence, status from ents union all select 'relation', id, " + ", ".join(ORIGIN) + ", confidence, status from rels")
def kg_provenance_index(spark, d):
    return kg.provenance_index(entities(spark, d), relations(spark, d))


# --- events -------------------------------------------------------------------------------------------------------

b.SQL["mixed_events"] = """select case when user_id % 13 = 1 then '' else event_type end as event_type,
  case when user_id % 13 = 2 then null when user_id % 13 = 3 then 'unknown.pv' else sensor_tag end as sensor_tag,
  case when user_id % 13 = 4 then null else "start" end as "start", "end",
  case when user_id % 13 = 5 then null else timestamp end as timestamp, event_id, user_id from detected"""
b.NEEDS["mixed_events"] = ["detected"]
REASON = """case when event_type = '' then 'missing event_type' when sensor_tag is null then 'missing sensor_tag'
  when event_type = 'statistical_spike' and ("start" is null or "end" is null) then 'spike event missing start/end'
  when event_type = 'change_point_candidate' and timestamp is null then 'change point missing timestamp' else '' end"""


def mixed_events(spark, d):
    k = F.col("user_id") % 13
    return b.detected(spark, d).withColumns(
        {
            "event_type": F.when(k == 1, "").otherwise(F.col("event_type")),
            "sensor_tag": F.when(k == 3, "unknown.pv").when(k != 2, F.col("sensor_tag")),
            "start": F.when(k != 4, F.col("start")),
            "timestamp": F.when(k != 5, F.col("timestamp")),
        }
    )


@query("flt_event_valid", b.ctes("mixed_events") + f"""select event_id, {REASON} as reason, {REASON} = '' as valid
  from mixed_events""")
def flt_event_valid(spark, d):
    return kg.event_reason(mixed_events(spark, d)).select("event_id", "reason", "valid")


RESOLVED = f"""res as (select m.event_id, s.entity_id, case when {REASON} <> '' then {REASON} when s.entity_id is null then
  concat('no sensor entity for ', m.sensor_tag) end as unresolved from mixed_events m left join (select source_tag,
  id as entity_id from ents where entity_type = 'Sensor') s on s.source_tag = m.sensor_tag)"""


@query("join_event_sensor", b.ctes("mixed_events", "ents").rstrip() + ", " + RESOLVED + """ select *,
  (select count(*) filter (unresolved is not null) from res) as rejected, (select count(*) filter (unresolved is not null)
  = 0 from res) as may_load from res""")
def join_event_sensor(spark, d):
    resolved = kg.resolve_event_sensors(mixed_events(spark, d), entities(spark, d))
    gate = kg.event_gate(resolved).select(F.struct("rejected", "may_load").alias("g")).scalar()
    return resolved.withColumn("g", gate).select("event_id", "entity_id", "unresolved", "g.rejected", "g.may_load")


@query("prj_event_properties", b.ctes("detected") + """select event_id as id, event_type, sensor_tag, status, interpretation,
  'plant.xlsx' as source_id, 'time_series_analysis' as source_type, 'statistical' as analysis_method,
  'event_candidates' as analysis_artifact, "start", "end", peak_timestamp, timestamp, direction, cast(null as varchar)
  as sample_count, peak_value, peak_robust_z, cast(null as varchar) as change_score from detected""")
def prj_event_properties(spark, d):
    return graph.event_properties(b.detected(spark, d), SOURCE)


@query("set_dedup_events", b.ctes("detected") + """select event_id, copy, sensor_tag from (select *, row_number() over
  (partition by event_id order by copy) as n from (select d.*, c.copy from detected d, (values (3), (1), (2)) c(copy)))
  where n = 1""")
def set_dedup_events(spark, d):
    copies = F.explode(F.array(F.lit(3), F.lit(1), F.lit(2))).alias("copy")
    return kg.first_per_event(b.detected(spark, d).select("*", copies), ["copy"]).select("event_id", "copy", "sensor_tag")


# --- graph --------------------------------------------------------------------------------------------------------


@query("join_class_nodes", b.ctes("rels") + """select c.name, c.status, c.source, r.source as src from (select distinct target
  as name, 'candidate' as status, 'ontology_candidate' as source from rels where relation = 'INSTANCE_OF') c
  join rels r on r.relation = 'INSTANCE_OF' and r.target = c.name""")
def join_class_nodes(spark, d):
    found = relations(spark, d)
    edges = found.where("relation = 'INSTANCE_OF'").select(F.col("target").alias("name"), F.col("source").alias("src"))
    return graph.class_nodes(found).join(edges, "name").select("name", "status", "source", "src")


@query("sink_upsert_create", b.ctes("sensors") + """select tag, user_id, case when user_id % 3 <> 0 then 'old' else 'new 2' end
  as note from sensors where user_id % 3 <> 0 or user_id % 2 = 0""")
def sink_upsert_create(spark, d):
    """Merged where rows that exist stay as they are."""
    sensors = b.sensors(spark, d).select("tag", "user_id")
    incoming = sensors.where("user_id % 2 = 0").select(
        "*", F.explode(F.array(F.lit("new 1"), F.lit("new 2"))).alias("note")
    )
    path = sinks.scratch_path(spark, "entities")
    keyed_table.create_table(sensors.where("user_id % 3 <> 0").withColumn("note", F.lit("old")), path, ["tag"])
    keyed_table.merge(spark, path, incoming, ["note"], create_only=True)
    return keyed_table.read_table(spark, path)


@query("sink_upsert", b.ctes("sensors") + """select tag, user_id, case when user_id % 2 = 0 then 'new 2' else 'old' end as note
  from sensors where user_id % 3 <> 0 union all select tag, user_id, 'new 2' from sensors where user_id % 3 = 0
  and user_id % 2 = 0""")
def sink_upsert(spark, d):
    sensors = b.sensors(spark, d).select("tag", "user_id")
    existing = sensors.where("user_id % 3 <> 0").withColumn("note", F.lit("old"))
    incoming = sensors.where("user_id % 2 = 0").select(
        "*", F.explode(F.array(F.lit("new 1"), F.lit("new 2"))).alias("note")
    )
    path = sinks.scratch_path(spark, "entities")
    keyed_table.create_table(existing, path, ["tag"])
    keyed_table.merge(spark, path, incoming, ["note"])
    keyed_table.merge(spark, path, incoming, ["note"])
    return keyed_table.read_table(spark, path)


def whole_graph(spark, d, merge=graph.merged_edges):
    ents, events = staged(entities(spark, d), "entities"), b.detected(spark, d)
    rels = kg.structural_relations(ents)
    resolved = kg.resolve_event_sensors(events, ents).where("unresolved is null")
    chunks = staged(b.chunks(spark, d), "chunks")
    words = b.dict_entities(spark, d)
    links = mentioned_entities(chunks, b.tag_dictionary(spark, d), words, ["file_name", "page"])
    nodes = graph.graph_nodes(ents, graph.class_nodes(rels), events, chunks, SOURCE).unionByName(
        graph.node_rows(words.drop("user_id"), "entity_id", "Entity")
    )
    # Relations come twice and once more with a target that nobody knows: the graph has each edge once.
    faulty = rels.unionByName(rels).unionByName(rels.withColumn("target", F.concat(F.lit("ghost "), "target")))
    edges = graph.graph_edges(faulty, resolved.select("event_id", "entity_id"), links, SOURCE)
    return nodes, merge(edges, nodes)


b.SQL["all_nodes"] = """select id, 'Entity' as label from ents union all select distinct target, 'Class' from rels
  where relation = 'INSTANCE_OF' union all select event_id, 'Event' from detected
  union all select chunk_id, 'DocumentChunk' from chunks union all select entity_id, 'Entity' from dict_entities"""
b.NEEDS["all_nodes"] = ["ents", "rels", "detected", "chunks", "dict_entities"]
b.SQL["all_edges"] = """select source as src, relation as type, target as dst, source_column as a from rels
  union all select d.event_id, 'DETECTED_BY', e.id, 'time_series_analysis' from detected d join ents e on
    e.source_tag = d.sensor_tag and e.entity_type = 'Sensor'
  union all select m.chunk_id, 'MENTIONS', m.entity_id, cast(c.page as varchar) from mention_edges m join chunks c
    on c.chunk_id = m.chunk_id"""
b.NEEDS["all_edges"] = ["rels", "detected", "ents", "mention_edges"]


@query("kg_graph", b.ctes("all_edges") + "select src, type, dst, a from all_edges")
def kg_graph(spark, d):
    _, edges = whole_graph(spark, d)
    p = F.col("properties")
    shown = F.coalesce(F.try_element_at(p, F.lit("source_column")), F.try_element_at(p, F.lit("page")),
                       F.try_element_at(p, F.lit("evidence_type")))
    return edges.select("src", "type", "dst", shown.alias("a"))


@query("sink_graph_export", b.ctes("all_nodes", "all_edges") + """select 'node' as kind, id as element_id, label as labels,
  cast(null as varchar) as start_element_id, cast(null as varchar) as end_element_id from all_nodes union all
  select 'edge', concat(src, '|', type, '|', dst), type, src, dst from all_edges""")
def sink_graph_export(spark, d):
    nodes, edges = whole_graph(spark, d, graph.exported_edges)
    at = sinks.scratch_path(spark, "graph")
    sinks.write_graph(nodes, edges, at, "gzip")
    schema = "element_id string, labels array<string>, type string, start_element_id string, end_element_id string, properties string"
    back = spark.read.schema(schema).json([f"{at}/nodes", f"{at}/edges"])
    return back.select(
        F.when(F.col("type").isNull(), "node").otherwise("edge").alias("kind"), "element_id",
        F.coalesce(F.col("labels")[0], "type").alias("labels"), "start_element_id", "end_element_id",
    )


@query("agg_graph_counts", b.ctes("all_nodes", "all_edges") + """select (select count(*) from all_nodes) as nodes,
  (select count(*) from all_edges) as edges, (select count(distinct label) from all_nodes) as labels""")
def agg_graph_counts(spark, d):
    return graph.graph_counts(*whole_graph(spark, d))


@query("agg_package_summary", b.ctes("checked", "rels", "all_nodes", "all_edges") + """select
  (select count(distinct target) from rels where relation = 'INSTANCE_OF') as class_count, (select count(*) from rels) as
  relation_count, (select count(*) from checked) as entity_count,
  case when (select count(*) from checked where issues like '%error%') = 0 then 'passed' else 'needs_review' end as
  validation_status, (select count(*) from embeddings) as vectors, (select max(len(embedding)) from embeddings)::bigint as dims,
  (select count(*) from all_nodes) as nodes, (select count(*) from all_edges) as edges""")
def agg_package_summary(spark, d):
    rels = relations(spark, d)
    checked = kg.validate_entities(faulty_entities(spark, d), source_catalog(spark, d))
    report = kg.validation_report(checked, kg.validate_relations(rels, entities(spark, d)))
    return package.package_summary(
        graph.class_nodes(rels), rels, checked, report, b.table(spark, d, "embeddings"), *whole_graph(spark, d)
    )


# --- look-ups -----------------------------------------------------------------------------------------------------

b.SQL["graph_ents"] = "select id as entity_id, source_column, candidate_class, tag_family from ents"
b.NEEDS["graph_ents"] = ["ents"]
b.SQL["graph_events"] = """select d.*, e.id as entity_id, e.source_column from detected d join ents e on
  e.source_tag = d.sensor_tag and e.entity_type = 'Sensor'"""
b.NEEDS["graph_events"] = ["detected", "ents"]
b.SQL["toks"] = r"""select distinct question_id, lower(t) as token from (select question_id,
  unnest(string_split_regex(question, '[^A-Za-z0-9_.-]+')) as t from questions) where length(t) >= 3"""
b.NEEDS["toks"] = ["questions"]
b.SQL["looked"] = """select * from (select question_id, row_number() over (partition by question_id order by entity_id)
  as rank, * exclude (question_id) from (select distinct question_id, e.* from toks join graph_ents e on
  contains(lower(e.entity_id), token) or contains(lower(e.source_column), token) or
  contains(lower(coalesce(e.tag_family, '')), token) or contains(lower(e.candidate_class), token))) where rank <= 20"""
b.NEEDS["looked"] = ["toks", "graph_ents"]
b.SQL["event_found"] = """select * from (select question_id, row_number() over (partition by question_id order by "start" desc
  nulls first, event_id, entity_id) as rank, * exclude (question_id) from (select distinct q.question_id, v.* from questions q
  join graph_events v on not exists (select 1 from toks t where t.question_id = q.question_id) or exists (select 1 from toks t
  where t.question_id = q.question_id and (contains(lower(v.event_type), token) or contains(lower(v.entity_id), token)
  or contains(lower(v.source_column), token) or contains(lower(v.interpretation), token))))) where rank <= 20"""
b.NEEDS["event_found"] = ["toks", "graph_events"]


def graph_entities(spark, d, ents=None):
    return (entities(spark, d) if ents is None else ents).select(
        F.col("id").alias("entity_id"), F.col("provenance.location.column").alias("source_column"), "candidate_class",
        F.col("attributes.tag_family").alias("tag_family"),
    )


def graph_events(spark, d, ents=None):
    ents = entities(spark, d) if ents is None else ents
    found = kg.resolve_event_sensors(b.detected(spark, d), ents).where("unresolved is null")
    return found.withColumn("source_column", F.col("sensor_tag"))


@query("join_graph_lookup", b.ctes("looked") + """select question_id, rank, entity_id, source_column, candidate_class, tag_family
  from looked""")
def join_graph_lookup(spark, d):
    return retrieval.graph_lookup(b.questions(spark, d), graph_entities(spark, d))


TEN_EVENTS = """ten as (select * from (select *, row_number() over (partition by entity_id order by event_id) as n from
  graph_events) where n <= 10)"""


@query("join_graph_lookup_events", b.ctes("looked", "graph_events").rstrip() + ", " + TEN_EVENTS + """ select question_id, entity_id,
  event_id, event_type from (select l.question_id, l.entity_id, t.event_id, t.event_type, row_number() over (partition by
  l.question_id, t.event_id order by l.rank) as seen from looked l join ten t on t.entity_id = l.entity_id) where seen = 1""")
def join_graph_lookup_events(spark, d):
    found = retrieval.graph_lookup(b.questions(spark, d), graph_entities(spark, d))
    return retrieval.graph_lookup_events(found, graph_events(spark, d)).select(
        "question_id", "entity_id", "event_id", "event_type"
    )


@query("agg_entity_events", b.ctes("graph_events").rstrip() + ", " + TEN_EVENTS + """ select entity_id, count(*) as events,
  string_agg(event_id, ',' order by event_id) as event_ids from ten group by entity_id""")
def agg_entity_events(spark, d):
    return retrieval.entity_events(graph_events(spark, d)).groupBy("entity_id").agg(
        F.count("*").alias("events"), F.array_join(F.array_sort(F.collect_list("event_id")), ",").alias("event_ids")
    )


@query("join_event_lookup", b.ctes("event_found") + """select question_id, rank, event_id, entity_id, event_type, "start" from event_found""")
def join_event_lookup(spark, d):
    return retrieval.event_lookup(b.questions(spark, d), graph_events(spark, d)).select(
        "question_id", "rank", "event_id", "entity_id", "event_type", "start"
    )


@query("topk_event_timeline", b.ctes("graph_events") + """select event_id, entity_id as sensor, event_type, "start" from graph_events
  order by "start" desc nulls first, event_id, entity_id limit 400""")
def topk_event_timeline(spark, d):
    return retrieval.event_timeline(graph_events(spark, d), 400).select(
        "event_id", F.col("entity_id").alias("sensor"), "event_type", "start"
    )
