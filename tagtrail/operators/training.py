"""Grounded examples from the data products: made, checked, split and written as chat messages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tagtrail.functions.citations import compact_json
from tagtrail.functions.ids import example_id, hash_bucket, pair_key, split_name
from tagtrail.functions.text import contains_any, excerpt, strip

# Fixed values of the examples.
SCHEMA_VERSION = "1.0"
DOCUMENT_LIMIT, EVENT_LIMIT = 25, 50
ASSIGNMENT_METHOD = "exact_text_match"
POLICY_KEYS = [
    "source_grounded", "statistical_event_is_not_confirmed_fault", "document_mention_is_not_physical_assignment",
    "correlation_is_not_causation",
]
REQUIRED_FIELDS = [
    "id", "schema_version", "task_type", "instruction", "response", "context", "source_records", "grounding_policy",
]
UNCERTAIN_TERMS = ["no.", "not", "insufficient", "cannot", "does not"]
EVENT_CAVEAT = (
    " This is a statistical candidate event and does not by itself establish a confirmed equipment fault."
)
# The three policy questions as (id, rule, question, answer, artifact).
HARD_NEGATIVES = [
    (
        "hard_negative_failure", "statistical_event_is_not_confirmed_fault",
        "Does a statistical anomaly prove that the equipment has failed?",
        "No. A statistical anomaly is evidence of unusual behavior in the measured signal. It does not by itself prove "
        "equipment failure. Additional engineering evidence and validation are required.",
        "event_candidates.json",
    ),
    (
        "hard_negative_assignment", "document_mention_is_not_physical_assignment",
        "Does a document mentioning a sensor tag prove which physical asset it belongs to?",
        "No. A document mention establishes textual evidence that the tag appears in that document. It does not by "
        "itself prove physical asset assignment or component connectivity.",
        "document_entity_links.jsonl",
    ),
    (
        "hard_negative_causality", "correlation_is_not_causation",
        "If two sensor signals are correlated, can we conclude that one caused the other?",
        "No. Correlation alone does not establish causation. A causal conclusion requires additional evidence.",
        "correlated_sensor_pairs.csv",
    ),
]


def clean(value: Column | str) -> Column:
    """Stripped text; empty for null."""
    value = F.col(value) if isinstance(value, str) else value
    return strip(F.coalesce(value.cast("string"), F.lit("")))


def record(**fields: Column) -> Column:
    """A flat record as a string map."""
    return F.create_map(*(x for k, v in fields.items() for x in (F.lit(k), v.cast("string"))))


def example(
    id: Column, task: str, question: Column, answer: Column, context: Column, source: Column,
    difficulty: str = "standard",
) -> list[Column]:
    return [
        id.alias("id"), F.lit(SCHEMA_VERSION).alias("schema_version"), F.lit(task).alias("task_type"),
        F.lit(difficulty).alias("difficulty"), question.alias("instruction"), answer.alias("response"),
        F.array(context).alias("context"), source.alias("source_records"),
        F.struct(*(F.lit(True).alias(k) for k in POLICY_KEYS)).alias("grounding_policy"),
    ]


# --- makers -------------------------------------------------------------------------------------------------------


def entity_examples(entities: DataFrame) -> DataFrame:
    """Two questions per entity: its class, and where the evidence for it came from."""
    id, where = clean("id"), F.col("provenance.location")
    column, name = clean(where["column"]), clean("candidate_class")
    rows = where["data_rows"]
    context = record(
        type=F.lit("entity"), id=id, entity_id=id, source_column=column, candidate_class=name, confidence=F.col("confidence")
    )
    source = F.array(record(artifact=F.lit("validated_knowledge.json"), entity_id=id, source_column=column))

    def part(word: str, value: Column) -> Column:
        return F.when(value.isNotNull() & (value != ""), F.concat(F.lit(word), value))

    span = F.when(
        rows["start"].isNotNull(),
        F.concat(F.lit("rows "), rows["start"].cast("string"),
                 F.coalesce(F.concat(F.lit("–"), rows["end"].cast("string")), F.lit(""))),
    )
    places = F.concat_ws(
        ", ", part("source ", F.col("provenance.source_id")), part("sheet ", where["sheet"]),
        part("column ", where["column"]), span,
    )
    named = entities.where(id != "")
    classes = named.select(*example(
        example_id("entity_class", id), "entity_classification",
        F.concat(F.lit("What class was proposed for sensor entity "), id, F.lit("?")),
        F.concat(F.lit("The candidate class recorded for "), id, F.lit(" is "),
                 F.coalesce(F.nullif(name, F.lit("")), F.lit("not specified")), F.lit(".")),
        context, source,
    ))
    origins = named.select(*example(
        example_id("entity_provenance", id), "provenance",
        F.concat(F.lit("Where did the knowledge system obtain evidence for "), id, F.lit("?")),
        F.concat(F.lit("The recorded provenance points to "),
                 F.coalesce(F.nullif(places, F.lit("")), F.lit("no source details recorded")), F.lit(".")),
        context, source,
    ))
    return classes.unionByName(origins)


def document_examples(chunks: DataFrame, links: DataFrame, limit: int | None = None) -> DataFrame:
    """One question per chunk, answered with an excerpt and its citation.

    The first ``limit`` chunks in document order are taken before empty ones are left out; None takes all.
    """
    tags = links.select("chunk_id", "matched_sensor_tags")
    if limit is not None:
        chunks = chunks.orderBy("document_id", "page", "chunk_index").limit(limit)
    id, file, page, text = clean("chunk_id"), clean("file_name"), clean("page"), clean("text")
    cite = F.concat(file, F.lit(" p."), page, F.lit(" chunk:"), id)
    return chunks.join(tags, "chunk_id", "left").where(text != "").select(*example(
        example_id("doc_evidence", id), "document_evidence",
        F.concat(F.lit("What does the retrieved document evidence at "), file, F.lit(" page "), page, F.lit(" say?")),
        F.concat(F.lit("The retrieved evidence from "), cite, F.lit(" states: "), excerpt(text)),
        record(type=F.lit("document_chunk"), chunk_id=id, file=file, page=page, text=text,
               mentioned_sensor_tags=F.to_json(F.coalesce("matched_sensor_tags", F.array().cast("array<string>")))),
        F.array(record(artifact=F.lit("document_chunks.jsonl"), chunk_id=id, file=file, page=page)),
    ))


def event_examples(events: DataFrame, limit: int | None = None) -> DataFrame:
    """One question per event; the sentences of the answer follow the fields the event has.

    The first ``limit`` events by id are taken before those without an id are left out; None takes all.
    """
    if limit is not None:
        events = events.orderBy("event_id").limit(limit)
    if "entity_id" in events.columns:  # an event without a sensor tag goes by its entity
        events = events.withColumn("sensor_tag", F.coalesce(F.nullif("sensor_tag", F.lit("")), "entity_id"))
    id, sensor, kind, status = clean("event_id"), clean("sensor_tag"), clean("event_type"), clean("status")
    note, start, end = clean("interpretation"), clean("start"), clean("end")

    def said(value: Column, *parts: Column | str) -> Column:
        return F.when(value, F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts)))

    def known(time: Column) -> Column:
        return F.coalesce(F.nullif(time, F.lit("")), F.lit("unspecified"))

    answer = F.concat_ws(
        " ",
        said(kind != "", "The recorded event type is ", kind, "."),
        said(sensor != "", "The associated sensor is ", sensor, "."),
        said((start != "") | (end != ""), "The recorded time window is ", known(start), " to ", known(end), "."),
        said(F.col("peak_value").isNotNull(), "The recorded peak value is ", F.col("peak_value").cast("string"), "."),
        said(F.col("peak_robust_z").isNotNull(), "The recorded peak robust z-score is ",
             F.col("peak_robust_z").cast("string"), "."),
        said(note != "", "Recorded interpretation: ", note),
        said(status != "", "Status: ", status, "."),
    )
    return events.where(id != "").select(*example(
        example_id("event", id), "timeseries_event_interpretation",
        F.concat(F.lit("What does candidate event "), id, F.lit(" tell us?")),
        F.concat(answer, F.lit(EVENT_CAVEAT)),
        record(type=F.lit("event"), event_id=id, sensor=sensor, event_type=kind, status=status, start=start, end=end,
               peak_value=F.col("peak_value"), peak_robust_z=F.col("peak_robust_z"), interpretation=note),
        F.array(record(artifact=F.lit("event_candidates.json"), event_id=id)),
    ))


def hard_negatives(entities: DataFrame, events: DataFrame) -> DataFrame:
    """The three policy questions; the first points at the first entity and event by id."""
    firsts = entities.agg(F.min("id").alias("sensor")).withColumn("event_id", events.agg(F.min("event_id")).scalar())
    out = None
    for id, rule, question, answer, artifact in HARD_NEGATIVES:
        context = {"type": F.lit("policy"), "rule": F.lit(rule)}
        method = {"method": F.lit(ASSIGNMENT_METHOD)} if id == "hard_negative_assignment" else {}
        source = F.array(record(artifact=F.lit(artifact), **method))
        if id == "hard_negative_failure":
            event = clean("event_id")
            context |= {"event_id": event, "sensor": clean("sensor")}
            source = F.when(event != "", F.array(record(artifact=F.lit(artifact), event_id=event))).otherwise(
                F.array().cast("array<map<string,string>>")
            )
        rows = firsts.select(*example(
            F.lit(id), "uncertainty_reasoning", F.lit(question), F.lit(answer), record(**context), source, "hard"
        ))
        out = rows if out is None else out.unionByName(rows)
    return out


def all_examples(
    entities: DataFrame, chunks: DataFrame, links: DataFrame, events: DataFrame,
    document_limit: int | None = None, event_limit: int | None = None,
) -> DataFrame:
    return (
        entity_examples(entities)
        .unionByName(document_examples(chunks, links, document_limit))
        .unionByName(event_examples(events, event_limit))
        .unionByName(hard_negatives(entities, events))
    )


# --- checks -------------------------------------------------------------------------------------------------------


def with_duplicates(examples: DataFrame) -> DataFrame:
    """Add ``duplicate_id`` and ``duplicate_pair``: every member of a group of equals is flagged.

    Groups are counted after partial aggregation, and only keys that repeat come back.
    """
    id = F.coalesce("id", F.lit("None"))
    keyed = examples.withColumns({"_id": id, "_pair": pair_key(F.col("instruction"), F.col("response"))})

    def repeated(key: str, flag: str) -> DataFrame:
        counts = keyed.groupBy(key).agg(F.count("*").alias("n"))
        return counts.where("n > 1").select(key, F.lit(True).alias(flag))

    return (
        keyed.join(repeated("_id", "duplicate_id"), "_id", "left")
        .join(repeated("_pair", "duplicate_pair"), "_pair", "left")
        .fillna(False, ["duplicate_id", "duplicate_pair"])
        .drop("_id", "_pair")
    )


def unknown_references(examples: DataFrame, chunks: DataFrame, entities: DataFrame, events: DataFrame) -> DataFrame:
    """``context_key, unknown``: references of a context that name no chunk, entity or event.

    Each table is one column ``id``. ``context_key`` is the hash of the context as JSON.
    """
    kinds = {"chunk_id": "unknown_chunk", "entity_id": "unknown_entity", "event_id": "unknown_event"}
    known = None
    for kind, df in zip(kinds, (chunks, entities, events)):
        part = df.select(F.lit(kind).alias("kind"), F.col("id").alias("ref")).distinct()
        known = part if known is None else known.unionByName(part)
    refs = (
        examples.select(context_key().alias("context_key"), "context").dropDuplicates(["context_key"])
        .select("context_key", F.posexplode("context").alias("place", "c"))
        .select("context_key", "place", F.explode(F.array(*(
            F.struct(F.lit(i).alias("n"), F.lit(k).alias("kind"), F.try_element_at("c", F.lit(k)).alias("ref"))
            for i, k in enumerate(kinds)
        ))).alias("r"))
        .select("context_key", "place", "r.*")
        .where("ref is not null and ref <> ''")
    )
    label = F.create_map(*(F.lit(x) for kv in kinds.items() for x in kv))
    bad = refs.join(known, ["kind", "ref"], "left_anti").select(
        "context_key", F.struct("place", "n", F.concat_ws(":", label[F.col("kind")], "ref").alias("error")).alias("e")
    )
    return bad.groupBy("context_key").agg(F.array_sort(F.collect_list("e"))["error"].alias("unknown"))


def context_key() -> Column:
    return F.sha2(compact_json(F.col("context")), 256)


def validate_examples(examples: DataFrame, chunks: DataFrame, entities: DataFrame, events: DataFrame) -> DataFrame:
    """Add ``errors`` in the order of the checks and ``status`` (passed if there is none)."""

    def blank(name: str) -> Column:
        return clean(name) == ""

    policy = F.col("grounding_policy")
    missing = [F.when(F.col(f).isNull(), f"missing_field:{f}") for f in REQUIRED_FIELDS]
    answer, task = F.lower(clean("response")), F.col("task_type")
    before = F.array(
        *missing,
        F.when(blank("id"), "empty_id"), F.when(blank("instruction"), "empty_instruction"),
        F.when(blank("response"), "empty_response"),
        F.when(F.col("context").isNull(), "context_not_list"),
        F.when(F.col("source_records").isNull(), "source_records_not_list"),
        F.when(policy.isNull(), "grounding_policy_not_object"),
        *(F.when(policy.isNotNull() & policy[k].isNull(), f"missing_policy:{k}") for k in POLICY_KEYS),
        F.when(F.coalesce(F.size("source_records"), F.lit(0)) <= 0, "no_source_records"),
    )
    after = F.array(
        F.when(
            (task == "timeseries_event_interpretation") & ~(answer.contains("does not") & answer.contains("confirmed")),
            "event_response_missing_uncertainty_guard",
        ),
        F.when((task == "uncertainty_reasoning") & ~contains_any(answer, UNCERTAIN_TERMS),
               "uncertainty_example_may_be_overconfident"),
        F.when(F.col("duplicate_id"), "duplicate_example_id"),
        F.when(F.col("duplicate_pair"), "duplicate_instruction_response"),
    )
    unknown = unknown_references(examples, chunks, entities, events)
    errors = F.concat(
        F.array_compact(before), F.coalesce("unknown", F.array().cast("array<string>")), F.array_compact(after)
    )
    return (
        with_duplicates(examples)
        .withColumn("context_key", context_key())
        .join(unknown, "context_key", "left")
        .withColumn("errors", errors)
        .withColumn("status", F.when(F.size("errors") == 0, "passed").otherwise("failed"))
        .drop("context_key", "unknown", "duplicate_id", "duplicate_pair")
    )


def example_counts(examples: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Counts by each of the columns as ``field, value, examples``."""
    cells = examples.select(*(F.coalesce(F.col(c).cast("string"), F.lit("unknown")).alias(c) for c in columns))
    return cells.unpivot([], list(columns), "field", "value").groupBy("field", "value").agg(
        F.count("*").alias("examples")
    )


# --- split and chat rows ------------------------------------------------------------------------------------------


def split_examples(
    examples: DataFrame, train: float = 0.8, validation: float = 0.1, test: float = 0.1,
    checked: DataFrame | None = None,
) -> DataFrame:
    """Add ``bucket`` and ``split``, decided by content alone, so that exact duplicates stay together.

    With ``checked`` (validated examples) the job fails if any of them did not pass.
    """
    if abs(train + validation + test - 1.0) > 1e-9:
        raise ValueError("train + validation + test must equal 1.0")
    bucket = hash_bucket(pair_key(F.col("instruction"), F.col("response")))
    if checked is not None:
        invalid = checked.agg(F.count_if(F.col("status") != "passed")).scalar()
        stop = F.raise_error(F.lit("training data holds invalid examples")).cast("double")
        bucket = F.when(invalid == 0, bucket).otherwise(stop)
    return examples.withColumn("bucket", bucket).withColumn("split", split_name(F.col("bucket"), train, validation))


def chat_rows(split: DataFrame, system_prompt: str) -> DataFrame:
    """``messages`` (system, user with evidence and policy, assistant) and ``metadata`` of each example."""
    policy = F.struct(*(F.lit(True).alias(k) for k in POLICY_KEYS))
    evidence = F.concat_ws(
        "\n",
        F.lit("EVIDENCE CONTEXT"),
        F.when(F.size("context") > 0, compact_json(F.col("context"))),
        F.when(F.size("source_records") > 0,
               F.concat(F.lit("\nSOURCE RECORDS\n"), compact_json(F.col("source_records")))),
        F.concat(F.lit("\nGROUNDING POLICY\n"), compact_json(F.coalesce(F.col("grounding_policy"), policy))),
    )
    user = F.concat_ws(
        "\n\n", clean("instruction"), evidence, F.lit("Provide the grounded answer using only this evidence.")
    )

    def message(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    return split.select(
        F.array(
            message("system", F.lit(system_prompt)), message("user", user), message("assistant", clean("response"))
        ).alias("messages"),
        F.struct(
            F.col("id").alias("example_id"), "task_type", "difficulty", "split", "source_records"
        ).alias("metadata"),
    )
