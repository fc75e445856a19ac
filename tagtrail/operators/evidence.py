"""Evidence per question as rows, and its rendering to the lines of a prompt.

Evidence stays one row per item: what an entity or question gathers has no bound. A prompt is the lines of a question
in the order (section, place); ``render_text`` joins them where the look-ups bound their number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tagtrail.functions import citations as c, routing
from tagtrail.functions.text import contains_any, strip
from tagtrail.operators import correlation, retrieval, timeseries
from tagtrail.session import staged

# Headings and closing line of each prompt layout.
LAYOUTS = {
    "grounded": {
        "question": "QUESTION", "documents": "DOCUMENT EVIDENCE", "entities": "GRAPH ENTITY EVIDENCE",
        "events": "STATISTICAL EVENT EVIDENCE", "closing": "Answer the question using only the evidence above.",
    },
    "evaluation": {
        "question": "QUESTION", "documents": "DOCUMENT EVIDENCE", "entities": "GRAPH ENTITY EVIDENCE",
        "events": "STATISTICAL EVENT EVIDENCE", "closing": "Generate the grounded answer now.",
    },
    "tools": {
        "question": "USER QUESTION", "tools": "TOOLS USED", "documents": "DOCUMENT TOOL RESULTS",
        "entities": "GRAPH ENTITY RESULTS", "events": "GRAPH-LINKED EVENT RESULTS", "found": "EVENT TOOL RESULTS",
        "closing": "Answer using only these tool results.",
    },
    "agent": {
        "question": "QUESTION", "tools": "TOOLS USED", "documents": "DOCUMENT EVIDENCE", "entities": "GRAPH ENTITIES",
        "events": "GRAPH EVENTS", "found": "EVENT SEARCH RESULTS", "series": "TIME-SERIES TOOL RESULTS",
        "closing": "Answer strictly from this evidence.",
    },
}
AGENT_SENSORS, AGENT_RECENT, AGENT_EVENTS, COMPARE_ROWS = 3, 12, 12, 500
SECTION = {"question": 0, "tools": 1, "documents": 2, "entities": 3, "events": 4, "found": 5, "series": 6, "policies": 7, "closing": 9}


def _text(value: Column | str) -> Column:
    value = F.col(value) if isinstance(value, str) else value
    return F.coalesce(value.cast("string"), F.lit("None"))


def _say(*parts: Column | str) -> Column:
    """Text of the parts: strings are literal, ``name=`` takes the column of that name behind it."""
    out = []
    for p in parts:
        out.append(F.lit(p) if isinstance(p, str) else p)
    return F.concat(*out)


def _fields(**names: str) -> Column:
    return F.concat_ws(" ", *(F.concat(F.lit(f"{k}="), _text(v)) for k, v in names.items()))


def _lines(rows: DataFrame, section: str, place: list[Column], *lines: Column) -> DataFrame:
    """Several lines per row; ``place`` orders the rows of a section, null lines are left out."""
    at = F.concat_ws("|", *(p.cast("string") for p in place)) if place else F.lit("")
    each = F.array_compact(
        F.array(*(F.when(t.isNotNull(), F.struct(F.lit(i).alias("n"), t.alias("line"))) for i, t in enumerate(lines)))
    )
    return rows.select(
        "question_id", F.lit(SECTION[section]).alias("section"), at.alias("place"), F.inline(each)
    )


def _padded(number: str) -> Column:
    return F.lpad(F.col(number).cast("string"), 6, "0")


def document_lines(documents: DataFrame, with_score: bool) -> DataFrame:
    """``documents``: question_id, rank, file_name, page, chunk_id, text, score."""
    key = c.document_key(F.col("file_name"), F.col("page"), F.col("chunk_id"))
    score = _say(" score=", _text(F.round("score", 6))) if with_score else F.lit("")
    text = F.col("text") if with_score else strip(F.col("text"))
    return _lines(documents, "documents", [_padded("rank")], F.concat(F.lit("["), key, F.lit("]"), score), text, F.lit(""))


def entity_lines(entities: DataFrame, layout: str) -> DataFrame:
    """``entities``: question_id, entity_id, source_column, candidate_class and what the layout shows."""
    shown = {"column": "source_column", "class": "candidate_class"}
    if layout == "grounded":
        shown |= {"tag_family": "tag_family", "confidence": "confidence"}
    elif layout != "evaluation":
        shown |= {"family": "tag_family"}
    place = [F.col("chunk_id"), F.col("entity_id")] if "chunk_id" in entities.columns else [_padded("rank")]
    return _lines(entities, "entities", place, _say("[ENTITY:", F.col("entity_id"), "] ", _fields(**shown)))


def event_line(layout: str, key: str = "EVENT:") -> Column:
    shown = {"sensor": "entity_id", "type": "event_type"}
    if layout != "grounded":
        shown |= {"status": "status"}
    shown |= {"start": "start", "end": "end", "peak": "peak_value", "robust_z": "peak_robust_z"}
    if layout == "grounded":
        shown |= {"direction": "direction", "status": "status"}
    return _say(f"[{key}", _text("event_id"), "] ", _fields(**shown))


def event_lines(events: DataFrame, layout: str, section: str = "events") -> DataFrame:
    note = F.when(
        F.col("interpretation").isNotNull() & (F.col("interpretation") != ""),
        F.concat(F.lit("interpretation="), F.col("interpretation")),
    )
    lines = [event_line(layout)] + ([note] if layout in ("grounded", "evaluation") else [])
    place = [_padded("rank")] if section == "found" else [F.col("entity_id"), F.col("event_id")]
    return _lines(events, section, place, *lines)


def frame_lines(questions: DataFrame, layout: str, system_prompt: str | None = None) -> DataFrame:
    """Headings, question, tools and closing line of every prompt."""
    heads = LAYOUTS[layout]
    top = [] if system_prompt is None else [F.lit(system_prompt), F.lit("")]
    parts = [_lines(questions, "question", [], *top, F.lit(heads["question"]), F.col("question"), F.lit(""))]
    if "tools" in heads:
        parts.append(_lines(questions, "tools", [], F.lit(heads["tools"]), F.array_join("tools", ", "), F.lit("")))
    for name in ("documents", "entities", "events", "found", "series"):
        if name in heads:
            # A heading is the first line of its section: its place sorts before any other.
            gap = [] if name in ("documents", "entities") else [F.lit("")]
            parts.append(_lines(questions, name, [], *gap, F.lit(heads[name])))
    parts.append(_lines(questions, "closing", [], F.lit(""), F.lit(heads["closing"])))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def render_text(lines: DataFrame) -> DataFrame:
    """One prompt text per question; for layouts whose look-ups bound the number of lines."""
    ordered = F.array_sort(F.collect_list(F.struct("section", "place", "n", "line")))
    return lines.groupBy("question_id").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("prompt"))


def grounded_lines(
    questions: DataFrame, documents: DataFrame, entities: DataFrame, events: DataFrame, layout: str = "grounded",
    system_prompt: str | None = None,
) -> DataFrame:
    """Prompt lines from documents found and the graph evidence of their mentions."""
    return (
        frame_lines(questions, layout, system_prompt)
        .unionByName(document_lines(documents, with_score=False))
        .unionByName(entity_lines(entities, layout))
        .unionByName(event_lines(events, layout))
    )


def grounded_bundle(documents: DataFrame, entities: DataFrame, events: DataFrame) -> DataFrame:
    """Evidence of each question as rows ``question_id, kind, key, parent, score`` with its citation key."""
    null = F.lit(None)
    docs = documents.select(
        "question_id", F.lit("document").alias("kind"),
        c.document_key(F.col("file_name"), F.col("page"), F.col("chunk_id")).alias("key"),
        null.cast("string").alias("parent"), "score",
    )
    ents = entities.select(
        "question_id", F.lit("entity").alias("kind"), c.entity_key(F.col("entity_id")).alias("key"),
        F.col("chunk_id").alias("parent"), null.cast("double").alias("score"),
    )
    found = events.select(
        "question_id", F.lit("event").alias("kind"), c.event_key(F.col("event_id")).alias("key"),
        F.col("entity_id").alias("parent"), null.cast("double").alias("score"),
    )
    return docs.unionByName(ents).unionByName(found)


def policy_rows(questions: DataFrame, policy: list[str]) -> DataFrame:
    """The rules every bundle carries, in the shape of ``grounded_bundle``."""
    return questions.select(
        "question_id", F.lit("policy").alias("kind"), F.explode(F.array(*map(F.lit, policy))).alias("key"),
        F.lit(None).cast("string").alias("parent"), F.lit(None).cast("double").alias("score"),
    )


def policy_lines(questions: DataFrame, policy: list[str]) -> DataFrame:
    """The rules as lines of a routed bundle; prompts leave them out."""
    return _lines(questions, "policies", [], *map(F.lit, policy))


# --- routed evidence ----------------------------------------------------------------------------------------------


def routed(questions: DataFrame, agent: bool = True) -> DataFrame:
    route = routing.route_agent if agent else routing.route
    return questions.withColumn("tools", route(F.col("question")))


def needing(questions: DataFrame, tool: str) -> DataFrame:
    return questions.where(F.array_contains("tools", tool)).drop("tools")


def question_sensors(questions: DataFrame, tags: DataFrame) -> DataFrame:
    """Sensors of the questions that need readings, with their rank."""
    return staged(retrieval.explicit_sensors(needing(questions, "timeseries"), tags), "sensors-asked")


def sensor_evidence(
    questions: DataFrame, sensors: DataFrame, readings: DataFrame, events: DataFrame
) -> dict[str, DataFrame]:
    """Summary, recent values and events of the first sensors of each question, and comparisons asked for."""
    first = sensors.where(F.col("rank") <= AGENT_SENSORS).select("question_id", "tag", F.col("rank").alias("sensor_rank"))
    wanted = first.select("tag").distinct()
    mine = readings.join(wanted, "tag", "left_semi")
    bounds = readings.agg(F.min("ts").alias("first_timestamp"), F.max("ts").alias("last_timestamp"))
    own = events.join(wanted.select(F.col("tag").alias("sensor_tag")), "sensor_tag", "left_semi")
    latest = timeseries.sensor_events(own, AGENT_EVENTS).withColumn("key", F.col("sensor_key"))
    asks = questions.where(contains_any(F.lower("question"), routing.COMPARE_TERMS)).select("question_id")
    pair = (
        sensors.where(F.col("rank") <= 2).join(asks, "question_id", "left_semi").groupBy("question_id")
        .agg(F.count("*").alias("n"), F.min_by("tag", "rank").alias("sensor_a"), F.max_by("tag", "rank").alias("sensor_b"))
        .where("n = 2").select(F.col("question_id").alias("pair_id"), "sensor_a", "sensor_b")
    )
    return {
        "summaries": first.join(timeseries.tool_summary(mine, bounds), "tag"),
        "recent": first.join(timeseries.recent_values(mine, AGENT_RECENT), "tag"),
        "events": first.withColumn("key", F.lower("tag")).join(latest, "key"),
        "comparisons": correlation.compare_sensor_pairs(readings, pair, COMPARE_ROWS).withColumnRenamed(
            "pair_id", "question_id"
        ),
    }


def series_lines(sensors: DataFrame, found: dict[str, DataFrame], questions: DataFrame) -> DataFrame:
    """Lines of the time-series section, in the order summaries, recent values, events, comparisons."""
    iso = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
    names = sensors.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("rank", "tag"))).alias("found"))
    named = questions.select("question_id").join(names, "question_id", "left").select(
        "question_id", F.array_join(F.coalesce(F.col("found")["tag"], F.array().cast("array<string>")), ", ").alias("names")
    )

    def number(name: str) -> Column:
        return _text(F.round(name, 8))

    summary = _say(
        "[", c.series_key("SUMMARY", F.col("tag")), "] rows=", _text("rows"), " min=", number("min"), " max=",
        number("max"), " mean=", number("mean"), " median=", number("median"), " std=", number("std"), " range=",
        F.date_format("first_timestamp", iso), "..", F.date_format("last_timestamp", iso),
    )
    recent_head = found["recent"].where("recency = 1")
    recent = _say("timestamp=", F.date_format("ts", iso), " value=", _text("value"))
    compare = _say(
        "[", c.series_key("COMPARE", F.col("sensor_a"), F.col("sensor_b")), "] rows=", _text("rows_analyzed"),
        " pearson=", number("pearson_correlation"), " range=", F.date_format("start", iso), "..",
        F.date_format("end", iso),
    )
    # Recent values run from the oldest to the newest.
    oldest_first = F.lpad((1000 - F.col("recency")).cast("string"), 6, "0")
    events = found["events"].withColumn("entity_id", F.col("tag"))
    return (
        _lines(named, "series", [F.lit("0")], _say("IDENTIFIED SENSORS: ", F.col("names")))
        .unionByName(_lines(found["summaries"], "series", [F.lit("1"), _padded("sensor_rank")], summary))
        .unionByName(_lines(recent_head, "series", [F.lit("2"), _padded("sensor_rank")],
                            _say("[", c.series_key("RECENT", F.col("tag")), "]")))
        .unionByName(_lines(found["recent"], "series", [F.lit("2"), _padded("sensor_rank"), oldest_first], recent))
        .unionByName(_lines(events, "series", [F.lit("3"), _padded("sensor_rank"), _padded("recency")],
                            event_line("agent", "TS:EVENT:")))
        .unionByName(_lines(found["comparisons"], "series", [F.lit("4")], compare))
    )


def routed_evidence(
    questions: DataFrame, documents: DataFrame, entities: DataFrame, events: DataFrame
) -> dict[str, DataFrame]:
    """Documents, entities, their events, and event search results for routed questions ``(…, tools)``."""
    found = staged(retrieval.graph_lookup(needing(questions, "graph_lookup"), entities), "entities-found")
    return {
        "documents": documents,
        "entities": found,
        "events": retrieval.graph_lookup_events(found, events),
        "found": retrieval.event_lookup(needing(questions, "event_lookup"), events),
    }


def routed_lines(
    questions: DataFrame, found: dict[str, DataFrame], layout: str, system_prompt: str | None = None
) -> DataFrame:
    """Prompt lines of the tool and agent layouts (the agent adds ``series_lines``)."""
    once = Window.partitionBy("question_id").orderBy("rank", "event_id")
    events = found["events"].withColumn("rank", F.row_number().over(once))
    return (
        frame_lines(questions, layout, system_prompt)
        .unionByName(document_lines(found["documents"], with_score=True))
        .unionByName(entity_lines(found["entities"], layout))
        .unionByName(_lines(events, "events", [_padded("rank")], event_line(layout)))
        .unionByName(event_lines(found["found"], layout, "found"))
    )
