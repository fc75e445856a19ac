"""Which tools a question needs, by the terms it contains."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tagtrail.functions.text import contains_any

# Terms that call for a tool.
GRAPH_TERMS = [
    "sensor", "tag", "entity", "compressor", "bearing", "instrument", "pressure", "temperature", "speed", "position",
]
EVENT_TERMS = [
    "anomaly", "abnormal", "event", "spike", "change point", "changed", "trend", "failure", "fault", "what happened",
    "before", "after",
]
AGENT_EVENT_TERMS = [
    "anomaly", "abnormal", "event", "spike", "change point", "change-point", "failure", "fault", "happened", "before",
    "after", "detected",
]
SERIES_TERMS = [
    "recent", "latest", "current value", "current reading", "trend", "over time", "time series", "timeseries", "value",
    "values", "measurement", "measurements", "compare", "correlation",
]
COMPARE_TERMS = ["compare", "correlation"]


def route(question: Column) -> Column:
    """Documents always; graph and events by their terms."""
    q = F.lower(question)
    return F.array_compact(
        F.array(
            F.lit("document_search"),
            F.when(contains_any(q, GRAPH_TERMS), "graph_lookup"),
            F.when(contains_any(q, EVENT_TERMS), "event_lookup"),
        )
    )


def route_agent(question: Column) -> Column:
    """As ``route`` with other event terms, and readings for their own terms or any event term."""
    q = F.lower(question)
    events = contains_any(q, AGENT_EVENT_TERMS)
    return F.array_compact(
        F.array(
            F.lit("document_search"),
            F.when(contains_any(q, GRAPH_TERMS), "graph_lookup"),
            F.when(events, "event_lookup"),
            F.when(events | contains_any(q, SERIES_TERMS), "timeseries"),
        )
    )
