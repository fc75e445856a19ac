"""Citations in answers, sections and phrases an answer holds, and chat messages."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tagtrail.functions.text import collapse_ws, contains_any, strip

# Phrases each kind of evaluation looks for.
INSUFFICIENT_PHRASES = [
    "insufficient", "not enough evidence", "cannot establish", "cannot confirm", "not confirmed",
]
UNCERTAINTY_PHRASES = [
    "insufficient", "not confirmed", "does not prove", "cannot confirm", "cannot establish", "not enough evidence",
]
FAILURE_PHRASES = ["equipment has failed", "confirmed failure", "machine failed", "bearing failure"]
GUARD_PHRASES = [
    "not confirmed", "does not prove", "cannot confirm", "insufficient", "not enough evidence", "not causation",
    "does not establish", "[doc:", "[entity:", "[event:",
]
COMPARISON_GUARD_PHRASES = [p for p in GUARD_PHRASES if p != "not causation"]


def document_key(file: Column, page: Column, chunk: Column) -> Column:
    return F.concat(F.lit("DOC:"), file, F.lit(" p."), page.cast("string"), F.lit(" chunk:"), chunk)


def entity_key(entity: Column) -> Column:
    return F.concat(F.lit("ENTITY:"), entity)


def event_key(event: Column) -> Column:
    return F.concat(F.lit("EVENT:"), event)


def series_key(kind: str, *names: Column) -> Column:
    return F.concat_ws(":", F.lit("TS"), F.lit(kind), *names)


def citations(answer: Column, with_series: bool = False) -> Column:
    """Every bracketed citation of the answer, repeats kept; those of readings only if asked for."""
    kinds = "DOC|ENTITY|EVENT|TS" if with_series else "DOC|ENTITY|EVENT"
    return F.regexp_extract_all(answer, F.lit(rf"\[((?:{kinds}):[^\]]+)\]"), 1)


def invalid_citations(cited: Column, valid: Column) -> Column:
    """Citations not among the valid ones; a citation made twice counts twice."""
    return F.filter(cited, lambda c: ~F.array_contains(valid, c))


def flat_lower(text: Column) -> Column:
    return collapse_ws(F.lower(text))


def not_empty(text: Column) -> Column:
    return strip(text) != ""


def section_flags(answer: Column, any_case: bool = False) -> dict[str, Column]:
    """Answer, evidence and uncertainty sections; exact spelling, or any case over collapsed text."""
    where = flat_lower(answer) if any_case else answer
    return {
        f"has_{n}_section": where.contains(f"{n}:" if any_case else f"{n.capitalize()}:")
        for n in ("answer", "evidence", "uncertainty")
    }


def grounding_flags(answer: Column) -> dict[str, Column]:
    """Flags of the grounding evaluation."""
    return {
        **section_flags(answer),
        "contains_insufficient_language": contains_any(F.lower(answer), INSUFFICIENT_PHRASES),
    }


def system_flags(answer: Column) -> dict[str, Column]:
    """Flags of the system benchmark."""
    low = flat_lower(answer)
    sections = [low.contains(s) for s in ("answer:", "evidence:", "assessment:", "uncertainty:")]
    return {
        "has_required_sections": sections[0] & sections[1] & sections[2] & sections[3],
        "has_uncertainty_language": contains_any(low, UNCERTAINTY_PHRASES),
        "contains_failure_language": contains_any(low, FAILURE_PHRASES),
        "has_non_empty_answer": not_empty(answer),
    }


def prediction_flags(answer: Column) -> dict[str, Column]:
    """Flags of the evaluation of a tuned model."""
    return {
        "non_empty_prediction": not_empty(answer),
        "grounding_guard_present": contains_any(flat_lower(answer), GUARD_PHRASES),
        **section_flags(answer),
    }


def comparison_flags(answer: Column) -> dict[str, Column]:
    """Flags of the comparison of two models."""
    return {
        "non_empty": not_empty(answer),
        **section_flags(answer, any_case=True),
        "has_grounding_guard": contains_any(flat_lower(answer), COMPARISON_GUARD_PHRASES),
    }


# --- chat messages ------------------------------------------------------------------------------------------------


def compact_json(value: Column) -> Column:
    """JSON text that keeps null fields."""
    return F.to_json(value, {"ignoreNullFields": "false"})


def prompt_text(messages: Column) -> Column:
    """Every message but the assistant's as ``ROLE: content`` blocks, then ``ASSISTANT:``."""
    blocks = F.transform(
        F.filter(messages, lambda m: F.coalesce(m["role"], F.lit("")) != "assistant"),
        lambda m: F.concat(
            F.upper(F.coalesce(m["role"], F.lit("user"))), F.lit(": "), F.coalesce(m["content"], F.lit(""))
        ),
    )
    return F.array_join(F.concat(blocks, F.array(F.lit("ASSISTANT:"))), "\n\n")


def reference_text(messages: Column) -> Column:
    """Content of the first assistant message, empty if there is none."""
    said = F.filter(messages, lambda m: m["role"] == "assistant")
    return F.coalesce(F.get(said, 0)["content"], F.lit(""))
