"""Grounding checks of answers, pass rates, model comparison and consistency of the data products."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tagtrail.functions import citations as c


def citation_checks(answers: DataFrame, shown: DataFrame, case: str, keys: Sequence[str], with_series: bool = False) -> DataFrame:
    """Citation counts of each answer against what its case was shown ``(case, key)``.

    Citations meet the shown keys in an equality join, so neither side is gathered per case.
    """
    cited = answers.select(*keys, F.explode(c.citations(F.col("answer"), with_series)).alias("key"))
    found = (
        cited.join(shown.select(case, "key", F.lit(True).alias("known")).distinct(), [case, "key"], "left")
        .groupBy(*keys)
        .agg(
            F.count("*").alias("citation_count"),
            F.count("known").alias("valid_citation_count"),
            F.array_sort(F.collect_list(F.when(F.col("known").isNull(), F.col("key")))).alias("invalid_citations"),
        )
    )
    total, valid = F.coalesce("citation_count", F.lit(0)), F.coalesce("valid_citation_count", F.lit(0))
    return answers.join(found, list(keys), "left").select(
        *answers.columns,
        total.alias("citation_count"), valid.alias("valid_citation_count"), (total - valid).alias("invalid_citation_count"),
        F.coalesce("invalid_citations", F.array().cast("array<string>")).alias("invalid_citations"),
        (total == valid).alias("citation_grounding_pass"),
    )


def shown_counts(shown: DataFrame, case: str) -> DataFrame:
    """Documents, entities and events each case was shown."""

    def kind(prefix: str, name: str) -> Column:
        return F.count_if(F.col("key").startswith(prefix)).alias(name)

    return shown.groupBy(case).agg(
        kind("DOC:", "document_count"), kind("ENTITY:", "entity_count"), kind("EVENT:", "event_count")
    )


def _with_shown(checked: DataFrame, shown: DataFrame, case: str) -> DataFrame:
    """Counts of what the case was shown; a case that was shown nothing has zeros."""
    names = ["document_count", "entity_count", "event_count"]
    joined = checked.join(shown_counts(shown, case), case, "left")
    return joined.withColumns({n: F.coalesce(n, F.lit(0)) for n in names})


def grounding_evaluation(answers: DataFrame, shown: DataFrame, case: str, keys: Sequence[str]) -> DataFrame:
    """Citations, sections, insufficiency language and retrieval counts per answer; review fields stay null."""
    checked = citation_checks(answers, shown, case, keys)
    return _with_shown(checked, shown, case).withColumns(c.grounding_flags(F.col("answer")))


def system_evaluation(answers: DataFrame, shown: DataFrame, case: str, keys: Sequence[str]) -> DataFrame:
    """As ``grounding_evaluation`` with the benchmark's flags; citations of readings count and are never valid."""
    checked = citation_checks(answers, shown, case, keys, with_series=True)
    return _with_shown(checked, shown, case).withColumns(c.system_flags(F.col("answer")))


def prediction_evaluation(answers: DataFrame) -> DataFrame:
    """The checks of a tuned model's answers; ``required_structure`` holds if all three sections are there."""
    return with_structure(answers.withColumns(c.prediction_flags(F.col("answer"))))


def with_structure(checked: DataFrame) -> DataFrame:
    sections = F.col("has_answer_section") & F.col("has_evidence_section") & F.col("has_uncertainty_section")
    return checked.withColumn("required_structure", sections)


def retrieval_summary(checked: DataFrame, scores: DataFrame, case: str) -> DataFrame:
    """One row: the mean of the best document score over the cases that have one, mean documents and entities per row.

    ``scores`` holds ``(case, score)``, any number per case.
    """
    top = scores.groupBy(case).agg(F.max("score").alias("top_document_score"))

    def mean(name: str, out: str) -> Column:
        return F.coalesce(F.avg(name), F.lit(0.0)).alias(out)

    return checked.join(top, case, "left").agg(
        mean("top_document_score", "average_top_document_score"), mean("document_count", "average_documents"),
        mean("entity_count", "average_entities"),
    )


def pass_rates(rows: DataFrame, flags: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Share of rows on which each flag holds, and the number of rows; 0.0 for an empty table."""
    rates = [F.coalesce(F.avg(F.coalesce(F.col(f), F.lit(False)).cast("int")), F.lit(0.0)).alias(f"{f}_rate") for f in flags]
    return rows.groupBy(*by).agg(F.count("*").alias("cases"), *rates)


def model_checks(answers: DataFrame, models: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """One row per example and model from a table with one answer column per model."""
    long = answers.unpivot(list(keys), list(models), "model", "answer")
    return long.withColumns(c.comparison_flags(F.coalesce("answer", F.lit(""))))


def model_comparison(checked: DataFrame) -> DataFrame:
    """Rates of every check, one row per check and one column per model."""
    flags = ["non_empty", "has_answer_section", "has_evidence_section", "has_uncertainty_section", "has_grounding_guard"]
    rates = pass_rates(checked, flags, ["model"])
    return rates.unpivot(["model"], [f"{f}_rate" for f in flags], "check", "rate")


def consistency_checks(
    vectors: DataFrame, metadata: DataFrame, validation: DataFrame, examples: DataFrame, parts: dict[str, DataFrame]
) -> DataFrame:
    """``check, passed, detail``: index and metadata agree, reports passed, no bad example, no required part empty.

    ``validation`` has one row with ``status``; ``examples`` has ``status`` per example.
    """
    both = vectors.select("chunk_id", F.lit(True).alias("v")).join(
        metadata.select("chunk_id", F.lit(True).alias("m")), "chunk_id", "full_outer"
    )

    def row(df: DataFrame, name: str, count: Column) -> DataFrame:
        n = df.agg(count.alias("detail"))
        return n.select(F.lit(name).alias("check"), (F.col("detail") == 0).alias("passed"), "detail")

    out = row(both, "vectors_match_metadata", F.count_if(F.col("v").isNull() | F.col("m").isNull()))
    out = out.unionByName(row(validation, "knowledge_validation_passed", F.count_if(F.col("status") != "passed")))
    out = out.unionByName(row(examples, "no_invalid_examples", F.count_if(F.col("status") != "passed")))
    for name, df in parts.items():
        empty = df.limit(1).agg((F.count("*") == 0).cast("bigint").alias("detail"))
        out = out.unionByName(
            empty.select(F.lit(f"has_{name}").alias("check"), (F.col("detail") == 0).alias("passed"), "detail")
        )
    return out
