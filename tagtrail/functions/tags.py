"""Tag names: family, sensor class and confidence."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Instrument families in matching order and their sensor classes.
FAMILIES = ["PDI", "PI", "TI", "XI", "ZI", "SI"]
SENSOR_CLASSES = {
    "PI": "PressureSensor",
    "PDI": "DifferentialPressureSensor",
    "TI": "TemperatureSensor",
    "SI": "SpeedSensor",
    "XI": "PositionOrDisplacementSensor",
    "ZI": "PositionSensor",
}
KNOWN_CONFIDENCE, UNKNOWN_CONFIDENCE = 0.70, 0.40


def family_by_pattern(tag: Column) -> Column:
    """Family that follows a run of digits anywhere in the tag, else null."""
    return F.nullif(F.regexp_extract(F.upper(tag), r"\d+(PDI|PI|TI|XI|ZI|SI)", 1), F.lit(""))


def family_by_pattern_or_prefix(tag: Column) -> Column:
    """As ``family_by_pattern``, else the family the tag starts with; so ``Timestamp`` is TI."""
    starts = [F.when(F.upper(tag).startswith(f), f) for f in FAMILIES]
    return F.coalesce(family_by_pattern(tag), *starts)


def family_by_substring(tag: Column) -> Column:
    """First family, in matching order, that occurs anywhere in the tag."""
    return F.coalesce(*(F.when(F.upper(tag).contains(f), f) for f in FAMILIES))


def sensor_class(family: Column, unknown: Column | None = None) -> Column:
    """Class of a family; ``unknown`` (default ``Sensor``) for a family without one."""
    table = F.create_map(*(F.lit(x) for pair in SENSOR_CLASSES.items() for x in pair))
    return F.coalesce(F.try_element_at(table, family), F.lit("Sensor") if unknown is None else unknown)


def class_confidence(family: Column) -> Column:
    return F.when(family.isNotNull(), F.lit(KNOWN_CONFIDENCE)).otherwise(F.lit(UNKNOWN_CONFIDENCE))
