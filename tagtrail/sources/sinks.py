"""Writers: JSON lines, CSV and graph files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F, types as T

from tagtrail.operators import graph
from tagtrail.session import scratch_path

__all__ = ["scratch_path", "write_csv", "write_graph", "write_jsonl", "write_splits", "write_table"]


def write_jsonl(df: DataFrame, path: str, partition_by: Sequence[str] = (), compression: str = "none") -> None:
    """JSON lines; null fields are written."""
    df.write.mode("overwrite").partitionBy(*partition_by).option("ignoreNullFields", "false").json(path, compression=compression)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; fields of a struct become columns ``struct.field``, arrays JSON text."""
    columns = []
    for f in df.schema:
        if isinstance(f.dataType, T.StructType):
            columns += [F.col(f"`{f.name}`.`{g.name}`").alias(f"{f.name}.{g.name}") for g in f.dataType]
        elif isinstance(f.dataType, (T.ArrayType, T.MapType)):
            columns.append(F.to_json(f"`{f.name}`").alias(f.name))
        else:
            columns.append(F.col(f"`{f.name}`"))
    df.select(*columns).write.mode("overwrite").option("header", "true").csv(path)


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_graph(nodes: DataFrame, edges: DataFrame, path: str, compression: str = "none") -> None:
    """``nodes`` and ``edges`` as JSON lines; files in order of their names are in order of the element id.

    Edges that ``graph.exported_edges`` has made stand in that order and are written without another shuffle.
    """
    write_jsonl(graph.export_nodes(nodes).orderBy("element_id"), f"{path}/nodes", compression=compression)
    exported = edges if "element_id" in edges.columns else graph.export_edges(edges)
    write_jsonl(exported.orderBy("element_id"), f"{path}/edges", compression=compression)


def write_splits(split: DataFrame, path: str) -> None:
    """JSON lines in one folder per ``split``; its files in order of their names are in order of id."""
    write_jsonl(split.orderBy("split", "id"), path, ["split"])
