"""Rewrites of a graph: first-writer-wins inserts, range-merging upserts, deletions with their edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_wins(rows: DataFrame, key: str = "id", order: str = "ord") -> DataFrame:
    """One row of each key, that of the smallest order (then of the smallest row)."""
    rest = [c for c in rows.columns if c not in (key, order)]
    return rows.groupBy(key).agg(F.min(F.struct(order, *rest)).alias("m")).select(key, *[F.col(f"m.{c}").alias(c) for c in (order, *rest)])


def merge_ranges(rows: DataFrame, key: str = "id", order: str = "ord") -> DataFrame:
    """One row of each key: the first one's columns, with the least start line and the greatest end line."""
    first = first_wins(rows, key, order).drop("start_line", "end_line")
    span = rows.groupBy(F.col(key).alias("span_key")).agg(F.min("start_line").alias("start_line"), F.max("end_line").alias("end_line"))
    return first.join(span, F.col(key) == F.col("span_key")).drop("span_key")


def drop_dangling(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The edges both of whose ends are nodes."""
    ids = nodes.select("id").distinct()
    return edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi").select(*edges.columns)


def delete_nodes(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges without the ids in ``gone``: the edges at either end go too."""
    ids = gone.select("id").distinct()
    kept = nodes.join(ids, "id", "left_anti").select(*nodes.columns)
    e = edges.join(ids.withColumnRenamed("id", "source"), "source", "left_anti").join(ids.withColumnRenamed("id", "target"), "target", "left_anti")
    return kept, e.select(*edges.columns)


def delete_where(nodes: DataFrame, edges: DataFrame, condition: Column) -> tuple[DataFrame, DataFrame]:
    """Deletes the nodes that meet a condition (of a file, of a label); nulls don't meet it."""
    return delete_nodes(nodes, edges, nodes.where(F.coalesce(condition, F.lit(False))))


def delete_edges(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """Edges without those ids; parallel edges stay."""
    return edges.join(gone.select("id").distinct(), "id", "left_anti").select(*edges.columns)


def lookup(nodes: DataFrame, ids: list[str]) -> DataFrame:
    """(pos, node columns) for a list of ids in its order; unknown ids are left out."""
    wanted = nodes.sparkSession.createDataFrame(list(enumerate(ids)), "pos long, id string")
    return wanted.join(nodes, "id").orderBy("pos")
