"""A property graph over the TPC-H-like tables, with the columns the engine's operators expect.

Regions are folders, nations packages, customers classes, suppliers interfaces, orders functions
and parts methods. ``GRAPH_SQL`` is the same graph in SQL, as common table expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, label, name, file_path, start_line, end_line, is_exported)."""

    def part(table: str, prefix: str, label: str, key: str, name: str) -> DataFrame:
        k = F.col(key).cast("long")
        return _table(spark, sf_dir, table).select(
            F.concat(F.lit(prefix + ":"), k).alias("id"), F.lit(label).alias("label"), F.expr(name).alias("name"), F.concat(F.lit(f"{table}/"), (k % 10).cast("string"), F.lit(".go")).alias("file_path"),
            (k * 10).cast("int").alias("start_line"), (k * 10 + 9).cast("int").alias("end_line"), (k % 2 == 0).alias("is_exported"),
        )

    parts = [
        part("region", "Region", "Folder", "r_regionkey", "r_name"),
        part("nation", "Nation", "Package", "n_nationkey", "n_name"),
        part("customer", "Customer", "Class", "c_custkey", "c_name"),
        part("supplier", "Supplier", "Interface", "s_suppkey", "s_name"),
        part("orders", "Order", "Function", "o_orderkey", "concat('order', o_orderkey)"),
        part("part", "Part", "Method", "p_partkey", "p_name"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, type, source, target, confidence)."""
    t = lambda name: _table(spark, sf_dir, name)
    ref = lambda prefix, key: F.concat(F.lit(prefix + ":"), F.expr(key).cast("long"))

    def edge(df: DataFrame, kind: str, source, target, confidence=None) -> DataFrame:
        return df.select(F.lit(kind).alias("type"), source.alias("source"), target.alias("target"), (F.lit(1.0) if confidence is None else confidence).alias("confidence"))

    line = t("lineitem")
    calls = line.groupBy("l_orderkey", "l_partkey").agg(F.round(F.max(1 - F.col("l_discount")), 6).alias("c"))
    imports = line.groupBy("l_partkey", "l_suppkey").agg(F.round(F.max(1 - F.col("l_tax")), 6).alias("c"))
    suppliers = t("supplier").agg(F.count("*").alias("suppliers"))
    parts = [
        edge(t("nation"), "CONTAINS", ref("Region", "n_regionkey"), ref("Nation", "n_nationkey")),
        edge(t("customer"), "CONTAINS", ref("Nation", "c_nationkey"), ref("Customer", "c_custkey")),
        edge(t("supplier"), "CONTAINS", ref("Nation", "s_nationkey"), ref("Supplier", "s_suppkey")),
        edge(t("orders"), "DEFINES", ref("Customer", "o_custkey"), ref("Order", "o_orderkey")),
        edge(calls, "CALLS", ref("Order", "l_orderkey"), ref("Part", "l_partkey"), F.col("c")),
        edge(imports, "IMPORTS", ref("Part", "l_partkey"), ref("Supplier", "l_suppkey"), F.col("c")),
        edge(t("part").where("p_partkey >= 1"), "EXTENDS", ref("Part", "p_partkey"), ref("Part", "(p_partkey - 1) div 2")),
        edge(t("part").crossJoin(F.broadcast(suppliers)), "IMPLEMENTS", ref("Part", "p_partkey"), ref("Supplier", "p_partkey % suppliers")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(F.concat_ws("|", "type", "source", "target").alias("id"), "type", "source", "target", "confidence")


def planted_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges with defects for the checks: dangling ends, self loops, rings of five customers, and an import ring of the suppliers of each nation."""
    c = _table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("k"))
    s = _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("k"))
    ring = c.select(F.lit("EXTENDS").alias("type"), F.concat(F.lit("Customer:"), F.col("k")).alias("source"), F.concat(F.lit("Customer:"), F.expr("k div 5 * 5 + (k + 1) % 5")).alias("target"), F.lit(1.0).alias("confidence"))
    chain = s.select(F.lit("IMPORTS").alias("type"), F.concat(F.lit("Supplier:"), F.col("k")).alias("source"), F.concat(F.lit("Supplier:"), F.expr("k div 3 * 3 + (k + 1) % 3")).alias("target"), F.expr("cast(k % 10 as double) / 10").alias("confidence"))
    loops = s.select(F.lit("IMPLEMENTS").alias("type"), F.concat(F.lit("Supplier:"), F.col("k")).alias("source"), F.concat(F.lit("Supplier:"), F.expr("k - k % 2")).alias("target"), F.lit(0.9).alias("confidence"))
    dangling = s.select(F.lit("CALLS").alias("type"), F.concat(F.lit("Supplier:"), F.col("k")).alias("source"), F.concat(F.lit("Ghost:"), F.col("k")).alias("target"), F.lit(0.5).alias("confidence"))
    out = ring.unionByName(chain).unionByName(loops).unionByName(dangling)
    return out.select(F.concat_ws("|", "type", "source", "target").alias("id"), "type", "source", "target", "confidence")


def _node_sql(table: str, prefix: str, label: str, key: str, name: str) -> str:
    return f"SELECT '{prefix}:' || {key} AS id, '{label}' AS label, {name} AS name, '{table}/' || ({key} % 10) || '.go' AS file_path, ({key} * 10)::INT AS start_line, ({key} * 10 + 9)::INT AS end_line, {key} % 2 = 0 AS is_exported FROM {table}"


NODES_SQL = "nodes AS (" + " UNION ALL ".join([
    _node_sql("region", "Region", "Folder", "r_regionkey", "r_name"), _node_sql("nation", "Nation", "Package", "n_nationkey", "n_name"), _node_sql("customer", "Customer", "Class", "c_custkey", "c_name"),
    _node_sql("supplier", "Supplier", "Interface", "s_suppkey", "s_name"), _node_sql("orders", "Order", "Function", "o_orderkey", "'order' || o_orderkey"), _node_sql("part", "Part", "Method", "p_partkey", "p_name"),
]) + ")"

EDGES_SQL = """edges AS (SELECT type || '|' || source || '|' || target AS id, * FROM (
    SELECT 'CONTAINS' AS type, 'Region:' || n_regionkey AS source, 'Nation:' || n_nationkey AS target, 1.0::DOUBLE AS confidence FROM nation
    UNION ALL SELECT 'CONTAINS', 'Nation:' || c_nationkey, 'Customer:' || c_custkey, 1.0 FROM customer
    UNION ALL SELECT 'CONTAINS', 'Nation:' || s_nationkey, 'Supplier:' || s_suppkey, 1.0 FROM supplier
    UNION ALL SELECT 'DEFINES', 'Customer:' || o_custkey, 'Order:' || o_orderkey, 1.0 FROM orders
    UNION ALL SELECT 'CALLS', 'Order:' || l_orderkey, 'Part:' || l_partkey, round(max(1 - l_discount), 6) FROM lineitem GROUP BY l_orderkey, l_partkey
    UNION ALL SELECT 'IMPORTS', 'Part:' || l_partkey, 'Supplier:' || l_suppkey, round(max(1 - l_tax), 6) FROM lineitem GROUP BY l_partkey, l_suppkey
    UNION ALL SELECT 'EXTENDS', 'Part:' || p_partkey, 'Part:' || ((p_partkey - 1) // 2), 1.0 FROM part WHERE p_partkey >= 1
    UNION ALL SELECT 'IMPLEMENTS', 'Part:' || p_partkey, 'Supplier:' || (p_partkey % (SELECT count(*) FROM supplier)), 1.0 FROM part))"""

PLANTED_SQL = """planted AS (SELECT type || '|' || source || '|' || target AS id, * FROM (
    SELECT 'EXTENDS' AS type, 'Customer:' || c_custkey AS source, 'Customer:' || (c_custkey // 5 * 5 + (c_custkey + 1) % 5) AS target, 1.0::DOUBLE AS confidence FROM customer
    UNION ALL SELECT 'IMPORTS', 'Supplier:' || s_suppkey, 'Supplier:' || (s_suppkey // 3 * 3 + (s_suppkey + 1) % 3), (s_suppkey % 10)::DOUBLE / 10 FROM supplier
    UNION ALL SELECT 'IMPLEMENTS', 'Supplier:' || s_suppkey, 'Supplier:' || (s_suppkey - s_suppkey % 2), 0.9 FROM supplier
    UNION ALL SELECT 'CALLS', 'Supplier:' || s_suppkey, 'Ghost:' || s_suppkey, 0.5 FROM supplier))"""

GRAPH_SQL = NODES_SQL + ", " + EDGES_SQL
