"""Git patches as tables, changed symbols by range joins, and rename plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import valid_identifier, whole_identifier
from ..schema import ACTIONABLE, CONTEXT_RELATIONS, InvalidRequest, NotFound
from .traverse import aggregate_impact, impact_many

_HUNK = r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@"


def parse_patches(patches: DataFrame, id_col: str = "patch_id", text_col: str = "patch") -> DataFrame:
    """(patch id, path, old_path, status, additions, deletions, ranges), one row a changed file.

    Ranges are (old_start, old_lines, new_start, new_lines); an omitted count is 1. Lines are
    numbered per patch, and a running count of ``diff --git`` lines tells the files apart.
    """
    lines = patches.select(F.col(id_col).alias("pid"), F.posexplode(F.split(text_col, "\n")).alias("n", "line"))
    w = Window.partitionBy("pid").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("file", F.sum(F.when(F.col("line").startswith("diff --git "), 1).otherwise(0)).over(w)).where("file > 0")
    lines = lines.withColumn("hunks", F.sum(F.when(F.col("line").rlike(_HUNK), 1).otherwise(0)).over(Window.partitionBy("pid", "file").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)))
    head = F.col("hunks") == 0

    def first(prefix: str) -> Column:
        return F.min(F.when(head & F.col("line").startswith(prefix), F.substring(F.col("line"), len(prefix) + 1, 1 << 20)))

    number = lambda k, default: F.when(F.regexp_extract("line", _HUNK, k) == "", default).otherwise(F.regexp_extract("line", _HUNK, k)).cast("int")
    hunk = F.when(F.col("line").rlike(_HUNK), F.struct(F.col("n"), number(1, "0").alias("old_start"), number(2, "1").alias("old_lines"), number(3, "0").alias("new_start"), number(4, "1").alias("new_lines")))
    inside = F.col("hunks") > 0
    files = lines.groupBy("pid", "file").agg(
        F.max(F.when(F.col("line").startswith("diff --git "), F.regexp_extract("line", r"^diff --git a/(.*) b/(.*)$", 2))).alias("git_path"),
        F.max(F.when(F.col("line").startswith("diff --git "), F.regexp_extract("line", r"^diff --git a/(.*) b/(.*)$", 1))).alias("git_old"),
        first("rename from ").alias("rename_from"), first("rename to ").alias("rename_to"),
        F.max((head & F.col("line").startswith("new file mode")).cast("int")).alias("added"), F.max((head & F.col("line").startswith("deleted file mode")).cast("int")).alias("deleted"),
        F.sum((inside & F.col("line").startswith("+")).cast("int")).alias("additions"), F.sum((inside & F.col("line").startswith("-")).cast("int")).alias("deletions"),
        F.array_sort(F.collect_list(hunk)).alias("ranges"),
    )
    return files.select(
        F.col("pid").alias(id_col), F.coalesce("rename_to", "git_path").alias("path"), F.coalesce("rename_from", "git_old").alias("old_path"),
        F.when(F.col("added") == 1, "added").when(F.col("deleted") == 1, "deleted").when(F.col("rename_from").isNotNull(), "renamed").otherwise("modified").alias("status"),
        "additions", "deletions", F.transform("ranges", lambda r: F.struct(r["old_start"].alias("old_start"), r["old_lines"].alias("old_lines"), r["new_start"].alias("new_start"), r["new_lines"].alias("new_lines"))).alias("ranges"),
    )


def changed_symbols(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """(id, label, name, path, status): actionable nodes whose lines meet a hunk of their file.

    Nodes match by the new path, by the old one where no node has the new. Nodes count lines from
    0, hunks from 1. A deleted file and a hunk without new lines use the old range; a hunk of no
    lines is one line long; a file without hunks matches all its symbols. Hunks and symbols of a
    file are sorted together once, and not compared pair by pair.
    """
    own = nodes.where(F.col("label").isin(sorted(ACTIONABLE))).select("id", "label", "name", F.col("file_path").alias("at"), (F.col("start_line") + 1).alias("s"), (F.coalesce("end_line", "start_line") + 1).alias("e"))
    by_new = files.select(F.col("path").alias("at"), "path", "status", "ranges")
    # paths of files are few beside nodes
    rest = files.join(own.join(F.broadcast(files.select(F.col("path").alias("at")).distinct()), "at", "left_semi").select(F.col("at").alias("path")).distinct(), "path", "left_anti")
    f = by_new.unionByName(rest.select(F.col("old_path").alias("at"), "path", "status", "ranges"))
    key = ["at", "path", "status"]
    r = f.select(*key, F.explode("ranges").alias("r")).select(*key, ((F.col("status") == "deleted") | (F.col("r.new_lines") == 0)).alias("old"), "r")
    start = F.when(F.col("old"), F.col("r.old_start")).otherwise(F.col("r.new_start"))
    size = F.greatest(F.when(F.col("old"), F.col("r.old_lines")).otherwise(F.col("r.new_lines")), F.lit(1))
    hunks = r.select(*key, start.alias("pos"), F.lit(0).alias("kind"), (start + size - 1).alias("reach"), *[F.lit(None).cast(own.schema[c].dataType).alias(c) for c in ("id", "label", "name", "s")])
    spans = own.join(F.broadcast(f.where(F.size("ranges") > 0).select(*key).distinct()), "at").select(*key, F.col("e").alias("pos"), F.lit(1).alias("kind"), F.lit(None).cast("int").alias("reach"), "id", "label", "name", "s")
    # a span meets a hunk if one of those that start at its end or before reaches its start
    w = Window.partitionBy(*key).orderBy("pos", "kind").rowsBetween(Window.unboundedPreceding, 0)
    met = hunks.unionByName(spans).withColumn("far", F.max("reach").over(w)).where("kind = 1 and far >= s")
    whole = own.join(F.broadcast(f.where(F.size("ranges") == 0).select(*key).distinct()), "at")
    return met.select("id", "label", "name", "path", "status").unionByName(whole.select("id", "label", "name", "path", "status")).distinct()


def diff_impact(nodes: DataFrame, edges: DataFrame, files: DataFrame, max_depth: int = 3, limit: int = 100) -> tuple[DataFrame, DataFrame]:
    """Changed symbols, and their dependants by (depth, falling confidence, id)."""
    changed = changed_symbols(nodes, files)
    found = aggregate_impact(impact_many(nodes, edges, changed.select("id"), max_depth), changed)
    return changed, found.orderBy("depth", F.desc("confidence"), "id").limit(limit)


def rename_conflicts(nodes: DataFrame, node: str, new_name: str) -> DataFrame:
    """(id, severity, scope): other symbols of the new name; in the same file they are errors."""
    own = nodes.where(F.col("id") == node).select("name", "file_path", "label").first()
    if own is None:
        raise NotFound(node)
    if own["label"] not in ACTIONABLE:
        raise InvalidRequest("only actionable symbols can be renamed")
    spark = nodes.sparkSession
    if new_name == own["name"] or not spark.range(1).where(valid_identifier(F.lit(new_name))).count():
        raise InvalidRequest(f"{new_name!r} is no new identifier")
    same = F.col("file_path") == F.lit(own["file_path"])
    return nodes.where((F.col("name") == new_name) & (F.col("id") != node) & F.col("label").isin(sorted(ACTIONABLE))).select("id", F.when(same, "error").otherwise("warning").alias("severity"), F.when(same, "file").otherwise("repository").alias("scope"))


def rename_references(nodes: DataFrame, edges: DataFrame, node: str) -> DataFrame:
    """(edge_type, id, name, file_path, start_line, end_line): symbols that refer to the node."""
    e = edges.where((F.col("target") == node) & F.col("type").isin(sorted(CONTEXT_RELATIONS))).select(F.col("type").alias("edge_type"), F.col("source").alias("id"))
    return e.join(nodes.where(F.col("label").isin(sorted(ACTIONABLE))).select("id", "name", "file_path", "start_line", "end_line"), "id").distinct()


def rename_occurrences(files: DataFrame, spans: DataFrame, name: str) -> DataFrame:
    """(path, line, kind, confidence): lines with the whole identifier, by the span that holds them.

    ``spans`` (path, start_line, end_line, kind) has ``declaration`` and ``semantic-reference``
    spans; a line (from 1) in none is a ``text-candidate``. Declaration goes before reference.
    """
    lines = files.select("path", F.posexplode(F.split("content", "\n")).alias("n", "text")).where(F.col("text").contains(name)).where(F.col("text").rlike(whole_identifier(name))).select("path", (F.col("n") + 1).alias("line"), "n")
    order = F.when(F.col("kind") == "declaration", 0).when(F.col("kind") == "semantic-reference", 1).otherwise(2)
    s = spans.select(F.col("path").alias("sp"), "start_line", "end_line", "kind")
    hit = lines.join(s, (F.col("path") == F.col("sp")) & F.col("n").between(F.col("start_line"), F.col("end_line")), "left")
    best = hit.groupBy("path", "line").agg(F.min(order).alias("k"))
    kind = F.when(F.col("k") == 0, "declaration").when(F.col("k") == 1, "semantic-reference").otherwise("text-candidate")
    return best.select("path", "line", kind.alias("kind"), F.when(F.col("k") == 0, 1.0).when(F.col("k") == 1, 0.9).otherwise(0.5).alias("confidence"))


def rename_plan(nodes: DataFrame, edges: DataFrame, files: DataFrame, node: str, new_name: str, limit: int = 200) -> dict:
    """Conflicts, references and occurrences of a rename, whether it is safe and needs review."""
    if not 1 <= limit <= 1000:
        raise InvalidRequest("limit must be 1 to 1000")
    conflicts = rename_conflicts(nodes, node, new_name)
    own = nodes.where(F.col("id") == node)
    refs = rename_references(nodes, edges, node)
    spans = own.select(F.col("file_path").alias("path"), "start_line", "end_line", F.lit("declaration").alias("kind")).unionByName(refs.select(F.col("file_path").alias("path"), "start_line", "end_line", F.lit("semantic-reference").alias("kind")))
    found = rename_occurrences(files, spans, own.first()["name"]).orderBy("path", "line").limit(limit + 1).collect()
    errors = conflicts.where("severity = 'error'").count()
    text = any(r["kind"] == "text-candidate" for r in found)
    return {
        "conflicts": [r.asDict() for r in conflicts.orderBy("severity", "id").limit(limit).collect()],
        "references": [r.asDict() for r in refs.orderBy("edge_type", "id").limit(limit).collect()],
        "occurrences": [r.asDict() for r in found[:limit]],
        "truncated": len(found) > limit, "requires_review": text or not found, "safe": not errors and bool(found),
    }


def enclosing(offsets: DataFrame, spans: DataFrame) -> DataFrame:
    """(key, node_id): for each (key, file_path, at) the innermost span: the last to start at or before it that ends at or after it.

    A span of up to 2^k units lies in one or two bins of that width, so spans join offsets by
    (file, k, bin), for the few values of k that occur. Equal starts go to the shorter span, then the id.
    """
    size = F.greatest(F.col("end") - F.col("start") + 1, F.lit(1)).cast("long")
    s = spans.where(F.col("end") >= F.col("start")).select(F.col("file_path").alias("sf"), "node_id", F.col("start").cast("long").alias("ss"), F.col("end").cast("long").alias("se"), F.ceil(F.log2(size)).cast("int").alias("k"))
    levels = sorted(r["k"] for r in s.select("k").distinct().collect())  # at most 64
    s = s.withColumn("bin", F.explode(F.array_distinct(F.array(F.expr("shiftright(ss, k)"), F.expr("shiftright(se, k)")))))
    o = offsets.select("key", "file_path", F.col("at").cast("long").alias("at"), F.explode(F.array(*[F.lit(k) for k in levels]) if levels else F.array().cast("array<int>")).alias("ok")).withColumn("obin", F.expr("shiftright(at, ok)"))
    hit = o.join(s, (F.col("file_path") == F.col("sf")) & (F.col("ok") == F.col("k")) & (F.col("obin") == F.col("bin")) & (F.col("ss") <= F.col("at")) & (F.col("se") >= F.col("at")))
    return hit.groupBy("key").agg(F.min(F.struct((-F.col("ss")).alias("a"), "se", "node_id")).alias("m")).select("key", F.col("m.node_id").alias("node_id"))
