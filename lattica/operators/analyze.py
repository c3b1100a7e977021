"""Neighbourhood context, structural checks, strongly connected components, degrees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..checkpoints import cut
from ..schema import CONTEXT_RELATIONS, IMPACT_RELATIONS, INHERITANCE, NO_SELF, InvalidRequest, relations

SEVERITIES = ("error", "warning", "info")
#: Lines of a file that are one row where excerpts are cut.
BLOCK = 1024


def context(nodes: DataFrame, edges: DataFrame, node: str, types=None, limit: int = 100) -> DataFrame:
    """(direction, edge_id, edge_type, neighbour, label, name, confidence), both ways, one hop.

    Ordered by relation, direction, neighbour; an edge counts once a direction; neighbours that
    are no nodes are dropped.
    """
    if not 1 <= limit <= 1000:
        raise InvalidRequest("limit must be 1 to 1000")
    e = edges.where(F.col("type").isin(sorted(relations(types, CONTEXT_RELATIONS))))
    out = e.where(F.col("source") == node).select(F.lit("out").alias("direction"), F.col("id").alias("edge_id"), F.col("type").alias("edge_type"), F.col("target").alias("neighbour"), "confidence")
    into = e.where(F.col("target") == node).select(F.lit("in").alias("direction"), F.col("id").alias("edge_id"), F.col("type").alias("edge_type"), F.col("source").alias("neighbour"), "confidence")
    both = out.unionByName(into).dropDuplicates(["direction", "edge_id"])
    return both.join(nodes.select(F.col("id").alias("neighbour"), "label", "name"), "neighbour").orderBy("edge_type", "direction", "neighbour", "edge_id").limit(limit).select("direction", "edge_id", "edge_type", "neighbour", "label", "name", "confidence")


def file_blocks(files: DataFrame) -> DataFrame:
    """(path, block, content): whole files (path, content) in blocks of ``BLOCK`` lines, numbered from 0."""
    size = F.lit(BLOCK)
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size("lines") - 1) / size).cast("int")), lambda k: F.array_join(F.slice("lines", k * size + 1, size), "\n"))
    # lines that a generator reads are split once
    return files.where("content is not null").select("path", F.split("content", "\n").alias("lines")).select("path", F.posexplode(blocks).alias("block", "content"))


def excerpt(files: DataFrame, nodes: DataFrame, max_lines: int = 200) -> DataFrame:
    """(id, excerpt): the lines of each node's span in its file; lines are 0-based, spans inclusive.

    ``files`` are whole (path, content), or blocks of ``BLOCK`` lines (path, block, content) where a
    file is longer than a row can be. A block meets the spans of its own lines only; what a span has
    in several blocks is put together again.
    """
    size = F.lit(BLOCK)
    end = F.least(F.greatest(F.coalesce("end_line", "start_line"), F.col("start_line")), F.col("start_line") + max_lines - 1)
    n = nodes.where(F.col("start_line").isNotNull() & (F.col("start_line") >= 0)).select("id", F.col("file_path").alias("path"), "start_line", end.alias("end_line"))
    number = lambda c: F.floor(F.col(c) / size).cast("int")
    spans = n.select("id", "path", "start_line", "end_line", F.explode(F.sequence(number("start_line"), number("end_line"))).alias("block"))
    spans = spans.groupBy("path", "block").agg(F.collect_list(F.struct("id", "start_line", "end_line")).alias("spans"))
    pieces = files if "block" in files.columns else file_blocks(files)
    own = pieces.select("path", "block", "content").join(spans.hint("shuffle_hash"), ["path", "block"]).select("path", "block", F.array(F.split("content", "\n")).alias("files"), "spans")

    def cut_out(lines: Column, s: Column) -> Column:
        first = F.greatest(s["start_line"] - F.col("block") * size, F.lit(0))
        last = F.least(s["end_line"] - F.col("block") * size, size - 1)
        text = F.when(first < F.size(lines), F.array_join(F.slice(lines, first + 1, last - first + 1), "\n"))
        return F.struct(s["id"].alias("id"), s["start_line"].alias("start_line"), s["end_line"].alias("end_line"), text.alias("text"))

    # the outer transform binds the lines, which would else be split again for each span
    found = own.select("path", "block", F.explode(F.flatten(F.transform("files", lambda lines: F.transform("spans", lambda s: cut_out(lines, s))))).alias("x")).select("path", "block", "x.*").where("text is not null")
    whole = found.groupBy("id", "path", "start_line", "end_line").agg(F.collect_list(F.struct("block", "text")).alias("parts"))
    # a node that occurs twice has each of its parts twice
    begun = F.size(F.filter("parts", lambda x: x["block"] == F.floor(F.col("start_line") / size)))
    text = F.array_join(F.transform(F.array_sort(F.array_distinct("parts")), lambda x: x["text"]), "\n")
    return whole.where(begun > 0).select("id", text.alias("text"), begun.alias("times")).select("id", F.explode(F.array_repeat("text", F.col("times"))).alias("excerpt"))


def endpoint_findings(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(severity, code, message, edge_id): dangling ends and forbidden self-dependencies.

    An edge is dangling when either of its ends is no node.
    """
    ids = nodes.select(F.col("id").alias("node_id"))
    missing = edges.join(ids, edges["source"] == F.col("node_id"), "left_anti").select("id").unionByName(edges.join(ids, edges["target"] == F.col("node_id"), "left_anti").select("id")).distinct()
    dangling = missing.select(F.lit("error").alias("severity"), F.lit("DANGLING_EDGE").alias("code"), F.concat(F.lit("edge "), F.col("id"), F.lit(" has no node at an end")).alias("message"), F.col("id").alias("edge_id"))
    loops = edges.where((F.col("source") == F.col("target")) & F.col("type").isin(sorted(NO_SELF))).select(F.lit("error").alias("severity"), F.lit("INVALID_SELF_DEPENDENCY").alias("code"), F.concat(F.col("type"), F.lit(" from "), F.col("source"), F.lit(" to itself")).alias("message"), F.col("id").alias("edge_id"))
    return dangling.unionByName(loops)


def low_confidence(edges: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Impact relations of a confidence under the threshold; a threshold of 0 means the default."""
    least = threshold or 0.7
    return edges.where((F.col("confidence") < least) & F.col("type").isin(sorted(IMPACT_RELATIONS))).select(F.lit("info").alias("severity"), F.lit("LOW_CONFIDENCE_RELATION").alias("code"), F.concat(F.col("type"), F.lit(" "), F.col("source"), F.lit(" -> "), F.col("target")).alias("message"), F.col("id").alias("edge_id"))


def components(edges: DataFrame) -> DataFrame:
    """(id, component): strongly connected components of more than one node, named by their least member.

    Nodes without an edge on either side are trimmed while that takes a fifth of the edges. Each round gives the nodes a new random order, and every node the first of all that reach it and
    the first of all that it reaches. Where these are the same, its nodes are one component and leave.
    Of the rest, only edges between nodes with the same two firsts can lie in a component and go
    another round. Chains fall apart at random places, so rounds grow with the logarithm of lengths.
    """
    e = cut(edges.select("source", "target").where("source <> target").distinct())
    done, turn, size = None, 0, e.count()
    while size:
        e, size = _trim(e, size)
        if not size:
            break
        turn += 1
        ahead, behind = _spread(e, turn), _spread(e.select(F.col("target").alias("source"), F.col("source").alias("target")), turn)
        both = cut(ahead.join(behind.withColumnRenamed("m", "b"), "id"))
        found = both.where("m = b")
        own = cut(found.join(found.groupBy("m").agg(F.min("id").alias("component"), F.count("*").alias("n")).where("n > 1"), "m").select("id", "component"))
        done = own if done is None else done.unionByName(own)
        rest = both.where("m <> b").select("id", F.struct("m", "b").alias("m"))
        e = cut(_within(e, rest))
        size = e.count()
    return done if done is not None else edges.sparkSession.createDataFrame([], "id string, component string")


def _trim(e: DataFrame, size: int) -> tuple[DataFrame, int]:
    """The edges from nodes with an edge in to nodes with an edge out, and their number."""
    while size:
        starts, ends = e.select(F.col("source").alias("id")).distinct(), e.select(F.col("target").alias("id")).distinct()
        e = cut(e.join(ends.withColumnRenamed("id", "source"), "source", "left_semi").join(starts.withColumnRenamed("id", "target"), "target", "left_semi"))
        before, size = size, e.count()
        if size > 0.8 * before:
            break
    return e, size


def _within(e: DataFrame, m: DataFrame) -> DataFrame:
    """The edges whose ends have equal marks (id, m)."""
    return e.join(m.select(F.col("id").alias("source"), F.col("m").alias("ms")), "source").join(m.select(F.col("id").alias("target"), F.col("m").alias("mt")), "target").where("ms = mt").select("source", "target")


def _spread(e: DataFrame, turn: int) -> DataFrame:
    """(id, m): the first node, in the turn's random order, among a node and all that reach it.

    The first of a node's first reaches it too: that hop halves the distances left in each round.
    """
    first = F.struct(F.xxhash64(F.lit(turn), "id").alias("h"), F.col("id").alias("i"))
    m = cut(e.select(F.col("source").alias("id")).unionByName(e.select(F.col("target").alias("id"))).distinct().withColumn("m", first))
    while True:
        got = e.join(m.select(F.col("id").alias("source"), F.col("m").alias("ms")), "source").groupBy(F.col("target").alias("id")).agg(F.min("ms").alias("ms"))
        near = m.join(got, "id", "left").select("id", "m", F.least("m", F.coalesce("ms", "m")).alias("n"))
        hop = m.select(F.col("id").alias("i"), F.col("m").alias("mm"))
        nxt = cut(near.withColumn("i", F.col("n.i")).join(hop, "i").select("id", F.least("n", "mm").alias("m"), (F.least("n", "mm") < F.col("m")).alias("moved")))
        if nxt.where("moved").isEmpty():
            return nxt.select("id", F.col("m.i").alias("m"))
        m = nxt.select("id", "m")


def cycle_findings(edges: DataFrame) -> DataFrame:
    """(severity, code, message, members): inheritance cycles are errors, import cycles warnings; up to 20 members."""

    def of(types, severity: str, code: str) -> DataFrame:
        c = components(edges.where(F.col("type").isin(sorted(types))))
        return c.groupBy("component").agg(F.slice(F.array_sort(F.collect_list("id")), 1, 20).alias("members"), F.count("*").alias("size")).select(
            F.lit(severity).alias("severity"), F.lit(code).alias("code"), F.concat(F.col("size").cast("string"), F.lit(" nodes from "), F.col("component")).alias("message"), "members")

    return of(INHERITANCE, "error", "INHERITANCE_CYCLE").unionByName(of({"IMPORTS"}, "warning", "IMPORT_CYCLE"))


def rank(severity: Column | str) -> Column:
    c = F.col(severity) if isinstance(severity, str) else severity
    return F.when(c == "error", 0).when(c == "warning", 1).otherwise(2)


def check(nodes: DataFrame, edges: DataFrame, checks=("integrity", "cycles"), threshold: float = 0.7, limit: int = 100) -> tuple[DataFrame, DataFrame]:
    """The first ``limit`` findings by severity, code and message, and the counts of all by severity."""
    known = {"integrity", "cycles", "confidence"}
    wanted = {c.strip().lower() for c in checks} or {"integrity", "cycles"}
    if wanted - known:
        raise InvalidRequest(f"unknown checks {sorted(wanted - known)}")
    cols = ("severity", "code", "message")
    parts = []
    if "integrity" in wanted:
        parts.append(endpoint_findings(nodes, edges).select(*cols))
    if "cycles" in wanted:
        parts.append(cycle_findings(edges).select(*cols))
    if "confidence" in wanted:
        parts.append(low_confidence(edges, threshold).select(*cols))
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    return found.orderBy(rank("severity"), "code", "message").limit(limit), summary(found)


def summary(found: DataFrame) -> DataFrame:
    return found.groupBy("severity").agg(F.count("*").alias("findings"))


def degrees(edges: DataFrame, types=("CALLS",)) -> DataFrame:
    """(id, callees, callers): out and in degrees of every node with an edge of the types."""
    e = edges.where(F.col("type").isin(sorted(types)))
    ends = e.select(F.col("source").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(e.select(F.col("target").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return ends.groupBy("id").agg(F.sum("o").alias("callees"), F.sum("i").alias("callers"))


def simple_cycles(edges: DataFrame, max_length: int | None = None) -> DataFrame:
    """(members): elementary cycles, of up to ``max_length`` nodes if that is given, from their least member on.

    Paths grow inside strongly connected components only. A cycle whose members include those of a
    shorter one is left out, as is usual for reports.
    """
    c = components(edges)
    inner = cut(edges.select("source", "target").where("source <> target").distinct().join(c.select(F.col("id").alias("source"), F.col("component").alias("cs")), "source").join(c.select(F.col("id").alias("target"), F.col("component").alias("ct")), "target").where("cs = ct").select("source", "target"))
    paths = inner.where("source < target").select(F.array("source", "target").alias("p"), F.col("target").alias("last"))
    found, length = None, 1
    while max_length is None or length < max_length:
        length += 1
        grown = cut(paths.join(inner, F.col("last") == F.col("source")).select("p", F.col("target").alias("next")))
        closed = grown.where(F.col("next") == F.element_at("p", 1)).select(F.col("p").alias("members"))
        found = closed if found is None else found.unionByName(closed)
        paths = grown.where((F.col("next") > F.element_at("p", 1)) & ~F.array_contains("p", F.col("next"))).select(F.concat("p", F.array("next")).alias("p"), F.col("next").alias("last"))
        if paths.isEmpty():
            break
    if found is None:
        return inner.sparkSession.createDataFrame([], "members array<string>")
    found = cut(found.distinct())
    smaller = found.select(F.col("members").alias("s")).alias("b")
    return found.alias("a").join(smaller, (F.size("s") < F.size("members")) & (F.size(F.array_except("s", "members")) == 0), "left_anti").orderBy(F.size("members"), "members")
