"""The public facade: one method an operation, DataFrames in and out."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .checkpoints import cut
from .functions.chunk import chunks
from .operators import analyze, community, diff, mro, resolve, search, traverse
from .schema import CONTEXT_RELATIONS, EMBEDDABLE, SYMBOLS, Closed, InvalidRequest, NotFound, VectorsMissing
from .sources import repository
from .sources.store import Store, export_csv, export_inspection


@dataclass(frozen=True)
class Options:
    traversal_limit: int = 100_000
    chunk_size: int = 1200
    chunk_overlap: int = 120
    snippet_bytes: int = 500


@dataclass
class Metrics:
    """Counts of the driver's calls; reads and writes count tables, as nobody counts rows one by one here."""

    index_total: int = 0
    index_success: int = 0
    index_fail: int = 0
    drop_total: int = 0
    reindex_total: int = 0
    reindex_success: int = 0
    reindex_fail: int = 0
    impact_queries: int = 0
    search_queries: int = 0
    context_queries: int = 0
    rename_queries: int = 0
    node_reads: int = 0
    edge_reads: int = 0
    node_writes: int = 0
    edge_writes: int = 0
    errors: int = 0


@dataclass
class Engine:
    spark: SparkSession
    root: str
    options: Options = field(default_factory=Options)

    def __post_init__(self) -> None:
        self.store, self.metrics, self._embedders, self._open = Store(self.spark, self.root), Metrics(), {}, True

    # ---- life cycle
    def close(self) -> None:
        self._open = False

    def ping(self) -> bool:
        if not self._open:
            raise Closed("engine is closed")
        return self.spark.range(1).count() == 1

    def _table(self, repo: str, table: str) -> DataFrame:
        if not self._open:
            raise Closed("engine is closed")
        if table in ("nodes", "edges"):
            self._count(f"{table[:-1]}_reads")
        return self.store.read(repo, table)

    def _count(self, *names: str) -> None:
        for n in names:
            setattr(self.metrics, n, getattr(self.metrics, n) + 1)

    def get_metrics(self) -> dict[str, int]:
        """A copy of the counters."""
        return dict(vars(self.metrics))

    def list_repos(self) -> list[str]:
        return self.store.list()

    def delete_repo(self, repo: str) -> None:
        self._embedders.pop(repo, None)
        self.store.delete(repo)
        self._count("drop_total")

    def index_repo(self, path: str, name: str, replace: bool = False) -> str:
        """Reads a source folder, builds its graph and publishes a snapshot. Vectors must be built anew."""
        if not self._open:
            raise Closed("engine is closed")
        again = replace and name.strip() in self.store.list()
        self._count("index_total", *(["reindex_total"] if again else []))
        try:
            files = repository.read_files(self.spark, path)
            nodes, edges = build_graph(files)
            searchable = repository.read_files(self.spark, path, filtered=False).where("kind is not null").where(~F.exists(F.split("path", "/"), lambda x: x.isin(".git", "node_modules", "vendor", "__pycache__", ".venv", "venv")))
            nodes = cut(nodes)
            out = self.store.publish(name, {"nodes": nodes, "edges": edges, "files": searchable, **search_tables(nodes)}, replace)
        except BaseException:
            self._count("index_fail", "errors", *(["reindex_fail"] if again else []))
            raise
        self._embedders.pop(name, None)
        self._count("index_success", "node_writes", "edge_writes", *(["reindex_success"] if again else []))
        return out

    def publish(self, name: str, nodes: DataFrame, edges: DataFrame, files: DataFrame | None = None, replace: bool = False) -> str:
        """Publishes a graph that was built elsewhere."""
        return self.store.publish(name, {"nodes": nodes, "edges": edges, **search_tables(nodes), **({"files": files} if files is not None else {})}, replace)

    # ---- graph
    def traverse(self, repo: str, node: str, direction: str = "out", max_depth: int = 1, types=None) -> DataFrame:
        nodes = self._table(repo, "nodes")
        start = nodes.where(F.col("id") == node).select("id")
        if start.isEmpty():
            raise NotFound(node)
        found = traverse.bfs(self._table(repo, "edges"), start, max_depth, direction, types, limit=self.options.traversal_limit)
        return found.join(nodes.select("id", "label", "name", "file_path"), "id")

    def shortest_path(self, repo: str, source: str, target: str) -> DataFrame:
        return traverse.shortest_path(self._table(repo, "edges"), source, target)

    def context(self, repo: str, node: str, types=None, limit: int = 100) -> DataFrame:
        self._count("context_queries")
        nodes = self._table(repo, "nodes")
        if nodes.where(F.col("id") == node).isEmpty():
            raise NotFound(node)
        return analyze.context(nodes, self._table(repo, "edges"), node, types, limit)

    def excerpt(self, repo: str, node: str) -> DataFrame:
        return analyze.excerpt(self._table(repo, "files"), self._table(repo, "nodes").where(F.col("id") == node))

    def impact(self, repo: str, node: str, max_depth: int = 3, limit: int = 100, types=None) -> DataFrame:
        self._count("impact_queries")
        return traverse.impact(self._table(repo, "nodes"), self._table(repo, "edges"), node, max_depth, limit, types)

    def check(self, repo: str, checks=("integrity", "cycles"), threshold: float = 0.7, limit: int = 100) -> tuple[DataFrame, DataFrame]:
        return analyze.check(self._table(repo, "nodes"), self._table(repo, "edges"), checks, threshold, limit)

    def diff(self, repo: str, patch: DataFrame, max_depth: int = 3, limit: int = 100) -> tuple[DataFrame, DataFrame]:
        return diff.diff_impact(self._table(repo, "nodes"), self._table(repo, "edges"), diff.parse_patches(patch), max_depth, limit)

    def rename(self, repo: str, node: str, new_name: str, limit: int = 200) -> dict:
        self._count("rename_queries")
        files = self._table(repo, "files").where(F.col("kind").isin("code", "config"))
        return diff.rename_plan(self._table(repo, "nodes"), self._table(repo, "edges"), files, node, new_name, limit)

    # ---- search
    def search(self, repo: str, query: str, limit: int = 20) -> DataFrame:
        if not repo or not (query or "").strip():
            raise InvalidRequest("repository and query are needed")
        self._count("search_queries")
        return search.bm25_stored(self._table(repo, "postings"), self._table(repo, "search_stats"), query, limit)

    def search_source(self, repo: str, query: str, scope: str = "code", limit: int = 20, context: int = 0) -> DataFrame:
        return search.source_search(self._table(repo, "files"), query, scope, limit, context)

    def embed_repo(self, repo: str, embedder: repository.Embedder) -> int:
        """Builds the description and code vectors of all embeddable nodes; returns how many."""
        docs = description_texts(self._table(repo, "nodes"), self._table(repo, "edges"))
        texts = docs.select("node_id", F.lit("desc").alias("modality"), F.lit(0).alias("chunk_idx"), F.col("description").alias("text")).unionByName(
            docs.select("node_id", F.lit("code").alias("modality"), F.posexplode(chunks(F.col("code"), F.col("label"), self.options.chunk_size, self.options.chunk_overlap)).alias("chunk_idx", "c")).select("node_id", "modality", "chunk_idx", F.col("c.content").alias("text")))
        self.store.add_table(repo, "vectors", repository.embed(texts, embedder, max_bytes=self.options.snippet_bytes).drop("text"))
        vectors = self._table(repo, "vectors")
        params = search.int8_params(vectors)
        if params:
            self.store.add_table(repo, "qparams", self.spark.createDataFrame([(k, o, s) for k, (o, s) in enumerate(params)], "dim int, offset double, scale double"))
            self.store.add_table(repo, "codes", search.code_table(vectors.select(vector_key().alias("vec_id"), "embedding"), params))
        self._embedders[repo] = embedder
        return vectors.where("chunk_idx = 0").count()

    def nearest(self, repo: str, query: str, limit: int = 10) -> DataFrame:
        """(id, similarity) of description and code vectors, named node|modality|chunk: stored codes first, then full vectors."""
        if repo not in self._embedders:
            raise VectorsMissing(repo)
        params = [(r["offset"], r["scale"]) for r in self._table(repo, "qparams").orderBy("dim").collect()]
        vectors = self._table(repo, "vectors").select(vector_key().alias("vec_id"), "embedding")
        return search.two_stage(vectors, self._embedders[repo].embed([query])[0], limit, codes=self._table(repo, "codes"), params=params)

    def attach_embedder(self, repo: str, embedder: repository.Embedder) -> int:
        """Uses stored vectors where their count still fits the nodes, else builds them anew."""
        want = 2 * self._table(repo, "nodes").where(F.col("label").isin(sorted(EMBEDDABLE))).count()
        try:
            have = self._table(repo, "vectors").where("chunk_idx = 0").count()
        except NotFound:
            have = -1
        if have != want:
            return self.embed_repo(repo, embedder)
        self._embedders[repo] = embedder
        return have

    def hybrid_search(self, repo: str, query: str, limit: int = 20) -> DataFrame:
        if repo not in self._embedders:
            raise VectorsMissing(repo)
        vector = self._embedders[repo].embed([query])[0]
        nodes = self._table(repo, "nodes")
        semantic = search.dual_search(self._table(repo, "vectors").where("chunk_idx = 0"), vector, 2 * limit)
        return search.hybrid(self.search(repo, query, 2 * limit), semantic, nodes, limit)

    def export_full_csv(self, repo: str, to: str) -> dict:
        return export_csv(self._table(repo, "nodes"), self._table(repo, "edges"), to, repo)

    def export_inspection_csv(self, repo: str, to: str) -> None:
        export_inspection(self._table(repo, "nodes"), self._table(repo, "edges"), to)


def search_tables(nodes: DataFrame) -> dict[str, DataFrame]:
    """The stored symbol index: postings by term, and the statistics that go with them."""
    docs = symbol_documents(nodes)
    return {"postings": search.postings(docs), "search_stats": search.index_stats(docs)}


def vector_key():
    return F.concat_ws("|", "node_id", "modality", F.col("chunk_idx").cast("string"))


def symbol_documents(nodes: DataFrame) -> DataFrame:
    """(node_id, name, label, file_path, content): what symbol search indexes."""
    text = [c for c, t in nodes.dtypes if t == "string" and c not in ("id", "repo", "snapshot")]
    return nodes.where(F.col("label").isin(sorted(SYMBOLS))).select(F.col("id").alias("node_id"), "name", "label", "file_path", F.concat_ws(" ", *[F.col(c) for c in text]).alias("content"))


def description_texts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node_id, label, description, code): embedding inputs of embeddable nodes.

    The description names the node, its callees and its callers; code is the node's content, or
    made of its name, label and callees where it has none.
    """
    calls = edges.where("type = 'CALLS'").join(nodes.select(F.col("id").alias("source"), F.col("name").alias("sn")), "source", "left").join(nodes.select(F.col("id").alias("target"), F.col("name").alias("tn")), "target", "left")
    out = calls.groupBy(F.col("source").alias("id")).agg(F.array_join(F.array_sort(F.collect_set(F.coalesce("tn", "target"))), ", ").alias("calls"))
    into = calls.groupBy(F.col("target").alias("id")).agg(F.array_join(F.array_sort(F.collect_set(F.coalesce("sn", "source"))), ", ").alias("callers"))
    n = nodes.where(F.col("label").isin(sorted(EMBEDDABLE))).join(out, "id", "left").join(into, "id", "left")
    content = F.col("content") if "content" in nodes.columns else F.lit(None).cast("string")
    description = F.concat_ws("\n", F.concat_ws(" ", "label", "name"), F.concat(F.lit("Calls: "), F.col("calls")), F.concat(F.lit("Called by: "), F.col("callers")))
    return n.select(F.col("id").alias("node_id"), "label", description.alias("description"), F.coalesce(F.when(content != "", content), F.concat_ws(" ", "label", "name", F.concat(F.lit("calls "), F.col("calls")))).alias("code"))


def build_graph(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a source tree: structure, definitions, imports, calls, heritage, overrides, communities, processes."""
    file_nodes, contains = repository.structure(files)
    facts = cut(repository.parse(files))
    d = facts.where("kind = 'definition'").select("file_path", "name", "node_id", F.col("label").alias("type"), "parameter_count", "return_type", F.col("owner").alias("owner_id"), "start_byte", "end_byte", "ord", "start_line", "end_line", "is_exported")
    d = cut(d.groupBy("node_id").agg(F.min_by(F.struct(*[c for c in d.columns if c != "node_id"]), "ord").alias("s")).select("node_id", "s.*"))
    symbols = d.select(F.col("node_id").alias("id"), F.col("type").alias("label"), "name", "file_path", "start_line", "end_line", "is_exported", "parameter_count", "return_type")
    imports = facts.where("kind = 'import'").select("file_path", F.col("target").alias("import_path"), F.col("name").alias("local_name"), F.col("receiver").alias("exported_name"))
    targets = cut(resolve.resolve_imports(imports.select("file_path", "import_path"), files.select("path")))
    bindings = imports.where("exported_name is not null").join(targets, ["file_path", "import_path"]).select("file_path", "local_name", "target", "exported_name")
    heritage = facts.where("kind = 'heritage'").select("file_path", F.col("name").alias("child_name"), F.col("target").alias("parent_name"), F.col("form").alias("heritage_type"))
    parents = cut(resolve.resolve_heritage(heritage, d, targets))
    calls = facts.where("kind = 'call'").select(F.xxhash64("file_path", "ord").alias("call_id"), "file_path", F.col("name").alias("call_name"), "receiver_type", F.col("form").alias("call_form"), "arg_count", "start_byte")
    spans = d.where(F.col("type").isin("Function", "Method", "Class")).select("file_path", "node_id", F.col("start_byte").alias("start"), F.col("end_byte").alias("end"))
    holder = diff.enclosing(calls.select(F.col("call_id").alias("key"), "file_path", F.col("start_byte").alias("at")), spans)
    resolved = resolve.resolve_calls(calls, d, targets, parents.select(F.col("child_id").alias("child"), F.col("parent_id").alias("parent")), bindings)
    called = calls.join(resolved, "call_id").join(holder.select(F.col("key").alias("call_id"), F.col("node_id").alias("holder")), "call_id", "left")
    edge = lambda kind, a, b, conf=F.lit(1.0), why=F.lit(None).cast("string"): [F.lit(kind).alias("type") if isinstance(kind, str) else kind.alias("type"), a.alias("source"), b.alias("target"), conf.alias("confidence"), why.alias("reason")]
    file_id = lambda c: F.concat(F.lit("File:"), F.col(c))
    e = contains.select(*edge("CONTAINS", F.col("source"), F.col("target")))
    e = e.unionByName(d.select(*edge("DEFINES", file_id("file_path"), F.col("node_id"))))
    e = e.unionByName(d.where("owner_id is not null").select(*edge("HAS_METHOD", F.col("owner_id"), F.col("node_id"))))
    e = e.unionByName(targets.select(*edge("IMPORTS", file_id("file_path"), file_id("target"))).distinct())
    e = e.unionByName(parents.select(*edge(F.col("type"), F.col("child_id"), F.col("parent_id"))))
    e = e.unionByName(called.groupBy(F.coalesce("holder", file_id("file_path")).alias("s"), "node_id").agg(F.max("confidence").alias("c"), F.min("reason").alias("r")).select(*edge("CALLS", F.col("s"), F.col("node_id"), F.col("c"), F.col("r"))))
    up = parents.select(F.col("child_id").alias("child"), F.col("parent_id").alias("parent"), "type")
    if not up.isEmpty():
        order = mro.linearizations(up)
        e = e.unionByName(mro.method_edges(order, d.where("owner_id is not null").select("owner_id", "name", "node_id"), up).select(*edge(F.col("type"), F.col("source"), F.col("target"))))
    e = cut(e)
    graph, resolution = community.clustering_graph(symbols, e)
    nodes = file_nodes.unionByName(symbols, allowMissingColumns=True)
    if not graph.isEmpty():
        members = cut(community.communities(graph, resolution))
        big = members.groupBy("community").count().where("count >= 2").select("community")
        nodes = nodes.unionByName(big.select(F.concat(F.lit("comm_"), F.substring(F.sha2("community", 256), 1, 12)).alias("id"), F.lit("Community").alias("label"), F.col("community").alias("name")), allowMissingColumns=True)
        e = e.unionByName(members.join(big, "community").select(*edge("MEMBER_OF", F.col("id"), F.concat(F.lit("comm_"), F.substring(F.sha2("community", 256), 1, 12)))))
        found = community.processes(community.traces(community.entry_scores(symbols, e.where("type = 'CALLS' and confidence >= 0.5")).orderBy(F.desc("score"), "id").limit(200), e.where("type = 'CALLS' and confidence >= 0.5")), members)
        found = cut(found)
        nodes = nodes.unionByName(found.select(F.col("process").alias("id"), F.lit("Process").alias("label"), F.concat_ws(" to ", "entry", "terminal").alias("name")), allowMissingColumns=True)
        e = e.unionByName(community.process_steps(found).select("source", "target", "type", F.lit(1.0).alias("confidence"), F.lit(None).cast("string").alias("reason")))
    known = nodes.select("id")
    e = e.join(known.withColumnRenamed("id", "source"), "source", "left_semi").join(known.withColumnRenamed("id", "target"), "target", "left_semi")
    return nodes, e.select(F.concat_ws("|", "type", "source", "target").alias("id"), "type", "source", "target", "confidence", "reason")


__all__ = ["CONTEXT_RELATIONS", "Engine", "Metrics", "Options", "build_graph", "description_texts", "symbol_documents"]
