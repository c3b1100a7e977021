"""Snapshots: immutable Parquet folders behind a manifest that is replaced by renaming, and CSV export."""

from __future__ import annotations

import hashlib
import json
import os
import shutil
import time
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import Busy, Conflict, InvalidRequest, NotFound

TABLES = ("nodes", "edges", "files", "vectors")


def repository_dir(name: str) -> str:
    return hashlib.sha256(name.strip().encode()).hexdigest()[:32]


class Store:
    """Repositories under one folder; a writer holds a lock folder, readers see the manifest's snapshot."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        os.makedirs(root, exist_ok=True)
        for name in self.list():
            self.collect(name)

    def _dir(self, name: str) -> str:
        if not name or not name.strip():
            raise InvalidRequest("empty repository name")
        return os.path.join(self.root, repository_dir(name))

    def _manifest(self, name: str) -> dict:
        try:
            with open(os.path.join(self._dir(name), "manifest.json")) as f:
                m = json.load(f)
        except FileNotFoundError:
            raise NotFound(name) from None
        if m.get("version") != 1 or repository_dir(m["name"]) != os.path.basename(self._dir(name)):
            raise InvalidRequest("manifest doesn't belong to its folder")
        return m

    def list(self) -> list[str]:
        out = []
        for d in sorted(os.listdir(self.root)):
            try:
                with open(os.path.join(self.root, d, "manifest.json")) as f:
                    out.append(json.load(f)["name"])
            except (FileNotFoundError, NotADirectoryError):
                pass
        return sorted(out)

    def publish(self, name: str, tables: dict[str, DataFrame], replace: bool = False) -> str:
        """Writes a snapshot beside the active one, then makes it active in one rename."""
        d = self._dir(name)
        os.makedirs(d, exist_ok=True)
        with self._locked(name):
            path = os.path.join(d, "manifest.json")
            old = None
            if os.path.exists(path):
                if not replace:
                    raise Conflict(name)
                old = self._manifest(name)
            snapshot = f"snapshot@{time.time_ns():x}"
            at = os.path.join(d, snapshot)
            try:
                for table, df in tables.items():
                    df.write.parquet(os.path.join(at, table))
                self._write(path, {"version": 1, "name": name.strip(), "active": snapshot, "retired": [*(old or {}).get("retired", []), *([old["active"]] if old else [])]})
            except BaseException:
                shutil.rmtree(at, ignore_errors=True)
                raise
            return snapshot

    @contextmanager
    def _locked(self, name: str):
        """Holds the repository's lock folder, wherever it is in the end; a second writer is told that it is busy."""
        d = self._dir(name)
        try:
            os.mkdir(os.path.join(d, "lock"))
        except FileExistsError:
            raise Busy(name) from None
        except FileNotFoundError:
            raise NotFound(name) from None
        try:
            yield
        finally:
            if os.path.isdir(os.path.join(d, "lock")):
                os.rmdir(os.path.join(d, "lock"))

    @staticmethod
    def _write(path: str, manifest: dict) -> None:
        tmp = f"{path}.{uuid.uuid4().hex}"
        with open(tmp, "w") as f:
            json.dump(manifest, f)
        os.replace(tmp, path)

    def add_table(self, name: str, table: str, df: DataFrame) -> None:
        """Adds or replaces one table of the active snapshot (vectors are built after the graph).

        The rows are written beside the old ones, and the manifest then names their folder: a reader
        sees the one or the other. Old folders go with their snapshot.
        """
        with self._locked(name):
            m = self._manifest(name)
            folder = f"{table}.{uuid.uuid4().hex}"
            df.write.parquet(os.path.join(self._dir(name), m["active"], folder))
            self._write(os.path.join(self._dir(name), "manifest.json"), m | {"tables": m.get("tables", {}) | {table: folder}})

    def read(self, name: str, table: str) -> DataFrame:
        m = self._manifest(name)
        at = os.path.join(self._dir(name), m["active"], m.get("tables", {}).get(table, table))
        if not os.path.isdir(at):
            raise NotFound(f"{name} has no {table}")
        return self.spark.read.parquet(at)

    def collect(self, name: str) -> None:
        """Removes retired snapshots; called when a store is opened, as no reader of them is left then."""
        m = self._manifest(name)
        for s in m["retired"]:
            shutil.rmtree(os.path.join(self._dir(name), s), ignore_errors=True)
        if m["retired"]:
            self._write(os.path.join(self._dir(name), "manifest.json"), m | {"retired": []})

    def delete(self, name: str) -> None:
        d = self._dir(name)
        self._manifest(name)
        with self._locked(name):
            trash = f"{d}.trash-{uuid.uuid4().hex}"
            os.rename(d, trash)
        shutil.rmtree(trash, ignore_errors=True)


# == CSV
NODE_CSV = ("id", "label", "name", "language", "filePath", "startLine", "endLine", "content", "description", "properties")
EDGE_CSV = ("id", "from", "to", "type", "confidence", "reason", "step", "properties")
_OWN = {"from": "source", "to": "target"}
#: Columns that make a row what it is; all others are its properties.
_CORE = {"id", "label", "name", "file_path", "type", "source", "target", "repo", "snapshot"}


def _camel(name: str) -> str:
    head, *rest = name.split("_")
    return head + "".join(w.capitalize() for w in rest)


def csv_table(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """The full export's columns as text, whole and in id order.

    Absent text is empty and an absent number 0. ``properties`` is JSON of all properties that are
    not null, by name.
    """
    names = {_camel(c): c for c in df.columns}
    props = sorted(k for k, c in names.items() if c not in _CORE)
    json_text = F.to_json(F.struct(*[F.col(names[k]).alias(k) for k in props])) if props else F.lit("{}")
    kinds = dict(df.dtypes)

    def text(column: str) -> Column:
        own = names.get(_OWN.get(column, column))
        if column == "properties":
            return json_text
        if own is None:
            return F.lit("0" if column in ("startLine", "endLine", "step", "confidence") else "")
        if kinds[own] in ("double", "float"):  # no point behind a whole number
            return F.regexp_replace(F.coalesce(F.col(own), F.lit(0.0)).cast("string"), r"\.0$", "")
        return F.coalesce(F.col(own).cast("string"), F.lit("0" if kinds[own] in ("int", "bigint", "smallint") else ""))

    return df.orderBy("id").select(*[text(c).alias(c) for c in columns])


def _digest(folder: str) -> str:
    digest = hashlib.sha256()
    for p in sorted(x for x in os.listdir(folder) if x.endswith(".csv")):
        with open(os.path.join(folder, p), "rb") as f:
            while block := f.read(1 << 20):
                digest.update(block)
    return digest.hexdigest()


def export_csv(nodes: DataFrame, edges: DataFrame, to: str, repository: str = "") -> dict:
    """nodes.csv, edges.csv (each a folder of files) and a manifest with row counts and SHA-256."""
    files = {}
    for name, df, cols in (("nodes.csv", nodes, NODE_CSV), ("edges.csv", edges, EDGE_CSV)):
        at = os.path.join(to, name)
        csv_table(df, cols).write.mode("overwrite").option("header", True).option("escape", '"').csv(at)
        files[name] = {"sha256": _digest(at), "rows": df.count()}
    out = {"schemaVersion": 2, "repository": repository, "nodeCount": files["nodes.csv"]["rows"], "edgeCount": files["edges.csv"]["rows"], "files": files}
    with open(os.path.join(to, "manifest.json"), "w") as f:
        json.dump(out, f, indent=2)
        f.write("\n")
    return out


def csv_text(c: Column, limit: int = 10_000) -> Column:
    """A field of the inspection tables: LF line ends, no control characters, nothing beyond the basic plane, ``limit`` characters."""
    lines = F.regexp_replace(c, "\r\n?", "\n")
    return F.substring(F.regexp_replace(lines, r"[\x{0}-\x{8}\x{B}\x{C}\x{E}-\x{1F}\x{7F}\x{D800}-\x{DFFF}\x{FFFE}\x{FFFF}\x{10000}-\x{10FFFF}]", ""), 1, limit)


INSPECTED = ("id", "label", "name", "file_path", "start_line", "end_line", "is_exported")


def inspection_table(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    return df.orderBy("id").select(*[csv_text(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(c) if c in df.columns else F.lit("").alias(c) for c in columns])


def export_inspection(nodes: DataFrame, edges: DataFrame, to: str) -> None:
    """One CSV folder a label (partitioned in one pass) and one of relations; a view of the graph, not the whole."""
    inspection_table(nodes, INSPECTED).withColumnRenamed("label", "kind").write.mode("overwrite").partitionBy("kind").option("header", True).option("quoteAll", True).option("escape", '"').csv(os.path.join(to, "symbols"))
    inspection_table(edges, tuple("source target type confidence reason step".split())).write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').csv(os.path.join(to, "relations"))
