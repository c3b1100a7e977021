"""Command line and a line-based JSON tool server over ``Engine``."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession

from . import __version__
from .engine import Engine
from .schema import EngineError, InvalidRequest
from .sources.repository import HashEmbedder, git_patch

#: tool -> (parameters in order, optional ones with their defaults)
TOOLS = {
    "list": ((), {}), "search": (("repo", "query"), {"limit": 20}), "source": (("repo", "query"), {"scope": "code", "limit": 20, "context": 0}),
    "traverse": (("repo", "node"), {"direction": "out", "max_depth": 1}), "path": (("repo", "source", "target"), {}), "context": (("repo", "node"), {"limit": 100}),
    "impact": (("repo", "node"), {"max_depth": 3, "limit": 100}), "check": (("repo",), {"threshold": 0.7, "limit": 100}), "diff": (("repo", "checkout"), {"base": "HEAD", "target": ""}),
    "rename": (("repo", "node", "new_name"), {"limit": 200}),
}
_METHODS = {"source": "search_source", "path": "shortest_path"}


def rows(result) -> object:
    if isinstance(result, DataFrame):
        return [r.asDict(recursive=True) for r in result.collect()]
    if isinstance(result, tuple):
        return [rows(r) for r in result]
    return result


def call(engine: Engine, tool: str, args: dict) -> object:
    """One read-only operation by name; unknown tools and parameters are refused."""
    if tool not in TOOLS:
        raise InvalidRequest(f"unknown tool {tool!r}")
    need, optional = TOOLS[tool]
    if missing := [p for p in need if not args.get(p)]:
        raise InvalidRequest(f"missing {missing}")
    if extra := set(args) - set(need) - set(optional):
        raise InvalidRequest(f"unknown parameters {sorted(extra)}")
    own = {p: args[p] for p in need} | {p: type(d)(args.get(p, d)) for p, d in optional.items()}
    if tool == "list":
        return engine.list_repos()
    if tool == "diff":
        return rows(engine.diff(own["repo"], git_patch(engine.spark, own["checkout"], own["base"], own["target"])))
    return rows(getattr(engine, _METHODS.get(tool, tool))(**own))


def serve(engine: Engine, lines, out) -> None:
    """Answers {"id", "tool", "args"} lines one after the other with {"id", "result"} or {"id", "error"}."""
    for line in lines:
        if not line.strip():
            continue
        ident = None
        try:
            ask = json.loads(line)
            ident = ask.get("id")
            answer = {"id": ident, "result": call(engine, ask.get("tool", ""), ask.get("args") or {})}
        except (EngineError, ValueError, TypeError, AttributeError) as e:
            answer = {"id": ident, "error": f"{type(e).__name__}: {e}"}
        print(json.dumps(answer, default=str), file=out, flush=True)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lattica")
    p.add_argument("--store", required=True)
    sub = p.add_subparsers(dest="command", required=True)
    for tool, (need, optional) in TOOLS.items():
        s = sub.add_parser(tool)
        for name in need:
            s.add_argument(name)
        for name, default in optional.items():
            s.add_argument(f"--{name.replace('_', '-')}", type=type(default), default=default)
    s = sub.add_parser("index")
    s.add_argument("path"), s.add_argument("repo"), s.add_argument("--replace", action="store_true")
    sub.add_parser("delete").add_argument("repo")
    s = sub.add_parser("hybrid")
    s.add_argument("repo"), s.add_argument("query"), s.add_argument("--limit", type=int, default=20), s.add_argument("--dimensions", type=int, default=64)
    s = sub.add_parser("embed")
    s.add_argument("repo"), s.add_argument("--dimensions", type=int, default=64)
    sub.add_parser("version")
    s = sub.add_parser("export")
    s.add_argument("repo"), s.add_argument("to")
    sub.add_parser("serve")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None, out=sys.stdout) -> int:
    a = vars(parser().parse_args(argv))
    engine = Engine(spark or SparkSession.builder.getOrCreate(), a.pop("store"))
    command = a.pop("command")
    try:
        if command == "serve":
            serve(engine, sys.stdin, out)
            return 0
        if command == "index":
            result = engine.index_repo(a["path"], a["repo"], a["replace"])
        elif command == "delete":
            result = engine.delete_repo(a["repo"])
        elif command == "embed":
            result = {"vectors": engine.embed_repo(a["repo"], HashEmbedder(a["dimensions"]))}
        elif command == "version":
            result = {"version": __version__}
        elif command == "export":
            result = engine.export_full_csv(a["repo"], a["to"])
        elif command == "hybrid":
            engine.attach_embedder(a["repo"], HashEmbedder(a["dimensions"]))
            result = rows(engine.hybrid_search(a["repo"], a["query"], a["limit"]))
        else:
            result = call(engine, command, a)
    except EngineError as e:
        print(json.dumps({"error": f"{type(e).__name__}: {e}"}), file=out)
        return 1
    print(json.dumps(result, default=str), file=out)
    return 0


if __name__ == "__main__":
    sys.exit(main())
