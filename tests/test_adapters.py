import io
import json

from pyspark.sql import functions as F

from lattica import cli
from lattica.engine import Engine
from lattica.operators import edit
from lattica.streaming.reindex import apply_changes, reindex


def graph(spark):
    n = spark.createDataFrame([("A", "Function", "alpha", "a.py", 0, 1), ("B", "Function", "beta", "b.py", 0, 1), ("C", "Function", "gamma", "b.py", 2, 3)], "id string, label string, name string, file_path string, start_line int, end_line int")
    e = spark.createDataFrame([("1", "CALLS", "A", "B", 1.0), ("2", "CALLS", "A", "B", 0.5), ("3", "CALLS", "B", "C", 1.0), ("4", "CALLS", "A", "ghost", 1.0)], "id string, type string, source string, target string, confidence double")
    return n, e


def test_edits(spark):
    n, e = graph(spark)
    assert edit.drop_dangling(n, e).count() == 3
    kept, left = edit.delete_where(n, e, F.col("file_path") == "b.py")
    assert [r.id for r in kept.collect()] == ["A"] and [r.id for r in left.collect()] == ["4"]
    assert {r.id for r in edit.delete_edges(e, spark.createDataFrame([("1",)], "id string")).collect()} == {"2", "3", "4"}
    assert [r.id for r in edit.lookup(n, ["C", "none", "A"]).collect()] == ["C", "A"]
    d = spark.createDataFrame([("x", 2, "late", 1, 9), ("x", 1, "early", 3, 4), ("y", 1, None, None, None)], "id string, ord int, name string, start_line int, end_line int")
    assert {(r.id, r.name) for r in edit.first_wins(d).collect()} == {("x", "early"), ("y", None)}
    assert {(r.id, r.name, r.start_line, r.end_line) for r in edit.merge_ranges(d).collect()} == {("x", "early", 1, 9), ("y", None, None, None)}


def test_tool_server_and_command_line(spark, tmp_path):
    engine = Engine(spark, str(tmp_path))
    n, e = graph(spark)
    files = spark.createDataFrame([("a.py", "py", "python", "code", 5, "alpha\nbeta")], "path string, ext string, language string, kind string, size long, content string")
    engine.publish("g", n, e, files)
    asks = [{"id": 1, "tool": "list"}, {"id": 2, "tool": "impact", "args": {"repo": "g", "node": "C"}}, {"id": 3, "tool": "nope"}, {"id": 4, "tool": "path", "args": {"repo": "g", "source": "A", "target": "C"}}, {"id": 5, "tool": "impact", "args": {"repo": "g"}}]
    out = io.StringIO()
    cli.serve(engine, [*map(json.dumps, asks), "", "not json"], out)
    got = [json.loads(x) for x in out.getvalue().splitlines()]
    assert got[0]["result"] == ["g"] and [r["id"] for r in got[1]["result"]] == ["B", "A"]
    assert "InvalidRequest" in got[2]["error"] and len(got[3]["result"]) == 2 and "missing" in got[4]["error"] and "error" in got[5]
    out = io.StringIO()
    assert cli.main(["--store", str(tmp_path), "source", "g", "beta"], spark, out) == 0 and json.loads(out.getvalue())[0]["line"] == 2
    assert cli.main(["--store", str(tmp_path), "context", "g", "nobody"], spark, io.StringIO()) == 1
    for command, key in ((["embed", "g", "--dimensions", "8"], "vectors"), (["version"], "version")):
        out = io.StringIO()
        assert cli.main(["--store", str(tmp_path), *command], spark, out) == 0 and key in json.loads(out.getvalue())


def test_changes(spark):
    f = spark.createDataFrame([("a.py", "py", "python", "code", 1, "x"), ("b.py", "py", "python", "code", 1, "y")], "path string, ext string, language string, kind string, size long, content string")
    c = spark.createDataFrame([("a.py", "old", 1), ("a.py", "new", 2), ("b.py", None, 1), ("c.md", "docs", 1)], "path string, content string, version int")
    assert {(r.path, r.content, r.kind) for r in apply_changes(f, c).collect()} == {("a.py", "new", "code"), ("c.md", "docs", "docs")}


def test_stream_publishes_snapshots(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "store"))
    src = str(tmp_path / "changes")
    spark.createDataFrame([("m.py", "def f():\n    return g()\n\ndef g():\n    return 1\n", 1)], "path string, content string, version int").write.parquet(src)
    stream = spark.readStream.schema("path string, content string, version int").parquet(src)
    reindex(engine, "live", stream, str(tmp_path / "state")).awaitTermination()
    assert engine._table("live", "edges").where("type = 'CALLS'").count() == 1
