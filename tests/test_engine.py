import json
import os

import pytest
from pyspark.sql import functions as F

from lattica.engine import Engine
from lattica.schema import Busy, Closed, Conflict, InvalidRequest, NotFound, VectorsMissing
from lattica.sources import repository
from lattica.sources.store import repository_dir

CODE = {
    "main.py": "from util import work\n\nclass Base:\n    def go(self):\n        return helper()\n\nclass Sub(Base):\n    def go(self):\n        return work()\n\ndef helper():\n    return work()\n\ndef run():\n    helper()\n",
    "util.py": "def work():\n    return 1\n",
    "README.md": "work and run",
    "node_modules/x.py": "def hidden(): pass\n",
    ".secret.py": "x = 1\n",
    "lib.min.js": "x",
}


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "src"
    for name, text in CODE.items():
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    return str(root)


def test_engine_end_to_end(spark, tree, tmp_path):
    e = Engine(spark, str(tmp_path / "store"))
    e.index_repo(tree, "demo")
    assert e.list_repos() == ["demo"] and e.ping()
    work = "Function:util.py:work"
    assert [r.id for r in e.impact("demo", work).where("depth = 1").orderBy("id").collect()] == ["Function:main.py:helper", "Method:main.py:Sub.go"]
    assert e.traverse("demo", "Function:main.py:run", max_depth=3, types=["CALLS"]).where(F.col("id") == work).count() == 1
    assert e.shortest_path("demo", "Function:main.py:run", work).count() == 2
    assert "in" in {r.direction for r in e.context("demo", work).collect()}
    assert e.excerpt("demo", work).first().excerpt == "def work():\n    return 1"
    assert {r.type for r in e._table("demo", "edges").select("type").distinct().collect()} >= {"CONTAINS", "DEFINES", "HAS_METHOD", "IMPORTS", "CALLS", "EXTENDS", "OVERRIDES", "MEMBER_OF"} - {"CONTAINS"}
    assert e.search("demo", "work").first().node_id == work
    assert e.search_source("demo", "work", scope="docs").count() == 1
    first, counts = e.check("demo")
    assert first.count() == 0
    plan = e.rename("demo", work, "execute")
    assert plan["safe"] and {"declaration"} <= {o["kind"] for o in plan["occurrences"]}
    patch = spark.createDataFrame([(0, "diff --git a/util.py b/util.py\n@@ -2 +2 @@\n-    return 1\n+    return 2\n")], "patch_id long, patch string")
    changed, hit = e.diff("demo", patch)
    assert [r.id for r in changed.collect()] == [work] and hit.where("depth = 1").count() == 2
    with pytest.raises(VectorsMissing):
        e.hybrid_search("demo", "work")
    assert e.embed_repo("demo", repository.HashEmbedder(16)) > 0
    assert e.hybrid_search("demo", "work").first().id == work
    assert e.attach_embedder("demo", repository.HashEmbedder(16)) > 0
    out = e.export_full_csv("demo", str(tmp_path / "csv"))
    assert out["nodeCount"] == e._table("demo", "nodes").count() and out["repository"] == "demo" and json.load(open(tmp_path / "csv" / "manifest.json")) == out
    with pytest.raises(Conflict):
        e.index_repo(tree, "demo")
    old = e.store._manifest("demo")["active"]
    e.index_repo(tree, "demo", replace=True)
    assert e.store._manifest("demo")["active"] != old and e.metrics.index_fail == 1 and e.metrics.index_success == 2
    counts = e.get_metrics()
    assert counts["reindex_success"] == 1 and counts["impact_queries"] == 1 and counts["context_queries"] == 1 and counts["rename_queries"] == 1 and counts["search_queries"] >= 2 and counts["node_reads"] > 5
    again = Engine(spark, str(tmp_path / "store"))
    assert not os.path.exists(os.path.join(again.store._dir("demo"), old))
    os.mkdir(os.path.join(e.store._dir("demo"), "lock"))
    with pytest.raises(Busy):
        e.delete_repo("demo")
    os.rmdir(os.path.join(e.store._dir("demo"), "lock"))
    e.delete_repo("demo")
    assert e.list_repos() == []
    with pytest.raises(NotFound):
        e.search("demo", "x")
    e.close()
    with pytest.raises(Closed):
        e.ping()


def test_walk(spark, tree):
    assert {r.path for r in repository.read_files(spark, tree).collect()} == {"main.py", "util.py", "README.md"}
    assert "node_modules/x.py" in {r.path for r in repository.read_files(spark, tree, filtered=False).collect()}


def test_structure(spark):
    n, e = repository.structure(spark.createDataFrame([("a/b/c.py",), ("top.py",)], "path string"))
    assert {r.id for r in n.collect()} == {"Folder:a", "Folder:a/b", "File:a/b/c.py", "File:top.py"}
    assert {(r.source, r.target) for r in e.collect()} == {("Folder:a", "Folder:a/b"), ("Folder:a/b", "File:a/b/c.py")}


def test_parser():
    facts = repository.parse_python("x.py", "import os\nclass A(B):\n    def f(self, a, *, k=1) -> int:\n        return g(1, k=2)\n")
    d = {f["node_id"]: f for f in facts if f["kind"] == "definition"}
    assert set(d) == {"Class:x.py:A", "Method:x.py:A.f"} and d["Method:x.py:A.f"]["parameter_count"] == 2 and d["Method:x.py:A.f"]["return_type"] == "int"
    assert [(f["name"], f["arg_count"]) for f in facts if f["kind"] == "call"] == [("g", 2)]
    assert repository.parse_python("y.py", "def (") == []


TYPED = """
class Engine:
    def run(self, a, b=1): pass
    def stop(self): pass

class Car:
    spare: Engine
    def __init__(self, engine: "Engine", other):
        self.engine = engine
        self.made = Engine()
        self.other = other
    def go(self, e: Engine | None):
        self.engine.run(1, 2)
        self.made.stop()
        self.spare.stop()
        self.other.stop()
        self.go(e)
        e.run(3, 4)
        local = Engine()
        local.stop()
        twice = Engine()
        twice = Car(local, 1)
        twice.go(e)
        Engine().stop()
    class Part:
        def fit(self):
            self.fit()

shared = Engine()
def use():
    shared.stop()
"""


def test_types_of_receivers():
    calls = [(f["receiver"], f["name"], f.get("receiver_type")) for f in repository.parse_python("t.py", TYPED) if f["kind"] == "call" and f["form"] == "member"]
    assert calls == [("self.engine", "run", "Engine"), ("self.made", "stop", "Engine"), ("self.spare", "stop", "Engine"), ("self.other", "stop", None), ("self", "go", "Car"), ("e", "run", "Engine"),
        ("local", "stop", "Engine"), ("twice", "go", None), (None, "stop", "Engine"), ("self", "fit", "Part"), ("shared", "stop", "Engine")]


def test_methods_of_nested_classes_have_their_owner():
    facts = {f["node_id"]: f for f in repository.parse_python("t.py", TYPED) if f["kind"] == "definition"}
    assert facts["Method:t.py:Car.Part.fit"]["owner"] == "Class:t.py:Car.Part" and "Class:t.py:Car.Part" in facts


def test_typed_calls_make_edges(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "t.py").write_text(TYPED)
    e = Engine(spark, str(tmp_path / "store"))
    e.index_repo(str(tmp_path / "src"), "typed")
    calls = {(r.source, r.target) for r in e._table("typed", "edges").where("type = 'CALLS'").collect()}
    assert ("Method:t.py:Car.go", "Method:t.py:Engine.run") in calls and ("Function:t.py:use", "Method:t.py:Engine.stop") in calls and ("Method:t.py:Car.Part.fit", "Method:t.py:Car.Part.fit") in calls
    assert e._table("typed", "edges").where("type = 'HAS_METHOD' and target = 'Method:t.py:Car.Part.fit'").count() == 1
    e.embed_repo("typed", repository.HashEmbedder(16))
    assert e.nearest("typed", "Method run", 3).count() == 3
    e.export_inspection_csv("typed", str(tmp_path / "seen"))
    assert spark.read.option("header", True).csv(str(tmp_path / "seen" / "symbols")).where("kind = 'Method'").count() == e._table("typed", "nodes").where("label = 'Method'").count()


def test_other_languages_are_refused(spark):
    with pytest.raises(InvalidRequest):
        repository.parse(spark.createDataFrame([], "path string, content string, language string"), ("go",))


def test_repository_ids(spark):
    from lattica.functions.text import repository_id

    assert spark.range(1).select(repository_id(F.lit(" demo "))).first()[0] == repository_dir("demo")
