import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.operators import analyze, community, diff, mro, resolve, traverse
from lattica.schema import InvalidRequest, LimitExceeded, NotFound, direction, relations


def edges(spark, *rows):
    full = [(f"{t}|{a}|{b}", t, a, b, c) for t, a, b, c in ((*r, 1.0)[:4] if len(r) == 3 else r for r in rows)]
    return spark.createDataFrame(full, "id string, type string, source string, target string, confidence double")


def nodes(spark, *rows):
    return spark.createDataFrame([(*r, None, None, None)[:6] if len(r) < 6 else r for r in rows], "id string, label string, name string, file_path string, start_line int, end_line int")


def ids(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "id string")


def found(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_directions_and_relations():
    assert direction(None) == "out" and direction(" Callers ") == "in" and direction("two-way") == "both"
    assert relations([" calls", ""]) == {"CALLS"} and relations(None, {"X"}) == {"X"}
    with pytest.raises(InvalidRequest):
        direction("sideways")


def test_bfs(spark):
    e = edges(spark, ("CALLS", "A", "B"), ("CALLS", "C", "B"), ("CALLS", "B", "D"), ("USES", "B", "E"))
    assert found(traverse.bfs(e, ids(spark, "B"), 1, "both", ["CALLS"]), "id") == [("A",), ("C",), ("D",)]
    assert found(traverse.bfs(e, ids(spark, "A"), 1), "id", "depth") == [("B", 1)]
    assert found(traverse.bfs(e, ids(spark, "A"), 5), "id", "depth", "parent") == [("B", 1, "A"), ("D", 2, "B"), ("E", 2, "B")]
    assert found(traverse.bfs(e, ids(spark, "Z"), 2), "id") == []
    with pytest.raises(LimitExceeded):
        traverse.bfs(e, ids(spark, "A"), 5, limit=2)
    with pytest.raises(InvalidRequest):
        traverse.bfs(e, ids(spark, "A"), 0)


def test_cycles_dont_run_forever(spark):
    e = edges(spark, ("CALLS", "A", "B"), ("CALLS", "B", "A"), ("CALLS", "A", "A"))
    assert found(traverse.bfs(e, ids(spark, "A"), 9), "id") == [("B",)]


def test_shortest_path(spark):
    e = edges(spark, ("CALLS", "A", "B"), ("CALLS", "B", "C"), ("CALLS", "A", "X"), ("CALLS", "X", "C"), ("CALLS", "C", "D"))
    assert [(r.step, r.source, r.target) for r in traverse.shortest_path(e, "A", "D").collect()] == [(1, "A", "B"), (2, "B", "C"), (3, "C", "D")]
    for a, b in (("D", "A"), ("A", "A"), ("A", "nowhere")):
        with pytest.raises(NotFound):
            traverse.shortest_path(e, a, b)


def chain(spark, n):
    return edges(spark, *[("CALLS", f"n{i:05d}", f"n{i + 1:05d}") for i in range(n)])


def test_shortest_path_of_a_long_chain(spark):
    for n in (500, 10_000):
        path = traverse.shortest_path(chain(spark, n), "n00000", f"n{n:05d}").orderBy("step").collect()
        assert [(r.step, r.source) for r in path] == [(i + 1, f"n{i:05d}") for i in range(n)]
    with pytest.raises(NotFound):
        traverse.shortest_path(chain(spark, 20), "n00000", "n00020", max_hops=19)


def test_both_ends_meet_in_the_same_path(spark):
    r = random.Random(4)
    for _ in range(2):
        rows = {(r.choice(["CALLS", "USES"]), f"v{r.randint(0, 30):02d}", f"v{r.randint(0, 30):02d}") for _ in range(60)}
        e = edges(spark, *sorted(rows))
        for target in ("v07", "v23"):
            try:
                want = [tuple(x) for x in traverse.shortest_path(e, "v00", target).orderBy("step").collect()]
            except NotFound:
                with pytest.raises(NotFound):
                    traverse.shortest_path(e, "v00", target, one_task=0)
                continue
            assert [tuple(x) for x in traverse.shortest_path(e, "v00", target, one_task=0).orderBy("step").collect()] == want


def test_impact_gate_order_and_limit(spark):
    n = nodes(spark, ("T", "Function", "t"), ("A", "Function", "a"), ("B", "Method", "b"), ("F", "File", "f"), ("C", "Class", "c"))
    e = edges(spark, ("CALLS", "A", "T", 0.5), ("CALLS", "B", "T", 0.9), ("IMPORTS", "F", "T", 1.0), ("CALLS", "C", "A", 1.0), ("CONTAINS", "C", "T", 1.0))
    r = traverse.impact(n, e, "T").orderBy("ord").collect()
    assert [(x.ord, x.id, x.depth) for x in r] == [(1, "B", 1), (2, "A", 1), (3, "C", 2)]
    assert [x.id for x in traverse.impact(n, e, "T", limit=1).collect()] == ["B"]
    with pytest.raises(NotFound):
        traverse.impact(n, e, "missing")
    with pytest.raises(InvalidRequest):
        traverse.impact(n, e, "T", max_depth=11)


def test_many_impacts(spark):
    n = nodes(spark, *[(x, "Function", x) for x in "ABCD"])
    e = edges(spark, ("CALLS", "A", "B"), ("CALLS", "B", "C"), ("CALLS", "A", "D", 0.4))
    start = ids(spark, "C", "D")
    r = traverse.aggregate_impact(traverse.impact_many(n, e, start), start).collect()
    assert {x.id: (x.depth, x.causes) for x in r} == {"B": (1, ["C"]), "A": (1, ["C", "D"])}


def test_closure(spark):
    p = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d")], "a string, b string")
    assert len(found(traverse.closure(p), "a", "b")) == 6


def test_closure_has_no_end_of_its_own(spark):
    p = spark.createDataFrame([(f"n{i:03d}", f"n{i + 1:03d}") for i in range(130)] + [("x", "y"), ("y", "x")], "a string, b string")
    got = traverse.closure(p)
    assert got.count() == 131 * 130 // 2 + 4 and got.where("a = 'n000' and b = 'n130'").count() == 1


def test_ancestors_of_a_deep_hierarchy(spark):
    rows = [(f"c{i:03d}", f"c{i + 1:03d}", "EXTENDS") for i in range(100)] + [("c000", "i", "IMPLEMENTS"), ("i", "c050", "EXTENDS"), ("c003", "c003", "EXTENDS")]
    got = {(r.child, r.ancestor): r for r in mro.ancestors(spark.createDataFrame(rows, "child string, parent string, type string")).collect()}
    assert len([k for k in got if k[0] == "c001"]) == 99
    far = got["c000", "c060"]
    assert far.depth == 12 and far.path == ["i", *[f"c{k:03d}" for k in range(50, 61)]] and far.via == "IMPLEMENTS"


def test_context(spark):
    n = nodes(spark, ("A", "Function", "a"), ("B", "Function", "b"))
    e = edges(spark, ("CALLS", "A", "B"), ("CALLS", "ghost", "B"), ("CONTAINS", "A", "B"))
    assert found(analyze.context(n, e, "B"), "direction", "neighbour") == [("in", "A")]


def test_excerpts_across_blocks_of_a_file(spark):
    lines = [f"l{i}" for i in range(3 * analyze.BLOCK + 5)]
    b = analyze.BLOCK
    n = nodes(spark, ("a", "Class", "a", "f", b - 2, b + 1), ("a", "Class", "a", "f", b - 2, b + 1), ("b", "Class", "b", "f", 3 * b, 9 * b), ("c", "Class", "c", "f", 3 * b + 5, 9 * b), ("d", "Class", "d", "f", 7, None), ("e", "Class", "e", "f", 10, 900))
    want = sorted([("a", "\n".join(lines[b - 2 : b + 2]))] * 2 + [("b", "\n".join(lines[3 * b :])), ("d", "l7"), ("e", "\n".join(lines[10:210]))])
    whole = spark.createDataFrame([("f", "\n".join(lines)), ("g", "")], "path string, content string")
    assert found(analyze.excerpt(whole, n), "id", "excerpt") == want
    blocks = spark.createDataFrame([("f", k, "\n".join(lines[k * b : k * b + b])) for k in range(4)], "path string, block int, content string")
    assert found(analyze.excerpt(blocks, n), "id", "excerpt") == want


def test_components(spark):
    e = edges(spark, *[("IMPORTS", a, b) for a, b in ("ab", "ba", "bc", "de", "ef", "fd", "ss")])
    assert found(analyze.components(e), "id", "component") == [("a", "a"), ("b", "a"), ("d", "d"), ("e", "d"), ("f", "d")]
    assert analyze.components(e.where("false")).count() == 0


def test_components_against_brute_force(spark):
    r = random.Random(6)
    pairs = {(f"a{i:02d}", f"a{i + 1:02d}") for i in range(40)} | {(f"b{r.randint(0, 25)}", f"b{r.randint(0, 25)}") for _ in range(40)}
    reach = {x: {x} for p in pairs for x in p}
    while True:
        size = sum(map(len, reach.values()))
        for a, b in pairs:
            reach[a] |= reach[b]
        if size == sum(map(len, reach.values())):
            break
    want = {}
    for x in reach:
        own = [y for y in reach[x] if x in reach[y]]
        if len(own) > 1:
            want[x] = min(own)
    got = {x.id: x.component for x in analyze.components(edges(spark, *[("IMPORTS", a, b) for a, b in sorted(pairs)])).collect()}
    assert got == want and want


def test_components_joined_by_a_bridge(spark):
    e = edges(spark, *[("IMPORTS", a, b) for a, b in ("xy", "yx", "xa", "ab", "ba", "bm", "mn", "nm")])
    assert {r.component for r in analyze.components(e).collect()} == {"x", "a", "m"}


def test_simple_cycles_leave_out_supersets(spark):
    e = edges(spark, *[("IMPORTS", a, b) for a, b in ("AB", "BC", "CA", "BD", "DC")])
    assert [r.members for r in analyze.simple_cycles(e).collect()] == [["A", "B", "C"]]


def test_check(spark):
    n = nodes(spark, ("A", "Class", "a"), ("B", "Class", "b"))
    e = edges(spark, ("EXTENDS", "A", "B"), ("EXTENDS", "B", "A"), ("CALLS", "A", "ghost"), ("IMPORTS", "A", "A"), ("CALLS", "A", "B", 0.2))
    first, counts = analyze.check(n, e, ("integrity", "cycles", "confidence"))
    assert [(r.severity, r.code) for r in first.collect()] == [("error", "DANGLING_EDGE"), ("error", "INHERITANCE_CYCLE"), ("error", "INVALID_SELF_DEPENDENCY"), ("info", "LOW_CONFIDENCE_RELATION")]
    assert dict(counts.collect()) == {"error": 3, "info": 1}
    few, counts = analyze.check(n, e, ("integrity",), limit=1)
    assert few.count() == 1 and dict(counts.collect()) == {"error": 2}
    with pytest.raises(InvalidRequest):
        analyze.check(n, e, ("nonsense",))


PATCH = "diff --git a/m.go b/m.go\n--- a/m.go\n+++ b/m.go\n@@ -3,2 +3,3 @@ func\n-a\n-b\n+c\n+d\n+e\ndiff --git a/old.go b/new.go\nsimilarity index 100%\nrename from old.go\nrename to new.go\n"


def test_patch(spark):
    f = diff.parse_patches(spark.createDataFrame([(1, PATCH), (2, "")], "patch_id long, patch string")).orderBy("path").collect()
    assert [(r.path, r.old_path, r.status, r.additions, r.deletions) for r in f] == [("m.go", "m.go", "modified", 3, 2), ("new.go", "old.go", "renamed", 0, 0)]
    assert [tuple(x) for x in f[0].ranges] == [(3, 2, 3, 3)] and f[1].ranges == []


def test_changed_symbols(spark):
    n = nodes(spark, ("F", "Function", "f", "m.go", 0, 3), ("G", "Function", "g", "m.go", 6, 9), ("O", "Class", "o", "old.go", 50, 60), ("X", "Variable", "x", "m.go", 0, 9))
    files = diff.parse_patches(spark.createDataFrame([(1, PATCH)], "patch_id long, patch string"))
    assert found(diff.changed_symbols(n, files), "id") == [("F",), ("O",)]


def test_many_hunks_of_one_file_take_no_pairs(spark):
    n = spark.range(50_000).selectExpr("'n' || id as id", "'Function' as label", "'x' as name", "'f' as file_path", "cast(id * 10 as int) as start_line", "cast(id * 10 + 3 as int) as end_line")
    # hunks of lines 10 k + 5 to 10 k + 6 lie between the spans, those of every fifth k reach the next one
    hunk = F.struct(F.lit(1).alias("old_start"), F.lit(1).alias("old_lines"), (F.col("id") * 10 + 5).cast("int").alias("new_start"), F.when(F.col("id") % 5 == 0, 7).otherwise(2).alias("new_lines"))
    f = spark.range(50_000).agg(F.collect_list(hunk).alias("ranges")).select(F.lit("f").alias("path"), F.lit("f").alias("old_path"), F.lit("modified").alias("status"), "ranges")
    began = time.time()
    got = {int(r.id[1:]) for r in diff.changed_symbols(n, f).collect()}
    assert got == {k + 1 for k in range(0, 49_999, 5)} and time.time() - began < 60


def test_hunks_of_several_patches_and_odd_spans(spark):
    r = random.Random(3)
    spans = [(f"s{i}", "Class", "x", f"f{r.randint(0, 3)}", a := r.choice([None, r.randint(0, 60)]), r.choice([None, (a or 0) + r.randint(-2, 9)])) for i in range(80)]
    kinds = [("f0", "f0", "modified"), ("f1", "f2", "renamed"), ("f1", "f1", "deleted"), ("new", "f3", "renamed"), ("f2", "f2", "modified")]
    files = [(p, o, s, [tuple(r.randint(0, 50) if k % 2 == 0 else r.randint(0, 3) for k in range(4)) for _ in range(r.randint(1, 4))]) for p, o, s in kinds] + [("f2", "f2", "touched", [])]
    want = set()
    for x in spans:
        for p, o, s, ranges in files:
            hit = any(x[4] is not None and x[4] + 1 <= a + max(m, 1) - 1 and (x[4] if x[5] is None else x[5]) + 1 >= a for q in ranges for a, m in [(q[0], q[1]) if s == "deleted" or q[3] == 0 else (q[2], q[3])])
            if x[3] == (o if p == "new" else p) and (hit or not ranges):
                want.add((x[0], p, s))
    table = spark.createDataFrame(files, "path string, old_path string, status string, ranges array<struct<old_start:int,old_lines:int,new_start:int,new_lines:int>>")
    assert {(x.id, x.path, x.status) for x in diff.changed_symbols(nodes(spark, *spans), table).collect()} == want and len(want) > 20


def test_rename(spark):
    n = nodes(spark, ("W", "Function", "Work", "m.go", 0, 0), ("R", "Function", "Run", "m.go", 1, 1))
    e = edges(spark, ("CALLS", "R", "W"))
    files = spark.createDataFrame([("m.go", "func Work() { }\nfunc Run() { return Work(1) }\nWorker")], "path string, content string")
    plan = diff.rename_plan(n, e, files, "W", "Execute")
    assert plan["safe"] and not plan["requires_review"] and [o["kind"] for o in plan["occurrences"]] == ["declaration", "semantic-reference"]
    clash = diff.rename_plan(n, e, files, "W", "Run")
    assert not clash["safe"] and clash["conflicts"][0]["severity"] == "error"
    with pytest.raises(InvalidRequest):
        diff.rename_plan(n, e, files, "W", "1x")


def test_enclosing_takes_the_innermost(spark):
    spans = spark.createDataFrame([("f", "outer", 0, 100), ("f", "inner", 10, 20)], "file_path string, node_id string, start int, end int")
    at = spark.createDataFrame([(1, "f", 15), (2, "f", 50), (3, "f", 500)], "key long, file_path string, at int")
    assert found(diff.enclosing(at, spans), "key", "node_id") == [(1, "inner"), (2, "outer")]


def test_tiers(spark):
    d = spark.createDataFrame([("a.py", "f", "1", "Function"), ("b.py", "f", "2", "Function"), ("b.py", "g", "3", "Function"), ("c.py", "h", "4", "Function"), ("d.py", "h", "5", "Function")], "file_path string, name string, node_id string, type string")
    refs = spark.createDataFrame([(1, "a.py", "f"), (2, "x.py", "f"), (3, "x.py", "h"), (4, "x.py", "g"), (5, "y.py", "g")], "ref_id long, file_path string, name string")
    i = spark.createDataFrame([("x.py", "b.py"), ("x.py", "b.py")], "file_path string, target string")
    assert found(resolve.resolve_symbols(refs, d, i), "ref_id", "node_id", "tier") == [(1, "1", "same-file"), (2, "2", "import-resolved"), (4, "3", "import-resolved"), (5, "3", "unique-global")]


def test_calls_by_type_arity_and_form(spark):
    d = spark.createDataFrame([("a", "Base", "B", "Class", None, None), ("a", "Sub", "S", "Class", None, None), ("a", "run", "B.run", "Method", 1, "B"), ("a", "go", "go1", "Function", 1, None), ("b", "go", "go2", "Function", 2, None), ("b", "only", "only", "Function", None, None)],
        "file_path string, name string, node_id string, type string, parameter_count int, owner_id string")
    calls = spark.createDataFrame([(1, "z", "run", "Sub", "member", 1), (2, "z", "go", None, "free", 2), (3, "z", "only", None, "member", 0), (4, "z", "run", "Nope", "member", 1), (5, "z", "only", None, "free", -1)],
        "call_id long, file_path string, call_name string, receiver_type string, call_form string, arg_count int")
    none = spark.createDataFrame([], "file_path string, target string")
    up = spark.createDataFrame([("S", "B")], "child string, parent string")
    assert found(resolve.resolve_calls(calls, d, none, up), "call_id", "node_id") == [(1, "B.run"), (2, "go2"), (5, "only")]


def test_typed_calls_with_defaults_and_visibility(spark):
    d = spark.createDataFrame([("main.cc", "Fixture", "F", "Class", None, None), ("main.cc", "Reopen", "F.Reopen", "Method", 1, "F"), ("public/i.h", "Iterator", "P", "Class", None, None), ("public/i.h", "Valid", "P.Valid", "Method", 0, "P"),
        ("internal/s.h", "Iterator", "S", "Class", None, None), ("internal/s.h", "Valid", "S.Valid", "Method", 0, "S")], "file_path string, name string, node_id string, type string, parameter_count int, owner_id string")
    calls = spark.createDataFrame([(1, "main.cc", "cpp", "Reopen", "Fixture", "member", 0), (2, "main.cc", "cpp", "Valid", "Iterator", "member", 0), (3, "else.cc", "cpp", "Valid", "Iterator", "member", 0)], "call_id long, file_path string, language string, call_name string, receiver_type string, call_form string, arg_count int")
    i = spark.createDataFrame([("main.cc", "public/db.h"), ("public/db.h", "public/i.h")], "file_path string, target string")
    assert found(resolve.resolve_calls(calls, d, i), "call_id", "node_id", "reason") == [(1, "F.Reopen", "receiver-type-default-args"), (2, "P.Valid", "receiver-type-exact")]


def test_imports(spark):
    files = spark.createDataFrame([("src/app/util.py",), ("src/Main.java",), ("src/x.ts",)], "path string")
    i = spark.createDataFrame([("src/app/main.py", "./util"), ("a.py", "app.util"), ("a.py", "main"), ("src/y.ts", "./x"), ("a.py", "./util")], "file_path string, import_path string")
    assert found(resolve.resolve_imports(i, files), "file_path", "import_path", "target") == [("a.py", "app.util", "src/app/util.py"), ("a.py", "main", "src/Main.java"), ("src/app/main.py", "./util", "src/app/util.py"), ("src/y.ts", "./x", "src/x.ts")]


def test_heritage(spark):
    d = spark.createDataFrame([("a", "C", "c", "Class"), ("a", "I", "i", "Interface"), ("a", "P", "p", "Class")], "file_path string, name string, node_id string, type string")
    h = spark.createDataFrame([("a", "C", "I", "extends"), ("a", "C", "P", "extends"), ("a", "C", "Unknown", "extends")], "file_path string, child_name string, parent_name string, heritage_type string")
    assert found(resolve.resolve_heritage(h, d, spark.createDataFrame([], "file_path string, target string")), "child_id", "parent_id", "type") == [("c", "i", "IMPLEMENTS"), ("c", "p", "EXTENDS")]


def test_c3():
    b = {"D": ["B", "C"], "B": ["A"], "C": ["A"]}
    assert mro.c3("D", b) == ["D", "B", "C", "A"]
    assert mro.c3("X", {"X": ["A", "B"], "A": ["X"]}) is None
    assert mro.c3("Z", {"Z": ["P", "Q"], "P": ["M", "N"], "Q": ["N", "M"]}) is None


def test_c3_merges_long_lists_in_proportion():
    """Chains with an interface at each step."""
    bases = {f"c{i}": [f"c{i - 1}", f"i{i}"] for i in range(1, 400)}
    begun = time.time()
    order = mro.c3("c399", bases)
    assert time.time() - begun < 3
    assert order == [f"c{i}" for i in range(399, -1, -1)] + [f"i{i}" for i in range(1, 400)]


def test_ancestor_depths_and_closure_agree_with_ancestors(spark):
    rng = random.Random(4)
    rows = [(f"k{i}", f"k{rng.randrange(12) if rng.random() < 0.1 else rng.randrange(i)}", "EXTENDS") for i in range(1, 25) for _ in range(2)]
    p = spark.createDataFrame(rows, "child string, parent string, type string")
    assert found(mro.ancestor_depths(p), "child", "ancestor", "depth") == found(mro.ancestors(p), "child", "ancestor", "depth")
    up = {}
    for c, a, _ in rows:
        up.setdefault(c, set()).add(a)
    reach = {(a, b) for a in up for b in up[a]}
    while more := {(a, c) for a, b in reach for c in up.get(b, ())} - reach:
        reach |= more
    assert found(traverse.closure(p.select(F.col("child").alias("a"), F.col("parent").alias("b"))), "a", "b") == sorted(reach)


def test_method_edges(spark):
    p = spark.createDataFrame([("C", "B", "EXTENDS"), ("B", "A", "EXTENDS"), ("C", "I", "IMPLEMENTS")], "child string, parent string, type string")
    order = mro.linearizations(p)
    m = spark.createDataFrame([("A", "f", "A.f"), ("C", "f", "C.f"), ("I", "g", "I.g"), ("C", "g", "C.g")], "owner_id string, name string, node_id string")
    assert found(mro.method_edges(order, m, p), "type", "source", "target") == [("DISPATCHES_TO", "I.g", "C.g"), ("METHOD_IMPLEMENTS", "C.g", "I.g"), ("OVERRIDES", "C.f", "A.f")]


def test_leiden_finds_cliques(spark):
    def clique(names):
        return [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]

    e = spark.createDataFrame([*clique("abcd"), *clique("wxyz"), ("d", "w")], "source string, target string")
    c = dict(community.communities(e).collect())
    assert len({c[x] for x in "abcd"}) == len({c[x] for x in "wxyz"}) == 1 and c["a"] != c["z"]
    single = e.select(F.explode(F.array("source", "target")).alias("id")).distinct().withColumn("community", F.col("id"))
    members = spark.createDataFrame(list(c.items()), "id string, community string")
    assert community.modularity(e, members).first()[0] > community.modularity(e, single).first()[0]


def test_leiden_of_a_large_component():
    """Local moves are numpy sweeps, not one node at a time."""
    rng = np.random.default_rng(1)
    n, m, groups = 20_000, 200_000, 20
    a = rng.integers(0, n, m)
    b = np.where(rng.random(m) < 0.8, a % groups + groups * rng.integers(0, n // groups, m), rng.integers(0, n, m))
    keep = a != b
    begun = time.time()
    c = community.leiden(a[keep], b[keep], n, float(keep.sum()))
    assert time.time() - begun < 20
    assert len(set(c)) == groups and all(len(set(c[k::groups])) == 1 for k in range(groups))


def test_weak_components_in_blocks(spark):
    """More edges than one task takes, scattered and in blocks, and links that don't get fewer."""
    rows = [(f"n{i:03}", f"n{i + 3:03}") for i in range(90)] + [(f"h{i % 3}", f"m{i}") for i in range(60)] + [("loop", "loop")]
    e = spark.createDataFrame(rows, "source string, target string").repartition(5)
    whole = dict(mro.weak_components(e).collect())
    assert {whole[f"n{i:03}"] for i in range(93)} == {"n000", "n001", "n002"} and whole["m4"] == "h1" and whole["loop"] == "loop"
    assert dict(mro.weak_components(e, few=20).collect()) == whole


def test_traces_shuffle_no_paths_to_count_them(spark, monkeypatch):
    """An entry that has its number stops, others go on; no level is sorted by entry for that."""
    plans, cut = [], community.cut

    def watched(df):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return cut(df)

    monkeypatch.setattr(community, "cut", watched)
    calls = spark.createDataFrame([("r", "a"), ("r", "b"), ("a", "x"), ("b", "y"), ("y", "z"), ("q", "b")], "source string, target string")
    got = community.traces(ids(spark, "r", "q"), calls, per_entry=1)
    assert found(got, "entry", "path") == [("q", ["q", "b", "y", "z"]), ("r", ["r", "a", "x"])]
    assert not any("Window" in p for p in plans[1:])


def test_traces_and_processes(spark):
    calls = spark.createDataFrame([("m", "a"), ("a", "b"), ("b", "m"), ("m", "c")], "source string, target string")
    t = community.traces(ids(spark, "m", "a"), calls)
    assert found(t, "entry", "path") == [("a", ["a", "b", "m", "c"]), ("m", ["m", "a", "b"])]
    many = spark.createDataFrame([("r", f"x{i}") for i in range(4)] + [(f"x{i}", f"y{i}{j}") for i in range(4) for j in range(4)] + [(f"y{i}{j}", f"z{i}{j}") for i in range(4) for j in range(4)], "source string, target string")
    first = community.traces(ids(spark, "r"), many, per_entry=12)
    assert found(first, "path") == [(["r", f"x{i}", f"y{i}{j}", f"z{i}{j}"],) for i in range(3) for j in range(4)]
    p = community.processes(t)
    assert p.count() == 2 and found(community.process_steps(p).where("source = 'a'"), "step") == [(1,), (2,)]
