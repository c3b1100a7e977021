import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.functions import text as T
from lattica.functions.chunk import by_characters, by_members, chunk
from lattica.operators import search
from lattica.schema import InvalidRequest


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


def test_tokens(spark):
    assert one(spark, T.tokens(F.lit("HTTPRequest the my_var getX userName2"))) == ["request", "my_var", "get", "user", "name2"]
    assert one(spark, T.tokens(F.lit(""))) == []


def test_kinds(spark):
    kinds = {p: one(spark, T.file_kind(F.lit(p))) for p in ("main.go", "config.yml", "CMakeLists.txt", "README.md", "notes.log", "LICENSE", "a/b.PY")}
    assert kinds == {"main.go": "code", "config.yml": "config", "CMakeLists.txt": "config", "README.md": "docs", "notes.log": None, "LICENSE": "docs", "a/b.PY": "code"}


def test_names_and_paths(spark):
    assert [one(spark, T.valid_identifier(F.lit(x))) for x in ("été", "$a1", "1a", "a-b", "")] == [True, True, False, False, False]
    assert [one(spark, T.is_test_file(F.lit(x))) for x in ("a_test.go", "src/tests/x.py", "x.spec.ts", "contest.py", "FooTests.cs")] == [True, True, True, False, True]
    assert [one(spark, T.entry_name_factor(F.lit(x))) for x in ("handleClick", "main", "getName", "plain", "FooHandler")] == [1.5, 1.5, 0.3, 1.0, 1.5]
    assert one(spark, T.language(F.lit("x/y.hpp"))) == "cpp" and one(spark, T.framework_factor(F.lit("app/views.py"))) == 3.0


def docs(spark):
    rows = [("1", "parseConfig", "a.go", "parse config file"), ("2", "loadFile", "config.go", "load"), ("3", "other", "b.go", "nothing here")]
    return spark.createDataFrame(rows, "node_id string, name string, file_path string, content string")


def test_bm25(spark):
    assert [r.node_id for r in search.bm25(docs(spark), "config").collect()] == ["1", "2"]
    assert search.bm25(docs(spark), "the").count() == 0
    with pytest.raises(InvalidRequest):
        search.bm25(docs(spark), "  ")


FILES = [("main.go", "go", "package main\n\nfunc ParseConfig() {}\nfunc ParseOptions() {}\nParseConfig()"), ("config.yml", None, "ParseConfig: 1"), ("README.md", None, "ParseConfig docs"), ("notes.log", None, "ParseConfig")]


def test_source_search(spark):
    f = spark.createDataFrame(FILES, "path string, language string, content string")
    lines = lambda q, **a: [(r.path, r.line) for r in search.source_search(f, q, **a).collect()]
    assert lines("ParseConfig") == [("config.yml", 1), ("main.go", 3), ("main.go", 5)]
    assert lines("ParseConfig", scope="docs") == [("README.md", 1)] and len(lines("ParseConfig", scope="all")) == 4
    assert lines("lang:go file:MAIN ParseConfig") == [("main.go", 3), ("main.go", 5)]
    assert lines("lang:go regex:true Parse(Config|Options)") == [("main.go", 3), ("main.go", 4), ("main.go", 5)]
    assert lines("parseconfig case:yes") == [] and len(lines("parseconfig")) == 3
    r = search.source_search(f, "lang:go Options", context=1).first()
    assert (r.before, r.after) == (["func ParseConfig() {}"], ["ParseConfig()"])
    with pytest.raises(InvalidRequest):
        search.parse_query("case:yes")


def test_chunks():
    text = "\n".join("x" * 9 for _ in range(10))
    c = by_characters(text, 30, 10)
    assert all(b - a + 1 <= 5 for _, a, b, _ in c) and c[0][1] == 1 and c[-1][2] == 10
    assert {i for _, a, b, _ in c for i in range(a, b + 1)} == set(range(1, 11))
    assert by_characters("y" * 100, 30, 5) == [("y" * 100 + "\n", 1, 1, "character")]
    m = by_members("class A:\n  def f():\n    1\nclass B:\n  2", 1000)
    assert [(a, b) for _, a, b, _ in m] == [(1, 3), (4, 5)]
    assert chunk("a\nb", "Function") == [("a\nb", 1, 2, "function")] and chunk(None, "Class") == []


def vectors(spark, n=60, d=8):
    rng = np.random.default_rng(1)
    return spark.createDataFrame([(i, [float(x) for x in rng.normal(size=d)]) for i in range(n)], "vec_id long, embedding array<float>")


def test_top_k_is_exact(spark):
    v = vectors(spark)
    m = np.array([r.embedding for r in v.orderBy("vec_id").collect()])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    want = {(q, int(i)) for q in range(3) for i in np.argsort(-(m @ m[q]), kind="stable")[:5]}
    for room in (100, 2):
        got = search.top_k(v, v.where("vec_id < 3").select(F.col("vec_id").alias("query_id"), "embedding"), 5, max_broadcast_bytes=room * 100)
        assert {(r.query_id, r.id) for r in got.collect()} == want


def test_cosine_edge_cases(spark):
    a = lambda *x: F.array(*[F.lit(float(v)) for v in x])
    assert one(spark, T.cosine(a(1, 0), a(1))) == 0.0 and one(spark, T.cosine(a(0, 0), a(1, 0))) == 0.0 and one(spark, T.cosine(a(2, 0), a(1, 0))) == 1.0


def test_fusion(spark):
    r = spark.createDataFrame([("l", "a", 1), ("l", "b", 2), ("s", "b", 1)], "source string, id string, rank int")
    out = search.fuse(r, 5).collect()
    assert [x.id for x in out] == ["b", "a"] and out[0].sources == "l,s" and abs(out[0].score - (1 / 61 + 1 / 62)) < 1e-9


def test_stored_postings_score_alike(spark):
    d = docs(spark)
    index, stats = search.postings(d), search.index_stats(d)
    for q in ("parse config", "load the file", "missing word", "the"):
        assert search.bm25_stored(index, stats, q).collect() == search.bm25(d, q).collect()
    with pytest.raises(InvalidRequest):
        search.bm25_stored(index, stats, " ")


def test_int8_round_trip_and_recall(spark):
    v = vectors(spark, 200)
    q = v.first().embedding
    params = [(r.offset, r.scale) for r in search.train_int8(v).orderBy("dim").collect()]
    worst = v.select(F.expr("embedding").alias("e"), search.decode_int8(search.encode_int8(v, params), params).alias("d")).select(F.array_max(F.zip_with("e", "d", lambda x, y: F.abs(x - y))).alias("m")).agg(F.max("m")).first()[0]
    assert worst <= max(s for _, s in params) / 2 + 1e-6
    exact = {r.id for r in search.top_k(v, v.limit(1).select(F.lit(0).alias("query_id"), "embedding"), 10).collect()}
    assert len(exact & {r.id for r in search.two_stage(v, q, 10).collect()}) >= 9
