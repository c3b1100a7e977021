"""Registered queries over small made-up tables, against brute force."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lattica import queries as Q
from lattica.operators import search
from lattica.plans import graph as G

PARTS = 1500


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    d = tmp_path_factory.mktemp("tables")
    r = np.random.default_rng(5)
    lines = [(o, int(p), o % 3, n + 1, 0.1, 0.0) for o in range(6) for n, p in enumerate(r.integers(PARTS - 200, PARTS, 5))]
    made = {
        "region": pd.DataFrame({"r_regionkey": [0], "r_name": ["r"]}), "nation": pd.DataFrame({"n_nationkey": [0], "n_name": ["n"], "n_regionkey": [0]}),
        "customer": pd.DataFrame({"c_custkey": range(70), "c_name": "c", "c_nationkey": 0}), "supplier": pd.DataFrame({"s_suppkey": range(3), "s_name": "s", "s_nationkey": 0}),
        "orders": pd.DataFrame({"o_orderkey": range(6), "o_custkey": range(6)}),
        "part": pd.DataFrame({"p_partkey": range(PARTS), "p_name": "p", "p_brand": [f"b{k % 7}" for k in range(PARTS)], "p_type": [f"t{k % 50}" for k in range(PARTS)], "p_size": [k % 11 for k in range(PARTS)]}),
        "lineitem": pd.DataFrame(lines, columns=["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_discount", "l_tax"]),
        # few values, so that many similarities are the same
        "embeddings": pd.DataFrame({"vec_id": range(90), "embedding": [x.tolist() for x in r.integers(-1, 3, (90, 4)).astype(float)]}),
    }
    for name, df in made.items():
        df.to_parquet(d / f"{name}.parquet")
    return str(d), made


def test_process_traces_go_ten_nodes_deep(spark, tables):
    d, t = tables
    want = set()
    for o, own in t["lineitem"].groupby("l_orderkey"):
        for p in sorted({f"Part:{p}" for p in own["l_partkey"]})[:4]:
            path = [f"Order:{o}", p]
            while len(path) < 10 and path[-1] != "Part:0":
                path.append(f"Part:{(int(path[-1][5:]) - 1) // 2}")
            want.add((f"Order:{o}", ">".join(path)))
    assert max(p.count(">") for _, p in want) == 9
    assert {tuple(r) for r in Q.process_traces(spark, d).collect()} == want


def nearest(t, k=10):
    m = np.array(t["embeddings"]["embedding"].tolist())
    n = np.linalg.norm(m, axis=1, keepdims=True)
    s = np.round((u := np.divide(m, n, out=np.zeros_like(m), where=n > 0)) @ u.T, 6)
    return {(q, i, rank + 1) for q in range(len(s)) for rank, i in enumerate(np.lexsort((np.arange(len(s)), -s[q]))[:k].tolist())}


def test_the_stated_vectors_are_queries(spark, tables):
    d, t = tables
    want = nearest(t)
    assert {(r.query_id, r.id, r["rank"]) for r in Q.vector_topk(spark, d).collect()} == {x for x in want if x[0] % 50 == 0}
    v = spark.read.parquet(f"{d}/embeddings.parquet").select(F.format_string("%03d", "vec_id").alias("vec_id"), "embedding").repartition(3)
    got = search.top_k(v, v.withColumnRenamed("vec_id", "query_id"), 10, batch=7)
    assert {(int(r.query_id), int(r.id), r["rank"]) for r in got.collect()} == want
    rounds = search.top_k(v, v.withColumnRenamed("vec_id", "query_id"), 10, max_broadcast_bytes=2000)
    assert {(int(r.query_id), int(r.id), r["rank"]) for r in rounds.collect()} == want


def test_recall_is_of_every_stated_vector_at_the_default_width(spark, tables):
    d, t = tables
    v = spark.read.parquet(f"{d}/embeddings.parquet")
    got = {r.query_id: r.recall for r in Q.int8_topk_recall(spark, d).collect()}
    assert got.keys() == {0, 50}
    exact = {(q, i) for q, i, _ in nearest(t)}
    for q in (0, 50):
        found = [r.id for r in search.two_stage(v, t["embeddings"]["embedding"][q], 10).collect()]
        assert got[q] == sum((q, i) in exact for i in found) / 10
    many = search.two_stage_many(v, v.where("vec_id = 17").withColumnRenamed("vec_id", "query_id"), 10, widen=1).orderBy("rank").collect()
    assert [(r.id, r.similarity) for r in many] == [tuple(r) for r in search.two_stage(v, t["embeddings"]["embedding"][17], 10, widen=1).collect()]


def test_tier_resolution_takes_every_line(spark, tables):
    d, t = tables
    parts = {k: (f"brand/b{k % 7}", f"t{k % 50} {k % 11}") for k in range(PARTS)}
    imports = {(parts[k][0], parts[k + 1][0]) for k in range(PARTS - 1)}
    named = {}
    for k, (f, n) in parts.items():
        named.setdefault(n, []).append((f, f"Part:{k}"))
    want = set()
    refs = {(o * 1_000_000 + (p + n) % PARTS, (p + n) % PARTS) for o, p, n in t["lineitem"][["l_orderkey", "l_partkey", "l_linenumber"]].itertuples(index=False)}
    for ref, k in refs:
        f, n = parts[k]
        for tier, test in (("same-file", lambda x: x == f), ("import-resolved", lambda x: (f, x) in imports), ("unique-global", lambda x: True)):  # noqa: B023
            if c := [node for x, node in named[n] if test(x)]:
                if len(c) == 1:
                    want.add((int(ref), c[0], tier))
                break
    assert len(want) > 6
    assert {(r.ref_id, r.node_id, r.tier) for r in Q.tier_resolution(spark, d).collect()} == want


def test_every_node_has_its_excerpt(spark, tables):
    d, _ = tables
    got = {r.id: r.excerpt for r in Q.source_excerpts(spark, d).collect()}
    assert got == {r.id: "\n".join(f"line {i}" for i in range(r.start_line, r.end_line + 1)) for r in G.nodes(spark, d).collect()} and len(got) > PARTS


def test_stored_codes_are_the_codes(spark, tables):
    d, t = tables
    v = spark.read.parquet(f"{d}/embeddings.parquet")
    codes, params = Q._codes(spark, d)
    m = np.array(t["embeddings"]["embedding"].tolist())
    lo, hi = m.min(0), m.max(0)
    want = np.floor((m - lo) / ((hi - lo) / 254) + 0.5)
    got = {r.id: np.frombuffer(r.code, np.uint8) for r in codes.collect()}
    assert all((got[k] == want[k]).all() for k in range(90))
    one = search.two_stage(v, t["embeddings"]["embedding"][3], 5, codes=codes, params=params).collect()
    assert one == search.two_stage(v, t["embeddings"]["embedding"][3], 5).collect()


def test_hunks_reach_the_same_symbols_as_a_loop(spark, tables):
    d, t = tables
    n = G.nodes(spark, d).collect()
    hunks = [(f"part/{k % 10}.go", k * 10 + 5, k * 10 + 5 + s % 40) for k, s in zip(t["part"]["p_partkey"], t["part"]["p_size"]) if s % 3 == 0]
    by_file = {}
    for f, a, b in hunks:
        by_file.setdefault(f, []).append((a, b))
    want = {x.id for x in n if x.label in Q.ACTIONABLE and any(x.start_line + 1 <= b and x.end_line + 1 >= a for a, b in by_file.get(x.file_path, ()))}
    assert {r.id for r in Q.diff_hunk_symbols(spark, d).collect()} == want and len(want) > 300


def test_paths_end_where_their_sql_ends(spark, tmp_path):
    made = {
        "region": pd.DataFrame({"r_regionkey": [2], "r_name": ["r"]}), "nation": pd.DataFrame({"n_nationkey": [0, 1], "n_name": "n", "n_regionkey": [2, 3]}),
        "customer": pd.DataFrame({"c_custkey": [2], "c_nationkey": [0]}), "supplier": pd.DataFrame({"s_suppkey": range(10), "s_nationkey": 1}), "orders": pd.DataFrame({"o_orderkey": [7, 8], "o_custkey": [2, 3]}),
        "part": pd.DataFrame({"p_partkey": range(21)}), "lineitem": pd.DataFrame({"l_orderkey": [7, 8], "l_partkey": [20, 19], "l_suppkey": [1, 9], "l_discount": 0.1, "l_tax": 0.0}),
    }
    for name, df in made.items():
        df.to_parquet(tmp_path / f"{name}.parquet")
    # Customer:2, Order:7, Part:20, Part:9, Supplier:9 is a hop longer than the SQL goes; two more hops lead to Supplier:5
    assert Q.shortest_path_edges(spark, str(tmp_path)).collect() == []
    assert [r.hops for r in Q.shortest_path_length(spark, str(tmp_path)).collect()] == [None]
    made["orders"].assign(o_custkey=[3, 2]).to_parquet(tmp_path / "orders.parquet")
    assert [(r.step, r.source, r.target) for r in Q.shortest_path_edges(spark, str(tmp_path)).orderBy("step").collect()] == [(1, "Customer:2", "Order:8"), (2, "Order:8", "Part:19"), (3, "Part:19", "Supplier:9")]
    made["supplier"].assign(s_nationkey=0).to_parquet(tmp_path / "supplier.parquet")
    assert [r.hops for r in Q.shortest_path_length(spark, str(tmp_path)).collect()] == [2]
