import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lattica.llm import exact, simhash, spans
from lattica.llm import text as X

from .helpers import DOCS, odd_rows, sentence, table, text


# == exact
def brute_exact(rows):
    best = {}
    for k, r in enumerate(rows):
        if r[1] is None:
            best["null", k] = r
        elif r[1] not in best or (r[0] is not None and (best[r[1]][0] is None or r[0] < best[r[1]][0])):
            best[r[1]] = r
    return sorted(map(repr, best.values()))


def copies(seed=1, n=60):
    r = random.Random(seed)
    base = [text(r, "en", 3) for _ in range(n)]
    return [(i, r.choice(base), "en", "s") for i in range(2 * n)] + odd_rows(r)


def test_exact_against_brute_force(spark):
    rows = copies()
    for size in (64 << 20, 1):
        got = exact.exact_dedup(table(spark, rows).repartition(3), max_filter_bytes=size)
        assert got.columns == table(spark, rows).columns
        assert sorted(repr((x.doc_id, x.text, x.lang, x.source)) for x in got.collect()) == brute_exact(rows)


def test_a_full_filter_is_still_exact(spark):
    rows = [(i, f"text {i % 900}", "en", "s") for i in range(1800)]
    m = exact.filter_cells(10**9, 1)
    assert m == exact.SEGMENT
    assert exact.exact_dedup(table(spark, rows), max_filter_bytes=1).count() == 900


def test_exact_empty_and_clashing(spark):
    assert exact.exact_dedup(spark.createDataFrame([], DOCS)).count() == 0
    d = table(spark, [(1, "a", "x", "y"), (2, "a", "x", "y")]).withColumn("maybe_repeated", F.lit(5)).withColumn("text_hash", F.lit(6)).withColumn("h", F.lit(7))
    out = exact.exact_dedup(d)
    assert out.columns == d.columns and [r.doc_id for r in out.collect()] == [1]


def test_ties_of_text_and_id_go_the_same_way(spark):
    d = table(spark, [(1, "a", "x", str(k)) for k in range(6)])
    got = {tuple(exact.exact_dedup(d.repartition(n)).collect()[0]) for n in (1, 3, 5)}
    assert len(got) == 1


def test_cells_count_a_row_once():
    out = list(exact._touch([pa.RecordBatch.from_pydict({"h": pa.array([5, 6, None], pa.int64())})], 1 << 16))
    assert len(out) == 1 and len(exact._unpack(out[0]["more"][0].as_py()).nonzero()[0]) == 0
    again = list(exact._touch([pa.RecordBatch.from_pydict({"h": pa.array([5, 5], pa.int64())})], 1 << 16))
    assert exact._unpack(again[0]["more"][0].as_py()).sum() == len(set(exact.cells_of(np.array([5]), 1 << 16)[0].tolist()))


def test_packing_round_trip():
    r = np.random.default_rng(0)
    for n in (0, 1, 100, 5000, exact.SEGMENT):
        c = np.sort(r.choice(exact.SEGMENT, n, replace=False))
        assert (exact._unpack(exact._pack(c)).nonzero()[0] == c).all()


# == near
def brute_print(t):
    words = {w for w in (re.sub(r"[\W_]+", "", x.lower()) for x in t.split()) if w}
    total, half = np.zeros(128), 0
    for w in words:
        h = X.hash64(pa.array([w]))
        bits = np.unpackbits(np.stack([X.mix64(h), X.mix64(h ^ np.uint64(0xA5A5A5A55A5A5A5A))], 1).view(np.uint8))
        weight = 3 if len(w) > 3 else 1
        total += bits * weight
        half += weight
    return np.packbits(2 * total > half).view(">u8").astype(np.uint64)


def test_fingerprints_against_brute_force():
    r = random.Random(4)
    arr = [text(r, "fr", k) for k in (1, 2, 30, 400)] + ["", "a a a b", "..."]
    fp, some = simhash.fingerprints(pa.array(arr, pa.large_string()))
    assert some.tolist() == [True] * 4 + [False, True, False]
    for t, f, ok in zip(arr, fp, some):
        if ok:
            assert (brute_print(t) == f).all()


def noisy(r, t, share=0.05):
    words = t.split(" ")
    for i in r.sample(range(len(words)), max(1, int(len(words) * share))):
        words[i] = sentence(r, "en", 1)[:-1].lower()
    return " ".join(words)


def near_rows(seed=5, groups=25):
    r = random.Random(seed)
    rows, truth = [], []
    for g in range(groups):
        t = text(r, r.choice(["en", "fr", "de"]), 12)
        own = [len(rows)]
        rows.append((len(rows), t, "en", "s"))
        for _ in range(r.choice([0, 0, 1, 2, 6])):
            own.append(len(rows))
            rows.append((len(rows), noisy(r, t), "en", "s"))
        truth.append(own)
    return rows, truth


def brute_groups(rows, limit=24):
    fp, some = simhash.fingerprints(pa.array([r[1] or "" for r in rows], pa.large_string()))
    root = list(range(len(rows)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    pairs = set()
    for i in range(len(rows)):
        for j in range(i):
            if some[i] and some[j] and rows[i][0] is not None and rows[j][0] is not None and np.bitwise_count(fp[i] ^ fp[j]).sum() <= limit:
                pairs.add((j, i))
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
    return pairs, [top(i) for i in range(len(rows))]


def test_near_groups_meet_the_recall(spark):
    rows, truth = near_rows()
    pairs, _ = brute_groups(rows)
    got = {r.id: r.root for r in simhash.near_groups(table(spark, rows), leaf=4, list_size=16).collect()}
    assert pairs and sum(got.get(a, a) == got.get(b, b) for a, b in pairs) >= 0.9 * len(pairs)
    for i, r in got.items():
        assert any(i in g and r in g for g in truth)  # clean documents are left alone


def test_near_dedup_keeps_one_of_each_group(spark):
    rows, truth = near_rows(6, 12)
    out = simhash.near_dedup(table(spark, rows))
    kept = {r.doc_id for r in out.collect()}
    assert out.columns == DOCS.replace(" long", "").replace(" string", "").split(", ")
    assert kept == {g[0] for g in truth}


def test_near_odd_rows(spark):
    rows = odd_rows(random.Random(8))
    out = simhash.near_dedup(table(spark, rows).withColumn("near_copy_id", F.lit(1)).withColumn("root", F.lit(2)))
    assert out.count() == len(rows)
    assert simhash.near_dedup(spark.createDataFrame([], DOCS)).count() == 0
    same = table(spark, [(3, "one two three four", "a", "b"), (1, "One, two three four", "a", "b"), (2, "one two three four", "a", "b")])
    assert [r.doc_id for r in simhash.near_dedup(same).collect()] == [1]


def test_keep_probability_by_simulation():
    rng = np.random.default_rng(0)
    n, d = 4000, 22
    a = rng.integers(0, 2, (n, 128), dtype=np.uint8)
    b = a.copy()
    for i in range(n):
        b[i, rng.choice(128, d, replace=False)] ^= 1
    pa_, pb = (np.packbits(x, axis=1).view(">u8").astype(np.uint64) for x in (a, b))
    same = np.mean([simhash.strip_key(pa_[:, 0], pa_[:, 1], 4, np.random.default_rng(s)) == simhash.strip_key(pb[:, 0], pb[:, 1], 4, np.random.default_rng(s)) for s in range(10)])
    assert abs(same - simhash.keep_probability(d, 4)) < 0.02


def test_big_and_small_leaves_agree():
    rng = np.random.default_rng(1)
    hi, lo = (rng.integers(0, 1 << 63, 1500, dtype=np.uint64) for _ in range(2))
    hi[700:] = hi[0]
    lo[700:] = lo[0] ^ (np.uint64(1) << rng.integers(0, 63, 800, dtype=np.uint64))
    found = set()
    simhash._near_blocks(hi, lo, np.array([0]), np.array([1500]), 24, lambda a, b: found.update(zip(a.tolist(), b.tolist())))
    small = set()
    simhash._near_blocks(hi[700:1100], lo[700:1100], np.array([0]), np.array([400]), 24, lambda a, b: small.update(zip((a + 700).tolist(), (b + 700).tolist())))
    assert len(small) == 400 * 399 // 2 and small <= found and len(found) == 801 * 800 // 2


def test_components_of_a_long_chain(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    assert {(r.id, r.root) for r in simhash.components(e).collect()} == {(i, 0) for i in range(1, 41)} | {(101, 100)}
    assert simhash.components(e.where("false")).count() == 0


# == spans
def brute_spans(rows, runs=spans.RUNS):
    docs = [(i, t, re.sub(spans.BOUNDARY, lambda m: m.group() + "\x01", t).split("\x01")) for i, t, *_ in rows if t is not None]
    seen, gone = set(), {}
    for i, t, p in sorted(docs, key=lambda d: d[0]):
        k = [x.lower().strip() for x in p]
        for n, least in runs:
            for a in range(len(k) - n + 1):
                run = (n, *k[a : a + n])
                if sum(x.count(" ") + 1 for x in run[1:]) >= least:
                    if run in seen:
                        gone.setdefault(i, set()).update(range(a, a + n))
                    seen.add(run)
    return {i: "".join(x for j, x in enumerate(p) if j not in gone.get(i, ())) for i, t, p in docs if len(gone.get(i, ())) < len(p)}


def test_spans_against_brute_force(spark):
    r = random.Random(9)
    shared = [" ".join(sentence(r) for _ in range(6)) for _ in range(4)]
    rows = []
    for i in range(50):
        own = [sentence(r) for _ in range(r.randint(0, 6))]
        if r.random() < 0.5:
            own.insert(r.randint(0, len(own)), r.choice(shared))
        rows.append((i, r.choice(["\n", " "]).join(own), "en", "s"))
    rows.append((60, rows[3][1], "en", "s"))
    got = {x.doc_id: x.text for x in spans.dedup_spans(table(spark, rows)).collect()}
    assert got == brute_spans(rows)
    body = " ".join(got.values())
    assert all(body.count(s) <= 1 for s in shared)


def test_spans_repeat_inside_one_text(spark):
    r = random.Random(2)
    a, b = (" ".join(sentence(r) for _ in range(4)) for _ in range(2))
    out = spans.dedup_spans(table(spark, [(1, f"{a} {b} {a}", "en", "s")]), removed="n").first()
    assert out.text.strip() == f"{a} {b}" and out.n == 4


def test_short_sentences_count_and_characters_stay(spark):
    rows = [(1, "Go on. Stop. Wait.", "en", "s"), (2, "Go on. Stop. Wait. Then\x01 more\x02a\x02 of\x02b\x01.", "en", "s"), (3, "A\x01b. \x02a stays.", "en", "s")]
    got = {x.doc_id: x.text for x in spans.dedup_spans(table(spark, rows)).collect()}
    assert got == {1: rows[0][1], 2: "Then\x01 more\x02a\x02 of\x02b\x01.", 3: rows[2][1]}


def test_one_whole_long_sentence_between_cut_ones(spark):
    r = random.Random(5)
    a, b, c = (sentence(r, n=n) for n in (20, 18, 20))
    rows = [(1, f"{a} {b} {c}", "en", "s"), (2, " ".join(a.split()[5:]) + f" {b} " + " ".join(c.split()[:12]) + " and so on.", "en", "s")]
    assert b not in {x.doc_id: x.text for x in spans.dedup_spans(table(spark, rows)).collect()}[2]


def test_ids_need_not_be_numbers(spark):
    r = random.Random(3)
    t = text(r, "en", 8)
    near = t.replace(t.split()[30], "another", 1)
    d = table(spark, [(1, t, "en", "s"), (2, near, "en", "s"), (3, text(r), "en", "s"), (None, text(r), "en", "s")]).withColumn("doc_id", F.concat(F.lit("doc-"), F.col("doc_id").cast("string")))
    assert sorted(str(x.doc_id) for x in simhash.near_dedup(d).collect()) == ["None", "doc-1", "doc-3"]
    cut = {x.doc_id: x.n for x in spans.dedup_spans(d, removed="n").collect()}
    assert cut["doc-1"] == cut["doc-3"] == cut[None] == 0 and cut["doc-2"] > 0


def test_spans_odd_rows(spark):
    rows = odd_rows(random.Random(11))
    d = table(spark, rows).withColumn("span_id", F.lit(1)).withColumn("h", F.lit(2))
    out = spans.dedup_spans(d)
    assert out.columns == d.columns and sorted(repr(tuple(x)[:2]) for x in out.collect()) == sorted(repr(x[:2]) for x in rows)
    assert spans.dedup_spans(spark.createDataFrame([], DOCS)).count() == 0
