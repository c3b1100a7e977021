import random

import numpy as np
import pyarrow as pa

import corpus_pipeline
from lattica.llm import decontam, langid, mixing, trie

from .helpers import sentence, table, text
from .test_dedup import brute_groups, noisy
from .test_filters import brute_leaks, norm


def corpus(r):
    item = " ".join(sentence(r, "en", 10)[:-1] for _ in range(2))
    rows = []
    for i in range(60):
        rows.append([i, text(r, ("en", "fr", "de")[i % 3], 10), ("en", "fr", "de")[i % 3], f"src{min(i % 5, 2)}"])
    rows.append([60, rows[7][1], rows[7][2], "src0"])
    rows.append([61, noisy(r, rows[8][1]), rows[8][2], "src0"])
    rows.append([62, "Привет мир это русский текст", None, "src1"])
    rows.append([63, None, None, "src1"])
    rows[9][1] += " " + item
    return [tuple(x) for x in rows], item


def brute_language(t, model):
    """Sums segmentations word by word with a plain dictionary."""
    pieces, _ = trie.load_pieces(model.vocabulary)
    index = {p: i for i, p in enumerate(pieces.pieces)}
    total = np.zeros(model.prob.shape[1])
    for w in t.split():
        w = "▁" + w
        a = [np.ones(model.prob.shape[1])]
        for d in range(1, len(w) + 1):
            s = np.zeros(model.prob.shape[1])
            for k in range(1, d + 1):
                if w[d - k : d] in index:
                    s = s + a[d - k] * model.prob[index[w[d - k : d]]]
                elif k == 1:
                    s = s + a[d - 1] * langid.UNKNOWN
            a.append(s)
        total += np.log(a[-1])
    return total


def test_run_against_brute_force(spark, tmp_path):
    rows, item = corpus(random.Random(21))
    d = table(spark, rows)
    d.coalesce(2).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, item)], "item_id long, text string").coalesce(1).write.parquet(str(tmp_path / "benchmark.parquet"))
    model = langid.fit(spark.read.parquet(str(tmp_path / "documents.parquet")))
    kept = []
    for x in rows:
        if x[1] and norm(x[1]):
            total = brute_language(x[1], model)
            k = len(model.languages)
            post = 1 / np.exp(total[:k] - total[:k].max()).sum()
            if post >= 0.9 and total[:k].max() > total[k]:
                kept.append(x)
    assert len(kept) == 62
    seen, one = set(), []
    for x in sorted(kept):
        if x[1] not in seen:
            seen.add(x[1])
            one.append(x)
    _, top = brute_groups(one)
    near = [x for i, x in enumerate(one) if top[i] == i]
    assert len(near) == 60
    m = decontam.Matcher([item], 13, 0.7, 8)
    clean = {x[0]: [w for k, w in enumerate(norm(x[1])) if k not in brute_leaks(x[1], [item], m)] for x in near}
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    for r in out:
        assert norm(r.text) == clean[r.doc_id] and r.n_chars == len(r.text)
    assert norm(item)[3] not in clean[9][-20:] or len(clean[9]) < len(norm(rows[9][1]))
    # the mixture of what is left, by the operator that test_filters holds to its budgets
    want = mixing.mix(table(spark, [(x[0], next((r.text for r in out if r.doc_id == x[0]), x[1]), x[2], x[3]) for x in near]))
    assert sorted((r.doc_id, r.mix_pass) for r in out) == sorted((r.doc_id, r.mix_pass) for r in want.collect())


def test_stages_keep_the_columns(spark, tmp_path):
    rows, item = corpus(random.Random(22))
    d = table(spark, rows)
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] and len(corpus_pipeline.STAGES) == 5
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, d, str(tmp_path)).columns == d.columns


def test_registered_queries_and_their_sql(spark):
    from lattica.llm import queries

    q, sql = queries.queries(), queries.oracle_sql()
    assert [sum(n.startswith(f"op{k}_") for n in q) for k in range(1, 11)] == [1] * 10 and "pipeline" in q
    assert set(sql) <= set(q)


def test_texts_survive_slicing():
    from lattica.llm import text as X

    b = pa.RecordBatch.from_pydict({"t": ["a" * 10, None, "b" * 100, "", "c"]})
    parts = list(X.steps(iter([b, b.slice(0, 0)]), "t", 40))
    assert [x for p in parts for x in p.column(0).to_pylist()] == b.column(0).to_pylist() and len(parts) > 1
