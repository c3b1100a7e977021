import itertools
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lattica.llm import langid, tokencount, trie

from .helpers import DOCS, odd_rows, table, text


def segmentations(word):
    for cuts in itertools.product((False, True), repeat=len(word) - 1):
        out, at = [], 0
        for i, c in enumerate(cuts, 1):
            if c:
                out.append(word[at:i])
                at = i
        yield [*out, word[at:]]


WORDS = ["▁the", "▁then", "▁there", "▁a", "abc", "▁zß", "▁\U0001f600a", "ththe"]


def test_forward_sums_every_segmentation():
    pieces = trie.Pieces(["▁", "▁t", "▁th", "▁the", "h", "e", "the", "re", "r", "a", "b", "ab", "bc", "n", "en"])
    index = {p: i for i, p in enumerate(pieces.pieces)}
    prob = np.random.default_rng(0).random((len(pieces.pieces), 2))
    got = trie.forward(WORDS, pieces, prob, 1e-3)
    for w, row in zip(WORDS, got):
        for k in range(2):
            total = 0.0
            for seg in segmentations(w):
                p = 1.0
                for s in seg:
                    p *= prob[index[s], k] if s in index else (1e-3 if len(s) == 1 else 0.0)
                total += p
            assert math.isclose(row[k], math.log(total), rel_tol=1e-9)


def test_best_counts_against_every_segmentation():
    pieces = trie.Pieces(["▁", "▁t", "▁th", "▁the", "h", "e", "the", "re", "r", "a", "b", "ab", "bc", "n", "en"])
    index = {p: i for i, p in enumerate(pieces.pieces)}
    score = -np.random.default_rng(1).random(len(pieces.pieces)) * 5
    best, count = trie.best_counts(WORDS, pieces, score, -9.0)
    for w, b, c in zip(WORDS, best, count):
        options = []
        for seg in segmentations(w):
            s = n = 0
            for x in seg:
                if x in index:
                    s, n = s + score[index[x]], n + 1
                elif len(x) == 1:
                    s, n = s - 9.0 * len(x.encode()), n + len(x.encode())
                else:
                    s = -math.inf
            options.append((s, -n))
        want = max(options)
        assert math.isclose(b, want[0], rel_tol=1e-9) and c == -want[1]


def plain_forward(w, index, prob, unknown):
    """The recurrence with a plain dictionary, scaled by powers of two."""
    a, scale = [[1.0] * prob.shape[1]], np.zeros(prob.shape[1])
    for d in range(1, len(w) + 1):
        s = np.zeros(prob.shape[1])
        for k in range(1, min(d, 16) + 1):
            if w[d - k : d] in index:
                s = s + np.array(a[d - k]) * prob[index[w[d - k : d]]]
            elif k == 1:
                s = s + np.array(a[d - 1]) * unknown
        a.append(s)
        if d % 8 == 0:
            x = 2.0 ** -np.floor(np.log2(s))
            scale -= np.log(x)
            a[-17:] = [np.array(v) * x for v in a[-17:]]
    return np.log(a[-1]) + scale


def plain_best(w, index, score, byte_score):
    a = [(0.0, 0)]
    for d in range(1, len(w) + 1):
        options = []
        for k in range(1, min(d, 16) + 1):
            b, c = a[d - k]
            if w[d - k : d] in index:
                options.append((b + score[index[w[d - k : d]]], c - 1))
            elif k == 1:
                n = len(w[d - 1].encode())
                options.append((b + byte_score * n, c - n))
        a.append(max(options))
    return a[-1][0], -a[-1][1]


def test_long_runs_are_segmented_whole(monkeypatch):
    """Unspaced runs of any length: alone, by many together, and across the parts they are matched in."""
    pieces = trie.Pieces(["▁", "▁t", "▁th", "▁the", "h", "e", "the", "re", "r", "a", "b", "ab", "bc", "n", "en", "hethere"])
    index = {p: i for i, p in enumerate(pieces.pieces)}
    rng, r = np.random.default_rng(0), random.Random(2)
    prob, score = rng.random((len(pieces.pieces), 2)) / 50, -rng.random(len(pieces.pieces)) * 5
    for chunk, many in ((1 << 15, 3), (1 << 15, 40), (37, 3)):
        monkeypatch.setattr(trie, "CHUNK", chunk)
        words = ["▁" + "".join(r.choice(["the", "there", "abc", "n", "漢", "\U0001f600", "é"]) for _ in range(n)) for n in (3, *[r.randint(12, 20) for _ in range(many)], 60, 900)]
        words.append("▁" + "漢" * 400)  # would underflow without logs
        got, (best, count) = trie.forward(words, pieces, prob, 1e-7), trie.best_counts(words, pieces, score, -9.0)
        for w, row, b, c in zip(words, got, best, count):
            assert np.allclose(row, plain_forward(w, index, prob, 1e-7), rtol=1e-9)
            want = plain_best(w, index, score, -9.0)
            assert math.isclose(b, want[0], rel_tol=1e-9) and c == want[1]


def test_expected_uses_of_a_long_run():
    pieces = trie.Pieces(["a", "b", "ab", "ba"])
    p = np.array([[0.3], [0.2], [0.4], [0.1]])
    items, counts = ["ab" * 4 + "x" + "a", "abab"], np.array([[2.0], [3.0]])
    lv = trie.Levels(items, pieces)
    by = np.zeros((lv.n, 1))
    np.add.at(by, lv.inverse, counts)
    out, logs = np.zeros((4, 1)), trie.log_prob(p, langid.UNKNOWN)
    for i in (0, 1):
        langid._add_expected(out, items[i], pieces, logs, counts[i])
    assert np.allclose(out, langid._expected(lv, p, by))


def test_each_prefix_is_one_node():
    lv = trie.Levels(["ab", "abc", "abd", "b"], trie.Pieces(["a"]))
    assert [len(f) for f in lv.first[1:]] == [2, 1, 2]


def test_find_is_a_dictionary():
    pieces, _ = trie.load_pieces()
    some = random.Random(3).sample(pieces.pieces, 500)
    h = np.array([pieces._hash(p) for p in some] + [pieces._hash(p + "一q") for p in some], np.uint64)
    got = pieces.find(h)
    assert [pieces.pieces[i] for i in got[:500]] == some and (got[500:] == -1).all()


def test_token_counts_odd_rows(spark):
    d = table(spark, odd_rows(random.Random(1)))
    rows = tokencount.token_counts(d.withColumn("n_tokens", F.lit("mine"))).collect()
    assert len(rows) == d.count()
    for r in rows:
        pre, tokens = tokencount.count_texts(pa.array([r.text or ""], pa.large_string()), trie.DEFAULT_VOCABULARY)
        assert (r.n_pretokens, r["_n_tokens"], r["n_tokens"]) == (pre[0], tokens[0], "mine")
        assert (r["_n_tokens"] == 0) == (not (r.text or "").strip())
    assert tokencount.token_counts(spark.createDataFrame([], DOCS)).count() == 0
    six = next(r for r in rows if r.doc_id == 6)
    assert six.n_pretokens == 1


def test_counts_add_up_over_words():
    a = pa.array(["the house of", "the house of the house"], pa.large_string())
    _, n = tokencount.count_texts(a, trie.DEFAULT_VOCABULARY)
    _, one = tokencount.count_texts(pa.array(["the", "house", "of"], pa.large_string()), trie.DEFAULT_VOCABULARY)
    assert n.tolist() == [one.sum(), one.sum() + one[0] + one[1]]


def corpus(seed, n):
    r = random.Random(seed)
    return [(i, text(r, lang), lang, "s") for i, lang in enumerate(r.choice(["en", "fr", "de"]) for _ in range(n))]


def test_language_on_held_out_texts(spark):
    model = langid.fit(table(spark, corpus(1, 60)), docs_per_language=15)
    held = table(spark, corpus(2, 90))
    out = langid.identify(held, model).collect()
    assert sum(r.lang == r.lang_id for r in out) >= 89 and sum(r.lang_ok for r in out) >= 89
    kept = langid.keep_identified(held, model)
    assert kept.columns == held.columns and kept.count() >= 89


def test_foreign_and_wordless_texts_are_rejected(spark):
    model = langid.fit(table(spark, corpus(1, 60)))
    odd = table(spark, [*odd_rows(random.Random(2)), (90, "Привет мир это русский текст о погоде", None, "x"), (91, "漢字漢字 漢字", None, "x")])
    out = langid.identify(odd, model).collect()
    assert len(out) == odd.count()
    by = {r.doc_id: r for r in out}
    assert not by[90].lang_ok and not by[91].lang_ok and by[5].lang_ok
    for i in (1, 2, 3):
        assert by[i].lang_id is None and not by[i].lang_ok and by[i].lang_score == 0


def test_no_labels_and_no_rows(spark):
    empty = spark.createDataFrame([], DOCS)
    model = langid.fit(empty)
    assert model.languages == () and langid.identify(empty, model).count() == 0
    assert not langid.identify(table(spark, corpus(1, 3)), model).where("lang_ok").count()


def test_clashing_names(spark):
    d = table(spark, corpus(1, 6)).withColumn("LANG_ID", F.lit(1)).withColumn("lang_ok", F.lit(2))
    out = langid.identify(d, langid.fit(d))
    assert out.columns[-3:] == ["_lang_id", "lang_score", "_lang_ok"] and out.count() == 6
    assert langid.keep_identified(d).columns == d.columns


def test_one_expectation_step_raises_the_likelihood():
    pieces = trie.Pieces(["a", "b", "ab", "ba"])
    items, counts = ["ab", "aba", "abab"], np.array([[5.0], [2.0], [1.0]])
    lv = trie.Levels(items, pieces)
    by = np.zeros((lv.n, 1))
    np.add.at(by, lv.inverse, counts)
    p = np.full((4, 1), 0.25)
    like = lambda q: float((counts * trie.forward(items, pieces, q, 1e-9)).sum())
    e = langid._expected(lv, p, by)
    assert like(e / e.sum()) > like(p)
    # expected characters are the characters there are
    assert math.isclose(float(e[:, 0] @ np.array([1, 1, 2, 2])), 2 * 5 + 3 * 2 + 4, rel_tol=1e-9)


def test_bounded_sample(spark):
    with pytest.MonkeyPatch.context() as m:
        seen = {}
        m.setattr(langid, "_expected", lambda lv, prob, counts: seen.setdefault("n", counts.sum()) or np.ones_like(prob))
        langid.fit(table(spark, corpus(1, 40)), docs_per_language=1, rounds=1)
    assert seen["n"] <= 3 * 8 * 12
