"""The registered queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontam, exact, langid, lm, mixing, pii, quality, simhash, spans, tokencount


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_docs(spark, sf_dir)).select("doc_id", "source", "n_chars", "mix_pass", "mix_block", "mix_key")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_dedup(_docs(spark, sf_dir))


def op3_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.dedup_spans(_docs(spark, sf_dir), removed="n_removed").select("doc_id", "text", "n_removed")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.redact_pii(_docs(spark, sf_dir).select("doc_id", "text"))


def op5_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.lm_scores(_docs(spark, sf_dir))


def op6_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_dedup(_docs(spark, sf_dir))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    return langid.identify(docs, langid.fit(docs)).select("doc_id", "lang", "lang_id", "lang_score", "lang_ok")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir).select("doc_id", "text")
    return quality.score(docs, quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))).drop("text")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), removed="leak_words_cut")


def op10_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(_docs(spark, sf_dir).select("doc_id", "text")).drop("text")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out = {f.__name__: f for f in (op1_mixing, op2_simhash, op3_spans, op4_pii, op5_lm, op6_exact, op7_language, op8_quality, op9_decontaminate, op10_tokens)}
    out["pipeline"] = pipeline
    return out


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def _number(expr: str) -> str:
    return f"('0x' || substr(md5({expr}), 1, 15))::BIGINT"


_EXPONENT_ROUNDS = mixing.ROUNDS

ORACLES = {
    # the exponent by bisection, then budgets, blocks and the last pass's cut-off
    "op1_mixing": rf"""
        WITH RECURSIVE d AS (
            SELECT *, CASE WHEN source IS NULL THEN 'n' ELSE 's' || source END AS s, coalesce(doc_id::VARCHAR, 'null') AS i,
                coalesce(len(regexp_extract_all(text, '\S+')), 0)::BIGINT AS n FROM documents),
        tot AS (SELECT s, sum(n)::BIGINT AS t FROM d GROUP BY s HAVING sum(n) > 0),
        whole AS (SELECT list(t ORDER BY s) AS ts, sum(t)::DOUBLE AS total, sum(t)::BIGINT AS budget FROM tot),
        p AS (SELECT list_transform(ts, lambda x: x / total) AS p, total, budget, len(ts) AS k FROM whole),
        bis AS (
            SELECT 0 AS r, 0.0::DOUBLE AS elo, 1.0::DOUBLE AS ehi, 0.0::DOUBLE AS rlo, 1.0::DOUBLE AS rhi
            UNION ALL
            SELECT r + 1,
                CASE WHEN high THEN (elo + ehi) / 2 ELSE elo END, CASE WHEN high THEN ehi ELSE (elo + ehi) / 2 END,
                CASE WHEN few THEN rlo ELSE (rlo + rhi) / 2 END, CASE WHEN few THEN (rlo + rhi) / 2 ELSE rhi END
            FROM (
                SELECT bis.*,
                    ln(list_sum(list_transform(p, lambda x: pow(x, (elo + ehi) / 2)))) - (elo + ehi) / 2 * list_sum(list_transform(p, lambda x: pow(x, (elo + ehi) / 2) * ln(x)))
                        / list_sum(list_transform(p, lambda x: pow(x, (elo + ehi) / 2))) >= 0.95 * ln(k) AS high,
                    pow(list_min(p), (rlo + rhi) / 2 - 1) / list_sum(list_transform(p, lambda x: pow(x, (rlo + rhi) / 2))) <= 4.0 AS few
                FROM bis, p WHERE r < {_EXPONENT_ROUNDS})),
        a AS (
            SELECT CASE WHEN k < 2 THEN 1.0 ELSE round(greatest(
                CASE WHEN -list_sum(list_transform(p, lambda x: x * ln(x))) >= 0.95 * ln(k) THEN 1.0 ELSE elo END,
                CASE WHEN 1 / list_min(p) / k <= 4.0 THEN 0.0 ELSE rhi END), 9) END AS a
            FROM bis, p WHERE r = {_EXPONENT_ROUNDS}),
        pw AS (SELECT s, t, pow(t / total, a) AS x, budget FROM tot, p, a),
        plan AS (
            SELECT s, ceil(t / {1 << 18})::BIGINT AS blocks, (take // t)::BIGINT AS f, (take % t)::BIGINT AS rest
            FROM (SELECT s, t, floor(round(x / (SELECT list_sum(list(x ORDER BY s)) FROM pw), 9) * budget)::BIGINT AS take FROM pw)),
        placed AS (
            SELECT doc_id, source, n_chars, d.s, i, n, f, rest, {_number("'11:' || i")} % blocks AS b, {_number("'d:11:' || f || ':' || i")} AS dk FROM d JOIN plan USING (s)),
        keyed AS (SELECT *, {_number("'11:' || s || ':' || f || ':' || b")} AS bk FROM placed),
        cum AS (SELECT *, sum(n) OVER (PARTITION BY s ORDER BY bk, b, dk) AS upto, sum(n) OVER (PARTITION BY s ORDER BY bk, b) AS block_upto FROM keyed),
        passes AS (
            SELECT doc_id, source, n_chars, s, i, b, unnest(range(f + CASE WHEN rest > 0 AND (block_upto <= rest OR upto <= rest) THEN 1 ELSE 0 END)) AS k FROM cum)
        SELECT doc_id, source, n_chars, k AS mix_pass, {_number("'11:' || s || ':' || k || ':' || b")} AS mix_block, {_number("'d:11:' || k || ':' || i")} AS mix_key FROM passes
    """,
    "op3_spans": r"""
        WITH d AS (
            SELECT doc_id, text, row_number() OVER () AS rid,
                string_split(regexp_replace(replace(replace(text, chr(2), chr(2) || 'b'), chr(1), chr(2) || 'a'), '([.!?]+[ \t\n\r\f]+|\n+)', '\1' || chr(1), 'g'), chr(1)) AS p FROM documents),
        s AS (SELECT doc_id, rid, unnest(p) AS raw, generate_subscripts(p, 1) AS pos FROM d),
        k AS (SELECT *, trim(lower(raw), chr(32) || chr(9) || chr(10) || chr(12) || chr(13)) AS t FROM s),
        w AS (SELECT doc_id, rid, pos, t, length(t) - length(replace(t, ' ', '')) + 1 AS n FROM k),
        v AS (SELECT *, lead(t) OVER o AS t2, lead(t, 2) OVER o AS t3, lead(n) OVER o AS n2 FROM w WINDOW o AS (PARTITION BY rid ORDER BY pos)),
        runs AS (
            SELECT doc_id, rid, pos, 3 AS len, [t, t2, t3] AS run FROM v WHERE t3 IS NOT NULL
            UNION ALL
            SELECT doc_id, rid, pos, 2, [t, t2] FROM v WHERE t2 IS NOT NULL AND n + n2 >= 16
            UNION ALL
            SELECT doc_id, rid, pos, 1, [t] FROM v WHERE n >= 16),
        again AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY run ORDER BY doc_id, pos) > 1),
        gone AS (SELECT DISTINCT rid, unnest(range(pos, pos + len)) AS pos FROM again),
        kept AS (
            SELECT s.rid, count(gone.pos) AS n_removed,
                replace(replace(string_agg(CASE WHEN gone.pos IS NULL THEN raw END, '' ORDER BY s.pos), chr(2) || 'a', chr(1)), chr(2) || 'b', chr(2)) AS text
            FROM s LEFT JOIN gone ON s.rid = gone.rid AND s.pos = gone.pos GROUP BY s.rid)
        SELECT d.doc_id, CASE WHEN coalesce(n_removed, 0) = 0 THEN d.text ELSE coalesce(kept.text, '') END AS text, coalesce(n_removed, 0)::BIGINT AS n_removed
        FROM d LEFT JOIN kept USING (rid) WHERE coalesce(n_removed, 0) < len(d.p) OR d.text IS NULL
    """,
    "op5_lm": r"""
        WITH d AS (SELECT doc_id, row_number() OVER () AS rid, list_filter(list_transform(string_split_regex(coalesce(text, ''), '\s+'), lambda x: regexp_replace(lower(x), '[^\p{L}\p{N}]+', '', 'g')), lambda x: x <> '') AS ws FROM documents),
        t AS (SELECT rid, unnest(ws) AS w, generate_subscripts(ws, 1) AS pos FROM d),
        g AS (SELECT *, lag(w) OVER o AS v, lag(w, 2) OVER o AS u FROM t WINDOW o AS (PARTITION BY rid ORDER BY pos)),
        c1 AS (SELECT w, count(*) AS c FROM g GROUP BY w),
        c2 AS (SELECT v, w, count(*) AS c FROM g WHERE v IS NOT NULL GROUP BY v, w),
        c3 AS (SELECT u, v, w, count(*) AS c FROM g WHERE u IS NOT NULL GROUP BY u, v, w),
        n AS (SELECT count(*) AS n FROM t),
        s AS (
            SELECT rid, CASE
                WHEN g.v IS NULL THEN round(log10(cw.c) * 10000) - round(log10(n) * 10000)
                WHEN c3.c >= 2 THEN round(log10((c3.c - 1) / (cuv.c - 1)) * 10000)
                WHEN c2.c >= 2 THEN round(log10(CASE WHEN g.u IS NULL THEN 1.0::DOUBLE ELSE 0.4::DOUBLE END * (c2.c - 1) / (cv.c - 1)) * 10000)
                ELSE round(log10(CASE WHEN g.u IS NULL THEN 0.4::DOUBLE ELSE 0.4::DOUBLE * 0.4::DOUBLE END * cw.c) * 10000) - round(log10(n) * 10000) END AS units
            FROM g JOIN c1 cw ON cw.w = g.w LEFT JOIN c1 cv ON cv.w = g.v LEFT JOIN c2 ON c2.v = g.v AND c2.w = g.w
                LEFT JOIN c2 cuv ON cuv.v = g.u AND cuv.w = g.v LEFT JOIN c3 ON c3.u = g.u AND c3.v = g.v AND c3.w = g.w, n),
        x AS (SELECT rid, sum(units) AS units FROM s GROUP BY rid)
        SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(units, 0) / 10000.0::DOUBLE AS lm_logprob, CASE WHEN len(ws) > 0 THEN units / 10000.0::DOUBLE / len(ws) END AS lm_mean
        FROM d LEFT JOIN x USING (rid)
    """,
    "op6_exact": """
        SELECT doc_id, text, lang, source, n_chars FROM documents
        QUALIFY text IS NULL OR row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1
    """,
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
