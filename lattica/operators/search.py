"""Symbol search by BM25, source search by lines, vector search, rank fusion, quantisation."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import cosine, file_kind, in_scope, tokens
from ..schema import InvalidRequest

K1, B = 1.2, 0.75
BOOSTS = {"name": 3.0, "file_path": 1.5, "content": 1.0}
RRF = 60


def _equals(word: str):
    return lambda x: x == word


# == symbols
def _tokenised(docs: DataFrame, id_col: str, fields) -> DataFrame:
    """(field, node_id, t): the tokens of every field."""
    own = F.array(*[F.struct(F.lit(f).alias("field"), tokens(F.coalesce(F.col(f), F.lit(""))).alias("t")) for f in fields])
    return docs.select(F.col(id_col).alias("node_id"), F.explode(own).alias("x")).select("x.field", "node_id", "x.t")


def postings(docs: DataFrame, id_col: str = "node_id", fields=tuple(BOOSTS)) -> DataFrame:
    """(term, field, node_id, tf, length): the inverted index of symbol documents, laid out to be stored.

    Rows are partitioned and sorted by term, so a stored index reads only the row groups of a query's terms.
    """
    d = _tokenised(docs, id_col, fields).select("field", "node_id", F.size("t").alias("length"), F.explode("t").alias("term"))
    return d.groupBy("term", "field", "node_id", "length").agg(F.count("*").alias("tf")).select("term", "field", "node_id", "tf", "length").repartition("term").sortWithinPartitions("term", "field")


def index_stats(docs: DataFrame, id_col: str = "node_id", fields=tuple(BOOSTS)) -> DataFrame:
    """(field, docs, avg): how many documents there are, and the mean number of tokens of each field."""
    return _tokenised(docs, id_col, fields).groupBy("field").agg(F.count("*").alias("docs"), F.avg(F.size("t")).alias("avg"))


def bm25_stored(index: DataFrame, stats: DataFrame, query: str, limit: int | None = 20) -> DataFrame:
    """``bm25`` over stored postings and statistics: only the rows of the query's terms are read."""
    if not query.strip():
        raise InvalidRequest("empty query")
    own = index.where(F.col("term").isin(query_terms(query)))
    # a row for each field and term of the query
    df = F.broadcast(own.groupBy("field", "term").agg(F.count("*").alias("df")).join(F.broadcast(stats), "field"))
    boost = F.create_map(*[F.lit(x) for kv in BOOSTS.items() for x in kv])
    idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = F.coalesce(boost[F.col("field")], F.lit(1.0)) * idf * (K1 + 1) * F.col("tf") / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("avg")))
    out = own.join(df, ["field", "term"]).groupBy("node_id").agg(F.round(F.sum(part), 6).alias("score")).where("score > 0")
    return out.orderBy(F.desc("score"), "node_id").limit(limit) if limit else out


def query_terms(query: str) -> list[str]:
    from ..functions.text import STOP_WORDS

    found = [x.lower() for x in re.findall(r"[A-Z][a-z0-9_]*|[a-z0-9_]+", re.sub("[^A-Za-z0-9_]", " ", query))]
    return sorted({x for x in found if len(x) >= 2 and x not in STOP_WORDS})


def bm25(docs: DataFrame, query: str, limit: int | None = 20, id_col: str = "node_id", fields=tuple(BOOSTS)) -> DataFrame:
    """(node_id, score): any query term in any field, fields weighted; ties by id. No terms, no rows."""
    if not query.strip():
        raise InvalidRequest("empty query")
    terms = query_terms(query)
    if not terms:
        return docs.select(F.col(id_col).alias("node_id"), F.lit(0.0).alias("score")).where("false")
    text = {f: F.coalesce(F.col(f), F.lit("")) for f in fields}

    def tokenised(df: DataFrame) -> DataFrame:
        return df.select(F.col(id_col).alias("node_id"), *[tokens(text[f]).alias(f"t{k}") for k, f in enumerate(fields)])

    tf = {(k, w): F.size(F.filter(f"t{k}", _equals(w))) for k in range(len(fields)) for w in terms}
    # one pass for the statistics: a single row
    stats = tokenised(docs).agg(F.count("*").alias("docs"), *[F.avg(F.size(f"t{k}")).alias(f"avg{k}") for k in range(len(fields))], *[F.sum((c > 0).cast("long")).alias(f"df{k}_{w}") for (k, w), c in tf.items()]).first()
    score = F.lit(0.0)
    for (k, w), c in tf.items():
        df = stats[f"df{k}_{w}"] or 0
        if df:
            weight = BOOSTS.get(fields[k], 1.0) * math.log(1 + (stats["docs"] - df + 0.5) / (df + 0.5)) * (K1 + 1)
            score = score + F.when(c > 0, F.lit(weight) * c / (c + K1 * (1 - B + B * F.size(f"t{k}") / F.lit(stats[f"avg{k}"])))).otherwise(0.0)
    # a token is part of its text, so only rows with a term anywhere in a field are tokenised again
    maybe = F.lit(False)
    for f in fields:
        for w in terms:
            maybe = maybe | F.lower(text[f]).contains(w)
    out = tokenised(docs.where(maybe)).select("node_id", F.round(score, 6).alias("score"))
    return (out.orderBy(F.desc("score"), "node_id").limit(limit) if limit else out).where("score > 0")


# == source text
@dataclass(frozen=True)
class SourceQuery:
    text: str = ""
    lang: str = ""
    file: str = ""
    regex: bool = False
    case: bool = False


def parse_query(query: str) -> SourceQuery:
    """``lang:``, ``file:``, ``regex:`` and ``case:`` filters; all other words are the text."""
    lang = file = ""
    regex, case, rest = False, "auto", []
    for word in query.split():
        key, colon, value = word.partition(":")
        if colon and key == "lang":
            lang = value.lower()
        elif colon and key == "file":
            file = value
        elif colon and key == "regex" and value in ("true", "yes", "false", "no"):
            regex = value in ("true", "yes")
        elif colon and key == "case":
            case = value
        else:
            rest.append(word)
    text = " ".join(rest)
    if not (text or lang or file):
        raise InvalidRequest("empty source query")
    try:
        re.compile(file), re.compile(text) if regex else None
    except re.error as e:
        raise InvalidRequest(f"bad pattern: {e}") from e
    return SourceQuery(text, lang, file, regex, case in ("yes", "true") or (case == "auto" and text != text.lower()))


def source_search(files: DataFrame, query: str, scope: str = "code", limit: int | None = 20, context: int = 0) -> DataFrame:
    """(path, line, text, before, after): matching lines by (path, line); an empty text matches every line.

    ``files`` has path, language and content; the kind is computed where there is no such column.
    Files are filtered before any is split; a literal text must occur in the file at all.
    """
    q = parse_query(query)
    kind: Column = F.col("kind") if "kind" in files.columns else file_kind(F.col("path"), F.col("content"))
    f = files.where(in_scope(kind, scope))
    if q.lang:
        f = f.where(F.lower("language") == q.lang)
    if q.file:
        f = f.where(F.col("path").rlike("(?i)" + q.file))
    fold = lambda c: c if q.case else F.lower(c)
    wanted = q.text if q.case else q.text.lower()
    if q.text and not q.regex:
        f = f.where(fold(F.col("content")).contains(wanted))
    lines = f.select("path", F.split("content", "\n").alias("all")).select("path", "all", F.posexplode("all").alias("n", "text"))
    if q.text:
        lines = lines.where(F.col("text").rlike(q.text if q.case else "(?i)" + q.text) if q.regex else fold(F.col("text")).contains(wanted))
    near = lambda a, b: F.slice("all", a, F.greatest(b, F.lit(0)))
    n, k = F.col("n"), F.lit(context)
    out = lines.select("path", (n + 1).alias("line"), "text", near(F.greatest(n - k + 1, F.lit(1)), F.least(n, k)).alias("before"), near(n + 2, F.least(k, F.size("all") - n - 1)).alias("after"))
    return out.orderBy("path", "line").limit(limit) if limit else out


# == vectors
def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", query_id: str = "query_id", batch: int = 2048, max_broadcast_bytes: int = 64 << 20, digits: int = 6, params: list[tuple[float, float]] | None = None) -> DataFrame:
    """(query_id, id, similarity, rank): exact cosine neighbours of each query, ties by id.

    Queries of at most ``max_broadcast_bytes`` (as doubles, with their k best) are broadcast and every
    partition keeps its own k best by matrix products of ``batch`` vectors with as many queries; only
    those are shuffled. More queries than that go in rounds. Similarities are rounded to ``digits``
    (12 at most) before they are compared. With ``params``, (offset, scale) by dimension, vectors are
    stored int8 codes in a column ``code`` and are decoded as they are read.
    """
    import numpy as np
    import pandas as pd

    rows = queries.select(query_id, "embedding").orderBy(query_id)
    column = "embedding" if params is None else "code"
    offset, scale = np.array(params if params is not None else [(0.0, 1.0)]).T

    def matrix_of(column: pd.Series, size: int) -> np.ndarray:
        if params is None:
            return np.stack(column.to_numpy()).astype(float)
        return np.frombuffer(b"".join(column), np.uint8).reshape(-1, size) * scale + offset

    spark = vectors.sparkSession
    out = None

    def search(qids: list, matrix: np.ndarray):
        shared = spark.sparkContext.broadcast((np.array(qids, object), matrix))

        def run(batches):
            ids, q = shared.value
            best_s, best_i = np.empty((len(ids), 0)), None
            for pdf in batches:
                for at in range(0, len(pdf), batch):
                    part = pdf.iloc[at : at + batch]
                    part = part[part[column].map(lambda v: v is not None and len(v) == q.shape[1])].sort_values("id")
                    if not len(part):
                        continue
                    m = matrix_of(part[column], q.shape[1])
                    norm = np.linalg.norm(m, axis=1)
                    names, n = np.array(part["id"].tolist()), len(part)
                    near = min(k, n)
                    new_s, new_i = np.empty((len(ids), near)), np.empty((len(ids), near), names.dtype)
                    for lo in range(0, len(ids), batch):
                        own = slice(lo, lo + batch)
                        s = q[own] @ m.T
                        s = np.round(np.divide(s, norm, out=np.zeros_like(s), where=norm > 0), digits)
                        # places are in the ids' order, so no two keys are the same and ties go by id
                        key = np.rint(np.nan_to_num(s, nan=-2.0) * -(10.0**digits)).astype(np.int64) * n + np.arange(n)
                        top = np.argpartition(key, near - 1, axis=1)[:, :near]
                        new_s[own], new_i[own] = np.take_along_axis(s, top, 1), names[top]
                    best_s, best_i = np.concatenate([best_s, new_s], 1), new_i if best_i is None else np.concatenate([best_i, new_i], 1)
                    if best_s.shape[1] > k:
                        order = np.lexsort((best_i, -best_s), axis=1)[:, :k]
                        best_s, best_i = np.take_along_axis(best_s, order, 1), np.take_along_axis(best_i, order, 1)
            for lo in range(0, len(ids) if best_s.shape[1] else 0, batch):
                own = slice(lo, lo + batch)
                yield pd.DataFrame({"query_id": np.repeat(ids[own], best_s.shape[1]), "id": best_i[own].ravel(), "similarity": best_s[own].ravel()})

        kind = dict(vectors.dtypes)[id_col], dict(queries.dtypes)[query_id]
        return vectors.select(F.col(id_col).alias("id"), column).mapInPandas(run, f"query_id {kind[1]}, id {kind[0]}, similarity double")

    held: list = []
    for r in rows.toLocalIterator():
        held.append(r)
        if len(held) * 8 * (len(held[0][1] or ()) + 2 * k) >= max_broadcast_bytes:
            part = search([x[0] for x in held], _unit(np.array([x[1] for x in held], float)))
            out, held = part if out is None else out.unionByName(part), []
    if held or out is None:
        part = search([x[0] for x in held], _unit(np.array([x[1] for x in held], float).reshape(len(held), -1)))
        out = part if out is None else out.unionByName(part)
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _unit(m):
    import numpy as np

    n = np.linalg.norm(m, axis=1, keepdims=True) if m.size else m
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0) if m.size else m


def fuse(ranked: DataFrame, limit: int | None = None, priority: Column | None = None) -> DataFrame:
    """(id, score, sources, best): reciprocal ranks of (source, id, rank[, similarity]) summed.

    Ordered by score, then ``priority`` (over the id), then id.
    """
    best = F.max("similarity") if "similarity" in ranked.columns else F.lit(None).cast("double")
    out = ranked.groupBy("id").agg(F.round(F.sum(1.0 / (RRF + F.col("rank"))), 9).alias("score"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"), best.alias("best"))
    if limit is None:
        return out
    return out.orderBy(F.desc("score"), *([priority] if priority is not None else []), "id").limit(limit)


def dual_search(vectors: DataFrame, query, limit: int = 10, id_col: str = "node_id") -> DataFrame:
    """(id, score, sources, best): twice the limit from each modality, fused; best cosine as similarity.

    ``vectors`` has (id, modality, embedding).
    """
    q = F.array(*[F.lit(float(v)) for v in query])
    scored = vectors.select(F.col(id_col).alias("id"), F.col("modality").alias("source"), F.round(cosine(F.col("embedding"), q), 6).alias("similarity"))
    w = Window.partitionBy("source").orderBy(F.desc("similarity"), "id")
    return fuse(scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= 2 * limit), limit)


def label_priority(label: Column) -> Column:
    return F.when(label == "Interface", 1).when(label.isin("Struct", "Class"), 2).when(label.isin("Function", "Method"), 3).when(label == "Trait", 4).when(label == "Constructor", 5).otherwise(10)


def hybrid(lexical: DataFrame, semantic: DataFrame, nodes: DataFrame, limit: int = 20) -> DataFrame:
    """(rank, id, score, sources): lexical (node_id, score) and semantic (id, score) lists fused by rank; ties by label, then id."""
    lex = lexical.select(F.col("node_id").alias("id"), "score").orderBy(F.desc("score"), "id").limit(2 * limit)
    sem = semantic.select("id", "score").orderBy(F.desc("score"), "id").limit(2 * limit)
    # both lists are at most twice the limit long, so one partition numbers them
    w = Window.orderBy(F.desc("score"), "id")
    ranked = lex.select(F.lit("lexical").alias("source"), "id", F.row_number().over(w).alias("rank")).unionByName(sem.select(F.lit("semantic").alias("source"), "id", F.row_number().over(w).alias("rank")))
    fused = fuse(ranked).join(nodes.select("id", label_priority(F.col("label")).alias("p")), "id", "left")
    order = [F.desc("score"), F.coalesce("p", F.lit(10)), F.col("id")]
    return fused.orderBy(*order).limit(limit).select(F.row_number().over(Window.orderBy(*order)).alias("rank"), "id", "score", "sources")


def train_int8(vectors: DataFrame) -> DataFrame:
    """(dim, offset, scale): least value and 1/254 of the range of every dimension."""
    return vectors.select(F.posexplode("embedding").alias("dim", "v")).groupBy("dim").agg(F.min(F.col("v").cast("double")).alias("offset"), ((F.max(F.col("v").cast("double")) - F.min(F.col("v").cast("double"))) / 254).alias("scale"))


def encode_int8(vectors: DataFrame, params: list[tuple[float, float]], column: str = "embedding") -> Column:
    """Codes 0 to 255 by nearest rounding; a dimension without range is 0. ``params``: (offset, scale) by dimension."""
    p = F.array(*[F.struct(F.lit(o).alias("o"), F.lit(s).alias("s")) for o, s in params])
    return F.zip_with(F.col(column), p, lambda v, q: F.when(q["s"] > 0, F.least(F.greatest(F.round((v.cast("double") - q["o"]) / q["s"]), F.lit(0.0)), F.lit(255.0))).otherwise(0.0).cast("short"))


def decode_int8(codes: Column, params: list[tuple[float, float]]) -> Column:
    p = F.array(*[F.struct(F.lit(o).alias("o"), F.lit(s).alias("s")) for o, s in params])
    return F.zip_with(codes, p, lambda v, q: v.cast("double") * q["s"] + q["o"])


def code_table(vectors: DataFrame, params: list[tuple[float, float]], id_col: str = "vec_id") -> DataFrame:
    """(id, code): every vector as one byte a dimension, to be stored beside the vectors."""
    import numpy as np
    import pandas as pd

    offset, scale = np.array(params).T

    def run(batches):
        for pdf in batches:
            pdf = pdf[pdf["embedding"].map(lambda v: v is not None and len(v) == len(offset))]
            if len(pdf):
                m = np.stack(pdf["embedding"].to_numpy()).astype(float)
                # halves go up, as in SQL
                c = np.where(scale > 0, np.clip(np.floor((m - offset) / np.where(scale > 0, scale, 1) + 0.5), 0, 255), 0).astype(np.uint8)
                yield pd.DataFrame({"id": pdf["id"].to_numpy(), "code": [x.tobytes() for x in c]})

    kind = dict(vectors.dtypes)[id_col]
    return vectors.select(F.col(id_col).alias("id"), "embedding").mapInPandas(run, f"id {kind}, code binary")


def int8_params(vectors: DataFrame) -> list[tuple[float, float]]:
    """(offset, scale) by dimension, trained over all vectors."""
    return [(r["offset"], r["scale"]) for r in train_int8(vectors).orderBy("dim").collect()]


def two_stage(vectors: DataFrame, query, k: int = 10, widen: int = 4, id_col: str = "vec_id", codes: DataFrame | None = None, params: list[tuple[float, float]] | None = None) -> DataFrame:
    """(id, similarity): widen x k candidates by int8 codes, ranked again by the full vectors."""
    one = vectors.sparkSession.createDataFrame([(0, [float(v) for v in query])], "query_id int, embedding array<double>")
    return two_stage_many(vectors, one, k, widen, id_col, codes=codes, params=params).orderBy("rank").select("id", "similarity")


def two_stage_many(vectors: DataFrame, queries: DataFrame, k: int = 10, widen: int = 4, id_col: str = "vec_id", query_id: str = "query_id", codes: DataFrame | None = None, params: list[tuple[float, float]] | None = None) -> DataFrame:
    """(query_id, id, similarity, rank): ``two_stage`` for each (query_id, embedding) of ``queries``.

    Stored ``codes`` (id, code) with their ``params`` are used as they are; without them the vectors
    are coded first.
    """
    if codes is None:
        params = int8_params(vectors)
        codes = code_table(vectors, params, id_col)
    q = queries.select(F.col(query_id).alias("query_id"), F.col("embedding").alias("q"))
    coarse = top_k(codes, queries, widen * k, "id", query_id, digits=12, params=params).select("query_id", "id")
    full = coarse.join(vectors.select(F.col(id_col).alias("id"), "embedding"), "id").join(q, "query_id")
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    scored = full.select("query_id", "id", F.round(cosine(F.col("embedding"), F.col("q")), 6).alias("similarity"))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
