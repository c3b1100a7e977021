"""Mixing sources to target weights by temperature.

A source's weight is its share of all tokens to the power ``a``, normalised. The exponent between 0
(uniform) and 1 (as they are) is bisected: the largest that reaches the target entropy, raised if
need be to the smallest that keeps every source within the repetition limit.

Weights become budgets of tokens, and budgets passes over permuted blocks: documents fall into
blocks by a hash; a source is passed over as often as its budget allows, each time with its blocks
in another order, and the last pass stops inside a block where the budget ends. Blocks and
documents are ordered by hashes, so a pass needs one cut-off a source and no sort of the texts.
"""

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text as X

ROUNDS = 50
BROADCAST_SOURCES = 100_000


def solve_exponent(tokens: list[int], entropy: float, max_repeats: float, budget_share: float = 1.0) -> float:
    """The exponent for target entropy ``entropy`` x log(sources) and at most ``max_repeats`` passes.

    A limit that no exponent meets gives 1, the one that repeats least.
    """
    t = [x for x in tokens if x > 0]
    if len(t) < 2:
        return 1.0
    total = sum(t)
    p = [x / total for x in t]

    def z(a: float) -> float:
        return sum(x**a for x in p)

    def high_enough(a: float) -> bool:
        return math.log(z(a)) - a * sum(x**a * math.log(x) for x in p) / z(a) >= entropy * math.log(len(p))

    def repeats_few(a: float) -> bool:
        return budget_share * min(p) ** (a - 1) / z(a) <= max_repeats

    def bisect(good_low: bool, test) -> float:
        lo, hi = 0.0, 1.0
        for _ in range(ROUNDS):
            mid = (lo + hi) / 2
            if test(mid) == good_low:
                lo = mid
            else:
                hi = mid
        return lo if good_low else hi

    by_entropy = 1.0 if high_enough(1.0) else bisect(True, high_enough)
    by_repeats = 0.0 if repeats_few(0.0) else bisect(False, repeats_few)
    return round(max(by_entropy, by_repeats), 9)


def _number(*parts: Column | str) -> Column:
    """60 bits of MD5 over the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]).cast("binary")), 1, 15), 16, 10).cast("long")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", entropy: float = 0.95, max_repeats: float = 4.0, budget_tokens: int | None = None, block_tokens: int = 1 << 18, seed: int = 11) -> DataFrame:
    """The rows of ``docs`` as the mixture has them, with ``mix_pass``, ``mix_block`` and ``mix_key``.

    The order of training is (mix_block, mix_key). A document appears once in each pass that takes
    it. Tokens are runs without white space. The budget is all tokens of ``docs`` unless given.
    Null sources are one source of their own; null texts have no tokens; a source without tokens
    has weight 0 and is left out. Rows with equal or null ids share a place: the budget takes all
    of them or none. Empty tables give empty tables. Added columns get underscores where names clash.
    """
    spark = docs.sparkSession
    names = [X.fresh(docs, n) for n in ("mix_pass", "mix_block", "mix_key")]
    src = F.concat(F.when(F.col(source_col).isNull(), F.lit("n")).otherwise(F.lit("s")), F.coalesce(F.col(source_col).cast("string"), F.lit("")))
    ident = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    narrow = docs.select(src.alias("s"), ident.alias("i"), F.coalesce(F.regexp_count(text_col, F.lit(r"\S+")), F.lit(0)).cast("long").alias("n"))
    totals = {r["s"]: r["n"] for r in narrow.groupBy("s").agg(F.sum("n").alias("n")).collect() if r["n"]}
    total = sum(totals.values())
    budget = total if budget_tokens is None else budget_tokens
    order = sorted(totals)
    a = solve_exponent([totals[s] for s in order], entropy, max_repeats, budget / total if total else 1.0)
    powers = [(totals[s] / total) ** a for s in order]
    plan = []
    for s, x in zip(order, powers):
        take = math.floor(round(x / sum(powers), 9) * budget)
        plan.append((s, -(-totals[s] // block_tokens), take // totals[s], take % totals[s]))
    # one row a source: broadcast while that is small, joined by Catalyst's choice beyond
    small = F.broadcast if len(plan) <= BROADCAST_SOURCES else lambda df: df
    plans = small(spark.createDataFrame(plan, "s string, blocks long, full long, rest long"))

    block, doc_key = (_number(str(seed), F.col("i")) % F.col("blocks")).alias("b"), _number("d", str(seed), F.col("full"), F.col("i")).alias("dk")
    placed = narrow.join(plans.where("rest > 0"), "s").select("s", "full", "rest", "n", "i", block, doc_key)
    by_block = placed.groupBy("s", "full", "rest", "b").agg(F.sum("n").alias("n")).withColumn("bk", _number(str(seed), F.col("s"), F.col("full"), F.col("b")))
    running = Window.partitionBy("s").orderBy("bk", "b").rowsBetween(Window.unboundedPreceding, 0)
    # the block in which the last pass ends
    edge = by_block.withColumn("upto", F.sum("n").over(running)).where("upto > rest").groupBy("s").agg(F.min(F.struct("bk", "b", (F.col("upto") - F.col("n")).alias("before"))).alias("e")).select("s", "e.*")
    edge_docs = placed.join(edge.withColumnRenamed("b", "eb"), "s").where("b = eb").groupBy("s", "rest", "before", "dk").agg(F.sum("n").alias("n"))
    inside = edge_docs.withColumn("upto", F.col("before") + F.sum("n").over(Window.partitionBy("s").orderBy("dk").rowsBetween(Window.unboundedPreceding, 0)))
    last = inside.where("upto <= rest").groupBy("s").agg(F.max("dk").alias("edk"))
    ends = {r["s"]: (r["bk"], r["b"], r["edk"]) for r in edge.join(last, "s", "left").collect()}
    final = spark.createDataFrame([(s, blocks, full, rest, *ends.get(s, (None, None, None))) for s, blocks, full, rest in plan], "s string, blocks long, full long, rest long, ebk long, eb long, edk long")

    marks = {c: X.fresh(docs, f"mix_{c}_") for c in ("s", "blocks", "full", "rest", "ebk", "eb", "edk")}
    final = small(final.toDF(*marks.values()))
    c = {k: F.col(v) for k, v in marks.items()}
    own_block, own_key = _number(str(seed), ident) % c["blocks"], _number("d", str(seed), c["full"], ident)
    own_bk = _number(str(seed), c["s"], c["full"], own_block)
    partial = (c["rest"] > 0) & (
        c["ebk"].isNull() | (own_bk < c["ebk"]) | ((own_bk == c["ebk"]) & (own_block < c["eb"])) | ((own_block == c["eb"]) & F.coalesce(own_key <= c["edk"], F.lit(False)))
    )
    passes = c["full"] + F.when(partial, 1).otherwise(0)
    joined = docs.join(final, src == c["s"]).withColumn(names[0], F.explode(F.filter(F.sequence(F.lit(0).cast("long"), passes), lambda k: k < passes)))
    return joined.select(*docs.columns, F.col(names[0]).cast(T.LongType()).alias(names[0]), _number(str(seed), c["s"], F.col(names[0]), own_block).alias(names[1]), _number("d", str(seed), F.col(names[0]), ident).alias(names[2]))
