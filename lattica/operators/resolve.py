"""Symbol resolution: imports by path suffix, definitions by tiers, call targets, heritage.

Each rule is a join that yields candidates with a rank; for every reference the first rank with
any candidate decides, and only when it has exactly one. Ambiguity never falls through to a later,
weaker rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import SYMBOLS
from .traverse import closure

#: What a path without its extension may end in, in order of preference.
_ENDINGS = "tsx ts jsx js /index.tsx /index.ts /index.jsx /index.js py /__init__.py java kt kts c h cpp hpp cc cxx hxx hh cs go rs /mod.rs php swift"
EXTENSIONS = ("", *(e if e[0] == "/" else "." + e for e in _ENDINGS.split()))
TIERS = {"same-file": (1, 0.95), "named-binding": (2, 0.9), "import-resolved": (3, 0.9), "package": (4, 0.9), "unique-global": (5, 0.5)}
CALLABLE = ("Constructor", "Function", "Macro", "Method")


def path_suffixes(files: DataFrame) -> DataFrame:
    """(suffix, path): every way to name a file by its last components."""
    parts = F.split("path", "/")
    return files.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))).alias("suffix"))


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(file_path, import_path, target): each import's file, by suffix and then by suffix without case.

    Relative paths are taken from the importer's folder and match whole paths only; dots separate
    components in other paths without a slash. Candidates go by extension order, exact case first,
    shorter and then smaller paths first. A file never imports itself.
    """
    name = F.col("import_path")
    folder = F.regexp_replace("file_path", r"[^/]*$", "")
    steps = F.split(F.concat(folder, name), "/")
    rel = F.aggregate(steps, F.array().cast("array<string>"), lambda acc, x: F.when(x == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).when((x == ".") | (x == ""), acc).otherwise(F.concat(acc, F.array(x))))
    relative = name.startswith("./") | name.startswith("../")
    wanted = F.when(relative, F.array_join(rel, "/")).when(name.contains("/"), F.regexp_replace(name, "^/+", "")).otherwise(F.replace(name, F.lit("."), F.lit("/")))
    ext = F.posexplode(F.array(*[F.lit(e) for e in EXTENSIONS])).alias("p", "e")
    c = imports.select("file_path", "import_path", relative.alias("relative"), wanted.alias("w")).distinct().select("*", ext).select("*", F.concat("w", "e").alias("c"))
    s = path_suffixes(files)
    whole = F.col("path") == F.col("suffix")
    exact = c.join(s, c["c"] == s["suffix"]).where(~F.col("relative") | whole).withColumn("loose", F.lit(0))
    folded = c.join(s.withColumn("suffix", F.lower("suffix")), F.lower(c["c"]) == F.col("suffix")).where(~F.col("relative") | (F.lower("path") == F.col("suffix"))).withColumn("loose", F.lit(1))
    both = exact.unionByName(folded).where("path <> file_path")
    return both.groupBy("file_path", "import_path").agg(F.min(F.struct("loose", "p", F.length("path").alias("n"), "path")).alias("m")).select("file_path", "import_path", F.col("m.path").alias("target"))


def tier_candidates(refs: DataFrame, definitions: DataFrame, imports: DataFrame, bindings: DataFrame | None = None, packages: DataFrame | None = None) -> DataFrame:
    """(ref_id, node_id, tier, rank): definitions that each (ref_id, file_path, name) may mean.

    ``imports`` has (file_path, target), ``bindings`` (file_path, local_name, target, exported_name),
    ``packages`` (file_path, package).
    """
    d = definitions.select(F.col("file_path").alias("df"), F.col("name").alias("dn"), "node_id", "type")
    r = refs.select("ref_id", "file_path", "name")

    def tier(df: DataFrame, kind: str) -> DataFrame:
        return df.select("ref_id", "node_id", F.lit(kind).alias("tier"), F.lit(TIERS[kind][0]).alias("rank"))

    out = tier(r.join(d, (r["file_path"] == F.col("df")) & (r["name"] == F.col("dn"))), "same-file")
    if bindings is not None:
        b = bindings.select(F.col("file_path").alias("bf"), F.col("local_name").alias("bl"), F.col("target").alias("bt"), F.col("exported_name").alias("be"))
        out = out.unionByName(tier(r.join(b, (r["file_path"] == F.col("bf")) & (r["name"] == F.col("bl"))).join(d, (F.col("bt") == F.col("df")) & (F.col("be") == F.col("dn"))), "named-binding"))
    i = imports.select(F.col("file_path").alias("imf"), F.col("target").alias("imt")).distinct()
    # the name goes first: a file imports many files, few of which define the name
    named = r.join(d, r["name"] == F.col("dn"))
    out = out.unionByName(tier(named.join(i, (F.col("file_path") == F.col("imf")) & (F.col("df") == F.col("imt"))), "import-resolved"))
    if packages is not None:
        p = packages.select("file_path", "package").distinct()
        a, b2 = p.select(F.col("file_path").alias("pf"), "package"), p.select(F.col("file_path").alias("qf"), F.col("package").alias("q"))
        out = out.unionByName(tier(named.join(a, F.col("file_path") == F.col("pf")).join(b2, (F.col("df") == F.col("qf")) & (F.col("package") == F.col("q"))).where("file_path <> df"), "package"))
    return out.unionByName(tier(named, "unique-global"))


def decide(candidates: DataFrame, key: str = "ref_id") -> DataFrame:
    """(key, node_id, tier): the only candidate of the first rank that has any."""
    ranked = candidates.groupBy(key, "rank").agg(F.countDistinct("node_id").alias("n"), F.min("node_id").alias("node_id"), F.min("tier").alias("tier"))
    first = ranked.groupBy(key).agg(F.min(F.struct("rank", "n", "node_id", "tier")).alias("m"))
    return first.where("m.n = 1").select(key, F.col("m.node_id").alias("node_id"), F.col("m.tier").alias("tier"))


def resolve_symbols(refs: DataFrame, definitions: DataFrame, imports: DataFrame, bindings: DataFrame | None = None, packages: DataFrame | None = None) -> DataFrame:
    """(ref_id, node_id, tier, confidence).

    References of one file and name have one answer, so candidates are counted once for each
    (file, name), and definitions by name or by (file, name) before they meet any reference.
    """
    d = definitions.select(F.col("file_path").alias("df"), F.col("name").alias("dn"), "node_id")
    need = refs.select("file_path", "name").distinct()

    def tier(df: DataFrame, kind: str) -> DataFrame:
        n = df.groupBy("file_path", "name").agg(F.countDistinct("node_id").alias("n"), F.min("node_id").alias("node_id"))
        return n.select("file_path", "name", F.lit(TIERS[kind][0]).alias("rank"), "n", "node_id", F.lit(kind).alias("tier"))

    out = tier(need.join(d, (F.col("file_path") == F.col("df")) & (F.col("name") == F.col("dn"))), "same-file")
    if bindings is not None:
        b = bindings.select("file_path", F.col("local_name").alias("name"), F.col("target").alias("bt"), F.col("exported_name").alias("be"))
        out = out.unionByName(tier(need.join(b, ["file_path", "name"]).join(d, (F.col("bt") == F.col("df")) & (F.col("be") == F.col("dn"))), "named-binding"))
    i = imports.select("file_path", "target").distinct()
    out = out.unionByName(tier(need.join(i, "file_path").join(d, (F.col("target") == F.col("df")) & (F.col("name") == F.col("dn"))), "import-resolved"))
    if packages is not None:
        p = packages.select("file_path", "package").distinct()
        peers = p.join(p.select(F.col("file_path").alias("peer"), "package"), "package").where("peer <> file_path").select("file_path", "peer").distinct()
        out = out.unionByName(tier(need.join(peers, "file_path").join(d, (F.col("peer") == F.col("df")) & (F.col("name") == F.col("dn"))), "package"))
    everywhere = d.groupBy("dn").agg(F.countDistinct("node_id").alias("n"), F.min("node_id").alias("node_id"))
    kind = "unique-global"
    out = out.unionByName(need.join(everywhere, F.col("name") == F.col("dn")).select("file_path", "name", F.lit(TIERS[kind][0]).alias("rank"), "n", "node_id", F.lit(kind).alias("tier")))
    best = out.groupBy("file_path", "name").agg(F.min(F.struct("rank", "n", "node_id", "tier")).alias("m")).where("m.n = 1").select("file_path", "name", F.col("m.node_id").alias("node_id"), F.col("m.tier").alias("tier"))
    return refs.select("ref_id", "file_path", "name").join(best, ["file_path", "name"]).select("ref_id", "node_id", "tier", _confidence(F.col("tier")).alias("confidence"))


def _confidence(tier: Column) -> Column:
    out: Column = F.lit(None).cast("double")
    for kind, (_, c) in TIERS.items():
        out = F.when(tier == kind, c).otherwise(out)
    return out


def resolve_calls(calls: DataFrame, definitions: DataFrame, imports: DataFrame, parents: DataFrame | None = None, bindings: DataFrame | None = None, packages: DataFrame | None = None) -> DataFrame:
    """(call_id, node_id, reason, confidence): call targets.

    A typed receiver decides by its type alone: the method of that owner with fitting arity, else the
    owner's only method of the name that takes more arguments (the rest have defaults), else one of an
    assignable ancestor. An owner that the caller's file defines or imports (C and C++ files: also
    through what they include) comes before one that it can't see. Other calls go by tiers over callable definitions of fitting arity
    (unknown arities fit); a member call whose receiver has no type is never resolved by
    ``unique-global``. ``parents`` has (child, parent) owner ids.
    """
    d = definitions.where(F.col("type").isin(*CALLABLE))
    fits = F.col("parameter_count").isNull() | (F.col("arg_count") < 0) | (F.col("parameter_count") == F.col("arg_count"))
    typed, plain = calls.where(F.col("receiver_type").isNotNull()), calls.where(F.col("receiver_type").isNull())
    owners = definitions.where(F.col("type").isin(sorted(SYMBOLS - set(CALLABLE)))).select(F.col("name").alias("on"), F.col("node_id").alias("oid"), F.col("file_path").alias("of"))
    methods = d.select(F.col("owner_id").alias("mo"), F.col("name").alias("mn"), "node_id", "parameter_count")
    own = typed.join(owners, F.col("receiver_type") == F.col("on"))
    sees = imports.select("file_path", F.col("target").alias("of")).where("file_path <> of").distinct()
    if "language" in calls.columns and not typed.where(F.col("language").isin("c", "cpp")).isEmpty():
        far = closure(sees.select(F.col("file_path").alias("a"), F.col("of").alias("b"))).select(F.col("a").alias("file_path"), F.col("b").alias("of"))
        sees = sees.unionByName(far.join(calls.where(F.col("language").isin("c", "cpp")).select("file_path").distinct(), "file_path", "left_semi")).distinct()
    seen = own.join(sees, ["file_path", "of"], "left_semi").unionByName(own.where(F.col("file_path") == F.col("of")), allowMissingColumns=True)
    own = seen.unionByName(own.join(seen.select("call_id").distinct(), "call_id", "left_anti"))
    exact = own.join(methods, (F.col("oid") == F.col("mo")) & (F.col("call_name") == F.col("mn"))).where(fits).select("call_id", "node_id", F.lit("receiver-type-exact").alias("tier"), F.lit(1).alias("rank"))
    more = own.join(methods, (F.col("oid") == F.col("mo")) & (F.col("call_name") == F.col("mn"))).where(F.col("parameter_count") > F.col("arg_count")).where("arg_count >= 0")
    found = exact.unionByName(more.select("call_id", "node_id", F.lit("receiver-type-default-args").alias("tier"), F.lit(2).alias("rank")))
    if parents is not None:
        up = closure(parents.select(F.col("child").alias("a"), F.col("parent").alias("b")))
        above = own.join(up, F.col("oid") == F.col("a")).join(methods, (F.col("b") == F.col("mo")) & (F.col("call_name") == F.col("mn"))).where(fits)
        found = found.unionByName(above.select("call_id", "node_id", F.lit("receiver-type").alias("tier"), F.lit(3).alias("rank")))
    by_type = decide(found, "call_id").select("call_id", "node_id", F.col("tier").alias("reason"), F.when(F.col("tier") == "receiver-type-exact", 0.95).otherwise(0.9).alias("confidence"))
    refs = plain.select(F.col("call_id").alias("ref_id"), "file_path", F.col("call_name").alias("name"), "arg_count", "call_form")
    c = tier_candidates(refs, d, imports, bindings, packages).join(refs.select("ref_id", "arg_count", "call_form"), "ref_id").join(d.select("node_id", "parameter_count").distinct(), "node_id")
    c = c.where(fits).where(~((F.col("call_form") == "member") & (F.col("tier") == "unique-global")))
    by_tier = decide(c).select(F.col("ref_id").alias("call_id"), "node_id", F.col("tier").alias("reason"), _confidence(F.col("tier")).alias("confidence"))
    return by_type.unionByName(by_tier)


def resolve_heritage(heritage: DataFrame, definitions: DataFrame, imports: DataFrame) -> DataFrame:
    """(child_id, parent_id, type): EXTENDS or IMPLEMENTS edges whose two ends are known.

    The parent's kind decides (an interface or trait is implemented unless its child is one too);
    the declared type where the kinds say nothing.
    """
    own = definitions.select(F.col("file_path").alias("cf"), F.col("name").alias("cn"), F.col("node_id").alias("child_id"), F.col("type").alias("ct"))
    h = heritage.withColumn("ref_id", F.xxhash64("file_path", "child_name", "parent_name")).dropDuplicates(["ref_id"])
    parent = resolve_symbols(h.select("ref_id", "file_path", F.col("parent_name").alias("name")), definitions.where(F.col("type").isin(sorted(SYMBOLS - set(CALLABLE)))), imports)
    kinds = definitions.select("node_id", F.col("type").alias("pt")).distinct()
    full = h.join(own, (h["file_path"] == F.col("cf")) & (h["child_name"] == F.col("cn"))).join(parent, "ref_id").join(kinds, "node_id")
    contract = F.col("pt").isin("Interface", "Trait")
    kind = F.when(contract & ~F.col("ct").isin("Interface", "Trait"), "IMPLEMENTS").when(F.col("pt").isNotNull(), "EXTENDS").otherwise(F.upper("heritage_type"))
    return full.where("child_id <> node_id").select("child_id", F.col("node_id").alias("parent_id"), kind.alias("type")).distinct()


def failures(calls: DataFrame, resolved: DataFrame, definitions: DataFrame, top: int = 12) -> DataFrame:
    """(call_name, failed): the names that most often have no target."""
    return calls.join(resolved.select("call_id"), "call_id", "left_anti").groupBy("call_name").agg(F.count("*").alias("failed")).orderBy(F.desc("failed"), "call_name").limit(top)
