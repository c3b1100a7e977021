"""Import rules of single languages, over tables of imports, files and project settings.

Each rule turns imports into candidates: what to look for, how, and in which order. One join a way
of looking finds files, and of each import the first candidate with any file decides. A rule for
whole packages keeps all files of its candidate, any other the shortest path, then the smallest.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .resolve import EXTENSIONS, path_suffixes

CANDIDATES = ("file_path", "import_path", "rank", "want", "how", "ext")
#: how: the file is this path; ends in this path; does so without case; lies in a folder ending so; lies in this folder or below it; has this name, the last path counts.
PATH, SUFFIX, FOLDED, FOLDER, TREE, LAST = "path", "suffix", "folded", "folder", "tree", "last"


def _candidates(imports: DataFrame, *options: tuple[Column, str, str]) -> DataFrame:
    """Options (want, how, ext) in their order; a null want is no candidate."""
    parts = [F.struct(F.lit(k).alias("rank"), want.alias("want"), F.lit(how).alias("how"), F.lit(ext).alias("ext")) for k, (want, how, ext) in enumerate(options)]
    return imports.select("file_path", "import_path", F.explode(F.array(*parts)).alias("c")).select("file_path", "import_path", "c.*").where("want is not null and want <> ''")


def find(candidates: DataFrame, files: DataFrame) -> DataFrame:
    """(file_path, import_path, target): the files of each import's first candidate that has any."""
    f = files.select("path").distinct()
    folder = F.regexp_replace("path", r"/?[^/]*$", "")
    parts = F.split(folder, "/")
    whole = lambda a, b: F.array_join(F.slice(parts, a, b), "/")
    suffix, size = path_suffixes(f), F.size(parts)
    inside = f.select("path", F.explode(F.transform(F.sequence(F.lit(1), size), lambda i: whole(i, size))).alias("key"))
    below = f.select("path", F.explode(F.transform(F.sequence(F.lit(1), size), lambda i: whole(F.lit(1), i))).alias("key"))
    ways = {
        PATH: f.withColumn("key", F.col("path")), SUFFIX: suffix.withColumnRenamed("suffix", "key"), FOLDED: suffix.select("path", F.lower("suffix").alias("key")),
        FOLDER: inside, TREE: below, LAST: f.select("path", F.regexp_extract("path", r"[^/]*$", 0).alias("key")),
    }
    hits = []
    for how, index in ways.items():
        own = candidates.where(F.col("how") == how)
        by = F.concat("want", F.lit("") if how in (FOLDER, TREE) else F.col("ext"))
        hit = own.withColumn("key", F.lower(by) if how == FOLDED else by).join(index, "key")
        hits.append(hit.where(F.col("path").endswith(F.col("ext"))) if how in (FOLDER, TREE) else hit)
    found = reduce(DataFrame.unionByName, hits).where("path <> file_path").select("file_path", "import_path", "rank", "how", "path")
    best = found.groupBy("file_path", "import_path").agg(F.min("rank").alias("rank"))
    first = found.join(best, ["file_path", "import_path", "rank"])
    many = first.where(F.col("how").isin(FOLDER, TREE)).select("file_path", "import_path", F.col("path").alias("target")).distinct()
    one = first.where(~F.col("how").isin(FOLDER, TREE)).groupBy("file_path", "import_path").agg(F.when(F.first("how") == LAST, F.max("path")).otherwise(F.min(F.struct(F.length("path").alias("n"), "path"))["path"]).alias("target"))
    return many.unionByName(one)


def jvm(imports: DataFrame, extensions=(".java",)) -> DataFrame:
    """``a.b.*`` is a folder's files; ``a.b.C`` a file; ``a.b.C.member`` (lower case or capitals) its class's; else the last file of the name."""
    raw = F.col("import_path")
    path = F.replace(raw, F.lit("."), F.lit("/"))
    star = raw.endswith(".*")
    package = F.when(star, F.replace(F.regexp_replace(raw, r"\.\*$", ""), F.lit("."), F.lit("/")))
    full = F.when(~star, path)
    parts = F.split(raw, r"\.")
    member = F.when(~star & (F.size(parts) >= 3) & F.element_at(parts, -1).rlike("^[a-z]|^[A-Z_]+$"), F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/"))
    name = F.when(~star, F.element_at(parts, -1))
    options = [(w, how, e) for w, hows in ((package, (FOLDER,)), (full, (SUFFIX, FOLDED)), (member, (SUFFIX, FOLDED)), (name, (LAST,))) for e in extensions for how in hows]
    return _candidates(imports, *options)


def go(imports: DataFrame, modules: DataFrame) -> DataFrame:
    """Packages of the repository's own modules (``modules``: module); tests don't count, packages below do."""
    own = imports.join(F.broadcast(modules.select("module")), F.col("import_path").startswith(F.col("module")))
    rel = F.regexp_replace(F.expr("substring(import_path, length(module) + 1)"), "^/", "")
    return _candidates(own.withColumn("rel", rel), (F.col("rel"), TREE, ".go"))


def go_sources(files: DataFrame) -> DataFrame:
    return files.where(~F.col("path").endswith("_test.go"))


def csharp(imports: DataFrame, projects: DataFrame) -> DataFrame:
    """A namespace under a project's root (``projects``: root_namespace, project_dir) is a file or a folder; else the file of the last name."""
    j = imports.join(F.broadcast(projects.select("root_namespace", "project_dir")), (F.col("import_path") == F.col("root_namespace")) | F.col("import_path").startswith(F.concat("root_namespace", F.lit("."))), "left")
    rel = F.replace(F.expr("substring(import_path, length(root_namespace) + 2)"), F.lit("."), F.lit("/"))
    j = j.withColumn("rel", rel)
    place = F.concat_ws("/", F.when(F.col("project_dir") != "", F.col("project_dir")), F.when(F.col("rel") != "", F.col("rel")))
    single = F.when(F.col("rel") != "", place)
    last = F.element_at(F.split("import_path", r"\."), -1)
    known = F.col("root_namespace").isNotNull()
    return _candidates(j, (single, SUFFIX, ".cs"), (single, FOLDED, ".cs"), (F.when(F.col("rel") != "", F.col("rel")), SUFFIX, ".cs"), (F.when(F.col("rel") != "", F.col("rel")), FOLDED, ".cs"), (F.when(known, place), FOLDER, ".cs"), (last, SUFFIX, ".cs"), (last, FOLDED, ".cs")).distinct()


def php(imports: DataFrame, psr4: DataFrame | None = None) -> DataFrame:
    """With PSR-4 prefixes (``psr4``: prefix, dir) only what they own; without any the path, then the class's file."""
    path = F.replace("import_path", F.lit("\\"), F.lit("/"))
    if psr4 is None:
        last = F.element_at(F.split("import_path", r"\\"), -1)
        return _candidates(imports, (path, PATH, ".php"), (path, SUFFIX, ".php"), (last, SUFFIX, ".php"), (last, FOLDED, ".php"))
    own = imports.join(F.broadcast(psr4.select("prefix", "dir")), F.col("import_path").startswith(F.col("prefix")))
    rel = F.regexp_replace(F.replace(F.expr("substring(import_path, length(prefix) + 1)"), F.lit("\\"), F.lit("/")), "^/+", "")
    own = own.withColumn("at", F.regexp_replace(F.concat("dir", F.lit("/"), rel), "/+", "/"))
    return _candidates(own, (F.col("at"), PATH, ".php"), (F.col("at"), SUFFIX, ".php"))


def rust(imports: DataFrame) -> DataFrame:
    """``crate::`` from the crate's source root, then from ``src``; ``self::`` and ``super::`` from the file's folder; a group counts as its module."""
    use = F.trim(F.regexp_replace(F.regexp_replace(F.trim("import_path"), r"::\{.*$", ""), ";$", ""))
    j = imports.withColumn("use", use)
    path = F.replace(F.regexp_replace("use", "^(crate|self|super)::", ""), F.lit("::"), F.lit("/"))
    folder = F.regexp_replace("file_path", r"/?[^/]*$", "")
    above = F.regexp_replace(folder, r"/?[^/]*$", "")
    root = F.when(F.col("file_path").startswith("src/"), F.lit("src")).when(F.col("file_path").contains("/src/"), F.regexp_replace("file_path", "^(.*/src)/.*$", "$1")).otherwise(F.lit("src"))
    under = lambda a: F.concat_ws("/", F.when(a != "", a), path)
    crate, own, up = (F.col("use").startswith(p) for p in ("crate::", "self::", "super::"))
    other = F.col("use").contains("::") & ~crate & ~own & ~up
    bases = [F.when(crate, under(root)), F.when(crate, under(F.lit("src"))), F.when(own, under(folder)), F.when(up, under(above)), F.when(crate | other, path)]
    parent = lambda b: F.when(b.contains("/"), F.regexp_replace(b, "/[^/]*$", ""))
    return _candidates(j, *[(w, PATH, e) for b in bases for w, e in ((b, ".rs"), (b, "/mod.rs"), (b, "/lib.rs"), (parent(b), ".rs"), (parent(b), "/mod.rs"))])


def aliases(imports: DataFrame, settings: DataFrame) -> DataFrame:
    """Path aliases of a project (``settings``: alias, target, base_url), rewritten and then found by any extension."""
    own = imports.join(F.broadcast(settings.select("alias", "target", "base_url")), F.col("import_path").startswith(F.col("alias")))
    at = F.concat_ws("/", F.when(F.coalesce("base_url", F.lit("")) != "", F.col("base_url")), F.concat("target", F.expr("substring(import_path, length(alias) + 1)")))
    own = own.withColumn("at", F.regexp_replace(F.regexp_replace(at, r"(^|/)\./", "$1"), "/+", "/"))
    return _candidates(own, *[(F.col("at"), PATH, e) for e in EXTENSIONS], *[(F.col("at"), SUFFIX, e) for e in EXTENSIONS])


def implicit_packages(files: DataFrame) -> DataFrame:
    """(file_path, package): files that see each other without imports; ``files`` has (path, language, content).

    Java packages, C# and PHP namespaces as declared (one unnamed package a language), and all Swift
    files below one ``Sources`` or ``Tests`` folder's target.
    """
    declared = {"java": r"(?m)^\s*package\s+([A-Za-z_][\w.]*)\s*;", "csharp": r"(?m)^\s*namespace\s+([A-Za-z_][\w.]*)\s*[;{]?", "php": r"(?m)^\s*namespace\s+([A-Za-z_][\w]*(?:\\[A-Za-z_][\w]*)*)\s*;"}
    name: Column = F.lit(None).cast("string")
    for language, pattern in declared.items():
        name = F.when(F.col("language") == language, F.regexp_extract(F.coalesce("content", F.lit("")), pattern, 1)).otherwise(name)
    target = F.regexp_extract("path", "^((?:.*?/)?(?:Sources|Tests)/[^/]+)/", 1)
    name = F.when(F.col("language") == "swift", F.when(target != "", target)).otherwise(name)
    return files.select(F.col("path").alias("file_path"), F.concat("language", F.lit(":"), name).alias("package")).where("package is not null")


def re_exports(bindings: DataFrame, depth: int = 5) -> DataFrame:
    """Bindings (file_path, local_name, target, exported_name) followed through files that pass a name on.

    Where the target itself binds the name from another file, that file is meant, up to ``depth``
    files on and never in a circle; that many steps is what a chain has by definition.
    """
    own = bindings.select("file_path", "local_name", "target", "exported_name", F.array("file_path").alias("via"))
    on = bindings.select(F.col("file_path").alias("target"), F.col("local_name").alias("exported_name"), F.col("target").alias("t2"), F.col("exported_name").alias("e2"))
    for _ in range(depth):
        moved = own.join(on, ["target", "exported_name"], "left")
        go_on = F.col("t2").isNotNull() & ~F.array_contains("via", F.col("t2")) & (F.col("t2") != F.col("target"))
        own = moved.select("file_path", "local_name", F.when(go_on, F.col("t2")).otherwise(F.col("target")).alias("target"), F.when(go_on, F.col("e2")).otherwise(F.col("exported_name")).alias("exported_name"), F.when(go_on, F.concat("via", F.array("target"))).otherwise(F.col("via")).alias("via"))
    return own.drop("via").distinct()
