"""Column functions over names, paths, lines and file contents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STOP_WORDS = sorted(set("""
a an the this that its it self / is are was were be been being / have has had do does did / will would shall should can could may might /
to of in on at by for from with as / and or not no if / const fn func let new return type var
""".replace("/", " ").split()))

LANGUAGES = {
    "go": "go", "python": "py pyw", "java": "java", "javascript": "js jsx", "typescript": "ts tsx", "c": "c", "cpp": "cc cpp cxx h hpp hxx",
    "csharp": "cs", "rust": "rs", "php": "php", "swift": "swift", "kotlin": "kt kts",
}
DOC_EXT = "adoc asciidoc markdown md mdx rst txt".split()
CONFIG_EXT = "cfg conf env gql graphql ini json jsonc properties proto sql toml xml yaml yml".split()
CODE_EXT = (
    "bash sh zsh ps1 / cjs js jsx mjs ts tsx vue svelte / css less sass scss htm html / c cc cpp cxx h hpp hxx / cs fs fsx / dart erl hrl ex exs / go java kt kts scala / lua php pl py pyw r rs swift zig"
).replace("/", " ").split()
CONFIG_NAMES = "build cmakelists.txt dockerfile gemfile justfile makefile procfile rakefile workspace".split()
DOC_NAMES = "authors license maintainers notice readme".split()


def tokens(text: Column) -> Column:
    """Identifier tokens: split at what is no ASCII word character and before capitals; lower case, two characters or more, no stop words."""
    parts = F.regexp_extract_all(F.regexp_replace(text, "[^A-Za-z0-9_]", " "), F.lit("([A-Z][a-z0-9_]*|[a-z0-9_]+)"), F.lit(1))
    lower = F.transform(parts, lambda x: F.lower(x))
    return F.filter(lower, lambda x: (F.length(x) >= 2) & ~x.isin(STOP_WORDS))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """Lower-case extension without its dot; empty where there is none."""
    return F.lower(F.regexp_extract(base_name(path), r"\.([^.]*)$", 1))


def language(path: Column) -> Column:
    """Language by extension, null where none is supported."""
    ext = extension(path)
    out = F.lit(None).cast("string")
    for name, exts in LANGUAGES.items():
        out = F.when(ext.isin(exts.split()), name).otherwise(out)
    return out


def file_kind(path: Column, content: Column | None = None) -> Column:
    """``code``, ``config`` or ``docs``; null for binary content and for extensions without a kind."""
    name, ext = F.lower(base_name(path)), extension(path)
    kind = F.when(name.isin(CONFIG_NAMES), "config").when(name.isin(DOC_NAMES), "docs").when(ext.isin(DOC_EXT), "docs").when(ext.isin(CONFIG_EXT), "config").when(ext.isin(CODE_EXT), "code")
    return kind if content is None else F.when(~content.contains("\u0000"), kind)


def in_scope(kind: Column, scope: str) -> Column:
    return {"docs": kind == "docs", "all": kind.isNotNull(), "code": kind.isin("code", "config")}[scope]


def valid_identifier(name: Column) -> Column:
    return name.rlike(r"^[\p{L}_$][\p{L}\p{Nd}_$]*$")


def whole_identifier(name: str) -> str:
    """A Java regular expression for the name where no identifier character touches it."""
    return r"(^|[^A-Za-z0-9_$])\Q" + name + r"\E([^A-Za-z0-9_$]|$)"


def is_test_file(path: Column) -> Column:
    p = F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
    inside = r"\.(test|spec)\.|__(tests|mocks)__/|/(tests?|testing|testproject)/|/test_|uitests/|\.(tests?|integrationtests|unittests)/"
    return p.rlike(inside + r"|(_test\.(py|go)|tests?\.(swift|cs)|(test|spec)\.php)$")


def is_utility_file(path: Column) -> Column:
    p = F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
    return p.rlike(r"/(utils?|helpers?|common|shared|lib)/|/(utils|helpers)\.(ts|js)$|_(utils|helpers)\.py$")


def repository_id(name: Column) -> Column:
    return F.substring(F.sha2(F.trim(name), 256), 1, 32)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in double precision; 0 where lengths differ or a norm is 0."""

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda u, v: u.cast("double") * v.cast("double")), F.lit(0.0), lambda s, v: s + v)

    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / norm).otherwise(F.lit(0.0))


_ENTRY = r"^(?i:main|init|bootstrap|start|run|setup|configure)$|^(handle|on|process|execute|perform|dispatch|trigger|fire|emit)[A-Z]|(Handler|Controller)$"
_LANGUAGE_ENTRY = {
    "javascript": "^use[A-Z]", "typescript": "^use[A-Z]", "python": "(?i)^app$|^(get|post|put|delete|patch|api|view)_", "java": "^(do|create|build)[A-Z]|Service$",
}
_UTILITY = r"^(can|did|from|get|has|is|set|should|to|will)[A-Z]|^_|(Helper|Utils?)$|^(?i:(format|parse|validate|convert|transform|encode|decode|serialize|deserialize|clone|copy|deep|merge|extend|assign|filter|map|reduce|sort|find).*|log|debug|error|warn|info|utils?|helpers?)$"


def entry_name_factor(name: Column, lang: Column | None = None) -> Column:
    """0.3 for utility names, 1.5 for entry-point names (universal, and the language's own), else 1."""
    entry = name.rlike(_ENTRY)
    if lang is not None:
        for own, pattern in _LANGUAGE_ENTRY.items():
            entry = entry | ((lang == own) & name.rlike(pattern))
    return F.when(name.rlike(_UTILITY), 0.3).when(entry, 1.5).otherwise(1.0)


#: (path pattern on the lower-cased path with a leading slash, factor), the first that matches counts
FRAMEWORKS = (
    (r"^(?!.*/_)(?!.*/api/).*/pages/.*\.[tj]sx?$", 3.0), (r"/app/.*page\.[tj]sx?$", 3.0), (r"/pages/api/|/app/.*/api/.*route\.ts$", 3.0), (r"/app/.*layout\.tsx?$", 2.0),
    (r"/(routes|controllers|handlers)/.*\.[tj]s$", 2.5), (r"views\.py$", 3.0), (r"urls\.py$", 2.0), (r"/(routers|endpoints|routes)/.*\.py$", 2.5), (r"/api/(?!.*__init__\.py$).*\.py$", 2.0),
)


def framework_factor(path: Column) -> Column:
    p = F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
    p = F.when(p.startswith("/"), p).otherwise(F.concat(F.lit("/"), p))
    out = None
    for pattern, factor in FRAMEWORKS:
        out = F.when(p.rlike(pattern), factor) if out is None else out.when(p.rlike(pattern), factor)
    return out.otherwise(1.0)
