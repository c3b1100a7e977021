"""Sources: repository files, git patches, parsed Python symbols, embeddings."""

import ast
import subprocess
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import extension, file_kind, language
from ..schema import InvalidRequest

MAX_BYTES = 512 * 1024
SKIP_DIRS = sorted(set("""
node_modules bower_components jspm_packages vendor venv env __pycache__ site-packages eggs lib64 parts sdist wheels dist build out output bin obj target _build
coverage htmlcov __tests__ __mocks__ logs log tmp temp cache generated auto-generated fixtures snapshots __snapshots__ bazel-bin bazel-out bazel-testlogs
""".split()))
SKIP_EXT = sorted(set("""
png jpg jpeg gif svg ico webp bmp tiff tif psd ai sketch fig xd / zip tar gz rar 7z bz2 xz tgz / exe dll so dylib a lib o obj class jar war ear pyc pyo pyd beam wasm node
pdf doc docx xls xlsx ppt pptx odt ods odp / mp4 mp3 wav mov avi mkv flv wmv ogg webm flac aac m4a / woff woff2 ttf eot otf / db sqlite sqlite3 mdb accdb / map lock
pem key crt cer p12 pfx / csv tsv parquet avro feather npy npz pkl pickle h5 hdf5 / bin dat data raw iso img dmg
""".replace("/", " ").split()))
SKIP_NAMES = sorted({
    *"package-lock.json yarn.lock pnpm-lock.yaml composer.lock Gopkg.lock go.sum Cargo.lock poetry.lock Gemfile.lock Thumbs.db".split(),
    *"LICENSE LICENSE.md LICENSE.txt CHANGELOG CHANGELOG.md CONTRIBUTING.md CODE_OF_CONDUCT.md SECURITY.md".split(),
})


def read_files(spark: SparkSession, root: str, filtered: bool = True) -> DataFrame:
    """(path, ext, language, kind, size, content) of the text files under a folder.

    With ``filtered``: no entry or folder that starts with a dot, none of the listed folders, names
    and extensions, no minified, bundled, generated or declaration files, none over 512 KiB.
    """
    base = root.rstrip("/") + "/"
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(base)
    path = F.regexp_replace(F.regexp_replace("path", "^file:/*", "/"), "^" + "".join("\\" + c if not c.isalnum() and c != "/" else c for c in base), "")
    f = f.select(path.alias("path"), F.col("length").alias("size"), "content")
    return keep_files(f) if filtered else _decoded(f)


def walk_filter(path="path", size="size"):
    """The condition under which a repository walk keeps a relative path of a size."""
    p = F.col(path)
    parts = F.split(p, "/")
    name = F.element_at(parts, -1)
    hidden = F.exists(parts, lambda x: x.startswith("."))
    folder = F.exists(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), lambda x: x.isin(SKIP_DIRS) | x.endswith("-csv"))
    made = name.rlike(r"\.(bundle|chunk|generated)\.|\.min\.(js|css)$|\.d\.ts$")
    return ~hidden & ~folder & ~made & ~name.isin(SKIP_NAMES) & ~extension(p).isin(SKIP_EXT) & (F.col(size) <= MAX_BYTES)


def keep_files(files: DataFrame) -> DataFrame:
    return _decoded(files.where(walk_filter()))


def _decoded(files: DataFrame) -> DataFrame:
    text = F.decode("content", "UTF-8") if dict(files.dtypes)["content"] == "binary" else F.col("content")
    d = files.where(F.is_valid_utf8("content")) if dict(files.dtypes)["content"] == "binary" else files
    d = d.select("path", "size", text.alias("content")).where(~F.col("content").contains("\u0000"))
    p = F.col("path")
    return d.select("path", extension(p).alias("ext"), language(p).alias("language"), file_kind(p).alias("kind"), "size", "content")


def git_patch(spark: SparkSession, repository: str, base: str = "HEAD", target: str = "") -> DataFrame:
    """(patch_id, patch): the diff of a checkout, renames found, without context lines, paths relative to it."""
    options = "--no-color --unified=0 --relative --find-renames".split()
    cmd = ["git", "-C", repository, "diff", *options, *filter(None, (base, target)), "--", "."]
    done = subprocess.run(cmd, capture_output=True, text=True, timeout=120)
    if done.returncode:
        raise InvalidRequest(done.stderr.strip())
    return spark.createDataFrame([(0, done.stdout)], "patch_id long, patch string")


# == structure
def structure(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """File and folder nodes, and CONTAINS edges along their paths; files at the root have no parent."""
    parts = F.split("path", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    chain = files.select("path", prefixes.alias("p")).select("path", F.posexplode("p").alias("i", "at"), F.size("p").alias("n"), "p")
    label = F.when(F.col("i") == F.col("n") - 1, "File").otherwise("Folder")
    ident = F.concat(label, F.lit(":"), F.col("at"))
    nodes = chain.select(ident.alias("id"), label.alias("label"), F.element_at(F.split("at", "/"), -1).alias("name"), F.col("at").alias("file_path")).distinct()
    edges = chain.where("i > 0").select(F.lit("CONTAINS").alias("type"), F.concat(F.lit("Folder:"), F.element_at("p", F.col("i"))).alias("source"), ident.alias("target")).distinct()
    return nodes, edges.select(F.concat_ws("|", "type", "source", "target").alias("id"), "type", "source", "target", F.lit(1.0).alias("confidence"))


# == parsing
FACTS = (
    "kind string, file_path string, node_id string, label string, name string, owner string, start_line int, end_line int, start_byte long, end_byte long, "
    "parameter_count int, return_type string, is_exported boolean, receiver string, arg_count int, form string, target string, ord long, receiver_type string"
)


def _type_name(node: ast.AST | None) -> str | None:
    """The class that an annotation names: ``A``, ``m.A``, ``"A"``, ``A | None`` and ``Optional[A]``."""
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.Attribute):
        return node.attr
    if isinstance(node, ast.Constant) and isinstance(node.value, str):
        try:
            return _type_name(ast.parse(node.value, mode="eval").body)
        except SyntaxError:
            return None
    if isinstance(node, ast.BinOp) and isinstance(node.op, ast.BitOr):
        sides = [x for x in (node.left, node.right) if not (isinstance(x, ast.Constant) and x.value is None)]
        return _type_name(sides[0]) if len(sides) == 1 else None
    if isinstance(node, ast.Subscript) and _type_name(node.value) == "Optional":
        return _type_name(node.slice)
    return None


def _made_by(node: ast.AST | None) -> str | None:
    """The class whose constructor an expression calls; classes start with a capital."""
    if isinstance(node, ast.Await):
        node = node.value
    name = _type_name(node.func) if isinstance(node, ast.Call) else None
    return name if name and name.lstrip("_")[:1].isupper() else None


def _types_in(body: ast.AST, into: dict[str, str]) -> dict[str, str]:
    """Variable -> class of the annotations and constructor assignments in a scope; a variable of two classes has none."""
    clashing = set()

    def note(target: ast.AST, kind: str | None) -> None:
        name = target.id if isinstance(target, ast.Name) else f"{target.value.id}.{target.attr}" if isinstance(target, ast.Attribute) and isinstance(target.value, ast.Name) else None
        if name and kind:
            if into.setdefault(name, kind) != kind:
                clashing.add(name)

    def walk(node: ast.AST) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, ast.Assign):
                for t in child.targets:
                    note(t, _made_by(child.value))
            elif isinstance(child, ast.AnnAssign):
                note(child.target, _type_name(child.annotation))
            elif isinstance(child, (ast.With, ast.AsyncWith)):
                for item in child.items:
                    if item.optional_vars is not None:
                        note(item.optional_vars, _made_by(item.context_expr))
            if not isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef, ast.Lambda)):
                walk(child)

    walk(body)
    for name in clashing:
        into.pop(name, None)
    return into



def parse_python(path: str, source: str) -> list[dict]:
    """Definitions, calls, imports and base classes of one Python file; a file that doesn't parse has none."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return []
    starts = [0]
    for line in source.splitlines(keepends=True):
        starts.append(starts[-1] + len(line.encode()))
    at = lambda line, col: starts[line - 1] + col
    out: list[dict] = []

    def add(kind: str, node: ast.AST, **fields) -> None:
        out.append({"kind": kind, "file_path": path, "start_line": node.lineno - 1, "end_line": node.end_lineno - 1, "start_byte": at(node.lineno, node.col_offset), "end_byte": at(node.end_lineno, node.end_col_offset), "ord": len(out), **fields})

    def scope_of(f, owner: str | None, outer: dict[str, str], of_class: dict[str, str]) -> dict[str, str]:
        """Types known inside a function: its own, those of its class's attributes, and those around it."""
        args = [*f.args.posonlyargs, *f.args.args, *f.args.kwonlyargs]
        own = {x.arg: k for x in args if (k := _type_name(x.annotation))}
        me = args[0].arg if owner and args and args[0].arg in ("self", "cls") else None
        if me:
            own[me] = owner.rsplit(".", 1)[-1]
        return {**outer, **({f"{me}.{k}": v for k, v in of_class.items()} if me else {}), **_types_in(f, own)}

    def attributes(c: ast.ClassDef) -> dict[str, str]:
        """Attribute -> class, from the class's body and from what its methods assign to ``self``."""
        own = _types_in(c, {})
        for m in c.body:
            if isinstance(m, (ast.FunctionDef, ast.AsyncFunctionDef)) and m.args.args:
                me = m.args.args[0].arg + "."
                params = {x.arg: k for x in m.args.args[1:] if (k := _type_name(x.annotation))}
                for name, kind in _types_in(m, {}).items():
                    if name.startswith(me):
                        own.setdefault(name[len(me) :], kind)
                for x in ast.walk(m):  # self.a = a, of an annotated parameter
                    if isinstance(x, ast.Assign) and isinstance(x.value, ast.Name) and x.value.id in params:
                        for t in x.targets:
                            if isinstance(t, ast.Attribute) and isinstance(t.value, ast.Name) and t.value.id + "." == me:
                                own.setdefault(t.attr, params[x.value.id])
        return own

    def visit(node: ast.AST, owner: str | None, types: dict[str, str], of_class: dict[str, str]) -> None:
        for child in ast.iter_child_nodes(node):
            inner, known, attrs = owner, types, of_class
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                is_class = isinstance(child, ast.ClassDef)
                label = "Class" if is_class else "Method" if owner else "Function"
                ident = f"{label}:{path}:{owner + '.' if owner else ''}{child.name}"
                args = None if is_class else [*child.args.posonlyargs, *child.args.args, *child.args.kwonlyargs]
                count = None if is_class or child.args.vararg or child.args.kwarg else len(args) - int(bool(owner and args and args[0].arg in ("self", "cls")))
                returns = None if is_class or child.returns is None else ast.unparse(child.returns)
                add("definition", child, node_id=ident, label=label, name=child.name, owner=f"Class:{path}:{owner}" if owner and not is_class else None, parameter_count=count, return_type=returns, is_exported=not child.name.startswith("_"))
                if is_class:
                    for b in child.bases:
                        if isinstance(b, (ast.Name, ast.Attribute)):
                            add("heritage", b, name=child.name, target=b.id if isinstance(b, ast.Name) else b.attr, form="extends")
                    inner, attrs = f"{owner}.{child.name}" if owner else child.name, attributes(child)
                else:
                    known = scope_of(child, owner, types, of_class)
                    inner, attrs = None, {}
            elif isinstance(child, ast.Import):
                for a in child.names:
                    add("import", child, target=a.name, name=a.asname or a.name)
            elif isinstance(child, ast.ImportFrom):
                base = ("./" if child.level == 1 else "../" * (child.level - 1) if child.level else "") + (child.module or "").replace(".", "/" if child.level else ".")
                for a in child.names:
                    add("import", child, target=base or a.name, name=a.asname or a.name, receiver=a.name)
            elif isinstance(child, ast.Call):
                f = child.func
                count = -1 if any(isinstance(x, ast.Starred) for x in child.args) or any(k.arg is None for k in child.keywords) else len(child.args) + len(child.keywords)
                if isinstance(f, ast.Name):
                    add("call", child, name=f.id, form="free", arg_count=count)
                elif isinstance(f, ast.Attribute):
                    v = f.value
                    name = v.id if isinstance(v, ast.Name) else f"{v.value.id}.{v.attr}" if isinstance(v, ast.Attribute) and isinstance(v.value, ast.Name) else None
                    add("call", child, name=f.attr, form="member", arg_count=count, receiver=name, receiver_type=types.get(name) if name else _made_by(v))
            visit(child, inner, known, attrs)

    visit(tree, None, _types_in(tree, {}), {})
    return out


def parse(files: DataFrame, languages=("python",)) -> DataFrame:
    """The facts of all files of the languages; only Python has a parser here, any other raises."""
    if set(languages) - {"python"}:
        raise InvalidRequest(f"no parser for {sorted(set(languages) - {'python'})}")

    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_()}
    schema = pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in FACTS.split(", ")])

    def run(batches):
        for b in batches:
            rows = [r for p, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for r in parse_python(p, c or "")]
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return files.where(F.col("language").isin(*languages)).select("path", "content").mapInArrow(run, FACTS)


# == embeddings
class Embedder(Protocol):
    """What users bring: texts in, vectors of a fixed dimension out."""

    dimensions: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class HashEmbedder:
    """A deterministic stand-in: FNV-1a hashes of the tokens of a text, counted by dimension and sign."""

    def __init__(self, dimensions: int = 64):
        self.dimensions = dimensions

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = [0.0] * self.dimensions
            for w in t.lower().split():
                h = 0xCBF29CE484222325
                for b in w.encode():
                    h = (h ^ b) * 0x100000001B3 % (1 << 64)
                v[h % self.dimensions] += 1.0 if h >> 63 else -1.0
            out.append(v)
        return out


class HTTPEmbedder:
    """POSTs batches of texts to a service that answers ``{"data": [{"index": i, "embedding": [...]}]}``."""

    def __init__(self, url: str, model: str, dimensions: int, key: str = "", batch: int = 8, attempts: int = 3, timeout: float = 30.0):
        self.url, self.model, self.dimensions, self.key, self.batch, self.attempts, self.timeout = url, model, dimensions, key, batch, attempts, timeout

    def _post(self, texts: list[str]) -> list[list[float]]:
        import json
        import time
        import urllib.error
        import urllib.request

        body = json.dumps({"model": self.model, "input": texts}).encode()
        for k in range(self.attempts):
            try:
                r = urllib.request.Request(self.url, body, {"Content-Type": "application/json", **({"Authorization": f"Bearer {self.key}"} if self.key else {})})
                with urllib.request.urlopen(r, timeout=self.timeout) as answer:
                    data = sorted(json.load(answer)["data"], key=lambda d: d["index"])
                return [d["embedding"] for d in data]
            except (urllib.error.URLError, TimeoutError):
                if k == self.attempts - 1:
                    raise
                time.sleep(2**k)
        return []

    def embed(self, texts: list[str]) -> list[list[float]]:
        return [v for i in range(0, len(texts), self.batch) for v in self._post(texts[i : i + self.batch])]


def embed(texts: DataFrame, embedder: Embedder, text_col: str = "text", max_bytes: int = 500) -> DataFrame:
    """``texts`` with ``embedding``; a text counts up to ``max_bytes`` bytes, as the model's input does."""
    from pyspark.sql import types as T

    schema = T.StructType([*texts.schema.fields, T.StructField("embedding", T.ArrayType(T.FloatType()))])

    def run(batches):
        for pdf in batches:
            clipped = [(t or "").encode()[:max_bytes].decode(errors="ignore") for t in pdf[text_col]]
            yield pdf.assign(embedding=embedder.embed(clipped) if clipped else [])

    return texts.mapInPandas(run, schema)
