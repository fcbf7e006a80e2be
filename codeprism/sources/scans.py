"""Scans: source files, sample CSVs, event logs, unified diffs, functions of Python files."""

from __future__ import annotations

import ast
import re
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from ..functions.text import language_of
from . import brace
from .alike import alike
from .batches import parsed

# Directories whose files are no production sources.
SKIPPED = (".git", ".hg", ".svn", ".idea", ".opencode", "__pycache__", ".pytest_cache", ".mypy_cache", ".venv", "venv", "env", "node_modules", "test", "tests", "build", "build-refactoragent", "dist", "target", "cmake-build-debug", "cmake-build-release")


def source_files(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """path, language and content of the source files below root, without skipped directories."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    rel = F.regexp_replace("path", r"^.*?" + re.escape(root.rstrip("/").split(":")[-1]) + "/", "")
    files = raw.select(rel.alias("path"), F.decode("content", "UTF-8").alias("content")).withColumn("language", language_of(F.col("path")))
    parts = F.split("path", "/")
    skipped = F.arrays_overlap(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), F.array(*[F.lit(x) for x in SKIPPED]))
    return files.where(F.col("language").isNotNull() & ~skipped).select("path", "language", "content")


def samples(spark: SparkSession, path: str) -> DataFrame:
    """Labelled sample rows with numbers cast; embedded JSON and quotes are kept, a malformed file is an error."""
    raw = spark.read.options(header=True, multiLine=True, quote='"', escape='"', mode="FAILFAST").csv(path)
    kinds = {"sample_id": "int", "begin_line": "int", "end_line": "int", "metric_value": "double"}
    return raw.withColumns({c: F.col(c).cast(k) for c, k in kinds.items() if c in raw.columns})


def locations(rows: DataFrame, column: str = "location") -> DataFrame:
    """rows, once for each descriptor of their location: location_file, location_line, location_name, location_ok."""
    one = F.trim(F.col("_one"))
    out = rows.withColumn("_one", F.explode(F.split(F.col(column), r";|\s+<->\s+")))
    file = F.regexp_extract(one, r"^(.+?):(?:method=|class=|\d+$)", 1)
    line = F.coalesce(F.nullif(F.regexp_extract(one, r"\|line=(\d+)$", 1), F.lit("")), F.nullif(F.regexp_extract(one, r":(\d+)$", 1), F.lit("")))
    name = F.nullif(F.regexp_extract(one, r":(?:method|class)=(.*?)(?:\|line=\d+)?$", 1), F.lit(""))
    return out.withColumns({"location_file": F.nullif(file, F.lit("")), "location_line": line.cast("int"), "location_name": name, "location_ok": (file != "") & (line.isNotNull() | name.isNotNull())}).drop("_one")


def tool_events(lines: DataFrame) -> DataFrame:
    """Events of NDJSON lines (column value); malformed lines are dropped."""
    schema = "type string, seq long, ts string, part struct<tool:string, state:struct<status:string>>"
    return lines.select(F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("e")).where("e.type is not null").select("e.type", "e.seq", "e.ts", F.col("e.part.tool").alias("tool"), F.col("e.part.state.status").alias("status"))


def parse_patch(patch: str) -> Iterator[tuple]:
    """(file, hunk, kind, old_line, new_line, content) of each line of a unified diff's hunks; kind is ' ', '-' or '+'."""
    file, hunk, old, new, left_old, left_new = None, 0, 0, 0, 0, 0
    lines = re.split(r"\r?\n", patch)  # other separators stand within lines
    for line in lines[:-1] if lines[-1] == "" else lines:
        if left_old > 0 or left_new > 0:
            kind, content = line[:1] or " ", line[1:]
            if kind == "\\":
                continue
            if kind not in " -+":
                raise ValueError(f"malformed hunk line: {line[:80]!r}")
            yield file, hunk, kind, old if kind != "+" else None, new if kind != "-" else None, content
            old, left_old = (old + 1, left_old - 1) if kind != "+" else (old, left_old)
            new, left_new = (new + 1, left_new - 1) if kind != "-" else (new, left_new)
        elif line.startswith("+++ "):
            name = line[4:].split("\t")[0]
            file, hunk = (file if name == "/dev/null" else name.removeprefix("b/")), 0
        elif line.startswith("--- "):
            file = line[4:].split("\t")[0].removeprefix("a/")
        elif m := re.match(r"@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@", line):
            hunk += 1
            old, left_old, new, left_new = int(m[1]), int(m[2] or 1), int(m[3]), int(m[4] or 1)
    if left_old > 0 or left_new > 0:
        raise ValueError("the patch ends within a hunk")


@udtf(returnType="file string, hunk int, kind string, old_line int, new_line int, content string")
class DiffLines:
    """Lines of unified diffs: SELECT ... FROM patches, LATERAL diff_lines(patch)."""

    def eval(self, patch: str):
        yield from parse_patch(patch or "")


_SCOPES = (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef, ast.Lambda)
_CONTROL = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler)


#: Where statements, handlers and cases stand; no expression holds a statement, so walks for these leave expressions out.
_INSIDE = ("body", "handlers", "orelse", "finalbody", "cases")


def _within(node: ast.AST) -> Iterator[tuple[str, ast.AST]]:
    """(field, child) of the statements, handlers and cases directly within a node."""
    for name in _INSIDE:
        value = getattr(node, name, None)
        if value.__class__ is list:
            for child in value:
                yield name, child


def _every(node: ast.AST) -> Iterator[ast.AST]:
    """All nodes of a tree, in no order; contexts apart."""
    stack = [node]
    while stack:
        node = stack.pop()
        yield node
        for name in node._fields:
            if name == "ctx":
                continue
            value = getattr(node, name, None)
            if value.__class__ is list:
                stack += [x for x in value if isinstance(x, ast.AST)]
            elif isinstance(value, ast.AST):
                stack.append(value)


def _elifs(node: ast.If) -> int:
    """How many elif branches an if has."""
    n = 0
    while len(node.orelse) == 1 and isinstance(node.orelse[0], ast.If) and node.orelse[0].col_offset == node.col_offset:
        n, node = n + 1, node.orelse[0]
    return n


def _chained(node: ast.AST, name: str, child: ast.AST) -> bool:
    """Whether child is the elif of node."""
    return isinstance(node, ast.If) and name == "orelse" and isinstance(child, ast.If) and len(node.orelse) == 1 and child.col_offset == node.col_offset


def python_metrics(body: list[ast.stmt]) -> tuple[int, int, int, int]:
    """(nesting, complexity, switches, branches) of a body.

    Nesting counts if, for, while and except, each elif on its if's level; nested functions, classes and lambdas are not
    entered. Complexity sums 1 + depth of the same, over all of the body. Switches are if chains with an elif, and
    matches; branches is the largest fan-out of an if (its else counted) or a match.
    """
    deep = total = switches = branches = 0
    stack = [(n, 0, False, True) for n in body]
    while stack:
        node, depth, chained, own = stack.pop()
        inner = depth
        if isinstance(node, _CONTROL):
            level = depth - 1 if chained else depth
            total += 1 + level
            inner = level + 1
            deep = max(deep, inner) if own else deep
        if isinstance(node, ast.If) and not chained:
            n, last = _elifs(node), node
            while last.orelse and _chained(last, "orelse", last.orelse[0]):
                last = last.orelse[0]
            branches = max(branches, 1 + n + bool(last.orelse))
            switches += n > 0
        if isinstance(node, ast.Match):
            branches, switches = max(branches, len(node.cases)), switches + (len(node.cases) > 0)
        inside = own and not isinstance(node, _SCOPES)
        for name, child in _within(node):
            stack.append((child, inner, _chained(node, name, child), inside))
    return deep, total, switches, branches


def python_functions(content: str) -> Iterator[tuple]:
    """(name, begin_line, end_line, n_params, nesting, complexity, branches) of each function; nothing if it doesn't parse."""
    for f in code_functions(content, "python"):
        yield f[1], f[2], f[3], f[4], f[6], f[7], f[9]


def _python_owners(tree: ast.AST) -> Iterator[tuple[ast.AST, str]]:
    stack = [(tree, "")]
    while stack:
        node, owner = stack.pop()
        for _, child in _within(node):
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef)):
                yield child, owner
            name = f"{owner}.{child.name}".lstrip(".") if isinstance(child, ast.ClassDef) else owner
            stack.append((child, name))


def _parsed(content: str) -> ast.Module | None:
    try:
        return ast.parse(content)
    except (SyntaxError, ValueError, RecursionError):
        return None


FUNCTION_FIELDS = "owner string, name string, begin_line int, end_line int, n_params int, loc int, nesting int, complexity int, switches int, branches int, ncss int, params array<string>, signature string, body string, modifiers array<string>, annotations array<string>"


def code_functions(content: str, language: str) -> Iterator[tuple]:
    """FUNCTION_FIELDS of each function of a Python, C, C++ or Java source; nothing of Python that doesn't parse.

    loc: lines of the body with anything but comments; complexity: cognitive for Java, else the sum of 1 + depth;
    branches: of the largest dispatch in Python, else case and default labels; ncss: statements (0 for Python).
    """
    if language == "python":
        tree = _parsed(content)
        lines = re.split(r"\r\n|\r|\n", content)  # as the parser counts them
        for f, owner in _python_owners(tree) if tree else ():
            a = f.args
            params = [("*" if x is a.vararg else "**" if x is a.kwarg else "") + x.arg + (f": {ast.unparse(x.annotation)}" if x.annotation else "") for x in (*a.posonlyargs, *a.args, a.vararg, *a.kwonlyargs, a.kwarg) if x is not None]
            params = params[1:] if params and params[0].split(":")[0] in ("self", "cls") else params
            body = "\n".join(lines[f.body[0].lineno - 1 : f.end_lineno])
            loc = sum(1 for x in body.splitlines() if re.sub("#.*", "", x).strip())
            deep, total, switches, branches = python_metrics(f.body)
            signature = " ".join(" ".join(lines[f.lineno - 1 : max(f.body[0].lineno - 1, f.lineno)]).split())
            yield owner, f.name, f.lineno, f.end_lineno, len(params), loc, deep, total, switches, branches, 0, params, signature, body, [], [ast.unparse(d) for d in f.decorator_list]
        return
    for f in brace.scan(content, language)[0]:
        nodes = brace.parse_body(f.code, f.tokens)
        inner = f.body_text.strip()[1:-1]
        bare = re.sub(r"//[^\n]*", "", re.sub(r"(?s)/\*.*?\*/", "", inner))
        switches, _, _ = brace.switch_metrics(f.code)
        total = brace.cognitive(nodes, f.name) if language == "java" else brace.complexity(nodes, language)
        branches = len(re.findall(r"(?m)^\s*(?:case\b|default\s*:)", bare))
        yield f.owner, f.name, f.line, f.end_line, len(f.params), sum(1 for x in bare.splitlines() if x.strip()), brace.nesting(nodes, language), total, switches, branches, brace.ncss(nodes) + 1, f.params, f.signature, f.body_text, sorted(f.modifiers), f.annotations


def python_accesses(f: ast.AST) -> Iterator[tuple[str, str, int, bool, bool]]:
    """(receiver, member, line, written, called) of each attribute in a function's body; the receiver is the chain's root name.

    Simple aliases are folded: after `x = r` or `x = r.f`, x counts for r, until x is bound anew.
    """
    alias: dict[str, str] = {}

    def root(node: ast.AST) -> str:
        while isinstance(node, (ast.Attribute, ast.Subscript)):
            node = node.value
        return alias.get(node.id, node.id) if isinstance(node, ast.Name) else ""

    def pairs(target: ast.AST, value: ast.AST | None) -> Iterator[tuple[str, ast.AST | None]]:
        if isinstance(target, ast.Name):
            yield target.id, value
        elif isinstance(target, (ast.Tuple, ast.List)):
            same = isinstance(value, (ast.Tuple, ast.List)) and len(value.elts) == len(target.elts)
            for i, t in enumerate(target.elts):
                yield from pairs(t, value.elts[i] if same else None)
        elif isinstance(target, ast.Starred):
            yield from pairs(target.value, None)

    def bind(bound: list[tuple[str, ast.AST | None]]) -> None:
        new = [(name, root(value) if isinstance(value, (ast.Name, ast.Attribute)) else "") for name, value in bound]
        for name, to in new:
            alias.pop(name, None)
            if to and to != name:
                alias[name] = to

    def walk(node: ast.AST, called: bool = False) -> Iterator[tuple[str, str, int, bool, bool]]:
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef, ast.Lambda)):
            return
        if isinstance(node, ast.Attribute):
            r = root(node)
            if r:
                yield r, node.attr, node.lineno, isinstance(node.ctx, (ast.Store, ast.Del)), called
        if isinstance(node, (ast.Assign, ast.AnnAssign, ast.AugAssign)):
            if node.value is not None:
                yield from walk(node.value)
            targets = node.targets if isinstance(node, ast.Assign) else [node.target]
            for t in targets:
                yield from walk(t)
            bind([p for t in targets for p in pairs(t, None if isinstance(node, ast.AugAssign) else node.value)])
            return
        if isinstance(node, ast.NamedExpr):
            yield from walk(node.value)
            bind([(node.target.id, node.value)])
            return
        if isinstance(node, (ast.For, ast.AsyncFor)):
            yield from walk(node.iter)
            bind(list(pairs(node.target, None)))
        if isinstance(node, ast.Call):
            yield from walk(node.func, True)
            for x in (*node.args, *node.keywords):
                yield from walk(x)
            return
        for child in ast.iter_child_nodes(node):
            yield from walk(child)

    for s in f.body:
        yield from walk(s)


def _python_locals(f: ast.AST) -> Iterator[tuple[str, int]]:
    """(name, line) of each name bound in a function's body, nested scopes apart."""
    stack = list(f.body)[::-1]
    while stack:
        node = stack.pop()
        if isinstance(node, _SCOPES):
            continue
        if isinstance(node, ast.Name) and isinstance(node.ctx, ast.Store):
            yield node.id, node.lineno
        if isinstance(node, ast.ExceptHandler) and node.name:
            yield node.name, node.lineno
        stack.extend(reversed(list(ast.iter_child_nodes(node))))


def _c_name(param: str) -> str:
    names = re.findall(r"[A-Za-z_$][\w$]*", re.sub(r"=.*$", "", re.sub(r"\[[^\]]*\]", "", param)))
    return names[-1] if len(names) > 1 else ""


def code_identifiers(content: str, language: str) -> Iterator[tuple]:
    """(kind, name, line, owner, function) of methods, parameters and locals."""
    if language == "python":
        tree = _parsed(content)
        for f, owner in _python_owners(tree) if tree else ():
            yield "method", f.name, f.lineno, owner, f.name
            a = f.args
            for x in (*a.posonlyargs, *a.args, a.vararg, *a.kwonlyargs, a.kwarg):
                if x is not None and x.arg not in ("self", "cls"):
                    yield "param", x.arg, x.lineno, owner, f.name
            for name, line in _python_locals(f):
                yield "local", name, line, owner, f.name
        return
    for f in brace.scan(content, language)[0]:
        yield "method", f.name, f.line, f.owner, f.name
        for p in f.params:
            if _c_name(p):
                yield "param", _c_name(p), f.line, f.owner, f.name
        first = f.line + content.count("\n", f.begin, f.body[0])
        for name, line in brace.local_names(f.code, first):
            yield "local", name, line, f.owner, f.name


def code_accesses(content: str, language: str) -> Iterator[tuple]:
    """(owner, function, begin_line, receiver, member, line, written, called) of each member access in a function."""
    if language == "python":
        tree = _parsed(content)
        for f, owner in _python_owners(tree) if tree else ():
            for x in python_accesses(f):
                yield owner, f.name, f.lineno, *x
        return
    for f in brace.scan(content, language)[0]:
        first = f.line + content.count("\n", f.begin, f.body[0])
        for x in brace.accesses(f.code, first, f.tokens):
            yield f.owner, f.name, f.line, *x


def _python_fields(node: ast.ClassDef) -> set[str]:
    """Names bound in the class body, and those that its methods set on self or cls."""
    out = set()
    for s in node.body:
        targets = s.targets if isinstance(s, ast.Assign) else [s.target] if isinstance(s, ast.AnnAssign) else []
        out |= {x.id for t in targets for x in _every(t) if isinstance(x, ast.Name)}
        if isinstance(s, (ast.FunctionDef, ast.AsyncFunctionDef)):
            out |= {x.attr for x in _every(s) if isinstance(x, ast.Attribute) and isinstance(x.ctx, ast.Store) and isinstance(x.value, ast.Name) and x.value.id in ("self", "cls")}
    return out


CLASS_FIELDS = "kind string, name string, begin_line int, end_line int, nom int, nof int, wmc int, loc int, supers array<string>, interfaces array<string>"


def code_classes(content: str, language: str) -> Iterator[tuple]:
    """CLASS_FIELDS of each type: methods, fields, summed method complexity (1 at least each) and lines without comments.

    A C source is one module of its functions; C++ functions defined outside count for the class that owns them.
    """
    if language == "python":
        tree = _parsed(content)
        lines = re.split(r"\r\n|\r|\n", content)
        level = [tree] if tree else []
        for node in level:
            level += [child for _, child in _within(node)]
            if isinstance(node, ast.ClassDef):
                methods = [s for s in node.body if isinstance(s, (ast.FunctionDef, ast.AsyncFunctionDef))]
                wmc = sum(max(1, _python_controls(m)) for m in methods)
                loc = sum(1 for x in lines[node.lineno - 1 : node.end_lineno] if re.sub("#.*", "", x).strip())
                yield "class", node.name, node.lineno, node.end_lineno, len(methods), len(_python_fields(node)), wmc, loc, [ast.unparse(b) for b in node.bases], []
        return
    functions, types = brace.scan(content, language)
    weight = lambda f: max(1, brace.control_nodes(brace.parse_body(f.code, f.tokens)))
    if language == "c":
        loc = brace.non_comment_loc(content)
        yield "module", "", 1, content.count("\n") + 1, len(functions), 0, sum(map(weight, functions)), loc, [], []
        return
    for t in types:
        if t.kind in ("namespace", "anonymous"):
            continue
        own = [f for f in functions if f.owner == t.name or (language == "cpp" and f.owner and t.name.endswith(f".{f.owner}"))]
        text = content[t.at : t.end]
        yield t.kind, t.name, t.line, t.end_line, len(own), len(brace.field_names(text[text.find("{") :], language)), sum(map(weight, own)), brace.non_comment_loc(text), t.supers, t.interfaces


def _python_controls(f: ast.AST) -> int:
    n, stack = 0, list(f.body)
    while stack:
        node = stack.pop()
        if isinstance(node, _SCOPES):
            continue
        n += isinstance(node, _CONTROL)
        stack += [child for _, child in _within(node)]
    return n


@udtf(returnType="name string, begin_line int, end_line int, n_params int, nesting int, complexity int, branches int")
class PythonFunctions:
    def eval(self, content: str):
        yield from python_functions(content or "")


@udtf(returnType=FUNCTION_FIELDS)
class CodeFunctions:
    def eval(self, content: str, language: str):
        yield from code_functions(content or "", language or "")


@udtf(returnType="kind string, name string, line int, owner string, function string")
class CodeIdentifiers:
    def eval(self, content: str, language: str):
        yield from code_identifiers(content or "", language or "")


@udtf(returnType="owner string, function string, begin_line int, receiver string, member string, line int, written boolean, called boolean")
class CodeAccesses:
    def eval(self, content: str, language: str):
        yield from code_accesses(content or "", language or "")


@udtf(returnType=CLASS_FIELDS)
class CodeClasses:
    def eval(self, content: str, language: str):
        yield from code_classes(content or "", language or "")


def register(spark: SparkSession) -> None:
    """Make the table functions known to SQL."""
    for name, kind in (("diff_lines", DiffLines), ("python_functions", PythonFunctions), ("code_functions", CodeFunctions), ("code_identifiers", CodeIdentifiers), ("code_accesses", CodeAccesses), ("code_classes", CodeClasses)):
        spark.udtf.register(name, kind)


def functions(spark: SparkSession, files: DataFrame) -> DataFrame:
    """Functions of Python files, one table function call for each file."""
    register(spark)
    return spark.sql("SELECT f.path, p.* FROM {files} f, LATERAL python_functions(f.content) p WHERE f.language = 'python'", files=files)


IDENTIFIER_FIELDS = "kind string, name string, line int, owner string, function string"
ACCESS_FIELDS = "owner string, function string, begin_line int, receiver string, member string, line int, written boolean, called boolean"
_SCANS = {"functions": (code_functions, FUNCTION_FIELDS), "identifiers": (code_identifiers, IDENTIFIER_FIELDS), "accesses": (code_accesses, ACCESS_FIELDS), "classes": (code_classes, CLASS_FIELDS)}


@lru_cache
def _scan(what: str, columns: tuple[str, ...]) -> Callable[[str, str], Iterator[tuple]]:
    """The rows of a scan, only the given columns of them, one scan for texts that are alike."""
    scan, fields = _SCANS[what]
    names = [f.split()[0] for f in fields.split(", ")]
    places = [names.index(c) for c in columns]
    only = lambda content, language: ([r[k] for k in places] for r in scan(content, language))
    return alike(only, lambda content, language: language != "python" or _parsed(content) is not None)


def scan_code(spark: SparkSession, files: DataFrame, what: str = "functions", apart: bool = False, columns: Sequence[str] | None = None) -> DataFrame:
    """functions, identifiers, accesses or classes of files (path, language, content): path, language and the columns of that scan, or those of them that are asked for.

    Files go to a few tasks for each core (they stay where they are if they lie `apart` already), and each is parsed
    whole, in Arrow batches; those that are alike but for the numbers in their names once. Null content counts as empty,
    other languages give nothing.
    """
    if what not in _SCANS:
        raise ValueError(f"unknown scan: {what}")
    fields = {f.split()[0]: f for f in ("path string", "language string", *_SCANS[what][1].split(", "))}
    columns = list(fields) if columns is None else list(columns)
    own = tuple(c for c in columns if c not in ("path", "language"))
    ahead = [c for c in columns if c in ("path", "language")]

    def rows(path: str, language: str | None, content: str | None) -> Iterator[tuple]:
        known = [path if c == "path" else language for c in ahead]
        for r in _scan(what, own)(content or "", language or ""):
            yield *known, *r

    known = files.where(F.col("language").isin("python", "java", "c", "cpp"))
    return parsed(known, ["path", "language", "content"], rows, ", ".join(fields[c] for c in (*ahead, *own)), apart).select(*columns)


def name_status(payload: Column) -> Column:
    """Changed paths of NUL-parted status records: status and paths; renames and copies have two. A truncated record is null."""
    start = F.struct(F.array().cast("array<struct<status:string,paths:array<string>>>").alias("done"), F.lit("").alias("status"), F.lit(0).alias("left"), F.array().cast("array<string>").alias("paths"), F.lit(True).alias("ok"))
    none = F.array().cast("array<string>")

    def step(s: Column, x: Column) -> Column:
        fresh = s["left"] == 0
        skip = fresh & (x == "")
        need = F.when(F.substring(x, 1, 1).isin("R", "C"), 2).otherwise(1)
        paths = F.concat(s["paths"], F.array(x))
        full = ~fresh & (s["left"] == 1)
        return F.struct(
            F.when(full, F.concat(s["done"], F.array(F.struct(s["status"].alias("status"), paths.alias("paths"))))).otherwise(s["done"]).alias("done"),
            F.when(fresh & ~skip, x).otherwise(s["status"]).alias("status"),
            F.when(skip, 0).when(fresh, need).otherwise(s["left"] - 1).alias("left"),
            F.when(fresh | full, none).otherwise(paths).alias("paths"),
            (s["ok"] & (fresh | (x != ""))).alias("ok"),
        )

    return F.aggregate(F.split(payload, "\0", -1), start, step, lambda s: F.when(s["ok"] & (s["left"] == 0), s["done"]))


def test_root(path: Column) -> Column:
    """The conventional test root of a path: src and a test source set, or a folder named for tests outside of main sources; else null."""
    # fixed values: source sets and folder names
    sets, legacy = ("test", "tests", "testfixtures", "integrationtest", "integration-test", "functionaltest", "it"), ("test", "tests")
    parts = F.split(F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), "^/+|/+$", ""), "/+")
    low = F.transform(parts, F.lower)
    n = F.size(parts)
    places = F.sequence(F.lit(0), F.greatest(n - 2, F.lit(0)))
    pair = F.get(F.filter(places, lambda i: (i < n - 1) & (F.get(low, i) == "src") & F.get(low, i + 1).isin(*sets)), 0)
    main = lambda i: F.array_contains(F.slice(low, 1, i), "src") & F.arrays_overlap(F.slice(low, 1, i), F.array(F.lit("main"), F.lit("production")))
    old = F.get(F.filter(places, lambda i: (i < n - 1) & F.get(low, i).isin(*legacy) & ~main(i)), 0)
    head = lambda k: F.array_join(F.slice(parts, 1, k), "/")
    return F.when(pair.isNotNull(), head(pair + 2)).when(old.isNotNull(), head(old + 1))


def revisions(spark: SparkSession, path: str) -> DataFrame:
    """project, project_commit, tree_hash and problem of a manifest {"projects": {name: {...}}} (or the flat map); one JSON document a file."""
    entry = "struct<project_commit:string,tree_hash:string>"
    text = spark.read.text(path, wholetext=True).select("value")
    nested = F.from_json("value", f"projects map<string,{entry}>")["projects"]
    rows = text.select(F.explode(F.coalesce(nested, F.from_json("value", f"map<string,{entry}>"))).alias("project", "e"))
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    problem = F.when(blank("e.project_commit"), "PROJECT_COMMIT_MISSING").when(blank("e.tree_hash"), "TREE_HASH_MISSING")
    return rows.select("project", F.trim("e.project_commit").alias("project_commit"), F.trim("e.tree_hash").alias("tree_hash"), problem.alias("problem"))


def resolve_revisions(samples: DataFrame, known: DataFrame) -> DataFrame:
    """samples (project, ...) with their revision, and problem where the manifest has none: a value, not a lost row."""
    out = samples.join(known, "project", "left")
    return out.withColumn("problem", F.coalesce("problem", F.when(F.col("project_commit").isNull(), "PROJECT_REVISION_NOT_FOUND")))


def resolve_settings(rows: DataFrame, layers: Sequence[DataFrame], on: str, names: Sequence[str]) -> DataFrame:
    """rows with each setting by precedence: the row's own value, then the layers' in order; blank values don't count.

    layers: tables of settings by `on`, as the command line, dataset, project and language give them; a row each.
    """
    out = rows
    for i, layer in enumerate(layers):
        cols = [F.nullif(F.trim(F.col(n)), F.lit("")).alias(f"_{i}_{n}") for n in names if n in layer.columns]
        out = out.join(layer.select(on, *cols), on, "left")
    for n in names:
        own = [F.nullif(F.trim(F.col(n)), F.lit(""))] if n in rows.columns else []
        out = out.withColumn(n, F.coalesce(*own, *[F.col(f"_{i}_{n}") for i, layer in enumerate(layers) if n in layer.columns], F.lit(None).cast("string")))
    return out.drop(*[f"_{i}_{n}" for i, layer in enumerate(layers) for n in names])


def junit_counts(content: str) -> Iterator[tuple]:
    """(tests, failures, errors, skipped, disabled) of a JUnit report: the root's attribute or the suites' sum, and at least what stands in it; nothing if it doesn't parse."""
    try:
        root = ElementTree.fromstring(content)
    except ElementTree.ParseError:
        return

    def whole(value: str | None) -> int | None:
        return int(value) if value is not None and re.fullmatch(r"\s*[+-]?\d+\s*", value) else None

    out = []
    for attribute, mark in (("tests", None), ("failures", "failure"), ("errors", "error"), ("skipped", "skipped"), ("disabled", "disabled")):
        there = len(root.findall(".//testcase" if mark is None else f".//testcase/{mark}"))
        own = whole(root.get(attribute))
        suites = [max(n, 0) for n in (whole(s.get(attribute)) for s in root.findall(".//testsuite")) if n is not None]
        out.append(max(own, there, 0) if own is not None else max(sum(suites), there))
    yield tuple(out)


@udtf(returnType="tests int, failures int, errors int, skipped int, disabled int")
class JunitCounts:
    def eval(self, content: str):
        yield from junit_counts(content or "")


def junit_reports(spark: SparkSession, reports: DataFrame) -> DataFrame:
    """reports (path, content, ...) with their counts, and executed: tests that ran, 0 of a report with failures; unreadable reports are left out."""
    spark.udtf.register("junit_counts", JunitCounts)
    out = spark.sql("SELECT r.*, j.* FROM {reports} r, LATERAL junit_counts(r.content) j", reports=reports)
    clean = (F.col("failures") == 0) & (F.col("errors") == 0)
    return out.withColumn("executed", F.when(clean, F.greatest(F.col("tests") - F.col("skipped") - F.col("disabled"), F.lit(0))).otherwise(0))
