"""Facts of Python sources: one pass of the interpreter's own parser over each file, in Arrow batches.

Everything after this is relational. facts(file_path, kind, name, line, col, end_line,
end_col, scope, parent, value, items, attrs): kinds are parse_error, module, function,
class, import, use, assign, call, string, block and example_error. A file that can't
be parsed gives one parse_error row and never fails the job.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loupe.session import ship
from loupe.sources.files import is_python

SCHEMA = "file_path string, kind string, name string, line int, col int, end_line int, end_col int, scope string, parent string, value string, items array<string>, attrs map<string,string>"
_LOOPS = (ast.For, ast.AsyncFor, ast.While)
_NESTS = (*_LOOPS, ast.If, ast.With, ast.AsyncWith, ast.Try)
_DEFS = (ast.FunctionDef, ast.AsyncFunctionDef)


def complexity(node: ast.AST) -> int:
    """One, and one for each branch, loop, handler and further operand of and/or below."""
    n = 1
    for x in ast.walk(node):
        if isinstance(x, (*_LOOPS, ast.If, ast.ExceptHandler)):
            n += 1
        elif isinstance(x, ast.BoolOp):
            n += len(x.values) - 1
    return n


def depth(node: ast.AST, at: int = 0) -> int:
    most, todo = at, [(node, at)]
    while todo:
        x, d = todo.pop()
        for c in ast.iter_child_nodes(x):
            e = d + isinstance(c, _NESTS)
            most = max(most, e)
            todo.append((c, e))
    return most


def _dotted(x: ast.AST) -> str:
    parts = []
    while isinstance(x, ast.Attribute):
        parts.append(x.attr)
        x = x.value
    parts.append(x.id if isinstance(x, ast.Name) else "")
    return ".".join(reversed(parts))


def _last(x: ast.AST) -> str:
    x = x.func if isinstance(x, ast.Call) else x
    return x.attr if isinstance(x, ast.Attribute) else x.id if isinstance(x, ast.Name) else ""


def _dynamic(x: ast.AST | None) -> bool:
    if isinstance(x, ast.Call):
        return _dotted(x.func) in ("input", "raw_input")
    return isinstance(x, (ast.BinOp, ast.JoinedStr, ast.FormattedValue))


def doc_style(text: str) -> str:
    if re.search(r"\b(Args|Arguments|Parameters):\s*\n", text):
        return "google"
    if re.search(r":param\s+\w+:|:return:", text):
        return "sphinx"
    return "numpy" if re.search(r"\n\s*Parameters\s*\n\s*-+", text) else "plain"


def parse_doc(text: str) -> tuple[str, dict[str, str], str, list[str]]:
    """Style, documented parameters with their types (empty if none is given), what is said of the return value, and doctest examples."""
    style, params, returns = doc_style(text), {}, ""
    if style == "google":
        block = re.search(r"\b(?:Args|Arguments|Parameters):[ \t]*\n(.*?)(?=\n\s*\n|\n[ \t]*[A-Z]\w+:[ \t]*\n|\Z)", text, re.S)
        for m in re.finditer(r"^[ \t]*\*{0,2}(\w+)[ \t]*(?:\(([^)]*)\))?[ \t]*:", block[1] if block else "", re.M):
            params.setdefault(m[1], (m[2] or "").split(",")[0].strip())
        if m := re.search(r"\bReturns?:[ \t]*\n?[ \t]*(\S.*)", text):
            returns = m[1].strip()
    elif style == "sphinx":
        for m in re.finditer(r":param\s+(?:(\w+)\s+)?(\w+):", text):
            params[m[2]] = m[1] or ""
        for m in re.finditer(r":type\s+(\w+):\s*(\S+)", text):
            params[m[1]] = m[2]
        if m := re.search(r":returns?:\s*(\S.*)", text):
            returns = m[1].strip()
    elif style == "numpy":
        if block := re.search(r"Parameters[ \t]*\n[ \t]*-+[ \t]*\n(.*?)(?=\n[ \t]*\w+[ \t]*\n[ \t]*-+|\Z)", text, re.S):
            for m in re.finditer(r"^[ \t]*(\w+)[ \t]*:[ \t]*(\S.*)?$", block[1], re.M):
                params[m[1]] = (m[2] or "").strip()
        if m := re.search(r"Returns[ \t]*\n[ \t]*-+[ \t]*\n[ \t]*(\S.*)", text):
            returns = m[1].strip()
    examples = [m.strip() for m in re.findall(r">>> (.+?)(?=>>>|\Z)", text, re.S)]
    return style, params, returns, examples


class _Facts:
    def __init__(self, path: str, source: str, min_lines: int):
        self.path, self.lines, self.min_lines, self.rows = path, source.split("\n"), min_lines, []
        self.scope: list[tuple[str, str]] = []
        self.flags: list[tuple[bool, bool]] = []

    def add(self, kind: str, node: ast.AST | None = None, name: str = "", value: str | None = None, items: list[str] | None = None, line: int | None = None, **attrs: object) -> None:
        at = self.scope[-1] if self.scope else ("module", "")
        if isinstance(node, ast.stmt | ast.Call):  # what findings show; of a definition only its first line
            attrs["context"] = self.lines[node.lineno - 1].rstrip()
            attrs["code"] = attrs["context"].strip() if isinstance(node, (*_DEFS, ast.ClassDef)) else ast.unparse(node)
        text = {k: str(v).lower() if isinstance(v, bool) else str(v) for k, v in attrs.items() if v is not None}
        self.rows.append((self.path, kind, name, line or getattr(node, "lineno", 1), getattr(node, "col_offset", 0), getattr(node, "end_lineno", 0) or 0, getattr(node, "end_col_offset", 0) or 0, at[0], at[1], value, items or [], text))

    def block(self, first: int, last: int, what: str) -> None:
        if last - first + 1 >= self.min_lines:
            self.rows.append((self.path, "block", what, first, 0, last, 0, "", "", "\n".join(self.lines[first - 1 : last]).rstrip(), [], {}))

    def body_block(self, body: list[ast.stmt], what: str) -> None:
        if body:
            self.block(body[0].lineno, max(getattr(x, "end_lineno", x.lineno) or x.lineno for x in body), what)

    def walk(self, node: ast.AST) -> None:
        for c in ast.iter_child_nodes(node):
            self.visit(c)

    def visit(self, x: ast.AST) -> None:
        if isinstance(x, _DEFS):
            self.function(x)
        elif isinstance(x, ast.ClassDef):
            self.class_(x)
        elif isinstance(x, ast.Import | ast.ImportFrom):
            self.import_(x)
        elif isinstance(x, ast.If):
            names = {_dotted(n) for n in ast.walk(x.test) if isinstance(n, ast.Name | ast.Attribute)}
            self.flags.append((True, "typing.TYPE_CHECKING" in names))
            self.body_block(x.body, "if")
            self.body_block(x.orelse, "else")
            self.walk(x)
            self.flags.pop()
        else:
            if isinstance(x, (*_LOOPS, ast.With, ast.AsyncWith, ast.Try)):
                self.body_block(x.body, type(x).__name__.lower())
                self.body_block(getattr(x, "orelse", []), "else")
            elif isinstance(x, ast.Call):
                self.call(x)
            elif isinstance(x, ast.Attribute):
                if isinstance(x.value, ast.Name):
                    self.add("use", x, x.value.id, "access")
                self.add("use", x, x.attr, "attribute")
            elif isinstance(x, ast.Name):
                if not isinstance(x.ctx, ast.Store):
                    self.add("use", x, x.id, "access", name_node=True)
            elif isinstance(x, ast.Assign | ast.AnnAssign):
                self.assign(x)
            elif isinstance(x, ast.Constant) and isinstance(x.value, str):
                self.add("string", x, value=x.value)
            self.walk(x)

    def function(self, x: ast.FunctionDef | ast.AsyncFunctionDef) -> None:
        doc = ast.get_docstring(x)
        style, params, returns, examples = parse_doc(doc) if doc else ("unknown", {}, "", [])
        names = [a.arg for a in x.args.args]
        decorators = [d for d in map(_last, x.decorator_list) if d]
        types = {f"type:{a.arg}": ast.unparse(a.annotation) for a in x.args.args if a.annotation}
        self.add(
            "function", x, x.name, doc, names, is_async=isinstance(x, ast.AsyncFunctionDef), is_method=bool(self.scope) and self.scope[-1][0] == "class",
            is_property="property" in decorators, decorators=",".join(decorators), returns=ast.unparse(x.returns) if x.returns else None, complexity=complexity(x), depth=depth(x),
            doc_style=style, doc_returns=returns, **types, **{f"doc:{k}": v for k, v in params.items()},
        )
        for e in examples:
            code = "\n".join(re.sub(r"^\s*\.\.\. ?", "", line) for i, line in enumerate(e.split("\n")) if not i or line.lstrip().startswith("..."))
            try:
                compile(code, "<example>", "exec", dont_inherit=True)
            except (SyntaxError, ValueError) as err:
                self.add("example_error", x, x.name, str(getattr(err, "msg", err)))
        self.block(x.lineno, x.end_lineno or x.lineno, "function")
        self.scope.append(("function", x.name))
        self.walk(x)
        self.scope.pop()

    def class_(self, x: ast.ClassDef) -> None:
        self.add("class", x, x.name, ast.get_docstring(x), decorators=",".join(filter(None, map(_last, x.decorator_list))))
        for b in x.bases:
            if isinstance(b, ast.Name):
                self.add("use", x, b.id, "inherit")
        self.block(x.lineno, x.end_lineno or x.lineno, "class")
        self.scope.append(("class", x.name))
        self.walk(x)
        self.scope.pop()

    def import_(self, x: ast.Import | ast.ImportFrom) -> None:
        flags = {"conditional": any(f[0] for f in self.flags), "type_checking": any(f[1] for f in self.flags)}
        if isinstance(x, ast.Import):
            for a in x.names:
                self.add("import", x, a.name, a.asname or a.name.split(".")[0], type="import", level=0, plain=a.name, **flags)
        else:
            kind = "relative" if x.level else "from"
            for i, a in enumerate(x.names):
                self.add("import", x, x.module or "", a.asname or a.name, type=kind, level=x.level, plain=a.name, first=i == 0, **flags)

    def call(self, x: ast.Call) -> None:
        name = _dotted(x.func)
        self.add("call", x, name, dynamic=_dynamic(x.args[0]) if x.args else False, shell=any(k.arg == "shell" and isinstance(k.value, ast.Constant) and k.value.value is True for k in x.keywords), verify=any(k.arg == "verify" and isinstance(k.value, ast.Constant) and k.value.value is False for k in x.keywords))
        if isinstance(x.func, ast.Name):
            self.add("use", x, x.func.id, "call")
        elif isinstance(x.func, ast.Attribute) and isinstance(x.func.value, ast.Name):
            self.add("use", x, x.func.value.id, "access")

    def assign(self, x: ast.Assign | ast.AnnAssign) -> None:
        targets = x.targets if isinstance(x, ast.Assign) else [x.target]
        for t in targets:
            if isinstance(t, ast.Name):
                names = [e.value for e in x.value.elts if isinstance(e, ast.Constant) and isinstance(e.value, str)] if t.id == "__all__" and isinstance(x.value, ast.List | ast.Tuple) else []
                self.add("assign", x, t.id, items=names, literal=isinstance(x.value, ast.Constant), plain=isinstance(x, ast.Assign))


def rows_of(path: str, source: str, min_lines: int = 6) -> list[tuple]:
    try:
        tree = ast.parse(source)
        f = _Facts(path, source, min_lines)
        f.add("module", None, "", ast.get_docstring(tree))
        f.walk(tree)
        return f.rows
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
        return [(path, "parse_error", type(e).__name__, getattr(e, "lineno", None) or 1, 0, 0, 0, "module", "", str(getattr(e, "msg", e)), [], {})]


def facts(files: DataFrame, min_lines: int = 6) -> DataFrame:
    """Facts of the Python files of files, spread by path so that a folder of large files doesn't stay in one task."""
    spark = files.sparkSession
    ship(spark)
    columns = [f.split()[0] for f in SCHEMA.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [r for p, c in zip(b["file_path"], b["content"], strict=True) for r in rows_of(p, c, min_lines)]
            out = pd.DataFrame(rows, columns=columns)
            out["attrs"] = [dict(a) for a in out["attrs"]]
            yield out

    src = files.where(is_python("file_path") & F.col("content").isNotNull()).select("file_path", "content")
    return src.repartition(F.col("file_path")).mapInPandas(run, SCHEMA)
