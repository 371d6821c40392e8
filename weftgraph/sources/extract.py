"""Imports, declarations and errors from source text, on Arrow batches of files.

Python is read by the standard library's own parser and is exact for files
without syntax errors; for the others, and for those too deep for the parser,
imports are read line by line. TypeScript and JavaScript are read by their
tokens (``script``), Go by patterns over text without comments. No text raises.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from weftgraph.operators.scoped import scope
from weftgraph.sources import script

IMPORTS = "path string, specifier string, line int"
ERRORS = "path string, severity string, message string, line int, col int"
DECLARATIONS = "path string, nth int, kind string, name string, qualified_name string, start_line int, start_col int, end_line int, end_col int"
DEEP = (MemoryError, RecursionError)  # the parser's stack is bounded


def python_tree(text: str) -> tuple[ast.Module | None, tuple | None]:
    """The tree, or the error (severity, message, line, column)."""
    try:
        return ast.parse(text), None
    except SyntaxError as e:
        return None, ("partial", e.msg, e.lineno or 1, e.offset or 1)
    except ValueError as e:
        return None, ("partial", str(e), 1, 1)
    except DEEP:
        return None, ("partial", "nested too deeply", 1, 1)


def python_imports(text: str) -> list[tuple[str, int]]:
    """(specifier, line): a.b for ``import a.b``, m.n for ``from m import n``, m for ``from m import *``, with leading dots."""
    tree, _ = python_tree(text)
    if tree is None:
        return python_imports_by_line(text)
    out = []
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            out += [(a.name, node.lineno) for a in node.names]
        elif isinstance(node, ast.ImportFrom):
            base = "." * node.level + (node.module or "")
            joint = "" if base.endswith(".") or not base else "."
            out += [(base if a.name == "*" else f"{base}{joint}{a.name}", node.lineno) for a in node.names]
    return sorted(out, key=lambda x: x[1])


PY_IMPORT = re.compile(r"^\s*import\s+([\w.]+(?:\s+as\s+\w+)?(?:\s*,\s*[\w.]+(?:\s+as\s+\w+)?)*)")
PY_FROM = re.compile(r"^\s*from\s+(\.*[\w.]*)\s+import\s+\(?([^()#]*)")


def python_imports_by_line(text: str) -> list[tuple[str, int]]:
    out = []
    for n, line in enumerate(text.split("\n"), 1):
        if m := PY_IMPORT.match(line):
            out += [(x.split()[0], n) for x in m[1].split(",")]
        elif m := PY_FROM.match(line):
            joint = "" if m[1].endswith(".") else "."
            names = [x.split()[0] for x in m[2].split(",") if x.split()]
            out += [(m[1] if x == "*" else f"{m[1]}{joint}{x}", n) for x in names]
    return out


def python_errors(text: str) -> list[tuple[str, str, int, int]]:
    error = python_tree(text)[1]
    return [error] if error else []


def python_declarations(text: str) -> list[tuple[str, str, str, int, int, int, int]]:
    """(kind, name, qualified name, start line and column, end line and column), both from 1, in source order."""
    tree, _ = python_tree(text)
    out, todo = [], [(tree, "", False)] if tree else []
    while todo:
        node, scope, in_class = todo.pop()
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                kind = "class" if isinstance(child, ast.ClassDef) else "function" if not in_class else "constructor" if child.name == "__init__" else "method"
                out.append((kind, child.name, scope + child.name, child.lineno, child.col_offset + 1, child.end_lineno, child.end_col_offset + 1))
                todo.append((child, f"{scope}{child.name}.", isinstance(child, ast.ClassDef)))
            else:
                todo.append((child, scope, in_class))
    return sorted(out, key=lambda x: (x[3], x[4]))


def script_imports(text: str, jsx: bool = False) -> list[tuple[str, int]]:
    """Static imports and re-exports, import = require, and import() and the module loader's require() of one literal."""
    return script.read(text, jsx)[0]


def script_declarations(text: str, jsx: bool = False) -> list[tuple[str, str, str, int, int, int, int]]:
    return script.read(text, jsx)[1]


def script_errors(text: str, jsx: bool = False) -> list[tuple[str, str, int, int]]:
    return [("fatal", *e) for e in script.read(text, jsx)[2]]


GO_BLOCK = re.compile(r"^import\s*\(([^)]*)\)|^import\s+(?:[\w.]+\s+)?[\"`]([^\"`]+)[\"`]", re.M)
GO_SPEC = re.compile(r"[\"`]([^\"`]+)[\"`]")
GO_DECLARATION = re.compile(r"^func\s+(?:\(\s*\w*\s*\*?\s*(\w+)[^)]*\)\s*)?(\w+)|^type\s+(\w+)(?:\[[^\]]*\])?\s+(struct|interface)?", re.M)


def line_numbers(text: str, places: list[int]) -> list[int]:
    """The lines, from 1, of ascending places."""
    out, line, at = [], 1, 0
    for p in places:
        line, at = line + text.count("\n", at, p), p
        out.append(line)
    return out


def go_imports(text: str) -> list[tuple[str, int]]:
    bare = re.sub(r"//[^\n]*|/\*.*?\*/", lambda m: re.sub(r"[^\n]", " ", m[0]), text, flags=re.S)
    found: dict[str, int] = {}
    for m in GO_BLOCK.finditer(bare):
        specs = [(s[1], m.start(1) + s.start()) for s in GO_SPEC.finditer(m[1])] if m[1] is not None else [(m[2], m.start(2))]
        for spec, at in specs:
            found.setdefault(spec, at)
    return list(zip(found, line_numbers(bare, list(found.values()))))


def go_declarations(text: str) -> list[tuple[str, str, str, int, int, int, int]]:
    out = []
    found = list(GO_DECLARATION.finditer(text))
    for m, line in zip(found, line_numbers(text, [m.start() for m in found])):
        if m[2]:
            kind, name, full = ("method", m[2], f"{m[1]}.{m[2]}") if m[1] else ("function", m[2], m[2])
        else:
            kind, name, full = {"struct": "class", "interface": "interface"}.get(m[4], "type"), m[3], m[3]
        out.append((kind, name, full, line, 1, line, m.end() - m.start() + 1))
    return out


READERS: dict[str, tuple[Callable, Callable]] = {"python": (python_imports, python_declarations), "go": (go_imports, go_declarations), "typescript": (script_imports, script_declarations)}


def extracted(contents: DataFrame, language: str) -> DataFrame:
    """(path, specifier, line) of contents(path, content)."""
    read = READERS[language][0]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(p, s, n) for p, c in zip(b["path"], b["content"]) for s, n in read(c or "")], columns=["path", "specifier", "line"])

    return contents.select("path", "content").mapInPandas(run, IMPORTS)


def declared(contents: DataFrame, language: str) -> DataFrame:
    read = READERS[language][1]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(p, i, *d) for p, c in zip(b["path"], b["content"]) for i, d in enumerate(read(c or ""))]
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in DECLARATIONS.split(", ")])

    return contents.select("path", "content").mapInPandas(run, DECLARATIONS)


def syntax_errors(contents: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(p, *e) for p, c in zip(b["path"], b["content"]) for e in python_errors(c or "")], columns=["path", "severity", "message", "line", "col"])

    return contents.select("path", "content").mapInPandas(run, ERRORS)


# --- a whole file at once -----------------------------------------------------------------------------------

EXTENSIONS = {"py": "python", "go": "go"} | dict.fromkeys(("ts", "tsx", "js", "jsx", "mjs", "cjs", "mts", "cts"), "typescript")
PARSED = (
    "path string, language string, line_count int, imports array<struct<specifier:string,line:int>>, "
    "declarations array<struct<nth:int,kind:string,name:string,qualified_name:string,start_line:int,start_col:int,end_line:int,end_col:int>>, "
    "errors array<struct<message:string,line:int,col:int,severity:string,reason:string>>"
)


def read_file(path: str, text: str) -> tuple[str | None, list, list, list]:
    """(language, imports, declarations, errors (message, line, column, severity)); language is null for other files."""
    extension = path.rpartition(".")[2].lower()
    language = EXTENSIONS.get(extension)
    if language == "python":
        errors = [(message, line, col, severity) for severity, message, line, col in python_errors(text)]
        return language, python_imports(text), python_declarations(text), errors
    if language == "typescript":
        imports, declarations, errors = script.read(text, extension in ("tsx", "jsx", "js"))
        return language, imports, declarations, [(*e, "fatal") for e in errors]
    if language == "go":
        return language, go_imports(text), go_declarations(text), []
    return None, [], [], []


def parsed(contents: DataFrame) -> DataFrame:
    """What contents(path, content) hold, a row for each source file, by one pass over every text.

    A null content is a file that couldn't be read: it has no lines and a fatal error of the reason unreadable. Files
    in no known language are left out. repo_id goes along if it is there.
    """
    keys = scope(contents)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for *key, path, text in b.itertuples(index=False, name=None):
                language, imports, declarations, errors = read_file(path or "", text or "")
                if language is None:
                    continue
                found = [(*e, "syntax") for e in errors] if text is not None else [("Unable to read file", None, None, "fatal", "unreadable")]
                lines = 0 if text is None else text.count("\n") + 1
                rows.append((*key, path, language, lines, imports, [(i, *d) for i, d in enumerate(declarations)], found))
            yield pd.DataFrame(rows, columns=[*keys, "path", "language", "line_count", "imports", "declarations", "errors"])

    kinds = "".join(f"{c} {contents.schema[c].dataType.simpleString()}, " for c in keys)
    return contents.select(*keys, "path", "content").mapInPandas(run, kinds + PARSED)
