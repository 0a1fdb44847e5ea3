"""Symbols of source files: a parser a language, run inside Arrow batches.

Python is parsed with its own grammar, and by lines where a file does not parse. Other
languages are cut into tokens and matched with the patterns of their tables (grammar.py); a language
without patterns gives its file node only. Calls belong to the innermost function around them,
found by one pass over calls and functions in the order of their places. A file that has
errors gives what can be read, and a warning.
"""

from __future__ import annotations

import ast
import hashlib
import json
import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.scalar import stable_id
from graphloom.operators.grammar import Language, Tokens, language
from graphloom.operators.graph import placeholders, upsert_edges, upsert_nodes

ROW = "kind string, seq int, id string, type string, name string, path string, lang string, properties string, source_id string, target_id string, relationship string, error string"
COLUMNS = [f.split()[0] for f in ROW.split(", ")]


def make_id(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()[:16]


class Symbols:
    """Collects the rows of one file in capture order."""

    def __init__(self, path: str, lang: str, source: str):
        self.path, self.lang, self.rows, self.ids = path, lang, [], set()
        self.file_id = make_id(path)
        self.node(self.file_id, "file", path.rsplit("/", 1)[-1], {"lines": source.count("\n") + 1})

    def node(self, nid: str, kind: str, name: str, props: dict) -> None:
        self.ids.add(nid)
        self.rows.append(dict(kind="node", id=nid, type=kind, name=name, path=self.path, lang=self.lang, properties=json.dumps(props)))

    def edge(self, source: str, target: str, relationship: str, props: dict | None = None) -> None:
        self.rows.append(dict(kind="edge", source_id=source, target_id=target, relationship=relationship, properties=json.dumps(props or {})))

    def define(self, kind: str, name: str, start: int, end: int, text: str) -> str:
        """A function or class; its id holds path, line, kind and the first 50 characters."""
        nid = make_id(f"{self.path}:{start}:{kind}:{text[:50]}")
        if nid not in self.ids:
            self.node(nid, kind, name, {"start_line": start, "end_line": end})
            self.edge(nid, self.file_id, "defined_in")
        return nid

    def imports(self, text: str, line: int) -> None:
        self.edge(self.file_id, make_id("import:" + text.strip()), "imports", {"import_line": line})

    def warn(self, text: str) -> None:
        """Says of the file node that the file was read in part."""
        self.rows[0]["error"] = text

    def call(self, caller: str, target: str, line: int) -> None:
        self.edge(caller, make_id("call:" + target), "calls", {"call_line": line})


def scan_python(source: str, out: Symbols) -> None:
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        out.warn("the file has parse errors")
        return scan_indented(source, out)

    lines = source.splitlines(keepends=True)

    def walk(node: ast.AST, caller: str | None) -> None:
        for child in ast.iter_child_nodes(node):
            inner = caller
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                kind = "class" if isinstance(child, ast.ClassDef) else "function"
                nid = out.define(kind, child.name, child.lineno, child.end_lineno or child.lineno, head_of(child, lines))
                inner = nid if kind == "function" else caller
            elif isinstance(child, ast.Import):
                for a in child.names:
                    if a.asname is None:
                        out.imports(ast.get_source_segment(source, child) or "", child.lineno)
                        break
            elif isinstance(child, ast.ImportFrom):
                if not child.level and any(a.name != "*" and a.asname is None for a in child.names):
                    out.imports(ast.get_source_segment(source, child) or "", child.lineno)
            elif isinstance(child, ast.Call) and caller:
                f = child.func
                name = f.id if isinstance(f, ast.Name) else f.attr if isinstance(f, ast.Attribute) else None
                if name:
                    out.call(caller, name, child.lineno)
            walk(child, inner)

    walk(tree, None)


def head_of(node: ast.stmt, lines: list[str], n: int = 50) -> str:
    """The first n characters of a definition; the tree's columns count bytes."""
    parts, size, last = [], 0, node.end_lineno or node.lineno
    for at in range(node.lineno, last + 1):
        raw = lines[at - 1].encode()
        text = raw[node.col_offset if at == node.lineno else 0 : node.end_col_offset if at == last else None].decode()
        parts.append(text)
        size += len(text)
        if size >= n:
            break
    return "".join(parts)[:n]


def scan_indented(source: str, out: Symbols) -> None:
    """Python that does not parse: definitions and imports by line, calls by indentation."""
    stack: list[tuple[int, str | None]] = []
    lines = source.split("\n")
    for n, line in enumerate(lines, 1):
        body = line.lstrip()
        if not body or body.startswith("#"):
            continue
        depth = len(line) - len(body)
        while stack and stack[-1][0] >= depth:
            stack.pop()
        if m := re.match(r"(async\s+def|def|class)\s+(\w+)", body):
            kind = "class" if m[1] == "class" else "function"
            end = n
            while end < len(lines) and (not lines[end].strip() or len(lines[end]) - len(lines[end].lstrip()) > depth):
                end += 1
            nid = out.define(kind, m[2], n, end, "\n".join([body, *lines[n : n + 2]]))
            stack.append((depth, nid if kind == "function" else (stack[-1][1] if stack else None)))
            body = body[m.end() :].partition(":")[2]
        elif re.match(r"import\s+[\w.]+\s*(,|$)|from\s+\w[\w.]*\s+import\s+\w", body):
            out.imports(body, n)
            continue
        caller = next((s for _, s in reversed(stack) if s), None)
        if caller:
            for m in re.finditer(r"(\w+)\s*\(", body):
                if m[1] not in {"if", "while", "for", "return", "def", "class", "and", "or", "not", "in", "print("}:
                    out.call(caller, m[1], n)


def innermost(places: Iterable[int], spans: list[tuple[int, int, str]]) -> Iterator[tuple[int, str | None]]:
    """Each place with the id of the innermost span (first, last, id) that holds it; places come in order.

    One pass with a stack of the spans that are open; spans nest, as blocks do.
    """
    ahead, opened, k = sorted(spans, key=lambda s: (s[0], -s[1])), [], 0
    for at in places:
        while k < len(ahead) and ahead[k][0] <= at:
            opened.append(ahead[k])
            k += 1
        while opened and opened[-1][1] < at:
            opened.pop()
        yield at, opened[-1][2] if opened else None


def scan_tokens(source: str, out: Symbols, table: Language) -> None:
    """Definitions, imports and calls of a language with a table."""
    tokens = Tokens(table, source)
    breaks = [0, *(m.end() for m in re.finditer("\n", source))]
    line = lambda at: bisect_right(breaks, at)
    ends = lambda i: tokens.start[i] + len(tokens.text[i])
    found: dict[str, list[tuple[int, tuple[str, int, int]]]] = {"class": [], "function": [], "import": []}
    patterns = [(kind, pattern.split()) for kind, pattern in table.symbols]
    for i, text in enumerate(tokens.text):
        for kind, atoms in patterns:
            if (atoms[0] == text or atoms[0] == "NAME") and (i == 0 or tokens.text[i - 1] not in table.not_after) and (m := tokens.match(i, atoms)):
                found[kind].append((i, m))
    classes = {body for _, (_, body, _) in found["class"]}
    functions = []
    for kind in ("class", "function"):
        for i, (name, body, last) in found[kind]:
            if name in table.not_calls:
                continue
            first = i
            if kind == "function" and table.typed:
                first = type_before(tokens, i)
                if first == i or tokens.above[i] in classes:
                    continue
            begin = tokens.start[first]
            nid = out.define(kind, name, line(begin), line(tokens.start[last]), source[begin : ends(last)])
            if kind == "function":
                functions.append((tokens.start[body] + 1, tokens.start[last], nid))
    for i, (_, _, last) in found["import"]:
        if tokens.above[i] < 0:
            out.imports(source[tokens.start[i] : ends(last)], line(tokens.start[i]))
    names = {tokens.start[i]: t for i, t in enumerate(tokens.text) if tokens.is_call(i) and t not in table.not_calls}
    for at, caller in innermost(names, functions):
        if caller:
            out.call(caller, names[at], line(at))
    if tokens.errors:
        out.warn(f"the file has parse errors: {tokens.errors}")


def type_before(tokens: Tokens, i: int) -> int:
    """The first token of the type before a name, or the name's own place if there is none."""
    if i and tokens.text[i - 1] == "::":
        return i
    first, words = i, 0
    while first and (tokens.text[first - 1][0].isalpha() or tokens.text[first - 1] in ("_", "::", "<", ">", "*", "&", ",", "~") or tokens.text[first - 1][0] == "_"):
        if tokens.text[first - 1] in ("return", "else", "new", "throw", "case", "goto", "delete"):
            break
        first -= 1
        words += tokens.text[first][0].isalpha() or tokens.text[first][0] == "_"
    return first if words else i


def extract_file(path: str, lang: str, content: bytes | None, tables: dict[str, Language] | None = None) -> list[dict]:
    """Rows of one file: nodes and edges, with capture order in seq; one error row on failure."""
    try:
        table = language(lang, tables)
        if content is None:
            raise OSError("the file could not be read")
        source = bytes(content).decode("utf-8", errors="replace")
        out = Symbols(path, lang, source)
        if table.python:
            scan_python(source, out)
        elif table.symbols:
            scan_tokens(source, out, table)
        else:
            out.warn(f"no patterns for {lang}")
        return [dict.fromkeys(COLUMNS) | r | {"seq": i} for i, r in enumerate(out.rows)]
    except Exception as e:  # noqa: BLE001  one bad file may not end the run
        return [dict.fromkeys(COLUMNS) | {"kind": "error", "seq": 0, "path": path, "error": f"{type(e).__name__}: {e}"}]


def extract_symbols(files: DataFrame, tables: dict[str, Language] | None = None) -> DataFrame:
    """Rows of extract_file for files (path, lang, content); tables add to the languages that are known."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [r for p, lang, c in zip(part["path"], part["lang"], part["content"], strict=True) for r in extract_file(p, lang, c, tables)]
            yield pd.DataFrame(rows, columns=COLUMNS)

    return files.select("path", "lang", "content").mapInPandas(run, ROW)


def extraction_errors(symbols: DataFrame) -> DataFrame:
    """path, error of the files that gave no symbols."""
    return symbols.filter("kind = 'error'").select("path", "error")


def extraction_warnings(symbols: DataFrame) -> DataFrame:
    """path, lang, warning of the files that were read in part: parse errors, no patterns."""
    return symbols.filter("kind = 'node' AND error IS NOT NULL").select("path", "lang", F.col("error").alias("warning"))


def to_graph(symbols: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes with placeholders, and edges of which the last capture wins."""
    order = F.struct("path", "seq").alias("seq")
    nodes = upsert_nodes(symbols.filter("kind = 'node'").select("id", "type", "name", "path", "lang", "properties", order)).drop("seq")
    # edges carry no path; their capture order is that of their file, which holds their source
    edges = upsert_edges(symbols.filter("kind = 'edge'").select("source_id", "target_id", "relationship", F.lit(1.0).alias("weight"), "properties", "seq")).drop("seq")
    return nodes.unionByName(placeholders(nodes, edges)), edges


__all__ = ["extract_file", "extraction_errors", "extraction_warnings", "innermost", "extract_symbols", "make_id", "stable_id", "to_graph"]
