"""Symbols and lexical relations of source files, by a lexer that knows comments, strings, braces and indentation.

One file makes many rows, so this is a ``mapInArrow``-shaped step; it emits lexical edges only, and a set-based join resolves
those whose name is unique in the file. Confidence is that of a generic extractor. A file that can't be read as its
language gives its owner symbol alone; nothing fails the run.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Confidences of declarations, of calls by name, of calls resolved in the file, of imports.
DECLARED, LEXICAL, IN_FILE, IMPORTED = 0.55, 0.25, 0.85, 0.75
NAME = r"[A-Za-z_]\w*"


@dataclass(frozen=True)
class Syntax:
    """How a language marks comments, strings, blocks, declarations and imports."""

    line_comment: str
    block_comment: tuple[str, str] | None
    strings: str
    indented: bool
    declarations: tuple[tuple[str, str], ...]
    imports: tuple[str, ...]


def syntax(line: str, block, strings: str, indented: bool, declarations: dict[str, str], *imports: str) -> Syntax:
    return Syntax(line, block, strings, indented, tuple((k, v.replace("NAME", f"(?P<name>{NAME})")) for k, v in declarations.items()), imports)


C_BLOCK = ("/*", "*/")
FUNCTION_BODY = r"^[ \t]*(?:[\w:<>,*&\[\]~]+[ \t*&]+)+NAME[ \t]*\([^;{}]*\)[^;{}=]*\{"
SYNTAXES = {
    "go": syntax("//", C_BLOCK, "\"'`", False, {"function": r"^func[ \t]+NAME[ \t]*[\[(]", "method": r"^func[ \t]*\([^)]*\)[ \t]*NAME[ \t]*\(", "struct": r"^type[ \t]+NAME[ \t]+struct\b", "interface": r"^type[ \t]+NAME[ \t]+interface\b"}, r'^import[ \t]+(?:\w+[ \t]+)?"([^"]+)"', r'^[ \t]+(?:[\w.]+[ \t]+)?"([\w./-]+)"[ \t]*$'),
    "python": syntax("#", None, "\"'", True, {"class": r"^[ \t]*class[ \t]+NAME", "function": r"^[ \t]*(?:async[ \t]+)?def[ \t]+NAME"}, r"^[ \t]*import[ \t]+([\w.]+)", r"^[ \t]*from[ \t]+([\w.]+)[ \t]+import"),
    "ruby": syntax("#", None, "\"'", False, {"class": r"^[ \t]*class[ \t]+NAME", "module": r"^[ \t]*module[ \t]+NAME", "method": r"^[ \t]*def[ \t]+(?:self\.)?NAME"}, r"""^[ \t]*require(?:_relative)?[ \t(]+['"]([^'"]+)"""),
    "javascript": syntax("//", C_BLOCK, "\"'`", False, {"class": r"\bclass[ \t]+NAME", "function": r"\bfunction\*?[ \t]+NAME", "arrow_function": r"^[ \t]*(?:export[ \t]+)?(?:const|let|var)[ \t]+NAME[ \t]*=[ \t]*(?:async[ \t]*)?(?:\([^)]*\)|\w+)[ \t]*=>", "method": r"^[ \t]+(?:async[ \t]+|static[ \t]+)*(?!if|for|while|switch|catch|return)NAME[ \t]*\([^;{}]*\)[ \t]*\{"}, r"""^[ \t]*(?:import|export)\b[^'"\n]*['"]([^'"]+)""", r"""\brequire\([ \t]*['"]([^'"]+)"""),
    "rust": syntax("//", C_BLOCK, '"', False, {"function": r"\bfn[ \t]+NAME", "struct": r"\bstruct[ \t]+NAME", "enum": r"\benum[ \t]+NAME", "trait": r"\btrait[ \t]+NAME", "impl": r"\bimpl(?:<[^>]*>)?[ \t]+NAME"}, r"^[ \t]*(?:pub[ \t]+)?use[ \t]+([\w:]+)", r"^[ \t]*(?:pub[ \t]+)?mod[ \t]+(\w+)[ \t]*;"),
    "php": syntax("//", C_BLOCK, "\"'", False, {"class": r"\bclass[ \t]+NAME", "interface": r"\binterface[ \t]+NAME", "trait": r"\btrait[ \t]+NAME", "function": r"\bfunction[ \t]+&?NAME"}, r"^[ \t]*use[ \t]+([\w\\]+)", r"""\b(?:require|include)(?:_once)?[ \t(]+['"]([^'"]+)"""),
    "csharp": syntax("//", C_BLOCK, "\"'", False, {"class": r"\bclass[ \t]+NAME", "interface": r"\binterface[ \t]+NAME", "struct": r"\bstruct[ \t]+NAME", "enum": r"\benum[ \t]+NAME", "method": FUNCTION_BODY}, r"^[ \t]*using[ \t]+([\w.]+)[ \t]*;"),
    "cpp": syntax("//", C_BLOCK, "\"'", False, {"class": r"\bclass[ \t]+NAME[^;{]*\{", "struct": r"\bstruct[ \t]+NAME[^;{]*\{", "namespace": r"\bnamespace[ \t]+NAME", "function": FUNCTION_BODY}, r'^[ \t]*#[ \t]*include[ \t]*[<"]([^>"]+)'),
    "lua": syntax("--", ("--[[", "]]"), "\"'", False, {"function": r"\bfunction[ \t]+(?:\w+[.:])*NAME"}, r"""\brequire[ \t(]+['"]([^'"]+)"""),
    "nim": syntax("#", None, '"', True, {"function": r"^[ \t]*(?:proc|func|method|template|iterator|macro)[ \t]+NAME"}, r"^[ \t]*(?:import|include|from)[ \t]+([\w./]+)"),
    "zig": syntax("//", None, '"', False, {"function": r"\bfn[ \t]+NAME", "struct": r"\bconst[ \t]+NAME[ \t]*=[ \t]*(?:packed[ \t]+|extern[ \t]+)?struct\b"}, r'@import\("([^"]+)"\)'),
}
SYNTAXES |= {"typescript": SYNTAXES["javascript"], "c": SYNTAXES["cpp"], "pawn": SYNTAXES["cpp"]}
#: Words before a bracket that call nothing.
KEYWORDS = frozenset("if for while switch catch return function def class sizeof elif with and or not in new typeof await yield assert print match loop fn func".split())
CALL = re.compile(rf"(?<![\w.])((?:{NAME}(?:\.|::|->))*{NAME})[ \t]*\(")


def blanked(text: str, s: Syntax, keep_strings: bool = False) -> str:
    """The text with comments (and the insides of strings) as blanks, every line end in its place."""
    parts = [re.escape(s.line_comment) + r"[^\n]*"]
    if s.block_comment:
        a, b = map(re.escape, s.block_comment)
        parts.insert(0, f"{a}.*?(?:{b}|\\Z)")
    if s.indented:
        parts.insert(0, r'"""(?:.*?)(?:"""|\Z)|\'\'\'(?:.*?)(?:\'\'\'|\Z)')
    quoted = [rf"{q}(?:\\.|[^\\{q}{'' if q == '`' else chr(10)}])*{q}?" for q in s.strings]
    pattern = re.compile("|".join([*(f"(?P<c{i}>{p})" for i, p in enumerate(parts)), *quoted]), re.S)
    return pattern.sub(lambda m: m[0] if keep_strings and m.lastgroup is None else re.sub(r"[^\n]", " ", m[0]), text)


def end_of(code: str, lines: list[str], line: int, at: int, s: Syntax) -> int:
    """Last line (from 0) of a declaration that begins at this line and character."""
    if s.indented:
        depth = len(lines[line]) - len(lines[line].lstrip())
        last = line
        for i in range(line + 1, len(lines)):
            if lines[i].strip():
                if len(lines[i]) - len(lines[i].lstrip()) <= depth:
                    break
                last = i
        return last
    opened, depth = code.find("{", at), 0
    stop = code.find(";", at)
    if opened < 0 or (0 <= stop < opened):
        return line
    for m in re.compile("[{}]").finditer(code, opened):
        depth += 1 if m[0] == "{" else -1
        if not depth:
            return code.count("\n", 0, m.start())
    return len(lines) - 1


def extract(path: str, language: str, text: str) -> tuple[list[tuple], list[tuple]]:
    """(kind, name, qualified, parent, first line, last line, confidence) and (from, kind, target, confidence); parents and origins by qualified name."""
    module = re.sub(r"\.[^./]+$", "", path).replace("/", ".")
    n = text.count("\n") + 1
    symbols: list[tuple] = [("module", module.rsplit(".", 1)[-1], module, None, 1, n, 0.9)]
    s = SYNTAXES.get(language)
    if s is None:
        return symbols, []
    code, with_strings = blanked(text, s), blanked(text, s, keep_strings=True)
    lines = code.split("\n")
    found: dict[tuple[int, str], tuple[str, int]] = {}
    for kind, pattern in s.declarations:
        for m in re.finditer(pattern, code, re.M):
            line = code.count("\n", 0, m.start("name"))
            if m["name"] not in KEYWORDS:
                found.setdefault((line, m["name"]), (kind, end_of(code, lines, line, m.end("name"), s)))
    edges: list[tuple] = []
    open_scopes: list[tuple[str, int]] = [(module, n)]
    spans: list[tuple[int, int, str, str]] = []
    for (line, name), (kind, last) in sorted(found.items()):
        while len(open_scopes) > 1 and open_scopes[-1][1] < line:
            open_scopes.pop()
        parent = open_scopes[-1][0]
        own = f"{parent}.{name}"
        if kind in ("function", "method") and re.match(r"(?i)test", name):
            kind = "test"
        elif kind == "function" and parent != module:
            kind = "method"
        symbols.append((kind, name, own, parent, line + 1, last + 1, DECLARED))
        edges.append((parent, "contains", own, 1.0))
        spans.append((line, last, own, kind))
        open_scopes.append((own, last))
    declared = {(line, name) for line, name in found}
    seen: set[tuple] = set()
    for m in CALL.finditer(code):
        line = code.count("\n", 0, m.start())
        bare = re.split(r"\.|::|->", m[1])[-1]
        if bare in KEYWORDS or (line, bare) in declared:
            continue
        holder = max((x for x in spans if x[0] <= line <= x[1]), key=lambda x: x[0], default=(0, 0, module, "module"))
        edge = (holder[2], "tests" if holder[3] == "test" else "calls", m[1], LEXICAL)
        if edge not in seen:
            seen.add(edge)
            edges.append(edge)
    for pattern in s.imports:
        edges += [(module, "imports", m[1], IMPORTED) for m in re.finditer(pattern, with_strings, re.M)]
    return symbols, list(dict.fromkeys(edges))


ROW = "path string, language string, entity string, kind string, name string, qualified_name string, parent string, start_line long, end_line long, target string, confidence double"


def extractions(files: DataFrame) -> DataFrame:
    """Symbol and relation rows of ``path, language, content``."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = []
            for path, language, content in zip(pdf["path"], pdf["language"], pdf["content"]):
                symbols, edges = extract(path, language, content or "")
                rows += [(path, language, "symbol", k, name, q, parent, a, b, None, c) for k, name, q, parent, a, b, c in symbols]
                rows += [(path, language, "relation", k, None, origin, None, None, None, target, c) for origin, k, target, c in edges]
            yield pd.DataFrame(rows, columns=[c.split(" ")[0] for c in ROW.split(", ")]).astype({"start_line": "Int64", "end_line": "Int64"})

    return files.select("path", "language", "content").mapInPandas(run, ROW)


def resolve_in_file(rows: DataFrame) -> DataFrame:
    """Relations with ``resolved_to``: the qualified name of the one symbol of the file that a call names, if there is one."""
    named = rows.filter("entity = 'symbol'").groupBy(F.col("path").alias("in_path"), F.col("name").alias("called")).agg(F.min("qualified_name").alias("first"), F.max("qualified_name").alias("last"))
    unique = named.filter("first = last").select("in_path", "called", "first")
    calls = rows.filter("entity = 'relation'").withColumn("bare", F.regexp_extract("target", r"([^.:>]*)$", 1))
    on = (F.col("path") == F.col("in_path")) & (F.col("bare") == F.col("called")) & F.col("kind").isin("calls", "tests")
    out = calls.join(unique, on, "left")
    known = F.col("first").isNotNull()
    return out.select("path", "language", "kind", F.col("qualified_name").alias("origin"), "target", F.when(F.col("kind") == "contains", F.col("target")).otherwise(F.col("first")).alias("resolved_to"), F.when(known, IN_FILE).otherwise(F.col("confidence")).alias("confidence"))
