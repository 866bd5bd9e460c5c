"""Symbols and relations of XAML, resource files and templates, as ``extract.ROW`` rows: one tolerant scan for tags each.

Broken markup is read as far as it goes; a file without a tag gives its document alone.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from lodestone.operators.extract import ROW

#: Confidences.
DOCUMENT, ELEMENT, CONTAINED, CLASS, EVENT, BINDING, RESOURCE, DICTIONARY, TYPE, FILE_REF, INCLUDE, SCRIPT, CALL = 0.9, 0.85, 0.9, 0.9, 0.8, 0.65, 0.7, 0.8, 0.55, 0.8, 0.8, 0.75, 0.7
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z_][\w.:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
ATTRIBUTE = re.compile(r"""([\w.:-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'{}=<>]+))""")
MARKS = re.compile(r"\{\*.*?(?:\*\}|\Z)|\{(/?)([A-Za-z_]\w*)((?:[^{}\"']|\"[^\"]*\"|'[^']*')*)\}|<script\b([^>]*)>", re.S)
EVENTS = re.compile(r"(click|changed|loaded|unloaded|opened|closed|closing|checked|unchecked|selected|down|up|enter|leave|move|focus|completed|executed|tapped)$", re.I)

Symbol = tuple  # kind, name, qualified name, parent, first line, last line, confidence
Edge = tuple  # from, kind, target, confidence


class Lines:
    def __init__(self, text: str):
        self.starts = [0, *(m.end() for m in re.finditer("\n", text))]

    def at(self, offset: int) -> int:
        return bisect_right(self.starts, offset)


def attributes(raw: str) -> dict[str, str]:
    return {k: a or b or c for k, a, b, c in ATTRIBUTE.findall(raw)}


def binding(value: str) -> str:
    """The path of a binding: its first part, or what ``Path=`` says."""
    found = re.match(r"\{\s*(?:x:)?(?:Bind|Binding|TemplateBinding)\b\s*(.*)\}\s*$", value, re.S)
    if not found:
        return ""
    parts = [p.strip() for p in found[1].split(",")]
    named = next((p.split("=", 1)[1].strip() for p in parts if re.match(r"Path\s*=", p)), "")
    return named or (parts[0] if parts[0] and "=" not in parts[0] else "")


def resource(value: str) -> str:
    found = re.match(r"\{\s*(?:StaticResource|DynamicResource|ThemeResource)\s+(?:ResourceKey\s*=\s*)?([^,}\s]+)", value)
    return found[1] if found else ""


def xaml(path: str, text: str) -> tuple[list[Symbol], list[Edge]]:
    """Named elements, resources by key, and elements with handlers or bindings; classes, handlers, bindings, resources, dictionaries."""
    lines = Lines(text)
    tags = [(m, attributes(m[3])) for m in TAG.finditer(text) if m[2] and not m[1]]
    symbols: list[Symbol] = [("xaml_document", path, path, None, 1, len(lines.starts), DOCUMENT)]
    edges: list[Edge] = []
    keys = {a["x:Key"]: f"{path}::{a['x:Key']}" for _, a in tags if a.get("x:Key")}
    for i, (m, a) in enumerate(tags):
        name, key = a.get("x:Name") or a.get("Name"), a.get("x:Key")
        handlers = {k: v for k, v in a.items() if EVENTS.search(k) and v and not v.startswith("{")}
        bound = [v for v in a.values() if binding(v) or resource(v)]
        kind = "xaml_named" if name else "xaml_resource" if key else "xaml_element" if handlers or bound else ""
        own = path
        if kind:
            label = name or key or m[2]
            own = f"{path}::{label}"
            symbols.append((kind, label, own, path, lines.at(m.start()), lines.at(m.end() - 1), ELEMENT))
            edges.append((path, "contains", own, CONTAINED))
        if i == 0 and a.get("x:Class"):
            edges.append((path, "references", a["x:Class"], CLASS))
        edges += [(own, "references", v, EVENT) for v in handlers.values()]
        for k, v in a.items():
            if target := binding(v):
                edges.append((own, "references", target, BINDING))
            if target := resource(v):
                edges.append((own, "references", keys.get(target, target), RESOURCE))
            if k.lower() == "source" and v and not v.startswith("{"):
                edges.append((path, "imports", v, DICTIONARY))
    return symbols, list(dict.fromkeys(edges))


def resx(path: str, text: str) -> tuple[list[Symbol], list[Edge]]:
    """Items by name, their types, and the files that they refer to."""
    lines = Lines(text)
    symbols: list[Symbol] = [("resx_document", path, path, None, 1, len(lines.starts), DOCUMENT)]
    edges: list[Edge] = []
    kinds = {"data": "resx_data", "metadata": "resx_metadata", "setting": "settings_item"}
    for m in TAG.finditer(text):
        tag = (m[2] or "").lower()
        if m[1] or tag not in kinds:
            continue
        a = {k.lower(): v for k, v in attributes(m[3]).items()}
        if not a.get("name"):
            continue
        own = f"{path}::{m[2]}::{a['name']}"
        symbols.append((kinds[tag], a["name"], own, path, lines.at(m.start()), lines.at(m.end() - 1), ELEMENT))
        edges.append((path, "contains", own, CONTAINED))
        edges += [(own, "references", a[k], TYPE) for k in ("type", "mimetype", "scope") if a.get(k)]
        if "resxfileref" in a.get("type", "").lower():
            value = re.compile(r"\s*<value>\s*([^;<]+)").match(text, m.end())
            if value:
                edges.append((path, "imports", value[1].strip().replace("\\", "/"), FILE_REF))
    return symbols, list(dict.fromkeys(edges))


def beside(path: str, target: str) -> str:
    """A target seen from the file's folder where it starts with a dot; otherwise as it is."""
    if not target.startswith("."):
        return target.lstrip("/")
    parts = path.split("/")[:-1]
    for step in target.split("/"):
        if step == "..":
            parts = parts[:-1]
        elif step not in ("", "."):
            parts.append(step)
    return "/".join(parts)


def template(path: str, text: str) -> tuple[list[Symbol], list[Edge]]:
    """Blocks, functions and captures of a template; what it extends, includes and calls; its scripts."""
    lines = Lines(text)
    symbols: list[Symbol] = [("template", path, path, None, 1, len(lines.starts), DOCUMENT)]
    edges: list[Edge] = []
    kinds = {"block": "template-block", "function": "template-function", "capture": "template-capture"}
    scopes: list[tuple[str, str, int]] = []  # tag, qualified name, place among the symbols
    calls: list[tuple[str, str]] = []
    for m in MARKS.finditer(text):
        if m[4] is not None:
            if src := {k.lower(): v for k, v in attributes(m[4]).items()}.get("src"):
                edges.append((path, "imports", beside(path, src), SCRIPT))
            continue
        tag = (m[2] or "").lower()
        if m[1]:
            if scopes and scopes[-1][0] == tag:
                _, _, i = scopes.pop()
                symbols[i] = (*symbols[i][:5], lines.at(m.end() - 1), symbols[i][6])
            continue
        a = attributes(m[3] or "")
        first = re.match(r"\s*[\"']([^\"']+)[\"']|\s*(\w+)\s*(?:\s|$)", m[3] or "")
        plain = (first[1] or first[2]) if first else ""
        here = scopes[-1][1] if scopes else path
        if tag in kinds and (name := a.get("name") or plain):
            own = f"{here}::{name}"
            scopes.append((tag, own, len(symbols)))
            symbols.append((kinds[tag], name, own, here, lines.at(m.start()), len(lines.starts), 1.0))
            edges.append((here, "contains", own, 1.0))
        elif tag in ("extends", "include") and (target := a.get("file") or plain):
            edges.append((path, "imports", beside(path, target.removeprefix("file:")), INCLUDE))
        elif tag == "call" and (target := a.get("name") or plain):
            calls.append((here, target))
    named: dict[str, list[str]] = {}
    for kind, name, own, *_ in symbols:
        if kind == "template-function":
            named.setdefault(name, []).append(own)
    edges += [(here, "calls", named[t][0] if len(named.get(t, ())) == 1 else t, CALL) for here, t in calls]
    return symbols, list(dict.fromkeys(edges))


SCANNERS: dict[str, Callable[[str, str], tuple[list[Symbol], list[Edge]]]] = {"xaml": xaml, "dotnet-resource": resx, "smarty": template, "template": template}


def extractions(files: DataFrame) -> DataFrame:
    """Symbol and relation rows of the markup files among ``path, language, content``."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = []
            for path, language, content in zip(pdf["path"], pdf["language"], pdf["content"]):
                symbols, edges = SCANNERS[language](path, content or "")
                rows += [(path, language, "symbol", k, name, q, parent, a, b, None, c) for k, name, q, parent, a, b, c in symbols]
                rows += [(path, language, "relation", k, None, origin, None, None, None, target, c) for origin, k, target, c in edges]
            yield pd.DataFrame(rows, columns=[c.split(" ")[0] for c in ROW.split(", ")]).astype({"start_line": "Int64", "end_line": "Int64"})

    return files.filter(files["language"].isin(*SCANNERS)).select("path", "language", "content").mapInPandas(run, ROW)
