"""Project manifests to facts: one parser for each family, run beside the data as a grouped-free map over the few manifest files."""

from __future__ import annotations

import json
import re
import tomllib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FACTS = "source_path string, kind string, name string, target string, confidence double"
PROBLEMS = "metadata_json_invalid", "metadata_toml_invalid"
Fact = tuple[str, str, str, float]

#: Elements of .NET projects and the facts that they stand for.
DOTNET = {"RootNamespace": "namespace", "AssemblyName": "assembly", "ProjectReference": "project-reference", "Compile": "compile", "Page": "page", "ApplicationDefinition": "application-definition", "EmbeddedResource": "embedded-resource", "DependentUpon": "dependent-upon"}
QUOTED = re.compile(r"""["']([^"']+)["']""")


def is_manifest(path: Column) -> Column:
    base = F.lower(F.element_at(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), -1))
    named = base.isin("go.mod", "go.work", "cargo.toml", "package.json", "tsconfig.json", "jsconfig.json", "composer.json", "pyproject.toml", "setup.cfg", "gemfile", "build.zig.zon")
    return named | base.rlike(r"\.(gemspec|rockspec|vbp|nimble|csproj|vbproj)$")


def first_quoted(line: str) -> str:
    found = QUOTED.search(line)
    return found[1] if found else ""


def assigned(line: str, key: str) -> str:
    """The value of ``key = value`` at a line's start, quoted or up to a blank or comment."""
    found = re.match(rf"""\s*{re.escape(key)}\s*=\s*(?:["']([^"']+)["']|([^#;\s]+))""", line, re.I)
    return (found[1] or found[2]) if found else ""


def keyed(line: str, key: str) -> str:
    found = re.search(rf"""\b{re.escape(key)}\s*[:=]\s*["']([^"']+)["']""", line, re.I)
    return found[1] if found else ""


def plain_json(text: str) -> str:
    """JSON with comments and trailing commas as plain JSON; what stands in strings is left alone."""
    token = re.compile(r'"(?:\\.|[^"\\])*"|//[^\n]*|/\*.*?\*/', re.S)
    bare = token.sub(lambda m: m[0] if m[0][0] == '"' else " ", text)
    return re.sub(r'("(?:\\.|[^"\\])*")|,(?=\s*[}\]])', lambda m: m[1] or "", bare)


def go_facts(text: str, base: str) -> Iterator[Fact]:
    inside = False
    for line in map(str.strip, text.split("\n")):
        words = line.split()
        if base == "go.work" and line in ("use (", ")"):
            inside = line == "use ("
            continue
        if len(words) > 1 and words[0] == "module":
            yield "module", "", words[1], 1.0
        if inside and len(words) == 1:
            yield "workspace-use", "", words[0], 0.9
        if len(words) > 1 and words[0] == "use" and words[1] != "(":
            yield "workspace-use", "", words[1].strip("()"), 0.9
        if "=>" in line and (to := line.split("=>", 1)[1].split()):
            yield "replace", line.removeprefix("replace").strip(), to[0], 0.9


def cargo_facts(text: str, base: str) -> Iterator[Fact]:
    document = tomllib.loads(text)
    table = lambda key: document[key] if isinstance(document.get(key), dict) else {}
    for of, key, kind in (("package", "name", "package"), ("lib", "path", "lib-path")):
        if isinstance(value := table(of).get(key), str):
            yield kind, "", value, 0.9
    todo = [document]
    while todo:
        for key, inner in todo.pop().items():
            if not isinstance(inner, dict):
                continue
            if key in ("dependencies", "dev-dependencies", "build-dependencies"):
                yield from (("path-dependency", name, d["path"], 0.8) for name, d in inner.items() if isinstance(d, dict) and isinstance(d.get("path"), str))
            else:
                todo.append(inner)
    members = table("workspace").get("members")
    yield from (("workspace-member", "", m, 0.8) for m in (members if isinstance(members, list) else ()) if isinstance(m, str))


def composer_paths(kind: str, value) -> Iterator[Fact]:
    """Autoload entries: a mapping of names to paths, or paths alone."""
    named = value.items() if isinstance(value, dict) else [("", value)]
    for name, paths in named:
        for path in paths if isinstance(paths, list) else [paths]:
            if not isinstance(path, str):
                raise ValueError("autoload paths must be strings")
            yield kind, name, path, 0.9 if isinstance(value, dict) else 0.8


def json_facts(text: str, base: str) -> Iterator[Fact]:
    config = base in ("tsconfig.json", "jsconfig.json")
    if config:
        yield "project-config", base, "", 1.0
    value = json.loads(plain_json(text) if config else text)
    if not isinstance(value, dict):
        raise ValueError("not an object")
    text_of = lambda d, key: d[key] if isinstance(d.get(key), str) else ""
    if name := text_of(value, "name"):
        yield "package", "", name, 1.0
    yield from ((key, "", value[key], 0.9) for key in ("type", "main", "module", "types") if isinstance(value.get(key), str))
    spaces = value.get("workspaces")
    yield from (("workspace", "", x, 0.8) for x in (spaces if isinstance(spaces, list) else ()) if isinstance(x, str))
    options = value.get("compilerOptions") if config and isinstance(value.get("compilerOptions"), dict) else {}
    root = text_of(options, "baseUrl") if "baseUrl" in options else text_of(value, "baseUrl")
    if root:
        yield "baseUrl", "", root, 0.9
    aliases = options.get("paths", value.get("paths"))
    for name, targets in aliases.items() if isinstance(aliases, dict) else ():
        for target in targets if isinstance(targets, list) else ():
            if isinstance(target, str):
                steps = [x for x in f"{root}/{target}".replace("\\", "/").split("/") if x not in ("", ".")]
                yield "path-alias", name, "/".join(steps), 0.8
    for key in ("autoload", "autoload-dev"):
        load = value.get(key)
        for kind in ("psr-4", "psr-0", "classmap", "files") if isinstance(load, dict) else ():
            if kind in load:
                yield from composer_paths(kind, load[kind])
    exports = value.get("exports")
    yield from (("export", name, to, 0.8) for name, to in (exports.items() if isinstance(exports, dict) else ()) if isinstance(to, str))


def python_facts(text: str, base: str) -> Iterator[Fact]:
    waiting = False
    for line in map(str.strip, text.split("\n")):
        if value := assigned(line, "name"):
            yield "package", "", value, 0.9
        if value := assigned(line, "where"):
            yield "package-dir", "", value, 0.8
        if line.lower().startswith("package_dir"):
            value = assigned(line, "package_dir")
            waiting = not value
            if value:
                yield "package-dir", "", value, 0.8
        elif waiting and line.startswith("="):
            if value := line[1:].strip().strip("\"'"):
                yield "package-dir", "", value, 0.8
            waiting = False


def ruby_facts(text: str, base: str) -> Iterator[Fact]:
    for line in map(str.strip, text.split("\n")):
        if line.startswith("gem ") and (path := keyed(line, "path")):
            yield "gem-path", "", path, 0.8
        for here, kind, sure in ((line.startswith("require_relative"), "require-relative", 0.9), ("s.name" in line or line.startswith("name ="), "gem", 0.9), ("require_paths" in line, "require-path", 0.8)):
            if here and (value := first_quoted(line)):
                yield kind, "", value, sure


def lua_facts(text: str, base: str) -> Iterator[Fact]:
    for line in map(str.strip, text.split("\n")):
        if line.startswith(("package", "source")) and (value := first_quoted(line)):
            yield "package", "", value, 0.8
        if ("module" in line or "dir" in line) and (value := keyed(line, "dir") or first_quoted(line)):
            yield "path", "", value, 0.7


def vb6_facts(text: str, base: str) -> Iterator[Fact]:
    for line in map(str.strip, text.split("\n")):
        key, eq, value = line.partition("=")
        if eq and key.lower() in ("form", "class", "module", "usercontrol"):
            yield "component", key, value.strip(), 0.9


def nim_facts(text: str, base: str) -> Iterator[Fact]:
    for line in map(str.strip, text.split("\n")):
        for start, kind in (("name", "package"), ("srcDir", "src-dir")):
            if line.startswith(start) and (value := first_quoted(line)):
                yield kind, "", value, 0.8
        if line.startswith("requires"):
            yield from (("path-dependency", "", x, 0.7) for x in QUOTED.findall(line) if x.startswith(("./", "../", "/")))


def zig_facts(text: str, base: str) -> Iterator[Fact]:
    for line in text.split("\n"):
        if (".name" in line or ".path" in line) and (value := first_quoted(line)):
            yield "path" if ".path" in line else "package", "", value, 0.8


def dotnet_facts(text: str, base: str) -> Iterator[Fact]:
    for tag, kind in DOTNET.items():
        for inner, include in re.findall(rf'<{tag}\b[^>]*>([^<]+)</{tag}>|<{tag}\b[^>]*\bInclude\s*=\s*"([^"]+)"[^>]*/?>', text, re.I | re.S):
            if value := (inner or include).strip():
                yield kind, "", value, 0.9


FAMILIES: tuple[tuple[str, Callable[[str, str], Iterator[Fact]]], ...] = (
    (r"go\.(mod|work)", go_facts), (r"cargo\.toml", cargo_facts), (r"(package|tsconfig|jsconfig|composer)\.json", json_facts), (r"pyproject\.toml|setup\.cfg", python_facts), (r"gemfile|.*\.gemspec", ruby_facts),
    (r".*\.rockspec", lua_facts), (r".*\.vbp", vb6_facts), (r".*\.nimble", nim_facts), (r"build\.zig\.zon", zig_facts), (r".*\.(cs|vb)proj", dotnet_facts),
)


def facts_of(path: str, content: str) -> tuple[list[Fact], str]:
    """Distinct facts of a manifest in order, and the problem code of one that can't be read ('' if it can)."""
    base = path.replace("\\", "/").rsplit("/", 1)[-1].lower()
    parse = next((f for pattern, f in FAMILIES if re.fullmatch(pattern, base)), None)
    out: list[Fact] = []
    if parse is None:
        return out, ""
    try:
        for fact in parse(content.removeprefix("\ufeff"), base):
            out.append(fact)
    except (ValueError, tomllib.TOMLDecodeError):
        return sorted(set(out)), PROBLEMS[1] if base.endswith(".toml") else PROBLEMS[0]
    return sorted(set(out)), ""


def manifest_facts(files: DataFrame) -> DataFrame:
    """``FACTS`` of the manifests among ``files`` (``path, content``); one that can't be read gives a fact of kind ``diagnostic``."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"]):
                facts, problem = facts_of(path, content or "")
                rows += [(path, *f) for f in facts] + ([(path, "diagnostic", "", problem, 1.0)] if problem else [])
            yield pd.DataFrame(rows, columns=[c.split(" ")[0] for c in FACTS.split(", ")])

    return files.filter(is_manifest(F.col("path"))).select("path", "content").mapInPandas(parse, FACTS)


def with_package(facts: DataFrame) -> DataFrame:
    """Facts with the ``package`` name of their own manifest, which entry points belong to."""
    own = facts.filter("kind = 'package'").groupBy("source_path").agg(F.min("target").alias("package"))
    return facts.join(own, "source_path", "left")
