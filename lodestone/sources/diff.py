"""Unified diffs as tables of changed files and hunks."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame

HUNK = re.compile(r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@")
ESCAPE = re.compile(r"\\([0-7]{3}|.)")
#: C escapes in quoted paths.
ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "a": "\a", "b": "\b", "f": "\f", "v": "\v", '"': '"', "\\": "\\"}


@dataclass
class Change:
    path: str
    old_path: str
    kind: str = "modify"
    binary: bool = False
    hunks: list[tuple[int, int, int, int]] = field(default_factory=list)

    @property
    def ranges(self) -> list[tuple[int, int]]:
        """New line ranges; a pure deletion is the line that survives before it."""
        if self.kind == "delete":
            return [(c, c + d - 1) for _, _, c, d in self.hunks if d]
        return [(c, c + d - 1) if d else (max(1, c), max(1, c)) for _, b, c, d in self.hunks if b or d]


def unquote(path: str) -> str:
    if not path.startswith('"'):
        return path.split("\t")[0]
    raw = ESCAPE.sub(lambda m: chr(int(m[1], 8)) if m[1].isdigit() else ESCAPES.get(m[1], m[1]), path[1 : path.rindex('"')])
    return raw.encode("latin-1", "surrogateescape").decode("utf-8", "replace") if all(ord(c) < 256 for c in raw) else raw


def bare(path: str) -> str:
    return path[2:] if path.startswith(("a/", "b/")) else path


def header_paths(rest: str) -> tuple[str, str]:
    quoted = re.findall(r'"(?:[^"\\]|\\.)*"', rest)
    if len(quoted) == 2:
        return bare(unquote(quoted[0])), bare(unquote(quoted[1]))
    half = re.match(r"a/(.*) b/\1$", rest)
    if half:
        return half[1], half[1]
    old, _, new = rest.partition(" b/")
    return bare(unquote(old)), unquote(new)


def parse(text: str) -> list[Change]:
    out: list[Change] = []
    in_hunk = False
    for line in text.replace("\r\n", "\n").split("\n"):
        if line.startswith("diff --git "):
            old, new = header_paths(line[11:])
            out.append(Change(new, old))
            in_hunk = False
        elif not out:
            continue
        elif m := HUNK.match(line):
            a, b, c, d = (1 if x is None else int(x) for x in m.groups())
            out[-1].hunks.append((a, b, c, d))
            in_hunk = True
        elif in_hunk:
            continue
        elif line.startswith("new file mode"):
            out[-1].kind = "add"
        elif line.startswith("deleted file mode"):
            out[-1].kind = "delete"
        elif line.startswith(("rename from ", "rename to ")):
            out[-1].kind = "rename"
            setattr(out[-1], "old_path" if line[7] == "f" else "path", unquote(line.split(" ", 2)[2]))
        elif line.startswith("Binary files "):
            out[-1].binary = True
        elif line.startswith(("+++ ", "--- ")) and not line.endswith("/dev/null"):
            setattr(out[-1], "path" if line[0] == "+" else "old_path", bare(unquote(line[4:])))
    return out


SCHEMA = "diff_id long, path string, old_path string, kind string, binary boolean, old_start long, old_count long, new_start long, new_count long"


def hunks(diffs: DataFrame) -> DataFrame:
    """One row per hunk (one without numbers for a file without hunks) of ``diff_id, text``."""

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = []
            for i, text in zip(pdf["diff_id"], pdf["text"]):
                for c in parse(text or ""):
                    rows += [(i, c.path, c.old_path, c.kind, c.binary, *h) for h in c.hunks or [(None,) * 4]]
            yield pd.DataFrame(rows, columns=[c.split(" ")[0] for c in SCHEMA.split(", ")])

    return diffs.select("diff_id", "text").mapInPandas(read, SCHEMA)
