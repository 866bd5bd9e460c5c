"""Context under a token budget: bundles of items, and role-labelled evidence packets.

Both are greedy and order-dependent, over the windows of at most the fused cap of files a question: grouped-map Python, one question a
group, so that a table of questions runs in parallel.
"""

from __future__ import annotations

import json
import math
import re
import unicodedata

import pandas as pd
from pyspark.sql import DataFrame

MIN_BUDGET, MAX_BUDGET = 256, 64_000
ELIDED = "[...elided...]"
#: Utilities, role weights by intent, qualities by fidelity, role order in presentation.
RANK_BASE, NEW_ROLE, NEW_PATH, RELATION, RESOLVED, IDENTITY, CHANGED, REPEATED_PATH, OTHER_ROLE = 100, 18, 10, 16, 8, 14, 12, 7, 8
ROLE_WEIGHTS = {
    "definition": {"target": 45, "implementation": 34, "definition": 30, "declaration": 24, "type": 18},
    "callers": {"target": 40, "caller": 46, "test": 20, "implementation": 18},
    "callees": {"target": 40, "callee": 46, "type": 20, "import": 18},
    "tests": {"target": 36, "test": 50, "implementation": 18, "config": 12},
    "imports": {"target": 34, "import": 46, "export": 38, "dependent": 24, "config": 14},
    "exports": {"target": 34, "import": 46, "export": 38, "dependent": 24, "config": 14},
    "references": {"target": 38, "reference": 44, "type": 30, "dependent": 20},
    "impact": {"change": 50, "dependent": 46, "caller": 30, "test": 28, "target": 26},
}
QUALITY = {"verbatim": 1.30, "excerpt": 1.20, "synthetic": 1.05, "signature": 1.0}
SELECTION_LIMIT = {"definition": 1, "impact": 6}
TYPE_KINDS = frozenset("class interface struct record trait type enum protocol union".split())
IMPLEMENTATION_KINDS = frozenset("function method constructor destructor operator implementation impl sub event-handler arrow_function macro".split())
WHY_ORDER = ("exact_symbol", "qualified_symbol", "direct_caller", "direct_callee", "related_test", "imports_target", "imported_by", "references_target", "contains_target", "parent_context", "changed_span", "path_match", "lexical_match", "same_symbol", "same_file")
WHY_REASONS = {"symbol-exact": "exact_symbol", "qualified-symbol": "qualified_symbol", "symbol-prefix": "qualified_symbol", "path": "path_match", "lexical": "lexical_match", "retrieval-fusion": "lexical_match", "changed-file": "changed_span", "same-symbol": "same_symbol", "same-file": "same_file"}
WHY_RELATIONS = {"callers": "direct_caller", "callees": "direct_callee", "tests": "related_test", "references": "references_target", "children": "contains_target", "parent": "parent_context"}


def estimate(text: str) -> int:
    """The token estimate of a text, as ``functions.text.estimate_tokens``."""
    if not text:
        return 0
    ascii_chars = sum(c < "\x7f" for c in text)
    words = len(re.findall(r"\w+", text)) if text.isascii() else _identifiers(text)
    marks = sum(unicodedata.category(c)[0] in "PS" and c != "_" for c in text)
    return math.ceil(1.12 * (ascii_chars / 4 + (len(text) - ascii_chars) / 1.8 + marks / 8 + words / 3 + 4))


def _identifiers(text: str) -> int:
    inside, n = False, 0
    for c in text:
        own = c == "_" or unicodedata.category(c) in ("Lu", "Ll", "Lt", "Lm", "Lo", "Nd")
        n += own and not inside
        inside = own
    return n


def clamp(budget: int) -> int:
    return min(MAX_BUDGET, max(MIN_BUDGET, budget))


def elide(content: str, tokens: int) -> str:
    """Leading lines within a number of tokens, and a mark."""
    lines = content.replace("\r\n", "\n").split("\n") if content and tokens >= 8 else []
    lo, hi = 0, len(lines)  # the estimate grows with the lines, so the longest fit is found by halving
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if estimate("\n".join(lines[:mid]) + f"\n{ELIDED}\n") <= tokens:
            lo = mid
        else:
            hi = mid - 1
    return "\n".join(lines[:lo]) + f"\n{ELIDED}\n" if lo else ELIDED + "\n"


def codes(row: dict) -> set[str]:
    return {r["code"] if isinstance(r, dict) else r[0] for r in (row.get("reasons") if row.get("reasons") is not None else ())}


def is_documentation(row: dict) -> bool:
    return row["kind"] == "heading" or row["language"] in ("markdown", "text")


def is_test(row: dict) -> bool:
    path = row["path"].lower().replace("\\", "/")
    named = row["kind"] in ("test", "test-suite") or row["symbol"].startswith("Test")
    return named and ("/test" in path or path.startswith("test") or any(x in path for x in ("_test.", ".test.", ".spec.")))


def is_structural(row: dict) -> bool:
    return any(c in ("symbol-exact", "symbol-prefix", "path", "changed-file", "test-pair") or c.startswith("relation") for c in codes(row))


def wants_tests(query: str, intents: list[str]) -> bool:
    words = {w.strip(".,?!:;()[]{}") for w in query.lower().split()}
    return "tests" in intents or bool(words & {"test", "tests", "testing", "coverage", "cover", "spec", "specs"})


def pack(query: str, intents: list[str], rows: list[dict], budget: int, mode: str = "source") -> tuple[list[dict], int]:
    """(items, omitted): candidates in order, as long as the serialised bundle stays within the budget."""
    budget = clamp(budget)
    tests = wants_tests(query, intents) and any(map(is_test, rows))
    some_code, some_structure = any(not is_documentation(r) for r in rows), any(map(is_structural, rows))
    production = any(not is_documentation(r) and not is_test(r) for r in rows)
    items: list[dict] = []
    size = lambda extra=(): estimate(json.dumps({"query": query, "budget": budget, "items": [*items, *extra]}, ensure_ascii=False, separators=(",", ":")))
    omitted, n_tests, seen_relations = 0, 0, set()
    for i, row in enumerate(rows):
        skip = (some_code and is_documentation(row)) or (some_structure and i > 0 and not is_structural(row))
        if not skip and tests:
            skip = not is_test(row) or n_tests >= 2
            n_tests += not skip
        elif not skip:
            skip = not wants_tests(query, intents) and "impact" not in intents and production and bool(row["language"]) and is_test(row)
        if skip:
            omitted += 1
            continue
        item = {k: row[k] for k in ("handle", "path", "kind", "symbol", "signature", "start_line", "end_line", "score", "relation")} | {"content": row["content"] if mode == "source" else ""}
        if row["relation"]:
            if row["relation"] in seen_relations and item["content"]:
                item["content"] = row["signature"] or ELIDED + "\n"
            seen_relations.add(row["relation"])
        if i and items and not codes(row) & {"symbol-exact", "symbol-prefix"}:
            top, own = rows[0]["score"], row["score"]
            weak = top > 0 and own > 0 and ((not row["relation"] and own * 2 < top) or (own * 4 < top and size([item]) > budget * 3 // 5))
            if weak:
                omitted += 1
                continue
        if mode == "source" and item["content"] and (size([item]) > budget or (i and estimate(item["content"]) > budget * 40 // 100)):
            item["content"] = elide(row["content"], budget // 3)
        if mode == "source" and size([item]) > budget:
            item["content"] = elide(row["content"], budget // 5)
        if size([item]) > budget:
            item["content"] = ELIDED
        if size([item]) > budget:
            omitted += 1
            continue
        items.append(item | {"estimated_tokens": estimate(item["content"])})
    while items and size() > budget:
        items.pop()
        omitted += 1
    return items, omitted


def role(row: dict, intent: str, target: bool) -> str:
    """What a candidate is to the question."""
    relation, direction = row["relation"], row.get("direction") or "related"
    if intent == "impact" and row.get("changed"):
        return "change"
    if intent == "impact" and relation:
        return "dependent"
    if target:
        return "target"
    if relation in ("imports", "exports"):
        return "dependent" if direction == "incoming" else relation[:-1]
    if relation in ("callers", "callees", "tests", "references"):
        return relation[:-1]
    kind, path, language = row["kind"].lower(), row["path"].lower().replace("\\", "/"), row["language"].lower()
    base = path.rsplit("/", 1)[-1]
    if kind in ("test", "test-suite") or row["symbol"].lower().startswith("test") or "/test" in path or path.startswith("test") or any(x in path for x in ("_test.", ".test.", ".spec.")):
        return "test"
    if kind.startswith("template") or kind == "block" or language in ("smarty", "template"):
        return "template"
    if kind in ("config", "manifest", "project") or base in ("go.mod", "gemfile") or base.endswith((".csproj", ".vbproj", ".json", ".yaml", ".yml", ".toml")) or path.startswith("config/") or "/config/" in path:
        return "config"
    if kind in ("heading", "documentation") or language in ("markdown", "text") or path.endswith(".md"):
        return "documentation"
    if language in ("c", "cpp") and path.endswith((".h", ".hh", ".hpp", ".hxx")) and kind in ("function", "method", "prototype"):
        return "declaration"
    if kind in ("prototype", "ambient") or "declaration" in kind:
        return "declaration"
    if kind.removesuffix("-outline") in TYPE_KINDS:
        return "type"
    if kind == "definition":
        return "definition"
    return "implementation" if kind in IMPLEMENTATION_KINDS else "context"


def why(row: dict) -> list[str]:
    found = {WHY_REASONS[c] for c in codes(row) if c in WHY_REASONS}
    if row.get("changed"):
        found.add("changed_span")
    if row["relation"] == "imports":
        found.add("imported_by" if row.get("direction") == "incoming" else "imports_target")
    elif row["relation"] in WHY_RELATIONS:
        found.add(WHY_RELATIONS[row["relation"]])
    return [c for c in WHY_ORDER if c in found][:4]


def certainty(resolved: bool, confidence: float) -> str:
    return "lexical" if not resolved else "exact" if confidence >= 0.9 else "scoped"


def focused(content: str, terms: list[str]) -> str:
    """The declaration's first lines and the three best windows around lines that name a term."""
    lines = content.splitlines(keepends=True)
    hits = [(i, n) for i, x in enumerate(lines) if (n := sum(t.lower() in x.lower() for t in terms))]
    merged: list[list[int]] = []
    for i, n in hits:
        a, b = max(0, i - 2), min(len(lines) - 1, i + 4)
        if merged and a - merged[-1][1] <= 3:
            merged[-1][1], merged[-1][2] = max(b, merged[-1][1]), max(n, merged[-1][2])
        else:
            merged.append([a, b, n])
    head = next((i for i, x in enumerate(lines[:6]) if "{" in x or ":" in x), min(5, len(lines) - 1))
    chosen = [(0, head), *[(a, b) for a, b, _ in sorted(merged, key=lambda w: (-w[2], w[0]))[:3]]] if lines else []
    keep = sorted({i for a, b in chosen for i in range(a, b + 1)})
    return "".join(lines[i] for i in keep)


def variants(row: dict, own_role: str, mode: str, terms: list[str]) -> list[tuple[str, str]]:
    """(fidelity, text), the best first."""
    content = row["content"]
    signature = (row["signature"] or "").strip() or f"{row['kind'] or 'source'} {row['symbol'] or 'unnamed'} ({row['path']}:{row['start_line']}-{row['end_line']})"
    if row["kind"].lower().endswith("-outline") or row["kind"] == "test-suite":
        return [("synthetic", content)] if content else []
    out: list[tuple[str, str]] = []
    lines = len(content.splitlines())
    if content and mode == "source":
        out.append(("verbatim", content))
        if lines > 1:
            out.append(("excerpt", focused(content, terms)))
    elif content and mode == "focused":
        if (own_role in ("target", "implementation") and lines < 40) or (own_role in ("caller", "callee", "test") and lines < 24):
            out.append(("verbatim", content))
        elif own_role in ("target", "implementation") or any(t.lower() in content.lower() for t in terms):
            out.append(("excerpt", focused(content, terms)))
    return [*out, ("signature", signature)]


def utility(row: dict, own_role: str, position: int, intent: str, roles: set[str], paths: set[str], first: bool) -> float:
    value = RANK_BASE / (1 + position) + ROLE_WEIGHTS.get(intent, {}).get(own_role, OTHER_ROLE)
    if not first:
        value += NEW_ROLE * (own_role not in roles) + (NEW_PATH if row["path"] not in paths else -REPEATED_PATH)
    if row["relation"]:
        value += RELATION + RESOLVED * bool(row.get("resolved"))
    if set(why(row)) & {"exact_symbol", "qualified_symbol"}:
        value += IDENTITY
    return value + CHANGED * bool(row.get("changed"))


def compile_packet(query: str, intent: str, anchors: list[str], terms: list[str], rows: list[dict], budget: int, mode: str = "focused", known: frozenset[str] = frozenset(), revision: str = "") -> dict:
    """The packet: an anchor first, then the best utility per added token, as far as limit and budget go."""
    limit = clamp(budget)
    low = {a.lower() for a in anchors}
    target = next((i for i, r in enumerate(rows) if not r["relation"] and (codes(r) & {"symbol-exact", "qualified-symbol"} or r["symbol"].lower() in low)), -1)
    prepared, seen, skipped, dropped = [], set(), 0, 0
    for i, row in enumerate(rows):
        own = role(row, intent, i == target)
        keys = {("h", row["handle"]), ("c", row["path"], row["content"]), ("s", row["path"], row["start_line"], row["end_line"])}
        if row["handle"] in known:
            skipped += 1
        elif keys & seen:
            dropped += 1
        else:
            seen |= keys
            prepared.append((i, row, own, variants(row, own, mode, terms)))

    def build(chosen: list) -> dict:
        items = [
            {"id": f"e{k}", "handle": r["handle"], "role": o, "location": {"path": r["path"], "lines": [int(r["start_line"]), int(r["end_line"])]}, "fidelity": f, "text": x, "why": why(r)}
            for k, (_, r, o, (f, x), _) in enumerate(chosen, 1)
        ]
        packet = {"schema": "evidence/1", "revision": revision, "intent": intent, "mode": mode, "budget": {"limit": limit, "used": 0, "omitted": len(rows) - len(chosen), "truncated": len(chosen) < len(rows), "known": skipped}, "evidence": items}
        for _ in range(4):  # the number is part of the text that it measures
            used = estimate(json.dumps(packet, ensure_ascii=False, separators=(",", ":")))
            if used == packet["budget"]["used"]:
                break
            packet["budget"]["used"] = used
        return packet

    chosen: list = []
    for i, row, own, options in prepared:
        if own in ("target", "change"):
            for option in options:
                trial = [(i, row, own, option, utility(row, own, i, intent, set(), set(), True))]
                if build(trial)["budget"]["used"] <= limit:
                    chosen = trial
                    break
            break
    while len(chosen) < SELECTION_LIMIT.get(intent, 4):
        taken, roles, paths = {c[0] for c in chosen}, {c[2] for c in chosen}, {c[1]["path"] for c in chosen}
        now, best = build(chosen)["budget"]["used"], None
        for i, row, own, options in prepared:
            if i in taken:
                continue
            base = utility(row, own, i, intent, roles, paths, False)
            for option in options:
                used = build([*chosen, (i, row, own, option, 0)])["budget"]["used"]
                if used <= limit:
                    value = base * QUALITY[option[0]]
                    ratio = value / max(1, used - now)
                    if best is None or ratio > best[0]:
                        best = (ratio, (i, row, own, option, value))
        if best is None:
            break
        chosen.append(best[1])
    return build(chosen)


def violations(packet: dict) -> list[str]:
    """Rules that a packet breaks; none for a valid one."""
    out = []
    evidence = packet["evidence"]
    if [e["id"] for e in evidence] != [f"e{i}" for i in range(1, len(evidence) + 1)]:
        out.append("ids")
    if len({e["handle"] for e in evidence}) < len(evidence):
        out.append("handles")
    if any(e["fidelity"] not in QUALITY for e in evidence):
        out.append("fidelity")
    if any(e["location"]["lines"][0] < 1 or e["location"]["lines"][1] < e["location"]["lines"][0] for e in evidence):
        out.append("lines")
    if packet["budget"]["used"] > packet["budget"]["limit"]:
        out.append("budget")
    return out


def compact(packet: dict) -> dict:
    """The shorter wire form: paths in a dictionary by first appearance, rows by position."""
    paths = list(dict.fromkeys(e["location"]["path"] for e in packet["evidence"]))
    rows = [[e["handle"], e["role"], paths.index(e["location"]["path"]), *e["location"]["lines"], e["fidelity"], e["text"], e["why"]] for e in packet["evidence"]]
    return {**{k: packet[k] for k in ("revision", "intent", "mode", "budget")}, "schema": "evidence/2", "paths": paths, "rows": rows}


def expand_compact(wire: dict) -> dict:
    """The packet that ``compact`` took."""
    items = [{"id": f"e{i}", "handle": h, "role": r, "location": {"path": wire["paths"][p], "lines": [a, b]}, "fidelity": f, "text": x, "why": w} for i, (h, r, p, a, b, f, x, w) in enumerate(wire["rows"], 1)]
    return {"schema": "evidence/1", **{k: wire[k] for k in ("revision", "intent", "mode", "budget")}, "evidence": items}


def wire(packet: dict) -> str:
    """The compact form where it is strictly shorter, else the plain one."""
    text = lambda x: json.dumps(x, ensure_ascii=False, separators=(",", ":"))
    return min(text(packet), text(compact(packet)), key=len)


CANDIDATE = ("handle", "path", "language", "kind", "symbol", "signature", "start_line", "end_line", "content", "score", "relation", "reasons")
BUNDLE = "query_id long, position long, handle string, estimated_tokens long, elided boolean, budget long, omitted long"
PACKET = "query_id long, position long, handle string, role string, fidelity string, used long, budget_limit long, violations long"


def _rows(pdf: pd.DataFrame) -> list[dict]:
    rows = pdf.sort_values("position").to_dict("records")
    return [{**r, "reasons": [dict(x.asDict()) if hasattr(x, "asDict") else x for x in (r["reasons"] if r["reasons"] is not None else [])]} for r in rows]


def bundles(candidates: DataFrame, budget: int = 2048, mode: str = "source") -> DataFrame:
    """Packed items of each question; candidates: ``query_id, query, intent, position`` and the candidate's columns."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = _rows(pdf)
        items, omitted = pack(rows[0]["query"], [rows[0]["intent"]], rows, budget, mode)
        out = [(rows[0]["query_id"], i, x["handle"], x["estimated_tokens"], ELIDED in x["content"], clamp(budget), omitted) for i, x in enumerate(items, 1)]
        return pd.DataFrame(out, columns=[c.split(" ")[0] for c in BUNDLE.split(", ")])

    return candidates.groupBy("query_id").applyInPandas(one, BUNDLE)


def packets(candidates: DataFrame, budget: int = 2048, mode: str = "focused") -> DataFrame:
    """Evidence of each question; candidates as for ``bundles``, and ``terms array<string>``."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = _rows(pdf)
        packet = compile_packet(rows[0]["query"], rows[0]["intent"], list(rows[0]["terms"]), list(rows[0]["terms"]), rows, budget, mode)
        out = [(rows[0]["query_id"], i, e["handle"], e["role"], e["fidelity"], packet["budget"]["used"], packet["budget"]["limit"], len(violations(packet))) for i, e in enumerate(packet["evidence"], 1)]
        return pd.DataFrame(out, columns=[c.split(" ")[0] for c in PACKET.split(", ")])

    return candidates.groupBy("query_id").applyInPandas(one, PACKET)
