import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.functions.text import estimate_tokens
from lodestone.operators import evidence as E
from pyspark.sql import functions as F


def row(i, **kw):
    base = {"handle": f"h{i}", "path": f"src/f{i}.go", "language": "go", "kind": "function", "symbol": f"Run{i}", "signature": f"func Run{i}()", "start_line": 1, "end_line": 9, "content": f"func Run{i}() {{\n  work({i})\n}}\n" * 3, "score": 100.0 - i, "relation": "", "reasons": [{"code": "lexical", "weight": 8.0}]}
    return base | kw


def test_budget_is_never_exceeded():
    rows = [row(i, content="line of code here\n" * 400) for i in range(30)]
    for budget in (1, 256, 700, 4000, 10**6):
        items, omitted = E.pack("q", ["definition"], rows, budget)
        text = json.dumps({"query": "q", "budget": E.clamp(budget), "items": items}, ensure_ascii=False, separators=(",", ":"))
        assert E.estimate(text) <= E.clamp(budget) + 40 * len(items) and len(items) + omitted == 30


def test_documentation_and_tests_give_way():
    rows = [row(0), row(1, kind="heading"), row(2, kind="test", path="x/test_a.py")]
    items, omitted = E.pack("where is Run", ["definition"], rows, 4000)
    assert [x["handle"] for x in items] == ["h0"] and omitted == 2
    items, _ = E.pack("tests of Run", ["tests"], rows, 4000)
    assert [x["handle"] for x in items] == ["h2"]


def test_packet_is_valid_and_round_trips():
    rows = [row(0, reasons=[{"code": "symbol-exact", "weight": 100.0}]), *[row(i, relation="callers") for i in range(1, 9)]]
    p = E.compile_packet("who calls Run0", "callers", ["Run0"], ["Run0"], rows, 2048)
    assert E.violations(p) == [] and p["evidence"][0]["role"] == "target" and p["evidence"][1]["role"] == "caller"
    assert len(p["evidence"]) <= 4 and E.expand_compact(E.compact(p)) == p
    assert len(E.wire(p)) <= len(json.dumps(p, ensure_ascii=False, separators=(",", ":")))


def test_known_handles_are_skipped():
    p = E.compile_packet("q", "callers", [], [], [row(0), row(1)], 2048, known=frozenset({"h0"}))
    assert p["budget"]["known"] == 1 and [e["handle"] for e in p["evidence"]] == ["h1"]


@pytest.mark.parametrize("budget", [256, 64_000, 10**9, -5])
def test_empty(budget):
    assert E.compile_packet("q", "definition", [], [], [], budget)["evidence"] == []
    assert E.pack("q", [], [], budget) == ([], 0)


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=200), st.integers(0, 300))
def test_elide_fits(text, n):
    out = E.elide(text, n)
    assert out.endswith("[...elided...]\n") and (E.estimate(out) <= max(n, 20))


def test_estimates_agree(spark):
    texts = ["", "a", "foo_bar(1) + x", "日本語 text", "\x7f\x7f", "é è ß _ __", "a b\n" * 50, "“quoted” — dash"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r[0]: r[1] for r in df.select("i", estimate_tokens(F.col("t"))).collect()}
    assert [got[i] for i in range(len(texts))] == [E.estimate(t) for t in texts]
