"""What the registered queries without an oracle are given."""

from lodestone.plans import catalog

SF = "/root/testdata/sf0.001"


def test_every_fused_file_is_a_candidate(spark):
    """No file that fusion kept is left out before the greedy steps, and a question's candidates have one order."""
    rows = catalog.chunk_candidates(spark, SF).select("query_id", "path", "position").collect()
    assert {(r["query_id"], r["path"]) for r in rows} == {(r["query_id"], r["handle"]) for r in catalog.fused(spark, SF).collect()}
    assert len({(r["query_id"], r["position"]) for r in rows}) == len(rows)


def test_spans_have_one_order(spark):
    rows = catalog.span_dedupe(spark, SF).select("query_id", "position").collect()
    assert len(set(rows)) == len(rows)
