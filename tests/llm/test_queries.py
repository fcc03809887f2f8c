"""Registered training-data queries against their SQL, on the smallest tables."""

import os

import pytest
from plain_compare import differences

from foliant.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    assert not differences(spark, SF, queries.QUERIES[name], queries.ORACLES[name])


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no tables")
def test_op10_on_held_out_labels(spark):
    """The registered query, judged on labels that it never learned from."""
    sf = "/root/testdata/sf0.01"
    truth = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = queries.QUERIES["op10_quality_classifier"](spark, sf).collect()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    held = [(r["score"], r["predicted"], truth[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in truth]
    good, bad = ([s for s, _, y in held if y == k] for k in (1, 0))
    auc = sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))
    assert len(held) > 30 and auc > 0.95 and sum(p == y for _, p, y in held) / len(held) > 0.9
