"""Names of queries promise what the queries give."""

from __future__ import annotations

from collections import Counter

from bindwell.plans import registry


def test_examples_are_bindings_and_counts_are_called_counts(spark):
    assert "quality_flag_counts" in registry.QUERIES
    assert registry.QUERIES.keys() >= registry.ORACLES.keys()
    rows = registry.QUERIES["quality_examples"](spark, "/root/testdata/sf0.001").collect()
    assert {"msisdn", "imsi", "imei", "category", "history"} <= set(rows[0].asDict())
    assert max(Counter(r["category"] for r in rows).values()) == 5 and any(r["history"] for r in rows)
