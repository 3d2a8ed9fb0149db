"""Joins of the collect job never trust a size estimate."""

import pytest

from evalspark import plans


@pytest.mark.parametrize("name", ["collect_facts", "resolve_n_shot", "collect_shapes", "collect_audit"])
def test_no_table_is_broadcast_by_an_estimate(spark, name):
    """Nothing measured is small enough to be broadcast here, and whatever is broadcast all the same is too large."""
    limits = {"spark.sql.autoBroadcastJoinThreshold": "10m", "spark.sql.adaptive.autoBroadcastJoinThreshold": "0",
              "spark.sql.maxBroadcastTableSize": "1k"}
    before = {k: spark.conf.get(k, None) for k in limits}
    try:
        for k, v in limits.items():
            spark.conf.set(k, v)
        assert plans.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0
        assert {k: spark.conf.get(k) for k in limits} == limits
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
