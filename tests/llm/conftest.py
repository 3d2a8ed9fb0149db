import pytest
from pyspark.sql import functions as F


@pytest.fixture
def with_extras():
    """Adds columns whose names the operators use inside."""

    def add(df):
        names = ["n", "u", "key", "ids", "rank", "size", "copies", "vec", "dim", "node", "component", "fp", "gram",
                 "score", "spans", "link", "start", "block", "tie", "w", "part", "lead", "pivot", "home", "bucket"]
        return df.select("*", *(F.lit("x").alias(c) for c in names if c not in df.columns))

    return add
