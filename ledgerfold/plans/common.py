"""Helpers shared by catalogue queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Parameters for the test binding: the reference floor of
# 500,000 would drop every contract of the test data (max price ~105,000).
TEST_MIN_CONTRACT_VALUE = 50_000.0


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every floating column (oracle comparison on both sides)."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            out.append(F.round(F.col(f"`{f.name}`").cast("double"), digits).alias(f.name))
        else:
            out.append(F.col(f"`{f.name}`"))
    return df.select(out)
