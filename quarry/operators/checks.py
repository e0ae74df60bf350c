"""Row-count expectations that fail the job loudly, evaluated in-plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def expect_rows(df: DataFrame, expected: int, label: str = "rows") -> DataFrame:
    """Fail when ``df`` does not have exactly ``expected`` rows, none included.

    The count is checked on its own one-row aggregate, which adds no row to the result, so
    an empty input is checked like any other and the check runs in the consumer's job.
    """
    failed = F.concat(F.lit(f"expected {expected} {label}, found "), F.col("n").cast("string"))
    check = (df.agg(F.count(F.lit(1)).alias("n"))
             .where(F.when(F.col("n") == expected, F.lit(False)).otherwise(F.raise_error(failed).isNotNull())))
    return df.unionByName(check.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema.fields]))
