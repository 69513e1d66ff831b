"""Joins in which one key may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot beyond this part of all rows (so there are at most so many hot keys) and this number of rows.
PART, LEAST = 1000, 4096
SALTS = 64


def spread_join(left: DataFrame, right: DataFrame, on: list[str], counts: DataFrame, how: str = "left") -> DataFrame:
    """left joined with right (one row a key) on `on`, hot keys of left dealt over SALTS tasks.

    counts: the key and n, the rows of left that have it. Hot keys are at most PART rows, so they are broadcast; right's rows
    of them are repeated once a salt. Rows of left get salts by their place, which a retried task finds the same.
    """
    total = counts.agg(F.sum("n")).first()[0] or 0
    hot = counts.filter(F.col("n") > max(LEAST, total // PART)).select(*on, F.lit(SALTS).alias("_salts"))
    if not hot.head(1):
        return left.join(right, on, how)
    salted = left.withColumn("_place", F.monotonically_increasing_id()).join(F.broadcast(hot), on, "left").withColumn("_salt", F.when(F.col("_salts").isNull(), F.lit(0)).otherwise(F.pmod("_place", F.lit(SALTS)).cast("int"))).drop("_salts", "_place")
    wide = right.join(F.broadcast(hot), on, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1))).drop("_salts")
    return salted.join(wide, [*on, "_salt"], how).drop("_salt")
