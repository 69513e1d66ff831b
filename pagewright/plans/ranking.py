"""Row numbers over a whole table without one task that sorts it all."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.plans.workspace import Workspace


def numbered(df: DataFrame, order: list[str], name: str, ws: Workspace, start: int = 0) -> DataFrame:
    """df with `name`: start, start + 1 ... in the order of the columns (ties in any order).

    Rows are range partitioned and sorted where they are; a number is the place in the partition plus the sizes of the
    partitions before it, of which the driver holds one a partition.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = ws.save(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("_place", 33)
    offsets, at = [], start
    for r in placed.groupBy(part.alias("part")).count().orderBy("part").collect():
        offsets += [F.lit(r["part"]).cast("bigint"), F.lit(at).cast("bigint")]
        at += r["count"]
    base = F.element_at(F.create_map(*offsets), part) if offsets else F.lit(start)
    return placed.withColumn(name, (base + F.col("_place").bitwiseAND((1 << 33) - 1)).cast("bigint")).drop("_place")
