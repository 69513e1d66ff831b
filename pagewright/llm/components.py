"""Connected components of an edge table: union-find where it is small, alternating stars where it is not."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.plans.workspace import Workspace

#: Edges that one task may join; beyond it, the table is contracted by stars.
MOST_EDGES = 1 << 18


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges: u > v, both ways of looking at an edge are made here. Large star: every larger neighbour of a node goes to the
    node's least neighbour; small star: the node and its smaller neighbours do."""
    if large:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = both.join(least, "u")
    moved = joined.filter(F.col("v") > F.col("u") if large else F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not large:
        moved = moved.unionByName(least.select("u", F.col("m").alias("v")))
    ordered = moved.filter(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    return ordered.distinct()


def _union_find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parent: dict = {}

    def root(x):
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent[up]
            x = parent[x]
        return x

    schema = None
    for batch in batches:
        schema = schema or batch.schema
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    if parent:
        nodes = list(parent)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, schema.types[0]), pa.array([root(x) for x in nodes], schema.types[0])], ["node", "component"])


def components(edges: DataFrame, ws: Workspace, rounds: int = 60, most_edges: int = MOST_EDGES) -> DataFrame:
    """(node, component): the least node that each node of an edge reaches; edges are columns a, b of any ordered type.

    A table of at most most_edges edges is one task's work. Beyond it, each round is two joins of narrow tables and is
    written, so that lineage stays short. Nodes without edges have no row.
    Empty edges give an empty table. Nulls and loops are left out.
    """
    now = ws.save(edges.filter("a is not null and b is not null and a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    if now.count() <= most_edges:
        kind = now.schema["u"].dataType.simpleString()
        return now.coalesce(1).mapInArrow(_union_find, f"node {kind}, component {kind}")
    mark = None
    for _ in range(rounds):
        after = ws.save(_star(_star(now, True), False), "stars")
        sign = after.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        ws.drop(now)
        now = after
        if sign == mark:
            break
        mark = sign
    else:
        raise RuntimeError("components did not settle")
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
