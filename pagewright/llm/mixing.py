"""Sources mixed to target weights by entropy balancing.

For each source the rates r of its documents are as near to one copy each (in relative entropy) as the token constraint
sum(r * size) = target and the ceiling of COPIES copies let them be. The convex dual has one multiplier a source; its
solution tilts the rates exponentially in the size, r = min(COPIES, exp(lambda * size / mean size)). The multipliers of all
sources are found at once by distributed Newton steps over the (source, size) histogram, each kept inside a bracket that is
halved where a step would leave it.

Rates become whole copies in two steps. Per source, from the largest size to the smallest, each histogram cell gets the whole
number of copies that brings the running total nearest to the ideal one, so what a cell misses the next ones make good. Inside
a cell, copies go to documents by the order of a hash, in buckets of about BUCKET documents, so that a group of equal
documents, however large, is spread over many tasks. The result depends on the rows alone, not on their partitions.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagewright.plans.ranking import numbered
from pagewright.plans.skew import spread_join
from pagewright.plans.workspace import Workspace

COPIES = 3
BUCKET = 256
#: Rows of the table of sources that may be broadcast; beyond it, it is joined.
MOST_BROADCAST = 10_000
STEPS, TOLERANCE = 60, 1e-9
WEIGHTS = (5.0, 2.0, 1.0)


def count_words(text: Column) -> Column:
    """Number of runs of characters other than space and 0x09-0x0D; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("bigint")


def targets(sources: DataFrame, ws: Workspace, weights: tuple[float, ...] = WEIGHTS, copies: int = COPIES) -> DataFrame:
    """source, source_size, target: shares of the whole size by weight, none above `copies` times its source's size.

    sources: source, source_size, one row a source, however many. Weights repeat along the sources by code point, null last.
    What a capped source cannot take goes to the others by weight, again and again until none is above: each time is one
    aggregation over the sources, and a source that is capped stays so, since the others' level only rises.
    """
    ordered = sources.withColumn("_null", F.col("source").isNull()).withColumn("_code", F.coalesce(F.col("source"), F.lit("")).cast("binary"))
    listed = F.array(*(F.lit(float(w)) for w in weights))
    ranked = numbered(ordered, ["_null", "_code"], "_nth", ws).select("source", "source_size", F.element_at(listed, (F.col("_nth") % len(weights) + 1).cast("int")).alias("weight"), (F.col("source_size") * float(copies)).alias("room"))
    ranked = ws.save(ranked, "weighted")
    total = float(ranked.agg(F.sum("source_size")).first()[0] or 0)
    level, capped = -1.0, -1
    while True:
        full = F.col("room") < F.lit(level) * F.col("weight")
        sums = ranked.agg(F.count_if(full).alias("n"), F.sum(F.when(full, F.col("room"))).alias("room"), F.sum(F.when(~full, F.col("weight"))).alias("weight")).first()
        if sums["n"] == capped or not sums["weight"]:
            break
        level, capped = (total - (sums["room"] or 0.0)) / sums["weight"], sums["n"]
    return ranked.select("source", "source_size", F.least(F.col("room"), F.lit(max(level, 0.0)) * F.col("weight")).alias("target"))


def _multipliers(cells: DataFrame, goals: DataFrame, ws: Workspace, copies: int) -> DataFrame:
    """source, lam, mean: the dual solution, by Newton steps in a bracket. cells: source, size > 0, n."""
    state = ws.save(
        goals.filter("source_size > 0").join(cells.groupBy("source").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean"), F.min("size").alias("least")), "source")
        .select("source", "target", "mean", F.lit(0.0).alias("lam"), (F.lit(-745.0) * F.col("mean") / F.col("least")).alias("low"), (F.log(F.lit(float(copies))) * F.col("mean") / F.col("least")).alias("high"))
        .withColumn("error", F.lit(float("inf"))),
        "multipliers",
    )
    small = state.count() <= MOST_BROADCAST
    for _ in range(STEPS):
        side = F.broadcast(state) if small else state
        at = cells.alias("c").join(side.alias("s"), F.col("c.source") == F.col("s.source"))
        x = F.col("c.size") / F.col("s.mean")
        rate = F.exp(F.least(F.col("s.lam") * x, F.lit(700.0)))
        mass = F.col("c.n") * F.col("c.size")
        sums = at.groupBy(F.col("s.source").alias("source")).agg(
            *(F.first(f"s.{c}").alias(c) for c in ("target", "mean", "lam", "low", "high")), F.sum(mass * F.least(rate, F.lit(float(copies)))).alias("got"), F.sum(F.when(rate < copies, mass * x * rate).otherwise(0.0)).alias("slope")
        )
        gap = F.col("got") - F.col("target")
        bracket = sums.withColumn("low", F.when(gap < 0, F.col("lam")).otherwise(F.col("low"))).withColumn("high", F.when(gap >= 0, F.col("lam")).otherwise(F.col("high")))
        step = F.when(F.col("slope") > 0, F.col("lam") - gap / F.col("slope"))
        moved = bracket.withColumn("next", F.when((step > F.col("low")) & (step < F.col("high")), step).otherwise((F.col("low") + F.col("high")) / 2))
        error = F.abs(gap) / F.greatest(F.col("target"), F.lit(1.0))
        done = error <= TOLERANCE
        after = ws.save(moved.select("source", "target", "mean", F.when(done, F.col("lam")).otherwise(F.col("next")).alias("lam"), "low", "high", error.alias("error")), "multipliers")
        ws.drop(state)
        state = after
        if (state.agg(F.max("error")).first()[0] or 0.0) <= TOLERANCE:
            break
    return state.select("source", "lam", "mean")


def _whole_copies(copies: int):
    """cell_copies of cells that come sorted by source and falling size: the whole number that brings the source's running
    total nearest to the ideal one. A source's total is carried from batch to batch, so only a batch is held."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, ideal, got = None, 0.0, 0
        for batch in batches:
            takes = []
            for k, size, n, rate in zip(batch["k"], batch["size"], batch["n"], batch["rate"], strict=True):
                if k != now:
                    now, ideal, got = k, 0.0, 0
                ideal += n * rate * size
                takes.append(max(0, min(round((ideal - got) / size), n * copies)))
                got += takes[-1] * size
            yield batch.assign(cell_copies=takes)

    return run


def mix(docs: DataFrame, ws: Workspace, weights: tuple[float, ...] = WEIGHTS, copies: int = COPIES) -> DataFrame:
    """doc_id, source, size, source_size, target, rate, copies, taken for each row of docs (doc_id, source, text).

    size is the number of words, null text: 0; targets() says what each source should give. taken = copies * size, copies is
    0 to `copies`. Documents without words get a copy each: they change no total. The null source is a source of its own,
    last in order. Rows that repeat another get copies one by one. Other columns are ignored; no rows, no result.
    """
    rows = ws.save(docs.select("doc_id", "source", count_words(F.col("text")).alias("size"), F.xxhash64("doc_id", "text").alias("h")), "sizes")
    keyed = rows.withColumn("k", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")))
    cells = ws.save(keyed.groupBy("k", "size").agg(F.count("*").alias("n"), F.first("source").alias("source")), "cells")
    goals = ws.save(targets(cells.groupBy("k").agg(F.first("source").alias("source"), F.sum(F.col("n") * F.col("size")).alias("source_size")).drop("k"), ws, weights, copies).withColumn("k", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))), "targets")
    by_key = cells.filter("size > 0").select(F.col("k").alias("source"), "size", "n")
    lam = _multipliers(by_key, goals.select(F.col("k").alias("source"), "source_size", "target"), ws, copies).withColumnRenamed("source", "k")
    rated = cells.filter("size > 0").select("k", "size", "n").join(goals.select("k", "target"), "k").join(lam, "k")
    rate = F.least(F.exp(F.least(F.col("lam") * F.col("size") / F.col("mean"), F.lit(700.0))), F.lit(float(copies)))
    # a source's cells (one a distinct size) from the largest size on; the running total follows the ideal one
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    along = rated.select("k", "size", "n", rate.alias("rate")).repartition(parts, "k").sortWithinPartitions("k", F.desc("size"))
    given = ws.save(along.mapInPandas(_whole_copies(copies), "k string, size bigint, n bigint, rate double, cell_copies bigint"), "cell-copies")
    placed = spread_join(keyed, given, ["k", "size"], cells.select("k", "size", "n")).withColumn("bucket", F.pmod("h", F.when(F.col("size") == 0, F.lit(1 << 20)).otherwise(F.ceil(F.coalesce("n", F.lit(1)) / BUCKET))))
    dealt = placed.repartition("k", "size", "bucket")
    inside = Window.partitionBy("k", "size", "bucket")
    members = F.count("*").over(inside)
    lot = F.pmod(F.xxhash64("k", "size", "bucket", F.lit(11)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    share = F.when(members == F.col("n"), F.col("cell_copies")).otherwise(F.least(F.floor(F.col("cell_copies") * members / F.col("n") + lot), members * copies))
    ranked = dealt.withColumn("share", share.cast("bigint")).withColumn("members", members).withColumn("nth", F.row_number().over(inside.orderBy("h", "doc_id")))
    got = F.when(F.col("size") == 0, F.lit(1)).otherwise(F.floor(F.col("share") / F.col("members")) + F.when(F.col("nth") <= F.pmod("share", "members"), 1).otherwise(0)).cast("bigint")
    side = goals.select("k", "source_size", "target")
    out = ranked.withColumn("copies", got).join(F.broadcast(side) if goals.count() <= MOST_BROADCAST else side, "k")
    return out.select("doc_id", "source", "size", F.col("source_size").cast("bigint").alias("source_size"), "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"))
