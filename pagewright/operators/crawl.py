"""Breadth-first crawls over captured responses, and the crawl state as a table of URLs.

A crawl is a loop over levels of the page graph. Each level is one set-oriented step: the frontier meets the responses, links
of what was fetched are ordered by (place of the page, place of the link), links already seen go by an anti-join, the rest is
the next frontier. Each level's outcomes are written, so lineage stays short and a lost executor repeats one level at most.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions import url as u
from pagewright.plans.ranking import numbered
from pagewright.plans.workspace import Workspace

#: Levels whose tables are read side by side.
MOST_PARTS = 32
QUEUED, DONE, FAILED, SKIPPED = "queued", "downloaded", "failed", "skipped"


def outcome(status: Column, skip_status: tuple[int, ...] = (403,)) -> Column:
    """What a response's status makes of its URL; null status: the request itself failed."""
    return F.when(status.between(200, 299), DONE).when(status.isin(*skip_status) if skip_status else F.lit(False), SKIPPED).otherwise(FAILED)


def reason(url: Column, status: Column, error: Column) -> Column:
    return F.when(status.isNull(), F.coalesce(error, F.concat(F.lit("request failed: "), url))).when(~status.between(200, 299), F.concat(F.lit("HTTP "), status.cast("string"), F.lit(" for "), url))


def seed_state(spark, scope: u.Scope, start: str) -> DataFrame:
    """The state of a crawl that has not begun: its start URL, in normal form, queued."""
    one = spark.range(1).select(u.normalize_in(F.lit(start), scope).alias("url"))
    bad = F.raise_error(F.lit(f"not a page to crawl on {scope.host}: {start}"))
    return one.select(F.coalesce("url", bad).alias("url"), F.lit(QUEUED).alias("status"), F.lit(None).cast("string").alias("reason"), F.lit(0).cast("bigint").alias("enqueue_pos"))


def check_scope(state: DataFrame, scope_host: str) -> DataFrame:
    """URLs of a state that are of another host than the scope's, least place first (none: the state fits)."""
    return state.filter(u.host(F.col("url")) != scope_host).select("url", u.host(F.col("url")).alias("host")).orderBy("url")


def retry(state: DataFrame, ws: Workspace, known: tuple[str, ...] = (DONE, QUEUED)) -> DataFrame:
    """Failed URLs become queued again, behind the queue and in the order of their URLs; what is done or queued under another
    row of the state is not queued twice, and every failure is cleared."""
    held = state.filter(F.col("status").isin(*known)).select("url").distinct()
    again = state.filter(F.col("status") == FAILED).select("url").distinct().join(held, "url", "left_anti")
    tail = state.filter(F.col("status") == QUEUED).agg(F.coalesce(F.max("enqueue_pos") + 1, F.lit(0))).first()[0]
    back = numbered(again, ["url"], "enqueue_pos", ws, tail).select("url", F.lit(QUEUED).alias("status"), F.lit(None).cast("string").alias("reason"), "enqueue_pos")
    return state.filter(F.col("status") != FAILED).unionByName(back)


def crawl(
    state: DataFrame, responses: DataFrame, edges: DataFrame, ws: Workspace, skip_status: tuple[int, ...] = (403,), exclude: tuple[str, ...] = (), limit: int | None = None, saved: DataFrame | None = None, skip_failed: bool = False, redownload: bool = False,
) -> DataFrame:
    """The state after a run: url, status, reason, enqueue_pos (order of the queue, 0 first, over all runs).

    state: as from seed_state or an earlier run; responses: url, status, error, one row a URL (a missing one is a failed
    request); edges: src, pos, dst, the links of the pages in order. saved: urls whose artefacts exist; they count as done and
    not against the limit. limit: new pages of this run; whoever is before the page that would exceed it keeps its outcome.
    Queued URLs that an earlier row calls done or skipped (with skip_failed: or failed) leave the queue as they are; with
    redownload they are fetched again, and so are saved ones. What is fetched replaces its earlier row.

    Each level writes its own outcomes and the next queue only; what was seen is the union of those tables.
    """
    first = ws.save(state.select("url", "status", "reason", "enqueue_pos"), "state")
    if redownload:
        saved = None
    known_bad = F.lit(False) if redownload else F.col("status").isin(DONE, SKIPPED, *([FAILED] if skip_failed else []))
    queue = ws.save(first.filter(F.col("status") == QUEUED).join(first.filter(known_bad).select("url"), "url", "left_anti"), "queue")
    settled = [ws.save(first.filter(F.col("status") != QUEUED).join(queue.select("url"), "url", "left_anti"), "settled")]
    top = first.agg(F.max("enqueue_pos")).first()[0] or 0
    room = limit
    while True:
        if queue.isEmpty() or room is not None and room <= 0 and saved is None:
            break
        known = saved.select("url", F.lit(True).alias("saved")).distinct() if saved is not None else queue.select("url", F.lit(False).alias("saved"))
        met = queue.join(responses.select("url", F.col("status").alias("http"), "error"), "url", "left").join(known, "url", "left").withColumn("saved", F.coalesce("saved", F.lit(False)))
        banned = u.excluded_by(F.col("url"), exclude)
        after = F.when(banned.isNotNull(), SKIPPED).when(F.col("saved"), DONE).otherwise(outcome(F.col("http"), skip_status))
        why = F.when(banned.isNotNull(), F.concat(F.lit("excluded by pattern: "), banned)).when(F.col("saved"), None).otherwise(reason(F.col("url"), F.col("http"), F.col("error")))
        fetch = banned.isNull() & ~F.col("saved")
        judged = met.select("url", "enqueue_pos", after.alias("status"), why.alias("reason"), fetch.alias("fetch"), ((after == DONE) & fetch).cast("int").alias("new"))
        if room is not None:  # the first fetch behind the last page that the limit lets in ends the run; it and the rest stay queued
            judged = ws.save(judged, "outcomes")
            last = judged.filter("new = 1").select("enqueue_pos").orderBy("enqueue_pos").limit(max(room, 0)).agg(F.count("*").alias("n"), F.max("enqueue_pos").alias("at")).first()
            if last["n"] == room:
                cut = judged.filter(F.col("fetch") & (F.col("enqueue_pos") > (last["at"] if room else -1))).agg(F.min("enqueue_pos")).first()[0]
                stays = F.lit(False) if cut is None else F.col("enqueue_pos") >= cut
                judged = judged.withColumn("reason", F.when(~stays, F.col("reason"))).withColumn("new", F.when(~stays, F.col("new"))).withColumn("status", F.when(stays, QUEUED).otherwise(F.col("status")))
        judged = ws.save(judged.select("url", "status", "reason", "enqueue_pos", "new"), "level")
        rows = judged.drop("new")
        settled.append(rows.filter(F.col("status") != QUEUED))
        stopped = rows.filter(F.col("status") == QUEUED)
        done = judged.filter(F.col("status") == DONE)
        seen = reduce(DataFrame.unionByName, (part.select("url") for part in (*settled, stopped)))
        fresh = done.select(F.col("url").alias("src"), "enqueue_pos").join(edges, "src").groupBy("dst").agg(F.min(F.struct("enqueue_pos", "pos")).alias("at")).withColumnRenamed("dst", "url").join(seen, "url", "left_anti")
        placed = numbered(fresh.select("url", F.col("at.enqueue_pos").alias("page"), F.col("at.pos").alias("link")), ["page", "link"], "enqueue_pos", ws, top + 1)
        queued = placed.select("url", F.lit(QUEUED).alias("status"), F.lit(None).cast("string").alias("reason"), "enqueue_pos")
        queue = ws.save(stopped.unionByName(queued), "queue")
        top += placed.count()
        if room is not None:
            room -= judged.filter((F.col("status") == DONE) & (F.col("new") == 1)).count()
            if not stopped.isEmpty():
                break
        if len(settled) >= MOST_PARTS:  # a plan of few parts; what is merged is written once in so many levels
            settled = [ws.save(reduce(DataFrame.unionByName, settled), "settled")]
    return reduce(DataFrame.unionByName, (*settled, queue))


def progress(state: DataFrame, last_url: str | None = None) -> DataFrame:
    """One row: counters, the frontier's size and the share of it that is done, and the line that reports them."""
    n = lambda s: F.count_if(F.col("status") == s)
    counts = state.agg(n(DONE).alias("downloaded"), n(QUEUED).alias("queued"), F.count("*").alias("seen"), n(FAILED).alias("failed"), n(SKIPPED).alias("skipped"))
    total = counts.withColumn("frontier_total", F.greatest(F.col("seen"), F.col("downloaded") + F.col("queued")))
    share = total.withColumn("frontier_percent", F.when(F.col("frontier_total") == 0, 100.0).otherwise(F.col("downloaded") * 100.0 / F.greatest(F.col("frontier_total"), F.lit(1))))
    line = F.format_string("progress: %d/%d frontier (%.2f%%), queue=%d, seen=%d, failed=%d, skipped=%d", "downloaded", "frontier_total", "frontier_percent", "queued", "seen", "failed", "skipped")
    return share.withColumn("last_url", F.lit(last_url).cast("string")).withColumn("line", line)


def due(nth: Column, every: int, always_below_two: bool = True) -> Column:
    """Whether the nth processed URL is one after which a checkpoint (or, with 0 for never, a progress line) is due."""
    if every <= 1 and always_below_two:
        return F.lit(True)
    return F.lit(False) if every <= 0 else nth % every == 0


def already_saved(urls: DataFrame, artefacts: DataFrame, kinds: tuple[str, ...] = ("raw", "content_html", "markdown"), any_of: bool = False) -> DataFrame:
    """URLs whose file stem has all (or any) of the kinds of artefacts. Stems decide, so URLs that share one share the answer.

    urls: url, file_stem; artefacts: file_stem, kind."""
    have = artefacts.filter(F.col("kind").isin(*kinds)).groupBy("file_stem").agg(F.count_distinct("kind").alias("n"))
    return urls.join(have.filter(F.col("n") >= (1 if any_of else len(kinds))), "file_stem", "left_semi")


def merge(*states: DataFrame) -> DataFrame:
    """One row a URL of several states: done beats skipped, failed and queued, in this order; first place of the queue."""
    rank = F.array_position(F.array(*(F.lit(s) for s in (DONE, SKIPPED, FAILED, QUEUED))), F.col("status"))
    whole = states[0].select("url", "status", "reason", "enqueue_pos")
    for s in states[1:]:
        whole = whole.unionByName(s.select("url", "status", "reason", "enqueue_pos"))
    best = F.min(F.struct(rank.alias("rank"), "status", "reason")).alias("best")
    return whole.groupBy("url").agg(best, F.min("enqueue_pos").alias("enqueue_pos")).select("url", "best.status", "best.reason", "enqueue_pos")
