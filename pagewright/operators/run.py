"""Whole runs over captured responses, driven by the option records: from responses to artefacts, manifest, state and progress."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.functions import page as p
from pagewright.functions import url as u
from pagewright.operators import crawl, derive, scan
from pagewright.options import CrawlOptions, ScanOptions, parse_status_list
from pagewright.plans.workspace import Workspace
from pagewright.sources import archive


@dataclass(frozen=True)
class CrawlRun:
    state: DataFrame
    pages: DataFrame  # what was downloaded, derived
    manifest: DataFrame
    progress: DataFrame


def crawl_run(options: CrawlOptions, responses: DataFrame, ws: Workspace, state: DataFrame | None = None, saved: DataFrame | None = None) -> CrawlRun:
    """One run of the page archiver over responses (url, status, content_type, body, error; one row a URL).

    Without an earlier state the start URL is queued. With options.out, artefacts, manifest, progress and state are written
    there: a repeated run appends only pages that this run downloaded."""
    spark = responses.sparkSession
    scope = u.Scope.of(options.start)
    columns = tuple(F.lit(x) for x in (scope.host, scope.root, scope.prefix))
    # written first: it may have been read from the folder that this run replaces
    state = ws.save(crawl.seed_state(spark, scope, options.start) if state is None else state, "before")
    if odd := crawl.check_scope(state, scope.host).select("url").head(1):
        raise ValueError(f"the state is of another site: {odd[0]['url']}")
    if options.retry_failed:
        state = crawl.retry(state, ws)
    got = derive.fetched(responses.select("url"), responses).filter("ok")
    derived = ws.save(derive.derive(got.select("url", "html"), columns, options.exclude_url_regex, options.sample_chars), "pages")
    links = derived.select(F.col("url").alias("src"), F.posexplode("links").alias("pos", "dst"))
    after = crawl.crawl(state, responses, links, ws, parse_status_list(options.skip_http_status), options.exclude_url_regex, options.limit, saved, options.skip_failed, options.redownload)
    before = state.filter(F.col("status") == crawl.DONE).select("url")
    new = after.filter(F.col("status") == crawl.DONE).select("url").join(before, "url", "left_anti")
    pages = derived.join(new, "url", "left_semi")
    manifest = derive.manifest(pages, options.raw_html, options.content_html, options.zstd)
    report = crawl.progress(after)
    if options.out is not None:
        kinds = (*(["html"] if options.raw_html else []), *(["content"] if options.content_html else []), "md")
        archive.write_artefacts(pages, f"{options.out}/pages", kinds, options.zstd_level if options.zstd else None)
        archive.write_manifest(manifest, f"{options.out}/manifest")
        archive.write_state(after, f"{options.out}/state")
        report.write.mode("overwrite").json(f"{options.out}/progress")
    return CrawlRun(after, pages, manifest, report)


def scan_seeds(options: ScanOptions, pages: DataFrame, documents: DataFrame, ws: Workspace, lines: DataFrame | None = None) -> DataFrame:
    """url, enqueue_pos: the queue of the scan archiver from all its kinds of seeds, in their order: library items, a player given
    outright, image links of pages, a numeric template, a list (lines: pos, value, or the file that the options name; library pages in it are expanded), handles.
    pages: url, html; documents: url, body; captured ones."""
    spark = pages.sparkSession
    given = lambda urls: spark.createDataFrame(list(enumerate(urls)), "pos bigint, url string")
    at = lambda source, column: F.concat(F.array(F.lit(source)), column.cast("array<int>"))
    parts = []
    if options.item:
        parts.append(scan.library_tasks(given(options.item), pages, documents, ws).select(at(0, F.col("at")).alias("at"), "url"))
    if options.object_data is not None:
        player = spark.createDataFrame([(options.object_data, options.iip, options.image_dir)], "url string, iip string, image_dir string")
        parts.append(scan.of_players(player.select(F.lit(0).alias("player"), F.col("url").alias("object_data"), "iip", "image_dir"), documents).select(at(1, F.array("player", "pos")).alias("at"), "url"))
    if options.page:
        asked = given(options.page).join(pages.select("url", "html"), "url")
        parts.append(asked.select("pos", F.posexplode(p.image_links(F.col("html"), F.col("url"))).alias("nth", "link")).select(at(2, F.array("pos", "nth")).alias("at"), F.col("link").alias("url")))
    if options.url_template is not None:
        parts.append(scan.template_urls(spark, options.url_template, options.first, options.last, options.pad).select(at(3, F.array("pos")).alias("at"), "url"))
    if lines is None and options.url_list is not None:
        lines = archive.list_lines(spark, options.url_list)
    if lines is not None:
        listed = scan.list_urls(lines)
        parts.append(listed.filter(~F.col("library")).select(at(4, F.array("pos")).alias("at"), "url"))
        parts.append(scan.library_tasks(listed.filter("library").select("pos", "url"), pages, documents, ws).select(at(4, F.col("at")).alias("at"), "url"))
    if options.handle:
        parts.append(scan.library_tasks(given(options.handle), pages, documents, ws).select(at(5, F.col("at")).alias("at"), "url"))
    if not parts:
        raise ValueError("nothing to fetch: give items, a player, pages, a template, a list or handles")
    whole = reduce(DataFrame.unionByName, parts).groupBy("url").agg(F.min("at").alias("at"))
    return scan.numbered(whole, ["at"], "enqueue_pos", ws).select("url", "enqueue_pos")


def scan_run(options: ScanOptions, seeds: DataFrame, infos: DataFrame, responses: DataFrame, codecs: scan.Codecs, ws: Workspace, done: DataFrame | None = None) -> DataFrame:
    """Manifest records of a run of the scan archiver over its queue (seeds: url, enqueue_pos), with `error` where a task failed.

    done: urls of earlier runs, which are passed over unless the options say redownload. limit: the first so many tasks."""
    todo = seeds if done is None or options.redownload else seeds.join(done.select("url"), "url", "left_anti")
    if options.limit is not None:
        todo = todo.orderBy("enqueue_pos").limit(options.limit)
    made = ws.save(scan.process(todo.select("url"), infos, responses, codecs, options), "images")
    told = scan.scan_manifest(made, options.lossless, options.distance, options.min_bytes, options.keep_raw, options.jxl)
    return told.join(made.select("url", "transcoded", "raw", "jxl", "error"), "url").withColumn("ok", F.col("error").isNull())
