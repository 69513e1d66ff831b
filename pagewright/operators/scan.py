"""Scan archives: seeds of the queue, tile plans, stitched rasters, manifests."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.functions import page as p
from pagewright.functions import url as u
from pagewright.functions import viewers as v
from pagewright.options import ScanOptions
from pagewright.plans.ranking import numbered
from pagewright.plans.workspace import Workspace


def template_urls(spark: SparkSession, template: str, first: int, last: int, pad: int = 0) -> DataFrame:
    """pos, url for every number of the range ({n} in the template), zero-padded; longer numbers are not cut."""
    rows = spark.range(first, max(last, first - 1) + 1)
    number = F.format_string(f"%0{pad}d", "id") if pad > 0 else F.col("id").cast("string")
    return rows.select((F.col("id") - first).alias("pos"), F.replace(F.lit(template), F.lit("{n}"), number).alias("url"))


def list_urls(lines: DataFrame) -> DataFrame:
    """pos, url, library of a list's lines (pos, value): trimmed, without blank ones and # comments; library: to be expanded."""
    value = F.trim(F.regexp_replace("value", "(?U)^\\s+|\\s+$", ""))
    return lines.select("pos", value.alias("url")).filter((F.col("url") != "") & ~F.startswith("url", F.lit("#"))).withColumn("library", v.is_library_page(F.col("url")))


def seed_union(ws: Workspace, *sources: DataFrame) -> DataFrame:
    """url, enqueue_pos of ordered sources (pos, url): the first place of each URL, in the order of sources and places."""
    whole = reduce(DataFrame.unionByName, (s.select(F.lit(i).alias("source"), F.col("pos").cast("bigint").alias("pos"), "url") for i, s in enumerate(sources)))
    first = whole.groupBy("url").agg(F.min(F.struct("source", "pos")).alias("at")).select("url", "at.source", "at.pos")
    return numbered(first, ["source", "pos"], "enqueue_pos", ws).select("url", "enqueue_pos")


def of_players(players: DataFrame, documents: DataFrame) -> DataFrame:
    """players (object_data, iip, image_dir, and more) with pos, url: info addresses of all pages of their objectData documents
    (url, body as text)."""
    files = documents.select(F.col("url").alias("object_data"), F.posexplode(v.page_files(F.col("body"))).alias("pos", "file"))
    return players.join(files, "object_data").withColumn("url", v.info_url(F.col("iip"), F.col("image_dir"), F.col("file"))).drop("file")


def player_pages(pages: DataFrame, documents: DataFrame) -> DataFrame:
    """page_url, player, pos, url: info addresses of all pages of the players on pages (url, html)."""
    found = pages.select(F.col("url").alias("page_url"), F.posexplode(v.players(F.col("html"))).alias("player", "p")).select("page_url", "player", "p.*")
    return of_players(found, documents).select("page_url", "player", "pos", "url")


def collection_pages(roots: DataFrame, pages: DataFrame, ws: Workspace, levels: int = 10_000) -> DataFrame:
    """root, url, level, at of the item pages under each of the collections (roots: url). pages: url, html, the captured ones.

    A collection's listing pages are followed breadth first, each once, so listings that point at each other end; if they do
    not within `levels`, that is an error. A link is resolved against the collection's own URL, links with a # are left out, a
    listing that was not captured has no items. at: the item's place, by level, then along the listings (arrays compare)."""
    root = F.col("root")
    frontier = ws.save(roots.select(F.col("url").alias("root"), "url", F.array().cast("array<int>").alias("path")), "frontier")
    visited = listed = None
    for level in range(levels):
        hrefs = F.filter(p.hrefs(F.col("html")), lambda h: ~F.contains(h, F.lit("#")))
        targets = F.transform(hrefs, lambda h: u.resolve(root, h))
        links = ws.save(frontier.join(pages.select("url", "html"), "url").select("root", "path", F.posexplode(targets).alias("pos", "dst")).filter("dst is not null"), "links")
        here = links.select("root", "dst", F.lit(level).alias("level"), F.concat(F.array(F.lit(level)), "path", F.array("pos")).alias("at"))
        listed = here if listed is None else listed.unionByName(here)
        visited = frontier.select("root", "url") if visited is None else visited.unionByName(frontier.select("root", "url"))
        fresh = links.filter(u.is_pagination(F.col("dst"), root)).groupBy("root", F.col("dst").alias("url")).agg(F.min(F.concat("path", F.array("pos"))).alias("path"))
        frontier = ws.save(fresh.join(visited, ["root", "url"], "left_anti"), "frontier")
        if frontier.isEmpty():
            break
    else:
        raise RuntimeError(f"listings go on after {levels} levels")
    own = (u.path(F.col("dst")) == u.path(root)) | u.query(F.col("dst")).isNotNull()  # itself, listings, filters
    return listed.filter(u.is_item(F.col("dst")) & ~own).groupBy("root", F.col("dst").alias("url")).agg(F.min("level").alias("level"), F.min("at").alias("at"))


def collection_items(start: str, pages: DataFrame, ws: Workspace, levels: int = 10_000) -> DataFrame:
    """url, level of the item pages under one collection."""
    return collection_pages(pages.sparkSession.createDataFrame([(start,)], "url string"), pages, ws, levels).select("url", "level")


def library_tasks(starts: DataFrame, pages: DataFrame, documents: DataFrame, ws: Workspace, rounds: int = 100) -> DataFrame:
    """at, url of the scan tasks that library pages lead to, in the order in which one walk would find them (at: an array).

    starts: pos, url; pages: url, html, documents: url, body, what was captured. A page is seeded from the first that applies:
    its players (all pages of their objectData), its safe-view count, the items of its collection, the viewer that its button
    opens. Items and viewers are pages again, in rounds; a page is expanded once. Pages that were not captured, or lead
    nowhere, give no task."""
    todo = ws.save(starts.groupBy("url").agg(F.min(F.array(F.col("pos").cast("int"))).alias("at")), "todo")
    seen, tasks = todo.select("url"), []
    for _ in range(rounds):
        if todo.isEmpty():
            break
        kinds = ws.save(todo.join(pages.select("url", "html"), "url").withColumn("kind", v.page_kind(F.col("url"), F.col("html"))), "kinds")
        of = lambda kind: kinds.filter(F.col("kind") == kind)  # noqa: B023, E731
        shown = player_pages(of("players").select("url", "html"), documents).select(F.col("page_url").alias("page"), F.array("player", "pos").alias("next"), "url")
        viewed = of("safe_view").select(F.col("url").alias("page"), F.posexplode(v.safe_view_pages(F.col("html"), F.col("url"))).alias("pos", "url")).select("page", F.array("pos").alias("next"), "url")
        found = shown.unionByName(viewed).join(kinds.select(F.col("url").alias("page"), "at"), "page").select(F.concat("at", "next").alias("at"), "url")
        tasks.append(ws.save(found, "tasks"))
        items = collection_pages(of("collection").select("url"), pages, ws).select(F.col("root").alias("page"), F.col("at").alias("next"), "url")
        viewers = of("item").select(F.col("url").alias("page"), F.array(F.lit(0)).alias("next"), v.viewer_link(F.col("html"), F.col("url")).alias("url")).filter("url is not null")
        onward = items.unionByName(viewers).join(kinds.select(F.col("url").alias("page"), "at"), "page").groupBy("url").agg(F.min(F.concat("at", "next")).alias("at"))
        todo = ws.save(onward.join(seen, "url", "left_anti"), "todo")
        seen = seen.unionByName(todo.select("url"))
    else:
        raise RuntimeError(f"library pages go on after {rounds} rounds")
    whole = reduce(DataFrame.unionByName, tasks) if tasks else pages.sparkSession.createDataFrame([], "at array<int>, url string")
    return whole.groupBy("url").agg(F.min("at").alias("at")).select("at", "url")


def tiles(images: DataFrame, tile: int = 1024) -> DataFrame:
    """images (base, width, height) with x, y, w, h and url of each tile, row by row; edge tiles are clipped. Tiles are of 64
    pixels at least. An empty image has no tiles."""
    size = max(tile, 64)
    start = lambda c: F.when(c > 0, F.sequence(F.lit(0).cast("bigint"), c.cast("bigint") - 1, F.lit(size).cast("bigint")))
    rows = images.withColumn("y", F.explode(start(F.col("height")))).withColumn("x", F.explode(start(F.col("width"))))
    cut = rows.withColumn("w", F.least(F.lit(size), F.col("width") - F.col("x"))).withColumn("h", F.least(F.lit(size), F.col("height") - F.col("y")))
    return cut.withColumn("url", v.tile_url(F.col("base"), F.col("x"), F.col("y"), F.col("w"), F.col("h")))


def blit(canvas: np.ndarray, piece: np.ndarray, x: int, y: int) -> None:
    """Copy a raster onto a canvas (rows, columns, channels), what lies outside cut off."""
    top, left, bottom, right = max(y, 0), max(x, 0), min(y + piece.shape[0], canvas.shape[0]), min(x + piece.shape[1], canvas.shape[1])
    if top < bottom and left < right:
        canvas[top:bottom, left:right] = piece[top - y : bottom - y, left - x : right - x]


def _stitch(key, rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One image at a time: its pieces come in order, in batches, and only the canvas is held."""
    canvas = None
    for batch in rows:
        for r in batch.itertuples():
            if canvas is None:
                canvas = np.zeros((int(r.height), int(r.width), 3), np.uint8)
            blit(canvas, np.frombuffer(r.data, np.uint8).reshape(int(r.h), int(r.w), 3), int(r.x), int(r.y))
    if canvas is not None:
        yield pd.DataFrame({"base": [key[0]], "width": [canvas.shape[1]], "height": [canvas.shape[0]], "data": [canvas.tobytes()]})


def stitch(pieces: DataFrame) -> DataFrame:
    """base, width, height, data (RGB rows) from pieces (base, width, height, x, y, w, h, data); the later of two pieces that
    overlap (by row, then column) wins. An image is one row, so its pieces meet in one task."""

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        return next(_stitch((pdf["base"].iloc[0],), iter([pdf.sort_values(["y", "x"], kind="stable")])))

    return pieces.groupBy("base").applyInPandas(whole, "base string, width int, height int, data binary")


def frames(tasks: DataFrame, infos: DataFrame, tile: int = 1024, full_res: bool = True) -> DataFrame:
    """task, frame, x, y, width, height: the images to fetch for each scan task (url) and where they stand.

    A direct task is its own frame. A IIIF task's info.json (infos: url, body) says the size: it is cut into tiles or, without
    full_res, asked for as one frame. Without a readable info.json there is no frame."""
    url = F.col("url")
    no = F.lit(None).cast("bigint")
    direct = tasks.filter(~v.is_iiif(url)).select(url.alias("task"), url.alias("frame"), *(no.alias(c) for c in ("x", "y", "width", "height")))
    known = tasks.filter(v.is_iiif(url)).join(infos.select("url", v.image_info(F.col("body")).alias("info")), "url").filter("info.width > 0 and info.height > 0")
    base = known.select(url.alias("task"), F.regexp_replace("url", "/info\\.json$", "").alias("base"), "info.width", "info.height")
    if full_res:
        parts = tiles(base, tile).select("task", F.col("url").alias("frame"), "x", "y", "width", "height")
    else:
        parts = base.select("task", v.whole_url(F.col("base")).alias("frame"), *(no.alias(c) for c in ("x", "y", "width", "height")))
    return direct.unionByName(parts)


@dataclass(frozen=True)
class Codecs:
    """Functions between bytes and rasters (rows, columns, RGB); one that is missing fails where it is needed."""

    decode: Callable[[bytes], np.ndarray]
    jpeg: Callable[[np.ndarray], bytes] | None = None
    jxl: Callable[[np.ndarray], bytes] | None = None
    transcode: Callable[[bytes], bytes] | None = None


_MADE = "url string, src_bytes bigint, jxl_bytes bigint, width bigint, height bigint, is_jpeg boolean, transcoded boolean, raw binary, jxl binary, error string"


def process(tasks: DataFrame, infos: DataFrame, responses: DataFrame, codecs: Codecs, options: ScanOptions) -> DataFrame:
    """Everything from scan tasks (url) to images: the plan of frames, their bytes (responses: url, body), stitching, encoding.

    url, src_bytes, jxl_bytes, width, height, is_jpeg, transcoded, raw (JPEG bytes), jxl, error. A task fails, with the reason as
    error, if a frame or its info.json was not captured or does not decode, or if a direct image is smaller than min_bytes.
    JPEG bytes are transcoded where the options allow it; if that fails, they go through pixels. An image is one row, so its
    frames meet in one task."""
    planned = frames(tasks, infos, options.tile, options.full_res).join(responses.select(F.col("url").alias("frame"), "body"), "frame", "left")

    def whole(key, pdf: pd.DataFrame) -> pd.DataFrame:
        made = dict.fromkeys((c.split(" ")[0] for c in _MADE.split(", ")))
        made |= {"url": key[0], "src_bytes": 0, "jxl_bytes": 0, "is_jpeg": False, "transcoded": False}
        try:
            pdf = pdf.sort_values(["y", "x"], kind="stable")
            lost = pdf["frame"][pdf["body"].isna()]
            if pdf["frame"].isna().all():
                raise ValueError(f"no readable info.json: {key[0]}")
            if len(lost):
                raise ValueError(f"not captured: {lost.iloc[0]}")
            direct, body = pdf["frame"].iloc[0] == key[0], bytes(pdf["body"].iloc[0])
            if direct and len(body) < options.min_bytes:
                raise ValueError(f"response too small ({len(body)} bytes < {options.min_bytes})")
            if pdf["x"].isna().all():
                pixels = codecs.decode(body)
            else:
                pixels = np.zeros((int(pdf["height"].iloc[0]), int(pdf["width"].iloc[0]), 3), np.uint8)
                for r in pdf.itertuples():
                    blit(pixels, codecs.decode(bytes(r.body)), int(r.x), int(r.y))
                body = codecs.jpeg(pixels)
            made |= {"height": pixels.shape[0], "width": pixels.shape[1], "src_bytes": len(body), "is_jpeg": body[:2] == b"\xff\xd8"}
            if options.jxl:
                if direct and codecs.transcode and (options.lossless or options.distance <= 0.1):
                    try:
                        made |= {"jxl": codecs.transcode(body), "transcoded": True}
                    except ValueError:
                        pass  # not a JPEG that can be kept as it is
                if made["jxl"] is None:
                    made["jxl"] = codecs.jxl(pixels)
                made["jxl_bytes"] = len(made["jxl"])
            if options.keep_raw or not options.jxl:
                made["raw"] = body
        except ValueError as e:
            made["error"] = str(e)
        return pd.DataFrame([made])

    lost = tasks.select(F.col("url").alias("task")).join(planned.select("task"), "task", "left_anti")
    rows = planned.select("task", "frame", "x", "y", "width", "height", "body").unionByName(lost, allowMissingColumns=True)
    return rows.groupBy("task").applyInPandas(whole, _MADE)


def images(spark: SparkSession, folder: str) -> DataFrame:
    """path, width, height, data (RGB rows) of a folder's JPEG, PNG, GIF and BMP files, decoded in the JVM."""
    image = F.col("image")
    swapped = F.unhex(F.regexp_replace(F.hex(image["data"]), "(..)(..)(..)", "$3$2$1"))  # it stores blue, green, red
    grey = F.unhex(F.regexp_replace(F.hex(image["data"]), "(..)", "$1$1$1"))
    clear = F.unhex(F.regexp_replace(F.hex(image["data"]), "(..)(..)(..)..", "$3$2$1"))
    data = F.when(image["nChannels"] == 3, swapped).when(image["nChannels"] == 1, grey).otherwise(clear)
    return spark.read.format("image").option("dropInvalid", True).load(folder).select(image["origin"].alias("path"), image["width"].alias("width"), image["height"].alias("height"), data.alias("data"))


def scan_manifest(results: DataFrame, lossless: bool = False, distance: float = 1.0, min_bytes: int = 1024, keep_raw: bool = False, jxl: bool = True) -> DataFrame:
    """Manifest records, and ok, mode, ratio, line for results (url, src_bytes, jxl_bytes, width, height, is_jpeg).

    A direct image of fewer than min_bytes is a failure (IIIF frames are not held to it)."""
    iiif, stem = v.is_iiif(F.col("url")), v.stem(F.col("url"))
    raw = F.concat(F.lit("raw/"), stem, F.lit(".jpg")) if keep_raw or not jxl else F.lit(None).cast("string")
    share = v.ratio(F.col("src_bytes"), F.col("jxl_bytes"))
    return results.select(
        "url", stem.alias("file_stem"), (F.concat(F.lit("jxl/"), stem, F.lit(".jxl")) if jxl else F.lit("")).alias("jxl_path"), raw.alias("raw_path"), "src_bytes", "jxl_bytes", "width", "height", F.lit(lossless).alias("lossless"),
        F.lit(0.0 if lossless else distance).cast("float").alias("distance"), (iiif | (F.col("src_bytes") >= min_bytes)).alias("ok"), v.encode_mode(iiif, F.col("is_jpeg"), F.lit(lossless), F.lit(distance)).alias("mode"), share.alias("ratio"), F.format_string("%.0f%%", share).alias("ratio_text"),
    )


def encode_jpeg(pixels: np.ndarray, quality: int = 95) -> bytes:
    """JPEG bytes of an RGB raster; needs an image codec, which is optional."""
    try:
        from PIL import Image
    except ImportError as e:
        raise RuntimeError("encoding JPEG needs Pillow, which is not installed") from e
    import io

    out = io.BytesIO()
    Image.fromarray(pixels).save(out, "JPEG", quality=quality)
    return out.getvalue()


def encode_jxl(pixels: np.ndarray, distance: float = 1.0, effort: int = 7, lossless: bool = False) -> bytes:
    """JPEG XL bytes of an RGB raster; needs an image codec, which is optional."""
    try:
        import imagecodecs
    except ImportError as e:
        raise RuntimeError("encoding JPEG XL needs imagecodecs, which is not installed") from e
    return imagecodecs.jpegxl_encode(pixels, distance=0.0 if lossless else distance, effort=effort, lossless=lossless)
