"""Scan viewers as native expressions: player settings, page enumeration, tile addresses, scan manifests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagewright.functions import url as u
from pagewright.functions.binding import let
from pagewright.functions.page import attribute, start_tags
from pagewright.schemas import IMAGE_INFO, OBJECT_DATA

#: Settings of an embedded player, in the order in which its pages write them; a fixed format.
_PLAYER = r'"iipServerURL"\s*:\s*"(.*?)"\s*,\s*"imageDir"\s*:\s*"(.*?)"\s*,\s*"objectData"\s*:\s*"(.*?)"'


def json_text(escaped: Column) -> Column:
    """The inside of a JSON string literal, read; where it is none, with \\/ as / only."""
    read = F.get(F.from_json(F.concat(F.lit('["'), escaped, F.lit('"]')), "array<string>"), F.lit(0))
    return F.coalesce(read, F.replace(escaped, F.lit("\\/"), F.lit("/")))


def players(page: Column) -> Column:
    """Array of (iip, image_dir, object_data), the first of each object_data, in the order of the page."""
    parts = [F.regexp_extract_all(page, F.lit(_PLAYER), i) for i in (1, 2, 3)]
    rows = F.transform(F.arrays_zip(*(x.alias(n) for x, n in zip(parts, ("x", "y", "z"), strict=True))), lambda r: F.struct(json_text(r["x"]).alias("iip"), json_text(r["y"]).alias("image_dir"), json_text(r["z"]).alias("object_data")))
    keys = F.transform(rows, lambda r: r["object_data"])
    return F.filter(rows, lambda r, i: F.array_position(keys, r["object_data"]) == i + 1)


def page_files(object_data: Column) -> Column:
    """File names of an objectData document; other keys are ignored, a broken document is an error."""
    return F.transform(F.from_json(object_data, OBJECT_DATA, {"mode": "FAILFAST"})["pgs"], lambda p: p["f"])


def image_info(body: Column) -> Column:
    """(width, height) of an info.json; a broken one is null."""
    return F.from_json(body, IMAGE_INFO)


def info_url(iip: Column, image_dir: Column, file: Column) -> Column:
    return F.concat(iip, F.lit("?IIIF="), F.rtrim(image_dir, F.lit("/")), F.lit("/"), file, F.lit("/info.json"))


def tile_url(base: Column, x: Column, y: Column, w: Column, h: Column) -> Column:
    return F.concat(base, F.lit("/"), F.concat_ws(",", *(c.cast("string") for c in (x, y, w, h))), F.lit("/full/0/default.jpg"))


def whole_url(base: Column) -> Column:
    return F.concat(base, F.lit("/full/max/0/default.jpg"))


def safe_view_pages(page: Column, viewer: Column) -> Column:
    """URLs of a viewer's pages: its last segment is a file name in base64 with _ for /; page i is that name and /i, encoded the
    same way. Null if the page names no count or the segment is no base64 of UTF-8."""
    count = F.regexp_extract(page, "setPagesCount\\((\\d+)\\)", 1)
    last = F.substring_index(F.substring_index(viewer, "/", -1), "#", 1)
    code = F.translate(last, "_", "/")
    name = F.when((F.length(code) % 4 == 0) & F.rlike(code, F.lit("^[A-Za-z0-9+/]*={0,2}$")), F.try_to_binary(code, F.lit("base64")))
    text = F.try_validate_utf8(name.cast("string"))
    base = F.left(viewer, F.length(viewer) - F.length(last))
    n = F.when(F.length(count).between(1, 9), count.cast("int"))
    numbers = F.when(n > 0, F.sequence(F.lit(0), n - 1)).when(n == 0, F.array().cast("array<int>"))
    return F.when(text.isNotNull(), F.transform(numbers, lambda i: F.concat(base, F.translate(F.base64(F.encode(F.concat(text, F.lit("/"), i.cast("string")), "utf-8")), "/", "_"))))


def viewer_link(page: Column, base: Column) -> Column:
    """The first a.button-primary whose target holds /safe-view/; null without one."""
    anchors = F.transform(start_tags(page, "a"), lambda t: F.struct(attribute(t, "class").alias("class"), attribute(t, "href").alias("href")))
    good = F.filter(anchors, lambda a: F.array_contains(F.split(F.coalesce(a["class"], F.lit("")), "\\s+"), "button-primary") & F.contains(a["href"], F.lit("/safe-view/")))
    return let(F.get(good, F.lit(0))["href"], lambda href: u.resolve(base, href))


def is_library_page(url: Column) -> Column:
    host, path = u.host(url), u.path(url)
    return ((host == "elib.rgo.ru") & (F.contains(path, F.lit("/handle/")) | F.contains(path, F.lit("/safe-view/")))) | (F.contains(host, F.lit("prlib.ru")) & F.contains(path, F.lit("/item/")))


def page_kind(url: Column, page: Column) -> Column:
    """What a library page is seeded from, the first that applies: players, safe_view, collection, item, unknown."""
    handle = (u.host(url) == "elib.rgo.ru") & F.contains(u.path(url), F.lit("/handle/"))
    listing = F.contains(page, F.lit("tbl-type-1-adapt")) | F.contains(page, F.lit("pagination"))
    return F.when(F.size(players(page)) > 0, "players").when(F.contains(u.path(url), F.lit("/safe-view/")), "safe_view").when(handle & listing, "collection").when(handle, "item").otherwise("unknown")


def is_iiif(url: Column) -> Column:
    return F.contains(url, F.lit("IIIF=")) & F.endswith(url, F.lit("/info.json"))


def stem(url: Column) -> Column:
    """File stem of a scan task: of the image file for IIIF, else of the whole URL."""
    return F.when(is_iiif(url), u.iiif_stem(F.regexp_replace(url, "/info\\.json$", ""))).otherwise(u.scan_stem(url))


def encode_mode(iiif: Column, is_jpeg: Column, lossless: Column, distance: Column) -> Column:
    """transcode keeps a JPEG's own coefficients; everything else goes through pixels."""
    return F.when(~iiif & is_jpeg & (lossless | (distance <= 0.1)), "transcode").when(lossless, "pixels_lossless").otherwise("pixels")


def ratio(source: Column, made: Column) -> Column:
    return F.when(source > 0, made * 100.0 / F.greatest(source, F.lit(1))).otherwise(0.0)
