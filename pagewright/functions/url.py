"""URLs as native expressions: parts, resolution, normal form within a scope, file stems, predicates.

An absolute URL is http or https; everything else is null rather than guessed at.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from pagewright.functions.binding import let

#: Path suffixes of assets that are no pages, fixed values.
ASSETS = "jpg jpeg png gif webp svg ico css js mjs pdf djvu zip rar 7z tar gz mp3 mp4 avi mov webm woff woff2 ttf eot".split()
IMAGES = "jpg jpeg png tif tiff webp bmp jp2".split()

_URL = r"^(?i:(https?))://([^/?#\\]*)([^?#]*)(\?[^#]*)?(#.*)?$"
_PATH_BAD = "[\\x00-\\x20\"<>`{}\\x7F-\\x{10FFFF}]"
_QUERY_BAD = "[\\x00-\\x20\"<>'\\x7F-\\x{10FFFF}]"


def _part(url: Column, group: int) -> Column:
    return F.regexp_extract(url, _URL, group)


def scheme(url: Column) -> Column:
    return F.lower(_part(url, 1))


def authority(url: Column) -> Column:
    """Lower-cased host and port without user and without the scheme's own port."""
    host = F.lower(F.regexp_replace(_part(url, 2), "^.*@", ""))
    return F.when(scheme(url) == "http", F.regexp_replace(host, ":(80)?$", "")).otherwise(F.regexp_replace(host, ":(443)?$", ""))


def host(url: Column) -> Column:
    return F.regexp_replace(authority(url), ":[0-9]+$", "")


def path(url: Column) -> Column:
    p = _part(url, 3)
    return F.when(p == "", "/").otherwise(p)


def query(url: Column) -> Column:
    """Text after the question mark; null without one."""
    q = _part(url, 4)
    return F.when(q != "", F.substring(q, 2, 1 << 30))


def fragment(url: Column) -> Column:
    f = _part(url, 5)
    return F.when(f != "", F.substring(f, 2, 1 << 30))


def percent_encoded(text: Column, bad: str) -> Column:
    """Characters of the class as the %XX of their UTF-8 bytes."""

    def coded(t: Column) -> Column:
        chars = F.transform(F.split(t, ""), lambda c: F.when(F.rlike(c, F.lit(bad)), F.regexp_replace(F.hex(F.encode(c, "utf-8")), "(..)", "%$1")).otherwise(c))
        return F.when(F.rlike(t, F.lit(bad)), F.array_join(chars, "")).otherwise(t)

    return let(text, coded)


def without_dots(p: Column) -> Column:
    """A path that begins with a slash, its . and .. segments resolved."""
    return let(p, _without_dots)


def _without_dots(p: Column) -> Column:
    parts = F.split(F.substring(p, 2, 1 << 30), "/", -1)
    last = F.size(parts) - 1
    indexed = F.transform(parts, lambda s, i: F.struct(s.alias("s"), (i == last).alias("last")))
    dot = lambda s: F.rlike(s, F.lit("^(?i:\\.|%2e)$"))
    two = lambda s: F.rlike(s, F.lit("^(?i:\\.|%2e){2}$"))

    def step(acc: Column, x: Column) -> Column:
        empty = F.array(F.lit(""))
        shorter = F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))
        tail = lambda a: F.when(x["last"], F.concat(a, empty)).otherwise(a)
        return F.when(two(x["s"]), tail(shorter)).when(dot(x["s"]), tail(acc)).otherwise(F.concat(acc, F.array(x["s"])))

    clean = F.concat(F.lit("/"), F.array_join(F.aggregate(indexed, F.array().cast("array<string>"), step), "/"))
    return F.when(F.rlike(p, F.lit("/(?i:\\.|%2e)")), clean).otherwise(p)


def canonical(url: Column) -> Column:
    """An absolute URL written out in its standard form; null if it is none."""
    return let(url, _canonical)


def _canonical(url: Column) -> Column:
    q, f = query(url), fragment(url)
    out = F.concat(scheme(url), F.lit("://"), authority(url), percent_encoded(without_dots(path(F.translate(url, "\\", "/"))), _PATH_BAD), F.coalesce(F.concat(F.lit("?"), percent_encoded(q, _QUERY_BAD)), F.lit("")), F.coalesce(F.concat(F.lit("#"), percent_encoded(f, _QUERY_BAD)), F.lit("")))
    return F.when(F.rlike(url, F.lit(_URL)) & (authority(url) != ""), out)


def resolve(base: Column, href: Column) -> Column:
    """href as a URL of the page at base (absolute, in standard form): absolute, //host, /rooted, ?query, #fragment, empty or
    relative with dot segments. Null for other schemes and where base is no URL."""
    h = F.regexp_replace(F.regexp_replace(href, "^[\\x00-\\x20]+|[\\x00-\\x20]+$", ""), "[\\t\\n\\r]", "")
    parts = F.struct(F.rlike(base, F.lit(_URL)).alias("good"), scheme(base).alias("scheme"), authority(base).alias("authority"), path(base).alias("path"), F.coalesce(F.concat(F.lit("?"), query(base)), F.lit("")).alias("query"), h.alias("h"))
    return let(parts, lambda b: F.when(b["good"], canonical(_joined(b, b["h"]))))


def _joined(b: Column, h: Column) -> Column:
    root = F.concat(b["scheme"], F.lit("://"), b["authority"])
    page = F.concat(root, b["path"])
    here = F.concat(page, b["query"])
    return (
        F.when(F.rlike(h, F.lit("^(?i:https?)://")), h).when(F.rlike(h, F.lit("^[A-Za-z][A-Za-z0-9+.-]*:")), F.lit(None).cast("string")).when(F.startswith(h, F.lit("//")), F.concat(b["scheme"], F.lit(":"), h)).when(F.startswith(h, F.lit("/")), F.concat(root, h))
        .when(F.startswith(h, F.lit("?")), F.concat(page, h)).when(F.startswith(h, F.lit("#")), F.concat(here, h)).when(h == "", here).otherwise(F.concat(F.regexp_replace(page, "[^/]*$", ""), h))
    )


@dataclass(frozen=True)
class Scope:
    """What a crawl stays in: one host, its scheme, and a path prefix."""

    host: str
    root: str
    prefix: str

    @classmethod
    def of(cls, start: str) -> Scope:
        m = re.match(r"^(https?)://([^/?#]*)([^?#]*)", start, re.I)
        name = re.sub(r":\d*$", "", re.sub(r"^.*@", "", m[2])).lower() if m else ""
        if not name:
            raise ValueError(f"not an http(s) URL with a host: {start}")
        where = (m[3] or "/").rstrip("/") or "/"
        return cls(name, f"{m[1].lower()}://{name}/", where)


def in_prefix(p: Column, prefix: Column) -> Column:
    return (prefix == "/") | (p == prefix) | F.startswith(p, F.concat(prefix, F.lit("/")))


def is_asset(p: Column) -> Column:
    return F.rlike(F.lower(p), F.lit("\\.(" + "|".join(ASSETS) + ")$"))


def _plain(s: Column) -> Column:
    return let(s, lambda t: F.coalesce(F.try_url_decode(t), t))


def form_value(q: Column, name: str) -> Column:
    """Decoded value of the first pair of that name; null without one."""
    first = F.get(F.filter(F.split(q, "&", -1), lambda p: _plain(F.substring_index(p, "=", 1)) == name), F.lit(0))
    return let(first, lambda f: F.when(F.contains(f, F.lit("=")), _plain(F.regexp_replace(f, "^[^=]*=", ""))).when(f.isNotNull(), F.lit("")))


def normalize(url: Column, scope_host: Column, scope_root: Column, scope_prefix: Column) -> Column:
    """The page's identity within a scope: the scope's scheme and host, the path, the query without which it is another page
    (index.php: its id alone), no fragment. Null outside the scope, for assets, and for what is no URL, whatever the scope."""
    parts = let(url, lambda x: F.struct(host(x).alias("host"), path(x).alias("path"), query(x).alias("query"), form_value(query(x), "id").alias("id")))

    def written(b: Column) -> Column:
        kept = F.when(F.endswith(b["path"], F.lit("/index.php")), F.when(F.trim(b["id"]) != "", F.concat(F.lit("id="), percent_encoded(b["id"], _QUERY_BAD)))).otherwise(b["query"])
        out = F.concat(F.rtrim(scope_root, F.lit("/")), b["path"], F.coalesce(F.concat(F.lit("?"), kept), F.lit("")))
        return F.when((b["host"] != "") & (b["host"] == scope_host) & in_prefix(b["path"], scope_prefix) & ~is_asset(b["path"]), out)

    return let(parts, written)


def normalize_in(url: Column, scope: Scope) -> Column:
    return normalize(url, F.lit(scope.host), F.lit(scope.root), F.lit(scope.prefix))


def own_scope(url: Column) -> tuple[Column, Column, Column]:
    """Host, root and whole-site prefix of a page's own URL."""
    return host(url), F.concat(scheme(url), F.lit("://"), host(url), F.lit("/")), F.lit("/")


def excluded_by(url: Column, patterns: tuple[str, ...]) -> Column:
    """The first of the patterns that is found in the URL; null if none is. Patterns are compiled here, where they run, in the
    JVM: one that does not compile fails at once."""
    session = SparkSession.getActiveSession()
    for p in patterns:
        try:
            session._jvm.java.util.regex.Pattern.compile(p)
        except (Py4JJavaError, IllegalArgumentException) as e:
            raise ValueError(f"bad exclusion pattern: {p}") from e
    return F.coalesce(*(F.when(F.rlike(url, F.lit(p)), F.lit(p)) for p in patterns), F.lit(None).cast("string"))


def text_stem(text: Column) -> Column:
    """A file name: other characters than [A-Za-z0-9._-] become _, runs of dots one, ends are trimmed; nothing left: page."""
    s = F.regexp_replace(F.regexp_replace(text, "[^A-Za-z0-9._-]", "_"), "\\.{2,}", ".")
    s = F.regexp_replace(s, "^[._-]+|[._-]+$", "")
    return let(s, lambda x: F.when(x == "", "page").otherwise(x))


def page_stem(url: Column) -> Column:
    parts = let(url, lambda x: F.struct(path(x).alias("path"), F.coalesce(query(x), F.lit("")).alias("query"), form_value(query(x), "id").alias("id")))

    def named(b: Column) -> Column:
        trimmed = F.translate(F.regexp_replace(b["path"], "^/+|/+$", ""), "/", ".")
        key = let(trimmed, lambda t: F.concat(F.when(t == "", "index").otherwise(t), F.when(b["query"] != "", F.concat(F.lit("__q_"), b["query"])).otherwise("")))
        return text_stem(F.when(F.trim(b["id"]) != "", b["id"]).otherwise(key))

    return let(parts, named)


def scan_text_stem(text: Column) -> Column:
    """Runs of other characters than [A-Za-z0-9.-] become one _; _ and then . are trimmed; the last 180 characters stay."""
    s = F.regexp_replace(text, "[^A-Za-z0-9.-]+", "_")
    s = F.regexp_replace(F.regexp_replace(s, "^_+|_+$", ""), "^\\.+|\\.+$", "")
    return let(s, lambda x: F.when(F.length(x) > 180, F.right(x, F.lit(180))).otherwise(x))


def scan_stem(url: Column) -> Column:
    s = scan_text_stem(F.concat(host(url), F.lit("_"), path(url), F.coalesce(F.concat(F.lit("_"), query(url)), F.lit(""))))
    return let(s, lambda x: F.when(x == "", "index").otherwise(x))


def iiif_stem(base: Column) -> Column:
    s = scan_text_stem(F.substring_index(F.substring_index(base, "/", -1), "?", 1))
    return let(s, lambda x: F.when(x == "", "page").otherwise(x))


def looks_like_image(url: Column) -> Column:
    p = F.lower(path(url))
    return F.rlike(p, F.lit("\\.(" + "|".join(IMAGES) + ")$")) | F.rlike(p, F.lit("view|image|page")) | F.coalesce(F.contains(F.lower(query(url)), F.lit("image")), F.lit(False))


def is_item(url: Column) -> Column:
    """A library item: /handle/x/number and beyond."""
    parts = F.filter(F.split(path(url), "/", -1), lambda s: s != "")
    return (F.size(parts) >= 3) & (F.get(parts, F.lit(0)) == "handle") & F.rlike(F.coalesce(F.get(parts, F.lit(2)), F.lit("")), F.lit("^\\p{N}+$"))


def is_pagination(url: Column, root: Column) -> Column:
    return (path(url) == path(root)) & F.coalesce(F.contains(query(url), F.lit("offset=")), F.lit(False))
