"""Captured pages as native expressions: charset, title, main content, Markdown, links, images."""

from __future__ import annotations

import html
import html.entities
import json
import re
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from pagewright.functions import text as tx
from pagewright.functions import url as u
from pagewright.functions.binding import let

MAIN_BEGIN, MAIN_END = "<!--Main Content-->", "<!--EndOf Main Content-->"
#: Labels of character sets and the JVM's names for them, fixed values.
CHARSETS = {
    "utf-8": "UTF-8", "utf8": "UTF-8", "unicode-1-1-utf-8": "UTF-8", "windows-1251": "windows-1251", "cp1251": "windows-1251", "x-cp1251": "windows-1251", "koi8-r": "KOI8-R", "koi8": "KOI8-R", "koi8_r": "KOI8-R", "koi": "KOI8-R", "koi8-u": "KOI8-U",
    "windows-1252": "windows-1252", "cp1252": "windows-1252", "latin1": "windows-1252", "iso-8859-1": "windows-1252", "ascii": "windows-1252", "us-ascii": "windows-1252", "l1": "windows-1252", "iso-8859-5": "ISO-8859-5", "cyrillic": "ISO-8859-5", "ibm866": "IBM866",
    "cp866": "IBM866", "866": "IBM866", "windows-1250": "windows-1250", "iso-8859-2": "ISO-8859-2", "latin2": "ISO-8859-2", "windows-1253": "windows-1253", "windows-1254": "windows-1254", "utf-16le": "UTF-16LE", "utf-16": "UTF-16LE", "utf-16be": "UTF-16BE", "x-mac-cyrillic": "x-MacCyrillic",
    "gbk": "GBK", "gb2312": "GBK", "gb18030": "GB18030", "big5": "Big5", "euc-jp": "EUC-JP", "shift_jis": "windows-31j", "sjis": "windows-31j", "euc-kr": "EUC-KR",
}
#: What decode() needs of the session: the JVM's character sets, and replacement of what is malformed.
SESSION = {"spark.sql.legacy.javaCharsets": "true", "spark.sql.legacy.codingErrorAction": "true"}


@contextmanager
def decoding(spark: SparkSession) -> Iterator[None]:
    """Settings that decoded() needs while its expression is made; the caller's own come back after it."""
    before = {key: spark.conf.get(key, None) for key in SESSION}
    for key, value in SESSION.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def _known(label: Column) -> Column:
    pairs = F.create_map(*(F.lit(x) for kv in CHARSETS.items() for x in kv))
    return F.try_element_at(pairs, F.lower(F.trim(label)))


def header_charset(content_type: Column) -> Column:
    """Character set of a Content-Type; null if there is none, or an unknown one."""
    label = F.regexp_extract(content_type, "(?i)charset=([^;]*)", 1)
    return F.when(F.rlike(content_type, F.lit("(?i)charset=")), _known(F.btrim(F.trim(label), F.lit("\"'"))))


def meta_charset(body: Column) -> Column:
    """Character set that the first 8 KiB of a page name: at the first `charset=`, else at the first `charset =`."""
    head = F.lower(F.decode(F.substring(body, 1, 8192), "ISO-8859-1"))
    at = lambda needle: _known(F.when(F.contains(head, F.lit(needle)), F.regexp_extract(head, f"(?s)^.*?{needle}[ \\t'\"]*([^\"'>;\\s]*)", 1)))
    return F.coalesce(at("charset="), at("charset ="))


def charset(body: Column, content_type: Column) -> Column:
    """Header, else page, else UTF-8 if the bytes are that, else windows-1251."""
    return F.coalesce(header_charset(content_type), meta_charset(body), F.when(F.is_valid_utf8(body.cast("string")), "UTF-8").otherwise("windows-1251"))


def decoded(body: Column, content_type: Column) -> Column:
    """Text of a body (to be put into a plan inside decoding()); a byte order mark is dropped, malformed bytes become U+FFFD."""
    return F.regexp_replace(F.call_function("decode", body, charset(body, content_type)), "^\\uFEFF", "")


#: Names that pages use most, fixed values.
_COMMON = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "nbsp": "\u00a0", "middot": "·", "copy": "©", "apos": "'", "laquo": "«", "raquo": "»", "mdash": "—", "ndash": "–", "hellip": "…"}
_REFERENCE = "&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);"
#: All named references, as one constant.
_NAMES = json.dumps({k[:-1]: v for k, v in html.entities.html5.items() if k.endswith(";")}, ensure_ascii=True)


def _character(reference: Column) -> Column:
    """What one reference stands for; itself if the name is unknown. Numbers that are no character are U+FFFD, and those of the
    C1 controls mean windows-1252, as browsers read them."""
    body = F.substring(reference, 2, 1 << 30)
    body = F.left(body, F.length(body) - 1)
    digits = F.when(F.rlike(body, F.lit("^#[xX]")), F.conv(F.right(F.substring(body, 3, 1 << 30), F.lit(9)), 16, 10)).otherwise(F.conv(F.right(F.substring(body, 2, 1 << 30), F.lit(9)), 10, 10))
    long = F.rlike(body, F.lit("^#(?:[xX]0*[1-9a-fA-F][0-9a-fA-F]{8,}|0*[1-9][0-9]{9,})$"))

    def of(code: Column) -> Column:
        windows = F.create_map(*(F.lit(x) for c in range(0x80, 0xA0) for x in (c, html.unescape(f"&#{c};"))))
        bad = long | (code == 0) | (code > 0x10FFFF) | code.between(0xD800, 0xDFFF)
        return F.when(bad, F.lit("\ufffd")).when(code.between(0x80, 0x9F), F.try_element_at(windows, code)).otherwise(F.decode(F.unhex(F.lpad(F.hex(code.cast("bigint")), 8, "0")), "UTF-32"))

    common = F.try_element_at(F.create_map(*(F.lit(x) for pair in _COMMON.items() for x in pair)), body)
    named = F.try_element_at(F.from_json(F.lit(_NAMES), "map<string,string>"), body)
    return F.when(F.startswith(body, F.lit("#")), let(digits.cast("int"), of)).otherwise(F.coalesce(common, named, reference))


def entities(text: Column) -> Column:
    """All named and numeric references that end in a semicolon, each read once. Texts without an & pass as they are, the
    others are cut at their references."""

    def read(t: Column) -> Column:
        found = F.transform(F.regexp_extract_all(t, F.lit(_REFERENCE), 0), _character)
        return F.array_join(F.zip_with(F.split(t, _REFERENCE, -1), found, lambda gap, c: F.concat(gap, F.coalesce(c, F.lit("")))), "")

    return let(text, lambda t: F.when(F.contains(t, F.lit("&")), read(t)).otherwise(t))


def bare(page: Column) -> Column:
    """A page without comments, scripts and styles."""
    out = page
    for pattern in ("<!--.*?-->", "<script\\b[^>]*>.*?</script\\s*>", "<style\\b[^>]*>.*?</style\\s*>"):
        out = F.regexp_replace(out, "(?is)" + pattern, "")
    return out


def title(page: Column, clean: Column | None = None) -> Column:
    """Text of the first h1, else of the first title, that is not blank: inner tags become spaces, references are decoded twice
    (once by the parser, once for pages that escape twice), white space is cleaned. Null without either. clean: bare(page), if
    it is at hand."""

    def of(clean: Column, tag: str) -> Column:
        raw = F.regexp_extract(clean, f"(?is)<{tag}\\b[^>]*>(.*?)</{tag}\\s*>", 1)
        return F.nullif(tx.clean_ws(entities(entities(F.regexp_replace(raw, "(?s)<[^>]+>", " ")))), F.lit(""))

    return let(bare(page) if clean is None else clean, lambda c: F.coalesce(of(c, "h1"), of(c, "title")))


def main_content(page: Column) -> Column:
    """What stands between the content marks; the whole page without both, in that order. An empty region is empty."""
    begin = F.locate(MAIN_BEGIN, page)
    after = F.when(begin > 0, F.substring(page, begin + len(MAIN_BEGIN), 1 << 30))
    return let(after, lambda a: F.when(F.contains(a, F.lit(MAIN_END)), F.substring_index(a, MAIN_END, 1)).otherwise(page))


#: Tags and what they become, in this order, fixed values.
MARKS = [
    (r"(?i)<\s*h1\b[^>]*>", "\n# "), (r"(?i)<\s*/\s*h1\s*>", "\n\n"), (r"(?i)<\s*h2\b[^>]*>", "\n## "), (r"(?i)<\s*/\s*h2\s*>", "\n\n"), (r"(?i)<\s*h3\b[^>]*>", "\n### "), (r"(?i)<\s*/\s*h3\s*>", "\n\n"), (r"(?i)<\s*br\b[^>]*>", "\n"), (r"(?i)<\s*/\s*p\s*>", "\n\n"),
    (r"(?i)<\s*p\b[^>]*>", "\n\n"), (r"(?i)<\s*/\s*div\s*>", "\n"), (r"(?i)<\s*/\s*center\s*>", "\n"), (r"(?i)<\s*li\b[^>]*>", "\n- "), (r"(?i)</\s*tr\s*>", "\n"), (r"(?i)</\s*td\s*>", " | "),
]
#: Regions that go with their contents, in this order, fixed values.
NOISE = [
    "(?is)<!--.*?-->", "(?is)<script\\b[^>]*>.*?</script>", "(?is)<style\\b[^>]*>.*?</style>", "(?is)<form\\b[^>]*>.*?</form>", "(?is)<iframe\\b[^>]*>.*?</iframe>",
]
_TAG = "(?s)<[^>]+>"
#: The same by the head of a tag: a slash if it ends one, and its name.
_SIGNS = {("/" if "/" in pattern else "") + re.search(r"(?:\*|</\\s\*)(h[123]|br|p|div|center|li|tr|td)", pattern)[1]: sign for pattern, sign in MARKS}


def _signed(s: Column) -> Column:
    """Block tags become their signs, other tags a space. Each tag is looked up by its name in one pass; where a tag holds a <,
    so that what is a tag depends on the order of the steps, the steps are taken one by one."""

    def by_steps(t: Column) -> Column:
        for pattern, sign in MARKS:
            t = F.regexp_replace(t, pattern, sign)
        return F.regexp_replace(t, _TAG, " ")

    def by_name(t: Column, tags: Column) -> Column:
        known = F.create_map(*(F.lit(x) for pair in _SIGNS.items() for x in pair))
        head = lambda tag: F.lower(F.translate(F.regexp_extract(tag, "(?i)^<(\\s*(?:/\\s*)?[a-z0-9]+)\\b", 1), " \t\n\r\f\u000b", ""))
        closed = lambda tag: ~F.startswith(F.ltrim(F.substring(tag, 2, 1 << 30)), F.lit("/")) | F.rlike(tag, F.lit("^<(?:/|\\s+/(?!\\s*(?i:tr|td)\\b))\\s*[A-Za-z0-9]+\\s*>$"))
        signs = F.transform(tags, lambda tag: F.coalesce(F.when(closed(tag), F.try_element_at(known, head(tag))), F.lit(" ")))
        return F.array_join(F.zip_with(F.split(t, _TAG, -1), signs, lambda gap, sign: F.concat(gap, F.coalesce(sign, F.lit("")))), "")

    def judged(t: Column) -> Column:
        return let(F.regexp_extract_all(t, F.lit(_TAG), 0), lambda tags: F.when(F.exists(tags, lambda g: F.contains(F.substring(g, 2, 1 << 30), F.lit("<"))), by_steps(t)).otherwise(by_name(t, tags)))

    return let(s, judged)


def markdown_body(content: Column, script: str | None = None) -> Column:
    """Markdown of a piece of a page: noise goes, block tags become line breaks and signs, other tags a space; then white space,
    letter spacing (script: of that one only), initials and the space about punctuation are put right."""
    s = content
    for pattern in NOISE:
        s = F.regexp_replace(s, pattern, "")
    s = F.replace(entities(_signed(s)), F.lit("\r"), F.lit("\n"))
    for pattern, sign in (("[ \\t]+", " "), ("[\\u00A0\\u202F]+", " "), ("\\n[ \\t]+", "\n"), ("\\n{3,}", "\n\n")):
        s = F.regexp_replace(s, pattern, sign)
    s = tx.glue_initials(tx.despace(F.btrim(s, F.lit(tx.WHITE)), script))
    return F.regexp_replace(F.regexp_replace(s, " ([.,;:!?)\\]»”])", "$1"), "([(\\[«“]) ", "$1")


def markdown(body: Column, name: Column, url: Column) -> Column:
    return F.concat(F.lit("# "), name, F.lit("\n\nSource: "), url, F.lit("\n\n---\n\n"), body, F.lit("\n"))


def plain_body(md: Column) -> Column:
    """Text after the first --- (wherever it is), white space cleaned."""
    return tx.clean_ws(let(md, lambda m: F.when(F.contains(m, F.lit("---")), F.substring(m, F.locate("---", m) + 3, 1 << 30)).otherwise(m)))


def attribute(tag: Column, name: str) -> Column:
    """An attribute's value in a start tag, decoded; null without it."""
    pattern = f"(?is)\\s{name}\\s*=\\s*(?:\"([^\"]*)\"|'([^']*)'|([^\\s\"'>]+))"
    value = F.concat(*(F.regexp_extract(tag, pattern, i) for i in (1, 2, 3)))
    return F.when(F.rlike(tag, F.lit(pattern)), entities(value))


def start_tags(page: Column, names: str, clean: Column | None = None) -> Column:
    return F.regexp_extract_all(bare(page) if clean is None else clean, F.lit(f"(?is)<(?:{names})(?=[\\s/>])(?:[^>\"']|\"[^\"]*\"|'[^']*')*>"), 0)


def hrefs(page: Column, clean: Column | None = None) -> Column:
    """Targets of a[href] in the order of the page, without in-page, mail and script ones."""
    all_ = F.filter(F.transform(start_tags(page, "a", clean), lambda t: attribute(t, "href")), lambda h: h.isNotNull())
    return F.filter(all_, lambda h: ~F.startswith(h, F.lit("#")) & ~F.startswith(h, F.lit("mailto:")) & ~F.startswith(h, F.lit("javascript:")))


def links(page: Column, base: Column, scope: tuple[Column, Column, Column], excluded: tuple[str, ...] = (), clean: Column | None = None) -> Column:
    """In-scope links of a page in normal form, each once, in order."""
    found = F.transform(F.transform(hrefs(page, clean), lambda h: u.resolve(base, h)), lambda x: u.normalize(x, *scope))
    kept = F.filter(found, lambda x: x.isNotNull())
    if excluded:
        kept = F.filter(kept, lambda x: u.excluded_by(x, excluded).isNull())
    return F.array_distinct(kept)


def best_of_srcset(srcset: Column) -> Column:
    """The candidate of the largest width, the first of equals; other descriptors count as 0; an empty part voids the whole."""
    parts = F.transform(F.split(srcset, ",", -1), lambda p: tx.clean_ws(p))

    def best(list_: Column) -> Column:
        width = lambda p: F.regexp_extract(p, "^\\S+ ([0-9]{1,9})w( |$)", 1)
        seen = F.transform(list_, lambda p: F.struct(F.substring_index(p, " ", 1).alias("url"), F.coalesce(F.nullif(width(p), F.lit("")).cast("bigint"), F.lit(0)).alias("w")))
        start = F.struct(F.lit(None).cast("string").alias("url"), F.lit(-1).cast("bigint").alias("w"))
        first = F.aggregate(seen, start, lambda a, c: F.when(c["w"] > a["w"], c).otherwise(a))["url"]
        return F.when(~F.exists(list_, lambda p: p == ""), first)

    return let(parts, best)


def image_links(page: Column, base: Column) -> Column:
    """Images of a page in standard form, each once: of img (src, data-src, data-original, data-lazy-src, best of srcset), then
    of a[href], of source (src, best of srcset), of the pages's og:image and twitter:image; only what looks like an image."""
    of_img = F.flatten(F.transform(start_tags(page, "img"), lambda t: F.array(*(attribute(t, a) for a in ("src", "data-src", "data-original", "data-lazy-src")), best_of_srcset(attribute(t, "srcset")))))
    of_a = F.transform(start_tags(page, "a"), lambda t: attribute(t, "href"))
    of_source = F.flatten(F.transform(start_tags(page, "source"), lambda t: F.array(attribute(t, "src"), best_of_srcset(attribute(t, "srcset")))))
    meta = F.filter(start_tags(page, "meta"), lambda t: attribute(t, "property").isin("og:image") | F.coalesce(attribute(t, "name").isin("twitter:image"), F.lit(False)))
    of_meta = F.transform(meta, lambda t: attribute(t, "content"))
    raw = F.transform(F.filter(F.concat(of_img, of_a, of_source, of_meta), lambda x: x.isNotNull()), lambda x: F.trim(x))
    good = F.filter(raw, lambda x: (x != "") & ~F.startswith(x, F.lit("data:")))
    full = F.transform(good, lambda x: u.resolve(base, x))
    return F.array_distinct(F.filter(full, lambda x: x.isNotNull() & u.looks_like_image(x)))
