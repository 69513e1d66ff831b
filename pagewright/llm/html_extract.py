"""Main text of web pages by differencing with the pages of the nearest URLs.

A page is read into blocks (lines of text) in page order. What HTML says is no text of the page (scripts, forms, menus,
footers, asides, containers that carry an ARIA role or a class of their own for adverts, notices or comments) goes at once.
All other lines are compared with those of the pages next to it by URL path in its host: pages are ordered by host and path
over the whole table and numbered, so a host of any size is spread over all tasks, and each page is aligned with up to REACH
distinct pages on each side by longest common subsequence. Pages of a host with the same lines are one page here, however many.

A line shared with a neighbour is template, unless the neighbour is a copy of the page: leaving out what all of three or more
neighbours share, the two have more than half of the page's rest in common. Template lines go. An explicit <article> or <main>
is believed over this only where it holds at least as much text as the unshared lines outside it: then the lines outside go,
and inside, where articles may share paragraphs, template is only what stands at the beginning or end and is shared with
two neighbours that are no copies. Otherwise the differencing decides every line.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.plans.ranking import numbered
from pagewright.plans.skew import spread_join
from pagewright.plans.workspace import Workspace

#: Distinct pages on each side that a page is aligned with; pages of a chunk, which one task reads in turn.
REACH, CHUNK = 4, 512
#: Bits of rows that one alignment keeps.
DIRECT_BITS = 1 << 24

#: Elements by their part in a page.
SKIPPED = frozenset("script style noscript template svg math iframe object canvas textarea select button head audio video map datalist".split())
OUTSIDE = frozenset("nav footer aside form dialog menu".split())
BLOCKS = frozenset("address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Containers whose attributes are looked at: what is marked otherwise is text.
CONTAINERS = frozenset("article aside center details div dl header main ol section table ul".split())
#: ARIA roles, and whole tokens of class and id, of what is not the article, fixed values; for an <article> only comments count.
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog menu menubar navigation search toolbar".split())
READERS = frozenset("comment comments comment-list commentlist replies respond disqus_thread".split())
TOKENS = READERS | frozenset("ad ads advert advertisement banner breadcrumb breadcrumbs cookie cookies cookie-banner footer header login menu modal nav navbar navigation newsletter notice paywall popup promo promotion related share sharing sidebar social sponsor sponsored toolbar widget".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?>=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>]*)|[^>=])*+)>", re.S)
_ATTR = re.compile(r"(?:^|[\s\"'])(class|id|role|hidden|aria-hidden)(?=[\s=/]|\Z)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_MAIN_ROLE = re.compile(r"\srole\s*=\s*[\"']?main\b", re.I)
#: Elements whose start closes an open one of the same kind.
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_P_ENDS = BLOCKS - {"br", "option", "legend", "caption", "summary", "td", "th", "tr", "tbody", "thead", "tfoot", "li", "dt", "dd", "html", "body"}

#: Kinds of lines: of the article by mark-up, outside by mark-up, undecided.
INSIDE, OUT, OPEN = 1, 2, 0


def _marked(name: str, attrs: str, inside: bool) -> bool:
    """Whether class, id, role or hidden say that a container is not the article. Inside it, a header is the article's own; an
    <article> is none only if it is a comment."""
    for m in _ATTR.finditer(attrs):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key == "hidden" or (key == "aria-hidden" and value == "true"):
            return True
        if name not in CONTAINERS or name == "main":
            continue
        if key == "role" and name != "article" and value in ROLES and not (inside and value == "banner"):
            return True
        if key in ("class", "id"):
            said = (READERS if name == "article" else TOKENS).intersection(value.split())
            if said - {"header", "banner"} or (said and not inside):
                return True
    return False


def _raw_end(page: str, name: str, at: int) -> int:
    m = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)[^>]*>?", re.I).search(page, at)
    return m.end() if m else len(page)


def lines(page: str) -> list[tuple[str, int]]:
    """(text, kind) of a page's blocks in order: references decoded, white space inside a block one space, none empty."""
    out: list[tuple[str, int]] = []
    held: list[str] = []
    stack: list[tuple[str, int]] = []  # name, kind inside it
    kind, at = OPEN, 0

    def flush() -> None:
        if held:
            if text := " ".join(html.unescape("".join(held)).split()):
                out.append((text, kind))
            held.clear()

    def leave(depth: int) -> None:
        nonlocal kind
        while len(stack) > depth:
            if stack[-1][0] in BLOCKS or stack[-1][1] != (stack[-2][1] if len(stack) > 1 else OPEN):
                flush()
            stack.pop()
        kind = stack[-1][1] if stack else OPEN

    while at < len(page):
        m = _TOKEN.search(page, at)
        if m is None:
            held.append(page[at:])
            break
        held.append(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if m[1]:  # an end tag: to the open element of that name, unless a block of the article's shell is in between
            if name == "br":
                flush()
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == name:
                    leave(depth)
                    break
                if name not in BLOCKS and stack[depth][0] in BLOCKS:
                    break
            else:
                if name in BLOCKS:
                    flush()
            continue
        if name in SKIPPED:
            if name == "head":
                continue
            held.append(" ")
            if name not in ("svg", "math") or not m[3].rstrip().endswith("/"):
                at = _raw_end(page, name, at)
            continue
        if name == "title":
            at = _raw_end(page, name, at)
            continue
        if name in BLOCKS:
            flush()
        if name in _P_ENDS or name in _CLOSES:
            shut = _CLOSES.get(name, {"p"}) if name in _CLOSES else {"p"}
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] in shut:
                    leave(depth)
                    break
                if stack[depth][0] in ("table", "ul", "ol", "dl", "article", "main", "section", "div", "blockquote", "nav", "aside", "footer", "header"):
                    break
        if name in VOID or m[3].rstrip().endswith("/") and name not in BLOCKS:
            continue
        if kind == OUT or name in OUTSIDE or (name == "header" and kind != INSIDE) or _marked(name, m[3], kind == INSIDE):
            inner = OUT
        elif name in ("article", "main") or _MAIN_ROLE.search(m[3]):
            inner = INSIDE
        else:
            inner = kind
        if inner != kind:
            flush()
        stack.append((name, inner))
        kind = inner
    flush()
    return out


def place(url: str | None) -> tuple[str, str]:
    """Host and path (with query) of a URL; what cannot be read is a path of the empty host."""
    try:
        parts = urlsplit(url or "")
        return (parts.hostname or "").lower(), parts.path + ("?" + parts.query if parts.query else "")
    except ValueError:
        return "", url or ""


def _outline_of(url: str | None, found: list[tuple[str, int]]) -> tuple[str, str, bytes, bytes, bytes, bytes]:
    """host, path, key, hashes, kinds and lengths of a page's lines (without those outside by mark-up)."""
    host, path = place(url)
    hashes = np.array([xxhash.xxh64_intdigest(t.encode("utf-8", "surrogatepass")) for t, _ in found], np.uint64).tobytes()
    kinds = bytes(k for _, k in found)
    lengths = np.array([len(t) for t, _ in found], np.uint32).tobytes()
    return host, path, xxhash.xxh3_128_digest(hashes + kinds + lengths), hashes, kinds, lengths


def _text_lines(page: str | None) -> list[tuple[str, int]]:
    return [x for x in lines(page or "") if x[1] != OUT]


def _outline(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = [_outline_of(url, found) for url, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if (found := _text_lines(page))]
        cols = list(zip(*made, strict=True)) or [()] * 6
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), *(pa.array(c, pa.binary()) for c in cols[2:])], ["host", "path", "key", "hashes", "kinds", "lengths"])


def _lengths(x: list, y: list) -> int:
    """The bit-parallel row of x against y: its zero bits count, column by column, the longest common subsequence."""
    where: dict = {}
    for j, v in enumerate(y):
        where[v] = where.get(v, 0) | 1 << j
    full = (1 << len(y)) - 1
    row = full
    for v in x:
        hit = row & where.get(v, 0)
        row = ((row + hit) | (row - hit)) & full
    return row


def _prefix_counts(row: int, n: int) -> np.ndarray:
    """Zero bits among the first 0, 1 ... n bits of a row."""
    bits = np.unpackbits(np.frombuffer(row.to_bytes(n // 8 + 1, "little"), np.uint8), bitorder="little")[:n]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def _matched(x: list, y: list) -> list[int]:
    """Places of x in a longest common subsequence of x and y. Rows are kept for problems of up to DIRECT_BITS; greater ones
    are cut in two where forward and backward lengths add up to the most, so memory is in proportion to the lines."""
    if not x or not y:
        return []
    if len(x) == 1:
        return [0] if x[0] in y else []
    if len(x) * len(y) > DIRECT_BITS:
        half = len(x) // 2
        ahead = _prefix_counts(_lengths(x[:half], y), len(y))
        behind = _prefix_counts(_lengths(x[half:][::-1], y[::-1]), len(y))[::-1]
        cut = int(np.argmax(ahead + behind))
        return _matched(x[:half], y[:cut]) + [half + i for i in _matched(x[half:], y[cut:])]
    where: dict = {}
    for j, v in enumerate(y):
        where[v] = where.get(v, 0) | 1 << j
    full = (1 << len(y)) - 1
    row, rows = full, []
    for v in x:
        hit = row & where.get(v, 0)
        row = ((row + hit) | (row - hit)) & full
        rows.append(row)
    out, j = [], len(y)
    for i in range(len(x) - 1, -1, -1):
        before = rows[i - 1] if i else full
        while j and (rows[i] >> (j - 1)) & 1:
            j -= 1
        if j and (before >> (j - 1)) & 1:  # the length at this column grows in this row: a match is here
            out.append(i)
            j -= 1
    return out[::-1]


def shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which entries of a are in a longest common subsequence of a and b."""
    keep = np.zeros(len(a), bool)
    x, y = a.tolist(), b.tolist()
    common = set(x) & set(y)
    if common:
        ia = [i for i, v in enumerate(x) if v in common]
        keep[[ia[i] for i in _matched([x[i] for i in ia], [v for v in y if v in common])]] = True
    return keep


def kept_lines(kinds: np.ndarray, lengths: np.ndarray, same: list[np.ndarray]) -> np.ndarray:
    """Which lines of a page are its text, given what it shares with each of its neighbours."""
    votes = np.zeros(len(kinds), np.int64)
    frame = np.logical_and.reduce(same) if len(same) >= 3 else np.zeros(len(kinds), bool)
    rest = int(lengths[~frame].sum())
    for s in same:
        if int(lengths[s & ~frame].sum()) * 2 <= rest:  # else a copy, which tells nothing about the template
            votes += s
    inside = kinds == INSIDE
    if inside.any() and lengths[inside].sum() >= lengths[~inside & (votes == 0)].sum():
        keep = inside.copy()
        spots = np.flatnonzero(inside)
        for way in (spots, spots[::-1]):
            for i in way:
                if votes[i] < 2:
                    break
                keep[i] = False
        return keep if keep.any() else inside
    return votes == 0


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """host, key and, bit by bit, the lines kept of each page at home in its chunk; rows come sorted by chunk and rank."""

    def judged(i: int, held: list[dict]) -> tuple:
        me = held[i]
        own, kinds, lengths = np.frombuffer(me["hashes"], np.uint64), np.frombuffer(me["kinds"], np.uint8), np.frombuffer(me["lengths"], np.uint32).astype(np.int64)
        near = [r for k, r in enumerate(held) if k != i and r["host"] == me["host"] and abs(r["rank"] - me["rank"]) <= REACH]
        same = [shared(own, np.frombuffer(r["hashes"], np.uint64)) for r in near]
        return me["host"], me["key"], np.packbits(kept_lines(kinds, lengths, same)).tobytes()

    def emitted(out: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*out, strict=True)) or [()] * 3
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.binary())], ["host", "key", "kept"])

    held: list[dict] = []  # rows of one chunk, the next to be judged at `at`
    at = 0
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            if held and held[0]["chunk"] != row["chunk"]:
                out += [judged(i, held) for i in range(at, len(held)) if held[i]["home"]]
                held, at = [], 0
            held.append(row)
            while len(held) - at > REACH:
                if held[at]["home"]:
                    out.append(judged(at, held))
                at += 1
            if at > REACH:
                del held[: at - REACH]
                at = REACH
        yield emitted(out)
    yield emitted([judged(i, held) for i in range(at, len(held)) if held[i]["home"]])


def _compact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """page_id, url, host, key, lines (packed for the shuffle): each page's blocks without those outside by mark-up."""
    pack = zstandard.ZstdCompressor(level=6)
    for batch in batches:
        hosts, keys, text = [], [], []
        for url, page in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            host, _, key, *_ = _outline_of(url, found := _text_lines(page))
            hosts.append(host)
            keys.append(key)
            text.append(pack.compress("\n".join(t for t, _ in found).encode("utf-8", "surrogatepass")) if found else b"")
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(hosts, pa.string()), pa.array(keys, pa.binary()), pa.array(text, pa.binary())], ["page_id", "url", "host", "key", "lines"])


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        texts = []
        for packed, kept in zip(batch.column("lines").to_pylist(), batch.column("kept").to_pylist(), strict=True):
            found = unpack.decompress(packed).decode("utf-8", "surrogatepass").split("\n") if packed else []
            stay = np.unpackbits(np.frombuffer(kept, np.uint8))[: len(found)] if found else ()
            texts.append("\n".join(t for t, k in zip(found, stay, strict=True) if k))
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])


def extract(pages: DataFrame, ws: Workspace) -> DataFrame:
    """page_id, url, text, n_chars for each row of pages (page_id, url, html; other columns are ignored).

    text is the article's blocks in page order, joined by newlines: character references decoded, white space inside a block
    one space, trimmed; nothing else is dropped. Null or empty html gives an empty text. Rows of one host and the same lines
    are one page for the comparison, at the least of their paths, however many they are, and all get its text. A page whose
    URL cannot be read is compared with others of that kind. Ties of host and path are in the order of the content's hash. No
    rows, no result.
    """
    n = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    made = pages.select("url", "html").mapInArrow(_outline, "host string, path string, key binary, hashes binary, kinds binary, lengths binary")
    once = ws.save(made.groupBy("host", "key").agg(F.min("path").alias("path"), F.count("*").alias("n"), *(F.first(c).alias(c) for c in ("hashes", "kinds", "lengths"))), "outlines")
    ranked = numbered(once.drop("n"), ["host", "path", "key"], "rank", ws)
    chunk = F.floor(F.col("rank") / CHUNK).cast("bigint")
    place_ = F.col("rank") % CHUNK
    # a chunk's edge rows also go to the chunk beside it, where they are neighbours only
    around = F.array_compact(F.array(F.lit(0), F.when(place_ < REACH, F.lit(-1)), F.when(place_ >= CHUNK - REACH, F.lit(1))))
    dealt = ranked.withColumn("_by", F.explode(around)).withColumn("chunk", chunk + F.col("_by")).withColumn("home", F.col("_by") == 0)
    near = dealt.select("chunk", "rank", "home", "host", "key", "hashes", "kinds", "lengths").repartition(n, "chunk").sortWithinPartitions("chunk", "rank")
    judged = ws.save(near.mapInArrow(_compare, "host string, key binary, kept binary"), "judged")
    blocks = pages.select("page_id", "url", "html").mapInArrow(_compact, "page_id bigint, url string, host string, key binary, lines binary")
    out = spread_join(blocks, judged, ["host", "key"], once.select("host", "key", "n")).select("page_id", "url", "lines", "kept").mapInArrow(_finish, "page_id bigint, url string, text string")
    return out.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))
