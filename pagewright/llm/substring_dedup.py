"""Repeated passages removed from documents: a relative Lempel-Ziv parse against an index of anchored reference blocks.

In each window of WINDOW words the first least hash of GRAM consecutive words is the window's anchor, so equal windows have
equal anchors at equal places, wherever they stand. The words around one anchor that are ruled by it (its up to WINDOW - GRAM +
1 windows) are a reference block, and the anchor is the index: a block of a document meets the blocks of its own anchor, of the
whole corpus, and no others. Factoring every document against every block in turn grows with the square of the corpus; here
the work is in proportion to the text, and a passage that thousands share is one row of the index.

A document is parsed from left to right. Where a block stands at another place too, a factor begins: it runs on through the
blocks that follow for as long as the same reference goes on with the same words, and of a block's references the one that
goes on longer is taken. The first and the last place of a block stand for all of its places, so a factor may be cut shorter
than the longest match; what it leaves begins the next factor one window further on, so no repeated window is lost. Factors
have WINDOW words at least. At their boundaries, where only a part of a block recurs, the block's single windows are looked up
among those of all blocks of the anchor. Factors and these windows are the duplicate spans.

A Bloom filter of the anchors that occur twice, bounded in size, keeps unique text out of the shuffle; its false positives
only cost rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm import bloom
from pagewright.llm.kernels import combine, encode, mix, ngrams, word_hashes
from pagewright.plans.skew import spread_join
from pagewright.plans.workspace import Workspace

GRAM = 8
#: Distinct blocks that a task remembers having sent; beyond it, it forgets and sends some again.
REMEMBERED = 1 << 19
_U = np.uint64


def _least(g: np.ndarray, width: int) -> np.ndarray:
    """For each run of width entries the place of its first least one."""
    value, place = g, np.arange(len(g))
    best_v, best_p, done, size, m = None, None, 0, 1, len(g) - width + 1
    while True:
        if width & size:
            v, p = value[done : done + m], place[done : done + m]
            if best_v is None:
                best_v, best_p = v, p
            else:
                worse = v < best_v
                best_v, best_p = np.where(worse, v, best_v), np.where(worse, p, best_p)
            done += size
        if done == width:
            return best_p
        later = value[size:] < value[:-size]
        value, place = np.where(later, value[size:], value[:-size]), np.where(later, place[size:], place[:-size])
        size *= 2


def blocks(words: np.ndarray, bounds: np.ndarray, window: int) -> tuple[np.ndarray, ...] | None:
    """(document, anchor's place, first window, last window, anchor's hash) of the reference blocks of some documents."""
    n = len(words) - window + 1
    if n <= 0:
        return None
    gram = min(GRAM, window)
    grams = ngrams(words, gram)
    at = _least(mix(grams), window - gram + 1)
    doc = np.searchsorted(bounds, np.arange(n), "right") - 1
    valid = np.flatnonzero(np.arange(n) + window <= bounds[doc + 1])
    if not len(valid):
        return None
    new = np.flatnonzero((np.diff(at[valid], prepend=-1) != 0) | (np.diff(valid, prepend=-2) != 1))
    first = valid[new]
    last = valid[np.append(new[1:], len(valid)) - 1]
    return doc[first], at[first], first, last, combine(grams[at[first]], grams[at[first]])


def _anchors(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, words, bounds in word_hashes(encode(batch.column(0).to_pylist()), False):
                if (found := blocks(words, bounds, window)) is not None:
                    anchor, n = np.unique(found[4], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(n)], ["anchor", "n"])

    return run


def text_key(text: bytes) -> bytes:
    return xxhash.xxh3_128_digest(text)


_BLOCK = "anchor bigint, block bigint, key binary, place int, windows binary, low int, n bigint"


def _occurrences(window: int, filter_of):
    """Blocks whose anchor may occur twice: a row an occurrence (key, place), and once a task the block's window hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = bloom.Bloom(*filter_of.value)
        sent: set[int] = set()
        for batch in batches:
            texts = encode(batch.column(0).to_pylist())
            for i, words, bounds in word_hashes(texts, False):
                if (found := blocks(words, bounds, window)) is None:
                    continue
                good = keep.has(found[4])
                doc, at, first, last, anchor = (x[good] for x in found)
                if not len(doc):
                    continue
                full = ngrams(words, window)
                block = combine(combine(full[first], full[last]), mix((last - first).astype(_U) * _U(1 << 20) + (at - first).astype(_U)))
                keys = {d: text_key(texts[i + d]) for d in np.unique(doc).tolist()}
                fresh = []
                for b in block.tolist():
                    fresh.append(b not in sent)
                    sent.add(b)
                if len(sent) > REMEMBERED:
                    sent.clear()
                windows = [full[f : t + 1].tobytes() if new else None for f, t, new in zip(first.tolist(), last.tolist(), fresh, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor.view(np.int64)), pa.array(block.view(np.int64)), pa.array([keys[d] for d in doc.tolist()], pa.binary()), pa.array(at - bounds[doc], pa.int32()), pa.array(windows, pa.binary()), pa.array(at - first, pa.int32()), pa.array(np.ones(len(doc), np.int64))],
                    ["anchor", "block", "key", "place", "windows", "low", "n"],
                )

    return run


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row a window of each block: bit is low minus the window's distance from the first one."""
    for batch in batches:
        blobs = batch.column("windows").to_pylist()
        count = np.array([len(b) // 8 for b in blobs], np.int64)
        if not count.sum():
            continue
        at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        wide = [np.repeat(np.asarray(batch.column(c)), count) for c in ("anchor", "block", "n", "low")]
        yield pa.RecordBatch.from_arrays([pa.array(wide[0]), pa.array(wide[1]), pa.array(np.frombuffer(b"".join(blobs), np.int64)), pa.array(at.astype(np.int32)), pa.array(wide[2])], ["anchor", "block", "hash", "nth", "n"])


def factored(own: bytes, spans: list[dict], window: int) -> tuple[list[tuple], list[int]]:
    """(factors, boundary windows) of the text of key own: factors are (first word, words, reference's key, its first word).
    A place is no reference of its own, unless the text stands again elsewhere and has no other."""
    whole, single = [], []
    for s in spans:
        first = s["place"] - s["low"]
        if s["one"] is None:
            single += [first + k for k in range(window) if (s["mask"] >> k) & 1]
        else:
            places = {(bytes(r["key"]), r["place"] - s["place"]) for r in (s["one"], s["other"])}
            whole.append((first, first + s["mask"].bit_length() - 1, places - {(own, 0)} or places))
    whole.sort(key=lambda b: b[:2])
    out, i = [], 0
    while i < len(whole):
        first, last, live = whole[i]
        i += 1
        # references are texts and shifts: one that the next block, right behind this one, also has goes on
        while i < len(whole) and whole[i][0] == last + 1 and (on := live & whole[i][2]):
            last, live = whole[i][1], on
            i += 1
        key, shift = min(live)
        out.append((first, last - first + window, key, first + shift))
    return out, sorted(single)


def _removed(window: int):
    """doc_id, text, n_words, n_removed and the kept words of each document, given its factors as packed spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept_texts, n_words, n_removed = [], [], []
            for text, spans in zip(encode(batch.column(1).to_pylist()), batch.column(2).to_pylist(), strict=True):
                words = text.split()
                if spans:
                    mark = np.zeros(len(words) + 1, np.int32)
                    factors, single = factored(text_key(text), spans, window)
                    ends = [(f[0], f[0] + f[1]) for f in factors] + [(p, p + window) for p in single]
                    np.add.at(mark, [b for b, _ in ends], 1)
                    np.add.at(mark, [e for _, e in ends], -1)
                    keep = np.cumsum(mark)[:-1] == 0
                    n_removed.append(int(len(words) - keep.sum()))
                    kept_texts.append(b" ".join(w for w, k in zip(words, keep.tolist(), strict=True) if k).decode("utf-8", "replace"))
                else:
                    n_removed.append(0)
                    kept_texts.append(b" ".join(words).decode("utf-8", "replace"))
                n_words.append(len(words))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept_texts, pa.string())], ["doc_id", "n_words", "n_removed", "kept_text"])

    return run


def _parsed(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape = pa.list_(pa.struct([("start", pa.int32()), ("words", pa.int32()), ("ref_key", pa.binary()), ("ref_start", pa.int32())]))
        for batch in batches:
            both = [factored(key, spans, window) for key, spans in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            named = [[dict(zip(("start", "words", "ref_key", "ref_start"), f, strict=True)) for f in factors] for factors, _ in both]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(named, shape), pa.array([b for _, b in both], pa.list_(pa.int32()))], ["key", "factors", "boundary_windows"])

    return run


def parsed(docs: DataFrame, ws: Workspace, window: int = 50) -> DataFrame:
    """key (hash of the text), factors (start, words, ref_key, ref_start), boundary_windows (first words) of each text of docs
    in which something recurs."""
    shape = "key binary, factors array<struct<start:int,words:int,ref_key:binary,ref_start:int>>, boundary_windows array<int>"
    return repeated_blocks(docs, ws, window).mapInArrow(_parsed(window), shape)


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = [text_key(t) for t in encode(batch.column(1).to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.binary())], ["doc_id", "text", "key"])


def _text_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([text_key(t) for t in encode(batch.column(0).to_pylist())], pa.binary())], ["key"])


def repeated_blocks(docs: DataFrame, ws: Workspace, window: int) -> DataFrame:
    """key (hash of the text), spans: array of (place, low, mask, one, other) of each text: the blocks whose windows start
    elsewhere too. one, other: first and last place (key, place of the anchor) of a block that recurs whole, null elsewhere."""
    if not 1 <= window <= 60 + GRAM:
        raise ValueError("window must be 1 to 68 words")
    spark = docs.sparkSession
    text = docs.select("text")
    anchors = ws.save(text.mapInArrow(_anchors(window), "anchor bigint, n bigint").groupBy("anchor").agg(F.sum("n").alias("n")).filter("n > 1").select("anchor"), "anchors")
    twice = spark.sparkContext.broadcast(bloom.build(anchors, anchors.count()))
    seen = ws.save(text.mapInArrow(_occurrences(window, twice), _BLOCK), "occurrences")
    twice.destroy()
    ws.drop(anchors)
    each = ws.save(seen.groupBy("anchor", "block").agg(F.sum("n").alias("n"), F.max("windows").alias("windows"), F.max("low").alias("low"), F.min(F.struct("key", "place")).alias("one"), F.max(F.struct("key", "place")).alias("other")), "blocks")
    # where an anchor has several blocks and one of them occurs once, single windows decide; elsewhere whole blocks do
    mixed = each.groupBy("anchor").agg(F.count("*").alias("kinds"), F.min("n").alias("least")).filter("kinds > 1 and least = 1").select("anchor")
    single = ws.save(each.join(mixed, "anchor", "left_semi").select("anchor", "block", "windows", "low", "n").mapInArrow(_unpack, "anchor bigint, block bigint, hash bigint, nth int, n bigint"), "windows")
    again = single.groupBy("anchor", "hash").agg(F.sum("n").alias("total")).filter("total > 1").select("anchor", "hash")
    parts = single.filter("n = 1").join(again, ["anchor", "hash"], "left_semi").groupBy("anchor", "block").agg(F.sum(F.expr("shiftleft(1L, nth)")).alias("mask")).withColumns({c: F.lit(None).cast("struct<key:binary,place:int>") for c in ("one", "other")})
    whole = each.filter("n > 1").select("anchor", "block", (F.expr("shiftleft(1L, cast(octet_length(windows) / 8 as int))") - 1).alias("mask"), "one", "other")
    masks = ws.save(whole.unionByName(parts), "masks")
    spans = spread_join(seen.select("anchor", "block", "key", "place", "low"), masks, ["anchor", "block"], each.select("anchor", "block", "n"), "inner")
    return spans.groupBy("key").agg(F.collect_set(F.struct("place", "low", "mask", "one", "other")).alias("spans"))


def remove_repeats(docs: DataFrame, ws: Workspace, window: int = 50) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text for each row of docs (doc_id, text; other columns are ignored).

    Words are runs of characters other than space and 0x09-0x0D, compared unchanged. A word goes if a window of `window`
    consecutive words that covers it has a word sequence that also starts at another place, in the same row or another one;
    windows are judged on the input. kept_text joins what stays by one space. Null and empty texts: no words, empty text.
    Rows that repeat another row, null doc_id or not, are other places: all their windows recur. No rows, no result.
    """
    spans = ws.save(repeated_blocks(docs, ws, window), "spans")
    copies = ws.save(docs.select("text").mapInArrow(_text_keys, "key binary").groupBy("key").agg(F.count("*").alias("n")), "copies")
    keyed = docs.select("doc_id", "text").mapInArrow(_keyed, "doc_id bigint, text string, key binary")
    joined = spread_join(keyed, spans, ["key"], copies).select("doc_id", "text", "spans")
    return joined.mapInArrow(_removed(window), "doc_id bigint, n_words bigint, n_removed bigint, kept_text string")
