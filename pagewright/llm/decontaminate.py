"""Benchmark passages in documents, found by greedy string tiling.

The benchmark is the query set: it is read in blocks of at most BLOCK_SEEDS seeds, and each block scans every document once.
Seeds (runs of `width` words, hashed) that a document shares with benchmark items select the pairs; each pair is tiled: the
longest matches of unmarked words are marked in both texts, again and again until none of `width` words is left. Marked parts
may stand in any order, so a reordered passage is covered as well as a verbatim one. No document is shuffled: a block's seeds
are bounded, so they travel to the documents.

The longest match is found by running Karp-Rabin: one pass of prefix sums per text gives the hash of a run of any length by
one subtraction and one product, so a length is tried in time in proportion to the texts, whatever repeats in them, and the
greatest length that matches is found by halving. All matches of that length are marked in one go, so the number of passes
follows the number of different tile lengths (their sum is at most the item's length).
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from pagewright.llm.kernels import encode, ngrams, word_hashes

BLOCK_SEEDS = 1 << 21
#: Blocks that one scan of the documents asks for.
TOGETHER = 4
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


class Running:
    """Karp-Rabin hashes of the runs of a text of word hashes, of any length, and which words are marked."""

    def __init__(self, words: np.ndarray):
        n = len(words)
        self.words, self.marked = words, np.zeros(n, bool)
        powers = np.full(n + 1, _BASE, _U)
        back = np.full(n + 1, _INVERSE, _U)
        powers[0] = back[0] = 1
        self.back = np.cumprod(back, dtype=_U)
        self.sums = np.concatenate([np.zeros(1, _U), np.cumsum(words * np.cumprod(powers, dtype=_U)[:n], dtype=_U)])

    def runs(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of the runs without marked words, and their hashes."""
        n = len(self.words) - length + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, _U)
        marks = np.concatenate([[0], np.cumsum(self.marked)])
        at = np.flatnonzero(marks[length:] == marks[:n])
        return at, (self.sums[at + length] - self.sums[at]) * self.back[at]


def tiles(item: np.ndarray, text: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(start in item, start in text, length): longest matches of unmarked words first, ties by place; none overlap."""
    a, b = Running(np.asarray(item, _U)), Running(np.asarray(text, _U))
    out: list[tuple[int, int, int]] = []
    most = min(len(item), len(text))
    while True:
        low, high = least - 1, most  # a length that matches (or is too short to count), and the greatest that may
        while low < high:
            length = (low + high + 1) // 2
            if np.isin(a.runs(length)[1], b.runs(length)[1]).any():
                low = length
            else:
                high = length - 1
        if low < least:
            return out
        (ia, ha), (ib, hb) = a.runs(low), b.runs(low)
        both = np.isin(ha, hb)
        order = np.argsort(hb, kind="stable")
        begin, end = np.searchsorted(hb[order], ha[both]), np.searchsorted(hb[order], ha[both], "right")
        spots, following = ib[order], {}
        for i, low_at, high_at in zip(ia[both].tolist(), begin.tolist(), end.tolist(), strict=True):
            if a.marked[i] or a.marked[i + low - 1]:
                continue
            k = following.get(low_at, low_at)  # places before it are taken for good
            while k < high_at and (b.marked[spots[k]] or b.marked[spots[k] + low - 1]):
                k += 1
            if k < high_at and np.array_equal(a.words[i : i + low], b.words[spots[k] : spots[k] + low]):
                t = int(spots[k])
                a.marked[i : i + low] = True
                b.marked[t : t + low] = True
                out.append((i, t, low))
            following[low_at] = k
        most = low - 1


#: Hash that no word of an item has in a document.
_NONE = _U(0x0123456789ABCDEF)


def _finder(query, width: int, percent: int):
    """Function of a list of texts: (index, item, words of the item, covered, tiles, longest tile) of each hit."""
    seeds, owners, items, shorts = query
    order = np.argsort(seeds, kind="stable")
    seeds, owners = seeds[order], owners[order]
    table = np.zeros(1 << 16, bool)
    table[(seeds >> _U(48)).astype(np.int64)] = True
    briefs: dict[int, dict[int, list[int]]] = {}  # by length: the items of a hash
    for item, (n, h) in shorts.items():
        briefs.setdefault(n, {}).setdefault(h, []).append(item)

    def judged(words: np.ndarray, at: list[int], want: np.ndarray) -> tuple | None:
        # seeds bound what can be covered: fewer than that cannot reach the threshold
        if 100 * min(len(at) * width, len(want)) < percent * len(want):
            return None
        near = np.zeros(len(words) + 1, np.int32)
        np.add.at(near, np.array(at), 1)
        np.add.at(near, np.array(at) + width, -1)
        # words without a seed nearby can be in no tile; one word that equals none stands for each stretch of them
        inside = np.cumsum(near)[:-1] > 0
        keep = inside | np.concatenate([[False], inside[:-1]])
        cut = np.where(inside, words, _NONE)[keep]
        got = tiles(want, cut, width)
        covered = sum(k for *_, k in got)
        return (len(want), covered, len(got), max(k for *_, k in got)) if got and 100 * covered >= percent * len(want) else None

    def find(texts: list[bytes]) -> list[tuple]:
        rows: list[tuple] = []
        for first, words, bounds in word_hashes(texts, True):
            grams = ngrams(words, width)
            maybe = np.flatnonzero(table[(grams >> _U(48)).astype(np.int64)])
            low = np.searchsorted(seeds, grams[maybe])
            real = (low < len(seeds)) & (seeds[np.minimum(low, len(seeds) - 1)] == grams[maybe])
            spots, low = maybe[real], low[real]
            doc = np.searchsorted(bounds, spots, "right") - 1
            inside = spots + width <= bounds[doc + 1]
            places: dict[tuple, list[int]] = defaultdict(list)
            for p, d, at in zip(spots[inside].tolist(), doc[inside].tolist(), low[inside].tolist(), strict=True):
                seed = seeds[at]
                while at < len(seeds) and seeds[at] == seed:
                    places[d, int(owners[at])].append(p - int(bounds[d]))
                    at += 1
            for (d, item), at in sorted(places.items()):
                if (got := judged(words[bounds[d] : bounds[d + 1]], at, items[item])) is not None:
                    rows.append((first + d, item, *got))
            for n, asked in briefs.items():
                grams = ngrams(words, n)
                hits = np.flatnonzero(np.isin(grams, np.array(list(asked), _U)))
                doc = np.searchsorted(bounds, hits, "right") - 1
                for d, p in {(int(d), int(grams[p])) for d, p in zip(doc, hits, strict=True) if p + n <= bounds[d + 1]}:
                    rows += [(first + d, item, n, n, 1, n) for item in asked[p]]
        return rows

    return find


def _scan(queries: list, width: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finders = [_finder(q.value, width, percent) for q in queries]
        for batch in batches:
            rows = [r for find in finders for r in find(encode(batch.column(1).to_pylist()))]
            index = pa.array([r[0] for r in rows], pa.int64())
            cols = [pa.array([r[c] for r in rows], pa.int64()) for c in range(1, 6)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(index), *cols], ["doc_id", "item_id", "n_item_words", "n_covered", "n_tiles", "longest_tile"])

    return run


def _without(queries: list, width: int, percent: int, text: int):
    """The rows of a scan that hold no item of the blocks, all columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finders = [_finder(q.value, width, percent) for q in queries]
        for batch in batches:
            clean = np.ones(batch.num_rows, bool)
            for find in finders:
                clean[[r[0] for r in find(encode(batch.column(text).to_pylist()))]] = False
            yield batch.filter(pa.array(clean))

    return run


def _blocks(benchmark: DataFrame, width: int, block_seeds: int) -> Iterator[tuple[np.ndarray, np.ndarray, dict, dict]]:
    """The benchmark in blocks of at most that many seeds (one item at least), streamed to the driver one partition a time:
    seeds, their items, items' words, and (length, hash) of items that are too short for a seed."""
    seeds, owners, items, shorts, size = [np.zeros(0, _U)], [np.zeros(0, np.int64)], {}, {}, 0
    rows = benchmark.filter("item_id is not null and text is not null").select("item_id", "text").groupBy("item_id", "text").count().toLocalIterator()
    for r in rows:
        for _, words, _ in word_hashes([r["text"].encode("utf-8", "surrogatepass")], True):
            grams = np.unique(ngrams(words, min(width, len(words)))) if len(words) else np.zeros(0, _U)
            if not len(grams):
                continue
            if size and (size + len(grams) > block_seeds or r["item_id"] in items or r["item_id"] in shorts):
                yield np.concatenate(seeds), np.concatenate(owners), items, shorts
                seeds, owners, items, shorts, size = [np.zeros(0, _U)], [np.zeros(0, np.int64)], {}, {}, 0
            if len(words) < width:
                shorts[r["item_id"]] = (len(words), int(grams[0]))
            else:
                seeds.append(grams)
                owners.append(np.full(len(grams), r["item_id"], np.int64))
                items[r["item_id"]] = words
            size += len(grams)
    if size:
        yield np.concatenate(seeds), np.concatenate(owners), items, shorts


_HITS = "doc_id bigint, item_id bigint, n_item_words bigint, n_covered bigint, n_tiles bigint, longest_tile bigint"


def contaminated(docs: DataFrame, benchmark: DataFrame, width: int = 5, percent: int = 80, block_seeds: int = BLOCK_SEEDS) -> DataFrame:
    """A row for each document row and benchmark item of which tiles of `width` words or more cover `percent` of the words.

    doc_id, item_id, n_item_words, n_covered, n_tiles, longest_tile. Words are lower-cased (A-Z). Null texts are empty. Items
    of fewer than `width` words are found where all their words stand in a row (one tile). Items with a null id or without
    words cannot be found and give no row. A repeated document row is found as often as it stands, a repeated item once; items
    that share an id but not a text are searched one by one. Either table may be empty: no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", "text")
    parts = [rows.mapInArrow(_scan([spark.sparkContext.broadcast(b) for b in blocks], width, percent), _HITS) for blocks in _groups(_blocks(benchmark, width, block_seeds))]
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], _HITS)


def _groups(blocks: Iterator) -> Iterator[list]:
    while group := list(islice(blocks, TOGETHER)):
        yield group


def stage(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, width: int = 5, percent: int = 80, block_seeds: int = BLOCK_SEEDS) -> DataFrame:
    """The rows of docs, all columns, without those that hold a benchmark item: each row is judged by its own text, with no
    shuffle. Columns may have any names; `text` is the one searched."""
    out = docs
    for blocks in _groups(_blocks(benchmark, width, block_seeds)):
        out = out.mapInArrow(_without([spark.sparkContext.broadcast(b) for b in blocks], width, percent, docs.columns.index("text")), docs.schema)
    return out
