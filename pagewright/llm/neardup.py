"""Near-duplicate documents by an LSH forest with exact confirmation.

Every text has a MinHash signature, cut into TREES orders of DEPTH values. Each order is one sorted list (a range
partitioned sort on order and signature, so no list sits in one task). Texts that stand near each other in a list and share
a long prefix are candidates: next neighbours from MIN_DEPTH common values on, neighbours further off only where they share
a deeper prefix, so that a crowded region is searched at greater depth than a sparse one. In crowded regions each text is also
a candidate with the region's most central one, and with others that share a shingle which that one has not; together they
stand in for all pairs of the region at a cost in proportion to its size. Candidates are confirmed on full shingle sets.
Confirmation goes in two turns: the two best partners of each text and its leaders first, then every other candidate pair
whose texts are still in different components; a pair inside one component cannot change the result.

Texts with the same words are one node from the start, however many they are, so a group of exact copies costs a row each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from pagewright.llm import bloom
from pagewright.llm.components import components
from pagewright.llm.kernels import encode, mix, ngrams, word_hashes
from pagewright.plans.workspace import Workspace

TREES, DEPTH, MIN_DEPTH, REACH = 16, 8, 4, 8
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def _coefficients(n: int) -> tuple[np.ndarray, np.ndarray]:
    a = mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    b = mix(a)
    return (a.astype(np.uint32) | np.uint32(1)), b.astype(np.uint32)


def shingle_bounds(words: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of consecutive documents and their bounds; a short document's whole sequence is its only shingle."""
    n = np.diff(bounds)
    count = np.where(n >= width, n - width + 1, np.where(n > 0, 1, 0))
    out = np.concatenate([[0], np.cumsum(count)])
    grams = ngrams(words, width)
    shingles = np.zeros(int(out[-1]), np.uint64)
    full = n >= width
    if full.any():
        at = np.repeat(bounds[:-1][full] - out[:-1][full], count[full])
        spots = np.flatnonzero(np.repeat(full, count))
        shingles[spots] = grams[spots + at]
    for d in np.flatnonzero((n > 0) & ~full):
        shingles[out[d]] = mix(np.bitwise_xor.reduce(mix(words[bounds[d] : bounds[d + 1]] + np.arange(int(n[d]), dtype=np.uint64))[None, :], axis=1) + n[d].astype(np.uint64))[0]
    return shingles, out


def _features(width: int):
    a, b = _coefficients(TREES * DEPTH)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = encode(batch.column(1).to_pylist())
            keys, counts, signatures = [], [], []
            for _, words, bounds in word_hashes(texts, True):
                shingles, at = shingle_bounds(words, bounds, width)
                n = np.diff(at)
                full = np.flatnonzero(n)
                sig = np.zeros((len(n), TREES * DEPTH), np.uint16)
                if len(full):
                    low = (shingles >> np.uint64(32)).astype(np.uint32)
                    begin = at[:-1][full]
                    for j in range(TREES * DEPTH):
                        least = np.minimum.reduceat(low * a[j] + b[j], begin)
                        sig[full, j] = (least * np.uint32(0x9E3779B1) >> np.uint32(16)).astype(np.uint16)
                signatures += [row.tobytes() for row in sig.astype(">u2")]
                counts += [len(np.unique(shingles[at[d] : at[d + 1]])) for d in range(len(n))]
                keys += [xxhash.xxh3_128_digest(words[bounds[d] : bounds[d + 1]].tobytes()) for d in range(len(n))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.array(counts, pa.int64()), pa.array(signatures, pa.binary())], ["doc_id", "key", "n_shingles", "signature"])

    return run


def _wanted_texts(wanted):
    """key, text (packed for the shuffle) of the texts whose key may be wanted; within a task each goes out once, so that
    copies do not meet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep, pack = bloom.Bloom(*wanted.value), zstandard.ZstdCompressor(level=3)
        seen: set[bytes] = set()
        for batch in batches:
            texts = encode(batch.column(0).to_pylist())
            keys = [xxhash.xxh3_128_digest(words[bounds[d] : bounds[d + 1]].tobytes()) for _, words, bounds in word_hashes(texts, True) for d in range(len(bounds) - 1)]
            short = np.array([xxhash.xxh64_intdigest(k, 42) for k in keys], np.uint64)
            new = keep.has(short)
            for i in np.flatnonzero(new).tolist():
                new[i] = keys[i] not in seen
                seen.add(keys[i])
            out = np.flatnonzero(new).tolist()
            yield pa.RecordBatch.from_arrays([pa.array([keys[i] for i in out], pa.binary()), pa.array([pack.compress(texts[i]) for i in out], pa.binary())], ["key", "text"])

    return run


def _neighbours(limit: float):
    """Candidate pairs among the rows of one sorted partition; its first and last REACH rows go out too (flag edge)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail, first, left = None, True, []
        for batch in batches:
            if not batch.num_rows:
                continue
            tree = np.asarray(batch.column("tree"))
            prefix = np.frombuffer(b"".join(batch.column("prefix").to_pylist()), ">u2").reshape(-1, DEPTH).astype(np.uint16)
            key = np.array(batch.column("key").to_pylist() + [None], object)[:-1]
            size = np.asarray(batch.column("n_shingles"))
            part = np.asarray(batch.column("part"))
            if first:
                left = [(int(tree[i]), prefix[i].astype(">u2").tobytes(), key[i], int(size[i]), int(part[i])) for i in range(min(REACH, len(tree)))]
            old = 0
            if tail is not None:
                tree, prefix, key, size, part = (np.concatenate(p) for p in zip(tail, (tree, prefix, key, size, part), strict=True))
                old = len(tail[0])
            yield _pairs(tree, prefix, key, size, part, old, limit, False)
            first = False
            tail = tuple(x[-REACH:] for x in (tree, prefix, key, size, part))
        if tail is not None:
            right = [(int(t), p.astype(">u2").tobytes(), k, int(s), int(g)) for t, p, k, s, g in zip(*tail, strict=True)]
            rows = left + [r for r in right if r not in left]
            yield _edge_rows(rows)

    return run


_PAIR = pa.schema([("a", pa.binary()), ("b", pa.binary()), ("depth", pa.int32()), ("tree", pa.int32()), ("prefix", pa.binary()), ("n_shingles", pa.int64()), ("part", pa.int32())])


def _pairs(tree, prefix, key, size, part, old, limit, across) -> pa.RecordBatch:
    """Pairs at a distance of up to REACH rows; the d-th next row must share MIN_DEPTH + log2(d) values at least."""
    a, b, depth = [], [], []
    for d in range(1, REACH + 1):
        if len(tree) <= d:
            break
        i = np.arange(max(0, old - d), len(tree) - d)
        j = i + d
        lcp = np.where((prefix[i] != prefix[j]).any(axis=1), (prefix[i] != prefix[j]).argmax(axis=1), DEPTH)
        low, high = np.minimum(size[i], size[j]), np.maximum(size[i], size[j])
        good = (tree[i] == tree[j]) & (lcp >= min(DEPTH, MIN_DEPTH + d.bit_length() - 1)) & (low >= limit * high - 1e-9)
        if across:
            good &= part[i] != part[j]
        for x, y, z in zip(key[i[good]], key[j[good]], lcp[good], strict=True):
            if x != y:
                a.append(min(x, y))
                b.append(max(x, y))
                depth.append(int(z))
    n = len(a)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(depth, pa.int32()), *(pa.nulls(n, f.type) for f in list(_PAIR)[3:])], schema=_PAIR)


def _edge_rows(rows: list[tuple]) -> pa.RecordBatch:
    n = len(rows)
    t, p, k, s, g = zip(*rows, strict=True) if rows else ((),) * 5
    return pa.RecordBatch.from_arrays([pa.array(k, pa.binary()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.int32()), pa.array(t, pa.int32()), pa.array(p, pa.binary()), pa.array(s, pa.int64()), pa.array(g, pa.int32())], schema=_PAIR)


def _across(limit: float):
    """Pairs that a partition boundary parts: the few edge rows of all partitions, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for batch in batches for r in batch.to_pylist()]
        if rows:
            order = sorted(rows, key=lambda r: (r["tree"], r["prefix"], r["key"]))
            prefix = np.frombuffer(b"".join(r["prefix"] for r in order), ">u2").reshape(-1, DEPTH).astype(np.uint16)
            key = np.array([r["key"] for r in order] + [None], object)[:-1]
            yield _pairs(np.array([r["tree"] for r in order]), prefix, key, np.array([r["n_shingles"] for r in order]), np.array([r["part"] for r in order]), 0, limit, True).select(["a", "b", "depth"])

    return run


def _tree_rows(nodes: DataFrame) -> DataFrame:
    width = DEPTH * 2
    trees = F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: F.struct(t.cast("int").alias("tree"), F.substring(F.col("signature"), t * width + 1, F.lit(width)).alias("prefix")))
    return nodes.filter("n_shingles > 0").select("key", "n_shingles", F.explode(trees).alias("t")).select("t.tree", "t.prefix", "key", "n_shingles")


def candidates(rows: DataFrame, ws: Workspace, limit: float) -> DataFrame:
    """(a, b, votes, depth): neighbours in the sorted orders. rows: _tree_rows of one row a distinct text."""
    n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    ordered = rows.repartitionByRange(n, "tree", "prefix", "key").sortWithinPartitions("tree", "prefix", "key").withColumn("part", F.spark_partition_id())
    found = ws.save(ordered.mapInArrow(_neighbours(limit), "a binary, b binary, depth int, tree int, prefix binary, n_shingles bigint, part int"), "neighbours")
    # 2 * REACH rows a partition: bounded by the number of partitions, not by the documents
    edges = found.filter("b is null").select(F.col("a").alias("key"), "tree", "prefix", "n_shingles", "part").coalesce(1)
    far = edges.mapInArrow(_across(limit), "a binary, b binary, depth int")
    return found.filter("b is not null").select("a", "b", "depth").unionByName(far).groupBy("a", "b").agg(F.count("*").alias("votes"), F.max("depth").alias("depth"))


def leaders(rows: DataFrame, ws: Workspace) -> DataFrame:
    """(key, leader): the texts of crowded regions, where neighbours in order are not all that share a prefix, with the most
    central text of the region: the one whose whole signatures are the most common in the trees."""
    here = rows.withColumn("region", F.substring("prefix", 1, MIN_DEPTH * 2))
    crowded = here.groupBy("tree", "region").agg(F.count("*").alias("members")).filter(F.col("members") > REACH + 1).select("tree", "region")
    inside = ws.save(here.join(crowded, ["tree", "region"], "left_semi").select("tree", "region", "prefix", "key"), "crowded")
    runs = inside.groupBy("tree", "prefix").agg(F.count("*").alias("run"))
    score = inside.join(runs, ["tree", "prefix"]).groupBy("key").agg(F.sum("run").alias("score"))
    best = inside.join(score, "key").groupBy("tree", "region").agg(F.max_by("key", F.struct("score", "key")).alias("leader"))
    return inside.join(best, ["tree", "region"]).filter("key != leader").select("key", "leader").distinct()


def _confirm(width: int, percent: int):
    """a, b, linked: whether a pair's full shingle sets meet the threshold. If one of them leads a region (lead: 1 for a, 2 for
    b), also the other one's shingles that the leader has not, unless the two have little in common."""

    def shingles(text: bytes) -> set:
        w = text.translate(_LOWER).split()
        return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        last, sets = None, None
        for batch in batches:
            a, b, ta, tb, lead = (batch.column(c) for c in ("a", "b", "text_a", "text_b", "lead"))
            linked, own = [], []
            for i in range(batch.num_rows):
                if a[i].as_py() != last:
                    last, sets = a[i].as_py(), shingles(unpack(ta[i].as_py()))
                other = shingles(unpack(tb[i].as_py()))
                both = len(sets & other)
                union = len(sets) + len(other) - both
                linked.append(100 * both >= percent * union)
                first = lead[i].as_py()
                rest = (other - sets if first == 1 else sets - other) if first and 3 * both >= union else ()
                own.append([xxhash.xxh64_intdigest(b" ".join(s)) - (1 << 63) for s in rest])
            yield pa.RecordBatch.from_arrays([a, b, pa.array(linked, pa.bool_()), lead, pa.array(own, pa.list_(pa.int64()))], ["a", "b", "linked", "lead", "own"])

    return run


def confirm(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """a, b, linked, lead, own for pairs (a, b, lead). texts: key, text, one row a key."""
    one = pairs.join(texts.select(F.col("key").alias("a"), F.col("text").alias("text_a")), "a")
    two = one.join(texts.select(F.col("key").alias("b"), F.col("text").alias("text_b")), "b")
    return two.select("a", "b", "text_a", "text_b", "lead").mapInArrow(_confirm(width, percent), "a binary, b binary, linked boolean, lead int, own array<bigint>")


def _apart(judged: DataFrame) -> DataFrame:
    """(a, b) for texts of a crowded region that share a shingle which their leader has not: such texts can be near each other
    and far from the leader. Of each shingle's texts every one is paired with the one of fewest such shingles."""
    each = judged.filter("size(own) > 0").select(F.when(F.col("lead") == 1, F.col("b")).otherwise(F.col("a")).alias("key"), F.size("own").alias("n"), F.explode("own").alias("shingle"))
    head = each.groupBy("shingle").agg(F.min_by("key", F.struct("n", "key")).alias("head"), F.count("*").alias("texts")).filter("texts > 1").select("shingle", "head")
    return each.join(head, "shingle").filter("key != head").select(F.least("key", "head").alias("a"), F.greatest("key", "head").alias("b")).distinct()


def near_duplicates(docs: DataFrame, ws: Workspace, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs (doc_id, text; other columns are ignored).

    Two texts are linked if 100 * |A & B| >= percent * |A | B| over their sets of distinct shingles of `width` lower-cased
    words; a text with fewer words has its whole sequence as its only shingle. component_id is the least doc_id that a row
    reaches over links, kept tells whether it is the row's own. Null and wordless texts: an empty set, linked with nothing,
    each row its own component. Rows that repeat a doc_id with the same text are one document, and all of them say kept.
    A null doc_id never becomes a component_id unless all of the component's are null; kept is then true. No rows, no result.
    """
    out = _judged(docs, ws, width, percent)
    return out.select("doc_id", "n_shingles", "component_id").withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _judged(docs: DataFrame, ws: Workspace, width: int, percent: int) -> DataFrame:
    """doc_id, key (of the text's words), n_shingles, component (a key), component_id for each row of docs."""
    features = ws.save(docs.select("doc_id", "text").mapInArrow(_features(width), "doc_id bigint, key binary, n_shingles bigint, signature binary"), "features")
    nodes = features.groupBy("key").agg(F.max("n_shingles").alias("n_shingles"), F.min("doc_id").alias("least"), F.max("signature").alias("signature"))
    rows = _tree_rows(nodes)
    found = ws.save(candidates(rows, ws, percent / 100), "candidates")
    led = ws.save(leaders(rows, ws).select(F.least("key", "leader").alias("a"), F.greatest("key", "leader").alias("b"), F.when(F.col("leader") < F.col("key"), 1).otherwise(2).alias("lead")), "leaders")
    used = ws.save(found.select("a", "b").unionByName(led.select("a", "b")).select(F.explode(F.array("a", "b")).alias("key")).distinct(), "used")
    # the filter is bounded in size and only spares the shuffle of texts without candidates; the join after it is exact
    wanted = docs.sparkSession.sparkContext.broadcast(bloom.build(used.select(F.xxhash64("key").alias("short")), used.count()))
    keyed = docs.select("text").mapInArrow(_wanted_texts(wanted), "key binary, text binary")
    texts = ws.save(keyed.groupBy("key").agg(F.min("text").alias("text")).join(used, "key", "left_semi"), "texts")
    wanted.destroy()
    ends = found.select(F.col("a").alias("x"), "a", "b", "votes", "depth").unionByName(found.select(F.col("b").alias("x"), "a", "b", "votes", "depth"))
    order = Window.partitionBy("x").orderBy(F.desc("votes"), F.desc("depth"), "a", "b")
    best = ends.withColumn("rank", F.row_number().over(order)).filter("rank <= 2").select("a", "b", F.lit(0).alias("lead"))
    judged = ws.save(confirm(best.unionByName(led).groupBy("a", "b").agg(F.max("lead").alias("lead")), texts, width, percent), "judged")
    first = ws.save(components(judged.filter("linked"), ws), "components")
    both = found.select("a", "b").unionByName(_apart(judged)).distinct()
    rest = (
        both.join(first.select(F.col("node").alias("a"), F.col("component").alias("ca")), "a", "left").join(first.select(F.col("node").alias("b"), F.col("component").alias("cb")), "b", "left")
        .filter("ca is null or cb is null or ca != cb").select("a", "b").join(judged.select("a", "b"), ["a", "b"], "left_anti")
    )
    more = ws.save(confirm(rest.withColumn("lead", F.lit(0)), texts, width, percent).filter("linked").select("a", "b"), "links")
    ws.drop(texts)
    whole = components(first.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more), ws)
    grouped = nodes.select("key", "least").join(whole.withColumnRenamed("node", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))
    least = grouped.groupBy("component").agg(F.min("least").alias("component_id"))
    places = ws.save(grouped.select("key", "component").join(least, "component").select("key", "component", "component_id"), "places")
    out = features.select("doc_id", "key", "n_shingles").join(places, "key", "left")
    own = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "key", "n_shingles", "component", own.alias("component_id"))


def _with_key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = [xxhash.xxh3_128_digest(words[bounds[d] : bounds[d + 1]].tobytes()) for _, words, bounds in word_hashes(encode(batch.column(1).to_pylist()), True) for d in range(len(bounds) - 1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary())], ["row", "key"])


def stage(spark: SparkSession, docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, all columns, whatever their names, of which one a component stays.

    The row that stays is judged by its id and its text: of the least id in the component the text whose key comes first, of
    rows that repeat both the one whose columns' hash does. Rows that share an id but hold texts of different components all
    stay, or go, by their own text; of wordless rows one an id stays. Rows without an id cannot be told from others by it and
    stay."""
    ws = Workspace(spark, "neardup-stage")
    verdict = ws.save(_judged(docs, ws, width, percent).filter("doc_id is not null and doc_id = component_id"), "verdict")
    each = verdict.groupBy("doc_id", "component", "key").agg(F.count("*").alias("n"))
    stays = ws.save(each.groupBy("doc_id", "component").agg(F.min(F.struct("key", "n")).alias("first")).select("doc_id", "first.key", "first.n"), "stays")
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), "text")
    keyed = packed.mapInArrow(_with_key, T.StructType([packed.schema["row"], T.StructField("key", T.BinaryType())])).withColumn("doc_id", F.col("row")["doc_id"])
    once = keyed.join(stays.filter("n = 1"), ["doc_id", "key"], "left_semi").select("row")
    again = keyed.join(stays.filter("n > 1"), ["doc_id", "key"], "left_semi").groupBy("doc_id", "key").agg(F.min_by("row", F.xxhash64("row")).alias("row")).select("row")
    without = packed.filter(F.col("row")["doc_id"].isNull()).select("row")
    return once.unionByName(again).unionByName(without).select(*(F.col("row")[c].alias(c) for c in docs.columns))
