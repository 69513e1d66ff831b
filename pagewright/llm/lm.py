"""Language-model scores from a log-frequency Bloom filter.

Counts of words and word pairs are gathered from the training rows in one shuffle: tasks send them as packed, sorted arrays,
one row for each of a number of ranges of the hash that follows the size of the text. A count c is kept as its level,
1 + floor(log(c) / log(BASE)), by setting the keys (n-gram, 1), (n-gram, 2) ... (n-gram, level) in one Bloom filter. A reader
probes levels from 1 on until one fails or the greatest level stored is reached; false positives only raise a level. The
filter grows with the entries, at fixed bits a key. Up to FILTER_BYTES it is broadcast, and so is the vocabulary that the
plain unigram score beside it needs, up to MOST_BROADCAST words. Beyond either, filter and vocabulary stay cut by ranges of the
n-gram's hash (all levels of an n-gram lie in one block): tasks send the distinct n-grams of a chunk of texts to the ranges,
each range is probed where its blocks are, and levels and exact counts of words go back to the chunk.

Probability of a word after its predecessor: weight * low(pair) / high(predecessor) + (1 - weight) * (low(word) + 0.5) /
(N + 0.5 * (V + 1)), where low and high are the least and greatest counts of a level: what a history gives out never exceeds 1
but for false positives.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.llm import bloom
from pagewright.llm.kernels import combine, encode, mix, word_hashes
from pagewright.plans.workspace import Workspace

BASE = 1.5
MOST_BROADCAST = 1 << 23
FILTER_BYTES = 1 << 26  # of a filter that is broadcast
SHARD_BYTES = 1 << 24  # of a range of a greater one
BUCKET_BYTES = 1 << 21  # of text whose n-grams meet in one range of counts
FLUSH = 1 << 21
ASKED = 12 << 20  # bytes of a chunk of texts
WORDS, PAIRS = 1, 2
_U = np.uint64
END, BEGIN = mix(np.array([0xE0F, 0xB0F], _U))


def levels_low(level: np.ndarray) -> np.ndarray:
    """Least count of each level; level 0: 0."""
    return np.where(level > 0, np.ceil(BASE ** np.maximum(level - 1, 0) - 1e-9), 0.0)


def levels_high(level: np.ndarray) -> np.ndarray:
    return np.where(level > 0, np.maximum(np.ceil(BASE ** np.asarray(level, float) - 1e-9) - 1, 1), 0.0)


def level_of(count: np.ndarray) -> np.ndarray:
    level = np.maximum(1 + np.floor(np.log(np.maximum(count, 1)) / np.log(BASE)).astype(np.int64), 1)
    level -= count < levels_low(level)
    level += count >= levels_low(level + 1)
    return np.where(count >= 1, level, 0)


def tokens(words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens with an end after each document, each one's predecessor, and the bounds of the documents."""
    docs = len(bounds) - 1
    out = np.full(len(words) + docs, END, _U)
    at = bounds + np.arange(docs + 1)
    inside = np.ones(len(out), bool)
    inside[at[1:] - 1] = False
    out[inside] = words
    before = np.empty_like(out)
    before[1:] = out[:-1]
    before[at[:-1]] = BEGIN
    return out, before, at


def packed(keys: np.ndarray) -> bytes:
    """Sorted keys in few bytes: how many trailing bits are 0 in all, then the differences without them, byte by byte of all,
    compressed."""
    some = int(np.bitwise_or.reduce(keys)) if len(keys) else 0
    shift = (some & -some).bit_length() - 1 if some else 0
    return bytes([shift]) + zstandard.ZstdCompressor(level=1).compress(np.diff(keys >> _U(shift), prepend=_U(0)).view(np.uint8).reshape(-1, 8).T.tobytes())


def opened(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).reshape(-1).view(_U), dtype=_U) << _U(data[0])


def _small(counts: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(counts.tobytes())


def _large(data: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)


def leading(keys: np.ndarray, width: int) -> np.ndarray:
    """The leading bits of keys, the others 0: what the filter knows of an n-gram."""
    return keys >> _U(64 - width) << _U(64 - width)


def _cut(keys: np.ndarray, bits: int) -> Iterator[tuple[int, int, int]]:
    """(range, begin, end) of sorted keys by their leading bits."""
    where = (keys >> _U(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
    begins = np.flatnonzero(np.diff(where, prepend=-1))
    return zip(where[begins].tolist(), begins.tolist(), np.append(begins[1:], len(keys)).tolist(), strict=True)


def _sent(kind: int, keys: list[np.ndarray], bits: int) -> pa.RecordBatch:
    code, key = pd.factorize(np.concatenate(keys))
    n = np.bincount(code, minlength=len(key))
    order = np.argsort(key)
    key, n = key[order], n[order]
    rows = [(kind, where, packed(key[a:b]), _small(n[a:b])) for where, a, b in _cut(key, bits)]
    cols = list(zip(*rows, strict=True)) or [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.binary()), pa.array(cols[3], pa.binary())], ["kind", "bucket", "keys", "counts"])


def _pairs(token: np.ndarray, before: np.ndarray, width: int) -> np.ndarray:
    return leading(combine(before, token), width)


def _gather(bits: int, width: int):
    """Counts of words (kind 1) and of pairs (kind 2) of a task's training texts, packed by ranges of the hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {WORDS: [], PAIRS: []}
        size = 0
        for batch in batches:
            for _, words, bounds in word_hashes(encode(batch.column(0).to_pylist()), True):
                token, before, _ = tokens(words, bounds)
                held[WORDS].append(token)
                held[PAIRS].append(_pairs(token, before, width))
                size += len(token)
                if size >= FLUSH:
                    for kind, keys in held.items():
                        yield _sent(kind, keys, bits)
                    held, size = {WORDS: [], PAIRS: []}, 0
        if size:
            for kind, keys in held.items():
                yield _sent(kind, keys, bits)

    return run


def _added(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key, n = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    first = np.flatnonzero(np.diff(key, prepend=key[0] ^ _U(1)) != 0)
    return key[first], np.add.reduceat(n, first)


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a range: its keys with their whole counts; rows come sorted by kind and bucket. Parts are added up as they come,
    so memory follows the range's distinct keys."""

    def made(kind: int, bucket: int, keys: list, counts: list) -> pa.RecordBatch:
        key, n = _added(keys, counts)
        level = level_of(n)
        facts = [pa.array([x]) for x in (len(key), int(n.sum()), int(level.sum()), int(level.max(initial=0)))]
        return pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), pa.array([bucket], pa.int32()), pa.array([packed(key)], pa.binary()), pa.array([_small(n)], pa.binary()), *facts], ["kind", "bucket", "keys", "counts", "n_keys", "total", "entries", "top"])

    now, keys, counts, size, base = None, [], [], 0, 0
    for batch in batches:
        for kind, bucket, k, c in zip(*(batch.column(x).to_pylist() for x in ("kind", "bucket", "keys", "counts")), strict=True):
            if (kind, bucket) != now:
                if now is not None:
                    yield made(*now, keys, counts)
                now, keys, counts, size, base = (kind, bucket), [], [], 0, 0
            keys.append(opened(k))
            counts.append(_large(c, np.int64))
            size += len(keys[-1])
            if size > 2 * base + FLUSH:
                key, n = _added(keys, counts)
                keys, counts, size, base = [key], [n], len(key), len(key)
    if now is not None:
        yield made(*now, keys, counts)


def level_key(keys: np.ndarray, level: int, cut: int) -> np.ndarray:
    """Keys of a level in the filter; the leading bits, and so the block, are the n-gram's own."""
    rest = _U(64 - cut)
    return keys >> rest << rest | combine(keys, np.array([level], _U)) >> _U(cut)


def levels(filter_: bloom.Bloom, keys: np.ndarray, top: int) -> np.ndarray:
    """Level of each n-gram by repeated probes, up to the greatest level stored."""
    out, live, j = np.zeros(len(keys), np.int64), np.arange(len(keys)), 1
    while len(live) and j <= top:
        live = live[filter_.has(level_key(keys[live], j, filter_.cut))]
        out[live] = j
        j += 1
    return out


def _level_keys(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                key, level = leading(opened(keys), width), level_of(_large(counts, np.int64))
                for j in range(1, int(level.max()) + 1 if len(level) else 1):
                    yield pa.RecordBatch.from_arrays([pa.array(level_key(key[level >= j], j, bloom.BLOCK_BITS).view(np.int64))], ["key"])

    return run


#: Kinds of rows: to a range go bits of a block, words with counts, a chunk's sign, words and pairs asked for; to a chunk go its
#: texts, their sign, levels and counts of words, levels of pairs.
BITS, COUNTS, SIGN, ASK_WORDS, ASK_PAIRS = range(5)
TEXTS, ITS_SIGN, WORD_LEVELS, WORD_COUNTS, PAIR_LEVELS = range(5)
_ROW = "chunk bigint, shard int, kind int, place int, data binary"


def _row_batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()), strict=True)], ["chunk", "shard", "kind", "place", "data"])


def _parts(bits: int, cut: int, size: int, width: int):
    """Blocks of the filter with the bits that one row of counts sets, where they are (several rows can have parts of a block),
    and the words of each range with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for kind, keys, counts in zip(*(batch.column(x).to_pylist() for x in ("kind", "keys", "counts")), strict=True):
                key, n = opened(keys), _large(counts, np.int64)
                short, level = leading(key, width), level_of(n)
                for block, a, b in _cut(key, cut):
                    all_ = np.concatenate([level_key(short[a:b][level[a:b] >= j], j, cut) for j in range(1, int(level[a:b].max()) + 1)])
                    yield _row_batch([(-1, block >> (cut - bits), BITS, block, _small(bloom.bits_of(all_, size)))])
                if kind == WORDS:
                    yield _row_batch([(-1, shard, COUNTS, 0, len(whole := packed(key[a:b])).to_bytes(8, "little") + whole + _small(n[a:b])) for shard, a, b in _cut(key, bits)])

    return run


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch, list[bytes]]]:
    """Number, rows and texts of consecutive rows of about ASKED bytes: the same ones in every scan of the same rows."""
    chunk = TaskContext.get().partitionId() << 40
    for batch in batches:
        texts, start, size = encode(batch.column(2).to_pylist()), 0, 0
        for end, text in enumerate(texts, 1):
            size += len(text)
            if size >= ASKED or end == len(texts):
                yield chunk, batch.slice(start, end - start), texts[start:end]
                chunk, start, size = chunk + 1, end, 0


def _sign(texts: list[bytes]) -> bytes:
    return xxhash.xxh3_128_digest(b"\n".join(texts))


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each chunk's rows, packed, on their way to the scores."""
    pack = zstandard.ZstdCompressor(level=3)
    for chunk, rows, _ in _chunks(batches):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rows.schema) as writer:
            writer.write_batch(rows)
        yield _row_batch([(chunk, -1, TEXTS, 0, pack.compress(sink.getvalue()))])


def _plain_scan(df: DataFrame) -> bool:
    """Whether df comes from files by columns and filters alone, so that every scan has the same rows in the same partitions."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return all(line.lstrip(" :+-").startswith(("Project", "Filter", "Relation")) for line in plan.splitlines() if line.strip())


def _joined(held: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Groups of documents as one."""
    starts = np.cumsum([0] + [len(t) for t, *_ in held])
    return np.concatenate([t for t, *_ in held]), np.concatenate([b for _, b, _ in held]), np.concatenate([[0], *(at[1:] + s for (*_, at), s in zip(held, starts, strict=False))])


def _ask(bits: int, width: int):
    """Each chunk's words and pairs by ranges of the hash, and a sign of its texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, _, texts in _chunks(batches):
            token, before, _ = _joined([tokens(words, bounds) for _, words, bounds in word_hashes(texts, True)])
            words, pairs = np.sort(pd.unique(token)), np.sort(pd.unique(_pairs(token, before, width)))
            out = [(chunk, int(words[0] >> _U(64 - bits)) if bits else 0, SIGN, 0, _sign(texts))]
            out += [(chunk, shard, ASK_WORDS, 0, packed(words[a:b])) for shard, a, b in _cut(words, bits)]
            yield _row_batch(out + [(chunk, shard, ASK_PAIRS, 0, packed(pairs[a:b])) for shard, a, b in _cut(pairs, bits)])

    return run


def _answer(bits: int, cut: int, size: int, width: int, top: int):
    """Levels of the n-grams asked for, a byte each, and exact counts of the words. Rows come sorted by shard, the parts of its filter and vocabulary (chunk -1) before all else."""
    share = 1 << (cut - bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, known = None, np.zeros(0, np.uint8), []
        for batch in batches:
            out = []
            for chunk, shard, kind, place, data in zip(*(batch.column(c) for c in ("chunk", "shard", "kind", "place", "data")), strict=True):
                chunk, shard, kind, place, data = chunk.as_py(), shard.as_py(), kind.as_py(), place.as_py(), data.as_py()
                if shard != now:
                    now, held, known = shard, np.zeros(share * size, np.uint8), []
                if kind == BITS:
                    at = (place - shard * share) * size
                    held[at : at + size] |= _large(data, np.uint8)
                elif kind == COUNTS:
                    n = int.from_bytes(data[:8], "little")
                    known.append((opened(data[8 : 8 + n]), _large(data[8 + n :], np.int64)))
                elif kind == SIGN:
                    out.append((chunk, shard, ITS_SIGN, 0, data))
                else:
                    filter_ = bloom.Bloom(held, size, shard * share, cut)
                    if kind == ASK_PAIRS:
                        out.append((chunk, shard, PAIR_LEVELS, 0, _small(levels(filter_, opened(data), top).astype(np.uint8))))
                        continue
                    words = opened(data)
                    if len(known) > 1:
                        known = [_added(*zip(*known, strict=True))]
                    out.append((chunk, shard, WORD_LEVELS, 0, _small(levels(filter_, leading(words, width), top).astype(np.uint8))))
                    out.append((chunk, shard, WORD_COUNTS, 0, _small(_counts_of(words, *known[0]) if known else np.zeros(len(words), np.int64))))
            yield _row_batch(out)

    return run


def _counts_of(words: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.zeros(len(words), np.int64)
    spot = np.minimum(np.searchsorted(keys, words), len(keys) - 1)
    return np.where(keys[spot] == words, counts[spot], 0)


def _scored(m: dict, at: np.ndarray, word: np.ndarray, pair: np.ndarray, word_level: np.ndarray, pair_level: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, ...]:
    """n_tokens, n_known, base_score, score of documents; word and pair: places of each token's n-grams in what follows."""
    norm, first = m["tokens"] + 0.5 * (m["vocabulary"] + 1), at[:-1]
    every = np.arange(m["top"] + 1)
    low, high = levels_low(every), levels_high(every)
    uni = ((low[word_level] + 0.5) / norm)[word]
    history = np.empty(len(word))
    history[1:] = high[word_level][word[:-1]]
    history[first] = high[int(level_of(np.array([m["trained"]]))[0])]
    follow = np.divide(low[pair_level][pair], history, out=np.zeros(len(pair)), where=history > 0)
    p = np.where(history > 0, m["weight"] * np.minimum(follow, 1.0) + (1 - m["weight"]) * uni, uni)
    return np.diff(at), np.add.reduceat((count > 0)[word].astype(np.int64), first), np.add.reduceat(np.log10((count + 0.5) / norm)[word], first), np.add.reduceat(np.log10(p), first)


def _result(rows: pa.RecordBatch, parts: list[tuple]) -> pa.RecordBatch:
    cols = [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.zeros(0)] * 4
    made = [pa.array(c.astype(t)) for c, t in zip(cols, (np.int64, np.int64, float, float), strict=True)]
    return pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), *made], ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])


def _scores(model):
    """Scores by a broadcast filter and vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        filter_, keys, counts = bloom.Bloom(m["blocks"], m["size"]), np.frombuffer(m["keys"], _U), np.frombuffer(m["counts"], np.int64)
        for batch in batches:
            parts = []
            for _, hashes, bounds in word_hashes(encode(batch.column(2).to_pylist()), True):
                token, before, at = tokens(hashes, bounds)
                (word, words), (pair, pairs) = pd.factorize(token), pd.factorize(_pairs(token, before, m["width"]))
                level = levels(filter_, leading(np.concatenate([words, pairs]), m["width"]), m["top"])
                parts.append(_scored(m, at, word, pair, level[: len(words)], level[len(words) :], _counts_of(words, keys, counts)))
            yield _result(batch, parts)

    return run


def _scores_by_chunk(model):
    """As _scores; rows come sorted by chunk, kind and shard: a chunk's texts, then what its n-grams in their order gave."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, unpack = model.value, zstandard.ZstdDecompressor()

        def placed(keys: np.ndarray, answers: list[bytes], kind: type) -> np.ndarray:
            got = np.concatenate([_large(a, kind) for a in answers]).astype(np.int64)
            assert len(got) == len(keys), "answers of a chunk are missing"
            out = np.empty(len(keys), np.int64)
            out[np.argsort(keys, kind="stable")] = got
            return out

        def made(answers: dict[int, list[bytes]]) -> pa.RecordBatch:
            rows = pa.ipc.open_stream(unpack.decompress(answers[TEXTS][0])).read_next_batch()
            texts = encode(rows.column(2).to_pylist())
            assert _sign(texts) == answers[ITS_SIGN][0], "the two scans of the texts differ"
            token, before, at = _joined([tokens(words, bounds) for _, words, bounds in word_hashes(texts, True)])
            (word, words), (pair, pairs) = pd.factorize(token), pd.factorize(_pairs(token, before, m["width"]))
            return _result(rows, [_scored(m, at, word, pair, placed(words, answers[WORD_LEVELS], np.uint8), placed(pairs, answers[PAIR_LEVELS], np.uint8), placed(words, answers[WORD_COUNTS], np.int64))])

        now, answers = None, {}
        for batch in batches:
            for chunk, kind, data in zip(*(batch.column(c) for c in ("chunk", "kind", "data")), strict=True):
                if chunk.as_py() != now:
                    if now is not None:
                        yield made(answers)
                    now, answers = chunk.as_py(), {}
                answers.setdefault(kind.as_py(), []).append(data.as_py())
        if now is not None:
            yield made(answers)

    return run


def is_held_out(doc_id: Column) -> Column:
    """Remainder 1 of the id's CRC; a null id trains."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 1, F.lit(False))


def score(docs: DataFrame, ws: Workspace, weight: float = 0.5, most_broadcast: int = MOST_BROADCAST, most_filter: int | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of docs (doc_id, text).

    Training rows are those whose crc32 of the id as text leaves a remainder other than 1 by 5; a null id trains. Texts are
    lower-cased (A-Z) and cut into words, with one end token after the last; a null text is an empty one: the end alone.
    base_score adds log10((c + 0.5) / (N + 0.5 * (V + 1))) over the tokens, score is the model's log10 probability. Repeated
    rows count as often as they stand. Without training rows N and V are 0, and every token has the probability 1.
    Other columns are ignored; no rows, no result.
    """
    spark = docs.sparkSession
    most_filter = FILTER_BYTES if most_filter is None else most_filter
    rows = docs.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "text")
    facts = rows.agg(F.sum(F.octet_length("text")).alias("bytes"), F.count_if(~F.col("held_out")).alias("trained")).first()
    bits = min(max(8, ((facts["bytes"] or 0) // BUCKET_BYTES).bit_length()), 17)
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), (facts["bytes"] or 0) >> 28)
    # of a pair's hash so many bits are kept that two alike are a thousand times rarer than the pairs that the texts can hold
    width = min(64, max(facts["bytes"] or 0, 2).bit_length() + 10)
    sent = rows.filter("not held_out").select("text").mapInArrow(_gather(bits, width), "kind int, bucket int, keys binary, counts binary")
    counted = ws.save(sent.repartition(n, "kind", "bucket").sortWithinPartitions("kind", "bucket").mapInArrow(_summed, "kind int, bucket int, keys binary, counts binary, n_keys bigint, total bigint, entries bigint, top bigint"), "counts")
    of = {r["kind"]: r for r in counted.groupBy("kind").agg(F.sum("n_keys").alias("keys"), F.sum("total").alias("total"), F.sum("entries").alias("entries"), F.max("top").alias("top")).collect()}
    vocabulary, total = (of[WORDS]["keys"], of[WORDS]["total"]) if WORDS in of else (0, 0)
    entries = sum(f["entries"] for f in of.values())
    top = max([int(level_of(np.array([facts["trained"]]))[0]), *(f["top"] for f in of.values())])
    model = {"top": top, "tokens": total, "vocabulary": vocabulary, "weight": weight, "trained": facts["trained"], "width": width}
    size = bloom.block_bytes(entries, None)
    whole = size << bloom.BLOCK_BITS <= most_filter and vocabulary <= most_broadcast
    if whole:
        words = counted.filter(F.col("kind") == WORDS).select("keys", "counts", "bucket", "n_keys")
        # buckets are ranges of the hash, so the table is sorted once each stands in its place; one partition a time comes here
        at, start = {}, 0
        for r in words.select("bucket", "n_keys").orderBy("bucket").collect():
            at[r["bucket"]], start = start, start + r["n_keys"]
        keys_, counts_ = bytearray(8 * start), bytearray(8 * start)
        for r in words.toLocalIterator():
            begin, end = 8 * at[r["bucket"]], 8 * (at[r["bucket"]] + r["n_keys"])
            keys_[begin:end], counts_[begin:end] = opened(r["keys"]).tobytes(), _large(r["counts"], np.int64).tobytes()
        model |= {"keys": keys_, "counts": counts_, "size": size, "blocks": bloom.build(counted.select("keys", "counts").mapInArrow(_level_keys(width), "key bigint"), entries, None)[0]}
    sent_model = spark.sparkContext.broadcast(model)
    del model
    fields = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double"
    if whole:
        scored = rows.mapInArrow(_scores(sent_model), fields)
    else:
        # ranges of at most SHARD_BYTES (and a few for each task), of a power of two of blocks each
        shards = min(20, max((entries * bloom.BITS_PER_KEY // 8 // SHARD_BYTES).bit_length(), (4 * n - 1).bit_length()))
        cut = max(bloom.BLOCK_BITS, shards)
        size = bloom.block_bytes(entries, None, cut)
        scanned = rows if _plain_scan(docs) else ws.save(rows, "rows")  # read twice, for what is asked and for the scores
        there = scanned.mapInArrow(_ask(shards, width), _ROW).unionByName(counted.select("kind", "keys", "counts").mapInArrow(_parts(shards, cut, size, width), _ROW)).repartition(n, "shard").sortWithinPartitions("shard", "chunk", "kind")
        back = scanned.mapInArrow(_texts, _ROW).unionByName(there.mapInArrow(_answer(shards, cut, size, width, top), _ROW)).repartition(n, "chunk").sortWithinPartitions("chunk", "kind", "shard")
        scored = back.mapInArrow(_scores_by_chunk(sent_model), fields)
    # written here, so that driver and executors can let go of the model
    out = ws.save(scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("bigint").alias("train_tokens"), "base_score", "score"), "scores")
    sent_model.destroy()
    ws.drop(counted)
    return out
