"""A Bloom filter cut into blocks by the leading bits of the key, so that executors build it block by block.

Every key sets and probes bits of its own block only. A block is made by one task from the keys of that block; the driver
gathers the blocks, whose total size is bounded by MAX_BYTES, and broadcasts them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.kernels import mix

BLOCK_BITS = 10  # 1024 blocks
PROBES = 4
BITS_PER_KEY = 8
MAX_BYTES = 1 << 25
_U = np.uint64


def block_bytes(keys: int, most: int | None = MAX_BYTES, bits: int = BLOCK_BITS) -> int:
    """Bytes of each of 2**bits blocks for so many keys, within the bound for the whole filter (None: no bound)."""
    size = max(64, -(-keys * BITS_PER_KEY // (8 << bits)))
    return size if most is None else min(size, most >> bits)


def _spots(keys: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """Bit numbers of the keys within their block, one array a probe."""
    h = mix(keys * _U(0xA0761D6478BD642F) + _U(7))
    step = mix(h) | _U(1)
    for _ in range(PROBES):
        yield h % _U(size * 8)
        h = h + step


def block_of(keys: np.ndarray, bits: int = BLOCK_BITS) -> np.ndarray:
    return (keys >> _U(64 - bits)).astype(np.int64)


class Bloom:
    """blocks: bytes of all 2**cut blocks, or of the consecutive ones from `first` on, one after another."""

    def __init__(self, blocks: bytes | bytearray, size: int, first: int = 0, cut: int = BLOCK_BITS):
        self.bits, self.size, self.first, self.cut = np.frombuffer(blocks, np.uint8), size, first, cut

    def has(self, keys: np.ndarray) -> np.ndarray:
        """Whether each key may be in the filter; probes of keys that already failed are not made."""
        out = np.ones(len(keys), bool)
        live = np.arange(len(keys))
        base = (block_of(keys, self.cut) - self.first) * self.size
        h = mix(keys * _U(0xA0761D6478BD642F) + _U(7))
        step = mix(h) | _U(1)
        for _ in range(PROBES):
            spot = h[live] % _U(self.size * 8)
            byte = self.bits[base[live] + (spot >> _U(3)).astype(np.int64)]
            hit = (byte >> (spot & _U(7)).astype(np.uint8)) & 1 == 1
            out[live[~hit]] = False
            live = live[hit]
            if not len(live):
                break
            h = h + step
        return out


def bits_of(keys: np.ndarray, size: int) -> np.ndarray:
    """A block with the bits of keys of that block."""
    bits = np.zeros(size * 8, bool)
    for spot in _spots(keys, size):
        bits[spot.astype(np.int64)] = True
    return np.packbits(bits, bitorder="little")


def _build(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[int, np.ndarray] = {}
        for batch in batches:
            keys = np.asarray(batch.column(0)).astype(np.int64).view(_U)
            where = block_of(keys)
            order = np.argsort(where, kind="stable")
            keys, where = keys[order], where[order]
            cuts = np.flatnonzero(np.diff(where, prepend=-1))
            for k, at in enumerate(cuts):
                block = int(where[at])
                bits = blocks.setdefault(block, np.zeros(size, np.uint8))
                for spot in _spots(keys[at : cuts[k + 1] if k + 1 < len(cuts) else len(keys)], size):
                    np.bitwise_or.at(bits, (spot >> _U(3)).astype(np.int64), np.left_shift(np.uint8(1), (spot & _U(7)).astype(np.uint8)))
        yield pa.RecordBatch.from_arrays([pa.array(list(blocks), pa.int32()), pa.array([b.tobytes() for b in blocks.values()], pa.binary())], ["block", "bits"])

    return run


def build(keys: DataFrame, count: int, most: int = MAX_BYTES) -> tuple[bytearray, int]:
    """(blocks, bytes of a block) of the filter of the one column of keys, bigint; count: how many there are.

    Beyond what fits the bound, bits per key fall and false positives rise; callers must stay right with any rate of them.
    """
    size = block_bytes(count, most)
    name = keys.columns[0]
    block = F.shiftrightunsigned(F.col(name), 64 - BLOCK_BITS)
    n = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    whole = bytearray(size << BLOCK_BITS)
    for r in keys.repartition(n, block).mapInArrow(_build(size), "block int, bits binary").collect():
        whole[r["block"] * size : (r["block"] + 1) * size] = r["bits"]
    return whole, size
