"""The whole pipeline against a brute-force one in plain Python."""

import math
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from test_ops import brute_near, brute_quality, brute_secrets, low, words

from pagewright.llm import decontaminate

pipeline = pytest.importorskip("corpus_pipeline")


def masked(text):
    out, at = [], 0
    for begin, _, _, end in brute_secrets(text):
        if begin >= at:
            out += [text[at:begin], "[SECRET]"]
        at = max(at, end)
    return "".join(out) + text[at:] if out else text


def hashed(list_):
    return np.array([hash(w) % (1 << 64) for w in list_], np.uint64)


def test_pipeline(spark, small):
    docs = pq.read_table(f"{small}/documents.parquet").to_pylist()
    rows = [(d["doc_id"], d["text"], d["source"]) for d in docs]
    kept = []
    for r in rows:  # too few labels here to certify a cutoff: the base rules alone decide
        n, *_, repeated = brute_quality(r[1])
        if not (n < 10 or 100 * repeated > 20 * n):
            kept.append(r)
    stays = {i for (i, _, _, same) in brute_near(kept, 5, 80) if same}
    kept = [r for r in kept if r[0] in stays]
    items = [words(low(b["text"])) for b in pq.read_table(f"{small}/benchmark.parquet").to_pylist()]

    def leaks(text):
        own = words(low(text))
        seeds = {tuple(own[i : i + 5]) for i in range(len(own) - 4)}
        for item in items:
            if any(tuple(item[i : i + 5]) in seeds for i in range(len(item) - 4)) and 100 * sum(k for *_, k in decontaminate.tiles(hashed(item), hashed(own), 5)) >= 80 * len(item):
                return True
        return False

    kept = [(i, masked(t), s) for i, t, s in kept if not leaks(t)]
    sizes = Counter()
    for _, t, s in kept:
        sizes[s] += len(words(t))
    got = pipeline.run(spark, small).collect()
    assert Counter((r["doc_id"], r["size"], r["source_size"]) for r in got) == Counter((i, len(words(t)), sizes[s]) for i, t, s in kept)
    assert math.isclose(sum({r["source"]: r["target"] for r in got}.values()), sum(sizes.values()))
    assert all(0 <= r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"] for r in got)


def test_stages_keep_the_columns(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    for name, stage in pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(20), small).columns == docs.columns, name
