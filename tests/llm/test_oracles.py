"""Queries of this part agree with their DuckDB oracles."""

import duckdb
import pytest

from pagewright.llm.oracles import ORACLES
from pagewright.llm.queries import QUERIES
from pagewright.llm.token_counts import MARK, read_pieces, token_counts


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_agrees_with_its_oracle(spark, small, name):
    folder = small if name in ("op3_neardup",) else small.replace("0.001", "0.01")
    con = duckdb.connect()
    for t in ("documents", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    df = QUERIES[name](spark, folder)
    cols = sorted(df.columns)
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({ORACLES[name]})").fetchall()
    assert sorted(map(str, want)) == sorted(str(tuple(r[c] for c in cols)) for r in df.select(*cols).collect())


def test_token_counts_with_a_public_vocabulary(spark, small):
    """Every word of the table by greedy search in the set of pieces."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    pieces = read_pieces()
    known, longest = set(pieces), max(map(len, pieces))

    def count(word):
        at = n = 0
        while at < len(word):
            k = next((k for k in range(min(longest, len(word) - at), 0, -1) if word[at : at + k] in known), 0)
            n += 1 if k else len(word[at].encode())
            at += k or 1
        return n

    memory = {}
    for r in token_counts(docs, pieces).join(docs.select("doc_id", "text"), "doc_id").collect():
        words = (r["text"] or "").encode().split()
        for w in words:
            if w not in memory:
                memory[w] = count(MARK + w.decode())
        assert (r["n_words"], r["n_tokens"]) == (len(words), sum(memory[w] for w in words))
