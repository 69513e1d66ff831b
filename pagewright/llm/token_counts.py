"""Word-piece counts by a linear longest-match automaton.

Pieces are matched greedily: from the left, always the longest piece of the vocabulary. The automaton is the vocabulary's
trie. A node without a child for the next character fails over: its failure link leads to the node that stands for what is
left of the matched string once the pieces that greedy matching has certainly taken are popped, and the number of popped
pieces is stored beside the link. So a word is read once, character by character, in time linear in its length, and only
numbers of pieces are added up; no piece is ever cut out.

A word is matched with MARK before it, as the vocabulary writes word starts. Where greedy matching finds no piece, one
character counts as its UTF-8 bytes (byte fallback) and matching goes on behind it.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from pagewright.llm.kernels import encode

MARK = "▁"
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: Pieces that may be broadcast.
MOST_PIECES = 1 << 20
#: Words whose count a task remembers; beyond it, it starts anew.
REMEMBERED = 1 << 18


def read_pieces(path: str = VOCABULARY) -> list[str]:
    """Pieces of a vocabulary file on the driver, without control, unknown and byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]


class Automaton:
    """children[node]: character to node; link[node] (-1: none) and popped[node]: failure link and the pieces it pops."""

    def __init__(self, pieces: Iterable[str]):
        self.children: list[dict[str, int]] = [{}]
        self.parent: list[tuple[int, str]] = [(-1, "")]
        self.piece = [False]
        for text in sorted(set(pieces) - {""}):
            node = 0
            for ch in text:
                step = self.children[node].get(ch)
                if step is None:
                    step = len(self.children)
                    self.children[node][ch] = step
                    self.children.append({})
                    self.parent.append((node, ch))
                    self.piece.append(False)
                node = step
            self.piece[node] = True
        n = len(self.children)
        self.link, self.popped = [-1] * n, [0] * n
        queue = deque(self.children[0].values())
        while queue:
            node = queue.popleft()
            if self.piece[node]:  # popped whole, nothing is left
                self.link[node], self.popped[node] = 0, 1
            else:  # pop from the parent's string until what is left can take this node's last character
                above, ch = self.parent[node]
                at, count = self.link[above], self.popped[above]
                while at != -1 and ch not in self.children[at]:
                    count += self.popped[at]
                    at = self.link[at]
                if at != -1:
                    self.link[node], self.popped[node] = self.children[at][ch], count
            queue.extend(self.children[node].values())
        self.tail = [0] * n  # pieces of a node's string when the word ends there; -1: greedy matching fails inside
        for node in range(1, n):
            at, count = node, 0
            while at > 0:
                count += self.popped[at]
                at = self.link[at]
            self.tail[node] = count if at == 0 else -1

    def _string(self, node: int) -> str:
        out = []
        while node:
            node, ch = self.parent[node]
            out.append(ch)
        return "".join(reversed(out))

    def count(self, word: str) -> int:
        """Number of pieces of one word, its mark included."""
        children, link, popped = self.children, self.link, self.popped
        node = pieces = 0
        for i, ch in enumerate(word):
            while (step := children[node].get(ch)) is None:
                if node == 0:
                    pieces += len(ch.encode("utf-8", "surrogatepass"))
                    step = 0
                    break
                if link[node] < 0:
                    return pieces + self._by_trial(self._string(node) + word[i:])
                pieces += popped[node]
                node = link[node]
            node = step
        return pieces + (self.tail[node] if self.tail[node] >= 0 else self._by_trial(self._string(node)))

    def _by_trial(self, text: str) -> int:
        """From a piece boundary on, where some prefix of a piece is not itself made of pieces (rare)."""
        at = pieces = 0
        while at < len(text):
            node, end, k = 0, 0, at
            while k < len(text) and (node := self.children[node].get(text[k], 0)):
                k += 1
                if self.piece[node]:
                    end = k
            pieces += 1 if end else len(text[at].encode("utf-8", "surrogatepass"))
            at = end or at + 1
        return pieces


def _count(pieces):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(pieces.value)

        class Counts(dict):
            def __missing__(self, word: bytes) -> int:
                if len(self) >= REMEMBERED:
                    self.clear()
                n = self[word] = automaton.count(MARK + word.decode("utf-8", "surrogatepass"))
                return n

        known = Counts()
        get = known.__getitem__
        for batch in batches:
            n_words, n_tokens = [], []
            for text in encode(batch.column(1).to_pylist()):
                words = text.split()
                n_words.append(len(words))
                n_tokens.append(sum(map(get, words)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_tokens, pa.int64())], ["doc_id", "n_words", "n_tokens"])

    return run


def token_counts(docs: DataFrame, pieces: list[str]) -> DataFrame:
    """doc_id, n_words, n_tokens for each row of docs (doc_id, text; other columns are ignored).

    Words are runs of characters other than space and 0x09-0x0D, unchanged; each is cut greedily into the longest pieces.
    Null and empty texts have no words and no tokens; repeated rows and null ids are counted like any other. A row is never
    shuffled. No rows, no result.
    """
    if len(pieces) > MOST_PIECES:
        raise ValueError(f"a vocabulary of {len(pieces)} pieces is too large to broadcast")
    sent = docs.sparkSession.sparkContext.broadcast(pieces)
    return docs.select("doc_id", "text").mapInArrow(_count(sent), "doc_id bigint, n_words bigint, n_tokens bigint")
