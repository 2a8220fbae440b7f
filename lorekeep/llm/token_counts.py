"""Token counts by a linear longest-match automaton.

Every word, written as a space and its UTF-8 bytes, is split greedily into the longest pieces of a
vocabulary of byte strings that holds all single bytes. The automaton is the trie of the vocabulary
with, for each node, the number of pieces that are popped when the walk cannot go on from it and
the node (failure link) where it goes on; both are worked out once, so a word costs one step per
byte and its pieces are never built.

Defined cases: null and empty texts have no words and no tokens; a text is read whole, whatever its
length; repeated rows are counted each; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import base64
from collections import deque
from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.common import map_rows, text_of, words_of

CACHED_WORDS = 300_000


def read_pieces(path: str) -> list[bytes]:
    """Pieces of a rank file: base64 of the bytes, then the rank."""
    with open(path, "rb") as lines:
        return [base64.b64decode(line.split()[0]) for line in lines if line.strip()]


class Automaton:
    """Trie with failure links and popped-token counts."""

    def __init__(self, pieces: Iterable[bytes]):
        self.next: list[dict[int, int]] = [{}]
        ends = {0}
        for piece in [*pieces, *(bytes([b]) for b in range(256))]:
            node = 0
            for byte in piece:
                found = self.next[node].get(byte)
                if found is None:
                    found = self.next[node][byte] = len(self.next)
                    self.next.append({})
                node = found
            ends.add(node)
        self.fail = [0] * len(self.next)
        self.popped = [0] * len(self.next)
        queue = deque([0])
        while queue:
            parent = queue.popleft()
            for byte, node in self.next[parent].items():
                queue.append(node)
                if node in ends:
                    self.popped[node] = 1  # the node's own string; the walk goes on at the root
                    continue
                at, count = self.fail[parent], self.popped[parent]
                while byte not in self.next[at]:
                    count += self.popped[at]
                    at = self.fail[at]
                self.fail[node], self.popped[node] = self.next[at][byte], count

    def count(self, data: bytes) -> int:
        """Number of pieces in the greedy longest-match split of ``data``."""
        nexts, fail, popped = self.next, self.fail, self.popped
        node = total = 0
        for byte in data:
            while byte not in nexts[node]:
                total += popped[node]
                node = fail[node]
            node = nexts[node][byte]
        while node:
            total += popped[node]
            node = fail[node]
        return total


class WordCounts(dict):
    """Counts of words seen in a task; emptied when full, which changes no result."""

    def __init__(self, automaton: Automaton, limit: int = CACHED_WORDS):
        super().__init__()
        self.automaton, self.limit = automaton, limit

    def __missing__(self, word: str) -> int:
        if len(self) >= self.limit:
            self.clear()
        found = self[word] = self.automaton.count(b" " + word.encode())
        return found


def token_counts(docs: DataFrame, vocabulary: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_words, n_tokens per row; ``vocabulary`` is a rank file every executor can read."""

    def build():
        counts = WordCounts(Automaton(read_pieces(vocabulary)))

        def step(rows):
            words = [words_of(t) for t in rows["text"]]
            tokens = [int(np.fromiter(map(counts.__getitem__, w), np.int64, len(w)).sum()) for w in words]
            return {"doc_id": rows["doc_id"], "n_words": [len(w) for w in words], "n_tokens": tokens}

        return step

    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text"))
    return map_rows(slim, "doc_id long, n_words long, n_tokens long", build)
