"""BPE encoding and decoding by batched numpy merge rounds.

The symbols of many words lie in one flat array. In a round every word merges its lowest-ranked
pair, wherever it occurs in the word from left to right; the ranks of pairs are found by binary
search over the sorted pair keys, and only next to a merge are they looked up again. Words without
a pair that merges leave the array.

The tokenizer is read from its public JSON file: special tokens are cut out first, the rest is
brought to NFC, lower-cased by character and split by the file's pattern; bytes are the base
symbols, the last one of a word with the word-end suffix.

Defined cases: null is the empty text, which has no ids and decodes to the empty text; texts are
read whole; repeated rows give equal rows; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.chunks import ChunkCache, Cutter, read_spec
from lorekeep.llm.common import map_rows, text_of

_NEVER = np.iinfo(np.int64).max

def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class Bpe:
    def __init__(self, path: str):
        spec = read_spec(path)
        model = spec["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        self.cut = Cutter(spec)
        self.tokens = {i: t for t, i in [*vocab.items(), *self.cut.special.items()]}
        symbols = byte_symbols()
        self.inner = np.array([vocab[s] for s in symbols], np.int64)
        self.final = np.array([vocab[s + suffix] for s in symbols], np.int64)
        left = np.array([vocab[a] for a, _ in model["merges"]], np.int64)
        right = np.array([vocab[b] for _, b in model["merges"]], np.int64)
        made = np.array([vocab[a + b] for a, b in model["merges"]], np.int64)
        keys = left << 32 | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made[order]

    def _look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair (``_NEVER``: does not merge) and the symbol it makes."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], _NEVER), self.made[at]

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of non-empty pieces in one array, and the number of ids of each."""
        data = np.frombuffer(b"".join(words), np.uint8)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        if not len(words):
            return np.zeros(0, np.int64), sizes
        symbol, last = self.inner[data], np.cumsum(sizes) - 1
        symbol[last] = self.final[data[last]]
        word = np.repeat(np.arange(len(words)), sizes)
        # rank[i], made[i]: of the pair (i, i + 1); the last symbol of a word has none
        rank, made = np.full(len(symbol), _NEVER), np.zeros(len(symbol), np.int64)
        rank[:-1], made[:-1] = self._look_up(symbol[:-1], symbol[1:])
        rank[last] = _NEVER
        done_word, done_symbol = [], []
        while len(word):
            start = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            best = np.minimum.reduceat(rank, start)
            length = np.diff(np.append(start, len(word)))
            lowest = np.repeat(best, length)
            over = lowest == _NEVER
            if over.any():
                done_word.append(word[over])
                done_symbol.append(symbol[over])
                stay = ~over
                symbol, word, rank, made, lowest = symbol[stay], word[stay], rank[stay], made[stay], lowest[stay]
                if not len(word):
                    break
            at = np.flatnonzero(rank == lowest)
            # in x x x the pairs overlap: every second of a run of neighbours merges
            order = np.arange(len(at))
            first = np.maximum.accumulate(np.where(np.concatenate([[True], np.diff(at) != 1]), order, 0))
            at = at[(order - first) % 2 == 0]
            symbol[at] = made[at]
            rank[at] = rank[at + 1]  # where the right part was last, so is the merged symbol
            stay = np.ones(len(word), bool)
            stay[at + 1] = False
            at = at - np.arange(len(at))
            symbol, word, rank, made = symbol[stay], word[stay], rank[stay], made[stay]
            again = np.concatenate([at, at[at > 0] - 1])
            again = again[again + 1 < len(word)]
            again = again[word[again] == word[again + 1]]
            rank[again], made[again] = self._look_up(symbol[again], symbol[again + 1])
            ends = at[(at + 1 == len(word)) | (word[np.minimum(at + 1, len(word) - 1)] != word[at])]
            rank[ends] = _NEVER
        word, symbol = np.concatenate(done_word), np.concatenate(done_symbol)
        order = np.argsort(word, kind="stable")
        return symbol[order], np.bincount(word, minlength=len(words))

    def decode(self, ids: list[int]) -> str:
        """The tokens with a space between, special ones included; the file names no decoder."""
        return " ".join(map(self.tokens.__getitem__, ids))


@lru_cache(maxsize=1)
def _loaded(vocabulary: str) -> tuple[Bpe, ChunkCache]:
    """Once per worker process: tables and cache serve all its tasks."""
    bpe = Bpe(vocabulary)
    return bpe, ChunkCache(bpe.cut, lambda pieces: bpe.merge([p.encode() for p in pieces]))


def encode_documents(docs: DataFrame, vocabulary: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_tokens, ids (array) and decoded text of every document."""

    def build():
        bpe, cache = _loaded(vocabulary)

        def step(rows):
            flat, counts = cache.encode(rows["text"])
            ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.astype(np.int32)))
            own = (flat[a:b].tolist() for a, b in zip(ends.tolist(), ends[1:].tolist(), strict=False))
            return {
                "doc_id": rows["doc_id"], "n_tokens": counts.tolist(), "ids": lists,
                "decoded": [bpe.decode(ids) for ids in own],
            }

        return step

    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text"))
    return map_rows(slim, "doc_id long, n_tokens long, ids array<int>, decoded string", build)


def encoding_digests(docs: DataFrame, vocabulary: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_tokens and the SHA-256 of ids and of decoded text, without shipping either."""

    def build():
        bpe, cache = _loaded(vocabulary)

        def step(rows):
            flat, counts = cache.encode(rows["text"])
            ends = np.cumsum(counts)
            made = {"doc_id": rows["doc_id"], "n_tokens": counts.tolist(), "ids_sha256": [], "decoded_sha256": []}
            for end, n in zip(ends.tolist(), made["n_tokens"], strict=True):
                own = flat[end - n : end]
                made["ids_sha256"].append(hashlib.sha256(own.astype("<u4").tobytes()).hexdigest())
                made["decoded_sha256"].append(hashlib.sha256(bpe.decode(own.tolist()).encode()).hexdigest())
            return made

        return step

    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text"))
    return map_rows(slim, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", build)
