"""Token ids of whole texts through bounded caches of chunks and pieces.

For a tokenizer that drops white space and whose pieces never span it, the ids of a text are the
ids of its white-space separated chunks, one after another, and those of a chunk are the ids of its
pieces. Chunks and pieces repeat; each is encoded once per worker and fill of the cache.
"""

from __future__ import annotations

import gc
import json
import unicodedata
from collections.abc import Callable
from itertools import chain

import numpy as np
import regex

from lorekeep.llm.common import ragged, words_of

CACHED_CHUNKS = 500_000
CACHED_PIECES = 400_000
CACHED_IDS = 6_000_000
# White space as the tokenizer file's pattern means it.
_SPACE = r"\t-\r\x20\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

_SIGMA, _SMALL_SIGMA = "\N{GREEK CAPITAL LETTER SIGMA}", "\N{GREEK SMALL LETTER SIGMA}"
# neither letters, digits nor the beginnings of contractions or special tokens
_MARKS = "!\"#$%&()*+,-./:;=?@[\\]^_`{}~"


class Cutter:
    """Pieces of a chunk as a tokenizer file defines them.

    Special tokens are cut out first and come as ids; the rest is brought to NFC, lower-cased by
    character and split by the file's pattern.
    """

    def __init__(self, spec: dict):
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._special = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) or "(?!)")
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self._pieces = regex.compile(pattern.replace(r"[^\s", f"[^{_SPACE}"))

    def __call__(self, chunk: str) -> list[str | int]:
        # most chunks are letters, perhaps with marks behind them
        word = chunk.rstrip(_MARKS)
        if word.isalpha():
            low = word.lower() if word.isascii() else _lowered(word)
            if low.isalpha():
                return [low, chunk[len(word) :]] if len(word) < len(chunk) else [low]
        out: list[str | int] = []
        at = 0
        for match in self._special.finditer(chunk):
            out += self._plain(chunk[at : match.start()])
            out.append(self.special[match.group()])
            at = match.end()
        return out + self._plain(chunk[at:])

    def _plain(self, text: str) -> list[str]:
        return self._pieces.findall(_lowered(text))


def _lowered(text: str) -> str:
    """NFC, then lower-cased by character: no rule for a final sigma."""
    if text.isascii():
        return text.lower()
    return unicodedata.normalize("NFC", text).replace(_SIGMA, _SMALL_SIGMA).lower()


def read_spec(path: str) -> dict:
    with open(path, encoding="utf-8") as file:
        return json.load(file)


class _Numbered(dict):
    """Numbers of keys in order of first sight; new ones wait in ``pending``."""

    def __init__(self):
        super().__init__()
        self.pending: list = []

    def __missing__(self, key) -> int:
        found = self[key] = len(self)
        self.pending.append(key)
        return found


class _Store:
    """Id sequences by number, one after another in a growing array."""

    def __init__(self):
        self.ids = np.zeros(1 << 16, np.int32)
        self.ends = np.zeros(1 << 16, np.int64)  # sequence i lies between ends[i] and ends[i + 1]
        self.n = 0

    def __len__(self) -> int:
        return int(self.ends[self.n])

    def add(self, ids: np.ndarray, lengths: np.ndarray) -> None:
        used, n = len(self), self.n
        self.ids = _room(self.ids, used, used + len(ids))
        self.ids[used : used + len(ids)] = ids
        self.ends = _room(self.ends, n + 1, n + 1 + len(lengths))
        self.ends[n + 1 : n + 1 + len(lengths)] = used + np.cumsum(lengths)
        self.n = n + len(lengths)

    def take(self, numbers: np.ndarray, groups: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the numbered sequences, and how many each of the consecutive groups of them has."""
        starts = self.ends[numbers]
        lengths = self.ends[numbers + 1] - starts
        edges = np.concatenate([[0], np.cumsum(groups, dtype=np.int64)])
        total = np.concatenate([[0], np.cumsum(lengths)])
        return self.ids[ragged(starts, lengths)], np.diff(total[edges])


class ChunkCache:
    """``encode_many(pieces)`` gives all ids in one array and the number of ids of each piece."""

    def __init__(
        self, cut: Callable[[str], list[str | int]], encode_many: Callable[[list[str]], tuple[np.ndarray, np.ndarray]],
        chunks: int = CACHED_CHUNKS, pieces: int = CACHED_PIECES, ids: int = CACHED_IDS,
    ):
        self.cut, self.encode_many = cut, encode_many
        self.most_chunks, self.most_pieces, self.most_ids = chunks, pieces, ids
        self.chunks, self.chunk_ids = _Numbered(), _Store()
        self.pieces, self.piece_ids = _Numbered(), _Store()

    def _learn_pieces(self) -> None:
        new, self.pieces.pending = self.pieces.pending, []
        plain = [p for p in new if isinstance(p, str)]
        ids, lengths = self.encode_many(plain)
        if len(plain) < len(new):  # special tokens are their own ids
            marks = np.array([not isinstance(p, str) for p in new])
            size = np.ones(len(new), np.int64)
            size[~marks] = lengths
            spread = np.repeat(marks, size)
            all_ids = np.zeros(int(size.sum()), np.int64)
            all_ids[spread], all_ids[~spread] = [p for p in new if not isinstance(p, str)], ids
            ids, lengths = all_ids, size
        self.piece_ids.add(ids, lengths)

    def _learn_chunks(self) -> None:
        new, self.chunks.pending = self.chunks.pending, []
        if len(self.pieces) > self.most_pieces or len(self.piece_ids) > self.most_ids:
            self.pieces, self.piece_ids = _Numbered(), _Store()
        collects = gc.isenabled()
        gc.disable()  # many small lists and no cycles: collections would only walk over them
        try:
            self._add_chunks(new)
        finally:
            if collects:
                gc.enable()

    def _add_chunks(self, new: list[str]) -> None:
        cut = [self.cut(c) for c in new]
        numbers = np.fromiter(map(self.pieces.__getitem__, chain.from_iterable(cut)), np.int64)
        if self.pieces.pending:
            self._learn_pieces()
        self.chunk_ids.add(*self.piece_ids.take(numbers, [len(c) for c in cut]))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in one array, and the number of ids of each text."""
        if len(self.chunks) > self.most_chunks or len(self.chunk_ids) > self.most_ids:
            self.chunks, self.chunk_ids = _Numbered(), _Store()
        words, counts = [], []
        for text in texts:
            found = words_of(text)
            words += found
            counts.append(len(found))
        numbers = np.fromiter(map(self.chunks.__getitem__, words), np.int64, len(words))
        if self.chunks.pending:
            self._learn_chunks()
        return self.chunk_ids.take(numbers, counts)


def _room(array: np.ndarray, used: int, needed: int) -> np.ndarray:
    """``array`` with space for ``needed`` values, the first ``used`` kept."""
    if needed <= len(array):
        return array
    larger = np.zeros(max(needed, 2 * len(array)), array.dtype)
    larger[:used] = array[:used]
    return larger
