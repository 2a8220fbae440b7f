"""Grouping of spelling variants by blocked Gram matrices of letter counts.

* **Words** are counted over all texts by Spark functions: runs of Latin letters, lower-cased from A
  to Z, with the seeded typing slip of ``slipped``; those long and frequent enough go on.
* **Blocks.** Words of n letters meet words of n and n + 1 letters. Two words one edit apart agree
  in the first or in the second half of the shorter one, so a length block falls into one block
  per first half and one per second half; a block of more than ``limit`` words is halved again
  between what its words are known to share, until at most one letter is open. So every block has a
  bound, whatever the words, and no near pair is lost.
* **Gram matrices.** In a block the letter counts of its words are the rows of a matrix; one
  product gives all squared distances. An exchanged letter makes 2, an added one 1: pairs at most 2
  apart are kept. The number of the block is one more coordinate, so that small blocks share a
  product. Kept pairs are verified letter by letter, and each is given by the first block that
  holds it alone.
* **Forms** are the most frequent near words; roots are found by pointer doubling.

Defined cases: a null or empty text has no words; a null id counts as the empty text before the
colon; repeated rows count again; texts and words of any length are read whole; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.common import settle, text_of
from lorekeep.llm.components import shortened

RUN = "[a-zÀ-ÿ]"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LIMIT = 512
# rows of small blocks that share a product, rows of a large block's strip
_TOGETHER, _STRIP = 128, 1024
_LETTERS = np.zeros(256, np.int64)
_LETTERS[ord("a") : ord("z") + 1] = np.arange(26)
_LETTERS[0xC0:] = np.arange(26, 26 + 64)
_WIDTH = 26 + 64


def slipped(run: Column, doc_id: Column, every: int) -> Column:
    """``run`` without one letter where ``every`` divides the CRC-32 of ``doc_id:run``."""
    code = F.crc32(F.concat(doc_id, F.lit(":"), run).cast("binary"))
    at = (code % F.length(run)).cast("int")
    cut = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))
    return F.when(code % every == 0, cut).otherwise(run)


def word_counts(
    docs: DataFrame, min_length: int, min_count: int, every: int, text: str = "text", doc_id: str = "doc_id"
) -> DataFrame:
    """word, n of the words of at least ``min_length`` letters that occur ``min_count`` times."""
    # a slip only shortens, so shorter runs need not be looked at
    runs = F.regexp_extract_all(
        F.translate(text_of(text), _UPPER, _LOWER), F.lit(f"{RUN}{{{min_length},}}"), F.lit(0)
    )
    rows = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    words = rows.select(slipped(F.col("run"), F.col("id"), every).alias("word")).where(F.length("word") >= min_length)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


# ---- blocks -------------------------------------------------------------------------------


def _halved(rows: DataFrame) -> DataFrame:
    """Each row under its two narrower blocks: more of the beginning, or more of the end, is shared."""
    half = F.expr("div(size - head - tail, 2)").cast("int")
    rest = F.col("size") - F.col("head") - F.col("tail") - half
    parts = F.explode(F.array(
        F.struct((F.col("head") + half).alias("head"), F.col("tail").alias("tail"), F.concat("path", F.lit("h")).alias("path")),
        F.struct(F.col("head").alias("head"), (F.col("tail") + rest).alias("tail"), F.concat("path", F.lit("t")).alias("path")),
    ))
    rows = rows.select("word", "n", "size", parts.alias("part")).select("word", "n", "size", "part.*")
    shared = F.concat(F.expr("left(word, head)"), F.expr("right(word, tail)"))
    return rows.withColumn("block", F.concat_ws(":", "size", "path", shared))


def blocks(words: DataFrame, min_length: int, limit: int = LIMIT) -> DataFrame:
    """word, n, size (letters of the block's shorter words), path (how it was halved) and block."""
    size = F.explode(F.array(F.length("word"), F.length("word") - 1)).alias("size")
    start = [F.lit(0).alias("head"), F.lit(0).alias("tail"), F.lit("").alias("path")]
    rows = _halved(words.select("word", "n", size).where(F.col("size") >= min_length).select("*", *start))
    done = None
    while True:
        full = rows.where("size - head - tail > 1").groupBy("block").agg(F.count("*").alias("members"))
        full = settle(full.where(F.col("members") > limit).select("block"), "full-blocks")
        if full.isEmpty():
            return (done.unionByName(rows) if done else rows).select("word", "n", "size", "path", "block")
        small = rows.join(full, "block", "left_anti")
        done = done.unionByName(small) if done else small
        rows = _halved(rows.join(full, "block", "left_semi").drop("block"))


# ---- pairs --------------------------------------------------------------------------------


def letter_counts(words: list[str]) -> np.ndarray:
    """One row of letter counts per word."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    letters = _LETTERS[np.frombuffer("".join(words).encode("latin-1"), np.uint8)]
    cells = np.repeat(np.arange(len(words)), sizes) * _WIDTH + letters
    return np.bincount(cells, minlength=len(words) * _WIDTH).reshape(len(words), _WIDTH)


def one_edit(a: str, b: str) -> int:
    """Length of the common beginning if the words differ by exactly one edit, else -1."""
    if len(a) > len(b):
        a, b = b, a
    at = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    if len(a) == len(b):
        return at if at < len(a) and a[at + 1 :] == b[at + 1 :] else -1
    return at if len(b) - len(a) == 1 and a[at:] == b[at + 1 :] else -1


def close_pairs(words: list[str], own: np.ndarray, group: np.ndarray) -> Iterator[tuple[int, int]]:
    """Positions of pairs of one group, the first of them in ``own``, at most 2 apart by their letters."""
    counts = letter_counts(words)
    # sums of squares are exact in single precision up to words of some thousand letters
    kind = np.float32 if max(map(len, words)) < 2000 else np.float64
    # groups are at least 2 apart by this coordinate, so 4 by its square
    rows = np.concatenate([counts, 2 * group[:, None]], 1).astype(kind)
    square = (rows * rows).sum(1)
    right = np.concatenate([-2 * rows, np.ones((len(rows), 1), kind), square[:, None]], 1).T
    left = np.concatenate([rows, square[:, None], np.ones((len(rows), 1), kind)], 1)
    is_own = np.zeros(len(words), bool)
    is_own[own] = True
    for start in range(0, len(own), _STRIP):
        strip = own[start : start + _STRIP]
        i, j = np.nonzero(left[strip] @ right <= 2)
        i = strip[i]
        good = (i < j) | ~is_own[j]
        yield from zip(i[good].tolist(), j[good].tolist(), strict=True)


def _repeats_earlier(size: int, path: str, common: int) -> bool:
    """Whether a pair with this common beginning also lies in a block taken before on the path."""
    head = tail = 0
    for step in path:
        half = (size - head - tail) // 2
        if step == "h":
            head += half
        elif common >= head + half:
            return True
        else:
            tail = size - head - half
    return False


def _near(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, near, near_n) both ways, of rows sorted by block."""

    def found(rows: list[tuple]) -> Iterator[tuple]:
        words = [r[0] for r in rows]
        own = np.flatnonzero([len(r[0]) == r[2] for r in rows])
        keys = [r[4] for r in rows]
        group = np.cumsum([0, *(a != b for a, b in zip(keys, keys[1:], strict=False))])
        if not len(own) or len(rows) < 2:
            return
        for i, j in close_pairs(words, own, group):
            common = one_edit(words[i], words[j])
            if common >= 0 and not _repeats_earlier(rows[i][2], rows[i][3], common):
                yield words[i], words[j], rows[j][1]
                yield words[j], words[i], rows[i][1]

    def made(pairs: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(zip(*pairs, strict=True), kinds, strict=True)], ["word", "near", "near_n"]
        )

    held: list[tuple] = []  # whole small blocks, then the rows of the open one
    begin = 0  # of the open block
    pairs: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and row[4] != held[-1][4]:
                if len(held) >= _TOGETHER:
                    # a large block by itself, so that its product has no other rows
                    for part in (held[:begin], held[begin:]) if len(held) - begin >= _TOGETHER else (held,):
                        if part:
                            pairs.extend(found(part))
                    held = []
                begin = len(held)
            held.append(row)
        if pairs:
            yield made(pairs)
            pairs = []
    if held:
        pairs.extend(found(held))
    if pairs:
        yield made(pairs)


def near_words(words: DataFrame, min_length: int, limit: int = LIMIT) -> DataFrame:
    """word, near, near_n: every pair of ``words`` (word, n) one edit apart, both ways."""
    rows = blocks(words, min_length, limit).repartition(F.col("block")).sortWithinPartitions("block")
    return rows.mapInArrow(_near, "word string, near string, near_n long")


def spelling_variants(
    docs: DataFrame, min_length: int = 7, min_count: int = 2, ratio: int = 10, every: int = 31, limit: int = LIMIT,
    text: str = "text", doc_id: str = "doc_id",
) -> DataFrame:
    """word, n, form, form_n, n_near and root of every word.

    The form of a word is its most frequent near word (ties: smallest in code-point order) if that is
    at least ``ratio`` times as frequent; the root is the last of its forms' forms.
    """
    words = settle(word_counts(docs, min_length, min_count, every, text, doc_id), "words")
    near = near_words(words, min_length, limit).groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best")
    )
    often = -F.col("best.less") >= ratio * F.col("n")
    named = settle(
        words.join(near, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(often, F.col("best.near")).alias("form"), F.when(often, -F.col("best.less")).alias("form_n"),
        ),
        "forms",
    )
    # every step multiplies the count, so chains are as short as its logarithm
    roots = shortened(named.where("form is not null").select(F.col("word").alias("id"), F.col("form").alias("component")))
    return named.join(roots.withColumnsRenamed({"id": "word", "component": "root"}), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
