"""Token ids in files: canonical length-limited Huffman codes in independent blocks.

A token folder holds

* ``codes``: Parquet rows (id, length). Lengths come from the global counts of all ids by
  package-merge, at most ``MAX_BITS``; the codes are canonical: counted up by (length, id).
* ``blocks``: Parquet rows in ascending id order of the documents, one block of whole documents
  each: ``file`` (number of the id range), ``seq`` (place in it), ``before`` (ids of the file before
  the block), ``n`` (ids in it), ``doc_ids`` and ``counts`` (per document), ``payload`` (codes, most
  significant bit first, each document from a whole byte) and ``points``: for every document and
  every ``POINT`` ids of it, the bit of the payload where they begin, as 64-bit integers.

A block needs nothing but the codes to be read: a table over ``MAX_BITS`` bits gives id and length
of the next code, and all points of a block are decoded side by side. Spark's writer commits the
files, so a lost executor leaves no half-written block, and any store that Spark reads will do.

Steps: tokenize once into a staged table; count ids; give each document its range of ids (quantiles
of the column, so nothing is tokenized twice); encode; shuffle the compressed documents to their
ranges; sort and pack. What comes to the driver is one count per id of the vocabulary and one row
per file.

Defined cases: null is the empty text and has the end id alone; texts are read whole, a document
is never cut; repeated ids lie side by side, ordered by their bytes; null ids come first; an empty
table gives empty files and no rows; other columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.llm.bpe import byte_symbols
from lorekeep.llm.chunks import ChunkCache, Cutter, read_spec
from lorekeep.llm.common import map_rows, ragged, settle, text_of
from lorekeep.session import ensure_checkpoint_dir

MAX_BITS = 16
POINT = 128
BLOCK_IDS = 1 << 17
FILE_IDS = 1 << 23

BLOCKS = (
    "file int, seq long, before long, n long, doc_ids array<long>, counts array<long>, payload binary, points binary"
)


# ---- codes --------------------------------------------------------------------------------


def code_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits by package-merge; 0 for ids that don't occur."""
    lengths = np.zeros(len(counts), np.int64)
    used = np.flatnonzero(counts)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} ids need more than {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    coins = counts[order].astype(np.int64)
    level, marks = coins, [np.zeros(len(coins), bool)]
    for _ in range(limit - 1):
        packages = level[: len(level) // 2 * 2].reshape(-1, 2).sum(axis=1)
        merged = np.concatenate([coins, packages])
        by_weight = np.argsort(merged, kind="stable")
        level = merged[by_weight]
        marks.append(by_weight >= len(coins))
    take = 2 * len(coins) - 2
    ranked = np.zeros(len(coins), np.int64)
    for is_package in reversed(marks):
        packages = int(is_package[:take].sum())
        ranked[: take - packages] += 1
        take = 2 * packages
    lengths[order] = ranked
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    codes = np.zeros(len(lengths), np.int64)
    used = np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    if len(order):
        # the next code is the last one plus one, shifted to its own length
        steps = np.int64(1) << (int(lengths.max()) - lengths[order])
        first = np.concatenate([[0], np.cumsum(steps)[:-1]])
        codes[order] = first // steps
    return codes


def decode_table(lengths: np.ndarray) -> np.ndarray:
    """Id and code length, as ``id << 5 | length``, for every value of the next ``MAX_BITS`` bits."""
    used = np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    spans = np.int64(1) << (MAX_BITS - lengths[order])
    table = np.ones(1 << MAX_BITS, np.int32)
    table[: int(spans.sum())] = np.repeat(order << 5 | lengths[order], spans)
    return table


def pack(ids: np.ndarray, counts: np.ndarray, lengths: np.ndarray, codes: np.ndarray):
    """Codes of documents, each from a whole byte: payload, first byte of each document, points.

    ``points`` are (document, bit in the document) of every ``POINT`` ids.
    """
    if not len(ids):
        return b"", np.zeros(len(counts), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    width = lengths.astype(np.int32)[ids]
    ends = np.cumsum(width)
    doc_end = np.cumsum(counts)
    bits = np.diff(np.concatenate([[0], np.concatenate([[0], ends])[doc_end]]))
    size = (bits + 7) // 8
    first_byte = np.cumsum(size) - size
    at = ends - width
    at += np.repeat(8 * first_byte - (np.cumsum(bits) - bits), counts)
    aligned = codes.astype(np.uint64) << (64 - np.maximum(lengths, 1)).astype(np.uint64)
    value = aligned[ids] >> (at & 31).view(np.uint64)
    word = at >> 5
    starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
    words = np.zeros(int(word[-1]) + 2, np.uint64)
    # bits are disjoint, so sums are unions
    words[word[starts]] += np.add.reduceat(value >> np.uint64(32), starts)
    words[word[starts] + 1] += np.add.reduceat(value & np.uint64(0xFFFFFFFF), starts)
    payload = words.astype(">u4").tobytes()[: int(size.sum())]
    lanes = -(-counts // POINT)
    owner = np.repeat(np.arange(len(counts)), lanes)
    nth = np.arange(len(owner)) - (np.cumsum(lanes) - lanes)[owner]
    return payload, first_byte, owner, at[(doc_end - counts)[owner] + POINT * nth] - 8 * first_byte[owner]


def unpack(payload: bytes, counts: np.ndarray, points: np.ndarray, table: np.ndarray) -> np.ndarray:
    """All ids of a block, from every point side by side."""
    out = np.zeros(int(counts.sum()), np.int32)
    if not len(points):
        return out
    data = np.frombuffer(payload + b"\0\0\0", np.uint8).astype(np.int32)
    window = data[:-2] << 16 | data[1:-1] << 8 | data[2:]
    lanes = -(-counts // POINT)
    nth = np.arange(len(points)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
    size = np.minimum(POINT, np.repeat(counts, lanes) - nth * POINT)
    order = np.argsort(-size, kind="stable")
    to = (np.repeat(np.cumsum(counts) - counts, lanes) + nth * POINT)[order]
    at, size = points[order].copy(), size[order]
    # lanes still open at a step are a prefix
    open_lanes = np.searchsorted(-size, -np.arange(POINT), "left")
    for step in range(POINT):
        n = int(open_lanes[step])
        if not n:
            break
        now = at[:n]
        found = table[window[now >> 3] >> (8 - (now & 7)) & 0xFFFF]
        out[to[:n] + step] = found >> 5
        now += found & 31
    return out


# ---- jobs ---------------------------------------------------------------------------------


@lru_cache(maxsize=1)
def _loaded(vocabulary: str) -> ChunkCache:
    """Once per worker process: the library's tokenizer behind a cache that serves all its tasks."""
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(vocabulary).model
    symbols = dict(enumerate(byte_symbols()))

    def encode_many(pieces):
        # in byte-level vocabularies printable ASCII stands for itself
        shown = [p if p.isascii() else p.encode().decode("latin-1").translate(symbols) for p in pieces]
        shown = [p if p.isprintable() else p.translate(symbols) for p in shown]
        made = [[token.id for token in model.tokenize(p)] for p in shown]
        sizes = np.fromiter(map(len, made), np.int64, len(made))
        return np.fromiter(chain.from_iterable(made), np.int32, int(sizes.sum())), sizes

    return ChunkCache(Cutter(read_spec(vocabulary)), encode_many)


def tokenize(docs: DataFrame, vocabulary: str, end_id: int, text: str, doc_id: str) -> DataFrame:
    """doc_id, n, ids (little-endian 16-bit, or 32-bit for larger vocabularies), end id included."""

    def build():
        cache = _loaded(vocabulary)

        def step(rows):
            flat, counts = cache.encode(rows["text"])
            ends = np.cumsum(counts)
            flat = np.insert(flat, ends, end_id).astype(f"<u{width}")
            ends, counts = ends + np.arange(1, len(ends) + 1), counts + 1
            data = flat.tobytes()
            pieces = [data[width * (e - n) : width * e] for e, n in zip(ends.tolist(), counts.tolist(), strict=True)]
            return {"doc_id": rows["doc_id"], "n": counts.tolist(), "ids": pieces}

        return step

    width = id_width(vocabulary)
    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text"))
    return map_rows(slim, "doc_id long, n long, ids binary", build)


def id_width(vocabulary: str) -> int:
    from tokenizers import Tokenizer

    return 2 if Tokenizer.from_file(vocabulary).get_vocab_size() <= 1 << 16 else 4


def id_counts(staged: DataFrame, width: int) -> DataFrame:
    """id, n over all documents; a task sends one row per id it has seen."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            found = np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), f"<u{width}"))
            if len(found) > len(total):
                total, found = found.astype(np.int64), total
            total[: len(found)] += found
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(total[ids], pa.int64())], ["id", "n"])

    return staged.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write_token_files(
    docs: DataFrame, path: str, vocabulary: str, end_id: int, text: str = "text", doc_id: str = "doc_id",
    file_ids: int = FILE_IDS, block_ids: int = BLOCK_IDS,
) -> None:
    """Write the token folder ``path``."""
    spark = docs.sparkSession
    width = id_width(vocabulary)
    staged = settle(tokenize(docs, vocabulary, end_id, text, doc_id), "tokens")
    # at most one row per id of the vocabulary
    found = id_counts(staged, width).toPandas()
    counts = np.zeros(int(found["id"].max()) + 1 if len(found) else 1, np.int64)
    counts[found["id"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    lengths = code_lengths(counts)
    used = np.flatnonzero(lengths)
    spark.createDataFrame(
        [(int(i), int(lengths[i])) for i in used], "id int, length int"
    ).coalesce(1).write.parquet(f"{path}/codes")

    files = max(1, -(-int(counts.sum()) // file_ids))
    cuts = [(k + 1) / files for k in range(files - 1)]
    bounds = np.zeros(0, np.int64)
    if cuts:
        split = staged.agg(F.percentile_approx("doc_id", cuts, max(10_000, 4 * files))).first()[0]
        bounds = np.unique(np.array(split or [], np.int64))

    def build():
        codes = canonical_codes(lengths)

        def step(rows):
            ids = np.frombuffer(b"".join(rows["ids"]), f"<u{width}").astype(np.int64)
            n = np.array(rows["n"], np.int64)
            payload, first, owner, points = pack(ids, n, lengths, codes)
            edges = np.append(first, len(payload)).tolist()
            cut = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(n)))]).tolist()
            raw = points.astype("<i8").tobytes()
            least = np.iinfo(np.int64).min
            keys = np.array([least if d is None else d for d in rows["doc_id"]], np.int64)
            return {
                "file": np.searchsorted(bounds, keys, "left").tolist(), "doc_id": rows["doc_id"], "n": rows["n"],
                "payload": [payload[a:b] for a, b in zip(edges, edges[1:], strict=False)],
                "points": [raw[8 * a : 8 * b] for a, b in zip(cut, cut[1:], strict=False)],
            }

        return step

    encoded = map_rows(staged, "file int, doc_id long, n long, payload binary, points binary", build)
    ranged = encoded.repartitionById(files, F.col("file")).sortWithinPartitions(
        "file", F.col("doc_id").asc_nulls_first(), "payload"
    )
    ranged.mapInArrow(_blocks(block_ids), BLOCKS).write.parquet(f"{path}/blocks")


def _blocks(block_ids: int):
    names = [part.split()[0] for part in BLOCKS.split(", ")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, seq, before, held = None, 0, 0, []

        def close():
            nonlocal seq, before, held
            _, ids, counts, payloads, points = zip(*held, strict=True)
            shift = np.concatenate([[0], np.cumsum([8 * len(p) for p in payloads])])
            bits = [np.frombuffer(p, "<i8") + s for p, s in zip(points, shift, strict=False)]
            n = sum(counts)
            row = [file, seq, before, n, ids, counts, b"".join(payloads), np.concatenate(bits).astype("<i8").tobytes()]
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()),
                     pa.binary(), pa.binary()]
            seq, before, held = seq + 1, before + n, []
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names)

        size = 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and (row[0] != file or size + row[2] > block_ids):
                    yield close()
                    size = 0
                if row[0] != file:
                    file, seq, before = row[0], 0, 0
                held.append(row)
                size += row[2]
        if held:
            yield close()

    return run


def read_token_files(spark: SparkSession, path: str, digests: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, and ids or their unsigned CRC-32."""
    # one row per id of the vocabulary, and one per file
    codes = spark.read.schema("id int, length int").parquet(f"{path}/codes").toPandas()
    lengths = np.zeros(int(codes["id"].max()) + 1 if len(codes) else 1, np.int64)
    lengths[codes["id"].to_numpy(np.int64)] = codes["length"].to_numpy(np.int64)
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    sums = dict(map(tuple, blocks.groupBy("file").agg(F.sum("n")).collect()))
    offsets, total = {}, 0
    for file in sorted(sums):
        offsets[file] = total
        total += sums[file]

    def build():
        table = decode_table(lengths)

        def step(rows):
            made = {"doc_id": [], "start": [], "n_tokens": [], last: []}
            for file, before, doc_ids, counts, payload, points in zip(
                rows["file"], rows["before"], rows["doc_ids"], rows["counts"], rows["payload"], rows["points"],
                strict=True,
            ):
                n = np.array(counts, np.int64)
                ids = unpack(payload, n, np.frombuffer(points, "<i8"), table).astype("<u4")
                ends = np.cumsum(n)
                made["doc_id"] += doc_ids
                made["n_tokens"] += counts
                made["start"] += (offsets[file] + before + ends - n).tolist()
                own = (ids[e - c : e] for e, c in zip(ends.tolist(), counts, strict=True))
                made[last] += [zlib.crc32(x.tobytes()) if digests else x.tolist() for x in own]
            return made

        return step

    last = "ids_crc32" if digests else "ids"
    kind = "long" if digests else "array<long>"
    return map_rows(
        blocks.drop("seq", "n"), f"doc_id long, start long, n_tokens long, {last} {kind}", build, rows=8
    )


def new_folder(spark: SparkSession, name: str = "token-files") -> str:
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
