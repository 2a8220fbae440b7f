"""Shared helpers: reading the documents, tables in the shared folder, words and ragged arrays."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from lorekeep.session import ensure_checkpoint_dir

# A word of every contract: a run of anything but ASCII white space. The same text is valid in
# Java, Python and RE2.
WORD = r"[^\x20\x09-\x0D]+"

# str.split() also splits at these; they belong to words here.
_ODD_SPACE = re.compile("[\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_ODD_ASCII = "\x1c\x1d\x1e\x1f"
_WORDS = re.compile(WORD)


def read_table(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def new_shared_folder(spark: SparkSession, name: str) -> str:
    """A path of its own in the folder that driver and executors share."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The plan is cut and lost executors cost at most a re-read; unlike a checkpoint the table is
    compressed, columns are pruned from it and Spark knows its size.
    """
    path = new_shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def words_of(text: str) -> list[str]:
    """Words by ``WORD``; the fast split where it gives the same."""
    odd = any(c in text for c in _ODD_ASCII) if text.isascii() else _ODD_SPACE.search(text)
    return _WORDS.findall(text) if odd else text.split()


def _slices(batch: pa.RecordBatch, rows: int, size: int) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``rows`` rows and, but for a single larger row, ``size`` bytes of text."""
    weight = np.zeros(batch.num_rows, np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
            weight += np.asarray(pc.fill_null(pc.binary_length(column), 0), np.int64)
    total = np.concatenate([[0], np.cumsum(weight)])
    start = 0
    while start < batch.num_rows:
        end = int(np.searchsorted(total, total[start] + size, "right")) - 1
        end = min(max(end, start + 1), start + rows, batch.num_rows)
        yield batch.slice(start, end - start)
        start = end


def map_rows(
    df: DataFrame, schema: str, build: Callable[[], Callable[[dict[str, list]], dict[str, list]]],
    rows: int = 512, size: int = 4 << 20,
) -> DataFrame:
    """``mapInArrow`` over slices bounded in rows and bytes.

    ``build()`` runs once per task and returns a function from a dict of columns (Python lists) to
    a dict of columns (lists or Arrow arrays) named as in ``schema``.
    """
    fields = StructType.fromDDL(schema).fields
    kinds = {field.name: to_arrow_type(field.dataType) for field in fields}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = build()
        for batch in batches:
            for piece in _slices(batch, rows, size):
                made = step(piece.to_pydict())
                columns = [
                    made[name] if isinstance(made[name], pa.Array) else pa.array(made[name], kind)
                    for name, kind in kinds.items()
                ]
                yield pa.RecordBatch.from_arrays(columns, names=list(kinds))

    return df.mapInArrow(run, schema)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions ``starts[i] .. starts[i] + lengths[i] - 1``, one after another."""
    total = int(lengths.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)
