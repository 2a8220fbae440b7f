"""Closures in logarithmic rounds over append-only generations.

A loop keeps what it has found in generations: every round writes one folder of new rows to the
shared folder and never rewrites an earlier one. Plans stay short, lost executors cost a re-read,
and all rows written together are the result, plus the pointers that were still open on the way.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.session import ensure_checkpoint_dir


class Generations:
    """Rows written round by round; with ``open_column``, rows still open lie apart from closed ones."""

    def __init__(self, spark: SparkSession, open_column: str | None = None):
        self.spark, self.open_column = spark, open_column
        self.folder = f"{ensure_checkpoint_dir(spark)}/generations-{uuid.uuid4().hex}"
        self.paths: list[str] = []
        self.schema = None

    def append(self, df: DataFrame) -> DataFrame:
        """Write the rows of a round and return them as written."""
        path = f"{self.folder}/{len(self.paths)}"
        writer = df.write
        if self.open_column:
            writer = writer.partitionBy(self.open_column)
        writer.parquet(path)
        self.paths.append(path)
        self.schema = df.schema
        return self._read([path])

    def _read(self, paths: list[str]) -> DataFrame:
        # files of different rounds have the same columns, so one scan reads them all
        parts = [self.spark.read.schema(self.schema).parquet(path) for path in paths] if self.open_column else [
            self.spark.read.schema(self.schema).parquet(*paths)
        ]
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out.select(*self.schema.names)

    def all(self) -> DataFrame:
        return self._read(self.paths)

    def closed(self) -> DataFrame:
        return self.all().where(~F.col(self.open_column))

    def open(self) -> DataFrame:
        return self._read(self.paths[-1:]).where(F.col(self.open_column))


def reachable(steps: DataFrame, start: str, key: list[str], end: str) -> DataFrame:
    """Pairs of ``start`` and ``key`` joined by one or more steps; loops are pairs like others.

    ``end`` is the start that a step leads to, or NULL where it ends. Paths double: a round joins the
    pairs of the round before with all known ones, on either side, and writes those not known yet. So
    the rounds are the logarithm of the longest path.
    """
    names = [start, *key, end]
    found = Generations(steps.sparkSession)
    fresh = found.append(steps.select(*names).dropDuplicates([start, *key]))

    def joined(first: DataFrame, second: DataFrame) -> DataFrame:
        onward = second.select(F.col(start).alias("__met"), *[F.col(c).alias(f"_{c}") for c in (*key, end)])
        return first.join(onward, F.col(end) == F.col("__met")).select(start, *[F.col(f"_{c}").alias(c) for c in (*key, end)])

    while not fresh.isEmpty():
        known = found.all()
        grown = joined(fresh, known).unionByName(joined(known, fresh)).dropDuplicates([start, *key])
        fresh = found.append(grown.join(known.select(start, *key), [start, *key], "left_anti").select(*names))
    return found.all()


def chase(rows: DataFrame, node: list[str], to: list[str], fall_back: list[str] | None = None) -> DataFrame:
    """Each row's pointer ``to`` followed until it names no ``node``; rows gain ``closed``.

    Columns besides ``node`` come from the last row on the way; of those in ``fall_back`` the last
    value that is not NULL stays. Pointers double, so a chain takes as many rounds as its logarithm; a
    row is written in each round until it is closed, and once then. Rows on a loop, or leading into
    one, are not closed: a round that closes nothing leaves only those.
    """
    fall_back = fall_back or []
    others = [c for c in rows.columns if c not in node]
    known = rows.select(*[F.col(a).alias(f"_{b}") for a, b in zip(node, to, strict=True)]).distinct().withColumn("_open", F.lit(True))
    on = [F.col(c) == F.col(f"_{c}") for c in to]
    state = Generations(rows.sparkSession, "open")
    written = state.append(
        rows.join(known, on, "left").select(*rows.columns, F.coalesce("_open", F.lit(False)).alias("open"))
    )
    left = written.where("open").count()
    while left:
        open_rows = state.open()
        step = state.closed().unionByName(open_rows).select(
            *[F.col(a).alias(f"_{b}") for a, b in zip(node, to, strict=True)],
            *[F.col(c).alias(f"_next_{c}") for c in others], F.col("open").alias("_next_open"),
        )
        moved = open_rows.join(step, on).select(
            *node,
            *[(F.coalesce(f"_next_{c}", c) if c in fall_back else F.col(f"_next_{c}")).alias(c) for c in others],
            F.col("_next_open").alias("open"),
        )
        written = state.append(moved.select(*rows.columns, "open"))
        before, left = left, written.where("open").count()
        if left == before:
            break
    return state.closed().unionByName(state.open()).withColumn("closed", ~F.col("open")).drop("open")
