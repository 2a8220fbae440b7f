"""A keyed table that streams keep up to date: a snapshot in parts, of which a batch rewrites only the touched ones.

``data/version=B/part=P`` holds the rows of part P as batch B left them, and a commit names the version
of every part. Readers take the last commit, so they never see half a batch and never merge batches:
after a thousand batches a read is as cheap as after ten. A batch that is repeated starts from the
commit before it and writes the same again. A lost executor costs the tasks of one batch.

Parts are ranges of the id for feeds, whose new rows have new ids, and hashes of the key otherwise. Of
rows with one key the first or the last (by ``order``) stays. Versions that no commit names any more may
be removed by age; what comes to the driver is one row per part.
"""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ID_SPAN = 1 << 20
HASH_PARTS = 64
# commits that are kept: a stream repeats at most its last batch
KEPT = 4

_COMMIT = "slot int, batch long, part long, version long"


def id_range(column: str, span: int = ID_SPAN) -> Column:
    return F.floor(F.col(column) / span)


def key_hash(key: Collection[str], parts: int = HASH_PARTS) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(parts))


class KeyedStore:
    """One row per ``key``; ``order`` (a column that grows) decides, without it the first row that came stays."""

    def __init__(
        self, spark: SparkSession, root: str, schema: T.StructType, key: Collection[str], part: Column, order: str | None = None
    ):
        self.spark, self.root, self.schema = spark, root, schema
        self.key, self.part, self.order = list(key), part, order

    def _commit_before(self, batch: int | None = None) -> dict[int, int]:
        """Version of each part in the last commit, or in the last one before ``batch``."""
        try:
            commits = self.spark.read.schema(_COMMIT).parquet(f"{self.root}/commits")
            rows = commits.where(F.lit(True) if batch is None else F.col("batch") < batch).collect()
        except Exception as error:
            if "PATH_NOT_FOUND" in str(error):
                return {}
            raise
        last = max((r.batch for r in rows), default=None)
        return {r.part: r.version for r in rows if r.batch == last and r.part is not None}

    def _read(self, versions: dict[int, int], spark: SparkSession | None = None) -> DataFrame:
        spark = spark or self.spark
        paths = [f"{self.root}/data/version={v}/part={p}" for p, v in sorted(versions.items())]
        if not paths:
            return spark.createDataFrame([], self.schema)
        return spark.read.schema(self.schema).parquet(*paths)

    def table(self) -> DataFrame:
        return self._read(self._commit_before())

    def _one_each(self, rows: DataFrame) -> DataFrame:
        """One row per key of rows with ``_new`` (0: stored, 1: of this batch)."""
        rest = F.struct(*[F.col(f.name) for f in self.schema])
        rank = F.struct("_new") if self.order is None else F.struct(F.col(self.order), (-F.col("_new")).alias("_old"))
        pick = F.min_by if self.order is None else F.max_by
        kept = rows.groupBy("_part", *[F.col(k).alias(f"_key_{k}") for k in self.key]).agg(pick(rest, rank).alias("_row"))
        return kept.select(F.col("_part").alias("part"), "_row.*")

    def apply(self, batch_rows: DataFrame, batch: int) -> None:
        """Merge the rows of ``batch`` and commit."""
        # a stream's batches come with a session of their own
        new = batch_rows.select(*self.schema.names)
        touched = [r[0] for r in new.select(self.part.alias("part")).distinct().collect()]
        versions = self._commit_before(batch)
        stored = self._read({p: v for p, v in versions.items() if p in touched}, batch_rows.sparkSession)
        both = stored.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1))).withColumn("_part", self.part)
        if touched:
            self._one_each(both).write.mode("overwrite").partitionBy("part").parquet(f"{self.root}/data/version={batch}")
        versions = {**versions, **dict.fromkeys(touched, batch)}
        # a commit is one file of one row per part; a store without rows still has one
        rows = [(batch, p, v) for p, v in versions.items()] or [(batch, None, None)]
        commit = self.spark.createDataFrame(rows, "batch long, part long, version long").coalesce(1)
        commit.write.mode("overwrite").parquet(f"{self.root}/commits/slot={batch % KEPT}")

    def run_available(self, stream: DataFrame, checkpoint: str) -> DataFrame:
        """Merge everything that has landed, then stop; returns the table."""
        query = (
            stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(self.apply).start()
        )
        query.awaitTermination()
        return self.table()
