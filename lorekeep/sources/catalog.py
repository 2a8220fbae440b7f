"""Catalogs: tables by name, with fixed schemas."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from lorekeep.sources import sample
from lorekeep.sources.schemas import SCHEMAS


class Catalog:
    """Wiki tables stored as parquet under one folder, one subfolder per table.

    ``catalog["page"]`` and ``catalog.page`` are the same DataFrame. The declared
    schema is passed to the reader, so nothing is inferred and columns missing in
    older files come back as NULL.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark = spark
        self.root = root.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def schema(self, name: str) -> T.StructType:
        return SCHEMAS[name]

    def table(self, name: str) -> DataFrame:
        return self.spark.read.schema(self.schema(name)).parquet(self.path(name))

    def __getitem__(self, name: str) -> DataFrame:
        return self.table(name)

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in self.names():
            raise AttributeError(name)
        return self.table(name)

    def names(self) -> list[str]:
        return sorted(SCHEMAS)


class MemoryCatalog(Catalog):
    """Tables given as DataFrames; used by jobs that chain in one session."""

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame]) -> None:
        super().__init__(spark, "")
        self.tables = dict(tables)

    def table(self, name: str) -> DataFrame:
        return self.tables[name]

    def names(self) -> list[str]:
        return sorted(self.tables)


class SampleCatalog(Catalog):
    """Wiki tables computed from the driver's sample tables (see ``sample``)."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        super().__init__(spark, sf_dir)
        self.prefix = "lk_" + re.sub(r"\W", "_", sf_dir.strip("/")) + "__"
        self._known: dict[str, DataFrame] = {}

    def names(self) -> list[str]:
        return sorted([*sample.TABLES, *sample.DRIVER_TABLES])

    def table(self, name: str) -> DataFrame:
        if name not in self._known:
            if name in sample.TABLES:
                self._known[name] = self.sql(sample.spark_sql(name))
            else:
                self._known[name] = self.spark.read.parquet(f"{self.root}/{name}.parquet")
        return self._known[name]

    def sql(self, text: str) -> DataFrame:
        """Run SQL in which ``@name`` stands for a table of this catalog."""

        def view(match: re.Match) -> str:
            name = match.group(1)
            if name not in self._known or not self.spark.catalog.tableExists(self.prefix + name):
                self.table(name).createOrReplaceTempView(self.prefix + name)
            return self.prefix + name

        return self.spark.sql(re.sub(r"@(\w+)", view, text))
