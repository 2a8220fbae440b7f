"""Connected components of links, named by their smallest member, by hooking and contraction.

Every round each component hooks onto its smallest neighbour, chains of hooks are shortened by
pointer doubling, and the links are rewritten to the new names; links inside a component vanish.
At least half of the linked components vanish with each round, so rounds grow with the logarithm.
Nothing but row counts reaches the driver. A hub with any number of neighbours is one row per task
in the aggregation and a skew-split side in the joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.common import settle


def renamed(rows: DataFrame, column: str, names: DataFrame) -> DataFrame:
    """``column`` replaced by ``names`` (id, component) where it is listed."""
    other = names.select(F.col("id").alias("_from"), F.col("component").alias("_to"))
    joined = rows.join(other, rows[column] == F.col("_from"), "left")
    return joined.withColumn(column, F.coalesce("_to", column)).select(*rows.columns)


def shortened(hooks: DataFrame) -> DataFrame:
    """Chains id -> component followed to their ends."""
    while True:
        other = hooks.select(F.col("id").alias("_from"), F.col("component").alias("_to"))
        next_ = settle(
            hooks.join(other, hooks["component"] == F.col("_from"), "left").select(
                "id", F.coalesce("_to", "component").alias("component"), F.col("_to").isNotNull().alias("_moved")
            ),
            "components",
        )
        hooks = next_.drop("_moved")
        if next_.where("_moved").isEmpty():
            return hooks


def merge_components(names: DataFrame, links: DataFrame) -> DataFrame:
    """``names`` (id, component) brought up to date with ``links`` (a, b); unlisted ids name themselves."""
    open_links = renamed(renamed(links, "a", names), "b", names).where("a <> b").distinct()
    open_links = settle(open_links, "components")
    while not open_links.isEmpty():
        both = open_links.select("a", "b").unionAll(open_links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("component")).where("component < id")
        hooks = shortened(settle(hooks, "components"))
        kept = renamed(names, "component", hooks)
        # an id that hooks for the first time was no member of a component before
        new = hooks.join(names.select("id"), "id", "left_anti")
        names = settle(kept.unionByName(new), "components")
        open_links = settle(
            renamed(renamed(open_links, "a", hooks), "b", hooks).where("a <> b").distinct(), "components"
        )
    return names
