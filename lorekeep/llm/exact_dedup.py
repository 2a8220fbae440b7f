"""Exact duplicates by MSD radix partitioning.

A text is taken as its length followed by its bytes. Each pass groups the documents that are still
together by their next bytes, a digit of growing width, and a pass keeps only groups of two or
more; a group is finished when it has one member or its bytes have ended. Equality is decided by
the bytes alone: no digest is compared.

* A pass is one aggregation, combined on the map side, and one join of the open documents with one
  row per group. Of a group of any size the aggregation moves one row per task; the join's long
  side is split by adaptive execution.
* The first pass sees every document by a short prefix; later ones only those that still share
  everything so far. Digits grow by ``growth``, so the number of passes is the logarithm of the
  longest repeated text.
* Group numbers are given to written rows, so a lost executor cannot change them.

Defined cases: a null text is the empty text; empty texts form a group; repeated rows (same id,
same text) are one group of which exactly one row is kept; with equal ids any one of them; a null
id loses against every other; an empty table gives an empty result. Other columns may have any
name: internal names start with ``_radix_``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.common import settle, text_of

_LEAST = -(2**63)


def exact_groups(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", carry: list[str] | None = None,
    first_width: int = 64, growth: int = 8,
) -> DataFrame:
    """One row per document: ``carry`` columns (default the id), keep_id, group_size, kept."""
    carry = carry or [doc_id]
    value = text_of(text).cast("binary")
    size, head = F.octet_length(value).cast("long"), F.substring(value, 1, first_width)
    rows = docs.select(
        *[F.col(c).alias(f"_radix_c{i}") for i, c in enumerate(carry)],
        F.col(doc_id).cast("long").alias("_radix_id"), size.alias("_radix_size"), head.alias("_radix_digit"),
        value.alias("_radix_text"),
    )
    keys = ["_radix_size", "_radix_digit"]
    # merge joins throughout: whether a table is small must not decide what is shuffled
    groups = settle(
        rows.groupBy(*keys).agg(F.count("*").alias("_radix_n")).where("_radix_n > 1")
        .withColumn("_radix_group", F.monotonically_increasing_id()).drop("_radix_n"),
        "radix",
    ).hint("merge")
    out = [f"_radix_c{i}" for i in range(len(carry))]
    alone = rows.join(groups, keys, "left_anti").select(
        *out, F.col("_radix_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept")
    )
    finished = [alone]
    open_rows = settle(
        rows.join(groups, keys).drop("_radix_digit").withColumn("_radix_row", F.monotonically_increasing_id()), "radix"
    )
    offset, width = 0, first_width
    while not open_rows.isEmpty():
        keys = ["_radix_group", "_radix_digit"]
        digit = F.substring(F.col("_radix_text"), offset + 1, width)
        keyed = open_rows.withColumn("_radix_digit", digit)
        ranked = F.coalesce(F.col("_radix_id"), F.lit(_LEAST))
        groups = settle(
            keyed.groupBy(*keys).agg(
                F.count("*").alias("group_size"), F.max("_radix_id").alias("keep_id"),
                F.max_by("_radix_row", ranked).alias("_radix_kept"),
            ).where("group_size > 1").withColumn("_radix_next", F.monotonically_increasing_id()),
            "radix",
        ).hint("merge")
        single, ended = F.col("group_size").isNull(), F.col("_radix_size") <= offset + width
        done = single | ended
        split = settle(
            keyed.join(groups, keys, "left").select(
                *out, "_radix_id", "_radix_size", "_radix_row", F.col("_radix_next").alias("_radix_group"),
                F.when(~done, F.col("_radix_text")).alias("_radix_text"), done.alias("_radix_done"),
                F.when(single, F.col("_radix_id")).otherwise(F.col("keep_id")).alias("keep_id"),
                F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
                (single | (F.col("_radix_kept") == F.col("_radix_row"))).alias("kept"),
            ),
            "radix",
        )
        finished.append(split.where("_radix_done").select(*out, "keep_id", "group_size", "kept"))
        open_rows = split.where("not _radix_done").drop("_radix_done", "keep_id", "group_size", "kept")
        # the first pass over the open rows reads the first digit again, to name who stays
        offset, width = offset + width, width * growth
    return reduce(DataFrame.unionByName, finished).withColumnsRenamed(
        {f"_radix_c{i}": c for i, c in enumerate(carry)}
    )


def exact_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows that stay, with the columns of ``docs``."""
    names = docs.columns
    safe = docs.toDF(*[f"_in{i}" for i in range(len(names))])
    kept = exact_groups(
        safe, f"_in{names.index(text)}", f"_in{names.index(doc_id)}", carry=safe.columns
    ).where("kept").select(*safe.columns)
    return kept.toDF(*names)
