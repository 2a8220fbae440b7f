"""Mixing sources to target weights by capped water-filling.

Every source gets a share of the budget in proportion to its weight; sources whose share would pass
``max_epochs`` times their size are clamped there, and the excess is shared again among the others
by weight until no target is above its cap. A source is then taken ``floor(target / size)`` times
as a whole, and the rest by a seeded sample: documents are ordered by a hash of seed and id, and
the sample ends at the hash cell where the words come nearest to what is missing.

DataFrame functions only. The cells are found in two steps of 4096 cells per source, each an
aggregation combined on the map side, so that no source, however large, is gathered in one place;
only one row per source is ever joined back, broadcast when the counted number of sources is small
and by a skew-split join beyond it.

Defined cases: a null text has no words; a null source is a source of its own, last in order; a
source without words has target 0 and takes nothing; repeated rows (same id) share a cell and are
taken together; rows without id are told apart by their texts; an empty table gives an empty result.
Other columns may have any name; ``mix`` replaces those that have the names of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.llm.common import WORD, settle, text_of

BROADCAST_SOURCES = 20_000
MADE = ["mix_size", "mix_source_size", "mix_target", "mix_repeats"]


def _numbered(sources: DataFrame) -> DataFrame:
    """Position of each source by code point from 0, null last, without one task for all."""
    ranged = sources.repartitionByRange(F.col("_mix_source").asc_nulls_last()).sortWithinPartitions(
        F.col("_mix_source").asc_nulls_last()
    ).withColumn("_mix_at", F.monotonically_increasing_id())
    ranged = settle(ranged, "mix")
    part = F.shiftright("_mix_at", 33)
    before = ranged.groupBy(part.alias("_mix_part")).agg(F.count("*").alias("_mix_n"))
    # one row per partition of the range sort
    before = before.withColumn(
        "_mix_before", F.sum("_mix_n").over(Window.orderBy("_mix_part").rowsBetween(Window.unboundedPreceding, -1))
    ).select("_mix_part", "_mix_before")
    at = F.col("_mix_at").bitwiseAND(F.lit(2**33 - 1)) + F.coalesce("_mix_before", F.lit(0))
    return ranged.withColumn("_mix_part", part).join(before, "_mix_part").withColumn("_mix_at", at).drop(
        "_mix_part", "_mix_before"
    )


def water_fill(sources: DataFrame, budget: float, max_epochs: int) -> DataFrame:
    """Add ``_mix_target`` to rows of (``_mix_size``, ``_mix_weight``); they are one per source."""
    cap = F.col("_mix_size") * max_epochs
    clamped, n_clamped, level = F.lit(False), -1, 0.0
    total = sources.agg(F.sum("_mix_size")).first()[0] or 0
    while True:
        held, weight, n = sources.agg(
            F.coalesce(F.sum(F.when(clamped, cap)), F.lit(0)),
            F.coalesce(F.sum(F.when(~clamped, F.col("_mix_weight"))), F.lit(0)),
            F.count(F.when(clamped, 1)),
        ).first()
        if n == n_clamped:
            break
        # sources once clamped stay so: the level only rises
        n_clamped, level = n, (budget * total - held) / weight if weight else 0.0
        clamped = F.col("_mix_weight") * F.lit(level) > cap
    target = F.when(clamped, cap.cast("double")).otherwise(F.col("_mix_weight") * F.lit(level))
    return sources.withColumn("_mix_target", target)


def _boundary(cells: DataFrame, cell: str) -> DataFrame:
    """The cell in which the sum of sizes reaches what a source needs, and the sum before it."""
    order = Window.partitionBy("_mix_source").orderBy(cell)
    after = F.sum("_mix_cell_size").over(order)
    return cells.withColumn("_mix_after", after).withColumn(
        "_mix_before", F.col("_mix_after") - F.col("_mix_cell_size")
    ).where("_mix_before < _mix_need and _mix_need <= _mix_after")


def mix(
    docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id",
    weights: tuple[int, ...] = (3, 1, 2), budget: float = 1.5, max_epochs: int = 2, seed: int = 7,
) -> DataFrame:
    """``docs`` with ``mix_size``, ``mix_source_size``, ``mix_target`` and ``mix_repeats``.

    ``budget`` is the size of the mix as a multiple of all words; ``weights`` go to the sources in
    code-point order, repeating.
    """
    names = docs.columns
    safe = docs.toDF(*[f"_in{i}" for i in range(len(names))])
    mixed = _mixed(
        safe, *(f"_in{names.index(c)}" for c in (text, source, doc_id)), weights=weights, budget=budget,
        max_epochs=max_epochs, seed=seed,
    )
    kept = [i for i, name in enumerate(names) if name not in MADE]
    made = [f"_mix_{name}" for name in ("size", "source_size", "target", "repeats")]
    return mixed.select(*[f"_in{i}" for i in kept], *made).toDF(*[names[i] for i in kept], *MADE)


def _mixed(
    docs: DataFrame, text: str, source: str, doc_id: str, weights: tuple[int, ...] = (3, 1, 2), budget: float = 1.5,
    max_epochs: int = 2, seed: int = 7,
) -> DataFrame:
    """``docs``, whose column names are not ours, with ``_mix_size``, ``_mix_source_size``, ``_mix_target``, ``_mix_repeats``."""
    known = F.coalesce(F.col(doc_id).cast("string"), F.concat(F.lit(":"), text_of(text)))
    cell = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), known)), 1, 6)
    size = F.regexp_count(text_of(text), F.lit(WORD)).cast("long")
    slim = settle(
        docs.select(F.col(source).cast("string").alias("_mix_source"), size.alias("_mix_size"), cell.alias("_mix_cell")),
        "mix",
    )
    sources = settle(
        _numbered(slim.groupBy("_mix_source").agg(F.sum("_mix_size").alias("_mix_size"))).withColumn(
            "_mix_weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("_mix_at") % len(weights) + 1).cast("int"))
        ),
        "mix",
    )
    small = sources.count() <= BROADCAST_SOURCES

    def per_source(rows: DataFrame, other: DataFrame, *more) -> DataFrame:
        on = rows["_mix_source"].eqNullSafe(other["_mix_source"])
        for c in more:
            on = on & (rows[c] == other[c])
        return rows.join(F.broadcast(other) if small else other, on).drop(other["_mix_source"])

    filled = water_fill(sources, budget, max_epochs)
    whole = F.when(F.col("_mix_size") > 0, F.floor(F.col("_mix_target") / F.col("_mix_size"))).otherwise(0)
    filled = filled.withColumn("_mix_whole", whole.cast("int")).withColumn(
        "_mix_need", F.col("_mix_target") - F.col("_mix_whole") * F.col("_mix_size")
    )
    plan = filled.select("_mix_source", "_mix_need")
    coarse = slim.groupBy("_mix_source", F.substring("_mix_cell", 1, 3).alias("_mix_c1")).agg(
        F.sum("_mix_size").alias("_mix_cell_size")
    )
    first = settle(
        _boundary(per_source(coarse, plan), "_mix_c1").select(
            "_mix_source", "_mix_c1", (F.col("_mix_need") - F.col("_mix_before")).alias("_mix_need")
        ),
        "mix",
    )
    fine = slim.withColumn("_mix_c1", F.substring("_mix_cell", 1, 3)).groupBy("_mix_source", "_mix_c1", "_mix_cell").agg(
        F.sum("_mix_size").alias("_mix_cell_size")
    )
    found = first.select("_mix_source", F.col("_mix_c1").alias("_mix_f1"), "_mix_need")
    fine = per_source(fine, found).where("_mix_c1 = _mix_f1")
    nearer = F.col("_mix_after") - F.col("_mix_need") <= F.col("_mix_need") - F.col("_mix_before")
    limit = _boundary(fine, "_mix_cell").select("_mix_source", F.col("_mix_cell").alias("_mix_limit"), nearer.alias("_mix_in"))
    filled, limit = filled.alias("f"), limit.alias("l")
    table = settle(
        filled.join(limit, F.col("f._mix_source").eqNullSafe(F.col("l._mix_source")), "left").select(
            "f._mix_source", F.col("_mix_size").alias("_mix_source_size"), "_mix_target", "_mix_whole", "_mix_limit", "_mix_in",
        ),
        "mix",
    )
    rows = docs.withColumns({"_mix_source": F.col(source).cast("string"), "_mix_size": size, "_mix_cell": cell})
    more = (F.col("_mix_cell") < F.col("_mix_limit")) | ((F.col("_mix_cell") == F.col("_mix_limit")) & F.col("_mix_in"))
    mixed = per_source(rows, table)
    repeats = F.col("_mix_whole") + F.when(F.coalesce(more, F.lit(False)), 1).otherwise(0)
    return mixed.withColumn("_mix_repeats", repeats).select(
        *docs.columns, "_mix_size", "_mix_source_size", "_mix_target", "_mix_repeats"
    )


def mixed_documents(
    docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", **options
) -> DataFrame:
    """The mix itself: each document as often as it is taken, with the columns of ``docs``."""
    names = docs.columns
    safe = docs.toDF(*[f"_in{i}" for i in range(len(names))])
    mixed = _mixed(safe, *(f"_in{names.index(c)}" for c in (text, source, doc_id)), **options).where("_mix_repeats > 0")
    copies = F.explode(F.sequence(F.lit(1), F.col("_mix_repeats")))
    return mixed.withColumn("_mix_copy", copies).select(*safe.columns).toDF(*names)
