"""Building blocks shared by list queries, page properties and reports."""

from __future__ import annotations

import datetime as dt
from collections.abc import Collection, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.functions.times import as_timestamp, never
from lorekeep.functions.titles import prefixed
from lorekeep.sources.catalog import Catalog
from lorekeep.sources.schemas import (
    DELETED_ACTION, DELETED_COMMENT, DELETED_RESTRICTED, DELETED_TEXT, DELETED_USER,
)

Time = dt.datetime | str


def as_set(value) -> list:
    """A scalar or a collection as a sorted list."""
    if isinstance(value, (set, frozenset, list, tuple)):
        return sorted(value)
    return [value]


def check_choice(name: str, value, allowed: Collection) -> None:
    if value not in allowed:
        raise ValueError(f"{name}={value!r} is not one of {sorted(map(str, allowed))}")


def check_subset(name: str, values: Iterable, allowed: Collection) -> None:
    extra = set(values) - set(allowed)
    if extra:
        raise ValueError(f"{name} does not accept {sorted(map(str, extra))}")


def bounds(direction: str, start, end, up: str = "newer", down: str = "older"):
    """(lowest, highest) of a range given in reading direction."""
    check_choice("direction", direction, {up, down})
    low, high = (start, end) if direction == up else (end, start)
    if low is not None and high is not None and not low < high:
        raise ValueError("the range is empty: check start, end and direction")
    return low, high


def in_time_range(df: DataFrame, column: str, direction: str, start: Time | None, end: Time | None) -> DataFrame:
    """Keep rows between ``start`` and ``end``, both included, in reading direction."""
    low, high = bounds(direction, start, end)
    if low is not None:
        df = df.where(F.col(column) >= as_timestamp(low))
    if high is not None:
        df = df.where(F.col(column) <= as_timestamp(high))
    return df


def in_title_range(df: DataFrame, column: str, direction: str, start: str | None, end: str | None) -> DataFrame:
    low, high = bounds(direction, start, end, up="ascending", down="descending")
    if low is not None:
        df = df.where(F.col(column) >= low)
    if high is not None:
        df = df.where(F.col(column) <= high)
    return df


def ordered(df: DataFrame, columns: list[str], descending: bool, limit: int | None = None) -> DataFrame:
    keys = [F.col(c).desc() if descending else F.col(c).asc() for c in columns]
    df = df.orderBy(*keys)
    return df.limit(limit) if limit is not None else df


def flag_filter(df: DataFrame, show: Collection[str], flags: dict[str, Column]) -> DataFrame:
    """Tri-state flags: ``x`` keeps rows where it holds, ``!x`` those where it does not."""
    check_subset("show", show, {*flags, *("!" + f for f in flags)})
    for name in show:
        bare = name.lstrip("!")
        if bare in show and "!" + bare in show:
            raise ValueError(f"show has both {bare} and !{bare}")
        wanted = F.coalesce(flags[bare], F.lit(False))
        df = df.where(~wanted if name.startswith("!") else wanted)
    return df


def not_expired(expiry: Column, now: Time) -> Column:
    """Expiry in the future; a missing expiry never ends."""
    return F.coalesce(expiry, never()) > as_timestamp(now)


def is_indefinite(expiry: Column) -> Column:
    return F.coalesce(expiry, never()) >= never()


def with_namespace(df: DataFrame, cat: Catalog, ns: str, name: str = "nss_name") -> DataFrame:
    """Left join the local name of namespace column ``ns``; Spark broadcasts the small side."""
    names = cat["namespace_starname"].select(F.col("nss_id").alias("_nss_id"), F.col("nss_name").alias(name))
    return df.join(names, F.col(ns) == F.col("_nss_id"), "left").drop("_nss_id")


def tag_names(cat: Catalog, table: str, wanted: DataFrame | None = None) -> DataFrame:
    """``(entity, tag_names)`` of one assignment table, names sorted; of the ``wanted`` entities only.

    Tags per entity are few (at most the tag catalogue), so the arrays stay small.
    """
    tag_id, entity = TAG_TABLES[table]
    tags = cat["tag"].select("tag_id", "tag_name")
    assigned = cat[table].select(F.col(entity).alias("_entity"), F.col(tag_id).alias("_tag"))
    if wanted is not None:
        # the join leaves the rows dealt by entity, as the aggregation needs them
        assigned = assigned.join(wanted, "_entity", "left_semi")
    return (
        assigned.join(tags, F.col("_tag") == F.col("tag_id"))
        .groupBy("_entity")
        .agg(F.sort_array(F.collect_set("tag_name")).alias("tag_names"))
    )


TAG_TABLES = {
    "tagged_recentchange": ("tgrc_tag_id", "tgrc_rc_id"),
    "tagged_logevent": ("tgle_tag_id", "tgle_log_id"),
    "tagged_revision": ("tgrev_tag_id", "tgrev_rev_id"),
    "tagged_archived_revision": ("tgar_tag_id", "tgar_rev_id"),
}


def with_tags(df: DataFrame, cat: Catalog, table: str, key: str) -> DataFrame:
    """Add ``tag_names``; entities without tags get an empty array.

    Only assignments of rows that ``df`` has kept are joined to names and aggregated.
    """
    wanted = df.select(F.col(key).alias("_entity")).where("_entity is not null")
    joined = df.join(tag_names(cat, table, wanted), F.col(key) == F.col("_entity"), "left").drop("_entity")
    empty = F.array().cast("array<string>")
    return joined.withColumn("tag_names", F.coalesce("tag_names", empty))


def tagged_with(df: DataFrame, cat: Catalog, table: str, key: str, tag: str) -> DataFrame:
    """Rows that carry the tag ``tag``."""
    tag_id, entity = TAG_TABLES[table]
    wanted = cat["tag"].where(F.col("tag_name") == tag).select("tag_id")
    hits = cat[table].join(wanted, F.col(tag_id) == F.col("tag_id"), "left_semi")
    return df.join(hits.select(F.col(entity).alias("_entity")), F.col(key) == F.col("_entity"), "left_semi")


def has_bit(bits: Column, bit: int) -> Column:
    return bits.bitwiseAND(F.lit(bit)) != 0


def mark(condition: Column) -> Column:
    """Boolean as the surface shows it: an empty string when set, absent otherwise."""
    return F.when(condition, F.lit(""))


def hidden_marks(bits: Column, is_log: Column | None = None) -> list[Column]:
    """Marks of a deletion bitmask, as the surface names them."""
    is_log = F.lit(False) if is_log is None else is_log
    return [
        mark(has_bit(bits, DELETED_TEXT) & ~is_log).alias("sha1hidden"),
        mark(has_bit(bits, DELETED_ACTION) & is_log).alias("actionhidden"),
        mark(has_bit(bits, DELETED_COMMENT)).alias("commenthidden"),
        mark(has_bit(bits, DELETED_USER)).alias("userhidden"),
        mark(has_bit(bits, DELETED_RESTRICTED)).alias("suppressed"),
    ]


def shaped(df: DataFrame, names: dict[str, str], zeroable: Collection[str], flags: dict[str, str]) -> list[Column]:
    """Surface columns for the stored columns that ``df`` has."""
    out = []
    for column, name in names.items():
        if column in df.columns:
            value = F.col(column)
            out.append((F.coalesce(value, F.lit(0)) if column in zeroable else value).alias(name))
    out += [mark(F.col(c)).alias(name) for c, name in flags.items() if c in df.columns]
    return out


def shaped_title(df: DataFrame, title: str) -> list[Column]:
    if "nss_name" in df.columns and title in df.columns:
        return [prefixed(F.col("nss_name"), F.col(title)).alias("title")]
    return []


def as_json(df: DataFrame, name: str = "entry") -> DataFrame:
    """One JSON object per row; NULL fields are left out, as on the surface."""
    return df.select(F.to_json(F.struct(*df.columns)).alias(name))
