"""Page sets by title, id or list query, and properties attached to them."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.functions.titles import parse_titles, prefixed
from lorekeep.operators import common as c
from lorekeep.operators import lists
from lorekeep.operators.props import PROPERTIES, entries
from lorekeep.sources.catalog import Catalog

_PAGE = ["page_id", "page_namespace", "page_title"]


def requested_titles(cat: Catalog, titles: DataFrame | Collection[str]) -> DataFrame:
    """Requests as ``(page_namespace, page_title)``, normalised and without repeats."""
    if not isinstance(titles, DataFrame):
        titles = cat.spark.createDataFrame([(t,) for t in titles], "title string")
    parsed = parse_titles(titles.select("title"), "title", cat["interwiki"], cat["namespace_name"])
    local = parsed.where("title_error is null and iwprefix = ''")
    return local.select(
        F.col("ns_id").alias("page_namespace"), F.col("pagename").alias("page_title")
    ).distinct()


def by_titles(cat: Catalog, titles: DataFrame | Collection[str]) -> DataFrame:
    requests = requested_titles(cat, titles)
    df = cat["page"].select(*_PAGE).join(requests, ["page_namespace", "page_title"], "left_semi")
    return df.select(*_PAGE)


def missing_titles(cat: Catalog, titles: DataFrame | Collection[str]) -> DataFrame:
    df = requested_titles(cat, titles).join(cat["page"], ["page_namespace", "page_title"], "left_anti")
    return df.select("page_namespace", "page_title", F.lit("").alias("missing"))


def requested_ids(cat: Catalog, ids: DataFrame | Collection[int]) -> DataFrame:
    if not isinstance(ids, DataFrame):
        ids = cat.spark.createDataFrame([(i,) for i in ids], "page_id long")
    return ids.select("page_id").distinct()


def by_ids(cat: Catalog, ids: DataFrame | Collection[int]) -> DataFrame:
    return cat["page"].select(*_PAGE).join(requested_ids(cat, ids), "page_id", "left_semi")


def missing_ids(cat: Catalog, ids: DataFrame | Collection[int]) -> DataFrame:
    df = requested_ids(cat, ids).join(cat["page"], "page_id", "left_anti")
    return df.select("page_id", F.lit("").alias("missing"))


def by_list(cat: Catalog, name: str, **options) -> DataFrame:
    """Pages named by a list query; each page once, whatever the list repeats."""
    c.check_choice("generator", name, GENERATORS)
    build, ns, title = GENERATORS[name]
    keys = build(cat, **options).select(F.col(ns).alias("page_namespace"), F.col(title).alias("page_title"))
    df = cat["page"].select(*_PAGE).join(keys, ["page_namespace", "page_title"], "left_semi")
    return df.select(*_PAGE)


def _with_title(build):
    return lambda cat, **options: build(cat, **{"prop": {"title"}, **options})


GENERATORS = {
    "allpages": (lists.all_pages, "page_namespace", "page_title"),
    "recentchanges": (_with_title(lists.recent_changes), "rc_namespace", "rc_title"),
    "logevents": (_with_title(lists.log_events), "log_namespace", "log_title"),
    "protectedtitles": (lists.protected_titles, "pt_namespace", "pt_title"),
    "allrevisions": (lists.all_revisions, "page_namespace", "page_title"),
    "alldeletedrevisions": (lists.all_deleted_revisions, "ar_namespace", "ar_title"),
}


def attach(pages: DataFrame, parts: dict[str, DataFrame]) -> DataFrame:
    """One row per page, property and entry: the columns of ``pages``, ``property`` and a struct per property.

    Only the struct named by ``property`` is filled. A page without entries has one
    row, with no property. Rows stay flat, so a crowded page is just many rows, and
    properties do not multiply each other; one join with the pages.
    """
    entries = None
    for name, df in parts.items():
        fields = [x for x in df.columns if x != "page_id"]
        part = df.select("page_id", F.lit(name).alias("property"), F.struct(*fields).alias(name))
        entries = part if entries is None else entries.unionByName(part, allowMissingColumns=True)
    return pages if entries is None else pages.join(entries, "page_id", "left")


def query_pages(
    cat: Catalog, pages: DataFrame, prop: Collection[str], options: dict[str, dict] | None = None
) -> DataFrame:
    """Attach the named properties; ``options`` has keyword arguments per property."""
    c.check_subset("prop", prop, PROPERTIES)
    options = options or {}
    parts = {}
    for name in sorted(prop):
        rows = entries(cat, name, pages, **options.get(name, {}))
        if name == "pageprops":
            rows = rows.where("pageprops is not null").select("page_id", F.explode("pageprops"))
        parts[name] = rows
    return attach(pages, parts)


def merge_partials(df: DataFrame, key: str, seq: str, scalars: list[str]) -> DataFrame:
    """Partial results of the same entity merged: later scalars overwrite, NULL leaves as is."""
    merged = [F.max_by(x, F.when(F.col(x).isNotNull(), F.col(seq))).alias(x) for x in scalars]
    return df.groupBy(key).agg(*merged)


def merged_items(df: DataFrame, key: str, seq: str, items: str, name: str = "item") -> DataFrame:
    """List parts of partial results appended in order: one row per item with its ``place``.

    Rows instead of one array per entity, so a huge list is never collected.
    """
    return df.select(key, seq, F.posexplode(items).alias("place", name))


def full_titles(cat: Catalog, pages: DataFrame) -> DataFrame:
    df = c.with_namespace(pages, cat, "page_namespace")
    return df.withColumn("full_title", prefixed(F.col("nss_name"), F.col("page_title"))).drop("nss_name")
