"""Page properties: for a page set, one row per page and entry.

``pages`` needs ``page_id``; reverse properties (who links *here*) also need
``page_namespace`` and ``page_title``. Pages without entries have no rows. The
rows stay flat, so a page with very many entries is just many rows.
"""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.functions.langs import html_code, text_direction
from lorekeep.operators import common as c
from lorekeep.operators.common import Time
from lorekeep.operators.graph import place_in_group
from lorekeep.operators.lists import filter_revisions, revision_columns, with_content
from lorekeep.sources.catalog import Catalog


def _ids(pages: DataFrame) -> DataFrame:
    return pages.select("page_id")


def _keys(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", "page_namespace", "page_title")


def info(cat: Catalog, pages: DataFrame, *, display_title: bool = False) -> DataFrame:
    """Basic facts, language code and direction, and the display title on request."""
    facts = cat["page"].select(
        "page_id", "page_is_redirect", "page_is_new", "page_touched", "page_len", "page_latest",
        "page_content_model", "page_lang",
    )
    df = _keys(pages).join(facts, "page_id")
    out = [
        "page_id", c.mark(F.col("page_is_redirect")).alias("redirect"), c.mark(F.col("page_is_new")).alias("new"),
        F.col("page_touched").alias("touched"), F.col("page_len").alias("length"),
        F.col("page_latest").alias("lastrevid"), F.col("page_content_model").alias("contentmodel"),
        F.col("page_lang").alias("pagelanguage"), html_code(F.col("page_lang")).alias("pagelanguagehtmlcode"),
        text_direction(F.col("page_lang")).alias("pagelanguagedir"),
    ]
    if display_title:
        # filter the right side first: a page without this property must be kept
        shown = cat["page_props"].where("pp_propname = 'displaytitle'").select(
            F.col("pp_page").alias("page_id"), "pp_value"
        )
        df = c.with_namespace(df.join(shown, "page_id", "left"), cat, "page_namespace")
        full = c.prefixed(F.col("nss_name"), F.col("page_title"))
        out.append(F.coalesce(F.nullif(F.col("pp_value"), F.lit("")), full).alias("displaytitle"))
    return df.select(*out)


# fixed values: actions a page can be protected against
RESTRICTION_TYPES = ["edit", "move"]


def protection(cat: Catalog, pages: DataFrame) -> DataFrame:
    """Protections per page; a missing expiry reads ``indefinite``."""
    df = cat["page_restrictions"].join(_ids(pages), F.col("pr_page") == F.col("page_id"))
    expiry = F.when(c.is_indefinite(F.col("pr_expiry")) & F.col("pr_expiry").isNull(), F.lit("indefinite")).when(
        c.is_indefinite(F.col("pr_expiry")), F.lit("infinity")
    ).otherwise(F.col("pr_expiry").cast("string"))
    return df.select(
        "page_id", F.col("pr_type").alias("type"), F.col("pr_level").alias("level"),
        c.mark(F.col("pr_cascade")).alias("cascade"), expiry.alias("expiry"),
    )


def page_props(cat: Catalog, pages: DataFrame, *, names: Collection[str] | None = None) -> DataFrame:
    """Property maps. Names are filtered before the outer join, so every page stays."""
    props = cat["page_props"]
    if names is not None:
        props = props.where(F.col("pp_propname").isin(c.as_set(set(names))))
    # a page has each property once, so the map is as small as the list of names
    maps = props.groupBy(F.col("pp_page").alias("page_id")).agg(
        F.map_from_entries(F.collect_list(F.struct("pp_propname", "pp_value"))).alias("pageprops")
    )
    return _ids(pages).join(maps, "page_id", "left")


def _first_revisions(df: DataFrame, prefix: str, direction: str, limit: int | None) -> DataFrame:
    """The first ``limit`` by page and time, before anything is joined to them."""
    if limit is None:
        return df
    time = [F.col(prefix + "timestamp"), F.col("ar_rev_id" if prefix == "ar_" else "rev_id")]
    return df.orderBy("page_id", *[x.asc() if direction == "newer" else x.desc() for x in time]).limit(limit)


def revisions(
    cat: Catalog, pages: DataFrame, *, latest: bool = False, start: Time | None = None, end: Time | None = None,
    direction: str = "older", user: str | None = None, exclude_user: str | None = None,
    prop: Collection[str] = ("ids", "timestamp", "flags", "comment", "user"), limit: int | None = None,
) -> DataFrame:
    """Revisions of the pages, or only the current one (``latest``). Hidden bits are selected."""
    columns = revision_columns(prop)
    df = filter_revisions(cat["revision"], "rev_", direction, start, end, user, exclude_user)
    if latest:
        # the id set carries page_latest, so one revision per page survives the join
        current = cat["page"].select("page_id", "page_latest").join(_ids(pages), "page_id", "left_semi")
        df = df.join(current, (F.col("rev_page") == F.col("page_id")) & (F.col("rev_id") == F.col("page_latest")))
    else:
        df = df.join(_ids(pages), F.col("rev_page") == F.col("page_id"))
    df = _first_revisions(df, "rev_", direction, limit)
    if "content" in prop:
        df = with_content(df, cat, "rev_text_id")
        columns.append("old_text")
    if "tags" in prop:
        df = c.with_tags(df, cat, "tagged_revision", "rev_id")
        columns.append("tag_names")
    return df.select("page_id", *columns)


def deleted_revisions(
    cat: Catalog, pages: DataFrame, *, start: Time | None = None, end: Time | None = None,
    direction: str = "older", user: str | None = None, exclude_user: str | None = None, tag: str | None = None,
    prop: Collection[str] = ("ids", "timestamp", "flags", "comment", "user"), limit: int | None = None,
) -> DataFrame:
    """Deleted revisions under the title of each page."""
    columns = revision_columns(prop, "ar_")
    df = filter_revisions(cat["archive"], "ar_", direction, start, end, user, exclude_user)
    if tag is not None:
        df = c.tagged_with(df, cat, "tagged_archived_revision", "ar_rev_id", tag)
    df = df.join(
        _keys(pages), (F.col("ar_namespace") == F.col("page_namespace")) & (F.col("ar_title") == F.col("page_title"))
    )
    df = _first_revisions(df, "ar_", direction, limit)
    if "content" in prop:
        df = with_content(df, cat, "ar_text_id")
        columns.append("old_text")
    if "tags" in prop:
        df = c.with_tags(df, cat, "tagged_archived_revision", "ar_rev_id")
        columns.append("tag_names")
    return df.select("page_id", *columns)


def _targets(cat: Catalog, df: DataFrame, ns: str, title: str) -> DataFrame:
    df = c.with_namespace(df, cat, ns)
    return df.select(
        "page_id", F.col(ns).alias("ns"), c.prefixed(F.col("nss_name"), F.col(title)).alias("title")
    )


def _forward(
    cat: Catalog, pages: DataFrame, table: str, prefix: str, namespace, titles: Collection[tuple[int, str]] | None
) -> DataFrame:
    df = cat[table]
    ns, title = prefix + "namespace", prefix + "title"
    if namespace is not None:
        df = df.where(F.col(ns).isin(c.as_set(namespace)))
    if titles is not None:
        wanted = cat.spark.createDataFrame(sorted(titles), "want_ns int, want_title string")
        df = df.join(
            wanted, (F.col(ns) == F.col("want_ns")) & (F.col(title) == F.col("want_title")), "left_semi"
        )
    return _targets(cat, df.join(_ids(pages), F.col(prefix + "from") == F.col("page_id")), ns, title)


def templates(cat: Catalog, pages: DataFrame, *, namespace=None, titles=None) -> DataFrame:
    """Pages transcluded by each page; ``titles`` is a set of (namespace, title)."""
    return _forward(cat, pages, "templatelinks", "tl_", namespace, titles)


def links(cat: Catalog, pages: DataFrame, *, namespace=None, titles=None) -> DataFrame:
    """Pages linked by each page; ``titles`` is a set of (namespace, title)."""
    return _forward(cat, pages, "pagelinks", "pl_", namespace, titles)


def _fixed_namespace(cat: Catalog, pages: DataFrame, table: str, source: str, target: str, ns: int) -> DataFrame:
    df = cat[table].join(_ids(pages), F.col(source) == F.col("page_id"))
    # one name for all rows, so it is looked up and not joined
    name = cat["namespace_starname"].where(F.col("nss_id") == ns).agg(F.max("nss_name")).scalar()
    return df.select("page_id", F.lit(ns).alias("ns"), c.prefixed(name, F.col(target)).alias("title"))


def images(cat: Catalog, pages: DataFrame) -> DataFrame:
    return _fixed_namespace(cat, pages, "imagelinks", "il_from", "il_to", 6)


def categories(cat: Catalog, pages: DataFrame) -> DataFrame:
    return _fixed_namespace(cat, pages, "categorylinks", "cl_from", "cl_to", 14)


def _reverse(
    cat: Catalog, pages: DataFrame, edges: DataFrame, prefix: str, prop: Collection[str], namespace,
    keep: list[str],
) -> DataFrame:
    """Edges that end at the pages, with the page each edge starts at."""
    source = cat["page"].select(
        F.col("page_id").alias("src_pageid"), F.col("page_namespace").alias("src_namespace"),
        F.col("page_title").alias("src_title"), F.col("page_is_redirect").alias("src_is_redirect"),
    )
    if namespace is not None:
        source = source.where(F.col("src_namespace").isin(c.as_set(namespace)))
    df = edges.join(
        _keys(pages),
        (F.col(prefix + "namespace") == F.col("page_namespace")) & (F.col(prefix + "title") == F.col("page_title")),
    ).join(source, F.col(prefix + "from") == F.col("src_pageid"))
    out = ["page_id"]
    if "pageid" in prop:
        out.append(F.col("src_pageid").alias("pageid"))
    if "title" in prop:
        df = c.with_namespace(df, cat, "src_namespace")
        out += [F.col("src_namespace").alias("ns"),
                c.prefixed(F.col("nss_name"), F.col("src_title")).alias("title")]
    if "redirect" in prop:
        out.append(c.mark(F.col("src_is_redirect")).alias("redirect"))
    return df.select(*out, *keep, "src_is_redirect")


def _shown(df: DataFrame, show) -> DataFrame:
    names = c.as_set(show) if show is not None else []
    return c.flag_filter(df, names, {"redirect": F.col("src_is_redirect")}).drop("src_is_redirect")


def transcluded_in(
    cat: Catalog, pages: DataFrame, *, prop: Collection[str] = ("pageid", "title", "redirect"),
    namespace=None, show=None,
) -> DataFrame:
    """Pages that transclude each page; ``show`` is ``redirect`` or ``!redirect``."""
    c.check_subset("prop", prop, {"pageid", "title", "redirect"})
    return _shown(_reverse(cat, pages, cat["templatelinks"], "tl_", prop, namespace, []), show)


def links_here(
    cat: Catalog, pages: DataFrame, *, prop: Collection[str] = ("pageid", "title", "redirect"),
    namespace=None, show=None,
) -> DataFrame:
    """Pages that link to each page."""
    c.check_subset("prop", prop, {"pageid", "title", "redirect"})
    return _shown(_reverse(cat, pages, cat["pagelinks"], "pl_", prop, namespace, []), show)


def redirects(
    cat: Catalog, pages: DataFrame, *, prop: Collection[str] = ("pageid", "title"), namespace=None, show=None
) -> DataFrame:
    """Pages that redirect to each page; ``show`` is ``fragment`` or ``!fragment``."""
    c.check_subset("prop", prop, {"pageid", "title", "fragment"})
    names = c.as_set(show) if show is not None else []
    edges = c.flag_filter(cat["redirect"], names, {"fragment": F.col("rd_fragment").isNotNull()})
    df = _reverse(cat, pages, edges, "rd_", prop, namespace, ["rd_fragment"]).drop("src_is_redirect")
    if "fragment" not in prop:
        return df.drop("rd_fragment")
    return df.withColumnRenamed("rd_fragment", "fragment")


def language_links(cat: Catalog, pages: DataFrame, *, lang=None, title=None) -> DataFrame:
    df = cat["langlinks"]
    if lang is not None:
        df = df.where(F.col("ll_lang").isin(c.as_set(lang)))
    if title is not None:
        df = df.where(F.col("ll_title").isin(c.as_set(title)))
    return df.join(_ids(pages), F.col("ll_from") == F.col("page_id")).select(
        "page_id", F.col("ll_lang").alias("lang"), F.col("ll_title").alias("title")
    )


def interwiki_links(cat: Catalog, pages: DataFrame, *, prefix=None, title=None) -> DataFrame:
    df = cat["iwlinks"]
    if prefix is not None:
        df = df.where(F.col("iwl_prefix").isin(c.as_set(prefix)))
    if title is not None:
        df = df.where(F.col("iwl_title").isin(c.as_set(title)))
    return df.join(_ids(pages), F.col("iwl_from") == F.col("page_id")).select(
        "page_id", F.col("iwl_prefix").alias("prefix"), F.col("iwl_title").alias("title")
    )


def external_links(
    cat: Catalog, pages: DataFrame, *, protocol: str | None = None, query: str | None = None
) -> DataFrame:
    """External links. ``protocol`` and ``query`` match literally; a query alone means http."""
    df = cat["externallinks"]
    if protocol is not None or query is not None:
        head = (protocol or "http") + "://"
        df = df.where(F.startswith("el_to", F.lit(head)))
        if query:
            df = df.where(F.contains(F.substr("el_to", F.lit(len(head) + 1)), F.lit(query)))
    return df.join(_ids(pages), F.col("el_from") == F.col("page_id")).select("page_id", F.col("el_to").alias("url"))


def sections(cat: Catalog, pages: DataFrame) -> DataFrame:
    return cat["section"].join(_ids(pages), F.col("sec_page") == F.col("page_id")).select(
        "page_id", F.col("sec_number").alias("number"), F.col("sec_level").alias("level"),
        F.col("sec_title").alias("title"), F.col("sec_anchor").alias("anchor"),
    )


def latest_revisions(cat: Catalog, pages: DataFrame, **options) -> DataFrame:
    return revisions(cat, pages, latest=True, **options)


def arranged(df: DataFrame, order: Collection[str], direction: str | None, limit: int | None) -> DataFrame:
    """The first ``limit`` entries by page and ``order``, and, with a ``direction``, each entry's ``place`` on its page."""
    if direction not in (None, "ascending", "descending"):
        raise ValueError(f"direction must be ascending or descending, not {direction!r}")
    if limit is not None and limit < 1:
        raise ValueError("limit must be at least 1")
    keys = [F.col(x).desc() if direction == "descending" else F.col(x).asc() for x in order if x in df.columns]
    if limit is not None:
        df = df.orderBy("page_id", *keys).limit(limit)
    return df if direction is None else place_in_group(df, "page_id", keys)


# what the entries of a property are ordered by; sections and revisions have orders of their own
ENTRY_ORDER = {
    "templates": ["ns", "title"], "links": ["ns", "title"], "images": ["title"], "categories": ["title"],
    "langlinks": ["lang", "title"], "iwlinks": ["prefix", "title"], "extlinks": ["url"], "sections": ["number"],
    "transcludedin": ["pageid", "ns", "title"], "linkshere": ["pageid", "ns", "title"], "redirects": ["pageid", "ns", "title"],
}


def entries(
    cat: Catalog, name: str, pages: DataFrame, *, entry_direction: str | None = None, entry_limit: int | None = None, **options
) -> DataFrame:
    """A property by name; its entries are put in order and cut if asked for."""
    df = PROPERTIES[name](cat, pages, **options)
    if entry_direction is None and entry_limit is None:
        return df
    return arranged(df, ENTRY_ORDER[name], entry_direction, entry_limit)


PROPERTIES = {
    "info": info, "protection": protection, "pageprops": page_props, "latestrevisions": latest_revisions,
    "revisions": revisions, "deletedrevisions": deleted_revisions, "templates": templates,
    "transcludedin": transcluded_in, "links": links, "linkshere": links_here, "images": images,
    "categories": categories, "langlinks": language_links, "iwlinks": interwiki_links,
    "extlinks": external_links, "redirects": redirects, "sections": sections,
}
