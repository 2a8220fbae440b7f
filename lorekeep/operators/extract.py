"""Derive link tables from page text.

Input pages have ``page_id, page_namespace, page_title, body``. Each page is read
once, next to the scan, and only the small prefix tables are joined. Titles in the
results are parsed and canonical.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.functions import markup as M
from lorekeep.functions import text as W
from lorekeep.functions.encodings import dot_encode, unescape_each
from lorekeep.functions.langs import LANGUAGE_TAGS
from lorekeep.functions.titles import absolute_link, canonical_title, computed_once, parse_titles, prefixed
from lorekeep.functions.urls import has_host
from lorekeep.operators.activity import keep_last
from lorekeep.operators.changes import CASCADES, upsert
from lorekeep.operators.closure import Generations, reachable
from lorekeep.sources.catalog import Catalog

# ---- which pages --------------------------------------------------------------------------


_IS_STALE = "wspc_rev_id is null or wspc_rev_id <> page_latest"


def _with_extracted(cat: Catalog) -> DataFrame:
    return cat["page"].join(cat["ws_parser_cache_sync"], F.col("page_id") == F.col("wspc_page_id"), "left")


def stale_pages(cat: Catalog) -> DataFrame:
    """Pages never extracted, or extracted from another than the current revision."""
    return _with_extracted(cat).where(_IS_STALE).select("page_id", "page_namespace", "page_title")


def pages_to_extract(cat: Catalog) -> DataFrame:
    """Stale pages and the pages that transclude one of them (``page_id``).

    One pass over the pages by id: both reasons are marks beside them.
    """
    on = (F.col("tl_namespace") == F.col("page_namespace")) & (F.col("tl_title") == F.col("page_title"))
    users = cat["templatelinks"].join(stale_pages(cat), on, "left_semi").select(F.col("tl_from").alias("_user"))
    users = users.distinct()
    pages = _with_extracted(cat).join(users, F.col("page_id") == F.col("_user"), "left")
    return pages.where(f"{_IS_STALE} or _user is not null").select("page_id").distinct()


def forced_pages(cat: Catalog, page_ids: DataFrame | None = None) -> DataFrame:
    """All pages, or the selected ones, regardless of their state."""
    page = cat["page"].select("page_id")
    return page if page_ids is None else page.join(page_ids.select("page_id"), "page_id", "left_semi")


def drop_derived(cat: Catalog, page_ids: DataFrame) -> dict[str, DataFrame]:
    """The derived tables without the rows of the pages that will be extracted again."""
    gone = page_ids.select(F.col("page_id").alias("_gone"))
    derived = [t for t in CASCADES if t not in ("page_props", "page_restrictions", "ws_parser_cache_sync")]
    return {t: cat[t].join(gone, F.col(CASCADES[t]) == F.col("_gone"), "left_anti") for t in derived}


def record_extracted(cat: Catalog, page_ids: DataFrame) -> DataFrame:
    """Note the revision each page was extracted from.

    The ids are written once: the joins that find them and the join that records them would otherwise
    lie in the same tasks, all by page, and hold their sorted rows together.
    """
    page_ids = Generations(cat.spark).append(page_ids.select("page_id"))
    current = cat["page"].join(page_ids, "page_id", "left_semi").select(
        F.col("page_id").alias("wspc_page_id"), F.col("page_latest").alias("wspc_rev_id")
    )
    return upsert(cat["ws_parser_cache_sync"], current, ["wspc_page_id"])


# ---- wikilinks ----------------------------------------------------------------------------


def wikilinks(cat: Catalog, pages: DataFrame) -> DataFrame:
    """Every wikilink of every page, parsed, made absolute and classified.

    ``kind`` is interwiki, language, image, category, page or skip. Invalid titles
    are left out. The first link of a redirect page is its target and never special.
    """
    found = pages.select(
        "page_id", "page_namespace", "page_title", W.is_redirect(F.col("body")).alias("is_redirect"),
        F.posexplode(M.wikilinks(F.col("body"))).alias("position", "link"),
    )
    found = found.select(
        "page_id", "page_namespace", "page_title", "is_redirect", "position",
        F.col("link.target").alias("raw"), F.col("link.label").alias("label"),
    )
    parsed = parse_titles(found, "raw", cat["interwiki"], cat["namespace_name"]).where("title_error is null")
    return classify_links(cat, parsed)


def classify_links(cat: Catalog, parsed: DataFrame) -> DataFrame:
    base = cat["namespace_starname"].select(
        F.col("nss_id").alias("page_namespace"), F.col("nss_name").alias("_base_ns")
    )
    df = parsed.join(base, "page_namespace", "left").withColumn("_own_name", F.col("pagename"))
    target = absolute_link(
        F.col("iwprefix"), F.col("namespace"), F.col("pagename"), F.col("leading_colon"),
        F.coalesce("_base_ns", F.lit("")), F.col("page_title"),
    )
    local = F.col("iwprefix") == ""
    relative = local & (F.col("namespace") == "") & (
        (F.col("pagename") == "") | (~F.col("leading_colon") & F.col("pagename").rlike(r"^(/|\.\./)"))
    )
    df = computed_once(df, _relative=relative, _target=target)
    df = df.withColumn("ns_id", F.when(F.col("_relative"), F.col("page_namespace")).otherwise(F.col("ns_id")))
    df = df.withColumn("namespace", F.col("_target.namespace")).withColumn("pagename", F.col("_target.pagename"))
    special = ~(F.col("is_redirect") & (F.col("position") == 0))
    plain = ~F.col("leading_colon")
    same = (F.col("ns_id") == F.col("page_namespace")) & (F.col("pagename") == F.col("page_title"))
    tracked = ~same | ((F.col("_own_name") != "") & (F.col("sectionname") != ""))
    in_article = (F.col("page_namespace") >= 0) & (F.col("page_namespace") % 2 == 0)
    kind = (
        F.when(
            ~local,
            F.when(plain & special & F.col("iwprefix").isin(LANGUAGE_TAGS) & in_article, F.lit("language"))
            .otherwise(F.lit("interwiki")),
        )
        .when(special & ((F.col("ns_id") == -2) | ((F.col("ns_id") == 6) & plain)), F.lit("image"))
        .when(special & (F.col("ns_id") == 14) & plain, F.lit("category"))
        .when(tracked & ((F.col("ns_id") >= 0) | (F.col("ns_id") == -2)), F.lit("page"))
        .otherwise(F.lit("skip"))
    )
    return df.withColumn("kind", kind).drop("_base_ns", "_own_name", "_relative", "_target")


def link_tables(links: DataFrame) -> dict[str, DataFrame]:
    """Rows of the five link tables; on equal keys the last link of the page wins."""
    of = lambda kind: links.where(F.col("kind") == kind)
    full = prefixed(F.col("namespace"), F.col("pagename"))
    categories = keep_last(
        of("category").select(
            F.col("page_id").alias("cl_from"), F.col("pagename").alias("cl_to"), "position",
            W.category_sort_key(F.col("page_title"), F.col("label")).alias("cl_sortkey"),
            F.coalesce("label", F.lit("")).alias("cl_sortkey_prefix"), F.lit("uppercase").alias("cl_collation"),
            W.category_member_type(F.col("page_namespace")).alias("cl_type"),
        ), ["cl_from", "cl_to"], "position",
    ).drop("position")
    languages = keep_last(
        of("language").select(
            F.col("page_id").alias("ll_from"), F.col("iwprefix").alias("ll_lang"), full.alias("ll_title"), "position"
        ), ["ll_from", "ll_lang"], "position",
    ).drop("position")
    target_ns = F.when(F.col("ns_id") == -2, F.lit(6)).otherwise(F.col("ns_id"))
    return {
        "pagelinks": of("page").select(
            F.col("page_id").alias("pl_from"), target_ns.alias("pl_namespace"), F.col("pagename").alias("pl_title")
        ).distinct(),
        "imagelinks": of("image").select(F.col("page_id").alias("il_from"), F.col("pagename").alias("il_to")).distinct(),
        "categorylinks": categories,
        "langlinks": languages,
        "iwlinks": of("interwiki").select(
            F.col("page_id").alias("iwl_from"), F.col("iwprefix").alias("iwl_prefix"), full.alias("iwl_title")
        ).distinct(),
    }


# ---- other tables -------------------------------------------------------------------------


def external_links(pages: DataFrame) -> DataFrame:
    """External links with a host."""
    urls = pages.select(F.col("page_id").alias("el_from"), F.explode(M.external_urls(F.col("body"))).alias("el_to"))
    return urls.where(has_host(F.col("el_to"))).distinct()


def sections(pages: DataFrame) -> DataFrame:
    """Headings with number, level, title and unique anchor."""
    heads = pages.select("page_id", M.headings(F.col("body")).alias("head"))
    plain = unescape_each(F.transform("head", lambda h: W.plain_text(h["shown"])))
    heads = heads.withColumn("plain", plain)
    anchors = M.unique_anchors(F.transform("plain", lambda x: dot_encode(x)))
    # exploding the headings, not the anchors, keeps the Python step out of inferred filters
    rows = heads.withColumn("anchors", anchors).select(
        F.col("page_id").alias("sec_page"), "anchors", F.posexplode("head").alias("place", "h")
    )
    number = F.col("place") + 1
    return rows.select(
        "sec_page", number.alias("sec_number"), F.col("h.level").alias("sec_level"), F.col("h.title").alias("sec_title"),
        F.element_at("anchors", number).alias("sec_anchor"),
    )


def redirects(cat: Catalog, pages: DataFrame) -> DataFrame:
    """Redirect rows; a target on another wiki has no namespace number."""
    found = pages.select("page_id", W.redirect_target(F.col("body")).alias("raw")).where("raw is not null")
    parsed = parse_titles(found, "raw", cat["interwiki"], cat["namespace_name"]).where("title_error is null")
    local = F.col("iwprefix") == ""
    title = F.when(local, F.col("pagename")).otherwise(prefixed(F.col("namespace"), F.col("pagename")))
    return parsed.select(
        F.col("page_id").alias("rd_from"), F.when(local, F.col("ns_id")).alias("rd_namespace"), title.alias("rd_title"),
        F.nullif(F.col("iwprefix"), F.lit("")).alias("rd_interwiki"),
        F.nullif(F.col("sectionname"), F.lit("")).alias("rd_fragment"),
    )


# fixed values: magic words that are no transclusions
MAGIC_VARIABLES = [
    "CURRENTYEAR", "CURRENTMONTH", "CURRENTMONTH1", "CURRENTMONTHNAME", "CURRENTMONTHNAMEGEN", "CURRENTMONTHABBREV",
    "CURRENTDAY", "CURRENTDAY2", "CURRENTDOW", "CURRENTDAYNAME", "CURRENTTIME", "CURRENTHOUR", "CURRENTWEEK",
    "CURRENTTIMESTAMP", "LOCALYEAR", "LOCALMONTH", "LOCALMONTH1", "LOCALMONTHNAME", "LOCALMONTHNAMEGEN",
    "LOCALMONTHABBREV", "LOCALDAY", "LOCALDAY2", "LOCALDOW", "LOCALDAYNAME", "LOCALTIME", "LOCALHOUR", "LOCALWEEK",
    "LOCALTIMESTAMP", "SITENAME", "SERVER", "SERVERNAME", "DIRMARK", "DIRECTIONMARK", "SCRIPTPATH", "STYLEPATH",
    "CURRENTVERSION", "CONTENTLANGUAGE", "CONTENTLANG", "PAGEID", "PAGELANGUAGE", "CASCADINGSOURCES", "REVISIONSIZE",
    "NUMBEROFPAGES", "NUMBEROFARTICLES", "NUMBEROFFILES", "NUMBEROFEDITS", "NUMBEROFVIEWS", "NUMBEROFUSERS",
    "NUMBEROFADMINS", "NUMBEROFACTIVEUSERS", "!", "=", "REVISIONID", "REVISIONDAY", "REVISIONDAY2", "REVISIONMONTH",
    "REVISIONMONTH1", "REVISIONYEAR", "REVISIONTIMESTAMP", "REVISIONUSER", "FULLPAGENAME", "PAGENAME", "BASEPAGENAME",
    "SUBPAGENAME", "SUBJECTPAGENAME", "ARTICLEPAGENAME", "TALKPAGENAME", "ROOTPAGENAME", "FULLPAGENAMEE", "PAGENAMEE",
    "BASEPAGENAMEE", "SUBPAGENAMEE", "SUBJECTPAGENAMEE", "ARTICLEPAGENAMEE", "TALKPAGENAMEE", "ROOTPAGENAMEE",
    "NAMESPACENUMBER", "NAMESPACE", "SUBJECTSPACE", "ARTICLESPACE", "TALKSPACE", "NAMESPACEE", "SUBJECTSPACEE",
    "ARTICLESPACEE", "TALKSPACEE",
]
# fixed values: magic words that take an argument after a colon
MAGIC_PREFIXES = [
    "PROTECTIONLEVEL", "PROTECTIONEXPIRY", "DISPLAYTITLE", "DEFAULTSORT", "DEFAULTSORTKEY", "DEFAULTCATEGORYSORT",
    "PAGESINCATEGORY", "PAGESINCAT", "NUMBERINGROUP", "NUMINGROUP", "PAGESINNS", "PAGESINNAMESPACE", "PAGEID",
    "PAGESIZE", "CASCADINGSOURCES", "REVISIONID", "REVISIONDAY", "REVISIONDAY2", "REVISIONMONTH", "REVISIONMONTH1",
    "REVISIONYEAR", "REVISIONTIMESTAMP", "REVISIONUSER", "FULLPAGENAME", "PAGENAME", "BASEPAGENAME", "SUBPAGENAME",
    "SUBJECTPAGENAME", "ARTICLEPAGENAME", "TALKPAGENAME", "ROOTPAGENAME", "FULLPAGENAMEE", "PAGENAMEE",
    "BASEPAGENAMEE", "SUBPAGENAMEE", "SUBJECTPAGENAMEE", "ARTICLEPAGENAMEE", "TALKPAGENAMEE", "ROOTPAGENAMEE",
    "NAMESPACENUMBER", "NAMESPACE", "SUBJECTSPACE", "ARTICLESPACE", "TALKSPACE", "NAMESPACEE", "SUBJECTSPACEE",
    "ARTICLESPACEE", "TALKSPACEE",
]
# fixed values: parser functions
PARSER_FUNCTIONS = [
    "localurl", "fullurl", "canonicalurl", "filepath", "urlencode", "anchorencode", "ns", "nse", "formatnum",
    "#dateformat", "#formatdate", "lc", "lcfirst", "uc", "ucfirst", "padleft", "padright", "plural", "grammar",
    "gender", "int", "#language", "#special", "#tag",
]
# fixed values: modifiers in front of a transcluded title
TRANSCLUSION_MODIFIERS = ["msgnw", "subst", "safesubst"]


def is_magic_word(name: Column) -> Column:
    """Variables, parser functions and anything that starts with ``#``."""
    prefix = F.substring_index(name, ":", 1)
    called = F.contains(name, F.lit(":")) & (
        prefix.isin(MAGIC_PREFIXES) | F.lower(prefix).isin(PARSER_FUNCTIONS)
    )
    return name.isin(MAGIC_VARIABLES) | called | F.startswith(name, F.lit("#"))


def transclusions(cat: Catalog, pages: DataFrame) -> DataFrame:
    """Direct transclusions. Names without a namespace belong to Template; ``{{:x}}`` is a page."""
    names = pages.select(
        "page_id", "page_namespace", "page_title",
        F.explode(M.transclusions(M.viewed_part(F.col("body")))).alias("raw"),
    )
    modified = F.lower(F.substring_index("raw", ":", 1)).isin(TRANSCLUSION_MODIFIERS) & F.contains("raw", F.lit(":"))
    bare = F.trim(F.when(modified, F.regexp_replace("raw", "^[^:]*:", "")).otherwise(F.col("raw")))
    names = names.withColumn("raw", bare).where((F.col("raw") != "") & ~is_magic_word(F.col("raw")))
    parsed = parse_titles(names, "raw", cat["interwiki"], cat["namespace_name"])
    parsed = parsed.where("title_error is null and iwprefix = '' and ns_id >= 0")
    subpage = F.startswith("raw", F.lit("/"))
    ns = (
        F.when(subpage, F.col("page_namespace"))
        .when((F.col("ns_id") == 0) & ~F.col("leading_colon"), F.lit(10)).otherwise(F.col("ns_id"))
    )
    title = F.when(subpage, F.concat("page_title", F.regexp_replace("raw", "/+$", ""))).otherwise(F.col("pagename"))
    return parsed.select(
        F.col("page_id").alias("tl_from"), ns.alias("tl_namespace"), canonical_title(title).alias("tl_title")
    ).distinct()


def transclusion_closure(direct: DataFrame, page: DataFrame) -> DataFrame:
    """Direct and indirect transclusions of each page, loops included only once."""
    titles = page.select(
        F.col("page_id").alias("via"), F.col("page_namespace").alias("tl_namespace"), F.col("page_title").alias("tl_title")
    )
    steps = direct.join(titles, ["tl_namespace", "tl_title"], "left")
    return reachable(steps, "tl_from", ["tl_namespace", "tl_title"], "via").drop("via")
