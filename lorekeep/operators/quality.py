"""Quality reports and worklists. Each returns rows to act on; nothing edits the wiki."""

from __future__ import annotations

from collections.abc import Callable, Collection

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.functions.encodings import dot_encode, url_decode
from lorekeep.functions.langs import (
    language_of_tag, localized_title, pure_title, tag_of_language, title_language,
)
from lorekeep.functions.text import count_capitalized, is_struck_through, word_count
from lorekeep.functions.titles import article_space, parse_titles, prefixed
from lorekeep.operators import common as c
from lorekeep.operators.closure import Generations
from lorekeep.operators.families import CONTENT_NAMESPACES
from lorekeep.sources.catalog import Catalog

CHECKS: dict[str, Callable[..., DataFrame]] = {}


def register_check(name: str, check: Callable[..., DataFrame]) -> None:
    """Add a report of one's own; it is then found by ``run_check``."""
    if name in CHECKS:
        raise ValueError(f"check {name} exists already")
    CHECKS[name] = check


def run_check(name: str, *arguments, **options) -> DataFrame:
    return CHECKS[name](*arguments, **options)


def _titles(cat: Catalog, df: DataFrame, ns: str, title: str, name: str) -> DataFrame:
    """Add the full title of a (namespace, title) pair as ``name``."""
    df = c.with_namespace(df, cat, ns, "_ns_name")
    return df.withColumn(name, prefixed(F.col("_ns_name"), F.col(title))).drop("_ns_name")


# ---- redirects and talk pages -------------------------------------------------------------


def broken_redirect_fragments(cat: Catalog, edges: DataFrame) -> DataFrame:
    """Redirects to a section that the target page does not have."""
    page = cat["page"].select("page_id", F.col("page_namespace").alias("dst_ns"), F.col("page_title").alias("dst_title"))
    anchored = edges.where("fragment is not null").join(page, ["dst_ns", "dst_title"])
    anchored = anchored.withColumn("anchor", dot_encode(F.col("fragment")))
    known = cat["section"].select(F.col("sec_page").alias("page_id"), F.col("sec_anchor").alias("anchor"))
    return anchored.join(known, ["page_id", "anchor"], "left_anti").select(
        "src_ns", "src_title", "dst_ns", "dst_title", "fragment"
    )


def wrong_capitalization(cat: Catalog, edges: DataFrame) -> DataFrame:
    """Sentence-case redirects to titles that differ only in case and are title case."""
    df = _titles(cat, _titles(cat, edges, "src_ns", "src_title", "source"), "dst_ns", "dst_title", "target")
    return df.where(
        (F.lower("source") == F.lower("target")) & (word_count(pure_title(F.col("source"))) > 1)
        & (count_capitalized(F.col("source")) < count_capitalized(F.col("target")))
    ).select("source", "target")


def leaving_content(edges: DataFrame, namespaces: Collection[int] = (0, 4, 12, 14)) -> DataFrame:
    """Redirects from content namespaces to other namespaces."""
    inside = sorted(namespaces)
    return edges.where(F.col("src_ns").isin(inside) & ~F.col("dst_ns").isin(inside))


def talk_without_article(cat: Catalog, namespaces: Collection[int] = (1, 5, 13)) -> DataFrame:
    page = cat["page"].select("page_id", "page_namespace", "page_title")
    talk = page.where(F.col("page_namespace").isin(sorted(namespaces)))
    articles = page.select((F.col("page_namespace") + 1).alias("page_namespace"), "page_title")
    return talk.join(articles, ["page_namespace", "page_title"], "left_anti").select(*page.columns)


def talk_of_redirects(cat: Catalog, namespaces: Collection[int] = (0, 4, 12)) -> DataFrame:
    """Talk pages, not redirects themselves, whose article is a redirect."""
    page = cat["page"].select("page_id", "page_namespace", "page_title", "page_is_redirect")
    moved = page.where(F.col("page_is_redirect") & F.col("page_namespace").isin(sorted(namespaces))).select(
        (F.col("page_namespace") + 1).alias("page_namespace"), "page_title"
    )
    talk = page.where("not page_is_redirect").select("page_id", "page_namespace", "page_title")
    return talk.join(moved, ["page_namespace", "page_title"], "left_semi").select(*talk.columns)


def mismatched_talk_redirects(
    cat: Catalog, edges: DataFrame, archive: str = "Project:Archive", exempt: dict[str, str] | None = None
) -> DataFrame:
    """Talk redirects that do not go where their article redirects to.

    ``exempt`` maps a talk target to the prefix of articles that may share it.
    """
    target = F.concat("dst_title", F.coalesce(F.concat(F.lit("#"), "fragment"), F.lit("")))
    talk = edges.where("src_ns > 0 and src_ns % 2 = 1").select(
        "src_ns", "src_title", "dst_ns", "dst_title", target.alias("target"),
        (F.col("src_ns") - 1).alias("article_ns"),
    )
    article = edges.select(
        F.col("src_ns").alias("article_ns"), F.col("src_title"), F.col("dst_ns").alias("to_ns"),
        F.col("dst_title").alias("to_title"), target.alias("to_target"),
    )
    df = talk.join(article, ["article_ns", "src_title"], "left")
    same = (F.col("to_ns") == F.col("dst_ns")) & (F.col("to_target") == F.col("target")) & (F.col("dst_ns") % 2 == 1)
    df = df.where(~F.coalesce(same, F.lit(False)))
    df = _titles(cat, df, "dst_ns", "dst_title", "talk_target")
    for shared, start in (exempt or {}).items():
        excused = F.startswith("src_title", F.lit(start)) | F.startswith(F.coalesce("to_title", F.lit("")), F.lit(start))
        df = df.where(~((F.col("talk_target") == shared) & excused))
    lone = F.col("to_title").isNull()
    wrong = (article_space(F.col("dst_ns")) != F.col("to_ns")) | (F.col("dst_title") != F.col("to_title"))
    df = df.where((lone & (F.col("talk_target") != archive)) | (~lone & wrong))
    problem = F.when(lone, F.lit("article is not a redirect")).otherwise(F.lit("article redirects elsewhere"))
    return df.select("src_ns", "src_title", "talk_target", problem.alias("problem"), "to_ns", "to_title")


def closed_discussions(cat: Catalog, namespaces: Collection[int] = (1, 5, 11, 13, 15)) -> DataFrame:
    """Talk pages with a struck-through section title."""
    closed = cat["section"].where(is_struck_through(F.col("sec_title"))).select(F.col("sec_page").alias("page_id"))
    page = cat["page"].where(F.col("page_namespace").isin(sorted(namespaces)))
    return page.join(closed, "page_id", "left_semi").select("page_id", "page_namespace", "page_title")


# ---- categories and languages -------------------------------------------------------------

# fixed values: namespaces whose pages do not belong into categories
UNCATEGORIZED_NAMESPACES = [1, 2, 3, 5, 7, 9, 11, 13, 15]


def wrong_language_categories(cat: Catalog) -> DataFrame:
    """Content pages in a category of another language, each page once."""
    page = cat["page"].where(~F.col("page_is_redirect") & F.col("page_namespace").isin(CONTENT_NAMESPACES))
    page = _titles(cat, page.select("page_id", "page_namespace", "page_title"), "page_namespace", "page_title", "title")
    page = page.withColumn("language", title_language(F.col("title")))
    links = cat["categorylinks"].select(F.col("cl_from").alias("page_id"), F.concat(F.lit("Category:"), "cl_to").alias("category"))
    root = (F.col("title") == F.concat(F.lit("Category:"), "language")) & (F.col("category") == "Category:Languages")
    wrong = page.join(links, "page_id").where(~root & (title_language(F.col("category")) != F.col("language")))
    return wrong.select("page_id", "title", "language").distinct()


def categorized_talk(cat: Catalog) -> DataFrame:
    page = cat["page"].where(~F.col("page_is_redirect") & F.col("page_namespace").isin(UNCATEGORIZED_NAMESPACES))
    links = cat["categorylinks"].select(F.col("cl_from").alias("page_id"))
    return page.join(links, "page_id", "left_semi").select("page_id", "page_namespace", "page_title")


def language_mismatches(cat: Catalog) -> DataFrame:
    """Content pages whose page language is not that of their title."""
    page = cat["page"].where(F.col("page_namespace").isin(CONTENT_NAMESPACES))
    page = _titles(cat, page.select("page_id", "page_namespace", "page_title", "page_lang"), "page_namespace", "page_title", "title")
    return page.withColumn("title_lang", tag_of_language(title_language(F.col("title")))).where(
        "page_lang is null or page_lang <> title_lang"
    ).select("page_id", "title", "page_lang", "title_lang")


# fixed values: languages that changed their name
RENAMED_LANGUAGES = {
    "Česky": "Čeština", "Indonesia": "Bahasa Indonesia", "Lietuviškai": "Lietuvių", "Slovenský": "Slovenčina",
}


def renamed_language_pages(cat: Catalog, renamed: dict[str, str] | None = None) -> DataFrame:
    """Moves that follow a changed language name: ``page_id, title, new_title``."""
    renamed = RENAMED_LANGUAGES if renamed is None else renamed
    page = cat["page"].where(~F.col("page_is_redirect") & F.col("page_namespace").isin(CONTENT_NAMESPACES))
    page = _titles(cat, page.select("page_id", "page_namespace", "page_title"), "page_namespace", "page_title", "title")
    new = None
    for old, name in renamed.items():
        hit = F.contains("title", F.lit(f"({old})")) | (F.col("title") == f"Category:{old}")
        value = F.when(F.col("title") == f"Category:{old}", F.lit(f"Category:{name}")).otherwise(
            F.replace("title", F.lit(f"({old})"), F.lit(f"({name})"))
        )
        new = F.when(hit, value) if new is None else new.when(hit, value)
    return page.withColumn("new_title", new).where("new_title is not null").select("page_id", "title", "new_title")


def unused_localized_templates(cat: Catalog) -> DataFrame:
    """Translated pages that use an English template although a translation exists.

    Only templates with language links count, and pages that are no redirects.
    """
    linked = cat["page"].where("page_namespace = 10").join(
        cat["langlinks"], F.col("page_id") == F.col("ll_from"), "left_semi"
    ).select(F.col("page_title").alias("template"))
    english = linked.where(title_language(F.col("template")) == "English")
    page = cat["page"].where("not page_is_redirect").select("page_id", "page_namespace", "page_title", "page_lang")
    page = page.withColumn("language", language_of_tag(F.col("page_lang"))).where("language <> 'English'")
    uses = cat["templatelinks"].where("tl_namespace = 10").select(
        F.col("tl_from").alias("page_id"), F.col("tl_title").alias("template")
    )
    used = uses.join(english, "template", "left_semi").join(page, "page_id")
    used = used.withColumn("localized", localized_title(F.col("template"), F.col("language")))
    return used.join(linked.withColumnRenamed("template", "localized"), "localized", "left_semi").select(
        "page_id", "page_title", "template", "localized"
    )


# ---- wikilinks ----------------------------------------------------------------------------


def with_label_title(cat: Catalog, links: DataFrame) -> DataFrame:
    """Parse link texts as titles: adds ``label_iw, label_ns, label_name, label_section``."""
    keep = [x for x in links.columns if x not in ("title_error", "leading_colon")]
    renamed = links.select(*[F.col(x).alias("_l_" + x) for x in keep])
    parsed = parse_titles(renamed, "_l_label", cat["interwiki"], cat["namespace_name"])
    return parsed.select(
        *[F.col("_l_" + x).alias(x) for x in keep], F.col("iwprefix").alias("label_iw"), F.col("ns_id").alias("label_ns"),
        F.col("pagename").alias("label_name"), F.col("sectionname").alias("label_section"),
    )


def redundant_labels(cat: Catalog, links: DataFrame) -> DataFrame:
    """``[[Foo|foo]]``: the text alone is the same title."""
    df = with_label_title(cat, links.where("label is not null"))
    return df.where(
        (F.col("label_iw") == F.col("iwprefix")) & (F.col("label_ns") == F.col("ns_id"))
        & (F.col("label_name") == F.col("pagename")) & (F.col("label_section") == F.col("sectionname"))
    ).select("page_id", "position", "raw", "label")


def _one_step(edges: DataFrame, ns: str, title: str, prefix: str) -> DataFrame:
    return edges.select(
        F.col("src_ns").alias(ns), F.col("src_title").alias(title), F.col("dst_ns").alias(prefix + "ns"),
        F.col("dst_title").alias(prefix + "title"), F.coalesce("fragment", F.lit("")).alias(prefix + "section"),
    )


def self_links(links: DataFrame, edges: DataFrame) -> DataFrame:
    """Section links that lead back to the same page, possibly through a redirect."""
    df = links.where("iwprefix = '' and sectionname <> ''")
    df = df.join(_one_step(edges, "ns_id", "pagename", "to_"), ["ns_id", "pagename"], "left")
    here = (F.coalesce("to_ns", "ns_id") == F.col("page_namespace")) & (
        F.coalesce("to_title", "pagename") == F.col("page_title")
    )
    return df.where(here).select("page_id", "position", "raw", F.concat(F.lit("#"), "sectionname").alias("short"))


def direct_links(cat: Catalog, links: DataFrame, edges: DataFrame) -> DataFrame:
    """``[[foo|bar]]`` where foo and bar are the same page after one redirect step."""
    df = with_label_title(cat, links.where("label is not null and iwprefix = '' and pagename <> ''"))
    df = df.where("label_iw = ''")
    df = df.join(_one_step(edges, "ns_id", "pagename", "a_"), ["ns_id", "pagename"], "left")
    df = df.join(_one_step(edges, "label_ns", "label_name", "b_"), ["label_ns", "label_name"], "left")
    via_a, via_b = F.col("a_title").isNotNull(), F.col("b_title").isNotNull()
    kept = ~via_a | (F.col("a_section") == F.col("sectionname"))

    def same(ns1: str, t1: str, s1: str, ns2: str, t2: str, s2: str) -> Column:
        return (F.col(ns1) == F.col(ns2)) & (F.col(t1) == F.col(t2)) & (F.col(s1) == F.col(s2))

    both = same("a_ns", "a_title", "a_section", "b_ns", "b_title", "b_section")
    first = same("a_ns", "a_title", "a_section", "label_ns", "label_name", "label_section")
    second = same("b_ns", "b_title", "b_section", "ns_id", "pagename", "sectionname")
    hit = F.when(via_a & via_b, both).when(via_a, first).when(via_b, second).otherwise(F.lit(False))
    return df.where(kept & hit).select("page_id", "position", "raw", "label")


def case_only_redirects(cat: Catalog, links: DataFrame, edges: DataFrame) -> DataFrame:
    """Links through a redirect that differs from its target only in case."""
    steps = _one_step(edges, "ns_id", "pagename", "to_").where("to_section = ''")
    df = links.where("iwprefix = ''").join(steps, ["ns_id", "pagename"])
    same = (F.col("to_ns") == F.col("ns_id")) & (F.lower("to_title") == F.lower("pagename"))
    df = _titles(cat, df.where(same), "to_ns", "to_title", "target")
    section = F.when(F.col("sectionname") != "", F.concat(F.lit("#"), "sectionname")).otherwise("")
    return df.select("page_id", "position", "raw", F.concat("target", section).alias("direct"))


def links_to_missing(links: DataFrame, page: DataFrame) -> DataFrame:
    wanted = links.where("iwprefix = '' and ns_id >= 0 and pagename <> ''")
    known = page.select(F.col("page_namespace").alias("ns_id"), F.col("page_title").alias("pagename"))
    return wanted.join(known, ["ns_id", "pagename"], "left_anti").select("page_id", "position", "ns_id", "pagename")


def display_title_mismatches(links: DataFrame, display: DataFrame) -> DataFrame:
    """Links spelled unlike the display title, apart from the first letter.

    ``display`` has ``ns_id, pagename, displaytitle``; links with a leading colon
    are left alone.
    """
    df = links.where("iwprefix = '' and ns_id >= 0 and pagename <> '' and not leading_colon")
    df = df.join(display, ["ns_id", "pagename"])
    spelled = F.substring_index("raw", "#", 1)
    tail = lambda x: F.substr(x, F.lit(2))
    differs = tail(spelled) != tail(F.col("displaytitle"))
    upper = ~F.substring("displaytitle", 1, 1).rlike(r"^\p{Ll}$")
    only_spaces = F.replace(tail(spelled), F.lit(" "), F.lit("_")) == F.replace(
        tail(F.col("displaytitle")), F.lit(" "), F.lit("_")
    )
    new = F.when(upper & only_spaces, F.concat(F.substring("raw", 1, 1), tail(F.col("displaytitle")))).otherwise(
        F.col("displaytitle")
    )
    return df.where(differs).select("page_id", "position", "raw", new.alias("new_title"))


def links_to_archive(cat: Catalog, links: DataFrame, resolved: DataFrame, archive: str | Column = "Project:Archive") -> DataFrame:
    """Links whose redirects end at the archive page, named or looked up by a scalar subquery."""
    ends = _titles(cat, resolved.where("dst_title is not null"), "dst_ns", "dst_title", "final").where(
        F.col("final") == archive
    ).select(F.col("src_ns").alias("ns_id"), F.col("src_title").alias("pagename"))
    return links.where("iwprefix = ''").join(ends, ["ns_id", "pagename"], "left_semi").select(
        "page_id", "position", "ns_id", "pagename"
    )


def broken_section_links(cat: Catalog, links: DataFrame, resolved: DataFrame) -> DataFrame:
    """Links to a section that the page, after redirects, does not have.

    ``via_section`` tells that the redirect itself leads to a section. Links into
    loops, to missing pages and to other wikis cannot be checked and are left out.
    """
    steps = resolved.select(
        F.col("src_ns").alias("ns_id"), F.col("src_title").alias("pagename"), "dst_ns", "dst_title",
        F.col("fragment").alias("to_fragment"), F.lit(True).alias("redirected"),
    )
    df = links.where("iwprefix = '' and sectionname <> '' and ns_id >= 0").join(steps, ["ns_id", "pagename"], "left")
    moved = F.col("redirected").isNotNull()
    df = df.withColumn("target_ns", F.when(moved, F.col("dst_ns")).otherwise(F.col("ns_id")))
    df = df.withColumn("target_title", F.when(moved, F.col("dst_title")).otherwise(F.col("pagename")))
    page = cat["page"].select(
        F.col("page_id").alias("target_page"), F.col("page_namespace").alias("target_ns"),
        F.col("page_title").alias("target_title"),
    )
    df = df.join(page, ["target_ns", "target_title"]).withColumn(
        "anchor", dot_encode(F.coalesce(url_decode(F.col("sectionname")), F.col("sectionname")))
    )
    known = cat["section"].select(F.col("sec_page").alias("target_page"), F.col("sec_anchor").alias("anchor"))
    return df.join(known, ["target_page", "anchor"], "left_anti").select(
        "page_id", "position", "raw", "target_page", "anchor", F.col("to_fragment").isNotNull().alias("via_section")
    )


def anchor_suggestions(cat: Catalog, broken: DataFrame) -> DataFrame:
    """The similar anchor of the same page for broken section links.

    Similarity is one minus the edit distance over the longer length. Only an anchor
    that alone reaches 0.8 is suggested: a second one at 0.8 or more could never be
    more than 0.2 behind the first. The anchors of one page come from one page text,
    so their array is small; each distinct broken anchor is scored once.
    """
    anchors = cat["section"].groupBy(F.col("sec_page").alias("target_page")).agg(F.collect_set("sec_anchor").alias("anchors"))
    wanted = broken.where("not via_section").select("target_page", "anchor").distinct()

    def similar(other: Column) -> Column:
        longer = F.greatest(F.length("anchor"), F.length(other))
        return 5 * F.levenshtein("anchor", other) <= longer

    scored = wanted.join(anchors, "target_page").select(
        "target_page", "anchor", F.filter("anchors", similar).alias("_similar")
    )
    scored = scored.where(F.size("_similar") == 1).select("target_page", "anchor", F.col("_similar")[0].alias("suggestion"))
    return broken.join(scored, ["target_page", "anchor"])


# ---- packages -----------------------------------------------------------------------------


def classify_packages(
    templates: DataFrame, packages: DataFrame, groups: DataFrame, user_packages: DataFrame, replaces: DataFrame
) -> DataFrame:
    """Template and hint for package names: ``name, template, package, hint``.

    Looked up in this order: package, group, user package (always lower case),
    package and group without regard to case, package that replaces the name.
    ``packages``, ``groups`` and ``user_packages`` have ``name``; ``replaces`` has
    ``name`` (replaced) and ``by``. Names are looked up once each.
    """

    def exact(df: DataFrame, column: str) -> DataFrame:
        return df.select(F.col("name").alias("key"), F.lit(True).alias(column)).distinct()

    def loose(df: DataFrame, column: str, value: str = "name") -> DataFrame:
        return df.groupBy(F.lower("name").alias("low")).agg(F.min(value).alias(column))

    names = templates.select(F.trim("name").alias("key")).distinct().withColumn("low", F.lower("key"))
    df = names.join(exact(packages, "is_pkg"), "key", "left").join(exact(groups, "is_grp"), "key", "left")
    users = user_packages.select(F.lower("name").alias("low"), F.lit(True).alias("is_user")).distinct()
    df = df.join(users, "low", "left").join(loose(packages, "pkg"), "low", "left")
    df = df.join(loose(groups, "grp"), "low", "left").join(loose(replaces, "by", "by"), "low", "left")
    template = (
        F.when(F.col("is_pkg"), F.lit("Pkg")).when(F.col("is_grp"), F.lit("Grp")).when(F.col("is_user"), F.lit("AUR"))
        .when(F.col("pkg").isNotNull(), F.lit("Pkg")).when(F.col("grp").isNotNull(), F.lit("Grp"))
    )
    known = F.coalesce("is_pkg", "is_grp", "is_user", F.lit(False))
    package = F.when(known, F.col("key")).otherwise(F.coalesce("pkg", "grp"))
    hint = F.when(
        template.isNull(),
        F.when(F.col("by").isNotNull(), F.concat(F.lit("replaced by {{Pkg|"), "by", F.lit("}}")))
        .otherwise(F.lit("package not found")),
    )
    return df.select(F.col("key").alias("name"), template.alias("template"), package.alias("package"), hint.alias("hint"))


def package_hints(uses: DataFrame, classified: DataFrame) -> DataFrame:
    """Hints per use: ``page_id, title, name, message``; uses with one parameter only."""
    count = F.when(F.col("parameters") != 1, F.lit("invalid number of template parameters"))
    df = uses.withColumn("name", F.trim("name")).join(classified, "name", "left")
    return df.withColumn("message", F.coalesce("hint", count)).where("message is not null").select(
        "page_id", "title", "name", "message"
    )


# ---- comparison ---------------------------------------------------------------------------


def compare(left: DataFrame, right: DataFrame, key: Collection[str], ignore: Collection[str] = ()) -> DataFrame:
    """Differences of two tables: ``<key>, status, columns``.

    ``status`` is ``only left``, ``only right`` or ``differs``; ``columns`` lists the
    differing fields. Arrays are compared without regard to order; a column that
    one side lacks counts as NULL there. One full outer join on the key.
    """
    key = list(key)
    fields = [x for x in dict.fromkeys([*left.columns, *right.columns]) if x not in key and x not in set(ignore)]
    known = dict([*right.dtypes, *left.dtypes])

    def normal(df: DataFrame, side: str) -> DataFrame:
        kinds = dict(df.dtypes)
        values = [
            (F.lit(None).cast(known[x]) if x not in kinds else F.array_sort(x) if kinds[x].startswith("array") else F.col(x)).alias(x)
            for x in fields
        ]
        return df.select(*key, F.struct(*values, F.lit(True).alias("_there")).alias(side))

    # rows are compared whole; only of those that differ is every field looked at
    df = normal(left, "_a").join(normal(right, "_b"), key, "full_outer").where(~F.col("_a").eqNullSafe(F.col("_b")))
    in_a, in_b = F.col("_a._there").isNotNull(), F.col("_b._there").isNotNull()
    differing = F.concat_ws(",", *[F.when(~F.col(f"_a.{x}").eqNullSafe(F.col(f"_b.{x}")), F.lit(x)) for x in fields])
    status = F.when(~in_b, F.lit("only left")).when(~in_a, F.lit("only right")).otherwise(F.lit("differs"))
    return df.select(*key, status.alias("status"), F.when(in_a & in_b, differing).otherwise(F.lit("")).alias("columns"))


# ranges of a table whose digests are compared before any row is
RANGES = 4096


def _range(key: list[str]) -> Column:
    return F.pmod(F.xxhash64(*[F.col(k).cast("string") for k in key]), F.lit(RANGES)).alias("range")


def _range_digests(name: str, df: DataFrame, key: list[str], fields: list[str]) -> DataFrame:
    """``name, range, digest`` of the rows of each range of keys, combined on the map side."""
    kinds = dict(df.dtypes)
    values = [
        F.lit(None).cast("string") if x not in kinds else F.array_sort(x) if kinds[x].startswith("array") else F.col(x)
        for x in fields
    ]
    # a hash takes no notice of NULL
    cells = [x for value in [*map(F.col, key), *values] for x in (value, value.isNull())]
    digest = F.struct(
        F.count(F.lit(1)).alias("rows"), F.bit_xor("h").alias("mix"), F.sum(F.col("h").bitwiseAND(2**31 - 1)).alias("total")
    )
    return df.select(_range(key), F.xxhash64(*cells).alias("h")).groupBy(F.lit(name).alias("name"), "range").agg(digest.alias("digest"))


def differing_ranges(pairs: dict[str, tuple[DataFrame, DataFrame, list[str], set[str]]]) -> DataFrame:
    """``name, range`` of the ranges whose digests differ; ``pairs`` has left, right, key and fields to ignore by name.

    One job for all pairs: an aggregation per table, and a join of at most RANGES rows for each.
    """
    sides = []
    for side in (0, 1):
        rows = None
        for name, (left, right, key, ignore) in pairs.items():
            fields = [x for x in dict.fromkeys([*left.columns, *right.columns]) if x not in key and x not in ignore]
            part = _range_digests(name, (left, right)[side], list(key), fields)
            rows = part if rows is None else rows.unionByName(part)
        sides.append(rows.withColumnRenamed("digest", f"d{side}"))
    both = sides[0].join(sides[1], ["name", "range"], "full_outer").where(~F.col("d0").eqNullSafe(F.col("d1")))
    return Generations(both.sparkSession).append(both.select("name", "range"))


def _compare_where(differing: DataFrame, left: DataFrame, right: DataFrame, key: list[str], ignore: set[str]) -> DataFrame:
    # at most RANGES rows
    ranges = F.broadcast(differing.select("range"))

    def reduced(df: DataFrame) -> DataFrame:
        return df.withColumn("range", _range(key)).join(ranges, "range", "left_semi").drop("range")

    return compare(reduced(left), reduced(right), key, ignore)


def compare_ranges(left: DataFrame, right: DataFrame, key: Collection[str], ignore: Collection[str] = ()) -> DataFrame:
    """As :func:`compare`, but only ranges of keys whose digests differ are joined."""
    key, ignore = list(key), set(ignore)
    return _compare_where(differing_ranges({"": (left, right, key, ignore)}), left, right, key, ignore)


# dataset -> table, key, fields that may differ
MIRROR_CHECKS = {
    "pages": ("page", ["page_id"], ["page_touched"]),
    "page properties": ("page_props", ["pp_page", "pp_propname"], []),
    "revisions": ("revision", ["rev_id"], ["rev_text_id"]),
    "deleted revisions": ("archive", ["ar_rev_id"], ["ar_id", "ar_text_id"]),
    "recent changes": ("recentchanges", ["rc_id"], []),
    "log events": ("logging", ["log_id"], []),
    "users": ("users", ["user_id"], []),
    "blocks": ("ipblocks", ["ipb_id"], []),
    "protected titles": ("protected_titles", ["pt_namespace", "pt_title"], []),
    "tags": ("tag", ["tag_name"], ["tag_id"]),
    "namespaces": ("namespace_starname", ["nss_id"], []),
    "interwiki prefixes": ("interwiki", ["iw_prefix"], []),
    "redirects": ("redirect", ["rd_from"], []),
    "sections": ("section", ["sec_page", "sec_number"], []),
    "category members": ("categorylinks", ["cl_from", "cl_to"], []),
    "language links": ("langlinks", ["ll_from", "ll_lang"], []),
    "page links": ("pagelinks", ["pl_from", "pl_namespace", "pl_title"], []),
    "template links": ("templatelinks", ["tl_from", "tl_namespace", "tl_title"], []),
    "image links": ("imagelinks", ["il_from", "il_to"], []),
    "external links": ("externallinks", ["el_from", "el_to"], []),
}


def mirror_differences(mirror: Catalog, source: Catalog, checks: dict = MIRROR_CHECKS) -> DataFrame:
    """Differences of a mirror's tables from their source: ``dataset, key, status, columns``.

    Digests of ranges come first; a table whose digests are equal is not read again.
    """
    pairs = {name: (mirror[table], source[table], list(key), set(ignore)) for name, (table, key, ignore) in checks.items()}
    differing = differing_ranges(pairs)
    # at most one name per dataset
    names = {r.name for r in differing.select("name").distinct().collect()}
    out = mirror.spark.createDataFrame([], "dataset string, key string, status string, columns string")
    for name in (n for n in pairs if n in names):
        left, right, key, ignore = pairs[name]
        found = _compare_where(differing.where(F.col("name") == name), left, right, key, ignore)
        text = F.concat_ws("/", *[F.col(x).cast("string") for x in key])
        out = out.unionByName(found.select(F.lit(name).alias("dataset"), text.alias("key"), "status", "columns"))
    return out


register_check("mirror-differences", mirror_differences)
register_check("closed-discussions", closed_discussions)
register_check("talk-without-article", talk_without_article)
register_check("talk-of-redirects", talk_of_redirects)
register_check("wrong-language-categories", wrong_language_categories)
register_check("categorized-talk", categorized_talk)
register_check("language-mismatches", language_mismatches)
register_check("unused-localized-templates", unused_localized_templates)
