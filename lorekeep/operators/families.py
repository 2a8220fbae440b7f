"""Translation families: pages that are each other's translations, and their language links.

A family holds at most one page per language, so every group here is as small as
the language list. Conflicting groups (two pages in one language) are split by
the case of the title, and what still conflicts is reported instead of merged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.functions.langs import (
    EXTERNAL_TAGS, INTERLANGUAGE_TAGS, INTERNAL_TAGS, language_of_tag, localized_title, pure_title, tag_of_language,
    title_language,
)
from lorekeep.functions.titles import canonical_title, prefixed
from lorekeep.operators import common as c
from lorekeep.operators.graph import redirect_edges, resolve_redirects
from lorekeep.session import cut_lineage
from lorekeep.sources.catalog import Catalog

# fixed values: namespaces whose pages can be translated
CONTENT_NAMESPACES = [0, 4, 10, 12, 14]


def content_pages(cat: Catalog) -> DataFrame:
    """Content pages that are no redirects: full title, pure title, language, tag."""
    page = cat["page"].where(~F.col("page_is_redirect") & F.col("page_namespace").isin(CONTENT_NAMESPACES))
    df = c.with_namespace(page.select("page_id", "page_namespace", "page_title"), cat, "page_namespace")
    df = df.withColumn("full_title", prefixed(F.col("nss_name"), F.col("page_title")))
    df = df.withColumn("language", title_language(F.col("full_title")))
    return df.select(
        "page_id", "full_title", pure_title(F.col("full_title")).alias("pure"), "language",
        tag_of_language(F.col("language")).alias("tag"),
    )


def group_families(pages: DataFrame) -> DataFrame:
    """Add ``family``: the pure title without regard to case, or with it where a
    language would occur twice. Only counts per key are shuffled before the join."""
    valid = pages.where(F.col("tag").isin(INTERLANGUAGE_TAGS)).withColumn("_key", F.lower("pure"))
    clashes = (
        valid.groupBy("_key").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("tag").alias("tags"))
        .where("n <> tags").select("_key", F.lit(True).alias("clash"))
    )
    joined = valid.join(clashes, "_key", "left")
    return joined.withColumn("family", F.when(F.col("clash"), F.col("pure")).otherwise(F.col("_key"))).drop("_key", "clash")


def _exists(df: DataFrame, title: Column, pages: DataFrame, name: str) -> DataFrame:
    """Add a boolean column telling whether a content page has this title."""
    known = pages.select(F.col("full_title").alias("_known"), F.lit(True).alias(name))
    joined = df.withColumn("_title", canonical_title(title)).join(
        known, F.col("_title") == F.col("_known"), "left"
    )
    return joined.withColumn(name, F.coalesce(name, F.lit(False))).drop("_title", "_known")


def link_candidates(cat: Catalog, pages: DataFrame) -> DataFrame:
    """Language links of content pages as ``(page_id, tag, title, kind)``.

    Internal targets are resolved through redirects; ``kind`` is ``external``,
    ``internal`` (the target exists) or ``invalid``.
    """
    links = cat["langlinks"].where(F.col("ll_lang").isin(INTERLANGUAGE_TAGS)).join(
        pages.select("page_id"), F.col("ll_from") == F.col("page_id"), "left_semi"
    )
    full = localized_title(F.col("ll_title"), language_of_tag(F.col("ll_lang")))
    internal = F.col("ll_lang").isin(INTERNAL_TAGS)
    links = links.select(
        F.col("ll_from").alias("page_id"), F.col("ll_lang").alias("tag"),
        F.when(internal, canonical_title(full)).otherwise(full).alias("full"), internal.alias("is_internal"),
    )
    targets = resolve_redirects(redirect_edges(cat)).where("dst_title is not null")
    targets = c.with_namespace(targets, cat, "src_ns", "src_name")
    targets = c.with_namespace(targets, cat, "dst_ns", "dst_name").select(
        prefixed(F.col("src_name"), F.col("src_title")).alias("full"),
        prefixed(F.col("dst_name"), F.col("dst_title")).alias("resolved"),
    )
    df = links.join(targets, "full", "left")
    final = F.when(F.col("is_internal"), F.coalesce("resolved", "full")).otherwise(F.col("full"))
    df = df.withColumn("title", pure_title(final))
    language = language_of_tag(F.col("tag"))
    df = _exists(df, localized_title(F.col("title"), language), pages, "_whole")
    df = _exists(df, localized_title(F.col("title"), language, every_part=False), pages, "_last")
    found = F.col("_whole") | (F.contains("title", F.lit("/")) & F.col("_last"))
    kind = (
        F.when(F.col("tag").isin(EXTERNAL_TAGS), F.lit("external"))
        .when(F.col("is_internal") & found, F.lit("internal")).otherwise(F.lit("invalid"))
    )
    return df.select("page_id", "tag", "title", kind.alias("kind"))


def _first(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """The candidate with the smallest ``rank`` per key and tag."""
    return candidates.groupBy(*keys, "tag").agg(
        F.min_by(F.struct("title", "stage"), "rank").alias("x")
    ).select(*keys, "tag", "x.title", "x.stage")


def complete_families(cat: Catalog) -> tuple[DataFrame, DataFrame]:
    """Families with links pulled in: ``(members, completed)``.

    ``members`` are the pages of the families. ``completed`` has one row per page
    and language: the title that the page's family has in that language. Order of
    preference: the family's own pages; valid internal links of its pages by
    title; the links of the English page, if it belongs to the family or its own
    family has room for the page; else external links of any page.
    """
    pages = cut_lineage(content_pages(cat))
    members = cut_lineage(group_families(pages))
    links = cut_lineage(link_candidates(cat, pages))
    owned = members.select(
        "family", "tag", F.col("pure").alias("title"), F.lit(0).alias("stage"),
        F.struct(F.lit(0).alias("s"), F.col("full_title").alias("t"), F.lit("").alias("l")).alias("rank"),
    )
    pulled = links.join(members.select("page_id", "family", "full_title"), "page_id")

    def ranked(df: DataFrame, stage: int) -> DataFrame:
        rank = F.struct(F.lit(stage).alias("s"), F.col("full_title").alias("t"), F.col("title").alias("l"))
        return df.select("family", "tag", "title", F.lit(stage).alias("stage"), rank.alias("rank"))

    from_pages = ranked(pulled.where("kind = 'internal'"), 1)
    base = cut_lineage(_first(owned.unionByName(from_pages), ["family"]))

    # the English page of each family: its own (stage 0) or one that was pulled in
    english = base.where("tag = 'en'").select("family", F.col("title").alias("en_title"), F.col("stage").alias("en_stage"))
    en_pages = members.where("tag = 'en'").select(
        F.col("full_title").alias("en_title"), F.col("page_id").alias("en_id"), F.col("family").alias("en_family")
    )
    english = cut_lineage(english.join(en_pages, "en_title"))
    from_english = english.join(
        links.where("kind <> 'invalid'").withColumnRenamed("page_id", "en_id"), "en_id"
    ).select(
        "family", "tag", "title", F.lit(2).alias("stage"),
        F.struct(F.lit(2).alias("s"), F.col("en_title").alias("t"), F.col("title").alias("l")).alias("rank"),
    )
    whole = base.select(
        "family", "tag", "title", "stage",
        F.struct(F.lit(0).alias("s"), F.lit("").alias("t"), F.lit("").alias("l")).alias("rank"),
    )
    with_english = cut_lineage(_first(whole.unionByName(from_english), ["family"]))
    without_english = _first(whole.unionByName(ranked(pulled.where("kind = 'external'"), 2)), ["family"])

    # which variant a page takes
    masters = members.select("page_id", "family", "tag", F.col("pure").alias("title")).join(
        english.select("family", "en_stage", "en_family"), "family", "left"
    )
    other = with_english.select(F.col("family").alias("en_family"), F.col("tag").alias("_tag"), F.col("title").alias("_title"))
    same_title = other.select("en_family", F.col("_title").alias("title"), F.lit(True).alias("known")).distinct()
    same_tag = other.select("en_family", F.col("_tag").alias("tag"), F.lit(True).alias("taken"))
    masters = masters.join(same_title, ["en_family", "title"], "left").join(same_tag, ["en_family", "tag"], "left")
    joins_english = F.col("en_family").isNotNull() & (
        (F.col("en_stage") == 0) | F.col("known").isNotNull() | F.col("taken").isNull()
    )
    chosen = masters.select("page_id", "family", joins_english.alias("joined"))
    completed = chosen.where("joined").join(with_english, "family").unionByName(
        chosen.where("not joined").join(without_english, "family")
    )
    return members, cut_lineage(completed.select("page_id", "family", "tag", "title"))


def language_links(
    members: DataFrame, completed: DataFrame, pages: DataFrame, archive: str = "Project:Archive"
) -> DataFrame:
    """New language links per page: its family without itself and without the archive."""
    own = members.select("page_id", F.col("tag").alias("own_tag"), F.col("pure").alias("own_title"))
    df = completed.join(own, "page_id").where("not (tag = own_tag and title = own_title)")
    df = df.where((F.col("title") != archive) | (F.col("own_title") == archive))
    new_title = localized_title(F.col("title"), language_of_tag(F.col("tag")))
    df = _exists(df, new_title, pages, "_there")
    shown = F.when(F.col("_there"), pure_title(new_title, every_part=False)).otherwise(F.col("title"))
    return df.select("page_id", "tag", shown.alias("title"))


def changed_language_links(cat: Catalog, members: DataFrame, new_links: DataFrame) -> DataFrame:
    """Pages whose links change, with the old and the new set as sorted texts.

    Both sets have at most one entry per language.
    """
    link = F.concat("tag", F.lit(":"), "title")
    new = new_links.groupBy("page_id").agg(F.array_join(F.array_sort(F.collect_set(link)), "|").alias("new_links"))
    old = cat["langlinks"].groupBy(F.col("ll_from").alias("page_id")).agg(
        F.array_join(F.array_sort(F.collect_set(F.concat("ll_lang", F.lit(":"), "ll_title"))), "|").alias("old_links")
    )
    df = members.select("page_id", "full_title").join(new, "page_id", "left").join(old, "page_id", "left")
    df = df.na.fill("", ["new_links", "old_links"])
    return df.where("new_links <> old_links")


def orphans(members: DataFrame, new_links: DataFrame) -> DataFrame:
    """Pages in other languages than English that are alone in their family."""
    return members.where("tag <> 'en'").join(new_links, "page_id", "left_anti").select("page_id", "full_title")


def rename_suggestions(members: DataFrame, new_links: DataFrame, pages: DataFrame) -> DataFrame:
    """Localised categories whose name differs from the English one, if the new name is free."""
    english = members.where("tag = 'en' and full_title like 'Category:%'").select("page_id", "full_title")
    links = new_links.where(F.col("tag").isin(INTERNAL_TAGS)).join(english, "page_id").where("title <> full_title")
    suffix = F.concat(F.lit(" ("), language_of_tag(F.col("tag")), F.lit(")"))
    df = links.withColumn("source", F.concat("title", suffix)).withColumn("target", F.concat("full_title", suffix))
    return _exists(df, F.col("target"), pages, "_there").where("not _there").select("source", "target")
