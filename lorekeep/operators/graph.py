"""Graphs as edge tables: redirect chains and category trees.

The loops below iterate on DataFrames. Each round is written to the shared
folder, so plans stay short and lost executors do not cost the earlier rounds.
Only a row count per round reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.functions.langs import localized_title, pure_title, title_language
from lorekeep.operators import common as c
from lorekeep.operators.closure import Generations, chase
from lorekeep.session import cut_lineage
from lorekeep.sources.catalog import Catalog


def place_in_group(df: DataFrame, group: str, order: list[Column], name: str = "place") -> DataFrame:
    """Row number from 1 within each group, also for groups too large for one task.

    Rows are range-sorted over the whole cluster; each task numbers its own slice
    and adds the sizes of the same group's earlier slices.
    """
    keys = [F.col(group), *order]
    sliced = cut_lineage(
        df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_slice", F.spark_partition_id())
    )
    sizes = sliced.groupBy(group, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(group, "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy(group, "_slice").orderBy(*order)
    numbered = sliced.withColumn("_row", F.row_number().over(within))
    out = numbered.join(offsets, [group, "_slice"])
    return out.withColumn(name, F.col("_before") + F.col("_row")).drop("_slice", "_before", "_row")


# ---- redirects ---------------------------------------------------------------------------


def redirect_edges(cat: Catalog, source_namespaces=None, target_namespaces=None) -> DataFrame:
    """``src_ns, src_title, dst_ns, dst_title, fragment`` of redirects to existing pages."""
    page = cat["page"].select("page_id", "page_namespace", "page_title")
    source = page.select(
        F.col("page_id").alias("rd_from"), F.col("page_namespace").alias("src_ns"), F.col("page_title").alias("src_title")
    )
    target = page.select(F.col("page_namespace").alias("dst_ns"), F.col("page_title").alias("dst_title"))
    if source_namespaces is not None:
        source = source.where(F.col("src_ns").isin(c.as_set(source_namespaces)))
    if target_namespaces is not None:
        target = target.where(F.col("dst_ns").isin(c.as_set(target_namespaces)))
    redirect = cat["redirect"].where("rd_interwiki is null and rd_namespace is not null").select(
        "rd_from", F.col("rd_namespace").alias("dst_ns"), F.col("rd_title").alias("dst_title"),
        F.nullif(F.col("rd_fragment"), F.lit("")).alias("fragment"),
    )
    df = redirect.join(target, ["dst_ns", "dst_title"], "left_semi").join(source, "rd_from")
    return df.select("src_ns", "src_title", "dst_ns", "dst_title", "fragment")


def resolve_redirects(edges: DataFrame) -> DataFrame:
    """Final target of every redirect; the last non-empty fragment on the way wins.

    Sources on a loop, or leading into one, get NULL.
    """
    ends = ["dst_ns", "dst_title", "fragment"]
    found = chase(
        edges.select("src_ns", "src_title", *ends), ["src_ns", "src_title"], ["dst_ns", "dst_title"], ["fragment"]
    )
    return found.select("src_ns", "src_title", *[F.when(F.col("closed"), F.col(x)).alias(x) for x in ends])


def double_redirects(edges: DataFrame) -> DataFrame:
    """Redirects whose target is a redirect, with the two hops."""
    first = edges.select("src_ns", "src_title", F.col("dst_ns").alias("via_ns"), F.col("dst_title").alias("via_title"))
    second = edges.select(F.col("src_ns").alias("via_ns"), F.col("src_title").alias("via_title"), "dst_ns", "dst_title")
    return first.join(second, ["via_ns", "via_title"])


# ---- categories --------------------------------------------------------------------------


def category_edges(cat: Catalog) -> DataFrame:
    """``parent, child`` between category pages; the parent may lack a page."""
    page = cat["page"].where("page_namespace = 14").select("page_id", F.col("page_title").alias("child"))
    links = cat["categorylinks"].select("cl_from", F.col("cl_to").alias("parent"))
    return page.join(links, F.col("page_id") == F.col("cl_from")).select("parent", "child")


def category_info(cat: Catalog) -> DataFrame:
    """Pages, subcategories and files per category that has members or a page."""
    counts = cat["categorylinks"].groupBy(F.col("cl_to").alias("category")).pivot(
        "cl_type", ["page", "subcat", "file"]
    ).agg(F.count(F.lit(1)))
    pages = cat["page"].where("page_namespace = 14").select(F.col("page_title").alias("category"))
    full = counts.join(pages, "category", "full_outer").na.fill(0, ["page", "subcat", "file"])
    return full.select(
        "category", F.col("page").alias("pages"), F.col("subcat").alias("subcats"), F.col("file").alias("files"),
        (F.col("page") + F.col("subcat") + F.col("file")).alias("size"),
    )


def ordered_children(edges: DataFrame) -> DataFrame:
    """``parent, child, place``: siblings numbered without regard to case."""
    return place_in_group(edges.distinct(), "parent", [F.lower("child"), F.col("child")])


def walk_tree(edges: DataFrame, root: str, max_depth: int | None = None) -> DataFrame:
    """Every simple path that starts at ``root``: one row per path.

    ``path`` lists the categories, ``levels`` their places among all siblings
    (also those skipped because they are on the path already). The root counts as
    visited. Runs until no path grows, or to ``max_depth`` if one is given; the
    number of paths, not of categories, decides the size on dense graphs.
    """
    children = cut_lineage(ordered_children(edges))
    found = children.sparkSession.createDataFrame([(root, [root], [])], "node string, path array<string>, levels array<long>")
    rows = None
    depth = 0
    while max_depth is None or depth < max_depth:
        grown = found.join(children, F.col("node") == F.col("parent")).where(
            ~F.array_contains("path", F.col("child"))
        )
        found = cut_lineage(grown.select(
            F.col("child").alias("node"), F.concat("path", F.array("child")).alias("path"),
            F.concat("levels", F.array("place")).alias("levels"),
        ))
        if found.isEmpty():
            break
        rows = found if rows is None else rows.unionByName(found)
        depth += 1
    if rows is None:
        rows = found
    return rows.select(
        F.col("node").alias("category"), F.element_at("path", F.lit(-2)).alias("parent"), "path", "levels",
        F.size("levels").alias("depth"),
    )


def compare_trees(left: DataFrame, right: DataFrame) -> DataFrame:
    """Two walked trees side by side, matched on the path of language-free names."""

    def keyed(tree: DataFrame, name: str) -> DataFrame:
        # the root differs between languages; below it the pure names must agree
        pure = F.transform(F.slice("path", 2, F.size("path")), lambda name: pure_title(name))
        return tree.select(F.array_join(pure, "\x1f").alias("key"), F.col("category").alias(name), F.col("depth").alias("d_" + name))

    both = keyed(left, "left").join(keyed(right, "right"), "key", "full_outer")
    return both.select(
        F.replace(F.col("key"), F.lit("\x1f"), F.lit("/")).alias("path"),
        F.coalesce("d_left", "d_right").alias("depth"), "left", "right",
    )


def other_parents(edges: DataFrame, walked: DataFrame) -> DataFrame:
    """Parents of each walked category besides the one the path came through."""
    parents = edges.distinct().withColumnRenamed("parent", "other").withColumnRenamed("child", "category")
    rows = walked.select("category", "parent").distinct()
    return rows.join(parents, "category").where(F.col("other") != F.col("parent"))


def contents_rows(edges: DataFrame, walked: DataFrame, info: DataFrame) -> DataFrame:
    """Table of contents: indent, label like ``1.2.3``, name, page count, other parents.

    A category has few parents, so joining their names into one text is safe.
    """
    also = other_parents(edges, walked).groupBy("category", "parent").agg(
        F.array_join(F.array_sort(F.collect_set(pure_title(F.col("other")))), ", ").alias("also_in")
    )
    df = walked.join(info, "category", "left").join(also, ["category", "parent"], "left")
    label = F.array_join(F.transform("levels", lambda x: x.cast("string")), ".")
    line = F.concat(
        F.repeat(F.lit(" "), F.col("depth") * 4), label, F.lit(" "), pure_title(F.col("category")),
        F.format_string(" (%d)", F.coalesce("pages", F.lit(0))),
        F.coalesce(F.concat(F.lit(" (also in "), F.col("also_in"), F.lit(")")), F.lit("")),
    )
    return df.select(
        "category", "parent", "depth", "levels", label.alias("label"), F.coalesce("pages", F.lit(0)).alias("pages"),
        "also_in", line.alias("line"),
    ).orderBy("levels")


def wanted_categories(cat: Catalog) -> DataFrame:
    """Categories with members but without a page, with their member count."""
    used = cat["categorylinks"].groupBy(F.col("cl_to").alias("category")).agg(F.count(F.lit(1)).alias("members"))
    pages = cat["page"].where("page_namespace = 14").select(F.col("page_title").alias("category"))
    return used.join(pages, "category", "left_anti")


def _pure(name: Column) -> Column:
    return F.substr(pure_title(F.concat(F.lit("Category:"), name)), F.lit(len("Category:") + 1))


def _language(name: Column) -> Column:
    return title_language(F.concat(F.lit("Category:"), name))


def localized_categories_to_create(cat: Catalog, root: str = "Languages", local: str = "English") -> DataFrame:
    """Categories to create for wanted localised ones: ``category, parent``.

    A wanted category is created if its English counterpart exists, below the
    localised parents of that counterpart; missing parents follow in the next
    round. Categories without parents have one row with a NULL parent.
    """
    existing = cat["page"].where("page_namespace = 14").select(F.col("page_title").alias("name"))
    parents = category_edges(cat).distinct()
    frontier = wanted_categories(cat).select("category")
    planned = Generations(cat.spark)
    while True:
        named = frontier.select(
            "category", _language(F.col("category")).alias("language"), _pure(F.col("category")).alias("name")
        ).where(F.col("language") != local)
        good = named.join(existing, "name", "left_semi")
        lifted = good.join(parents, F.col("name") == F.col("child"), "left")
        parent_pure, parent_language = _pure(F.col("parent")), _language(F.col("parent"))
        # the parent of a language's master category is its counterpart in the new language
        localized = (
            F.when(F.col("parent").isNull(), F.lit(None).cast("string"))
            .when(parent_pure == root, parent_pure)
            .when(F.lower(parent_pure) == F.lower(parent_language), F.col("language"))
            .otherwise(localized_title(parent_pure, F.col("language")))
        )
        step = planned.append(lifted.select("category", localized.alias("parent")).distinct())
        if step.isEmpty():
            return planned.all()
        done = planned.all().select(F.col("category").alias("name")).unionByName(existing)
        frontier = step.where("parent is not null").select(F.col("parent").alias("category")).distinct().join(
            done, F.col("category") == F.col("name"), "left_anti"
        )


def unused_categories(cat: Catalog) -> DataFrame:
    page = cat["page"].where("page_namespace = 14").select("page_id", "page_title")
    return page.join(cat["categorylinks"], F.col("page_title") == F.col("cl_to"), "left_anti")


def recategorization(cat: Catalog) -> DataFrame:
    """Members of redirected categories with the category they should move to."""
    moves = redirect_edges(cat, source_namespaces=14).select(
        F.col("src_title").alias("source"), F.col("dst_ns").alias("target_ns"), F.col("dst_title").alias("target")
    )
    members = cat["categorylinks"].select(F.col("cl_from").alias("page_id"), F.col("cl_to").alias("source"))
    return members.join(moves, "source").select("page_id", "source", "target_ns", "target")
