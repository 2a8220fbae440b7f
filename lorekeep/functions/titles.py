"""Page titles: canonical form, parsing, derived names, relative links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.functions.encodings import anchor_text, url_decode

# fixed value: characters allowed in page titles
_ILLEGAL = r"""[^ %!"$&'()*,\-./0-9:;=?@A-Z\\^_`a-z~+\x{80}-\x{10FFFF}]"""


def canonical_title(title: Column) -> Column:
    """Spaces for underscores, trimmed, marks dropped, spaces squashed, first letter upper."""
    out = F.regexp_replace(F.replace(title, F.lit("_"), F.lit(" ")), r"^\s+|\s+$", "")
    out = F.regexp_replace(F.regexp_replace(out, "[‎‏]", ""), r"^\s+|\s+$", "")
    out = F.regexp_replace(out, " +", " ")
    return F.concat(F.upper(F.substring(out, 1, 1)), F.substr(out, F.lit(2)))


def prefixed(namespace: Column, title: Column) -> Column:
    """``Namespace:Title``, or the bare title in the main namespace."""
    return F.when(F.coalesce(namespace, F.lit("")) == "", title).otherwise(
        F.concat(namespace, F.lit(":"), title)
    )


def computed_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that later steps use many times.

    A one-element ``inline`` keeps the optimizer from copying long expressions into
    every filter and column that mentions them, so each is evaluated once per row.
    """
    row = F.struct(*[value.alias(name) for name, value in columns.items()])
    kept = [x for x in df.columns if x not in columns]
    return df.select(*kept, F.inline(F.array(row)))


def _after(text: Column, mark: str) -> Column:
    """Text behind the first ``mark``; empty when there is none."""
    place = F.instr(text, mark)
    return F.when(place > 0, F.substring(text, place + len(mark), F.length(text))).otherwise(F.lit(""))


def parse_titles(df: DataFrame, column: str, interwiki: DataFrame, names: DataFrame) -> DataFrame:
    """Split titles into interwiki prefix, namespace, page name and section.

    ``interwiki`` needs ``iw_prefix`` and ``iw_local``; ``names`` needs ``nsn_id``
    and ``nsn_name``. Prefixes match without regard to case. Adds the columns
    ``iwprefix, namespace, ns_id, pagename, sectionname, leading_colon,
    title_error``; a bad title has an error and NULL parts. The two lookups are
    equi joins, which Spark broadcasts as long as the tables are small.
    """
    raw = F.col(column)
    body = F.regexp_replace(raw, "^:", "")
    iw_key = F.lower(
        F.replace(F.trim(F.replace(F.substring_index(body, ":", 1), F.lit("_"), F.lit(" "))), F.lit(" "), F.lit("_"))
    )
    prefixes = interwiki.select(
        F.lower("iw_prefix").alias("_iw_key"), F.col("iw_prefix").alias("iwprefix"),
        F.col("iw_local").alias("_iw_local"),
    )
    spaces = names.where("nsn_name <> ''").select(
        F.lower("nsn_name").alias("_ns_key"), F.col("nsn_name").alias("namespace"),
        F.col("nsn_id").alias("ns_id"),
    )
    out = df.withColumn("_body", body).withColumn(
        "_iw_key", F.when(F.contains(body, F.lit(":")), iw_key)
    )
    out = out.join(prefixes, "_iw_key", "left")
    is_iw = F.col("iwprefix").isNotNull()
    out = out.withColumn(
        "_rest", F.when(is_iw, F.regexp_replace(_after(F.col("_body"), ":"), "^:+", "")).otherwise(F.col("_body"))
    )
    may_have_ns = F.contains(F.col("_rest"), F.lit(":")) & (~is_iw | F.col("_iw_local"))
    out = out.withColumn(
        "_ns_key", F.when(may_have_ns, F.lower(canonical_title(F.substring_index("_rest", ":", 1))))
    ).join(spaces, "_ns_key", "left")
    pure = F.when(F.col("namespace").isNotNull(), _after(F.col("_rest"), ":")).otherwise(F.col("_rest"))
    out = out.withColumn("_pure", pure)
    out = computed_once(
        out, _name=url_decode(F.substring_index("_pure", "#", 1)), _section=anchor_text(_after(F.col("_pure"), "#"))
    )
    error = (
        F.when(~is_iw & F.startswith("_body", F.lit(":")), F.lit("colon"))
        .when(F.startswith("_name", F.lit(":")), F.lit("colon"))
        .when(F.col("_name").isNull() | F.col("_name").rlike(_ILLEGAL), F.lit("character"))
    )
    out = computed_once(out, title_error=error, _title=canonical_title(F.col("_name")))
    good = F.col("title_error").isNull()
    return (
        out.withColumn("pagename", F.when(good, F.col("_title")))
        .withColumn("sectionname", F.when(good, F.col("_section")))
        .withColumn("leading_colon", F.startswith(raw, F.lit(":")))
        .withColumn("iwprefix", F.when(good, F.coalesce("iwprefix", F.lit(""))))
        .withColumn("ns_id", F.when(good, F.coalesce("ns_id", F.lit(0))))
        .withColumn("namespace", F.when(good, F.coalesce("namespace", F.lit(""))))
        .drop("_body", "_iw_key", "_iw_local", "_rest", "_ns_key", "_pure", "_name", "_section", "_title")
    )


def full_page_name(iwprefix: Column, namespace: Column, pagename: Column) -> Column:
    return F.concat(
        F.when(iwprefix == "", F.lit("")).otherwise(F.concat(iwprefix, F.lit(":"))),
        prefixed(namespace, pagename),
    )


def base_page_name(pagename: Column) -> Column:
    """Without the rightmost subpage level."""
    return F.regexp_replace(pagename, "/[^/]*$", "")


def sub_page_name(pagename: Column) -> Column:
    """The rightmost subpage level."""
    return F.substring_index(pagename, "/", -1)


def root_page_name(pagename: Column) -> Column:
    return F.substring_index(pagename, "/", 1)


def article_space(ns_id: Column) -> Column:
    """Subject namespace of a namespace; special namespaces are their own."""
    return F.when((ns_id > 0) & (ns_id % 2 == 1), ns_id - 1).otherwise(ns_id)


def talk_space(ns_id: Column) -> Column:
    """Talk namespace of a namespace; NULL for special namespaces."""
    return F.when(ns_id < 0, F.lit(None)).when(ns_id % 2 == 0, ns_id + 1).otherwise(ns_id)


def database_title(namespace: Column, ns_id: Column, pagename: Column, expected: Column) -> Column:
    """Bare name if the namespace is the expected one (or none is expected), else prefixed."""
    return F.when(expected.isNull() | (ns_id == expected), pagename).otherwise(prefixed(namespace, pagename))


def _normal_path(path: Column) -> Column:
    """Resolve ``.`` and ``..`` segments; ``..`` above the top is kept."""
    empty = F.array().cast("array<string>")

    def step(done: Column, part: Column) -> Column:
        climbs = (part == "..") & (F.size(done) > 0) & (F.try_element_at(done, F.lit(-1)) != "..")
        return (
            F.when(part.isin("", "."), done)
            .when(climbs, F.slice(done, F.lit(1), F.size(done) - 1))
            .otherwise(F.concat(done, F.array(part)))
        )

    return F.array_join(F.aggregate(F.split(path, "/"), empty, step), "/")


def absolute_link(
    iwprefix: Column, namespace: Column, pagename: Column, leading_colon: Column,
    base_namespace: Column, base_pagename: Column,
) -> Column:
    """Target of a possibly relative link as ``struct(namespace, pagename)``.

    ``#x`` stays on the page; ``/x`` and ``../x`` are resolved against it. Links
    with a prefix or a leading colon are absolute already.
    """
    prefixed_link = (iwprefix != "") | (namespace != "")
    relative = F.startswith(pagename, F.lit("/")) | F.startswith(pagename, F.lit("../"))
    joined = _normal_path(F.concat(base_pagename, F.lit("/./"), pagename))
    same = F.struct(base_namespace.alias("namespace"), base_pagename.alias("pagename"))
    as_is = F.struct(namespace.alias("namespace"), pagename.alias("pagename"))
    return (
        F.when(prefixed_link, as_is)
        .when(pagename == "", same)
        .when(leading_colon | ~relative, as_is)
        .otherwise(F.struct(base_namespace.alias("namespace"), joined.alias("pagename")))
    )
