"""List queries: one function per list, each returns one DataFrame.

Arguments are plain keyword arguments; a wrong one raises ``ValueError`` before
any plan is built. A table is joined only if a requested property or filter
needs it, so narrow requests read few columns and shuffle little. Results are
ordered, which is a distributed range sort; pass ``limit`` for a top-k instead.
"""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.functions.times import as_timestamp
from lorekeep.operators import common as c
from lorekeep.operators.common import Time
from lorekeep.sources.catalog import Catalog

RC_PROPS = {
    "user": ["rc_user_text"],
    "userid": ["rc_user"],
    "comment": ["rc_comment"],
    "flags": ["rc_minor", "rc_bot", "rc_new"],
    "timestamp": ["rc_timestamp"],
    "title": ["rc_namespace", "rc_title"],
    "ids": ["rc_id", "rc_cur_id", "rc_this_oldid", "rc_last_oldid"],
    "sizes": ["rc_old_len", "rc_new_len"],
    "patrolled": ["rc_patrolled"],
    "loginfo": ["rc_logid", "rc_log_type", "rc_log_action", "rc_params"],
    "sha1": [], "redirect": [], "tags": [],
}
RC_TYPES = {"edit", "new", "log", "external"}


def recent_changes(
    cat: Catalog, *, start: Time | None = None, end: Time | None = None, direction: str = "older",
    namespace=None, user: str | None = None, exclude_user: str | None = None, tag: str | None = None,
    prop: Collection[str] = ("title", "timestamp", "ids"), show: Collection[str] = (),
    types: Collection[str] = ("edit", "new", "log"), top_only: bool = False, limit: int | None = None,
) -> DataFrame:
    """Recent changes. ``show`` also accepts ``redirect``; ``anon`` means user 0 or unknown."""
    c.check_subset("prop", prop, RC_PROPS)
    c.check_subset("types", types, RC_TYPES)
    if user is not None and exclude_user is not None:
        raise ValueError("user and exclude_user exclude each other")
    df = cat["recentchanges"].where(F.col("rc_type").isin(c.as_set(set(types))))
    df = c.in_time_range(df, "rc_timestamp", direction, start, end)
    if namespace is not None:
        df = df.where(F.col("rc_namespace").isin(c.as_set(namespace)))
    if user is not None:
        df = df.where(F.col("rc_user_text") == user)
    if exclude_user is not None:
        df = df.where(F.col("rc_user_text") != exclude_user)
    if tag is not None:
        df = c.tagged_with(df, cat, "tagged_recentchange", "rc_id", tag)
    columns = ["rc_type", "rc_deleted", *[x for p in RC_PROPS if p in prop for x in RC_PROPS[p]]]
    on_redirect = {"redirect", "!redirect"} & set(show)
    if top_only or "redirect" in prop or on_redirect:
        page = cat["page"].select("page_namespace", "page_title", "page_is_redirect", "page_latest")
        same = (F.col("rc_namespace") == F.col("page_namespace")) & (F.col("rc_title") == F.col("page_title"))
        if top_only:
            df = df.join(page, same & (F.col("rc_this_oldid") == F.col("page_latest")))
        else:
            df = df.join(page, same, "left")
        if "redirect" in prop:
            columns.append("page_is_redirect")
    else:
        df = df.withColumn("page_is_redirect", F.lit(None).cast("boolean"))
    df = c.flag_filter(df, show, {
        "minor": F.col("rc_minor"), "bot": F.col("rc_bot"), "patrolled": F.col("rc_patrolled"),
        "anon": F.coalesce(F.col("rc_user"), F.lit(0)) == 0, "redirect": F.col("page_is_redirect"),
    })
    if "title" in prop:
        df = c.with_namespace(df, cat, "rc_namespace")
        columns.append("nss_name")
    if "sha1" in prop:
        # changes without a revision match nothing; dealt by their own ids they do not meet in one task
        none = F.when(F.col("rc_this_oldid").isNull(), F.xxhash64("rc_id")).otherwise(F.lit(0))
        there = F.when(F.col("rev_id").isNotNull(), F.lit(0).cast("long"))
        revision = cat["revision"].select("rev_id", "rev_sha1", there.alias("_there"))
        df = df.withColumn("_none", none)
        df = df.join(revision, (F.col("rc_this_oldid") == F.col("rev_id")) & (F.col("_none") == F.col("_there")), "left")
        columns.append("rev_sha1")
    if "tags" in prop:
        df = c.with_tags(df, cat, "tagged_recentchange", "rc_id")
        columns.append("tag_names")
    return c.ordered(df, ["rc_timestamp", "rc_id"], direction == "older", limit).select(*columns)


def shape_recent_changes(df: DataFrame) -> DataFrame:
    """Surface names of :func:`recent_changes` rows."""
    names = {
        "rc_id": "rcid", "rc_timestamp": "timestamp", "rc_user": "userid", "rc_user_text": "user",
        "rc_namespace": "ns", "rc_comment": "comment", "rc_cur_id": "pageid", "rc_this_oldid": "revid",
        "rc_last_oldid": "old_revid", "rc_type": "type", "rc_old_len": "oldlen", "rc_new_len": "newlen",
        "rc_logid": "logid", "rc_log_type": "logtype", "rc_log_action": "logaction",
        "rc_params": "logparams", "rev_sha1": "sha1", "tag_names": "tags",
    }
    flags = {
        "rc_minor": "minor", "rc_bot": "bot", "rc_new": "new", "rc_patrolled": "patrolled",
        "page_is_redirect": "redirect",
    }
    out = c.shaped(df, names, {"rc_user", "rc_cur_id", "rc_this_oldid", "rc_last_oldid"}, flags)
    out += c.shaped_title(df, "rc_title")
    if "rc_user" in df.columns:
        out.append(c.mark(F.coalesce("rc_user", F.lit(0)) == 0).alias("anon"))
    out += c.hidden_marks(F.col("rc_deleted"), F.col("rc_type") == "log")
    return df.select(*out)


LOG_PROPS = {
    "user": ["log_user_text"],
    "userid": ["log_user"],
    "comment": ["log_comment"],
    "timestamp": ["log_timestamp"],
    "title": ["log_namespace", "log_title"],
    "ids": ["log_id", "log_page"],
    "type": ["log_type", "log_action"],
    "details": ["log_params"],
    "tags": [],
}


def log_events(
    cat: Catalog, *, start: Time | None = None, end: Time | None = None, direction: str = "older",
    user: str | None = None, title: str | None = None, namespace=None, tag: str | None = None,
    type: str | None = None, action: str | None = None,
    prop: Collection[str] = ("ids", "title", "type", "user", "timestamp", "comment", "details"),
    limit: int | None = None,
) -> DataFrame:
    """Log events. ``namespace=0`` selects the main namespace."""
    c.check_subset("prop", prop, LOG_PROPS)
    df = c.in_time_range(cat["logging"], "log_timestamp", direction, start, end)
    for column, value in (("log_user_text", user), ("log_title", title), ("log_type", type), ("log_action", action)):
        if value is not None:
            df = df.where(F.col(column) == value)
    if namespace is not None:
        df = df.where(F.col("log_namespace").isin(c.as_set(namespace)))
    if tag is not None:
        df = c.tagged_with(df, cat, "tagged_logevent", "log_id", tag)
    columns = ["log_deleted", *[x for p in LOG_PROPS if p in prop for x in LOG_PROPS[p]]]
    if "title" in prop:
        page = cat["page"].select("page_id", "page_namespace", "page_title")
        df = c.with_namespace(df, cat, "log_namespace").join(
            page, (F.col("log_namespace") == F.col("page_namespace")) & (F.col("log_title") == F.col("page_title")),
            "left",
        )
        columns += ["nss_name", "page_id"]
    if "user" in prop:
        users = cat["users"].select("user_id", "user_name")
        df = df.join(users, F.col("log_user") == F.col("user_id"), "left")
        columns.append("user_name")
    if "tags" in prop:
        df = c.with_tags(df, cat, "tagged_logevent", "log_id")
        columns.append("tag_names")
    return c.ordered(df, ["log_timestamp", "log_id"], direction == "older", limit).select(*columns)


def shape_log_events(df: DataFrame) -> DataFrame:
    names = {
        "log_id": "logid", "log_type": "type", "log_action": "action", "log_timestamp": "timestamp",
        "log_user": "userid", "log_namespace": "ns", "log_page": "logpage", "log_comment": "comment",
        "log_params": "params", "page_id": "pageid", "tag_names": "tags",
    }
    out = c.shaped(df, names, {"log_user", "log_page", "page_id"}, {}) + c.shaped_title(df, "log_title")
    if "log_user_text" in df.columns:
        # the current name of the user, if the account still exists
        current = F.col("user_name") if "user_name" in df.columns else F.lit(None)
        out.append(F.coalesce(F.nullif(current, F.lit("")), F.col("log_user_text")).alias("user"))
    if "log_user" in df.columns:
        out.append(c.mark(F.coalesce("log_user", F.lit(0)) == 0).alias("anon"))
    out += c.hidden_marks(F.col("log_deleted"), F.lit(True))[1:]
    return df.select(*out)


def all_pages(
    cat: Catalog, *, start: str | None = None, end: str | None = None, prefix: str | None = None,
    direction: str = "ascending", namespace: int = 0, redirects: str = "all",
    min_size: int | None = None, max_size: int | None = None, pr_type: Collection[str] | None = None,
    pr_level: Collection[str] | None = None, pr_expiry: str = "all", pr_cascade: str = "all",
    now: Time | None = None, limit: int | None = None,
) -> DataFrame:
    """Pages of one namespace by title. ``prefix`` and the size limits are applied;
    any protection filter requires a protection that has not ended at ``now``."""
    c.check_choice("redirects", redirects, {"all", "redirects", "nonredirects"})
    c.check_choice("pr_expiry", pr_expiry, {"all", "definite", "indefinite"})
    c.check_choice("pr_cascade", pr_cascade, {"all", "cascading", "noncascading"})
    if pr_type is not None:
        c.check_subset("pr_type", pr_type, {"edit", "move", "upload"})
    if pr_level is not None:
        if pr_type is None:
            raise ValueError("pr_level needs pr_type")
        c.check_subset("pr_level", pr_level, {"autoconfirmed", "sysop"})
    df = cat["page"].where(F.col("page_namespace") == namespace)
    df = c.in_title_range(df, "page_title", direction, start, end)
    if prefix is not None:
        df = df.where(F.startswith("page_title", F.lit(prefix)))
    if redirects != "all":
        df = df.where(F.col("page_is_redirect") == (redirects == "redirects"))
    if min_size is not None:
        df = df.where(F.col("page_len") >= min_size)
    if max_size is not None:
        df = df.where(F.col("page_len") <= max_size)
    if pr_type is not None or pr_expiry != "all":
        active = cat["page_restrictions"]
        active = active.where(c.not_expired(F.col("pr_expiry"), now) if now is not None else F.coalesce(
            F.col("pr_expiry"), F.lit("9999-12-31").cast("timestamp_ntz")) > F.localtimestamp())
        if pr_type is not None:
            active = active.where(F.col("pr_type").isin(c.as_set(set(pr_type))))
            if pr_level is not None:
                active = active.where(F.col("pr_level").isin(c.as_set(set(pr_level))))
            if pr_cascade != "all":
                active = active.where(F.col("pr_cascade") == (pr_cascade == "cascading"))
        if pr_expiry != "all":
            forever = c.is_indefinite(F.col("pr_expiry"))
            active = active.where(forever if pr_expiry == "indefinite" else ~forever)
        # semi join: a page with two matching protections is listed once
        df = df.join(active, F.col("page_id") == F.col("pr_page"), "left_semi")
    df = c.with_namespace(df, cat, "page_namespace")
    return c.ordered(df, ["page_title"], direction == "descending", limit).select(
        "page_id", "page_namespace", "page_title", "nss_name"
    )


def shape_pages(df: DataFrame) -> DataFrame:
    return df.select(
        F.col("page_id").alias("pageid"), F.col("page_namespace").alias("ns"), *c.shaped_title(df, "page_title")
    )


PT_PROPS = {
    "timestamp": ["log_timestamp"], "user": ["log_user_text", "log_user"], "userid": ["log_user"],
    "comment": ["log_comment"], "expiry": ["pt_expiry"], "level": ["pt_level"],
}


def latest_protections(cat: Catalog) -> DataFrame:
    """The newest protection event per title, by event id."""
    log = cat["logging"].where("log_type = 'protect' and log_action = 'protect'")
    facts = F.struct("log_timestamp", "log_user", "log_user_text", "log_comment")
    return (
        log.groupBy("log_namespace", "log_title")
        .agg(F.max("log_id").alias("pt_log_id"), F.max_by(facts, "log_id").alias("_log"))
        .select("log_namespace", "log_title", "pt_log_id", "_log.*")
    )


def protected_titles(
    cat: Catalog, *, start: Time | None = None, end: Time | None = None, direction: str = "older",
    namespace=None, level: Collection[str] | None = None,
    prop: Collection[str] = ("timestamp", "level"), limit: int | None = None,
) -> DataFrame:
    """Titles protected against creation, with the newest protection event.

    The namespace filter uses the title's own namespace, so titles without an
    event are kept. The event is found by aggregating the log once instead of
    joining the log to itself.
    """
    c.check_subset("prop", prop, PT_PROPS)
    if level is not None:
        c.check_subset("level", level, {"autoconfirmed", "sysop"})
    titles = cat["protected_titles"]
    if namespace is not None:
        titles = titles.where(F.col("pt_namespace").isin(c.as_set(namespace)))
    if level is not None:
        titles = titles.where(F.col("pt_level").isin(c.as_set(set(level))))
    df = titles.join(
        latest_protections(cat),
        (F.col("pt_namespace") == F.col("log_namespace")) & (F.col("pt_title") == F.col("log_title")), "left",
    )
    df = c.in_time_range(df, "log_timestamp", direction, start, end)
    df = c.with_namespace(df, cat, "pt_namespace")
    columns = ["pt_namespace", "pt_title", "nss_name"]
    columns += list(dict.fromkeys(x for p in PT_PROPS if p in prop for x in PT_PROPS[p]))
    return c.ordered(
        df, ["log_timestamp", "pt_namespace", "pt_title"], direction == "older", limit
    ).select(*columns)


def shape_protected_titles(df: DataFrame) -> DataFrame:
    names = {
        "pt_namespace": "ns", "log_timestamp": "timestamp", "log_user_text": "user", "log_user": "userid",
        "log_comment": "comment", "pt_expiry": "expiry", "pt_level": "level",
    }
    return df.select(*c.shaped(df, names, set(), {}), *c.shaped_title(df, "pt_title"))


# requested property -> stored columns, without the rev_ / ar_ prefix
REVISION_PROPS = {
    "ids": ["id", "parent_id"], "flags": ["minor_edit"], "timestamp": ["timestamp"], "user": ["user_text"],
    "userid": ["user"], "size": ["len"], "sha1": ["sha1"], "contentmodel": ["content_model", "content_format"],
    "comment": ["comment"], "content": ["content_model", "content_format"], "tags": [],
}


def revision_columns(prop: Collection[str], prefix: str = "rev_") -> list[str]:
    """Stored columns of a property set; archived rows keep their revision id as ``ar_rev_id``."""
    c.check_subset("prop", prop, REVISION_PROPS)
    names = [x for p in REVISION_PROPS if p in prop for x in REVISION_PROPS[p]]
    names = ["rev_id" if prefix == "ar_" and x == "id" else x for x in names]
    return list(dict.fromkeys(prefix + x for x in ["deleted", *names]))


def filter_revisions(
    df: DataFrame, prefix: str, direction: str, start, end, user: str | None, exclude_user: str | None
) -> DataFrame:
    if user is not None and exclude_user is not None:
        raise ValueError("user and exclude_user exclude each other")
    df = c.in_time_range(df, prefix + "timestamp", direction, start, end)
    if user is not None:
        df = df.where(F.col(prefix + "user_text") == user)
    if exclude_user is not None:
        df = df.where(F.col(prefix + "user_text") != exclude_user)
    return df


def with_content(df: DataFrame, cat: Catalog, text_id: str) -> DataFrame:
    return df.join(cat["texts"], F.col(text_id) == F.col("old_id"), "left").drop("old_id")


def all_revisions(
    cat: Catalog, *, start: Time | None = None, end: Time | None = None, direction: str = "newer",
    namespace=None, user: str | None = None, exclude_user: str | None = None,
    prop: Collection[str] = ("ids", "timestamp", "flags", "comment", "user"), limit: int | None = None,
) -> DataFrame:
    """Revisions of existing pages with the page's title."""
    columns = revision_columns(prop)
    df = filter_revisions(cat["revision"], "rev_", direction, start, end, user, exclude_user)
    page = cat["page"].select("page_id", "page_namespace", "page_title")
    if namespace is not None:
        page = page.where(F.col("page_namespace").isin(c.as_set(namespace)))
    df = df.join(page, F.col("rev_page") == F.col("page_id"))
    df = c.with_namespace(df, cat, "page_namespace")
    columns += ["page_id", "page_namespace", "page_title", "nss_name"]
    if "content" in prop:
        df = with_content(df, cat, "rev_text_id")
        columns.append("old_text")
    if "tags" in prop:
        df = c.with_tags(df, cat, "tagged_revision", "rev_id")
        columns.append("tag_names")
    return c.ordered(df, ["rev_timestamp", "rev_id"], direction == "older", limit).select(*columns)


def all_deleted_revisions(
    cat: Catalog, *, start: Time | None = None, end: Time | None = None, direction: str = "newer",
    namespace=None, user: str | None = None, exclude_user: str | None = None, tag: str | None = None,
    title_from: str | None = None, title_to: str | None = None,
    prop: Collection[str] = ("ids", "timestamp", "flags", "comment", "user"), limit: int | None = None,
) -> DataFrame:
    """Deleted revisions. ``page_id`` is that of a page which has the title today."""
    columns = revision_columns(prop, "ar_")
    df = filter_revisions(cat["archive"], "ar_", direction, start, end, user, exclude_user)
    df = c.in_title_range(df, "ar_title", "ascending", title_from, title_to)
    if namespace is not None:
        df = df.where(F.col("ar_namespace").isin(c.as_set(namespace)))
    if tag is not None:
        df = c.tagged_with(df, cat, "tagged_archived_revision", "ar_rev_id", tag)
    page = cat["page"].select("page_id", "page_namespace", "page_title")
    df = df.join(
        page, (F.col("ar_namespace") == F.col("page_namespace")) & (F.col("ar_title") == F.col("page_title")), "left"
    )
    df = c.with_namespace(df, cat, "ar_namespace")
    columns += ["ar_namespace", "ar_title", "page_id", "nss_name"]
    if "content" in prop:
        df = with_content(df, cat, "ar_text_id")
        columns.append("old_text")
    if "tags" in prop:
        df = c.with_tags(df, cat, "tagged_archived_revision", "ar_rev_id")
        columns.append("tag_names")
    return c.ordered(df, ["ar_timestamp", "ar_rev_id"], direction == "older", limit).select(*columns)


def shape_revisions(df: DataFrame, prefix: str = "rev_") -> DataFrame:
    """Surface names of live (``rev_``) or deleted (``ar_``) revisions; content goes to slots."""
    rev_id = "ar_rev_id" if prefix == "ar_" else "rev_id"
    names = {
        rev_id: "revid", prefix + "parent_id": "parentid", prefix + "timestamp": "timestamp",
        prefix + "user": "userid", prefix + "user_text": "user", prefix + "comment": "comment",
        prefix + "sha1": "sha1", prefix + "len": "size", "page_id": "pageid",
        "page_namespace": "ns", "ar_namespace": "ns", "tag_names": "tags",
    }
    zeroable = {prefix + "user", prefix + "parent_id", "page_id"}
    out = c.shaped(df, names, zeroable, {prefix + "minor_edit": "minor"})
    out += c.shaped_title(df, "ar_title" if prefix == "ar_" else "page_title")
    if prefix + "user" in df.columns:
        out.append(c.mark(F.coalesce(prefix + "user", F.lit(0)) == 0).alias("anon"))
    slot = [
        F.col(column).alias(name)
        for column, name in (
            (prefix + "content_model", "contentmodel"), (prefix + "content_format", "contentformat"),
            ("old_text", "*"),
        )
        if column in df.columns
    ]
    if slot:
        out.append(F.struct(F.struct(*slot).alias("main")).alias("slots"))
    marks = c.hidden_marks(F.col(prefix + "deleted"))
    return df.select(*out, marks[0], *marks[2:])


# fixed values: groups every named user belongs to
IMPLICIT_GROUPS = ["*", "user"]


def all_users(
    cat: Catalog, *, start: str | None = None, end: str | None = None, direction: str = "ascending",
    group: str | None = None, exclude_group: str | None = None, with_edits_only: bool = False,
    prop: Collection[str] = (), limit: int | None = None,
) -> DataFrame:
    """Named users. Group filters apply to the whole set of a user's explicit groups."""
    c.check_subset("prop", prop, {"blockinfo", "groups", "editcount", "registration"})
    if group is not None and exclude_group is not None:
        raise ValueError("group and exclude_group exclude each other")
    df = c.in_title_range(cat["users"].where("user_id > 0"), "user_name", direction, start, end)
    if with_edits_only:
        df = df.where("user_editcount > 0")
    columns = ["user_id", "user_name"]
    if "editcount" in prop:
        columns.append("user_editcount")
    if "registration" in prop:
        columns.append("user_registration")
    if "blockinfo" in prop:
        blocks = cat["ipblocks"].select(
            "ipb_user", "ipb_by", "ipb_by_text", "ipb_timestamp", "ipb_expiry", "ipb_id", "ipb_reason",
            "ipb_create_account", "ipb_deleted",
        )
        df = df.join(blocks, F.col("user_id") == F.col("ipb_user"), "left")
        columns += [x for x in blocks.columns if x != "ipb_user"]
    if "groups" in prop or group is not None or exclude_group is not None:
        groups = user_group_sets(cat)
        df = df.join(groups, F.col("user_id") == F.col("ug_user"), "left")
        explicit = F.coalesce("user_groups", F.array().cast("array<string>"))
        if group is not None:
            df = df.where(F.array_contains(explicit, group))
        if exclude_group is not None:
            df = df.where(~F.array_contains(explicit, exclude_group))
        if "groups" in prop:
            df = df.withColumn("user_groups", F.concat(explicit, F.array(*map(F.lit, IMPLICIT_GROUPS))))
            columns.append("user_groups")
    return c.ordered(df, ["user_name"], direction == "descending", limit).select(*columns)


def user_group_sets(cat: Catalog) -> DataFrame:
    """Explicit groups per user, sorted; at most as many as the site has groups."""
    return cat["user_groups"].groupBy("ug_user").agg(F.sort_array(F.collect_set("ug_group")).alias("user_groups"))


def shape_users(df: DataFrame) -> DataFrame:
    names = {
        "user_id": "userid", "user_name": "name", "user_editcount": "editcount", "user_groups": "groups",
        "ipb_id": "blockid", "ipb_by": "blockedbyid", "ipb_by_text": "blockedby",
        "ipb_timestamp": "blockedtimestamp", "ipb_expiry": "blockexpiry", "ipb_reason": "blockreason",
    }
    flags = {"ipb_create_account": "blocknocreate", "ipb_deleted": "hidden"}
    out = c.shaped(df, names, {"user_editcount"}, flags)
    if "user_registration" in df.columns:
        out.append(F.coalesce(F.col("user_registration").cast("string"), F.lit("")).alias("registration"))
    return df.select(*out)


def change_time_bounds(cat: Catalog) -> DataFrame:
    """Oldest and newest recent change."""
    return cat["recentchanges"].agg(
        F.min("rc_timestamp").alias("oldest"), F.max("rc_timestamp").alias("newest")
    )


def namespaces(cat: Catalog) -> DataFrame:
    """Namespaces with their local ("star") and canonical names."""
    star, canon = cat["namespace_starname"], cat["namespace_canonical"]
    return (
        cat["namespace"]
        .join(star, F.col("ns_id") == F.col("nss_id"), "left")
        .join(canon, F.col("ns_id") == F.col("nsc_id"), "left")
        .select("ns_id", "ns_case", "ns_content", "ns_subpages", "nss_name", "nsc_name")
    )


def namespace_ids(cat: Catalog) -> DataFrame:
    """Every name of a namespace (local, canonical, alias) with its id."""
    return cat["namespace_name"].select("nsn_name", "nsn_id")


def interwiki_map(cat: Catalog, local_only: bool = False) -> DataFrame:
    df = cat["interwiki"]
    return df.where("iw_local") if local_only else df


def interwiki_redirects(cat: Catalog) -> DataFrame:
    """Redirects to other wikis: source title and ``prefix:title#fragment``."""
    redirect = cat["redirect"].where("rd_interwiki is not null")
    df = c.with_namespace(cat["page"].join(redirect, F.col("page_id") == F.col("rd_from")), cat, "page_namespace")
    fragment = F.when(
        F.coalesce("rd_fragment", F.lit("")) != "", F.concat(F.lit("#"), F.col("rd_fragment"))
    ).otherwise("")
    return df.select(
        c.prefixed(F.col("nss_name"), F.col("page_title")).alias("source"),
        F.concat(F.col("rd_interwiki"), F.lit(":"), F.col("rd_title"), fragment).alias("target"),
    )


def last_revision_id(cat: Catalog) -> DataFrame:
    changes = cat["recentchanges"].where("rc_type in ('edit', 'new')")
    return changes.agg(F.max("rc_this_oldid").alias("last_rev_id"))


def category_members(cat: Catalog, category: str, *, content: bool = False) -> DataFrame:
    """Pages of a category, with their current text on request."""
    links = cat["categorylinks"].where(F.col("cl_to") == category).select("cl_from", "cl_type")
    df = c.with_namespace(cat["page"].join(links, F.col("page_id") == F.col("cl_from")), cat, "page_namespace")
    columns = ["page_id", "page_namespace", "page_title", "nss_name", "cl_type"]
    if content:
        revision = cat["revision"].select("rev_id", "rev_text_id")
        df = df.join(revision, F.col("page_latest") == F.col("rev_id"), "left")
        df = with_content(df, cat, "rev_text_id")
        columns.append("old_text")
    return df.select(*columns)


def embedding_pages(
    cat: Catalog, namespace: int, title: str, *, namespaces=None, redirects: str = "all"
) -> DataFrame:
    """Pages that transclude one page."""
    c.check_choice("redirects", redirects, {"all", "redirects", "nonredirects"})
    links = cat["templatelinks"].where((F.col("tl_namespace") == namespace) & (F.col("tl_title") == title))
    df = cat["page"]
    if namespaces is not None:
        df = df.where(F.col("page_namespace").isin(c.as_set(namespaces)))
    if redirects != "all":
        df = df.where(F.col("page_is_redirect") == (redirects == "redirects"))
    return df.join(links, F.col("page_id") == F.col("tl_from"), "left_semi").select(
        "page_id", "page_namespace", "page_title", "page_is_redirect"
    )


def backlinks(cat: Catalog, namespace: int, title: str) -> DataFrame:
    """Pages that link to a page directly or through one of its redirects.

    ``via`` is the redirect's page id, or NULL for a direct link.
    """
    here = (F.col("rd_namespace") == namespace) & (F.col("rd_title") == title) & F.col("rd_interwiki").isNull()
    redirects = cat["redirect"].where(here).select("rd_from")
    page = cat["page"].select("page_id", "page_namespace", "page_title")
    sources = page.join(redirects, F.col("page_id") == F.col("rd_from"), "left_semi")
    links = cat["pagelinks"]
    through = links.join(
        sources, (F.col("pl_namespace") == F.col("page_namespace")) & (F.col("pl_title") == F.col("page_title"))
    ).select("pl_from", F.col("page_id").alias("via"))
    direct = links.where((F.col("pl_namespace") == namespace) & (F.col("pl_title") == title)).select(
        "pl_from", F.lit(None).cast("long").alias("via")
    )
    return direct.unionByName(through).join(page, F.col("pl_from") == F.col("page_id")).select(
        "page_id", "page_namespace", "page_title", "via"
    )


def last_contributions(cat: Catalog) -> DataFrame:
    """Time of each named user's last revision; the smallest timestamp when there is none."""
    last = cat["revision"].groupBy("rev_user").agg(F.max("rev_timestamp").alias("last"))
    df = cat["users"].where("user_id > 0").join(last, F.col("user_id") == F.col("rev_user"), "left")
    return df.select(
        "user_id", "user_name", F.coalesce("last", as_timestamp("0001-01-01 00:00:00")).alias("last_contribution")
    )


def change_tags(cat: Catalog, which: str = "all") -> DataFrame:
    """Change tags: all, active, manual, extension, or applicable (active and manual)."""
    c.check_choice("which", which, {"all", "active", "manual", "extension", "applicable"})
    df = cat["tag"]
    if which in ("active", "applicable"):
        df = df.where("tag_active")
    if which in ("manual", "applicable"):
        df = df.where(F.array_contains("tag_source", "manual"))
    if which == "extension":
        df = df.where(F.array_contains("tag_source", "extension"))
    return df.select("tag_id", "tag_name", "tag_displayname")


def pages_by_language_links(cat: Catalog, *, linked: bool, namespace: int = 0) -> DataFrame:
    """Pages that have (or lack) language links."""
    page = cat["page"].where(F.col("page_namespace") == namespace)
    how = "left_semi" if linked else "left_anti"
    return page.join(cat["langlinks"], F.col("page_id") == F.col("ll_from"), how).select(
        "page_id", "page_namespace", "page_title"
    )
