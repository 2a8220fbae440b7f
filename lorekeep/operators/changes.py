"""Change application: compute the next state of the mirror's tables.

Every function takes the current table(s) and the landed changes and returns the
new table(s) as DataFrames. Nothing is updated in place: a job writes the results
as a new snapshot (``sources.files.write_snapshot``) and then reads from there.
Events are ordered by ``log_id``, which is total, never by time.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Collection

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.functions.times import as_timestamp, parse_timestamp
from lorekeep.operators.common import Time, TAG_TABLES
from lorekeep.operators.graph import place_in_group
from lorekeep.operators.closure import Generations, chase
from lorekeep.session import cut_lineage
from lorekeep.sources.catalog import Catalog
from lorekeep.sources.schemas import (
    DELETED_ACTION, DELETED_COMMENT, DELETED_RESTRICTED, DELETED_TEXT, DELETED_USER,
)

# ---- generic upserts ----------------------------------------------------------------------


def last_rows(new: DataFrame, key: Collection[str], sequence: str | None = None) -> DataFrame:
    """One row per key: the last by ``sequence``; without one, or on ties, the largest row."""
    key = list(key)
    rest = [x for x in new.columns if x not in key]
    if not rest:
        return new.distinct()
    if len(rest) == 1 and sequence in (None, *rest):
        # the largest row is the largest value, NULL only if there is no other; numbers are hashed, not sorted
        return new.groupBy(*key).agg(F.max(rest[0]).alias(rest[0]))
    order = [F.col(x) for x in ([sequence] if sequence else [])] + [F.struct(*rest).alias("_row")]
    return new.groupBy(*key).agg(F.max(F.struct(*order)).alias("_last")).select(*key, "_last._row.*")


def upsert(
    old: DataFrame, new: DataFrame, key: Collection[str], overwrite: Collection[str] | None = None,
    sequence: str | None = None,
) -> DataFrame:
    """Insert new keys; for known keys overwrite the listed columns (default: all).

    One full outer join on the key. ``new`` may lack columns; they stay as they
    are, or NULL in inserted rows. A key that ``new`` repeats counts once, see
    :func:`last_rows`; ``sequence`` is a column of ``new`` that tells the order.
    """
    key = list(key)
    columns = [x for x in old.columns if x not in key]
    given = [x for x in columns if x in new.columns]
    new = last_rows(new, key, sequence)
    overwrite = given if overwrite is None else [x for x in given if x in set(overwrite)]
    left = old.select(*key, F.struct(*columns, F.lit(True).alias("_there")).alias("_old"))
    right = new.select(*key, F.struct(*given, F.lit(True).alias("_there")).alias("_new"))
    df = left.join(right, key, "full_outer")
    is_old, is_new = F.col("_old._there").isNotNull(), F.col("_new._there").isNotNull()
    out = []
    for x in old.columns:
        if x in key:
            out.append(F.col(x))
        elif x in overwrite:
            out.append(F.when(is_new, F.col("_new." + x)).otherwise(F.col("_old." + x)).alias(x))
        elif x in given:
            out.append(F.when(is_old, F.col("_old." + x)).otherwise(F.col("_new." + x)).alias(x))
        else:
            out.append(F.col("_old." + x).alias(x))
    return df.select(*out)


def insert_ignore(old: DataFrame, new: DataFrame, key: Collection[str]) -> DataFrame:
    """Insert rows whose key is not there yet; of repeated keys in ``new`` the smallest row."""
    key = list(key)
    rest = [x for x in new.columns if x not in key]
    one = new.groupBy(*key).agg(F.min(F.struct(*rest)).alias("_row")).select(*key, "_row.*") if rest else new.distinct()
    fresh = one.join(old.select(*key), key, "left_anti")
    return old.unionByName(fresh.select(*old.columns))


def update_column(old: DataFrame, key: str, changes: DataFrame, column: str, sequence: str | None = None) -> DataFrame:
    """Overwrite one column for the keys in ``changes`` (``key, <column>``); insert nothing.

    A key that ``changes`` repeats counts once, see :func:`last_rows`.
    """
    new = last_rows(changes, [key], sequence)
    new = new.select(F.col(key), F.col(column).alias("_value"), F.lit(True).alias("_hit"))
    value = F.when(F.col("_hit"), F.col("_value")).otherwise(F.col(column))
    return old.join(new, key, "left").withColumn(column, value).select(*old.columns)


def keep_only(old: DataFrame, touched: DataFrame, kept: DataFrame, key: str, item: str) -> DataFrame:
    """Within touched keys drop the items that are not kept; other keys stay whole."""
    inside = touched.select(key).distinct().withColumn("_touched", F.lit(True))
    keep = kept.select(key, item).distinct().withColumn("_kept", F.lit(True))
    df = old.join(inside, key, "left").join(keep, [key, item], "left")
    return df.where("_touched is null or _kept is not null").select(*old.columns)


def with_new_ids(df: DataFrame, column: str, existing: DataFrame) -> DataFrame:
    """Surrogate ids after the largest existing one, in a stable order of the rows."""
    top = existing.agg(F.coalesce(F.max(column), F.lit(0)).alias("top")).scalar()
    order = [F.col(x) for x in df.columns if x != column]
    numbered = place_in_group(df.drop(column).withColumn("_all", F.lit(1)), "_all", order, "_place")
    return numbered.withColumn(column, (top + F.col("_place")).cast("long")).drop("_all", "_place")


# ---- sync state ---------------------------------------------------------------------------


def sync_timestamp(sync: DataFrame, key: str) -> DataFrame:
    return sync.where(F.col("wss_key") == key).select("wss_timestamp")


def set_sync_timestamp(sync: DataFrame, key: str, when: Time) -> DataFrame:
    new = sync.sparkSession.createDataFrame([(key,)], "wss_key string").withColumn("wss_timestamp", as_timestamp(when))
    return upsert(sync, new, ["wss_key"])


def needs_update(stored: DataFrame, source: DataFrame, column: str = "rc_timestamp") -> DataFrame:
    """One row: does the source have something newer than the stored table?"""
    newest = stored.agg(F.max(column).alias("stored"))
    return source.agg(F.max(column).alias("newest")).select(
        F.coalesce(F.col("newest") > newest.scalar(), F.lit(True)).alias("needs_update")
    )


def feed_mode(feed: DataFrame, since: Time | None, column: str = "rc_timestamp") -> DataFrame:
    """``update`` if the feed reaches back to ``since``, else ``full``."""
    if since is None:
        return feed.agg(F.lit("full").alias("mode"))
    oldest = feed.agg(F.min(column).alias("oldest"))
    reaches = F.coalesce(F.col("oldest") <= as_timestamp(since), F.lit(False))
    return oldest.select(F.when(reaches, F.lit("update")).otherwise(F.lit("full")).alias("mode"))


def purge_older(df: DataFrame, column: str, source: DataFrame) -> DataFrame:
    """Drop rows older than the oldest row of the source feed."""
    return df.where(F.col(column) >= source.agg(F.min(column).alias("t")).scalar())


def purge_expired(df: DataFrame, column: str, now: Time) -> DataFrame:
    return df.where(F.col(column).isNull() | (F.col(column) >= as_timestamp(now)))


# ---- deletion bits ------------------------------------------------------------------------


def bits_from_marks(df: DataFrame) -> Column:
    """Bitmask of the hidden marks of landed records (absent means visible)."""
    marks = [
        ("sha1hidden", DELETED_TEXT), ("actionhidden", DELETED_ACTION), ("commenthidden", DELETED_COMMENT),
        ("userhidden", DELETED_USER), ("suppressed", DELETED_RESTRICTED),
    ]
    bits = F.lit(0)
    for name, bit in marks:
        if name in df.columns:
            bits = bits.bitwiseOR(F.when(F.col(name).isNotNull(), F.lit(bit)).otherwise(F.lit(0)))
    return bits


_BITS = "type string, ids array<long>, new struct<bitmask: int>"


def bitmask_changes(log: DataFrame, kind: str) -> DataFrame:
    """Last bitmask per id from visibility events; ``kind`` is ``revision`` or ``event``."""
    events = log.where((F.col("log_type") == "delete") & (F.col("log_action") == kind)).select(
        "log_id", F.from_json("log_params", _BITS).alias("p")
    )
    rows = events.select("log_id", F.explode("p.ids").alias("id"), F.col("p.new.bitmask").alias("bitmask"))
    return rows.groupBy("id").agg(F.max_by("bitmask", "log_id").alias("bitmask"))


def apply_bitmask(df: DataFrame, id_column: str, bits_column: str, changes: DataFrame) -> DataFrame:
    new = changes.select(F.col("id").alias(id_column), F.col("bitmask").alias(bits_column))
    return update_column(df, id_column, new, bits_column)


def apply_visibility(cat: Catalog, log: DataFrame) -> dict[str, DataFrame]:
    """Visibility events applied to revisions, archive, log and recent changes."""
    # the log is read once; the net changes are few and feed several tables
    revisions, events = cut_lineage(bitmask_changes(log, "revision")), cut_lineage(bitmask_changes(log, "event"))
    changes = apply_bitmask(cat["recentchanges"], "rc_this_oldid", "rc_deleted", revisions)
    return {
        "revision": apply_bitmask(cat["revision"], "rev_id", "rev_deleted", revisions),
        "archive": apply_bitmask(cat["archive"], "ar_rev_id", "ar_deleted", revisions),
        "logging": apply_bitmask(cat["logging"], "log_id", "log_deleted", events),
        "recentchanges": apply_bitmask(changes, "rc_logid", "rc_deleted", events),
    }


def suppress_pages(archive: DataFrame, log: DataFrame) -> DataFrame:
    """Set every bit on archived revisions of titles deleted with suppression."""
    titles = log.where("log_type = 'suppress' and log_action = 'delete'").select(
        F.col("log_namespace").alias("ar_namespace"), F.col("log_title").alias("ar_title"), F.lit(True).alias("_hit")
    ).distinct()
    every = DELETED_TEXT | DELETED_COMMENT | DELETED_USER | DELETED_RESTRICTED
    df = archive.join(titles, ["ar_namespace", "ar_title"], "left")
    bits = F.when(F.col("_hit"), F.lit(every)).otherwise(F.col("ar_deleted"))
    return df.withColumn("ar_deleted", bits).select(*archive.columns)


# ---- pages: delete, restore, merge, move --------------------------------------------------


def page_events(log: DataFrame) -> DataFrame:
    """Delete and restore events: ``log_namespace, log_title, log_id, action, log_page``."""
    deletes = (F.col("log_type").isin("delete") & F.col("log_action").isin("delete", "delete_redir")) | (
        (F.col("log_type") == "suppress") & (F.col("log_action") == "delete")
    )
    restores = (F.col("log_type") == "delete") & (F.col("log_action") == "restore")
    action = F.when(deletes, F.lit("deleted")).when(restores, F.lit("restored"))
    events = log.withColumn("action", action).where("action is not null")
    return events.select("log_namespace", "log_title", "log_id", "action", "log_page")


def page_actions(log: DataFrame) -> DataFrame:
    """Last action per title: ``deleted`` or ``restored``, with the page id of that event."""
    return page_events(log).groupBy("log_namespace", "log_title").agg(
        F.max_by(F.struct("action", "log_page"), "log_id").alias("x")
    ).select("log_namespace", "log_title", "x.*")


def classify_pages(log: DataFrame) -> DataFrame:
    """Per page id: was it deleted, moved or otherwise modified by the events?"""
    removed = F.col("log_action").isin("delete", "delete_redir") & F.col("log_type").isin("delete", "suppress")
    relevant = F.col("log_type").isin("delete", "protect", "move", "import") | (
        (F.col("log_type") == "suppress") & (F.col("log_action") == "delete")
    )
    events = log.where(relevant & F.col("log_page").isNotNull())
    return events.groupBy(F.col("log_page").alias("page_id")).agg(
        F.bool_or(removed).alias("deleted"), F.bool_or(~removed).alias("modified"),
        F.bool_or(F.col("log_action").isin("move", "move_redir")).alias("moved"),
    )


ARCHIVE_OF = {
    "ar_rev_id": "rev_id", "ar_page_id": "rev_page", "ar_text_id": "rev_text_id", "ar_comment": "rev_comment",
    "ar_user": "rev_user", "ar_user_text": "rev_user_text", "ar_timestamp": "rev_timestamp",
    "ar_minor_edit": "rev_minor_edit", "ar_deleted": "rev_deleted", "ar_len": "rev_len",
    "ar_parent_id": "rev_parent_id", "ar_sha1": "rev_sha1", "ar_content_model": "rev_content_model",
    "ar_content_format": "rev_content_format",
}

# tables whose rows go away with their page
CASCADES = {
    "page_props": "pp_page", "page_restrictions": "pr_page", "pagelinks": "pl_from", "templatelinks": "tl_from",
    "imagelinks": "il_from", "categorylinks": "cl_from", "langlinks": "ll_from", "iwlinks": "iwl_from",
    "externallinks": "el_from", "redirect": "rd_from", "section": "sec_page",
    "ws_parser_cache_sync": "wspc_page_id",
}


def _split(df: DataFrame, keys: DataFrame, column: str, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows that stay, rows whose key is listed)."""
    on = F.col(column) == F.col(key)
    return df.join(keys, on, "left_anti"), df.join(keys, on, "left_semi")


def delete_pages(cat: Catalog, page_ids: DataFrame) -> dict[str, DataFrame]:
    """Delete pages (``page_id``): revisions and tags move to the archive, the rest cascades."""
    gone = cut_lineage(page_ids.select(F.col("page_id").alias("_gone")).distinct())
    stay, leave = _split(cat["revision"], gone, "rev_page", "_gone")
    titles = cat["page"].select("page_id", "page_namespace", "page_title")
    moved = leave.join(titles, F.col("rev_page") == F.col("page_id")).select(
        F.col("page_namespace").alias("ar_namespace"), F.col("page_title").alias("ar_title"),
        *[F.col(b).alias(a) for a, b in ARCHIVE_OF.items()],
    )
    archive = cat["archive"]
    moved = with_new_ids(moved, "ar_id", archive)
    out = {
        "revision": stay,
        "archive": archive.unionByName(moved.select(*archive.columns)),
        "page": _split(cat["page"], gone, "page_id", "_gone")[0],
    }
    ids = leave.select(F.col("rev_id").alias("_rev"))
    kept, tags = _split(cat["tagged_revision"], ids, "tgrev_rev_id", "_rev")
    out["tagged_revision"] = kept
    out["tagged_archived_revision"] = cat["tagged_archived_revision"].unionByName(
        tags.select(F.col("tgrev_tag_id").alias("tgar_tag_id"), F.col("tgrev_rev_id").alias("tgar_rev_id"))
    ).distinct()
    for table, column in CASCADES.items():
        out[table] = _split(cat[table], gone, column, "_gone")[0]
    return out


def restore_pages(cat: Catalog, titles: DataFrame) -> dict[str, DataFrame]:
    """Restore titles (``log_namespace, log_title, log_page``): archive and tags move back.

    The restored page id is that of the event. Titles are compared as stored,
    without the namespace prefix.
    """
    wanted = titles.where("log_page is not null").select(
        F.col("log_namespace").alias("ar_namespace"), F.col("log_title").alias("ar_title"), "log_page"
    )
    archive = cat["archive"]
    rows = archive.join(wanted, ["ar_namespace", "ar_title"])
    back = rows.select(
        F.col("log_page").alias("rev_page"),
        *[F.col(a).alias(b) for a, b in ARCHIVE_OF.items() if b != "rev_page"],
    )
    revision = cat["revision"]
    ids = back.select(F.col("rev_id").alias("_rev"))
    kept, tags = _split(cat["tagged_archived_revision"], ids, "tgar_rev_id", "_rev")
    return {
        "archive": archive.join(wanted, ["ar_namespace", "ar_title"], "left_anti").select(*archive.columns),
        "revision": revision.unionByName(back.select(*revision.columns)),
        "tagged_archived_revision": kept,
        "tagged_revision": cat["tagged_revision"].unionByName(
            tags.select(F.col("tgar_tag_id").alias("tgrev_tag_id"), F.col("tgar_rev_id").alias("tgrev_rev_id"))
        ).distinct(),
    }


def merges(cat: Catalog, log: DataFrame) -> DataFrame:
    """History merges: event, source page, target page, merge point; ``rejected`` if the source moved.

    The target is known by title only, so a merge into an unknown title is rejected
    as well. A page may be the source of several merges.
    """
    shape = "dest_ns int, dest_title string, mergepoint string"
    events = log.where("log_type = 'merge' and log_page is not null").select(
        "log_id", "log_page", F.from_json("log_params", shape).alias("p")
    )
    moved = log.where("log_type = 'move'").select(F.col("log_page").alias("_moved")).distinct()
    page = cat["page"].select(F.col("page_id").alias("dest_page"), "page_namespace", "page_title")
    df = events.join(
        page, (F.col("p.dest_ns") == F.col("page_namespace")) & (F.col("p.dest_title") == F.col("page_title")), "left"
    ).join(moved, F.col("log_page") == F.col("_moved"), "left")
    return df.select(
        "log_id", F.col("log_page").alias("src_page"), "dest_page", parse_timestamp(F.col("p.mergepoint")).alias("mergepoint"),
        (F.col("_moved").isNotNull() | F.col("dest_page").isNull()).alias("rejected"),
    )


def _following(events: DataFrame, page: str) -> DataFrame:
    """``log_id, next``: the first merge out of ``page`` after the event."""
    spots = events.select(F.col("src_page").alias("_page"), F.col("log_id").alias("_at"), F.col("log_id").alias("_merge"))
    if page != "src_page":
        spots = spots.unionByName(events.select(F.col(page).alias("_page"), F.col("log_id").alias("_at"), F.lit(None).alias("_merge")))
    # from the last event back, so that the frame only grows
    later = Window.partitionBy("_page").orderBy(F.desc("_at")).rowsBetween(Window.unboundedPreceding, -1)
    spots = spots.withColumn("next", F.last("_merge", ignorenulls=True).over(later))
    own = F.col("_merge").isNotNull() if page == "src_page" else F.col("_merge").isNull()
    return spots.where(own).select(F.col("_at").alias("log_id"), "next")


def merge_ways(planned: DataFrame) -> DataFrame:
    """Where revisions end that meet a merge: ``log_id, lo, hi, page`` for times in (lo, hi].

    A merge sends what is not after its merge point to the target, where the next
    merge out of that page waits, and the rest to the next merge out of its own
    page. The two steps of every merge are composed by doubling: times intersect,
    and a chain of merges takes as many rounds as its logarithm.
    """
    events = planned.where("not rejected and mergepoint is not null and src_page <> dest_page").select(
        "log_id", "src_page", "dest_page", "mergepoint"
    )
    events = cut_lineage(events)
    never = F.lit(None).cast(events.schema["mergepoint"].dataType)
    taken = events.join(_following(events, "dest_page"), "log_id").select(
        "log_id", never.alias("lo"), F.col("mergepoint").alias("hi"), F.col("next").alias("to"), F.col("dest_page").alias("page")
    )
    passed = events.join(_following(events, "src_page"), "log_id").select(
        "log_id", F.col("mergepoint").alias("lo"), never.alias("hi"), F.col("next").alias("to"), F.col("src_page").alias("page")
    )
    ways = Generations(events.sparkSession, "open")
    fresh = ways.append(taken.unionByName(passed).withColumn("open", F.col("to").isNotNull()))
    while not fresh.where("open").isEmpty():
        onward = ways.closed().unionByName(ways.open()).select(
            F.col("log_id").alias("to"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"), F.col("to").alias("_to"),
            F.col("page").alias("_page"), F.col("open").alias("_open"),
        )
        # no bound is NULL, which the greater and the smaller of two leave out
        both = ways.open().join(onward, "to").select(
            "log_id", F.greatest("lo", "_lo").alias("lo"), F.least("hi", "_hi").alias("hi"), F.col("_to").alias("to"),
            F.col("_page").alias("page"), F.col("_open").alias("open"),
        )
        fresh = ways.append(both.where("lo is null or hi is null or lo < hi"))
    return ways.closed().select("log_id", "lo", "hi", "page")


def apply_merges(revision: DataFrame, planned: DataFrame) -> DataFrame:
    """Move revisions up to the merge point to the target page, merge after merge in log order.

    A revision goes with the first merge out of its page whose merge point is not
    before it, and from there with later merges out of the page it has come to.
    """
    first = planned.where("not rejected and mergepoint is not null and src_page <> dest_page").groupBy(
        F.col("src_page").alias("_from")
    ).agg(F.min("log_id").alias("log_id"))
    ways = merge_ways(planned).join(first, "log_id").where("page <> _from").select("_from", "lo", "hi", F.col("page").alias("_to"))
    time = F.col("rev_timestamp")
    on = (F.col("rev_page") == F.col("_from")) & (F.col("lo").isNull() | (time > F.col("lo"))) & time.isNotNull() & (
        F.col("hi").isNull() | (time <= F.col("hi"))
    )
    df = revision.join(ways, on, "left")
    return df.withColumn("rev_page", F.coalesce("_to", "rev_page")).select(*revision.columns)


def apply_moves(page: DataFrame, log: DataFrame) -> DataFrame:
    """Replay page moves: the last one per page id decides its name."""
    shape = "target_ns int, target_title string"
    last = log.where(
        "log_type = 'move' and log_action in ('move', 'move_redir') and log_page is not null"
    ).groupBy(F.col("log_page").alias("page_id")).agg(F.max_by("log_params", "log_id").alias("params"))
    last = last.select("page_id", F.from_json("params", shape).alias("p"))
    df = page.join(last, "page_id", "left")
    df = df.withColumn("page_namespace", F.coalesce("p.target_ns", "page_namespace"))
    return df.withColumn("page_title", F.coalesce("p.target_title", "page_title")).select(*page.columns)


def drop_changes_of_missing_pages(changes: DataFrame, page: DataFrame) -> DataFrame:
    """Recent changes of pages that are gone, except log entries."""
    logs = changes.where("rc_logid is not null")
    edits = changes.where("rc_logid is null")
    return logs.unionByName(
        edits.join(page.select(F.col("page_id").alias("rc_cur_id")), "rc_cur_id", "left_semi").select(*changes.columns)
    )


# ---- users --------------------------------------------------------------------------------


def final_targets(steps: DataFrame) -> DataFrame:
    """Follow replacements ``src, dst, seq`` in order: ``src, dst`` after the last one.

    A step applies to whatever carries its source at that moment, so only later
    steps continue a chain.
    """
    events = steps.select(F.col("src").alias("_key"), "seq", F.col("seq").alias("_own"))
    events = events.unionByName(steps.select(F.col("dst").alias("_key"), "seq", F.lit(None).alias("_own")))
    # from the last event back; a step from a name to itself is not its own successor
    later = Window.partitionBy("_key").orderBy(F.desc("seq")).rangeBetween(Window.unboundedPreceding, -1)
    following = events.withColumn("next", F.last("_own", ignorenulls=True).over(later)).where("_own is null").select("seq", "next")
    found = chase(steps.join(following, "seq").select("seq", "next", "dst"), ["seq"], ["next"])
    first = steps.groupBy("src").agg(F.min("seq").alias("seq"))
    return first.join(found, "seq").select("src", "dst")


def renames(log: DataFrame) -> DataFrame:
    """``old_name, new_name`` after all rename events, in order."""
    events = log.where("log_type = 'renameuser'").select(
        F.from_json("log_params", "olduser string, newuser string").alias("p"), F.col("log_id").alias("seq")
    )
    steps = events.select(F.col("p.olduser").alias("src"), F.col("p.newuser").alias("dst"), "seq")
    return final_targets(steps).select(F.col("src").alias("old_name"), F.col("dst").alias("new_name"))


RENAMED_COLUMNS = {
    "users": "user_name", "logging": "log_user_text", "ipblocks": "ipb_by_text", "archive": "ar_user_text",
    "revision": "rev_user_text",
}


def rename_in(df: DataFrame, column: str, mapping: DataFrame) -> DataFrame:
    """Replace old names by new ones; Spark broadcasts the mapping while it is small."""
    names = mapping.select(F.col("old_name").alias(column), "new_name")
    out = df.join(names, column, "left")
    return out.withColumn(column, F.coalesce("new_name", column)).select(*df.columns)


def apply_renames(cat: Catalog, log: DataFrame) -> dict[str, DataFrame]:
    mapping = renames(log)
    return {table: rename_in(cat[table], column, mapping) for table, column in RENAMED_COLUMNS.items()}


MERGED_COLUMNS = {
    "logging": ("log_user", "log_user_text"), "ipblocks": ("ipb_by", "ipb_by_text"),
    "archive": ("ar_user", "ar_user_text"), "revision": ("rev_user", "rev_user_text"),
}


def user_merges(log: DataFrame) -> DataFrame:
    """``old_id, new_id, new_name`` after all merges, in order."""
    shape = "oldId long, newId long, newName string"
    events = log.where("log_type = 'usermerge' and log_action = 'mergeuser'").select(
        F.from_json("log_params", shape).alias("p"), F.col("log_id").alias("seq")
    )
    steps = events.select(F.col("p.oldId").alias("src"), F.col("p.newId").alias("dst"), "seq")
    names = events.groupBy(F.col("p.newId").alias("dst")).agg(F.max_by("p.newName", "seq").alias("new_name"))
    return final_targets(steps).join(names, "dst").select(
        F.col("src").alias("old_id"), F.col("dst").alias("new_id"), "new_name"
    )


def apply_user_merges(cat: Catalog, log: DataFrame) -> dict[str, DataFrame]:
    """Reassign merged users in four tables and delete the accounts that were removed."""
    mapping = user_merges(log)
    out = {}
    for table, (id_column, name_column) in MERGED_COLUMNS.items():
        df = cat[table]
        joined = df.join(mapping, F.col(id_column) == F.col("old_id"), "left")
        joined = joined.withColumn(id_column, F.coalesce("new_id", id_column))
        out[table] = joined.withColumn(name_column, F.coalesce("new_name", name_column)).select(*df.columns)
    removed = log.where("log_type = 'usermerge' and log_action = 'deleteuser'").select(
        F.from_json("log_params", "oldId long").alias("p")
    ).select(F.col("p.oldId").alias("user_id"))
    out["users"] = cat["users"].join(removed, "user_id", "left_anti")
    return out


def users_to_refresh(changes: DataFrame, log: DataFrame) -> DataFrame:
    """Names whose records may have changed: performers, targets of account and rights
    events, and the new names of renamed users instead of the old ones."""
    performers = changes.where("rc_type in ('edit', 'new', 'log')").select(F.col("rc_user_text").alias("user_name"))
    targets = log.where("log_type in ('newusers', 'rights')").select(
        F.regexp_replace("log_title", "^[^:]*:", "").alias("user_name")
    )
    mapping = renames(log)
    names = performers.unionByName(targets).unionByName(mapping.select(F.col("new_name").alias("user_name"))).distinct()
    renamed = names.join(mapping.withColumnRenamed("old_name", "user_name"), "user_name", "left")
    return renamed.select(F.coalesce("new_name", "user_name").alias("user_name")).distinct()


def blocks_after(blocks: DataFrame, log: DataFrame, landed: DataFrame) -> DataFrame:
    """Blocks of users with block events: upsert those that still exist, drop the others."""
    touched = log.where("log_type = 'block'").select(
        F.regexp_replace("log_title", "^[^:]*:", "").alias("ipb_address")
    ).distinct()
    fresh = landed.join(touched, "ipb_address", "left_semi").select(*blocks.columns)
    return keep_only(upsert(blocks, fresh, ["ipb_id"]), touched, fresh, "ipb_address", "ipb_id")


# ---- tags, patrol, protection -------------------------------------------------------------


def tag_events(log: DataFrame, target: str = "revid") -> DataFrame:
    """Tag events: ``id, tag_name, log_id, added``; ``target`` is revid or logid."""
    shape = "revid long, logid long, tagsAdded array<string>, tagsRemoved array<string>"
    events = log.where("log_type = 'tag' and log_action = 'update'").select(
        "log_id", F.from_json("log_params", shape).alias("p")
    ).where(F.col("p." + target).isNotNull())

    def rows(field: str, added: bool) -> DataFrame:
        return events.select(
            F.col("p." + target).alias("id"), F.explode("p." + field).alias("tag_name"), "log_id",
            F.lit(added).alias("added"),
        )

    return rows("tagsAdded", True).unionByName(rows("tagsRemoved", False))


def tag_actions(log: DataFrame, target: str = "revid") -> DataFrame:
    """Net effect of tag events: last action per ``(id, tag)``."""
    return tag_events(log, target).groupBy("id", "tag_name").agg(F.max_by("added", "log_id").alias("added"))


def apply_tags(tagged: DataFrame, table: str, actions: DataFrame, tags: DataFrame, entities: DataFrame) -> DataFrame:
    """Apply net tag actions to one assignment table; ``entities`` (``id``) routes additions.

    Assignments and actions meet in one aggregation, so the table is shuffled once.
    """
    tag_id, entity = TAG_TABLES[table]
    named = actions.join(tags.select("tag_id", "tag_name"), "tag_name").select(
        F.col("tag_id").alias(tag_id), F.col("id").alias(entity), "added"
    )
    known = entities.select(F.col("id").alias(entity))
    wanted = named.where("added").join(known, entity, "left_semi").unionByName(named.where("not added"))
    stored = tagged.select(tag_id, entity, F.lit(None).cast("boolean").alias("added"))
    # an action decides, and adding wins over removing
    last = stored.unionByName(wanted).groupBy(tag_id, entity).agg(F.max("added").alias("added"))
    return last.where("added or added is null").select(tag_id, entity)


def apply_tag_events(cat: Catalog, log: DataFrame) -> dict[str, DataFrame]:
    """Tag events applied to revisions, archived revisions, log events and recent changes."""
    tags = cat["tag"]
    # the log is read once; the net actions are few and feed several tables
    revisions, events = cut_lineage(tag_actions(log, "revid")), cut_lineage(tag_actions(log, "logid"))
    rev = cat["revision"].select(F.col("rev_id").alias("id"))
    archived = revisions.join(rev, "id", "left_anti")
    changes = cat["recentchanges"]
    of_rev = changes.select(F.col("rc_this_oldid").alias("id"), "rc_id").join(revisions, "id")
    of_log = changes.select(F.col("rc_logid").alias("id"), "rc_id").join(events, "id")
    on_changes = of_rev.unionByName(of_log).select(F.col("rc_id").alias("id"), "tag_name", "added")
    removals = revisions.where("not added")

    def apply(table: str, actions: DataFrame, entities: DataFrame) -> DataFrame:
        return apply_tags(cat[table], table, actions, tags, entities)

    return {
        "tagged_revision": apply("tagged_revision", revisions, rev),
        "tagged_archived_revision": apply(
            "tagged_archived_revision", archived.where("added").unionByName(removals),
            cat["archive"].select(F.col("ar_rev_id").alias("id")),
        ),
        "tagged_logevent": apply("tagged_logevent", events, cat["logging"].select(F.col("log_id").alias("id"))),
        "tagged_recentchange": apply("tagged_recentchange", on_changes, changes.select(F.col("rc_id").alias("id"))),
    }


def apply_patrol(changes: DataFrame, log: DataFrame) -> DataFrame:
    patrolled = log.where("log_type = 'patrol' and log_action = 'patrol'").select(
        F.from_json("log_params", "curid long").alias("p")
    ).select(F.col("p.curid").alias("rc_this_oldid"), F.lit(True).alias("rc_patrolled")).distinct()
    return update_column(changes, "rc_this_oldid", patrolled, "rc_patrolled")


def protected_titles_to_refresh(changes: DataFrame, log: DataFrame) -> DataFrame:
    """Titles whose protection against creation may have changed: new pages and
    protection events on titles without a page."""
    created = changes.where("rc_type = 'new'").select(
        F.col("rc_namespace").alias("pt_namespace"), F.col("rc_title").alias("pt_title")
    )
    protected = log.where("log_type = 'protect' and log_page is null").select(
        F.col("log_namespace").alias("pt_namespace"), F.col("log_title").alias("pt_title")
    )
    return created.unionByName(protected).distinct()


def protected_titles_after(titles: DataFrame, page: DataFrame, log: DataFrame) -> DataFrame:
    """Drop rows whose page exists now, or whose last protection event removed it."""
    last = log.where("log_type = 'protect'").groupBy("log_namespace", "log_title").agg(
        F.max_by("log_action", "log_id").alias("last")
    )
    free = last.where("last = 'unprotect'").select(
        F.col("log_namespace").alias("pt_namespace"), F.col("log_title").alias("pt_title")
    )
    existing = page.select(F.col("page_namespace").alias("pt_namespace"), F.col("page_title").alias("pt_title"))
    key = ["pt_namespace", "pt_title"]
    return titles.join(existing, key, "left_anti").join(free, key, "left_anti").select(*titles.columns)


# ---- checks and backfills -----------------------------------------------------------------

# child table, column, parent table, column, children with NULL are fine
FOREIGN_KEYS = [
    ("revision", "rev_page", "page", "page_id"),
    ("revision", "rev_user", "users", "user_id"),
    ("archive", "ar_user", "users", "user_id"),
    ("logging", "log_user", "users", "user_id"),
    ("page_props", "pp_page", "page", "page_id"),
    ("page_restrictions", "pr_page", "page", "page_id"),
    ("pagelinks", "pl_from", "page", "page_id"),
    ("templatelinks", "tl_from", "page", "page_id"),
    ("imagelinks", "il_from", "page", "page_id"),
    ("categorylinks", "cl_from", "page", "page_id"),
    ("langlinks", "ll_from", "page", "page_id"),
    ("iwlinks", "iwl_from", "page", "page_id"),
    ("externallinks", "el_from", "page", "page_id"),
    ("redirect", "rd_from", "page", "page_id"),
    ("section", "sec_page", "page", "page_id"),
    ("tagged_revision", "tgrev_rev_id", "revision", "rev_id"),
    ("tagged_archived_revision", "tgar_rev_id", "archive", "ar_rev_id"),
    ("user_groups", "ug_user", "users", "user_id"),
    ("ipblocks", "ipb_user", "users", "user_id"),
    ("recentchanges", "rc_namespace", "namespace", "ns_id"),
]
UNIQUE_KEYS = [
    ("page", ["page_namespace", "page_title"]), ("users", ["user_name"]), ("tag", ["tag_name"]),
    ("namespace_name", ["nsn_name"]), ("page_props", ["pp_page", "pp_propname"]),
    ("page_restrictions", ["pr_page", "pr_type"]), ("protected_titles", ["pt_namespace", "pt_title"]),
    ("categorylinks", ["cl_from", "cl_to"]), ("langlinks", ["ll_from", "ll_lang"]),
    ("section", ["sec_page", "sec_number"]), ("section", ["sec_page", "sec_anchor"]),
    ("revision", ["rev_id"]), ("archive", ["ar_rev_id"]), ("logging", ["log_id"]), ("recentchanges", ["rc_id"]),
]
PREDICATES = [
    ("page", "page_namespace >= 0"), ("archive", "ar_namespace >= 0"), ("protected_titles", "pt_namespace >= 0"),
    ("pagelinks", "pl_namespace >= 0"), ("templatelinks", "tl_namespace >= 0"),
    ("user_groups", "ug_user > 0"), ("ipblocks", "ipb_user > 0"),
    ("section", "sec_number > 0"), ("section", "sec_level between 1 and 6"),
    ("recentchanges", "rc_type in ('edit', 'new', 'log', 'external')"),
    ("categorylinks", "cl_type in ('page', 'subcat', 'file')"),
    ("namespace", "ns_case in ('first-letter', 'case-sensitive')"),
]
LINK_PREDICATES = [
    ("ws_domain", "resolved or ssl_error is null"),
    ("ws_url_check", "position(concat('://', domain_name) in url) > 0"),
]


def validate(
    cat: Catalog, foreign_keys=FOREIGN_KEYS, unique_keys=UNIQUE_KEYS, predicates=PREDICATES
) -> DataFrame:
    """Number of violations per constraint: ``rule, kind, violations``."""
    parts = []

    def add(df: DataFrame, kind: str, rule: str) -> None:
        parts.append(df.agg(F.count(F.lit(1)).alias("violations")).select(
            F.lit(rule).alias("rule"), F.lit(kind).alias("kind"), "violations"
        ))

    for child, column, parent, key in foreign_keys:
        lost = cat[child].where(F.col(column).isNotNull()).select(F.col(column).alias("_child"))
        known = cat[parent].select(F.col(key).alias("_parent"))
        add(lost.join(known, F.col("_child") == F.col("_parent"), "left_anti"), "foreign key",
            f"{child}.{column} -> {parent}.{key}")
    for table, key in unique_keys:
        groups = cat[table].groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
        add(groups.where("n > 1"), "unique", f"{table}({', '.join(key)})")
    # all rules of one table in a single scan
    for table in dict.fromkeys(name for name, _ in predicates):
        rules = [rule for name, rule in predicates if name == table]
        counts = [F.count_if(F.expr(f"not ({rule})")).alias(f"v{i}") for i, rule in enumerate(rules)]
        rows = [
            F.struct(F.lit(f"{table}: {rule}").alias("rule"), F.lit("check").alias("kind"), F.col(f"v{i}").alias("violations"))
            for i, rule in enumerate(rules)
        ]
        parts.append(cat[table].agg(*counts).select(F.inline(F.array(*rows))))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def missing_content(cat: Catalog, latest_only: bool = True) -> DataFrame:
    """Revisions whose text has not been fetched."""
    rev = cat["revision"].join(cat["texts"], F.col("rev_text_id") == F.col("old_id"), "left_anti")
    if latest_only:
        current = cat["page"].select(F.col("page_id").alias("rev_page"), F.col("page_latest").alias("rev_id"))
        rev = rev.join(current, ["rev_page", "rev_id"], "left_semi")
    return rev.select("rev_id", "rev_page")


def backfill(df: DataFrame, values: dict[str, Column]) -> DataFrame:
    """Recompute columns of a stored table, e.g. blanks to NULL or numbers to booleans."""
    return df.withColumns(values).select(*df.columns)


def blank_to_null(column: str) -> Column:
    return F.nullif(F.col(column), F.lit(""))


def replace_value(column: str, old: str, new: str) -> Column:
    return F.when(F.col(column) == old, F.lit(new)).otherwise(F.col(column))


def namespace_names(star: DataFrame, canonical: DataFrame, aliases: DataFrame) -> DataFrame:
    """All names of each namespace; a name from several lists is kept once."""
    return star.toDF("nsn_id", "nsn_name").union(canonical.toDF("nsn_id", "nsn_name")).union(
        aliases.toDF("nsn_id", "nsn_name")
    ).distinct()


def changed_since(df: DataFrame, column: str, since: Time | dt.datetime) -> DataFrame:
    return df.where(F.col(column) >= as_timestamp(since))
