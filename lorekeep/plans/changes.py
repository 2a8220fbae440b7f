"""Queries for change application (C) and its joins (J-07..J-09, J-11) and windows (W-14, W-15)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorekeep.operators import changes as C
from lorekeep.operators import lists as L
from lorekeep.plans.registry import query
from lorekeep.sources.catalog import MemoryCatalog
from lorekeep.sources.sample import TODAY


@query("c01_upsert", """
  select coalesce(u.user_id, n.user_id) as user_id, coalesce(u.user_name, n.user_name) as user_name,
         u.user_registration, case when n.user_id is not null then n.edits else u.user_editcount end as user_editcount
  from @users u full join (
    select rc_user + 1000 as user_id, 'N' || (rc_user + 1000) as user_name, arg_max(cast(rc_new_len as bigint), rc_id) as edits
    from @recentchanges where rc_user is not null group by 1) n on n.user_id = u.user_id""")
def upsert(cat):
    # one landed row per change, so most keys are repeated
    landed = cat["recentchanges"].where("rc_user is not null and rc_new_len is not null").select(
        "rc_id", (F.col("rc_user") + 1000).alias("user_id"), F.col("rc_new_len").cast("long").alias("user_editcount"))
    landed = landed.withColumn("user_name", F.concat(F.lit("N"), F.col("user_id").cast("string")))
    return C.upsert(cat["users"], landed, ["user_id"], ["user_editcount"], sequence="rc_id")


@query("c02_insert_ignore", "select rc_id, rc_user_text, rc_timestamp from @recentchanges")
def insert_ignore(cat):
    rows = cat["recentchanges"].select("rc_id", "rc_user_text", "rc_timestamp")
    stored, feed = rows.where("rc_timestamp < '2024-01-20'"), rows.where("rc_timestamp >= '2024-01-15'")
    return C.insert_ignore(stored, feed.unionByName(feed), ["rc_id"])


_BITS = """(select cast(unnest(from_json(json_extract(log_params, '$.ids'), '["BIGINT"]')) as bigint) as id, log_id,
    cast(json_extract(log_params, '$.new.bitmask') as integer) as bitmask
  from @logging where log_type = 'delete' and log_action = '{kind}')"""
_LAST_BITS = "(select id, arg_max(bitmask, log_id) as bitmask from " + _BITS + " b group by 1)"
REV_BITS, EVENT_BITS = _LAST_BITS.format(kind="revision"), _LAST_BITS.format(kind="event")


@query("c03_log_visibility", f"""
  select l.log_id, l.log_type, coalesce(b.bitmask, l.log_deleted) as log_deleted from @logging l
  left join {EVENT_BITS} b on b.id = l.log_id""")
def log_visibility(cat):
    return C.apply_visibility(cat, cat["logging"])["logging"].select("log_id", "log_type", "log_deleted")


@query("c11_revision_visibility", f"""
  select r.rev_id as id, 'revision' as source, coalesce(b.bitmask, r.rev_deleted) as deleted
  from @revision r left join {REV_BITS} b on b.id = r.rev_id
  union all
  select a.ar_rev_id, 'archive', coalesce(b.bitmask, a.ar_deleted) from @archive a
  left join {REV_BITS} b on b.id = a.ar_rev_id
  union all
  select r.rc_id, 'recentchanges', coalesce(e.bitmask, b.bitmask, r.rc_deleted) from @recentchanges r
  left join {REV_BITS} b on b.id = r.rc_this_oldid left join {EVENT_BITS} e on e.id = r.rc_logid""")
def revision_visibility(cat):
    tables = C.apply_visibility(cat, cat["logging"])
    pick = lambda t, i, d: tables[t].select(F.col(i).alias("id"), F.lit(t).alias("source"), F.col(d).alias("deleted"))
    return pick("revision", "rev_id", "rev_deleted").unionByName(pick("archive", "ar_rev_id", "ar_deleted")).unionByName(
        pick("recentchanges", "rc_id", "rc_deleted"))


@query("c05_sync_state", f"""
  select wss_key, case when wss_key = 'delete' then timestamp '{TODAY}' else wss_timestamp end as wss_timestamp
  from (select log_type as wss_key, max(log_timestamp) as wss_timestamp from @logging group by 1) s
  union all select 'revision', timestamp '{TODAY}'""")
def sync_state(cat):
    sync = cat["logging"].groupBy(F.col("log_type").alias("wss_key")).agg(F.max("log_timestamp").alias("wss_timestamp"))
    return C.set_sync_timestamp(C.set_sync_timestamp(sync, "delete", TODAY), "revision", TODAY)


@query("c06_needs_update", """
  select (select max(log_timestamp) from @logging) > (select max(log_timestamp) from @logging
          where log_type = 'move') as needs_update""")
def needs_update(cat):
    return C.needs_update(cat["logging"].where("log_type = 'move'"), cat["logging"], "log_timestamp")


@query("c07_feed_mode", """
  select log_type, case when min(log_timestamp) <= '2024-01-01 06:00:00' then 'update' else 'full' end as mode
  from @logging where log_type in ('delete', 'move', 'tag') group by 1""")
def feed_mode(cat):
    out = None
    for kind in ("delete", "move", "tag"):
        feed = cat["logging"].where(F.col("log_type") == kind)
        part = C.feed_mode(feed, "2024-01-01 06:00:00", "log_timestamp").select(F.lit(kind).alias("log_type"), "mode")
        out = part if out is None else out.unionByName(part)
    return out


@query("c08_purge_older", """
  select log_id, log_timestamp from @logging where log_timestamp >= (
    select min(rc_timestamp) from @recentchanges where rc_type = 'log' and rc_deleted <> 0)""")
def purge_older(cat):
    source = cat["recentchanges"].where("rc_type = 'log' and rc_deleted <> 0")
    return C.purge_older(
        cat["logging"], "log_timestamp", source.withColumnRenamed("rc_timestamp", "log_timestamp")
    ).select("log_id", "log_timestamp")


@query("c09_purge_expired", f"""
  select 'group' as kind, ug_user as id, ug_group as name from @user_groups
  where ug_expiry is null or ug_expiry >= '{TODAY}'
  union all
  select 'block', ipb_id, ipb_address from @ipblocks where ipb_expiry >= '{TODAY}'""")
def purge_expired(cat):
    groups = C.purge_expired(cat["user_groups"], "ug_expiry", TODAY)
    blocks = C.purge_expired(cat["ipblocks"], "ipb_expiry", TODAY)
    return groups.select(F.lit("group").alias("kind"), F.col("ug_user").alias("id"), F.col("ug_group").alias("name")).union(
        blocks.select(F.lit("block"), "ipb_id", "ipb_address"))


@query("c10_bits_from_marks", "select rc_id as rcid, rc_deleted from @recentchanges")
def bits_from_marks(cat):
    landed = L.shape_recent_changes(L.recent_changes(cat, prop={"ids"}))
    return landed.select("rcid", C.bits_from_marks(landed).alias("rc_deleted"))


@query("c12_suppressed_pages", """
  select a.ar_rev_id, case when exists (select 1 from @logging l where l.log_type = 'delete' and l.log_action = 'delete'
      and l.log_namespace = a.ar_namespace and l.log_title = a.ar_title) then 15 else a.ar_deleted end as ar_deleted
  from @archive a""")
def suppressed_pages(cat):
    # the sample has no suppressions: take its page deletions as such
    log = cat["logging"].withColumn(
        "log_type", F.when(F.col("log_action") == "delete", F.lit("suppress")).otherwise(F.col("log_type")))
    return C.suppress_pages(cat["archive"], log).select("ar_rev_id", "ar_deleted")


ACTIONS = """(select log_namespace, log_title, case when log_action = 'delete' then 'deleted' else 'restored' end as action,
    log_page from @logging where log_type = 'delete' and log_action in ('delete', 'restore')
  qualify row_number() over (partition by log_namespace, log_title order by log_id desc) = 1)"""
GONE = f"(select distinct log_page as page_id from {ACTIONS} a where action = 'deleted' and log_page is not null)"


@query("w15_page_actions", f"select * from {ACTIONS} a")
def page_actions(cat):
    return C.page_actions(cat["logging"])


@query("c17_classified_pages", """
  select log_page as page_id, bool_or(log_action = 'delete') as deleted, bool_or(log_action <> 'delete') as modified,
         bool_or(log_action = 'move') as moved
  from @logging where log_page is not null and log_type in ('delete', 'protect', 'move', 'import') group by 1""")
def classified_pages(cat):
    return C.classify_pages(cat["logging"])


def _gone(cat):
    actions = C.page_actions(cat["logging"])
    return actions.where("action = 'deleted' and log_page is not null").select(F.col("log_page").alias("page_id"))


@query("c13_archive_after_delete", f"""
  select ar_rev_id, ar_namespace, ar_title, ar_page_id, ar_user_text, ar_timestamp from @archive
  union all
  select r.rev_id, p.page_namespace, p.page_title, r.rev_page, r.rev_user_text, r.rev_timestamp
  from @revision r join @page p on p.page_id = r.rev_page where p.page_id in (select page_id from {GONE} g)""")
def archive_after_delete(cat):
    return C.delete_pages(cat, _gone(cat))["archive"].select(
        "ar_rev_id", "ar_namespace", "ar_title", "ar_page_id", "ar_user_text", "ar_timestamp")


_CASCADE_SQL = " union all ".join(
    f"select '{table}' as tbl, count(*) as n from @{table} where {column} not in (select page_id from gone)"
    for table, column in [("page", "page_id"), ("revision", "rev_page"), *C.CASCADES.items()]
)


@query("c13_rows_after_delete", f"""
  with gone as {GONE} {_CASCADE_SQL}
  union all select 'tagged_revision', count(*) from @tagged_revision where tgrev_rev_id in (
    select rev_id from @revision where rev_page not in (select page_id from gone))
  union all select 'tagged_archived_revision', (select count(*) from @tagged_archived_revision) + count(*)
    from @tagged_revision where tgrev_rev_id in (select rev_id from @revision where rev_page in (select page_id from gone))
  """)
def rows_after_delete(cat):
    out = None
    for table, df in C.delete_pages(cat, _gone(cat)).items():
        if table == "archive":
            continue
        part = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(table).alias("tbl"), "n")
        out = part if out is None else out.unionByName(part)
    return out


@query("c28_new_ids", f"""
  select min(ar_id) as first_id, max(ar_id) as last_id, count(*) as n, count(distinct ar_id) as ids from (
    select ar_id from @archive union all
    select (select max(ar_id) from @archive) + row_number() over () from @revision
    where rev_page in (select page_id from {GONE} g)) x""")
def new_ids(cat):
    archive = C.delete_pages(cat, _gone(cat))["archive"]
    return archive.agg(
        F.min("ar_id").alias("first_id"), F.max("ar_id").alias("last_id"), F.count("ar_id").alias("n"),
        F.countDistinct("ar_id").alias("ids"))


@query("c14_restored", f"""
  with back as (select log_namespace, log_title, log_page from {ACTIONS} x where action = 'restored' and log_page is not null)
  select 'revision' as tbl, a.ar_rev_id as id, b.log_page as page from @archive a
  join back b on b.log_namespace = a.ar_namespace and b.log_title = a.ar_title
  union all select 'revision', rev_id, rev_page from @revision
  union all select 'archive', a.ar_rev_id, a.ar_page_id from @archive a where not exists (
    select 1 from back b where b.log_namespace = a.ar_namespace and b.log_title = a.ar_title)
  union all
  select 'tags', g.tgar_rev_id, g.tgar_tag_id from @tagged_archived_revision g join @archive a on a.ar_rev_id = g.tgar_rev_id
  join back b on b.log_namespace = a.ar_namespace and b.log_title = a.ar_title
  union all select 'tags', tgrev_rev_id, tgrev_tag_id from @tagged_revision""")
def restored(cat):
    actions = C.page_actions(cat["logging"]).where("action = 'restored'")
    tables = C.restore_pages(cat, actions)
    pick = lambda name, table, i, p: tables[table].select(F.lit(name).alias("tbl"), F.col(i).alias("id"), F.col(p).alias("page"))
    return pick("revision", "revision", "rev_id", "rev_page").unionByName(
        pick("archive", "archive", "ar_rev_id", "ar_page_id")).unionByName(
        pick("tags", "tagged_revision", "tgrev_rev_id", "tgrev_tag_id"))


MERGES = """(select m.log_id, m.log_page as src_page, p.page_id as dest_page,
    cast(replace(json_extract_string(m.log_params, '$.mergepoint'), 'Z', '') as timestamp) as mergepoint,
    p.page_id is null or m.log_page in (select log_page from @logging where log_type = 'move' and log_page is not null) as rejected
  from (select * from @logging where log_type = 'merge' and log_page is not null) m
  left join @page p on p.page_namespace = cast(json_extract(m.log_params, '$.dest_ns') as integer)
    and p.page_title = json_extract_string(m.log_params, '$.dest_title'))"""


@query("c15_planned_merges", f"select * from {MERGES} m")
def planned_merges(cat):
    return C.merges(cat, cat["logging"])


_REPLAY = """walk as (
    select rev_id, rev_page as page, rev_timestamp as t, cast(-1 as bigint) as pos from @revision
    union all
    select w.rev_id, m.dest, w.t, m.log_id from walk w join m on m.src = w.page and m.point >= w.t and m.log_id > w.pos
    where not exists (select 1 from m n where n.src = w.page and n.point >= w.t and n.log_id > w.pos and n.log_id < m.log_id))"""


@query("c15_merged_history", f"""
  with recursive m as (
    select log_id, src_page as src, dest_page as dest, mergepoint as point from {MERGES} x
    where not rejected and src_page <> dest_page), {_REPLAY}
  select rev_id, arg_max(page, pos) as rev_page from walk group by 1""")
def merged_history(cat):
    merged = C.apply_merges(cat["revision"], C.merges(cat, cat["logging"]))
    return merged.select("rev_id", "rev_page")


@query("c15_chained_history", f"""
  with recursive m as (
    select log_id, log_page as src, log_page + 4 as dest, log_timestamp as point from @logging where log_page is not null),
  {_REPLAY}
  select rev_id, arg_max(page, pos) as rev_page, count(*) - 1 as steps from walk group by 1""")
def chained_history(cat):
    # every log event of a page stands for a merge of its history into the next page
    planned = cat["logging"].where("log_page is not null").select(
        "log_id", F.col("log_page").alias("src_page"), (F.col("log_page") + 4).alias("dest_page"),
        F.col("log_timestamp").alias("mergepoint"), F.lit(False).alias("rejected"),
    )
    revision = cat["revision"].select("rev_id", "rev_page", "rev_timestamp")
    merged = C.apply_merges(revision, planned)
    return revision.join(merged.withColumnRenamed("rev_page", "to_page"), "rev_id").select(
        "rev_id", F.col("to_page").alias("rev_page"), ((F.col("to_page") - F.col("rev_page")) / 4).cast("long").alias("steps"))


@query("j11_history_join", f"""
  select r.rev_id, m.src_page, m.dest_page from @revision r join {MERGES} m on m.src_page = r.rev_page
    and r.rev_timestamp <= m.mergepoint""")
def history_join(cat):
    planned = C.merges(cat, cat["logging"])
    on = (F.col("rev_page") == F.col("src_page")) & (F.col("rev_timestamp") <= F.col("mergepoint"))
    return cat["revision"].join(planned, on).select("rev_id", "src_page", "dest_page")


@query("c16_moved_pages", """
  select p.page_id, coalesce(cast(json_extract(m.log_params, '$.target_ns') as integer), p.page_namespace) as page_namespace,
         coalesce(json_extract_string(m.log_params, '$.target_title'), p.page_title) as page_title
  from @page p left join (
    select log_page, log_params from @logging where log_type = 'move' and log_page is not null
    qualify row_number() over (partition by log_page order by log_id desc) = 1) m on m.log_page = p.page_id""")
def moved_pages(cat):
    return C.apply_moves(cat["page"], cat["logging"]).select("page_id", "page_namespace", "page_title")


@query("c18_changes_of_existing", f"""
  select rc_id from @recentchanges where rc_logid is not null
    or rc_cur_id in (select page_id from @page where page_id not in (select page_id from {GONE} g))""")
def changes_of_existing(cat):
    page = C.delete_pages(cat, _gone(cat))["page"]
    return C.drop_changes_of_missing_pages(cat["recentchanges"], page).select("rc_id")


@query("j08_anti_join", """
  select rc_id, rc_cur_id from @recentchanges
  where rc_cur_id not in (select log_page from @logging where log_page is not null)""")
def anti_join(cat):
    seen = cat["logging"].select(F.col("log_page").alias("rc_cur_id"))
    return cat["recentchanges"].join(seen, "rc_cur_id", "left_anti").select("rc_id", "rc_cur_id")


def _chain(steps: str) -> str:
    return f"""steps as ({steps}),
  nxt as (select s.seq, min(n.seq) as next_seq from steps s join steps n on n.src = s.dst and n.seq > s.seq group by 1),
  chain as (
    select src, dst, seq, seq as pos from steps s
    where seq = (select min(seq) from steps m where m.src = s.src)
    union all
    select c.src, n.dst, c.seq, n.seq from chain c join nxt x on x.seq = c.pos join steps n on n.seq = x.next_seq),
  final as (select src, arg_max(dst, pos) as dst from chain group by 1)"""


RENAME_CTE = _chain("""select json_extract_string(log_params, '$.olduser') as src,
    json_extract_string(log_params, '$.newuser') as dst, log_id as seq from @logging where log_type = 'renameuser'""")
MERGE_CTE = _chain("""select cast(json_extract(log_params, '$.oldId') as bigint) as src,
    cast(json_extract(log_params, '$.newId') as bigint) as dst, log_id as seq
    from @logging where log_type = 'usermerge' and log_action = 'mergeuser'""")


@query("c19_renames", f"with recursive {RENAME_CTE} select src as old_name, dst as new_name from final")
def renames(cat):
    return C.renames(cat["logging"])


@query("c19_renamed_tables", f"""
  with recursive {RENAME_CTE},
  names as (select 'users' as tbl, user_name as name from @users union all select 'logging', log_user_text from @logging
    union all select 'ipblocks', ipb_by_text from @ipblocks union all select 'archive', ar_user_text from @archive
    union all select 'revision', rev_user_text from @revision)
  select tbl, coalesce(f.dst, n.name) as name, count(*) as n from names n left join final f on f.src = n.name group by 1, 2""")
def renamed_tables(cat):
    out = None
    for table, df in C.apply_renames(cat, cat["logging"]).items():
        part = df.groupBy(F.col(C.RENAMED_COLUMNS[table]).alias("name")).agg(F.count(F.lit(1)).alias("n"))
        part = part.select(F.lit(table).alias("tbl"), "name", "n")
        out = part if out is None else out.unionByName(part)
    return out


@query("c20_merged_users", f"""
  with recursive {MERGE_CTE},
  ids as (select 'logging' as tbl, log_user as id from @logging union all select 'ipblocks', ipb_by from @ipblocks
    union all select 'archive', ar_user from @archive union all select 'revision', rev_user from @revision)
  select tbl, coalesce(f.dst, n.id) as id, count(*) as n from ids n left join final f on f.src = n.id group by 1, 2
  union all
  select 'users', user_id, 1 from @users where user_id not in (
    select cast(json_extract(log_params, '$.oldId') as bigint) from @logging
    where log_type = 'usermerge' and log_action = 'deleteuser')""")
def merged_users(cat):
    out = None
    tables = C.apply_user_merges(cat, cat["logging"])
    for table, df in tables.items():
        key = C.MERGED_COLUMNS[table][0] if table != "users" else "user_id"
        part = df.groupBy(F.col(key).alias("id")).agg(F.count(F.lit(1)).alias("n"))
        part = part.select(F.lit(table).alias("tbl"), "id", "n")
        out = part if out is None else out.unionByName(part)
    return out


@query("c23_users_to_refresh", f"""
  with recursive {RENAME_CTE},
  names as (select rc_user_text as name from @recentchanges where rc_type in ('edit', 'new', 'log')
    union select log_title from @logging where log_type in ('newusers', 'rights') union select dst from final)
  select distinct coalesce(f.dst, n.name) as user_name from names n left join final f on f.src = n.name""")
def users_to_refresh(cat):
    return C.users_to_refresh(cat["recentchanges"], cat["logging"])


_TAGS = """(select id, tag_name, arg_max(added, log_id) as added from (
    select cast(json_extract(log_params, '$.revid') as bigint) as id, log_id, true as added,
           unnest(from_json(json_extract(log_params, '$.tagsAdded'), '["VARCHAR"]')) as tag_name
    from @logging where log_type = 'tag'
    union all
    select cast(json_extract(log_params, '$.revid') as bigint), log_id, false,
           unnest(from_json(json_extract(log_params, '$.tagsRemoved'), '["VARCHAR"]'))
    from @logging where log_type = 'tag') e group by 1, 2)"""


@query("w14_tag_actions", f"select id, tag_name, added from {_TAGS} t")
def tag_actions(cat):
    return C.tag_actions(cat["logging"])


@query("c21_tags_after", f"""
  with acts as (select a.id, t.tag_id, a.added from {_TAGS} a join @tag t on t.tag_name = a.tag_name)
  select 'tagged_revision' as tbl, tgrev_tag_id as tag, tgrev_rev_id as id from @tagged_revision g
  where not exists (select 1 from acts a where not a.added and a.tag_id = g.tgrev_tag_id and a.id = g.tgrev_rev_id)
  union select 'tagged_revision', tag_id, id from acts where added and id in (select rev_id from @revision)
  union select 'tagged_archived_revision', tgar_tag_id, tgar_rev_id from @tagged_archived_revision g
  where not exists (select 1 from acts a where not a.added and a.tag_id = g.tgar_tag_id and a.id = g.tgar_rev_id)
  union select 'tagged_archived_revision', tag_id, id from acts where added and id in (select ar_rev_id from @archive)
  union select 'tagged_logevent', tgle_tag_id, tgle_log_id from @tagged_logevent
  union select 'tagged_recentchange', tgrc_tag_id, tgrc_rc_id from @tagged_recentchange g
  where not exists (select 1 from acts a join @recentchanges r on r.rc_this_oldid = a.id
                    where not a.added and a.tag_id = g.tgrc_tag_id and r.rc_id = g.tgrc_rc_id)
  union select 'tagged_recentchange', a.tag_id, r.rc_id from acts a join @recentchanges r on r.rc_this_oldid = a.id
  where a.added""")
def tags_after(cat):
    out = None
    for table, df in C.apply_tag_events(cat, cat["logging"]).items():
        part = df.toDF("tag", "id").select(F.lit(table).alias("tbl"), "tag", "id")
        out = part if out is None else out.unionByName(part)
    return out


@query("j07_semi_join", f"""
  select id, tag_name, added, id in (select rev_id from @revision) as live from {_TAGS} t""")
def semi_join(cat):
    actions = C.tag_actions(cat["logging"])
    ids = cat["revision"].select(F.col("rev_id").alias("id"))
    live = actions.join(ids, "id", "left_semi").withColumn("live", F.lit(True))
    return live.unionByName(actions.join(ids, "id", "left_anti").withColumn("live", F.lit(False)))


@query("c22_patrolled", """
  select rc_id, rc_patrolled or rc_this_oldid in (
    select cast(json_extract(log_params, '$.curid') as bigint) from @logging where log_type = 'patrol')
    is true as rc_patrolled from @recentchanges""")
def patrolled(cat):
    return C.apply_patrol(cat["recentchanges"], cat["logging"]).select("rc_id", "rc_patrolled")


def _landed_blocks(cat):
    return cat["ipblocks"].where("ipb_expiry >= '2024-02-01'").withColumn("ipb_reason", F.lit("checked"))


@query("c24_blocks_after", """
  with touched as (select distinct log_title as address from @logging where log_type = 'block')
  select ipb_id, ipb_address, case when ipb_address in (select address from touched) then 'checked' else ipb_reason end
    as ipb_reason from @ipblocks
  where ipb_address not in (select address from touched) or ipb_expiry >= '2024-02-01'""")
def blocks_after(cat):
    after = C.blocks_after(cat["ipblocks"], cat["logging"], _landed_blocks(cat))
    return after.select("ipb_id", "ipb_address", "ipb_reason")


@query("j09_keep_only", """
  select pp_page, pp_propname from @page_props
  where pp_page not in (select page_id from @page where not page_is_redirect) or pp_propname in ('displaytitle', 'notoc')""")
def keep_only(cat):
    props = cat["page_props"].select("pp_page", "pp_propname")
    touched = cat["page"].where("not page_is_redirect").select(F.col("page_id").alias("pp_page"))
    landed = props.where("pp_propname in ('displaytitle', 'notoc')")
    return C.keep_only(props, touched, landed, "pp_page", "pp_propname")


@query("c25_titles_to_refresh", """
  select rc_namespace as pt_namespace, rc_title as pt_title from @recentchanges where rc_type = 'new'
  union select log_namespace, log_title from @logging where log_type = 'protect' and log_page is null""")
def titles_to_refresh(cat):
    return C.protected_titles_to_refresh(cat["recentchanges"], cat["logging"])


@query("c25_protected_after", """
  select t.pt_namespace, t.pt_title, t.pt_level from @protected_titles t
  where not exists (select 1 from @page p where p.page_namespace = t.pt_namespace and p.page_title = t.pt_title)
    and coalesce((select arg_max(l.log_action, l.log_id) from @logging l where l.log_type = 'protect'
                  and l.log_namespace = t.pt_namespace and l.log_title = t.pt_title), '') <> 'unprotect'""")
def protected_after(cat):
    return C.protected_titles_after(cat["protected_titles"], cat["page"], cat["logging"]).select(
        "pt_namespace", "pt_title", "pt_level")


def _validation_sql() -> str:
    parts = [
        f"select '{c}.{x} -> {p}.{k}' as rule, 'foreign key' as kind, count(*) as violations from @{c} "
        f"where {x} is not null and {x} not in (select {k} from @{p})" for c, x, p, k in C.FOREIGN_KEYS
    ]
    parts += [
        f"select '{t}({', '.join(k)})', 'unique', count(*) from (select 1 from @{t} group by {', '.join(k)} having count(*) > 1) u"
        for t, k in C.UNIQUE_KEYS
    ]
    parts += [
        "select '" + f"{t}: {r}".replace("'", "''") + f"', 'check', count(*) from @{t} where not ({r})" for t, r in C.PREDICATES
    ]
    return " union all ".join(parts)


@query("c26_validation", _validation_sql())
def validation(cat):
    return C.validate(cat)


_DOMAINS = """(select n_nationkey as id, n_name || '.example.org' as domain, n_nationkey % 3 <> 0 as resolved,
    case when n_nationkey % 4 = 0 then 'expired' end as ssl_error from @nation)"""
_CHECKS = """(select c_custkey as id, 'n' || cast(c_nationkey as string) || '.example.org' as domain_name, 'https://n'
    || cast(c_nationkey + (case when c_custkey % 5 = 0 then 1 else 0 end) as string) || '.example.org/' || cast(c_custkey as string)
    as url from @customer)"""


@query("c26_link_checks", f"""
  select 'ws_domain: ' || '{C.LINK_PREDICATES[0][1]}' as rule, 'check' as kind, count(*) as violations
  from {_DOMAINS} d where not (resolved or ssl_error is null)
  union all select 'ws_url_check: ' || $${C.LINK_PREDICATES[1][1]}$$, 'check', count(*)
  from {_CHECKS} u where not contains(url, '://' || domain_name)""")
def link_checks(cat):
    tables = {"ws_domain": cat.sql(f"select * from {_DOMAINS}"), "ws_url_check": cat.sql(f"select * from {_CHECKS}")}
    site = MemoryCatalog(cat.spark, tables)
    return C.validate(site, foreign_keys=[], unique_keys=[], predicates=C.LINK_PREDICATES)


@query("c27_missing_content", """
  select r.rev_id, r.rev_page from @revision r join @page p on p.page_id = r.rev_page and p.page_latest = r.rev_id
  where r.rev_text_id not in (select old_id from @texts)""")
def missing_content(cat):
    return C.missing_content(cat)


@query("c27_missing_content_all", """
  select rev_id, rev_page from @revision where rev_text_id not in (select old_id from @texts)""")
def missing_content_all(cat):
    return C.missing_content(cat, latest_only=False)


@query("c29_backfill", """
  select rc_id, case when rc_user_text = 'U0' then 'Anonymous' else rc_user_text end as rc_user_text,
         rc_new_len % 2 = 1 as odd, nullif(replace(rc_comment, 'change click', ''), '') as rc_comment
  from @recentchanges""")
def backfill(cat):
    rows = cat["recentchanges"].select(
        "rc_id", "rc_user_text", (F.col("rc_new_len") % 2).alias("odd"),
        F.replace(F.col("rc_comment"), F.lit("change click"), F.lit("")).alias("rc_comment"))
    return C.backfill(rows, {
        "rc_user_text": C.replace_value("rc_user_text", "U0", "Anonymous"), "odd": F.col("odd").cast("boolean"),
        "rc_comment": C.blank_to_null("rc_comment")})


@query("c30_namespace_names", """
  select nss_id as nsn_id, nss_name as nsn_name from @namespace_starname
  union select nsc_id, nsc_name from @namespace_canonical union select nsa_id, nsa_name from @namespace_alias""")
def namespace_names(cat):
    return C.namespace_names(cat["namespace_starname"], cat["namespace_canonical"], cat["namespace_alias"])
