"""Queries for the list operators (L), predicates (F-a..F-j) and row shaping (O-01, O-07, O-08)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorekeep.operators import lists as L
from lorekeep.plans.registry import query
from lorekeep.sources.sample import TODAY

_TITLE = "(case when coalesce(n.nss_name, '') = '' then {t} else n.nss_name || ':' || {t} end)"


def _title(column: str) -> str:
    return _TITLE.format(t=column)


_RC_TAGS = """
  (select g.tgrc_rc_id as id, string_agg(t.tag_name, ',' order by t.tag_name) as tags
   from @tagged_recentchange g join @tag t on t.tag_id = g.tgrc_tag_id group by 1)"""


def _joined(df, column: str = "tag_names", name: str = "tags"):
    joined = df.withColumn(name, F.array_join(column, ","))
    return joined if column == name else joined.drop(column)


@query("l01_recentchanges", f"""
  select r.rc_id as rcid, r.rc_timestamp as timestamp, coalesce(r.rc_user, 0) as userid,
         r.rc_user_text as "user", r.rc_namespace as ns, r.rc_type as type,
         coalesce(r.rc_cur_id, 0) as pageid, coalesce(r.rc_this_oldid, 0) as revid,
         coalesce(r.rc_last_oldid, 0) as old_revid, r.rc_old_len as oldlen, r.rc_new_len as newlen,
         r.rc_comment as comment, v.rev_sha1 as sha1, coalesce(g.tags, '') as tags,
         r.rc_logid as logid, r.rc_log_type as logtype, r.rc_log_action as logaction, r.rc_params as logparams,
         case when r.rc_minor then '' end as minor, case when r.rc_bot then '' end as bot,
         case when r.rc_new then '' end as "new", case when r.rc_patrolled then '' end as patrolled,
         case when p.page_is_redirect then '' end as redirect,
         {_title('r.rc_title')} as title,
         case when coalesce(r.rc_user, 0) = 0 then '' end as anon,
         case when (r.rc_deleted & 1) <> 0 and r.rc_type <> 'log' then '' end as sha1hidden,
         case when (r.rc_deleted & 1) <> 0 and r.rc_type = 'log' then '' end as actionhidden,
         case when (r.rc_deleted & 2) <> 0 then '' end as commenthidden,
         case when (r.rc_deleted & 4) <> 0 then '' end as userhidden,
         case when (r.rc_deleted & 8) <> 0 then '' end as suppressed
  from @recentchanges r
  left join @namespace_starname n on n.nss_id = r.rc_namespace
  left join @revision v on v.rev_id = r.rc_this_oldid
  left join @page p on p.page_namespace = r.rc_namespace and p.page_title = r.rc_title
  left join {_RC_TAGS} g on g.id = r.rc_id
  where r.rc_type in ('edit', 'new', 'log')""")
def recent_changes(cat):
    df = L.recent_changes(cat, prop=set(L.RC_PROPS))
    return _joined(L.shape_recent_changes(df), "tags")


@query("l01_recentchanges_filtered", """
  select r.rc_type, r.rc_deleted, r.rc_id, r.rc_cur_id, r.rc_this_oldid, r.rc_last_oldid, r.rc_timestamp
  from @recentchanges r
  where r.rc_type = 'edit' and r.rc_namespace in (0, 10) and r.rc_user_text <> 'U3'
    and r.rc_timestamp between '2024-01-05' and '2024-01-25'
    and r.rc_minor and not r.rc_bot and coalesce(r.rc_user, 0) <> 0
    and exists (select 1 from @tagged_recentchange g join @tag t on t.tag_id = g.tgrc_tag_id
                where g.tgrc_rc_id = r.rc_id and t.tag_name = 'view')""")
def recent_changes_filtered(cat):
    return L.recent_changes(
        cat, start="2024-01-25", end="2024-01-05", namespace={0, 10}, exclude_user="U3", tag="view",
        show=["minor", "!bot", "!anon"], types={"edit"}, prop={"ids", "timestamp"},
    )


@query("l01_recentchanges_top", """
  select r.rc_type, r.rc_deleted, r.rc_namespace, r.rc_title, n.nss_name
  from @recentchanges r join @page p
    on p.page_namespace = r.rc_namespace and p.page_title = r.rc_title and r.rc_this_oldid = p.page_latest
  left join @namespace_starname n on n.nss_id = r.rc_namespace
  where r.rc_type in ('edit', 'new') and coalesce(p.page_is_redirect, false)""")
def recent_changes_top(cat):
    return L.recent_changes(cat, types={"edit", "new"}, top_only=True, show=["redirect"], prop={"title"})


@query("l02_logevents", f"""
  select l.log_id as logid, l.log_type as type, l.log_action as action, l.log_timestamp as timestamp,
         coalesce(l.log_user, 0) as userid, l.log_namespace as ns, coalesce(l.log_page, 0) as logpage,
         l.log_comment as comment, l.log_params as params, coalesce(p.page_id, 0) as pageid,
         coalesce(g.tags, '') as tags, {_title('l.log_title')} as title,
         coalesce(u.user_name, l.log_user_text) as "user",
         case when coalesce(l.log_user, 0) = 0 then '' end as anon,
         case when (l.log_deleted & 1) <> 0 then '' end as actionhidden,
         case when (l.log_deleted & 2) <> 0 then '' end as commenthidden,
         case when (l.log_deleted & 4) <> 0 then '' end as userhidden,
         case when (l.log_deleted & 8) <> 0 then '' end as suppressed
  from @logging l
  left join @namespace_starname n on n.nss_id = l.log_namespace
  left join @page p on p.page_namespace = l.log_namespace and p.page_title = l.log_title
  left join @users u on u.user_id = l.log_user
  left join (select g.tgle_log_id as id, string_agg(t.tag_name, ',' order by t.tag_name) as tags
             from @tagged_logevent g join @tag t on t.tag_id = g.tgle_tag_id group by 1) g on g.id = l.log_id""")
def log_events(cat):
    return _joined(L.shape_log_events(L.log_events(cat, prop=set(L.LOG_PROPS))), "tags")


@query("l02_logevents_filtered", """
  select l.log_deleted, l.log_id, l.log_page, l.log_timestamp
  from @logging l where l.log_type = 'delete' and l.log_action = 'delete' and l.log_namespace = 0
    and l.log_timestamp >= '2024-01-10'""")
def log_events_filtered(cat):
    return L.log_events(
        cat, type="delete", action="delete", namespace=0, end="2024-01-10", prop={"ids", "timestamp"}
    )


@query("l03_allpages", f"""
  select p.page_id as pageid, p.page_namespace as ns, {_title('p.page_title')} as title
  from @page p left join @namespace_starname n on n.nss_id = p.page_namespace
  where p.page_namespace = 0 and p.page_title >= 'Topic X1' and p.page_title <= 'Topic Y9'
    and not p.page_is_redirect and p.page_len between 100 and 2000 and starts_with(p.page_title, 'Topic')""")
def all_pages(cat):
    return L.shape_pages(L.all_pages(
        cat, start="Topic X1", end="Topic Y9", prefix="Topic", redirects="nonredirects",
        min_size=100, max_size=2000,
    ))


@query("l03_allpages_protected", f"""
  select p.page_id, p.page_namespace, p.page_title, n.nss_name
  from @page p left join @namespace_starname n on n.nss_id = p.page_namespace
  where p.page_namespace = 0 and p.page_id in (
    select pr_page from @page_restrictions
    where (pr_expiry is null or pr_expiry > '{TODAY}') and pr_type in ('edit', 'move')
      and pr_level = 'sysop' and not pr_cascade
      and (pr_expiry is null or pr_expiry >= '9999-12-31 23:59:59.999999'))""")
def all_pages_protected(cat):
    return L.all_pages(
        cat, pr_type={"edit", "move"}, pr_level={"sysop"}, pr_cascade="noncascading",
        pr_expiry="indefinite", now=TODAY,
    )


@query("l04_protectedtitles", f"""
  select t.pt_namespace as ns, l.log_timestamp as timestamp, l.log_user_text as "user",
         l.log_user as userid, l.log_comment as comment, cast(t.pt_expiry as varchar) as expiry,
         t.pt_level as level, {_title('t.pt_title')} as title
  from @protected_titles t
  left join (select log_namespace, log_title, max(log_id) as id from @logging
             where log_type = 'protect' and log_action = 'protect' group by 1, 2) m
    on m.log_namespace = t.pt_namespace and m.log_title = t.pt_title
  left join @logging l on l.log_id = m.id
  left join @namespace_starname n on n.nss_id = t.pt_namespace
  where t.pt_level in ('autoconfirmed', 'sysop')""")
def protected_titles(cat):
    df = L.protected_titles(cat, prop=set(L.PT_PROPS), level={"autoconfirmed", "sysop"})
    return L.shape_protected_titles(df).withColumn("expiry", F.col("expiry").cast("string"))


@query("j10_latest_protection", """
  select log_namespace, log_title, log_id as pt_log_id, log_timestamp, log_user, log_user_text, log_comment
  from @logging where log_type = 'protect' and log_action = 'protect'
  qualify row_number() over (partition by log_namespace, log_title order by log_id desc) = 1""")
def latest_protection(cat):
    return L.latest_protections(cat)


@query("a02_max_log_id", """
  select log_namespace, log_title, max(log_id) as pt_log_id from @logging
  where log_type = 'protect' and log_action = 'protect' group by 1, 2""")
def max_log_id(cat):
    return L.latest_protections(cat).select("log_namespace", "log_title", "pt_log_id")


@query("l05_allrevisions", f"""
  select r.rev_id as revid, r.rev_parent_id as parentid, r.rev_timestamp as timestamp, r.rev_user as userid,
         r.rev_user_text as "user", r.rev_len as size, r.rev_sha1 as sha1, r.rev_comment as comment,
         p.page_id as pageid, p.page_namespace as ns, {_title('p.page_title')} as title,
         case when r.rev_minor_edit then '' end as minor, coalesce(g.tags, '') as tags,
         case when r.rev_user = 0 then '' end as anon,
         case when (r.rev_deleted & 1) <> 0 then '' end as sha1hidden,
         case when (r.rev_deleted & 2) <> 0 then '' end as commenthidden,
         case when (r.rev_deleted & 4) <> 0 then '' end as userhidden,
         case when (r.rev_deleted & 8) <> 0 then '' end as suppressed
  from @revision r join @page p on p.page_id = r.rev_page
  left join @namespace_starname n on n.nss_id = p.page_namespace
  left join (select g.tgrev_rev_id as id, string_agg(t.tag_name, ',' order by t.tag_name) as tags
             from @tagged_revision g join @tag t on t.tag_id = g.tgrev_tag_id group by 1) g on g.id = r.rev_id
  where p.page_namespace in (0, 4, 14) and r.rev_timestamp <= '2024-01-28'""")
def all_revisions(cat):
    prop = set(L.REVISION_PROPS) - {"content", "contentmodel"}
    df = L.all_revisions(cat, namespace={0, 4, 14}, end="2024-01-28", prop=prop)
    return _joined(L.shape_revisions(df), "tags")


@query("o08_content_slots", """
  select r.rev_id as revid, x.old_text as text, r.rev_content_model as model, r.rev_content_format as format
  from @revision r join @page p on p.page_id = r.rev_page left join @texts x on x.old_id = r.rev_text_id""")
def content_slots(cat):
    df = L.shape_revisions(L.all_revisions(cat, prop={"ids", "content"}))
    main = F.col("slots.main")
    return df.select(
        "revid", main.getField("*").alias("text"), main["contentmodel"].alias("model"),
        main["contentformat"].alias("format"),
    )


@query("l06_alldeletedrevisions", f"""
  select a.ar_rev_id as revid, a.ar_parent_id as parentid, a.ar_timestamp as timestamp,
         a.ar_user as userid, a.ar_user_text as "user", a.ar_comment as comment, a.ar_sha1 as sha1,
         a.ar_len as size, coalesce(p.page_id, 0) as pageid, a.ar_namespace as ns, {_title('a.ar_title')} as title,
         case when a.ar_minor_edit then '' end as minor, coalesce(g.tags, '') as tags,
         case when a.ar_user = 0 then '' end as anon,
         case when (a.ar_deleted & 1) <> 0 then '' end as sha1hidden,
         case when (a.ar_deleted & 2) <> 0 then '' end as commenthidden,
         case when (a.ar_deleted & 4) <> 0 then '' end as userhidden,
         case when (a.ar_deleted & 8) <> 0 then '' end as suppressed
  from @archive a left join @page p on p.page_namespace = a.ar_namespace and p.page_title = a.ar_title
  left join @namespace_starname n on n.nss_id = a.ar_namespace
  left join (select g.tgar_rev_id as id, string_agg(t.tag_name, ',' order by t.tag_name) as tags
             from @tagged_archived_revision g join @tag t on t.tag_id = g.tgar_tag_id group by 1) g
    on g.id = a.ar_rev_id
  where a.ar_title >= 'Topic X' and a.ar_title <= 'Topic Z' and a.ar_user_text <> 'U1'
    and exists (select 1 from @tagged_archived_revision g join @tag t on t.tag_id = g.tgar_tag_id
                where g.tgar_rev_id = a.ar_rev_id and t.tag_name = 'error')""")
def all_deleted_revisions(cat):
    prop = set(L.REVISION_PROPS) - {"content", "contentmodel"}
    df = L.all_deleted_revisions(
        cat, title_from="Topic X", title_to="Topic Z", exclude_user="U1", tag="error", prop=prop
    )
    return _joined(L.shape_revisions(df, "ar_"), "tags")


_GROUPS = """(select ug_user, string_agg(ug_group, ',' order by ug_group) as groups from @user_groups group by 1)"""


@query("l07_allusers", f"""
  select u.user_id as userid, u.user_name as name, coalesce(u.user_editcount, 0) as editcount,
         coalesce(g.groups || ',', '') || '*,user' as groups, coalesce(cast(u.user_registration as varchar), '') as registration,
         b.ipb_id as blockid, b.ipb_by as blockedbyid, b.ipb_by_text as blockedby,
         b.ipb_timestamp as blockedtimestamp, cast(b.ipb_expiry as varchar) as blockexpiry, b.ipb_reason as blockreason,
         case when b.ipb_create_account then '' end as blocknocreate, case when b.ipb_deleted then '' end as hidden
  from @users u left join @ipblocks b on b.ipb_user = u.user_id
  left join {_GROUPS} g on g.ug_user = u.user_id where u.user_id > 0""")
def all_users(cat):
    df = L.shape_users(L.all_users(cat, prop={"blockinfo", "groups", "editcount", "registration"}))
    return _joined(df, "groups", "groups").withColumn("blockexpiry", F.col("blockexpiry").cast("string"))


@query("l07_allusers_group", """
  select u.user_id, u.user_name from @users u where u.user_id > 0 and u.user_editcount > 0
    and u.user_name >= 'U1' and u.user_name <= 'U5'
    and exists (select 1 from @user_groups g where g.ug_user = u.user_id and g.ug_group = 'bot')""")
def all_users_group(cat):
    return L.all_users(cat, group="bot", with_edits_only=True, start="U1", end="U5")


@query("l07_allusers_excludegroup", """
  select u.user_id, u.user_name from @users u where u.user_id > 0
    and not exists (select 1 from @user_groups g where g.ug_user = u.user_id and g.ug_group = 'machinery')""")
def all_users_exclude_group(cat):
    return L.all_users(cat, exclude_group="machinery", direction="descending")


@query("a03_groups_per_user", f"select ug_user, groups as user_groups from {_GROUPS}")
def groups_per_user(cat):
    return L.user_group_sets(cat).select("ug_user", F.array_join("user_groups", ",").alias("user_groups"))


@query("l08_change_bounds", "select min(rc_timestamp) as oldest, max(rc_timestamp) as newest from @recentchanges")
def change_bounds(cat):
    return L.change_time_bounds(cat)


@query("l09_namespaces", """
  select n.ns_id, n.ns_case, n.ns_content, n.ns_subpages, s.nss_name, k.nsc_name from @namespace n
  left join @namespace_starname s on s.nss_id = n.ns_id left join @namespace_canonical k on k.nsc_id = n.ns_id""")
def namespaces(cat):
    return L.namespaces(cat)


@query("l09_namespace_ids", "select nsn_name, nsn_id from @namespace_name")
def namespace_ids(cat):
    return L.namespace_ids(cat)


@query("l10_interwiki", "select iw_prefix, iw_url, iw_local from @interwiki")
def interwiki(cat):
    return L.interwiki_map(cat).select("iw_prefix", "iw_url", "iw_local")


@query("l11_interwiki_redirects", f"""
  select {_title('p.page_title')} as source,
         r.rd_interwiki || ':' || r.rd_title ||
           (case when coalesce(r.rd_fragment, '') = '' then '' else '#' || r.rd_fragment end) as target
  from @page p join @redirect r on r.rd_from = p.page_id
  left join @namespace_starname n on n.nss_id = p.page_namespace where r.rd_interwiki is not null""")
def interwiki_redirects(cat):
    return L.interwiki_redirects(cat)


@query("l12_last_revision_id", """
  select max(rc_this_oldid) as last_rev_id from @recentchanges where rc_type in ('edit', 'new')""")
def last_revision_id(cat):
    return L.last_revision_id(cat)


@query("l13_category_members", """
  select p.page_id, p.page_namespace, p.page_title, n.nss_name, k.cl_type, x.old_text
  from @categorylinks k join @page p on p.page_id = k.cl_from
  left join @namespace_starname n on n.nss_id = p.page_namespace
  left join @revision r on r.rev_id = p.page_latest left join @texts x on x.old_id = r.rev_text_id
  where k.cl_to = 'NATION 7'""")
def category_members(cat):
    return L.category_members(cat, "NATION 7", content=True)


@query("l14_embeddedin", """
  select p.page_id, p.page_namespace, p.page_title, p.page_is_redirect from @page p
  where p.page_namespace in (0, 4, 10) and not p.page_is_redirect and p.page_id in (
    select tl_from from @templatelinks where tl_namespace = 10 and tl_title = 'Topic X95')""")
def embedded_in(cat):
    return L.embedding_pages(cat, 10, "Topic X95", namespaces={0, 4, 10}, redirects="nonredirects")


@query("l15_backlinks", """
  with target as (select 0 as ns, 'Topic X0' as title),
  via as (select p.page_id, p.page_namespace, p.page_title from @page p join @redirect r on r.rd_from = p.page_id
          join target t on t.ns = r.rd_namespace and t.title = r.rd_title where r.rd_interwiki is null),
  hits as (
    select l.pl_from, cast(null as bigint) as via from @pagelinks l join target t
      on l.pl_namespace = t.ns and l.pl_title = t.title
    union all
    select l.pl_from, v.page_id from @pagelinks l join via v
      on l.pl_namespace = v.page_namespace and l.pl_title = v.page_title)
  select p.page_id, p.page_namespace, p.page_title, h.via from hits h join @page p on p.page_id = h.pl_from""")
def backlinks(cat):
    return L.backlinks(cat, 0, "Topic X0")


@query("l16_last_contribution", """
  select u.user_id, u.user_name, cast(coalesce(max(r.rev_timestamp), timestamp '0001-01-01 00:00:00') as varchar) as last_contribution
  from @users u left join @revision r on r.rev_user = u.user_id where u.user_id > 0 group by 1, 2""")
def last_contribution(cat):
    return L.last_contributions(cat).withColumn("last_contribution", F.col("last_contribution").cast("string"))


@query("l17_change_tags", """
  select 'all' as kind, tag_name from @tag
  union all select 'active', tag_name from @tag where tag_active
  union all select 'manual', tag_name from @tag where list_contains(tag_source, 'manual')
  union all select 'extension', tag_name from @tag where list_contains(tag_source, 'extension')
  union all select 'applicable', tag_name from @tag where tag_active and list_contains(tag_source, 'manual')""")
def change_tags(cat):
    out = None
    for kind in ("all", "active", "manual", "extension", "applicable"):
        part = L.change_tags(cat, kind).select(F.lit(kind).alias("kind"), "tag_name")
        out = part if out is None else out.unionByName(part)
    return out


@query("l18_local_interwiki", "select iw_prefix, iw_url from @interwiki where iw_local")
def local_interwiki(cat):
    return L.interwiki_map(cat, local_only=True).select("iw_prefix", "iw_url")


@query("l19_without_langlinks", """
  select p.page_id, p.page_namespace, p.page_title, true as linked from @page p
  where p.page_namespace = 0 and p.page_id in (select ll_from from @langlinks)
  union all
  select p.page_id, p.page_namespace, p.page_title, false from @page p
  where p.page_namespace = 0 and p.page_id not in (select ll_from from @langlinks)""")
def without_langlinks(cat):
    linked = L.pages_by_language_links(cat, linked=True).withColumn("linked", F.lit(True))
    return linked.unionByName(L.pages_by_language_links(cat, linked=False).withColumn("linked", F.lit(False)))


@query("o01_ordered_changes", """
  select row_number() over (order by rc_timestamp desc, rc_id desc) as place, rc_id
  from @recentchanges where rc_type in ('edit', 'new', 'log')
  order by rc_timestamp desc, rc_id desc limit 50""")
def ordered_changes(cat):
    # top 50 of the ordered list; the place is numbered on those 50 rows only
    from pyspark.sql import Window

    top = L.recent_changes(cat, prop={"ids", "timestamp"}, limit=50)
    order = Window.orderBy(F.col("rc_timestamp").desc(), F.col("rc_id").desc())
    return top.select(F.row_number().over(order).cast("long").alias("place"), "rc_id")


@query("o07_shaped_json", f"""
  select l.log_id as id, '{{"logid":' || l.log_id || ',"type":"' || l.log_type || '","action":"' || l.log_action || '"'
         || (case when (l.log_deleted & 1) <> 0 then ',"actionhidden":""' else '' end)
         || (case when (l.log_deleted & 2) <> 0 then ',"commenthidden":""' else '' end)
         || (case when (l.log_deleted & 4) <> 0 then ',"userhidden":""' else '' end)
         || (case when (l.log_deleted & 8) <> 0 then ',"suppressed":""' else '' end) || '}}' as entry
  from @logging l""")
def shaped_json(cat):
    df = L.shape_log_events(L.log_events(cat, prop={"ids", "type"})).drop("logpage")
    return df.select(F.col("logid").alias("id"), F.to_json(F.struct(*df.columns)).alias("entry"))
