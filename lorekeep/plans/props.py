"""Queries for page sets (G) and page properties (P)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorekeep.operators import pageset as S
from lorekeep.operators import props as P
from lorekeep.operators.api import query as wiki_query
from lorekeep.plans.registry import query


def _title(alias: str, column: str) -> str:
    return f"(case when coalesce({alias}.nss_name, '') = '' then {column} else {alias}.nss_name || ':' || {column} end)"


# the page set the properties below are asked for: every page
_SET = "(select page_id, page_namespace, page_title from @page)"


def _pages(cat):
    return cat["page"].select("page_id", "page_namespace", "page_title")


# requests derived from the link table: linked titles, written in the odd ways users write them
_REQUESTS = """(select distinct
    (case when pl_namespace = 10 then 'template : ' when pl_namespace = 14 then 'CATEGORY:' else '' end)
    || lower(substr(pl_title, 1, 1)) || replace(substr(pl_title, 2), ' ', '__') || ' ' as title
  from @pagelinks where pl_namespace in (0, 10, 14))"""


@query("g01_titles", """
  select p.page_id, p.page_namespace, p.page_title from @page p
  where (p.page_namespace, p.page_title) in
    (select distinct pl_namespace, pl_title from @pagelinks where pl_namespace in (0, 10, 14))""")
def by_titles(cat):
    return S.by_titles(cat, cat.sql(f"select title from {_REQUESTS}"))


@query("g02_pageids", """
  select page_id, page_namespace, page_title from @page where page_id in (select rc_cur_id from @recentchanges)""")
def by_ids(cat):
    return S.by_ids(cat, cat["recentchanges"].select(F.col("rc_cur_id").alias("page_id")))


@query("g03_missing", """
  select pl_namespace as page_namespace, pl_title as page_title, '' as missing
  from (select distinct pl_namespace, pl_title from @pagelinks where pl_namespace in (0, 10, 14)) l
  where not exists (select 1 from @page p where p.page_namespace = l.pl_namespace and p.page_title = l.pl_title)""")
def missing(cat):
    return S.missing_titles(cat, cat.sql(f"select title from {_REQUESTS}"))


@query("g03_missing_ids", """
  select distinct log_page + 4 * 1000 as page_id, '' as missing from @logging
  where log_page is not null and log_page + 4 * 1000 not in (select page_id from @page)""")
def missing_ids(cat):
    return S.missing_ids(cat, cat["logging"].where("log_page is not null").selectExpr("log_page + 4000 as page_id"))


@query("g04_generator", """
  select p.page_id, p.page_namespace, p.page_title, 'recentchanges' as source from @page p where exists (
    select 1 from @recentchanges r where r.rc_namespace = p.page_namespace and r.rc_title = p.page_title
      and r.rc_type = 'new')
  union all
  select p.page_id, p.page_namespace, p.page_title, 'logevents' from @page p where exists (
    select 1 from @logging l where l.log_namespace = p.page_namespace and l.log_title = p.page_title
      and l.log_type = 'move')
  union all
  select p.page_id, p.page_namespace, p.page_title, 'allpages' from @page p
    where p.page_namespace = 14 and p.page_is_redirect
  union all
  select p.page_id, p.page_namespace, p.page_title, 'alldeletedrevisions' from @page p where exists (
    select 1 from @archive a where a.ar_namespace = p.page_namespace and a.ar_title = p.page_title)""")
def generators(cat):
    parts = {
        "recentchanges": {"types": {"new"}}, "logevents": {"type": "move"},
        "allpages": {"namespace": 14, "redirects": "redirects"}, "alldeletedrevisions": {},
    }
    out = None
    for name, options in parts.items():
        part = S.by_list(cat, name, **options).withColumn("source", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


@query("g05_attached", f"""
  with e as (
    select pl_from as page_id, 'links' as property, pl_namespace || '/' || pl_title as entry from @pagelinks
    union all select cl_from, 'categories', cl_to from @categorylinks
    union all select el_from, 'extlinks', el_to from @externallinks)
  select s.page_id, s.page_namespace, s.page_title, e.property, e.entry from {_SET} s left join e on e.page_id = s.page_id""")
def attached(cat):
    pages = _pages(cat)
    links = cat["pagelinks"].selectExpr("pl_from as page_id", "pl_namespace as ns", "pl_title as title")
    members = cat["categorylinks"].selectExpr("cl_from as page_id", "cl_to")
    urls = cat["externallinks"].selectExpr("el_from as page_id", "el_to")
    df = S.attach(pages, {"links": links, "categories": members, "extlinks": urls})
    entry = F.when(F.col("property") == "links", F.concat("links.ns", F.lit("/"), "links.title")).otherwise(
        F.coalesce("categories.cl_to", "extlinks.el_to"))
    return df.select("page_id", "page_namespace", "page_title", "property", entry.alias("entry"))


@query("g05_query_surface", """
  with e as (
    select cl_from as page_id, 'categories' as property, 'Category:' || cl_to as title from @categorylinks
    union all select p.page_id, 'latestrevisions', null from @page p
      join @revision r on r.rev_id = p.page_latest and r.rev_page = p.page_id)
  select p.page_id, p.page_title, e.property, e.title from @page p left join e on e.page_id = p.page_id
  where p.page_namespace = 0 and p.page_is_redirect""")
def query_surface(cat):
    df = wiki_query(cat, generator="allpages", gapfilterredir="redirects", prop={"categories", "latestrevisions"})
    return df.select("page_id", "page_title", "property", F.col("categories.title").alias("title"))


@query("g05_entry_order", """
  with e as (
    select cl_from as page_id, 'categories' as property, 'Category:' || cl_to as entry,
           row_number() over (partition by cl_from order by cl_to desc) as place from @categorylinks
    union all
    select el_from, 'extlinks', el_to, null from (
      select * from @externallinks where el_from in (select page_id from @page where page_namespace = 0)
      order by el_from, el_to limit 40) t)
  select p.page_id, e.property, e.entry, e.place from @page p left join e on e.page_id = p.page_id where p.page_namespace = 0""")
def entry_order(cat):
    df = wiki_query(cat, generator="allpages", prop={"categories", "extlinks"}, cldir="descending", ellimit=40)
    entry = F.coalesce("categories.title", "extlinks.url")
    return df.select("page_id", "property", entry.alias("entry"), F.col("categories.place").cast("long").alias("place"))


@query("g06_merge_partials", """
  select rc_cur_id as page_id,
         arg_max(rc_log_type, rc_id) filter (rc_log_type is not null) as last_log_type,
         arg_max(rc_params, rc_id) filter (rc_params is not null) as last_params,
         arg_max(rc_new_len, rc_id) as last_len
  from @recentchanges group by 1""")
def merge_partials(cat):
    parts = cat["recentchanges"].selectExpr(
        "rc_cur_id as page_id", "rc_id", "rc_log_type as last_log_type", "rc_params as last_params",
        "rc_new_len as last_len",
    )
    return S.merge_partials(parts, "page_id", "rc_id", ["last_log_type", "last_params", "last_len"])


@query("g06_merged_items", """
  select tag_id, item, cast(p - 1 as integer) as place
  from (select tag_id, unnest(tag_source) as item, generate_subscripts(tag_source, 1) as p from @tag) t""")
def merged_items(cat):
    return S.merged_items(cat["tag"], "tag_id", "tag_name", "tag_source").select("tag_id", "place", "item")


@query("p01_info", f"""
  select p.page_id, case when p.page_is_redirect then '' end as redirect, case when p.page_is_new then '' end as "new",
         p.page_touched as touched, p.page_len as length, p.page_latest as lastrevid,
         p.page_content_model as contentmodel, p.page_lang as pagelanguage, p.page_lang as pagelanguagehtmlcode,
         'ltr' as pagelanguagedir,
         coalesce(nullif(d.pp_value, ''), {_title('n', 'p.page_title')}) as displaytitle
  from @page p left join @page_props d on d.pp_page = p.page_id and d.pp_propname = 'displaytitle'
  left join @namespace_starname n on n.nss_id = p.page_namespace""")
def info(cat):
    return P.info(cat, _pages(cat), display_title=True)


@query("p01_protection", f"""
  select s.page_id, r.pr_type as type, r.pr_level as level, case when r.pr_cascade then '' end as "cascade",
         case when r.pr_expiry is null then 'indefinite' when r.pr_expiry >= '9999-01-01' then 'infinity'
              else cast(r.pr_expiry as varchar) end as expiry
  from {_SET} s join @page_restrictions r on r.pr_page = s.page_id""")
def protection(cat):
    return P.protection(cat, _pages(cat))


@query("p02_pageprops", f"""
  select s.page_id, max(p.pp_value) filter (p.pp_propname = 'displaytitle') as displaytitle,
         max(p.pp_value) filter (p.pp_propname = 'defaultsort') as defaultsort,
         count(p.pp_propname) as n_props
  from {_SET} s left join @page_props p on p.pp_page = s.page_id and p.pp_propname in ('displaytitle', 'defaultsort')
  group by 1""")
def page_props(cat):
    df = P.page_props(cat, _pages(cat), names={"displaytitle", "defaultsort"})
    value = lambda name: F.try_element_at("pageprops", F.lit(name)).alias(name)
    size = F.coalesce(F.size("pageprops"), F.lit(0)).cast("long").alias("n_props")
    return df.select("page_id", value("displaytitle"), value("defaultsort"), size)


@query("p03_latestrevisions", f"""
  select s.page_id, r.rev_deleted, r.rev_id, r.rev_parent_id, r.rev_timestamp, r.rev_user_text
  from {_SET} s join @page p on p.page_id = s.page_id
  join @revision r on r.rev_page = p.page_id and r.rev_id = p.page_latest""")
def latest_revisions(cat):
    return P.latest_revisions(cat, _pages(cat), prop={"ids", "timestamp", "user"})


@query("p04_revisions", f"""
  select s.page_id, r.rev_deleted, r.rev_id, r.rev_parent_id, r.rev_timestamp, x.old_text,
         r.rev_content_model, r.rev_content_format,
         coalesce((select string_agg(t.tag_name, ',' order by t.tag_name) from @tagged_revision g
                   join @tag t on t.tag_id = g.tgrev_tag_id where g.tgrev_rev_id = r.rev_id), '') as tag_names
  from {_SET} s join @revision r on r.rev_page = s.page_id left join @texts x on x.old_id = r.rev_text_id
  where r.rev_user_text <> 'U2' and r.rev_timestamp >= '2024-01-03'""")
def revisions(cat):
    df = P.revisions(
        cat, _pages(cat), prop={"ids", "timestamp", "content", "tags"}, exclude_user="U2", end="2024-01-03"
    )
    return df.withColumn("tag_names", F.array_join("tag_names", ","))


@query("p05_deletedrevisions", f"""
  select s.page_id, a.ar_deleted, a.ar_rev_id, a.ar_parent_id, a.ar_timestamp, a.ar_user_text
  from {_SET} s join @archive a on a.ar_namespace = s.page_namespace and a.ar_title = s.page_title
  where exists (select 1 from @tagged_archived_revision g join @tag t on t.tag_id = g.tgar_tag_id
                where g.tgar_rev_id = a.ar_rev_id and t.tag_name = 'big')""")
def deleted_revisions(cat):
    return P.deleted_revisions(cat, _pages(cat), prop={"ids", "timestamp", "user"}, tag="big")


@query("p06_templates", f"""
  select s.page_id, l.tl_namespace as ns, {_title('n', 'l.tl_title')} as title
  from {_SET} s join @templatelinks l on l.tl_from = s.page_id
  left join @namespace_starname n on n.nss_id = l.tl_namespace where l.tl_namespace in (0, 10)""")
def templates(cat):
    return P.templates(cat, _pages(cat), namespace={0, 10})


def _reverse_sql(table: str, prefix: str, extra: str, where: str) -> str:
    return f"""
  select s.page_id, p.page_id as pageid, p.page_namespace as ns, {_title('n', 'p.page_title')} as title{extra}
  from {_SET} s join @{table} l on l.{prefix}namespace = s.page_namespace and l.{prefix}title = s.page_title
  join @page p on p.page_id = l.{prefix}from left join @namespace_starname n on n.nss_id = p.page_namespace
  where {where}"""


@query("p07_transcludedin", _reverse_sql(
    "templatelinks", "tl_", ", case when p.page_is_redirect then '' end as redirect",
    "not p.page_is_redirect and p.page_namespace = 0"))
def transcluded_in(cat):
    return P.transcluded_in(cat, _pages(cat), namespace=0, show="!redirect")


@query("p08_links", f"""
  select s.page_id, l.pl_namespace as ns, {_title('n', 'l.pl_title')} as title
  from {_SET} s join @pagelinks l on l.pl_from = s.page_id
  left join @namespace_starname n on n.nss_id = l.pl_namespace""")
def links(cat):
    return P.links(cat, _pages(cat))


@query("p08_links_titles", f"""
  select s.page_id, l.pl_namespace as ns, {_title('n', 'l.pl_title')} as title
  from {_SET} s join @pagelinks l on l.pl_from = s.page_id
  left join @namespace_starname n on n.nss_id = l.pl_namespace
  where (l.pl_namespace, l.pl_title) in ((0, 'Topic X0'), (0, 'Missing 3'))""")
def links_titles(cat):
    return P.links(cat, _pages(cat), titles={(0, "Topic X0"), (0, "Missing 3")})


@query("p09_linkshere", _reverse_sql(
    "pagelinks", "pl_", ", case when p.page_is_redirect then '' end as redirect", "p.page_is_redirect"))
def links_here(cat):
    return P.links_here(cat, _pages(cat), show={"redirect"})


@query("p10_images", f"""
  select s.page_id, 6 as ns, 'File:' || l.il_to as title from {_SET} s join @imagelinks l on l.il_from = s.page_id""")
def images(cat):
    return P.images(cat, _pages(cat))


@query("p11_categories", f"""
  select s.page_id, 14 as ns, 'Category:' || l.cl_to as title
  from {_SET} s join @categorylinks l on l.cl_from = s.page_id""")
def categories(cat):
    return P.categories(cat, _pages(cat))


@query("p12_langlinks", f"""
  select s.page_id, l.ll_lang as lang, l.ll_title as title from {_SET} s join @langlinks l on l.ll_from = s.page_id
  where l.ll_lang in ('de', 'es')""")
def language_links(cat):
    return P.language_links(cat, _pages(cat), lang={"de", "es"})


@query("p13_iwlinks", f"""
  select s.page_id, l.iwl_prefix as prefix, l.iwl_title as title from {_SET} s join @iwlinks l on l.iwl_from = s.page_id
  where l.iwl_prefix in ('s1', 's2', 's3')""")
def interwiki_links(cat):
    return P.interwiki_links(cat, _pages(cat), prefix={"s1", "s2", "s3"})


@query("p14_extlinks", f"""
  select s.page_id, l.el_to as url from {_SET} s join @externallinks l on l.el_from = s.page_id
  where starts_with(l.el_to, 'https://') and contains(substr(l.el_to, 9), 'example.com/')""")
def external_links(cat):
    return P.external_links(cat, _pages(cat), protocol="https", query="example.com/")


@query("p15_redirects", _reverse_sql("redirect", "rd_", ", l.rd_fragment as fragment", "l.rd_fragment is not null"))
def redirects(cat):
    return P.redirects(cat, _pages(cat), prop={"pageid", "title", "fragment"}, show={"fragment"})


@query("p16_sections", f"""
  select s.page_id, c.sec_number as number, c.sec_level as level, c.sec_title as title, c.sec_anchor as anchor
  from {_SET} s join @section c on c.sec_page = s.page_id""")
def sections(cat):
    return P.sections(cat, _pages(cat))
