"""Queries for quality reports (Q) and the joins behind them (J-01..J-06, J-12, J-15, J-16)."""

from __future__ import annotations

from multiprocessing.pool import ThreadPool

from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from lorekeep.operators import extract as X
from lorekeep.operators import graph as G
from lorekeep.operators import quality as Q
from lorekeep.operators.closure import Generations
from lorekeep.operators.common import with_namespace
from lorekeep.plans.extract import _ENCODE, _UNIQUE, PARSED, _wikitext
from lorekeep.plans.graph import EDGES, language
from lorekeep.plans.registry import query
from lorekeep.session import ensure_checkpoint_dir
from lorekeep.sources.catalog import MemoryCatalog


def _full(n: str, t: str) -> str:
    return f"(case when {n}.nss_name = '' then {t} else {n}.nss_name || ':' || {t} end)"


@query("q01_broken_fragments", f"""
  select e.* from {EDGES} e join @page p on p.page_namespace = e.dst_ns and p.page_title = e.dst_title
  where e.dst_ns in (0, 4, 12) and e.fragment is not null and not exists (
    select 1 from @section s where s.sec_page = p.page_id and s.sec_anchor = replace(e.fragment, ' ', '_'))""")
def broken_fragments(cat):
    return Q.broken_redirect_fragments(cat, G.redirect_edges(cat, None, {0, 4, 12}))


def _case_edges(cat):
    """Redirects between spellings of the same title, one per content page."""
    page = cat["page"].where("page_namespace = 0")
    return page.select(
        F.col("page_namespace").alias("src_ns"), F.regexp_replace("page_title", "X", "x").alias("src_title"),
        F.col("page_namespace").alias("dst_ns"), F.col("page_title").alias("dst_title"),
        F.lit(None).cast("string").alias("fragment"),
    )


@query("q02_wrong_capitalization", """
  select replace(page_title, 'X', 'x') as source, page_title as target from @page
  where page_namespace = 0 and page_title like 'Topic X%'""")
def wrong_capitalization(cat):
    return Q.wrong_capitalization(cat, _case_edges(cat))


@query("q03_leaving_content", f"select * from {EDGES} e where src_ns in (0, 4, 12, 14) and dst_ns not in (0, 4, 12, 14)")
def leaving_content(cat):
    return Q.leaving_content(G.redirect_edges(cat))


@query("q04_talk_without_article", """
  select t.page_id, t.page_namespace, t.page_title from @page t where t.page_namespace in (1, 5, 13) and not exists (
    select 1 from @page a where a.page_namespace = t.page_namespace - 1 and a.page_title = t.page_title)""")
def talk_without_article(cat):
    return Q.talk_without_article(cat)


@query("q05_talk_of_redirects", """
  select t.page_id, t.page_namespace, t.page_title from @page t
  join @page a on a.page_namespace = t.page_namespace - 1 and a.page_title = t.page_title
  where a.page_namespace in (0, 4, 12) and a.page_is_redirect and not t.page_is_redirect""")
def talk_of_redirects(cat):
    return Q.run_check("talk-of-redirects", cat)


@query("q06_mismatched_talk", f"""
  with e as {EDGES},
  t as (select s.src_ns, s.src_title, s.dst_ns, s.dst_title, s.dst_title || coalesce('#' || s.fragment, '') as target,
               {_full('n', 's.dst_title')} as talk_target, a.dst_ns as to_ns, a.dst_title as to_title,
               a.dst_title || coalesce('#' || a.fragment, '') as to_target
        from e s left join e a on a.src_ns = s.src_ns - 1 and a.src_title = s.src_title
        join @namespace_starname n on n.nss_id = s.dst_ns where s.src_ns > 0 and s.src_ns % 2 = 1)
  select src_ns, src_title, talk_target, case when to_title is null then 'article is not a redirect'
         else 'article redirects elsewhere' end as problem, to_ns, to_title
  from t where not coalesce(to_ns = dst_ns and to_target = target and dst_ns % 2 = 1, false)
    and (to_title is null or to_title <> dst_title or to_ns <> (case when dst_ns > 0 and dst_ns % 2 = 1 then dst_ns - 1 else dst_ns end))""")
def mismatched_talk(cat):
    return Q.mismatched_talk_redirects(cat, G.redirect_edges(cat))


@query("q07_closed_discussions", """
  select page_id, page_namespace, page_title from @page where page_namespace in (1, 5, 11, 13, 15) and page_id in (
    select sec_page from @section where sec_title like '<s>%</s>')""")
def closed_discussions(cat):
    return Q.closed_discussions(cat)


@query("q09_wrong_language_categories", f"""
  select distinct p.page_id, {_full('n', 'p.page_title')} as title, {language('p.page_title')} as language
  from @page p join @namespace_starname n on n.nss_id = p.page_namespace join @categorylinks k on k.cl_from = p.page_id
  where not p.page_is_redirect and p.page_namespace in (0, 4, 10, 12, 14)
    and {language('k.cl_to')} <> {language('p.page_title')}""")
def wrong_language_categories(cat):
    return Q.wrong_language_categories(cat)


@query("q10_categorized_talk", """
  select page_id, page_namespace, page_title from @page where not page_is_redirect
    and page_namespace in (1, 2, 3, 5, 7, 9, 11, 13, 15) and page_id in (select cl_from from @categorylinks)""")
def categorized_talk(cat):
    return Q.categorized_talk(cat)


def _site(cat):
    """A small wiki of its own: the wikitext pages with everything extracted from them."""
    pages = _wikitext(cat)
    links = X.wikilinks(cat, pages)
    tables = {
        "page": pages.select("page_id", "page_namespace", "page_title"), "section": X.sections(pages),
        "redirect": X.redirects(cat, pages), "namespace_starname": cat["namespace_starname"],
        "namespace_name": cat["namespace_name"], "interwiki": cat["interwiki"],
    }
    return MemoryCatalog(cat.spark, tables), links


SITE = """page_list as (select page_id, title from @wikitext),
  redirects as (select w.title as src, r.target, r.fragment from (
      select page_id, title from @wikitext) w join (
      select page_id, {up} as target, nullif(split_part(raw, '#', 2), '') as fragment
      from (select page_id, regexp_extract(body, '^#REDIRECT \\[\\[([^\\]]*)\\]\\]', 1) as raw from @wikitext
            where starts_with(body, '#REDIRECT')) q where raw <> '') r on r.page_id = w.page_id
      where r.target in (select title from @wikitext))""".replace(
    "{up}", "((case when substr(raw, 1, 1) = 'ß' then 'SS' else upper(substr(raw, 1, 1)) end) || substr(split_part(raw, '#', 1), 2))")


@query("q11_broken_section_links", f"""
  with recursive {SITE},
  walk as (
    select src, target, fragment, [src] as path from redirects
    union all
    select w.src, r.target, coalesce(r.fragment, w.fragment), list_append(w.path, r.src)
    from walk w join redirects r on r.src = w.target where not list_contains(w.path, r.src)),
  resolved as (
    select s.src, w.target, w.fragment from redirects s
    left join (select * from walk x where x.target not in (select src from redirects)) w on w.src = s.src),
  known as (select page_id, unnest(anchors) as anchor from {_UNIQUE} u),
  links as (
    select l.page_id, l.place, case when r.src is null then l.name else r.target end as target,
           r.fragment is not null as via_section, array_to_string({_ENCODE.format(
               x="trim(regexp_replace(replace(l.section, '_', ' '), ' +', ' ', 'g'))")}, '') as anchor
    from {PARSED} l left join resolved r on r.src = l.name where l.kind in ('page', 'skip') and l.section <> '')
  select k.page_id, cast(k.place as integer) as position, p.page_id as target_page, k.anchor, k.via_section
  from links k join page_list p on p.title = k.target
  where (p.page_id, k.anchor) not in (select page_id, anchor from known)""")
def broken_section_links(cat):
    site, links = _site(cat)
    return Q.broken_section_links(site, links, G.resolve_redirects(G.redirect_edges(site))).drop("raw")


@query("j15_anchor_suggestions", """
  select b.page as target_page, b.anchor, min(s.sec_anchor) as suggestion
  from (select sec_page as page, sec_number as n, translate(sec_anchor, 's', 'z') as anchor from @section) b
  join (select distinct sec_page, sec_anchor from @section) s
    on s.sec_page = b.page and 5 * levenshtein(b.anchor, s.sec_anchor) <= greatest(length(b.anchor), length(s.sec_anchor))
  group by b.page, b.n, b.anchor having count(*) = 1""")
def anchor_suggestions(cat):
    # section names of talk pages with a letter changed, looked up on the same page
    site = MemoryCatalog(cat.spark, {"section": cat["section"]})
    broken = cat["section"].select(
        F.col("sec_page").alias("target_page"), F.translate("sec_anchor", "s", "z").alias("anchor"),
        F.lit(False).alias("via_section"),
    )
    return Q.anchor_suggestions(site, broken).select("target_page", "anchor", "suggestion")


@query("q12_direct_links", f"""
  with {SITE},
  l as (select page_id, place, label, name, section,
          (case when substr(label, 1, 1) = 'ß' then 'SS' else upper(substr(label, 1, 1)) end) || substr(label, 2) as lname
        from {PARSED} p where label is not null and kind in ('page', 'skip', 'image')
          and not contains(label, ':') and kind <> 'image')
  select l.page_id, cast(l.place as integer) as position, l.label from l
  left join redirects a on a.src = l.name left join redirects b on b.src = l.lname
  where (a.target is null or coalesce(a.fragment, '') = l.section) and (case
    when a.target is not null and b.target is not null then a.target = b.target and coalesce(a.fragment, '') = coalesce(b.fragment, '')
    when a.target is not null then a.target = l.lname and coalesce(a.fragment, '') = ''
    when b.target is not null then b.target = l.name and coalesce(b.fragment, '') = l.section else false end)""")
def direct_links(cat):
    site, links = _site(cat)
    return Q.direct_links(site, links, G.redirect_edges(site)).select("page_id", "position", "label")


@query("q13_case_only_redirects", """
  select pl_from as page_id, replace(pl_title, 'X', 'x') as raw, pl_title as direct from @pagelinks l
  where pl_namespace = 0 and pl_title like '%X%' and exists (
    select 1 from @page p where p.page_namespace = 0 and p.page_title = l.pl_title)""")
def case_only_redirects(cat):
    links = cat["pagelinks"].where("pl_namespace = 0").select(
        F.col("pl_from").alias("page_id"), F.lit(0).alias("position"), F.replace("pl_title", F.lit("X"), F.lit("x")).alias("raw"),
        F.col("pl_title").alias("linked"), F.lit("").alias("iwprefix"), F.lit(0).alias("ns_id"),
        F.replace("pl_title", F.lit("X"), F.lit("x")).alias("pagename"), F.lit("").alias("sectionname"),
    ).where("pagename <> linked")
    edges = _case_edges(cat).where("src_title <> dst_title")
    return Q.case_only_redirects(cat, links, edges).select("page_id", "raw", "direct")


@query("q14_redundant_labels", f"""
  select page_id, cast(place as integer) as position, label from {PARSED} p
  where label is not null and kind in ('page', 'skip') and section = ''
    and name = (case when substr(label, 1, 1) = 'ß' then 'SS' else upper(substr(label, 1, 1)) end) || substr(label, 2)""")
def redundant_labels(cat):
    site, links = _site(cat)
    return Q.redundant_labels(site, links).select("page_id", "position", "label")


@query("q15_self_links", f"""
  with {SITE}
  select l.page_id, cast(l.place as integer) as position, '#' || l.section as short from {PARSED} l
  left join redirects r on r.src = l.name
  where l.kind in ('page', 'skip') and l.section <> '' and coalesce(r.target, l.name) = l.own""")
def self_links(cat):
    site, links = _site(cat)
    return Q.self_links(links, G.redirect_edges(site)).select("page_id", "position", "short")


@query("q16_links_to_missing", f"""
  select page_id, cast(place as integer) as position, name as pagename,
         cast(case kind when 'image' then 6 when 'category' then 14 else 0 end as integer) as ns_id from {PARSED} l
  where kind not in ('language', 'interwiki') and (kind in ('image', 'category') or name not in (select title from @wikitext))""")
def links_to_missing(cat):
    site, links = _site(cat)
    return Q.links_to_missing(links, site["page"])


@query("q16_display_titles", """
  select l.pl_from as page_id, l.pl_title as raw, d.pp_value as new_title from @pagelinks l
  join @page p on p.page_namespace = l.pl_namespace and p.page_title = l.pl_title
  join @page_props d on d.pp_page = p.page_id and d.pp_propname = 'displaytitle'
  where substr(l.pl_title, 2) <> substr(d.pp_value, 2)""")
def display_titles(cat):
    links = cat["pagelinks"].select(
        F.col("pl_from").alias("page_id"), F.lit(0).alias("position"), F.col("pl_title").alias("raw"),
        F.lit("").alias("iwprefix"), F.col("pl_namespace").alias("ns_id"), F.col("pl_title").alias("pagename"),
        F.lit(False).alias("leading_colon"),
    )
    display = cat["page_props"].where("pp_propname = 'displaytitle'").join(
        cat["page"], F.col("pp_page") == F.col("page_id")
    ).select(F.col("page_namespace").alias("ns_id"), F.col("page_title").alias("pagename"), F.col("pp_value").alias("displaytitle"))
    return Q.display_title_mismatches(links, display).select("page_id", "raw", "new_title")


@query("q17_links_to_archive", f"""
  with recursive e as {EDGES},
  into_archive as (
    select src_ns, src_title from e where dst_ns = 0 and dst_title = (select min(page_title) from @page p
      where page_namespace = 0 and page_title like 'Topic%' and (0, page_title) not in (select src_ns, src_title from e))
    union
    select e.src_ns, e.src_title from e join into_archive i on i.src_ns = e.dst_ns and i.src_title = e.dst_title)
  select l.pl_from as page_id, l.pl_namespace as ns_id, l.pl_title as pagename from @pagelinks l
  join into_archive i on i.src_ns = l.pl_namespace and i.src_title = l.pl_title""")
def links_to_archive(cat):
    edges = G.redirect_edges(cat)
    sources = edges.select(F.col("src_ns").alias("page_namespace"), F.col("src_title").alias("page_title"))
    # the first title that is no redirect stands for the archive page
    archive = cat["page"].where("page_namespace = 0 and page_title like 'Topic%'").join(
        sources, ["page_namespace", "page_title"], "left_anti"
    ).agg(F.min("page_title")).scalar()
    links = cat["pagelinks"].select(
        F.col("pl_from").alias("page_id"), F.lit(0).alias("position"), F.lit("").alias("iwprefix"),
        F.col("pl_namespace").alias("ns_id"), F.col("pl_title").alias("pagename"),
    )
    return Q.links_to_archive(cat, links, G.resolve_redirects(edges), archive).drop("position")


_PACKAGE_USES = """(select o_orderkey as page_id, 'Page ' || cast(o_orderkey as string) as title,
    (case o_orderkey % 7 when 0 then ' Pkg' || cast(o_custkey as string) when 1 then 'pkg' || cast(o_custkey as string)
       when 2 then 'grp' || cast(o_custkey % 50 as string) when 3 then 'GRP' || cast(o_custkey % 50 as string)
       when 4 then 'User' || cast(o_custkey as string) when 5 then 'old' || cast(o_custkey as string)
       else 'none' || cast(o_custkey as string) end) as name,
    (case when o_orderkey % 11 = 0 then 2 else 1 end) as parameters from @orders)"""


def _package_tables(cat):
    return (
        cat["customer"].selectExpr("concat('pkg', c_custkey) as name"),
        cat["nation"].selectExpr("concat('grp', n_nationkey) as name"),
        cat["customer"].selectExpr("concat('user', c_custkey) as name").where("name not like '%7'"),
        cat["supplier"].selectExpr("concat('Old', s_suppkey) as name", "concat('pkg', s_suppkey) as by"),
    )


_CLASSIFIED = f"""(select name, case
      when p.pkg is not null or g.grp is not null or u.usr is not null or p2.pkg is not null or g2.grp is not null
      then (case when p.pkg is not null then 'Pkg' when g.grp is not null then 'Grp' when u.usr is not null then 'AUR'
                 when p2.pkg is not null then 'Pkg' else 'Grp' end) end as template,
    case when p.pkg is not null or g.grp is not null or u.usr is not null then name else coalesce(p2.pkg, g2.grp) end as package,
    case when p.pkg is null and g.grp is null and u.usr is null and p2.pkg is null and g2.grp is null
         then case when r.by is not null then 'replaced by {{{{Pkg|' || r.by || '}}}}' else 'package not found' end end as hint
  from (select distinct trim(name) as name from {_PACKAGE_USES} x) t
  left join (select 'pkg' || c_custkey as pkg from @customer) p on p.pkg = t.name
  left join (select 'grp' || n_nationkey as grp from @nation) g on g.grp = t.name
  left join (select 'user' || c_custkey as usr from @customer where c_custkey % 10 <> 7) u on u.usr = lower(t.name)
  left join (select 'pkg' || c_custkey as pkg from @customer) p2 on p2.pkg = lower(t.name)
  left join (select 'grp' || n_nationkey as grp from @nation) g2 on g2.grp = lower(t.name)
  left join (select 'old' || s_suppkey as old, 'pkg' || s_suppkey as by from @supplier) r on r.old = lower(t.name))"""


@query("j12_classified_packages", f"select * from {_CLASSIFIED} c")
def classified_packages(cat):
    return Q.classify_packages(cat.sql(f"select * from {_PACKAGE_USES}"), *_package_tables(cat))


@query("q18_package_hints", f"""
  select u.page_id, u.title, trim(u.name) as name, coalesce(c.hint,
    case when u.parameters <> 1 then 'invalid number of template parameters' end) as message
  from {_PACKAGE_USES} u join {_CLASSIFIED} c on c.name = trim(u.name) where c.hint is not null or u.parameters <> 1""")
def package_hints(cat):
    uses = cat.sql(f"select * from {_PACKAGE_USES}")
    return Q.package_hints(uses, Q.classify_packages(uses, *_package_tables(cat)))


_LANG_TAG = "(case {x} when 'Español' then 'es' when 'Français' then 'fr' when 'Čeština' then 'cs' else 'en' end)"


@query("q19_language_mismatches", f"""
  select p.page_id, {_full('n', 'p.page_title')} as title, p.page_lang, {_LANG_TAG.format(x=language('p.page_title'))} as title_lang
  from @page p join @namespace_starname n on n.nss_id = p.page_namespace where p.page_namespace in (0, 4, 10, 12, 14)
    and p.page_lang <> {_LANG_TAG.format(x=language('p.page_title'))}""")
def language_mismatches(cat):
    return Q.language_mismatches(cat)


@query("q20_renamed_languages", f"""
  select p.page_id, {_full('n', 'p.page_title')} as title,
         replace({_full('n', 'p.page_title')}, '(Čeština)', '(Czech)') as new_title
  from @page p join @namespace_starname n on n.nss_id = p.page_namespace
  where not p.page_is_redirect and p.page_namespace in (0, 4, 10, 12, 14) and p.page_title like '%(Čeština)%'""")
def renamed_languages(cat):
    return Q.renamed_language_pages(cat, {"Čeština": "Czech"})


@query("q21_unused_localized_templates", f"""
  with linked as (select p.page_title from @page p where p.page_namespace = 10 and p.page_id in (select ll_from from @langlinks)),
  used as (
    select p.page_id, p.page_title, l.tl_title as template,
      l.tl_title || (case p.page_lang when 'es' then ' (Español)' when 'fr' then ' (Français)' else ' (Čeština)' end) as localized
    from @templatelinks l join @page p on p.page_id = l.tl_from
    where l.tl_namespace = 10 and not p.page_is_redirect and p.page_lang <> 'en'
      and l.tl_title in (select page_title from linked) and {language('l.tl_title')} = 'English'
      and not contains(l.tl_title, '/'))
  select * from used where localized in (select page_title from linked)""")
def unused_localized_templates(cat):
    return Q.unused_localized_templates(cat)


@query("q24_table_differences", """
  select rc_id, case when rc_timestamp < '2024-01-05' then 'only left' when rc_timestamp >= '2024-01-25' then 'only right'
         else 'differs' end as status,
         case when rc_timestamp < '2024-01-05' or rc_timestamp >= '2024-01-25' then ''
              when rc_new_len % 3 = 0 then 'rc_new_len,rc_comment' else 'rc_comment' end as columns
  from @recentchanges where rc_timestamp < '2024-01-05' or rc_timestamp >= '2024-01-25'
    or rc_new_len % 3 = 0 or rc_minor""")
def table_differences(cat):
    rows = cat["recentchanges"].select(
        "rc_id", "rc_timestamp", "rc_new_len", "rc_comment", "rc_minor", F.array("rc_type", "rc_title").alias("parts")
    )
    mirror = rows.where("rc_timestamp < '2024-01-25'")
    source = rows.where("rc_timestamp >= '2024-01-05'").withColumns({
        "rc_new_len": F.when(F.col("rc_new_len") % 3 == 0, F.col("rc_new_len") + 1).otherwise(F.col("rc_new_len")),
        "rc_comment": F.when(F.col("rc_minor") | (F.col("rc_new_len") % 3 == 0), F.lit("other")).otherwise(F.col("rc_comment")),
        "parts": F.reverse("parts"), "rc_timestamp": F.lit("2024-01-31").cast("timestamp_ntz"),
    })
    return Q.compare(mirror, source, ["rc_id"], ignore=["rc_timestamp"])


# dataset -> a number per row that decides what happens to it, and the text that changes
_MIRRORED = {
    "pages": ("page_id", "page_title"), "revisions": ("rev_id", "rev_comment"), "deleted revisions": ("ar_rev_id", "ar_comment"),
    "recent changes": ("rc_id", "rc_comment"), "log events": ("log_id", "log_comment"), "users": ("user_id", "user_name"),
    "blocks": ("ipb_id", None), "protected titles": ("length(pt_title)", "pt_level"),
    "tags": ("length(tag_name)", "tag_displayname"), "namespaces": ("nss_id + 20", "nss_name"),
    "interwiki prefixes": ("length(iw_prefix)", "iw_url"), "redirects": ("rd_from", "rd_title"),
    "sections": ("sec_page + sec_number", "sec_title"), "category members": ("cl_from", "cl_sortkey_prefix"),
    "language links": ("ll_from", "ll_title"), "page links": ("pl_from", None), "template links": ("tl_from", None),
    "image links": ("il_from", None), "external links": ("el_from", None), "page properties": ("pp_page", "pp_value"),
}


def _mirror_sql() -> str:
    parts = []
    for dataset, (number, text) in _MIRRORED.items():
        table, key, _ = Q.MIRROR_CHECKS[dataset]
        name = " || '/' || ".join(f"cast({x} as varchar)" for x in key)
        changed = f"{number} % 3 = 0 and {text} is not null" if text else "false"
        parts.append(f"""select '{dataset}' as dataset, {name} as key, status, case when status = 'differs' then '{text}' else '' end as columns
          from (select *, case when {number} % 7 = 0 then (case when {number} % 5 <> 0 then 'only right' end)
            when {number} % 5 = 0 then 'only left' when {changed} then 'differs' end as status from @{table}) t where status is not null""")
    return " union all ".join(parts)


def _landed(cat, names):
    """Tables by name, each worked out and written once; a comparison reads either side for its digests and for its rows."""
    ensure_checkpoint_dir(cat.spark)
    tables = {name: cat[name] for name in names}
    land = inheritable_thread_target(cat.spark)(lambda name: Generations(cat.spark).append(tables[name]))
    # no table waits for the last tasks of another
    with ThreadPool(4) as pool:
        return dict(zip(tables, pool.map(land, tables, 1), strict=True))


@query("q24_mirror", _mirror_sql())
def mirror(cat):
    left, right = {}, {}
    tables = _landed(cat, [Q.MIRROR_CHECKS[dataset][0] for dataset in _MIRRORED])
    for dataset, (number, text) in _MIRRORED.items():
        table, _, ignore = Q.MIRROR_CHECKS[dataset]
        rows = tables[table]
        left[table] = rows.where(f"{number} % 7 <> 0")
        right[table] = rows.where(f"{number} % 5 <> 0").drop(*ignore)
        if text:
            new = F.when(F.expr(f"{number} % 3 = 0"), F.concat(text, F.lit("!"))).otherwise(F.col(text))
            right[table] = right[table].withColumn(text, new)
    return Q.mirror_differences(MemoryCatalog(cat.spark, left), MemoryCatalog(cat.spark, right))


@query("j16_outer_comparison", """
  select ar_rev_id as rev, case when r.rev_id is null then 'only left' else 'only right' end as status
  from (select ar_rev_id from @archive) a full join (select rev_id from @revision) r on r.rev_id = a.ar_rev_id
  where a.ar_rev_id is not null
  union all select rev_id, 'only right' from @revision""")
def outer_comparison(cat):
    left = cat["archive"].select(F.col("ar_rev_id").alias("rev"), "ar_user_text")
    right = cat["revision"].select(F.col("rev_id").alias("rev"))
    return Q.compare(left, right, ["rev"]).select("rev", "status")


# ---- plain join kinds ---------------------------------------------------------------------


@query("j01_inner_join", """
  select r.rev_id, p.page_title, n.nss_name from @revision r join @page p on p.page_id = r.rev_page
  join @namespace_starname n on n.nss_id = p.page_namespace""")
def inner_join(cat):
    names = cat["namespace_starname"]
    return cat["revision"].join(cat["page"], F.col("rev_page") == F.col("page_id")).join(
        names, F.col("page_namespace") == F.col("nss_id")).select("rev_id", "page_title", "nss_name")


@query("j02_left_join", """
  select r.rc_id, n.nss_name from @recentchanges r left join @namespace_starname n on n.nss_id = r.rc_namespace""")
def left_join(cat):
    return with_namespace(cat["recentchanges"], cat, "rc_namespace").select("rc_id", "nss_name")


@query("j03_composite_join", """
  select l.log_id, p.page_id from @logging l left join @page p
    on p.page_namespace = l.log_namespace and p.page_title = l.log_title""")
def composite_join(cat):
    on = (F.col("log_namespace") == F.col("page_namespace")) & (F.col("log_title") == F.col("page_title"))
    return cat["logging"].join(cat["page"], on, "left").select("log_id", "page_id")


@query("j04_constant_side", """
  select l.il_from, p.page_id as file_page from @imagelinks l join @page p on p.page_namespace = 6 and p.page_title = l.il_to""")
def constant_side(cat):
    files = cat["page"].where("page_namespace = 6").select(F.col("page_id").alias("file_page"), "page_title")
    return cat["imagelinks"].join(files, F.col("il_to") == F.col("page_title")).select("il_from", "file_page")


@query("j05_self_join", """
  select s.page_id as source, t.page_id as target from @pagelinks l join @page s on s.page_id = l.pl_from
  join @page t on t.page_namespace = l.pl_namespace and t.page_title = l.pl_title""")
def self_join(cat):
    source = cat["page"].select(F.col("page_id").alias("source"))
    target = cat["page"].select(F.col("page_id").alias("target"), "page_namespace", "page_title")
    on = (F.col("pl_namespace") == F.col("page_namespace")) & (F.col("pl_title") == F.col("page_title"))
    return cat["pagelinks"].join(source, F.col("pl_from") == F.col("source")).join(target, on).select("source", "target")


@query("j06_aggregated_side", """
  select r.rev_id, coalesce(g.n, 0) as tags from @revision r
  left join (select tgrev_rev_id, count(*) as n from @tagged_revision group by 1) g on g.tgrev_rev_id = r.rev_id""")
def aggregated_side(cat):
    counts = cat["tagged_revision"].groupBy(F.col("tgrev_rev_id").alias("rev_id")).agg(F.count(F.lit(1)).alias("tags"))
    return cat["revision"].select("rev_id").join(counts, "rev_id", "left").na.fill(0, ["tags"])
