"""Queries for redirects, category trees and translation families (R)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorekeep.operators import families as T
from lorekeep.operators import graph as G
from lorekeep.plans.registry import query

EDGES = """(select s.page_namespace as src_ns, s.page_title as src_title, r.rd_namespace as dst_ns, r.rd_title as dst_title,
    nullif(r.rd_fragment, '') as fragment
  from @redirect r join @page s on s.page_id = r.rd_from
  where r.rd_interwiki is null and r.rd_namespace is not null
    and (r.rd_namespace, r.rd_title) in (select page_namespace, page_title from @page))"""

RESOLVED_CTE = f"""edges as {EDGES},
  walk as (
    select src_ns, src_title, dst_ns, dst_title, fragment, [src_ns || ':' || src_title] as path from edges
    union all
    select w.src_ns, w.src_title, e.dst_ns, e.dst_title, coalesce(e.fragment, w.fragment),
           list_append(w.path, e.src_ns || ':' || e.src_title)
    from walk w join edges e on e.src_ns = w.dst_ns and e.src_title = w.dst_title
    where not list_contains(w.path, e.src_ns || ':' || e.src_title)),
  resolved as (
    select s.src_ns, s.src_title, w.dst_ns, w.dst_title, w.fragment from edges s
    left join (select * from walk x where not exists (
        select 1 from edges e where e.src_ns = x.dst_ns and e.src_title = x.dst_title)) w
      on w.src_ns = s.src_ns and w.src_title = s.src_title)"""


@query("r01_redirect_edges", f"select * from {EDGES} e where src_ns in (0, 4, 12) and dst_ns in (0, 10, 14)")
def redirect_edges(cat):
    return G.redirect_edges(cat, {0, 4, 12}, {0, 10, 14})


@query("r02_resolved_redirects", f"with recursive {RESOLVED_CTE} select * from resolved")
def resolved_redirects(cat):
    return G.resolve_redirects(G.redirect_edges(cat))


@query("r03_double_redirects", f"""
  with edges as {EDGES}
  select a.src_ns, a.src_title, a.dst_ns as via_ns, a.dst_title as via_title, b.dst_ns, b.dst_title
  from edges a join edges b on b.src_ns = a.dst_ns and b.src_title = a.dst_title""")
def double_redirects(cat):
    return G.double_redirects(G.redirect_edges(cat))


CATS = """(select distinct k.cl_to as parent, p.page_title as child from @categorylinks k
  join @page p on p.page_id = k.cl_from where p.page_namespace = 14)"""
CHILDREN = f"""(select parent, child, row_number() over (partition by parent order by lower(child), child) as place
  from {CATS} c)"""
WALK_CTE = f"""children as {CHILDREN},
  tree as (
    select child as category, parent, ['Top', child] as path, [place] as levels from children where parent = 'Top'
    union all
    select c.child, c.parent, list_append(t.path, c.child), list_append(t.levels, c.place)
    from tree t join children c on c.parent = t.category where not list_contains(t.path, c.child))"""
INFO = """(select coalesce(k.category, p.page_title) as category, coalesce(k.pages, 0) as pages,
    coalesce(k.subcats, 0) as subcats, coalesce(k.files, 0) as files,
    coalesce(k.pages, 0) + coalesce(k.subcats, 0) + coalesce(k.files, 0) as size
  from (select cl_to as category, count(*) filter (cl_type = 'page') as pages,
               count(*) filter (cl_type = 'subcat') as subcats, count(*) filter (cl_type = 'file') as files
        from @categorylinks group by 1) k
  full join (select page_title from @page where page_namespace = 14) p on p.page_title = k.category)"""


@query("r04_category_edges", """
  select k.cl_to as parent, p.page_title as child from @categorylinks k
  join @page p on p.page_id = k.cl_from where p.page_namespace = 14""")
def category_edges(cat):
    return G.category_edges(cat)


@query("a16_category_sizes", f"select * from {INFO} i")
def category_sizes(cat):
    return G.category_info(cat)


@query("w12_sibling_places", f"select parent, child, place from {CHILDREN} c")
def sibling_places(cat):
    return G.ordered_children(G.category_edges(cat))


@query("r05_category_tree", f"""
  with recursive {WALK_CTE}
  select category, parent, array_to_string(path, '/') as path, array_to_string(levels, '.') as levels,
         cast(len(levels) as integer) as depth from tree""")
def category_tree(cat):
    tree = G.walk_tree(G.category_edges(cat), "Top")
    return tree.withColumn("path", F.array_join("path", "/")).withColumn(
        "levels", F.array_join(F.transform("levels", lambda x: x.cast("string")), ".")
    )


_PURE = ("(case " + " ".join(
    "when {x} like '% (" + name + ")' then replace({x}, ' (" + name + ")', '')" for name in ("Español", "Français", "Čeština")
) + " else {x} end)")
_LANG = ("(case when {x} like '% (Español)' then 'Español' when {x} like '% (Français)' then 'Français' "
         "when {x} like '% (Čeština)' then 'Čeština' else 'English' end)")


def pure(x: str) -> str:
    return _PURE.format(x=x)


def language(x: str) -> str:
    return _LANG.format(x=x)


@query("r06_compared_trees", f"""
  with recursive children as {CHILDREN},
  tree as (
    select parent as root, child as category, [parent, child] as path from children
    where parent in ('AFRICA', 'AMERICA')
    union all
    select t.root, c.child, list_append(t.path, c.child)
    from tree t join children c on c.parent = t.category where not list_contains(t.path, c.child)),
  keyed as (select root, category, len(path) - 1 as depth,
                   array_to_string(list_transform(path[2:], lambda x: {pure('x')}), '/') as path from tree)
  select coalesce(a.path, b.path) as path, cast(coalesce(a.depth, b.depth) as integer) as depth,
         a.category as "left", b.category as "right"
  from (select * from keyed where root = 'AFRICA') a
  full join (select * from keyed where root = 'AMERICA') b on a.path = b.path""")
def compared_trees(cat):
    edges = G.category_edges(cat)
    return G.compare_trees(G.walk_tree(edges, "AFRICA"), G.walk_tree(edges, "AMERICA"))


@query("r07_other_parents", f"""
  with recursive {WALK_CTE}
  select t.category, t.parent, c.parent as other from (select distinct category, parent from tree) t
  join {CATS} c on c.child = t.category where c.parent <> t.parent""")
def other_parents(cat):
    edges = G.category_edges(cat)
    return G.other_parents(edges, G.walk_tree(edges, "Top"))


@query("r08_contents_rows", f"""
  with recursive {WALK_CTE},
  also as (select t.category, t.parent, string_agg(distinct {pure('c.parent')}, ', ' order by {pure('c.parent')}) as also_in
           from (select distinct category, parent from tree) t join {CATS} c on c.child = t.category
           where c.parent <> t.parent group by 1, 2)
  select t.category, t.parent, cast(len(t.levels) as integer) as depth, array_to_string(t.levels, '.') as label,
         coalesce(i.pages, 0) as pages, a.also_in,
         repeat(' ', len(t.levels) * 4) || array_to_string(t.levels, '.') || ' ' || {pure('t.category')}
           || ' (' || coalesce(i.pages, 0) || ')' || coalesce(' (also in ' || a.also_in || ')', '') as line
  from tree t left join {INFO} i on i.category = t.category
  left join also a on a.category = t.category and a.parent = t.parent""")
def contents_rows(cat):
    edges = G.category_edges(cat)
    return G.contents_rows(edges, G.walk_tree(edges, "Top"), G.category_info(cat)).drop("levels")


@query("r09_wanted_categories", """
  select cl_to as category, count(*) as members from @categorylinks
  where cl_to not in (select page_title from @page where page_namespace = 14) group by 1""")
def wanted_categories(cat):
    return G.wanted_categories(cat)


def _in_language(title: str, name: str) -> str:
    parts = f"list_transform(string_split({title}, '/'), lambda y: y || ' (' || {name} || ')')"
    return f"array_to_string({parts}, '/')"


@query("r09_categories_to_create", f"""
  with recursive existing as (select page_title as name from @page where page_namespace = 14),
  wanted as (select distinct cl_to as category from @categorylinks where cl_to not in (select name from existing)),
  plan as (
    select w.category, c.parent as local_parent, {language('w.category')} as lang
    from wanted w join existing e on e.name = {pure('w.category')} left join {CATS} c on c.child = e.name
    where {language('w.category')} <> 'English'
    union
    select x.category, c.parent, x.lang
    from (select {_in_language(pure('p.local_parent'), 'p.lang')} as category, p.lang, {pure('p.local_parent')} as name
          from plan p where p.local_parent is not null) x
    join existing e on e.name = x.name left join {CATS} c on c.child = e.name
    where x.category not in (select name from existing))
  select distinct category, {_in_language(pure('local_parent'), 'lang')} as parent from plan""")
def categories_to_create(cat):
    return G.localized_categories_to_create(cat)


@query("r10_unused_categories", """
  select page_id, page_title from @page where page_namespace = 14
    and page_title not in (select cl_to from @categorylinks)""")
def unused_categories(cat):
    return G.unused_categories(cat)


@query("r11_recategorization", f"""
  select k.cl_from as page_id, k.cl_to as source, e.dst_ns as target_ns, e.dst_title as target
  from @categorylinks k join {EDGES} e on e.src_ns = 14 and e.src_title = k.cl_to""")
def recategorization(cat):
    return G.recategorization(cat)


_TAG = ("(case {x} when 'Español' then 'es' when 'Français' then 'fr' when 'Čeština' then 'cs' "
        "when 'Deutsch' then 'de' else 'en' end)")
_NAME = "(case {x} when 'es' then 'Español' when 'fr' then 'Français' when 'cs' then 'Čeština' when 'de' then 'Deutsch' end)"


def _localize(title: str, tag: str, every_part: bool = True) -> str:
    name = _NAME.format(x=tag)
    parts = f"array_to_string(list_transform(string_split({title}, '/'), lambda y: y || ' (' || {name} || ')'), '/')"
    whole = f"{title} || ' (' || {name} || ')'"
    return (f"(case when {tag} = 'en' then {title} when {tag} <> 'de' and contains({title}, '/') then "
            f"{parts if every_part else whole} else {whole} end)")


PAGES = f"""(select p.page_id, case when n.nss_name = '' then p.page_title else n.nss_name || ':' || p.page_title end as full_title
  from @page p join @namespace_starname n on n.nss_id = p.page_namespace
  where not p.page_is_redirect and p.page_namespace in (0, 4, 10, 12, 14))"""
FAMILY_CTE = f"""pages as (select page_id, full_title, {pure('full_title')} as pure, {language('full_title')} as language,
      {_TAG.format(x=language('full_title'))} as tag from {PAGES} q),
  clashes as (select lower(pure) as k from pages group by 1 having count(*) <> count(distinct tag)),
  members as (select p.*, case when c.k is null then lower(p.pure) else p.pure end as family
              from pages p left join clashes c on c.k = lower(p.pure))"""


@query("r12_families", f"with {FAMILY_CTE} select page_id, full_title, pure, language, tag, family from members")
def families(cat):
    return T.group_families(T.content_pages(cat))


LINKS_CTE = RESOLVED_CTE + f""",
  {FAMILY_CTE},
  targets as (select case when a.nss_name = '' then r.src_title else a.nss_name || ':' || r.src_title end as full_title,
                     case when b.nss_name = '' then r.dst_title else b.nss_name || ':' || r.dst_title end as resolved
              from resolved r join @namespace_starname a on a.nss_id = r.src_ns
              join @namespace_starname b on b.nss_id = r.dst_ns where r.dst_title is not null),
  links as (
    select page_id, tag, title,
           case when tag = 'de' then 'external'
                when {_localize('title', 'tag')} in (select full_title from pages)
                  or (contains(title, '/') and {_localize('title', 'tag', False)} in (select full_title from pages))
                then 'internal' else 'invalid' end as kind
    from (select l.ll_from as page_id, l.ll_lang as tag,
                 case when l.ll_lang = 'de' then l.ll_title
                      else {pure("coalesce(t.resolved, " + _localize('l.ll_title', 'l.ll_lang') + ")")} end as title
          from @langlinks l join pages p on p.page_id = l.ll_from
          left join targets t on t.full_title = {_localize('l.ll_title', 'l.ll_lang')}) x),
  pulled as (select l.*, m.family, m.full_title from links l join members m on m.page_id = l.page_id),
  base as (
    select family, tag, arg_min(title, rank) as title, min(rank[1]) as stage from (
      select family, tag, pure as title, ['0', full_title, ''] as rank from members
      union all
      select family, tag, title, ['1', full_title, title] from pulled where kind = 'internal') z group by 1, 2),
  english as (select b.family, b.stage, b.title as en_title, m.page_id as en_id, m.family as en_family
              from base b join members m on m.tag = 'en' and m.full_title = b.title where b.tag = 'en'),
  with_en as (
    select family, tag, arg_min(title, rank) as title from (
      select family, tag, title, ['0', '', ''] as rank from base
      union all
      select e.family, l.tag, l.title, ['2', e.en_title, l.title] from english e
      join links l on l.page_id = e.en_id and l.kind <> 'invalid') z group by 1, 2),
  without_en as (
    select family, tag, arg_min(title, rank) as title from (
      select family, tag, title, ['0', '', ''] as rank from base
      union all
      select family, tag, title, ['2', full_title, title] from pulled where kind = 'external') z group by 1, 2),
  masters as (
    select m.page_id, m.family, m.tag, m.pure, e.en_family is not null and (e.stage = '0'
        or exists (select 1 from with_en w where w.family = e.en_family and w.title = m.pure)
        or not exists (select 1 from with_en w where w.family = e.en_family and w.tag = m.tag)) as joined
    from members m left join english e on e.family = m.family),
  completed as (
    select m.page_id, m.family, w.tag, w.title from masters m join with_en w on w.family = m.family where m.joined
    union all
    select m.page_id, m.family, w.tag, w.title from masters m join without_en w on w.family = m.family
    where not m.joined),
  new_links as (
    select c.page_id, c.tag, case when {_localize('c.title', 'c.tag')} in (select full_title from pages)
             and contains(c.title, '/') and c.tag not in ('en', 'de')
             then regexp_replace({_localize('c.title', 'c.tag')}, ' \\([^()]*\\)$', '') else c.title end as title
    from completed c join members m on m.page_id = c.page_id where not (c.tag = m.tag and c.title = m.pure))"""


def _new_links(cat):
    members, completed = T.complete_families(cat)
    pages = T.content_pages(cat)
    return members, pages, T.language_links(members, completed, pages)


@query("r13_completed_families", f"with recursive {LINKS_CTE} select page_id, family, tag, title from completed")
def completed_families(cat):
    return T.complete_families(cat)[1]


@query("r14_language_links", f"with recursive {LINKS_CTE} select page_id, tag, title from new_links")
def language_links(cat):
    return _new_links(cat)[2]


@query("r15_changed_language_links", f"""
  with recursive {LINKS_CTE},
  n as (select page_id, string_agg(tag || ':' || title, '|' order by tag || ':' || title) as t from new_links group by 1),
  o as (select ll_from, string_agg(ll_lang || ':' || ll_title, '|' order by ll_lang || ':' || ll_title) as t
        from @langlinks group by 1)
  select m.page_id, m.full_title, coalesce(n.t, '') as new_links, coalesce(o.t, '') as old_links
  from members m left join n on n.page_id = m.page_id left join o on o.ll_from = m.page_id
  where coalesce(n.t, '') <> coalesce(o.t, '')""")
def changed_language_links(cat):
    members, _, new = _new_links(cat)
    return T.changed_language_links(cat, members, new)


@query("r16_orphans", f"""
  with recursive {LINKS_CTE} select page_id, full_title from members where tag <> 'en'
    and page_id not in (select page_id from new_links)""")
def orphans(cat):
    members, _, new = _new_links(cat)
    return T.orphans(members, new)


@query("r17_rename_suggestions", f"""
  with recursive {LINKS_CTE}
  select l.title || ' (' || {_NAME.format(x='l.tag')} || ')' as source,
         m.full_title || ' (' || {_NAME.format(x='l.tag')} || ')' as target
  from new_links l join members m on m.page_id = l.page_id
  where m.tag = 'en' and m.full_title like 'Category:%' and l.tag <> 'de' and l.title <> m.full_title
    and m.full_title || ' (' || {_NAME.format(x='l.tag')} || ')' not in (select full_title from pages)""")
def rename_suggestions(cat):
    members, pages, new = _new_links(cat)
    return T.rename_suggestions(members, new, pages)
