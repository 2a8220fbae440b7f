"""Queries for link extraction (X) and the joins and windows it uses (J-13, J-14, W-13, W-16, A-20)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorekeep.functions import markup as M
from lorekeep.operators import external as E
from lorekeep.operators import extract as X
from lorekeep.plans.registry import query
from lorekeep.sources.sample import TODAY


def _upper_first(x: str) -> str:
    return f"((case when substr({x}, 1, 1) = 'ß' then 'SS' else upper(substr({x}, 1, 1)) end) || substr({x}, 2))"


def _wikitext(cat):
    return cat["wikitext"].select(
        "page_id", F.col("namespace").alias("page_namespace"), F.col("title").alias("page_title"), "body", "url"
    )


STALE = """(select p.page_id, p.page_namespace, p.page_title from @page p
  left join @ws_parser_cache_sync s on s.wspc_page_id = p.page_id
  where s.wspc_rev_id is null or s.wspc_rev_id <> p.page_latest)"""
TODO = f"""(select page_id from {STALE} s
  union select l.tl_from from @templatelinks l join {STALE} s
    on s.page_namespace = l.tl_namespace and s.page_title = l.tl_title
  where l.tl_from in (select page_id from @page))"""


@query("x01_stale_pages", f"select * from {STALE} s")
def stale_pages(cat):
    return X.stale_pages(cat)


@query("x02_pages_to_extract", f"select page_id from {TODO} t")
def pages_to_extract(cat):
    return X.pages_to_extract(cat)


@query("u07_invalidated_union", f"select count(*) as pages from {TODO} t")
def invalidated_union(cat):
    return X.pages_to_extract(cat).agg(F.count(F.lit(1)).alias("pages"))


@query("x03_dropped_rows", "with todo as " + TODO + " " + " union all ".join(
    f"select '{t}' as tbl, count(*) as n from @{t} where {c} not in (select page_id from todo)"
    for t, c in X.CASCADES.items() if t not in ("page_props", "page_restrictions", "ws_parser_cache_sync")))
def dropped_rows(cat):
    out = None
    for table, df in X.drop_derived(cat, X.pages_to_extract(cat)).items():
        part = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(table).alias("tbl"), "n")
        out = part if out is None else out.unionByName(part)
    return out


@query("x10_recorded", f"""
  select coalesce(p.page_id, s.wspc_page_id) as wspc_page_id, coalesce(p.page_latest, s.wspc_rev_id) as wspc_rev_id
  from @ws_parser_cache_sync s full join (select * from @page where page_id in (select page_id from {TODO} t)) p
    on p.page_id = s.wspc_page_id""")
def recorded(cat):
    return X.record_extracted(cat, X.pages_to_extract(cat))


@query("x11_forced_pages", "select page_id from @page where page_id in (select pl_from from @pagelinks)")
def forced_pages(cat):
    return X.forced_pages(cat, cat["pagelinks"].select(F.col("pl_from").alias("page_id")))


LINKS = rf"""(select page_id, title as own, m[1] as raw, m[2] as label, place, body[1:9] = '#REDIRECT' as is_redirect from (
    select page_id, title, body, unnest(list_zip(regexp_extract_all(body, '\[\[([^\[\]{{}}|\n]+)(\|[^\[\]]*)?\]\]', 1),
        regexp_extract_all(body, '\[\[([^\[\]{{}}|\n]+)(\|[^\[\]]*)?\]\]', 2))) as m,
      generate_subscripts(regexp_extract_all(body, '\[\[([^\[\]{{}}|\n]+)(\|[^\[\]]*)?\]\]', 1), 1) - 1 as place
    from @wikitext) l)"""
PARSED = f"""(select page_id, own, place, case when label = '' then null else substr(label, 2) end as label,
    case when starts_with(raw, 'Category:') then 'category' when starts_with(raw, 'de:') then 'language'
         when starts_with(raw, 'File:') then 'image' when starts_with(raw, 's1:') then 'interwiki'
         when name = own and section = '' then 'skip' else 'page' end as kind, name, section
  from (select *, {_upper_first("regexp_replace(split_part(raw, '#', 1), '^(Category|de|File|s1):', '')")} as name,
          case when contains(raw, '#') then substr(raw, instr(raw, '#') + 1) else '' end as section from {LINKS} k) p)"""


@query("x04_wikilinks", f"select page_id, cast(place as integer) as position, kind, name as pagename, section as sectionname, label from {PARSED} p")
def wikilinks(cat):
    return X.wikilinks(cat, _wikitext(cat)).select("page_id", "position", "kind", "pagename", "sectionname", "label")


@query("x04_link_tables", f"""
  select distinct 'pagelinks' as tbl, page_id, '0' as ns, name as title from {PARSED} p where kind = 'page'
  union all select distinct 'imagelinks', page_id, '', name from {PARSED} p where kind = 'image'
  union all select distinct 'langlinks', page_id, 'de', arg_max(name, place) from {PARSED} p where kind = 'language' group by page_id
  union all select distinct 'iwlinks', page_id, 's1', name from {PARSED} p where kind = 'interwiki'
  union all select distinct 'categorylinks', page_id, upper(own), name from {PARSED} p where kind = 'category'""")
def link_tables(cat):
    t = X.link_tables(X.wikilinks(cat, _wikitext(cat)))

    def rows(table, page, ns, title):
        return t[table].select(F.lit(table).alias("tbl"), F.col(page).alias("page_id"), ns.alias("ns"), F.col(title).alias("title"))

    return (
        rows("pagelinks", "pl_from", F.col("pl_namespace").cast("string"), "pl_title")
        .union(rows("imagelinks", "il_from", F.lit(""), "il_to"))
        .union(rows("langlinks", "ll_from", F.col("ll_lang"), "ll_title"))
        .union(rows("iwlinks", "iwl_from", F.col("iwl_prefix"), "iwl_title"))
        .union(rows("categorylinks", "cl_from", F.col("cl_sortkey"), "cl_to"))
    )


_NESTED = """(select page_id, namespace, title, url, '[[File:Map ' || cast(page_id as string)
    || '.png|thumb|near [[Inner ' || cast(page_id as string) || '|inner]] and [http://maps.example.org/' || cast(page_id as string)
    || ' a map]]] <!-- [[Gone]] {{Gone}} http://gone.example.org/ --><nowiki>[[No]] {{No}}</nowiki> {{{1|x}}} {{Box|{{{name}}}|'
    || 'y={{Inside}}}} [[Open|never closed' as body from @wikitext)"""


@query("x04_nested_markup", """
  select page_id, k.kind, replace(k.name, '#', cast(page_id as varchar)) as name from @wikitext,
    (values ('image', 'Map #.png'), ('page', 'Inner #'), ('template', 'Box'), ('template', 'Inside'),
            ('url', 'http://maps.example.org/#')) k(kind, name)""")
def nested_markup(cat):
    pages = cat.sql(f"select page_id, namespace as page_namespace, title as page_title, body from {_NESTED}")
    links = X.wikilinks(cat, pages).select("page_id", "kind", F.col("pagename").alias("name"))
    templates = X.transclusions(cat, pages).select(F.col("tl_from").alias("page_id"), F.lit("template").alias("kind"), "tl_title")
    urls = X.external_links(pages).select("el_from", F.lit("url"), "el_to")
    return links.union(templates).union(urls)


@query("x05_external_links", r"""
  select distinct page_id as el_from, unnest(regexp_extract_all(body, 'https?://[^\s\[\]<>"{}|]+')) as el_to from @wikitext""")
def external_links(cat):
    return X.external_links(_wikitext(cat))


_DEEP = """(select page_id, namespace as page_namespace, title as page_title, '<nowiki/>[[File:M ' || cast(page_id as string)
    || '.png|thumb|one [[L ' || cast(page_id as string) || '|two [[M ' || cast(page_id as string) || '|three [[N '
    || cast(page_id as string) || ']] ]] ]] ]] [[R&amp;D ' || cast(page_id as string) || '|a&#61;b]] <nowiki>[[no]]</nowiki>'
    || '<math>{{no}}</math> {{{1|{{P}}}}} {{Q|x={{R|[[O ' || cast(page_id as string) || ']]}}}}'
    || ' http://b.example.org/' || cast(page_id as string) || '_(c) (see http://d.example.org/' || cast(page_id as string)
    || '?a&amp;b).' || '\n== H ==<!-- x -->\n<pre>\n== no ==\n</pre>\n= <nowiki>=</nowiki> =\n== h ==' as body from @wikitext)"""


def _deep(cat):
    return cat.sql(f"select * from {_DEEP}")


@query("x04_deep_captions", """
  select page_id, cast(k.position as integer) as position, k.kind, replace(k.name, '#', cast(page_id as varchar)) as pagename, k.label
  from @wikitext, (values (0, 'image', 'M #.png', null), (1, 'page', 'L #', null), (2, 'page', 'M #', null),
    (3, 'page', 'N #', null), (4, 'page', 'R&D #', 'a=b'), (5, 'page', 'O #', null)) k(position, kind, name, label)""")
def deep_captions(cat):
    return X.wikilinks(cat, _deep(cat)).select("page_id", "position", "kind", "pagename", "label")


@query("x05_urls_in_brackets", """
  select page_id as el_from, replace(u, '#', cast(page_id as varchar)) as el_to from @wikitext,
    (values ('http://b.example.org/#_(c)'), ('http://d.example.org/#?a&b')) k(u)""")
def urls_in_brackets(cat):
    return X.external_links(_deep(cat))


@query("x06_protected_headings", """
  select page_id as sec_page, cast(n as integer) as sec_number, cast(l as integer) as sec_level, t as sec_title, a as sec_anchor
  from @wikitext, (values (1, 2, 'H', 'H'), (2, 1, '<nowiki>=</nowiki>', '.3D'), (3, 2, 'h', 'h_2')) k(n, l, t, a)""")
def protected_headings(cat):
    return X.sections(_deep(cat))


@query("x08_deep_transclusions", """
  select page_id as tl_from, cast(10 as integer) as tl_namespace, k.name as tl_title from @wikitext,
    (values ('P'), ('Q'), ('R')) k(name)""")
def deep_transclusions(cat):
    return X.transclusions(cat, _deep(cat))


_HEADS = r"""(select page_id, list_filter(string_split(body, chr(10)), lambda x: regexp_matches(x, '^={1,6}[^=].*=\s*$')) as lines
  from @wikitext)"""
_TITLES = rf"""(select page_id, list_transform(lines, lambda x: trim(regexp_replace(regexp_replace(x, '^=+\s*', ''), '\s*=+\s*$', ''))) as titles,
    list_transform(lines, lambda x: length(regexp_extract(x, '^=+'))) as levels from {_HEADS} h where len(lines) > 0)"""
_ENCODE = r"""list_transform(string_split({x}, ''), lambda c: case when regexp_full_match(c, '[A-Za-z0-9_.:-]') then c
    when c = ' ' then '_' else regexp_replace(hex(c), '(..)', '.\1', 'g') end)"""
_ANCHORS = rf"""(select page_id, titles, levels, list_transform(titles, lambda t: array_to_string({_ENCODE.format(
    x="regexp_replace(replace(replace(t, '&amp;', '&'), '&quot;', '\"'), ' +', ' ', 'g')")}, '')) as base from {_TITLES} t)"""
_UNIQUE = f"""(select page_id, titles, levels, list_reduce(list_transform(base, lambda b: [b]),
    lambda acc, y: list_append(acc, case when list_contains(list_transform(acc, lambda a: lower(a)), lower(y[1]))
      then list_filter(list_transform(range(2, len(acc) + 3), lambda j: y[1] || '_' || j),
                       lambda z: not list_contains(list_transform(acc, lambda a: lower(a)), lower(z)))[1]
      else y[1] end)) as anchors from {_ANCHORS} a)"""


@query("x06_sections", f"""
  select page_id as sec_page, cast(n as integer) as sec_number, cast(levels[n] as integer) as sec_level,
         titles[n] as sec_title, anchors[n] as sec_anchor
  from (select *, unnest(range(1, len(titles) + 1)) as n from {_UNIQUE} u) r""")
def sections(cat):
    return X.sections(_wikitext(cat))


@query("w13_unique_anchors", """
  with recursive items as (
    select conv_id, turn, role as base, row_number() over (partition by conv_id order by turn) as n from @conversations),
  fold as (
    select conv_id, n, [base] as done from items where n = 1
    union all
    select f.conv_id, i.n, list_append(f.done, case when list_contains(f.done, i.base)
      then list_filter(list_transform(range(2, len(f.done) + 3), lambda j: i.base || '_' || j),
                       lambda z: not list_contains(f.done, z))[1] else i.base end)
    from fold f join items i on i.conv_id = f.conv_id and i.n = f.n + 1)
  select conv_id, array_to_string(arg_max(done, n), ',') as anchors from fold group by 1""")
def unique_anchors(cat):
    # a conversation stands for a talk page: one heading per turn, named by the role
    roles = cat["conversations"].groupBy("conv_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]).alias("roles")
    )
    return roles.select("conv_id", F.array_join(M.unique_anchors(F.col("roles")), ",").alias("anchors"))


@query("x07_redirects", f"""
  select page_id as rd_from, cast(0 as integer) as rd_namespace, {_upper_first("split_part(target, '#', 1)")} as rd_title,
         cast(null as varchar) as rd_interwiki, nullif(split_part(target, '#', 2), '') as rd_fragment
  from (select page_id, regexp_extract(body, '^#REDIRECT \\[\\[([^\\]]*)\\]\\]', 1) as target from @wikitext
        where starts_with(body, '#REDIRECT')) r where target <> ''""")
def redirects(cat):
    return X.redirects(cat, _wikitext(cat))


@query("x08_transclusions", r"""
  select distinct page_id as tl_from, cast(10 as integer) as tl_namespace, name as tl_title from (
    select page_id, trim(unnest(regexp_extract_all(body, '\{\{([^{}|\[\]\n<>]+)', 1))) as name from @wikitext) t""")
def transclusions(cat):
    return X.transclusions(cat, _wikitext(cat))


@query("x09_transclusion_closure", """
  with recursive reach as (
    select tl_from, tl_namespace, tl_title from @templatelinks
    union
    select r.tl_from, l.tl_namespace, l.tl_title from reach r
    join @page p on p.page_namespace = r.tl_namespace and p.page_title = r.tl_title
    join @templatelinks l on l.tl_from = p.page_id)
  select * from reach""")
def transclusion_closure(cat):
    return X.transclusion_closure(cat["templatelinks"], cat["page"])


# ---- external URLs ------------------------------------------------------------------------

CHECKABLE = r"""(regexp_matches(el_to, '^https?://') and not regexp_matches(el_to, '^https?://[^/?#]*@')
  and contains(regexp_extract(el_to, '^https?://([^/?#:]+)', 1), '.')
  and not regexp_matches(el_to, '^https?://[^/?#:]*\.onion') and not regexp_matches(el_to, '^https?://(10|127)\.'))"""
URLS = rf"""(select distinct regexp_replace(el_to, '#[^#]*$', '') as url from @externallinks where {CHECKABLE})"""
HOST = r"lower(regexp_extract({x}, '^[a-z]+://([^/?#:@]+)', 1))"


@query("a20_distinct_urls", "select distinct el_to from @externallinks")
def distinct_urls(cat):
    return E.distinct_urls(cat["externallinks"])


@query("x12_urls_and_domains", f"select url, {HOST.format(x='url')} as domain_name from {URLS} u")
def urls_and_domains(cat):
    return E.checkable_urls(cat["externallinks"])


@query("x12_domains", f"select distinct {HOST.format(x='url')} as name from {URLS} u")
def domains(cat):
    return E.checkable_urls(cat["externallinks"]).select(F.col("domain_name").alias("name")).distinct()


def _fetched(cat):
    """Landed fetch results; the sample gives status, server and age in days per URL."""
    age = F.make_dt_interval(days=F.col("age_days") * 3)
    today = F.lit(TODAY).cast("timestamp_ntz")
    return cat["url_fetch"].select(
        "url", F.col("http_status").cast("int").alias("http_status"), "text_status", "server",
        (F.length("url") % 10 == 4).alias("captcha"), (F.length("url") % 7 != 0).alias("resolved"),
        F.when(F.length("url") % 2 == 0, today - F.expr("interval 30 minutes")).otherwise(today - age).alias("domain_check"),
        F.when(F.col("age_days") == 0, F.lit(None).cast("timestamp_ntz")).otherwise(today - age).alias("last_check"),
        F.when(F.length("url") % 11 == 0, F.lit("bad certificate")).alias("ssl_error"),
    )


FETCHED = f"""(select *, case when dead then 'bad' when http_status is null and (not resolved or ssl_error is not null) then 'bad'
    when http_status between 200 and 299 then 'OK'
    when http_status between 400 and 499 and captcha then 'needs user check'
    when (http_status = 403 and server = 'cloudflare') or http_status = 429 then 'needs user check'
    when http_status between 400 and 499 then 'bad' else 'needs user check' end as result,
    case when dead then text_status when http_status between 400 and 499 and captcha then 'CloudFlare CAPTCHA'
         when http_status = 403 and server = 'cloudflare' then 'CloudFlare block' else text_status end as note
  from (select *, domain_check > timestamp '{TODAY}' - interval 1 hour and not resolved as dead from (
    select url, cast(http_status as integer) as http_status, text_status, server, length(url) % 10 = 4 as captcha,
           length(url) % 7 <> 0 as resolved, case when length(url) % 2 = 0 then timestamp '{TODAY}' - interval 30 minute
             else timestamp '{TODAY}' - to_days(cast(age_days * 3 as integer)) end as domain_check,
           case when age_days <> 0 then timestamp '{TODAY}' - to_days(cast(age_days * 3 as integer)) end as last_check,
           case when length(url) % 11 = 0 then 'bad certificate' end as ssl_error
    from @url_fetch) f) g)"""


@query("x13_urls_to_check", f"""
  select url from {FETCHED} f where last_check is null or last_check < timestamp '{TODAY}' - interval 7 day
    or http_status in (406, 429)""")
def urls_to_check(cat):
    return E.urls_to_check(_fetched(cat), TODAY).select("url")


@query("x14_classified", f"select url, http_status, note as text_status, result from {FETCHED} f")
def classified(cat):
    return E.classify_fetch(_fetched(cat), TODAY).select("url", "http_status", "text_status", "result")


_DESCRIPTION = """(case when not resolved then 'domain name not resolved' when ssl_error is not null then 'SSL error'
  when http_status is null then note when note is null then cast(http_status as varchar)
  else http_status || ' (' || note || ')' end)"""


@query("x15_descriptions", f"select url, {_DESCRIPTION} as description from {FETCHED} f where result = 'bad'")
def descriptions(cat):
    bad = E.classify_fetch(_fetched(cat), TODAY).where("result = 'bad'")
    return bad.select("url", E.status_description(bad).alias("description"))


@query("q22_dead_links", f"""
  select l.el_from, l.el_to, {_DESCRIPTION} as description from @externallinks l
  join {FETCHED} f on f.url = regexp_replace(l.el_to, '#[^#]*$', '') where f.result = 'bad' and {CHECKABLE}""")
def dead_links(cat):
    return E.dead_links(cat["externallinks"], E.classify_fetch(_fetched(cat), TODAY))


# URLs of the shapes the rewriting rules look for, one per part
_REWRITABLE = """(select p_partkey as id, (case p_partkey % 8
    when 0 then 'https://forum.example.org/en/topic/' || cast(p_partkey as string) || '?page=2'
    when 1 then 'http://www.example.org/about' || cast(p_partkey as string)
    when 2 then 'http://www.example.org/old/Doc' || cast(p_partkey as string)
    when 3 then 'ftp://Files.example.net/pub/' || cast(p_partkey as string)
    when 4 then 'https://talk.example.org/t/' || cast(p_partkey as string)
    when 5 then 'https://other.example.com/' || cast(p_partkey as string) || '?utm_source=a'
    when 6 then 'https://other.example.com/' || cast(p_partkey as string)
    else 'no address ' || cast(p_partkey as string) end) as url from @part)"""
_NEW = r"""(case id % 8
    when 0 then 'https://talk.example.org/t/' || id
    when 1 then 'https://example.org/about' || id
    when 2 then 'https://docs.example.org/doc' || id
    when 3 then 'https://files.example.net/pub/' || id
    when 5 then 'https://other.example.com/' || id end)"""
_URL_RULES = r"""select * from values
    (1, 'forum.example.org', r'https?://forum\.example\.org/[a-z]{2}/topic/(\d+)(\?.*)?', 'https://talk.example.org/t/$1', false, 'forum moved'),
    (2, 'example.org', r'https?://www\.example\.org/old/(.*)', 'https://docs.example.org/$1', true, 'documents moved'),
    (3, 'example.org', r'https?://www\.example\.org(/.*)?', 'https://example.org$1', false, 'bare domain'),
    (4, 'talk.example.org', r'https?://talk\.example\.org/(.*)', 'https://talk.example.org/$1', false, 'encrypted talk'),
    (5, 'example.net', r'ftp://(?i:files)\.example\.net/(.*)', 'https://files.example.net/$1', false, 'no file transfer'),
    (6, null, r'(.*)[?&]utm_source=[^&#]*', '$1', false, 'tracking')
  as rules(priority, host, pattern, replacement, lower, summary)"""


@query("x16_rewritten_urls", f"select id, url, {_NEW} as new_url from {_REWRITABLE} u")
def rewritten_urls(cat):
    urls = cat.sql(f"select * from {_REWRITABLE}")
    found = E.rewrite_urls(urls, cat.sql(_URL_RULES))
    return urls.join(found, "url", "left").select("id", "url", "new_url")


@query("w16_first_rule", f"""
  select case id % 8 when 0 then 'forum moved' when 1 then 'bare domain' when 2 then 'documents moved'
    when 3 then 'no file transfer' when 5 then 'tracking' end as summary, count(*) as urls
  from {_REWRITABLE} u group by 1""")
def first_rule(cat):
    urls = cat.sql(f"select * from {_REWRITABLE}")
    found = E.rewrite_urls(urls, cat.sql(_URL_RULES))
    return urls.join(found, "url", "left").groupBy("summary").agg(F.count(F.lit(1)).alias("urls"))


_PAGE_RULES = r"""select * from values
    (1, null, r'.*[?&]utm_.*', 't', false, 'tracking'), (2, null, r'.*\?.*', 'q', false, 'query'),
    (3, null, '.*#.*', 'f', false, 'fragment'), (4, null, 'http:.*', 'p', false, 'plain')
  as rules(priority, host, pattern, replacement, lower, summary)"""


@query("j14_rule_join", r"""
  select page_id, url, case when regexp_matches(url, '[?&]utm_') then 'tracking' when regexp_matches(url, '[?]') then 'query'
    when regexp_matches(url, '#') then 'fragment' when regexp_matches(url, '^http:') then 'plain' end as rule from @pages""")
def rule_join(cat):
    found = E.rewrite_urls(cat["pages"], cat.sql(_PAGE_RULES))
    return cat["pages"].join(found, "url", "left").select("page_id", "url", F.col("summary").alias("rule"))


_LINKED = """(select p_partkey as id, (case p_partkey % 5
    when 0 then 'https://lexicon.example.net/en/Topic%20' || cast(p_partkey as string)
    when 1 then 'https://lexicon.example.net/de/Thema_' || cast(p_partkey as string)
    when 2 then 'https://issues.example.org/' || cast(p_partkey as string)
    when 3 then 'https://www.example.org/parts/part' || cast(p_partkey as string) || '/'
    else 'https://www.example.com/' || cast(p_partkey as string) end) as url,
   (case when p_partkey % 4 = 0 then null when p_partkey % 5 = 2 then 'issue #' || cast(p_partkey as string)
         when p_partkey % 5 = 3 then 'Part' || cast(p_partkey as string) else p_name end) as text,
   p_partkey % 8 <> 4 as brackets from @part)"""
_LINK_RULES = r"""select * from values
    (1, 'lexicon.example.net', 'https://lexicon.example.net/en/(.+)', 'any', null, '[[Lexicon:$1|{text}]]'),
    (2, 'lexicon.example.net', 'https://lexicon.example.net/en/(.+)', 'none', null, '[[Lexicon:$1]]'),
    (3, 'lexicon.example.net', 'https://lexicon.example.net/([a-z]+)/(.+)', 'any', null, '[[Lexicon:$1:$2|{text}]]'),
    (4, 'lexicon.example.net', 'https://lexicon.example.net/([a-z]+)/(.+)', 'none', null, '[[Lexicon:$1:$2]]'),
    (5, 'issues.example.org', r'https://issues\.example\.org/(\d+)', 'same', '(?i)issue *#?', '{{Issue|$1}}'),
    (6, 'issues.example.org', r'https://issues\.example\.org/(\d+)', 'bare', null, '{{Issue|$1}}'),
    (7, 'example.org', r'https://www\.example\.org/parts/(\w+)/?', 'same', null, '{{Part|$1}}'),
    (8, 'example.org', r'https://www\.example\.org/parts/(\w+)/?', 'none', null, '{{Part|$1}}')
  as rules(priority, host, pattern, label, prefix, replacement)"""


@query("x17_replaced_links", f"""
  select id, case
    when id % 5 = 0 and text is not null then '[[Lexicon:Topic ' || id || '|' || text || ']]'
    when id % 5 = 0 then '[[Lexicon:Topic ' || id || ']]'
    when id % 5 = 1 and text is not null then '[[Lexicon:de:Thema_' || id || '|' || text || ']]'
    when id % 5 = 1 then '[[Lexicon:de:Thema_' || id || ']]'
    when id % 5 = 2 and (text is not null or not brackets) then '{{{{Issue|' || id || '}}}}'
    when id % 5 = 3 then '{{{{Part|part' || id || '}}}}' end as replacement
  from {_LINKED} l""")
def replaced_links(cat):
    links = cat.sql(f"select * from {_LINKED}")
    found = E.replace_links(links, cat.sql(_LINK_RULES)).select("id", "replacement")
    return links.select("id").join(found, "id", "left")


@query("x18_site_links", """
  select pl_from, pl_title, '[[' || (case pl_namespace when 14 then ':Category:' when 6 then ':File:' when 10 then 'Template:'
    when 12 then 'Help:' when 4 then 'Lore:' when 1 then 'Talk:' when 2 then 'User:' when 3 then 'User talk:' else '' end)
    || pl_title || '#' || 'Part 1|label]]' as wikilink from @pagelinks""")
def site_links(cat):
    name = F.concat(
        F.when(F.col("pl_namespace") == 0, F.lit("")).otherwise(F.concat(F.lower(F.replace("nss_name", F.lit(" "), F.lit("_"))), F.lit(":"))),
        F.replace("pl_title", F.lit(" "), F.lit("_")), F.lit("#Part_1"),
    )
    links = cat["pagelinks"].join(cat["namespace_starname"], F.col("pl_namespace") == F.col("nss_id")).select(
        "pl_from", "pl_title", F.concat(F.lit("https://wiki.example.net/title/"), name).alias("url"),
        F.lit("label").alias("text"),
    )
    return E.site_links(cat, links, "https://wiki.example.net/title/").select("pl_from", "pl_title", "wikilink")


_RULES = f"""(select distinct {HOST.format(x='el_to')} as rule, false as with_subdomains from @externallinks
    where length({HOST.format(x='el_to')}) % 3 = 0 and {HOST.format(x='el_to')} <> ''
  union all select 'example.org', true)"""


def _rules(cat):
    from lorekeep.functions.urls import url_host

    hosts = cat["externallinks"].select(url_host(F.col("el_to")).alias("rule")).where("length(rule) % 3 = 0").distinct()
    root = cat.sql("select 'example.org' as rule, true as with_subdomains")
    return hosts.withColumn("with_subdomains", F.lit(False)).unionByName(root)


@query("j13_matching_rules", f"""
  select h.host, case when r.rule is not null then r.rule else 'example.org' end as rule
  from (select distinct {HOST.format(x='el_to')} as host from @externallinks) h
  left join {_RULES} r on r.rule = h.host
  where r.rule is not null or h.host like '%.example.org'""")
def matching_rules(cat):
    from lorekeep.functions.urls import url_host

    hosts = cat["externallinks"].select(url_host(F.col("el_to")).alias("host")).where("host is not null")
    return E.matching_rules(hosts, _rules(cat))


@query("x19_https_upgrades", f"""
  select el_from, el_to, 'https://' || substr(el_to, 8) as new_url from @externallinks
  where starts_with(el_to, 'http://') and ({HOST.format(x='el_to')} in (select rule from {_RULES} r)
    or {HOST.format(x='el_to')} like '%.example.org')""")
def https_upgrades(cat):
    return E.upgrade_to_https(cat["externallinks"], _rules(cat))


@query("x20_stripped_brackets", """
  select page_id, 'see [' || url || ' there] and [[Page]]' as body from @pages""")
def stripped_brackets(cat):
    doubled = F.concat(F.lit("see [["), "url", F.lit(" there]] and [[Page]]"))
    return cat["pages"].select("page_id", E.strip_extra_brackets(doubled).alias("body"))


@query("q23_manual_page_urls", """
  select log_id, 'https://man.example.org/man/' || (case when log_id % 3 = 0 then log_type || '/' else '' end)
    || replace(log_title, ' ', '%20') || '.' || log_namespace || '#' || log_action as url
  from (select log_id, log_type, log_namespace, log_action, 'page ' || log_type as log_title from @logging) l""")
def manual_page_urls(cat):
    url = E.manual_page_url(
        "https://man.example.org/man/", F.concat(F.lit("page "), "log_type"), F.col("log_namespace").cast("string"),
        F.when(F.col("log_id") % 3 == 0, F.col("log_type")), F.col("log_action"),
    )
    return cat["logging"].select("log_id", url.alias("url"))
