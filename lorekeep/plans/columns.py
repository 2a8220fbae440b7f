"""Queries for column functions (F) and predicates (F-a..F-j), and per-key sets (U-05, U-06)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorekeep.functions import encodings as enc
from lorekeep.functions import langs, markup, text, times, titles, urls
from lorekeep.operators import activity as A
from lorekeep.operators import common as c
from lorekeep.operators import lists as L
from lorekeep.plans.extract import CHECKABLE
from lorekeep.plans.graph import language, pure
from lorekeep.plans.registry import query
from lorekeep.sources.sample import TODAY


@query("fa_projection", "select rc_type, rc_deleted, rc_user_text, rc_old_len, rc_new_len from @recentchanges where rc_type in ('edit', 'new', 'log')")
def projection(cat):
    return L.recent_changes(cat, prop={"user", "sizes"})


@query("fb_time_range", "select rc_id, rc_timestamp from @recentchanges where rc_timestamp between '2024-01-10' and '2024-01-12'")
def time_range(cat):
    return c.in_time_range(cat["recentchanges"], "rc_timestamp", "newer", "2024-01-10", "2024-01-12").select("rc_id", "rc_timestamp")


@query("fc_title_range", "select page_id, page_title from @page where page_title >= 'Topic X2' and page_title <= 'Topic X7'")
def title_range(cat):
    return c.in_title_range(cat["page"], "page_title", "descending", "Topic X7", "Topic X2").select("page_id", "page_title")


@query("fd_set_membership", "select page_id from @page where page_namespace in (4, 10)")
def set_membership(cat):
    return cat["page"].where(F.col("page_namespace").isin(c.as_set({4, 10}))).select("page_id")


@query("fe_tuple_membership", "select rc_id from @recentchanges where (rc_namespace, rc_title) in (select pl_namespace, pl_title from @pagelinks)")
def tuple_membership(cat):
    wanted = cat["pagelinks"].select(F.col("pl_namespace").alias("rc_namespace"), F.col("pl_title").alias("rc_title"))
    return cat["recentchanges"].join(wanted, ["rc_namespace", "rc_title"], "left_semi").select("rc_id")


@query("ff_flags", "select rc_id from @recentchanges where rc_patrolled and not rc_minor and not coalesce(rc_user, 0) = 0")
def flags(cat):
    df = c.flag_filter(cat["recentchanges"], ["patrolled", "!minor", "!anon"], {
        "patrolled": F.col("rc_patrolled"), "minor": F.col("rc_minor"), "anon": F.coalesce("rc_user", F.lit(0)) == 0})
    return df.select("rc_id")


@query("fg_not_expired", f"""
  select pr_id, coalesce(pr_expiry >= '9999-01-01', true) as indefinite from @page_restrictions
  where pr_expiry is null or pr_expiry > '{TODAY}'""")
def not_expired(cat):
    df = cat["page_restrictions"].where(c.not_expired(F.col("pr_expiry"), TODAY))
    return df.select("pr_id", c.is_indefinite(F.col("pr_expiry")).alias("indefinite"))


@query("fh_tag_filter", """
  select log_id from @logging where log_id in (select g.tgle_log_id from @tagged_logevent g
    join @tag t on t.tag_id = g.tgle_tag_id where t.tag_name = 'signup')""")
def tag_filter(cat):
    return c.tagged_with(cat["logging"], cat, "tagged_logevent", "log_id", "signup").select("log_id")


@query("fj_null_rejecting", """
  select p.page_id, l.pl_title from @page p left join @pagelinks l on l.pl_from = p.page_id where l.pl_namespace = 10""")
def null_rejecting(cat):
    joined = cat["page"].join(cat["pagelinks"], F.col("page_id") == F.col("pl_from"), "left")
    return joined.where("pl_namespace = 10").select("page_id", "pl_title")


@query("a01_tag_arrays", """
  select r.rev_id, coalesce(string_agg(t.tag_name, ',' order by t.tag_name), '') as tags, count(t.tag_name) as n
  from @revision r left join @tagged_revision g on g.tgrev_rev_id = r.rev_id left join @tag t on t.tag_id = g.tgrev_tag_id
  group by 1""")
def tag_arrays(cat):
    df = c.with_tags(cat["revision"].select("rev_id"), cat, "tagged_revision", "rev_id")
    return df.select("rev_id", F.array_join("tag_names", ",").alias("tags"), F.size("tag_names").cast("long").alias("n"))


@query("u05_equal_sets", """
  with a as (select rev_page as page, string_agg(distinct rev_user_text, ',' order by rev_user_text) as s from @revision group by 1),
  b as (select ar_page_id as page, string_agg(distinct ar_user_text, ',' order by ar_user_text) as s from @archive group by 1)
  select coalesce(a.page, b.page) as page, a.s is not distinct from b.s as same from a full join b on a.page = b.page""")
def equal_sets(cat):
    # users are counted, not collected: equal sets have equal sizes and no one-sided member
    live = cat["revision"].select(F.col("rev_page").alias("page"), F.col("rev_user_text").alias("u"), F.lit(1).alias("side"))
    gone = cat["archive"].select(F.col("ar_page_id").alias("page"), F.col("ar_user_text").alias("u"), F.lit(2).alias("side"))
    members = live.unionByName(gone).groupBy("page", "u").agg(F.countDistinct("side").alias("sides"))
    return members.groupBy("page").agg(F.min(F.col("sides") == 2).alias("same"))


@query("u06_explicit_groups", """
  select ug_user, string_agg(ug_group, ',' order by ug_group) as groups from @user_groups
  where ug_group <> 'bot' group by 1
  union all select ug_user, '' from @user_groups group by 1 having bool_and(ug_group = 'bot')""")
def explicit_groups(cat):
    sets = L.user_group_sets(cat).withColumn("all", F.concat("user_groups", F.array(F.lit("*"), F.lit("user"))))
    rest = F.array_except("all", F.array(F.lit("*"), F.lit("user"), F.lit("bot")))
    return sets.select("ug_user", F.array_join(rest, ",").alias("groups"))


@query("f01_canonical_title", "select pl_from, pl_title, pl_title as canonical from @pagelinks")
def canonical_title(cat):
    odd = F.concat(F.lit("_ ‎"), F.lower(F.substring("pl_title", 1, 1)),
                   F.replace(F.expr("substr(pl_title, 2)"), F.lit(" "), F.lit("_ _")), F.lit("  "))
    return cat["pagelinks"].select("pl_from", "pl_title", titles.canonical_title(odd).alias("canonical"))


@query("f02_parsed_titles", """
  select l.log_id, (case l.log_id % 3 when 0 then 'de' when 1 then 's1' else '' end) as iwprefix,
    (case when l.log_id % 3 = 1 and not i.iw_local then '' else n.nss_name end) as namespace,
    cast(case when l.log_id % 3 = 1 and not i.iw_local then 0 else l.log_namespace end as integer) as ns_id,
    (case when l.log_id % 3 = 1 and not i.iw_local and n.nss_name <> '' then n.nss_name || ':' else '' end)
      || (case when n.nss_name <> '' and l.log_id % 3 = 1 and not i.iw_local then lower(substr(l.log_title, 1, 1)) || substr(l.log_title, 2)
               else l.log_title end) as pagename,
    'part one' as sectionname
  from @logging l join @namespace_starname n on n.nss_id = l.log_namespace join @interwiki i on i.iw_prefix = 's1'""")
def parsed_titles(cat):
    names = cat["namespace_starname"]
    raw = F.concat(
        F.element_at(F.array(F.lit("DE : "), F.lit("s1:"), F.lit("")), (F.col("log_id") % 3 + 1).cast("int")),
        F.when(F.col("nss_name") == "", F.lit("")).otherwise(F.concat("nss_name", F.lit(":"))),
        F.lower(F.substring("log_title", 1, 1)), F.expr("substr(log_title, 2)"), F.lit("# _part  one_"),
    )
    rows = cat["logging"].join(names, F.col("log_namespace") == F.col("nss_id")).select("log_id", raw.alias("raw"))
    parsed = titles.parse_titles(rows, "raw", cat["interwiki"], cat["namespace_name"])
    return parsed.select("log_id", "iwprefix", "namespace", "ns_id", "pagename", "sectionname")


@query("f03_derived_names", """
  select page_id, case when contains(page_title, '/') then regexp_replace(page_title, '/[^/]*$', '') else page_title end as base,
    split_part(page_title, '/', -1) as sub, split_part(page_title, '/', 1) as root,
    cast(case when page_namespace > 0 and page_namespace % 2 = 1 then page_namespace - 1 else page_namespace end as integer) as article_ns,
    cast(case when page_namespace % 2 = 0 then page_namespace + 1 else page_namespace end as integer) as talk_ns from @page""")
def derived_names(cat):
    t, ns = F.col("page_title"), F.col("page_namespace")
    return cat["page"].select(
        "page_id", titles.base_page_name(t).alias("base"), titles.sub_page_name(t).alias("sub"),
        titles.root_page_name(t).alias("root"), titles.article_space(ns).alias("article_ns"), titles.talk_space(ns).alias("talk_ns"))


@query("f04_absolute_links", """
  select page_id, case page_id % 4 when 0 then page_title when 1 then page_title || '/Sub'
    when 2 then (case when contains(page_title, '/') then regexp_replace(page_title, '/[^/]*$', '') || '/Up' else 'Up' end)
    else 'Other/Page' end as pagename from @page""")
def absolute_links(cat):
    forms = F.array(F.lit(""), F.lit("/Sub"), F.lit("../Up"), F.lit("Other/Page"))
    link = F.element_at(forms, (F.col("page_id") % 4 + 1).cast("int"))
    target = titles.absolute_link(F.lit(""), F.lit(""), link, F.lit(False), F.lit("Help"), F.col("page_title"))
    return cat["page"].select("page_id", target["pagename"].alias("pagename"))


@query("f05_database_title", """
  select p.page_id, case when p.page_namespace = 10 or n.nss_name = '' then p.page_title else n.nss_name || ':' || p.page_title end as dbtitle
  from @page p join @namespace_starname n on n.nss_id = p.page_namespace""")
def database_title(cat):
    df = c.with_namespace(cat["page"], cat, "page_namespace")
    db = titles.database_title(F.col("nss_name"), F.col("page_namespace"), F.col("page_title"), F.lit(10))
    return df.select("page_id", db.alias("dbtitle"))


_ANCHOR = "regexp_replace(regexp_replace(regexp_replace(replace(text, '_', ' '), '^\\s+|\\s+$', '', 'g'), ' +', ' ', 'g'), '^:+', '')"


@query("f06_encodings", f"""
  select conv_id, turn, url_encode(text) as url, replace(replace(url_encode(text), '%20', '+'), '~', '%7E') as query,
    replace(replace(replace(replace(url_encode({_ANCHOR}), '%20', '_'), '%3A', ':'), '~', '.7E'), '%', '.') as dot,
    text as back from @conversations""")
def encodings(cat):
    t = F.col("text")
    return cat["conversations"].select(
        "conv_id", "turn", enc.url_encode(t).alias("url"), enc.query_encode(t).alias("query"), enc.dot_encode(t).alias("dot"),
        enc.query_decode(enc.query_encode(t)).alias("back"))


@query("f06_anchor_encode", f"select conv_id, turn, regexp_replace({_ANCHOR}, '\\s', '_', 'g') as anchor from @conversations")
def anchor_encode(cat):
    return cat["conversations"].select("conv_id", "turn", enc.anchor_encode(F.col("text")).alias("anchor"))


@query("f07_languages", f"select page_id, {language('page_title')} as language, {pure('page_title')} as pure from @page")
def languages(cat):
    t = F.col("page_title")
    return cat["page"].select("page_id", langs.title_language(t).alias("language"), langs.pure_title(t).alias("pure"))


@query("f07_localized", """
  select page_id, case when contains(page_title, '/') then replace(page_title, '/', ' (Suomi)/') || ' (Suomi)'
    else page_title || ' (Suomi)' end as localized from @page""")
def localized(cat):
    return cat["page"].select("page_id", langs.localized_title(F.col("page_title"), F.lit("Suomi")).alias("localized"))


@query("f08_timestamps", """
  select pr_id, case when pr_expiry >= '9999-01-01' then 'infinity' else strftime(pr_expiry, '%Y-%m-%dT%H:%M:%SZ') end as formatted,
         cast(pr_expiry as varchar) as parsed from @page_restrictions""")
def timestamps(cat):
    shown = times.format_timestamp(F.col("pr_expiry"))
    return cat["page_restrictions"].select("pr_id", shown.alias("formatted"), times.parse_timestamp(shown).cast("string").alias("parsed"))


@query("f08_rounding", "select rc_id, date_trunc('second', rc_timestamp + interval 500 millisecond) as rounded from @recentchanges")
def rounding(cat):
    return cat["recentchanges"].select("rc_id", times.round_to_second(F.col("rc_timestamp")).alias("rounded"))


@query("f09_sha1_codec", "select rev_id, lpad(rev_sha1, 40, '0') as digest, case when rev_sha1 is not null then 31 end as stored_length from @revision")
def sha1_codec(cat):
    stored = enc.sha1_to_base36("rev_sha1")
    rows = cat["revision"].select("rev_id", stored.alias("stored"))
    return rows.select("rev_id", enc.sha1_from_base36("stored").alias("digest"), F.length("stored").alias("stored_length"))


@query("f10_redirects", """
  select page_id, starts_with(body, '#REDIRECT') and not starts_with(body, '#REDIRECT [[]]') as redirect,
    case when starts_with(body, '#REDIRECT') then regexp_extract(body, '^#REDIRECT \\[\\[([^\\]]+)\\]\\]', 1) end as target
  from @wikitext""")
def redirects(cat):
    b = F.col("body")
    return cat["wikitext"].select("page_id", text.is_redirect(b).alias("redirect"), text.redirect_target(b).alias("target"))


@query("f11_headings", """
  select page_id, len(h) as n, array_to_string(list_transform(h, lambda x: trim(regexp_replace(regexp_replace(x, '^=+\\s*', ''), '\\s*=+\\s*$', ''))), '|') as titles
  from (select page_id, list_filter(string_split(body, chr(10)), lambda x: regexp_matches(x, '^={1,6}[^=].*=\\s*$')) as h from @wikitext) w""")
def headings(cat):
    found = markup.headings(F.col("body"))
    return cat["wikitext"].select(
        "page_id", F.size(found).cast("long").alias("n"), F.array_join(F.transform(found, lambda h: h["title"]), "|").alias("titles"))


@query("f12_plain_text", r"""
  select page_id, length(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(body,
    '(?s)<!--.*?-->', '', 'g'), '\{\{[^{}]*\}\}', '', 'g'), '\[\[(?:[^\[\]|]*\|)?([^\[\]]*)\]\]', '\1', 'g'),
    '\[(?:https?|ftp)://\S+ ([^\[\]]*)\]', '\1', 'g'), '</?[A-Za-z][^<>]*>', '', 'g'), '''{2,}', '', 'g'),
    '(?m)^=+[ \t]*(.*?)[ \t]*=+[ \t]*$', '\1', 'g')) as n from @wikitext""")
def plain_text(cat):
    return cat["wikitext"].select("page_id", F.length(text.plain_text(F.col("body"))).cast("long").alias("n"))


@query("f13_word_statistics", r"""
  select doc_id, len(list_filter(string_split_regex(text, '\s+'), lambda w: regexp_matches(w, '^\p{Lu}'))) as capitalized,
    len(list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')) as words from @documents""")
def word_statistics(cat):
    t = F.col("text")
    return cat["documents"].select(
        "doc_id", text.count_capitalized(t).cast("long").alias("capitalized"), text.word_count(t).cast("long").alias("words"))


@query("f14_struck_through", "select sec_page, sec_number, sec_title like '<s>%</s>' as closed from @section")
def struck_through(cat):
    return cat["section"].select("sec_page", "sec_number", text.is_struck_through(F.col("sec_title")).alias("closed"))


@query("f15_checkable", f"select el_from, el_to, {CHECKABLE} as checkable, regexp_extract(el_to, '^[a-z]+://(?:[^/?#@]*@)?([^/?#:@]+)', 1) as host from @externallinks")
def checkable(cat):
    u = F.col("el_to")
    return cat["externallinks"].select("el_from", "el_to", urls.is_checkable(u).alias("checkable"), urls.url_host(u).alias("host"))


@query("f15_url_parts", r"""
  select page_id, regexp_extract(url, '^([a-z]+):', 1) as scheme, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) as host,
    nullif(regexp_extract(url, '\?([^#]*)', 1), '') as query, nullif(regexp_extract(url, '#(.*)$', 1), '') as fragment from @pages""")
def url_parts(cat):
    part = lambda p: urls.url_part(F.col("url"), p)
    return cat["pages"].select(
        "page_id", part("PROTOCOL").alias("scheme"), part("HOST").alias("host"), part("QUERY").alias("query"), part("REF").alias("fragment"))


@query("f16_normalized_urls", r"select page_id, regexp_replace(url, '#[^#]*$', '') as url from @pages")
def normalized_urls(cat):
    return cat["pages"].select("page_id", urls.without_fragment(F.col("url")).alias("url"))


@query("f18_sort_keys", """
  select k.cl_from, k.cl_to, (case when k.cl_sortkey_prefix <> '' then upper(k.cl_sortkey_prefix) || chr(10) else '' end)
    || upper(p.page_title) as sort_key, k.cl_type as member_type from @categorylinks k join @page p on p.page_id = k.cl_from""")
def sort_keys(cat):
    df = cat["categorylinks"].join(cat["page"], F.col("cl_from") == F.col("page_id"))
    key = text.category_sort_key(F.col("page_title"), F.col("cl_sortkey_prefix"))
    return df.select("cl_from", "cl_to", key.alias("sort_key"), text.category_member_type(F.col("page_namespace")).alias("member_type"))


@query("f19_transcluded_part", """
  select doc_id, case doc_id % 3 when 0 then text when 1 then 'a' || text else text || 'b' end as transcluded,
    case doc_id % 3 when 0 then 'x' || text || 'y' when 1 then text else 'n' || text || 'b' end as viewed from @documents""")
def transcluded_part(cat):
    t = F.col("text")
    wrapped = F.element_at(F.array(
        F.concat(F.lit("x<onlyinclude>"), t, F.lit("</onlyinclude>y")),
        F.concat(F.lit("<includeonly>a</includeonly>"), t),
        F.concat(F.lit("<noinclude>n</noinclude>"), t, F.lit("b")),
    ), (F.col("doc_id") % 3 + 1).cast("int"))
    return cat["documents"].select(
        "doc_id", markup.transcluded_part(wrapped).alias("transcluded"), markup.viewed_part(wrapped).alias("viewed"))


@query("f19_nested_parts", """
  select doc_id, text as transcluded, '1' || text || '2345' as viewed from @documents where text is not null""")
def nested_parts(cat):
    t = F.col("text")
    wrapped = F.concat(
        F.lit("<noinclude>1<noinclude>"), t, F.lit("</noinclude>2</noinclude><includeonly>"), t,
        F.lit("<includeonly></includeonly></includeonly><noinclude>3<includeonly>x</includeonly>4</noinclude><noinclude>5"),
    )
    return cat["documents"].where("text is not null").select(
        "doc_id", markup.transcluded_part(wrapped).alias("transcluded"), markup.viewed_part(wrapped).alias("viewed"))


@query("f20_unescaped", """
  select page_id, length(replace(replace(replace(replace(html, '&copy;', '©'), '&middot;', '·'), '&quot;', '"'), '&amp;', '&')) as n
  from @pages""")
def unescaped(cat):
    return cat["pages"].select("page_id", F.length(enc.unescape_entities("html")).cast("long").alias("n"))


@query("a21_unique_values", "select rc_user_text, count(distinct rc_title) as titles from @recentchanges group by 1")
def unique_values(cat):
    first = A.first_occurrences(cat["recentchanges"], "rc_user_text", "rc_title", "rc_id")
    return first.groupBy("rc_user_text").agg(F.count(F.lit(1)).alias("titles"))
