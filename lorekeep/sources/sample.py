"""Wiki-shaped tables derived from the driver's sample tables.

Each entry is one SELECT understood by Spark SQL and by DuckDB. ``@name`` refers
to another table; ``#...`` marks the few spellings in which the dialects differ.
All formulas are integer arithmetic on keys, so both engines see the same rows,
and every table grows with the sample tables it comes from.

Page ids are ``4 * key + kind``: kind 0 comes from ``part``, 1 from ``pages``
(with wikitext), 2 from ``conversations`` (talk pages), 3 from ``region`` and
``nation`` (category pages).
"""

from __future__ import annotations

import re

DRIVER_TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

INFINITY = "9999-12-31 23:59:59.999999"
TODAY = "2024-01-31 00:00:00"


def _group(key: str) -> str:
    return f"cast(floor(({key}) / 4) as bigint)"


def base_title(key: str) -> str:
    """Title without language suffix; odd groups may differ from even ones only in case."""
    g = _group(key)
    return (
        f"('Topic ' || (case when {g} % 2 = 0 then 'X' when {g} % 5 = 4 then 'x' else 'Y' end)"
        f" || cast(cast(floor({g} / 2) as bigint) as string)"
        f" || (case when {g} % 7 = 3 then '/Usage' else '' end))"
    )


def title(key: str) -> str:
    return (
        f"({base_title(key)} || (case ({key}) % 4 when 1 then ' (Español)'"
        f" when 2 then ' (Français)' when 3 then ' (Čeština)' else '' end))"
    )


def namespace(key: str) -> str:
    g = _group(key)
    return (
        f"cast(case when {g} % 16 = 8 and ({key}) % 4 = 3 then 0 else (case {g} % 16 when 5 then 1 when 6 then 4 when 7 then 10 when 8 then 14"
        f" when 9 then 6 when 10 then 3 when 11 then 2 when 12 then 12 when 13 then 14"
        f" when 14 then 10 else 0 end) end as int)"
    )


def linked_title(key: str) -> str:
    """Title as language links spell it: with the namespace, without the language."""
    return (
        f"((case {namespace(key)} when 4 then 'Lore:' when 10 then 'Template:' when 12 then 'Help:'"
        f" when 14 then 'Category:' else '' end) || {base_title(key)})"
    )


NAMESPACE_NAMES = {
    # fixed values: default namespace ids and canonical names of a wiki site
    -2: "Media", -1: "Special", 0: "", 1: "Talk", 2: "User", 3: "User talk",
    4: "Project", 5: "Project talk", 6: "File", 7: "File talk", 8: "MediaWiki",
    9: "MediaWiki talk", 10: "Template", 11: "Template talk", 12: "Help",
    13: "Help talk", 14: "Category", 15: "Category talk",
}
_CANONICAL = " ".join(f"when {k} then '{v}'" for k, v in NAMESPACE_NAMES.items())

_LOG_KEY = "(event_id * 11) % (cnt + 50)"
_USER_LOG = "event_id % 13 in (4, 5, 6, 7)"

_REV_COLUMNS = """
  event_id as rev_id, 4 * ((event_id * 7) % cnt) as rev_page, event_id as rev_text_id,
  (case when event_id % 4 = 0 then '' else 'edit ' || event_type end) as rev_comment,
  user_id as rev_user, 'U' || cast(user_id as string) as rev_user_text, ts as rev_timestamp,
  event_type = 'view' as rev_minor_edit,
  cast(case when event_id % 17 = 0 then 1 + event_id % 15 else 0 end as int) as rev_deleted,
  cast(length(props) + event_id % 50 as bigint) as rev_len,
  (case when event_id >= cnt then event_id - cnt else 0 end) as rev_parent_id,
  (case when event_id % 19 = 0 then null else md5(cast(event_id as string)) end) as rev_sha1,
  'wikitext' as rev_content_model, 'text/x-wiki' as rev_content_format
"""

TABLES: dict[str, str] = {
    "part_count": "select count(*) as cnt from @part",
    "customer_count": "select count(*) as cnt from @customer",
    "supplier_count": "select count(*) as cnt from @supplier",
    # events with the number of part pages beside each row (one-row scalar subquery)
    "activity": """
        select event_id, ts, user_id, event_type, value, props,
               (select cnt from @part_count) as cnt,
               (select cnt from @customer_count) as users
        from @events""",
    "namespace": """
        select cast(n_nationkey - 2 as int) as ns_id, 'first-letter' as ns_case,
               n_nationkey - 2 in (0, 4, 12) as ns_content,
               n_nationkey - 2 > 0 as ns_subpages
        from @nation""",
    "namespace_canonical": f"""
        select cast(n_nationkey - 2 as int) as nsc_id,
               (case n_nationkey - 2 {_CANONICAL} else replace(n_name, '_', ' ') end) as nsc_name
        from @nation where n_nationkey - 2 <> 0""",
    "namespace_starname": f"""
        select cast(n_nationkey - 2 as int) as nss_id,
               (case n_nationkey - 2 when 4 then 'Lore' when 5 then 'Lore talk' {_CANONICAL}
                else replace(n_name, '_', ' ') end) as nss_name
        from @nation""",
    "namespace_alias": """
        select cast(n_nationkey - 2 as int) as nsa_id, 'R' || cast(n_regionkey as string)
               || ' N' || cast(n_nationkey as string) as nsa_name
        from @nation where n_nationkey % 6 = 0""",
    "namespace_name": """
        select nss_id as nsn_id, nss_name as nsn_name from @namespace_starname
        union select nsc_id, nsc_name from @namespace_canonical
        union select nsa_id, nsa_name from @namespace_alias""",
    "interwiki": """
        select lang as iw_prefix, 'https://' || lang || '.wiki.example.org/$1' as iw_url,
               true as iw_local, true as iw_language
        from (select distinct lang from @documents) as l
        union all
        select 's' || cast(s_suppkey as string),
               'https://site' || cast(s_suppkey as string) || '.example.org/$1',
               s_nationkey % 5 = 0, false
        from @supplier""",
    "tag_name": """
        select event_type as tag_name, event_id % 3 as mod3 from @events
        union select 'big', 0 from @events where value > 10""",
    "tag": """
        select cast(length(tag_name) * 10 + (case when tag_name = 'view' then 1
                    when tag_name = 'error' then 2 else 0 end) as bigint) as tag_id,
               tag_name, 'Tag ' || tag_name as tag_displayname,
               tag_name <> 'error' as tag_active,
               split(case when tag_name in ('view', 'big') then 'manual'
                          when tag_name = 'click' then 'extension,manual'
                          when tag_name = 'error' then 'manual'
                          else 'extension' end, ',') as tag_source
        from (select distinct tag_name from @tag_name) as t""",
    "revision": f"""
        select {_REV_COLUMNS} from @activity
        where event_type in ('view', 'click', 'purchase')""",
    "archive": f"""
        select event_id as ar_id, {namespace('(event_id * 7) % cnt')} as ar_namespace,
               {title('(event_id * 7) % cnt')} as ar_title, rev_id as ar_rev_id,
               rev_page as ar_page_id, rev_text_id as ar_text_id, rev_comment as ar_comment,
               rev_user as ar_user, rev_user_text as ar_user_text,
               rev_timestamp as ar_timestamp, rev_minor_edit as ar_minor_edit,
               rev_deleted as ar_deleted, rev_len as ar_len, rev_parent_id as ar_parent_id,
               rev_sha1 as ar_sha1, rev_content_model as ar_content_model,
               rev_content_format as ar_content_format
        from (select event_id, cnt, {_REV_COLUMNS} from @activity
              where event_type = 'error') as r""",
    "logging": f"""
        select event_id as log_id,
               (case when event_id % 26 = 19 then 'renameuser' when event_id % 26 = 20 then 'usermerge'
                     else (case event_id % 13 when 0 then 'delete' when 1 then 'delete' when 2 then 'move'
                     when 3 then 'protect' when 4 then 'block' when 5 then 'block'
                     when 6 then 'rights' when 7 then 'newusers' when 8 then 'patrol'
                     when 9 then 'delete' when 10 then 'merge' when 11 then 'tag'
                     else 'delete' end) end) as log_type,
               (case when event_id % 26 = 19 then 'renameuser' when event_id % 26 = 20 then 'usermerge'
                     else (case event_id % 13 when 0 then 'delete' when 1 then 'restore' when 2 then 'move'
                     when 3 then (case when event_id % 4 = 0 then 'unprotect' else 'protect' end)
                     when 4 then 'block' when 5 then 'unblock'
                     when 6 then 'rights' when 7 then 'create' when 8 then 'patrol'
                     when 9 then 'revision' when 10 then 'merge' when 11 then 'update'
                     else 'event' end) end) as log_action,
               ts as log_timestamp, user_id as log_user,
               'U' || cast(user_id as string) as log_user_text,
               (case when {_USER_LOG} then 2 else {namespace(_LOG_KEY)} end) as log_namespace,
               (case when {_USER_LOG}
                     then 'U' || cast((event_id * 3) % users as string)
                     else {title(_LOG_KEY)} end) as log_title,
               (case when {_USER_LOG} or {_LOG_KEY} >= cnt then null
                     else 4 * ({_LOG_KEY}) end) as log_page,
               (case when event_id % 5 = 0 then '' else 'because ' || event_type end) as log_comment,
               (case when event_id % 26 = 19 then
                    (case when event_id % 52 = 19
                     then '{{"olduser": "U' || cast((event_id * 3) % users as string)
                          || '", "newuser": "R' || cast((event_id * 3) % users as string) || '"}}'
                     else '{{"olduser": "R' || cast((event_id * 3) % 10 as string)
                          || '", "newuser": "S' || cast((event_id * 3) % 10 as string) || '"}}' end)
                  when event_id % 26 = 20 then
                    '{{"oldId": ' || cast((event_id * 3) % users as string)
                    || ', "newId": ' || cast((event_id * 3 + 7) % users as string)
                    || ', "newName": "U' || cast((event_id * 3 + 7) % users as string) || '"}}'
                  else (case event_id % 13
                  when 2 then '{{"target_ns": 0, "target_title": "Moved '
                              || cast(event_id % 97 as string) || '"}}'
                  when 6 then (case when event_id % 2 = 0
                       then '{{"oldgroups": ["bot"], "newgroups": ["bot", "sysop"]}}'
                       else '{{"oldgroups": ["bot", "sysop"], "newgroups": ["maintainer"]}}' end)
                  when 8 then '{{"curid": ' || cast(event_id - event_id % 5 as string) || '}}'
                  when 9 then '{{"type": "revision", "ids": [' || cast(event_id - 1 as string) || ', '
                              || cast(event_id - 2 as string) || '], "new": {{"bitmask": '
                              || cast(event_id % 16 as string) || '}}}}'
                  when 10 then '{{"dest_ns": 0, "dest_title": "'
                              || {title('(event_id * 5) % cnt')} || '", "mergepoint": "2024-01-'
                              || (case when event_id % 2 = 0 then '10' else '20' end) || 'T00:00:00Z"}}'
                  when 11 then '{{"revid": ' || cast(event_id - event_id % 7 as string)
                              || ', "tagsAdded": ["big"], "tagsRemoved": ["'
                              || event_type || '"]}}'
                  when 12 then '{{"type": "logging", "ids": [' || cast(event_id - 13 as string)
                              || '], "new": {{"bitmask": ' || cast(event_id % 8 as string) || '}}}}'
                  else props end) end) as log_params,
               cast(case when event_id % 23 = 0 then 1 + event_id % 15 else 0 end as int)
                 as log_deleted
        from @activity where event_type in ('signup', 'error')""",
    "recentchanges": f"""
        select event_id as rc_id, ts as rc_timestamp,
               (case when user_id % 50 = 49 then null else user_id end) as rc_user,
               'U' || cast(user_id as string) as rc_user_text,
               {namespace('(event_id * 7) % cnt')} as rc_namespace,
               {title('(event_id * 7) % cnt')} as rc_title,
               'change ' || event_type as rc_comment,
               event_type = 'view' as rc_minor, user_id % 10 = 3 as rc_bot,
               event_type = 'purchase' as rc_new, 4 * ((event_id * 7) % cnt) as rc_cur_id,
               (case when event_type in ('signup', 'error') then null else event_id end)
                 as rc_this_oldid,
               (case when event_id >= cnt then event_id - cnt else null end) as rc_last_oldid,
               (case when event_type = 'purchase' then 'new'
                     when event_type in ('view', 'click') then 'edit' else 'log' end) as rc_type,
               event_id % 3 = 0 as rc_patrolled, cast(event_id % 40 as bigint) as rc_old_len,
               cast(length(props) + event_id % 50 as bigint) as rc_new_len,
               cast(case when event_id % 17 = 0 then 1 + event_id % 15 else 0 end as int) as rc_deleted,
               (case when event_type in ('signup', 'error') then event_id else null end) as rc_logid,
               (case when event_type in ('signup', 'error') then event_type else null end) as rc_log_type,
               (case when event_type in ('signup', 'error') then 'event' else null end) as rc_log_action,
               (case when event_type in ('signup', 'error') then props else null end) as rc_params
        from @activity""",
    "tagged": """
        select event_id as entity_id, event_type as tag_name, event_type as kind
        from @events where event_id % 3 <> 0
        union all
        select event_id, 'big', event_type from @events where value > 10""",
    "tagged_recentchange": """
        select t.tag_id as tgrc_tag_id, g.entity_id as tgrc_rc_id
        from @tagged as g join @tag as t on g.tag_name = t.tag_name""",
    "tagged_logevent": """
        select t.tag_id as tgle_tag_id, g.entity_id as tgle_log_id
        from @tagged as g join @tag as t on g.tag_name = t.tag_name
        where g.kind in ('signup', 'error')""",
    "tagged_revision": """
        select t.tag_id as tgrev_tag_id, g.entity_id as tgrev_rev_id
        from @tagged as g join @tag as t on g.tag_name = t.tag_name
        where g.kind in ('view', 'click', 'purchase')""",
    "tagged_archived_revision": """
        select t.tag_id as tgar_tag_id, g.entity_id as tgar_rev_id
        from @tagged as g join @tag as t on g.tag_name = t.tag_name
        where g.kind = 'error'""",
    "users": """
        select c.c_custkey as user_id, 'U' || cast(c.c_custkey as string) as user_name,
               o.first_order as user_registration,
               cast(case when c.c_custkey % 7 = 0 then null else c.c_custkey % 60 end as bigint)
                 as user_editcount
        from @customer as c
        left join (select o_custkey, min(o_orderdate) as first_order from @orders
                   group by o_custkey) as o on c.c_custkey = o.o_custkey""",
    "user_groups": f"""
        select c_custkey as ug_user, lower(c_mktsegment) as ug_group,
               (case when c_custkey % 4 = 0 then cast('2024-01-15 00:00:00' as #ts)
                     when c_custkey % 4 = 1 then cast('{INFINITY}' as #ts)
                     else null end) as ug_expiry
        from @customer where c_custkey > 0 and c_custkey % 3 <> 0
        union all
        select c_custkey, 'bot', cast(null as #ts) from @customer
        where c_custkey > 0 and c_custkey % 10 = 3
        union all
        select c_custkey, 'sysop', cast('2024-03-01 00:00:00' as #ts) from @customer
        where c_custkey > 0 and c_custkey % 25 = 2""",
    "ipblocks": f"""
        select c_custkey as ipb_id, 'U' || cast(c_custkey as string) as ipb_address,
               c_custkey as ipb_user, cast(1 as bigint) as ipb_by, 'U1' as ipb_by_text,
               'spam' as ipb_reason, cast('2024-01-05 12:00:00' as #ts) as ipb_timestamp,
               c_custkey % 2 = 0 as ipb_create_account, c_custkey % 5 = 0 as ipb_deleted,
               (case when c_custkey % 3 = 0 then cast('{INFINITY}' as #ts)
                     when c_custkey % 3 = 1 then cast('2024-01-20 00:00:00' as #ts)
                     else cast('2024-06-01 00:00:00' as #ts) end) as ipb_expiry
        from @customer where c_acctbal < 0 and c_custkey > 0""",
    "texts": "select doc_id * 7 as old_id, text as old_text from @documents",
    # page text: the sample html rewritten as wikitext
    "wikitext_raw": """
        select page_id as key, url, html,
          (case when substr(#x(html, 'href="/([^"]*)"', 1)#, 1, 1) = 'ß' then 'SS'
                else upper(substr(#x(html, 'href="/([^"]*)"', 1)#, 1, 1)) end)
            || substr(#x(html, 'href="/([^"]*)"', 1)#, 2) as word,
          #r(#r(#r(#r(#r(#r(#r(#r(#r(#r(#r(#r(#r(#r(html,
            '<script>[^<]*</p>[^<]*</script>', '')#,
            '<style>[^<]*</style>', '')#,
            '<title>[^<]*</title>', '')#,
            '<a href="/e([^"]*)">([^<]*)</a>', '[[Category:e%1]]')#,
            '<a href="/d([^"]*)">([^<]*)</a>', '[[de:d%1]]')#,
            '<a href="/l([^"]*)">([^<]*)</a>', '[[File:l%1|thumb]]')#,
            '<a href="/i([^"]*)">([^<]*)</a>', '[[s1:i%1|%2]]')#,
            '<a href="/t([^"]*)">([^<]*)</a>', '[[t%1#%2|%2]]')#,
            '<a href="/([^"]*)">([^<]*)</a>', '[[%1|%2]]')#,
            '<h1>([^<]*)</h1>', '%n== %1 ==%n')#,
            '<b>([^<]*)<br>', '%n=== %1 ===%n')#,
            '<div class="ad">([^<]*)</div>', '{{Ad|%1}}')#,
            '<footer>&copy; ([^ ]*) ([^<]*)</footer>', '{{Footer}}%n[https://%1/about?x=1#top %1]')#,
            '</?(html|head|body|nav|ul|li|p|article|meta|!DOCTYPE)[^>]*>', '%n')# as body
        from @pages""",
    "wikitext": """
        select 4 * w.key + 1 as page_id, cast(0 as int) as namespace,
               (case when w.key = f.first_key then w.word
                     else w.word || ' ' || cast(w.key as string) end) as title,
               (case when w.key % 9 = 4 then '#REDIRECT [[' || #x(w.html, 'href="/([^"]*)"', 1)#
                          || (case when w.key % 2 = 0 then '#Part ' || cast(w.key as string)
                                   else '' end) || ']]'
                     else w.body end) as body,
               w.url as url, w.key % 9 = 4 as is_redirect, length(w.html) as html_length
        from @wikitext_raw as w
        join (select word, min(key) as first_key from @wikitext_raw group by word) as f
          on w.word = f.word""",
    "page_latest": """
        select rev_page, max(rev_id) as latest, max(rev_timestamp) as touched
        from @revision group by rev_page""",
    "page": f"""
        select 4 * p.p_partkey as page_id, {namespace('p.p_partkey')} as page_namespace,
               {title('p.p_partkey')} as page_title, p.p_partkey % 3 <> 0 as page_is_redirect,
               p.p_partkey % 11 = 0 as page_is_new,
               coalesce(l.touched, cast('2024-01-01 00:00:00' as #ts)) as page_touched,
               coalesce(l.latest, 0) as page_latest,
               cast(floor(p.p_retailprice) as bigint) as page_len,
               'wikitext' as page_content_model,
               (case p.p_partkey % 5 when 1 then 'es' when 2 then 'fr' when 3 then 'cs'
                     else 'en' end) as page_lang
        from @part as p left join @page_latest as l on 4 * p.p_partkey = l.rev_page
        union all
        select page_id, namespace, title, is_redirect, false,
               cast('2024-01-02 00:00:00' as #ts), cast(0 as bigint), cast(html_length as bigint),
               'wikitext', 'en' from @wikitext
        union all
        select 4 * conv_id + 2, cast(1 as int), {title('conv_id * 2')}, conv_id % 6 = 1, false,
               cast('2024-01-03 00:00:00' as #ts), cast(0 as bigint),
               cast(sum(length(text)) as bigint), 'wikitext', 'en'
        from @conversations where {namespace('conv_id * 2')} <> 1 group by conv_id
        union all
        select cast(8 * r_regionkey + 3 as bigint), cast(14 as int), r_name, false, false,
               cast('2024-01-04 00:00:00' as #ts), cast(0 as bigint), cast(10 as bigint),
               'wikitext', 'en' from @region
        union all
        select cast(8 * n_nationkey + 7 as bigint), cast(14 as int), replace(n_name, '_', ' '), false, false,
               cast('2024-01-04 00:00:00' as #ts), cast(0 as bigint), cast(20 as bigint),
               'wikitext', 'en' from @nation""",
    "page_props": f"""
        select 4 * p_partkey as pp_page, 'displaytitle' as pp_propname,
               (case when p_partkey % 12 = 0 then 'i' else 'X' end) || {title('p_partkey')} as pp_value
        from @part where p_partkey % 6 = 0
        union all
        select 4 * p_partkey, 'notoc', '' from @part where p_partkey % 4 = 1
        union all
        select 4 * p_partkey, 'defaultsort', p_name from @part where p_partkey % 9 = 2""",
    "page_restrictions": f"""
        select p_partkey * 2 as pr_id, 4 * p_partkey as pr_page, 'edit' as pr_type,
               'sysop' as pr_level, p_partkey % 20 = 0 as pr_cascade,
               (case p_partkey % 3 when 0 then cast(null as #ts)
                     when 1 then cast('{INFINITY}' as #ts)
                     else cast('2024-02-10 00:00:00' as #ts) end) as pr_expiry
        from @part where p_partkey % 10 = 0
        union all
        select p_partkey * 2 + 1, 4 * p_partkey, 'move', 'autoconfirmed', false,
               (case p_partkey % 2 when 0 then cast('2024-01-10 00:00:00' as #ts)
                     else cast('{INFINITY}' as #ts) end)
        from @part where p_partkey % 15 = 0""",
    "protected_titles": f"""
        select {namespace('cnt + k')} as pt_namespace, {title('cnt + k')} as pt_title,
               (case when k % 3 = 0 then 'autoconfirmed' else 'sysop' end) as pt_level,
               (case when k % 2 = 0 then cast('{INFINITY}' as #ts)
                     else cast('2024-05-01 00:00:00' as #ts) end) as pt_expiry
        from (select s_suppkey as k, (select cnt from @part_count) as cnt from @supplier) as s""",
    "line": """
        select l_orderkey % (select cnt from @part_count) as src, l_partkey as dst,
               l_suppkey, l_linenumber, l_returnflag, l_linestatus from @lineitem""",
    "pagelinks": f"""
        select distinct 4 * src as pl_from, {namespace('dst')} as pl_namespace,
               {title('dst')} as pl_title from @line where l_linenumber <= 3
        union
        select distinct 4 * src, cast(0 as int), 'Missing ' || cast(dst % 40 as string)
        from @line where l_linenumber = 4""",
    "templatelinks": f"""
        select distinct 4 * src as tl_from, {namespace('dst')} as tl_namespace,
               {title('dst')} as tl_title from @line
        where (l_linenumber = 1 and {namespace('dst')} = 10)
           or (l_linenumber = 5 and l_returnflag = 'R' and dst % 20 = 0)""",
    "imagelinks": f"""
        select distinct 4 * src as il_from, {title('dst')} as il_to from @line
        where l_linenumber = 6""",
    "categorylinks": f"""
        select 4 * p_partkey as cl_from, 'NATION ' || cast(p_partkey % 25 as string) as cl_to,
               '' as cl_sortkey_prefix,
               (case {namespace('p_partkey')} when 6 then 'file' when 14 then 'subcat'
                     else 'page' end) as cl_type
        from @part
        union all
        select 4 * p_partkey, {title('cast(floor(p_partkey / 8) as bigint)')}, 'k',
               (case {namespace('p_partkey')} when 6 then 'file' when 14 then 'subcat'
                     else 'page' end)
        from @part where p_partkey % 2 = 0
        union all
        select cast(8 * n.n_nationkey + 7 as bigint), r.r_name, '', 'subcat'
        from @nation as n join @region as r on n.n_regionkey = r.r_regionkey
        union all
        select cast(8 * r_regionkey + 3 as bigint), 'Top', '', 'subcat' from @region
        union all
        select cast(8 * r_regionkey + 3 as bigint), 'NATION 2', 'loop', 'subcat'
        from @region where r_regionkey = 2""",
    "langlinks": f"""
        select 4 * p_partkey as ll_from, 'de' as ll_lang, {base_title('p_partkey')} as ll_title
        from @part where p_partkey % 4 = 0 or p_partkey % 12 = 3
        union all
        select 4 * p_partkey, 'es', {linked_title('p_partkey')} from @part
        where p_partkey % 4 = 0 and p_partkey % 5 <> 0
        union all
        select 4 * p_partkey, 'cs', (case when p_partkey % 24 = 0 then {linked_title('p_partkey + 192')}
                                          else {linked_title('p_partkey')} end)
        from @part where p_partkey % 4 = 0 and p_partkey % 3 = 0
        union all
        select 4 * p_partkey, 'en', (case when p_partkey % 8 = 2 then {linked_title('p_partkey')}
                                          else {linked_title('p_partkey + 64')} end)
        from @part where p_partkey % 4 = 2""",
    "iwlinks": f"""
        select distinct 4 * src as iwl_from, 's' || cast(l_suppkey as string) as iwl_prefix,
               {title('dst')} as iwl_title from @line where l_linenumber = 2""",
    "externallinks": """
        select distinct el_from, el_to from (
          select 4 * page_id + 1 as el_from, url as el_to from @pages
          union all
          select 4 * page_id + 1, 'https://' || #x(html, '&copy; ([^ ]*) ', 1)# || '/about'
          from @pages
          union all
          select 4 * page_id + 1, 'http://user' || chr(64) || 'host' || cast(page_id % 7 as string) || '.example.com/'
          from @pages where page_id % 10 = 1
          union all
          select 4 * page_id + 1, 'http://127.0.0.' || cast(page_id % 7 as string) || ':8080/x'
          from @pages where page_id % 10 = 2
          union all
          select 4 * page_id + 1, 'ftp://files.example.com/' || cast(page_id as string)
          from @pages where page_id % 10 = 3
          union all
          select 4 * page_id + 1, 'http://localhost/' || cast(page_id as string)
          from @pages where page_id % 10 = 4
          union all
          select 4 * page_id + 1, 'https://10.1.' || cast(page_id % 256 as string) || '.1/a#b'
          from @pages where page_id % 10 = 5
          union all
          select 4 * page_id + 1, 'https://abc' || cast(page_id % 3 as string) || '.onion/'
          from @pages where page_id % 10 = 6
        ) as u""",
    "redirect": f"""
        select 4 * k as rd_from,
               (case when k % 50 = 7 then null else {namespace('dst')} end) as rd_namespace,
               {title('dst')} as rd_title,
               (case when k % 50 = 7 then 's' || cast(k % 10 as string) else null end)
                 as rd_interwiki,
               (case when k % 5 = 0 then 'Section ' || cast(k % 4 as string) else null end)
                 as rd_fragment
        from (select p_partkey as k, (p_partkey * 7 + 3) % (select cnt from @part_count) as dst
              from @part where p_partkey % 3 <> 0) as e
        union all
        select 4 * conv_id + 2, (case when conv_id % 12 = 1 then 1 else 0 end),
               {title('conv_id * 14 + 3')}, cast(null as string), cast(null as string)
        from @conversations where turn = 0 and conv_id % 6 = 1 and {namespace('conv_id * 2')} <> 1""",
    "section": f"""
        select 4 * conv_id + 2 as sec_page, cast(turn + 1 as int) as sec_number,
               cast(2 as int) as sec_level,
               (case when conv_id % 5 = 2 then '<s>' || role || ' ' || cast(turn as string) || '</s>'
                     else role || ' ' || cast(turn as string) end) as sec_title,
               role || '_' || cast(turn as string) as sec_anchor
        from @conversations where {namespace('conv_id * 2')} <> 1
        union all
        select 4 * p_partkey, cast(1 as int), cast(2 as int), 'Section 0', 'Section_0'
        from @part where p_partkey % 2 = 0
        union all
        select 4 * p_partkey, cast(2 as int), cast(3 as int),
               'Section ' || cast(1 + p_size % 3 as string),
               'Section_' || cast(1 + p_size % 3 as string)
        from @part where p_partkey % 3 = 1""",
    "ws_parser_cache_sync": """
        select page_id as wspc_page_id,
               (case when page_id % 5 = 0 then page_latest - 1 else page_latest end) as wspc_rev_id
        from @page where page_id % 3 <> 0 and page_latest > 0""",
    # landed results of URL checks, one row per distinct URL
    "url_fetch": """
        select el_to as url,
               (case length(el_to) % 9 when 0 then 404 when 1 then 200 when 2 then 403
                     when 3 then 429 when 4 then 503 when 5 then 200 when 6 then 410
                     when 7 then null else 301 end) as http_status,
               (case when length(el_to) % 9 = 7 then 'connection error' else null end)
                 as text_status,
               (case when length(el_to) % 6 = 0 then 'cloudflare' else 'nginx' end) as server,
               length(el_to) % 5 as age_days
        from (select distinct el_to from @externallinks) as u""",
}


def _dialect(sql: str, spark: bool) -> str:
    """Resolve the ``#`` marks: timestamp type, regex extract and regex replace."""
    if spark:
        sql = sql.replace("#ts", "timestamp_ntz")
        sql = sql.replace("%1", "$1").replace("%2", "$2").replace("%n", r"\n")
        sql = sql.replace("#r(", "regexp_replace(").replace("#x(", "regexp_extract(")
        return sql.replace(")#", ")")
    sql = sql.replace("#ts", "timestamp").replace("%1", r"\1").replace("%2", r"\2")
    sql = sql.replace("%n", "\n").replace("#x(", "regexp_extract(")
    sql = sql.replace("#r(", "regexp_replace(")
    # every replace is global
    return re.sub(r"'\)#", "', 'g')", sql).replace(")#", ")")


def _references(sql: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"@(\w+)", sql)))


def spark_sql(name: str) -> str:
    return _dialect(TABLES[name], spark=True)


def oracle_prefix(sql: str) -> str:
    """``WITH`` clause with the sample tables that ``sql`` needs, for DuckDB."""
    needed: dict[str, str] = {}

    def add(name: str) -> None:
        if name in needed or name not in TABLES:
            return
        for dep in _references(TABLES[name]):
            add(dep)
        needed[name] = re.sub(r"@(\w+)", r"\1", _dialect(TABLES[name], spark=False))

    for name in _references(sql):
        add(name)
    return ",\n".join(f"{name} as ({text})" for name, text in needed.items())


def oracle(sql: str) -> str:
    """Complete DuckDB statement for a query text that uses ``@table`` names."""
    body = re.sub(r"@(\w+)", r"\1", sql).strip()
    prefix = oracle_prefix(sql)
    if not prefix:
        return body
    lowered = body.lower()
    if lowered.startswith("with recursive "):
        return "with recursive " + prefix + ",\n" + body[len("with recursive "):]
    if lowered.startswith("with "):
        return "with " + prefix + ",\n" + body[len("with "):]
    return "with " + prefix + "\n" + body
