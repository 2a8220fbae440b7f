"""Queries for sources and sinks (S): written to the shared scratch folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorekeep.functions.encodings import sha1_to_base36
from lorekeep.plans.registry import query
from lorekeep.sources import files as S
from lorekeep.sources.catalog import Catalog
from lorekeep.sources.sample import TODAY


@query("s01_table_by_name", "select page_id, page_namespace, page_title, page_latest, cast(null as timestamp) as page_links_updated from @page")
def table_by_name(cat):
    root = S.scratch_folder(cat.spark, "snapshot")
    S.write_snapshot({"page": cat["page"]}, root)
    return Catalog(cat.spark, root).page.select("page_id", "page_namespace", "page_title", "page_latest", "page_links_updated")


@query("s01_partitioned_by_month", "select strftime(o_orderdate, '%Y-%m') as ym, count(*) as n from @orders group by 1")
def partitioned_by_month(cat):
    path = S.scratch_folder(cat.spark, "months")
    S.write_partitioned(cat["orders"].select("o_orderkey", "o_orderdate"), path, "o_orderdate")
    stored = cat.spark.read.parquet(path)
    return stored.groupBy(F.col("ym").cast("string").alias("ym")).agg(F.count(F.lit(1)).alias("n"))


@query("s02_history_dump", """
  select r.rev_id, r.rev_page, p.page_title, r.rev_user, r.rev_user_text, date_trunc('second', r.rev_timestamp) as rev_timestamp,
         r.rev_minor_edit, lpad(r.rev_sha1, 40, '0') as rev_sha1, r.rev_comment as old_text
  from @revision r join @page p on p.page_id = r.rev_page""")
def history_dump(cat):
    path = S.scratch_folder(cat.spark, "dump")
    rows = cat["revision"].join(cat["page"], F.col("rev_page") == F.col("page_id"))
    revision = F.struct(
        F.col("rev_id").alias("id"), F.col("rev_parent_id").alias("parentid"),
        F.date_format("rev_timestamp", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"),
        F.struct(F.col("rev_user_text").alias("username"), F.col("rev_user").alias("id")).alias("contributor"),
        F.when(F.col("rev_minor_edit"), F.lit("")).alias("minor"), F.col("rev_comment").alias("comment"),
        F.col("rev_content_model").alias("model"), F.col("rev_content_format").alias("format"),
        F.col("rev_comment").alias("text"), sha1_to_base36("rev_sha1").alias("sha1"),
    )
    # one element per revision; pages may repeat in a dump
    pages = rows.select(
        F.col("page_title").alias("title"), F.col("page_namespace").alias("ns"), F.col("page_id").alias("id"), revision.alias("revision")
    )
    pages.write.format("xml").option("rootTag", "mediawiki").option("rowTag", "page").save(path)
    return S.read_dump(cat.spark, path).select(
        "rev_id", "rev_page", "page_title", "rev_user", "rev_user_text", "rev_timestamp", "rev_minor_edit", "rev_sha1", "old_text")


@query("s02_long_histories", """
  select r.rev_id, p.page_id as rev_page, p.page_title, r.rev_user_text, r.rev_minor_edit,
         r.rev_comment || ' <a & b>' || chr(10) as old_text
  from @revision r join @page p on p.page_id = (r.rev_page - 1) % 20 + 1""")
def long_histories(cat):
    # histories of many pages put together, so that each page has very many revisions
    path = S.scratch_folder(cat.spark, "dump")
    text = F.concat("rev_comment", F.lit(" <a & b>\n"))
    rows = cat["revision"].withColumn("rev_page", (F.col("rev_page") - 1) % 20 + 1).join(
        cat["page"], F.col("rev_page") == F.col("page_id")).withColumns({"old_text": text, "sha1": sha1_to_base36("rev_sha1")})
    S.write_dump(rows, path)
    return S.read_dump(cat.spark, path).select("rev_id", "rev_page", "page_title", "rev_user_text", "rev_minor_edit", "old_text")


@query("s03_change_feed", """
  select rc_id, rc_user_text, date_trunc('second', rc_timestamp + interval 500 millisecond) as rc_timestamp, rc_type, rc_params
  from @recentchanges where date_trunc('second', rc_timestamp + interval 500 millisecond) >= '2024-01-10'""")
def change_feed(cat):
    path = S.scratch_folder(cat.spark, "feed")
    cat["recentchanges"].write.json(path)
    feed = S.read_feed(cat.spark, path, "recentchanges", since="2024-01-10", time_column="rc_timestamp")
    return feed.select("rc_id", "rc_user_text", "rc_timestamp", "rc_type", "rc_params")


@query("s04_site_snapshot", """
  select 'namespace' as kind, cast(ns_id as varchar) as key, ns_subpages as flag from @namespace
  union all select 'interwiki', iw_prefix, iw_local from @interwiki
  union all select 'tag', tag_name, tag_active from @tag
  union all select 'name', nsn_name, nsn_id >= 0 from @namespace_name""")
def site_snapshot(cat):
    path = S.scratch_folder(cat.spark, "site")
    mark = lambda name: F.when(F.col(name), F.lit(""))
    spaces = cat["namespace"].join(cat["namespace_starname"], F.col("ns_id") == F.col("nss_id")).join(
        cat["namespace_canonical"], F.col("ns_id") == F.col("nsc_id"), "left")
    # one landed record per entry, as paged requests deliver them
    records = [
        spaces.select(F.array(F.struct(
            F.col("ns_id").alias("id"), F.col("ns_case").alias("case"), F.col("nss_name").alias("*"),
            F.col("nsc_name").alias("canonical"), mark("ns_subpages").alias("subpages"))).alias("namespaces")),
        cat["namespace_alias"].select(F.array(F.struct(
            F.col("nsa_id").alias("id"), F.col("nsa_name").alias("*"))).alias("namespacealiases")),
        cat["interwiki"].select(F.array(F.struct(
            F.col("iw_prefix").alias("prefix"), F.col("iw_url").alias("url"), mark("iw_local").alias("local"))).alias("interwikimap")),
        cat["tag"].select(F.array(F.struct(
            F.col("tag_name").alias("name"), F.col("tag_displayname").alias("displayname"), mark("tag_active").alias("active"),
            F.col("tag_source").alias("source"))).alias("tags")),
    ]
    for df in records:
        df.write.mode("append").json(path)
    site = S.read_site(cat.spark, path, lines=True)
    pick = lambda kind, table, key, flag: site[table].select(
        F.lit(kind).alias("kind"), F.col(key).cast("string").alias("key"), flag.alias("flag"))
    return (
        pick("namespace", "namespace", "ns_id", F.col("ns_subpages"))
        .union(pick("interwiki", "interwiki", "iw_prefix", F.col("iw_local")))
        .union(pick("tag", "tag", "tag_name", F.col("tag_active")))
        .union(pick("name", "namespace_name", "nsn_name", F.col("nsn_id") >= 0))
    )


@query("s05_package_list", "select 'pkg' || c_custkey as name from @customer where c_custkey % 3 <> 0")
def package_list(cat):
    path = S.scratch_folder(cat.spark, "packages")
    line = F.when(F.col("c_custkey") % 3 == 0, F.lit("# note")).otherwise(F.concat(F.lit(" pkg"), "c_custkey", F.lit(" ")))
    cat["customer"].select(line.alias("value")).write.option("compression", "gzip").text(path)
    return S.read_package_list(cat.spark, path)


@query("s06_recovered_revisions", """
  select ar_rev_id as rev_id, ar_user_text as rev_user_text, ar_len as rev_len from @archive
  union select rev_id, rev_user_text, rev_len from @revision""")
def recovered_revisions(cat):
    from lorekeep.operators.changes import insert_ignore

    path = S.scratch_folder(cat.spark, "recovered")
    lost = cat["archive"].select(
        F.col("ar_rev_id").alias("rev_id"), F.col("ar_user_text").alias("rev_user_text"), F.col("ar_len").alias("rev_len"))
    lost.write.json(path)
    stored = cat["revision"].select("rev_id", "rev_user_text", "rev_len")
    return insert_ignore(stored, S.read_recovered(cat.spark, path, lines=True).select(*stored.columns), ["rev_id"])


@query("s07_rule_tables", """
  select lang, count(*) as docs, max(case lang when 'en' then 'English' when 'fr' then 'Français' when 'de' then 'Deutsch'
    when 'es' then 'Español' end) as name from @documents group by 1""")
def rule_tables(cat):
    from lorekeep.functions.langs import language_table

    rules = language_table(cat.spark).select(F.col("tag").alias("lang"), "name")
    counts = cat["documents"].groupBy("lang").agg(F.count(F.lit(1)).alias("docs"))
    return counts.join(rules, "lang").select("lang", "docs", "name")


_USERS = "(select rc_user_text as u, count(*) as n from @recentchanges group by 1)"


@query("s08_wiki_table", f"""
  select 'u,n' as fields, row_number() over (order by n desc, u) - 1 as row, u, cast(n as varchar) as n from {_USERS} t""")
def wiki_table(cat):
    path = S.scratch_folder(cat.spark, "table")
    rows = cat["recentchanges"].groupBy(F.col("rc_user_text").alias("u")).agg(F.count(F.lit(1)).alias("n"))
    S.write_lines(S.wiki_table(rows, ["u", "n"], [F.col("n").desc(), F.col("u")]), path, files=4)
    return S.read_wiki_table(cat.spark, path).select(
        F.array_join("fields", ",").alias("fields"), "row", F.col("cells")[0].alias("u"), F.col("cells")[1].alias("n"))


@query("s09_parsed_table", """
  select c_mktsegment as segment, cast(c_nationkey as varchar) as nation, cast(count(*) as varchar) as customers,
         case when c_nationkey % 3 = 0 then '' else 'x' end as note
  from @customer group by 1, c_nationkey""")
def parsed_table(cat):
    # one cell per line, the first and last ones empty in some rows
    path = S.scratch_folder(cat.spark, "cells")
    note = F.when(F.col("c_nationkey") % 3 != 0, F.lit("x")).alias("note")
    rows = cat["customer"].groupBy("c_mktsegment", "c_nationkey").agg(F.count(F.lit(1)).alias("n")).select("*", note)
    columns = ["note", "c_mktsegment", "c_nationkey", "n"]
    S.write_lines(S.wiki_table(rows, columns, [F.col("c_mktsegment"), F.col("c_nationkey")], False), path, files=5)
    cell = lambda i, name: F.col("cells")[i].alias(name)
    return S.read_wiki_table(cat.spark, path).select(
        cell(1, "segment"), cell(2, "nation"), cell(3, "customers"), cell(0, "note"))


@query("s10_report", """
  select language, title, line from (
    select distinct 'English' as language, rc_title as title, '* [[' || rc_title || ']]' as line from @recentchanges where not contains(rc_title, '(')
    union all select 'English', rc_title, '** ' || rc_id from @recentchanges where not contains(rc_title, '(')
    union all
    select distinct regexp_extract(rc_title, '\\(([^)]*)\\)$', 1), rc_title, '* [[' || rc_title || ']]' from @recentchanges where contains(rc_title, '(')
    union all select regexp_extract(rc_title, '\\(([^)]*)\\)$', 1), rc_title, '** ' || rc_id from @recentchanges where contains(rc_title, '(')) r""")
def report(cat):
    path = S.scratch_folder(cat.spark, "report")
    S.write_report(cat["recentchanges"].select(F.col("rc_title").alias("title"), F.col("rc_id").cast("string").alias("message")), path)
    return cat.spark.read.schema("title string, line string, language string").json(path + "/json").select("language", "title", "line")


_LANG = """(case when page_title like '% (Español)' then 'es' when page_title like '% (Français)' then 'fr'
  when page_title like '% (Čeština)' then 'cs' else 'en' end)"""
_BASE = "regexp_replace(page_title, ' \\((Español|Français|Čeština)\\)$', '')"
_EXPORT = f"""(select page_id, page_touched, (case when ns = '' then {_LANG} || '/' || base || '.wiki'
      when ns in ('Talk', 'Project', 'Template', 'Help', 'Category') then {_LANG} || '/' || ns || ':' || base || '.wiki'
      when ns = 'File' then ns || ':' || base else ns || ':' || base || '.wiki' end) as path
  from (select *, replace(n.nss_name, ' ', '_') as ns, case when regexp_full_match({_BASE}, '[ -~]*') then replace({_BASE}, ' ', '_')
          else md5(replace({_BASE}, ' ', '_')) end as base
        from @page p left join @namespace_starname n on n.nss_id = p.page_namespace where not p.page_is_redirect) q)"""


@query("s11_export_paths", f"select page_id, path, page_touched as touched from {_EXPORT} e")
def export_paths(cat):
    return S.exported_pages(cat, cat["page"], ascii_only=True)


@query("s12_export_changes", f"""
  with e as (select path, page_touched as touched from {_EXPORT} x),
  m as (select path, case when length(path) % 2 = 0 then timestamp '2024-01-20' else timestamp '2024-02-01' end as written
        from {_EXPORT} x where length(path) % 5 <> 0
        union all select 'old/' || n_name, timestamp '2024-01-01' from @nation)
  select coalesce(e.path, m.path) as path, case when e.path is null then 'delete' else 'write' end as action
  from e full join m on m.path = e.path
  where e.path is null or m.written is null or m.written < e.touched or m.written < '2024-01-25'""")
def export_changes(cat):
    exported = S.exported_pages(cat, cat["page"], ascii_only=True)
    day = lambda x: F.lit(x).cast("timestamp_ntz")
    written = exported.where("length(path) % 5 <> 0").select(
        "path", F.when(F.length("path") % 2 == 0, day("2024-01-20")).otherwise(day("2024-02-01")).alias("written"))
    stale = cat["nation"].select(F.concat(F.lit("old/"), "n_name").alias("path"), day("2024-01-01").alias("written"))
    return S.export_changes(exported, written.unionByName(stale), epoch="2024-01-25")


@query("c04_full_refresh", f"select user_id, user_name, cast('{TODAY}' as timestamp) as synced from @users")
def full_refresh(cat):
    from lorekeep.operators.changes import set_sync_timestamp

    root = S.scratch_folder(cat.spark, "refresh")
    sync = cat.spark.createDataFrame([], "wss_key string, wss_timestamp timestamp_ntz")
    S.write_snapshot({"users": cat["users"], "ws_sync": set_sync_timestamp(sync, "users", TODAY)}, root)
    fresh = Catalog(cat.spark, root)
    when = fresh.ws_sync.where("wss_key = 'users'").select("wss_timestamp").scalar()
    return fresh.users.select("user_id", "user_name", when.alias("synced"))
