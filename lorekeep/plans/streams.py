"""Queries for streaming jobs (ST): the sample lands as files, the stream runs until they are used up."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorekeep.operators import changes as C
from lorekeep.plans.activity import PHRASES, _phrase_sql
from lorekeep.plans.changes import ACTIONS, EVENT_BITS, REV_BITS, _TAGS
from lorekeep.plans.registry import query
from lorekeep.sources.files import scratch_folder
from lorekeep.streaming import feeds as ST


def _landed(cat, table: str, time: str, again: str | None = None):
    """Land a table as JSON, one folder per day; days matching ``again`` land twice."""
    path = scratch_folder(cat.spark, "landing-" + table)
    df = cat[table].withColumn("day", F.to_date(time))
    df.repartitionByRange("day").write.partitionBy("day").json(path)
    if again:
        df.where(again).drop("day").write.json(path + "/again")
    return path


def _run(cat, stream, mode: str = "append"):
    root = scratch_folder(cat.spark, "stream")
    return ST.run_available(stream, root + "/data", root + "/checkpoint", mode)


_SECOND = "date_trunc('second', {x} + interval 500 millisecond)"


@query("st01_ingest", f"""
  select r.rc_id, coalesce(e.bitmask, b.bitmask, r.rc_deleted) as rc_deleted,
         r.rc_patrolled or coalesce(r.rc_this_oldid in (select cast(json_extract(log_params, '$.curid') as bigint)
           from @logging where log_type = 'patrol'), false) as rc_patrolled
  from @recentchanges r left join {REV_BITS} b on b.id = r.rc_this_oldid left join {EVENT_BITS} e on e.id = r.rc_logid""")
def ingest(cat):
    changes = ST.read_changes(cat.spark, _landed(cat, "recentchanges", "rc_timestamp", "day = '2024-01-05'"))
    log = ST.read_changes(cat.spark, _landed(cat, "logging", "log_timestamp"), "logging")
    tables = ST.ingest(changes, log, scratch_folder(cat.spark, "ingest"))
    return tables["recentchanges"].select("rc_id", "rc_deleted", "rc_patrolled")


@query("st02_spam_alerts", f"""
  select doc_id, {_phrase_sql('t')} as spam_score from (
    select doc_id, source, lower(regexp_replace(text, '[!-/:-@\\[-`{{-~]', '', 'g')) as t from @documents) d
  where {_phrase_sql('t')} > 5""")
def spam_alerts(cat):
    path = scratch_folder(cat.spark, "landing-documents")
    docs = cat["documents"].select("doc_id", "source", "text")
    docs.write.json(path)
    stream = ST.read_stream(cat.spark, path, docs.schema)
    return _run(cat, ST.spam_alerts(stream, "source", "text", PHRASES)).select("doc_id", "spam_score")


@query("st03_deduplicated", f"""
  select rc_id, rc_user_text, {_SECOND.format(x='rc_timestamp')} as rc_timestamp from @recentchanges""")
def deduplicated(cat):
    stream = ST.read_changes(cat.spark, _landed(cat, "recentchanges", "rc_timestamp", "day = '2024-01-05'"))
    once = ST.deduplicated(stream, ["rc_id"], "rc_timestamp", "60 days")
    return _run(cat, once).select("rc_id", "rc_user_text", "rc_timestamp")


@query("st04_daily_counts", f"""
  select date_trunc('day', {_SECOND.format(x='rc_timestamp')}) as day, rc_type, count(*) as events from @recentchanges group by 1, 2""")
def daily_counts(cat):
    stream = ST.read_changes(cat.spark, _landed(cat, "recentchanges", "rc_timestamp"), files_per_batch=10)
    counts = ST.daily_counts(stream, "rc_timestamp", by=["rc_type"])
    return ST.latest_rows(_run(cat, counts, "update"), ["day", "rc_type"])


@query("st04_sliding_counts", f"""
  select d.until, count(*) as events from @recentchanges r
  join (select unnest(generate_series(timestamp '2024-01-02', timestamp '2024-03-05', interval 1 day)) as until) d
    on {_SECOND.format(x='r.rc_timestamp')} < d.until and {_SECOND.format(x='r.rc_timestamp')} >= d.until - interval 30 day
  group by 1""")
def sliding_counts(cat):
    stream = ST.read_changes(cat.spark, _landed(cat, "recentchanges", "rc_timestamp"), files_per_batch=20)
    daily = ST.latest_rows(_run(cat, ST.daily_counts(stream, "rc_timestamp"), "update"), ["day"])
    return ST.sliding_counts(daily)


# sessions whose end the watermark has passed: the others are still open
@query("st05_sessions", f"""
  select * from (select rc_user_text, min(t) as start, max(t) as "end", count(*) as edits from (
    select *, sum(fresh) over (partition by rc_user_text order by t, rc_id) as session from (
      select rc_id, rc_user_text, t, case when t - lag(t) over (partition by rc_user_text order by t, rc_id) <= interval 6 hour
        then 0 else 1 end as fresh
      from (select rc_id, rc_user_text, {_SECOND.format(x='rc_timestamp')} as t from @recentchanges) a) b) s
  group by rc_user_text, session) c
  where "end" + interval 6 hour <= (select max({_SECOND.format(x='rc_timestamp')}) - interval 2 day from @recentchanges)""")
def sessions(cat):
    stream = ST.read_changes(cat.spark, _landed(cat, "recentchanges", "rc_timestamp"), files_per_batch=1000)
    return _run(cat, ST.sessions(stream, "rc_user_text", "rc_timestamp", "6 hours", "2 days")).drop("batch")


@query("st06_tag_actions", f"select id, tag_name, added from {_TAGS} t")
def tag_actions(cat):
    stream = ST.read_changes(cat.spark, _landed(cat, "logging", "log_timestamp"), "logging", files_per_batch=20)
    root = scratch_folder(cat.spark, "stream")
    last = ST.last_actions(C.tag_events(stream), ["id", "tag_name"], root + "/data", root + "/checkpoint")
    return last.select("id", "tag_name", "added")


@query("st06_page_actions", f"select log_namespace, log_title, action from {ACTIONS} a")
def page_actions(cat):
    stream = ST.read_changes(cat.spark, _landed(cat, "logging", "log_timestamp"), "logging", files_per_batch=20)
    root = scratch_folder(cat.spark, "stream")
    key = ["log_namespace", "log_title"]
    last = ST.last_actions(C.page_events(stream), key, root + "/data", root + "/checkpoint")
    return last.select("log_namespace", "log_title", "action")


@query("st07_late_events", f"""
  select rc_id, {_SECOND.format(x='rc_timestamp')} as rc_timestamp from @recentchanges
  where cast(rc_timestamp as date) <> '2024-01-03'""")
def late_events(cat):
    # day 3 lands after the rest of the month and is older than the watermark by then
    path, root = scratch_folder(cat.spark, "landing-late"), scratch_folder(cat.spark, "stream")
    rows, day = cat["recentchanges"], F.to_date("rc_timestamp")

    def run():
        stream = ST.read_changes(cat.spark, path)
        return ST.run_available(
            ST.deduplicated(stream, ["rc_id"], "rc_timestamp", "7 days"), root + "/data", root + "/checkpoint")

    rows.where(day != "2024-01-03").write.json(path + "/1")
    run()
    rows.where(day == "2024-01-03").write.json(path + "/2")
    return run().select("rc_id", "rc_timestamp")


@query("st08_enriched", """
  select l.log_id, n.nss_name, u.user_name, p.page_id from @logging l
  left join @namespace_starname n on n.nss_id = l.log_namespace left join @users u on u.user_id = l.log_user
  left join @page p on p.page_namespace = l.log_namespace and p.page_title = l.log_title""")
def enriched(cat):
    stream = ST.read_changes(cat.spark, _landed(cat, "logging", "log_timestamp"), "logging", files_per_batch=1000)
    return _run(cat, ST.enriched(stream, cat)).select("log_id", "nss_name", "user_name", "page_id")
