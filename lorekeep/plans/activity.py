"""Queries for aggregations (A), windows (W), rankings (O) and set operations (U)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorekeep.functions.langs import pure_title, title_language
from lorekeep.operators import activity as A
from lorekeep.operators.graph import place_in_group
from lorekeep.plans.registry import query
from lorekeep.sources.sample import TODAY

MIN_TOTAL = 50
PHRASES = ["the with", "ere", "nicht", "réeau"]

EDITS = f"""(select rev_user_text as user_name, rev_timestamp as ts, rev_id from @revision where rev_timestamp <= '{TODAY}'
  union all select ar_user_text, ar_timestamp, ar_rev_id from @archive where ar_timestamp <= '{TODAY}')"""
DAYS = f"""(select user_name, cast(ts as date) as day, count(*) as edits, min(ts) as first_ts, max(ts) as last_ts
  from {EDITS} e group by 1, 2)"""
STREAKS = f"""(select user_name, streak, date_sub('day', min(first_ts), max(last_ts)) + 1 as length,
    min(day) as "start", max(day) as "end", cast(sum(edits) as bigint) as edits,
    cast(date_diff('day', min(day), max(day)) + 1 as bigint) as calendar_days, max(last_ts) as last_ts
  from (select *, cast(sum(gap) over (partition by user_name order by day) as bigint) as streak from (
    select *, case when day - lag(day) over (partition by user_name order by day) <= 1 then 0 else 1 end as gap
    from {DAYS} d) g) r group by 1, 2)"""
LONGEST = f"""(select * from {STREAKS} s
  qualify row_number() over (partition by user_name order by length desc, "start") = 1)"""
CURRENT = f"""(select * from (select * from {STREAKS} s
    qualify row_number() over (partition by user_name order by "start" desc) = 1) l
  where timestamp '{TODAY}' - last_ts <= interval 1 day)"""
RECENT = f"""(select rc_user_text as user_name, count(*) as recent_edits from @recentchanges
  where rc_type in ('edit', 'new') and rc_timestamp between timestamp '{TODAY}' - interval 30 day and '{TODAY}'
  group by 1)"""
DAILY = f"""(select s.user_name, s.day, coalesce(d.edits, 0) as edits
  from (select user_name, cast(unnest(generate_series(min(day), max(day), interval 1 day)) as date) as day
        from {DAYS} x group by 1) s
  left join {DAYS} d on d.user_name = s.user_name and d.day = s.day)"""


def _edits(cat):
    return A.every_revision(cat, TODAY)


def _days(cat):
    return A.user_days(_edits(cat))


def _text(df, *columns):
    """Dates as text, which every client shows alike."""
    for name in columns:
        df = df.withColumn(name, F.col(name).cast("string"))
    return df


USER_TABLE = f"""
  select u.user_name, coalesce(r.recent_edits, 0) as recent_edits, coalesce(t.total, 0) as total_edits,
         u.user_registration as registration, coalesce(g.groups, '') as groups,
         l.length as longest_length, cast(l."start" as varchar) as longest_start,
         cast(l."end" as varchar) as longest_end, l.edits as longest_edits,
         k.length as current_length, cast(k."start" as varchar) as current_start,
         cast(k."end" as varchar) as current_end, k.edits as current_edits,
         case when u.user_registration is null then 'nan'::double else coalesce(t.total, 0)
              / (date_sub('day', u.user_registration, timestamp '{TODAY}') + 1) end as total_average,
         t.total / (date_sub('day', t.a, t.b) + 1) as active_average
  from @users u
  left join {RECENT} r on r.user_name = u.user_name
  left join (select user_name, count(*) as total, min(ts) as a, max(ts) as b from {EDITS} e group by 1) t
    on t.user_name = u.user_name
  left join {LONGEST} l on l.user_name = u.user_name
  left join {CURRENT} k on k.user_name = u.user_name
  left join (select ug_user, string_agg(ug_group, ', ' order by ug_group) as groups from @user_groups group by 1) g
    on g.ug_user = u.user_id
  where u.user_id > 0 and (coalesce(u.user_editcount, 0) >= {MIN_TOTAL} or r.recent_edits >= 1)
    and not exists (select 1 from @ipblocks b where b.ipb_user = u.user_id
                    and b.ipb_expiry >= '9999-12-31 23:59:59.999999')"""


@query("a09_user_statistics", USER_TABLE)
def user_statistics(cat):
    df = A.user_statistics(cat, TODAY, min_total=MIN_TOTAL)
    return _text(df, "longest_start", "longest_end", "current_start", "current_end")


@query("o04_ranked_users", f"""
  select cast(row_number() over (order by recent_edits desc, total_edits desc, registration nulls last, user_name)
              as bigint) as place, user_name, recent_edits, total_edits
  from ({USER_TABLE}) t""")
def ranked_users(cat):
    users = A.user_statistics(cat, TODAY, min_total=MIN_TOTAL).withColumn("_all", F.lit(0))
    placed = place_in_group(users, "_all", A.ranking())
    return placed.select(F.col("place").cast("long").alias("place"), "user_name", "recent_edits", "total_edits")


@query("a10_threshold_counts", f"""
  select cast(count(*) filter (total_edits > {MIN_TOTAL}) as bigint) as major_users, count(*) as listed_users,
         (select count(distinct user_name) from {RECENT} r) as active_users from ({USER_TABLE}) t""")
def threshold_counts(cat):
    table = A.user_statistics(cat, TODAY, min_total=MIN_TOTAL)
    return A.threshold_counts(table, A.active_users(cat, TODAY), MIN_TOTAL)


@query("a04_total_edits", f"select user_name, count(*) as total_edits from {EDITS} e group by 1")
def total_edits(cat):
    return A.total_edits(_days(cat))


@query("u01_every_revision", f"select user_name, ts, rev_id from {EDITS} e")
def every_revision(cat):
    return _edits(cat)


@query("a05_recent_edits", f"select user_name, recent_edits from {RECENT} r")
def recent_edits(cat):
    return A.recent_edits(cat, TODAY)


@query("w11_activity_window", """
  select rc_id, rc_timestamp from @recentchanges where rc_type in ('edit', 'new')
    and rc_timestamp between '2024-01-21 00:00:00' and '2024-01-28 00:00:00'""")
def activity_window(cat):
    return A.recent_window(cat, "2024-01-28 00:00:00", 7).select("rc_id", "rc_timestamp")


@query("a06_active_users", f"select count(*) as active_users from {RECENT} r")
def active_users(cat):
    return A.active_users(cat, TODAY)


_SKETCHED = "(select distinct cast(rc_timestamp as date) as day, rc_user_text as u from @recentchanges where rc_type in ('edit', 'new'))"


@query("a06_active_users_approx", f"select cast(day as varchar) as day, true as close from {_SKETCHED} d group by day")
def active_users_approx(cat):
    # at most 3 % from the exact count of each window
    edits = cat["recentchanges"].where("rc_type in ('edit', 'new')")
    days = edits.select(F.to_date("rc_timestamp").alias("day"), "rc_user_text").distinct()
    exact = days.select(F.explode(F.sequence("day", F.date_add("day", 29))).alias("day"), "rc_user_text").groupBy("day").agg(
        F.countDistinct("rc_user_text").alias("exact"))
    found = A.sketched_active_users(A.daily_user_sketches(cat["recentchanges"]), 30).join(exact, "day")
    close = F.abs(F.col("active_users") - F.col("exact")) <= 0.03 * F.col("exact")
    return _text(found.select("day", close.alias("close")), "day")


@query("a12_monthly_users_approx", f"""
  select cast(cast(date_trunc('month', day) as date) as varchar) as month, true as close from {_SKETCHED} d group by 1""")
def monthly_users_approx(cat):
    edits = cat["recentchanges"].where("rc_type in ('edit', 'new')")
    exact = edits.groupBy(F.trunc(F.to_date("rc_timestamp"), "month").alias("month")).agg(F.countDistinct("rc_user_text").alias("exact"))
    found = A.sketched_monthly_users(A.daily_user_sketches(cat["recentchanges"])).join(exact, "month")
    close = F.abs(F.col("users") - F.col("exact")) <= 0.03 * F.col("exact")
    return _text(found.select("month", close.alias("close")), "month")


@query("a07_edits_per_day", f"""
  select u.user_name, case when u.user_registration is null then 'nan'::double else
    t.total / (date_sub('day', u.user_registration, timestamp '{TODAY}') + 1) end as total_average
  from @users u join (select user_name, count(*) as total from {EDITS} e group by 1) t on t.user_name = u.user_name""")
def edits_per_day(cat):
    df = cat["users"].join(A.total_edits(_days(cat)), "user_name")
    average = A.edits_per_day(F.col("total_edits"), F.col("user_registration"), TODAY)
    return df.select("user_name", average.alias("total_average"))


@query("a08_active_span", f"""
  select user_name, count(*) as total_edits, count(*) / (date_sub('day', min(ts), max(ts)) + 1) as active_average
  from {EDITS} e group by 1""")
def active_span(cat):
    return A.active_span(_days(cat))


@query("w01_streaks", f"""
  select user_name, streak, length, cast("start" as varchar) as "start", cast("end" as varchar) as "end", edits,
         calendar_days, last_ts from {STREAKS} s""")
def streaks(cat):
    return _text(A.streaks(_days(cat)), "start", "end").drop("first_ts")


@query("w02_longest_streak", f"""
  select user_name, length, cast("start" as varchar) as "start", cast("end" as varchar) as "end", edits
  from {LONGEST} s""")
def longest_streak(cat):
    return _text(A.longest_streaks(A.streaks(_days(cat))), "start", "end")


@query("w03_current_streak", f"""
  select user_name, length, cast("start" as varchar) as "start", cast("end" as varchar) as "end", edits
  from {CURRENT} s""")
def current_streak(cat):
    return _text(A.current_streaks(A.streaks(_days(cat)), TODAY), "start", "end")


@query("a11_monthly_edits", """
  with m as (select cast(date_trunc('month', o_orderdate) as date) as month, count(*) as n, count(distinct o_custkey) as u
             from @orders group by 1)
  select cast(s.month as varchar) as month, coalesce(m.n, 0) as edits, coalesce(m.u, 0) as users
  from (select cast(unnest(generate_series(min(month), max(month), interval 1 month)) as date) as month from m) s
  left join m on m.month = s.month""")
def monthly_edits(cat):
    edits = cat["orders"].select(F.col("o_orderdate").alias("ts"), F.col("o_custkey").alias("user_name"))
    return _text(A.monthly_activity(edits), "month")


@query("a12_monthly_users", f"""
  select cast(cast(date_trunc('month', ts) as date) as varchar) as month, count(distinct user_name) as users
  from {EDITS} e group by 1""")
def monthly_users(cat):
    return _text(A.monthly_activity(_edits(cat)).select("month", "users"), "month")


@query("a11_yearly_rollup", """
  select cast(year(o_orderdate) as integer) as year, cast(month(o_orderdate) as integer) as month, count(*) as edits
  from @orders group by rollup (1, 2)""")
def yearly_rollup(cat):
    return A.yearly_rollup(cat["orders"].select(F.col("o_orderdate").alias("ts")))


@query("a13_daily_counts", f"select user_name, cast(day as varchar) as day, edits from {DAILY} d")
def daily_counts(cat):
    return _text(A.daily_counts(_days(cat)), "day")


@query("w10_day_spine", f"""
  select cast(cast(unnest(generate_series(min(day), max(day), interval 1 day)) as date) as varchar) as day from {DAYS} d""")
def day_spine(cat):
    from lorekeep.functions.times import spine

    bounds = _days(cat).agg(F.min("day").alias("a"), F.max("day").alias("b"))
    return _text(spine(bounds, "a", "b", "day", "day").select("day"), "day")


@query("w10_month_edges", """
  select cast(cast(unnest(generate_series(date_trunc('month', min(o_orderdate)),
         date_trunc('month', max(o_orderdate)) + interval 1 month, interval 1 month)) as date) as varchar) as month
  from @orders""")
def month_edges(cat):
    from lorekeep.functions.times import month_edges as edges

    bounds = cat["orders"].agg(F.min("o_orderdate").alias("a"), F.max("o_orderdate").alias("b"))
    return _text(bounds.select(F.explode(edges(F.col("a"), F.col("b"))).alias("month")), "month")


@query("a14_daily_max_revision", """
  with d as (select cast(o_orderdate as date) as day, max(o_orderkey) as m from @orders group by 1)
  select cast(s.day as varchar) as day, last_value(d.m ignore nulls) over (order by s.day) as max_rev_id
  from (select cast(unnest(generate_series(min(day), max(day), interval 1 day)) as date) as day from d) s
  left join d on d.day = s.day""")
def daily_max_revision(cat):
    # orders as edits: their dates leave days without any
    edits = cat["orders"].select(F.col("o_orderdate").alias("ts"), F.col("o_orderkey").alias("rev_id"))
    return _text(A.daily_max_revision(edits), "day")


ROLLING = f"""(select user_name, day, cast(sum(edits) over (partition by user_name order by day
  range between interval 6 days preceding and current row) as bigint) as edits from {DAILY} d)"""
TOP = f"""(select *, cast(row_number() over (partition by day order by edits desc, user_name) as integer) as place
  from (select * from {ROLLING} r where day >= (select min(day) from {ROLLING} x) + 7) q qualify place <= 5)"""
FILLED = f"""(select s.user_name, s.day, coalesce(last_value(t.edits ignore nulls) over
    (partition by s.user_name order by s.day range between interval 10 days preceding and current row), 0) as edits
  from (select user_name, cast(unnest(generate_series((select min(day) from {TOP} a), (select max(day) from {TOP} b),
               interval 1 day)) as date) as day from (select distinct user_name from {TOP} c) u) s
  left join {TOP} t on t.user_name = s.user_name and t.day = s.day)"""


def _rolling(cat):
    return A.rolling_counts(A.daily_counts(_days(cat)), 7)


def _top(cat):
    return A.top_per_day(_rolling(cat), 5, 7, _days(cat))


@query("w04_rolling_counts", f"select user_name, cast(day as varchar) as day, edits from {ROLLING} r")
def rolling_counts(cat):
    return _text(_rolling(cat), "day")


@query("w05_top_per_day", f"select user_name, cast(day as varchar) as day, edits, place from {TOP} t")
def top_per_day(cat):
    return _text(_top(cat), "day")


@query("w06_filled_race", f"select user_name, cast(day as varchar) as day, edits from {FILLED} f")
def filled_race(cat):
    return _text(A.fill_race(_top(cat), 10), "day")


@query("w07_race_table", f"""
  select cast(day as varchar) as day, dense_rank() over (order by user_name) as place, user_name, edits from {FILLED} f""")
def race_table(cat):
    return _text(A.race_cells(A.fill_race(_top(cat), 10)), "day")


CUMULATIVE = f"""(select user_name, day, cast(sum(edits) over (partition by user_name order by day) as bigint) as total
  from {DAILY} d)"""
RIGHTS = """(select log_id as event_id, log_timestamp as ts, log_title as user_name, log_params from @logging
  where log_type = 'rights')"""


@query("w08_cumulative", f"select user_name, cast(day as varchar) as day, total from {CUMULATIVE} c")
def cumulative(cat):
    return _text(A.cumulative_counts(A.daily_counts(_days(cat))), "day")


INTERPOLATED = f"""(select r.event_id, r.user_name, r.ts,
    case when cast(r.ts as date) = c.day and n.total is not null
         then c.total + (n.total - c.total) * (epoch_us(r.ts) - epoch_us(cast(c.day as timestamp))) / 86400000000
         else cast(c.total as double) end as value
  from {RIGHTS} r
  join (select user_name, min(day) as a, max(day) as b from {CUMULATIVE} x group by 1) s on s.user_name = r.user_name
  join {CUMULATIVE} c on c.user_name = r.user_name and c.day = greatest(s.a, least(s.b, cast(r.ts as date)))
  left join {CUMULATIVE} n on n.user_name = r.user_name and n.day = c.day + 1)"""


@query("w09_value_at_events", f"select event_id, user_name, ts, round(value, 6) as value from {INTERPOLATED} i")
def value_at_events(cat):
    series = A.cumulative_counts(A.daily_counts(_days(cat)))
    df = A.value_at_events(series, A.rights_changes(cat).select("event_id", "ts", "user_name"))
    return df.withColumn("value", F.round("value", 6))


@query("a23_activity_with_rights", f"""
  select event_id, i.user_name, i.ts, round(value, 6) as value,
         (case when json_extract_string(log_params, '$.newgroups[1]') = 'sysop' then '+sysop'
               else '+maintainer' || chr(10) || '-bot' || chr(10) || '-sysop' end) as label
  from {INTERPOLATED} i join @logging l on l.log_id = i.event_id""")
def activity_with_rights(cat):
    return A.activity_with_rights(cat, TODAY).withColumn("value", F.round("value", 6))


@query("a15_deleted_totals", """
  select count(*) as revisions, count(distinct ar_namespace || '/' || ar_title) as pages,
         count(distinct ar_user_text) as users from @archive""")
def deleted_totals(cat):
    return A.deleted_totals(cat)


@query("o03_top_deleted", """
  select ar_user_text as user_name, count(*) as revisions from @archive group by 1
  order by 2 desc, 1 limit 20""")
def top_deleted(cat):
    return A.top_deleted(cat)


@query("a17_interwiki_prefixes", """
  select distinct iwl_prefix as prefix from @iwlinks l join @page p on p.page_id = l.iwl_from
  where not p.page_is_redirect""")
def interwiki_prefixes(cat):
    return A.interwiki_prefixes(cat)


@query("a18_log_count", "select count(*) as events from @logging where log_type = 'move'")
def log_count(cat):
    return A.log_count(cat, "move")


@query("a19_keep_last", """
  select rc_cur_id, rc_user_text, rc_id, rc_type from @recentchanges
  qualify row_number() over (partition by rc_cur_id, rc_user_text order by rc_id desc) = 1""")
def keep_last(cat):
    rows = cat["recentchanges"].select("rc_cur_id", "rc_user_text", "rc_id", "rc_type")
    return A.keep_last(rows, ["rc_cur_id", "rc_user_text"], "rc_id")


@query("a21_first_occurrences", """
  select rc_cur_id, rc_user_text, min(rc_id) as rc_id from @recentchanges group by 1, 2""")
def first_occurrences(cat):
    return A.first_occurrences(cat["recentchanges"], "rc_cur_id", "rc_user_text", "rc_id")


def _phrase_sql(column: str) -> str:
    wanted = list(dict.fromkeys([*PHRASES, *(p.replace(" ", "") for p in PHRASES)]))
    parts = [
        f"cast((length({column}) - length(replace({column}, '{p}', ''))) / {len(p)} as integer)" for p in wanted
    ]
    return "greatest(" + ", ".join(parts) + ")"


@query("a22_spam_flags", f"""
  select doc_id, {_phrase_sql('t')} as spam_score,
         contains(s, 'the with') or contains(s, 'ere') or contains(s, 'nicht') or contains(s, 'réeau')
           or contains(s, 'thewith') or {_phrase_sql('t')} > 5 as is_spam
  from (select doc_id, lower(regexp_replace(text, '[!-/:-@\\[-`{{-~]', '', 'g')) as t,
               lower(regexp_replace(source, '[!-/:-@\\[-`{{-~]', '', 'g')) as s from @documents) d""")
def spam_flags(cat):
    docs = cat["documents"].select("doc_id", "source", "text")
    return A.spam_flags(docs, "source", "text", PHRASES).select("doc_id", "spam_score", "is_spam")


@query("o02_pages_by_language", """
  select page_title, page_id,
    case when page_title like '% (Español)' then 'Español' when page_title like '% (Français)' then 'Français'
         when page_title like '% (Čeština)' then 'Čeština' else 'English' end as language,
    regexp_replace(page_title, ' \\((Español|Français|Čeština)\\)$', '') as pure
  from @page where not page_is_redirect and page_namespace = 0""")
def pages_by_language(cat):
    page = cat["page"].where("not page_is_redirect and page_namespace = 0")
    title = F.col("page_title")
    df = page.select("page_title", "page_id", title_language(title).alias("language"), pure_title(title).alias("pure"))
    return df.orderBy("language", "pure")


_ACTIVE = f"""
  select u.user_id, u.user_name, u.user_editcount,
         case when u.user_registration is null then 0.0::double
              when date_sub('day', u.user_registration, timestamp '{TODAY}') = 0 then u.user_editcount
              else u.user_editcount / date_sub('day', u.user_registration, timestamp '{TODAY}') end as average_edits
  from @users u where u.user_id > 0 and u.user_editcount > 0
    and not exists (select 1 from @ipblocks b where b.ipb_user = u.user_id)
    and not exists (select 1 from @user_groups g where g.ug_user = u.user_id and g.ug_group = 'bot')"""


@query("o05_average_activity", _ACTIVE)
def average_activity(cat):
    return A.average_activity(cat, TODAY)


@query("q25_active_users", _ACTIVE + f" and u.user_name in (select user_name from {RECENT} r)")
def q25_active_users(cat):
    return A.recently_active(cat, TODAY)


@query("o06_split_by_activity", f"""
  select u.user_name, coalesce(r.recent_edits, 0) as recent_edits,
         cast(coalesce(l.last, timestamp '0001-01-01 00:00:00') as varchar) as last_contribution,
         coalesce(r.recent_edits, 0) >= 10 as active
  from @users u join @user_groups g on g.ug_user = u.user_id and g.ug_group = 'building'
  left join {RECENT} r on r.user_name = u.user_name
  left join (select rev_user, max(rev_timestamp) as last from @revision group by 1) l on l.rev_user = u.user_id
  where u.user_id > 0""")
def split_by_activity(cat):
    return _text(A.split_by_activity(cat, TODAY, group="building"), "last_contribution")


_FLAGS = """(select distinct r.rev_page as page_id, t.tag_name as flag from @tagged_revision g
  join @tag t on t.tag_id = g.tgrev_tag_id join @revision r on r.rev_id = g.tgrev_rev_id)"""


def _flag_sets(cat):
    flags = cat["tagged_revision"].join(cat["tag"], F.col("tgrev_tag_id") == F.col("tag_id")).join(
        cat["revision"], F.col("tgrev_rev_id") == F.col("rev_id")
    )
    return A.flag_sets(flags.select(F.col("rev_page").alias("page_id"), F.col("tag_name").alias("flag")))


@query("u02_flagged_any", f"select distinct page_id from {_FLAGS} f")
def flagged_any(cat):
    return A.flagged_any(_flag_sets(cat))


@query("u03_flagged_both", f"""
  select page_id from {_FLAGS} f where flag = 'view' intersect select page_id from {_FLAGS} f where flag = 'click'""")
def flagged_both(cat):
    return A.flagged_all(_flag_sets(cat), {"view", "click"})


@query("u04_flagged_only", f"""
  select page_id from {_FLAGS} f where flag = 'view' except select page_id from {_FLAGS} f where flag = 'click'
  except select page_id from {_FLAGS} f where flag = 'big'""")
def flagged_only(cat):
    return A.flagged_only(_flag_sets(cat), "view", {"click", "big"})


@query("q08_flag_breakdown", f"""
  select flags, count(*) as pages from (
    select page_id, string_agg(flag, ',' order by flag) as flags from {_FLAGS} f group by 1) s group by 1""")
def flag_breakdown(cat):
    sets = _flag_sets(cat).select(F.array_join("flags", ",").alias("flags"))
    return sets.groupBy("flags").agg(F.count(F.lit(1)).alias("pages"))


@query("f17_statistics_cells", f"""
  select u.user_name, '[[User:' || u.user_name || '|' || u.user_name || ']]' as link,
         coalesce(strftime(u.user_registration, '%Y-%m-%d %H:%M:%S'), '-') as registration,
         case when l.length is null then '0' else '<span title="' || l.length || ' days, from ' || l."start" || ' to '
              || l."end" || ' (' || l.edits || ' edits)">' || l.length || '</span>' end as longest,
         concat_ws(', ', case when list_contains(g.groups, 'sysop') then 'Administrator' end,
                   case when list_contains(g.groups, 'bot') then 'Bot' end) as groups
  from @users u left join {LONGEST} l on l.user_name = u.user_name
  left join (select ug_user, list(ug_group) as groups from @user_groups group by 1) g on g.ug_user = u.user_id
  where u.user_id > 0""")
def statistics_cells(cat):
    longest = A.longest_streaks(A.streaks(_days(cat)))
    df = cat["users"].where("user_id > 0").join(longest, "user_name", "left").join(
        A.user_group_sets(cat), F.col("user_id") == F.col("ug_user"), "left"
    )
    labels = {"bot": "Bot", "sysop": "Administrator"}
    return df.select(
        "user_name", A.user_link(F.col("user_name")).alias("link"),
        F.coalesce(F.date_format("user_registration", "yyyy-MM-dd HH:mm:ss"), F.lit("-")).alias("registration"),
        A.streak_span(F.col("length"), F.col("start"), F.col("end"), F.col("edits")).alias("longest"),
        F.coalesce(A.group_labels(F.col("user_groups"), labels), F.lit("")).alias("groups"),
    )
