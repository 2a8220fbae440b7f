"""Edit activity: totals, averages, streaks, histograms, rankings.

Everything that looks at a user's history starts from :func:`user_days`, one row
per user and day. That aggregation combines on the map side, so a user who made
a third of all edits still sends at most one row per task and day; all windows
then run over days, never over raw revisions.
"""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.functions.times import as_timestamp, days_between, never
from lorekeep.operators.common import Time
from lorekeep.operators.graph import place_in_group
from lorekeep.operators.lists import user_group_sets
from lorekeep.session import cut_lineage
from lorekeep.sources.catalog import Catalog


def every_revision(cat: Catalog, until: Time | None = None) -> DataFrame:
    """Live and deleted revisions: ``user_name, ts, rev_id``."""
    live = cat["revision"].select(
        F.col("rev_user_text").alias("user_name"), F.col("rev_timestamp").alias("ts"), "rev_id"
    )
    deleted = cat["archive"].select(
        F.col("ar_user_text").alias("user_name"), F.col("ar_timestamp").alias("ts"), F.col("ar_rev_id").alias("rev_id")
    )
    df = live.unionByName(deleted)
    return df if until is None else df.where(F.col("ts") <= as_timestamp(until))


def user_days(edits: DataFrame) -> DataFrame:
    """Edits per user and calendar day with the first and last edit of the day."""
    return edits.groupBy("user_name", F.col("ts").cast("date").alias("day")).agg(
        F.count(F.lit(1)).alias("edits"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")
    )


def total_edits(days: DataFrame) -> DataFrame:
    return days.groupBy("user_name").agg(F.sum("edits").alias("total_edits"))


def recent_window(cat: Catalog, today: Time, active_days: int = 30) -> DataFrame:
    """Edits and new pages of the last ``active_days`` days, both ends included."""
    end = as_timestamp(today)
    start = end - F.expr(f"interval {int(active_days)} days")
    df = cat["recentchanges"].where(F.col("rc_type").isin("edit", "new"))
    return df.where((F.col("rc_timestamp") >= start) & (F.col("rc_timestamp") <= end))


def recent_edits(cat: Catalog, today: Time, active_days: int = 30) -> DataFrame:
    df = recent_window(cat, today, active_days)
    return df.groupBy(F.col("rc_user_text").alias("user_name")).agg(F.count(F.lit(1)).alias("recent_edits"))


def active_users(cat: Catalog, today: Time, active_days: int = 30, approximate: bool = False) -> DataFrame:
    count = F.approx_count_distinct("rc_user_text") if approximate else F.countDistinct("rc_user_text")
    return recent_window(cat, today, active_days).agg(count.alias("active_users"))


def daily_user_sketches(changes: DataFrame) -> DataFrame:
    """``day, users``: a HyperLogLog sketch of the users who edited on each day, a few kilobytes at most.

    Stored once per day, sketches answer for any window of days without a look at the changes.
    """
    edits = changes.where(F.col("rc_type").isin("edit", "new"))
    return edits.groupBy(F.to_date("rc_timestamp").alias("day")).agg(F.hll_sketch_agg("rc_user_text", 14).alias("users"))


def sketched_active_users(sketches: DataFrame, days: int) -> DataFrame:
    """``day, active_users``: about how many users edited in the ``days`` days that end with each day of ``sketches``."""
    spread = sketches.select(F.explode(F.sequence("day", F.date_add("day", days - 1))).alias("day"), "users")
    ends = spread.join(sketches.select("day"), "day", "left_semi")
    return ends.groupBy("day").agg(F.hll_sketch_estimate(F.hll_union_agg("users")).alias("active_users"))


def sketched_monthly_users(sketches: DataFrame) -> DataFrame:
    """``month, users``: about how many users edited in each calendar month."""
    month = F.trunc("day", "month").alias("month")
    return sketches.groupBy(month).agg(F.hll_sketch_estimate(F.hll_union_agg("users")).alias("users"))


def streaks(days: DataFrame) -> DataFrame:
    """Runs of days without a gap of more than one day.

    ``length`` counts 24-hour spans between the first and the last edit plus one;
    ``calendar_days`` counts dates. The window sees one row per user and day.
    """
    by_user = Window.partitionBy("user_name").orderBy("day")
    starts = F.coalesce(F.datediff("day", F.lag("day").over(by_user)) > 1, F.lit(True))
    runs = days.withColumn("_starts", starts.cast("int")).withColumn("streak", F.sum("_starts").over(by_user))
    out = runs.groupBy("user_name", "streak").agg(
        F.min("first_ts").alias("_first"), F.max("last_ts").alias("_last"), F.sum("edits").alias("edits"),
        F.min("day").alias("start"), F.max("day").alias("end"),
    )
    return out.select(
        "user_name", F.col("streak").cast("long").alias("streak"),
        (days_between(F.col("_first"), F.col("_last")) + 1).alias("length"), "start", "end", "edits",
        (F.datediff("end", "start") + 1).cast("long").alias("calendar_days"), F.col("_first").alias("first_ts"),
        F.col("_last").alias("last_ts"),
    )


def _streak_facts() -> Column:
    return F.struct("length", "start", "end", "edits")


def longest_streaks(runs: DataFrame) -> DataFrame:
    """The longest streak of each user, the earliest one on ties."""
    order = F.struct(F.col("length"), (-F.unix_date("start")).alias("early"))
    best = runs.groupBy("user_name").agg(F.max_by(_streak_facts(), order).alias("s"))
    return best.select("user_name", "s.*")


def current_streaks(runs: DataFrame, today: Time) -> DataFrame:
    """The last streak of each user if its last edit is at most one day before ``today``."""
    last = runs.groupBy("user_name").agg(F.max_by(F.struct(_streak_facts().alias("s"), "last_ts"), "start").alias("x"))
    recent = F.col("x.last_ts") >= as_timestamp(today) - F.expr("interval 1 day")
    return last.where(recent).select("user_name", "x.s.*")


def edits_per_day(totals: DataFrame, registration: Column, today: Time) -> Column:
    """Average since registration; NaN when the registration is unknown."""
    days = days_between(registration, as_timestamp(today)) + 1
    return F.when(registration.isNull(), F.lit(float("nan"))).otherwise(totals / days)


def active_span(days: DataFrame) -> DataFrame:
    """Average edits per day between the first and the last edit."""
    out = days.groupBy("user_name").agg(
        F.sum("edits").alias("total_edits"), F.min("first_ts").alias("_first"), F.max("last_ts").alias("_last")
    )
    return out.select(
        "user_name", "total_edits",
        (F.col("total_edits") / (days_between(F.col("_first"), F.col("_last")) + 1)).alias("active_average"),
    )


def user_summaries(runs: DataFrame, today: Time) -> DataFrame:
    """Totals, averages, longest and current streak of each user, in one pass over the streaks.

    The streaks are already partitioned by user, so this adds no shuffle.
    """
    early = F.struct(F.col("length"), (-F.unix_date("start")).alias("early"))
    out = runs.groupBy("user_name").agg(
        F.sum("edits").alias("total_edits"), F.min("first_ts").alias("_first"), F.max("last_ts").alias("_last"),
        F.max_by(_streak_facts(), early).alias("longest"), F.max_by(_streak_facts(), "start").alias("_current"),
    )
    recent = F.col("_last") >= as_timestamp(today) - F.expr("interval 1 day")
    current = F.when(recent, F.col("_current"))
    facts = ("length", "start", "end", "edits")
    return out.select(
        "user_name", "total_edits",
        (F.col("total_edits") / (days_between(F.col("_first"), F.col("_last")) + 1)).alias("active_average"),
        *[F.col("longest." + x).alias("longest_" + x) for x in facts],
        *[current[x].alias("current_" + x) for x in facts],
    )


def user_statistics(
    cat: Catalog, today: Time, *, active_days: int = 30, min_total: int = 1000, min_recent: int = 1
) -> DataFrame:
    """The user table: activity, averages and streaks of each user worth listing.

    A user is listed with at least ``min_total`` recorded edits or ``min_recent``
    recent ones, unless blocked for ever. Ranked by recent edits, total edits,
    registration and name.
    """
    banned = cat["ipblocks"].where(F.col("ipb_expiry") >= never())
    users = cat["users"].where("user_id > 0").join(banned, F.col("user_id") == F.col("ipb_user"), "left_anti")
    listed = users.join(recent_edits(cat, today, active_days), "user_name", "left").where(
        (F.coalesce("user_editcount", F.lit(0)) >= min_total) | (F.col("recent_edits") >= min_recent)
    )
    # streaks only of the users that are listed
    days = user_days(every_revision(cat, today)).join(listed.select("user_name"), "user_name", "left_semi")
    df = (
        listed.join(user_summaries(streaks(days), today), "user_name", "left")
        .join(user_group_sets(cat), F.col("user_id") == F.col("ug_user"), "left")
    )
    total = F.coalesce("total_edits", F.lit(0))
    facts = [x for x in df.columns if x.startswith(("longest_", "current_"))]
    out = df.select(
        "user_name", F.coalesce("recent_edits", F.lit(0)).alias("recent_edits"), total.alias("total_edits"),
        F.col("user_registration").alias("registration"),
        F.coalesce(F.array_join("user_groups", ", "), F.lit("")).alias("groups"), *facts,
        edits_per_day(total, F.col("user_registration"), today).alias("total_average"), "active_average",
    )
    return out.orderBy(*ranking())


def ranking() -> list[Column]:
    """Recent edits, then total edits, then the older account, then the name."""
    return [
        F.col("recent_edits").desc(), F.col("total_edits").desc(), F.col("registration").asc_nulls_last(),
        F.col("user_name").asc(),
    ]


def threshold_counts(table: DataFrame, active: DataFrame, min_total: int) -> DataFrame:
    """Major users (more than ``min_total`` edits), active users and listed users."""
    listed = table.agg(
        F.count_if(F.col("total_edits") > min_total).alias("major_users"), F.count(F.lit(1)).alias("listed_users")
    )
    return listed.withColumn("active_users", active.scalar())


def group_labels(groups: Column, labels: dict[str, str]) -> Column:
    """Sorted display names of user groups; groups without a label are left out."""
    mapping = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    named = F.transform(groups, lambda g: F.try_element_at(mapping, g))
    return F.array_join(F.array_sort(F.filter(named, lambda x: x.isNotNull() & (x != ""))), ", ")


def streak_span(length: Column, start: Column, end: Column, edits: Column) -> Column:
    """Cell text of a streak; ``0`` when there is none."""
    text = F.format_string(
        '<span title="%d days, from %s to %s (%d edits)">%d</span>', length, start.cast("string"),
        end.cast("string"), edits, length,
    )
    return F.when(length.isNull(), F.lit("0")).otherwise(text)


def user_link(name: Column) -> Column:
    return F.format_string("[[User:%s|%s]]", name, name)


# ---- histograms and series -------------------------------------------------------------


def monthly_activity(edits: DataFrame) -> DataFrame:
    """Edits and distinct users per calendar month, months without edits included."""
    per_month = edits.groupBy(F.trunc(F.col("ts").cast("date"), "month").alias("month")).agg(
        F.count(F.lit(1)).alias("edits"), F.countDistinct("user_name").alias("users")
    )
    spine = per_month.agg(F.min("month").alias("a"), F.max("month").alias("b")).select(
        F.explode(F.sequence("a", "b", F.expr("interval 1 month"))).alias("month")
    )
    return spine.join(per_month, "month", "left").na.fill(0, ["edits", "users"])


def yearly_rollup(edits: DataFrame) -> DataFrame:
    """Edits per month with subtotals per year and a grand total (NULL keys)."""
    keyed = edits.select(F.year("ts").alias("year"), F.month("ts").alias("month"))
    return keyed.rollup("year", "month").agg(F.count(F.lit(1)).alias("edits"))


def daily_counts(days: DataFrame) -> DataFrame:
    """Edits per user and day, with zero rows between the user's first and last day."""
    spans = days.groupBy("user_name").agg(F.min("day").alias("a"), F.max("day").alias("b"))
    spine = spans.select("user_name", F.explode(F.sequence("a", "b", F.expr("interval 1 day"))).alias("day"))
    return spine.join(days.select("user_name", "day", "edits"), ["user_name", "day"], "left").na.fill(0, ["edits"])


def daily_max_revision(edits: DataFrame) -> DataFrame:
    """Largest revision id per day, carried over days without edits.

    The window has no partition, but it only sees one row per day of the wiki.
    """
    per_day = edits.groupBy(F.col("ts").cast("date").alias("day")).agg(F.max("rev_id").alias("rev_id"))
    spine = per_day.agg(F.min("day").alias("a"), F.max("day").alias("b")).select(
        F.explode(F.sequence("a", "b", F.expr("interval 1 day"))).alias("day")
    )
    order = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return spine.join(per_day, "day", "left").select(
        "day", F.last("rev_id", ignorenulls=True).over(order).alias("max_rev_id")
    )


def rolling_counts(daily: DataFrame, period_days: int = 30) -> DataFrame:
    """Edits of the last ``period_days`` days, per user and day of :func:`daily_counts`."""
    frame = Window.partitionBy("user_name").orderBy(F.unix_date("day")).rangeBetween(-(period_days - 1), 0)
    return daily.select("user_name", "day", F.sum("edits").over(frame).alias("edits"))


def top_per_day(rolling: DataFrame, n: int = 10, skip_days: int = 30, days: DataFrame | None = None) -> DataFrame:
    """The ``n`` busiest users of each day, ties by name, from ``skip_days`` after the first day.

    The first day is that of ``days``, rows that need no window, or else that of ``rolling``.
    Spark keeps only ``n`` rows per day and task before the shuffle.
    """
    first = (rolling if days is None else days).agg(F.min("day").alias("d")).scalar()
    kept = rolling.where(F.col("day") >= F.date_add(first, skip_days))
    order = Window.partitionBy("day").orderBy(F.col("edits").desc(), F.col("user_name").asc())
    return kept.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)


def fill_race(top: DataFrame, carry_days: int = 30) -> DataFrame:
    """A row for every day and every user who is ever on top.

    A user who drops out keeps the last value for ``carry_days`` days, then 0. The
    users are few because the ranking was pruned first, and each of them unfolds
    the day range, which needs no join of all users with all days. The ranking is
    written once, a few rows per day, as both ends and the users are read from it.
    """
    top = cut_lineage(top.select("user_name", "day", "edits"))
    first, last = top.agg(F.min("day").alias("d")).scalar(), top.agg(F.max("day").alias("d")).scalar()
    users = top.select("user_name").distinct()
    spine = users.select("user_name", F.explode(F.sequence(first, last, F.expr("interval 1 day"))).alias("day"))
    filled = spine.join(top.select("user_name", "day", "edits"), ["user_name", "day"], "left")
    frame = Window.partitionBy("user_name").orderBy(F.unix_date("day")).rangeBetween(-carry_days, 0)
    value = F.last("edits", ignorenulls=True).over(frame)
    return filled.select("user_name", "day", F.coalesce(value, F.lit(0)).alias("edits"))


def race_table(filled: DataFrame, users: Collection[str]) -> DataFrame:
    """Pivot: one row per day, one column for each of the named users."""
    return filled.groupBy("day").pivot("user_name", list(users)).agg(F.first("edits"))


def race_cells(filled: DataFrame) -> DataFrame:
    """Pivot in long form, for any number of users: ``day, place, user_name, edits``.

    ``place`` is the column of the user, by name from 1.
    """
    users = filled.select("user_name", F.lit(1).alias("_all")).distinct()
    places = place_in_group(users, "_all", [F.col("user_name")]).select("user_name", "place")
    return filled.join(places, "user_name").select("day", "place", "user_name", "edits")


def cumulative_counts(daily: DataFrame) -> DataFrame:
    frame = Window.partitionBy("user_name").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return daily.select("user_name", "day", F.sum("edits").over(frame).alias("total"))


def value_at_events(series: DataFrame, events: DataFrame) -> DataFrame:
    """Linear interpolation of a daily series at event times (``user_name, event_id, ts``).

    The series has every day, so the neighbours are found by equi joins on the
    day; times outside the series take its first or last value.
    """
    by_day = Window.partitionBy("user_name").orderBy("day")
    steps = series.select("user_name", "day", "total", F.lead("total").over(by_day).alias("next_total"))
    spans = series.groupBy("user_name").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"))
    day = F.greatest("first_day", F.least("last_day", F.col("ts").cast("date")))
    placed = events.join(spans, "user_name").withColumn("day", day)
    joined = placed.join(steps, ["user_name", "day"])
    inside = (F.col("ts").cast("date") == F.col("day")) & F.col("next_total").isNotNull()
    micros = F.timestamp_diff("MICROSECOND", F.col("day").cast("timestamp_ntz"), F.col("ts"))
    exact = F.col("total") + (F.col("next_total") - F.col("total")) * micros / F.lit(86_400_000_000)
    value = F.when(inside, exact).otherwise(F.col("total").cast("double"))
    return joined.select("user_name", "event_id", "ts", value.alias("value"))


def rights_changes(cat: Catalog) -> DataFrame:
    """Rights events: user, and the groups added and removed."""
    shape = "oldgroups array<string>, newgroups array<string>"
    log = cat["logging"].where("log_type = 'rights'").select(
        F.col("log_id").alias("event_id"), F.col("log_timestamp").alias("ts"), F.col("log_title").alias("user_name"),
        F.from_json("log_params", shape).alias("p"),
    )
    return log.select(
        "event_id", "ts", "user_name", F.array_except("p.newgroups", "p.oldgroups").alias("added"),
        F.array_except("p.oldgroups", "p.newgroups").alias("removed"),
    )


def activity_with_rights(cat: Catalog, today: Time) -> DataFrame:
    """Rights changes placed on each user's cumulative edit curve, with their labels."""
    daily = daily_counts(user_days(every_revision(cat, today)))
    changes = rights_changes(cat)
    labels = F.concat(
        F.transform("added", lambda g: F.concat(F.lit("+"), g)),
        F.transform("removed", lambda g: F.concat(F.lit("-"), g)),
    )
    values = value_at_events(cumulative_counts(daily), changes.select("user_name", "event_id", "ts"))
    return values.join(changes.select("event_id", F.array_join(labels, "\n").alias("label")), "event_id")


# ---- reports ---------------------------------------------------------------------------


def deleted_totals(cat: Catalog) -> DataFrame:
    return cat["archive"].agg(
        F.count(F.lit(1)).alias("revisions"), F.countDistinct("ar_namespace", "ar_title").alias("pages"),
        F.countDistinct("ar_user_text").alias("users"),
    )


def top_deleted(cat: Catalog, n: int = 20) -> DataFrame:
    counts = cat["archive"].groupBy(F.col("ar_user_text").alias("user_name")).agg(F.count(F.lit(1)).alias("revisions"))
    return counts.orderBy(F.col("revisions").desc(), F.col("user_name").asc()).limit(n)


def interwiki_prefixes(cat: Catalog) -> DataFrame:
    """Interwiki prefixes that content pages (not redirects) use."""
    page = cat["page"].where("not page_is_redirect and page_namespace >= 0").select("page_id")
    return cat["iwlinks"].join(page, F.col("iwl_from") == F.col("page_id"), "left_semi").select(
        F.col("iwl_prefix").alias("prefix")
    ).distinct()


def log_count(cat: Catalog, type: str) -> DataFrame:
    return cat["logging"].where(F.col("log_type") == type).agg(F.count(F.lit(1)).alias("events"))


def keep_last(df: DataFrame, key: list[str], position: str) -> DataFrame:
    """One row per key, the one with the highest position (map-side combinable)."""
    rest = [x for x in df.columns if x not in key]
    return df.groupBy(*key).agg(F.max_by(F.struct(*rest), position).alias("_row")).select(*key, "_row.*")


def first_occurrences(df: DataFrame, key: str, value: str, position: str) -> DataFrame:
    """Distinct values per key with the place of their first occurrence."""
    return df.groupBy(key, value).agg(F.min(position).alias(position))


# fixed values: ASCII punctuation
_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def spam_flags(
    pages: DataFrame, title: str, text: str, phrases: Collection[str], threshold: int = 5
) -> DataFrame:
    """Spam test: a phrase in the title, or more than ``threshold`` times in the text.

    Punctuation is ignored, and each phrase also counts without its spaces. Adds
    ``spam_score`` (highest count of one phrase) and ``is_spam``.
    """
    from lorekeep.functions.text import phrase_count

    if not phrases:
        raise ValueError("give at least one phrase")
    wanted = list(dict.fromkeys([*phrases, *(p.replace(" ", "") for p in phrases)]))
    bare_title = F.lower(F.translate(F.col(title), _PUNCTUATION, ""))
    df = pages.withColumn("_bare", F.translate(F.col(text), _PUNCTUATION, ""))
    counts = [phrase_count(F.col("_bare"), p) for p in wanted]
    score = F.greatest(*counts) if len(counts) > 1 else counts[0]
    in_title = F.lit(False)
    for phrase in wanted:
        in_title = in_title | F.contains(bare_title, F.lit(phrase))
    df = df.withColumn("spam_score", score)
    return df.withColumn("is_spam", in_title | (F.col("spam_score") > threshold)).drop("_bare")


def average_activity(cat: Catalog, now: Time) -> DataFrame:
    """Active users by average edits per day: not bots, not blocked, with edits."""
    from lorekeep.operators.lists import all_users

    users = all_users(cat, exclude_group="bot", with_edits_only=True, prop={"editcount", "registration", "blockinfo"})
    users = users.where("ipb_id is null")
    days = days_between(F.col("user_registration"), as_timestamp(now))
    average = (
        F.when(F.col("user_registration").isNull(), F.lit(0.0))
        .when(days == 0, F.col("user_editcount").cast("double"))
        .otherwise(F.col("user_editcount") / days)
    )
    return users.select("user_id", "user_name", "user_editcount", average.alias("average_edits")).orderBy(
        F.col("average_edits").desc(), F.col("user_name").asc()
    )


def recently_active(cat: Catalog, today: Time, active_days: int = 30) -> DataFrame:
    """Named users with recent edits who are neither bots nor blocked."""
    seen = recent_window(cat, today, active_days).select(F.col("rc_user_text").alias("user_name"))
    users = average_activity(cat, today)
    return users.join(seen, "user_name", "left_semi")


def split_by_activity(cat: Catalog, today: Time, *, group: str, active_days: int = 30, min_edits: int = 10) -> DataFrame:
    """Members of a group ordered by recent edits and last edit, flagged active or not."""
    from lorekeep.operators.lists import last_contributions

    members = cat["user_groups"].where(F.col("ug_group") == group).select(F.col("ug_user").alias("user_id"))
    users = last_contributions(cat).join(members, "user_id", "left_semi")
    df = users.join(recent_edits(cat, today, active_days), "user_name", "left").na.fill(0, ["recent_edits"])
    return df.select(
        "user_name", "recent_edits", "last_contribution", (F.col("recent_edits") >= min_edits).alias("active")
    ).orderBy(F.col("recent_edits").desc(), F.col("last_contribution").desc())


# ---- sets of flagged pages --------------------------------------------------------------


def flag_sets(flags: DataFrame) -> DataFrame:
    """``(page_id, flags)`` from ``(page_id, flag)`` rows in one pass; flags are few by nature."""
    return flags.groupBy("page_id").agg(F.sort_array(F.collect_set("flag")).alias("flags"))


def flagged_any(sets: DataFrame) -> DataFrame:
    return sets.select("page_id")


def flagged_all(sets: DataFrame, flags: Collection[str]) -> DataFrame:
    wanted = F.array(*[F.lit(x) for x in sorted(flags)])
    return sets.where(F.size(F.array_except(wanted, F.col("flags"))) == 0).select("page_id")


def flagged_only(sets: DataFrame, flag: str, others: Collection[str]) -> DataFrame:
    """Pages with ``flag`` and none of ``others``."""
    rest = F.array(*[F.lit(x) for x in sorted(others)])
    return sets.where(F.array_contains("flags", flag) & ~F.arrays_overlap("flags", rest)).select("page_id")
