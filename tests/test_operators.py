"""Operators against brute force and hand-made histories."""

import collections
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from lorekeep.operators import activity, changes, external, extract, graph, lists, pageset, props, quality
from lorekeep.operators.api import query
from lorekeep.sources.catalog import MemoryCatalog


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_redirect_chains(spark):
    edges = [
        ("A1", "B1", None), ("B1", "C1", None),
        ("A2", "B2", "section"), ("B2", "C2", None),
        ("A3", "B3", "section"), ("B3", "C3", "section2"),
        ("x", "y", None), ("y", "x", None), ("into", "x", "s"),
    ] + [(f"n{i}", f"n{i + 1}", None) for i in range(40)]
    df = spark.createDataFrame([(0, s, 0, d, f) for s, d, f in edges],
                               "src_ns int, src_title string, dst_ns int, dst_title string, fragment string")
    got = {r.src_title: (r.dst_title, r.fragment) for r in graph.resolve_redirects(df).collect()}
    assert got["A1"] == ("C1", None) and got["A2"] == ("C2", "section") and got["A3"] == ("C3", "section2")
    assert got["x"] == got["y"] == got["into"] == (None, None)
    assert all(got[f"n{i}"] == ("n40", None) for i in range(40))
    assert len(got) == len(edges)


def test_place_in_hot_group(spark):
    data = [("hot", i * 7919 % 5000) for i in range(5000)] + [(f"g{i % 9}", i) for i in range(90)]
    df = spark.createDataFrame(data, "g string, v int").repartition(6)
    got = graph.place_in_group(df, "g", [F.col("v")]).collect()
    expected = {}
    for name in {g for g, _ in data}:
        for place, v in enumerate(sorted(v for g, v in data if g == name), 1):
            expected[name, v] = place
    assert {(r.g, r.v): r.place for r in got} == expected


def test_hot_page_is_whole(spark):
    entries = spark.createDataFrame([(1, f"t{i}") for i in range(2500)] + [(2, "a"), (2, "b")], "page_id long, title string")
    pages = spark.createDataFrame([(1,), (2,), (3,)], "page_id long")
    more = spark.createDataFrame([(1, "k", 5), (9, "k", 5)], "page_id long, title string, n int")
    got = pageset.attach(pages, {"links": entries, "keys": more}).collect()
    by_page = collections.defaultdict(list)
    for r in got:
        by_page[r.page_id].append((r.property, r.links and r.links.title, r["keys"] and r["keys"].n))
    assert sorted(by_page[1], key=str) == sorted([("links", f"t{i}", None) for i in range(2500)] + [("keys", None, 5)], key=str)
    assert sorted(by_page[2]) == [("links", "a", None), ("links", "b", None)] and by_page[3] == [(None, None, None)]
    assert len(by_page) == 3 and pageset.attach(pages, {}).count() == 3


def test_streaks_of_one_user(spark):
    stamps = ["2024-01-01 23:00:00", "2024-01-02 01:00:00", "2024-01-05 10:00:00", "2024-01-06 12:00:00", "2024-01-07 09:00:00"]
    edits = spark.createDataFrame([("u", s) for s in stamps], "user_name string, ts string").withColumn(
        "ts", F.col("ts").cast("timestamp_ntz"))
    runs = activity.streaks(activity.user_days(edits))
    assert [(r.length, r.calendar_days, r.edits) for r in runs.orderBy("start").collect()] == [(1, 2, 2), (2, 3, 3)]
    assert activity.current_streaks(runs, "2024-01-08 09:00:00").first().edits == 3
    assert activity.current_streaks(runs, "2024-01-08 09:00:01").first() is None
    assert activity.longest_streaks(runs).first().edits == 3


def test_rolling_and_race_against_brute_force(spark):
    rng = random.Random(1)
    edits = collections.Counter((f"u{rng.randrange(4)}", rng.randrange(40)) for _ in range(300))
    days = spark.createDataFrame([(u, d, n) for (u, d), n in edits.items()], "user_name string, d int, edits long").select(
        "user_name", F.date_add(F.lit("2024-01-01").cast("date"), F.col("d")).alias("day"), "edits")
    rolling = activity.rolling_counts(activity.daily_counts(days), 5)
    first = min(d for _, d in edits)
    for r in rolling.collect():
        d = (r.day - __import__("datetime").date(2024, 1, 1)).days
        assert r.edits == sum(edits[r.user_name, x] for x in range(d - 4, d + 1))
    top = activity.top_per_day(rolling, 2, 3).collect()
    assert all(r.place <= 2 for r in top) and min(r.day for r in top).day >= first + 1 + 3


def _history(spark):
    """A small wiki and an event log; ids are chosen so that each event has one effect."""
    page = spark.createDataFrame([
        (1, 0, "Kept", 11), (2, 0, "Deleted", 21), (3, 0, "Old name", 31), (4, 0, "Source", 42), (5, 0, "Target", 51),
    ], "page_id long, page_namespace int, page_title string, page_latest long")
    revision = spark.createDataFrame([
        (11, 1, "2024-01-01"), (21, 2, "2024-01-01"), (22, 2, "2024-01-02"), (31, 3, "2024-01-01"),
        (41, 4, "2024-01-01"), (42, 4, "2024-01-09"), (51, 5, "2024-01-01"),
    ], "rev_id long, rev_page long, t string").select(
        "rev_id", "rev_page", F.col("rev_id").alias("rev_text_id"), F.lit("c").alias("rev_comment"), F.lit(7).cast("long").alias("rev_user"),
        F.lit("Seven").alias("rev_user_text"), F.col("t").cast("timestamp_ntz").alias("rev_timestamp"), F.lit(False).alias("rev_minor_edit"),
        F.lit(0).alias("rev_deleted"), F.lit(1).cast("long").alias("rev_len"), F.lit(0).cast("long").alias("rev_parent_id"),
        F.lit(None).cast("string").alias("rev_sha1"), F.lit("m").alias("rev_content_model"), F.lit("f").alias("rev_content_format"))
    archive = spark.createDataFrame([(1, 91, "Gone"), (2, 92, "Restored")], "ar_id long, ar_rev_id long, ar_title string").select(
        "ar_id", F.lit(0).alias("ar_namespace"), "ar_title", "ar_rev_id", F.lit(None).cast("long").alias("ar_page_id"),
        *[F.lit(None).cast(k).alias(a) for a, k in (
            ("ar_text_id", "long"), ("ar_comment", "string"), ("ar_user", "long"), ("ar_user_text", "string"),
            ("ar_timestamp", "timestamp_ntz"), ("ar_minor_edit", "boolean"), ("ar_deleted", "int"), ("ar_len", "long"),
            ("ar_parent_id", "long"), ("ar_sha1", "string"), ("ar_content_model", "string"), ("ar_content_format", "string"))])
    log = [
        (1, "delete", "restore", 2, "Deleted", "{}"), (2, "delete", "delete", 2, "Deleted", "{}"),
        (3, "delete", "delete", 9, "Restored", "{}"), (4, "delete", "restore", 9, "Restored", "{}"),
        (5, "move", "move", 3, "Old name", '{"target_ns": 4, "target_title": "Middle"}'),
        (6, "move", "move", 3, "Middle", '{"target_ns": 0, "target_title": "New name"}'),
        (7, "merge", "merge", 4, "Source", '{"dest_ns": 0, "dest_title": "Target", "mergepoint": "2024-01-05T00:00:00Z"}'),
        (8, "delete", "revision", 1, "Kept", '{"type": "revision", "ids": [11], "new": {"bitmask": 3}}'),
        (9, "delete", "revision", 1, "Kept", '{"type": "revision", "ids": [11, 92], "new": {"bitmask": 1}}'),
        (10, "tag", "update", 1, "Kept", '{"revid": 11, "tagsAdded": ["a", "b"], "tagsRemoved": []}'),
        (11, "tag", "update", 1, "Kept", '{"revid": 11, "tagsAdded": [], "tagsRemoved": ["a"]}'),
    ]
    logging = spark.createDataFrame(
        [(i, t, a, p, 0, title, params, 0) for i, t, a, p, title, params in log],
        "log_id long, log_type string, log_action string, log_page long, log_namespace int, log_title string, log_params string, log_deleted int")
    empty = lambda ddl: spark.createDataFrame([], ddl)
    tables = {
        "page": page, "revision": revision, "archive": archive, "logging": logging,
        "tag": spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "tag_id long, tag_name string"),
        "tagged_revision": spark.createDataFrame([(3, 21), (3, 11)], "tgrev_tag_id long, tgrev_rev_id long"),
        "tagged_archived_revision": spark.createDataFrame([(3, 92)], "tgar_tag_id long, tgar_rev_id long"),
        "tagged_logevent": empty("tgle_tag_id long, tgle_log_id long"),
        "tagged_recentchange": empty("tgrc_tag_id long, tgrc_rc_id long"),
        "recentchanges": empty("rc_id long, rc_this_oldid long, rc_logid long, rc_deleted int"),
    }
    for table, column in changes.CASCADES.items():
        tables[table] = spark.createDataFrame([(1,), (2,)], f"{column} long")
    return MemoryCatalog(spark, tables)


def test_replayed_history(spark):
    cat = _history(spark)
    log = cat["logging"]
    actions = changes.page_actions(log)
    assert rows(actions.select("log_title", "action")) == [("Deleted", "deleted"), ("Restored", "restored")]
    gone = actions.where("action = 'deleted'").select(F.col("log_page").alias("page_id"))
    after = changes.delete_pages(cat, gone)
    assert [r.page_title for r in after["page"].orderBy("page_id").collect()] == ["Kept", "Old name", "Source", "Target"]
    assert rows(after["archive"].where("ar_title = 'Deleted'").select("ar_id", "ar_rev_id")) == [(3, 21), (4, 22)]
    assert rows(after["tagged_archived_revision"]) == [(3, 21), (3, 92)] and rows(after["tagged_revision"]) == [(3, 11)]
    assert all(after[t].count() == 1 for t in changes.CASCADES)

    back = changes.restore_pages(cat, actions.where("action = 'restored'"))
    assert rows(back["revision"].where("rev_page = 9").select("rev_id")) == [(92,)]
    assert rows(back["archive"].select("ar_rev_id")) == [(91,)] and (3, 92) in rows(back["tagged_revision"])

    assert changes.apply_moves(cat["page"], log).where("page_id = 3").first()[1:3] == (0, "New name")
    merged = changes.apply_merges(cat["revision"], changes.merges(cat, log))
    assert dict(merged.where("rev_id in (41, 42)").select("rev_id", "rev_page").collect()) == {41: 5, 42: 4}
    seen = changes.apply_visibility(cat, log)
    assert seen["revision"].where("rev_id = 11").first().rev_deleted == 1
    assert seen["archive"].where("ar_rev_id = 92").first().ar_deleted == 1
    tags = changes.apply_tag_events(cat, log)
    assert rows(tags["tagged_revision"]) == [(2, 11), (3, 11), (3, 21)]


def test_merge_into_moved_page_is_rejected(spark):
    cat = _history(spark)
    moved = cat["logging"].unionByName(spark.createDataFrame(
        [(12, "move", "move", 4, 0, "Source", '{"target_ns": 0, "target_title": "X"}', 0)], cat["logging"].schema))
    assert changes.merges(cat, moved).first().rejected


def test_merges_in_log_order(spark):
    planned = spark.createDataFrame([
        (1, 4, 5, "2024-01-05", False), (2, 4, 6, "2024-01-03", False), (3, 4, 7, "2024-01-09", False),
        (4, 4, 8, "2024-02-01", True), (5, 9, None, None, True),
    ], "log_id long, src_page long, dest_page long, mergepoint string, rejected boolean").withColumn(
        "mergepoint", F.col("mergepoint").cast("timestamp_ntz"))
    revision = spark.createDataFrame(
        [(i, 4, f"2024-01-{d:02d}") for i, d in enumerate((1, 3, 5, 6, 9, 10))] + [(6, 9, "2024-01-01"), (7, 4, None)],
        "rev_id long, rev_page long, t string").select("rev_id", "rev_page", F.col("t").cast("timestamp_ntz").alias("rev_timestamp"))
    got = dict(changes.apply_merges(revision, planned).select("rev_id", "rev_page").collect())
    assert got == {0: 5, 1: 5, 2: 5, 3: 7, 4: 7, 5: 4, 6: 9, 7: 4}


def test_rename_chains(spark):
    events = [(1, "A", "B"), (2, "B", "C"), (3, "A", "D"), (4, "E", "F"), (5, "F", "E")]
    steps = spark.createDataFrame(events, "seq long, src string, dst string")
    # a later A is a new account; F renamed back to E ends at E
    assert dict(changes.final_targets(steps).collect()) == {"A": "C", "B": "C", "E": "E", "F": "E"}


def test_upsert_keeps_unlisted_columns(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "k int, x string, y int")
    new = spark.createDataFrame([(2, "B", None), (3, "c", 3)], "k int, x string, y int")
    assert rows(changes.upsert(old, new, ["k"], ["y"])) == [(1, "a", 1), (2, "b", None), (3, "c", 3)]
    assert rows(changes.insert_ignore(old, new, ["k"])) == [(1, "a", 1), (2, "b", 2), (3, "c", 3)]
    feed = spark.createDataFrame([(1, "b", 5, 2), (1, "c", 6, 9), (4, "x", 7, None), (4, "y", 7, None), (2, None, None, 1)],
                                 "k int, x string, y int, seq int")
    assert rows(changes.upsert(old, feed, ["k"], sequence="seq")) == [(1, "c", 6), (2, None, None), (4, "y", 7)]
    assert rows(changes.insert_ignore(old, feed.drop("seq"), ["k"])) == [(1, "a", 1), (2, "b", 2), (4, "x", 7)]
    assert rows(changes.update_column(old, "k", feed, "y", "seq")) == [(1, "a", 6), (2, "b", None)]


def test_closure_with_loop(spark):
    page = spark.createDataFrame([(i, 10, f"T{i}") for i in range(5)], "page_id long, page_namespace int, page_title string")
    direct = [(0, "T1"), (1, "T2"), (2, "T1"), (2, "T3"), (4, "Missing")]
    links = spark.createDataFrame([(a, 10, t) for a, t in direct], "tl_from long, tl_namespace int, tl_title string")
    got = collections.defaultdict(set)
    for r in extract.transclusion_closure(links, page).collect():
        got[r.tl_from].add(r.tl_title)
    assert got == {0: {"T1", "T2", "T3"}, 1: {"T1", "T2", "T3"}, 2: {"T1", "T2", "T3"}, 4: {"Missing"}}


def test_tree_walk_skips_loops(spark):
    edges = spark.createDataFrame([("r", "b"), ("r", "A"), ("b", "c"), ("c", "r"), ("c", "b"), ("c", "d")], "parent string, child string")
    got = {tuple(r.path): list(r.levels) for r in graph.walk_tree(edges, "r").collect()}
    assert got == {("r", "A"): [1], ("r", "b"): [2], ("r", "b", "c"): [2, 1], ("r", "b", "c", "d"): [2, 1, 2]}


def _edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_anchor_suggestions_match_brute_force(spark):
    rng = random.Random(3)
    words = ["install", "config", "network", "boot_loader", "boot_load", "kernel_parameters"]
    pages = {p: sorted({rng.choice(words) + str(rng.randrange(4)) for _ in range(6)}) for p in range(8)}
    broken = [(p, rng.choice(a)[:-1] + "x") for p, a in pages.items() for _ in range(4)]
    section = spark.createDataFrame([(p, a) for p, xs in pages.items() for a in xs], "sec_page long, sec_anchor string")
    links = spark.createDataFrame([(p, a, False) for p, a in broken], "target_page long, anchor string, via_section boolean")
    got = {(r.target_page, r.anchor): r.suggestion
           for r in quality.anchor_suggestions(MemoryCatalog(spark, {"section": section}), links).collect()}
    expected = {}
    for page, anchor in broken:
        ranks = sorted(((1 - _edits(anchor, o) / max(len(anchor), len(o)), o) for o in pages[page]), reverse=True)
        ranks = [x for x in ranks if x[0] >= 0.8]
        if len(ranks) == 1 or (len(ranks) > 1 and ranks[0][0] - ranks[1][0] > 0.2 + 1e-9):
            expected[page, anchor] = ranks[0][1]
    assert expected and got == expected


def test_broken_section_links(spark):
    page = spark.createDataFrame([(1, 0, "A"), (2, 0, "B"), (3, 0, "R")], "page_id long, page_namespace int, page_title string")
    section = spark.createDataFrame([(1, "One"), (2, "Two_.C4.8D")], "sec_page long, sec_anchor string")
    resolved = spark.createDataFrame([(0, "R", 0, "B", "Two č"), (0, "Loop", None, None, None)],
                                     "src_ns int, src_title string, dst_ns int, dst_title string, fragment string")
    links = spark.createDataFrame([
        (9, i, t, "", 0, t, s) for i, (t, s) in enumerate(
            [("A", "One"), ("A", "Two"), ("B", "Two č"), ("R", "Two č"), ("R", "x"), ("Loop", "x"), ("Missing", "x"), ("B", "Two %C4%8D")])
    ], "page_id long, position int, raw string, iwprefix string, ns_id int, pagename string, sectionname string")
    got = quality.broken_section_links(MemoryCatalog(spark, {"page": page, "section": section}), links, resolved)
    assert rows(got.select("position", "via_section")) == [(1, False), (4, True)]


def test_compare_tables(spark):
    left = spark.createDataFrame([(1, ["a", "b"], 5), (2, ["a"], 5), (3, ["a"], 5)], "k int, xs array<string>, n int")
    right = spark.createDataFrame([(1, ["b", "a"], 6), (2, ["b"], 5), (4, ["a"], 5)], "k int, xs array<string>, n int")
    assert rows(quality.compare(left, right, ["k"], ignore=["n"])) == [
        (2, "differs", "xs"), (3, "only left", ""), (4, "only right", "")]
    assert rows(quality.compare(left.drop("xs"), right, ["k"])) == [
        (1, "differs", "n,xs"), (2, "differs", "xs"), (3, "only left", ""), (4, "only right", "")]


def test_url_rules(spark, tmp_path):
    land = [
        {"priority": 1, "host": "Lists.example.org", "pattern": r"https?://lists\.example\.org/(\w+)/?", "replacement": "https://example.org/lists/$1"},
        {"priority": 2, "host": "example.org", "pattern": r"https?://(\w+)\.example\.org(/.*)?", "replacement": "https://example.org/$1$2", "lower": True},
        {"priority": 2, "host": "example.org", "pattern": r"https?://(\w+)\.example\.org/tie", "replacement": "https://example.org/a"},
        {"priority": 3, "host": "org", "pattern": r"ircs?://chat\.example\.org/(.*)", "replacement": "ircs://chat.example.org/$1"},
        {"priority": 4, "host": None, "pattern": r"(.*)#", "replacement": "$1", "summary": "empty fragment"},
    ]
    (tmp_path / "rules.json").write_text("\n".join(json.dumps(x) for x in land))
    rules = external.read_rules(spark, str(tmp_path / "rules.json"))
    cases = {
        "http://lists.example.org/News/": "https://example.org/lists/News",
        "http://lists.example.org/a/b": "https://example.org/lists/a/b",
        "https://user:pw@www.example.org/A": None,
        "https://WWW.example.org/A": "https://example.org/www/a",
        "https://www.example.org/A": "https://example.org/www/a",
        "https://www.example.org/tie": "https://example.org/a",
        "irc://chat.example.org/x": "ircs://chat.example.org/x",
        "ircs://chat.example.org/x": None,
        "no address#": "no address",
        "https://example.com/?q={x}|y#": "https://example.com/?q={x}|y",
        "": None, None: None,
    }
    urls = spark.createDataFrame([(u,) for u in cases] * 2, "url string")
    got = {r.url: r.new_url for r in external.rewrite_urls(urls, rules).collect()}
    assert got == {u: new for u, new in cases.items() if new}
    assert external.rewrite_urls(urls, rules.where("false")).count() == 0


def test_link_rules(spark):
    rules = spark.createDataFrame([
        (1, "lexicon.org", "https://lexicon.org/(.+)", "any", None, "[[L:$1|{text}]]"),
        (2, "lexicon.org", "https://lexicon.org/(.+)", "bare", None, "[[L:$1]]"),
        (3, "issues.org", r"https://issues\.org/(\d+)", "same", "(?i)issue *#?", "{{Issue|$1}}"),
    ], external.LINK_RULES)
    links = spark.createDataFrame([
        (1, "https://lexicon.org/A%20b", "see {text} $1", True), (2, "https://lexicon.org/A", None, True),
        (3, "https://lexicon.org/A", None, False), (4, "https://issues.org/7", " Issue #7", True),
        (5, "https://issues.org/7", "7", True), (6, "https://issues.org/7", "Issue 8", True), (7, None, None, True),
    ], "id int, url string, text string, brackets boolean")
    assert rows(external.replace_links(links, rules).select("id", "replacement")) == [
        (1, "[[L:A b|see {text} $1]]"), (3, "[[L:A]]"), (4, "{{Issue|7}}")]


def test_https_upgrade_prefers_specific_rule(spark):
    rules = spark.createDataFrame([("example.org", True), ("a.example.org", False), ("b.org", False)], "rule string, with_subdomains boolean")
    hosts = spark.createDataFrame([("a.example.org",), ("x.a.example.org",), ("b.org",), ("c.b.org",)], "host string")
    assert rows(external.matching_rules(hosts, rules)) == [
        ("a.example.org", "a.example.org"), ("b.org", "b.org"), ("x.a.example.org", "example.org")]


def test_argument_checks(sample):
    with pytest.raises(ValueError):
        lists.recent_changes(sample, user="a", exclude_user="b")
    with pytest.raises(ValueError):
        lists.recent_changes(sample, start="2024-01-01", end="2024-01-02")
    with pytest.raises(ValueError):
        lists.recent_changes(sample, prop={"parsedcomment"})
    with pytest.raises(ValueError):
        lists.recent_changes(sample, show=["bot", "!bot"])
    with pytest.raises(ValueError):
        lists.all_pages(sample, pr_level={"sysop"})
    with pytest.raises(ValueError):
        lists.all_users(sample, group="a", exclude_group="b")
    with pytest.raises(ValueError):
        query(sample, list="recentchanges", rcfoo=1)


def test_query_surface(sample):
    got = query(sample, list="recentchanges", rcprop={"ids", "user"}, rctype={"new"}, rcdir="newer", rclimit="max")
    assert {"rcid", "user", "pageid", "revid"} <= set(got.columns)
    assert got.count() == sample["recentchanges"].where("rc_type = 'new'").count()
    pages = query(sample, titles={"topic X0", "Topic_X0 (Français)"}, prop={"links", "info"}, inprop={"displaytitle"})
    assert sorted({r.page_title for r in pages.collect()}) == ["Topic X0", "Topic X0 (Français)"]
    one = query(sample, pageids=0, prop="latestrevisions", rvprop={"ids"})
    assert one.count() == 1 and "latestrevisions" in one.columns


def test_registered_checks(sample):
    quality.register_check("no-such-pages", lambda cat: cat["page"].where("false"))
    assert quality.run_check("no-such-pages", sample).count() == 0
    with pytest.raises(ValueError):
        quality.register_check("no-such-pages", lambda cat: None)
    assert quality.run_check("closed-discussions", sample).count() > 0


def test_only_ranges_that_differ_are_compared(spark):
    rows = spark.range(5000).selectExpr("id", "if(id % 3 = 0, null, 'x') as a", "if(id % 3 = 0, 'x', null) as b", "array('p', 'q') as c")
    other = rows.where("id <> 7").withColumn("a", F.when(F.col("id") == 9, F.lit("x")).otherwise(F.col("a"))).withColumn(
        "b", F.when(F.col("id") == 9, None).otherwise(F.col("b"))).withColumn("c", F.reverse("c"))
    found = quality.compare_ranges(rows, other, ["id"]).collect()
    assert sorted(map(tuple, found)) == [(7, "only left", ""), (9, "differs", "a,b")]
    assert sorted(map(tuple, found)) == sorted(map(tuple, quality.compare(rows, other, ["id"]).collect()))
    equal = quality.compare_ranges(rows, rows.withColumn("c", F.reverse("c")), ["id"])
    assert equal.count() == 0


def test_entries_in_order_and_cut(spark):
    pages = spark.createDataFrame([(1, 0, "A"), (2, 0, "B")], "page_id long, page_namespace int, page_title string")
    cat = MemoryCatalog(spark, {
        "page": pages, "categorylinks": spark.createDataFrame([(1, "x"), (1, "z"), (2, "y")], "cl_from long, cl_to string"),
        "namespace_starname": spark.createDataFrame([(14, "Category")], "nss_id int, nss_name string"),
    })
    got = props.entries(cat, "categories", pages, entry_direction="descending").select("page_id", "title", "place").collect()
    assert sorted(map(tuple, got)) == [(1, "Category:x", 2), (1, "Category:z", 1), (2, "Category:y", 1)]
    got = props.entries(cat, "categories", pages, entry_limit=2).select("page_id", "title").collect()
    assert sorted(map(tuple, got)) == [(1, "Category:x"), (1, "Category:z")]
    for bad in ({"entry_direction": "sideways"}, {"entry_limit": 0}):
        with pytest.raises(ValueError):
            props.entries(cat, "categories", pages, **bad)
    for bad in ({"cldir": "up"}, {"cllimit": 0}):
        with pytest.raises(ValueError):
            query(cat, pageids={1}, prop={"categories"}, **bad)
    with pytest.raises(ValueError):
        query(cat, list="allrevisions", arvslots="other")


def test_literal_of_a_rule_is_in_every_match(spark):
    cases = {
        r"https://issues\.example\.org/(\d+)": "issues.example.org/", r"https?://x\.y/ab+cde": "://x.y/ab", r".*": None, r"abc": None,
        r"foo(bar)?bazqux": "bazqux", r"aaaa|bbbb": None, r"(?i)abcdef": None, r"abcd?efghi": "efghi", r"[abc]+wxyz\w": "wxyz",
        r"http://www\.(a(b)c)/page\.html$": "/page.html", r"abcde{2}fg": "abcd", r"a\\bcdef": "bcdef", r"\Qabcd\E": None,
    }
    df = spark.createDataFrame(list(enumerate(cases)), "i int, p string")
    got = [r.x for r in df.orderBy("i").select(external.required_literal(F.col("p")).alias("x")).collect()]
    assert dict(zip(cases, got, strict=True)) == cases


def test_rules_without_host_match_as_if_tried_on_every_url(spark):
    rng = random.Random(9)
    hosts = [f"site{k}.example.org" for k in range(6)]
    urls = [(f"http://{rng.choice(hosts)}/{rng.choice(['wiki', 'page', 'item'])}/{rng.randrange(40)}{rng.choice(['', '.html', '?x=1'])}",)
            for _ in range(300)]
    rules = []
    for k in range(120):
        pattern = rng.choice([
            f"http://(.+)/item/{k % 40}", rf"http://([a-z0-9.]+)/page/{k % 40}\.html", f".*/wiki/({k % 40})", ".+x=1" if k == 60 else f"none{k}.*",
            f"http://site{k % 6}(.*)/wiki/.*", f"http://(site1|site2).*/{k % 40}",
        ])
        rules.append((rng.randrange(10**6), rng.choice([None, None, None, hosts[k % 6], "example.org"]), pattern, "https://new/$0", False, f"s{k}"))
    df = spark.createDataFrame(urls, "url string")
    table = spark.createDataFrame(rules, external.URL_RULES)
    expected = {}
    for (url,) in set(urls):
        host = url.split("/")[2]
        hits = [r for r in rules if (r[1] is None or host == r[1] or host.endswith("." + r[1])) and re.fullmatch(r[2], url)]
        if hits:
            expected[url] = min(hits)[5]
    got = {r.url: r.summary for r in external.rewrite_urls(df, table).collect()}
    assert got == expected and len(got) > 50
