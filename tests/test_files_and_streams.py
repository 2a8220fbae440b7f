"""Files in their original formats, and streams against the batch result."""

import json

from pyspark.sql import functions as F

from lorekeep.operators import activity, changes
from lorekeep.sources import files
from lorekeep.sources.catalog import Catalog
from lorekeep.sources.schemas import SCHEMAS
from lorekeep.streaming import feeds
from lorekeep.streaming.store import KeyedStore, id_range

DUMP = """<mediawiki><siteinfo><sitename>x</sitename></siteinfo>
<page><title>Main page</title><ns>0</ns><id>1</id>
 <revision><id>1</id><timestamp>2020-01-01T00:00:00Z</timestamp><contributor><username>Admin</username><id>1</id></contributor>
  <comment>first</comment><model>wikitext</model><format>text/x-wiki</format><text bytes="5" xml:space="preserve">hello</text>
  <sha1>k5wx5mflx1mcnsdxihbn1kr0ngbjc1m</sha1></revision>
 <revision><id>2</id><parentid>1</parentid><timestamp>2020-01-02T00:00:00Z</timestamp><contributor><ip>1.2.3.4</ip></contributor>
  <minor/><model>wikitext</model><format>text/x-wiki</format><text bytes="0"/></revision>
</page></mediawiki>"""


def test_dump(spark, tmp_path):
    (tmp_path / "dump.xml").write_text(DUMP)
    first, second = files.read_dump(spark, str(tmp_path / "dump.xml")).orderBy("rev_id").collect()
    assert (first.page_title, first.rev_user_text, first.old_text, first.rev_len) == ("Main page", "Admin", "hello", 5)
    assert len(first.rev_sha1) == 40 and not first.rev_minor_edit
    assert (second.rev_user_text, second.rev_user, second.rev_minor_edit, second.rev_parent_id) == ("1.2.3.4", 0, True, 1)


def test_dump_of_long_histories_is_read_in_many_tasks(spark, tmp_path):
    """Pages of thousands of revisions over many splits; marks in texts stay text."""
    n = 6000
    rows = spark.range(n).selectExpr(
        "id as rev_id", "case when id < 5000 then 1 when id < 5001 then 2 else 3 end as rev_page", "0 as page_namespace",
        "0 as rev_user", "'U & <V>' as rev_user_text", "timestamp_ntz'2020-01-01 00:00:00' as rev_timestamp",
        "id % 2 = 0 as rev_minor_edit", "cast(null as long) as rev_parent_id", "'c' as rev_comment", "'w' as rev_content_model",
        "'t' as rev_content_format", "concat('<page><title>no</title></revision> ', id) as old_text", "cast(null as string) as sha1",
    ).withColumn("page_title", F.concat(F.lit("T<"), F.col("rev_page")))
    files.write_dump(rows, str(tmp_path / "dump"))
    small = {"spark.sql.files.maxPartitionBytes": "100000", "spark.sql.files.openCostInBytes": "0"}
    before = {k: spark.conf.get(k) for k in small}
    for k, v in small.items():
        spark.conf.set(k, v)
    try:
        read = files.read_dump(spark, str(tmp_path / "dump"))
        assert files._dump_pieces(spark, str(tmp_path / "dump")).rdd.getNumPartitions() > 10
        got = read.select("rev_id", "rev_page", "page_title", "rev_user_text", "rev_minor_edit", "old_text").collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    page = lambda i: 1 if i < 5000 else 2 if i < 5001 else 3
    assert sorted(map(tuple, got)) == [
        (i, page(i), f"T<{page(i)}", "U & <V>", i % 2 == 0, f"<page><title>no</title></revision> {i}") for i in range(n)
    ]


def test_site_and_lists(spark, tmp_path):
    site = {
        "namespaces": [{"id": 0, "case": "first-letter", "*": "", "content": ""},
                       {"id": 4, "case": "first-letter", "*": "Lore", "canonical": "Project", "subpages": ""}],
        "namespacealiases": [{"id": 4, "*": "L"}],
        "interwikimap": [{"prefix": "de", "url": "https://de/$1", "local": ""}, {"prefix": "wp", "url": "https://wp/$1"}],
        "tags": [{"name": "t", "description": "", "active": "", "source": ["manual"]}],
    }
    (tmp_path / "site.json").write_text(json.dumps(site, indent=1))
    got = files.read_site(spark, str(tmp_path / "site.json"))
    assert {tuple(r) for r in got["namespace_name"].collect()} == {(0, ""), (4, "Lore"), (4, "Project"), (4, "L")}
    assert [(r.iw_prefix, r.iw_local) for r in got["interwiki"].orderBy("iw_prefix").collect()] == [("de", True), ("wp", False)]
    tag = got["tag"].first()
    assert (tag.tag_displayname, tag.tag_description, tag.tag_active, tag.tag_source) == ("(hidden)", None, True, ["manual"])
    (tmp_path / "packages").write_text("# header\nfoo\n\n bar \n")
    assert [r.name for r in files.read_package_list(spark, str(tmp_path / "packages")).collect()] == ["foo", "bar"]
    (tmp_path / "lost.json").write_text(json.dumps([{"rev_id": 1, "rev_page": 2}, {"rev_id": 3, "rev_page": 4}]))
    assert files.read_recovered(spark, str(tmp_path / "lost.json")).count() == 2


def test_wiki_table_round_trip(spark, tmp_path):
    data = [(f"n{i}" if i % 5 else None, i, "" if i % 7 else "-5") for i in range(1000)]
    df = spark.createDataFrame(data, "name string, n int, note string")
    expected = [[name or "", str(n), note] for name, n, note in reversed(data)]
    for single in (True, False):
        path = tmp_path / f"table-{single}"
        table = files.wiki_table(df, ["name", "n", "note"], [F.col("n").desc()], single)
        files.write_lines(table, str(path), files=4)
        assert len(list(path.glob("part-*"))) == 4
        got = files.read_wiki_table(spark, str(path)).orderBy("row").collect()
        assert [r.cells for r in got] == expected and [r.row for r in got] == list(range(1000))
        assert got[0].fields == ["name", "n", "note"]
    files.write_lines(files.wiki_table(df.where("false"), ["name"], [F.col("name")]), str(tmp_path / "empty"))
    assert files.read_wiki_table(spark, str(tmp_path / "empty")).count() == 0


def test_snapshot_has_declared_schema(spark, sample, tmp_path):
    files.write_snapshot({"page": sample["page"], "redirect": sample["redirect"]}, str(tmp_path / "v1"))
    cat = Catalog(spark, str(tmp_path / "v1"))
    assert cat.page.schema == SCHEMAS["page"] and cat["redirect"].count() == sample["redirect"].count()
    assert "page_links_updated" in cat.page.columns and set(cat.names()) >= {"page", "revision", "ws_url_check"}
    assert len(SCHEMAS) >= 35


def test_report_and_export(spark, tmp_path):
    messages = spark.createDataFrame([("B (Español)", "y"), ("A", "x"), ("A", "w")], "title string, message string")
    lines = files.report_lines(messages)
    assert [r.line for r in lines.collect()] == ["* [[A]]", "** w", "** x", "* [[B (Español)]]", "** y"]
    path = lambda ns, t: files.export_path(F.lit(ns), F.lit(t), ascii_only=True)
    row = spark.range(1).select(path("", "A b (Español)"), path("Help", "X"), path("File", "p.png"), path("User", "U"), path("", "Č")).first()
    assert row[:4] == ("es/A_b.wiki", "en/Help:X.wiki", "File:p.png", "User:U.wiki") and len(row[4]) == len("en/.wiki") + 32


def _land(spark, folder, name, rows):
    lines = [json.dumps({"rc_id": i, "rc_timestamp": t, "rc_user_text": u, "rc_type": "edit"}) for i, t, u in rows]
    (folder / name).write_text("\n".join(lines) + "\n")


def test_late_and_repeated_events(spark, tmp_path):
    landing = tmp_path / "in"
    landing.mkdir()

    def run(build, mode, name):
        stream = feeds.read_changes(spark, str(landing), files_per_batch=1)
        return feeds.run_available(build(stream), str(tmp_path / name), str(tmp_path / (name + "-ckpt")), mode)

    day = lambda d: f"2024-01-{d:02d}T12:00:00"
    _land(spark, landing, "1.json", [(i, day(i), "u") for i in range(1, 4)])
    once = lambda s: feeds.deduplicated(s, ["rc_id"], "rc_timestamp", "3 days")
    count = lambda s: feeds.daily_counts(s, "rc_timestamp", "3 days")
    assert run(once, "append", "once").count() == 3
    run(count, "append", "days")
    # a later file repeats day 3 and moves the watermark to day 17
    _land(spark, landing, "2.json", [(3, day(3), "u"), (20, day(20), "u")])
    assert run(once, "append", "once").count() == 4
    run(count, "append", "days")
    # events of day 2 are now too late, those of day 19 are not
    _land(spark, landing, "3.json", [(90, day(2), "late"), (91, day(19), "u")])
    got = run(once, "append", "once")
    assert sorted(r.rc_id for r in got.collect()) == [1, 2, 3, 20, 91]
    closed = {r.day.day: r.events for r in run(count, "append", "days").collect()}
    assert closed[1] == 1 and closed[2] == 1 and 20 not in closed


def test_repeated_batch_replaces_itself(spark, tmp_path):
    write = feeds.batch_writer(str(tmp_path / "out"))
    df = spark.createDataFrame([(1, "a")], "id int, x string")
    write(df, 0)
    write(df.withColumn("x", F.lit("b")), 1)
    write(df, 0)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == 2
    assert feeds.latest_rows(got, ["id"]).first().x == "b" and feeds.first_rows(got, ["id"]).first().x == "a"


def test_stream_and_batch_spam_agree(spark, sample, tmp_path):
    docs = sample["documents"].select("doc_id", "source", "text")
    docs.write.json(str(tmp_path / "docs"))
    stream = feeds.spam_alerts(feeds.read_stream(spark, str(tmp_path / "docs"), docs.schema), "source", "text", ["the with"], 2)
    got = feeds.run_available(stream, str(tmp_path / "alerts"), str(tmp_path / "ckpt"))
    batch = activity.spam_flags(docs, "source", "text", ["the with"], 2).where("is_spam")
    assert {r.doc_id for r in got.collect()} == {r.doc_id for r in batch.collect()}


def test_store_keeps_one_row_per_key_and_rewrites_touched_parts_only(spark, tmp_path):
    schema = spark.createDataFrame([], "id long, x string, log_id long").schema
    rows = lambda *r: spark.createDataFrame(r, schema)
    first = KeyedStore(spark, f"{tmp_path}/first", schema, ["id"], id_range("id", 100))
    assert first.table().count() == 0
    first.apply(rows((1, "a", 0), (150, "b", 0), (1, "a", 0)), 0)
    first.apply(rows((2, "c", 0), (150, "later", 0)), 1)
    first.apply(rows((250, "d", 0)), 2)
    first.apply(rows(), 3)
    expected = {(1, "a"), (2, "c"), (150, "b"), (250, "d")}
    seen = lambda: {(r.id, r.x) for r in first.table().collect()}
    assert seen() == expected and first.table().count() == 4
    assert first._commit_before() == {0: 1, 1: 1, 2: 2}
    # a repeated batch changes nothing, and reads before its commit see the one before
    first.apply(rows(), 3)
    first.apply(rows((250, "d", 0)), 4)
    first.apply(rows((250, "d", 0)), 4)
    assert seen() == expected and first._commit_before(4) == {0: 1, 1: 1, 2: 2}
    last = KeyedStore(spark, f"{tmp_path}/last", schema, ["id"], id_range("id", 100), "log_id")
    last.apply(rows((1, "old", 5), (1, "new", 9), (7, "x", 1)), 0)
    last.apply(rows((1, "late", 7), (7, "y", 2)), 1)
    assert {(r.id, r.x) for r in last.table().collect()} == {(1, "new"), (7, "y")}


def test_reading_does_not_grow_with_batches(spark, tmp_path):
    schema = spark.createDataFrame([], "id long, x string").schema
    store = KeyedStore(spark, f"{tmp_path}/s", schema, ["id"], id_range("id", 50))
    for k in range(24):
        store.apply(spark.range(5 * k, 5 * k + 7).selectExpr("id", f"'{k}' as x"), k)
        if k == 3:
            files_after_few = len(store.table().inputFiles())
    got = {r.id: int(r.x) for r in store.table().collect()}
    assert got == {i: max(0, (i - 2) // 5) if i % 5 < 2 and i > 1 else min(i // 5, 23) for i in range(122)}
    # one set of files per part, and as many commits as are kept
    assert len(store._commit_before()) == 3 and files_after_few <= 8 and len(store.table().inputFiles()) <= 24
    assert len(list((tmp_path / "s" / "commits").iterdir())) <= 4 + 1


def test_streamed_last_actions_match_batch(spark, sample, tmp_path):
    log = sample["logging"].withColumn("n", F.pmod(F.xxhash64("log_id"), F.lit(5)))
    # not in order: late events come after the ones that overrule them
    for k in range(5):
        log.where(F.col("n") == k).drop("n").coalesce(1).write.json(f"{tmp_path}/in/{k}")
    stream = feeds.read_changes(spark, f"{tmp_path}/in", "logging", files_per_batch=1)
    got = feeds.last_actions(changes.tag_events(stream), ["id", "tag_name"], f"{tmp_path}/out", f"{tmp_path}/ckpt")
    batch = changes.last_rows(changes.tag_events(sample["logging"]), ["id", "tag_name"], "log_id")
    columns = ["id", "tag_name", "added"]
    assert batch.count() > 5
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(map(tuple, batch.select(*columns).collect()))
