"""What bounds a task: its joins, the rows dealt to it, the bytes sent to Python, and files of long pages."""

import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lorekeep.operators import changes, extract, lists, quality
from lorekeep.plans.quality import mirror
from lorekeep.session import prepare
from lorekeep.sources import files
from lorekeep.sources.catalog import MemoryCatalog
from lorekeep.sources.schemas import SCHEMAS


@pytest.fixture
def plain(spark):
    """Shuffles as planned: no adaptive changes, no broadcasts."""
    fixed = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in fixed}
    for k, v in fixed.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def _table(spark, name, rows):
    """Rows given as dicts; other columns are NULL."""
    kind = SCHEMAS[name]
    return spark.createDataFrame([tuple(r.get(f.name) for f in kind.fields) for r in rows], kind)


def _pages(spark):
    page = [(1, "A", 5), (2, "B", 6), (3, "C", 7), (4, "D", 8), (None, "E", 9), (3, "C", 7)]
    return MemoryCatalog(spark, {
        "page": _table(spark, "page", [
            {"page_id": i, "page_namespace": 10, "page_title": t, "page_latest": x} for i, t, x in page]),
        "ws_parser_cache_sync": _table(spark, "ws_parser_cache_sync", [
            {"wspc_page_id": i, "wspc_rev_id": x} for i, x in ((1, 5), (2, 1), (3, 7), (9, 1))]),
        "templatelinks": _table(spark, "templatelinks", [
            {"tl_from": i, "tl_namespace": 10, "tl_title": t}
            for i, t in ((3, "B"), (3, "B"), (1, "A"), (8, "B"), (None, "B"))]),
    })


def test_pages_to_extract_with_unknown_and_repeated_ids(spark):
    got = extract.pages_to_extract(_pages(spark)).collect()
    assert sorted((r.page_id for r in got), key=lambda x: (x is not None, x)) == [None, 2, 3, 4]


def test_recording_does_not_join_again_what_found_the_pages(spark):
    cat = _pages(spark)
    df = extract.record_extracted(cat, extract.pages_to_extract(cat))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 2
    got = {tuple(r) for r in df.collect()}
    assert got == {(1, 5), (2, 6), (3, 7), (4, 8), (9, 1)}


def test_last_row_of_one_column(spark):
    df = spark.createDataFrame([(1, None), (1, 4), (1, 3), (2, None)], "k int, v long")
    last = changes.last_rows(df, ["k"])
    assert sorted(map(tuple, last.collect())) == [(1, 4), (2, None)]
    assert "SortAggregate" not in last._jdf.queryExecution().executedPlan().toString()


def test_changes_without_revision_are_dealt_by_their_own_ids(plain):
    cat = MemoryCatalog(plain, {
        "recentchanges": _table(plain, "recentchanges", [
            {"rc_id": i, "rc_type": "edit", "rc_this_oldid": None if i % 2 else i} for i in range(6)]),
        "revision": _table(plain, "revision", [{"rev_id": i, "rev_sha1": f"s{i}"} for i in (0, 1, 2, None)]),
    })
    df = lists.recent_changes(cat, prop={"ids", "sha1"})
    got = sorted((r.rc_id, r.rev_sha1) for r in df.collect())
    assert got == [(0, "s0"), (1, None), (2, "s2"), (3, None), (4, None), (5, None)]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert any("hashpartitioning(rc_this_oldid" in x and "_none" in x for x in plan.splitlines())


def test_tasks_read_few_compressed_bytes(spark):
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64m")
    assert prepare(spark).conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") == "8m"


def test_batches_sent_to_python_are_bounded_in_bytes(spark):
    @F.arrow_udf("long")
    def weight(cells: pa.Array) -> pa.Array:
        return pa.array([cells.nbytes] * len(cells), pa.int64())

    texts = prepare(spark).range(0, 600, 1, 1).select(F.repeat(F.lit("x"), 100_000).alias("text"))
    largest = texts.select(weight("text").alias("n")).agg(F.max("n").alias("n")).first().n
    assert largest < 20_000_000


def test_long_page_is_written_in_several_files(plain, tmp_path):
    n = 4000
    rows = plain.range(n).selectExpr(
        "case when id = 7 then null else id end as rev_id", "case when id < 3900 then 1 else 2 end as rev_page", "0 as page_namespace",
        "0 as rev_user", "'U' as rev_user_text", "timestamp_ntz'2020-01-01 00:00:00' as rev_timestamp",
        "false as rev_minor_edit", "cast(null as long) as rev_parent_id", "'c' as rev_comment", "'w' as rev_content_model",
        "'t' as rev_content_format", "concat('text ', id) as old_text", "cast(null as string) as sha1",
    ).withColumn("page_title", F.concat(F.lit("T"), F.col("rev_page")))
    path = str(tmp_path / "dump")
    files.write_dump(rows, path)
    parts = [open(f"{path}/{x}").read() for x in sorted(os.listdir(path)) if x.endswith(".txt")]
    assert sum("<title>T1</title>" in x for x in parts) > 1
    assert all(x.startswith("<page>") and x.endswith("</page>\n") and x.count("<page>") == x.count("</page>") for x in parts if x)
    got = files.read_dump(plain, path).select("rev_id", "page_title", "old_text").collect()
    assert sorted((r.old_text, r.rev_id, r.page_title) for r in got if r.rev_id is not None) == sorted(
        (f"text {i}", i, "T1" if i < 3900 else "T2") for i in range(n) if i != 7)
    assert [(r.old_text, r.page_title) for r in got if r.rev_id is None] == [("text 7", "T1")]


def test_fields_are_not_looked_at_one_by_one_for_every_row(spark):
    kind = "k long, x double, xs array<string>, s string, m int"
    nan = float("nan")
    left = spark.createDataFrame([
        (1, nan, ["a", None], None, 1), (2, 0.0, None, "s", 1), (3, 1.0, ["a"], None, 1), (4, None, None, None, None), (None, 1.0, [], "", 1),
        (5, 1.0, [], "t", 1), (5, 2.0, [], "t", 1)], kind)
    right = spark.createDataFrame([
        (1, nan, [None, "a"], None, 2), (2, -0.0, None, "s", 2), (3, nan, None, "", 2), (6, None, None, None, None), (None, 1.0, [], "", 2),
        (5, 1.0, [], "u", 2)], kind)
    found = quality.compare(left, right, ["k"], ignore=["m"])
    got = sorted((tuple(r) for r in found.collect()), key=str)
    assert got == sorted([
        (3, "differs", "x,xs,s"), (4, "only left", ""), (6, "only right", ""), (None, "only left", ""), (None, "only right", ""),
        (5, "differs", "s"), (5, "differs", "x,s")], key=str)
    assert quality.compare(left.select("k"), right.select("k"), ["k"]).where("status = 'differs'").count() == 0
    assert "filter(array(" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_mirrored_tables_are_worked_out_once(spark, tmp_path):
    rows = {
        "page": [{"page_id": i, "page_title": None if i == 6 else f"T{i}"} for i in range(1, 41)],
        "pagelinks": [{"pl_from": 5, "pl_namespace": 0, "pl_title": "A"}, {"pl_from": 1, "pl_namespace": 0, "pl_title": "A"}] * 2,
    }
    tables = {}
    for table, _, _ in quality.MIRROR_CHECKS.values():
        _table(spark, table, rows.get(table, [])).write.parquet(str(tmp_path / table))
        tables[table] = spark.read.schema(SCHEMAS[table]).parquet(str(tmp_path / table))
    found = mirror(MemoryCatalog(spark, tables))
    # what the tables come from is not read for every side and pass
    assert found.inputFiles() and not any(str(tmp_path) in x for x in found.inputFiles())

    def expected(i):
        if i % 7 == 0:
            return None if i % 5 == 0 else ("only right", "")
        return ("only left", "") if i % 5 == 0 else ("differs", "page_title") if i % 3 == 0 and i != 6 else None

    assert sorted(map(tuple, found.collect())) == sorted(
        [("pages", str(i), *expected(i)) for i in range(1, 41) if expected(i)] + [("page links", "5/0/A", "only left", "")] * 2)
