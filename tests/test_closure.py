"""Closures and chained merges against plain loops; rounds and rows written."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from lorekeep.operators import changes, closure, extract, graph


@pytest.fixture
def written(monkeypatch):
    """Row counts of all generations that are written."""
    counts = []
    append = closure.Generations.append

    def counted(self, df):
        out = append(self, df)
        counts.append(out.count())
        return out

    monkeypatch.setattr(closure.Generations, "append", counted)
    return counts


def test_chain_of_transclusions_takes_logarithmic_rounds(spark, written):
    n = 1000
    page = spark.range(n).selectExpr("id as page_id", "10 as page_namespace", "concat('T', id) as page_title")
    links = spark.range(n - 1).selectExpr("id as tl_from", "10 as tl_namespace", "concat('T', id + 1) as tl_title")
    found = extract.transclusion_closure(links, page)
    assert found.count() == n * (n - 1) // 2 == sum(written)
    assert len(written) <= 12


def test_closure_of_random_graphs(spark):
    rng = random.Random(2)
    edges = {(rng.randrange(40), rng.randrange(40)) for _ in range(60)} | {(50, None), (1, 1)}
    steps = spark.createDataFrame([(a, f"n{b}", b) for a, b in edges], "a long, name string, b long")
    got = {(r.a, r.b) for r in closure.reachable(steps, "a", ["name"], "b").collect()}
    expected = set(edges)
    while more := {(a, d) for a, b in expected for c, d in edges if b is not None and b == c} - expected:
        expected |= more
    assert got == expected


def test_chains_of_redirects(spark, written):
    n = 1000
    edges = [(0, f"R{i}", 0, f"R{i + 1}", "half" if i == n // 2 else None) for i in range(n)]
    edges += [(0, "L1", 0, "L2", None), (0, "L2", 0, "L1", None), (0, "L3", 0, "L1", "x")]
    df = spark.createDataFrame(edges, "src_ns int, src_title string, dst_ns int, dst_title string, fragment string")
    got = {r.src_title: (r.dst_title, r.fragment) for r in graph.resolve_redirects(df).collect()}
    assert got == {
        **{f"R{i}": (f"R{n}", "half" if i <= n // 2 else None) for i in range(n)}, **dict.fromkeys(("L1", "L2", "L3"), (None, None))
    }
    assert len(written) <= 13


def test_rename_chains_match_replay(spark, written):
    rng = random.Random(7)
    events = [(k, rng.choice("ABCDEF"), rng.choice("ABCDEFG")) for k in range(60)]
    events += [(100 + k, f"long{k}", f"long{k + 1}") for k in range(500)]
    steps = spark.createDataFrame(events, "seq long, src string, dst string")
    expected = {}
    for src in {s for _, s, _ in events}:
        name, after = src, -1
        while step := min(((q, d) for q, s, d in events if s == name and q > after), default=None):
            after, name = step
        expected[src] = name
    assert dict(changes.final_targets(steps).collect()) == expected
    assert len(written) <= 12


def replayed(revisions, merges):
    place = {r: p for r, p, _ in revisions}
    time = {r: t for r, _, t in revisions}
    for _, src, dst, point, rejected in sorted(merges):
        if not rejected and point is not None:
            for r, p in place.items():
                if p == src and time[r] is not None and time[r] <= point:
                    place[r] = dst
    return place


def merged(spark, revisions, merges):
    planned = spark.createDataFrame(
        merges, "log_id long, src_page long, dest_page long, mergepoint timestamp_ntz, rejected boolean")
    df = spark.createDataFrame(revisions, "rev_id long, rev_page long, rev_timestamp timestamp_ntz")
    return dict(changes.apply_merges(df, planned).select("rev_id", "rev_page").collect())


def day(k):
    return None if k is None else dt.datetime(2024, 1, 1) + dt.timedelta(days=k)


def test_three_chained_merges(spark):
    merges = [(1, 1, 2, day(10), False), (2, 2, 3, day(8), False), (3, 3, 4, day(5), False), (4, 3, 1, day(7), True)]
    revisions = [(k, 1, day(k)) for k in range(12)] + [(20, 2, day(8)), (21, 3, day(9)), (22, 1, None)]
    got = merged(spark, revisions, merges)
    assert got == replayed(revisions, merges)
    assert [got[k] for k in (5, 8, 10, 11)] == [4, 3, 2, 1]


def test_merges_match_replay(spark, written):
    rng = random.Random(5)
    for n_pages, n in ((3, 25), (6, 60)):
        merges = [
            (k, rng.randrange(n_pages), rng.randrange(n_pages), day(rng.choice([None, *range(40)])), rng.random() < 0.1)
            for k in range(n)
        ]
        revisions = [(k, rng.randrange(n_pages + 1), day(rng.choice([None, *range(42)]))) for k in range(150)]
        assert merged(spark, revisions, merges) == replayed(revisions, merges)
    written.clear()
    chain = [(k, k, k + 1, day(400 - k), False) for k in range(300)]
    revisions = [(k, 0, day(k)) for k in range(0, 420, 7)]
    assert merged(spark, revisions, chain) == replayed(revisions, chain)
    assert len(written) <= 11


def test_no_merges_and_no_rows(spark):
    assert merged(spark, [(1, 1, day(1))], [(1, 1, 1, day(5), False), (2, 1, 2, None, False)]) == {1: 1}
    assert merged(spark, [], [(1, 1, 2, day(5), False)]) == {}
    nothing = spark.createDataFrame([], "seq long, src string, dst string")
    assert changes.final_targets(nothing).count() == 0
    none = closure.reachable(spark.range(0).selectExpr("id as a", "id as k", "id as b"), "a", ["k"], "b")
    assert none.select(F.count("*")).first()[0] == 0
