"""Spelling variants, conversation repair and archives against plain programs."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from lorekeep.llm.common import new_shared_folder
from lorekeep.llm.conversations import compress, damaged, repaired, segments, symbols, transfer
from lorekeep.llm.spelling import blocks, close_pairs, near_words, one_edit, spelling_variants
from lorekeep.llm.warc import (
    Bytes, list_files, member, read_archives, read_manifest, record, resolved, salvage, sha1_label, write_archives,
)
from tests.conftest import SF_DIR

# ---- spelling -----------------------------------------------------------------------------


def plain_variants(rows, min_length=7, every=31):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            code = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if code % every == 0:
                run = run[: code % len(run)] + run[code % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= min_length and n >= 2}
    near = {w: [x for x in words if abs(len(w) - len(x)) < 2 and distance(w, x) == 1] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        if best and words[best] >= 10 * n:
            form[w] = best
    out = []
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(near[w]), words.get(form.get(w))))
    return sorted(out)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def variants_of(docs, **options):
    found = spelling_variants(docs, **options).select("word", "form", "root", "n", "n_near", "form_n").collect()
    return sorted(tuple(r) for r in found)


@pytest.fixture(scope="module")
def misspelled(spark):
    rng = random.Random(5)
    base = ["".join(rng.choice("abcé") for _ in range(rng.choice([7, 7, 8, 9, 12]))) for _ in range(25)]
    rows = []
    for i in range(60):
        words = []
        for _ in range(40):
            w = rng.choice(base) if rng.random() < 0.8 else base[0]
            if rng.random() < 0.15:
                k = rng.randrange(len(w))
                w = w[:k] + rng.choice(["", "b", w[k] + "a"]) + w[k + 1 :]
            words.append(w.title() if rng.random() < 0.1 else w)
        rows.append((i, " ".join(words), i))
    rows += [(100, None, 1), (101, "", 1), (None, "abcabca abcabca, abcabcb!", 1), (102, "q" * 30000 + " " + "q" * 29999, 1)]
    rows += [(103, "q" * 30000 + " " + "q" * 29999, 1), rows[0]]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, word long")


def test_variants_match_plain_program_at_any_block_limit(misspelled):
    rows, docs = misspelled
    short = [r for r in rows if len(r[1] or "") < 20000]
    expected = plain_variants([r[:2] for r in short])
    long = {"q" * 30000, "q" * 29999}
    for limit in (512, 4):
        got = variants_of(docs, limit=limit)
        assert [r for r in got if r[0] not in long] == expected
        assert {r[0]: r[4] for r in got if r[0] in long} == dict.fromkeys(long, 1)
    assert any(r[1] and r[2] != r[1] for r in expected) or any(r[1] for r in expected)


def test_variants_of_nothing(spark):
    assert variants_of(spark.createDataFrame([], "doc_id long, text string")) == []
    assert variants_of(spark.createDataFrame([(1, None), (2, "short words only")], "doc_id long, text string")) == []


def test_blocks_are_bounded_and_pairs_come_once(spark):
    rng = random.Random(2)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.choice([9, 10]))) for _ in range(900)})
    df = spark.createDataFrame([(w, 1) for w in words], "word string, n long")
    sizes = [r["count"] for r in blocks(df, 7, 16).groupBy("block").count().collect()]
    # at most one letter is open in a block that cannot be halved again
    assert max(sizes) <= 16
    got = [tuple(r)[:2] for r in near_words(df, 7, 16).collect()]
    expected = [(a, b) for a in words for b in words if abs(len(a) - len(b)) < 2 and distance(a, b) == 1]
    assert sorted(got) == sorted(expected)


def test_gram_product_keeps_near_pairs():
    words = ["abcdefg", "abcdefh", "abcdef", "gfedcba", "zzzzzzz", "abcdefgh"]
    group = np.zeros(len(words), np.int64)
    own = np.array([0, 1, 3, 4])
    assert set(close_pairs(words, own, group)) >= {(0, 1), (0, 2), (0, 5), (0, 3)}
    assert not [p for p in close_pairs(words, own, group) if 4 in p]
    assert one_edit("abcdefg", "gfedcba") == -1 and one_edit("abc", "abc") == -1 and one_edit("abc", "abxc") == 2


# ---- conversations ------------------------------------------------------------------------


def plain_repair(rows):
    """Row by row, with the cheapest audit and text of every state as plain strings."""
    talks = defaultdict(list)
    for conv_id, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        code = zlib.crc32(f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}".encode()) % 20
        own = talks[conv_id]
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        if code:
            own += [(turn, "user" if code == 4 else role, text)] * (2 if code == 3 else 1)
    after = {"E": {"s": "S", "u": "U"}, "S": {"u": "U"}, "U": {"a": "A"}, "A": {"u": "U"}}
    made = [("u", "user"), ("a", "assistant")]
    out = []
    for conv_id, own in talks.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
        turns = {t for t, _, _ in own if t is not None}
        faults, seen = [], set()
        for _, role, text in own:
            end = text.rstrip(" \t\n\v\f\r")
            faults.append("blank" if not end else "duplicate" if (role, text) in seen else "" if end[-1] in ".!?" else "cut")
            seen.add((role, text))
        ways = {"E": (0, "", ())}

        def put(found, state, way):
            if state and (state not in found or way < found[state]):
                found[state] = way
                return True
            return False

        def inserted(found):
            while any([
                put(found, after[s].get(i), (c + 2, a + "I", t + (f"{r}:",)))
                for s, (c, a, t) in list(found.items()) for i, r in made
            ]):
                pass

        for (_, role, text), fault in zip(own, faults, strict=True):
            inserted(ways)
            found = {}
            for state, (c, a, t) in ways.items():
                put(found, state, (c + 3, a + "D", t))
                if fault in ("", "cut"):
                    more = c + (fault == "cut")
                    put(found, after[state].get(role[:1]), (more, a + "K", (*t, f"{role}:{text}")))
                    for i, r in made:
                        put(found, after[state].get(i), (more + 2, a + "R", (*t, f"{r}:{text}")))
            ways = found
        inserted(ways)
        cost, audit, text = min(ways[s] for s in "EA" if s in ways)
        illegal = sum((x[1][:1] + y[1][:1]) not in ("su", "ua", "au") for x, y in zip(own, own[1:], strict=False))
        out.append((
            conv_id, max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults.count("blank"),
            faults.count("duplicate"), faults.count("cut"), illegal, cost, audit,
            hashlib.sha256("\n".join(text).encode()).hexdigest(),
        ))
    return sorted(out, key=str)


TALK = "conv_id long, turn long, role string, text string"


def repaired_rows(df):
    return sorted((tuple(r) for r in repaired(df).collect()), key=str)


def test_repair_of_the_table(spark):
    talks = spark.read.parquet(f"{SF_DIR}/conversations.parquet")
    rows = [tuple(r) for r in talks.select("conv_id", "turn", "role", "text").collect()]
    assert repaired_rows(talks) == plain_repair(rows)


def test_repair_of_odd_and_long_conversations(spark):
    rng = random.Random(3)
    rows = []
    for conv_id in (None, *range(40)):
        for k in range(rng.choice([1, 3, 9, 5])) if conv_id != 7 else range(1500):
            rows.append((
                conv_id, rng.choice([None, k, k, k, k // 2]),
                rng.choice(["user", "assistant", "system", "user", "assistant", "tool", "", None, "ünï", "uncle"]),
                rng.choice(["Hi.", "Ok", "", "  ", None, "A b!\n ", f"x?{k}", "y.\x85", f"{k}."]),
            ))
    rows += [(50, k, "user", "y" * 200_000 + ".") for k in range(3)] + [rows[0]]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], f"{TALK}, copies long, segment long")
    assert repaired_rows(df) == plain_repair(rows)


def test_conversations_without_rows(spark):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:1".encode()) % 20 == 0)
    df = spark.createDataFrame([(gone, 1, "user", "Hi.")], TALK)
    assert repaired_rows(df) == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert repaired(spark.createDataFrame([], TALK)).count() == 0


def test_grammar_keeps_sequences_and_products(spark):
    talks = spark.read.parquet(f"{SF_DIR}/conversations.parquet")
    parts = segments(symbols(damaged(talks))).groupBy("sequence").count().withColumnRenamed("count", "weight").cache()
    few, rules = compress(parts, rules=40, per_round=8)
    assert len(rules) > 8
    expand = {}
    for k, pair in enumerate(rules):
        expand[chr(0xE000 + k)] = "".join(expand.get(s, s) for s in pair)
    for row in few.collect():
        assert "".join(expand.get(s, s) for s in row.packed) == row.sequence
        assert len(row.sequence) < 2 or len(row.packed) <= len(row.sequence)
    none, _ = compress(parts, rules=0)
    key = lambda r: r.sequence
    assert sorted(transfer(few, rules).collect(), key=key) == sorted(transfer(none, []).collect(), key=key)
    parts.unpersist()


# ---- archives -----------------------------------------------------------------------------

PAGE = "page_id long, url string, html string"


def archive(pages, spark, **options):
    path = new_shared_folder(spark, "warc")
    files = write_archives(pages, path, **options)
    return path, files


def test_pages_come_back(spark):
    rows = [(i, f"http://h/{i % 7} \r\nX: y", "é" * (400 + i % 300)) for i in range(1200)]
    rows += [(5000 + i, "u", "Z" * 1500) for i in range(60)] + [(5059, "v", "Z" * 1500), (None, None, "Z" * 1500)]
    rows += [(7000, "u", None), (7001, None, ""), (7002, "u", "x" * 999), (7003, "u", "x" * 999), (None, "u", "n" * 2000)]
    rows += [(-5, "u", "WARC/1.0\r\n" * 300_000)]
    pages = spark.createDataFrame([(*r, 1) for r in rows], f"{PAGE}, refers_to long")
    path, files = archive(pages, spark, file_bytes=50_000)
    assert files.count() > 3
    records, gaps = read_archives(read_manifest(spark, path), path, range_bytes=20_000)
    groups = defaultdict(list)
    for page_id, _, html in rows:
        groups[html or ""].append(page_id)
    expected = []
    for page_id, _, html in rows:
        data, ids = (html or "").encode(), [i for i in groups[html or ""] if i is not None]
        later = len(data) >= 1000 and bool(ids) and (page_id is None or page_id < max(ids))
        expected.append((
            page_id, len(data), hashlib.sha1(data).hexdigest(), "revisit" if later else "response", max(ids) if later else None
        ))
    names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted((tuple(r) for r in resolved(records).select(*names).collect()), key=str) == sorted(expected, key=str)
    assert gaps.count() == 0
    # without the manifest, with whole payloads
    again, _ = read_archives(list_files(spark, f"{path}/archives"), payload=True)
    held = {hashlib.sha1(r.payload).hexdigest(): r.digest for r in again.where("payload is not null").collect()}
    assert all(a == b for a, b in held.items())


def test_no_pages(spark):
    path, files = archive(spark.createDataFrame([], PAGE), spark)
    records, gaps = read_archives(files, path)
    assert resolved(records).count() == gaps.count() == 0


def put(spark, tmp_path, data):
    (tmp_path / "one.warc.gz").write_bytes(data)
    return spark.createDataFrame([("one.warc.gz", len(data))], "path string, size long"), f"file://{tmp_path}"


def offsets(parts):
    ends = np.cumsum([len(p) for p in parts]).tolist()
    return list(zip([0, *ends[:-1]], ends, strict=True))


@pytest.mark.parametrize("range_bytes", [1 << 20, 3000, 400])
def test_salvage_goes_on_after_damage(spark, tmp_path, range_bytes):
    rng = random.Random(1)
    bodies = [rng.randbytes(rng.randrange(200, 3000)).hex().encode() for _ in range(40)]
    # single members and bare records, with every kind of damage
    parts = [(member if i % 3 else bytes)(record(i, "u", b)) for i, b in enumerate(bodies)]
    bad = {}
    flipped = bytearray(parts[4])
    flipped[len(flipped) // 2] ^= 0x55
    parts[4], bad[4] = bytes(flipped), "member"
    parts[9], bad[9] = parts[9].replace(b"Content-Length: ", b"Content-Length: 9", 1), None  # either length line
    parts[12], bad[12] = parts[12].replace(bodies[12][:40], bytes(40), 1), "digest"
    parts[15], bad[15] = b"XARC" + parts[15][4:], "start"
    parts[20], bad[20] = parts[20][: len(parts[20]) // 2], None
    parts[21], bad[21] = b"\x1f\x8b\x08 noise WARC/1.1\r\n\r\n" * 9, None
    parts[39], bad[39] = parts[39][:-30], None
    files, folder = put(spark, tmp_path, b"".join(parts))
    records, gaps = read_archives(files, folder, range_bytes)
    spans = offsets(parts)
    assert sorted((r.start, r.end) for r in records.collect()) == [s for i, s in enumerate(spans) if i not in bad]
    expected = []
    for i in sorted(bad):
        start, end = spans[i]
        if expected and expected[-1][1] == start:
            expected[-1] = (expected[-1][0], end, expected[-1][2])
        else:
            expected.append((start, end, bad[i]))
    got = sorted(tuple(r) for r in gaps.select("start", "end", "reason").collect())
    assert [g[:2] for g in got] == [e[:2] for e in expected]
    assert all(g[2] and e[2] in (None, g[2]) for g, e in zip(got, expected, strict=True))


@pytest.mark.parametrize("range_bytes", [1 << 20, 1500, 200])
def test_archives_within_payloads_are_no_records(spark, tmp_path, range_bytes):
    inner = b"".join(record(i, "in", b"x" * 300) for i in range(20)) + member(record(99, "in", b"y" * 300))
    parts = [record(1, "u", b"a" * 500), record(2, "u", inner), member(record(3, "u", b"c")), record(4, "u", b"d" * 900)]
    files, folder = put(spark, tmp_path, b"".join(parts))
    records, gaps = read_archives(files, folder, range_bytes)
    assert sorted((r.start, r.end) for r in records.collect()) == offsets(parts)
    assert gaps.count() == 0


def test_member_with_several_records_and_foreign_digests(tmp_path):
    two = record(1, "u", b"a") + record(2, "u", b"b")
    odd = record(3, "u", b"c").replace(sha1_label(b"c").encode(), b"md5:zz")
    data = member(two) + odd
    (tmp_path / "x").write_bytes(data)
    with open(tmp_path / "x", "rb") as file:
        found = list(salvage(Bytes(file, 0, len(data)), 0, len(data)))
    assert [r.payload for r in found] == [b"a", b"b", b"c"]
