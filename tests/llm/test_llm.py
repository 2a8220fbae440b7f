"""Training-data operators: brute force, round trips, held-out accuracy and edge cases."""

import hashlib
import os
import random
import re
import zlib

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

import corpus_pipeline
from check import compare, connect
from lorekeep.llm import queries as q
from lorekeep.llm import sql
from lorekeep.llm.bpe import Bpe, encode_documents, encoding_digests
from lorekeep.llm.chunks import ChunkCache
from lorekeep.llm.common import words_of
from lorekeep.llm.exact_dedup import exact_dedup, exact_groups
from lorekeep.llm.mixing import mix, mixed_documents
from lorekeep.llm.near_dedup import mixed, near_dedup, near_duplicates, signatures
from lorekeep.llm.pii import KINDS, all_spans, base_spans, find_pii, luhn, train, training_windows
from lorekeep.llm.quality_bands import LEVEL, compression_verdict, quality_bands, repeat_words
from lorekeep.llm.rule_ensemble import quality_filter, quality_scores, statistics, trained
from lorekeep.llm.token_counts import Automaton, read_pieces, token_counts
from lorekeep.llm.token_files import (
    canonical_codes, code_lengths, decode_table, new_folder, pack, read_token_files, unpack, write_token_files,
)
from lorekeep.llm.toxicity import _feature_rows, toxicity_scores
from tests.conftest import SF_DIR

os.environ["TOKENIZERS_PARALLELISM"] = "false"

LONG = "lorem ipsum dolor sit amet " * 8000
ODD = [
    None, "", " \t\n", "a", "One two three.", "one two three.", "same text here", "same text here", LONG,
    "x" * 5000, "Été ΣΑΣ İstanbul ﬁ 中文 ½ \x1c\x85　 tail", "<|endoftext|>a<|startoftext|> it's 12 !!",
    "mail a.b@c.de or 10.0.0.300 and 4111 1111 1111 1111 call +1 (555) 123-4567",
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, kept boolean, id long"


@pytest.fixture(scope="module")
def odd(spark):
    """Edge cases, a repeated row, a null id, a null source, and columns with clashing names."""
    rows = [(i, t, "en", f"s{i % 3}" if i else None, 1, 0.5, True, 7) for i, t in enumerate(ODD)]
    rows += [rows[6], (None, "null id", None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 1), (3, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def texts(spark):
    return [r.text for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").orderBy("doc_id").collect()]


# ---- all operators on edge cases ----------------------------------------------------------


def operators(spark, labels):
    def files(docs):
        path = new_folder(spark)
        write_token_files(docs, path, q.WORD_BPE, end_id=1, file_ids=3000, block_ids=1000)
        return read_token_files(spark, path, digests=True)

    return {
        "pii": find_pii, "mix": mix, "counts": lambda d: token_counts(d, q.BYTE_PIECES), "files": files,
        "bands": quality_bands, "rules": lambda d: quality_scores(d, labels), "near": lambda d: near_duplicates(d, width=4),
        "bpe": lambda d: encoding_digests(d, q.WORD_BPE), "exact": exact_groups,
        "toxicity": lambda d: toxicity_scores(d, labels),
    }


@pytest.mark.parametrize("name", ["pii", "mix", "counts", "files", "bands", "rules", "near", "bpe", "exact", "toxicity"])
def test_edge_cases_give_one_row_per_row(spark, odd, empty, labels, name):
    run = operators(spark, labels)[name]
    got = sorted(str(r.doc_id) for r in run(odd).collect())
    assert got == sorted(str(r.doc_id) for r in odd.select("doc_id").collect())
    assert run(empty).count() == 0


def test_stages_keep_columns_and_survive_edge_cases(spark, odd, empty, labels):
    for stage in (exact_dedup, near_dedup, mixed_documents):
        assert stage(odd).columns == odd.columns
        assert stage(empty).count() == 0
    assert exact_dedup(odd).where("text = 'same text here'").select("doc_id").collect()[0].doc_id == 7
    assert exact_dedup(odd).count() == len(ODD) - 2 + 1  # null, empty and the repeated row fall together


def test_quality_filter_survives_edge_cases(spark, odd, empty, labels):
    assert quality_filter(odd, labels).columns == odd.columns
    assert quality_filter(empty, labels).count() == 0
    # without labels of both kinds all rows are accepted or none; repeated rows and null ids stay
    same = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert quality_filter(odd, same).count() == odd.count()


def test_quality_filter_rejects_rows_not_ids(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    found = docs.join(quality_scores(docs, labels).select("doc_id", "predicted"), "doc_id").orderBy("doc_id").collect()
    accepted, rejected = ([r.text for r in found if r.predicted == k] for k in (1, 0))
    more = [(i, t, "en", "s", 1) for i in (None, 10**9) for t in (accepted[0], rejected[0], accepted[1], accepted[1])]
    got = quality_filter(docs.unionByName(spark.createDataFrame(more, docs.schema)), labels).collect()
    assert sorted(r.doc_id for r in got if r.doc_id is not None and r.doc_id < 10**9) == [r.doc_id for r in found if r.predicted]
    for i in (None, 10**9):
        assert sorted(r.text for r in got if r.doc_id == i) == sorted([accepted[0], accepted[1], accepted[1]])


# ---- SQL ----------------------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(q.SQL))
def test_query_matches_sql(spark, name):
    import __spark_entry__

    assert name in __spark_entry__.queries()
    good, note = compare(spark, connect(SF_DIR), SF_DIR, name, q.SQL[name])
    assert good, note
    assert q.SQL[name] in vars(sql).values()


# ---- exact duplicates ---------------------------------------------------------------------


def test_exact_groups_brute_force(spark):
    rng = random.Random(4)
    bodies = ["", "a", "ab" * 40, "ab" * 40 + "x", "ab" * 700, "ab" * 699 + "ac", "é" * 90, LONG]
    rows = [(i, rng.choice(bodies)) for i in range(300)] + [(5000, "alone")]
    got = {r.doc_id: r for r in exact_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        same = [j for j, u in rows if u == t]
        assert (got[i].keep_id, got[i].group_size, got[i].kept) == (max(same), len(same), i == max(same))


def test_repeated_rows_keep_one(spark):
    docs = spark.createDataFrame([(1, "t"), (1, "t"), (None, "t")], "doc_id long, text string")
    rows = exact_groups(docs).collect()
    assert [r.keep_id for r in rows] == [1, 1, 1]
    assert sorted((r.doc_id, r.kept) for r in rows if r.doc_id) == [(1, False), (1, True)]


# ---- mixing -------------------------------------------------------------------------------


def test_mix_reaches_targets_and_agrees(spark):
    rng = random.Random(2)
    rows = [(i, f"s{i % 7}", " ".join("w" for _ in range(rng.randint(0, 60 if i % 7 else 400)))) for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = mix(docs).toPandas()
    again = mix(docs.repartition(5)).toPandas().sort_values("doc_id")
    assert got.sort_values("doc_id").mix_repeats.tolist() == again.mix_repeats.tolist()
    got["taken"] = got.mix_size * got.mix_repeats
    by = got.groupby("source").agg(taken=("taken", "sum"), size=("mix_source_size", "max"), target=("mix_target", "max"))
    assert (abs(by.taken - by.target) <= 60 + 400).all() and (by.target <= 2 * by["size"] + 1e-6).all()
    assert abs(by.target.sum() - 1.5 * by["size"].sum()) < 1e-6
    assert got.mix_repeats.max() <= 2
    assert mixed_documents(docs).count() == got.mix_repeats.sum()


# ---- tokens -------------------------------------------------------------------------------


def test_automaton_counts_greedy_pieces():
    pieces = read_pieces(q.BYTE_PIECES)[:20000]
    known, automaton, rng = set(pieces) | {bytes([b]) for b in range(256)}, Automaton(pieces), random.Random(1)
    most = max(map(len, known))
    for _ in range(600):
        data = "".join(rng.choice("theaniongdé 1-") for _ in range(rng.randint(0, 30))).encode()
        at = count = 0
        while at < len(data):
            at += next(n for n in range(min(most, len(data) - at), 0, -1) if data[at : at + n] in known)
            count += 1
        assert automaton.count(data) == count


def library(texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(q.WORD_BPE)
    return tokenizer, [e.ids for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_bpe_equals_library(spark, odd, texts):
    rng = random.Random(3)
    parts = ["'s", "'re", "'", "<|endoftext|>", "<|", "\x1c", "\xa0", "​", "́", "é", "Σ", "İ", "ß", "aaa", "Th",
             " ", "\n", "!!", "😀", "½", "中", "\x00", "ǅ", "word,", "W$$$"]
    made = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(1500)]
    tokenizer, expected = library([*texts, *made, *ODD])
    bpe = Bpe(q.WORD_BPE)
    cache = ChunkCache(bpe.cut, lambda p: bpe.merge([x.encode() for x in p]), chunks=3000, pieces=2000)
    for text, ids in zip([*texts, *made, *ODD], expected, strict=True):
        flat, counts = cache.encode([text or ""])
        assert flat.tolist() == ids and counts.tolist() == [len(ids)]
        assert bpe.decode(ids) == tokenizer.decode(ids, skip_special_tokens=False)
    rows = {r.doc_id: r for r in encode_documents(odd, q.WORD_BPE).collect()}
    _, ids = library(ODD)
    for i, own in enumerate(ids):
        assert rows[i].ids == own and rows[i].decoded == tokenizer.decode(own, skip_special_tokens=False)


def test_huffman_codes_round_trip():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 500, 40000):
        lengths = code_lengths(rng.zipf(1.3, n).clip(0, 10**9))
        assert lengths.max() <= 16 and (n == 1 or abs((0.5 ** lengths[lengths > 0]).sum() - 1) < 1e-12)
    codes, table = canonical_codes(lengths), decode_table(lengths)
    counts = np.array([0, 1, 127, 128, 129, 1000, 30000, 0, 1])
    ids = rng.integers(0, n, counts.sum())
    payload, first, owner, points = pack(ids, counts, lengths, codes)
    assert (unpack(payload, counts, points + 8 * first[owner], table) == ids).all()


def test_length_limit_is_optimal_on_small_codes():
    counts = np.array([1, 1, 2, 3, 5, 8, 13, 21])

    def best(limit):  # all non-increasing length vectors that satisfy Kraft's inequality
        from itertools import combinations_with_replacement

        ok = [c for c in combinations_with_replacement(range(1, limit + 1), 8) if sum(0.5**x for x in c) <= 1]
        return min(sum(a * b for a, b in zip(sorted(counts, reverse=True), c, strict=True)) for c in ok)

    for limit in (3, 4, 5, 7):
        assert (code_lengths(counts, limit) * counts).sum() == best(limit)


def test_token_files_round_trip(spark, texts):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    path = new_folder(spark)
    write_token_files(docs, path, q.WORD_BPE, end_id=1, file_ids=20_000, block_ids=4_000)
    rows = read_token_files(spark, path).orderBy("doc_id").collect()
    _, expected = library(texts)
    start = 0
    for row, ids in zip(rows, expected, strict=True):
        assert row.ids == [*ids, 1] and row.start == start and row.n_tokens == len(ids) + 1
        start += row.n_tokens
    crc = {r.doc_id: r.ids_crc32 for r in read_token_files(spark, path, digests=True).collect()}
    assert crc[rows[3].doc_id] == zlib.crc32(np.array(rows[3].ids, "<u4").tobytes())
    assert spark.read.parquet(f"{path}/blocks").select("file").distinct().count() > 3


# ---- quality and toxicity -----------------------------------------------------------------


def test_quality_bands_brute_force(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts[:80] + ODD)), "doc_id long, text string")
    for row, text in zip(quality_bands(docs).orderBy("doc_id").collect(), texts[:80] + ODD, strict=True):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        windows = list(zip(words, words[1:], words[2:], strict=False))
        hit = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)} if len(words) < 800 else None
        assert (row.n_words, row.word_chars) == (len(words), sum(map(len, words)))
        assert hit is None or row.n_repeat_words == len(hit)
        lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert row.n_dup_lines == sum(x in lines[:i] for i, x in enumerate(lines))
        assert row.n_symbols == len(re.findall(r"[#*$%&|<>]", text or ""))
        assert row.base_failed == (len(words) < 50 or 100 * row.n_repeat_words > 50 * len(words))
    assert repeat_words("a b c a b c".split()) == 6 and repeat_words([]) == 0
    noise = "".join(random.Random(1).choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/", k=9000))
    noise = " ".join(noise[i : i + 60] for i in range(0, 9000, 60))
    two = quality_bands(spark.createDataFrame([(1, noise), (2, " ".join(texts[5].split()))], "doc_id long, text string"))
    assert not two.where("doc_id = 1").first().base_failed and two.where("doc_id = 1").first().zstd_ratio < 1.35


@pytest.fixture(scope="module")
def clean(spark):
    """Texts of sf0.1 labelled as clean, as bytes."""
    folder = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{folder}/labels.parquet").where("quality = 1").select("doc_id")
    rows = spark.read.parquet(f"{folder}/documents.parquet").join(labels, "doc_id").orderBy("doc_id").collect()
    return [r.text.encode() for r in rows]


def noise_words(rng, letters, size, width=0):
    words = []
    while sum(map(len, words)) + len(words) <= size:
        words.append("".join(rng.choices(letters, k=width or rng.randint(2, 10))))
    return " ".join(words)[:size].encode()


BASE64 = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/"


def test_lower_limits_reject_noise_and_keep_clean_texts(clean):
    compressor, rng = zstandard.ZstdCompressor(level=LEVEL), random.Random(5)
    good = lambda data: compression_verdict(data, compressor)[2]
    prose = b" ".join(t for t in clean if 2000 < len(t) < 9000)
    assert good(prose[:40_000]) and all(map(good, clean))
    for size in (400, 700, 1500, 4000, 8000, 20_000, 60_000):
        assert not any(good(noise_words(rng, BASE64, size, width)) for width in (0, 8, 60))
    for size in (2500, 4000, 8000, 20_000, 60_000):
        assert not good(noise_words(rng, BASE64[:26], size))
    for size in (1000, 2000, 4000, 10_000, 20_000):
        half = prose[:size] + b" " + noise_words(rng, BASE64, size, 8)
        assert not good(half)
    _, share, verdict = compression_verdict(prose[:20_480] + noise_words(rng, BASE64, 20_480, 60), compressor)
    assert share == 0.5 and not verdict


def test_bytes_after_the_last_full_chunk_count(clean):
    compressor, rng = zstandard.ZstdCompressor(level=LEVEL), random.Random(6)
    prose = b" ".join(t for t in clean if 2000 < len(t) < 9000)
    passage = prose[50_000:50_060]
    for tail in ((passage * 32)[:1904], noise_words(rng, BASE64, 1904, 8)):
        for data in (prose[:4096] + tail, tail + prose[:4096]):
            ratio, share, verdict = compression_verdict(data, compressor)
            assert share > 0.3 and not verdict
    for size in (0, 700, 1904, 3900):
        assert compression_verdict(prose[: 8192 + size], compressor)[1:] == (0.0, True)
    # a short bad tail counts with its own bytes
    assert compression_verdict(prose[:8192] + passage * 20, compressor)[1:] == (1200 / 9392, True)


def test_other_scripts_have_wide_limits():
    compressor, rng = zstandard.ZstdCompressor(level=LEVEL), random.Random(5)
    signs = [chr(0x4E00 + rng.randrange(2000)) for _ in range(2500)]
    ratio, _, verdict = compression_verdict("".join(signs).encode(), compressor)
    assert 1.35 < ratio < 1.9 and verdict


@pytest.mark.parametrize("kind", ["quality", "toxic"])
def test_held_out_accuracy(spark, kind):
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    scores = quality_scores(docs, labels) if kind == "quality" else toxicity_scores(docs, labels)
    rows = scores.join(labels, "doc_id").where("held_out").toPandas()
    assert len(rows) > 500 and (rows.predicted == rows[kind]).mean() > 0.96
    assert rows.score.between(0, 1).all()
    assert (rows.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 5) == 0).all()


def test_samples_are_bounded_by_rows(spark, monkeypatch):
    """Null and repeated ids on two thirds of the rows: what comes to the driver stays small."""
    rows = [(i if i % 3 == 0 else None if i % 3 == 1 else 3, f"write to a{i}@b{i}.org or c{i}") for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert len(training_windows(docs, 100)) <= 150
    sizes, collect = [], type(docs).toPandas
    monkeypatch.setattr(type(docs), "toPandas", lambda self: sizes.append(len(found := collect(self))) or found)
    few = spark.createDataFrame([(3, 1), (6, 0), (9, 1)], "doc_id long, y int")
    trained(statistics(docs), few)
    assert len(_feature_rows(docs.join(few, "doc_id", "left_semi"))) == 3
    assert sizes == [3, 3]


# ---- near duplicates ----------------------------------------------------------------------


def test_signature_is_superminhash():
    slots = 24
    for seed, n in enumerate((1, 2, 9, 200)):
        items = np.unique(np.random.default_rng(seed).integers(0, 2**63, n).astype(np.uint64))
        expected = [2**64 - 1] * slots
        for item in items.tolist():
            order = list(range(slots))
            for j in range(slots):
                x = int(mixed(np.array([(item + (j + 1) * 0x9E3779B97F4A7C15) % 2**64], np.uint64))[0])
                k = j + ((x >> 40) * (slots - j) >> 24)
                order[j], order[k] = order[k], order[j]
                expected[order[j]] = min(expected[order[j]], (x & (1 << 40) - 1) | j << 40)
        assert signatures([items], slots)[0].tolist() == expected


def test_near_copies_brute_force(spark):
    """A cluster around the threshold: no link between components may be missed."""
    rng = random.Random(8)
    base = [f"w{rng.randrange(400)}" for _ in range(220)]
    rows = []
    for i in range(150):
        words = list(base)
        for _ in range(rng.randint(0, 16)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
        rows.append((i * 3 + 1, " ".join(words)))
    rows += [(1000, "short one"), (1001, "short one"), (1002, ""), (1003, None), (1004, rows[0][1].upper())]
    got = {r.doc_id: r for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=4).collect()}
    sets = {}
    for i, t in rows:
        words = (t or "").lower().split()
        sets[i] = {tuple(words[k : k + 4]) for k in range(max(len(words) - 3, 1))} if words else set()
    name = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                low, high = sorted((name[a], name[b]))
                name = {k: low if v == high else v for k, v in name.items()}
    assert len(set(name.values())) > 20
    for i in sets:
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (len(sets[i]), name[i], name[i] == i)


def test_rows_that_share_an_id_are_one_node(spark):
    docs = spark.createDataFrame([(1, "a b c d e"), (1, "v w x y z"), (2, "a b c d e"), (3, "v w x y z")], "doc_id long, text string")
    assert {r.component_id for r in near_duplicates(docs).collect()} == {1}


def plain_components(rows, width, percent=80):
    """Smallest id reachable, by comparing all pairs; rows of one id are one node."""
    sets = []
    for i, t in rows:
        words = (t or "").lower().split()
        sets.append((i, {tuple(words[k : k + width]) for k in range(max(len(words) - width + 1, 1))} if words else set()))
    name = {i: i for i, _ in rows}
    for k, (a, x) in enumerate(sets):
        for b, y in sets[:k]:
            if x and y and name[a] != name[b] and 100 * len(x & y) >= percent * len(x | y):
                low, high = sorted((name[a], name[b]))
                name = {i: low if v == high else v for i, v in name.items()}
    return name


@pytest.mark.parametrize("seed,percent", [(1, 80), (2, 80), (3, 65)])
def test_no_link_between_copies_of_copies_is_lost(spark, seed, percent):
    """Copies of copies with shared, added and removed words, of several bases and sizes."""
    rng = random.Random(seed)
    pool = []
    for _ in range(3):
        pool.append([f"w{rng.randrange(300)}" for _ in range(rng.choice([60, 150, 160]))])
    rows = []
    for i in range(220):
        words = list(rng.choice(pool))
        for _ in range(rng.choice([0, 1, 2, 3, 5, 9])):
            k = rng.randrange(len(words))
            words[k : k + rng.choice([0, 1, 1, 1, 6])] = [f"x{rng.randrange(30)}" for _ in range(rng.choice([0, 1, 1, 1, 5]))]
        if rng.random() < 0.3:
            pool.append(words)
        rows.append((rng.randrange(10**6) if rng.random() < 0.97 else rows[0][0] if rows else 1, " ".join(words)))
    name = plain_components(rows, 4, percent)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_duplicates(docs, width=4, percent=percent).collect()}
    assert len(set(name.values())) > 8
    assert got == name


def test_all_texts_of_a_shared_id_are_compared(spark):
    a, b = (" ".join(f"{c}{k}" for k in range(40)) for c in "ab")
    rows = [(1, a), (1, b), (2, a + " more"), (3, b + " more"), (9, b + " more"), (9, "else"), (4, "else")]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(i, 1) for i in (1, 2, 3, 9, 4)}


# ---- personal data ------------------------------------------------------------------------


def test_base_spans_brute_force(texts):
    def brute(text):
        out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
        for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
            if all(int(p) <= 255 for p in m.group().split(".")):
                out.append((m.start(), 1, m.end()))
        for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
            digits = re.sub("[^0-9]", "", m.group())
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
            if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
                out.append((m.start(), 3, m.end()))
        return sorted(out)

    rng = random.Random(6)
    parts = ["1", "22", "255", "256", "00", "@", ".", "a", "b.c", "-", "+", " ", "(", ")", "é", "\n", "4111 1111 1111 1111", "١"]
    made = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(4000)]
    assert all(base_spans(t) == brute(t) for t in [*made, *texts, *(t or "" for t in ODD)])


def test_field_adds_what_patterns_miss(spark, texts):
    rows = find_pii(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()
    digests = {r.doc_id: r.base_sha256 for r in rows}
    own = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    for i, text in own.items():
        joined = ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in base_spans(text))
        assert digests[i] == hashlib.sha256(joined.encode()).hexdigest()
    field = train([f"see {i} jo.{i:02}@mail{i}.example.com and +1 (55{i % 10}) 555-{1000 + i} there 40{i:02}" for i in range(60)])
    base, added = all_spans("call (555) 123-4567 now, or jane(at)mail.example.org of 2004, 3.5", field)
    assert not base and {KINDS[k] for _, k, _ in added} >= {"phone"}
    assert all_spans("in 2004 there were 12 of 30", field) == ([], [])


# ---- words and pipeline -------------------------------------------------------------------


def test_words(texts):
    for text in [*texts, *(t or "" for t in ODD), "a\x1cb c\x85d　e"]:
        assert words_of(text) == re.findall(r"[^\x20\x09-\x0D]+", text)


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, SF_DIR)
        assert docs.columns == columns
        assert docs.join(before, "doc_id", "left_anti").count() == 0
    mixed_ids = sorted(r.doc_id for r in docs.select("doc_id").collect())
    final = corpus_pipeline.run(spark, SF_DIR)
    assert sorted(r.doc_id for r in final.select("doc_id").collect()) == mixed_ids
    assert final.where(F.size("ids") != F.col("n_tokens")).count() == 0
