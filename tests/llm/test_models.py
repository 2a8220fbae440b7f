"""Models against enumeration, differences and slow solvers; the pipeline against a plain program."""

import hashlib
import math
import random
import re
import time
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lorekeep.llm import pii, rule_ensemble, toxicity
from lorekeep.llm.bpe import Bpe
from lorekeep.llm.mixing import MADE, mix, mixed_documents
from lorekeep.llm.queries import WORD_BPE
from tests.llm.test_llm import plain_components

# ---- semi-Markov field --------------------------------------------------------------------


def segmentations(n, found, at=0):
    """All ways to cut chunks ``at`` .. n into outside chunks and candidates with a kind."""
    if at == n:
        yield []
        return
    for rest in segmentations(n, found, at + 1):
        yield [None, *rest]
    for c in found:
        if c.first == at:
            for rest in segmentations(n, found, c.last + 1):
                for kind in range(pii.OUTSIDE):
                    yield [(c, kind), *rest]


def total(field, parts):
    score, before = 0.0, pii.OUTSIDE
    for part in parts:
        kind = pii.OUTSIDE if part is None else part[1]
        score += field.steps[before, kind] + (0 if part is None else field.spans[list(part[0].features), kind].sum())
        before = kind
    return score


def random_field(seed):
    rng = np.random.default_rng(seed)
    field = pii.new_field()
    field.spans[:] = rng.normal(size=field.spans.shape)
    field.steps[:] = rng.normal(size=field.steps.shape)
    return field


def small_window(seed):
    rng = random.Random(seed)
    text = " ".join(rng.choice(["call", "12", "+1", "a@b.co", "x", "555-1234", "key=abc"]) for _ in range(4))
    return pii.candidates(text, 0, len(text))


@pytest.mark.parametrize("seed", range(6))
def test_best_spans_are_best_of_all_segmentations(seed):
    n, found = small_window(seed)
    field = random_field(seed)
    best = max(segmentations(n, found), key=lambda parts: total(field, parts))
    assert pii.best_spans(n, found, field) == [(c.start, kind, c.end) for c, kind in filter(None, best)]


@pytest.mark.parametrize("seed", range(3))
def test_learning_follows_the_likelihood(seed):
    n, found = small_window(seed + 20)
    found = found[:5]
    field = random_field(seed)
    ways = list(segmentations(n, found))
    gold_way = random.Random(seed).choice(ways)
    gold = {(c.first, c.last): kind for c, kind in filter(None, gold_way)}

    def likelihood(f):
        scores = np.array([total(f, w) for w in ways])
        return total(f, gold_way) - scores.max() - math.log(np.exp(scores - scores.max()).sum())

    moved = pii.Field(field.spans.copy(), field.steps.copy())
    pii.learn(moved, n, found, gold, 1.0)
    used = {f for c in found for f in c.features}
    for table, step, extra in (("spans", moved.spans - field.spans, 0), ("steps", moved.steps - field.steps, pii.RIDGE)):
        for i in range(step.shape[0]):
            if table == "spans" and i not in used:
                assert not step[i].any()
                continue
            for k in range(step.shape[1]):
                up, down = (pii.Field(field.spans.copy(), field.steps.copy()) for _ in range(2))
                getattr(up, table)[i, k] += 1e-5
                getattr(down, table)[i, k] -= 1e-5
                slope = (likelihood(up) - likelihood(down)) / 2e-5 - extra * getattr(field, table)[i, k]
                assert abs(step[i, k] - slope) < 1e-6


def test_addresses_by_the_plain_pattern():
    plain = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    rng = random.Random(3)
    for _ in range(4000):
        text = "".join(rng.choice("ab1@@@..-_% é") for _ in range(rng.randrange(25)))
        assert list(pii._emails(text)) == [m.span() for m in plain.finditer(text)], text


def test_very_long_texts_take_linear_time():
    field = random_field(1)
    for text in ("a" * 10**6 + "@", "a@" * 500_000, "7" * 10**6, "a.b@c.d" * 140_000, "+1 (" * 250_000, "12 345 " * 30_000):
        started = time.process_time()
        pii.all_spans(text, field)
        assert time.process_time() - started < 60, text[:10]


# ---- mixing -------------------------------------------------------------------------------


def test_mix_takes_any_column_names_and_spreads_null_ids(spark):
    rng = random.Random(4)
    rows = [(None, "s", " ".join(rng.choice("abc") for _ in range(30)) + f" {i}", i, i) for i in range(900)]
    rows += [(i, "t", "w " * 20, i, i) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, mix_target long, _mix_size long")
    found = mix(docs)
    assert found.columns == ["doc_id", "source", "text", "_mix_size", *MADE]
    sums = {r.source: r for r in found.groupBy("source").agg(
        F.sum(F.col("mix_size") * F.col("mix_repeats")).alias("taken"), F.max("mix_target").alias("target")
    ).collect()}
    assert all(abs(r.taken - r.target) <= 60 for r in sums.values())
    copies = mixed_documents(docs)
    assert copies.columns == docs.columns and copies.count() == found.agg(F.sum("mix_repeats")).first()[0]


# ---- rules --------------------------------------------------------------------------------


def test_grown_tree_takes_the_best_cut():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 12, (60, 3)).astype(float)
    y = (x[:, 1] + rng.normal(size=60) > 6).astype(float)
    rules = rule_ensemble.grow(x, y, np.arange(3), 1)

    def spread(part):
        return ((part - part.mean()) ** 2).sum()

    costs = {}
    for f in range(3):
        for cut in np.unique(np.quantile(x[:, f], np.linspace(0, 1, rule_ensemble.CUTS + 2)[1:-1])):
            above = x[:, f] > cut
            if 5 <= above.sum() <= 55:
                costs[f, float(cut)] = spread(y[above]) + spread(y[~above])
    (f, greater, cut), = rules[0].terms
    assert not greater and math.isclose(costs[f, cut], min(costs.values()))
    assert rules[1].terms == ((f, True, cut),)
    for rule in rule_ensemble.grow(x, y, np.arange(3), 3):
        assert 1 <= len(rule.terms) <= 3 and rule_ensemble.applies(rule, x).any()


def test_lasso_matches_coordinate_descent():
    rng = np.random.default_rng(3)
    r = (rng.random((200, 6)) < 0.4).astype(float)
    y = (r[:, 0] - r[:, 2] + rng.normal(size=200) * 0.7 > 0.1).astype(float)
    penalty = 0.02
    base, w = rule_ensemble.lasso_logistic(r, y, penalty, rounds=4000)
    b, v = 0.0, np.zeros(6)
    for _ in range(3000):
        b -= 4 * (1 / (1 + np.exp(-(b + r @ v))) - y).mean()
        for j in range(6):
            slope = (r[:, j] * (1 / (1 + np.exp(-(b + r @ v))) - y)).mean()
            bound = max((r[:, j] ** 2).mean() / 4, 1e-9)
            u = v[j] - slope / bound
            v[j] = math.copysign(max(abs(u) - penalty / bound, 0), u)
    assert np.allclose(w, v, atol=1e-3) and abs(base - b) < 1e-3 and (v == 0).any()


def test_compiled_score_is_the_sum_of_rules(spark):
    rng = np.random.default_rng(4)
    x = rng.integers(0, 4, (300, len(rule_ensemble.STATISTICS))).astype(float)
    y = (x[:, 0] * x[:, 3] > 2).astype(int)
    model = rule_ensemble.fit(x, y)
    assert len(model.rules) > 3 and max(len(r.terms) for _, r in model.rules) > 1
    margin = model.base + sum(weight * rule_ensemble.applies(rule, x) for weight, rule in model.rules)
    df = spark.createDataFrame([(i, *map(float, row)) for i, row in enumerate(x)], ["i", *rule_ensemble.STATISTICS])
    got = [r.s for r in df.select("i", rule_ensemble.compiled(model).alias("s")).orderBy("i").collect()]
    assert np.allclose(got, 1 / (1 + np.exp(-margin)))


# ---- positive and unlabelled --------------------------------------------------------------


@pytest.mark.parametrize("prior,every,goes_negative", [(0.05, 4, False), (0.2, 10, True)])
def test_fit_descends_the_non_negative_risk(monkeypatch, prior, every, goes_negative):
    """The same steps by differences of the risk as stated, with the clean part kept from below zero."""
    monkeypatch.setattr(toxicity, "ROUNDS", 120)
    monkeypatch.setattr(toxicity, "BUCKETS", 64)
    buckets = {}

    def row(words, length):
        ids = sorted({buckets.setdefault(w, len(buckets)) for w in words})
        return toxicity.Features(np.array(ids), np.ones(len(ids)), length)

    rng = random.Random(1)
    toxic = [row(["bad", rng.choice("abc")], 1.0) for _ in range(40)]
    mixed = [row([rng.choice("abcd"), rng.choice("xyz"), *(["bad"] if k % every == 0 else [])], rng.random()) for k in range(120)]
    model = toxicity.fit(toxic, mixed, prior)
    used = np.flatnonzero(model.weights)
    assert used.tolist() == [buckets["bad"]]

    def margins(theta, rows):
        return np.array([theta[0] * (buckets["bad"] in r.buckets) + theta[1] * r.length + theta[2] for r in rows])

    def clean(theta):
        return np.logaddexp(0, margins(theta, mixed)).mean() - prior * np.logaddexp(0, margins(theta, toxic)).mean()

    def whole(theta):
        return prior * np.logaddexp(0, -margins(theta, toxic)).mean() + clean(theta)

    theta = np.array([0.0, 0.0, math.log(prior / (1 - prior))])
    first, second, negative = np.zeros(3), np.zeros(3), 0
    for turn in range(1, 121):
        below = clean(theta) < 0
        negative += below
        risk, sign = (clean, -1) if below else (whole, 1)
        step = np.array([(risk(theta + e) - risk(theta - e)) / 2e-5 for e in np.eye(3) * 1e-5]) * sign
        step[:1] += toxicity.RIDGE * theta[:1]
        first, second = 0.9 * first + 0.1 * step, 0.999 * second + 0.001 * step**2
        theta = theta - toxicity.RATE * (first / (1 - 0.9**turn)) / (np.sqrt(second / (1 - 0.999**turn)) + 1e-8)
    assert bool(negative) == goes_negative
    assert np.allclose([model.weights[used[0]], model.length, model.bias], theta, atol=2e-3)


# ---- pipeline -----------------------------------------------------------------------------


def test_stages_match_a_plain_program(spark, tmp_path):
    """Exact, near and clean documents through stages 2 to 5; stage 1 has tests of its own."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8)))
    clean = [" ".join(word() for _ in range(rng.randrange(30, 90))) for _ in range(60)]
    texts = list(clean)
    texts += [clean[0]] * 7 + [clean[1]] * 3 + [None, "", "short text", "short text"]
    for t in clean[:10]:
        words = t.split()
        words[rng.randrange(len(words))] = "changed"
        texts.append(" ".join([*words, "tail"]))
    rng.shuffle(texts)
    rows = [(i, t, "en", f"s{i % 4}", len(t or "")) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")

    got = docs
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality classifier", "exact dedup", "near dedup", "source mixing", "bpe encoding"]

    got = stages["exact dedup"](spark, docs, str(tmp_path))
    last = {t or "": i for i, t, *_ in rows}
    kept = [r for r in rows if last[r[1] or ""] == r[0]]
    assert sorted(map(tuple, got.collect())) == sorted(kept)

    got = stages["near dedup"](spark, got, str(tmp_path))
    name = plain_components([r[:2] for r in kept], 5)
    alone = [r for r in kept if name[r[0]] == r[0]]
    assert len(alone) < len(kept) - 5
    assert sorted(map(tuple, got.collect())) == sorted(alone)

    got = stages["source mixing"](spark, got, str(tmp_path))
    copies = defaultdict(int)
    for r in got.collect():
        copies[tuple(r)] += 1
    assert sorted({k: v for k, v in copies.items()}.items()) == sorted(plain_mix(alone).items())

    found = stages["bpe encoding"](spark, got, str(tmp_path)).collect()
    bpe = Bpe(WORD_BPE)
    assert len(found) == sum(copies.values())
    by_id = {r[0]: r[1] or "" for r in alone}
    from tokenizers import Tokenizer

    theirs = Tokenizer.from_file(WORD_BPE)
    for r in found:
        ids = theirs.encode(by_id[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids, r.decoded) == (len(ids), ids, bpe.decode(ids))
        assert r.decoded == theirs.decode(ids, skip_special_tokens=False)


def plain_mix(rows):
    """How often each row is taken: targets clamped at twice a source's size, then a seeded sample in order of a hash."""
    size = {r[0]: len((r[1] or "").split()) for r in rows}
    sources = sorted({r[3] for r in rows})
    totals = {s: sum(size[r[0]] for r in rows if r[3] == s) for s in sources}
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(sources)}
    full, budget = set(), 1.5 * sum(totals.values())
    while True:
        level = (budget - sum(2 * totals[s] for s in full)) / sum(weight[s] for s in sources if s not in full)
        new = {s for s in sources if s not in full and weight[s] * level > 2 * totals[s]}
        if not new:
            break
        full |= new
    out = {}
    for s in sources:
        target = 2.0 * totals[s] if s in full else weight[s] * level
        whole = math.floor(target / totals[s]) if totals[s] else 0
        need, sums = target - whole * totals[s], defaultdict(int)
        cell = {r[0]: hashlib.md5(f"7:{r[0]}".encode()).hexdigest()[:6] for r in rows if r[3] == s}
        for i, c in cell.items():
            sums[c] += size[i]
        before, chosen = 0, set()
        for c in sorted(sums):
            if before + sums[c] <= need or (before < need and before + sums[c] - need <= need - before):
                chosen.add(c)
            if before + sums[c] >= need:
                break
            before += sums[c]
        for r in rows:
            n = whole + (cell[r[0]] in chosen) if r[3] == s else 0
            if n:
                out[r] = n
    return out
