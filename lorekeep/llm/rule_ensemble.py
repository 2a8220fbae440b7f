"""Quality classifier: a sparse ensemble of rules over text statistics.

Statistics are Spark column expressions. Shallow trees are grown on a bounded sample of labelled
rows; every path from a root becomes a conjunctive rule; a logistic model with an L1 penalty gives
most rules the weight 0; the others are compiled into one Spark column expression, so scoring needs
no Python at all.

The sample has about ``SAMPLE`` labelled rows at most, drawn by a hash of the id; with fewer
labels all are used. Rows that share an id count once, by their least statistics. Held-out rows (crc32 of the id modulo 5 is 0) never take part.

Defined cases: null is the empty text, whose statistics are 0 and whose score is the model's for
them; labels of ids that don't occur, null labels and null ids are ignored; repeated rows give
equal rows; without labels of both kinds, or without a rule, the score is the share of label 1 (0.5 without any); an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.common import settle, text_of

SAMPLE = 8000
TREES, DEPTH, CUTS = 40, 3, 24
PENALTY = 0.002
FOLDS = 5
SEED = 11
THRESHOLD = 0.3


class Rule(NamedTuple):
    """Conjunction of (statistic, is greater, threshold)."""

    terms: tuple[tuple[int, bool, float], ...]


class Model(NamedTuple):
    base: float
    rules: list[tuple[float, Rule]]


# ---- statistics ---------------------------------------------------------------------------

STATISTICS = [
    "log_words", "word_length", "symbols", "exclaims", "stops", "upper", "digits", "line_words", "repeated_lines",
    "new_words",
]


def held_out(doc_id: str | Column) -> Column:
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(column.cast("string")) % FOLDS == 0, F.lit(False))


def statistics(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id and one double per name in ``STATISTICS``."""
    return with_statistics(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("_body")), "_body").drop(
        "_body"
    )


def with_statistics(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` and one double per name in ``STATISTICS``; no column of ``docs`` has such a name."""
    rows = docs.select(*docs.columns, text_of(text).alias("_t")).select(
        *docs.columns, "_t",
        F.expr(r"filter(split(_t, '[\\x20\\x09-\\x0D]+'), x -> x <> '')").alias("_w"),
        F.expr(r"filter(split(_t, '\n'), x -> x rlike '[^\\x20\\x09-\\x0D]')").alias("_l"),
    )
    n, chars, lines = F.size("_w"), F.length("_t"), F.size("_l")
    some, per_word = F.greatest(n, F.lit(1)), lambda x: x / F.greatest(n, F.lit(1))
    count = lambda pattern: F.regexp_count("_t", F.lit(pattern))
    per_char = lambda x: x / F.greatest(chars, F.lit(1))
    made = {
        "log_words": F.log1p(n), "word_length": per_word(F.expr("aggregate(_w, 0, (a, x) -> a + length(x))")),
        "symbols": per_word(count("[#*$%&|<>]")), "exclaims": per_word(count("!")), "stops": per_word(count("[.,;:]")),
        "upper": per_char(count(r"\p{Lu}")), "digits": per_char(count("[0-9]")),
        "line_words": F.log1p(n / F.greatest(lines, F.lit(1))),
        "repeated_lines": 1 - F.size(F.array_distinct("_l")) / F.greatest(lines, F.lit(1)),
        "new_words": F.when(n > 0, F.size(F.array_distinct("_w")) / some).otherwise(0),
    }
    return rows.select(*docs.columns, *[F.round(made[s].cast("double"), 6).alias(s) for s in STATISTICS])


# ---- fitting ------------------------------------------------------------------------------


def grow(x: np.ndarray, y: np.ndarray, features: np.ndarray, depth: int) -> list[Rule]:
    """Rules for all nodes below the root of a tree that splits by squared error."""
    found: list[Rule] = []

    def split(rows: np.ndarray, terms: tuple) -> None:
        if len(terms) == depth or len(rows) < 20 or y[rows].min() == y[rows].max():
            return
        best = (1e-9, -1, 0.0)
        for f in features:
            values = x[rows, f]
            cuts = np.unique(np.quantile(values, np.linspace(0, 1, CUTS + 2)[1:-1]))
            above = values[None, :] > cuts[:, None]
            n = above.sum(axis=1)
            good = (n >= 5) & (n <= len(rows) - 5)
            if not good.any():
                continue
            ones, total = above @ y[rows], y[rows].sum()
            gain = np.where(good, ones**2 / np.maximum(n, 1) + (total - ones) ** 2 / np.maximum(len(rows) - n, 1), 0)
            gain -= total**2 / len(rows)
            at = int(np.argmax(np.where(good, gain, -1)))
            if gain[at] > best[0]:
                best = (float(gain[at]), int(f), float(cuts[at]))
        if best[1] < 0:
            return
        _, f, cut = best
        for greater in (False, True):
            new = (*terms, (f, greater, cut))
            found.append(Rule(new))
            split(rows[(x[rows, f] > cut) == greater], new)

    split(np.arange(len(x)), ())
    return found


def applies(rule: Rule, x: np.ndarray) -> np.ndarray:
    return np.logical_and.reduce([(x[:, f] > cut) == greater for f, greater, cut in rule.terms])


def lasso_logistic(r: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 600) -> tuple[float, np.ndarray]:
    """Accelerated proximal gradient; the base has no penalty."""
    n, k = r.shape
    step = 4.0 / (np.linalg.norm(r, 2) ** 2 / n + 1.0)
    base, w = float(np.log(y.mean() / (1 - y.mean()))), np.zeros(k)
    b_at, w_at, t = base, w, 1.0
    for _ in range(rounds):
        error = 1 / (1 + np.exp(-(b_at + r @ w_at))) - y
        new_b = b_at - step * error.mean()
        new_w = w_at - step * (r.T @ error) / n
        new_w = np.sign(new_w) * np.maximum(np.abs(new_w) - step * penalty, 0)
        new_t = (1 + np.sqrt(1 + 4 * t * t)) / 2
        b_at, w_at = new_b + (t - 1) / new_t * (new_b - base), new_w + (t - 1) / new_t * (new_w - w)
        base, w, t = new_b, new_w, new_t
    return base, w


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """``x``: rows of statistics, ``y``: 0 or 1."""
    share = float(np.clip(y.mean(), 0.01, 0.99)) if len(y) else 0.5
    plain = Model(float(np.log(share / (1 - share))), [])
    if not len(y) or y.min() == y.max():
        return plain
    rng = np.random.default_rng(SEED)
    rules: dict[Rule, None] = {}
    wide = max(2, int(np.ceil(x.shape[1] / 2)))
    for _ in range(TREES):
        rows = rng.integers(0, len(x), len(x))
        features = rng.choice(x.shape[1], wide, replace=False)
        rules.update(dict.fromkeys(grow(x[rows], y[rows].astype(float), features, DEPTH)))
    columns: dict[bytes, tuple[Rule, np.ndarray]] = {}
    for rule in rules:
        hit = applies(rule, x)
        if 0 < hit.sum() < len(x):
            columns.setdefault(hit.tobytes(), (rule, hit))
    if not columns:
        return plain
    kept = [rule for rule, _ in columns.values()]
    base, w = lasso_logistic(np.array([h for _, h in columns.values()], float).T, y.astype(float), PENALTY)
    return Model(base, [(float(v), rule) for v, rule in zip(w, kept, strict=True) if abs(v) > 1e-6])


def compiled(model: Model) -> Column:
    """The score as a Spark expression over the statistics."""

    def term(f: int, greater: bool, cut: float) -> Column:
        column = F.col(STATISTICS[f])
        return column > cut if greater else column <= cut

    total = F.lit(model.base)
    for weight, rule in model.rules:
        hit = term(*rule.terms[0])
        for more in rule.terms[1:]:
            hit = hit & term(*more)
        total = total + F.when(hit, weight).otherwise(0.0)
    return 1 / (1 + F.exp(-total))


# ---- job ----------------------------------------------------------------------------------


def labelled_sample(labels: DataFrame, label: str, sample: int, label_id: str = "doc_id") -> DataFrame:
    """(doc_id, y) of about ``sample`` training rows at most, drawn by a hash of the id."""
    rows = labels.where(F.col(label).isNotNull() & F.col(label_id).isNotNull() & ~held_out(label_id)).select(
        F.col(label_id).cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")
    )
    n = rows.count()
    if n > sample:
        # 32 bits of the hash as a number from 0 to 1
        share = F.pmod(F.xxhash64("doc_id"), F.lit(2**32)) / float(2**32)
        rows = rows.where(share < sample / n)
    return rows.groupBy("doc_id").agg(F.max("y").alias("y"))


def trained(stats: DataFrame, chosen: DataFrame) -> Model:
    """The model of the rows of ``stats`` whose labels are in the bounded ``chosen``."""
    # at most the sample is broadcast and collected: rows that share an id become one before
    one = F.min(F.struct(*STATISTICS, "y")).alias("one")
    rows = stats.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(one).select("doc_id", "one.*")
    rows = rows.toPandas().sort_values("doc_id")
    return fit(rows[STATISTICS].to_numpy(float), rows["y"].to_numpy(int))


def quality_scores(
    docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "quality",
    sample: int = SAMPLE, threshold: float = THRESHOLD,
) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    stats = settle(statistics(docs, text, doc_id), "statistics")
    model = trained(stats, labelled_sample(labels, label, sample))
    return stats.select(
        "doc_id", held_out("doc_id").alias("held_out"), compiled(model).alias("score")
    ).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def quality_filter(
    docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "quality",
    sample: int = SAMPLE, threshold: float = THRESHOLD,
) -> DataFrame:
    """The rows that the classifier accepts, each by its own text, with the columns of ``docs``."""
    names = docs.columns
    safe = docs.toDF(*[f"_in{i}" for i in range(len(names))])
    own, body = f"_in{names.index(doc_id)}", f"_in{names.index(text)}"
    chosen = labelled_sample(labels, label, sample)
    drawn = safe.join(F.broadcast(chosen), safe[own].cast("long") == chosen["doc_id"], "left_semi")
    model = trained(statistics(drawn, body, own), chosen)
    # the filter would be pushed below the statistics, and they computed anew in every rule, but for a
    # column that is not deterministic
    rows = with_statistics(safe, body).withColumn("_row", F.monotonically_increasing_id())
    accepted = (compiled(model) >= threshold) & (F.col("_row") >= 0)
    return rows.where(accepted).select(*safe.columns).toDF(*names)
