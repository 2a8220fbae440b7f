"""Personal data by patterns and a semi-Markov conditional random field.

Patterns give the base spans. Around whatever may be personal data (digits, at signs, assignments,
spelled-out addresses) the text is cut into chunks at white space, and the field scores whole
candidate spans of up to ``MAX_CHUNKS`` chunks: how many digits, how grouped, checksum, shape of an
address, words before. A dynamic program over chunks chooses boundaries and types together; an
entity is bounded in chunks and characters, so it is linear in the text. Spans it finds beside the
base ones (a phone number without country code, a spelled-out address, a key) are added; base spans
always stay.

The field is trained by conditional likelihood on windows around base spans of a bounded sample of
documents (about ``SAMPLE`` at most; of more, drawn by a hash of the id, without null ids, and one text
of rows that share an id; of each the first ``WINDOWS`` windows of at most ``LONGEST`` characters): as
they are, in other common spellings, and with numbers that mean nothing.

Defined cases: null is the empty text and has no spans; texts are read whole; repeated rows give
equal rows; where no document of the sample has a base span nothing is learned and nothing added; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import random
import re
from functools import lru_cache
from itertools import islice
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.common import map_rows, text_of

KINDS = ["email", "ip", "card", "phone", "secret"]
SAMPLE = 2000
WINDOWS, LONGEST = 50, 1000
MAX_CHUNKS, MAX_CHARS = 7, 120
CONTEXT = 48
EPOCHS, RATE, RIDGE = 8, 0.5, 1e-4

Span = tuple[int, int, int]  # start, kind, end


# ---- base spans ---------------------------------------------------------------------------

_EMAIL_NAME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_EMAIL_HOST = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# runs of digits are taken whole: what follows a run decides
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str):
    """Spans of addresses. If any place of a run of name characters begins a match, its first one does."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _EMAIL_NAME:
            start -= 1
        host = _EMAIL_HOST.match(text, at + 1) if start < at else None
        # no name runs over an @, so no character is looked at twice
        done = host.end() if host else at + 1
        if host:
            yield start, done
        at = text.find("@", done)


def _short(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def base_spans(text: str) -> list[Span]:
    """Base spans in order of start, then kind."""
    found = [(a, 0, b) for a, b in _emails(text)]
    found += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(map(_short, m.group().split(".")))]
    for match in _CARD.finditer(text):
        digits = _digits(match.group())
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append((match.start(), 2, match.end()))
    if "+" in text:
        found += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m.group())) <= 15]
    return sorted(found)


# ---- candidate windows --------------------------------------------------------------------

_TRIGGER = re.compile(r"[0-9@=]+")
_SPELLED = (" dot ", "(at)", "[at]", "(dot)", "[dot]")
_CHUNK = re.compile(r"[^\x20\x09-\x0D]+")
_BLANKS = " \t\n\r\x0b\x0c"
_TRIM_LEFT, _TRIM_RIGHT = "\"'([{<,;:.!?", "\"')]}>,;:.!?"


def windows(text: str) -> list[tuple[int, int]]:
    """Stretches of text around whatever may be personal data, ending at white space."""
    marks = [m.span() for m in _TRIGGER.finditer(text)]
    for word in _SPELLED:
        at = text.find(word)
        while at >= 0:
            marks.append((at, at + len(word)))
            at = text.find(word, at + 1)
    marks.sort()
    joined: list[list[int]] = []
    for start, end in marks:
        start, end = max(0, start - CONTEXT), min(len(text), end + CONTEXT)
        if joined and start <= joined[-1][1]:
            joined[-1][1] = max(end, joined[-1][1])
        else:
            joined.append([start, end])
    out: list[tuple[int, int]] = []
    for start, end in joined:
        if out:
            start = max(start, out[-1][1])
        # a chunk is never cut: context that begins or ends inside one grows to its edge, up to a bound
        low = max(0, start - MAX_CHARS)
        start = max((text.rfind(b, low, start + 1) for b in _BLANKS), default=-1) + 1 or low
        match = _CHUNK.match(text, end, min(len(text), end + MAX_CHARS)) if end < len(text) else None
        end = match.end() if match else end
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


class Candidate(NamedTuple):
    first: int
    last: int
    start: int
    end: int
    features: tuple[int, ...]


NAMES: dict[str, int] = {}


def _feature(name: str) -> int:
    return NAMES.setdefault(name, len(NAMES))


_ADDRESS = re.compile(
    r"[\w.%+-]+(?:@|\s*[(\[]at[)\]]\s*| at )[\w-]+(?:(?:\.|\s*[(\[]dot[)\]]\s*| dot )[\w-]+)+", re.IGNORECASE
)
_QUAD = re.compile(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?::[0-9]+|/[0-9]+)?")
_PHONE_SHAPE = re.compile(r"(?:\+?[0-9]{1,3}[\x20.-]?)?(?:\([0-9]{2,4}\)|[0-9]{2,4})[\x20.-]?[0-9]{3,4}[\x20.-]?[0-9]{3,4}")
_CARD_SHAPE = re.compile(r"[0-9]{4}(?:[\x20.-]?[0-9]{4}){2}[\x20.-]?[0-9]{1,7}")
_KEY_SHAPE = re.compile(r"[A-Z]{3,5}[A-Z0-9]{12,}")
_SETTING = re.compile(r"(?:\w*(?:password|passwd|secret|token|key)\w*)\s*[=:]\s*[\"']?[^\s\"']{6,}[\"']?", re.IGNORECASE)
_DATE = re.compile(r"[0-9]{1,4}[-/.][0-9]{1,2}[-/.][0-9]{1,4}|[0-9]{1,2}:[0-9]{2}(?::[0-9]{2})?")
_NUMBER = re.compile(r"[+-]?(?:[0-9]{1,3}(?:,[0-9]{3})+|[0-9]+)(?:\.[0-9]+)?%?")
_HINTS = {
    "mail": ("email", "e-mail", "mail", "contact", "write"), "line": ("phone", "tel", "call", "mobile", "fax", "dial"),
    "pay": ("card", "visa", "credit", "account"), "host": ("ip", "host", "server", "address"),
    "login": ("password", "passwd", "secret", "token", "key"),
}
# every feature has its number before any text is seen, so that all tasks agree
_SHAPES = {
    "address": _ADDRESS, "quad": _QUAD, "phone": _PHONE_SHAPE, "card": _CARD_SHAPE, "key": _KEY_SHAPE,
    "setting": _SETTING, "date": _DATE, "number": _NUMBER,
}
for _name in [
    "one", *_SHAPES, "at", "plus", "bracket", "equals", "luhn", "octets", "mixed", "long",
    *(f"chunks{n}" for n in range(1, MAX_CHUNKS + 1)), *(f"digits{n}" for n in range(9)),
    *(f"mostly{n}" for n in range(4)), *(f"hint_{h}" for h in _HINTS), "phone&digits10", "card&luhn",
]:
    _feature(_name)


_HINT_WORDS = frozenset(w for words in _HINTS.values() for w in words)


def span_features(span: str, chunks: int, before: str) -> tuple[int, ...]:
    """Numbers of the features of a span of so many chunks, behind the chunk ``before``."""
    last = before.lower().rstrip(":=") if len(before) < 16 else ""
    return _features(span, chunks, last if last in _HINT_WORDS else "")


@lru_cache(maxsize=1 << 15)
def _features(span: str, chunks: int, last: str) -> tuple[int, ...]:
    digits = _digits(span)
    n = len(digits)
    names = ["one", f"chunks{chunks}", f"mostly{min(3, 4 * n // max(len(span), 1))}"]
    names.append(f"digits{0 if n == 0 else 1 if n < 4 else 2 if n < 7 else 3 if n < 9 else 4 if n < 11 else 5 if n < 12 else 6 if n < 16 else 7 if n < 20 else 8}")
    hits = {name for name, shape in _SHAPES.items() if shape.fullmatch(span)}
    names += hits
    if "@" in span:
        names.append("at")
    if span.startswith("+"):
        names.append("plus")
    if "(" in span:
        names.append("bracket")
    if "=" in span:
        names.append("equals")
    if 12 <= n <= 19 and luhn(digits):
        names.append("luhn")
        if "card" in hits:
            names.append("card&luhn")
    if "quad" in hits and all(map(_short, re.split(r"[.:/]", span)[:4])):
        names.append("octets")
    if "phone" in hits and n in (10, 11):
        names.append("phone&digits10")
    if n >= 3 and sum(c.isalpha() for c in span) >= 3:
        names.append("mixed")
    if len(span) > 24:
        names.append("long")
    names += [f"hint_{h}" for h, words in _HINTS.items() if last in words]
    return tuple(NAMES[x] for x in names)


def candidates(text: str, start: int, end: int) -> tuple[int, list[Candidate]]:
    """Number of chunks of a window, and its candidate spans by first chunk."""
    chunks = [m.span() for m in _CHUNK.finditer(text, start, end)]
    made = []
    for i, (a, _) in enumerate(chunks):
        before = text[chunks[i - 1][0] : chunks[i - 1][1]] if i else ""
        for j in range(i, min(i + MAX_CHUNKS, len(chunks))):
            b = chunks[j][1]
            if b - a > MAX_CHARS:
                break
            x, y = a, b
            while x < y and text[x] in _TRIM_LEFT and not (text[x] == "(" and ")" in text[x:y]):
                x += 1
            while y > x and text[y - 1] in _TRIM_RIGHT and not (text[y - 1] in ")]" and text[y - 1] == ")" and "(" in text[x:y]):
                y -= 1
            span = text[x:y]
            if x < y and (_TRIGGER.search(span) or any(s.strip() in span for s in _SPELLED)):
                made.append(Candidate(i, j, x, y, span_features(span, j - i + 1, before)))
    return len(chunks), made


# ---- the field ----------------------------------------------------------------------------


class Field(NamedTuple):
    """Weights by feature and kind, and by (kind before, kind); the last kind is a chunk outside."""

    spans: np.ndarray
    steps: np.ndarray


OUTSIDE = len(KINDS)


def new_field() -> Field:
    return Field(np.zeros((len(NAMES), len(KINDS))), np.zeros((OUTSIDE + 1, OUTSIDE + 1)))


def _by_end(n: int, found: list[Candidate], field: Field):
    """For every chunk the segments that end there: first chunk, candidate (or None), scores by kind."""
    ends: list[list] = [[] for _ in range(n)]
    for c in found:
        ends[c.last].append((c.first, c, field.spans[list(c.features)].sum(axis=0)))
    return ends


def best_spans(n: int, found: list[Candidate], field: Field) -> list[Span]:
    """The segmentation with the greatest score."""
    if not found:
        return []
    flat = np.fromiter((f for c in found for f in c.features), np.int64)
    sizes = np.fromiter((len(c.features) for c in found), np.int64, len(found))
    own = np.add.reduceat(field.spans[flat], np.cumsum(sizes) - sizes)
    ends: list[list[int]] = [[] for _ in range(n)]
    for i, c in enumerate(found):
        ends[c.last].append(i)
    kinds = np.arange(OUTSIDE + 1)
    # the best way to go on from each place with each kind, and the kind before it
    ahead, before = np.empty((n + 1, OUTSIDE + 1)), np.empty((n + 1, OUTSIDE + 1), np.int64)
    score = np.full(OUTSIDE + 1, -np.inf)
    score[OUTSIDE] = 0.0
    back: list[list[int | None]] = [[None] * (OUTSIDE + 1) for _ in range(n + 1)]
    for at in range(n + 1):
        if at:
            score = np.full(OUTSIDE + 1, -np.inf)
            score[OUTSIDE] = ahead[at - 1, OUTSIDE]
            if ends[at - 1]:
                ways = ends[at - 1]
                totals = ahead[[found[i].first for i in ways], :OUTSIDE] + own[ways]
                best = totals.argmax(axis=0)
                score[:OUTSIDE] = totals[best, kinds[:OUTSIDE]]
                back[at][:OUTSIDE] = [ways[k] for k in best.tolist()]
        come = score[:, None] + field.steps
        before[at] = come.argmax(axis=0)
        ahead[at] = come[before[at], kinds]
    out, at, kind = [], n, int(score.argmax())
    while at:
        i = back[at][kind] if kind != OUTSIDE else None
        place = at - 1 if i is None else found[i].first
        if i is not None:
            out.append((found[i].start, kind, found[i].end))
        at, kind = place, int(before[place, kind])
    return out[::-1]


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    top = np.where(np.isfinite(top), top, 0)
    with np.errstate(divide="ignore"):
        return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def learn(field: Field, n: int, found: list[Candidate], gold: dict[tuple[int, int], int], rate: float) -> None:
    """One step up the conditional likelihood of a window; ``gold``: kind by (first, last) chunk."""
    ends = _by_end(n, found, field)
    ahead = np.full((n + 1, OUTSIDE + 1), -np.inf)
    ahead[0, OUTSIDE] = 0.0
    for at in range(1, n + 1):
        parts = [[ahead[at - 1][:, None] + field.steps[:, OUTSIDE:]]]
        ahead[at, OUTSIDE] = _log_sum(parts[0][0], 0)[0]
        inner = [_log_sum(ahead[f][:, None] + field.steps[:, :OUTSIDE], 0) + own for f, _, own in ends[at - 1]]
        if inner:
            ahead[at, :OUTSIDE] = _log_sum(np.array(inner), 0)
    behind = np.full((n + 1, OUTSIDE + 1), -np.inf)
    behind[n] = 0.0
    starts: list[list] = [[] for _ in range(n + 1)]
    for last, segments in enumerate(ends):
        for first, c, own in segments:
            starts[first].append((last + 1, c, own))
    for at in range(n - 1, -1, -1):
        onward = [field.steps[:, OUTSIDE] + behind[at + 1, OUTSIDE]]
        onward += [_log_sum(field.steps[:, :OUTSIDE] + (own + behind[to, :OUTSIDE])[None, :], 1) for to, _, own in starts[at]]
        behind[at] = _log_sum(np.array(onward), 0)
    total = _log_sum(ahead[n], 0)
    steps = np.zeros_like(field.steps)
    spans: list[tuple[Candidate, np.ndarray]] = []
    for at in range(n):
        steps[:, OUTSIDE] -= np.exp(ahead[at] + field.steps[:, OUTSIDE] + behind[at + 1, OUTSIDE] - total)
        for to, c, own in starts[at]:
            joint = np.exp(ahead[at][:, None] + field.steps[:, :OUTSIDE] + (own + behind[to, :OUTSIDE])[None, :] - total)
            steps[:, :OUTSIDE] -= joint
            spans.append((c, -joint.sum(axis=0)))
    at, kind = 0, OUTSIDE
    by_first = {first: (last, k) for (first, last), k in gold.items()}
    while at < n:
        last, k = by_first.get(at, (at, OUTSIDE))
        steps[kind, k] += 1
        at, kind = last + 1, k
    for c, expected in spans:
        k = gold.get((c.first, c.last))
        if k is not None:
            expected[k] += 1
        field.spans[list(c.features)] += rate * expected
    field.steps[:] += rate * (steps - RIDGE * field.steps)


def _spellings(kind: int, span: str, rng: random.Random) -> list[str]:
    """Other common ways to write a span."""
    if kind == 0 and span.count("@") == 1:
        name, host = span.split("@")
        return [f"{name} at {host.replace('.', ' dot ')}", f"{name} (at) {host}", f"{name}[at]{host.replace('.', '[dot]')}"]
    if kind == 2:
        d = _digits(span)
        return [" ".join(d[i : i + 4] for i in range(0, len(d), 4)), "-".join(d[i : i + 4] for i in range(0, len(d), 4))]
    if kind == 3:
        d = _digits(span)[-10:].zfill(10)
        return [
            f"({d[:3]}) {d[3:6]}-{d[6:]}", f"{d[:3]}-{d[3:6]}-{d[6:]}", f"{d[:3]}.{d[3:6]}.{d[6:]}",
            f"1 ({d[:3]}) {d[3:6]}-{d[6:]}", f"+1-{d[:3]}-{d[3:6]}-{d[6:]}",
        ]
    if kind == 4:
        # other names and marks before the same value, and a key that stands alone
        value = re.split(r"[=:]", span)[-1].strip("\x20\"'")
        cut = value[: rng.randrange(10, 28)]
        key = "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(16))
        return [f"password={cut}", f"token={cut.title()}", f"api_key: {cut}", f"secret_key='{value}'", f"AKIA{key}"]
    return []


def _nothing(rng: random.Random) -> str:
    """A number that is no personal data."""
    d = lambda n: str(rng.randrange(10 ** (n - 1), 10**n))
    return rng.choice([
        d(1), d(2), d(3), str(rng.randrange(1900, 2100)), d(5), d(6), d(8), f"{d(1)}.{d(1)}", f"{d(1)}.{d(2)}.{d(1)}",
        f"{d(2)},{d(3)},{d(3)}", f"{rng.randrange(1990, 2030)}-{rng.randrange(1, 13):02}-{rng.randrange(1, 29):02}",
        f"{rng.randrange(24):02}:{rng.randrange(60):02}", f"{d(2)}%", f"x={d(1)}", f"n = {d(2)}", f"{d(3)}-{d(3)}", d(13),
    ])


# settings with a long value, and access keys by their shape: sure enough to learn the kind from
_SEEDS = re.compile(
    r"""\b[\w-]{0,24}?(?:password|passwd|secret|token|api_?key)[\w-]{0,24}[\x20]?[=:][\x20]?["']?[A-Za-z0-9+/_-]{8,64}"""
    r"""|\bAKIA[A-Z0-9]{16}\b""", re.IGNORECASE,
)


def train(texts: list[str], seed: int = 5) -> Field:
    """Fit on texts that hold base spans (windows of documents)."""
    rng = random.Random(seed)
    examples: list[tuple[str, list[Span]]] = []
    for text in texts:
        spans = base_spans(text) + [(m.start(), 4, m.end()) for m in _SEEDS.finditer(text)]
        if not spans:
            continue
        examples.append((text, spans))
        for start, kind, end in spans:
            left, right = text[max(0, start - CONTEXT) : start], text[end : end + CONTEXT]
            # the neighbours of a span must hold nothing themselves
            if base_spans(left) or base_spans(right):
                continue
            for other in _spellings(kind, text[start:end], rng):
                examples.append((left + other + right, [(len(left), kind, len(left) + len(other))]))
            none = _nothing(rng)
            examples.append((left + none + right, []))
    field = new_field()
    rows = []
    for text, spans in examples:
        n, found = candidates(text, 0, len(text))
        by_place = {(c.start, c.end): (c.first, c.last) for c in found}
        if any((a, b) not in by_place for a, _, b in spans):
            continue  # a span that is no run of whole chunks
        rows.append((n, found, {by_place[a, b]: k for a, k, b in spans}))
    for epoch in range(EPOCHS):
        rng.shuffle(rows)
        for n, found, gold in rows:
            learn(field, n, found, gold, RATE / (1 + epoch))
        field.spans[:] *= 1 - RIDGE
    return field


def all_spans(text: str, field: Field) -> tuple[list[Span], list[Span]]:
    """Base spans, and those the field adds; the latter overlap no base span."""
    base = base_spans(text)
    taken = sorted((a, b) for a, _, b in base)
    starts = [a for a, _ in taken]
    reach = np.maximum.accumulate([b for _, b in taken]) if taken else []
    added = []
    for start, end in windows(text):
        n, found = candidates(text, start, end)
        for a, kind, b in best_spans(n, found, field):
            before = int(np.searchsorted(starts, b, "left"))
            if not before or reach[before - 1] <= a:
                added.append((a, kind, b))
    return base, added


# ---- job ----------------------------------------------------------------------------------


def training_windows(docs: DataFrame, sample: int = SAMPLE, most: int = WINDOWS) -> list[str]:
    """Windows that hold a base span, in a fixed order: of about ``sample`` documents the first ``most`` of each
    that are no longer than ``LONGEST``."""

    def build():
        def step(rows):
            made = {"doc_id": [], "part": []}
            for doc_id, text in zip(rows["doc_id"], rows["text"], strict=True):
                fit = (
                    text[start:end] for start, end in windows(text)
                    if end - start <= LONGEST and (base_spans(text[start:end]) or _SEEDS.search(text, start, end))
                )
                for part in islice(fit, most):
                    made["doc_id"].append(doc_id)
                    made["part"].append(part)
            return made

        return step

    slim = docs.select(F.col("doc_id"), F.col("text"))
    total = slim.select("doc_id").count()
    share = F.pmod(F.xxhash64("doc_id"), F.lit(2**32)) / float(2**32)
    if total > sample:
        drawn = slim.where(F.col("doc_id").isNotNull() & (share < sample / total))
        slim = drawn.groupBy("doc_id").agg(F.min("text").alias("text"))
    rows = map_rows(slim, "doc_id long, part string", build).toPandas()
    return sorted(set(rows["part"]))


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def find_pii(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", sample: int = SAMPLE) -> DataFrame:
    """Base counts, digest of the base spans, all spans and the number of added ones, per document."""
    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text"))
    field = train(training_windows(slim, sample))

    def build():
        def step(rows):
            made = {name: [] for name in names}
            made["doc_id"] = rows["doc_id"]
            for text in rows["text"]:
                base, added = all_spans(text, field)
                for k in range(4):
                    made[f"n_{KINDS[k]}"].append(sum(s[1] == k for s in base))
                made["base_sha256"].append(hashlib.sha256(_joined(base).encode()).hexdigest())
                made["spans"].append(_joined(base + added))
                made["n_added"].append(len(added))
            return made

        return step

    names = ["doc_id", *(f"n_{k}" for k in KINDS[:4]), "base_sha256", "spans", "n_added"]
    return map_rows(
        slim, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long",
        build,
    )
