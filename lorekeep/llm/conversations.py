"""Conversation structure repair by dynamic programming over a grammar-compressed corpus.

A conversation is a sequence of symbols, one per row: the class of its role's initial and its fault.

* **Order and faults** are columns: a row is a duplicate unless it is the first of its conversation,
  role and text, found by one aggregation. Rows are numbered by a range sort, so that a conversation
  of any length lies in segments of at most ``SEGMENT`` rows; only symbols are gathered.
* **Re-Pair.** The distinct segments, weighted by how often they occur, share one grammar: in every
  round the most frequent pairs of symbols that don't touch each other get a symbol of their own.
  What comes to the driver is at most ``RULES`` pairs in all.
* **Transfer matrices.** For every rule, bottom-up, a min-plus matrix over four states (nothing yet,
  after s, after u, after a) holds the cheapest edits between two states: cost and audit, least
  in ASCII among the cheapest. An audit is a rope of the audits of the rule's two parts. A segment is
  the product of the few symbols it was compressed to, worked out once for all conversations that
  contain it.
* **Conversations** fold their segments from left to right; then their rows stream by in order, with
  the audit in front, and the repaired text goes through the hash. A conversation's audit is a cell
  of the result and the SHA-256 of its repaired text is sequential by nature, so one task reads a
  conversation to the end, but it holds one row and the audit at a time.

No two audits of equal cost between the same states begin one another: the longer would have more
inserts. So the least of joined audits is the join of the least ones, and the products are exact.

Defined cases: a null role or text is one space, and so is a null id or number in the damage code; a
null id is a conversation of its own; rows of one turn are ordered by role and digest of the text; a
role whose initial is none of s, u and a must be changed or deleted; a conversation without rows
after damage has zeros; repeated rows are duplicates; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.common import map_rows, settle

SEGMENT = 256
RULES = 1024
PER_ROUND = 64
# white space of the contract, for Java's and Python's patterns
SPACE = r"\x20\x09-\x0D"
CLEAN, BLANK, DUPLICATE, TRUNCATED = range(4)
INITIALS = "sua"  # other initials are class 3
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
_RULE_BASE = 0xE000  # private use: symbols of rules


# ---- rows and faults ----------------------------------------------------------------------


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and ``copies``: 0 for a row that is dropped, 2 for one repeated."""
    space = F.lit(" ")
    code = F.crc32(F.concat_ws(
        ":", F.coalesce(F.col("conv_id").cast("string"), space), F.coalesce(F.col("turn").cast("string"), space)
    ).cast("binary")) % 20
    text = F.coalesce(F.col("text").cast("string"), space)
    return conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.when(code == 4, F.lit("user")).otherwise(F.coalesce(F.col("role").cast("string"), space)).alias("role"),
        F.when(code == 1, F.lit("")).when(code == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(code == 0, 0).when(code == 3, 2).otherwise(1).alias("copies"),
    )


def role_class() -> Column:
    initial, out = F.substring("role", 1, 1), F.lit(len(INITIALS))
    for k, letter in enumerate(INITIALS):
        out = F.when(initial == letter, k).otherwise(out)
    return out


def symbols(rows: DataFrame) -> DataFrame:
    """conv_id, segment, place and symbol of every row that is left, numbered in order."""
    blank = ~F.col("text").rlike(f"[^{SPACE}]")
    open_end = ~F.col("text").rlike(f"[.!?][{SPACE}]*\\z")
    slim = rows.where("copies > 0").select(
        "conv_id", "turn", "role", F.sha2("text", 256).alias("digest"), "copies",
        F.when(blank, BLANK).when(open_end, TRUNCATED).otherwise(CLEAN).alias("fault"),
    )
    same = slim.groupBy("conv_id", "turn", "role", "digest", "fault").agg(F.sum("copies").alias("copies"))
    same = settle(same, "turns")
    # only texts met again need a look at their first turn
    again = same.where("fault <> 1").groupBy("conv_id", "role", "digest").agg(
        F.min(F.struct(F.col("turn").isNotNull(), "turn")).alias("first"), F.count("*").alias("turns")
    ).where("turns > 1")
    again = settle(again.select(
        F.coalesce("conv_id", F.lit(0)).alias("key"), F.col("conv_id").isNull().alias("no_id"), "role", "digest",
        F.col("first.turn").alias("first"), F.lit(True).alias("met"),
    ), "again")
    later = same.withColumns({"key": F.coalesce("conv_id", F.lit(0)), "no_id": F.col("conv_id").isNull()}).join(
        again, ["key", "no_id", "role", "digest"], "left"
    ).withColumn("later", F.coalesce("met", F.lit(False)) & ~F.col("turn").eqNullSafe(F.col("first")))
    # of equal rows of one turn the first keeps its own fault
    each = later.select(
        "conv_id", "turn", "role", "digest", "fault", "later", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")
    )
    fault = F.when(F.col("fault") == BLANK, BLANK).when(F.col("later") | (F.col("copy") > 1), DUPLICATE).otherwise(F.col("fault"))
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "digest", "copy"]
    ordered = each.repartitionByRange(*order).sortWithinPartitions(*order).select(
        "conv_id", F.monotonically_increasing_id().alias("place"),
        F.char(F.lit(ord("a")) + 4 * role_class() + fault).alias("symbol"),
    )
    return settle(ordered.withColumn("segment", F.floor(F.col("place") / SEGMENT)), "symbols")


def segments(rows: DataFrame) -> DataFrame:
    """conv_id, segment, sequence; at most ``SEGMENT`` symbols each."""
    return rows.groupBy("conv_id", "segment").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "symbol"))), lambda x: x["symbol"]), "")
        .alias("sequence")
    )


# ---- grammar ------------------------------------------------------------------------------


def _chosen(counts: list[tuple[str, int]], most: int) -> list[str]:
    """The most frequent pairs of which none shares a symbol with an earlier one."""
    taken, out = set(), []
    for pair, _ in counts:
        if len(out) < most and not taken & set(pair):
            out.append(pair)
            taken |= set(pair)
    return out


def compress(sequences: DataFrame, rules: int = RULES, per_round: int = PER_ROUND) -> tuple[DataFrame, list[str]]:
    """``sequences`` (sequence, weight) with ``packed``, and the pairs the rules stand for, in order."""
    packed = sequences.withColumn("packed", F.col("sequence"))
    grammar: list[str] = []
    while len(grammar) < rules:
        pairs = packed.where(F.length("packed") > 1).select("weight", F.explode(F.transform(
            F.sequence(F.lit(1), F.length("packed") - 1), lambda i: F.substring(F.col("packed"), i, F.lit(2))
        )).alias("pair")).groupBy("pair").agg(F.sum("weight").alias("n")).where("n > 1")
        best = pairs.orderBy(F.desc("n"), "pair").limit(4 * per_round).collect()
        new = _chosen([tuple(r) for r in best], min(per_round, rules - len(grammar)))
        if not new:
            break
        made = F.col("packed")
        for pair in new:
            made = F.replace(made, F.lit(pair), F.lit(chr(_RULE_BASE + len(grammar))))
            grammar.append(pair)
        packed = settle(packed.withColumn("packed", made), "packed")
    return packed, grammar


# ---- transfer matrices --------------------------------------------------------------------

Rope = object  # a letter, or a pair of ropes
Entry = tuple  # cost, rope
Matrix = list  # [from][to]: Entry or None


def flat(rope: Rope) -> str:
    out, left = [], [rope]
    while left:
        top = left.pop()
        if isinstance(top, str):
            out.append(top)
        else:
            left += [top[1], top[0]]
    return "".join(out)


def less(a: Entry | None, b: Entry | None) -> Entry | None:
    """The cheaper of two; of equally cheap ones the one with the smaller audit."""
    if a is None or b is None:
        return b if a is None else a
    if a[0] != b[0]:
        return a if a[0] < b[0] else b
    return a if flat(a[1]) <= flat(b[1]) else b


def product(left: Matrix, right: Matrix) -> Matrix:
    out: Matrix = [[None] * 4 for _ in range(4)]
    for i in range(4):
        for k in range(4):
            if left[i][k] is None:
                continue
            cost, rope = left[i][k]
            for j in range(4):
                if right[k][j] is not None:
                    out[i][j] = less(out[i][j], (cost + right[k][j][0], (rope, right[k][j][1])))
    return out


def _identity() -> Matrix:
    return [[(0, "") if i == j else None for j in range(4)] for i in range(4)]


def _emit(state: int, initial: int) -> int | None:
    """The state after a kept or made row of class ``initial``."""
    if initial == 0:
        return SYSTEM if state == NOTHING else None
    if initial == 1:
        return USER if state != USER else None
    return ASSISTANT if initial == 2 and state == USER else None


def inserts() -> Matrix:
    """Any number of inserted rows."""
    one = [[None] * 4 for _ in range(4)]
    for state in range(4):
        for initial in (1, 2):
            after = _emit(state, initial)
            if after is not None:
                one[state][after] = less(one[state][after], (2, "I"))
    total, power = _identity(), _identity()
    for _ in range(3):  # more would come back to a state at a cost
        power = product(power, one)
        total = [[less(total[i][j], power[i][j]) for j in range(4)] for i in range(4)]
    return total


def terminal(symbol: str) -> Matrix:
    """Inserts before a row, then its edit."""
    initial, fault = divmod(ord(symbol) - ord("a"), 4)
    edits: Matrix = [[None] * 4 for _ in range(4)]
    for state in range(4):
        edits[state][state] = (3, "D")
        if fault in (BLANK, DUPLICATE):
            continue
        extra = int(fault == TRUNCATED)
        kept = _emit(state, initial)
        if kept is not None:
            edits[state][kept] = less(edits[state][kept], (extra, "K"))
        for other in (1, 2):
            made = _emit(state, other)
            if made is not None:
                edits[state][made] = less(edits[state][made], (2 + extra, "R"))
    return product(inserts(), edits)


class Grammar:
    """Matrices of all symbols, each worked out once."""

    def __init__(self, rules: list[str]):
        self.matrices = {chr(ord("a") + k): terminal(chr(ord("a") + k)) for k in range(16)}
        for k, (left, right) in enumerate(rules):
            self.matrices[chr(_RULE_BASE + k)] = product(self.matrices[left], self.matrices[right])

    def of(self, packed: str) -> Matrix:
        out = _identity()
        for symbol in packed:
            out = product(out, self.matrices[symbol])
        return out


def transfer(packed: DataFrame, rules: list[str]) -> DataFrame:
    """sequence, costs and audits (16 each, null where there is no way)."""

    def build():
        grammar = Grammar(rules)

        def step(rows):
            cells = [[cell for line in grammar.of(p) for cell in line] for p in rows["packed"]]
            return {
                "sequence": rows["sequence"], "costs": [[c and c[0] for c in row] for row in cells],
                "audits": [[c and flat(c[1]) for c in row] for row in cells],
            }

        return step

    return map_rows(packed.select("sequence", "packed"), "sequence string, costs array<long>, audits array<string>", build)


# ---- conversations ------------------------------------------------------------------------


class _Fold:
    """One conversation from its segments: counts and the cheapest way into each state."""

    def __init__(self, conv_id: int | None):
        self.conv_id = conv_id
        self.ways: list[tuple[int, str] | None] = [(0, ""), None, None, None]
        self.faults = [0, 0, 0, 0]
        self.illegal, self.last = 0, ""

    def add(self, sequence: str, costs: list[int | None], audits: list[str | None]) -> None:
        after: list = [None] * 4
        for i, way in enumerate(self.ways):
            for j in range(4) if way else ():
                if costs[4 * i + j] is not None:
                    after[j] = less(after[j], (way[0] + costs[4 * i + j], way[1] + audits[4 * i + j]))
        self.ways = after
        classes = [divmod(ord(s) - ord("a"), 4) for s in sequence]
        initials = self.last + "".join((INITIALS + "-")[c] for c, _ in classes)
        self.illegal += sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        self.last = initials[-1]
        for _, fault in classes:
            self.faults[fault] += 1

    def row(self) -> tuple:
        best = None
        for i, end in zip(range(4), _ends(), strict=True):
            for j in (NOTHING, ASSISTANT):
                if self.ways[i] and end[j] is not None:
                    best = less(best, (self.ways[i][0] + end[j][0], self.ways[i][1] + flat(end[j][1])))
        return (self.conv_id, *self.faults[1:], self.illegal, best[0], best[1])


@lru_cache(maxsize=1)
def _ends() -> Matrix:
    return inserts()


def _columns(rows: list[tuple], schema: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    cells = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(cells, schema, strict=True)], [n for n, _ in schema])


_REPAIRS = [("conv_id", pa.int64())] + [(n, pa.int64()) for n in ("blank", "duplicate", "truncated", "illegal", "cost")] + [
    ("audit", pa.string())
]


def _folded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    fold = None
    for batch in batches:
        done = []
        for conv_id, sequence, costs, audits in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if fold is None or fold.conv_id != conv_id:
                if fold:
                    done.append(fold.row())
                fold = _Fold(conv_id)
            fold.add(sequence, costs, audits)
        if done:
            yield _columns(done, _REPAIRS)
    if fold:
        yield _columns([fold.row()], _REPAIRS)


def repairs(conversations: DataFrame) -> DataFrame:
    """conv_id, blank, duplicate, truncated, illegal, cost, audit of conversations with rows left."""
    parts = settle(segments(symbols(damaged(conversations))), "segments")
    packed, rules = compress(parts.groupBy("sequence").agg(F.count("*").alias("weight")))
    cheapest = settle(transfer(packed, rules), "transfer")
    rows = parts.join(cheapest, "sequence").repartition(F.col("conv_id")).sortWithinPartitions("conv_id", "segment")
    return rows.select("conv_id", "sequence", "costs", "audits").mapInArrow(
        _folded, "conv_id long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
    )


class Repair:
    """Rows of one conversation in order: the turns met and the hash of the repaired text."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, NOTHING
        self.hash, self.first = hashlib.sha256(), True
        self.turns, self.low, self.high = 0, None, None

    def _write(self, role: str, text: str) -> None:
        self.hash.update(("" if self.first else "\n").encode() + f"{role}:{text}".encode())
        self.first = False

    def _next(self) -> str:
        """The role of an inserted or changed row."""
        self.state = ASSISTANT if self.state == USER else USER
        return "assistant" if self.state == ASSISTANT else "user"

    def _inserted(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at += 1
            self._write(self._next(), "")

    def row(self, turn: int | None, role: str, text: str) -> None:
        if turn is not None and turn != self.high:
            self.turns, self.high = self.turns + 1, turn
            self.low = turn if self.low is None else self.low
        self._inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "R":
            self._write(self._next(), text)
        elif edit == "K":
            self._write(role, text)
            self.state = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[role[0]]

    def end(self) -> tuple[int, str]:
        self._inserted()
        return 0 if self.low is None else self.high - self.low + 1 - self.turns, self.hash.hexdigest()


_RESULT = [_REPAIRS[0], ("gaps", pa.int64()), *_REPAIRS[1:], ("repaired_sha256", pa.string())]


def _streamed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by conversation and ``kind``: what was found (0), then the rows in order (1)."""
    head = own = None

    def close() -> tuple:
        gaps, digest = own.end()
        return (head[0], gaps, *head[1:], digest)

    for batch in batches:
        done = []
        for conv_id, kind, turn, role, text, copies, *found in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if head is None or conv_id != head[0]:
                if head:
                    done.append(close())
                head = [conv_id, *(found if kind == 0 else [0, 0, 0, 0, 0, ""])]
                own = Repair(head[-1])
            if kind:
                for _ in range(copies):
                    own.row(turn, role, text)
        if done:
            yield _columns(done, _RESULT)
    if head:
        yield _columns([close()], _RESULT)


def repaired(conversations: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    found = repairs(conversations)
    # a dropped row stays to name its conversation
    rows = damaged(conversations).select(
        "conv_id", F.lit(1).alias("kind"), "turn", "role", F.when(F.col("copies") > 0, F.col("text")).alias("text"), "copies",
        F.sha2("text", 256).alias("digest"),
    )
    both = found.withColumn("kind", F.lit(0)).unionByName(rows, allowMissingColumns=True)
    # as in ``symbols``, but equal rows need no number
    ordered = both.repartition(F.col("conv_id")).sortWithinPartitions(
        "conv_id", "kind", F.col("turn").asc_nulls_first(), "role", "digest"
    )
    names = ["conv_id", "kind", "turn", "role", "text", "copies", *[n for n, _ in _REPAIRS[1:]]]
    return ordered.select(*names).mapInArrow(
        _streamed, "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string,"
        " repaired_sha256 string",
    )
