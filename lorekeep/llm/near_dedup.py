"""Near-duplicates by SuperMinHash signatures, banding, verification and union-find grouping.

* **Signature.** In round j every shingle of a document puts a random value into the j-th place of
  its own random permutation of the slots; a slot keeps the smallest value of the first round that
  reaches it. A document stops as soon as all its slots are filled: one or two rounds for most
  texts, at most as many as there are slots. All shingles of a slice go through a round together.
* **Classes.** Documents with equal shingle sets (128 bits of the sorted set and its size) form a
  class; only one text of it goes on, so thousands of copies cost one signature each and no pair.
* **Banding.** ``bands`` bands of ``rows`` slots; classes that agree in a band share a bucket. At
  similarity 0.8 a pair is in no common bucket with a probability of 3e-6.
* **Links.** Each bucket tests its members against one hub, the member that meets most others, and
  links found are merged into components. What is then still apart goes through an exact join
  around the hubs: with H the hub, A and B differ in |A^H| + |B^H| - 2 |common part of both| shingles
  (^ is the symmetric difference), and of two members in different components one is so far from
  the hub that their differences must have much in common. The differences are ordered from the
  rarest shingle on; a similar pair meets in the first of them, fewer for the one that is nearer to
  the hub, and their places bound what can be common. Shingles that nearly all copies of a text share
  are in no difference, so they bring nobody together: the keys are the rare departures from the hub.
  Only pairs of different components that pass the bound are tested. So no bucket is gathered, no
  group's pairs are all built, and no link is lost to a cap.
* **Verification** is exact, on the full shingle sets of the two texts.

Defined cases: a document without words, or null, has no shingles and is its own component; with
fewer words than a shingle its whole sequence is one; equal texts and repeated rows are one class
and stay rows of the result; rows that share an id are one node, whose texts are all compared; a null id
links with nothing and has a null component; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.llm.common import map_rows, settle, text_of
from lorekeep.llm.components import merge_components, renamed

BANDS, ROWS = 32, 5
CACHED_WORDS = 300_000
HUB_BLOCK = 512

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_VALUE_BITS = 40


def mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


class WordHashes(dict):
    """64-bit hashes of words; emptied when full, which changes no result."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found


def shingle_sets(texts: list[str], hashes: WordHashes, width: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text."""
    # bytes.lower() and bytes.split() know ASCII only, as the contract does
    words = [t.encode().lower().split() for t in texts]
    counts = [len(w) for w in words]
    flat = np.fromiter((hashes[w] for ws in words for w in ws), np.uint64, sum(counts))
    spans = flat[: max(len(flat) - width + 1, 0)].copy()
    for k in range(1, width):
        spans = mixed(spans + _GOLDEN) ^ flat[k : k + len(spans)]
    spans = mixed(spans)
    out, at = [], 0
    for n in counts:
        if n >= width:
            out.append(np.unique(spans[at : at + n - width + 1]))
        elif n:
            own = flat[at : at + n]
            h = np.uint64(n) * np.ones(1, np.uint64)
            for k in range(n):
                h = mixed(h + _GOLDEN) ^ own[k : k + 1]
            out.append(mixed(h + _GOLDEN))
        else:
            out.append(np.zeros(0, np.uint64))
        at += n
    return out


def signatures(sets: list[np.ndarray], slots: int) -> np.ndarray:
    """SuperMinHash signatures, one row per set; rows of empty sets are meaningless."""
    sizes = np.array([len(s) for s in sets], np.int64)
    empty = np.iinfo(np.uint64).max
    out = np.full((len(sets), slots), empty, np.uint64)
    flat = out.reshape(-1)
    item = np.concatenate([*sets, np.zeros(0, np.uint64)])
    doc = np.repeat(np.arange(len(sets)), sizes)
    swaps: list[np.ndarray] = []
    for j in range(slots):
        if not len(item):
            break
        x = mixed(item + np.uint64((j + 1) * int(_GOLDEN) & 0xFFFFFFFFFFFFFFFF))
        swap = j + ((x >> np.uint64(_VALUE_BITS)) * np.uint64(slots - j) >> np.uint64(64 - _VALUE_BITS)).astype(np.int64)
        # what stands at that place after the swaps of the earlier rounds
        place = swap.copy()
        for t in range(j - 1, -1, -1):
            place[place == swaps[t]] = t
        value = (x & np.uint64((1 << _VALUE_BITS) - 1)) | np.uint64(j << _VALUE_BITS)
        np.minimum.at(flat, doc * slots + place, value)
        swaps.append(swap)
        go_on = (out == empty).any(axis=1)[doc]
        if not go_on.all():
            item, doc, swaps = item[go_on], doc[go_on], [s[go_on] for s in swaps]
    return out


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    parts = signature.reshape(len(signature), bands, rows)
    key = np.arange(bands, dtype=np.uint64)[None, :] * _GOLDEN
    for r in range(rows):
        key = mixed(key + _GOLDEN) ^ parts[:, :, r]
    return mixed(key).view(np.int64)


def _sketched(docs: DataFrame, width: int, bands: int, rows: int, text: str, doc_id: str) -> DataFrame:
    def build():
        hashes = WordHashes()

        def step(batch):
            sets = shingle_sets(batch["text"], hashes, width)
            keys = band_keys(signatures(sets, bands * rows), bands, rows)
            sizes = [len(s) for s in sets]
            has = np.array(sizes) > 0
            ends = np.concatenate([[0], np.cumsum(np.where(has, bands, 0))]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys[has].reshape(-1)))
            digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            return {"id": batch["id"], "print": batch["print"], "n_shingles": sizes, "digest": digests, "bands": lists}

        return step

    return map_rows(
        _printed(docs, text, doc_id), "id long, print long, n_shingles long, digest binary, bands array<long>", build
    )


def _printed(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """id, text and the print that tells texts of one id apart."""
    return docs.select(
        F.col(doc_id).cast("long").alias("id"), F.xxhash64(text_of(text)).alias("print"), text_of(text).alias("text")
    )


def _compared(pairs: DataFrame, texts: DataFrame, width: int, percent: int, differences: bool) -> DataFrame:
    """``pairs`` (a, b) with ``linked``; with ``n_a``, ``n_b`` and ``apart``, the shingles that only one has, if asked for."""
    # merge joins: whether the texts are small must not decide what is shuffled; a hub with many
    # pairs is several blocks of them, each with the hub's text
    blocks = pairs.groupBy("a").agg(F.ceil(F.count("*") / HUB_BLOCK).cast("int").alias("blocks"))
    firsts = texts.withColumnRenamed("vertex", "a").join(blocks, "a").select(
        "a", F.col("text").alias("text_a"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")
    )
    rows = pairs.join(blocks, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("blocks")).cast("int").alias("block"))
    rows = rows.join(texts.select(F.col("vertex").alias("b"), F.col("text").alias("text_b")).hint("merge"), "b").join(
        firsts.hint("merge"), ["a", "block"]
    )

    def build():
        hashes = WordHashes()
        last: dict[str, np.ndarray] = {}

        def sets_of(texts: list[str]) -> list[np.ndarray]:
            # a hub's text comes many times in a row
            new = [t for t in dict.fromkeys(texts) if t not in last]
            made = {t: last[t] for t in dict.fromkeys(texts) if t in last}
            made.update(zip(new, shingle_sets(new, hashes, width), strict=True))
            last.clear()
            last.update(made)
            return [made[t] for t in texts]

        def step(batch):
            sets = zip(sets_of(batch["text_a"]), shingle_sets(batch["text_b"], hashes, width), strict=True)
            made = {"a": batch["a"], "b": batch["b"], "linked": [], "n_a": [], "n_b": []}
            apart = []
            for x, y in sets:
                one = np.setxor1d(x, y, assume_unique=True)
                # twice the common ones, and twice all
                made["linked"].append(100 * (len(x) + len(y) - len(one)) >= percent * (len(x) + len(y) + len(one)))
                made["n_a"].append(len(x))
                made["n_b"].append(len(y))
                apart.append(one if differences else one[:0])
            ends = np.concatenate([[0], np.cumsum([len(d) for d in apart])]).astype(np.int32)
            flat = np.concatenate([*apart, np.zeros(0, np.uint64)]).view(np.int64)
            made["apart"] = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
            return made

        return step

    schema = "a long, b long, linked boolean, n_a long, n_b long, apart array<long>"
    return map_rows(rows.select("a", "b", "text_a", "text_b"), schema, build, rows=256)


def _linked(compared: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links (a, b) between the nodes of the vertices found similar."""
    a, b = (nodes.select(F.col("vertex").alias(x), F.col("node").alias(f"{x}_node")) for x in "ab")
    found = compared.where("linked").select("a", "b").join(a, "a").join(b, "b")
    return settle(found.select(F.col("a_node").alias("a"), F.col("b_node").alias("b")), "links")


def linked(
    members: DataFrame, docs: DataFrame, width: int, percent: int, text: str, doc_id: str
) -> DataFrame:
    """Components (id, component) of the nodes of ``members`` (vertex, node, print, bands).

    A vertex is a shingle set with the text that has ``print`` and the id ``node``; a node may have
    several. Unlisted nodes stand alone.
    """
    rows = members.select("vertex", F.explode("bands").alias("key")).distinct()
    shared = rows.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
    buckets = settle(rows.join(shared, "key"), "buckets")
    nodes = members.select("vertex", "node", "print").distinct()
    nodes = settle(nodes.join(buckets.select("vertex").distinct(), "vertex", "left_semi"), "nodes")
    on = nodes.select("vertex", F.col("node").alias("id"), "print")
    # repeated rows: any one of the equal texts
    texts = settle(_printed(docs, text, doc_id).join(on.hint("merge"), ["id", "print"]).dropDuplicates(["vertex"]).select("vertex", "text"), "texts")

    central = buckets.groupBy("vertex").agg(F.sum("members").alias("met"))
    hubs = buckets.join(central, "vertex").groupBy("key").agg(
        F.max(F.struct("met", (-F.col("vertex")).alias("less"))).alias("hub")
    ).select("key", (-F.col("hub.less")).alias("a"))
    pairs = settle(
        buckets.join(hubs, "key").where("vertex <> a").select("a", F.col("vertex").alias("b")).distinct(), "pairs"
    )
    compared = _compared(pairs, texts, width, percent, differences=True)
    compared = settle(compared.withColumn("member", F.monotonically_increasing_id()), "compared")
    names = docs.sparkSession.createDataFrame([], "id long, component long")
    names = merge_components(names, _linked(compared, nodes))
    new = settle(_around_hubs(compared, nodes, names, percent), "pairs")
    return merge_components(names, _linked(settle(_compared(new, texts, width, percent, False), "compared"), nodes))


def _around_hubs(compared: DataFrame, nodes: DataFrame, names: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of vertices with one hub but different components that may be similar.

    Similar sets differ in at most ``(100 - percent) / (100 + percent)`` of the sum of their sizes.
    """
    component = renamed(nodes.select("vertex", F.col("node").alias("component")), "component", names)
    members = compared.select(
        "member", F.col("a").alias("hub"), F.col("n_a").alias("n_hub"), F.col("b").alias("vertex"), F.col("n_b").alias("n"),
        F.size("apart").cast("long").alias("far"),
    ).join(component, "vertex")
    # the hub itself was tested against all: with all in one component there is nothing to find
    several = members.groupBy("hub").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
    members = settle(members.join(several.select("hub"), "hub", "left_semi"), "members")
    # the rows are many: hub and shingle are one key, and all else is joined to the few that are left
    rows = compared.join(members.select("member"), "member", "left_semi").select(
        "member", F.col("a").alias("hub"), F.explode("apart").alias("shingle")
    ).select("member", F.xxhash64("hub", "shingle").alias("key"))
    held = rows.groupBy("key").agg(F.count("*").alias("holders")).where("holders > 1")
    # one document's differences lie in one window, as its text lies in one row
    own = Window.partitionBy("member")
    ordered = rows.join(held.hint("merge"), "key").withColumns({
        "place": F.row_number().over(own.orderBy("holders", "key")), "shared": F.count("*").over(own),
    }).select("member", "key", (F.col("shared") - F.col("place") + 1).alias("rest")).join(members, "member")
    less = F.lit(100 - percent) / F.lit(100 + percent)
    # of two in different components one is no neighbour of the hub; it has percent of the other's size or more
    least_far = less * (F.col("n") * percent / 100 + F.col("n_hub"))
    most = F.col("n") * (100 - percent) / percent  # apart from a partner of any size
    nearer = (F.greatest(F.col("far"), least_far) + F.col("far") - most) / 2
    farther = F.col("far") - most
    slack = 1e-6
    ordered = settle(
        ordered.select(
            "key", "vertex", "component", "n", "far", "rest", (F.col("rest") >= nearer - slack).alias("near_role"),
            ((F.col("rest") >= farther - slack) & (F.col("far") >= least_far - slack)).alias("far_role"),
        ).where("near_role or far_role"),
        "departures",
    )
    near = ordered.where("near_role").drop("near_role", "far_role")
    far = ordered.where("far_role").select("key", *[F.col(c).alias(f"{c}_f") for c in ("vertex", "component", "n", "far", "rest")])
    apart = F.col("far") + F.col("far_f") - 2 * F.least("rest", "rest_f")
    once = (F.col("far") < F.col("far_f")) | ((F.col("far") == F.col("far_f")) & (F.col("vertex") < F.col("vertex_f")))
    may = (100 + percent) * apart <= (100 - percent) * (F.col("n") + F.col("n_f"))
    met = near.join(far, "key").where(once & (F.col("component") != F.col("component_f")) & may)
    return met.select(F.least("vertex", "vertex_f").alias("a"), F.greatest("vertex", "vertex_f").alias("b")).distinct()


def near_duplicates(
    docs: DataFrame, width: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS,
    text: str = "text", doc_id: str = "doc_id",
) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable), kept; one row per row of ``docs``.

    Two documents are linked when ``100 * common >= percent * all`` of their distinct shingles of
    ``width`` words.
    """
    sketched = settle(_sketched(docs, width, bands, rows, text, doc_id), "sketches")
    first = F.min(F.struct("id", "print")).alias("first")
    classes = sketched.where("digest is not null and id is not null").groupBy("digest", "n_shingles").agg(first)
    classes = settle(
        classes.select(
            "digest", "n_shingles", F.col("first.id").alias("rep"), F.col("first.print").alias("rep_print"),
            F.monotonically_increasing_id().alias("vertex"),
        ),
        "vertices",
    )
    is_rep = (F.col("id") == F.col("rep")) & (F.col("print") == F.col("rep_print"))
    classed = settle(
        sketched.join(classes, ["digest", "n_shingles"], "left").select(
            "id", "n_shingles", F.when(F.col("id").isNotNull(), F.col("rep")).alias("rep"), "print", "vertex",
            F.when(is_rep, F.col("bands")).alias("bands"),
        ),
        "classes",
    )
    members = classed.where("bands is not null").select("vertex", F.col("rep").alias("node"), "print", "bands")
    # rows that share an id but not a text tie their classes together through the id
    other = classed.where("rep is not null and id <> rep").select("id", "rep").distinct()
    named = classes.select(F.col("rep").alias("id")).distinct()
    same = other.groupBy("id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a < b").select("a", "b").unionByName(
        other.join(named, "id", "left_semi").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    )
    names = merge_components(linked(members, docs, width, percent, text, doc_id), same)
    out = renamed(
        classed.select("id", "n_shingles", F.coalesce("rep", "id").alias("component_id")), "component_id", names
    )
    return out.select(
        F.col("id").alias("doc_id"), "n_shingles", "component_id",
        F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"),
    )


def near_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """One document of each group, with the columns of ``docs``: the rows of its smallest id."""
    names = docs.columns
    safe = docs.toDF(*[f"_in{i}" for i in range(len(names))])
    own = f"_in{names.index(doc_id)}"
    found = near_duplicates(safe, text=f"_in{names.index(text)}", doc_id=own, **options)
    gone = found.where("not kept").select("doc_id").distinct()
    kept = safe.join(gone, safe[own].cast("long") == gone["doc_id"], "left_anti")
    return kept.toDF(*names)
