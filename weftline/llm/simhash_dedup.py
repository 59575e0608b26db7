"""SimHash near-dedup with an LSH forest.

Texts are compared as sets of five-word shingles; two are near-duplicates at a Jaccard similarity of 0.8 or more, and a
class is a connected component of such links.

1. Equal texts become one node (by a 64-bit text hash, with partial aggregation), so copies are never paired.
2. A node's SimHash has 256 bits: bit by bit, the sign of the sum of +-1 over its distinct shingles' hashes.
3. The forest has several tries, each over its own random permutation of the bits. The deepest prefixes come first: in the first few tries
   every node meets its neighbours in the trie's order, which share the longest prefix with it. What is verified
   there puts nearly all members of a large group into one class, and nodes of one class are never compared again.
4. Then all tries climb to shorter prefixes, until the target recall is met. For a pair at the threshold one bit differs with
   probability p = acos(2J/(1+J))/pi, so prefixes of d bits in t tries find it with probability 1-(1-(1-p)^d)^t, averaged over how
   many of its bits differ: for t tries there is a deepest d at which the climb can stop.
5. The depth adapts to the density of each subtree. A prefix that still holds more than LEAF nodes at the depth where the climb would stop isn't
   compared there: its nodes go to the next rung of ``rungs``, with more tries, where the same recall is met at a deeper prefix. What
   is crowded even on the last rung is compared in full, class against class, in cells spread over tasks.
6. Candidates that differ in more bits than true pairs do (four standard deviations above the expected number, a loss of one in 10,000 at
   exactly the threshold), or whose numbers of shingles alone rule the threshold out, are dropped in the bucket.
   Every other one is verified by the exact Jaccard similarity of the shingle sets. No candidate is dropped by a count.

Cases: a null text, or one without a word, is like no other unless the text is equal; null texts are each alone. Texts of
one to four words have one shingle of all their words. Rows equal in doc_id and text are copies as any others: each
gets a row. The class id is the least doc_id of the class (nulls last). An empty table gives an empty result. Extra columns, whatever their
names, are carried by ``keep_one`` and don't matter elsewhere.
"""

from __future__ import annotations

import bisect
import functools
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


from .candidates import BYTES, LEAF, by_node, crowded, in_cells, neighbours, verify, within, within_crowded
from .common import cut, given, hidden, mix64, named, small, text_batches
from .components import components
from .shingles import WORDS, shingle_sets

BITS = 256
SIMILARITY = 0.8
RECALL = 0.999
PER_PREFIX = 512  # nodes expected under a prefix where the climb stops
LEAST_DEPTH = 4
MOST_TRIES = 1024
DEEP_TRIES = 8  # tries whose neighbours are verified first
SEED = 99

_SALTS = np.random.default_rng(SEED).integers(0, 2**63, size=BITS // 64, dtype=np.uint64)


def simhashes(texts: list[str | None], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(n x 4 integers, the numbers of distinct shingles). A repeated shingle counts once, as in verification."""
    sets = shingle_sets(texts, words)
    hashes, offsets = np.concatenate([np.zeros(0, dtype=np.uint64), *sets]), np.cumsum([0, *map(len, sets)])
    out = np.zeros((len(texts), BITS // 64), dtype=np.uint64)
    for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        if a == b:
            continue
        h = hashes[a:b]
        total = np.zeros(BITS, dtype=np.int64)
        for s in range(0, b - a, 255 * 16):
            wide = np.empty((min(b - a, s + 255 * 16) - s, BITS // 64), dtype=np.uint64)
            for k in range(BITS // 64):
                wide[:, k] = mix64(h[s : s + 255 * 16] + _SALTS[k])
            bits = np.unpackbits(wide.view(np.uint8).reshape(len(wide), -1), axis=1)
            for r in range(0, len(bits), 255):
                total += bits[r : r + 255].sum(axis=0, dtype=np.uint8)
        out[i] = np.packbits(2 * total > b - a).view(np.uint64)
    return out, np.diff(offsets)


def bit_error(similarity: float) -> float:
    """How likely a bit differs for two sets of this Jaccard similarity (of about equal sizes)."""
    return math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi


@functools.cache
def _missed(depth: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """(how likely each number of differing bits is, how likely one trie's prefix then misses the pair)."""
    p = bit_error(similarity)
    differ = np.arange(BITS + 1)
    share = np.exp([math.lgamma(BITS + 1) - math.lgamma(k + 1) - math.lgamma(BITS - k + 1) + k * math.log(p) + (BITS - k) * math.log(1 - p) for k in differ.tolist()])
    return share, 1 - np.prod([np.maximum(BITS - differ - x, 0) / (BITS - x) for x in range(depth)], axis=0)


def tries_for(depth: int, similarity: float = SIMILARITY, recall: float = RECALL) -> int:
    """The least number of tries that finds a pair at the threshold by prefixes of this depth. A pair's number of differing bits varies, and
    the far pairs lose more than the near ones gain."""
    share, miss = _missed(depth, similarity)
    most = 1
    while share @ miss**most > 1 - recall:
        most *= 2
    return 1 + bisect.bisect_left(range(1, most), True, key=lambda t: share @ miss**t <= 1 - recall)


def rungs(nodes: int, similarity: float = SIMILARITY, recall: float = RECALL) -> list[tuple[int, int]]:
    """[(depth where the climb stops, tries)], each with the target recall. The first is for all nodes, the others for the nodes of crowded prefixes."""
    depth = max(LEAST_DEPTH, math.ceil(math.log2(max(nodes, 1) / PER_PREFIX)) if nodes > PER_PREFIX else 0)
    out = [(depth, tries_for(depth, similarity, recall))]
    while (tries := tries_for(depth := depth + 3, similarity, recall)) <= MOST_TRIES:
        out.append((depth, tries))
    return out


def most_bits(similarity: float = SIMILARITY) -> int:
    """The most bits in which a candidate may differ."""
    p = bit_error(similarity)
    return math.ceil(BITS * p + 4 * math.sqrt(BITS * p * (1 - p)))


@functools.cache
def _order(trie: int) -> np.ndarray:
    return np.random.default_rng([SEED, trie]).permutation(BITS)


def _permuted(bits: np.ndarray, trie: int, depth: int) -> np.ndarray:
    """The first ``depth`` (62 at most) bits of the trie's permutation, as integers. ``bits``: a row of 256 zeros and ones a node."""
    out = np.zeros(len(bits), dtype=np.int64)
    for p in _order(trie)[:depth].tolist():
        out = (out << 1) | bits[:, p]
    return out


def _bits(sigs: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(sigs).view(np.uint8).reshape(len(sigs), -1), axis=1, bitorder="little")


def _masks(depth: int, tries: int) -> np.ndarray:
    """(tries x 4): the bits of each trie's prefix."""
    out = np.zeros((tries, BITS // 64), dtype=np.uint64)
    for t in range(tries):
        for p in _order(t)[:depth].tolist():
            out[t, p >> 6] |= np.uint64(1) << np.uint64(p & 63)
    return out


def _planted(nodes: DataFrame, depth: int, tries: int) -> DataFrame:
    """A row for each node and trie, with key = trie and prefix. ``nodes``: node, comp, n, s0..s3."""

    def plant(batches):
        for pdf in batches:
            for s in range(0, len(pdf), 2000):
                part = pdf.iloc[s : s + 2000]
                bits = _bits(part[BYTES].to_numpy().view(np.uint64))
                keys = np.stack([(t << depth) | _permuted(bits, t, depth) for t in range(tries)], axis=1)
                yield part.assign(keys=list(keys))

    columns = ["node", "comp", "n", *BYTES]
    keyed = nodes.select(*columns).mapInPandas(plant, ", ".join(f"{c} long" for c in columns) + ", keys array<long>")
    return keyed.select(*columns, F.explode("keys").alias("key"))


def climb(nodes: DataFrame, total: int, similarity: float, recall: float, leaf: int | None = None) -> DataFrame:
    """(a, b): the candidates of different classes that the forest finds, by exact distance and size still possible."""
    leaf = leaf or LEAF
    most, found, steps = most_bits(similarity), [], rungs(total, similarity, recall)
    for step, (depth, tries) in enumerate(steps):
        rows, masks = _planted(nodes, depth, tries), _masks(depth, tries)
        dense = crowded(rows, leaf)
        if dense.isEmpty():
            found.append(within(rows, similarity, most, masks, depth))
            break
        held = small(dense, 100_000)
        found.append(within(rows.join(held, "key", "left_anti"), similarity, most, masks, depth))
        packed = rows.join(held, "key", "left_semi")
        if step + 1 == len(steps):
            found.append(within_crowded(packed, similarity, most, masks, depth, leaf))
        else:
            nodes = cut(packed.select("node", "comp", "n", *BYTES).distinct())
    return functools.reduce(DataFrame.union, found).distinct() if len(found) > 1 else found[0]


def node_classes(docs: DataFrame, text: str = "text", similarity: float = SIMILARITY, recall: float = RECALL, leaf: int | None = None) -> DataFrame:
    """(th, comp) for every distinct text that has a near-duplicate of another text."""

    def sign(batches):
        for pdf in batches:
            texts = pdf["text"].tolist()
            sigs, counts = zip(*[simhashes(texts[a:b]) for a, b in text_batches(texts, 1_000_000)]) if texts else ((np.zeros((0, 4), dtype=np.uint64),), (np.zeros(0, dtype=int),))
            s = np.concatenate(sigs).view(np.int64)
            out = pd.DataFrame({"node": pdf["node"], "id": pdf["id"], "n": np.concatenate(counts), **{c: s[:, k] for k, c in enumerate(BYTES)}})
            yield out[np.concatenate(counts) > 0]

    columns = "node long, id string, n long, " + ", ".join(f"{c} long" for c in BYTES)  # as text, an id stays exact beside nulls
    t = named(text)
    rows = docs.where(t.isNotNull()).select(F.xxhash64(t).alias("node"), named("doc_id").cast("long").alias("id"), t.alias("text"))
    signed = rows.withColumn("id", F.col("id").cast("string")).mapInPandas(sign, columns).withColumn("id", F.col("id").cast("long"))
    nodes = cut(signed.groupBy("node").agg(F.min("id").alias("id"), *[F.first(c).alias(c) for c in ("n", *BYTES)]).withColumn("comp", F.col("node")))
    total = nodes.count()

    def texts(wanted: DataFrame) -> DataFrame:
        # one row's text for each node; rows equal in id and text give it again, which does no harm
        keys = small(cut(nodes.join(wanted, "node").select("node", F.col("id").alias("least"))))
        return rows.join(keys, "node").where(F.col("id").eqNullSafe(F.col("least"))).select("node", "text")

    def deep(batches):
        for pdf in batches:
            for s in range(0, len(pdf), 2000):
                part = pdf.iloc[s : s + 2000]
                bits = _bits(part[BYTES].to_numpy().view(np.uint64))
                for trie in range(DEEP_TRIES):
                    yield part.assign(key=(trie << 59) | _permuted(bits, trie, 59))

    flat = ["node", "comp", "n", *BYTES]
    ordered = nodes.select(*flat).mapInPandas(deep, ", ".join(f"{c} long" for c in [*flat, "key"]))
    first = cut(neighbours(ordered, ["key"], similarity, most_bits(similarity), 59))
    links, known = None, nodes
    if not first.isEmpty():
        links = cut(verify(by_node(first), texts, similarity))
        known = _classed(nodes, links)
    found = cut(climb(known, total, similarity, recall, leaf))
    if not found.isEmpty():
        more = cut(verify(in_cells(found, nodes), texts, similarity))
        links = more if links is None else links.union(more)
    if links is None:
        return nodes.select(F.col("node").alias("th"), "comp").limit(0)
    return components(links).select(F.col("node").alias("th"), F.col("component").alias("comp"))


def _classed(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``nodes`` with comp, the class that the links put a node into."""
    classes = components(links)
    return cut(nodes.drop("comp").join(small(classes), "node", "left").withColumn("comp", F.coalesce("component", "node")).drop("component"))


def near_duplicates(docs: DataFrame, text: str = "text", **settings) -> DataFrame:
    """(doc_id, th, class_id, class_size, kept): one row per row of ``docs``; kept marks one document of each class.

    Rows equal in doc_id and text are both marked if that document is the one kept.
    """
    classes = node_classes(docs, text, **settings)
    rows = docs.select(named("doc_id"), F.xxhash64(named(text)).alias("th"), named(text).isNull().alias("alone"))
    labelled = cut(rows.join(classes, "th", "left").withColumn("comp", F.coalesce("comp", "th")))
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("th"))
    heads = labelled.where("NOT alone").groupBy("comp").agg(F.min(order).alias("head"), F.count("*").alias("n"))
    grouped = labelled.where("NOT alone").join(heads, "comp").select("doc_id", "th", F.col("head.doc_id").alias("class_id"), F.col("n").alias("class_size"), order.eqNullSafe(F.col("head")).alias("kept"))
    alone = labelled.where("alone").select("doc_id", "th", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"), F.lit(True).alias("kept"))
    return grouped.union(alone)


def keep_one(docs: DataFrame, text: str = "text", **settings) -> DataFrame:
    """``docs`` with one document of each class. Of rows equal in doc_id and text one stays, unless the text is null."""
    i, h, th = hidden("id"), hidden("head"), hidden("th")
    heads = near_duplicates(docs, text, **settings).where("kept").select(F.col("doc_id").alias(i), F.col("th").alias(h)).distinct()
    some = docs.where(named(text).isNotNull()).withColumn(th, F.xxhash64(named(text)))
    stay = some.join(heads, named("doc_id").eqNullSafe(F.col(i)) & (F.col(th) == F.col(h)), "left_semi").dropDuplicates(["doc_id", th])
    return stay.select(*given(docs)).union(docs.where(named(text).isNull()))
