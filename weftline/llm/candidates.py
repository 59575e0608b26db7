"""Pairs of rows that share a bucket, and their exact verification: the common part of the near-duplicate operators.

A bucket is all rows with one ``key``; a row is (key, node, comp, n) and, with a distance limit, the integers s0.. of a signature: of a
SimHash, then the limit is ``most`` bits, of a fingerprint of four-bit digits, then it is ``most`` digits, or of an odd sketch (``most`` = ODD). In an odd sketch every element of a set flips one bit, so sketches never differ in
more bits than the sets do in elements, which at a similarity t are at most (1-t)/(1+t) of all: no true pair is lost there. ``comp`` is the class a node is already known to be in: two nodes of one class are never compared again.

* ``neighbours`` takes only rows that stand next to each other in the order of the key. It costs one pair a row however
  large a bucket is, and links most members of a large group before anything is compared all against all.
* ``within`` takes every pair of different classes in a bucket. Buckets of at most LEAF rows go to one task each. Larger ones are cut
  into cells: the rows outside the bucket's largest class in chunks, each against salts of all rows, so that no task
  holds more than about 2 * LEAF rows of a bucket and no pair inside the largest class is looked at.
* ``verify`` computes the Jaccard similarity of whole shingle sets. Pairs are gathered in cells; a text is sent once to a cell, not once
  to a pair, and the intersections of a cell are counted over packed bits.

No pair is left out by a count: the cuts only spread the work. Sizes that rule the similarity out, and a Hamming distance over the
limit, are the only filters.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, small, stored, text_batches
from .components import components
from .shingles import jaccard, shingle_sets

LEAF = 2048  # rows of a bucket that one task takes whole
SMALL = 128  # buckets compared shift by shift, many at a time
BLOCK = 1024
CELL = 1 << 18  # shingles that one side of a verification cell holds, about
BYTES = ["s0", "s1", "s2", "s3"]
SIGNATURE = [f"s{k}" for k in range(16)]
ODD = -1


def distance(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    d = np.bitwise_count(x[..., 0] ^ y[..., 0]).astype(np.int32)
    for k in range(1, x.shape[-1]):
        d += np.bitwise_count(x[..., k] ^ y[..., k])
    return d


def digits_apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many of the four-bit digits differ."""
    d = x ^ y
    d |= d >> np.uint64(1)
    d |= d >> np.uint64(2)
    return np.bitwise_count(d & np.uint64(0x1111111111111111)).sum(axis=-1, dtype=np.int32)


def whole(batches, by: str):
    """The sorted batches, cut so that all rows with one value of ``by`` are together."""
    held: list[pd.DataFrame] = []
    for pdf in batches:
        if not len(pdf):
            continue
        key = pdf[by].to_numpy()
        if held and held[-1][by].iloc[-1] != key[0]:
            yield pd.concat(held, ignore_index=True)
            held = []
        first = int(np.searchsorted(key, key[-1]))
        if first:
            yield pd.concat([*held, pdf.iloc[:first]], ignore_index=True)
            held = []
        held.append(pdf.iloc[first:])
    if held:
        yield pd.concat(held, ignore_index=True)


class _Rows:
    """The rows of some buckets as arrays, and the test that a pair of them must pass."""

    def __init__(self, pdf: pd.DataFrame, similarity: float, most: int | None, masks: np.ndarray | None, shift: int):
        self.node, self.comp, self.n, self.key = (pdf[c].to_numpy() for c in ("node", "comp", "n", "key"))
        self.sig = None if most is None else np.ascontiguousarray(pdf[[c for c in SIGNATURE if c in pdf]].to_numpy()).view(np.uint64)
        self.similarity, self.most, self.masks, self.shift = similarity, most, masks, shift
        self.digits = "s15" in pdf  # a fingerprint of 256 digits

    def keep(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ok = (self.comp[i] != self.comp[j]) & (np.minimum(self.n[i], self.n[j]) >= self.similarity * np.maximum(self.n[i], self.n[j]) - 1e-9)
        i, j = i[ok], j[ok]
        if self.sig is not None and len(i):
            limit = (self.n[i] + self.n[j]) * ((1 - self.similarity) / (1 + self.similarity)) + 1e-9 if self.most == ODD else self.most
            ok = (digits_apart if self.digits else distance)(self.sig[i], self.sig[j]) <= limit
            i, j = i[ok], j[ok]
        return i, j

    def frame(self, i: np.ndarray, j: np.ndarray) -> pd.DataFrame:
        """The pairs (a, b), a > b. With masks, only those that share no bucket of an earlier trie."""
        if self.masks is not None and len(i):
            x, trie = self.sig[i] ^ self.sig[j], self.key[i] >> self.shift
            again = np.zeros(len(i), dtype=bool)
            for t in range(int(trie.max())):
                again |= (trie > t) & ~(x & self.masks[t]).any(axis=1)
            i, j = i[~again], j[~again]
        a, b = self.node[i], self.node[j]
        return pd.DataFrame({"a": np.maximum(a, b), "b": np.minimum(a, b)})

    def blocks(self, rows: np.ndarray, others: np.ndarray, same: bool):
        """Pairs of ``rows`` with ``others`` (each once if these are the same), block by block in the order of their sizes."""
        rows, others = (x[np.argsort(self.n[x], kind="stable")] for x in (rows, others))
        for s in range(0, len(rows), BLOCK):
            x = rows[s : s + BLOCK]
            for t in range(s if same else 0, len(others), BLOCK):
                y = others[t : t + BLOCK]
                if self.n[x[-1]] < self.similarity * self.n[y[0]] - 1e-9:
                    break
                if self.n[y[-1]] < self.similarity * self.n[x[0]] - 1e-9:
                    continue
                ok = self.comp[x][:, None] != self.comp[y][None, :]
                if self.sig is not None and self.most != ODD and not self.digits:
                    ok &= distance(self.sig[x][:, None, :], self.sig[y][None, :, :]) <= self.most
                p, q = np.nonzero(np.triu(ok, 1) if same and s == t else ok)
                if len(p):
                    yield self.keep(x[p], y[q])


def _search(similarity, most, masks, shift, by):
    def search(batches):
        for pdf in whole(batches, by):
            rows = _Rows(pdf, similarity, most, masks, shift)
            cell = pdf[by].to_numpy()
            starts = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
            sizes = np.diff(np.append(starts, len(cell)))
            if by == "key":
                few = sizes <= SMALL
                at = np.flatnonzero(np.repeat(few, sizes))
                for k in range(1, int(sizes[few].max(initial=1))):
                    at = at[at + k < len(cell)]
                    at = at[cell[at] == cell[at + k]]
                    i, j = rows.keep(at, at + k)
                    if len(i):
                        yield rows.frame(i, j)
                for s, m in zip(starts[~few].tolist(), sizes[~few].tolist()):
                    here = np.arange(s, s + m)
                    for i, j in rows.blocks(here, here, True):
                        yield rows.frame(i, j)
            else:
                ask, minor = pdf["ask"].to_numpy(), pdf["minor"].to_numpy()
                for s, m in zip(starts.tolist(), sizes.tolist()):
                    here = np.arange(s, s + m)
                    for i, j in rows.blocks(here[ask[here]], here[~ask[here]], False):
                        once = ~minor[j] | (rows.node[i] > rows.node[j])  # two minor rows meet in two cells
                        yield rows.frame(i[once], j[once])

    return search


def crowded(rows: DataFrame, leaf: int = LEAF) -> DataFrame:
    """(key): the buckets of more than ``leaf`` rows. Counted with partial aggregation."""
    return cut(rows.groupBy("key").count().where(F.col("count") > leaf).select("key"))


def within(rows: DataFrame, similarity: float, most: int | None = None, masks: np.ndarray | None = None, shift: int = 0) -> DataFrame:
    """(a, b), a > b, of different classes, for buckets that one task can take whole."""
    return rows.repartition("key").sortWithinPartitions("key").mapInPandas(_search(similarity, most, masks, shift, "key"), "a long, b long")


def within_crowded(rows: DataFrame, similarity: float, most: int | None = None, masks: np.ndarray | None = None, shift: int = 0, leaf: int | None = None) -> DataFrame:
    """(a, b), a > b, of different classes, for buckets of any size, in cells of about 2 * ``leaf`` rows."""
    leaf = leaf or LEAF
    counts = rows.groupBy("key", "comp").agg(F.count("*").alias("c"))
    tops = cut(counts.groupBy("key").agg(F.sum("c").alias("m"), F.max(F.struct("c", "comp")).alias("top")).where("m > top.c"))
    part = rows.join(small(tops, 100_000), "key").withColumn("minor", F.col("comp") != F.col("top.comp"))
    chunks, salts = F.ceil((F.col("m") - F.col("top.c")) / leaf), F.ceil(F.col("m") / leaf)
    part = part.withColumn("i", F.pmod(F.xxhash64("key", "node"), chunks)).withColumn("r", F.pmod(F.xxhash64("node", "key"), salts))
    asked = part.where("minor").withColumn("ask", F.lit(True)).withColumn("r", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)))
    other = part.withColumn("ask", F.lit(False)).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), chunks - 1)))
    kept = [c for c in rows.columns] + ["minor", "ask", "i", "r"]
    cells = asked.select(*kept).unionByName(other.select(*kept)).withColumn("cell", F.xxhash64("key", "i", "r")).drop("i", "r")
    return cells.repartition("cell").sortWithinPartitions("cell").mapInPandas(_search(similarity, most, masks, shift, "cell"), "a long, b long")


def neighbours(rows: DataFrame, order: list[str], similarity: float, most: int | None = None, shift: int = 0) -> DataFrame:
    """(a, b), a > b: rows of one bucket (``key`` >> ``shift``) next to each other in ``order``, which starts with the key. Ranges of the order are cut
    wherever that balances them, so a large bucket is spread over tasks; a pair across a cut is left to ``within``."""

    def search(batches):
        last = None
        for pdf in batches:
            pdf = pdf if last is None else pd.concat([last, pdf], ignore_index=True)
            if not len(pdf):
                continue
            rows_ = _Rows(pdf, similarity, most, None, 0)
            at = np.flatnonzero((rows_.key[1:] >> shift) == (rows_.key[:-1] >> shift))
            yield rows_.frame(*rows_.keep(at, at + 1))
            last = pdf.iloc[-1:]

    return rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInPandas(search, "a long, b long").distinct()


def similar(sets: dict[int, np.ndarray], a: np.ndarray, b: np.ndarray, at_least: float) -> np.ndarray:
    """Which of the pairs have a Jaccard similarity of ``at_least``, exactly. Intersections are counted over the bits of shared shingles."""
    if len(a) <= 2:
        return np.array([jaccard(sets[x], sets[y]) >= at_least for x, y in zip(a.tolist(), b.tolist())], dtype=bool)
    ids, where = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = where[: len(a)], where[len(a) :]
    n = np.array([len(sets[i]) for i in ids.tolist()])
    cat = np.concatenate([sets[i] for i in ids.tolist()])
    _, column, count = np.unique(cat, return_inverse=True, return_counts=True)
    many = count > 1
    label = np.cumsum(many) - 1
    shared = many[column]
    row, column = np.repeat(np.arange(len(ids)), n)[shared], label[column[shared]]
    both = np.zeros(len(a), dtype=np.int64)
    width = max(64, min(1 << 15, (1 << 25) // len(ids))) // 64 * 64
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    total = int(many.sum())
    edges = np.searchsorted(column, np.arange(0, total + width, width))
    for c, (s, e) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist())):
        if s == e:
            continue
        bits = np.zeros((len(ids), width), dtype=bool)
        bits[row[s:e], column[s:e] - c * width] = True
        packed = np.packbits(bits, axis=1).view(np.uint64)
        step = max(1, (1 << 21) // packed.shape[1])
        for p in range(0, len(a), step):
            both[p : p + step] += np.bitwise_count(packed[x[p : p + step]] & packed[y[p : p + step]]).sum(axis=1, dtype=np.int64)
    return (both > 0) & (both >= at_least * (n[x] + n[y] - both) - 1e-9)


def verify(pairs: DataFrame, texts, similarity: float) -> DataFrame:
    """The pairs (a, b) of ``pairs`` (cell, a, b) that are similar enough. ``texts``: a function from a table of nodes to (node, text)."""

    def check(batches):
        now, sets = None, {}
        for pdf in batches:
            cell, pair, a, b = (pdf[c].to_numpy() for c in ("cell", "pair", "a", "b"))
            at = np.flatnonzero(~pair)
            words = pdf["text"].iloc[at].tolist()
            new = [s for p, q in text_batches(words, 1_000_000) for s in shingle_sets(words[p:q])]
            starts = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])).tolist() if len(cell) else []
            good = np.zeros(len(pdf), dtype=bool)
            for s, e in zip(starts, [*starts[1:], len(cell)]):
                if cell[s] != now:
                    now, sets = cell[s], {}
                middle = s + int((~pair[s:e]).sum())
                first = int(np.searchsorted(at, s))
                sets.update(zip(a[s:middle].tolist(), new[first : first + middle - s]))
                if middle < e:
                    good[middle:e] = similar(sets, a[middle:e], b[middle:e], similarity)
            yield pd.DataFrame({"a": a[good], "b": b[good]})

    pairs = stored(pairs.select("cell", "a", "b"))
    need = pairs.select("cell", F.col("a").alias("node")).union(pairs.select("cell", F.col("b").alias("node"))).distinct()
    found = texts(need.select("node").distinct())
    sides = need.join(found, "node").select("cell", F.lit(False).alias("pair"), F.col("node").alias("a"), F.lit(0).cast("long").alias("b"), "text")
    rows = sides.union(pairs.select("cell", F.lit(True).alias("pair"), "a", "b", F.lit(None).cast("string").alias("text")))
    return rows.repartition("cell").sortWithinPartitions("cell", "pair").mapInPandas(check, "a long, b long").distinct()


def by_node(pairs: DataFrame) -> DataFrame:
    """``pairs`` (a, b) with a cell for each b: for tables in which a node has few partners."""
    return pairs.select(F.col("b").alias("cell"), "a", "b")


def in_cells(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``pairs`` (a, b) with the cell of each. Pairs that hang together are a group; a group is cut into as many parts as its shingles need, and a
    cell is two parts. ``nodes``: node, n."""
    groups = components(pairs)
    weights = groups.join(nodes.select("node", "n"), "node")
    parts = weights.groupBy("component").agg(F.ceil(F.greatest(F.sum("n") / CELL, F.count("*") / 1024)).alias("k"))
    placed = cut(weights.join(parts, "component").select("node", "component", F.pmod(F.xxhash64("node"), F.greatest("k", F.lit(1).cast("long"))).alias("part")))
    one = placed.select(F.col("node").alias("a"), F.col("component"), F.col("part").alias("pa"))
    two = placed.select(F.col("node").alias("b"), F.col("part").alias("pb"))
    return pairs.join(one, "a").join(two, "b").select(F.xxhash64("component", F.least("pa", "pb"), F.greatest("pa", "pb")).alias("cell"), "a", "b")

