"""Substring dedup by paragraph MinHash banding.

Two kinds of passages of a text are compared, as sets of five-word shingles: its paragraphs, which are its lines of at least five words (the size
of a shingle), and overlapping units of UNIT words, which start at words whose three-word hash is the least of a window. A unit's start depends
on the words around it only, so a passage that is set into other text has the same units wherever it stands; WINDOW is chosen such that any 51
words in a row hold a whole unit. Paragraphs and units go through the same steps:

1. Equal passages become one node by hash, with partial aggregation: one that a third of all documents hold is one node.
2. MinHash with bands tuned for high recall: the widest bands, hence the fewest candidates, that find a pair at the threshold
   with the target probability, of those that HASHES hashes allow. Units have so few shingles that all their minima are known: theirs is the
   one-permutation form, one hash whose range is cut in three bands, a band's signature being all hashes in it. Alike units differ in two shingles
   at most, hence in two bands at most, so no pair is missed (``split_keys``).
3. Nodes with an equal band collide. Pairs whose sizes or odd sketches rule the threshold out are dropped in the bucket, which loses no true pair. In buckets of
   more than LEAF rows those that stand next to each other are verified first, which settles large groups, and then only pairs of different classes
   (``candidates``); in smaller ones all pairs. Verification is by exact Jaccard similarity of 0.8 or more.
4. Clusters are the connected components of such links.

A unit within two words of another one of its text, or inside a line of at most 30 words, is 0.8 like that one or that line in any case, and isn't
made. Passages of one cluster that overlap in a text are one occurrence, the first. A document's repeated passages that overlap or touch form a run. Runs of fewer than ``least`` words are left alone: a short sentence that
happens to stand elsewhere too is compared like any other passage, but only counts beside other repeated words.
Of a cluster's passages in the remaining runs the first, by (doc_id, text hash, word), stays and the others are removals; a cluster of which only one
is left is none.

Cases: null, empty and blank texts have no passages. Rows equal in doc_id and text are one document given twice, named once. A passage repeated inside
one document is a repeat as any other. In texts of one phrase repeated the first of equal hashes in a window is taken, so these have units as well.
An empty table gives an empty result. Extra columns, whatever their names, are carried by ``remove``.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .candidates import ODD, by_node, crowded, in_cells, neighbours, verify, within, within_crowded
from .common import cut, hidden, mix64, named, small, stored, text_batches
from .components import components
from .shingles import WORDS, shingle_hashes, words_and_lines

SIMILARITY = 0.8
RECALL = 0.9995
HASHES = 16  # for lines
UNIT_HASHES = 27  # at a similarity below SIMILARITY
LEAF = 256  # rows of a bucket, copies included, that are compared all with all at once
UNIT = 16  # words of a unit
CLOSE = int((1 - SIMILARITY) / (1 + SIMILARITY) * (UNIT - WORDS + 1))  # words by which units may be apart and still be alike
WINDOW = 35  # starts of which at least one begins a unit: UNIT + WINDOW - 1 words in a row hold a whole unit
LEAST = 16  # words of a run that is reported
ROW = "word:int,n_words:int,line:int,comp:long"
FEWEST, WIDEST = int(np.ceil(SIMILARITY * (UNIT - WORDS + 1))), int((UNIT - WORDS + 1) / SIMILARITY + 1e-9)  # shingles of what can be like a unit
SPLITS = 8  # of the hash range, tried in turn while a band has fewer than two shingles
BITMAP = 1 << 26  # bits of a broadcast filter of band keys: 8 MB
CHUNK = 8192  # words of the bitmap in a row
PLACE = ["id", "th", "word", "n_words"]
_ODD = (np.random.default_rng(5).integers(1, 2**63, size=1024, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)


def tune_bands(similarity: float = SIMILARITY, recall: float = RECALL, hashes: int = HASHES) -> tuple[int, int]:
    """(bands, rows a band): the widest bands that find a pair at the threshold with at least this probability."""
    for rows in range(hashes, 0, -1):
        for bands in range(1, hashes // rows + 1):
            if 1 - (1 - similarity**rows) ** bands >= recall:
                return bands, rows
    return hashes, 1


def paragraphs(lines: np.ndarray, offsets: np.ndarray, newlines: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, first word, words, line number) of every line of five words or more. ``lines``: the words' line numbers over all texts;
    ``newlines``: how many the texts before have."""
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    first = np.flatnonzero(np.concatenate([[True], (lines[1:] != lines[:-1]) | (text[1:] != text[:-1])])) if len(lines) else np.zeros(0, dtype=np.int64)
    n = np.diff(np.append(first, len(lines)))
    first, n = first[n >= WORDS], n[n >= WORDS]
    return text[first], first - offsets[text[first]], n, lines[first] - newlines[text[first]]


def unit_starts(words: np.ndarray, offsets: np.ndarray, unit: int = UNIT, window: int = WINDOW) -> np.ndarray:
    """The words (numbers over all texts) that start a unit: in each window of ``window`` words that can start one, the first of the least
    three-word hash. Shorter texts have the least of all words that can start one."""
    count = np.diff(offsets)
    can = np.maximum(count - unit + 1, 0)
    if not can.any():
        return np.zeros(0, dtype=np.int64)
    at = np.repeat(offsets[:-1] - np.concatenate([[0], np.cumsum(can)[:-1]]), can) + np.arange(can.sum())
    text = np.repeat(np.arange(len(can)), can)
    h = mix64(words[at] * np.uint64(3) + words[at + 1] * np.uint64(5) + words[at + 2] * np.uint64(7))
    # the first least of each window, from windows of half its size
    ends = np.cumsum(can)[text]
    best, wide = np.arange(len(at)), 1
    while wide < window:
        step = min(wide, window - wide)
        nxt = best[np.minimum(np.arange(len(at)) + step, ends - 1)]
        best, wide = np.where(h[nxt] < h[best], nxt, best), wide + step
    full = (np.arange(len(at)) + window <= ends) | (np.arange(len(at)) == ends - can[text])
    found = at[np.unique(best[full])]
    same = np.searchsorted(offsets, found, side="right")
    near = np.flatnonzero((np.diff(found) <= CLOSE) & (same[1:] == same[:-1])).tolist()
    if near:
        gone, kept, last = [], -1, -1
        for k in near:
            if k != last:  # a new chain; its first stays
                kept = found[k]
            if found[k + 1] - kept <= CLOSE:
                gone.append(k + 1)
            else:
                kept = found[k + 1]
            last = k + 1
        found = np.delete(found, gone)
    return found


def passages(texts: list[str | None]) -> tuple[np.ndarray, ...]:
    """(text, first word in the text, words, line number or -1, hash) of all paragraphs and units, and the words and offsets they come from."""
    words, offsets, lines = words_and_lines(texts)
    i, w, n, p = paragraphs(lines, offsets, np.cumsum([0, *((t or "").count("\n") for t in texts)]))
    starts = unit_starts(words, offsets)
    if len(i):  # not those inside a line that is like them
        fits = n - WORDS + 1 <= (UNIT - WORDS + 1) / SIMILARITY
        begin, end = offsets[i] + w, offsets[i] + w + n
        at = np.maximum(np.searchsorted(begin, starts, side="right") - 1, 0)
        starts = starts[~((starts >= begin[at]) & (starts + UNIT <= end[at]) & fits[at])]
    of = np.searchsorted(offsets, starts, side="right") - 1
    i, w = np.concatenate([i, of]), np.concatenate([w, starts - offsets[of]])
    n, p = np.concatenate([n, np.full(len(starts), UNIT)]), np.concatenate([p, np.full(len(starts), -1)])
    # a polynomial over the word hashes, by sums over prefixes; of equal units that overlap in a text the first is enough
    first = offsets[i] + w
    powers = np.full(len(words) + 1, np.uint64(0x9E3779B97F4A7C15))
    powers[0] = 1
    inverse = np.full(len(words) + 1, np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64)))
    inverse[0] = 1
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(words * np.multiply.accumulate(powers)[:-1], dtype=np.uint64)])
    h = mix64((sums[first + n] - sums[first]) * np.multiply.accumulate(inverse)[first] + n.astype(np.uint64))
    order = np.lexsort((first, h, i, p >= 0))
    near = (np.diff(first[order], prepend=-UNIT) < UNIT) & (np.diff(i[order], prepend=-1) == 0) & (np.diff(h[order], prepend=np.uint64(0)) == 0) & (p[order] < 0)
    near[:1] = False
    gone, end = [], 0
    for k in np.flatnonzero(near).tolist():
        if not near[k - 1]:
            end = first[order[k - 1]] + UNIT
        if first[order[k]] < end:
            gone.append(order[k])
        else:
            end = first[order[k]] + UNIT
    keep = np.delete(np.arange(len(i)), gone)
    return i[keep], w[keep], n[keep], p[keep], h[keep], words, offsets


def schemes(similarity: float = SIMILARITY, recall: float = RECALL) -> list[tuple[int, int]]:
    """[(bands, rows) of lines, of all passages where the similarity is too low for ``split_keys``]."""
    return [tune_bands(similarity, recall, HASHES), tune_bands(similarity, recall, UNIT_HASHES)]


def band_keys(found: tuple[np.ndarray, ...], bands: int, rows: int, scheme: int = 0, hashed: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """(n x bands) for the passages of ``found``. Minima over units come from minima over fewer shingles, those over lines from their ranges."""
    i, w, n, p, _, words, offsets = found
    shingles, of = hashed or shingle_hashes(words, offsets)
    first, size = of[i] + w, n - WORDS + 1
    unit, line = np.flatnonzero(p < 0), np.flatnonzero(p >= 0)
    ranges = np.stack([first[line], first[line] + size[line]], axis=1).ravel()
    keys = np.zeros((len(i), bands), dtype=np.uint64)
    reach = 1 << ((UNIT - WORDS + 1).bit_length() - 1)
    for b in range(bands):
        for r in range(rows):
            h = shingles * _ODD[scheme * 512 + b * rows + r]
            least = np.zeros(len(i), dtype=np.uint64)
            if len(line):
                least[line] = np.minimum.reduceat(np.append(h, np.uint64(2**64 - 1)), ranges)[::2]
            if len(unit):
                step = 1
                while step < reach:
                    h = np.minimum(h[:-step], h[step:])
                    step *= 2
                least[unit] = np.minimum(h[first[unit]], h[first[unit] + (UNIT - WORDS + 1) - reach])
            keys[:, b] = keys[:, b] * np.uint64(31) + (least >> np.uint64(8))
        keys[:, b] = mix64(keys[:, b] + np.uint64(scheme * 512 + b))
    return keys


def split_keys(found: tuple[np.ndarray, ...], count: np.ndarray, hashed: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(key, number of the passage) for passages of FEWEST to WIDEST different shingles (``count``): any two that are alike, of which one has at most as
    many as a unit, share a key.

    Such two differ in at most two shingles, so one of three bands is equal in both. Or one has WIDEST shingles and all of the unit's twelve: then
    it has three more, and where each is in a band of its own, a band less one shingle is equal: WIDEST shingles give those keys as well. A band of fewer than two
    shingles has no key, since too many passages would share it; who has one goes on to the next split, as does any partner that is equal there.
    """
    i, w, n, _, _, words, offsets = found
    shingles, of = hashed or shingle_hashes(words, offsets)
    first, size = of[i] + w, n - WORDS + 1
    valid = np.arange(WIDEST) < count[:, None]
    elements = shingles[np.minimum(first[:, None] + np.arange(WIDEST), max(len(shingles) - 1, 0))] if len(i) else np.zeros((0, WIDEST), dtype=np.uint64)
    for k in np.flatnonzero(size > count).tolist():  # a shingle twice
        elements[k, : count[k]] = np.unique(shingles[first[k] : first[k] + size[k]])
    rows, keys, at = np.arange(len(i)), [], []
    for split in range(SPLITS):
        band = ((elements * _ODD[768 + split]) >> np.uint64(40)) % np.uint64(3)
        more = np.zeros(len(rows), dtype=bool)
        for b in range(3):
            here = (band == np.uint64(b)) & valid
            held = here.sum(axis=1)
            total = np.where(here, elements, np.uint64(0)).sum(axis=1, dtype=np.uint64) + _ODD[800 + 3 * split + b]
            more |= held < 2
            r, c = np.nonzero(here & (valid[:, -1] & (held > 2))[:, None])
            keys += [total[held >= 2], total[r] - elements[r, c]]
            at += [rows[held >= 2], rows[r]]
        rows, elements, valid = rows[more], elements[more], valid[more]
    keys.append(np.full(len(rows), _ODD[799]))  # one in some 100,000 passages or fewer
    at.append(rows)
    return mix64(np.concatenate(keys)), np.concatenate(at)


def sketches(found: tuple[np.ndarray, ...], hashed: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(number of distinct shingles, their odd sketch of 64 bits) of each passage."""
    i, w, n, _, _, words, offsets = found
    shingles, of = hashed or shingle_hashes(words, offsets)
    first, size = of[i] + w, n - WORDS + 1
    order = np.argsort(shingles, kind="stable")
    before = np.full(len(shingles) + 1, -1)
    same = shingles[order[1:]] == shingles[order[:-1]]
    before[order[1:][same]] = order[:-1][same]
    flips = np.concatenate([np.zeros(1, dtype=np.uint64), np.bitwise_xor.accumulate(np.uint64(1) << (shingles >> np.uint64(58)))])
    sketch, count = flips[first + size] ^ flips[first], size.copy()
    if len(i):
        ranges = np.stack([first, first + size], axis=1).ravel()
        for k in np.flatnonzero(np.maximum.reduceat(before, ranges)[::2] >= first).tolist():  # a shingle twice
            once = np.unique(shingles[first[k] : first[k] + size[k]])
            count[k], sketch[k] = len(once), np.bitwise_xor.reduce(np.uint64(1) << (once >> np.uint64(58)))
    return count, sketch


def banded(texts: list[str | None], tuned: list[tuple[int, int] | None]) -> tuple[np.ndarray, ...]:
    """(key, number of the passage), and the passages with their sketches. Lines of about as many different shingles as a unit has also get the units' bands
    (None: ``split_keys``), and units of fewer, which repeat themselves, those of lines. Units' bands that aren't None are those of all passages."""
    found = passages(texts)
    i, w, n, p, h, words, offsets = found
    hashed = shingle_hashes(words, offsets)
    count, sketch = sketches(found, hashed)
    line, full = p >= 0, UNIT - WORDS + 1
    whole = tuned[1] is not None
    of_line = (line | (count < full)) & (not whole)
    of_unit = ((count >= FEWEST) & (count <= WIDEST)) | whole
    keys, at = [], []
    for scheme, (which, how) in enumerate(zip((of_line, of_unit), tuned)):
        which = np.flatnonzero(which)
        part = (*(x[which] for x in (i, w, n, p, h)), words, offsets)
        if how is None:
            k, of = split_keys(part, count[which], hashed)
        else:
            k, of = band_keys(part, *how, scheme, hashed).ravel(), np.repeat(np.arange(len(which)), how[0])
        keys.append(k)
        at.append(which[of])
    return np.concatenate(keys), np.concatenate(at), found, count, sketch


def _texts_of(docs: DataFrame, text: str) -> DataFrame:
    t = named(text)
    return docs.where(t.isNotNull()).select(named("doc_id").cast("string").alias("id"), F.xxhash64(t).alias("th"), t.alias("text"))  # as text, an id stays exact beside nulls


def _occurrences(docs: DataFrame, text: str, tuned: list[tuple[int, int] | None]) -> DataFrame:
    """(ph, id, th, word, n_words, line, n, s0, keys): every paragraph (line its number) and unit (line -1), with the number of its shingles, the odd
    sketch and the band keys."""

    def find(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in text_batches(texts, 500_000):
                keys, at, (i, w, n, p, h, *_), count, sketch = banded(texts[a:b], tuned)
                ends = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=len(i)))]).astype("int32")
                lists = pa.ListArray.from_arrays(ends, keys[np.argsort(at, kind="stable")].view(np.int64))
                place = pa.array(i + a)
                made = [pa.array(x) for x in (h.view(np.int64), w.astype("int32"), n.astype("int32"), p.astype("int32"), count.astype("int32"), sketch.view(np.int64))]
                yield pa.RecordBatch.from_arrays([made[0], batch.column("id").take(place), batch.column("th").take(place), *made[1:], lists], names=["ph", "id", "th", "word", "n_words", "line", "n", "s0", "keys"])

    rows = _texts_of(docs, text).withColumn("id", F.col("id").cast("long"))
    return rows.mapInArrow(find, "ph long, id long, th long, word int, n_words int, line int, n int, s0 long, keys array<long>")


def _wanted(held: DataFrame, wanted) -> DataFrame:
    """(node, n, s0, key): for every occurrence those of its keys that the broadcast bitmap ``wanted`` may have."""

    def choose(batches):
        for batch in batches:
            lists = batch.column("keys")
            keys = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            bit = keys & np.uint64(BITMAP - 1)
            ok = (wanted.value[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) == 1
            at = pa.array(np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))[ok])
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in ("ph", "n", "s0")), pa.array(keys[ok].view(np.int64))], names=["node", "n", "s0", "key"])

    return held.select("ph", "n", "s0", "keys").mapInArrow(choose, "node long, n int, s0 long, key long")


def _bitmap(keys: DataFrame):
    """A broadcast bitmap of BITMAP bits, whatever the number of keys, in which the bit of each key is set. With very many keys it lets all pass."""
    bit = F.col("key").bitwiseAND(F.lit(BITMAP - 1))
    words = keys.groupBy(F.shiftright(bit, 6).cast("int").alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(key & 63 as int))")).alias("bits"))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        part = np.zeros(CHUNK, dtype=np.int64)
        part[pdf["at"].to_numpy() % CHUNK] = pdf["bits"].to_numpy()
        return pd.DataFrame({"chunk": [int(pdf["at"].iloc[0]) // CHUNK], "bits": [part.tobytes()]})

    out = np.zeros(BITMAP >> 6, dtype=np.uint64)
    # BITMAP / 8 bytes in all reach the driver, packed, in 128 rows
    for r in words.withColumn("chunk", F.floor(F.col("at") / CHUNK)).groupBy("chunk").applyInPandas(pack, "chunk int, bits binary").collect():
        out[r["chunk"] * CHUNK : (r["chunk"] + 1) * CHUNK] = np.frombuffer(r["bits"], dtype=np.uint64)
    return keys.sparkSession.sparkContext.broadcast(out)


def _texts(docs: DataFrame, text: str, places: DataFrame) -> DataFrame:
    """(node, text) of the passages in ``places`` (node, id, th, word, n_words)."""

    def pick(batches):
        for pdf in batches:
            out = []
            for t, wanted in zip(pdf["text"], pdf["wanted"]):
                words = t.split()
                out += [(x["node"], " ".join(words[x["word"] : x["word"] + x["n_words"]])) for x in wanted]
            yield pd.DataFrame(out, columns=["node", "text"])

    wanted = cut(places.groupBy("id", "th").agg(F.collect_list(F.struct("node", "word", "n_words")).alias("wanted")).withColumnsRenamed({"id": "i", "th": "h"}))
    same = F.col("id").cast("long").eqNullSafe(F.col("i")) & (F.col("th") == F.col("h"))
    joined = _texts_of(docs, text).join(small(wanted.select("i", "h")), same, "left_semi").join(wanted, same).select("text", "wanted")
    return joined.mapInPandas(pick, "node long, text string")


def _links(docs: DataFrame, text: str, held: DataFrame, similarity: float) -> DataFrame | None:
    """(a, b): verified links between nodes of different texts that make up their classes. ``held``: all occurrences."""
    # keys of several nodes; the copies of one node are none
    seen = held.select(F.col("ph").alias("node"), F.explode("keys").alias("key")).groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi"))
    shared = stored(seen.where("lo < hi").select("key"))
    if shared.isEmpty():
        return None
    met = stored(_wanted(held, _bitmap(shared)).join(shared, "key").withColumn("comp", F.col("node")))
    many = cut(met.groupBy("key").count().where(F.col("count") > LEAF).select("key"))

    def texts(wanted: DataFrame) -> DataFrame:
        places = held.join(small(cut(wanted)), F.col("ph") == F.col("node")).groupBy("node").agg(F.min(F.struct(*PLACE)).alias("at")).select("node", "at.*")
        return _texts(docs, text, places)

    held_keys = small(many)
    found, links = within(met.join(held_keys, "key", "left_anti"), similarity, ODD), None
    if not many.isEmpty():
        full = stored(met.join(held_keys, "key", "left_semi").groupBy("key", "node", "comp").agg(F.max("n").alias("n"), F.max("s0").alias("s0")))
        first = cut(neighbours(full, ["key", "s0", "node"], similarity, ODD))
        links = cut(verify(by_node(first), texts, similarity))
        classes = components(links).withColumnRenamed("node", "x")
        known = stored(full.drop("comp").join(small(classes), F.col("node") == F.col("x"), "left").withColumn("comp", F.coalesce("component", "node")).drop("x", "component"))
        dense = crowded(known)
        found = found.union(within(known.join(dense, "key", "left_anti"), similarity, ODD)).union(within_crowded(known.join(dense, "key", "left_semi"), similarity, ODD))
        found = found.join(first, ["a", "b"], "left_anti")  # what failed among the neighbours needn't be tried again
    found = cut(found.distinct())
    if found.isEmpty():
        return links
    more = cut(verify(in_cells(found, met.groupBy("node").agg(F.max("n").alias("n"))), texts, similarity))
    return more if links is None else links.union(more)


def repeats(docs: DataFrame, text: str = "text", similarity: float = SIMILARITY, recall: float = RECALL, least: int = LEAST) -> DataFrame:
    """(doc_id, th, kind, paragraph, start_word, n_words, cluster, first_doc_id, removed): every repeated passage in a run of ``least`` words or more.
    kind is paragraph (then with its line number) or unit."""
    tuned = schemes(similarity, recall)
    if similarity >= SIMILARITY:
        tuned[1] = None
    held = stored(_occurrences(docs, text, tuned))
    links = _links(docs, text, held, similarity)
    here = F.xxhash64(*PLACE)  # two places, not one place given twice
    many = held.groupBy("ph").agg(F.min(here).alias("lo"), F.max(here).alias("hi")).where("lo < hi").select("ph", F.col("ph").alias("comp"))
    if links is not None:
        classes = components(links).select(F.col("node").alias("x"), "component")
        many = many.join(classes, F.col("ph") == F.col("x"), "full").select(F.coalesce("ph", "x").alias("ph"), F.coalesce("component", "comp").alias("comp"))
    found = held.join(small(cut(many)), "ph").select("id", "th", "word", "n_words", "line", "comp").distinct()

    @F.pandas_udf(f"array<struct<{ROW}>>")
    def apart(lists: pd.Series) -> pd.Series:
        out = []
        for rows in lists:
            ends: dict[int, int] = {}
            kept = []
            for x in sorted(rows, key=lambda x: (x["word"], -x["n_words"])):
                if x["word"] >= ends.get(x["comp"], 0):
                    ends[x["comp"]] = x["word"] + x["n_words"]
                    kept.append(x)
            out.append(kept)
        return pd.Series(out, dtype=object)

    @F.pandas_udf(f"array<struct<{ROW}>>")
    def long_runs(lists: pd.Series) -> pd.Series:
        out = []
        for rows in lists:
            kept, run, end = [], [], 0
            for x in sorted(rows, key=lambda x: (x["word"], -x["n_words"])):
                if run and x["word"] > end:
                    kept += run if end - run[0]["word"] >= least else []
                    run = []
                end = max(end, x["word"] + x["n_words"]) if run else x["word"] + x["n_words"]
                run.append(x)
            out.append(kept + (run if run and end - run[0]["word"] >= least else []))
        return pd.Series(out, dtype=object)

    def by_text(rows: DataFrame, f) -> DataFrame:
        lists = rows.groupBy("id", "th").agg(F.collect_list(F.struct("word", "n_words", "line", "comp")).alias("rows"))
        return stored(lists.select("id", "th", F.explode(f("rows")).alias("x")).select("id", "th", "x.*"))

    def again(rows: DataFrame) -> DataFrame:
        return rows.groupBy("comp").agg(F.min(F.struct(*PLACE)).alias("head"), F.count("*").alias("c")).where("c > 1").withColumnRenamed("comp", "cluster")

    rows = by_text(found, apart)
    rows = by_text(rows.join(again(rows), F.col("comp") == F.col("cluster"), "left_semi"), long_runs)
    heads = again(rows)
    out = rows.join(heads, F.col("comp") == F.col("cluster"))
    return out.select(
        F.col("id").alias("doc_id"), "th", F.when(F.col("line") < 0, "unit").otherwise("paragraph").alias("kind"), F.when(F.col("line") >= 0, F.col("line")).alias("paragraph"), F.col("word").alias("start_word"), "n_words",
        "cluster", F.col("head.id").alias("first_doc_id"), (~F.struct(*PLACE).eqNullSafe(F.col("head"))).alias("removed"))


_WORD = re.compile(r"\S+")


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without these spans of words (start, count) and the white space after them."""
    gone = {w for a, n in spans for w in range(a, a + n)}
    out, at = [], 0
    for i, m in enumerate(_WORD.finditer(text)):
        if i in gone:
            out.append(text[at : m.start()])
            at = m.end()
            while at < len(text) and text[at] in " \t":
                at += 1
    out.append(text[at:])
    return "".join(out)


def remove(docs: DataFrame, text: str = "text", **settings) -> DataFrame:
    """``docs`` without the words of removals. A word that a passage which stays covers as well goes too: another place has it."""
    i, h, g = hidden("id"), hidden("th"), hidden("gone")
    gone = repeats(docs, text, **settings).where("removed").groupBy(F.col("doc_id").alias(i), F.col("th").alias(h)).agg(F.collect_list(F.struct("start_word", "n_words")).alias(g))

    @F.pandas_udf("string")
    def rest(texts: pd.Series, gone: pd.Series) -> pd.Series:
        return pd.Series([t if x is None else without(t, [(s["start_word"], s["n_words"]) for s in x]) for t, x in zip(texts, gone)], dtype=object)

    j = docs.join(gone, named("doc_id").cast("long").eqNullSafe(F.col(i)) & (F.xxhash64(named(text)) == F.col(h)), "left")
    return j.select(*[rest(named(text), F.col(g)).alias(c) if c == text else named(c) for c in docs.columns])
