"""Document fingerprints by a randomised edit embedding.

All texts walk with the same random bits: at step j a text whose pointer is at character c emits c, and moves on if bit
(j, c) is set. Two texts at a small edit distance fall back into step soon after each edit, so the number of steps at which they
emit different characters, a Hamming distance, follows their edit distance.

A fingerprint samples SLOTS steps, uniform over the embedding and shared by all texts: slot k takes the step of the least
random value among the first 2n steps, n being the text's length, so texts of like lengths mostly sample the same steps. Each
sample is kept as a hash of slot, step and character in one hexadecimal digit. ``likeness`` is the share of equal digits,
corrected for chance. ``near_classes`` bands the digits (bit sampling), compares all texts that share a band,
and verifies the likeness of whole fingerprints.

``edited`` compares each document with a half-replaced version of itself and with the next document by ascending doc_id. Documents
are split into ranges of ids whose bounds are known; the first document of a range is sent to the range before it, so texts are
shuffled once and no range is gathered as a whole.

Cases: a null text counts as empty, and empty texts have the fingerprint of sixteens ("g"). Rows of equal doc_id follow each other
by text hash; null ids come first. The only row of a table is its own next. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .candidates import LEAF, crowded, neighbours, within, within_crowded
from .common import code_points, cut, given, hidden, mix64, named, small, stored, text_batches
from .components import components

SLOTS = 256
LETTERS = 64
PERIOD = 1 << 14  # steps after which the walk's bits come again
BAND = 8
SEED = 31
FEW = 48  # documents still walking, from which plain loops are faster than array steps


@cache
def _dwell() -> np.ndarray:
    """(letters x period): how many steps a pointer stays that comes to a letter at a step."""
    bits = np.random.default_rng(SEED).random((LETTERS, 2 * PERIOD)) < 0.5
    bits[:, PERIOD:] = bits[:, :PERIOD]
    out = np.zeros((LETTERS, 2 * PERIOD), dtype=np.uint8)
    left = np.full(LETTERS, 1, dtype=np.int64)
    for j in range(2 * PERIOD - 1, -1, -1):
        left = np.where(bits[:, j], 1, np.minimum(left + 1, 255))
        out[:, j] = left
    return np.ascontiguousarray(out[:, :PERIOD])


@cache
def _records() -> list[np.ndarray]:
    """For each slot the steps at which a running minimum of random values falls, in ascending order."""
    out = []
    for k in range(SLOTS):
        rng, found = np.random.default_rng([SEED, k]), [0]
        while found[-1] < 1 << 40:
            found.append(int((found[-1] + 1) / rng.random()))
        out.append(np.array(found, dtype=np.int64))
    return out


def _letters(points: np.ndarray) -> np.ndarray:
    return ((points.astype(np.uint32) * np.uint32(2654435761)) >> np.uint32(26)).astype(np.uint8)


def _walk(letters: np.ndarray, starts: np.ndarray, lengths: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the step at which each character is come to, the step after the last), from step ``at`` of each text on."""
    dwell = _dwell()
    flat = dwell.ravel()
    steps = np.zeros(len(letters), dtype=np.int64)
    order = np.argsort(-lengths, kind="stable")
    s, n, t = starts[order], lengths[order], at[order].astype(np.int64)
    longest = int(n[0]) if len(n) else 0
    active = np.searchsorted(-n, -np.arange(1, longest + 1), side="right") if longest else np.zeros(0, dtype=int)
    i = 0
    base = letters.astype(np.int32) * PERIOD
    while i < longest and active[i] > FEW:
        a = active[i]
        place = s[:a] + i
        steps[place] = t[:a]
        t[:a] += flat[base[place] + (t[:a] & (PERIOD - 1))]
        i += 1
    if i < longest:
        rows = [bytes(r) for r in dwell]
        mask = PERIOD - 1
        for k in range(int(active[i])):
            x, out = int(t[k]), []
            add = out.append
            for c in letters[s[k] + i : s[k] + n[k]].tobytes():
                add(x)
                x += rows[c][x & mask]
            steps[s[k] + i : s[k] + n[k]] = out
            t[k] = x
    end = np.empty_like(t)
    end[order] = t
    return steps, end


def _sample(points: np.ndarray, steps: np.ndarray, starts: np.ndarray, lengths: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """(texts x SLOTS) digits 0..15, or 16 for an empty text."""
    reach = 2 * lengths
    where = np.stack([r[np.maximum(np.searchsorted(r, reach) - 1, 0)] for r in _records()], axis=1)
    symbol = np.zeros((len(starts), SLOTS), dtype=np.uint64)
    for d in range(len(starts)):
        a, n = starts[d], lengths[d]
        if n:
            own = steps[a : a + n]
            i = np.searchsorted(own, where[d], side="right") - 1
            symbol[d] = points[a + i]
    past = where >= ends[:, None]
    symbol = np.where(past, np.uint64(0x110000), symbol)
    slot = np.arange(SLOTS, dtype=np.uint64) << np.uint64(54)
    digits = (mix64(slot + (where.astype(np.uint64) << np.uint64(21)) + symbol) >> np.uint64(60)).astype(np.uint8)
    digits[lengths == 0] = 16
    return digits


_DIGITS = np.frombuffer(b"0123456789abcdefg", dtype=np.uint8)


def _string(digits: np.ndarray) -> list[str]:
    return [bytes(r).decode("ascii") for r in _DIGITS[digits]]


def likeness_of(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """0 to 1: the share of equal digits, corrected for chance."""
    return np.clip(((a == b).mean(axis=1) - 1 / 16) * 16 / 15, 0.0, 1.0)


def fingerprints(texts: list[str | None]) -> np.ndarray:
    """(n x SLOTS) digits."""
    points, ends = code_points(texts)
    lengths = np.diff(ends)
    steps, stop = _walk(_letters(points), ends[:-1], lengths, np.zeros(len(texts), dtype=np.int64))
    return _sample(points, steps, ends[:-1], lengths, stop)


def _pair_fingerprints(texts: list[str], others: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of the texts and of their edited versions, whose common first halves are walked once."""
    heads = [t[: len(t) - len(t) // 2] for t in texts]
    tails = [t[len(t) - len(t) // 2 :] for t in texts]
    swaps = [o[: len(t) // 2] for t, o in zip(texts, others)]
    n = len(texts)
    hp, he = code_points(heads)
    hs, hend = _walk(_letters(hp), he[:-1], np.diff(he), np.zeros(n, dtype=np.int64))
    tp, te = code_points([*tails, *swaps])
    ts, tend = _walk(_letters(tp), te[:-1], np.diff(te), np.concatenate([hend, hend]))
    out = []
    for k in (0, 1):
        starts = np.zeros(n + 1, dtype=np.int64)
        own = te[k * n : k * n + n + 1]
        lengths = np.diff(he) + np.diff(own)
        np.cumsum(lengths, out=starts[1:])
        points, steps = np.empty(starts[-1], dtype=np.uint32), np.empty(starts[-1], dtype=np.int64)
        for i in range(n):
            a, m = starts[i], starts[i] + he[i + 1] - he[i]
            points[a:m], steps[a:m] = hp[he[i] : he[i + 1]], hs[he[i] : he[i + 1]]
            points[m : starts[i + 1]], steps[m : starts[i + 1]] = tp[own[i] : own[i + 1]], ts[own[i] : own[i + 1]]
        out.append(_sample(points, steps, starts[:-1], lengths, tend[k * n : k * n + n]))
    return out[0], out[1]


def _bucket(value, bounds: list, low: int, high: int):
    """How many bounds are at most ``value``, as a binary search; 0 for null."""
    if low == high:
        return F.lit(low)
    mid = (low + high) // 2
    return F.when(value >= F.lit(bounds[mid]), _bucket(value, bounds, mid + 1, high)).otherwise(_bucket(value, bounds, low, mid))


def with_next(docs: DataFrame, text: str = "text", ranges: int | None = None) -> DataFrame:
    """(id, text, bucket, guest) sorted within partitions; the row after a document's is the next document's."""
    spark = docs.sparkSession
    ranges = ranges or min(4096, 3 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    ids = docs.select(named("doc_id").cast("long").alias("id"))
    bounds = sorted({int(x) for x in ids.approxQuantile("id", [k / ranges for k in range(1, ranges)], 0.2 / ranges)})
    rows = docs.select(named("doc_id").cast("long").alias("id"), F.xxhash64(F.coalesce(named(text), F.lit(""))).alias("th"), named(text).alias("text"))
    rows = rows.withColumn("bucket", _bucket(F.col("id"), bounds, 0, len(bounds)))
    place = F.struct("id", "th")
    # at most ``ranges`` rows reach the driver and are broadcast
    firsts = sorted(rows.groupBy("bucket").agg(F.min(place).alias("first")).collect(), key=lambda r: r["bucket"])
    sent = [(r["bucket"], firsts[i - 1]["bucket"], r["first"]["id"], r["first"]["th"]) for i, r in enumerate(firsts)]
    heads = spark.createDataFrame(sent, "bucket int, before int, fid long, fth long")
    marked = rows.join(F.broadcast(heads), "bucket")
    is_first = F.col("id").eqNullSafe(F.col("fid")) & (F.col("th") == F.col("fth"))
    own = F.struct(F.col("bucket").alias("bucket"), F.lit(0).alias("guest"))
    guest = F.struct(F.col("before").alias("bucket"), F.lit(1).alias("guest"))
    spread = marked.select("id", "th", "text", F.explode(F.when(is_first, F.array(own, guest)).otherwise(F.array(own))).alias("x"))
    return spread.select(F.col("id").cast("string").alias("id"), F.col("text"), "x.bucket", "x.guest", F.col("id").alias("__id"), "th").repartition("bucket").sortWithinPartitions("bucket", "guest", "__id", "th").select("id", "text", "bucket", "guest")


def edited(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)."""

    def compare(batches):
        last = None
        for pdf in batches:
            if last is not None:
                pdf = pd.concat([last, pdf], ignore_index=True)
            last = pdf.iloc[-1:]
            texts = [t or "" for t in pdf["text"].tolist()]
            bucket, guest, ids = pdf["bucket"].to_numpy(), pdf["guest"].to_numpy(), pdf["id"].tolist()
            for a, b in text_batches(texts, 3_000_000):
                b = min(b, len(texts) - 1)
                rows = [i for i in range(a, b) if not guest[i]]
                if not rows:
                    continue
                if any(bucket[i] != bucket[i + 1] for i in rows):
                    raise RuntimeError("a range of ids ends without the document after it")
                own, others = [texts[i] for i in rows], [texts[i + 1] for i in rows]
                print_own, print_edited = _pair_fingerprints(own, others)
                # the next document's print: the next row's, but for the last row of a run, where it is made anew
                place = {i: k for k, i in enumerate(rows)}
                alone = [k for k, i in enumerate(rows) if i + 1 not in place]
                nxt = print_own[[place.get(i + 1, 0) for i in rows]]
                if alone:
                    nxt[alone] = fingerprints([others[k] for k in alone])
                changed = [t[: len(t) - len(t) // 2] + o[: len(t) // 2] for t, o in zip(own, others)]
                yield pd.DataFrame({
                    "doc_id": [ids[i] for i in rows], "n_chars": np.array([len(t) for t in own], dtype="int64"),
                    "edited_sha256": [hashlib.sha256(t.encode("utf-8")).hexdigest() for t in changed],
                    "fingerprint": _string(print_own), "edited_fingerprint": _string(print_edited),
                    "near_edited": likeness_of(print_own, print_edited), "near_next": likeness_of(print_own, nxt),
                })

    schema = "doc_id string, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_next(docs, text).mapInPandas(compare, schema).withColumn("doc_id", F.col("doc_id").cast("long"))


def fingerprint(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the column fingerprint, which replaces one of that name."""

    @F.pandas_udf("string")
    def make(column: pd.Series) -> pd.Series:
        texts = column.tolist()
        return pd.Series([x for a, b in text_batches(texts) for x in _string(fingerprints(texts[a:b]))], dtype=object)

    return docs.select(*given(docs, "fingerprint"), make(named(text)).alias("fingerprint"))


def likeness(a, b):
    """Of two fingerprint columns, with built-in functions."""
    same = F.aggregate(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (same / F.lit(SLOTS) - 1 / 16) * 16 / 15))


def near_classes(printed: DataFrame, least: float = 0.8, column: str = "fingerprint", leaf: int | None = None) -> DataFrame:
    """``printed`` (with a fingerprint column) with near_class, the least fingerprint hash of the component of links of likeness ``least`` or more, and
    near_links, whether the fingerprint has one to a different fingerprint. Both null for a null fingerprint.

    Bit sampling: a band is BAND digits, of slots that are random steps of the walk. All fingerprints that share a band are compared (in crowded
    bands, class against class), and a pair is verified by the likeness of the whole fingerprints. A pair at the threshold shares a band
    with probability 1 - (1 - p**BAND)**bands, p being the share of equal digits: 0.9999 at a likeness of 0.8.
    """
    most = int((1 - (least * 15 / 16 + 1 / 16)) * SLOTS + 1e-9)
    bands = SLOTS // BAND
    h, node, comp, col = hidden("h"), hidden("node"), hidden("comp"), named(column)
    prints = printed.where(col.isNotNull()).select(F.xxhash64(col).alias("node"), col.alias("fp")).groupBy("node").agg(F.first("fp").alias("fp"))

    def sign(batches):
        for pdf in batches:
            digits = np.array([np.frombuffer(x.encode("ascii"), dtype=np.uint8) for x in pdf["fp"]], dtype=np.uint8).reshape(len(pdf), -1)
            full = (digits <= ord("f")).all(axis=1)  # an empty text is like no other fingerprint
            pdf, digits = pdf[full], digits[full]
            low = np.where(digits >= ord("a"), digits - ord("a") + 10, digits - ord("0")).astype(np.uint64)
            words = (low.reshape(len(pdf), SLOTS // 16, 16) << (np.arange(16, dtype=np.uint64) * np.uint64(4))).sum(axis=2, dtype=np.uint64)
            parts = words.view(np.uint32).astype(np.uint64)  # eight digits each
            keys = mix64(parts + (np.arange(parts.shape[1], dtype=np.uint64) << np.uint64(32)))
            out = pd.DataFrame({"node": pdf["node"].to_numpy(), "keys": list(keys.view(np.int64))})
            yield out.assign(**{f"s{k}": words[:, k].view(np.int64) for k in range(SLOTS // 16)})

    signature = [f"s{k}" for k in range(SLOTS // 16)]
    signed = stored(prints.mapInPandas(sign, "node long, keys array<long>, " + ", ".join(f"{c} long" for c in signature)))
    keyed = signed.select("node", F.explode("keys").alias("key"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("c")).where("c > 1")
    met = stored(keyed.join(sizes.select("key"), "key", "left_semi"))
    rows = met.join(signed.drop("keys"), "node").withColumn("comp", F.col("node")).withColumn("n", F.lit(1).cast("long"))
    dense = small(crowded(met, leaf or LEAF))
    links = within(rows.join(dense, "key", "left_anti"), least, most)
    packed = rows.join(dense, "key", "left_semi")
    first = cut(neighbours(packed, ["key", "s0", "s1", "node"], least, most))
    classes = components(first).select(F.col("node").alias("x"), "component")
    known = packed.drop("comp").join(classes, F.col("node") == F.col("x"), "left").withColumn("comp", F.coalesce("component", "node")).drop("x", "component")
    links = cut(links.union(first).union(within_crowded(known, least, most, leaf=leaf)).distinct())
    found = components(links).select(F.col("node").alias(node), F.col("component").alias(comp))
    joined = printed.withColumn(h, F.xxhash64(col)).join(small(cut(found)), F.col(h) == F.col(node), "left")
    return joined.select(
        *given(printed, "near_class", "near_links"), F.when(col.isNotNull(), F.coalesce(F.col(comp), F.col(h))).alias("near_class"),
        F.when(col.isNotNull(), F.col(comp).isNotNull()).alias("near_links"))
