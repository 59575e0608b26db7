"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

Text is split by the tokenizer's pattern and each match is merged on its own. The bytes of a match form a linked list.
Every adjacent pair that is in the vocabulary stands in the bucket of its rank as the position of its left element. A
bitmap of the non-empty buckets, with a bitmap of its non-zero words above it, finds the lowest rank by two
find-first-set steps, however many ranks there are (up to 65,536). Merging a pair links its right element out and adds the two
new pairs; what the merge made stale stays in its bucket and is skipped when it comes up. A match of n bytes takes about
n log n steps, where rescanning for the lowest pair would take n squared.

Within one rank the leftmost position goes first, so the ids are those of the usual greedy merge.

Each Python worker keeps the ids of matches it has met in two generations of bounded size, so memory is bounded too.

Cases: a null text counts as empty: no ids, and the hashes of nothing. Rows are encoded one by one.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from heapq import heappop, heappush

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import given, hidden, named

CACHED = 300_000  # matches in one generation
CACHED_BYTES = 64  # longer matches aren't kept


BIT = [1 << k for k in range(256)]


class Bpe:
    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks = ranks
        self.find = regex.compile(pattern).findall
        self.tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        assert len(self.tokens) <= 1 << 16, "two levels of 256 bits"
        self.low = [0] * 256  # the rank queue's lower level; all zero between calls
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    @classmethod
    def load(cls, path: str, pattern: str) -> "Bpe":
        with open(path, "rb") as f:
            pairs = (line.split() for line in f if line.strip())
            return cls({base64.b64decode(t): int(r) for t, r in pairs}, pattern)

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one match."""
        ranks = self.ranks
        whole = ranks.get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        ends = list(range(1, n + 1))  # ends[i]: where the part that starts at i ends
        before = list(range(-1, n))  # before[i]: where the part that ends at i starts
        now = [-1] * n  # now[i]: the rank of the pair whose left part starts at i, -1 where it isn't one
        # The rank queue: bit r of the lower level says that rank r has a bucket, in words of 256 bits (Python's integers
        # are as wide as need be); top has a bit for each word that isn't zero. Lists of positions are heaps.
        buckets: dict[int, list[int]] = {}
        low, top, get = self.low, 0, ranks.get
        for i in range(n - 1):
            r = get(piece[i : i + 2])
            if r is not None:
                now[i] = r
                if r in buckets:
                    buckets[r].append(i)
                else:
                    buckets[r] = [i]
                    low[r >> 8] |= BIT[r & 255]
                    top |= BIT[r >> 8]
        while top:
            a = (top & -top).bit_length() - 1
            x = low[a]
            b = (x & -x).bit_length() - 1
            rank = (a << 8) + b
            bucket = buckets[rank]
            lower = False
            while bucket and not lower:
                i = heappop(bucket) if len(bucket) > 1 else bucket.pop()
                if now[i] != rank:
                    continue  # stale: one of the two parts has grown since, or is gone
                mid = ends[i]
                end = ends[mid]
                ends[i] = end
                before[end] = i
                now[mid] = now[i] = -1
                if end < n:
                    r = get(piece[i : ends[end]])
                    if r is not None:
                        now[i] = r
                        lower = r < rank
                        if r in buckets:
                            heappush(buckets[r], i)
                        else:
                            buckets[r] = [i]
                            low[r >> 8] |= BIT[r & 255]
                            top |= BIT[r >> 8]
                if i:
                    j = before[i]
                    r = get(piece[j:end])
                    if r is None:
                        now[j] = -1
                    else:
                        now[j] = r
                        lower = lower or r < rank
                        if r in buckets:
                            heappush(buckets[r], j)
                        else:
                            buckets[r] = [j]
                            low[r >> 8] |= BIT[r & 255]
                            top |= BIT[r >> 8]
            if not bucket:
                del buckets[rank]
                low[a] ^= BIT[b]
                if not low[a]:
                    top ^= BIT[a]
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : ends[i]]])
            i = ends[i]
        return out

    def piece(self, match: str) -> bytes:
        """The ids of a match as packed 32-bit integers."""
        packed = self.old.get(match)
        if packed is None:
            packed = array("I", self.merge(match.encode("utf-8"))).tobytes()
            if len(match) > CACHED_BYTES:
                return packed
        if len(self.young) >= CACHED:
            self.old, self.young = self.young, {}
        self.young[match] = packed
        return packed

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        out = []
        add, piece = out.append, self.piece
        for match in self.find(text):
            add(self.young.get(match) or piece(match))
        return b"".join(out)

    def decode(self, packed: bytes) -> bytes:
        ids = array("I")
        ids.frombytes(packed)
        return b"".join(map(self.tokens.__getitem__, ids))


assert array("I").itemsize == 4

_loaded: dict[tuple[str, str], Bpe] = {}


def tokenizer(path: str, pattern: str) -> Bpe:
    """One per Python worker; the vocabulary's file must be on every executor."""
    if (path, pattern) not in _loaded:
        _loaded[path, pattern] = Bpe.load(path, pattern)
    return _loaded[path, pattern]


def encode_column(text: Column, path: str, pattern: str) -> Column:
    """array<int> of ids."""

    @F.pandas_udf("array<int>")
    def ids(column: pd.Series) -> pd.Series:
        bpe = tokenizer(path, pattern)
        return pd.Series([array("i", bpe.encode(t or "")).tolist() if t else [] for t in column], dtype=object)

    return ids(text)


def decode_column(ids: Column, path: str, pattern: str) -> Column:
    """binary: the bytes that the ids stand for."""

    @F.pandas_udf("binary")
    def back(column: pd.Series) -> pd.Series:
        bpe = tokenizer(path, pattern)
        return pd.Series([bpe.decode(array("I", [int(x) for x in i]).tobytes()) if i is not None else b"" for i in column], dtype=object)

    return back(ids)


def round_trip(docs: DataFrame, path: str, pattern: str, text: str = "text", with_ids: bool = False) -> DataFrame:
    """``docs`` with n_tokens, ids_sha256 and decoded_sha256, and with ``with_ids`` also the token ids themselves (array<int>).

    A text that comes again in a batch, as copies of a document do, is encoded once. Columns of the result's names are replaced, all others kept.
    """
    names = ["n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)
    def digest(column: pd.Series) -> pd.DataFrame:
        bpe, done, rows = tokenizer(path, pattern), {}, []
        for t in column:
            if t not in done:
                packed = bpe.encode(t or "")
                row = (len(packed) // 4, hashlib.sha256(packed).hexdigest(), hashlib.sha256(bpe.decode(packed)).hexdigest())
                done[t] = (*row, np.frombuffer(packed, dtype="<i4")) if with_ids else row
            rows.append(done[t])
        return pd.DataFrame(rows, columns=names).astype({"n_tokens": "int64", **{c: object for c in names[1:]}})

    r = hidden("bpe")
    done = docs.select(*given(docs, *names), digest(named(text)).alias(r))
    return done.select(*given(docs, *names), *[F.col(r)[c].alias(c) for c in names])
