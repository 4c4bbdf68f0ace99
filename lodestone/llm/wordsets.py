"""Texts as sequences and multisets of words: sketches, MinHash bands and segments, computed for a whole Arrow batch at once.

Words are runs of letters (with their marks), digits and underscores of the consistent form (see confusables) in lower case, so case and punctuation are ignored. A text
without a word (null, empty, punctuation only) has no sketch and is nearly the same as no other text.

Two texts of n and m words with o words in common, counted with repeats, are near copies if o / (n + m - o) >= 4/5, that is 9 o >= 4 (n + m).
Each word gets a key that also holds how often it occurred before in the text; then the multisets are sets of keys, and o is the size of
their intersection.
"""

from __future__ import annotations

import functools
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.confusables import canonical

WORD = re.compile(r"[\w\u0300-\u036f]+")
#: rows x bands of the MinHash signature: at similarity 0.8 a pair shares no band with probability (1 - 0.8^6)^24 = 0.0007.
ROWS, BANDS = 6, 24
#: Words of a segment; in a near copy at most one word of so many is replaced.
SEGMENT, PER_SEGMENT = 7, 9

_MEMO: dict[str, int] = {}
_HASHES = np.zeros(1024, np.uint64)
_MOST_WORDS = 500_000  # words kept in a worker's memory; beyond that it starts anew
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(31))) * U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> U(29))) * U(0xBF58476D1CE4E5B9)
    return x ^ (x >> U(32))


class _Ids(dict):
    """What stands between blanks (lower case) -> the numbers of its words in _HASHES, filled in as it occurs."""

    def __missing__(self, token: str) -> tuple[int, ...]:
        global _HASHES
        out = []
        for x in WORD.findall(token):
            k = _MEMO.get(x)
            if k is None:
                k = _MEMO[x] = len(_MEMO)
                if k >= len(_HASHES):
                    _HASHES = np.concatenate([_HASHES, np.zeros_like(_HASHES)])
                _HASHES[k] = xxhash.xxh3_64_intdigest(x)
            out.append(k)
        self[token] = got = tuple(out)
        return got


_IDS = _Ids()


def hashed(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words of all texts, and the number of words of each text."""
    if len(_IDS) > _MOST_WORDS:
        _IDS.clear()
        _MEMO.clear()
    ids: list[int] = []
    counts = np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        if t is not None:
            before = len(ids)
            ids.extend(itertools.chain.from_iterable(map(_IDS.__getitem__, canonical(t).lower().split())))
            counts[i] = len(ids) - before
    return _HASHES[np.array(ids, np.int64)], counts


def keys(h: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each word the key of (word, how often before in this text)."""
    doc = np.repeat(np.arange(len(counts)), counts)
    order = np.lexsort((h, doc))
    hs, ds = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (hs[1:] != hs[:-1]) | (ds[1:] != ds[:-1])
    at = np.arange(len(h))
    rank = np.empty(len(h), np.int64)
    rank[order] = at - np.maximum.accumulate(np.where(new, at, 0))
    return mix(h + rank.astype(np.uint64) * U(0xD6E8FEB86659FD93))


_RNG = np.random.Generator(np.random.PCG64(20))
_A = (_RNG.integers(0, 2**32, ROWS * BANDS, dtype=np.uint32) | np.uint32(1)).astype(np.uint32)
_B = _RNG.integers(0, 2**32, ROWS * BANDS, dtype=np.uint32)


def bands(k: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each text BANDS 32-bit hashes of ROWS minima each. Every text has a word."""
    x = (k >> U(32)).astype(np.uint32)
    out = np.zeros((BANDS, len(starts)), np.uint64)
    for i in range(ROWS * BANDS):
        out[i // ROWS] = mix(out[i // ROWS] + np.minimum.reduceat(x * _A[i] + _B[i], starts).astype(np.uint64))
    return (out >> U(32)).astype(np.uint32).view(np.int32).T


def _chunks(batch: pa.RecordBatch, chars: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of about so many bytes of text (the last column), one text at least; memory doesn't depend on the batch size."""
    size = np.cumsum(np.asarray(batch.column(batch.num_columns - 1).cast(pa.large_binary()).to_pandas().str.len().fillna(0))) if batch.num_rows else np.zeros(0)
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + chars)))
        yield batch.slice(at, end - at)
        at = end


def _lists(flat: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(flat, kind))


class Sketch:
    """What is computed of the texts of a slice that have a word: n, two sketches (64 bits, each the parity of the keys that fall on it),
    a hash of the multiset, and the words' hashes and keys."""

    def __init__(self, texts: list[str | None]):
        h, counts = hashed(texts)
        self.has = np.flatnonzero(counts)
        self.n = counts[self.has]
        self.h = h
        self.key = keys(h, counts)
        self.starts = np.cumsum(self.n) - self.n
        self.band: np.ndarray | None = None
        if len(self.has):
            self.bits = np.bitwise_xor.reduceat(U(1) << (self.key >> U(58)), self.starts).view(np.int64)
            self.more = np.bitwise_xor.reduceat(U(1) << ((self.key >> U(40)) & U(63)), self.starts).view(np.int64)
            self.multiset = mix(np.add.reduceat(mix(h), self.starts) + self.n.astype(np.uint64)).view(np.int64)
        else:
            self.bits = self.more = self.multiset = np.zeros(0, np.int64)

    def columns(self) -> list[pa.Array]:
        return [pa.array(self.n.astype(np.int32)), pa.array(self.bits), pa.array(self.multiset)]


def _mapped(df: DataFrame, more: str, f) -> DataFrame:
    """df's columns but the last (the text), then n, bits, multiset and what f adds, for rows whose text has a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in _chunks(whole):
                s = Sketch(b.column(b.num_columns - 1).to_pylist())
                if len(s.has):
                    keep = pa.array(s.has)
                    cols = [b.column(i).take(keep) for i in range(b.num_columns - 1)] + s.columns() + f(s)
                    yield pa.RecordBatch.from_arrays(cols, names)

    kept = df.schema.fields[:-1]
    names = [x.name for x in kept] + ["n", "bits", "multiset"] + [x.split()[0] for x in more.split(", ") if x]
    schema = ", ".join([f"`{x.name}` {x.dataType.simpleString()}" for x in kept] + ["n int", "bits long", "multiset long"] + [more] * bool(more))
    return df.mapInArrow(run, schema)


def with_bands(df: DataFrame) -> DataFrame:
    """Adds n, bits, multiset, more (a second sketch) and bands (array of int) of the last column, the text, which is dropped."""
    return _mapped(df, "more long, bands array<int>", lambda s: [pa.array(s.more), _lists(bands(s.key, s.starts).ravel(), np.full(len(s.has), BANDS), pa.int32())])


def with_keys(df: DataFrame) -> DataFrame:
    """Adds n, bits, multiset and keys (array of long) of the last column, the text, which is dropped."""
    return _mapped(df, "keys array<bigint>", lambda s: [_lists(s.key.view(np.int64), s.n, pa.int64())])



def _window_hash(h: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """A hash of the words [start, start + length) of the flat sequence h; windows stay within one text, so sums over all texts serve."""
    out = np.zeros(len(start), np.uint64)
    for j in range(int(length.max(initial=0))):
        on = length > j
        at = np.where(on, start + j, 0)
        out = np.where(on, (out + mix(h[at])) * U(0x9FB21C651E98DF25), out)
    return mix(out ^ length.astype(np.uint64)).view(np.int64)


def segments_of(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and length of the segments of texts of n words, which start at equal distances and don't overlap: as many of seven words as there is room for;
    in short texts fewer or shorter ones, but always one more than words may be replaced."""
    n = np.asarray(n)
    g = np.where(n < 28, n // PER_SEGMENT + 1, n // SEGMENT)
    return g, np.where(n < 28, n // g, SEGMENT)


def _segments(s: Sketch) -> list[pa.Array]:
    """Segment i of g starts at word i n / g."""
    g, size = segments_of(s.n)
    doc = np.repeat(np.arange(len(g)), g)
    lo = (np.arange(len(doc)) - np.repeat(np.cumsum(g) - g, g)) * s.n[doc] // g[doc]
    return [_lists(_window_hash(s.h, s.starts[doc] + lo, size[doc]), g, pa.int64()), _lists(lo.astype(np.int32), g, pa.int32())]


def _with_bands(s: Sketch, found: list[pa.Array]) -> list[pa.Array]:
    """Segments or windows, followed by the text's MinHash bands at place -1."""
    segment, at = (x.flatten().to_numpy() for x in found)
    counts = np.diff(found[0].offsets.to_numpy())
    if s.band is None:
        s.band = bands(s.key, s.starts)
    band = mix(s.band.view(np.uint32).astype(np.uint64) + (np.arange(1, BANDS + 1, dtype=np.uint64) << U(40))).view(np.int64)
    end = np.repeat(np.cumsum(counts), BANDS)
    return [_lists(np.insert(segment, end, band.ravel()), counts + BANDS, pa.int64()), _lists(np.insert(at, end, np.int32(-1)), counts + BANDS, pa.int32())]


def wide(key: np.ndarray, starts: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each text a sketch as `bits`, of a bit a word at least: its longs one text after the other, and how many each has, a power of two. A key falls on the bit
    that its lowest digits say, so the two halves of a sketch, one turned by the other, are the sketch of half the length."""
    size = np.left_shift(1, np.ceil(np.log2(np.maximum(1, n / 64))).astype(np.int64))
    flat = np.zeros(int(size.sum()), np.uint64)
    at = np.repeat(np.cumsum(size) - size, n) + ((key >> U(6)).astype(np.int64) & np.repeat(size - 1, n))
    np.bitwise_xor.at(flat, at, U(1) << (key & U(63)))
    return flat.view(np.int64), size


def _wide(s: Sketch) -> list[pa.Array]:
    return [_lists(*wide(s.key, s.starts, s.n), pa.int64())]


def with_segments(df: DataFrame) -> DataFrame:
    """Adds n, bits, multiset, segment (array of long: hashes of the segments, in order, then of the MinHash bands) and wide."""
    return _mapped(df, "segment array<bigint>, wide array<bigint>", lambda s: _with_bands(s, _segments(s))[:1] + _wide(s))


@functools.lru_cache(10_000)
def _window_lengths(n: int) -> list[int]:
    """The lengths that segments have in texts whose number of words lets them be near copies of a text of n words."""
    return sorted({int(x) for x in segments_of(np.arange(-(-4 * n // 5), 5 * n // 4 + 1))[1] if 0 < x <= n})


def _windows(s: Sketch) -> list[pa.Array]:
    doc, size = (np.array(x, np.int64) for x in zip(*[(d, ln) for d, n in enumerate(s.n.tolist()) for ln in _window_lengths(n)], strict=True))
    g = s.n[doc] - size + 1
    of = np.repeat(np.arange(len(g)), g)
    lo = np.arange(len(of)) - np.repeat(np.cumsum(g) - g, g)
    counts = np.bincount(doc[of], minlength=len(s.n))
    return [_lists(_window_hash(s.h, s.starts[doc[of]] + lo, size[of]), counts, pa.int64()), _lists(lo.astype(np.int32), counts, pa.int32())]


def with_windows(df: DataFrame) -> DataFrame:
    """Adds n, bits, multiset, segment and at of all substrings of words that may equal a segment of a near copy, and of the MinHash bands."""
    return _mapped(df, "segment array<bigint>, at array<int>", lambda s: _with_bands(s, _windows(s)))


def with_both(df: DataFrame) -> DataFrame:
    """As with_windows, `own`, which is with_segments' segment, and wide, from one reading of the text."""
    return _mapped(df, "segment array<bigint>, at array<int>, own array<bigint>, wide array<bigint>", lambda s: _with_bands(s, _windows(s)) + _with_bands(s, _segments(s))[:1] + _wide(s))


def may_be_near(n: str, m: str, bits: str, other: str) -> Column:
    """No near copy fails this: the shorter has four fifths of the longer's words, and at most (n + m) / 9 words aren't shared, each
    of which turns one of the 64 bits."""
    return F.expr(f"5 * least({n}, {m}) >= 4 * greatest({n}, {m}) and 9 * bit_count({bits} ^ {other}) <= {n} + {m}")


def may_be_near_widely(n: str, m: str, a: str, b: str) -> Column:
    """No near copy fails this: a and b are texts' wide sketches, of which the longer is brought to the length of the shorter. Where one is missing or of less than half the length, true."""
    half = lambda x, y: f"if(size({x}) = 2 * size({y}), zip_with(slice({x}, 1, size({y})), slice({x}, size({y}) + 1, size({y})), (p, q) -> p ^ q), {x})"
    turned = f"aggregate(zip_with({half(a, b)}, {half(b, a)}, (p, q) -> bit_count(p ^ q)), 0, (x, y) -> x + y)"
    return F.expr(f"coalesce(9 * {turned} <= {n} + {m}, true)")


def is_near(keys_a: str, keys_b: str) -> Column:
    return F.expr(f"9 * size(array_intersect({keys_a}, {keys_b})) >= 4 * (size({keys_a}) + size({keys_b}))")


def near_verified(pairs: DataFrame, texts: DataFrame, a: str, b: str) -> DataFrame:
    """The pairs whose texts are near copies, by exact comparison. texts: (key, text); only texts that occur in a pair are worked on."""
    ids = pairs.select(F.col(a).alias("key")).union(pairs.select(F.col(b).alias("key"))).distinct()
    k = with_keys(texts.join(ids, "key", "left_semi")).select("key", "keys")
    ka, kb = k.select(F.col("key").alias(a), F.col("keys").alias("_ka")), k.select(F.col("key").alias(b), F.col("keys").alias("_kb"))
    return pairs.join(ka, a).join(kb, b).where(is_near("_ka", "_kb")).drop("_ka", "_kb")
