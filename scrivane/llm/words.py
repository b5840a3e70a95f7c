"""Words, shingles and compact signatures, in numpy over Arrow batches.

Words are maximal runs of letters or digits, lower-cased; a shingle is ``k`` consecutive words. A word is a
64-bit hash here, a shingle a 64-bit mix of its words' hashes, so one record is a short integer array and a batch
of records costs a few vector operations instead of an exploded row per word.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame

from scrivane.runtime import ship

WORD = re.compile(r"[^\W_]+")
MIN_WORDS = 30
SHINGLE = 3
#: 16 million buckets of one byte.
BUCKET_BITS = 24
_CHUNKS = 64
_CACHE = 1_000_000


_SEPARATORS = bytes(c if chr(c).isalnum() or c >= 128 else 32 for c in range(256))


class _Tokens:
    """Hashes of byte tokens. ASCII separators are cut by a byte table; a token with other signs may hold no word, one or
    several, found once by the pattern and kept. Emptied when it grows past a bound, so a worker's memory stays flat."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.index: dict[bytes, int] = {}
        self.starts = np.zeros(1024, dtype=np.int64)
        self.counts = np.zeros(1024, dtype=np.int64)
        self.flat = np.zeros(1024, dtype=np.uint64)
        self.used = 0

    def add(self, token: bytes) -> int:
        found = [token.decode()] if token.isascii() else WORD.findall(token.decode("utf-8", "surrogatepass"))
        at = self.index[token] = len(self.index)
        if at >= len(self.starts):
            self.starts, self.counts = np.resize(self.starts, 2 * at), np.resize(self.counts, 2 * at)
        while self.used + len(found) > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        self.starts[at], self.counts[at] = self.used, len(found)
        for w in found:
            self.flat[self.used] = xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"))
            self.used += 1
        return at

    def hashes(self, tokens: list[bytes]) -> np.ndarray:
        if len(self.index) > _CACHE:
            self.clear()
        index = self.index
        try:
            at = np.fromiter(map(index.__getitem__, tokens), dtype=np.int64, count=len(tokens))
        except KeyError:
            at = np.fromiter([index[t] if t in index else self.add(t) for t in tokens], dtype=np.int64, count=len(tokens))
        count = self.counts[at]
        first = self.starts[at]
        if (count != 1).any():
            ends = np.cumsum(count)
            first = np.repeat(first - (ends - count), count) + np.arange(ends[-1])
        return self.flat[first]


_TOKENS = _Tokens()


def words(text: str | None) -> list[str]:
    """The text's words in order; null has none. Dotted capital I is the one letter whose lower case is not a word."""
    if not text:
        return []
    if "İ" in text:
        return [w.lower() for w in WORD.findall(text)]
    return WORD.findall(text.lower())


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of ``words(text)``, in order."""
    if not text:
        return np.zeros(0, dtype=np.uint64)
    if "İ" in text:
        return np.array([xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) for w in words(text)], dtype=np.uint64)
    return _TOKENS.hashes(text.lower().encode("utf-8", "surrogatepass").translate(_SEPARATORS).split())


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values; faster on short arrays than a general unique."""
    if len(values) < 2:
        return values
    v = np.sort(values)
    return v[np.r_[True, v[1:] != v[:-1]]]


def grams(hashes: np.ndarray, k: int = SHINGLE) -> np.ndarray:
    """Rolling mix of every ``k`` consecutive word hashes."""
    count = len(hashes) - k + 1
    if count <= 0:
        return np.zeros(0, dtype=np.uint64)
    x = np.zeros(count, dtype=np.uint64)
    for j in range(k):
        x = (x * np.uint64(0x9E3779B97F4A7C15)) ^ hashes[j : j + count]
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _mix(x: np.ndarray, odd: int) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(odd)
    x ^= x >> np.uint64(27)
    return x * np.uint64(0x94D049BB133111EB)


def multiset_key(values: np.ndarray) -> tuple[int, int]:
    """128-bit key of a multiset: equal for equal values equally often, whatever their order."""
    return (
        int(_mix(values, 0xD6E8FEB86659FD93).sum(dtype=np.uint64).astype(np.int64)),
        int(_mix(values, 0xA0761D6478BD642F).sum(dtype=np.uint64).astype(np.int64)),
    )


def pack40(values: np.ndarray) -> bytes:
    """Five bytes a value, the top 40 bits: four low bytes of all, then the high byte of all."""
    v = values >> np.uint64(24)
    return (v & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes() + (v >> np.uint64(32)).astype(np.uint8).tobytes()


def unpack40(data: bytes) -> np.ndarray:
    n = len(data) // 5
    low = np.frombuffer(data, dtype="<u4", count=n).astype(np.uint64)
    return low | (np.frombuffer(data, dtype=np.uint8, count=n, offset=4 * n).astype(np.uint64) << np.uint64(32))


# --- one-bit minwise sketch -------------------------------------------------------------------------------------

_RNG = np.random.default_rng(20240607)
SKETCH_BITS = 256
#: Chance that two records at the threshold agree in fewer bits than asked.
SKETCH_MISS = 2e-9
_MUL = (_RNG.integers(1, 2**32, size=SKETCH_BITS, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_ADD = _RNG.integers(0, 2**32, size=SKETCH_BITS, dtype=np.uint64).astype(np.uint32)
#: So many minima make the key under which highly similar sets look for a leader.
KEY_MINIMA = 4


def sketch_agree(similarity: float) -> int:
    """Bits in which records of this similarity agree, but for a chance of ``SKETCH_MISS``: 181 of 256 for 0.7.

    A bit agrees with probability (1 + similarity) / 2; unrelated records agree in about 135.
    """
    p, miss = (1 + similarity) / 2, 0.0
    for k in range(SKETCH_BITS + 1):
        miss += math.comb(SKETCH_BITS, k) * p**k * (1 - p) ** (SKETCH_BITS - k)
        if miss > SKETCH_MISS:
            return k
    return SKETCH_BITS


def sketch(values: np.ndarray) -> tuple[bytes, int]:
    """One parity bit of each of 256 permutations' minimum, and a key of the first few minima."""
    h = (values >> np.uint64(32)).astype(np.uint32)
    low = np.full(SKETCH_BITS, 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(h), 2048):
        block = np.multiply.outer(_MUL, h[at : at + 2048])
        block += _ADD[:, None]
        np.minimum(low, block.min(axis=1), out=low)
    key = xxhash.xxh64_intdigest(low[:KEY_MINIMA].tobytes()) - 2**63
    return np.packbits(((low * np.uint32(0x9E3779B1)) >> np.uint32(31)).astype(np.uint8)).tobytes(), key


# --- counts by hash bucket: a statistic of bounded size over all rows ----------------------------------------------


class Frequencies:
    """Estimated frequencies of values: counts by hash bucket on a logarithmic scale of one byte.

    A bucket's count is an upper bound of its values' frequencies. ``excess`` takes off what an ordinary bucket holds, so
    that it estimates the frequency of a frequent value whatever the size of the corpus.
    """

    def __init__(self, levels: np.ndarray):
        self.levels = levels
        self.bits = len(levels).bit_length() - 1
        count = _LEVELS[levels[:: max(1, len(levels) // 65536)]]
        self.ordinary = int(np.median(count))

    def count(self, values: np.ndarray) -> np.ndarray:
        return _LEVELS[self.levels[(values >> np.uint64(64 - self.bits)).astype(np.int64)]]

    def excess(self, values: np.ndarray) -> np.ndarray:
        return np.maximum(self.count(values) - self.ordinary, 0)


#: Counts that the 256 levels stand for, each rounded up: exact to 10, then in steps of a tenth up to 2e11.
_LEVELS = np.unique(np.r_[np.arange(11), np.ceil(10 * 1.103 ** np.arange(1, 246))].astype(np.int64))[:256]


def _packed(total: np.ndarray) -> bytes:
    """Counts of one chunk: distances of the buckets that hold any, then their counts, both compressed."""
    at = np.flatnonzero(total)
    gaps = zlib.compress(np.diff(at, prepend=0).astype("<u4").tobytes(), 1)
    return np.uint32(len(gaps)).tobytes() + gaps + zlib.compress(np.minimum(total[at], 2**32 - 1).astype("<u4").tobytes(), 1)


def _added(rows: pa.ChunkedArray, step: int) -> np.ndarray:
    total = np.zeros(step, dtype=np.int64)
    for data in rows:
        raw = data.as_py()
        size = int(np.frombuffer(raw, dtype="<u4", count=1)[0])
        at = np.cumsum(np.frombuffer(zlib.decompress(raw[4 : 4 + size]), dtype="<u4"), dtype=np.int64)
        total[at] += np.frombuffer(zlib.decompress(raw[4 + size :]), dtype="<u4")
    return total


def bucket_counts(df: DataFrame, values_of: Callable[[pa.RecordBatch], Iterator[np.ndarray]], bits: int = BUCKET_BITS) -> Frequencies:
    """How many values of all rows fall into each of 2**bits hash buckets, by their top bits.

    Every task adds up its own counts, tasks' counts meet in two shuffles of compressed chunks - first of about the
    square root of the tasks, so that no group grows with the corpus - and the driver receives one byte a bucket, 16 MB.
    """
    ship(df.sparkSession)
    size = 1 << bits
    step = size // _CHUNKS
    groups = max(1, math.isqrt(df.rdd.getNumPartitions()))

    def part(batches):
        total = np.zeros(size, dtype=np.uint32)
        for batch in batches:
            held = list(values_of(batch))
            if held:
                at = np.sort((np.concatenate(held) >> np.uint64(64 - bits)).astype(np.uint32))
                first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
                total[at[first]] += np.diff(np.r_[first, len(at)]).astype(np.uint32)
        if total.any():
            mine = TaskContext.get().partitionId() % groups
            data = [_packed(total[i * step : (i + 1) * step]) for i in range(_CHUNKS)]
            yield pa.RecordBatch.from_arrays([pa.array([mine] * _CHUNKS, pa.int32()), pa.array(range(_CHUNKS), pa.int32()), pa.array(data, pa.binary())], ["part", "chunk", "counts"])

    def some(rows: pa.Table) -> pa.Table:
        return pa.table({"chunk": rows["chunk"].slice(0, 1), "counts": pa.array([_packed(_added(rows["counts"], step))], pa.binary())})

    def all_of(rows: pa.Table) -> pa.Table:
        level = np.minimum(np.searchsorted(_LEVELS, _added(rows["counts"], step)), len(_LEVELS) - 1).astype(np.uint8)
        return pa.table({"chunk": rows["chunk"].slice(0, 1), "counts": pa.array([zlib.compress(level.tobytes(), 1)], pa.binary())})

    kind = "chunk int, counts binary"
    found = df.mapInArrow(part, "part int, " + kind)
    if groups > 8:
        found = found.groupBy("part", "chunk").applyInArrow(some, kind)
    out = np.zeros(size, dtype=np.uint8)
    for row in found.select("chunk", "counts").groupBy("chunk").applyInArrow(all_of, kind).collect():  # 64 rows
        out[row.chunk * step : (row.chunk + 1) * step] = np.frombuffer(zlib.decompress(bytes(row.counts)), dtype=np.uint8)
    return Frequencies(out)


class IdFilter:
    """A bitmap of hashed identifiers: false positives cost a little work, nothing is missed."""

    def __init__(self, bitmap: np.ndarray):
        self.bitmap = bitmap
        self.bits = (8 * len(bitmap)).bit_length() - 1

    def holds(self, ids: np.ndarray) -> np.ndarray:
        at = (id_hash(ids) >> np.uint64(64 - self.bits)).astype(np.int64)
        return ((self.bitmap[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).astype(bool)


def id_filter(ids: DataFrame, count: int) -> IdFilter:
    """Filter of a one-column table of ``count`` identifiers, 16 bits each, from 128 KB to 16 MB."""
    ship(ids.sparkSession)
    bits = min(27, max(20, (16 * max(count, 1)).bit_length()))
    step = (1 << bits) // _CHUNKS

    def part(batches):
        held = np.zeros(1 << bits, dtype=bool)
        for batch in batches:
            held[(id_hash(batch.column(0).to_numpy(zero_copy_only=False)) >> np.uint64(64 - bits)).astype(np.int64)] = True
        if held.any():
            data = [zlib.compress(np.packbits(held[i * step : (i + 1) * step]).tobytes(), 1) for i in range(_CHUNKS)]
            yield pa.RecordBatch.from_arrays([pa.array(range(_CHUNKS), pa.int32()), pa.array(data, pa.binary())], ["chunk", "held"])

    def merge(rows: pa.Table) -> pa.Table:
        held = np.zeros(step // 8, dtype=np.uint8)
        for data in rows["held"]:
            held |= np.frombuffer(zlib.decompress(data.as_py()), dtype=np.uint8)
        return pa.table({"chunk": pa.array([rows["chunk"][0].as_py()], pa.int32()), "held": pa.array([zlib.compress(held.tobytes(), 1)], pa.binary())})

    kind = "chunk int, held binary"
    out = np.zeros((1 << bits) // 8, dtype=np.uint8)
    for row in ids.mapInArrow(part, kind).groupBy("chunk").applyInArrow(merge, kind).collect():  # 64 rows
        out[row.chunk * step // 8 : (row.chunk + 1) * step // 8] = np.frombuffer(zlib.decompress(bytes(row.held)), dtype=np.uint8)
    return IdFilter(out)


def id_hash(ids: np.ndarray) -> np.ndarray:
    """Spread 64-bit identifiers over the buckets."""
    return _mix(ids.astype(np.int64).view(np.uint64) + np.uint64(0x632BE59BD9B4E019), 0xD6E8FEB86659FD93)
