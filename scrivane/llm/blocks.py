"""Distributed inverted lists with block skipping.

Each record posts (token, position); postings travel packed, one blob per input batch and hash bucket, and a record's
identifier, set size, flag and sketch are in a blob once, however many of its postings are. The number of buckets follows
the counted postings, so that a bucket holds ``BUCKET_BYTES`` whatever the size of the corpus; the list of a token that
more than ``LIST`` records may post is cut into parts by record, and every two parts meet in a bucket of their own.

A bucket's lists are sorted by (token, size, position), so that rows of one token with equal size form a block ordered by
position. Every posting walks its list with its own pointer: a partner whose size is out of range ends the walk, a
position out of range skips the rest of the block, and only what is left is compared by the 256-bit sketch. All pointers
of a bucket move together in vector operations.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrivane.llm.words import SKETCH_BITS, id_hash, sketch_agree
from scrivane.runtime import shuffle_width

RECORD = np.dtype([("id", "<i8"), ("n", "<u4"), ("f", "<u1"), ("s", "<u8", (SKETCH_BITS // 64,))])
POSTING = np.dtype([("t", "<u8"), ("p", "<u4"), ("r", "<u4"), ("side", "<u1")])
#: A posting as it travels, 12 bytes: 48 bits of the token, the position below two bits of the side, and the record's
#: place in its blob. Side is 0 in a whole list, 1 or 2 in the two parts that meet in a list of two parts.
PACKED = np.dtype([("t", "<u4"), ("u", "<u2"), ("p", "<u4"), ("r", "<u2")])
_FLUSH = 2_000_000
_BATCH = 50_000
BUCKET_BYTES = 16 << 20
LIST = 20_000


@dataclass(frozen=True)
class Jaccard:
    """Exact integer bounds for set similarity of at least ``num / den``."""

    num: int = 7
    den: int = 10

    @classmethod
    def of(cls, threshold: float) -> "Jaccard":
        f = Fraction(threshold).limit_denominator(1000)
        return cls(f.numerator, f.denominator)

    def overlap(self, total):
        """Least intersection of two sets whose sizes add up to ``total``."""
        return -(-self.num * total // (self.num + self.den))

    def least(self, n):
        """Least size of a partner of a set of ``n``."""
        return -(-self.num * n // self.den)

    def most(self, n):
        return n * self.den // self.num

    @staticmethod
    def shared(overlap):
        """How many shared tokens a true pair must show within the prefixes that are compared."""
        return 1 + overlap // 25

    def prefix(self, n):
        """Leading tokens, in the global order, that must be posted for a set of ``n``."""
        o = self.least(n)
        return n - o + self.shared(o)

    def holds(self, inter, na, nb):
        return inter * self.den >= self.num * (na + nb - inter)


def buckets_for(records: DataFrame) -> int:
    """Buckets for checkpointed records (tokens binary, 8 bytes each): by the bytes that their postings take."""
    postings = (records.agg(F.sum(F.octet_length("tokens"))).first()[0] or 0) // 8
    return max(shuffle_width(records.sparkSession), -(-postings * (PACKED.itemsize + RECORD.itemsize) // BUCKET_BYTES))


def labels_for(spark: SparkSession, width: int) -> np.ndarray | None:
    """Numbers of ``width`` buckets that Spark's hash deals evenly over the shuffle partitions.

    None, which is the buckets' own numbers, where a partition gets more than 16 of them: chance then deals evenly enough.
    """
    partitions = shuffle_width(spark, 1)
    each = -(-width // partitions)
    if each > 16:
        return None
    dealt: dict[int, list[int]] = {p: [] for p in range(partitions)}
    rows = spark.range(partitions * (3 * each + 40)).select(F.col("id").cast("int").alias("k")).select("k", F.pmod(F.hash("k"), F.lit(partitions)).alias("p"))
    for k, p in rows.toPandas().itertuples(index=False):  # at most 88 numbers a partition
        if len(dealt[p]) < each:
            dealt[p].append(k)
    return np.array([k for level in range(each) for p in range(partitions) for k in dealt[p][level : level + 1]][:width], dtype=np.int32)


def parts_of(rows: np.ndarray, ids: np.ndarray, parts: np.ndarray) -> np.ndarray:
    """Postings with those of long lists (``parts`` > 1) once for each pair of parts that their own part meets."""
    long = parts > 1
    if not long.any():
        return rows
    out = [rows[~long]]
    for count in np.unique(parts[long]).tolist():
        some, own = rows[parts == count], (id_hash(ids[parts == count]) % np.uint64(count)).astype(np.int64)
        for other in range(count):
            copy = some.copy()
            low, high = np.minimum(own, other).astype(np.uint64), np.maximum(own, other).astype(np.uint64)
            with np.errstate(over="ignore"):
                copy["t"] = _spread(some["t"] ^ _spread(low * np.uint64(count) + high + np.uint64(1)))
            copy["side"] = np.where(own == other, 0, np.where(own < other, 1, 2))
            out.append(copy)
    return np.concatenate(out)


def _spread(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def pack(df: DataFrame, postings_of: Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray]], width: int) -> DataFrame:
    """(bucket, blob): all postings of an input batch, with their records, that belong to one hash bucket of tokens."""
    labels = labels_for(df.sparkSession, width)
    count = width if labels is None else len(labels)

    def part(batches):
        for batch in (b.slice(at, _BATCH) for b in batches for at in range(0, b.num_rows, _BATCH)):
            records, rows = postings_of(batch)
            if not len(rows):
                continue
            bucket = (_spread(rows["t"]) % np.uint64(count)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            rows, bucket = rows[order], bucket[order]
            starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
            blobs = []
            for start, end in zip(starts.tolist(), [*starts[1:].tolist(), len(rows)]):
                own = rows[start:end]
                used, place = np.unique(own["r"], return_inverse=True)
                some = np.empty(len(own), dtype=PACKED)
                some["t"], some["u"], some["r"] = own["t"] >> np.uint64(32), (own["t"] >> np.uint64(16)) & np.uint64(0xFFFF), place
                some["p"] = own["p"] | (own["side"].astype(np.uint32) << np.uint32(30))
                blobs.append(np.uint32(len(used)).tobytes() + records[used].tobytes() + some.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(bucket[starts].astype(np.int32) if labels is None else labels[bucket[starts]]), pa.array(blobs, pa.binary())], ["bucket", "blob"])

    return df.mapInArrow(part, "bucket int, blob binary")


def load(blobs) -> tuple[np.ndarray, np.ndarray]:
    """All records and postings of a bucket, postings sorted by (token, set size, position)."""
    records, rows, seen = [], [], 0
    for blob in blobs:
        data = blob.as_py()
        count = int(np.frombuffer(data, dtype="<u4", count=1)[0])
        records.append(np.frombuffer(data, dtype=RECORD, count=count, offset=4))
        own = np.frombuffer(data, dtype=PACKED, offset=4 + count * RECORD.itemsize)
        some = np.empty(len(own), dtype=POSTING)
        some["t"] = (own["t"].astype(np.uint64) << np.uint64(16)) | own["u"]
        some["p"], some["side"], some["r"] = own["p"] & np.uint32(2**30 - 1), own["p"] >> np.uint32(30), own["r"].astype(np.uint32) + np.uint32(seen)
        seen += count
        rows.append(some)
    all_records, all_rows = np.concatenate(records), np.concatenate(rows)
    return all_records, all_rows[np.lexsort((all_rows["p"], all_records["n"][all_rows["r"]], all_rows["t"]))]


def walk(records: np.ndarray, rows: np.ndarray, sim: Jaccard, by_position: bool, by_flag: bool):
    """Yield index arrays (i, j) of postings of one token that pass every bound."""
    count = len(rows)
    if count < 2:
        return
    r = rows["r"].astype(np.int64)
    t, p, side = np.ascontiguousarray(rows["t"]), rows["p"].astype(np.int64), np.ascontiguousarray(rows["side"])
    parted = bool(side.any())
    n, f, ids = records["n"].astype(np.int64)[r], records["f"][r], records["id"][r]
    sketches = np.ascontiguousarray(records["s"])
    new_list = np.flatnonzero(np.r_[True, t[1:] != t[:-1]])
    new_block = np.flatnonzero(np.r_[True, (t[1:] != t[:-1]) | (n[1:] != n[:-1])])
    list_end = np.repeat(np.r_[new_list[1:], count], np.diff(np.r_[new_list, count]))
    block_end = np.repeat(np.r_[new_block[1:], count], np.diff(np.r_[new_block, count]))
    most = sim.most(n)
    differ = SKETCH_BITS - sketch_agree(sim.num / sim.den)
    i = np.arange(count)
    j = i + 1
    while True:
        alive = j < list_end[i]
        i, j = i[alive], j[alive]
        alive = n[j] <= most[i]
        i, j = i[alive], j[alive]
        if not len(i):
            return
        if by_position:
            o = sim.overlap(n[i] + n[j])
            slack = sim.shared(o) - o
            fits = (p[i] <= n[i] + slack) & (p[j] <= n[j] + slack)
        else:
            fits = np.ones(len(i), dtype=bool)
        a, b = i[fits], j[fits]
        if parted:
            ok = (side[a] == 0) | (side[a] != side[b])
            a, b = a[ok], b[ok]
        if by_flag:
            ok = ((f[a] & 1) & (f[b] >> 1)) | ((f[a] >> 1) & (f[b] & 1))
            a, b = a[ok > 0], b[ok > 0]
        near = np.bitwise_count(sketches[r[a]] ^ sketches[r[b]]).sum(axis=1, dtype=np.int64) <= differ
        near &= ids[a] != ids[b]
        if near.any():
            yield a[near], b[near]
        j = np.where(fits, j + 1, block_end[j])


def shared_counts(packed: DataFrame, sim: Jaccard) -> DataFrame:
    """(a, b, need): pairs that share at least ``need`` tokens of their prefixes within the position bounds."""

    def bucket(table: pa.Table) -> pa.Table:
        records, rows = load(table["blob"])
        ids, n = records["id"][rows["r"]], records["n"].astype(np.int64)[rows["r"]]
        found: list[np.ndarray] = []
        held: list[np.ndarray] = []
        waiting = 0

        def fold():
            if held:
                x = np.concatenate(held)
                u, w = np.unique(x[:, :3], axis=0, return_inverse=True)
                found.append(np.c_[u, np.bincount(w.ravel(), weights=x[:, 3]).astype(np.int64)])
                held.clear()

        for a, b in walk(records, rows, sim, by_position=True, by_flag=False):
            need = sim.shared(sim.overlap(n[a] + n[b]))
            held.append(np.c_[np.minimum(ids[a], ids[b]), np.maximum(ids[a], ids[b]), need, np.ones(len(a), dtype=np.int64)])
            waiting += len(a)
            if waiting > _FLUSH:
                fold()
                waiting = 0
        fold()
        x = np.concatenate(found) if found else np.zeros((0, 4), dtype=np.int64)
        return pa.table({"a": x[:, 0], "b": x[:, 1], "need": x[:, 2].astype(np.int32), "shared": x[:, 3].astype(np.int32)})

    per_bucket = packed.groupBy("bucket").applyInArrow(bucket, "a long, b long, need int, shared int")
    return per_bucket.groupBy("a", "b").agg(F.sum("shared").alias("shared"), F.max("need").alias("need")).where("shared >= need").select("a", "b")
