"""Problem 2: records of evaluation splits that recur, exactly or almost, in the training split.

Method. Winnowing over rolling shingle hashes: of every ``window`` consecutive shingles the rarest one (ties by hash)
is a fingerprint, so any run of window + 2 equal words gives two records a common fingerprint. Fingerprints are joined
across splits, only train against evaluation; their positions are the seeds. Seeds of a pair are chained collinearly,
the chain is extended word by word to an alignment, and the alignment's coverage is reported. A pair of similarity 0.7
has runs longer than that window: its edits may touch at most three tenths of the union, and each edit breaks at
least four shingles. An exact check of the similarity follows.

A fingerprint that more than ``HOT`` records share, such as one inside a paragraph that a third of all rows carry, is
not posted, which bounds the work of every list. Its frequency is estimated by what its bucket holds above an ordinary
one, so that the bound means the same at any size of corpus. Records that lose one post their rarest shingles instead, as many as
any two sets of the wanted similarity must share one of: a pair that has only hot fingerprints in common is found by
those, any other by the fingerprints.

Defined cases as in ``neardup``; records without a split, or of another split, take no part. Splits are trimmed and
lower-cased.
"""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrivane.llm.blocks import Jaccard, buckets_for, load, pack, walk
from scrivane.llm.neardup import postings
from scrivane.llm.signatures import KEY, classes, involved, packed_values, record_signatures, shingle_frequencies, texts, with_values
from scrivane.llm.words import MIN_WORDS, distinct, grams, pack40, unpack40
from scrivane.runtime import cut

WINDOW = 8
HOT = 5_000
#: Training copies of one class that meet an evaluation copy in one task.
PART = 10_000
TRAIN, EVAL = 1, 2


def winnow(count: np.ndarray, hashes: np.ndarray, window: int) -> np.ndarray:
    """Positions, in ascending order, of the rarest of each window's grams: least (count, hash), rightmost of equals.

    Count, hash and position share one word of 20 + 20 + 24 bits, so that windows are plain running minima; the position
    is reduced modulo 2**24, which only matters to ties within one window.
    """
    n = len(hashes)
    if not n:
        return np.zeros(0, dtype=np.int64)
    at = np.arange(n, dtype=np.uint64)
    mask = np.uint64(2**24 - 1)
    x = (np.minimum(count, 2**20 - 1).astype(np.uint64) << np.uint64(44)) | ((hashes >> np.uint64(44)) << np.uint64(24)) | (mask - (at & mask))
    size, want = 1, min(window, n)
    while size < want:
        step = min(size, want - size)
        x = np.minimum(x[:-step], x[step:])
        size += step
    start = np.arange(len(x), dtype=np.int64)
    # the position modulo 2**24, brought back into the window that starts at ``start``
    place = start + ((((mask - (x & mask)).astype(np.int64) - start)) & (2**24 - 1))
    return place[np.r_[True, place[1:] != place[:-1]]]


def chain(seeds: np.ndarray) -> np.ndarray:
    """Longest chain of seeds (pa, pb) ascending in both positions: patience sorting over pb."""
    seeds = seeds[np.lexsort((-seeds[:, 1], seeds[:, 0]))]
    tails: list[int] = []
    tail_at: list[int] = []
    before = np.full(len(seeds), -1)
    for k, value in enumerate(seeds[:, 1].tolist()):
        lo = bisect.bisect_left(tails, value)
        before[k] = tail_at[lo - 1] if lo else -1
        tails[lo : lo + 1] = [value]
        tail_at[lo : lo + 1] = [k]
    path = []
    k = tail_at[-1] if tail_at else -1
    while k >= 0:
        path.append(k)
        k = int(before[k])
    return seeds[path[::-1]]


def aligned_words(a: np.ndarray, b: np.ndarray, seeds: np.ndarray, k: int = 3) -> int:
    """Words covered by the chained seeds once each is extended, both ways, over equal words."""
    end_a = end_b = covered = 0
    for x, y in chain(seeds).tolist():
        if x < end_a or y < end_b:
            continue
        left = min(x - end_a, y - end_b)
        back = 0
        if left:
            unequal = np.flatnonzero(a[x - left : x][::-1] != b[y - left : y][::-1])
            back = int(unequal[0]) if len(unequal) else left
        right = min(len(a) - x, len(b) - y)
        unequal = np.flatnonzero(a[x : x + right] != b[y : y + right])
        ahead = int(unequal[0]) if len(unequal) else right
        covered += back + ahead
        end_a, end_b = x + ahead, y + ahead
    return covered


def split_flags(splits: DataFrame) -> DataFrame:
    """(id, split, source, flag) of each record of the training or an evaluation split; of differing rows the least."""
    name = F.lower(F.regexp_replace("split", r"^\s+|\s+$", ""))
    rows = splits.select(F.col("resume_id").cast("long").alias("id"), name.alias("split"), F.col("source").alias("source"))
    flag = F.when(F.col("split") == "train", TRAIN).when(F.col("split").isin("validation", "test"), EVAL)
    rows = rows.withColumn("flag", flag).where("flag is not null and id is not null")
    return rows.groupBy("id").agg(F.min(F.struct("flag", "split", "source")).alias("s")).select("id", "s.split", "s.source", "s.flag")


def seed_pairs(packed: DataFrame, sim: Jaccard) -> DataFrame:
    """(a, b, seeds): class pairs that share fingerprints across splits, with packed positions of each."""

    def bucket(table: pa.Table) -> pa.Table:
        records, rows = load(table["blob"])
        ids, p = records["id"][rows["r"]], rows["p"].astype(np.int64)
        held = []
        for i, j in walk(records, rows, sim, by_position=False, by_flag=True):
            swap = ids[i] > ids[j]
            i, j = np.where(swap, j, i), np.where(swap, i, j)
            held.append(np.c_[ids[i], ids[j], p[i], p[j]])
        x = np.concatenate(held) if held else np.zeros((0, 4), dtype=np.int64)
        x = x[np.lexsort((x[:, 3], x[:, 2], x[:, 1], x[:, 0]))]
        new = np.flatnonzero(np.r_[True, (x[1:, :2] != x[:-1, :2]).any(axis=1)]) if len(x) else np.zeros(0, dtype=np.int64)
        ends = np.r_[new[1:], len(x)]
        at = x[:, 2:].astype("<u4")
        seeds = [at[s:e].tobytes() for s, e in zip(new.tolist(), ends.tolist())] if len(x) else []
        return pa.table({"a": pa.array(x[new, 0], pa.int64()), "b": pa.array(x[new, 1], pa.int64()), "seeds": pa.array(seeds, pa.binary())})

    per_bucket = packed.groupBy("bucket").applyInArrow(bucket, "a long, b long, seeds binary")
    return per_bucket.groupBy("a", "b").agg(F.collect_list("seeds").alias("seeds"))  # at most one row a bucket


def similar_classes(resumes: DataFrame, splits: DataFrame, threshold: float, least_words: int, window: int, hot: int) -> tuple[DataFrame, DataFrame]:
    """Members (id, rep, bag1, bag2, flag) of classes and pairs (a, b, similarity, coverage) of similar classes.

    A class's members have the same shingles and the same words equally often; its smallest id stands for it.
    """
    sim = Jaccard.of(threshold)
    rows = texts(resumes, "id", "resume_str")
    flags = split_flags(splits).select("id", "flag")
    shared = rows.sparkSession.sparkContext.broadcast(shingle_frequencies(rows, least_words))  # 16 MB at any size

    def fingerprints(h, shingles):
        known = shared.value
        g = grams(h)
        count = known.count(g)
        often = np.maximum(count - known.ordinary, 0)
        at = winnow(count, g, window)
        if (often[at] > hot).any():
            rarest = shingles[np.lexsort((shingles, known.count(shingles)))[: sim.prefix(len(shingles))]]
            order = np.argsort(g, kind="stable")
            first = order[np.searchsorted(g[order], rarest)]
            at = np.union1d(at[often[at] <= hot], first)
        at = at[count[at] > 1]
        return g[at], at, often[at]

    records = record_signatures(rows, fingerprints, least_words)
    keyed = cut(records.select("id", *KEY).distinct().join(flags, "id"))
    reps = keyed.groupBy(*KEY).agg(F.min("id").alias("rep"), F.expr("bit_or(flag)").alias("flag"))
    one_each = records.select("id", "n", "sketch", "tokens", "places", "parts").join(reps.select(F.col("rep").alias("id"), F.col("flag")), "id")  # a repeated row repeats seeds, no pairs
    seeds = cut(seed_pairs(pack(one_each, postings, buckets_for(records)), sim))
    sequences = packed_values(rows, involved(seeds), pack40, least_words)

    def verify(batches):
        for batch in batches:
            kept = []
            for a, b, s, x, y in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "seeds", "value_a", "value_b"))):
                u, v = unpack40(x), unpack40(y)
                gu, gv = distinct(grams(u)), distinct(grams(v))
                both = np.concatenate((gu, gv))
                both.sort()
                inter = int((both[1:] == both[:-1]).sum())
                if sim.holds(inter, len(gu), len(gv)):
                    at = np.concatenate([np.frombuffer(z, dtype="<u4") for z in s]).reshape(-1, 2).astype(np.int64)
                    kept.append((a, b, inter / (len(gu) + len(gv) - inter), aligned_words(u, v, at) / max(len(u), len(v))))
            if kept:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*kept)], ["a", "b", "similarity", "coverage"])

    similar = with_values(seeds, sequences).mapInArrow(verify, "a long, b long, similarity double, coverage double")
    return keyed.join(reps.drop("flag"), KEY).select("id", "rep", "bag1", "bag2", "flag"), similar


def overlaps(resumes: DataFrame, splits: DataFrame, threshold: float = 0.7, least_words: int = MIN_WORDS, window: int = WINDOW, hot: int = HOT) -> DataFrame:
    """(id_a, id_b, similarity, coverage) with id_a < id_b, one of train, the other of an evaluation split.

    Records with the same words equally often have similarity and coverage 1 here.
    """
    members, similar = similar_classes(resumes, splits, threshold, least_words, window, hot)
    of = members.select("rep", "id", "flag", F.struct("bag1", "bag2").alias("bag"))
    almost = (
        similar.join(of.select(F.col("rep").alias("a"), F.col("id").alias("x"), F.col("flag").alias("fx"), F.col("bag").alias("bx")), "a")
        .join(of.select(F.col("rep").alias("b"), F.col("id").alias("y"), F.col("flag").alias("fy"), F.col("bag").alias("by")), "b")
        .where("fx <> fy and bx <> by")
        .select("x", "y", "similarity", "coverage")
    )
    # copies: a class's training records are dealt into parts of PART, and each evaluation record meets every part
    parts = members.where(F.col("flag") == TRAIN).groupBy("bag1", "bag2").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    train = members.where(F.col("flag") == TRAIN).join(parts, ["bag1", "bag2"])
    train = train.select("bag1", "bag2", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), F.col("id").alias("x"))
    evaluated = members.where(F.col("flag") == EVAL).join(parts, ["bag1", "bag2"])
    evaluated = evaluated.select("bag1", "bag2", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("id").alias("y"))
    same = train.join(evaluated, ["bag1", "bag2", "part"]).select("x", "y", F.lit(1.0).alias("similarity"), F.lit(1.0).alias("coverage"))
    return almost.unionByName(same).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"), "similarity", "coverage")


def class_overlaps(resumes: DataFrame, splits: DataFrame, threshold: float, least_words: int) -> tuple[DataFrame, DataFrame]:
    """Evaluation members (id, rep, split, source) and, per class, (rep, pairs, full_pairs, covered, best) with train.

    Pairs are counted from the classes' sizes and never written out: a record's partners are the training records of its
    own words and those of similar classes. ``covered`` is the sum of the coverages.
    """
    members, similar = similar_classes(resumes, splits, threshold, least_words, WINDOW, HOT)
    members = cut(members)
    train = members.where(F.col("flag") == TRAIN).groupBy("rep", "bag1", "bag2").agg(F.count("*").alias("trained"))
    held = members.where(F.col("flag") == EVAL).join(split_flags(splits).select("id", "split", "source"), "id")
    reps = held.select("rep", "bag1", "bag2").distinct()
    same = reps.join(train.groupBy("bag1", "bag2").agg(F.sum("trained").alias("pairs")), ["bag1", "bag2"])
    same = same.select("rep", "pairs", F.lit(1.0).alias("similarity"), F.lit(1.0).alias("coverage"))
    both = similar.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("p"), "similarity", "coverage")
    both = both.select(F.col("p.a").alias("rep"), F.col("p.b").alias("other"), "similarity", "coverage").join(reps, "rep")
    other = train.select(F.col("rep").alias("other"), F.col("bag1").alias("o1"), F.col("bag2").alias("o2"), F.col("trained").alias("pairs"))
    almost = both.join(other, "other").where("bag1 <> o1 or bag2 <> o2").select("rep", "pairs", "similarity", "coverage")
    each = same.unionByName(almost).groupBy("rep").agg(
        F.sum("pairs").alias("pairs"), F.sum(F.when(F.col("similarity") == 1, F.col("pairs")).otherwise(0)).alias("full_pairs"),
        F.sum(F.col("pairs") * F.col("coverage")).alias("covered"), F.max("similarity").alias("best_similarity"), F.max("coverage").alias("best_coverage"),
    )
    return held.select("id", "rep", "split", "source"), each


def overlap_report(resumes: DataFrame, splits: DataFrame, threshold: float = 0.7, least_words: int = MIN_WORDS) -> DataFrame:
    """Per evaluation split and source: records that overlap with train, pairs, and mean coverage."""
    held, each = class_overlaps(resumes, splits, threshold, least_words)
    return held.join(each, "rep").groupBy("split", "source").agg(
        F.count("*").alias("records"), F.sum("pairs").alias("pairs"), F.sum("full_pairs").alias("full_pairs"), F.round(F.sum("covered") / F.sum("pairs"), 6).alias("mean_coverage"),
    )


def overlap_records(resumes: DataFrame, splits: DataFrame, threshold: float = 0.7, least_words: int = MIN_WORDS) -> DataFrame:
    """(id, split, source, pairs, best_similarity, best_coverage) of every evaluation record that overlaps with train."""
    held, each = class_overlaps(resumes, splits, threshold, least_words)
    return held.join(each, "rep").select("id", "split", "source", "pairs", F.round("best_similarity", 6).alias("best_similarity"), F.round("best_coverage", 6).alias("best_coverage"))
