"""Problem 3: groups of near-duplicate records by an exact set-similarity join with set-relation skipping.

Method. The shingles of the whole corpus are ordered by frequency; every set posts its rarest shingles to inverted
lists; lists are cut into blocks by size and position and whole blocks are skipped by the overlap bound
(``scrivane.llm.blocks``). Related sets are skipped in the index and derive their answers:

* equal sets with the same words form a class, and only its representative takes part;
* representatives with the same key of minima look to the smallest of them; one that differs from it in at most
  ``DIFFER`` of its shingles is its *follower* and keeps only the difference. Followers post nothing;
* leaders are joined at a threshold lowered by what the differences of two followers can change. From a pair of leaders
  and the size of its intersection, a follower's answers follow incrementally, by looking up only its few differing
  shingles in the other leader's set, and then the other follower's. Followers of one leader are similar to each other
  and to it by construction, and no pair of them is computed to know that.

So neither copies nor clusters of revisions ever meet in a list. ``near_duplicates`` writes out every pair, as asked;
``near_duplicate_links`` counts a cluster's pairs without writing them.

Defined cases: null ids, null texts and texts below ``least_words`` words take no part; repeated rows of one id count
once; an empty table gives an empty result; other columns are ignored; texts of any length are processed whole.
Two different shingles are taken for one with probability 2**-40, and a pair at the threshold fails the sketch with
probability of about 2e-9.
"""

from __future__ import annotations

from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrivane.llm.blocks import POSTING, RECORD, Jaccard, buckets_for, pack, parts_of, shared_counts
from scrivane.llm.signatures import KEY, classes, fetched, involved, record_signatures, shingle_frequencies, texts, with_values
from scrivane.llm.words import MIN_WORDS, id_filter, unpack40
from scrivane.runtime import cut

#: Least share of all distinct shingles of two records that both have; one value for pairs and for links.
THRESHOLD = 0.7
#: A follower differs from its leader in at most this share of the leader's shingles.
DIFFER = Fraction(3, 100)


def lowered(sim: Jaccard, differ: Fraction = DIFFER) -> Jaccard:
    """The similarity that two leaders have at least if any of their followers are similar.

    With j = num / den and overlap share s = j / (1 + j), a difference of d shingles lowers the overlap that a pair of
    sizes asks for by (1 - s) d at most, so leaders overlap in s - (1 - s) * differ of their sizes.
    """
    share = Fraction(sim.num, sim.num + sim.den)
    low = share - (1 - share) * differ
    least = low / (1 - low)
    return Jaccard(int(least * 1000), 1000)


def postings(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The records of a batch and all their postings."""
    flag = batch.column("flag").to_pylist() if "flag" in batch.schema.names else [0] * batch.num_rows
    records = np.zeros(batch.num_rows, dtype=RECORD)
    out, ids, parts = [], [], []
    for k, (i, n, s, t, p, g, f) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("id", "n", "sketch", "tokens", "places", "parts")), flag)):
        token = np.frombuffer(t, dtype="<u8")
        rows = np.zeros(len(token), dtype=POSTING)
        rows["t"], rows["p"], rows["r"] = token, np.frombuffer(p, dtype="<u4"), k
        records[k] = (i, n, f, np.frombuffer(s, dtype="<u8"))
        out.append(rows)
        ids.append(np.full(len(token), i, dtype=np.int64))
        parts.append(np.frombuffer(g, dtype="<u2"))
    if not out:
        return records, np.zeros(0, dtype=POSTING)
    return records, parts_of(np.concatenate(out), np.concatenate(ids), np.concatenate(parts).astype(np.int64))


def prefix_records(rows: DataFrame, sim: Jaccard, least_words: int) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(shingle_frequencies(rows, least_words))  # 16 MB at any size

    def prefix(_, values):
        count = shared.value.count(values)
        order = np.lexsort((values, count))[: sim.prefix(len(values))]
        places = np.arange(1, len(order) + 1)
        repeated = count[order] > 1  # a count of 1 is a shingle of one record, which joins nothing
        kept = order[repeated]
        return values[kept], places[repeated], np.maximum(count[kept] - shared.value.ordinary, 0)

    return record_signatures(rows, prefix, least_words, whole=True)


# --- leaders and followers ------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Relations:
    """What the join leaves: class membership, followers with their differences, and pairs of leaders.

    members (id, rep, bag1, bag2); followers (rep, leader, n, gone, new), a leader being its own follower without a difference;
    sets (id, value) of the leaders; pairs (a, b, inter) of leaders, a < b.
    """

    members: DataFrame
    followers: DataFrame
    sets: DataFrame
    pairs: DataFrame


def _only(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Values of u that are not in v, both sorted."""
    if not len(v):
        return u
    return u[v[np.minimum(np.searchsorted(v, u), len(v) - 1)] != u]


def _common(u: np.ndarray, v: np.ndarray) -> int:
    return len(u) - len(_only(u, v))


def _bytes(values: np.ndarray) -> bytes:
    return values.astype("<u8").tobytes()


def _values(data: bytes) -> np.ndarray:
    return np.frombuffer(data, dtype="<u8")


def led(records: DataFrame, unique: DataFrame) -> DataFrame:
    """(rep, leader, n, gone, new) of every representative: its leader and the difference, or itself and none.

    Representatives of one key look to its smallest id. Only sets of keys with two or more are fetched and compared; a
    key that a third of all rows share is a join with one row on the other side, which Spark may split.
    """
    narrow = records.groupBy("id").agg(F.min("near").alias("near"), F.min("n").alias("n")).join(unique, "id")
    first = narrow.groupBy("near").agg(F.min("id").alias("leader"), F.count("*").alias("size")).where("size > 1")
    looking = cut(narrow.join(first, "near").where("id <> leader").select(F.col("leader").alias("a"), F.col("id").alias("b"), "n"))
    sets = fetched(records, involved(looking), "value")

    def differences(batches):
        for batch in batches:
            out = []
            for rep, leader, n, other, own in zip(*(batch.column(c).to_pylist() for c in ("b", "a", "n", "value_a", "value_b"))):
                u, v = unpack40(own), unpack40(other)
                gone, new = _only(v, u), _only(u, v)
                if len(gone) + len(new) <= DIFFER * len(v):
                    out.append((rep, leader, n, _bytes(gone), _bytes(new)))
            if out:
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["rep", "leader", "n", "gone", "new"])

    following = cut(with_values(looking, sets).mapInArrow(differences, "rep long, leader long, n int, gone binary, new binary"))
    none = F.lit(b"")
    own = narrow.join(following.select(F.col("rep").alias("id")), "id", "left_anti").select(F.col("id").alias("rep"), F.col("id").alias("leader"), "n", none.alias("gone"), none.alias("new"))
    return cut(following.unionByName(own))


def relations(rows: DataFrame, sim: Jaccard, least_words: int = MIN_WORDS) -> Relations:
    """The wide records stay where they are: filters of bounded size pick what posts and what is compared.

    A filter lets a few other records through; what they add is dropped from the pairs by a join on ids alone.
    """
    low = lowered(sim)
    records = prefix_records(rows, low, least_words)
    reps, members = classes(records)
    membership = cut(members.join(reps, KEY).select("id", "rep", "bag1", "bag2"))
    followers = led(records, membership.where("id = rep").select("id"))
    leaders = followers.where("rep = leader").select(F.col("rep").alias("id"))
    posting = rows.sparkSession.sparkContext.broadcast(id_filter(leaders, leaders.count()))  # 16 MB at most

    def led_postings(batch):
        return postings(batch.filter(pa.array(posting.value.holds(batch.column("id").to_numpy(zero_copy_only=False)))))

    light = records.select("id", "n", "sketch", "tokens", "places", "parts")
    shared = shared_counts(pack(light, led_postings, buckets_for(light)), low)
    candidates = cut(shared.join(leaders.withColumnRenamed("id", "a"), "a", "left_semi").join(leaders.withColumnRenamed("id", "b"), "b", "left_semi").select("a", "b"))
    sets = fetched(records, involved(candidates), "value")

    def verify(batches):
        for batch in batches:
            kept = []
            for a, b, x, y in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "value_a", "value_b"))):
                u, v = unpack40(x), unpack40(y)
                both = np.concatenate((u, v))
                both.sort()
                inter = int((both[1:] == both[:-1]).sum())
                if low.holds(inter, len(u), len(v)):
                    kept.append((a, b, inter))
            if kept:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*kept)], ["a", "b", "inter"])

    return Relations(membership, followers, sets, cut(with_values(candidates, sets).mapInArrow(verify, "a long, b long, inter long")))


# --- answers of followers, derived ------------------------------------------------------------------------------------------


def follower_pairs(r: Relations, sim: Jaccard) -> DataFrame:
    """(x, y): similar representatives of different leaders.

    Plain pairs of leaders without followers pass through; for the others the first side's followers get the size of
    their intersection with the other leader from its pair's, then the other side's followers theirs, each by looking up
    differences alone.
    """
    follows = r.followers.where("rep <> leader").select(F.col("leader").alias("of")).distinct()
    marked = r.pairs.join(follows.select(F.col("of").alias("a"), F.lit(1).alias("fa")), "a", "left").join(follows.select(F.col("of").alias("b"), F.lit(1).alias("fb")), "b", "left")
    sizes = r.followers.where("rep = leader").select(F.col("rep").alias("l"), "n")
    plain = marked.where("fa is null and fb is null").select("a", "b", "inter")
    plain = plain.join(sizes.select(F.col("l").alias("a"), F.col("n").alias("na")), "a").join(sizes.select(F.col("l").alias("b"), F.col("n").alias("nb")), "b")
    plain = plain.where(F.col("inter") * sim.den >= (F.col("na") + F.col("nb") - F.col("inter")) * sim.num).select(F.col("a").alias("x"), F.col("b").alias("y"))
    led_pairs = with_values(marked.where("fa is not null or fb is not null").select("a", "b", "inter"), r.sets)
    side = r.followers.select(F.col("leader"), F.col("rep"), "n", "gone", "new")
    first = led_pairs.join(side.select(F.col("leader").alias("a"), F.col("rep").alias("x"), F.col("n").alias("nx"), F.col("gone").alias("gx"), F.col("new").alias("wx")), "a")

    def one_side(batches):
        """From |a and b| to |x and b|; only what may still be similar to a follower of b goes on."""
        for batch in batches:
            out = []
            columns = ("b", "x", "nx", "inter", "gx", "wx", "value_a", "value_b")
            for b, x, nx, inter, gx, wx, va, vb in zip(*(batch.column(c).to_pylist() for c in columns)):
                if gx or wx:
                    other = unpack40(vb)
                    inter += _common(_values(wx), other) - _common(_values(gx), other)
                out.append((b, x, nx, inter, gx, wx, va))
            if out:
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["b", "x", "nx", "inter", "gx", "wx", "value_a"])

    half = first.mapInArrow(one_side, "b long, x long, nx int, inter long, gx binary, wx binary, value_a binary")
    second = half.join(side.select(F.col("leader").alias("b"), F.col("rep").alias("y"), F.col("n").alias("ny"), F.col("gone").alias("gy"), F.col("new").alias("wy")), "b")

    def other_side(batches):
        """From |x and b| to |x and y|: y's differences are looked up in x, which is a's set and x's own differences."""
        for batch in batches:
            out = []
            columns = ("x", "y", "nx", "ny", "inter", "gx", "wx", "gy", "wy", "value_a")
            for x, y, nx, ny, inter, gx, wx, gy, wy, va in zip(*(batch.column(c).to_pylist() for c in columns)):
                if gy or wy:
                    u, gone, new = unpack40(va), _values(gx), _values(wx)
                    held = lambda some: _common(some, u) - _common(some, gone) + _common(some, new)
                    inter += held(_values(wy)) - held(_values(gy))
                if sim.holds(inter, nx, ny):
                    out.append((x, y))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["x", "y"])

    return plain.unionByName(second.mapInArrow(other_side, "x long, y long"))


def near_duplicates(df: DataFrame, id_col: str = "id", text_col: str = "resume_str", threshold: float = THRESHOLD, least_words: int = MIN_WORDS) -> DataFrame:
    """(id_a, id_b), id_a < id_b: similar records that do not have the same words equally often."""
    sim = Jaccard.of(threshold)
    r = relations(texts(df, id_col, text_col), sim, least_words)
    many = r.followers.where("rep <> leader").select("leader").distinct()
    clustered = r.followers.join(many, "leader", "left_semi").select("leader", "rep")
    inside = clustered.select("leader", F.col("rep").alias("x")).join(clustered.select("leader", F.col("rep").alias("y")), "leader").where("x < y").select("x", "y")  # all are similar
    pairs = follower_pairs(r, sim).unionByName(inside)
    a = r.members.select(F.col("rep").alias("x"), F.col("id").alias("id_1"), F.struct("bag1", "bag2").alias("bag_1"))
    b = r.members.select(F.col("rep").alias("y"), F.col("id").alias("id_2"), F.struct("bag1", "bag2").alias("bag_2"))
    return pairs.join(a, "x").join(b, "y").where("bag_1 <> bag_2").select(F.least("id_1", "id_2").alias("id_a"), F.greatest("id_1", "id_2").alias("id_b"))


def near_duplicate_links(df: DataFrame, id_col: str = "id", text_col: str = "resume_str", threshold: float = THRESHOLD, least_words: int = MIN_WORDS) -> DataFrame:
    """(id, class_id, links): one row per record with its class and the number of other classes it is similar to."""
    sim = Jaccard.of(threshold)
    r = relations(texts(df, id_col, text_col), sim, least_words)
    ends = follower_pairs(r, sim).select(F.explode(F.array("x", "y")).alias("rep"))
    between = ends.groupBy("rep").agg(F.count("*").alias("between"))
    sizes = r.followers.groupBy("leader").agg((F.count("*") - 1).alias("inside"))
    links = r.followers.select("rep", "leader").join(sizes, "leader").join(between, "rep", "left")
    links = links.select("rep", (F.col("inside") + F.coalesce("between", F.lit(0))).alias("links"))
    return r.members.join(links, "rep").select("id", F.col("rep").alias("class_id"), "links")
