"""Problem 7: a mix of sources in which each has its target share of all tokens.

Method. Records of a source are dealt into ``blocks`` by a hash of (seed, id): a random permutation cut into disjoint
blocks. A mix's total is the largest at which every source with documents reaches its weight with at most
``max_repeats`` uses of a record. Each source's share becomes an exact quota of blocks: full passes over all blocks,
and a last pass over the leading blocks of the permutation, whose final block is taken in part. A splitting tree
divides the quotas among the output shards: at each node a multivariate-hypergeometric draw decides how many blocks of
each source go left. Shards then draw disjoint runs of the permuted blocks and order their records by a local hash.

The number of shards follows the tokens, so that a shard is never more than one task sorts, and the number of blocks the
shards. Only block sums (named sources x blocks) are looked at by the driver. Sizes are tokens of a public tokenizer.

Defined cases: null ids, null sources and records without tokens take no part; repeated rows of one id count once;
sources are trimmed; a source without documents or of weight 0 gets nothing, the rest share its weight in proportion;
null max_repeats means 1; an empty table gives an empty mix and a report of zero shares; other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scrivane.llm.encode import VOCABULARY, token_counts
from scrivane.runtime import cut

#: Least numbers of blocks of a source and of shards of a mix.
BLOCKS = 256
SHARDS = 16
#: Tokens from which a shard is split further: some eight million records of ordinary length, sorted by id and source alone.
SHARD_TOKENS = 1 << 31
SEED = 42


def sized(df: DataFrame, id_col: str, text_col: str, source_col: str, path: str = VOCABULARY) -> DataFrame:
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.regexp_replace(F.col(source_col), r"^\s+|\s+$", "").alias("source"), F.col(text_col).alias("text"))
    rows = rows.where("doc_id is not null and source is not null and text is not null and text <> ''")
    counted = token_counts(rows, ["doc_id", "source"], "text", path).where("n_tokens > 0")
    return cut(counted.dropDuplicates(["doc_id"]))


def split_tree(quota: np.ndarray, shards: int, rng: np.random.Generator) -> list[np.ndarray]:
    """Divide block quotas among shards: each node draws the left half's blocks without replacement."""
    if shards == 1:
        return [quota]
    left = shards // 2
    total = int(quota.sum())
    drawn = rng.multivariate_hypergeometric(quota, total * left // shards) if total else np.zeros_like(quota)
    return split_tree(drawn, left, rng) + split_tree(quota - drawn, shards - left, rng)


def plan(sums: dict[str, np.ndarray], targets: list[tuple[str, str, float, int]], shards: int = SHARDS, seed: int = SEED):
    """From block sums to (mix, source, pass, block, shard, tokens to take) rows and the report's rows."""
    deals: list[tuple] = []
    shares: list[tuple] = []
    by_mix: dict[str, list[tuple[str, float, int]]] = defaultdict(list)
    for mix, source, weight, most in targets:
        by_mix[mix].append((source, weight, most))
    for mix in sorted(by_mix):
        rows = sorted(by_mix[mix])
        live = [(s, w, m) for s, w, m in rows if s in sums and w > 0 and m > 0]
        weight_sum = sum(w for _, w, _ in live)
        total = min((int(sums[s].sum()) * m * weight_sum / w for s, w, m in live), default=0.0)
        rng = np.random.default_rng([seed, *mix.encode()])
        runs: list[list[tuple[int, int, int]]] = []
        for s, w, m in live:
            want = int(total * w / weight_sum)
            have = int(sums[s].sum())
            order = [b for b in rng.permutation(len(sums[s])).tolist() if sums[s][b]]
            run = []
            for use in range(m):
                for b in order:
                    if want <= 0:
                        break
                    take = min(want, int(sums[s][b]))
                    run.append((use + 1, b, take))
                    want -= take
            runs.append(run)
            if sum(t for _, _, t in run) > have * m:
                raise ValueError(f"source {s!r} of mix {mix!r} would be used more than {m} times")
        parts = split_tree(np.array([len(r) for r in runs], dtype=np.int64), shards, rng) if runs else []
        at = [0] * len(runs)
        for shard, part in enumerate(parts):
            for k, (s, _, _) in enumerate(live):
                for use, b, take in runs[k][at[k] : at[k] + int(part[k])]:
                    deals.append((mix, s, use, b, shard, take))
                at[k] += int(part[k])
        for s, w, m in rows:
            shares.append((mix, s, w, m, int(sums[s].sum()) if s in sums else 0))
    return deals, shares


def mixed(docs: DataFrame, targets: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", path: str = VOCABULARY, shards: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The mixes (mix_name, shard, position, doc_id, source, use, n_tokens) and the report of shares."""
    spark = docs.sparkSession
    records = sized(docs, id_col, text_col, source_col, path)
    shards = shards or max(SHARDS, -(-(records.agg(F.sum("n_tokens")).first()[0] or 0) // SHARD_TOKENS))
    blocks = max(BLOCKS, 4 * shards)
    records = records.withColumn("block", F.pmod(F.xxhash64(F.lit(SEED), "doc_id"), F.lit(blocks)).cast("int"))
    wanted = targets.select("mix_name", F.regexp_replace("source", r"^\s+|\s+$", "").alias("source"), F.col("target_weight").cast("double"), F.coalesce("max_repeats", F.lit(1)).cast("int")).where("mix_name is not null and source is not null and target_weight is not null")
    named = wanted.select("source").distinct()
    per_block = records.join(named, "source", "left_semi").groupBy("source", "block").agg(F.sum("n_tokens").alias("n"))
    sums: dict[str, np.ndarray] = {}
    for r in per_block.collect():  # named sources x blocks
        sums.setdefault(r.source, np.zeros(blocks, dtype=np.int64))[r.block] = r.n
    deals, shares = plan(sums, [tuple(r) for r in wanted.collect()], shards)
    kind = "mix_name string, source string, use int, block int, shard int, take long"
    dealt = spark.createDataFrame(deals, kind)
    joined = records.join(dealt, ["source", "block"])  # a hot source is spread over its blocks
    inside = Window.partitionBy("mix_name", "source", "use", "block").orderBy(F.xxhash64(F.lit(SEED + 1), "use", "doc_id"), "doc_id")
    before = F.coalesce(F.sum("n_tokens").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # a block that ends the quota gives the records whose middle lies within what is left of it
    used = joined.withColumn("before", before).where(F.col("before") + F.col("n_tokens") / 2 <= F.col("take"))
    order = Window.partitionBy("mix_name", "shard").orderBy(F.xxhash64(F.lit(SEED + 2), "doc_id", "use"), "doc_id", "use")
    out = cut(used.select("mix_name", "shard", "doc_id", "source", "use", "n_tokens").withColumn("position", F.row_number().over(order)))
    reached = out.groupBy("mix_name", "source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("uses"), F.countDistinct("doc_id").alias("records"), F.max("use").alias("most_uses"))
    base = spark.createDataFrame(shares, "mix_name string, source string, target_weight double, max_repeats int, available long").join(reached, ["mix_name", "source"], "left")
    for c in ("tokens", "uses", "records", "most_uses"):
        base = base.withColumn(c, F.coalesce(c, F.lit(0)))
    share = F.try_divide(F.col("tokens").cast("double"), F.sum("tokens").over(Window.partitionBy("mix_name")).cast("double"))
    return out, base.withColumn("actual_share", F.round(F.coalesce(share, F.lit(0.0)), 6))
