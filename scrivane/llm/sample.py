"""Problem 5: samples whose category shares follow target proportions.

Method. Every record has a random priority, a hash of seed and id. In one pass over the distinct records each task keeps,
per category, a reservoir of the records with the smallest priorities and the number of records seen. A reservoir holds as
many records as any target may ask of its category: the bound follows from the row count and the targets alone, so every
task knows it in advance, and a task with fewer records keeps them all. Reservoirs merge by taking the smallest
priorities of both. The final counts give the feasible quotas, to which the merged reservoirs are trimmed: priority ranges
below a quota are taken whole and only the range at the quota is ranked, so that no category, however large, meets in one
task. Exhausted and missing categories are reported; ``met`` says that the number of records wanted was reached, while
``actual_share`` shows the share, which differs where other categories run out.

Quotas. The sample's size is ``fraction`` of the distinct categorised records. A category's wish is its share of that size,
rounded half up, raised to min_records where given; its quota is the wish or, if fewer records exist, all of them.

Defined cases: null ids and null or blank categories take no part; repeated rows of one id count once (an id with
several categories takes the smallest); categories are trimmed and upper-cased; a target may name a missing category;
an empty table gives empty samples and a report with zero counts; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scrivane.runtime import cut, ship

FRACTION = 0.2
SEED = "42"
CELLS = 1024
#: Priorities are the first 15 hexadecimal digits of an MD5.
SPACE = 16**15


def priority(id_col: Column, seed: str) -> Column:
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), id_col.cast("string"))), 1, 15), 16, 10).cast("long")


def categorised(df: DataFrame, id_col: str, category_col: str) -> DataFrame:
    name = F.upper(F.regexp_replace(F.col(category_col), r"^\s+|\s+$", ""))
    rows = df.select(F.col(id_col).cast("long").alias("id"), name.alias("category")).where("id is not null and category is not null and category <> ''")
    return rows.groupBy("id").agg(F.min("category").alias("category"))


def quotas(counts: DataFrame, targets: DataFrame, fraction: float) -> DataFrame:
    """One row per target: available, wanted, quota. Both inputs are aggregates of one row a category."""
    name = F.upper(F.regexp_replace("category", r"^\s+|\s+$", ""))
    wanted = targets.select("target_name", name.alias("category"), F.col("target_share").cast("double").alias("target_share"), F.col("min_records").cast("long").alias("min_records"))
    size = int((counts.agg(F.sum("available")).first()[0] or 0) * fraction + 0.5)
    joined = wanted.join(counts, "category", "left")
    wish = F.floor(F.col("target_share") * F.lit(float(size)) + 0.5).cast("long")
    joined = joined.withColumn("available", F.coalesce("available", F.lit(0)).cast("long"))
    joined = joined.withColumn("wanted", F.greatest(wish, F.coalesce("min_records", F.lit(0))).cast("long"))
    return joined.withColumn("quota", F.least("wanted", "available"))


def reservoir_sizes(rows: int, targets: DataFrame, fraction: float) -> dict[str, int]:
    """The most records that any target may take of a category, from a bound of the number of records."""
    name = F.upper(F.regexp_replace("category", r"^\s+|\s+$", ""))
    size = int(rows * fraction + 0.5)
    asked = targets.where("category is not null and target_share is not null").select(name.alias("category"), F.greatest(F.floor(F.col("target_share").cast("double") * size + 0.5) + 1, F.coalesce(F.col("min_records"), F.lit(0))).alias("most"))
    return {r.category: int(r.most) for r in asked.groupBy("category").agg(F.max("most").alias("most")).collect()}  # one row a category named


def reservoirs(records: DataFrame, sizes: dict[str, int]) -> DataFrame:
    """(category, id, priority) of what the tasks keep, and (category, seen) rows, whose id is null, of what they saw."""
    ship(records.sparkSession)

    def smallest(kept: list[np.ndarray], most: int) -> np.ndarray:
        x = np.concatenate(kept)
        return x[np.lexsort((x[:, 0], x[:, 1]))[:most]] if len(x) > most else x

    def part(batches):
        held: dict[str, list[np.ndarray]] = {}
        waiting: dict[str, int] = {}
        seen: dict[str, int] = {}
        for batch in batches:
            names = batch.column("category").dictionary_encode()
            code = names.indices.to_numpy(zero_copy_only=False)
            rows = np.c_[batch.column("id").to_numpy(zero_copy_only=False), batch.column("priority").to_numpy(zero_copy_only=False)]
            for k, name in enumerate(names.dictionary.to_pylist()):
                some = rows[code == k]
                seen[name] = seen.get(name, 0) + len(some)
                most = sizes.get(name, 0)
                if most:
                    held.setdefault(name, []).append(some)
                    waiting[name] = waiting.get(name, 0) + len(some)
                    if waiting[name] > 2 * most + 10_000:
                        held[name] = [smallest(held[name], most)]
                        waiting[name] = most
        for name, count in seen.items():
            x = smallest(held[name], sizes[name]) if name in held else np.zeros((0, 2), dtype=np.int64)
            n = len(x)
            columns = [pa.array([name] * (n + 1), pa.string()), pa.array([*x[:, 0].tolist(), None], pa.int64()), pa.array([*x[:, 1].tolist(), None], pa.int64()), pa.array([0] * n + [count], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["category", "id", "priority", "seen"])

    return records.select("id", "category", "priority").mapInArrow(part, "category string, id long, priority long, seen long")


def draw(df: DataFrame, targets: DataFrame, id_col: str = "id", category_col: str = "category", fraction: float = FRACTION, seed: str = SEED) -> tuple[DataFrame, DataFrame]:
    """The samples (target_name, category, id) and the report of every target."""
    kept = cut(reservoirs(categorised(df, id_col, category_col).withColumn("priority", priority(F.col("id"), seed)), reservoir_sizes(df.count(), targets, fraction)))
    counts = kept.where("id is null").groupBy("category").agg(F.sum("seen").alias("available"))
    records = kept.where("id is not null").withColumn("cell", (F.col("priority") / F.lit(SPACE // CELLS)).cast("int"))
    cells = cut(records.groupBy("category", "cell").agg(F.count("*").alias("n")))  # partial counts: at most 1024 a category and task
    plan = cut(quotas(counts, targets, fraction))
    before = Window.partitionBy("category").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    start = cells.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    # the cell of each category and target at which the quota ends, and how many of it are taken
    takes = start.join(plan.select("target_name", "category", "quota"), "category").where("before < quota")
    takes = takes.select("target_name", "category", "cell", F.least("n", F.col("quota") - F.col("before")).alias("take"), "n")
    whole = takes.where("take = n").drop("take", "n")
    part = takes.where("take < n").drop("n")
    base = records.select("category", "cell", "id", "priority")
    rank = F.row_number().over(Window.partitionBy("target_name", "category", "cell").orderBy("priority", "id"))
    ranked = base.join(part, ["category", "cell"]).withColumn("rank", rank).where("rank <= take")
    out = base.join(whole, ["category", "cell"]).select("target_name", "category", "id")
    sample = out.unionByName(ranked.select("target_name", "category", "id"))
    taken = F.sum("quota").over(Window.partitionBy("target_name"))
    report = plan.select(
        "target_name", "category", "target_share", "min_records", "available", "wanted", "quota",
        F.round(F.try_divide(F.col("quota").cast("double"), taken.cast("double")), 6).alias("actual_share"),
        F.when(F.col("available") == 0, "missing").when(F.col("quota") < F.col("wanted"), "exhausted").otherwise("met").alias("status"),
    )
    return sample, report
