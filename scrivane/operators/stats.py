"""Corpus statistics: partial aggregates before every shuffle, nothing collected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scrivane.functions.text import quick_tokens, word_count

#: Hash ranges that a label is ranked in; a power of two, 65,536 at most.
CELLS = 1024


def null_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    counts = df.agg(*(F.sum(F.col(c).isNull().cast("long")).alias(c) for c in columns))
    return counts.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).alias("nulls")) for c in columns))).alias("x")).select("x.*")


def distinct_rows(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def duplicate_count(df: DataFrame) -> DataFrame:
    """Rows beyond the first of each set of equal rows; the sets are told apart by a hash of 128 bits of all columns."""
    row = F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})
    keys = df.select(F.md5(row).alias("k")).groupBy("k").count()
    return keys.agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("duplicates"))


def value_counts(df: DataFrame, column: Column, name: str) -> DataFrame:
    return df.groupBy(column.alias(name)).agg(F.count("*").alias("n"))


def mean_words(df: DataFrame, key: Column, text: str, most: int = 10) -> DataFrame:
    """Groups with the highest mean number of words."""
    means = df.groupBy(key.alias("category")).agg(F.round(F.avg(word_count(F.col(text))), 6).alias("mean_words"))
    return means.orderBy(F.desc("mean_words"), "category").limit(most)


def describe(df: DataFrame, value: Column) -> DataFrame:
    v = df.select(value.cast("double").alias("v")).where("v is not null")
    q = F.percentile("v", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    one = v.agg(F.count("v").alias("n"), F.round(F.avg("v"), 6).alias("mean"), F.round(F.stddev_samp("v"), 6).alias("std"), F.min("v").alias("least"), q.alias("q"), F.max("v").alias("most"))
    return one.select("n", "mean", "std", "least", *(F.round(F.get("q", F.lit(k)), 6).alias(c) for k, c in enumerate(("q25", "median", "q75"))), "most")


def histogram(df: DataFrame, value: Column, bins: int = 50) -> DataFrame:
    """Equal-width bins from least to most; the last one is closed. Bins without rows are left out."""
    v = df.select(value.cast("double").alias("v")).where("v is not null")
    least, most = v.agg(F.min("v"), F.max("v")).first()
    if least is None or least == most:
        return v.groupBy(F.lit(0).alias("bin")).agg(F.count("*").alias("n"))
    at = F.least(F.floor((F.col("v") - least) / ((most - least) / bins)), F.lit(bins - 1))
    return v.groupBy(at.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def box(df: DataFrame, key: Column, value: Column) -> DataFrame:
    """Quartiles of each group and whiskers at 1.5 times their distance, clipped to the data."""
    v = df.select(key.alias("category"), value.cast("double").alias("v")).where("v is not null")
    q = v.groupBy("category").agg(F.percentile("v", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
    q = q.select("category", F.get("q", F.lit(0)).alias("q1"), F.get("q", F.lit(1)).alias("median"), F.get("q", F.lit(2)).alias("q3"))
    j = v.join(q.withColumnRenamed("category", "group"), F.col("category").eqNullSafe(F.col("group")))
    low, high = F.col("q1") - 1.5 * (F.col("q3") - F.col("q1")), F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))
    return j.groupBy("category").agg(
        F.round(F.first("q1"), 6).alias("q1"), F.round(F.first("median"), 6).alias("median"), F.round(F.first("q3"), 6).alias("q3"),
        F.min(F.when(F.col("v") >= low, F.col("v"))).alias("low_whisker"), F.max(F.when(F.col("v") <= high, F.col("v"))).alias("high_whisker"),
    )


def top_words(df: DataFrame, text: str, stop: list[str], most: int = 30) -> DataFrame:
    words = df.select(F.explode(quick_tokens(F.col(text))).alias("word")).where(~F.col("word").isin(*stop))
    return words.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(most)


def stable_sample(df: DataFrame, key: str, most: int = 500, seed: int = 42) -> DataFrame:
    """The rows with the smallest hash of seed and key: the same whatever the partitions."""
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key).limit(most)


def stratified_split(df: DataFrame, key: str, label: str, train: float = 0.7, seed: int = 42) -> DataFrame:
    """train, validation and test per label, in the order of a hash: 70 %, then half of the rest each.

    A row's rank in its label is the number of rows in lower hash cells, from one small count table, plus its rank in its
    own cell, so that a label of any size is ranked by ``CELLS`` tasks. A null label is a label.
    """
    code = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    rows = df.withColumn("_code", code).withColumn("_cell", (F.conv(F.substring("_code", 1, 4), 16, 10).cast("int") / (65536 // CELLS)).cast("int"))
    cells = rows.groupBy(F.col(label).alias("_label"), F.col("_cell").alias("_of")).agg(F.count("*").alias("_n"))
    lower = Window.partitionBy("_label").orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("_label", "_of", F.coalesce(F.sum("_n").over(lower), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy("_label")).alias("_size"))
    row = F.row_number().over(Window.partitionBy(label, "_cell").orderBy("_code", key)) + F.col("_before")
    cut = F.floor(F.col("_size") * train + 0.5)
    half = F.floor((F.col("_size") - cut) * 0.5 + 0.5)
    placed = rows.join(cells, F.col(label).eqNullSafe(F.col("_label")) & (F.col("_cell") == F.col("_of"))).withColumn("_row", row)
    return placed.select(*df.columns, F.when(F.col("_row") <= cut, "train").when(F.col("_row") <= cut + half, "validation").otherwise("test").alias("split"))


def labels(df: DataFrame, column: str) -> DataFrame:
    """(label, category): categories in order, from 0. The distinct values are few, the window is over them only."""
    names = df.select(F.col(column).alias("category")).where("category is not null").distinct()
    return names.select((F.row_number().over(Window.orderBy("category")) - 1).cast("int").alias("label"), "category")
