"""Problem 4: duplicates hidden by layout, letter case, punctuation or the order of parts.

Method. A record's canonical key is its sorted words; equal keys are copies. Exact counts per key are pre-aggregated
in the map tasks; a key of more than ``HOT`` records is hot, at any size of the table. A hot key's rows are salted and
aggregated in two levels to their smallest id; they meet it by a broadcast while hot keys are at most ``HOT_KEYS``, else by
a salted join. All other keys take one shuffle. Keys of one record are never sorted or joined: their counts tell. No
group is ever collected.

Defined cases: null ids, null texts and texts below ``least_words`` words take no part; repeated rows of one id count
once; records that differ in other columns only are copies; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrivane.llm.words import MIN_WORDS
from scrivane.runtime import cut

HOT = 100_000
#: Hot keys, 40 bytes each, that are sent to every task; more are joined by key and salt.
HOT_KEYS = 500_000
SALTS = 64


def canonical_words(text: Column) -> Column:
    """Sorted lower-case words, all inside the JVM."""
    found = F.split(F.lower(text), r"[^\p{L}\p{N}]+")
    return F.sort_array(F.filter(found, lambda w: w != ""))


def keyed(df: DataFrame, id_col: str, text_col: str, least_words: int) -> DataFrame:
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")
    rows = rows.select("id", canonical_words(F.col("text")).alias("words")).where(F.size("words") >= least_words)
    return rows.select("id", F.unhex(F.md5(F.concat_ws(" ", "words"))).alias("key"))


def grouped(records: DataFrame, hot: int = HOT, salts: int = SALTS, hot_keys: int = HOT_KEYS) -> tuple[DataFrame, DataFrame]:
    """(key, keep_id, copies) of every key, and the hot rows (key, id, salt) beside their keys' smallest id (keep_id)."""
    counts = cut(records.groupBy("key").agg(F.count("*").alias("copies"), F.min("id").alias("keep_id")))  # map tasks send one row a key
    listed = counts.where(F.col("copies") > hot).select("key")
    few = listed.count() <= hot_keys
    salted = records.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int"))
    every = listed.select("key", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    hot_rows = salted.join(F.broadcast(listed), "key") if few else salted.join(every, ["key", "salt"])
    per_salt = hot_rows.groupBy("key", "salt").agg(F.min("id").alias("least"), F.count("*").alias("n"))
    least = per_salt.groupBy("key").agg(F.min("least").alias("keep_id"), F.sum("n").alias("copies"))
    rest = counts.where(F.col("copies") <= hot).select("key", "keep_id", "copies")
    beside = hot_rows.join(F.broadcast(least.select("key", "keep_id")), "key") if few else hot_rows.join(least.select("key", "keep_id").join(every, "key"), ["key", "salt"])
    return rest.unionByName(least.select("key", "keep_id", "copies")), beside.select("key", "id", "keep_id")


def hidden_copies(df: DataFrame, id_col: str = "id", text_col: str = "resume_str", least_words: int = MIN_WORDS, hot: int = HOT, **options) -> DataFrame:
    """(keep_id, copy_id) for every record that is a copy of one with a smaller id."""
    records = cut(keyed(df, id_col, text_col, least_words).distinct())
    groups, hot_rows = grouped(records, hot, **options)
    repeated = groups.where((F.col("copies") > 1) & (F.col("copies") <= hot)).select("key", "keep_id")
    rest = records.join(repeated.hint("shuffle_hash"), "key").select("id", "keep_id")
    return rest.unionByName(hot_rows.select("id", "keep_id")).where("keep_id <> id").select("keep_id", F.col("id").alias("copy_id"))


def copy_counts(df: DataFrame, id_col: str = "id", text_col: str = "resume_str", least_words: int = MIN_WORDS, hot: int = HOT, **options) -> DataFrame:
    """(keep_id, copies): one row per distinct record and how many records it stands for."""
    return grouped(cut(keyed(df, id_col, text_col, least_words).distinct()), hot, **options)[0].select("keep_id", "copies")
