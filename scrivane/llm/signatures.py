"""Per-record signatures that problems 2 and 3 share: class keys, representatives and packed values."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrivane.llm.blocks import LIST
from scrivane.llm.words import MIN_WORDS, Frequencies, IdFilter, bucket_counts, distinct, grams, id_filter, multiset_key, pack40, sketch, word_hashes
from scrivane.runtime import cut, spread

KEY = ["set1", "set2", "bag1", "bag2"]


def texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text) of rows that have both; every other column, whatever its name, is pruned at the scan."""
    return spread(df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null"), "id")


def shingle_frequencies(rows: DataFrame, least_words: int) -> Frequencies:
    """Bucket counts of the distinct shingles of all records: the global order of shingles, rarest first."""

    def values(batch):
        for text in batch.column("text").to_pylist():
            h = word_hashes(text)
            if len(h) >= least_words:
                yield distinct(grams(h))

    return bucket_counts(rows.select("text"), values)


def record_signatures(rows: DataFrame, tokens_of: Callable, least_words: int = MIN_WORDS, whole: bool = False) -> DataFrame:
    """(id, class key, n, sketch, near, tokens, places, parts[, value]), checkpointed.

    ``tokens_of(hashes, distinct)`` gives the record's posted tokens (uint64), their positions and estimated frequencies.
    ``parts`` says into how many parts a token's list is cut. Records of one class have the same shingle set and the same
    words equally often; ``near`` is equal for most highly similar sets; ``value`` is the packed set, with ``whole``.
    """
    kinds = {"id": "long", **dict.fromkeys(KEY, "long"), "n": "int", "sketch": "binary", "near": "long", "tokens": "binary", "places": "binary", "parts": "binary"} | ({"value": "binary"} if whole else {})
    longest = LIST
    arrow = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}

    def part(batches):
        for batch in batches:
            out: list[tuple] = []
            for i, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
                h = word_hashes(text)
                if len(h) < least_words:
                    continue
                shingles = distinct(grams(h))
                tokens, places, often = tokens_of(h, shingles)
                bits, near = sketch(shingles)
                parts = np.minimum(-(-often // longest), 65535).clip(1).astype("<u2")
                row = (i, *multiset_key(shingles), *multiset_key(h), len(shingles), bits, near, tokens.astype("<u8").tobytes(), places.astype("<u4").tobytes(), parts.tobytes())
                out.append((*row, pack40(shingles)) if whole else row)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, arrow[k]) for c, k in zip(zip(*out), kinds.values())], list(kinds))

    return cut(rows.mapInArrow(part, ", ".join(f"{c} {k}" for c, k in kinds.items())))


def classes(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(class key, rep) with the smallest id of each class, and (id, rep, bag) of every record once."""
    members = records.select("id", *KEY).distinct()
    reps = members.groupBy(*KEY).agg(F.min("id").alias("rep"))
    return reps, members


def involved(pairs: DataFrame) -> IdFilter:
    """A filter of the ids that occur in checkpointed pairs."""
    return id_filter(pairs.select(F.explode(F.array("a", "b")).alias("id")), 2 * pairs.count())


def fetched(records: DataFrame, wanted: IdFilter, *columns: str) -> DataFrame:
    """(id, columns) of the checkpointed records that the filter lets through, one row per id, checkpointed."""
    shared = records.sparkSession.sparkContext.broadcast(wanted)  # 16 MB at most
    rows = records.select("id", *columns)

    def part(batches):
        for batch in batches:
            yield batch.filter(pa.array(shared.value.holds(batch.column("id").to_numpy(zero_copy_only=False))))

    return cut(rows.mapInArrow(part, rows.schema).dropDuplicates(["id"]))


def packed_values(rows: DataFrame, wanted: IdFilter, value_of: Callable, least_words: int = MIN_WORDS) -> DataFrame:
    """(id, value) of the records that the filter lets through, one row per id, checkpointed."""
    shared = rows.sparkSession.sparkContext.broadcast(wanted)  # 16 MB at most

    def part(batches):
        for batch in batches:
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            out_ids, out = [], []
            for k in np.flatnonzero(shared.value.holds(ids)):
                h = word_hashes(batch.column("text")[int(k)].as_py())
                if len(h) >= least_words:
                    out_ids.append(int(ids[k]))
                    out.append(value_of(h))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out_ids, pa.int64()), pa.array(out, pa.binary())], ["id", "value"])

    return cut(rows.mapInArrow(part, "id long, value binary").dropDuplicates(["id"]))


def with_values(pairs: DataFrame, values: DataFrame) -> DataFrame:
    """Attach both records' packed values: two shuffles on ids, never a product."""
    return (
        pairs.join(values.select(F.col("id").alias("a"), F.col("value").alias("value_a")), "a")
        .join(values.select(F.col("id").alias("b"), F.col("value").alias("value_b")), "b")
    )
