"""The stateless analysis over streams of Parquet or text files: no state to keep, so nothing grows with time."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from scrivane.plans.analyze import analyzed


def parquet_stream(spark: SparkSession, folder: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def text_stream(spark: SparkSession, folder: str) -> DataFrame:
    """(id, resume_str, category): each file one document, its name hashed to an id."""
    rows = spark.readStream.option("wholetext", True).text(folder)
    return rows.select(F.xxhash64(F.input_file_name()).alias("id"), F.col("value").alias("resume_str"), F.lit("Unknown").alias("category"))


def start_analysis(docs: DataFrame, dictionary: Mapping[str, str], out: str, checkpoint: str) -> StreamingQuery:
    """Write analyses as Parquet, exactly once, until what is there now is done."""
    return analyzed(docs, dictionary).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
