"""Problem 6: the whole corpus as token ids of a public byte-level BPE tokenizer.

Method. A text is cut by the tokenizer's pattern; each piece's bytes form a doubly linked list of symbols, and a priority
queue of (rank, position) yields the next merge; entries whose symbols have changed since are stale and skipped.
Ids of distinct pieces are kept in a bounded per-worker cache, so the queue runs once for a common piece. Decoding
concatenates the vocabulary's byte strings.

Defined cases: null and empty texts have the empty list; special tokens' strings are ordinary text; blank texts and
texts of any length are encoded as they stand; null ids keep their row; other columns are ignored.
"""

from __future__ import annotations

import base64
import heapq
import os

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrivane.runtime import ship, spread

#: The published split pattern of this vocabulary (a fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
VOCABULARY = os.environ.get("SCRIVANE_BPE_RANKS", "/opt/tokenizers/byte_bpe_50k.tiktoken")
_CACHE = 400_000
_CACHED_LENGTH = 64


def read_ranks(path: str = VOCABULARY) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class Encoder:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.split = regex.compile(PATTERN).findall
        self.cache: dict[str, list[int]] = {}

    def piece(self, data: bytes) -> list[int]:
        """Ids of one piece: merge the lowest rank, leftmost first, until no neighbours merge."""
        ranks = self.ranks
        whole = ranks.get(data)
        if whole is not None:
            return [whole]
        n = len(data)
        symbol: list[bytes | None] = [data[k : k + 1] for k in range(n)]
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        queue = []
        for k in range(n - 1):
            rank = ranks.get(data[k : k + 2])
            if rank is not None:
                queue.append((rank, k, data[k : k + 2]))
        heapq.heapify(queue)
        while queue:
            _, k, merged = heapq.heappop(queue)
            left = symbol[k]
            nxt = after[k]
            if left is None or nxt >= n or len(left) + len(symbol[nxt]) != len(merged):
                continue  # stale: one of the two symbols has been merged since
            symbol[k], symbol[nxt] = merged, None
            after[k] = nxt = after[nxt]
            if nxt < n:
                before[nxt] = k
                pair = merged + symbol[nxt]
                rank = ranks.get(pair)
                if rank is not None:
                    heapq.heappush(queue, (rank, k, pair))
            prev = before[k]
            if prev >= 0:
                pair = symbol[prev] + merged
                rank = ranks.get(pair)
                if rank is not None:
                    heapq.heappush(queue, (rank, prev, pair))
        return [ranks[s] for s in symbol if s is not None]

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        if not text:
            return out
        cache = self.cache
        for p in self.split(text):
            ids = cache.get(p)
            if ids is None:
                ids = self.piece(p.encode("utf-8", "surrogatepass"))
                if len(p) <= _CACHED_LENGTH:
                    if len(cache) >= _CACHE:
                        cache.clear()
                    cache[p] = ids
            out += ids
        return out

    def count(self, text: str | None) -> int:
        return len(self.encode(text))


def by_id(ranks: dict[bytes, int]) -> list[bytes]:
    """The vocabulary's strings in the order of their ids."""
    out = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        out[rank] = token
    return out


def decode(ids, strings: list[bytes]) -> str:
    """The text again: vocabulary strings, concatenated."""
    return b"".join([strings[i] for i in ids]).decode("utf-8", "surrogatepass")


_ENCODERS: dict[int, Encoder] = {}


def worker_encoder(shared) -> Encoder:
    """One encoder, and one cache, per worker process and vocabulary."""
    ranks = shared.value
    key = id(ranks)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(ranks)
    return _ENCODERS[key]


def broadcast_ranks(spark: SparkSession, path: str = VOCABULARY):
    """The rank file is read where the job is started and sent to the workers: about 1 MB, whatever the corpus."""
    ship(spark)
    return spark.sparkContext.broadcast(read_ranks(path))


def encoded(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = VOCABULARY) -> DataFrame:
    """(doc_id, ids): narrow, one row per row."""
    shared = broadcast_ranks(df.sparkSession, path)

    def part(batches):
        encoder = worker_encoder(shared)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                some = batch.slice(at, 1000)
                ids = pa.array([encoder.encode(t) for t in some.column("text").to_pylist()], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), ids], ["doc_id", "ids"])

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return spread(rows, "doc_id").mapInArrow(part, "doc_id long, ids array<int>")


def decoded(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str = VOCABULARY) -> DataFrame:
    """(doc_id, text) of token ids: narrow; null and empty lists give the empty text."""
    ship(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(by_id(read_ranks(path)))  # about 1 MB

    def part(batches):
        for batch in batches:
            texts = [decode(ids or (), shared.value) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids"))
    return rows.mapInArrow(part, "doc_id long, text string")


def token_counts(df: DataFrame, columns: list[str], text_col: str = "text", path: str = VOCABULARY) -> DataFrame:
    """The given columns and n_tokens, without shipping the ids anywhere."""
    shared = broadcast_ranks(df.sparkSession, path)
    rows = df.select(*columns, F.col(text_col).cast("string").alias("_text_"))
    kind = rows.drop("_text_").withColumn("n_tokens", F.lit(0)).schema

    def part(batches):
        encoder = worker_encoder(shared)
        for batch in batches:
            counts = pa.array([encoder.count(t) for t in batch.column("_text_").to_pylist()], pa.int32())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), counts], [*columns, "n_tokens"])

    return spread(rows, columns[0]).mapInArrow(part, kind)
