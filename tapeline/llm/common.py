"""Shared helpers of the corpus operators: checkpoints, blocks of documents, word hashes.

A *block* is a group of whole documents, picked by a hash of the row, that holds
about ``block_bytes`` of text. Operators that need a second look at a text deal
documents out by block once; every later step asks for the same layout, so Spark
reuses that one exchange.
"""

from __future__ import annotations

import gc
import pickle
import string
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeline.sources.shared import shared_folder

#: Bytes of text that a block aims at.
BLOCK_BYTES = 8_000_000
#: Elements that numpy handles at a time inside a task.
CHUNK = 1_000_000


def checkpointed(df: DataFrame) -> DataFrame:
    """The same rows with their lineage cut, kept in the shared folder.

    Shuffle files of steps that earlier checkpoints cut off go when the driver's JVM
    collects garbage, which it seldom needs to by itself; so it is asked to here.
    """
    shared_folder(df.sparkSession)
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()
    return df.checkpoint()


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Two columns only, so that other columns' names can't clash: doc_id long, text string."""
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))


def lowered(text: Column) -> Column:
    """A-Z in lower case, all else as it is; texts of ASCII only take a faster way."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def n_blocks(rows: DataFrame, block_bytes: int = BLOCK_BYTES) -> int:
    """How many blocks the texts make: one number, from one aggregate over the table."""
    total = rows.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    return max(1, -(-int(total) // block_bytes))


def in_blocks(rows: DataFrame, n: int) -> DataFrame:
    """Adds block int; rows with a null or one repeated id are dealt out by their texts."""
    return rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int"))


def packed(rows: DataFrame, block_bytes: int = BLOCK_BYTES, task_bytes: int = 12_000_000) -> DataFrame:
    """Rows of documents (doc_id, text and others) as (block int, payload binary): what a task has for a block at a time, compressed."""
    dealt = in_blocks(rows, n_blocks(rows, block_bytes))
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = {}
        size = 0

        def flushed() -> pa.RecordBatch:
            pack = zstandard.ZstdCompressor(level=3).compress
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([pack(pickle.dumps(v)) for v in held.values()], pa.binary())], names=["block", "payload"])

        for batch in small_batches(batches):
            texts_ = batch.column("text").to_pylist()
            for block, *row in zip(*(batch.column(c).to_pylist() for c in ["block", *names]), strict=True):
                held.setdefault(block, []).append(tuple(row))
            size += sum(len(t or "") for t in texts_)
            if size >= task_bytes:
                yield flushed()
                held, size = {}, 0
        if held:
            yield flushed()

    return dealt.mapInArrow(run, "block int, payload binary")


def unpacked(payloads: Iterable[bytes]) -> list[tuple]:
    """The documents of some payloads, as tuples in the order of their columns."""
    return [row for p in payloads for row in pickle.loads(zstandard.decompress(p))]


#: What operators remember in a Python worker, by operator.
remembered: dict[str, list[dict]] = {}


def only(owner: str) -> None:
    """Python workers are used again by other operators: drops what those have remembered."""
    for name, caches in remembered.items():
        if name != owner:
            for cache in caches:
                cache.clear()


class WordHashes(dict):
    """bytes -> 64-bit hash, remembered; forgets all when it has grown large."""

    LIMIT = 400_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_hashes = WordHashes()
remembered["words"] = [_hashes]


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))


def mix(h: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit values that spreads every bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


BASE = 0x9E3779B97F4A7C15 | 1
_powers = np.ones(1, np.uint64), np.ones(1, np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n."""
    global _powers
    if len(_powers[0]) < n:
        size = max(n, 2 * len(_powers[0]))
        up, down = np.full(size, BASE, np.uint64), np.full(size, pow(BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _powers = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers[0][:n], _powers[1][:n]


class Rolling:
    """Rabin-Karp values of any run of a sequence of 64-bit symbols, from one prefix sum."""

    def __init__(self, symbols: np.ndarray):
        self.up, down = powers(len(symbols) + 1)
        self.prefix = np.zeros(len(symbols) + 1, np.uint64)
        np.cumsum(symbols * down[:-1], out=self.prefix[1:])

    def runs(self, width: int) -> np.ndarray:
        """The values of all runs of the width, by where they start."""
        n = max(0, len(self.prefix) - width)
        return mix((self.prefix[len(self.prefix) - n :] - self.prefix[:n]) * self.up[:n] + np.uint64(width))

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.prefix[end] - self.prefix[start]) * self.up[start] + (end - start).astype(np.uint64))


def chunks(sizes: list[int], limit: int = CHUNK) -> Iterator[slice]:
    """Cuts a list into runs whose sizes add up to about the limit; a larger item is a run of its own."""
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield slice(start, i)
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield slice(start, len(sizes))


def small_batches(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of no more than so many."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
