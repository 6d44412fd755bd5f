"""Byte-pair token counts by heap and linked list, and cached byte-pair ids.

Both look at a text as the runs between single spaces, since a space that follows
and precedes other text always starts a new piece; what a run gives is remembered.
Texts in which white space runs make that untrue take the slower way.
"""

from __future__ import annotations

import heapq
import json
import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tapeline.llm.common import only, remembered, small_batches, texts

#: Fixed value: the piece pattern of the byte-level pre-tokenizer, as published with the vocabulary.
PIECES = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Where runs between single spaces can't stand for themselves.
MIXED = re.compile(r" \s|\s $|^\s")


class Remembered(dict):
    """key -> make(key). Holds two generations of ``limit`` keys: what is asked for again outlives the change."""

    def __init__(self, make: Callable, limit: int = 700_000):
        super().__init__()
        self.make, self.limit, self.older = make, limit, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(key) < 200:
            self.room()
            self[key] = value
        return value

    def room(self) -> None:
        if len(self) >= self.limit:
            self.older = dict(self)
            self.clear()


def byte_symbols() -> dict[int, str]:
    """The printable stand-in of each byte: itself where printable, else the next free character from 256."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return {b: chr(b) if b in own else chr(next(free)) for b in range(256)}


class MergeCounter:
    """Counts the tokens of texts under the merge list of a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pairs = (tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"])
        self.ranks = {pair: i for i, pair in enumerate(pairs)}
        self.symbols = byte_symbols()
        self.specials = [t["content"] for t in spec.get("added_tokens", [])]
        self.special = re.compile("|".join(map(re.escape, sorted(self.specials, key=len, reverse=True))) or r"(?!)")
        self.pattern = regex.compile(PIECES)
        self.piece = Remembered(self.merged)
        self.run = Remembered(lambda run: sum(map(self.piece.__getitem__, self.pattern.findall(" " + run))))

    def merged(self, piece: str) -> int:
        """Initial symbols minus merges: the lowest-ranked adjacent pair merges first, the leftmost of equals."""
        symbols = piece.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.symbols)
        n, ranks = len(symbols), self.ranks
        token, after, before = list(symbols), list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := ranks.get((symbols[i], symbols[i + 1]))) is not None]
        heapq.heapify(heap)
        merges = 0
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            if token[i] is None or j >= n or ranks.get((token[i], token[j])) != rank:
                continue
            token[i] += token[j]
            token[j] = None
            after[i] = k = after[j]
            merges += 1
            if k < n:
                before[k] = i
                if (r := ranks.get((token[i], token[k]))) is not None:
                    heapq.heappush(heap, (r, i))
            if (h := before[i]) >= 0 and (r := ranks.get((token[h], token[i]))) is not None:
                heapq.heappush(heap, (r, h))
        return n - merges

    def count(self, text: str) -> int:
        if any(s in text for s in self.specials):
            parts = self.special.split(text)
            return len(parts) - 1 + sum(map(self.count, parts))
        if MIXED.search(text):
            return sum(map(self.piece.__getitem__, self.pattern.findall(text)))
        first, *rest = text.split(" ")
        return sum(map(self.piece.__getitem__, self.pattern.findall(first))) + sum(map(self.run.__getitem__, rest))


_counters: dict[str, MergeCounter] = {}
remembered["counts"] = [_counters]


def counter(path: str) -> MergeCounter:
    if path not in _counters:
        _counters[path] = MergeCounter(path)
    return _counters[path]


def token_counts(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens): one row for each document, in one pass without a shuffle.

    Tokens are counted as the tokenizer file defines them, without begin or end
    tokens; a special string inside a text counts as its one token. Null and empty
    texts have 0 bytes and 0 tokens. Any other column is ignored; null and repeated
    ids keep their rows; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("counts")
        count = counter(tokenizer_path).count
        for batch in small_batches(batches):
            own = [t or "" for t in batch.column("text").to_pylist()]
            sizes = pa.array([len(t.encode("utf-8", "surrogatepass")) for t in own], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), sizes, pa.array(map(count, own), pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")


class IdEncoder:
    """Ids of texts as little-endian unsigned 32-bit bytes, by the tokenizers library."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            self.specials = [t["content"] for t in json.load(f).get("added_tokens", [])]
        self.run = Remembered(lambda run: self.whole([" " + run])[0])

    def whole(self, texts_: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts_, add_special_tokens=False)
        return [np.array(x.ids, "<u4").tobytes() for x in found]

    def many(self, texts_: list[str]) -> list[bytes]:
        """The ids of each text; runs that are new to all of them are encoded in one call."""
        plain = [not (MIXED.search(t) or any(s in t for s in self.specials)) for t in texts_]
        runs = [t.split(" ") if p else [] for t, p in zip(texts_, plain, strict=True)]
        new = [r for r in set().union(*runs) if r not in self.run and r not in self.run.older]
        for at in range(0, len(new), 20_000):
            part = new[at : at + 20_000]
            for r, ids in zip(part, self.whole([" " + r for r in part]), strict=True):
                self.run.room()
                self.run[r] = ids
        first = self.whole([t if not p else r[0] for t, p, r in zip(texts_, plain, runs, strict=True)])
        return [f + b"".join(map(self.run.__getitem__, r[1:])) for f, r in zip(first, runs, strict=True)]

    def ids(self, text: str) -> bytes:
        return self.many([text])[0]


_encoders: dict[str, IdEncoder] = {}
remembered["ids"] = [_encoders]


def encoder(path: str) -> IdEncoder:
    if path not in _encoders:
        _encoders[path] = IdEncoder(path)
    return _encoders[path]
