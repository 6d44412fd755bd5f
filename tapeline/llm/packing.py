"""Sum-of-squares online packing of tokenized documents into sequences of a fixed length."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tapeline.llm.bpe import encoder
from tapeline.llm.common import chunks, only, small_batches, texts

#: Sequences that one partition may number.
SHARD = 1 << 40


class Packer:
    """Places pieces as they come; ``levels[h]`` counts open sequences that hold h tokens.

    A piece goes where the sum of the squared counts grows least: into a sequence
    of some fill level, or into a new one. Sequences are given back when full; at
    the end the pieces of the emptiest open ones are cut into the gaps of the
    fullest, so that one sequence at most stays short.
    """

    def __init__(self, capacity: int, first: int = 0):
        self.capacity, self.next = capacity, first
        self.levels = np.zeros(capacity + 1, np.int64)
        self.open: list[list[tuple[int, list]]] = [[] for _ in range(capacity + 1)]

    def level_for(self, size: int) -> int:
        """The fill level to use; 0 stands for a new sequence."""
        n, cap = self.levels, self.capacity
        after = n[size : cap + 1].copy()
        grown = 2 * (after - n[: cap - size + 1] + 1)
        grown[0] = 2 * n[size] + 1
        grown[cap - size] = 1 - 2 * n[cap - size]
        usable = n[: cap - size + 1] > 0
        usable[0] = True
        best = np.where(usable, grown, np.iinfo(np.int64).max)
        return int(len(best) - 1 - best[::-1].argmin())

    def place(self, piece: tuple) -> Iterator[tuple]:
        """piece: (doc_id, start, ids as bytes, doc_tokens). Yields the rows of sequences that are now full."""
        size = len(piece[2]) // 4
        if size == self.capacity:
            self.next += 1
            yield (*piece, self.next - 1, 0)
            return
        level = self.level_for(size)
        if level:
            number, pieces = self.open[level].pop()
            self.levels[level] -= 1
        else:
            number, pieces = self.next, []
            self.next += 1
        pieces.append(piece)
        if level + size == self.capacity:
            yield from self.rows(number, pieces)
        else:
            self.open[level + size].append((number, pieces))
            self.levels[level + size] += 1

    @staticmethod
    def rows(number: int, pieces: list) -> Iterator[tuple]:
        at = 0
        for piece in pieces:
            yield (*piece, number, at)
            at += len(piece[2]) // 4

    def finish(self) -> Iterator[tuple]:
        left = [(level, *s) for level in range(self.capacity, 0, -1) for s in self.open[level]]
        head, tail = 0, len(left) - 1
        while head < tail:
            level, number, pieces = left[head]
            while level < self.capacity and head < tail:
                donor = left[tail][2]
                doc, start, ids, total = donor.pop()
                take = min(len(ids) // 4, self.capacity - level)
                pieces.append((doc, start, ids[: 4 * take], total))
                level += take
                if 4 * take < len(ids):
                    donor.append((doc, start + take, ids[4 * take :], total))
                if not donor:
                    tail -= 1
            if level == self.capacity:
                yield from self.rows(number, pieces)
                head += 1
            else:
                left[head] = (level, number, pieces)
        if head == tail:
            yield from self.rows(*left[head][1:])


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, ids, doc_tokens, sequence_id, offset): one row for each piece of a document.

    A document is its token ids and then end_id; a null or empty text is end_id
    alone. ids holds a piece as little-endian unsigned 32-bit values. Documents
    longer than a sequence give whole sequences and a rest. Each input partition
    packs its own documents in one pass: nothing is shuffled, the work in memory is
    the open sequences, and a repeated task numbers its sequences as before. Null
    and repeated ids keep their pieces; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("ids")
        ids_of, end = encoder(tokenizer_path).many, np.array([end_id], "<u4").tobytes()
        packer = Packer(capacity, TaskContext.get().partitionId() * SHARD)
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        names = ["doc_id", "start", "ids", "doc_tokens", "sequence_id", "offset"]

        def placed() -> Iterator[tuple]:
            for batch in small_batches(batches):
                docs_, texts_ = batch.column("doc_id").to_pylist(), [t or "" for t in batch.column("text").to_pylist()]
                for part in chunks([len(t) for t in texts_]):
                    for doc, ids in zip(docs_[part], ids_of(texts_[part]), strict=True):
                        ids += end
                        total = len(ids) // 4
                        for at in range(0, total, capacity):
                            yield from packer.place((doc, at, ids[4 * at : 4 * (at + capacity)], total))
            yield from packer.finish()

        def batched(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        held: list[tuple] = []
        for row in placed():
            held.append(row)
            if len(held) >= 4096:
                yield batched(held)
                held = []
        if held:
            yield batched(held)

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, start long, ids binary, doc_tokens long, sequence_id long, offset long")
