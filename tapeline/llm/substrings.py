"""Removes words that lie in a window of words that also starts somewhere else, by Rabin-Karp hashes.

Hashes of all windows are counted first. A window whose hash occurs again is counted
once more, by a 128-bit digest of its bytes, so that two different windows with one
hash don't remove each other.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeline.llm.common import BLOCK_BYTES, Rolling, chunks, in_blocks, n_blocks, texts, word_hashes
from tapeline.llm.fingerprints import answered, read_bits, sent


def _words(pdf: pd.DataFrame) -> list[list[bytes]]:
    return [(t or "").encode("utf-8", "surrogatepass").split() for t in pdf["text"]]


def _windows(words: list[list[bytes]], width: int) -> list[np.ndarray]:
    """For each document the hash of the window that starts at each word."""
    out: list[np.ndarray] = []
    for part in chunks([len(w) for w in words]):
        own = words[part]
        runs, at = Rolling(word_hashes([x for w in own for x in w])).runs(width), 0
        for w in own:
            out.append(runs[at : at + max(0, len(w) - width + 1)])
            at += len(w)
    return out


def _joined(hashes: list[np.ndarray]) -> np.ndarray:
    return np.concatenate(hashes or [np.zeros(0, np.uint64)])


def covered(starts: np.ndarray, n: int, width: int) -> np.ndarray:
    """Which of n places a run of the width from one of the starts covers."""
    steps = np.zeros(n + 1, np.int32)
    if len(starts):
        np.add.at(steps, starts, 1)
        np.add.at(steps, np.minimum(starts + width, n), -1)
    return np.cumsum(steps[:-1]) > 0


def intervals(mask: np.ndarray) -> list[tuple[int, int]]:
    """The maximal runs of a mask as (start, end)."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def _send(width: int, buckets: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return sent(int(pdf["block"].iloc[0]), np.unique(_joined(_windows(_words(pdf), width))), buckets)

    return run


def _digests(words: list[list[bytes]], marked: np.ndarray, width: int) -> np.ndarray:
    """A row of two 64-bit values for each marked window, by its bytes: its words joined by one space."""
    out, at = [], 0
    for own in words:
        n = max(0, len(own) - width + 1)
        starts = np.flatnonzero(marked[at : at + n])
        at += n
        if len(starts):
            joined = b" ".join(own)
            sizes = np.fromiter(map(len, own), np.int64, len(own))
            ends = np.cumsum(sizes + 1) - 1
            spans = zip((ends - sizes)[starts].tolist(), ends[starts + width - 1].tolist(), strict=True)
            out.append(b"".join([xxhash.xxh3_128_digest(joined[a:b]) for a, b in spans]))
    return np.frombuffer(b"".join(out), np.uint64).reshape(-1, 2)


def _distinct(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sorted distinct rows, which of them each row is, and how often each occurs."""
    order = np.lexsort((rows[:, 1], rows[:, 0]))
    ranked = rows[order]
    new = np.ones(len(rows), bool)
    new[1:] = (ranked[1:] != ranked[:-1]).any(axis=1)
    where = np.empty(len(rows), np.int64)
    where[order] = np.cumsum(new) - 1
    return ranked[new], where, np.bincount(where)


def _send_again(width: int, buckets: int):
    """Sends the digests of windows whose hashes occur again, and under bucket's complement which windows those are."""

    def run(pdf: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("text")
        words, block = _words(pdf), int(pdf["block"].iloc[0])
        values, where, times = np.unique(_joined(_windows(words, width)), return_inverse=True, return_counts=True)
        marked = (read_bits(answers, values, buckets) | (times > 1))[where]
        own = pd.DataFrame({"bucket": np.array([~(block % buckets)], np.int32), "block": np.array([block], np.int32), "payload": [np.packbits(marked).tobytes()]})
        return pd.concat([own, sent(block, _distinct(_digests(words, marked, width))[0], buckets)])

    return run


def _answered_again(pdf: pd.DataFrame) -> pd.DataFrame:
    """Answers to digests; rows under a complement go back to their blocks as they are."""
    own = pdf["bucket"] < 0
    back = pdf[own].rename(columns={"payload": "bits"})[["block", "bucket", "bits"]]
    return back if own.all() else pd.concat([back, answered(pdf[~own], wide=2)])


def _remove(width: int, buckets: int):
    def run(pdf: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("text")
        words = _words(pdf)
        places = [max(0, len(w) - width + 1) for w in words]
        back = answers["bucket"] < 0
        repeated = np.unpackbits(np.frombuffer(answers["bits"][back].iloc[0], np.uint8), count=sum(places)).astype(bool)
        values, where, times = _distinct(_digests(words, repeated, width))
        repeated[repeated] = (read_bits(answers[~back], values, buckets) | (times > 1))[where]
        rows, at = [], 0
        for doc, own, n in zip(pdf["doc_id"], words, places, strict=True):
            gone = covered(np.flatnonzero(repeated[at : at + n]), len(own), width)
            at += n
            spans = intervals(gone)
            kept = own if not spans else [w for w, g in zip(own, gone.tolist(), strict=True) if not g]
            rows.append((doc, len(own), int(gone.sum()), hashlib.sha256(b" ".join(kept)).hexdigest(), [list(s) for s in spans]))
        made = pd.DataFrame(rows, columns=["doc_id", "n_words", "n_removed", "kept_sha256", "spans"], dtype=object)
        return made.assign(doc_id=pd.array([None if d is None else int(d) for d in made["doc_id"]], "Int64"))

    return run


def repeated_windows(docs: DataFrame, width: int = 35, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, spans): one row for each document.

    A word goes if a window of ``width`` words that covers it has a word sequence
    that also starts anywhere else, in the same document too; windows are judged on
    the input. spans lists the maximal runs [start, end) of words that go. Every
    window of every document has its 64-bit Rabin-Karp hash counted, and those that
    occur again their 128-bit digest. Documents are dealt out once, by block. Null texts, and those shorter than a window, lose nothing; null and
    repeated ids keep their rows, so that repeated rows remove each other's windows;
    an empty table gives no rows.
    """
    # ids travel as text: pandas would turn those of a block with a null id to floating point
    rows = texts(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("string"))
    n = n_blocks(rows, block_bytes)
    dealt = in_blocks(rows, n).groupBy("block")
    hashes = dealt.applyInPandas(_send(width, n), "bucket int, block int, payload binary")
    answers = hashes.groupBy("bucket").applyInPandas(answered, "block int, bucket int, bits binary")
    digests = dealt.cogroup(answers.groupBy("block")).applyInPandas(_send_again(width, n), "bucket int, block int, payload binary")
    # a complement meets its own bucket, so that both are dealt out alike
    again = digests.groupBy(F.when(F.col("bucket") < 0, F.bitwise_not("bucket")).otherwise(F.col("bucket"))).applyInPandas(_answered_again, "block int, bucket int, bits binary")
    return dealt.cogroup(again.groupBy("block")).applyInPandas(_remove(width, n), "doc_id long, n_words long, n_removed long, kept_sha256 string, spans array<array<int>>")
