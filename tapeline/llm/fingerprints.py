"""Finds which fingerprints of a block of documents also occur elsewhere, without a row for each.

A block sends its sorted fingerprints as one binary value per *bucket* (a range of
fingerprints); a bucket marks which of them other blocks hold too and answers with
one bit each, in the same order. A fingerprint is sent once by each block however
often the block holds it, so no bucket grows with a hot text. A fingerprint is 64
bits, or 128 as rows of two columns, sorted by both.
"""

from __future__ import annotations

import numpy as np
import pandas as pd


def bucket_bounds(sorted_values: np.ndarray, buckets: int) -> np.ndarray:
    """Where each of the equal ranges of 64-bit values begins in the sorted values, and their end."""
    width = -(-(1 << 64) // buckets)
    limits = np.array([min(i * width, (1 << 64) - 1) for i in range(1, buckets)], np.uint64)
    return np.concatenate([[0], np.searchsorted(sorted_values, limits), [len(sorted_values)]])


def sent(block: int, values: np.ndarray, buckets: int) -> pd.DataFrame:
    """Rows (bucket, block, payload) of a block's sorted distinct fingerprints."""
    at = bucket_bounds(values if values.ndim == 1 else values[:, 0], buckets)
    own = [i for i in range(buckets) if at[i] < at[i + 1]]
    return pd.DataFrame({"bucket": np.array(own, np.int32), "block": np.full(len(own), block, np.int32), "payload": [values[at[i] : at[i + 1]].tobytes() for i in own]})


def answered(pdf: pd.DataFrame, *, wide: int = 1) -> pd.DataFrame:
    """Rows (block, bucket, bits) for the rows of one bucket: a bit says that another block has the fingerprint of ``wide`` x 64 bits."""
    parts = [np.frombuffer(p, np.uint64).reshape(-1, wide) for p in pdf["payload"]]
    values = np.concatenate(parts)
    order = np.lexsort(values.T[::-1]) if wide > 1 else np.argsort(values[:, 0])
    ranked = values[order]
    twin = np.zeros(len(values), bool)
    same = (ranked[1:] == ranked[:-1]).all(axis=1)
    twin[order[1:][same]] = True
    twin[order[:-1][same]] = True
    ends = np.cumsum([len(p) for p in parts])
    bits = [np.packbits(twin[e - len(p) : e]).tobytes() for p, e in zip(parts, ends, strict=True)]
    return pd.DataFrame({"block": pdf["block"].astype(np.int32), "bucket": pdf["bucket"].astype(np.int32), "bits": bits})


def read_bits(answers: pd.DataFrame, values: np.ndarray, buckets: int) -> np.ndarray:
    """The bits of a block's sorted distinct fingerprints, from its answers."""
    at = bucket_bounds(values if values.ndim == 1 else values[:, 0], buckets)
    out = np.zeros(len(values), bool)
    for bucket, bits in zip(answers["bucket"], answers["bits"], strict=True):
        lo, hi = at[bucket], at[bucket + 1]
        out[lo:hi] = np.unpackbits(np.frombuffer(bits, np.uint8), count=hi - lo).astype(bool)
    return out
