"""Near-duplicate vectors by randomised-rotation binary codes with stored correction factors.

A unit vector x is turned by random orthogonal matrices; the signs of a turned
vector are its code, and ``<sign / sqrt(D), turned x>`` is stored beside it as the
correction factor. ``<sign / sqrt(D), turned y> / factor`` is then an unbiased
estimate of ``<x, y>`` with a known spread, so most pairs that are looked at are
settled by codes, and only those whose confidence bound reaches the limit are
recomputed from the vectors in double precision. Which pairs are looked at at all
is decided by runs of the same code bits, used as keys of hash tables.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeline.llm.common import checkpointed
from tapeline.llm.components import components

#: Chance that a pair exactly at the limit shares no table.
MISS = 1e-3
#: Rotations whose codes make an estimate, and spreads that its bound allows for.
CODE_ROTATIONS, SPREADS = 4, 4.5
#: Vectors in a tile: two tiles are compared at a time.
TILE = 512


def plan_tables(n: int, cosine: float) -> tuple[int, int]:
    """Bits of a key and number of tables for n vectors: keys grow with log n, tables follow from MISS."""
    same = 1 - math.acos(cosine) / math.pi
    bits = min(64, max(10, math.ceil(math.log2(max(n, 2))) + 4))
    return bits, math.ceil(math.log(MISS) / math.log1p(-(same**bits)))


def rotations(dim: int, count: int, seed: int) -> np.ndarray:
    """count random orthogonal matrices, one below the other; the first ones don't depend on count."""
    rng = np.random.default_rng(seed + dim)
    return np.concatenate([np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(count)])


def _coded(bits: int, tables: int, seed: int):
    known: dict[int, np.ndarray] = {}

    def code(ids: list, rows: list[np.ndarray]) -> dict[str, list]:
        x = np.stack(rows)
        dim = x.shape[1]
        if dim not in known:
            known[dim] = rotations(dim, max(CODE_ROTATIONS, -(-bits * tables // dim)), seed)
        turned = (x / np.sqrt((x * x).sum(1))[:, None]) @ known[dim].T
        sign = turned > 0
        factors = np.abs(turned[:, : CODE_ROTATIONS * dim].reshape(len(x), CODE_ROTATIONS, dim)).sum(2) / math.sqrt(dim)
        keys = np.zeros((len(x), tables, 8), np.uint8)
        keys[:, :, : -(-bits // 8)] = np.packbits(sign[:, : bits * tables].reshape(len(x), tables, bits), axis=2)
        return {"vec_id": ids, "dim": [dim] * len(x), "keys": list(keys.view(np.int64)[:, :, 0]), "vector": [v.tobytes() for v in x], "code": [c.tobytes() for c in np.packbits(sign, axis=1)], "factors": [f.tobytes() for f in factors]}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["vec_id", "dim", "keys", "vector", "code", "factors"]
        kinds = [pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary()]
        for batch in batches:
            by_dim: dict[int, tuple[list, list]] = {}
            for i, v in zip(batch.column("vec_id").to_pylist(), batch.column("embedding").to_pylist(), strict=True):
                x = np.array(v if v and None not in v else [0], np.float64)
                if i is not None and np.isfinite(x).all() and x.any():
                    ids, rows = by_dim.setdefault(len(x), ([], []))
                    ids.append(i)
                    rows.append(x / np.abs(x).max())
                else:
                    yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip([i, 0, None, None, None, None], kinds, strict=True)], names=names)
            for ids, rows in by_dim.values():
                for at in range(0, len(ids), 256):
                    made = code(ids[at : at + 256], rows[at : at + 256])
                    yield pa.RecordBatch.from_arrays([pa.array(made[n], k) for n, k in zip(names, kinds, strict=True)], names=names)

    return run


class Tile:
    """Rows of one table entry, unpacked."""

    def __init__(self, pdf: pd.DataFrame, turn: np.ndarray):
        stack = lambda c, kind: np.frombuffer(b"".join(pdf[c]), kind).reshape(len(pdf), -1)
        x = stack("vector", np.float64)
        dim = x.shape[1]
        self.dim, self.id, self.copies = dim, pdf["vec_id"].to_numpy(), pdf["copies"].to_numpy()
        self.unit = x / np.sqrt((x * x).sum(1))[:, None]
        self.code, factors = stack("code", np.uint8), stack("factors", np.float64)
        sign = np.unpackbits(self.code, axis=1)[:, : CODE_ROTATIONS * dim].reshape(len(pdf), CODE_ROTATIONS, dim) * np.float32(2) - 1
        self.scaled = (sign / (math.sqrt(dim) * CODE_ROTATIONS * factors[:, :, None])).astype(np.float32).reshape(len(pdf), -1)
        self.turned = (self.unit @ turn.T).astype(np.float32)
        self.slack = SPREADS * np.sqrt((np.maximum(1 / factors**2 - 1, 0) / max(dim - 1, 1)).sum(1)) / CODE_ROTATIONS + 1e-5


def settled(x: Tile, y: Tile, cosine: float, pairs: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """Of the pairs (row of x, row of y) given, or else of all, those with at least the cosine; and how many had to be recomputed."""
    if pairs is None:
        i, j = np.nonzero(x.scaled @ y.turned.T + x.slack[:, None] >= cosine)
    else:
        near = np.einsum("ij,ij->i", x.scaled[pairs[0]], y.turned[pairs[1]]) + x.slack[pairs[0]] >= cosine
        i, j = pairs[0][near], pairs[1][near]
    exact = np.concatenate([np.einsum("ij,ij->i", x.unit[i[a : a + 20000]], y.unit[j[a : a + 20000]]) for a in range(0, len(i), 20000)] or [np.zeros(0)])
    yes = exact >= cosine
    return i[yes], j[yes], len(i)


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each end of the pairs with the smallest one that they join it to."""
    root = {k: k for k in np.unique(np.concatenate([u, v])).tolist()}

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    for a, b in zip(u.tolist(), v.tolist(), strict=True):
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return np.array(list(root), np.int64), np.array([find(k) for k in root], np.int64)


def _compare(bits: int, tables: int, cosine: float, seed: int):
    turns: dict[int, np.ndarray] = {}
    entry = ["dim", "t", "key", "p", "q"]

    def first_shared(x: Tile, y: Tile, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i), np.int64)
        for a in range(0, len(i), 4096):
            s = slice(a, a + 4096)
            differ = np.unpackbits(x.code[i[s]] ^ y.code[j[s]], axis=1)[:, : bits * tables]
            out[s] = (~differ.reshape(len(differ), tables, bits).any(2)).argmax(1)
        return out

    def pairs_of(pdf: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(id, id, copies, copies) of the linked pairs of whole entries, each in the first table that its ends share."""
        for dim, own in pdf.groupby("dim", sort=False):
            if dim not in turns:
                turns[dim] = rotations(int(dim), CODE_ROTATIONS, seed)
            number = own.groupby(entry, sort=False).ngroup().to_numpy()
            size = np.bincount(number)
            large = size[number] > 48
            small = own[~large]
            parts = [(small, number[~large], True)] + [(own[number == g], None, False) for g in np.unique(number[large])]
            for part, group, many in parts:
                if not len(part):
                    continue
                same = (part["p"] == part["q"]).to_numpy()
                if many:
                    x = y = Tile(part, turns[dim])
                    found = []
                    tile = part["tile"].to_numpy()
                    for d in range(1, int(np.bincount(group).max())):
                        i = np.flatnonzero(group[d:] == group[:-d])
                        i = i[same[i] | (tile[i] != tile[i + d])]
                        found.append(settled(x, x, cosine, (i, i + d))[:2])
                    i, j = (np.concatenate([f[k] for f in found] or [np.zeros(0, np.int64)]).astype(np.int64) for k in (0, 1))
                elif same[0]:
                    x = y = Tile(part, turns[dim])
                    i, j, _ = settled(x, y, cosine)
                    i, j = i[i < j], j[i < j]
                else:
                    x, y = (Tile(part[part["tile"] == part[c].iloc[0]], turns[dim]) if (part["tile"] == part[c].iloc[0]).any() else None for c in "pq")
                    if x is None or y is None:
                        continue
                    i, j, _ = settled(x, y, cosine)
                at = part["t"].to_numpy()[i] if many else int(part["t"].iloc[0])
                now = first_shared(x, y, i, j) == at
                i, j = i[now], j[now]
                yield x.id[i], y.id[j], x.copies[i], y.copies[j]

    def result(pdf: pd.DataFrame) -> pd.DataFrame:
        found = list(pairs_of(pdf))
        u, v, m, n = (np.concatenate([f[k] for f in found] or [np.zeros(0)]).astype(np.int64) for k in range(4))
        ends, roots = forest(u, v)
        others = pd.Series(np.concatenate([n, m]), dtype=np.int64).groupby(np.concatenate([u, v])).sum()
        return pd.DataFrame({"a": ends, "b": roots, "n": others.reindex(ends).to_numpy(np.int64, na_value=0) if len(ends) else np.zeros(0, np.int64)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        rows = 0
        for pdf in batches:
            for at in range(0, len(pdf), 2048):
                held.append(pdf.iloc[at : at + 2048])
                rows += len(held[-1])
                if rows >= 4096:
                    own = pd.concat(held, ignore_index=True)
                    last = (own[entry] != own[entry].shift(-1)).any(axis=1).to_numpy()[:-1]
                    cut = int(np.flatnonzero(last)[-1]) + 1 if last.any() else 0
                    if cut:
                        yield result(own.iloc[:cut].reset_index(drop=True))
                    held, rows = [own.iloc[cut:]], len(own) - cut
        if rows:
            yield result(pd.concat(held, ignore_index=True))

    return run


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.9, seed: int = 20) -> DataFrame:
    """(vec_id, n_links, component_id, kept): one row for each vector.

    Vectors of the same length link when their cosine, in double precision, reaches
    the limit. n_links counts the vectors linked directly, component_id is the
    smallest vec_id reachable. A pair at the limit is looked at with probability
    1 - MISS, a closer one with more. Equal vectors are one class: a class counts
    its members and is compared once. Members of a table's entry are compared in
    tiles, which are dealt out one by one, and give counts and a spanning forest,
    never their pairs. Vectors that are null, empty, zero or hold nulls or
    non-finite values link with nothing, nor does a row with a null vec_id; rows
    that repeat a vec_id count as vectors of their own. An empty table gives no rows.
    """
    rows = vectors.select(vectors[id_col].cast("long").alias("vec_id"), vectors[vector_col].cast("array<double>").alias("embedding"))
    bits, tables = plan_tables(rows.count(), cosine)
    coded = checkpointed(rows.mapInArrow(_coded(bits, tables, seed), "vec_id long, dim int, keys array<long>, vector binary, code binary, factors binary"))
    valid = coded.where("vector is not null")
    classes = checkpointed(valid.groupBy("vector").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("dim").alias("dim"), F.first("keys").alias("keys"), F.first("code").alias("code"), F.first("factors").alias("factors")).withColumn("class", F.xxhash64("vector", "rep")))

    keyed = classes.select("class", "dim", F.posexplode("keys").alias("t", "key"))
    sizes = keyed.groupBy("dim", "t", "key").agg(F.count("*").alias("n")).where("n > 1")
    members = keyed.join(sizes, ["dim", "t", "key"]).withColumn("tiles", F.ceil(F.col("n") / TILE).cast("int")).withColumn("tile", F.pmod("class", F.col("tiles")).cast("int"))
    duels = members.withColumn("_d", F.explode(F.expr("transform(sequence(0, tiles - 1), o -> struct(least(o, tile) as p, greatest(o, tile) as q))"))).select("class", "t", "key", "tile", "_d.p", "_d.q")
    packed = duels.join(classes.select("class", "dim", F.col("rep").alias("vec_id"), "copies", "vector", "code", "factors"), "class")
    entries = packed.repartition("dim", "t", "key", "p", "q").sortWithinPartitions("dim", "t", "key", "p", "q", "tile", "class")
    partial = checkpointed(entries.select("vec_id", "copies", "dim", "t", "key", "p", "q", "tile", "vector", "code", "factors").mapInPandas(_compare(bits, tables, cosine, seed), "a long, b long, n long"))

    counted = partial.groupBy("a").agg(F.sum("n").alias("others"))
    joined = components(partial.select("a", "b"))
    per_class = classes.join(counted, classes["rep"] == counted["a"], "left").join(joined, classes["rep"] == joined["id"], "left")
    per_class = per_class.select("vector", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component_id", "rep").alias("component_id"))
    out = coded.select("vec_id", "vector").join(per_class, "vector", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
