"""Merkle manifest of a table: a forest of hash trees kept as append logs in postorder, and proofs read from them.

Every tree has fan-out FAN and one level for each round of runs of FAN nodes, the
last run shorter. Its log holds the nodes in the order in which an appending
writer completes them: a leaf, then each ancestor whose last leaf it is. Where a
node stands follows from sizes of subtrees alone (``position``), so builders of
aligned runs write their parts of a log independently, and a proof finds its
siblings by arithmetic.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeline.llm.common import checkpointed
from tapeline.sources.logs import number_rows

#: Children of a node, as a power of two.
FAN_BITS = 3
FAN = 1 << FAN_BITS
#: Levels that one builder completes over its run of FAN**SPAN nodes.
SPAN = 3

#: A node of a log: its tree's number of leaves and height, its level and place there, its place in the log; a leaf's row id and offered digest.
NODE = "tree string, n long, height int, level int, idx long, pos long, digest string, id long, offered string"
NODE_SCHEMA = pa.schema([("tree", pa.string()), ("n", pa.int64()), ("height", pa.int32()), ("level", pa.int32()), ("idx", pa.int64()), ("pos", pa.int64()), ("digest", pa.string()), ("id", pa.int64()), ("offered", pa.string())])
STEP = "array<struct<at: int, siblings: array<string>>>"
PROOF = f"tree string, idx long, id long, digest string, offered string, subroot string, root string, path {STEP}"
STEP_TYPE = pa.list_(pa.struct([("at", pa.int32()), ("siblings", pa.list_(pa.string()))]))
PROOF_SCHEMA = pa.schema([("tree", pa.string()), ("idx", pa.int64()), ("id", pa.int64()), ("digest", pa.string()), ("offered", pa.string()), ("subroot", pa.string()), ("root", pa.string()), ("path", STEP_TYPE)])


def digest(*parts: Column) -> Column:
    """Lowercase hex sha256 of the parts, concatenated."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field(value: Column) -> Column:
    """`-` for null, else the number of UTF-8 bytes, `:` and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def tree_key(by: Column) -> Column:
    """A tree's name: null sorts before all others, which sort by their bytes."""
    return F.coalesce(F.concat(F.lit("="), by.cast("string")), F.lit("-"))


def width(level: int, n: int) -> int:
    """Nodes on a level of a tree of n leaves."""
    return -(-n >> FAN_BITS * level)


def height(n: int) -> int:
    """Levels over the leaves of a tree of n leaves: runs are folded while more than one node is left."""
    h = 0
    while width(h, n) > 1:
        h += 1
    return h


def position(level: int, idx: int, n: int) -> int:
    """Where the log of a tree of n leaves has a node: after all that is completed before its last leaf, and the levels from that up."""
    last = min((idx + 1) << FAN_BITS * level, n) - 1
    at, under = last + level, last >> FAN_BITS
    while under:
        at, under = at + under, under >> FAN_BITS
    return at


def builder(base: int) -> Callable:
    """Appends one aligned run of a level's nodes, in order, and each node that is completed by one, up to SPAN levels."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("idx")
        tree, n, first = (rows.column(c)[0].as_py() for c in ("tree", "n", "idx"))
        h, nodes = height(n), width(base, n)
        top = min(SPAN, h - base)
        log: list[tuple] = []
        open_: list[list[str]] = [[] for _ in range(top + 1)]
        own = zip(rows.column("digest").to_pylist(), rows.column("id").to_pylist(), rows.column("offered").to_pylist(), strict=True)
        for i, (node, id_, offered) in enumerate(own, first):
            if base == 0:
                log.append((0, i, node, id_, offered))
            open_[0].append(node)
            for up in range(1, top + 1):
                if (i + 1) % (1 << FAN_BITS * up) and i + 1 != nodes:
                    break
                node = hashlib.sha256("".join(open_[up - 1]).encode()).hexdigest()
                open_[up - 1].clear()
                open_[up].append(node)
                log.append((base + up, i >> FAN_BITS * up, node, None, None))
        level, idx, digests, ids, offers = zip(*log, strict=True) if log else ([],) * 5
        at = [position(a, b, n) for a, b in zip(level, idx, strict=True)]
        return pa.table([[tree] * len(at), [n] * len(at), [h] * len(at), level, idx, at, digests, ids, offers], schema=NODE_SCHEMA)

    return run


def append_logs(leaves: DataFrame) -> DataFrame:
    """The nodes of all trees (NODE). leaves(tree, n, idx, digest, id, offered), idx from 0 in each tree.

    A round for each SPAN levels, over the tops that the round before left: 1 / FAN**SPAN of its rows.
    """
    most = height(leaves.agg(F.max("n")).first()[0] or 0)
    left, log, base = leaves.select("tree", "n", "idx", "digest", "id", "offered"), None, 0
    while log is None or base < most:
        runs = left.groupBy("tree", F.shiftright("idx", FAN_BITS * SPAN).alias("run"))
        made = checkpointed(runs.applyInArrow(builder(base), NODE))
        log = made if log is None else log.unionByName(made)
        base += SPAN
        left = made.where((F.col("level") == base) & (F.col("height") > base)).select("tree", "n", "idx", "digest", "id", "offered")
    return log


def extractor(base: int) -> Callable:
    """Paths of a run's nodes, by the positions of their siblings in the log; each goes on with the path of the node over the run."""

    def run(key: tuple, rows: pa.Table, over: pa.Table) -> pa.Table:
        tree, n, h = (rows.column(c)[0].as_py() for c in ("tree", "n", "height"))
        place = dict(zip(rows.column("pos").to_pylist(), range(rows.num_rows), strict=True))
        digests = rows.column("digest").to_pylist()
        node = lambda level, i: place[position(level, i, n)]
        above = over.slice(0, 1).to_pylist()[0]
        top = min(base + SPAN, h)
        first = key[1].as_py() << FAN_BITS * SPAN
        own = range(first, min(first + (1 << FAN_BITS * SPAN), width(base, n)))
        paths = {first >> FAN_BITS * (top - base): above["path"]}
        for level in range(top - 1, base - 1, -1):
            parents, paths, nodes = paths, {}, width(level, n)
            for parent, path in parents.items():
                children = range(parent << FAN_BITS, min((parent + 1) << FAN_BITS, nodes))
                named = [digests[node(level, c)] for c in children]
                for k, c in enumerate(children):
                    paths[c] = [{"at": k, "siblings": named[:k] + named[k + 1 :]}, *path]
        at = pa.array([node(base, i) for i in own], pa.int64())
        picked = [rows.column(c).take(at) for c in ("id", "digest", "offered")]
        return pa.table([[tree] * len(own), list(own), *picked, [above["subroot"]] * len(own), [above["root"]] * len(own), pa.array([paths[i] for i in own], STEP_TYPE)], schema=PROOF_SCHEMA)

    return run


def proofs(log: DataFrame, over: DataFrame) -> DataFrame:
    """The leaves of all trees (PROOF), each with its siblings at each level, from below, and its place among them.

    over(tree, subroot, root, path) has one row for each tree; its path is what each leaf's goes on
    with. Rounds go from the top: each gives the runs below a row with their path.
    """
    most = height(log.agg(F.max("n")).first()[0] or 0)
    rounds = F.greatest(F.ceil(F.col("height") / SPAN).cast("int") - 1, F.lit(0))
    tops = log.where("level = height").select("tree", rounds.alias("_round"), F.lit(0).cast("long").alias("run")).join(over, "tree")
    found = None
    for r in range(max(0, -(-most // SPAN) - 1), -1, -1):
        base = SPAN * r
        run = F.expr(f"shiftright(idx, {FAN_BITS} * ({base + SPAN} - level))").alias("run")
        own = log.where((rounds >= r) & F.col("level").between(base, base + SPAN)).select("*", run)
        paths = tops.where(F.col("_round") == r).select("tree", "run", "subroot", "root", "path")
        if found is not None:
            paths = paths.unionByName(found.select("tree", F.col("idx").alias("run"), "subroot", "root", "path"))
        paths = paths.toDF("of", "part", "subroot", "root", "path")  # names of their own, as both sides may come from one table
        found = own.groupBy("tree", "run").cogroup(paths.groupBy("of", "part")).applyInArrow(extractor(base), PROOF)
    return found


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings lead to."""

    def step(node: Column, x: Column) -> Column:
        before, after = F.slice(x["siblings"], 1, x["at"]), F.slice(x["siblings"], x["at"] + 1, FAN)
        return digest(F.array_join(before, ""), node, F.array_join(after, ""))

    return F.aggregate(path, leaf, step)


def proof_digest(path: Column) -> Column:
    """sha256 of all siblings of a path, from below, left to right."""
    return digest(F.array_join(F.flatten(F.transform(path, lambda x: x["siblings"])), ""))


def numbered(leaves: DataFrame) -> DataFrame:
    """Leaves with idx from 0 by id, null first, then by digest; n is their tree's number."""
    return number_rows(leaves, ["id", "digest", "offered"], "idx", ["tree"], "n").withColumn("idx", F.col("idx") - 1)


def manifest(docs: DataFrame, by: str, id_col: str, columns: list[str], changed: dict[str, Column] | None = None) -> DataFrame:
    """(id, leaf, subroot, root, path, offered): each row's place in the tree of its ``by``, whose roots are the leaves of one more tree.

    A leaf is the digest of the columns. ``changed`` has columns with other contents;
    ``offered`` is the leaf that those make, to be held against the path. In a tree
    leaves ascend by id, null first; rows that share an id by their digest. A null in
    ``by`` is a tree of its own, before the others. Nulls enter a digest as `-`, empty texts as
    `0:`. Equal rows are a leaf each. An empty table gives no rows. Other columns
    play no part, whatever their names. Texts are read once and go no further than
    their digests.
    """
    own = {c: docs[c] for c in columns}
    contents = lambda x: digest(*(field(v) for v in x.values()))
    leaves = docs.select(tree_key(docs[by]).alias("tree"), docs[id_col].cast("long").alias("id"), contents(own).alias("digest"), contents(own | (changed or {})).alias("offered"))
    log = append_logs(numbered(checkpointed(leaves)))
    subroots = log.where("level = height").select(F.lit("").alias("tree"), F.col("tree").alias("of"), "digest")
    high = number_rows(subroots, ["of"], "idx", ["tree"], "n").withColumn("idx", F.col("idx") - 1)
    named = checkpointed(high.select("idx", "of"))
    high_log = append_logs(high.select("tree", "n", "idx", "digest", F.lit(None).cast("long").alias("id"), F.lit(None).cast("string").alias("offered")))
    whole = high_log.where("level = height").select("tree", F.lit("").alias("subroot"), F.col("digest").alias("root"), F.array().cast(STEP).alias("path"))
    over = proofs(high_log, whole).join(named, "idx").select(F.col("of").alias("tree"), F.col("digest").alias("subroot"), "root", "path")
    return proofs(log, checkpointed(over)).select("id", F.col("digest").alias("leaf"), "subroot", "root", "path", "offered")
