"""Near-duplicate documents by MinHash with tensored banding, links confirmed on whole shingle sets.

With ``k`` minhashes a table and ``m * m`` tables, plain banding needs ``k * m * m``
minhashes. Here two collections of ``m`` keys, each of ``k / 2`` minhashes, are
computed, and table (i, j) is keyed by key i of the first with key j of the
second: ``k * m`` minhashes fill ``m * m`` tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeline.llm.common import CHUNK, Rolling, checkpointed, chunks, mix, only, small_batches, texts, word_hashes
from tapeline.llm.components import components

#: Keys in each of the two collections, and minhashes in each key. At similarity s
#: a pair shares no table with probability under 2 * (1 - s**HALF)**SIDE: 7e-5 at 0.8.
SIDE, HALF = 10, 2
#: Seeds of hashes; of each, the first member meets the others of an entry with several components.
PIVOTS = (1, 2, 3, 4, 5, 6, 7, 8)
#: Documents, at most, that have a rare shingle.
RARE = 4
#: Fixed seeds of the permutations.
SEEDS = mix(np.arange(1, 2 * SIDE * HALF + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def shingle_sets(texts_: list[str | None], width: int) -> list[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its shingles of ``width`` words.

    Words are runs of anything but ASCII white space, A-Z lowered. A shorter text
    is one shingle; null and wordless texts have none.
    """
    out: list[np.ndarray] = []
    for part in chunks([len(t or "") for t in texts_], 2 * CHUNK):
        own = [(t or "").encode("utf-8", "surrogatepass").lower().split() for t in texts_[part]]
        rolling = Rolling(word_hashes([x for w in own for x in w]))
        at = 0
        for w in own:
            n = len(w)
            starts = np.arange(at, at + (max(1, n - width + 1) if n else 0))
            out.append(np.unique(rolling.of(starts, np.minimum(starts + width, at + n))))
            at += n
    return out


def _signatures(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("words")
        for batch in small_batches(batches):
            ids, sets = batch.column("doc_id"), shingle_sets(batch.column("text").to_pylist(), width)
            keys, digests = [], np.zeros((len(sets), 2), np.uint64)
            for i, s in enumerate(sets):
                if not len(s):
                    keys.append(None)
                    continue
                least = np.array([mix(s ^ seed).min() for seed in SEEDS]).reshape(2, SIDE, HALF)
                side = mix(least[..., 0] + mix(least[..., 1] + np.uint64(1)))
                keys.append(np.concatenate([side[0], side[1]]).view(np.int64))
                digests[i] = s.sum(dtype=np.uint64) + np.uint64(len(s)), np.bitwise_xor.reduce(mix(s + np.uint64(7)))
            d = digests.view(np.int64)
            yield pa.RecordBatch.from_arrays([ids, pa.array([len(s) for s in sets], pa.int64()), pa.array(d[:, 0]), pa.array(d[:, 1]), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "d1", "d2", "keys"])

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("words")
        for batch in small_batches(batches):
            sets = shingle_sets(batch.column("text").to_pylist(), width)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["id", "shingles"])

    return run


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs(a, b) with both sizes and the size of the intersection of the whole sets."""
    left = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa")), "a")
    both = left.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb")), "b")
    shared = both.select("a", "b", F.size("sa").alias("na"), F.size("sb").alias("nb"), F.size(F.array_intersect("sa", "sb")).alias("common"))
    return shared.withColumn("either", F.col("na") + F.col("nb") - F.col("common"))


def _mixed(members: DataFrame, found: DataFrame) -> DataFrame:
    """The members, with their components, of table entries that hold more than one component."""
    labelled = members.join(found, "id", "left").withColumn("component_id", F.coalesce("component_id", "id"))
    mixed = labelled.groupBy("key").agg(F.min("component_id").alias("lo"), F.max("component_id").alias("hi")).where("lo <> hi").select("key")
    return checkpointed(labelled.join(mixed, "key", "left_semi").select("key", "table_no", "id", "pivot", "component_id"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): one row for each document.

    Documents link when ``100 * |A & B| >= percent * |A | B|`` for their sets of
    distinct shingles of ``width`` words; component_id is the smallest doc_id
    reachable, kept marks doc_id = component_id. Texts with equal sets are one class,
    stood for by its smallest doc_id, and are never expanded into pairs. In each
    table the members are compared with the smallest one, and where a table then still
    holds several components, with a few others; members of different components that
    are still in one table after that are compared with each other unless the
    triangle inequality of the Jaccard distance rules a link out, so that no pair
    that shares a table is lost. Null, empty or wordless texts have n_shingles 0
    and link with nothing; rows with a null doc_id keep it and are never linked;
    a repeated doc_id gives a row each time
    and, where its texts differ, is linked through each of them. An empty table gives no rows.
    """
    rows = texts(docs, id_col, text_col)
    signed = checkpointed(rows.mapInArrow(_signatures(width), "doc_id long, n_shingles long, d1 long, d2 long, keys array<long>"))
    classes = checkpointed(signed.where("n_shingles > 0 and doc_id is not null").groupBy("n_shingles", "d1", "d2").agg(F.min("doc_id").alias("rep"), F.first("keys").alias("keys")))
    reps = classes.select(F.col("rep").alias("doc_id"), "keys")

    # A document without a fellow in any key of either collection is in no shared table.
    single = reps.select("doc_id", F.posexplode("keys").alias("i", "key"))
    shared = single.groupBy("i", "key").agg(F.count("*").alias("n")).where("n > 1").select("i", "key")
    alive = single.join(shared, ["i", "key"], "left_semi").groupBy("doc_id").agg(F.sum(F.when(F.col("i") < SIDE, 1).otherwise(0)).alias("u"), F.sum(F.when(F.col("i") >= SIDE, 1).otherwise(0)).alias("v")).where("u > 0 and v > 0").select("doc_id")
    table = reps.join(alive, "doc_id", "left_semi").select(F.col("doc_id").alias("id"), F.posexplode(F.expr(f"flatten(transform(sequence(0, {SIDE - 1}), i -> transform(sequence({SIDE}, {2 * SIDE - 1}), j -> xxhash64(i, keys[i], j, keys[j]))))")).alias("table_no", "key"))
    pivots = table.groupBy("key").agg(F.min("id").alias("pivot"), F.count("*").alias("n")).where("n > 1").select("key", "pivot")
    members = checkpointed(table.join(pivots, "key").select("key", "table_no", "id", "pivot"))

    wanted = members.select("id").distinct()
    sets = checkpointed(rows.join(wanted, rows["doc_id"] == wanted["id"], "left_semi").distinct().mapInArrow(_sets(width), "id long, shingles array<long>"))
    first = checkpointed(_verified(members.where("id <> pivot").select(F.col("id").alias("a"), F.col("pivot").alias("b")).distinct(), sets))
    is_link = F.expr(f"100L * common >= {percent}L * either")
    links = first.where(is_link).select("a", "b")
    found = components(links)

    # A shingle is rare if at most RARE of the documents in mixed entries have it. Documents that share no rare one have
    # at most the smaller number of their other shingles in common, which mostly rules a link out.
    rest = _mixed(members, found)
    own = sets.join(rest.select("id").distinct(), "id", "left_semi").select("id", F.size("shingles").alias("n"), F.explode("shingles").alias("shingle"))
    rare = own.groupBy("shingle").agg(F.count("*").alias("times")).where(F.col("times") <= RARE).select("shingle")
    rare = checkpointed(own.join(rare, "shingle", "left_semi"))
    few = rare.groupBy("id").agg(F.count("*").alias("few"))
    sizes = checkpointed(sets.join(rest.select("id").distinct(), "id", "left_semi").select("id", F.size("shingles").alias("n")).join(few, "id", "left").select("id", "n", (F.col("n") - F.coalesce("few", F.lit(0))).alias("many")))
    # a partner has at least percent of a document's shingles; so many must be left of its common ones too
    able = sizes.where(f"100L * many >= {percent}L * n")
    near = lambda p, q: f"100L * least({p}n, {q}n) >= {percent}L * greatest({p}n, {q}n) and {100 + percent}L * least({p}many, {q}many) >= {percent}L * ({p}n + {q}n)"

    # Entries that their smallest member did not join into one component meet further members, the same ones in most tables.
    met = rest.join(able, "id")
    picked = met.groupBy("key").agg(*(F.min(F.struct(F.xxhash64(F.lit(s), "id").alias("h"), "id", "component_id", "n", "many")).alias(f"p{s}") for s in PIVOTS))
    met = met.join(picked, "key").withColumn("p", F.explode(F.array(*(f"p{s}" for s in PIVOTS)))).where("component_id <> p.component_id and " + near("", "p."))
    asked = met.select(F.greatest("id", "p.id").alias("a"), F.least("id", "p.id").alias("b")).distinct().join(first.select("a", "b"), ["a", "b"], "left_anti")
    more = checkpointed(_verified(asked, sets))
    verified, links = first.unionByName(more), links.unionByName(more.where(is_link).select("a", "b"))
    rest = _mixed(members, components(links))

    # What is still apart: documents that share a rare shingle, and those whose other shingles are enough, unless the
    # distances from the first pivot rule a link out. A pair is given out by the first table that it shares.
    tagged = rare.join(rest.select("id", "component_id").distinct(), "id")
    x, y = (tagged.select("shingle", *(F.col(c).alias(f"{s}{c}") for c in ("id", "n", "component_id"))) for s in "xy")
    apart_ = "xid > yid and xcomponent_id <> ycomponent_id"
    sharing = x.join(y, "shingle").where(f"{apart_} and 100L * least(xn, yn) >= {percent}L * greatest(xn, yn)").select("xid", "yid")
    apart = first.select(F.col("a").alias("id"), F.col("b").alias("pivot"), (1 - F.col("common") / F.col("either")).alias("far"))
    rest = rest.where("id <> pivot").join(apart, ["id", "pivot"]).join(able, "id").join(reps.select(F.col("doc_id").alias("id"), "keys"), "id")
    rest = rest.select("key", "table_no", "id", "component_id", "n", "many", "far", *(F.col("keys")[i].alias(f"k{i}") for i in range(2 * SIDE)))
    x, y = (rest.select("key", *(F.col(c).alias(f"{s}{c}") for c in rest.columns if c != "key")) for s in "xy")
    first_of = lambda own: "case " + " ".join(f"when xk{i} = yk{i} then {i % SIDE}" for i in own) + " end"
    first_shared = f"xtable_no = {SIDE} * {first_of(range(SIDE))} + {first_of(range(SIDE, 2 * SIDE))}"
    alike = x.join(y, "key").where(f"{apart_} and {near('x', 'y')} and abs(xfar - yfar) <= {1 - percent / 100 + 1e-9} and {first_shared}").select("xid", "yid")
    between = sharing.unionByName(alike).select(F.col("xid").alias("a"), F.col("yid").alias("b")).distinct()
    second = _verified(between.join(verified.select("a", "b"), ["a", "b"], "left_anti"), sets)
    joined = components(links.unionByName(second.where(is_link).select("a", "b")))

    of_class = classes.join(joined, classes["rep"] == joined["id"], "left").select("n_shingles", "d1", "d2", F.coalesce("component_id", "rep").alias("component_id"))
    out = signed.select("doc_id", "n_shingles", "d1", "d2").join(of_class, ["n_shingles", "d1", "d2"], "left")
    component = F.when(F.col("doc_id").isNull() | (F.col("n_shingles") == 0), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """The documents without those that repeat an earlier one: one of each group stays.

    Rows with the same doc_id stay or go together; they stay if one of their texts does, so
    that no text goes that repeats nothing. Documents without words, and
    those with a null doc_id, all stay; other columns pass through unchanged.
    """
    found = near_duplicates(docs, id_col, text_col, width, percent)
    gone = found.groupBy(F.col("doc_id").alias("_gone")).agg(F.bool_or("kept").alias("_kept")).where("not _kept").select("_gone")
    return docs.join(gone, docs[id_col] == gone["_gone"], "left_anti")
