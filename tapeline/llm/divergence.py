"""How far the sources of a language differ: exact sparse term vectors, their sums by source, and all pairs of sums.

Documents of a source meet in tasks, which write them as few rows without repeats: a
row has a weight, and a term's weights add up to its occurrences. Such rows become
sparse vectors by CountVectorizer, whose vocabulary has the terms of each language
that enough of its documents hold. A vocabulary goes through the driver and to every
task, so terms are dealt into shards by their hash, as many as the estimated number
of different terms asks for; a row has a vector in each shard. Vectors are summed
by source without being made dense, and a pair of sums is evaluated from the terms
that either has.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeline.llm.common import checkpointed, small_batches
from tapeline.sources.shared import shared_folder, small

#: Documents of a language that a term must stand in, and CountVectorizer's largest vocabulary.
MIN_DOCS, MOST_TERMS = 3, 2**31 - 1
#: Different terms, rare ones included, that a shard is meant to have; its vocabulary has fewer, and the driver holds it for a while.
SHARD_TERMS = 500_000
#: Parts of the terms by hash; a shard is some of them, or where more shards are asked for, a share of one by another hash.
BUCKETS = 64
#: Terms of a row at most, and terms by source that a task counts before it writes them.
ROW_TERMS, TASK_TERMS = 1_000, 1_000_000
#: Probabilities are whole numbers of this part of one.
UNIT = 1_000_000_000
#: Letters, in lower case, and bytes of characters beyond ASCII stay; all else parts terms.
TABLE = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
#: A term that no text can hold, in a language of its own, so that no vocabulary is empty.
NO_TERM = "\x00 \x00"


def numbered(table: pa.Table) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """A number for each row's language and source; the languages and the sources by number."""
    lang, source = (table[c].combine_chunks().cast(pa.string()).dictionary_encode() for c in ("lang", "source"))
    both, group = np.unique(lang.indices.to_numpy() * np.int64(len(source.dictionary)) + source.indices.to_numpy(), return_inverse=True)
    size = max(1, len(source.dictionary))
    return group, lang.dictionary.take(pa.array(both // size)), source.dictionary.take(pa.array(both % size))


def counted(batch: pa.RecordBatch) -> pa.Table:
    """(lang, source, term, n, d): how often each term occurs in a batch's documents of a source, and in how many of them."""
    group, langs, sources = numbered(pa.Table.from_batches([batch]))
    split = pc.ascii_split_whitespace(pa.array([(t or b"").translate(TABLE) for t in batch.column("text").cast(pa.binary()).to_pylist()], pa.string()))
    encoded = split.flatten().dictionary_encode()
    terms, number, rows = encoded.dictionary, encoded.indices.to_numpy().astype(np.int64), pc.list_parent_indices(split).to_numpy()
    empty = terms.index("").as_py()
    rows, number = rows[number != empty], number[number != empty]
    size = max(1, len(terms))
    found, n = np.unique(group[rows] * size + number, return_counts=True)
    held = np.sort(rows * size + number)
    held = held[np.r_[True, held[1:] != held[:-1]][: len(held)]]
    d = np.unique(group[held // size] * size + held % size, return_counts=True)[1]
    own = pa.array(found // size)
    return pa.table([langs.take(own), sources.take(own), terms.take(pa.array(found % size)), pa.array(n), pa.array(d)], names=["lang", "source", "term", "n", "d"])


def weighted(counts: pa.Table, min_docs: int) -> pa.RecordBatch:
    """(bucket, first, lang, source, weight, terms): rows that stand for the documents counted, by a hash of terms; a term is its language, a blank and itself.

    A term is in a row once at most, and the weights of its rows add up to its occurrences. It
    is in as many rows as documents hold it, or in ``min_docs`` or more if as many documents
    do, so that rows tell as well as documents whether enough of these hold a term.
    Rows with ``first`` have all terms, the others those again that several documents hold.
    """
    terms = counts["term"].combine_chunks().dictionary_encode()
    bucket = np.array([xxhash.xxh64_intdigest(t) % BUCKETS for t in terms.dictionary.cast(pa.binary()).to_pylist()], np.int64)[terms.indices.to_numpy()]
    n, d = counts["n"].to_numpy(), counts["d"].to_numpy()
    alone = np.minimum(d, min_docs) - 1
    rest, enough = n - alone, d >= min_docs
    # (terms, number of the row, weight): rows of weight 1, then one with the rest, or one for each of its powers of two
    found = [(np.flatnonzero(alone >= k), k, 1) for k in range(1, min_docs)]
    found += [(np.flatnonzero(enough & (rest >> bit & 1 == 1)), 0, 1 << bit) for bit in range(int(rest.max()).bit_length())]
    few = np.flatnonzero(~enough)
    few = few[np.argsort(rest[few], kind="stable")]
    own = np.concatenate([few, *(x[0] for x in found)])
    number = np.concatenate([np.zeros(len(few), np.int64), *(np.full(len(x), k) for x, k, _ in found)])
    weight = np.concatenate([rest[few], *(np.full(len(x), w) for x, _, w in found)])
    group, langs, sources = numbered(counts)
    place = (bucket * len(langs) + group)[own]
    order = np.argsort(place.astype(np.min_scalar_type(int(place.max()))), kind="stable")
    own, number, weight, place = own[order], number[order], weight[order], place[order]
    new = np.r_[True, (np.diff(place) != 0) | (np.diff(number) != 0) | (np.diff(weight) != 0)]
    place = np.arange(len(own)) - np.flatnonzero(new)[np.cumsum(new) - 1]
    first = np.flatnonzero(place % ROW_TERMS == 0)
    named = pc.binary_join_element_wise(counts["lang"], counts["term"], " ").combine_chunks()
    lists = pa.ListArray.from_arrays(pa.array(np.r_[first, len(own)], pa.int32()), named.take(pa.array(own)))
    head = pa.array(group[own[first]])
    held = [pa.array(bucket[own[first]], pa.int32()), pa.array(number[first] == 0), langs.take(head), sources.take(head), pa.array(weight[first], pa.int64()), lists]
    return pa.RecordBatch.from_arrays(held, names=["bucket", "first", "lang", "source", "weight", "terms"])


def condensed(docs: DataFrame, min_docs: int, task_terms: int = TASK_TERMS) -> DataFrame:
    """(bucket, first, lang, source, weight, terms): see weighted(); documents (lang, source, text) of a source are brought together, and a large source has several tasks."""

    def merged(parts: list[pa.Table]) -> pa.Table:
        every = pa.concat_tables(parts).group_by(["lang", "source", "term"], use_threads=False).aggregate([("n", "sum"), ("d", "sum")])
        return every.rename_columns(["lang", "source", "term", "n", "d"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[pa.Table] = []
        for batch in small_batches(batches, 500):
            parts.append(counted(batch))
            if sum(len(x) for x in parts) > task_terms:
                parts = [merged(parts)]
                if len(parts[0]) > task_terms // 2:
                    yield weighted(parts[0], min_docs)
                    parts = []
        if sum(len(x) for x in parts):
            yield weighted(merged(parts), min_docs)

    filled = [F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")]
    dealt = docs.select(*filled, "text", F.monotonically_increasing_id().alias("row")).repartitionByRange("lang", "source", "row").drop("row")
    return dealt.mapInArrow(run, "bucket int, first boolean, lang string, source string, weight long, terms array<string>")


def n_shards(rows: DataFrame, shard_terms: int) -> int:
    """How many shards the different terms of all rows make, from their estimated number."""
    n = rows.where("first").select(F.explode("terms").alias("term")).agg(F.approx_count_distinct("term")).first()[0]
    return max(1, -(-n // shard_terms))


def vectors(terms: DataFrame, min_docs: int) -> tuple[DataFrame, DataFrame]:
    """(lang, source, weight, v struct<indices, values>) for each row of terms, and the vocabulary (idx, lang, term)."""
    spark = terms.sparkSession
    none = spark.range(min_docs).select(F.array(F.lit(NO_TERM)).alias("terms"))
    model = CountVectorizer(inputCol="terms", outputCol="v", minDF=float(min_docs), vocabSize=MOST_TERMS).fit(terms.select("terms").unionByName(none))
    found = model.transform(terms).select("lang", "source", "weight", F.unwrap_udt("v").alias("v"))
    names = pa.array(model.vocabulary, pa.string())
    listed = pa.table({"idx": pa.array(np.arange(len(names)), pa.int32()), "name": names})
    name, term = F.col("name"), F.substring_index("name", " ", -1)
    vocabulary = spark.createDataFrame(listed).where(name != NO_TERM)
    return found, vocabulary.select("idx", name.substr(F.lit(1), F.length(name) - F.length(term) - 1).alias("lang"), term.alias("term"))


def group_sums(docs: DataFrame, min_docs: int = MIN_DOCS, shard_terms: int = SHARD_TERMS) -> tuple[DataFrame, DataFrame]:
    """(lang, source, shard, idx, n): how often each kept term occurs in each source; and the vocabulary (shard, idx, lang, term).

    Shards follow one another, each over its own part of a written table of terms;
    sums and vocabularies are appended to tables, so plans don't grow with their number.
    """
    spark: SparkSession = docs.sparkSession
    folder = f"{shared_folder(spark)}/terms-{uuid.uuid4().hex}"
    own = docs.select(*(docs[c].cast("string").alias(c) for c in ("lang", "source", "text")))
    schema = "lang string, source string, weight long, terms array<string>"
    condensed(own, min_docs).write.parquet(f"{folder}/rows")
    rows = spark.read.schema(f"bucket int, first boolean, {schema}").parquet(f"{folder}/rows")
    shards = n_shards(rows, shard_terms)
    tables, shares = min(shards, BUCKETS), -(-shards // BUCKETS)
    rows.drop("first").withColumn("shard", F.col("bucket") % tables).drop("bucket").write.partitionBy("shard").parquet(f"{folder}/terms")
    every = spark.read.schema(f"{schema}, shard int").parquet(f"{folder}/terms")
    for k in range(tables * shares):
        part = every.where(F.col("shard") == k % tables)
        if shares > 1:
            part = part.withColumn("terms", F.filter("terms", lambda t: F.pmod(F.xxhash64(t), F.lit(shares)) == k // tables))  # noqa: B023
        found, vocabulary = vectors(part, min_docs)
        # a row has a term once, so all values of its vector are 1; explode() would make Spark build each vector again to filter rows without any
        entries = found.select("lang", "source", "weight", F.explode_outer("v.indices").alias("idx")).where("idx IS NOT NULL")
        sums = entries.groupBy("lang", "source", "idx").agg(F.sum("weight").alias("n"))
        sums.withColumn("shard", F.lit(k)).write.mode("append").parquet(f"{folder}/sums")
        vocabulary.withColumn("shard", F.lit(k)).write.mode("append").parquet(f"{folder}/vocabulary")
    sums = spark.read.schema("lang string, source string, idx int, n long, shard int").parquet(f"{folder}/sums")
    return sums, spark.read.schema("idx int, lang string, term string, shard int").parquet(f"{folder}/vocabulary")


def probability(n: Column, total: Column, size: Column) -> Column:
    """1 + floor(UNIT * (n + 1) / (total + size)), in whole numbers of any length; those of 64 bits are faster."""
    whole = lambda c, digits: c.cast(f"decimal({digits},0)")
    div = lambda x, y: F.call_function("div", x, y)
    longer = div(whole(F.lit(UNIT), 10) * whole(n + 1, 20), whole(total + size, 20))
    return F.lit(1).cast("long") + F.when(n < 2**63 // UNIT - 1, div(F.lit(UNIT).cast("long") * (n + 1).cast("long"), (total + size).cast("long"))).otherwise(longer)


def distance(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def audit(docs: DataFrame, top: int = 200, min_docs: int = MIN_DOCS, shard_terms: int = SHARD_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): each source of a language against its other sources, and its terms against the language.

    A term is kept in a language if at least ``min_docs`` of its documents hold it; V is
    their number. Part `pair` has all other sources by value, the sum over all kept
    terms; part `term` the ``top`` terms that a source has more of than its language.
    Null texts, languages and sources count as ''. A source without terms is compared
    all the same; where V = 0 its values are 0. Repeated rows are documents each. An empty
    table gives no rows. Other columns play no part.

    For a pair only terms that either source has are looked at: the rest all give the
    same. Terms of one source enter as how often each count occurs; those of both meet by term.
    """
    sums, vocabulary = group_sums(docs, min_docs, shard_terms)
    filled = lambda c: F.coalesce(docs[c].cast("string"), F.lit("")).alias(c)
    sizes = vocabulary.groupBy("lang").agg(F.count("*").alias("size"))
    totals = sums.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = docs.select(filled("lang"), filled("source")).distinct().join(sizes, "lang", "left").join(totals, ["lang", "source"], "left")
    groups = groups.select("lang", "source", F.coalesce("size", F.lit(0)).alias("size"), F.coalesce("total", F.lit(0)).alias("total"))
    none = F.when(F.col("size") > 0, probability(F.lit(0), F.col("total"), F.col("size")))
    groups = checkpointed(groups.withColumn("z", none))
    chance = probability(F.col("n"), F.col("total"), F.col("size"))
    held = sums.join(small(groups), ["lang", "source"]).select("lang", "shard", "idx", "n", F.struct("source", "z", chance.alias("p")).alias("x"))
    # a row for each kept term, with the sources that have it
    held = checkpointed(held.groupBy("lang", "shard", "idx").agg(F.collect_list("x").alias("xs"), F.sum("n").alias("lang_n")))

    a, b = F.col("a"), F.col("b")
    other = groups.select("lang", F.col("source").alias("b"), F.col("z").alias("zb"))
    base = groups.select("lang", F.col("source").alias("a"), F.col("z").alias("za"), "size").join(other, "lang").where(a != b)
    parts = [base.select("lang", "a", "b", F.coalesce(F.col("size") * distance(F.col("za"), F.col("zb")), F.lit(0)).alias("value"))]
    # terms of one source only: a row for each count that occurs, against every other source
    p, n, za, zb = (F.col(c) for c in ("p", "times", "za", "zb"))
    levels = held.select("lang", F.explode("xs").alias("x")).groupBy("lang", F.col("x.source").alias("a"), F.col("x.z").alias("za"), F.col("x.p").alias("p")).agg(F.count("*").alias("times"))
    one = levels.join(small(other), "lang").where(a != b)
    both_ways = F.explode(F.array(
        F.struct(a.alias("a"), b.alias("b"), (n * (distance(p, zb) - distance(za, zb))).alias("value")),
        F.struct(b.alias("a"), a.alias("b"), (n * (distance(zb, p) - distance(zb, za))).alias("value")),
    ))
    parts.append(one.select("lang", both_ways.alias("x")).select("lang", "x.*"))
    # terms of both: what the two lines above say of them is replaced
    pa_, pb = F.col("pa"), F.col("pb")
    met = held.where(F.size("xs") > 1).select("lang", "xs", F.explode("xs").alias("x")).select("lang", "x", F.explode("xs").alias("y")).where("x.source < y.source")
    met = met.select("lang", *(F.col(f"{side}.{c}").alias(name) for side, names in (("x", ("a", "pa", "za")), ("y", ("b", "pb", "zb"))) for c, name in zip(("source", "p", "z"), names, strict=True)))
    more = lambda p, q, z, y: distance(p, q) - distance(p, y) - distance(z, q) + distance(z, y)
    sums_of = met.groupBy("lang", "a", "b").agg(F.sum(more(pa_, pb, za, zb)).alias("ab"), F.sum(more(pb, pa_, zb, za)).alias("ba"))
    turned = F.explode(F.array(F.struct(a.alias("a"), b.alias("b"), F.col("ab").alias("value")), F.struct(b.alias("a"), a.alias("b"), F.col("ba").alias("value"))))
    parts.append(sums_of.select("lang", turned.alias("x")).select("lang", "x.*"))
    pairs = parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    pairs = pairs.select("lang", F.col("a").alias("source"), F.lit("pair").alias("part"), F.col("b").alias("item"), "value")

    language = groups.groupBy("lang", "size").agg(F.sum("total").alias("lang_total"))
    whole = probability(F.col("lang_n"), F.col("lang_total"), F.col("size"))
    terms = held.join(small(language), "lang").select("lang", "shard", "idx", whole.alias("q"), F.explode("xs").alias("x")).select("lang", "shard", "idx", "q", "x.source", "x.p")
    terms = terms.where("p > q").join(vocabulary.drop("lang"), ["shard", "idx"])
    terms = terms.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), distance(F.col("p"), F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), "item")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(order))
    return ranked(pairs).unionByName(ranked(terms).where(F.col("rank") <= top))


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws
  FROM documents),
w AS (SELECT r, lang, source, unnest(ws) AS term FROM d),
kept AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
sizes AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM d),
counts AS (SELECT lang, source, term, count(*) AS c FROM w JOIN kept USING (lang, term) GROUP BY ALL),
totals AS (SELECT lang, source, sum(c) AS n FROM counts GROUP BY ALL),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(c, 0) AS c, 1 + (CAST(1000000000 AS HUGEINT) * (coalesce(c, 0) + 1)) // (coalesce(n, 0) + v) AS p
  FROM groups g JOIN kept k ON k.lang = g.lang JOIN sizes s ON s.lang = g.lang
  LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term LEFT JOIN totals t ON t.lang = g.lang AND t.source = g.source),
whole AS (
  SELECT lang, term, 1 + (CAST(1000000000 AS HUGEINT) * (sum(c) + 1)) // (sum(sum(c)) OVER (PARTITION BY lang) + any_value(v)) AS q
  FROM p JOIN sizes USING (lang) GROUP BY lang, term),
met AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(m.value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN met m ON m.lang = a.lang AND m.source = a.source AND m.item = b.source),
terms AS (SELECT p.lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // q AS value FROM p JOIN whole USING (lang, term) WHERE c > 0 AND p > q),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""
