"""Quality by an interpolated modified Kneser-Ney n-gram model of characters, trained on trusted text.

A text is read as characters with start marks before and an end mark after it;
perplexity is for each character. Documents are packed into *blocks*; a block asks
for each of its n-grams, and for each of their endings of two characters and more,
once. Counts of all these orders and the questions meet in *shards* by a hash of the
whole context, so that a shard has all counts of a context, and a context has no more
of them than there are characters. A shard's counts are read first and its questions
after them, some at a time. The answers, two numbers for each n-gram in the order
asked, go back to the block, which puts the orders together. The lowest order has one
row for each character of Unicode at most and is sent to every task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeline.llm.common import checkpointed, chunks, mix, packed, small_batches, unpacked

#: Characters of an n-gram; quantile of held-out trusted documents' perplexity up to which documents are kept.
ORDER, QUANTILE = 5, 0.995
#: One in so many trusted documents is held out of training and sets the threshold.
HELD_OUT = 5
#: Bytes of text of a block.
BLOCK = 24_000_000
#: Trusted n-grams, of all orders, that a shard aims at; questions that it answers at a time.
SHARD, ASKED = 500_000, 2_000_000
#: Ids of trusted documents up to which they are sent to every task; more are joined by a shuffle.
SENT_IDS = 2_000_000
START, END = "\x02", "\x03"
#: Perplexities are put in order by their logarithm to this many steps a unit.
STEPS = 1000
#: Of contexts: the factor and the prime of their hash.
FACTOR, PRIME = 1_048_583, 2_147_483_629


class Grams:
    """The n-grams of some texts. ``codes`` has one number for each n-gram that ends in a character or the end mark, text by text."""

    def __init__(self, texts_: list[str], order: int, alphabet: np.ndarray | None = None):
        own = [START * (order - 1) + t.replace(START, " ").replace(END, " ") + END for t in texts_]
        self.order, self.sizes = order, np.array([len(t) - (order - 1) for t in own], np.int64)
        self.chars = np.frombuffer("".join(own).encode("utf-32-le", "surrogatepass"), "<u4")
        self.alphabet = letters(self.chars) if alphabet is None else alphabet
        rank = np.zeros(int(self.alphabet[-1]) + 1, np.uint64)
        rank[self.alphabet] = np.arange(len(self.alphabet), dtype=np.uint64)
        ranks, exact = rank[self.chars], len(self.alphabet) ** order < 1 << 63
        base = np.uint64(len(self.alphabet) if exact else 0x9E3779B97F4A7C15)
        n = len(ranks) - order + 1
        code = ranks[:n].copy()
        for k in range(1, order):
            code *= base
            code += ranks[k : n + k]
        ends = np.cumsum(self.sizes + order - 1) - (order - 1)
        self.place = np.repeat(ends - np.cumsum(self.sizes), self.sizes) + np.arange(int(self.sizes.sum()))
        self.codes = code[self.place] if exact else mix(code[self.place])

    def spelled(self, at: np.ndarray) -> np.ndarray:
        """The characters of the n-grams at some places of codes."""
        return np.stack([self.chars[self.place[at] + k] for k in range(self.order)], 1)


def distinct(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different codes in the order in which they come, where each comes first, and which of them each place has; by a hash table, as most of them come often."""
    which, own = pd.factorize(codes)
    at = np.zeros(len(own), np.int64)
    at[which[::-1]] = np.arange(len(codes) - 1, -1, -1)
    return own, at, which


def letters(chars: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.bincount(chars))


def as_text(spelled: np.ndarray) -> list[str]:
    joined, order = np.ascontiguousarray(spelled, "<u4").tobytes().decode("utf-32-le", "surrogatepass"), spelled.shape[1]
    return [joined[i : i + order] for i in range(0, len(joined), order)]


def as_numbers(grams: list[str], order: int) -> np.ndarray:
    return np.frombuffer("".join(grams).encode("utf-32-le", "surrogatepass"), "<u4").reshape(-1, order)


class Block:
    """Documents of one block, and of their texts the distinct n-grams of each order but the lowest, with their shards.

    ``of[k]`` has the n-grams of order k, a row each, ``shard[k]`` their shards, and
    ``ending[k]`` the place there of each distinct n-gram of the highest order.
    """

    def __init__(self, payloads: list[bytes], order: int, shards: int):
        self.rows = unpacked(payloads)
        self.full = [i for i, r in enumerate(self.rows) if r[1]]
        self.parts = list(chunks([len(self.rows[i][1]) for i in self.full]))
        self.order = order
        seen = [letters(np.frombuffer("".join([START, END, " ", *self.texts(p)]).encode("utf-32-le", "surrogatepass"), "<u4")) for p in self.parts]
        self.alphabet = np.unique(np.concatenate(seen)) if seen else np.zeros(0, np.int64)
        found, spelled = [np.zeros(0, np.uint64)], [np.zeros((0, order), np.uint32)]
        for part in self.parts:
            g = Grams(self.texts(part), order, self.alphabet)
            codes, at, _ = distinct(g.codes)
            found.append(codes)
            spelled.append(g.spelled(at))
        codes, at, _ = distinct(np.concatenate(found))
        up = np.argsort(codes)  # so that the same texts in another order make the same questions
        self.codes, self.spelled = codes[up], np.concatenate(spelled)[at[up]]
        self.of, self.shard, self.ending = {}, {}, {}
        number = self.spelled[:, -1].astype(np.int64)
        for k in range(2, order + 1):
            _, at, number = distinct(paired(number, self.spelled[:, order - k]))
            self.of[k], self.ending[k] = self.spelled[at, order - k :], number
            self.shard[k] = context_hash(self.of[k]) % shards

    def texts(self, part: slice) -> list[str]:
        return [self.rows[i][1] for i in self.full[part]]


def _counted(order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[str] = []
        size = 0

        def flushed() -> pa.RecordBatch:
            g = Grams(held, order)
            _, at, which = distinct(g.codes)
            n = np.bincount(which)
            return pa.RecordBatch.from_arrays([pa.array(as_text(g.spelled(at)), pa.string()), pa.array(n, pa.int64())], names=["gram", "c"])

        for batch in small_batches(batches):
            for text in batch.column("text").to_pylist():
                held.append(text)
                size += len(text)
                if size >= 4_000_000:
                    yield flushed()
                    held, size = [], 0
        if held:
            yield flushed()

    return run


def paired(number: np.ndarray, more: np.ndarray) -> np.ndarray:
    """One number for each pair of a small number and a character."""
    return number * np.int64(int(more.max(initial=0)) + 1) + more


def numbered(*columns: np.ndarray) -> np.ndarray:
    """One number for each different row of some columns of characters."""
    out = columns[0].astype(np.int64)
    for c in columns[1:]:
        out = distinct(paired(out, c))[2]
    return out


def context_hash(grams: np.ndarray) -> np.ndarray:
    """A hash of each row's characters but the last, and of how many there are."""
    h = np.full(len(grams), grams.shape[1], np.int64)
    for c in grams.T[:-1]:
        h = (h * FACTOR + c) % PRIME
    return h


def context_hash_of(gram: str, order: int) -> Column:
    """The same of a column of n-grams of one order."""
    h = F.lit(order).cast("long")
    for i in range(1, order):
        h = (h * F.lit(FACTOR) + F.ascii(F.substring(gram, i, 1))) % F.lit(PRIME)
    return h


def _asked(order: int, shards: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        b, rows = Block(pdf["payload"].tolist(), order, shards), []
        for s in np.unique(np.concatenate(list(b.shard.values()))).tolist():
            own = {k: b.of[k][b.shard[k] == s] for k in b.of}
            sizes = np.array([len(g) for g in own.values()], np.int64)
            rows.append((s, zstandard.compress(b"".join([sizes.tobytes(), *(np.ascontiguousarray(g.T).tobytes() for g in own.values())]), 3)))
        out = pd.DataFrame(rows, columns=["shard", "payload"])
        return out.assign(block=pdf["block"].iloc[0], gram=None, c=None)[["shard", "block", "gram", "c", "payload"]]

    return run


def questions(payload: bytes, order: int) -> dict[int, np.ndarray]:
    """The n-grams that a block asks a shard for, by order."""
    data = zstandard.decompress(payload)
    sizes, at, out = np.frombuffer(data, np.int64, order - 1).tolist(), 8 * (order - 1), {}
    for k, n in enumerate(sizes, 2):
        out[k] = np.frombuffer(data, np.uint32, n * k, at).reshape(k, n).T
        at += 4 * n * k
    return out


def shares(counted: np.ndarray, count: np.ndarray, wanted: np.ndarray, discount: tuple[float, float, float]) -> tuple[np.ndarray, np.ndarray]:
    """Of one order: what is left of each wanted n-gram's own count, and what its context leaves to the next lower order, as shares of the context's total."""
    n, both = len(counted), np.concatenate([counted, wanted])
    context = numbered(*both.T[:-1])
    gram = distinct(paired(context, both[:, -1]))[2]
    size = int(context.max(initial=-1)) + 1
    d = np.array(discount)[np.minimum(count, 3).astype(np.int64) - 1] if n else count
    total, freed = np.bincount(context[:n], count, size), np.bincount(context[:n], d, size)
    left = np.bincount(gram[:n], count - d, int(gram.max(initial=-1)) + 1)
    here = context[n:]
    met = total[here] > 0
    some = np.where(met, total[here], 1)
    return np.where(met, left[gram[n:]] / some, 0).astype(np.float32), np.where(met, freed[here] / some, 1).astype(np.float32)


class Shard:
    """A shard's counts, and questions until there are enough of them to answer."""

    def __init__(self, number: int, order: int, discounts_: dict[int, tuple[float, float, float]]):
        self.number, self.order, self.discounts = number, order, discounts_
        self.read: list[pd.DataFrame] = []
        self.counts: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.asked: list[tuple[int, dict[int, np.ndarray]]] = []
        self.size = 0

    def ask(self, block: int, payload: bytes) -> None:
        self.asked.append((block, questions(payload, self.order)))
        self.size += sum(map(len, self.asked[-1][1].values()))

    def answers(self) -> pd.DataFrame:
        if not self.counts:
            all_ = pd.concat([*self.read, pd.DataFrame({"gram": pd.Series([], dtype=object), "c": pd.Series([], dtype=float)})])
            lengths = all_["gram"].str.len()
            for k in range(2, self.order + 1):
                own = all_[lengths == k]
                self.counts[k] = as_numbers(own["gram"].tolist(), k), own["c"].to_numpy(np.float64)
            self.read = []
        parts: list[list[bytes]] = [[] for _ in self.asked]
        for k, (counted, count) in self.counts.items():
            wanted = [q[k] for _, q in self.asked]
            own, rest = shares(counted, count, np.concatenate(wanted), self.discounts[k])
            ends = np.cumsum([len(w) for w in wanted])[:-1]
            for part, a, b in zip(parts, np.split(own, ends), np.split(rest, ends), strict=True):
                part += [a.tobytes(), b.tobytes()]
        out = [(block, self.number, zstandard.compress(b"".join(part), 3)) for (block, _), part in zip(self.asked, parts, strict=True)]
        self.asked, self.size = [], 0
        return pd.DataFrame(out, columns=["block", "shard", "payload"])


def _answered(order: int, discounts_: dict[int, tuple[float, float, float]]):
    """Rows in the order of shards, each shard's counts before its questions, to answers."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here = Shard(-1, order, discounts_)
        for pdf in batches:
            for number, own in pdf.groupby("shard"):
                if number != here.number:
                    if here.asked:
                        yield here.answers()
                    here = Shard(number, order, discounts_)
                if len(counts := own.loc[own["block"] < 0, ["gram", "c"]]):
                    here.read.append(counts)
                some = own[own["block"] >= 0]
                for block, payload in zip(some["block"].tolist(), some["payload"].tolist(), strict=True):
                    here.ask(block, payload)
                    if here.size >= ASKED:
                        yield here.answers()
        if here.asked:
            yield here.answers()

    return run


def _perplexities(order: int, shards: int, lowest: tuple[np.ndarray, np.ndarray, float]):
    known, share, unseen = lowest

    def run(pdf: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf):
            return pd.DataFrame([], columns=["doc_id", "lang", "perplexity"])
        b = Block(pdf["payload"].tolist(), order, shards)
        own, rest = ({k: np.zeros(len(b.of[k]), np.float32) for k in b.of} for _ in range(2))
        for shard, payload in zip(answers["shard"].tolist(), answers["payload"].tolist(), strict=True):
            told, at = np.frombuffer(zstandard.decompress(payload), np.float32), 0
            for k in b.of:
                here = np.flatnonzero(b.shard[k] == shard)
                own[k][here], rest[k][here] = told[at : at + 2 * len(here)].reshape(2, -1)
                at += 2 * len(here)
        last = b.spelled[:, -1]
        place = np.minimum(np.searchsorted(known, last), max(len(known) - 1, 0))
        p = np.where(known[place] == last, share[place], unseen) if len(known) else np.full(len(last), unseen)
        for k in b.of:
            p = own[k][b.ending[k]] + rest[k][b.ending[k]] * p
        value, out = np.log(p), np.full(len(b.rows), np.nan)
        for part in b.parts:
            g = Grams(b.texts(part), order, b.alphabet)
            codes, _, which = distinct(g.codes)
            logs = value[np.searchsorted(b.codes, codes)][which]
            out[b.full[part]] = np.exp(-np.add.reduceat(logs, np.cumsum(g.sizes) - g.sizes) / g.sizes)
        ids, langs = pd.array([r[0] for r in b.rows], "Int64"), [r[2] for r in b.rows]
        return pd.DataFrame({"doc_id": ids, "lang": langs, "perplexity": pd.Series(out).astype("Float64").where(~np.isnan(out), pd.NA)})

    return run


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """The three discounts of modified Kneser-Ney, from how many n-grams have count 1, 2, 3, 4."""
    if not n1 or not n2 or not n3:
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    return min(max(1 - 2 * y * n2 / n1, 0.0), 1.0), min(max(2 - 3 * y * n3 / n2, 0.0), 2.0), min(max(3 - 4 * y * n4 / n3, 0.0), 3.0)


def model_rows(counts: DataFrame, order: int) -> tuple[DataFrame, int, dict[int, tuple[float, float, float]]]:
    """counts(gram, c) of the highest order to (k, gram, c) of all orders, how many rows these are, and the discounts of each order.

    Below the highest order a count is of the different characters before an n-gram.
    """
    tables = {order: counts}
    for k in range(order - 1, 0, -1):
        tables[k] = tables[k + 1].groupBy(F.substring("gram", 2, k).alias("gram")).agg(F.count("*").alias("c"))
    rows = [tables[k].select(F.lit(k).alias("k"), "gram", F.col("c").cast("double").alias("c")) for k in tables]
    for more in rows[1:]:
        rows[0] = rows[0].unionByName(more)
    model = checkpointed(rows[0])
    found = model.groupBy("k").agg(F.count("*"), *(F.count(F.when(F.col("c") == n, 1)) for n in (1, 2, 3, 4))).collect()  # a row for each order
    of = {k: (0.5, 1.0, 1.5) for k in tables} | {r[0]: discounts(*r[2:]) for r in found}
    return model, sum(r[1] for r in found), of


def lowest_order(model: DataFrame, discount: tuple[float, float, float]) -> tuple[np.ndarray, np.ndarray, float]:
    """Characters in ascending order, their probabilities, and that of any other: interpolated with a uniform choice. As many rows as there are characters, which Unicode bounds by 1,114,112."""
    own = model.where("k = 1").select(F.ascii("gram").alias("char"), "c").orderBy("char").toPandas()
    char, c = own["char"].to_numpy(np.int64), own["c"].to_numpy(np.float64)
    d = np.array(discount)[np.minimum(c, 3).astype(np.int64) - 1] if len(c) else c
    unseen = float(d.sum() / (c.sum() or 1) / (len(c) + 1)) if len(c) else 1.0
    return char, (c - d) / (c.sum() or 1) + unseen, unseen


def quantiles(values: DataFrame, q: float) -> DataFrame:
    """values(lang, perplexity) -> (lang, threshold): the exact quantile of perplexities rounded up to 1 / STEPS of a logarithm."""
    steps = values.where("perplexity is not null").groupBy("lang", F.ceil(F.log("perplexity") * STEPS).alias("step")).agg(F.count("*").alias("n"))
    up = Window.partitionBy("lang").orderBy("step")
    ranked = steps.withColumn("below", F.sum("n").over(up)).withColumn("all", F.sum("n").over(Window.partitionBy("lang")))
    return ranked.where(F.col("below") >= q * F.col("all")).groupBy("lang").agg(F.exp(F.min("step") / STEPS).alias("threshold"))


def perplexities(rows: DataFrame, ids: DataFrame, order: int = ORDER, block_bytes: int = BLOCK, shard_grams: int = SHARD) -> DataFrame:
    """rows(doc_id, text, lang) with the perplexity of each text, null for one without characters, under a model of the texts with one of the ids(doc_id)."""
    if order < 3:
        raise ValueError("order must be at least 3")
    few = ids.limit(SENT_IDS + 1).count() <= SENT_IDS
    trusted = rows.where("text <> ''").join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")
    counts = checkpointed(trusted.select("text").mapInArrow(_counted(order), "gram string, c long").groupBy("gram").agg(F.sum("c").alias("c")))
    model, n, of = model_rows(counts, order)
    shards = -(-n // shard_grams) or 1
    number = F.coalesce(*(F.when(F.col("k") == k, context_hash_of("gram", k)) for k in range(2, order + 1)))
    counted = model.where("k > 1").select((number % F.lit(shards)).cast("int").alias("shard"), F.lit(-1).alias("block"), "gram", "c", F.lit(None).cast("binary").alias("payload"))
    dealt = packed(rows.select("doc_id", "text", "lang"), block_bytes).groupBy("block")
    asked = dealt.applyInPandas(_asked(order, shards), "shard int, block int, gram string, c double, payload binary")
    met = counted.unionByName(asked).repartition("shard").sortWithinPartitions("shard", "block")
    answers = met.mapInPandas(_answered(order, of), "block int, shard int, payload binary")
    return dealt.cogroup(answers.groupBy("block")).applyInPandas(_perplexities(order, shards, lowest_order(model, of[1])), "doc_id long, lang string, perplexity double")


def classify(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", order: int = ORDER, quantile: float = QUANTILE, block_bytes: int = BLOCK) -> DataFrame:
    """(doc_id, lang, perplexity, threshold, kept): one row for each document.

    ``trusted`` lists the ids of trusted documents. One in HELD_OUT of them, by a
    hash of the id, sets the threshold of its language, the quantile of its
    perplexities, and the others train the model. A language without held-out
    documents has the threshold of its other trusted ones, one without any that of
    all languages together. Null and empty texts have no perplexity and are not kept; a null lang is a
    language of its own; null and repeated ids keep their rows; without any trusted
    text nothing is kept; an empty table gives no rows.
    """
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"), F.coalesce(docs[lang_col].cast("string"), F.lit("")).alias("lang"))
    ids = trusted.select(trusted[id_col].cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    ids = ids.withColumn("held", F.pmod(F.xxhash64("doc_id"), F.lit(HELD_OUT)) == 0)
    training = ids.where("not held").select("doc_id")
    scored = checkpointed(perplexities(rows, training if not training.isEmpty() else ids.select("doc_id"), order, block_bytes))
    sure = checkpointed(scored.where("perplexity is not null").join(ids, "doc_id").select("lang", "perplexity", "held"))
    everywhere = lambda own, name: F.broadcast(quantiles(own.withColumn("lang", F.lit("")), quantile).select(F.col("threshold").alias(name)))
    by_lang = lambda own, name: quantiles(own, quantile).withColumnRenamed("threshold", name)
    held = sure.where("held")
    out = scored.join(by_lang(held, "a"), "lang", "left").join(by_lang(sure, "b"), "lang", "left")
    out = out.join(everywhere(held, "c"), F.lit(True), "left").join(everywhere(sure, "d"), F.lit(True), "left")
    out = out.select("doc_id", F.nullif("lang", F.lit("")).alias("lang"), "perplexity", F.coalesce("a", "b", "c", "d").alias("threshold"))
    return out.withColumn("kept", F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(False)))
