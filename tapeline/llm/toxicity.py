"""Toxicity by a support vector machine over a gapped subsequence string kernel with Nyström landmarks.

The kernel of two words sums, over all sequences of three characters that both hold
in order, ``DECAY`` to the power of the two spans; gaps up to ``SPAN`` count, so an
insult with inserted or missing characters stays close to itself. It is normalised
and raised to ``POWER``, and the kernel of two sentences is the sum over their pairs
of words. Nyström features of a word against a few landmark words make this a linear
model, so a sentence's decision value is the sum of one number for each of its words,
and numbers of words met before are remembered. A document has the value of its most
toxic sentence.
"""

from __future__ import annotations

import pickle
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeline.llm.bpe import Remembered
from tapeline.llm.common import chunks, only, small_batches

DECAY, SPAN, POWER = 0.7, 6, 4
#: Landmark words; longest word that is taken as one, longer ones are taken in overlapping parts.
LANDMARKS, WORD = 128, 24
#: Words of a sentence that are looked at together.
LONG = 16
#: Labelled documents of each class, at most, that a model is fitted on, and bytes of their texts.
SAMPLE, SAMPLE_BYTES = 1500, 8_000_000
#: Sentences that are in double precision at a time while a model is fitted.
SLICE = 4096
#: A document is called toxic from this score on.
THRESHOLD = 0.7
#: Gaps (first to second, second to third character) that the kernel sees.
GAPS = [(a, b) for a in range(1, SPAN) for b in range(1, SPAN) if a + b < SPAN]
#: Different characters of landmarks up to which a table of all triples is made.
TABLE = 96
EDGES = "\"'()[]{}<>.,;:!?*_-#%&$|~`"


def sentences(text: str | None) -> list[list[str]]:
    """The words of each sentence; sentences of more than LONG words are taken in pieces."""
    lines = (text or "").lower().replace("!", ".").replace("?", ".").replace("\n", ". ").split(". ")
    return [words[i : i + LONG] for line in lines if (words := line.split()) for i in range(0, len(words), LONG)]


def parts_of(word: str) -> list[str]:
    word = word.strip(EDGES) or word
    return [word] if len(word) <= WORD else [word[i : i + WORD] for i in range(0, len(word) - WORD // 2, WORD // 2)]


def encoded(words: list[str]) -> np.ndarray:
    """Code points, 0 after a word's end; characters of all scripts stay apart."""
    padded = "".join([w[:WORD].ljust(WORD + SPAN, "\0") for w in words])
    return np.frombuffer(padded.encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(words), WORD + SPAN).astype(np.int64)


def subsequences(codes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """(code, present, weight) of every place and gap: the three-character sequences of each word."""
    longest = int((codes > 0).sum(1).max()) if len(codes) else 0
    for i in range(longest):
        for a, b in GAPS:
            if i + a + b < codes.shape[1]:
                x, y, z = codes[:, i], codes[:, i + a], codes[:, i + a + b]
                yield (x << 42) | (y << 21) | z, z > 0, DECAY ** (a + b + 1)


class Kernel:
    """Normalised kernel values of words against fixed landmarks."""

    def __init__(self, landmarks: list[str]):
        self.landmarks = landmarks
        # landmarks' own characters are numbered from 1, so that a table finds a sequence's row; no other character is in one
        self.letters = np.unique(encoded(landmarks))
        self.letters = self.letters[self.letters > 0]
        rows: dict[int, np.ndarray] = {}
        for m, w in enumerate(landmarks):
            own: dict[int, float] = {}
            for code, there, weight in subsequences(encoded([w])):
                if there[0]:
                    own[int(code[0])] = own.get(int(code[0]), 0) + weight
            norm = np.sqrt(sum(v * v for v in own.values())) or 1.0
            for code, v in own.items():
                rows.setdefault(code, np.zeros(len(landmarks), np.float32))[m] += v / norm
        self.codes = np.array(sorted(rows), np.int64)
        self.weights = np.stack([np.zeros(len(landmarks), np.float32), *(rows[c] for c in self.codes.tolist())])
        size = len(self.letters) + 1
        self.row = np.zeros(size**3 if size <= TABLE else 0, np.int32)
        if len(self.row) and len(self.codes):
            x, y, z = (np.searchsorted(self.letters, (self.codes >> k) & 0x1FFFFF) + 1 for k in (42, 21, 0))
            self.row[(x * size + y) * size + z] = np.arange(1, len(self.codes) + 1)

    def rows_of(self, code: np.ndarray, x: np.ndarray, y: np.ndarray, z: np.ndarray) -> np.ndarray:
        """Where the weights of sequences are; 0 for one of no landmark. x, y, z: numbers of their characters, 0 for others."""
        if len(self.row):
            size = len(self.letters) + 1
            return np.where((x > 0) & (y > 0) & (z > 0), self.row[(x * size + y) * size + z], 0)
        at = np.minimum(np.searchsorted(self.codes, code), max(0, len(self.codes) - 1))
        return np.where(self.codes[at] == code, at + 1, 0) if len(self.codes) else np.zeros(len(code), np.int64)

    def of(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), len(self.landmarks)), np.float32)
        order = np.argsort([len(w) for w in words], kind="stable")
        for at in range(0, len(words), 2048):
            take = order[at : at + 2048]
            codes = encoded([words[i] for i in take])
            place = np.searchsorted(self.letters, codes)
            own = np.where(self.letters[np.minimum(place, len(self.letters) - 1)] == codes, place + 1, 0) if len(self.letters) else np.zeros_like(codes)
            seen, value = np.zeros((len(take), len(self.landmarks)), np.float32), []
            numbered = ((own[:, i], own[:, i + a], own[:, i + a + b]) for i in range(WORD) for a, b in GAPS if i + a + b < own.shape[1])
            for (code, there, weight), three in zip(subsequences(codes), numbered, strict=False):
                row = self.rows_of(code, *three)
                hit = np.flatnonzero((row > 0) & there)
                if len(hit):
                    seen[hit] += np.float32(weight) * self.weights[row[hit]]
                value.append((np.where(there, code, -1), weight))
            if value:
                all_codes = np.stack([v[0] for v in value], 1)
                weight = np.where(all_codes >= 0, np.array([v[1] for v in value]), 0.0)
                rank = np.argsort(all_codes, axis=1, kind="stable")
                c, w = np.take_along_axis(all_codes, rank, 1), np.take_along_axis(weight, rank, 1)
                total = np.cumsum(w, axis=1)
                last = np.concatenate([c[:, 1:] != c[:, :-1], np.ones((len(c), 1), bool)], axis=1)
                ends = np.where(last, total, 0)
                before = np.maximum.accumulate(np.concatenate([np.zeros((len(c), 1)), ends[:, :-1]], axis=1), axis=1)
                norm = np.sqrt((np.where(last, total - before, 0) ** 2).sum(1))
                seen /= np.maximum(norm, 1e-9)[:, None].astype(np.float32)
            out[take] = seen
        return np.minimum(out, 1) ** POWER


def svm(x: np.ndarray, rows: np.ndarray, y: np.ndarray, cost: np.ndarray, rounds: int = 30) -> tuple[np.ndarray, float]:
    """Linear SVM with squared hinge loss over some rows of x, by Newton steps; its normal equations are summed over slices."""
    n = x.shape[1] + 1
    v, ridge = np.zeros(n), np.eye(n)
    ridge[-1, -1] = 1e-6
    for _ in range(rounds):
        left, right = ridge.copy(), np.zeros(n)
        for at in range(0, len(rows), SLICE):
            s = slice(at, at + SLICE)
            x1 = np.ones((len(rows[s]), n))
            x1[:, :-1] = x[rows[s]]
            in_ = y[s] * (x1 @ v) < 1
            xs = x1[in_]
            weighted = xs * cost[s][in_][:, None]
            left += 2 * weighted.T @ xs
            right += 2 * weighted.T @ y[s][in_]
        new = np.linalg.solve(left, right)
        if np.allclose(new, v, rtol=1e-6, atol=1e-9):
            break
        v = new
    return v[:-1], float(v[-1])


class Model:
    """landmarks, their weights, the bias of a sentence, and the logistic curve of a document."""

    def __init__(self, landmarks: list[str], beta: np.ndarray, bias: float, slope: float, shift: float):
        self.landmarks, self.beta, self.bias, self.slope, self.shift = landmarks, beta, bias, slope, shift

    def ready(self) -> Model:
        self.kernel = Kernel(self.landmarks)
        self.known = Remembered(lambda word: 0.0, 200_000)
        return self

    def learn(self, words: list[str]) -> None:
        parts = [parts_of(w) for w in words]
        flat = [p for own in parts for p in own]
        values = np.concatenate([self.kernel.of(flat[a : a + 20_000]) @ self.beta for a in range(0, len(flat), 20_000)] or [np.zeros(0)])
        at = 0
        for w, own in zip(words, parts, strict=True):
            self.known.room()
            self.known[w] = float(max(values[at : at + len(own)]))
            at += len(own)

    def scores(self, texts_: list[str | None]) -> np.ndarray:
        own = [sentences(t) for t in texts_]
        new = [w for w in set().union(*(s for d in own for s in d)) if w not in self.known and w not in self.known.older]
        for at in range(0, len(new), 50_000):
            self.learn(new[at : at + 50_000])
        get = self.known.__getitem__
        top = np.array([max((sum(map(get, s)) for s in d), default=0.0) for d in own]) + self.bias
        return 1 / (1 + np.exp(-np.clip(self.slope * top + self.shift, -30, 30)))


def fit(rows: list[tuple[int, str | None, int]], prior: float) -> Model:
    """rows: (doc_id, text, toxic). Which sentence makes a document toxic isn't given: it is chosen anew in each round."""
    rows = sorted(rows, key=lambda r: (r[0], r[2]))
    label = np.array([r[2] for r in rows])
    number: dict[str, int] = {}
    counts = Counter(), Counter()
    flat, begins, of = array("i"), array("q"), array("i")  # numbers of words, where sentences begin, whose they are
    for i, (_, text, toxic) in enumerate(rows):
        met = set()
        for sentence in sentences(text):
            begins.append(len(flat))
            of.append(i)
            for w in sentence:
                for p in parts_of(w):
                    flat.append(number.setdefault(p, len(number)))
                    met.add(p)
        counts[toxic].update(p for p in met if len(p) > 2)
    flat, begins, of = (np.frombuffer(v, v.typecode).astype(np.int64) for v in (flat, begins, of))
    n = max(1, int((label == 0).sum())), max(1, int((label == 1).sum()))
    odds = {w: np.log((c + 0.1) / n[1]) - np.log((counts[0][w] + 0.1) / n[0]) for w, c in counts[1].items() if c > 2}
    # sure of the odds: how many deviations they are above nothing
    sure = {w: o / np.sqrt(1 / (counts[1][w] + 0.1) + 1 / (counts[0][w] + 1)) for w, o in odds.items()}
    toxic = sorted((w for w in odds if odds[w] > 1.5 and sure[w] > 2.5), key=lambda w: (-sure[w], w))[: 3 * LANDMARKS]
    landmarks: list[str] = []
    near = Kernel(toxic).of(toxic) if toxic else np.zeros((0, 0))
    taken = np.zeros(len(toxic), bool)
    for i, w in enumerate(toxic):
        if len(landmarks) < LANDMARKS * 3 // 4 and not (near[i][taken] > 0.7).any():
            taken[i] = True
            landmarks.append(w)
    common = sorted(counts[0], key=lambda w: (-counts[0][w], w))
    landmarks += [w for w in common if w not in landmarks][: LANDMARKS // 8]
    if not landmarks or len(set(label.tolist())) < 2:
        return Model(["-"], np.zeros(1), 0.0, 0.0, float(np.log(max(prior, 1e-6) / max(1 - prior, 1e-6))))
    kernel = Kernel(landmarks)
    value, vector = np.linalg.eigh(kernel.of(landmarks).astype(np.float64))
    keep = value > 1e-6 * value.max()
    basis = vector[:, keep] / np.sqrt(value[keep])
    words = list(number)
    feature = np.concatenate([(kernel.of(words[at : at + 8192]) @ basis).astype(np.float32) for at in range(0, len(words), 8192)])
    chance = np.array([odds.get(w, 0.0) for w in words])
    x, value_of = np.zeros((len(of), feature.shape[1]), np.float32), np.zeros(len(of))
    for at in range(0, len(of), SLICE):
        end = begins[at + SLICE] if at + SLICE < len(of) else len(flat)
        own, first = flat[begins[at] : end], begins[at : at + SLICE] - begins[at]
        x[at : at + SLICE] = np.add.reduceat(feature[own], first)
        value_of[at : at + SLICE] = np.maximum.reduceat(chance[own], first)
    del feature
    clean = np.flatnonzero(label[of] == 0)
    for _ in range(4):
        order = np.lexsort((-value_of, of))
        first = order[np.concatenate([[True], of[order][1:] != of[order][:-1]])]
        worst = first[label[of[first]] == 1]
        take = np.concatenate([worst, clean])
        y = np.where(label[of[take]] == 1, 1.0, -1.0)
        cost = np.where(y > 0, 50.0 / max(1, len(worst)), 50.0 / max(1, len(clean))) * 20
        weight, bias = svm(x, take, y, cost)
        value_of = x @ weight.astype(np.float32) + bias
    top = np.full(len(rows), bias)
    np.maximum.at(top, of, value_of)
    share = np.where(label == 1, prior / max(1e-9, label.mean()), (1 - prior) / max(1e-9, 1 - label.mean()))
    slope, shift = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(slope * top + shift, -30, 30)))
        g = np.array([(share * (p - label) * top).sum() + 1e-2 * slope, (share * (p - label)).sum()])
        q = share * p * (1 - p)
        h = np.array([[(q * top * top).sum() + 1e-2, (q * top).sum()], [(q * top).sum(), q.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        slope, shift = slope - np.clip(step[0], -1, 1), shift - np.clip(step[1], -1, 1)
    return Model(landmarks, basis @ weight, bias, float(slope), float(shift))


def fitted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """A model made in one task from at most ``sample`` documents of each label, those first by a hash of the id, as far as their texts add up to ``sample_bytes``.

    Rows with a null id, or a label other than 0 and 1, teach nothing; a repeated id
    counts each of its texts.
    """
    known = labels.select(labels[id_col].cast("long").alias("doc_id"), labels[label_col].cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)")
    n = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    prior = n.get(1, 0) / max(1, sum(n.values()))
    chosen = [r for y in (0, 1) for r in known.where(F.col("toxic") == y).distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).collect()]
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    small = docs.sparkSession.createDataFrame(chosen, "doc_id long, toxic int")
    before = Window.partitionBy("toxic").orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text")).rowsBetween(Window.unboundedPreceding, -1)
    own = rows.join(F.broadcast(small), "doc_id").withColumn("before", F.coalesce(F.sum(F.octet_length("text")).over(before), F.lit(0))).where(F.col("before") < sample_bytes).drop("before")

    def train(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"model": [pickle.dumps(fit(list(zip(pdf["doc_id"].tolist(), pdf["text"].tolist(), pdf["toxic"].tolist(), strict=True)), prior))]})

    made = own.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(train, "model binary").first()
    return pickle.loads(made["model"]) if made else fit([], prior)


def _scorer(model: Model):
    held: list[Model] = []

    def score(texts_: list[str | None]) -> np.ndarray:
        if not held:
            only("toxicity")
            held.append(model.ready())
        return np.concatenate([held[0].scores(texts_[s]) for s in chunks([len(t or "") for t in texts_])] or [np.zeros(0)])

    return score


def scores(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score): the probability that a document is labelled toxic, in one pass without a shuffle.

    A null, empty or wordless text has the value of an empty sentence. Null and
    repeated ids keep their rows; an empty table gives no rows. Without labels of
    both kinds to learn from, every score is the share of toxic labels.
    """
    score = _scorer(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score(batch.column("text").to_pylist()), pa.float64())], names=["doc_id", "score"])

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")


def without_toxic(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents, all columns, that score under the threshold.

    Null, empty and wordless texts have the score of an empty sentence; null and
    repeated ids, and columns of any name, pass through; an empty table gives no rows.
    """
    score = _scorer(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            yield batch.filter(pa.array(score(batch.column(text_col).to_pylist()) < threshold))

    return docs.mapInArrow(run, docs.schema)
