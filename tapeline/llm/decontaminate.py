"""Finds benchmark items inside documents, edits allowed, by CGK embeddings and bit sampling.

The CGK embedding walks a string and copies its current character at each of 3n
steps, moving on or not as a fixed random bit for (step, character) says; strings
with few edits between them meet again soon, so edit distance becomes Hamming
distance. Windows of an item's size are embedded by several walks, sampled places of
the walks are the keys of hash tables, and what meets an item there is compared by
exact edit distance. Which windows are embedded is decided by the q-gram lemma,
which never loses a window within the allowed distance: a window and an item at edit
distance k share at least n - q + 1 - k * q of the item's q-grams. Long items are
looked for in parts, one of which must have its share of the edits at most, and then
compared as a whole; items too short for a q-gram are looked for as whole words.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeline.llm.common import Rolling, chunks, mix, small_batches

#: Edits allowed for each byte of an item.
RATE = 0.06
#: Bytes of a q-gram, and of the shortest item that it serves: the lemma asks for one common q-gram there at least.
GRAMS = ((12, 36), (8, 8))
#: Walks, tables for each walk, and sampled places for a key. A window whose walk differs in
#: a fifth of its places still meets its item with probability 1 - (1 - 0.8**8)**64 > 0.9999.
WALKS, TABLES, PLACES = 8, 8, 8
#: Items of more than twice so many bytes are looked for in parts of about so many.
PIECE = 400
#: Bytes of items that one pass takes to the executors, where they take about 60 times as much; more items take more passes.
ITEM_BYTES = 1_000_000
#: ASCII: letters are lowered, what is neither a letter nor a digit parts words. Texts with other characters go by Apart first.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


class Apart(dict):
    """Code point -> itself, or a space for punctuation, symbols, separators and controls; filled as characters are met."""

    def __missing__(self, code: int) -> int:
        kind = unicodedata.category(chr(code))
        self[code] = 32 if kind[0] in "PSZ" or kind == "Cc" else code
        return self[code]


_apart = Apart()


def folded(text: str | None) -> bytes:
    """Words without regard to case (Unicode case folding), with single spaces: what is compared."""
    text = text or ""
    if not text.isascii():
        text = text.casefold().translate(_apart)
    return b" ".join(text.encode("utf-8", "surrogatepass").translate(_FOLD).split())


def pieces(item: bytes) -> list[tuple[int, bytes]]:
    """A long item as parts (where each begins, its bytes) of about PIECE bytes that begin and end with words, or inside a word that is longer."""
    out, at = [], 0
    while len(item) - at > 2 * PIECE:
        cut = item.rfind(b" ", at + 1, at + PIECE)
        cut = cut if cut > 0 else at + PIECE
        out.append((at, item[at:cut]))
        at = cut + (item[cut : cut + 1] == b" ")
    return [*out, (at, item[at:])]


def allowed(n: int) -> int:
    return int(RATE * n)


def grams(data: np.ndarray, q: int) -> np.ndarray:
    if len(data) < q:
        return np.zeros(0, np.uint64)
    return Rolling(mix(data.astype(np.uint64) + np.uint64(1))).runs(q)


def edit_match(item: bytes, text: bytes) -> tuple[int, int]:
    """Smallest edit distance of the item to any part of the text, and where that part ends; bit-parallel."""
    n = len(item)
    full, top = (1 << n) - 1, 1 << (n - 1)
    masks: dict[int, int] = {}
    for i, b in enumerate(item):
        masks[b] = masks.get(b, 0) | 1 << i
    plus, minus, score = full, 0, n
    best, end = n, 0
    for j, b in enumerate(text):
        eq = masks.get(b, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        up, down = minus | ~(xh | plus) & full, plus & xh
        score += bool(up & top) - bool(down & top)
        up, down = (up << 1) & full, (down << 1) & full
        plus, minus = down | ~(xv | up) & full, up & xv
        if score < best:
            best, end = score, j + 1
    return best, end


def span_of(item: bytes, text: bytes, lo: int, hi: int) -> tuple[int, int, int]:
    """(distance, start, length) of the part of text[lo:hi] that is nearest to the item."""
    distance, end = edit_match(item, text[lo:hi])
    _, size = edit_match(item[::-1], text[lo : lo + end][::-1])
    return distance, lo + end - size, size


class Words:
    """Items too short for a q-gram, found as whole words without edits."""

    def __init__(self, items: list[tuple[int, bytes]]):
        self.ids: dict[str, list[int]] = {}
        for i, t in items:
            if t:
                self.ids.setdefault(f" {t.decode('latin-1')} ", []).append(i)
        self.automaton = ahocorasick.Automaton()
        for word in self.ids:
            self.automaton.add_word(word, word)
        self.automaton.make_automaton()

    def find(self, texts_: list[bytes]) -> Iterator[tuple[int, int, int, int, int]]:
        for i, t in enumerate(texts_ if self.ids else ()):
            first: dict[str, int] = {}
            for end, word in self.automaton.iter(f" {t.decode('latin-1')} "):
                first.setdefault(word, end - len(word) + 1)
            for word, start in first.items():
                yield from ((i, item, start, len(word) - 2, 0) for item in self.ids[word])


class Items:
    """Items of all lengths; finds them in folded texts."""

    def __init__(self, items: list[tuple[int, bytes]], seed: int = 5):
        self.parts: list[Words | Matcher] = []
        longest = 1 << 62
        for q, least in GRAMS:
            own = [(i, t) for i, t in items if least <= len(t) < longest]
            longest = least
            if own:
                self.parts.append(Matcher(own, q, seed))
        if short := [(i, t) for i, t in items if len(t) < longest]:
            self.parts.append(Words(short))

    def find(self, texts_: list[bytes]) -> Iterator[tuple[int, int, int, int, int]]:
        """(text number, item_id, start, length, distance): the best place of each item in each text that has it."""
        for part in self.parts:
            yield from part.find(texts_)


class Matcher:
    """Items and their tables. Arrays have one element for each part of an item."""

    def __init__(self, items: list[tuple[int, bytes]], q: int, seed: int = 5):
        self.q, self.whole = q, items
        found = [(n, at, part, at > 0 or len(part) < len(t)) for n, (_, t) in enumerate(items) for at, part in pieces(t)]
        self.of, self.at = np.array([f[0] for f in found]), np.array([f[1] for f in found])
        self.items = [f[2] for f in found]
        self.size = np.array([len(t) for t in self.items], np.int64)
        # cuts leave out a space each, so that a part may have one edit more than its share
        self.edits = np.array([allowed(len(f[2])) + f[3] for f in found], np.int64)
        self.need = np.maximum(self.size - q + 1 - self.edits * q, 1)
        own = [grams(np.frombuffer(t, np.uint8), q) for t in self.items]
        gram = np.concatenate(own)
        order = np.argsort(gram, kind="stable")
        self.gram = gram[order]
        self.owner = np.repeat(np.arange(len(own)), [len(f) for f in own])[order]
        self.place = np.concatenate([np.arange(len(f)) for f in own])[order]
        self.known = np.zeros(1 << 22, bool)
        self.known[gram >> np.uint64(42)] = True
        rng = np.random.default_rng(seed)
        self.longest = int(self.size.max())
        self.moves = rng.integers(0, 2, (WALKS, 3 * self.longest, 257), dtype=np.int8)
        self.sample = rng.random((WALKS, TABLES, PLACES))
        self.tables = np.concatenate([self.keys(self.items[a : a + 256], self.size[a : a + 256]) for a in range(0, len(self.items), 256)])

    def keys(self, windows: list[bytes], sizes: np.ndarray) -> np.ndarray:
        """For each window its key in each table, as a hash; sizes are those of the items looked for."""
        text = np.full((len(windows), self.longest + 1), 256, np.int64)
        for i, w in enumerate(windows):
            text[i, : len(w)] = np.frombuffer(w, np.uint8)
        steps = 3 * int(sizes.max())
        rows = np.arange(len(windows))
        out = np.zeros((len(windows), WALKS, TABLES, PLACES), np.int16)
        for w in range(WALKS):
            at, walk = np.zeros(len(windows), np.int64), np.zeros((steps, len(windows)), np.int16)
            for s in range(steps):
                c = text[rows, at]
                walk[s] = c
                at = np.minimum(at + self.moves[w, s, c], self.longest)
            places = (self.sample[w][None] * (3 * sizes)[:, None, None]).astype(np.int64)
            out[:, w] = walk[places, rows[:, None, None]]
        halves = out.reshape(len(windows), WALKS * TABLES, PLACES).view(np.uint64)
        return mix(halves[..., 0] ^ mix(halves[..., 1]))

    def regions(self, data: bytes, hits: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(item, first start, last start) where the q-gram lemma allows a match; hits are places of known grams."""
        codes = np.frombuffer(data, np.uint8)
        own = np.concatenate([grams(codes[h : h + self.q], self.q) for h in hits]) if len(hits) < 64 else grams(codes, self.q)[hits]
        lo, hi = np.searchsorted(self.gram, own, "left"), np.searchsorted(self.gram, own, "right")
        times = hi - lo
        if not times.sum():
            return
        index = np.repeat(lo - np.cumsum(times) + times, times) + np.arange(times.sum())
        item, start = self.owner[index], np.repeat(hits, times) - self.place[index]
        enough = np.bincount(item, minlength=len(self.items)) >= self.need
        keep = enough[item]
        item, start = item[keep], start[keep]
        order = np.lexsort((start, item))
        item, start = item[order], start[order]
        for k in np.unique(item):
            s = start[item == k]
            # starts of true matches lie within the allowed edits of each other
            width = 2 * self.edits[k] + 1
            count = np.searchsorted(s, s + width, "right") - np.arange(len(s))
            good = s[count >= self.need[k]]
            if len(good):
                for part in np.split(good, np.flatnonzero(np.diff(good) > width) + 1):
                    yield int(k), int(part[0]), int(part[-1] + width)

    def find(self, texts_: list[bytes]) -> Iterator[tuple[int, int, int, int, int]]:
        jobs: list[tuple[int, int, int, int]] = []
        least = int(self.need.min())
        for part in chunks([len(t) for t in texts_]):
            own = texts_[part]
            seen = self.known[grams(np.frombuffer(b"\x00".join(own), np.uint8), self.q) >> np.uint64(42)]
            places = np.flatnonzero(seen)
            ends = np.cumsum([len(t) + 1 for t in own])
            at = np.searchsorted(places, ends)
            before = np.concatenate([[0], at[:-1]])
            for i in np.flatnonzero(at - before >= least):
                hits = places[before[i] : at[i]] - (ends[i] - len(own[i]) - 1)
                hits = hits[hits <= len(own[i]) - self.q]
                jobs += [(part.start + int(i), *r) for r in self.regions(own[i], hits)]
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        tried: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for at in range(0, len(jobs), 64):
            group = jobs[at : at + 64]
            windows, owner = [], []
            for j, (i, k, lo, hi) in enumerate(group):
                text, n, slack = texts_[i], int(self.size[k]), int(self.edits[k])
                for s in range(max(0, lo - slack), min(len(text), hi + slack) + 1):
                    if s == 0 or text[s - 1] == 32:
                        windows.append(text[s : s + n])
                        owner.append(j)
            met: set[int] = set()
            for a in range(0, len(windows), 512):
                of = np.array([group[j][1] for j in owner[a : a + 512]])
                shared = (self.keys(windows[a : a + 512], self.size[of]) == self.tables[of]).any(1)
                met.update(owner[a + x] for x in np.flatnonzero(shared))
            for j in sorted(met):
                i, k, lo, hi = group[j]
                number, item = self.whole[self.of[k]]
                slack, n = allowed(len(item)), len(item)
                lo, hi = lo - int(self.at[k]) - 2 * slack, hi - int(self.at[k]) + 2 * slack
                # parts of one item mostly lead to one place, which is compared once
                places = tried.setdefault((i, number), [])
                if any(a - slack <= lo and hi <= b + slack for a, b in places):
                    continue
                places.append((lo, hi))
                found = span_of(item, texts_[i], max(0, lo), max(0, hi + n))
                if found[0] <= slack:
                    best[i, number] = min(best.get((i, number), found), found)
        for (i, number), (distance, start, n) in sorted(best.items()):
            yield i, number, start, n, distance


def _matchers(items: DataFrame, id_col: str, text_col: str) -> Iterator[Items]:
    """Matchers of bounded size that together hold all items; a null id stands as -1."""
    own = items.select(F.coalesce(items[id_col].cast("long"), F.lit(-1)).alias("item_id"), items[text_col].cast("string").alias("text")).where("text is not null")
    total = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = -(-total // ITEM_BYTES) or 1
    for p in range(parts):
        yield Items([(r["item_id"], folded(r["text"])) for r in own.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == p).toLocalIterator()])


def item_matches(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, start, length, distance): one row for each document and benchmark item that it holds.

    Texts are compared as case-folded words with single spaces, punctuation and
    symbols left out (all of Unicode); start and length are bytes of that form, distance the
    exact edit distance, at most RATE of the item's bytes. The documents are read
    once for each ITEM_BYTES of items and are never shuffled. Items without words, and
    those with a null id or text, match nothing; null and empty texts
    hold nothing; rows with a null or repeated id give a row each; an item_id with
    several texts stands for each of them. Empty tables give no rows.
    """
    items = items.where(items[item_id].isNotNull())
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    schema, names = "doc_id long, item_id long, start long, length long, distance long", ["doc_id", "item_id", "start", "length", "distance"]
    out = None
    for matcher in _matchers(items, item_id, item_text):
        shared = docs.sparkSession.sparkContext.broadcast(matcher)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in small_batches(batches):
                ids, own = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
                found = [(ids[i], *rest) for i, *rest in shared.value.find([folded(t) for t in own])]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=names)

        part = rows.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out


def without_items(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The documents, all columns, that hold none of the items, those with a null id too; see item_matches.

    One pass, no shuffle. Null and empty texts stay, as do null and repeated ids and
    columns of any name; without items all rows stay.
    """
    for matcher in _matchers(items, item_id, item_text):
        shared = docs.sparkSession.sparkContext.broadcast(matcher)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in small_batches(batches):
                own = batch.column(text_col).to_pylist()
                keep = np.ones(len(own), bool)
                keep[[i for i, *_ in shared.value.find([folded(t) for t in own])]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
