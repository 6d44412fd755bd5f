"""Removes bytes that lie in a string of a fixed length which also starts earlier, by suffix arrays.

The *anchor* of a string of ``length`` bytes is its ``ANCHOR``-byte part with the
smallest hash, so equal strings have equal anchors at equal places. The strings that
have an anchor start one after another; all bytes that they cover are the anchor's
*context*. Spark counts anchors and contexts: an anchor that occurs once settles its
strings at once, and where whole contexts are equal (128-bit digests), all but the
first go. The first occurrences of different contexts of one anchor are dealt out by
two thirds of their bytes, which equal strings share, and there a suffix array with
adjacent common prefixes compares what is left byte by byte.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeline.llm.common import BLOCK_BYTES, Rolling, chunks, mix, packed, texts, unpacked

#: Bytes of an anchor; bytes of a suffix array's text.
ANCHOR, SORTED = 32, 1_000_000
#: An anchor with more different contexts in one block is widened to the whole strings, so that no task gathers them.
CONTEXTS = 256
#: Stands for a null doc_id when documents are put in order: after all others.
LAST = np.iinfo(np.int64).max
#: A value for each byte.
BYTES = mix(np.arange(1, 257, dtype=np.uint64))


# --- suffix array -----------------------------------------------------------


def words8(text: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place as one big-endian number, zero from the next separator on."""
    padded = np.concatenate([text, np.zeros(8, np.uint8)]).astype(np.uint64)
    out = np.zeros(len(text), np.uint64)
    for j in range(8):
        out |= padded[j : j + len(text)] << np.uint64(56 - 8 * j)
    keep = np.array([0] + [((1 << 8 * k) - 1) << (64 - 8 * k) for k in range(1, 9)], np.uint64)
    return out & keep[np.minimum(left, 8)]


def smaller_than_next(text: np.ndarray) -> np.ndarray:
    """Which suffixes are smaller than the one that starts a place later; the last is."""
    n = len(text)
    step = np.sign(np.diff(text.astype(np.int16)))
    decided = np.where(step != 0, np.arange(n - 1), n)
    decided = np.minimum.accumulate(decided[::-1])[::-1]
    out = np.ones(n, bool)
    known = decided < n
    out[:-1][known] = step[decided[known]] > 0
    out[text == 0] = True
    return out


def sorted_directly(places: np.ndarray, words: np.ndarray, left: np.ndarray, depth: int) -> np.ndarray:
    """The places in the order of their suffixes' first ``depth`` bytes, eight at a time; equal ones in text order."""
    places = places[np.argsort(words[places], kind="stable")]
    key = words[places]
    at = np.arange(len(places))
    group = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]])) if len(places) else at
    for done in range(8, depth, 8):
        # what stays open: groups of several, whose suffixes go on
        twin = group[1:] == group[:-1]
        open_ = np.flatnonzero(np.concatenate([twin, [False]]) | np.concatenate([[False], twin]))
        open_ = open_[left[places[at[open_]]] >= done]
        if not len(open_):
            break
        at, group = at[open_], group[open_]
        group = np.cumsum(np.concatenate([[0], group[1:] != group[:-1]]))
        own = places[at]
        key = words[own + done]
        apart = (group[1:] == group[:-1]) & (key[1:] != key[:-1])
        if apart.any():
            split = np.zeros(int(group[-1]) + 1, bool)
            split[group[1:][apart]] = True
            some = np.flatnonzero(split[group])
            again = some[np.lexsort((key[some], group[some]))]
            places[at[some]], key[some] = own[again], key[again]
            group = np.cumsum(np.concatenate([[0], (group[1:] != group[:-1]) | (key[1:] != key[:-1])]))
    return places


def suffix_array(text: np.ndarray, depth: int | None = None) -> np.ndarray:
    """Two-stage sorting of a text of bytes in which 0 separates: separators differ, earlier ones are smaller.

    With a depth, suffixes are in order of so many first bytes at least.

    Suffixes smaller than their successors are sorted directly. Scanning the buckets
    of first bytes upwards then puts every other suffix in place: the suffix before
    one just passed goes to the end of what its own bucket holds so far.
    """
    n = len(text)
    ends = np.flatnonzero(text == 0)
    left = ends[np.searchsorted(ends, np.arange(n))] - np.arange(n)
    small = smaller_than_next(text)
    direct = sorted_directly(np.flatnonzero(small), words8(text, left), left, depth or n + 8)
    direct_at = np.searchsorted(text[direct], np.arange(257))
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]
    out: list[np.ndarray] = []
    for c in range(256):
        waves = induced[c]
        new = np.concatenate(waves) if waves else np.zeros(0, np.int64)
        waves = [new]
        while len(new):
            before = new[new > 0] - 1
            new = before[(text[before] == c) & ~small[before]]
            waves.append(new)
        passed = np.concatenate([*waves, direct[direct_at[c] : direct_at[c + 1]]])
        out.append(passed)
        before = passed[passed > 0] - 1
        before = before[~small[before] & (text[before] > c)]
        if len(before):
            to = text[before]
            order = np.argsort(to, kind="stable")
            before, to = before[order], to[order]
            for part in np.split(before, np.flatnonzero(np.diff(to)) + 1):
                induced[text[part[0]]].append(part)
    return np.concatenate(out)


def earlier_elsewhere(snippets: list[bytes], doc: np.ndarray, start: np.ndarray, length: int) -> list[np.ndarray]:
    """For each snippet (its document and its start there), which strings of the length in it start earlier in another one."""
    sizes = np.array([len(s) for s in snippets])
    # UTF-8 has no byte 255, so a byte plus one is never 0
    text = (np.frombuffer(b"\xff".join(snippets) + b"\xff", np.uint8) + np.uint8(1)).astype(np.uint8)
    first = np.cumsum(sizes + 1) - sizes - 1
    owner = np.repeat(np.arange(len(snippets)), sizes + 1)
    left = (first + sizes)[owner] - np.arange(len(text))
    words = words8(text, left)
    ranked = suffix_array(text, length)
    ranked = ranked[left[ranked] >= length]
    a, b = ranked[:-1], ranked[1:]
    same = np.ones(len(a), bool)
    for k in [*range(0, length - 7, 8), length - 8]:
        live = np.flatnonzero(same)
        same[live] = words[a[live] + k] == words[b[live] + k]
    group = np.cumsum(np.concatenate([[0], ~same])) if len(ranked) else np.zeros(0, np.int64)
    begin = start[owner[ranked]] + ranked - first[owner[ranked]]
    who = doc[owner[ranked]]
    order = np.lexsort((begin, who, group))
    g, w, s = group[order], who[order], begin[order]
    head = np.concatenate([[True], g[1:] != g[:-1]]) if len(g) else np.zeros(0, bool)
    of = np.maximum.accumulate(np.where(head, np.arange(len(g)), 0)) if len(g) else np.zeros(0, np.int64)
    later = (w != w[of]) | (s != s[of])
    flags = np.zeros(len(text), bool)
    flags[ranked[order][later]] = True
    return [flags[f : f + max(0, n - length + 1)] for f, n in zip(first, sizes, strict=True)]


# --- anchors ----------------------------------------------------------------


class Anchors:
    """The anchors of a block of documents, in the order of (doc_id, text).

    Arrays have one element for each anchor that a document has: its row, its place,
    where the first and the last string start that have it, and its hash. The number
    of an anchor is its place in them, the same whenever the block is read.
    """

    def __init__(self, payloads: pd.Series, length: int):
        self.length = length
        rows = sorted(unpacked(payloads), key=lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or ""))
        self.ids = [doc for doc, _ in rows]
        self.data = [(text or "").encode("utf-8", "surrogatepass") for _, text in rows]
        order = np.array([LAST if doc is None else doc for doc in self.ids], np.int64)
        sizes = np.array([len(d) for d in self.data], np.int64)
        found = [self._chunk(part.start, self.data[part], sizes[part]) for part in chunks(sizes.tolist())]
        kinds = (np.int64, np.int64, np.int64, np.int64, np.uint64)
        self.row, self.place, self.first, self.last, self.gram = (np.concatenate([f[k] for f in found] or [np.zeros(0)]).astype(kind) for k, kind in enumerate(kinds))
        self.doc = order[self.row] if len(self.row) else np.zeros(0, np.int64)

    def _chunk(self, row: int, data: list[bytes], sizes: np.ndarray) -> tuple[np.ndarray, ...]:
        joined, length = b"".join(data), self.length
        begin, count = np.cumsum(sizes) - sizes, np.maximum(sizes - length + 1, 0)
        if not count.any():
            return tuple(np.zeros(0, np.int64) for _ in range(5))
        grams = Rolling(BYTES[np.frombuffer(joined, np.uint8)]).runs(ANCHOR)
        ranked = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
        width, size = length - ANCHOR + 1, 1
        while 2 * size <= width:
            ranked = np.minimum(ranked[:-size], ranked[size:])
            size *= 2
        if width > size:
            ranked = np.minimum(ranked[: len(ranked) - (width - size)], ranked[width - size :])
        owner = np.repeat(np.arange(len(data)), count)
        start = np.arange(len(owner)) + (begin - np.cumsum(count) + count)[owner]
        place = (ranked[start] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        new = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        last = start[np.concatenate([new[1:], [len(place)]]) - 1]
        owner, first, place = owner[new], start[new], place[new]
        base = begin[owner]
        return owner + row, place - base, first - base, last - base, grams[place]

    def contexts(self, some: np.ndarray) -> np.ndarray:
        """The digests of the contexts of some anchors: two numbers each."""
        digest, length = xxhash.xxh3_128_digest, self.length
        own = zip(self.row[some].tolist(), self.first[some].tolist(), self.last[some].tolist(), self.place[some].tolist(), strict=True)
        return np.frombuffer(b"".join([digest(self.data[i][a : b + length], p - a) for i, a, b, p in own]), np.int64).reshape(-1, 2)

    def strings(self, some: np.ndarray) -> pd.DataFrame:
        """The strings that have some anchors: digest, doc, start and anchor, in this order."""
        found = []
        for i in some.tolist():
            text, doc = self.data[self.row[i]], self.doc[i]
            found += [(xxhash.xxh3_128_digest(text[s : s + self.length]), doc, s, i) for s in range(self.first[i], self.last[i] + 1)]
        return pd.DataFrame(found, columns=["digest", "doc", "start", "i"]).sort_values(["digest", "doc", "start"], ignore_index=True)


#: Kinds of messages: anchors whose strings all go; the first of its context, where the anchor has others; the same, to be
#: compared by whole strings; bits of a context's strings; one string.
GONE, FIRST, WIDE, TEXT, STRING = range(5)
MESSAGE = "kind int, k1 long, k2 long, block int, i int, doc long, start int, payload binary"


def _ints(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values, "<i4").tobytes()


def _numbers(messages: pd.DataFrame, kind: int) -> np.ndarray:
    """The anchors that messages of a kind name, one by one or many in a payload."""
    own = messages[messages["kind"] == kind]
    many = [np.frombuffer(p, "<i4") for p in own["payload"] if p is not None]
    return np.unique(np.concatenate([own["i"][own["payload"].isna()].to_numpy(), *many]).astype(np.int64))


def _grams(length: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        grams, n = np.unique(Anchors(pdf["payload"], length).gram, return_counts=True)
        return pd.DataFrame({"gram": grams.view(np.int64), "times": n.astype(np.int32), "block": np.full(len(grams), pdf["block"].iloc[0], np.int32)})

    return run


def _entries(length: int, limit: int):
    """Anchors that occur again to one row for the first occurrence of each context here; all others of it go."""
    columns = ["gram", "c1", "c2", "wide", "block", "i", "doc", "start", "payload"]

    def run(pdf: pd.DataFrame, again: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf) or not len(again):
            return pd.DataFrame([], columns=columns)
        x, block = Anchors(pdf["payload"], length), int(pdf["block"].iloc[0])
        some = np.flatnonzero(np.isin(x.gram.view(np.int64), again["gram"].to_numpy()))
        c1, c2 = x.contexts(some).T
        order = np.lexsort((x.first[some], x.doc[some], c2, c1))
        some, c1, c2 = some[order], c1[order], c2[order]
        head = np.concatenate([[True], (c1[1:] != c1[:-1]) | (c2[1:] != c2[:-1])])[: len(some)]
        of = some[np.maximum.accumulate(np.where(head, np.arange(len(some)), 0))]
        gone = some[(x.doc[some] != x.doc[of]) | (x.first[some] != x.first[of])]
        first, c1, c2 = some[head], c1[head], c2[head]
        grams, which, n = np.unique(x.gram[first], return_inverse=True, return_counts=True)
        wide = n[which] > limit
        plain = ~wide
        rows = [pd.DataFrame({"gram": x.gram[first[plain]].view(np.int64), "c1": c1[plain], "c2": c2[plain], "wide": False, "i": first[plain], "doc": x.doc[first[plain]], "start": x.first[first[plain]], "payload": None})]
        for g in np.unique(x.gram[first[wide]]).tolist():
            own = first[wide][x.gram[first[wide]] == g]
            rows.append(pd.DataFrame({"gram": np.array([g], np.uint64).view(np.int64), "c1": 0, "c2": 0, "wide": True, "i": -1, "doc": 0, "start": -1, "payload": [_ints(own)]}))
        if len(gone):
            rows.append(pd.DataFrame({"gram": mix(np.array([block], np.uint64)).view(np.int64), "c1": 0, "c2": 0, "wide": False, "i": -2, "doc": 0, "start": -1, "payload": [_ints(gone)]}))
        return pd.concat([r for r in rows if len(r)] or rows, ignore_index=True).assign(block=block)[columns]

    return run


def _contexts(length: int):
    """Anchors to compare to rows with the key that they are compared under; what is known already passes.

    The strings that begin at most ``half`` before their anchor all hold the bytes
    after it, the others all hold the bytes before it: these are the key.
    """
    half = (length - ANCHOR) // 2
    columns = ["kind", "k1", "k2", "block", "i", "doc", "start", "payload"]

    def run(pdf: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf) or not len(asked):
            return pd.DataFrame([], columns=columns)
        x, block = Anchors(pdf["payload"], length), int(pdf["block"].iloc[0])
        own, digest, rows = _numbers(asked, FIRST), xxhash.xxh3_128_digest, []
        for i, d, r, p, a, b in zip(own.tolist(), x.doc[own].tolist(), x.row[own].tolist(), x.place[own].tolist(), x.first[own].tolist(), x.last[own].tolist(), strict=True):
            text = x.data[r]
            if b >= p - half:
                s = max(a, p - half)
                rows.append((TEXT, digest(text[p : p + length - half], 1), d, s, i, text[s : b + length]))
            if a < p - half:
                rows.append((TEXT, digest(text[p - half - 1 : p + ANCHOR], 2), d, a, i, text[a : min(b, p - half - 1) + length]))
        for kind in (GONE, WIDE):
            if len(known := _numbers(asked, kind)):
                rows.append((kind, digest(block.to_bytes(8, "little"), 3 + kind), 0, 0, -1, _ints(known)))
        rows += [(STRING, k, d, s, i, None) for k, d, s, i in x.strings(_numbers(asked, WIDE)).drop_duplicates("digest").itertuples(index=False)]
        out = pd.DataFrame(rows, columns=["kind", "key", "doc", "start", "i", "payload"])
        keys = np.frombuffer(b"".join(out["key"]), np.int64).reshape(-1, 2)
        return out.assign(k1=keys[:, 0], k2=keys[:, 1], block=block)[columns]

    return run


def _settle(length: int):
    """Rows in the order of their keys to what starts earlier under the same key: bits of a context's strings, or a whole string."""

    def compared(own: pd.DataFrame) -> pd.DataFrame:
        known, own = own[own["kind"] <= WIDE], own[own["kind"] > WIDE]
        own = own[own.duplicated(["k1", "k2"], keep=False)]
        texts_, strings = own[own["kind"] == TEXT], own[own["kind"] == STRING]
        if len(strings):
            strings = strings.sort_values(["k1", "k2", "doc", "start"])
            first = strings.groupby(["k1", "k2"], sort=False)[["doc", "start"]].transform("first")
            strings = strings[(strings["doc"] != first["doc"]) | (strings["start"] != first["start"])]
        if len(texts_):
            flags = earlier_elsewhere(texts_["payload"].tolist(), texts_["doc"].to_numpy(np.int64), texts_["start"].to_numpy(np.int64), length)
            some = np.array([f.any() for f in flags])
            texts_ = texts_[some].assign(payload=[np.packbits(f).tobytes() for f in flags if f.any()])
        return pd.concat([known, texts_, strings])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for pdf in batches:
            lengths = pdf["payload"].str.len().fillna(32).astype(int).tolist()
            for part in chunks(lengths, SORTED // 4):
                held.append(pdf.iloc[part])
                size += sum(lengths[part])
                if size >= SORTED:
                    own = pd.concat(held, ignore_index=True)
                    k1, k2 = own["k1"].to_numpy(), own["k2"].to_numpy()
                    change = np.flatnonzero((k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])) + 1
                    cut = int(change[-1]) if len(change) else 0
                    if cut:
                        yield compared(own.iloc[:cut])
                    held = [own.iloc[cut:]]
                    size = int(held[0]["payload"].str.len().fillna(32).sum())
        if held and sum(map(len, held)):
            yield compared(pd.concat(held, ignore_index=True))

    return run


def _remove(length: int):
    columns = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"]

    def run(pdf: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf):
            return pd.DataFrame([], columns=columns)
        x = Anchors(pdf["payload"], length)
        whole = _numbers(told, GONE)
        # (row, first start, last start) of runs of strings that go
        row, first, last = [x.row[whole]], [x.first[whole]], [x.last[whole]]
        some = told[told["kind"] == TEXT]
        for r, s, bits in zip(x.row[some["i"].to_numpy(np.int64)].tolist(), some["start"].tolist(), some["payload"].tolist(), strict=True):
            at = s + np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8)))
            row.append(np.full(len(at), r))
            first.append(at)
            last.append(at)
        if len(wide := _numbers(told, WIDE)):
            strings = x.strings(wide)
            named = told[told["kind"] == STRING]
            known = strings.groupby("digest", sort=False)[["doc", "start"]].transform("first")
            again = (strings["doc"] != known["doc"]) | (strings["start"] != known["start"])
            elsewhere = set(zip(named["i"].tolist(), named["start"].tolist(), strict=True))
            gone = strings[again | np.array([k in elsewhere for k in zip(strings["i"].tolist(), strings["start"].tolist(), strict=True)], bool)]
            row.append(x.row[gone["i"].to_numpy(np.int64)])
            first.append(gone["start"].to_numpy(np.int64))
            last.append(gone["start"].to_numpy(np.int64))
        row, first, last = (np.concatenate(v).astype(np.int64) for v in (row, first, last))
        sizes = np.array([len(d) for d in x.data], np.int64)
        base = np.cumsum(sizes + 1) - sizes - 1
        steps = np.zeros(int((sizes + 1).sum()) + 1, np.int32)
        np.add.at(steps, base[row] + first, 1)
        np.add.at(steps, base[row] + last + length, -1)
        edges = np.flatnonzero(np.diff(np.concatenate([[0], np.cumsum(steps) > 0]).astype(np.int8)))
        begin, end = edges[::2], edges[1::2]
        of = np.searchsorted(base, begin, "right") - 1
        begin, end, cut = (begin - base[of]).tolist(), (end - base[of]).tolist(), np.searchsorted(of, np.arange(len(sizes) + 1)).tolist()
        rows = []
        for i, (doc, data) in enumerate(zip(x.ids, x.data, strict=True)):
            spans = [[begin[k], end[k]] for k in range(cut[i], cut[i + 1])]
            kept, at = hashlib.sha256(), 0
            for s, t in spans:
                kept.update(data[at:s])
                at = t
            kept.update(data[at:])
            rows.append((doc, len(data), sum(t - s for s, t in spans), len(spans), kept.hexdigest(), spans))
        made = pd.DataFrame(rows, columns=columns, dtype=object)
        return made.assign(doc_id=pd.array(x.ids, "Int64"))

    return run


def repeated_strings(docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, contexts_limit: int = CONTEXTS) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans): one row for each document.

    A byte of a text's UTF-8 form goes if a string of ``length`` bytes that covers it
    also starts earlier: in a document with a smaller doc_id, or earlier in the same
    one; overlaps count, and strings are judged on the input. spans lists the
    maximal runs [start, end) that go. Matches never cross documents. Null texts,
    and those shorter than the length, lose nothing. A null doc_id comes after all
    others; rows that share a doc_id and a text are no earlier than each other; an
    empty table gives no rows. Anchors are only looked for by 64-bit hashes; whole
    contexts, and the strings of an anchor with over contexts_limit contexts in one
    block, count as equal by 128-bit digests, and all others are compared byte by byte.
    """
    if length < ANCHOR + 8:
        raise ValueError(f"length must be at least {ANCHOR + 8}")
    # one chain of steps, each with one reader, so that none runs twice; all read the same exchange of texts
    dealt = packed(texts(docs, id_col, text_col), block_bytes).groupBy("block")
    grams = dealt.applyInPandas(_grams(length), "gram long, times int, block int")
    again = grams.withColumn("n", F.sum("times").over(Window.partitionBy("gram"))).where("n > 1").select("gram", "block")
    entries = dealt.cogroup(again.groupBy("block")).applyInPandas(_entries(length, contexts_limit), "gram long, c1 long, c2 long, wide boolean, block int, i int, doc long, start int, payload binary")
    place, own = F.struct("doc", "start"), Window.partitionBy("gram", "c1", "c2")
    judged = entries.repartition("gram").withColumn("later", place != F.min(place).over(own))
    judged = judged.withColumn("n", F.count_if(~F.col("later")).over(Window.partitionBy("gram"))).withColumn("any_wide", F.max("wide").over(Window.partitionBy("gram")))
    kind = F.when((F.col("i") == -2) | ((F.col("i") >= 0) & F.col("later")), GONE).when(F.col("any_wide"), WIDE).when(F.col("n") > 1, FIRST)
    asked = judged.select("block", kind.alias("kind"), "i", "payload").where("kind is not null")
    contexts = dealt.cogroup(asked.groupBy("block")).applyInPandas(_contexts(length), MESSAGE)
    settled = contexts.repartition("k1", "k2").sortWithinPartitions("k1", "k2").mapInPandas(_settle(length), MESSAGE)
    return dealt.cogroup(settled.groupBy("block")).applyInPandas(_remove(length), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<array<long>>")
