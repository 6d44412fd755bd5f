import collections
import hashlib
import itertools
import random
import re

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tapeline.llm import decontaminate, embeddings, lines, minhash, packing, quality, substrings, suffixes, toxicity
from tapeline.llm.bpe import IdEncoder, MergeCounter, token_counts
from tapeline.llm.queries import oracle_sql, queries
from tests.conftest import SF, rows

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, block int, key string, kept string"


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, "en", 0, "x", "y") for i, t in enumerate(texts)], SCHEMA)


def odd(spark):
    """Nulls in every column, empty, blank and long texts, repeated rows, columns with clashing names."""
    rng = random.Random(1)
    long = " ".join(rng.choice(["ab", "cd", "ef", "gh", "ij"]) + str(rng.randrange(99)) for _ in range(9000))
    own = [(0, long, "en", 1, "a", None), (1, long, None, None, None, None), (1, long, None, None, None, None), (2, "", "en", 0, "", ""), (3, None, None, None, None, None), (4, " \n\t ", "fr", 0, "", ""), (None, "some words here", "en", 0, "", ""), (5, "a\n\nb\nc", "en", 0, "", "")]
    return spark.createDataFrame(own, SCHEMA)


OPERATORS = {
    "quality": lambda d: quality.classify(d, d.where("doc_id < 2").select("doc_id")),
    "minhash": minhash.near_duplicates,
    "packing": lambda d: packing.pack(d, PATH),
    "substrings": lambda d: substrings.repeated_windows(d),
    "decontaminate": lambda d: decontaminate.item_matches(d, d.select(F.col("doc_id").alias("item_id"), "text")),
    "toxicity": lambda d: toxicity.scores(d, toxicity.fitted(d, d.select("doc_id", F.lit(0).alias("toxic")))),
    "bpe": lambda d: token_counts(d, PATH),
    "lines": lambda d: lines.without_repeated_chunks(d, counts=True),
    "suffixes": suffixes.repeated_strings,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows_and_empty_tables(spark, name):
    d = odd(spark)
    got = OPERATORS[name](d).collect()
    if name not in ("packing", "decontaminate"):
        assert len(got) == 8
    assert OPERATORS[name](d.limit(0)).collect() == []


def test_stages_with_odd_rows(spark):
    """What each stage of the pipeline keeps of nulls, empty texts, repeats and clashing names."""
    d = odd(spark).withColumn("_gone", F.lit("mine"))
    item = spark.createDataFrame([(None, "Some WORDS, here")], "item_id long, text string")
    every = [None, 0, 1, 1, 2, 3, 4, 5]
    stages = {
        (lambda t: toxicity.without_toxic(t, toxicity.fit([], 0.0))): every,
        (lambda t: lines.without_repeated_chunks(t)): every,
        (lambda t: minhash.one_of_each(t)): [None, 0, 2, 3, 4, 5],
        (lambda t: decontaminate.without_items(t, item)): every[1:],
    }
    for stage, want in stages.items():
        out = stage(d)
        assert out.columns == d.columns
        got = out.collect()
        assert sorted((r["doc_id"] for r in got), key=lambda i: -1 if i is None else i) == want
        assert {r["text"] for r in got if r["doc_id"] in (3, 5)} == {None, "a\n\nb\nc"} and {r["_gone"] for r in got} == {"mine"}
        assert stage(d.limit(0)).collect() == []


def test_odd_vectors(spark):
    own = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (1, [2.0, 0.0]), (2, None), (3, []), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (None, [1.0, 0.0]), (6, [1.0, 0.0, 0.0]), (7, [1.0, None])]
    v = spark.createDataFrame(own, "vec_id long, embedding array<float>")
    got = collections.Counter((r["vec_id"], r["n_links"], r["component_id"]) for r in embeddings.near_duplicates(v).collect())
    assert got[(0, 2, 0)] == 1 and got[(1, 2, 0)] == 2 and got[(6, 0, 6)] == 1 and sum(got.values()) == 10
    assert embeddings.near_duplicates(v.limit(0)).collect() == []


def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(4)
    centers = rng.standard_normal((12, 24))
    x = np.concatenate([c + rng.standard_normal((n, 24)) * s for c, n, s in zip(centers, [700, 80, *[6] * 10], [0.2, 0.25, *[0.3] * 10], strict=True)]).astype(np.float32).astype(float)
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<float>")
    got = {r["vec_id"]: r["n_links"] for r in embeddings.near_duplicates(v).collect()}
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    want = (unit @ unit.T >= 0.9).sum(1) - 1
    have = np.array([got[i] for i in range(len(x))])
    assert (have <= want).all() and have.sum() >= 0.995 * want.sum() > 0


def test_near_duplicates_of_a_chain(spark):
    base = [f"w{i}" for i in range(100)]
    chain = [" ".join([*(f"n{i}" for i in range(6 * k)), *base[6 * k :]]) for k in range(6)]
    got = [r["component_id"] for r in minhash.near_duplicates(docs_of(spark, chain), width=1).orderBy("doc_id").collect()]
    assert got == [0] * 6


def test_tokens_equal_the_library():
    t, counter, encoder = Tokenizer.from_file(PATH), MergeCounter(PATH), IdEncoder(PATH)
    rng = random.Random(2)
    bits = [" ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", "a", "é", "1", "²", "一", "!", "'s", "S", "<|endoftext|>", "<|end", "́", "\U0001f600", "\x00", "\r\n", " the", " hello"]
    for _ in range(3000):
        s = "".join(rng.choice(bits) for _ in range(rng.randrange(12)))
        ids = t.encode(s, add_special_tokens=False).ids
        assert counter.count(s) == len(ids) and encoder.ids(s) == np.array(ids, "<u4").tobytes()


def test_packing_is_whole(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    got = packing.pack(d, PATH).collect()
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        by_doc[r["doc_id"]].append((r["start"], r["ids"]))
        by_sequence[r["sequence_id"]].append((r["offset"], len(r["ids"]) // 4))
    e = IdEncoder(PATH)
    for r in d.collect():
        assert b"".join(ids for _, ids in sorted(by_doc[r["doc_id"]])) == e.ids(r["text"]) + bytes(4)
    sizes = []
    for pieces in by_sequence.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        sizes.append(at)
    assert max(sizes) <= 1024 and sum(n < 1024 for n in sizes) <= 1


def removed(texts, size):
    """Byte-wise brute force of the repeated strings."""
    seen, out = set(), []
    for t in texts:
        gone = bytearray(len(t))
        for j in range(len(t) - size + 1):
            if t[j : j + size] in seen:
                gone[j : j + size] = b"\1" * size
            seen.add(t[j : j + size])
        out.append((sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(bytes(b for b, g in zip(t, gone, strict=True) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize("limit", [256, 2, 1])
def test_repeated_strings(spark, limit):
    rng = random.Random(5)
    pool = ["".join(rng.choice("abcé ") for _ in range(150)) for _ in range(4)]
    texts = ["".join(rng.choice([*pool, "".join(rng.choice("ab") for _ in range(40)), "a" * 130]) for _ in range(6)) for _ in range(40)]
    got = [(r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffixes.repeated_strings(docs_of(spark, texts), block_bytes=6000, contexts_limit=limit).orderBy("doc_id").collect()]
    assert got == removed([t.encode() for t in texts], 100)


def test_suffix_array():
    rng = np.random.default_rng(1)
    for _ in range(60):
        text = rng.integers(0, 4, rng.integers(1, 60)).astype(np.uint8)
        text[-1] = 0
        seps = iter(range(100))
        key = [(0, next(seps)) if c == 0 else (int(c), 0) for c in text]
        assert suffixes.suffix_array(text).tolist() == sorted(range(len(text)), key=lambda i: key[i:])


def test_items_with_edits(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9)))
    items = [" ".join(word() for _ in range(40)) for _ in range(20)]
    texts, want = [], set()
    for i, item in enumerate(items):
        s = list(item)
        for _ in range(int(0.04 * len(s))):
            p = rng.randrange(len(s))
            s[p : p + 1] = rng.choice([[], ["z"], [s[p], "q"]])
        texts.append(" ".join(word() for _ in range(60)) + " " + "".join(s) + " " + " ".join(word() for _ in range(60)))
        want.add((i, i))
    texts += [" ".join(word() for _ in range(160)) for _ in range(20)]
    table = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.item_matches(docs_of(spark, texts), table).collect()}
    assert got <= want and len(got) >= 18


def test_items_in_capitals(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("éñüçàaeonrst") for _ in range(rng.randrange(2, 9)))
    items = [" ".join(word() for _ in range(30)) for _ in range(4)] + [" ".join(["straße", "größe", *(word() for _ in range(25))])]
    texts = [item.upper() for item in items] + ["¡" + item.replace(" ", "… «") + "»" for item in items]
    table = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r["doc_id"], r["item_id"], r["distance"]) for r in decontaminate.item_matches(docs_of(spark, texts), table).collect()}
    assert got == {(i, i % 5, 0) for i in range(10)}
    assert decontaminate.without_items(docs_of(spark, texts), table).count() == 0


def nearest(item, text):
    """Smallest edit distance of the item to any part of the text, row by row."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def test_items_of_all_lengths(spark):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9)))
    items = ["2 + 2 = 4", "ok", "aaaaaa bbbbbbbbb c", "one two three four five six seven eight", *(" ".join(word() for _ in range(n)) for n in (4, 6, 8, 20, 60, 300))]
    texts, want = [], set()
    for i, item in enumerate(items):
        for edits in (0, 1, decontaminate.allowed(len(item)), 4 * decontaminate.allowed(len(item)) + 4):
            s = list(item)
            for p in rng.sample(range(1, len(s) - 1), min(edits, len(s) - 2)) if edits else ():
                s[p] = "z"
            texts.append(" ".join([word() for _ in range(20)] + ["".join(s)] + [word() for _ in range(20)]))
    texts += ["book okay", "2 2 44", *(" ".join(items[-1].split()[a : a + 60]) for a in (0, 120))]
    for d, text in enumerate(texts):
        for i, item in enumerate(items):
            a, b = decontaminate.folded(item), decontaminate.folded(text)
            near = nearest(a, b) if len(a) < 600 or len(b) < 2 * len(a) else 0
            if len(a) < 8 and b" " + a + b" " in b" " + b + b" " or len(a) >= 8 and near <= decontaminate.allowed(len(a)):
                want.add((d, i, 0 if len(a) < 8 else near))
    table = spark.createDataFrame([*enumerate(items), (None, items[-2]), (99, None)], "item_id long, text string")
    d = docs_of(spark, texts)
    got = decontaminate.item_matches(d, table).collect()
    assert {(r["doc_id"], r["item_id"], r["distance"]) for r in got} == want
    for r in got:
        text = decontaminate.folded(texts[r["doc_id"]])[r["start"] : r["start"] + r["length"]]
        assert nearest(decontaminate.folded(items[r["item_id"]]), text) == r["distance"]
    assert {r["doc_id"] for r in decontaminate.without_items(d, table).collect()} == set(range(len(texts))) - {w[0] for w in want}


def gapped(a, b):
    """The string kernel summed over all common sequences of three characters, normalised and raised."""
    def own(w):
        out = collections.Counter()
        for i in range(len(w)):
            for j in range(i + 1, len(w)):
                for k in range(j + 1, min(len(w), i + toxicity.SPAN)):
                    out[w[i] + w[j] + w[k]] += toxicity.DECAY ** (k - i + 1)
        return out
    x, y = own(a), own(b)
    dot = lambda p, q: sum(v * q[s] for s, v in p.items())
    return (dot(x, y) / np.sqrt(dot(x, x) * dot(y, y))) ** toxicity.POWER if x and y else 0.0


@pytest.mark.parametrize("table", [96, 0])
def test_kernel_equals_a_plain_sum(table, monkeypatch):
    monkeypatch.setattr(toxicity, "TABLE", table)
    rng = random.Random(11)
    words = ["".join(rng.choice("abcé漢\U0001f600ß") for _ in range(rng.randrange(1, 12))) for _ in range(40)] + ["idiot", "id1ot", "idi0t"]
    got = toxicity.Kernel(words[:20]).of(words)
    want = [[gapped(a, b) for b in words[:20]] for a in words]
    assert np.allclose(got, want, atol=1e-5)


def test_toxicity_tolerates_gaps(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("tnrhoeal") for _ in range(rng.randrange(2, 8)))
    bad = ["scumbag", "moronic", "pathetic"]
    rows_ = [(i, " ".join([word() for _ in range(30)] + ([rng.choice(bad)] if i % 3 == 0 else []) + [word() for _ in range(9)]), int(i % 3 == 0)) for i in range(300)]
    model = toxicity.fit(rows_, 1 / 3).ready()
    plain, gapped, clean = model.scores(["then the hole scumbag ran on", "then the hole scumxbag ran on", "then the hole teal ran on"])
    assert plain > 0.7 and gapped > clean and clean < 0.5


def plain_kneser_ney(texts_, order):
    """p(character | context) from dictionaries, for a model of the texts."""
    tables = {order: collections.Counter()}
    for t in texts_:
        s = quality.START * (order - 1) + t + quality.END
        tables[order].update(s[i : i + order] for i in range(len(s) - order + 1))
    for k in range(order - 1, 0, -1):
        tables[k] = collections.Counter(g[1:] for g in tables[k + 1])
    less = {}
    for k, table in tables.items():
        n = [sum(c == j for c in table.values()) for j in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1]) if all(n[:3]) else 0
        less[k] = [min(max(j - (j + 1) * y * n[j] / n[j - 1], 0), j) for j in (1, 2, 3)] if all(n[:3]) else [0.5, 1.0, 1.5]

    def p(gram):
        k = len(gram)
        if not k:
            return 1 / (len(tables[1]) + 1)
        own = [(g, c) for g, c in tables[k].items() if g[:-1] == gram[:-1]]
        if not own:
            return p(gram[1:])
        d = lambda c: less[k][min(c, 3) - 1]
        here = tables[k].get(gram, 0)
        return ((here - d(here) if here else 0) + sum(d(c) for _, c in own) * p(gram[1:])) / sum(c for _, c in own)

    return p


def plain_chunks(text):
    own = text.split("\n")
    h = [int(hashlib.md5(x.encode()).hexdigest()[:8], 16) for x in own]
    v = [((h[i - 1] if i else 0) % 1000003 * 31 + h[i]) % 1000003 for i in range(len(h))]
    ends = [0, *(i for i in range(2, len(v) - 1) if v[i - 1] < min(v[i - 2], v[i])), len(v)]
    starts = [s for a, b in itertools.pairwise(ends) for s in range(a, max(a, b - 2) + 1, lines.MOST)]
    return [own[a:b] for a, b in itertools.pairwise([*starts, len(own)])]


def test_line_chunks_against_a_plain_form(spark):
    """Planted runs, runs of one repeated line and odd texts; each text's lines all stand in its chunks."""
    rng = random.Random(11)
    passage = [f"p{i}" for i in range(15)]
    own = ["By To.\n" * 91, "x\n" + "By To.\n" * 40 + "y", "\n".join(passage), "\n".join(["q", *passage, "r", "s"]), "", "\n", "a\nb", "z\na\nb", None]
    own += ["\n".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 40))) for _ in range(60)]
    seen, want = set(), {}
    for i, t in enumerate(own):
        kept, gone = [], 0
        for c in plain_chunks(t) if t is not None else []:
            assert 2 <= len(c) <= lines.MOST + 1 or c == t.split("\n")
            if len(c) >= 2 and tuple(c) in seen:
                gone += len(c)
            else:
                kept += c
            seen.add(tuple(c))
        want[i] = (gone, None if t is None else "\n".join(kept))
    got = {r["doc_id"]: (r["n_removed"], r["text"]) for r in lines.without_repeated_chunks(docs_of(spark, own), counts=True).collect()}
    assert got == want
    assert got[0][0] == 84 and got[1][0] == 36 and got[3][0] > 0


@pytest.mark.parametrize("order", [3, 5])
def test_perplexity_equals_a_plain_model(spark, order):
    rng = random.Random(10)
    own = ["".join(rng.choice("abcdé\U0001f600 ") for _ in range(rng.randrange(1, 60))) for _ in range(40)] + ["zzz", "漢字 abc"]
    p = plain_kneser_ney(own[:30], order)
    d = docs_of(spark, own).select("doc_id", "text", "lang")
    got = {r["doc_id"]: r["perplexity"] for r in quality.perplexities(d, d.where("doc_id < 30").select("doc_id"), order, 300, 50).collect()}
    for i, t in enumerate(own):
        s = quality.START * (order - 1) + t + quality.END
        logs = [np.log(p(s[j : j + order])) for j in range(len(s) - order + 1)]
        assert got[i] == pytest.approx(np.exp(-np.mean(logs)), rel=1e-5)


def test_quality_sees_more_than_trigrams(spark):
    rng = random.Random(9)
    words = ["".join(rng.choice("aeinorst") for _ in range(6)) for _ in range(60)]
    good = [" ".join(rng.choice(words) for _ in range(200)) for _ in range(40)]
    after = collections.defaultdict(list)
    for t in good:
        for i in range(len(t) - 2):
            after[t[i : i + 2]].append(t[i + 2])
    bad = []
    for t in good[:10]:
        made = t[:2]
        while len(made) < 1400:
            made += rng.choice(after[made[-2:]])
        bad.append(made)
    d = docs_of(spark, good + bad)
    got = {r["doc_id"]: r["kept"] for r in quality.classify(d, d.where("doc_id < 40").select("doc_id")).collect()}
    assert all(got[i] for i in range(40)) and not any(got[i] for i in range(40, 50))


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_agrees_with_sql(spark, duck, name):
    assert rows(queries()[name](spark, SF).toPandas()) == rows(duck.execute(oracle_sql()[name]).df())


def test_windows_with_one_hash_stay(spark, monkeypatch):
    """With all Rabin-Karp hashes of few bits, digests alone decide: the same as a plain count of windows."""
    rng = random.Random(5)
    words = [[rng.choice("abc") + rng.choice("xyz") for _ in range(rng.randrange(60))] for _ in range(60)]
    words += [w[3:40] for w in words[:20]] + [words[3]] * 3
    docs = spark.createDataFrame([(i, "\t ".join(w)) for i, w in enumerate(words)] + [(None, None), (None, "")], "doc_id long, text string").repartition(5)

    def few_bits(texts_, width, plain=substrings._windows):
        return [h % np.uint64(7) for h in plain(texts_, width)]

    starts = collections.Counter(tuple(w[i : i + 5]) for w in words for i in range(len(w) - 4))
    want = {}
    for n, w in enumerate(words):
        gone = {j for i in range(len(w) - 4) if starts[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        want[n] = len(w), len(gone), hashlib.sha256(" ".join(x for j, x in enumerate(w) if j not in gone).encode()).hexdigest()
    for _ in range(2):
        got = substrings.repeated_windows(docs, width=5, block_bytes=900).collect()
        assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got if r["doc_id"] is not None} == want
        assert sum(r["doc_id"] is None and r["n_words"] == 0 for r in got) == 2 and 0 < sum(r["n_removed"] for r in got) < sum(map(len, words))
        monkeypatch.setattr(substrings, "_windows", few_bits)


def test_pipeline(spark):
    import corpus_pipeline

    d = docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == columns and 0 < docs.count() <= d.count(), name
    assert corpus_pipeline.run(spark, SF).select("doc_id").distinct().count() == docs.count()
