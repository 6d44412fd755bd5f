"""Operators and pipeline stages that SQL can't express, each against a plain form of what it has to give."""

import collections
import functools
import math
import random
import re

import duckdb
import numpy as np
import pytest
import xxhash
from tokenizers import Tokenizer

import corpus_pipeline
from tapeline.llm import decontaminate, packing, quality, toxicity
from tapeline.llm.queries import oracle_sql, queries, toxicity_model
from tests.conftest import rows
from tests.llm.test_operators import PATH, nearest, plain_chunks, plain_kneser_ney

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def test_packer_takes_the_level_that_adds_least():
    """Every choice against the sum of squared counts of partly filled sequences after each possible one."""
    rng = random.Random(3)
    for capacity in (5, 16, 33):
        packer = packing.Packer(capacity)
        for _ in range(600):
            size = rng.choice([1, 2, 3, rng.randrange(1, capacity)])

            def squares(level, size=size, capacity=capacity, packer=packer):
                counts = collections.Counter({h: int(n) for h, n in enumerate(packer.levels) if n})
                if level:
                    counts[level] -= 1
                if level + size < capacity:
                    counts[level + size] += 1
                return sum(n * n for n in counts.values())

            possible = [0, *(h for h in range(1, capacity - size + 1) if packer.levels[h])]
            assert squares(packer.level_for(size)) == min(map(squares, possible))
            list(packer.place((0, 0, bytes(4 * size), size)))
        assert packer.levels.tolist() == [len(s) for s in packer.open]


@functools.cache
def triples(word):
    """Weights of the common sequences of three characters, and their norm."""
    out = collections.Counter()
    for i in range(len(word)):
        for j in range(i + 1, len(word)):
            for k in range(j + 1, min(len(word), i + toxicity.SPAN)):
                out[word[i] + word[j] + word[k]] += toxicity.DECAY ** (k - i + 1)
    return out, np.sqrt(sum(v * v for v in out.values()))


def word_value(model, word):
    """What one word adds to its sentence: the kernel with each landmark, weighted."""
    word = word.strip(toxicity.EDGES) or word
    assert len(word) <= toxicity.WORD
    own, norm = triples(word)
    out = 0.0
    for landmark, weight in zip(model.landmarks, model.beta, strict=True):
        other, size = triples(landmark)
        if norm and size:
            out += weight * (sum(v * other[s] for s, v in own.items()) / (norm * size)) ** toxicity.POWER
    return out


def plain_scores(model, texts):
    value = functools.cache(lambda w: word_value(model, w))
    out = []
    for t in texts:
        split = [s.split() for s in re.split(r"[.!?] |\n", (t or "").lower())]
        pieces = [s[i : i + toxicity.LONG] for s in split for i in range(0, len(s), toxicity.LONG)]
        top = max((sum(map(value, p)) for p in pieces), default=0.0) + model.bias
        out.append(1 / (1 + np.exp(-(model.slope * top + model.shift))))
    return out


def test_toxicity_scores_equal_a_plain_sum():
    rng = random.Random(4)
    landmarks = ["moronic", "scumbag", "été", "the", "then"]
    model = toxicity.Model(landmarks, np.array([1.5, 2.0, -0.5, -0.7, -0.2]), -0.3, 1.7, 0.2)
    words = ["moronic", "mor0nic", "mo-ro-nic", "\"Scumbag,\"", "scum", "the", "then", "été", "漢字", "a", "!!", "s c u m"]
    texts = [None, "", " \n ", *("".join(rng.choice(words) + rng.choice([" ", " ", ". ", "! ", "\n", "? "]) for _ in range(rng.randrange(1, 50))) for _ in range(80))]
    assert np.allclose(model.ready().scores(texts), plain_scores(model, texts), atol=1e-4)


def test_linked_vectors_agree_with_sql(spark, tmp_path):
    """Groups, chains, copies and vectors that link with nothing, by the registered query and its SQL."""
    rng = np.random.default_rng(8)
    x = [c + rng.standard_normal(32) * s for c in rng.standard_normal((40, 32)) for s in [0.15, 0.2, 0.3][: rng.integers(1, 4)] for _ in range(rng.integers(1, 9))]
    turn = [np.r_[np.cos(0.3 * k), np.sin(0.3 * k), np.zeros(30)] for k in range(9)]
    own = [v.astype(np.float32).tolist() for v in [*x, *turn, *turn[:3], 7 * x[0]]] + [None, [], [0.0] * 32, [float("nan")] * 32, [None, *[1.0] * 31], [1.0, 0.0]]
    order = rng.permutation(len(own)).tolist()
    spark.createDataFrame([(i, own[j]) for i, j in enumerate(order)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    got = queries()["op3_embeddings"](spark, str(tmp_path)).toPandas()
    assert rows(got) == rows(con.execute(oracle_sql()["op3_embeddings"]).df())
    assert (got["n_links"] > 0).sum() > 100 and (got["n_links"] == 0).sum() > 5 and len(got) == len(own)


def plain_lines(docs):
    seen, out = set(), []
    for d in docs:
        kept = []
        for c in plain_chunks(d[1]) if d[1] is not None else []:
            if len(c) < 2 or tuple(c) not in seen:
                kept += c
            seen.add(tuple(c))
        out.append((d[0], None if d[1] is None else "\n".join(kept), *d[2:]))
    return out


def plain_one_of_each(docs):
    words = [(d[1] or "").lower().split() for d in docs]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in words]
    root = list(range(len(docs)))

    def find(i):
        return i if root[i] == i else find(root[i])

    for i, s in enumerate(sets):
        for j in range(i):
            if s and sets[j] and 100 * len(s & sets[j]) >= 80 * len(s | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [d for i, d in enumerate(docs) if root[i] == i]


def plain_without_items(docs, items):
    own = [decontaminate.folded(t) for t in items]
    held = lambda text: any(nearest(i, text) <= decontaminate.allowed(len(i)) for i in own)
    return [d for d in docs if not held(decontaminate.folded(d[1]))]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """documents, labels and benchmark with planted cases for every stage; the folder, the documents and the items."""
    rng = random.Random(21)
    folder = str(tmp_path_factory.mktemp("corpus"))
    word = lambda: "".join(rng.choice("tnrhoealsd") for _ in range(rng.randrange(2, 8)))
    many = lambda n: [word() for _ in range(n)]
    items = [" ".join(many(14)) for _ in range(3)]
    passage = [" ".join(many(4)) for _ in range(14)]
    texts = [" ".join([*many(30), *([rng.choice(["scumbag", "moronic"])] if i % 4 == 0 else []), *many(6)]) for i in range(120)]
    for i in range(20):
        base = texts[4 * i + 1].split()
        base[rng.randrange(len(base))] = "changed"
        texts += [texts[4 * i + 1]] if i % 2 else [" ".join(base), " ".join([*base, "more"])]
    texts += ["\n".join([" ".join(many(5)), *passage, " ".join(many(5))]) for _ in range(6)]
    for k in range(9):
        edited = list(items[k % 3])
        for at in rng.sample(range(len(edited)), k // 3):
            edited[at] = "z"
        texts.append(" ".join([*many(12), "".join(edited), *many(12)]))
    texts += [None, "", " \n", "two words", "two words", "\n".join(many(400))]
    order = rng.sample(range(len(texts)), len(texts))
    docs = [(i, texts[j], "en", "s", len(texts[j] or "")) for i, j in enumerate(order)]
    insult = re.compile("scumbag|moronic")
    spark.createDataFrame(docs, DOCUMENTS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(d[0], 1, int(bool(insult.search(d[1] or "")))) for d in docs], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, docs, items


def test_pipeline_against_plain_forms(spark, corpus):
    """Each stage on what the one before kept, then the whole run: the token ids of exactly the documents that are left."""
    folder, docs, items = corpus
    model = toxicity_model(spark, folder)
    score = plain_scores(model, [d[1] for d in docs])
    assert all(abs(s - toxicity.THRESHOLD) > 1e-3 for s in score)
    plain = {
        "toxicity": lambda own: [d for d, s in zip(own, score, strict=True) if s < toxicity.THRESHOLD],
        "line_dedup": plain_lines,
        "near_duplicates": plain_one_of_each,
        "decontamination": lambda own: plain_without_items(own, items),
    }
    for name, stage in corpus_pipeline.STAGES[:-1]:
        want = plain[name](docs)
        assert want != docs, name
        got = sorted(map(tuple, stage(spark, spark.createDataFrame(docs, DOCUMENTS), folder).collect()))
        assert got == want, name
        docs = want
    tokens = Tokenizer.from_file(PATH)
    want = {d[0]: [*tokens.encode(d[1] or "", add_special_tokens=False).ids, 0] for d in docs}
    pieces, filled = collections.defaultdict(list), collections.defaultdict(list)
    for r in corpus_pipeline.run(spark, folder).collect():
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        pieces[r["doc_id"]].append((r["start"], ids))
        filled[r["sequence_id"]].append((r["offset"], len(ids)))
    assert {i: [t for _, ids in sorted(p) for t in ids] for i, p in pieces.items()} == want
    for places in filled.values():
        ends = [0]
        for offset, n in sorted(places):
            assert offset == ends[-1]
            ends.append(offset + n)
        assert ends[-1] <= 1024


def test_contexts_of_a_hot_pair_are_dealt_evenly(spark):
    """Almost every context ends in the same two characters; its n-grams fill all shards alike, as Spark and numpy number them."""
    rng = random.Random(21)
    own = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz漢\U0001f600") + rng.choice("abcdefghijklmnopqrstuvwxyz") + "th" + rng.choice("aeiou") for _ in range(150)) for _ in range(20)]
    order, shards = 5, 8
    grams = sorted({t[i : i + order] for t in own for i in range(len(t) - order + 1) if t[i + 2 : i + 4] == "th"})
    got = spark.createDataFrame([(g,) for g in grams], "gram string").select("gram", quality.context_hash_of("gram", order).alias("h")).collect()
    hashes = quality.context_hash(quality.as_numbers([r["gram"] for r in got], order))
    assert hashes.tolist() == [r["h"] for r in got]
    sizes = np.bincount(hashes % shards, minlength=shards)
    assert len(grams) > 1000 and sizes.max() < 1.5 * np.median(sizes)


def test_questions_in_small_parts_get_the_same_answers(spark, monkeypatch):
    """Shards of few counts, and questions answered a few at a time, give what one shard and one answer give."""
    rng = random.Random(22)
    docs = spark.createDataFrame([(i, "".join(rng.choice("abc thé") for _ in range(rng.randrange(1, 80)))) for i in range(60)], "doc_id long, text string").selectExpr("*", "'en' AS lang")
    trusted = docs.where("doc_id < 40").select("doc_id")
    whole = {r["doc_id"]: r["perplexity"] for r in quality.perplexities(docs, trusted, block_bytes=10**6).collect()}
    monkeypatch.setattr(quality, "ASKED", 50)
    parts = {r["doc_id"]: r["perplexity"] for r in quality.perplexities(docs, trusted, block_bytes=400, shard_grams=60).collect()}
    assert parts == pytest.approx(whole, rel=1e-6)


def test_quality_choice_equals_a_plain_form(spark):
    """Held-out fifth by a hash of the id, quantile of its perplexities by language, and the fallbacks for languages without any."""
    rng = random.Random(23)
    docs = [(i, "".join(rng.choice("ab " if i % 7 else "abcdef") for _ in range(rng.randrange(5, 40))), ["en", "de", None][i % 3]) for i in range(90)]
    spread = lambda i: int.from_bytes(xxhash.xxh64_digest(i.to_bytes(8, "little"), seed=42), "big", signed=True)
    held = {i for i in range(60) if spread(i) % quality.HELD_OUT == 0}
    rare = next(i for i in range(60) if i not in held)  # the only trusted one of its language, and trained on
    docs[rare] = (rare, "ab ab", "fr")
    docs += [(90, "ba ba", "fr"), (91, "zzzz", "xx"), (92, "", "en"), (93, None, "en")]
    trusted = set(range(60))
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    p = plain_kneser_ney([docs[i][1] for i in sorted(trusted - held)], 3)
    score = {}
    for i, t, _ in docs:
        if t:
            s = quality.START * 2 + t + quality.END
            score[i] = math.exp(-sum(math.log(p(s[j : j + 3])) for j in range(len(s) - 2)) / (len(t) + 1))

    def quantile(ids):
        steps = sorted(math.ceil(math.log(score[i]) * quality.STEPS) for i in ids)
        return math.exp(steps[math.ceil(0.9 * len(steps)) - 1] / quality.STEPS) if steps else None

    got = {r["doc_id"]: r for r in quality.classify(d, d.where("doc_id < 60").select("doc_id"), order=3, quantile=0.9).collect()}
    assert len(got) == len(docs)
    for i, _, lang in docs:
        own = [j for j in trusted if docs[j][2] == lang]
        want = quantile([j for j in own if j in held]) or quantile(own) or quantile(trusted & held)
        assert got[i]["lang"] == lang and got[i]["threshold"] == pytest.approx(want, rel=2e-3)
        assert got[i]["perplexity"] == (pytest.approx(score[i], rel=1e-5) if i in score else None)
        if i not in score or abs(math.log(score[i] / want)) > 2e-3:
            assert got[i]["kept"] == (i in score and score[i] <= want)
