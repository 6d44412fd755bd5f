"""Manifest, divergence audit and licence scans against plain Python."""

import collections
import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tapeline.llm import divergence, licenses, merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, idx long, words string, a string, shard int, tree string, digest string"
COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def table(spark, docs):
    """(doc_id, text, lang, source, n_chars), with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(*d, 7, "w", "a", 1, "t", "d") for d in docs], SCHEMA)


def odd_docs():
    rng = random.Random(3)
    word = lambda: rng.choice(["alpha", "Beta", "gamma", "été", "ÉTÉ", "x1y", "mit", "license", "cc", "by", "nc", "4", "0", "licensed", "under"])
    long = " ".join(word() for _ in range(20_000))
    docs = [(i, " ".join(word() for _ in range(rng.randrange(40))), rng.choice(["en", "fr", "", None]), rng.choice(["a", "b", "c", None]), rng.choice([None, 5])) for i in range(150)]
    docs += [(None, None, None, None, None), (None, "x", "en", "a", 1), (7, "Same ID, other text", "en", "b", 2), (7, "Same ID, other text", "en", "b", 2), (8, "", "en", "", 0), (9, long, "en", "a", 9), (2**53 + 1, "mit\nlicense", "en", "a", 1), (2**53 + 3, "a-b", "de", "lone", 1)]
    return docs


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def part(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def plain_log(n):
    """(level, idx) in the order of completion, one leaf at a time."""
    out = []
    for i in range(n):
        out.append((0, i))
        level, width = 0, n
        while width > 1:
            if (i + 1) % 8 ** (level + 1) and i + 1 != n:
                break
            level, width = level + 1, -(-width // 8)
            out.append((level, i // 8**level))
    return out


@pytest.mark.parametrize("n", [1, 2, 7, 8, 9, 63, 64, 65, 511, 512, 513, 520, 4096, 4097, 4161])
def test_positions_are_those_of_an_appending_writer(n):
    log = plain_log(n)
    assert [merkle.position(level, i, n) for level, i in log] == list(range(len(log))) and max(x[0] for x in log) == merkle.height(n)


def plain_tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + 8]) for i in range(0, len(levels[-1]), 8)])
    return levels


def plain_path(levels, i):
    path = []
    for level in levels[:-1]:
        run = level[i // 8 * 8 : i // 8 * 8 + 8]
        path.append((i % 8, run[: i % 8] + run[i % 8 + 1 :]))
        i //= 8
    return path


def plain_manifest(docs, lowered):
    trees = collections.defaultdict(list)
    for d in docs:
        i, text, lang, source, n_chars = d
        leaf = lambda t: h(part(i), part(source), part(lang), part(n_chars), part(t))  # noqa: B023, E731
        trees[lang].append((i is not None, i or 0, leaf(text), leaf(lowered(d))))
    order = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    low = {t: plain_tree([x[2] for x in sorted(trees[t])]) for t in order}
    high = plain_tree([low[t][-1][0] for t in order])
    out = []
    for k, t in enumerate(order):
        for j, (known, i, leaf, offered) in enumerate(sorted(trees[t])):
            path = plain_path(low[t], j) + plain_path(high, k)
            node = offered
            for at, others in path:
                node = h(*others[:at], node, *others[at:])
            out.append((i if known else None, leaf, low[t][-1][0], high[-1][0], h(*(x for _, others in path for x in others)), node))
    return sorted(out, key=str)


@pytest.mark.parametrize("copies", [1, 5])
def test_manifest(spark, copies):
    """Trees of one leaf, of several rounds of builders, of a null language; null and repeated ids."""
    docs = odd_docs() + [(1000 + i, f"T{i}", "en", "b", i) for i in range(600 * (copies - 1))]
    df = table(spark, docs)
    got = merkle.manifest(df, "lang", "doc_id", COLUMNS, {"text": F.when(df["doc_id"] % 3 == 0, F.lower("text")).otherwise(df["text"])})
    got = got.select("id", "leaf", "subroot", "root", merkle.proof_digest(F.col("path")), merkle.folded(F.col("offered"), F.col("path"))).collect()
    want = plain_manifest(docs, lambda d: d[1].lower() if d[0] is not None and d[0] % 3 == 0 and d[1] else d[1])
    assert sorted(map(tuple, got), key=str) == want


def test_manifest_of_nothing_and_of_one(spark):
    df = table(spark, odd_docs()[:1])
    assert merkle.manifest(df.limit(0), "lang", "doc_id", COLUMNS).collect() == []
    r = merkle.manifest(df, "lang", "doc_id", COLUMNS).first()
    assert r["leaf"] == r["subroot"] == r["root"] == r["offered"] and r["path"] == []


def plain_audit(docs, top, min_docs):
    words = [(lang or "", source or "", re.findall(r"[a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))) for _, text, lang, source, _ in docs]
    held = collections.Counter((lang, t) for lang, _, ws in words for t in set(ws))
    kept = {x for x, n in held.items() if n >= min_docs}
    out = []
    for lang in {w[0] for w in words}:
        terms = sorted(t for own, t in kept if own == lang)
        groups = {s: collections.Counter() for own, s, _ in words if own == lang}
        for own, s, ws in words:
            if own == lang:
                groups[s].update(t for t in ws if (lang, t) in kept)
        share = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (c.total() + len(terms)) for t in terms}  # noqa: B023, E731
        q = share(sum(groups.values(), collections.Counter()))
        p = {s: share(c) for s, c in groups.items()}
        far = lambda x, y: (x - y) ** 2 // y
        for s, c in groups.items():
            pairs = [(-sum(far(p[s][t], p[o][t]) for t in terms), o.encode(), o) for o in groups if o != s]
            more = [(-far(p[s][t], q[t]), t.encode(), t) for t in terms if c[t] and p[s][t] > q[t]]
            for name, found in (("pair", sorted(pairs)), ("term", sorted(more)[:top])):
                out += [(lang, s, name, item, -v, k) for k, (v, _, item) in enumerate(found, 1)]
    return sorted(out)


@pytest.mark.parametrize("shard_terms", [1_000_000, 4])
def test_audit(spark, shard_terms):
    """One shard and several, languages without kept terms, sources without terms, ties, ranks beyond the top."""
    docs = odd_docs()
    got = divergence.audit(table(spark, docs), top=3, shard_terms=shard_terms).collect()
    want = plain_audit(docs, 3, divergence.MIN_DOCS)
    assert sorted(map(tuple, got)) == want and {"", "en", "fr"} <= {x[0] for x in want}


def test_audit_of_nothing_and_of_no_terms(spark):
    df = table(spark, [(0, "one two", "en", "a", 1), (1, None, "en", "b", 1), (2, "", None, None, None)])
    assert divergence.audit(df.limit(0)).collect() == []
    got = sorted(map(tuple, divergence.audit(df).collect()))
    assert got == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]


def test_more_shards_than_buckets(spark, monkeypatch):
    monkeypatch.setattr(divergence, "BUCKETS", 2)
    docs = odd_docs()
    assert sorted(map(tuple, divergence.audit(table(spark, docs), top=3, shard_terms=4).collect())) == plain_audit(docs, 3, divergence.MIN_DOCS)


def test_terms_given_to_the_vectorizer(spark, monkeypatch):
    """Copies of documents give it no more than a few rows with the same terms."""
    given = []
    seen = divergence.vectors
    monkeypatch.setattr(divergence, "vectors", lambda terms, n: (given.append(terms.agg(F.sum(F.size("terms"))).first()[0]), seen(terms, n))[1])
    docs = [(i, "one two two three", "en", "ab"[i % 2], 1) for i in range(400)]
    got = divergence.audit(table(spark, docs)).collect()
    assert sorted(map(tuple, got)) == plain_audit(docs, 200, divergence.MIN_DOCS) and 0 < sum(given) < 300


@pytest.mark.parametrize("min_docs", [1, 2, 3, 5])
def test_rows_that_stand_for_documents(spark, min_docs):
    """Weights add up to occurrences, and rows tell whether enough documents hold a term, though tasks write before they end; NULs part no names."""
    rng = random.Random(min_docs)
    docs = odd_docs() + [(i, " ".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.choice([1, 3, 50]))), *rng.choice([("a\0", "b"), ("a", "\0b")]), 1) for i in range(30)]
    docs += [(i, " ".join(["rare"] * k), "en", "a", 1) for i, k in enumerate(rng.sample([0, 0, 7, 900], 4))]
    rows = divergence.condensed(table(spark, docs).repartition(3), min_docs, task_terms=20).collect()
    words = [(lang or "", source or "", re.findall(r"[a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))) for _, text, lang, source, _ in docs]
    n, held = (collections.Counter((lang, source, f"{lang} {t}") for lang, source, ws in words for t in kind(ws)) for kind in (list, set))
    got, times = collections.Counter(), collections.Counter()
    for r in rows:
        assert len(set(r["terms"])) == len(r["terms"])
        for t in r["terms"]:
            got[r["lang"], r["source"], t] += r["weight"]
            times[r["lang"], r["source"], t] += 1
    assert got == n and all(times[x] == d if d < min_docs else times[x] >= min_docs for x, d in held.items())
    assert {(r["lang"], t) for r in rows if r["first"] for t in r["terms"]} == {(lang, t) for lang, _, t in n}


def test_probabilities_of_counts_beyond_64_bits(spark):
    n, total, size = 10**12, 3 * 10**13 + 7, 10**9
    df = spark.createDataFrame([(n, total, size)], "n long, total long, size long")
    assert df.select(divergence.probability(F.col("n"), F.col("total"), F.col("size"))).first()[0] == 1 + 10**9 * (n + 1) // (total + size)


def test_probabilities_at_the_edge_of_64_bits(spark):
    cases = [(n, 3 * 10**9 + 1, 10**6 + 3) for n in (0, 1, 9_223_372_033, 9_223_372_034, 9_223_372_035, 9_223_372_036, 9_223_372_037, 2**62)]
    df = spark.createDataFrame(cases, "n long, total long, size long")
    got = df.select("n", divergence.probability(F.col("n"), F.col("total"), F.col("size"))).collect()
    assert [tuple(r) for r in got] == [(n, 1 + 10**9 * (n + 1) // (total + size)) for n, total, size in cases]


def plain_scan(texts):
    """Every offset of every template tried, one after another."""
    split = [[w for w in re.split("[^a-z0-9\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if w] for t in texts]
    vocabulary = {w for _, text, _ in licenses.TEMPLATES for w in licenses.plain_words(text)}
    df = collections.Counter(w for ws in split for w in set(ws) & vocabulary)
    out = []
    for ws in split:
        places = sorted((i, label) for p, label in licenses.BASE.items() for i in range(len(ws)) if ws[i : i + len(p.split())] == p.split())
        found = []
        for label, text, phrases in licenses.TEMPLATES:
            own = licenses.plain_words(text)
            rare = sorted(set(own), key=lambda w: (df[w], w))[: licenses.SEEDS]
            seeds = [(j, w) for j, w in enumerate(own) if w in rare]
            for at in range(-len(own), len(ws)):
                n = sum(0 <= at + j < len(ws) and ws[at + j] == w for j, w in seeds)
                if n * 2 >= len(seeds):
                    near = []
                    for phrase in map(licenses.plain_words, phrases):
                        j = next(j for j in range(len(own)) if own[j : j + len(phrase)] == phrase)
                        near.append(any(ws[i : i + len(phrase)] == phrase for i in range(max(0, at + j - licenses.SLACK), max(0, at + j + licenses.SLACK) + 1)))
                    if all(near):
                        found.append((label, n / len(seeds)))
        labels = {label for _, label in places}
        out.append((len(ws), len(places), places[0][0] if places else None, places[-1][0] if places else None, ",".join(sorted(labels)), ",".join(sorted(labels | {x for x, _ in found})), max([0.5 * bool(places), *(s for _, s in found)])))
    return out


def test_scan(spark):
    """Notices with words put in, taken out and repeated, at both ends, and texts without any."""
    rng = random.Random(8)
    filler = ["lorem", "ipsum", "the", "of", "version", "3", "license", "mit", "cc", "by", "software", "é", "Apache License"]
    texts = [None, "", " \n", "MIT license MIT License", "cc by cc by-nc 4.0", "Licensed under CC\nBY-NC 4.0", "x " * 30_000 + "Released under the MIT License. " * 300]
    for _ in range(300):
        words = [rng.choice(filler) for _ in range(rng.randrange(25))]
        for _ in range(rng.randrange(3)):
            notice = rng.choice(licenses.TEMPLATES)[1].split()
            for _ in range(rng.randrange(4)):
                at = rng.randrange(len(notice))
                notice[at : at + rng.randrange(2)] = [rng.choice(filler) for _ in range(rng.randrange(2))]
            at = rng.randrange(len(words) + 1)
            words[at:at] = notice
        texts.append(" ".join(words))
    df = table(spark, [(i, t, "en", "a", 1) for i, t in enumerate(texts)])
    got = [tuple(r)[1:] for r in licenses.report(licenses.scan(df)).orderBy("id").collect()]
    want = plain_scan(texts)
    assert got == want and len({x[5] for x in want}) > 15


def test_scan_of_odd_rows(spark):
    docs = odd_docs()
    got = licenses.report(licenses.scan(table(spark, docs))).collect()
    assert sorted((tuple(r)[1:] for r in got), key=str) == sorted(plain_scan([d[1] for d in docs]), key=str)
    assert collections.Counter(r["id"] for r in got) == collections.Counter(d[0] for d in docs)
    assert licenses.scan(table(spark, docs).limit(0)).collect() == []


def test_scan_runs_without_python_or_a_shuffle(spark):
    plan = licenses.report(licenses.scan(table(spark, odd_docs())))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|ArrowEval|Exchange", plan)
