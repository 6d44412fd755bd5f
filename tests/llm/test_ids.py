"""Ids that floating point can't hold beside null ids, and one id on different texts."""

import collections

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tapeline.llm import decontaminate, licenses, lines, merkle, minhash, packing, quality, substrings, suffixes, toxicity
from tapeline.llm.bpe import token_counts
from tests.llm.test_operators import docs_of

BIG = 2**53
IDS = [None, BIG + 1, BIG + 3, -(BIG + 5), None, 2**63 - 2, 7, 7]
PATH = public_tokenizers.path("byte_bpe_50k.json")

OPERATORS = {
    "quality": lambda d: quality.classify(d, d.where("doc_id = 7").select("doc_id")),
    "minhash": minhash.near_duplicates,
    "substrings": lambda d: substrings.repeated_windows(d),
    "toxicity": lambda d: toxicity.scores(d, toxicity.fitted(d, d.select("doc_id", F.lit(0).alias("toxic")))),
    "bpe": lambda d: token_counts(d, PATH),
    "lines": lambda d: lines.without_repeated_chunks(d, counts=True),
    "suffixes": suffixes.repeated_strings,
    "packing": lambda d: packing.pack(d, PATH).dropDuplicates(["doc_id", "ids"]),
    "merkle": lambda d: merkle.manifest(d, "lang", "doc_id", ["doc_id", "text"]).withColumnRenamed("id", "doc_id"),
    "licenses": lambda d: licenses.scan(d).withColumnRenamed("id", "doc_id"),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_large_ids_beside_null_ones(spark, name):
    d = spark.createDataFrame([(i, f"text number {k}\nof its own {k * k}", "en") for k, i in enumerate(IDS)], "doc_id long, text string, lang string").coalesce(1)
    assert collections.Counter(r["doc_id"] for r in OPERATORS[name](d).collect()) == collections.Counter(IDS)


def test_large_ids_of_items(spark):
    d = spark.createDataFrame([(i, "some long text about a question of the exam", "en") for i in IDS], "doc_id long, text string, lang string").coalesce(1)
    items = spark.createDataFrame([(BIG + 1, "a question of the exam"), (None, "long text about a question")], "item_id long, text string")
    got = collections.Counter((r["doc_id"], r["item_id"]) for r in decontaminate.item_matches(d, items).collect())
    assert {i for i, _ in got if i is not None} == {i for i in IDS if i is not None} and {i for _, i in got} <= {BIG + 1, None}


def test_one_id_on_different_texts_loses_nothing_of_its_own(spark):
    passage = "\n".join(f"line {i} of a passage that many share" for i in range(12))
    unique = "unique one\nunique two"
    d = docs_of(spark, [passage]).unionByName(docs_of(spark, [None, passage]).where("doc_id = 1")).unionByName(docs_of(spark, [None, unique]).where("doc_id = 1"))
    cut = collections.Counter((r["doc_id"], r["text"]) for r in lines.without_repeated_chunks(d).collect())
    assert cut[(1, unique)] == 1 and cut[(0, passage)] == 1 and cut[(1, "")] == 1
    stay = collections.Counter((r["doc_id"], r["text"]) for r in minhash.one_of_each(d).collect())
    assert stay[(1, unique)] == 1 and stay[(0, passage)] == 1


def test_one_id_on_texts_that_share_lines(spark):
    """Of two texts of one id one keeps the common lines; equal rows lose none to each other."""
    passage = "\n".join(f"line {i} of a passage that many share" for i in range(12))
    own = [passage, passage + "\nits own end", passage]
    d = spark.createDataFrame([(1, t, "en") for t in own], "doc_id long, text string, lang string")
    kept = [r["text"] for r in lines.without_repeated_chunks(d).collect()]
    assert len(kept) == 3 and any(passage in t for t in kept)
    assert lines.without_repeated_chunks(d.where(~F.col("text").contains("its own"))).where(F.col("text") == passage).count() == 2
