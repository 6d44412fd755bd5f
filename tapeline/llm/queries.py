"""The registered queries of this folder, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeline.llm import decontaminate, divergence, embeddings, licenses, lines, merkle, minhash, packing, quality, substrings, suffixes, toxicity
from tapeline.llm.bpe import token_counts
from tapeline.llm.common import lowered


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id) -> F.Column:
    """Rows whose labels are never learned from."""
    return F.crc32(doc_id.cast("string")) % 3 == 1


def toxicity_model(spark: SparkSession, sf_dir: str) -> toxicity.Model:
    labels = table(spark, sf_dir, "labels")
    return toxicity.fitted(table(spark, sf_dir, "documents"), labels.where(~held_out(labels["doc_id"])))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = table(spark, sf_dir, "labels").where("quality = 1")
    return quality.classify(table(spark, sf_dir, "documents"), trusted)


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), width=4, percent=80)


def op3_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"), cosine=0.9)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), capacity=1024, end_id=0)
    return pieces.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("length"), F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op5_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.repeated_windows(table(spark, sf_dir, "documents"), width=35).drop("spans")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.item_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.scores(table(spark, sf_dir, "documents"), toxicity_model(spark, sf_dir))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 512)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lines.without_repeated_chunks(table(spark, sf_dir, "documents").select("doc_id", "text"), counts=True)
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op10_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.repeated_strings(table(spark, sf_dir, "documents"), length=100).drop("spans")


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tampered = F.when(F.crc32(docs["doc_id"].cast("string")) % 3 == 0, lowered(docs["text"])).otherwise(docs["text"])
    proved = merkle.manifest(docs, "lang", "doc_id", ["doc_id", "source", "lang", "n_chars", "text"], {"text": tampered})
    checked = proved.withColumn("folded_root", merkle.folded(F.col("offered"), F.col("path")))
    return checked.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", merkle.proof_digest(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"), top=200)


def op13_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.report(licenses.scan(table(spark, sf_dir, "documents"))).withColumnRenamed("id", "doc_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_quality, op2_minhash, op3_embeddings, op4_packing, op5_substrings, op6_decontamination, op7_toxicity, op8_token_counts, op9_line_dedup, op10_suffixes, op11_merkle, op12_divergence, op13_licenses)
    return {f.__name__: f for f in own}


MINHASH_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(len(w) - 3, 1) + 1), lambda i: array_to_string(w[i : i + 3], ' '))) END AS s
  FROM words),
rows AS (SELECT doc_id, unnest(s) AS x FROM sets),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM rows a JOIN rows b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM shared JOIN sets p ON p.doc_id = a JOIN sets q ON q.doc_id = b WHERE 100 * n >= 80 * (len(p.s) + len(q.s) - n)),
reach AS (SELECT doc_id AS id, doc_id AS c FROM documents UNION SELECT b, c FROM reach JOIN links ON a = id),
least AS (SELECT id, min(c) AS c FROM reach GROUP BY id)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, c AS component_id, doc_id = c AS kept FROM sets JOIN least ON id = doc_id
"""

EMBEDDINGS_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS MATERIALIZED (SELECT * FROM v WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND CASE WHEN len(a.e) = len(b.e) THEN list_cosine_similarity(a.e, b.e) >= 0.9 ELSE false END),
reach AS (SELECT vec_id AS id, vec_id AS c FROM v UNION SELECT b, c FROM reach JOIN links ON a = id),
least AS (SELECT id, min(c) AS c FROM reach GROUP BY id),
times AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, c AS component_id, vec_id = c AS kept
FROM v JOIN least ON id = vec_id LEFT JOIN times ON a = vec_id
"""

SUBSTRINGS_SQL = r"""
WITH words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
starts AS (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM words WHERE len(w) >= 35),
windows AS (SELECT doc_id, i, md5(array_to_string(w[i : i + 34], ' ')) AS h FROM starts),
again AS (SELECT doc_id, i FROM windows WHERE h IN (SELECT h FROM windows GROUP BY h HAVING count(*) > 1)),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS i FROM again),
every AS (SELECT doc_id, w[i] AS x, i FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM words)),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS t, count(*) AS n FROM every ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT words.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM words LEFT JOIN kept USING (doc_id)
"""


#: Levels of nodes by folding runs of eight; each leaf is then folded with the other children of its ancestors.
MERKLE_SQL = r"""
WITH RECURSIVE crc AS (
  SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END) AS v
  FROM (SELECT unnest(range(256)) AS i)),
crcs AS (SELECT list(v ORDER BY i) AS t FROM crc),
named AS (
  SELECT doc_id, lang, coalesce('=' || lang, '-') AS tree, text,
    xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda d: CAST(ascii(d) AS BIGINT))),
      lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1]))) % 3 = 0 AS hit,
    [CAST(doc_id AS VARCHAR), source, lang, CAST(n_chars AS VARCHAR)] AS f
  FROM documents, crcs),
leaves AS (
  SELECT doc_id, tree, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    sha256(head || coalesce(strlen(text) || ':' || CASE WHEN hit THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END, '-')) AS offered
  FROM (SELECT *, array_to_string(list_transform(f, lambda x: coalesce(strlen(x) || ':' || x, '-')), '') AS head FROM named)),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY tree) AS n FROM leaves),
low AS (
  SELECT tree, 0 AS level, idx, n, leaf AS digest FROM placed
  UNION ALL SELECT tree, any_value(level) + 1, idx // 8, (any_value(n) + 7) // 8, sha256(string_agg(digest, '' ORDER BY idx)) FROM low WHERE n > 1 GROUP BY tree, idx // 8),
tops AS (SELECT tree, level AS height, digest AS subroot, row_number() OVER (ORDER BY encode(tree)) - 1 AS idx, count(*) OVER () AS n FROM low WHERE n = 1),
high AS (
  SELECT 0 AS level, idx, n, subroot AS digest FROM tops
  UNION ALL SELECT any_value(level) + 1, idx // 8, (any_value(n) + 7) // 8, sha256(string_agg(digest, '' ORDER BY idx)) FROM high WHERE n > 1 GROUP BY idx // 8),
runs AS (
  SELECT tree, level, idx // 8 AS parent, list(digest ORDER BY idx) AS nodes FROM low WHERE n > 1 GROUP BY 1, 2, 3
  UNION ALL SELECT t.tree, t.height + h.level, h.idx // 8, list(h.digest ORDER BY h.idx)
  FROM tops t JOIN high h ON h.n > 1 AND h.idx // 8 = t.idx // CAST(pow(8, h.level + 1) AS BIGINT) GROUP BY ALL),
climb AS (
  SELECT doc_id, leaf, p.tree, 0 AS level, p.idx, p.idx AS own, t.idx AS top, t.height, offered AS folded, '' AS proof, t.subroot FROM placed p JOIN tops t ON p.tree = t.tree
  UNION ALL
  SELECT doc_id, leaf, c.tree, c.level + 1, CASE WHEN c.level + 1 = height THEN top ELSE c.idx // 8 END, own, top, height,
    sha256(array_to_string(nodes[1:seat], '') || folded || array_to_string(nodes[seat + 2 :], '')),
    proof || array_to_string(nodes[1:seat], '') || array_to_string(nodes[seat + 2 :], ''), subroot
  FROM (SELECT *, CASE WHEN level = height THEN top ELSE idx END % 8 AS seat, CASE WHEN level = height THEN top ELSE idx END // 8 AS up FROM climb) c
  JOIN runs r ON r.tree = c.tree AND r.level = c.level AND r.parent = c.up)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = root AS verified
FROM climb, (SELECT digest AS root, level AS over FROM high WHERE n = 1) WHERE level = height + over
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_minhash": MINHASH_SQL, "op3_embeddings": EMBEDDINGS_SQL, "op5_substrings": SUBSTRINGS_SQL, "op9_line_dedup": lines.ORACLE, "op11_merkle": MERKLE_SQL, "op12_divergence": divergence.ORACLE, "op13_licenses": licenses.oracle()}
