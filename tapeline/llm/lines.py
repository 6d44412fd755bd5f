"""Line dedup by content-defined chunks of lines; built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Lines that the rolling hash spans, and lines after which a chunk without an end of its own is cut.
SPAN, MOST = 2, 6


def line_chunks(text: Column) -> Column:
    """array<struct<pos, n_lines, body>>: the chunks of a text, in order; null for null.

    The 32-bit hash of each line enters a polynomial over the last SPAN lines. A chunk
    ends after a line whose value is smaller than those of both neighbours, so an
    inserted or removed line moves ends only within SPAN lines of it, and two ends are never
    next to each other. Where no end comes, as in a run of one repeated line, a chunk is cut every
    MOST lines. A chunk has 2 to MOST + 1 lines; a text of one line is one chunk.
    """
    lines = F.split(text, "\n", -1)
    hashes = F.transform(lines, lambda line: F.conv(F.substring(F.md5(line), 1, 8), 16, 10).cast("long"))
    packed = F.struct(lines.alias("lines"), hashes.alias("h"))

    # one-element arrays name an intermediate value, so that it is computed once
    def then(x: Column, step) -> Column:
        return F.transform(F.array(x), step)[0]

    def rolled(x: Column) -> Column:
        def value(i: Column) -> Column:
            v = F.lit(0).cast("long")
            for back in range(SPAN - 1, -1, -1):
                v = (v * 31 + F.coalesce(F.get(x["h"], i - back), F.lit(0))) % 1000003
            return v

        return F.struct(x["lines"].alias("lines"), F.transform(F.sequence(F.lit(0), F.size(x["h"]) - 1), value).alias("v"))

    def ended(x: Column) -> Column:
        v, n = x["v"], F.size(x["v"])
        is_least = lambda i: (F.get(v, i - 1) < F.get(v, i - 2)) & (F.get(v, i - 1) < F.get(v, i))
        inner = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | ((i >= 2) & (i <= n - 2) & is_least(i)))
        return F.struct(x["lines"].alias("lines"), inner.alias("starts"))

    def cut(x: Column) -> Column:
        own = x["starts"]
        pieces = F.transform(own, lambda s, k: F.sequence(s, F.greatest(s, F.coalesce(F.get(own, k + 1), F.size(x["lines"])) - 2), F.lit(MOST)))
        return F.struct(x["lines"].alias("lines"), F.flatten(pieces).alias("starts"))

    def chunked(x: Column) -> Column:
        starts = x["starts"]

        def body(s: Column, k: Column) -> Column:
            n = F.coalesce(F.get(starts, k + 1), F.size(x["lines"])) - s
            return F.struct(k.alias("pos"), n.alias("n_lines"), F.array_join(F.slice(x["lines"], s + 1, n), "\n").alias("body"))

        return F.transform(starts, body)

    out = packed
    for step in (rolled, ended, cut, chunked):
        out = then(out, step)
    return F.when(text.isNotNull(), out)


def repeated_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_lines: int = 2) -> DataFrame:
    """(_doc, _text, _gone): for each document that has any, by its id and a hash of its text, the places of its chunks that repeat an earlier one.

    A chunk of at least ``least_lines`` lines goes if the same bytes are a chunk of a
    document with a smaller id, or with the same id and a smaller hash of its text, or stand earlier in the same one. Hashes only pick
    candidates, which are then grouped by their bytes. Counts are combined before
    they are shuffled; a hot chunk's join is left to Spark to split.
    """
    own = ["_doc", "_text"]
    base = docs.select(docs[id_col].alias("_doc"), F.xxhash64(docs[text_col].cast("string")).alias("_text"), docs[text_col].cast("string").alias("_of")).where("_doc is not null and _of is not null")
    chunk = base.select(*own, F.explode(line_chunks(F.col("_of"))).alias("_c")).where(F.col("_c.n_lines") >= least_lines)
    marks = chunk.select(*own, F.col("_c.pos").alias("pos"), F.xxhash64("_c.body").alias("h"))
    again = marks.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")
    places = marks.join(again, "h", "left_semi").groupBy(*own).agg(F.collect_set("pos").alias("_at"))
    some = base.join(places, own).select(*own, F.explode(F.filter(line_chunks(F.col("_of")), lambda c: F.array_contains(F.col("_at"), c["pos"]))).alias("_c")).select(*own, "_c.pos", "_c.body")
    first = some.groupBy("body").agg(F.min(F.struct(*own, "pos")).alias("first"), F.count("*").alias("n")).where("n > 1").select("body", "first")
    later = some.join(first, "body").where(F.struct(*own, "pos") > F.col("first"))
    return later.groupBy(*own).agg(F.collect_set("pos").alias("_gone"))


def without_repeated_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_lines: int = 2, counts: bool = False) -> DataFrame:
    """The documents, all columns, with repeated multi-line chunks cut from their texts.

    With ``counts``, n_lines and n_removed (lines) are added, and must not be names of
    the table's own. A text that loses all its lines becomes empty; a null text
    stays null, with 0 lines; a row with a null id loses nothing and takes nothing
    from others; rows that share an id and a text lose the same places, and none to each
    other. An empty table gives no rows.
    """
    name = next(n for i in range(len(docs.columns) + 1) if (n := "_gone" + "_" * i) not in docs.columns)
    gone = repeated_chunks(docs, id_col, text_col, least_lines).withColumnRenamed("_gone", name)
    keyed = docs.join(gone, (docs[id_col] == gone["_doc"]) & (F.xxhash64(docs[text_col].cast("string")) == gone["_text"]), "left")
    of_all = F.transform(
        F.array(line_chunks(docs[text_col])),
        lambda c: F.struct(
            F.array_join(F.transform(F.filter(c, lambda x: ~F.array_contains(F.col(name), x["pos"])), lambda x: x["body"]), "\n").alias("text"),
            F.aggregate(F.filter(c, lambda x: F.array_contains(F.col(name), x["pos"])), F.lit(0), lambda a, x: a + x["n_lines"]).alias("n"),
        ),
    )[0]
    cut = F.when(F.col(name).isNotNull(), of_all)
    text = F.when(F.col(name).isNull(), docs[text_col]).otherwise(cut["text"])
    columns = [text.alias(c) if c == text_col else docs[c] for c in docs.columns]
    if counts:
        total = F.coalesce(F.size(F.split(docs[text_col], "\n", -1)), F.lit(0))
        columns += [F.when(docs[text_col].isNull(), 0).otherwise(total).cast("long").alias("n_lines"), F.coalesce(cut["n"], F.lit(0)).cast("long").alias("n_removed")]
    return keyed.select(*columns)


ORACLE = r"""
WITH split AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL),
hashed AS (
  SELECT doc_id, text, lines, list_transform(lines, lambda l: CAST('0x' || substr(md5(l), 1, 8) AS BIGINT)) AS h FROM split),
valued AS (
  SELECT doc_id, text, lines, list_transform(range(1, len(lines) + 1), lambda i: ((CASE WHEN i > 1 THEN h[i - 1] ELSE 0 END % 1000003) * 31 + h[i]) % 1000003) AS v
  FROM hashed),
ends AS (
  SELECT doc_id, text, lines, list_filter(range(0, len(lines)), lambda i: i = 0 OR (i >= 2 AND i <= len(lines) - 2 AND v[i] < v[i - 1] AND v[i] < v[i + 1])) AS e
  FROM valued),
starts AS (
  SELECT doc_id, text, lines, flatten(list_transform(range(1, len(e) + 1), lambda k: range(e[k], greatest(e[k], coalesce(e[k + 1], len(lines)) - 2) + 1, 6))) AS s
  FROM ends),
chunks AS (
  SELECT doc_id, k - 1 AS pos, coalesce(s[k + 1], len(lines)) - s[k] AS n_lines,
         array_to_string(lines[s[k] + 1 : coalesce(s[k + 1], len(lines))], chr(10)) AS body
  FROM (SELECT *, unnest(range(1, len(s) + 1)) AS k FROM starts)),
judged AS (
  SELECT *, n_lines >= 2 AND row_number() OVER (PARTITION BY body, n_lines >= 2 ORDER BY doc_id, pos) > 1 AS gone FROM chunks)
SELECT doc_id, CAST(sum(n_lines) AS BIGINT) AS n_lines,
       CAST(coalesce(sum(n_lines) FILTER (WHERE gone), 0) AS BIGINT) AS n_removed,
       sha256(coalesce(string_agg(body, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
UNION ALL SELECT doc_id, 0, 0, NULL FROM documents WHERE text IS NULL
"""
