"""License scan by diagonal voting over word k-grams.

Templates are word sequences: the three phrases that must be found wherever they stand, and the notices of
common licenses. All rolling k-grams of a document are hashed and joined to the places where templates have them; every
match votes for the diagonal document place - template place. Diagonals with the votes of a whole template are
spans as they are; for notices, a diagonal is merged with its NEAR next ones (a word or two more or less), and a span
counts if the template words that stand within NEAR of their places reach the share MATCH. The table of template k-grams is a constant, bounded by MAX_GRAMS.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

K = 2
MATCH = 0.8
NEAR = 2
MAX_GRAMS = 10_000
MARK = "\n"
WORD_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    """`exact` templates count at each place; the others are notices that may differ by a few words."""

    label: str
    text: str
    exact: bool = False


# fixed values: phrases and labels, then wordings of license notices
PHRASES = (
    Template("mit", "mit license", True),
    Template("apache", "apache license", True),
    Template("gpl", "general public license", True),
)
NOTICES = (
    Template("apache-2.0", "licensed under the apache license version 2 0"),
    Template("gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    Template("mit-notice", "released under the mit license"),
    Template("mit-notice", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    Template("cc-by-nc-4.0", "licensed under cc by nc 4 0"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
)


def words_of(text: Column) -> Column:
    """Words of a text for matching. Only ASCII letters may be folded to ASCII, so the one other character whose
    lower case is an ASCII letter (the Kelvin sign) is first replaced by another word character."""
    folded = F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("K"), F.lit("ĸ")))
    return F.split(F.regexp_replace(folded, "^" + WORD_GAP + "|" + WORD_GAP + "$", ""), WORD_GAP)


def template_grams(spark: SparkSession, templates: tuple[Template, ...]) -> DataFrame:
    """(h, gram, t, q): each k-gram of template t at its place q, with its hash. Template -1 marks each document once."""
    rows = [(MARK, -1, 0)]
    for t, made in enumerate(templates):
        words = made.text.split(" ")
        if len(words) < K:
            raise ValueError("a template needs at least %d words" % K)
        rows += [(" ".join(words[q : q + K]), t, q) for q in range(len(words) - K + 1)]
    if len(rows) > MAX_GRAMS:
        raise ValueError("more than %d template k-grams" % MAX_GRAMS)
    return spark.createDataFrame(rows, "gram string, t int, q int").select(F.xxhash64("gram").alias("h"), "gram", "t", "q")


def votes(docs: DataFrame, templates: tuple[Template, ...]) -> DataFrame:
    """doc_id, _text (hash of the text), n_words, t, d, q and copies: one row for each template place q of a document that
    the diagonal d = place in the document - q meets, and one with t = -1 for each document."""
    # a generator keeps the words as a value; merged projections would split the text again at every use
    words = docs.select("doc_id", F.xxhash64("text").alias("_text"), F.explode(F.array(words_of(F.col("text")))).alias("_w"))
    n_words = F.when((F.size("_w") == 1) & (F.col("_w")[0] == ""), 0).otherwise(F.size("_w")).cast("bigint")
    pairs = F.greatest(F.size("_w") - 1, F.lit(0))
    grams = F.zip_with(F.slice("_w", 1, pairs), F.slice("_w", F.lit(2), pairs), lambda a, b: F.concat_ws(" ", a, b))
    rolling = words.select("doc_id", "_text", n_words.alias("n_words"), F.posexplode(F.concat(grams, F.array(F.lit(MARK)))).alias("p", "gram"))
    table = F.broadcast(template_grams(docs.sparkSession, templates).withColumnRenamed("gram", "_gram"))
    met = rolling.join(table, (F.xxhash64("gram") == F.col("h")) & (F.col("gram") == F.col("_gram")))
    d = F.when(F.col("t") < 0, 0).otherwise(F.col("p") - F.col("q")).cast("bigint").alias("d")
    met = met.select("doc_id", "_text", "n_words", "t", d, "q")
    return met.groupBy("doc_id", "_text", "n_words", "t", "d", "q").agg(F.count("*").alias("copies"))


def scan_licenses(docs: DataFrame, templates: tuple[Template, ...] = PHRASES + NOTICES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of every row.

    Null and empty texts have no words. Labels are empty strings and places null where nothing is found;
    score is the largest share of a template that stands in the document. Equal rows give equal results, each
    once for each row.
    """
    sizes = F.array(*[F.lit(len(t.text.split(" "))) for t in templates])
    names = F.array(*[F.lit(t.label) for t in templates])
    strict = F.array(*[F.lit(t.exact) for t in templates])
    of = lambda table: F.get(table, F.col("t"))
    key = ["doc_id", "_text", "n_words"]
    diagonals = votes(docs, templates).groupBy(*key, "t", "d").agg(F.collect_list("q").alias("qs"), F.max("copies").alias("copies"))
    # every diagonal with the next NEAR ones, not a chain of neighbours: all words of a span stand within NEAR of their places
    beside = Window.partitionBy(*key, "t").orderBy("d").rangeBetween(0, NEAR)
    near = F.flatten(F.collect_list("qs").over(beside))
    spans = diagonals.withColumn("_near", near).withColumn("qs", F.when(F.coalesce(of(strict), F.lit(True)), F.col("qs")).otherwise(F.array_distinct("_near")))
    covered = F.size(F.array_distinct(F.concat("qs", F.transform("qs", lambda q: q + (K - 1)))))
    share = F.when(F.col("t") >= 0, covered / of(sizes)).otherwise(0.0)
    spans = spans.select(*key, "t", "d", "copies", share.alias("share"), (F.size("qs") == of(sizes) - K + 1).alias("_full"))
    place = F.when(of(strict) & F.col("_full"), F.col("d"))
    base = F.when(of(strict) & F.col("_full"), of(names))
    named = F.when(F.when(of(strict), F.col("_full")).otherwise(F.col("share") >= MATCH), of(names))
    score = F.when(~of(strict) | F.col("_full"), F.col("share")).otherwise(0.0)
    out = spans.groupBy(*key).agg(
        F.max(F.when(F.col("t") < 0, F.col("copies"))).alias("_copies"),
        F.count(place).alias("n_base"), F.min(place).alias("first_word"), F.max(place).alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(base)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set(named)), ",").alias("labels"),
        F.coalesce(F.max(score), F.lit(0.0)).alias("score"),
    )
    out = out.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def scan_sql(templates: tuple[Template, ...] = PHRASES + NOTICES) -> str:
    """The scan of `documents` in SQL, for checks."""
    rows = ", ".join(f"({i}, '{t.label}', {str(t.exact).lower()}, '{t.text}')" for i, t in enumerate(templates))
    return rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
t AS (SELECT t, label, exact, string_split(txt, ' ') AS tw, len(string_split(txt, ' ')) AS n FROM (VALUES {rows}) v(t, label, exact, txt)),
tg AS (SELECT t, q, tw[q + 1] || ' ' || tw[q + 2] AS gram FROM (SELECT t, tw, unnest(range(0, n - 1)) AS q FROM t)),
g AS (SELECT doc_id, p - 1 AS p, ws[p] || ' ' || ws[p + 1] AS gram FROM (SELECT doc_id, ws, unnest(range(1, len(ws))) AS p FROM w)),
m AS (SELECT doc_id, t, p - q AS d, q FROM g JOIN tg USING (gram)),
s AS (SELECT DISTINCT doc_id, t, d, d + CASE WHEN exact THEN 0 ELSE {NEAR} END AS far FROM m JOIN t USING (t)),
c AS (SELECT doc_id, t, d, count(DISTINCT q) AS dq, count(DISTINCT x) AS covered FROM (
  SELECT s.doc_id, s.t, s.d, q, unnest([q, q + 1]) AS x FROM s JOIN m ON m.doc_id = s.doc_id AND m.t = s.t AND m.d BETWEEN s.d AND s.far) GROUP BY 1, 2, 3),
f AS (SELECT c.*, label, exact, covered / n AS share, dq = n - 1 AS whole FROM c JOIN t USING (t)),
r AS (SELECT doc_id, count(*) FILTER (exact AND whole) AS n_base, min(d) FILTER (exact AND whole) AS first_word, max(d) FILTER (exact AND whole) AS last_word,
  string_agg(DISTINCT label, ',' ORDER BY label) FILTER (exact AND whole) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (CASE WHEN exact THEN whole ELSE share >= {MATCH} END) AS labels,
  max(CASE WHEN NOT exact OR whole THEN share ELSE 0 END) AS score FROM f GROUP BY 1)
SELECT doc_id, len(ws) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
FROM w LEFT JOIN r USING (doc_id)
"""
