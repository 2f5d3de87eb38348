"""License scans as an exact set-similarity join of text blocks with license templates.

Blocks are windows of words, over line ends: ``step`` words apart and twice as long, where ``step`` is the
longest stretch a template may take (its number of words and a quarter more), so that every such stretch
lies within one block. A template matches a text if some stretch of that length holds at least ``threshold``
of its distinct words, and all words that set it apart. Words are ordered by how often the corpus has them,
rarest first. A block with a match must hold a word of the template's prefix (its rarest words, so many that
the rest is too short to reach the threshold), have at least the required number of template words (length
filter), and have enough words left from the shared one on, on both sides (positional filter); of what
remains, every stretch is counted. All of it runs as DataFrame expressions within a document's row; only
matches are shuffled. The template table is a constant of the library, a few hundred rows once exploded, and
that bounds what is broadcast and what comes to the driver (the frequencies of its words).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from signalspark.llm.common import ascii_lower, store

#: Characters that separate words, once A-Z are lower-cased.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Phrases and labels of the base scan.
PHRASES = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]

#: Label, wording of public license notices as lower-case words, and the words that a match must hold.
TEMPLATES = [
    ("mit", "released under the mit license", "mit"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ""),
    ("apache", "licensed under the apache license version 2 0", "apache"),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied", ""),
    ("gpl", "this work is licensed under the gnu general public license version 3", "gnu general"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gnu general"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license", "gnu lesser"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ""),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", ""),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc nc"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license", "noncommercial"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", "attribution"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla"),
]


def _spaces(part: Column) -> Column:
    return (F.char_length(part) - F.char_length(F.replace(part, F.lit(" "), F.lit("")))).cast("long")


def _base(words: str, n_words: str) -> list[Column]:
    """n_base, first_word, last_word and found labels from an array of words; null and empty where no phrase is."""
    padded = F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
    counts, firsts, lasts, labels = [], [], [], []
    for phrase, label in PHRASES:
        here = F.contains(padded, F.lit(f" {phrase} "))
        parts = F.split(padded, f" {phrase}(?= )", -1)
        size = len(phrase.split())
        counts.append(F.when(here, F.size(parts) - 1).otherwise(0).cast("long"))
        firsts.append(F.when(here, _spaces(F.element_at(parts, 1))))
        lasts.append(F.when(here, F.col(n_words) - (_spaces(F.element_at(parts, -1)) - 1) - size))
        labels.append(F.when(here, F.lit(label)))
    found = F.array_compact(F.array(*labels))
    return [sum(counts[1:], counts[0]).alias("n_base"), F.least(*firsts).alias("first_word"), F.greatest(*lasts).alias("last_word"), found.alias("found")]


def _need(words: set[str], threshold: float) -> int:
    """The least number of words that reaches the threshold, kept clear of rounding."""
    return max(1, math.ceil(len(words) * threshold - 1e-9))


def _stretch(text: str) -> int:
    """How many words in a row a template may take: its own number and a quarter more."""
    n = len(text.split())
    return n + n // 4


def _literal(words: list[str]) -> Column:
    return F.array(*map(F.lit, words)).cast("array<string>")


def global_order(table: list[tuple[str, str, str]], frequency: dict[str, int]) -> list[str]:
    """All template words, the rarest of the corpus first."""
    return sorted({w for _, text, _ in table for w in text.split()}, key=lambda w: (frequency.get(w, 0), w))


def prefix_rows(table: list[tuple[str, str, str]], threshold: float, order: list[str]) -> list[tuple]:
    """(token, at, need, template) for every word in the prefix of each template."""
    rank = {w: i for i, w in enumerate(order)}
    out = []
    for template in table:
        words = sorted(set(template[1].split()), key=rank.get)
        need = _need(set(words), threshold)
        out += [(w, at, need, template) for at, w in enumerate(words[: len(words) - need + 1])]
    return out


def _prefix_table(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    structs = [
        F.struct(
            F.lit(token).alias("token"),
            F.lit(at).alias("at"),
            F.lit(need).alias("need"),
            F.lit(label).alias("label"),
            F.lit(len(set(text.split()))).alias("size"),
            F.lit(_stretch(text)).alias("stretch"),
            _literal(sorted(set(text.split()))).alias("tokens"),
            _literal(must.split()).alias("must"),
        )
        for token, at, need, (label, text, must) in rows
    ]
    return spark.range(1).select(F.inline(F.array(*structs)))


def match_blocks(blocks: DataFrame, keys: list[str], table: list[tuple[str, str, str]], threshold: float, order: list[str]) -> DataFrame:
    """Blocks (keys, block: an array of words) -> (keys, label, containment), one row per label and key.

    The three filters run on the block's distinct template words in ``order``; what passes is counted
    stretch by stretch."""
    prefix = _prefix_table(blocks.sparkSession, prefix_rows(table, threshold, order))
    ordered = blocks.withColumn("words", F.array_intersect(_literal(order), "block"))
    places = ordered.select(*keys, "block", "words", F.posexplode("words").alias("place", "token"))
    near = places.join(F.broadcast(prefix), "token").where(F.size("words") >= F.col("need"))
    near = near.where(F.least(F.size("words") - F.col("place"), F.col("size") - F.col("at")) >= F.col("need"))

    def held(start: Column) -> Column:
        part = F.slice("block", start, F.col("stretch"))
        return F.when(F.size(F.array_except("must", part)) == 0, F.size(F.array_intersect(part, "tokens"))).otherwise(0)

    overlap = F.array_max(F.transform(F.sequence(F.lit(1), F.size("block")), held))
    near = near.withColumn("overlap", overlap).where("overlap >= need")
    return near.groupBy(*keys, "label").agg(F.max(F.col("overlap") / F.col("size")).alias("containment"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", table: list[tuple[str, str, str]] | None = None, threshold: float = 0.8) -> DataFrame:
    """One row per input row: (doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score).

    base_labels: the phrases found in the text's words, over line ends; labels: those and the labels of all
    templates that some stretch of words matches, over line ends too. score is 1 with a base label, else the
    largest containment of a match, else 0. Null texts are empty: no words, null places, empty labels. A very
    long text is scanned whole, block by block. Of templates with equal containment all labels stay. Repeated
    rows each give a row, told apart by their place in the stored table, not by id. No rows: no result rows.
    Further columns are ignored, whatever their names."""
    table = TEMPLATES if table is None else table
    vocabulary = sorted({w for _, text, _ in table for w in text.split()})
    step = max(_stretch(text) for _, text, _ in table)
    split = F.array_remove(F.split(ascii_lower(F.coalesce(F.col(text_col), F.lit(""))), BETWEEN), "")
    counts = docs.select(F.explode(split).alias("token")).where(F.col("token").isin(vocabulary)).groupBy("token").count()
    order = global_order(table, {r["token"]: r["count"] for r in counts.collect()})
    prefix = _literal(sorted({r[0] for r in prefix_rows(table, threshold, order)}))

    rows = docs.select(F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("row"), split.alias("words"))
    rows = rows.withColumn("n_words", F.size("words").cast("long"))
    last = F.floor(F.greatest(F.size("words") - 1, F.lit(0)) / step).cast("int")
    cut_up = F.transform(F.sequence(F.lit(0), last), lambda b: F.slice("words", b * step + 1, 2 * step))
    blocks = F.when(F.arrays_overlap("words", prefix), F.filter(cut_up, lambda block: F.arrays_overlap(block, prefix)))
    rows = store(rows.select("doc_id", "row", "n_words", *_base("words", "n_words"), blocks.alias("blocks")))

    blocks = rows.where("blocks is not null").select("row", F.explode("blocks").alias("block"))
    found = match_blocks(blocks, ["row"], table, threshold, order).groupBy("row")
    found = found.agg(F.collect_set("label").alias("more"), F.max("containment").alias("containment"))
    whole = rows.drop("blocks").join(found, "row", "left")
    labels = F.array_sort(F.array_distinct(F.concat("found", F.coalesce("more", F.array().cast("array<string>")))))
    score = F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("containment", F.lit(0.0)))
    return whole.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join(F.array_sort("found"), ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        score.cast("double").alias("score"),
    )


def oracle_sql(table: list[tuple[str, str, str]] | None = None, threshold: float = 0.8) -> str:
    """op9 for DuckDB: every stretch that begins with a template word against its template."""
    table = TEMPLATES if table is None else table
    templates = ", ".join(f"({i}, '{label}', {len(set(text.split()))}, {_stretch(text)}, {len(must.split())})" for i, (label, text, must) in enumerate(table))
    tokens = ", ".join(f"({i}, '{w}', {w in must.split()})" for i, (_, text, must) in enumerate(table) for w in sorted(set(text.split())))
    base = " UNION ALL ".join(
        f"SELECT doc_id, '{label}' AS label, UNNEST(list_filter(range(len(words)), lambda i: {' AND '.join(f'words[i + {k + 1}] = {w!r}' for k, w in enumerate(phrase.split()))})) AS pos FROM w"
        for phrase, label in PHRASES
    )
    return f"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
b AS ({base}),
g AS (SELECT doc_id, COUNT(*) AS n, MIN(pos) AS first_at, MAX(pos) AS last_at, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM b GROUP BY doc_id),
tpl(id, label, size, stretch, n_must) AS (VALUES {templates}),
tok(id, word, must) AS (VALUES {tokens}),
p AS (SELECT doc_id, UNNEST(words) AS word, UNNEST(range(len(words))) AS pos FROM w),
h AS (SELECT doc_id, tok.id, pos, word, CASE WHEN must THEN word END AS must_word, stretch - 1 AS reach FROM p JOIN tok USING (word) JOIN tpl ON tpl.id = tok.id),
m AS (SELECT doc_id, id, COUNT(DISTINCT word) OVER r AS hit, COUNT(DISTINCT must_word) OVER r AS hit_must FROM h
  WINDOW r AS (PARTITION BY doc_id, id ORDER BY pos RANGE BETWEEN CURRENT ROW AND reach FOLLOWING)),
f AS (SELECT doc_id, label, MAX(hit / size) AS share FROM m JOIN tpl USING (id) WHERE hit >= size * {threshold} - 1e-9 AND hit_must = n_must GROUP BY doc_id, label),
every AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM f UNION ALL SELECT doc_id, label FROM b) GROUP BY doc_id),
s AS (SELECT doc_id, MAX(share) AS share FROM f GROUP BY doc_id)
SELECT w.doc_id, len(words)::BIGINT AS n_words, COALESCE(g.n, 0)::BIGINT AS n_base, g.first_at::BIGINT AS first_word, g.last_at::BIGINT AS last_word,
  COALESCE(g.labels, '') AS base_labels, COALESCE(every.labels, '') AS labels, CASE WHEN g.n > 0 THEN 1.0 ELSE COALESCE(s.share, 0.0) END::DOUBLE AS score
FROM w LEFT JOIN g USING (doc_id) LEFT JOIN every USING (doc_id) LEFT JOIN s USING (doc_id)
"""
