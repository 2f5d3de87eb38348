"""Language identification: word scores first, character n-grams for unseen words.

A word that the training rows hold scores its smoothed log frequency in each language. An unseen word backs off to
its character n-grams, longest first: it takes the longest order of which the model knows one of its n-grams
and scores their mean log frequency there (a penalty for the orders passed over would be the same in every
language). A text's score in a language is the sum over its words and the language's log share of documents.

The model is two tables, of all words and of all n-grams of the training rows; nothing is cut off. Every distinct word
of the texts to predict is scored once and joined to the frequencies of each text. The
``hot_words`` most frequent ones, a table of bounded size, are joined inside the task that reads the text; the others
by a shuffle. Texts are told by digest, so that copies share one result.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalspark.llm.common import most_frequent, salted_join, store

#: Runs of letters, by Unicode category, and of marks that follow them.
LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*")
PLAIN = re.compile(r"[a-z]+")
ORDERS = (4, 3, 2, 1)
FLUSH = 200_000  # distinct entries that a task holds before it passes them on


def words(text: str) -> list[str]:
    """Runs of letters, lower-cased."""
    low = text.lower()
    return (PLAIN if low.isascii() else LETTERS).findall(low)


def _word_counts(rows: DataFrame, langs: list[str]) -> DataFrame:
    """(lang, text) -> (word, n), n an array of counts in the order of ``langs``, then that of rows without language."""
    at = {lang: i for i, lang in enumerate([*langs, None])}

    def run(batches):
        table: dict[int, Counter] = defaultdict(Counter)

        def out():
            for lang, counts in table.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(counts), pa.int32()), pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["lang", "word", "n"])
            table.clear()

        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                table[at[lang]].update(words(text))
                if sum(map(len, table.values())) > FLUSH:
                    yield from out()
        yield from out()

    counts = rows.mapInArrow(run, "lang int, word string, n long")
    return counts.groupBy("word").agg(F.array(*(F.sum(F.when(F.col("lang") == i, F.col("n")).otherwise(0)) for i in range(len(at)))).alias("n"))


def cut_up(word: str, order: int) -> list[str]:
    """n-grams of a word, with marks at its ends."""
    marked = f"\x02{word}\x03"
    return [marked[k : k + order] for k in range(len(marked) - order + 1)]


def _gram_counts(counts: DataFrame, n_langs: int) -> DataFrame:
    """(word, n) -> (order, gram, n). A task adds up the n-grams of its words before it passes them on."""

    def run(batches):
        tables: list[dict] = [defaultdict(int) for _ in range(n_langs)]

        def out():
            for lang, table in enumerate(tables):
                cols = [pa.array(map(len, table), pa.int32()), pa.array(list(table), pa.string()), pa.array([lang] * len(table), pa.int32()), pa.array(list(table.values()), pa.int64())]
                table.clear()
                yield pa.RecordBatch.from_arrays(cols, ["order", "gram", "lang", "n"])

        for b in batches:
            for word, counts in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                pieces = None
                for table, n in zip(tables, counts, strict=False):
                    if n:
                        pieces = pieces or [g for order in ORDERS for g in cut_up(word, order)]
                        for g in pieces:
                            table[g] += n
            if sum(map(len, tables)) > FLUSH:
                yield from out()
        yield from out()

    rows = counts.select("word", "n").mapInArrow(run, "order int, gram string, lang int, n long")
    return rows.groupBy("order", "gram").agg(F.array(*(F.sum(F.when(F.col("lang") == i, F.col("n")).otherwise(0)) for i in range(n_langs))).alias("n"))


def _logs(table: DataFrame, n_langs: int) -> DataFrame:
    """(order, n, ...) -> also s: smoothed log frequencies by language, in all that is counted of that order."""
    per = range(n_langs)
    totals = table.groupBy("order").agg(*(F.sum(F.col("n")[i]).alias(f"t{i}") for i in per)).collect()
    by_order = [F.create_map(*(F.lit(v) for r in totals for v in (r["order"], float(r[f"t{i}"] + 1)))) for i in per] if totals else []
    s = F.array(*(F.ln(F.col("n")[i] + 1.0) - F.ln(F.element_at(m, F.col("order"))) for i, m in enumerate(by_order)))
    return table.withColumn("s", s.cast("array<double>"))


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", learn: Column | None = None) -> dict:
    """A model from the rows with a text and a language, where ``learn`` holds if it is given: languages, log shares,
    and the tables ``words`` (word, n, s) and ``grams`` (order, gram, n, s), s the log frequencies by language.

    The words of other rows are in ``words`` too, n their frequency and s null where no row that counts has them."""
    lang = F.col(lang_col).cast("string")
    rows = docs.select((lang if learn is None else F.when(learn, lang)).alias("lang"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    shares = {r["lang"]: r["count"] for r in rows.where("lang is not null").groupBy("lang").count().collect()}
    langs = sorted(shares)
    if not langs:
        return {"langs": []}
    size = len(langs)
    counts = store(_word_counts(rows, langs))
    grams = store(_gram_counts(counts, size))
    learned = F.exists(F.slice("n", 1, size), lambda v: v > 0)
    total = F.aggregate("n", F.lit(0).cast("long"), lambda a, v: a + v)
    own = _logs(counts.withColumn("order", F.lit(0)), size)
    prior = np.log(np.array([shares[x] for x in langs], float) / sum(shares.values()))
    return {"langs": langs, "prior": prior, "words": own.select("word", total.alias("n"), F.when(learned, F.col("s")).alias("s")), "grams": _logs(grams, size)}


def _back_off(unseen: DataFrame, grams: DataFrame, n_langs: int, small: int) -> DataFrame:
    """(word) -> (word, mean) for words with a known n-gram. A table of up to ``small`` n-grams goes to all tasks; a
    larger one is joined."""
    if grams.count() <= small:
        table = unseen.sparkSession.sparkContext.broadcast({r["gram"]: r["s"] for r in grams.select("gram", "s").toLocalIterator()})

        def run(batches):
            get = table.value.get
            for b in batches:
                found = []
                for w in b.column(0).to_pylist():
                    for order in ORDERS:
                        s = [v for g in cut_up(w, order) if (v := get(g)) is not None]
                        if s:
                            found.append((w, np.mean(s, axis=0).tolist()))
                            break
                names, means = zip(*found, strict=True) if found else ((), ())
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(means, pa.list_(pa.float64()))], ["word", "mean"])

        return unseen.mapInArrow(run, "word string, mean array<double>")
    near = unseen.mapInArrow(_pieces, "word string, order int, gram string")
    near = salted_join(near, grams.select("order", "gram", "s"), ["order", "gram"], ["word"])
    means = near.groupBy("word", "order").agg(F.array(*(F.avg(F.col("s")[i]) for i in range(n_langs))).alias("mean"))
    return means.groupBy("word").agg(F.max(F.struct("order", "mean"))["mean"].alias("mean"))


def _pieces(batches):
    for b in batches:
        for at in range(0, b.num_rows, 1000):
            rows = [(w, n, g) for w in b.column(0).slice(at, 1000).to_pylist() for n in ORDERS for g in cut_up(w, n)]
            w, n, g = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(w, pa.string()), pa.array(n, pa.int32()), pa.array(g, pa.string())], ["word", "order", "gram"])


def score_words(vocabulary: DataFrame, model: dict, small: int = 1 << 17) -> DataFrame:
    """(word, n, s) of distinct words -> s where it is null: the mean of the log frequencies of the word's n-grams of
    the longest order that has any, or zeros."""
    size = len(model["langs"])
    best = _back_off(vocabulary.where("s is null").select("word"), model["grams"], size, small)
    zeros = F.array(*(F.lit(0.0) for _ in range(size)))
    return vocabulary.join(best, "word", "left").select("word", "n", F.coalesce("s", "mean", zeros).alias("s"))


def vocabulary(texts: DataFrame, model: dict) -> DataFrame:
    """(text) -> (word, n, s) of all words, s as the model has it."""
    counts = _word_counts(texts.select(F.lit(None).cast("string").alias("lang"), "text"), []).select("word", F.col("n")[0].alias("n"))
    return counts.join(model["words"].select("word", "s"), "word", "left")


def score_texts(texts: DataFrame, model: dict, seen: bool, hot_words: int = 1 << 17) -> DataFrame:
    """(digest, text) -> (digest, lang_pred, score), a row per digest; ``seen``: the model has all words of the texts."""
    langs, prior = model["langs"], model["prior"]
    scored = store(score_words(model["words"] if seen else vocabulary(texts, model), model, hot_words))
    hot: dict = {}
    values: list = []
    for r in most_frequent(scored, F.col("n"), hot_words).select("word", "s").toLocalIterator():
        hot[r["word"]] = len(values)
        values.append(r["s"])
    sent = texts.sparkSession.sparkContext.broadcast((hot, np.array(values, float).reshape(-1, len(langs))))

    def frequencies(batches):
        """A row per text with the sums over its hot words, then one per other word."""
        table, matrix = sent.value
        get = table.get
        for b in batches:
            digests, keys, ns, sums, letters = [], [], [], [], []
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                counts = Counter(words(t)) if t else {}
                at, weight = [], []
                for w, n in counts.items():
                    k = get(w)
                    if k is None:
                        digests.append(d)
                        keys.append(w)
                        ns.append(n)
                        sums.append(None)
                        letters.append(None)
                    else:
                        at.append(k)
                        weight.append(n)
                digests.append(d)
                keys.append("\n" + d.hex())  # no word; spreads these rows over the join
                ns.append(None)
                sums.append((np.array(weight, float) @ matrix[at]).tolist() if at else [0.0] * len(langs))
                letters.append(bool(counts))
            cols = [pa.array(digests, pa.binary()), pa.array(keys, pa.string()), pa.array(ns, pa.int64()), pa.array(sums, pa.list_(pa.float64())), pa.array(letters, pa.bool_())]
            yield pa.RecordBatch.from_arrays(cols, ["digest", "word", "times", "hot", "letters"])

    found = texts.mapInArrow(frequencies, "digest binary, word string, times long, hot array<double>, letters boolean")
    found = found.join(scored.select("word", "s"), "word", "left")
    # Copies of a text come as often as there are of them.
    total = [(F.sum(F.coalesce(F.col("hot")[i], F.col("times") * F.col("s")[i])) / F.count("letters") + float(p)).alias(f"t{i}") for i, p in enumerate(prior)]
    sums = found.groupBy("digest").agg(F.max("letters").alias("letters"), *total)
    names = F.array(*map(F.lit, langs))
    values = F.array(*(F.col(f"t{i}") for i in range(len(langs))))
    best = F.array_max(values)
    share = 1.0 / F.aggregate(F.transform(values, lambda v: F.exp(v - best)), F.lit(0.0), lambda a, v: a + v)
    und = ~F.col("letters")
    return sums.select("digest", F.when(und, "und").otherwise(F.get(names, F.array_position(values, best).cast("int") - 1)).alias("lang_pred"), F.when(und, 0.0).otherwise(share).alias("score"))


def predict(docs: DataFrame, model: dict, text_col: str = "text", spread: list[str] | None = None, seen: bool = False, hot_words: int = 1 << 17) -> DataFrame:
    """All columns of ``docs`` with lang_pred and score appended (columns of these names are replaced). Rows with equal
    texts are dealt to several tasks by the columns ``spread``. ``seen``: the model was fitted over these rows, whether
    it learned from them or not, so that it has their words."""
    docs = docs.drop("lang_pred", "score")
    if not model["langs"]:
        return docs.withColumns({"lang_pred": F.lit("und"), "score": F.lit(0.0)})
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.withColumn("digest of text", F.unhex(F.md5(text.cast("binary"))))
    texts = rows.select(F.col("digest of text").alias("digest"), text.alias("text"))
    found = score_texts(texts, model, seen, hot_words).withColumnRenamed("digest", "digest of text")
    return salted_join(rows, found, ["digest of text"], spread or [text_col]).select(*docs.columns, "lang_pred", "score")


def held_out(id_col: str = "doc_id"):
    """Whether a row is kept from training: CRC32 of its id as text, modulo 4, is 2. A null id counts as empty."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", hot_words: int = 1 << 17) -> DataFrame:
    """One row per input row: (doc_id, held_out, lang_pred, score).

    Learns from rows that are not held out and have text and language; predicts all rows from text alone.
    Null texts and texts without letters (Unicode category L) are ``und`` with score 0, as is everything where nothing
    can be learned. Very long texts are read whole. Repeated rows count as often as they come and each give a row.
    Equal scores go to the first language in order. No rows: no result rows; further columns are ignored, whatever
    their names. Rows are told by their text, so a second reading may deliver them in another order."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).withColumn("held_out", held_out())
    model = fit(rows, learn=~F.col("held_out"))
    return predict(rows.select("doc_id", "held_out", "text"), model, "text", ["doc_id"], True, hot_words).select("doc_id", "held_out", "lang_pred", "score")
