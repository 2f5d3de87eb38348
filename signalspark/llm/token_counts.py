"""Token counts from pieces per distinct pre-token.

SentencePiece BPE never merges across the start of a run of spaces (no piece has a space after another
character) nor at a line feed (no piece has one at all), so a text falls into pre-tokens that are encoded
independently. Each distinct pre-token of the corpus is encoded once; its number of pieces is joined to the
per-document frequencies and summed. The ``hot_words`` most frequent pre-tokens, a table of bounded size, are
joined inside the task that reads the document; the others by a shuffle.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalspark.llm.common import cut, most_frequent

FLUSH = 250_000  # distinct pre-tokens that a task holds before it passes them on
LONE = " \n"
RUNS = re.compile(r" +[^ ]*|[^ ]+")


def pre_tokens(text: str) -> list[str]:
    """Keys of the pre-tokens of a text. A key is what to encode, less the space that the encoder puts before it;
    one that starts with a line feed stands without that space, and a lone space has the key LONE."""
    out: list[str] = []
    if not text:
        return out
    text = text.replace("▁", " ")
    for k, line in enumerate(text.split("\n")):
        if k == 0:
            line = " " + line  # the encoder's own
            if line == " ":
                out.append(LONE)
                continue
        if "  " not in line and line[-1:] != " ":
            first, *rest = line.split(" ")
            if k:
                out.append("\n" + first)
            out += rest
        else:
            found = RUNS.findall(line)
            if k:
                out.append("\n" + (found.pop(0) if found and found[0][0] != " " else ""))
            for run in found:
                out.append(run[1:] or LONE)
    return out


def piece_counts(keys: list[str], encoder) -> list[int]:
    """Number of pieces of each key."""
    encoded = encoder.encode(keys, num_threads=1)
    # Before a line feed the encoder puts a space that the text has not; a lone space is one piece.
    return [1 if k == LONE else len(e) - (k[0] == "\n") for k, e in zip(keys, encoded, strict=True)]


def _encoder(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def vocabulary(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(token, n): every pre-token of all texts with its frequency."""

    def run(batches):
        table: Counter = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(table), pa.string()), pa.array(list(table.values()), pa.int64())], ["token", "n"])

        for b in batches:
            for t in b.column(0).to_pylist():
                table.update(pre_tokens(t))
                if len(table) > FLUSH:
                    yield out()
                    table.clear()
        yield out()

    rows = docs.select(F.col(text_col).cast("string").alias("text")).where("text <> ''")
    return rows.mapInArrow(run, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))


def count_tokens(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096, hot_words: int = 1 << 17) -> DataFrame:
    """One row per input row: (doc_id, n_bytes, n_tokens, over_limit).

    Null and empty texts have no bytes and no tokens. ``model_path`` is read by the tasks and must be there on
    every machine. Repeated rows each give a row, as rows are told apart by their place in the input, not by
    id. No rows: no result rows. Further columns are ignored."""

    def pieces(batches):
        encoder = _encoder(model_path)
        for b in batches:
            counts = piece_counts(b.column(0).to_pylist(), encoder) if b.num_rows else []
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(counts, pa.int64())], ["token", "n", "pieces"])

    known = cut(vocabulary(docs, text_col).mapInArrow(pieces, "token string, n long, pieces long"))
    top = most_frequent(known, F.col("n"), hot_words)
    hot = docs.sparkSession.sparkContext.broadcast({r["token"]: r["pieces"] for r in top.select("token", "pieces").toLocalIterator()})

    def frequencies(batches):
        """A row per document with the pieces of its hot pre-tokens, then one per rare pre-token."""
        here = hot.value
        for b in batches:
            ids, rows, size, sums, tokens, ns = [], [], [], [], [], []
            for i, r, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                counts, done = Counter(pre_tokens(t)) if t else {}, 0
                for token, n in counts.items():
                    p = here.get(token)
                    if p is not None:
                        done += p * n
                    else:
                        rows.append(r)
                        ids.append(i)
                        size.append(None)
                        sums.append(None)
                        tokens.append(token)
                        ns.append(n)
                rows.append(r)
                ids.append(i)
                size.append(len(t.encode()) if t else 0)
                sums.append(done)
                tokens.append(f"\n\n{r}")  # no key; spreads these rows over the join
                ns.append(None)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(rows, pa.int64()), pa.array(size, pa.int64()), pa.array(sums, pa.int64()), pa.array(tokens, pa.string()), pa.array(ns, pa.int64())],
                ["doc_id", "row", "n_bytes", "hot", "token", "n"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.col(text_col).cast("string").alias("text"))
    found = rows.mapInArrow(frequencies, "doc_id long, row long, n_bytes long, hot long, token string, n long")
    joined = found.join(known.select("token", "pieces"), "token", "left").groupBy("row")
    total = F.sum(F.coalesce("hot", F.col("n") * F.col("pieces")))
    out = joined.agg(F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"), total.alias("n_tokens"))
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
