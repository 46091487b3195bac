"""Scores of texts under a subword model that sums all segmentations, beside a smoothed word model.

The vocabulary and the first weights of its pieces are given; the pieces' probabilities are re-estimated on the training
documents by expectation-maximisation over the table of their words, so that the model's cost in training grows with the
distinct words. A text's probability is that of its words, each marginalised over all segmentations, and of one end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, slices, stored
from .lattice import Lattice, Words, WordScores, load_pieces, texts_of
from .shingles import word_hashes

#: Most words whose counts are broadcast; the counts of all others are joined.
FREQUENT = 1 << 18
ROUNDS = 2
SMOOTHING = 0.1


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) of the distinct words of `text` (binary), A-Z in lower case."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        for batch in batches:
            for part in slices(batch, "text"):
                words = Words([t.lower() for t in texts_of(part, "text")])
                yield [[words.word(i) for i in range(len(words.hashes))], words.counts]

    return in_arrow(docs.select("text"), run, "word binary, n long", [pa.binary(), pa.int64()]).groupBy("word").agg(F.sum("n").alias("n"))


def fit_pieces(counts: DataFrame, ends: int, pieces: list[str], logs: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Log probabilities of the pieces (the end piece among them) after some rounds over all words.

    What reaches the driver is one number for each piece of the vocabulary.
    """
    given = counts.sparkSession.sparkContext.broadcast({"pieces": pieces})
    end = pieces.index("</s>")
    for _ in range(rounds):

        def run(batches: Iterator[pa.RecordBatch], logs: np.ndarray = logs) -> Iterator[list]:
            state = given.value
            lattice = state["lattice"] = state.get("lattice") or Lattice(state["pieces"])
            total = np.zeros(lattice.size)
            for batch in batches:
                words = [w.decode("utf-8", "replace") for w in batch.column("word").to_pylist()]
                total += lattice.expected(words, np.array(batch.column("n").to_pylist(), float), logs)
            used = np.flatnonzero(total)
            yield [used, total[used]]

        sums = in_arrow(counts.select("word", "n"), run, "piece long, uses double", [pa.int64(), pa.float64()])
        uses = np.full(len(pieces), SMOOTHING)
        for piece, n in sums.groupBy("piece").agg(F.sum("uses")).collect():
            uses[piece] += n
        uses[end] += ends
        logs = np.log(uses / uses.sum())
    return logs


def frequent_words(counts: DataFrame, most: int = FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, in order, and counts of the words above the lowest of some fixed count levels that `most` words pass."""
    level = F.floor(F.log2("n") * 8).cast("int")
    sizes = sorted(counts.groupBy(level.alias("level")).count().collect(), reverse=True)
    lowest, total = None, 0
    for row in sizes:
        total += row["count"]
        if total > most:
            break
        lowest = row["level"]
    if lowest is None:
        return np.zeros(0, np.uint64), np.zeros(0)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        for batch in batches:
            words = batch.column("word").to_pylist()
            yield [[int(word_hashes(w)[0].view(np.int64)[0]) for w in words], batch.column("n")]

    frequent = in_arrow(counts.where(level >= lowest).select("word", "n"), hashed, "hash long, n long", [pa.int64(), pa.int64()]).toArrow()  # `most` rows at most
    hashes = frequent.column("hash").to_numpy().view(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], frequent.column("n").to_numpy()[order].astype(float)


def score_documents(docs: DataFrame, path: str, held_out_of: int = 7, held_out: int = 2, rounds: int = ROUNDS) -> DataFrame:
    """Word and subword log10 probabilities of every text, learnt from the documents that are not held out.

    A null text counts as empty and has one token, its end; a null id counts as the empty string in the split. Repeated
    rows count and are scored one by one. Characters outside the vocabulary are spelt in bytes. Without training rows
    every word is unknown and the pieces keep their given weights. Other columns are not read.
    """
    pieces, first = load_pieces(path)
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.crc32(key) % held_out_of == held_out).alias("held_out"),
        F.coalesce("text", F.lit("")).cast("binary").alias("text"),
    )

    train = rows.where(~F.col("held_out"))
    counts = stored(word_counts(train), "word-counts")
    ends = train.count()
    known = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    train_tokens, distinct = known["n"] + ends, known["v"] + (ends > 0)
    logs = fit_pieces(counts, ends, pieces, first, rounds) if ends else first
    hashes, often = frequent_words(counts)
    below = np.log10(train_tokens + distinct + 1.0)
    shared = docs.sparkSession.sparkContext.broadcast({"pieces": pieces, "logs": logs, "hashes": hashes, "base": np.log10(often + 1.0) - below})
    end_base, end_score = float(np.log10(ends + 1.0) - below), float(logs[pieces.index("</s>")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        state = shared.value
        scores = state["scores"] = state.get("scores") or WordScores(state["pieces"], state["logs"][:, None])
        hashes, base = state["hashes"], state["base"]
        place = TaskContext.get().partitionId() << 36
        for batch in batches:
            for part in slices(batch, "text"):
                n = part.num_rows
                words = Words([t.lower() for t in texts_of(part, "text")])
                at = np.minimum(np.searchsorted(hashes, words.hashes), max(0, len(hashes) - 1))
                found = hashes[at] == words.hashes if len(hashes) else np.zeros(len(words.hashes), bool)
                value = np.where(found, base[at] if len(base) else 0.0, 0.0)
                uid = np.arange(place, place + n)
                place += n
                whole = [
                    uid, part.column("doc_id"), part.column("held_out"), words.lengths + 1, words.per_text(found.astype(float)).astype(np.int64) + (ends > 0),
                    words.per_text(value) + end_base, (words.per_text(scores.of(words)[:, 0]) + end_score) / np.log(10),
                ]
                yield [*whole, pa.nulls(n, pa.binary()), pa.nulls(n, pa.int64())]
                rare = ~found[words.which]
                if rare.any():
                    pairs, times = np.unique(words.owner[rare] * len(words.hashes) + words.which[rare], return_counts=True)
                    which = pairs % len(words.hashes)
                    text = {i: words.word(i) for i in np.unique(which).tolist()}
                    none = [pa.nulls(len(pairs), t) for t in kinds[1:7]]
                    yield [uid[pairs // len(words.hashes)], *none, [text[i] for i in which.tolist()], times]

    kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.int64()]
    schema = "uid long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, word binary, times long"
    scored = stored(in_arrow(rows, run, schema, kinds), "scored")
    rare = scored.where("word IS NOT NULL").select("uid", "word", "times").join(counts, "word", "left")
    n = F.coalesce("n", F.lit(0))
    rare = rare.groupBy("uid").agg(
        F.sum(F.col("times") * (F.log10(n + 1.0) - F.lit(float(below)))).alias("rare_base"), F.sum(F.when(n > 0, F.col("times")).otherwise(0)).alias("rare_known")
    )
    zero = F.lit(0)
    return scored.where("word IS NULL").join(rare, "uid", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("rare_known", zero)).alias("n_known"), F.lit(int(train_tokens)).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("rare_base", zero)).alias("base_score"), "score",
    )
