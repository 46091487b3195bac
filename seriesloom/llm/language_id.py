"""Language identification by piece probabilities of each language, all segmentations of a word summed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import in_arrow, slices, stored
from .lattice import Lattice, Words, WordScores, load_pieces, texts_of

#: At most about so many labelled documents of each language are learnt from, drawn by a hash of the id.
TRAIN_PER_LANG = 5000
ROUNDS = 2
SMOOTHING = 0.05
UNKNOWN = "und"


def training_rows(docs: DataFrame, held_out_of: int, held_out: int, per_lang: int) -> DataFrame:
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.crc32(key) % held_out_of != held_out))
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # one row for each language
    if not sizes:
        return rows.select("lang", F.col("text").cast("binary").alias("text")).where("false")
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, per_lang / n))])
    draw = F.pmod(F.xxhash64(key, F.lit(6)), F.lit(1 << 30)) / float(1 << 30)
    return rows.where(draw < share[F.col("lang")]).select("lang", F.col("text").cast("binary").alias("text"))


def fit_languages(train: DataFrame, pieces: list[str], first: np.ndarray, rounds: int = ROUNDS) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(languages, log prior, log probability of each piece in each): expectation-maximisation over the words of each language."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            texts = texts_of(batch, "text")
            for lang in set(langs):
                words = Words([t for t, own in zip(texts, langs, strict=True) if own == lang])
                yield [[lang] * len(words.hashes), [words.word(i) for i in range(len(words.hashes))], words.counts]

    words = in_arrow(train, counted, "lang string, word binary, n long", [pa.string(), pa.binary(), pa.int64()])
    words = stored(words.groupBy("lang", "word").agg(F.sum("n").alias("n")), "lang-words")
    sizes = {r["lang"]: r["n"] for r in words.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    langs = sorted(sizes)
    given = train.sparkSession.sparkContext.broadcast({"pieces": pieces})
    logs = np.repeat(first[:, None], len(langs), 1)
    for _ in range(rounds):

        def run(batches: Iterator[pa.RecordBatch], logs: np.ndarray = logs) -> Iterator[list]:
            state = given.value
            lattice = state["lattice"] = state.get("lattice") or Lattice(state["pieces"])
            total = np.zeros((len(langs), lattice.size))
            for batch in batches:
                own = np.array(batch.column("lang").to_pylist())
                text = [w.decode("utf-8", "replace").lower() for w in batch.column("word").to_pylist()]
                n = np.array(batch.column("n").to_pylist(), float)
                for k, lang in enumerate(langs):
                    here = np.flatnonzero(own == lang)
                    if len(here):
                        total[k] += lattice.expected([text[i] for i in here], n[here], logs[:, k])
            lang, piece = np.nonzero(total)
            yield [lang, piece, total[lang, piece]]

        sums = in_arrow(words, run, "lang long, piece long, uses double", [pa.int64(), pa.int64(), pa.float64()])
        uses = np.full((len(pieces), len(langs)), SMOOTHING)
        for lang, piece, n in sums.groupBy("lang", "piece").agg(F.sum("uses")).collect():
            uses[piece, lang] += n
        logs = np.log(uses / uses.sum(0))
    return langs, np.log(np.array([1.0 / max(1, len(langs))] * len(langs))), logs


def identify(docs: DataFrame, path: str, held_out_of: int = 3, held_out: int = 1, per_lang: int = TRAIN_PER_LANG) -> DataFrame:
    """`docs` with `lang_pred`, `lang_score` (the language's share of the probability) and `lang_held_out`; columns of these names are replaced.

    Learnt from rows with text and language that are not held out; only the text of a row decides its own prediction. A
    null text, or one without a letter, is "und" with score 0, and so is every row if there is nothing to learn from.
    Repeated rows get equal predictions, texts of any length are read whole, an empty table gives no rows.
    """
    names = [c for c in docs.columns if c not in ("lang_pred", "lang_score", "lang_held_out")]
    docs = docs.select(*names)
    pieces, first = load_pieces(path)
    train = stored(training_rows(docs, held_out_of, held_out, per_lang), "lang-train")
    langs, prior, logs = fit_languages(train, pieces, first)
    shared = docs.sparkSession.sparkContext.broadcast({"pieces": pieces, "logs": logs})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = shared.value
        scores = state["scores"] = state.get("scores") or WordScores(state["pieces"], state["logs"], fold=True)
        for batch in batches:
            for part in slices(batch, "text"):
                n = part.num_rows
                texts = [t or "" for t in part.column("text").to_pylist()]
                words = Words([t.encode() for t in texts])
                value = scores.of(words) if langs else np.zeros((len(words.hashes), 1))
                total = np.stack([words.per_text(value[:, k]) for k in range(value.shape[1])], 1) + (prior if langs else 0.0)
                best = total.argmax(1)
                share = 1.0 / np.exp(total - total.max(1, keepdims=True)).sum(1)
                known = np.array([bool(langs) and any(map(str.isalpha, t)) for t in texts], bool).reshape(n)
                pred = [langs[k] if ok else UNKNOWN for k, ok in zip(best.tolist(), known.tolist(), strict=True)]
                extra = [pa.array(pred, pa.string()), pa.array(np.where(known, share, 0.0), pa.float64())]
                yield pa.RecordBatch.from_arrays([*part.columns, *extra], names=[*part.schema.names, "lang_pred", "lang_score"])

    schema = T.StructType(list(docs.schema.fields)).add("lang_pred", "string").add("lang_score", "double")
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return docs.mapInArrow(run, schema).withColumn("lang_held_out", F.crc32(key) % held_out_of == held_out)
