"""Document fingerprints: threshold-scaled sketches of word shingles.

A sketch keeps every distinct shingle hash below a fixed fraction of the hash range, and the smallest hash in any
case. Its size follows the text's, so the share of one sketch found in another estimates containment also between very
unequal texts, and the sketch of a union is the merge of the sketches.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, partitions
from .shingles import shingle_set

FRACTION = 1 / 8
WIDTH = 5
ROWS_PER_RANGE = 1024
MOST_RANGES = 10_000


def sketch(text: str, fraction: float = FRACTION, width: int = WIDTH) -> np.ndarray:
    """Sorted kept hashes of a text; nothing for a text without words."""
    return scaled(shingle_set(text.encode(), width), fraction)


def scaled(hashes: np.ndarray, fraction: float) -> np.ndarray:
    below = int(np.searchsorted(hashes, np.uint64(int(fraction * (1 << 64)) - 1), side="right"))
    return hashes[: max(below, min(1, len(hashes)))]


def merge(a: np.ndarray, b: np.ndarray, fraction: float = FRACTION) -> np.ndarray:
    """The sketch of two texts' shingles together."""
    return scaled(np.union1d(a, b), fraction)


def pack(kept: np.ndarray) -> str:
    """A sketch as text: sixteen hex digits for each hash, ascending."""
    return kept.astype(">u8").tobytes().hex()


def unpack(text: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(text), ">u8").astype(np.uint64)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of common shingles among all; two empty sketches are alike, one empty sketch is like no other."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / (len(a) + len(b) - common)


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of the shingles of `a` that `b` has too; 1 if `a` has none."""
    return len(np.intersect1d(a, b, assume_unique=True)) / len(a) if len(a) else 1.0


def id_ranges(docs: DataFrame) -> list[int]:
    """Ids that cut the table into ranges of about `ROWS_PER_RANGE` rows; the last is the largest id."""
    rows = docs.count()
    ranges = max(1, min(MOST_RANGES, rows // ROWS_PER_RANGE))
    at = [k / ranges for k in range(1, ranges)] or [1.0]
    cuts = docs.agg(F.percentile_approx("doc_id", at, 100 * ranges + 1000).alias("at"), F.max("doc_id").alias("last")).first()
    return sorted({*(cuts["at"] or []), cuts["last"]} - {None})


def with_next(docs: DataFrame) -> DataFrame:
    """Rows (piece, guest, doc_id, text): ranges of ids, each in descending order and closed by the row that follows it.

    Each range ends at an id that exists, so its first row is known before the shuffle and is sent to the range above
    as a guest as well. Every text is shuffled once, apart from one more row for each range.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    cuts = id_ranges(rows)
    edges = F.array(*map(F.lit, cuts)) if cuts else F.array().cast("array<bigint>")
    own = F.coalesce(F.size(F.filter(edges, lambda e: e < F.col("doc_id"))), F.lit(0))
    above = F.when(F.col("doc_id").isin(cuts), (own + 1) % len(cuts)) if cuts else F.lit(0).cast("int")
    places = F.when(above.isNull(), F.array(F.struct(own.alias("piece"), F.lit(0).alias("guest")))).otherwise(
        F.array(F.struct(own.alias("piece"), F.lit(0).alias("guest")), F.struct(above.cast("int").alias("piece"), F.lit(1).alias("guest")))
    )
    spread = rows.select(F.explode(places).alias("at"), "doc_id", "text").select("at.piece", "at.guest", "doc_id", "text")
    tasks = max(partitions(docs.sparkSession), len(cuts) // 8)
    return spread.repartition(tasks, "piece").sortWithinPartitions("piece", "guest", F.desc_nulls_last("doc_id"), "text")


def fingerprint_edits(docs: DataFrame, fraction: float = FRACTION, width: int = WIDTH) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they and the next document's are.

    The next document is the one with the next smaller id (after the smallest: the largest). The edited text has the
    last third of the code points replaced by as many from the start of the next document. A null text counts as
    empty; rows without an id come last; rows with the same id follow each other by text; a table of one row follows
    itself; an empty table gives no rows. Texts of any length are read whole; other columns are not read.
    """

    def measured(this: tuple, after: tuple) -> tuple:
        (doc_id, text, own), (_, other, its) = this, after
        third = len(text) // 3
        edited = text[: len(text) - third] + other[:third]
        changed = sketch(edited, fraction, width)
        return (
            doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), pack(own), pack(changed),
            likeness(own, changed), likeness(own, its), containment(own, changed), containment(own, its),
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        out, piece, before = [], None, None
        for batch in batches:
            for at, guest, doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at != piece:
                    piece, before = at, None
                if guest and before is None:
                    continue  # only the first guest is needed
                row = (doc_id, text, sketch(text, fraction, width))
                if before:
                    out.append(measured(before, row))
                before = None if guest else row
                if len(out) >= 256:
                    yield list(zip(*out, strict=True))
                    out = []
        if out:
            yield list(zip(*out, strict=True))

    schema = (
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double, contained_edited double, contained_next double"
    )
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), *[pa.float64()] * 4]
    return in_arrow(with_next(docs), run, schema, types)
