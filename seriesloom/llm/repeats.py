"""Passages that stand elsewhere before: seed and extend.

Seeds are winnowed anchors: of every `window` words the least hash of `SEED` words in a row, so that equal windows choose
the same seed at the same place, and a document gives about one seed for seven words. An occurrence stands for the span of
windows that chose it. Seeds that occur once go at once. Occurrences whose whole spans are equal collapse in one aggregation: all
but the first are repeats. What is left, the first occurrences of different spans of one seed, found at the edges of repeated
passages, is extended word by word to both sides against the first occurrence of its seed. Windows inside the match are
repeats. Windows that reach beyond it can only be repeats of an occurrence that parts from the first at the same word, and go
on in a group of their own, until no group has two members. Matches of neighbouring seeds overlap and make up the maximal
repeats of at least `window` words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, slices, stored
from .lattice import texts_of
from .shingles import Joined, chained, mix

WINDOW = 20
#: Words of a seed: enough that few stand twice by chance.
SEED = 8
#: Most bits (as a power of two) of the filters of what is extended; what they let through in error ends alone in its group.
FILTER_BITS = 28
#: Bytes of text that a task works on at a time.
SLICE_BYTES = 1 << 20
ROW = ("doc_id", "part")
_TURN = np.uint64(0x9E3779B97F4A7C15)


def seeds(words: Joined, window: int, width: int) -> tuple[np.ndarray, ...]:
    """(hash, place, first window, last window) of every chosen seed, as positions among the joined words."""
    n = len(words.hashes) - window + 1
    if n <= 0:
        return (np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3)
    grams = chained(words.hashes, 0, width)
    reach = window - width + 1
    place = np.lib.stride_tricks.sliding_window_view(grams, reach).argmin(1) + np.arange(n)
    whole = words.owner[:n] == words.owner[window - 1 :]  # windows inside one text
    start = np.flatnonzero(whole & np.r_[True, (place[1:] != place[:-1]) | ~whole[:-1]])
    end = np.flatnonzero(whole & np.r_[(place[1:] != place[:-1]) | ~whole[1:], True])
    return grams[place[start]], place[start], start, end


def with_row(docs: DataFrame) -> DataFrame:
    """(doc_id, part, text) of every row; part tells texts of one id apart."""
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(text).alias("part"), text.cast("binary").alias("text"))


def seed_keys(rows: DataFrame, window: int, width: int) -> DataFrame:
    """The seeds of all occurrences, as `key`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                yield [seeds(Joined(texts_of(part, "text")), window, width)[0].view(np.int64)]

    return in_arrow(rows, run, "key long", [pa.int64()])


def anchors(rows: DataFrame, chosen: Broadcast, window: int, width: int) -> DataFrame:
    """(seed, span, doc_id, part, place, back, ahead): seeds that pass the filter, with a hash of all words of the windows that chose them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                words = Joined(texts_of(part, "text"))
                found = seeds(words, window, width)
                hit = passes(chosen.value, found[0])
                seed, place, start, end = (x[hit] for x in found)
                left, right = (chained(words.hashes, at, window) for at in (start, end))
                span = mix(left ^ mix(right + (place - start).astype(np.uint64) * _TURN) + (end - start).astype(np.uint64))
                of = pa.array(words.owner[start])
                first = np.r_[0, np.cumsum(words.counts)][words.owner[start]]
                yield [
                    seed.view(np.int64), span.view(np.int64), part.column("doc_id").take(of), part.column("part").take(of),
                    (place - first).astype(np.int32), (place - start).astype(np.int8), (end - place).astype(np.int8),
                ]

    schema = "seed long, span long, doc_id long, part long, place int, back byte, ahead byte"
    return in_arrow(rows, run, schema, [pa.int64()] * 4 + [pa.int32(), pa.int8(), pa.int8()])


def order() -> Column:
    """Sorts occurrences by document, null ids last, then by place."""
    return F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "part", "place")


def spots(keys: np.ndarray, bits: int) -> np.ndarray:
    """Where keys lie in a filter of a power of two of bits."""
    return keys >> np.uint64(64 - bits.bit_length() + 1)


def passes(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys a filter, held in words of 32 bits, lets through."""
    at = spots(keys, len(bits) << 5)
    return (bits[at >> np.uint64(5)] >> (at & np.uint64(31)).astype(np.uint32)) & 1 == 1


def occurrence_keys(seed: np.ndarray, part: np.ndarray, place: np.ndarray) -> np.ndarray:
    return mix(seed ^ mix(part + place.astype(np.uint64) * _TURN))


def key_filter(keys: DataFrame) -> np.ndarray:
    """A filter of the hashes in column `key`, of a size that follows their number up to 2**`FILTER_BITS` bits."""
    bits = 1 << min(FILTER_BITS, max(16, int(keys.count()).bit_length() + 4))
    spot = F.shiftrightunsigned(F.col("key"), 64 - bits.bit_length() + 1)
    words = keys.select(spot.alias("spot")).groupBy(F.shiftright("spot", 5).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(spot & 31 as int))")).alias("bits"))
    out = np.zeros(bits >> 5, np.uint32)
    for batch in words.toArrow().to_batches():
        out[batch.column("word").to_numpy(zero_copy_only=False)] = batch.column("bits").to_numpy(zero_copy_only=False).astype(np.uint32)
    return out


def having(rows: DataFrame, column: str, bits: Broadcast) -> DataFrame:
    """The rows whose key in a column of hashes passes a filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(passes(bits.value, batch.column(column).to_numpy().view(np.uint64))))

    return rows.mapInArrow(run, rows.schema)


def first_keys(firsts: DataFrame) -> DataFrame:
    """Hashes of occurrences (seed, part, place)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        for batch in batches:
            seed, part, place = (batch.column(c).to_numpy() for c in ("seed", "part", "place"))
            yield [occurrence_keys(seed.view(np.uint64), part.view(np.uint64), place).view(np.int64)]

    return in_arrow(firsts, run, "key long", [pa.int64()])


def contexts(rows: DataFrame, chosen: Broadcast, window: int, width: int) -> DataFrame:
    """As `anchors`, for the occurrences that pass the filter, with the word hashes before and after the seed, nearest first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                words = Joined(texts_of(part, "text"))
                seed, place, start, end = seeds(words, window, width)
                first = np.r_[0, np.cumsum(words.counts)][words.owner[start]]
                own = part.column("part").to_numpy().view(np.uint64)[words.owner[start]]
                hit = passes(chosen.value, occurrence_keys(seed, own, place - first))
                seed, place, start, end, first = (x[hit] for x in (seed, place, start, end, first))
                of = pa.array(words.owner[start])
                h = words.hashes
                yield [
                    seed.view(np.int64), part.column("doc_id").take(of), part.column("part").take(of), (place - first).astype(np.int32), (place - start).astype(np.int8),
                    (end - place).astype(np.int8), [h[a:p][::-1].tobytes() for a, p in zip(start.tolist(), place.tolist(), strict=True)],
                    [h[p + width : b + window].tobytes() for p, b in zip(place.tolist(), end.tolist(), strict=True)],
                ]

    schema = "group_id long, doc_id long, part long, place int, back byte, ahead byte, before binary, after binary"
    return in_arrow(rows, run, schema, [pa.int64()] * 3 + [pa.int32(), pa.int8(), pa.int8(), pa.binary(), pa.binary()])


def matched(a: bytes, b: bytes) -> int:
    """How many words of eight bytes two runs have in common from their start."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    n = min(len(x), len(y))
    apart = np.flatnonzero(x[:n] != y[:n])
    return int(apart[0]) if len(apart) else n


def extend(open_: DataFrame, window: int, width: int) -> DataFrame:
    """One round: every occurrence against the first of its group.

    Rows with a span (start, end) are windows found to be repeats; rows with a group are windows to go on with.
    """
    first = open_.groupBy("group_id").agg(F.min_by(F.struct("doc_id", "part", "place", "before", "after"), order()).alias("ref"), F.count("*").alias("n")).where("n > 1")
    first = stored(first, "firsts")  # a plain join, in which a group with many members can be split
    same = F.col("doc_id").eqNullSafe(F.col("ref.doc_id")) & (F.col("part") == F.col("ref.part")) & (F.col("place") == F.col("ref.place"))
    pairs = open_.join(first, "group_id").where(~same).select(
        "group_id", "doc_id", "part", "place", "back", "ahead", "before", "after", F.col("ref.before").alias("ref_before"), F.col("ref.after").alias("ref_after")
    )
    beyond = window - width

    def further(group: int, side: int, n: int, run: bytes) -> int:
        """The group of those that part from the first on one side after n words, with the same word."""
        key = b"%d,%d,%d," % (group, side, n) + run[8 * n : 8 * n + 8]
        return int.from_bytes(hashlib.blake2b(key, digest_size=8).digest(), "little", signed=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        for batch in batches:
            out: list[tuple] = []
            for group, doc_id, part, place, back, ahead, before, after, ref_before, ref_after in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                left, right = matched(before, ref_before), matched(after, ref_after)
                start, end = place - back, place + ahead
                low, high = place - left, place + right - beyond  # windows that start between these lie inside the match
                if max(start, low) <= min(end, high):
                    out.append((doc_id, part, max(start, low), min(end, high), *[None] * 6))
                if start < low:
                    out.append((doc_id, part, None, None, further(group, 0, left, before), place, back, min(end, low - 1) - place, before, after))
                if end > high and end >= low:
                    out.append((doc_id, part, None, None, further(group, 1, right, after), place, place - max(start, low, high + 1), ahead, before, after))
            if out:
                yield list(zip(*out, strict=True))

    schema = "doc_id long, part long, start int, end int, group_id long, place int, back byte, ahead byte, before binary, after binary"
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int8(), pa.int8(), pa.binary(), pa.binary()]
    return in_arrow(pairs, run, schema, types)


def repeated_windows(docs: DataFrame, window: int = WINDOW, width: int = SEED) -> DataFrame:
    """(doc_id, part, start, end): spans of first words of windows that stand before, `end` inclusive.

    A window stands before if its words also start in a document of a smaller id, or earlier in its own. Documents of one id are told
    apart and ordered by their texts' hash, null ids come last, and rows of equal id and text are one document.
    """
    rows = with_row(docs)
    context = docs.sparkSession.sparkContext
    twice = seed_keys(rows, window, width).groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    shared = anchors(rows, context.broadcast(key_filter(stored(twice, "keys"))), window, width)
    shared = stored(shared.dropDuplicates([*ROW, "place"]) if has_doubles(rows) else shared, "anchors")
    spans = stored(shared.groupBy("seed", "span").agg(F.min(order()).alias("first"), F.count("*").alias("n")), "spans")
    later = shared.join(spans.where("n > 1").select("seed", "span", "first"), ["seed", "span"]).where(order() != F.col("first"))
    out = [later.select(*ROW, (F.col("place") - F.col("back")).alias("start"), (F.col("place") + F.col("ahead")).alias("end"))]
    several = spans.groupBy(F.col("seed").alias("key")).agg(F.count("*").alias("n")).where("n > 1").select("key")
    firsts = first_keys(having(spans.select("seed", "first.part", "first.place"), "seed", context.broadcast(key_filter(stored(several, "keys")))))
    firsts = context.broadcast(key_filter(stored(firsts, "keys")))
    open_ = stored(contexts(rows, firsts, window, width), "open")
    while not open_.isEmpty():
        step = stored(extend(open_, window, width), "extended")
        out.append(step.where("start IS NOT NULL").select(*ROW, "start", "end"))
        open_ = step.where("group_id IS NOT NULL").select("group_id", *ROW, "place", "back", "ahead", "before", "after")
    result = out[0]
    for more in out[1:]:
        result = result.unionByName(more)
    return result


def has_doubles(rows: DataFrame) -> bool:
    """Whether any two rows have the same id."""
    return not rows.groupBy("doc_id").count().where("count > 1").isEmpty()


def covered(n: int, spans: list[dict] | None, window: int) -> np.ndarray:
    """Which of n words lie in a window that starts inside one of the spans."""
    steps = np.zeros(n + 1, np.int64)
    for s in spans or ():
        steps[s["start"]] += 1
        steps[s["end"] + window] -= 1
    return np.cumsum(steps[:n]) > 0


def cut_repeats(docs: DataFrame, window: int = WINDOW, width: int = SEED, keep_text: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256[, text, repeats]) of every row: words that a repeated window covers are removed.

    Words are runs of characters other than ASCII white space, compared as they are; what is left is joined by one space. `repeats`
    lists the removed stretches as first word and word after the last. A null text counts as empty, a text shorter than
    `window` words keeps all; rows of equal id and text count as one document and get equal results, so none of them is a repeat
    of the other. Very long texts are worked on whole. An empty table gives no rows; other columns are not read.
    """

    rows, context = with_row(docs), docs.sparkSession.sparkContext
    lists = repeated_windows(docs, window, width).groupBy(*ROW).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))  # bounded by the text's own length
    lists = stored(lists.withColumnsRenamed({"doc_id": "_id", "part": "_part"}), "lists")
    # texts without repeats, and that is all the filter holds back, are not shuffled
    bits = context.broadcast(key_filter(lists.select(F.col("_part").alias("key"))))

    def cut(texts: list[bytes], spans: list) -> list[list]:
        out = []
        for text, own in zip(texts, spans, strict=True):
            words = Joined([text])
            gone = covered(len(words.starts), own, window)
            kept = b" ".join([text[a:b] for a, b in zip(words.starts[~gone].tolist(), words.ends[~gone].tolist(), strict=True)])
            row = [len(gone), int(gone.sum()), hashlib.sha256(kept).hexdigest()]
            if keep_text:
                edges = np.flatnonzero(np.diff(np.r_[False, gone, False]))
                row += [kept.decode("utf-8", "replace"), [{"start": a, "end": b} for a, b in edges.reshape(-1, 2).tolist()]]
            out.append(row)
        return out

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        for batch in batches:
            batch = batch.filter(pa.array(~passes(bits.value, batch.column("part").to_numpy().view(np.uint64))))
            for part in slices(batch, "text", SLICE_BYTES):
                yield [part.column("doc_id"), *zip(*cut(texts_of(part, "text"), [None] * part.num_rows), strict=True)]

    def with_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                yield [part.column("doc_id"), *zip(*cut(texts_of(part, "text"), part.column("spans").to_pylist()), strict=True)]

    schema, types = "doc_id long, n_words long, n_removed long, kept_sha256 string", [pa.int64(), pa.int64(), pa.int64(), pa.string()]
    if keep_text:
        schema += ", text string, repeats array<struct<start:int,end:int>>"
        types += [pa.string(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))]
    some = having(rows, "part", bits)
    same = some["doc_id"].eqNullSafe(lists["_id"]) & (some["part"] == lists["_part"])
    joined = some.join(lists, same, "left").select("doc_id", "text", "spans")
    return stored(in_arrow(rows, alone, schema, types).unionByName(in_arrow(joined, with_spans, schema, types)), "cut")
