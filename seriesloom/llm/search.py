"""Ranked lexical search by Block-Max MaxScore over shards of an inverted index.

Every slice of the scan becomes a shard: the posting lists of the query terms, in compressed blocks with the last document, the
largest count and the shortest length of each. Corpus statistics come from the shards' sums. Then every shard answers
all queries on its own. List bounds part a query's terms: lists are read whole, strongest first, until the bounds of the others
together fall below the tenth best score; of the others, the block bounds reject candidates before a block is unpacked. The
heaps of the shards are merged by rank. Nothing but vocabulary-sized statistics and the ten best of a shard is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import in_arrow, slices, stored
from .lattice import texts_of
from .shingles import Joined

#: Bytes that part terms: all of ASCII but letters and digits.
BETWEEN = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
SHARD_BYTES = 16 << 20
#: Bytes of the item texts that are answered in one pass; more items take further passes.
ITEM_BYTES = 8 << 20
BLOCK = 128
BEST = 10
_WIDTHS = {1: "<u1", 2: "<u2", 4: "<u4"}


def width_of(values: np.ndarray) -> int:
    top = int(values.max(initial=0))
    return 1 if top < 1 << 8 else 2 if top < 1 << 16 else 4


def pack(ordinals: np.ndarray, counts: np.ndarray) -> tuple[bytes, int, int]:
    """Steps between document numbers and counts, each in as few bytes as the largest needs."""
    steps = np.diff(ordinals, prepend=0)
    a, b = width_of(steps), width_of(counts)
    return steps.astype(_WIDTHS[a]).tobytes() + counts.astype(_WIDTHS[b]).tobytes(), a, b


def unpack(data: bytes, at: int, n: int, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
    steps = np.frombuffer(data, _WIDTHS[a], n, at).astype(np.int64)
    return np.cumsum(steps), np.frombuffer(data, _WIDTHS[b], n, at + a * n).astype(np.int64)


SHARD = "ids binary, lengths binary, terms array<int>, dfs array<long>, first_block binary, blocks binary, payload binary, n_docs long, n_terms long"
_SHARD_TYPES = [pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]


def shard_row(ids: np.ndarray, known: np.ndarray, texts: list[bytes], vocabulary: np.ndarray) -> list:
    """The index of some documents: (id, whether it is null) in rank order of ties, their lengths, and lists of the vocabulary's terms.

    `vocabulary` holds sorted term hashes. A block's header is (place, size, two widths, last document, largest count, least length).
    """
    order = np.lexsort((ids, ~known))
    words = Joined([texts[i].lower() for i in order.tolist()], BETWEEN)
    at = np.minimum(np.searchsorted(vocabulary, words.hashes), max(0, len(vocabulary) - 1))
    hit = vocabulary[at] == words.hashes if len(vocabulary) else np.zeros(len(words.hashes), bool)
    pairs, counts = np.unique(at[hit] * len(texts) + words.owner[hit], return_counts=True)
    term, doc = pairs // len(texts), pairs % len(texts)
    terms, begin, size = np.unique(term, return_index=True, return_counts=True)
    payload, headers, first, place = [], [], [0], 0
    for s, n in zip(begin.tolist(), size.tolist(), strict=True):
        for i in range(s, s + n, BLOCK):
            j = min(i + BLOCK, s + n)
            data, a, b = pack(doc[i:j], counts[i:j])
            headers.append((place, j - i, a, b, doc[j - 1], counts[i:j].max(), words.counts[doc[i:j]].min()))
            payload.append(data)
            place += len(data)
        first.append(len(headers))
    return [
        np.stack([ids[order], known[order]]).astype("<i8").tobytes(), words.counts.astype("<i8").tobytes(), terms.astype(np.int32), size,
        np.array(first, "<i8").tobytes(), np.array(headers, "<i8").tobytes(), b"".join(payload), int((words.counts > 0).sum()), int(words.counts.sum()),
    ]


def build_index(docs: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """One row for each slice of the table: its shard for the terms of the vocabulary (sorted hashes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        for batch in batches:
            for part in slices(batch, "text", SHARD_BYTES):
                ids = part.column("doc_id")
                known = np.array(ids.is_valid().to_pylist(), bool)
                row = shard_row(np.array(ids.fill_null(0).to_pylist(), np.int64), known, texts_of(part, "text"), vocabulary)
                yield [[x] for x in row]

    rows = docs.where("text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    return in_arrow(rows, run, SHARD, _SHARD_TYPES)


class Shard:
    """A shard opened for queries. Lists and blocks are unpacked when first needed and kept until the shard is done."""

    def __init__(self, row: dict, n_docs: int, n_terms: int) -> None:
        self.ids, self.known = np.frombuffer(row["ids"], "<i8").reshape(2, -1)
        lengths = np.frombuffer(row["lengths"], "<i8")
        self.norm = lambda n: 25 + 75 * n * n_docs // max(1, n_terms)
        self.m = self.norm(lengths)
        self.place = {t: i for i, t in enumerate(row["terms"])}
        self.first = np.frombuffer(row["first_block"], "<i8")
        self.blocks = np.frombuffer(row["blocks"], "<i8").reshape(-1, 7)
        self.last = self.blocks[:, 4]
        self.bound = self.value(self.blocks[:, 5], self.norm(self.blocks[:, 6]))
        self.payload = row["payload"]
        self.open: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    @staticmethod
    def value(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
        """A term's value without its weight: grows with the count, falls with the length, so block extremes bound it."""
        return 1_000_000_000 * tf // (1000 * tf + 8 * m)

    def block(self, b: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, values) of a block."""
        found = self.open.get(b)
        if found is None:
            at, n, wide_step, wide_count = self.blocks[b, :4].tolist()
            docs, counts = unpack(self.payload, at, n, wide_step, wide_count)
            found = self.open[b] = (docs, self.value(counts, self.m[docs]))
        return found

    def best(self, query: dict[int, int], k: int = BEST) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) of the k best for a query of terms and weights; ties go to the lower document number."""
        lists = [(w, *self.first[self.place[t] : self.place[t] + 2].tolist()) for t, w in query.items() if w and t in self.place]
        lists = sorted(((w * int(self.bound[i:j].max()), w, i, j) for w, i, j in lists), reverse=True)
        rest = np.cumsum([0, *[x[0] for x in reversed(lists)]])[::-1]  # bound of the lists from each on
        score, least, done = np.zeros(len(self.ids), np.int64), 1, 0
        while done < len(lists) and rest[done] >= least:  # essential lists
            _, w, i, j = lists[done]
            for b in range(i, j):
                docs, values = self.block(b)
                score[docs] += w * values
            done += 1
            if len(score) >= k:
                least = max(1, int(np.partition(score, -k)[-k]))
        found = np.flatnonzero((score > 0) & (score + rest[done] >= least))
        bounds, places = [], []
        for _, w, i, j in lists[done:]:
            at = i + np.searchsorted(self.last[i:j], found)
            bounds.append(np.where(at < j, w * self.bound[np.minimum(at, j - 1)], 0))
            places.append(np.where(at < j, at, -1))
        upper = score[found] + sum(bounds, np.zeros(len(found), np.int64))
        for x, (_, w, _, _) in enumerate(lists[done:]):
            alive = upper >= least
            found, upper, bounds, places = found[alive], upper[alive], [y[alive] for y in bounds], [y[alive] for y in places]
            upper = upper - bounds[x]
            for b in np.unique(places[x][places[x] >= 0]).tolist():
                docs, values = self.block(b)
                mine = np.flatnonzero(places[x] == b)
                at = np.minimum(np.searchsorted(docs, found[mine]), len(docs) - 1)
                gain = np.where(docs[at] == found[mine], w * values[at], 0)
                score[found[mine]] += gain
                upper[mine] += gain
            if len(found) >= k:
                least = max(least, int(np.partition(score[found], -k)[-k]))
        order = np.lexsort((found, -score[found]))[:k]
        return found[order], score[found[order]]


def weight(n_docs: int, df: int) -> int:
    return floor(1000 * log((2 * n_docs + 2) / (2 * df + 1)))


def answer(docs: DataFrame, items: pa.Table, k: int) -> DataFrame:
    """(item, item_id, doc_id, score): the best of every shard for some items (item_id, text), numbered from 0."""
    words = [Joined([t.lower()], BETWEEN).hashes for t in texts_of(items, "text")]
    vocabulary = np.unique(np.concatenate([np.zeros(0, np.uint64), *words]))
    index = stored(build_index(docs, vocabulary), "index")
    size = index.agg(F.coalesce(F.sum("n_docs"), F.lit(0)).alias("docs"), F.coalesce(F.sum("n_terms"), F.lit(0)).alias("terms")).first()
    df = index.select(F.explode(F.arrays_zip("terms", "dfs")).alias("t")).groupBy("t.terms").agg(F.sum("t.dfs")).collect()  # a row a term at most
    weights = {t: weight(size["docs"], n) for t, n in df}
    queries = []
    for hashes in words:
        terms, times = np.unique(np.searchsorted(vocabulary, hashes), return_counts=True)
        queries.append({t: n * weights[t] for t, n in zip(terms.tolist(), times.tolist(), strict=True) if t in weights})
    names = items.column("item_id").to_pylist()
    shared = docs.sparkSession.sparkContext.broadcast((queries, names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        queries, names = shared.value
        for batch in batches:
            for i in range(batch.num_rows):
                shard = Shard(batch.slice(i, 1).to_pylist()[0], size["docs"], size["terms"])
                out = [(x, *shard.best(query, k)) for x, query in enumerate(queries)]
                rows = [(x, names[x], int(shard.ids[d]) if shard.known[d] else None, s) for x, found, scores in out for d, s in zip(found.tolist(), scores.tolist(), strict=True)]
                if rows:
                    yield list(zip(*rows, strict=True))

    schema = "item long, item_id long, doc_id long, score long"
    needed = index.select("ids", "lengths", "terms", "first_block", "blocks", "payload")
    return in_arrow(needed, run, schema, [pa.int64()] * 4)


def ranked(docs: DataFrame, items: DataFrame, k: int = BEST) -> DataFrame:
    """(item_id, rank, doc_id, score): the `k` best documents with a score above 0 for every item.

    Terms are runs of ASCII letters and digits and of all characters beyond ASCII, A-Z in lower case; a null or empty text has none. Equal
    scores go by ascending id, null ids last. Rows of one id are documents of their own; equal rows of `items` count once, other
    rows of one item id are answered one by one. Very long texts are a shard of their own. Empty tables give no rows; other
    columns are not read.
    """
    slim = items.where("text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").cast("binary").alias("text"))
    slim = slim.distinct()
    total = slim.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = 1 + total // ITEM_BYTES
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    # each block's items, about ITEM_BYTES, come to the driver and go with its pass
    found = [answer(docs, slim.where(block == b).toArrow(), k).withColumn("item", F.col("item") + F.lit(b << 32)) for b in range(blocks)]
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    best = reduce(DataFrame.unionByName, found).withColumn("rank", place).where(F.col("rank") <= k)
    return best.select("item_id", "rank", "doc_id", "score")
