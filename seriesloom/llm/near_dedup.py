"""Near-duplicate documents by an inverted join over signature coordinates.

Texts with equal shingle sets are one class. A class posts its signature as coordinate-value pairs. Two sets over the
similarity bound agree in at least `AGREE` of the `COORDINATES` coordinates (missed with a chance of about two in a million
at the bound itself, falling fast above it), so in any order of the pairs they share one of the first
COORDINATES - AGREE + 1 of each: with the rarest pairs first, a class posts only that prefix, pairs nobody shares are skipped, and most
classes post nothing. Links are confirmed on the full shingle sets in two steps:

1. every class against the most agreeing heads of its posting lists; a list's head is the member whose pairs are shared most.
   This joins groups of near copies with a number of checks that grows with their size, not its square;
2. in lists that still hold several components, the members from different components whose signatures agree, in blocks of
   bounded size, where only links that join two components of the block are handed on.

Full sets are made, from the texts, only for classes whose signature agrees with that of another class often enough.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import in_arrow, slices, stored
from .components import star_links
from .lattice import texts_of
from .shingles import named_set

COORDINATES = 64
AGREE = 36
#: Heads that a class is checked against in the first step.
HEADS = 2
#: Most bits (as a power of two) of the filter that finds the texts whose sets are made again.
FILTER_BITS = 28
#: Bytes of full sets in a block of one posting list.
BLOCK_BYTES = 4 << 20
#: Rows with full sets that go to a Python worker at a time.
SET_ROWS = 512
#: Pairs of signatures compared at a time.
PAIRS = 1 << 15
_RANDOM = np.random.default_rng(64)
_FACTORS = _RANDOM.integers(0, 1 << 63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _RANDOM.integers(0, 1 << 63, COORDINATES, dtype=np.uint64)


def signature(hashes: np.ndarray) -> np.ndarray:
    """The least image of a set under each coordinate's hash function, 32 bits of it."""
    least = np.full(COORDINATES, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), 4096):
        least = np.minimum(least, (hashes[i : i + 4096, None] * _FACTORS + _SHIFTS).min(0))
    return (least >> np.uint64(32)).astype(np.uint32).view(np.int32)


def linked(common: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    return 100 * common >= percent * (a + b - common)


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, uid, n_shingles, set_key, sig) of every row; uid numbers the rows, key and signature are null for empty sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        uid = TaskContext.get().partitionId() << 36
        for batch in batches:
            for part in slices(batch, "text"):
                sets = [named_set(t.lower(), width) for t in texts_of(part, "text")]
                yield [
                    part.column("doc_id"), np.arange(uid, uid + len(sets)), [len(s) for s, _ in sets],
                    [key for _, key in sets], [signature(s) if len(s) else None for s, _ in sets],
                ]
                uid += len(sets)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    schema = "doc_id long, uid long, n_shingles long, set_key binary, sig array<int>"
    return in_arrow(rows, run, schema, [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int32())])


def postings(classes: DataFrame) -> DataFrame:
    """(token, uid, rank, weight): the prefix of each class that can have a partner; weight says how much its pairs are shared."""
    place = (F.col("at").cast("long") * F.lit(1 << 32)) + F.pmod(F.col("value").cast("long"), F.lit(1 << 32))
    tokens = classes.select("uid", F.posexplode("sig").alias("at", "value")).select("uid", place.alias("token"))
    shared = tokens.groupBy("token").agg(F.count("*").alias("n")).where("n > 1")
    held = tokens.join(shared, "token").groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("n", "token"))).alias("held"))  # COORDINATES at most
    able = held.where(F.size("held") >= AGREE)
    # pairs that nobody shares come first in the order and take up places of the prefix
    places = F.greatest(F.lit(0), F.lit(COORDINATES - AGREE + 1) - (F.lit(COORDINATES) - F.size("held")))
    weight = F.aggregate("held", F.lit(0.0), lambda total, x: total + F.log(x["n"]))
    return able.select("uid", weight.alias("weight"), F.explode(F.slice("held", 1, places)).alias("x")).select("uid", "weight", F.col("x.token").alias("token"))


def id_filter(ids: DataFrame) -> np.ndarray:
    """A Bloom filter of ids with two bits each, at most `FILTER_BITS` bits: what reaches the driver is bounded by its size."""
    bits = 1 << min(FILTER_BITS, max(16, int(ids.count()).bit_length() + 4))
    spots = ids.select(F.explode(F.array(*[F.pmod(F.xxhash64("_id", F.lit(k)), F.lit(bits)) for k in (1, 2)])).alias("spot"))
    words = spots.groupBy(F.shiftright("spot", 5).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(spot & 31 as int))")).alias("bits"))
    out = np.zeros(bits >> 5, np.uint32)
    for batch in words.toArrow().to_batches():
        out[batch.column("word").to_numpy(zero_copy_only=False)] = batch.column("bits").to_numpy(zero_copy_only=False).astype(np.uint32)
    return out


def full_sets(docs: DataFrame, classes: DataFrame, needed: DataFrame, width: int) -> DataFrame:
    """(uid, hashes): the shingle sets of the classes in `needed`, made again from the texts of their first rows.

    A filter of the rows' ids lets all other texts pass unread, so that no text is shuffled; what it lets through in error
    goes in the join on the set's own key.
    """
    wanted = classes.join(needed, "uid", "left_semi")
    id_of = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    kept = docs.sparkSession.sparkContext.broadcast(id_filter(wanted.select(id_of.alias("_id")).distinct()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        bits = kept.value
        for batch in batches:
            spots = [batch.column(k).to_numpy(zero_copy_only=False) % (len(bits) << 5) for k in (0, 1)]
            hit = np.logical_and.reduce([(bits[s >> 5] >> (s & 31).astype(np.uint32)) & 1 == 1 for s in spots])
            for part in slices(batch.filter(pa.array(hit)), "text"):
                sets = [named_set(t.lower(), width) for t in texts_of(part, "text")]
                yield [[key for _, key in sets], [s.tobytes() for s, _ in sets]]

    spots = [F.pmod(F.xxhash64(id_of, F.lit(k)), F.lit(1 << FILTER_BITS)).alias(f"spot{k}") for k in (1, 2)]
    rows = docs.where("text IS NOT NULL").select(*spots, F.col("text").cast("string").cast("binary").alias("text"))
    made = in_arrow(rows, run, "set_key binary, hashes binary", [pa.binary(), pa.binary()])
    return made.join(wanted.select("set_key", "uid"), "set_key").dropDuplicates(["uid"]).select("uid", "hashes")


def best_heads(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """For every class the `HEADS` heads whose signatures agree most with its own, often enough to be linked."""
    left, right = (classes.select(F.col("uid").alias(x), F.col("sig").alias(f"sig_{x}")) for x in "ab")
    agree = F.aggregate(F.zip_with("sig_a", "sig_b", lambda x, y: (x == y).cast("int")), F.lit(0), lambda total, x: total + x)
    scored = pairs.join(left, "a").join(right, "b").select("a", "b", agree.alias("agree")).where(F.col("agree") >= AGREE)
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("agree"), "b"))  # one row for each prefix pair at most
    return scored.withColumn("rank", rank).where(F.col("rank") <= HEADS).select("a", "b")


def confirm_pairs(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are linked."""
    left, right = (sets.select(F.col("uid").alias(x), F.col("hashes").alias(f"set_{x}")) for x in "ab")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        for batch in batches:
            a, b = [], []
            for x, y, set_x, set_y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x_set, y_set = np.frombuffer(set_x, np.uint64), np.frombuffer(set_y, np.uint64)
                if linked(len(np.intersect1d(x_set, y_set, assume_unique=True)), len(x_set), len(y_set), percent):
                    a.append(x)
                    b.append(y)
            yield [a, b]

    near = (F.octet_length("set_a") * 100 >= F.octet_length("set_b") * percent) & (F.octet_length("set_b") * 100 >= F.octet_length("set_a") * percent)
    both = pairs.join(left, "a").join(right, "b").where(near).select("a", "b", "set_a", "set_b")
    return in_arrow(both, run, "a long, b long", [pa.int64(), pa.int64()])


class _Roots:
    """Union-find over the members of a block."""

    def __init__(self, labels: np.ndarray) -> None:
        first: dict[int, int] = {}
        self.up = [first.setdefault(x, i) for i, x in enumerate(labels.tolist())]

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def all(self) -> np.ndarray:
        return np.array([self.find(i) for i in range(len(self.up))])


class Block:
    """Members of one posting list's block, or of two blocks (`side`), in the order of their set sizes."""

    def __init__(self, rows: pd.DataFrame) -> None:
        self.rows = rows = rows.sort_values(["n_shingles", "uid"]).reset_index(drop=True)
        self.sig = np.stack(rows["sig"].to_numpy())
        masks = rows["prefix"].to_numpy().view(np.uint64)
        self.prefix = masks[:, None] >> np.arange(COORDINATES, dtype=np.uint64) & np.uint64(1) == 1
        self.n, self.side, self.uid = (rows[c].to_numpy() for c in ("n_shingles", "side", "uid"))
        self.root = rows["root"].to_numpy()
        self.two = len(rows) > 0 and self.side.min() != self.side.max()
        self.at = int(rows["token"].iloc[0] >> 32)

    def partners(self, i: int, now: np.ndarray, percent: int) -> np.ndarray:
        """Later members that may be linked with member i and belong to another component.

        A pair that shares several prefix pairs is looked at only in the list of the lowest shared coordinate.
        """
        j = np.arange(i + 1, int(np.searchsorted(self.n * percent, 100 * self.n[i], side="right")))
        j = j[(now[j] != now[i]) & ((self.side[j] != self.side[i]) if self.two else True)]
        same = self.sig[j] == self.sig[i]
        first = (same & self.prefix[j] & self.prefix[i]).argmax(1) if len(j) else j
        return j[(same.sum(1) >= AGREE) & (first == self.at)]

    def links(self, percent: int) -> list[tuple[int, int]]:
        """Links that join different components, confirmed on the full sets."""
        roots, out = _Roots(self.rows["root"].to_numpy()), []
        sets = [np.frombuffer(h, np.uint64) for h in self.rows["hashes"]]
        now = roots.all()
        for i in range(len(sets) - 1):
            j = self.partners(i, now, percent)
            if not len(j):
                continue
            own, lengths = sets[i], self.n[j]
            joined = np.concatenate([sets[k] for k in j])
            spot = np.minimum(np.searchsorted(own, joined), len(own) - 1)
            common = np.add.reduceat((own[spot] == joined).astype(np.int64), np.r_[0, np.cumsum(lengths)[:-1]])
            for k in j[linked(common, self.n[i], lengths, percent)]:
                a, b = roots.find(i), roots.find(int(k))
                if a != b:
                    roots.up[max(a, b)] = min(a, b)
                    out.append((int(self.root[i]), int(self.root[k])))
            now = roots.all()
        return out


def able(rows: pa.Table, percent: int) -> np.ndarray:
    """Which rows of whole blocks, each in the order of set sizes, have a partner (see `Block.partners`) in their block."""
    token, one, two, side, root, n, mask = (rows.column(c).to_numpy() for c in ("token", "one", "two", "side", "root", "n_shingles", "prefix"))
    sig, mask = rows.column("sig").combine_chunks().flatten().to_numpy().reshape(-1, COORDINATES), mask.view(np.uint64)
    block = np.cumsum(np.r_[False, block_starts(rows)])
    width = 101 * int(n.max()) + 1
    counts = np.searchsorted(block * width + n * percent, block * width + 100 * n, side="right") - np.arange(len(n)) - 1
    before = np.r_[0, np.cumsum(counts)]
    out, i = np.zeros(len(n), bool), 0
    while i < len(n):
        j = max(i + 1, int(np.searchsorted(before, before[i] + PAIRS, side="right")) - 1)
        a = np.repeat(np.arange(i, j), counts[i:j])
        b = a + 1 + np.arange(len(a)) - np.repeat(before[i:j] - before[i], counts[i:j])
        apart = (root[a] != root[b]) & ((side[a] != side[b]) | (one[a] == two[a]))
        a, b = a[apart], b[apart]
        same = sig[a] == sig[b]
        near = np.count_nonzero(same, axis=1) >= AGREE
        a, b = a[near], b[near]
        shared = np.packbits(same[near], axis=1, bitorder="little").view(np.uint64)[:, 0] & mask[a] & mask[b]
        own = shared & (~shared + np.uint64(1)) == np.uint64(1) << (token[a] >> 32).astype(np.uint64)
        out[a[own]] = out[b[own]] = True
        i = j
    return out


def block_starts(rows: pa.Table) -> np.ndarray:
    """Where a row, from the second on, begins another block."""
    return np.logical_or.reduce([np.diff(rows.column(c).to_numpy()) != 0 for c in ("token", "one", "two")])


def open_members(posts: DataFrame, roots: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The members of posting lists that have a possible partner in another component, by signatures alone, in their blocks."""
    labelled = posts.join(roots, "uid", "left").withColumn("root", F.coalesce("root", "uid"))
    spans = labelled.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("token")
    prefix = posts.groupBy("uid").agg(F.bit_or(F.expr("shiftleft(1L, cast(shiftright(token, 32) as int))")).alias("prefix"))
    members = labelled.join(spans, "token").select("token", "uid", "root").join(classes.select("uid", "n_shingles"), "uid")
    # blocks of bounded size along the order of set sizes; sizes too far apart cannot be linked, so far blocks never meet
    size = F.col("n_shingles") * 8 + 512
    sizes = members.groupBy("token", "n_shingles").agg(F.sum(size).alias("bytes"))  # a list's sizes, not its members, are put in order
    before = Window.partitionBy("token").orderBy("n_shingles").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("token", "n_shingles", F.floor(F.coalesce(F.sum("bytes").over(before), F.lit(0)) / BLOCK_BYTES).alias("from"), F.ceil(F.col("bytes") / BLOCK_BYTES).alias("parts"))
    # members of one size that fill several blocks are dealt out to them
    place = F.col("from") + F.pmod(F.xxhash64("uid"), F.col("parts"))
    blocks = members.join(sizes, ["token", "n_shingles"]).select("token", "uid", "root", "n_shingles", place.cast("int").alias("block"))
    spread = blocks.groupBy("token", "block").agg(F.min("n_shingles").alias("least"), F.max("n_shingles").alias("most"))
    first = spread.select("token", F.col("block").alias("one"), F.col("most").alias("reach"))
    meet = first.join(spread, "token").where((F.col("block") >= F.col("one")) & (F.col("least") * percent <= F.col("reach") * 100))
    pairs = meet.select("token", "one", F.col("block").alias("two"), F.explode(F.array_distinct(F.array("one", "block"))).alias("side"))
    placed = pairs.join(blocks.withColumnRenamed("block", "side"), ["token", "side"])
    known = classes.select("uid", "sig").join(prefix, "uid")
    rows = placed.join(known, "uid").select("token", "one", "two", "side", "uid", "root", "n_shingles", "prefix", "sig")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            rest = table if rest is None else pa.concat_tables([rest, table]).combine_chunks()
            starts = np.flatnonzero(block_starts(rest))
            if len(starts):  # the last block may go on in the next batch
                whole, rest = rest.slice(0, starts[-1] + 1), rest.slice(starts[-1] + 1)
                yield from whole.filter(pa.array(able(whole, percent))).to_batches()
        if rest is not None and rest.num_rows:
            yield from rest.filter(pa.array(able(rest, percent))).to_batches()

    ordered = rows.repartition("token", "one", "two").sortWithinPartitions("token", "one", "two", "n_shingles", "uid")
    return ordered.mapInArrow(run, rows.schema)


def residual_links(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between the components that still meet in a posting list, confirmed on the full sets of its open members; as their roots."""

    def links(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(Block(rows).links(percent), columns=["a", "b"], dtype="int64")

    return members.join(sets.select("uid", "hashes"), "uid").groupBy("token", "one", "two").applyInPandas(links, "a long, b long")


def near_groups(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row.

    Words are runs of characters other than ASCII white space, A-Z in lower case; a text of fewer than `width` words is one
    shingle. Rows are linked if their sets of distinct shingles have at least `percent` % in common; equal sets are
    linked by their class and never expanded into pairs. A component's id is the least id in it, its row stays; rows without
    words (null, empty, white space) are linked with nothing. A row without an id links others, but has no component id if it is
    alone or only with its like, and stays in that case. An empty table gives no rows; other columns are not read.
    """
    rows = stored(sketches(docs, width), "sketches")
    filled = rows.where("set_key IS NOT NULL")
    classes = filled.groupBy("set_key").agg(F.min("uid").alias("uid"), F.min("doc_id").alias("doc_id"), F.first("sig").alias("sig"), F.first("n_shingles").alias("n_shingles"))
    classes = stored(classes, "classes")
    posts = stored(postings(classes), "postings")
    heads = posts.groupBy("token").agg(F.max(F.struct("weight", "uid")).alias("head"), F.count("*").alias("n")).where("n > 1").select("token", "head.uid")
    pairs = posts.select("token", F.col("uid").alias("a")).join(heads.withColumnRenamed("uid", "b"), "token").where("a <> b").select("a", "b").distinct()
    near = stored(best_heads(pairs, classes), "near")
    sets = stored(full_sets(docs, classes, near.select(F.explode(F.array("a", "b")).alias("uid")).distinct(), width), "sets", SET_ROWS)
    first = stored(confirm_pairs(near, sets, percent), "links", SET_ROWS)
    roots = star_links(first).withColumnRenamed("node", "uid")
    listed = posts.join(heads, "token", "left_semi").select("token", "uid")
    open_ = stored(open_members(listed, roots, classes, percent), "open")
    named = classes.join(roots, "uid", "left").withColumn("root", F.coalesce("root", "uid"))
    if not open_.isEmpty():
        lacking = open_.select("uid").distinct().join(sets, "uid", "left_anti")
        more_sets = stored(full_sets(docs, classes, lacking, width), "sets", SET_ROWS)
        # written first: contracting them in the same stage would need a second Python worker for every task
        more = stored(residual_links(open_, sets.union(more_sets), percent), "more-links")
        # links of the second step join components of the first
        merged = star_links(more).select(F.col("node").alias("root"), F.col("root").alias("final"))
        named = named.join(merged, "root", "left").withColumn("root", F.coalesce("final", "root"))
    least = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    members = named.join(least, "root").select("set_key", "component_id")
    grouped = rows.join(members, "set_key", "left")
    component = F.when(F.col("set_key").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return grouped.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, component.isNull()).alias("kept"))


def drop_near_copies(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of `docs` that `near_groups` keeps, all columns as they are, whatever their names; rows of one id go or stay together."""
    gone = near_groups(docs, width, percent).where(~F.col("kept")).select(F.col("doc_id").alias("gone")).distinct()
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.struct("*").alias("row"))
    return rows.join(gone, rows["id"].eqNullSafe(gone["gone"]), "left_anti").select("row.*")
