import hashlib
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from seriesloom.llm import fingerprint as fp
from seriesloom.llm.sharding import permuted, round_keys, shard_documents
from seriesloom.llm.shingles import shingle_set, word_hashes


def edits(rows):
    """Plain version of the neighbours and edits: descending ids, nulls last, ties by text."""
    order = sorted(((d is not None, d or 0, d, t or "") for d, t in rows), key=lambda r: (-r[0], -r[1], r[3]))
    out = []
    for k, (_, _, d, t) in enumerate(order):
        nxt = order[(k + 1) % len(order)][3]
        third = len(t) // 3
        out.append((d, t, t[: len(t) - third] + nxt[:third], nxt))
    return out


def check_edits(docs):
    rows = [(r[0], r[1]) for r in docs.select("doc_id", "text").collect()]
    got = fp.fingerprint_edits(docs).collect()
    want = []
    for d, t, e, n in edits(rows):
        a, b, c = fp.sketch(t), fp.sketch(e), fp.sketch(n)
        want.append((d, len(t), hashlib.sha256(e.encode()).hexdigest(), fp.pack(a), fp.pack(b), fp.likeness(a, b), fp.likeness(a, c), fp.containment(a, b), fp.containment(a, c)))
    assert Counter(map(tuple, got)) == Counter(want)


def test_fingerprints_of_odd_rows(odd_docs, none_docs):
    check_edits(odd_docs)
    assert fp.fingerprint_edits(none_docs).count() == 0


def test_fingerprints_across_ranges(make_docs, monkeypatch):
    monkeypatch.setattr(fp, "ROWS_PER_RANGE", 7)
    check_edits(make_docs([(i * 3 % 101, f"text {i} " * (i % 9) + "some more words follow here") for i in range(101)]))


def test_single_document_follows_itself(make_docs):
    check_edits(make_docs([(7, "abcdef ghi")]))


def test_clashing_columns_are_ignored(make_docs):
    docs = make_docs([(1, "a b"), (2, "c d")])
    for name in ("piece", "guest", "fingerprint", "size", "digest", "kept", "bucket"):
        docs = docs.withColumn(name, docs["doc_id"])
    assert fp.fingerprint_edits(docs).count() == shard_documents(docs).count() == 2


def test_estimates_follow_the_true_shares():
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in rng.integers(0, 5000, 6000)]
    whole, part = " ".join(words), " ".join(words[:600])
    a, b = fp.sketch(part), fp.sketch(whole)
    assert fp.containment(a, b) == 1.0
    true = len(shingle_set(part.encode(), 5)) / len(shingle_set(whole.encode(), 5))
    assert fp.likeness(a, b) == pytest.approx(true, abs=0.03)


@given(st.lists(st.sampled_from("a b c d e f".split()), max_size=40), st.lists(st.sampled_from("a b c d e f".split()), max_size=40))
@settings(max_examples=60, deadline=None)
def test_merged_sketch_is_the_sketch_of_the_union(x, y):
    a, b = (shingle_set(" ".join(t).encode(), 2) for t in (x, y))
    union = fp.scaled(np.union1d(a, b), 1 / 8)
    assert fp.merge(fp.scaled(a, 1 / 8), fp.scaled(b, 1 / 8), 1 / 8).tolist() == union.tolist()
    assert fp.unpack(fp.pack(a)).tolist() == a.tolist()


def test_word_hashes_depend_on_the_word_only():
    text = b"one  two\tone\x0btwo three one"
    h, s, e = word_hashes(text)
    words = [text[i:j] for i, j in zip(s, e)]
    assert words == text.split()
    assert len(set(h.tolist())) == 3 and h[0] == h[2] == h[5]


def plain_permutation(n, seed):
    left = int(np.ceil(np.sqrt(n))) if n > 1 else 1
    while left * left < n:
        left += 1
    while left > 1 and (left - 1) ** 2 >= n:
        left -= 1
    right = -(-n // left)

    def mixed(x, key):
        h = xxhash.xxh64_intdigest(struct.pack("<q", key), seed=xxhash.xxh64_intdigest(struct.pack("<q", x), seed=42))
        return h - (1 << 64) if h >> 63 else h

    def network(v):
        a, b = divmod(v, right)
        for key in round_keys(seed):
            if key % 2 == 0:
                a = (a + mixed(b, key) % left) % left
            else:
                b = (b + mixed(a, key) % right) % right
        return a * right + b

    out = []
    for v in range(n):
        v = network(v)
        while v >= n:
            v = network(v)
        out.append(v)
    return out


@pytest.mark.parametrize("n", [1, 2, 5, 24, 97, 1000])
def test_permutation_is_the_plain_one(spark, n):
    from pyspark.sql import functions as F

    got = [r[1] for r in spark.range(n).select("id", permuted(F.col("id"), n, 2).alias("p")).orderBy("id").collect()]
    assert sorted(got) == list(range(n))
    assert got == plain_permutation(n, 2)


def test_shards_of_odd_rows(odd_docs, none_docs):
    got = shard_documents(odd_docs).collect()
    texts = {}
    for r in odd_docs.collect():
        texts.setdefault(r["doc_id"], []).append((r["text"] or "").encode())
    total = sum(map(len, texts.values()))
    place = plain_permutation(total, 2)
    assert len(got) == total
    for r in got:
        assert (r["size"] - 8, r["text_crc32"]) in [(len(t), zlib.crc32(t)) for t in texts[r["doc_id"]]]
        assert (r["shard"], r["slot"]) == (place[r["row_no"]] % 24, place[r["row_no"]] // 24)
    check_shards(got)
    assert shard_documents(none_docs).count() == 0


def check_shards(rows):
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r["slot"])
        assert r["law"] == "rows" and r["grown_shard"] is None
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    sizes = [len(by.get(k, [])) for k in range(24)]
    assert max(sizes) - min(sizes) <= 1


def test_shards_do_not_depend_on_the_partitions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    a = {tuple(r) for r in shard_documents(docs.repartition(1)).collect()}
    b = shard_documents(docs.repartition(7, "text")).collect()
    assert a == {tuple(r) for r in b}
    check_shards(b)
