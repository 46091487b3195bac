import hashlib
import heapq
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesloom.llm import conversations as cv
from seriesloom.llm import repeats as rp
from seriesloom.llm import search as se
from seriesloom.llm.shingles import word_hashes

WS = "\x20\t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


# ---- word hash ----


@pytest.mark.parametrize("rounds", [4, 7, 10])
def test_words_of_mirrored_letters_differ(rounds):
    """The Thue-Morse word and its complement have equal polynomial hashes modulo 2**64, whatever the odd base."""
    word = "a"
    for _ in range(rounds):
        word += word.translate(str.maketrans("ab", "ba"))
    hashes, starts, ends = word_hashes(f" {word}\n{word.translate(str.maketrans('ab', 'ba'))} {word}".encode())
    assert hashes[0] == hashes[2] != hashes[1]
    assert (ends - starts == len(word)).all()


def test_word_hashes_tell_words_apart():
    words = [b"a" * n for n in range(1, 300)] + [b"a" * n + b"b" for n in range(1, 300)] + ["é".encode() * n for n in range(1, 200)]
    found = word_hashes(b" ".join(words))[0]
    assert len(set(found.tolist())) == len(words)
    assert word_hashes(b"  " + words[280] + b" x")[0][0] == word_hashes(words[280])[0][0]
    assert len(word_hashes(b" \t\n")[0]) == len(word_hashes(b"")[0]) == 0


# ---- repeats ----


def plain_repeats(rows, window):
    """Rows of equal id and text are one document; texts of one id go by Spark's hash of the text, given with the row."""
    out, seen = {}, set()
    for doc_id, part, text in sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0, r[1])):
        words = re.findall(WORD, text)
        gone = [False] * len(words)
        for i in range(len(words) - window + 1):
            key = tuple(words[i : i + window])
            if key in seen:
                gone[i : i + window] = [True] * window
            seen.add(key)
        kept = " ".join(w for w, g in zip(words, gone) if not g)
        out[doc_id, part] = (len(words), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def check_repeats(docs, window=20, width=4):
    rows = [tuple(r) for r in docs.select(F.col("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))), F.coalesce("text", F.lit(""))).collect()]
    want = plain_repeats(rows, window)
    got = Counter(tuple(r) for r in rp.cut_repeats(docs, window, width).collect())
    assert got == Counter((d, *want[d, p]) for d, p, _ in rows)
    return sum(x[1] for x in want.values())


def test_repeats_of_odd_rows(odd_docs, none_docs):
    named = odd_docs.withColumn("part", F.lit(1)).withColumn("spans", F.lit("x")).withColumn("_id", F.lit(2))
    assert check_repeats(named) > 0
    assert check_repeats(odd_docs, 3, 2) > 0
    assert rp.cut_repeats(none_docs).count() == 0


@pytest.mark.parametrize(("window", "width"), [(20, 4), (6, 3), (5, 5), (3, 1)])
def test_repeats_of_shared_passages(make_docs, window, width):
    rng = random.Random(window)
    common = [f"w{i}" for i in range(12)]
    passages = [[rng.choice(common) for _ in range(rng.randint(window - 2, 3 * window))] for _ in range(8)]
    rows = []
    for i in range(120):
        text = []
        for _ in range(rng.randint(0, 4)):
            part = list(rng.choice(passages))
            if rng.random() < 0.4:
                part[rng.randrange(len(part))] = rng.choice(common)
            text += part + [rng.choice(common) for _ in range(rng.randint(0, 5))]
        rows.append((rng.choice([i, i, i, i, 7, None]), rng.choice([" ", "\n", "  "]).join(text)))
    assert check_repeats(make_docs(rows, parts=5), window, width) > 0


def test_repeats_with_a_hot_passage_and_periodic_texts(make_docs):
    rng = random.Random(2)
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, " ".join(f"u{rng.randint(0, 10**6)}" for _ in range(30)) + f" {passage} " + " ".join(f"v{rng.randint(0, 3)}" for _ in range(9))) for i in range(150)]
    rows += [(200 + i, "a b " * (20 + i)) for i in range(10)] + [(300 + i, "x " * (15 + i)) for i in range(10)]
    assert check_repeats(make_docs(rows, parts=6)) > 150 * 59


def test_repeats_of_long_words_and_maximal_stretches(make_docs):
    long = " ".join("z" * (300 + i) for i in range(25))
    docs = make_docs([(1, long + " a b c"), (2, "q " + long + " d"), (3, "only these words here")])
    got = {r["doc_id"]: r for r in rp.cut_repeats(docs, keep_text=True).collect()}
    assert got[2]["text"] == "q d" and [tuple(x) for x in got[2]["repeats"]] == [(1, 26)]
    assert got[1]["repeats"] == [] and got[3]["text"] == "only these words here"


def test_a_seed_filter_that_is_full_changes_nothing(make_docs, monkeypatch):
    monkeypatch.setattr(rp, "FILTER_BITS", 5)
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice("abc") for _ in range(60))) for i in range(40)]
    assert check_repeats(make_docs(rows), 6, 3) > 0


# ---- conversations ----


def dijkstra(rows, entry, after):
    """(cost, letters, exit state): the least (cost, letters) of all ways."""
    heap, done = [(0, "", 0, entry, entry)], set()
    while heap:
        cost, letters, i, q, last = heapq.heappop(heap)
        if i > len(rows):
            return cost, letters, last
        if (i, q) in done:
            continue
        done.add((i, q))
        go = lambda c, x, n, s, end=0: heapq.heappush(heap, (cost + c, letters + x, n, s, end))  # noqa: B023, E731
        if i == len(rows):
            if after[q] < cv.NEVER:
                go(after[q], "", i + 1, 0, q)
        else:
            initial, must_go, cut_off = rows[i]
            go(2, "D", i + 1, q)
            if not must_go:
                go(1 + 5 * cut_off, "R", i + 1, 3 if q == 2 else 2)
                to = {"0s": 1, "0u": 2, "1u": 2, "2a": 3, "3u": 2}.get(f"{q}{initial}")
                if to:
                    go(5 * cut_off, "K", i + 1, to)
        go(5, "I", i, 3 if q == 2 else 2)
    return cv.NEVER, "", entry


@pytest.mark.parametrize("block", [1, 2, 5, 256])
def test_auction_finds_the_least_cheapest_edits(monkeypatch, block):
    monkeypatch.setattr(cv, "BLOCK", block)
    rng = random.Random(block)
    for _ in range(400):
        rows = [(rng.choice(["s", "u", "a", "u", "a", " ", ""]), rng.random() < 0.15, rng.random() < 0.15) for _ in range(rng.randint(0, 12))]
        after, entry = rng.choice([cv.TERMINAL, [0, *[cv.NEVER] * 3], [3, 1, 2, 0], [cv.NEVER, cv.NEVER, 4, cv.NEVER]]), rng.randint(0, 3)
        assert cv.repair(rows, entry, after) == dijkstra(rows, entry, after)
        if rows:
            want = [dijkstra(rows, q, [0 if y == x else cv.NEVER for y in range(4)])[0] for q in range(4) for x in range(4)]
            assert [min(c, cv.NEVER) for c in cv.table(rows)] == want


def test_prices_are_dual_to_the_cheapest_way():
    """No price exceeds an arc's cost and the price behind it, and they differ along the traced way by its costs."""
    rng = random.Random(6)
    for _ in range(100):
        rows = [(rng.choice("sua"), rng.random() < 0.2, rng.random() < 0.2) for _ in range(rng.randint(0, 30))]
        ways, price = cv.arcs(rows, cv.TERMINAL), cv.first_prices(rows, cv.TERMINAL)
        cv.auction(ways, price, 0)
        assert all(price[at] <= cost + price[to] for at, found in enumerate(ways) for cost, to, _ in found)
        assert price[0] == dijkstra(rows, 0, cv.TERMINAL)[0]


def plain_repair(rows):
    talks = defaultdict(list)
    for conv, turn, role, text in rows:
        talk = talks[conv]
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        talk += [(turn, "user" if kind == 4 else role, text, copy) for copy in range(0 if kind == 0 else 2 if kind == 3 else 1)]
    out = {}
    for conv, talk in talks.items():
        talk.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode(), r[3]))
        turns = [r[0] for r in talk if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        seen, faults = set(), []
        for _, role, text, _ in talk:
            text_end = text.rstrip(WS)
            faults.append("blank" if not text_end else "duplicate" if (role, text) in seen else "truncated" if text_end[-1] not in ".!?" else None)
            seen.add((role, text))
        initials = [r[1][:1] for r in talk]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, letters, _ = dijkstra([(r, f in ("blank", "duplicate"), f == "truncated") for r, f in zip(initials, faults)], 0, [0, cv.NEVER, cv.NEVER, 0])
        lines, at, state = [], 0, 0
        for x in letters:
            given = "assistant" if state == 2 else "user"
            if x in "IR":
                lines.append(f"{given}:{talk[at][2] if x == 'R' else ''}")
                state = 3 if state == 2 else 2
            if x == "K":
                lines.append(f"{talk[at][1]}:{talk[at][2]}")
                state = {"s": 1, "u": 2, "a": 3}[initials[at]]
            at += x != "I"
        out[conv] = (gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, letters, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def check_talks(talks):
    want = plain_repair([tuple(r) for r in talks.select("conv_id", "turn", "role", "text").collect()])
    got = cv.repair_damage(talks).collect()
    assert {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in got} == want and len(got) == len(want)


TALKS = "conv_id long, turn long, role string, text string"


def random_talks(rng, convs, longest):
    ends = [".", "!", "?", "", " ", ". ", "\n"]
    return [
        (c, t if rng.random() < 0.9 else rng.choice([None, t - 1]), rng.choice(["user", "assistant", "user", "assistant", "system", None, "tool", ""]),
         rng.choice([None, "", " \t", *[f"text {rng.randint(0, 30)}" + rng.choice(ends) for _ in range(9)]]))
        for c in convs for t in range(rng.randint(0, longest))
    ]


def test_conversations_of_the_small_table(spark):
    check_talks(spark.read.parquet("/root/testdata/sf0.001/conversations.parquet"))


def test_odd_conversations(spark):
    rows = random_talks(random.Random(1), [None, *range(60)], 12) + [(100, None, None, None), (101, 3, "user", "x" * 200_000 + "."), (None, 1, "user", "a.")]
    extra = {c: F.lit(1) for c in ("kind", "copy", "said", "first", "_conv", "piece", "fault")}
    check_talks(spark.createDataFrame(rows, TALKS).repartition(4).withColumns(extra))
    assert cv.repair_damage(spark.createDataFrame([], TALKS)).count() == 0


def test_a_conversation_with_most_of_all_rows_is_cut_into_ranges(spark, monkeypatch):
    monkeypatch.setattr(cv, "BLOCK", 16)
    rng = random.Random(8)
    hot = [(5, t, rng.choice(["user", "assistant"]) if rng.random() < 0.3 else ("user", "assistant")[t % 2], f"t{rng.randint(0, 900)}" + rng.choice([".", ".", ""])) for t in range(600)]
    talks = spark.createDataFrame(hot + random_talks(rng, [1, 2, 9, 11], 10) + [(7, None, "user", "same.")] * 40, TALKS).repartition(4)
    rows = cv.with_faults(cv.damaged(talks)).repartitionByRange(4, F.col("conv_id"), *cv.row_order())
    assert rows.where("conv_id = 5").select(F.spark_partition_id()).distinct().count() > 1
    check_talks(talks)


# ---- search ----


def plain_search(rows, items, k=10):
    term = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    docs = [(d, Counter(term(t)), len(term(t))) for d, t in rows]
    size, total = sum(n > 0 for *_, n in docs), sum(n for *_, n in docs)
    df = Counter(w for _, c, _ in docs for w in c)
    out = Counter()
    for item, text in set(items):
        found = []
        for d, counts, n in docs:
            m = 25 + 75 * n * size // max(1, total)
            score = sum(math.floor(1000 * math.log((2 * size + 2) / (2 * df[w] + 1))) * (10**9 * counts[w] // (1000 * counts[w] + 8 * m)) for w in term(text) if counts[w])
            if score > 0:
                found.append((-score, d is None, d or 0))
        for rank, (score, no_id, d) in enumerate(sorted(found)[:k], 1):
            out[item, rank, None if no_id else d, -score] += 1
    return out


def check_search(docs, items, k=10):
    got = Counter(tuple(r) for r in se.ranked(docs, items, k).collect())
    assert got == plain_search([tuple(r) for r in docs.select("doc_id", "text").collect()], [tuple(r) for r in items.select("item_id", "text").collect()], k)
    return sum(got.values())


ITEMS = "item_id long, text string"


def test_search_of_odd_rows(spark, odd_docs, none_docs):
    items = spark.createDataFrame([(1, "one TWO ok"), (2, None), (3, ""), (4, "日本語 🙂"), (5, "quick fox; quick"), (6, "one TWO ok"), (6, "one TWO ok"), (6, "river"), (None, "one"), (7, "ab1é" * 3000)], ITEMS)
    extra = {c: F.lit(1) for c in ("item", "score", "rank", "terms", "payload")}
    assert check_search(odd_docs.withColumns(extra), items.withColumns(extra)) == 20
    assert se.ranked(none_docs, items).count() == 0
    assert se.ranked(odd_docs, items.where("false")).count() == 0


@pytest.mark.parametrize(("shard", "block", "bytes_"), [(16 << 20, 128, 8 << 20), (3000, 4, 8 << 20), (700, 1, 200)])
def test_search_over_many_shards_and_blocks(spark, make_docs, monkeypatch, shard, block, bytes_):
    monkeypatch.setattr(se, "ITEM_BYTES", bytes_)
    monkeypatch.setattr(se, "SHARD_BYTES", shard)
    monkeypatch.setattr(se, "BLOCK", block)
    rng = random.Random(block)
    vocabulary = [f"w{i}" for i in range(60)]
    pick = lambda n: " ".join(vocabulary[min(59, int(rng.paretovariate(0.6)) - 1)] for _ in range(n))
    docs = make_docs([(rng.choice([i, i, None, 3]) if i % 9 == 0 else i, pick(rng.choice([1, 5, 20, 60]))) for i in range(250)] + [(500 + i, "w0 w0 w1") for i in range(30)], parts=3)
    items = spark.createDataFrame([(i, pick(rng.randint(1, 15))) for i in range(30)], ITEMS)
    assert check_search(docs, items) > 100


def test_block_bounds_hold_and_spare_blocks():
    rng = np.random.default_rng(3)
    texts = [("rare " * (i % 97 == 0) + "often " * int(rng.integers(1, 9)) + "pad " * int(rng.integers(1, 400))).encode() for i in range(4000)]
    vocabulary = np.unique(se.Joined([b"rare often"], se.BETWEEN).hashes)
    row = se.shard_row(np.arange(4000), np.ones(4000, bool), texts, vocabulary)
    names = [part.split()[0] for part in se.SHARD.split(", ")]
    shard = se.Shard(dict(zip(names, [x.tolist() if isinstance(x, np.ndarray) else x for x in row])), 4000, 800_000)
    for b in range(len(shard.blocks)):
        assert shard.block(b)[1].max() <= shard.bound[b]
    shard.open.clear()
    rare, often = (int(np.searchsorted(vocabulary, se.Joined([w], se.BETWEEN).hashes[0])) for w in (b"rare", b"often"))
    shard.best({rare: 9000, often: 10})
    assert len(shard.open) < len(shard.blocks) / 2
