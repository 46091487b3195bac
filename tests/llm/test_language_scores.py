import math
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from seriesloom.llm import lm_scoring
from seriesloom.llm.lattice import LONG, START, Lattice, Words, WordScores, load_pieces
from seriesloom.llm.language_id import UNKNOWN, identify
from seriesloom.llm.lm_scoring import score_documents

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def vocabulary():
    pieces, logs = load_pieces(PATH)
    return pieces, logs, Lattice(pieces)


def plain_forward(word, pieces, logs, lattice):
    ids = {p: i for i, p in enumerate(pieces) if not p.startswith("<0x") and p not in ("<unk>", "<s>", "</s>") and START not in p[1:]}
    text = START + word
    total = [0.0] + [-math.inf] * len(text)
    for j in range(1, len(text) + 1):
        terms = []
        for i in range(max(0, j - lattice.reach), j):
            if text[i:j] in ids:
                terms.append(total[i] + logs[ids[text[i:j]]])
            elif j == i + 1:
                terms.append(total[i] + sum(logs[lattice.byte_ids[b]] for b in text[i:j].encode()))
        total[j] = np.logaddexp.reduce(terms)
    return total[-1]


WORDS = ["the", "a", "thstion", "été", "日本語🙂x", "x" * (LONG + 30), "ab<c", "1,234.5", "ｆｕｌｌ"]


def test_forward_sums_all_segmentations(vocabulary):
    pieces, logs, lattice = vocabulary
    got = lattice.forward(WORDS, np.stack([logs, logs - 1], 1))
    assert got[:, 0] == pytest.approx([plain_forward(w, *vocabulary) for w in WORDS])
    assert got[:, 1] == pytest.approx([plain_forward(w, pieces, logs - 1, lattice) for w in WORDS])


def test_expected_uses_are_the_derivative(vocabulary):
    """The expected count of a piece is the derivative of the log probability by the piece's log weight."""
    _, logs, lattice = vocabulary
    counts = np.arange(1.0, len(WORDS) + 1)
    uses = lattice.expected(WORDS, counts, logs)
    for piece in np.random.default_rng(1).choice(np.flatnonzero(uses > 1e-3), 12, replace=False):
        moved = logs.copy()
        moved[piece] += 1e-5
        slope = ((lattice.forward(WORDS, moved[:, None]) - lattice.forward(WORDS, logs[:, None]))[:, 0] * counts).sum() / 1e-5
        assert uses[piece] == pytest.approx(slope, rel=1e-2, abs=1e-3)


def held_out(doc_id, of, rest):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % of == rest


def plain_base(rows):
    words = {i: re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower()) for i, (_, t) in enumerate(rows)}
    counts = Counter()
    for i, (d, _) in enumerate(rows):
        if not held_out(d, 7, 2):
            counts.update([*words[i], None])
    n, v = sum(counts.values()), len(counts)
    out = []
    for i, (d, _) in enumerate(rows):
        tokens = [*words[i], None]
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens)
        out.append((d, held_out(d, 7, 2), len(tokens), sum(counts[w] > 0 for w in tokens), n, base))
    return out


def order(row):
    return (row[0] is not None, row[0] or 0, row[2], row[5])


def check_base(docs):
    rows = [(r[0], r[1]) for r in docs.select("doc_id", "text").collect()]
    got = score_documents(docs, PATH).collect()
    want = sorted(plain_base(rows), key=order)
    for g, w in zip(sorted((tuple(r) for r in got), key=order), want, strict=True):
        assert g[:5] == w[:5]
        assert g[5] == pytest.approx(w[5], rel=1e-9)
        assert g[6] < 0
    return got


def test_kept_words_are_small_and_change_nothing(vocabulary, monkeypatch):
    pieces, logs, _ = vocabulary
    logs = np.stack([logs, logs[::-1], logs * 2, logs - 1], 1)
    rng = random.Random(7)
    texts = [" ".join(f"w{rng.randint(0, 20_000)}" for _ in range(4000)).encode() for _ in range(6)]
    scores, plain = WordScores(pieces, logs), WordScores(pieces, logs)
    monkeypatch.setattr(plain, "MOST", 0)
    tracemalloc.start()
    before = tracemalloc.get_traced_memory()[0]
    for i in range(0, 6, 2):
        scores.of(Words(texts[i : i + 2]))
    grown = tracemalloc.get_traced_memory()[0] - before
    tracemalloc.stop()
    assert grown < 100 * len(Words(texts).hashes)
    monkeypatch.setattr(scores, "MOST", 5000)
    for words in (Words(texts), Words(texts[:1]), Words([]), Words([b"new words here w1"])):
        assert np.array_equal(scores.of(words), plain.of(words))


@pytest.mark.parametrize("frequent", [1 << 19, 3])
def test_word_scores_of_odd_rows(odd_docs, none_docs, monkeypatch, frequent):
    monkeypatch.setattr(lm_scoring.frequent_words, "__defaults__", (frequent,))
    check_base(odd_docs.withColumn("word", F.lit("x")).withColumn("uid", F.lit(1)))
    assert score_documents(none_docs, PATH).count() == 0


@pytest.mark.parametrize("frequent", [1 << 19, 500])
def test_scores_of_the_table(spark, monkeypatch, frequent):
    monkeypatch.setattr(lm_scoring.frequent_words, "__defaults__", (frequent,))
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = check_base(docs)
    # on held-out documents with unknown words the pieces do better for a token than any constant guess over the letters
    rest = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in rest) / sum(r["n_tokens"] for r in rest) > -8


def test_score_is_the_sum_over_words_and_end(spark, make_docs, vocabulary):
    pieces, logs, lattice = vocabulary
    docs = make_docs([(i, t) for i, t in enumerate(["The cat sat", "the dog", "a cat and a dog", "été the"])])
    counts, ends = Counter(), 0
    for r in docs.collect():
        if not held_out(r["doc_id"], 7, 2):
            counts.update(w.decode() for w in r["text"].encode().lower().split())
            ends += 1
    for _ in range(lm_scoring.ROUNDS):
        uses = lattice.expected(list(counts), np.array(list(counts.values()), float), logs) + lm_scoring.SMOOTHING
        uses[lattice.end] += ends
        logs = np.log(uses / uses.sum())
    for r in score_documents(docs, PATH).join(docs.select("doc_id", "text"), "doc_id").collect():
        want = lattice.forward([w.decode() for w in r["text"].encode().lower().split()], logs[:, None]).sum() + logs[lattice.end]
        assert r["score"] == pytest.approx(want / math.log(10), rel=1e-9)


def test_language_of_the_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = identify(docs, PATH).where("lang_held_out").collect()
    assert len(got) > 250
    assert sum(r["lang"] == r["lang_pred"] for r in got) / len(got) > 0.97
    assert all(0 <= r["lang_score"] <= 1 for r in got)


def test_language_of_odd_rows(odd_docs, none_docs):
    docs = odd_docs.withColumn("lang_pred", F.lit("x")).withColumn("extra", F.current_timestamp())
    got = identify(docs, PATH)
    assert set(docs.columns) <= set(got.columns)
    rows = got.collect()
    assert len(rows) == 15
    for r in rows:
        letters = any(map(str.isalpha, r["text"] or ""))
        assert (r["lang_pred"] == UNKNOWN) == (not letters)
        assert (r["lang_score"] == 0) == (not letters)
    assert identify(none_docs, PATH).count() == 0


def test_nothing_to_learn_from(make_docs):
    rows = identify(make_docs([(1, "some words", None, None), (2, "more", None, None)]), PATH).collect()
    assert [(r["lang_pred"], r["lang_score"]) for r in rows] == [(UNKNOWN, 0.0)] * 2


def test_prediction_uses_the_text_only(make_docs):
    rng = random.Random(4)
    en, de = "the cat sat on the mat and the dog ran".split(), "der hund und die katze sind nicht im haus".split()
    rows = [(i, " ".join(rng.choices(en if i % 2 else de, k=12)), "en" if i % 2 else "de", "s") for i in range(80)]
    rows += [(i + 1000, t, "de" if lang == "en" else "en", "other") for i, t, lang, _ in rows if held_out(i + 1000, 3, 1)]
    got = defaultdict(set)
    for r in identify(make_docs(rows), PATH).collect():
        got[r["text"]].add((r["lang_pred"], round(r["lang_score"], 9)))
    assert all(len(v) == 1 for v in got.values())
