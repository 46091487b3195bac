import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from seriesloom.llm.bpe import WordBpe, encode_documents

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def ours():
    with open(PATH, encoding="utf-8") as f:
        return WordBpe(f.read())


def same(ours, library, texts):
    for text, (ids, decoded), want in zip(texts, ours.encode(texts), library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == want.ids, ascii(text)
        assert decoded == library.decode(want.ids, skip_special_tokens=False) == ours.decode(np.frombuffer(ids, "<u4")), ascii(text)


LETTERS = list("abcdeéßΣσςİıIA'’stre 0123½²Ⅷ一二かなガ　\x85\xa0\x1c\x1f\t\n</w>|<|endoftext|>!?🙂👍🏽é́​\x00") + ["<|endoftext|>", "<|startoftext|>", "'ll", "don't", "é", "﻿"]


@given(st.lists(st.lists(st.sampled_from(LETTERS), max_size=40).map("".join), max_size=20))
@settings(max_examples=150, deadline=None)
def test_mixed_texts(ours, library, texts):
    same(ours, library, texts)


@given(st.text(alphabet="thearoinsxq", min_size=1, max_size=300))
@settings(max_examples=150, deadline=None)
def test_long_words(ours, library, text):
    same(ours, library, [text])


def test_very_long_words(ours, library):
    rng = random.Random(1)
    same(ours, library, ["a" * 5000 + "b" * 3000, "".join(rng.choice("thearoinxq") for _ in range(20000)), "the quick " * 20000])


def test_heap_and_list_merge_alike(ours):
    rng = random.Random(2)
    for _ in range(300):
        symbols = ours.symbols("".join(rng.choice("thearoinsé") for _ in range(rng.randint(1, 60))))
        assert ours.merged(symbols) == ours.merged_long(symbols)


def test_only_failing_words_are_merged(ours):
    before = ours.failed
    ours.learn({"the", "of", "and"})
    assert ours.failed == before


def test_kept_words_do_not_change_results(library, monkeypatch):
    import seriesloom.llm.bpe as bpe

    monkeypatch.setattr(bpe, "MOST_WORDS", 5)
    monkeypatch.setattr(bpe, "MOST_PAIRS", 5)
    with open(PATH, encoding="utf-8") as f:
        small = WordBpe(f.read())
    for _ in range(2):
        same(small, library, ["some words that are not kept, and others", "more words again: kept, and others"])


def expected_row(library, doc_id, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    decoded = library.decode(ids, skip_special_tokens=False)
    return doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


def key(row):
    return (row[0] is None, row[0] or 0, row[1:])


def check(docs, library):
    want = sorted((expected_row(library, r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()), key=key)
    assert sorted((tuple(r) for r in encode_documents(docs, PATH).collect()), key=key) == want


def test_documents(spark, library, odd_docs, none_docs):
    check(odd_docs.withColumn("ids", F.lit(1)).withColumn("n_tokens", F.lit(2)), library)
    check(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), library)
    assert encode_documents(none_docs, PATH).count() == 0


def test_ids_are_those_of_the_checksum(odd_docs):
    for r in encode_documents(odd_docs, PATH, keep_ids=True).collect():
        assert hashlib.sha256(np.array(r["ids"], "<u4").tobytes()).hexdigest() == r["ids_sha256"]
        assert len(r["ids"]) == r["n_tokens"]
