import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def make_docs(spark):
    """Documents from (doc_id, text) or (doc_id, text, lang, source)."""

    def make(rows, parts=3):
        full = [(*r, *("en", "src1")[len(r) - 2 :], len(r[1] or "")) for r in rows]
        return spark.createDataFrame(full, DOCS).repartition(parts)

    return make


@pytest.fixture
def odd_docs(make_docs):
    """Nulls, empty, white-space and long texts, ties and repeated rows."""
    long_word, long_text = "ab1é" * 3000, "the quick brown fox jumps over the lazy dog near the old river bank " * 300
    return make_docs(
        [
            (1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "one"), (5, "one"), (6, long_text), (7, long_text + "x"), (8, long_word), (9, "日本語 🙂 ok"),
            (None, "one"), (None, None), (10, "a b c d e f g h", None, None), (11, "A B C D E F G H"), (12, "12 34 !!"),
        ]
    )


@pytest.fixture
def none_docs(make_docs):
    return make_docs([])
