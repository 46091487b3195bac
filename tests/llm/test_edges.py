"""Clashing names, empty tables, plain versions of the language model and of the span labelers, and what each contract says about case."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

import corpus_pipeline
from seriesloom.llm import language_id as li
from seriesloom.llm import lattice, mixing, pii
from seriesloom.llm import lm_scoring as lm
from seriesloom.llm.exact_dedup import drop_copies
from seriesloom.llm.near_dedup import drop_near_copies
from seriesloom.llm.queries import tokenizer_path

ODD_NAMES = ("digest", "_digest", "_first", "_keep", "keep_id", "_gone", "gone", "row", "id", "sum", "turn", "_turn", "_copies", "copies", "_doc_id", "_check", "check",
             "place", "lang_pred", "lang_score", "lang_held_out", "domain", "tree_lang", "tree_source", "kept", "component_id")


@pytest.fixture
def clashing(odd_docs):
    return odd_docs.withColumns({c: F.concat(F.lit(f"{c}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))) for c in ODD_NAMES})


def untouched(df):
    rows = df.collect()
    assert all(r[c] == f"{c}:{'-' if r['doc_id'] is None else r['doc_id']}" for r in rows for c in ODD_NAMES)
    return rows


@pytest.mark.parametrize("stage", [s for s, _ in corpus_pipeline.STAGES[:-1]])
def test_stages_keep_columns_of_any_name(spark, clashing, stage):
    out = dict(corpus_pipeline.STAGES)[stage](spark, clashing, "")
    assert out.columns == clashing.columns
    rows = untouched(out)
    assert rows and dict(corpus_pipeline.STAGES)[stage](spark, clashing.limit(0), "").count() == 0


def test_pipeline_over_an_empty_table_and_over_odd_rows(spark, clashing, tmp_path):
    clashing.limit(0).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
    clashing.write.parquet(str(tmp_path / "odd" / "documents.parquet"))
    ids = Counter(r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path / "odd")).collect())
    assert ids and set(ids) <= {r["doc_id"] for r in clashing.collect()}


def test_droppers_and_mix_keep_columns_of_any_name(clashing):
    for kept in (drop_copies(clashing), drop_near_copies(clashing), mixing.mix(clashing, F.lit("d"), share=1.0, epochs=2)):
        assert kept.columns == clashing.columns and untouched(kept)


def test_a_source_called_none_is_no_null(spark):
    rows = [(i, "a b c d", "en", s, 7) for i, s in enumerate(["(none)"] * 6 + [None] * 3 + ["x"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = mixing.mix_copies(docs, F.lit("d"), share=0.5, epochs=1).collect()
    assert {r["doc_id"]: r["leaf_tokens"] for r in out} == {i: 24 if i < 6 else 12 if i < 9 else 4 for i in range(10)}


def test_rows_of_one_id_and_checksum_keep_their_own_copies(spark):
    docs = spark.createDataFrame([(1, "a b", "en", "big", 3), (1, "a b", "en", "small", 3)], "doc_id long, text string, lang string, source string, n_chars long")
    out = mixing.mix(docs, F.lit("d"), share=0.5, epochs=2, source_weights={"big": 1.0, "small": 0.0})
    assert [r["source"] for r in out.collect()] == ["big"]


def test_lm_score_folds_ascii_only(spark, make_docs):
    docs = make_docs([(i, "élan école été") for i in range(1, 20)] + [(100, "élan"), (101, "Élan"), (102, "LAN"), (103, "lan")])
    got = {r["doc_id"]: (r["score"], r["base_score"]) for r in lm.score_documents(docs, tokenizer_path("piece_bpe_32k.model")).collect()}
    assert got[100][0] != got[101][0] and got[100][1] != got[101][1]
    assert got[102] == got[103]


# ---- language model by enumeration ----


def segmentations(word, pieces):
    if not word:
        return [[]]
    return [[word[:n], *rest] for n in range(1, len(word) + 1) if word[:n] in pieces for rest in segmentations(word[n:], pieces)]


def plain_languages(train, names, first, rounds=li.ROUNDS):
    """Piece probabilities of each language, by counting the pieces of all segmentations by their probability."""
    usable = {p for p in names if not re.fullmatch("<0x..>", p) and p not in ("<unk>", "<s>", "</s>") and lattice.START not in p[1:]}
    place = {p: i for i, p in enumerate(names)}
    counts = defaultdict(Counter)
    for lang, text in train:
        counts[lang].update(w.lower() for w in text.split())
    logs = {lang: first.copy() for lang in counts}
    for _ in range(rounds):
        for lang, words in counts.items():
            uses = np.full(len(names), li.SMOOTHING)
            for word, n in words.items():
                ways = segmentations(lattice.START + word, usable)
                weights = [math.exp(sum(logs[lang][place[p]] for p in way)) for way in ways]
                for way, w in zip(ways, weights):
                    for p in way:
                        uses[place[p]] += n * w / sum(weights)
            logs[lang] = np.log(uses / uses.sum())
    return logs, usable, place


def test_language_shares_match_enumeration(spark, make_docs):
    english, german = "the cat sat on the mat and ran", "der hund lag in dem haus und schlief"
    rows = [(i, english if i % 2 else german, "en" if i % 2 else "de", "s") for i in range(1, 13)] + [(50 + i, t, None, "s") for i, t in enumerate(["The haus cat", "hund sat", "and", "DEM", "das ran"])]
    docs = make_docs(rows)
    path = tokenizer_path("piece_bpe_32k.model")
    got = {r["doc_id"]: (r["lang_pred"], r["lang_score"]) for r in li.identify(docs.select("doc_id", "text", "lang"), path).collect()}
    held = {r["doc_id"] for r in docs.where(F.crc32(F.col("doc_id").cast("string")) % 3 == 1).collect()}
    names, first = lattice.load_pieces(path)
    logs, usable, place = plain_languages([(lang, t) for i, t, lang, _ in rows if lang and i not in held], names, first)
    for i, text, _, _ in rows:
        total = {}
        for lang, p in logs.items():
            total[lang] = sum(math.log(sum(math.exp(sum(p[place[x]] for x in way)) for way in segmentations(lattice.START + w.lower(), usable))) for w in text.split())
        best = max(total, key=total.get)
        share = 1 / sum(math.exp(v - total[best]) for v in total.values())
        assert got[i][0] == best and got[i][1] == pytest.approx(share, rel=1e-6)


# ---- labelers, reliabilities and classifier in plain Python ----


def plain_votes(kind, match, before):
    number = re.sub("[^0-9]", "", match)
    word = lambda words: rf"(?i)(?<![a-z])(?:{'|'.join(words.split())})(?![a-z])"
    on = lambda yes, no=-1: 1 if yes else no
    pattern = {
        "email": lambda: on(re.search(r"[@\])][^@]*[A-Za-z]{2,}\Z", match), 0), "ip": lambda: 0 if re.search(r"^0|\.0[0-9]", match) else 1, "card": lambda: 1,
        "phone": lambda: 1 if re.search(r"^1?[2-9][0-9]{2}[2-9][0-9]{6}\Z", number) else 0 if re.search(r"^(.)\1+\Z", number) else -1,
        "ssn": lambda: 0 if re.search(r"^(000|666|9)|^...00|0000\Z", number) else 1, "name": lambda: 1,
    }[kind]()
    gazetteer = {
        "email": lambda: on(re.search(rf"(?i)[. )\]](?:{'|'.join(pii.TOP_DOMAINS.split())})\Z", match)), "ip": lambda: 0 if re.search(r"^(?:0|127|255)\.", match) else -1,
        "card": lambda: on(re.search("^(?:4|5[1-5]|2[2-7]|3[47]|6)", number), 0), "name": lambda: on(regex.search(word(pii.GIVEN_NAMES), match)),
    }.get(kind, lambda: -1)()
    return pattern, gazetteer, on(re.search(word(pii.CUES), before)), 0 if re.search(word(pii.AGAINST) + r"|[#=]\Z", before) else -1


def plain_added(texts, base_of):
    """Added spans of every text: votes, expectation-maximisation, logistic regression on the posteriors."""
    spans = []
    for doc, text in texts.items():
        base = base_of(text)
        rows, ends = [], Counter()
        for kind, start, end in base:
            rows.append((kind, start, end, False))
        for kind, pattern, _ in pii.LOOSE:
            found = [(m.start(), m.end()) for m in regex.finditer(pattern, text)]
            rows += [(kind, s, e, True) for s, e in found if not any(b[1] < e and s < b[2] for b in base)]
        for kind, s, e, loose in rows:
            # the text since the last match of the same pattern, cut to the window before the span
            earlier = max([m.end() for k, p, _ in (pii.LOOSE if loose else pii.STRICT) if k == kind for m in regex.finditer(p, text) if m.end() <= s], default=0)
            before = text[max(earlier, s - pii.BEFORE) : s]
            match = text[s:e]
            features = (" " in match, bool(re.search(r"[:(]\s*\Z", before)), bool(re.search("[0-9]", match)))
            spans.append((doc, s, e, kind, loose, plain_votes(kind, match, before), features))
    right, prior, sure = np.full(4, 0.8), defaultdict(lambda: 0.5), {}
    for _ in range(50):
        good, total, mass, size = np.full(4, 4.0), np.full(4, 5.0), defaultdict(lambda: 1.0), defaultdict(lambda: 2.0)
        for i, (_, _, _, kind, loose, votes, _) in enumerate(spans):
            yes, no = prior[kind, loose], 1 - prior[kind, loose]
            for v, r in zip(votes, right):
                if v >= 0:
                    yes, no = yes * (r if v else 1 - r), no * (1 - r if v else r)
            p = sure[i] = yes / (yes + no)
            mass[kind, loose] += p
            size[kind, loose] += 1
            for j, v in enumerate(votes):
                if v >= 0:
                    good[j] += p if v else 1 - p
                    total[j] += 1
        right = np.clip(good / total, 0.55, 0.99)
        prior = {k: float(np.clip(mass[k] / size[k], 0.02, 0.98)) for k in size}
    x = np.array([[*(float(kind == k) for k in pii.KINDS), float(loose), *(0.0 if v < 0 else 2.0 * v - 1 for v in votes), *map(float, features), 1.0] for _, _, _, kind, loose, votes, features in spans])
    y, w = np.array([sure[i] for i in range(len(spans))]), np.zeros(x.shape[1])
    decay = np.r_[np.full(x.shape[1] - 1, 1e-3), 0.0]
    for _ in range(400):
        w = w - 0.5 * (x.T @ (1 / (1 + np.exp(-x @ w)) - y) / len(x) + decay * w)
    out = defaultdict(list)
    for (doc, s, e, kind, loose, *_), score in sorted(zip(spans, x @ w), key=lambda r: (r[0][0], r[0][1], pii.KINDS.index(r[0][3]), r[0][2])):
        if loose and score > 0 and not any(a < e and s < b for _, a, b in out[doc]):
            out[doc].append((kind, s, e))
    return out


def test_added_spans_match_plain_python(make_docs):
    from test_pii_toxicity import plain_base

    words = ["call 555-123-4567 now", "phone: (212) 555 0199", "order 555-123-4567", "ssn 123-45-6789", "part #000-12-3456", "write joe.doe (at) mail (dot) com", "ann[at]site.org",
             "Dr. Anna Schmidt", "Mr Quick Fox", "Madame Marie", "mail a@b.com", "ip 10.0.0.1", "+1 212 555 0100", "version 127.0.0.1", "nothing here", "ssn: 219-09-9999, tel. 415.555.2671 or +49 30 123456789"]
    texts = {i: " and ".join(words[(i * k + k) % len(words)] for k in range(1, 1 + i % 5)) for i in range(120)}
    got = {r["doc_id"]: set(r["spans"].split(",")) - {""} for r in pii.personal_data(make_docs(list(texts.items()))).collect()}
    added = plain_added(texts, plain_base)
    assert sum(map(len, added.values())) > 50
    for doc, text in texts.items():
        assert got[doc] == {f"{k}:{s}:{e}" for k, s, e in [*plain_base(text), *added[doc]]}, text
