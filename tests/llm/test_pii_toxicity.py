import hashlib
import random
import re
from importlib import import_module

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from seriesloom.llm import pii
from seriesloom.llm.toxicity import fit_chain, toxicity

#: The fixed rules, as given.
RULES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def holds(kind, match):
    digits = [int(c) for c in match if c.isdigit()]
    if kind == "ip":
        return all(int(p) <= 255 for p in match.split("."))
    if kind == "card":
        worth = [d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(reversed(digits))]
        return 14 <= len(digits) <= 19 and sum(worth) % 10 == 0
    return kind == "email" or 10 <= len(digits) <= 15


def plain_base(text):
    found = [(m.start(), k, m.end(), kind) for k, (kind, rule) in enumerate(RULES.items()) for m in re.finditer(rule, text or "", re.ASCII) if holds(kind, m.group())]
    return [(kind, s, e) for s, _, e, kind in sorted(found)]


def check(docs):
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = pii.personal_data(docs).collect()
    for r in rows:
        base = plain_base(texts[r["doc_id"]])
        assert (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) == tuple(sum(b[0] == k for b in base) for k in RULES), ascii(texts[r["doc_id"]])
        named = [f"{k}:{s}:{e}" for k, s, e in base]
        assert r["base_sha256"] == hashlib.sha256(",".join(named).encode()).hexdigest(), ascii(texts[r["doc_id"]])
        spans = r["spans"].split(",") if r["spans"] else []
        assert set(named) <= set(spans)
        added = sorted(tuple(map(int, s.split(":")[1:])) for s in spans if s not in named)
        others = [(s, e) for _, s, e in base] + added
        assert all(a == b or a[1] <= b[0] or b[1] <= a[0] for a in added for b in others)
    return {r["doc_id"]: r for r in rows}


def test_spans_of_odd_rows(odd_docs, none_docs):
    rows = odd_docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).withColumn("base", F.lit(1)).withColumn("loose", F.lit(1))
    assert len(check(rows)) == 12
    assert pii.personal_data(odd_docs).count() == 15
    assert pii.personal_data(none_docs).count() == 0


CASES = [
    "a@b.com_x@d.e", "x@y.z.w@q.r", "..@-.-", "a@b..c a@b", "%+@1.2", "🙂a.b@c.de🙂 b@c.de", "1.2.3.4.5.6.7.8", "1.2.3.4.5", "256.1.1.1 0255.1.1.1", "1.1.1.1.", "001.2.3.400",
    "4111 1111 1111 1111", "4111-1111-1111-1111x4111111111111111", "1 4111111111111111", "4111111111111111 2", "12  4111111111111111", "5" * 40, "4111111111111111" * 3,
    "+1 (988) 555-2485", "+49 30 1234567 x", "++1 234 567 8901", "+1", "+12345678901234567", "+1 2+3 456 789 012 34", "+1-----2345678901", "0" * 30 + ".1.1.1",
]


def test_base_spans_of_hard_cases(make_docs):
    check(make_docs(list(enumerate(CASES))))


def test_base_spans_of_random_strings(make_docs):
    rng = random.Random(9)
    alphabets = ["a@.-_%+ ", "0123456789 .-", "+0123456789 ()-.", "a@b.c1+2 -(é🙂", "012.5"]
    check(make_docs([(i, "".join(rng.choice(alphabets[i % 5]) for _ in range(rng.randint(0, 60)))) for i in range(1500)]))


def test_long_runs_are_read_once(make_docs):
    n = 60_000
    check(make_docs([(1, "a" * n), (2, "1" * n), (3, "1 " * n), (4, "+1" * n), (5, "a." * n + "@b.c"), (6, "1." * n), (7, "a@b" + ".c" * n), (8, "(" * n)]))


def test_added_spans_and_clean_texts(make_docs):
    rows = check(
        make_docs(
            [(i, f"Please call our office, phone: (212) 555-{1000 + i} or mail to jane{i} [at] example [dot] com for help") for i in range(40)]
            + [(100 + i, "the order was placed in the version of that release and nothing else is in it") for i in range(40)]
        )
    )
    assert all("phone:" in rows[i]["spans"] and "email:" in rows[i]["spans"] for i in range(40))
    assert all(not rows[100 + i]["spans"] for i in range(40))


@given(st.dictionaries(st.tuples(st.integers(0, 5), st.booleans(), st.tuples(*[st.sampled_from([-1, 0, 1])] * 4)), st.integers(1, 1000), min_size=1, max_size=30))
@settings(max_examples=40, deadline=None)
def test_posteriors_are_probabilities(counts):
    assert all(0 < p < 1 for p in pii.posteriors(counts).values())


def test_reliable_votes_count_more():
    """A labeler that agrees with two others is believed against one that is at odds with them."""
    counts = {(3, True, (1, 1, 1, -1)): 50, (3, True, (0, 0, 0, -1)): 50, (3, True, (1, 1, 0, -1)): 5, (3, True, (0, 0, 1, -1)): 5, (3, True, (1, 0, 1, -1)): 1}
    sure = pii.posteriors(counts)
    assert sure[3, True, (1, 1, 1, -1)] > sure[3, True, (1, 1, 0, -1)] > 0.5 > sure[3, True, (0, 0, 1, -1)] > sure[3, True, (0, 0, 0, -1)]


def labelled(spark, make_docs, n=400):
    rng = random.Random(6)
    calm, rude = [f"w{i}" for i in range(60)], ["".join(c) for c in ("grob", "mies", "fies")]
    rows, marks = [], []
    letters = "abcdefghijklmnopqrstuvwxyz"
    calm = ["".join(rng.choices(letters, k=5)) for _ in range(60)]
    for i in range(n):
        toxic = i % 4 == 0
        words = rng.choices(calm, k=rng.randint(5, 60)) + (rng.choices(rude, k=2) if toxic else [])
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
        if i % 2 == 0 or toxic:
            marks.append((i, 0 if toxic else 1, int(toxic)))
    return make_docs(rows), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")


def test_chain_finds_the_toxic_documents(spark, make_docs):
    docs, labels = labelled(spark, make_docs)
    got = {r["doc_id"]: r for r in toxicity(docs.withColumn("_words", F.lit(1)).withColumn("p_toxic", F.lit(1)), labels).collect()}
    hits = sum(got[i]["is_toxic"] == (i % 4 == 0) for i in range(400))
    assert hits >= 396
    assert all(0 <= r[c] <= 1 for r in got.values() for c in ("p_low_quality", "p_toxic"))


def test_later_models_read_earlier_probabilities(spark, make_docs):
    docs, labels = labelled(spark, make_docs)
    chain = fit_chain(docs, labels, {"low_quality": 1 - F.col("quality"), "toxic": F.col("toxic")})
    first, second = (s.model.coefficients.size for s in chain.steps)
    assert second == first + 1


def test_fits_read_few_partitions(spark, make_docs, monkeypatch):
    """Also where a table comes back from storage in many: every pass of a fit is a task for each of them."""
    chain, seen = import_module("seriesloom.llm.toxicity"), []
    fit_step = chain.fit_step
    monkeypatch.setattr(chain, "fit_step", lambda rows, *a: seen.append(rows.rdd.getNumPartitions()) or fit_step(rows, *a))
    small = {"spark.sql.files.maxPartitionBytes": "2k", "spark.sql.files.openCostInBytes": "1k"}
    docs, labels = labelled(spark, make_docs)
    try:
        for key, value in small.items():
            spark.conf.set(key, value)
        chain.fit_chain(docs, labels, {"low_quality": 1 - F.col("quality"), "toxic": F.col("toxic")})
    finally:
        for key in small:
            spark.conf.unset(key)
    assert len(seen) == 8 and max(seen) <= 8


def test_fits_carry_no_names_of_words(spark, make_docs, monkeypatch):
    """A name for every number of a vector would go with each plan, file and task of the fits."""
    learner, seen = import_module("seriesloom.llm.toxicity").LogisticRegression, []
    fit = learner.fit
    monkeypatch.setattr(learner, "fit", lambda self, rows: seen.append(rows.schema["_in"].metadata["ml_attr"]) or fit(self, rows))
    docs, labels = labelled(spark, make_docs)
    chain = fit_chain(docs, labels, {"low_quality": 1 - F.col("quality"), "toxic": F.col("toxic")})
    size = len(chain.vectors.vocabulary)
    assert seen == [{"num_attrs": size}] * 4 + [{"num_attrs": size + 1}] * 4


def test_toxicity_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    train, rest = labels.where("doc_id % 3 > 0"), {r["doc_id"]: r["toxic"] for r in labels.where("doc_id % 3 = 0").collect()}
    got = {r["doc_id"]: r["is_toxic"] for r in toxicity(docs, train).where("doc_id % 3 = 0").collect()}
    hits = sum(bool(got[d]) and bool(t) for d, t in rest.items())
    assert hits >= 0.9 * sum(rest.values())
    assert sum(bool(got[d]) for d in rest) <= 1.1 * hits


@pytest.mark.parametrize("kind", ["none", "single", "null"])
def test_toxicity_without_usable_labels(spark, odd_docs, none_docs, kind):
    marks = {"none": [], "single": [(4, 1, 0), (6, 1, 0)], "null": [(4, None, None), (None, 1, 1)]}[kind]
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    rows = toxicity(odd_docs, labels).collect()
    assert len(rows) == 15 and not any(r["is_toxic"] for r in rows)
    assert toxicity(none_docs, labels).count() == 0


def test_toxicity_of_odd_rows(spark, odd_docs):
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(1, 13)], "doc_id long, quality int, toxic int")
    assert toxicity(odd_docs, labels).count() == 15
