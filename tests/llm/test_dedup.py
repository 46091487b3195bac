import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesloom.llm import exact_dedup as ed
from seriesloom.llm import near_dedup as nd
from seriesloom.llm.components import components


def plain_exact(rows):
    groups = defaultdict(list)
    for d, t in rows:
        groups[t or ""].append(d)
    out = Counter()
    for t, ids in groups.items():
        keep = max((d for d in ids if d is not None), default=None)
        sha = hashlib.sha256(t.encode()).hexdigest()
        for k, d in enumerate(sorted(ids, key=lambda d: (d is not None, d or 0), reverse=True)):
            out[d, keep, len(ids), k == 0, sha] += 1
    return out


def pairs_of(docs):
    return [(r[0], r[1]) for r in docs.select("doc_id", "text").collect()]


@pytest.mark.parametrize("counters", [2, 4096])
def test_exact_groups_of_odd_rows(odd_docs, none_docs, monkeypatch, counters):
    monkeypatch.setattr(ed.heavy_digests, "__defaults__", (counters,))
    assert Counter(map(tuple, ed.exact_groups(odd_docs).collect())) == plain_exact(pairs_of(odd_docs))
    assert ed.exact_groups(none_docs).count() == 0


@pytest.mark.parametrize("counters", [3, 4096])
def test_exact_groups_with_a_hot_text(make_docs, monkeypatch, counters):
    monkeypatch.setattr(ed.heavy_digests, "__defaults__", (counters,))
    rng = random.Random(3)
    docs = make_docs([(i, "hot" if i % 3 == 0 else f"t{rng.randint(0, 40)}") for i in range(400)], parts=7)
    assert Counter(map(tuple, ed.exact_groups(docs).collect())) == plain_exact(pairs_of(docs))
    kept = ed.drop_copies(docs.withColumn("digest", F.lit(1)).withColumn("kept", F.lit(2)))
    assert kept.columns[-2:] == ["digest", "kept"]
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(k[0] for k in plain_exact(pairs_of(docs)) if k[3])


def test_drop_copies_of_odd_rows(odd_docs):
    kept = Counter((r["doc_id"], r["text"] or "") for r in ed.drop_copies(odd_docs).collect())
    want = Counter()
    for (d, _, _, stays, sha), n in plain_exact(pairs_of(odd_docs)).items():
        if stays:
            want[d, sha] += n
    assert Counter({(d, hashlib.sha256(t.encode()).hexdigest()): n for (d, t), n in kept.items()}) == want


def test_misra_gries_keeps_what_is_frequent():
    rng = random.Random(5)
    rows = [rng.choice("aaaaabbbcdefghij") for _ in range(4000)]
    counts = {}
    for i in range(0, len(rows), 50):
        counts = ed.misra_gries(counts, dict(Counter(rows[i : i + 50])), 4)
    true = Counter(rows)
    assert len(counts) <= 4
    for w, n in true.items():
        assert counts.get(w, 0) <= n <= counts.get(w, 0) + len(rows) / 5


def plain_near(rows, width, percent=80):
    sets = []
    for d, t in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        sets.append({tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set())
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            common = len(a & sets[j])
            if a and sets[j] and 100 * common >= percent * len(a | sets[j]):
                up[find(i)] = find(j)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(i)
    out = Counter()
    for members in groups.values():
        least = min((rows[i][0] for i in members if rows[i][0] is not None), default=None)
        for i in members:
            component = least if sets[i] else rows[i][0]
            out[rows[i][0], len(sets[i]), component, component is None or rows[i][0] == component] += 1
    return out


@pytest.mark.parametrize("width", [2, 5])
def test_near_groups_of_odd_rows(odd_docs, none_docs, width):
    got = nd.near_groups(odd_docs, width).collect()
    assert Counter((r[0], r[1], r[2], bool(r[3])) for r in got) == plain_near(pairs_of(odd_docs), width)
    assert nd.near_groups(none_docs, width).count() == 0


def varied(rng, words, rate):
    return " ".join(rng.choice(VOCABULARY) if rng.random() < rate else w for w in words)


VOCABULARY = [f"w{i}" for i in range(400)]


@pytest.mark.parametrize("block", [4 << 20, 2000])
def test_near_groups_of_varied_copies(make_docs, monkeypatch, block):
    """Chains, a large group of copies at many distances around the bound, and texts that share a long passage."""
    monkeypatch.setattr(nd, "BLOCK_BYTES", block)
    rng = random.Random(11)
    base = [rng.choice(VOCABULARY) for _ in range(80)]
    rows = [(i, varied(rng, base, rng.choice([0.01, 0.03, 0.06, 0.12]))) for i in range(60)]
    chain = [rng.choice(VOCABULARY) for _ in range(60)]
    for i in range(100, 130):
        chain = varied(rng, chain, 0.03).split()
        rows.append((i, " ".join(chain)))
    passage = [rng.choice(VOCABULARY) for _ in range(60)]
    rows += [(i, " ".join(passage + [rng.choice(VOCABULARY) for _ in range(rng.randint(2, 30))])) for i in range(200, 230)]
    rows += [(i, " ".join(rng.choice(VOCABULARY[:6]) for _ in range(rng.randint(1, 5)))) for i in range(300, 360)]
    got = nd.near_groups(make_docs(rows), 2).collect()
    assert Counter((r[0], r[1], r[2], bool(r[3])) for r in got) == plain_near(rows, 2)


def test_confirmed_links_are_written_before_they_are_contracted(make_docs, monkeypatch):
    """Two Python steps in one stage take two workers for every task."""
    plans = []
    star_links = nd.star_links
    monkeypatch.setattr(nd, "star_links", lambda links: plans.append(links._jdf.queryExecution().executedPlan().toString()) or star_links(links))
    monkeypatch.setattr(nd, "best_heads", lambda pairs, classes: pairs.where("false"))  # leaves all links to the second step
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(i, f"{text} x{i}") for i in range(6)]
    got = nd.near_groups(make_docs(rows), 2).collect()
    assert Counter((r[0], r[1], r[2], bool(r[3])) for r in got) == plain_near(rows, 2)
    assert len(plans) == 2 and not any("InPandas" in p or "InArrow" in p for p in plans)


def test_near_groups_of_the_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = nd.near_groups(docs, 2).collect()
    assert Counter((r[0], r[1], r[2], bool(r[3])) for r in got) == plain_near(pairs_of(docs), 2)


def test_drop_near_copies_keeps_columns(make_docs):
    text = " ".join(f"w{i}" for i in range(40))
    docs = make_docs([(3, text), (1, text + " z"), (2, "other words here and there"), (9, None)]).withColumn("kept", F.lit(1)).withColumn("uid", F.lit(2))
    left = nd.drop_near_copies(docs)
    assert left.columns == docs.columns
    assert sorted(r["doc_id"] for r in left.collect()) == [1, 2, 9]


def test_components_of_chains_and_stars(spark):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 140)] + [(200, 300), (300, 250), (250, 250)]
    rng.shuffle(links)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = {i: 0 for i in range(41)} | {i: 100 for i in range(100, 140)} | {200: 200, 250: 200, 300: 200}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_signatures_agree_as_the_sets_do():
    rng = np.random.default_rng(1)
    common, rest = rng.integers(0, 1 << 63, 800, dtype=np.uint64), rng.integers(0, 1 << 63, 200, dtype=np.uint64)
    same = (nd.signature(np.r_[common, rest[:100]]) == nd.signature(np.r_[common, rest[100:]])).mean()
    assert same == pytest.approx(0.8, abs=0.15)
