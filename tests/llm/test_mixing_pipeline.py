import hashlib
import os
import subprocess
import sys
import textwrap
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from seriesloom.llm.mixing import NONE, mix, mix_copies
from seriesloom.llm.queries import domain_of

WEIGHTS = {"domain_weights": {"head": 1.0, "tail": 2.0}, "lang_weights": {"en": 2.0, "de": 0.5}, "source_weights": {"src1": 3.0, "src7": 0.0}}


def fill(budget, children):
    """Plain water filling: (capacity, weight) by key; what one cannot take is offered to the others again."""
    out, open_ = dict.fromkeys(children, 0.0), {k for k, (_, w) in children.items() if w > 0}
    while open_ and budget > 1e-9:
        total = sum(children[k][1] for k in open_)
        full = {k for k in open_ if children[k][0] - out[k] <= budget * children[k][1] / total + 1e-12}
        if not full:
            for k in open_:
                out[k] += budget * children[k][1] / total
            break
        for k in full:
            budget -= children[k][0] - out[k]
            out[k] = float(children[k][0])
        open_ -= full
    return out


def plain_mix(docs, share, epochs, seed, domain_weights, lang_weights, source_weights):
    rows = []
    for r in docs.select("doc_id", "text", domain_of(F.col("source")).alias("domain"), "lang", "source").collect():
        text = r["text"] or ""
        leaf = tuple(NONE if x is None else x for x in (r["domain"], r["lang"], r["source"]))
        rows.append((r["doc_id"], len(text.encode().split()), zlib.crc32(text.encode()), leaf))
    tokens = Counter()
    for _, n, _, leaf in rows:
        tokens[leaf] += n
    total = int(share * sum(tokens.values()))

    def families(prefix):
        out = defaultdict(int)
        for leaf, n in tokens.items():
            if leaf[: len(prefix)] == prefix:
                out[leaf[: len(prefix) + 1]] += n * epochs
        return out

    budgets = {}
    top = fill(total, {k: (c, domain_weights.get(k[0], 1.0)) for k, c in families(()).items()})
    for d, b in top.items():
        mid = fill(b, {k: (c, lang_weights.get(k[1], 1.0)) for k, c in families(d).items()})
        for m, c in mid.items():
            budgets |= fill(c, {k: (x, source_weights.get(k[2], 1.0)) for k, x in families(m).items()})
    out = Counter()
    for leaf in tokens:
        budget = int(round(budgets[leaf], 6))
        whole = budget // tokens[leaf] if tokens[leaf] else epochs
        left, used = budget - whole * tokens[leaf], 0
        mine = [(hashlib.md5(f"{'' if d is None else d}:{seed}:{whole}".encode()).hexdigest(), d is not None, d or 0, c, d, n) for d, n, c, at in rows if at == leaf]
        for tie in sorted(set(m[:4] for m in mine)):
            same = [m for m in mine if m[:4] == tie]
            used += sum(m[5] for m in same)
            for m in same:
                out[m[4], leaf, m[5], budget, whole + (left > 0 and used <= left)] += 1
    return out


def check(docs, share, epochs, seed=8):
    got = mix_copies(docs, domain_of(docs["source"]), share=share, epochs=epochs, seed=seed, **WEIGHTS).collect()
    rows = Counter((r["doc_id"], (r["domain"], r["lang"], r["source"]), r["n_tokens"], r["leaf_budget"], r["copies"]) for r in got)
    assert rows == plain_mix(docs, share, epochs, seed, **WEIGHTS)
    return got


@pytest.mark.parametrize("share,epochs", [(0.5, 2), (0.9, 1), (0.1, 1), (1.7, 2), (5.0, 2)])
def test_mixture_of_the_table(spark, share, epochs):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = check(docs, share, epochs)
    taken = sum(r["copies"] * r["n_tokens"] for r in got)
    assert taken <= share * sum(r["n_tokens"] for r in got)


def test_mixture_of_odd_rows(odd_docs, none_docs):
    check(odd_docs, 0.6, 2)
    assert mix_copies(none_docs, domain_of(none_docs["source"])).count() == 0


def test_mix_repeats_rows_and_keeps_columns(make_docs):
    docs = make_docs([(i, "w " * (i + 1), "en", f"src{i % 3}") for i in range(30)]).withColumn("domain", F.lit("x")).withColumn("budget", F.lit(1))
    how = dict(share=1.4, epochs=2)
    copies = {r["doc_id"]: r["copies"] for r in mix_copies(docs, domain_of(docs["source"]), **how).collect()}
    mixed = mix(docs, domain_of(docs["source"]), **how)
    assert mixed.columns == docs.columns
    assert Counter(r["doc_id"] for r in mixed.collect()) == Counter({d: n for d, n in copies.items() if n})


def test_shortage_goes_to_siblings_first(make_docs):
    """A small source leaves its part to the other source of its language, not to the other language."""
    rows = [(i, "w " * 10, "en", "src1") for i in range(2)] + [(100 + i, "w " * 10, "en", "src2") for i in range(100)] + [(300 + i, "w " * 10, "de", "src1") for i in range(100)]
    got = mix_copies(make_docs(rows), F.lit("all"), share=0.4, epochs=1).collect()
    budgets = {(r["lang"], r["source"]): r["leaf_budget"] for r in got}
    assert budgets == {("en", "src1"): 20, ("en", "src2"): 384, ("de", "src1"): 404}


def test_stages(spark, make_docs, tmp_path):
    """The pipeline against its steps on a small table where every step has something to do."""
    import re

    text = [" ".join(f"{a}{b}" for a, b in zip("the and of with in for to is was that".split(), "abcdefghij"[k:] + "klmnopqrst"[:k])) + f" word{k}" for k in range(8)]
    rows = [(k, t, "en", f"src{k % 3}") for k, t in enumerate(text)]
    rows += [(20, text[0], "en", "src1"), (21, "123 456 !!", "en", "src1"), (22, None, "en", "src2")]
    long = " ".join(f"token{i}" for i in range(200))
    rows += [(30, long, "en", "src12"), (31, long + " tail", "en", "src13")]
    make_docs(rows).write.parquet(str(tmp_path / "documents.parquet"))
    out = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = out
        out = stage(spark, before, str(tmp_path))
        assert out.columns == before.columns, name
        out = spark.createDataFrame(out.collect(), out.schema)
        seen.append({r["doc_id"] for r in out.collect()})
    assert {21, 22} & seen[0] == set() and {*range(8), 20, 30, 31} <= seen[0]
    assert seen[1] == seen[0] - {0}
    assert seen[2] == seen[1] - {31}
    assert seen[3] < seen[2]
    final = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in final} == seen[3]
    assert all(len(r["ids"]) == r["n_tokens"] and re.fullmatch("[0-9a-f]{64}", r["ids_sha256"]) for r in final)


def test_pipeline_over_the_table(spark):
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    assert 100 < len(rows) < 190 and len({r["doc_id"] for r in rows}) == len(rows)


def test_worker_code_travels_with_the_job(tmp_path):
    repo = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    code = f"""
        import sys
        sys.path.insert(0, {repo!r})
        from __spark_entry__ import queries
        from seriesloom import build_session
        spark = build_session(master="local[2]", **{{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "2"}})
        for name in ("op1_fingerprint", "op4_near_dedup", "op6_language", "op9_bpe"):
            assert queries()[name](spark, "/root/testdata/sf0.001").count() == 200
        spark.stop()
    """
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", textwrap.dedent(code)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-2000:]
