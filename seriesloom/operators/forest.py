"""Isolation forest: trees grown in parallel on small samples, scored where the rows are."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from ..spec import DEFAULT, PanelSpec
from .quantiles import exact_quantiles

#: Rows each tree is grown on (all rows of a smaller table).
SAMPLE = 256


def _average_depth(n):
    """Mean path length of an unsuccessful search among n points."""
    n = np.asarray(n, dtype=float)
    h = np.log(np.maximum(n - 1, 1)) + 0.5772156649015329
    return np.where(n > 2, 2 * h - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


def _grow(x: np.ndarray, rng: np.random.Generator, limit: int) -> list[tuple]:
    """Nodes (id, feature, cut, left, right, depth value); leaves have feature -1."""
    nodes, todo = [], [(0, np.arange(len(x)), 0)]
    used = 1
    while todo:
        node, rows, depth = todo.pop()
        span = np.ptp(x[rows], axis=0) if len(rows) > 1 else np.zeros(x.shape[1])
        usable = np.flatnonzero(span > 0)
        if depth >= limit or len(usable) == 0:
            nodes.append((node, -1, 0.0, -1, -1, float(depth + _average_depth(len(rows)))))
            continue
        f = int(rng.choice(usable))
        lo = x[rows, f].min()
        cut = float(lo + rng.uniform() * span[f])
        left = x[rows, f] <= cut
        nodes.append((node, f, cut, used, used + 1, 0.0))
        todo += [(used, rows[left], depth + 1), (used + 1, rows[~left], depth + 1)]
        used += 2
    return nodes


def fit(df: DataFrame, features: Sequence[str], key: str, n: int, trees: int = 100, seed: int = 42) -> DataFrame:
    """Node table (tree, node, feature, cut, left, right, depth) of a table of `n` rows.

    A row joins the sample of each tree by a hash of its key and the tree, so the draw is repeatable and the same
    at every size. About trees x SAMPLE rows (a fixed number) leave the scan; each tree is one small group.
    """
    cols = list(features)
    rows = df.select(F.col(key), *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in cols])
    # a key may stand for several rows: they are drawn and ordered by their features too
    draw = lambda *parts: F.pmod(F.xxhash64(F.col(key), *cols, *parts), F.lit(1 << 40)) / float(1 << 40)
    share = 1.2 * SAMPLE / max(n, 1)
    # one draw for all trees first, so that most rows of a large table are hashed once
    gate = min(1.0, 8 * trees * share)
    joins = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: draw(F.lit(seed + 1), t) < share / gate)
    picked = rows.filter(draw(F.lit(seed)) < gate).withColumn("tree", F.explode(joins))
    schema = "tree int, node int, feature int, cut double, left int, right int, depth double"

    def build(k: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        rng = np.random.default_rng(seed * 1_000_003 + int(k[0]))
        x = pdf.sort_values([key, *cols])[cols].to_numpy(float)
        if len(x) > SAMPLE:
            x = x[np.sort(rng.choice(len(x), SAMPLE, replace=False))]
        nodes = _grow(x, rng, int(np.ceil(np.log2(max(len(x), 2)))))
        out = pd.DataFrame(nodes, columns=["node", "feature", "cut", "left", "right", "depth"])
        out.insert(0, "tree", int(k[0]))
        return out

    return picked.groupBy("tree").applyInPandas(build, schema)


def score(df: DataFrame, nodes: DataFrame, features: Sequence[str], key: str, sample: int = SAMPLE) -> DataFrame:
    """Anomaly score 2^(-mean depth / c(sample)) per row, computed in the scan's own partitions.

    The node table has at most trees x 2 x SAMPLE rows whatever the data size; it travels to the
    tasks with the function.
    """
    cols = list(features)
    table = nodes.toPandas().sort_values(["tree", "node"])
    # all trees end to end; a leaf points to itself, so every row can take the same number of steps
    start = table.groupby("tree")["node"].transform("size").groupby(table["tree"]).first().cumsum().shift(fill_value=0)
    base = table["tree"].map(start).to_numpy()
    leaf = table["feature"].to_numpy() < 0
    here = np.arange(len(table))
    feature = np.where(leaf, 0, table["feature"]).astype(np.intp)
    cut = table["cut"].to_numpy()
    child = np.stack([np.where(leaf, here, table[c] + base) for c in ("right", "left")], axis=1).astype(np.intp).ravel()
    depth = table["depth"].to_numpy()
    roots = start.to_numpy(dtype=np.intp)
    steps = int(np.ceil(np.log2(max(sample, 2))))
    norm = float(_average_depth(sample))
    kind = dict(df.dtypes)[key]

    def run(batches):
        for pdf in batches:
            x = pdf[cols].fillna(0.0).to_numpy(float)
            flat, offset = x.ravel(), np.arange(len(x)) * len(cols)
            total = np.zeros(len(x))
            for root in roots:
                at = np.full(len(x), root)
                for _ in range(steps):
                    goes_left = flat.take(offset + feature.take(at)) <= cut.take(at)
                    at = child.take(2 * at + goes_left)
                total += depth.take(at)
            yield pd.DataFrame({key: pdf[key], "score": np.power(2.0, -total / (len(roots) * norm))})

    return df.select(key, *cols).mapInPandas(run, f"{key} {kind}, score double")


def anomaly_forest(df: DataFrame, features: Sequence[str], key: str, contamination: float = 0.1, trees: int = 100, seed: int = 42) -> DataFrame:
    """(key, score, is_forest): the `contamination` share of rows with the highest scores is flagged; none below 10 rows."""
    n = df.count()
    if n < 10:
        return df.select(key, F.lit(0.0).alias("score"), F.lit(False).alias("is_forest"))
    nodes = fit(df, features, key, n, trees, seed)
    # the cut needs more than one pass over the scores: keep them instead of scoring again
    ensure_checkpoint_dir(df.sparkSession)
    scored = score(df, nodes, features, key, min(SAMPLE, n)).checkpoint()
    cut = exact_quantiles(scored, [], "score", {"cut": 1 - contamination}).scalar()
    return scored.withColumn("is_forest", F.col("score") > cut)


# ---- one forest per series ----

#: Trees grown in one group.
CHUNK = 25


def _draw(*parts) -> float:
    """A number in [0, 1) that depends on nothing but its arguments."""
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:8], 16) / float(1 << 32)


def tree_depths(x: np.ndarray, sample: np.ndarray, name: str, tree: int, seed: int) -> np.ndarray:
    """Path length of every row in one tree grown on the sampled rows; all nodes of a level are split together."""
    node, depth, open_ = np.ones(len(x), np.int64), np.zeros(len(x)), np.ones(len(x), bool)
    limit = int(np.ceil(np.log2(max(int(sample.sum()), 2))))
    for level in range(limit + 1):
        rows = np.flatnonzero(open_)
        if not len(rows):
            break
        names, at = np.unique(node[rows], return_inverse=True)
        low, high, size = np.full((len(names), x.shape[1]), np.inf), np.full((len(names), x.shape[1]), -np.inf), np.zeros(len(names))
        mine = sample[rows]
        np.minimum.at(low, at[mine], x[rows[mine]])
        np.maximum.at(high, at[mine], x[rows[mine]])
        np.add.at(size, at[mine], 1)
        usable = high > low
        splits = usable.any(1) & (size > 1) & (level < limit)
        feature, cut = np.zeros(len(names), np.int64), np.zeros(len(names))
        for i in np.flatnonzero(splits).tolist():
            choice = np.flatnonzero(usable[i])
            f = feature[i] = choice[int(_draw(seed, name, tree, names[i], "feature") * len(choice))]
            cut[i] = low[i, f] + _draw(seed, name, tree, names[i], "cut") * (high[i, f] - low[i, f])
        ends = rows[~splits[at]]
        depth[ends] = level + _average_depth(size)[at[~splits[at]]]
        open_[ends] = False
        on, k = rows[splits[at]], at[splits[at]]
        node[on] = 2 * node[on] + (x[on, feature[k]] > cut[k])
    return depth


def series_forest(
    df: DataFrame, features: Sequence[str], contamination: float = 0.1, trees: int = 100, seed: int = 42, spec: PanelSpec = DEFAULT
) -> DataFrame:
    """`df` with `forest_score` and `is_forest`: the `contamination` share of each series' rows that is easiest to isolate.

    Trees are grown in groups of (series, 25 trees), each on all rows of a series or, above 256, on the 256 that a hash draws for it.
    All draws are hashes of (seed, series, tree, node), so a forest is the same in every run and order of rows. Scores are
    rounded to nine digits, so that ties do not hang on the order of adding up. Missing features count as 0; series below ten
    rows have score 0 and no flag.
    """
    cols, keys = list(features), list(spec.keys)
    name = F.concat_ws("|", *[F.col(k).cast("string") for k in keys])
    chunks = F.sequence(F.lit(0), F.lit((trees - 1) // CHUNK))
    rows = df.select(*keys, spec.ds, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"_f{i}") for i, c in enumerate(cols)], name.alias("_name"))
    rows = rows.withColumn("_chunk", F.explode(chunks))
    kinds = dict(df.dtypes)

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([spec.ds, *[f"_f{i}" for i in range(len(cols))]])
        x, label, chunk = pdf[[f"_f{i}" for i in range(len(cols))]].to_numpy(float), pdf["_name"].iloc[0], int(pdf["_chunk"].iloc[0])
        total = np.zeros(len(x))
        for tree in range(chunk * CHUNK, min(trees, (chunk + 1) * CHUNK)):
            sample = np.ones(len(x), bool)
            if len(x) > SAMPLE:
                drawn = np.argsort([_draw(seed, label, tree, i, "row") for i in range(len(x))], kind="stable")[:SAMPLE]
                sample = np.isin(np.arange(len(x)), drawn)
            total += tree_depths(x, sample, label, tree, seed)
        return pd.DataFrame({**{k: pdf[k] for k in keys}, spec.ds: pdf[spec.ds], "_depth": total, "_n": float(min(len(x), SAMPLE))})

    schema = ", ".join(f"{c} {kinds[c]}" for c in (*keys, spec.ds)) + ", _depth double, _n double"
    grown = rows.groupBy(*keys, "_chunk").applyInPandas(grow, schema)
    depths = grown.groupBy(*keys, spec.ds).agg((F.sum("_depth") / trees).alias("_d"), F.first("_n").alias("_n"))
    norm = F.when(F.col("_n") > 2, 2 * (F.ln(F.col("_n") - 1) + 0.5772156649015329) - 2 * (F.col("_n") - 1) / F.col("_n")).otherwise(1.0)
    scored = depths.select(*keys, spec.ds, F.when(F.col("_n") >= 10, F.round(F.pow(F.lit(2.0), -F.col("_d") / norm), 9)).otherwise(0.0).alias("forest_score"))
    cut = F.percentile("forest_score", 1 - contamination).over(spec.whole())
    flagged = scored.withColumn("is_forest", (F.col("forest_score") > cut) & (F.col("forest_score") > 0))
    return df.join(flagged, [*keys, spec.ds])
