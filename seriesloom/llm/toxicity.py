"""Toxicity by a classifier chain.

The categories are predicted one after the other by linear models over the presence of words; each later model also gets
the probabilities of the categories before it. In training these are out-of-fold predictions, so that a later model does not
learn to trust probabilities that its own rows have shaped.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizer, CountVectorizerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: At most about so many labelled documents are learnt from, drawn by a hash of the id.
TRAIN_ROWS = 20_000
#: Most words and heads of words that the models weigh, the most frequent ones first.
VOCABULARY = 50_000
#: Lengths of the heads.
HEADS = (5, 7)
LEAST_DOCS = 5
FOLDS = 3
#: Tasks that read the training rows, a bounded number: the driver keeps a record of each task of the hundreds of jobs of the fits.
PARTS = 4
SEED = 10


def words_of(text: Column) -> Column:
    """Distinct runs of letters in lower case, and the first letters of longer ones, marked as such: endings change a word's form."""
    words = F.array_distinct(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{M}]+"), lambda w: w != ""))
    return F.array_distinct(F.concat(words, *[heads_of(words, n) for n in HEADS]))


def heads_of(words: Column, n: int) -> Column:
    return F.transform(F.filter(words, lambda w: F.char_length(w) > n), lambda w: F.concat(F.left(w, F.lit(n)), F.lit("*")))


def joined(rows: DataFrame, columns: list[str], size: int) -> DataFrame:
    """`columns` as one vector `_in` of `size` numbers. Of what Spark ML notes about a vector only the length is kept: a name for every word
    would be parsed, copied and sent along with each plan, file and task."""
    if "_in" in columns:
        rows, columns = rows.withColumnRenamed("_in", "_before"), ["_before" if c == "_in" else c for c in columns]
    rows = VectorAssembler(inputCols=columns, outputCol="_in", handleInvalid="keep").transform(rows)
    return rows.withMetadata("_in", {"ml_attr": {"num_attrs": size}}).drop("_before")


class Step:
    """One category of the chain: a fitted model, or one probability if training rows have a single class."""

    def __init__(self, name: str, model: LogisticRegressionModel | None, constant: float, threshold: float = 0.5) -> None:
        self.name, self.model, self.constant, self.threshold = name, model, constant, threshold

    def apply(self, rows: DataFrame) -> DataFrame:
        if self.model is None:
            return rows.withColumn(f"p_{self.name}", F.lit(self.constant))
        return self.model.transform(rows).withColumn(f"p_{self.name}", vector_to_array("_out")[1]).drop("_raw", "_out", "_pred")


def fit_step(rows: DataFrame, name: str) -> Step:
    known = rows.where(F.col(name).isNotNull())
    classes = {r[name]: r["count"] for r in known.groupBy(name).count().collect()}
    if len(classes) < 2:
        return Step(name, None, float(next(iter(classes), 0.0)))
    learner = LogisticRegression(
        featuresCol="_in", labelCol=name, rawPredictionCol="_raw", probabilityCol="_out", predictionCol="_pred", regParam=5e-4, elasticNetParam=1.0,
        standardization=False, maxIter=25,
    )
    return Step(name, learner.fit(known), 0.0)


def best_threshold(rows: DataFrame, name: str) -> float:
    """The probability level, in hundredths, that gives the best F1 on out-of-fold predictions."""
    level = F.floor(F.col(f"p_{name}") * 100).cast("int")
    counts = {r["level"]: (r["n"], r["hits"]) for r in rows.where(F.col(name).isNotNull()).groupBy(level.alias("level")).agg(F.count("*").alias("n"), F.sum(name).alias("hits")).collect()}
    positives = sum(h for _, h in counts.values())
    scores = []
    for t in range(1, 100):
        taken, hits = (sum(counts[k][i] for k in counts if k >= t) for i in (0, 1))
        scores.append((2 * hits / (taken + positives) if taken + positives else 0.0, t))
    top = max(s for s, _ in scores)
    good = [t for s, t in scores if s == top]
    return good[len(good) // 2] / 100


class Chain:
    def __init__(self, vectors: CountVectorizerModel | None, steps: list[Step]) -> None:
        self.vectors, self.steps = vectors, steps

    def score(self, docs: DataFrame) -> DataFrame:
        """(doc_id, p_<category>..., is_<category>...) of every row; a text without known words gets the models' bare intercepts."""
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), words_of(F.col("text")).alias("_tokens"))
        size = len(self.vectors.vocabulary) if self.vectors else 0
        rows = joined(self.vectors.transform(rows), ["_words"], size).drop("_words") if self.vectors else rows
        done: list[str] = []
        for step in self.steps:
            rows = joined(rows, ["_in", f"p_{done[-1]}"], size + len(done)) if self.vectors and done else rows
            rows = step.apply(rows)
            done.append(step.name)
        flags = [(F.col(f"p_{s.name}") >= s.threshold).alias(f"is_{s.name}") for s in self.steps]
        return rows.select("doc_id", *[f"p_{c}" for c in done], *flags)


def fit_chain(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], most: int = TRAIN_ROWS) -> Chain:
    """Fit the categories (name to a 0/1 column of `labels`, null where unknown) in their order.

    Learns from the labelled documents drawn by a hash of the id, about `most` of them; labels without a document, null ids
    and null texts are left out, and several labels of one id count as the largest.
    """
    key = F.col("doc_id").cast("long")
    named = labels.where("doc_id IS NOT NULL").groupBy(key.alias("doc_id")).agg(*[F.max(c.cast("double")).alias(n) for n, c in categories.items()])
    share = min(1.0, most / max(1, named.count()))
    draw = F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1 << 30)) / float(1 << 30)
    drawn = named.where(draw < share)  # about `most` rows of a few numbers
    texts = docs.where("text IS NOT NULL").select(key.alias("doc_id"), "text")
    train = texts.join(F.broadcast(drawn), "doc_id").select("doc_id", words_of(F.col("text")).alias("_tokens"), *categories)
    train = stored(train.repartition(4, "doc_id"), "toxicity-train").coalesce(PARTS)
    least = float(min(LEAST_DOCS, max(1, train.count() // 100)))
    names = list(categories)
    if not train.select(F.explode("_tokens")).take(1):
        return Chain(None, [Step(n, None, 0.0) for n in names])
    vectors = CountVectorizer(inputCol="_tokens", outputCol="_words", vocabSize=VOCABULARY, minDF=least, binary=True).fit(train)
    size = len(vectors.vocabulary)
    fold = F.pmod(F.xxhash64("doc_id", F.lit(SEED + 1)), F.lit(FOLDS))
    rows = joined(vectors.transform(train), ["_words"], size).drop("_tokens", "_words").withColumn("_fold", fold)
    rows = stored(rows, "toxicity-vectors").coalesce(PARTS)
    steps: list[Step] = []
    for i, name in enumerate(names):
        parts = [fit_step(rows.where(F.col("_fold") != k), name).apply(rows.where(F.col("_fold") == k)) for k in range(FOLDS)]
        step = fit_step(rows, name)
        rows = joined(parts[0].unionByName(parts[1]).unionByName(parts[2]), ["_in", f"p_{name}"], size + i + 1)
        rows = stored(rows, "toxicity-vectors").coalesce(PARTS)
        step.threshold = best_threshold(rows, name)
        steps.append(step)
    return Chain(vectors, steps)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Probabilities and verdicts of low quality and toxicity for every document, learnt from `labels` (doc_id, quality, toxic).

    A null or empty text has no words; texts of any length are read whole. Without usable labels every probability is 0 and nothing is
    flagged. Repeated rows get equal results; an empty table gives no rows; other columns are not read.
    """
    categories = {"low_quality": 1 - F.col("quality"), "toxic": F.col("toxic")}
    return fit_chain(docs, labels, categories).score(docs)
