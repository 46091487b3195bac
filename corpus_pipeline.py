"""From raw documents to token ids: five stages, each written to the shared folder and read again as the next one's input.

Language identification drops what has no language, exact and near deduplication leave one document of each group, mixing
cuts the rest to the target weights, and encoding makes the token ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.llm.bpe import encode_documents
from seriesloom.llm.common import stored
from seriesloom.llm.exact_dedup import drop_copies
from seriesloom.llm.language_id import UNKNOWN, identify
from seriesloom.llm.mixing import mix
from seriesloom.llm.near_dedup import drop_near_copies
from seriesloom.llm.queries import DOMAIN_WEIGHTS, LANG_WEIGHTS, domain_of, tokenizer_path

#: A prediction with a smaller share of the probability is no language.
LEAST_SHARE = 0.5
#: Share of the tokens that the mixture keeps.
MIX_SHARE = 0.9


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised: null and letterless texts go, so do those whose best language is no majority.

    Like every stage, it keeps all columns as they are whatever their names, reads texts of any length whole, treats repeated
    rows alike and gives no rows for an empty table.
    """
    read = ("doc_id", "text", "lang")
    others = [docs[c] for c in docs.columns if c not in read]
    rows = docs.select(*read, F.struct(*(others or [F.lit(0)])).alias("row"))  # the texts go to the workers once
    found = identify(rows, tokenizer_path("piece_bpe_32k.model"))
    kept = found.where((found["lang_pred"] != UNKNOWN) & (found["lang_score"] >= LEAST_SHARE))
    return kept.select(*[F.col(c) if c in read else F.col("row").getField(c).alias(c) for c in docs.columns])


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, the one with the largest id; a null text equals an empty one."""
    return drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (word shingles of five, similarity of 0.8 or more), the one with the least id.

    Documents without words stay, as do those without an id unless a group has one with an id.
    """
    return drop_near_copies(docs, width=5, percent=80)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as the budgets of their domain, language and source take them; nulls there are a leaf of their own."""
    return mix(docs, domain_of(docs["source"]), share=MIX_SHARE, epochs=1, domain_weights=DOMAIN_WEIGHTS, lang_weights=LANG_WEIGHTS)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, checksums and the number of tokens of every document; a null text has none."""
    return encode_documents(docs, tokenizer_path("word_bpe_49k.json"), keep_ids=True)


STAGES = [("language", language), ("exact_copies", exact_copies), ("near_copies", near_copies), ("mixture", mixture), ("token_ids", token_ids)]

#: Language probabilities, signatures and merges have no SQL form; tests hold the result against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table of documents; rows with ids of the kept documents, their token ids and checksums."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
