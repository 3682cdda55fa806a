"""A training corpus from documents: language, toxicity, near copies, mixture, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next stage's docs. All but the last return the
columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import bpe, language, mixing, neardup, toxicity
from loomgraph.llm.common import table, written

#: Documents whose language is less sure than this are rejected, as are those without a letter.
LEAST_LANGUAGE = 0.4


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language, and those with none that prevails."""
    model = language.learn(docs, toxicity.remainder(4) != 2)
    found = language.identify(docs.withColumnsRenamed({c: f"_{c}" for c in docs.columns}), model, [f"_{c}" for c in docs.columns], "_text")
    kept = found.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("lang_score") >= LEAST_LANGUAGE))
    return kept.select(*[F.col(f"`_{c}`").alias(c) for c in docs.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose toxicity reaches the threshold."""
    lexicon = toxicity.learn(docs, table(spark, sf_dir, "labels"), toxicity.remainder(3) != 1)
    scored = toxicity.score(docs.withColumnsRenamed({c: f"_{c}" for c in docs.columns}), lexicon, [f"_{c}" for c in docs.columns], "_text")
    return scored.where(F.col("toxicity") < toxicity.THRESHOLD).select(*[F.col(f"`_{c}`").alias(c) for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return neardup.deduplicated(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture of sources has it."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and the digest of what they decode to."""
    return bpe.encode(docs, ["doc_id", "lang", "source"])


STAGES = [
    ("language_id", identify_language),
    ("toxicity", drop_toxic),
    ("minhash_near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("byte_bpe", encode),
]
#: Learned models, minwise trees and byte-level merges are not SQL; tests hold near copies and decoded tokens of run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs)
    return docs
