"""From raw documents to token ids: language, near duplicates, secrets, mixture, tokens.

Each stage takes (spark, docs, folder of the tables) and works on every row that the one before
kept.  All but the last return the columns of documents, extra ones of any name too.  An empty table
gives an empty result in every stage, and any column may be null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, language, mixture, secrets, simhash
from tessera.llm.queries import VOCABULARY
from tessera.session import stored, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; the others go.

    Null and empty texts and texts without a letter go; repeated rows stay or go together.
    """
    return language.identified(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, the least id (nulls last), then the least hash.

    Null and empty texts are one group; of repeated rows one stays.
    """
    return simhash.representatives(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with live-looking secrets replaced; widely copied examples stay.

    Rows stay one for one, null and empty texts as they are.
    """
    return secrets.redacted(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, none to three times.

    Texts without a word are not taken; a null source is one like any other.
    """
    return mixture.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document of the mix, with the digest of the text that they decode to.

    Rows stay one for one; null and empty texts have no ids.
    """
    both = bpe.round_trip(docs, ["doc_id", "lang", "source"], VOCABULARY)
    return both.select("doc_id", "lang", "source", F.size("tokens").cast("long").alias("n_tokens"), "tokens", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", redact_secrets),
    ("mixture", mix_sources),
    ("bpe", encode),
]
#: SQL has neither the classifier nor the fingerprints nor the merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's rows kept in the shared folder for the next."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
