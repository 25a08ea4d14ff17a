"""The corpus pipeline: toxicity, near duplicates, secrets, mixing, tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import bpe, mixing, secrets, simhash, toxicity
from tidewatch.llm.common import read_table, written
from tidewatch.llm.queries import PATTERN, RANKS


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.5.

    Null and empty texts score as clean ones do, repeated rows alike, an empty table gives no rows,
    and other columns are kept whatever they are called.
    """
    model = toxicity.fit_sample(toxicity.training_sample(docs, read_table(spark, sf_dir, "labels")))
    return toxicity.keep_clean(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: that of least id, a null id last.

    Null and empty texts are one group; of repeated rows one stays; an empty table gives no rows.
    """
    return simhash.keep_first(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked and n_chars, where there is such a column, counted again for all of them.

    A null text stays null and has a null n_chars; empty texts and repeated rows stay as they are;
    an empty table gives no rows.
    """
    masked = secrets.redact(docs)
    return masked.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else masked


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target weight asks for.

    Null sources are one source, null and empty texts have size 0 and are taken as often as their
    source is, repeated rows count each, an empty table gives no rows.
    """
    return mixing.mixed_rows(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, ids) of each document of the mix.

    Null and empty texts have no tokens, repeated rows are encoded each, an empty table gives no rows.
    """
    return bpe.round_trip(docs, RANKS, PATTERN, with_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_copies),
    ("secrets", mask_secrets),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: A random field and token ids are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
