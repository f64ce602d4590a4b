"""A corpus pipeline: toxic documents go, near copies go, personal data is replaced, sources are mixed, texts are encoded.

Each stage takes ``(spark, docs, sf_dir)`` with ``docs`` shaped like the
``documents`` table and returns a DataFrame; all but the last return the
columns of ``documents``.  ``run`` writes each stage's result as Parquet in the
shared folder and reads it back as the next stage's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strataloom.llm import mixing, ngram_join, personal_data, sentencepieces, toxicity
from strataloom.llm.queries import crc_mod, tokenizer_path
from strataloom.llm.storage import settle
from strataloom.session import ship


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the threshold; labels of the training folds only."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(crc_mod(3) != 1)
    return toxicity.drop_documents(docs, toxicity.fit(docs, labels))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8 or more): the one of least doc_id."""
    return ngram_join.one_of_each(docs, percent=80, size=5)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind in brackets, ``n_chars`` as it is then."""
    return personal_data.redact(docs, personal_data.fit(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' drawn words: a row per document and epoch that the mix draws from."""
    return mixing.drawn_texts(docs)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token count and digests of each row's ids and decoded text."""
    return sentencepieces.encode_documents(docs, tokenizer_path(), with_ids=False)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_join", drop_near_copies),
    ("personal_data", replace_personal_data),
    ("mixing", mix_sources),
    ("sentencepiece", encode_texts),
]

#: Trained models and seeded draws decide which rows stay; SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    ship(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
