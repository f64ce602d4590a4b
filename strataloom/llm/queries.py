"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strataloom.llm import licenses

#: Where public tokenizer files lie unless a caller passes a path.
TOKENIZER = "piece_bpe_32k.model"
PAIRS = "byte_bpe_multi_50k.tiktoken"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op6_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strataloom.llm.order_minhash import fingerprint_with_edits

    return fingerprint_with_edits(table(spark, sf_dir, "documents"))


def op7_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strataloom.llm.ppm import score_documents

    return score_documents(table(spark, sf_dir, "documents"), crc_mod(7) == 2)


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strataloom.llm.sentencepieces import encode_documents

    return encode_documents(table(spark, sf_dir, "documents"), tokenizer_path(), with_ids=False)


def crc_mod(divisor: int):
    from pyspark.sql import functions as F

    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(divisor))


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strataloom.llm.licenses import scan_documents

    return scan_documents(table(spark, sf_dir, "documents"))


def op3_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strataloom.llm.compaction import shard_documents

    return shard_documents(table(spark, sf_dir, "documents"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strataloom.llm.mixing import mix_documents

    return mix_documents(table(spark, sf_dir, "documents"))


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strataloom.llm.personal_data import find_personal_data, fit

    docs = table(spark, sf_dir, "documents")
    return find_personal_data(docs, fit(docs))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from strataloom.llm.toxicity import THRESHOLD, fit, score_documents

    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where(crc_mod(3) != 1)
    scored = score_documents(docs, fit(docs, labels))
    return scored.select("doc_id", (crc_mod(3) == 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op9_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strataloom.llm.fertility import judge_documents

    return judge_documents(table(spark, sf_dir, "documents"), tokenizer_path(), tokenizer_path(PAIRS)).drop("lang", "text_key")


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strataloom.llm.ngram_join import join_components

    return join_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_licenses": op1_licenses,
    "op2_mixing": op2_mixing,
    "op3_compaction": op3_compaction,
    "op4_personal_data": op4_personal_data,
    "op5_toxicity": op5_toxicity,
    "op6_order_minhash": op6_order_minhash,
    "op7_ppm": op7_ppm,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_fertility": op9_fertility,
    "op10_ngram_join": op10_ngram_join,
}

ORACLES: dict[str, str] = {"op1_licenses": licenses.oracle()}
