"""The queries of the ten operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loglattice.llm.pii import personal_data

    return personal_data(_table(spark, sf_dir, "documents"))


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loglattice.llm.html_text import main_texts

    return main_texts(_table(spark, sf_dir, "pages"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loglattice.llm.mixing import mixture

    return mixture(_table(spark, sf_dir, "documents"))


def op4_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loglattice.llm.tokens_rans import token_files

    return token_files(_table(spark, sf_dir, "documents"), _tokenizer())


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loglattice.llm.jaccard_join import classes

    return classes(_table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loglattice.llm.cotraining import quality

    return quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loglattice.llm.matroska import media_column

    return media_column(_table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loglattice.llm.packing import pack

    return pack(_table(spark, sf_dir, "documents"), _tokenizer())


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loglattice.llm.substrings import remove_repeats

    return remove_repeats(_table(spark, sf_dir, "documents"))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loglattice.llm.vectors import near_vectors

    return near_vectors(_table(spark, sf_dir, "embeddings"))


def queries() -> dict:
    return {name: f for name, f in globals().items() if name.startswith("op")}


def oracle_sql() -> dict[str, str]:
    from loglattice.llm.mixing import mixture_sql

    return {"op3_mixing": mixture_sql()}
