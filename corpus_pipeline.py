"""From documents to packed training sequences: five stages, each written as Parquet and read again by the next.

Stages hand on the columns of documents; the last returns the packed pieces.  All their statistics (shingle counts,
cell sums, length histogram) are gathered from the rows the stage before kept.  An empty table gives no rows at any stage,
and columns beside those of documents are carried along, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loglattice.llm import cotraining, jaccard_join, mixing, packing, pii
from loglattice.llm._store import sifted, stored

#: The stages select by trained classifiers and hashes of texts, which SQL cannot express.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifiers keep; a null or empty text goes.

    Repeated rows stay or go together, a null language or source is a value of its own, and without labels every text stays.
    """
    return cotraining.kept(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group linked at Jaccard similarity 0.75 or more.

    Rows without a doc_id or without words stay; rows that repeat a doc_id are one document and stay or go together.  Only
    rows that may be copies pass through the join with them.
    """
    copies = stored(jaccard_join.classes(docs).where("doc_id <> component_id").select("doc_id").distinct(), "copies")
    may, cannot = sifted(docs, copies, "doc_id")
    return cannot.unionByName(may.join(copies, "doc_id", "left_anti").select(*docs.columns))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; null and empty texts, repeated rows and null ids stay rows."""
    return pii.redact(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample of documents calibrated to source, language and topic marginals.

    A null source or language is a value of its own; texts without a word have probability 0; repeated rows of a doc_id are
    kept or left together.
    """
    return mixing.sampled(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 tokens; every row, a null text too, is a document of its own."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", quality), ("near duplicates", near_duplicates), ("personal data", personal_data), ("source mix", source_mix), ("packing", sequences)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
