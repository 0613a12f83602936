"""A corpus from raw documents to packed training sequences, in four stages.

Each stage takes all rows that the one before has kept and returns the columns of ``documents``;
the last returns the pieces of the sequences.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm import packing, pii, setsketch, toxicity
from tablewright.session import configure, cut_lineage

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Documents with this score or a higher one go.
TOXIC = 0.3


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, trained on all labels of the input, does not reject."""
    labels = configure(spark).read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs, labels, F.lit(True))
    return toxicity.keep_below(docs.select(*COLUMNS), model, TOXIC)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: the one with the smallest id. Ids may be null or repeat."""
    rows = setsketch.numbered(docs.select(*COLUMNS))
    kept = setsketch.row_components(rows).where("kept").select(setsketch.ROW)
    return rows.join(kept, setsketch.ROW, "left_semi").select(*COLUMNS)


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents with personal data replaced by its kind; ``n_chars`` follows the text."""
    hidden = pii.redact(docs.select(*COLUMNS), pii.fit(docs))
    return hidden.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents as pieces of sequences of at most 1,024 tokens, within all limits of ``op10``."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    return packing.pack_documents(docs, path, packing.DOCUMENT_LIMITS, loss=packing.DOCUMENT_LOSS)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_copies),
    ("personal_data", hide_personal_data),
    ("packing", pack),
]

#: The stages train models and follow links; SQL cannot say that.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = configure(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cut_lineage(docs)
    return docs
