"""The registered queries of the text operators, and the SQL that some of them must agree with."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm import bpe, ctw, embeddings, filter_audit, fim, kdtree, langid, licenses, maxscore, packing, pii, setsketch, toxicity

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
TOXIC = 0.3


def _query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query()
def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors with a cosine of 0.95 or more, whatever their labels."""
    return embeddings.links(_table(spark, sf_dir, "embeddings"))


@_query()
def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all whole texts."""
    docs = _table(spark, sf_dir, "documents")
    return pii.find(docs, pii.fit(docs))


@_query()
def op3_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-probabilities of all texts, learnt from nine tenths of the ids."""
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0
    scored = ctw.score(_table(spark, sf_dir, "documents"), ~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")


@_query()
def op4_kd_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of nearly equal bytes."""
    dimensions = {"length": kdtree.magnitude(F.octet_length("text")), "lang": kdtree.category("lang"), "source": kdtree.category("source")}
    return kdtree.shard(_table(spark, sf_dir, "documents"), dimensions)


@_query()
def op5_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best inner products of every twentieth vector with all others."""
    return maxscore.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@_query()
def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text encoded and decoded, as digests."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.round_trip(_table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


@_query(licenses.oracle())
def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices in all whole texts."""
    return licenses.scan(_table(spark, sf_dir, "documents"))


@_query()
def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that share three quarters of their five-word shingles."""
    return setsketch.near_duplicates(_table(spark, sf_dir, "documents"))


@_query()
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents; a quarter of the ids is held out from training."""
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    scored = toxicity.score(docs, toxicity.fit(docs, labels, ~held_out))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"), F.size("spans").cast("long").alias("n_spans"))


@_query()
def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 1,024 tokens, 4 segments and 320 loss-bearing tokens."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    return packing.pack_documents(_table(spark, sf_dir, "documents"), path, packing.DOCUMENT_LIMITS, loss=packing.DOCUMENT_LOSS)


@_query(filter_audit.oracle())
def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove in all 120 orders, per source and label."""
    return filter_audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@_query(fim.oracle())
def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts rearranged for filling in a middle, and taken back."""
    return fim.digests(_table(spark, sf_dir, "documents"))


@_query()
def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all texts; a third of the ids is held out from training."""
    docs = _table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    found = langid.predict(docs, langid.fit(docs, ~held_out))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@_query()
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity, near-duplicates, personal data and packing, one after the other."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
