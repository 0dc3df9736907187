"""A training corpus from raw documents: toxicity filter, line dedup, near-dedup, mixing, tokens.

Each stage is (spark, docs, sf_dir) -> DataFrame; its result is written as Parquet and read again as the docs of the next.

As an application the pipeline sets the session's rows of an Arrow batch, where these are Spark's default, as its stages follow each other on the same executors; run() puts the
setting back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from assaylake.llm import bpe, common, linededup, minhash, mixing, toxicity

#: SQL can't express the learned lexicon, the forest and the tokens; the stages are tested against brute force.
ORACLE_SQL = None


#: Rows of an Arrow batch: large ones of several stages add up in an executor's memory.
SETTING, DEFAULT, ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "1000"


def _small_batches(spark: SparkSession) -> None:
    if spark.conf.get(SETTING) == DEFAULT:
        spark.conf.set(SETTING, ROWS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose predicted label isn't toxic; the scores are learned from these documents and the table of labels."""
    _small_batches(spark)
    return toxicity.clean(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that at least linededup.MIN_DOCS of them share."""
    _small_batches(spark)
    return linededup.without_shared_lines(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the smallest id: five-word shingles, similarity of 0.8 or more. Those of a null id stay."""
    _small_batches(spark)
    return minhash.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in its order."""
    return mixing.mixed_documents(docs)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each document, and the digest of what they decode to."""
    _small_batches(spark)
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.encode(docs.select("doc_id", "lang", "source", "text"), path, public_tokenizers.PATTERN, adds=("ids", "decoded_sha256")).drop("text")


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_lines),
    ("MinHash near-dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("byte-level BPE", tokenise),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.conf.get(SETTING)
    try:
        for k, (_, stage) in enumerate(STAGES):
            docs = common.materialize(stage(spark, docs, sf_dir), f"pipeline-{k}")
    finally:
        spark.conf.set(SETTING, before)
    return docs
