"""Training-corpus pipeline over ``documents``.

Five stages in a fixed order, each an operator of ``rankfold.llm`` applied to
all that its predecessor kept:

1. toxicity       documents scored as toxic go (the network is fitted on the
                  labelled documents among the stage's input)
2. near_dedup     one document of each group of near duplicates stays
3. decontaminate  passages of the benchmark are cut out; documents that are
                  mostly benchmark go
4. pii            personal data is replaced by its kind
5. sentencepiece  texts become piece ids that decode to the same text

Stages 1 to 4 return the columns of documents (doc_id, text, lang, source,
n_chars); columns beyond these are not carried along.  Null texts pass
through as null until the last stage, which encodes them as no pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rankfold.llm import decontaminate, near_dup, pieces, pii, toxicity
from rankfold.llm.common import bounded_batches, documents, stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs, labels)
    return toxicity.score(docs, model, tuple(COLUMNS)).where("predicted = 0").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return near_dup.deduplicate(docs).select(*COLUMNS)


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*COLUMNS)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return pii.redact(docs).select(*COLUMNS)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return pieces.encode(docs, keep=("doc_id", "lang", "source", "n_chars"), check=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontaminate", cut_benchmark),
    ("pii", mask_personal_data),
    ("sentencepiece", encode_pieces),
]

#: trained networks, sampled hashes and Viterbi paths have no SQL form; the
#: stages are tested against brute-force versions instead
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; every stage's rows but the
    last's are written to the shared folder and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
