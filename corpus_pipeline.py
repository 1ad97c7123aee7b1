"""From documents to packed training sequences: five stages, each an operator of quantloom.llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next one's docs. All
but the last return the columns of documents. doc_id names a document; rows without one take no part in groups and stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quantloom.llm import decontaminate, jaccard, packing, pii, quality
from quantloom.llm.shared import stash

#: Documents that score less are rejected.
LEAST_QUALITY = 0.3


#: Documents that go to a Python worker together. Whole texts are long: Spark's default of 10,000 rows is tens of MB a batch, on both
#: sides, in every worker of an executor.
DOCUMENTS_PER_BATCH = 1000
PER_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def _in_small_batches(spark: SparkSession) -> None:
    """Lower the session's rows of a batch to DOCUMENTS_PER_BATCH; a lower setting stays."""
    if not 0 < int(spark.conf.get(PER_BATCH)) <= DOCUMENTS_PER_BATCH:
        spark.conf.set(PER_BATCH, DOCUMENTS_PER_BATCH)


def _as_documents(out: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs; where there is n_chars it follows the text."""
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(docs.columns)


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Those that the quality classifier, fitted on the labels of these documents, does not reject.

    A null or empty text scores the model's bias and stays or goes by it; repeated rows are judged alike; null ids are scored too,
    but teach nothing. Columns of any names stay. An empty table gives none.
    """
    _in_small_batches(spark)
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    judged = quality.scored(docs.select(F.struct("*").alias("row"), "text"), model)
    return judged.where(F.col("score") >= LEAST_QUALITY).select("row.*")


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest doc_id.

    Rows without a doc_id are in no group and stay; rows that share the smallest doc_id, repeated ones too, all stay, for doc_id
    names a document. Texts that are null or without words are like no other. An empty table gives none.
    """
    _in_small_batches(spark)
    others = jaccard.groups(docs).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(others, "doc_id", "left_anti").select(docs.columns)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of benchmark items; those that are mostly such passages go.

    Null and empty texts have no passages and stay as they are; so do null ids and repeated rows, each judged alone.
    """
    _in_small_batches(spark)
    return _as_documents(decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")), docs)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind. No row goes; null and empty texts, null ids and repeated rows stay."""
    _in_small_batches(spark)
    return _as_documents(pii.redact(docs), docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each piece of each document with its place in the training sequences.

    A null or empty text is the one piece of id 0; null ids are kept; repeated rows are packed as often as they occur; an empty
    table gives none.
    """
    _in_small_batches(spark)
    return packing.pack_documents(docs)


STAGES = [
    ("quality_classifier", good_documents),
    ("ngram_jaccard_join", one_of_each_group),
    ("benchmark_decontamination", without_benchmark),
    ("pii", without_personal_data),
    ("best_fit_packing", packed),
]

#: SQL can't train the classifier or tokenise; the stages are tested one by one and run() against their plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stash(docs)
    return docs
