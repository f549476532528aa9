"""A corpus pipeline of five stages, each one of the operators of tessella.llm.

A stage takes (spark, docs, sf_dir) and gives the documents that it keeps, with the columns of documents; the last gives
the packed pieces. Each stage's result is written and read again before the next.

In every stage a row with a null or repeated doc_id is judged by itself, null and empty texts are kept (they are neither
toxic, copies, leaks nor secrets), repeated rows are copies of each other, of which the second stage keeps one, other columns
go through unread, and an empty table gives an empty table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import common, decontam, ngram_join, packing, secrets, toxicity
from tessella.llm.queries import tokenizer_path


#: Rows of an Arrow batch: of texts of a few kilobytes, Spark's 10,000 rows take tens of megabytes in every task, twice.
BATCH = 1000


def _small_batches(spark: SparkSession) -> None:
    """Sets BATCH for the session, unless it has a number of its own."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(BATCH))


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from the labels that aren't held out, scores below 0.5."""
    _small_batches(spark)
    return toxicity.kept(docs, common.table(spark, sf_dir, "labels"))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of rows linked by a similarity of 0.75 or more, the one with the smallest id (the first of such rows;
    one without an id only where none has one)."""
    _small_batches(spark)
    rows, row = common.keyed(docs)
    groups = common.keep(ngram_join.join(rows, id_col=row).join(rows.select(row, "doc_id"), row).select(row, "doc_id", "component_id"), "groups")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", row))
    least = common.keep(groups.groupBy("component_id").agg(first.alias("first")).select(f"first.{row}"), "least")
    copies = common.keep(groups.select(row).join(least, row, "left_anti"), "copies")
    return ngram_join.without(rows, row, copies).select(*docs.columns)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no copy of a test item."""
    _small_batches(spark)
    return decontam.clean(docs, common.table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, the secrets in them replaced by a mark and n_chars set anew where there were any. A null text stays
    null; rows with null or repeated ids are each redacted by their own text."""
    _small_batches(spark)
    return secrets.redacted(docs, length_col="n_chars")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 tokens."""
    _small_batches(spark)
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [("toxicity", without_toxic), ("ngram_jaccard_join", without_copies), ("benchmark_decontamination", without_benchmark), ("secret_scans", without_secrets), ("best_fit_packing", packed)]
#: SQL can't express the classifier, the alignment or the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
