"""The corpus pipeline: quality, near duplicates, decontamination, secrets, tokens.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before kept; all
but the last return the columns of ``documents``. Between stages the rows are written to the
shared folder and read again, which cuts lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pagelattice.llm import bpe, decontaminate, jaccard_join, quality, secret_scan
from pagelattice.llm.common import Written, table

#: Near duplicates of the pipeline: shingles of five words, 80 % of them shared.
SHINGLE, PERCENT = 5, 80
#: Chunks whose encoding a worker keeps; fewer than in the query alone, since workers of other stages wait beside it.
KEPT_CHUNKS = 60_000


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: documents whose perplexity exceeds their language's limit go."""
    return quality.kept(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: of each group of near duplicates the document with the smallest doc_id stays.

    Rows are judged one by one, by their text: of several texts with one doc_id each stays or goes with its own group.
    A document without words, or without doc_id, is no duplicate.
    """
    return jaccard_join.representatives(docs, SHINGLE, PERCENT)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: benchmark passages are cut out; a document that mostly consists of them goes."""
    return decontaminate.cleaned(docs, table(spark, sf_dir, "benchmark"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: every secret is replaced by a mark."""
    return secret_scan.redacted(docs)


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: each document's number of tokens and the digests of its ids and of its decoded text."""
    return bpe.digest(docs, kept=KEPT_CHUNKS)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("secret_scans", secret_scans),
    ("bpe_encoding", bpe_encoding),
]

#: SQL cannot express the trained model, the automaton and the tokenizer; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            written = Written(docs)
            docs = written.df
            if before is not None:
                before.drop()
            before = written
    return docs
