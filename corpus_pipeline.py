"""The corpus pipeline: quality rules, near-duplicates, repeated passages, benchmark passages, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
`documents`. What each decides takes effect: rejected, duplicate and contaminated documents go, repeated
passages leave the text (a document may end with an empty text), n_chars follows the text.

Defined cases: a null doc_id can't be told from others by a join on ids; such a document passes the
near-duplicate stage, and passes the quality stage only if all documents with a null doc_id do. Rows that repeat
a doc_id share its fate. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowsmith.llm import decontam, pieces, quality, simhash, substring
from rowsmith.llm.common import documents, drop_since, made, tune, write_table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: documents that the base rule or the outlier estimate rejects go."""
    tune(spark)
    bad = quality.quality(docs).filter(~F.col("kept")).select(F.col("doc_id").alias("bad_")).distinct()
    return docs.join(bad, docs.doc_id.eqNullSafe(bad.bad_), "left_anti")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: of documents with a 5-word shingle similarity of 0.8 or more the first by doc_id stays."""
    tune(spark)
    later = simhash.similar_groups(docs, words=5, similarity=0.8).filter("doc_id <> component_id").select(F.col("doc_id").alias("later_")).distinct()
    return docs.join(later, docs.doc_id == later.later_, "left_anti")


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: windows of 20 words that started earlier leave the texts."""
    tune(spark)
    return substring.dedup(docs, width=20, keep_columns=True)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: documents with a window of a benchmark item go."""
    tune(spark)
    return decontam.clean(docs, documents(spark, sf_dir, "benchmark"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: two sampled segmentations of every text."""
    tune(spark)
    return pieces.encode(docs, k=2, model="piece_bpe_32k.model", seed=0)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("benchmark_passages", benchmark_passages),
    ("token_ids", token_ids),
]

#: Robust estimates, fingerprints and sampled segmentations aren't SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is written to the shared folder and read again, and what
    the stages before it wrote there goes."""
    docs, mark = documents(spark, sf_dir), made()
    for name, stage in STAGES[:-1]:
        docs = write_table(stage(spark, docs, sf_dir), name)
        drop_since(spark, mark, docs)
    return STAGES[-1][1](spark, docs, sf_dir)
