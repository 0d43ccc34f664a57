"""A training corpus from `documents`, in five stages. Belongs to the llm subpackage.

Each stage is a function of (spark, docs, sf_dir); its result is written as Parquet and read again as the next one's
docs. All but the last return the columns of `documents`, and pass through any others.

Defined cases, the same in all stages: a null or empty text is a document like any other, which is kept unless its site
speaks against it, has no line to lose, no copy and no benchmark passage, and is packed as the end-of-document token;
null ids, sources and languages stay null, and null ids count as the largest; repeated rows are copies, of which one
stays; very long texts are read whole; an empty table stays empty; columns named as the operators' results or their own
variables don't matter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import leaks, lines, packing, quality, similar
from ledgerloom.llm.common import drop, dropping, read, written


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxic documents and junk go."""
    return quality.keep_good(docs, read(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shared lines stay in one document; text and n_chars change, no document goes."""
    kept = lines.drop_shared_lines(docs)
    own = {"text": F.col("kept"), "n_chars": F.length("kept").cast("long")}
    return kept.select(*[own[c].alias(c) if c in own else F.col(c) for c in docs.columns])


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, that of the smallest id."""
    return similar.one_of_each(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return leaks.drop_leaks(docs, read(spark, sf_dir, "benchmark"))


def hilbert_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, packed into sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("benchmark decontamination", benchmark_decontamination),
    ("packing", hilbert_packing),
]

#: Fitting a classifier and tokenizing are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from documents on. What a stage has written goes when the next one's docs are there."""
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        if k + 1 == len(STAGES):
            return stage(spark, docs, sf_dir)
        with dropping(spark) as kept:
            after = written(stage(spark, docs, sf_dir), f"stage-{k}")
            kept.append(after._table)
        if k:
            drop(docs)
        docs = after
