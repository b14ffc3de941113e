"""The corpus pipeline: stages over documents, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pipelens.llm import familiar, langid, line_dedup, mixing, sentencepiece_ops, simhash
from pipelens.llm._shared import col, fresh, new_path


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter go, and those that are not like the texts of the language they were taken for, by a
    likelihood whose tables and threshold are counted over all labelled rows. The network starts from a fit on a sample
    and is trained on all of them."""
    rows = docs.where(~langid.held_out())
    gate, counts = familiar.calibrate_all(rows)
    return familiar.keep_known(docs, langid.refine(rows, langid.fit(rows, F.col("doc_id")), counts), gate)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of a passage go from the texts, and documents of which nothing else is left; n_chars follows."""
    out = line_dedup.dedup_lines(docs)
    n_lines, n_removed = out.columns[-2:]
    kept = out.where((F.col(n_removed) == 0) | (F.col(n_lines) > F.col(n_removed)))
    return kept.select(*(F.when(F.col(n_removed) > 0, F.char_length("text")).otherwise(F.col("n_chars")).cast("long").alias(c) if c == "n_chars" else col(c) for c in docs.columns))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.8 over five-word shingles, that with the smallest id stays.
    Documents with the same id stay together; so do all with a null id, if a group has no other."""
    kept = fresh(docs, "kept_id")[0]
    groups = simhash.group_similar(docs).where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias(kept)).distinct()
    return docs.join(groups, F.col("doc_id").eqNullSafe(F.col(kept)), "left_semi")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in files whose order mixes the sources by the target weights 5, 3 and 1."""
    return mixing.mix(docs, mixing.in_turn())


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document, by their digest and that of the text they decode to."""
    return sentencepiece_ops.digests(spark, docs)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_repeated_lines),
    ("simhash_near_dedup", drop_near_copies),
    ("mix_sources", mix_sources),
    ("sentencepiece", encode_pieces),
]

#: The network, the fingerprints and the pieces have no SQL form; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = new_path(spark, name)
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
