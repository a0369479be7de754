"""The corpus pipeline: language ID, line dedup, SimHash near-dedup, decontamination, BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next stage's documents. All but the last return
the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheafline.llm import bpe, decontam, langmix, linedrop, nearcopies, simhash
from sheafline.llm.queries import vocabulary_path
from sheafline.session import made_so_far, release, staged, table

#: Up to so many removed ids (8 bytes each, so 16 MB) go to all tasks; more are joined by a shuffle.
BROADCAST_IDS = 2_000_000


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in learned languages: those go that have no letter (or text), or that the model explains no better than noise for the most part.

    The model is learned from the documents themselves. Rows are judged one by one,
    whatever their id; no labelled row leaves all with a letter.
    """
    return langmix.known_language_only(docs, langmix.train(docs.filter(~langmix.held_out())))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that three documents hold, except in the last of these.

    A null text stays null; a row without an id keeps no copy that another document holds.
    """
    cleaned = linedrop.drop_lines(docs, rewrite=True)
    if "n_chars" in docs.columns:
        cleaned = cleaned.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return cleaned.select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near copies.

    Rows without an id stay; of rows that share an id all stay or go, as the id does. Near copies have fingerprints at most two bits apart, or five-word shingles with a Jaccard similarity of 0.8 or more.
    """
    seen = staged(nearcopies.sketch_table(docs), "sketches")
    groups = simhash.simhash_components(docs, own=seen.select("doc_id", "fp"), more_links=nearcopies.near_links(docs, seen))
    gone = staged(groups.filter(F.col("component_id") != F.col("doc_id")).select(F.col("doc_id").alias("gone_id")).distinct(), "gone")
    if gone.count() <= BROADCAST_IDS:
        gone = F.broadcast(gone)
    return docs.join(gone, docs["doc_id"] == gone["gone_id"], "left_anti")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; null and empty texts hold none, rows are judged one by one."""
    return decontam.drop_leaked(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts, and digests of ids and decoded text, of what is left, a row each; a null text counts as empty."""
    return bpe.bpe_round_trip(docs, vocabulary_path())


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontaminate),
    ("bpe", encode),
]

#: SQL has neither the language model nor SimHash's hash function; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each written and read again."""
    docs, mark = table(spark, sf_dir, "documents"), made_so_far(spark)
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
        release(spark, mark, keep=1)  # what the stage needed is read
    return STAGES[-1][1](spark, docs, sf_dir)
