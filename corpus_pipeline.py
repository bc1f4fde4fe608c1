"""A corpus pipeline: quality, near duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and works on everything that the stage before
it kept; its result is written as Parquet and read again as the next one's documents.
All but the last return the columns of documents, whatever other columns there are
beside doc_id, text, lang and n_chars. In every stage:

* a null text and an empty one are kept as they are; both are a piece of one token;
* a text of any length is worked on whole;
* rows that repeat an id are one document for near duplicates and passages: all of
  them are kept or go together, and none is cut because of another;
* rows without an id are judged by quality, never go as near duplicates, and count as one document
  after all others where passages are cut;
* an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidefold.llm import minhash, packing, quality, substring_dedup
from tidefold.llm.shared import table, written

BROADCAST_ROWS = 1_000_000


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps; it is trained on those that labels call good."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near duplicates (five-word shingles, similarity 0.8)."""
    found = minhash.near_duplicates(docs)
    gone = written(found.where("id <> component").select("id").distinct(), "gone")
    if gone.count() <= BROADCAST_ROWS:
        gone = F.broadcast(gone)
    return docs.join(gone, docs.doc_id == gone.id, "left_anti")


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of 20 and more words that an earlier document has; n_chars is counted anew."""
    out = substring_dedup.substring_dedup(docs).withColumn("n_chars", F.when(F.col(substring_dedup.REMOVED) > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in training sequences of at most 2048 tokens."""
    return packing.pack(docs, packing.tokenizer_path())


STAGES = [("quality", good_documents), ("near_duplicates", distinct_documents), ("repeated_passages", without_repeats), ("packing", packed_sequences)]

#: SQL can't express the language model, nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage_{name}")
    return docs
