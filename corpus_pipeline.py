"""A corpus pipeline in five stages: what goes is toxic, boilerplate or a near copy; what stays is mixed and packed.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
next one's docs. All but the last return the columns of documents: doc_id, text, lang, source, n_chars.

Nulls and empty texts: not toxic unless the model says so of a text without words; no lines to remove; alike to
each other, so that one stays; packed as a lone separator. The mix repeats documents of small sources at most
MOST_REPEATS times and loses none of non-empty text.

Very long texts are scored, deduplicated, compared and tokenised whole, each in its task. Ties: of near copies the smallest doc_id
stays, of rows of one doc_id and text the one of the smallest hash. Repeated rows, and rows of one doc_id with unlike texts, are
documents of their own until near-copy removal, after which equal ones are one. An empty table gives an empty result, of each stage and of all. Columns
beyond those of documents are dropped by the first stage, whatever their names. What near copies on five or more sites share is boilerplate
to the second stage, which knows exact copies only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mapfold.llm.common import discard, materialize, table
from mapfold.llm.line_dedup import dedup_lines
from mapfold.llm.mixing import mix_sources
from mapfold.llm.near_copies import drop_near_copies as one_of_each
from mapfold.llm.packing import pack_documents
from mapfold.llm.toxicity import toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
TOXIC, MOST_REPEATS = 0.5, 2.0
#: Near copies: five-word shingles, and the Jaccard similarity of their sets from which two documents are copies.
SHINGLE_WORDS, SIMILARITY = 5, 0.8


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a score under TOXIC; the labels are those of sf_dir."""
    return toxicity(docs, table(spark, sf_dir, "labels")).where(F.col("score") < TOXIC).select(*COLUMNS)


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many sources carry go, those of copies stay; n_chars follows the text."""
    return dedup_lines(docs).withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return one_of_each(docs, words=SHINGLE_WORDS, similarity=SIMILARITY).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources by temperature: none is repeated more than MOST_REPEATS times, the largest is seen once."""
    return mix_sources(docs, max_repeats=MOST_REPEATS).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences."""
    return pack_documents(docs)


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_boilerplate), ("simhash_near_dedup", drop_near_copies), ("mixing", mix), ("packing", pack)]

#: The model is trained, so SQL can't express the rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, materialize(stage(spark, docs, sf_dir), name)
        if i:  # the stage before this one has been read for the last time
            discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
