"""A cleaning run over documents: five stages, each written before the next one reads it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textrec.llm.common import read, stored
from textrec.llm.decontaminate import clean_documents
from textrec.llm.packing import pack_pieces, token_pieces
from textrec.llm.quality import GOOD, GRADES, fit_graded, rated_grades, with_tail
from textrec.llm.repeats import remove_repeats
from textrec.llm.simhash import SIMILAR_BITS, SIMILAR_BLOCKS, SIMILAR_WORDS, one_of_each_group

# Documents stay if they are good with this chance or more.
LEAST_CHANCE = 0.5


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the classifier, fitted on the labels, holds for toxic or of low quality."""
    model = fit_graded(docs, rated_grades(read(spark, sf_dir, "labels")), GRADES)
    chance = f"_{uuid.uuid4().hex}"  # no column of the documents
    return with_tail(docs, model, GOOD, chance).where(F.col(chance) >= LEAST_CHANCE).drop(chance)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of copies and near copies."""
    return one_of_each_group(docs, shingle_words=SIMILAR_WORDS, thresholds=SIMILAR_BITS, blocks=SIMILAR_BLOCKS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts strings of 100 bytes or more out of all documents but the first that has them."""
    return remove_repeats(docs, as_text=True).withColumn("n_chars", F.length("text").cast("long"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a passage of the benchmark."""
    return clean_documents(docs, read(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of each piece of each document in sequences of 2048 tokens."""
    return pack_pieces(token_pieces(docs, derived={"ids_crc32": F.crc32("ids")}).drop("ids"))


STAGES = [
    ("quality", keep_good),
    ("near_duplicates", keep_one_of_each_group),
    ("repeats", cut_repeats),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

# Hashing, regression and tokens are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
