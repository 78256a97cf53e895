"""Queries over whole texts: packing, scoring, quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from textrec.llm.common import read
from textrec.llm.packing import pack_pieces, token_pieces
from textrec.llm.ppm import score_documents
from textrec.llm.quality import GRADES, fit_graded, grade_documents, rated_grades
from textrec.llm.registry import query


@query()
def op4_packing(spark, folder):
    """The place of every document's pieces in sequences of 2048 tokens."""
    pieces = token_pieces(read(spark, folder, "documents"), derived={"ids_crc32": F.crc32("ids")})
    return pack_pieces(pieces.drop("ids"))


@query()
def op8_quality(spark, folder):
    """Expected grade of every document, its chance to be no worse than low or good, and the decision."""
    docs = read(spark, folder, "documents")
    model = fit_graded(docs, rated_grades(read(spark, folder, "labels")), GRADES)
    graded = grade_documents(docs, model)
    low, good = F.col("tails")[0], F.col("tails")[1]
    return graded.select("doc_id", "score", "expected_grade", low.alias("p_not_toxic"), good.alias("p_good"), (good >= 0.5).alias("kept"))


@query()
def op10_ppm(spark, folder):
    """The log10 probability of every document, by words and by byte contexts, learned from four fifths of them."""
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 1
    scored = score_documents(read(spark, folder, "documents"), ~held)
    return scored.withColumn("held_out", held)
