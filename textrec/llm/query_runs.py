"""The query of periodic runs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textrec.llm.common import read
from textrec.llm.periodic import periodic_runs
from textrec.llm.registry import query


def planted(text: Column, doc_id: Column) -> Column:
    """A text, in a tenth of the documents with its words from some place on repeated from there."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeated(words: Column) -> Column:
        n = F.size(words)
        a = (g % n).cast("int")
        p = (F.floor((n - a) / (g % 8 + 3)) + 1).cast("int")
        return F.transform(words, lambda word, i: F.when(i < a, word).otherwise(F.get(words, a + (i - a) % p)))

    # Bound by a list of one, so that a text is split once and not once a word.
    split = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda word: word != "")
    made = F.transform(F.array(split), lambda words: F.when(F.size(words) > 0, F.array_join(repeated(words), " ")))
    return F.when(h % 10 == 0, F.get(made, F.lit(0))).otherwise(text)


@query()
def op12_runs(spark, folder):
    """Periodic runs of every document: the number, the longest, and digests of all and of what is left."""
    docs = read(spark, folder, "documents").select("doc_id", planted(F.col("text"), F.col("doc_id")).alias("text"))
    found = periodic_runs(docs)
    ranked = F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period")))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    listed = F.when(F.size("runs") > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise("")
    best = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), F.array_min(ranked).alias("best"), listed.alias("listed"), "collapsed")
    return best.select(
        "doc_id",
        "n_runs",
        F.col("best.start").alias("start"),
        (-F.col("best.less")).alias("length"),
        F.col("best.period").alias("period"),
        F.floor(-F.col("best.less") * 1000 / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.col("listed").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
