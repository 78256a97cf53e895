"""Queries over embeddings: near-duplicates, whitening."""

from __future__ import annotations

from pyspark.sql import functions as F

from textrec.llm.common import read
from textrec.llm.embeddings import near_vectors
from textrec.llm.registry import query
from textrec.llm.whitening import whitened


@query("""WITH RECURSIVE whole AS (
    SELECT row_number() OVER () AS r, vec_id, [CAST(x AS DOUBLE) FOR x IN embedding] AS v,
           embedding IS NOT NULL AND len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
           AND len([x FOR x IN embedding IF x <> 0]) > 0 AS usable FROM embeddings),
links AS (
    SELECT a.r AS a, b.r AS b, b.vec_id FROM whole a JOIN whole b ON a.r <> b.r AND a.usable AND b.usable
    WHERE list_inner_product(a.v, b.v) / (sqrt(list_inner_product(a.v, a.v)) * sqrt(list_inner_product(b.v, b.v))) >= 0.95),
reached(a, b) AS (SELECT r, r FROM whole UNION SELECT reached.a, links.b FROM reached JOIN links ON reached.b = links.a),
found AS (SELECT a, min(vec_id) AS component_id FROM reached JOIN whole ON b = r GROUP BY a),
counted AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM whole JOIN found ON found.a = r LEFT JOIN counted ON counted.a = r""")
def op11_vectors(spark, folder):
    """Links and component of every vector."""
    return near_vectors(read(spark, folder, "embeddings"))


@query()
def op13_whitening(spark, folder):
    """Every vector on the 32 leading components, whitened."""
    made = whitened(read(spark, folder, "embeddings"))
    return made.withColumn("deviation", F.col("deviation").try_cast("long"))
