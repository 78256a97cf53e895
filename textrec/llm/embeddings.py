"""Near-duplicate vectors: small-world graphs per shard, audited beams, exact cosines, components."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textrec.llm.common import open_array, save_arrays, scratch
from textrec.llm.components import stars
from textrec.llm.hnsw import Graph
from textrec.session import stored

# Cosine at which vectors link.
LEAST_COSINE = 0.95

# Shards at least, vectors and bytes of a shard at most, queries of a task, shards that a task's queries visit.
SHARDS, SHARD_ROWS, SHARD_BYTES = 8, 32_768, 64 << 20
BLOCK_QUERIES, SHARDS_PER_TASK = 1_024, 16

# Vectors that the audit asks for, once as they are and once turned away to the least cosine; the share of links that
# it must find; the beam it begins with.
AUDIT_ROWS, RECALL, BEAM = 512, 0.995, 16

# Single precision is this far from double at most.
SLACK = 1e-5


def _usable(vector: str) -> Column:
    """Whether a vector has a direction: not null, without null or non-finite components, not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array, width: int | None = None) -> np.ndarray:
    """Vectors as rows, scaled so that their largest component is 1; missing components are 0."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.diff(lists.offsets.to_numpy())
    width = int(lengths.max(initial=0)) if width is None else width
    out = np.zeros((len(lists), max(width, int(lengths.max(initial=0)))))
    out[np.arange(out.shape[1]) < lengths[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out / np.abs(out).max(axis=1, initial=0, keepdims=True) if len(out) else out


def _norms(rows: np.ndarray) -> np.ndarray:
    return np.sqrt(np.einsum("ij,ij->i", rows, rows))


def _build(folder: str, width: int):
    """Function that writes the graph of one shard to the shared folder and gives its name."""

    def build(table: pa.Table) -> pa.Table:
        rows, nodes = _matrix(table.column("v"), width), table.column("node").to_numpy()
        order = np.random.default_rng(0).permutation(np.argsort(nodes))
        rows, norms = rows[order], _norms(rows)[order]
        unit = (rows / norms[:, None]).astype(np.float32)
        name = f"{folder}/{uuid.uuid4().hex}"  # a repeated task writes a folder of its own
        arrays = {"rows": rows, "norms": norms, "unit": unit, "nodes": nodes[order], "copies": table.column("copies").to_numpy()[order]}
        graph = Graph.build(unit)
        save_arrays(name, arrays | {f"links{i}": x for i, x in enumerate(graph.links)})
        return pa.table({"shard": table.column("shard")[:1], "layers": pa.array([len(graph.links)], pa.int32()), "folder": [name]})

    return build


class _Shard:
    def __init__(self, layers: int, folder: str):
        self.rows, self.norms, self.nodes, self.copies = (open_array(folder, x) for x in ("rows", "norms", "nodes", "copies"))
        self.graph = Graph(open_array(folder, "unit"), [open_array(folder, f"links{i}") for i in range(layers)])
        self.sorted = np.argsort(self.nodes)

    def linked(self, nodes: np.ndarray, rows: np.ndarray, norms: np.ndarray, beam: int, least: float) -> tuple[np.ndarray, np.ndarray]:
        """``(query, row)``: links by cosine in double precision, a query's own node left out."""
        at = np.minimum(np.searchsorted(self.nodes, nodes, sorter=self.sorted), len(self.nodes) - 1)
        own = np.where(self.nodes[self.sorted[at]] == nodes, self.sorted[at], -1)
        unit = (rows / norms[:, None]).astype(np.float32)
        q, v = self.graph.near(unit, own.astype(np.int32), beam, least - SLACK)
        exact = np.empty(len(q))
        for i in range(0, len(q), 1 << 16):
            a, b = q[i : i + (1 << 16)], v[i : i + (1 << 16)]
            exact[i : i + (1 << 16)] = np.einsum("ij,ij->i", rows[a], self.rows[b]) / (norms[a] * self.norms[b])
        fits = (exact >= least) & (own[q] != v)
        return q[fits], v[fits]


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect the same nodes: each with the smallest one reached from it."""
    names, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(names))
    while True:
        least = np.minimum(root[a], root[b])
        before = root.copy()
        for side in (a, b):
            np.minimum.at(root, root[side], least)
            np.minimum.at(root, side, least)
        root = root[root]
        if (root == before).all():
            break
    other = root != np.arange(len(names))
    return names[other], names[root[other]]


def _search(shards: list[tuple[int, str]], width: int, beam: int, least: float, per_task: int):
    """Function that looks for the links of queries ``(node, v, part)`` in the shards of their part.

    Gives a row ``(node, null, n)`` for each query, ``n`` the vectors it links to,
    copies included, and rows ``(u, v, null)`` of links that connect the same
    nodes as all links found.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_parts = batch.column("part").to_numpy()
            for part in np.unique(all_parts):
                mine = batch.filter(pa.array(all_parts == part))
                nodes, rows = mine.column("node").to_numpy(), _matrix(mine.column("v"), width)
                norms, n = _norms(rows), np.zeros(len(mine), np.int64)
                u, v = np.zeros(0, np.int64), np.zeros(0, np.int64)
                for layers, folder in shards[part * per_task : (part + 1) * per_task]:
                    shard = _Shard(layers, folder)
                    a, b = shard.linked(nodes, rows, norms, beam, least)
                    np.add.at(n, a, shard.copies[b])
                    u, v = forest(np.concatenate([u, nodes[a]]), np.concatenate([v, shard.nodes[b]]))
                nulls = lambda k: pa.nulls(k, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(nodes), nulls(len(nodes)), pa.array(n)], ["u", "v", "n"])
                if len(u):
                    yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), nulls(len(u))], ["u", "v", "n"])

    return run


def _audit_rows(some: list, width: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """The vectors the audit asks for: ``(node, row)``, first as they are, then turned by a random direction to the least cosine."""
    nodes = np.array([r["node"] for r in some], np.int64)
    rows = _matrix(pa.array([r["v"] for r in some], pa.list_(pa.float64())), width)
    unit = rows / _norms(rows)[:, None]
    aside = np.random.default_rng(1).normal(size=unit.shape)
    aside -= (aside * unit).sum(axis=1, keepdims=True) * unit
    size = _norms(aside)[:, None]
    turned = min(1.0, least + 1e-6) * unit + np.sqrt(max(0.0, 1 - (least + 1e-6) ** 2)) * np.divide(aside, size, out=np.zeros_like(aside), where=size > 1e-9)
    return np.concatenate([nodes, -1 - np.arange(len(nodes))]), np.concatenate([rows, turned])


def _links_by_force(nodes: np.ndarray, rows: np.ndarray, width: int, least: float):
    """Function that counts the links of the audit's queries to all rows of a batch."""
    norms = _norms(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for batch in batches:
            own, copies, ids = _matrix(batch.column("v"), width), batch.column("copies").to_numpy(), batch.column("node").to_numpy()
            lengths = _norms(own)
            for at in range(0, len(own), 2_048):
                cosine = np.einsum("ij,kj->ik", own[at : at + 2_048], rows, optimize=True) / (lengths[at : at + 2_048, None] * norms)
                linked = (cosine >= least) & (ids[at : at + 2_048, None] != nodes)
                n += int((linked * copies[at : at + 2_048, None]).sum())
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    return run


def audited_beam(classes: DataFrame, search, width: int, least: float, recall: float, beam: int, most: int) -> tuple[int, float]:
    """The first beam, doubled from ``beam`` on, whose searches find the share ``recall`` of an audit's links, and that share.

    The audit asks for ``AUDIT_ROWS`` vectors chosen by hash, as they are and
    turned away to the least cosine, so that there are links to be found where
    the vectors have none. What is to be found comes from all rows, compared one
    by one. A beam as wide as a shard misses nothing.
    """
    spark = classes.sparkSession
    some = classes.orderBy(F.xxhash64(F.lit("audit"), "node"), "node").limit(AUDIT_ROWS).collect()
    nodes, rows = _audit_rows(some, width, least)
    truth = classes.mapInArrow(_links_by_force(nodes, rows, width, least), "n long").agg(F.sum("n")).first()[0] or 0
    asked = spark.createDataFrame(pa.table({"node": nodes, "v": pa.array(rows.tolist(), pa.list_(pa.float64()))}))
    while True:
        found = search(asked, beam).agg(F.sum("n")).first()[0] or 0
        share = found / truth if truth else 1.0
        if share >= recall or beam >= most:
            return beam, share
        beam = min(2 * beam, most)


def near_vectors(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    least: float = LEAST_COSINE,
    recall: float = RECALL,
    shard_rows: int = SHARD_ROWS,
    beam: int = BEAM,
) -> DataFrame:
    """``(id_col, n_links, component_id, kept)`` of every row: how many others it links to, and the smallest id it reaches.

    Rows link where the cosine of their vectors, in double precision, is
    ``least`` or more. Equal vectors are one node with a number of copies. Nodes
    are dealt by hash to shards, each with a graph of its own in the shared
    folder; every node is looked for in every shard. The beam is doubled until
    an audit against all rows finds the share ``recall`` of its links. Found
    pairs are checked, counted and, task by task, thinned to links that connect
    the same nodes, so a group of very many near copies is counted in full but
    never listed pair by pair.

    Rows whose vector is null, empty, zero or holds a null or non-finite
    component link with nothing and are components of their own, as they are. A shorter
    vector counts as filled with zeros. Rows with a null id count and link, but
    cannot name a component: one of such rows only has a null id. Rows with the
    same id are rows of their own; ``kept`` says whether a row has its
    component's id. Other columns are not looked at; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    named = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"))
    usable = named.where(_usable("v"))
    alone = named.where(~_usable("v")).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    classes = stored(
        usable.groupBy("v").agg(F.min("id").alias("least"), F.count("*").alias("copies")).withColumn("node", F.monotonically_increasing_id()), "vectors"
    )
    nodes = classes.select("node", F.col("v").cast("array<double>").alias("v"), "copies")
    n, width = classes.agg(F.count("*"), F.max(F.size("v"))).first()
    width = width or 0
    per_shard = max(1, min(shard_rows, SHARD_BYTES // (4 * max(width, 1))))
    count = max(SHARDS, -(-n // per_shard))

    dealt = nodes.withColumn("shard", F.pmod(F.xxhash64(F.lit("shard"), "node"), F.lit(count)).cast("int"))
    built = dealt.repartitionByRange(count, "shard").groupBy("shard").applyInArrow(_build(scratch(spark, "graphs"), width), "shard int, layers int, folder string")
    shards = [(r["layers"], r["folder"]) for r in stored(built, "graphs").orderBy("shard").collect()]
    parts = -(-len(shards) // SHARDS_PER_TASK)

    def search(queries: DataFrame, beam: int) -> DataFrame:
        each = F.explode(F.sequence(F.lit(0), F.lit(max(parts, 1) - 1))).alias("part")
        tasks = max(1, parts) * max(1, -(-n // BLOCK_QUERIES))
        spread = queries.select("node", "v", each).repartitionByRange(tasks, "part", F.xxhash64(F.lit("query"), "node"))
        return spread.mapInArrow(_search(shards, width, beam, least, SHARDS_PER_TASK), "u long, v long, n long")

    if n:
        beam = audited_beam(nodes, search, width, least, recall, beam, per_shard)[0]
    found = stored(search(nodes.select("node", "v"), beam), "found")
    counts = found.where(F.col("n").isNotNull()).groupBy(F.col("u").alias("node")).agg(F.sum("n").alias("others"))
    roots = stars(found.where(F.col("v").isNotNull()).select("u", "v")).select(F.col("u").alias("node"), F.col("v").alias("root"))
    rooted = classes.select("node", "least", "copies").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    names = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_node = rooted.join(names, "root").join(counts, "node").select("node", (F.col("others") + F.col("copies") - 1).alias("n_links"), "component_id")
    by_vector = stored(classes.select("v", "node").join(by_node, "node").drop("node"), "answers")
    linked = usable.join(by_vector, "v").select("id", "n_links", "component_id")
    every = linked.union(alone).withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))
    return every.withColumnRenamed("id", id_col)
