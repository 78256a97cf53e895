"""Tables whose further columns have the names that the operators use inside."""

import pytest
from pyspark.sql import functions as F

from textrec.llm.repeats import remove_repeats
from textrec.llm.sharding import place
from textrec.llm.simhash import near_duplicates, one_of_each_group

TEXT = " ".join(f"word{i}" for i in range(40))
NAMES = ["_id", "_text", "_kept", "_bytes", "_starts", "_ends", "_slot", "_print", "_own", "_component", "_root", "_place", "id", "text_", "chunk", "rows", "marks", "c0", "print", "root", "a.b", "bucket"]


@pytest.fixture
def docs(spark):
    rows = [(1, TEXT), (2, TEXT), (2, "other text " * 30), (None, TEXT + " more"), (3, None)]
    schema = "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in NAMES)
    return spark.createDataFrame([(*r, *[f"{n}{i}" for n in NAMES]) for i, r in enumerate(rows)], schema)


def test_repeats(docs):
    cut = remove_repeats(docs, as_text=True)
    assert cut.schema == docs.schema
    whole = {r["_id"]: r for r in docs.collect()}
    for r in cut.collect():
        assert all(r[n] == whole[r["_id"]][n] for n in NAMES)
    more = remove_repeats(docs)
    assert more.columns == ["doc_id", *NAMES, "n_bytes", "starts", "ends", "kept"] and more.count() == 5


def test_groups(docs):
    kept = one_of_each_group(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r["_id"]) for r in kept.collect()) == [(1, "_id0"), (2, "_id2"), (3, "_id4")]
    assert near_duplicates(docs).count() == 5


def test_shards(docs):
    placed = place(docs, ["doc_id"], ["x", "y"])
    assert placed.columns == [*docs.columns, "slot", "shard"] and placed.count() == 5
    assert placed.where(F.col("_slot") == "_slot0").count() == 1
