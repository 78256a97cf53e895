"""The stages on a small table, each against what it should keep; the whole run on given tables."""

import numpy as np
import pytest

import corpus_pipeline as pipeline

RNG = np.random.default_rng(11)
VOCABULARY = [f"word{i}" for i in range(3000)]
FIELDS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(n):
    return " ".join(RNG.choice(VOCABULARY, n))


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    passage, item = prose(60), prose(30)
    good = [prose(150) for _ in range(60)]
    texts = [*good]
    copies = {60: good[3], 61: " ".join(good[4].split()[:75] + ["changed"] + good[4].split()[76:])}
    shared = {62: prose(100) + " " + passage + " " + prose(50), 63: prose(80) + " " + passage + " " + prose(70)}
    leaked = {64: prose(60) + " " + " ".join(item.split()[5:20]) + " " + prose(60)}
    toxic = {65 + i: prose(40) + " vile scum " + prose(40) + " vile" for i in range(40)}
    junk = {105 + i: " | ".join(prose(3) for _ in range(15)) for i in range(40)}
    odd = {145: None, 146: ""}
    rows = [(i, t) for i, t in enumerate(texts)] + [(i, t) for group in (copies, shared, leaked, toxic, junk, odd) for i, t in group.items()]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], FIELDS)
    docs.coalesce(2).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, 1, 0) for i in range(50)] + [(i, 1, 1) for i in range(65, 95)] + [(i, 0, 0) for i in range(105, 135)] + [(999, 1, None), (None, 1, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(0, item), (1, None), (2, "")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, passage


def test_stages(spark, tables):
    folder, passage = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {}
    for name, stage in pipeline.STAGES:
        docs = pipeline.stored(stage(spark, docs, folder), name)
        kept[name] = {r.doc_id: r for r in docs.collect()}
        if name != "packing":
            assert docs.schema.simpleString() == spark.read.parquet(f"{folder}/documents.parquet").schema.simpleString()
    clean = {*range(60), 60, 61, 62, 63, 64}
    assert clean <= kept["quality"].keys() and not kept["quality"].keys() & {*range(65, 145)}
    assert kept["near_duplicates"].keys() >= {*range(60), 62, 63, 64} and not kept["near_duplicates"].keys() & {60, 61, 146}
    assert passage in kept["repeats"][62].text and passage[:150] not in kept["repeats"][63].text
    assert kept["repeats"][63].n_chars == len(kept["repeats"][63].text)
    assert all(kept["repeats"][i].text == kept["near_duplicates"][i].text for i in range(60))
    assert kept["decontamination"].keys() == kept["repeats"].keys() - {64}
    assert kept["packing"].keys() == kept["decontamination"].keys()


def test_run_is_the_stages_one_after_the_other(spark, tables):
    folder, _ = tables
    rows = pipeline.run(spark, folder).collect()
    assert {r.doc_id for r in rows} >= {*range(60), 62, 63}
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in sequences.values():
        places.sort()
        assert [a for a, _ in places] == np.cumsum([0, *[n for _, n in places[:-1]]]).tolist() and sum(n for _, n in places) <= 2048


def test_empty_documents(spark, tables, tmp_path):
    folder, _ = tables
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    spark.createDataFrame([], FIELDS).write.parquet(f"{tmp_path}/documents.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0


def test_given_tables(spark):
    from textrec.llm.common import read

    folder = "/root/testdata/sf0.01"
    docs = read(spark, folder, "documents")
    good = pipeline.stored(pipeline.keep_good(spark, docs, folder), "good")
    toxic = read(spark, folder, "labels").where("toxic = 1")
    assert good.join(toxic, "doc_id").count() <= 0.05 * toxic.count()
    one = pipeline.stored(pipeline.keep_one_of_each_group(spark, good, folder), "one")
    assert one.select("text").distinct().count() == one.count() < good.count()
