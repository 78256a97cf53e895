"""Packing: round trips, and bins against the least possible number."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textrec.llm import packing


def unpacked(bins, counts, capacity):
    got = {}
    for content, n in bins:
        assert n > 0 and 0 < sum(k * c for k, c in content.items()) <= capacity
        for k, c in content.items():
            got[k] = got.get(k, 0) + c * n
    assert got == {k: c for k, c in counts.items() if c}
    return sum(n for _, n in bins)


@pytest.mark.parametrize("shape", ["mixed", "large", "small", "halves", "one"])
def test_few_bins(shape):
    rng = np.random.default_rng(1)
    lengths = {
        "mixed": np.minimum(rng.lognormal(6.5, 0.9, 30_000).astype(int) + 1, 2048),
        "large": rng.integers(700, 2049, 20_000),
        "small": rng.integers(1, 200, 50_000),
        "halves": np.full(9_999, 1024),
        "one": np.array([1]),
    }[shape]
    values, n = np.unique(lengths, return_counts=True)
    counts = dict(zip(values.tolist(), n.tolist()))
    bins = unpacked(packing.pack_lengths(counts), counts, 2048)
    # Lower bounds: all tokens, and pieces of over half a sequence, none of which share one.
    least = max(-(-int(lengths.sum()) // 2048), int((lengths > 1024).sum()))
    assert bins <= 1.01 * least + 2


def test_many_group_lengths_beside_a_session(spark):
    """All 128 groups have lengths of their own; the solver runs in the driver of a session that has worked."""
    assert spark.range(10).count() == 10
    docs = spark.range(20_000).select(
        F.col("id").alias("doc_id"), F.lit(0).alias("piece"), (F.pmod(F.xxhash64("id"), F.lit(1349)) + 700).alias("length"), F.lit(0).alias("slot")
    )
    pieces = docs.withColumn("place", F.row_number().over(Window.partitionBy("length").orderBy("doc_id")) - 1)
    got = packing.pack_pieces(pieces).groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"))
    bins, tokens, most, gaps = got.agg(F.count("*"), F.sum("n"), F.max("n"), F.count_if(F.col("n") != F.col("end"))).first()
    large = docs.where("length > 1024").count()
    assert most <= 2048 and gaps == 0 and bins <= 1.01 * max(large, tokens / 2048) + 2


def test_equal_groups_of_one_length_and_leftovers():
    for counts in ({}, {5: 0}, {2048: 3}, {300: 1}, {300: 7, 1748: 7, 1: 9}, {1025: 10, 1023: 10}):
        assert unpacked(packing.pack_lengths(counts), counts, 2048) >= 0
    assert unpacked(packing.pack_lengths({1025: 10, 1023: 10}), {1025: 10, 1023: 10}, 2048) == 10


def test_documents_come_back(spark):
    rng = np.random.default_rng(0)
    texts = [" ".join(f"Word{w}" for w in rng.integers(0, 5000, n)) for n in rng.integers(0, 300, 200)]
    texts += ["", None, "long été " * 3000, "<|endoftext|> in it", texts[0], texts[0]]
    rows = [(i, t, 1, "x") for i, t in enumerate(texts)] + [(None, "no id", 1, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length int, slot string").repartition(4)
    out = packing.pack_documents(docs, capacity=256).collect()
    encode = packing.Encoder(packing.VOCABULARY)
    own = {}
    for r in out:
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == r.length <= 256
        own.setdefault(r.doc_id, []).append((r.piece, r.start, ids))
    for i, text, *_ in rows:
        pieces = sorted(own[i], key=lambda p: p[0])
        whole = np.concatenate([p[2] for p in pieces])
        assert whole.tolist() == [*encode.file.encode(text or "", add_special_tokens=False).ids, 0]
        assert [p[1] for p in pieces] == np.cumsum([0, *[len(p[2]) for p in pieces[:-1]]]).tolist()
        assert all(len(p[2]) == 256 for p in pieces[1:]) and (len(pieces) == 1 or len(whole) > 256)
    sequences = {}
    for r in out:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in sequences.values():
        places.sort()
        assert [p[0] for p in places] == np.cumsum([0, *[p[1] for p in places[:-1]]]).tolist()
        assert sum(p[1] for p in places) <= 256
    assert len(sequences) <= 1.05 * sum(r.length for r in out) / 256 + 2
    assert packing.pack_documents(docs.limit(0)).count() == 0
    assert zlib.crc32(out[0].ids) >= 0


def test_fast_and_file_ids_agree():
    encode = packing.Encoder(packing.VOCABULARY)
    for text in ("a  b\t\n c", "don't I'll 123 ١٢٣ ½", "日本語 mixed ÉÑ x y​", "🙂👍🏽 é", "\x00\x1f x\r\n\r\n ", "  lead and trail  ", "A" * 5000):
        assert encode(text) == encode.file.encode(text, add_special_tokens=False).ids


def test_query_as_encoding_one_by_one(spark, tmp_path):
    from textrec.llm.query_text import op4_packing

    texts = ["", None, "short text", "long text " * 3000, "été " * 900, "<|endoftext|> there"] + [f"document {i} " * (i * 7) for i in range(30)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    encode, want = packing.Encoder(packing.VOCABULARY), set()
    for i, text in enumerate(texts):
        ids = np.array([*encode.file.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        for piece, (start, length) in enumerate(packing.cuts(len(ids), 2048)):
            want.add((i, piece, start, length, zlib.crc32(ids[start : start + length].tobytes())))
    rows = op4_packing(spark, str(tmp_path)).collect()
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows} == want and len(rows) == len(want)
    places = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in places.values():
        own.sort()
        assert [a for a, _ in own] == np.cumsum([0, *[n for _, n in own[:-1]]]).tolist() and sum(n for _, n in own) <= 2048


def test_tokenizer_file_is_loaded_for_special_tokens_only():
    encode = packing.Encoder(packing.VOCABULARY, packing.special_tokens(packing.VOCABULARY))
    assert encode("plain text") and "file" not in vars(encode)
    assert encode("<|endoftext|> there") == packing.Encoder(packing.VOCABULARY).file.encode("<|endoftext|> there", add_special_tokens=False).ids
    assert "file" in vars(encode)


def test_ids_are_not_read_again_for_their_digest(spark, tmp_path):
    from textrec.llm.query_text import op4_packing

    spark.createDataFrame([(1, "some text"), (2, None), (2, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = op4_packing(spark, str(tmp_path))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "ids_crc32:bigint" in plan and "ids:binary" not in plan
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert [r.ids_crc32 for r in out.orderBy("doc_id").collect()][1:] == [zlib.crc32(bytes(4))] * 2
