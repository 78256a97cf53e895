"""Periodic runs against all stretches of all periods."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from textrec.llm import periodic
from textrec.llm.query_runs import op12_runs


def slow_runs(words, least=6, repeats=4):
    """For every period the longest stretches that have it, kept where no smaller period fits."""
    found, n = [], len(words)
    for q in range(1, n // repeats + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            stretch = words[i : j + q]
            smallest = next(p for p in range(1, q + 1) if all(a == b for a, b in zip(stretch, stretch[p:])))
            if smallest == q and len(stretch) >= max(least, repeats * q):
                found.append((i, len(stretch), q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def slow_kept(words, runs):
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    return [w for i, w in enumerate(words) if i not in gone]


def texts_of(seed):
    rng = random.Random(seed)
    for _ in range(150):
        letters = "ab" if rng.random() < 0.4 else "abcd"
        words = []
        for _ in range(rng.randint(0, 6)):
            block = [rng.choice(letters) for _ in range(rng.randint(1, 9))]
            times = rng.choice([1, 1, 2, 3, 4, 5, 9])
            words += (block * times)[: len(block) * times - rng.randint(0, len(block) - 1)]
        yield words


@pytest.mark.parametrize("least, repeats", [(6, 4), (6, 3), (1, 5), (40, 4)])
def test_as_all_stretches(least, repeats):
    texts = list(texts_of(least + repeats))
    texts += [["x"] * 300, ["x", "y"] * 200, ["a"] * 5, ["a"] * 6, list("abcabcabcabc"), list("abcabcabcab"), (["a"] * 8 + ["b"]) * 6]
    numbers, base = [], 0
    for words in texts:
        names = {}
        numbers += [base + names.setdefault(w, len(names)) for w in words]
        base += len(names)
    lengths = np.array([len(w) for w in texts])
    got = periodic.find_runs(np.array(numbers, np.int64), lengths, least, repeats)
    at = 0
    want = []
    for words in texts:
        want += [(at + s, n, q) for s, n, q in slow_runs(words, least, repeats)]
        at += len(words)
    assert [tuple(r) for r in got.tolist()] == want
    assert len(want) > 40


def test_two_repeats_are_no_run():
    with pytest.raises(ValueError):
        periodic.find_runs(np.zeros(3, np.int64), np.array([3]), 6, 2)


def test_rows_of_all_kinds(spark, monkeypatch):
    texts = [" ".join(w) for w in texts_of(3)]
    texts += [None, "", " \t\r\n ", "\x0ba  b\t\tb b b b b\x0c", "é é é é é é ü", "a b " * 700, "one", "A a A a A a A a"]
    rows = [(i, t, 1, "x", 0) for i, t in enumerate(texts)] + [(None, "z " * 9, 1, "x", 0), (3, texts[3], 1, "x", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs int, id string, start int")
    got = {}
    for r in periodic.periodic_runs(docs).collect():
        got.setdefault(r.doc_id, []).append((r.n_words, [tuple(x) for x in r.runs], r.collapsed))
    for doc, text, *_ in rows:
        words = [w.decode() for w in (text or "").encode().split()]
        runs = slow_runs(words)
        assert (len(words), runs, " ".join(slow_kept(words, runs))) in got[doc]
    assert len(got[3]) == 2 and len(got[None]) == 1
    assert periodic.periodic_runs(docs.limit(0)).collect() == []


def test_long_texts_are_split_in_slices(monkeypatch):
    monkeypatch.setattr(periodic, "SLICE_BYTES", 64)
    rng = random.Random(1)
    words = [rng.choice("abcdefgh") * rng.randint(1, 30) for _ in range(80)] + ["p", "q", "r"] * 50 + [rng.choice("ab") for _ in range(60)]
    group = periodic._Group()
    group.add(1, " \n ".join(words).encode())
    ((doc, n, runs, kept),) = group.results(6, 4)
    want = slow_runs(words)
    assert (doc, n, [tuple(r.values()) for r in runs]) == (1, len(words), want)
    assert kept.decode() == " ".join(slow_kept(words, want))
    assert [w for s in periodic.word_slices(b"  aa b\tccc  ", 2) for w in s] == [b"aa", b"b", b"ccc"]


def test_query_as_brute_force(spark, tmp_path):
    """The registered query, with its planted repeats, on texts of up to a few hundred words."""
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice("abcdefghij") for _ in range(rng.randint(0, 160)))) for i in range(240)] + [(1000, None), (7, "a a a a a a b")]
    spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_chars", F.length("text")).write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for doc, text in rows:
        words = (text or "").split()
        n, h = len(words), zlib.crc32(str(doc).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs = slow_runs(words)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want.append((
            doc, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)), sha(" ".join(slow_kept(words, runs))),
        ))
    got = [tuple(r) for r in op12_runs(spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert sum(r[1] for r in want) > 10
