"""URLs judged by rules kept as a sorted array of 64-bit digests."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textrec.llm.common import load_array, ship_arrays

ALLOW, BLOCK = "allow", "block"

# Rules in one array. More rules make more arrays, which are probed one after the other.
ARRAY_RULES = 1_000_000

FILES = ["hosts", "host_at", "lengths", "keys", "text_at", "texts", "allowed"]


def host_of(url: str | Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without it."""
    url = F.col(url) if isinstance(url, str) else url
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.coalesce(F.translate(found, upper, upper.lower()), F.lit(""))


def path_of(url: str | Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; empty without ``://``."""
    url = F.col(url) if isinstance(url, str) else url
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _digest(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))


def digest_arrays(rules: Sequence[tuple[str, str, str]]) -> dict[str, np.ndarray]:
    """The arrays of some rules ``(host, path, verdict)``, sorted by digest.

    ``keys`` are the digests of host and path, ``texts`` the full strings to
    confirm them by. ``hosts`` are the digests of the hosts alone; each leads to
    the path lengths its rules have, so that only those prefixes are looked up.
    """
    named = sorted({(_digest(h + p), h, p, v) for h, p, v in rules})
    full = [(h + "\n" + p).encode("utf-8", "surrogatepass") for _, h, p, _ in named]
    spans = sorted({(_digest(h), len(p)) for _, h, p, _ in named})
    hosts, first = np.unique(np.array([d for d, _ in spans], np.uint64), return_index=True)
    return {
        "hosts": hosts,
        "host_at": np.append(first, len(spans)).astype(np.int64),
        "lengths": np.array([n for _, n in spans], np.int64),
        "keys": np.array([d for d, *_ in named], np.uint64),
        "text_at": np.cumsum([0, *map(len, full)], dtype=np.int64),
        "texts": np.frombuffer(b"".join(full), np.uint8),
        "allowed": np.array([v == ALLOW for *_, v in named], np.bool_),
    }


def _probe(wanted: np.ndarray, digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each digest where it is in the sorted array: ``(from, to)``."""
    return np.searchsorted(wanted, digests, "left"), np.searchsorted(wanted, digests, "right")


def best_rules(arrays: dict[str, np.ndarray], hosts: Sequence[str], paths: Sequence[str]) -> dict[int, tuple]:
    """The longest fitting rule of each URL that has one: ``(length, host's length, blocks, host + path)`` by its place."""
    suffixes: dict[str, list[str]] = {}
    for host in hosts:
        if host not in suffixes:
            cuts = [0, *[i + 1 for i, c in enumerate(host) if c == "."]]
            suffixes[host] = [host[i:] for i in cuts]
    names = [s for own in suffixes.values() for s in own]
    low, high = _probe(arrays["hosts"], np.array([_digest(s) for s in names], np.uint64))
    lengths = {s: arrays["lengths"][arrays["host_at"][a] : arrays["host_at"][a + 1]].tolist() for s, a, b in zip(names, low, high) if a < b}
    tries = [
        (i, suffix, path[:n])
        for i, (host, path) in enumerate(zip(hosts, paths))
        for suffix in suffixes[host]
        for n in lengths.get(suffix, ())
        if n <= len(path)
    ]
    best: dict[int, tuple] = {}
    low, high = _probe(arrays["keys"], np.array([_digest(s + p) for _, s, p in tries], np.uint64))
    for (i, suffix, prefix), a, b in zip(tries, low.tolist(), high.tolist()):
        text = (suffix + "\n" + prefix).encode("utf-8", "surrogatepass")
        for k in range(a, b):  # more than one only for both verdicts, or if digests collide
            if arrays["texts"][arrays["text_at"][k] : arrays["text_at"][k + 1]].tobytes() == text:
                found = (len(suffix) + len(prefix), len(suffix), not arrays["allowed"][k], suffix + prefix)
                best[i] = max(best.get(i, found), found)
    return best


def judge_urls(
    pages: DataFrame,
    rules: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    otherwise: str = ALLOW,
    array_rules: int = ARRAY_RULES,
) -> DataFrame:
    """``(id_col, host, path, rule, verdict)`` of every row of ``pages``.

    ``rules`` has ``host``, ``path`` and ``verdict`` (allow or block). A rule
    fits its host and all subdomains if the path begins with its path; the
    longest host and path together wins, then the longer host, then block. No
    rule: a null ``rule`` and the verdict ``otherwise``. Null URLs and URLs
    without ``://`` have an empty host and path, which only a rule for the empty
    host could fit. Null hosts or paths in ``rules`` count as empty, repeated
    rules as one; without rules every URL gets ``otherwise``. Other columns are
    not looked at; repeated rows are all judged.

    Rules reach the driver ``array_rules`` at a time, are sorted by digest and
    sent out as files. Each array is one narrow pass over the URLs, which keep
    the longest rule so far; no URL is shuffled.
    """
    spark = pages.sparkSession
    empty = F.lit("")
    listed = rules.select(F.coalesce("host", empty).alias("host"), F.coalesce("path", empty).alias("path"), "verdict").distinct()
    judged = pages.select(
        F.col(id_col).alias("id"),
        host_of(url_col).alias("host"),
        path_of(url_col).alias("path"),
        F.lit(None).cast("string").alias("rule"),
        F.lit(otherwise).alias("verdict"),
        F.lit(-1).alias("_size"),
        F.lit(-1).alias("_host"),
    )
    kind = judged.schema["id"].dataType.simpleString()
    schema = f"id {kind}, host string, path string, rule string, verdict string, _size int, _host int"

    def passed(name: str):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            arrays = {part: load_array(name, part) for part in FILES}
            for batch in batches:
                had = batch.to_pydict()
                for i, found in best_rules(arrays, had["host"], had["path"]).items():
                    size, host, blocks, rule = found
                    if (size, host, blocks) > (had["_size"][i], had["_host"][i], had["verdict"][i] == BLOCK):
                        had["_size"][i], had["_host"][i], had["rule"][i] = size, host, rule
                        had["verdict"][i] = BLOCK if blocks else ALLOW
                yield pa.RecordBatch.from_pydict(had, schema=batch.schema)

        return run

    def taken() -> Iterator[list[tuple[str, str, str]]]:
        some: list[tuple[str, str, str]] = []
        for row in listed.toLocalIterator():
            some.append((row["host"], row["path"], row["verdict"]))
            if len(some) == array_rules:
                yield some
                some = []
        if some:
            yield some

    for some in taken():
        judged = judged.mapInArrow(passed(ship_arrays(spark, digest_arrays(some))), schema)
    return judged.select(F.col("id").alias(id_col), "host", "path", "rule", "verdict")
