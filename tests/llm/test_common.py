"""Helpers that the operators share."""

import weakref

import numpy as np
import pyarrow as pa

from textrec.llm import common


def test_memory_is_given_back_when_a_function_is_over(monkeypatch):
    held, free = [], []

    def run(batches):
        for batch in batches:
            array = np.zeros(1000)
            held.append(weakref.ref(array))
            yield batch

    class Pool:
        def release_unused(self):
            free.append(all(a() is None for a in held))

    batches = [pa.RecordBatch.from_pydict({"x": [i]}) for i in range(3)]
    monkeypatch.setattr(common.pa, "default_memory_pool", Pool)
    assert list(common.giving_back(run)(iter(batches))) == batches and len(held) == 3
    assert free == [True]
