"""Induced order and common prefixes against sorting suffixes one by one."""

import numpy as np
import pytest

from textrec.llm import suffixes


def slow(text, cap):
    order = sorted(range(len(text)), key=lambda i: text[i:])
    lcps = [0]
    for a, b in zip(order, order[1:]):
        k = 0
        while k < cap and max(a, b) + k < len(text) and text[a + k] == text[b + k]:
            k += 1
        lcps.append(k)
    return order, lcps


def fast(folder, text, cap, memory=suffixes.MEMORY_BYTES):
    own = np.array(text, np.int32)
    got = list(suffixes.sorted_suffixes(suffixes.Files(str(folder), memory), own, int(own.max()) + 1, cap))
    pos, lcp = (np.concatenate(x)[::-1].tolist() for x in zip(*got))
    return pos, [0, *lcp[:-1]]


TEXTS = [
    [0],
    [1, 0],
    [*b"mississippi", 0],
    [1] * 50 + [0],
    [1, 2] * 40 + [0],
    [2, 1] * 40 + [2, 0],
    [5, 4, 3, 2, 1, 0],
    [1, 2, 3, 4, 5, 0],
    [*([3, 1, 2, 2, 1] * 30), 0],
    [*b"abracadabra" * 9, *b"abracad" * 5, 0],
]


@pytest.mark.parametrize("base", [0, 1 << 20])
@pytest.mark.parametrize("text", TEXTS)
@pytest.mark.parametrize("cap", [3, 100])
def test_small_texts(tmp_path, monkeypatch, text, cap, base):
    monkeypatch.setattr(suffixes, "BASE_ITEMS", base)
    assert fast(tmp_path, text, cap) == slow(text, cap)


@pytest.mark.parametrize("seed", range(12))
def test_random_texts_with_tiny_memory(tmp_path, monkeypatch, seed):
    monkeypatch.setattr(suffixes, "BLOCK_ITEMS", 16)
    monkeypatch.setattr(suffixes, "BATCH_ITEMS", 37)
    monkeypatch.setattr(suffixes, "BASE_ITEMS", 0)
    rng = np.random.default_rng(seed)
    alphabet = [1, 2, 3, 60, 250][seed % 5]
    text = rng.integers(1, alphabet + 1, 700).tolist()
    text[300:500] = text[100:300]  # a long repeat
    text += [0]
    assert fast(tmp_path, text, 100, memory=256) == slow(text, 100)
    assert any(tmp_path.iterdir())


@pytest.mark.parametrize("base", [0, 500, 1 << 20])
def test_larger_text(tmp_path, monkeypatch, base):
    monkeypatch.setattr(suffixes, "BASE_ITEMS", base)
    rng = np.random.default_rng(1)
    words = [rng.integers(97, 123, rng.integers(2, 9)).tolist() + [32] for _ in range(300)]
    text = [c for w in rng.integers(0, 300, 4000) for c in words[w]]
    text = text + text[:5000] + [0]
    assert fast(tmp_path, text, 100) == slow(text, 100)
