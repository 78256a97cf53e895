"""Suffix and common-prefix order of a byte string by external induced sorting.

The string may be far larger than memory: it, its order and the queues lie in
files of a folder, and only blocks of them are held at a time.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np

# Items of a queue block, items taken from the queue at once, and bytes kept in memory before a queue goes to disk.
BLOCK_ITEMS = 1 << 14
BATCH_ITEMS = 1 << 18
MEMORY_BYTES = 64 << 20

# A text of names up to this length ends the recursion: it is sorted in memory.
BASE_ITEMS = 1 << 20

FAR = np.uint8(255)


class Files:
    """Arrays in memory up to a size, in files of a folder beyond."""

    def __init__(self, folder: str, memory: int = MEMORY_BYTES):
        self.folder, self.memory, self.made = folder, memory, 0

    def path(self) -> str:
        self.made += 1
        return os.path.join(self.folder, f"{self.made}.bin")

    def array(self, n: int, kind) -> np.ndarray:
        if n * np.dtype(kind).itemsize <= self.memory // 8 or not n:
            return np.empty(n, kind)
        return np.memmap(self.path(), kind, "w+", shape=(n,))


class BlockQueue:
    """A priority queue of suffix tuples ``(character, position, common prefix)``.

    Characters are divided into blocks. Tuples wait unsorted in the block of
    their character, in the order they came, and go to disk when memory is full;
    a block is sorted when its turn comes.
    """

    KIND = np.dtype([("char", np.int32), ("pos", np.int64), ("lcp", np.uint8)])

    def __init__(self, files: Files, block_of: np.ndarray, blocks: int):
        self.files, self.block_of = files, block_of
        self.held: list[list[np.ndarray]] = [[] for _ in range(blocks)]
        self.spilled: list[str | None] = [None] * blocks
        self.buffer: list[np.ndarray] = []
        self.buffered = self.bytes = 0

    def push(self, items: np.ndarray) -> None:
        if not len(items):
            return
        self.buffer.append(items)
        self.buffered += len(items)
        if self.buffered >= 4 * BLOCK_ITEMS:
            self._deal()

    def _deal(self) -> None:
        if not self.buffer:
            return
        items = np.concatenate(self.buffer)
        self.buffer, self.buffered = [], 0
        block = self.block_of[items["char"]]
        order = np.argsort(block, kind="stable")
        items, block = items[order], block[order]
        starts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
        for a, b in zip(starts, np.r_[starts[1:], len(items)]):
            self.held[block[a]].append(items[a:b])
        self.bytes += items.nbytes
        if self.bytes > self.files.memory // 2:
            self._spill()

    def _spill(self) -> None:
        for block, own in enumerate(self.held):
            if own:
                self.spilled[block] = self.spilled[block] or self.files.path()
                with open(self.spilled[block], "ab") as out:
                    np.concatenate(own).tofile(out)
                self.held[block] = []
        self.bytes = 0

    def take(self, block: int) -> np.ndarray:
        """The tuples of a block in the order they came."""
        self._deal()
        own, self.held[block] = self.held[block], []
        self.bytes -= sum(x.nbytes for x in own)
        if self.spilled[block]:
            own.insert(0, np.fromfile(self.spilled[block], self.KIND))
            os.remove(self.spilled[block])
        return np.concatenate([np.zeros(0, self.KIND), *own])


def _range_minima(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The least of ``values[first : last + 1]`` for each pair, over tables of doubling width."""
    out = np.empty(len(first), values.dtype)
    width = last - first + 1
    level = np.floor(np.log2(np.maximum(width, 1))).astype(np.int64)
    table = values
    for k in range(int(level.max(initial=0)) + 1):
        own = level == k
        if own.any():
            out[own] = np.minimum(table[first[own]], table[last[own] - (1 << k) + 1])
        if len(table) <= 1 << k:
            break
        table = np.minimum(table[: -(1 << k)], table[1 << k :])
    return out


def _induce(files: Files, chars: np.ndarray, sigma: int, wanted: np.ndarray, runs: np.ndarray, given: np.ndarray, given_lcp: np.ndarray, cap: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """All ``wanted`` suffixes in order, merged with the ``given`` ones: batches of ``(position, common prefix, is given)``.

    Each suffix taken from the queue induces the one a character before it, if
    wanted: among those with its character it follows all that were induced
    earlier. It shares with the last of them one character more than what lies
    between their sources has in common. As many tuples are taken at once as no
    tuple that they induce can precede.
    """
    given_chars = chars[given]
    counts = np.bincount(chars[wanted], minlength=sigma) + np.bincount(given_chars, minlength=sigma)
    block_of = (np.cumsum(counts) - counts) // BLOCK_ITEMS
    block_of = np.unique(block_of, return_inverse=True)[1].astype(np.int32)
    blocks = int(block_of[-1]) + 1
    ends = np.searchsorted(block_of, np.arange(blocks), "right")
    queue = BlockQueue(files, block_of, blocks)
    given_ends = np.searchsorted(given_chars, ends)
    last_batch, last_tail = np.full(sigma, -1, np.int32), np.full(sigma, FAR, np.uint8)
    since = np.full(1024, FAR, np.uint8)  # by batch: the least common prefix in all batches after it
    batch, given_at, before_char, before_pos, before_given = 0, 0, -1, -1, False
    far_key, taken = np.int64(2 * sigma + 2), 0
    for block in range(blocks):
        items = queue.take(block)
        some = slice(given_at, int(given_ends[block]))
        given_at = some.stop
        key = np.concatenate([2 * items["char"].astype(np.int64), 2 * given_chars[some].astype(np.int64) + 1])
        pos = np.concatenate([items["pos"], given[some]])
        lcp = np.concatenate([items["lcp"], given_lcp[some]])
        order = np.argsort(key, kind="stable")
        key, pos, lcp = key[order], pos[order], lcp[order]
        while len(key):
            head = min(len(key), BATCH_ITEMS, 4 * taken + 256)
            source = pos[:head]
            induces = (source > 0) & wanted[source - 1]
            char = np.where(induces, chars[source - 1], 0).astype(np.int64)
            bound = np.minimum.accumulate(np.where(induces, 2 * char, far_key))
            late = np.flatnonzero(key[1:head] > bound[:-1])
            n = taken = int(late[0]) + 1 if len(late) else head
            own_char, own_given = key[:n] >> 1, (key[:n] & 1).astype(bool)
            same = np.empty(n, bool)
            same[0], same[1:] = own_char[0] == before_char, own_char[1:] == own_char[:-1]
            shared = np.where(same, lcp[:n], 0).astype(np.uint8)
            same[0] &= own_given[0] and not before_given
            same[1:] &= own_given[1:] & ~own_given[:-1]
            turn = np.flatnonzero(same)
            if len(turn):  # the border between induced and given suffixes of a character: only its run is shared
                other = np.where(turn > 0, pos[turn - 1], before_pos)
                shared[turn] = np.minimum(np.minimum(runs[pos[turn]], runs[other]), cap)
            yield pos[:n], shared, own_given
            before_char, before_pos, before_given = int(own_char[-1]), int(pos[n - 1]), bool(own_given[-1])

            at = np.flatnonzero(induces[:n])
            if batch == len(since):
                since = np.concatenate([since, np.full(batch, FAR, np.uint8)])
            new = np.zeros(0, BlockQueue.KIND)
            if len(at):
                order = np.argsort(char[at], kind="stable")
                at, c = at[order], char[at][order]
                first = np.ones(len(at), bool)
                np.not_equal(c[1:], c[:-1], out=first[1:])
                low = np.empty(len(at), np.uint8)
                prefix = np.minimum.accumulate(shared)
                a, cf = at[first], c[first]
                known = last_batch[cf] >= 0
                # From the last source in its batch, over the batches between, and from the begin of this one.
                between = np.minimum(last_tail[cf], since[np.maximum(last_batch[cf], 0)])
                low[first] = np.where(known, np.minimum(between, prefix[a]), 0)
                rest = np.flatnonzero(~first)
                low[rest] = _range_minima(shared, at[rest - 1] + 1, at[rest])
                value = np.minimum(low.astype(np.int64) + 1, cap)
                value[np.flatnonzero(first)[~known]] = 0
                final = np.ones(len(at), bool)
                final[:-1] = first[1:]
                tail = np.full(n + 1, FAR, np.uint8)
                tail[:n] = np.minimum.accumulate(shared[::-1])[::-1]
                last_batch[c[final]], last_tail[c[final]] = batch, tail[at[final] + 1]
                new = np.empty(len(at), BlockQueue.KIND)
                new["char"], new["pos"], new["lcp"] = c, pos[at] - 1, value
            np.minimum(since[:batch], shared.min(), out=since[:batch])
            since[batch] = FAR
            batch += 1
            here = int(np.searchsorted(new["char"], ends[block]))
            queue.push(new[here:])
            key, pos, lcp = key[n:], pos[n:], lcp[n:]
            if here:
                key = np.concatenate([key, 2 * new["char"][:here].astype(np.int64)])
                pos, lcp = np.concatenate([pos, new["pos"][:here]]), np.concatenate([lcp, new["lcp"][:here]])
                order = np.argsort(key, kind="stable")
                key, pos, lcp = key[order], pos[order], lcp[order]


def _types(files: Files, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every suffix whether it is smaller than the next one, and the length of its first run of one character.

    From the end, a block at a time. The last character is the least and comes once.
    """
    n = len(text)
    small, runs = files.array(n, bool), files.array(n, np.int32)
    small[n - 1], runs[n - 1] = True, 1
    end = n - 1  # of the run that begins after the block
    for a in range((n - 2) // BATCH_ITEMS * BATCH_ITEMS, -1, -BATCH_ITEMS):
        b = min(a + BATCH_ITEMS, n - 1)
        own = np.asarray(text[a : b + 1])
        ends = np.where(own[1:] != own[:-1], np.arange(a, b), n)
        ends = np.minimum.accumulate(ends[::-1])[::-1]
        ends[ends == n] = end
        small[a:b] = text[ends] < text[ends + 1]
        runs[a:b] = ends - np.arange(a, b) + 1
        end = int(ends[0])
    return small, runs


def _names(files: Files, text: np.ndarray, small: np.ndarray, lms: np.ndarray, sigma: int) -> tuple[np.ndarray, int]:
    """The rank of each substring between neighbours of ``lms``, equal ones alike, and the number of ranks.

    Substrings are compared by character and type, some of them packed into a
    word; those still equal go on to their next word. Substrings are sorted in
    ranges of their first word that fit in memory.
    """
    bits = int(2 * sigma + 1).bit_length()
    each = 62 // bits
    ends = np.append(lms[1:], lms[-1]) + 1

    def word(which: np.ndarray, number: int) -> np.ndarray:
        out = np.zeros(len(which), np.int64)
        start, end = lms[which] + number * each, ends[which]
        for j in range(each):
            at = np.minimum(start + j, len(text) - 1)
            out = (out << bits) | np.where(start + j < end, 2 * text[at].astype(np.int64) + small[at], 0)
        return out

    first = files.array(len(lms), np.int64)
    for a in range(0, len(lms), BATCH_ITEMS):
        which = np.arange(a, min(a + BATCH_ITEMS, len(lms)))
        first[which] = word(which, 0)
    step = max(1, 16 * BATCH_ITEMS)
    cuts = np.unique(np.partition(first, range(step, len(lms), step))[step::step]) if len(lms) > step else []
    names, low, total = files.array(len(lms), np.int64), None, 0
    for high in [*cuts, None]:
        inside = np.ones(len(lms), bool) if low is None else first >= low
        which = np.flatnonzero(inside if high is None else inside & (first < high))
        low = high
        if not len(which):
            continue
        _, rank, size = np.unique(first[which], return_inverse=True, return_counts=True)
        start = np.cumsum(size) - size
        rank = start[rank]
        number, open_ = 1, np.ones(len(which), bool)
        while True:
            count = np.bincount(rank, minlength=len(which))
            open_ &= (count[rank] > 1) & (ends[which] - lms[which] > number * each)
            left = np.flatnonzero(open_)
            if not len(left):
                break
            next_word = word(which[left], number)
            order = np.lexsort((next_word, rank[left]))
            left, next_word = left[order], next_word[order]
            r = rank[left]
            new = np.r_[True, (r[1:] != r[:-1]) | (next_word[1:] != next_word[:-1])]
            group = np.r_[True, r[1:] != r[:-1]]
            at = np.arange(len(left))
            rank[left] = r + np.maximum.accumulate(np.where(new, at, 0)) - np.maximum.accumulate(np.where(group, at, 0))
            number += 1
        kinds, dense = np.unique(rank, return_inverse=True)
        names[which] = dense + total
        total += len(kinds)
    return names, total


def _common(text: np.ndarray, a: np.ndarray, b: np.ndarray, base: np.ndarray, cap: int) -> np.ndarray:
    """``base`` and what the suffixes at ``a`` and ``b`` have in common, up to ``cap``."""
    out = np.minimum(base, cap).astype(np.int64)
    left = np.flatnonzero(out < cap)
    offset = np.zeros(len(left), np.int64)
    while len(left):
        x, y = a[left] + offset, b[left] + offset
        same = (np.maximum(x, y) < len(text)) & (text[np.minimum(x, len(text) - 1)] == text[np.minimum(y, len(text) - 1)])
        out[left[same]] += 1
        going = same & (out[left] < cap)
        left, offset = left[going], offset[going] + 1
    return out.astype(np.uint8)


def _doubled(names: np.ndarray) -> np.ndarray:
    """The order of all suffixes of a short text of ranks, the last one least and alone, by doubling prefixes.

    Only suffixes that still share their rank are sorted again.
    """
    order = np.argsort(names, kind="stable")
    sorted_ = names[order]
    new = np.r_[True, sorted_[1:] != sorted_[:-1]]
    rank = np.empty(len(names), np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(len(names)), 0))
    alone = new & np.r_[new[1:], True]
    left, width = order[~alone], 1
    while len(left):
        first, second = rank[left], rank[left + width]
        by = np.argsort(first * len(names) + second, kind="stable")
        left, first, second = left[by], first[by], second[by]
        at = np.arange(len(left))
        group = np.r_[True, first[1:] != first[:-1]]
        new = group | np.r_[True, second[1:] != second[:-1]]
        rank[left] = first + np.maximum.accumulate(np.where(new, at, 0)) - np.maximum.accumulate(np.where(group, at, 0))
        left, width = left[~(new & np.r_[new[1:], True])], 2 * width
    order[rank] = np.arange(len(names))
    return order


def sorted_suffixes(files: Files, text: np.ndarray, sigma: int, cap: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Batches of ``(position, common prefix with the one before)`` of all suffixes, in descending order.

    ``text`` holds characters below ``sigma`` and ends with the only 0. Common
    prefixes are exact up to ``cap`` (at most 200).
    """
    if len(text) == 1:
        yield np.zeros(1, np.int64), np.zeros(1, np.uint8)
        return
    small, runs = _types(files, text)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    names, kinds = _names(files, text, small, lms, sigma)
    if kinds == len(lms):
        order = np.empty(len(lms), np.int64)
        order[names] = np.arange(len(lms))
        name_lcp = np.zeros(len(lms), np.int64)
    elif len(lms) <= BASE_ITEMS:
        order = _doubled(np.asarray(names))
        name_lcp = np.zeros(len(lms), np.uint8)
        name_lcp[1:] = _common(names, order[:-1], order[1:], np.zeros(len(lms) - 1, np.int64), cap)
    else:  # the names are a text of a third of the length or less
        order, name_lcp = files.array(len(lms), np.int64), files.array(len(lms), np.uint8)
        end = len(lms)
        before = None
        for pos, lcp in sorted_suffixes(files, names, kinds, cap):
            order[end - len(pos) : end] = pos[::-1]
            # From with the next larger to with the next smaller.
            if before is not None:
                name_lcp[end] = lcp[0]
            name_lcp[end - len(pos) + 1 : end] = lcp[1:][::-1]
            end, before = end - len(pos), True
        name_lcp[0] = 0
    at = lms[order]
    lcp = np.zeros(len(lms), np.uint8)
    for a in range(1, len(lms), BATCH_ITEMS):
        b = min(a + BATCH_ITEMS, len(lms))
        whole = name_lcp[a:b].astype(np.int64)
        x, y = (np.minimum(order[i] + whole, len(lms) - 1) for i in (slice(a - 1, b - 1), slice(a, b)))
        lcp[a:b] = _common(text, lms[x], lms[y], lms[y] - at[a:b], cap)
    large = files.array(len(text), bool)
    np.logical_not(small, out=large)
    n_large = int(large.sum())
    down, down_lcp = files.array(n_large, np.int64), files.array(n_large, np.uint8)
    end, last = n_large, None
    for pos, shared, is_given in _induce(files, text, sigma, large, runs, at, lcp, cap):
        # Between two induced suffixes of a character no given one stands; after a given one the character is new.
        own = ~is_given
        k = int(own.sum())
        if not k:
            continue
        down[end - k : end] = pos[own][::-1]
        if last is not None:
            down_lcp[end] = shared[own][0]
        down_lcp[end - k + 1 : end] = shared[own][1:][::-1]
        end, last = end - k, True
    if n_large:
        down_lcp[0] = 0
    mirrored = files.array(len(text), np.int32)
    mirrored[:] = sigma - 1 - text.astype(np.int32) if len(text) <= BATCH_ITEMS else 0
    if len(text) > BATCH_ITEMS:
        for a in range(0, len(text), BATCH_ITEMS):
            mirrored[a : a + BATCH_ITEMS] = sigma - 1 - text[a : a + BATCH_ITEMS].astype(np.int32)
    for pos, shared, _ in _induce(files, mirrored, sigma, small, runs, down, down_lcp, cap):
        yield pos, shared
    # The end, which no suffix induces, is the least.
    yield np.array([len(text) - 1]), np.zeros(1, np.uint8)
