"""Navigable small-world graphs in layers, over vectors of one shard; searched for many queries at once."""

from __future__ import annotations

import numpy as np

# Links of a node on the lowest layer and on those above, nodes of a layer for one of the next, width of the beam that finds a new node's links.
LOW_LINKS, HIGH_LINKS, LAYER_SHARE, BUILD_BEAM = 32, 16, 16, 48

# Nodes put in, and queries followed, at a time; nodes of a beam that are left together; newcomers that a node may link back to in one go.
AT_ONCE, STEPS, NEWCOMERS = 256, 4, 32

# Pairs whose products are made at a time.
PAIRS = 1 << 17


def products(left: np.ndarray, a: np.ndarray, right: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows ``a`` of ``left`` with rows ``b`` of ``right``."""
    out = np.empty(len(a), np.result_type(left, right))
    for at in range(0, len(a), PAIRS):
        np.einsum("ij,ij->i", left[a[at : at + PAIRS]], right[b[at : at + PAIRS]], out=out[at : at + PAIRS])
    return out


def _best(ids: np.ndarray, sims: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``n`` columns of highest similarity in each row, highest first."""
    if sims.shape[1] > n:
        some = np.argpartition(-sims, n - 1, axis=1)[:, :n]
        ids, sims = np.take_along_axis(ids, some, 1), np.take_along_axis(sims, some, 1)
    order = np.argsort(-sims, axis=1, kind="stable")
    return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)


def _without_repeats(ids: np.ndarray) -> np.ndarray:
    ids = np.sort(ids, axis=1)
    ids[:, 1:][ids[:, 1:] == ids[:, :-1]] = -1
    return ids


class Graph:
    """The layers: layer ``l`` has the first ``sizes[l]`` rows of ``vectors`` as nodes and their ``links``, -1 for none."""

    def __init__(self, vectors: np.ndarray, links: list[np.ndarray]):
        self.vectors, self.links = vectors, links

    @classmethod
    def build(cls, vectors: np.ndarray) -> Graph:
        """A graph over unit vectors in any random order; nodes are put in from the highest layer down, a batch at a time.

        A batch's nodes look for neighbours among those before them by a beam
        search and among themselves directly. Of the neighbours found a node
        links to those that are nearer to it than to one it already links to,
        then to the nearest of the others; these link back by the same rule.
        """
        n, sizes = len(vectors), []
        while not sizes or sizes[-1] > 4 * LAYER_SHARE:
            sizes.append(n if not sizes else sizes[-1] // LAYER_SHARE)
        graph = cls(vectors, [np.full((s, HIGH_LINKS if i else LOW_LINKS), -1, np.int32) for i, s in enumerate(sizes)])
        for layer in range(len(sizes) - 1, -1, -1):
            done = 0
            while done < sizes[layer]:
                more = np.arange(done, min(sizes[layer], done + AT_ONCE))
                graph._put_in(layer, more)
                done += len(more)
        return graph

    def _put_in(self, layer: int, more: np.ndarray) -> None:
        links, done, own = self.links[layer], int(more[0]), self.vectors[more]
        among = own @ own.T
        np.fill_diagonal(among, -np.inf)
        ids, sims = np.broadcast_to(more, among.shape), among
        if done:
            starts = self._descend(own, layer)
            starts[starts >= done] = -1
            starts = np.concatenate([starts, np.zeros((len(more), 1), starts.dtype)], axis=1)
            found, near, _ = self.beam(layer, own, starts, BUILD_BEAM, links)
            ids, sims = np.concatenate([found, ids], axis=1), np.concatenate([near, sims], axis=1)
        ids, sims = _best(ids, sims, BUILD_BEAM)
        links[more, : HIGH_LINKS] = self._chosen(ids, sims, HIGH_LINKS)
        # Links back: for every node that was linked to, its own links and the nearest newcomers.
        to, by = links[more, :HIGH_LINKS].ravel(), np.repeat(more, HIGH_LINKS)
        to, by = to[to >= 0], by[to >= 0]
        near = products(self.vectors, to, self.vectors, by)
        order = np.lexsort((-near, to))
        to, by = to[order], by[order]
        first = np.flatnonzero(np.r_[True, to[1:] != to[:-1]]) if len(to) else np.zeros(0, int)
        place = np.arange(len(to)) - np.repeat(first, np.diff(np.r_[first, len(to)]))
        nodes = to[first]
        new = np.full((len(nodes), NEWCOMERS), -1, np.int32)
        few = place < NEWCOMERS
        new[np.searchsorted(nodes, to[few]), place[few]] = by[few]
        for at in range(0, len(nodes), 4 * AT_ONCE):
            some = nodes[at : at + 4 * AT_ONCE]
            every = _without_repeats(np.concatenate([links[some], new[at : at + 4 * AT_ONCE]], axis=1))
            every = every[:, (every >= 0).any(axis=0)]
            row, column = np.nonzero(every >= 0)
            sims = np.full(every.shape, -np.inf, np.float32)
            sims[row, column] = products(self.vectors, some[row], self.vectors, every[row, column])
            every, sims = _best(every, sims, every.shape[1])
            full = np.isfinite(sims).sum(axis=1) > links.shape[1]
            kept = np.full((len(some), links.shape[1]), -1, np.int32)
            width = min(every.shape[1], links.shape[1])
            kept[~full, :width] = np.where(np.isfinite(sims), every, -1)[~full, :width]
            if full.any():
                kept[full] = self._chosen(every[full], sims[full], links.shape[1])
            links[some] = kept

    def _chosen(self, ids: np.ndarray, sims: np.ndarray, n: int) -> np.ndarray:
        """Up to ``n`` of each row's candidates, which come nearest first."""
        there = np.isfinite(sims)
        some = self.vectors[np.where(there, ids, 0)]
        between = np.matmul(some, some.transpose(0, 2, 1))
        taken = np.zeros(ids.shape, bool)
        for c in range(ids.shape[1]):
            apart = ~(taken & (between[:, c] > sims[:, c, None])).any(axis=1)
            taken[:, c] = there[:, c] & apart & (taken.sum(axis=1) < n)
        rank = np.where(taken, 0, np.where(there, 1, 2)) * ids.shape[1] + np.arange(ids.shape[1])
        order = np.argsort(rank, axis=1)[:, :n]
        out = np.full((len(ids), n), -1, np.int32)
        out[:, : order.shape[1]] = np.where(np.take_along_axis(there, order, 1), np.take_along_axis(ids, order, 1), -1)
        return out

    def _descend(self, queries: np.ndarray, layer: int) -> np.ndarray:
        """Nodes of the layer above ``layer`` near each query, to start from; on the highest layer all are compared."""
        top = len(self.links) - 1
        if layer == top:
            return np.zeros((len(queries), 1), np.int32)
        sims = queries @ self.vectors[: len(self.links[top])].T
        near = _best(np.broadcast_to(np.arange(sims.shape[1], dtype=np.int32), sims.shape), sims, 4)[0]
        for above in range(top - 1, layer, -1):
            near = self.beam(above, queries, near, 8, self.links[above])[0][:, :4]
        return near

    def beam(self, layer: int, queries: np.ndarray, starts: np.ndarray, width: int, links: np.ndarray, least: float = np.inf):
        """``(ids, sims, hits)``: the ``width`` nodes found nearest to each query, and all ``(query, node)`` seen at ``least`` or more.

        The nearest nodes of the beam that were not left yet are left to all their
        neighbours, until there are none.
        """
        n = len(queries)
        seen = np.zeros((n, len(self.links[layer])), bool)
        ids, sims = np.full((n, width), -1, np.int32), np.full((n, width), -np.inf, np.float32)
        left, hits = np.ones((n, width), bool), []
        rows, step = np.arange(n), _without_repeats(starts.astype(np.int32))
        while len(rows):
            r, c = np.nonzero(step >= 0)
            fresh = ~seen[rows[r], step[r, c]]
            r, c = r[fresh], c[fresh]
            to = step[r, c]
            seen[rows[r], to] = True
            near = products(queries, rows[r], self.vectors, to)
            high = near >= least
            if high.any():
                hits.append((rows[r[high]], to[high]))
            made = np.full(step.shape, -np.inf, np.float32)
            made[r, c] = near
            every, value = np.concatenate([ids[rows], step], axis=1), np.concatenate([sims[rows], made], axis=1)
            gone = np.concatenate([left[rows], ~np.isfinite(made)], axis=1)
            some = np.argpartition(-value, width - 1, axis=1)[:, :width]
            ids[rows], sims[rows], gone = (np.take_along_axis(x, some, 1) for x in (every, value, gone))
            ahead = np.where(gone, -np.inf, sims[rows])
            steps = min(STEPS, width)
            pick = np.argpartition(-ahead, steps - 1, axis=1)[:, :steps]
            best = np.take_along_axis(ahead, pick, 1)
            np.put_along_axis(gone, pick, True, 1)
            left[rows] = gone
            at = np.where(np.isfinite(best), np.take_along_axis(ids[rows], pick, 1), -1)
            going = (at >= 0).any(axis=1)
            rows, at = rows[going], at[going]
            step = _without_repeats(np.where(at[..., None] >= 0, links[at], -1).reshape(len(rows), steps * links.shape[1]))
        ids, sims = _best(ids, sims, width)
        found = tuple(np.concatenate(x) for x in zip(*hits)) if hits else (np.zeros(0, int), np.zeros(0, np.int32))
        return ids, sims, (*found, seen)

    def near(self, queries: np.ndarray, own: np.ndarray, width: int, least: float) -> tuple[np.ndarray, np.ndarray]:
        """All ``(query, node)`` found with a similarity of ``least`` or more; ``own`` is a query's own node, or -1.

        After the beam every node that is near enough is left to its neighbours
        too, however many there are, so that a large group of near copies is
        followed to its end and does not have to fit in the beam.
        """
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for at in range(0, len(queries), AT_ONCE):
            some, self_at = queries[at : at + AT_ONCE], own[at : at + AT_ONCE, None]
            starts = np.concatenate([self._descend(some, 0), self_at], axis=1)
            _, _, (q, v, seen) = self.beam(0, some, starts, min(width, len(self.vectors)), self.links[0], least)
            while len(q):
                a.append(q + at)
                b.append(v.astype(np.int64))
                more = [(np.zeros(0, int), np.zeros(0, np.int32))]
                for part in range(0, len(q), PAIRS // LOW_LINKS):
                    to = self.links[0][v[part : part + PAIRS // LOW_LINKS]]
                    r, to = np.repeat(q[part : part + PAIRS // LOW_LINKS], to.shape[1]), to.ravel()
                    fresh = to >= 0
                    fresh[fresh] = ~seen[r[fresh], to[fresh]]
                    keys = np.unique(r[fresh].astype(np.int64) << 32 | to[fresh])
                    r, to = (keys >> 32).astype(int), (keys & 0xFFFFFFFF).astype(np.int32)
                    seen[r, to] = True
                    high = products(some, r, self.vectors, to) >= least
                    more.append((r[high], to[high]))
                q, v = (np.concatenate(x) for x in zip(*more))
        return np.concatenate(a), np.concatenate(b)
