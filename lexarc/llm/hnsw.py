"""Hierarchical navigable small-world graphs over unit vectors, built and searched in batches with numpy.

Nodes are numbered so that each layer holds a prefix of them: the layers' sizes shrink by a constant factor. A layer
grows by batches of at most its present size; every batch searches the graph that stands, picks diverse neighbours, and
hangs itself to them in return.
"""

from __future__ import annotations

import io

import numpy as np

DEGREE, BUILD_BEAM, SHRINK, BATCH = 16, 48, 16, 256


def _beam(nbr: np.ndarray, x: np.ndarray, q: np.ndarray, entry: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
    """Best ef nodes of a layer for each query, with their similarities, from entry nodes (rows x k). -1 fills up."""
    n, b = len(nbr), len(q)
    seen = np.zeros((b, n), bool)
    ids = np.full((b, ef), -1, dtype=np.int32)
    sim = np.full((b, ef), -np.inf, dtype=np.float32)
    open_ = np.zeros((b, ef), bool)
    k = min(ef, entry.shape[1])
    ids[:, :k] = entry[:, :k]
    rows = np.arange(b)
    ok = ids[:, :k] >= 0
    seen[np.repeat(rows, k)[ok.ravel()], ids[:, :k][ok]] = True
    sim[:, :k] = np.where(ok, np.einsum("bkd,bd->bk", x[ids[:, :k]], q), -np.inf)
    open_[:, :k] = ok
    active = rows
    while len(active):
        s = np.where(open_[active], sim[active], -np.inf)
        best = s.argmax(axis=1)
        go = s[np.arange(len(active)), best] > -np.inf
        active, best = active[go], best[go]
        if not len(active):
            break
        open_[active, best] = False
        near = nbr[ids[active, best]]
        fresh = (near >= 0) & ~seen[active[:, None], near]
        r, c = np.nonzero(fresh)
        seen[active[r], near[r, c]] = True
        new = np.where(fresh, np.einsum("bkd,bd->bk", x[near], q[active]), -np.inf).astype(np.float32)
        better = new.max(axis=1) > sim[active].min(axis=1)
        a = active[better]
        if len(a):
            cs = np.concatenate([sim[a], new[better]], axis=1)
            ci = np.concatenate([ids[a], near[better]], axis=1)
            co = np.concatenate([open_[a], fresh[better]], axis=1)
            top = np.argpartition(-cs, ef - 1, axis=1)[:, :ef]
            sim[a], ids[a], open_[a] = (np.take_along_axis(z, top, axis=1) for z in (cs, ci, co))
            ids[a] = np.where(np.isfinite(sim[a]), ids[a], -1)
            open_[a] &= np.isfinite(sim[a])
    order = np.argsort(-sim, axis=1, kind="stable")
    return np.take_along_axis(ids, order, axis=1), np.take_along_axis(sim, order, axis=1)


def _diverse(x: np.ndarray, ids: np.ndarray, sim: np.ndarray, degree: int) -> np.ndarray:
    """Of candidates by falling similarity, those nearer to the node than to any chosen before; then the nearest others."""
    b, k = ids.shape
    valid = ids >= 0
    v = x[np.maximum(ids, 0)]
    cross = np.einsum("bid,bjd->bij", v, v)
    chosen = np.zeros((b, k), bool)
    worst = np.full((b, k), -np.inf, dtype=np.float32)
    for i in range(k):
        take = valid[:, i] & (sim[:, i] > worst[:, i]) & (chosen.sum(axis=1) < degree)
        chosen[:, i] = take
        worst[take] = np.maximum(worst[take], cross[take, i])
    rank = np.where(chosen, 0, np.where(valid, 1, 2))
    order = np.argsort(rank, axis=1, kind="stable")[:, :degree]
    out = np.where(np.take_along_axis(valid, order, axis=1), np.take_along_axis(ids, order, axis=1), -1)
    if out.shape[1] < degree:
        out = np.pad(out, ((0, 0), (0, degree - out.shape[1])), constant_values=-1)
    return out.astype(np.int32)


class Graph:
    def __init__(self, x: np.ndarray, layers: list[np.ndarray]):
        self.x, self.layers = x, layers

    @classmethod
    def build(cls, x: np.ndarray) -> Graph:
        """x: unit vectors (float32) in random order."""
        sizes = [len(x)]
        while sizes[-1] > 4 * SHRINK:
            sizes.append(sizes[-1] // SHRINK)
        g = cls(x, [])
        for size in reversed(sizes):
            g.layers.insert(0, g._layer(size))
        return g

    def _layer(self, size: int) -> np.ndarray:
        x, degree = self.x, DEGREE
        nbr = np.full((size, degree * 2), -1, dtype=np.int32)
        done = min(size, 2 * degree)
        first = x[:done] @ x[:done].T
        np.fill_diagonal(first, -np.inf)
        order = np.argsort(-first, axis=1)[:, :done - 1].astype(np.int32)
        if done > 1:
            nbr[:done] = _diverse(x, order, np.take_along_axis(first, order, axis=1), degree * 2)
        while done < size:
            end = min(size, done + min(done, BATCH))
            q = x[done:end]
            ids, sim = _beam(nbr[:done], x, q, self._entry(q, done), BUILD_BEAM)
            picked = _diverse(x, ids, sim, degree)
            nbr[done:end, :degree] = picked
            self._hang(nbr, picked, done)
            done = end
        return nbr

    def _hang(self, nbr: np.ndarray, picked: np.ndarray, done: int) -> None:
        r, c = np.nonzero(picked >= 0)
        to, own = picked[r, c], (r + done).astype(np.int32)
        order = np.argsort(to, kind="stable")
        to, own = to[order], own[order]
        nodes, begin, count = np.unique(to, return_index=True, return_counts=True)
        width = nbr.shape[1]
        new = np.full((len(nodes), int(count.max())), -1, dtype=np.int32)
        new[np.repeat(np.arange(len(nodes)), count), np.arange(len(to)) - np.repeat(begin, count)] = own
        both = np.concatenate([nbr[nodes], new], axis=1)
        fits = (both >= 0).sum(axis=1) <= width
        order = np.argsort(both < 0, axis=1, kind="stable")[:, :width]
        nbr[nodes[fits]] = np.take_along_axis(both, order, axis=1)[fits]
        full = np.flatnonzero(~fits)
        for at in range(0, len(full), BATCH):
            f = full[at:at + BATCH]
            ids = both[f]
            sim = np.where(ids >= 0, np.einsum("bkd,bd->bk", self.x[np.maximum(ids, 0)], self.x[nodes[f]]), -np.inf)
            order = np.argsort(-sim, axis=1, kind="stable")[:, :3 * width]
            nbr[nodes[f]] = _diverse(self.x, np.take_along_axis(ids, order, axis=1), np.take_along_axis(sim, order, axis=1), width)

    def _entry(self, q: np.ndarray, limit: int) -> np.ndarray:
        """Entry nodes below a limit, found by descending through the layers above the one that grows."""
        entry = np.zeros((len(q), 1), dtype=np.int32)
        for nbr in reversed(self.layers):
            part = nbr[:limit]
            entry, _ = _beam(np.where(part < limit, part, -1), self.x, q, entry, 4)
        return entry

    def search(self, q: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
        entry = np.zeros((len(q), 1), dtype=np.int32)
        for nbr in reversed(self.layers[1:]):
            entry, _ = _beam(nbr, self.x, q, entry, 4)
        return _beam(self.layers[0], self.x, q, entry, min(ef, len(self.x)))

    def dump(self) -> bytes:
        f = io.BytesIO()
        np.savez(f, x=self.x, **{f"l{i}": a for i, a in enumerate(self.layers)})
        return f.getvalue()

    @classmethod
    def load(cls, data: bytes) -> Graph:
        z = np.load(io.BytesIO(data))
        return cls(z["x"], [z[f"l{i}"] for i in range(len(z.files) - 1)])
