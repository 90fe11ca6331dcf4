"""Layered proximity graphs over the vectors of one shard, in numpy.

A node's links go to near nodes in unlike directions: of the candidates in order of distance, one is taken if it is nearer
to the node than to every link taken before. Nodes of the upper layers are drawn with a probability that falls by the
link number from layer to layer (HNSW); a graph of a single layer starts at the node nearest to the mean (NSG). The
candidates of a layer are exact nearest neighbours, computed in blocks, so a shard is built in bulk; links are made
mutual, and nodes that no walk from the entry reaches get a link from their nearest reached node.
"""

from __future__ import annotations

import heapq
import io
from dataclasses import dataclass

import numpy as np


#: Distances that are held at once while a graph is built.
NUMBERS_AT_ONCE = 1 << 22


def _distances(x: np.ndarray, q: np.ndarray, inner: bool) -> np.ndarray:
    return -(q @ x.T) if inner else (q * q).sum(1)[:, None] - 2 * q @ x.T + (x * x).sum(1)[None, :]


def _diverse(d: np.ndarray, between: np.ndarray, most: int) -> list[int]:
    """Of candidates sorted by distance d, those nearer to the node than to any one taken before; the nearest of the rest fill up a quarter."""
    taken: list[int] = []
    for i in range(len(d)):
        if len(taken) == most:
            break
        if not taken or d[i] < between[i, taken].min():
            taken.append(i)
    for i in range(len(d)):
        if len(taken) >= max(1, most // 4):
            break
        if i not in taken:
            taken.append(i)
    return taken


def _links(x: np.ndarray, most: int, inner: bool) -> list[np.ndarray]:
    """The links of each node of a layer, as places in x."""
    n, pool = len(x), min(len(x) - 1, 3 * most)
    if n < 2:
        return [np.zeros(0, np.int64)] * n
    own: list[list[int]] = []
    block = max(1, min(1024, NUMBERS_AT_ONCE // n))
    for lo in range(0, n, block):
        d = _distances(x, x[lo : lo + block], inner)
        d[np.arange(len(d)), lo + np.arange(len(d))] = np.inf
        near = np.argpartition(d, pool - 1, axis=1)[:, :pool]
        for row, cand in zip(d, near):
            cand = cand[np.lexsort((cand, row[cand]))]
            own.append(cand[_diverse(row[cand], _distances(x[cand], x[cand], inner), most)].tolist())
    both = [set(a) for a in own]
    for i, a in enumerate(own):
        for j in a:
            both[j].add(i)
    out = []
    for i, a in enumerate(both):
        cand = np.array(sorted(a))
        if len(cand) > 2 * most:
            d = _distances(x[cand], x[i : i + 1], inner)[0]
            order = np.lexsort((cand, d))
            cand = cand[order][_diverse(d[order], _distances(x[cand[order]], x[cand[order]], inner), 2 * most)]
        out.append(cand)
    return out


@dataclass
class Graph:
    """ids and vectors of a shard's nodes; layers: of each, its nodes and their links in one array with offsets."""

    ids: np.ndarray
    x: np.ndarray
    inner: bool
    layers: list[tuple[np.ndarray, np.ndarray, np.ndarray]]
    entry: int

    @classmethod
    def build(cls, ids: np.ndarray, x: np.ndarray, links: int, layered: bool = True, inner: bool = False, seed: int = 12345) -> "Graph":
        n = len(ids)
        level = np.zeros(n, np.int64)
        if layered and n:
            level = np.floor(-np.log(1 - np.random.default_rng(seed).random(n)) / np.log(max(links, 2))).astype(np.int64)
        layers = []
        for k in range(int(level.max(initial=0)) + 1 if n else 0):
            nodes = np.flatnonzero(level >= k)
            own = [nodes[a] for a in _links(x[nodes], links if k or not layered else 2 * links, inner)]
            layers.append((nodes, np.concatenate([[0], np.cumsum([len(a) for a in own])]).astype(np.int64), np.concatenate(own) if own else np.zeros(0, np.int64)))
        if layered:
            entry = int(layers[-1][0][0]) if n else -1
        else:
            entry = int(_distances(x, x.mean(0)[None, :], False)[0].argmin()) if n else -1
        out = cls(ids, x, inner, layers, entry)
        return out._reached() if n else out

    def _reached(self) -> "Graph":
        """With links to the nodes that no walk from the entry finds."""
        nodes, offs, flat = self.layers[0]
        links = [flat[a:b].tolist() for a, b in zip(offs, offs[1:])]
        seen = np.zeros(len(nodes), bool)
        waiting = [self.entry]
        seen[self.entry] = True
        while True:
            while waiting:
                i = waiting.pop()
                for j in links[i]:
                    if not seen[j]:
                        seen[j] = True
                        waiting.append(j)
            rest = np.flatnonzero(~seen)
            if not len(rest):
                break
            known = np.flatnonzero(seen)
            lost = int(rest[0])
            near = int(known[_distances(self.x[known], self.x[lost : lost + 1], self.inner)[0].argmin()])
            links[near].append(lost)
            links[lost].append(near)
            seen[lost] = True
            waiting = [lost]
        self.layers[0] = (nodes, np.concatenate([[0], np.cumsum([len(a) for a in links])]).astype(np.int64), np.array([j for a in links for j in a], np.int64))
        return self

    def _neighbours(self, layer: int, node: int) -> np.ndarray:
        nodes, offs, flat = self.layers[layer]
        i = node if layer == 0 else int(np.searchsorted(nodes, node))
        return flat[offs[i] : offs[i + 1]]

    def search(self, q: np.ndarray, k: int, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(distances, ids) of the k nearest that a walk which keeps ``width`` nodes finds; distances are negative inner products for ``inner``."""
        if self.entry < 0:
            return np.zeros(0), np.zeros(0, np.int64)
        width = max(width, k)
        of = lambda nodes: _distances(self.x[nodes], q[None, :], self.inner)[0]
        at, d = self.entry, float(of(np.array([self.entry]))[0])
        for layer in range(len(self.layers) - 1, 0, -1):
            while True:
                near = self._neighbours(layer, at)
                if not len(near):
                    break
                dn = of(near)
                i = int(dn.argmin())
                if dn[i] >= d:
                    break
                at, d = int(near[i]), float(dn[i])
        seen = {at}
        waiting, kept = [(d, at)], [(-d, at)]
        while waiting:
            d, at = heapq.heappop(waiting)
            if len(kept) >= width and d > -kept[0][0]:
                break
            fresh = np.array([j for j in self._neighbours(0, at).tolist() if j not in seen], np.int64)
            if not len(fresh):
                continue
            seen.update(fresh.tolist())
            for dj, j in zip(of(fresh).tolist(), fresh.tolist()):
                if len(kept) < width:
                    heapq.heappush(kept, (-dj, j))
                elif dj < -kept[0][0]:
                    heapq.heapreplace(kept, (-dj, j))
                else:
                    continue
                heapq.heappush(waiting, (dj, j))
        found = np.array([j for _, j in kept], np.int64)
        d = of(found)
        order = np.lexsort((self.ids[found], d))[:k]
        return d[order], self.ids[found[order]]

    def to_bytes(self) -> bytes:
        kept = io.BytesIO()
        parts = {f"{name}{i}": a for i, layer in enumerate(self.layers) for name, a in zip("nol", layer)}
        np.savez(kept, ids=self.ids, x=self.x, head=np.array([self.entry, int(self.inner), len(self.layers)]), **parts)
        return kept.getvalue()

    @classmethod
    def from_bytes(cls, raw: bytes) -> "Graph":
        kept = np.load(io.BytesIO(raw))
        entry, inner, n = kept["head"].tolist()
        return cls(kept["ids"], kept["x"], bool(inner), [tuple(kept[f"{name}{i}"] for name in "nol") for i in range(n)], entry)
