"""Hierarchical navigable small-world graph over unit vectors, searched for many queries at once."""

from __future__ import annotations

import io
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field

import numpy as np

M = 12  # links of a node on upper layers; twice as many on the lowest
EF_BUILD = 48
STEP = 4  # nodes that a query expands at once
BATCH = 256
FLOOD = 1 << 16  # links followed at once
DENSE = 256  # nodes, and share of a shard, that a query floods before brute force is cheaper
BLOCK = 1 << 22  # similarities of a block of brute force
HITS = 1 << 20  # hits returned at once


def unit(vectors: np.ndarray) -> np.ndarray:
    wide = vectors.astype(np.float64)
    return wide / np.linalg.norm(wide, axis=1, keepdims=True)


def _diverse(candidates: np.ndarray, sims: np.ndarray, vectors: np.ndarray, keep: int) -> np.ndarray:
    """Of each row's candidates (best first, -1 for none) those nearer to the row than to any chosen one.

    What stays free is filled with the best of the others, so that near copies keep links outside.
    """
    rows, width = candidates.shape
    own = vectors[np.maximum(candidates, 0)]
    between = np.matmul(own, own.transpose(0, 2, 1))
    chosen = np.zeros((rows, width), bool)
    for k in range(width):
        rival = np.where(chosen[:, :k], between[:, k, :k], -2).max(1, initial=-2)
        chosen[:, k] = (candidates[:, k] >= 0) & (rival < sims[:, k]) & (chosen.sum(1) < keep)
    rank = np.where(chosen, 0, np.where(candidates >= 0, 1, 2))
    order = np.argsort(rank, axis=1, kind="stable")[:, :keep]
    return np.take_along_axis(candidates, order, 1)


@dataclass
class Layer:
    """Links of nodes; ``-1`` fills up. Nodes outside the layer have none."""

    links: np.ndarray
    entry: int = -1

    def search(self, vectors: np.ndarray, queries: np.ndarray, entries: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
        """Nodes and similarities of the ``ef`` best found for each query, best first, -1 for none."""
        rows = len(queries)
        at = np.arange(rows)[:, None]
        ids = np.full((rows, ef), -1, np.int64)
        sims = np.full((rows, ef), -2, np.float32)
        done = np.ones((rows, ef), bool)
        ids[:, 0], done[:, 0] = entries, False
        sims[:, 0] = np.einsum("bd,bd->b", vectors[entries], queries)
        seen = np.zeros((rows, len(vectors)), bool)
        seen[at[:, 0], entries] = True
        live = np.arange(rows)
        while len(live):
            todo = np.where(done[live], 3, -sims[live])
            pick = np.argsort(todo, axis=1, kind="stable")[:, :STEP]
            open_ = ~np.take_along_axis(done[live], pick, 1)
            some = open_.any(1)
            live, pick, open_ = live[some], pick[some], open_[some]
            if not len(live):
                break
            nodes = np.where(open_, ids[live[:, None], pick], -1)
            done[live[:, None], pick] = True
            near = np.where(nodes[:, :, None] >= 0, self.links[np.maximum(nodes, 0)], -1).reshape(len(live), -1)
            fresh = (near >= 0) & ~seen[live[:, None], np.maximum(near, 0)]
            # a node behind two expanded ones counts once
            order = np.argsort(near, axis=1, kind="stable")
            sorted_ = np.take_along_axis(near, order, 1)
            again = np.zeros_like(fresh)
            np.put_along_axis(again, order[:, 1:], sorted_[:, 1:] == sorted_[:, :-1], 1)
            fresh &= ~again
            r, c = np.nonzero(fresh)
            found = near[r, c]
            seen[live[r], found] = True
            sim = np.full(near.shape, -2, np.float32)
            sim[r, c] = np.einsum("nd,nd->n", vectors[found], queries[live[r]])
            all_sims = np.concatenate([sims[live], sim], 1)
            all_ids = np.concatenate([ids[live], np.where(fresh, near, -1)], 1)
            all_done = np.concatenate([done[live], ~fresh], 1)
            best = np.argsort(-all_sims, axis=1, kind="stable")[:, :ef]
            sims[live] = np.take_along_axis(all_sims, best, 1)
            ids[live] = np.take_along_axis(all_ids, best, 1)
            done[live] = np.take_along_axis(all_done, best, 1)
        return ids, sims

    def insert(self, vectors: np.ndarray, new: np.ndarray, entries: np.ndarray | None, keep: int) -> None:
        """Links new nodes with the layer and with each other."""
        width = min(EF_BUILD, len(new) - 1)
        ids, sims = np.full((len(new), 0), -1), np.zeros((len(new), 0), np.float32)
        if entries is not None:
            ids, sims = self.search(vectors, vectors[new], entries, EF_BUILD)
        if width > 0:  # the new nodes do not find each other by search
            own = vectors[new] @ vectors[new].T
            np.fill_diagonal(own, -2)
            near = np.argpartition(-own, width - 1, 1)[:, :width]
            ids = np.concatenate([ids, new[near]], 1)
            sims = np.concatenate([sims, np.take_along_axis(own, near, 1)], 1)
        if not ids.shape[1]:
            return
        order = np.argsort(-sims, axis=1, kind="stable")[:, :EF_BUILD]
        ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
        links = _diverse(ids, sims, vectors, keep)
        self.links[new, :links.shape[1]] = links
        self._link_back(vectors, new, links, keep)

    def _link_back(self, vectors: np.ndarray, new: np.ndarray, links: np.ndarray, keep: int) -> None:
        source, target = np.repeat(new, links.shape[1]), links.reshape(-1)
        source, target = source[target >= 0], target[target >= 0]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        nodes, first, n = np.unique(target, return_index=True, return_counts=True)
        for part in range(0, len(nodes), BATCH):
            node, begin, size = nodes[part:part + BATCH], first[part:part + BATCH], n[part:part + BATCH]
            extra = np.full((len(node), size.max()), -1)
            fill = np.arange(size.max())[None, :] < size[:, None]
            extra[fill] = source[np.repeat(begin, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)]
            both = np.sort(np.concatenate([self.links[node], extra], 1), axis=1)
            both[:, 1:][both[:, 1:] == both[:, :-1]] = -1
            sims = np.einsum("bnd,bd->bn", vectors[np.maximum(both, 0)], vectors[node])
            sims[both < 0] = -2
            best = np.argsort(-sims, axis=1, kind="stable")[:, :2 * keep]
            kept = _diverse(np.take_along_axis(both, best, 1), np.take_along_axis(sims, best, 1), vectors, keep)
            self.links[node] = -1
            self.links[node, :kept.shape[1]] = kept


@dataclass
class Graph:
    vectors: np.ndarray  # unit vectors, 32 bits
    layers: list[Layer] = field(default_factory=list)  # lowest first

    @classmethod
    def build(cls, vectors: np.ndarray, seed: int = 0) -> Graph:
        graph = cls(vectors.astype(np.float32))
        n = len(vectors)
        rng = np.random.default_rng(seed)
        level = np.minimum(np.floor(-np.log(rng.random(n)) / np.log(M)), 8).astype(int)
        order = rng.permutation(n)
        # from the top layer down, so that every layer is searched from a finished one above
        for height in range(level.max() if n else -1, -1, -1):
            keep = 2 * M if height == 0 else M
            layer = Layer(np.full((n, keep), -1, np.int32))
            members = order[level[order] >= height]
            upper = {int(m) for m in members if level[m] > height}
            members = np.array([m for m in members if int(m) in upper] + [m for m in members if int(m) not in upper], np.int64)
            layer.entry = int(members[0])
            at, size = 0, 32
            while at < len(members):
                new = members[at:at + size]
                entries = None
                if at:
                    entries = graph._descend(graph.vectors[new], layer.entry)
                    inside = np.zeros(n, bool)
                    inside[members[:at]] = True
                    entries = np.where(inside[entries], entries, layer.entry)
                layer.insert(graph.vectors, new, entries, keep)
                at += len(new)
                size = min(2 * size, BATCH)
            graph.layers.insert(0, layer)
        return graph

    def _descend(self, queries: np.ndarray, entry: int) -> np.ndarray:
        """Entry nodes for the layer below the layers there are."""
        at = np.full(len(queries), self.layers[-1].entry if self.layers else entry)
        for layer in reversed(self.layers):
            ids, _ = layer.search(self.vectors, queries, at, STEP)
            at = ids[:, 0]
        return at

    def search(self, queries: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
        upper = Graph(self.vectors, self.layers[1:])
        ef = min(ef, len(self.vectors))
        return self.layers[0].search(self.vectors, queries, upper._descend(queries, self.layers[0].entry), ef)

    def both_ways(self) -> tuple[np.ndarray, np.ndarray]:
        """First place of each node's neighbours, and the neighbours, of the lowest layer's links both ways."""
        links = self.layers[0].links
        there = links >= 0
        out, ahead = there.sum(1), links[there]
        into = np.bincount(ahead, minlength=len(links))
        first = np.concatenate([[0], np.cumsum(out + into)])
        others = np.empty(first[-1], np.int32)
        back = np.ones(first[-1], bool)  # a node's own links come first, then those to it
        back[np.repeat(first[:-1] - np.cumsum(out) + out, out) + np.arange(len(ahead))] = False
        others[~back] = ahead
        others[back] = np.repeat(np.arange(len(links), dtype=np.int32), out)[np.argsort(ahead, kind="stable")]
        return first, others

    def hits(self, queries: np.ndarray, least: float, ef: int, slack: float,
             ways: tuple[np.ndarray, np.ndarray] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Query, node and similarity of all found similarities from ``least``, in parts of bounded size.

        The beam leads to the region of a query; from its nodes the region is flooded along the links
        of all nodes down to ``least - slack``, in both directions, as in dense regions pruning leaves
        nodes that no link leads to. A query has as many results as there are. A query whose region is
        so dense that flooding costs more than brute force goes to brute force. Beam 0 is brute force.
        ``ways`` are the graph's ``both_ways`` if they are at hand.
        """
        if not ef:
            yield from self.brute(queries, least)
            return
        n = len(self.vectors)
        dense = max(DENSE, n // DENSE)
        first, others = ways or self.both_ways()
        for start in range(0, len(queries), BATCH):
            part = queries[start:start + BATCH]
            ids, sims = self.search(part, ef)
            seen = np.zeros((len(part), n), bool)
            row, col = np.nonzero(ids >= 0)
            node, sim = ids[row, col], sims[row, col]
            seen[row, node] = True
            size = np.zeros(len(part), np.int64)  # nodes that each query's flood went through
            found = []
            todo = [(row, node, sim)]
            while todo:
                row, node, sim = todo.pop()
                go = (sim >= least - slack) & (size[row] <= dense)
                row, node, sim = row[go], node[go], sim[go]
                size += np.bincount(row, minlength=len(part))
                hit = sim >= least
                found.append((row[hit], node[hit], sim[hit]))
                go = size[row] <= dense
                row, node = row[go], node[go]
                ends = np.cumsum(first[node + 1] - first[node])
                cuts = np.searchsorted(ends, np.arange(FLOOD, ends[-1] + FLOOD, FLOOD)) + 1 if len(ends) else []
                for r, x in zip(np.split(row, cuts), np.split(node, cuts)):
                    at, width = first[x], first[x + 1] - first[x]
                    near = others[np.repeat(at, width) + np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width)]
                    r = np.repeat(r, width)
                    new = ~seen[r, near]
                    both = np.unique(r[new] * n + near[new])
                    r, x = both // n, both % n
                    seen[r, x] = True
                    if len(r):
                        todo.append((r, x, np.einsum("nd,nd->n", self.vectors[x], part[r])))
            row, node, sim = (np.concatenate(f) for f in zip(*found))
            flooded = size[row] <= dense
            yield start + row[flooded], node[flooded], sim[flooded]
            rest = np.flatnonzero(size > dense)
            for q, node, sim in self.brute(part[rest], least):
                yield start + rest[q], node, sim

    def within(self, queries: np.ndarray, least: float, ef: int, slack: float) -> tuple[np.ndarray, np.ndarray]:
        """Query and node of all hits at once."""
        found = [(q, node) for q, node, _ in self.hits(queries, least, ef, slack)]
        q, node = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 2
        return q, node

    def brute(self, queries: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Query, node and similarity of all similarities from ``least``, block by block."""
        rows = max(1, BLOCK // len(self.vectors))
        for start in range(0, len(queries), rows):
            sims = queries[start:start + rows] @ self.vectors.T
            flat = np.flatnonzero(sims >= least)
            for i in range(0, len(flat), HITS):
                at = flat[i:i + HITS]
                q, node = np.divmod(at, len(self.vectors))
                yield start + q, node, sims.reshape(-1)[at]

    def arrays(self) -> dict[str, np.ndarray]:
        """What ``of`` makes the graph from, beside its vectors; nodes without links are left out."""
        out = {"entries": np.array([x.entry for x in self.layers], np.int64)}
        for i, layer in enumerate(self.layers):
            nodes = np.flatnonzero((layer.links >= 0).any(1))
            out |= {f"nodes{i}": nodes.astype(np.int32), f"links{i}": layer.links[nodes]}
        return out

    @classmethod
    def of(cls, vectors: np.ndarray, arrays: Mapping[str, np.ndarray]) -> Graph:
        layers = []
        for i, entry in enumerate(arrays["entries"]):
            some = arrays[f"links{i}"]
            links = np.full((len(vectors), some.shape[1]), -1, np.int32)
            links[arrays[f"nodes{i}"]] = some
            layers.append(Layer(links, int(entry)))
        return cls(vectors, layers)

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, vectors=self.vectors, **self.arrays())
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> Graph:
        with np.load(io.BytesIO(data)) as z:
            return cls.of(z["vectors"], z)
