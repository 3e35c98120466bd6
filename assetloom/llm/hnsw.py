"""A hierarchical navigable small-world graph (Malkov and Yashunin, 2016) in numpy.

Nodes are inserted in batches that double, and searched in lockstep: the loops
run over steps of the search, not over nodes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

NEIGHBOURS = 16  # links of a node on upper layers; twice as many on the lowest
EXPANDED = 4  # beam entries expanded in one step
_VALUES = 1 << 21  # vector components gathered at once: 8 MB
_CACHED = 1 << 16  # of them scored at once
_MARKS = 1 << 25  # bytes that tell which query has met which node
_SCANNED = 2048  # nodes of an upper layer that are compared as a whole, where it has no more
_NONE = -2.0  # below any cosine


def members(n: int) -> list[np.ndarray]:
    """The nodes of each layer, lowest first: every 16th goes up. Positions are random, so this draws at random."""
    out = [np.arange(n)]
    while len(out[-1]) > 4 * NEIGHBOURS:
        out.append(out[-1][::NEIGHBOURS])
    return out


def _width(level: int) -> int:
    return NEIGHBOURS * (1 if level else 2)


def _parts(rows: np.ndarray, values_each: int) -> Iterator[np.ndarray]:
    step = max(1, _VALUES // max(1, values_each))
    for at in range(0, len(rows), step):
        yield rows[at : at + step]


def _unique_in_rows(nodes: np.ndarray, score: np.ndarray) -> np.ndarray:
    """The scores, of repeated or absent nodes of a row set below all others; of equals the first stays."""
    order = np.argsort(nodes, 1, kind="stable")
    ranked = np.take_along_axis(nodes, order, 1)
    again = np.zeros(nodes.shape, bool)
    again[:, 1:] = ranked[:, 1:] == ranked[:, :-1]
    bad = np.zeros(nodes.shape, bool)
    np.put_along_axis(bad, order, again, 1)
    return np.where(bad | (nodes < 0), np.float32(_NONE), score)


class Graph:
    def __init__(self, unit: np.ndarray, layers: list[np.ndarray] | None = None, beam: int = 48) -> None:
        self.x, self.members = unit, members(len(unit))
        self.layers = layers or [np.full((len(unit), _width(v)), -1, np.int32) for v in range(len(self.members))]
        if layers is None:
            for level in reversed(range(len(self.members))):
                self._build(level, beam)

    def flat_links(self) -> list[np.ndarray]:
        """For each node its links of all its layers in one array, as ``from_links`` takes them."""
        out = [row for row in self.layers[0]]
        for level in range(1, len(self.members)):
            for node in self.members[level].tolist():
                out[node] = np.concatenate([out[node], self.layers[level][node]])
        return out

    @classmethod
    def from_links(cls, unit: np.ndarray, values: np.ndarray, ends: np.ndarray) -> Graph:
        layers = []
        for level, own in enumerate(members(len(unit))):
            layer = np.full((len(unit), _width(level)), -1, np.int32)
            start = ends[own] + (2 * NEIGHBOURS + (level - 1) * NEIGHBOURS if level else 0)
            layer[own] = values[start[:, None] + np.arange(_width(level))]
            layers.append(layer)
        return cls(unit, layers)

    def _each(self, beam: int, width: int) -> int:
        """Values that a query of a beam search takes in all, for ``_parts``."""
        return max(3 * beam + EXPANDED * width * (self.x.shape[1] + 8), len(self.x) * _VALUES // _MARKS)

    def _scores(self, q: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        found = np.matmul(self.x[np.maximum(nodes, 0)], q[:, :, None])[:, :, 0]
        return np.where(nodes < 0, np.float32(_NONE), found)

    def _pair_scores(self, q: np.ndarray, asked: np.ndarray, node: np.ndarray) -> np.ndarray:
        """The score of each query named in ``asked`` with its ``node``, by so few at once that they stay in the cache."""
        out, step = np.empty(len(node), np.float32), max(1, _CACHED // self.x.shape[1])
        mine, theirs = np.empty((2, min(step, len(node)), self.x.shape[1]), np.float32)
        for at in range(0, len(node), step):
            k = min(step, len(node) - at)
            np.take(q, asked[at : at + k], 0, out=mine[:k], mode="clip")
            np.take(self.x, node[at : at + k], 0, out=theirs[:k], mode="clip")
            np.einsum("ij,ij->i", mine[:k], theirs[:k], out=out[at : at + k])
        return out

    def _build(self, level: int, beam: int) -> None:
        links, width = self.layers[level], _width(level)
        above = self.members[level + 1] if level + 1 < len(self.members) else self.members[level][:1]
        own = np.concatenate([above, np.setdiff1d(self.members[level], above)])
        at = min(len(own), 2 * width)
        self._join(links, own[:at], np.zeros((at, 0), np.int64), np.zeros((at, 0), np.float32))
        while at < len(own):
            # Until all nodes of the layer above are in, searches start at one node.
            stop = min(len(own), at + min(at, 4096), len(above) if at < len(above) else len(own))
            for batch in _parts(own[at:stop], self._each(beam, width)):
                q = self.x[batch]
                start = np.repeat(own[:1], len(batch))[:, None] if at < len(above) else self._enter(q, level)
                self._join(links, batch, *self._beam(q, links, start, beam))
            at = stop

    def _join(self, links: np.ndarray, batch: np.ndarray, found: np.ndarray, score: np.ndarray) -> None:
        """Link new nodes to what was found for them and to each other, and back."""
        step, dim = links.shape[1], self.x.shape[1]
        k = min(len(batch) - 1, step)
        for rows in _parts(np.arange(len(batch)), max(len(batch), 3 * step * (dim + step))):
            near, near_score = found[rows], score[rows]
            if k > 0:
                own = self.x[batch[rows]] @ self.x[batch].T
                own[np.arange(len(rows)), rows] = _NONE
                best = np.argpartition(-own, k - 1, 1)[:, :k]
                near = np.concatenate([near, batch[best]], 1)
                near_score = np.concatenate([near_score, np.take_along_axis(own, best, 1)], 1)
            self._choose(links, batch[rows], near, near_score)
        target, source = links[batch].ravel(), np.repeat(batch, step)
        order = np.argsort(target, kind="stable")
        order = order[target[order] >= 0]
        target, source = target[order], source[order]
        nodes, starts, counts = np.unique(target, return_index=True, return_counts=True)
        for done in range(0, int(counts.max(initial=0)), step):
            # Rows of like counts together, so that few places stay empty.
            some = np.flatnonzero(counts > done)
            some = some[np.argsort(counts[some], kind="stable")]
            for part in _parts(some, 3 * step * (dim + step)):
                place = done + np.arange(min(step, int(counts[part[-1]]) - done))[None]
                rows = np.minimum(starts[part, None] + place, len(source) - 1)
                extra = np.where(place < counts[part, None], source[rows], -1)
                both = np.concatenate([links[nodes[part]], extra], 1)
                self._choose(links, nodes[part], both, self._scores(self.x[nodes[part]], both))

    def _choose(self, links: np.ndarray, nodes: np.ndarray, found: np.ndarray, score: np.ndarray) -> None:
        """Keep the best links; a candidate nearer to one kept than to the node waits behind the others."""
        width = links.shape[1]
        score = _unique_in_rows(found, score)
        score = np.where(found == nodes[:, None], np.float32(_NONE), score)
        order = np.argsort(-score, 1, kind="stable")[:, : 2 * width]
        found, score = np.take_along_axis(found, order, 1), np.take_along_axis(score, order, 1)
        valid = score > _NONE
        if not found.shape[1]:
            return
        vectors = self.x[np.maximum(found, 0)]
        # A copy, as BLAS is slower with a matrix and itself turned.
        nearer = np.matmul(vectors, vectors.transpose(0, 2, 1).copy()) > score[:, None, :]
        covered, chosen = np.zeros_like(valid), np.zeros_like(valid)
        for i in range(found.shape[1]):
            chosen[:, i] = valid[:, i] & ~covered[:, i]
            covered[:, i + 1 :] |= chosen[:, i, None] & nearer[:, i, i + 1 :]
        rank = np.argsort(2 * ~chosen + 2 * ~valid, 1, kind="stable")[:, :width]
        kept = np.where(np.take_along_axis(valid, rank, 1), np.take_along_axis(found, rank, 1), -1)
        links[nodes] = -1
        links[nodes, : kept.shape[1]] = kept

    def _enter(self, q: np.ndarray, level: int) -> np.ndarray:
        """The nodes at which a search of ``level`` starts, by way of the layers above."""
        start = np.repeat(self.members[-1][:1], len(q))[:, None]
        for v in range(len(self.members) - 1, level, -1):
            own = self.members[v]
            if len(own) <= _SCANNED:
                if v > level + 1 and len(self.members[v - 1]) <= _SCANNED:
                    continue  # the next layer is compared as a whole, wherever it is entered
                score = q @ self.x[own].T
                start = own[np.argpartition(-score, min(4, len(own)) - 1, 1)[:, :4]]
                continue
            found, score = self._beam(q, self.layers[v], start, 8)
            start = np.take_along_axis(found, np.argsort(-score, 1, kind="stable")[:, :4], 1)
        return start

    def _beam(self, q: np.ndarray, links: np.ndarray, start: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Best-first search; a query rests when all of its beam is expanded. Absent places hold -1.

        A node is scored once for a query, and kept only if it beats the beam's last.
        """
        n, width = len(self.x), max(width, start.shape[1])
        beam = np.full((len(q), width), -1, np.int64)
        score = np.full((len(q), width), _NONE, np.float32)
        done = np.ones((len(q), width), bool)
        k = start.shape[1]
        beam[:, :k], score[:, :k], done[:, :k] = start, self._scores(q, start), start < 0
        met = np.zeros(len(q) * n, bool)
        met[(np.arange(len(q))[:, None] * n + start)[start >= 0]] = True
        active = np.arange(len(q))
        step = min(EXPANDED, width)
        while len(active):
            b, s, d = beam[active], score[active], done[active]
            waiting = np.where(d, np.float32(-3), s)
            pick = np.argpartition(-waiting, step - 1, 1)[:, :step]
            usable = np.take_along_axis(waiting, pick, 1) > _NONE
            alive = usable.any(1)
            if not alive.all():
                active, b, s, d, pick, usable = (v[alive] for v in (active, b, s, d, pick, usable))
                if not len(active):
                    break
            np.put_along_axis(d, pick, np.take_along_axis(d, pick, 1) | usable, 1)
            done[active] = d
            row, place = np.nonzero(usable)
            near = links[b[row, pick[row, place]]]
            key = ((active[row] * n)[:, None] + near)[near >= 0]
            key = np.sort(key[~met[key]])
            key = key[np.append(True, key[1:] != key[:-1])] if len(key) else key
            met[key] = True
            asked, node = np.divmod(key, n)
            got = self._pair_scores(q, asked, node)
            better = got > score.min(1)[asked]
            asked, node, got = asked[better], node[better], got[better]
            if not len(asked):
                continue
            begins = np.flatnonzero(np.append(True, asked[1:] != asked[:-1]))
            changed, counts = asked[begins], np.diff(np.append(begins, len(asked)))
            line = np.repeat(np.arange(len(changed)), counts)
            column = width + np.arange(len(asked)) - np.repeat(begins, counts)
            most = width + int(counts.max())
            b, s, d = np.full((len(changed), most), -1, np.int64), np.full((len(changed), most), _NONE, np.float32), np.zeros((len(changed), most), bool)
            b[:, :width], s[:, :width], d[:, :width] = beam[changed], score[changed], done[changed]
            b[line, column], s[line, column] = node, got
            top = np.argpartition(-s, width - 1, 1)[:, :width]
            s = np.take_along_axis(s, top, 1)
            beam[changed], score[changed] = np.take_along_axis(b, top, 1), s
            done[changed] = np.take_along_axis(d, top, 1) | (s <= _NONE)
        return beam, score

    def within(self, q: np.ndarray, least: float, width: int, widest: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, node) pairs at ``least`` or above. A beam full of such nodes is widened fourfold and run
        again; beyond ``widest``, or the size of the graph, the query is compared with all nodes."""
        left, right, waiting = [], [], np.arange(len(q))
        while len(waiting):
            full = []
            compare = width >= min(widest, len(self.x))
            each = len(self.x) if compare else self._each(width, 2 * NEIGHBOURS)
            for part in _parts(waiting, each):
                if compare:
                    a, b = np.nonzero(q[part] @ self.x.T >= least)
                    left.append(part[a])
                    right.append(b)
                    continue
                found, score = self._beam(q[part], self.layers[0], self._enter(q[part], 0), width)
                hit = score >= least
                again = hit.all(1)
                a, b = np.nonzero(hit & ~again[:, None])
                left.append(part[a])
                right.append(found[a, b])
                full.append(part[again])
            waiting = np.concatenate(full) if full else waiting[:0]
            width *= 4
        none = np.zeros(0, np.int64)
        return np.concatenate([none, *left]), np.concatenate([none, *right])
