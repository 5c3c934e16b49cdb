"""Context-tree weighting in one process and the other way round, longest contexts first: what the operator's shards are held against."""

from collections.abc import Iterator
from math import lgamma, log, pi

import numpy as np

from hindcast.llm.lm_score import DEPTH, _nodes

_log_gamma = np.vectorize(lgamma, otypes=[float])


def _estimate(zeros, ones):
    return _log_gamma(zeros + 0.5) + _log_gamma(ones + 0.5) - log(pi) - _log_gamma(zeros + ones + 1.0) if len(zeros) else np.zeros(0)


def _contexts(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Depth, the positions that have so many bytes before them, and the packed context of each; shortest first."""
    at = np.arange(len(data)) - np.repeat(start, end - start)
    packed = np.zeros(len(data), np.uint64)
    for depth in range(DEPTH + 1):
        where = np.flatnonzero(at >= depth)
        yield depth, where, packed[where]
        if depth < DEPTH:
            more = np.flatnonzero(at > depth)
            packed[more] |= data[more - depth - 1].astype(np.uint64) << np.uint64(8 * depth)


class Tree:
    """Per depth: sorted keys of (context, bit prefix), the probability of a one bit there mixed over shorter contexts."""

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray]]):
        """levels: for each depth, symbols (context << 8 | byte) and their counts."""
        nodes = [_nodes(symbols, n) for symbols, n in levels]
        below = None
        # From the longest contexts up: the weighted code length of a node is that of its own estimate or of its children.
        weights: list[np.ndarray] = [np.zeros(0)] * len(nodes)
        for depth in range(len(nodes) - 1, -1, -1):
            key, zeros, ones = nodes[depth]
            own = _estimate(zeros, ones)
            if below is None:
                weights[depth], total = np.ones(len(key)), own
            else:
                child_key, child_total, child_zeros, child_ones = below
                mask = (np.uint64(1) << np.uint64(8 * depth)) - np.uint64(1)
                parent = np.searchsorted(key, (child_key >> np.uint64(8) & mask) << np.uint64(8) | (child_key & np.uint64(0xFF)))
                rest, z, o = np.zeros(len(key)), zeros.astype(np.float64), ones.astype(np.float64)
                np.add.at(rest, parent, child_total)
                np.subtract.at(z, parent, child_zeros)
                np.subtract.at(o, parent, child_ones)
                # Training bytes whose longer context is not in the tree form one more child.
                rest += np.where((z > 0) | (o > 0), _estimate(np.maximum(z, 0), np.maximum(o, 0)), 0.0)
                total = np.logaddexp(own, rest) - np.log(2)
                weights[depth] = np.exp(np.minimum(own - np.log(2) - total, 0.0))
            below = key, total, zeros, ones
        self.levels = []
        for depth, (key, zeros, ones) in enumerate(nodes):
            # Prediction of a one bit by the node alone; the mixture with longer contexts follows the path when scoring.
            self.levels.append((key, ((ones + 0.5) / (zeros + ones + 1.0)).astype(np.float32), weights[depth].astype(np.float32)))

    def score(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """log10 probability of each segment."""
        total = np.zeros(len(data))
        paths = [(where, context << np.uint64(8)) for _, where, context in _contexts(data, start, end)]
        for bit in range(8):
            prefix = ((1 << bit) | (data.astype(np.uint64) >> np.uint64(8 - bit))).astype(np.uint64)
            one = (data >> np.uint8(7 - bit)) & 1 == 1
            p, deeper = np.full(len(data), 0.5, np.float32), np.zeros(len(data), bool)
            # Longest contexts first: each node mixes its own estimate with what the longer ones predict, if any is known.
            for (where, context), (key, own, weight) in zip(reversed(paths), reversed(self.levels), strict=True):
                if not len(key) or not len(where):
                    continue
                wanted = context | prefix[where]
                at = np.minimum(np.searchsorted(key, wanted), len(key) - 1)
                known = key[at] == wanted
                at, where = at[known], where[known]
                w = np.where(deeper[where], weight[at], np.float32(1))
                p[where] = w * own[at] + (1 - w) * p[where]
                deeper[where] = True
            total += np.log10(np.where(one, p, 1 - p).astype(np.float64))
        edges = np.r_[0.0, np.cumsum(total)]
        return edges[end] - edges[start]
