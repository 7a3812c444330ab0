"""A whole context tree in memory, for comparison with the one that is weighted as a table."""

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np

from corpusbrief.llm.scoring import _branches, _evidence, _grams, _one


@dataclass(frozen=True)
class ContextTree:
    """``child[node, byte]``: the node of the context one byte longer, -1 if it has none; ``log10[node, byte]``:
    what the weighted tree gives the byte where ``node`` is the longest kept context."""

    child: np.ndarray
    log10: np.ndarray
    depth: int

    def score(self, text: bytes) -> float:
        """log10 probability of the whole text and its end."""
        total = 0.0
        for codes in _grams([text], self.depth):
            node, alive = np.zeros(len(codes), np.int32), np.ones(len(codes), bool)
            for back in range(1, self.depth + 1):
                longer = self.child[node, codes >> 8 * back & 0xFF]
                alive &= longer >= 0
                node = np.where(alive, longer, node)
            total += float(self.log10[node, codes & 0xFF].sum(dtype=np.float64))
        return total


def weigh(contexts: list[list[int]], leaves: Iterable[tuple[int, int, int, int]], depth: int) -> ContextTree:
    """Mix the estimates of all depths.

    ``contexts[d]``: kept contexts of depth d, whose lowest byte is the most recent one; every kept context's
    shorter ones are kept. ``leaves``: (depth, context, byte, n) where context is the longest kept one. A node's
    probability is half its own estimate and half the product of its children's, "rest" among them.
    """
    names = [(d, c) for d in range(depth + 1) for c in (contexts[d] if d else [0])]
    number = {name: i for i, name in enumerate(names)}
    up = np.array([number[d - 1, c & ((1 << 8 * (d - 1)) - 1)] if d else -1 for d, c in names])
    level = np.array([d for d, _ in names])
    rest = np.zeros((len(names), 256))
    for d, c, byte, n in leaves:
        rest[number[d, c], byte] += n
    full = rest.copy()
    for d in range(depth, 0, -1):
        np.add.at(full, up[level == d], full[level == d])
    own, own_one = _evidence(tree := _branches(full)), _one(tree)
    rest_evidence, rest_one = _evidence(tree := _branches(rest)), _one(tree)
    below, weighted = rest_evidence, np.zeros_like(own)
    stay = np.ones_like(own)
    for d in range(depth, -1, -1):
        at = level == d
        if d == depth:
            weighted[at] = own[at]
        else:
            stop = own[at] - np.log(2)
            weighted[at] = np.logaddexp(stop, below[at] - np.log(2))
            stay[at] = np.exp(stop - weighted[at])
        if d:
            np.add.at(below, up[at], weighted[at])
    one, left = np.zeros_like(own), np.ones_like(own)
    for d in range(depth + 1):
        at = np.flatnonzero(level == d)
        if d:
            one[at], left[at] = one[up[at]], left[up[at]]
        one[at] += left[at] * stay[at] * own_one[at]
        left[at] *= 1 - stay[at]
    one += left * rest_one  # nothing is left at the full depth
    logs = np.zeros((len(names), 512))
    one = np.clip(one, 1e-300, 1 - 1e-16)
    for j in range(1, 256):
        logs[:, 2 * j] = logs[:, j] + np.log10(1 - one[:, j])
        logs[:, 2 * j + 1] = logs[:, j] + np.log10(one[:, j])
    child = np.full((len(names), 256), -1, np.int32)
    for i, (d, c) in enumerate(names[1:], 1):
        child[up[i], c >> 8 * (d - 1)] = i
    return ContextTree(child, logs[:, 256:].astype(np.float32), depth)
