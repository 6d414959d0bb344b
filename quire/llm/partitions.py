"""Learned partitions: a balanced split of a neighbour graph, and a small classifier that routes to it."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Router:
    """A network with one hidden layer that gives each partition's probability for a vector; ``mass``
    is how much of it a query has to visit."""

    hidden: np.ndarray
    hidden_bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray
    mass: float

    @property
    def parts(self) -> int:
        return len(self.out_bias)

    def probabilities(self, rows: np.ndarray) -> np.ndarray:
        return _softmax(np.maximum(unit(rows) @ self.hidden + self.hidden_bias, 0) @ self.out + self.out_bias)

    def homes(self, rows: np.ndarray) -> np.ndarray:
        """The most probable partition of each row, where it is stored."""
        return self.probabilities(rows).argmax(axis=1).astype(np.int32)

    def visits(self, rows: np.ndarray) -> list[np.ndarray]:
        """The most probable partitions of each row, until those before have ``mass`` of it together."""
        found = self.probabilities(rows)
        order = np.argsort(-found, axis=1, kind="stable").astype(np.int32)
        sorted_ = np.take_along_axis(found, order, axis=1)
        before = np.cumsum(sorted_, axis=1) - sorted_
        return [own[:max(1, int(count))] for own, count in zip(order, (before < self.mass).sum(axis=1))]


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, in single precision."""
    rows = rows / np.maximum(np.abs(rows).max(axis=1, keepdims=True), 1e-300)
    return (rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-300)).astype(np.float32)


def _softmax(scores: np.ndarray) -> np.ndarray:
    scores = np.exp(scores - scores.max(axis=1, keepdims=True))
    return scores / scores.sum(axis=1, keepdims=True)


def balanced(scores: np.ndarray, room: int) -> np.ndarray:
    """A partition for each row, of high score, with at most ``room`` rows each. All rows ask for their
    best partition that is not closed; those with the highest scores are taken, a full one closes."""
    count, parts = scores.shape
    labels = np.full(count, -1, np.int64)
    left = np.full(parts, room)
    waiting = np.arange(count)
    while len(waiting):
        own = np.where(left > 0, scores[waiting], -np.inf)
        want = own.argmax(axis=1)
        order = np.lexsort((-own[np.arange(len(waiting)), want], want))
        place = np.arange(len(order)) - np.searchsorted(want[order], want[order])
        taken = order[place < left[want[order]]]
        labels[waiting[taken]] = want[taken]
        left -= np.bincount(want[taken], minlength=parts)
        waiting = np.delete(waiting, taken)
    return labels


def split(rows: np.ndarray, neighbours: np.ndarray, parts: int, slack: float = 1.05, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Partitions of about equal size that cut few edges between rows and their neighbours.

    Starts from balanced nearest centres; then rows move, half of them at a time, to the partitions
    that hold most of their neighbours in either direction, as far as there is room. The split with
    the fewest cut edges is returned."""
    rng = np.random.default_rng(seed)
    count, degree = neighbours.shape
    own = unit(rows)
    room = int(np.ceil(slack * count / parts))
    centres = own[rng.choice(count, parts, replace=False)]
    for _ in range(6):
        labels = balanced(own @ centres.T, room)
        sums = np.zeros((parts, own.shape[1]), np.float32)
        np.add.at(sums, labels, own)
        centres = unit(sums)
    ends = np.repeat(np.arange(count), degree), neighbours.ravel()
    best, fewest = labels, np.inf
    for _ in range(rounds):
        cut = int((labels[ends[0]] != labels[ends[1]]).sum())
        if cut < fewest:
            best, fewest = labels, cut
        votes = np.zeros((count, parts), np.float32)
        for a, b in (ends, ends[::-1]):
            votes += np.bincount(a * parts + labels[b], minlength=count * parts).reshape(count, parts)
        votes[np.arange(count), labels] += np.where(rng.random(count) < 0.5, 0.5, 1e6)  # these stay
        labels = balanced(votes, room)
    return best


def learn(
    rows: np.ndarray, neighbours: np.ndarray, parts: int, recall: float, hidden: int = 128, epochs: int = 24, seed: int = 7,
) -> Router:
    """A router for ``parts`` partitions of the rows' neighbour graph.

    The network learns, from seven eighths of the rows, the shares of the partitions among a row's
    neighbours. The other eighth sets ``mass``: so much that their visits find ``recall`` of their
    neighbours where the router itself stores them, plus two standard errors of that share."""
    rng = np.random.default_rng(seed)
    own, (count, degree) = unit(rows), neighbours.shape
    labels = split(rows, neighbours, parts, seed=seed)
    shares = np.zeros((count, parts), np.float32)
    np.add.at(shares, (np.repeat(np.arange(count), degree), labels[neighbours].ravel()), 1 / degree)
    held = rng.permutation(count) < count // 8
    train = np.flatnonzero(~held)

    entries = own.shape[1]
    weights = [
        (rng.standard_normal((entries, hidden)) * np.sqrt(2)).astype(np.float32), np.zeros(hidden, np.float32),
        (rng.standard_normal((hidden, parts)) * 0.1 / np.sqrt(hidden)).astype(np.float32), np.zeros(parts, np.float32),
    ]
    means, squares = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    size, step = 256, 0
    steps = epochs * max(1, len(train) // size)
    for _ in range(epochs):
        order = rng.permutation(train)
        for first in range(0, len(order) - size + 1 if len(order) >= size else 1, size):
            at = order[first:first + size]
            inner = np.maximum(own[at] @ weights[0] + weights[1], 0)
            off = (_softmax(inner @ weights[2] + weights[3]) - shares[at]) / len(at)
            back = (off @ weights[2].T) * (inner > 0)
            grads = [own[at].T @ back, back.sum(axis=0), inner.T @ off, off.sum(axis=0)]
            step += 1
            rate = 3e-3 * (1 - step / (steps + 1))
            for w, g, m, v in zip(weights, grads, means, squares):
                g = g + 1e-5 * w
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                w -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
    router = Router(*weights, mass=1.0)
    found = router.probabilities(rows)
    homes = found.argmax(axis=1)
    test = np.flatnonzero(held)
    if not len(test):
        return router
    sorted_ = -np.sort(-found[test], axis=1)
    place = np.argsort(np.argsort(-found[test], axis=1, kind="stable"), axis=1)
    before = np.cumsum(sorted_, axis=1) - sorted_
    needed = np.sort(np.take_along_axis(before, np.take_along_axis(place, homes[neighbours[test]], axis=1), axis=1).ravel())
    safe = min(1.0, recall + 2 * np.sqrt(recall * (1 - recall) / len(needed)))
    mass = needed[min(len(needed) - 1, int(np.ceil(safe * len(needed))))]
    return Router(*weights, mass=float(np.nextafter(mass, 2)))
