"""Weighted acyclic automata over whole numbers: minimal transducers from sorted paths to counts."""

from __future__ import annotations

import pickle
import sys
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark import cloudpickle

# Tasks get the code with the plan, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _small(values: np.ndarray) -> np.ndarray:
    top = int(values.max()) if len(values) else 0
    return values.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64)


def runs(ends: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For every run, given by its end and size in one array, the places it covers, run after run."""
    total = np.cumsum(sizes)
    return np.arange(total[-1] if len(total) else 0) - np.repeat(total - ends, sizes)


def _registered(first: np.ndarray, arcs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The class of every state, and the classes' arc counts and arcs; states with equal arcs are one.

    State ``i`` has the arcs from ``first[i]`` to ``first[i + 1]``, label and target in one number.
    Chains, which most states are, are told apart at once; the others are looked up in a register.
    """
    sizes = np.diff(first)
    of = np.empty(len(sizes), np.int64)
    single = np.flatnonzero(sizes == 1)
    chains, of[single] = np.unique(arcs[first[single]], return_inverse=True)
    register: dict[bytes, int] = {}
    kept, n = [], len(chains)
    for state in np.flatnonzero(sizes != 1).tolist():
        part = arcs[first[state] : first[state + 1]]
        at = register.setdefault(part.tobytes(), n)
        if at == n:
            kept.append(part)
            n += 1
        of[state] = at
    counts = np.array([1] * len(chains) + [len(p) for p in kept], np.int64)
    return of, counts, np.concatenate([chains, *kept])


@dataclass
class Automaton:
    """Paths of one fixed length, each with a count: layers of states, equal ones shared.

    ``layers`` holds, from the root on, the arc counts of the states, and of all their arcs in
    order the labels (numbers of ``alphabet``) and targets; those of the last layer are numbers of
    ``weights``. Shorter paths are filled with a label that ends them.
    """

    alphabet: np.ndarray
    weights: np.ndarray
    layers: list[tuple[np.ndarray, np.ndarray, np.ndarray]]

    @classmethod
    def of(cls, paths: np.ndarray, weights: np.ndarray) -> Automaton:
        """From distinct paths in ascending order, one a row; a state is closed once its prefix is past."""
        alphabet, flat = np.unique(paths, return_inverse=True)
        coded = flat.reshape(paths.shape).astype(np.uint64)
        values, target = np.unique(weights, return_inverse=True)
        new = np.empty(paths.shape, bool)
        new[:1] = True
        new[1:] = np.logical_or.accumulate(coded[1:] != coded[:-1], axis=1)
        layers = []
        rows = np.arange(len(paths))
        for depth in range(paths.shape[1] - 1, -1, -1):
            arcs = (coded[rows, depth] << np.uint64(32)) | target.astype(np.uint64)
            # the states here are the distinct prefixes one label shorter
            opens = np.flatnonzero(new[rows, depth - 1]) if depth else np.arange(min(len(rows), 1))
            first = np.append(opens, len(rows))
            target, counts, kept = _registered(first, arcs)
            layers.append((counts, (kept >> np.uint64(32)).astype(np.int64), (kept & np.uint64(0xFFFFFFFF)).astype(np.int64)))
            rows = rows[opens]
        return cls(alphabet, values, layers[::-1])

    def paths(self) -> tuple[np.ndarray, np.ndarray]:
        """All paths in ascending order, and their counts."""
        made = np.empty((1, 0), np.int64)
        state = np.zeros(1 if len(self.weights) else 0, np.int64)
        made = made[: len(state)]
        for counts, labels, targets in self.layers:
            ends = np.cumsum(counts)
            sizes = counts[state]
            arc = runs(ends[state], sizes)
            made = np.column_stack([np.repeat(made, sizes, axis=0), self.alphabet[labels[arc]]])
            state = targets[arc]
        return made, self.weights[state]

    def look_up(self, paths: np.ndarray) -> np.ndarray:
        """The counts of ``paths``, 0 where there is none: all are followed at once, arc by arc."""
        if not len(self.weights):
            return np.zeros(len(paths), np.int64)
        label = np.searchsorted(self.alphabet, paths).clip(max=len(self.alphabet) - 1)
        alive = (self.alphabet[label] == paths).all(axis=1)
        state = np.zeros(len(paths), np.int64)
        for depth, (counts, labels, targets) in enumerate(self.layers):
            owner = np.repeat(np.arange(len(counts)), counts)
            keys = (owner << 32) | labels
            sought = (state << 32) | label[:, depth]
            at = np.searchsorted(keys, sought).clip(max=len(keys) - 1)
            alive &= keys[at] == sought
            state = np.where(alive, targets[at], 0)
        return np.where(alive, self.weights[state], 0)

    def dump(self) -> bytes:
        parts = [_small(self.alphabet), _small(self.weights), *[_small(a) for layer in self.layers for a in layer]]
        return zlib.compress(pickle.dumps(parts, 5), 1)

    @classmethod
    def load(cls, data: bytes) -> Automaton:
        alphabet, weights, *rest = [a.astype(np.int64) for a in pickle.loads(zlib.decompress(data))]
        return cls(alphabet, weights, [tuple(rest[i : i + 3]) for i in range(0, len(rest), 3)])


def summed(paths: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct paths in ascending order with the sums of their weights."""
    if not len(paths):
        return paths, weights
    order = np.lexsort(paths.T[::-1])
    paths, weights = paths[order], weights[order]
    new = np.flatnonzero(np.append(True, (paths[1:] != paths[:-1]).any(axis=1)))
    return paths[new], np.add.reduceat(weights, new)


def united(automata: list[Automaton]) -> tuple[np.ndarray, np.ndarray]:
    """The paths of the union, their counts added."""
    parts = [a.paths() for a in automata]
    return summed(np.concatenate([p for p, _ in parts]), np.concatenate([w for _, w in parts]))
