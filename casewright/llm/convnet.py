"""A small convolutional network over integer ids, trained in numpy.

Embedding, filters of several widths, ReLU, max pooling over all places, and softmax heads on the
pooled features. An item's embedding is the sum of the embeddings of its one or more ids (a word and
its stem, say). Embedding and filters fold into one table of numbers for each id, so applying the
network to a sequence is table look-ups, shifted additions and a running maximum.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class ConvNet:
    embedding: np.ndarray  # (ids, dim); row pad is zero
    filters: list[np.ndarray]  # for each width: (width, dim, filters)
    bias: np.ndarray  # (filters of all widths,)
    heads: list[tuple[np.ndarray, np.ndarray]]  # (features, classes), (classes,)
    pad: int

    @classmethod
    def fresh(cls, ids: int, dim: int, widths: tuple[int, ...], filters: int, classes: list[int], pad: int, seed: int, spread: float = 0.3) -> ConvNet:
        """spread: of the first embeddings; small where most ids will never be learned, so that these stay silent."""
        rng = np.random.default_rng(seed)
        embedding = rng.normal(0, spread, (ids, dim)).astype(np.float32)
        embedding[pad] = 0
        kernels = [rng.normal(0, (w * dim) ** -0.5, (w, dim, filters)).astype(np.float32) for w in widths]
        n = filters * len(widths)
        return cls(embedding, kernels, np.zeros(n, np.float32), [(rng.normal(0, n**-0.5, (n, c)).astype(np.float32), np.zeros(c, np.float32)) for c in classes], pad)

    @property
    def widths(self) -> list[int]:
        return [len(k) for k in self.filters]

    def tables(self) -> list[list[np.ndarray]]:
        """For each width and place within it, what every id adds to the filters."""
        return [[np.ascontiguousarray(self.embedding @ k[j]) for j in range(len(k))] for k in self.filters]

    def parameters(self) -> list[np.ndarray]:
        return [self.embedding, *self.filters, self.bias, *(x for h in self.heads for x in h)]


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


class _Adam:
    def __init__(self, values: list[np.ndarray], rate: float) -> None:
        self.values, self.rate, self.t = values, rate, 0
        self.m = [np.zeros_like(v) for v in values]
        self.v = [np.zeros_like(v) for v in values]

    def step(self, grads: list[np.ndarray], rows: np.ndarray) -> None:
        """grads[0] belongs to these rows of the first value only; its other rows stay as they are."""
        self.t += 1
        scale = self.rate * (1 - 0.999**self.t) ** 0.5 / (1 - 0.9**self.t)
        for i, (x, g, m, v) in enumerate(zip(self.values, grads, self.m, self.v, strict=True)):
            at = rows if i == 0 else slice(None)
            m[at] += 0.1 * (g - m[at])
            v[at] += 0.001 * (g * g - v[at])
            x[at] -= scale * m[at] / (np.sqrt(v[at]) + 1e-7)


def gradients(net: ConvNet, sequences: list[np.ndarray], targets: list[np.ndarray], weights: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """Gradients of the mean weighted cross entropy of a batch, in the order of parameters(); the first belongs to the embedding
    rows that come second.

    Only the place that wins the pooling gets a gradient, so a backward step touches as many embeddings
    as there are filters."""
    n_filters, n = net.filters[0].shape[2], len(sequences)
    grads = [np.zeros_like(p) for p in net.parameters()[1:]]
    grads.insert(0, None)
    touched, parts = [], []
    pooled = np.empty((n, len(net.bias)), net.bias.dtype)
    wins = np.empty((n, len(net.bias)), np.int64)
    embedded = []
    most = max(net.widths)
    for r, seq in enumerate(sequences):
        e = np.zeros((max(len(seq), 1) + most - 1, net.embedding.shape[1]), net.embedding.dtype)
        e[: len(seq)] = net.embedding[seq].sum(axis=1) if len(seq) else 0
        embedded.append(e)
        for k, kernel in enumerate(net.filters):
            places = len(e) - most + 1
            out = sum(e[j : j + places] @ kernel[j] for j in range(len(kernel)))
            own = slice(k * n_filters, (k + 1) * n_filters)
            wins[r, own] = out.argmax(axis=0)
            pooled[r, own] = out.max(axis=0)
    features = np.maximum(pooled + net.bias, 0)
    back = np.zeros_like(features)
    for h, (w, b) in enumerate(net.heads):
        p = softmax(features @ w + b)
        p[np.arange(n), targets[h]] -= 1
        p *= (weights[h] / n)[:, None]
        head = 2 + len(net.filters) + 2 * h
        grads[head] += features.T @ p
        grads[head + 1] += p.sum(axis=0)
        back += p @ w.T
    back *= features > 0
    grads[1 + len(net.filters)] += back.sum(axis=0)
    for r, seq in enumerate(sequences):
        e = embedded[r]
        for k, kernel in enumerate(net.filters):
            own = slice(k * n_filters, (k + 1) * n_filters)
            g, place = back[r, own], wins[r, own]
            for j in range(len(kernel)):
                grads[1 + k][j] += e[place + j].T * g
                if len(seq):
                    there = place + j < len(seq)
                    ids = seq[place[there] + j]
                    if ids.size:
                        touched.append(ids.ravel())
                        parts.append(np.repeat((kernel[j][:, there] * g[there]).T, ids.shape[1], axis=0))
    ids, place = np.unique(np.concatenate(touched), return_inverse=True) if touched else (np.empty(0, np.int64), None)
    grads[0] = np.zeros((len(ids), net.embedding.shape[1]), net.embedding.dtype)
    if touched:
        np.add.at(grads[0], place, np.concatenate(parts))
    return grads, ids


def train(
    net: ConvNet,
    sequences: list[np.ndarray],
    targets: list[np.ndarray],
    weights: list[np.ndarray],
    epochs: int,
    batch: int,
    rate: float,
    seed: int,
) -> None:
    """Fit net in place. sequences: (items, ids an item) arrays; targets and weights: one array for each head."""
    rng = np.random.default_rng(seed)
    adam = _Adam(net.parameters(), rate)
    for _ in range(epochs):
        order = rng.permutation(len(sequences))
        for at in range(0, len(order), batch):
            rows = order[at : at + batch]
            adam.step(*gradients(net, [sequences[i] for i in rows], [t[rows] for t in targets], [w[rows] for w in weights]))
            net.embedding[net.pad] = 0


def pool_segments(tables: np.ndarray, widths: list[int], n_filters: int, ids: list[np.ndarray], starts: np.ndarray, pad: int, most: int = 1 << 16) -> np.ndarray:
    """Pooled filter values of segments of one long sequence, without bias and ReLU.

    tables: (ids, sum of widths * filters), an id's part for each width and place. ids: for each id of an
    item, the sequence's ids; every segment ends with max(widths) - 1 pads at least, at which no filter begins. starts: where segments begin.
    The sequence is worked off in stretches of about `most` items, so a very long segment needs no more memory."""
    total, tail = len(ids[0]), max(widths) - 1
    out = np.full((len(starts), n_filters * len(widths)), -np.inf, np.float32)
    for a in range(0, total, most):
        b = min(a + most, total)
        c = min(b + tail, total)
        rows = tables[ids[0][a:c]]
        for x in ids[1:]:
            rows += tables[x[a:c]]
        if c - b < tail:
            rows = np.concatenate([rows, np.zeros((tail - (c - b), rows.shape[1]), np.float32)])
        first = np.searchsorted(starts, a, side="right") - 1
        inside = starts[(starts > a) & (starts < b)] - a
        cuts = np.concatenate(([0], inside))
        at, blank = 0, np.flatnonzero(ids[0][a:b] == pad)
        for k, w in enumerate(widths):
            conv = rows[: b - a, at : at + n_filters].copy()
            for j in range(1, w):
                conv += rows[j : j + b - a, at + j * n_filters : at + (j + 1) * n_filters]
            at += w * n_filters
            conv[blank] = -np.inf
            best = np.maximum.reduceat(conv, cuts, axis=0)
            own = out[first : first + len(cuts), k * n_filters : (k + 1) * n_filters]
            np.maximum(own, best, out=own)
    return out
