"""A linear-chain conditional random field over discrete token shapes, in numpy.

The score of a labelling is the sum of W[offset, shape of the token at that offset, label] over a window of
offsets and of T[label, next label]. Label 0 is "outside".
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

REACH = 3  # tokens to each side that a token's score looks at
STEPS, RATE = 80, 0.2
DECAY, FARTHER, LINKS = 0.002, 1.0, 0.1  # of W at offset 0, of W for each token of distance, and of T; a token itself counts most


@dataclass
class Model:
    w: np.ndarray  # (2 * REACH + 1, shapes + 1, labels); the last shape stands for what is beyond a text
    t: np.ndarray  # (labels, labels)

    def decode(self, shapes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Labels of the stretches start..end, one behind the other, each the best path with outside before and after it."""
        size = end - start
        first = np.cumsum(size) - size
        at = np.arange(int(size.sum())) + np.repeat(start - first, size)
        padded = np.concatenate((np.full(REACH, self.w.shape[1] - 1), shapes, np.full(REACH, self.w.shape[1] - 1)))
        e = sum(w.astype(np.float32)[padded[at + i]] for i, w in enumerate(self.w))
        labels = np.zeros(len(at), np.int8)
        if len(at):
            viterbi(e, self.t.astype(np.float32), first, first + size, labels)
        return labels


def viterbi(e: np.ndarray, t: np.ndarray, start: np.ndarray, end: np.ndarray, labels: np.ndarray) -> None:
    """Writes the best labels of stretches start..end, each with outside before and after it. Longer stretches come first, so that those still running are a prefix."""
    order = np.argsort(start - end, kind="stable")
    start, size = start[order], (end - start)[order]
    best = t[0] + e[start]
    back = []
    for step in range(1, int(size[0])):
        n = int(np.searchsorted(-size, -step))  # stretches longer than step
        through = best[:n, :, None] + t
        back.append(through.argmax(axis=1).astype(np.int8))
        best[:n] = np.take_along_axis(through, back[-1][:, None, :].astype(np.intp), axis=1)[:, 0] + e[start[:n] + step]
    at = (best + t[:, 0]).argmax(axis=1)
    for step in range(int(size[0]) - 1, -1, -1):
        n = int(np.searchsorted(-size, -step))
        labels[start[:n] + step] = at[:n]
        if step:
            at[:n] = back[step - 1][np.arange(n), at[:n]]


def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def fit(sequences: list[tuple[np.ndarray, np.ndarray]], shapes: int, labels: int, steps: int = STEPS) -> Model:
    """Maximum likelihood with weight decay on (shapes, labels) of each text, by full-batch Adam; the same rows give the same model."""
    n, longest = len(sequences), max(len(s) for s, _ in sequences)
    x = np.full((n, longest + 2 * REACH), shapes)
    y = np.zeros((n, longest), int)
    size = np.array([len(s) for s, _ in sequences])
    for i, (s, l) in enumerate(sequences):
        x[i, REACH : REACH + len(s)] = s
        y[i, : len(l)] = l
    real = np.arange(longest) < size[:, None]
    linked = real[:, 1:]
    flat = [np.where(real, x[:, o : o + longest], shapes + 1).ravel() for o in range(2 * REACH + 1)]
    one = np.eye(labels)[y] * real[:, :, None]
    pairs = np.zeros((labels, labels))
    np.add.at(pairs, (y[:, :-1][linked], y[:, 1:][linked]), 1)
    model = Model(np.zeros((2 * REACH + 1, shapes + 1, labels)), np.zeros((labels, labels)))
    far = np.abs(np.arange(2 * REACH + 1) - REACH)
    decays = (DECAY + FARTHER * far)[:, None, None], LINKS
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (model.w, model.t)]
    for step in range(1, steps + 1):
        e = np.zeros((n, longest, labels))
        for o in range(2 * REACH + 1):
            e += model.w[o][x[:, o : o + longest]]
        a, b = np.zeros_like(e), np.zeros_like(e)
        a[:, 0] = e[:, 0]
        for i in range(1, longest):
            a[:, i] = np.where(real[:, i, None], log_sum(a[:, i - 1, :, None] + model.t, 1) + e[:, i], a[:, i - 1])
        for i in range(longest - 2, -1, -1):
            b[:, i] = np.where(real[:, i + 1, None], log_sum(model.t + (e[:, i + 1] + b[:, i + 1])[:, None, :], 2), 0)
        z = log_sum(a[:, -1], 1)[:, None, None]
        lost = (np.exp(a + b - z) * real[:, :, None] - one).reshape(-1, labels)
        two = np.exp(a[:, :-1, :, None] + model.t + (e + b)[:, 1:, None, :] - z[:, :, :, None]) * linked[:, :, None, None]
        grad_w = np.stack([np.stack([np.bincount(f, lost[:, k], shapes + 2)[: shapes + 1] for k in range(labels)], axis=1) for f in flat])
        for p, g, (m, v), decay in zip((model.w, model.t), (grad_w, two.sum(axis=(0, 1)) - pairs), moments, decays):
            g = g + decay * p
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return model
