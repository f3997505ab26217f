"""A linear model over hashed word and character n-grams, with calibrated probabilities.

The features of a text are which of 2**20 hash cells its lower-cased word n-grams (one and two words, punctuation at their ends
removed) and character n-grams (three and five characters) fall into. Training looks at a bounded sample: cells that differ clearly
between the classes are kept, and a logistic regression is fitted on them. A quarter of the sample is held out; on it the
scores are calibrated (a logistic curve over the score).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from pullscan.llm.common import window_hashes, word_hashes

BITS = 20
MARKS = b".,;:!?\"'()[]"
CHAR_SIZES = (3, 5)
CHAR_FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1], np.uint32)


def plain_words(text: bytes) -> list[bytes]:
    return [w for w in (x.strip(MARKS) for x in text.decode().lower().encode().split()) if w]


def cells(text: bytes) -> list[np.ndarray]:
    """The hash cell of each n-gram, one array per kind; cells can repeat."""
    low = text.decode().lower()
    words = [w for w in (x.strip(MARKS) for x in low.encode().split()) if w]
    own = word_hashes(words)
    out = [(own >> np.uint64(64 - BITS)).astype(np.uint32), (window_hashes(own, 2) >> np.uint64(64 - BITS)).astype(np.uint32)]
    chars = np.frombuffer(f" {low} ".encode("utf-32-le"), np.uint32)
    for size in CHAR_SIZES:
        n = len(chars) - size + 1
        if n > 0:
            h = np.full(n, size, np.uint32)
            for k in range(size):
                h += chars[k : k + n] * CHAR_FACTORS[k]
            h ^= h >> np.uint32(15)
            h *= np.uint32(0x2C1B3C6D)
            out.append(h >> np.uint32(32 - BITS))
    return out


@dataclass
class Model:
    place: np.ndarray  # of each cell in weights, or -1
    weights: np.ndarray
    bias: float
    scale: float
    shift: float
    held_out_accuracy: float

    def probability(self, text: bytes) -> float:
        found = [self.place.take(c) for c in cells(text)]
        at = np.unique(np.concatenate([x[x >= 0] for x in found]))
        z = self.scale * (self.bias + float(self.weights[at].sum())) + self.shift
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def _fit(x: np.ndarray, y: np.ndarray, w: np.ndarray, l2: float, steps: int) -> tuple[np.ndarray, float]:
    """Weighted logistic regression by full-batch Adam."""
    a, b = np.zeros(x.shape[1], np.float32), 0.0
    m, v, mb, vb = np.zeros_like(a), np.zeros_like(a), 0.0, 0.0
    for i in range(1, steps + 1):
        e = (w * (1 / (1 + np.exp(-np.clip(x @ a + b, -40, 40))) - y)).astype(np.float32)
        g, gb = x.T @ e + l2 * a, float(e.sum())
        m, mb = 0.9 * m + 0.1 * g, 0.9 * mb + 0.1 * gb
        v, vb = 0.99 * v + 0.01 * g * g, 0.99 * vb + 0.01 * gb * gb
        rate = 0.05 / (1 + i / 200)
        a = a - rate * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.99**i)) + 1e-8)
        b -= rate * (mb / (1 - 0.9**i)) / (vb / (1 - 0.99**i) + 1e-16) ** 0.5
    return a, b


def train(texts: list[bytes], target: np.ndarray, weight: np.ndarray, most_cells: int = 3000, least_z: float = 5.0, l2: float = 3e-4, steps: int = 250) -> Model | None:
    """``target`` is the probability of the good class, hard or soft; None without samples of both classes.

    ``weight`` says how many rows a sampled one stands for. The calibration uses it as it is, the fit its square root, so that
    rare classes are learnt as well.
    """
    y, w = np.asarray(target, np.float64), np.asarray(weight, np.float64)
    if not len(y) or y.max() < 0.5 or y.min() >= 0.5:
        return None
    w = w / w.sum()
    own, ends = bytearray(), [0]  # one block of memory, which goes back whole
    for t in texts:
        own += np.unique(np.concatenate(cells(t))).astype(np.uint32).tobytes()
        ends.append(len(own) // 4)
    own = np.frombuffer(own, np.uint32)
    held = np.arange(len(y)) % 4 == 3 if len(y) >= 40 else np.zeros(len(y), bool)
    fit = ~held
    good, bad = np.zeros(1 << BITS), np.zeros(1 << BITS)
    for i in np.flatnonzero(fit):
        c = own[ends[i] : ends[i + 1]]
        good[c] += y[i]
        bad[c] += 1 - y[i]
    n1, n0 = y[fit].sum(), (1 - y[fit]).sum()
    p = (good + bad) / max(1.0, n1 + n0)
    z = (good / max(n1, 1e-9) - bad / max(n0, 1e-9)) / np.sqrt(p * (1 - p) * (1 / max(n1, 1e-9) + 1 / max(n0, 1e-9)) + 1e-12)
    z[(good + bad) < 4] = 0
    kept = np.argsort(-np.abs(z), kind="stable")[:most_cells]
    kept = kept[np.abs(z[kept]) >= least_z] if (np.abs(z) >= least_z).any() else kept[:64]
    place = np.full(1 << BITS, -1, np.int16)
    place[kept] = np.arange(len(kept))

    def features(which: np.ndarray) -> np.ndarray:
        x = np.zeros((int(which.sum()), len(kept)), np.float32)
        for row, i in enumerate(np.flatnonzero(which)):
            at = place[own[ends[i] : ends[i + 1]]]
            x[row, at[at >= 0]] = 1
        return x

    r = np.sqrt(w[fit])
    a, b = _fit(features(fit), y[fit], r / r.sum(), l2, steps)
    if held.any() and 0 < (y[held] >= 0.5).sum() < held.sum():
        s = (features(held) @ a + b)[:, None].astype(np.float32)
        scale, shift = _fit(s / max(1e-6, s.std()), y[held], w[held] / w[held].sum(), 1e-3, 600)
        scale = float(scale[0]) / max(1e-6, float(s.std()))
        if scale > 0:
            right = (1 / (1 + np.exp(-np.clip(scale * s[:, 0] + shift, -40, 40))) >= 0.5) == (y[held] >= 0.5)
            return Model(place, a, b, scale, shift, float((w[held] * right).sum() / w[held].sum()))
    right = (features(np.ones(len(y), bool)) @ a + b >= 0) == (y >= 0.5)
    return Model(place, a, b, 1.0, 0.0, float((w * right).sum() / w.sum()))

