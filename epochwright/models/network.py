"""A small classifier network in numpy: forward pass, weighted loss, gradient and Adam steps (ML2)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from epochwright.models.boosting import softmax

BETA1, BETA2, EPSILON = 0.9, 0.999, 1e-8


@dataclass(frozen=True)
class Shape:
    inputs: int
    hidden: int
    classes: int

    @property
    def size(self) -> int:
        return (self.inputs + 1) * self.hidden + (self.hidden + 1) * self.classes

    def parts(self, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The flat weights as (inputs x hidden), hidden, (hidden x classes), classes; views."""
        a, b = self.inputs * self.hidden, (self.inputs + 1) * self.hidden
        c = b + self.hidden * self.classes
        return (
            flat[:a].reshape(self.inputs, self.hidden),
            flat[a:b],
            flat[b:c].reshape(self.hidden, self.classes),
            flat[c:],
        )

    def start(self, seed: int) -> np.ndarray:
        """Random weights scaled to each layer's inputs, no offsets."""
        rng, flat = np.random.default_rng(seed), np.zeros(self.size)
        w1, _, w2, _ = self.parts(flat)
        w1[:] = rng.normal(0, (2 / self.inputs) ** 0.5, w1.shape)
        w2[:] = rng.normal(0, (2 / self.hidden) ** 0.5, w2.shape)
        return flat

    def proba(self, flat: np.ndarray, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.parts(flat)
        return softmax(np.maximum(x @ w1 + b1, 0) @ w2 + b2)

    def gradient(self, flat: np.ndarray, x: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray]:
        """Mean weighted cross-entropy of a batch, and its derivative by every weight."""
        w1, b1, w2, b2 = self.parts(flat)
        inner = x @ w1 + b1
        out = np.maximum(inner, 0)
        p = softmax(out @ w2 + b2)
        rows, n = np.arange(len(x)), len(x)
        loss = float(-(weight * np.log(np.maximum(p[rows, label], 1e-300))).sum() / n)
        back = p * (weight / n)[:, None]
        back[rows, label] -= weight / n
        through = (back @ w2.T) * (inner > 0)
        parts = (x.T @ through, through.sum(axis=0), out.T @ back, back.sum(axis=0))
        return loss, np.concatenate([part.ravel() for part in parts])


@dataclass
class Adam:
    """Weights with their running moments and the number of steps taken."""

    weights: np.ndarray
    mean: np.ndarray
    square: np.ndarray
    steps: float = 0.0

    @classmethod
    def at(cls, weights: np.ndarray) -> "Adam":
        return cls(weights.copy(), np.zeros_like(weights), np.zeros_like(weights))

    def step(self, gradient: np.ndarray, rate: float) -> None:
        self.steps += 1
        self.mean = BETA1 * self.mean + (1 - BETA1) * gradient
        self.square = BETA2 * self.square + (1 - BETA2) * gradient**2
        mean = self.mean / (1 - BETA1**self.steps)
        square = self.square / (1 - BETA2**self.steps)
        self.weights = self.weights - rate * mean / (np.sqrt(square) + EPSILON)
