"""Reverse-mode differentiation of dense arrays on the driver, for models small enough to fit there.

A ``Tensor`` remembers what it was made of; ``backward`` walks the graph once in reverse topological order and
adds up gradients, summing over axes that were broadcast.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


def _shrink(g: np.ndarray, shape: tuple[int, ...]) -> np.ndarray:
    """A gradient summed down to the shape of the operand that was broadcast."""
    while g.ndim > len(shape):
        g = g.sum(0)
    for k, n in enumerate(shape):
        if n == 1 and g.shape[k] != 1:
            g = g.sum(k, keepdims=True)
    return g


class Tensor:
    def __init__(self, value, parents: tuple[tuple[Tensor, Callable[[np.ndarray], np.ndarray]], ...] = ()):
        self.value = np.asarray(value, float)
        self.parents = parents
        self.grad = np.zeros_like(self.value)

    @staticmethod
    def of(x) -> Tensor:
        return x if isinstance(x, Tensor) else Tensor(x)

    def __add__(self, o):
        o = Tensor.of(o)
        return Tensor(self.value + o.value, ((self, lambda g: g), (o, lambda g: g)))

    __radd__ = __add__

    def __neg__(self):
        return Tensor(-self.value, ((self, lambda g: -g),))

    def __sub__(self, o):
        return self + -Tensor.of(o)

    def __rsub__(self, o):
        return Tensor.of(o) + -self

    def __mul__(self, o):
        o = Tensor.of(o)
        return Tensor(self.value * o.value, ((self, lambda g: g * o.value), (o, lambda g: g * self.value)))

    __rmul__ = __mul__

    def __matmul__(self, o):
        o = Tensor.of(o)
        return Tensor(self.value @ o.value, ((self, lambda g: g @ o.value.T), (o, lambda g: self.value.T @ g)))

    def sum(self):
        return Tensor(self.value.sum(), ((self, lambda g: np.broadcast_to(g, self.value.shape)),))

    def mean(self):
        return self.sum() * (1.0 / self.value.size)

    def _map(self, value: np.ndarray, slope: np.ndarray) -> Tensor:
        return Tensor(value, ((self, lambda g: g * slope),))

    def relu(self):
        return self._map(np.maximum(self.value, 0), (self.value > 0).astype(float))

    def sigmoid(self):
        s = 1 / (1 + np.exp(-self.value))
        return self._map(s, s * (1 - s))

    def tanh(self):
        t = np.tanh(self.value)
        return self._map(t, 1 - t * t)

    def exp(self):
        e = np.exp(self.value)
        return self._map(e, e)

    def log(self):
        return self._map(np.log(self.value), 1 / self.value)

    def conv2d(self, kernel: Tensor) -> Tensor:
        """Valid cross-correlation of (height, width) with a smaller kernel."""
        k = Tensor.of(kernel)
        h, w = k.value.shape
        windows = np.lib.stride_tricks.sliding_window_view(self.value, (h, w))

        def back(g: np.ndarray) -> np.ndarray:
            out = np.zeros_like(self.value)
            for i in range(h):
                for j in range(w):
                    out[i : i + g.shape[0], j : j + g.shape[1]] += g * k.value[i, j]
            return out

        return Tensor(np.einsum("abij,ij->ab", windows, k.value), ((self, back), (k, lambda g: np.einsum("abij,ab->ij", windows, g))))

    def backward(self) -> None:
        """Gradients of this value (its sum, if it isn't a number) for all it was made of."""
        order, seen, stack = [], set(), [(self, False)]
        while stack:
            t, done = stack.pop()
            if done:
                order.append(t)
            elif id(t) not in seen:
                seen.add(id(t))
                stack.append((t, True))
                stack += [(p, False) for p, _ in t.parents]
        for t in order:
            t.grad = np.zeros_like(t.value)
        self.grad = np.ones_like(self.value)
        for t in reversed(order):
            for p, f in t.parents:
                p.grad = p.grad + _shrink(f(t.grad), p.value.shape)
