"""Reverse-mode differentiation over numpy arrays: what the learned estimators are trained with."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


def _fit(slope: np.ndarray, shape: tuple[int, ...]) -> np.ndarray:
    """Sum over what broadcasting repeated."""
    while slope.ndim > len(shape):
        slope = slope.sum(0)
    for axis, size in enumerate(shape):
        if size == 1 and slope.shape[axis] != 1:
            slope = slope.sum(axis, keepdims=True)
    return slope


class Node:
    __slots__ = ("back", "parents", "slope", "value")

    def __init__(self, value, parents: tuple = (), back: Callable | None = None):
        self.value = np.asarray(value, np.float64)
        self.parents, self.back = parents, back
        self.slope: np.ndarray | None = None

    def _with(self, other) -> Node:
        return other if isinstance(other, Node) else Node(other)

    def __add__(self, other) -> Node:
        o = self._with(other)
        return Node(self.value + o.value, (self, o), lambda g: (_fit(g, self.value.shape), _fit(g, o.value.shape)))

    def __mul__(self, other) -> Node:
        o = self._with(other)
        return Node(self.value * o.value, (self, o), lambda g: (_fit(g * o.value, self.value.shape), _fit(g * self.value, o.value.shape)))

    __radd__, __rmul__ = __add__, __mul__

    def __neg__(self) -> Node:
        return self * -1.0

    def __sub__(self, other) -> Node:
        return self + -self._with(other)

    def __rsub__(self, other) -> Node:
        return self._with(other) - self

    def __matmul__(self, other: Node) -> Node:
        return Node(self.value @ other.value, (self, other), lambda g: (g @ other.value.T, self.value.reshape(-1, self.value.shape[-1]).T @ g.reshape(-1, g.shape[-1])))

    def __getitem__(self, at) -> Node:
        def back(g):
            out = np.zeros_like(self.value)
            np.add.at(out, at, g)
            return (out,)

        return Node(self.value[at], (self,), back)

    def _map(self, value: np.ndarray, by: np.ndarray) -> Node:
        return Node(value, (self,), lambda g: (g * by,))

    def tanh(self) -> Node:
        t = np.tanh(self.value)
        return self._map(t, 1 - t * t)

    def sigmoid(self) -> Node:
        s = 1 / (1 + np.exp(-np.clip(self.value, -60, 60)))
        return self._map(s, s * (1 - s))

    def leaky(self, slope: float = 0.01) -> Node:
        by = np.where(self.value > 0, 1.0, slope)
        return self._map(self.value * by, by)

    def relu(self) -> Node:
        return self.leaky(0.0)

    def softplus(self) -> Node:
        return self._map(np.logaddexp(0, self.value), 1 / (1 + np.exp(-np.clip(self.value, -60, 60))))

    def exp(self) -> Node:
        e = np.exp(np.clip(self.value, -60, 60))
        return self._map(e, e)

    def log1p(self) -> Node:
        return self._map(np.log1p(self.value), 1 / (1 + self.value))

    def square(self) -> Node:
        return self._map(self.value**2, 2 * self.value)

    def absolute(self) -> Node:
        return self._map(np.abs(self.value), np.sign(self.value))

    def sum(self, axis=None) -> Node:
        return Node(self.value.sum(axis), (self,), lambda g: (np.broadcast_to(g if axis is None else np.expand_dims(g, axis), self.value.shape),))

    def mean(self, axis=None) -> Node:
        n = self.value.size if axis is None else self.value.shape[axis]
        return self.sum(axis) * (1.0 / n)

    def cumsum(self, axis: int = -1) -> Node:
        return Node(self.value.cumsum(axis), (self,), lambda g: (np.flip(np.flip(g, axis).cumsum(axis), axis),))

    def reshape(self, *shape: int) -> Node:
        return Node(self.value.reshape(*shape), (self,), lambda g: (g.reshape(self.value.shape),))

    def backward(self) -> None:
        order, seen, stack = [], set(), [(self, False)]
        while stack:
            node, done = stack.pop()
            if done:
                order.append(node)
            elif id(node) not in seen:
                seen.add(id(node))
                stack.append((node, True))
                stack.extend((p, False) for p in node.parents)
        for node in order:
            node.slope = None
        self.slope = np.ones_like(self.value)
        for node in reversed(order):
            if node.back and node.slope is not None:
                for parent, g in zip(node.parents, node.back(node.slope), strict=True):
                    parent.slope = g if parent.slope is None else parent.slope + g


def joined(nodes: list[Node], axis: int = -1) -> Node:
    sizes = np.cumsum([n.value.shape[axis] for n in nodes])[:-1]
    return Node(np.concatenate([n.value for n in nodes], axis), tuple(nodes), lambda g: tuple(np.split(g, sizes, axis)))


class Parameters(dict):
    """Named weights, with Adam and gradients clipped by value."""

    def __init__(self, seed: int = 0):
        super().__init__()
        self.random, self.moments, self.steps = np.random.default_rng(seed), {}, 0

    def weight(self, name: str, *shape: int, scale: float | None = None) -> Node:
        if name not in self:
            self[name] = Node(self.random.normal(0, scale or (1 / shape[0]) ** 0.5, shape))
        return self[name]

    def dense(self, name: str, x: Node, size: int) -> Node:
        return x @ self.weight(name, x.value.shape[-1], size) + self.weight(f"{name}.bias", size, scale=1e-3)

    def step(self, loss: Node, rate: float = 3e-3, limit: float = 1.0) -> float:
        loss.backward()
        self.steps += 1
        for name, node in self.items():
            if node.slope is None:
                continue
            g = np.clip(node.slope, -limit, limit)
            m, v = self.moments.get(name, (0.0, 0.0))
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            self.moments[name] = m, v
            node.value = node.value - rate * (m / (1 - 0.9**self.steps)) / (np.sqrt(v / (1 - 0.999**self.steps)) + 1e-8)
        return float(loss.value)

    def copy_values(self) -> dict[str, np.ndarray]:
        return {k: n.value.copy() for k, n in self.items()}

    def restore(self, values: dict[str, np.ndarray]) -> None:
        for k, v in values.items():
            self[k].value = v
