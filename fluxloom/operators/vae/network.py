"""Fully connected network in numpy, used per Arrow batch inside tasks."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

# Fixed values of the batch normalisation.
BN_EPS, BN_MOMENTUM = 1e-5, 0.1


@dataclass
class Layer:
    """Weights (out x in) and bias; a hidden layer may also carry batch normalisation."""

    w: np.ndarray
    b: np.ndarray
    gamma: np.ndarray | None = None
    beta: np.ndarray | None = None
    run_mean: np.ndarray | None = None
    run_var: np.ndarray | None = None

    def params(self) -> list[np.ndarray]:
        return [self.w, self.b] + ([] if self.gamma is None else [self.gamma, self.beta])

    def stats(self) -> list[np.ndarray]:
        return [] if self.gamma is None else [self.run_mean, self.run_var]


def layer_sizes(n_in: int, n_out: int, n_lay: int) -> list[int]:
    """Sizes fall evenly from input to output."""
    return [round(s) for s in np.linspace(n_in, n_out, n_lay)]


def make_layers(n_in: int, n_out: int, n_lay: int, batch_norm: bool, rng: np.random.Generator) -> list[Layer]:
    """New layers, uniform within 1 / sqrt(fan in)."""
    sizes, layers = layer_sizes(n_in, n_out, n_lay), []
    for i, (a, b) in enumerate(zip(sizes, sizes[1:])):
        bound = 1.0 / np.sqrt(a)
        layer = Layer(rng.uniform(-bound, bound, (b, a)), rng.uniform(-bound, bound, b))
        if batch_norm and i < len(sizes) - 2:
            layer.gamma, layer.beta, layer.run_mean, layer.run_var = np.ones(b), np.zeros(b), np.zeros(b), np.ones(b)
        layers.append(layer)
    return layers


def forward(layers: list[Layer], x: np.ndarray, slope: float) -> np.ndarray:
    """Output with the running statistics and without dropout."""
    for i, layer in enumerate(layers):
        x = x @ layer.w.T + layer.b
        if i < len(layers) - 1:
            x = np.where(x > 0, x, slope * x)
            if layer.gamma is not None:
                x = (x - layer.run_mean) / np.sqrt(layer.run_var + BN_EPS) * layer.gamma + layer.beta
    return x


def train_forward(layers: list[Layer], x: np.ndarray, slope: float, dropout_p: float, keys: np.ndarray, salt: int):
    """Output and what `train_backward` needs, for some rows of a batch.

    A generator: at each batch normalisation it yields the sums of its rows (their number, and the values and squares about the running
    mean) and is sent those of the whole batch. What a row drops out depends on its key, layer and position only.
    """
    caches = []
    for i, layer in enumerate(layers):
        a = x @ layer.w.T + layer.b
        cache = {"x": x}
        if i < len(layers) - 1:
            cache["sign"] = sign = np.where(a > 0, 1.0, slope)
            a = a * sign
            if i and dropout_p:
                cache["mask"] = (uniforms(keys, a.shape[1], salt + i) >= dropout_p) / (1.0 - dropout_p)
                a = a * cache["mask"]
            if layer.gamma is not None:
                width, about = a.shape[1], a - layer.run_mean
                total = yield np.concatenate([[len(a)], about.sum(axis=0), (about**2).sum(axis=0)])
                n = total[0]
                shift = total[1:1 + width] / n
                var = np.maximum(total[1 + width:] / n - shift**2, 0.0)
                cache["scale"] = 1.0 / np.sqrt(var + BN_EPS)
                cache["hat"] = (about - shift) * cache["scale"]
                cache["mean"], cache["var"], cache["n"] = layer.run_mean + shift, var * (n / max(1.0, n - 1.0)), n
                a = cache["hat"] * layer.gamma + layer.beta
        caches.append(cache)
        x = a
    return x, caches


def train_backward(layers: list[Layer], caches: list[dict], grad: np.ndarray):
    """Gradients of the parameters (in ``params`` order) and of the input, from that of the output, for some rows of a batch.

    A generator: at each batch normalisation it yields two sums over its rows and is sent those of the whole batch.
    """
    grads: list[list[np.ndarray]] = []
    for layer, cache in zip(reversed(layers), reversed(caches)):
        extra: list[np.ndarray] = []
        if "sign" in cache:
            if layer.gamma is not None:
                hat, width = cache["hat"], len(layer.gamma)
                extra = [(grad * hat).sum(axis=0), grad.sum(axis=0)]
                g = grad * layer.gamma
                total = yield np.concatenate([g.sum(axis=0), (g * hat).sum(axis=0)])
                grad = cache["scale"] * (g - total[:width] / cache["n"] - hat * (total[width:] / cache["n"]))
            if "mask" in cache:
                grad = grad * cache["mask"]
            grad = grad * cache["sign"]
        grads.append([grad.T @ cache["x"], grad.sum(axis=0), *extra])
        grad = grad @ layer.w
    return [g for per_layer in reversed(grads) for g in per_layer], grad


def batch_stats(layers: list[Layer], caches: list[dict]) -> list[np.ndarray]:
    """Means and variances that the batch normalisations saw."""
    return [s for layer, c in zip(layers, caches) if layer.gamma is not None for s in (c["mean"], c["var"])]


def _bits(keys: np.ndarray, width: int, salt: int) -> np.ndarray:
    """64 random bits per row and position."""
    def mix(x):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))

    with np.errstate(over="ignore"):
        at = np.arange(1, width + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        rows = keys.astype(np.int64).view(np.uint64)
        if salt:
            rows = mix(rows + np.uint64(salt) * np.uint64(0xD1342543DE82EF95))
        return mix(rows[:, None] + at[None, :])


def uniforms(keys: np.ndarray, width: int, salt: int = 0) -> np.ndarray:
    """Uniform draws between 0 and 1, one row per 64-bit key; they depend on key, salt and position only."""
    return ((_bits(keys, width, salt) >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)


def normals(keys: np.ndarray, width: int) -> np.ndarray:
    """Standard normal draws, one row per 64-bit key; they depend on the key and the position only."""
    u = uniforms(keys, 2 * width)
    return np.sqrt(-2.0 * np.log(u[:, :width])) * np.cos(2.0 * np.pi * u[:, width:])
