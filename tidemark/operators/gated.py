"""Gated recurrent networks, many of one shape at a time.

Each network has its own weights, inputs and steps of descent; what they share
is the walk over time, whose products are taken for all of them at once. A
network's weights are the same, whatever others are fitted beside it.
"""

from __future__ import annotations

import math

import numpy as np


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _turned(x: np.ndarray) -> np.ndarray:
    return x.swapaxes(1, 2)


def _forward(p: dict[str, np.ndarray], x: np.ndarray, reset_first: bool, keep: list | None = None) -> np.ndarray:
    """Outputs (network, example, 2) of inputs (network, example, step, input)."""
    nets, examples, steps, inputs = x.shape
    hidden = p["wo"].shape[1]
    # The inputs' products need no state, so those of all steps are one.
    flat = x.swapaxes(1, 2).reshape(nets, steps * examples, inputs)
    i = (flat @ p["wi"] + p["bi"]).reshape(nets, steps, examples, 3, hidden)
    i = np.ascontiguousarray(i.transpose(1, 3, 0, 2, 4))  # (step, gate, network, example, state)
    gates, inner = np.ascontiguousarray(p["wh"][:, :, : 2 * hidden]), np.ascontiguousarray(p["wh"][:, :, 2 * hidden :])
    b_gates, b_inner = p["bh"][:, :, : 2 * hidden], p["bh"][:, :, 2 * hidden :]
    h = np.zeros((nets, examples, hidden))
    for t in range(steps):
        both = h @ gates + b_gates
        r, z = _sigmoid(i[t, 0] + both[:, :, :hidden]), _sigmoid(i[t, 1] + both[:, :, hidden:])
        product = (r * h if reset_first else h) @ inner + b_inner
        c = np.tanh(i[t, 2] + (product if reset_first else r * product))
        if keep is not None:
            keep.append((h, r, z, c, product))
        h = (1 - z) * h + z * c if reset_first else (1 - z) * c + z * h
    if keep is not None:
        keep.append(h)
    return h @ p["wo"] + p["bo"]


def _gradients(p: dict[str, np.ndarray], x: np.ndarray, push, reset_first: bool) -> dict[str, np.ndarray]:
    """Gradients of a mean loss over examples whose derivative by the outputs is ``push(outputs)``."""
    keep: list = []
    d_out = push(_forward(p, x, reset_first, keep)) / x.shape[1]
    last = keep.pop()
    nets, examples, steps, inputs = x.shape
    hidden = last.shape[2]
    g = {"wo": _turned(last) @ d_out, "bo": d_out.sum(axis=1, keepdims=True)}
    gates, inner = np.ascontiguousarray(_turned(p["wh"][:, :, : 2 * hidden])), np.ascontiguousarray(_turned(p["wh"][:, :, 2 * hidden :]))
    dh = d_out @ _turned(p["wo"])
    # What each step adds to the weights is one product over all steps behind the loop.
    by_input = np.empty((nets, steps, examples, 3 * hidden))
    by_inner = np.empty((nets, steps, examples, hidden))
    states = np.empty((nets, steps, examples, hidden))
    reset = np.empty((nets, steps, examples, hidden)) if reset_first else states
    for t in range(steps - 1, -1, -1):
        h, r, z, c, product = keep[t]
        if reset_first:
            dn, dz = dh * z * (1 - c**2), dh * (c - h)
            d_inner, back = dn, dn @ inner
            dr, before = back * h, dh * (1 - z) + back * r
            reset[:, t] = r * h
        else:
            dn, dz = dh * (1 - z) * (1 - c**2), dh * (h - c)
            d_inner = dn * r
            dr, before = dn * product, dh * z + d_inner @ inner
        d_gates = by_input[:, t, :, : 2 * hidden]
        d_gates[:, :, :hidden], d_gates[:, :, hidden:] = dr * r * (1 - r), dz * z * (1 - z)
        by_input[:, t, :, 2 * hidden :], by_inner[:, t], states[:, t] = dn, d_inner, h
        dh = before + d_gates @ gates
    rows = lambda v: v.reshape(nets, steps * examples, -1)
    flat, pushed, inside = x.swapaxes(1, 2).reshape(nets, steps * examples, inputs), rows(by_input), rows(by_inner)
    g["wi"], g["bi"] = _turned(flat) @ pushed, pushed.sum(axis=1, keepdims=True)
    g["wh"] = np.concatenate([_turned(rows(states)) @ pushed[:, :, : 2 * hidden], _turned(rows(reset)) @ inside], axis=2)
    g["bh"] = np.concatenate([g["bi"][:, :, : 2 * hidden], inside.sum(axis=1, keepdims=True)], axis=2)
    return g


class GatedNetwork:
    """A gated recurrent layer with a head of two outputs: the median, and how far above it the upper quantile lies.

    ``reset_first``: the reset gate acts on the state before the hidden
    product, and the new state is (1-z)*old + z*candidate. Otherwise it acts
    on the product with its bias, and the new state is (1-z)*candidate + z*old.
    """

    def __init__(self, inputs: int, hidden: int, reset_first: bool, seed: int = 1):
        rng = np.random.default_rng(seed)
        spread = 1 / math.sqrt(hidden)
        draw = lambda *shape: rng.uniform(-spread, spread, shape)
        self.reset_first, self.hidden, self.offset = reset_first, hidden, 0.0
        self.p = {"wi": draw(3, inputs, hidden), "wh": draw(3, hidden, hidden), "bi": draw(3, hidden), "bh": draw(3, hidden), "wo": draw(hidden, 2), "bo": np.array([0.0, 0.1])}

    def forward(self, x: np.ndarray) -> np.ndarray:
        return _forward(stacked([self]), x[None], self.reset_first)[0]

    def gradients(self, x: np.ndarray, push) -> dict[str, np.ndarray]:
        """Gradients of a loss whose derivative by the outputs is ``push(outputs)``."""
        return unstacked(_gradients(stacked([self]), x[None], lambda out: push(out[0])[None], self.reset_first), 0)

    def quantiles(self, x: np.ndarray) -> np.ndarray:
        """(p50, upper) in scaled units, upper no less than p50."""
        out = self.forward(x)
        return np.stack([out[:, 0], out[:, 0] + np.maximum(out[:, 1], 0) + self.offset], axis=1)

    def dump(self) -> dict:
        return {"reset_first": self.reset_first, "offset": self.offset, "weights": {k: v.tolist() for k, v in self.p.items()}}

    @classmethod
    def load(cls, spec: dict) -> GatedNetwork:
        weights = {k: np.array(v, float) for k, v in spec["weights"].items()}
        inputs, hidden = weights["wi"].shape[1:]
        out = cls(inputs, hidden, bool(spec["reset_first"]))
        for k, v in out.p.items():
            if weights.get(k) is None or weights[k].shape != v.shape or not np.isfinite(weights[k]).all():
                raise ValueError(f"weights {k} are missing, misshapen or not finite")
        out.p, out.offset = weights, float(spec["offset"])
        return out


def stacked(nets: list[GatedNetwork]) -> dict[str, np.ndarray]:
    """The networks' weights as one array each: (network, row, column), the three gates side by side."""
    side = lambda w: w.transpose(1, 0, 2).reshape(w.shape[1], -1)
    forms = {"wi": side, "wh": side, "bi": lambda w: w.reshape(1, -1), "bh": lambda w: w.reshape(1, -1), "wo": lambda w: w, "bo": lambda w: w[None]}
    return {k: np.stack([form(n.p[k]) for n in nets]) for k, form in forms.items()}


def unstacked(p: dict[str, np.ndarray], k: int) -> dict[str, np.ndarray]:
    """The weights of network ``k``, or their gradients, as that network has them."""
    hidden = p["wo"].shape[1]
    gates = lambda w: np.ascontiguousarray(w.reshape(w.shape[0], 3, hidden).transpose(1, 0, 2))
    flat = lambda w: w.reshape(3, hidden).copy()
    return {"wi": gates(p["wi"][k]), "wh": gates(p["wh"][k]), "bi": flat(p["bi"][k]), "bh": flat(p["bh"][k]), "wo": p["wo"][k].copy(), "bo": p["bo"][k][0].copy()}


def _clipped(g: dict[str, np.ndarray], clip: float, each: bool) -> dict[str, np.ndarray]:
    """Gradients with each entry within ``clip``, or with each network's norm within it."""
    if each:
        return {k: np.clip(v, -clip, clip) for k, v in g.items()}
    norm = np.sqrt(sum((v**2).sum(axis=(1, 2), keepdims=True) for v in g.values()))
    scale = np.minimum(1.0, clip / np.maximum(norm, 1e-12))
    return {k: v * scale for k, v in g.items()}


def train_stack(nets: list[GatedNetwork], windows: list[np.ndarray], labels: list[np.ndarray], q: list[float], epochs: int, batch: int, rate: float, clip: float, decay: float, clip_each: bool, seed: int = 1) -> None:
    """Fits networks of one shape in place, each to its ``windows`` (example, step, input) and ``labels``, as many of one as of another.

    Batches are drawn by ``seed``, so that each network sees its examples in
    the order that it would see them in alone.
    """
    rng, p = np.random.default_rng(seed), stacked(nets)
    levels, n = np.array(q, float)[:, None], len(labels[0])
    first, second = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    turn = 0
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(n), max(1, n // batch)):
            target = np.stack([y[part] for y in labels])

            def push(out, target=target):
                low = np.where(target > out[:, :, 0], -0.5, 0.5)
                upper = out[:, :, 0] + np.maximum(out[:, :, 1], 0)
                high = np.where(target > upper, -levels, 1 - levels)
                return np.stack([low + high, np.where(out[:, :, 1] > 0, high, np.minimum(high, 0))], axis=2)

            g = _clipped(_gradients(p, np.stack([x[part] for x in windows]), push, nets[0].reset_first), clip, clip_each)
            turn += 1
            for k, v in p.items():
                first[k] = 0.9 * first[k] + 0.1 * g[k]
                second[k] = 0.999 * second[k] + 0.001 * g[k] ** 2
                v -= rate * (first[k] / (1 - 0.9**turn) / (np.sqrt(second[k] / (1 - 0.999**turn)) + 1e-8) + decay * v)
    for k, net in enumerate(nets):
        net.p = unstacked(p, k)
