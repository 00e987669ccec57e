"""Bidirectional gated recurrent network with attention pooling, forward and backward in numpy.

Windows of words come in as input numbers; 0 stands for no word.  All arrays
of a batch have the window first: (windows, steps, width).
"""

from __future__ import annotations

import numpy as np

Weights = dict[str, np.ndarray]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def initial(inputs: int, hidden: int, attention: int, rng: np.random.Generator) -> Weights:
    def drawn(*shape: int) -> np.ndarray:
        return (rng.normal(size=shape) / np.sqrt(shape[0])).astype(np.float32)

    weights = {}
    for side in ("f", "b"):
        weights |= {f"w{side}": drawn(inputs, 3 * hidden), f"u{side}": drawn(hidden, 3 * hidden),
                    f"c{side}": np.zeros(3 * hidden, np.float32)}
    return weights | {"wa": drawn(2 * hidden, attention), "ca": np.zeros(attention, np.float32),
                      "va": drawn(attention, 1), "wo": drawn(2 * hidden, 1), "co": np.full(1, -1, np.float32)}


def _run(gates: np.ndarray, mask: np.ndarray, u: np.ndarray, back: bool, keep: list | None = None) -> np.ndarray:
    """Hidden states of one direction.  ``gates``: inputs times weights, for update, reset and candidate."""
    windows, steps, width = gates.shape
    hidden = width // 3
    state, out = np.zeros((windows, hidden), np.float32), np.empty((windows, steps, hidden), np.float32)
    for t in range(steps - 1, -1, -1) if back else range(steps):
        past = state @ u[:, :2 * hidden]
        zr = _sigmoid(gates[:, t, :2 * hidden] + past)
        z, r = zr[:, :hidden], zr[:, hidden:]
        new = np.tanh(gates[:, t, 2 * hidden:] + (r * state) @ u[:, 2 * hidden:])
        # A step without a word leaves the state as it is.
        step = z * mask[:, t, None]
        if keep is not None:
            keep.append((t, state, z, r, new, step))
        state = state + step * (new - state)
        out[:, t] = state
    return out


def _pool(weights: Weights, states: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, ...]:
    tone = np.tanh(states @ weights["wa"] + weights["ca"])
    share = np.where(mask, (tone @ weights["va"])[:, :, 0], -30)
    share = np.exp(share - share.max(axis=1, keepdims=True)) * mask
    share /= np.maximum(share.sum(axis=1, keepdims=True), 1e-9)
    pooled = (share[:, :, None] * states).sum(axis=1)
    return tone, share, pooled


def gate_inputs(weights: Weights, inputs: np.ndarray) -> np.ndarray:
    """Both directions' input products, taken once per distinct word."""
    return np.concatenate([inputs @ weights["wf"] + weights["cf"], inputs @ weights["wb"] + weights["cb"]], axis=1)


def log_odds(weights: Weights, gates: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Log-odds of every window of word numbers, given each word's gate inputs."""
    half = gates.shape[1] // 2
    mask = windows > 0
    given = gates[windows]
    states = np.concatenate([_run(given[:, :, :half], mask, weights["uf"], False),
                             _run(given[:, :, half:], mask, weights["ub"], True)], axis=2)
    return (_pool(weights, states, mask)[2] @ weights["wo"])[:, 0] + weights["co"][0]


def gradients(weights: Weights, inputs: np.ndarray, mask: np.ndarray, labels: np.ndarray) -> tuple[Weights, np.ndarray]:
    """Gradients of the mean logistic loss for all weights and for the inputs."""
    windows, steps, width = inputs.shape
    hidden = weights["uf"].shape[0]
    flat = inputs.reshape(-1, width)
    kept: dict[str, list] = {"f": [], "b": []}
    states = np.concatenate([
        _run((flat @ weights[f"w{s}"] + weights[f"c{s}"]).reshape(windows, steps, -1), mask, weights[f"u{s}"],
             s == "b", kept[s]) for s in ("f", "b")], axis=2)
    tone, share, pooled = _pool(weights, states, mask)
    chance = _sigmoid((pooled @ weights["wo"])[:, 0] + weights["co"][0])
    d_out = ((chance - labels) / windows).astype(np.float32)[:, None]
    grad: Weights = {"wo": pooled.T @ d_out, "co": d_out.sum(axis=0)}
    d_pooled = d_out @ weights["wo"].T
    d_share = (states @ d_pooled[:, :, None])[:, :, 0]
    d_score = (share * (d_share - (share * d_share).sum(axis=1, keepdims=True)))[:, :, None]
    d_tone = (d_score @ weights["va"].T) * (1 - tone ** 2)
    size = tone.shape[2]
    grad["va"] = tone.reshape(-1, size).T @ d_score.reshape(-1, 1)
    grad["wa"] = states.reshape(-1, 2 * hidden).T @ d_tone.reshape(-1, size)
    grad["ca"] = d_tone.sum(axis=(0, 1))
    d_states = share[:, :, None] * d_pooled[:, None, :] + d_tone @ weights["wa"].T
    d_inputs = np.zeros_like(inputs)
    for s, part in (("f", slice(0, hidden)), ("b", slice(hidden, None))):
        u = weights[f"u{s}"]
        d_u, d_state = np.zeros_like(u), np.zeros((windows, hidden), np.float32)
        d_gates = np.zeros((windows, steps, 3 * hidden), np.float32)
        for t, past, z, r, new, step in reversed(kept[s]):
            d_state = d_state + d_states[:, t, part]
            d_new = d_state * step * (1 - new ** 2)
            d_z = d_state * (new - past) * mask[:, t, None] * z * (1 - z)
            d_reset = d_new @ u[:, 2 * hidden:].T
            d_r = d_reset * past * r * (1 - r)
            d_zr = np.concatenate([d_z, d_r], axis=1)
            d_u[:, :2 * hidden] += past.T @ d_zr
            d_u[:, 2 * hidden:] += (r * past).T @ d_new
            d_gates[:, t] = np.concatenate([d_zr, d_new], axis=1)
            d_state = d_state * (1 - step) + d_reset * r + d_zr @ u[:, :2 * hidden].T
        rows = d_gates.reshape(-1, 3 * hidden)
        grad |= {f"u{s}": d_u, f"w{s}": flat.T @ rows, f"c{s}": rows.sum(axis=0)}
        d_inputs += (rows @ weights[f"w{s}"].T).reshape(inputs.shape)
    return grad, d_inputs


class Steps:
    """Adam steps for a set of arrays."""

    def __init__(self, rate: float):
        self.rate, self.count, self.first, self.second = rate, 0, {}, {}

    def take(self, values: Weights, grad: Weights) -> None:
        self.count += 1
        for name, g in grad.items():
            self.first[name] = 0.9 * self.first.get(name, 0) + 0.1 * g
            self.second[name] = 0.99 * self.second.get(name, 0) + 0.01 * g * g
            m, v = self.first[name] / (1 - 0.9 ** self.count), self.second[name] / (1 - 0.99 ** self.count)
            values[name] -= (self.rate * m / (np.sqrt(v) + 1e-8)).astype(values[name].dtype)
