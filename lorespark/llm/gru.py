"""A gated recurrent layer in numpy, with backpropagation through time, and the Adam rule.

Arrays are laid out ``(time, unit, row)``: a step is one small matrix product and a few
operations over long contiguous rows. Gates use the piecewise linear sigmoid.
"""

from __future__ import annotations

import numpy as np

Params = dict[str, np.ndarray]
SLOPE = np.float32(0.25)


def gate(x: np.ndarray) -> np.ndarray:
    """Clip ``x / 4 + 1 / 2`` to [0, 1], in place."""
    x *= SLOPE
    x += np.float32(0.5)
    return np.clip(x, 0, 1, out=x)


def run(inputs: np.ndarray, weights: np.ndarray, mask: np.ndarray, tape: list | None = None) -> np.ndarray:
    """States ``(T, H, B)`` of ``inputs (T, 3H, B)``: reset, update and candidate inputs.

    ``mask (T, B)`` is 0 where a row has no symbol; its state stays. ``tape`` collects what the
    way back needs.
    """
    steps, _, rows = inputs.shape
    size = weights.shape[1]
    states = np.empty((steps, size, rows), np.float32)
    state = np.zeros((size, rows), np.float32)
    turned = np.empty((3 * size, rows), np.float32)
    for t in range(steps):
        np.matmul(weights, state, out=turned)
        gates = gate(turned[: 2 * size] + inputs[t, : 2 * size])
        reset, update = gates[:size], gates[size:]
        new = turned[2 * size :] * reset
        new += inputs[t, 2 * size :]
        np.tanh(new, out=new)
        move = new - state
        move *= update
        move *= mask[t]
        if tape is not None:
            tape.append((state, reset, update, new, turned[2 * size :].copy()))
        state = np.add(state, move, out=states[t])
    return states


def back(
    grads: np.ndarray, weights: np.ndarray, mask: np.ndarray, tape: list
) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the inputs and the weights, from those of the states."""
    steps, size, rows = grads.shape
    d_inputs = np.empty((steps, 3 * size, rows), np.float32)
    d_weights = np.zeros_like(weights)
    carried = np.zeros((size, rows), np.float32)
    for t in range(steps - 1, -1, -1):
        state, reset, update, new, turned = tape[t]
        d = carried + grads[t]
        d_move = d * mask[t]
        d_new = d_move * update * (1 - new * new)
        d_update = d_move * (new - state) * ((update > 0) & (update < 1)) * SLOPE
        d_reset = d_new * turned * ((reset > 0) & (reset < 1)) * SLOPE
        d_inputs[t, :size], d_inputs[t, size : 2 * size], d_inputs[t, 2 * size :] = d_reset, d_update, d_new
        d_turned = np.concatenate((d_reset, d_update, d_new * reset))
        d_weights += d_turned @ state.T
        carried = d - d_move * update + weights.T @ d_turned
    return d_inputs, d_weights


def both(forward: np.ndarray, backward: np.ndarray, p: Params, mask: np.ndarray, tape: dict | None = None) -> np.ndarray:
    """States of both directions, ``(T, 2H, B)``; ``backward`` inputs are in reading order."""
    tapes = ([], []) if tape is not None else (None, None)
    ahead = run(forward, p["ahead"], mask, tapes[0])
    behind = run(backward[::-1], p["behind"], mask[::-1], tapes[1])[::-1]
    if tape is not None:
        tape.update(ahead=tapes[0], behind=tapes[1], mask=mask)
    return np.concatenate((ahead, behind), axis=1)


def both_back(grads: np.ndarray, p: Params, tape: dict) -> tuple[np.ndarray, np.ndarray, Params]:
    size, mask = p["ahead"].shape[1], tape["mask"]
    d_forward, d_ahead = back(grads[:, :size], p["ahead"], mask, tape["ahead"])
    d_backward, d_behind = back(grads[::-1, size:], p["behind"], mask[::-1], tape["behind"])
    return d_forward, d_backward[::-1], {"ahead": d_ahead, "behind": d_behind}


class Adam:
    """Steps of the Adam rule; gradients are clipped to a norm of 5."""

    def __init__(self, params: Params, rate: float = 0.01):
        self.params, self.rate, self.steps = params, rate, 0
        self.mean = {k: np.zeros_like(v) for k, v in params.items()}
        self.square = {k: np.zeros_like(v) for k, v in params.items()}

    def step(self, grads: Params, rate: float | None = None) -> None:
        self.steps += 1
        norm = float(np.sqrt(sum((g.astype(np.float64) ** 2).sum() for g in grads.values())))
        scale = min(1.0, 5.0 / (norm + 1e-12))
        for k, g in grads.items():
            g = g * np.float32(scale)
            self.mean[k] += 0.1 * (g - self.mean[k])
            self.square[k] += 0.001 * (g * g - self.square[k])
            mean, square = self.mean[k] / (1 - 0.9**self.steps), self.square[k] / (1 - 0.999**self.steps)
            self.params[k] -= ((rate or self.rate) * mean / (np.sqrt(square) + 1e-8)).astype(np.float32)


def small(rng: np.random.Generator, *shape: int) -> np.ndarray:
    return (rng.standard_normal(shape) / np.sqrt(shape[-1])).astype(np.float32)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))
