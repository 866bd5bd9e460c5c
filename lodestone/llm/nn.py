"""A gated recurrent layer in numpy, forward and backward, and Adam."""

from __future__ import annotations

import numpy as np

Params = dict[str, np.ndarray]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + np.float32(0.5)


def init_gru(rng: np.random.Generator, inputs: int, hidden: int, name: str) -> Params:
    scale = lambda n: np.float32(1 / np.sqrt(n))
    bias = np.zeros(3 * hidden, dtype=np.float32)
    bias[:hidden] = 0.5
    return {
        f"{name}.W": rng.standard_normal((inputs, 3 * hidden)).astype(np.float32) * scale(inputs),
        f"{name}.U": rng.standard_normal((hidden, 3 * hidden)).astype(np.float32) * scale(hidden),
        f"{name}.b": bias,
    }


def gru_step(gx: np.ndarray, h: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Next state from the input's share of the gates (update, reset, new)."""
    n = h.shape[1]
    gh = h @ u
    zr = gx[:, : 2 * n] + gh[:, : 2 * n]
    zr *= np.float32(0.5)
    np.tanh(zr, out=zr)
    zr *= np.float32(0.5)
    zr += np.float32(0.5)
    new = zr[:, n:] * gh[:, 2 * n :]
    new += gx[:, 2 * n :]
    np.tanh(new, out=new)
    after = h - new
    after *= zr[:, :n]
    after += new
    return after


def gru_forward(gx: np.ndarray, h: np.ndarray, u: np.ndarray, mask: np.ndarray | None) -> tuple[np.ndarray, tuple]:
    """States (steps, rows, hidden) after each step of gx (steps, rows, 3 * hidden); mask 0 keeps the state, no mask: none does."""
    n, first = h.shape[1], h
    out, zrs, news, ghs = (np.empty((len(gx), len(h), k * n), dtype=np.float32) for k in (1, 2, 1, 3))
    for t in range(len(gx)):
        gh, zr, new = ghs[t], zrs[t], news[t]
        np.matmul(h, u, out=gh)
        np.add(gx[t, :, : 2 * n], gh[:, : 2 * n], out=zr)
        zr *= np.float32(0.5)
        np.tanh(zr, out=zr)
        zr *= np.float32(0.5)
        zr += np.float32(0.5)
        np.multiply(zr[:, n:], gh[:, 2 * n :], out=new)
        new += gx[t, :, 2 * n :]
        np.tanh(new, out=new)
        after = out[t]
        np.subtract(h, new, out=after)
        after *= zr[:, :n]
        after += new
        if mask is not None:
            m = mask[t][:, None]
            after *= m
            after += h * (1 - m)
        h = after
    return out, (np.concatenate((first[None], out))[: len(out)], zrs, news, ghs[:, :, 2 * n :], mask)


def gru_backward(d_out: np.ndarray, kept: tuple, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of gx and of u, given those of all states."""
    steps, rows, n = d_out.shape
    d_gh, d_news = np.empty((steps, rows, 3 * n), dtype=np.float32), np.empty((steps, rows, n), dtype=np.float32)
    d_h = np.zeros_like(d_out[0])
    back = np.ascontiguousarray(u.T)
    # what the gradient of a state is multiplied by on its way to each gate, for all steps together
    before, zr, new, ghn, mask = kept
    z, r = np.ascontiguousarray(zr[:, :, :n]), np.ascontiguousarray(zr[:, :, n:])
    to_new = new * new
    np.subtract(1, to_new, out=to_new)
    slope = 1 - z
    to_new *= slope
    slope *= z
    to_z = before - new
    to_z *= slope
    np.subtract(1, r, out=slope)
    slope *= r
    slope *= ghn
    to_r = slope
    for t in range(steps - 1, -1, -1):
        m = None if mask is None else mask[t][:, None]
        d = d_h
        d += d_out[t]
        d_after = d if m is None else d * m
        d_new = np.multiply(d_after, to_new[t], out=d_news[t])
        np.multiply(d_after, to_z[t], out=d_gh[t, :, :n])
        np.multiply(d_new, to_r[t], out=d_gh[t, :, n : 2 * n])
        np.multiply(d_new, r[t], out=d_gh[t, :, 2 * n :])
        d_h = d_gh[t] @ back
        d_h += d_after * z[t]
        if m is not None:
            d_h += d * (1 - m)
    d_u = before.reshape(-1, n).T @ d_gh.reshape(-1, 3 * n)
    d_gh[:, :, 2 * n :] = d_news
    return d_gh, d_u


class Adam:
    def __init__(self, params: Params, rate: float):
        self.params, self.rate, self.t = params, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.v = {k: np.zeros_like(v) for k, v in params.items()}

    def step(self, grads: Params, clip: float = 5.0) -> None:
        self.t += 1
        norm = float(np.sqrt(sum(float((g * g).sum()) for g in grads.values())))
        scale = min(1.0, clip / (norm + 1e-9))
        for k, g in grads.items():
            if scale < 1:
                g = g * np.float32(scale)
            m, v = self.m[k], self.v[k]
            m *= 0.9
            m += 0.1 * g
            v *= 0.99
            v += 0.01 * g * g
            rate = self.rate * np.sqrt(1 - 0.99**self.t) / (1 - 0.9**self.t)
            self.params[k] -= (rate * m / (np.sqrt(v) + 1e-7)).astype(np.float32)
