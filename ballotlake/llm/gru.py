"""A bidirectional gated recurrent network over bytes in numpy, trained by backpropagation through time."""

from __future__ import annotations

import numpy as np

#: Byte windows are padded with this symbol, which has no label and moves nothing.
PAD = 256


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-x))


class BiGru:
    """One state per direction; a linear layer labels every position from both.

    The input layer is a table of one row per byte. Weights are float32 and come from ``seed`` alone, so that a task
    that runs again after a loss gives the same result.
    """

    def __init__(self, labels: int, hidden: int = 32, seed: int = 0):
        rng = np.random.default_rng(seed)
        h, s = hidden, 1.0 / np.sqrt(hidden)
        self.h, self.labels = hidden, labels
        self.p: dict[str, np.ndarray] = {}
        for d in "fb":
            self.p[f"x{d}"] = rng.uniform(-0.5, 0.5, (PAD + 1, 3 * h)).astype(np.float32)
            self.p[f"u{d}"] = rng.uniform(-s, s, (h, 3 * h)).astype(np.float32)
            self.p[f"c{d}"] = np.zeros(h, np.float32)
        self.p["v"] = rng.uniform(-s, s, (2 * h, labels)).astype(np.float32)
        self.p["w"] = np.zeros(labels, np.float32)

    def _run(self, x: np.ndarray, d: str, keep: bool):
        """States (T, B, h) of one direction over ``x`` (T, B), already in its order; with ``keep`` what backpropagation needs."""
        h, u, c, table = self.h, self.p[f"u{d}"], self.p[f"c{d}"], self.p[f"x{d}"]
        steps, batch = x.shape
        state = np.zeros((batch, h), np.float32)
        states = np.empty((steps, batch, h), np.float32)
        kept = []
        for t in range(steps):
            a = table[x[t]]
            g = state @ u
            rz = _sigmoid(a[:, : 2 * h] + g[:, : 2 * h])
            r, z = rz[:, :h], rz[:, h:]
            m = g[:, 2 * h :] + c
            n = np.tanh(a[:, 2 * h :] + r * m)
            live = (x[t] != PAD)[:, None]
            new = np.where(live, n + z * (state - n), state)
            if keep:
                kept.append((state, r, z, m, n, live))
            state = new
            states[t] = state
        return states, kept

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """(T, B, labels) for byte windows ``x`` (T, B)."""
        f, _ = self._run(x, "f", False)
        b, _ = self._run(x[::-1], "b", False)
        o = f @ self.p["v"][: self.h] + b[::-1] @ self.p["v"][self.h :] + self.p["w"]
        o -= o.max(-1, keepdims=True)
        np.exp(o, out=o)
        o /= o.sum(-1, keepdims=True)
        return o

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over the positions that aren't padding, and its gradients. ``y``: a label per window."""
        f, kf = self._run(x, "f", True)
        b, kb = self._run(x[::-1], "b", True)
        s = np.concatenate([f, b[::-1]], -1)
        o = s @ self.p["v"] + self.p["w"]
        o -= o.max(-1, keepdims=True)
        q = np.exp(o)
        q /= q.sum(-1, keepdims=True)
        live = (x != PAD).astype(np.float32)
        total = max(float(live.sum()), 1.0)
        picked = np.take_along_axis(q, np.broadcast_to(y[None, :, None], (*x.shape, 1)), -1)[..., 0]
        loss = float(-(np.log(picked + 1e-9) * live).sum() / total)
        np.put_along_axis(q, np.broadcast_to(y[None, :, None], (*x.shape, 1)), (picked - 1.0)[..., None], -1)
        q *= live[..., None] / total
        flat = q.reshape(-1, self.labels)
        g = {"v": s.reshape(-1, 2 * self.h).T @ flat, "w": flat.sum(0)}
        ds = (flat @ self.p["v"].T).reshape(*x.shape, 2 * self.h)
        self._back(x, "f", kf, ds[..., : self.h], g)
        self._back(x[::-1], "b", kb, ds[::-1, :, self.h :], g)
        return loss, g

    def _back(self, x, d, kept, ds, g) -> None:
        h, u = self.h, self.p[f"u{d}"]
        steps, batch = x.shape
        da = np.empty((steps, batch, 3 * h), np.float32)
        du, dc = np.zeros_like(u), np.zeros(h, np.float32)
        carry = np.zeros((batch, h), np.float32)
        dg = np.empty((batch, 3 * h), np.float32)
        for t in range(steps - 1, -1, -1):
            prev, r, z, m, n, live = kept[t]
            dh = ds[t] + carry
            moved = np.where(live, dh, 0.0)
            dn = moved * (1 - z) * (1 - n * n)
            dz = moved * (prev - n) * z * (1 - z)
            dr = dn * m * r * (1 - r)
            da[t, :, :h], da[t, :, h : 2 * h], da[t, :, 2 * h :] = dr, dz, dn
            dg[:, :h], dg[:, h : 2 * h], dg[:, 2 * h :] = dr, dz, dn * r
            du += prev.T @ dg
            dc += dg[:, 2 * h :].sum(0)
            carry = np.where(live, moved * z, dh) + dg @ u.T
        order = np.argsort(x.reshape(-1), kind="stable")
        symbols, starts = np.unique(x.reshape(-1)[order], return_index=True)
        g[f"x{d}"] = np.zeros((PAD + 1, 3 * h), da.dtype)
        g[f"x{d}"][symbols] = np.add.reduceat(da.reshape(-1, 3 * h)[order], starts, 0)
        g[f"u{d}"], g[f"c{d}"] = du, dc

    def train(self, windows: np.ndarray, labels: np.ndarray, weights: np.ndarray, steps: int, batch: int, rate: float, seed: int, short: float = 0.4) -> float:
        """Adam over random batches in which label k has the share ``weights[k]`` of the windows (at least one). ``windows``: (N, T).

        The share ``short`` of the windows is cut to a random length, so that short texts are learnt too. Labels without a window are left out. Returns the mean loss of the last steps.
        """
        rng = np.random.default_rng(seed)
        groups = [(np.flatnonzero(labels == k), float(weights[k])) for k in range(self.labels)]
        groups = [(x, w) for x, w in groups if len(x)]
        if not groups:
            return 0.0
        share = sum(w for _, w in groups)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        losses = []
        for t in range(1, steps + 1):
            rows = np.concatenate([rng.choice(x, max(1, round(batch * w / share))) for x, w in groups])
            x = windows[rows]
            cut = np.where(rng.random(len(rows)) < short, rng.integers(8, x.shape[1] + 1, len(rows)), x.shape[1])
            x[np.arange(x.shape[1])[None, :] >= cut[:, None]] = PAD
            loss, g = self.gradients(np.ascontiguousarray(x.T), labels[rows])
            norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
            clip = min(1.0, 1.0 / (norm + 1e-9))
            lr = rate * min(1.0, t / 20) * (1.0 if t < 0.7 * steps else 0.2)
            for k, v in g.items():
                v *= clip
                m[k] += 0.1 * (v - m[k])
                s[k] += 0.001 * (v * v - s[k])
                self.p[k] -= lr * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.999**t)) + 1e-8)
            losses.append(loss)
        return float(np.mean(losses[-20:])) if losses else 0.0
