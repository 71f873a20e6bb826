"""A character-level bidirectional LSTM with CRF transitions, in numpy.

Arrays hold features by sequences, so that each gate of all sequences is one contiguous block. The cell's squashing function
is softsign, ``x / (1 + |x|)``, and the input, forget and output gates are ``(1 + softsign) / 2``: numpy takes a fifth of the
time of hyperbolic tangents for it, which decides the cost of reading whole texts.
"""

from __future__ import annotations

import numpy as np

HIDDEN = 12


def _squash(x: np.ndarray, spare: np.ndarray) -> None:
    """Softsign in place."""
    np.abs(x, out=spare)
    spare += 1
    x /= spare


class Tagger:
    """``classes`` character classes in, ``tags`` tags out. Sequences of one length form a batch; class 0 is filling, at which
    the backward state is empty, so that a sequence's tags don't depend on how much filling follows it. Tag 0 is outside."""

    def __init__(self, classes: int, tags: int, hidden: int = HIDDEN, seed: int = 7):
        r = np.random.default_rng(seed)
        self.h, self.classes, self.tags = hidden, classes, tags
        small = lambda *s: (r.standard_normal(s) * 0.3).astype(np.float32)
        self.p = {"A": small(tags, tags), "b": small(tags)}
        for d in "fb":
            self.p |= {f"x{d}": small(4 * hidden, classes), f"h{d}": small(4 * hidden, hidden), f"u{d}": small(tags, hidden)}

    def _lstm(self, x: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """States (step, feature, sequence) of classes (step, sequence)."""
        steps, n = x.shape
        k = self.h
        table, w = self.p[f"x{d}"], self.p[f"h{d}"]
        filled = ~(x.all(axis=1)) if d == "b" else np.zeros(steps, dtype=bool)
        out = np.empty((steps, k, n), dtype=np.float32)
        h, c = np.zeros((k, n), dtype=np.float32), np.zeros((k, n), dtype=np.float32)
        z, y, s, r = (np.empty((m, n), dtype=np.float32) for m in (4 * k, 4 * k, k, k))
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            np.dot(w, h, out=z)
            z += table.take(x[t], axis=1, out=y, mode="clip")
            _squash(z, y)
            gates = z[: 3 * k]
            gates *= 0.5
            gates += 0.5
            i, f, o, u = z[:k], z[k : 2 * k], z[2 * k : 3 * k], z[3 * k :]
            if keep is not None:
                keep.append((t, z.copy(), c.copy(), h.copy()))
            c *= f
            np.multiply(i, u, out=s)
            c += s
            if filled[t]:
                c *= x[t] > 0
            s[...] = c
            _squash(s, r)
            h = np.multiply(o, s, out=out[t])
            if keep is not None:
                keep[-1] += (s.copy(),)
        return out

    def emissions(self, x: np.ndarray, keep: tuple[list, list] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores (step, tag, sequence), and the states of both directions."""
        forth, back = (self._lstm(x, d, keep and keep[i]) for i, d in enumerate("fb"))
        return np.matmul(self.p["uf"], forth) + np.matmul(self.p["ub"], back) + self.p["b"][:, None], forth, back

    def decode(self, x: np.ndarray) -> np.ndarray:
        """Best tags (sequence, step) of classes (sequence, step), by the Viterbi algorithm."""
        best = self.emissions(np.ascontiguousarray(x.T))[0]
        steps, tags, n = best.shape
        a = self.p["A"]
        outside, tried = best[0, 0].copy(), np.empty((tags, tags, n), dtype=np.float32)
        for t in range(1, steps):  # the scores of all steps stay, and which tag a score came from is found on the way back
            here = best[t]
            outside += a[0, 0]
            outside += here[0]
            here += np.add(best[t - 1][:, None, :], a[:, :, None], out=tried).max(axis=0)
        out = np.zeros((n, steps), dtype=np.int8)
        last = best[-1].argmax(axis=0)
        some = np.flatnonzero((last > 0) | (outside < best[-1, 0]))  # of others, the best path is outside all along
        tag = out[some, -1] = last[some]
        into = np.ascontiguousarray(a.T)
        for t in range(steps - 1, 0, -1):
            tag = (best[t - 1][:, some].T + into[tag]).argmax(axis=1)
            out[some, t - 1] = tag
        return out

    def _gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean negative log-likelihood of tags ``y`` (step, sequence)."""
        kept: tuple[list, list] = ([], [])
        e, forth, back = self.emissions(x, kept)
        steps, tags, n = e.shape
        # forward and backward in probabilities, each step scaled to a sum of one
        m = np.exp((e - e.max(axis=1, keepdims=True)).astype(np.float64))
        a = np.exp(self.p["A"].astype(np.float64))
        fwd, bwd, scale = np.empty_like(m), np.empty_like(m), np.empty((steps, 1, n))
        for t in range(steps):
            v = m[t] * (a.T @ fwd[t - 1]) if t else m[0]
            scale[t] = v.sum(axis=0)
            fwd[t] = v / scale[t]
        bwd[-1] = 1
        for t in range(steps - 2, -1, -1):
            bwd[t] = a @ (m[t + 1] * bwd[t + 1]) / scale[t + 1]
        de = fwd * bwd
        pair = a * np.einsum("tin,tjn->ij", fwd[:-1], m[1:] * bwd[1:] / scale[1:])
        at = np.arange(steps)[:, None], y, np.arange(n)[None, :]
        de[at] -= 1
        np.subtract.at(pair, (y[:-1].ravel(), y[1:].ravel()), 1)
        de = (de / n).astype(np.float32)
        g = {"A": (pair / n).astype(np.float32), "b": de.sum(axis=(0, 2))}
        k = self.h
        one = np.zeros((steps * n, self.classes), dtype=np.float32)
        one[np.arange(steps * n), x.ravel()] = 1
        for d, h, keep in (("f", forth, kept[0]), ("b", back, kept[1])):
            g[f"u{d}"] = np.einsum("tkn,thn->kh", de, h)
            above = np.matmul(self.p[f"u{d}"].T, de)
            w = np.ascontiguousarray(self.p[f"h{d}"].T)
            dz = np.empty((steps, 4 * k, n), dtype=np.float32)
            prior = np.empty((steps, k, n), dtype=np.float32)
            dh = dc = np.zeros((k, n), dtype=np.float32)
            for t, z, c, before, s in reversed(keep):
                i, f, o, u = z[:k], z[k : 2 * k], z[2 * k : 3 * k], z[3 * k :]
                dh = dh + above[t]
                dc = dc + dh * o * (1 - np.abs(s)) ** 2
                if d == "b":
                    dc = dc * (x[t] > 0)
                to = dz[t]
                to[:k], to[k : 2 * k], to[2 * k : 3 * k], to[3 * k :] = dc * u, dc * c, dh * s, dc * i
                to[: 3 * k] *= 0.5 * (1 - np.abs(2 * z[: 3 * k] - 1)) ** 2  # a gate g comes from the softsign 2g - 1
                to[3 * k :] *= (1 - np.abs(u)) ** 2
                prior[t] = before
                dh, dc = w @ to, dc * f
            g[f"h{d}"] = np.einsum("tkn,thn->kh", dz, prior, optimize=True)
            g[f"x{d}"] = dz.transpose(1, 0, 2).reshape(4 * k, -1) @ one
        return g

    def fit(self, x: np.ndarray, y: np.ndarray, steps: int, batch: int = 48, rate: float = 0.02, seed: int = 3) -> None:
        """Adam over random batches of sequences (sequence, step)."""
        r = np.random.default_rng(seed)
        m, v = ({k: np.zeros_like(w) for k, w in self.p.items()} for _ in range(2))
        for k in range(1, steps + 1):
            rows = r.integers(0, len(x), batch)
            for name, g in self._gradients(np.ascontiguousarray(x[rows].T), np.ascontiguousarray(y[rows].T)).items():
                g = np.clip(g, -5, 5)
                m[name] = 0.9 * m[name] + 0.1 * g
                v[name] = 0.99 * v[name] + 0.01 * g * g
                step = rate * min(1.0, 2 * (1 - k / (steps + 1)))
                self.p[name] = (self.p[name] - step * (m[name] / (1 - 0.9**k)) / (np.sqrt(v[name] / (1 - 0.99**k)) + 1e-6)).astype(np.float32)
