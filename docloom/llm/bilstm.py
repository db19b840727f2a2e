"""A character-level bidirectional LSTM with CRF transitions, in numpy: forward, gradients, training and decoding."""

from __future__ import annotations

import numpy as np

# Characters with a symbol of their own; others share one by kind.
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789 \n.,:;-_@()[]{}+/\\'\"&#!?|*<>=%$€ßäöüéèáíóúñçøåôëÄÖÜ"
PAD, LOWER, UPPER, DIGIT, MARK = range(5)
_INDEX = {c: i + 5 for i, c in enumerate(ALPHABET)}
SYMBOLS = len(ALPHABET) + 5
_table: list[np.ndarray] = []


def _symbol(c: str) -> int:
    n = _INDEX.get(c)
    return n if n is not None else LOWER if c.islower() else UPPER if c.isupper() else DIGIT if c.isdigit() else _INDEX[" "] if c.isspace() else LOWER if c.isalpha() else MARK


def symbols(text: str) -> np.ndarray:
    """Numbers of the characters of ``text``."""
    if not _table:  # one number for each code point of the first planes; a rare character beyond them is a mark
        _table.append(np.array([_symbol(chr(i)) for i in range(0x20000)], np.uint8))
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return _table[0].take(points, mode="clip")


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


def logsum(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis, keepdims=True))).squeeze(axis)


class Tagger:
    """Embeddings of characters and of their words' kinds, one LSTM in each direction, a linear layer to ``labels``
    scores, and transitions between labels."""

    def __init__(self, labels: int, kinds: int = 1, embed: int = 20, hidden: int = 32, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.hidden, self.labels = hidden, labels
        put = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {"e": put(SYMBOLS, embed) * np.float32(3), "k": put(kinds, embed), "w": put(2 * hidden, labels), "b": np.zeros(labels, np.float32), "t": np.zeros((labels, labels), np.float32)}
        for d in "fr":
            self.p |= {f"x{d}": put(embed, 4 * hidden), f"h{d}": put(hidden, 4 * hidden), f"c{d}": np.zeros(4 * hidden, np.float32)}
            self.p[f"c{d}"][hidden : 2 * hidden] = 1

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str, keep: bool):
        """States over time of one direction; ``x`` is (time, batch, embedding), already reversed for ``r``."""
        n, h = self.hidden, np.zeros((x.shape[1], self.hidden), np.float32)
        c = h
        pre = x @ self.p[f"x{d}"] + self.p[f"c{d}"]
        out, memory = np.empty((len(x), x.shape[1], n), np.float32), []
        for t in range(len(x)):
            g = pre[t] + h @ self.p[f"h{d}"]
            s = sigmoid(g[:, : 3 * n])
            i, f, o, u = s[:, :n], s[:, n : 2 * n], s[:, 2 * n :], np.tanh(g[:, 3 * n :])
            m = mask[t]
            new = f * c + i * u
            v = np.tanh(new)
            if keep:
                memory.append((h, c, i, f, o, u, v))
            c = m * new + (1 - m) * c
            h = m * (o * v) + (1 - m) * h
            out[t] = h
        return out, memory

    def _back(self, x, mask, d, memory, dout, grads):
        n = self.hidden
        dh, dc = np.zeros_like(dout[0]), np.zeros_like(dout[0])
        dpre = np.empty((len(x), x.shape[1], 4 * n), np.float32)
        for t in range(len(x) - 1, -1, -1):
            h, c, i, f, o, u, v = memory[t]
            m = mask[t]
            dh = dh + dout[t]
            a = m * dh
            dnew = a * o * (1 - v * v) + m * dc
            g = dpre[t]
            g[:, :n] = dnew * u * i * (1 - i)
            g[:, n : 2 * n] = dnew * c * f * (1 - f)
            g[:, 2 * n : 3 * n] = a * v * o * (1 - o)
            g[:, 3 * n :] = dnew * i * (1 - u * u)
            grads[f"h{d}"] += h.T @ g
            dh = (1 - m) * dh + g @ self.p[f"h{d}"].T
            dc = (1 - m) * dc + dnew * f
        grads[f"x{d}"] += np.tensordot(x, dpre, ((0, 1), (0, 1)))
        grads[f"c{d}"] += dpre.sum((0, 1))
        return dpre @ self.p[f"x{d}"].T

    def scores(self, ids: np.ndarray, kinds: np.ndarray | None = None) -> np.ndarray:
        """Label scores (batch, time, labels) of rows of symbols, padded with ``PAD`` at their ends; ``kinds`` are the
        kinds of the words that the characters belong to. What stands at padding has no meaning."""
        n, k, embed, (batch, time), one = self.hidden, self.labels, self.p["e"].shape[1], ids.shape, np.float32(1)
        size = (ids != PAD).sum(1)
        order = np.argsort(-size, kind="stable")  # longest first: rows that have ended are dropped from the right
        size = size[order]
        count = len(self.p["k"])
        table = (self.p["e"][:, None] + self.p["k"][None]).reshape(-1, embed)
        codes = (ids.astype(np.uint16) * np.uint16(count) + (0 if kinds is None else kinds.astype(np.uint16)))[order]
        # each direction begins at its own end of a row, so that no padding comes before a character
        back = np.zeros_like(codes)
        for row, own, m in zip(back, codes, size):
            row[:m] = own[:m][::-1]
        both = np.zeros((time + 1, 2, batch), np.intp)
        both[:-1, 0], both[:-1, 1] = np.ascontiguousarray(codes.T), np.ascontiguousarray(back.T)
        # states stand in columns, so that every gate is one run of memory; a column of ``z`` is twice the state, the
        # character and a one for the biases. Rows of ``g``: memory, then what ``weights`` gives: input, the three gates,
        # and the scores of the character before.
        order_of = np.r_[3 * n : 4 * n, n : 2 * n, :n, 2 * n : 3 * n]
        half = np.repeat(np.array([1, 0.5], np.float32), [n, 3 * n])[:, None]  # one tanh serves for all gates
        weights = np.zeros((2, 4 * n + k, n + embed + 1), np.float32)
        for d, own, w in zip("fr", weights, (self.p["w"][:n], self.p["w"][n:])):
            own[: 4 * n] = np.concatenate([self.p[f"h{d}"] * np.float32(0.5), self.p[f"x{d}"], self.p[f"c{d}"][None]]).T[order_of] * half
            own[4 * n :, :n] = w.T * np.float32(0.5)
        weights[0, 4 * n :, -1] = self.p["b"]
        scores = np.empty((time, k, 2, batch), np.float32)
        left = np.searchsorted(-size, -np.arange(time + 1), "right")  # rows of which a character or its score is to come
        width = 0
        for t in range(time + 1):
            if not t or width - left[t] >= 16:
                old, width = (np.zeros((n, 2, batch), np.float32),) * 2 if not t else (h, c), int(left[t])
                z, g = np.empty((n + embed + 1, 2, width), np.float32), np.empty((5 * n + k, 2, width), np.float32)
                h, x, c, u, o, label = z[:n], z[n:-1], g[:n], g[n : 2 * n], g[4 * n : 5 * n], g[5 * n :]
                inner, gates, both_in, both_by = g[n : 5 * n], g[2 * n : 5 * n], g[: 2 * n], g[2 * n : 4 * n]
                by_way, made = z.transpose(1, 0, 2), g[n:].transpose(1, 0, 2)
                h[:], c[:], z[-1] = old[0][:, :, :width], old[1][:, :, :width], 1
            x[:] = table.take(both[t, :, :width], axis=0, mode="clip").transpose(2, 0, 1)
            np.matmul(weights, by_way, out=made)
            if t:
                scores[t - 1, :, :, :width] = label
            np.tanh(inner, out=inner)
            gates += one  # twice the gate
            both_in *= both_by  # memory by forget gate, input by input gate
            c += u
            c *= np.float32(0.5)
            np.tanh(c, out=h)
            h *= o
        if time and size[-1] == time:
            whole, out = scores[:, :, 0] + scores[::-1, :, 1], np.empty((batch, k, time), np.float32)
            for at in range(0, batch, 16):
                out[at : at + 16] = whole[:, :, at : at + 16].transpose(2, 1, 0)
            return out.transpose(0, 2, 1)
        out = np.zeros((batch, k, time), np.float32)
        for at in range(0, batch, 16):
            ahead, back = (np.ascontiguousarray(scores[:, :, d, at : at + 16].transpose(2, 1, 0)) for d in (0, 1))
            for r, m, a, b in zip(order[at:], size[at:], ahead, back):
                np.add(a[:, :m], b[:, :m][:, ::-1], out=out[r, :, :m])
        return out.transpose(0, 2, 1)

    def step(self, ids: np.ndarray, gold: np.ndarray, kinds: np.ndarray | None = None) -> tuple[float, dict[str, np.ndarray]]:
        """Loss (negative log likelihood under the CRF, per character) and gradients of a batch."""
        grads = {k: np.zeros_like(v) for k, v in self.p.items()}
        kinds = np.zeros_like(ids) if kinds is None else kinds
        x = self.p["e"][ids.T] + self.p["k"][kinds.T]
        mask = (ids.T != PAD).astype(np.float32)[:, :, None]
        f, mf = self._run(x, mask, "f", True)
        r, mr = self._run(x[::-1], mask[::-1], "r", True)
        hidden = np.concatenate([f, r[::-1]], 2)
        s = (hidden @ self.p["w"] + self.p["b"]).astype(np.float64)
        t, (steps, batch, k) = self.p["t"].astype(np.float64), s.shape
        m = mask[:, :, 0].astype(bool)
        alpha, beta = np.empty_like(s), np.zeros_like(s)
        alpha[0] = s[0]
        for a in range(1, steps):
            nxt = logsum(alpha[a - 1][:, :, None] + t[None], 1) + s[a]
            alpha[a] = np.where(m[a][:, None], nxt, alpha[a - 1])
        for a in range(steps - 2, -1, -1):
            nxt = logsum(t[None] + (s[a + 1] + beta[a + 1])[:, None, :], 2)
            beta[a] = np.where(m[a + 1][:, None], nxt, beta[a + 1])
        z = logsum(alpha[-1], 1)
        own = np.exp(alpha + beta - z[None, :, None]) * m[:, :, None]
        g = gold.T
        rows = np.arange(batch)
        truth = np.zeros(batch)
        ds = own
        dt = np.zeros((k, k))
        for a in range(steps):
            on = m[a]
            truth += np.where(on, s[a, rows, g[a]], 0)
            ds[a, rows[on], g[a][on]] -= 1
            if a and on.any():
                truth += np.where(on, t[g[a - 1], g[a]], 0)
                both = np.exp(alpha[a - 1][on][:, :, None] + t[None] + (s[a] + beta[a])[on][:, None, :] - z[on][:, None, None])
                dt += both.sum(0)
                np.add.at(dt, (g[a - 1][on], g[a][on]), -1)
        total = m.sum()
        ds, dt = (ds / total).astype(np.float32), (dt / total).astype(np.float32)
        grads["t"] += dt
        grads["w"] += np.tensordot(hidden, ds, ((0, 1), (0, 1)))
        grads["b"] += ds.sum((0, 1))
        dhidden = ds @ self.p["w"].T
        dx = self._back(x, mask, "f", mf, dhidden[:, :, : self.hidden], grads)
        dx = dx + self._back(x[::-1], mask[::-1], "r", mr, dhidden[::-1, :, self.hidden :], grads)[::-1]
        for name, at in (("e", ids.T), ("k", kinds.T)):
            np.add.at(grads[name], at, dx * mask)
        return float((z - truth).sum() / total), grads

    def fit(self, texts: list[str], gold: list[np.ndarray], epochs: int = 6, batch: int = 32, rate: float = 8e-3, seed: int = 1, kinds: list[np.ndarray] | None = None) -> list[float]:
        """Adam over length-sorted batches; the mean loss of each epoch."""
        kinds = [np.zeros(len(t), np.int64) for t in texts] if kinds is None else kinds
        rng, ids = np.random.default_rng(seed), [symbols(t) for t in texts]
        order = np.argsort([len(i) for i in ids], kind="stable")
        groups = [order[i : i + batch] for i in range(0, len(order), batch)]
        m, v, n, losses = {k: np.zeros_like(x) for k, x in self.p.items()}, {k: np.zeros_like(x) for k, x in self.p.items()}, 0, []
        for e in range(epochs):
            seen = []
            for b in rng.permutation(len(groups)):
                own = groups[b]
                width = max(len(ids[i]) for i in own)
                x, y, z = (np.zeros((len(own), width), np.int64) for _ in range(3))
                for r, i in enumerate(own):
                    x[r, : len(ids[i])], y[r, : len(ids[i])], z[r, : len(ids[i])] = ids[i], gold[i], kinds[i]
                loss, g = self.step(x, y, z)
                seen.append(loss)
                n += 1
                size = np.sqrt(sum(float((q * q).sum()) for q in g.values()))
                lr = rate * (1 - (e + 0.5) / epochs) ** 0.7 * np.sqrt(1 - 0.999**n) / (1 - 0.9**n)
                for k, q in g.items():
                    q = q * min(1.0, 1.0 / max(size, 1e-9))
                    m[k] += 0.1 * (q - m[k])
                    v[k] += 0.001 * (q * q - v[k])
                    self.p[k] -= (lr * m[k] / (np.sqrt(v[k]) + 1e-8)).astype(np.float32)
            losses.append(float(np.mean(seen)))
        return losses

    def decode(self, scores: np.ndarray) -> np.ndarray:
        """Best labels (Viterbi) of one sequence of scores (time, labels)."""
        t = self.p["t"]
        best, back = scores[0], np.empty(scores.shape, np.int8)
        for a in range(1, len(scores)):
            c = best[:, None] + t
            back[a] = c.argmax(0)
            best = c.max(0) + scores[a]
        out = np.empty(len(scores), np.int64)
        out[-1] = best.argmax()
        for a in range(len(scores) - 1, 0, -1):
            out[a - 1] = back[a][out[a]]
        return out

    def decode_many(self, scores: np.ndarray, lengths: np.ndarray) -> list[np.ndarray]:
        """Best labels of several sequences of equal width, padded at their ends."""
        (rows, width, k), moves = scores.shape, self.p["t"][:, :, None]
        own = np.ascontiguousarray(scores.transpose(1, 2, 0), np.float32)
        best, whole = np.empty((width, k, rows), np.float32), int(lengths.min())
        best[0] = own[0]
        for a in range(1, width):
            new = (best[a - 1][:, None, :] + moves).max(0)
            new += own[a]
            best[a] = new if a < whole else np.where(a < lengths, new, best[a - 1])
        out = np.empty((width, rows), np.int64)
        out[-1] = best[-1].argmax(0)
        back = self.p["t"].T  # on the way back only the steps into the labels taken are looked at
        for a in range(width - 1, 0, -1):
            came = (best[a - 1] + back[out[a]].T).argmax(0)
            out[a - 1] = came if a < whole else np.where(a < lengths, came, out[a])
        return [out[:n, r] for r, n in enumerate(lengths)]
