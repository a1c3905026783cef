"""Character-level bidirectional LSTM with a CRF on top, forward and backward in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

KINDS = ("email", "ip", "card", "phone")
TAGS = 1 + 2 * len(KINDS)  # outside, then begin and inside of each kind
WINDOW = 64
_VOCABULARY = 130


def char_ids(text: str) -> np.ndarray:
    """ASCII codes; 128 stands for other letters, 129 for anything else; 0 pads."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    wide = codes > 127
    if wide.any():
        codes[wide] = [128 if chr(c).isalpha() else 129 for c in codes[wide]]
    return codes


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


@dataclass
class Tagger:
    parameters: dict[str, np.ndarray]

    @classmethod
    def fresh(cls, hidden: int = 20, size: int = 12, seed: int = 9) -> Tagger:
        g = np.random.default_rng(seed)
        p = {"chars": g.normal(0, 0.3, (_VOCABULARY, size)), "out": g.normal(0, 0.2, (2 * hidden, TAGS)), "bias": np.zeros(TAGS), "moves": np.zeros((TAGS, TAGS))}
        for side in "fb":
            p[f"x{side}"] = g.normal(0, 0.25, (size, 4 * hidden))
            p[f"h{side}"] = g.normal(0, 0.2, (hidden, 4 * hidden))
            p[f"c{side}"] = np.concatenate([np.zeros(hidden), np.ones(hidden), np.zeros(2 * hidden)])
        return cls(p)

    def _lstm(self, x: np.ndarray, side: str) -> tuple[np.ndarray, list]:
        """States (batch, time, hidden) of one direction, and what the backward pass needs."""
        wh = self.parameters[f"h{side}"]
        n = wh.shape[0]
        pre = x @ self.parameters[f"x{side}"] + self.parameters[f"c{side}"]
        h = c = np.zeros((len(x), n))
        states, kept = np.zeros((x.shape[0], x.shape[1], n)), []
        for t in range(x.shape[1]) if side == "f" else range(x.shape[1] - 1, -1, -1):
            a = pre[:, t] + h @ wh
            gates = _sigmoid(a[:, : 3 * n])
            i, f, o, g = gates[:, :n], gates[:, n : 2 * n], gates[:, 2 * n :], np.tanh(a[:, 3 * n :])
            before, c = c, f * c + i * g
            u = np.tanh(c)
            kept.append((t, h, before, i, f, o, g, u))
            h = o * u
            states[:, t] = h
        return states, kept

    def _lstm_back(self, x: np.ndarray, side: str, kept: list, grad: np.ndarray, into: dict[str, np.ndarray]) -> np.ndarray:
        wh = self.parameters[f"h{side}"]
        da_all, dwh = np.zeros((x.shape[0], x.shape[1], wh.shape[1])), np.zeros_like(wh)
        dh = dc = np.zeros((len(x), wh.shape[0]))
        for t, h, before, i, f, o, g, u in reversed(kept):
            dh = dh + grad[:, t]
            dc = dc + dh * o * (1 - u * u)
            da = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), dh * u * o * (1 - o), dc * i * (1 - g * g)], axis=1)
            dwh += h.T @ da
            da_all[:, t] = da
            dh, dc = da @ wh.T, dc * f
        into[f"h{side}"] = dwh
        flat = da_all.reshape(-1, da_all.shape[2])
        into[f"x{side}"] = x.reshape(-1, x.shape[2]).T @ flat
        into[f"c{side}"] = flat.sum(axis=0)
        return da_all @ self.parameters[f"x{side}"].T

    def emissions(self, ids: np.ndarray) -> np.ndarray:
        """Tag scores (batch, time, tags) of equally long windows."""
        x = self.parameters["chars"][ids]
        both = np.concatenate([self._lstm(x, "f")[0], self._lstm(x, "b")[0]], axis=2)
        return both @ self.parameters["out"] + self.parameters["bias"]

    def marginals(self, scores: np.ndarray) -> np.ndarray:
        """Probability of each tag at each place (batch, time, tags) under the CRF."""
        ahead, back, total = self._chain(scores)
        return np.exp(ahead + back - total[:, None, None])

    def _chain(self, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        moves = self.parameters["moves"]
        ahead, back = np.zeros_like(scores), np.zeros_like(scores)
        ahead[:, 0] = scores[:, 0]
        for t in range(1, scores.shape[1]):
            ahead[:, t] = _logsum(ahead[:, t - 1, :, None] + moves, 1) + scores[:, t]
        for t in range(scores.shape[1] - 2, -1, -1):
            back[:, t] = _logsum(moves + (scores[:, t + 1] + back[:, t + 1])[:, None, :], 2)
        return ahead, back, _logsum(ahead[:, -1], 1)

    def decode(self, scores: np.ndarray) -> np.ndarray:
        """Best tags of one sequence of emissions (time, tags)."""
        moves = self.parameters["moves"]
        best, came = scores[0], np.zeros(scores.shape, np.int64)
        for t in range(1, len(scores)):
            all_ways = best[:, None] + moves
            came[t] = all_ways.argmax(axis=0)
            best = all_ways.max(axis=0) + scores[t]
        tags = np.zeros(len(scores), np.int64)
        tags[-1] = best.argmax()
        for t in range(len(scores) - 1, 0, -1):
            tags[t - 1] = came[t, tags[t]]
        return tags

    def step(self, ids: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log likelihood of a batch, and its gradient."""
        p, n = self.parameters, len(ids)
        x = p["chars"][ids]
        hf, kf = self._lstm(x, "f")
        hb, kb = self._lstm(x, "b")
        both = np.concatenate([hf, hb], axis=2)
        scores = both @ p["out"] + p["bias"]
        ahead, back, total = self._chain(scores)
        rows = np.arange(n)[:, None]
        gold = np.take_along_axis(scores, tags[:, :, None], 2).sum(axis=(1, 2)) + p["moves"][tags[:, :-1], tags[:, 1:]].sum(axis=1)
        grad = np.exp(ahead + back - total[:, None, None])
        grad[rows, np.arange(ids.shape[1]), tags] -= 1
        pair = ahead[:, :-1, :, None] + p["moves"] + (scores + back)[:, 1:, None, :] - total[:, None, None, None]
        moves = np.exp(pair).sum(axis=(0, 1))
        np.subtract.at(moves, (tags[:, :-1].ravel(), tags[:, 1:].ravel()), 1)
        grad, moves = grad / n, moves / n
        out = {"moves": moves, "out": both.reshape(-1, both.shape[2]).T @ grad.reshape(-1, TAGS), "bias": grad.sum(axis=(0, 1))}
        inner = grad @ p["out"].T
        half = hf.shape[2]
        dx = self._lstm_back(x, "f", kf, inner[:, :, :half], out) + self._lstm_back(x, "b", kb, inner[:, :, half:], out)
        out["chars"] = np.zeros_like(p["chars"])
        np.add.at(out["chars"], ids.ravel(), dx.reshape(-1, dx.shape[2]))
        return float((total - gold).mean()), out

    def fit(self, ids: np.ndarray, tags: np.ndarray, epochs: int = 10, batch: int = 32, rate: float = 0.01, seed: int = 3) -> list[float]:
        """Adam over shuffled batches; the mean loss of each epoch."""
        g, losses, k = np.random.default_rng(seed), [], 0
        first = {n: np.zeros_like(v) for n, v in self.parameters.items()}
        second = {n: np.zeros_like(v) for n, v in self.parameters.items()}
        for _ in range(epochs):
            order, seen = g.permutation(len(ids)), []
            for s in range(0, len(order), batch):
                part = order[s : s + batch]
                loss, grads = self.step(ids[part], tags[part])
                seen.append(loss)
                k += 1
                for n, d in grads.items():
                    d = np.clip(d, -5, 5)
                    first[n] += 0.1 * (d - first[n])
                    second[n] += 0.001 * (d * d - second[n])
                    self.parameters[n] -= rate * (first[n] / (1 - 0.9**k)) / (np.sqrt(second[n] / (1 - 0.999**k)) + 1e-8)
            losses.append(float(np.mean(seen)))
        return losses
