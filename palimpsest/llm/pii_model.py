"""A character-level bidirectional LSTM with a linear-chain CRF, in numpy, learnt from labelled spans that are made here."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from .pii_rules import KINDS, luhn

#: Characters told apart: ASCII, and one class for all else.
CLASSES = 129
HIDDEN = 20
#: Labels: none, then for each kind its first and its further characters.
LABELS = 1 + 2 * len(KINDS)
WINDOW = 96
#: Training batches hold windows of one length, most of them `TRAIN_LENGTH`; nothing is padded, here or in decoding, so what a window gives does not depend on
#: the windows beside it.
TRAIN_BATCHES, TRAIN_LENGTH, EPOCHS, BATCH = 94, 80, 9, 30


def encode(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return np.minimum(codes, 128).astype("int64")


def _tanh_gates(z: np.ndarray, h: int) -> np.ndarray:
    """Input, forget and output gate and candidate; a logistic is a tanh of half its argument."""
    z[:, : 3 * h] *= 0.5
    np.tanh(z, out=z)
    z[:, : 3 * h] *= 0.5
    z[:, : 3 * h] += 0.5
    return z


class BiLstmCrf:
    def __init__(self, seed: int = 5, hidden: int = HIDDEN):
        rng, h = np.random.default_rng(seed), hidden
        self.h, self.p = h, {}
        for d in ("f", "b"):
            self.p["x" + d] = (rng.standard_normal((CLASSES, 4 * h)) * 0.3).astype("float32")
            self.p["x" + d][:, h : 2 * h] += 0.5
            self.p["u" + d] = (rng.standard_normal((h, 4 * h)) / h**0.5).astype("float32")
            self.p["o" + d] = (rng.standard_normal((h, LABELS)) / h**0.5).astype("float32")
        self.p["bias"] = np.zeros(LABELS, "float32")
        self.p["trans"] = np.zeros((LABELS, LABELS), "float32")
        self.allowed = np.zeros((LABELS, LABELS), "float32")
        for k in range(len(KINDS)):
            self.allowed[:, 2 + 2 * k] = -1e4  # a further character only follows one of its kind
            self.allowed[[1 + 2 * k, 2 + 2 * k], 2 + 2 * k] = 0

    def _run(self, x: np.ndarray, d: str, keep: bool):
        """States over time (T, B, H) in direction d; with ``keep``, what the backward pass needs."""
        t_max, n, h = x.shape[1], len(x), self.h
        table, u = self.p["x" + d], self.p["u" + d]
        state, cell = np.zeros((n, h), "float32"), np.zeros((n, h), "float32")
        out, kept = np.empty((t_max, n, h), "float32"), []
        for t in range(t_max) if d == "f" else range(t_max - 1, -1, -1):
            z = table[x[:, t]]
            z += state @ u
            _tanh_gates(z, h)
            before = cell
            cell = z[:, h : 2 * h] * cell + z[:, :h] * z[:, 3 * h :]
            tc = np.tanh(cell)
            if keep:
                kept.append((t, z, before, tc, state))
            state = z[:, 2 * h : 3 * h] * tc
            out[t] = state
        return out, kept

    def emissions(self, x: np.ndarray) -> np.ndarray:
        f, b = self._run(x, "f", False)[0], self._run(x, "b", False)[0]
        return f @ self.p["of"] + b @ self.p["ob"] + self.p["bias"]

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best labels (B, T) by Viterbi, and the margin of each label over the best other emission."""
        e = self.emissions(x)
        step = self.p["trans"] + self.allowed
        score = e[0].copy()
        score[:, 2::2] -= 1e4
        back = np.empty(e.shape, "int8")
        rows = np.arange(len(x))
        for t in range(1, len(e)):
            s = score[:, :, None] + step
            back[t] = s.argmax(axis=1)
            score = s.max(axis=1) + e[t]
        labels = np.empty((len(x), len(e)), "int8")
        labels[:, -1] = score.argmax(axis=1)
        for t in range(len(e) - 1, 0, -1):
            labels[:, t - 1] = back[t, rows, labels[:, t]]
        top = np.sort(e, axis=2)
        return labels, (top[:, :, -1] - top[:, :, -2]).T

    def _gradient(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        t_max, n, h = x.shape[1], len(x), self.h
        states = {d: self._run(x, d, True) for d in "fb"}
        e = (states["f"][0] @ self.p["of"] + states["b"][0] @ self.p["ob"] + self.p["bias"]).astype("float64")
        step = (self.p["trans"] + self.allowed).astype("float64")

        def lse(a, axis):
            m = a.max(axis=axis, keepdims=True)
            return (m + np.log(np.exp(a - m).sum(axis=axis, keepdims=True))).squeeze(axis)

        alpha, beta = np.empty_like(e), np.zeros_like(e)
        alpha[0] = e[0]
        for t in range(1, t_max):
            alpha[t] = e[t] + lse(alpha[t - 1][:, :, None] + step, 1)
        for t in range(t_max - 2, -1, -1):
            beta[t] = lse(step + (e[t + 1] + beta[t + 1])[:, None, :], 2)
        z = lse(alpha[-1], 1)
        de = np.exp(alpha + beta - z[None, :, None])
        rows, times = np.arange(n), np.arange(t_max)[:, None]
        g = {"trans": np.exp(alpha[:-1, :, :, None] + step + (e[1:] + beta[1:])[:, :, None, :] - z[None, :, None, None]).sum(axis=(0, 1))}
        np.add.at(g["trans"], (y[:, :-1].ravel(), y[:, 1:].ravel()), -1)
        gold = e[times, rows, y.T].sum(axis=0) + step[y[:, :-1], y[:, 1:]].sum(axis=1)
        de[times, rows, y.T] -= 1
        de /= n
        g["trans"] /= n
        g["bias"] = de.sum(axis=(0, 1))
        seen = np.zeros((t_max * n, CLASSES), "float32")
        seen[np.arange(t_max * n), x.T.ravel()] = 1
        for d in "fb":
            out, kept = states[d]
            g["o" + d] = out.reshape(-1, h).T @ de.reshape(-1, LABELS)
            dh_all = (de @ self.p["o" + d].T).astype("float32")
            gu, steps = np.zeros_like(self.p["u" + d]), np.empty((t_max, n, 4 * h), "float32")
            dh, dc = np.zeros((n, h), "float32"), np.zeros((n, h), "float32")
            for t, a, before, tc, state in reversed(kept):
                i, f, o, c = a[:, :h], a[:, h : 2 * h], a[:, 2 * h : 3 * h], a[:, 3 * h :]
                dh = dh + dh_all[t]
                dc = dc + dh * o * (1 - tc**2)
                dz = np.concatenate((dc * c * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - c**2)), axis=1)
                steps[t] = dz
                gu += state.T @ dz
                dh, dc = dz @ self.p["u" + d].T, dc * f
            g["x" + d], g["u" + d] = seen.T @ steps.reshape(-1, 4 * h), gu
        return float((z - gold).mean()), g

    def fit(self, batches: list[tuple[np.ndarray, np.ndarray]], epochs: int = EPOCHS, rate: float = 0.01, seed: int = 6) -> list[float]:
        """Adam with a step that falls to zero; returns the loss of each epoch."""
        rng, m, v, k, losses = np.random.default_rng(seed), {}, {}, 0, []
        for _ in range(epochs):
            total = 0.0
            for i in rng.permutation(len(batches)).tolist():
                loss, g = self._gradient(*batches[i])
                total += loss / len(batches)
                k += 1
                for name, d in g.items():
                    d = np.clip(d, -1, 1).astype("float32")
                    m[name] = 0.9 * m.get(name, 0) + 0.1 * d
                    v[name] = 0.99 * v.get(name, 0) + 0.01 * d * d
                    self.p[name] -= rate * (1 - (k - 1) / (epochs * len(batches))) * (m[name] / (1 - 0.9**k)) / (np.sqrt(v[name] / (1 - 0.99**k)) + 1e-7)
            losses.append(total)
        return losses


def _digits(rng, n: int) -> str:
    return "".join(map(str, rng.integers(0, 10, n)))


def _card(rng) -> str:
    """16 to 19 digits, whatever the first one, whole or in groups."""
    n = int(rng.choice([16, 16, 16, 17, 18, 19]))
    d = str(rng.integers(2, 7)) + _digits(rng, n - 2)
    d += next(c for c in "0123456789" if luhn(d + c))
    if rng.random() < 0.5:
        return d
    return str(rng.choice([" ", "-", "."])).join(d[i : i + 4] for i in range(0, n, 4))


def _word(rng) -> str:
    return "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyzéüñ"), rng.integers(1, 9)))


def _name(rng, most: int = 9) -> str:
    return "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), rng.integers(1, most + 1)))


def _email(rng) -> str:
    """One to three names with signs between, an at in words or as a sign, a domain of two to four names."""
    user = str(rng.choice([".", "_", "-", ""])).join(_name(rng) for _ in range(rng.integers(1, 4))) + str(rng.choice(["", "", str(rng.integers(0, 100))]))
    host = _name(rng) + str(rng.choice(["", "", "-" + _name(rng), str(rng.integers(0, 10))]))
    at = str(rng.choice(["@", "@", " @ ", "(at)", " (at) ", "[at]", " [at] "]))
    dot = "." if at == "@" or rng.random() < 0.6 else str(rng.choice(["(dot)", "[dot]"]))
    inner = "".join(dot + _name(rng) for _ in range(int(rng.choice([0, 0, 1, 2]))))
    return f"{user}{at}{host}{inner}{dot}{rng.choice(['com', 'org', 'net', 'de', 'fr', 'es', 'edu', 'info', 'co.uk'])}"


def _ip(rng) -> str:
    parts = map(str, rng.integers(0, 256, 4))
    return rng.choice([".", ".", ".", "[.]", " . "]).join(parts)


def _phone(rng) -> str:
    a, b, c = _digits(rng, 3), _digits(rng, 3), _digits(rng, 4)
    return str(rng.choice([f"+1 ({a}) {b}-{c}", f"+{rng.integers(1, 99)} {a} {b} {c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"00{rng.integers(1, 99)} {a} {b}{c}", f"1-{a}-{b}-{c}", f"+1 {a}.{b}.{c}"]))


def _other(rng) -> str:
    """Digits and signs that are nobody's."""
    n = rng.integers(0, 8)
    if n == 0:
        return f"version {rng.integers(0, 9)}.{rng.integers(0, 20)}" + rng.choice(["", f".{rng.integers(0, 9)}"])
    if n == 1:
        return f"{rng.integers(1900, 2100)}-{rng.integers(1, 13):02d}-{rng.integers(1, 29):02d}"
    if n == 2:
        return "".join(rng.choice(list("0123456789abcdef"), rng.integers(8, 40)))
    if n == 3:
        return f"{rng.integers(0, 999)}.{rng.integers(0, 99):02d}"
    if n == 4:
        return str(rng.integers(0, 10 ** int(rng.integers(1, 9))))
    if n == 5:
        return f"@{_word(rng)}"
    if n == 6:
        return f"{_digits(rng, 2)}:{_digits(rng, 2)} {_word(rng)} {rng.integers(1, 30)}/{rng.integers(1, 30)}"
    return f"{_digits(rng, int(rng.integers(10, 16)))}"


def labelled(batches: int = TRAIN_BATCHES, seed: int = 8) -> list[tuple[np.ndarray, np.ndarray]]:
    """Batches of windows with labelled spans among invented words, some spans side by side and cut by a window's edge."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(batches):
        size = TRAIN_LENGTH if rng.random() < 0.7 else int(rng.integers(16, TRAIN_LENGTH))
        windows = [_window(rng, size) for _ in range(BATCH)]
        out.append((np.stack([x for x, _ in windows]), np.stack([y for _, y in windows])))
    return out


def _window(rng, size: int) -> tuple[np.ndarray, np.ndarray]:
    makers = (_email, _ip, _card, _phone)
    text, labels = "", []

    def put(s: str, kind: int = -1) -> None:
        nonlocal text
        text += s
        labels.extend([0] * len(s) if kind < 0 else [1 + 2 * kind] + [2 + 2 * kind] * (len(s) - 1))

    upper = rng.random() < 0.15
    while len(text) < size + 30:
        pick = rng.random()
        if pick < 0.3:
            k = int(rng.integers(0, 4))
            put(makers[k](rng), k)
            if rng.random() < 0.2:
                put(" ")
                put(makers[k](rng), k)
        elif pick < 0.5:
            put(_other(rng))
        else:
            for _ in range(rng.integers(1, 4)):
                w = _word(rng)
                put((w.upper() if upper else w.capitalize() if rng.random() < 0.2 else w) + rng.choice(["", "", ",", ".", "!!", "###", "***", " |"]) + " ")
        put(str(rng.choice([" ", " ", ", ", ". ", "\n", "### ", ") "])))
    at = int(rng.integers(0, 30))
    y = np.array(labels[at : at + size], "int64")
    if y[0] and y[0] % 2 == 0:
        y[0] -= 1  # a span cut by the edge begins there
    return encode(text[at : at + size]), y


@lru_cache(maxsize=1)
def trained() -> BiLstmCrf:
    """Learnt once in a driver process, from a fixed seed: reruns agree."""
    model = BiLstmCrf()
    model.fit(labelled())
    return model
