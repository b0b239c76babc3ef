"""A character-level bidirectional LSTM with CRF transitions, in numpy: inference, and training with Adam."""

from __future__ import annotations

import numpy as np

SYMBOLS = 1700


def encode(text: str) -> np.ndarray:
    """Symbol of each character: digits are one symbol, syllables and rare characters share hashed ones."""
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = np.where(cp < 592, cp, 1624 + cp % 64)
    out = np.where((cp >= 0xAC00) & (cp <= 0xD7A3), 600 + ((cp * np.uint32(2654435761)) >> np.uint32(22)) % 1024, out)
    digit = (cp >= 48) & (cp <= 57) | (cp >= 0xFF10) & (cp <= 0xFF19)
    return np.where(digit, 48, np.where(cp == 0, 1, out)).astype(np.int16)


def init(tags: int, embed: int = 16, hidden: int = 20, seed: int = 3) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    g = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
    p = {"E": (0.3 * rng.standard_normal((SYMBOLS, embed))).astype(np.float32), "V": g(2 * hidden, tags), "d": np.zeros(tags, np.float32), "A": np.zeros((tags, tags), np.float32)}
    for k in "fb":
        p |= {f"W{k}": g(embed, 4 * hidden), f"U{k}": g(hidden, 4 * hidden), f"c{k}": np.r_[np.zeros(hidden), np.ones(hidden), np.zeros(2 * hidden)].astype(np.float32)}
    return p


def _gates(z: np.ndarray, h: int) -> None:
    """In place: sigmoid of the first three blocks (i, f, o), tanh of the last (g)."""
    z[:, : 3 * h] *= 0.5
    np.tanh(z, out=z)
    z[:, : 3 * h] *= 0.5
    z[:, : 3 * h] += 0.5


def _states(x: np.ndarray, table: np.ndarray, u: np.ndarray, w: np.ndarray | None = None, going: list[int] | None = None, back: bool = False, out: np.ndarray | None = None) -> np.ndarray:
    """Hidden states (T, B, H) of symbol rows x (T, B), as _direction gives them, for inference: all gates by one exp,
    tanh(z) being 2 / (1 + exp(-2 z)) - 1, in buffers that are used again, each gate's values standing together.

    The gates get table[x] @ w, or table[x] itself. going: how many rows are longer than 0, 1, ...; rows stand longest
    first and nothing is reckoned behind their ends. back: from the ends to the starts. out: (T, H, B), zero behind the ends."""
    t, b = x.shape
    h, m = u.shape[0], table.shape[1]
    scale = np.r_[np.full(3 * h, -1), np.full(h, -2)].astype(np.float32)
    w = np.ascontiguousarray((np.concatenate([u, np.eye(m, dtype=np.float32) if w is None else w]) * scale).T)
    table, x = np.ascontiguousarray(table.T), x.astype(np.intp)
    out = np.zeros((t, h, b), np.float32) if out is None else out
    inputs, cells, gates, news = (np.zeros((n, b), np.float32) for n in (h + m, h, 4 * h, h))  # cells: times -2
    symbols, n = inputs[h:], 0
    one, two, four = (np.array(v, np.float32) for v in (1, 2, -4))
    with np.errstate(over="ignore"):  # exp gives inf, its gate 0
        for k in range(t - 1, -1, -1) if back else range(t):
            if n != (n := going[k] if going else b):
                before, hid, z, cell, new = inputs[:, :n], inputs[:h, :n], gates[:, :n], cells[:, :n], news[:, :n]
                i, f, o, g = (z[j * h : (j + 1) * h] for j in range(4))
            table.take(x[k], 1, symbols, "clip")
            np.matmul(w, before, z)
            np.exp(z, z)
            np.add(z, one, z)
            np.divide(four, g, new)
            np.add(new, two, new)
            np.divide(new, i, new)
            np.divide(cell, f, cell)
            np.add(cell, new, cell)
            np.exp(cell, new)
            np.add(new, one, new)
            np.divide(two, new, new)
            np.subtract(new, one, new)
            np.divide(new, o, hid)
            out[k, :, :n] = hid
    return out.transpose(0, 2, 1)


def _direction(x: np.ndarray, table: np.ndarray, u: np.ndarray, keep: list | None = None) -> np.ndarray:
    """Hidden states (T, B, H) of symbol rows x (T, B)."""
    t, b = x.shape
    h = u.shape[0]
    out, hid, cell = np.empty((t, b, h), np.float32), np.zeros((b, h), np.float32), np.zeros((b, h), np.float32)
    for k in range(t):
        z = table[x[k]]
        z += hid @ u
        _gates(z, h)
        before = cell
        cell = z[:, h : 2 * h] * cell
        cell += z[:, :h] * z[:, 3 * h :]
        squashed = np.tanh(cell)
        previous, hid = hid, z[:, 2 * h : 3 * h] * squashed
        out[k] = hid
        if keep is not None:
            keep.append((z, before, squashed, previous))
    return out


def reversed_rows(x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Each row (B, T, ...) reversed within its length, the padding staying at the end."""
    at = np.arange(x.shape[1])[None, :]
    back = np.where(at < lengths[:, None], lengths[:, None] - 1 - at, at)
    return np.take_along_axis(x, back if x.ndim == 2 else back[:, :, None], 1)


def emissions(p: dict, x: np.ndarray, lengths: np.ndarray, room: np.ndarray | None = None) -> np.ndarray:
    """(T, B, tags) of symbol rows x (B, T). room: for states, T * B * (2 H + 1) finite numbers or more."""
    if (lengths[1:] > lengths[:-1]).any():  # longest first
        order = np.argsort(-lengths, kind="stable")
        return emissions(p, x[order], lengths[order], room)[:, np.argsort(order)]
    h, (b, t) = p["Uf"].shape[0], x.shape
    going = np.searchsorted(-lengths, -np.arange(t), "left").tolist()
    room = np.zeros(t * b * (2 * h + 1), np.float32) if room is None else room
    x, both = np.ascontiguousarray(x.T), room[: t * b * (2 * h + 1)].reshape(t, 2 * h + 1, b)
    table = np.concatenate([p["E"], np.ones((len(p["E"]), 1), np.float32)], axis=1)
    _states(x, table, p["Uf"], np.concatenate([p["Wf"], p["cf"][None]]), going, False, both[:, :h])
    _states(x, table, p["Ub"], np.concatenate([p["Wb"], p["cb"][None]]), going, True, both[:, h : 2 * h])
    both[:, 2 * h] = 1
    v = np.concatenate([p["V"], p["d"][None]])
    out = np.empty((b, t, v.shape[1]), np.float32)
    for k in range(0, t, 16):  # turned round while they are in the cache
        out[:, k : k + 16] = (both[k : k + 16].transpose(0, 2, 1) @ v).transpose(1, 0, 2)
    if going[-1] < b:
        pad = np.arange(t)[None, :] >= lengths[:, None]
        out[pad] = -30
        out[pad, 0] = 0
    return out.transpose(1, 0, 2)


def viterbi(e: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Best tags (B, T) of emissions (T, B, K) with transitions a; the way back is found on the path alone."""
    t, b, k = e.shape
    e = np.ascontiguousarray(e.transpose(0, 2, 1))
    scores, step = e.copy(), a[:, :, None]
    for i in range(1, t):
        scores[i] += (scores[i - 1][:, None, :] + step).max(axis=0)
    tags = np.empty((b, t), np.int8)
    tags[:, -1] = scores[-1].argmax(axis=0)
    for i in range(t - 1, 0, -1):
        tags[:, i - 1] = (scores[i - 1] + a[:, tags[:, i]]).argmax(axis=0)
    return tags


def paths(e: np.ndarray, a: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Best tags (N) of the stretches of emissions e (N, K) that begin at starts, each decoded by itself; 0 elsewhere.
    Stretches are taken by size, so that at each step those that are over stand last and no padding is reckoned."""
    tags, scores, step, steps = np.zeros(len(e), np.int8), e.copy(), a[:, :, None], np.ascontiguousarray(a.T)
    order = np.argsort(-sizes, kind="stable")
    for lo in range(0, len(order), 1024):
        first, n = starts[order[lo : lo + 1024]], sizes[order[lo : lo + 1024]]
        going = np.searchsorted(-n, -np.arange(n[0] + 1), "left").tolist()  # how many are longer than 0, 1, ...
        last = np.ascontiguousarray(e[first].T)
        for i in range(1, n[0]):
            at = first[: going[i]] + i
            last = (last[:, None, : going[i]] + step).max(axis=0)
            last += e[at].T
            scores[at] = last.T
        best = np.zeros(0, np.int64)
        for i in range(n[0] - 1, -1, -1):
            at = first[: going[i]] + i
            s = scores[at]
            s[: going[i + 1]] += steps[best]
            best = s.argmax(axis=1)
            tags[at] = best
    return tags


def _crf(e: np.ndarray, a: np.ndarray, y: np.ndarray, mask: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Negative log likelihood per row, gradients for e (T, B, K) and a. y, mask: (T, B)."""
    t, b, k = e.shape
    alpha, beta = np.empty_like(e), np.empty_like(e)
    alpha[0] = e[0]
    lse = lambda s, ax: (m := s.max(axis=ax, keepdims=True)).squeeze(ax) + np.log(np.exp(s - m).sum(axis=ax))
    for i in range(1, t):
        new = lse(alpha[i - 1][:, :, None] + a[None], 1) + e[i]
        alpha[i] = np.where(mask[i][:, None], new, alpha[i - 1])
    beta[-1] = 0
    for i in range(t - 2, -1, -1):
        new = lse(a[None] + (e[i + 1] + beta[i + 1])[:, None, :], 2)
        beta[i] = np.where(mask[i + 1][:, None], new, beta[i + 1])
    z = lse(alpha[-1], 1)
    de = np.exp(alpha + beta - z[None, :, None]) * mask[:, :, None]
    rows, da = np.arange(b), np.zeros_like(a)
    gold = e[0, rows, y[0]].sum()
    de[0, rows, y[0]] -= 1
    for i in range(1, t):
        m = mask[i]
        if not m.any():
            break
        pair = alpha[i - 1][m][:, :, None] + a[None] + (e[i][m] + beta[i][m])[:, None, :] - z[m][:, None, None]
        da += np.exp(pair).sum(axis=0)
        np.add.at(da, (y[i - 1][m], y[i][m]), -1)
        gold += e[i, rows[m], y[i][m]].sum() + a[y[i - 1][m], y[i][m]].sum()
        de[i, rows[m], y[i][m]] -= 1
    return float(z.sum() - gold) / b, de / b, da / b


def gradients(p: dict, x: np.ndarray, lengths: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
    """Loss and gradients for rows x, y (B, T)."""
    h = p["Uf"].shape[0]
    mask = (np.arange(x.shape[1])[:, None] < lengths[None, :])
    sides, states = {}, []
    for k, rows in (("f", x), ("b", reversed_rows(x, lengths))):
        keep: list = []
        xt = np.ascontiguousarray(rows.T)
        out = _direction(xt, p["E"] @ p[f"W{k}"] + p[f"c{k}"], p[f"U{k}"], keep)
        sides[k] = (xt, keep)
        states.append(out if k == "f" else reversed_rows(out.transpose(1, 0, 2), lengths).transpose(1, 0, 2))
    both = np.concatenate(states, axis=2)
    loss, de, da = _crf(both @ p["V"] + p["d"], p["A"], np.ascontiguousarray(y.T), mask)
    g = {"A": da, "d": de.sum(axis=(0, 1)), "V": np.tensordot(both, de, ([0, 1], [0, 1]))}
    dboth = de @ p["V"].T
    g["E"] = np.zeros_like(p["E"])
    for k, d in (("f", dboth[:, :, :h]), ("b", reversed_rows(dboth[:, :, h:].transpose(1, 0, 2), lengths).transpose(1, 0, 2))):
        xt, keep = sides[k]
        u = p[f"U{k}"]
        dtable, du = np.zeros((SYMBOLS, 4 * h), np.float32), np.zeros_like(u)
        dh, dc = np.zeros((x.shape[0], h), np.float32), np.zeros((x.shape[0], h), np.float32)
        for i in range(len(keep) - 1, -1, -1):
            z, before, squashed, previous = keep[i]
            dh = dh + d[i]
            gi, gf, go, gg = z[:, :h], z[:, h : 2 * h], z[:, 2 * h : 3 * h], z[:, 3 * h :]
            dc = dc + dh * go * (1 - squashed**2)
            dz = np.concatenate([dc * gg * gi * (1 - gi), dc * before * gf * (1 - gf), dh * squashed * go * (1 - go), dc * gi * (1 - gg**2)], axis=1)
            np.add.at(dtable, xt[i], dz)
            du += previous.T @ dz
            dh, dc = dz @ u.T, dc * gf
        g |= {f"U{k}": du, f"c{k}": dtable.sum(axis=0), f"W{k}": p["E"].T @ dtable}
        g["E"] += dtable @ p[f"W{k}"].T
    return loss, g


class Adam:
    def __init__(self, p: dict, rate: float = 0.01) -> None:
        self.p, self.rate, self.t = p, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in p.items()}
        self.v = {k: np.zeros_like(v) for k, v in p.items()}

    def step(self, g: dict) -> None:
        self.t += 1
        norm = np.sqrt(sum(float((x**2).sum()) for x in g.values()))
        for k, x in g.items():
            x = x * min(1.0, 5.0 / (norm + 1e-9))
            self.m[k] = 0.9 * self.m[k] + 0.1 * x
            self.v[k] = 0.999 * self.v[k] + 0.001 * x * x
            self.p[k] -= (self.rate * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.999**self.t)) + 1e-8)).astype(np.float32)
