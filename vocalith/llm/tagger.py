"""A character-level bidirectional LSTM with CRF transitions, in numpy."""

from __future__ import annotations

import numpy as np

#: Characters with a class of their own; all others fall into classes by kind.
KNOWN = "".join(map(chr, range(32, 127))) + "\näöüßéèêáíóúñçàâ"
_CLASS = {c: i + 1 for i, c in enumerate(KNOWN)}
_KINDS = len(KNOWN) + 1
V = _KINDS + 6
#: Each character also says whether its word is a listed given name, a listed family name, or both. An input is the class
#: of the character plus V times this.
FLAGS = 4


def _kind(c: str) -> int:
    o = ord(c)
    if 0x400 <= o < 0x530:
        return _KINDS + (0 if c.islower() else 1)
    if o >= 0x2E80:
        return _KINDS + 2
    if c.isalpha():
        return _KINDS + (3 if c.islower() else 4)
    return _KINDS + 5


_TABLE = np.array([_CLASS.get(chr(i)) or _kind(chr(i)) for i in range(0x3000)], dtype=np.int16)


def char_classes(text: str) -> np.ndarray:
    """The class of each code point; 0 is padding."""
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return np.where(cp < 0x3000, _TABLE[np.minimum(cp, 0x2FFF)], _KINDS + 2).astype(np.int16)


def new_model(hidden: int, tags: int, seed: int = 7) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    f = lambda *s, scale: (r.standard_normal(s) * scale).astype(np.float32)
    x = f(2, V, 4 * hidden, scale=0.3)
    x[:, :, hidden : 2 * hidden] += 1.0  # the forget gates start open
    return {
        "x": x, "w": f(2, FLAGS, 4 * hidden, scale=0.3), "h": f(2, hidden, 4 * hidden, scale=1 / np.sqrt(hidden)), "o": f(2, hidden, tags, scale=0.3),
        "b": np.zeros(tags, dtype=np.float32), "t": np.zeros((tags, tags), dtype=np.float32),
    }


def _sigmoid(z: np.ndarray) -> np.ndarray:
    np.negative(z, out=z)
    np.exp(z, out=z)
    z += 1.0
    return np.reciprocal(z, out=z)


def _inputs(m: dict) -> np.ndarray:
    """What each input adds to the gates, (2, V * FLAGS, 4 hidden)."""
    return (m["w"][:, :, None, :] + m["x"][:, None, :, :]).reshape(2, FLAGS * V, -1)


def _steps(m: dict, idx: np.ndarray, keep: bool) -> tuple[np.ndarray, tuple | None]:
    """Emissions (T, B, K) of the windows ``idx`` (B, T); the gates too if ``keep``."""
    size, length = idx.shape
    hid = m["h"].shape[1]
    flow = np.ascontiguousarray(np.stack([idx.T, idx.T[::-1]], axis=1))  # (T, 2, B)
    h = np.zeros((2, size, hid), dtype=np.float32)
    c = np.zeros_like(h)
    em = np.tile(m["b"], (length, size, 1))
    table = _inputs(m)
    if keep:
        kind = m["h"].dtype
        gates = np.empty((length, 2, size, 4 * hid), dtype=kind)
        cells, hs = np.empty((length, 2, size, hid), dtype=kind), np.empty((length, 2, size, hid), dtype=kind)
    for t in range(length):
        z = np.matmul(h, m["h"])
        z[0] += table[0][flow[t, 0]]
        z[1] += table[1][flow[t, 1]]
        g = np.tanh(z[:, :, 3 * hid :])
        s = _sigmoid(np.clip(z[:, :, : 3 * hid], -30, 30))
        c = s[:, :, hid : 2 * hid] * c + s[:, :, :hid] * g
        h = s[:, :, 2 * hid :] * np.tanh(c)
        em[t] += h[0] @ m["o"][0]
        em[length - 1 - t] += h[1] @ m["o"][1]
        if keep:
            gates[t, :, :, : 3 * hid], gates[t, :, :, 3 * hid :], cells[t], hs[t] = s, g, c, h
    return em, ((flow, gates, cells, hs) if keep else None)


def _crf(em: np.ndarray, y: np.ndarray, trans: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """(loss per character, gradient of the emissions, of the transitions); forward and backward sums are scaled in each step."""
    length, size, k = em.shape
    top = em.max(axis=2, keepdims=True)
    e, tr = np.exp(em - top), np.exp(trans)
    a, b = np.empty_like(e), np.empty_like(e)
    scale = np.empty((length, size, 1), dtype=e.dtype)
    a[0] = e[0]
    for t in range(length):
        if t:
            np.matmul(a[t - 1], tr, out=a[t])
            a[t] *= e[t]
        np.sum(a[t], axis=1, keepdims=True, out=scale[t])
        a[t] /= scale[t]
    b[-1] = 1
    for t in range(length - 1, 0, -1):
        e[t] *= b[t]
        e[t] /= scale[t]
        np.matmul(e[t], tr.T, out=b[t - 1])
    d_em = a * b
    d_tr = tr * (a[:-1].reshape(-1, k).T @ e[1:].reshape(-1, k))
    yt = np.ascontiguousarray(y.T)
    pairs = yt[:-1] * k + yt[1:]
    d_tr -= np.bincount(pairs.reshape(-1), minlength=k * k).reshape(k, k)
    at = (np.arange(length)[:, None], np.arange(size)[None, :], yt)
    gold = em[at].sum() + trans.reshape(-1)[pairs].sum()
    d_em[at] -= 1
    n = length * size
    return float(np.log(scale).sum() + top.sum() - gold) / n, d_em / n, d_tr / n


def _gradients(m: dict, idx: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
    em, (flow, gates, cells, hs) = _steps(m, idx, keep=True)
    loss, d_em, d_tr = _crf(em, y, m["t"])
    length, _, size, hid = cells.shape
    g = {k: np.zeros_like(v) for k, v in m.items()}
    g["t"], g["b"] = d_tr, d_em.sum(axis=(0, 1))
    de = np.stack([d_em, d_em[::-1]], axis=1)  # (T, 2, B, K)
    from_out = np.matmul(de, m["o"].transpose(0, 2, 1))
    back = np.ascontiguousarray(m["h"].transpose(0, 2, 1))
    dh, dc = np.zeros((2, size, hid), dtype=cells.dtype), np.zeros((2, size, hid), dtype=cells.dtype)
    squashed = np.tanh(cells)
    dz_all = np.empty_like(gates)
    for t in range(length - 1, -1, -1):
        dh += from_out[t]
        i, f, o, gg = (gates[t, :, :, k * hid : (k + 1) * hid] for k in range(4))
        tc = squashed[t]
        dc += dh * o * (1 - tc * tc)
        dz = dz_all[t]
        np.multiply(dc, gg, out=dz[:, :, :hid])
        np.multiply(dc, cells[t - 1] if t else 0.0, out=dz[:, :, hid : 2 * hid])
        np.multiply(dh, tc, out=dz[:, :, 2 * hid : 3 * hid])
        s = gates[t, :, :, : 3 * hid]
        dz[:, :, : 3 * hid] *= s * (1 - s)
        np.multiply(dc * i, 1 - gg * gg, out=dz[:, :, 3 * hid :])
        np.matmul(dz, back, out=dh)
        dc *= f
    for d in range(2):
        g["o"][d] = hs[:, d].reshape(-1, hid).T @ de[:, d].reshape(length * size, -1)
        g["h"][d] = hs[:-1, d].reshape(-1, hid).T @ dz_all[1:, d].reshape(-1, 4 * hid)
        flat = flow[:, d].reshape(-1)
        dz = dz_all[:, d].reshape(len(flat), -1)
        for name, which, many in (("x", flat % V, V), ("w", flat // V, FLAGS)):
            hot = np.zeros((many, len(flat)), dtype=np.float32)
            hot[which, np.arange(len(flat))] = 1
            g[name][d] = hot @ dz
    return loss, g


def fit(windows: np.ndarray, tags: np.ndarray, k: int, hidden: int, steps: int, batch: int = 256, rate: float = 0.03, seed: int = 7) -> dict:
    """Adam on the CRF likelihood of windows (n, T) with tags (n, T); deterministic for given inputs."""
    m = new_model(hidden, k, seed)
    r = np.random.default_rng(seed)
    first = {n: np.zeros_like(v) for n, v in m.items()}
    second = {n: np.zeros_like(v) for n, v in m.items()}
    order: np.ndarray = np.zeros(0, dtype=np.int64)
    for step in range(1, steps + 1):
        while len(order) < min(batch, len(windows)):
            order = np.concatenate([order, r.permutation(len(windows))])
        b, order = order[:batch], order[batch:]
        _, g = _gradients(m, windows[b], tags[b])
        norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
        lr = rate * min(1.0, step / 20) * max(0.02, 1 - step / (steps * 1.02))
        for n, v in g.items():
            v = v * min(1.0, 1.0 / (norm + 1e-8))
            first[n] = 0.9 * first[n] + 0.1 * v
            second[n] = 0.99 * second[n] + 0.01 * v * v
            m[n] = (m[n] - lr * (first[n] / (1 - 0.9**step)) / (np.sqrt(second[n] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return m


def _emissions(m: dict, idx: np.ndarray) -> np.ndarray:
    """As ``_steps`` without keeping anything: one tanh for all gates, buffers used again and again."""
    size, length = idx.shape
    hid = m["h"].shape[1]
    half = np.ones(4 * hid, dtype=np.float32)
    half[: 3 * hid] = 0.5  # sigmoid(x) = tanh(x / 2) / 2 + 1 / 2
    wx, wh = _inputs(m) * half, m["h"] * half
    flow = np.ascontiguousarray(np.stack([idx.T, idx.T[::-1]], axis=1))
    h = np.zeros((2, size, hid), dtype=np.float32)
    c, tmp = np.zeros_like(h), np.empty_like(h)
    z = np.empty((2, size, 4 * hid), dtype=np.float32)
    row = np.empty((size, 4 * hid), dtype=np.float32)
    em = np.tile(m["b"], (length, size, 1))
    for t in range(length):
        np.matmul(h, wh, out=z)
        for d in range(2):
            np.take(wx[d], flow[t, d], axis=0, out=row, mode="clip")
            z[d] += row
        np.tanh(z, out=z)
        s = z[:, :, : 3 * hid]
        s *= 0.5
        s += 0.5
        c *= z[:, :, hid : 2 * hid]
        np.multiply(z[:, :, :hid], z[:, :, 3 * hid :], out=tmp)
        c += tmp
        np.tanh(c, out=h)
        h *= z[:, :, 2 * hid : 3 * hid]
        em[t] += h[0] @ m["o"][0]
        em[length - 1 - t] += h[1] @ m["o"][1]
    return em


def decode(m: dict, idx: np.ndarray, outside: float = 0.0) -> np.ndarray:
    """Best tags (B, T) by Viterbi; ``outside`` is taken from the score of tag 0."""
    em = _emissions(m, idx)
    em[:, :, 0] -= outside
    length, size, k = em.shape
    score = em[0]
    back = np.empty((length, size, k), dtype=np.int8)
    rows = np.arange(size)
    for t in range(1, length):
        top = score[:, 0, None] + m["t"][0]
        arg = np.zeros((size, k), dtype=np.int8)
        for j in range(1, k):  # few tags: a loop over them beats a large temporary
            z = score[:, j, None] + m["t"][j]
            better = z > top
            top = np.where(better, z, top)
            arg[better] = j
        back[t] = arg
        score = top + em[t]
    out = np.empty((size, length), dtype=np.int8)
    out[:, -1] = score.argmax(axis=1)
    for t in range(length - 1, 0, -1):
        out[:, t - 1] = back[t, rows, out[:, t]]
    return out
