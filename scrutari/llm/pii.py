"""Personal data, found by a character-level bidirectional LSTM with CRF transitions.

The network is written and trained in numpy, on labelled spans that
``example`` makes up from a seed, so it depends on no table. Its weights lie in
``pii_weights.npz``, made by ``python -m scrutari.llm.pii``, so that they are
the same in every process and on every processor. Texts are cut into windows of
``WIDTH`` characters that overlap by ``OVERLAP``; all windows of a batch run
through the network together, each is decoded by Viterbi, and a text's spans
are reconciled over all of its windows: spans of one kind that overlap are
united, of different kinds the longest stays.

Kinds are e-mail addresses, telephone numbers, IP addresses (of both versions),
numbers of cards and bank accounts, and secrets (keys, tokens, passwords).
Names and postal addresses aren't among them.

A window's result depends on its characters alone, so results don't depend on
how rows are partitioned.

Defined results: a null text has a null list of spans and stays null when
masked; an empty text has none; spans may be of any length; repeated rows are
treated alike; texts of any length are covered to their last character; an
empty table gives an empty result. Other columns aren't read, and masking
returns all columns as they were.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import runtime

KINDS = ("EMAIL", "PHONE", "IP", "CARD", "SECRET")
K = 1 + len(KINDS)
HIDDEN = 12
WIDTH = 768
OVERLAP = 128
#: Windows that run together, and steps after which those that have ended are left out.
TOGETHER = 768
STRETCH = 32

LOWER, UPPER, DIGIT, MARK, PAD = 128, 129, 130, 131, 132
CLASSES = 133


@lru_cache(1)
def _classes() -> np.ndarray:
    """Class of each code point: ASCII as it is, all else by kind."""
    out = np.full(0x110000, MARK, np.uint8)
    out[:128] = np.arange(128)
    for c in range(128, 0x30000):
        x = chr(c)
        if x.isalpha():
            out[c] = UPPER if x.isupper() else LOWER
        elif x.isdigit():
            out[c] = DIGIT
        elif x.isspace():
            out[c] = 32
    return out


def codes(text: str) -> np.ndarray:
    return _classes()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]


# Labelled examples


def _pick(r: np.random.Generator, s) -> str:
    return s[int(r.integers(len(s)))]


def _digits(r: np.random.Generator, n: int) -> str:
    return "".join(map(str, r.integers(0, 10, n)))


_ALNUM = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789abcdefghijklmnopqrstuvwxyz"
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def _of(r: np.random.Generator, chars: str, n: int) -> str:
    return "".join(chars[i] for i in r.integers(0, len(chars), n))


_SETS = ("abcdefghijklmnopqrstuvwxyz", "etaoinshrdlu", "aeiouéèêçnrstl", "eniraschtäöüßzu", "eaosrnidlcñíóú", "thernonedatis")


def _word(r: np.random.Generator, least: int = 1, most: int = 13) -> str:
    s = _pick(r, _SETS)
    return "".join(s[i] for i in r.integers(0, len(s), int(r.integers(least, most))))


def _person(r: np.random.Generator) -> tuple[str, str]:
    """A span of personal data and its kind."""
    k = int(r.integers(5))
    if k == 0:
        name = _word(r, 2, 12)
        if r.random() < 0.7:
            name += _pick(r, (".", ".", ".", "_", "-", "")) + (_digits(r, int(r.integers(1, 4))) if r.random() < 0.75 else _word(r, 2, 9))
        host = _pick(r, ("mail", "mail", "mail", "post", "web", "")) + _digits(r, int(r.integers(0, 2)))
        rest = _pick(r, ("example.com", "example.com", "example.com", "example.org", "example.net", _word(r, 3, 9) + "." + _pick(r, ("com", "org", "de", "fr", "net"))))
        return name + "@" + (host + "." + rest if host else rest), "EMAIL"
    if k == 1:
        a, b, c = _digits(r, 3), _pick(r, ("555", _digits(r, 3))), _digits(r, 4)
        return _pick(r, (f"+1 ({a}) {b}-{c}",) * 4 + (f"({a}) {b}-{c}", f"+1 {a} {b} {c}", f"+1-{a}-{b}-{c}", f"{a}-{b}-{c}", f"+{_digits(r, 2)} {_digits(r, 2)} {_digits(r, 4)} {c}")), "PHONE"
    if k == 2:
        if r.random() < 0.15:
            part = [f"{x:x}" for x in r.integers(0, 65536, 8)]
            if r.random() < 0.5:
                at = int(r.integers(1, 6))
                part[at : at + int(r.integers(2, 8 - at))] = [""]
            return ":".join(part), "IP"
        return ".".join(str(x) for x in r.integers(0, 256, 4)), "IP"
    if k == 3 and r.random() < 0.15:  # accounts
        d = _of(r, _ALNUM[:26], 2) + _digits(r, 2) + _digits(r, int(r.integers(11, 24)))
        sep = _pick(r, ("", " "))
        return sep.join(d[i : i + 4] for i in range(0, len(d), 4)), "CARD"
    if k == 3:
        d = _pick(r, ("4", "5", "3", "6", _digits(r, 1))) + _digits(r, 15)
        sep = _pick(r, ("", "", "", "", " ", "-"))
        return sep.join(d[i : i + 4] for i in range(0, 16, 4)), "CARD"
    form = r.random()
    if form < 0.3:  # identifiers of cloud access keys
        return _pick(r, ("AKIA", "AKIA", "AKIA", "ASIA")) + _of(r, _pick(r, (_BASE32, _BASE32, _ALNUM[:36])), 16), "SECRET"
    if form < 0.42:
        return _pick(r, ("ghp_", "gho_", "sk-", "sk_live_", "glpat-")) + _of(r, _ALNUM, int(r.integers(20, 40))), "SECRET"
    return _of(r, "0123456789abcdef", _pick(r, (40, 40, 40, 32, 64, 24, 18, 16))), "SECRET"


def _harmless(r: np.random.Generator) -> str:
    """What looks a little like personal data, but isn't."""
    k = int(r.integers(12))
    n = lambda a, b: int(r.integers(a, b))
    return (
        f"Version {n(1, 9)}.{n(0, 9)}.",
        f"{n(1, 9)}.{n(0, 9)}",
        str(n(1900, 2030)),
        _digits(r, n(1, 8)),
        f"{n(1990, 2030)}-{n(1, 13):02d}-{n(1, 29):02d}",
        f"{n(0, 24):02d}:{n(0, 60):02d}",
        f"${n(1, 999)}.{n(0, 99):02d}",
        f"https://{_word(r, 3, 8)}.example.com/{_word(r, 2, 8)}/{n(1, 999)}?page={n(1, 9)}",
        "token",
        "@" + _word(r, 3, 10),
        f"{n(1, 999)},{n(100, 999)},{n(100, 999)}",
        _word(r, 20, 40),
    )[k]


def example(r: np.random.Generator, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Classes and labels of ``length`` characters of made-up text."""
    parts: list[tuple[str, int]] = []
    n = 0
    junk = r.random() < 0.15
    rich = 0.16 if r.random() < 0.7 else 0.0  # many texts hold nothing personal
    shout = r.random() < 0.15
    table = r.random() < 0.1
    skip = int(r.integers(0, 30)) if r.random() < 0.5 else 0
    while n < length + skip:
        x = r.random()
        label = 0
        if x < rich:
            s, kind = _person(r)
            label = 1 + KINDS.index(kind)
            if kind == "SECRET":
                named = s[0] in "0123456789abcdef" and "_" not in s and "-" not in s
                before = _pick(r, ('token = "', 'token = "', 'token = "', 'key = "', "token: ", "secret=", "password=", 'password = "', "api_key: ") if named or r.random() < 0.2 else ("",))
                parts.append((before.upper() if shout else before, 0))
                n += len(before)
        elif x < rich + 0.06:
            s = _harmless(r)
        else:
            s = _word(r)
            if r.random() < 0.12:
                s = s.capitalize()
        if shout:
            s = s.upper()
        parts.append((s, label))
        n += len(s)
        if label == 1 + KINDS.index("SECRET") and before.endswith('"'):
            parts.append(('"', 0))
            n += 1
        after = ""
        if junk:
            after = _pick(r, ("!!", "%%%", "&&&", "###", "***", "$$$"))
        elif r.random() < 0.25:
            after = _pick(r, (".", ".", ".", ".", ".", ",", ",", ",", "!!", ";", ":", "?", ")"))
        elif shout and r.random() < 0.5:
            after = "!!"
        after += _pick(r, (" ",) * 12 + ("\n",)) if not table else " | "
        parts.append((after, 0))
        n += len(after)
    c = codes("".join(s for s, _ in parts))
    y = np.concatenate([np.full(len(s), k, np.int8) for s, k in parts])
    c, y = c[skip : skip + length].copy(), y[skip : skip + length].copy()
    if r.random() < 0.15:  # the end of a text
        at = int(r.integers(length // 3, length))
        c[at:], y[at:] = PAD, 0
    return c, y


# The network


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _forward(X: np.ndarray, U: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, list]:
    """States (time, hidden, batch) and what the backward pass needs; ids (time, batch)."""
    T, B = ids.shape
    H = HIDDEN
    h, c = np.zeros((H, B), np.float32), np.zeros((H, B), np.float32)
    out, kept = np.empty((T, H, B), np.float32), []
    for t in range(T):
        z = U @ h + X[ids[t]].T
        s, g = _sigmoid(z[: 3 * H]), np.tanh(z[3 * H :])
        before, prev = c, h
        c = s[H : 2 * H] * c + s[:H] * g
        tc = np.tanh(c)
        h = s[2 * H :] * tc
        out[t] = h
        kept.append((s, g, before, prev, tc))
    return out, kept


def _backward(U: np.ndarray, kept: list, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of U and of the gates' inputs (time, 4 * hidden, batch)."""
    T, H, B = d.shape
    dU = np.zeros_like(U)
    dz = np.empty((T, 4 * H, B), np.float32)
    dh, dc = np.zeros((H, B), np.float32), np.zeros((H, B), np.float32)
    for t in range(T - 1, -1, -1):
        s, g, before, prev, tc = kept[t]
        i, f, o = s[:H], s[H : 2 * H], s[2 * H :]
        dh = dh + d[t]
        dc = dc + dh * o * (1 - tc * tc)
        z = dz[t]
        z[:H] = dc * g * i * (1 - i)
        z[H : 2 * H] = dc * before * f * (1 - f)
        z[2 * H : 3 * H] = dh * tc * o * (1 - o)
        z[3 * H :] = dc * i * (1 - g * g)
        dU += z @ prev.T
        dh = U.T @ z
        dc = dc * f
    return dU, dz


def _crf(em: np.ndarray, y: np.ndarray, trans: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean negative log likelihood by character, and its gradients; em (time, K, batch), y (time, batch)."""
    T, _, B = em.shape
    top = em.max(axis=1, keepdims=True)
    e, E = np.exp(em - top), np.exp(trans)
    a, scale = np.empty_like(em), np.empty((T, B), np.float32)
    for t in range(T):
        a[t] = e[t] if t == 0 else (E.T @ a[t - 1]) * e[t]
        scale[t] = a[t].sum(axis=0)
        a[t] /= scale[t]
    b = np.ones((K, B), np.float32)
    marg = np.empty_like(em)
    dt = np.zeros_like(trans)
    for t in range(T - 1, -1, -1):
        marg[t] = a[t] * b
        if t:
            eb = e[t] * b / scale[t]
            dt += E * (a[t - 1] @ eb.T)
            b = E @ eb
    loss = np.log(scale).sum() + top.sum()
    tt, bb = np.arange(T)[:, None], np.arange(B)[None, :]
    loss -= em[tt, y, bb].sum() + trans[y[:-1], y[1:]].sum()
    marg[tt, y, bb] -= 1
    np.subtract.at(dt, (y[:-1].ravel(), y[1:].ravel()), 1)
    n = T * B
    return float(loss) / n, marg / n, dt / n


ROUNDS = 1_600
#: Characters of the examples, in turn: most are short, as steps are what costs; some are as long as windows.
LENGTHS = (112, 112, 112, 256, 112, 112, 112, WIDTH)
WEIGHTS = os.path.join(os.path.dirname(os.path.abspath(__file__)), "pii_weights.npz")


@lru_cache(1)
def weights() -> dict[str, np.ndarray]:
    """The parameters that come with this package; read on the driver, the executors get them by broadcast."""
    with np.load(WEIGHTS) as f:
        return {k: f[k] for k in f.files}


def train(seed: int = 11, rounds: int = ROUNDS, batch: int = 48) -> dict[str, np.ndarray]:
    """Parameters after ``rounds`` steps of Adam on fresh made-up examples."""
    r = np.random.default_rng(seed)
    H = HIDDEN
    p = {
        "Xf": r.normal(0, 0.3, (CLASSES, 4 * H)),
        "Xb": r.normal(0, 0.3, (CLASSES, 4 * H)),
        "Uf": r.normal(0, H**-0.5, (4 * H, H)),
        "Ub": r.normal(0, H**-0.5, (4 * H, H)),
        "Wf": r.normal(0, 0.2, (K, H)),
        "Wb": r.normal(0, 0.2, (K, H)),
        "b": np.zeros(K),
        "trans": np.zeros((K, K)),
    }
    for x in ("Xf", "Xb"):
        p[x][:, H : 2 * H] += 1.0
    # Characters of a kind begin alike: letters of a case, digits.
    for x in ("Xf", "Xb"):
        for a, z in ((48, 58), (97, 123), (65, 91)):
            p[x][a:z] = p[x][a] + r.normal(0, 0.05, (z - a, 4 * H))
    p = {k: v.astype(np.float32) for k, v in p.items()}
    m1, m2 = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    for step in range(1, rounds + 1):
        length = LENGTHS[step % len(LENGTHS)]
        pairs = [example(r, length) for _ in range(max(8, batch * 112 // length))]
        ids = np.stack([c for c, _ in pairs], axis=1).astype(np.int64)
        y = np.stack([y for _, y in pairs], axis=1).astype(np.int64)
        hf, kf = _forward(p["Xf"], p["Uf"], ids)
        hb, kb = _forward(p["Xb"], p["Ub"], ids[::-1])
        em = p["Wf"] @ hf + p["Wb"] @ hb[::-1] + p["b"][:, None]
        loss, de, dt = _crf(em.astype(np.float32), y, p["trans"])
        g = {"trans": dt, "b": de.sum(axis=(0, 2))}
        for side, h, kept, flip in (("f", hf, kf, 1), ("b", hb, kb, -1)):
            d = de[::flip]
            g["W" + side] = np.einsum("tkb,thb->kh", d, h)
            dU, dz = _backward(p["U" + side], kept, np.matmul(p["W" + side].T, d))
            g["U" + side] = dU
            flat = ids[::flip].ravel()
            hot = np.zeros((CLASSES, len(flat)), np.float32)
            hot[flat, np.arange(len(flat))] = 1
            g["X" + side] = hot @ dz.transpose(0, 2, 1).reshape(len(flat), 4 * H)
        norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
        clip = min(1.0, 0.5 / (norm + 1e-9))
        rate = 0.02 * min(1.0, step / 20) * (1 if step < rounds * 0.6 else 0.3 if step < rounds * 0.85 else 0.1)
        for k, v in g.items():
            v = v * clip
            m1[k] = 0.9 * m1[k] + 0.1 * v
            m2[k] = 0.99 * m2[k] + 0.01 * v * v
            p[k] = (p[k] - rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return p


class Tagger:
    """The trained network, arranged for fast inference."""

    def __init__(self, p: dict[str, np.ndarray]):
        sign = np.full(4 * HIDDEN, -1, np.float32)
        sign[3 * HIDDEN :] = -2  # tanh(x) is 2 * sigmoid(2 * x) - 1, and exp is the fastest function to have either from
        self.X = [np.ascontiguousarray(p[x] * sign) for x in ("Xf", "Xb")]
        self.U = [np.ascontiguousarray(p[u] * sign[:, None]) for u in ("Uf", "Ub")]
        self.W, self.b, self.trans = [p["Wf"], p["Wb"]], p["b"], p["trans"]
        self.UW = [np.concatenate(x) for x in zip(self.U, self.W)]

    def decode(self, ids: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Labels (time, batch) of windows ids (time, batch) padded to the longest."""
        with np.errstate(over="ignore"):  # exp may reach infinity, of which the inverse is 0 as it should be
            return self._decode(ids, length)

    def _decode(self, ids: np.ndarray, length: np.ndarray) -> np.ndarray:
        T, B = ids.shape
        H = HIDDEN
        one, two, minus = np.float32(1), np.float32(2), np.float32(-2)
        em = np.zeros((T, K, B), np.float32)
        ragged = bool((length < T).any())
        # Windows come longest first: a stretch of steps runs over those only that reach it.
        stretches = [(t, min(t + STRETCH, T), int((length > t).sum())) for t in range(0, T, STRETCH)]
        for side in (0, 1):
            X, UW, W = self.X[side], self.UW[side], self.W[side]
            h = c = np.zeros((H, 0), np.float32)
            for low, high, n in stretches if side == 0 else reversed(stretches):
                h, c = (np.concatenate((a[:, :n], np.zeros((H, max(0, n - a.shape[1])), np.float32)), axis=1) for a in (h, c))
                zw, g, w = np.empty((4 * H + K, n), np.float32), np.empty((n, 4 * H), np.float32), np.empty((K, n), np.float32)
                z, size, last = zw[: 4 * H], length[:n], -1
                over = bool((size < high).any())
                for t in range(low, high) if side == 0 else range(high - 1, low - 1, -1):
                    np.take(X, ids[t, :n], axis=0, out=g, mode="clip")
                    np.dot(UW, h, out=zw)  # the gates' inputs of this step, and what the step before emits
                    if last >= 0:
                        em[last, :, :n] += zw[4 * H :]
                    last = t
                    z += g.T
                    np.exp(z, out=z)
                    z += one
                    np.divide(one, z, out=z)
                    s = z[3 * H :]
                    s += s
                    s -= one
                    s *= z[:H]
                    c *= z[H : 2 * H]
                    c += s
                    np.multiply(c, minus, out=h)
                    np.exp(h, out=h)
                    h += one
                    np.divide(two, h, out=h)
                    h -= one
                    h *= z[2 * H : 3 * H]
                    if side and over:  # the backward pass begins at the window's own end
                        inside = t < size
                        h *= inside
                        c *= inside
                np.dot(W, h, out=w)
                em[last, :, :n] += w
        em += self.b[:, None]
        if ragged:
            over = np.arange(T)[:, None] >= length
            em[:, 1:][np.broadcast_to(over[:, None], em[:, 1:].shape)] = -1e4
        trans, m, paths, plain = self.trans, np.empty((K, B), np.float32), np.empty((K, K, B), np.float32), np.ones(B, bool)
        for t in range(1, T):  # em becomes the best score of a path that ends there
            np.add(em[t - 1][:, None], trans[:, :, None], out=paths)
            np.maximum.reduce(paths, axis=0, out=m)
            plain &= m[0] == paths[0, 0]
            em[t] += m
        # Where the best path ends without a label and what has none always follows such, there is no label at all.
        plain &= em[-1].argmax(axis=0) == 0
        y = np.zeros((T, B), np.int8)
        some = np.flatnonzero(~plain)
        if len(some):
            y[:, some] = self._traced(np.ascontiguousarray(em[:, :, some]))
        return y

    def _traced(self, em: np.ndarray) -> np.ndarray:
        """Labels of the best paths, from their scores."""
        T, _, B = em.shape
        y = np.empty((T, B), np.int8)
        y[-1] = em[-1].argmax(axis=0)
        for t in range(T - 2, -1, -1):
            y[t] = (em[t] + self.trans[:, y[t + 1]]).argmax(axis=0)
        return y

    def spans(self, texts: list[str | None]) -> list[list[tuple[int, int, int]]]:
        """(start, end, kind) of each text, by character."""
        found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        doc, start, size, joined, base = [], [], [], [], [0]
        for d, text in enumerate(texts):
            c = codes(text or "")
            joined.append(c)
            base.append(base[-1] + len(c))
            for s in range(0, max(len(c) - OVERLAP, 1) if len(c) else 0, WIDTH - OVERLAP):
                doc.append(d)
                start.append(s)
                size.append(min(WIDTH, len(c) - s))
        if not doc:
            return found
        stream = np.concatenate([*joined, np.full(WIDTH, PAD, np.uint8)])
        size_, start_ = np.array(size), np.array(start)
        first = start_ + np.array(base)[doc]
        order = np.argsort(-size_, kind="stable")
        for k in range(0, len(order), TOGETHER):
            own = order[k : k + TOGETHER]
            T = int(size_[own].max())
            at = first[own][None, :] + np.arange(T)[:, None]
            ids = np.where(np.arange(T)[:, None] < size_[own], stream[np.minimum(at, len(stream) - 1)], PAD).astype(np.intp)
            y = self.decode(ids, size_[own])
            for j in np.flatnonzero(y.any(axis=0)).tolist():
                col = y[:, j]
                cut = [0, *(np.flatnonzero(col[1:] != col[:-1]) + 1).tolist(), T]
                w = own[j]
                found[doc[w]].extend((start[w] + a, start[w] + b, int(col[a])) for a, b in zip(cut, cut[1:]) if col[a])
        return [reconcile(f, t or "") if f else f for f, t in zip(found, texts)]


def reconcile(spans: list[tuple[int, int, int]], text: str = "") -> list[tuple[int, int, int]]:
    """One text's spans from those of all its windows: united within a kind, else the longest stays."""
    united: list[list[int]] = []
    for kind in sorted({k for _, _, k in spans}):
        last: list[int] | None = None
        for a, b, _ in sorted(s for s in spans if s[2] == kind):
            if last and a < last[1]:
                last[1] = max(last[1], b)
            else:
                last = [a, b, kind]
                united.append(last)
    out: list[tuple[int, int, int]] = []
    for a, b, k in sorted(united, key=lambda s: (s[0] - s[1], s[0], s[2])):
        if all(b <= x or y <= a for x, y, _ in out):
            out.append((a, b, k))
    return sorted(out)


def _tagger(params: dict[str, np.ndarray], kept: dict = {}) -> Tagger:  # noqa: B006
    if id(params) not in kept:
        kept.clear()
        kept[id(params)] = Tagger(params), params
    return kept[id(params)][0]


_PIECE = 4_000_000


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans) of each row; a span is (start, end, kind), counted in code points from 0."""
    model = docs.sparkSession.sparkContext.broadcast(weights())
    kind = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = _tagger(model.value)
        for batch, texts in runtime.batches(it, "text", _PIECE):
            rows = [
                None if t is None else [{"start": a, "end": b, "kind": KINDS[k - 1]} for a, b, k in s] for t, s in zip(texts, tagger.spans(texts))
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(kind))], ["doc_id", "spans"])

    read = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return runtime.mapped(runtime.spread(read), run, f"doc_id {dict(docs.dtypes)[id_col]}, spans array<struct<start:int,end:int,kind:string>>")


def mask(docs: DataFrame, text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; ``length_col``, if given, gets the new length."""
    model = docs.sparkSession.sparkContext.broadcast(weights())

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = _tagger(model.value)
        for batch, texts in runtime.batches(it, text_col, _PIECE):
            out = []
            for t, spans in zip(texts, tagger.spans(texts)):
                for a, b, k in reversed(spans):
                    t = f"{t[:a]}[{KINDS[k - 1]}]{t[b:]}"
                out.append(t)
            at = batch.schema.get_field_index(text_col)
            batch = batch.set_column(at, batch.schema.field(at), pa.array(out, batch.schema.field(at).type))
            if length_col:
                at = batch.schema.get_field_index(length_col)
                f = batch.schema.field(at)
                batch = batch.set_column(at, f, pa.array([None if t is None else len(t) for t in out], f.type))
            yield batch

    return runtime.mapped(runtime.spread(docs), run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document."""
    return find(spark.read.parquet(f"{sf_dir}/documents.parquet"))


if __name__ == "__main__":
    np.savez(WEIGHTS, **train())
