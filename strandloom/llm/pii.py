"""Operator 10: personal data by a character-level BiLSTM with CRF transitions.

The model is trained here, in numpy, from texts whose spans are known because a
seeded generator wrote them.  Characters are bytes; those above 127 are four symbols, by
what UTF-8 uses them for.  The gates are hard sigmoids and the squashing is a hard tanh, so a step is
a small matrix product and a few clips over thousands of windows at once.

A column's text is laid out as one stream with a separator between rows and cut into
windows that overlap by CONTEXT characters on both sides.  Each window is decoded by
Viterbi's algorithm.  Where two windows overlap their paths are compared: the change from
one to the other is made where both are in the same state, at the place nearest the
seam, so that what is pasted is a path again; where they nowhere agree, the window that is
surer of its path there counts.  Spans are then read off the whole stream, so that a span
across a seam is one span and none crosses a row's end.
"""

from __future__ import annotations

import random
import string
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import flat, repeats

LABELS = ("none", "email", "phone", "ip", "card", "secret")
#: Size of a symbol's embedding; hidden units of each direction; length and number of the training texts; texts of a step; steps; seed.
EMBEDDING, HIDDEN, LENGTH, TEXTS, BATCH, STEPS, SEED = 10, 16, 96, 24_000, 128, 1600, 7
#: Core of a window and the context that it overlaps with its neighbours, in characters.
CORE, CONTEXT = 768, 64
#: Least characters of a span, by label: what is shorter can't be one.
LEAST = np.array([0, 6, 7, 7, 13, 5])
SYMBOLS = 133
SEPARATOR = 132

SCHEMA = "doc_id LONG, kind STRING, start_char INT, n_chars INT"

#: ASCII as it is; then bytes that go on, and leads of two, three and four bytes.
_SYMBOL = np.concatenate([np.arange(128), np.full(64, 128), np.full(32, 129), np.full(16, 130), np.full(16, 131)]).astype(np.uint8)


# ---- labelled texts -------------------------------------------------------


def _word(rng: random.Random) -> str:
    size = rng.choice((1, 2, 2, 3, 3, 4, 5, 6, 7, 8, 9, 10, 12, 15))
    vowels = rng.choice((0.3, 0.45, 0.6))
    letters = "".join(rng.choice("aeiou") if rng.random() < vowels else rng.choice("bcdfghjklmnpqrstvwxyznrsthl") for _ in range(size))
    if rng.random() < 0.15:
        at = rng.randrange(size)
        letters = letters[:at] + rng.choice("éèêçöüßñíóäà") + letters[at + 1 :]
    if rng.random() < 0.12:
        letters = letters.capitalize()
    return letters + (rng.choice((",", ".", ".", ".\n", ";", ":", "?", "!")) if rng.random() < 0.15 else "")


def _digits(rng: random.Random, n: int) -> str:
    return "".join(rng.choice(string.digits) for _ in range(n))


def _some(rng: random.Random, chars: str, n: int) -> str:
    return "".join(rng.choice(chars) for _ in range(n))


_LETTERS, _ALNUM = string.ascii_letters, string.ascii_letters + string.digits


def _plain(rng: random.Random) -> str:
    return _word(rng).strip(",.;:?!\n").lower()


def _email(rng: random.Random) -> str:
    first = _plain(rng) + rng.choice((".", "_", "-", "", "+")) + (_digits(rng, rng.choice((1, 2, 2, 3, 4))) if rng.random() < 0.6 else _plain(rng))
    made = rng.random()
    if made < 0.4:
        host = rng.choice((f"mail{rng.randrange(10)}.example", "mail.example", "post.test", f"host{rng.randrange(100)}", "web"))
    elif made < 0.6:
        host = rng.choice(("gmail", "outlook", "yahoo", "mail", "proton", "corp", "uni"))
    else:
        host = "".join(c for c in _plain(rng) if c.isascii()) + rng.choice(("", "", ".dept", "-lab"))
    return (first.capitalize() if rng.random() < 0.1 else first) + "@" + (host or "x") + rng.choice((".com", ".org", ".net", ".de", ".co.uk", ".io", ".edu", ".fr"))


def _phone(rng: random.Random) -> str:
    a, b, c = _digits(rng, 3), _digits(rng, 3), _digits(rng, 4)
    return rng.choice((
        f"+1 ({a}) {b}-{c}", f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+{rng.randrange(1, 99)} {a} {b} {c}", f"{a}.{b}.{c}", f"0{_digits(rng, 2)} {_digits(rng, 4)} {c}", f"0{_digits(rng, 3)}-{_digits(rng, 6)}",
        f"{b}-{c}", f"{b}-{c}", f"+{rng.randrange(10, 99)}{_digits(rng, 10)}", f"+{rng.randrange(10, 99)} (0){_digits(rng, 2)} {_digits(rng, 3)} {c}", f"1-{a}-{b}-{c}",
    ))


def _address(rng: random.Random) -> str:
    if rng.random() < 0.15:
        groups = [f"{rng.randrange(65536):x}" for _ in range(rng.choice((3, 4, 8)))]
        return ":".join(groups) if len(groups) == 8 else "2001:" + ":".join(groups) + "::" + f"{rng.randrange(4096):x}"
    return ".".join(str(rng.randrange(rng.choice((10, 100, 256, 256, 256)))) for _ in range(4))


def _card(rng: random.Random) -> str:
    d = (rng.choice("3456") if rng.random() < 0.5 else "") + _digits(rng, 16)
    d = d[:16]
    return rng.choice((d, d, d, " ".join((d[:4], d[4:8], d[8:12], d[12:])), "-".join((d[:4], d[4:8], d[8:12], d[12:]))))


def _secret(rng: random.Random) -> tuple[int, str, str, str]:
    hexa = _some(rng, "0123456789abcdef", rng.choice((16, 18, 18, 24, 32, 40, 40, 40)))
    kind = rng.randrange(10)
    if kind < 2:
        return 5, "", "AKIA" + _some(rng, string.ascii_uppercase + string.digits, 16), ""
    if kind < 4:
        return 5, rng.choice(("token", "token", "key", "secret")) + rng.choice((' = "', ' = "', '="')), hexa, '"'
    if kind < 6:
        return 5, rng.choice(("password", "password", "passwd", "pwd", "api_key")) + rng.choice(("=", "=", ": ")), hexa, ""
    if kind == 6:
        word = _some(rng, _LETTERS, rng.randrange(4, 9)) + _some(rng, "!$%&?_-" + string.digits, rng.randrange(1, 4)) + _some(rng, _ALNUM, rng.randrange(0, 6))
        return 5, rng.choice(("password", "Password", "passwd", "pwd", "pass")) + rng.choice(("=", ": ", " is ", ":")), word, ""
    if kind == 7:
        return 5, rng.choice(("", "key ", "token: ")), rng.choice(("sk-", "sk_live_", "ghp_", "xoxb-", "pk_", "glpat-")) + _some(rng, _ALNUM, rng.choice((20, 24, 32, 36))), ""
    if kind == 8:
        part = lambda n: _some(rng, _ALNUM + "_-", n)
        return 5, rng.choice(("Bearer ", "bearer ", "jwt=")), f"eyJ{part(12)}.eyJ{part(16)}.{part(14)}", ""
    return 5, rng.choice(("secret_access_key = ", "secret key: ", "aws_secret=", "client_secret=")), _some(rng, _ALNUM + "+/", 40), ""


def _personal(rng: random.Random) -> tuple[int, str, str, str]:
    """(label, text before, value, text after)"""
    kind = rng.randrange(1, 8)
    if kind > 4:
        return _secret(rng)
    value = (_email, _phone, _address, _card)[kind - 1](rng)
    before = rng.choice(("", "", "", "", "tel ", "ip=", "mail: ", "card ", "<", "at ", "call ", "(", "host ", "server ", "the server ", "from ", "address ", "or ", "reach ")) if rng.random() < 0.6 else ""
    return kind, before, value, ">" if before == "<" else ")" if before == "(" else ""


def _harmless(rng: random.Random) -> str:
    return rng.choice((
        f"version {rng.randrange(10)}.", f"Version {rng.randrange(10)}.{rng.randrange(10)}.", f"CC BY-NC {rng.randrange(5)}.0.", f"{rng.randrange(1900, 2100)}", f"{rng.randrange(1, 32)}.{rng.randrange(1, 13)}.{rng.randrange(1990, 2030)}",
        f"{rng.randrange(2030)}-{rng.randrange(1, 13):02d}-{rng.randrange(1, 29):02d}", f"{rng.randrange(24)}:{rng.randrange(60):02d}", f"${rng.randrange(1000)}.{rng.randrange(100):02d}", f"{rng.randrange(100)}%", str(rng.randrange(10 ** rng.randrange(1, 10))),
        f"released {rng.randrange(12)}.{rng.randrange(20)}.{rng.randrange(40)}.{rng.randrange(10)}", f"version {rng.randrange(9)}.{rng.randrange(20)}.{rng.randrange(40)}.{rng.randrange(100)}", f"v{rng.randrange(9)}.{rng.randrange(20)}.{rng.randrange(30)}.{rng.randrange(9)}",
        f"order {_digits(rng, rng.choice((8, 10, 12, 16)))}", f"invoice {_digits(rng, rng.choice((6, 12, 16)))}", f"id {_digits(rng, rng.choice((5, 9, 16)))}", f"password {_plain(rng)}", f"the {rng.choice(('password', 'token', 'secret', 'key'))} is {_plain(rng)}ed", f"pages {rng.randrange(100, 999)}-{rng.randrange(1000, 9999)}",
        f"{rng.randrange(1000)},{rng.randrange(1000):03d}", "AKIA", "ATOM BETA", "a = b", 'said "so"', "token", "password", "(see below)", "x@", "@home", "C++ #1", "1.2.3", "10/12", f"{rng.randrange(10)}.{rng.randrange(100)}", "LICENSED UNDER THE", "https://www.example.com/en/12",
    ))


def labelled(rng: random.Random) -> tuple[bytes, np.ndarray]:
    """A text of LENGTH bytes and the label of each."""
    text, marks = b"", []
    style = rng.random()
    wrap = rng.choice(("***", "$$$", "###", "%%%", "&&&", "!!", " |")) if style < 0.15 else ""
    upper = 0.15 < style < 0.25

    def put(s: str, label: int = 0) -> None:
        nonlocal text
        raw = s.encode()
        text += raw
        marks.extend([label] * len(raw))

    def value_of(kind: tuple[int, str, str, str]) -> None:
        label, before, value, after = kind
        put(before)
        put(value, label)
        put(after)

    put(_word(rng)[rng.randrange(2) :])
    while len(text) < LENGTH + 60:
        put(rng.choice((" ", " ", " ", " ", " ", " ", "\n", "  ")) if rng.random() < 0.97 else "")
        r = rng.random()
        if r < 0.2:
            kind = _personal(rng)
            value_of(kind)
            if rng.random() < 0.12:
                put(" ")
                value_of(kind)
            put(rng.choice(("", "", "", ".", ",")))
        elif r < 0.3:
            put(_harmless(rng))
        elif r < 0.32:
            put("".join(rng.choice(string.ascii_uppercase) for _ in range(rng.randrange(3, 25))))
        else:
            put(_word(rng).upper() if upper or rng.random() < 0.03 else _word(rng))
        put(wrap)
    cut = rng.randrange(50)
    return text[cut : cut + LENGTH], np.array(marks[cut : cut + LENGTH])


# ---- the model ------------------------------------------------------------


def initial(rng: np.random.Generator, hidden: int = HIDDEN) -> dict[str, np.ndarray]:
    """Gates in the order input, forget, output, candidate; index 0 reads forwards, 1 backwards."""
    w = {
        "emb": rng.standard_normal((SYMBOLS, EMBEDDING)) * 0.7,
        "x": rng.standard_normal((2, EMBEDDING, 4 * hidden)) / np.sqrt(EMBEDDING),
        "h": rng.standard_normal((2, hidden, 4 * hidden)) / np.sqrt(hidden),
        "b": np.zeros((2, 1, 4 * hidden)),
        "out": rng.standard_normal((2, hidden, len(LABELS))) * 0.5,
        "bias": np.zeros(len(LABELS)),
        "trans": np.zeros((len(LABELS), len(LABELS))),
    }
    w["b"][:, :, hidden : 2 * hidden] = 1.0
    w["bias"][0] = 1.0
    return {k: v.astype(np.float32) for k, v in w.items()}


def _forward(w: dict, symbols: np.ndarray) -> tuple[np.ndarray, list]:
    """Emissions (T, B, labels) of symbols (T, B), and what the gradient needs."""
    t_, b_ = symbols.shape
    n = w["h"].shape[1]
    both = np.stack([symbols, symbols[::-1]])
    h = np.zeros((2, b_, n), w["h"].dtype)
    c = np.zeros_like(h)
    kept, hs = [], np.empty((t_, 2, b_, n), h.dtype)
    seen = w["emb"][both]
    x = seen @ w["x"][:, None] + w["b"][:, None]
    for t in range(t_):
        z = x[:, t] + h @ w["h"]
        gate = np.clip(z[..., : 3 * n] * 0.25 + 0.5, 0, 1)
        cand = np.clip(z[..., 3 * n :], -1, 1)
        before, h_before = c, h
        c = gate[..., n : 2 * n] * c + gate[..., :n] * cand
        squashed = np.clip(c, -1, 1)
        h = gate[..., 2 * n :] * squashed
        hs[t] = h
        kept.append((z, gate, cand, before, c, squashed, h_before))
    e = hs[:, 0] @ w["out"][0] + hs[::-1, 1] @ w["out"][1] + w["bias"]
    return e, [both, seen, kept, hs]


def _crf(e: np.ndarray, trans: np.ndarray, gold: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean negative log likelihood by character, and its gradients by emission and transition."""
    t_, b_, k = e.shape
    alpha, beta = np.empty_like(e), np.zeros_like(e)
    alpha[0] = e[0]
    for t in range(1, t_):
        s = alpha[t - 1][:, :, None] + trans
        m = s.max(axis=1)
        alpha[t] = e[t] + m + np.log(np.exp(s - m[:, None, :]).sum(axis=1))
    for t in range(t_ - 2, -1, -1):
        s = trans + (e[t + 1] + beta[t + 1])[:, None, :]
        m = s.max(axis=2)
        beta[t] = m + np.log(np.exp(s - m[:, :, None]).sum(axis=2))
    m = alpha[-1].max(axis=1)
    z = m + np.log(np.exp(alpha[-1] - m[:, None]).sum(axis=1))
    p = np.exp(alpha + beta - z[None, :, None])
    pair = np.exp(alpha[:-1, :, :, None] + trans + (e[1:] + beta[1:])[:, :, None, :] - z[None, :, None, None]).sum(axis=(0, 1))
    line = np.arange(b_)
    score = e[np.arange(t_)[:, None], line, gold].sum() + trans[gold[:-1], gold[1:]].sum()
    p[np.arange(t_)[:, None], line, gold] -= 1
    np.subtract.at(pair, (gold[:-1], gold[1:]), 1)
    size = t_ * b_
    return float((z.sum() - score) / size), p / size, pair / size


def gradients(w: dict, symbols: np.ndarray, gold: np.ndarray) -> tuple[float, dict]:
    """The loss and its gradient by each weight, through time in both directions."""
    e, (both, seen, kept, hs) = _forward(w, symbols)
    loss, de, dtrans = _crf(e, w["trans"], gold)
    n = w["h"].shape[1]
    g = {k: np.zeros_like(v) for k, v in w.items()}
    g["trans"] = dtrans.astype(w["trans"].dtype)
    g["bias"] = de.sum(axis=(0, 1))
    back = de[::-1]
    g["out"][0] = np.einsum("tbh,tbk->hk", hs[:, 0], de)
    g["out"][1] = np.einsum("tbh,tbk->hk", hs[:, 1], back)
    dh_all = np.stack([de @ w["out"][0].T, back @ w["out"][1].T], axis=1)
    dh = np.zeros((2, symbols.shape[1], n), w["h"].dtype)
    dc = np.zeros_like(dh)
    dx = np.empty((2, *symbols.shape, 4 * n), dh.dtype)
    for t in range(len(kept) - 1, -1, -1):
        z, gate, cand, before, c, squashed, h_before = kept[t]
        dh = dh + dh_all[t]
        dc = dc + dh * gate[..., 2 * n :] * (np.abs(c) < 1)
        dgate = np.concatenate([dc * cand, dc * before, dh * squashed], axis=-1)
        dz = np.concatenate([dgate * 0.25 * ((gate > 0) & (gate < 1)), dc * gate[..., :n] * (np.abs(z[..., 3 * n :]) < 1)], axis=-1)
        dx[:, t] = dz
        g["h"] += h_before.transpose(0, 2, 1) @ dz
        dh = dz @ w["h"].transpose(0, 2, 1)
        dc = dc * gate[..., n : 2 * n]
    g["b"] = dx.sum(axis=(1, 2))[:, None]
    for d in (0, 1):
        flat_dx, flat_x = dx[d].reshape(-1, 4 * n), seen[d].reshape(-1, EMBEDDING)
        g["x"][d] = flat_x.T @ flat_dx
        to = (flat_dx @ w["x"][d].T).astype(np.float64)
        for k in range(EMBEDDING):
            g["emb"][:, k] += np.bincount(both[d].ravel(), weights=to[:, k], minlength=SYMBOLS)
    return loss, g


@lru_cache(maxsize=4)
def _trained(hidden: int, texts: int, batch: int, steps: int, seed: int) -> dict:
    rng, source = np.random.default_rng(seed), random.Random(seed)
    pool = [labelled(source) for _ in range(texts)]
    symbols = np.stack([_SYMBOL[np.frombuffer(t, np.uint8)] for t, _ in pool]).astype(np.int64)
    gold = np.stack([m for _, m in pool])
    w = initial(rng, hidden)
    mean = {k: np.zeros_like(v) for k, v in w.items()}
    square = {k: np.zeros_like(v) for k, v in w.items()}
    for step in range(1, steps + 1):
        pick = rng.integers(0, texts, batch)
        _, g = gradients(w, symbols[pick].T, gold[pick].T)
        norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
        rate = 0.02 * min(1.0, 1.2 - step / steps)
        for k in w:
            x = g[k] / max(1.0, norm / 0.5)
            mean[k] = 0.9 * mean[k] + 0.1 * x
            square[k] = 0.99 * square[k] + 0.01 * x * x
            w[k] = (w[k] - rate * mean[k] / (1 - 0.9**step) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return w


def train(hidden: int = HIDDEN, texts: int = TEXTS, batch: int = BATCH, steps: int = STEPS, seed: int = SEED) -> dict[str, np.ndarray]:
    """Weights trained on so many generated texts; the same arguments give the same weights, once for each process."""
    return _trained(hidden, texts, batch, steps, seed)


# ---- tagging --------------------------------------------------------------


def emissions(w: dict, windows: np.ndarray) -> np.ndarray:
    """Emissions (T, labels, B) of windows (T, B), with no memory of the hidden states.

    Input and hidden state are one matrix, so that a step is one product; the gates'
    scale and shift are in the weights.
    """
    t_, b_ = windows.shape
    n = w["h"].shape[1]
    scale = np.concatenate([np.full(3 * n, 0.25), np.ones(n)]).astype(np.float32)
    shift = np.concatenate([np.full(3 * n, 0.5), np.zeros(n)]).astype(np.float32)
    out = np.empty((t_, len(LABELS), b_), np.float32)
    out[:] = w["bias"][:, None]
    z, part, work = np.empty((4 * n, b_), np.float32), np.empty((len(LABELS), b_), np.float32), np.empty((n, b_), np.float32)
    gate, cand = z[: 3 * n], z[3 * n :]
    enter, forget, leave = z[:n], z[n : 2 * n], z[2 * n : 3 * n]
    table = np.ascontiguousarray(w["emb"].T)
    for d in (0, 1):
        # rows: embedding, 1 for the shift, hidden state
        weight = np.ascontiguousarray(np.concatenate([w["x"][d] * scale, w["b"][d] * scale + shift, w["h"][d] * scale]).T)
        wo = np.ascontiguousarray(w["out"][d].T)
        state = np.zeros((EMBEDDING + 1 + n, b_), np.float32)
        x, h, c = state[:EMBEDDING], state[EMBEDDING + 1 :], np.zeros((n, b_), np.float32)
        state[EMBEDDING] = 1
        for t in range(t_) if d == 0 else range(t_ - 1, -1, -1):
            np.take(table, windows[t], axis=1, out=x, mode="clip")
            np.dot(weight, state, out=z)
            np.clip(gate, 0, 1, out=gate)
            np.clip(cand, -1, 1, out=cand)
            c *= forget
            np.multiply(enter, cand, out=work)
            c += work
            np.clip(c, -1, 1, out=work)
            np.multiply(leave, work, out=h)
            np.dot(wo, h, out=part)
            out[t] += part
    return out


def viterbi(e: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Best label paths (T, B)."""
    t_, b_, k = e.shape
    score, came = e[0].copy(), np.empty((t_, b_, k), np.uint8)
    for t in range(1, t_):
        s = score[:, :, None] + trans
        came[t] = s.argmax(axis=1)
        score = s.max(axis=1) + e[t]
    path = np.empty((t_, b_), np.uint8)
    path[-1] = score.argmax(axis=1)
    line = np.arange(b_)
    for t in range(t_ - 1, 0, -1):
        path[t - 1] = came[t, line, path[t]]
    return path


def best_score(e: np.ndarray, trans: np.ndarray, only: int | None = None) -> np.ndarray:
    """The score of the best path of each window, from emissions (T, labels, B), or that of one label throughout, added up in the same order."""
    by = trans.astype(np.float64)
    if only is not None:
        e, by = e[:, only : only + 1], by[only : only + 1, only : only + 1]
    by = by[:, :, None]
    score = e[0].astype(np.float64)
    step = np.empty((len(by), *score.shape))
    for t in range(1, len(e)):
        np.add(score[:, None, :], by, out=step)
        np.max(step, axis=0, out=score)
        score += e[t]
    return score.max(axis=0)


def reconciled(path: np.ndarray, sure: np.ndarray) -> np.ndarray:
    """One path over the stream from the windows' (T, B), whose last and first 2 * CONTEXT characters are the same.

    From each window to the next the change is where both have the same label, nearest the
    seam (the left place of two); if they have nowhere, all of the overlap is the one's that is
    surer, by sure (T, B), the margin of a character's label over "none" or the other way round.
    """
    both = 2 * CONTEXT
    left, right = path[CORE:, :-1], path[:both, 1:]
    order = np.argsort(np.abs(np.arange(both) - CONTEXT), kind="stable")
    agree = (left == right)[order]
    found = agree.any(axis=0)
    surer = sure[CORE:, :-1].sum(axis=0) >= sure[:both, 1:].sum(axis=0)
    cut = np.where(found, order[agree.argmax(axis=0)], np.where(surer, both, 0))
    out = path[CONTEXT : CONTEXT + CORE].copy()
    # the second half of an overlap lies in the right window's core, the first in the left one's
    at = np.arange(CONTEXT)[:, None]
    out[:CONTEXT, 1:] = np.where(at + CONTEXT < cut, left[CONTEXT:], out[:CONTEXT, 1:])
    out[CORE - CONTEXT :, :-1] = np.where(at >= cut, right[:CONTEXT], out[CORE - CONTEXT :, :-1])
    return out


def labels(w: dict, symbols: np.ndarray) -> np.ndarray:
    """The label of each symbol of a stream."""
    size = len(symbols)
    count = max(1, -(-size // CORE))
    padded = np.full(count * CORE + 2 * CONTEXT, SEPARATOR, np.uint8)
    padded[CONTEXT : CONTEXT + size] = symbols
    windows = np.lib.stride_tricks.sliding_window_view(padded, CORE + 2 * CONTEXT)[::CORE].T
    e = emissions(w, np.ascontiguousarray(windows))
    # a window whose best path is no better than "none" throughout has that path, and needn't be traced back
    open_ = np.flatnonzero(best_score(e, w["trans"]) > best_score(e, w["trans"], only=0))
    path, sure = np.zeros(windows.shape, np.uint8), np.zeros((1, count), np.float32)
    if len(open_):
        found = e[:, :, open_].transpose(0, 2, 1)
        path[:, open_] = viterbi(found, w["trans"])
    if count > 1 and len(open_):
        own = np.take_along_axis(e, path[:, None, :].astype(np.int64), axis=1)[:, 0]
        sure = own - np.where(path == 0, e[:, 1:].max(axis=1), e[:, 0])
        return np.ascontiguousarray(reconciled(path, sure).T).reshape(-1)[:size]
    return np.ascontiguousarray(path[CONTEXT : CONTEXT + CORE].T).reshape(-1)[:size]


#: What a span of a label must hold: one of these bytes, so many times.
_NEEDS = ((b"", 0), (b"@", 1), (b"0123456789", 7), (b".:", 3), (b"0123456789", 13), (bytes(x for x in range(33, 127) if not 97 <= x <= 122), 1))


def plausible(data: np.ndarray, label: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which spans data[start:end] are long enough and hold the characters that their label can't do without."""
    good = end - start >= LEAST[label]
    for k, (chars, least) in enumerate(_NEEDS):
        if least:
            table = np.zeros(256, bool)
            table[list(chars)] = True
            seen = np.append(0, np.cumsum(table[data]))
            good &= (label != k) | (seen[end] - seen[start] >= least)
    return good


def find(w: dict, chunk: flat.Chunk) -> tuple[np.ndarray, ...]:
    """(row, label, first byte, end byte) of the spans in a chunk, bytes counted from the row's begin."""
    n, rows = len(chunk.data), len(chunk.rows)
    stream = np.full(n + rows, SEPARATOR, np.uint8)
    at = np.arange(n) + np.repeat(np.arange(rows), np.diff(chunk.row_start))
    stream[at] = _SYMBOL[chunk.data]
    found = labels(w, stream)
    found[stream == SEPARATOR] = 0
    edge = np.flatnonzero(np.diff(np.concatenate([[0], found, [0]])))
    start, end = edge[:-1], edge[1:]
    inside = found[start] > 0
    start, end = start[inside], end[inside]
    raw = np.zeros(n + rows, np.uint8)
    raw[at] = chunk.data
    good = plausible(raw, found[start], start, end)
    start, end = start[good], end[good]
    begin = chunk.row_start[:-1] + np.arange(rows)
    row = np.searchsorted(begin, start, side="right") - 1
    return row, found[start], start - begin[row], end - begin[row]


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, kind, start_char, n_chars) of each span of personal data, characters counted from 0.

    Kinds: email, phone, ip, card, secret.  Whole texts are read.  Null and empty texts
    have no spans; rows without an id are left out; rows that are there twice give their
    spans twice; other columns are ignored.
    """
    w = train()

    def tag(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for chunk in flat.chunks(batch.column(1), 1_000_000):
                row, label, start, end = find(w, chunk)
                if not len(row):
                    continue
                chars = np.append(0, np.cumsum((chunk.data & 0xC0) != 0x80))
                base = chunk.row_start[row]
                first = chars[base + start] - chars[base]
                yield pa.record_batch(
                    [pa.array(ids[chunk.rows[row]], pa.int64()), pa.array([LABELS[x] for x in label], pa.string()), pa.array(first, pa.int32()), pa.array(chars[base + end] - chars[base + start], pa.int32())],
                    names=["doc_id", "kind", "start_char", "n_chars"],
                )

    return repeats.documents(docs, id_col, text_col).mapInArrow(tag, SCHEMA)
