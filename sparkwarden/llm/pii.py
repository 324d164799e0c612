"""Personal data: base patterns plus a character BiLSTM-CRF trained in numpy.

The base finds e-mail addresses, IPv4 addresses, card and phone numbers by
fixed patterns.  The model adds spans of the same kinds written in other ways
("jo (at) host.org", "(212) 555-0134").  It is trained on labelled spans in
sentences from a seeded generator, so it is the same for every corpus; its
weights lie beside this module, and ``python -m sparkwarden.llm.pii`` trains
them anew.  Every span it can emit holds a digit, an at sign, a bracketed "at"
or a spelt "dot"; overlapping windows are laid over all stretches around those,
each is decoded on its own, a window that cuts a span grows until the span is
whole, and one weighted-interval pass over the whole text picks the final spans.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
GATE = re.compile(r"[0-9@\uff20]|[\[({<] ?at ?[\])}>]|[\[({< ]dot[\])}> ]", re.I)
#: First windows and their distance; a stretch reaches so far from its gates, and on to the next white space.
WINDOW, STEP, REACH = 128, 64, 40
#: A window grows up to this; no address is half as long (64 + 1 + 255 characters), however its dots are spelt.
LONGEST, MOST_DIGITS = 1280, 19
HIDDEN = 24
WEIGHTS = Path(__file__).with_name("pii_weights.npz")
TAGS = 1 + 2 * len(KINDS)  # O, then B and I of each kind


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Leftmost non-overlapping matches of each kind, by kind, then start; linear in the text."""
    out, done = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at) if start < at else None
        if m:
            out.append(("email", start, m.end()))
        done = m.end() if m else at + 1
        at = text.find("@", done)
    if re.search("[0-9]", text):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                out.append(("ip", *m.span()))
        for m in CARD.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
        for m in PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append(("phone", *m.span()))
    return out


# ---------------------------------------------------------------- the model

CLASSES = {c: i for i, c in enumerate("@._%+-()[]{}<> \n:/#=,\"'*&$|;!?abcdefghijklmnopqrstuvwxyz")}
DIGIT, ALPHA, OTHER = len(CLASSES), len(CLASSES) + 1, len(CLASSES) + 2
N_CLASS = len(CLASSES) + 3


@functools.lru_cache(maxsize=1)
def _class_table() -> np.ndarray:
    def of(c: str) -> int:
        return DIGIT if c in "0123456789" else CLASSES.get("@" if c == "\uff20" else c.lower(), ALPHA if c.isalpha() else OTHER)

    return np.asarray([of(chr(i)) for i in range(1 << 16)] + [ALPHA], "int64")


def char_classes(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return _class_table()[np.minimum(codes, 1 << 16)]


# Words of the generator's sentences (fixed values): common words of four languages, and lead-ins of the kinds.
COMMON = (
    "the of and to in is that for it was on are as with his they at be this have from or one had by word but not what all were we when your can said there use an each which she do how their if will up other about out many then them these so some her would make like him into time has look two more write go see number no way could people my than first water been call who its now find long down day did get come made may part "
    "der die und in den von zu das mit sich des auf ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem "
    "le la les des et un une du en est que pour dans qui pas sur plus par avec ce sont au il mais "
    "el los las de que y un una en es por con para se del al lo como pero sus"
).split()
LEADS = (("write to", "mail", "e-mail:", "contact", "reach", "email", "schreiben Sie an", "contactez", "escriba a"), ("server", "host", "from", "IP", "ip:", "address", "client", "at"), ("card", "card number:", "Visa", "paid with", "account", "Karte", "carte"), ("call", "tel.", "tel:", "phone", "Phone:", "fax", "ring", "Telefon", "appelez", "llame al"))


def generate(n: int, seed: int = 0, width: int = WINDOW) -> list[tuple[np.ndarray, np.ndarray]]:
    """``(classes, tags)`` of n seeded windows with labelled spans among sentences and look-alikes.

    A window may begin or end inside a span, as windows over a text do; the part
    that is left is labelled as a span.
    """
    rng = np.random.default_rng(seed)
    letters = list("etaoinshrdlucmfwygpbvkjxqz")
    strange = list("etaoinshrdlucméèäüßñóçíöа日")
    digits = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    word = lambda a=2, b=9: "".join(rng.choice(letters, rng.integers(a, b)))
    pick = lambda *x: x[rng.integers(len(x))]

    def one_word() -> str:
        w = pick(*COMMON) if rng.random() < 0.5 else word(2, 10) if rng.random() < 0.7 else "".join(rng.choice(strange, rng.integers(1, 10)))
        return w.capitalize() if rng.random() < 0.12 else w

    def prose(most: int = 9) -> str:
        glue = pick(" ", " ", " ", " ", "### ", "&&& ", " | ", "\n")
        return glue.join(one_word() for _ in range(rng.integers(1, most))) + pick("", "", "", ".", ",", ":", "?", " \n")

    def email() -> str:
        at = pick("@", " @ ", " (at) ", "(at)", " [at] ", "[at]", " at ", "{at}", " <at> ", " (AT) ", "[AT]", " AT ", "\uff20")
        spelt = (" dot ", "(dot)", " [dot] ", " (dot) ", "[dot]", " DOT ", "[.]")
        dot = pick(*spelt) if at.strip().lower() == "at" else pick(".", ".", ".", *spelt)
        local = pick(word(), word(1, 2) + "." + word(), word() + "." + word(), word() + "." + digits(2), word() + "_" + word(2, 4), word() + digits(rng.integers(1, 5)), word(3, 8) + "-" + word(3, 8), word(12, 30))
        host = pick("example", "mail" + digits(1), word(), word() + "-" + word(3, 6), word(3, 9), "department" + dot + "university", word(2, 6) + dot + word(3, 9))
        return (local.title() if rng.random() < 0.15 else local) + at + host + dot + pick("com", "org", "net", "de", "edu", "fr", "es", "info", "co" + dot + "uk")

    def ip() -> str:
        return pick(".", " . ", "[.]", "(.)", " dot ", "[dot]").join(str(rng.integers(0, 256)) for _ in range(4))

    def card() -> str:
        return pick("", " ", "-", ".", "  ", " - ", "/", "_", "\u00a0", "\u2013").join(digits(4) for _ in range(4))

    def phone() -> str:
        return pick("+{a} ({b}) {c}-{d}", "({b}) {c}-{d}", "({b}){c}-{d}", "{b}-{c}-{d}", "{b}.{c}.{d}", "+{a} {b} {c} {d}", "1-{b}-{c}-{d}", "({b}) {c} {d}", "0{b} {c}{d}", "0{b}/{c}{d}", "00{a} {b} {c}{d}", "+{a} (0) {b} / {c}{d}", "0{a} {d} {e}", "({b}) {c}.{d}").format(
            a=rng.integers(1, 99), b=digits(3), c=digits(3), d=digits(4), e=digits(4)
        )

    def decoy() -> str:
        hexes = lambda k: "".join(rng.choice(list("0123456789abcdef"), k))
        return pick(
            digits(rng.integers(1, 7)), digits(rng.integers(7, 15)), digits(rng.integers(20, 30)), f"20{digits(2)}-{digits(2)}-{digits(2)}", f"{digits(2)}/{digits(2)}/20{digits(2)}", f"{digits(2)}.{digits(2)}.19{digits(2)}", f"{digits(1)}.{digits(1)}.{digits(1)}", f"v{digits(1)}.{digits(2)}.{digits(1)}-rc{digits(1)}", f"{digits(1)}.{digits(1)}.{digits(1)}.{digits(1)}.{digits(2)}",
            hexes(40), f'token = "{hexes(24)}"', f"@{word()}", f"{digits(1)}.{digits(2)}", f"{digits(2)}:{digits(2)}:{digits(2)}", f"http://{word()}.com/{digits(3)}", f"https://{word()}.org/{word()}/{digits(4)}-{digits(2)}", f"password={word()}{digits(3)}", f"AKIA{word(16, 17).upper()}", f"{digits(3)},{digits(3)}.{digits(2)}", f"{digits(1)},{digits(3)},{digits(3)}",
            f"ISBN 978-{digits(1)}-{digits(2)}-{digits(6)}-{digits(1)}", f"{hexes(8)}-{hexes(4)}-{hexes(4)}-{hexes(4)}-{hexes(12)}", f"pp. {digits(3)}-{digits(3)}", f"{digits(4)}-{digits(4)}", f"INV-20{digits(2)}-{digits(5)}", f"{digits(2)}.{digits(4)}, {digits(2)}.{digits(4)}", " ".join(digits(rng.integers(1, 4)) for _ in range(rng.integers(2, 9))), f"{digits(3)}-{digits(2)}-{digits(4)}", f"§ {digits(3)} ({digits(1)})",
            f"meet at {word()} ({digits(2)})", "look at the dot on it", "a dot at the end", f"x[{digits(1)}] = y[{digits(2)}]", f"{digits(5)}-{digits(4)}", "CC BY-NC 4.0", f"{word()} | {digits(3)} | {digits(2)} | {word()}", f"#{digits(6)}", f"{digits(2)}%", f"${digits(2)}.{digits(2)}", f"({digits(4)})", f"[{digits(2)}]", f"at {digits(2)}.{digits(1)} and {digits(2)}.{digits(1)}",
        )

    kinds, out = (email, ip, card, phone), []
    while len(out) < n:
        text, tags = "", []
        for _ in range(rng.integers(1, 4)):
            p = prose() + " "
            roll = rng.random()
            k = int(rng.integers(len(KINDS)))
            if roll < 0.5 and rng.random() < 0.5:
                p += pick(*LEADS[k]) + " "
            s = kinds[k]() if roll < 0.5 else decoy() if roll < 0.85 else ""
            after = pick(" ", " ", ". ", ", ", "\n", "### ", "%%% ", "; ", ") ", " or ", " and ") if s else ""
            text += p + s + after
            tags += [0] * len(p) + ([1 + 2 * k, *[2 + 2 * k] * (len(s) - 1)] if roll < 0.5 else [0] * len(s)) + [0] * len(after)
        if rng.random() < 0.7:
            p = prose()
            text, tags = text + p, tags + [0] * len(p)
        else:  # the text ends with a span, or with a sign right after it
            end = len(text.rstrip())
            p = pick("", "", ".", "!", ")")
            text, tags = text[:end] + p, tags[:end] + [0] * len(p)
        at = int(rng.integers(0, max(1, len(text) - width + 1))) if rng.random() < 0.7 else 0
        cut = tags[at : at + width]
        if cut and cut[0] and cut[0] % 2 == 0:
            rest = next((i for i, t in enumerate(cut) if t != cut[0]), len(cut))
            cut = [cut[0] - 1, *cut[1:]] if rest > 1 else [0, *cut[1:]]
        out.append((char_classes(text[at : at + width]), np.asarray(cut)))
    return out


def _batch(rows: list[np.ndarray], fill: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Rows side by side, as wide as the longest, and where they hold something."""
    lens = np.asarray([len(r) for r in rows])
    out = np.full((len(rows), int(lens.max())), fill, "int64")
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out, np.arange(out.shape[1])[None, :] < lens[:, None]


def _sig(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


def _lstm(x: np.ndarray, mask: np.ndarray, wx: np.ndarray, wh: np.ndarray, b: np.ndarray, keep: bool = False):
    """States over ``x`` (batch, time) of classes; masked steps carry no state.  With ``keep``, what the way back needs as well."""
    n, t, h = len(x), x.shape[1], wh.shape[0]
    hs, cell = np.zeros((t + 1, n, h), "float32"), np.zeros((n, h), "float32")
    cs, gates = (np.zeros((t + 1, n, h), "float32"), np.zeros((t, n, 4 * h), "float32")) if keep else (None, None)
    for i in range(t):
        z = wx[x[:, i]] + hs[i] @ wh + b
        g = np.concatenate((_sig(z[:, : 3 * h]), np.tanh(z[:, 3 * h :])), 1)
        m = mask[:, i : i + 1]
        cell = (g[:, h : 2 * h] * cell + g[:, :h] * g[:, 3 * h :]) * m
        hs[i + 1] = g[:, 2 * h : 3 * h] * np.tanh(cell) * m
        if keep:
            cs[i + 1], gates[i] = cell, g
    return (hs[1:], (hs, cs, gates)) if keep else (hs[1:], None)


def _lstm_back(dh_out: np.ndarray, x: np.ndarray, mask: np.ndarray, wh: np.ndarray, n_class: int, kept) -> list[np.ndarray]:
    hs, cs, gates = kept
    t, n, h = dh_out.shape
    dwx, dwh, db = np.zeros((n_class, 4 * h)), np.zeros_like(wh), np.zeros(4 * h)
    dh, dc = np.zeros((n, h)), np.zeros((n, h))
    for i in range(t - 1, -1, -1):
        g, m = gates[i], mask[:, i : i + 1]
        dh = (dh + dh_out[i]) * m
        tc = np.tanh(cs[i + 1])
        dc = (dc + dh * g[:, 2 * h : 3 * h] * (1 - tc * tc)) * m
        dz = np.concatenate((dc * g[:, 3 * h :], dc * cs[i], dh * tc), 1) * g[:, : 3 * h] * (1 - g[:, : 3 * h])
        dz = np.concatenate((dz, dc * g[:, :h] * (1 - g[:, 3 * h :] ** 2)), 1)
        np.add.at(dwx, x[:, i], dz)
        dwh += hs[i].T @ dz
        db += dz.sum(0)
        dh, dc = dz @ wh.T, dc * g[:, h : 2 * h]
    return [dwx, dwh, db]


class Tagger:
    """Parameters: input, recurrent and bias weights each way; output; CRF transitions; and the least score of each kind."""

    def __init__(self, params: list[np.ndarray], least: np.ndarray | None = None):
        self.params, self.least = params, np.zeros(len(KINDS)) if least is None else least

    def emissions(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        fx, fh, fb, bx, bh, bb, ow, ob, _ = self.params
        f, _ = _lstm(x, mask, fx, fh, fb)
        b, _ = _lstm(x[:, ::-1], mask[:, ::-1], bx, bh, bb)
        return np.concatenate((f, b[::-1]), 2) @ ow + ob

    def paths(self, rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Best tags (row, time) by Viterbi, and the emissions (time, row, tag)."""
        x, mask = _batch(rows)
        e, tr = self.emissions(x, mask), self.params[-1]
        (n, wide) = x.shape
        best, back = e[0] + _START, np.zeros((wide, n, TAGS), "int8")
        for t in range(1, wide):
            s = best[:, :, None] + tr[None]
            back[t] = s.argmax(1)
            best = np.where(mask[:, t, None], s.max(1) + e[t], best)
            back[t][~mask[:, t]] = np.arange(TAGS)
        tag = best.argmax(1)
        path = np.zeros((n, wide), "int64")
        for t in range(wide - 1, -1, -1):
            path[:, t] = tag
            tag = back[t][np.arange(n), tag]
        return path, e

    def decode(self, rows: list[np.ndarray]) -> list[list[tuple[int, int, int, float]]]:
        """Spans ``(kind, start, end, score)`` of each window; the score is the log odds of the span's tags against none."""
        path, e = self.paths(rows)
        tr, out = self.params[-1], []
        for i, r in enumerate(rows):
            spans, p = [], path[i, : len(r)]
            for t in np.flatnonzero(p % 2).tolist():
                u = t + 1
                while u < len(p) and p[u] == p[t] + 1:
                    u += 1
                at = np.arange(t, u)
                tags = np.concatenate(([0], p[t:u], [0]))
                score = (e[at, i, p[at]] - e[at, i, 0]).sum() + (tr[tags[:-1], tags[1:]] - tr[0, 0]).sum()
                spans.append((int(p[t] - 1) // 2, t, u, float(score)))
            out.append(spans)
        return out


# Tag j may follow tag i: an I only its own B or I; a window does not start inside a span.
_ALLOWED = np.asarray([[j == 0 or j % 2 == 1 or i in (j, j - 1) for j in range(TAGS)] for i in range(TAGS)])
_START = np.asarray([0.0 if j == 0 or j % 2 else -1e4 for j in range(TAGS)])


def gradients(params: list[np.ndarray], group: list[tuple[np.ndarray, np.ndarray]]) -> tuple[float, list[np.ndarray]]:
    """Mean negative log likelihood of labelled windows under the CRF, and its gradient."""
    x, mask = _batch([g[0] for g in group])
    y, _ = _batch([g[1] for g in group])
    fx, fh, fb, bx, bh, bb, ow, ob, tr = params
    h, (n, wide) = fh.shape[0], x.shape
    f, fk = _lstm(x, mask, fx, fh, fb, True)
    rx, rm = x[:, ::-1], mask[:, ::-1]
    b, bk = _lstm(rx, rm, bx, bh, bb, True)
    hid = np.concatenate((f, b[::-1]), 2)
    e = hid @ ow + ob
    alpha, beta = np.zeros((wide, n, TAGS)), np.zeros((wide, n, TAGS))
    alpha[0] = e[0] + _START
    lse = lambda v, ax: (m := v.max(ax, keepdims=True)).squeeze(ax) + np.log(np.exp(v - m).sum(ax))
    for t in range(1, wide):
        alpha[t] = np.where(mask[:, t, None], lse(alpha[t - 1][:, :, None] + tr[None], 1) + e[t], alpha[t - 1])
    z = lse(alpha[-1], 1)
    for t in range(wide - 2, -1, -1):
        beta[t] = np.where(mask[:, t + 1, None], lse(tr[None] + (e[t + 1] + beta[t + 1])[:, None, :], 2), beta[t + 1])
    post = np.exp(alpha + beta - z[None, :, None])
    gold = np.zeros_like(post)
    np.put_along_axis(gold, y.T[:, :, None], 1.0, 2)
    live = mask.T[:, :, None]
    de = (post - gold) * live / n
    right = (e * gold * live).sum() + _START[y[:, 0]].sum()
    dtr = np.zeros_like(tr)
    for t in range(1, wide):
        on = mask[:, t]
        joint = np.exp(alpha[t - 1][on][:, :, None] + tr[None] + (e[t] + beta[t])[on][:, None, :] - z[on][:, None, None])
        dtr += joint.sum(0)
        np.add.at(dtr, (y[on, t - 1], y[on, t]), -1.0)
        right += tr[y[on, t - 1], y[on, t]].sum()
    dtr = np.where(_ALLOWED, dtr / n, 0.0)
    dhid = de @ ow.T
    return float((z.sum() - right) / n), [
        *_lstm_back(dhid[:, :, :h], x, mask, fh, N_CLASS, fk), *_lstm_back(dhid[::-1, :, h:], rx, rm, bh, N_CLASS, bk),
        np.tensordot(hid, de, ((0, 1), (0, 1))), de.sum((0, 1)), dtr,
    ]


def fit(rows: list[tuple[np.ndarray, np.ndarray]], epochs: int = 8, size: int = 16, rate: float = 0.015, clip: float = 5.0, seed: int = 0) -> Tagger:
    """Adam on the CRF likelihood of labelled windows, with gradients no longer than ``clip``."""
    rng = np.random.default_rng(seed)
    init = lambda *s: (rng.standard_normal(s) * 0.15)
    h = HIDDEN
    params = [init(N_CLASS, 4 * h), init(h, 4 * h), np.zeros(4 * h), init(N_CLASS, 4 * h), init(h, 4 * h), np.zeros(4 * h), init(2 * h, TAGS), np.zeros(TAGS), np.where(_ALLOWED, 0.0, -1e4)]
    for b in (2, 5):
        params[b][h : 2 * h] = 1.0
    m1, m2, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for epoch in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), size):
            _, grads = gradients(params, [rows[i] for i in order[at : at + size]])
            norm = np.sqrt(sum((g * g).sum() for g in grads))
            grads = [g * min(1.0, clip / norm) for g in grads]
            step += 1
            lr = rate * (1 - epoch / (epochs + 1))
            for k, g in enumerate(grads):
                m1[k] = 0.9 * m1[k] + 0.1 * g
                m2[k] = 0.999 * m2[k] + 0.001 * g * g
                params[k] -= lr * m1[k] / (1 - 0.9**step) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)
    return Tagger([p.astype("float32") for p in params])


def calibrated(tagger: Tagger, rows: list[tuple[np.ndarray, np.ndarray]], precision: float = 0.99) -> Tagger:
    """The tagger with the least score of each kind at which so many of its spans in labelled windows are right."""
    seen: list[list[tuple[float, bool]]] = [[] for _ in KINDS]
    for at in range(0, len(rows), 512):
        group = rows[at : at + 512]
        for (_, tags), spans in zip(group, tagger.decode([c for c, _ in group])):
            for kind, a, b, score in spans:
                whole = tags[a] == 1 + 2 * kind and (tags[a + 1 : b] == 2 + 2 * kind).all() and (b == len(tags) or tags[b] != 2 + 2 * kind)
                seen[kind].append((score, bool(whole)))
    least = np.zeros(len(KINDS))
    for kind, got in enumerate(seen):
        got.sort(reverse=True)
        share = np.cumsum([ok for _, ok in got]) / np.arange(1, len(got) + 1)
        good = np.flatnonzero(share >= precision)
        least[kind] = got[int(good[-1])][0] if len(good) else np.inf
    return Tagger(tagger.params, least)


def trained(n: int = 14_000, epochs: int = 7, seed: int = 0) -> Tagger:
    """Fitted and calibrated on generated windows; depends on its arguments only."""
    return calibrated(fit(generate(n, seed), epochs, seed=seed), generate(max(200, n // 3), seed + 1))


@functools.lru_cache(maxsize=1)
def default_tagger() -> Tagger:
    """The stored weights, trained by this module; trained here if the file is absent."""
    if not WEIGHTS.exists():
        return trained()
    with np.load(WEIGHTS) as kept:
        return Tagger([kept[f"p{i}"] for i in range(9)], kept["least"])


# ---------------------------------------------------------------- whole texts


def windows_of(text: str) -> list[tuple[int, int]]:
    """Overlapping windows over every stretch near a character that a span must hold."""
    out, reach = [], (-1, -1)

    def close() -> None:
        a, b = reach
        while a >= 0:
            out.append((a, min(b, a + WINDOW)))
            if a + WINDOW >= b:
                break
            a += STEP

    for m in GATE.finditer(text):
        if m.end() + REACH <= reach[1]:
            continue
        a, b = max(0, m.start() - REACH), min(len(text), m.end() + REACH)
        while a > max(0, reach[1]) and not text[a - 1].isspace():
            a -= 1
        while b < len(text) and not text[b].isspace():
            b += 1
        if a <= reach[1]:
            reach = (reach[0], b)
        else:
            close()
            reach = (a, b)
    close()
    return out


def passes(kind: int, s: str) -> bool:
    """The contract's own tests of digits; an e-mail address has none."""
    digits = "".join(c for c in s if c in "0123456789")
    if kind == 0:
        return True
    if kind == 1:
        parts = re.findall(r"[0-9]+", s)
        return len(parts) == 4 and all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in parts)
    return 16 <= len(digits) <= 19 and luhn(digits) if kind == 2 else 8 <= len(digits) <= 15


def reconcile(found: list[tuple[int, int, int, float]]) -> list[tuple[int, int, int]]:
    """Non-overlapping spans of greatest total score; a span seen in several windows scores their mean."""
    total: dict[tuple[int, int, int], list[float]] = {}
    for kind, a, b, s in found:
        total.setdefault((b, a, kind), []).append(s)
    spans = sorted((b, a, kind, sum(v) / len(v)) for (b, a, kind), v in total.items() if sum(v) > 0)
    ends = np.asarray([s[0] for s in spans])
    best, take = [0.0], []
    for i, (b, a, kind, s) in enumerate(spans):
        j = int(np.searchsorted(ends[:i], a, "right"))
        take.append((best[j] + s > best[i], j))
        best.append(max(best[i], best[j] + s))
    out, i = [], len(spans)
    while i:
        if take[i - 1][0]:
            out.append((spans[i - 1][2], spans[i - 1][1], spans[i - 1][0]))
            i = take[i - 1][1]
        else:
            i -= 1
    return out[::-1]


def find(texts: list[str], tagger: Tagger, at_once: int = 512) -> list[tuple[list, list]]:
    """``(base spans, added spans)`` of whole texts, each ``(kind, start, end)`` in code points.

    Beside the model's least scores, an added span must hold a gate, pass the
    digit tests of its kind, and overlap no base span.
    """
    base = [base_spans(t) for t in texts]
    added: list[list] = [[] for _ in texts]
    seen: list[list] = [[] for _ in texts]

    def tagged(queue: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """Decodes windows ``(text, start, end)``; returns the wider ones asked for by spans that touch a cut edge."""
        wider: dict[tuple[int, int, int], None] = {}
        # windows of like width go together, so that a batch never holds more than `at_once` first windows would
        queue = sorted(queue, key=lambda q: q[2] - q[1])
        decoded, at = [], 0
        while at < len(queue):
            n = 1
            while at + n < len(queue) and (n + 1) * (queue[at + n][2] - queue[at + n][1]) <= at_once * WINDOW:
                n += 1
            decoded += tagger.decode([char_classes(texts[i][a:b]) for i, a, b in queue[at : at + n]])
            at += n
        for (i, a, b), spans in zip(queue, decoded):
            for kind, u, v, score in spans:
                low, high = u == 0 and a > 0, v == b - a and b < len(texts[i])
                if low or high:
                    # a number with more digits than any kind has does not become one by growing
                    if b - a < LONGEST and (kind == 0 or sum(c in "0123456789" for c in texts[i][a + u : a + v]) <= MOST_DIGITS):
                        more = -(-(b - a) // WINDOW) * WINDOW  # coarser steps for wider windows, so that neighbours grow into one
                        wider[(i, max(0, a - more) // more * more if low else a, min(len(texts[i]), -(-(b + more) // more) * more) if high else b)] = None
                elif score >= tagger.least[kind]:
                    seen[i].append((kind, a + u, a + v, score))
        return list(wider)

    queue: list[tuple[int, int, int]] = []
    for i, text in enumerate(texts):
        for a, b in windows_of(text):
            queue.append((i, a, b))
            if len(queue) == at_once:
                queue = tagged(queue)
    while queue:
        queue = tagged(queue[:at_once]) + queue[at_once:]
    for i, text in enumerate(texts):
        taken = sorted((a, b) for _, a, b in base[i])
        starts, ends = [t[0] for t in taken], [t[1] for t in taken]
        for kind, a, b in reconcile([s for s in seen[i] if GATE.search(text, s[1], s[2]) and passes(s[0], text[s[1] : s[2]])]):
            j = int(np.searchsorted(starts, b))  # base spans that start before b
            if not any(e > a for e in ends[max(0, j - 4) : j]):
                added[i].append((KINDS[kind], a, b))
    return list(zip(base, added))


def digest(spans: list[tuple[str, int, int]]) -> str:
    order = {k: i for i, k in enumerate(KINDS)}
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (order[s[0]], s[1], s[2])))


def detect(docs: DataFrame, tagger: Tagger | None = None) -> DataFrame:
    """One row per document: ``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans``.

    Counts and hash are of the base spans; ``spans`` lists base and added ones.
    Null texts count as empty; repeated rows give equal rows.
    """
    tagger = tagger or default_tagger()
    model = docs.sparkSession.sparkContext.broadcast((tagger.params, tagger.least))  # fixed size

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tag = Tagger(*model.value)
        for pdf in batches:
            rows = []
            for doc_id, (base, added) in zip(pdf["doc_id"], find([t if isinstance(t, str) else "" for t in pdf["text"]], tag)):
                n = [sum(s[0] == k for s in base) for k in KINDS]
                rows.append((doc_id, *n, hashlib.sha256(digest(base).encode()).hexdigest(), digest(base + added)))
            out = pd.DataFrame(rows, columns=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInPandas(run, schema)


def mask(docs: DataFrame, tagger: Tagger | None = None) -> DataFrame:
    """``docs`` with every span in ``text`` replaced by ``<KIND>``; ``n_chars``, where present, follows.

    Null texts stay null; all rows and columns are kept.
    """
    tagger = tagger or default_tagger()
    model = docs.sparkSession.sparkContext.broadcast((tagger.params, tagger.least))

    @F.pandas_udf("string")
    def masked(texts: pd.Series) -> pd.Series:
        known = [t if isinstance(t, str) else "" for t in texts]
        out = []
        for raw, text, (base, added) in zip(texts, known, find(known, Tagger(*model.value))):
            spans = sorted((a, b, k) for k, a, b in base + added)
            parts, at = [], 0
            for a, b, k in spans:
                if b > at:
                    parts += [text[at : max(a, at)], f"<{k.upper()}>" if a >= at else ""]
                    at = b
            out.append("".join(parts) + text[at:] if isinstance(raw, str) else None)
        return pd.Series(out, dtype="object")

    out = docs.withColumn("text", masked(F.col("text").cast("string")))
    return out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else out


if __name__ == "__main__":
    best = trained()
    np.savez_compressed(WEIGHTS, least=best.least, **{f"p{i}": p for i, p in enumerate(best.params)})
