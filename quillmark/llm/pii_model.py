"""Gradient-boosted trees over candidate features, fitted on made-up examples.

There are no labelled personal data to learn from, so examples are generated:
each is a span with the text around it, positive where the span is a credential,
an account number, an obfuscated address or a local phone number in its usual
company, negative for look-alikes (order numbers, build ids, measurements, long words).
The fit takes well under a second, is deterministic, and its trees become column
expressions in ``pii``; nothing here runs on executors.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

#: Kinds that the generators propose, in the order in which spans are listed after the base kinds.
KINDS = ("secret", "account", "address", "local_phone")
#: Words in the context (lower case, WINDOW characters before) that a feature looks for.
CUES = {
    "cue_secret": "token|secret|password|passwd|api key|apikey|api_key|bearer|credential",
    "cue_account": "account|iban|ssn|passport|social security|routing|card|licence no|tax id",
    "cue_phone": "phone|call|tel|fax|mobile|cell|whatsapp|dial",
    "cue_plain": "order|build|version|page|isbn|invoice|commit|pages|lines|sku|model|total|sum",
}
WINDOW = 24
FEATURES = ("kind", "size", "digits", "uppers", "distinct", "hex", "luhn", "quoted", "assigned", "separators", *CUES)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 * (d > 9)
    return bool(digits) and total % 10 == 0


def features(kind: str, span: str, before: str) -> list[float]:
    """The same numbers as ``pii.feature_struct`` makes with column expressions."""
    ctx = before[-WINDOW:].lower()
    digits = re.sub("[^0-9]", "", span)
    return [
        float(KINDS.index(kind)), float(len(span)), len(digits) / len(span), len(re.sub("[^A-Z]", "", span)) / len(span),
        float(len(set(span))), float(bool(re.fullmatch("[0-9A-Fa-f]+", span))), float(luhn(digits)),
        float(bool(re.search("[\"'`]$", ctx))), float(bool(re.search("[=:] ?[\"'`]?$", ctx))), float(len(re.sub("[^ .()-]", "", span))),
        *(float(bool(re.search(c, ctx))) for c in CUES.values()),
    ]


def examples(n: int = 3000, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(seed)
    pick = lambda xs: xs[int(r.integers(len(xs)))]
    chars = lambda alphabet, k: "".join(alphabet[i] for i in r.integers(len(alphabet), size=k))
    word = lambda: chars("abcdefghilmnoprstu", int(r.integers(2, 9)))
    hexes, base, dig = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "0123456789"
    x, y = [], []
    for _ in range(n):
        kind, good = pick(KINDS), bool(r.random() < 0.5)
        lead = f"{word()} {word()} "
        if kind == "secret":
            span = chars(pick([hexes, hexes.upper(), base]), int(r.integers(20, 64))) if good else pick([
                chars(hexes, int(r.integers(16, 40))), f"{word()}{word()}{word()}{chars(dig, 2)}{word()}", chars(dig, int(r.integers(16, 30))), f"{word()}-{word()}-{word()}-{chars(dig, 4)}",
            ])
            cue = pick(["token = \"", "secret: ", "api_key=", "password = '", "TOKEN = \"", "bearer "]) if good else pick(["commit ", "", "build ", "version ", "", f"{word()} "])
        elif kind == "account":
            span = chars(dig, int(r.integers(9, 19))) if good else chars(dig, int(r.integers(9, 19)))
            if r.random() < 0.4:
                span = f"{span[:3]}-{span[3:5]}-{span[5:9]}"
            cue = pick(["account ", "ssn ", "passport ", "IBAN ", "routing ", "tax id: "]) if good else pick(["order ", "invoice ", "", f"{word()} ", "isbn ", "total "])
        elif kind == "address":
            span = f"{word()}{pick([' ', ''])}{pick(['(at)', '[at]'])}{pick([' ', ''])}{word()}.{pick(['com', 'org', 'net'])}" if good else f"{word()} (at) {word()} . {word()}"
            cue = ""
        else:
            span = f"({chars(dig, 3)}) {chars(dig, 3)}-{chars(dig, 4)}" if r.random() < 0.5 else f"{chars(dig, 3)}-{chars(dig, 3)}-{chars(dig, 4)}"
            cue = pick(["call ", "phone ", "tel: ", "fax ", "mobile "]) if good else pick(["order ", "model ", "sku ", "", f"{word()} "])
        x.append(features(kind, span, lead + cue))
        y.append(float(good))
    for _ in range(n // 10):  # long ones
        kind, good = pick(("secret", "address")), bool(r.random() < 0.5)
        if kind == "secret":
            size = int(r.integers(64, 2000))
            span = pick([chars(hexes, size), chars(base + "-_", size), ".".join(chars(base + "-_", k) for k in (36, size, 43))]) if good else pick([
                chars(hexes, int(r.integers(64, 129))), "/".join(word() for _ in range(size // 5)) + chars(dig, 4), chars(dig, size), chars(base + "+/", size),
            ])
            cue = pick(["token = \"", "secret: ", "api_key=", "password = '", "TOKEN = \"", "bearer "]) if good else pick(["commit ", "", "build ", "version ", "", f"{word()} "])
        else:
            labels = [word() for _ in range(int(r.integers(2, 5)))] + [pick(["com", "org", "photography", "international"])]
            span = f"{word()}{pick(['.', ''])}{word()}{pick([' (at) ', '(at)', '[at]'])}{pick(['.', '(dot)', ' [dot] ']).join(labels)}" if good else f"{word()} (at) {' . '.join(labels)}"
            cue = ""
        x.append(features(kind, span, f"{word()} {word()} " + cue))
        y.append(float(good))
    return np.array(x), np.array(y)


@dataclass(frozen=True)
class Model:
    """trees: (feature, cut, (feature, cut, low, high) if below, the same if not); then p = 1 / (1 + exp(-(a * sum + b)))."""

    bias: float
    trees: tuple
    a: float
    b: float
    thresholds: tuple[float, ...]

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.bias)
        for f, cut, low, high in self.trees:
            for side, mask in ((low, x[:, f] < cut), (high, x[:, f] >= cut)):
                g, c, u, v = side
                out += np.where(mask, np.where(x[:, g] < c, u, v), 0.0)
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.a * self.raw(x) + self.b)))


def _split(x, g, h, cuts):
    best = None
    for f, cs in enumerate(cuts):
        for c in cs:
            m = x[:, f] < c
            hl, hr = h[m].sum(), h[~m].sum()
            if hl < 1 or hr < 1:
                continue
            gl, gr = g[m].sum(), g[~m].sum()
            gain = gl * gl / (hl + 1) + gr * gr / (hr + 1)
            if best is None or gain > best[0] + 1e-12:
                best = gain, f, float(c), float(-gl / (hl + 1)), float(-gr / (hr + 1))
    if best is None:
        v = float(-g.sum() / (h.sum() + 1))
        return 0.0, 0, 0.0, v, v
    return best


@lru_cache(maxsize=2)
def fitted(trees: int = 20, rate: float = 0.4, precision: float = 0.95) -> Model:
    """Boosting on the log loss with trees of depth two; Platt calibration and thresholds on examples kept apart.

    A kind's threshold is the smallest probability from which on at least ``precision`` of the kept-apart spans are positive.
    """
    x, y = examples()
    xc, yc = examples(2000, seed=4)
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0.02, 0.98, 16))) for f in range(x.shape[1])]
    cuts = [np.unique(np.concatenate([c, [0.5]])) if len(c) <= 2 else c for c in cuts]
    z, grown, bias = np.zeros(len(x)), [], 0.0
    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        g, h = p - y, p * (1 - p)
        _, f, c, _, _ = _split(x, g, h, cuts)
        sides, m = [], x[:, f] < c
        for mask in (m, ~m):
            _, f2, c2, u, v = _split(x[mask], g[mask], h[mask], cuts)
            sides.append((f2, c2, round(rate * u, 6), round(rate * v, 6)))
            z[mask] += np.where(x[mask, f2] < c2, sides[-1][2], sides[-1][3])
        grown.append((f, c, sides[0], sides[1]))
    model = Model(bias, tuple(grown), 1.0, 0.0, ())
    s = model.raw(xc)
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-(a * s + b)))
        w = np.maximum(p * (1 - p), 1e-9)
        hess = np.array([[(w * s * s).sum(), (w * s).sum()], [(w * s).sum(), w.sum()]]) + 1e-6 * np.eye(2)
        step = np.linalg.solve(hess, [((p - yc) * s).sum(), (p - yc).sum()])
        a, b = a - step[0], b - step[1]
    p = 1 / (1 + np.exp(-(a * s + b)))
    limits = []
    for k in range(len(KINDS)):
        m = xc[:, 0] == k
        order = np.argsort(-p[m], kind="stable")
        hits = np.cumsum(yc[m][order]) / np.arange(1, m.sum() + 1)
        ok = np.flatnonzero(hits >= precision)
        limits.append(round(float(p[m][order][ok[-1]]) if len(ok) else 1.1, 6))
    return Model(bias, model.trees, round(float(a), 6), round(float(b), 6), tuple(max(x, math.nextafter(0.5, 1)) for x in limits))
