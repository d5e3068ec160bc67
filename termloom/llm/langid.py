"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Trained with follow-the-regularised-leader (elastic net), then calibrated with a temperature on held-out sentences. Training uses a bounded,
labelled sample on the driver; applying it is vectorized over many sentences at a time.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np

#: At most so many labelled texts are used for training.
MAX_SAMPLES = 20_000
ORDERS = (2, 4)
BITS = 15
BUCKETS = 1 << BITS
#: Where a sentence ends. Begins with one set of letters, which is searched for much faster than a choice or a look behind at every letter.
_END = re.compile(r"([.!?。！？\n])(?:(?<=[.!?])\s+|(?<=[。！？])\s*|(?<=\n)\n*)")


def sentences(text: str) -> list[str]:
    parts = _END.split(text)  # texts and the marks between them
    parts.append("")
    return [s for t, mark in zip(parts[::2], parts[1::2]) if (s := (t + mark).strip())]


def grams(texts: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
    """For each order, the row of the weights for the n-gram at each character of all texts together (the last row, of zeroes, where
    it would reach over its text's end); and where texts start.

    Texts are lower-cased and stand between two spaces; all digits are one character.
    """
    padded = [f" {t.lower()} " for t in texts]
    lengths = np.fromiter(map(len, padded), np.int64, len(padded))
    ends = np.cumsum(lengths)
    codes = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    codes[(codes >= 48) & (codes <= 57)] = 48
    out, acc, none = [], codes * np.uint32(0x9E3779B1), len(ORDERS) * BUCKETS
    for n in range(2, max(ORDERS) + 1):
        acc = acc[:-1] * np.uint32(0x85EBCA6B) + codes[n - 1:] * np.uint32(0x9E3779B1)
        acc ^= acc >> np.uint32(15)
        if n in ORDERS:
            b = np.full(len(codes), none, np.int32)
            b[:len(acc)] = ((acc * np.uint32(0xC2B2AE35)) >> np.uint32(32 - BITS)).astype(np.int32) + ORDERS.index(n) * BUCKETS
            for k in range(1, n):
                b[np.maximum(ends - k, 0)] = none
            out.append(b)
    return out, ends - lengths


@dataclass
class Model:
    languages: tuple[str, ...]
    weights: np.ndarray  # (orders * BUCKETS + 1, languages): idf times coefficient; the last row is zero
    bias: np.ndarray
    temperature: float = 1.0

    def logits(self, texts: list[str], chunk: int = 40_000) -> np.ndarray:
        """One row per text; not yet divided by the temperature. Works on as many characters at a time as stay in the cache."""
        out, at = np.zeros((len(texts), len(self.languages)), np.float32), 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end]) < chunk):
                size += len(texts[end])
                end += 1
            gs, starts = grams(texts[at:end])
            total = np.take(self.weights, gs[0], axis=0, mode="clip")  # all are in range; without the check it is four times as fast
            for g in gs[1:]:
                total += np.take(self.weights, g, axis=0, mode="clip")
            n = np.diff(np.append(starts, len(gs[0])))
            count = sum(np.maximum(0, n - (o - 1)) for o in ORDERS)
            out[at:end] = np.add.reduceat(total, starts, axis=0) / np.maximum(1, count)[:, None] + self.bias
            at = end
        return out

    def log_probabilities(self, logits: np.ndarray) -> np.ndarray:
        z = logits / self.temperature
        z = z - z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def train(samples: list[tuple[str, str]], epochs: int = 20, alpha: float = 0.3, beta: float = 1.0, l1: float = 1e-3, l2: float = 1e-3,
          scale: float = 20.0, held_out: int = 5, seed: int = 3) -> Model:
    """A model from ``(language, text)``; every ``held_out``-th text only serves to find the temperature. Without samples
    every text is ``und``.

    Features are tf-idf values: the share of a sentence's n-grams, times ln(texts / texts with it) + 1, times ``scale``.
    """
    samples = sorted((lang, t) for lang, t in samples if lang and t and t.strip())[:MAX_SAMPLES]
    if not samples:
        return Model(("und",), np.zeros((len(ORDERS) * BUCKETS + 1, 1), np.float32), np.zeros(1, np.float32))
    languages = tuple(sorted({lang for lang, _ in samples}))
    width = len(ORDERS) * BUCKETS
    pieces = [(i, languages.index(lang), s) for i, (lang, t) in enumerate(samples) for s in {t.strip(), *sentences(t)}]
    rng = np.random.default_rng(seed)
    pieces.sort()
    gs, starts = grams([s for _, _, s in pieces])
    ends = np.append(starts[1:], len(gs[0]))
    rows = []
    for a, b in zip(starts, ends):
        f = np.concatenate([g[a:b] for g in gs])
        f = f[f < width]
        ids, n = np.unique(f, return_counts=True)
        rows.append((ids, n / len(f)))
    df = np.zeros(width)
    for ids, _ in rows:
        df[ids] += 1
    idf = np.log(len(rows) / np.maximum(df, 1)) + 1
    y = np.array([c for _, c, _ in pieces])
    late = np.array([i % held_out == held_out - 1 for i, _, _ in pieces])
    k = len(languages)
    z, n2, w = np.zeros((width, k)), np.zeros((width, k)), np.zeros((width, k))
    bias = np.zeros(k)
    fit = np.flatnonzero(~late)
    for _ in range(epochs):
        for r in rng.permutation(fit):
            ids, tf = rows[r]
            x = tf * idf[ids] * scale
            zi, ni = z[ids], n2[ids]
            wi = np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2))
            s = x @ wi + bias
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y[r]] -= 1
            g = x[:, None] * p
            sigma = (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha
            z[ids] += g - sigma * wi
            n2[ids] += g * g
            bias -= 0.02 * p
    w = np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n2)) / alpha + l2))
    weights = np.zeros((width + 1, k), np.float32)
    weights[:-1] = w * (idf * scale)[:, None]
    model = Model(languages, weights, bias.astype(np.float32))
    if late.any():
        held = model.logits([s for (_, _, s), q in zip(pieces, late) if q])
        truth = y[late]

        def loss(t: float) -> float:
            model.temperature = t
            return -float(model.log_probabilities(held)[np.arange(len(truth)), truth].mean())

        model.temperature = min(np.geomspace(0.3, 8, 41), key=loss)
    return model


def smooth(logp: np.ndarray, switch: float = 4.0) -> np.ndarray:
    """The most probable language of each sentence in a row, a change of language costing ``switch`` (Viterbi)."""
    n, k = logp.shape
    alone = logp.argmax(axis=1)
    if (alone == alone[0]).all():
        return alone
    best, back = logp[0].copy(), np.zeros((n, k), np.int64)
    for i in range(1, n):
        j = int(best.argmax())
        stay = best >= best[j] - switch
        back[i] = np.where(stay, np.arange(k), j)
        best = np.where(stay, best, best[j] - switch) + logp[i]
    path = np.zeros(n, np.int64)
    path[-1] = int(best.argmax())
    for i in range(n - 1, 0, -1):
        path[i - 1] = back[i, path[i]]
    return path
