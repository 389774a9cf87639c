"""A quality classifier by attention-based multiple-instance learning (Ilse, Tomczak, Welling 2018).

A document is a bag of passages.  Every passage is encoded; gated attention, learned from document labels alone, weighs
the passages, and the weighted representation is scored.  Encoder, attention and score are trained together in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SEGMENT, bounded_sample, prepare, text_bytes

#: Labelled rows to learn from at most: those of the smallest hashes of their id.
TRAIN_ROWS = 6_000
#: Bytes of their texts at most: the sample ends before the first text that doesn't fit.
TRAIN_BYTES = 64 << 20
#: Words in a passage; a text's last passage may be shorter.
PASSAGE = 48
WIDTH, GATE = 24, 16
EPOCHS, BAGS, RATE = 12, 64, 0.01
#: Bytes of text that are encoded at a time, give or take one text.
_BLOCK = 1 << 20
_KINDS = 10
_KIND = np.full(256, 8, dtype=np.int64)  # 0 lower, 1 upper, 2 digit, 3 blank, 4 line end, 5 stop, 6 comma, 7 high, 8 sign, 9 quote or bracket
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[128:] = 0, 1, 2, 7
_KIND[[0x20, 0x09, 0x0B, 0x0C]], _KIND[[0x0A, 0x0D]] = 3, 4
_KIND[[ord(c) for c in ".!?"]], _KIND[[ord(c) for c in ",;:"]], _KIND[[ord(c) for c in "'\"()[]{}"]] = 5, 6, 9
_SPACE = (_KIND == 3) | (_KIND == 4)
FEATURES = _KINDS**2 + _KINDS + 9


def passages(texts: list[bytes], limit: int = SEGMENT) -> tuple[np.ndarray, np.ndarray]:
    """(features of every passage, passages by text); a text without words is one empty passage, a long one is cut between passages."""
    if max(map(len, texts), default=0) <= limit:
        return _passages(texts)
    x, count = [], []
    for t in texts:
        word = ~_SPACE[np.frombuffer(t, dtype=np.uint8)]
        first = np.flatnonzero(word & np.append(True, ~word[:-1])[: len(word)])[::PASSAGE]
        cuts = [0]
        for at in first[1:].tolist():
            if at - cuts[-1] >= limit and t[at - 1] == 0x20:  # the blank that a text's end counts as
                cuts.append(at)
        found = [_passages([t[a:b]]) for a, b in zip(cuts, [*(c - 1 for c in cuts[1:]), len(t)], strict=True)]
        x += [f[0] for f in found]
        count.append(sum(int(f[1][0]) for f in found))
    return np.concatenate(x), np.array(count)


def _passages(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
    lens = np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts))
    ends = np.cumsum(lens + 1) - 1
    kind = _KIND[data]
    word = ~_SPACE[data]
    first = word & np.append(True, ~word[:-1])
    at = np.flatnonzero(first)
    doc = np.searchsorted(ends, at)
    per_doc = np.bincount(doc, minlength=len(texts))
    number = np.arange(len(at)) - np.repeat(np.cumsum(per_doc) - per_doc, per_doc)
    count = np.maximum(1, -(-per_doc // PASSAGE))
    base = np.cumsum(count) - count
    own = base[doc] + number // PASSAGE  # the passage of each word
    total = int(count.sum())
    # bytes follow the word that they end; bytes before a text's first word go to its first passage
    byte_doc = np.repeat(np.arange(len(texts)), lens + 1)
    last = np.cumsum(first) - 1
    byte_own = np.maximum(np.where(last >= 0, own[np.maximum(last, 0)] if len(own) else 0, 0), base[byte_doc])
    x = np.zeros((total, FEATURES), dtype=np.float32)
    size = np.bincount(byte_own, minlength=total) + 1.0
    pair = byte_own * _KINDS**2 + np.append(3, kind[:-1]) * _KINDS + kind  # a blank is before every text
    x[:, : _KINDS**2] = np.bincount(pair, minlength=total * _KINDS**2).reshape(total, -1)
    x[:, _KINDS**2 : _KINDS**2 + _KINDS] = np.bincount(byte_own * _KINDS + kind, minlength=total * _KINDS).reshape(total, -1)
    x[:, : _KINDS**2 + _KINDS] = np.sqrt(x[:, : _KINDS**2 + _KINDS] / size[:, None])
    k = _KINDS**2 + _KINDS
    if len(at):
        stop = np.append(at[1:], len(data))
        length = np.minimum(stop, ends[doc]) - at
        value = np.add.reduceat(data * word.astype(np.int64) * (1 + np.arange(len(data)) - np.repeat(np.append(0, at), np.diff(np.append(np.append(0, at), len(data))))), at)
        words = np.bincount(own, minlength=total)
        some = np.maximum(words, 1)
        same = np.append(False, (value[1:] == value[:-1]) & (own[1:] == own[:-1]))
        two = np.append([False, False], (value[2:] == value[:-2]) & (own[2:] == own[:-2])) if len(at) > 2 else np.zeros(len(at), dtype=bool)
        distinct = np.bincount(np.unique(own * (1 << 22) + value % (1 << 22)) >> 22, minlength=total)
        x[:, k] = np.bincount(own, weights=same, minlength=total) / some
        x[:, k + 1] = np.bincount(own, weights=two[: len(own)], minlength=total) / some
        x[:, k + 2] = distinct / some
        x[:, k + 3] = np.log1p(np.bincount(own, weights=length, minlength=total) / some)
        x[:, k + 4] = np.log1p(words) / 4
        mean = np.bincount(own, weights=length, minlength=total) / some
        x[:, k + 5] = np.log1p(np.sqrt(np.maximum(np.bincount(own, weights=length * length, minlength=total) / some - mean**2, 0)))
        x[:, k + 6] = np.bincount(own, weights=length <= 3, minlength=total) / some
        upper = kind[at] == 1
        x[:, k + 7] = np.bincount(own, weights=upper, minlength=total) / some
    x[:, k + 8] = 1
    return x, count


class Attention:
    """h = tanh(xE); a = softmax over a bag of v.(tanh(hV) * sigmoid(hU)); score = sigmoid(c.(sum a h) + c0)."""

    NAMES = ("E", "V", "U", "v", "c")

    def __init__(self, seed: int = 7) -> None:
        r = np.random.default_rng(seed)
        shape = {"E": (FEATURES, WIDTH), "V": (WIDTH, GATE), "U": (WIDTH, GATE), "v": (GATE,), "c": (WIDTH + 1,)}
        self.w = {k: (r.normal(0, 1 / np.sqrt(s[0]), s)).astype(np.float32) for k, s in shape.items()}
        self.mean, self.scale = np.zeros(FEATURES, dtype=np.float32), np.ones(FEATURES, dtype=np.float32)
        self.rate: float | None = None

    def forward(self, x: np.ndarray, count: np.ndarray) -> tuple:
        begin = np.cumsum(count) - count
        h = np.tanh(((x - self.mean) * self.scale) @ self.w["E"])
        t, s = np.tanh(h @ self.w["V"]), 1 / (1 + np.exp(-np.clip(h @ self.w["U"], -30, 30)))
        e = (t * s) @ self.w["v"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, begin), count))
        a = e / np.repeat(np.add.reduceat(e, begin), count)
        z = np.add.reduceat(a[:, None] * h, begin)
        p = 1 / (1 + np.exp(-np.clip(z @ self.w["c"][:-1] + self.w["c"][-1], -30, 30)))
        return h, t, s, a, z, p

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if self.rate is not None:
            return np.full(len(texts), self.rate)
        out, some, held = [], [], 0
        for t in texts:
            some.append(t)
            held += len(t)
            if held >= _BLOCK:
                out.append(self.forward(*passages(some))[-1])
                some, held = [], 0
        if some:
            out.append(self.forward(*passages(some))[-1])
        return np.concatenate(out).astype(np.float64) if out else np.zeros(0)

    def gradient(self, x: np.ndarray, count: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean log loss of bags, by the weights."""
        h, t, s, a, z, p = self.forward(x, count)
        dp = (p - y) / len(count)
        g = {"c": np.append(z.T @ dp, dp.sum())}
        dz = np.repeat(dp[:, None] * self.w["c"][:-1], count, axis=0)
        da = (dz * h).sum(axis=1)
        de = a * (da - np.repeat(np.add.reduceat(a * da, np.cumsum(count) - count), count))
        dg = de[:, None] * self.w["v"]
        g["v"] = (t * s).T @ de
        dt, du = dg * s * (1 - t * t), dg * t * s * (1 - s)
        g["V"], g["U"] = h.T @ dt, h.T @ du
        dh = a[:, None] * dz + dt @ self.w["V"].T + du @ self.w["U"].T
        g["E"] = ((x - self.mean) * self.scale).T @ (dh * (1 - h * h))
        return g

    def fit(self, texts: list[bytes], y: np.ndarray) -> Attention:
        """Adam on the mean log loss of bags."""
        if not len(y) or y.min() == y.max():
            self.rate = float(y.mean()) if len(y) else 0.0
            return self
        parts = [passages(texts[b : b + 200]) for b in range(0, len(texts), 200)]
        x, count = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        begin = np.cumsum(count) - count
        self.mean, self.scale = x.mean(axis=0), (1 / np.maximum(x.std(axis=0), 0.02)).astype(np.float32)
        self.mean[-1] = 0
        y = y.astype(np.float32)
        m1, m2 = ({k: np.zeros_like(v) for k, v in self.w.items()} for _ in range(2))
        r = np.random.default_rng(11)
        step = 0
        for epoch in range(EPOCHS):
            for bags in np.array_split(r.permutation(len(y)), max(1, len(y) // BAGS)):
                n = count[bags]
                rows = np.repeat(begin[bags] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                bx = x[rows]
                g = self.gradient(bx, n, y[bags])
                step += 1
                rate = RATE * (1 - epoch / EPOCHS)
                for k in self.NAMES:
                    d = g[k].astype(np.float32) + 1e-4 * self.w[k]
                    m1[k] = 0.9 * m1[k] + 0.1 * d
                    m2[k] = 0.99 * m2[k] + 0.01 * d * d
                    self.w[k] -= rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-6)
        return self

    def dump(self) -> bytes:
        flat = [np.float32([-1 if self.rate is None else self.rate]), self.mean, self.scale, *(self.w[k].ravel() for k in self.NAMES)]
        return np.concatenate(flat).astype("<f4").tobytes()

    @classmethod
    def load(cls, raw: bytes) -> Attention:
        out, flat = cls(), np.frombuffer(raw, "<f4")
        out.rate = None if flat[0] < 0 else float(flat[0])
        at = 1
        for name in ("mean", "scale"):
            setattr(out, name, flat[at : at + FEATURES])
            at += FEATURES
        for k in cls.NAMES:
            out.w[k] = flat[at : at + out.w[k].size].reshape(out.w[k].shape)
            at += out.w[k].size
        return out


def _fitted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    rows = pd.concat(list(batches), ignore_index=True)
    rows = rows.sort_values("doc_id", kind="stable") if len(rows) else rows
    model = Attention().fit([text_bytes(t) for t in rows["text"]], rows["y"].to_numpy(dtype=np.int64))
    yield pd.DataFrame([(model.dump(),)], columns=["model"])


def train(docs: DataFrame, labelled: DataFrame, rows: int = TRAIN_ROWS) -> Attention:
    """Fit on labelled(doc_id, y): at most `rows` of them and TRAIN_BYTES of text, those of the smallest hash of doc_id, in one task."""
    texts = bounded_sample(docs, labelled, rows, TRAIN_BYTES).repartition(1)
    got = texts.mapInPandas(_fitted, "model binary").collect()
    return Attention.load(bytes(got[0][0])) if got else Attention().fit([], np.zeros(0))


def with_quality(docs: DataFrame, labelled: DataFrame, threshold: float = 0.3, rows: int = TRAIN_ROWS, names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """docs with `score` (double, 0 to 1) and `predicted` (int, 1 if score >= threshold), or other `names`; all other columns stay.

    Columns that have these names already are replaced.

    labelled(doc_id, y) holds the labels to learn from, y = 1 for good texts; of repeated labels of one id the larger
    counts.  Only texts are inputs of a score: null texts count as empty, and empty ones are a bag of one empty passage.
    Without labels of both kinds every score is the share of label 1 (0 without labels).
    """
    prepare(docs.sparkSession)
    raw = train(docs, labelled, rows).dump()

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = Attention.load(raw)
        for s in batches:
            yield pd.Series(model.scores([text_bytes(t) for t in s]), index=s.index, dtype="float64")

    first, second = names
    columns = [docs[f"`{c}`"] for c in docs.columns if c not in names]
    return docs.select(*columns, score(docs["text"].cast("string")).alias(first)).withColumn(second, (F.col(first) >= threshold).cast("int"))
