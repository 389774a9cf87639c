"""Toxicity scores of texts restored by a noisy channel.

Words written in disguise (leetspeak, inserted signs or spaces, stretched letters) are decoded: each suspicious span is a
lattice of letters that its signs may stand for, and Viterbi finds the likeliest reading under a character trigram model,
whose counts come from all texts.  The restored text is scored by the evidence of its words and word beginnings, weighed
on labelled rows: the strongest pieces of a text decide, so long harmless texts don't add up to a toxic one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _LOWER, SEGMENT, _power_table, bounded_sample, chunks, mix, pieces, prepare, segments, text_bytes

#: Labelled rows that the evidence is weighed on at most: those of the smallest hashes of their id.
TRAIN_ROWS = 20_000
#: Bytes of their texts at most: the sample ends before the first text that doesn't fit.
TRAIN_BYTES = 128 << 20
#: Texts with a piece of evidence that the model keeps must number so many.
LEAST_TEXTS = 3
_U = np.uint64
_LETTERS = 28  # 0 anything between words, 1-26 a-z, 27 bytes of other letters
_CLASS = np.zeros(256, dtype=np.int64)
_CLASS[97:123] = np.arange(1, 27)
_CLASS[65:91] = np.arange(1, 27)
_CLASS[128:] = 27
_LETTER = _CLASS > 0
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: The letters that digits and signs commonly stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "*": "aeiou", "#": "h"}
_SIGN = np.zeros(256, dtype=bool)
_SIGN[[ord(c) for c in [*LEET, ".", "-", "_", "'", "~", "^", ","]]] = True
_HEAD = np.zeros(256, dtype=bool)
_HEAD[[ord(c) for c in "0123456789@$!|+("]] = True
_TAIL = np.zeros(256, dtype=bool)
_TAIL[[ord(c) for c in "0123456789@$"]] = True
#: Log probabilities of the channel: a sign for a letter, a sign put in (one that may stand for a letter; another), a sign between words, a stretched letter, a doubled one.
SUBSTITUTE, LOST, INSERT, BREAK, STRETCH, DOUBLE = -1.0, -9.0, -2.0, -5.0, -0.5, -4.0
#: A star for a letter that isn't a vowel.
MASK = -2.5
#: Weight of the character model against the channel.
MODEL = 0.5
_MEMO = 100_000
#: Signs in a row within a word at most that may hide letters.
RUN = 6
#: Long texts are cut between two plain words, where no disguise goes on.
_gap = re.compile(rb"(?<=[a-z]{2})\s(?=[a-z]{2})")
_white = re.compile(r"\s+")


# --- the language model


def _trigrams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total = np.zeros(_LETTERS**3, dtype=np.int64)
    for _, texts in chunks(batches):
        c = _CLASS[np.frombuffer(b"  ".join([b"", *texts, b""]), dtype=np.uint8)]
        c = c[np.append(True, (c[1:] > 0) | (c[:-1] > 0))]  # one boundary between words
        total += np.bincount((c[:-2] * _LETTERS + c[1:-1]) * _LETTERS + c[2:], minlength=_LETTERS**3)
    at = np.flatnonzero(total)
    yield pd.DataFrame({"cell": at, "n": total[at]})


def letter_model(docs: DataFrame) -> np.ndarray:
    """log P(c | a, b) at [a, b, c]: trigram counts over all texts (at most 28^3 cells reach the driver), backed off by bigrams and letters."""
    rows = docs.select(F.lit(0).alias("doc_id"), F.lit(False).alias("no_id"), F.col("text").cast("string").alias("text")).mapInPandas(_trigrams, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    n = np.zeros(_LETTERS**3)
    for cell, count in rows:
        n[cell] = count
    n = n.reshape(_LETTERS, _LETTERS, _LETTERS)
    n1 = n.sum(axis=(0, 1)) + 1
    p1 = n1 / n1.sum()
    n2 = n.sum(axis=0)
    p2 = (n2 + 20 * p1) / (n2.sum(axis=1, keepdims=True) + 20)
    return np.log((n + 20 * p2) / (n.sum(axis=2, keepdims=True) + 20))


# --- restoring


def _lattice(span: str) -> list[list[tuple[int, str, float]]]:
    """Each step's choices: (letter class, text, log probability of the channel)."""
    steps: list[list[tuple[int, str, float]]] = []
    at = 0
    while at < len(span):
        c = span[at]
        run = at
        while run < len(span) and span[run] == c:
            run += 1
        n = run - at
        cls = int(_CLASS[ord(c)]) if ord(c) < 128 else 27 if c.isalpha() else 0
        if cls:
            steps += [[(cls, c, 0.0)]] if n < 3 else [[(cls, c, STRETCH)]]
            if n == 2:
                steps.append([(cls, c, 0.0), (-1, "", DOUBLE)])
            elif n > 2:
                steps.append([(cls, c, STRETCH), (-1, "", STRETCH)])
            at = run
            continue
        choices = [(int(_CLASS[ord(x)]), x, SUBSTITUTE) for x in LEET.get(c, "")]
        if c == "*":
            choices += [(k, chr(96 + k), MASK) for k in range(1, 27) if chr(96 + k) not in LEET[c]]
        if c.isspace():
            choices += [(-1, "", INSERT), (0, " ", -0.5)]
        else:
            choices += [(-1, "", LOST if c in LEET else INSERT), (0, " ", BREAK)]
        steps.append(choices)
        at += 1
    return steps


def decode(span: str, logp: np.ndarray) -> str:
    """The likeliest reading of a span in lower case."""
    best: dict[tuple[int, int], tuple[float, tuple]] = {(0, 0): (0.0, ())}
    for choices in _lattice(span):
        new: dict[tuple[int, int], tuple[float, tuple]] = {}
        for (a, b), (score, path) in best.items():
            for cls, text, cost in choices:
                if cls < 0 or cls == 0 and b == 0:
                    key, s, p = (a, b), score + cost, path
                else:
                    key, s, p = (b, cls), score + cost + logp[a, b, cls], (path, text)
                if key not in new or s > new[key][0]:
                    new[key] = (s, p)
        best = new
    (a, b), (_, path) = max(best.items(), key=lambda x: x[1][0] + logp[x[0][0], x[0][1], 0])
    out = []
    while path:
        path, text = path
        out.append(text)
    return "".join(reversed(out))


def suspicious(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places of a lower-case text's bytes at which a word looks disguised, whether by its last bytes alone).

    The bytes must begin and end with white space.  Disguised are letters with one to RUN signs between them, a leading
    sign before letters, digits, @ or $ after two letters at a word's end, a letter three times, and three or more letters
    by themselves.
    """
    n = len(data)
    if n < RUN + 3:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=bool)
    letter, sign, head, space = _LETTER[data], _SIGN[data], _HEAD[data], _SPACE[data]
    flag = np.zeros(n, dtype=bool)
    signs = np.ones(n, dtype=bool)  # whether the k bytes after a place are signs
    for k in range(1, RUN + 1):
        signs = signs[: n - k - 1] & sign[k : n - 1]
        flag[1 : n - k] |= letter[: n - k - 1] & signs & letter[k + 1 :]
    flag[1:-2] |= space[:-3] & head[1:-2] & letter[2:-1] & (letter | head)[3:]
    low = _LOWER[data]
    flag[2:] |= letter[2:] & (low[2:] == low[1:-1]) & (low[1:-1] == low[:-2]) & (data[2:] < 128)
    begin = np.flatnonzero(~space[1:] & space[:-1]) + 1
    alone = (letter | head)[begin] & space[np.minimum(begin + 1, n - 1)]
    three = np.flatnonzero(alone[:-2] & alone[1:-1] & alone[2:])
    for i in range(3):
        flag[begin[three + i]] = True
    tail = np.zeros(n, dtype=bool)
    for k in (1, 2, 3):
        ends = letter[: n - k - 2] & letter[1 : n - k - 1] & space[k + 2 :]
        for i in range(k):
            ends = ends & _TAIL[data[i + 2 : n - k + i]]
        tail[2 : n - k] |= ends
    at = np.flatnonzero(flag | tail)
    return at, ~flag[at]


class Restorer:
    """Restores texts with one language model; readings of spans are remembered."""

    def __init__(self, logp: np.ndarray) -> None:
        self.logp = MODEL * logp
        self.memo: dict[str, str] = {}

    def read(self, span: str) -> str:
        if span not in self.memo:
            if len(self.memo) > _MEMO:
                self.memo.clear()
            self.memo[span] = decode(span, self.logp)
        return self.memo[span]

    def restore(self, texts: list[bytes]) -> list[bytes]:
        """The texts in lower case with their suspicious spans decoded, where only a word's end is suspicious beside the word itself; other texts as they are."""
        if max(map(len, texts), default=0) > SEGMENT:
            return [b"".join([x for part in segments(t, SEGMENT, _gap) for x in self._restored([part])]) for t in texts]
        return self._restored(texts)

    def _restored(self, texts: list[bytes]) -> list[bytes]:
        data = np.frombuffer(b"   ".join([b"", *texts, b""]), dtype=np.uint8)
        at, tails = suspicious(data)
        if not len(at):
            return texts
        ends = np.cumsum([len(t) + 3 for t in texts])
        out = list(texts)
        which = np.searchsorted(ends, at - 3, side="right")
        for doc in np.unique(which).tolist():
            raw = texts[doc]
            own = which == doc
            mine = at[own] - (ends[doc] - len(raw))
            space = np.flatnonzero(_SPACE[np.frombuffer(raw, dtype=np.uint8)])
            after = np.searchsorted(space, mine)
            begin = np.where(after > 0, space[np.maximum(after - 1, 0)] + 1 if len(space) else 0, 0)
            end = np.where(after < len(space), space[np.minimum(after, max(len(space) - 1, 0))] if len(space) else len(raw), len(raw))
            parts: list[bytes] = []
            last = 0
            spans: list[list[int]] = []  # begin, end, whether of single letters, whether only the end is suspicious
            for b, e, tail in zip(begin.tolist(), end.tolist(), tails[own].tolist(), strict=True):
                single = e - b == 1
                if spans and b < spans[-1][1]:
                    spans[-1][3] &= tail
                elif spans and single and spans[-1][2] and not raw[spans[-1][1] : b].strip():
                    spans[-1][1] = e
                else:
                    spans.append([b, e, single, tail])
            for b, e, single, tail in spans:
                span = raw[b:e].decode("utf-8", "replace").lower()
                parts += [raw[last:e] + b" " if tail else raw[last:b], self.read(_white.sub(" ", span) if single else span).encode()]
                last = e
            out[doc] = b"".join([*parts, raw[last:]])
        return out


# --- evidence


def evidence(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, index of its text) of each word and of each word's first four, five and six bytes; of a long text each once."""
    if sum(map(len, texts)) <= 2 * SEGMENT:
        return _evidence(texts)
    found = []
    for at, t in enumerate(texts):
        h = np.concatenate([np.unique(_evidence([part])[0]) for part in segments(t)])
        found.append((np.unique(h), np.full(len(np.unique(h)), at)))
    return np.concatenate([h for h, _ in found]), np.concatenate([d for _, d in found])


def _evidence(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    lens = np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts))
    data = _LOWER[np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)]
    at = np.flatnonzero(_LETTER[data])
    if not len(at):
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    begin = np.flatnonzero(np.append(True, at[1:] != at[:-1] + 1))
    size = np.diff(np.append(begin, len(at)))
    offset = np.arange(len(at)) - np.repeat(begin, size)
    value = (data[at].astype(np.uint64) + _U(1)) * _power_table(int(size.max()))[offset]
    which = np.searchsorted(np.cumsum(lens + 1) - 1, at[begin])
    # sums of the first p bytes without another pass: running sums
    total = np.append(_U(0), np.cumsum(value))
    hashes, docs = [], []
    for p in (4, 5, 6, 0):
        long = np.flatnonzero(size > p)
        end = begin[long] + (p or 1 << 40)
        end = np.minimum(end, begin[long] + size[long])
        hashes.append(mix(total[end] - total[begin[long]] + _U((p + 1) * 0x9FB21C651E98DF25 & (2**64 - 1))))
        docs.append(which[long])
    return np.concatenate(hashes), np.concatenate(docs)


class Model:
    """Pieces of evidence (sorted hashes), their weights, and the logistic weights of a text's summary."""

    def __init__(self, keys: np.ndarray, weights: np.ndarray, beta: np.ndarray, rate: float) -> None:
        self.keys, self.weights, self.beta, self.rate = keys, weights, beta, rate
        self.seen = np.zeros(1 << 16, dtype=bool)
        self.seen[(keys & _U(0xFFFF)).astype(np.int64)] = True

    def summaries(self, texts: list[bytes]) -> np.ndarray:
        """By text: 1, the strongest piece, the second, the sum of the five strongest, the logarithm of their number."""
        out = np.zeros((len(texts), 5))
        out[:, 0] = 1
        h, doc = evidence(texts)
        near = self.seen[(h & _U(0xFFFF)).astype(np.int64)]
        h, doc = h[near], doc[near]
        if not len(h) or not len(self.keys):
            return out
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        hit = self.keys[at] == h
        both = np.unique(np.stack([doc[hit], at[hit]], axis=1), axis=0)
        doc, w = both[:, 0], self.weights[both[:, 1]]
        order = np.lexsort((-w, doc))
        doc, w = doc[order], w[order]
        begin = np.flatnonzero(np.append(True, doc[1:] != doc[:-1])) if len(doc) else np.zeros(0, dtype=np.int64)
        place = np.arange(len(doc)) - np.repeat(begin, np.diff(np.append(begin, len(doc))))
        out[doc[place == 0], 1] = w[place == 0]
        out[doc[place == 1], 2] = w[place == 1]
        np.add.at(out[:, 3], doc[place < 5], w[place < 5])
        out[:, 4] = np.log1p(np.bincount(doc, minlength=len(texts)))
        return out

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if self.beta is None:
            return np.full(len(texts), self.rate)
        return 1 / (1 + np.exp(-np.clip(self.summaries(texts) @ self.beta, -40, 40)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Ridge logistic regression by Newton's method."""
    beta = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -40, 40)))
        g = x.T @ (p - y) + ridge * beta
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(beta)), g)
        beta -= step
        if np.abs(step).max() < 1e-6:
            break
    return beta


def fit(texts: list[bytes], y: np.ndarray) -> Model:
    """Weights are smoothed log odds of the share of toxic and of other texts that hold a piece.

    For the logistic part each half of the rows is summed up with the weights of the other half.
    """
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(0, dtype=np.uint64), np.zeros(0), None, float(y.mean()) if len(y) else 0.0)
    half = np.arange(len(y)) % 2

    def held(rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(row, hash) of the pieces of evidence that the rows' texts hold, each once a text."""
        at = 0
        for some in pieces([texts[i] for i in rows]):
            h, doc = evidence(some)
            order = np.lexsort((h, doc))
            h, doc = h[order], doc[order]
            new = np.append(True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])) if len(h) else np.zeros(0, dtype=bool)
            yield rows[at + doc[new]], h[new]
            at += len(some)

    # only what several toxic texts hold can be evidence, so the other texts are searched for that alone
    rows, h = (np.concatenate(x) for x in zip(*held(np.flatnonzero(y == 1)), strict=True))
    keys, at, times = np.unique(h, return_inverse=True, return_counts=True)
    toxic = np.stack([np.bincount(at, weights=half[rows] == k, minlength=len(keys)) for k in (0, 1)])
    keys, toxic = keys[times >= LEAST_TEXTS], toxic[:, times >= LEAST_TEXTS]
    clean = np.zeros_like(toxic)
    if len(keys):
        for rows, h in held(np.flatnonzero(y == 0)):
            at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            hit = keys[at] == h
            np.add.at(clean, (half[rows[hit]], at[hit]), 1)

    def weigh(folds: list[int]) -> tuple[np.ndarray, np.ndarray]:
        own = np.isin(half, folds)
        pos, neg = max(1, y[own].sum()), max(1, (1 - y[own]).sum())
        t, c = toxic[folds].sum(axis=0), clean[folds].sum(axis=0)
        w = np.log((t + 0.5) / (pos + 1)) - np.log((c + 0.5) / (neg + 1)) - 1 / np.sqrt(t + 0.5)
        keep = (t >= LEAST_TEXTS) & (w > 1)
        return keys[keep], w[keep]

    x = np.zeros((len(y), 5))
    for fold in (0, 1):
        model = Model(*weigh([fold]), None, 0.0)
        own = np.flatnonzero(half != fold)
        at = 0
        for some in pieces([texts[i] for i in own]):
            x[own[at : at + len(some)]] = model.summaries(some)
            at += len(some)
    return Model(*weigh([0, 1]), logistic(x, y.astype(float)), 0.0)


# --- on Spark


def _fitted(batches: Iterator[pd.DataFrame], logp: np.ndarray) -> Iterator[pd.DataFrame]:
    rows = pd.concat(list(batches), ignore_index=True)
    rows = rows.sort_values("doc_id", kind="stable") if len(rows) else rows
    restorer = Restorer(logp)
    texts = [t for some in pieces([text_bytes(t) for t in rows["text"]]) for t in restorer.restore(some)]
    model = fit(texts, rows["y"].to_numpy(dtype=np.int64))
    beta = b"" if model.beta is None else model.beta.tobytes()
    yield pd.DataFrame([(model.keys.tobytes(), model.weights.tobytes(), beta, model.rate)], columns=["keys", "weights", "beta", "rate"])


def train(docs: DataFrame, labelled: DataFrame, logp: np.ndarray, rows: int = TRAIN_ROWS) -> Model:
    """Fit on labelled(doc_id, y): at most `rows` of them and TRAIN_BYTES of text, those of the smallest hash of doc_id, in one task."""
    texts = bounded_sample(docs, labelled, rows, TRAIN_BYTES).repartition(1)
    got = texts.mapInPandas(lambda it: _fitted(it, logp), "keys binary, weights binary, beta binary, rate double").collect()
    if not got:
        return Model(np.zeros(0, dtype=np.uint64), np.zeros(0), None, 0.0)
    r = got[0]
    return Model(np.frombuffer(r[0], "<u8"), np.frombuffer(r[1], "<f8"), np.frombuffer(r[2], "<f8") if r[2] else None, r[3])


def with_toxicity(docs: DataFrame, labelled: DataFrame, threshold: float = 0.7, rows: int = TRAIN_ROWS, names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """docs with `score` (double, 0 to 1) and `predicted` (int, 1 if score >= threshold), or other `names`; all other columns stay.

    Columns that have these names already are replaced.

    labelled(doc_id, y) holds the labels to learn from, y = 1 for toxic texts; of repeated labels of one id the larger
    counts.  Long texts are restored and searched in segments.  Only texts are inputs of a score: null texts count as empty, and any text without letters gets the score of
    an empty one.  Without labels of both kinds every score is the share of label 1 (0 without labels).
    """
    prepare(docs.sparkSession)
    logp = letter_model(docs)
    model = train(docs, labelled, logp, rows)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        restorer = Restorer(logp)
        for s in batches:
            found = [model.scores(restorer.restore(some)) for some in pieces([text_bytes(t) for t in s])]
            yield pd.Series(np.concatenate([np.zeros(0), *found]), index=s.index)

    first, second = names
    columns = [docs[f"`{c}`"] for c in docs.columns if c not in names]
    return docs.select(*columns, score(docs["text"].cast("string")).alias(first)).withColumn(second, (F.col(first) >= threshold).cast("int"))


def learned_rows(labels: DataFrame, column: str, modulus: int, kept_out: int) -> DataFrame:
    """(doc_id, y) of the labels whose crc32(doc_id as text) leaves another remainder than kept_out."""
    return labels.where(F.crc32(F.col("doc_id").cast("string")) % modulus != kept_out).select("doc_id", F.col(column).alias("y"))
