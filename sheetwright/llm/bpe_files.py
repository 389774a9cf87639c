"""Byte-level BPE vocabularies of the tokenizers JSON format as numpy tables."""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import regex
from pyspark.sql import SparkSession


def read_shared(spark: SparkSession, path: str):
    """A broadcast of the file's text: vocabularies have a fixed size of a few MB, whatever the corpus."""
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


#: Characters of a text that are split into pre-tokens at a time.
LONG = 1 << 20
_gap = regex.compile(r"[a-z](?= [a-z])")


@lru_cache(1)
def byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte: printable Latin-1 bytes stand for themselves, the others follow from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, extra = [], 0x100
    for b in range(256):
        out.append(chr(b if b in plain else extra))
        extra += b not in plain
    return out


class Vocabulary:
    """ids, ranks by pair of ids, and special tokens."""

    def __init__(self, text: str) -> None:
        spec = json.loads(text)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        vocab = model["vocab"]
        self.tokens = {i: t for t, i in vocab.items()}
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.width = np.int64(max(vocab.values()) + 1)
        pairs = np.array([[vocab[a], vocab[b], vocab[a + b]] for a, b in merges], dtype=np.int64)
        keys = pairs[:, 0] * self.width + pairs[:, 1]
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank = keys[order], order.astype(np.int64)
        self.left, self.right, self.made = pairs.T.copy()
        letters = byte_letters()
        self.byte_ids = np.array([vocab[x] for x in letters], dtype=np.int64)
        self.last_ids = np.array([vocab[x + self.suffix] for x in letters], dtype=np.int64)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"] if t["special"]}
        self.tokens |= {i: t for t, i in self.special.items()}
        # of two special strings that start at one place, the longer one counts
        self.split = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The merge rank of each pair of ids; a value over every rank where there is none."""
        key = a * self.width + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], len(self.keys))

    def symbols(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(the words' bytes as ids, one after the other; their lengths)."""
        n = np.fromiter((len(w) for w in words), dtype=np.int64, count=len(words))
        raw = np.frombuffer(b"".join(words), dtype=np.uint8)
        ids = self.byte_ids[raw]
        last = np.cumsum(n)[n > 0] - 1
        ids[last] = self.last_ids[raw[last]]
        return ids, n

    def parts(self, text: str, limit: int = LONG) -> list[str]:
        """The text cut into parts of about `limit` characters, between a word and the blank before the next one, where no pre-token or special string goes on."""
        if len(text) <= limit or any(" " in s for s in self.special):
            return [text]
        out, last = [], 0
        while len(text) - last > limit and (cut := _gap.search(text, last + limit)):
            out.append(text[last : cut.end()])
            last = cut.end()
        return [*out, text[last:]]

    def pieces(self, text: str) -> list[str]:
        """The text cut at special strings: odd places hold these."""
        if self.split is None or not any(s in text for s in self.special):
            return [text]
        return self.split.split(text)
