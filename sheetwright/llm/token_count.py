"""Token counts of byte-level BPE by rank-synchronous array merging.

A batch's pre-tokens that are new to the worker become one ragged numpy array of symbol ids.  In each step every
sequence merges all places of its own lowest-rank pair at once; sequences without a pair left leave the array, and
their surviving symbols are their count.  A document's count is the sum over its pre-tokens.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe_files import Vocabulary, read_shared
from .common import keyed, prepare, unkeyed

#: Fixed value: how the byte-level vocabularies split text before merging.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pre-tokens that a worker remembers; then it forgets them all.
MEMO = 400_000
#: Characters of text whose new pre-tokens are merged in one array.
BATCH = 4 << 20

_state: dict = {}
_find = regex.compile(SPLIT).findall


def merged_counts(vocab: Vocabulary, words: list[bytes]) -> np.ndarray:
    """Symbols that are left of each word when no pair of it can be merged."""
    sym, n = vocab.symbols(words)
    left = n.copy()
    who = np.arange(len(words))[n > 0]
    size = n[n > 0]
    none = len(vocab.keys)
    while len(sym):
        begin = np.cumsum(size) - size
        rank = np.full(len(sym), none, dtype=np.int64)
        if len(sym) > 1:
            rank[:-1] = vocab.ranks(sym[:-1], sym[1:])
        rank[begin + size - 1] = none
        least = np.minimum.reduceat(rank, begin)
        live = least < none
        if not live.all():
            left[who[~live]] = size[~live]
            stay = np.repeat(live, size)
            sym, rank, who, size, least = sym[stay], rank[stay], who[live], size[live], least[live]
            if not len(sym):
                break
            begin = np.cumsum(size) - size
        hit = rank == np.repeat(least, size)
        # in a run of overlapping places of one pair, every second one is taken, from the left
        at = np.flatnonzero(hit)
        fresh = np.append(True, at[1:] != at[:-1] + 1)
        run = np.flatnonzero(fresh)
        odd = (np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))) % 2
        at = at[odd == 0]
        sym[at] = vocab.made[rank[at]]
        stay = np.ones(len(sym), dtype=bool)
        stay[at + 1] = False
        sym = sym[stay]
        size = np.add.reduceat(stay.astype(np.int64), begin)
    return left


def _worker(key: str, text: str) -> tuple[Vocabulary, dict[str, int]]:
    if _state.get("key") != key:
        _state.update(key=key, vocab=Vocabulary(text), memo={})
    return _state["vocab"], _state["memo"]


def count_tokens(vocab: Vocabulary, memo: dict[str, int], texts: list[str]) -> list[int]:
    """Token counts of the texts, as the vocabulary's library gives them without added special tokens."""
    cut: list[tuple[int, list[str]]] = []
    fresh: set[str] = set()
    for text in texts:
        parts = vocab.pieces(text)
        words = _find(text) if len(parts) == 1 else [w for p in parts[::2] for w in _find(p)]
        fresh.update(words)
        cut.append((len(parts) // 2, words))
    new = [w for w in fresh if w not in memo]
    if new:
        memo.update(zip(new, merged_counts(vocab, [w.encode("utf-8", "replace") for w in new]).tolist(), strict=True))
    out = [n + sum(map(memo.__getitem__, words)) for n, words in cut]
    if len(memo) > MEMO:
        memo.clear()
    return out


def _counted(batches: Iterator[pd.DataFrame], shared, key: str) -> Iterator[pd.DataFrame]:
    vocab, memo = _worker(key, shared.value)
    for pdf in batches:
        texts = [t if isinstance(t, str) else "" for t in pdf["text"]]
        counts = np.zeros(len(texts), dtype=np.int64)
        some: list[str] = []
        owner: list[int] = []
        size = 0
        for at, t in enumerate(texts):
            for part in vocab.parts(t):
                some.append(part)
                owner.append(at)
                size += len(part)
                if size >= BATCH:
                    np.add.at(counts, owner, count_tokens(vocab, memo, some))
                    some, owner, size = [], [], 0
        np.add.at(counts, owner, count_tokens(vocab, memo, some))
        yield pd.DataFrame({"doc_id": pdf["doc_id"], "no_id": pdf["no_id"], "n_bytes": [len(t) if t.isascii() else len(t.encode("utf-8", "replace")) for t in texts], "n_tokens": counts})


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 512) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row of docs(doc_id, text); other columns are ignored.

    `vocabulary` is the path of a byte-level BPE file in the tokenizers JSON format.  Null texts count as empty: 0 bytes,
    0 tokens.  Rows with a null or repeated doc_id come out like any other.  No shuffle; a text is held whole and split in parts.
    """
    spark = docs.sparkSession
    prepare(spark)
    shared = read_shared(spark, vocabulary)
    out = keyed(docs).mapInPandas(lambda it: _counted(it, shared, vocabulary), "doc_id long, no_id boolean, n_bytes long, n_tokens long")
    return unkeyed(out).withColumn("over_limit", F.col("n_tokens") > limit)
