"""BPE encoding and decoding with a pair occurrence index.

The pre-tokens of a partition that the worker hasn't met before lie in one array of symbols, linked both ways within
each word.  An index maps every mergeable pair to all its places.  Active ranks are applied in ascending order: a
rank's places that still hold its pair are merged at once, and only the lists of the pairs left and right of the
merged places gain entries; places that no longer hold their pair are skipped when their rank comes up.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame

from .bpe_files import Vocabulary, read_shared
from .common import keyed, prepare, trim_memory, unkeyed

#: Fixed value: how the word-end vocabulary splits normalised text.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"""
#: Pre-tokens that a worker remembers; then it forgets them all.
MEMO = 300_000
#: Characters of text whose new pre-tokens share one index.
BATCH = 6 << 20
#: Characters of text whose ids and decoded texts leave the worker together.
FRAME = 1 << 20

# Where the library's Unicode tables differ from those of Python and its regex module.
#: Code points that are neither letters nor numbers to it.
NO_WORDS = (
    r"\u0558\u058b\u058c\u088f\u0c5c\u0cdc\u208f\u209d-\u209f\ua7ce\ua7cf\ua7d2\ua7d4\ua7dd\ua7e2\ua7f1\uab6c\uab6d\U000107bb-\U000107bf"
    r"\U00010940-\U00010959\U00010ec5-\U00010ec7\U00010ed9-\U00010eee\U00011b0a\U00011db0-\U00011ddb\U00011de0-\U00011de9\U00011df1\U0001246f"
    r"\U00012475-\U0001247f\U00012550-\U00012686\U00016ea0-\U00016eb8\U00016ebb-\U00016ed3\U00016ff2-\U00016ff6\U000187f8-\U000187ff"
    r"\U00018cd6-\U00018cda\U00018d09-\U00018d20\U00018d80-\U00018df2\U00018e00-\U00019191\U000191a0-\U000191d2\U0001b123-\U0001b128\U0001b168"
    r"\U0001d6a6\U0001df1f-\U0001df24\U0001df2b-\U0001df81\U0001df90-\U0001df96\U0001dfcd-\U0001dfff\U0001e6c0-\U0001e6de\U0001e6e0-\U0001e6e2"
    r"\U0001e6e4\U0001e6e5\U0001e6e7-\U0001e6ed\U0001e6f0-\U0001e6f4\U0001e6fe\U0001e6ff\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead"
    r"\U000323b0-\U00033479\U0003d000-\U0003fc3f"
)
#: Marks that it doesn't put in order and letters that it doesn't compose.
NO_MARKS = (
    r"\u07fd\u0898-\u089f\u08ca-\u08d3\u09fe\u0c3c\u0d3b\u0d3c\u0eba\u1715\u1abf-\u1ace\u1df6-\u1dfa\ua82c\U000105d2\U000105da\U00010d24-\U00010d27"
    r"\U00010eab\U00010eac\U00010efd-\U00010eff\U00010f46-\U00010f50\U00010f82-\U00010f85\U00011070\U0001133b\U000113b8\U000113bb\U000113c2\U000113c9"
    r"\U0001145e\U0001611e-\U00016129\U00011839\U0001183a\U0001193d\U0001193e\U00011943\U000119e0\U00011a34\U00011a47\U00011a99\U00011d42\U00011d44"
    r"\U00011d45\U00011d97\U00011f41\U00011f42\U00016d63\U00016d67\U00016ff0\U00016ff1\U0001e08f\U0001e130-\U0001e136\U0001e2ae\U0001e2ec-\U0001e2ef"
    r"\U0001e4ec-\U0001e4ef"
)
#: Capital letters of later Unicode versions and what it makes of them: (first, last, first small letter).
LATER_CASE = [
    (0x1C89, 0x1C89, 0x1C8A), (0xA7CB, 0xA7CB, 0x0264), (0xA7CC, 0xA7CC, 0xA7CD), (0xA7CE, 0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2, 0xA7D3), (0xA7D4, 0xA7D4, 0xA7D5),
    (0xA7DA, 0xA7DA, 0xA7DB), (0xA7DC, 0xA7DC, 0x019B), (0x10D50, 0x10D65, 0x10D70), (0x16EA0, 0x16EB8, 0x16EBB),
]

_state: dict = {}
_find = regex.compile(SPLIT).findall
_lower = {a + k: small + k for a, b, small in LATER_CASE for k in range(b - a + 1)}
_far = re.compile("[\u0558-\u1fff\u208f-\U0010ffff]").search  # a quick look: all of these lie there
_words = regex.compile(f"[{NO_WORDS}]").search
_marks = regex.compile(f"([{NO_MARKS}]+)")
_rare = regex.compile(f"[{NO_MARKS}{''.join(map(chr, _lower))}]").search
_find_rare = regex.compile(rf"(?V1)'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}--[{NO_WORDS}]]+|[\p{{N}}--[{NO_WORDS}]]|[[^\s\p{{L}}\p{{N}}]||[{NO_WORDS}]]+").findall
_white = regex.compile(r"\s+")


def normalise(text: str) -> str:
    """NFC, runs of white space to one space, lower case letter by letter (so that a final sigma has no form of its own)."""
    if text.isascii():
        return _white.sub(" ", text).lower()
    if _far(text) and _rare(text):
        text = "".join(p if k % 2 else unicodedata.normalize("NFC", p) for k, p in enumerate(_marks.split(text))).translate(_lower)
    else:
        text = unicodedata.normalize("NFC", text)
    return _white.sub(" ", text.replace("Σ", "σ")).lower()


def pre_tokens(text: str) -> list[str]:
    """The words of a text without special strings."""
    text = normalise(text)
    return _find(text) if text.isascii() or not _far(text) or not _words(text) else _find_rare(text)


def encode_words(vocab: Vocabulary, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all words, how many each has)."""
    sym, n = vocab.symbols(words)
    total = len(sym)
    if not total:
        return sym, n
    none = len(vocab.keys)
    word = np.repeat(np.arange(len(words)), n)
    place = np.arange(total)
    after = np.where(np.append(word[1:] == word[:-1], False), place + 1, -1)
    before = np.where(np.append(False, word[1:] == word[:-1]), place - 1, -1)

    index: dict[int, list[np.ndarray]] = {}
    active: list[int] = []

    def enter(places: np.ndarray) -> None:
        """Add places whose symbol has a follower to the lists of their pairs."""
        rank = vocab.ranks(sym[places], sym[after[places]])
        use = rank < none
        places, rank = places[use], rank[use]
        if not len(places):
            return
        order = np.argsort(rank, kind="stable")
        places, rank = places[order], rank[order]
        begin = np.flatnonzero(np.append(True, rank[1:] != rank[:-1]))
        for r, part in zip(rank[begin].tolist(), np.split(places, begin[1:]), strict=True):
            if r not in index:
                index[r] = []
                heapq.heappush(active, r)
            index[r].append(part)

    enter(place[after >= 0])
    while active:
        r = heapq.heappop(active)
        lists = index.pop(r)
        places = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
        a, b = vocab.left[r], vocab.right[r]
        nxt = after[places]
        ok = (sym[places] == a) & (nxt >= 0) & (sym[nxt] == b)
        places, nxt = places[ok], nxt[ok]
        if a == b and len(places) > 1:
            # places ascend, so overlapping ones follow each other: take every second one of a run
            fresh = np.append(True, places[1:] != nxt[:-1])
            run = np.flatnonzero(fresh)
            odd = (np.arange(len(places)) - np.repeat(run, np.diff(np.append(run, len(places))))) % 2
            places, nxt = places[odd == 0], nxt[odd == 0]
        if not len(places):
            continue
        sym[places] = vocab.made[r]
        sym[nxt] = -1
        far = after[nxt]
        after[places] = far
        after[nxt] = -1
        before[far[far >= 0]] = places[far >= 0]
        near = before[places]
        enter(np.unique(np.concatenate([near[near >= 0], places[far >= 0]])))
    live = sym >= 0
    return sym[live], np.bincount(word[live], minlength=len(words))


def _worker(key: str, text: str) -> tuple[Vocabulary, dict[str, tuple[bytes, str]]]:
    if _state.get("key") != key:
        _state.update(key=key, vocab=Vocabulary(text), memo={})
    return _state["vocab"], _state["memo"]


def encode_texts(vocab: Vocabulary, memo: dict, texts: list[str]) -> Iterator[tuple[bytes, str]]:
    """(ids as little-endian unsigned 32-bit integers, decoded text) of each text."""
    cut: list[list[str]] = []
    fresh: set[str] = set()
    for text in texts:
        words: list[str] = []
        for k, part in enumerate(vocab.pieces(text)):
            if k % 2:
                words.append("\0" + part)  # a marker that no pre-token starts with: NUL never joins a special string's place
            else:
                words += pre_tokens(part)
        fresh.update(words)
        cut.append(words)
    for s, i in vocab.special.items():
        memo["\0" + s] = (np.array([i], dtype="<u4").tobytes(), s)
    new = [w for w in fresh if w not in memo]
    if new:
        ids, n = encode_words(vocab, [w.encode("utf-8", "replace") for w in new])
        raw, names = ids.astype("<u4").tobytes(), vocab.tokens
        at = 0
        for w, k, part in zip(new, n.tolist(), np.split(ids, np.cumsum(n)[:-1]), strict=True):
            memo[w] = (raw[4 * at : 4 * (at + k)], " ".join([names[i] for i in part.tolist()]))
            at += k
    for words in cut:
        got = [memo[w] for w in words]
        yield b"".join([x for x, _ in got]), " ".join([x for _, x in got])
    if len(memo) > MEMO:
        memo.clear()
    trim_memory()


def _encoded(batches: Iterator[pd.DataFrame], shared, key: str) -> Iterator[pd.DataFrame]:
    vocab, memo = _worker(key, shared.value)
    ids: list = []
    texts: list[str] = []
    size = 0

    def flush() -> Iterator[pd.DataFrame]:
        rows: list[tuple] = []
        held = 0
        for i, t, (x, d) in zip(ids, texts, encode_texts(vocab, memo, texts), strict=True):
            rows.append((*i, len(x) // 4, x, d))
            held += len(t)
            if held >= FRAME:
                yield frame(rows)
                rows, held = [], 0
        if rows:
            yield frame(rows)

    def frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["doc_id", "no_id", "n_tokens", "ids", "decoded"])

    for pdf in batches:
        for i, none, t in zip(pdf["doc_id"].tolist(), pdf["no_id"].tolist(), pdf["text"], strict=True):
            parts = vocab.parts(t) if isinstance(t, str) else [""]
            if len(parts) > 1:
                got = [pair for part in parts for pair in encode_texts(vocab, memo, [part]) if pair[0]]
                raw = b"".join([x for x, _ in got])
                yield frame([(i, none, len(raw) // 4, raw, " ".join([d for _, d in got]))])
                continue
            ids.append((i, none))
            texts.append(parts[0])
            size += len(texts[-1])
            if size >= BATCH:
                yield from flush()
                ids, texts, size = [], [], 0
    if ids:
        yield from flush()


def _digested(batches: Iterator[pd.DataFrame], shared, key: str) -> Iterator[pd.DataFrame]:
    """As bpe_encode() followed by bpe_digests(), without moving ids and texts out of the worker."""
    for pdf in _encoded(batches, shared, key):
        yield pd.DataFrame(
            {"doc_id": pdf["doc_id"], "no_id": pdf["no_id"], "n_tokens": pdf["n_tokens"], "ids_sha256": [hashlib.sha256(x).hexdigest() for x in pdf["ids"]], "decoded_sha256": [hashlib.sha256(x.encode("utf-8", "replace")).hexdigest() for x in pdf["decoded"]]}
        )


def bpe_encode(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded) for every row of docs(doc_id, text): ids as bytes, four little-endian ones each.

    As the tokenizers library encodes with the file at `vocabulary` and add_special_tokens=False, and decodes with
    skip_special_tokens=False.  Null texts count as empty: no ids, decoded ''.  Null or repeated doc_ids come out like
    any other; other columns are ignored.  No shuffle; a text is held whole and encoded in parts.
    """
    prepare(docs.sparkSession)
    shared = read_shared(docs.sparkSession, vocabulary)
    return unkeyed(keyed(docs).mapInPandas(lambda it: _encoded(it, shared, vocabulary), "doc_id long, no_id boolean, n_tokens long, ids binary, decoded string"))


def bpe_digests(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of what bpe_encode() gives."""
    prepare(docs.sparkSession)
    shared = read_shared(docs.sparkSession, vocabulary)
    return unkeyed(keyed(docs).mapInPandas(lambda it: _digested(it, shared, vocabulary), "doc_id long, no_id boolean, n_tokens long, ids_sha256 string, decoded_sha256 string"))
