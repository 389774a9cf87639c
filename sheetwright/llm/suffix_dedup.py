"""Removal of repeated byte strings by sorting suffixes: deep-shallow sorting (Manzini, Ferragina 2004) over anchored suffixes.

A byte goes when a string of `length` bytes that covers it also starts earlier in the corpus.  Sorting every suffix of
100 TB is out of reach, and most suffixes are alone, so those to be sorted are chosen without loss: the half-length
strings whose hash is the smallest in a window of starts are anchors, every string of `length` bytes holds one at a
place that its content alone decides, and a string that repeats holds an anchor that repeats.

1. `_anchored`  each chunk of texts sends the hashes of its anchors, each once, to hash buckets;
2. `_repeats`   a bucket answers with the hashes that occur twice or more;
3. `_suffixes`  each chunk sends the surroundings of its anchors with such hashes (equal ones of a chunk: the first);
4. `_sorted`    a bucket orders the suffixes at its anchors, and the reversed texts before them, by deep-shallow
                sorting; shared prefixes of neighbours in both orders tell which strings around the anchors are equal;
5. `_removed`   each chunk gets the starts of its repeated strings and cuts what they cover.

Chunks are rows of a table in the shared folder, so steps 1, 3 and 5 see the same ones.  The strings around an anchor hash
with very many different surroundings (`HOT`) are dealt out by their content, so that no bucket meets them all, and each
bucket orders its share by deep-shallow sorting too.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import bucket_count, forget, keyed, materialize, mix, prepare, trim_memory, unkeyed

CHUNK = 2 << 20
#: Starts of strings whose anchors are looked for at a time, whatever a text's length.
SEGMENT = 4 << 20
#: Bytes of the input whose anchors share a bucket, about.
BUCKET_BYTES = 16 << 20
#: Occurrences of an anchor hash beyond which the strings around it are dealt out by their content.
HOT = 4096
#: Bytes that multikey quicksort looks at; what still ties is left to blind tries.
SHALLOW = 32
_U = np.uint64
_BUCKETS = "kind int, bucket int, chunk long, blob binary"
_DUPS = np.dtype([("doc", "<u4"), ("pos", "<u4"), ("bits", "<u8")])
_ODD = 0x2545F4914F6CDD1D
_BYTE = mix(np.arange(1, 257, dtype=np.uint64))
SUFFIX, WINDOW, LOCAL = range(3)
_power: dict[int, np.ndarray] = {}


def _pack(raw: bytes, level: int = 3) -> bytes:
    return zstandard.ZstdCompressor(level=level).compress(raw)


def _unpack(blob: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(blob)


def _runs(values: np.ndarray) -> list[tuple[int, int]]:
    """(begin, end) of the runs of equal neighbours."""
    begin = np.flatnonzero(np.append(True, values[1:] != values[:-1]))[: len(values)]
    return list(zip(begin.tolist(), np.append(begin[1:], len(values)).tolist(), strict=True)) if len(values) else []


# --- chunks


def _chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, no_id, text, others ...) in chunks of about CHUNK bytes of text; the others travel as an Arrow stream."""
    part = TaskContext.get().partitionId()
    held: list[pa.RecordBatch] = []
    number = size = 0

    def flush() -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        texts = [x or b"" for x in t["text"].cast(pa.large_binary()).to_pylist()]
        docs = t["doc_id"].to_numpy().astype("<i8")
        lens = np.array([len(x) for x in texts], dtype="<i8")
        real = (~t["no_id"].to_numpy().astype(bool)).astype(np.uint8)
        sink = pa.BufferOutputStream()
        notes = t.drop_columns(["doc_id", "no_id", "text"])
        with pa.ipc.new_stream(sink, notes.schema) as out:
            out.write_table(notes)
        blob = _pack(docs.tobytes() + lens.tobytes() + real.tobytes() + b"".join(texts), 5)
        return pa.RecordBatch.from_arrays(
            [pa.array([(part << 32) + number], pa.int64()), pa.array([len(docs)], pa.int32()), pa.array([blob], pa.binary()), pa.array([_pack(sink.getvalue().to_pybytes())], pa.binary())], names=["chunk", "n", "blob", "notes"]
        )

    for batch in batches:
        lens = [len(x or b"") + 64 for x in batch.column("text").cast(pa.large_binary()).to_pylist()]
        last = 0
        for at, n in enumerate(lens, 1):
            size += n
            if size >= CHUNK:
                held.append(batch.slice(last, at - last))
                yield flush()
                last, size, number = at, 0, number + 1
                held.clear()
                trim_memory()
        if last < len(lens):
            held.append(batch.slice(last))
    if held:
        yield flush()
    trim_memory()


def _read_chunk(n: int, blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, flags of real ids, ends, bytes) of a chunk's texts."""
    raw = _unpack(blob)
    docs, lens = np.frombuffer(raw, "<i8", n), np.frombuffer(raw, "<i8", n, 8 * n)
    return docs, np.frombuffer(raw, np.uint8, n, 16 * n), np.cumsum(lens), np.frombuffer(raw, np.uint8, offset=17 * n)


# --- anchors


def _powers(n: int, base: int) -> np.ndarray:
    if base not in _power or len(_power[base]) < n:
        grown = np.full(max(n, CHUNK + (1 << 16)), base, dtype=np.uint64)
        grown[0] = 1
        _power[base] = np.multiply.accumulate(grown)
    return _power[base][:n]


def anchors(data: np.ndarray, ends: np.ndarray, length: int, segment: int = SEGMENT) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(places, hashes of the half-length strings there, first and last starts of the strings that they stand for).

    Each string of `length` bytes within one text has one anchor; those of an anchor start one after the other.  Long
    data is searched in segments of starts, so that memory stays bounded; an anchor may come out of two of them, each
    time with its own starts.
    """
    if len(data) <= segment + length:
        return _anchors(data, ends, length)
    found = []
    for a in range(0, len(data), segment):
        some = data[a : a + segment + length - 1]
        low, high = np.searchsorted(ends, a, side="right"), np.searchsorted(ends, a + len(some)) + 1
        at, h, first, last = _anchors(some, np.clip(ends[low:high] - a, 0, len(some)), length)
        found.append((at + a, h, first + a, last + a))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _anchors(data: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    k = length // 2
    w = length - k + 1
    lens = np.diff(ends, prepend=0)
    starts = np.maximum(lens - length + 1, 0)
    if not starts.sum():
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    n = len(data)
    total = np.empty(n + 1, dtype=np.uint64)
    total[0] = 0
    np.cumsum(_BYTE[data] * _powers(n, _ODD), out=total[1:])
    h = (total[k:] - total[:-k]) * _powers(n - k + 1, pow(_ODD, -1, 2**64))
    del total
    h = mix(h)
    bits = max(22, int(n).bit_length())
    low = _U((1 << bits) - 1)
    least = (h & ~low) | np.arange(len(h), dtype=np.uint64)  # ties go to the left
    span = 1
    while 2 * span <= w:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < w:
        least = np.minimum(least[: len(least) - (w - span)], least[w - span :])
    real = np.zeros(n + 1, dtype=np.int8)
    begin = (ends - lens)[starts > 0]
    np.add.at(real, begin, 1)
    np.add.at(real, begin + starts[starts > 0], -1)
    inside = np.cumsum(real[: len(least)], dtype=np.int8) > 0
    start = np.flatnonzero(inside)
    at = (least[start] & low).astype(np.int64)
    begin = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    at = at[begin]
    return at, h[at], start[begin], start[np.append(begin[1:], len(start)) - 1]


def _anchored(batches: Iterator[pd.DataFrame], length: int, buckets: int) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for chunk, n, blob in zip(pdf["chunk"], pdf["n"], pdf["blob"], strict=True):
            _, _, ends, data = _read_chunk(n, blob)
            h, count = np.unique(anchors(data, ends, length)[1], return_counts=True)
            to = (mix(h) % _U(buckets)).astype(np.int64)
            order = np.argsort(to, kind="stable")
            h, count, to = h[order], np.minimum(count[order], 255).astype(np.uint8), to[order]
            rows = [(0, int(to[b]), chunk, h[b:e].tobytes() + count[b:e].tobytes()) for b, e in _runs(to)]
            yield pd.DataFrame(rows, columns=["kind", "bucket", "chunk", "blob"])
    trim_memory()


def _repeats(pdf: pd.DataFrame) -> pd.DataFrame:
    """Hashes that occur twice, to the chunks that hold them, those of very many occurrences apart."""
    sizes = np.array([len(b) // 9 for b in pdf["blob"]])
    h = np.concatenate([np.frombuffer(b, "<u8", n) for b, n in zip(pdf["blob"], sizes, strict=True)])
    count = np.concatenate([np.frombuffer(b, np.uint8, n, 8 * n) for b, n in zip(pdf["blob"], sizes, strict=True)]).astype(np.int64)
    which = np.repeat(np.arange(len(sizes)), sizes)
    order = np.argsort(h, kind="stable")
    h, count, which = h[order], count[order], which[order]
    if not len(h):
        return pd.DataFrame([], columns=["kind", "bucket", "chunk", "blob"])
    begin = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
    times = np.repeat(np.add.reduceat(count, begin), np.diff(np.append(begin, len(h))))
    use = times > 1
    h, which, hot = h[use], which[use], (times[use] > HOT).astype(np.uint8)
    order = np.argsort(which, kind="stable")
    h, which, hot = h[order], which[order], hot[order]
    ids = pdf["chunk"].to_numpy()
    return pd.DataFrame([(0, 0, ids[which[b]], h[b:e].tobytes() + hot[b:e].tobytes()) for b, e in _runs(which)], columns=["kind", "bucket", "chunk", "blob"])


# --- suffixes


def _entry(length: int) -> np.dtype:
    k = length // 2
    return np.dtype([("h", "<u8"), ("real", "u1"), ("id", "<i8"), ("chunk", "<i8"), ("doc", "<u4"), ("pos", "<u4"), ("before", "<u2"), ("after", "<u2"), ("text", "u1", length - k + length)])


def _starts(before: np.ndarray, after: np.ndarray, length: int) -> np.ndarray:
    """Bit j: the string that starts j bytes before the anchor lies within the text."""
    k = length // 2
    out = np.zeros(len(before), dtype=np.uint64)
    for j in range(length - k + 1):
        out |= ((before >= j) & (after >= length - j)).astype(np.uint64) << _U(j)
    return out


def _suffixes(chunk_df: pd.DataFrame, repeats: pd.DataFrame, length: int, buckets: int) -> pd.DataFrame:
    k, reach = length // 2, length - length // 2
    rows: list[tuple] = []
    for chunk, n, blob in zip(chunk_df["chunk"], chunk_df["n"], chunk_df["blob"], strict=True):
        if not len(repeats):
            continue
        known = np.concatenate([np.frombuffer(b, "<u8", len(b) // 9) for b in repeats["blob"]])
        hot = np.concatenate([np.frombuffer(b, np.uint8, len(b) // 9, 8 * (len(b) // 9)) for b in repeats["blob"]])
        order = np.argsort(known)
        known, hot = known[order], hot[order]
        ids, real, ends, data = _read_chunk(n, blob)
        at, h, first_start, last_start = anchors(data, ends, length)
        found = np.minimum(np.searchsorted(known, h), len(known) - 1)
        use = known[found] == h
        at, h, first_start, last_start, hot = at[use], h[use], first_start[use], last_start[use], hot[found[use]] > 0
        doc = np.searchsorted(ends, at, side="right")
        begin = ends[doc] - np.diff(ends, prepend=0)[doc]
        out = np.zeros(len(at), dtype=_entry(length))
        out["h"], out["real"], out["id"], out["chunk"], out["doc"], out["pos"] = h, real[doc], ids[doc], chunk, doc, at - begin
        # what the strings of an anchor cover, no more
        out["before"], out["after"] = at - first_start, last_start + length - at
        place = at[:, None] + np.arange(-reach, length)
        ok = (place >= first_start[:, None]) & (place < last_start[:, None] + length)
        out["text"] = np.where(ok, data[np.clip(place, 0, max(len(data) - 1, 0))], 0) if len(at) else out["text"]
        order = np.lexsort((out["pos"], out["doc"], out["id"], out["real"]))
        out, hot = out[order], hot[order]
        # of equal surroundings the first goes on; the others' strings all start earlier
        first: dict[bytes, None] = {}
        keep = np.ones(len(out), dtype=bool)
        for i, key in enumerate(zip(out["before"].tolist(), out["after"].tolist(), [t.tobytes() for t in out["text"]], strict=True)):
            keep[i] = key not in first
            first[key] = None
        rest = out[~keep]
        local = np.zeros(len(rest), dtype=_DUPS)
        local["doc"], local["pos"], local["bits"] = rest["doc"], rest["pos"], _starts(rest["before"], rest["after"], length)
        if len(local):
            rows.append((LOCAL, int(chunk) % buckets, chunk, _pack(local.tobytes())))
        near, far = out[keep & ~hot], out[keep & hot]
        to = (mix(near["h"]) % _U(buckets)).astype(np.int64)
        order = np.argsort(to, kind="stable")
        for b, e in _runs(to[order]):
            rows.append((SUFFIX, int(to[order[b]]), chunk, _pack(near[order[b:e]].tobytes())))
        if len(far):
            rows += _dealt(far, chunk, length, buckets)
    return pd.DataFrame(rows, columns=["kind", "bucket", "chunk", "blob"])


def _window(length: int) -> np.dtype:
    return np.dtype([("real", "u1"), ("id", "<i8"), ("chunk", "<i8"), ("doc", "<u4"), ("pos", "<u4"), ("text", "u1", length)])


def _dealt(far: np.ndarray, chunk: int, length: int, buckets: int) -> list[tuple]:
    """Every string around hot anchors, to a bucket that its content decides; of equal ones of the chunk, the first goes on."""
    reach = length - length // 2
    first: dict[bytes, tuple] = {}
    local: list[tuple] = []
    done: set[tuple[int, int]] = set()
    for e in far:
        text, pos, doc = e["text"].tobytes(), int(e["pos"]), int(e["doc"])
        for j in range(min(reach, int(e["before"])), max(0, length - int(e["after"])) - 1, -1):
            if (doc, pos - j) in done:
                continue
            done.add((doc, pos - j))
            key = text[reach - j : reach - j + length]
            mine = (int(e["real"]), int(e["id"]), chunk, doc, pos - j)
            old = first.setdefault(key, mine)
            if old != mine:
                if mine < old:
                    first[key], mine = mine, old
                local.append((mine[3], mine[4], 1))
    rows = [(LOCAL, int(chunk) % buckets, chunk, _pack(np.array(local, dtype=_DUPS).tobytes()))] if local else []
    out = np.zeros(len(first), dtype=_window(length))
    out["text"] = np.frombuffer(b"".join(first), np.uint8).reshape(-1, length)
    for k, name in enumerate(("real", "id", "chunk", "doc", "pos")):
        out[name] = [v[k] for v in first.values()]
    digest = np.frombuffer(b"".join(hashlib.blake2b(key, digest_size=8).digest() for key in first), "<u8")
    to = (digest % _U(buckets)).astype(np.int64)
    order = np.argsort(to, kind="stable")
    return rows + [(WINDOW, int(to[order[b]]), chunk, _pack(out[order[b:e]].tobytes())) for b, e in _runs(to[order])]


# --- deep-shallow sorting


def multikey_quicksort(words: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, shared words with the predecessor) of rows of unsigned words, sorted within their groups.

    All groups split at once: each takes its middle row's word as pivot and becomes three (less, equal, greater), and
    the equal one moves on to the next word.  Rows of different groups share -1 words.
    """
    n, depth_end = len(group), words.shape[1]
    order = np.argsort(group, kind="stable")
    g = group[order]
    new = np.append(True, g[1:] != g[:-1])
    shared = np.where(new, -1, 0)
    part = np.cumsum(new) - 1  # rank of each place's part among the parts
    depth = np.zeros(n, dtype=np.int64)
    while True:
        begin = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
        size = np.diff(np.append(begin, n))
        live = np.repeat(size > 1, size) & (depth < depth_end)
        if not live.any():
            return order, shared
        at = np.flatnonzero(live)
        pivot = order[(begin + size // 2)[part[at]]]
        mine = words[order[at], depth[at]]
        theirs = words[pivot, depth[at]]
        side = (mine > theirs).astype(np.int8) - (mine < theirs).astype(np.int8)
        if side.any():
            moved = np.lexsort((side, part[at]))
            order[at], side = order[at[moved]], side[moved]
            split = np.append(False, (part[at][1:] == part[at][:-1]) & (side[1:] != side[:-1]))
            shared[at[split]] = depth[at[split]]
            bump = np.zeros(n, dtype=np.int64)
            bump[at[split]] = 1
            part = part + np.cumsum(bump)
        depth[at] += side == 0


class BlindTrie:
    """A trie of strings of one length whose inner nodes keep only where they branch (Ferragina, Grossi 1999).

    A search compares single bytes down to some leaf; one comparison with that leaf's string then tells where the new
    string leaves the path.
    """

    def __init__(self, first: bytes) -> None:
        self.root: tuple | bytes = first  # inner node: (branching depth, {byte: child}); leaf: its string

    def insert(self, s: bytes) -> None:
        node = self.root
        while not isinstance(node, bytes):
            at, kids = node
            node = kids.get(s[at]) or next(iter(kids.values()))
        size = len(s)
        differ = int.from_bytes(s, "big") ^ int.from_bytes(node, "big")
        if not differ:
            return
        lcp = size - (differ.bit_length() + 7) // 8
        node, up = self.root, None
        while not isinstance(node, bytes) and node[0] < lcp:
            up, node = node, node[1][s[node[0]]]
        if not isinstance(node, bytes) and node[0] == lcp:
            node[1][s[lcp]] = s
            return
        leaf = node
        while not isinstance(leaf, bytes):
            leaf = next(iter(leaf[1].values()))
        fork = (lcp, {leaf[lcp]: node, s[lcp]: s})
        if up is None:
            self.root = fork
        else:
            up[1][s[up[0]]] = fork

    def walk(self) -> Iterator[tuple[bytes, int]]:
        """(string, bytes it shares with the one before) in ascending order; the first shares 0."""
        stack: list[tuple] = [(self.root, 0)]
        while stack:
            node, lcp = stack.pop()
            if isinstance(node, bytes):
                yield node, lcp
            else:
                kids = sorted(node[1].items(), reverse=True)
                stack += [(kid, node[0]) for _, kid in kids[:-1]]
                stack.append((kids[-1][1], lcp))


def deep_shallow_sort(text: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, bytes shared with the predecessor) of equally long rows of bytes, sorted within groups; -1 at a group's first."""
    n, width = text.shape
    shallow = min(SHALLOW, width) // 8 * 8
    words = np.ascontiguousarray(text[:, :shallow]).view(">u8").astype(np.uint64)
    order, shared = multikey_quicksort(words, group)
    lcp = np.where(shared > 0, shared * 8, shared)
    part = np.flatnonzero((shared >= 0) & (shared < shallow // 8))
    if len(part):  # whole words are shared, and some bytes of the next one
        at = shared[part]
        differ = words[order[part], at] ^ words[order[part - 1], at]
        lead = np.zeros(len(part), dtype=np.int64)
        for byte in range(7):
            lead += differ >> _U(56 - 8 * byte) == 0
        lcp[part] = at * 8 + lead
    # rows that equal their predecessor in the whole shallow part
    tied = np.append(False, (words[order[1:]] == words[order[:-1]]).all(axis=1)) & (shared >= 0)
    lcp[tied] = width
    begin = np.flatnonzero(~tied)
    size = np.diff(np.append(begin, n))
    raw = np.ascontiguousarray(text[:, shallow:])
    for b, s in zip(begin[size > 1].tolist(), size[size > 1].tolist(), strict=True):
        rows = order[b : b + s]
        tail = raw[rows]
        if (tail == tail[0]).all():
            continue
        by: dict[bytes, list[int]] = {}
        for r, t in zip(rows.tolist(), tail, strict=True):
            by.setdefault(t.tobytes(), []).append(r)
        found = iter(by)
        trie = BlindTrie(next(found))
        for t in found:
            trie.insert(t)
        place = b
        for t, common in trie.walk():
            if place > b:
                lcp[place] = shallow + common
            order[place : place + len(by[t])] = by[t]
            lcp[place + 1 : place + len(by[t])] = width
            place += len(by[t])
    return order, lcp


def repeated_starts(e: np.ndarray, length: int) -> np.ndarray:
    """Bit j of each entry (sorted by id, text, place): the string j bytes before its anchor is that of an earlier entry."""
    reach = length - length // 2
    n = len(e)
    _, group = np.unique(e["h"], return_inverse=True)
    right, rlcp = deep_shallow_sort(np.ascontiguousarray(e["text"][:, reach:]), group)
    left, llcp = deep_shallow_sort(np.ascontiguousarray(e["text"][:, reach - 1 :: -1]), group)
    bits = np.zeros(n, dtype=np.uint64)
    rclass, lclass = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
    for j in range(reach + 1):
        ok = np.flatnonzero((e["before"] >= j) & (e["after"] >= length - j))
        if len(ok) < 2:
            continue
        rclass[right] = np.cumsum(rlcp < length - j)
        lclass[left] = np.cumsum(llcp < j)
        key = rclass[ok] * (n + 1) + lclass[ok]
        order = np.argsort(key, kind="stable")
        later = np.append(False, np.diff(key[order]) == 0)
        bits[ok[order[later]]] |= _U(1) << _U(j)
    return bits


def _sorted(pdf: pd.DataFrame, length: int) -> pd.DataFrame:
    rows = [(LOCAL, 0, c, b) for k, c, b in zip(pdf["kind"], pdf["chunk"], pdf["blob"], strict=True) if k == LOCAL]
    suffixes = list(pdf["blob"][pdf["kind"] == SUFFIX])
    windows = list(pdf["blob"][pdf["kind"] == WINDOW])
    del pdf
    found: list[tuple[np.ndarray, np.ndarray]] = []
    if suffixes:
        e = np.concatenate([np.frombuffer(_unpack(b), _entry(length)) for b in suffixes])
        e = e[np.lexsort((e["pos"], e["doc"], e["chunk"], e["id"], e["real"]))]
        found.append((e, repeated_starts(e, length)))
    if windows:
        e = np.concatenate([np.frombuffer(_unpack(b), _window(length)) for b in windows])
        e = e[np.lexsort((e["pos"], e["doc"], e["chunk"], e["id"], e["real"]))]
        order, shared = deep_shallow_sort(np.ascontiguousarray(e["text"]), np.zeros(len(e), dtype=np.int64))
        same = np.empty(len(e), dtype=np.int64)
        same[order] = np.cumsum(shared < length)
        order = np.argsort(same, kind="stable")  # of equal strings the first in the corpus leads
        later = np.zeros(len(e), dtype=np.uint64)
        later[order[np.append(False, np.diff(same[order]) == 0)]] = 1
        found.append((e, later))
    for e, bits in found:
        e, bits = e[bits > 0], bits[bits > 0]
        order = np.argsort(e["chunk"], kind="stable")
        e, bits = e[order], bits[order]
        out = np.zeros(len(e), dtype=_DUPS)
        out["doc"], out["pos"], out["bits"] = e["doc"], e["pos"], bits
        rows += [(LOCAL, 0, int(e["chunk"][b]), _pack(out[b:end].tobytes())) for b, end in _runs(e["chunk"])]
    return pd.DataFrame(rows, columns=["kind", "bucket", "chunk", "blob"])


# --- cutting


def covered(ends: np.ndarray, total: int, dups: np.ndarray, length: int) -> np.ndarray:
    """Flags of the bytes that the repeated strings cover."""
    begin = np.append(0, ends[:-1])
    step = np.zeros(total + 1, dtype=np.int32)
    start = begin[dups["doc"]] + dups["pos"]
    hit = np.zeros(total + 1, dtype=bool)
    for j in range(length - length // 2 + 1):
        hit[start[(dups["bits"] >> _U(j)) & _U(1) > 0] - j] = True
    at = np.flatnonzero(hit)
    step[at] += 1
    step[at + length] -= 1
    return np.cumsum(step[:-1], dtype=np.int32) > 0


def _removed(chunks: pa.Table, dups: pa.Table, length: int, texts: bool, whole: bool) -> pa.Table:
    out = []
    d = np.frombuffer(b"".join(_unpack(b) for b in dups["blob"].to_pylist()), _DUPS)
    for n, blob, notes in zip(chunks["n"].to_pylist(), chunks["blob"].to_pylist(), chunks["notes"].to_pylist(), strict=True):
        ids, real, ends, data = _read_chunk(n, blob)
        gone = covered(ends, len(data), d, length)
        begin = np.append(0, ends[:-1])
        rows = []
        for b, e in zip(begin.tolist(), ends.tolist(), strict=True):
            g = gone[b:e]
            cut = int(g.sum())
            kept = data[b:e][~g].tobytes() if cut else data[b:e].tobytes()
            if whole and cut:
                kept = kept.decode("utf-8", "ignore").encode()
            spans = int(np.count_nonzero(g[1:] & ~g[:-1]) + (e > b and g[0])) if cut else 0
            rows.append((e - b, cut, spans, kept if texts else hashlib.sha256(kept).hexdigest()))
        size, cut, spans, kept = zip(*rows, strict=True)
        carried = pa.ipc.open_stream(_unpack(notes)).read_all()
        own = [pa.array(ids), pa.array(real == 0), *(pa.array(x, pa.int64()) for x in (size, cut, spans)), pa.array(kept, pa.binary() if texts else pa.string())]
        out.append(pa.table([*own, *carried.columns], names=["doc_id", "no_id", "n_bytes", "n_removed", "n_spans", "kept", *carried.column_names]))
    trim_memory()
    return pa.concat_tables(out)


def _trimmed(f, sides: int):
    """f, with freed memory handed back after each group."""

    def one(a: pd.DataFrame) -> pd.DataFrame:
        out = f(a)
        trim_memory()
        return out

    def two(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = f(a, b)
        trim_memory()
        return out

    return one if sides == 1 else two


def _run(docs: DataFrame, length: int, texts: bool, others: list[Column] | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept, _0, _1 ...): the other columns come out by number."""
    if not 16 <= length <= 126:
        raise ValueError("length must lie between 16 and 126")
    prepare(docs.sparkSession)
    buckets, whole = bucket_count(docs, BUCKET_BYTES), others is not None
    carried = docs.select(*[c.alias(f"_{k}") for k, c in enumerate(others or [])])
    rows = keyed(docs, *[c.alias(f"_{k}") for k, c in enumerate(others or [])])
    table = materialize(rows.mapInArrow(_chunked, "chunk long, n int, blob binary, notes binary"), "dedup-chunks")
    work = table.drop("notes")
    heads = work.mapInPandas(lambda it: _anchored(it, length, buckets), _BUCKETS)
    repeats = materialize(heads.groupBy("bucket").applyInPandas(_repeats, _BUCKETS), "dedup-repeats")
    sent = work.groupBy("chunk").cogroup(repeats.groupBy("chunk")).applyInPandas(_trimmed(lambda a, b: _suffixes(a, b, length, buckets), 2), _BUCKETS)
    dups = materialize(sent.groupBy("bucket").applyInPandas(_trimmed(lambda a: _sorted(a, length), 1), _BUCKETS), "dedup-starts")
    forget(repeats)
    schema = StructType.fromDDL(f"doc_id long, no_id boolean, n_bytes long, n_removed long, n_spans long, kept {'binary' if texts else 'string'}")
    schema = StructType([*schema.fields, *carried.schema.fields])
    return unkeyed(table.groupBy("chunk").cogroup(dups.groupBy("chunk")).applyInArrow(lambda a, b: _removed(a, b, length, texts, whole), schema))


def repeated_bytes(docs: DataFrame, length: int = 100) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) for every row of docs(doc_id, text): `kept` is the bytes that stay.

    Texts are UTF-8 bytes, null ones empty; strings never cross texts.  A byte goes when a `length`-byte string that
    covers it also starts earlier: in a row of a smaller doc_id, or in the same text.  A null doc_id counts as the
    smallest; rows that share one are taken in the order in which they were read, so of equal rows one stays whole.
    Other columns are ignored; an empty table gives an empty result.  A text is held whole, anchors are looked for in
    segments of it.
    """
    return _run(docs, length, True)


def repeated_digests(docs: DataFrame, length: int = 100) -> DataFrame:
    """As repeated_bytes(), with kept_sha256 in place of the bytes."""
    return _run(docs, length, False).withColumnRenamed("kept", "kept_sha256")


def without_repeats(docs: DataFrame, length: int = 100) -> DataFrame:
    """docs with each text cut down to the bytes that stay; rows that lose their whole text go, all columns stay.

    A character of which some bytes go, goes.  Texts that lose nothing, null ones too, stay as they are; where the table
    has n_chars, it is counted again for texts that were cut.
    """
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    found = _run(docs, length, True, [*[docs[f"`{c}`"] for c in others], docs["text"].isNull()])
    found = found.where("n_removed = 0 or n_removed < n_bytes")
    new = {c: F.col(f"_{k}") for k, c in enumerate(others)}
    new["text"] = F.when(~F.col(f"_{len(others)}"), F.col("kept").cast("string"))
    new["doc_id"] = F.col("doc_id").cast(docs.schema["doc_id"].dataType)
    if "n_chars" in new:
        new["n_chars"] = F.when(F.col("n_removed") > 0, F.char_length(new["text"]).cast(docs.schema["n_chars"].dataType)).otherwise(new["n_chars"])
    return found.select(*[new[c].alias(c) for c in docs.columns])
