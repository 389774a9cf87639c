"""N-gram Jaccard self-join by PartEnum signatures (Arasu, Ganti, Kaushik 2006), exact.

A document's set is its distinct n-word shingles as 64-bit hashes.  Sizes fall into bands whose upper end R is the
lower end divided by the threshold, so a pair at or over the threshold lies in one band or in two neighbours; every
set is signed for its own band and the next.  In a band, such a pair differs in at most k = 2R(1-t)/(1+t) elements.
The hash domain is cut into first-level partitions of which one must differ in at most one element, and those into
second-level ones, of which subsets are enumerated: two of three for small k, one of two beyond.  A signature is the
digest of a set's elements in such a subset, so each qualifying pair shares one.  An empty subset would join
strangers; a set with more empty signatures than a pair is sure to share signs again under another seed.

Links, not pairs, are wanted: in a signature's group only the pairs with the smallest id are compared exactly, then
components are found.  A pair must first pass an exact lower bound on its difference: bit i of a set's parity map says
whether an odd number of elements falls into cell i, and two sets differ at least where their maps do (a longer map folds
onto a shorter one by exclusive or).  Groups that still span several components are opened in two steps, in blocks that meet
within tasks.  First the maps tell which documents still have a possible partner in another component; what such pairs
connect within a task becomes a group of its own.  Then the texts of these are sent, their sets are compared, and a task
gives a forest of true links.  Neither step gives more rows than its tasks hold documents.

No link between different texts is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bucket_count, chunks, components, forget, keyed, materialize, mix, prepare, shingle_hashes, sorted_sets, text_bytes, trim_memory, word_hashes

#: Sets that differ in at most so many elements are signed by two of three second-level partitions, others by one of two.
SMALL_K = 16
#: Seeds after which empty signatures are emitted as well.
SEEDS = 12
#: A signature held by so many documents of one chunk is grouped there; its smallest id alone goes on.
HEAVY = 64
#: Documents in a block of a group that is compared across components; bytes of their sets, where these are sent.
BLOCK, BLOCK_BYTES = 1024, 4 << 20
#: Bytes of the input whose signatures share a bucket, and of sets that a task of the last round holds, about.
BUCKET_BYTES, TASK_BYTES = 32 << 20, 32 << 20
#: Buckets over which groups with the same smallest id are spread.
SALTS = 16
#: Ids in a cell of a group.
CELL = 1 << 16
_U = np.uint64
SCHEMA = "bucket int, kind int, gid long, blob binary"
DIGEST, SIGNATURE, FLAGGED, SIZES, GROUP, LINK, SAME = range(7)
_DIGEST = np.dtype([("a", "<u8"), ("b", "<u8"), ("doc", "<i8")])
_SIZES = np.dtype([("doc", "<i8"), ("n", "<i8"), ("words", "<i8")])


def bands(largest: int, num: int, den: int) -> np.ndarray:
    """Upper ends of the size bands 0, 1, 2 ... until one past the band of `largest`."""
    ends, low = [], 1
    while True:
        high = max(low, low * den // num)
        ends.append(high)
        if len(ends) > 1 and ends[-2] >= largest:
            return np.array(ends, dtype=np.int64)
        low = high + 1


def _plan(k: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cells, whether by threes, signatures that a pair surely shares) for each k and the smallest size signed with it.

    Cells beyond the number needed let a pair share more signatures than a set is likely to have empty ones.
    """
    threes = (k > 0) & (k <= SMALL_K)
    wide = k + 1
    for _ in range(3):
        wide = np.where(k > SMALL_K, k + 4 + np.ceil(1.3 * wide * np.exp(-least / wide)).astype(np.int64), k + 1)
    first = (k + 2) // 2 + 1
    return np.where(threes, 3 * first, wide), threes, np.where(threes, first - k // 2, wide - k)


def signatures(sets: list[np.ndarray], num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """(signature, index of its set), for all sets that aren't empty."""
    n = np.fromiter((len(s) for s in sets), dtype=np.int64, count=len(sets))
    if not n.sum():
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    ends = bands(int(n.max()), num, den)
    own = np.searchsorted(ends, n)
    flat = np.concatenate(sets)
    begin = np.cumsum(n) - n
    sigs, docs = [], []
    for step in (0, 1):
        todo = np.flatnonzero(n > 0)
        for seed in range(SEEDS):
            if not len(todo):
                break
            band = own[todo] + step
            k = 2 * ends[band] * (den - num) // (den + num)
            cells, threes, sure = _plan(k, np.append([1, 1], ends + 1)[band])
            size = n[todo]
            base = np.cumsum(cells) - cells
            where = np.repeat(np.arange(len(todo)), size)
            at = np.repeat(begin[todo] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
            h = mix(flat[at] + _U(((2 * seed + 1) * 0x9E3779B97F4A7C15) & (2**64 - 1)))
            slot = base[where] + (((h >> _U(32)) * cells[where].astype(np.uint64)) >> _U(32)).astype(np.int64)
            total = int(cells.sum())
            digest = np.zeros(total, dtype=np.uint64)
            np.add.at(digest, slot, mix(h))
            count = np.bincount(slot, minlength=total)
            cell_doc = np.repeat(np.arange(len(todo)), cells)
            index = np.arange(total) - base[cell_doc]
            three = threes[cell_doc]
            # one cell is the signature, or, by threes, cells i and i+1 (cyclic) of each first-level partition
            mate = np.where(index % 3 == 2, np.arange(total) - 2, np.minimum(np.arange(total) + 1, total - 1))
            digest = np.where(three, digest * _U(3) + digest[mate] * _U(5), digest)
            held = count + np.where(three, count[mate], 0)
            key = (band[cell_doc].astype(np.uint64) << _U(40)) + (_U(seed) << _U(34)) + index.astype(np.uint64)
            sig = mix(digest + mix(key + _U(1)))
            empty = np.bincount(cell_doc, weights=held == 0, minlength=len(todo)).astype(np.int64)
            bad = empty >= sure
            use = (held > 0) | bool(seed == SEEDS - 1) & bad[cell_doc]
            sigs.append(sig[use])
            docs.append(todo[cell_doc[use]])
            todo = todo[bad]
    return np.concatenate(sigs), np.concatenate(docs)


def _pack(sig: np.ndarray, doc: np.ndarray) -> bytes:
    """Signatures with ascending ids: differences in as few bytes as hold them."""
    order = np.argsort(doc, kind="stable")
    sig, doc = sig[order], doc[order]
    step = np.diff(doc.view(np.uint64), prepend=doc[:1].view(np.uint64))  # ids may lie over 2^63 apart
    code = next(c for c in "BHIQ" if step.max() <= np.iinfo(c).max)
    return code.encode() + doc[:1].tobytes() + sig.tobytes() + step.astype(code).tobytes()


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    kind = np.dtype(chr(blob[0]))
    n = (len(blob) - 9) // (8 + kind.itemsize)
    sig = np.frombuffer(blob, dtype=np.uint64, offset=9, count=n)
    step = np.frombuffer(blob, dtype=kind, offset=9 + 8 * n, count=n).astype(np.uint64)
    return sig, (np.cumsum(step, dtype=np.uint64) + np.frombuffer(blob, dtype=np.uint64, offset=1, count=1)).view(np.int64)


def _runs(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    begin = np.flatnonzero(np.append(True, sorted_values[1:] != sorted_values[:-1])) if len(sorted_values) else np.zeros(0, dtype=np.int64)
    return begin, np.diff(np.append(begin, len(sorted_values)))


def _pairs(u: np.ndarray, v: np.ndarray) -> bytes:
    keep = u != v
    both = np.unique(np.stack([u[keep], v[keep]], axis=1), axis=0) if keep.any() else np.zeros((0, 2), dtype=np.int64)
    return both.astype("<i8").tobytes()


def _groups(sig: np.ndarray, doc: np.ndarray, flagged: np.ndarray) -> tuple[bytes, list[tuple[int, bytes]]]:
    """Links of each signature's ids with the smallest one; the groups of three or more ids, equal ones once."""
    order = np.lexsort((doc, sig))
    sig, doc, flagged = sig[order], doc[order], flagged[order]
    begin, size = _runs(sig)
    lead = np.repeat(doc[begin], size)
    links = _pairs(lead, doc)
    groups: dict[int, bytes] = {}
    marked = np.add.reduceat(flagged.astype(np.int64), begin) if len(begin) else flagged
    for b, s, m in zip(begin[size > 1].tolist(), size[size > 1].tolist(), marked[size > 1].tolist(), strict=True):
        if s > 2 or m:
            ids = np.unique(doc[b : b + s])
            if len(ids) > 2 or m and len(ids) > 1:
                gid = int(sig[b].astype(np.int64)) if m else int(np.add.reduce(mix(ids.astype(np.uint64))) >> _U(2))
                groups[gid] = ids.tobytes()
    return links, list(groups.items())


def parity_map(s: np.ndarray) -> np.ndarray:
    """2 to 4 bits an element, as a power of two of 64-bit words."""
    words = 1 << max(0, (2 * len(s) - 1).bit_length() - 6)
    cell = (mix(s ^ _U(0x71D67FFFEDA60000)) >> _U(20)) & _U(64 * words - 1)
    flags = (np.bincount(cell.astype(np.int64), minlength=64 * words) & 1).astype(np.uint8)
    return np.packbits(flags, bitorder="little").view("<u8")


def plausible(maps: np.ndarray, offset: np.ndarray, words: np.ndarray, n: np.ndarray, a: np.ndarray, b: np.ndarray, num: int, den: int) -> np.ndarray:
    """Which pairs (a[i], b[i]) of sets the sizes and parity maps don't rule out; maps: all sets' maps, one after the other."""
    ok = (den * np.minimum(n[a], n[b]) >= num * np.maximum(n[a], n[b])) & (n[a] > 0) & (n[b] > 0)
    at = np.flatnonzero(ok)
    long, short = np.where(words[a] >= words[b], a, b)[at], np.where(words[a] >= words[b], b, a)[at]
    kinds = words[long] * (1 << 32) + words[short]
    for kind in np.unique(kinds).tolist():
        wide, narrow = kind >> 32, kind & 0xFFFFFFFF
        mine = np.flatnonzero(kinds == kind)
        for some in np.array_split(mine, 1 + len(mine) * wide // (1 << 20)):
            x = maps[offset[long[some]][:, None] + np.arange(wide)].reshape(len(some), wide // narrow, narrow)
            y = maps[offset[short[some]][:, None] + np.arange(narrow)]
            differ = np.bitwise_count(np.bitwise_xor.reduce(x, axis=1) ^ y).sum(axis=1).astype(np.int64)
            ok[at[some]] = differ * (den + num) <= (n[long[some]] + n[short[some]]) * (den - num)
    return ok


def _signed(batches: Iterator[pd.DataFrame], words: int, num: int, den: int, buckets: int, many: int) -> Iterator[pd.DataFrame]:
    for ids, texts in chunks(batches):
        hashes, counts = word_hashes(texts)
        sets = sorted_sets(*shingle_hashes(hashes, counts, words))
        del hashes
        doc = np.array([i or 0 for i in ids], dtype=np.int64)
        real = np.array([i is not None for i in ids])
        rows: list[tuple[int, int, int, bytes]] = []
        info = np.zeros(len(ids), dtype=_SIZES)
        info["doc"], info["n"] = doc, [len(s) for s in sets]
        maps = [parity_map(s) for s in sets]
        info["words"] = [len(m) for m in maps]
        for nulls, own in ((0, np.flatnonzero(real)), (1, np.flatnonzero(~real))):
            if len(own):
                rows.append((int(doc[own[0]]) % buckets, SIZES, nulls, len(own).to_bytes(8, "little") + info[own].tobytes() + b"".join(maps[i].tobytes() for i in own)))
        used = np.flatnonzero(real & (info["n"] > 0))
        # equal sets: of each, the smallest id of the chunk goes on
        first: dict[tuple[int, int], int] = {}
        same_u, same_v = [], []
        for at in used[np.argsort(doc[used], kind="stable")].tolist():
            key = (int(np.add.reduce(mix(sets[at]))), int(np.add.reduce(mix(sets[at] ^ _U(0x5851F42D4C957F2D)))) ^ len(sets[at]))
            at0 = first.setdefault(key, at)
            same_u.append(doc[at0])
            same_v.append(doc[at])
        links = _pairs(np.array(same_u, dtype=np.int64), np.array(same_v, dtype=np.int64))
        if links:
            rows.append((int(doc[used[0]]) % buckets, SAME, 0, links))
        lead = list(first.values())
        digest = np.array([(*k, doc[at]) for k, at in first.items()], dtype=_DIGEST)
        sig, which = signatures([sets[at] for at in lead], num, den)
        which = doc[np.array(lead, dtype=np.int64)[which]] if len(lead) else which
        order = np.argsort(sig, kind="stable")
        sig, which = sig[order], which[order]
        begin, size = _runs(sig)
        heavy = np.flatnonzero(size >= many)
        flagged: list[tuple[int, int]] = []
        keep = np.ones(len(sig), dtype=bool)
        seen: set[bytes] = set()
        for b, s in zip(begin[heavy].tolist(), size[heavy].tolist(), strict=True):
            members = np.unique(which[b : b + s])
            keep[b : b + s] = False
            flagged.append((b, int(members[0])))
            at = int(sig[b] >> _U(20)) % buckets
            rows.append((at, GROUP, int(sig[b].astype(np.int64)), members.tobytes()))
            if members.tobytes() not in seen:
                seen.add(members.tobytes())
                rows.append((at, LINK, 0, _pairs(np.full(len(members), members[0]), members)))
        for kind, s, d in ((SIGNATURE, sig[keep], which[keep]), (FLAGGED, sig[[b for b, _ in flagged]], np.array([d for _, d in flagged], dtype=np.int64))):
            if len(s):
                to = (s >> _U(20)) % _U(buckets)
                order = np.argsort(to, kind="stable")
                s, d, to = s[order], d[order], to[order]
                for b, n in zip(*_runs(to), strict=True):
                    rows.append((int(to[b]), kind, 0, _pack(s[b : b + n], d[b : b + n])))
        to = (digest["a"] >> _U(20)) % _U(buckets)
        order = np.argsort(to, kind="stable")
        for b, n in zip(*_runs(to[order]), strict=True):
            rows.append((int(to[order][b]), DIGEST, 0, digest[order[b : b + n]].tobytes()))
        yield pd.DataFrame(rows, columns=["bucket", "kind", "gid", "blob"])


def _met(pdf: pd.DataFrame) -> pd.DataFrame:
    """One bucket: sizes, links and groups pass; equal digests and signatures meet."""
    rows = [(0, k, g, b) for k, g, b in zip(pdf["kind"], pdf["gid"], pdf["blob"], strict=True) if k in (SIZES, GROUP, LINK, SAME)]
    by = {k: list(pdf["blob"][pdf["kind"] == k]) for k in (DIGEST, SIGNATURE, FLAGGED)}
    del pdf
    if by[DIGEST]:
        d = np.sort(np.concatenate([np.frombuffer(b, dtype=_DIGEST) for b in by[DIGEST]]), order=["a", "b", "doc"])
        begin = np.flatnonzero(np.append(True, (d["a"][1:] != d["a"][:-1]) | (d["b"][1:] != d["b"][:-1])))
        lead = np.repeat(d["doc"][begin], np.diff(np.append(begin, len(d))))
        rows.append((0, SAME, 0, _pairs(lead, d["doc"])))
    if by[SIGNATURE] or by[FLAGGED]:
        parts = [_unpack(b) for k in (SIGNATURE, FLAGGED) for b in by[k]]
        sig, doc = (np.concatenate(x) for x in zip(*parts, strict=True))
        flagged = np.zeros(len(sig), dtype=bool)
        tail = sum(len(s) for s, _ in parts[len(by[SIGNATURE]) :])
        flagged[len(sig) - tail :] = True
        # most signatures are alone: they go before the costly sort
        order = np.argsort(sig, kind="stable")
        s = sig[order]
        same = np.append(s[1:] == s[:-1], False)
        order = order[same | np.append(False, same[:-1])]
        links, groups = _groups(sig[order], doc[order], flagged[order])
        rows.append((0, LINK, 0, links))
        rows += [(0, GROUP, g, b[at : at + 8 * CELL]) for g, b in groups for at in range(0, len(b), 8 * CELL)]
    trim_memory()
    return pd.DataFrame([r for r in rows if r[3]], columns=["bucket", "kind", "gid", "blob"])


def _opened(batches: Iterator[pd.DataFrame], kind: int) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        if kind == SIZES:
            for gid, blob in zip(pdf["gid"], pdf["blob"], strict=True):
                count = int.from_bytes(blob[:8], "little")
                d = np.frombuffer(blob, dtype=_SIZES, offset=8, count=count)
                end = 8 + count * _SIZES.itemsize + 8 * np.cumsum(d["words"])
                ids = pd.array(d["doc"], dtype="Int64")
                if gid:
                    ids[:] = pd.NA
                yield pd.DataFrame({"doc_id": ids, "n": d["n"], "map": [blob[e - 8 * w : e] for e, w in zip(end.tolist(), d["words"].tolist(), strict=True)]})
        elif len(pdf):
            ids = np.frombuffer(b"".join(pdf["blob"]), dtype="<i8")
            if kind == GROUP:
                yield pd.DataFrame({"gid": np.repeat(pdf["gid"].to_numpy(), pdf["blob"].str.len().to_numpy() // 8), "doc_id": ids})
            else:
                yield pd.DataFrame(ids.reshape(-1, 2), columns=["u", "v"])


def _open(met: DataFrame, kind: int) -> DataFrame:
    schema = {SIZES: "doc_id long, n long, map binary", GROUP: "gid long, doc_id long"}.get(kind, "u long, v long")
    rows = met.where(F.col("kind") == kind).select("gid", "blob")
    if kind == GROUP:
        rows = rows.distinct()
    return rows.mapInPandas(lambda it: _opened(it, kind), schema)


def _pairs_dealt(batches: Iterator[pd.DataFrame], buckets: int) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        if len(pdf):
            both = np.frombuffer(b"".join(pdf["blob"]), dtype="<i8").reshape(-1, 2)
            to = (mix(both[:, 0].astype(np.uint64) * _U(0x9E3779B97F4A7C15) + both[:, 1].astype(np.uint64)) % _U(buckets)).astype(np.int64)
            order = np.argsort(to, kind="stable")
            both, to = both[order], to[order]
            yield pd.DataFrame([(int(to[b]), both[b : b + n].tobytes()) for b, n in zip(*_runs(to), strict=True)], columns=["bucket", "blob"])


def _pairs_once(pdf: pd.DataFrame) -> pd.DataFrame:
    both = np.frombuffer(b"".join(pdf["blob"]), dtype="<i8").reshape(-1, 2)
    return pd.DataFrame(np.unique(both, axis=0), columns=["u", "v"])


def _leading(met: DataFrame, buckets: int) -> DataFrame:
    """The distinct pairs of a signature's smallest id with its others."""
    rows = met.where(F.col("kind") == LINK).select("blob").mapInPandas(lambda it: _pairs_dealt(it, buckets), "bucket int, blob binary")
    return rows.groupBy("bucket").applyInPandas(_pairs_once, "u long, v long")


def _laid(maps: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    words = np.array([len(m) // 8 for m in maps], dtype=np.int64)
    return np.frombuffer(b"".join(maps), dtype="<u8"), np.cumsum(words) - words, words


def _possible(batches: Iterator[pd.DataFrame], num: int, den: int) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        n = np.concatenate([pdf["n_u"], pdf["n_v"]]).astype(np.int64)
        at = np.arange(len(pdf))
        ok = plausible(*_laid([*pdf["map_u"], *pdf["map_v"]]), n, at, at + len(pdf), num, den)
        yield pdf.loc[ok, ["u", "v"]]


def _filtered(pairs: DataFrame, sizes: DataFrame, num: int, den: int) -> DataFrame:
    own = sizes.where("doc_id is not null")
    left, right = (own.select(F.col("doc_id").alias(x), F.col("n").alias(f"n_{x}"), F.col("map").alias(f"map_{x}")) for x in "uv")
    near = pairs.join(left.drop("map_u"), "u").join(right, "v").where(f"{den} * least(n_u, n_v) >= {num} * greatest(n_u, n_v)").join(left.drop("n_u"), "u")
    return near.select("u", "v", "n_u", "n_v", "map_u", "map_v").mapInPandas(lambda it: _possible(it, num, den), "u long, v long").distinct()


def _similar(batches: Iterator[pd.DataFrame], words: int, num: int, den: int) -> Iterator[pd.DataFrame]:
    """Pairs whose sets meet the threshold; rows with the same first text follow each other."""

    def one(text: str | None) -> np.ndarray:
        return np.unique(shingle_hashes(*word_hashes([text_bytes(text)]), words)[0])

    last_row, last = None, np.zeros(0, dtype=np.uint64)  # an id may stand on rows with different texts
    for pdf in batches:
        keep = []
        for u, a, b in zip(pdf["u"], pdf["text_u"], pdf["text_v"], strict=True):
            if (u, a) != last_row or not len(last):
                last_row, last = (u, a), one(a)
            other = one(b)
            common = len(np.intersect1d(last, other, assume_unique=True))
            keep.append(den * common >= num * (len(last) + len(other) - common) and common > 0)
        yield pdf.loc[keep, ["u", "v"]]


def _verified(pairs: DataFrame, docs: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """The pairs whose texts meet the threshold; only texts of the pairs move on from the first shuffle.

    That one is a merge join at every size: the ids have no bound that would allow a broadcast.
    """
    pairs = materialize(pairs, "jaccard-pairs")
    wanted = pairs.select(F.col("u").alias("doc_id")).unionAll(pairs.select("v")).distinct()
    texts = materialize(docs.join(wanted.hint("merge"), "doc_id", "left_semi"), "jaccard-texts")
    left = texts.select(F.col("doc_id").alias("u"), F.col("text").alias("text_u"))
    right = texts.select(F.col("doc_id").alias("v"), F.col("text").alias("text_v"))
    rows = pairs.join(right, "v").join(left, "u").select("u", "v", "text_u", "text_v")
    links = materialize(rows.mapInPandas(lambda it: _similar(it, words, num, den), "u long, v long"), "jaccard-links")
    forget(pairs, texts)
    return links


def _root(up: list[int], x: int) -> int:
    while up[x] != x:
        up[x] = up[up[x]]
        x = up[x]
    return x


def _pairs_apart(pdf: pd.DataFrame, member: np.ndarray, node: np.ndarray, up: list[int], n: np.ndarray, num: int, den: int) -> Iterator[np.ndarray]:
    """Pairs of members of different trees and of sizes n that may link, over the blocks (gid, i, j) of pdf, some at a time, each once.

    Trees may grow while this runs: what they join isn't compared any more.
    """
    side = pdf["side"].to_numpy()
    order = np.lexsort((n[member], side, pdf["j"], pdf["i"], pdf["gid"]))
    at, side = member[order], side[order]
    names = pdf[["gid", "i", "j"]].to_numpy()[order]
    begin = np.flatnonzero(np.append(True, (names[1:] != names[:-1]).any(axis=1)))
    tree, most = node.copy(), len(node)
    found: list[np.ndarray] = []
    seen = np.zeros(0, dtype=np.int64)
    held = 0

    def fresh() -> np.ndarray:
        nonlocal seen
        new = np.setdiff1d(np.concatenate(found), seen)
        if len(seen) < 1 << 22:
            seen = np.union1d(seen, new)
        return np.stack(np.divmod(new, most), axis=1)

    for b, s in zip(begin.tolist(), np.diff(np.append(begin, len(at))).tolist(), strict=True):
        a = at[b : b + s]
        t = tree[a]
        if (t == t[0]).all():
            continue
        cut = int(np.searchsorted(side[b : b + s], 1)) if side[b + s - 1] else 0
        # within a side members ascend by size: each meets those behind it, or of the other side, that aren't too large or too small
        x, y = (a[:cut], a[cut:]) if cut else (a, a)
        low = np.searchsorted(n[y], (num * n[x] + den - 1) // den) if cut else np.arange(1, s + 1)
        high = np.searchsorted(n[y], den * n[x] // num, side="right")
        count = np.maximum(high - low, 0)
        left = np.repeat(np.arange(len(x)), count)
        right = np.arange(len(left)) - np.repeat(np.cumsum(count) - count, count) + low[left]
        x, y = x[left], y[right]
        ok = tree[x] != tree[y]
        x, y = x[ok], y[ok]
        found.append(np.minimum(x, y) * most + np.maximum(x, y))
        held += len(x)
        if held > 1 << 20:
            yield fresh()
            tree = np.array([_root(up, v) for v in node.tolist()])
            found, held = [], 0
    if found:
        yield fresh()


def _members(pdf: pd.DataFrame, what: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """(member of each row, first row of each member, node of each member, union-find over nodes): a member is a row's id and `what`, a node its component."""
    member = pdf.groupby(["doc_id", what], sort=False).ngroup().to_numpy()
    first = np.unique(member, return_index=True)[1]
    _, node = np.unique(pdf["component"].to_numpy()[first], return_inverse=True)
    return member, first, node.ravel(), list(range(int(node.max(initial=-1)) + 1))


def _unsure(pdf: pd.DataFrame, num: int, den: int) -> pd.DataFrame:
    """(gid, doc_id, component, n) of what pairs of different components that sizes and parity maps allow connect: a gid for each connected part."""
    member, first, node, up = _members(pdf, "map")
    n, ids = pdf["n"].to_numpy()[first], pdf["doc_id"].to_numpy()[first]
    maps, offset, words = _laid([pdf["map"].iloc[i] for i in first])
    part = list(range(len(first)))
    paired = np.zeros(len(first), dtype=bool)
    for both in _pairs_apart(pdf, member, node, up, n, num, den):
        both = both[plausible(maps, offset, words, n, both[:, 0], both[:, 1], num, den)]
        paired[both] = True
        for x, y in both.tolist():
            part[_root(part, y)] = _root(part, x)
    at = np.flatnonzero(paired)
    gid = np.array([_root(part, x) for x in at.tolist()], dtype=np.int64) + (int(pdf["bucket"].iloc[0]) << 40)
    trim_memory()
    return pd.DataFrame({"gid": gid, "doc_id": ids[at], "component": pdf["component"].to_numpy()[first][at], "n": n[at]})


def _linked(pdf: pd.DataFrame, words: int, num: int, den: int) -> pd.DataFrame:
    """A forest over the components of pairs whose texts' sets meet the threshold."""
    pdf = pdf.assign(text=pdf["text"].fillna(""))
    member, first, node, up = _members(pdf, "text")
    sets = sorted_sets(*shingle_hashes(*word_hashes([text_bytes(pdf["text"].iloc[i]) for i in first]), words))
    n = np.array([len(x) for x in sets], dtype=np.int64)
    maps, offset, wide = _laid([parity_map(x).tobytes() for x in sets])
    kept: list[tuple[int, int]] = []
    for both in _pairs_apart(pdf, member, node, up, n, num, den):
        for x, y in both[plausible(maps, offset, wide, n, both[:, 0], both[:, 1], num, den)].tolist():
            a, b = _root(up, node[x]), _root(up, node[y])
            if a != b:
                common = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                if common and den * common >= num * (len(sets[x]) + len(sets[y]) - common):
                    up[b] = a
                    kept.append((x, y))
    both = pdf["doc_id"].to_numpy()[first][np.array(kept, dtype=np.int64).reshape(-1, 2)]
    trim_memory()
    return pd.DataFrame({"u": both.min(axis=1), "v": both.max(axis=1)})


def _still_open(groups: DataFrame, found: DataFrame) -> DataFrame:
    """(gid, doc_id, component) of the groups that span several components."""
    own = groups.select("gid", "doc_id").join(found, F.col("doc_id") == F.col("id"), "left").select("gid", "doc_id", F.coalesce("component", "doc_id").alias("component"))
    own = materialize(own, "jaccard-groups")
    spans = own.groupBy("gid").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a <> b").select("gid")
    out = materialize(own.join(spans, "gid").distinct(), "jaccard-open")
    forget(own)
    return out


def _blocked(rows: DataFrame, blocks: Column, buckets: int) -> DataFrame:
    """rows(gid, doc_id ...) in the blocks (gid, i, j) of their groups that meet, with side and bucket; `blocks` is an aggregate by gid.

    Groups with the same smallest id, which tend to be much the same, share a few buckets, so that a pair counts once in
    them; a document has so many signatures and no more, which bounds a bucket.
    """
    size = rows.groupBy("gid").agg(F.count(F.lit(1)).alias("m"), F.min("doc_id").alias("lead"), F.pow(F.lit(2), F.ceil(F.log2(F.greatest(blocks, F.lit(1))))).cast("int").alias("blocks"))
    cut = rows.join(size.where("m > 1").drop("m"), "gid")
    cut = cut.withColumn("mine", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cut = cut.withColumn("i", F.least("mine", "other")).withColumn("j", F.greatest("mine", "other")).withColumn("side", F.when(F.col("mine") <= F.col("other"), 0).otherwise(1))
    return cut.withColumn("bucket", F.pmod(F.xxhash64("lead", "blocks", "i", "j", F.pmod("gid", F.lit(SALTS))), F.lit(buckets))).drop("lead", "blocks", "mine", "other")


def _merged(found: DataFrame, links: DataFrame) -> DataFrame:
    """found(id, component) after more links(u, v): their ends' components are joined, and ids that had none come in."""
    ends = links.join(found.select(F.col("id").alias("u"), F.col("component").alias("cu")), "u", "left").join(found.select(F.col("id").alias("v"), F.col("component").alias("cv")), "v", "left")
    new = materialize(components(ends.select(F.coalesce("cu", "u").alias("u"), F.coalesce("cv", "v").alias("v")), "jaccard-star"), "jaccard-new")
    renamed = new.select(F.col("id").alias("component"), F.col("component").alias("least"))
    out = found.join(renamed, "component", "left").select("id", F.coalesce("least", "component").alias("component"))
    out = materialize(out.unionAll(new.join(found.select("id"), "id", "left_anti").select("id", "component")), "jaccard-found")
    forget(new, found)
    return out


def _opened_up(groups: DataFrame, found: DataFrame, sizes: DataFrame, texts: DataFrame, words: int, num: int, den: int, buckets: int) -> DataFrame:
    """found with the links of the groups that span several components."""
    open_ = _still_open(groups, found)
    maps = sizes.where("doc_id is not null")
    placed = _blocked(open_, F.count(F.lit(1)) / BLOCK, 4 * buckets).join(maps, "doc_id")
    rows = materialize(placed.groupBy("bucket").applyInPandas(lambda pdf: _unsure(pdf, num, den), "gid long, doc_id long, component long, n long"), "jaccard-unsure")
    held = rows.agg(F.sum("n")).first()[0]
    if held:
        rows = rows.groupBy("gid", "doc_id", "component").agg(F.max("n").alias("n"))  # an id may stand on several rows
        wanted = materialize(texts.join(rows.select("doc_id").distinct().hint("merge"), "doc_id", "left_semi"), "jaccard-texts")
        placed = _blocked(rows, F.sum("n") * 8 / BLOCK_BYTES, max(buckets, 8 * held // TASK_BYTES)).drop("n").join(wanted, "doc_id")
        more = materialize(placed.groupBy("bucket").applyInPandas(lambda pdf: _linked(pdf, words, num, den), "u long, v long").distinct(), "jaccard-links")
        found = _merged(found, more)
        forget(more, wanted)
    forget(open_)
    return found


def jaccard_components(docs: DataFrame, words: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of docs(doc_id, text); other columns are ignored.

    Words are runs of `[^\\x20\\x09-\\x0D]`, A-Z lower-cased; a text of fewer than `words` words is one shingle; null and
    empty texts have none and link with nothing.  Rows link when intersection * den >= union * num; component_id is the
    smallest doc_id reachable.  Rows that repeat a doc_id come out once each, in one component; a null doc_id links with
    nothing and has a null component.  An empty table gives an empty result.  A text and its set are held whole in a task,
    some 40 bytes for a byte of text.
    """
    spark = docs.sparkSession
    prepare(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    buckets = bucket_count(docs, BUCKET_BYTES)
    signed = keyed(docs).mapInPandas(lambda it: _signed(it, words, num, den, buckets, HEAVY), SCHEMA)
    met = materialize(signed.groupBy("bucket").applyInPandas(_met, SCHEMA), "jaccard-met")
    sizes = _open(met, SIZES)
    texts = docs.where("doc_id is not null")
    verified = _verified(_filtered(_leading(met, buckets), sizes, num, den), texts, words, num, den)
    found = materialize(components(verified.unionAll(_open(met, SAME)), "jaccard-star"), "jaccard-found")
    forget(verified)
    groups = materialize(_open(met, GROUP), "jaccard-groups")
    found = _opened_up(groups, found, sizes, texts, words, num, den, buckets)
    out = sizes.join(found, sizes.doc_id == found.id, "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def one_per_group(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """docs without the rows that link, directly or through others, with one of a smaller doc_id; all columns stay.

    Rows without words and rows with a null doc_id stay.  Rows that repeat one doc_id stay or go together.
    """
    drop = jaccard_components(docs, words, num, den).where("component_id <> doc_id").select(F.col("doc_id").alias("_copy")).distinct()
    return docs.join(drop, docs["doc_id"] == drop["_copy"], "left_anti")


#: Of op 1's query: exact links by shared shingles, and their components.
ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, hash(x) AS h FROM (SELECT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda k: array_to_string(w[k:k+3], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS x FROM d)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS i FROM s a JOIN s b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS MATERIALIZED (SELECT u, v FROM p JOIN n a ON a.doc_id = u JOIN n b ON b.doc_id = v WHERE 100 * i >= 85 * (a.n + b.n - i)),
r(doc_id, reached) AS (SELECT u, v FROM e UNION SELECT r.doc_id, e.v FROM r JOIN e ON e.u = r.reached)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(c.least_id, d.doc_id)) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT doc_id, min(reached) AS least_id FROM r GROUP BY doc_id) c USING (doc_id)
"""
