"""What the operators share: shared-folder tables, word hashing in numpy, components of a link table."""

from __future__ import annotations

import contextlib
import ctypes
import os
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Text bytes that a Python task holds at a time, give or take one document.
CHUNK_BYTES = 4 << 20
_U = np.uint64
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def prepare(spark: SparkSession) -> None:
    """Small Arrow batches, so that a batch of long texts stays small; workers find this package where the driver did."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])


def partitions(spark: SparkSession) -> int:
    """The shuffle width of the session."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def plan_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of df's size in bytes; 0 where it has none."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 60 else 0


def bucket_count(df: DataFrame, each: int) -> int:
    """Buckets of about `each` bytes of df, at least two for each task of a shuffle."""
    return max(2 * partitions(df.sparkSession), -(-plan_bytes(df) // each))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a local one only where that is unset and all runs in one process."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not (spark.sparkContext.master + "[").startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="sheetwright-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/sheetwright-{spark.sparkContext.applicationId}"


def drop_tables(spark: SparkSession) -> None:
    """Delete all tables that this application wrote to the shared folder; results that read them must have been used."""
    _delete(spark, _own_dir(spark))


def _delete(spark: SparkSession, path: str) -> None:
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(jpath, True)


#: Paths of the tables that materialize() wrote, in order.
_written: list[str] = []


@contextlib.contextmanager
def swept(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """Tables that are written within go at the end, but for those put in the list."""
    begin = len(_written)
    keep: list[DataFrame] = []
    yield keep
    kept = {getattr(df, "_sheetwright_path", None) for df in keep}
    for path in _written[begin:]:
        if path not in kept:
            _delete(spark, path)
    _written[begin:] = [p for p in _written[begin:] if p in kept]


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Queries that end within leave no shuffle files: their result is a table, and nothing else reads these."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and return the table: lineage ends here, and lost executors cost no recomputation."""
    spark = df.sparkSession
    path = f"{_own_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with shuffles_dropped(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._sheetwright_path = path
    _written.append(path)
    return out


def forget(*tables: DataFrame) -> None:
    """Delete tables that materialize() wrote and that nothing lazy reads any more."""
    for df in tables:
        path = getattr(df, "_sheetwright_path", None)
        if path:
            _delete(df.sparkSession, path)


#: Rows of a few numbers each that may be broadcast.
FEW = 1_000_000


def few(df: DataFrame) -> DataFrame:
    """df marked for broadcasting if it has at most FEW rows, else as it is; df must be cheap to count."""
    return F.broadcast(df) if df.count() <= FEW else df


def bounded_sample(docs: DataFrame, labelled: DataFrame, rows: int, size: int) -> DataFrame:
    """(doc_id, text, y): labelled rows of docs, at most `rows` and `size` bytes of whole texts, in the order of the hash of doc_id.

    Of repeated labels of an id the larger counts, of repeated rows of an id the text that is smallest as a string.
    """
    labels = labelled.where("doc_id is not null and y is not null").groupBy("doc_id").agg(F.max("y").alias("y"))
    some = labels.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    # the sample has at most `rows` rows of two numbers, so it may be broadcast
    each = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(some), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    each = materialize(each.withColumn("size", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")), "labelled-texts")
    order = Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0)  # over at most `rows` rows of two numbers
    fit = each.select("doc_id", "size").withColumn("held", F.sum("size").over(order)).where(F.col("held") <= size).select("doc_id")
    return each.drop("size").join(F.broadcast(fit), "doc_id")


def keyed(docs: DataFrame, *others: Column) -> DataFrame:
    """(doc_id, no_id, text, others ...): null ids as 0 with a flag, since pandas would turn a column with nulls to floating point and blur large ids."""
    own = F.col("doc_id").cast("long")
    return docs.select(F.coalesce(own, F.lit(0).cast("long")).alias("doc_id"), own.isNull().alias("no_id"), F.col("text").cast("string").alias("text"), *others)


def unkeyed(df: DataFrame) -> DataFrame:
    """df without no_id, ids null where it is set."""
    return df.withColumn("doc_id", F.when(~F.col("no_id"), F.col("doc_id"))).drop("no_id")


def text_bytes(text: str | None) -> bytes:
    """UTF-8; lone surrogates, which no valid text has, become question marks."""
    return text.encode("utf-8", "replace") if isinstance(text, str) else b""


def chunks(batches: Iterator, limit: int = CHUNK_BYTES) -> Iterator[tuple[list, list[bytes]]]:
    """(ids, texts as bytes) of about `limit` bytes of text each, from pandas batches of keyed(); a null id is None."""
    ids: list = []
    texts: list[bytes] = []
    size = 0
    for pdf in batches:
        for i, none, t in zip(pdf["doc_id"].tolist(), pdf["no_id"].tolist(), pdf["text"].tolist(), strict=True):
            b = text_bytes(t)
            ids.append(None if none else i)
            texts.append(b)
            size += len(b) + 64
            if size >= limit:
                yield ids, texts
                ids, texts, size = [], [], 0
                trim_memory()
    if ids:
        yield ids, texts
    trim_memory()


def trim_memory() -> None:
    """Hand freed heap pages back: glibc keeps them for blocks of these sizes, and idle workers would hold their peak."""
    if _trim is not None:
        _trim(0)


def pieces(texts: list[bytes], limit: int = 1 << 20) -> Iterator[list[bytes]]:
    """The texts in order, in lists of about `limit` bytes."""
    some: list[bytes] = []
    size = 0
    for t in texts:
        some.append(t)
        size += len(t) + 64
        if size >= limit:
            yield some
            some, size = [], 0
    if some:
        yield some


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on unsigned 64-bit integers."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_powers = np.ones(1, dtype=np.uint64)


def _power_table(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        grown = np.full(max(n, 64), _BASE, dtype=np.uint64)
        grown[0] = 1
        _powers = np.multiply.accumulate(grown)
    return _powers


#: Bytes of text that are looked at at a time; a longer text is cut at white space.
SEGMENT = 4 << 20
_blank = re.compile(rb"[\x20\x09-\x0D]")


def segments(text: bytes, limit: int = SEGMENT, at: re.Pattern = _blank) -> list[bytes]:
    """The text cut where `at` matches, before white space, into parts of about `limit` bytes, more where it matches nowhere."""
    out, last = [], 0
    while len(text) - last > limit:
        cut = at.search(text, last + limit)
        if not cut:
            break
        out.append(text[last : cut.start()])
        last = cut.start()
    return [*out, text[last:]] if last else [text]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word of all texts in order, word counts by text): a word is a run of bytes other than 0x20 and 0x09-0x0D, A-Z lower-cased."""
    if sum(map(len, texts)) <= 2 * SEGMENT:
        return _word_hashes(texts)
    cut = [segments(t) for t in texts]
    found = [_word_hashes(some) for some in pieces([x for c in cut for x in c], SEGMENT)]
    owner = np.repeat(np.arange(len(texts)), [len(c) for c in cut])
    counts = np.concatenate([n for _, n in found])
    return np.concatenate([h for h, _ in found]), np.bincount(owner, weights=counts, minlength=len(texts)).astype(np.int64)


def _word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    lens = np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts))
    data = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
    low = _LOWER[data]
    inside = ~_SPACE[low]
    ends_of = np.cumsum(lens + 1) - 1
    inside[ends_of[ends_of < len(inside)]] = False
    at = np.flatnonzero(inside)
    if not len(at):
        return np.zeros(0, dtype=np.uint64), np.zeros(len(texts), dtype=np.int64)
    first = np.empty(len(at), dtype=bool)
    first[0] = True
    np.not_equal(at[1:], at[:-1] + 1, out=first[1:])
    begin = np.flatnonzero(first)
    size = np.diff(np.append(begin, len(at)))
    offset = np.arange(len(at), dtype=np.int64) - np.repeat(begin, size)
    value = (low[at].astype(np.uint64) + _U(1)) * _power_table(int(size.max()))[offset]
    h = mix(np.add.reduceat(value, begin) + size.astype(np.uint64) * _U(0xD6E8FEB86659FD93))
    which = np.searchsorted(ends_of, at[begin], side="left")
    return h, np.bincount(which, minlength=len(texts)).astype(np.int64)


def shingle_hashes(words: np.ndarray, counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every n-word shingle in text order, shingle counts by text); a text of 1 to n-1 words has itself as its one shingle."""
    per = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    begin = np.cumsum(counts) - counts
    total = int(per.sum())
    if not total:
        return np.zeros(0, dtype=np.uint64), per
    start = np.repeat(begin, per) + (np.arange(total) - np.repeat(np.cumsum(per) - per, per))
    size = np.repeat(np.minimum(counts, n), per)
    h = size.astype(np.uint64) * _U(0xA0761D6478BD642F)
    for k in range(n):
        part = words[np.minimum(start + k, len(words) - 1)]
        h = np.where(size > k, mix(h * _U(0xE7037ED1A0B428DB | 1) + part), h)
    return h, per


def sorted_sets(h: np.ndarray, per: np.ndarray) -> list[np.ndarray]:
    """The distinct values of each text's hashes, ascending."""
    out, at = [], 0
    for n in per.tolist():
        out.append(np.unique(h[at : at + n]))
        at += n
    return out


def components(links: DataFrame, name: str = "links") -> DataFrame:
    """(id, component): the smallest id reachable, for every id that has a link.  `links` has columns u, v.

    Alternating large-star and small-star rounds (Kiveris et al. 2014); each round's links are a table in the
    shared folder, and nothing but two sums reaches the driver.  Null ends and loops are no links.
    """

    def stats(df: DataFrame) -> tuple:
        row = df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        return row[0], row[1]

    def both(df: DataFrame) -> DataFrame:
        return df.unionAll(df.select(F.col("v").alias("u"), F.col("u").alias("v")))

    # The least neighbours are a table of their own: both sides of the join then come from scans, and Spark may split
    # the partition of a hub with very many links, which it can't behind an aggregate.
    def large(df: DataFrame) -> DataFrame:
        sym = both(df)
        least = materialize(sym.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), name)
        out = materialize(sym.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), name)
        forget(least)
        return out

    def small(df: DataFrame) -> DataFrame:
        """Links already lead from the larger end to the smaller one."""
        least = materialize(df.groupBy("u").agg(F.min("v").alias("m")), name)
        moved = df.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        moved = moved.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        out = materialize(moved.unionAll(least.select("u", F.col("m").alias("v"))).distinct(), name)
        forget(least)
        return out

    edges = links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = materialize(edges, name)
    before = stats(edges)
    while before[0]:
        wide = large(edges)
        after = small(wide)
        now = stats(after)
        forget(edges, wide)
        edges = after
        if now == before:
            break
        before = now
    # now every edge leads from an id to the root of its star
    roots = edges.select(F.col("v").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionAll(roots)
