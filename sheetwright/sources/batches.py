"""Rows of Arrow batches and batches of rows: Python holds a file or a group at most, in few large steps."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterable, Iterator
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame

#: Rows and bytes of texts that a batch made here holds before it is passed on.
ROWS, BYTES = 10_000, 4 << 20
_TYPES = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary()}


def arrow_schema(schema: str) -> pa.Schema:
    """The Arrow schema of a text like `a string, b int`."""
    return pa.schema([(n, _TYPES[t]) for n, t in (c.split() for c in schema.split(", "))])


def values_of(column: pa.Array) -> list:
    """As to_pylist(), by way of numpy where that gives the same values: it makes no Arrow scalar of each."""
    t = column.type
    plain = pa.types.is_string(t) or pa.types.is_boolean(t) or ((pa.types.is_integer(t) or pa.types.is_floating(t)) and not column.null_count)
    return column.to_numpy(zero_copy_only=False).tolist() if plain else column.to_pylist()


def rows_of(batches: Iterable[pa.RecordBatch], step: int = ROWS) -> Iterator[tuple]:
    for b in batches:
        for at in range(0, b.num_rows, step):
            yield from zip(*(c.to_pylist() for c in b.slice(at, step).columns), strict=True)


def batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    """NaN is null, as in pandas."""
    columns = zip(*rows, strict=True) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type, from_pandas=True) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _large(schema: pa.Schema) -> list[int]:
    """The places of texts and bytes."""
    return [i for i, f in enumerate(schema) if f.type in (pa.string(), pa.binary())]


def batches_of(rows: Iterable[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    large = _large(schema)
    held: list[tuple] = []
    size = 0
    for r in rows:
        held.append(r)
        size += sum(len(r[i]) for i in large if r[i])
        if len(held) >= ROWS or size >= BYTES:
            yield batch(held, schema)
            held, size = [], 0
    if held:
        yield batch(held, schema)


def groups_of(batches: Iterable[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    """The slices of each run of equal first columns."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        at = 0
        for key, same in itertools.groupby(b.column(0).to_pylist()):
            n = sum(1 for _ in same)
            if held and key != last:
                yield held
                held = []
            last = key
            held.append(b.slice(at, n))
            at += n
    if held:
        yield held


def made_by_key(df: DataFrame, key: str, order: list[str], make: Callable[[Iterator[tuple]], bytes]) -> DataFrame:
    """(key, content): make() gets the rows behind each key, in that order, one after the other."""
    schema = f"{key} string, content binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grouped = itertools.groupby(rows_of(batches), itemgetter(0))
        return batches_of(((k, make(r[1:] for r in rows)) for k, rows in grouped), arrow_schema(schema))

    return df.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema)


def read_by_file(files: DataFrame, schema: str, readers: dict[str, Callable[[bytes], Iterable[tuple]]], caught: tuple, failed: Callable[[Exception], tuple] | None = None) -> DataFrame:
    """The readers' rows behind each path of files(path, format, content); a file that raises gives failed()'s row alone, or none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return read_batches(rows_of(batches, 16), arrow_schema(schema), readers, caught, failed)

    return files.where(files["format"].isin(*readers)).select("path", "format", "content").mapInArrow(run, schema)


def read_batches(files: Iterable[tuple], form: pa.Schema, readers: dict[str, Callable[[bytes], Iterable[tuple]]], caught: tuple, failed: Callable[[Exception], tuple] | None = None) -> Iterator[pa.RecordBatch]:
    """read_by_file()'s batches of (path, format, content); a batch is passed on by its rows and by the bytes of its texts."""
    large = _large(form)
    done: list[tuple] = []  # rows of files that are read
    held = 0
    for path, kind, raw in files:
        own, packed, size = [], [], 0
        try:
            for x in readers[kind](raw):
                own.append((path, *x))
                size += sum(len(own[-1][i]) for i in large if own[-1][i])
                if len(own) >= ROWS or size >= BYTES:
                    packed.append(batch(own, form))
                    own, size = [], 0
        except caught as e:
            own, packed, size = [(path, *failed(e))] if failed else [], [], 0
        yield from packed
        done += own
        held += size
        if len(done) >= ROWS or held >= BYTES:
            yield batch(done, form)
            done, held = [], 0
    if done:
        yield batch(done, form)
