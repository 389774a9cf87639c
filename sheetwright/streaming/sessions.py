"""Stateful streams over edit and session events, each with its batch counterpart."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BinaryType, DoubleType, LongType, StructField, StructType, TimestampType

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark) -> None:
    """State on disk, as the operators here need it; no batches without data, which processing time would make endless."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")


def session_windows(events: DataFrame, user: str, ts: str, gap: str = "5 minutes", watermark: str | None = None) -> DataFrame:
    """(user, start, end, events): runs of events with gaps under `gap`; with a watermark also on streams."""
    rows = events.withColumn(ts, F.col(ts).cast("timestamp"))
    if watermark:
        rows = rows.withWatermark(ts, watermark)
    return rows.groupBy(F.session_window(ts, gap).alias("w"), user).agg(F.count(F.lit(1)).alias("events")).select(user, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")


def _swept(events: DataFrame, key: str, ts: str, seconds: float, order: list[str], strict: bool) -> DataFrame:
    schema = StructType([*events.schema.fields, StructField("nth", LongType()), StructField("since", DoubleType())])
    rows = events.repartition(key).sortWithinPartitions(key, ts, *order)

    def sweep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, start, n = None, None, 0
        for pdf in batches:
            nth, since = [], []
            keys = [None if pd.isna(k) else k for k in pdf[key]]  # null is a key like any other
            for k, t in zip(keys, pdf[ts], strict=True):
                gone = 0.0 if start is None else (t - start).total_seconds()
                if k != last or start is None or gone > seconds or gone == seconds and not strict:
                    last, start, n, gone = k, t, 0, 0.0
                n += 1
                nth.append(n)
                since.append(gone)
            yield pdf.assign(nth=pd.Series(nth, index=pdf.index, dtype="int64"), since=pd.Series(since, index=pdf.index, dtype="float64"))

    return rows.mapInPandas(sweep, schema)


def anchored_windows(events: DataFrame, key: str, ts: str, seconds: float, order: list[str], strict: bool = False) -> DataFrame:
    """events with `nth`: the place within a window that is anchored at its first event and lasts until one is `seconds` later (strict: more than that).

    Each key's events are swept in order by one task; a key's state is two numbers, so its length doesn't matter.
    """
    return _swept(events, key, ts, seconds, order, strict).drop("since")


def blocked_attempts(events: DataFrame, key: str, ts: str, limit: int, seconds: int, order: list[str]) -> DataFrame:
    """Attempts beyond the limit of their window, with `remaining`: the whole seconds until the window ends."""
    rows = _swept(events, key, ts, seconds, order, True).where(F.col("nth") > limit)
    return rows.withColumn("remaining", seconds - F.floor("since")).drop("nth", "since")


def over_limit(events: DataFrame, key: str, ts: str, limit: int, seconds: float, order: list[str]) -> DataFrame:
    """Events that a limit of so many in an anchored window turns away."""
    return anchored_windows(events, key, ts, seconds, order).where(F.col("nth") > limit).drop("nth")


def stale_editors(events: DataFrame, user: str, ts: str, minutes: int = 5) -> DataFrame:
    """(user, last_seen) of users silent for so long at the newest event's time."""
    last = events.groupBy(user).agg(F.max(ts).alias("last_seen"))
    now = events.agg(F.max(ts).alias("_now"))
    return last.join(F.broadcast(now)).where(F.col("last_seen") < F.col("_now") - F.expr(f"interval {minutes} minutes")).select(user, "last_seen")  # one row


def session_stats(sessions: DataFrame) -> DataFrame:
    """Counts, lengths and active ones of sessions(user, start, end, events)."""
    length = F.unix_timestamp("end") - F.unix_timestamp("start")
    return sessions.agg(F.count(F.lit(1)).alias("sessions"), F.sum("events").alias("events"), F.max(length).alias("longest_s"), F.count_if(F.col("events") > 1).alias("with_several"))


class AnchoredLimit(StatefulProcessor):
    """Lets `limit` events through in each window anchored at its first event; state: its start and count."""

    def __init__(self, ts: str, limit: int, seconds: float) -> None:
        self.ts, self.limit, self.seconds = ts, limit, seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("window", StructType([StructField("start", TimestampType()), StructField("n", LongType())]), ttlDurationMs=max(3_600_000, int(2000 * self.seconds)))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        got = self.state.get() if self.state.exists() else None
        start, n = (got[0], got[1]) if got else (None, 0)
        for pdf in rows:
            pdf = pdf.sort_values(self.ts)
            keep = []
            for t in pdf[self.ts]:
                if start is None or (t - pd.Timestamp(start)).total_seconds() >= self.seconds:
                    start, n = t, 0
                n += 1
                keep.append(n <= self.limit)
            yield pdf[keep]
        if start is not None:
            self.state.update((pd.Timestamp(start).to_pydatetime(), n))

    def close(self) -> None:
        pass


def limited_stream(events: DataFrame, key: str, ts: str, limit: int, seconds: float) -> DataFrame:
    """A stream's events under an anchored limit for each key."""
    use_rocksdb(events.sparkSession)
    return events.groupBy(key).transformWithStateInPandas(AnchoredLimit(ts, limit, seconds), outputStructType=events.schema, outputMode="append", timeMode="ProcessingTime")


class CausalBuffer(StatefulProcessor):
    """Passes each op on once, when what it depends on has passed; others wait for as long as that takes."""

    def __init__(self, schema: StructType) -> None:
        self.schema = schema

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", StructType([StructField("replica", LongType())]), StructType([StructField("lamport", LongType())]))
        self.waiting = handle.getListState("waiting", StructType([StructField("op", BinaryType())]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        import pickle

        pending = [pickle.loads(r[0]) for r in self.waiting.get()]  # noqa: S301  written below
        for pdf in rows:
            pending += pdf.to_dict("records")
        seen: dict[int, int] = {}

        def top(replica: int) -> int:
            if replica not in seen:
                seen[replica] = self.seen.getValue((replica,))[0] if self.seen.containsKey((replica,)) else 0
            return seen[replica]

        passed, progress = [], True
        while progress:
            progress, left = False, []
            for op in sorted(pending, key=lambda o: (o["lamport"], o["replica"])):
                if op["lamport"] <= top(op["replica"]):
                    continue
                deps = dict(op["deps"]) if op["deps"] is not None else {}
                if all(top(int(r)) >= n for r, n in deps.items()):
                    seen[op["replica"]] = op["lamport"]
                    passed.append(op)
                    progress = True
                else:
                    left.append(op)
            pending = left
        for replica, n in seen.items():
            if n:
                self.seen.updateValue((int(replica),), (int(n),))
        self.waiting.put([(pickle.dumps(op),) for op in pending])
        if passed:
            yield pd.DataFrame(passed, columns=self.schema.names)

    def close(self) -> None:
        pass


def causal_stream(ops: DataFrame) -> DataFrame:
    """ops(doc_id, replica, lamport, deps, ...) of a stream in causal order by document, each once."""
    use_rocksdb(ops.sparkSession)
    return ops.groupBy("doc_id").transformWithStateInPandas(CausalBuffer(ops.schema), outputStructType=ops.schema, outputMode="append", timeMode="ProcessingTime")


def flush_batches(stream: DataFrame, write, every: str | None = None, checkpoint: str | None = None):
    """Start a query that hands each batch to write(df, epoch): every so often, or once over what there is."""
    w = stream.writeStream.foreachBatch(write)
    w = w.option("checkpointLocation", checkpoint) if checkpoint else w
    return (w.trigger(processingTime=every) if every else w.trigger(availableNow=True)).start()


def run_hooks(df: DataFrame, before: list, save, after: list):
    """Callbacks around a save: those before transform the table or raise; those after stop at the first error."""
    for f in before:
        df = df.transform(f)
    save(df)
    for f in after:
        f(df)
    return df


