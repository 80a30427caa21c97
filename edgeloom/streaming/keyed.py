"""Keyed stream state: a step function folded over each key's events in event-time order.

Events wait in a list state until the watermark has passed their time, so micro-batches may come in any order within the
allowed delay and the fold still gives the rows of the batch operators. An expiry function adds rows that no input event
produced: when the watermark passes the moment it names, the fold is told, and a key without anything left is cleared.
The rows held for a key are those of the last ``delay`` of event time. Keys are dealt to buckets by their hash, and a
bucket is one group of the state store.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

import edgeloom.streaming
from edgeloom.session import Scratch

# The processors travel inside the job, so workers need not have this package installed.
cloudpickle.register_pickle_by_value(edgeloom.streaming)

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DELAY = "1 hour"
BUCKETS = 256


class OrderedFold(StatefulProcessor):
    """Applies ``step(state, row) -> (state, output tuple)`` to the rows of a key in the order of (ms, order columns).

    A call serves a bucket of keys: the rows that wait are one pickled list a batch, the states of all keys one pickled
    dict. Calls of the state store then grow with the buckets that a batch touches, not with the keys.

    ``due(state)`` is the moment in ms at which the state expires, None for never; ``expire(state, ms, key) -> (state,
    output tuple)`` is applied then, before any row of that moment or later. A None state clears the key; a None output
    is no row.
    """

    def __init__(self, step: Callable, initial: tuple, keys: list[str], columns: list[str], kinds: list[str], order: list[str], output: list[str], due: Callable | None, expire: Callable | None):
        self.step, self.initial, self.columns, self.kinds = step, initial, columns, kinds
        self.output, self.due, self.expire = output, due, expire
        self.ms = columns.index("ms")
        self.key = [columns.index(c) for c in keys]
        self.places = [self.ms] + [columns.index(c) for c in order]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.states = handle.getValueState("states", "states binary")
        self.waiting = handle.getListState("waiting", "rows binary")

    def _plain(self, frame: pd.DataFrame) -> list[tuple]:
        """Rows as plain values: pandas turns whole numbers beside nulls into floats."""
        lists = []
        for c, kind in zip(self.columns, self.kinds):
            plain = int if kind in ("bigint", "int") else lambda v: v
            lists.append([None if null else plain(v) for v, null in zip(frame[c].tolist(), frame[c].isna())])
        return list(zip(*lists))

    def _wake(self, ms: int) -> None:
        armed = list(self.handle.listTimers())
        if armed and min(armed) <= ms:
            return
        for t in armed:
            self.handle.deleteTimer(t)
        self.handle.registerTimer(ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for frame in rows:
            if len(frame):
                self.waiting.appendValue((pickle.dumps(self._plain(frame)),))
                low = int(frame["ms"].min())
                first = low if first is None else min(first, low)
        if first is not None:
            self._wake(first)
        yield pd.DataFrame([], columns=self.output)

    def _lapse(self, state, at: int, key: tuple, out: list[tuple]):
        while self.due is not None and state is not None and (due := self.due(state)) is not None and due <= at:
            state, told = self.expire(state, due, key)
            if told is not None:
                out.append(told)
        return state

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = int(timerValues.getCurrentWatermarkInMs())
        held = [r for chunk in self.waiting.get() for r in pickle.loads(chunk[0])] if self.waiting.exists() else []
        ready = sorted((r for r in held if r[self.ms] <= until), key=lambda r: tuple((r[i] is not None, r[i]) for i in self.places))
        later = [r for r in held if r[self.ms] > until]
        states = pickle.loads(self.states.get()[0]) if self.states.exists() else {}
        out: list[tuple] = []
        for values in ready:
            own = tuple(values[i] for i in self.key)
            state = self._lapse(states.get(own, self.initial), values[self.ms], own, out)
            states[own], told = self.step(self.initial if state is None else state, _Named(self.columns, values))
            if told is not None:
                out.append(told)
        moments = [r[self.ms] for r in later]
        for own in list(states):
            state = states[own] = self._lapse(states[own], until, own, out)
            if state is None:
                del states[own]
            elif self.due is not None and (due := self.due(state)) is not None:
                moments.append(due)
        if later:
            self.waiting.put([(pickle.dumps(later),)])
        else:
            self.waiting.clear()
        if states:
            self.states.update((pickle.dumps(states),))
        else:
            self.states.clear()
        for t in list(self.handle.listTimers()):
            if t != int(expiredTimerInfo.getExpiryTimeInMs()):
                self.handle.deleteTimer(t)
        if moments:
            self.handle.registerTimer(min(moments))
        yield pd.DataFrame(out, columns=self.output, dtype=object)

    def close(self) -> None:
        pass


class _Named:
    """One row's values by column name."""

    def __init__(self, names, values):
        self.__dict__.update(zip(names, values))


def fold(
    events: DataFrame, keys: list[str], step: Callable, initial: tuple, output: str, order: tuple[str, ...] = ("seq",),
    time: str = "ts", delay: str = DELAY, due: Callable | None = None, expire: Callable | None = None, buckets: int = BUCKETS,
) -> DataFrame:
    """Stateful stream of the ``step`` outputs; ``output`` is a DDL schema, states are tuples of plain values.

    ``time`` is the event time. Rows later than ``delay`` behind the latest are dropped by Spark; :func:`split_late`
    keeps them in a table of their own. Rows of a moment follow the ``order`` columns. Rows without a time or with null
    keys only move the watermark. The session must use the RocksDB state store (:func:`with_state_store`).

    A task holds the waiting rows and the states of one bucket at a time, so choose ``buckets`` such that a bucket has
    some ten thousand rows within the delay; a stream keeps its number for life.
    """
    rest = [c for c in events.columns if c not in (*keys, time)]
    named = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay)
    # A filter that names the time stays behind the watermark, so rows without a key move it before they go.
    keyed = F.lit(True)
    for k in keys:
        keyed = keyed & F.col(k).isNotNull()
    rows = named.where(F.when(keyed, F.col(time)).isNotNull()).select(*keys, time, *rest, F.unix_millis(time).alias("ms"))
    rows = rows.withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)))
    columns = [c for c in rows.columns if c not in (time, "_bucket")]
    kinds = [rows.schema[c].dataType.simpleString() for c in columns]
    names = [c.split()[0] for c in output.split(", ")]
    processor = OrderedFold(step, initial, keys, columns, kinds, list(order), names, due, expire)
    return rows.groupBy("_bucket").transformWithStateInPandas(statefulProcessor=processor, outputStructType=output, outputMode="append", timeMode="eventTime")


def with_state_store(spark: SparkSession) -> SparkSession:
    """Chooses the state store that list state and timers need, for the whole session."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    return spark


def run_to_table(stream: DataFrame, label: str) -> DataFrame:
    """Process everything available and return the written output."""
    spark = with_state_store(stream.sparkSession)
    scratch = Scratch(spark, label)
    stream.writeStream.format("parquet").option("checkpointLocation", f"{scratch.root}/checkpoint").option("path", f"{scratch.root}/out").trigger(
        availableNow=True
    ).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{scratch.root}/out")


def split_late(stream: DataFrame, time: str, delay_s: int, folder: str) -> None:
    """Writes all available rows of a stream to ``folder``/accepted or ``folder``/late, each row once.

    A row is late when its time is at or before the latest time of all earlier micro-batches less ``delay_s`` seconds,
    which is when a watermark of this delay drops it. Rows without a time are accepted. Each batch replaces its own
    partition and notes its latest time under its number, so a batch that is run again after a failure leaves the same files.
    """
    spark = stream.sparkSession
    marks = "batch long, latest timestamp"

    def write(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        path = f"{folder}/marks"
        known = session.createDataFrame([], marks)
        if number:
            known = session.read.schema(marks).parquet(path).where(F.col("batch") < number)
        edge = known.agg((F.max("latest") - F.make_dt_interval(secs=F.lit(delay_s))).alias("edge")).first()["edge"]
        late = F.coalesce(F.col(time) <= F.lit(edge).cast("timestamp"), F.lit(False)) if edge is not None else F.lit(False)
        kept = batch.persist()  # read three times; recomputed from the source where an executor is lost
        kept.where(~late).write.mode("overwrite").parquet(f"{folder}/accepted/batch={number}")
        kept.where(late).write.mode("overwrite").parquet(f"{folder}/late/batch={number}")
        kept.agg(F.lit(number).cast("long").alias("batch"), F.max(time).alias("latest")).write.mode("overwrite").parquet(f"{path}/part={number}")
        kept.unpersist()

    stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
