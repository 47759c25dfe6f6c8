"""T2 and T6 with a state per key and timers in event time.

`offer_lifetimes` keeps the open lifetimes of each offer and ends each one `ttl` after its own last
observation; `price_drops` holds observations back until the watermark has passed them and compares
each price with the one before it in event time, so neither the order of arrival nor the cut into
micro-batches changes the result. Rows behind the watermark are dropped by the stream; `late_rows`
(T4) counts them. State is kept in RocksDB: `keyed_store` sets the provider while a query starts."""
from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from datetime import timedelta

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from .. import fixed_values as fv

c = F.col
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
TTL = timedelta(hours=fv.SNAPSHOT_MAX_AGE_HOURS)
LIVE, EXPIRED, MERGED = "live", "expired", "merged"


@contextmanager
def keyed_store(spark: SparkSession):
    """Streams started inside keep their state in RocksDB, which timers need; the session's own
    setting comes back afterwards."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before) if before else spark.conf.unset(_PROVIDER)


def _us(d: timedelta) -> int:
    return d // timedelta(microseconds=1)


def _due(us: int) -> int:
    """The first millisecond of a watermark that has passed `us`."""
    return -(-us // 1000)


def _rank(values) -> tuple:
    return tuple((v is not None, v) for v in values)


# ---- T2 -------------------------------------------------------------------------------------------------
def _combined(keys, values, ttl: int):
    """Rows of an Arrow batch joined to spans of a key whose gaps are below the lifetime, before
    they are shuffled: an offer that sends most rows sends few spans."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            pdf = b.to_pandas()
            pdf["_key"] = pdf.groupby(keys, dropna=False, sort=False).ngroup()
            pdf = pdf.sort_values(["_key", "last_us", *values], na_position="first")
            key, us, order = pdf["_key"].to_numpy(), pdf["last_us"].to_numpy(), pdf.index.to_numpy()
            new = np.append(True, (key[1:] != key[:-1]) | (us[1:] - us[:-1] >= ttl))
            starts = np.flatnonzero(new)
            ends = np.append(starts[1:], len(us)) - 1
            out = b.take(pa.array(order[ends]))
            at = {"first_us": us[starts], "observations": ends - starts + 1}
            yield pa.RecordBatch.from_arrays([pa.array(at[f], pa.int64()) if f in at else out.column(f) for f in b.schema.names], b.schema.names)
    return run


class _Lifetimes(StatefulProcessor):
    """Value state: the open spans (first, last, observations, values) of a key. Timers: the end of
    each."""

    def __init__(self, keys, values, ttl: int, schema: T.StructType):
        self.names, self.values, self.ttl, self.schema = [*keys, "first_us", "last_us", "observations", *values, "state"], values, ttl, schema

    def init(self, handle):
        self.handle, self.open = handle, handle.getValueState("open", self.schema)

    def _spans(self) -> list[tuple]:
        return [tuple(s) for s in self.open.get()[0]] if self.open.exists() else []

    def _row(self, key, span, state):
        return Row(*self.names)(*key, *span, state)

    def handleInputRows(self, key, rows, timerValues):
        spans, born, gone = self._spans(), set(), {}
        before = list(spans)
        for r in rows:
            new = (r["first_us"], r["last_us"], r["observations"], *(r[v] for v in self.values))
            near = [s for s in spans if new[0] < s[1] + self.ttl and s[0] < new[1] + self.ttl]
            for s in near:
                spans.remove(s)
            latest = max([*near, new], key=lambda s: (s[1], _rank(s[3:])))
            spans.append((min(s[0] for s in (*near, new)), latest[1], sum(s[2] for s in (*near, new)), *latest[3:]))
        for s in set(before) - set(spans):
            self.handle.deleteTimer(_due(s[1] + self.ttl))
            gone[s[0]] = s
        for s in spans:
            if s not in before:
                self.handle.registerTimer(_due(s[1] + self.ttl))
                gone.pop(s[0], None)
                born.add(s)
        self.open.update((spans,))
        for s in sorted(gone.values(), key=lambda s: s[0]):
            yield self._row(key, s, MERGED)
        for s in sorted(born, key=lambda s: s[0]):
            yield self._row(key, s, LIVE)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now = expiredTimerInfo.getExpiryTimeInMs()
        spans = self._spans()
        rest = [s for s in spans if _due(s[1] + self.ttl) > now]
        self.open.update((rest,)) if rest else self.open.clear()
        for s in spans:
            if s not in rest:
                yield self._row(key, s, EXPIRED)

    def close(self):
        pass


def offer_lifetimes(observations: DataFrame, keys, value_cols, ttl: timedelta = TTL, delay: timedelta = TTL, ts: str = "ts") -> DataFrame:
    """T2 (update mode): lifetimes of each key. A lifetime takes observations less than `ttl` apart and
    ends `ttl` after its last one. A row is sent when a lifetime changes (state "live", with its
    latest values), when it has ended ("expired"), and when a late row has joined it to an earlier
    one ("merged": it is no lifetime any more). Of equal times the greatest values count as latest."""
    keys, values = list(keys), list(value_cols)
    fields = {f.name: f.dataType for f in observations.schema.fields}
    span = [("first_us", T.LongType()), ("last_us", T.LongType()), ("observations", T.LongType()), *((v, fields[v]) for v in values)]
    schema = T.StructType([T.StructField("spans", T.ArrayType(T.StructType([T.StructField(*f) for f in span])))])
    us = F.unix_micros(c(ts).cast("timestamp"))
    rows = observations.where(c(ts).isNotNull()).select(
        *keys, us.alias("first_us"), us.alias("last_us"), F.lit(1).cast("long").alias("observations"), *values)
    short = rows.mapInArrow(_combined(keys, values, _us(ttl)), rows.schema)
    seen = short.withColumn("last_seen", F.timestamp_micros("last_us")).withWatermark("last_seen", f"{_us(delay)} microseconds")
    out = T.StructType([*[T.StructField(k, fields[k]) for k in keys], *[T.StructField(*f) for f in span], T.StructField("state", T.StringType())])
    return seen.groupBy(*keys).transformWithState(_Lifetimes(keys, values, _us(ttl), schema), out, "update", "eventTime").select(
        *keys, F.timestamp_micros("first_us").alias("first_seen"), F.timestamp_micros("last_us").alias("last_seen"), "observations", *values,
        F.timestamp_micros(c("last_us") + _us(ttl)).alias("expires_at"), "state")


def newest_lifetimes(table: DataFrame, keys) -> DataFrame:
    """Every lifetime of a table of `offer_lifetimes`, in its newest version, with state live or
    expired."""
    rest = [x for x in table.columns if x not in (*keys, "first_seen", "batch_id")]
    order = F.struct("batch_id", c("state") != LIVE)
    newest = table.groupBy(*keys, "first_seen").agg(F.max_by(F.struct(*rest), order).alias("r")).select(*keys, "first_seen", "r.*")
    return newest.where(c("state") != MERGED)


# ---- T6 -------------------------------------------------------------------------------------------------
class _Drops(StatefulProcessor):
    """Value state: the last price in event time and the lowest one. List state: observations that
    the watermark has not passed. One timer: the earliest of them."""

    def __init__(self, keys):
        self.names = [*keys, "us", "previous_price", "price", "lowest"]

    def init(self, handle):
        self.handle = handle
        self.last = handle.getValueState("last", "price double, lowest double")
        self.due = handle.getValueState("due", "ms long")
        self.pending = handle.getListState("pending", "us long, price double")

    def _wake(self, us: int):
        ms = _due(us)
        if self.due.exists():
            if self.due.get()[0] <= ms:
                return
            self.handle.deleteTimer(self.due.get()[0])
        self.handle.registerTimer(ms)
        self.due.update((ms,))

    def handleInputRows(self, key, rows, timerValues):
        rows = [(r["us"], r["price"]) for r in rows]
        self.pending.appendList(rows)
        self._wake(min(us for us, _ in rows))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()) * 1000
        rows = sorted(tuple(r) for r in self.pending.get())
        passed, rest = [r for r in rows if r[0] <= now], [r for r in rows if r[0] > now]
        self.pending.put(rest) if rest else self.pending.clear()
        self.due.clear()
        if rest:
            self._wake(rest[0][0])
        previous, lowest = self.last.get() if self.last.exists() else (None, None)
        out = []
        for us, price in passed:
            lowest = price if lowest is None else min(lowest, price)
            if previous is not None and price < previous:
                out.append(Row(*self.names)(*key, us, previous, price, lowest))
            previous = price
        if passed:
            self.last.update((previous, lowest))
        yield from out

    def close(self):
        pass


def price_drops(observations: DataFrame, keys, delay: timedelta = TTL, ts: str = "ts", price: str = "price") -> DataFrame:
    """T6 (update mode): one row per price that is below the price before it in event time, whatever
    lies between them: keys, ts, previous_price, price and the lowest price so far. Rows are
    judged once the watermark has passed them; of equal times the lower price comes first. Rows
    without a price or time say nothing."""
    keys = list(keys)
    fields = {f.name: f.dataType for f in observations.schema.fields}
    rows = observations.where(c(ts).isNotNull() & c(price).isNotNull()).select(
        *keys, c(ts).cast("timestamp").alias("seen"), F.unix_micros(c(ts).cast("timestamp")).alias("us"), c(price).cast("double").alias("price"))
    out = T.StructType([*[T.StructField(k, fields[k]) for k in keys], T.StructField("us", T.LongType()),
                        *[T.StructField(n, T.DoubleType()) for n in ("previous_price", "price", "lowest")]])
    return rows.withWatermark("seen", f"{_us(delay)} microseconds").groupBy(*keys).transformWithState(_Drops(keys), out, "update", "eventTime").select(
        *keys, F.timestamp_micros("us").alias("ts"), "previous_price", "price", "lowest")
