"""T8 as incremental state: trailing-hour network metrics of a live ledger.

Ledgers, transactions and operations form one stream of events. Events are
spread over ``buckets`` keys (transactions by account, operations by hash, a
ledger close to every bucket) and each bucket keeps, in keyed state:

* the sums of its events by exact time and account, in blocks of up to
  ``BLOCK_ROWS`` rows by time (Arrow); a micro-batch adds blocks and rewrites
  none, so it costs a state access a block, not one an event or a minute;
* the closes that wait for the watermark, in blocks of the same kind.

An event-time timer fires when the watermark passes a waiting close: all its
events are in, the bucket's part of the metrics is worked out from the blocks
it spans and emitted, and blocks more than an hour behind the watermark are
dropped. Small blocks, as short micro-batches leave them, are merged once
``MANY_BLOCKS`` lie in a bucket. State therefore holds an hour plus the allowed
lateness, whatever the length of the stream, and stored history is never read
again. Closes are worked off a block at a time: a task holds one block of them
with the events it spans. The parts of a ledger leave all buckets in the same
micro-batch; they are summed there, kept while the sink reads them more than
once (else the state would be worked through again), and appended idempotently
(S7).

An account's events meet in one bucket; each Arrow batch is summed by bucket,
exact time and account before the shuffle, so an account with a third of all
transactions sends a row for each time, not for each transaction.

Events behind the watermark are dropped by Spark: the result equals W1 as long
as no event comes later than ``lateness`` behind the newest one. A ledger is
emitted when the watermark passes it, so the last ``lateness`` of a stopped
stream stays in state. Rows without a time are left out; transactions without
an account count but are no account.
"""

from __future__ import annotations

import decimal
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ledgerlake.functions import scalar as E
from ledgerlake.operators.common import from_micros, micros
from ledgerlake.operators.windows import HOUR_US, hour_metrics
from ledgerlake.sources import sinks

#: Rows of a block of state, and of a micro-batch that a bucket gathers at once.
BLOCK_ROWS, GATHER_ROWS = 8192, 500_000
#: Blocks of a bucket beyond which its small ones are merged.
MANY_BLOCKS = 64
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
SHUFFLE_PARTITIONS = "spark.sql.shuffle.partitions"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

EVENTS = ("bucket int, kind string, t long, account string, sequence long, n long, ok long, fee long, "
          "vol decimal(38,0)")
#: Signed 32-bit digits of ``vol``: 64-bit sums of them are exact.
DIGITS = ("v0", "v1", "v2", "v3")
SUMMED = EVENTS.replace("vol decimal(38,0)", ", ".join(f"{c} long" for c in DIGITS))
PARTS = "sequence long, t long, c_tx long, c_ok long, c_fee long, c_op long, c_vol string, c_acct long"


def hour_events(led: DataFrame, tx: DataFrame, op: DataFrame, buckets: int = 64) -> DataFrame:
    """Events of the three tables or streams in one schema; amounts in units
    of 1e-7."""
    amount = F.coalesce(E.json_decimal(F.col("details"), "amount"), F.lit(0)) * 10_000_000
    null = F.lit(None)

    def row(df, bucket, kind, t, account, sequence, ok, fee, vol):
        return df.select(
            bucket.cast("int").alias("bucket"), F.lit(kind).alias("kind"), t.alias("t"),
            account.cast("string").alias("account"), sequence.cast("long").alias("sequence"),
            F.lit(1).cast("long").alias("n"), ok.cast("long").alias("ok"), fee.cast("long").alias("fee"),
            vol.cast("decimal(38,0)").alias("vol"))

    zero = F.lit(0)
    txs = row(tx, F.pmod(F.xxhash64("source_account"), F.lit(buckets)), "tx", micros("created_at"),
              F.col("source_account"), null, F.when(F.col("successful"), 1).otherwise(0),
              F.coalesce(F.col("fee_charged"), zero), zero)
    ops = row(op, F.pmod(F.xxhash64("id", "created_at"), F.lit(buckets)), "op", micros("created_at"), null, null,
              zero, zero, F.when(F.col("type") == "payment", amount).otherwise(zero))
    closes = led.withColumn("_bucket", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))))
    closes = row(closes, F.col("_bucket"), "close", micros("closed_at"), null, F.col("sequence"), zero, zero, zero)
    return txs.unionByName(ops).unionByName(closes).where(F.col("t").isNotNull())


def _digits(vol: pa.Array) -> list[np.ndarray]:
    """Decimals of 128 bits as four digits to base 2**32; the sign is with the
    highest."""
    vol = pc.fill_null(vol.cast(pa.decimal128(38, 0)), 0)
    words = np.frombuffer(vol.buffers()[1], "<u4").reshape(-1, 4)[vol.offset:vol.offset + len(vol)]
    return [words[:, i].astype(np.int64) for i in range(3)] + [words[:, 3].view("<i4").astype(np.int64)]


def _grouped(rows: pa.Table, keys: list[str], sums: list[str]) -> pa.Table:
    out = rows.group_by(keys).aggregate([(c, "sum") for c in sums])
    return out.select(keys + [f"{c}_sum" for c in sums]).rename_columns(keys + sums)


def _summed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Events of equal bucket, kind, time, account and ledger as one row."""
    keys, sums = ["bucket", "kind", "t", "account", "sequence"], ["n", "ok", "fee", *DIGITS]
    for batch in batches:
        rows = pa.Table.from_batches([batch.drop_columns(["vol"])])
        for name, column in zip(DIGITS, _digits(batch.column("vol"))):
            rows = rows.append_column(name, pa.array(column))
        yield from _grouped(rows, keys, sums).combine_chunks().to_batches()


def _window_sums(times: np.ndarray, columns: list[np.ndarray], at: np.ndarray, window_us: int) -> list[np.ndarray]:
    """Sums of the columns (rows by time) inside each close's interval."""
    i, j = np.searchsorted(times, at - window_us, side="left"), np.searchsorted(times, at, side="right")
    upto = [np.concatenate([[0], np.cumsum(c, dtype=np.int64)]) for c in columns]
    return [u[j] - u[i] for u in upto]


def _active(accounts: np.ndarray, times: np.ndarray, at: np.ndarray, window_us: int) -> np.ndarray:
    """Accounts (as numbers) with an event inside each close's interval: spans
    that have begun less those that have ended."""
    order = np.lexsort((times, accounts))
    accounts, times = accounts[order], times[order]
    # between neighbours of one account without a gap above the window a span goes on
    on = (accounts[1:] == accounts[:-1]) & (np.diff(times) <= window_us)
    edge = np.ones(min(1, len(times)), bool)
    starts, ends = times[np.concatenate([edge, ~on])], times[np.concatenate([~on, edge])] + window_us
    return (np.searchsorted(np.sort(starts), at, side="right") - np.searchsorted(np.sort(ends), at, side="left"))


def _parts(rows: pa.Table, closes: list[tuple[int, int]], window_us: int) -> list[tuple]:
    """:func:`parts_of` from rows of state, in any order."""
    at = np.array([t for _, t in closes], np.int64)
    rows = rows.sort_by("t")

    def arrays(of: pa.Table, names: list[str]) -> list[np.ndarray]:
        return [of.column(c).to_numpy() for c in names]
    is_tx = pc.equal(rows.column("kind"), "tx")
    tx, op = rows.filter(is_tx), rows.filter(pc.invert(is_tx))
    n_tx, n_ok, fee = _window_sums(*arrays(tx, ["t"]), arrays(tx, ["n", "ok", "fee"]), at, window_us)
    n_op, *digits = _window_sums(*arrays(op, ["t"]), arrays(op, ["n", *DIGITS]), at, window_us)
    known = tx.filter(pc.is_valid(tx.column("account")))
    names = known.column("account").combine_chunks().dictionary_encode()
    active = _active(names.indices.to_numpy(), *arrays(known, ["t"]), at, window_us)
    columns = [x.tolist() for x in (n_tx, n_ok, fee, n_op, active, *digits)]
    return [(s, t, a, b, c, d, str(v0 + (v1 << 32) + (v2 << 64) + (v3 << 96)), n)
            for (s, t), a, b, c, d, n, v0, v1, v2, v3 in zip(closes, *columns)]


ROW = pa.schema([("kind", pa.string()), ("t", pa.int64()), ("account", pa.string()), ("n", pa.int64()),
                 ("ok", pa.int64()), ("fee", pa.int64()), *[(c, pa.int64()) for c in DIGITS]])
CLOSE = pa.schema([("sequence", pa.int64()), ("t", pa.int64())])


def parts_of(tx: list, op: list, closes: list, window_us: int = HOUR_US) -> list[tuple]:
    """A bucket's part of the metrics of ``closes`` [(sequence, t)] over the
    closed intervals [t - window, t], from ``tx`` [(t, account, n, ok, fee)]
    and ``op`` [(t, n, volume)] that cover all of them."""
    vol = _digits(pa.array([decimal.Decimal(v) for _, _, v in op], pa.decimal128(38, 0)))
    none = [0] * len(tx)
    rows = pa.table([
        ["tx"] * len(tx) + ["op"] * len(op), [e[0] for e in tx] + [e[0] for e in op],
        [e[1] for e in tx] + [None] * len(op), [e[2] for e in tx] + [e[1] for e in op],
        [e[3] for e in tx] + [0] * len(op), [e[4] for e in tx] + [0] * len(op),
        *[none + v.tolist() for v in vol]], names=ROW.names).cast(ROW)
    return _parts(rows, closes, window_us)


def _packed(rows: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as writer:
        writer.write_table(rows)
    return sink.getvalue().to_pybytes()


def _unpacked(raw: bytes) -> pa.Table:
    return pa.ipc.open_stream(pa.py_buffer(bytes(raw))).read_all()


class Blocks:
    """Rows of a bucket in state, in blocks by time: a map from (first time,
    last time, number) to the rows."""

    def __init__(self, handle: StatefulProcessorHandle, name: str):
        self.state = handle.getMapState(name, "first long, last long, number long, n long", "rows binary")

    def keys(self) -> list[tuple]:
        return sorted(tuple(int(x) for x in k) for k in self.state.keys())

    def add(self, rows: pa.Table) -> None:
        rows = rows.sort_by("t").combine_chunks()
        number = max((k[2] for k in self.keys()), default=-1) + 1
        for at in range(0, rows.num_rows, BLOCK_ROWS):
            block = rows.slice(at, BLOCK_ROWS)
            t = block.column("t")
            self.state.updateValue((t[0].as_py(), t[-1].as_py(), number, block.num_rows), (_packed(block),))
            number += 1

    def get(self, key: tuple) -> pa.Table:
        return _unpacked(self.state.getValue(key)[0])

    def remove(self, key: tuple) -> None:
        self.state.removeKey(key)

    def tidy(self) -> None:
        """Merge the small blocks of a bucket that has many."""
        keys = self.keys()
        small = [k for k in keys if k[3] < BLOCK_ROWS]
        if len(keys) <= MANY_BLOCKS or len(small) < MANY_BLOCKS // 2:
            return
        rows = pa.concat_tables([self.get(k) for k in small])
        self.add(rows)
        for k in small:
            self.remove(k)


class HourState(StatefulProcessor):
    """State of one bucket; see the module's docstring."""

    def __init__(self, window_us: int = HOUR_US):
        self.window_us = window_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.events = Blocks(handle, "events")
        self.closes = Blocks(handle, "closes")

    def _wake(self, t: int) -> None:
        self.handle.registerTimer(-(-t // 1000))            # the first millisecond not before t

    def _take(self, rows: pa.Table) -> None:
        is_close = pc.equal(rows.column("kind"), "close")
        closes = rows.filter(is_close).select(CLOSE.names)
        events = rows.filter(pc.invert(is_close)).select(ROW.names)
        if closes.num_rows:
            # a ledger that comes again while it waits has its new time
            for block in self.closes.keys():
                held = self.closes.get(block)
                rest = held.filter(pc.invert(pc.is_in(held.column("sequence"), closes.column("sequence"))))
                if rest.num_rows < held.num_rows:
                    self.closes.remove(block)
                    self.closes.add(rest)
            self.closes.add(closes.group_by("sequence").aggregate([("t", "max")])
                            .select(["sequence", "t_max"]).rename_columns(CLOSE.names).cast(CLOSE))
            self._wake(pc.min(closes.column("t")).as_py())
        if events.num_rows:
            self.events.add(_grouped(events, ["kind", "t", "account"], ["n", "ok", "fee", *DIGITS]).cast(ROW))
            # blocks go even where no ledger closes
            self._wake(pc.max(events.column("t")).as_py() + self.window_us + 1)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        schema = pa.schema([*ROW, CLOSE.field("sequence")])
        waiting, n = [], 0
        for frame in rows:
            waiting.append(pa.Table.from_pandas(frame[schema.names], schema, preserve_index=False))
            n += len(frame)
            if n >= GATHER_ROWS:
                self._take(pa.concat_tables(waiting))
                waiting, n = [], 0
        if n:
            self._take(pa.concat_tables(waiting))
        return iter(())

    def _spans(self, due: list[tuple[int, int]], keys: list[tuple]) -> Iterator[tuple[list, list]]:
        """Closes by time, cut where the blocks of events that they span hold
        more than ``GATHER_ROWS`` rows; with these blocks."""
        if not due:
            return
        low, high = due[0][1] - self.window_us, due[-1][1]
        held = [k for k in keys if k[1] >= low and k[0] <= high]
        if len(due) > 1 and sum(k[3] for k in held) > GATHER_ROWS:
            yield from self._spans(due[:len(due) // 2], held)
            yield from self._spans(due[len(due) // 2:], held)
        else:
            yield due, held

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        names = [c.split()[0] for c in PARTS.split(", ")]
        keys = self.events.keys()
        for block in self.closes.keys():
            if block[0] > now:
                continue
            closes = self.closes.get(block)
            late = closes.filter(pc.greater(closes.column("t"), now))
            due = closes.filter(pc.less_equal(closes.column("t"), now))
            for part, held in self._spans(list(zip(*(due.column(c).to_pylist() for c in CLOSE.names))), keys):
                rows = [self.events.get(k) for k in held]
                yield pd.DataFrame(_parts(pa.concat_tables(rows) if rows else ROW.empty_table(), part, self.window_us),
                                   columns=names)
            self.closes.remove(block)
            if late.num_rows:
                self.closes.add(late)
        if left := self.closes.keys():
            self._wake(left[0][0])
        for k in keys:
            if k[1] < now - self.window_us:
                self.events.remove(k)
        self.closes.tidy()
        self.events.tidy()

    def close(self) -> None:
        pass


def rolling_parts(events: DataFrame, lateness: str = "10 minutes", window_us: int = HOUR_US) -> DataFrame:
    """Streaming: (bucket's part of the metrics) for each close that the
    watermark has passed."""
    summed = events.mapInArrow(_summed, SUMMED).withColumn(       # no nulls: pandas would make doubles of them
        "sequence", F.when(F.col("kind") == "close", F.col("sequence")).otherwise(F.lit(0).cast("long")))
    return (summed.withColumn("event_time", F.timestamp_micros("t")).withWatermark("event_time", lateness)
            .groupBy("bucket").transformWithStateInPandas(HourState(window_us), PARTS, "Append", "EventTime"))


def total_of(parts: DataFrame) -> DataFrame:
    """Metrics of each ledger from the parts of all buckets."""
    sums = parts.groupBy("sequence", "t").agg(
        *[F.sum(c).alias(c) for c in ("c_tx", "c_ok", "c_fee", "c_op", "c_acct")],
        # 30 digits before seven decimals: the product keeps all of them
        (F.sum(F.col("c_vol").cast("decimal(38,0)")).cast("decimal(30,0)") * F.lit(decimal.Decimal("0.0000001")))
        .cast("decimal(38,7)").alias("c_vol"))
    return hour_metrics(sums.withColumn("close", from_micros(F.col("t"))).withColumnRenamed("sequence", "seq"))


def rolling_network_metrics(spark: SparkSession, events: DataFrame, out_path: str, checkpoint: str,
                            lateness: str = "10 minutes", trigger: dict | None = None,
                            partitions: int | None = None):
    """Start the stream of ``hour_events`` that appends a W1 row for every
    ledger whose close the watermark has passed. Keyed state needs the RocksDB
    store, which is chosen for this query alone, as are at most ``partitions``
    state stores: more of them than buckets hold nothing."""
    def fn(batch, batch_id):
        total = total_of(batch).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            sinks.append_snapshot(spark, out_path, total, key=("sequence",))
        finally:
            total.unpersist()
    writer = (rolling_parts(events, lateness).writeStream.foreachBatch(fn)
              .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})))
    before = {k: spark.conf.get(k) for k in (STATE_STORE, SHUFFLE_PARTITIONS)}
    spark.conf.set(STATE_STORE, ROCKSDB)
    if partitions:
        spark.conf.set(SHUFFLE_PARTITIONS, str(min(partitions, int(before[SHUFFLE_PARTITIONS]))))
    try:
        return writer.start()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
