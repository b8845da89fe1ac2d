"""Keyed state over events: what moved since a session was last seen, and notes shown once.

The same relations are given over tables, and over streams with the last
value of a key as state.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues


def moved(states: DataFrame) -> DataFrame:
    """session, ts, head where the head differs from the session's last one; the first sighting is no move."""
    w = Window.partitionBy("session").orderBy("ts", "ord")
    return states.withColumn("_p", F.lag("head").over(w)).where(F.col("_p").isNotNull() & (F.col("_p") != F.col("head"))).select("session", "ts", "ord", "head")


def shown_once(notes: DataFrame) -> DataFrame:
    """repo, ts, key of notes that differ from the repository's last one."""
    w = Window.partitionBy("repo").orderBy("ts", "ord")
    return notes.withColumn("_p", F.lag("key").over(w)).where(~F.col("_p").eqNullSafe(F.col("key"))).select("repo", "ts", "ord", "key")


def recent_sessions(states: DataFrame, kept: int = 50) -> DataFrame:
    """session, head of the sessions seen last."""
    last = states.groupBy("session").agg(F.max_by("head", F.struct("ts", "ord")).alias("head"), F.max(F.struct("ts", "ord")).alias("at"))
    return last.orderBy(F.desc("at"), "session").limit(kept).select("session", "head")


# Streams

#: Rows that wait are kept by slices of time of so many milliseconds, or of twice, four times, ... as many where they are thin.
SLICE = 24 * 3600 * 1000
#: Bytes of rows that are packed together, and rows that a pack should have.
PACK, ROWS = 8 << 20, 500


def moved_stream(states: DataFrame) -> DataFrame:
    """``moved`` over a stream of (session, ts, ord, head) that comes in order: the last head of each session is its state, and moves go out at once."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values(["ts", "ord"])
        before = rows["head"].shift(1)
        before.iloc[0] = last
        state.update((rows["head"].iloc[-1],))
        yield rows.loc[before.notna() & (before != rows["head"]), ["session", "ts", "ord", "head"]]

    schema = "session long, ts timestamp, ord long, head string"
    return states.groupBy("session").applyInPandasWithState(step, schema, "head string", "append", "NoTimeout")


def _millis(ts: pa.ChunkedArray) -> pa.ChunkedArray:
    """Milliseconds of times or microseconds, rounded up, as timers know no less."""
    micros = ts.cast(pa.int64())
    whole = pc.divide(micros, 1000)
    return pc.add(whole, pc.greater(micros, pc.multiply(whole, 1000)).cast(pa.int64()))


class InOrder(StatefulProcessor):
    """Rows of a key in the order of (ts, ord), held until the watermark says that none can come before them.

    State: the rows that wait, as many as come within the watermark's delay, an Arrow table for each batch; and
    the last value. ``fields`` are the columns that go out, the second of them the time, and ``value`` the one that
    is compared with the last.
    """

    TYPES = {"long": pa.int64(), "timestamp": pa.timestamp("us"), "string": pa.string()}

    def __init__(self, fields: list[str], kinds: str, value: str, first: bool):
        self.fields, self.time, self.kinds, self.value, self.first = fields, fields[1], kinds, value, first

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.fixed = pa.schema([(name, self.TYPES[kind]) for name, kind in (f.split() for f in self.kinds.split(","))])
        self.waiting = handle.getListState("waiting", "rows binary")
        self.last = handle.getValueState("last", "value string")

    def _packed(self, rows: pa.Table) -> tuple[bytes]:
        return (_packed(rows, self.fixed),)

    def _news(self, ready: pa.Table, last: str | None) -> pa.Table:
        """The rows of ``ready``, which are in order, that differ from the one before; ``last`` comes before all."""
        value = ready[self.value].combine_chunks()
        before = pa.concat_arrays([pa.array([last], value.type), value[:-1]])
        # A move is from something to something; a note is news beside none as well.
        out = pc.fill_null(pc.not_equal(value, before), False)
        if self.first:
            out = pc.or_(out, pc.xor(pc.is_null(value), pc.is_null(before)))
        return ready.filter(out)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        earliest = None
        for batch in rows:
            if len(batch):
                found = pa.Table.from_pandas(batch[self.fields], self.fixed, preserve_index=False)
                self.waiting.appendValue(self._packed(found))
                low = pc.min(_millis(found[self.time])).as_py()
                earliest = low if earliest is None else min(low, earliest)
        if earliest is not None:
            self.handle.registerTimer(earliest)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        parts = [pa.ipc.open_stream(blob).read_all() for (blob,) in self.waiting.get()] if self.waiting.exists() else []
        if not parts:
            return
        rows = pa.concat_tables(parts)
        due = pc.less_equal(_millis(rows[self.time]), now)
        ready, later = rows.filter(due).sort_by([(self.time, "ascending"), ("ord", "ascending")]), rows.filter(pc.invert(due))
        if len(later):
            self.waiting.put([self._packed(later)])
            self.handle.registerTimer(pc.min(_millis(later[self.time])).as_py())
        else:
            self.waiting.clear()
        if not len(ready):
            return
        found = self._news(ready, self.last.get()[0] if self.last.exists() else None)
        self.last.update((ready[self.value][-1].as_py(),))
        if len(found):
            yield found.to_pandas(integer_object_nulls=True)

    def close(self) -> None:
        pass


class SlicesInOrder(InOrder):
    """``InOrder`` for keys of any number of rows, that come as ``packed`` has them; their times are microseconds ``at``.

    State: the packs that wait, by slice of time, so that one slice of a key is in memory at a time (the widest, where
    some lie in others); and the last value with the watermark up to which rows have gone out.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.fixed = pa.schema([(name, self.TYPES[kind]) for name, kind in (f.split() for f in self.kinds.split(","))])
        self.waiting = handle.getMapState("waiting", "start long, end long, n long", "rows binary")
        self.count = handle.getValueState("count", "n long")
        self.last = handle.getValueState("last", "value string, until long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        n, until = self.count.get()[0] if self.count.exists() else 0, self.last.get()[1] if self.last.exists() else None
        earliest = None
        for batch in rows:
            for start, end, low, pack in batch[["start", "end", "low", "rows"]].itertuples(index=False):
                if until is not None and low <= until:  # some are late
                    found = _unpacked([pack])
                    found = found.filter(pc.greater(_millis(found["at"]), until))
                    if not len(found):
                        continue
                    (pack,), low = self._packed(found), pc.min(_millis(found["at"])).as_py()
                self.waiting.updateValue((int(start), int(end), n), (pack,))
                n += 1
                earliest = low if earliest is None else min(low, earliest)
        if earliest is not None:
            self.count.update((n,))
            self.handle.registerTimer(int(earliest))
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        last = self.last.get()[0] if self.last.exists() else None
        slices = []
        for k in sorted(self.waiting.keys(), key=lambda k: (k[0], -k[1], k[2])) if self.waiting.exists() else []:
            if slices and k[0] < slices[-1][0][1]:
                slices[-1].append(tuple(k))
            else:
                slices.append([tuple(k)])
        for held in slices:
            if held[0][0] > now:
                self.handle.registerTimer(held[0][0])
                break
            rows = _unpacked([self.waiting.getValue(k)[0] for k in held])
            due = pc.less_equal(_millis(rows["at"]), now)
            ready, later = rows.filter(due).sort_by([("at", "ascending"), ("ord", "ascending")]), rows.filter(pc.invert(due))
            if len(later):
                self.handle.registerTimer(pc.min(_millis(later["at"])).as_py())
            if not len(ready):
                continue
            for k in held[1:] if len(later) else held:
                self.waiting.removeKey(k)
            if len(later):
                self.waiting.updateValue(held[0], self._packed(later))
            found = self._news(ready, last)
            last = ready[self.value][-1].as_py()
            self.last.update((last, now))
            if len(found):
                yield found.to_pandas(integer_object_nulls=True)


def _packed(rows: pa.Table, schema: pa.Schema) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(rows)
    return sink.getvalue().to_pybytes()


def _unpacked(packs: list[bytes]) -> pa.Table:
    return pa.concat_tables([pa.ipc.open_stream(p).read_all() for p in packs])


def packed(rows: DataFrame, key: str) -> DataFrame:
    """name, start, end, low, ts, rows of ``rows``, which have microseconds ``at``: Arrow tables of rows of a key and a slice of time.

    ``name`` is the key's text, ``start`` and ``end`` the slice's milliseconds, ``low`` the first row's and ``ts`` the
    last row's time. Two slices are apart, or one lies in the other. State is read and written one Python value at a
    time, so millions of rows go there in thousands of packs.
    """

    def cut(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        found = pa.Table.from_batches(batches)
        ms = _millis(found["at"]).to_numpy()
        width, most = SLICE, max(len(found) / ROWS / pc.count_distinct(found["name"]).as_py(), 1)
        while ms.max() - ms.min() > width * most:
            width *= 2
        found = found.append_column("start", pa.array(ms - ms % width)).sort_by([("name", "ascending"), ("start", "ascending")]).combine_chunks()
        name, start, at = found["name"].combine_chunks(), found["start"].to_numpy(), found["at"].to_numpy()
        fresh = pc.not_equal(name[1:], name[:-1]).to_numpy(zero_copy_only=False) | (start[1:] != start[:-1])
        first = np.concatenate([[0], np.flatnonzero(fresh) + 1])
        inner = found.drop_columns(["name", "start"])
        inner = inner.cast(pa.schema([(f.name, f.type) for f in inner.schema]))  # a column without nulls is packed as any
        packs = [_packed(inner.slice(a, b - a), inner.schema) for a, b in zip(first, [*first[1:], len(found)])]
        low, high = _millis(pa.array(np.minimum.reduceat(at, first))), np.maximum.reduceat(at, first)
        return pa.record_batch([name.take(pa.array(first)), start[first], start[first] + width, low, high, pa.array(packs, pa.binary())], ["name", "start", "end", "low", "high", "rows"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.nbytes
            if size >= PACK:
                yield cut(held)
                held, size = [], 0
        if held:
            yield cut(held)

    named = rows.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("name"), *rows.columns)
    packs = named.mapInArrow(pack, "name string, start long, end long, low long, high long, rows binary")
    return packs.select("name", "start", "end", "low", F.timestamp_micros("high").alias("ts"), "rows")


def ordered_moves(states: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """``moved`` over a stream of (session, ts, ord, head), whose rows may come in any order within ``delay``.

    A row goes out when the watermark, in whole milliseconds, has reached it, so the last ones may wait for more;
    rows that come after that are dropped.
    """
    # Microseconds: a pandas time is one of the session's zone, and the watermark is not.
    ts = F.col("ts").cast("timestamp")
    rows = states.select("session", ts.alias("ts"), F.unix_micros(ts).alias("at"), "ord", "head").where("ts IS NOT NULL").withWatermark("ts", delay)
    schema = "session long, at long, ord long, head string"
    step = InOrder(["session", "at", "ord", "head"], schema, "head", False)
    found = rows.groupBy("session").transformWithStateInPandas(step, schema, "append", "eventTime")
    return found.select("session", F.timestamp_micros("at").alias("ts"), "ord", "head")


def ordered_notes(notes: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """``shown_once`` over a stream of (repo, ts, ord, key), as ``ordered_moves``.

    Repositories are few and may have many rows each, so these are packed where they are read. A late row is dropped
    at the latest when rows of its repository have gone out up to its time.
    """
    at = F.unix_micros(F.col("ts").cast("timestamp")).alias("at")
    rows = notes.select(F.col("repo").cast("long"), at, F.col("ord").cast("long"), F.col("key").cast("string")).where("at IS NOT NULL")
    schema = "repo long, at long, ord long, key string"
    step = SlicesInOrder(["repo", "at", "ord", "key"], schema, "key", True)
    found = packed(rows, "repo").withWatermark("ts", delay).groupBy("name").transformWithStateInPandas(step, schema, "append", "eventTime")
    return found.select("repo", F.timestamp_micros("at").alias("ts"), "ord", "key")


class Latest(StatefulProcessor):
    """The sessions of a bucket that were seen last, at most ``kept``; a session that is new or seen again goes out."""

    def __init__(self, kept: int):
        self.kept = kept

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "session long", "ts timestamp, ord long, head string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        best = {k[0]: tuple(v) for k, v in self.seen.iterator()}
        new = {}
        for batch in rows:
            for r in batch[["session", "ts", "ord", "head"]].itertuples(index=False):
                at = (r.ts.to_pydatetime(), r.ord, None if pd.isna(r.head) else r.head)
                if r.session not in best or best[r.session][:2] < at[:2]:
                    best[r.session] = new[r.session] = at
        order = sorted(best, key=lambda s: best[s][:2], reverse=True)
        for session in order[self.kept :]:
            new.pop(session, None)
            if self.seen.containsKey((session,)):
                self.seen.removeKey((session,))
        for session, at in new.items():
            self.seen.updateValue((session,), at)
        if new:
            yield pd.DataFrame([(s, *at) for s, at in new.items()], columns=["session", "ts", "ord", "head"])

    def close(self) -> None:
        pass


def recent_stream(states: DataFrame, kept: int = 50, buckets: int = 16) -> DataFrame:
    """(session, ts, ord, head) of sessions that are among the last ``kept`` of their bucket when they are seen.

    ``recent_sessions`` over what has gone out is that over all rows, whatever their order: a session that is
    among the last of all is among the last of its bucket. State is bounded by buckets x kept sessions.
    """
    rows = states.select("session", F.col("ts").cast("timestamp").alias("ts"), "ord", "head").withColumn("bucket", F.pmod(F.xxhash64("session"), F.lit(buckets)))
    return rows.groupBy("bucket").transformWithStateInPandas(Latest(kept), "session long, ts timestamp, ord long, head string", "append", "none")


def run_stream(stream: DataFrame, path: str) -> DataFrame:
    """All that a stream has to say now, as a table: its rows at ``path``/rows, its progress at ``path``/progress.

    State is kept in RocksDB, as these operators need it.
    """
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    query = stream.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")
