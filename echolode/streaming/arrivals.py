"""An addition of our own: texts that arrive are linked, window by window, with equal windows of texts seen before.

State is kept by window hash, in buckets of these: the stretches of time in which the window was seen, each with its first and last place. Two
sightings of a window are in one stretch if no gap between sightings is longer than ``horizon``; texts that are linked, directly
or through others, are those that share a stretch, whatever the order or the batches in which they come. Only links that hold
stretches together are given, not all pairs, so a window that a third of all texts has costs one link a text.

A stretch is forgotten once the watermark is ``horizon`` past its end. Windows later than the watermark are dropped by Spark, unless
one record batch holds them together with an equal one that isn't late. Texts without a time are left out. A null text has no windows; a null id counts as the empty text; a text that comes again links
with nothing new, as both have one path. Columns other than the three named aren't read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from datetime import timedelta
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..config import Windows
from ..operators.components import connected_components
from ..operators.snippets import text_units, window_snippets
from ..sources.files import table_files

PLACE = ("path", "start_line", "end_line")
SPAN = "first_at long, first_path string, first_start int, first_end int, last_at long, last_path string, last_start int, last_end int"
LINK = "a_path string, a_start_line int, a_end_line int, b_path string, b_start_line int, b_end_line int"
#: Link rows that a record batch has found already go through the state operator under that many keys that hold no state.
PASSED = 1024
#: Windows share that many keys of state by their hash: a key costs calls to the store, which millions of windows would each pay for.
#: State that was kept by window can't be taken up.
BUCKETS = 1 << 14


def joined(spans: list[tuple], horizon: int) -> tuple[list[tuple], list[tuple]]:
    """Stretches put together where gaps allow it, and the links (earlier place, later place) that this needs."""
    kept, links = [], []
    for x in sorted(spans):
        if kept and x[0] - kept[-1][4] <= horizon:
            held = kept[-1]
            if held[5] != x[1]:
                links.append(held[5:] + x[1:4])
            kept[-1] = held[:4] + max(held[4:], x[4:])
        else:
            kept.append(x)
    return kept, links


def _met(batches: Iterator[pa.RecordBatch], horizon: int) -> Iterator[pa.RecordBatch]:
    """Stretches of each record batch by window, and the links within them: what a frequent window sends on is a row a batch."""
    names = [x.split()[0] for x in SPAN.split(", ")]
    for b in batches:
        by = defaultdict(list)
        for key, at, *place in zip(*(b[c].to_pylist() for c in ("text_hash", "at", *PLACE)), strict=True):
            by[key].append((at, *place, at, *place))
        rows = []
        for key, spans in by.items():
            kept, links = joined(spans, horizon)
            rows += [(str(crc32(key.encode()) % BUCKETS), key, *x) for x in kept]
            rows += [(f"#{crc32(repr(x).encode()) % PASSED}", None, kept[-1][4], *x[:3], kept[-1][4], *x[3:]) for x in links]
        yield pa.RecordBatch.from_pylist([dict(zip(["key", "own", *names], x, strict=True)) for x in rows], _schema())


def _schema() -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
    return pa.schema([("key", pa.string()), ("own", pa.string())] + [(n, kinds[t]) for n, t in map(str.split, SPAN.split(", "))])


class Stretches(StatefulProcessor):
    """The stretches of the windows of a bucket, and a timer for the one that ends first. Between two of a window lies more than
    ``horizon``, so it has only as many as fit between the watermark and the newest row. A bucket is read and written once a batch,
    whatever windows of it the batch has."""

    def __init__(self, horizon: int) -> None:
        self.horizon = horizon

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.spans = handle, handle.getListState("spans", f"own string, {SPAN}")

    def _keep(self, new: list[tuple], due: int | None) -> None:
        """``new`` in the place of what is held, whose timer is ``due``."""
        at = min(x[5] for x in new) + self.horizon if new else None
        if at != due:
            if due is not None:
                self.handle.deleteTimer(due)
            if at is not None:
                self.handle.registerTimer(at)
        if new:
            self.spans.put(new)
        else:
            self.spans.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        names, new = [x.split()[0] for x in LINK.split(", ")], defaultdict(list)
        for r in rows:
            x = tuple(r[n.split()[0]] for n in SPAN.split(", "))
            if r["own"] is not None:
                new[r["own"]].append(x)
            else:
                yield Row(**dict(zip(names, x[1:4] + x[5:], strict=True)))
        if new:
            old = list(map(tuple, self.spans.get()))
            due = min(x[5] for x in old) + self.horizon if old else None
            kept = [x for x in old if x[0] not in new]
            for x in old:
                if x[0] in new:
                    new[x[0]].append(x[1:])
            for own, spans in new.items():
                spans, links = joined(spans, self.horizon)
                kept += [(own, *x) for x in spans]
                for x in links:
                    yield Row(**dict(zip(names, x, strict=True)))
            self._keep(kept, due)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        # the timer that fires is gone by itself; all that has ended by now goes with it
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        self._keep([x for x in map(tuple, self.spans.get()) if x[5] + self.horizon > now], None)
        return iter(())

    def close(self) -> None:
        pass


def links(arriving: DataFrame, id_col: str, text_col: str, at_col: str, windows: Windows = Windows(), horizon: timedelta = timedelta(days=30), late: timedelta = timedelta(days=1)) -> DataFrame:
    """A stream of links between equal windows of a stream of texts. The session's state store must be RocksDB's, which ``watch`` sees to."""
    ms = int(horizon.total_seconds() * 1000)
    texts = arriving.where(F.col(at_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(at_col).cast("timestamp").alias("at"))
    # one file row a text: its time goes along with the path, which is all that the windows keep of it
    named = texts.select(F.concat(F.unix_millis("at").cast("string"), F.lit("|"), F.coalesce(F.col("id").cast("string"), F.lit(""))).alias("id"), "text")
    w = window_snippets(text_units(table_files(named, "id", "text", "")), windows, normalise=False)
    told = w.select(F.sha2("text", 256).alias("text_hash"), F.expr("cast(substring_index(path, '|', 1) as long)").alias("at"), F.expr("substr(path, instr(path, '|') + 1)").alias("path"), "start_line", "end_line")
    met = told.mapInArrow(lambda batches: _met(batches, ms), f"key string, own string, {SPAN}")
    timed = met.withColumn("at", F.timestamp_millis("last_at")).withWatermark("at", f"{int(late.total_seconds() * 1000)} milliseconds")
    return timed.groupBy("key").transformWithState(Stretches(ms), LINK, "Append", "EventTime")


def watch(arriving: DataFrame, id_col: str, text_col: str, at_col: str, out: str, checkpoint: str, windows: Windows = Windows(), horizon: timedelta = timedelta(days=30), late: timedelta = timedelta(days=1), trigger: dict | None = None) -> StreamingQuery:
    """Links go to ``out`` as Parquet, once each, whatever is restarted; state lies in ``checkpoint``."""
    conf = arriving.sparkSession.conf
    conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    # else rows are late by the watermark of the batch before, as several operators in a row need it
    conf.set("spark.sql.streaming.statefulOperator.allowMultiple", "false")
    stream = links(arriving, id_col, text_col, at_col, windows, horizon, late)
    return stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(**(trigger or {"availableNow": True})).start()


def clusters(found: DataFrame) -> DataFrame:
    """(node, component) of all paths that links hold together."""
    return connected_components(found.select("a_path", "b_path"), "a_path", "b_path")
