"""H3 for pieces in any order: token messages by event time.

Pieces of a request wait in keyed state with their ``seq``; given out, a repeated piece
counts once (as it came last) and order of arrival does not matter.  When the watermark
passes the request's latest piece plus ``hold``, an event-time timer fires: the message is
given out once, exactly as ``events.assemble_tokens`` builds it from a batch, and
the pieces leave the state.  A mark stays for ``keep`` longer, so pieces that come
later do not open the request again; after that even its mark is gone.  Pieces older
than the watermark are dropped by Spark before they get here.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from qcorpus.streaming.events import ASSEMBLED_SCHEMA

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OPEN, DONE, ERROR = range(3)
APPENDED = 1000  # pieces in one call


class _Assembler(StatefulProcessor):
    """A call of the state costs a round trip to the JVM, so the pieces that a micro-batch
    brings are appended in one, and a request whose latest piece moves keeps its timer:
    the timer looks at the time reached by then and stands again where it is too early."""

    def __init__(self, hold_ms: int, keep_ms: int):
        self.hold_ms, self.keep_ms = hold_ms, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pieces = handle.getListState("pieces", "seq long, token string, kind int")
        self.request = handle.getValueState("request", "last_ms long, given boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        state = self.request.get()
        if state is not None and (state[1] or state[0] + self.hold_ms <= timerValues.getCurrentWatermarkInMs()):
            return  # the message is out, or goes out in this micro-batch: timers fire after the rows
        last, new = state[0] if state else None, []
        for r in rows:
            new.append((r.seq, r.token, r.kind))
            last = r.ms if last is None else max(last, r.ms)
            if len(new) == APPENDED:
                self.pieces.appendList(new)
                new = []
        if new:
            self.pieces.appendList(new)
        if state is None:
            self.handle.registerTimer(last + self.hold_ms)
        if state is None or last != state[0]:
            self.request.update((last, False))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        last, given = self.request.get()
        if given:
            self.request.clear()
            return
        if last + self.hold_ms > timerValues.getCurrentWatermarkInMs():
            self.handle.registerTimer(last + self.hold_ms)
            return
        rows = sorted({r[0]: tuple(r) for r in self.pieces.get()}.values(), key=lambda r: r[0])
        close = next((n for n, r in enumerate(rows) if r[2] != OPEN), None)
        kept = rows if close is None else rows[:close + 1]
        kind = OPEN if close is None else rows[close][2]
        self.pieces.clear()
        self.request.update((last, True))
        self.handle.registerTimer(last + self.hold_ms + self.keep_ms)
        yield Row(request_id=key[0], message="".join(r[1] for r in kept if r[1] is not None), n_tokens=len(kept),
                  done=kind == DONE, has_error=kind == ERROR)

    def close(self) -> None:
        pass


def _ms(interval: str) -> int:
    n, unit = interval.split()
    return int(float(n) * {"second": 1, "minute": 60, "hour": 3600, "day": 86400}[unit.rstrip("s")] * 1000)


def assemble_tokens_ordered(tokens: DataFrame, watermark: str = "10 minutes", hold: str = "10 minutes",
                            keep: str = "1 hour", ts_col: str = "timestamp") -> DataFrame:
    """A stream of (request_id, seq, token, done, error, ``ts_col``) as one row
    per request (append mode).  ``watermark``: how late pieces may be; ``hold``:
    event time without a new piece after which a request is given out, open
    (both flags false) if nothing closed it.  Pieces with a null request, seq or
    time are left out.  Run the query inside ``rocksdb_state``."""
    kind = (F.when(F.coalesce(F.col("done"), F.lit(False)), DONE).when(F.col("error").isNotNull(), ERROR).otherwise(OPEN))
    pieces = (tokens.where(F.col("request_id").isNotNull() & F.col("seq").isNotNull() & F.col(ts_col).isNotNull())
              .withWatermark(ts_col, watermark)
              .select("request_id", "seq", "token", kind.alias("kind"), F.unix_millis(ts_col).alias("ms"), ts_col))
    return pieces.groupBy("request_id").transformWithState(
        statefulProcessor=_Assembler(_ms(hold), _ms(keep)), outputStructType=ASSEMBLED_SCHEMA, outputMode="Append",
        timeMode="EventTime")


@contextmanager
def rocksdb_state(spark: SparkSession):
    """Queries started inside keep their state in RocksDB, which keyed maps and
    timers need; the session's own setting is put back."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)
