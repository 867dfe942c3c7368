"""Session state as a stream of writes: kept in a state store, expired by timers, begun from the permanent log.

messages(client_id, session_id, ts, ord, role, content, brand_filter): `ord` orders equal times; a null
filter keeps the last one, "all" clears it.  A session's state is its last turns and its filter; it ends a
time-to-live after its last write.  `session_fold` states the same over a table, and a stream that has
read all of it ends with the same states, however its batches were cut or restarted.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.window import Window

from millrace.operators.history import SESSION
from millrace.streaming.sessions import TTL_S, WINDOW

#: Times are microseconds in the state.
_TURN = "at long, ord long, role string, content string"
_OUT = "client_id string, session_id string, last long, brand_filter string, turns array<struct<at:long,ord:long,role:string,content:string>>, expired boolean"
_PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def session_fold(messages: DataFrame, ttl_s: int = TTL_S, window: int = WINDOW) -> DataFrame:
    """(client_id, session_id, ts, brand_filter, turns): each session's state after its last write.

    A write that comes a time-to-live or more after the one before begins anew.
    """
    order = Window.partitionBy(*SESSION).orderBy("ts", "ord")
    gap = F.col("ts").cast("double") - F.lag(F.col("ts").cast("double")).over(order) >= ttl_s
    x = messages.withColumn("_begins", F.sum(F.coalesce(gap, F.lit(False)).cast("long")).over(order))
    x = x.withColumn("_last", F.max("_begins").over(Window.partitionBy(*SESSION))).where("_begins = _last")
    newest = Window.partitionBy(*SESSION).orderBy(F.desc("ts"), F.desc("ord"))
    x = x.withColumn("_nth", F.row_number().over(newest))
    turn = F.when(F.col("_nth") <= window, F.struct(F.col("ts").alias("at"), "ord", "role", "content"))
    held = F.max_by("brand_filter", F.when(F.col("brand_filter").isNotNull(), F.struct("ts", "ord")))
    out = x.groupBy(*SESSION).agg(F.max("ts").alias("ts"), held.alias("held"), F.sort_array(F.collect_list(turn)).alias("turns"))
    return out.select(*SESSION, "ts", F.when(F.col("held") != "all", F.col("held")).alias("brand_filter"), "turns")


class SessionStates(StatefulProcessor):
    """Folds a session's writes in the order of their times; holds the writes that one batch has for it."""

    def __init__(self, ttl_s: int, window: int):
        self.ttl_s, self.window = ttl_s, window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.about = handle.getValueState("about", "last long, filter string, filter_at long, filter_ord long, due long")
        self.turns = handle.getListState("turns", _TURN)

    def _stored(self) -> tuple:
        if not self.about.exists():
            return None, None, (None, None), None, []
        last, brand, at, ord_, due = self.about.get()
        return last, brand, (at, ord_), due, [tuple(t) for t in self.turns.get()] if self.turns.exists() else []

    def _store(self, last, brand, brand_at: tuple, due, turns: list[tuple]) -> None:
        new = last // 1000 + self.ttl_s * 1000
        if new != due:
            if due is not None:
                self.handle.deleteTimer(due)
            self.handle.registerTimer(new)
        self.about.update((last, brand, *brand_at, new))
        self.turns.put(turns)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        last, brand, brand_at, due, turns = self._stored()
        for r in sorted(rows, key=lambda r: (r["at"], r["ord"])):
            if last is not None and r["at"] - last >= self.ttl_s * 1_000_000:
                brand, brand_at, turns = None, (None, None), []
            at = (r["at"], r["ord"])
            if r["brand_filter"] is not None and (brand_at[0] is None or at >= brand_at):
                brand, brand_at = r["brand_filter"], at
            turns = sorted([*turns, (*at, r["role"], r["content"])], key=lambda t: t[:2])[-self.window :]
            last = r["at"] if last is None else max(last, r["at"])
        self._store(last, brand, brand_at, due, turns)
        yield self._row(key, last, None if brand == "all" else brand, turns, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        last = self._stored()[0]
        self.about.clear()
        self.turns.clear()
        yield self._row(key, last, None, [], True)

    def handleInitialState(self, key, initialState: Row, timerValues) -> None:
        turns = [(t["at"], t["ord"], t["role"], t["content"]) for t in initialState["turns"]]
        self._store(initialState["last"], initialState["brand_filter"], (initialState["last"], turns[-1][1]), None, turns)

    @staticmethod
    def _row(key, last, brand, turns: list[tuple], expired: bool) -> Row:
        said = [Row(at=a, ord=o, role=r, content=c) for a, o, r, c in turns]
        return Row(client_id=key[0], session_id=key[1], last=last, brand_filter=brand, turns=said, expired=expired)

    def close(self) -> None:
        pass


def session_states(messages: DataFrame, log: DataFrame | None = None, ttl_s: int = TTL_S, window: int = WINDOW, late: str = "10 minutes") -> DataFrame:
    """(client_id, session_id, ts, brand_filter, turns, expired): a session's state after each batch that writes to it, or its end.

    With a log, a table of earlier messages, the first batch begins with the states that the log
    ends with; a restart takes up the stored states instead.  Start it with `started`.
    """
    rows = messages.withWatermark("ts", late).withColumn("at", F.unix_micros("ts"))
    timed = lambda column, cast: F.transform(column, lambda t: F.struct(cast(t["at"]).alias("at"), t["ord"].alias("ord"), t["role"].alias("role"), t["content"].alias("content")))
    begun = None
    if log is not None:
        held = session_fold(log, ttl_s, window)
        begun = held.select(*SESSION, F.unix_micros("ts").alias("last"), "brand_filter", timed("turns", F.unix_micros).alias("turns")).groupBy(*SESSION)
    out = rows.groupBy(*SESSION).transformWithState(SessionStates(ttl_s, window), _OUT, "update", "eventTime", begun)
    return out.select(*SESSION, F.timestamp_micros("last").alias("ts"), "brand_filter", timed("turns", F.timestamp_micros).alias("turns"), "expired")


def started(states: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = True, partitions: int | None = None) -> StreamingQuery:
    """Start `states` with its state in RocksDB, which timers need; sink(batch, batch_id) gets each batch's rows.

    `partitions` of the state, by default as many as of a shuffle, are fixed by the first start.
    """
    spark: SparkSession = states.sparkSession
    wanted = dict([_PROVIDER]) | ({"spark.sql.shuffle.partitions": str(partitions)} if partitions else {})
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        writer = states.writeStream.foreachBatch(sink).outputMode("update").option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if available_now else writer).start()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
