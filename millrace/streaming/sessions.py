"""Streams of session messages: state with a rolling time-to-live, and event windows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from millrace.operators.history import last_messages

#: Seconds that a session's state lives after its last write, and turns it keeps.
TTL_S, WINDOW = 86_400, 6
OUT = "client_id string, session_id string, ts timestamp, brand_filter string, history array<struct<role:string,content:string>>, expired boolean"
STATE = "brand_filter string, roles array<string>, contents array<string>"


def session_extents(messages: DataFrame, ttl_s: int = TTL_S) -> DataFrame:
    """(client, session, start, end, turns): stretches of writes less than a time-to-live apart; batch or stream."""
    window = F.session_window("ts", f"{ttl_s} seconds")
    return messages.groupBy("client_id", "session_id", window.alias("w")).agg(F.count(F.lit(1)).alias("turns")).select("client_id", "session_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "turns")


def session_state(messages: DataFrame, ttl_s: int = TTL_S, window: int = WINDOW, late: str = "10 minutes") -> DataFrame:
    """A stream's sessions after each batch of writes: sticky filter and last turns, or expired.

    messages(client_id, session_id, ts, role, content, brand_filter): null keeps the filter, "all"
    clears it.  Every write moves the expiry; reads don't exist here.
    """

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([(*key, pd.Timestamp(state.getCurrentWatermarkMs(), unit="ms"), None, [], True)], columns=_NAMES)
            return
        brand, roles, contents = state.get if state.exists else (None, [], [])
        roles, contents, last = list(roles), list(contents), None
        for f in frames:
            for r in f.sort_values("ts", kind="stable").itertuples():
                if isinstance(r.brand_filter, str):
                    brand = None if r.brand_filter == "all" else r.brand_filter
                roles, contents = [*roles, r.role][-window:], [*contents, r.content][-window:]
                last = r.ts if last is None else max(last, r.ts)
        state.update((brand, roles, contents))
        due = max(int(last.timestamp() * 1000), state.getCurrentWatermarkMs()) + ttl_s * 1000
        state.setTimeoutTimestamp(due)
        turns = [{"role": a, "content": b} for a, b in zip(roles, contents, strict=True)]
        yield pd.DataFrame([(*key, last, brand, turns, False)], columns=_NAMES)

    marked = messages.withWatermark("ts", late)
    return marked.groupBy("client_id", "session_id").applyInPandasWithState(update, OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)


_NAMES = ["client_id", "session_id", "ts", "brand_filter", "history", "expired"]


def once_each(rows: DataFrame, id_col: str, ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """A stream without repeated ids, for sources that deliver at least once."""
    return rows.withWatermark(ts, late).dropDuplicatesWithinWatermark([id_col])


def windowed_outcomes(events: DataFrame, size: str, slide: str | None = None, late: str | None = None) -> DataFrame:
    """Events and their mean value for each time window and type (an extension; batch or stream)."""
    rows = events.withWatermark("ts", late) if late else events
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    out = rows.groupBy(window.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("avg_value"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "avg_value")


def file_chain(files: DataFrame, steps: Callable[[DataFrame, int], None], checkpoint: str):
    """A stream of new files put through `steps(batch, batch_id)`; a failed batch is repeated, so steps must be idempotent."""
    return files.writeStream.foreachBatch(steps).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def hydrated(sessions: DataFrame, log: DataFrame, n: int = WINDOW) -> DataFrame:
    """(client_id, session_id, history): sessions without state get their last n messages from the permanent log; none is an empty history."""
    wanted = sessions.select("client_id", "session_id").distinct()
    kept = last_messages(log.join(wanted, ["client_id", "session_id"], "left_semi"), n)
    empty = F.array().cast("array<struct<role:string,content:string>>")
    return wanted.join(kept, ["client_id", "session_id"], "left").withColumn("history", F.coalesce("history", empty))


def append_turns(turns: DataFrame, path: str, checkpoint: str, id_col: str = "message_id"):
    """A stream of turns (id_col, ts, client_id, session_id, question, reply) appended as two messages each.

    A turn delivered twice within the watermark is appended once; the file sink commits whole batches.
    """
    said = F.array(F.struct(F.lit(0).alias("nth"), F.lit("user").alias("role"), F.col("question").alias("content")), F.struct(F.lit(1).alias("nth"), F.lit("assistant").alias("role"), F.col("reply").alias("content")))
    rows = once_each(turns, id_col).select(id_col, "ts", "client_id", "session_id", F.explode(said).alias("m")).select(id_col, "ts", "client_id", "session_id", "m.*")
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
