"""Session states as streams that are stopped and started again, against the fold over a table."""

from __future__ import annotations

import datetime as dt
import random

import pytest

from millrace.streaming import stateful

SCHEMA = "client_id string, session_id string, ts timestamp, ord long, role string, content string, brand_filter string"
T0 = dt.datetime(2024, 1, 1)


def writes(seed: int, n: int = 120) -> list[tuple]:
    """Rows in the order of time; sessions pause beyond the time-to-live of 1,000 s now and then."""
    r = random.Random(seed)
    now, rows = 0, []
    for i in range(n):
        now += r.choice([1, 5, 40, 40, 400])
        rows.append((f"c{r.randrange(2)}", f"s{r.randrange(6)}", T0 + dt.timedelta(seconds=now), i, r.choice(["user", "assistant"]), f"m{i}", r.choice([None, None, None, "a", "b", "all"])))
    return rows


def plain(row) -> tuple:
    return row["client_id"], row["session_id"], row["ts"], row["brand_filter"], tuple((t["ord"], t["role"], t["content"]) for t in row["turns"])


def run(spark, folder, tmp_path, log=None, fail_at=None) -> list:
    """Reads one file a batch; `fail_at` ends the stream after so many batches, as a lost driver would."""
    got, seen = [], [0]

    def sink(batch, batch_id):
        got.extend(batch.collect())
        seen[0] += 1
        if fail_at and seen[0] >= fail_at:
            raise RuntimeError("stopped")

    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
    q = stateful.started(stateful.session_states(stream, log, 1000, 3, "1 second"), sink, f"{tmp_path}/cp")
    if fail_at:
        with pytest.raises(Exception, match="stopped"):
            q.awaitTermination(300)
    else:
        q.awaitTermination(300)
    return got


def put(spark, folder, rows, name):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/tmp-{name}")
    import pathlib
    import shutil

    (file,) = pathlib.Path(f"{folder}/tmp-{name}").glob("*.parquet")
    shutil.move(file, f"{folder}/{name}.parquet")
    shutil.rmtree(f"{folder}/tmp-{name}")


def fold(rows: list[tuple]) -> set[tuple]:
    """Plain Python: the last turns and filter of each session after its last pause."""
    state: dict = {}
    for c, s, ts, o, role, content, brand in rows:
        last, held, turns = state.get((c, s), (None, None, []))
        if last is not None and (ts - last).total_seconds() >= 1000:
            held, turns = None, []
        held = held if brand is None else None if brand == "all" else brand
        state[c, s] = (ts, held, [*turns, (o, role, content)][-3:])
    return {(c, s, ts, held, tuple(turns)) for (c, s), (ts, held, turns) in state.items()}


def test_fold_of_a_table(spark):
    rows = writes(1)
    assert {plain(r) for r in stateful.session_fold(spark.createDataFrame(rows, SCHEMA), 1000, 3).collect()} == fold(rows)


def test_restarted_stream_ends_as_the_fold(spark, tmp_path):
    rows, folder = writes(2), f"{tmp_path}/in"
    for i in range(3):
        put(spark, folder, rows[40 * i : 40 * i + 40], f"b{i}")
    got = run(spark, folder, tmp_path, fail_at=2)
    got += run(spark, folder, tmp_path)
    final = {(r["client_id"], r["session_id"]): plain(r) for r in got if not r["expired"]}
    assert set(final.values()) == fold(rows)
    ended = {(r["client_id"], r["session_id"], r["ts"]) for r in got if r["expired"]}
    pauses = {(c, s, ts) for c, s, ts, *_ in rows if not any(a[0] == c and a[1] == s and 0 < (a[2] - ts).total_seconds() < 1000 for a in rows)}
    assert ended and ended <= pauses


def test_stream_begins_where_the_log_ends(spark, tmp_path):
    """The log is read by the first batch only; a restart takes up what the state store holds."""
    rows, folder = writes(3), f"{tmp_path}/in"
    log = spark.createDataFrame(rows[:60], SCHEMA)
    put(spark, folder, rows[60:90], "b0")
    got = run(spark, folder, tmp_path, log)
    put(spark, folder, rows[90:], "b1")
    got += run(spark, folder, tmp_path, log)
    final = {(r["client_id"], r["session_id"]): plain(r) for r in got if not r["expired"]}
    wanted = {x[:2]: x for x in fold(rows)}
    assert final and all(wanted[k] == v for k, v in final.items())
