"""Live mutations: batch forms with windows, and their Structured Streaming counterparts.

Columns of mutations: seq, path, event_type, ts (TIMESTAMP).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from karstwell.functions.paths import excluded
from karstwell.operators.search import numbered

#: The order in which kinds of work are done.
PRIORITY = {"delete": 0, "dir_delete": 0, "change": 1, "scan": 1, "dir_index": 1, "embed": 2}


def admitted(mutations: DataFrame, globs: list[str]) -> DataFrame:
    """Without paths that the policy excludes. Works on streams too."""
    return mutations.where(~excluded(F.col("path"), globs))


def _suppress(rows: list[tuple], seconds: float, state: tuple | None) -> tuple[list[int], tuple | None]:
    """Indexes of rows (type, time) that pass, and the last passed one: a repeat of its type within the window doesn't."""
    kept = []
    for i, (kind, at) in enumerate(rows):
        if state is None or state[0] != kind or at - state[1] >= seconds:
            kept.append(i)
            state = (kind, at)
    return kept, state


def suppress_duplicates(mutations: DataFrame, seconds: float = 2.0) -> DataFrame:
    """Drops an event of the type that was last accepted for its path less than ``seconds`` ago.

    Suppressed events do not prolong the window, so this is a fold in time order
    for each path, over sorted rows; only the state of one path is held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, state = None, None
        for batch in batches:
            keep = []
            rows = zip(*(batch.column(c).to_pylist() for c in ("path", "event_type", "_us")), strict=True)
            for i, (p, kind, us) in enumerate(rows):
                if p != path:
                    path, state = p, None
                passed, state = _suppress([(kind, us / 1e6)], seconds, state)
                if passed:
                    keep.append(i)
            yield batch.take(pa.array(keep, pa.int64())).drop_columns(["_us"])

    rows = mutations.withColumn("_us", F.unix_micros("ts"))
    return rows.repartition("path").sortWithinPartitions("path", "ts", "seq").mapInArrow(run, mutations.schema)


def suppress_duplicates_stream(mutations: DataFrame, seconds: float = 2.0) -> DataFrame:
    """``suppress_duplicates`` on a stream: the last accepted type and time of a path is its state."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = (state.get[0], state.get[1]) if state.exists else None
        pdf = pd.concat(list(parts)).sort_values(["ts", "seq"])
        rows = list(zip(pdf["event_type"], pdf["ts"].map(lambda t: t.timestamp()), strict=True))
        kept, last = _suppress(rows, seconds, last)
        state.update(last)
        yield pdf.iloc[kept]

    return mutations.groupBy("path").applyInPandasWithState(run, mutations.select("seq", "path", "event_type", "ts").schema, "kind string, at double", "append", GroupStateTimeout.NoTimeout)


def debounced(mutations: DataFrame, seconds: float) -> DataFrame:
    """One row for each quiet period: path, first, last, events, fires_at (the last change plus the delay)."""
    w = Window.partitionBy("path").orderBy("ts", "seq")
    gap = F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(w))
    rows = mutations.withColumn("_n", F.sum(F.when(gap < int(seconds * 1e6), 0).otherwise(1)).over(w))
    g = rows.groupBy("path", "_n").agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count("*").alias("events"))
    return g.select("path", "first", "last", "events", (F.col("last") + F.make_dt_interval(secs=F.lit(seconds))).alias("fires_at"))


def debounced_stream(mutations: DataFrame, seconds: float, late: str = "1 hour") -> DataFrame:
    """``debounced`` by session windows; a session is emitted when the watermark has passed it."""
    return mutations.withWatermark("ts", late).groupBy("path", F.session_window("ts", f"{int(seconds * 1000)} milliseconds").alias("w")).agg(F.count("*").alias("events")).select("path", F.col("w.start").alias("first"), F.col("w.end").alias("fires_at"), "events")


def coalesced(mutations: DataFrame) -> DataFrame:
    """One pending mutation for each (operation, path): the newest generation, the first of equals. Columns: operation, path, generation, seq."""
    best = F.max_by(F.struct("generation", "seq"), F.struct("generation", (-F.col("seq")).alias("s")))
    return mutations.groupBy("operation", "path").agg(best.alias("m")).select("operation", "path", "m.generation", "m.seq")


def without_stale_deletes(mutations: DataFrame) -> DataFrame:
    """Deletes of an older generation than the path's newest go."""
    newest = mutations.groupBy("path").agg(F.max("generation").alias("_newest"))
    return mutations.join(newest, "path").where((F.col("operation") != "delete") | (F.col("generation") >= F.col("_newest"))).drop("_newest")


def priority(operation: Column) -> Column:
    known = F.create_map(*[F.lit(x) for p in PRIORITY.items() for x in p])
    return F.coalesce(known[operation], F.lit(1))


def pressure(mutations: DataFrame, seconds: float = 30, *, elevated: int = 20, overloaded: int = 100) -> DataFrame:
    """Events of the path in the sliding window up to each event, and the state this makes."""
    micros = F.unix_micros("ts")
    w = Window.partitionBy("path").orderBy(micros).rangeBetween(-int(seconds * 1e6), 0)
    n = F.count("*").over(w)
    return mutations.withColumn("events", n).withColumn("state", F.when(F.col("events") >= overloaded, "overloaded").when(F.col("events") >= elevated, "elevated").otherwise("normal"))


def pressure_stream(mutations: DataFrame, seconds: int = 30, slide: int = 5) -> DataFrame:
    return mutations.withWatermark("ts", f"{seconds} seconds").groupBy("path", F.window("ts", f"{seconds} seconds", f"{slide} seconds").alias("w")).agg(F.count("*").alias("events")).select("path", F.col("w.start").alias("start"), "events")


def snapshot_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """created, modified and deleted paths between two listings (path, mtime, size)."""
    b = before.select("path", F.struct("mtime", "size").alias("b"))
    a = after.select("path", F.struct("mtime", "size").alias("a"))
    event = F.when(F.col("b").isNull(), "created").when(F.col("a").isNull(), "deleted").when(F.col("a") != F.col("b"), "modified")
    return b.join(a, "path", "full").select("path", event.alias("event_type")).where("event_type is not null")


def live_state(row: DataFrame, stale_seconds: float = 30) -> DataFrame:
    """degraded, uninitialized, busy, idle or stalled, from one row of health columns.

    Columns: has_error, ready, active, backlog, accepted_at, progress_at, now.
    """
    age = lambda c: F.unix_micros("now") - F.unix_micros(c)
    old = F.lit(int(stale_seconds * 1e6))
    stale = F.col("progress_at").isNull() | (F.col("progress_at") < F.col("accepted_at")) | (age("progress_at") > old)
    state = F.when(F.col("has_error"), "degraded").when(~F.col("ready"), "uninitialized").when(F.col("active") > 0, "busy").when(F.col("backlog") <= 0, "idle").when(F.col("accepted_at").isNotNull() & (age("accepted_at") > old) & stale, "stalled").otherwise("busy")
    return row.withColumn("state", state)


def delete_batches(mutations: DataFrame, most: int = 64) -> DataFrame:
    """Adds batch to the deletes (operation, seq): runs without another operation between, cut at ``most``; others have null.

    A batch is numbered by the place of its first delete among all mutations in
    the order of seq. Places are dealt out by ranges, so no task sees all rows.
    """
    placed = numbered(mutations, [F.col("seq")], "_place")
    deletes = numbered(placed.where(F.col("operation") == "delete").select(F.col("_place").alias("_at")), [F.col("_at")], "_nth")
    # in a run, place and number among the deletes grow alike
    deletes = deletes.withColumn("_run", F.col("_at") - F.col("_nth"))
    first = deletes.groupBy("_run").agg(F.min("_nth").alias("_first"), F.min("_at").alias("_begin"))
    batch = F.col("_begin") + F.floor((F.col("_nth") - F.col("_first")) / most) * most
    deletes = deletes.join(first, "_run").select("_at", batch.cast("long").alias("batch"))
    return placed.join(deletes, F.col("_place") == F.col("_at"), "left").drop("_place", "_at")


def overflow_bursts(arrivals: DataFrame, *, capacity: int = 1000, drained: int) -> DataFrame:
    """Bursts in which a bounded queue overflows: queue, burst (from 1), begin, end, dropped; each asks for a resync.

    ``arrivals``: queue, tick, events (one row for each tick with events). A
    tick takes in its events, drops what passes ``capacity``, and then works off
    ``drained`` events for each tick until the next one. Ticks without a drop
    end a burst. One pass over sorted rows; a queue's backlog is all that is held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queue, backlog, tick = None, 0, 0
        for batch in batches:
            out = []
            for q, t, n in zip(*(batch.column(c).to_pylist() for c in ("queue", "tick", "events")), strict=True):
                backlog = 0 if q != queue else max(0, backlog - drained * (t - tick))
                queue, tick = q, t
                out.append(max(0, backlog + n - capacity))
                backlog = min(capacity, backlog + n)
            yield batch.append_column("dropped", pa.array(out, pa.int64()))

    rows = arrivals.select("queue", F.col("tick").cast("long").alias("tick"), F.col("events").cast("long").alias("events"))
    folded = rows.repartition("queue").sortWithinPartitions("queue", "tick").mapInArrow(run, "queue string, tick long, events long, dropped long")
    w = Window.partitionBy("queue").orderBy("tick")
    calm = F.sum((F.col("dropped") == 0).cast("int")).over(w)
    bursts = folded.withColumn("calm", calm).where("dropped > 0").groupBy("queue", "calm")
    bursts = bursts.agg(F.min("tick").alias("begin"), F.max("tick").alias("end"), F.sum("dropped").alias("dropped"))
    return bursts.select("queue", F.row_number().over(Window.partitionBy("queue").orderBy("begin")).alias("burst"), "begin", "end", "dropped")


def retries(failures: DataFrame, *, base: float = 0.1, budget: int = 5) -> DataFrame:
    """When each failed mutation (path, seq, ts) is tried again: attempt (from 1), delay in seconds, due; null once the budget is spent."""
    attempt = F.row_number().over(Window.partitionBy("path").orderBy("ts", "seq"))
    rows = failures.withColumn("attempt", attempt)
    delay = F.when(F.col("attempt") <= budget, F.lit(base) * F.pow(F.lit(2.0), F.col("attempt") - 1))
    return rows.withColumn("delay", delay).withColumn("due", F.timestamp_micros(F.unix_micros("ts") + (F.col("delay") * 1e6).cast("long")))


def follow_ups(changes: DataFrame, processing: DataFrame) -> DataFrame:
    """One follow-up for each run of a file in which it changed: path, due (the run's end), generation (the newest seen).

    ``changes``: path, ts, generation. ``processing``: path, started, finished.
    Changes at the start are part of the run; those up to its end are not.
    """
    during = (F.col("c.path") == F.col("p.path")) & (F.col("ts") > F.col("started")) & (F.col("ts") <= F.col("finished"))
    met = changes.alias("c").join(processing.alias("p"), during).groupBy("p.path", "started", "finished")
    return met.agg(F.max("generation").alias("generation")).select("path", F.col("finished").alias("due"), "generation")


def apply_stream(mutations: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, *, batch: int = 64):
    """Runs ``apply`` on each micro-batch in priority order; idempotent appliers give exactly-once results.

    Deletes come with the number of their batch of at most ``batch``.
    """

    def each(df: DataFrame, epoch: int) -> None:
        numbered_ = delete_batches(df.withColumn("operation", F.col("event_type")), batch).drop("operation")
        apply(numbered_.orderBy(priority(F.col("event_type")), "seq"), epoch)

    return mutations.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
