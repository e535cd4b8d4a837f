"""Streams over the driver's event files, drained to a table and compared with the batch answer."""

from __future__ import annotations

from functools import partial

from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from dayslice.functions import columns as C
from dayslice.operators import load
from dayslice.session import new_dir
from dayslice.sources.writers import read_buckets
from dayslice.streaming import streams

from . import recipes as R
from .recipes import with_tables
from .registry import query


def _events(spark, sf):
    """The event file as a stream; the pattern matches that one file."""
    schema = R.table(spark, sf, "events").schema
    return streams.stream_landing(spark, f"{sf}/event[s].parquet", schema)


def _text(c: str):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


@query("stream_landing", "SELECT event_type, COUNT(*) AS n FROM events GROUP BY 1")
def stream_landing(spark, sf):
    rows = streams.drain(_events(spark, sf).select("event_id", "event_type"), "landing")
    return rows.groupBy("event_type").agg(F.count("*").alias("n"))


def _in_turn(spark, tables, label):
    """A stream over a folder, and for each table what lands it there; a table of many files is still one batch."""
    root = new_dir(spark, label)
    landings = [partial(table.write.parquet, f"{root}/{i}") for i, table in enumerate(tables)]
    return streams.stream_landing(spark, f"{root}/*", tables[0].schema), landings


@query("stream_dedup", "SELECT event_type, COUNT(*) AS n, CAST(SUM(event_id) AS BIGINT) AS ids FROM events GROUP BY 1")
def stream_dedup(spark, sf):
    """Four landings by age, each with its own events and once more those of the one before: a copy is known, or the watermark has passed it."""
    events = R.table(spark, sf, "events").select("event_id", "ts", "event_type")
    age = F.least(F.floor(F.datediff("ts", F.lit("2024-01-01").cast("date")) / 8), F.lit(3))
    tables = [events.where(age.isin(i, max(0, i - 1))).unionByName(events.where(age == i).limit(100)) for i in range(4)]
    stream, landings = _in_turn(spark, tables, "twice")
    rows = streams.drain_landings(streams.stream_dedup(stream, ["event_id"], "ts"), landings, "dedup")
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


def _metrics(spark, sf, frame, label):
    events = _events(spark, sf).select("ts", "event_type", C.money("value").alias("value"))
    aggs = [F.count("*").alias("n"), F.sum("value").alias("total")]
    out = streams.stream_metrics(events, "ts", frame, ["event_type"], aggs)
    rows = streams.drain_complete(out, label)
    return rows.withColumns({"window_start": _text("window_start"), "window_end": _text("window_end")})


_SUMS = "event_type, COUNT(*) AS n, CAST(SUM(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total"


@query(
    "stream_tumbling",
    f"""SELECT strftime(time_bucket(INTERVAL 6 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS window_start,
  strftime(time_bucket(INTERVAL 6 HOUR, ts) + INTERVAL 6 HOUR, '%Y-%m-%d %H:%M:%S') AS window_end, {_SUMS}
FROM events GROUP BY ALL""",
)
def stream_tumbling(spark, sf):
    return _metrics(spark, sf, streams.tumbling("ts", "6 hours"), "tumbling")


@query(
    "stream_sessions",
    f"""SELECT strftime(MIN(ts), '%Y-%m-%d %H:%M:%S') AS window_start,
  strftime(MAX(ts) + INTERVAL 10 MINUTE, '%Y-%m-%d %H:%M:%S') AS window_end, {_SUMS}
FROM (SELECT *, SUM(is_new) OVER (PARTITION BY event_type ORDER BY ts) AS session FROM (
  SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY event_type ORDER BY ts) < INTERVAL 10 MINUTE THEN 0 ELSE 1 END AS is_new
  FROM events)) GROUP BY event_type, session""",
)
def stream_sessions(spark, sf):
    """Five keys only: sessions are merged where the rows are before the few keys meet in a task."""
    with streams.local_sessions(spark):
        return _metrics(spark, sf, streams.session_of("ts", "10 minutes"), "sessions")


#: Rows of the first six days that land more than two weeks late.
_TOO_LATE = "ts < TIMESTAMP '2024-01-07' AND event_id % 101 = 0"


def _landed(spark, sf):
    """Events in five landings by age; one row in seven lands one late, a few of the first days only in the last one.

    A sixth landing holds one event of the far future, which moves the watermark past all windows.
    """
    events = R.table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type", C.money("value").alias("value"))
    age = F.floor(F.datediff("ts", F.lit("2024-01-01").cast("date")) / 6)
    late = F.when(F.expr(_TOO_LATE), F.lit(4)).otherwise(age + (F.col("event_id") % 7 == 0).cast("int"))
    tables = [events.where(F.least(late, F.lit(4)) == i) for i in range(5)]
    last = events.limit(1).withColumns({"ts": F.lit("2100-01-01 00:00:00").cast(events.schema["ts"].dataType), "event_type": F.lit("end")})
    return _in_turn(spark, [*tables, last], "landed")


def _appended(spark, sf, frame, keys, label):
    """Windows written once the watermark has passed them; their state is then freed."""
    aggs = [F.count("*").alias("n"), F.sum("value").alias("total")]
    stream, landings = _landed(spark, sf)
    out = streams.stream_metrics(stream, "ts", frame, keys, aggs, delay="8 days")
    rows = streams.drain_landings(out, landings, label).where("window_end < TIMESTAMP '2100-01-01'")
    return rows.withColumns({"window_start": _text("window_start"), "window_end": _text("window_end")})


@query(
    "stream_tumbling_append",
    f"""SELECT strftime(time_bucket(INTERVAL 6 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS window_start,
  strftime(time_bucket(INTERVAL 6 HOUR, ts) + INTERVAL 6 HOUR, '%Y-%m-%d %H:%M:%S') AS window_end, {_SUMS}
FROM events WHERE NOT ({_TOO_LATE}) GROUP BY ALL""",
)
def stream_tumbling_append(spark, sf):
    """Six landings; late rows inside the delay count, those beyond it do not."""
    return _appended(spark, sf, streams.tumbling("ts", "6 hours"), ["event_type"], "tumbling-append")


@query(
    "stream_sliding",
    f"""SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS window_start,
  strftime(s + INTERVAL 2 DAY, '%Y-%m-%d %H:%M:%S') AS window_end, {_SUMS}
FROM (SELECT *, date_trunc('day', ts) - to_days(CAST(unnest(range(2)) AS INTEGER)) AS s FROM events WHERE NOT ({_TOO_LATE})) GROUP BY ALL""",
)
def stream_sliding(spark, sf):
    """Each row counts in two windows, which are appended once the watermark has passed them."""
    return _appended(spark, sf, streams.tumbling("ts", "2 days", "1 day"), ["event_type"], "sliding-append")


@query(
    "stream_sessions_by_user",
    f"""SELECT strftime(MIN(ts), '%Y-%m-%d %H:%M:%S') AS window_start,
  strftime(MAX(ts) + INTERVAL 30 MINUTE, '%Y-%m-%d %H:%M:%S') AS window_end, user_id, COUNT(*) AS n,
  CAST(SUM(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total
FROM (SELECT *, SUM(is_new) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM (
  SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS is_new
  FROM events WHERE NOT ({_TOO_LATE}))) GROUP BY user_id, session""",
)
def stream_sessions_by_user(spark, sf):
    return _appended(spark, sf, streams.session_of("ts", "30 minutes"), ["user_id"], "sessions-append")


@query(
    "stream_cdc",
    with_tables(
        """SELECT user_id, event_id, CAST(amount AS DOUBLE) AS amount, strftime(updated_at, '%Y-%m-%d %H:%M:%S.%f') AS updated_at
FROM (SELECT * FROM changes_v QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY updated_at DESC) = 1) WHERE op <> 'D'""",
        "changes_v",
    ),
)
def stream_cdc(spark, sf):
    """The change log applied in micro-batches."""
    path, state = new_dir(spark, "stream_cdc"), new_dir(spark, "stream_cdc-state")
    batch = R.changes_v(spark, sf)
    log = _events(spark, sf)
    op = F.when(F.col("event_type") == "error", F.lit("D")).otherwise(F.lit("U"))
    changes = log.select(
        "user_id", "event_id", C.money("value").alias("amount"), op.alias("op"), F.col("ts").alias("updated_at")
    ).select(batch.columns)
    empty = spark.createDataFrame([], changes.schema)

    def merge(old, new):
        return load.merge_changes(old, new, ["user_id"], ["updated_at"])

    streams.foreach_batch_upsert(
        changes, path, state, "user_id", merge, lambda first: merge(empty, first), 16
    ).awaitTermination()
    table = load.live(read_buckets(spark, path))
    return table.withColumn("updated_at", F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


class _Stopped(RuntimeError):
    pass


@query(
    "stream_counter_upsert",
    "SELECT user_id, COUNT(*) AS n, CAST(SUM(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total FROM events GROUP BY 1",
)
def stream_counter_upsert(spark, sf):
    """Counters that add up over micro-batches. The stream dies after the write of its second batch, which is then delivered again."""
    root, path, state = new_dir(spark, "landed"), new_dir(spark, "counters"), new_dir(spark, "counters-state")
    events = R.table(spark, sf, "events").select("event_id", "user_id", C.money("value").alias("value"))
    # Four files, in four batches.
    events.repartitionByRange(4, "event_id").write.parquet(f"{root}/all")
    stream = streams.stream_landing(spark, f"{root}/*", events.schema, files_per_batch=1)

    def count(batch):
        return batch.groupBy("user_id").agg(F.count("*").alias("n"), F.sum("value").cast("decimal(28,2)").alias("total"))

    def merge(old, new):
        return old.unionByName(new).groupBy("user_id").agg(F.sum("n").alias("n"), F.sum("total").cast("decimal(28,2)").alias("total"))

    def die(batch_id):
        if batch_id == 1:
            raise _Stopped("after the write of batch 1")

    for applied in (die, None):
        run = streams.foreach_batch_upsert(
            stream, path, state, "user_id", lambda old, new: merge(old, count(new)), count, 8, applied
        )
        try:
            run.awaitTermination()
        except StreamingQueryException:
            assert applied is not None
    return read_buckets(spark, path)
