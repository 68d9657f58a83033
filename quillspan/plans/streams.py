"""Queries over event journals."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspan.streaming import journal

from .registry import Registry
from .session import shared_folder, table

query = Registry()
QUERIES, SQL = query.queries, query.sql


def _events(spark, d):
    return table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query("agg10_journal_fold", "select user_id, count(*) as n_events, count(distinct event_type) as n_kinds, round(sum(coalesce(value, 0)), 4) as total, arg_max(event_type, struct_pack(t := ts, e := event_id)) as last_kind from events group by user_id")
def agg10(spark, d):
    """State of each user after the whole journal."""
    out = journal.fold(_events(spark, d), "user_id", "event_type", "ts", ["ts", "event_id"], "value")
    return out.select("user_id", "n_events", "n_kinds", F.round("total", 4).alias("total"), "last_kind")


@query("stf3_illegal_steps", "with e as (select event_id, user_id, event_type, lag(event_type) over (partition by user_id order by ts, event_id) as p from events) select event_id, user_id, event_type, p as previous_kind from e where p = event_type or p is null and event_type not in ('signup', 'view')")
def stf3(spark, d):
    """Events that may not follow the one before them: journals begin with a sign-up or a view, and no kind follows itself."""
    kinds = ("signup", "view", "click", "purchase", "error")
    legal = [(None, "signup"), (None, "view"), *((a, b) for a in kinds for b in kinds if a != b)]
    return journal.illegal_steps(_events(spark, d), "user_id", "event_type", ["ts", "event_id"], legal).select("event_id", "user_id", "event_type", "previous_kind")


@query("stm1_windowed_counts", "select time_bucket(interval '1 hour', ts) as window_start, event_type, count(*) as n from events group by 1, 2")
def stm1(spark, d):
    """Events per hour and kind."""
    return journal.windowed_counts(_events(spark, d), "ts", "event_type").withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("stm2_stream_fold", "select user_id, count(*) as n_events, round(sum(coalesce(value, 0)), 4) as total from events group by user_id")
def stm2(spark, d):
    """The journal fold run as a stream over the events to its end; the last state of each user."""
    import uuid

    schema = spark.read.parquet(f"{d}/events.parquet").schema
    from pathlib import Path

    path = Path(f"{d}/events.parquet")
    source = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(str(path) if path.is_dir() else f"{d}/events.parquet*")
    source = source.withColumn("ts", F.col("ts").cast("timestamp")).select("user_id", "event_type", "ts", "value")
    place = f"{shared_folder(spark)}/fold_{uuid.uuid4().hex}"

    def keep(batch, number):
        batch.write.mode("overwrite").parquet(f"{place}/states/batch={number}")

    stream = journal.fold_stream(source, "user_id", "event_type", "ts", "value", "36500 days")
    run = stream.writeStream.outputMode("update").foreachBatch(keep).trigger(availableNow=True).option("checkpointLocation", f"{place}/log").start()
    run.awaitTermination()
    # Of each user the update of the latest batch holds.
    states = spark.read.schema(stream.schema).parquet(f"{place}/states")
    return states.groupBy("user_id").agg(F.max_by(F.struct("n_events", "total"), "n_events").alias("s")).select("user_id", "s.n_events", F.round("s.total", 4).alias("total"))
