"""Event journals: batch folds and their streaming form."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def fold(events: DataFrame, entity: str, kind: str, at: str, order: list[str], value: str) -> DataFrame:
    """State of each entity after its whole journal: events, last kind and time, sums per kind.

    The last event is taken by aggregation over the ordering columns, so hot
    entities combine map-side and are never sorted whole.
    """
    last = F.max_by(F.struct(kind, at), F.struct(*order)).alias("_last")
    g = events.groupBy(entity).agg(F.count("*").alias("n_events"), F.countDistinct(kind).alias("n_kinds"), F.sum(F.coalesce(value, F.lit(0.0))).alias("total"), last)
    return g.select(entity, "n_events", "n_kinds", "total", F.col(f"_last.{kind}").alias("last_kind"), F.col(f"_last.{at}").alias("last_at"))


def illegal_steps(events: DataFrame, entity: str, kind: str, order: list[str], legal: list[tuple[str | None, str]]) -> DataFrame:
    """Events that may not follow the one before them; ``None`` stands for the beginning."""
    w = W.partitionBy(entity).orderBy(*order)
    e = events.withColumn("previous_kind", F.lag(kind).over(w))
    ok = F.lit(False)
    for a, b in legal:
        ok = ok | ((F.col("previous_kind").isNull() if a is None else F.col("previous_kind") == a) & (F.col(kind) == b))
    return e.where(~F.coalesce(ok, F.lit(False)))


STATE = "n_events long, total double, last_kind string, last_at timestamp"


def fold_stream(events: DataFrame, entity: str, kind: str, at: str, value: str, late: str = "1 hour") -> DataFrame:
    """The fold as a stateful stream: an updated row for each entity that a batch touches.

    State is a few values per entity, whatever the length of its journal;
    events later than the watermark are dropped by Spark.
    """

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, total, last_kind, last_at = state.get if state.exists else (0, 0.0, None, None)
        for pdf in batches:
            n += len(pdf)
            total += float(pdf[value].fillna(0.0).sum())
            newest = pdf.sort_values([at, kind]).iloc[-1]
            if last_at is None or newest[at].to_pydatetime() >= last_at:
                last_kind, last_at = newest[kind], newest[at].to_pydatetime()
        state.update((n, total, last_kind, last_at))
        yield pd.DataFrame({entity: [key[0]], "n_events": [n], "total": [total], "last_kind": [last_kind], "last_at": [last_at]})

    kind_of = dict(events.dtypes)[entity]
    return events.withWatermark(at, late).groupBy(entity).applyInPandasWithState(step, f"{entity} {kind_of}, {STATE}", STATE, "update", GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, at: str, kind: str, size: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Events per time window and kind; works on tables and on streams with late data up to the watermark."""
    e = events.withWatermark(at, late) if events.isStreaming else events
    return e.groupBy(F.window(at, size), kind).agg(F.count("*").alias("n")).select(F.col("window.start").alias("window_start"), kind, "n")
