"""Ranking, scoring, sampling and paging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspan.functions import text as fx


def fuse_ranks(signals: DataFrame, k: int = 60, scale: int = 1_000_000) -> DataFrame:
    """Reciprocal-rank fusion of signals ``(seq, provider, query, url, title, global_rank)``.

    A provider, query and URL count once, first seen (lowest ``seq``); titles
    are compared in one form without letter case; points are ``scale div (k +
    rank)``. Ordered by score, then title; ``rank`` numbers the order.
    """
    s = signals.withColumn("_title", fx.work_title(F.col("title"))).where("_title <> ''")
    s = s.groupBy("provider", "query", "url").agg(F.min_by(F.struct("seq", "title", "_title", "global_rank"), "seq").alias("_s")).select("_s.*")
    s = s.withColumn("canonical_title", F.lower("_title")).withColumn("_points", F.expr(f"{scale} div ({k} + global_rank)"))
    g = s.groupBy("canonical_title").agg(
        F.sum("_points").alias("score"), F.count("*").alias("n_signals"), F.min_by("_title", "seq").alias("shown_title"), F.array_sort(F.collect_set(F.trim("title"))).alias("_raw")
    )
    g = g.withColumn("aliases", F.array_join(F.filter("_raw", lambda t: t != F.col("shown_title")), "|")).drop("_raw")
    # The ranking itself is one short table: a row per title, numbered over range-partitioned order.
    return numbered(g, [F.col("score").desc(), F.col("canonical_title")], "rank")


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Row numbers over a total order without one task for all rows.

    Rows are range-partitioned by the order; each partition numbers its own
    rows and adds the rows of the partitions before it.
    """
    # The sorted order is materialised once: it must not be recomputed between counting and numbering.
    from quillspan.plans.session import cut_lineage

    s = cut_lineage(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()))
    sizes = s.groupBy("_p").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    local = F.row_number().over(W.partitionBy("_p").orderBy(*order))
    return s.join(F.broadcast(before), "_p").withColumn(name, (local + F.col("_before")).cast("bigint")).drop("_p", "_before")


def precision_recall(tp: Column, predicted: Column, gold: Column) -> list[Column]:
    """Precision, recall and F1; null where the denominator is 0."""
    p, r = fx.ratio(tp, predicted), fx.ratio(tp, gold)
    return [F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(fx.ratio(2 * tp, predicted + gold), 6).alias("f1")]


def score_sets(predicted: DataFrame, gold: DataFrame, unit: str, item: str) -> DataFrame:
    """Per unit: true positives of predicted against gold items, with precision and recall."""
    p = predicted.select(unit, item).distinct().withColumn("_p", F.lit(1))
    g = gold.select(unit, item).distinct().withColumn("_g", F.lit(1))
    j = p.join(g, [unit, item], "full_outer").groupBy(unit).agg(F.count("_p").alias("n_predicted"), F.count("_g").alias("n_gold"), F.count_if(F.col("_p").isNotNull() & F.col("_g").isNotNull()).alias("n_both"))
    return j.select(unit, "n_predicted", "n_gold", "n_both", *precision_recall(F.col("n_both"), F.col("n_predicted"), F.col("n_gold")))


def capacity(records: DataFrame, unit: str, kind: str, payload: str) -> DataFrame:
    """Raw, unit-local and global distinct payloads per kind and overall, duplicates, and payloads in several units.

    Rates are 0 where nothing stands below the line. Aggregated in two steps
    so that no distinct set is held whole.
    """
    per = records.groupBy(kind, unit, payload).agg(F.count("*").alias("n"))
    glob = per.groupBy(kind, payload).agg(F.sum("n").alias("n"), F.count("*").alias("units"))
    both = glob.groupingSets([[F.col(kind)], []], kind).agg(F.sum("n").alias("n_raw"), F.sum("units").alias("n_unit_distinct"), F.count("*").alias("n_global_distinct"), F.count_if(F.col("units") > 1).alias("n_in_several_units"))
    dup = F.col("n_raw") - F.col("n_unit_distinct")
    return both.withColumn("n_duplicates", dup).withColumn("duplicate_rate", F.round(fx.ratio(dup, F.col("n_raw"), 0.0), 6)).withColumn(kind, F.coalesce(kind, F.lit("(all)")))


def upper_median(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """Element n div 2 (from 0) of each group's sorted values, from counts per value instead of a list of all rows."""
    per = df.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("_c"))
    w = W.partitionBy(*group).orderBy(value) if group else W.orderBy(value)
    whole = W.partitionBy(*group) if group else W.partitionBy(F.lit(1))
    per = per.withColumn("_upto", F.sum("_c").over(w.rowsBetween(W.unboundedPreceding, W.currentRow))).withColumn("_n", F.sum("_c").over(whole))
    hit = per.where(F.col("_upto") > F.floor(F.col("_n") / 2))
    return hit.groupBy(*group).agg(F.min(value).alias("upper_median"), F.max("_n").alias("n_values"))


def stratified_sample(items: DataFrame, group: str, order: list[str], ident: str, strata: int = 5, per_stratum: int = 2, all_up_to: int = 13, seed: str = "") -> DataFrame:
    """Endpoints, middle and the lowest-hash members of contiguous strata; short lists whole.

    Item j (from 0) of n lies in stratum ``(strata*(j+1)-1) div n``.
    """
    w = W.partitionBy(group).orderBy(*order, ident)
    t = items.withColumn("_j", F.row_number().over(w) - 1).withColumn("_n", F.count("*").over(W.partitionBy(group)))
    t = t.withColumn("stratum", F.floor((strata * (F.col("_j") + 1) - 1) / F.col("_n")).cast("int"))
    fixed = (F.col("_n") <= all_up_to) | (F.col("_j") == 0) | (F.col("_j") == F.floor(F.col("_n") / 2)) | (F.col("_j") == F.col("_n") - 1)
    t = t.withColumn("_fixed", fixed)
    h = F.sha2(F.concat_ws("|", F.lit(seed), F.col(group), F.col("stratum").cast("string"), F.col(ident)).cast("binary"), 256)
    t = t.withColumn("_r", F.row_number().over(W.partitionBy(group, "stratum", "_fixed").orderBy(h, ident)))
    return t.where(F.col("_fixed") | (F.col("_r") <= per_stratum)).withColumn("position", F.col("_j") + 1).drop("_j", "_n", "_fixed", "_r")


def seeded_pick(items: DataFrame, group: str, ident: str, seed: str, algorithm: str = "lowest-hash") -> DataFrame:
    """The member of each group with the lowest seeded hash."""
    h = F.sha2(F.concat_ws("\u0001", F.lit(seed), F.lit(algorithm), F.col(group).cast("string"), F.col(ident)).cast("binary"), 256)
    return items.groupBy(group).agg(F.min_by(ident, F.struct(h.alias("h"), F.col(ident).alias("i"))).alias(ident))


def page(df: DataFrame, order: list, offset: int, limit: int) -> DataFrame:
    """A page of an ordered result with ``next_offset`` (null on the last page).

    One row more than the page is read to tell whether more follow.
    """
    if not 0 <= offset <= 100_000 or not 1 <= limit <= 1000:
        raise ValueError("offset lies in 0..100000, limit in 1..1000")
    top = df.orderBy(*order).offset(offset).limit(limit + 1)
    w = W.orderBy(*order)
    t = top.withColumn("_i", F.row_number().over(w))
    more = t.agg(F.max("_i").alias("_m"))
    return t.where(F.col("_i") <= limit).crossJoin(F.broadcast(more)).withColumn("next_offset", F.when(F.col("_m") > limit, F.lit(offset + limit)).cast("int")).drop("_i", "_m")
