"""Checks that give rows: references, order, sets, journals, replay."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def dangling(child: DataFrame, key: str, parent: DataFrame, parent_key: str, rule: str) -> DataFrame:
    """``rule, key_value`` of references that no parent row answers; null references are none."""
    c = child.select(F.col(key).alias("key_value")).where("key_value is not null").distinct()
    return c.join(parent.select(F.col(parent_key).alias("key_value")), "key_value", "left_anti").select(F.lit(rule).alias("rule"), F.col("key_value").cast("string").alias("key_value"))


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def key_counts(df: DataFrame, key: str, kind: str) -> DataFrame:
    """Rows, distinct keys and repeated keys of a table."""
    g = df.groupBy(key).agg(F.count("*").alias("_n"))
    return g.agg(F.lit(kind).alias("kind"), F.coalesce(F.sum("_n"), F.lit(0)).alias("n_rows"), F.count(key).alias("n_keys"), F.count_if(F.col("_n") > 1).alias("n_repeated_keys")).select("kind", "n_rows", "n_keys", "n_repeated_keys")


def set_difference(a: DataFrame, b: DataFrame, keys: list[str], item: str) -> DataFrame:
    """Per key: items only in a, only in b, in both, and whether anything changed."""
    x = a.select(*keys, item).distinct().withColumn("_a", F.lit(1))
    y = b.select(*keys, item).distinct().withColumn("_b", F.lit(1))
    j = x.join(y, [*keys, item], "full_outer").groupBy(*keys).agg(
        F.count_if(F.col("_b").isNull()).alias("n_removed"), F.count_if(F.col("_a").isNull()).alias("n_added"), F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("n_kept")
    )
    return j.withColumn("changed", (F.col("n_removed") > 0) | (F.col("n_added") > 0))


def out_of_order(rows: DataFrame, group: str, order: list[str], number: str, ident: str) -> DataFrame:
    """Rows whose number is not above that of the numbered row before them."""
    w = W.partitionBy(group).orderBy(*order)
    n = rows.where(F.col(number).isNotNull()).withColumn("_prev", F.lag(number).over(w))
    return n.where(F.col(number) <= F.col("_prev")).select(group, ident, number, F.col("_prev").alias("previous_number"))


def missing_numbers(rows: DataFrame, group: str, number: str, most: int = 10_000) -> DataFrame:
    """Gaps between the distinct numbers of a group, as ranges ``first_missing, last_missing``.

    Groups with an unnumbered row have none. A gap is never expanded; groups
    that miss more than ``most`` numbers are marked.
    """
    full = rows.groupBy(group).agg(F.count_if(F.col(number).isNull()).alias("_u")).where("_u = 0").select(group)
    d = rows.join(full, group, "left_semi").select(group, number).distinct()
    nxt = F.lead(number).over(W.partitionBy(group).orderBy(number))
    g = d.withColumn("_next", nxt).where(F.col("_next") - F.col(number) > 1).select(group, (F.col(number) + 1).alias("first_missing"), (F.col("_next") - 1).alias("last_missing"))
    total = F.sum(F.col("last_missing") - F.col("first_missing") + 1).over(W.partitionBy(group))
    return g.withColumn("n_missing", total).withColumn("too_many", F.col("n_missing") > most)


def overall(statuses: Column) -> Column:
    """FAIL when any failed, PASS when all passed, else UNRESOLVED, from an aggregated array of statuses."""
    return F.when(F.array_contains(statuses, "FAIL"), "FAIL").when(F.forall(statuses, lambda s: s == "PASS"), "PASS").otherwise("UNRESOLVED")


def retry_chains(attempts: DataFrame, ident: str, parent: str) -> DataFrame:
    """Root and depth of every attempt along its chain of ``retry_of`` references, however long.

    Pointer doubling: each round a row looks up the root of its root, so
    chains of length n need log n joins. A reference to nothing is a root of
    its own; rows whose chain ends in a circle have neither root nor depth.
    """
    from quillspan.plans.session import cut_lineage

    a = attempts.select(F.col(ident).alias("id"), F.col(parent).alias("up")).where("id is not null").groupBy("id").agg(F.min("up").alias("up"))
    known = a.select(F.col("id").alias("up"), F.lit(True).alias("_known"))
    cur = cut_lineage(a.join(known, "up", "left").select("id", F.when(F.col("_known"), F.col("up")).otherwise(F.col("id")).alias("root"), F.when(F.col("_known"), 1).otherwise(0).alias("depth")))
    rows, reach = cur.count(), 1
    while reach < rows:
        look = cur.select(F.col("id").alias("root"), F.col("root").alias("_r"), F.col("depth").alias("_d"))
        step = cut_lineage(cur.join(look, "root").select("id", F.col("_r").alias("root"), (F.col("depth") + F.col("_d")).alias("depth"), (F.col("_d") > 0).alias("_moved")))
        cur = step.drop("_moved")
        if step.where("_moved").isEmpty():
            break
        reach *= 2
    # After as many steps as there are rows a chain stands at its root, unless it runs in a circle.
    ends = cur.where("depth = 0").select(F.col("id").alias("root"), F.lit(True).alias("_end"))
    out = cur.join(ends, "root", "left").select("id", F.when(F.col("_end"), F.col("root")).alias("root"), F.when(F.col("_end"), F.col("depth")).alias("depth"))
    return out.withColumnsRenamed({"id": ident})


def runs(events: DataFrame, group: list[str], order: list[str], flag: Column) -> DataFrame:
    """Consecutive runs of rows with a true flag: ``group, run_no, n_rows`` (gaps and islands)."""
    w = W.partitionBy(*group).orderBy(*order)
    e = events.withColumn("_f", F.coalesce(flag, F.lit(False)))
    e = e.withColumn("_island", F.sum(F.when(~F.col("_f"), 1).otherwise(0)).over(w.rowsBetween(W.unboundedPreceding, W.currentRow)))
    return e.where("_f").groupBy(*group, "_island").agg(F.count("*").alias("n_rows")).withColumn("run_no", F.row_number().over(W.partitionBy(*group).orderBy("_island"))).drop("_island")


def pending(tasks: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Tasks without a result: what an interrupted run has left to do."""
    return tasks.join(done.select(key).distinct(), key, "left_anti")


def replay_differs(stored: DataFrame, recomputed: DataFrame) -> DataFrame:
    """Rows in which a stored table and its recomputation differ, with the side they stand on."""
    cols = sorted(stored.columns)
    a, b = stored.select(*cols), recomputed.select(*cols)
    return a.exceptAll(b).withColumn("side", F.lit("stored")).unionByName(b.exceptAll(a).withColumn("side", F.lit("recomputed")))


def best_match(candidates: DataFrame, entries: DataFrame, on: list[str], rank: list[str]) -> DataFrame:
    """Entries of the best-ranked candidate that has any, with ``is_ambiguous`` when it has several."""
    j = candidates.join(entries, on)
    first = j.agg(F.min(F.struct(*rank)).alias("_best"))
    top = j.join(F.broadcast(first), F.struct(*[F.col(r) for r in rank]) == F.col("_best")).drop("_best")
    n = top.agg(F.count("*").alias("_n"))
    return top.crossJoin(F.broadcast(n)).withColumn("is_ambiguous", F.col("_n") > 1).drop("_n")


def divides(need: DataFrame, have: DataFrame, key: str, item: str) -> DataFrame:
    """Keys all of whose needed items are had (relational division)."""
    missing = need.select(key, item).distinct().join(have.select(key, item).distinct(), [key, item], "left_anti").select(key).distinct()
    return need.select(key).distinct().join(missing, key, "left_anti")
