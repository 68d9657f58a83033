"""Deduplication, reduction and merging."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspan.functions import ids
from quillspan.functions import text as fx


def first_seen(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in an explicit order (aggregated map-side, no sort of whole groups)."""
    rest = [c for c in df.columns if c not in keys]
    ranked = F.struct(*[F.col(o).alias(f"_o{i}") if isinstance(o, str) else o.alias(f"_o{i}") for i, o in enumerate(order)], *[F.col(c).alias(f"_v{i}") for i, c in enumerate(rest)])
    small = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), ranked).alias("_r")) if rest else df.distinct()
    return small.select(*keys, "_r.*") if rest else small


def chapter_hashes(segments: DataFrame, chapter: list[str], order: list[str], hash_col: str) -> DataFrame:
    """Hash of the ordered segment hashes of each chapter (boundaries count)."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct(*order, hash_col))), lambda x: x[hash_col])
    return segments.groupBy(*chapter).agg(F.sha2(F.array_join(parts, "|").cast("binary"), 256).alias("content_hash"))


def exact_duplicates(chapters: DataFrame, group: list[str], order: list[str], ident: str) -> DataFrame:
    """Adds ``duplicate_of``: the first chapter of the group with the same content, null for the first itself."""
    keys = [*group, "content_hash"]
    first = chapters.groupBy(*keys).agg(F.min_by(ident, F.struct(*order, ident)).alias("_first"))
    j = chapters.join(first, keys)
    return j.withColumn("duplicate_of", F.when(F.col("_first") != F.col(ident), F.col("_first"))).drop("_first")


def body_groups(bodies: DataFrame, ident: str, text: str) -> DataFrame:
    """Groups of two or more bodies that are equal without white space: ``body_hash, n_members, members``."""
    h = bodies.select(ident, F.sha2(F.regexp_replace(F.col(text), fx.SPACE, "").cast("binary"), 256).alias("body_hash"))
    return h.groupBy("body_hash").agg(F.count("*").alias("n_members"), F.array_join(F.array_sort(F.collect_list(ident)), ",").alias("members")).where("n_members > 1")


def reduce_payloads(observations: DataFrame, payload: str, ident: str, span: list[str]) -> DataFrame:
    """Exact-payload reduction: one record per payload with its members and distinct spans, sorted, and the record's hash.

    ``observations`` has a row per observation and span. Entities are never
    merged: only byte-equal payloads are one record.
    """
    g = observations.groupBy(payload).agg(F.array_sort(F.collect_set(ident)).alias("members"), F.array_sort(F.collect_set(F.struct(*span))).alias("spans"))
    return g.withColumn("record_hash", ids.object_hash(F.to_json(F.struct(F.col("members"), F.col(payload).alias("payload"), F.col("spans")))))


REDUCERS = {"exact-payload": reduce_payloads}


def reducer(name: str):
    """A registered reduction by name."""
    if name not in REDUCERS:
        raise KeyError(f"no reducer {name}; known: {', '.join(sorted(REDUCERS))}")
    return REDUCERS[name]


def repeated_in_unit(observations: DataFrame, unit: str, payload: str) -> DataFrame:
    """Payloads that stand more than once in a unit: ``unit, payload, n``."""
    return observations.groupBy(unit, payload).agg(F.count("*").alias("n")).where("n > 1")


def occurrences(labels: DataFrame, unit: str, payload: str, order: list[str]) -> DataFrame:
    """Labels numbered within their unit and payload, in order, with the number of labels of the payload."""
    w = W.partitionBy(unit, payload).orderBy(*order)
    return labels.withColumn("occurrence", F.row_number().over(w)).withColumn("n_occurrences", F.count("*").over(W.partitionBy(unit, payload)))


def merge_surfaces(items: DataFrame, key: Column, surface: str, source: str) -> DataFrame:
    """Items of one identity as one: sorted unions of surface forms and provenance."""
    return items.groupBy(key.alias("identity")).agg(F.array_join(F.array_sort(F.collect_set(surface)), "|").alias("surfaces"), F.array_join(F.array_sort(F.collect_set(source)), "|").alias("sources"), F.count("*").alias("n_items"))


def complete_link(candidates: list[dict], linked) -> list[list[int]]:
    """Greedy complete-link grouping in order: a candidate joins the first group all of whose members it is linked with."""
    groups: list[list[int]] = []
    for i, c in enumerate(candidates):
        for g in groups:
            if all(linked(candidates[j], c) for j in g):
                g.append(i)
                break
        else:
            groups.append([i])
    return groups


def _spans_meet(a: list, b: list) -> bool:
    return any(x["segment_id"] == y["segment_id"] and max(x["start_char"], y["start_char"]) < min(x["end_char"], y["end_char"]) for x in a for y in b)


def scenes_linked(a: dict, b: dict) -> bool:
    """Two candidates that share text and either say the same or share a value."""
    return _spans_meet(a["spans"], b["spans"]) and (bool(a["signature"]) and a["signature"] == b["signature"] or bool(set(a["entries"]) & set(b["entries"])))


GROUPED = "work_id string, group_no int, candidate_id string, member_no int"


def merge_scenes(candidates: DataFrame) -> DataFrame:
    """Complete-link groups of candidates ``(work_id, candidate_id, position, spans, signature, entries)``.

    Only candidates connected by shared text can group, so candidates are
    placed by connected text first: positions that no span bridges start a new
    stretch (gaps and islands per work), and each stretch is one task's group.
    ``position`` orders candidates; ``spans`` are structs of segment_id,
    segment_no, start_char and end_char.
    """
    lo = F.array_min(F.transform("spans", lambda s: s["segment_no"]))
    hi = F.array_max(F.transform("spans", lambda s: s["segment_no"]))
    c = candidates.withColumn("_lo", lo).withColumn("_hi", hi)
    w = W.partitionBy("work_id").orderBy("_lo", "position", "candidate_id")
    c = c.withColumn("_new", (F.col("_lo") > F.coalesce(F.max("_hi").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(-1))).cast("int"))
    c = c.withColumn("stretch", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, W.currentRow)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values(["position", "candidate_id"]).to_dict("records")
        for r in rows:
            r["spans"] = [dict(s) if not isinstance(s, dict) else s for s in r["spans"]]
        groups = complete_link(rows, scenes_linked)
        out = [(rows[0]["work_id"], int(rows[0]["stretch"]) * 100_000 + g, rows[i]["candidate_id"], k) for g, members in enumerate(groups) for k, i in enumerate(members)]
        return pd.DataFrame(out, columns=["work_id", "group_no", "candidate_id", "member_no"])

    return c.groupBy("work_id", "stretch").applyInPandas(run, GROUPED)


def merged_values(values: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Sorted values of a group and their status: UNKNOWN without, CONFLICTING when squashed value sets differ, else KNOWN.

    ``values`` has a row per member and value: keys, ``member`` and the value
    (null for a member without values).
    """
    per = values.groupBy(*keys, "member").agg(F.array_sort(F.collect_set(fx.squashed(F.col(value)))).alias("_s"), F.collect_set(value).alias("_v"))
    g = per.groupBy(*keys).agg(F.countDistinct(F.when(F.size("_s") > 0, F.col("_s"))).alias("_n"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("_v")))).alias("values"))
    return g.withColumn("status", F.when(F.size("values") == 0, "UNKNOWN").when(F.col("_n") > 1, "CONFLICTING").otherwise("KNOWN")).drop("_n")
