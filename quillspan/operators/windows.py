"""Overlapping character windows over ordered texts, by a closed form instead of a range join.

With offsets [a, b) of a text in its work, total T and step = W - O there are
n = 1 + ceil(max(0, T - W) / step) windows, and a text lies in windows
max(0, (a - W) div step + 1) to min(n - 1, (b - 1) div step).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType


def offsets(texts: DataFrame, work: str, chapter: str, order: list[str], length: Column, separator: int = 0) -> DataFrame:
    """Adds ``a``, ``b`` (offsets in the work, half open) and ``total``.

    Two-level prefix sum: chapters are summed first, so no task holds more
    than the chapters of one work or the texts of one chapter, even when one
    work holds a third of all rows. Texts of length 0 take no room, nor a
    separator.
    """
    t = texts.withColumn("_n", length).where("_n > 0")
    per = t.groupBy(work, chapter).agg(F.sum(F.col("_n") + separator).alias("_chapter_room"))
    upto = W.partitionBy(work).orderBy(chapter).rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(work)
    per = per.withColumn("_before", F.coalesce(F.sum("_chapter_room").over(upto), F.lit(0))).withColumn("total", F.sum("_chapter_room").over(whole) - separator)
    inner = W.partitionBy(work, chapter).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    t = t.join(per.drop("_chapter_room"), [work, chapter])
    a = F.col("_before") + F.coalesce(F.sum(F.col("_n") + separator).over(inner), F.lit(0))
    return t.withColumn("a", a).withColumn("b", F.col("a") + F.col("_n")).drop("_before", "_n")


def window_spans(placed: DataFrame, window: int, overlap: int) -> DataFrame:
    """One row per window and text: ``k`` (from 0) and the clipped span ``[start_char, end_char)`` of the text."""
    step = window - overlap
    if not 0 <= overlap < window:
        raise ValueError("the overlap must be at least 0 and less than the window")
    n = 1 + F.ceil(F.greatest(F.lit(0), F.col("total") - window) / step)
    first = F.greatest(F.lit(0), F.floor((F.col("a") - window) / step) + 1)
    last = F.least(n - 1, F.floor((F.col("b") - 1) / step))
    p = placed.withColumn("_k0", first).withColumn("_k1", last).where("_k1 >= _k0")
    p = p.withColumn("k", F.explode(F.sequence("_k0", "_k1"))).drop("_k0", "_k1")
    start = F.greatest(F.col("k") * step, F.col("a")) - F.col("a")
    end = F.least(F.col("k") * step + window, F.col("b")) - F.col("a")
    return p.withColumn("start_char", start.cast("int")).withColumn("end_char", end.cast("int")).where("start_char < end_char")


def coverage_gaps(spans: DataFrame, key: str, start: str, end: str, length: str) -> DataFrame:
    """Parts of each keyed text that no span covers: ``key, gap_start, gap_end``.

    ``spans`` has a row with null start for a text without any span.
    """
    w = W.partitionBy(key).orderBy(start, end).rowsBetween(W.unboundedPreceding, -1)
    s = spans.withColumn("_seen", F.coalesce(F.max(end).over(w), F.lit(0)))
    inner = s.where(F.col(start) > F.col("_seen")).select(key, F.col("_seen").alias("gap_start"), F.col(start).alias("gap_end"))
    tail = spans.groupBy(key, length).agg(F.coalesce(F.max(end), F.lit(0)).alias("_end")).where(F.col("_end") < F.col(length)).select(key, F.col("_end").alias("gap_start"), F.col(length).alias("gap_end"))
    return inner.unionByName(tail)


def coalesce_spans(spans: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Overlapping and touching spans of a key as one: gaps and islands over the running end."""
    w = W.partitionBy(*keys).orderBy(start, end)
    before = w.rowsBetween(W.unboundedPreceding, -1)
    s = spans.withColumn("_new", (F.col(start) > F.coalesce(F.max(end).over(before), F.lit(-1))).cast("int"))
    s = s.withColumn("_island", F.sum("_new").over(w))
    return s.groupBy(*keys, "_island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_island")


def containment(inner: DataFrame, outer: DataFrame, keys: list[str]) -> DataFrame:
    """Inner spans with the outer spans of the same keys that contain them (equi-join with a residual)."""
    o = outer.withColumnsRenamed({"start_char": "outer_start", "end_char": "outer_end"})
    return inner.join(o, keys).where("outer_start <= start_char and start_char < end_char and end_char <= outer_end")


def overlapping_pairs(left: DataFrame, right: DataFrame, keys: list[str], bin_width: int) -> DataFrame:
    """Pairs of spans of the same keys that share a character; each pair once.

    Spans are placed in bins of ``bin_width``; a pair is kept in the bin of
    the later start only, so hot keys spread over their bins without repeats.
    Columns: keys, ``l_start, l_end, r_start, r_end`` and the rest of both.
    """
    def binned(df: DataFrame, s: str, e: str) -> DataFrame:
        return df.where(F.col(e) > F.col(s)).withColumn("_bin", F.explode(F.sequence(F.floor(F.col(s) / bin_width), F.floor((F.col(e) - 1) / bin_width))))

    j = binned(left, "l_start", "l_end").join(binned(right, "r_start", "r_end"), [*keys, "_bin"])
    return j.where(F.greatest("l_start", "r_start") < F.least("l_end", "r_end")).where(F.floor(F.greatest("l_start", "r_start") / bin_width) == F.col("_bin")).drop("_bin")


#: Phrases that one scan of the texts looks for.
PHRASES = 20_000


def locate(texts: DataFrame, phrases: DataFrame, text: str, phrase: str) -> DataFrame:
    """All occurrences, overlapping ones included, of each phrase: adds ``start_char`` (from 0) and ``end_char``.

    ``phrases`` is a query set against all texts: it is taken in blocks of
    about ``PHRASES``, each of which is one scan of the texts with an automaton
    over the block, linear in the length of a text. Null and empty phrases and
    null texts match nothing.
    """
    import ahocorasick

    p = phrases.where(F.length(phrase) > 0)
    words = p.select(F.col(phrase).alias("q")).distinct()
    blocks = max(1, -(-words.count() // PHRASES))
    found = StructType([*texts.schema.fields, StructField("_q", StringType()), StructField("start_char", IntegerType())])
    spark, out = texts.sparkSession, None
    for k in range(blocks):
        block = [r.q for r in words.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == k).collect()]
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            finder = ahocorasick.Automaton()
            for q in shared.value:
                finder.add_word(q, q)
            finder.make_automaton()
            for pdf in batches:
                hits = [(i, q, end + 1 - len(q)) for i, t in enumerate(pdf[text]) if t and shared.value for end, q in finder.iter(t)]
                at = pdf.iloc[[h[0] for h in hits]].reset_index(drop=True)
                yield at.assign(_q=[h[1] for h in hits], start_char=pd.Series([h[2] for h in hits], dtype="int32"))

        part = texts.where(F.length(text) > 0).mapInPandas(run, found)
        out = part if out is None else out.unionByName(part)
    j = out.join(p.withColumn("_q", F.col(phrase)), "_q")
    return j.withColumn("end_char", F.col("start_char") + F.length(phrase)).drop("_q")


def position_in_unit(spans: DataFrame, length: Column, offset: Column) -> DataFrame:
    """Offset of a span in its unit in millionths, and its quarter (0 to 3)."""
    return spans.withColumn("position_ppm", F.floor(offset * 1_000_000 / length)).withColumn("quarter", F.least(F.lit(3), F.floor(offset * 4 / length)))
