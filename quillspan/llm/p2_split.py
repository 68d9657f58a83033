"""Problem 2: cut oversized items into overlapping pieces at natural boundaries.

Method: agglomerative merging. A text is first cut into atoms at every
boundary; adjacent atoms sit in a heap keyed by the strength of the boundary
between them, and the weakest boundary is merged first as long as the combined
size plus the overlap fits the limit. Only oversized items leave the JVM.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

# Strength of the boundary behind an atom.
HARD, BLANK, CLAUSE, SENTENCE, LINE, PART = range(6)
BOUNDARY_NAMES = ("none", "blank", "clause", "sentence", "line", "part")

_BOUNDARY = re.compile(
    r"(?P<line>[^\S\n]*\n\s*)"
    r"|(?P<sentence>[。！？!?…]+[”’»」』）)\"']*\s*|\.+[”’»\"')]*(?=\s|\Z)\s*)"
    r"|(?P<clause>[，、；：,;:—]+[”’»\"')]*\s*)"
    r"|(?P<blank>\s+)"
)
_KIND = {"line": LINE, "sentence": SENTENCE, "clause": CLAUSE, "blank": BLANK}


def atoms_of(text: str, most: int, parts: list[int] = ()) -> list[tuple[int, int]]:
    """(end, strength of the boundary at that end) of each atom; no atom is longer than ``most``.

    ``parts`` are offsets of boundaries known beforehand, such as the ends of
    the spans of a window.
    """
    ends: dict[int, int] = {}
    for m in _BOUNDARY.finditer(text):
        ends[m.end()] = max(ends.get(m.end(), 0), _KIND[m.lastgroup])
    for p in parts:
        if 0 < p < len(text):
            ends[p] = PART
    ends[len(text)] = PART
    ends.pop(0, None)
    out, at = [], 0
    for end in sorted(ends):
        while end - at > most:
            at += most
            out.append((at, HARD))
        out.append((end, ends[end]))
        at = end
    return out


def split_points(text: str, max_chars: int, overlap: int, parts: list[int] = ()) -> list[tuple[int, int, int]]:
    """(start, end, boundary at the end) of the pieces of a text.

    Each piece has at most ``max_chars`` code points and begins ``overlap``
    code points before the end of the piece before it. A text within the limit
    is one piece; an empty text has none.
    """
    n = len(text)
    if n == 0:
        return []
    if n <= max_chars:
        return [(0, n, PART)]
    if not 0 <= overlap < max_chars:
        raise ValueError("overlap_chars must be at least 0 and less than max_chars")
    room = max_chars - overlap
    atoms = atoms_of(text, max(1, min(room, max(1, room // 2))), parts)
    # The first piece has nothing before it to overlap with, so it must itself
    # be as long as the overlap; atoms are short enough that it then still fits.
    k = 0
    while k + 1 < len(atoms) and atoms[k][0] < overlap:
        k += 1
    atoms = atoms[k:]
    m = len(atoms)
    begin = [0] + [a[0] for a in atoms[:-1]]
    end = [a[0] for a in atoms]
    strength = [a[1] for a in atoms]
    right, left, alive = list(range(1, m + 1)), list(range(-1, m - 1)), [True] * m
    heap = [(strength[i], end[i + 1] - begin[i], i, i + 1) for i in range(m - 1)]
    heapq.heapify(heap)
    while heap:
        _, size, i, j = heapq.heappop(heap)
        if not (alive[i] and alive[j]) or right[i] != j or size != end[j] - begin[i]:
            continue
        if size + overlap > max_chars:
            continue
        alive[j] = False
        end[i], strength[i], right[i] = end[j], strength[j], right[j]
        if right[i] < m:
            left[right[i]] = i
            heapq.heappush(heap, (strength[i], end[right[i]] - begin[i], i, right[i]))
        if left[i] >= 0:
            p = left[i]
            heapq.heappush(heap, (strength[p], end[i] - begin[p], p, i))
    out, i = [], 0
    while i < m:
        out.append((max(0, begin[i] - overlap) if begin[i] else 0, end[i], strength[i]))
        i = right[i]
    return out


PIECES = "item_kind string, item_id string, n_chars int, piece_no int, start_char int, end_char int, boundary string, piece_text string"


def _cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in PIECES.split(", ")]
    for pdf in batches:
        rows = []
        for kind, ident, parts, most, overlap in zip(pdf.item_kind, pdf.item_id, pdf.parts, pdf.max_chars, pdf.overlap_chars):
            texts = ["�" * int(p["n"]) if p["part"] is None or len(p["part"]) != p["n"] else p["part"] for p in parts]
            text, marks, at = "".join(texts), [], 0
            for t in texts:
                at += len(t)
                marks.append(at)
            for k, (a, b, s) in enumerate(split_points(text, int(most), int(overlap), marks)):
                rows.append((kind, ident, len(text), k + 1, a, b, BOUNDARY_NAMES[s], text[a:b]))
        yield pd.DataFrame(rows, columns=names)


def split_items(items: DataFrame) -> DataFrame:
    """Pieces of items ``(item_kind, item_id, parts array<struct<pos int, part string, n int>>, max_chars, overlap_chars)``.

    A part whose text is missing or of another length than ``n`` counts as
    ``n`` replacement characters, so offsets stay right. Items without text
    have no piece.
    """
    return items.mapInPandas(_cut, PIECES)


def limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per kind of item (of repeated rows the smallest limit holds); kinds without a limit are left out."""
    s = table(spark, sf_dir, "size_limit").where("max_chars is not null")
    return s.groupBy("item_kind").agg(F.min("max_chars").alias("max_chars"), F.min(F.coalesce("overlap_chars", F.lit(0))).alias("overlap_chars"))


def oversized_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments over the limit, each id once; the limit is compared inside the scan stage."""
    lim = F.broadcast(limits(spark, sf_dir).where("item_kind = 'segment'"))  # at most one row
    seg = table(spark, sf_dir, "segment").select("segment_id", "normalized_text").where("normalized_text is not null and segment_id is not null")
    big = seg.join(lim, F.length("normalized_text") > F.col("max_chars"))
    n = F.length("normalized_text")
    return (
        big.groupBy("item_kind", "segment_id", "max_chars", "overlap_chars")
        .agg(F.min("normalized_text").alias("normalized_text"))
        .select("item_kind", F.col("segment_id").alias("item_id"), F.array(F.struct(F.lit(0).alias("pos"), F.col("normalized_text").alias("part"), n.alias("n"))).alias("parts"), "max_chars", "overlap_chars")
    )


def oversized_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows whose spans sum to more than the limit, with the text under their spans in order."""
    lim = F.broadcast(limits(spark, sf_dir).where("item_kind = 'scene_window'"))
    size = F.aggregate("source_spans", F.lit(0), lambda acc, s: acc + F.greatest(F.coalesce(s["end_char"] - s["start_char"], F.lit(0)), F.lit(0)))
    win = table(spark, sf_dir, "scene_window").where("window_id is not null").select("window_id", "source_spans")
    big = win.withColumn("size", size).join(lim, F.col("size") > F.col("max_chars"))
    # Of repeated rows that differ, the one with the smallest spans holds.
    big = big.groupBy("window_id", "item_kind", "max_chars", "overlap_chars").agg(F.min("source_spans").alias("source_spans"))
    spans = big.select("window_id", "item_kind", "max_chars", "overlap_chars", F.posexplode("source_spans").alias("pos", "s")).select(
        "window_id", "item_kind", "max_chars", "overlap_chars", "pos", "s.segment_id", "s.start_char", F.greatest(F.coalesce(F.expr("s.end_char - s.start_char"), F.lit(0)), F.lit(0)).alias("n")
    )
    seg = table(spark, sf_dir, "segment").select("segment_id", "normalized_text").where("segment_id is not null")
    part = F.substring(F.col("normalized_text"), F.col("start_char") + 1, F.col("n"))
    joined = spans.join(seg, "segment_id", "left").withColumn("part", part)
    # A repeated segment row repeats the span: one text per (window, span).
    one = joined.groupBy("window_id", "item_kind", "max_chars", "overlap_chars", "pos", "n").agg(F.min("part").alias("part"))
    return one.groupBy("item_kind", "window_id", "max_chars", "overlap_chars").agg(F.array_sort(F.collect_list(F.struct("pos", "part", "n"))).alias("parts")).select(
        "item_kind", F.col("window_id").alias("item_id"), "parts", "max_chars", "overlap_chars"
    )


def p2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every oversized segment and window."""
    return split_items(oversized_segments(spark, sf_dir).unionByName(oversized_windows(spark, sf_dir)))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that the splitter had to cut: those with a second piece."""
    return p2_pieces(spark, sf_dir).where("piece_no = 2").select("item_kind", "item_id")


QUERIES = {"p2_found": p2_found, "p2_pieces": p2_pieces}

SQL = {
    "p2_found": """
select 'segment' as item_kind, segment_id as item_id from segment
where segment_id is not null and length(normalized_text) > (select min(max_chars) from size_limit where item_kind = 'segment') group by segment_id
union all
select 'scene_window' as item_kind, window_id as item_id from scene_window
where window_id is not null and list_sum([s.end_char - s.start_char for s in source_spans]) > (select min(max_chars) from size_limit where item_kind = 'scene_window') group by window_id
""",
}
