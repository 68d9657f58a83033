"""Queries over character windows and spans."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspan.operators import windows as wn

from .registry import CHP, SEG, WIN, Registry, once
from .session import table

query = Registry()
QUERIES, SQL = query.queries, query.sql


def _texts(spark, d):
    s = once(spark, d, "segment", "segment_id", "work_id", "chapter_ordinal", "ordinal", "normalized_text").where("work_id is not null and normalized_text is not null")
    return s.select("segment_id", "work_id", "chapter_ordinal", "ordinal", F.length("normalized_text").alias("n"))


def _windows_sql(window: int, overlap: int, sep: int) -> str:
    """The windows by definition: starts at multiples of the step until one reaches the end, joined by overlap."""
    step = window - overlap
    return f"""
with s as (select distinct segment_id, work_id, chapter_ordinal, ordinal, length(normalized_text) as n from {SEG} where work_id is not null and normalized_text is not null and length(normalized_text) > 0),
o as (select *, coalesce(sum(n + {sep}) over (partition by work_id order by chapter_ordinal, ordinal, segment_id rows between unbounded preceding and 1 preceding), 0) as a from s),
e as (select work_id, max(a + n) as total from o group by work_id),
w as (select work_id, total, unnest(range(0, greatest(1, 1 + ceil(greatest(0, total - {window}) / {step}.0)::bigint))) as k from e)
select o.work_id, w.k, o.segment_id, (greatest(w.k * {step}, o.a) - o.a)::int as start_char, (least(w.k * {step} + {window}, o.a + o.n) - o.a)::int as end_char
from o join w on o.work_id = w.work_id and o.a < w.k * {step} + {window} and o.a + o.n > w.k * {step}
"""


def _spans(spark, d, window, overlap, sep):
    placed = wn.offsets(_texts(spark, d), "work_id", "chapter_ordinal", ["ordinal", "segment_id"], F.col("n"), sep)
    return wn.window_spans(placed, window, overlap).select("work_id", "k", "segment_id", "start_char", "end_char")


@query("win1_scene_windows", _windows_sql(10_000, 1_800, 2))
def win1(spark, d):
    """Spans of windows of 10,000 characters with 1,800 overlap, two characters between texts."""
    return _spans(spark, d, 10_000, 1_800, 2)


@query("win2_extraction_units", _windows_sql(2_400, 300, 0))
def win2(spark, d):
    """Spans of units of 2,400 characters with 300 overlap, texts joined without separator."""
    return _spans(spark, d, 2_400, 300, 0)


_STORED = f"""
with w as (select window_id, unnest(source_spans) as s from {WIN} where window_id is not null),
sp as (select distinct s.segment_id as segment_id, s.start_char as a, s.end_char as b from w),
x as (select segment_id, n, a, b, coalesce(max(b) over (partition by segment_id order by a, b rows between unbounded preceding and 1 preceding), 0) as seen from sp join
 (select distinct segment_id, length(normalized_text) as n from {SEG} where normalized_text is not null) using (segment_id))
"""


def _stored_spans(spark, d):
    w = once(spark, d, "scene_window", "window_id", "source_spans").where("window_id is not null")
    return w.select("window_id", F.posexplode("source_spans").alias("pos", "s")).select("window_id", "pos", "s.segment_id", "s.start_char", "s.end_char", F.col("s.normalized_text_hash").alias("hash"))


@query("win3_coverage_gaps", _STORED + "select segment_id, seen as gap_start, a as gap_end from x where a > seen union all select segment_id, max(b), n from x group by segment_id, n having max(b) < n")
def win3(spark, d):
    """Parts of segments that no stored window covers, among segments that any covers."""
    s = _stored_spans(spark, d).select("segment_id", "start_char", "end_char").distinct()
    n = _texts(spark, d).select("segment_id", "n").distinct()
    return wn.coverage_gaps(s.join(n, "segment_id"), "segment_id", "start_char", "end_char", "n")


@query(
    "win4_window_text",
    f"""
with w as (select window_id, unnest(source_spans) as s, generate_subscripts(source_spans, 1) as p from {WIN} where window_id is not null),
t as (select window_id, p, substring(normalized_text, s.start_char + 1, s.end_char - s.start_char) as part from w join (select distinct segment_id, normalized_text from {SEG}) g on g.segment_id = s.segment_id)
select window_id, sha256(string_agg(part, '' order by p)) as text_hash, sum(length(part)) as n_chars from t group by window_id
""",
)
def win4(spark, d):
    """Text of every stored window: joined from its spans, as hash and length."""
    s = _stored_spans(spark, d)
    g = once(spark, d, "segment", "segment_id", "normalized_text")
    part = F.expr("substring(normalized_text, start_char + 1, end_char - start_char)")
    t = s.join(g, "segment_id").select("window_id", "pos", part.alias("part"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "part"))), lambda x: x["part"]), "")
    return t.groupBy("window_id").agg(F.sha2(text.cast("binary"), 256).alias("text_hash"), F.sum(F.length("part")).alias("n_chars"))


@query(
    "win5_bad_spans",
    f"""
with w as (select window_id, unnest(source_spans) as s from {WIN} where window_id is not null),
g as (select distinct segment_id, length(normalized_text) as n, normalized_text_hash as h from {SEG})
select distinct window_id, s.segment_id as segment_id, case when n is null then 'UNKNOWN_SEGMENT' when not (0 <= s.start_char and s.start_char < s.end_char and s.end_char <= n) then 'OUT_OF_BOUNDS' else 'HASH' end as problem
from w left join g on g.segment_id = s.segment_id where n is null or not (0 <= s.start_char and s.start_char < s.end_char and s.end_char <= n) or h <> s.normalized_text_hash
""",
)
def win5(spark, d):
    """Spans of stored windows that do not lie within their segment, or name another text."""
    s = _stored_spans(spark, d)
    g = once(spark, d, "segment", "segment_id", "normalized_text", "normalized_text_hash").select("segment_id", F.length("normalized_text").alias("n"), F.col("normalized_text_hash").alias("h"))
    j = s.join(g, "segment_id", "left")
    inside = (F.col("start_char") >= 0) & (F.col("start_char") < F.col("end_char")) & (F.col("end_char") <= F.col("n"))
    problem = F.when(F.col("n").isNull(), "UNKNOWN_SEGMENT").when(~inside, "OUT_OF_BOUNDS").when(F.col("h") != F.col("hash"), "HASH")
    return j.select("window_id", "segment_id", problem.alias("problem")).where("problem is not null").distinct()


@query(
    "win6_position_in_window",
    f"""
with w as (select window_id, unnest(source_spans) as s, generate_subscripts(source_spans, 1) as p from {WIN} where window_id is not null),
o as (select window_id, p, s.segment_id as segment_id, s.end_char - s.start_char as n, coalesce(sum(s.end_char - s.start_char) over (partition by window_id order by p rows between unbounded preceding and 1 preceding), 0) as off, sum(s.end_char - s.start_char) over (partition by window_id) as total from w)
select window_id, p::int as pos, segment_id, (off * 1000000) // total as position_ppm, least(3, (off * 4) // total)::int as quarter from o where total > 0
""",
)
def win6(spark, d):
    """Place of each span in its window, in millionths and quarters."""
    s = _stored_spans(spark, d).withColumn("n", F.col("end_char") - F.col("start_char"))
    w = W.partitionBy("window_id").orderBy("pos")
    s = s.withColumn("off", F.coalesce(F.sum("n").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).withColumn("total", F.sum("n").over(W.partitionBy("window_id"))).where("total > 0")
    out = wn.position_in_unit(s, F.col("total"), F.col("off"))
    return out.select("window_id", (F.col("pos") + 1).alias("pos"), "segment_id", "position_ppm", F.col("quarter").cast("int").alias("quarter"))


@query(
    "win7_phrase_locate",
    f"""
with q as (select distinct title as phrase from novel_source where title is not null and length(title) > 0),
s as (select distinct segment_id, normalized_text as t from {SEG} where normalized_text is not null),
m as (select segment_id, t, phrase, unnest(range(1, length(t) - length(phrase) + 2)) as i from s join q on contains(t, phrase))
select segment_id, phrase, (i - 1)::int as start_char, (i - 1 + length(phrase))::int as end_char from m where substring(t, i, length(phrase)) = phrase
""",
)
def win7(spark, d):
    """Every occurrence of the sources' titles in the segments (the 24 sources are the query set)."""
    q = table(spark, d, "novel_source").select(F.col("title").alias("phrase")).where("title is not null").distinct()
    s = once(spark, d, "segment", "segment_id", "normalized_text").where("normalized_text is not null")
    return wn.locate(s, F.broadcast(q), "normalized_text", "phrase").select("segment_id", "phrase", F.col("start_char").cast("int").alias("start_char"), F.col("end_char").cast("int").alias("end_char"))


@query(
    "win8_coalesced_spans",
    f"""
with w as (select unnest(source_spans) as s from {WIN} where window_id is not null),
sp as (select distinct s.segment_id as segment_id, s.start_char as a, s.end_char as b from w),
f as (select *, case when a > coalesce(max(b) over (partition by segment_id order by a, b rows between unbounded preceding and 1 preceding), -1) then 1 else 0 end as new from sp),
i as (select *, sum(new) over (partition by segment_id order by a, b rows unbounded preceding) as island from f)
select segment_id, min(a) as start_char, max(b) as end_char from i group by segment_id, island
""",
)
def win8(spark, d):
    """Spans of all stored windows, overlapping and touching ones as one."""
    s = _stored_spans(spark, d).select("segment_id", "start_char", "end_char").distinct()
    return wn.coalesce_spans(s, ["segment_id"], "start_char", "end_char")


@query(
    "jn6_overlapping_windows",
    f"""
with w as (select distinct window_id, s.segment_id as segment_id, s.start_char as a, s.end_char as b from (select window_id, unnest(source_spans) as s from {WIN} where window_id is not null))
select l.window_id as left_id, r.window_id as right_id, count(*) as n_spans, sum(least(l.b, r.b) - greatest(l.a, r.a)) as shared_chars
from w l join w r on l.segment_id = r.segment_id and l.window_id < r.window_id and greatest(l.a, r.a) < least(l.b, r.b) group by 1, 2
""",
)
def jn6(spark, d):
    """Pairs of windows that share text, with the number of characters they share."""
    s = _stored_spans(spark, d).select("window_id", "segment_id", "start_char", "end_char").distinct()
    left = s.select("segment_id", F.col("window_id").alias("left_id"), F.col("start_char").alias("l_start"), F.col("end_char").alias("l_end"))
    right = s.select("segment_id", F.col("window_id").alias("right_id"), F.col("start_char").alias("r_start"), F.col("end_char").alias("r_end"))
    j = wn.overlapping_pairs(left, right, ["segment_id"], 2000).where("left_id < right_id")
    return j.groupBy("left_id", "right_id").agg(F.count("*").alias("n_spans"), F.sum(F.least("l_end", "r_end") - F.greatest("l_start", "r_start")).alias("shared_chars"))


@query(
    "jn7_quote_containment",
    f"""
with w as (select distinct window_id, s.segment_id as segment_id, s.start_char as a, s.end_char as b from (select window_id, unnest(source_spans) as s from {WIN} where window_id is not null)),
q as (select distinct segment_id, length(normalized_text) as n from {SEG} where segment_type = 'quote' and normalized_text is not null)
select q.segment_id, count(window_id) as n_windows from q left join w on w.segment_id = q.segment_id and w.a <= 0 and w.b >= q.n group by q.segment_id
""",
)
def jn7(spark, d):
    """For each quote the number of stored windows that hold it whole."""
    q = once(spark, d, "segment", "segment_id", "segment_type", "normalized_text").where("segment_type = 'quote' and normalized_text is not null").select("segment_id", F.lit(0).alias("start_char"), F.length("normalized_text").alias("end_char"))
    w = _stored_spans(spark, d).select("window_id", "segment_id", "start_char", "end_char").distinct()
    held = wn.containment(q, w, ["segment_id"]).groupBy("segment_id").agg(F.count("*").alias("n"))
    return q.select("segment_id").distinct().join(held, "segment_id", "left").select("segment_id", F.coalesce("n", F.lit(0)).alias("n_windows"))


@query(
    "lim3_text_search",
    f"""
with s as (select distinct segment_id, document_id, work_id, chapter_ordinal, ordinal, normalized_text as t from {SEG} where contains(normalized_text, '灯')),
m as (select *, unnest(range(1, length(t) + 1)) as i from s),
h as (select work_id, chapter_ordinal, ordinal, segment_id, (i - 1)::int as start_char, strlen(substring(t, 1, i - 1))::int as start_byte from m where substring(t, i, 1) = '灯')
select * from h order by work_id, chapter_ordinal, ordinal, segment_id, start_char limit 200 offset 100
""",
)
def lim3(spark, d):
    """A page of the occurrences of a word in reading order, with character and byte offsets (a paging feature)."""
    s = once(spark, d, "segment", "segment_id", "work_id", "chapter_ordinal", "ordinal", "normalized_text").where("normalized_text is not null")
    q = spark.createDataFrame([("灯",)], "phrase string")
    h = wn.locate(s, F.broadcast(q), "normalized_text", "phrase")
    h = h.select("work_id", "chapter_ordinal", "ordinal", "segment_id", F.col("start_char").cast("int").alias("start_char"), F.octet_length(F.expr("substring(normalized_text, 1, start_char)")).alias("start_byte"))
    return h.orderBy("work_id", "chapter_ordinal", "ordinal", "segment_id", "start_char").offset(100).limit(200)


@query(
    "jn9_provenance",
    f"""
with w as (select window_id, unnest(source_spans) as s from {WIN} where window_id is not null),
g as (select distinct segment_id, document_id from {SEG}),
c as (select document_id, min(chapter_id) as chapter_id, min(source_locator) as source_locator from {CHP} where document_id is not null group by document_id)
select window_id, chapter_id, source_locator, count(*) as n_spans, sum(s.end_char - s.start_char) as n_chars from w join g on g.segment_id = s.segment_id left join c using (document_id) group by all
""",
)
def jn9(spark, d):
    """Chapters and locators behind each window."""
    s = _stored_spans(spark, d)
    g = once(spark, d, "segment", "segment_id", "document_id")
    c = once(spark, d, "chapter_ref").where("document_id is not null").groupBy("document_id").agg(F.min("chapter_id").alias("chapter_id"), F.min("source_locator").alias("source_locator"))
    return s.join(g, "segment_id").join(c, "document_id", "left").groupBy("window_id", "chapter_id", "source_locator").agg(F.count("*").alias("n_spans"), F.sum(F.col("end_char") - F.col("start_char")).alias("n_chars"))
