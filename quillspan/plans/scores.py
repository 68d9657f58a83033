"""Queries that rank, score, sample and page."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspan.operators import rank

from .registry import CHP, RES, SEG, WIN, WRK, Registry, once
from .session import table

query = Registry()
QUERIES, SQL = query.queries, query.sql


@query(
    "agg1_rank_fusion",
    """
with s as (select doc_id as seq, source as provider, doc_kind as query, work_title as url, work_title as title, row_number() over (partition by source, doc_kind order by n_chars desc, doc_id) as r from documents where source is not null and work_title is not null),
n as (select *, trim(regexp_replace(regexp_replace(trim(title), '[《》]', '', 'g'), '\\s+', ' ', 'g')) as t from s),
f as (select * from n where t <> '' qualify row_number() over (partition by provider, query, url order by seq) = 1),
g as (select lower(t) as canonical_title, sum(1000000 // (60 + r))::bigint as score, count(*) as n_signals, arg_min(t, seq) as shown_title from f group by 1)
select canonical_title, score, n_signals, shown_title, row_number() over (order by score desc, canonical_title) as rank from g
""",
)
def agg1(spark, d):
    """Works fused from the rankings of their documents by length, per source and kind."""
    from pyspark.sql import Window as W

    x = table(spark, d, "documents").where("source is not null and work_title is not null")
    r = F.row_number().over(W.partitionBy("source", "doc_kind").orderBy(F.col("n_chars").desc(), "doc_id"))
    s = x.select(F.col("doc_id").alias("seq"), F.col("source").alias("provider"), F.col("doc_kind").alias("query"), F.col("work_title").alias("url"), F.col("work_title").alias("title"), r.cast("bigint").alias("global_rank"))
    return rank.fuse_ranks(s).select("canonical_title", "score", "n_signals", "shown_title", "rank")


@query("agg2_page_windows", f"with c as (select work_id, ordinal from {CHP} where work_id is not null) select work_id, count(distinct ordinal) as n_pages, max(ordinal) - min(ordinal) + 1 = count(distinct ordinal) as is_contiguous from c group by work_id")
def agg2(spark, d):
    """Whether the pages (chapters) of each work follow each other without a gap."""
    c = once(spark, d, "chapter_ref").where("work_id is not null").groupBy("work_id").agg(F.countDistinct("ordinal").alias("n_pages"), (F.max("ordinal") - F.min("ordinal") + 1).alias("room"))
    return c.select("work_id", "n_pages", (F.col("room") == F.col("n_pages")).alias("is_contiguous"))


@query(
    "agg3_capacity",
    f"""
with r as (select coalesce(segment_type, '?') as kind, document_id as unit, normalized_text_hash as p, count(*) as n from {SEG} where normalized_text_hash is not null group by 1, 2, 3), g as (select kind, p, sum(n) as n, count(*) as units from r group by 1, 2)
select coalesce(kind, '(all)') as kind, sum(n)::bigint as n_raw, sum(units)::bigint as n_unit_distinct, count(*) as n_global_distinct, count(*) filter (where units > 1) as n_in_several_units, (sum(n) - sum(units))::bigint as n_duplicates, round((sum(n) - sum(units)) / sum(n)::double, 6) as duplicate_rate
from g group by grouping sets ((kind), ())
""",
)
def agg3(spark, d):
    """Distinct texts per document and overall, by type of segment."""
    s = once(spark, d, "segment").where("normalized_text_hash is not null").withColumn("kind", F.coalesce("segment_type", F.lit("?")))
    return rank.capacity(s, "document_id", "kind", "normalized_text_hash")


@query(
    "agg4_precision_recall",
    """
with l as (select distinct doc_id, annotator, is_abusive from abuse_label), g as (select doc_id from l group by doc_id having avg(is_abusive) >= 0.5), a as (select annotator, doc_id from l where is_abusive = 1), gg as (select distinct annotator, doc_id from l join g using (doc_id)),
j as (select coalesce(a.annotator, gg.annotator) as annotator, a.doc_id as p, gg.doc_id as g from a full join gg on a.annotator = gg.annotator and a.doc_id = gg.doc_id)
select annotator, count(p) as n_predicted, count(g) as n_gold, count(*) filter (where p is not null and g is not null) as n_both, round(count(*) filter (where p is not null and g is not null) / nullif(count(p), 0)::double, 6) as precision, round(count(*) filter (where p is not null and g is not null) / nullif(count(g), 0)::double, 6) as recall, round(2 * count(*) filter (where p is not null and g is not null) / nullif(count(p) + count(g), 0)::double, 6) as f1
from j group by 1
""",
)
def agg4(spark, d):
    """Each annotator's positives against the majority's."""
    lab = table(spark, d, "abuse_label").select("doc_id", "annotator", "is_abusive").distinct()
    gold = lab.groupBy("doc_id").agg(F.avg("is_abusive").alias("m")).where("m >= 0.5").select("doc_id")
    return rank.score_sets(lab.where("is_abusive = 1"), lab.join(gold, "doc_id", "left_semi"), "annotator", "doc_id")


@query("agg5_cohorts", f"select coalesce(source_kind, '(all)') as source_kind, count(*) as n_works, count(author) as n_with_author, round(count(author) / count(*)::double, 6) as author_rate from {WRK} group by grouping sets ((source_kind), ())")
def agg5(spark, d):
    """Cohort totals and the overall total in one pass."""
    w = once(spark, d, "novel_work").groupingSets([[F.col("source_kind")], []], "source_kind").agg(F.count("*").alias("n_works"), F.count("author").alias("n_with_author"))
    return w.select(F.coalesce("source_kind", F.lit("(all)")).alias("source_kind"), "n_works", "n_with_author", F.round(F.col("n_with_author") / F.col("n_works"), 6).alias("author_rate"))


@query(
    "agg6_length_anomalies",
    f"""
with c as (select work_id, document_id, sum(length(normalized_text)) as n from {SEG} where work_id is not null and document_id is not null and normalized_text is not null group by 1, 2), m as (select work_id, list_sort(list(n))[(count(*) // 2)::int + 1] as med from c group by work_id)
select document_id, n as chars, med::bigint as median_chars, case when n < 200 then 'SHORT_CHAPTER' else 'LENGTH_OUTLIER' end as code from c join m using (work_id) where n < 200 or n > greatest(10000, 5 * med) or 5 * n < med
""",
)
def agg6(spark, d):
    """Documents that are short, or long or short against the upper median of their work."""
    s = once(spark, d, "segment", "segment_id", "work_id", "document_id", "normalized_text", "chapter_ordinal", "ordinal", "segment_type", "normalized_text_hash", "selector", "raw_start", "raw_end").where("work_id is not null and document_id is not null and normalized_text is not null")
    c = s.groupBy("work_id", "document_id").agg(F.sum(F.length("normalized_text")).alias("n"))
    j = c.join(rank.upper_median(c, ["work_id"], "n"), "work_id").withColumnRenamed("upper_median", "m")
    hit = (F.col("n") < 200) | (F.col("n") > F.greatest(F.lit(10000), 5 * F.col("m"))) | (5 * F.col("n") < F.col("m"))
    return j.where(hit).select("document_id", F.col("n").alias("chars"), F.col("m").alias("median_chars"), F.when(F.col("n") < 200, "SHORT_CHAPTER").otherwise("LENGTH_OUTLIER").alias("code"))


@query(
    "agg6_repeated_paragraphs",
    f"""
with p as (select distinct document_id, sha256(regexp_replace(x, '\\s+', '', 'g')) as h, length(regexp_replace(x, '\\s+', '', 'g')) as n from (select document_id, unnest(string_split(normalized_text, chr(10))) as x from {SEG} where normalized_text is not null and document_id is not null))
select h as paragraph_hash, count(distinct document_id) as n_documents from p where n >= 128 group by h having count(distinct document_id) > 1
""",
)
def agg6b(spark, d):
    """Long paragraphs that stand in several documents."""
    s = once(spark, d, "segment", "document_id", "normalized_text").where("normalized_text is not null and document_id is not null")
    p = s.select("document_id", F.explode(F.split("normalized_text", "\n")).alias("x")).select("document_id", F.regexp_replace("x", r"\s+", "").alias("x")).where(F.length("x") >= 128)
    return p.groupBy(F.sha2(F.col("x").cast("binary"), 256).alias("paragraph_hash")).agg(F.countDistinct("document_id").alias("n_documents")).where("n_documents > 1")


@query("anl1_row_ordinals", f"select chapter_id, row_number() over (partition by work_id order by ordinal, chapter_id)::int as position from {CHP} where work_id is not null")
def anl1(spark, d):
    """Position of each chapter in its work."""
    from pyspark.sql import Window as W

    return once(spark, d, "chapter_ref").where("work_id is not null").select("chapter_id", F.row_number().over(W.partitionBy("work_id").orderBy("ordinal", "chapter_id")).alias("position"))


@query("anl4_first_seen", f"select distinct on (source_locator) source_locator, chapter_id from (select distinct source_locator, chapter_id, discovered_at from chapter_ref where source_locator is not null) order by source_locator, discovered_at, chapter_id")
def anl4(spark, d):
    """First chapter seen under each locator."""
    from quillspan.operators.reduce import first_seen

    c = table(spark, d, "chapter_ref").where("source_locator is not null").select("source_locator", "chapter_id", "discovered_at")
    return first_seen(c, ["source_locator"], ["discovered_at", "chapter_id"]).select("source_locator", "chapter_id")


@query("anl6_earliest_quarter", f"""
with w as (select window_id, unnest(source_spans) as s, generate_subscripts(source_spans, 1) as p, len(source_spans) as n from {WIN} where window_id is not null)
select s.segment_id as segment_id, min(least(3, ((p - 1) * 4) // n))::int as earliest from w group by 1
""")
def anl6(spark, d):
    """Earliest quarter of a window in which each segment stands."""
    w = once(spark, d, "scene_window").where("window_id is not null").select(F.posexplode("source_spans").alias("p", "s"), F.size("source_spans").alias("n"))
    return w.groupBy(F.col("s.segment_id").alias("segment_id")).agg(F.min(F.least(F.lit(3), F.floor(F.col("p") * 4 / F.col("n")))).cast("int").alias("earliest"))


@query(
    "smp1_stratified_sample",
    f"""
with c as (select work_id, chapter_id, row_number() over (partition by work_id order by ordinal, chapter_id) - 1 as j, count(*) over (partition by work_id) as n from {CHP} where work_id is not null),
t as (select *, ((5 * (j + 1) - 1) // n)::int as stratum, (n <= 13 or j = 0 or j = n // 2 or j = n - 1) as fixed from c),
r as (select *, row_number() over (partition by work_id, stratum, fixed order by sha256('quillspan|' || work_id || '|' || stratum::varchar || '|' || chapter_id), chapter_id) as r from t)
select work_id, chapter_id, stratum, (j + 1)::int as position from r where fixed or r <= 2
""",
)
def smp1(spark, d):
    """Endpoints, middle and two low-hash chapters of each fifth of every work (a sampling operator)."""
    c = once(spark, d, "chapter_ref").where("work_id is not null").select("work_id", "chapter_id", "ordinal")
    return rank.stratified_sample(c, "work_id", ["ordinal"], "chapter_id", seed="quillspan").select("work_id", "chapter_id", "stratum", "position")


@query("smp2_seeded_pick", f"select source_id, arg_min(retrieval_id, sha256('seed' || chr(1) || 'lowest-hash' || chr(1) || source_id || chr(1) || retrieval_id)) as retrieval_id from (select distinct source_id, retrieval_id from {RES} where source_id is not null and retrieval_id is not null) group by source_id")
def smp2(spark, d):
    """One response of each source by seeded hash."""
    r = once(spark, d, "response").where("source_id is not null and retrieval_id is not null").select("source_id", "retrieval_id").distinct()
    return rank.seeded_pick(r, "source_id", "retrieval_id", "seed")


@query("lim1_page", f"select chapter_id, title, 150 as next_offset from (select chapter_id, title from {CHP} order by chapter_id limit 50 offset 100)")
def lim1(spark, d):
    """A page of the chapters by id, with the offset of the next (a paging feature)."""
    return rank.page(once(spark, d, "chapter_ref").select("chapter_id", "title"), ["chapter_id"], 100, 50)


@query("lim2_record_filter", f"select work_id from {WRK} where contains(lower(coalesce(title, '') || ' ' || coalesce(author, '') || ' ' || coalesce(source_kind, '') || ' ' || coalesce(work_lang, '')), 'frost')")
def lim2(spark, d):
    """Works with a word anywhere in their record."""
    w = once(spark, d, "novel_work")
    text = F.lower(F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in ("title", "author", "source_kind", "work_lang")]))
    return w.where(F.contains(text, F.lit("frost"))).select("work_id")


@query("fn12_ratios", "select source, count(*) filter (where lang is null) as n_null, round(count(*) filter (where lang is null) / count(*)::double, 6) as null_rate, round(count(*) filter (where lang = 'xx') / nullif(count(*) filter (where lang = 'yy'), 0)::double, 6) as odd_rate from documents group by source")
def fn12(spark, d):
    """Ratios with both rules for a zero below the line."""
    from quillspan.functions.text import ratio

    g = table(spark, d, "documents").groupBy("source").agg(F.count_if(F.col("lang").isNull()).alias("n_null"), F.count("*").alias("n"), F.count_if(F.col("lang") == "xx").alias("x"), F.count_if(F.col("lang") == "yy").alias("y"))
    return g.select("source", "n_null", F.round(ratio(F.col("n_null"), F.col("n"), 0.0), 6).alias("null_rate"), F.round(ratio(F.col("x"), F.col("y")), 6).alias("odd_rate"))
