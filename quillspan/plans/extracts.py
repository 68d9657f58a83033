"""Queries over extraction results and the rules they must keep."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspan.operators import extract

from .registry import CHP, RES, SEG, WIN, WRK, Registry, once
from .session import table

query = Registry()
QUERIES, SQL = query.queries, query.sql
PLACE = extract.Profile("place-mention", kinds={"place": (frozenset({"name"}), frozenset())})


@query(
    "udx1_extract",
    f"""
with s as (select distinct segment_id, normalized_text as t from {SEG} where normalized_text is not null and segment_id is not null), m as (select segment_id, unnest(regexp_extract_all(t, '第([0-9]+)位', 1)) as name from s)
select segment_id as unit_id, '{{"kind":"place","name":"' || name || '"}}' as payload, count(*) as n from m group by all
""",
)
def udx1(spark, d):
    """Records of a deterministic executor over every segment, counted per payload."""
    s = once(spark, d, "segment", "segment_id", "normalized_text").where("normalized_text is not null and segment_id is not null").select(F.col("segment_id").alias("unit_id"), F.col("normalized_text").alias("text"))
    got = extract.execute(s, extract.by_pattern("place", "第([0-9]+)位"))
    good = got.where(F.col("error").isNull() & extract.payload_problem(F.col("payload"), PLACE).isNull())
    return good.groupBy("unit_id", "payload").agg(F.count("*").alias("n"))


@query("flt7_schema_violations", f"""
select chapter_id, 'ordinal' as "column" from {CHP} where ordinal is null or ordinal < 1 union all select chapter_id, 'title' from {CHP} where title is null
union all select chapter_id, 'chapter_kind' from {CHP} where chapter_kind is null or chapter_kind not in ('MAIN', 'PROLOGUE', 'EPILOGUE', 'EXTRA', 'FRONTMATTER', 'NAVIGATION')
union all select chapter_id, 'media_type' from {CHP} where media_type is null union all select chapter_id, 'source_locator' from {CHP} where source_locator is null or not regexp_matches(source_locator, '^(https?://|/)')
union all select chapter_id, 'declared_number' from {CHP} where declared_number < 1
""")
def flt7(spark, d):
    """Fields of chapters that break their schema."""
    rules = [
        extract.Rule("ordinal", least=1), extract.Rule("title"), extract.Rule("chapter_kind", one_of=("MAIN", "PROLOGUE", "EPILOGUE", "EXTRA", "FRONTMATTER", "NAVIGATION")),
        extract.Rule("media_type"), extract.Rule("source_locator", pattern="^(https?://|/)"), extract.Rule("declared_number", required=False, least=1),
    ]
    return extract.violations(once(spark, d, "chapter_ref"), "chapter_id", rules)


@query("flt9_uncovered_evidence", f"""
with w as (select window_id, unnest(source_spans) as s, generate_subscripts(source_spans, 1) as p from {WIN} where window_id is not null), b as (select window_id, p, case when s.start_char = 0 then '/text' else '/text/tail' end as path from w)
select window_id, 1 as group_no from b group by window_id having count(*) filter (where path = '/text') = 0
""")
def flt9(spark, d):
    """Windows none of whose spans begins with its segment: as bindings, none covers the whole text."""
    w = once(spark, d, "scene_window").where("window_id is not null").dropDuplicates(["window_id"]).select("window_id", F.posexplode("source_spans").alias("binding", "s"))
    b = w.select("window_id", "binding", F.array(F.when(F.col("s.start_char") == 0, "/text").otherwise("/text/tail")).alias("paths"))
    need = b.select("window_id").distinct().select("window_id", F.lit(1).alias("group_no"), F.array(F.lit("/text/head"), F.lit("/text/tail")).alias("pointers"))
    return extract.uncovered(b, need, "window_id")


@query("flt10_tri_state", """
with l as (select distinct doc_id, annotator, is_abusive, category from abuse_label where doc_id is not null), g as (select doc_id, count(distinct is_abusive) as n, count(*) filter (where category is not null) as spans, count(*) as rows from l group by doc_id)
select doc_id, case when n > 1 then 'CONFLICTING' else 'KNOWN' end as status, case when n > 1 then null when n = 1 and spans < 1 then 'known without evidence' when n < 1 then 'known without evidence' end as problem from g
""")
def flt10(spark, d):
    """Verdicts of annotators as a field: conflicting when they differ, known with evidence when a category is given."""
    lab = table(spark, d, "abuse_label").select("doc_id", "annotator", "is_abusive", "category").where("doc_id is not null").distinct()
    g = lab.groupBy("doc_id").agg(F.collect_set("is_abusive").alias("v"), F.count("category").alias("n_spans"))
    g = g.withColumn("status", F.when(F.size("v") > 1, "CONFLICTING").otherwise("KNOWN"))
    return g.select("doc_id", "status", extract.tri_state_problem(F.col("status"), F.col("v"), F.col("n_spans")).alias("problem"))


@query("src7_backoff", f"""
with r as (select *, coalesce(status in (429, 500, 502, 503, 504) or status is null, false) as f from {RES} where source_id is not null), i as (select *, sum(case when f then 0 else 1 end) over (partition by source_id order by retrieved_at, retrieval_id rows unbounded preceding) as island from r),
n as (select retrieval_id, f, sum(case when f then 1 else 0 end) over (partition by source_id, island order by retrieved_at, retrieval_id rows unbounded preceding) as k from i)
select retrieval_id, k::int as consecutive_failures, case when k <= 0 then 0 when k = 1 then 30000 when k = 2 then 60000 else 120000 end as wait_ms from n where f
""")
def src7(spark, d):
    """Consecutive failures up to each failed response of a source, and the wait that follows."""
    r = once(spark, d, "response").where("source_id is not null")
    f = F.coalesce(F.col("status").isin(429, 500, 502, 503, 504) | F.col("status").isNull(), F.lit(False))
    w = W.partitionBy("source_id").orderBy("retrieved_at", "retrieval_id").rowsBetween(W.unboundedPreceding, W.currentRow)
    r = r.withColumn("f", f).withColumn("island", F.sum(F.when(F.col("f"), 0).otherwise(1)).over(w))
    k = F.sum(F.col("f").cast("int")).over(W.partitionBy("source_id", "island").orderBy("retrieved_at", "retrieval_id").rowsBetween(W.unboundedPreceding, W.currentRow))
    return r.withColumn("k", k.cast("int")).where("f").select("retrieval_id", F.col("k").alias("consecutive_failures"), extract.backoff_ms(F.col("k")).alias("wait_ms"))


@query("jn11_lead_groups", f"select title, count(*) as n_leads, count(distinct author) as n_authors, case when count(distinct author) = 1 then min(author) end as author, count(distinct author) <= 1 as is_group from {WRK} where title is not null group by title")
def jn11(spark, d):
    """Works of one title as leads, and whether one author at most is claimed."""
    return extract.single_author(once(spark, d, "novel_work").where("title is not null"), "title", "author").select("title", "n_leads", "n_authors", "author", "is_group")


@query("jn12_unknown_paths")
def jn12(spark, d):
    """Paths asked of a profile that its schema does not have (the schemas are documents, so no SQL)."""
    schemas = {"place": {"properties": {"kind": {}, "name": {}, "spans": {"items": {"$ref": "#/$defs/span"}}}, "$defs": {"span": {"properties": {"start": {}, "end": {}}}}}}
    asked = once(spark, d, "segment", "segment_type").where("segment_type is not null").distinct()
    wanted = asked.select(F.lit("place").alias("profile"), F.explode(F.array(F.lit("/name"), F.lit("/spans/*/start"), F.concat(F.lit("/"), "segment_type"))).alias("path")).distinct()
    return extract.unknown_paths(wanted, schemas, "profile", "path")


@query("jn13_lost_seeds", f"""
with a as (select distinct lower(trim(title)) as seed, title as surface from {WRK} where title is not null), b as (select distinct lower(trim(work_title)) as seed, work_title as surface from documents where work_title is not null)
select seed, null as lost from (select distinct seed from a) x where not exists (select 1 from b where b.seed = x.seed)
union all select seed, surface from a where exists (select 1 from b where b.seed = a.seed) and not exists (select 1 from b where b.seed = a.seed and b.surface = a.surface)
""")
def jn13(spark, d):
    """Titles of works that the documents lost, or keep in other spellings only."""
    a = once(spark, d, "novel_work").where("title is not null").select(F.lower(F.trim("title")).alias("seed"), F.col("title").alias("surface"))
    b = table(spark, d, "documents").where("work_title is not null").select(F.lower(F.trim("work_title")).alias("seed"), F.col("work_title").alias("surface"))
    return extract.superset(a, b, "seed", "surface")


@query("jn15_count_mismatches", f"""
with c as (select document_id, max(ordinal) + 1 as claimed from {SEG} where document_id is not null group by document_id), r as (select document_id, count(*) as counted from (select distinct document_id, segment_id from {SEG}) where document_id is not null group by document_id)
select document_id, claimed, counted from c join r using (document_id) where claimed <> counted
""")
def jn15(spark, d):
    """Documents whose last ordinal claims another number of segments than there are."""
    s = once(spark, d, "segment", "document_id", "segment_id", "ordinal").where("document_id is not null")
    claimed = s.groupBy("document_id").agg((F.max("ordinal") + 1).alias("n"))
    return extract.count_mismatches(claimed, s.select("document_id", "segment_id").distinct(), "document_id", "n")


@query("jn17_selected_run", f"select window_id, work_id, count(*) over () = 1 as is_unique from (select distinct window_id, work_id from {WIN}) where window_id = (select min(window_id) from {WIN})")
def jn17(spark, d):
    """Exact lookup of one window, marked unique."""
    w = once(spark, d, "scene_window", "window_id", "work_id")
    first = w.agg(F.min("window_id")).first()[0]
    return extract.select_run(w, window_id=first) if first else w.limit(0).withColumn("is_unique", F.lit(True))


@query("fn13_sorted_sets", f"select document_id, array_to_string(list_sort(list_distinct(list(segment_type))), ',') as types from {SEG} where segment_type is not null and document_id is not null group by document_id")
def fn13(spark, d):
    """Sorted distinct types of each document's segments."""
    s = once(spark, d, "segment", "document_id", "segment_type").where("segment_type is not null and document_id is not null")
    return s.groupBy("document_id").agg(F.array_join(F.array_sort(F.collect_set("segment_type")), ",").alias("types"))
