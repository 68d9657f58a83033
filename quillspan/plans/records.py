"""Queries that join, deduplicate, reduce and check records."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspan.functions import ids
from quillspan.functions import text as fx
from quillspan.operators import checks, rank, reduce
from quillspan.sources import sinks

from .registry import CHP, RES, SEG, WIN, WRK, Registry, once
from .session import table

query = Registry()
QUERIES, SQL = query.queries, query.sql

_KINDS = {"novel_work": "work_id", "chapter_ref": "chapter_id", "segment": "segment_id", "scene_window": "window_id", "response": "retrieval_id", "novel_source": "source_id", "documents": "doc_id"}


@query("src11_key_uniqueness", " union all ".join(f"select '{t}' as kind, coalesce(sum(n), 0)::bigint as n_rows, count({k}) as n_keys, count(*) filter (where n > 1) as n_repeated_keys from (select {k}, count(*) as n from {t} group by {k})" for t, k in _KINDS.items()))
def src11(spark, d):
    """Rows, keys and repeated keys of every table."""
    return checks.union_all([checks.key_counts(table(spark, d, t), k, t) for t, k in _KINDS.items()])


@query(
    "src12_record_index",
    f"select work_id as record_id, 'work' as kind, null as status from {WRK} union all select chapter_id, 'chapter', status from {CHP} union all select distinct window_id, 'window', null from {WIN} union all select retrieval_id, 'response', status::varchar from {RES}",
)
def src12(spark, d):
    """One index over records of all kinds."""
    none = F.lit(None).cast("string")
    parts = [("novel_work", "work_id", "work", none), ("chapter_ref", "chapter_id", "chapter", F.col("status")), ("scene_window", "window_id", "window", none), ("response", "retrieval_id", "response", F.col("status").cast("string"))]
    out = []
    for t, k, kind, status in parts:
        df = once(spark, d, t)
        df = df.select(F.col(k).alias("record_id"), F.lit(kind).alias("kind"), status.alias("status"))
        out.append(df.distinct() if kind == "window" else df)
    return checks.union_all(out)


@query("snk1_artifacts", "select 'sha256:' || sha256(body) as artifact_id, min(content_type) as media_type, octet_length(any_value(body)) as byte_length from response where body is not null group by 1")
def snk1(spark, d):
    """Each body once, addressed by its hash."""
    return sinks.artifacts(table(spark, d, "response"), "body", "content_type").select("artifact_id", "media_type", "byte_length")


@query(
    "snk5_export_manifest",
    f"""
with r as (select 'sha256:' || sha256(body) as artifact_id, source_id from {RES} where body is not null), s as (select source_id, source_kind from novel_source)
select artifact_id, case when bool_or(coalesce(source_kind, 'SITE') <> 'SITE') then 'AVAILABLE' else 'WITHHELD' end as availability from r left join s using (source_id) group by artifact_id
""",
)
def snk5(spark, d):
    """Artifacts with whether any of their sources lets them out."""
    r = table(spark, d, "response").where("body is not null").select(F.concat(F.lit("sha256:"), F.sha2("body", 256)).alias("artifact_id"), "source_id")
    s = table(spark, d, "novel_source").select("source_id", "source_kind")
    free = F.max((F.coalesce("source_kind", F.lit("SITE")) != "SITE").cast("int")) == 1
    return r.join(F.broadcast(s), "source_id", "left").groupBy("artifact_id").agg(F.when(free, "AVAILABLE").otherwise("WITHHELD").alias("availability"))


def _two_sites_sql(select: str) -> str:
    return f"""
with d as (select work_id, ordinal, min(document_id) as a, max(document_id) as b from {CHP} where document_id is not null and work_id is not null group by work_id, ordinal having min(document_id) < max(document_id)),
s as (select distinct document_id, normalized_text_hash as h from {SEG} where normalized_text_hash is not null),
x as (select work_id, ordinal, h from d join s on s.document_id = d.a), y as (select work_id, ordinal, h from d join s on s.document_id = d.b)
{select}"""


def _two_sites(spark, d):
    c = once(spark, d, "chapter_ref", "work_id", "ordinal", "document_id").where("document_id is not null and work_id is not null")
    c = c.groupBy("work_id", "ordinal").agg(F.min("document_id").alias("a"), F.max("document_id").alias("b")).where("a < b")
    s = once(spark, d, "segment", "document_id", "normalized_text_hash").where("normalized_text_hash is not null").withColumnRenamed("normalized_text_hash", "h")
    side = lambda k: c.select("work_id", "ordinal", F.col(k).alias("document_id")).join(s, "document_id").select("work_id", "ordinal", "h")
    return side("a"), side("b")


@query("txt6_segment_diff", _two_sites_sql("select work_id, ordinal, count(*) filter (where y.h is null) as n_removed, count(*) filter (where x.h is null) as n_added, count(*) filter (where x.h = y.h) as n_kept, (count(*) filter (where y.h is null or x.h is null)) > 0 as changed from x full join y using (work_id, ordinal, h) group by all".replace("y.h is null", "yh is null").replace("x.h is null", "xh is null").replace("x.h = y.h", "xh = yh").replace("from x full join y using (work_id, ordinal, h)", "from (select coalesce(x.work_id, y.work_id) as work_id, coalesce(x.ordinal, y.ordinal) as ordinal, x.h as xh, y.h as yh from x full join y on x.work_id = y.work_id and x.ordinal = y.ordinal and x.h = y.h)")))
def txt6(spark, d):
    """What differs between the two copies of a chapter that stands on two sites."""
    a, b = _two_sites(spark, d)
    return checks.set_difference(a, b, ["work_id", "ordinal"], "h")


@query(
    "jn2_dangling",
    f"""
select 'segment.document' as rule, document_id as key_value from (select distinct document_id from {SEG} where document_id is not null) s where not exists (select 1 from chapter_ref c where c.document_id = s.document_id)
union all select 'segment.work', work_id from (select distinct work_id from {SEG} where work_id is not null) s where not exists (select 1 from novel_work c where c.work_id = s.work_id)
union all select 'chapter.work', work_id from (select distinct work_id from {CHP} where work_id is not null) s where not exists (select 1 from novel_work c where c.work_id = s.work_id)
union all select 'chapter.source', source_id from (select distinct source_id from {CHP} where source_id is not null) s where not exists (select 1 from novel_source c where c.source_id = s.source_id)
union all select 'response.retry_of', retry_of from (select distinct retry_of from {RES} where retry_of is not null) s where not exists (select 1 from response c where c.retrieval_id = s.retry_of)
union all select 'dom.response', retrieval_id from (select distinct retrieval_id from dom_node where retrieval_id is not null) s where not exists (select 1 from response c where c.retrieval_id = s.retrieval_id)
""",
)
def jn2(spark, d):
    """References that nothing answers, by rule."""
    t = lambda n: table(spark, d, n)
    return checks.union_all(
        [
            checks.dangling(t("segment"), "document_id", t("chapter_ref"), "document_id", "segment.document"),
            checks.dangling(t("segment"), "work_id", t("novel_work"), "work_id", "segment.work"),
            checks.dangling(t("chapter_ref"), "work_id", t("novel_work"), "work_id", "chapter.work"),
            checks.dangling(t("chapter_ref"), "source_id", t("novel_source"), "source_id", "chapter.source"),
            checks.dangling(t("response"), "retry_of", t("response"), "retrieval_id", "response.retry_of"),
            checks.dangling(t("dom_node"), "retrieval_id", t("response"), "retrieval_id", "dom.response"),
        ]
    )


@query("jn1_chapter_lookup", f"select c.chapter_id, w.title as work_title, s.title as source_title from {CHP} c join {WRK} w using (work_id) left join novel_source s using (source_id)")
def jn1(spark, d):
    """Chapters with the titles of their work and source."""
    c = once(spark, d, "chapter_ref", *["chapter_id", "work_id", "document_id", "source_id", "chapter_key", "ordinal", "declared_number", "title", "chapter_kind", "source_locator", "media_type", "status", "duplicate_of"]).select("chapter_id", "work_id", "source_id")
    w = once(spark, d, "novel_work").select("work_id", F.col("title").alias("work_title"))
    s = table(spark, d, "novel_source").select("source_id", F.col("title").alias("source_title"))
    return c.join(w, "work_id").join(F.broadcast(s), "source_id", "left").select("chapter_id", "work_title", "source_title")


@query(
    "jn3_segment_chapters",
    f"""
with a as (select document_id, list_sort(list(distinct segment_id)) as ids from {SEG} where segment_id is not null group by document_id), e as (select document_id, unnest(ids) as segment_id from a)
select segment_id, count(distinct chapter_id) as n_chapters, count(distinct c.work_id) as n_works from e left join {CHP} c using (document_id) group by segment_id
""",
)
def jn3(spark, d):
    """How many chapters and works the members of each document's list of segments belong to."""
    a = once(spark, d, "segment", "document_id", "segment_id").where("segment_id is not null").groupBy("document_id").agg(F.array_sort(F.collect_set("segment_id")).alias("ids"))
    e = a.select("document_id", F.explode("ids").alias("segment_id"))
    c = once(spark, d, "chapter_ref", "document_id", "chapter_id", "work_id").select("document_id", "chapter_id", F.col("work_id").alias("w"))
    return e.join(c, "document_id", "left").groupBy("segment_id").agg(F.countDistinct("chapter_id").alias("n_chapters"), F.countDistinct("w").alias("n_works"))


@query(
    "jn4_title_candidates",
    f"""
with w as (select work_id, lower(regexp_replace(trim(title), '[《》]', '', 'g')) as t from {WRK} where title is not null), d as (select doc_id, lower(regexp_replace(trim(work_title), '[《》]', '', 'g')) as t from documents where work_title is not null)
select d.doc_id, count(w.work_id) as n_candidates, min(w.work_id) as first_candidate from d left join w on d.t = w.t group by d.doc_id
""",
)
def jn4(spark, d):
    """For each titled document all works of that title; nothing is chosen where there are several."""
    norm = lambda c: F.lower(F.regexp_replace(F.trim(c), "[《》]", ""))
    w = once(spark, d, "novel_work").where("title is not null").select("work_id", norm("title").alias("t"))
    x = table(spark, d, "documents").where("work_title is not null").select("doc_id", norm("work_title").alias("t"))
    return x.join(w, "t", "left").groupBy("doc_id").agg(F.count("work_id").alias("n_candidates"), F.min("work_id").alias("first_candidate"))


@query(
    "jn5_best_match",
    f"""
with r as (select work_lang, row_number() over (order by count(distinct work_id) desc, work_lang) as rank from {WRK} where work_lang is not null group by work_lang),
e as (select source_id, source_lang as work_lang from novel_source where source_lang is not null and source_kind <> 'SITE'), j as (select rank, work_lang, source_id from r join e using (work_lang)), b as (select min(rank) as rank from j)
select work_lang, source_id, (select count(*) from j where rank = (select rank from b)) > 1 as is_ambiguous from j where rank = (select rank from b)
""",
)
def jn5(spark, d):
    """Library sources in the commonest language of works that has any; several are ambiguous."""
    r = once(spark, d, "novel_work").where("work_lang is not null").groupBy("work_lang").agg(F.countDistinct("work_id").alias("n"))
    r = rank.numbered(r, [F.col("n").desc(), F.col("work_lang")], "rank")
    e = table(spark, d, "novel_source").where("source_lang is not null and source_kind <> 'SITE'").select(F.col("source_lang").alias("work_lang"), "source_id")
    return checks.best_match(r, e, ["work_lang"], ["rank", "work_lang"]).select("work_lang", "source_id", "is_ambiguous")


@query("jn8_unaligned_chapters", f"""
with c as (select distinct work_id, ordinal, source_id from {CHP} where source_id is not null and work_id is not null), f as (select work_id, min(source_id) as a, max(source_id) as b from c group by work_id having min(source_id) < max(source_id))
select work_id, ordinal, case when bool_or(source_id = a) then 'first' else 'second' end as only_on from c join f using (work_id) where source_id in (a, b) group by work_id, ordinal having count(distinct source_id) = 1
""")
def jn8(spark, d):
    """Chapters that only one of a work's two sites has."""
    c = once(spark, d, "chapter_ref", "work_id", "ordinal", "source_id").where("source_id is not null and work_id is not null")
    f = c.groupBy("work_id").agg(F.min("source_id").alias("a"), F.max("source_id").alias("b")).where("a < b")
    j = c.join(f, "work_id").where("source_id = a or source_id = b")
    g = j.groupBy("work_id", "ordinal").agg(F.countDistinct("source_id").alias("n"), F.max((F.col("source_id") == F.col("a")).cast("int")).alias("on_a"))
    return g.where("n = 1").select("work_id", "ordinal", F.when(F.col("on_a") == 1, "first").otherwise("second").alias("only_on"))


@query(
    "src8_catalog_comparison",
    f"""
with c as (select distinct work_id, ordinal from {CHP} where work_id is not null), s as (select distinct work_id, chapter_ordinal as ordinal from {SEG} where work_id is not null)
select coalesce(c.work_id, s.work_id) as work_id, coalesce(c.ordinal, s.ordinal) as ordinal, case when s.work_id is null then 'NOT_IMPORTED' else 'NOT_IN_CATALOG' end as problem from c full join s on c.work_id = s.work_id and c.ordinal = s.ordinal where c.work_id is null or s.work_id is null
""",
)
def src8(spark, d):
    """Chapters of the catalogue without segments, and segments outside the catalogue."""
    c = once(spark, d, "chapter_ref", "work_id", "ordinal").where("work_id is not null").withColumn("c", F.lit(1))
    s = once(spark, d, "segment", "work_id", "chapter_ordinal").where("work_id is not null").select("work_id", F.col("chapter_ordinal").alias("ordinal"), F.lit(1).alias("s"))
    j = c.join(s, ["work_id", "ordinal"], "full_outer").where("c is null or s is null")
    return j.select("work_id", "ordinal", F.when(F.col("s").isNull(), "NOT_IMPORTED").otherwise("NOT_IN_CATALOG").alias("problem"))


@query(
    "jn10_attempt_pairing",
    f"select a.retrieval_id, case when r.retrieval_id is not null then 'RETRIED' when a.status between 200 and 299 then 'SUCCEEDED' when a.status is null then 'FAILED' else 'ANSWERED' end as state from (select distinct retrieval_id, min(status) as status from response group by retrieval_id) a left join (select retry_of, min(retrieval_id) as retrieval_id from response where retry_of is not null group by retry_of) r on r.retry_of = a.retrieval_id where a.retrieval_id is not null",
)
def jn10(spark, d):
    """State of each attempt from its own answer and the retry that follows it."""
    a = table(spark, d, "response").where("retrieval_id is not null").groupBy("retrieval_id").agg(F.min("status").alias("status"))
    r = table(spark, d, "response").where("retry_of is not null").groupBy(F.col("retry_of").alias("retrieval_id")).agg(F.min("retrieval_id").alias("retry"))
    state = F.when(F.col("retry").isNotNull(), "RETRIED").when(F.col("status").between(200, 299), "SUCCEEDED").when(F.col("status").isNull(), "FAILED").otherwise("ANSWERED")
    return a.join(r, "retrieval_id", "left").select("retrieval_id", state.alias("state"))


@query("jn14_span_references", f"""
with w as (select window_id, work_id, unnest(source_spans) as s from {WIN} where window_id is not null), g as (select distinct segment_id, work_id as sw from {SEG})
select window_id, count(*) filter (where sw is null) as n_unknown, count(*) filter (where sw <> work_id) as n_foreign from w left join g on g.segment_id = s.segment_id group by window_id having count(*) filter (where sw is null or sw <> work_id) > 0
""")
def jn14(spark, d):
    """Windows that cite unknown segments or segments of another work."""
    w = once(spark, d, "scene_window").where("window_id is not null").select("window_id", "work_id", F.explode("source_spans").alias("s")).select("window_id", "work_id", "s.segment_id")
    g = once(spark, d, "segment", "segment_id", "work_id").select("segment_id", F.col("work_id").alias("sw"))
    c = w.join(g, "segment_id", "left").groupBy("window_id").agg(F.count_if(F.col("sw").isNull()).alias("n_unknown"), F.count_if(F.col("sw") != F.col("work_id")).alias("n_foreign"))
    return c.where("n_unknown + n_foreign > 0")


@query("jn16_complete_windows", f"""
with need as (select distinct work_id, segment_id from {SEG} where work_id is not null and length(normalized_text) > 0), have as (select distinct work_id, s.segment_id as segment_id from (select work_id, unnest(source_spans) as s from {WIN}))
select distinct work_id from need n where not exists (select 1 from need m where m.work_id = n.work_id and not exists (select 1 from have h where h.work_id = m.work_id and h.segment_id = m.segment_id))
""")
def jn16(spark, d):
    """Works all of whose segments stand in some window (relational division)."""
    need = once(spark, d, "segment", "work_id", "segment_id", "normalized_text").where("work_id is not null and length(normalized_text) > 0").select("work_id", "segment_id")
    have = once(spark, d, "scene_window").select("work_id", F.explode("source_spans").alias("s")).select("work_id", "s.segment_id")
    return checks.divides(need, have, "work_id", "segment_id")


@query(
    "ded1_duplicate_chapters",
    f"""
with h as (select document_id, string_agg(normalized_text_hash, '|' order by ordinal, segment_id) as content from {SEG} where document_id is not null and normalized_text_hash is not null group by document_id),
c as (select chapter_id, work_id, ordinal, content from {CHP} join h using (document_id) where chapter_kind not in ('FRONTMATTER', 'NAVIGATION'))
select chapter_id, first_value(chapter_id) over (partition by work_id, content order by ordinal, chapter_id) as first_id from c qualify chapter_id <> first_id
""",
)
def ded1(spark, d):
    """Chapters whose ordered segments equal an earlier chapter's of the work."""
    s = once(spark, d, "segment", "document_id", "ordinal", "segment_id", "normalized_text_hash").where("document_id is not null and normalized_text_hash is not null")
    h = reduce.chapter_hashes(s, ["document_id"], ["ordinal", "segment_id"], "normalized_text_hash")
    c = once(spark, d, "chapter_ref").where("chapter_kind not in ('FRONTMATTER', 'NAVIGATION')").join(h, "document_id").select("chapter_id", "work_id", "ordinal", "content_hash")
    return reduce.exact_duplicates(c, ["work_id"], ["ordinal"], "chapter_id").where("duplicate_of is not null").select("chapter_id", F.col("duplicate_of").alias("first_id"))


@query("ded2_duplicate_bodies", "select sha256(regexp_replace(text, '[\\s\\x{a0}\\x{3000}\\x{2000}-\\x{200a}\\x{202f}\\x{205f}\\x{85}\\x{2028}\\x{2029}\\x{1680}\\x{1c}-\\x{1f}]+', '', 'g')) as body_hash, count(*) as n_members, string_agg(doc_id::varchar, ',' order by doc_id::varchar) as members from documents where text is not null group by 1 having count(*) > 1")
def ded2(spark, d):
    """Groups of documents that are equal without white space."""
    x = table(spark, d, "documents").where("text is not null").select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    return reduce.body_groups(x, "doc_id", "text")


@query(
    "ded3_exact_payloads",
    f"select normalized_text_hash as payload, count(distinct segment_id) as n_members, min(segment_id) as first_member, sha256(string_agg(distinct segment_id, ',' order by segment_id)) as member_hash from {SEG} where normalized_text_hash is not null and segment_id is not null group by 1",
)
def ded3(spark, d):
    """Segments reduced to one record per exact text, with the hash of their members."""
    s = once(spark, d, "segment").where("normalized_text_hash is not null and segment_id is not null").select(F.col("normalized_text_hash").alias("payload"), "segment_id", F.lit(0).alias("start"), F.length("normalized_text").alias("end"))
    r = reduce.reducer("exact-payload")(s, "payload", "segment_id", ["segment_id", "start", "end"])
    return r.select("payload", F.size("members").alias("n_members"), F.element_at("members", 1).alias("first_member"), F.sha2(F.array_join("members", ",").cast("binary"), 256).alias("member_hash"))


@query("ded4_repeated_in_unit", f"select document_id, normalized_text_hash, count(*) as n from {SEG} group by 1, 2 having count(*) > 1")
def ded4(spark, d):
    """Texts that stand more than once in a document."""
    return reduce.repeated_in_unit(once(spark, d, "segment"), "document_id", "normalized_text_hash")


@query("ded5_identity", f"select count(*) as n_rows, count(distinct segment_id) as n_segments from segment")
def ded5(spark, d):
    """Rows and identities of the segments (a row per segment after the first-seen rule)."""
    t = table(spark, d, "segment")
    kept = reduce.first_seen(t.select("segment_id", "parsed_at", "document_id"), ["segment_id"], ["parsed_at", "document_id"])
    return t.agg(F.count("*").alias("n_rows")).crossJoin(kept.agg(F.count("segment_id").alias("n_segments")))


@query("ded7_label_occurrences", "select doc_id, is_abusive, annotator, row_number() over (partition by doc_id, is_abusive order by labelled_at, annotator)::int as occurrence, count(*) over (partition by doc_id, is_abusive) as n_occurrences from (select distinct doc_id, annotator, is_abusive, labelled_at from abuse_label)")
def ded7(spark, d):
    """Labels numbered within document and verdict."""
    t = table(spark, d, "abuse_label").select("doc_id", "annotator", "is_abusive", "labelled_at").distinct()
    return reduce.occurrences(t, "doc_id", "is_abusive", ["labelled_at", "annotator"]).select("doc_id", "is_abusive", "annotator", "occurrence", "n_occurrences")


@query("ded8_merged_titles", f"select regexp_replace(lower(regexp_replace(trim(title), '[《》]', '', 'g')), '\\s+', '', 'g') as identity, string_agg(distinct title, '|' order by title) as surfaces, string_agg(distinct source_kind, '|' order by source_kind) as sources, count(*) as n_items from {WRK} where title is not null group by 1")
def ded8(spark, d):
    """Works of one title as one, with all spellings and kinds of source."""
    w = once(spark, d, "novel_work").where("title is not null")
    return reduce.merge_surfaces(w, fx.squashed(F.regexp_replace(F.trim("title"), "[《》]", "")), "title", "source_kind")


@query("ded6_scene_groups")
def ded6(spark, d):
    """Complete-link groups of the stored windows as candidates: windows that share text and a chapter number (greedy, so no SQL)."""
    w = once(spark, d, "scene_window").where("window_id is not null and work_id is not null").dropDuplicates(["window_id"])
    s = w.select("work_id", "window_id", "ordinal", F.explode("source_spans").alias("s")).select("work_id", "window_id", "ordinal", "s.segment_id", "s.start_char", "s.end_char")
    g = once(spark, d, "segment", "segment_id", "work_id", "chapter_ordinal", "ordinal").select("segment_id", (F.col("chapter_ordinal").cast("bigint") * 100_000 + F.col("ordinal")).alias("segment_no"), "chapter_ordinal")
    j = s.join(g, "segment_id")
    c = j.groupBy("work_id", "window_id").agg(
        F.min("ordinal").alias("position"), F.collect_list(F.struct("segment_id", "segment_no", "start_char", "end_char")).alias("spans"), F.collect_set(F.col("chapter_ordinal").cast("string")).alias("entries")
    )
    return reduce.merge_scenes(c.select("work_id", F.col("window_id").alias("candidate_id"), "position", "spans", F.lit("").alias("signature"), "entries"))


@query(
    "agg7_out_of_order",
    f"with c as (select chapter_id, work_id, source_id, ordinal, declared_number, lag(declared_number) over (partition by work_id order by ordinal, chapter_id) as p from {CHP} where status = 'READY' and declared_number is not null) select work_id, chapter_id, declared_number, p as previous_number from c where declared_number <= p",
)
def agg7(spark, d):
    """Ready chapters whose number is not above the one before."""
    c = once(spark, d, "chapter_ref").where("status = 'READY'")
    return checks.out_of_order(c, "work_id", ["ordinal", "chapter_id"], "declared_number", "chapter_id")


@query(
    "agg7_missing_numbers",
    f"""
with c as (select work_id, declared_number from {CHP} where status = 'READY'), f as (select work_id from c group by work_id having count(*) filter (where declared_number is null) = 0),
d as (select distinct work_id, declared_number as n from c where work_id in (select work_id from f)), g as (select work_id, n + 1 as first_missing, lead(n) over (partition by work_id order by n) - 1 as last_missing from d)
select work_id, first_missing, last_missing, sum(last_missing - first_missing + 1) over (partition by work_id)::bigint as n_missing, sum(last_missing - first_missing + 1) over (partition by work_id) > 10000 as too_many from g where last_missing >= first_missing
""",
)
def agg7b(spark, d):
    """Gaps in the numbering of works whose ready chapters are all numbered."""
    return checks.missing_numbers(once(spark, d, "chapter_ref").where("status = 'READY'"), "work_id", "declared_number")


@query("agg8_work_checks", f"""
with c as (select work_id, count(*) filter (where status = 'DUPLICATE') as dup, count(*) filter (where declared_number is null) as unknown from {CHP} where work_id is not null group by work_id)
select work_id, case when dup > 0 then 'FAIL' when unknown = 0 then 'PASS' else 'UNRESOLVED' end as result from c
""")
def agg8(spark, d):
    """Roll-up of the checks of each work: any failure fails, all passed passes."""
    c = once(spark, d, "chapter_ref").where("work_id is not null").groupBy("work_id").agg(F.count_if(F.col("status") == "DUPLICATE").alias("dup"), F.count_if(F.col("declared_number").isNull()).alias("unknown"))
    return c.select("work_id", checks.overall(F.array(F.when(F.col("dup") > 0, "FAIL").otherwise("PASS"), F.when(F.col("unknown") > 0, "UNRESOLVED").otherwise("PASS"))).alias("result"))


@query(
    "agg11_retry_chains",
    f"""
with recursive r as (select distinct retrieval_id, retry_of from {RES} where retrieval_id is not null), k as (select retrieval_id, case when retry_of in (select retrieval_id from r) then retry_of end as up from r),
c as (select retrieval_id, retrieval_id as root, 0 as depth from k where up is null union all select k.retrieval_id, c.root, c.depth + 1 from k join c on k.up = c.retrieval_id)
select retrieval_id, root, depth from c
""",
)
def agg11(spark, d):
    """Root and depth of each attempt in its chain of retries."""
    return checks.retry_chains(once(spark, d, "response", "retrieval_id", "retry_of").where("retrieval_id is not null"), "retrieval_id", "retry_of")


@query("agg12_set_hash", f"select work_id, 'sha256:' || sha256('[' || string_agg(distinct '\"' || segment_id || '\"', ',' order by '\"' || segment_id || '\"') || ']') as set_hash from {SEG} where work_id is not null and segment_id is not null group by work_id")
def agg12(spark, d):
    """Hash of each work's set of segments."""
    s = once(spark, d, "segment", "work_id", "segment_id").where("work_id is not null and segment_id is not null")
    return s.groupBy("work_id").agg(ids.set_hash(F.collect_set("segment_id")).alias("set_hash"))


@query("agg13_argmax", f"select source_id, max_by(retrieval_id, struct_pack(n := octet_length(body), r := retrieval_id)) as largest, max(octet_length(body)) as n_bytes from {RES} where body is not null and source_id is not null group by source_id")
def agg13(spark, d):
    """Largest response of each source, ties by id."""
    r = once(spark, d, "response").where("body is not null and source_id is not null").withColumn("n", F.octet_length("body"))
    return r.groupBy("source_id").agg(F.max_by("retrieval_id", F.struct("n", "retrieval_id")).alias("largest"), F.max("n").alias("n_bytes"))


@query("agg14_closure", f"select 'sha256:' || sha256(body) as artifact_id from {RES} where body is not null union select normalized_text_hash from {SEG} where normalized_text_hash is not null union select s.normalized_text_hash from (select unnest(source_spans) as s from {WIN})")
def agg14(spark, d):
    """Every artifact that some record names."""
    b = table(spark, d, "response").where("body is not null").select(F.concat(F.lit("sha256:"), F.sha2("body", 256)).alias("artifact_id"))
    s = table(spark, d, "segment").select(F.col("normalized_text_hash").alias("artifact_id")).where("artifact_id is not null")
    w = table(spark, d, "scene_window").select(F.explode("source_spans").alias("s")).select(F.col("s.normalized_text_hash").alias("artifact_id"))
    return b.union(s).union(w).distinct()


@query("anl8_failure_runs", f"""
with r as (select *, coalesce(status in (429, 500, 502, 503, 504) or status is null, false) as f from {RES} where source_id is not null), i as (select *, sum(case when f then 0 else 1 end) over (partition by source_id order by retrieved_at, retrieval_id rows unbounded preceding) as island from r)
select source_id, island_no::int as run_no, n_rows from (select source_id, island, count(*) as n_rows, row_number() over (partition by source_id order by island) as island_no from i where f group by source_id, island)
""")
def anl8(spark, d):
    """Runs of consecutive failures of each source."""
    r = once(spark, d, "response").where("source_id is not null")
    return checks.runs(r, ["source_id"], ["retrieved_at", "retrieval_id"], F.col("status").isin(429, 500, 502, 503, 504) | F.col("status").isNull())


@query("fn2_derived_id", f"select work_id, 'NWK-' || upper(left(sha256('{{\"author\":' || coalesce(to_json(author)::varchar, 'null') || ',\"title\":' || to_json(title)::varchar || '}}'), 20)) as derived from {WRK} where title is not null")
def fn2(spark, d):
    """Id of each work derived from its title and author."""
    w = once(spark, d, "novel_work").where("title is not null")
    return w.select("work_id", ids.derived_id("NWK", ids.canonical_json(("title", F.col("title")), ("author", F.col("author")))).alias("derived"))


@query("fn3_id_check", f"select segment_id, regexp_full_match(segment_id, 'SEG-[0-9A-F]{{16}}-[0-9]{{3}}') as is_id, regexp_full_match(normalized_text_hash, 'sha256:[0-9a-f]{{64}}') as is_hash from {SEG} where segment_id is not null and normalized_text_hash is not null")
def fn3(spark, d):
    """Whether ids and hashes of segments have their form."""
    s = once(spark, d, "segment").where("segment_id is not null and normalized_text_hash is not null")
    return s.select("segment_id", F.col("segment_id").rlike("^SEG-[0-9A-F]{16}-[0-9]{3}$").alias("is_id"), fx.is_sha256(F.col("normalized_text_hash")).alias("is_hash"))


@query("flt8_payload_rules", "select event_id, json_valid(props) and json_type(props) = 'OBJECT' and json_exists(props, '/k') and len(json_keys(props)) = 1 as is_valid from events where props is not null")
def flt8(spark, d):
    """Events whose properties have exactly the allowed keys."""
    e = table(spark, d, "events").where("props is not null")
    keys = F.json_object_keys("props")
    return e.select("event_id", F.coalesce(F.size(F.array_except(keys, F.array(F.lit("k")))) + F.size(F.array_except(F.array(F.lit("k")), keys)) == 0, F.lit(False)).alias("is_valid"))


@query("flt11_limits", "select count(*) filter (where length(text) > 4000) as n_over, max(length(text)) as longest from documents")
def flt11(spark, d):
    """Texts over a limit: counted, never cut."""
    n = F.length("text")
    return table(spark, d, "documents").agg(F.count_if(n > 4000).alias("n_over"), F.max(n).alias("longest"))


@query("flt12_ordered_partition", f"""
select work_id, chapter_ordinal, document_id, max(ordinal) - min(ordinal) + 1 = count(distinct ordinal) and count(distinct ordinal) = count(distinct segment_id) as is_contiguous, count(distinct segment_id) as n
from {SEG} where work_id is not null group by work_id, chapter_ordinal, document_id
""")
def flt12(spark, d):
    """Whether the stored ordinals of each document's segments are one gapless order of them."""
    s = once(spark, d, "segment", "work_id", "chapter_ordinal", "document_id", "ordinal", "segment_id").where("work_id is not null")
    n = F.count_distinct("ordinal")
    whole = (F.max("ordinal") - F.min("ordinal") + 1 == n) & (n == F.count_distinct("segment_id"))
    return s.groupBy("work_id", "chapter_ordinal", "document_id").agg(whole.alias("is_contiguous"), F.count_distinct("segment_id").alias("n"))


@query("set2_set_algebra", _two_sites_sql("select (select count(*) from (select h from x intersect select h from y)) as n_both, (select count(*) from (select h from x except select h from y)) as n_first_only, (select count(*) from (select h from x union select h from y)) as n_any"))
def set2(spark, d):
    """Intersection, difference and union of the texts on two sites."""
    a, b = _two_sites(spark, d)
    x, y = a.select("h"), b.select("h")
    one = lambda df, n: df.agg(F.count("*").alias(n))
    return one(x.intersect(y), "n_both").crossJoin(one(x.subtract(y), "n_first_only")).crossJoin(one(x.union(y).distinct(), "n_any"))


@query("stf1_pending_work", f"select document_id from (select distinct document_id from {CHP} where document_id is not null) c where not exists (select 1 from segment s where s.document_id = c.document_id)")
def stf1(spark, d):
    """Documents that have no segments yet: what an interrupted run has left."""
    c = once(spark, d, "chapter_ref", "document_id").where("document_id is not null")
    return checks.pending(c, table(spark, d, "segment"), "document_id")


@query("stf5_replay", f"select segment_id, normalized_text_hash as stored_hash from {SEG} where normalized_text is not null and normalized_text_hash <> 'sha256:' || sha256(normalized_text)")
def stf5(spark, d):
    """Stored hashes that their recomputation does not give."""
    s = once(spark, d, "segment").where("normalized_text is not null and normalized_text_hash is not null")
    stored = s.select("segment_id", F.col("normalized_text_hash").alias("h"))
    again = s.select("segment_id", fx.text_hash(F.col("normalized_text")).alias("h"))
    return checks.replay_differs(stored, again).where("side = 'stored'").select("segment_id", F.col("h").alias("stored_hash"))


@query("udx2_pending_windows", f"select window_id from (select distinct window_id from {WIN} where window_id is not null) w where not exists (select 1 from (select unnest(source_spans) as s, window_id from {WIN}) x where x.window_id = w.window_id and s.start_char > 0)")
def udx2(spark, d):
    """Windows without an answer, where windows that cut into a segment count as answered."""
    w = once(spark, d, "scene_window")
    done = w.where(F.exists("source_spans", lambda s: s["start_char"] > 0)).select("window_id")
    return checks.pending(w.where("window_id is not null").select("window_id").distinct(), done, "window_id")
