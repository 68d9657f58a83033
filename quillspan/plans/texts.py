"""Queries over texts, titles, locators and pages."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspan.functions import ids
from quillspan.functions import text as fx
from quillspan.operators import parse, urls

from .registry import CHP, DOM, RES, SEG, WRK, Registry, once
from .session import table

query = Registry()
QUERIES, SQL = query.queries, query.sql
BLANK = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


@query("txt1_normalize_text")
def txt1(spark, d):
    """Every document's text in compatibility form with collapsed white space (no SQL: DuckDB lacks the form)."""
    t = table(spark, d, "documents").select("doc_id", fx.normalize_text(F.col("text")).alias("t"))
    return t.select("doc_id", F.length("t").alias("n_chars"), fx.text_hash(F.col("t")).alias("text_hash"))


@query("txt2_decode_bodies")
def txt2(spark, d):
    """Encoding of every body by detection alone."""
    b = once(spark, d, "response", "retrieval_id", "body").where("retrieval_id is not null")
    return parse.decoded(b, "retrieval_id", "body").select("retrieval_id", "encoding", "error", F.length("text").alias("n_chars"))


@query(
    "txt3_line_segments",
    f"""
with t as (select doc_id, replace(text, chr(13), chr(10)) as text from documents where text is not null),
p as (select doc_id, unnest(string_split(text, chr(10))) as raw_line, generate_subscripts(string_split(text, chr(10)), 1) as k from t),
o as (select *, coalesce(sum(length(raw_line) + 1) over (partition by doc_id order by k rows between unbounded preceding and 1 preceding), 0) as raw_start from p)
select doc_id, raw_start::int as raw_start, (raw_start + length(raw_line))::int as raw_end, (row_number() over (partition by doc_id order by raw_start) - 1)::int as ordinal, length(raw_line) as n_chars
from o where regexp_replace(raw_line, '{BLANK}', '', 'g') <> ''
""",
)
def txt3(spark, d):
    """Line segments of every document with their offsets."""
    out = parse.lines(table(spark, d, "documents").where("text is not null"), "doc_id", "text")
    return out.select("doc_id", "raw_start", "raw_end", "ordinal", F.length("raw_line").alias("n_chars"))


@query(
    "txt4_page_segments",
    f"""
with s as (select distinct document_id, ordinal, normalized_text from {SEG} where normalized_text is not null),
l as (select document_id, ordinal, list_filter(list_transform(string_split(normalized_text, chr(10)), lambda x: trim(regexp_replace(x, '{BLANK}', ' ', 'g'))), lambda x: x <> '') as l from s),
p as (select * from l where len(l) > 0),
g as (select document_id, count(*) >= 2 as many, min(l[1]) = max(l[1]) as head, min(l[-1]) = max(l[-1]) as foot from p group by document_id),
c as (select p.document_id, ordinal, l[(case when many and head then 2 else 1 end):(len(l) - case when many and foot then 1 else 0 end)] as kept from p join g using (document_id))
select document_id, ordinal, array_to_string(kept, ' ') as page_text from c where array_to_string(kept, ' ') <> ''
""",
)
def txt4(spark, d):
    """Segments read as the pages of their document, without running heads."""
    s = once(spark, d, "segment", "document_id", "ordinal", "normalized_text").where("normalized_text is not null")
    return parse.pages(s, "document_id", "ordinal", "normalized_text")


@query(
    "txt5_parser_dispatch",
    f"""
select case when contains(lower(coalesce(content_type, '')), 'application/pdf') then 'pdf' when starts_with(lower(coalesce(content_type, '')), 'text/plain') then 'text' else 'html' end as parser, count(*) as n
from (select distinct retrieval_id, content_type, body from response) group by 1
""",
)
def txt5(spark, d):
    """Which parser the bodies go to."""
    r = once(spark, d, "response", "retrieval_id", "content_type", "body")
    return r.groupBy(parse.parser_kind(F.col("body"), F.col("content_type")).alias("parser")).agg(F.count("*").alias("n"))


@query("txt7_text_hash", f"select segment_id, 'sha256:' || sha256(normalized_text) as text_hash, normalized_text_hash = 'sha256:' || sha256(normalized_text) as is_stored from {SEG} where normalized_text is not null")
def txt7(spark, d):
    """Hash of each stored text and whether it is the one stored beside it."""
    s = once(spark, d, "segment").where("normalized_text is not null")
    h = fx.text_hash(F.col("normalized_text"))
    return s.select("segment_id", h.alias("text_hash"), (F.col("normalized_text_hash") == h).alias("is_stored"))


@query("html1_blocks")
def html1(spark, d):
    """Block texts of all HTML pages, read by the charset that they declare or by detection (roots first; tag soup needs a parser, so no SQL)."""
    r = table(spark, d, "response").where("retrieval_id is not null and body is not null and octet_length(body) > 0 and lower(content_type) like 'text/html%'")
    r = r.groupBy("retrieval_id").agg(F.min("body").alias("body"))
    return parse.html_blocks(parse.page_texts(r, "retrieval_id", "body"), "retrieval_id", "page")


@query(
    "html3_links",
    f"""
with a as (select retrieval_id, node_no, attrs['href'] as href from {DOM} where tag = 'a'),
r as (select retrieval_id, min(requested_url) as url from {RES} group by retrieval_id)
select retrieval_id, node_no, lower(regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+)', 1)) || href as link
from a join r using (retrieval_id) where href is not null and starts_with(href, '/') and length(href) <= 8192
""",
)
def html3(spark, d):
    """Root-relative links of the parsed pages, resolved against their origin."""
    a = table(spark, d, "dom_node").where("tag = 'a'").select("retrieval_id", "node_no", F.element_at("attrs", "href").alias("href")).distinct()
    r = once(spark, d, "response", "retrieval_id", "requested_url").groupBy("retrieval_id").agg(F.min("requested_url").alias("url"))
    a = a.where(F.col("href").isNotNull() & F.col("href").startswith("/") & (F.length("href") <= 8192))
    return a.join(r, "retrieval_id").select("retrieval_id", "node_no", F.concat(urls.origin(F.col("url")), "href").alias("link"))


@query(
    "html4_titles",
    f"""
with n as (select retrieval_id, tag, min_by(trim(node_text), node_no) as t from {DOM} where tag in ('h1', 'title', 'h2') and trim(node_text) <> '' group by retrieval_id, tag)
select retrieval_id, coalesce(max(case when tag = 'h1' then t end), max(case when tag = 'title' then t end), max(case when tag = 'h2' then t end)) as title from n group by retrieval_id
""",
)
def html4(spark, d):
    """Title of each parsed page: the first h1, else title, else h2."""
    n = table(spark, d, "dom_node").where("tag in ('h1', 'title', 'h2') and trim(node_text) <> ''").groupBy("retrieval_id", "tag").agg(F.min_by(F.trim("node_text"), "node_no").alias("t"))
    pick = lambda tag: F.max(F.when(F.col("tag") == tag, F.col("t")))
    return n.groupBy("retrieval_id").agg(F.coalesce(pick("h1"), pick("title"), pick("h2")).alias("title"))


@query(
    "html5_single_match",
    f"""
with m as (select retrieval_id, node_no from {DOM} where list_contains(string_split(coalesce(attrs['class'], ''), ' '), 'chapter-body'))
select retrieval_id, min(node_no)::int as node_no from m group by retrieval_id having count(*) = 1
""",
)
def html5(spark, d):
    """Pages with exactly one element of a class."""
    return parse.single_match(table(spark, d, "dom_node"), ".chapter-body")


@query("chp1_chapter_number")
def chp1(spark, d):
    """Number read from each chapter title beside the declared one (a fold over numerals; tested against Python)."""
    c = once(spark, d, "chapter_ref")
    return c.select("chapter_id", fx.directory_number(F.col("title")).alias("title_number"), "declared_number")


@query(
    "chp2_chapter_kind",
    f"""
select chapter_id, case when regexp_matches(lower(title), '(?:^|[-_])(nav|toc)(?:$|[-_])') then 'NAVIGATION' when declared_number is not null then 'MAIN'
 when regexp_matches(lower(title), '序章|楔子|引子|prologue') then 'PROLOGUE' when regexp_matches(lower(title), '尾声|epilogue') then 'EPILOGUE'
 when regexp_matches(lower(title), '番外|后记|後記|附录|附錄|extra|appendix') then 'EXTRA'
 when regexp_matches(lower(title), '封面|版权|版權|目录|目錄|书名页|書名頁|title.?page|copyright|cover') then 'FRONTMATTER' else 'UNKNOWN' end as kind
from {CHP} where title is not null
""",
)
def chp2(spark, d):
    """Kind of each chapter by its title and number."""
    c = once(spark, d, "chapter_ref").where("title is not null")
    return c.select("chapter_id", fx.chapter_kind(F.col("title"), F.col("declared_number")).alias("kind"))


@query(
    "chp3_identity_confidence",
    f"""
select chapter_kind, case when declared_number is not null then 'HIGH' when chapter_kind <> 'UNKNOWN' then 'MEDIUM' else 'UNKNOWN' end as confidence,
 case when chapter_kind in ('FRONTMATTER', 'NAVIGATION') then 'IGNORED' when duplicate_of is not null then 'DUPLICATE' else 'READY' end as state, count(*) as n
from {CHP} group by all
""",
)
def chp3(spark, d):
    """How surely chapters are identified, and which count."""
    c = once(spark, d, "chapter_ref")
    conf = F.when(F.col("declared_number").isNotNull(), "HIGH").when(F.col("chapter_kind") != "UNKNOWN", "MEDIUM").otherwise("UNKNOWN")
    state = F.when(F.col("chapter_kind").isin("FRONTMATTER", "NAVIGATION"), "IGNORED").when(F.col("duplicate_of").isNotNull(), "DUPLICATE").otherwise("READY")
    return c.groupBy("chapter_kind", conf.alias("confidence"), state.alias("state")).agg(F.count("*").alias("n"))


@query("chp4_heading_identity")
def chp4(spark, d):
    """Chapters with the number in their first numbered heading segment, and whether it is the declared one, else the ordinal."""
    s = once(spark, d, "segment", "document_id", "ordinal", "normalized_text")
    s = s.withColumn("heading_number", fx.chapter_number(F.col("normalized_text"))).where("heading_number is not null and length(normalized_text) <= 80")
    first = s.groupBy("document_id").agg(F.min_by("heading_number", "ordinal").alias("heading_number"))
    c = once(spark, d, "chapter_ref", "chapter_id", "document_id", "ordinal", "declared_number")
    return c.join(first, "document_id").select("chapter_id", "heading_number", (F.col("heading_number") == F.coalesce("declared_number", "ordinal")).alias("agrees"))


@query(
    "src1_book_chapters",
    """
with t as (select doc_id, unnest(string_split(replace(text, chr(13), ''), chr(10))) as line, generate_subscripts(string_split(replace(text, chr(13), ''), chr(10)), 1) as k from documents where doc_kind = 'chapter' and text is not null),
h as (select *, regexp_extract(line, '^[^\\S\\r\\n]*(第\\s*[0-9零〇一二两三四五六七八九十百千万]+\\s*[章节回][^\\r\\n]*)$', 1) as title from t),
c as (select *, sum(case when title <> '' then 1 else 0 end) over (partition by doc_id order by k rows unbounded preceding) as c from h),
g as (select doc_id, c, max(nullif(title, '')) as title, sum(case when title = '' then length(line) else 0 end) as n_chars, bool_or(title = '' and trim(line) <> '') as has_body from c group by doc_id, c)
select doc_id, row_number() over (partition by doc_id order by c) as ordinal, trim(coalesce(title, '前置内容')) as title from g where c > 0 or has_body
""",
)
def src1(spark, d):
    """Chapters of the documents that are book text."""
    docs = table(spark, d, "documents").where("doc_kind = 'chapter' and text is not null")
    return parse.chapters(docs, "doc_id", "text").select("doc_id", "ordinal", "title")


@query("src2_directory_manifest")
def src2(spark, d):
    """Manifest of a folder in natural order: path, size and content id of every file."""
    from quillspan.sources.files import directory_manifest

    return directory_manifest(spark, d, "*.parquet")


@query(
    "src6_status_class",
    f"""
select case when status is null then 'NO_RESPONSE' when status in (429, 500, 502, 503, 504) then 'RETRYABLE' when status between 300 and 399 then 'REDIRECT' when status in (401, 403) then 'NEEDS_ACCESS'
 when status in (404, 410) then 'MISSING' when status between 200 and 299 then 'FETCHED' else 'OTHER' end as class, count(*) as n from {RES} group by 1
""",
)
def src6(spark, d):
    """Classes of responses by status."""
    s = F.col("status")
    cls = F.when(s.isNull(), "NO_RESPONSE").when(s.isin(429, 500, 502, 503, 504), "RETRYABLE").when(s.between(300, 399), "REDIRECT").when(s.isin(401, 403), "NEEDS_ACCESS").when(s.isin(404, 410), "MISSING").when(s.between(200, 299), "FETCHED").otherwise("OTHER")
    return once(spark, d, "response").groupBy(cls.alias("class")).agg(F.count("*").alias("n"))


@query(
    "src9_json_hits",
    f"""
with j as (select retrieval_id, try(decode(body)) as t from {RES} where starts_with(lower(content_type), 'application/json') and body is not null and octet_length(body) > 0 and retrieval_id is not null and try(decode(body)) is not null)
select retrieval_id, json_extract_string(t, '$.title') as title, json_extract_string(t, '$.author') as author, length(json_extract_string(t, '$.content')) as n_chars from j where json_valid(t)
""",
)
def src9(spark, d):
    """Title, author and length of the entries in JSON responses that are whole and well formed."""
    r = once(spark, d, "response", "retrieval_id", "content_type", "body").where("lower(content_type) like 'application/json%' and body is not null and octet_length(body) > 0 and retrieval_id is not null")
    r = r.where(F.is_valid_utf8(F.col("body").cast("string"))).select("retrieval_id", F.col("body").cast("string").alias("t"))
    r = r.withColumn("v", F.try_parse_json("t")).where("v is not null")
    f = lambda k, kind="string": F.try_variant_get("v", f"$.{k}", kind)
    return r.select("retrieval_id", f("title").alias("title"), f("author").alias("author"), F.length(f("content")).alias("n_chars"))


@query("src10_strict_json", "select event_id, json_valid(props) as is_valid from events where props is not null")
def src10(spark, d):
    """Strict reading of the events' properties."""
    e = table(spark, d, "events").where("props is not null").select("event_id", ids.strict_json(F.col("props")).alias("s"))
    return e.select("event_id", "s.is_valid")


@query("snk6_safe_filename", f"""
select chapter_id, lpad(ordinal::varchar, 6, '0') || '__' || trim(regexp_replace(regexp_replace(nfc_normalize(title), '[<>:"/\\\\|?*]', ' ', 'g'), '\\s+', ' ', 'g'), ' .') || '__' || left(sha256(chapter_key), 10) || '.txt' as file_name
from {CHP} where title is not null and chapter_key is not null
""")
def snk6(spark, d):
    """Safe file name of each chapter."""
    c = once(spark, d, "chapter_ref").where("title is not null and chapter_key is not null")
    return c.select("chapter_id", fx.safe_filename(F.col("ordinal"), F.col("title"), F.col("chapter_key")).alias("file_name"))


@query(
    "snk3_canonical_jsonl",
    f"select work_id, '{{\"author\":' || coalesce(to_json(author)::varchar, 'null') || ',\"title\":' || coalesce(to_json(title)::varchar, 'null') || ',\"work_id\":' || to_json(work_id)::varchar || '}}' as line from {WRK} where work_id is not null",
)
def snk3(spark, d):
    """One canonical JSON object per work."""
    w = once(spark, d, "novel_work").where("work_id is not null")
    return w.select("work_id", ids.canonical_json(("work_id", F.col("work_id")), ("title", F.col("title")), ("author", F.col("author"))).alias("line"))


@query("wrk1_work_title", f"select work_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(title), '[《》]', '', 'g'), '(?i)\\s*[-—_]\\s*(维基百科|Wikipedia).*$', ''), '\\s*[（(](小说|网络小说|作品)[）)]\\s*$', ''), '\\s+', ' ', 'g')) as canonical_title from {WRK} where title is not null")
def wrk1(spark, d):
    """Work titles in one form."""
    return once(spark, d, "novel_work").where("title is not null").select("work_id", fx.work_title(F.col("title")).alias("canonical_title"))


@query(
    "flt5_canonical_url",
    f"""
with u as (select distinct source_locator as url from {CHP} where source_locator like '%://%'),
p as (select url, lower(regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*)://', 1)) as scheme, lower(regexp_extract(url, '^[^:]+://([^/?#:]+)', 1)) as host, regexp_extract(url, '^[^:]+://[^/?#:]+:([0-9]+)', 1) as port,
 regexp_extract(url, '^[^:]+://[^/?#]*([^?#]*)', 1) as path, array_to_string(list_sort(list_filter(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&'), lambda x: x <> '')), '&') as q from u)
select url, scheme || '://' || host || case when port = '' or (scheme = 'http' and port = '80') or (scheme = 'https' and port = '443') then '' else ':' || port end || case when path = '' then '/' else path end || case when q = '' then '' else '?' || q end as canonical from p where host <> ''
""",
)
def flt5(spark, d):
    """Locators in one form, in the JVM; the Arrow form is tested equal on the same rows."""
    u = table(spark, d, "chapter_ref").where("source_locator like '%://%'").select(F.col("source_locator").alias("url")).distinct()
    return u.select("url", urls.canonical_native(F.col("url")).alias("canonical")).where("canonical is not null")


@query("fn4_chapter_key", f"""
with s as (select chapter_id, ordinal, left(trim(regexp_replace(title, '[^0-9A-Za-z\\x{{3400}}-\\x{{9fff}}]+', '-', 'g'), '-'), 48) as slug from {CHP} where title is not null)
select chapter_id, 'chapter-' || lpad(ordinal::varchar, 6, '0') || '-' || case when slug = '' then 'untitled' else slug end as key from s
""")
def fn4(spark, d):
    """Key of each chapter from its ordinal and title."""
    return once(spark, d, "chapter_ref").where("title is not null").select("chapter_id", fx.chapter_key(F.col("ordinal"), F.col("title")).alias("key"))


@query("fn5_file_stem", """
with w as (select distinct window_id from scene_window where window_id is not null)
select window_id, trim(regexp_replace(window_id, '[^0-9A-Za-z._-]+', '-', 'g'), '-') || '--' || left(sha256(window_id), 12) as stem from w
""")
def fn5(spark, d):
    """Safe stem of a task file for each window."""
    return table(spark, d, "scene_window").select("window_id").distinct().where("window_id is not null").select("window_id", fx.file_stem(F.col("window_id")).alias("stem"))


@query("fn6_comparison_text", f"select doc_id, sha256(trim(regexp_replace(nfc_normalize(text), '{BLANK}', ' ', 'g'))) as h from documents where text is not null")
def fn6(spark, d):
    """Documents in the form that compares sources."""
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.sha2(fx.comparison_text(F.col("text")).cast("binary"), 256).alias("h"))


@query(
    "fn7_edit_distance",
    """
with p as (select distinct a.p_name as a, b.p_name as b from part a join part b on a.p_brand = b.p_brand and a.p_type = b.p_type and a.p_size = b.p_size and a.p_name < b.p_name)
select a, b, levenshtein(a, b)::int as distance from p
""",
)
def fn7(spark, d):
    """Edit distance of the names of like parts (ASCII: DuckDB counts bytes)."""
    p = table(spark, d, "part").select("p_name", "p_brand", "p_type", "p_size")
    q = p.withColumnRenamed("p_name", "b")
    j = p.withColumnRenamed("p_name", "a").join(q, ["p_brand", "p_type", "p_size"]).where("a < b").select("a", "b").distinct()
    return j.select("a", "b", fx.bounded_levenshtein(F.col("a"), F.col("b")).alias("distance"))


@query("fn9_squashed", f"select work_id, regexp_replace(lower(title), '{BLANK}', '', 'g') as squashed from {WRK} where title is not null")
def fn9(spark, d):
    """Titles in lower case without white space."""
    return once(spark, d, "novel_work").where("title is not null").select("work_id", fx.squashed(F.col("title")).alias("squashed"))


@query("fn10_json_pointer", "select event_id, json_exists(props, '/k') as found from events where props is not null")
def fn10(spark, d):
    """Whether a pointer resolves in the events' properties."""
    e = table(spark, d, "events").where("props is not null")
    return e.select("event_id", ids.json_pointer(F.col("props"), F.lit("/k")).alias("p")).select("event_id", "p.found")


@query(
    "fn11_timestamps",
    f"select retrieval_id, strftime(date_trunc('second', retrieved_at), '%Y-%m-%dT%H:%M:%SZ') as iso, epoch_us(retrieved_at) // 1000 as ms, case when regexp_matches(retry_after, '^[0-9]+$') then retry_after::bigint * 1000 when retry_after is not null then 900000 end as wait_ms from {RES} where retrieved_at is not null",
)
def fn11(spark, d):
    """Times of responses as ISO text and epoch milliseconds, and how long a retry should wait (900 s unless seconds are given)."""
    r = once(spark, d, "response").where("retrieved_at is not null")
    ts = F.col("retrieved_at").cast("timestamp")
    wait = F.when(F.col("retry_after").rlike("^[0-9]+$"), F.col("retry_after").try_cast("bigint") * 1000).when(F.col("retry_after").isNotNull(), F.lit(900000).cast("bigint"))
    return r.select("retrieval_id", F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("iso"), F.unix_millis(ts).alias("ms"), wait.alias("wait_ms"))


@query("srt2_natural_order", f"""
with c as (select distinct chapter_key from {CHP} where chapter_key is not null),
k as (select chapter_key, regexp_extract(chapter_key, '^([^0-9]*)', 1) as head, regexp_extract(chapter_key, '^[^0-9]*([0-9]+)', 1) as num from c)
select chapter_key, lower(head) as head, try_cast(num as bigint) as number from k
""")
def srt2(spark, d):
    """First text and number of the natural sort key of each chapter key."""
    k = once(spark, d, "chapter_ref", "chapter_key").where("chapter_key is not null").withColumn("k", fx.natural_key(F.col("chapter_key")))
    return k.select("chapter_key", F.coalesce(F.try_element_at("k", F.lit(1)), F.lit("")).alias("head"), F.try_element_at("k", F.lit(2)).try_cast("bigint").alias("number"))
