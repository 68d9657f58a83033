"""Registration of queries with their SQL."""

from __future__ import annotations


class Registry:
    def __init__(self):
        self.queries, self.sql = {}, {}

    def __call__(self, name: str, sql: str | None = None):
        def add(f):
            self.queries[name] = f
            if sql is not None:
                self.sql[name] = sql.strip()
            return f

        return add


#: Segments once: the table holds about one repeated row in a hundred.
SEG = "(select distinct segment_id, document_id, work_id, chapter_ordinal, ordinal, segment_type, normalized_text, normalized_text_hash, selector, raw_start, raw_end from segment)"
CHP = "(select distinct chapter_id, work_id, document_id, source_id, chapter_key, ordinal, declared_number, title, chapter_kind, source_locator, media_type, status, duplicate_of from chapter_ref)"
RES = "(select distinct retrieval_id, source_id, requested_url, status, body, content_type, location, retry_after, error, retry_of, retrieved_at from response)"
WRK = "(select distinct work_id, title, author, work_lang, source_kind, source_locator, adapter_build_id from novel_work)"
WIN = "(select distinct window_id, work_id, ordinal, window_chars, overlap_chars, source_spans from scene_window)"
DOM = "(select distinct retrieval_id, node_no, parent_no, tag, attrs, node_text from dom_node)"

COLUMNS = {
    "segment": ["segment_id", "document_id", "work_id", "chapter_ordinal", "ordinal", "segment_type", "normalized_text", "normalized_text_hash", "selector", "raw_start", "raw_end"],
    "chapter_ref": ["chapter_id", "work_id", "document_id", "source_id", "chapter_key", "ordinal", "declared_number", "title", "chapter_kind", "source_locator", "media_type", "status", "duplicate_of"],
    "response": ["retrieval_id", "source_id", "requested_url", "status", "body", "content_type", "location", "retry_after", "error", "retry_of", "retrieved_at"],
    "novel_work": ["work_id", "title", "author", "work_lang", "source_kind", "source_locator", "adapter_build_id"],
    "scene_window": ["window_id", "work_id", "ordinal", "window_chars", "overlap_chars", "source_spans"],
}


def once(spark, sf_dir: str, name: str, *columns: str):
    """A table's rows once, over the columns that are used (late copies differ in none of them)."""
    from .session import table

    return table(spark, sf_dir, name).select(*(columns or COLUMNS[name])).distinct()
