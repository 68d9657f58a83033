"""URLs in one form, their origin and scope, and the links of pages."""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import parse_qsl, urlencode, urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def canonical_url(url: str) -> str | None:
    """Lower-case scheme and host, no default port, fragment or parameters, sorted query with blanks kept, path at least ``/``."""
    try:
        u = urlsplit(url.strip())
        port = u.port
    except ValueError:
        return None
    scheme, host = u.scheme.lower(), (u.hostname or "").lower()
    if not scheme or not host:
        return None
    if port and not (scheme == "http" and port == 80 or scheme == "https" and port == 443):
        host = f"{host}:{port}"
    path = u.path.split(";", 1)[0] if ";" in u.path.rsplit("/", 1)[-1] else u.path
    query = urlencode(sorted(parse_qsl(u.query, keep_blank_values=True)))
    return f"{scheme}://{host}{path or '/'}" + (f"?{query}" if query else "")


@F.pandas_udf(T.StringType())
def canonicalize(url: pd.Series) -> pd.Series:
    return url.map(lambda u: None if u is None else canonical_url(u))


def canonical_native(url: Column) -> Column:
    """The same form for URLs whose query needs no re-encoding, without leaving the JVM; null for other locators."""
    scheme = F.lower(F.regexp_extract(url, r"^([a-zA-Z][a-zA-Z0-9+.-]*)://", 1))
    host = F.lower(F.regexp_extract(url, r"^[^:]+://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    port = F.regexp_extract(url, r"^[^:]+://(?:[^/?#@]*@)?[^/?#:]+:([0-9]+)", 1)
    path = F.regexp_extract(url, r"^[^:]+://[^/?#]*([^?#]*)", 1)
    query = F.array_join(F.array_sort(F.filter(F.split(F.regexp_extract(url, r"\?([^#]*)", 1), "&"), lambda x: x != "")), "&")
    default = (port == "") | ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443"))
    out = F.concat(scheme, F.lit("://"), host, F.when(default, "").otherwise(F.concat(F.lit(":"), port)), F.when(path == "", "/").otherwise(path), F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))
    return F.when(host != "", out)


def origin(url: Column) -> Column:
    """Scheme, host and explicit port."""
    return F.nullif(F.lower(F.regexp_extract(url, r"^([a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?[^/?#]+)", 1)), F.lit(""))


def in_scope(url: Column, base: Column) -> Column:
    """Same origin, and a path below that of the base."""
    path = F.regexp_extract(base, r"^[^:]+://[^/?#]*([^?#]*)", 1)
    own = F.regexp_extract(url, r"^[^:]+://[^/?#]*([^?#]*)", 1)
    return (origin(url) == origin(base)) & own.startswith(path)


LINKS = "page_url string, position int, href string, url string, label string, rel string"


def page_links(pages: DataFrame, url: str, text: str) -> DataFrame:
    """Links of pages in document order, resolved and in one form.

    Empty, over-long (8192) and fragment-only references and schemes other
    than http are left out.
    """
    from html.parser import HTMLParser

    class Anchors(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.found, self.now = [], None

        def handle_starttag(self, tag, attrs):
            if tag == "a":
                a = dict(attrs)
                self.now = [a.get("href") or "", "", a.get("rel") or ""]
                self.found.append(self.now)

        def handle_endtag(self, tag):
            if tag == "a":
                self.now = None

        def handle_data(self, data):
            if self.now is not None:
                self.now[1] += data

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for base, t in zip(pdf[url], pdf[text]):
                p = Anchors()
                p.feed(t or "")
                k = 0
                for href, label, rel in p.found:
                    href = href.strip()
                    if not href or len(href) > 8192 or href.startswith("#"):
                        continue
                    try:
                        full = canonical_url(urljoin(base, href))
                    except ValueError:
                        full = None
                    if full and full.startswith(("http://", "https://")):
                        rows.append((base, k, href, full, " ".join(label.split()), rel))
                        k += 1
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in LINKS.split(", ")])

    return pages.select(url, text).where(F.col(url).isNotNull()).mapInPandas(run, LINKS)


def reachable(links: DataFrame, seeds: DataFrame, max_depth: int | None = None) -> DataFrame:
    """``url, depth`` of every page reachable from the seeds over ``links(from_url, url)``, breadth first.

    Each round joins the frontier with the links and drops what was visited
    (anti join); rounds are written to the shared checkpoint folder so that
    the lineage stays short and survives lost executors. It ends when nothing
    new is found, or behind ``max_depth`` where one is asked for.
    """
    from quillspan.plans.session import cut_lineage

    edges = cut_lineage(links.select("from_url", "url").distinct())
    front = seen = cut_lineage(seeds.select("url").distinct().withColumn("depth", F.lit(0)))
    depth = 0
    while max_depth is None or depth < max_depth:
        depth += 1
        nxt = front.select(F.col("url").alias("from_url")).join(edges, "from_url").select("url").distinct().join(seen, "url", "left_anti").withColumn("depth", F.lit(depth))
        front = cut_lineage(nxt)
        if front.isEmpty():
            break
        seen = cut_lineage(seen.unionByName(front))
    return seen


def crawl_plan(links: DataFrame, seeds: DataFrame, chapter_pattern: str, next_labels: tuple[str, ...] = ("next",), max_pages: int | None = None) -> DataFrame:
    """Chapter links of a site in the order in which a crawl meets them: ``ordinal, url, label, page_url, position, depth``.

    ``links`` has the columns of :func:`page_links`. Index pages are the seeds
    and what they reach over links marked ``rel=next`` (or labelled so) on the
    same origin; a chapter is a link in the scope of its page whose path
    matches the pattern. A chapter counts where it is met first: by depth of
    the page, then address of the page, then position. More than ``max_pages``
    index pages are an error, as a site that never ends would be.
    """
    from .rank import numbered

    same = links.where(origin(F.col("url")) == origin(F.col("page_url")))
    label = F.lower(F.trim("label"))
    onward = same.where(F.array_contains(F.split(F.lower("rel"), r"\s+"), "next") | label.isin(*next_labels))
    index = reachable(onward.select(F.col("page_url").alias("from_url"), "url"), seeds)
    if max_pages is not None and index.limit(max_pages + 1).count() > max_pages:
        raise ValueError(f"more than {max_pages} index pages")
    path = F.regexp_extract("url", r"^[^:]+://[^/?#]*([^?#]*)", 1)
    met = same.join(index.withColumnRenamed("url", "page_url"), "page_url").where(path.rlike(chapter_pattern)).join(index.select("url"), "url", "left_anti")
    first = met.groupBy("url").agg(F.min(F.struct("depth", "page_url", "position", "label")).alias("m")).select("url", "m.*")
    return numbered(first, [F.col("depth"), F.col("page_url"), F.col("position"), F.col("url")], "ordinal").select("ordinal", "url", "label", "page_url", "position", "depth")
