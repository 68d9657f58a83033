import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from quillspan.operators import checks, parse, rank, reduce
from quillspan.operators import windows as wn
from quillspan.sources import files, sinks


def test_lines(spark):
    df = spark.createDataFrame([("d", "标题\r\n第一段\r\n第二段"), ("e", None), ("f", ""), ("g", " \n　\nx")], "k string, t string")
    got = [(r.k, r.selector, r.raw_start, r.raw_end) for r in parse.lines(df, "k", "t").orderBy("k", "ordinal").collect()]
    assert got == [("d", "line:1", 0, 2), ("d", "line:2", 4, 7), ("d", "line:3", 9, 12), ("g", "line:3", 4, 5)]


def test_chapters(spark):
    book = "版权\n\n第一章 入山\n正文一\n\n第二章 拜师\r\n正文二\n"
    df = spark.createDataFrame([("b", book), ("c", "没有标题"), ("d", None)], "k string, t string")
    got = [(r.k, r.ordinal, r.title, r.chapter_kind, r.declared_number, r.body) for r in parse.chapters(df.where("t is not null"), "k", "t").orderBy("k", "ordinal").collect()]
    assert got == [("b", 1, "前置内容", "FRONTMATTER", None, "版权"), ("b", 2, "第一章 入山", "MAIN", 1, "正文一"), ("b", 3, "第二章 拜师", "MAIN", 2, "正文二"), ("c", 1, "前置内容", "UNKNOWN", None, "没有标题")]


def test_pages(spark):
    rows = [("d", 1, "Head\nA\nFoot"), ("d", 2, "Head\nB\nFoot"), ("e", 1, "Head\nA"), ("f", 1, "H"), ("f", 2, "H")]
    got = [(r.doc, r.page, r.page_text) for r in parse.pages(spark.createDataFrame(rows, "doc string, page int, t string"), "doc", "page", "t").orderBy("doc", "page").collect()]
    assert got == [("d", 1, "A"), ("d", 2, "B"), ("e", 1, "Head A")]


def test_html(spark):
    page = '<main><h1>Head</h1><ul><li>One</li><li>Two</li></ul><div>Box</div><p>Pa<b>ra</b></p><nav>no</nav><div class="ad-banner">no</div></main>x'
    df = spark.createDataFrame([("p", page), ("q", None)], "k string, t string")
    got = [(r.selector, r.normalized_text) for r in parse.html_blocks(df, "k", "t").orderBy("ordinal").collect()]
    assert got == [("h1:nth-of-type(1)", "Head"), ("li:nth-of-type(1)", "One"), ("li:nth-of-type(2)", "Two"), ("div:nth-of-type(1)", "Box"), ("p:nth-of-type(1)", "Para")]
    assert df.select(parse.html_title(F.col("t"))).first()[0] == "Head"
    t = spark.createDataFrame([(1, "<title>a &amp; <i>b</i></title>"), (2, "<h2>x</h2><title>y</title>"), (3, "none"), (4, None)], "i int, t string")
    assert [r[0] for r in t.orderBy("i").select(parse.html_title(F.col("t"))).collect()] == ["a & b", "y", None, None]
    r = spark.createDataFrame([('<p>menu</p><div id="bodyContent">x</div>',), ("<article>a</article><main>m</main>",), ("plain",)], "t string")
    assert [x[0] for x in r.select(parse.html_root(F.col("t"))).collect()] == ['<div id="bodyContent">x</div>', "<main>m</main>", "plain"]
    loose = spark.createDataFrame([("k", "<title>T</title>out<p>in</p><div class='sponsored'>no<br></div>tail<div>d</div>e")], "k string, t string")
    assert [(x.selector, x.normalized_text) for x in parse.html_blocks(loose, "k", "t").orderBy("ordinal").collect()] == [("text-node:nth-of-type(1)", "out"), ("p:nth-of-type(1)", "in"), ("text-node:nth-of-type(3)", "tail"), ("div:nth-of-type(1)", "de")]


def test_encodings():
    simplified = "他们在山里过了一年，这是我的国家。" * 4
    traditional = "他們在山裡過了一年，這是我的國家。" * 4
    assert parse.detect(simplified.encode("gb18030"))[1] == "gb18030"
    assert parse.detect(traditional.encode("big5"))[1] == "big5"
    assert parse.detect("é".encode()) == ("é", "utf-8-sig", None)
    assert parse.detect(b"\xff\xff\xff")[2] == "UNDECODABLE"


def test_pages_by_declared_charset(spark):
    text = "他们在山里过了一年，这是我的国家。" * 4
    assert parse.page_text(f'<meta charset="gbk"><p>{text}</p>'.encode("gb18030")).endswith(f"<p>{text}</p>")
    assert parse.page_text(f"<p>{text}</p>".encode("gb18030")) == f"<p>{text}</p>"  # by detection
    assert parse.page_text('<meta charset="nonsense"><p>é</p>'.encode()).endswith("é</p>")
    assert parse.page_text(b"\xff\xff\xff") is None
    df = spark.createDataFrame([("a", bytearray('<meta charset="latin-1"><p>\xe9</p>'.encode("latin-1"))), ("b", bytearray(b"\xff\xff\xff")), ("c", None)], "k string, b binary")
    assert [(r.k, r.normalized_text) for r in parse.html_blocks(parse.page_texts(df, "k", "b"), "k", "page").collect()] == [("a", "é")]


def test_hidden_elements():
    page = "<p>a<br>b</p><aside>x<div>y</div></aside>c<header>h<img></header><svg/>d<div/>e<p>f<script>1<2</script>g"
    assert parse.block_texts(page) == [("p:nth-of-type(1)", "ab"), ("text-node:nth-of-type(2)", "cd"), ("text-node:nth-of-type(3)", "e"), ("p:nth-of-type(1)".replace("1", "2"), "fg")]
    assert parse.block_texts("a<nav>never closed<p>b") == [("text-node:nth-of-type(1)", "a")]


def test_selector(spark):
    rows = [("a", 0, "div", {"class": "x body"}), ("a", 1, "p", {}), ("b", 0, "div", {"class": "body"}), ("b", 1, "p", {"class": "body"})]
    df = spark.createDataFrame(rows, "retrieval_id string, node_no int, tag string, attrs map<string,string>")
    assert [tuple(r) for r in parse.single_match(df, ".body").collect()] == [("a", 0)]
    with pytest.raises(ValueError):
        parse.select_nodes(df, "div > p")


def brute_windows(lens, window, overlap, sep):
    at, places = 0, []
    for n in lens:
        if n:
            places.append((at, at + n))
            at += n + sep
        else:
            places.append(None)
    total, out, k = at - sep if at else 0, set(), 0
    if not total:
        return out
    while True:
        a, b = k * (window - overlap), k * (window - overlap) + window
        for i, p in enumerate(places):
            if p and max(p[0], a) < min(p[1], b):
                out.add((k, i, max(p[0], a) - p[0], min(p[1], b) - p[0]))
        if b >= total:
            return out
        k += 1


@pytest.mark.parametrize("sep", [0, 2])
def test_windows(spark, sep):
    r = random.Random(3)
    works = {f"w{i}": [r.choice([0, 1, 5, 17, 40]) for _ in range(r.randint(0, 25))] for i in range(12)}
    rows = [(w, i // 7, i, f"s{i}", n) for w, lens in works.items() for i, n in enumerate(lens)]
    df = spark.createDataFrame(rows, "work string, ch int, ord int, seg string, n int")
    for window, overlap in ((30, 6), (10, 0), (9, 8)):
        got = wn.window_spans(wn.offsets(df, "work", "ch", ["ord", "seg"], F.col("n"), sep), window, overlap)
        found = {(x.work, x.k, x.ord, x.start_char, x.end_char) for x in got.collect()}
        assert found == {(w, k, i, a, b) for w, lens in works.items() for k, i, a, b in brute_windows(lens, window, overlap, sep)}


def test_window_text_fixture(spark):
    df = spark.createDataFrame([("w", 1, 1, "a", 12000), ("w", 1, 2, "b", 9500)], "work string, ch int, ord int, seg string, n int")
    got = wn.window_spans(wn.offsets(df, "work", "ch", ["ord"], F.col("n")), 10000, 1800)
    gaps = wn.coverage_gaps(got.select("seg", "start_char", "end_char", "n"), "seg", "start_char", "end_char", "n")
    assert gaps.isEmpty() and got.select(F.max("k")).first()[0] == 2


def test_coverage_gaps(spark):
    rows = [("s", 2, 5, 10), ("s", 4, 8, 10), ("t", 0, 3, 3), ("u", None, None, 4)]
    got = wn.coverage_gaps(spark.createDataFrame(rows, "k string, a int, b int, n int"), "k", "a", "b", "n").collect()
    assert {tuple(r) for r in got} == {("s", 0, 2), ("s", 8, 10), ("u", 0, 4)}


def test_coalesce(spark):
    rows = [("s", 0, 2), ("s", 2, 4), ("s", 6, 8), ("t", 1, 9), ("t", 2, 3), ("s", 6, 8)]
    got = wn.coalesce_spans(spark.createDataFrame(rows, "k string, a int, b int"), ["k"], "a", "b").collect()
    assert {(r.k, r.a, r.b) for r in got} == {("s", 0, 4), ("s", 6, 8), ("t", 1, 9)}


def test_overlaps(spark):
    r = random.Random(5)
    spans = [(i, r.choice("xy"), a, a + r.randint(1, 60)) for i in range(60) for a in [r.randint(0, 200)]]
    df = spark.createDataFrame(spans, "i int, k string, a int, b int")
    left = df.select("k", F.col("i").alias("li"), F.col("a").alias("l_start"), F.col("b").alias("l_end"))
    right = df.select("k", F.col("i").alias("ri"), F.col("a").alias("r_start"), F.col("b").alias("r_end"))
    got = [(x.li, x.ri) for x in wn.overlapping_pairs(left, right, ["k"], 25).collect()]
    want = {(x[0], y[0]) for x in spans for y in spans if x[1] == y[1] and max(x[2], y[2]) < min(x[3], y[3])}
    assert len(got) == len(set(got)) and set(got) == want


def test_locate(spark):
    t = spark.createDataFrame([("a", "aaa青青"), ("b", None), ("c", "")], "id string, t string")
    q = spark.createDataFrame([("aa",), ("",), ("青",)], "q string")
    got = {(r.id, r.q, r.start_char, r.end_char) for r in wn.locate(t, q, "t", "q").collect()}
    assert got == {("a", "aa", 0, 2), ("a", "aa", 1, 3), ("a", "青", 3, 4), ("a", "青", 4, 5)}


def test_fusion(spark):
    rows = [(1, "p", "q", "u1", "《凡人修仙传》", 1), (2, "p", "q", "u1", "again", 1), (3, "p", "r", "u2", "凡人修仙传 - 维基百科", 2), (4, "p", "q", "u3", "别的", 2), (5, "p", "q", "u4", "  ", 3)]
    df = spark.createDataFrame([(a, b, c, d, e, f) for a, b, c, d, e, f in rows], "seq int, provider string, query string, url string, title string, global_rank bigint")
    got = rank.fuse_ranks(df).orderBy("rank").collect()
    assert [(r.canonical_title, r.n_signals, r.rank) for r in got] == [("凡人修仙传", 2, 1), ("别的", 1, 2)]
    assert got[0].score == 1_000_000 // 61 + 1_000_000 // 62


def test_sample(spark):
    rows = [("w", i, f"c{i:03d}") for i in range(57)] + [("v", i, f"d{i}") for i in range(13)]
    df = spark.createDataFrame(rows, "work string, o int, id string")
    got = rank.stratified_sample(df, "work", ["o"], "id").collect()
    w = sorted(r.position - 1 for r in got if r.work == "w")
    assert sum(r.work == "v" for r in got) == 13 and {0, 28, 56} <= set(w) and 11 <= len(w) <= 13
    for i in range(5):
        assert sum(57 * i // 5 <= p < 57 * (i + 1) // 5 for p in w) >= 2
    again = rank.stratified_sample(df.repartition(5), "work", ["o"], "id").collect()
    assert {tuple(r) for r in got} == {tuple(r) for r in again}


def test_median_and_order(spark):
    df = spark.createDataFrame([("a", v) for v in (5, 1, 9, 7)] + [("b", 3), ("b", None)], "g string, v int")
    assert {(r.g, r.upper_median) for r in rank.upper_median(df, ["g"], "v").collect()} == {("a", 7), ("b", 3)}
    n = spark.createDataFrame([("w", i, v, f"c{i}") for i, v in enumerate([1, 2, 2, None, 1, 9])], "w string, o int, n int, id string")
    assert {r.id for r in checks.out_of_order(n, "w", ["o"], "n", "id").collect()} == {"c2", "c4"}
    assert checks.missing_numbers(n, "w", "n").isEmpty()
    m = spark.createDataFrame([("w", 1), ("w", 3), ("w", 1_000_000_000)], "w string, n int")
    assert {(r.first_missing, r.last_missing, r.too_many) for r in checks.missing_numbers(m, "w", "n").collect()} == {(2, 2, True), (4, 999_999_999, True)}


def test_numbered(spark):
    df = spark.createDataFrame([(random.Random(i).randint(0, 50), i) for i in range(300)], "v int, i int")
    got = rank.numbered(df, [F.col("v").desc(), F.col("i")], "n").collect()
    assert [r.n for r in sorted(got, key=lambda r: (-r.v, r.i))] == list(range(1, 301))


def test_retry_chains(spark):
    rows = [("a", None), ("b", "a"), ("c", "b"), ("d", "c"), ("e", "gone")]
    got = {tuple(r) for r in checks.retry_chains(spark.createDataFrame(rows, "id string, up string"), "id", "up").select("id", "root", "depth").collect()}
    assert got == {("a", "a", 0), ("b", "a", 1), ("c", "a", 2), ("d", "a", 3), ("e", "e", 0)}


def test_long_retry_chains_and_circles(spark):
    rows = [(f"n{i:02d}", f"n{i - 1:02d}" if i else None) for i in range(41)] + [("x", "y"), ("y", "x"), ("z", "x")]
    got = {r.id: (r.root, r.depth) for r in checks.retry_chains(spark.createDataFrame(rows, "id string, up string"), "id", "up").collect()}
    assert got == {f"n{i:02d}": ("n00", i) for i in range(41)} | {k: (None, None) for k in "xyz"}


def test_reduce(spark):
    rows = [("O1", '{"k":1}', "s", 0, 2), ("O2", '{"k":1}', "s", 0, 2), ("O3", '{"k":2}', "t", 1, 3)]
    df = spark.createDataFrame(rows, "id string, payload string, seg string, a int, b int")
    got = {r.payload: (r.members, len(r.spans)) for r in reduce.reducer("exact-payload")(df, "payload", "id", ["seg", "a", "b"]).collect()}
    assert got == {'{"k":1}': (["O1", "O2"], 1), '{"k":2}': (["O3"], 1)}
    with pytest.raises(KeyError):
        reduce.reducer("fuzzy")


def test_scene_merge(spark):
    def span(s, a, b):
        return {"segment_id": f"s{s}", "segment_no": s, "start_char": a, "end_char": b}

    rows = [
        ("w", "c1", 1, [span(1, 0, 10)], "", ["a"]), ("w", "c2", 2, [span(1, 5, 30)], "", ["a"]), ("w", "c3", 3, [span(1, 25, 40)], "", ["a"]),
        ("w", "c4", 4, [span(9, 0, 4)], "x", []), ("w", "c5", 5, [span(9, 2, 6)], "x", []),
    ]
    df = spark.createDataFrame(rows, "work_id string, candidate_id string, position int, spans array<struct<segment_id:string,segment_no:bigint,start_char:int,end_char:int>>, signature string, entries array<string>")
    got = {}
    for r in reduce.merge_scenes(df).collect():
        got.setdefault(r.group_no, set()).add(r.candidate_id)
    # c3 meets c2 but not c1: a wide span does not bridge.
    assert sorted(map(sorted, got.values())) == [["c1", "c2"], ["c3"], ["c4", "c5"]]


def test_values(spark):
    rows = [("g", "m1", "A b"), ("g", "m2", "a B"), ("h", "m1", "x"), ("h", "m2", "y"), ("i", "m1", None)]
    got = {r.k: (r["values"], r.status) for r in reduce.merged_values(spark.createDataFrame(rows, "k string, member string, v string"), ["k"], "v").collect()}
    assert got == {"g": (["A b", "a B"], "KNOWN"), "h": (["x", "y"], "CONFLICTING"), "i": ([], "UNKNOWN")}


def epub(spine=("c1", "c2", "nav"), extra=b""):
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("META-INF/container.xml", '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="O/p.opf"/></rootfiles></container>')
        items = '<item id="c1" href="a.xhtml" media-type="application/xhtml+xml"/><item id="c2" href="b%20b.xhtml" media-type="application/xhtml+xml"/><item id="nav" href="n.xhtml" media-type="application/xhtml+xml" properties="nav"/><item id="img" href="i.png" media-type="image/png"/>'
        z.writestr("O/p.opf", f'<package xmlns="http://www.idpf.org/2007/opf" xmlns:dc="http://purl.org/dc/elements/1.1/"><metadata><dc:title>书</dc:title></metadata><manifest>{items}</manifest><spine>' + "".join(f'<itemref idref="{i}"/>' for i in spine) + "</spine></package>")
        z.writestr("O/a.xhtml", "<h1>第一章 起</h1><p>正文</p>")
        z.writestr("O/b b.xhtml", "<h1>第二章 承</h1>")
        z.writestr("O/n.xhtml", "<h1>目录</h1>")
    return buf.getvalue()


def test_epub(spark):
    df = spark.createDataFrame([("ok", bytearray(epub())), ("bad", bytearray(b"no zip")), ("miss", bytearray(epub(("c1", "zz")))), ("null", None)], "book string, content binary")
    rows = files.read_epub(df).orderBy("book", "ordinal").collect()
    assert [(r.member, r.declared_number, r.chapter_kind, r.work_title) for r in rows if r.book == "ok"] == [("O/a.xhtml", 1, "MAIN", "书"), ("O/b b.xhtml", 2, "MAIN", "书"), ("O/n.xhtml", None, "NAVIGATION", "书")]
    assert [r.error is not None for r in rows if r.book in ("bad", "miss")] == [True, True]


def test_folder_and_store(spark, tmp_path):
    for n, t in (("10.txt", "十"), ("2.txt", "二"), ("3.html", "<p>二</p>"), ("x.bin", "-")):
        (tmp_path / n).write_text(t)
    got = files.read_directory(spark, str(tmp_path)).orderBy("ordinal").collect()
    assert [(r.relative_path, r.declared_number) for r in got] == [("2.txt", 2), ("3.html", 3), ("10.txt", 10)]
    store = str(tmp_path / "store")
    a = sinks.artifacts(spark.createDataFrame([(bytearray(b"1"), "t"), (bytearray(b"1"), "t"), (None, "t")], "c binary, m string"), "c", "m")
    sinks.put(spark, store, a)
    sinks.put(spark, store, a)
    assert spark.read.parquet(store).count() == 1 and sinks.corrupt(spark.read.parquet(store)).isEmpty()
    out = str(tmp_path / "table")
    df = spark.range(3)
    assert sinks.publish(spark, df, out) and not sinks.publish(spark, df, out)
    with pytest.raises(sinks.Differs):
        sinks.publish(spark, spark.range(4), out)


def test_search_payload(spark):
    df = spark.createDataFrame([("q", 2, '["q",["A","B"],["a","b"],["u","v"]]'), ("r", 1, '["q",["A"],[],["u"]]')], "q string, page int, p string")
    got = files.search_hits(df, ["q"], "p", "page", 10).collect()
    assert [(r.q, r["rank"], r.global_rank, r.title, r.url) for r in got] == [("q", 1, 11, "A", "u"), ("q", 2, 12, "B", "v")]


def test_reader_names():
    assert files.reader("TXT") is files.read_books
    with pytest.raises(ValueError):
        files.reader("pdf")


def test_empty_tables(spark):
    texts = spark.createDataFrame([], "work string, ch int, ord int, seg string, n int")
    assert wn.window_spans(wn.offsets(texts, "work", "ch", ["ord"], F.col("n")), 10, 2).isEmpty()
    assert parse.lines(spark.createDataFrame([], "k string, t string"), "k", "t").isEmpty()
    assert rank.numbered(spark.createDataFrame([], "v int"), [F.col("v")], "n").isEmpty()
