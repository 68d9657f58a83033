"""The text queries on small tables and, where a plain version exists, against it on the smallest test tables."""

import os
import random
import re
import unicodedata
from collections import defaultdict
from datetime import datetime

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspan import llm
from quillspan.llm import p1_cut, p2_split, p4_lookalike, p5_garbled, p6_lines, p7_content, p8_leak, p9_mix

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "p1_found": ["record_kind", "record_id"], "p2_found": ["item_kind", "item_id"], "p3_found": ["retrieval_id"], "p4_found": ["segment_id_a", "segment_id_b"], "p5_found": ["retrieval_id"],
    "p6_found": ["segment_id", "line_no"], "p7_found": ["retrieval_id", "node_no"], "p8_found": ["doc_id", "item_id"], "p10_found": ["doc_id"],
}


def rows(sql):
    return duckdb.sql(sql).fetchall()


@pytest.mark.parametrize("name", sorted(llm.queries()))
def test_runs(spark, name):
    df = llm.queries()[name](spark, SF)
    if name in COLUMNS:
        assert df.columns == COLUMNS[name]
        got = [tuple(r) for r in df.collect()]
        assert len(got) == len(set(got))
    else:
        df.write.format("noop").mode("overwrite").save()


def test_p2_sql(spark):
    con = duckdb.connect()
    for t in ("segment", "scene_window", "size_limit"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    assert {tuple(r) for r in p2_split.p2_found(spark, SF).collect()} == set(con.sql(p2_split.SQL["p2_found"]).fetchall())


def test_p4_brute(spark):
    by = defaultdict(set)
    for sid, w, o, d, t in rows(f"select segment_id, work_id, chapter_ordinal, document_id, normalized_text from '{SF}/segment.parquet' where normalized_text is not null and document_id is not null"):
        if (c := p4_lookalike.canonical_reference(t)):
            by[(w, o, c)].add((sid, d, t))
    want = {(a[0], b[0]) for v in by.values() for a in v for b in v if a[0] < b[0] and a[1] != b[1] and a[2] != b[2]}
    assert {tuple(r) for r in p4_lookalike.p4_found(spark, SF).collect()} == want


def test_p6_brute(spark):
    docs, size = defaultdict(set), defaultdict(set)
    for d, loc in rows(f"select distinct document_id, source_locator from '{SF}/chapter_ref.parquet'"):
        if d and (m := re.match(r"[a-zA-Z][\w+.-]*://([^/:?#]+)", loc or "")):
            host = re.sub(r"^(www|m)\.", "", m.group(1).lower())
            docs[d].add(host)
            size[host].add(d)
    place, held = defaultdict(set), defaultdict(set)
    for sid, d, t in rows(f"select distinct segment_id, document_id, normalized_text from '{SF}/segment.parquet' where normalized_text is not null"):
        for host in docs.get(d, ()):
            for i, ln in enumerate(t.split("\n"), 1):
                if (k := p6_lines.letters_of(ln)):
                    place[(host, k)].add((sid, i))
                    held[(host, k)].add(d)
    want = {p for k, v in place.items() if len(held[k]) >= 3 and len(held[k]) >= 0.03 * len(size[k[0]]) for p in v}
    assert {tuple(r) for r in p6_lines.p6_found(spark, SF).collect()} == want


def test_p8_brute(spark):
    def fold(t):
        return "".join(c for c in unicodedata.normalize("NFKC", t).casefold() if unicodedata.category(c)[0] in "LN")

    items = [(i, 24 if lang == "zh" else 60, fold(t)) for i, lang, t in rows(f"select item_id, lang, text from '{SF}/eval_item.parquet'")]
    want = set()
    for d, t in rows(f"select doc_id, text from '{SF}/documents.parquet' where text is not null"):
        f = fold(t)
        for i, n, x in items:
            if any(x[k : k + n] in f for k in range(len(x) - n + 1)):
                want.add((d, i))
    assert {tuple(r) for r in p8_leak.p8_found(spark, SF).collect()} == want


def test_p8_edge_cases(spark):
    item = "若滕季同每日铸三十四枚缠枝铁尺邬令仪每日转赠其中十八枚自上元起共一百九十九日"
    docs = spark.createDataFrame([(1, "前文" + item + "后文", "x"), (2, item[:23], "x"), (3, item[:12] + "错" + item[13:], "x"), (4, None, "x"), (5, "", "x"), (6, "长" * 200_000 + item, "x")], "doc_id bigint, text string, item_id string")
    items = spark.createDataFrame([(7, "zh", item), (7, "zh", item), (8, None, "short"), (9, "en", None)], "item_id bigint, lang string, text string")
    got = {(r.doc_id, r.item_id, r.run_chars >= r.min_run) for r in p8_leak.find_leaks(docs, items).collect()}
    assert got == {(1, 7, True), (3, 7, True), (6, 7, True)}
    assert p8_leak.find_leaks(docs.limit(0), items).isEmpty() and p8_leak.find_leaks(docs, items.limit(0)).isEmpty()


# ------------------------------------------------------------- small tables

SEGMENT = "segment_id string, document_id string, work_id string, chapter_ordinal int, ordinal int, segment_type string, normalized_text string, normalized_text_hash string, selector string, raw_start int, raw_end int, parsed_at timestamp, site string, letters string, canon string"
CHAPTER = "chapter_id string, work_id string, document_id string, source_id string, source_locator string, ordinal int, site string"
RESPONSE = "retrieval_id string, source_id string, requested_url string, status int, body binary, content_type string, host string, score double"
WINDOW = "window_id string, work_id string, source_spans array<struct<segment_id:string,start_char:int,end_char:int,normalized_text_hash:string>>, size int"
OTHER = {
    "size_limit": ("item_kind string, max_chars int, overlap_chars int", [("segment", 50, 10), ("segment", 50, 10), ("scene_window", 60, 10), ("x", None, None)]),
    "novel_source": ("source_id string, canonical_url string, platform_id string, title string, author string, source_lang string", [("S", "https://a.example/", "pa", "甲站", None, "zh"), (None, None, None, None, None, None)]),
    "documents": ("doc_id bigint, text string, lang string, source string, label double", [(1, "一。" * 50, "zh", "pa"), (2, None, None, None), (3, "", None, "pa"), (4, "two. " * 40, None, None)]),
    "eval_item": ("item_id bigint, suite string, lang string, text string", []),
    "abuse_label": ("doc_id bigint, annotator string, is_abusive int, category string", [(1, "a", 0, None), (4, "a", 1, None), (4, "a", 1, None), (9, "b", None, None)]),
    "mix_target": ("source string, target_share double, max_repeats int", [("pa", 1.0, 2), ("pa", 1.0, 2), (None, 0.1, 1)]),
    "dom_node": ("retrieval_id string, node_no int, parent_no int, tag string, attrs map<string,string>, node_text string", [("r1", 0, None, "html", {}, None), ("r1", 1, 0, "p", None, "文"), ("r1", 1, 0, "p", None, "文"), (None, 1, 0, "p", {}, "x"), ("r1", None, 0, None, {}, "y")]),
}


def pad(schema, data):
    """Rows with nulls for the columns that they leave out."""
    width = len(T._parse_datatype_string(schema).fields)
    return [tuple(r) + (None,) * (width - len(r)) for r in data]


def write(spark, folder, **tables):
    for name, (schema, data) in {**OTHER, "segment": (SEGMENT, []), "chapter_ref": (CHAPTER, []), "response": (RESPONSE, []), "scene_window": (WINDOW, []), **tables}.items():
        spark.createDataFrame(pad(schema, data), schema).write.mode("overwrite").parquet(os.path.join(folder, f"{name}.parquet"))
    return str(folder)


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Nulls everywhere, empty and very long texts, ties, repeated rows, unknown references, extra columns of clashing names."""
    t = datetime(2024, 1, 1)
    long = "很长的文字，没有尽头。" * 9000
    seg = [
        ("s1", "d1", "w", 1, 1, "paragraph", long, "h"), ("s1", "d1", "w", 1, 1, "paragraph", long, "h"), ("s2", "d1", "w", 1, 2, None, None, None), ("s3", "d1", "w", 1, 3, "paragraph", "", ""),
        ("s4", "d2", "w", 1, 1, "paragraph", "Ａ１，é x", "h"), ("s5", "d1", "w", 1, 4, "paragraph", "A1,é x", "h"), (None, None, None, None, None, None, None, None), ("s6", None, "w", 1, 1, None, "A1,é x", "h"), ("s7", "d1", "w", None, 5, None, "x\n\ny", "h"),
    ]
    chap = [("c1", "w", "d1", "S", "https://www.A.example:443/1", 1), ("c1", "w", "d1", "S", "https://www.A.example:443/1", 1), ("c2", "w", "d2", None, "/library/x", 1), (None, None, None, None, None, None)]
    res = [
        ("r1", "S", "https://a.example/1", 200, bytearray("<p>一。</p>".encode()), None), ("r1", "S", "https://a.example/1", 200, bytearray("<p>一。</p>".encode()), None), ("r2", None, None, None, None, None), ("r3", "S", "x", 302, bytearray(b""), "text/html"),
        ("r4", "S", "https://a.example/2", 200, bytearray(long.encode() * 2), "text/plain; charset=nonsense"), ("r5", None, None, 200, bytearray(b"\xff\xfe\x00<"), "text/html; charset=big5"), (None, None, None, 200, bytearray(b"x"), None), ("r6", "S", "u", 200, bytearray(b"{{ title }}"), "text/plain"),
    ]
    win = [("v1", "w", [("s1", 0, 80, "h"), ("gone", 0, 9, "h")]), ("v1", "w", [("s1", 0, 80, "h"), ("gone", 0, 9, "h")]), ("v2", "w", None), ("v3", "w", [("s1", None, 3, None)]), (None, None, [("s1", 0, 90, "h")])]
    del t
    return write(spark, tmp_path_factory.mktemp("odd"), segment=(SEGMENT, seg), chapter_ref=(CHAPTER, chap), response=(RESPONSE, res), scene_window=(WINDOW, win))


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return write(spark, tmp_path_factory.mktemp("empty"), **{k: (s, []) for k, (s, _) in OTHER.items()})


@pytest.mark.parametrize("name", sorted(llm.queries()))
def test_odd_rows(spark, odd, name):
    llm.queries()[name](spark, odd).write.format("noop").mode("overwrite").save()


@pytest.mark.parametrize("name", sorted(llm.queries()))
def test_empty_tables(spark, empty, name):
    got = llm.queries()[name](spark, empty)
    assert got.isEmpty()


def test_odd_results(spark, odd):
    assert {tuple(r) for r in p2_split.p2_found(spark, odd).collect()} == {("segment", "s1"), ("scene_window", "v1")}
    assert {tuple(r) for r in p4_lookalike.p4_found(spark, odd).collect()} == {("s4", "s5")}
    assert p6_lines.p6_found(spark, odd).isEmpty()
    assert [tuple(r) for r in llm.queries()["p3_found"](spark, odd).where("retrieval_id = 'r6'").collect()] == [("r6",)]
    pieces = p2_split.p2_pieces(spark, odd).where("item_kind = 'segment'")
    assert pieces.agg(F.max(F.length("piece_text"))).first()[0] <= 50


def test_p1_copies(spark, tmp_path):
    words = [f"word{i}" for i in range(60)]
    whole = "It began so. " + " ".join(words) + " and so it ended."
    data = [("a", "d", "w", 1, 1, "p", whole, "h"), ("b", "e", "w", 1, 1, "p", " ".join(whole.split()[:-6]), "h")] + [(f"n{i}", "d", "w", 1, i, "p", f"Another text number {i} stands here alone. It ends as it should.", "h") for i in range(40)]
    d = write(spark, tmp_path, segment=(SEGMENT, data))
    got = {r.record_id: r for r in p1_cut.scored(spark, d).collect()}
    assert got["b"].is_cut and got["b"].by_copy and not got["a"].is_cut and sum(r.is_cut for r in got.values()) == 1


def test_p1_copies_behind_a_usual_mark(spark, tmp_path):
    words = " ".join(f"word{i}" for i in range(60))
    whole, cut = f"It began. {words} and “Go!” said he.", f"It began. {words} and “Go!”"
    data = [(f"n{i}", "d", "w", 1, i, "p", f"Another text number {i} stands here alone. “It ends as it should!”", "h") for i in range(40)]
    res = [(k, "S", f"https://a.example/{k}", 200, bytearray(t.encode()), "text/plain; charset=utf-8") for k, t in (("a", whole), ("b", cut))]
    d = write(spark, tmp_path, segment=(SEGMENT, [*data, ("c", "d", "w", 1, 90, "p", cut, "h")]), response=(RESPONSE, res))
    got = p1_cut.scored(spark, d).where("by_copy and is_cut").collect()
    assert {(r.record_kind, r.record_id) for r in got} == {("response", "b"), ("segment", "c")}


def test_p1_copies_that_lost_more(spark, tmp_path):
    """Copies that lost 10, 30 and 60 %, one that stops behind a sentence, a pair of responses of which one is whole markup."""
    words = [f"word{i}" for i in range(100)]
    words[49] += "."
    whole = "It began. " + " ".join(words) + "."
    cuts = {f"c{n}": whole.rsplit(" ", n)[0] for n in (10, 30, 60)} | {"stop": " ".join(whole.split()[:52])}
    data = [(f"n{i}", "d", "w", 1, i, "p", f"Another text number {i} stands here alone. It ends as it should.", "h") for i in range(40)]
    data += [("whole", "d", "w", 1, 90, "p", whole, "h"), *((k, "e", "w", 1, 91 + i, "p", t, "h") for i, (k, t) in enumerate(cuts.items()))]
    page = [f"p{i}" for i in range(200)]
    html = "<html><body><p>" + " ".join(page) + ".</p></body></html>"
    res = [("page", "S", "u", 200, bytearray(html.encode()), "text/html"), ("part", "S", "v", 200, bytearray(" ".join(page[:90]).encode()), "text/plain")]
    d = write(spark, tmp_path, segment=(SEGMENT, data), response=(RESPONSE, res))
    got = {r.record_id: (r.by_copy, r.is_cut) for r in p1_cut.scored(spark, d, finished=True).where("by_copy").collect()}
    assert got == {"c10": (True, True), "c30": (True, True), "c60": (True, True), "part": (True, True), "stop": (True, False)}
    assert "stop" not in {r.record_id for r in p1_cut.scored(spark, d).where("by_copy").collect()}


def test_p1_hot_band(spark, tmp_path, monkeypatch):
    """Many texts with one beginning: paired by their closing words, and by the longest of a class beyond that."""
    head = " ".join(f"head{i}" for i in range(30))
    data = [(f"w{i}", "d", "w", 1, i, "p", f"{head} " + " ".join(f"t{i}x{j}" for j in range(14)) + ".", "h") for i in range(30)]
    data += [(f"c{i}", "e", "w", 2, i, "p", f"{head} " + " ".join(f"t{i}x{j}" for j in range(6)), "h") for i in range(30)]
    data += [(f"o{i}", "e", "w", 3, i, "p", f"{head} " + " ".join(f"o{i}x{j}" for j in range(6)), "h") for i in range(10)]
    d = write(spark, tmp_path, segment=(SEGMENT, data))
    want = {f"c{i}" for i in range(30)}
    for limit in (4096, 20):
        monkeypatch.setattr(p1_cut, "HOT_PAIRS", limit)
        assert {r.record_id for r in p1_cut.scored(spark, d).where("by_copy").collect()} == want
    # One class of copies beyond the limit: its longest text answers for all.
    same = [(f"s{i}", "d", "w", 4, i, "p", f"{head} tail0 tail1 tail2 tail3 tail4 more{i} of it.", "h") for i in range(30)] + [(f"k{i}", "d", "w", 5, i, "p", f"{head} tail0 tail1 tail2 tail3 tail{'' if i else '4'}", "h") for i in range(2)]
    d = write(spark, tmp_path, segment=(SEGMENT, same))
    assert {r.record_id for r in p1_cut.scored(spark, d).where("by_copy").collect()} == {"k0", "k1"}


def test_p1_hot_class_of_different_texts(spark, tmp_path, monkeypatch):
    """Texts of one beginning and one closing run of words: each cut one has one copy, which is not the longest of them."""
    head, tail = " ".join(f"head{i}" for i in range(30)), "tail0 tail1 tail2 tail3"
    own = [" ".join(f"own{i}x{j}" for j in range(5)) for i in range(30)]
    data = [(f"w{i}", "d", "w", 1, i, "p", f"{head} {t} {tail} tail4 of it.", "h") for i, t in enumerate(own)] + [(f"c{i}", "e", "w", 2, i, "p", f"{head} {t} {tail} ta", "h") for i, t in enumerate(own)]
    data += [("long", "e", "w", 3, 1, "p", f"{head} " + " ".join(f"long{j}" for j in range(40)) + f" {tail} tail4 of it.", "h")]
    data += [(f"alone{i}", "e", "w", 4, i, "p", f"{head} " + " ".join(f"alone{i}x{j}" for j in range(5)) + f" {tail} ta", "h") for i in range(5)]
    d = write(spark, tmp_path, segment=(SEGMENT, data))
    want = {f"c{i}" for i in range(30)}
    for limit, block in ((1 << 20, 2048), (20, 2048), (20, 7)):
        monkeypatch.setattr(p1_cut, "HOT_PAIRS", limit)
        monkeypatch.setattr(p1_cut, "BLOCK_TEXTS", block, raising=False)
        assert {r.record_id for r in p1_cut.scored(spark, d).where("by_copy").collect()} == want


def test_p6_clusters_decide(spark, tmp_path, monkeypatch):
    """Near-duplicates of a repeated line go with it; sentences of one pattern without such a line stay."""
    notice = "Please support the author by reading this chapter only on our own site"
    seg, chap = [], []
    for i in range(12):
        line = notice + (", thanks" if i == 5 else ", dear friend" if i == 6 else "") + "."
        seg.append((f"s{i}", f"d{i}", "w", i, 1, "section", f"{line}\nUpdated {i + 1} March 2021\nText {chr(97 + i) * 7} of its own {chr(110 - i) * 9} here", "h"))
        chap.append((f"c{i}", "w", f"d{i}", "S", f"https://www.a.example/{i}", i))
    d = write(spark, tmp_path, segment=(SEGMENT, seg), chapter_ref=(CHAPTER, chap))
    exact = {(f"s{i}", 1) for i in range(12) if i not in (5, 6)} | {(f"s{i}", 2) for i in range(12)}
    assert {tuple(r) for r in p6_lines.p6_found(spark, d).collect()} == exact
    assert {r.n_removed for r in p6_lines.p6_clean(spark, d).collect()} == {2}
    assert {(r.is_exact, r.n_docs, r.cluster_docs) for r in p6_lines.p6_lines(spark, d).collect()} == {(True, 10, 12), (False, 1, 12), (True, 12, 12)}
    monkeypatch.setattr(p6_lines, "CLUSTER_AGREEMENT", 1.1)  # without clusters the variants stay
    assert {r.n_removed for r in p6_lines.p6_clean(spark, d).collect()} == {1, 2}


def test_p4_form_over_all_scripts(spark):
    r = random.Random(4)
    blocks = [(0x20, 0x24F), (0x300, 0x36F), (0x370, 0x52F), (0x590, 0x6FF), (0x900, 0x9FF), (0xB00, 0xBFF), (0xD80, 0xDFF), (0xE00, 0xEFF), (0x1100, 0x11FF), (0x1E00, 0x1FFF), (0x2000, 0x214F), (0x3000, 0x318E), (0xAC00, 0xD7A3), (0xF900, 0xFAFF), (0xFB00, 0xFFEF), (0x1D400, 0x1D7FF)]
    texts = []
    for _ in range(3000):
        some = [blocks[1], blocks[6], blocks[10], r.choice(blocks), r.choice(blocks)]
        texts.append("".join(chr(r.randint(*r.choice(some))) for _ in range(r.randint(1, 12))))
    texts += [unicodedata.normalize(f, t) for t in ("한글과 세종대왕", "각́ é ệ", "Ａ\u200b１\xa0ö") for f in ("NFC", "NFD")]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, normalized_text string")
    got = {x.i: x.canon for x in p4_lookalike.canonicalise(df, ["i"]).collect()}
    assert [t for i, t in enumerate(texts) if got[i] != p4_lookalike.canonical_reference(t)] == []
    assert got[len(texts) - 6] == got[len(texts) - 5] == "한글과 세종대왕" and got[len(texts) - 4] == got[len(texts) - 3]


def test_p7_site(spark, tmp_path):
    nodes, res = [], []
    for i in range(12):
        res.append((f"r{i}", "S", f"https://a.example/{i}", 200, None, None))
        tree = [("html", None, None), ("body", 0, None), ("div", 1, None), ("a", 2, "Home"), ("h1", 1, f"Title {i}"), ("div", 1, None)]
        tree += [("p", 5, f"Paragraph {k} of page {chr(97 + i)} with words of its own {chr(98 + i)}{k} kept here") for k in range(4)] + [("p", 5, "Read faster at our site, always"), ("footer", 1, "All rights reserved")]
        nodes += [(f"r{i}", n, p, t, {}, x) for n, (t, p, x) in enumerate(tree)]
    d = write(spark, tmp_path, response=(RESPONSE, res), dom_node=(OTHER["dom_node"][0], nodes))
    got = {tuple(r) for r in p7_content.p7_found(spark, d).collect()}
    assert got == {(f"r{i}", n) for i in range(12) for n in (4, 6, 7, 8, 9)}


def test_samples_hold_whole_texts(spark, tmp_path, monkeypatch):
    text = "word " * 2000 + "lastly"
    d = write(spark, tmp_path, documents=(OTHER["documents"][0], [(1, text, "en", "pa"), (2, "short one", "en", "pa")]), mix_target=(OTHER["mix_target"][0], [("pa", 1.0, 2)]), novel_source=("source_id string, platform_id string, source_lang string", [("s", "pa", "en")]))
    seen = []
    monkeypatch.setattr(p9_mix, "fit_classifier", lambda texts, y, k: seen.extend(texts) or np.zeros((p9_mix.FEATURES + 1, k)))
    p9_mix.memberships(spark, d, p9_mix.targets(spark, d), p9_mix.TOKENIZER_PATH)
    assert sorted(seen) == ["short one", text]
    monkeypatch.setattr(p5_garbled.zstandard, "train_dictionary", lambda size, parts: (_ for _ in ()).throw(p5_garbled.zstandard.ZstdError("none")))
    assert "lastly" in p5_garbled.train_dictionaries(spark, d)["en"].decode()


def test_p9_shares(spark, tmp_path):
    docs = [(i, " ".join(f"alpha{j}" for j in range(20 + i % 7)), "en", "a") for i in range(400)] + [(1000 + i, "beta gamma " * (8 + i % 5), "en", "b") for i in range(150)] + [(5000 + i, "delta " * 30, "en", "c") for i in range(50)]
    d = write(spark, tmp_path, documents=(OTHER["documents"][0], docs), mix_target=(OTHER["mix_target"][0], [("a", 0.5, 1), ("b", 0.5, 3)]))
    got = {r.source: r for r in p9_mix.p9_shares(spark, d).collect()}
    assert set(got) == {"a", "b"} and all(abs(r.actual_share - 0.5) < 0.02 for r in got.values())
    mix = p9_mix.p9_mix(spark, d).collect()
    assert {r.source for r in mix} == {"a", "b"} and max(r.repeats for r in mix if r.source == "b") <= 3 and max(r.repeats for r in mix if r.source == "a") == 1
