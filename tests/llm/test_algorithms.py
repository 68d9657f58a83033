"""The algorithms of the text operators against plain versions of themselves."""

import difflib
import random
import re
import unicodedata

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspan.llm import common, p1_cut, p2_split, p3_residue, p4_lookalike, p5_garbled, p6_lines, p7_content, p8_leak, p9_mix, p10_abuse

PROSE = "据羽族所说，残破的灯盏原本属于顾砚秋。虞采薇把生锈的玉简递给温听雪，一时说不出是喜是忧。" * 6
ENGLISH = "They had walked ten miles from the ford. No one saw how the miller left, though the road was watched. " * 6


# ------------------------------------------------------------------ shingles


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab 中文,。\n1", max_size=30), min_size=1, max_size=6))
def test_shingles_follow_words(texts):
    def words(t):
        out, run = [], ""
        for c in t.lower():
            if "一" <= c <= "鿿":
                out += [run] * bool(run) + [c]
                run = ""
            elif c.isalnum():
                run += c
            else:
                out += [run] * bool(run)
                run = ""
        return out + [run] * bool(run)

    s, own = common.shingles(texts, 2)
    want = [[tuple(words(t)[i : i + 2]) for i in range(len(words(t)) - 1)] for t in texts]
    assert [int((own == i).sum()) for i in range(len(texts))] == [len(w) for w in want]
    flat = [x for w in want for x in w]
    assert len(set(zip(flat, s.tolist()))) == len(set(flat)) == len(set(s.tolist()))


def test_banding_finds_near_copies():
    r = random.Random(1)
    found = 0
    for _ in range(300):
        words = [f"w{r.randint(0, 9999)}" for _ in range(r.choice((20, 60, 400)))]
        cut = words[: max(9, int(len(words) * r.choice((0.4, 0.7, 0.9))))]
        if len(cut) >= 60 and r.random() < 0.5:
            cut[r.randrange(len(cut))] = "other"
        own = p1_cut.beginning_keys([" ".join(cut)], True)[1]
        all_of = p1_cut.beginning_keys([" ".join(words)], False)[1]
        found += bool((own[:, None] == all_of).any())
    assert found >= 280


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 60), min_size=1, max_size=5), st.integers(0, 99))
def test_beginning_keys_are_those_of_the_beginnings(sizes, seed):
    r = random.Random(seed)
    texts = [" ".join(f"w{r.randint(0, 99)}" for _ in range(n)) for n in sizes]
    ids, keys = p1_cut.beginning_keys(texts, False)
    want = []
    for i, t in enumerate(texts):
        words = t.split()
        for n in p1_cut.lengths_upto(len(words)):
            if n <= len(words):
                want.append((i, *p1_cut.beginning_keys([" ".join(words[:n])], True)[1][0].tolist()))
    assert [(int(i), *k) for i, k in zip(ids, keys.tolist())] == want


# -------------------------------------------------------------------- p1, p2


def test_early_end():
    PROSE = "".join(chr(0x4E00 + i * 37 % 3000) for i in range(240))
    for lost in (24, 72, 144):
        assert p1_cut.ends_early(PROSE[:-lost], PROSE) == 2
    assert not p1_cut.ends_early(PROSE, PROSE[:-20])
    assert not p1_cut.ends_early(PROSE, PROSE)
    assert not p1_cut.ends_early("".join(c + "异" * (i % 4 == 0) for i, c in enumerate(PROSE[:60])), PROSE)  # below the similarity of near-copies
    assert not p1_cut.ends_early("", PROSE) and not p1_cut.ends_early(PROSE, "")


def test_early_end_stops_inside_a_sentence():
    words = " ".join(f"word{i}" for i in range(60))
    assert p1_cut.ends_early(words + ' “Go!”', words + ' “Go!” said the miller.') == 2
    assert p1_cut.ends_early(words + " he le", words + " he left. So it ended.") == 2
    assert p1_cut.ends_early(words + " he left.", words + " he left. So it ended.") == 1
    assert p1_cut.ends_early(words + " he left", words + " he left\nRead on at our site") == 1
    assert not p1_cut.ends_early(words + " felt cold.", words + " felt very cold.")  # a word more inside the last sentence


@pytest.mark.parametrize("spread", [0, 4_000_000])
@settings(max_examples=30, deadline=None)
@given(seed=st.integers(0, 10**6))
def test_early_end_of_blocks_is_that_of_all_pairs(spread, seed):
    r = random.Random(seed)
    base = [" ".join(r.choice(["w%d" % r.randint(0, 40), "他", "说。", "go!”", "12", "he\n"]) for _ in range(r.randint(9, 60))) for _ in range(3)]
    make = lambda: (t := r.choice(base))[: r.randint(0, len(t))] + r.choice(["", "", ".", "…", " zz", t[-40:]])
    left, right = [make() for _ in range(r.randint(0, 12))], [make() for _ in range(r.randint(0, 12))]
    want = [max((p1_cut.ends_early(a, b) for b in right), default=0) for a in left]
    with pytest.MonkeyPatch.context() as m:
        m.setattr(p1_cut, "SPREAD", spread)
        assert p1_cut.ends_early_any(left, right).tolist() == want


def test_endings():
    whole = "<html><body><p>一。</p></body></html>"
    assert p1_cut.ending(whole, False)[2] is False
    assert p1_cut.ending(whole[:-20] + '<a href="/x', False)[2] is True
    assert p1_cut.ending("<p>Tom &am", False)[2] is True
    assert p1_cut.ending('{"a": "b', False)[2] is True
    assert p1_cut.ending('{"a": "b"}', False)[2] is False
    assert p1_cut.ending("plain", True)[2] is True
    assert p1_cut.ending("<p>a</p><script>" + "x = 1; " * 2000, False)[2] is True  # however long the open script is
    assert p1_cut.ending(" " * 5000 + "<p>a</p>", False)[0] == "markup"
    assert p1_cut.grade("第三章 归途", True) == 0 and p1_cut.grade("", True) == 0
    assert p1_cut.grade(PROSE[:-5], True) == 2
    assert p1_cut.grade("Chapter 3: Copper Ford", True) == 0


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab 。，\n.中", max_size=400), st.integers(2, 60), st.data())
def test_split(text, most, data):
    overlap = data.draw(st.integers(0, most - 1))
    got = p2_split.split_points(text, most, overlap)
    if not text:
        assert got == []
        return
    assert got[0][0] == 0 and got[-1][1] == len(text)
    for a, b, _ in got:
        assert 0 < b - a <= most
    for (a, b, _), (c, d, _) in zip(got, got[1:]):
        assert d > b and c == b - overlap and c >= a


def test_split_prefers_boundaries():
    text = ("句子一共十个字吗是的。" * 40)[:430]
    ends = [text[b - 1] for _, b, _ in p2_split.split_points(text, 120, 20)[:-1]]
    assert set(ends) == {"。"}
    assert p2_split.split_points("x" * 10, 10, 3) == [(0, 10, p2_split.PART)]
    with pytest.raises(ValueError):
        p2_split.split_points("x" * 10, 5, 5)


# ------------------------------------------------------------------------ p3


@pytest.mark.parametrize("text", ["{{ title }}", "欢迎，{{章节内容}}", "<%= author %>", "${name}", "#{user.name}", "{$title}", "[[summary]]", "%TITLE%", "__NAME__", "@@AUTHOR@@", "{% block x %}"])
def test_placeholders(text):
    assert p3_residue.PLACEHOLDER.search(text)


@pytest.mark.parametrize("text", ["公式 {甲+乙} 又划掉", "{ash + salt}", "涨了 50% 和 60%", "a[1][2]", "__init", "mail@@", "100% TITLE", "{}", ""])
def test_no_placeholders(text):
    assert not p3_residue.PLACEHOLDER.search(text)


def test_filler():
    for t in ("测试测试测试测试", "asdf asdf asdf", "啊啊啊啊啊啊", "测试。" * 40_000):
        assert p3_residue.repeats_itself(t)
    for t in (PROSE[:45], "", "啊啊", "测试测试", "asdf asdf asdg", PROSE[:45] * 2):
        assert not p3_residue.repeats_itself(t)
    assert p3_residue.DUMMY.match("Lorem ipsum dolor")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab 中文1２,。_\n", max_size=20), min_size=1, max_size=5))
def test_residue_features(texts):
    flat, lens = p3_residue.features_of(texts)
    assert int(lens.sum()) == len(flat)
    at = np.r_[0, np.cumsum(lens)]
    for i, t in enumerate(texts):
        alone, n = p3_residue.features_of([t])
        assert alone.tolist() == flat[at[i] : at[i + 1]].tolist() and n[0] == lens[i]
        words = re.findall(r"[一-鿿]|[^\W\d_一-鿿]+|\d+|[^\w\s]", t.lower())
        plain = {("w", w) for w in words if len(w) > 1 and w.isalpha() or not w.isalpha()} | {("p", a, b) for a, b in zip(["^", *words], [*words, "$"])} if words else set()
        plain = {tuple("0" if x.isdigit() else x for x in f) for f in plain}
        assert lens[i] == (len(plain) + 1 + (len(words) >= 6) if words else 0)


def test_residue_reads_whole_passages():
    far = "x " * 60_000
    assert set(p3_residue.features_of([far + "needle"])[0]) != set(p3_residue.features_of([far + "thread"])[0])


# ------------------------------------------------------------------------ p4


def test_look_alike_map_is_idempotent():
    m = p4_lookalike.single_map()
    assert all(c not in m or c == v for v in set(m.values()) for c in v)
    assert m["Ａ"] == "A" and m["，"] == "," and m["​"] == "" and m["а"] == "a" and m["⼈"] == "人" and m["\xa0"] == " "
    assert "é" not in m and "²" not in m and "中" not in m


def test_compositions_are_canonical():
    for pair, whole in p4_lookalike.compositions().items():
        assert unicodedata.normalize("NFC", pair) == whole


# ------------------------------------------------------------------------ p5


@pytest.fixture(scope="module")
def repairer():
    zh = [PROSE[i : i + 60] for i in range(0, 200, 7)]
    la = ["La neige pliait les bambous à Élan, où l’étrangère a regretté son départ.", "“Give me ten days,” said the miller — and left.", "Während der Ernte prüfte niemand außer ihm die Bücher."]
    return p5_garbled.Repairer({"zh": "\n".join(zh).encode(), "fr": "\n".join(la * 20).encode()})


@pytest.mark.parametrize(
    "wrong",
    [
        lambda t: t.encode().decode("latin-1").encode(),
        lambda t: t.encode().decode("gb18030", "replace").encode(),
        lambda t: t.encode("gb18030"),
        lambda t: t.encode("gb18030").decode("latin-1").encode(),
    ],
)
def test_restores_garbled_text(repairer, wrong):
    text = PROSE[:90]
    garbled, _, got, chains = repairer.body(wrong(text), "text/plain; charset=utf-8")
    assert garbled and chains
    assert difflib.SequenceMatcher(None, got, text, autojunk=False).ratio() > 0.75


@pytest.mark.parametrize("text", [PROSE[:90], "SÃO et ÂNIMO, lisait-on sur le mur.", "Où l’étrangère a regretté son départ.", "plain", "<p>" + PROSE[:40] + "</p>"])
def test_leaves_good_text(repairer, text):
    assert repairer.body(text.encode(), "text/html; charset=utf-8") == (False, False, text, "")


@pytest.mark.parametrize(
    "good, bad",
    [
        (ENGLISH + "It was the miller’s. " + ENGLISH, ENGLISH + "It was the millerâ€™s. " + ENGLISH),
        (ENGLISH + "a café there. " + ENGLISH, ENGLISH + "a cafÃ© there. " + ENGLISH),
        (PROSE + "他说l’été。" + PROSE, PROSE + "他说lâ€™Ã©tÃ©。" + PROSE),
        (PROSE + "écrit par l’étrangère à Élan", PROSE + "Ã©crit par lâ€™Ã©trangÃ¨re Ã\xa0 Ã‰lan"),
    ],
)
def test_restores_single_runs(repairer, good, bad):
    garbled, whole, got, chains = repairer.body(bad.encode(), "text/plain; charset=utf-8")
    assert garbled and whole and got == good and chains


@pytest.mark.parametrize("text", [ENGLISH + "“CAFÉ” and “QUALITÉ”. " + ENGLISH, PROSE + "“CAFÉ”，他说。" + PROSE, ENGLISH + "SÃO PAULO, Äpfel, œuvre «À» 隆 " + ENGLISH, ENGLISH + "顾砚秋。 " + ENGLISH])
def test_leaves_good_runs(repairer, text):
    assert repairer.body(text.encode(), "text/plain; charset=utf-8") == (False, False, text, "")


def test_cut_character_is_no_garble(repairer):
    assert not repairer.body(PROSE[:50].encode()[:-1], None)[0]
    assert repairer.body(PROSE[:20].encode() + b"\xff\xfe" + PROSE[20:40].encode(), None)[0]


def test_cut_letter_is_no_garble(repairer):
    assert not repairer.body("Il n'osait encore ti".encode() + b"\xc3", "text/html; charset=utf-8")[0]


# ------------------------------------------------------------------------ p6


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=20), min_size=1, max_size=8))
def test_letters(lines):
    assert p6_lines.letters_of_all(lines) == [p6_lines.letters_of(t) for t in lines]


def test_line_signatures():
    own, sig = p6_lines.signatures(["abcdefghij", "abcdefghij", "ab", "", "abcdefghijk"])
    assert own[0] == own[1] and (sig[0] == sig[1]).all() and len({*own[1:].tolist()}) == 4
    assert (sig[0] == sig[4]).mean() >= 0.5
    for line in ("Updated 3 May 2020 by Ann", "Updated 4 June 2021 by Bob", "UPDATED BY"):
        assert p6_lines.masked_letters(line, p6_lines.letters_of(line)) == "updatedby"
    assert p6_lines.masked_letters("第三章 归途", "第三章归途") == "第章归途"
    assert p6_lines.masked_letters("by Ann", "byann") == "byann"  # too little would be left


# ------------------------------------------------------------------------ p7


def test_page_nodes():
    nos, parents = [0, 1, 2, 3, 4, 5, 6], [None, 0, 0, 2, 3, 2, 5]
    tags, texts = ["html", "title", "body", "p", "b", "nav", "a"], [None, "T", None, "run\nning", "bold", None, "menu"]
    got = {r[0]: r for r in p7_content.page_nodes(nos, parents, tags, [""] * 7, texts)}
    assert set(got) == {3, 4, 6}
    assert got[3][1:3] == got[4][1:3] == (2, 7) and got[3][4] == got[4][4]  # inline text shares its paragraph's region and group
    assert got[6][10] and not got[3][10]
    assert p7_content.page_nodes([], [], [], [], []) == []
    assert p7_content.page_nodes([5], [5], ["p"], [""], ["x"])[0][0] == 5  # a node that is its own parent


def test_page_nodes_at_any_depth():
    n = 5000
    tags = ["body", "nav"] + ["div"] * n + ["p"] + ["b"] * n
    nos = list(range(len(tags)))
    got = p7_content.page_nodes(nos, [None, *nos[:-1]], tags, [""] * len(tags), [None] * (len(tags) - 1) + ["deep"])
    assert [(r[0], r[10]) for r in got] == [(len(tags) - 1, True)]  # a text thousands of levels under a menu is still blocked
    assert len(p7_content.page_nodes([1, 2, 3], [3, 1, 2], ["p"] * 3, [""] * 3, ["x"] * 3)) == 3  # parents in a circle


# ------------------------------------------------------------------------ p8


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="abcd", max_size=24), st.text(alphabet="abcd", max_size=24), st.integers(0, 5))
def test_banded_distance(a, b, width):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y)))
        row = new
    got = p8_leak.banded_distance(np.array([ord(c) for c in a]), np.array([ord(c) for c in b]), width)
    assert got == row[-1] if row[-1] <= width else got > width


def test_folding():
    cp, starts = p8_leak.folded(["Ａb-1 ﬁ。", None, "ß"])
    assert "".join(map(chr, cp)) == "ab1fiss" and starts.tolist() == [0, 5, 5, 7]


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 10**6), st.integers(0, 12), st.integers(0, 12), st.sampled_from([0, 1, 2]))
def test_windows_within_edits(seed, before, after, edits):
    r = random.Random(seed)
    Q = p8_leak.Q
    window = Q * (edits + 1) + r.randint(0, 8)
    part = [r.choice("abcdefgh") for _ in range(window)]
    doc = list(part)
    for _ in range(r.randint(0, edits + 1)):
        k = r.randrange(len(doc))
        doc[k : k + 1] = r.choice([[], ["x"], [doc[k], "x"]])
    noise = [chr(0x4E00 + i) for i in range(100)]
    item, text = "".join(noise[:before] + part + noise[20 : 20 + after]), "".join(noise[40 : 43 + before] + doc + noise[60 : 63 + after])
    cp = {t: np.array([ord(c) for c in t]) for t in (item, text)}
    hits = [(i, j) for i in range(len(text) - Q + 1) for j in range(len(item) - Q + 1) if text[i : i + Q] == item[j : j + Q]]
    spans = [(i, n) for n in range(max(0, window - edits), window + edits + 1) for i in range(len(text) - n + 1)]
    want = min((p8_leak.banded_distance(cp[item][j : j + window], cp[text][i : i + n], edits) for j in range(len(item) - window + 1) for i, n in spans), default=edits + 1)
    if hits:
        pos, off = np.array(hits).T
        at, e, _, _ = p8_leak.verify(cp[text], cp[item], pos, off, window, edits)
        assert min(e, edits + 1) == min(want, edits + 1)
        assert e > edits or 0 <= at <= len(text)
    else:
        assert want > edits or window < Q * (edits + 1) + edits


def test_window_with_one_edit():
    item = np.arange(100, 124)
    for k in range(24):
        for doc in (np.delete(item, k), np.insert(item, k, 9), np.r_[item[:k], 9, item[k + 1 :]]):
            doc = np.r_[7, doc, 8]
            pos, off = np.array([(i, j) for i in range(len(doc) - 7) for j in range(17) if (doc[i : i + 8] == item[j : j + 8]).all()]).T
            assert p8_leak.verify(doc, item, pos, off, 24, 1)[1] <= 1, (k, len(doc))


# ------------------------------------------------------------------------ p9


def test_classifier():
    texts = ["red apple tree"] * 20 + ["blue sea boat"] * 20
    w = p9_mix.fit_classifier(texts, np.array([0] * 20 + [1] * 20), 2)
    p = p9_mix.posteriors(w, ["red tree", "blue boat", ""])
    assert p[0, 0] > 0.9 and p[1, 1] > 0.9 and abs(p[2, 0] - 0.5) < 1e-6


# ----------------------------------------------------------------------- p10


def test_gradient():
    p = {k: v.astype(np.float64) for k, v in p10_abuse.init(3).items()}
    r = np.random.default_rng(0)
    x = np.r_[np.zeros((1, p10_abuse.DIM)), r.standard_normal((9, p10_abuse.DIM))]
    chunks = r.integers(0, 10, (4, 30))
    y, w = np.array([0.9, 0.1, 0.0, 1.0]), np.array([1.0, 2.0, 1.0, 0.5])

    def loss():
        hs, _, _ = p10_abuse.states(p, x @ p["Wf"] + p["bf"], x @ p["Wb"] + p["bb"], chunks)
        z = p10_abuse.window_logits(p, hs, chunks.T > 0)[0].max(0)
        q = 1 / (1 + np.exp(-z))
        return float((-w * (y * np.log(q) + (1 - y) * np.log(1 - q))).mean())

    g, dx = p10_abuse.gradient(p, x, chunks, y, w)
    for name in ("Wf", "Ub", "bb", "A", "a", "v", "w", "b"):
        flat, grad = p[name].reshape(-1), g[name].reshape(-1)
        k = int(np.argmax(np.abs(grad)))
        old, h = flat[k], 1e-3
        flat[k] = old + h
        up = loss()
        flat[k] = old - h
        down = loss()
        flat[k] = old
        assert abs((up - down) / (2 * h) - grad[k]) < 1e-2 + 0.1 * abs(grad[k]), name


def test_scores_every_window():
    w = p10_abuse.WINDOW
    for n in (1, w, w + 1, 159, 160, 161, 400):
        doc = np.arange(1, n + 1, dtype=np.int32)
        chunks, own = p10_abuse.chunked([doc], p10_abuse.CHUNK)
        hs = np.zeros((p10_abuse.CHUNK, len(chunks), 2 * p10_abuse.HID), np.float32)
        at = p10_abuse.window_logits(p10_abuse.init(1), hs, chunks.T > 0)[4]
        starts = {int(c[a]) for c in chunks for a in at if c[a] and (n < w or c[min(a + w, len(c)) - 1])}
        assert starts == set(range(1, max(1, n - w + 1) + 1)) and not own.any()


def test_learns_passages():
    r = random.Random(2)
    plain = ["the road was long and quiet", "snow bent the bamboo", "he folded the letter", "路断了只好回去", "雪压弯了竹枝"]
    bad = ["you worthless idiot drop dead", "你怎么还不去死蠢货"]
    texts, labels = [], []
    for i in range(160):
        parts = [r.choice(plain) for _ in range(8)]
        if i % 2:
            parts.insert(r.randint(0, 8), r.choice(bad))
        texts.append(". ".join(parts))
        labels.append(i % 2)
    w = p10_abuse.fit(texts, np.array(labels, float), epochs=6)
    z = p10_abuse.Scorer(w).logits(["snow bent the bamboo. " * 30 + "you worthless i​diot drop dead. " + "he folded the letter. " * 30, "snow bent the bamboo. " * 40, "w o r t h l e s s idiot drop dead", "", None])
    assert z[0] > 0 and z[1] < 0 and z[2] > 0 and z[3] < 0 and z[4] < 0


def test_disguises():
    assert p10_abuse.canonical("sluuuut") == "slut" and p10_abuse.canonical("h3ll") == "hell" and p10_abuse.canonical("123") == "0"
    assert p10_abuse.joined(["s", "h", "i", "t", "a", "b"]) == ["shitab"] and p10_abuse.joined(["a", "b"]) == ["a", "b"]
    v = p10_abuse.Vocabulary()
    assert v.ids("白.痴").tolist() == v.ids("白​痴").tolist() == v.ids("白痴").tolist()


def test_whole_words_are_read():
    assert p10_abuse.inputs_of("x" * 24 + "abc") != p10_abuse.inputs_of("x" * 24 + "def")


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 13), st.integers(0, 999))
def test_posteriors_in_parts(k, seed):
    p = np.random.default_rng(seed).dirichlet(np.full(k, 0.3), 7)
    got = p9_mix.in_parts(p)
    assert np.allclose(got.sum(1), 1) and (np.abs(got - p) <= 1 / p9_mix.PARTS + 1e-9).all()
    assert np.allclose(got * p9_mix.PARTS, np.round(got * p9_mix.PARTS))
