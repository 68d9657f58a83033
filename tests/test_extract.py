import pytest
from pyspark.sql import functions as F

from quillspan.functions import ids
from quillspan.operators import extract


def test_executor(spark):
    calls = spark.createDataFrame([("u1", "青云山在北，黑石山在南"), ("u2", None), ("u3", ""), ("u4", "boom")], "unit_id string, text string")

    def run(text):
        if text == "boom":
            raise extract.Retry("busy")
        if not text:
            return [({"kind": "place"}, 0, 5)]
        return extract.by_pattern("place", "(..山)")(text)

    got = sorted(extract.execute(calls, run, wait=0.0).collect(), key=lambda r: (r.unit_id, r.ordinal or 0))
    assert [(r.unit_id, r.payload, r.start_char, r.attempts, r.error) for r in got] == [
        ("u1", '{"kind":"place","name":"青云山"}', 0, 1, None), ("u1", '{"kind":"place","name":"黑石山"}', 6, 1, None), ("u3", None, 0, 1, "span outside the unit"), ("u4", None, None, 3, "busy"),
    ]


def test_payload_rules(spark):
    p = extract.Profile("p", kinds={"place": (frozenset({"name"}), frozenset({"note"}))})
    df = spark.createDataFrame([(1, '{"kind":"place","name":"x"}'), (2, '{"kind":"place"}'), (3, '{"kind":"race","name":"x"}'), (4, '{"kind":"place","name":"x","z":1}'), (5, "[]"), (6, None)], "i int, p string")
    got = {r.i: r.b for r in df.select("i", extract.payload_problem(F.col("p"), p).alias("b")).collect()}
    assert got == {1: None, 2: "missing key", 3: "unknown kind", 4: "unknown key", 5: "no object", 6: "no object"}
    assert p.identity() == extract.Profile("p", kinds={"place": (frozenset({"name"}), frozenset({"note"}))}).identity() != extract.Profile("q").identity()
    with pytest.raises(ValueError):
        extract.Profile("p", window=10, overlap=10)


def test_evidence(spark):
    b = spark.createDataFrame([("r1", 1, ["/a", "/b"]), ("r1", 2, ["/c"]), ("r2", 1, [""]), ("r4", 1, ["/ab"])], "record string, binding int, paths array<string>")
    need = spark.createDataFrame([("r1", 1, ["/a/0", "/b"]), ("r1", 2, ["/a", "/c"]), ("r2", 1, ["/x/y"]), ("r3", 1, ["/x"]), ("r4", 1, ["/a"])], "record string, group_no int, pointers array<string>")
    assert {tuple(r) for r in extract.uncovered(b, need, "record").collect()} == {("r1", 2), ("r3", 1), ("r4", 1)}


def test_tri_state(spark):
    rows = [("UNKNOWN", [], 0), ("UNKNOWN", ["a"], 0), ("KNOWN", ["a"], 1), ("KNOWN", [], 1), ("CONFLICTING", ["a"], 1), ("CONFLICTING", ["a", "b"], 0), ("x", ["a"], 1), (None, None, None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, s string, v array<string>, n int")
    got = [r[0] for r in df.orderBy("i").select(extract.tri_state_problem(F.col("s"), F.col("v"), F.col("n"))).collect()]
    assert got == [None, "unknown with values", None, "known without evidence", "conflict without two values", None, "status", "status"]


def test_rules_and_seeds(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("b", 0, None), ("c", None, "y")], "k string, n int, t string")
    rules = [extract.Rule("n", least=1, most=5), extract.Rule("t", required=False, one_of=("x",))]
    assert {tuple(r) for r in extract.violations(df, "k", rules).collect()} == {("b", "n"), ("c", "n"), ("c", "t")}
    a = spark.createDataFrame([("s", "S"), ("s", "s"), ("t", "T")], "k string, v string")
    assert {tuple(r) for r in extract.superset(a, a.where("v = 'S'"), "k", "v").collect()} == {("s", "s"), ("t", None)}
    c = spark.createDataFrame([("u", 2), ("v", 1)], "k string, n int")
    assert {tuple(r) for r in extract.count_mismatches(c, spark.createDataFrame([("u",), ("w",)], "k string"), "k", "n").collect()} == {("u", 2, 1), ("v", 1, 0), ("w", 0, 1)}


def test_schema_paths():
    s = {"oneOf": [{"$ref": "#/$defs/a"}, {"properties": {"x": {"items": {"properties": {"y": {}}}}}}], "$defs": {"a": {"properties": {"b": {"$ref": "#/$defs/a"}}}}}
    assert extract.schema_paths(s) == {"", "/b", "/x", "/x/*", "/x/*/y"}


def test_cache_and_answers(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.range(3)

    for _ in range(2):
        assert extract.cached(spark, str(tmp_path), "id1", make).count() == 3
    assert len(made) == 1
    assert extract.decode_answer('{"a": 1}') == {"a": 1}
    for bad in ("[1]", '{"a":1,"a":2}', "NaN"):
        with pytest.raises(ids.NotCanonical):
            extract.decode_answer(bad)


def test_pace(spark):
    df = spark.createDataFrame([(i,) for i in range(11)], "i int").select(F.timestamp_seconds(F.col("i") * 10).alias("at"))
    r = extract.remaining_seconds(df, "at", 21).first()
    assert (r.n_accepted, r.n_missing, r.eta_s) == (11, 10, 100)
    assert extract.remaining_seconds(df.limit(3), "at", 21).first().eta_s is None
    assert [r[0] for r in spark.createDataFrame([(0,), (1,), (2,), (3,), (9,)], "n int").select(extract.backoff_ms(F.col("n"))).collect()] == [0, 30000, 60000, 120000, 120000]
