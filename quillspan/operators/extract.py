"""Structured extraction over units: executors, evidence rules, schema rules, reconciliation of what came back."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.functions import ids


@dataclass(frozen=True)
class Profile:
    """What an extraction asks of its units and answers."""

    name: str
    window: int = 10_000
    overlap: int = 1_800
    max_records: int = 64
    reducer: str = "exact-payload"
    kinds: dict[str, tuple[frozenset[str], frozenset[str]]] = field(default_factory=dict)  # kind: (required, allowed) keys

    def __post_init__(self):
        if not 0 <= self.overlap < self.window:
            raise ValueError("the overlap must be at least 0 and less than the window")

    def identity(self) -> str:
        """Hash of the profile: results under one identity can be reused."""
        import hashlib

        kinds = {k: [sorted(r), sorted(a)] for k, (r, a) in sorted(self.kinds.items())}
        return hashlib.sha256(ids.canonical_dumps({"kinds": kinds, "max_records": self.max_records, "name": self.name, "overlap": self.overlap, "reducer": self.reducer, "window": self.window}).encode()).hexdigest()


RESULTS = "unit_id string, ordinal int, payload string, start_char int, end_char int, attempts int, error string"


class Retry(RuntimeError):
    """Raised by an executor whose call may succeed when it is made again."""


def execute(units: DataFrame, executor: Callable[[str], list[tuple[dict, int, int]]], unit: str = "unit_id", text: str = "text", max_attempts: int = 3, wait: float = 1.0) -> DataFrame:
    """Run an executor over the text of each unit: ``(payload, start, end)`` records as rows, or one row with an error.

    Calls that raise :class:`Retry` are made again, waiting ``wait`` doubled
    each time up to four times that. Units with null text give no row; a unit
    without records gives none either. Order of completion does not count:
    records carry their ordinal.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for u, t in zip(pdf[unit], pdf[text]):
                if t is None:
                    continue
                for attempt in range(1, max_attempts + 1):
                    try:
                        got = executor(t)
                    except Retry as err:
                        if attempt == max_attempts:
                            rows.append((u, None, None, None, None, attempt, str(err) or "retry"))
                            break
                        time.sleep(min(wait * 2 ** (attempt - 1), 4 * wait))
                    except Exception as err:  # noqa: BLE001 - an executor's failure is data
                        rows.append((u, None, None, None, None, attempt, f"{type(err).__name__}: {err}"))
                        break
                    else:
                        for k, (payload, a, b) in enumerate(got):
                            if 0 <= a < b <= len(t):
                                rows.append((u, k, ids.canonical_dumps(payload), a, b, attempt, None))
                            else:
                                rows.append((u, k, None, a, b, attempt, "span outside the unit"))
                        break
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in RESULTS.split(", ")])

    return units.select(unit, text).mapInPandas(run, RESULTS)


def by_pattern(kind: str, pattern: str) -> Callable[[str], list[tuple[dict, int, int]]]:
    """A deterministic executor: one record per match, named by its first group."""
    rx = re.compile(pattern)
    return lambda text: [({"kind": kind, "name": m.group(1)}, m.start(1), m.end(1)) for m in rx.finditer(text)]


def payload_problem(payload: Column, profile: Profile) -> Column:
    """First rule that a payload breaks: not an object, unknown kind, missing or unknown keys; null when none."""
    keys = F.json_object_keys(payload)
    kind = F.get_json_object(payload, "$.kind")
    out = F.when(keys.isNull(), "no object").when(kind.isNull() | ~kind.isin(*profile.kinds) if profile.kinds else kind.isNull(), "unknown kind")
    for k, (required, allowed) in sorted(profile.kinds.items()):
        need, may = F.array(*[F.lit(x) for x in sorted(required | {"kind"})]), F.array(*[F.lit(x) for x in sorted(allowed | required | {"kind"})])
        out = out.when((kind == k) & (F.size(F.array_except(need, keys)) > 0), "missing key").when((kind == k) & (F.size(F.array_except(keys, may)) > 0), "unknown key")
    return out


def covers(path: Column, pointer: Column) -> Column:
    """Whether an evidence path covers a pointer: itself, what lies below it, or everything for the empty path."""
    return (path == "") | (path == pointer) | pointer.startswith(F.concat(path, F.lit("/")))


def uncovered(bindings: DataFrame, required: DataFrame, record: str) -> DataFrame:
    """Required groups of a record that no single binding covers whole.

    ``bindings`` has ``record, binding, paths array<string>``; ``required``
    has ``record, group_no, pointers array<string>``.
    """
    j = required.join(bindings, record, "left")
    ok = F.coalesce(F.forall("pointers", lambda p: F.exists("paths", lambda x: covers(x, p))), F.lit(False))
    return j.groupBy(record, "group_no").agg(F.max(ok.cast("int")).alias("_ok")).where("_ok = 0").select(record, "group_no")


def tri_state_problem(status: Column, values: Column, n_spans: Column) -> Column:
    """What is wrong with a field: UNKNOWN holds nothing, KNOWN a value with evidence, CONFLICTING two values."""
    n = F.coalesce(F.size(values), F.lit(0))
    return (
        F.when(~F.coalesce(status.isin("UNKNOWN", "KNOWN", "CONFLICTING"), F.lit(False)), "status")
        .when((status == "UNKNOWN") & ((n > 0) | (n_spans > 0)), "unknown with values")
        .when((status == "KNOWN") & ((n < 1) | (n_spans < 1)), "known without evidence")
        .when((status == "CONFLICTING") & (n < 2), "conflict without two values")
    )


@dataclass(frozen=True)
class Rule:
    """A rule on a column: not null, a pattern, an enumeration or bounds."""

    column: str
    required: bool = True
    pattern: str | None = None
    one_of: tuple[str, ...] | None = None
    least: int | None = None
    most: int | None = None

    def broken(self) -> Column:
        c = F.col(self.column)
        bad = F.lit(False)
        if self.pattern:
            bad = bad | ~c.rlike(self.pattern)
        if self.one_of:
            bad = bad | ~c.isin(*self.one_of)
        if self.least is not None:
            bad = bad | (c < self.least)
        if self.most is not None:
            bad = bad | (c > self.most)
        return F.when(c.isNull(), F.lit(self.required)).otherwise(bad)


def violations(df: DataFrame, key: str, rules: list[Rule]) -> DataFrame:
    """``key, column`` of every broken rule, in one scan of the table."""
    hit = F.array_compact(F.array(*[F.when(r.broken(), F.lit(r.column)) for r in rules]))
    return df.select(key, F.explode(hit).alias("column"))


def superset(intake: DataFrame, plan: DataFrame, key: str, surface: str) -> DataFrame:
    """Keys and surface forms of the intake that the plan lost: ``key, lost`` (null where the whole key is gone)."""
    a, b = intake.select(key, surface).distinct(), plan.select(key, surface).distinct()
    gone = a.select(key).distinct().join(b.select(key).distinct(), key, "left_anti").select(key, F.lit(None).cast("string").alias("lost"))
    kept = a.join(b.select(key).distinct(), key, "left_semi").join(b, [key, surface], "left_anti").select(key, F.col(surface).alias("lost"))
    return gone.unionByName(kept)


def count_mismatches(claimed: DataFrame, rows: DataFrame, unit: str, n: str) -> DataFrame:
    """Units whose claimed count differs from the rows that are there; units on one side only count as 0 on the other."""
    real = rows.groupBy(unit).agg(F.count("*").alias("_real"))
    j = claimed.select(unit, n).join(real, unit, "full_outer").select(unit, F.coalesce(n, F.lit(0)).alias("claimed"), F.coalesce("_real", F.lit(0)).alias("counted"))
    return j.where("claimed <> counted")


def single_author(leads: DataFrame, work: str, author: str) -> DataFrame:
    """Groups of leads on one work, and whether at most one author is claimed for it."""
    g = leads.groupBy(work).agg(F.count("*").alias("n_leads"), F.countDistinct(author).alias("n_authors"), F.min(author).alias("author"))
    return g.withColumn("is_group", F.col("n_authors") <= 1).withColumn("author", F.when(F.col("n_authors") == 1, F.col("author")))


def schema_paths(schema: dict, prefix: str = "") -> set[str]:
    """Paths of a JSON schema: properties, items as ``*``, through alternatives and internal references."""

    def walk(node: dict, path: str, seen: tuple[str, ...]) -> set[str]:
        if "$ref" in node:
            ref = node["$ref"]
            if ref in seen or not ref.startswith("#/"):
                return {path}
            target = schema
            for part in ref[2:].split("/"):
                target = target[part.replace("~1", "/").replace("~0", "~")]
            return walk(target, path, (*seen, ref))
        out = {path}
        for alt in [*node.get("oneOf", []), *node.get("anyOf", [])]:
            out |= walk(alt, path, seen)
        for k, v in node.get("properties", {}).items():
            out |= walk(v, f"{path}/{k}", seen)
        if isinstance(node.get("items"), dict):
            out |= walk(node["items"], f"{path}/*", seen)
        return out

    return walk(schema, prefix, ())


def unknown_paths(wanted: DataFrame, schemas: dict[str, dict], profile: str, path: str) -> DataFrame:
    """Wanted paths that the schema of their profile does not have (anti join with the flattened schemas)."""
    rows = [(name, p) for name, s in sorted(schemas.items()) for p in sorted(schema_paths(s))]
    known = wanted.sparkSession.createDataFrame(rows or [(None, None)], f"{profile} string, {path} string")
    return wanted.join(known, [profile, path], "left_anti")


def backoff_ms(failures: Column) -> Column:
    """Wait after consecutive failures: thirty seconds doubled, two minutes at most; none without a failure."""
    return F.when(failures <= 0, F.lit(0)).otherwise(F.least(F.lit(120_000), F.lit(30_000) * F.pow(F.lit(2), F.least(failures - 1, F.lit(2))).cast("int")))


def remaining_seconds(accepted: DataFrame, at: str, total: int, recent: int = 50, least: int = 5) -> DataFrame:
    """Time that the missing entries will take at the pace of the latest accepted ones; null below ``least`` of them."""
    last = accepted.orderBy(F.col(at).desc()).limit(recent)
    n = accepted.agg(F.count("*").alias("n_accepted"))
    pace = last.agg(F.count("*").alias("n"), (F.unix_millis(F.max(at)) - F.unix_millis(F.min(at))).alias("ms"))
    missing = F.lit(total) - F.col("n_accepted")
    return n.crossJoin(pace).select("n_accepted", missing.alias("n_missing"), F.when(F.col("n_accepted") >= least, F.ceil(missing * F.col("ms") / F.greatest(F.col("n") - 1, F.lit(1)) / 1000)).alias("eta_s"))


def select_run(runs: DataFrame, **at: str) -> DataFrame:
    """The run with the given ids, marked ``is_unique``; several rows or none are not unique."""
    cond = F.lit(True)
    for k, v in at.items():
        cond = cond & (F.col(k) == v)
    hit = runs.where(cond)
    return hit.crossJoin(F.broadcast(hit.agg((F.count("*") == 1).alias("is_unique"))))


def cached(spark, path: str, identity: str, make: Callable[[], DataFrame]) -> DataFrame:
    """Results under an identity: read when they are there whole, made and written otherwise."""
    place = f"{path}/{identity}"
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(f"{place}/_SUCCESS")
    if not fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs_path):
        make().write.mode("overwrite").parquet(place)
    return spark.read.parquet(place)


def decode_answer(text: str) -> dict:
    """An answer as a JSON object without repeated keys and constants."""
    v = ids.strict_value(text)
    if not isinstance(v, dict):
        raise ids.NotCanonical("no object")
    return json.loads(json.dumps(v))
