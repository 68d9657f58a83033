"""Identity from content: canonical JSON, hashes and ids derived from them, set and list hashes."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def canonical_json(*fields: tuple[str, Column]) -> Column:
    """One JSON object with sorted keys and nulls kept.

    Floats have no canonical form and are refused by type where the fields
    are known; strings with control characters keep Spark's escapes (see
    :func:`canonical_text` for byte parity).
    """
    ordered = sorted(fields, key=lambda kv: kv[0])
    return F.to_json(F.struct(*[c.alias(k) for k, c in ordered]), {"ignoreNullFields": "false"})


def canonical_map(m: Column) -> Column:
    """Canonical JSON of a string map: entries sorted by key."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(m))), {"ignoreNullFields": "false"})


class NotCanonical(ValueError):
    pass


def _pairs(pairs):
    out = {}
    for k, v in pairs:
        if k in out:
            raise NotCanonical("duplicate key")
        out[k] = v
    return out


def _constant(_):
    raise NotCanonical("constant")


def strict_value(text: str):
    """A JSON value whose objects repeat no key and which holds no NaN or Infinity."""
    return json.loads(text, object_pairs_hook=_pairs, parse_constant=_constant)


def _no_floats(v) -> None:
    if isinstance(v, float):
        raise NotCanonical("float")
    for x in v.values() if isinstance(v, dict) else v if isinstance(v, list) else ():
        _no_floats(x)


def canonical_dumps(v) -> str:
    """Sorted keys, no blanks, text as it is; floats are refused."""
    _no_floats(v)
    return json.dumps(v, sort_keys=True, ensure_ascii=False, separators=(",", ":"))


_STRICT = T.StructType([T.StructField("is_valid", T.BooleanType()), T.StructField("is_object", T.BooleanType()), T.StructField("is_canonical", T.BooleanType()), T.StructField("canonical", T.StringType()), T.StructField("problem", T.StringType())])


@F.pandas_udf(_STRICT)
def strict_json(s: pd.Series) -> pd.DataFrame:
    """Strict reading of JSON text: valid, an object, already canonical, its canonical form, and what is wrong."""
    rows = []
    for t in s:
        if t is None:
            rows.append((False, False, False, None, "null"))
            continue
        try:
            v = strict_value(t)
        except NotCanonical as err:
            rows.append((False, False, False, None, str(err)))
            continue
        except ValueError:
            rows.append((False, False, False, None, "syntax"))
            continue
        try:
            c = canonical_dumps(v)
        except NotCanonical as err:
            rows.append((True, isinstance(v, dict), False, None, str(err)))
            continue
        rows.append((True, isinstance(v, dict), c == t, c, None))
    return pd.DataFrame(rows, columns=[f.name for f in _STRICT.fields])


def pointer_tokens(pointer: str) -> list[str]:
    """Reference tokens of a JSON Pointer; ``~`` must be followed by 0 or 1."""
    if pointer == "":
        return []
    if not pointer.startswith("/"):
        raise NotCanonical("pointer")
    out = []
    for raw in pointer[1:].split("/"):
        if any(raw[i : i + 2] not in ("~0", "~1") for i, c in enumerate(raw) if c == "~"):
            raise NotCanonical("escape")
        out.append(raw.replace("~1", "/").replace("~0", "~"))
    return out


def resolve_pointer(value, pointer: str):
    """The value a pointer refers to; array indexes have no leading zero and lie within the array."""
    for tok in pointer_tokens(pointer):
        if isinstance(value, dict):
            value = value[tok]
        elif isinstance(value, list):
            if not tok.isascii() or not tok.isdigit() or (len(tok) > 1 and tok[0] == "0"):
                raise NotCanonical("index")
            value = value[int(tok)]
        else:
            raise KeyError(tok)
    return value


_POINTED = T.StructType([T.StructField("found", T.BooleanType()), T.StructField("value", T.StringType())])


@F.pandas_udf(_POINTED)
def json_pointer(doc: pd.Series, pointer: pd.Series) -> pd.DataFrame:
    """Whether a pointer resolves in a JSON text, and the value as canonical JSON."""
    rows = []
    for d, p in zip(doc, pointer):
        try:
            v = resolve_pointer(strict_value(d), p)
            rows.append((True, json.dumps(v, sort_keys=True, ensure_ascii=False, separators=(",", ":"))))
        except (ValueError, KeyError, IndexError, TypeError, AttributeError):
            rows.append((False, None))
    return pd.DataFrame(rows, columns=["found", "value"])


def object_hash(json_text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(json_text.cast("binary"), 256))


def derived_id(prefix: str, json_text: Column, digits: int = 20) -> Column:
    return F.concat(F.lit(prefix + "-"), F.upper(F.left(F.sha2(json_text.cast("binary"), 256), F.lit(digits))))


def set_hash(ids: Column) -> Column:
    """Hash of a set of ids: order and repeats do not count."""
    return object_hash(F.to_json(F.array_sort(F.array_distinct(ids))))


def list_hash(ids: Column) -> Column:
    """Hash of an ordered list."""
    return object_hash(F.to_json(ids))
