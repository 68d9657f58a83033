"""Named queries over the test tables, each an operator applied to whole tables, with DuckDB SQL where SQL can say the same."""

from importlib import import_module

MODULES = ("texts", "spans", "records", "scores", "extracts", "streams")


def queries() -> dict:
    out = {}
    for name in MODULES:
        out.update(import_module(f"{__name__}.{name}").QUERIES)
    return out


def oracle_sql() -> dict[str, str]:
    out = {}
    for name in MODULES:
        out.update(import_module(f"{__name__}.{name}").SQL)
    return out
