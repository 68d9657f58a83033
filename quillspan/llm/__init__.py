"""Text operators for large training corpora.

Nothing outside this package imports it. ``QUERIES`` and ``SQL`` collect what
its modules register; a module is one problem.
"""

from importlib import import_module

MODULES = ("p1_cut", "p2_split", "p3_residue", "p4_lookalike", "p5_garbled", "p6_lines", "p7_content", "p8_leak", "p9_mix", "p10_abuse")


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
