"""Rules are data. Patterns become literals of one projection, so every task compiles each once;
a rule-table join would recompile patterns per row, so there is none.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from fleetrisk.functions.structs import sql_str


@dataclass(frozen=True)
class Rule:
    id: str
    name: str
    severity: str
    category: str
    cwe: str | None
    pattern: str
    gate: tuple[str, ...] = ("any",)
    suppress: str | None = None
    mask: bool = False
    framework: str | None = None


def metadata(rules: list[Rule], *fields: str) -> Column:
    """Literal map rule id to struct of the named text fields; looked up only on hits."""
    items = [f"{sql_str(r.id)}, named_struct({', '.join(f'{sql_str(f)}, {sql_str(getattr(r, f))}' for f in fields)})" for r in {r.id: r for r in rules}.values()]
    return F.expr(f"map({', '.join(items)})")
