"""Struct columns with explicit names, and long literal expressions as one SQL text.

A pack of rules is thousands of literals; built call by call it costs seconds on the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def named(**cols: Column) -> Column:
    return F.named_struct(*[x for k, v in cols.items() for x in (F.lit(k), v)])


def sql_str(text: str | None) -> str:
    """A SQL string literal. ``$`` is written as an escape: Spark substitutes ``${…}`` before parsing."""
    if text is None:
        return "CAST(NULL AS STRING)"
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'").replace("$", "\\u0024") + "'"


def sql_array(items: list[str]) -> Column:
    return F.expr("array(" + ", ".join(map(sql_str, items)) + ")")


def sql_map(pairs: list[tuple[str, str]]) -> Column:
    """Literal map of strings."""
    return F.expr("map(" + ", ".join(f"{sql_str(k)}, {sql_str(v)}" for k, v in pairs) + ")")


# Between packed texts; first of two letters that stand for one of these or for a missing text.
_BETWEEN, _ESCAPE = "\u0001", "\u0002"


def packed(*texts: Column) -> Column:
    """Texts as one, any of them may be null. A row of one text is smaller than a row of many, and its repeats lie closer to each other."""
    def one(text: Column) -> Column:
        escaped = F.replace(F.replace(text, F.lit(_ESCAPE), F.lit(_ESCAPE + "e")), F.lit(_BETWEEN), F.lit(_ESCAPE + "s"))
        return F.coalesce(escaped, F.lit(_ESCAPE + "n"))
    return F.concat_ws(_BETWEEN, *map(one, texts))


def unpacked(text: Column, names: list[str]) -> Column:
    """Struct of the texts in ``packed``."""
    def one(x: Column) -> Column:
        plain = F.replace(F.replace(x, F.lit(_ESCAPE + "s"), F.lit(_BETWEEN)), F.lit(_ESCAPE + "e"), F.lit(_ESCAPE))
        return F.when(x != _ESCAPE + "n", plain)
    parts = F.split(text, _BETWEEN, -1)
    return named(**{n: one(F.get(parts, F.lit(i))) for i, n in enumerate(names)})
