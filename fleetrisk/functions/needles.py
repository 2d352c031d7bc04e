"""Literals a pattern cannot match without, used as a cheap byte test before the regex.

``contains`` works on Spark's own string bytes; a regex first decodes the line. On lines that
hold none of the literals, which is nearly every line, the regex is never reached.
"""

from __future__ import annotations

import re

from fleetrisk.functions.structs import sql_str

_MIN, _MAX_ALTERNATIVES = 2, 16


def _best(candidates: list[set[str]]) -> set[str] | None:
    return max(candidates, key=lambda c: (min(map(len, c)), -len(c)), default=None)


def _required(items) -> set[str] | None:
    """Lower-case literals of which every match contains at least one, or None."""
    candidates: list[set[str]] = []
    run = ""

    def close() -> None:
        nonlocal run
        if run:
            candidates.append({run})
        run = ""

    for op, arg in items:
        name = str(op)
        if name == "LITERAL":
            run += chr(arg).lower()
            continue
        if name == "AT":  # anchors take no characters
            continue
        if name == "SUBPATTERN" and all(str(o) == "LITERAL" for o, _ in arg[-1]):
            run += "".join(chr(a).lower() for _, a in arg[-1])
            continue
        close()
        inner = None
        if name == "SUBPATTERN":
            inner = _required(arg[-1])
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and arg[0] >= 1:
            inner = _required(arg[2])
        elif name == "BRANCH":
            parts = [_required(b) for b in arg[1]]
            inner = set().union(*parts) if all(parts) else None
        if inner:
            candidates.append(inner)
    close()
    return _best([c for c in candidates if len(c) <= _MAX_ALTERNATIVES])


def needles(pattern: str) -> list[str]:
    """The literals to test for; empty when the pattern has no useful ones."""
    try:
        found = _required(list(re._parser.parse(pattern)))
    except (AttributeError, re.error, OverflowError):
        return []
    return sorted(found) if found and min(map(len, found)) >= _MIN and all(n.isascii() for n in found) else []


def may_match(lowered: str, pattern: str) -> str:
    """SQL of the cheap necessary condition on the lower-case column; empty when there is none."""
    found = needles(pattern)
    return "(" + " OR ".join(f"contains({lowered}, {sql_str(n)})" for n in found) + ")" if found else ""
