"""Column expressions on text: masking, entropy, redaction, self-reference."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

BULLET = "•"
REDACTED = "***REDACTED***"

# Fixed value: property markers that introduce a detector's own pattern.
DETECTOR_MARKER = r"(?i)\b(?:regex|pattern|matcher|test|rule)\s*:\s*"

# Fixed value: property markers that introduce prose.
PROSE_MARKER = r"(?i)\b(?:description|name|reason|title|message|label|capability)\s*:\s*"

# Token shapes redacted even without quotes.
TOKEN_SHAPES = (
    r"\b(?:sk-[A-Za-z0-9_-]{12,}|sk_(?:live|test)_[A-Za-z0-9]{12,}|ghp_[A-Za-z0-9]{20,}"
    r"|gho_[A-Za-z0-9]{20,}|github_pat_[A-Za-z0-9_]{20,}|AKIA[0-9A-Z]{16}"
    r"|AIza[0-9A-Za-z_-]{20,}|xox[baprs]-[0-9A-Za-z-]{10,})"
)


# White space cut from line ends, tabs and carriage returns included.
_SPACE = " \t\r\n\f\v\u00a0\ufeff"


def strip(text: Column | str) -> Column:
    return F.btrim(text, F.lit(_SPACE))


def lstrip(text: Column | str) -> Column:
    return F.ltrim(text, F.lit(_SPACE))


def mask_value(value: Column) -> Column:
    """Keep four characters at each end; eight or fewer are hidden whole."""
    n = F.length(value)
    return F.when(n <= 8, F.repeat(F.lit(BULLET), n)).otherwise(
        F.concat(F.substring(value, 1, 4), F.repeat(F.lit(BULLET), n - 8), F.right(value, F.lit(4)))
    )


def replace_first(text: Column, needle: Column, by: Column) -> Column:
    at = F.instr(text, needle)
    return F.when(at == 0, text).otherwise(
        F.concat(F.substr(text, F.lit(1), at - 1), by, F.substr(text, at + F.length(needle)))
    )


def mask_line(line: Column, matched: Column) -> Column:
    """Line with the first occurrence of the secret masked, cut to 200 characters."""
    safe = replace_first(line, matched, mask_value(matched))
    return F.when(F.length(safe) > 200, F.concat(F.substring(safe, 1, 197), F.lit("..."))).otherwise(strip(safe))


def clip(line: Column, n: int = 200) -> Column:
    return F.substring(strip(line), 1, n)


def ellipsis(line: Column, n: int = 200) -> Column:
    return F.when(F.length(line) > n, F.concat(F.substring(line, 1, n), F.lit("…"))).otherwise(line)


def redact_quoted(line: Column, min_len: int) -> Column:
    """Quoted literals of ``min_len`` or more characters become a marker."""
    pattern = "([\"'`])([^\"'`\\n]{" + str(min_len) + ",})\\1"
    return F.regexp_replace(line, pattern, "$1" + REDACTED.replace("*", "\\*") + "$1")


def redact_tokens(line: Column) -> Column:
    return F.regexp_replace(line, TOKEN_SHAPES, REDACTED)


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` names it: a lambda over an array of one."""
    return F.transform(F.array(value), use)[0]


def shannon_entropy(s: Column) -> Column:
    """Bits per character. The characters are sorted once; equal ones are then runs, and only the runs' ends are added up."""
    def of(a: Column) -> Column:
        n = F.size(a)
        inner = F.when(n > 1, F.filter(F.sequence(F.lit(1), n - 1), lambda i: a[i] != a[i - 1])).otherwise(F.array().cast("array<int>"))

        def add(acc: Column, end: Column) -> Column:
            p = (end - acc["at"]) / n
            return F.struct(end.alias("at"), (acc["bits"] - p * F.log2(p)).alias("bits"))

        return F.when(n > 0, F.aggregate(F.concat(inner, F.array(n)), F.struct(F.lit(0).alias("at"), F.lit(0.0).alias("bits")), add)["bits"]).otherwise(F.lit(0.0))

    return F.when(F.length(s) > 0, bound(F.sort_array(F.split(s, "")), of)).otherwise(F.lit(0.0))


def self_reference(line: Column, pos: Column) -> Column:
    """True when a match starting at 1-based ``pos`` looks like a detector's own definition.

    Either the match sits between two unescaped slashes of a regex literal, or a
    ``pattern:``-like marker stands before it. Escaped slashes are blanked first, so
    "nearest unescaped slash" becomes a plain end-anchored test. Text before the match without
    a slash or a colon reaches no regex.
    """
    blank, before = F.lit("  "), F.substr(line, F.lit(1), pos - 1)
    head = F.replace(before, F.lit("\\/"), blank)
    at = F.substr(line, pos, F.lit(1))
    tail = F.substr(F.replace(F.substr(line, pos), F.lit("\\/"), blank), F.lit(2))
    opened = head.rlike(r"/(?:[^/*][^/]*)?$") & ~(head.endswith("/") & at.isin("/", "*"))
    return (before.contains("/") & opened & tail.contains("/")) | (before.contains(":") & before.rlike(DETECTOR_MARKER))


def after_prose_marker(line: Column, pos: Column) -> Column:
    return F.substr(line, F.lit(1), pos - 1).rlike(PROSE_MARKER)


def comment_line(line: Column, hash_is_comment: Column | bool = True) -> Column:
    t = lstrip(line)
    h = hash_is_comment if isinstance(hash_is_comment, Column) else F.lit(hash_is_comment)
    return t.startswith("//") | t.startswith("*") | (h & t.startswith("#"))
