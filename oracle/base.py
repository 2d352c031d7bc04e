"""Building blocks of the check SQL: literals, derived fleets, lines, self-reference."""

from __future__ import annotations

from fleetrisk.functions.text import DETECTOR_MARKER, PROSE_MARKER


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def strings(items: list[str]) -> str:
    return "[" + ", ".join(q(i) for i in items) + "]"


def pick(items: list[str], index: str) -> str:
    return f"({strings(items)})[({index}) % {len(items)} + 1]"


def repo_of(key: str) -> str:
    return f"CASE WHEN {key} % 3 = 0 THEN 'acme/mono' ELSE 'org' || ({key} % 5) || '/svc' || ({key} % 11) END"


def path_of(paths: list[tuple[str, str]], key: str) -> str:
    return f"{pick([p for p, _ in paths], key)} || {key} || {pick([s for _, s in paths], key)}"


def snippet_text(items: list[str], key: str, base: int = 3, spread: int = 5) -> str:
    item = pick(items, f"{key} * 31 + i * (17 + {key} % 7)")
    return f"array_to_string(list_transform(range(1, {base} + {key} % {spread} + 1), lambda i: {item}), chr(10))"


def snippet_files(items, paths, source="orders", key="o_orderkey", base=3, spread=5) -> str:
    return (f"files AS (SELECT {repo_of(key)} AS repo, 's1' AS scan_id, {path_of(paths, key)} AS path, "
            f"{snippet_text(items, key, base, spread)} AS content FROM {source})")


def token_files(items: list[str], paths) -> str:
    k = "o_orderkey"
    text = snippet_text(items, k)
    for n in (12, 20, 24, 32, 36):
        text = f"replace({text}, '{{{n}}}', substr(md5({k}::VARCHAR) || md5(({k} + 1)::VARCHAR), 1, {n}))"
    return (f"files AS (SELECT {repo_of(k)} AS repo, 's1' AS scan_id, {path_of(paths, k)} AS path, "
            f"{text} AS content FROM orders)")


DOCUMENT_FILES = (
    "files AS (SELECT 'docs/' || source AS repo, 's1' AS scan_id, lang || '/doc_' || doc_id || '.conf' AS path, "
    "n_chars AS size, regexp_replace(text, ' ?token = \"([0-9a-f]{40})\"', "
    "chr(10) || 'api_key = \"\\1\"' || chr(10) || 'plain = 1' || chr(10), 'g') AS content FROM documents)"
)

LINES = (
    "lines AS (SELECT repo, scan_id, path, unnest(range(1, len(ls) + 1))::INTEGER AS line_no, unnest(ls) AS line "
    "FROM (SELECT *, string_split(content, chr(10)) AS ls FROM files))"
)


def rx(col: str, pattern: str) -> str:
    return f"regexp_matches({col}, {q(pattern)})"


def any_rx(col: str, patterns: list[str]) -> str:
    return "(" + " OR ".join(rx(col, p) for p in patterns) + ")"


def ext(path: str = "path") -> str:
    return f"regexp_replace(lower({path}), '^.*\\.', '')"


def base(path: str = "path") -> str:
    return f"regexp_replace({path}, '^.*/', '')"


def is_in(col: str, items: list[str]) -> str:
    return f"{col} IN ({', '.join(q(i) for i in items)})"


def self_reference(line: str, pos: str) -> str:
    head = f"replace(substr({line}, 1, {pos} - 1), '\\/', '  ')"
    return (f"((regexp_matches({head}, '/([^/*][^/]*)?$') AND NOT (suffix({head}, '/') AND substr({line}, {pos}, 1) IN ('/', '*')) "
            f"AND contains(substr(replace(substr({line}, {pos}), '\\/', '  '), 2), '/')) "
            f"OR {rx(f'substr({line}, 1, {pos} - 1)', DETECTOR_MARKER)})")


def prose(line: str, pos: str) -> str:
    return rx(f"substr({line}, 1, {pos} - 1)", PROSE_MARKER)


def mask(v: str) -> str:
    return (f"CASE WHEN length({v}) <= 8 THEN repeat('•', length({v})) ELSE substr({v}, 1, 4) || "
            f"repeat('•', length({v}) - 8) || right({v}, 4) END")


# Rules whose pattern uses look-ahead, restated without it for RE2.
RE2 = {
    "js-xss-innerhtml": r"\.innerHTML\s*=\s*[^=].*",
    "js-xss-react-dangerously": r"dangerouslySetInnerHTML\s*=\s*\{\{\s*__html\s*:(?:[^\"'`]|$)",
    "js-xss-document-write": r"\bdocument\.write(?:ln)?\s*\((?:[^\"'`)][^)]*)\)",
    "js-eval": r"\beval\s*\((?:[^\"'`]|$)",
    "py-eval-exec": r"\b(?:eval|exec)\s*\((?:[^\"']|$)",
}


def rule_hits(rules, gate, lines: str = "lines", skip: str | None = None) -> str:
    """UNION ALL of one SELECT per rule: line columns, rule_id, severity, category, pos."""
    parts = []
    for r in rules:
        p = RE2.get(r.id, r.pattern)
        cond = [gate(r.gate), rx("line", p)]
        if r.suppress:
            cond.append("NOT " + rx("line", r.suppress))
        if skip:
            cond.append(f"NOT ({skip})")
        parts.append(
            f"SELECT *, {q(r.id)} AS rule_id, {q(r.severity)} AS severity, {q(r.category)} AS category, "
            f"strpos(line, regexp_extract(line, {q(p)})) AS pos FROM {lines} WHERE {' AND '.join(cond)}")
    return " UNION ALL ".join(parts)


def with_ctes(*ctes: str, select: str) -> str:
    return "WITH " + ", ".join(ctes) + " " + select
