"""Check SQL of commit history, quotas and event counters."""

from __future__ import annotations

from fleetrisk.plans import registry as R
from fleetrisk.rules import secrets as X
from oracle.base import mask, q, repo_of, rx, self_reference, snippet_text, with_ctes


def _commits() -> list[str]:
    k = "o_orderkey"
    text = snippet_text(R.PATCH_LINES, k, 5, 7)
    for n in (12, 32, 36):
        text = f"replace({text}, '{{{n}}}', substr(md5(({k} % 40)::VARCHAR) || md5(({k} % 40 + 1)::VARCHAR), 1, {n}))"
    hunk = "regexp_extract(raw, '^@@ -\\d+(?:,\\d+)? \\+(\\d+)(?:,\\d+)? @@', 1)"
    marker = "(starts_with(raw, '+++') OR starts_with(raw, '---'))"
    w = "OVER (PARTITION BY sha ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND {})"
    return [
        f"c AS (SELECT {repo_of(k)} AS repo, 'c' || {k} AS sha, o_orderdate, 'src/f' || ({k} % 6) || '.ts' AS path, {k} % 4 <> 0 AS verified, {text} AS patch FROM orders)",
        "l AS (SELECT repo, sha, path, o_orderdate, unnest(range(1, len(ls) + 1)) AS pos, unnest(ls) AS raw FROM (SELECT *, string_split(patch, chr(10)) AS ls FROM c))",
        f"h AS (SELECT *, TRY_CAST(nullif({hunk}, '') AS INTEGER) AS st, {marker} AS mk FROM l)",
        f"g AS (SELECT *, last_value(st IGNORE NULLS) {w.format('CURRENT ROW')} AS hs, max(CASE WHEN st IS NOT NULL THEN pos END) {w.format('CURRENT ROW')} AS hp FROM h)",
        # A line's number: its hunk's start plus the earlier lines of the hunk that count.
        f"n AS (SELECT *, coalesce(hs, 0) + coalesce(sum(CASE WHEN st IS NULL AND NOT mk AND NOT starts_with(raw, '-') THEN 1 ELSE 0 END) OVER (PARTITION BY sha, hp ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS line_no FROM g)",
        "a AS (SELECT repo, sha, path, o_orderdate, line_no::INTEGER AS line_no, substr(raw, 2) AS line FROM n WHERE starts_with(raw, '+') AND NOT mk AND st IS NULL)",
    ]


def history() -> str:
    rules = [r for r in X.SECRET_RULES if r.id in ("github-pat", "stripe-live-secret", "password-in-url")]
    hits = " UNION ALL ".join(f"SELECT a.*, {q(r.id)} AS rule_id, regexp_extract(line, {q(r.pattern)}) AS m FROM a WHERE {rx('line', r.pattern)}" for r in rules)
    k = "o_orderkey"
    return with_ctes(
        *_commits(), f"x AS ({hits})",
        f"y AS (SELECT repo, path AS file_path, line_no, rule_id, trim(replace(line, m, {mask('m')})) AS line_content, sha AS commit_sha FROM x WHERE NOT {self_reference('line', 'strpos(line, m)')})",
        f"t0 AS (SELECT {repo_of(k)} AS repo, 'src/f' || ({k} % 6) || '.ts' AS file_path, 'ghp_' || substr(md5(({k} % 40)::VARCHAR) || md5(({k} % 40 + 1)::VARCHAR), 1, 36) AS m FROM orders WHERE {k} % 4 = 0)",
        f"t AS (SELECT DISTINCT repo, file_path, 'const a = ''' || {mask('m')} || '''' AS line_content FROM t0)",
        select="SELECT * FROM y WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.repo = y.repo AND t.file_path = y.file_path AND y.rule_id = 'github-pat' AND t.line_content = y.line_content)")


def quota() -> str:
    return (
        "WITH RECURSIVE e AS (SELECT CASE WHEN user_id % 3 = 0 THEN 'u-hot' ELSE 'u' || user_id END AS key, ts, epoch_us(ts) // 1000 AS ms FROM events), "
        "w AS (SELECT key, min(ms) AS s FROM e GROUP BY key UNION ALL SELECT e.key, min(e.ms) FROM w JOIN e ON e.key = w.key AND e.ms >= w.s + 3600000 GROUP BY e.key, w.s), "
        "b AS (SELECT e.*, max(w.s) AS s FROM e JOIN w ON w.key = e.key AND w.s <= e.ms GROUP BY e.key, e.ts, e.ms), "
        "r AS (SELECT *, row_number() OVER (PARTITION BY key, s ORDER BY ts) AS n FROM b) "
        "SELECT key, ts, n <= 3 AS allowed, greatest(3 - n, 0)::INTEGER AS remaining, CASE WHEN n <= 3 THEN 0 ELSE greatest(1, ceil((s + 3600000 - ms) / 1000.0)) END::BIGINT AS retry_after_s FROM r")


def sql() -> dict[str, str]:
    return {
        "sec_4_added_lines": with_ctes(*_commits(), select="SELECT sha, path, line_no, line FROM a"),
        "sec_5_history_secrets": history(),
        "pos_4_signed_ratio": with_ctes(*_commits()[:1], "r AS (SELECT repo, verified, row_number() OVER (PARTITION BY repo ORDER BY o_orderdate DESC, sha) AS rn FROM c)",
                                        select="SELECT repo, 's1' AS scan_id, round(avg(verified::INTEGER), 6) AS ratio FROM r WHERE rn <= 30 GROUP BY repo"),
        "str_1_quota": quota(),
        "str_4_event_counters": "SELECT date_trunc('hour', ts) AS window_start, count(*) AS scans, count(*) FILTER (event_type = 'error') AS failed, count(*) FILTER (event_type = 'view') AS degraded, round(avg(value), 4) AS mean_ms FROM events GROUP BY 1",
    }
