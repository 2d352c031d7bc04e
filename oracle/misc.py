"""Check SQL of scalar functions, gates, framework detection, container reports and presence signals."""

from __future__ import annotations

from fleetrisk.operators import posture as PO
from fleetrisk.plans import manifests as M, registry as R, snippets as S
from oracle.base import LINES, is_in, q, rx, self_reference, snippet_files, with_ctes
from fleetrisk.plans.views import case_of


def container() -> str:
    """Expected findings straight from the numbers the reports were written with."""
    path = case_of("o_orderkey", ["1", "2", "3", "0"])
    rule = case_of("o_orderkey + i", ["CVE-1", "GHSA-x", "KSV1", "CVE-2"])
    said = case_of("o_orderkey + i * 2", ["high", None, "medium"])
    rows = (f"r AS (SELECT 'm' || o_orderkey AS scan_id, 'pkg' || (o_orderkey % 30) AS package, '1.' || i AS version, {rule} AS rid, {said} AS said, {case_of('i', ['high', 'medium', 'low'])} AS lvl, '2.' || i AS fixed, "
            f"CASE WHEN {rule} = 'CVE-1' THEN (o_orderkey % 10) + 0.5 END::DOUBLE AS cvss_score FROM orders, unnest(range(1, 2 + o_orderkey % 3)) AS t(i) WHERE {path} <> '0')")
    return with_ctes(rows, select=(
        "SELECT scan_id, package, version, CASE WHEN said IS NOT NULL THEN said WHEN cvss_score >= 9 THEN 'critical' WHEN cvss_score >= 7 THEN 'high' WHEN cvss_score >= 4 THEN 'medium' WHEN cvss_score IS NOT NULL THEN 'low' ELSE lvl END AS severity, "
        "CASE WHEN rid = 'CVE-1' THEN 'short one' ELSE rid || ' in ' || package END AS title, CASE WHEN rid LIKE 'GHSA-%' THEN rid END AS ghsa, '< ' || fixed AS vulnerable_versions, cvss_score, "
        "CASE WHEN rid = 'CVE-1' THEN 'https://h/1' ELSE 'https://avd.aquasec.com/nvd/' || lower(rid) END AS url FROM r WHERE rid <> 'KSV1'"))


def presence() -> str:
    a = snippet_files(S.WORKFLOW, R.PRESENCE_PATHS).replace("files AS (", "a AS (", 1)
    b = snippet_files(S.WORKFLOW + ["      attestations: write"], R.WORKFLOW_PATHS).replace("files AS (", "b AS (", 1)
    wanted = [p for ps in PO.PRESENCE.values() for p in ps]
    flags = ", ".join(f"bool_or({is_in('path', ps)}) AS {k}" for k, ps in PO.PRESENCE.items())
    flow = "regexp_matches(path, '(?i)^\\.github/workflows/[^/]+\\.ya?ml$')"
    return with_ctes(a, b, "u AS (SELECT repo || '-' || (length(content) % 97) AS repo, regexp_replace(path, '^\\d+', '') AS path, content FROM (SELECT * FROM a UNION ALL SELECT * FROM b))",
                     select=f"SELECT repo, 's1' AS scan_id, {flags}, CASE WHEN count(*) FILTER ({flow}) = 0 THEN 'unknown' WHEN bool_or({flow} AND {rx('content', PO.PROVENANCE)}) THEN 'present' ELSE 'absent' END AS release_provenance "
                     f"FROM u WHERE {is_in('path', wanted)} OR {flow} GROUP BY repo")


def sql() -> dict[str, str]:
    p = "regexp_replace(url, '^https?://[^/]+/?', '')"
    ref = f"regexp_replace({p}, '[?#].*$', '')"
    u = "CASE WHEN page_id % 3 = 0 THEN regexp_replace(regexp_replace(url, '^(https?://)[^/]+', '\\1github.com'), '^https?://', '') WHEN page_id % 7 = 0 THEN url ELSE regexp_replace(url, '^(https?://)[^/]+', '\\1github.com') END"
    seg = "string_split(regexp_replace(regexp_replace(u, '^https?://', ''), '[?#].*$', ''), '/')"
    return {
        "flt_3_binary": "SELECT doc_id, (length(s) - length(regexp_replace(s, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]', '', 'g'))) > length(s) * 0.1 AS is_binary FROM (SELECT doc_id, substr(CASE WHEN doc_id % 2 = 0 THEN replace(text, ' ', chr(1)) ELSE text END, 1, 1000) AS s FROM documents)",
        "flt_10_self_reference": with_ctes(snippet_files(S.JS, [("src/f", ".ts")]), LINES, "l AS (SELECT *, unnest(list_filter(range(1, length(line) + 1), lambda p: substr(line, p, 1) = 'e'))::INTEGER AS pos FROM lines)", select=f"SELECT repo, path, line_no, pos, {self_reference('line', 'pos')} AS self_reference FROM l"),
        "flt_12_identifiers": f"SELECT page_id, length(p) BETWEEN 1 AND 1024 AND p NOT IN ('.', './') AND NOT starts_with(p, '/') AND NOT contains(p, '://') AND NOT contains(p, chr(92)) AND len(list_filter(string_split(p, '/'), lambda s: s = '..')) = 0 AND trim(p) = p AS path_ok, "
                              "regexp_matches(r, '^[A-Za-z0-9._/-]+$') AND length(r) <= 255 AND NOT starts_with(r, '/') AND NOT suffix(r, '/') AND NOT starts_with(r, '-') AND NOT contains(r, '//') AND NOT contains(r, '..') AS ref_ok, "
                              f"regexp_matches(o, '^[A-Za-z0-9._-]+$') AND length(o) <= 100 AND NOT regexp_matches(o, '^\\.+$') AS owner_ok FROM (SELECT page_id, {p} AS p, {ref} AS r, split_part({ref}, '/', 1) AS o FROM pages)",
        "sf_7_repo_urls": f"SELECT page_id, CASE WHEN s[1] = 'github.com' AND len(s) >= 3 AND s[2] <> '' AND s[3] <> '' AND regexp_matches(s[2], '^[A-Za-z0-9._-]+$') AND regexp_matches(s[3], '^[A-Za-z0-9._-]+$') THEN s[2] || '/' || regexp_replace(s[3], '\\.git$', '') END AS repo FROM (SELECT page_id, {seg} AS s FROM (SELECT page_id, {u} AS u FROM pages))",
        "sf_1_entropy": "WITH c AS (SELECT doc_id, unnest(string_split(text, '')) AS ch, length(text) AS n FROM documents), g AS (SELECT doc_id, ch, n, count(*) / n AS p FROM c WHERE ch <> '' GROUP BY doc_id, ch, n) SELECT doc_id, round(-sum(p * log2(p)), 6) AS entropy FROM g GROUP BY doc_id",
        "fw_2_frameworks": with_ctes(R.ORACLE_FRAMEWORKS, select="SELECT DISTINCT repo, framework FROM fw"),
        "src_8_container_reports": container(), "pos_2_file_signals": presence(),
    }
