"""Check SQL of scoring, diff, suppression, attack paths, SARIF, catalogue, fixes and analytics."""

from __future__ import annotations

from fleetrisk.functions.paths import JS_EXTENSIONS, PUBLIC_ROUTE_PATTERNS
from fleetrisk.operators import attack as AT, catalog as CT, fix as FX, score as SC
from fleetrisk.plans import registry as R, views as V
from oracle.base import LINES, any_rx, is_in, q, rx, snippet_files, with_ctes

FIN = "f AS (" + V.plain(V.FINDINGS_SQL) + ")"
STORED = "stored AS (" + V.plain(V.STORED_SUPPRESSIONS_SQL) + ")"
SCANS = "scans AS (" + V.plain(V.SCANS_SQL) + ")"
FIXTURE = "coalesce(likely_test_fixture, FALSE)"
BASE = "(CASE severity WHEN 'critical' THEN 40 WHEN 'high' THEN 15 WHEN 'medium' THEN 5 WHEN 'moderate' THEN 5 WHEN 'low' THEN 1 ELSE 0 END)::DOUBLE"
SCORE = (f"{BASE} * CASE WHEN {FIXTURE} THEN 0.1::DOUBLE ELSE 1 END * CASE WHEN kind = 'secret' AND source = 'history' THEN 0.5::DOUBLE ELSE 1 END "
         "* CASE WHEN kind = 'secret' AND validation = 'active' THEN 1.5::DOUBLE WHEN kind = 'secret' AND validation = 'inactive' THEN 0.15::DOUBLE ELSE 1 END "
         "* CASE WHEN kind IN ('dependency', 'license') AND is_transitive THEN 0.5::DOUBLE ELSE 1 END * CASE WHEN kind = 'dependency' AND is_dev THEN 0.4::DOUBLE ELSE 1 END "
         f"* CASE WHEN kind = 'code' AND {any_rx('lower(file_path)', PUBLIC_ROUTE_PATTERNS)} THEN 1.3::DOUBLE ELSE 1 END")
SCORED = f"s AS (SELECT *, {SCORE} AS score FROM f)"
SEV_RANK = "CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'moderate' THEN 2 WHEN 'low' THEN 3 ELSE 4 END"
BREAK = ("b AS (SELECT repo, scan_id, " + ", ".join(
    f"sum(CASE WHEN NOT {FIXTURE} AND severity IN ({w}) THEN score ELSE 0 END) AS {n}" for n, w in
    [("critical", "'critical'"), ("high", "'high'"), ("medium", "'medium', 'moderate'"), ("low", "'low'")])
    + f", sum(CASE WHEN {FIXTURE} THEN score ELSE 0 END) AS fixture FROM s GROUP BY ALL), "
    "c AS (SELECT *, CASE WHEN critical + high + medium + low <= 0 THEN 0 ELSE least(100, round(25 * log10(1 + critical + high + medium + low)))::INTEGER END AS risk_score FROM b)")
FP = ("CASE kind WHEN 'secret' THEN 'secret|' || CASE WHEN source = 'history' THEN coalesce(commit_sha, '?') ELSE 'tree' END || '|' || rule_id || '|' || file_path || '|' || line_no "
      "WHEN 'code' THEN 'code|' || rule_id || '|' || file_path || '|' || line_no WHEN 'iac' THEN 'iac|' || rule_id || '|' || coalesce(file_path, '?') || '|' || coalesce(line_no::VARCHAR, '?') "
      "WHEN 'sensitive-file' THEN 'sensitive-file|' || rule_id || '|' || file_path WHEN 'dependency' THEN 'dependency|' || package || '|' || coalesce(ghsa, version, '?') "
      "WHEN 'license' THEN 'license|' || package || '|' || version || '|' || license_risk END")
FPS = f"p AS (SELECT *, {FP} AS fp FROM f)"

# The globs of the derived suppressions, translated by hand.
GLOB_RX = {
    "**": r"^.+$", "src/**": r"^src/.+$", "tests/*": r"^tests/[^/]+$", "**/*.tf": r"^(.*/)?[^/]*\.tf$", "package.json": r"^package\.json$",
    "src/f1.ts": r"^src/f1\.ts$", "routes/f?.py": r"^routes/f[^/]\.py$", "infra/f[1-3].yml": r"^infra/f[1-3]\.yml$", "*.md": r"^[^/]*\.md$",
    "app/**/f7.*": r"^app/(.*/)?f7\.[^/]*$", "requirements.txt": r"^requirements\.txt$", "docs/f*": r"^docs/f[^/]*$",
    "code/*": r"^code/[^/]+$", "secret/aws-*": r"^secret/aws-[^/]*$", "iac/terraform": r"^iac/terraform$", "dependency/pkg1*": r"^dependency/pkg1[^/]*$",
    "license/**": r"^license/.+$", "code/cwe-79": r"^code/cwe-79$", "dependency/GHSA-1?": r"^dependency/GHSA-1[^/]$",
    "dependency/pkg7/GHSA-*": r"^dependency/pkg7/GHSA-[^/]*$",
}
_NPM, _PY = "['package.json', 'package-lock.json']", "['requirements.txt', 'pyproject.toml', 'Pipfile']"
_SRC = "coalesce(source, CASE kind WHEN 'license' THEN 'package-lock.json' ELSE 'package.json' END)"


def applied() -> list[str]:
    paths = (f"CASE WHEN kind IN ('dependency', 'license') THEN CASE WHEN list_contains({_NPM}, {_SRC}) THEN {_NPM} WHEN list_contains({_PY}, {_SRC}) THEN {_PY} "
             f"ELSE [{_SRC}] END ELSE [file_path] END")
    ids = ("CASE kind WHEN 'secret' THEN [CASE WHEN rule_id LIKE 'entropy-%' THEN 'entropy/' WHEN source = 'history' THEN 'git-history/' ELSE 'secret/' END || rule_id] "
           "WHEN 'code' THEN ['code/' || rule_id, 'code/' || lower(cwe)] WHEN 'iac' THEN ['iac/' || rule_id, 'iac/' || category] WHEN 'sensitive-file' THEN ['sensitive-file/' || rule_id] "
           "WHEN 'dependency' THEN ['dependency/' || package, 'dependency/' || package || '/' || ghsa, 'dependency/' || ghsa] ELSE ['license/' || package] END")
    g = "CASE {0} " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in GLOB_RX.items()) + " END"
    return [
        "f AS (SELECT *, row_number() OVER () AS rid FROM (" + V.plain(V.FINDINGS_SQL) + "))", "sup0 AS (" + V.plain(V.SUPPRESSIONS_SQL) + ")",
        f"sup AS (SELECT *, {g.format('path_glob')} AS prx, {g.format('rule_glob')} AS rrx, CASE WHEN rule_glob IS NULL THEN 0 ELSE 2 END + "
        "CASE WHEN regexp_matches(path_glob, '[*?\\[]') THEN 0 ELSE 1 END AS spec FROM (SELECT repo, path_glob, rule_glob, min(source_line) AS source_line, list(expires ORDER BY source_line)[1] AS expires FROM sup0 GROUP BY ALL))",
        f"fx AS (SELECT *, {paths} AS paths, list_filter({ids}, lambda x: x IS NOT NULL) AS ids FROM f)",
        "m AS (SELECT fx.repo, fx.scan_id, fx.ord, fx.rid, sup.source_line, sup.expires, row_number() OVER (PARTITION BY fx.rid ORDER BY spec DESC, source_line) AS rn FROM fx JOIN sup ON fx.repo = sup.repo "
        "AND len(list_filter(fx.paths, lambda p: regexp_matches(p, sup.prx))) > 0 AND (sup.rule_glob IS NULL OR len(list_filter(fx.ids, lambda r: regexp_matches(r, sup.rrx))) > 0))",
        "best AS (SELECT *, coalesce(TIMESTAMP '2025-06-01 12:00:00' > expires::TIMESTAMP + INTERVAL 86399 SECOND, FALSE) AS expired FROM m WHERE rn = 1)",
    ]


def creds() -> list[str]:
    arms = []
    for prefixes, domain, cap, assets in AT.BLAST:
        cond = " OR ".join(f"starts_with(lower(rule_id), {q(p)})" for p in prefixes)
        arms.append(f"WHEN {cond} THEN {{'d': {q(domain)}, 'c': {q(cap)}, 'a': {q(', '.join(assets))}}}")
    return [FIN, f"c AS (SELECT *, CASE {' '.join(arms)} END AS bl, coalesce(validation = 'active', FALSE) AS live FROM f WHERE kind = 'secret' AND NOT {FIXTURE})",
            "cr AS (SELECT *, CASE WHEN live THEN 'critical' ELSE severity END AS sv, 'cred:' || rule_id || ':' || file_path || ':' || line_no AS cid FROM c WHERE bl IS NOT NULL)"]


def paths() -> str:
    exp = f"kind = 'iac' AND NOT {FIXTURE} AND {rx('lower(rule_id)', AT.EXPOSURE)}"
    return with_ctes(
        *creds(), f"ctx AS (SELECT repo, scan_id, min_by(rule_name, ord) FILTER ({exp}) AS ex, bool_or(kind = 'sensitive-file') AS sens FROM f GROUP BY ALL)",
        "j AS (SELECT cr.*, ctx.ex, bl.d = 'cloud' AND ctx.ex IS NOT NULL AS cloud FROM cr JOIN ctx USING (repo, scan_id))",
        select="SELECT repo, scan_id, 'path:' || ord AS path_id, CASE WHEN cloud THEN rule_name || ' → cloud account → production data' ELSE rule_name || ' → ' || bl.d || ' blast radius' END AS title, "
        "CASE WHEN cloud THEN 'critical' ELSE sv END AS severity, 'Leaked ' || rule_name || ' in ' || file_path || ':' || line_no || CASE WHEN live THEN ' (confirmed live)' ELSE '' END || ' | ' || bl.c || "
        "CASE WHEN cloud THEN ' | Reachable resource exposed by: ' || ex || ' | Compromise of: ' || bl.a ELSE ' | Exposure of: ' || bl.a END || "
        "CASE WHEN bl.d = 'scm' THEN ' | Pivot: poison CI/CD → downstream supply chain' ELSE '' END AS steps, live FROM j UNION ALL "
        "SELECT repo, scan_id, 'path:exposure', 'Public cloud resource → data exposure', CASE WHEN sens THEN 'high' ELSE 'medium' END, 'Misconfiguration: ' || ex || ' | ' || CASE WHEN sens THEN "
        "'Combined with a committed sensitive file, data is directly reachable' ELSE 'Anything stored in the resource is internet-reachable' END, FALSE FROM ctx "
        "WHERE ex IS NOT NULL AND NOT EXISTS (SELECT 1 FROM j WHERE j.repo = ctx.repo AND j.scan_id = ctx.scan_id AND cloud)")


SHAPES = (
    "sh AS (SELECT repo, scan_id, ord, CASE kind WHEN 'dependency' THEN 'dependency/' || coalesce(ghsa, package) WHEN 'license' THEN 'license/' || license_risk ELSE kind || '/' || rule_id END AS sarif_rule, "
    "CASE kind WHEN 'dependency' THEN title WHEN 'license' THEN coalesce(license, 'No license') || ' (' || license_risk || ')' ELSE rule_name END AS name, "
    f"CASE WHEN {FIXTURE} THEN 'note' WHEN severity IN ('critical', 'high') THEN 'error' WHEN severity = 'low' THEN 'note' ELSE 'warning' END AS level, "
    "CASE kind WHEN 'secret' THEN rule_name || ' matched in ' || file_path || ':' || line_no WHEN 'code' THEN rule_name || ' (' || coalesce(cwe, 'no CWE') || ') at ' || file_path || ':' || line_no "
    "WHEN 'iac' THEN rule_name || ' in ' || file_path || coalesce(':' || line_no, '') WHEN 'sensitive-file' THEN 'Sensitive file present: ' || file_path "
    "WHEN 'dependency' THEN package || '@' || version || ' (' || coalesce(ghsa, 'no GHSA') || ') — ' || title ELSE package || '@' || version || ' — ' || coalesce(license, 'no license declared') || ' (' || license_risk || ')' END AS message, "
    f"CASE WHEN kind IN ('dependency', 'license') THEN {_SRC} ELSE file_path END AS uri, CASE WHEN kind IN ('secret', 'code', 'iac') THEN line_no END AS start_line FROM f)"
)


def resolved() -> str:
    cat = ", ".join(f"({q(e[0])})" for e in CT.entries())
    rest = "regexp_replace(sarif_rule, '^[^/]*/', '')"
    tries = [f"(SELECT id FROM cat WHERE id = sarif_rule)", f"(SELECT id FROM cat WHERE sarif_rule LIKE 'code/%' AND id = 'ast/' || {rest})"]
    tries += [f"(SELECT id FROM cat WHERE sarif_rule LIKE 'iac/%' AND id = 'iac/{s}/' || {rest})" for s in ["dockerfile", "actions", "terraform", "kubernetes", "iam", "cloudformation", "helm"]]
    return with_ctes(FIN, SHAPES, f"cat(id) AS (VALUES {cat})", "u AS (SELECT sarif_rule, count(*) AS n FROM sh GROUP BY ALL)",
                     select=f"SELECT sarif_rule, coalesce({', '.join(tries)}) AS catalog_id, n FROM u")


def fix_kinds() -> str:
    js = r"^(\s*)(const|let|var)\s+([A-Za-z_$][A-Za-z0-9_$]*)\s*=\s*('[^'\"]+'|\"[^'\"]+\")(\s*;?\s*)$"
    py = r"^(\s*)([A-Za-z_][A-Za-z0-9_]*)\s*=\s*('[^'\"]+'|\"[^'\"]+\")(\s*)$"
    e = "regexp_replace(file_path, '^.*\\.', '')"
    ext = f"(({is_in(e, JS_EXTENSIONS)} AND {rx('line_content', js)}) OR ({e} = 'py' AND {rx('line_content', py)}))"
    imgs = "|".join(FX.CURRENT_TAG)
    return with_ctes(FIN, f"k AS (SELECT ord, CASE WHEN kind = 'dependency' AND NOT coalesce(is_transitive, FALSE) AND source IN ('package.json', 'requirements.txt') AND regexp_matches(vulnerable_versions, '<\\s*\\d+\\.\\d+\\.\\d+') THEN 'dep-bump' "
                     f"WHEN NOT {FIXTURE} AND ((kind = 'secret' AND source <> 'history') OR (kind = 'code' AND category = 'hardcoded-creds')) AND {ext} THEN 'secret-extract' "
                     f"WHEN kind = 'iac' AND NOT {FIXTURE} AND rule_id = 'dockerfile-base-image-eol' AND regexp_matches(line_content, '^FROM ({imgs}):\\d') THEN 'dockerfile-baseimage-bump' "
                     f"WHEN kind = 'iac' AND NOT {FIXTURE} AND rule_id = 'gha-permissions-write-all' THEN 'gha-permissions-fix' END AS fix_kind FROM f)",
                     select="SELECT * FROM k WHERE fix_kind IS NOT NULL")


def ignore_files() -> str:
    mod = lambda k: (f"coalesce(nullif(regexp_extract(rest, '\\[{k}=\"([^\"]*)\"\\]', 1), ''), nullif(regexp_extract(rest, '\\[{k}=([^\\s\\]\"]+)\\]', 1), ''))")
    return with_ctes(
        snippet_files(R.IGNORE_LINES, [("", "")]), LINES, "t AS (SELECT repo, line_no, regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS t FROM lines)",
        "g AS (SELECT *, regexp_extract(t, '^([^ \\t\\[]*)', 1) AS path_glob FROM t WHERE t <> '' AND t NOT LIKE '#%')",
        "r AS (SELECT *, substr(t, length(path_glob) + 1) AS rest FROM g WHERE path_glob <> '')",
        select=f"SELECT repo, path_glob, {mod('rule')} AS rule_glob, {mod('reason')} AS reason, TRY_CAST({mod('expires')} AS DATE) AS expires, line_no AS source_line, count(*) AS n FROM r GROUP BY ALL")


def sql() -> dict[str, str]:
    now = "TIMESTAMP '2024-01-25 00:00:00'"
    det = ("CASE WHEN kind = 'secret' AND rule_id LIKE 'entropy-%' THEN 'entropy' WHEN kind = 'secret' AND source = 'history' THEN 'git-history' WHEN kind = 'secret' THEN 'secret-scanner' "
           "WHEN kind = 'sensitive-file' THEN 'sensitive-files' WHEN kind = 'code' THEN 'code-sast' WHEN kind = 'iac' THEN 'ci-iac' WHEN kind = 'dependency' THEN 'deps' ELSE 'license' END")
    dets = ", ".join(f"({q(d)})" for d in SC.DETECTORS)
    counted = f"NOT ({FIXTURE} AND (kind = 'code' OR (kind = 'secret' AND coalesce(source, 'tree') <> 'history')))"
    sev = lambda w: f"count(*) FILTER ({counted} AND CASE severity WHEN 'moderate' THEN 'medium' ELSE severity END = '{w}') AS {w}"
    first = "first_scans AS (SELECT user_id, min(scanned_at) AS fs FROM scans GROUP BY user_id)"
    eco = ", ".join(f"count(*) FILTER (kind = 'dependency' AND ecosystem = '{n}') AS {n.lower()}" for n in ["npm", "PyPI", "Go", "RubyGems", "Maven", "Packagist", "Container"])
    return {
        "agg_2_finding_scores": with_ctes(FIN, SCORED, select="SELECT ord, round(score, 6) AS score FROM s"),
        "agg_3_repo_scores": with_ctes(FIN, SCORED, BREAK, select="SELECT repo, scan_id, round(critical, 4) AS critical, round(high, 4) AS high, round(medium, 4) AS medium, round(low, 4) AS low, round(fixture, 4) AS fixture, risk_score, "
                                       "CASE WHEN 100 - risk_score >= 90 THEN 'Excellent' WHEN 100 - risk_score >= 70 THEN 'Good' WHEN 100 - risk_score >= 50 THEN 'Needs attention' ELSE 'Critical' END AS label FROM c"),
        "agg_5_severity_counts": with_ctes(FIN, select=f"SELECT repo, scan_id, {', '.join(map(sev, ['critical', 'high', 'medium', 'low']))}, count(*) FILTER ({counted}) AS total FROM f GROUP BY repo, scan_id"),
        "agg_7_category_rollup": with_ctes(FIN, f"r AS (SELECT *, {SEV_RANK} AS rk, CASE severity WHEN 'moderate' THEN 'medium' ELSE severity END AS s2 FROM f)",
                                           select="SELECT repo, scan_id, category, count(*) AS n, min(rk)::INTEGER AS worst_rank FROM r GROUP BY ALL"),
        "agg_15_detector_counts": with_ctes(FIN, f"d AS (SELECT repo, scan_id, {det} AS detector FROM f)", f"names(detector) AS (VALUES {dets})", "scan AS (SELECT DISTINCT repo, scan_id FROM f)",
                                            "cnt AS (SELECT repo, scan_id, detector, count(*) AS n FROM d GROUP BY ALL)",
                                            select="SELECT scan.repo, scan.scan_id, names.detector, coalesce(n, 0) AS n FROM scan CROSS JOIN names LEFT JOIN cnt ON cnt.repo = scan.repo AND cnt.scan_id = scan.scan_id AND cnt.detector = names.detector"),
        "top_1_worst_findings": with_ctes(FIN, SCORED, "r AS (SELECT *, row_number() OVER (PARTITION BY repo, scan_id ORDER BY score DESC, ord)::INTEGER AS rank FROM s)", select="SELECT repo, scan_id, rank, ord, round(score, 6) AS score FROM r WHERE rank <= 10"),
        "diff_1_fingerprints": with_ctes(FIN, FPS, select="SELECT ord, fp FROM p"),
        "diff_2_snapshot_diff": with_ctes(FIN, FPS, "a AS (SELECT * FROM p WHERE scan_id = 's0')", "b AS (SELECT * FROM p WHERE scan_id = 's1')",
                                          select="SELECT repo, ord, CASE WHEN EXISTS (SELECT 1 FROM a WHERE a.repo = b.repo AND a.fp = b.fp) THEN 'carried' ELSE 'new' END AS change FROM b UNION ALL SELECT repo, ord, 'resolved' FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE a.repo = b.repo AND a.fp = b.fp)"),
        "diff_2_score_delta": with_ctes(FIN, SCORED, BREAK, select="SELECT x.repo, x.scan_id AS from_scan, y.scan_id AS to_scan, y.risk_score - x.risk_score AS score_delta FROM c x JOIN c y ON x.repo = y.repo AND x.scan_id = 's0' AND y.scan_id = 's1'"),
        "diff_3_fleet_diff": with_ctes(FIN, FPS, "t AS (SELECT *, substr(scan_id, 2)::INTEGER AS n FROM p)", "k AS (SELECT DISTINCT repo, n, fp FROM t)", "ex AS (SELECT DISTINCT repo, n FROM t)",
                                       "r AS (SELECT repo, n, CASE WHEN EXISTS (SELECT 1 FROM k WHERE k.repo = t.repo AND k.n = t.n - 1 AND k.fp = t.fp) THEN 'carried' ELSE 'new' END AS change FROM t WHERE n > 0 UNION ALL "
                                       "SELECT t.repo, t.n + 1, 'resolved' FROM t JOIN ex ON ex.repo = t.repo AND ex.n = t.n + 1 WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.repo = t.repo AND k.n = t.n + 1 AND k.fp = t.fp))",
                                       select="SELECT repo, 's' || n AS scan_id, change, count(*) AS n FROM r GROUP BY repo, r.n, change"),
        "sup_1_ignore_files": ignore_files(),
        "sup_2_applied": with_ctes(*applied(), select="SELECT ord, expired, source_line FROM best"),
        "src_10_suppressions_left": with_ctes(STORED, select=f"SELECT id, user_id, path_glob FROM stored s WHERE NOT EXISTS (SELECT 1 FROM ({V.plain(V.DELETE_REQUESTS_SQL)}) d WHERE d.id = s.id AND d.user_id = s.user_id)"),
        "sup_3_suppressions_of_a_user": with_ctes(STORED, select="SELECT id, owner, path_glob FROM stored WHERE user_id = 'u1' AND owner = 'o3' AND repo = 'r'"),
        "sup_2_summary": with_ctes(*applied(), select="SELECT f.repo, f.scan_id, count(*) FILTER (best.rid IS NULL) AS kept, count(*) FILTER (best.rid IS NOT NULL) AS suppressed, count(DISTINCT source_line) FILTER (expired) AS expired_suppressions FROM f LEFT JOIN best ON best.rid = f.rid GROUP BY ALL"),
        "att_3_nodes": with_ctes(*creds(), "n AS (SELECT repo, scan_id, cid AS node_id, 'credential' AS node_kind, rule_name AS label, sv AS severity, ord FROM cr UNION ALL SELECT repo, scan_id, 'asset:' || bl.d, 'asset', bl.c, sv, ord FROM cr)",
                                 "r AS (SELECT *, row_number() OVER (PARTITION BY repo, scan_id, node_id ORDER BY ord) AS rn FROM n)", select="SELECT repo, scan_id, node_id, node_kind, label, severity FROM r WHERE rn = 1"),
        "att_3_edges": with_ctes(*creds(), select="SELECT repo, scan_id, cid AS from_id, 'asset:' || bl.d AS to_id, bl.c AS reason FROM cr"),
        "att_4_paths": paths(),
        "exp_1_sarif_shapes": with_ctes(FIN, SHAPES, select="SELECT ord, sarif_rule, level, message, uri, start_line FROM sh"),
        "agg_11_sarif_rules": with_ctes(FIN, SHAPES, "r AS (SELECT *, row_number() OVER (PARTITION BY repo, scan_id, sarif_rule ORDER BY ord) AS rn FROM sh)", select="SELECT repo, scan_id, sarif_rule, name, level FROM r WHERE rn = 1"),
        "snk_2_sarif_documents": with_ctes(FIN, SHAPES, select="SELECT repo, scan_id, count(*) AS results, count(DISTINCT sarif_rule) AS rules, 0::BIGINT AS undefined, count(*) FILTER (level = 'error') AS errors, count(*) FILTER (level = 'note') AS notes, "
                                           "count(start_line) AS lines, coalesce(sum(start_line), 0)::BIGINT AS line_sum, count(DISTINCT uri) AS uris, sum(length(message))::BIGINT AS message_chars FROM sh GROUP BY ALL"),
        "cat_2_resolved_rules": resolved(), "fix_0_fix_kinds": fix_kinds(),
        "dep_19_vuln_counts": with_ctes(FIN, select=f"SELECT repo, scan_id, {eco}, count(*) FILTER (kind = 'dependency') AS deps_count FROM f GROUP BY repo, scan_id"),
        "win_1_latest_scans": with_ctes(SCANS, "r AS (SELECT *, row_number() OVER (PARTITION BY user_id, owner, repo ORDER BY scanned_at DESC, id DESC) AS rn FROM scans)", select="SELECT user_id, owner, repo, id, scanned_at FROM r WHERE rn = 1"),
        "win_2_previous_scan": with_ctes(SCANS, select="SELECT id, lag(id) OVER w AS prev_id, lag(risk_score) OVER w AS prev_score FROM scans WINDOW w AS (PARTITION BY owner, repo ORDER BY scanned_at, id)"),
        "src_11_scan_history": with_ctes(SCANS, select="SELECT id, scanned_at FROM scans WHERE user_id = 'u1' ORDER BY scanned_at DESC, id LIMIT 50"),
        "sql_1_new_users": with_ctes(SCANS, first, select="SELECT fs::DATE AS day, count(*) AS new_users FROM first_scans GROUP BY 1"),
        "sql_2_scans_per_day": with_ctes(SCANS, select="SELECT scanned_at::DATE AS day, count(*) AS scans, count(DISTINCT user_id) AS distinct_users FROM scans GROUP BY 1"),
        "sql_3_active_users": with_ctes(SCANS, select=f"SELECT count(DISTINCT user_id) AS active_users_7d FROM scans WHERE scanned_at >= {now} - INTERVAL 7 DAY"),
        "sql_4_scans_per_user": with_ctes(SCANS, select=f"SELECT user_id, count(*) AS scans_last_7d FROM scans WHERE scanned_at >= {now} - INTERVAL 7 DAY GROUP BY 1"),
        "sql_5_retention": with_ctes(SCANS, first, "ret AS (SELECT DISTINCT f.user_id FROM first_scans f JOIN scans s ON s.user_id = f.user_id WHERE s.scanned_at::DATE <> f.fs::DATE AND s.scanned_at <= f.fs + INTERVAL 7 DAY)",
                                     select="SELECT (SELECT count(*) FROM first_scans) AS total_users, (SELECT count(*) FROM ret) AS retained_7d_users, round(100.0 * (SELECT count(*) FROM ret) / (SELECT count(*) FROM first_scans), 1)::DOUBLE AS retention_7d_pct"),
        "sql_6_top_repos": with_ctes(SCANS, select=f"SELECT owner || '/' || repo AS repository, count(*) AS scans, count(DISTINCT user_id) AS distinct_users FROM scans WHERE scanned_at >= {now} - INTERVAL 30 DAY GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20"),
        "sql_7_multi_repo_users": with_ctes(SCANS, select="SELECT count(*) AS pull_users_2plus_repos FROM (SELECT user_id FROM scans GROUP BY 1 HAVING count(DISTINCT owner || '/' || repo) >= 2)"),
        "sql_8_user_breakdown": with_ctes(SCANS, select="SELECT user_id, count(DISTINCT owner || '/' || repo) AS distinct_repos, count(*) AS total_scans, min(scanned_at) AS first_scan, max(scanned_at) AS last_scan FROM scans GROUP BY 1"),
        "sql_9_stable_ids": with_ctes(SCANS, select="SELECT CASE WHEN m.c_custkey IS NOT NULL THEN 'stable-' || m.c_custkey ELSE s.user_id END AS user_id, count(*) AS n FROM scans s LEFT JOIN customer m ON s.user_id = 'u' || m.c_custkey GROUP BY 1"),
    }
