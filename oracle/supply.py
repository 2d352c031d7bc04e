"""Check SQL of dependencies, advisories, licences, supply chain, posture, identity rules, call sites and patches."""

from __future__ import annotations

from fleetrisk.operators import deps as DP, licenses as LC, posture as PO, supply as SU
from fleetrisk.operators.deps import _NAME, _PINNED
from fleetrisk.plans import manifests as M, registry as R, snippets as S, views as V
from fleetrisk.plans.views import case_of
from fleetrisk.rules import calls as CR, iac as I
from oracle.base import LINES, any_rx, q, rx, snippet_files, with_ctes
from oracle.detectors import UPTO

NO = "FALSE AS is_transitive, FALSE AS is_dev"


def _lines(m: M.Manifest, select: str, *ctes: str) -> str:
    return with_ctes(m.sql(), LINES, *ctes, select=select)


def _deps(source: str, name: str, version: str, frm: str, where: str = "TRUE") -> str:
    return (f"SELECT * FROM (SELECT scan_id, {name} AS name, {version} AS version, {q(source)} AS source, {NO} FROM {frm} WHERE {where}) "
            "WHERE name <> '' AND version <> ''")


def package_json() -> str:
    v = "regexp_extract(spec, '\\d+(?:\\.\\d+){0,2}(?:-[A-Za-z0-9.-]+)?')"
    rows = (f"r AS (SELECT 'm' || o_orderkey AS scan_id, 'pkg' || ((o_orderkey * 3 + i) % 60) AS name, {case_of('i', M.OPS)} || (i % 4) || '.' || (o_orderkey % 7) || '.0' AS spec, FALSE AS is_dev "
            "FROM orders, unnest(range(1, 2 + o_orderkey % 4)) AS t(i) UNION ALL SELECT 'm' || o_orderkey, 'dev' || (o_orderkey % 9), '1.' || (o_orderkey % 3) || '.2', TRUE FROM orders)")
    return with_ctes(rows, select=f"SELECT scan_id, name, {v} AS version, 'package.json' AS source, FALSE AS is_transitive, is_dev FROM r")


LOCK = (f"r AS (SELECT 'm' || o_orderkey AS scan_id, 'pkg' || ((o_orderkey + i) % 50) AS name, i || '.' || (o_orderkey % 5) || '.0' AS version, (i + o_orderkey) % 2 = 1 AS is_transitive, "
        f"(o_orderkey + i * 2) % 3 = 1 AS is_dev, {case_of('o_orderkey + i', M.LICENSES)} AS license FROM orders, unnest(range(1, 2 + o_orderkey % 4)) AS t(i))")


LOCK_V1 = ("n AS (SELECT o_orderkey AS k, i FROM orders, unnest(range(1, 2 + o_orderkey % 3)) AS t(i)), "
           f"r AS (SELECT 'm' || k AS scan_id, 'top' || i || '-' || (k % 40) AS name, i || '.' || (k % 5) || '.0' AS version, FALSE AS is_transitive, {case_of('k + i', ['false', 'true'])} = 'true' AS is_dev FROM n "
           "UNION ALL SELECT 'm' || k, 'mid' || (k % 30), '2.' || i || '.0', TRUE, FALSE FROM n UNION ALL SELECT 'm' || k, 'deep', '3.0.' || (k % 3), TRUE, TRUE FROM n UNION ALL SELECT 'm' || k, '@s/leaf', '4.' || i || '.1', TRUE, FALSE FROM n)")


def requirements() -> str:
    body = "split_part(split_part(regexp_replace(trim(line), '\\s#.*$', ''), ';', 1), ' --hash=', 1)"
    return _lines(M.REQUIREMENTS, _deps("requirements.txt", f"lower(regexp_extract(b, {q('^(' + _NAME + ')')}, 1))",
                                        f"regexp_extract(regexp_replace(b, {q('^' + _NAME)}, ''), {q(_PINNED)}, 1)", "b"),
                  f"b AS (SELECT scan_id, {body} AS b FROM lines WHERE trim(line) <> '' AND NOT regexp_matches(trim(line), '^[#-]'))")


def _toml(m: M.Manifest, source: str, header: str, strip: str) -> list[str]:
    head = "CASE WHEN starts_with(line, '[') THEN line END"
    spec = "trim(regexp_extract(line, '=\\s*[\"'']([^\"'']+)[\"'']', 1))"
    v = f"regexp_extract(CASE WHEN starts_with({spec}, '==') THEN {spec} ELSE '==' || regexp_replace({spec}, {q(strip)}, '') END, {q(_PINNED)}, 1)"
    return [f"h AS (SELECT *, last_value({head} IGNORE NULLS) {UPTO} AS head FROM lines)",
            f"kv AS (SELECT scan_id, lower(regexp_extract(line, {q(f'^\\s*({_NAME})\\s*=')}, 1)) AS name, {v} AS version FROM h "
            f"WHERE regexp_matches(head, {q(header)}) AND NOT starts_with(line, '[') AND regexp_matches(line, {q(f'^\\s*{_NAME}\\s*=\\s*[\"\x27][^\"\x27]+[\"\x27]')}))"]


def pyproject() -> str:
    pep = ("pep AS (SELECT scan_id, unnest(regexp_extract_all(regexp_extract(content, '(?s)dependencies\\s*=\\s*\\[(.*?)\\]', 1), '\"([^\"]+)\"', 1)) AS i FROM files)")
    a = _deps("pyproject.toml", f"lower(regexp_extract(i, {q('^(' + _NAME + ')')}, 1))", f"regexp_extract(regexp_replace(i, {q('^' + _NAME)}, ''), {q(_PINNED)}, 1)", "pep")
    b = _deps("pyproject.toml", "name", "version", "kv", "name <> 'python'")
    return _lines(M.PYPROJECT, f"{a} UNION ALL {b}", pep, *_toml(M.PYPROJECT, "pyproject.toml", r"^\[tool\.poetry\.(?:dev-)?dependencies\]", r"^[\^~>=<!]+"))


def go_mod() -> str:
    st = "CASE WHEN starts_with(t, 'require (') THEN 1 WHEN t = ')' THEN 0 END"
    body = "trim(regexp_replace(regexp_replace(regexp_replace(t, '\\s+', ' ', 'g'), '^require ', ''), '//.*$', ''))"
    return _lines(M.GO_MOD, _deps("go.mod", "split_part(b, ' ', 1)", "regexp_replace(regexp_replace(split_part(b, ' ', 2), '^v', ''), '\\+incompatible$', '')", "g", "starts_with(split_part(b, ' ', 2), 'v')"),
                  "t AS (SELECT *, regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS t FROM lines)", f"s AS (SELECT *, last_value({st} IGNORE NULLS) {UPTO} AS st FROM t)",
                  f"g AS (SELECT scan_id, {body} AS b FROM s WHERE t <> '' AND NOT starts_with(t, '//') AND NOT starts_with(t, 'require (') AND ((st = 1 AND t <> ')') OR (coalesce(st, 0) = 0 AND starts_with(t, 'require '))))")


def gemfile() -> str:
    st = "CASE WHEN trim(line) = 'specs:' THEN 1 WHEN trim(line) = '' OR regexp_matches(line, '^[A-Z]') THEN 0 END"
    e = rf"^ {{4}}({_NAME}) \(([0-9][A-Za-z0-9._-]*)\)\s*$"
    return _lines(M.GEMFILE_LOCK, _deps("Gemfile.lock", f"regexp_extract(line, {q(e)}, 1)", f"regexp_extract(line, {q(e)}, 2)", "s", "st = 1"), f"s AS (SELECT *, last_value({st} IGNORE NULLS) {UPTO} AS st FROM lines)")


# What each picked line of the JVM manifests must yield.
POM_ROWS = [(0, "org.a:core", "1.0.1"), (4, "org.d:y", "2.3")]
GRADLE_ROWS = [(0, "com.x:lib", "1.2.3"), (1, "com.y:core", "2.0"), (2, "g:n", "3.1"), (6, "h:m", "4.0"), (7, "a:b", "1.0")]


def _per_line(m: M.Manifest, items: list[str], rows, source: str) -> str:
    vals = ", ".join(f"({q(items[i])}, {q(n)}, {q(v)})" for i, n, v in rows)
    return _lines(m, f"SELECT scan_id, name, version, {q(source)} AS source, {NO} FROM lines JOIN e ON e.l = lines.line", f"e(l, name, version) AS (VALUES {vals})")


def composer() -> str:
    v = f"regexp_replace({case_of('o_orderkey + i', ['v1.2.', '2.0.', 'dev-main', '3@'])} || i, '^v', '')"
    return (f"SELECT scan_id, name, version, 'composer.lock' AS source, {NO} FROM (SELECT 'm' || o_orderkey AS scan_id, 'vendor/p' || i AS name, {v} AS version FROM orders, unnest(range(1, 2 + o_orderkey % 3)) AS t(i) "
            "UNION ALL SELECT 'm' || o_orderkey, 'dev/d', '9.' || (o_orderkey % 4) FROM orders) WHERE NOT starts_with(version, 'dev-') AND NOT contains(version, '@')")


DEPS = "d0 AS (" + V.plain(V.DEPENDENCIES_SQL) + "), d AS (SELECT repo, ecosystem, name, version, min(source) AS source, bool_and(is_transitive) AS is_transitive, bool_and(is_dev) AS is_dev FROM d0 GROUP BY repo, ecosystem, name, version)"
ADV = "adv AS (" + V.plain(V.ADVISORIES_SQL) + ")"
_vl = lambda c: f"list_transform(string_split({c}, '.'), lambda x: x::INTEGER)"
IN_RANGE = f"(introduced = '0' OR {_vl('version')} >= {_vl('introduced')}) AND (fixed IS NULL OR {_vl('version')} < {_vl('fixed')})"
DB_SEV = "CASE lower(db_severity) WHEN 'critical' THEN 'critical' WHEN 'high' THEN 'high' WHEN 'moderate' THEN 'medium' ELSE 'low' END"


def osv() -> str:
    ghsa = "CASE WHEN id LIKE 'GHSA-%' THEN id WHEN id LIKE 'CVE-%' THEN 'GHSA-alias-' || id END"
    num = "TRY_CAST(cvss AS DOUBLE)"
    return with_ctes(DEPS, ADV, select=(
        f"SELECT repo, d.ecosystem, d.name AS package, version, id AS rule_id, CASE WHEN db_severity IS NOT NULL OR {num} IS NULL THEN {DB_SEV} WHEN {num} >= 9 THEN 'critical' WHEN {num} >= 7 THEN 'high' WHEN {num} >= 4 THEN 'medium' ELSE 'low' END AS severity, "
        f"{ghsa} AS ghsa, CASE WHEN introduced = '0' AND fixed IS NOT NULL THEN '< ' || fixed WHEN fixed IS NOT NULL THEN '>= ' || introduced || ', < ' || fixed ELSE '>= ' || introduced END AS vulnerable_versions, "
        f"CASE WHEN {ghsa} IS NOT NULL THEN 'https://github.com/advisories/' || {ghsa} ELSE 'https://pkg.go.dev/vuln/' || id END AS url, {num} AS cvss_score "
        f"FROM d JOIN adv ON d.ecosystem = adv.ecosystem AND d.name = adv.name WHERE d.ecosystem <> 'npm' AND {IN_RANGE}"))


RISK = {"GPL-3.0": "copyleft-strong", "LGPL-2.1": "copyleft-weak", "AGPL-3.0-only": "copyleft-strong", "MPL-2.0": "copyleft-weak", "GPL-2.0": "copyleft-strong",
        "GPL-3.0-only": "copyleft-strong", "UNLICENSED": "non-standard", "MPL-2.0 AND MIT": "copyleft-weak"}
RISK_CASE = "CASE {0} " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in RISK.items()) + " END"
LIC_SEV = "CASE license_risk WHEN 'copyleft-strong' THEN 'high' ELSE 'medium' END AS severity"


def npm_licenses() -> str:
    return with_ctes(LOCK, f"l AS (SELECT *, {RISK_CASE.format('license')} AS license_risk FROM r WHERE NOT is_dev)",
                     f"m AS (SELECT *, row_number() OVER (PARTITION BY scan_id, name, version ORDER BY is_transitive DESC) AS rn FROM l WHERE license_risk IS NOT NULL)",
                     select=f"SELECT scan_id, name AS package, version, license, license_risk, {LIC_SEV}, is_transitive FROM m WHERE rn = 1")


def registry_licenses() -> str:
    rank = "CASE {0} WHEN 'copyleft-strong' THEN 3 WHEN 'copyleft-weak' THEN 2 WHEN 'non-standard' THEN 1 ELSE 0 END"
    r1, r2 = RISK_CASE.format("l1"), RISK_CASE.format("l2")
    return with_ctes(
        DEPS, "p AS (" + V.plain(V.PACKAGE_LICENSES_SQL) + ")", "u AS (SELECT *, CASE WHEN ecosystem = 'Go' THEN 'v' || version ELSE version END AS v1 FROM d WHERE ecosystem <> 'npm')",
        "j AS (SELECT u.*, coalesce(a.l1, b.l1) AS l1, CASE WHEN a.l1 IS NOT NULL THEN a.l2 ELSE b.l2 END AS l2 FROM u LEFT JOIN p a ON a.ecosystem = u.ecosystem AND a.name = u.name AND a.version = u.v1 "
        "LEFT JOIN p b ON b.ecosystem = u.ecosystem AND b.name = u.name AND u.ecosystem = 'Go' AND split_part(u.version, '.', 1)::INTEGER >= 2 AND b.version = u.v1 || '+incompatible')",
        f"k AS (SELECT *, CASE WHEN {rank.format(f'({r1})')} >= {rank.format(f'({r2})')} THEN l1 ELSE l2 END AS pick FROM j WHERE l1 IS NOT NULL)",
        f"r AS (SELECT *, {RISK_CASE.format('pick')} AS license_risk FROM k)",
        select=f"SELECT repo, ecosystem, name AS package, version, CASE WHEN l2 IS NOT NULL THEN l1 || ', ' || l2 ELSE pick END AS license, license_risk, {LIC_SEV} FROM r WHERE license_risk IS NOT NULL")


def typosquats() -> str:
    return with_ctes(
        "pop AS (" + V.plain(M.POPULAR_SQL) + ")", f"n AS (SELECT 'm' || p_partkey AS scan_id, {M.MUTATED} AS name FROM part)",
        "x AS (SELECT DISTINCT n.name, pop.name AS target, rank, damerau_levenshtein(lower(n.name), lower(pop.name)) AS d FROM (SELECT DISTINCT name FROM n) n CROSS JOIN pop WHERE abs(length(n.name) - length(pop.name)) <= 2)",
        "e AS (SELECT DISTINCT name FROM x WHERE d = 0)",
        "c AS (SELECT name, target, rank, d, CASE WHEN d = 0 THEN 'case-fold' WHEN d = 1 THEN 'edit-distance-1' ELSE 'edit-distance-2-prefix' END AS pattern FROM x WHERE (d = 0 AND name <> target) OR (name NOT IN (SELECT name FROM e) AND (d = 1 OR (d = 2 AND substr(lower(name), 1, 3) = substr(target, 1, 3)))))",
        "b AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY d, rank, target) AS rn FROM c)",
        select="SELECT n.scan_id, n.name AS package, CASE pattern WHEN 'case-fold' THEN 'HIGH' WHEN 'edit-distance-1' THEN CASE WHEN rank <= 100 THEN 'HIGH' WHEN rank <= 1000 THEN 'MEDIUM' ELSE 'LOW' END ELSE CASE WHEN rank <= 100 THEN 'MEDIUM' ELSE 'LOW' END END AS severity, "
        "pattern, n.name || ' -> ' || target || ' (distance=' || d || ', ecosystem=pypi)' AS evidence FROM n JOIN b ON b.name = n.name AND rn = 1")


# What each derived install script must raise.
HOOKS = {1: [("HIGH", "pipe-to-shell")], 3: [("MEDIUM", "network-in-hook")], 4: [("LOW", "command-chain")], 5: [("HIGH", "decode-and-exec")], 6: [("HIGH", "env-exfil")], 7: [("MEDIUM", "network-in-hook")]}
HOOK_VALUES = ", ".join(f"({i}, {q(s)}, {q(p)})" for i, hs in HOOKS.items() for s, p in hs)
HOOK_ROWS = (f"hk(i, severity, pattern) AS (VALUES {HOOK_VALUES}), h AS (SELECT 'm' || o_orderkey AS scan_id, severity, pattern, 'hook=postinstall: ' || {case_of('o_orderkey', M.SCRIPTS)} AS evidence FROM orders JOIN hk ON o_orderkey % {len(M.SCRIPTS)} = hk.i)")
SIGNALS = ("reg AS (" + V.plain(V.REGISTRY_SQL) + "), nm AS (SELECT DISTINCT 'm' || o_orderkey AS scan_id, 'pkg' || ((o_orderkey * 3 + i) % 60) AS name FROM orders, unnest(range(1, 2 + o_orderkey % 4)) AS t(i)), "
           "sg AS (SELECT nm.scan_id, nm.name AS package, c.category, c.severity, c.pattern FROM nm JOIN reg USING (name), LATERAL (SELECT 'dependency-confusion' AS category, 'HIGH' AS severity, 'name-unpublished-on-public-registry' AS pattern WHERE status = 404 "
           f"UNION ALL SELECT 'recently-published', 'MEDIUM', 'package-recently-created' WHERE status = 200 AND created >= DATE {q(R.AS_OF)} - INTERVAL 30 DAY UNION ALL "
           "SELECT 'suspicious-maintainer', CASE WHEN deprecated THEN 'MEDIUM' ELSE 'LOW' END, CASE WHEN deprecated THEN 'package-deprecated' ELSE 'no-maintainers-listed' END WHERE status = 200 AND (deprecated OR n_maintainers = 0)) c)")


def python_hooks() -> str:
    cls = rf"^class\s+\w+\s*\(([^)]*)\)\s*:"
    hook = rf"regexp_extract(regexp_extract(line, {q(cls)}, 1), {q(r'\b(' + '|'.join(SU.PY_PARENTS) + r')\b')}, 1)"
    has = lambda k: rx("body", SU.PY_PATTERNS[k])
    high = f"({has('pipe')} OR ({has('eval')} AND {has('decode')}) OR ({has('env')} AND {has('net')}))"
    parts = [("HIGH", "pipe-to-shell", has("pipe")), ("HIGH", "decode-and-exec", f"{has('eval')} AND {has('decode')}"), ("HIGH", "env-exfil", f"{has('env')} AND {has('net')}"),
             ("MEDIUM", "network-in-hook", f"({has('net')} OR {has('shell_net')}) AND NOT {high}"), ("LOW", "command-chain", f"len(regexp_extract_all(body, {q(SU._SHELL)})) >= 4")]
    return _lines(
        M.SETUP_PY, " UNION ALL ".join(f"SELECT scan_id, {q(s)} AS severity, {q(p)} AS pattern, count(*) AS n FROM b WHERE {c} GROUP BY scan_id" for s, p, c in parts),
        f"o AS (SELECT *, {hook} AS hook FROM lines)", f"t AS (SELECT *, last_value(CASE WHEN regexp_matches(line, '^[A-Za-z_@]') THEN CASE WHEN hook <> '' THEN line_no ELSE 0 END END IGNORE NULLS) {UPTO} AS blk FROM o)",
        "b AS (SELECT scan_id, blk, string_agg(line, chr(10) ORDER BY line_no) AS body FROM t WHERE blk > 0 AND line_no > blk GROUP BY scan_id, blk)")


SET = "st AS (" + V.plain(V.SETTINGS_SQL) + ")"


def _signals() -> str:
    rs, bp = "has_rs", "has_bp"
    hid = "(branch_protected AND NOT has_bp AND NOT has_rs)"
    ok = {
        "branch-protection": ("branch_protected OR has_rs", "FALSE"), "branch-pr-required": (f"({bp} AND bp_pr) OR ({rs} AND rs_pr)", hid),
        "branch-status-checks": (f"({bp} AND bp_checks) OR ({rs} AND rs_checks)", hid), "branch-enforce-admins": (f"({bp} AND bp_admins) OR ({rs} AND coalesce(rs_nobypass, FALSE))", hid),
        "security-md": ("has_security_md", "FALSE"), "license": ("has_license", "FALSE"), "codeowners": ("has_codeowners", "FALSE"),
        "readme-substantial": ("length(coalesce(readme, '')) >= 500", "FALSE"), "readme-mentions-security": ("coalesce(readme, '') ILIKE '%security%'", "FALSE"),
        "auto-updates": ("has_dependabot_or_renovate", "FALSE"), "lockfile": ("has_lockfile", "FALSE"), "gitignore-basics": ("gitignore_kind IN (1, 2)", "FALSE"),
        "signed-commits": ("(has_rs AND rs_signed) OR coalesce(signed_commits_ratio >= 0.8, FALSE)", "NOT (has_rs AND rs_signed) AND signed_commits_ratio IS NULL"),
        "mfa-org": ("mfa_state = 'enforced'", "mfa_state IN ('na-user-repo', 'unknown')"), "secret-scanning": ("secret_scanning = 'enabled'", "secret_scanning = 'unknown'"),
        "workflow-permissions": ("workflow_perms = 'read'", "workflow_perms = 'unknown'"), "release-provenance": ("release_provenance = 'present'", "release_provenance = 'unknown'"),
    }
    parts = []
    for i, (s, cat, pts) in enumerate(PO.SIGNALS):
        good, unk = ok[s]
        half = "WHEN NOT (has_rs AND rs_signed) AND signed_commits_ratio >= 0.5 THEN 5 " if s == "signed-commits" else ""
        parts.append(f"SELECT repo, {i} AS ord, {q(s)} AS signal, {q(cat)} AS category, (CASE WHEN {good} THEN {pts} {half}ELSE 0 END)::INTEGER AS points_earned, {pts}::INTEGER AS points_max, {good} AS satisfied, {unk} AS unknown FROM st")
    return "sig AS (" + " UNION ALL ".join(parts) + ")"


def quick_wins() -> str:
    sub = ", ".join(q(s) for s in PO.SUB_SIGNALS)
    return with_ctes(SET, _signals(), "off AS (SELECT repo FROM sig WHERE signal = 'branch-protection' AND NOT satisfied)",
                     f"r AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY points_max DESC, ord)::INTEGER AS rank FROM sig WHERE NOT satisfied AND NOT unknown AND NOT (signal IN ({sub}) AND repo IN (SELECT repo FROM off)))",
                     select="SELECT repo, rank, signal, points_max AS points_available FROM r WHERE rank <= 5")


RULESETS = ("rl AS (SELECT 'org' || (c_custkey % 5) || '/svc' || (c_custkey % 50) AS repo, ['pull_request', 'required_status_checks', 'required_signatures', 'deletion'][c_custkey % 4 + 1] AS type, c_custkey % 25 AS rid, c_nationkey % 3 AS n_checks FROM customer), "
            "rs AS (SELECT rl.*, n_name AS name, n_nationkey % 3 > 0 AS vis, n_nationkey % 3 AS cnt, CASE WHEN n_nationkey % 2 = 0 THEN 'Team, App' ELSE 'unspecified' END AS who FROM rl JOIN nation ON rid = n_nationkey WHERE n_nationkey % 4 <> 0)")

# Marks of the derived action sets: grants PassRole, self-manages, assumes, full star, service stars, sensitive services, web identity, compute it creates.
ACTION_MARKS = [
    (1, 0, 0, 0, 0, "iam", 0, ""), (1, 1, 1, 1, 0, "", 0, "ec2:runinstances, ecs:runtask, glue:createjob, lambda:createfunction"), (1, 1, 0, 0, 1, "iam", 0, "ec2:runinstances"),
    (0, 0, 0, 0, 3, "kms", 0, "ec2:runinstances"), (0, 0, 0, 0, 0, "", 0, ""), (0, 1, 0, 0, 0, "iam", 0, ""), (0, 0, 0, 0, 0, "", 0, "lambda:createfunction"),
    (0, 0, 1, 0, 0, "sts", 0, ""), (0, 0, 0, 0, 0, "sts", 1, ""), (1, 0, 0, 0, 0, "iam, kms", 0, ""),
]


def _iam_ctes() -> list[str]:
    vals = ", ".join(f"({i}, {m[0]}, {m[1]}, {m[2]}, {m[3]}, {m[4]}, {q(m[5])}, {m[6]}, {q(m[7])})" for i, m in enumerate(ACTION_MARKS))
    return [
        f"mk(a, pr, sm, asr, fs, wide, svc, web, comp) AS (VALUES {vals})",
        "s0 AS (SELECT 'm' || o_orderkey AS scan_id, (i - 1)::INTEGER AS stmt_no, (o_orderkey + i) % 3 < 2 AS allow, (o_orderkey * 2 + i) % 7 = 6 AS neg, (o_orderkey + i * 3) % 10 AS a, (o_orderkey + i * 2) % 2 = 0 AS star, "
        "(o_orderkey + i * 5) % 5 AS p, (o_orderkey + i * 7) % 6 AS c FROM orders, unnest(range(1, 2 + o_orderkey % 3)) AS t(i))",
        "s AS (SELECT s0.*, mk.*, c IN (0, 4) AS nocond, allow AND NOT neg AS plain FROM s0 JOIN mk USING (a))",
        "cp AS (SELECT scan_id, string_agg(DISTINCT t, ', ' ORDER BY t) AS comp FROM (SELECT scan_id, unnest(string_split(comp, ', ')) AS t FROM s WHERE plain AND comp <> '') GROUP BY scan_id)",
        "r AS (SELECT scan_id, stmt_no, CASE WHEN nocond THEN 'iam-oidc-no-condition' WHEN c = 1 THEN 'iam-oidc-wildcard-repo' WHEN c = 2 THEN 'iam-oidc-pull-request-trust' WHEN c = 3 THEN 'iam-oidc-wildcard-ref' END AS rule_id, NULL AS detail "
        "FROM s WHERE allow AND web = 1 AND p = 3 AND c <> 5 UNION ALL SELECT scan_id, stmt_no, 'iam-passrole-wildcard', NULL FROM s WHERE plain AND pr = 1 AND star UNION ALL SELECT scan_id, stmt_no, 'iam-self-managing', NULL FROM s WHERE plain AND sm = 1 AND star "
        "UNION ALL SELECT scan_id, stmt_no, 'iam-assume-role-no-condition', NULL FROM s WHERE plain AND asr = 1 AND nocond AND (star OR p IN (1, 2)) UNION ALL SELECT scan_id, stmt_no, 'iam-not-action-allow', NULL FROM s WHERE allow AND neg "
        "UNION ALL SELECT scan_id, stmt_no, 'iam-action-resource-wildcard', NULL FROM s WHERE plain AND star AND (fs = 1 OR wide >= 3) UNION ALL SELECT scan_id, stmt_no, 'iam-sensitive-service-wildcard', svc FROM s WHERE plain AND star AND fs = 0 AND svc <> '' "
        "UNION ALL SELECT scan_id, stmt_no, 'iam-principal-wildcard', NULL FROM s WHERE allow AND p IN (1, 2) AND nocond UNION ALL SELECT s.scan_id, stmt_no, 'iam-passrole-with-create-compute', cp.comp FROM s JOIN cp USING (scan_id) WHERE plain AND pr = 1)",
        "rr AS (SELECT *, CASE WHEN rule_id IN ('iam-oidc-wildcard-ref', 'iam-assume-role-no-condition', 'iam-not-action-allow', 'iam-sensitive-service-wildcard') THEN 'high' ELSE 'critical' END AS severity FROM r)",
    ]


def call_rules() -> str:
    vals = ", ".join(f"({q(l)}, {q('ast/' + r)})" for l, rs in M.CALLS for r in rs)
    return with_ctes(snippet_files([c for c, _ in M.CALLS], [("src/f", ".ts"), ("tests/f", ".jsx")]), LINES, f"e(l, rule_id) AS (VALUES {vals})",
                     select="SELECT repo, path AS file_path, line_no, rule_id, starts_with(path, 'tests/') AS likely_test_fixture FROM lines JOIN e ON e.l = lines.line")


# The end-of-life FROM lines of the derived Dockerfiles that have a bump, and their result.
BUMPS = {"FROM node:14-alpine AS build": ("node:22-alpine", "FROM node:22-alpine AS build"), "FROM python:3.7": ("python:3.12", "FROM python:3.12"),
         "FROM registry.local:5000/team/ruby:2.7": ("registry.local:5000/team/ruby:3.3", "FROM registry.local:5000/team/ruby:3.3")}


def patches() -> str:
    vals = ", ".join(f"({q(k)}, {q(r)}, {q(n)})" for k, (r, n) in BUMPS.items())
    docker = snippet_files(S.DOCKER, R.DOCKER_PATHS).replace("files AS (", "dk AS (", 1)
    flows = snippet_files(S.WORKFLOW, R.WORKFLOW_PATHS, base=8, spread=9).replace("files AS (", "wf AS (", 1)
    ls = lambda t: f"(SELECT repo, path, content, unnest(range(1, len(ls) + 1))::INTEGER AS line_no, unnest(ls) AS line, ls FROM (SELECT *, string_split(content, chr(10)) AS ls FROM {t}))"
    swap = lambda new: f"md5(array_to_string(list_transform(range(1, len(ls) + 1), lambda i: CASE WHEN i = line_no THEN {new} ELSE ls[i] END), chr(10)))"
    return with_ctes(docker, flows, f"b(l, ref, new) AS (VALUES {vals})", select=(
        f"SELECT repo, path, 'dockerfile-baseimage-bump' AS fix_kind, 'Bump end-of-life base image to ' || ref AS summary, {swap('new')} AS patched, line_no FROM {ls('dk')} JOIN b ON b.l = line UNION ALL "
        f"SELECT repo, path, 'gha-permissions-fix', 'Replace permissions: write-all with least-privilege contents: read', {swap("regexp_extract(line, '^\\s*') || 'permissions:' || chr(10) || regexp_extract(line, '^\\s*') || '  contents: read'")}, line_no FROM {ls('wf')} WHERE {rx('line', I.GHA_WRITE_ALL.pattern)}"))


def dep_bumps() -> str:
    hit = lambda n: f"regexp_matches(trim(line), '(?i)^{n}\\s*==')"
    new = lambda n, keep: f"list_transform(string_split(content, chr(10)), lambda l: CASE WHEN regexp_matches(trim(l), '(?i)^{n}\\s*(==|>=|<=|!=|~=|<|>)') THEN '{keep}==9.9.1' ELSE l END)"
    part = lambda n, keep: (f"SELECT DISTINCT f.scan_id, '{n}' AS ord, 'Bump {n} to 9.9.1' AS summary, md5(array_to_string({new(n, keep)}, chr(10))) AS patched FROM files f JOIN lines l ON l.scan_id = f.scan_id AND {hit(n)}")
    # The pinned packages of the derived requirements files, as they are spelled there.
    pinned = ["Django", "requests", "numpy", "pandas", "PyYAML"]
    return with_ctes(M.REQUIREMENTS.sql(), LINES, select=" UNION ALL ".join(part(n.lower(), n) for n in pinned))


def sql() -> dict[str, str]:
    sup = with_ctes(HOOK_ROWS, SIGNALS, "a AS (SELECT scan_id, severity FROM h UNION ALL SELECT scan_id, severity FROM sg)",
                    "sc AS (SELECT o.scan_id, greatest(0, 100 - coalesce(sum(CASE severity WHEN 'HIGH' THEN 25 WHEN 'MEDIUM' THEN 10 WHEN 'LOW' THEN 3 END), 0))::INTEGER AS score, count(severity) AS n FROM (SELECT 'm' || o_orderkey AS scan_id FROM orders) o LEFT JOIN a ON a.scan_id = o.scan_id GROUP BY o.scan_id)",
                    select="SELECT scan_id, score, n, CASE WHEN score >= 90 THEN 'excellent' WHEN score >= 70 THEN 'good' WHEN score >= 50 THEN 'needs-attention' ELSE 'critical' END AS level FROM sc")
    return {
        "dep_1_package_json": package_json(),
        "dep_2_package_lock_v1": with_ctes(LOCK_V1, select="SELECT scan_id, name, version, 'package-lock.json' AS source, is_transitive, is_dev FROM r"),
        "dep_2_package_lock": with_ctes(LOCK, select="SELECT scan_id, name, version, 'package-lock.json' AS source, is_transitive, is_dev FROM r"),
        "dep_3_requirements": requirements(), "dep_4_pyproject": pyproject(),
        "dep_5_pipfile": _lines(M.PIPFILE, _deps("Pipfile", "name", "version", "kv"), *_toml(M.PIPFILE, "Pipfile", r"^\[(?:dev-)?packages\]", r"^[\^~>=<!*]+")),
        "dep_6_go_mod": go_mod(), "dep_7_gemfile_lock": gemfile(),
        "dep_8_pom": _per_line(M.POM, POM_ITEMS, POM_ROWS, "pom.xml"), "dep_8_gradle": _per_line(M.GRADLE, GRADLE_ITEMS, GRADLE_ROWS, "build.gradle"), "dep_9_composer": composer(),
        "dep_11_dedupe": with_ctes(DEPS, select="SELECT * FROM d"),
        "dep_12_npm_advisories": with_ctes(DEPS, ADV, select=f"SELECT repo, d.name AS package, version, {DB_SEV} AS severity, 'Flaw ' || id AS title, CASE WHEN id LIKE 'GHSA-%' THEN id END AS ghsa, is_transitive FROM d JOIN adv ON d.name = adv.name AND adv.ecosystem = 'npm' WHERE d.ecosystem = 'npm' AND {IN_RANGE}"),
        "dep_13_osv_advisories": osv(),
        "dep_20_degraded": with_ctes(DEPS, select="SELECT DISTINCT repo, 's1' AS scan_id, 'osv' AS detector, 'No advisory snapshot for Go; its vulnerabilities were not checked.' AS reason FROM d WHERE ecosystem = 'Go'"),
        "lic_2_npm_licenses": npm_licenses(), "lic_3_registry_licenses": registry_licenses(), "supc_2_typosquats": typosquats(),
        "supc_4_npm_hooks": with_ctes(HOOK_ROWS, select="SELECT scan_id, severity, pattern, evidence FROM h"), "supc_5_python_hooks": python_hooks(),
        "supc_6_registry_signals": with_ctes(SIGNALS, select="SELECT scan_id, category, severity, package, pattern FROM sg"), "supc_10_scores": sup,
        "pos_1_signals": with_ctes(SET, _signals(), select="SELECT repo, signal, points_earned, satisfied, unknown FROM sig"),
        "pos_8_scores": with_ctes(SET, _signals(), "sc AS (SELECT repo, CASE WHEN sum(points_max) FILTER (NOT unknown) > 0 THEN round(sum(points_earned) / (sum(points_max) FILTER (NOT unknown)) * 100) ELSE 100 END::INTEGER AS posture_score FROM sig GROUP BY repo)",
                                  select="SELECT repo, posture_score, CASE WHEN posture_score >= 90 THEN 'A' WHEN posture_score >= 75 THEN 'B' WHEN posture_score >= 60 THEN 'C' WHEN posture_score >= 40 THEN 'D' ELSE 'F' END AS posture_grade FROM sc"),
        "pos_8_breakdown": with_ctes(SET, _signals(), select="SELECT repo, category, sum(points_earned)::BIGINT AS points_earned, sum(points_max)::BIGINT AS points_max FROM sig GROUP BY ALL"),
        "iam_7_breakdown": with_ctes(*_iam_ctes(), "c AS (SELECT scan_id, CASE WHEN rule_id LIKE 'iam-oidc-%' THEN 'oidc' WHEN rule_id IN ('iam-action-resource-wildcard', 'iam-sensitive-service-wildcard', 'iam-principal-wildcard') THEN 'admin' ELSE 'privesc' END AS category, severity FROM rr)",
                                     "n(category) AS (VALUES ('oidc'), ('privesc'), ('admin'))",
                                     select="SELECT s.scan_id, n.category, count(c.severity) AS n, CASE WHEN bool_or(c.severity = 'critical') THEN 'critical' WHEN bool_or(c.severity = 'high') THEN 'high' END AS worst FROM (SELECT 'm' || o_orderkey AS scan_id FROM orders) s CROSS JOIN n LEFT JOIN c ON c.scan_id = s.scan_id AND c.category = n.category GROUP BY s.scan_id, n.category"),
        "supc_10_breakdown": with_ctes(HOOK_ROWS, SIGNALS, "a AS (SELECT scan_id, 'postinstall' AS category, severity FROM h UNION ALL SELECT scan_id, category, severity FROM sg)",
                                       "n(category) AS (VALUES " + ", ".join(f"({q(c)})" for c in SU.CATEGORIES) + ")",
                                       select="SELECT s.scan_id, n.category, greatest(0, 100 - coalesce(sum(CASE a.severity WHEN 'HIGH' THEN 25 WHEN 'MEDIUM' THEN 10 WHEN 'LOW' THEN 3 END), 0))::INTEGER AS score, count(a.severity) AS n, count(*) FILTER (a.severity = 'HIGH') AS high, count(*) FILTER (a.severity = 'MEDIUM') AS medium, count(*) FILTER (a.severity = 'LOW') AS low "
                                       "FROM (SELECT 'm' || o_orderkey AS scan_id FROM orders) s CROSS JOIN n LEFT JOIN a ON a.scan_id = s.scan_id AND a.category = n.category GROUP BY s.scan_id, n.category"),
        "pos_9_quick_wins": quick_wins(),
        "pos_6_rulesets": with_ctes(RULESETS, select="SELECT repo, bool_or(type = 'pull_request') AS pr_required, bool_or(type = 'required_status_checks' AND n_checks > 0) AS status_checks_required, bool_or(type = 'required_signatures') AS signed_commits_required, bool_and(cnt = 0) FILTER (vis) AS no_bypass_actors FROM rs GROUP BY repo"),
        "pos_6_bypass": with_ctes(RULESETS, select="SELECT repo, 'Rule ''' || type || ''' in ruleset ''' || name || ''' (branch ''main'') can be bypassed by ' || cnt || ' actor(s): ' || who || '.' AS description, count(*) AS n FROM rs WHERE vis AND cnt > 0 GROUP BY ALL"),
        "iam_1_12_statement_rules": with_ctes(*_iam_ctes(), select="SELECT scan_id, stmt_no, rule_id, severity, detail FROM rr"),
        "iam_s_scores": with_ctes(*_iam_ctes(), "k AS (SELECT scan_id, sum(CASE severity WHEN 'critical' THEN 20 ELSE 10 END) AS cost, count(*) AS n FROM rr GROUP BY scan_id)",
                                  "z AS (SELECT 'm' || o_orderkey AS scan_id, greatest(0, 100 - coalesce(cost, 0))::INTEGER AS iam_score, coalesce(n, 0) AS findings FROM orders LEFT JOIN k ON k.scan_id = 'm' || o_orderkey)",
                                  select="SELECT scan_id, iam_score, CASE WHEN iam_score >= 90 THEN 'low' WHEN iam_score >= 70 THEN 'medium' WHEN iam_score >= 50 THEN 'high' ELSE 'critical' END AS iam_level, findings FROM z"),
        "call_1_28_rules": call_rules(), "fix_2_3_patches": patches(), "fix_1_dependency_bumps": dep_bumps(),
    }


POM_ITEMS = M.POM_ITEMS
GRADLE_ITEMS = M.GRADLE_ITEMS
