"""Derived tables as SQL text that both Spark and the check engine read.

``{table}`` names a driver table. These are inputs only; no operator logic lives here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fleetrisk.plans.derived import TABLES, dealt, table


def case_of(expr: str, items: list[str | None]) -> str:
    """The item at ``expr`` modulo their number."""
    arms = " ".join(f"WHEN {i} THEN " + ("CAST(NULL AS STRING)" if v is None else "'" + v.replace("'", "''") + "'") for i, v in enumerate(items))
    return f"(CASE ({expr}) % {len(items)} {arms} END)"


def repo(key: str) -> str:
    return f"CASE WHEN {key} % 3 = 0 THEN 'acme/mono' ELSE 'org' || ({key} % 5) || '/svc' || ({key} % 11) END"


KINDS = ["secret", "code", "iac", "sensitive-file", "dependency", "license"]
SECRET_IDS = ["aws-access-key", "github-pat", "stripe-live-secret", "entropy-high-secret", "private-key-block", "slack-token",
              "gcp-api-key", "openai-api-key", "unknown-token"]
CODE_IDS = ["js-eval", "js-xss-innerhtml", "py-pickle-loads", "sql-injection-template", "ai-empty-catch", "django-debug-true"]
IAC_IDS = ["tf-s3-public-acl", "k8s-privileged-container", "dockerfile-base-image-eol", "cfn-iam-wildcard-action",
           "gha-permissions-write-all", "iam-aws-wildcard-action", "helm-privileged"]
FILE_IDS = ["private-key", "env-generic", "database-dump"]
DIRS = ["src/", "routes/", "tests/", "app/api/", "docs/", "infra/"]
EXTS = [".ts", ".py", ".controller.js", ".tf", ".yml"]
SOURCES = ["package.json", "package-lock.json", "requirements.txt", "Pipfile", "go.mod", None]
LINES = ["const apiKey = 'sk_live_abcdefgh'", "password = 'hunter22'", "let x = compute()", "FROM node:14-alpine", "FROM centos:7",
         "permissions: write-all"]
RANGES = ["< 1.2.3", ">= 1.0.0, < 2.0.1", ">= 3.0.0", "unknown"]

_k = "l_partkey + l_linenumber"
_is = lambda *ks: f"({_k}) % 6 IN ({', '.join(str(KINDS.index(x)) for x in ks)})"
_when = lambda cond, val, typ="STRING": f"CASE WHEN {cond} THEN {val} ELSE CAST(NULL AS {typ}) END"

FINDINGS_SQL = f"""
SELECT {repo('l_suppkey')} AS repo, 's' || (l_orderkey % 4) AS scan_id,
  lpad(CAST(l_orderkey AS STRING), 10, '0') || '-' || l_linenumber || '-' || lpad(CAST(l_partkey AS STRING), 9, '0') || '-' || lpad(CAST(l_suppkey AS STRING), 6, '0') AS ord,
  {case_of(_k, KINDS)} AS kind,
  CASE ({_k}) % 6 WHEN 0 THEN {case_of('l_partkey', SECRET_IDS)} WHEN 1 THEN {case_of('l_partkey', CODE_IDS)}
    WHEN 2 THEN {case_of('l_partkey', IAC_IDS)} WHEN 3 THEN {case_of('l_partkey', FILE_IDS)} END AS rule_id,
  CASE ({_k}) % 6 WHEN 0 THEN 'Name of ' || {case_of('l_partkey', SECRET_IDS)} WHEN 1 THEN 'Name of ' || {case_of('l_partkey', CODE_IDS)}
    WHEN 2 THEN 'Name of ' || {case_of('l_partkey', IAC_IDS)} WHEN 3 THEN 'Name of ' || {case_of('l_partkey', FILE_IDS)} END AS rule_name,
  {case_of('l_partkey + l_suppkey', ['critical', 'high', 'medium', 'low', 'moderate'])} AS severity,
  {_when(_is('code', 'iac'), case_of('l_suppkey', ['xss', 'hardcoded-creds', 'terraform', 'dockerfile']))} AS category,
  {_when(_is('code') + ' AND l_linenumber % 2 = 0', case_of('l_partkey', ['CWE-79', 'CWE-95', 'CWE-502']))} AS cwe,
  {_when(_is('secret', 'code', 'iac', 'sensitive-file'), case_of('l_suppkey', DIRS) + " || 'f' || (l_partkey % 40) || " + case_of('l_orderkey', EXTS))} AS file_path,
  {_when(_is('secret', 'code', 'iac') + " AND NOT (" + _is('iac') + " AND l_linenumber = 3)", 'CAST(l_quantity AS INT) % 10 + 1', 'INT')} AS line_no,
  {_when(_is('secret', 'code', 'iac'), case_of('l_orderkey + l_partkey', LINES))} AS line_content,
  {_when(_is('secret', 'code', 'iac'), "l_returnflag = 'R'", 'BOOLEAN')} AS likely_test_fixture,
  CASE ({_k}) % 6 WHEN 0 THEN CASE WHEN l_linestatus = 'F' THEN 'history' ELSE 'tree' END
    WHEN 4 THEN {case_of('l_suppkey', SOURCES)} WHEN 5 THEN {case_of('l_suppkey', SOURCES)} END AS source,
  {_when(_is('secret') + " AND l_linestatus = 'F'", "'c' || (l_orderkey % 9)")} AS commit_sha,
  {_when(_is('secret'), case_of('l_orderkey', ['active', 'inactive', 'unverifiable', None]))} AS validation,
  {_when(_is('dependency', 'license'), "'pkg' || (l_partkey % 50)")} AS package,
  {_when(_is('dependency', 'license'), "(l_partkey % 4) || '.' || l_linenumber || '.0'")} AS version,
  {_when(_is('dependency', 'license'), case_of('l_suppkey', ['npm', 'PyPI', 'Go', 'Maven', 'Container']))} AS ecosystem,
  {_when(_is('dependency'), "'Flaw in pkg' || (l_partkey % 50)")} AS title,
  {_when(_is('dependency') + ' AND l_suppkey % 2 = 0', "'GHSA-' || (l_partkey % 100)")} AS ghsa,
  {_when(_is('dependency'), case_of('l_partkey', RANGES))} AS vulnerable_versions,
  {_when(_is('dependency', 'license'), "l_linestatus = 'O'", 'BOOLEAN')} AS is_transitive,
  {_when(_is('dependency'), 'l_orderkey % 5 = 0', 'BOOLEAN')} AS is_dev,
  {_when(_is('license'), case_of('l_partkey', ['GPL-3.0', 'LGPL-2.1', None]))} AS license,
  {_when(_is('license'), case_of('l_partkey', ['copyleft-strong', 'copyleft-weak', 'non-standard']))} AS license_risk
FROM {{lineitem}}
"""

SCANS_SQL = """
SELECT 'scan-' || lpad(CAST(event_id AS STRING), 12, '0') AS id, 'u' || user_id AS user_id, 'org' || (user_id % 5) AS owner,
  'svc' || (event_id % 7) AS repo, ts AS scanned_at, event_id % 1000 AS duration_ms,
  CASE WHEN event_type = 'error' THEN CAST(NULL AS INT) ELSE CAST(floor(value) AS INT) END AS risk_score, event_type
FROM {events}
"""

GLOBS = ["**", "src/**", "tests/*", "**/*.tf", "package.json", "src/f1.ts", "routes/f?.py", "infra/f[1-3].yml", "*.md", "app/**/f7.*", "requirements.txt",
         "docs/f*"]
RULE_GLOBS = [None, "code/*", "secret/aws-*", None, "iac/terraform", "dependency/pkg1*", "license/**", None, "code/cwe-79", "dependency/GHSA-1?",
              "dependency/pkg7/GHSA-*"]

SUPPRESSIONS_SQL = f"""
SELECT {repo('c_custkey')} AS repo, {case_of('c_custkey', GLOBS)} AS path_glob, {case_of('c_custkey', RULE_GLOBS)} AS rule_glob,
  'reason ' || c_custkey AS reason,
  CASE WHEN c_custkey % 4 = 0 THEN CAST(NULL AS DATE) ELSE DATE '2025-01-01' + CAST(c_custkey % 300 AS INT) END AS expires,
  CAST(c_custkey AS INT) AS source_line
FROM {{customer}}
"""

# Suppressions as users stored them, and requests to delete some, a part of them by others than the owner.
STORED_SUPPRESSIONS_SQL = f"""
SELECT CAST(c_custkey AS STRING) AS id, 'u' || CAST(c_custkey % 5 AS STRING) AS user_id, 'o' || CAST(c_nationkey AS STRING) AS owner, 'r' AS repo, {case_of('c_custkey', GLOBS)} AS path_glob,
  TIMESTAMP '2025-01-01 00:00:00' AS created_at
FROM {{customer}}
"""
DELETE_REQUESTS_SQL = "SELECT DISTINCT CAST(o_custkey AS STRING) AS id, 'u' || CAST(o_custkey % 5 + CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END AS STRING) AS user_id FROM {orders} WHERE o_orderkey % 40 < 3"

# Dependencies, advisories and licence rows over shared package names.
DEPENDENCIES_SQL = f"""
SELECT {repo('l_suppkey')} AS repo, 's1' AS scan_id, {case_of('l_partkey', ['npm', 'PyPI', 'Go', 'RubyGems'])} AS ecosystem,
  'pkg' || (l_partkey % 200) AS name, (l_partkey % 4) || '.' || (l_linenumber * 3) || '.' || (l_partkey % 12) AS version,
  {case_of('l_partkey', ['package-lock.json', 'requirements.txt', 'go.mod', 'Gemfile.lock'])} AS source,
  l_linestatus = 'O' AS is_transitive, l_returnflag = 'R' AS is_dev
FROM {{lineitem}}
"""

ADVISORIES_SQL = f"""
SELECT 'pkg' || (p_partkey % 200) AS name, {case_of('p_partkey', ['npm', 'PyPI', 'Go', 'RubyGems'])} AS ecosystem,
  CASE WHEN p_partkey % 3 = 0 THEN 'GHSA-' || p_partkey WHEN p_partkey % 3 = 1 THEN 'GO-' || p_partkey ELSE 'CVE-' || p_partkey END AS id,
  CASE WHEN p_partkey % 4 = 0 THEN '0' ELSE (p_size % 3) || '.' || (p_size % 7) || '.0' END AS introduced,
  CASE WHEN p_size % 5 = 0 THEN CAST(NULL AS STRING) ELSE (p_size % 3 + 1) || '.' || (p_size % 9) || '.' || (p_partkey % 5) END AS fixed,
  {case_of('p_partkey', ['CRITICAL', 'HIGH', 'MODERATE', None])} AS db_severity,
  {case_of('p_size', ['9.8', '7.0', '4.2', 'CVSS:3.1/AV:N', None])} AS cvss
FROM {{part}}
"""

PACKAGE_LICENSES_SQL = f"""
SELECT ecosystem, name, version, l1, l2 FROM (
  SELECT DISTINCT {case_of('p_partkey', ['npm', 'PyPI', 'Go', 'RubyGems'])} AS ecosystem, 'pkg' || (p_partkey % 200) AS name,
    CASE WHEN p_partkey % 4 = 2 THEN 'v' || (p_partkey % 4) || '.' || ((p_size % 7 + 1) * 3) || '.' || (p_partkey % 12) || CASE WHEN p_size % 2 = 0 THEN '+incompatible' ELSE '' END
      ELSE (p_partkey % 4) || '.' || ((p_size % 7 + 1) * 3) || '.' || (p_partkey % 12) END AS version,
    {case_of('p_partkey % 200', ['GPL-3.0', 'MIT', 'LGPL-2.1', 'Apache-2.0', 'AGPL-3.0-only', 'MPL-2.0'])} AS l1,
    {case_of('p_partkey % 200', ['MIT', None, 'GPL-2.0', None, 'BSD-3-Clause'])} AS l2 FROM {{part}}) t
"""

SETTINGS_SQL = f"""
SELECT 'org' || (c_custkey % 5) || '/svc' || c_custkey AS repo, c_custkey % 2 = 0 AS branch_protected,
  c_custkey % 4 < 2 AS has_bp, c_custkey % 3 = 0 AS bp_pr, c_custkey % 5 = 0 AS bp_checks, c_custkey % 7 = 0 AS bp_admins,
  c_custkey % 6 = 0 AS has_rs, c_custkey % 4 = 1 AS rs_pr, c_custkey % 5 = 2 AS rs_checks, c_custkey % 9 = 0 AS rs_signed,
  CASE c_custkey % 3 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END AS rs_nobypass,
  c_nationkey % 2 = 0 AS has_security_md, c_nationkey % 3 = 0 AS has_license, c_nationkey % 5 = 0 AS has_codeowners,
  CASE WHEN c_custkey % 8 = 0 THEN CAST(NULL AS STRING) ELSE repeat('readme ', CAST(c_custkey % 100 AS INT)) || CASE WHEN c_custkey % 3 = 0 THEN 'Security notes' ELSE '' END END AS readme,
  c_custkey % 3 = 1 AS has_dependabot_or_renovate, c_custkey % 4 <> 3 AS has_lockfile, c_custkey % 5 AS gitignore_kind,
  CASE WHEN c_acctbal < 0 THEN CAST(NULL AS DOUBLE) ELSE (c_custkey % 11) / 10.0 END AS signed_commits_ratio,
  {case_of('c_custkey', ['enforced', 'not-enforced', 'na-user-repo', 'unknown'])} AS mfa_state,
  {case_of('c_nationkey', ['enabled', 'disabled', 'unknown'])} AS secret_scanning,
  {case_of('c_custkey', ['read', 'write', 'unknown'])} AS workflow_perms,
  {case_of('c_nationkey + c_custkey', ['present', 'absent', 'unknown'])} AS release_provenance
FROM {{customer}}
"""
GITIGNORES = [None, "node_modules/\n.env\n", "/node_modules\n.env.*\ndist", "dist\n.env", "node_modules"]

REGISTRY_SQL = """
SELECT 'pkg' || (p_partkey % 60) AS name, CAST(max(CASE WHEN p_partkey % 60 % 7 = 0 THEN 404 WHEN p_partkey % 60 % 11 = 0 THEN 500 ELSE 200 END) AS INT) AS status,
  max(CASE WHEN p_partkey % 60 % 4 = 0 THEN TIMESTAMP '2025-05-20 00:00:00' ELSE TIMESTAMP '2020-01-01 00:00:00' END) AS created,
  CAST(max(p_partkey % 60 % 3) AS INT) AS n_maintainers, max(p_partkey % 60) % 5 = 0 AS deprecated
FROM {part} GROUP BY p_partkey % 60
"""


#: Keys that the large tables are dealt by.
KEYS = {"lineitem": "l_orderkey", "events": "event_id", "customer": "c_custkey", "part": "p_partkey"}


def wide(df: DataFrame) -> bool:
    """Whether a table is read in as many parts as the session has cores, or more."""
    return df.rdd.getNumPartitions() >= df.sparkSession.sparkContext.defaultParallelism


def view(spark: SparkSession, sf_dir: str, sql: str, moved: bool = False) -> DataFrame:
    """Run one of the texts above on the tables of ``sf_dir``. Large tables are dealt by their key first; not if the query moves every row
    by itself next (``moved``) and the table is read in many parts: each row would be written twice."""
    used = {t: table(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in sql}
    used = {t: dealt(df, KEYS[t]) if t in KEYS and not (moved and wide(df)) else df for t, df in used.items()}
    return spark.sql(sql, **used)


def plain(sql: str) -> str:
    """The same text with bare table names."""
    return sql.format(**{t: t for t in TABLES})
