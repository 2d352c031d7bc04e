"""Table schemas as DDL. Every operator takes and returns DataFrames shaped like these."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# One scan of one repository holds one version of a path, so these identify a file.
FILE_KEY = ["repo", "scan_id", "path"]

FILES = ("repo string, scan_id string, path string, size bigint, content string")

COMMITS = (
    "repo string, scan_id string, sha string, author_name string, author_date timestamp, "
    "committer_name string, committer_date timestamp, verified boolean, "
    "files array<struct<filename:string,status:string,patch:string>>"
)

DEPENDENCIES = (
    "repo string, scan_id string, ecosystem string, name string, version string, source string, "
    "is_transitive boolean, is_dev boolean"
)

NPM_ADVISORIES = (
    "package string, severity string, title string, vulnerable_versions string, url string, cvss_score double"
)

OSV_ADVISORIES = (
    "id string, summary string, details string, aliases array<string>, "
    "severity array<struct<type:string,score:string>>, "
    "database_specific struct<severity:string,cwe_ids:array<string>>, "
    "affected array<struct<package:struct<name:string,ecosystem:string>,"
    "ranges:array<struct<type:string,events:array<struct<introduced:string,fixed:string,last_affected:string>>>>,"
    "versions:array<string>>>, "
    "references array<struct<type:string,url:string>>"
)

PACKAGE_LICENSES = (
    "ecosystem string, name string, version string, licenses array<string>"
)

REGISTRY_META = (
    "name string, status int, created timestamp, maintainers array<string>, deprecated boolean"
)

POPULAR_PACKAGES = ("ecosystem string, name string, rank int")

SUPPRESSIONS = (
    "repo string, path_glob string, rule_glob string, reason string, expires date, source_line int"
)

SUPPRESSION_ROWS = (
    "id string, user_id string, owner string, repo string, path_glob string, rule_glob string, "
    "reason string, expires_at timestamp, created_at timestamp"
)

IAM_STATEMENTS = (
    "repo string, scan_id string, path string, stmt_no int, effect string, principal string, "
    "actions array<string>, resources array<string>, conditions string, source_line int, raw_snippet string"
)

REPO_SETTINGS = (
    "repo string, branch_protected boolean, "
    "bp_details struct<pr_required:boolean,status_checks_required:boolean,enforce_admins:boolean>, "
    "has_security_md boolean, has_license boolean, has_codeowners boolean, readme string, "
    "has_dependabot_or_renovate boolean, has_lockfile boolean, gitignore string, "
    "signed_commits_ratio double, mfa_state string, secret_scanning string, workflow_perms string, "
    "release_provenance string, "
    "ruleset struct<pr_required:boolean,status_checks_required:boolean,signed_commits_required:boolean,"
    "no_bypass_actors:boolean>, degraded boolean"
)

SCANS = (
    "id string, user_id string, owner string, repo string, scanned_at timestamp, duration_ms bigint, "
    "files_scanned int, secrets_count int, deps_count int, risk_score int, "
    "risk_breakdown struct<critical:double,high:double,medium:double,low:double,fixture:double>, "
    "suppressed_count int, posture_score int, posture_grade string, iam_score int, iam_level string"
)

# The wide nullable form of the tagged union: consumers branch on ``kind``.
FINDINGS = (
    "repo string, scan_id string, ord string, kind string, rule_id string, rule_name string, severity string, "
    "category string, cwe string, description string, remediation string, file_path string, line_no int, "
    "line_content string, likely_test_fixture boolean, source string, commit_sha string, "
    "commit_date timestamp, commit_author string, validation string, package string, version string, "
    "ecosystem string, title string, ghsa string, vulnerable_versions string, cvss_score double, "
    "url string, is_transitive boolean, is_dev boolean, license string, license_risk string"
)

FINDING_KINDS = ["secret", "code", "iac", "sensitive-file", "dependency", "license"]


def fields(ddl: str) -> list[tuple[str, str]]:
    """(name, type) pairs of a flat DDL string (no commas inside types)."""
    return [tuple(part.strip().split(" ", 1)) for part in ddl.split(",")]


def conform(df: DataFrame, ddl: str, **given: Column) -> DataFrame:
    """Project ``df`` onto a flat schema; columns it lacks become typed nulls, ``given`` wins."""
    have = set(df.columns)

    def pick(name: str, dtype: str) -> Column:
        col = given[name] if name in given else F.col(name) if name in have else F.lit(None)
        return col.cast(dtype).alias(name)

    return df.select(*[pick(*f) for f in fields(ddl)])


def as_findings(df: DataFrame, kind: str, **given: Column) -> DataFrame:
    """Rows of one detector as canonical findings of ``kind``."""
    return conform(df, FINDINGS, kind=F.lit(kind), **given)
