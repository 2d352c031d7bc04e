"""Named queries over the driver's tables, one per operator family."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from fleetrisk.functions import paths as P, severity as sev, text
from fleetrisk.operators import (
    attack, calls, catalog, deps, diff, fix, gates, iac, iam, licenses, posture, sarif, sast, score, secrets, sensitive,
    supply, suppress,
)
from fleetrisk.plans import analytics as A, derived as D, fleet_scan, manifests as M, snippets as S, views as V
from fleetrisk.operators.lines import explode_lines
from fleetrisk.plans.materialise import materialise
from fleetrisk.schemas import FINDINGS, conform
from fleetrisk.sources import tables
from fleetrisk.streaming import incremental, quota

AS_OF = "2025-06-01"
DOC_ENTROPY = 3.0
DOCKER_PATHS = [("d", "/Dockerfile"), ("svc/d", ".dockerfile"), ("e", "/Dockerfile.prod")]
WORKFLOW_PATHS = [(".github/workflows/f", ".yml"), (".github/workflows/g", ".yaml")]
TERRAFORM_PATHS = [("infra/f", ".tf"), ("vars/f", ".tfvars")]
CFN_PATHS = [("stack/f", ".yaml"), ("stack/f", ".json"), ("stack/f", ".yml")]
K8S_PATHS = [("k8s/f", ".yaml"), ("deploy/f", ".yml")]
HELM_PATHS = [("chart", "/values.yaml"), ("chart/values-", ".yml")]
IAM_POLICY_PATHS = [("iam/f", ".json"), ("iam/f", ".ts"), ("iam/f", ".tf"), ("iam/f", ".md"), ("iam/f", ".yaml")]
CODE_PATHS = [("src/f", ".ts"), ("src/f", ".py"), ("routes/f", ".js"), ("tests/f", ".py"), ("pkg/f", ".go")]
FRAMEWORK_PATHS = [("src/f", ".ts"), ("src/f", ".py"), ("src/f", ".java"), ("conf/f", ".properties"), ("f", ".php"), ("f", ".rb")]

# Manifests of the derived repositories: repository number modulo the list length.
FRAMEWORK_MANIFESTS = [
    ("package.json", '{"dependencies": {"express": "^4.0.0", "@nestjs/core": "10.0.0"}}'),
    ("requirements.txt", "Django==4.2\nflask==2.0\n"),
    ("pom.xml", "<artifactId>spring-boot-starter</artifactId>"),
    ("composer.json", '{"require": {"laravel/framework": "^10"}}'),
    ("Gemfile", "source 'x'\ngem 'rails'\n"),
    ("pyproject.toml", "[project]\ndependencies = [\"fastapi\"]\n"),
]
FRAMEWORKS_OF = [["express", "nestjs"], ["django", "flask"], ["spring"], ["laravel"], ["rails"], ["fastapi"]]
ORACLE_FRAMEWORKS = (
    "fw AS (SELECT DISTINCT CASE WHEN c_custkey % 3 = 0 THEN 'acme/mono' ELSE 'org' || (c_custkey % 5) || '/svc' || (c_custkey % 11) END AS repo, "
    f"unnest(({FRAMEWORKS_OF!r})[c_custkey % {len(FRAMEWORKS_OF)} + 1]) AS framework FROM customer)"
)

Query = Callable[[SparkSession, str], DataFrame]


def manifest_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Framework manifests, one per customer."""
    k = F.col("c_custkey")
    c = D.table(spark, sf_dir, "customer")
    return c.select(
        D.repo_of(k).alias("repo"), F.lit("s1").alias("scan_id"),
        F.concat(F.lit("m"), (k % 6).cast("string"), F.lit("/"), D.pick([n for n, _ in FRAMEWORK_MANIFESTS], k)).alias("path"),
        F.lit(10).cast("bigint").alias("size"), D.pick([t for _, t in FRAMEWORK_MANIFESTS], k).alias("content"),
    )


def _out(df: DataFrame, *more: str) -> DataFrame:
    return df.select("repo", "file_path", "line_no", "rule_id", "severity", *more)


def _snip(items, paths, op, base: int = 3, spread: int = 5) -> Query:
    return lambda spark, sf: _out(op(D.snippet_files(spark, sf, items, paths, base=base, spread=spread)))


def path_facts(spark: SparkSession, sf: str) -> DataFrame:
    f = D.snippet_files(spark, sf, [""], S.SCAN_PATHS + S.SENSITIVE_PATHS)
    p = F.col("path")
    return f.select(
        "repo", p.alias("file_path"), gates.is_scannable(p, F.col("size")).alias("scannable"),
        P.is_test_like(p).alias("test_like"), P.is_public_route(p).alias("public_route"), P.language(p).alias("lang"),
        gates.file_class(p).alias("file_class"), gates.priority_tier(p).alias("tier"), P.in_prefix(p, "src/").alias("in_src"),
    )


def file_priority(spark: SparkSession, sf: str) -> DataFrame:
    f = D.snippet_files(spark, sf, [""], S.SCAN_PATHS).where(gates.is_scannable(F.col("path"), F.col("size")))
    return gates.prioritized(f).select("repo", F.col("path").alias("file_path"), "tier")


def framework_query(spark: SparkSession, sf: str) -> DataFrame:
    f = D.snippet_files(spark, sf, S.JS + S.PY + S.OTHER_CODE, FRAMEWORK_PATHS)
    return _out(sast.framework_rules(f, sast.detect_frameworks(manifest_files(spark, sf))))


def detector_queries() -> dict[str, Query]:
    code = S.JS + S.PY
    return {
        "flt_path_facts": path_facts,
        "flt_coverage": lambda spark, sf: gates.scan_coverage(D.snippet_files(spark, sf, [""], S.SCAN_PATHS)).drop("scan_id"),
        "top_2_file_priority": file_priority,
        "sfn_1_sensitive_files": lambda spark, sf: sensitive.sensitive_files(
            D.snippet_files(spark, sf, [""], S.SENSITIVE_PATHS)).select("repo", "file_path", "rule_id", "severity"),
        "sec_1_token_secrets": lambda spark, sf: _out(secrets.token_secrets(D.token_files(spark, sf, S.SCAN_PATHS)), "line_content"),
        "sec_3_entropy_secrets": lambda spark, sf: secrets.entropy_secrets(D.document_files(spark, sf), DOC_ENTROPY).select(
            "repo", "file_path", "line_no", "severity", "line_content"),
        "sast_1_code_vulns": _snip(code, CODE_PATHS, sast.code_vulns),
        "biz_1_business_logic": _snip(code, CODE_PATHS, sast.business_logic),
        "ai_1_scaffold_tells": _snip(code, CODE_PATHS, sast.scaffold_tells),
        "fw_3_framework_rules": framework_query,
        "iac_d_dockerfile": _snip(S.DOCKER, DOCKER_PATHS, iac.dockerfile),
        "iac_e_base_images": _snip(S.DOCKER, DOCKER_PATHS, lambda f: iac.eol_base_images(f, F.lit(AS_OF).cast("date"))),
        "iac_g_github_actions": _snip(S.WORKFLOW, WORKFLOW_PATHS, iac.github_actions, 8, 9),
        "iac_t_terraform": _snip(S.TERRAFORM, TERRAFORM_PATHS, iac.terraform, 8, 9),
        "iac_c_cloudformation": _snip(S.CLOUDFORMATION, CFN_PATHS, iac.cloudformation, 6, 7),
        "iac_k_kubernetes": _snip(S.KUBERNETES, K8S_PATHS, iac.kubernetes, 10, 9),
        "iac_h_helm_values": _snip(S.HELM, HELM_PATHS, iac.helm_values),
        "iac_p_iam_policies": _snip(S.IAM_POLICY, IAM_POLICY_PATHS, iac.iam_policies, 5, 6),
    }


# Whole texts of the given tables as source files: (key, text, extension).
REAL_TEXTS = {"pages": (["page_id"], "html", "src/page_", ".js"), "conversations": (["conv_id", "turn"], "text", "src/conv_", ".py"), "documents": (["doc_id"], "text", "src/doc_", ".py")}


def real_files(spark: SparkSession, sf: str, name: str) -> DataFrame:
    keys, text, head, tail = REAL_TEXTS[name]
    path = F.concat(F.lit(head), F.concat_ws("_", *[F.col(k).cast("string") for k in keys]), F.lit(tail))
    content = F.coalesce(text, F.lit(""))
    return D.table(spark, sf, name).select(F.lit(f"web/{name}").alias("repo"), F.lit("s1").alias("scan_id"), path.alias("path"), F.length(content).cast("bigint").alias("size"), content.alias("content"))


def _real_tokens(name: str) -> Query:
    return lambda spark, sf: secrets.token_secrets(real_files(spark, sf, name)).groupBy("rule_id", "severity").agg(F.count(F.lit(1)).alias("n"))


def _real_code(name: str) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        f = real_files(spark, sf, name)
        return sast.code_vulns(f).unionByName(sast.scaffold_tells(f)).select("file_path", "line_no", "rule_id", "severity")
    return run


def real_text_queries() -> dict[str, Query]:
    return {**{f"sec_1_real_{n}": _real_tokens(n) for n in REAL_TEXTS}, **{f"sast_1_real_{n}": _real_code(n) for n in REAL_TEXTS}}


def findings(spark: SparkSession, sf: str, moved: bool = False) -> DataFrame:
    return conform(V.view(spark, sf, V.FINDINGS_SQL, moved), FINDINGS)


def _on_findings(op) -> Query:
    return lambda spark, sf: op(findings(spark, sf))


def _on_scans(op) -> Query:
    return lambda spark, sf: op(V.view(spark, sf, V.SCANS_SQL))


def _now():
    return F.lit("2024-01-25 00:00:00").cast("timestamp")


def _breakdown(f: DataFrame) -> DataFrame:
    b = score.breakdown(f, f)
    parts = ["critical", "high", "medium", "low", "fixture"]
    return b.select("repo", "scan_id", *[F.round(p, 4).alias(p) for p in parts], "risk_score",
                    score.health_label(F.col("risk_score")).alias("label"))


def _snapshots(f: DataFrame) -> tuple[DataFrame, DataFrame]:
    return f.where("scan_id = 's0'"), f.where("scan_id = 's1'")


def _fleet_diff(f: DataFrame) -> DataFrame:
    n = F.substr("scan_id", F.lit(2)).cast("int")
    pairs = f.select("repo", "scan_id").distinct().withColumn(
        "prev_scan_id", F.when(n > 0, F.concat(F.lit("s"), (n - 1).cast("string"))))
    return diff.fleet_diff(f, pairs).groupBy("repo", "scan_id", "change").agg(F.count(F.lit(1)).alias("n"))


def _score_delta(f: DataFrame) -> DataFrame:
    b, a = _snapshots(f)
    return diff.score_delta(score.breakdown(b), score.breakdown(a))


def applied(spark: SparkSession, sf: str) -> DataFrame:
    as_of = F.lit("2025-06-01 12:00:00").cast("timestamp")
    return suppress.apply(findings(spark, sf), V.view(spark, sf, V.SUPPRESSIONS_SQL), as_of)


def _sarif_totals(f: DataFrame) -> DataFrame:
    """Results, rules, levels and locations counted back out of the written documents."""
    d = sarif.documents(f, parts=16).withColumn("j", F.from_json(
        "document", "runs array<struct<tool:struct<driver:struct<rules:array<struct<id:string,name:string>>>>,results:array<struct<ruleId:string,level:string,"
        "message:struct<text:string>,locations:array<struct<physicalLocation:struct<artifactLocation:struct<uri:string>,region:struct<startLine:int>>>>>>>>"))
    run = d.select("repo", "scan_id", F.col("j.runs")[0].alias("run"))
    # Counted within each document first, so that only a few numbers and names of a document move.
    def place(r):
        return r["locations"][0]["physicalLocation"]

    def count(cond):
        return F.size(F.filter("run.results", cond)).cast("bigint")

    ids = F.transform("run.tool.driver.rules", lambda x: x["id"])
    per = run.select(
        "repo", "scan_id", F.size("run.results").cast("bigint").alias("results"), ids.alias("rules"), F.array_except(F.transform("run.results", lambda r: r["ruleId"]), ids).alias("undefined"),
        count(lambda r: r["level"] == "error").alias("errors"), count(lambda r: r["level"] == "note").alias("notes"), count(lambda r: place(r)["region"]["startLine"].isNotNull()).alias("lines"),
        F.aggregate("run.results", F.lit(0).cast("bigint"), lambda x, r: x + F.coalesce(place(r)["region"]["startLine"], F.lit(0))).alias("line_sum"),
        F.array_distinct(F.transform("run.results", lambda r: place(r)["artifactLocation"]["uri"])).alias("uris"),
        F.aggregate("run.results", F.lit(0).cast("bigint"), lambda x, r: x + F.length(r["message"]["text"])).alias("message_chars"))
    names = lambda c: F.size(F.array_distinct(F.flatten(F.collect_set(c)))).cast("bigint").alias(c)
    return per.groupBy("repo", "scan_id").agg(*[F.sum(c).alias(c) for c in ("results", "errors", "notes", "lines", "line_sum", "message_chars")], names("rules"), names("undefined"), names("uris"))


IGNORE_LINES = ["src/** [rule=code/*]", "tests/*", "# a comment", "", "package.json [rule=dependency/lodash] [reason=\"not reachable\"] [expires=2026-01-31]",
                "docs/a.md [expires=2026-02-30]", "  *.tf\t[reason=soon]", "[rule=x]", "lib/x.js [rule=\"code/js eval\"]"]


def _ignore_files(spark: SparkSession, sf: str) -> DataFrame:
    f = D.snippet_files(spark, sf, IGNORE_LINES, [("", "")]).withColumn("path", F.lit(suppress.IGNORE_FILE))
    return suppress.parse_ignore_files(f).groupBy("repo", "path_glob", "rule_glob", "reason", "expires", "source_line").agg(
        F.count(F.lit(1)).alias("n"))


def _resolved(f: DataFrame) -> DataFrame:
    s = sarif.shapes(f).withColumn("catalog_id", catalog.resolve(F.col("sarif_rule")))
    return s.groupBy("sarif_rule", "catalog_id").agg(F.count(F.lit(1)).alias("n"))


def finding_queries() -> dict[str, Query]:
    return {
        "agg_2_finding_scores": _on_findings(lambda f: score.scored(f).select("ord", F.round("score", 6).alias("score"))),
        "agg_3_repo_scores": _on_findings(_breakdown),
        "agg_5_severity_counts": _on_findings(lambda f: score.severity_counts(f, f)),
        "agg_7_category_rollup": _on_findings(lambda f: score.category_rollup(f).select(
            "repo", "scan_id", "category", "n", sev.rank(F.col("worst")).alias("worst_rank"))),
        "agg_15_detector_counts": _on_findings(lambda f: score.detector_counts(f, f)),
        "top_1_worst_findings": _on_findings(lambda f: score.top_findings(f, 10).select(
            "repo", "scan_id", "rank", "ord", F.round("score", 6).alias("score"))),
        "diff_1_fingerprints": _on_findings(lambda f: f.select("ord", diff.fingerprint().alias("fp"))),
        "diff_2_snapshot_diff": _on_findings(lambda f: diff.diff(*_snapshots(f)).select("repo", "ord", "change")),
        "diff_2_score_delta": _on_findings(_score_delta),
        "diff_3_fleet_diff": _on_findings(_fleet_diff),
        "sup_1_ignore_files": _ignore_files,
        "sup_2_applied": lambda spark, sf: applied(spark, sf).where("suppressed").select(
            "ord", "expired", F.col("suppressed_by.source_line").alias("source_line")),
        "src_10_suppressions_left": lambda spark, sf: suppress.delete_rows(V.view(spark, sf, V.STORED_SUPPRESSIONS_SQL), V.view(spark, sf, V.DELETE_REQUESTS_SQL)).select("id", "user_id", "path_glob"),
        "sup_3_suppressions_of_a_user": lambda spark, sf: suppress.list_rows(V.view(spark, sf, V.STORED_SUPPRESSIONS_SQL), "u1", "o3", "r").select("id", "owner", "path_glob"),
        "sup_2_summary": lambda spark, sf: suppress.summary(applied(spark, sf)),
        "att_3_nodes": _on_findings(attack.nodes), "att_3_edges": _on_findings(attack.edges),
        "att_4_paths": _on_findings(lambda f: attack.paths(f).select(
            "repo", "scan_id", "path_id", "title", "severity", F.array_join("steps", " | ").alias("steps"), "live")),
        "exp_1_sarif_shapes": _on_findings(lambda f: sarif.shapes(f).select("ord", "sarif_rule", "level", "message", "uri", "start_line")),
        "agg_11_sarif_rules": _on_findings(lambda f: sarif.rules(sarif.shapes(f)).drop("about")),
        "snk_2_sarif_documents": lambda spark, sf: _sarif_totals(findings(spark, sf, moved=True)),
        "cat_2_resolved_rules": _on_findings(_resolved),
        "fix_0_fix_kinds": _on_findings(lambda f: f.withColumn("fix_kind", fix.fix_kind()).where("fix_kind is not null").select("ord", "fix_kind")),
        "dep_19_vuln_counts": _on_findings(deps.vuln_counts),
        "win_1_latest_scans": _on_scans(lambda s: diff.latest_scans(s).select("user_id", "owner", "repo", "id", "scanned_at")),
        "win_2_previous_scan": _on_scans(lambda s: diff.previous_scan(s).select("id", "prev_id", "prev_score")),
        "src_11_scan_history": _on_scans(lambda s: diff.scan_history(s, "u1").select("id", "scanned_at")),
        "sql_1_new_users": _on_scans(A.new_users_per_day), "sql_2_scans_per_day": _on_scans(A.scans_per_day),
        "sql_3_active_users": _on_scans(lambda s: A.active_users(s, _now())),
        "sql_4_scans_per_user": _on_scans(lambda s: A.scans_per_user(s, _now())),
        "sql_5_retention": _on_scans(A.retention), "sql_6_top_repos": _on_scans(lambda s: A.top_repos(s, _now())),
        "sql_7_multi_repo_users": _on_scans(A.multi_repo_users), "sql_8_user_breakdown": _on_scans(A.user_breakdown),
        "sql_9_stable_ids": lambda spark, sf: A.stabilise_ids(
            V.view(spark, sf, V.SCANS_SQL), D.table(spark, sf, "customer").select(
                F.concat(F.lit("u"), F.col("c_custkey").cast("string")).alias("legacy_id"),
                F.concat(F.lit("stable-"), F.col("c_custkey").cast("string")).alias("user_id"))
        ).groupBy("user_id").agg(F.count(F.lit(1)).alias("n")),
    }


def _manifest(m: M.Manifest, op) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return op(m.files(spark, sf)).select("scan_id", "name", "version", "source", "is_transitive", "is_dev")
    return run


def dependencies(spark: SparkSession, sf: str) -> DataFrame:
    return V.view(spark, sf, V.DEPENDENCIES_SQL)


def osv_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    """Derived advisories in the nested form of the public dump."""
    a = V.view(spark, sf, V.ADVISORIES_SQL).where("ecosystem <> 'npm'")
    t = "cast(null as string)"
    event = lambda i, f: f"named_struct('introduced', {i}, 'fixed', {f}, 'last_affected', {t})"
    events = f"if(fixed is null, array({event('introduced', t)}), array({event('introduced', t)}, {event(t, 'fixed')}))"
    return a.selectExpr(
        "id", f"{t} as summary", f"if(id like 'CVE-%', array('X-1', concat('GHSA-alias-', id)), cast(array() as array<string>)) as aliases",
        "if(cvss is null, null, array(named_struct('type', 'CVSS_V3', 'score', cvss))) as severity",
        "named_struct('severity', db_severity, 'cwe_ids', cast(array() as array<string>)) as database_specific",
        f"array(named_struct('package', named_struct('name', name, 'ecosystem', ecosystem), 'ranges', array(named_struct('type', 'SEMVER', 'events', {events})), "
        "'versions', cast(array() as array<string>))) as affected", "cast(array() as array<struct<type:string,url:string>>) as references")


def npm_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    a = V.view(spark, sf, V.ADVISORIES_SQL).where("ecosystem = 'npm'")
    return a.selectExpr("name as package", "db_severity as severity", "concat('Flaw ', id) as title",
                        "concat('>=', if(introduced = '0', '0.0.0', introduced), coalesce(concat(' <', fixed), '')) as vulnerable_versions",
                        "concat('https://github.com/advisories/', id) as url", "cast(null as double) as cvss_score")


def license_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    return V.view(spark, sf, V.PACKAGE_LICENSES_SQL).selectExpr("ecosystem", "name", "version", "array_compact(array(l1, l2)) as licenses")


def registry_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    return V.view(spark, sf, V.REGISTRY_SQL).selectExpr(
        "name", "status", "created", "if(n_maintainers = 0, cast(array() as array<string>), array('m')) as maintainers", "deprecated")


def settings(spark: SparkSession, sf: str) -> DataFrame:
    s = V.view(spark, sf, V.SETTINGS_SQL)
    return s.select(
        "repo", "branch_protected",
        F.when(F.col("has_bp"), F.struct(F.col("bp_pr").alias("pr_required"), F.col("bp_checks").alias("status_checks_required"),
                                         F.col("bp_admins").alias("enforce_admins"))).alias("bp_details"),
        F.when(F.col("has_rs"), F.struct(F.col("rs_pr").alias("pr_required"), F.col("rs_checks").alias("status_checks_required"),
                                         F.col("rs_signed").alias("signed_commits_required"), F.col("rs_nobypass").alias("no_bypass_actors"))).alias("ruleset"),
        "has_security_md", "has_license", "has_codeowners", "readme", "has_dependabot_or_renovate", "has_lockfile",
        F.element_at(F.array(*[F.lit(g) for g in V.GITIGNORES]), (F.col("gitignore_kind") + 1).cast("int")).alias("gitignore"),
        F.col("signed_commits_ratio").cast("double").alias("signed_commits_ratio"), "mfa_state", "secret_scanning", "workflow_perms", "release_provenance")


def rulesets(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    c = D.table(spark, sf, "customer")
    rules = c.selectExpr(
        "concat('org', c_custkey % 5, '/svc', c_custkey % 50) as repo", "'main' as branch",
        "element_at(array('pull_request', 'required_status_checks', 'required_signatures', 'deletion'), cast(c_custkey % 4 + 1 as int)) as type",
        "c_custkey % 25 as ruleset_id", "cast(c_nationkey % 3 as int) as n_checks")
    sets = D.table(spark, sf, "nation").selectExpr(
        "cast(n_nationkey as bigint) as id", "n_name as name", "if(n_nationkey % 4 = 0, 'disabled', 'active') as enforcement", "n_nationkey % 3 > 0 as bypass_visible",
        "if(n_nationkey % 2 = 0, array('Team', 'Team', 'App'), cast(array() as array<string>)) as bypass_actor_types", "cast(n_nationkey % 3 as int) as bypass_count")
    return rules, sets


def _iam(spark: SparkSession, sf: str) -> DataFrame:
    return iam.iam_findings(iam.iam_statements(M.IAM_POLICY.files(spark, sf)))


def _supply(spark: SparkSession, sf: str) -> DataFrame:
    f = M.PACKAGE_JSON.files(spark, sf)
    return supply.npm_hooks(f).unionByName(supply.registry_signals(f, registry_snapshot(spark, sf), F.lit(AS_OF).cast("timestamp")))


def _patches(spark: SparkSession, sf: str) -> DataFrame:
    docker = D.snippet_files(spark, sf, S.DOCKER, DOCKER_PATHS)
    flows = D.snippet_files(spark, sf, S.WORKFLOW, WORKFLOW_PATHS, base=8, spread=9)
    eol = iac.eol_base_images(docker, F.lit(AS_OF).cast("date"))
    all_f = eol.unionByName(iac.github_actions(flows)).withColumn("ord", F.concat_ws("|", "file_path", F.col("line_no").cast("string"), "rule_id"))
    p = fix.patches(all_f, docker.unionByName(flows))
    return p.select("repo", "path", "fix_kind", "summary", F.md5("patched").alias("patched"), F.regexp_extract("ord", r"\|(\d+)\|", 1).cast("int").alias("line_no"))


def _dep_bumps(spark: SparkSession, sf: str) -> DataFrame:
    """Bumps of the advisories found in the derived requirements files."""
    files = M.REQUIREMENTS.files(spark, sf)
    d = deps.requirements_txt(files).dropDuplicates(["scan_id", "name", "version"])
    f = conform(d, FINDINGS, kind=F.lit("dependency"), package=F.col("name"), vulnerable_versions=F.lit(">= 1.0.0, < 9.9.1"), ord=F.col("name"))
    return fix.patches(f, files).select("scan_id", "ord", "summary", F.md5("patched").alias("patched"))


def dependency_queries() -> dict[str, Query]:
    return {
        "dep_1_package_json": _manifest(M.PACKAGE_JSON, deps.package_json), "dep_2_package_lock": _manifest(M.PACKAGE_LOCK, deps.package_lock),
        "dep_2_package_lock_v1": _manifest(M.PACKAGE_LOCK_V1, deps.package_lock),
        "dep_3_requirements": _manifest(M.REQUIREMENTS, deps.requirements_txt), "dep_4_pyproject": _manifest(M.PYPROJECT, deps.pyproject_toml),
        "dep_5_pipfile": _manifest(M.PIPFILE, deps.pipfile), "dep_6_go_mod": _manifest(M.GO_MOD, deps.go_mod),
        "dep_7_gemfile_lock": _manifest(M.GEMFILE_LOCK, deps.gemfile_lock), "dep_8_pom": _manifest(M.POM, deps.pom_xml),
        "dep_8_gradle": _manifest(M.GRADLE, deps.gradle), "dep_9_composer": _manifest(M.COMPOSER, deps.composer_lock),
        "dep_11_dedupe": lambda spark, sf: deps.dedupe(dependencies(spark, sf)).drop("scan_id"),
        "dep_12_npm_advisories": lambda spark, sf: deps.npm_findings(deps.dedupe(dependencies(spark, sf)), npm_snapshot(spark, sf)).select(
            "repo", "package", "version", "severity", "title", "ghsa", "is_transitive"),
        "dep_13_osv_advisories": lambda spark, sf: deps.osv_findings(deps.dedupe(dependencies(spark, sf)), osv_snapshot(spark, sf)).select(
            "repo", "ecosystem", "package", "version", "rule_id", "severity", "ghsa", "vulnerable_versions", "url", "cvss_score"),
        "dep_20_degraded": lambda spark, sf: deps.degraded(dependencies(spark, sf), V.view(spark, sf, V.ADVISORIES_SQL).where("ecosystem <> 'Go'").withColumn("detector", F.lit("osv"))),
        "lic_2_npm_licenses": lambda spark, sf: licenses.npm_licenses(M.PACKAGE_LOCK.files(spark, sf)).select(
            "scan_id", "package", "version", "license", "license_risk", "severity", "is_transitive"),
        "lic_3_registry_licenses": lambda spark, sf: licenses.registry_licenses(dependencies(spark, sf), license_snapshot(spark, sf)).select(
            "repo", "ecosystem", "package", "version", "license", "license_risk", "severity"),
        "supc_2_typosquats": lambda spark, sf: supply.typosquats(M.TYPO.files(spark, sf), V.view(spark, sf, M.POPULAR_SQL)).select(
            "scan_id", "package", "severity", "pattern", "evidence"),
        "supc_4_npm_hooks": lambda spark, sf: supply.npm_hooks(M.PACKAGE_JSON.files(spark, sf)).select("scan_id", "severity", "pattern", "evidence"),
        "supc_5_python_hooks": lambda spark, sf: supply.python_hooks(M.SETUP_PY.files(spark, sf)).groupBy("scan_id", "severity", "pattern").agg(F.count(F.lit(1)).alias("n")),
        "supc_6_registry_signals": lambda spark, sf: supply.registry_signals(M.PACKAGE_JSON.files(spark, sf), registry_snapshot(spark, sf), F.lit(AS_OF).cast("timestamp")).select(
            "scan_id", "category", "severity", "package", "pattern"),
        "supc_10_scores": lambda spark, sf: supply.supply_scores(_supply(spark, sf), M.PACKAGE_JSON.files(spark, sf)).select("scan_id", "score", "n", "level"),
        "pos_1_signals": lambda spark, sf: posture.posture_signals(settings(spark, sf)).drop("ord", "points_max", "category"),
        "pos_8_scores": lambda spark, sf: posture.posture_scores(posture.posture_signals(settings(spark, sf))),
        "pos_8_breakdown": lambda spark, sf: posture.posture_breakdown(posture.posture_signals(settings(spark, sf))),
        "iam_7_breakdown": lambda spark, sf: iam.iam_breakdown(_iam(spark, sf), M.IAM_POLICY.files(spark, sf)).drop("repo"),
        "supc_10_breakdown": lambda spark, sf: supply.supply_breakdown(_supply(spark, sf), M.PACKAGE_JSON.files(spark, sf)).drop("repo"),
        "pos_9_quick_wins": lambda spark, sf: posture.quick_wins(posture.posture_signals(settings(spark, sf))),
        "pos_6_rulesets": lambda spark, sf: posture.ruleset_rollup(*rulesets(spark, sf)),
        "pos_6_bypass": lambda spark, sf: posture.bypass_findings(*rulesets(spark, sf)).groupBy("repo", "description").agg(F.count(F.lit(1)).alias("n")),
        "iam_1_12_statement_rules": lambda spark, sf: _iam(spark, sf).select("scan_id", "stmt_no", "rule_id", "severity", "detail"),
        "iam_s_scores": lambda spark, sf: iam.iam_scores(_iam(spark, sf), M.IAM_POLICY.files(spark, sf)).drop("repo"),
        "call_1_28_rules": lambda spark, sf: calls.call_rules(calls.call_sites(D.snippet_files(spark, sf, [c for c, _ in M.CALLS], [("src/f", ".ts"), ("tests/f", ".jsx")]))).select(
            "repo", "file_path", "line_no", "rule_id", "likely_test_fixture"),
        "fix_2_3_patches": _patches, "fix_1_dependency_bumps": _dep_bumps,
    }


def document_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Whole documents: token and entropy secrets, scored, summed, labelled and ranked, for every repository."""
    files = D.document_files(spark, sf)
    found = score.flatten({"secrets": secrets.token_secrets(files).unionByName(secrets.entropy_secrets(files, DOC_ENTROPY))})
    ranked = score.breakdown(found, files).orderBy(F.desc("risk_score"), "repo")
    return ranked.select(
        "repo", "findings", F.round(F.col("high"), 4).alias("high"), F.round(F.col("medium"), 4).alias("medium"), "risk_score",
        score.health_label(F.col("risk_score")).alias("label"))


def _fleet(spark: SparkSession, sf: str) -> DataFrame:
    """A mixed fleet through the whole scan; findings counted per kind and rule."""
    from functools import reduce
    parts = [D.snippet_files(spark, sf, S.JS + S.PY, CODE_PATHS), D.snippet_files(spark, sf, S.DOCKER, DOCKER_PATHS),
             D.snippet_files(spark, sf, S.TERRAFORM, TERRAFORM_PATHS, base=8, spread=9), D.token_files(spark, sf, S.SCAN_PATHS),
             M.PACKAGE_LOCK.files(spark, sf), M.REQUIREMENTS.files(spark, sf)]
    files = materialise(reduce(lambda a, b: a.unionByName(b), parts))
    snap = fleet_scan.Snapshots(npm_advisories=npm_snapshot(spark, sf), osv_advisories=osv_snapshot(spark, sf), package_licenses=license_snapshot(spark, sf))
    return fleet_scan.findings(files, snap, F.lit(AS_OF).cast("date")).groupBy("kind", "rule_id", "severity").agg(F.count(F.lit(1)).alias("n"))


def _fleet_reports(spark: SparkSession, sf: str) -> DataFrame:
    """Identity and supply-chain scores of a mixed fleet through the whole scan."""
    files = M.IAM_POLICY.files(spark, sf).unionByName(M.PACKAGE_JSON.files(spark, sf))
    r = fleet_scan.reports(files, fleet_scan.Snapshots(registry_meta=registry_snapshot(spark, sf)), F.lit(AS_OF).cast("date"))
    i, s = r["identity_scores"].drop("findings"), r["supply_scores"].withColumnsRenamed({"score": "supply_score", "level": "supply_level"}).drop("n")
    return i.join(s, ["repo", "scan_id"]).drop("repo")


def _fleet_health(spark: SparkSession, sf: str) -> DataFrame:
    """Dependencies of a mixed fleet for which there is no advisory snapshot."""
    files = M.REQUIREMENTS.files(spark, sf).unionByName(M.PACKAGE_LOCK.files(spark, sf))
    small = fleet_scan.small_files(files)
    return fleet_scan.health(small, fleet_scan.Snapshots(npm_advisories=npm_snapshot(spark, sf))).groupBy("detector", "reason", "ord").agg(F.count(F.lit(1)).alias("n"))


PATCH_LINES = ["@@ -1,4 +10,6 @@ def", "+const a = 'ghp_{36}'", " context", "-const b = 'ghp_{36}'", "+++ b/x", "--- a/x", "+key = sk_live_{32}",
               "@@ -40 +70,2 @@", "\\ No newline at end of file", "+plain", "+url: postgres://admin:{12}@db:5432/app", ""]


def commits(spark: SparkSession, sf: str) -> DataFrame:
    """One commit per order, its patch made of the lines above; a third belong to one repository."""
    k = F.col("o_orderkey")
    hexed = F.concat(F.md5((k % 40).cast("string")), F.md5((k % 40 + 1).cast("string")))
    text = D.snippet_text(PATCH_LINES, k, 5, 7)
    for n in (12, 32, 36):
        text = F.replace(text, F.lit("{%d}" % n), F.substring(hexed, 1, n))
    o = D.dealt(D.table(spark, sf, "orders").select("o_orderkey", "o_orderdate"), "o_orderkey")
    patch = F.struct(F.concat(F.lit("src/f"), (k % 6).cast("string"), F.lit(".ts")).alias("filename"), F.lit("modified").alias("status"), text.alias("patch"))
    return o.select(D.repo_of(k).alias("repo"), F.lit("s1").alias("scan_id"), F.concat(F.lit("c"), k.cast("string")).alias("sha"),
                    F.lit("dev").alias("author_name"), F.col("o_orderdate").alias("author_date"), F.lit(None).cast("string").alias("committer_name"),
                    F.lit(None).cast("timestamp").alias("committer_date"), (k % 4 != 0).alias("verified"), F.array(patch).alias("files"))


def history(spark: SparkSession, sf: str) -> DataFrame:
    """History secrets minus those the tree still holds."""
    k = F.col("o_orderkey")
    held = D.table(spark, sf, "orders").select("o_orderkey").select(
        D.repo_of(k).alias("repo"), F.lit("s1").alias("scan_id"), F.concat(F.lit("src/f"), (k % 6).cast("string"), F.lit(".ts")).alias("path"), F.lit(10).cast("bigint").alias("size"),
        F.when(k % 4 == 0, F.concat(F.lit("const a = 'ghp_"), F.substring(F.concat(F.md5((k % 40).cast("string")), F.md5((k % 40 + 1).cast("string"))), 1, 36), F.lit("'"))).otherwise("x = 1").alias("content"))
    tree = secrets.token_secrets(held)
    return secrets.history_secrets(commits(spark, sf), tree).select("repo", "file_path", "line_no", "rule_id", "line_content", "commit_sha")


def rate_events(spark: SparkSession, sf: str) -> DataFrame:
    return D.table(spark, sf, "events").select(
        F.when(F.col("user_id") % 3 == 0, "u-hot").otherwise(F.concat(F.lit("u"), F.col("user_id").cast("string"))).alias("key"), "ts")


def scan_events(spark: SparkSession, sf: str) -> DataFrame:
    return D.table(spark, sf, "events").select("ts", (F.col("event_type") != "error").alias("ok"), (F.col("event_type") == "view").alias("degraded"), F.col("value").alias("duration_ms"))


def stream_queries() -> dict[str, Query]:
    return {
        "sec_4_added_lines": lambda spark, sf: secrets.added_lines(commits(spark, sf)).select("sha", "path", "line_no", "line"),
        "sec_5_history_secrets": history,
        "pos_4_signed_ratio": lambda spark, sf: posture.signed_ratio(commits(spark, sf)).select("repo", "scan_id", F.round("signed_commits_ratio", 6).alias("ratio")),
        "str_1_quota": lambda spark, sf: quota.quota(rate_events(spark, sf), quota.Policy(3)).drop("id"),
        "str_4_event_counters": lambda spark, sf: incremental.event_counters(scan_events(spark, sf)).withColumn("mean_ms", F.round("mean_ms", 4)),
    }


PRESENCE_PATHS = [("", p) for ps in posture.PRESENCE.values() for p in ps] + [("src/x", ".ts")]


def _presence(spark: SparkSession, sf: str) -> DataFrame:
    """Presence flags of derived repositories; the key in the path is dropped so names are exact."""
    f = D.snippet_files(spark, sf, S.WORKFLOW, PRESENCE_PATHS).withColumn("path", F.regexp_replace("path", r"^\d+", ""))
    flows = D.snippet_files(spark, sf, S.WORKFLOW + ["      attestations: write"], WORKFLOW_PATHS)
    key = F.concat("repo", F.lit("-"), F.pmod(F.length("content"), F.lit(97)).cast("string"))
    g = posture.file_signals(f.unionByName(flows).withColumn("repo", key))
    return g.select("repo", "scan_id", *posture.PRESENCE, "release_provenance")


def misc_queries() -> dict[str, Query]:
    def binary(spark, sf):
        d = D.table(spark, sf, "documents").withColumn("text", F.when(F.col("doc_id") % 2 == 0, F.replace("text", F.lit(" "), F.lit("\u0001"))).otherwise(F.col("text")))
        return d.select("doc_id", gates.looks_binary(F.col("text")).alias("is_binary"))

    def identifiers(spark, sf):
        p = F.regexp_replace("url", r"^https?://[^/]+/?", "")
        ref = F.regexp_replace(p, r"[?#].*$", "")
        return D.table(spark, sf, "pages").select("page_id", gates.is_safe_repo_path(p).alias("path_ok"), gates.is_safe_git_ref(ref).alias("ref_ok"),
                                                  gates.is_safe_owner_repo(F.substring_index(ref, "/", 1)).alias("owner_ok"))

    def urls(spark, sf):
        u = F.regexp_replace("url", r"^(https?://)[^/]+", "$1github.com")
        u = F.when(F.col("page_id") % 3 == 0, F.regexp_replace(u, "^https?://", "")).when(F.col("page_id") % 7 == 0, F.col("url")).otherwise(u)
        return D.table(spark, sf, "pages").select("page_id", tables.repo_from_url(u).alias("repo"))

    def self_refs(spark, sf):
        f = D.snippet_files(spark, sf, S.JS, [("src/f", ".ts")])
        l = explode_lines(f).withColumn("pos", F.explode(F.expr("filter(sequence(1, length(line)), p -> length(line) > 0 and substring(line, p, 1) = 'e')")))
        return l.select("repo", "path", "line_no", "pos", text.self_reference(F.col("line"), F.col("pos")).alias("self_reference"))

    return {
        "flt_3_binary": binary, "flt_10_self_reference": self_refs, "flt_12_identifiers": identifiers, "sf_7_repo_urls": urls,
        "sf_1_entropy": lambda spark, sf: D.table(spark, sf, "documents").select(
            "doc_id", F.round(text.shannon_entropy(F.col("text")), 6).alias("entropy")),
        "fw_2_frameworks": lambda spark, sf: sast.detect_frameworks(manifest_files(spark, sf)).select("repo", "framework"),
        "src_8_container_reports": lambda spark, sf: sarif.container_findings(sarif.container_reports(M.SARIF_REPORT.files(spark, sf))).select(
            "scan_id", "package", "version", "severity", "title", "ghsa", "vulnerable_versions", "cvss_score", "url"),
        "pos_2_file_signals": _presence,
    }


def all_queries() -> dict[str, Query]:
    return {"fleet_scan_scores": document_scores, "fleet_scan_all_detectors": _fleet, "fleet_scan_reports": _fleet_reports, "fleet_scan_health": _fleet_health, **detector_queries(), **finding_queries(),
            **dependency_queries(), **stream_queries(), **misc_queries(), **real_text_queries()}
