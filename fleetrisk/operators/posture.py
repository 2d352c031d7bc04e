"""Repository posture: signals from settings and files, score, grade, quick wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from fleetrisk.operators.secrets import recent_commits

# Fixed values: (id, category, points), in display order.
SIGNALS = [
    ("branch-protection", "branch", 15), ("branch-pr-required", "branch", 5), ("branch-status-checks", "branch", 5),
    ("branch-enforce-admins", "branch", 5), ("security-md", "docs", 10), ("license", "docs", 8), ("codeowners", "docs", 5),
    ("readme-substantial", "docs", 4), ("readme-mentions-security", "docs", 3), ("auto-updates", "deps", 12),
    ("lockfile", "deps", 8), ("gitignore-basics", "deps", 5), ("signed-commits", "governance", 10), ("mfa-org", "governance", 5),
    ("secret-scanning", "governance", 6), ("workflow-permissions", "governance", 5), ("release-provenance", "governance", 4),
]
POINTS = {s: p for s, _, p in SIGNALS}
SUB_SIGNALS = ["branch-pr-required", "branch-status-checks", "branch-enforce-admins"]
PROVENANCE = r"(?i)attest-build-provenance|provenance:\s*true|--provenance|cosign\s+sign|sigstore|slsa-github-generator|attestations:\s*write"
PRESENCE = {
    "has_security_md": ["SECURITY.md"], "has_license": ["LICENSE", "LICENSE.md", "LICENSE.txt"],
    "has_codeowners": ["CODEOWNERS", ".github/CODEOWNERS", "docs/CODEOWNERS"],
    "has_dependabot_or_renovate": [".github/dependabot.yml", "renovate.json"],
    "has_lockfile": ["package-lock.json", "yarn.lock", "pnpm-lock.yaml", "poetry.lock"],
}


def file_signals(files: DataFrame) -> DataFrame:
    """Presence flags, README and .gitignore text, and release provenance, per scan of a repository."""
    path = F.col("path")
    flow = path.rlike(r"(?i)^\.github/workflows/[^/]+\.ya?ml$")
    wanted = [p for ps in PRESENCE.values() for p in ps] + ["README.md", ".gitignore"]
    f = files.where(path.isin(wanted) | flow)
    g = f.groupBy("repo", "scan_id").agg(
        *[F.bool_or(path.isin(ps)).alias(k) for k, ps in PRESENCE.items()],
        F.max(F.when(path == "README.md", F.col("content"))).alias("readme"),
        F.max(F.when(path == ".gitignore", F.col("content"))).alias("gitignore"),
        F.bool_or(F.when(flow, F.col("content").rlike(PROVENANCE))).alias("_signed"))
    state = F.when(F.col("_signed").isNull(), "unknown").when(F.col("_signed"), "present").otherwise("absent")
    return g.withColumn("release_provenance", state).drop("_signed")


def signed_ratio(commits: DataFrame, depth: int = 30) -> DataFrame:
    """Verified share of the latest ``depth`` commits of each scan."""
    r = recent_commits(commits.select("repo", "scan_id", "sha", "author_date", "committer_date", "verified"), depth)
    return r.groupBy("repo", "scan_id").agg(F.avg(F.coalesce("verified", F.lit(False)).cast("double")).alias("signed_commits_ratio"))


def ruleset_rollup(rules: DataFrame, rulesets: DataFrame) -> DataFrame:
    """Booleans of the active rulesets per repository; no_bypass_actors is null when never visible.

    ``rules(repo, branch, type, ruleset_id, n_checks)``, ``rulesets(id, name, enforcement,
    bypass_visible, bypass_actor_types, bypass_count)``.
    """
    j = rules.join(rulesets, rules.ruleset_id == rulesets.id).where(F.col("enforcement") == "active")
    checks = (F.col("type") == "required_status_checks") & (F.coalesce("n_checks", F.lit(0)) > 0)
    return j.groupBy("repo").agg(
        F.bool_or(F.col("type") == "pull_request").alias("pr_required"), F.bool_or(checks).alias("status_checks_required"),
        F.bool_or(F.col("type") == "required_signatures").alias("signed_commits_required"),
        F.bool_and(F.when(F.col("bypass_visible"), F.col("bypass_count") == 0)).alias("no_bypass_actors"))


def bypass_findings(rules: DataFrame, rulesets: DataFrame) -> DataFrame:
    """One finding per active rule that named actors may bypass."""
    j = rules.join(rulesets, rules.ruleset_id == rulesets.id)
    j = j.where((F.col("enforcement") == "active") & F.col("bypass_visible") & (F.col("bypass_count") > 0))
    types = F.array_distinct("bypass_actor_types")
    who = F.when(F.size(types) > 0, F.array_join(types, ", ")).otherwise("unspecified")
    return j.select("repo", F.lit("ruleset-bypass-actors").alias("rule_id"), F.lit("low").alias("severity"),
                    F.col("name").alias("ruleset_name"), F.col("type").alias("rule_type"), "branch", "bypass_count",
                    F.format_string("Rule '%s' in ruleset '%s' (branch '%s') can be bypassed by %d actor(s): %s.",
                                    "type", "name", "branch", "bypass_count", who).alias("description"))


def gitignore_ok(text: Column) -> Column:
    lines = F.transform(F.split(text, r"\r?\n"), lambda l: F.trim(l))
    return F.exists(lines, lambda l: l.rlike(r"^/?node_modules\b")) & F.exists(lines, lambda l: l.rlike(r"^/?\.env\b"))


def posture_signals(settings: DataFrame) -> DataFrame:
    """(repo, signal, category, points_earned, points_max, satisfied, unknown): 17 rows per repository."""
    no = F.lit(False)
    yes = lambda c: F.coalesce(c, no)
    rs, bp = F.col("ruleset"), F.col("bp_details")
    protected = yes(F.col("branch_protected")) | rs.isNotNull()
    hidden = yes(F.col("branch_protected")) & bp.isNull() & rs.isNull()
    readme = F.coalesce("readme", F.lit(""))
    by_rule = yes(rs["signed_commits_required"])
    ratio = F.col("signed_commits_ratio")
    half = F.when(~by_rule & (ratio < 0.8) & (ratio >= 0.5), F.lit(5)).otherwise(F.lit(0))
    state = {
        "branch-protection": (protected, no), "branch-pr-required": (yes(bp["pr_required"]) | yes(rs["pr_required"]), hidden),
        "branch-status-checks": (yes(bp["status_checks_required"]) | yes(rs["status_checks_required"]), hidden),
        "branch-enforce-admins": (yes(bp["enforce_admins"]) | yes(rs["no_bypass_actors"]), hidden),
        "security-md": (yes(F.col("has_security_md")), no), "license": (yes(F.col("has_license")), no),
        "codeowners": (yes(F.col("has_codeowners")), no), "readme-substantial": (F.length(readme) >= 500, no),
        "readme-mentions-security": (readme.rlike("(?i)security"), no),
        "auto-updates": (yes(F.col("has_dependabot_or_renovate")), no), "lockfile": (yes(F.col("has_lockfile")), no),
        "gitignore-basics": (yes(gitignore_ok(F.col("gitignore"))), no),
        "signed-commits": (by_rule | yes(ratio >= 0.8), ~by_rule & ratio.isNull()),
        "mfa-org": (yes(F.col("mfa_state") == "enforced"), F.coalesce("mfa_state", F.lit("unknown")).isin("na-user-repo", "unknown")),
        "secret-scanning": (yes(F.col("secret_scanning") == "enabled"), F.coalesce("secret_scanning", F.lit("unknown")) == "unknown"),
        "workflow-permissions": (yes(F.col("workflow_perms") == "read"), F.coalesce("workflow_perms", F.lit("unknown")) == "unknown"),
        "release-provenance": (yes(F.col("release_provenance") == "present"), F.coalesce("release_provenance", F.lit("unknown")) == "unknown"),
    }
    rows = []
    for i, (sid, cat, pts) in enumerate(SIGNALS):
        ok, unknown = state[sid]
        part = half if sid == "signed-commits" else F.lit(0)
        rows.append(F.struct(F.lit(i).alias("ord"), F.lit(sid).alias("signal"), F.lit(cat).alias("category"),
                             F.when(ok, F.lit(pts)).otherwise(part).alias("points_earned"), F.lit(pts).alias("points_max"),
                             ok.alias("satisfied"), unknown.alias("unknown")))
    return settings.select("repo", F.inline(F.array(*rows)))


def grade(score: Column) -> Column:
    return F.when(score >= 90, "A").when(score >= 75, "B").when(score >= 60, "C").when(score >= 40, "D").otherwise("F")


def posture_scores(signals: DataFrame) -> DataFrame:
    """Share of the assessable points, and the grade; unknown signals leave the denominator."""
    s = signals.groupBy("repo").agg(F.sum("points_earned").alias("earned"),
                                    F.sum(F.when(~F.col("unknown"), F.col("points_max")).otherwise(0)).alias("assessable"))
    score = F.when(F.col("assessable") > 0, F.round(F.col("earned") / F.col("assessable") * 100).cast("int")).otherwise(100)
    return s.select("repo", score.alias("posture_score")).withColumn("posture_grade", grade(F.col("posture_score")))


def posture_breakdown(signals: DataFrame) -> DataFrame:
    return signals.groupBy("repo", "category").agg(F.sum("points_earned").alias("points_earned"), F.sum("points_max").alias("points_max"))


def quick_wins(signals: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` largest fixable signals per repository.

    A repository has 17 signals, so the window is small whatever the fleet. Branch sub-signals
    wait until protection itself is on.
    """
    all_rows = Window.partitionBy("repo")
    off = F.bool_or((F.col("signal") == "branch-protection") & ~F.col("satisfied")).over(all_rows)
    s = signals.withColumn("_off", off).where(~F.col("satisfied") & ~F.col("unknown"))
    s = s.where(~(F.col("_off") & F.col("signal").isin(SUB_SIGNALS)))
    w = Window.partitionBy("repo").orderBy(F.desc("points_max"), "ord")
    return s.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(
        "repo", "rank", "signal", F.col("points_max").alias("points_available"))
