"""Rule catalogue: every rule of every pack, and how finding ids resolve to it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fleetrisk.functions import severity as sev
from fleetrisk.functions.structs import sql_map
from fleetrisk.rules import calls, iac, sast, secrets, sensitive

# Infrastructure layers and the order in which a bare iac/ id tries them.
_IAC_LAYERS = [
    ("dockerfile", "iac-dockerfile", [iac.DOCKER_USER_ROOT, *iac.DOCKER_RULES, iac.DOCKER_BASE_EOL]),
    ("actions", "iac-github-actions", iac.ACTIONS_RULES), ("terraform", "iac-terraform", iac.TERRAFORM_RULES),
    ("kubernetes", "iac-kubernetes", iac.KUBERNETES_RULES),
    ("iam", "iac-iam", list({r.id: r for r in iac.IAM_POLICY_RULES}.values())),
    ("cloudformation", "iac-cloudformation", iac.CLOUDFORMATION_RULES), ("helm", "iac-helm", iac.HELM_RULES),
]


def entries() -> list[tuple]:
    """(id, layer, name, severity, category, cwe) of every rule."""
    out = [(r.id, "ast", r.name, r.severity, r.category, r.cwe) for r in calls.CALL_RULES]
    for layer, rules in [("regex-code", sast.SAST_RULES), ("framework", sast.FRAMEWORK_RULES),
                         ("business-logic", sast.BIZ_RULES), ("ai-generated", sast.AI_RULES)]:
        for r in rules:
            cat = f"framework:{r.framework}" if r.framework else r.category
            out.append((f"code/{r.id}", layer, r.name, r.severity, cat, r.cwe))
    out += [(f"secret/{r.id}", "secret-regex", r.name, r.severity, "secret", "CWE-798") for r in secrets.SECRET_RULES]
    out += [(f"sensitive-file/{k}", "sensitive-file", n, s, "sensitive-file", None) for k, n, s, _ in sensitive.SENSITIVE_FILES]
    for short, layer, rules in _IAC_LAYERS:
        cat = "iac-actions" if short == "actions" else layer
        for r in rules:
            cwe = "CWE-1104" if r is iac.DOCKER_BASE_EOL else None
            out.append((f"iac/{short}/{r.id}", layer, r.name, r.severity, cat, cwe))
    return out


def rule_catalog(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(entries(), "id string, layer string, name string, severity string, category string, cwe string")


def by_severity(catalog: DataFrame) -> DataFrame:
    return catalog.orderBy(sev.rank(F.col("severity")), "layer", "id")


def resolve(sarif_id: Column) -> Column:
    """Catalogue id of a finding's SARIF rule id, or null. A literal map: no join, no shuffle."""
    known = sql_map([(e[0], e[0]) for e in entries()])
    rest = F.substr(sarif_id, F.instr(sarif_id, "/") + 1)
    tries = [sarif_id, F.when(sarif_id.startswith("code/"), F.concat(F.lit("ast/"), rest))]
    tries += [F.when(sarif_id.startswith("iac/"), F.concat(F.lit(f"iac/{s}/"), rest)) for s, _, _ in _IAC_LAYERS]
    return F.coalesce(*[F.try_element_at(known, t) for t in tries])


def slug(rule_id: Column) -> Column:
    return F.replace(rule_id, F.lit("/"), F.lit("."))


def unslug(s: Column) -> Column:
    return F.replace(s, F.lit("."), F.lit("/"))


def counts(catalog: DataFrame) -> DataFrame:
    return catalog.groupBy("layer", "severity").agg(F.count(F.lit(1)).alias("rules"))
