"""Blast radius and attack paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fleetrisk.functions import severity as sev
from fleetrisk.functions.structs import named

# Secret id prefixes to (domain, capability, assets); first group wins.
BLAST = [
    (["aws-"], "cloud", "Programmatic access to the AWS account the key belongs to",
     ["S3 buckets", "RDS / DynamoDB data", "EC2/Lambda compute", "IAM (potential privilege escalation)"]),
    (["azure-"], "cloud", "Access to Azure resources / storage for the tenant",
     ["Blob/Table/Queue storage", "AAD-protected resources"]),
    (["gcp-"], "cloud", "Access to the GCP project the credential is scoped to",
     ["GCS buckets", "Cloud SQL", "service-account impersonation"]),
    (["digitalocean-", "heroku-", "cloudflare-", "vercel-", "netlify-", "render-", "flyio-", "hashicorp-vault-",
      "terraform-cloud-"], "cloud", "Control of the hosting / infra account",
     ["Deployments", "DNS / edge config", "environment secrets"]),
    (["github-", "gitlab-", "bitbucket-"], "scm", "Read/write access to source repositories",
     ["Push to default branch", "CI/CD workflows", "downstream supply chain"]),
    (["stripe-", "paypal-", "square-", "shopify-", "adyen-"], "payments", "Access to the payments / commerce account",
     ["Customer PII", "charges / refunds", "payout configuration"]),
    (["npm-", "pypi-", "docker-hub-", "jfrog-"], "package-registry", "Publish rights to package registries",
     ["Malicious package releases", "supply-chain compromise of consumers"]),
    (["anthropic-", "openai-", "huggingface-", "replicate-", "perplexity-", "groq-"], "ai",
     "Billable use of the AI provider account", ["Quota / spend abuse", "access to fine-tunes / files"]),
    (["slack-", "discord-", "telegram-", "sendgrid-", "mailgun-", "postmark-", "mailchimp-", "twilio-"], "comms",
     "Send messages / email as the organisation", ["Phishing from a trusted sender", "contact-list exfiltration"]),
    (["datadog-", "newrelic-", "sentry-", "pagerduty-", "segment-", "algolia-"], "observability",
     "Access to monitoring / analytics data", ["Logs & traces (often contain secrets)", "alerting control"]),
    (["private-key", "password-in-url", "basic-auth-url", "jwt"], "data", "Direct access to a service or data store",
     ["Database / API behind the credential"]),
]
EXPOSURE = r"s3-public|public-access|wildcard|world-ingress|publicly-accessible|iam-"


def blast_radius(rule_id: Column) -> Column:
    """struct(domain, capability, assets) of a secret id, or null: one prefix match and a literal map."""
    prefix = F.regexp_extract(F.lower(rule_id), "^(" + "|".join(p for ps, *_ in BLAST for p in ps) + ")", 1)
    table = F.create_map(*[x for ps, domain, capability, assets in BLAST for p in ps for x in (
        F.lit(p), named(domain=F.lit(domain), capability=F.lit(capability), assets=F.array(*[F.lit(a) for a in assets])))])
    return F.try_element_at(table, prefix)


def _live_fixture_free() -> Column:
    return ~F.coalesce("likely_test_fixture", F.lit(False))


def repo_context(findings: DataFrame) -> DataFrame:
    """One row per scan: the first cloud exposure and whether a sensitive file is committed."""
    exposes = (F.col("kind") == "iac") & _live_fixture_free() & F.lower("rule_id").rlike(EXPOSURE)
    return findings.groupBy("repo", "scan_id").agg(
        F.min_by("rule_name", F.when(exposes, F.col("ord"))).alias("_e"), F.bool_or(exposes).alias("_any"),
        F.bool_or(F.col("kind") == "sensitive-file").alias("has_sensitive"),
    ).select("repo", "scan_id", F.when(F.col("_any"), F.col("_e")).alias("exposure"), "has_sensitive")


def credentials(findings: DataFrame) -> DataFrame:
    c = findings.where((F.col("kind") == "secret") & _live_fixture_free()).withColumn("blast", blast_radius(F.col("rule_id")))
    live = F.coalesce(F.col("validation") == "active", F.lit(False))
    return c.where(F.col("blast").isNotNull()).withColumn("live", live).withColumn(
        "sev", F.when(F.col("live"), "critical").otherwise(F.col("severity"))
    ).withColumn("cred_id", F.concat_ws(":", F.lit("cred"), "rule_id", "file_path", F.col("line_no").cast("string")))


def nodes(findings: DataFrame) -> DataFrame:
    """First node per id: credentials and the asset domains they open."""
    c = credentials(findings)
    cred = c.select("repo", "scan_id", F.col("cred_id").alias("node_id"), F.lit("credential").alias("node_kind"),
                    F.col("rule_name").alias("label"), "sev", "ord")
    asset = c.select("repo", "scan_id", F.concat(F.lit("asset:"), "blast.domain").alias("node_id"),
                     F.lit("asset").alias("node_kind"), F.col("blast.capability").alias("label"), "sev", "ord")
    first = F.min_by(F.struct("node_kind", "label", "sev"), "ord").alias("n")
    return cred.unionByName(asset).groupBy("repo", "scan_id", "node_id").agg(first).select(
        "repo", "scan_id", "node_id", "n.node_kind", "n.label", F.col("n.sev").alias("severity"))


def edges(findings: DataFrame) -> DataFrame:
    return credentials(findings).select(
        "repo", "scan_id", F.col("cred_id").alias("from_id"), F.concat(F.lit("asset:"), "blast.domain").alias("to_id"),
        F.col("blast.capability").alias("reason"))


def paths(findings: DataFrame) -> DataFrame:
    """Attack paths; path_id is the ordinal of the entry finding.

    The per-scan context is one row per scan; AQE broadcasts it when its measured size is
    small and splits a skewed scan otherwise.
    """
    ctx = repo_context(findings)
    c = credentials(findings).join(ctx, ["repo", "scan_id"])
    cloud = (F.col("blast.domain") == "cloud") & F.col("exposure").isNotNull()
    assets = F.array_join("blast.assets", ", ")
    where = F.concat(F.lit("Leaked "), "rule_name", F.lit(" in "), "file_path", F.lit(":"), F.col("line_no").cast("string"),
                     F.when(F.col("live"), " (confirmed live)").otherwise(""))
    steps = F.array_compact(F.array(
        where, F.col("blast.capability"),
        F.when(cloud, F.concat(F.lit("Reachable resource exposed by: "), "exposure")),
        F.when(cloud, F.concat(F.lit("Compromise of: "), assets)).otherwise(F.concat(F.lit("Exposure of: "), assets)),
        F.when(F.col("blast.domain") == "scm", F.lit("Pivot: poison CI/CD → downstream supply chain")),
    ))
    title = F.when(cloud, F.concat("rule_name", F.lit(" → cloud account → production data"))).otherwise(
        F.concat("rule_name", F.lit(" → "), "blast.domain", F.lit(" blast radius")))
    main = c.select(
        "repo", "scan_id", F.concat(F.lit("path:"), "ord").alias("path_id"), title.alias("title"),
        F.when(cloud, "critical").otherwise(F.col("sev")).alias("severity"), steps.alias("steps"),
        F.col("file_path").alias("entry_path"), F.col("line_no").alias("entry_line"), "live", "ord")
    covered = c.where(cloud).select("repo", "scan_id").distinct()
    sensitive = F.col("has_sensitive")
    alone = ctx.where(F.col("exposure").isNotNull()).join(covered, ["repo", "scan_id"], "left_anti").select(
        "repo", "scan_id", F.lit("path:exposure").alias("path_id"),
        F.lit("Public cloud resource → data exposure").alias("title"),
        F.when(sensitive, "high").otherwise("medium").alias("severity"),
        F.array(F.concat(F.lit("Misconfiguration: "), "exposure"),
                F.when(sensitive, "Combined with a committed sensitive file, data is directly reachable")
                .otherwise("Anything stored in the resource is internet-reachable")).alias("steps"),
        F.lit(None).cast("string").alias("entry_path"), F.lit(None).cast("int").alias("entry_line"),
        F.lit(False).alias("live"), F.lit("~").alias("ord"))
    return main.unionByName(alone)


def worst_first(p: DataFrame) -> DataFrame:
    return p.orderBy("repo", "scan_id", sev.rank(F.col("severity")), "ord")
