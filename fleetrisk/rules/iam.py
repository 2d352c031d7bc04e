"""Identity-policy rules. Ids, names, severities, categories, action lists."""

from __future__ import annotations

CANDIDATE_HINTS = ["iam", "policy", "policies", "role", "roles", "trust", "cloudformation", "cfn", "sam-template",
                   r"template\.yaml", r"template\.yml", r"template\.json"]
CANDIDATE_SKIP = [r"node_modules/", r"/\.next/", r"/dist/", r"/build/", r"package-lock\.json$", r"package\.json$",
                  r"tsconfig\.json$", r"composer\.lock$"]

# (id, name, severity, category)
IAM_RULES = [
    ("iam-oidc-no-condition", "GitHub OIDC trust has no Condition block", "critical", "oidc"),
    ("iam-oidc-wildcard-repo", "GitHub OIDC trust uses wildcard repo in sub claim", "critical", "oidc"),
    ("iam-oidc-pull-request-trust", "GitHub OIDC trust accepts pull_request context", "critical", "oidc"),
    ("iam-oidc-wildcard-ref", "GitHub OIDC trust uses wildcard ref/environment in sub claim", "high", "oidc"),
    ("iam-passrole-wildcard", "iam:PassRole granted on Resource: *", "critical", "privesc"),
    ("iam-self-managing", "Policy can modify IAM policies on Resource: *", "critical", "privesc"),
    ("iam-assume-role-no-condition", "sts:AssumeRole allowed without a Condition", "high", "privesc"),
    ("iam-not-action-allow", "Statement uses Allow with NotAction (inverted logic)", "high", "privesc"),
    ("iam-passrole-with-create-compute", "iam:PassRole combined with compute creation in the same file", "critical", "privesc"),
    ("iam-action-resource-wildcard", "Allow with Action: * and Resource: *", "critical", "admin"),
    ("iam-sensitive-service-wildcard", "Sensitive service action with Resource: *", "high", "admin"),
    ("iam-principal-wildcard", "Resource policy allows wildcard Principal without Condition", "critical", "admin"),
]
CATEGORIES = ["oidc", "privesc", "admin"]
DEDUCTION = {"critical": 20, "high": 10, "medium": 5, "low": 2}
CREATE_COMPUTE = ["lambda:createfunction", "ec2:runinstances", "ecs:runtask", "glue:createjob"]
SELF_MANAGING = ["iam:createpolicyversion", "iam:setdefaultpolicyversion", "iam:attachrolepolicy", "iam:putrolepolicy"]
SENSITIVE_SERVICES = ["iam", "kms", "secretsmanager", "sts"]
SERVICE_WILDCARDS = 3
OIDC_HOST = "token.actions.githubusercontent.com"
