"""File-level predicates. All are narrow projections pushed in front of the line explode."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from fleetrisk.functions.paths import any_match, basename, extension, has_extension

# Paths never scanned, extensions scanned.
SKIP_PATHS = [
    r"(^|/)node_modules/", r"(^|/)\.next/", r"(^|/)dist/", r"(^|/)build/", r"(^|/)target/", r"(^|/)vendor/",
    r"(^|/)\.git/", r"(^|/)coverage/", r"(^|/)out/", r"\.min\.(js|css)$", r"\.lock$", r"package-lock\.json$",
    r"yarn\.lock$", r"pnpm-lock\.yaml$", r"\.map$",
]
SCANNABLE_EXTENSIONS = [
    "js", "jsx", "ts", "tsx", "mjs", "cjs", "py", "rb", "go", "java", "kt", "scala", "rs", "php", "c", "cpp", "h",
    "hpp", "cs", "sh", "bash", "zsh", "fish", "yml", "yaml", "json", "xml", "toml", "ini", "conf", "config", "env",
    "envrc", "md", "txt", "sql", "dockerfile", "makefile", "properties", "plist", "tf", "tfvars", "bicep",
]


def is_scannable(path: Column, size: Column, max_size: int | None = None) -> Column:
    """Path and extension only, so the content of rejects is never decoded; ``max_size`` also rejects longer files."""
    name = F.lower(basename(path))
    by_ext = F.when(has_extension(path), extension(path).isin(SCANNABLE_EXTENSIONS)).otherwise(
        name.isin("dockerfile", "makefile")
    )
    ok = ~any_match(path, SKIP_PATHS) & (by_ext | name.startswith(".env"))
    return ok if max_size is None else ok & (F.coalesce(size, F.lit(0)) <= max_size)


def looks_binary(content: Column) -> Column:
    """More than a tenth of the first 1000 characters are control characters."""
    sample = F.substring(content, 1, 1000)
    printable = F.regexp_replace(sample, "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]", "")
    return (F.length(sample) - F.length(printable)) > F.length(sample) * 0.1


def is_dockerfile(path: Column) -> Column:
    base = basename(path)
    return base.rlike(r"(?i)^Dockerfile(\.[A-Za-z0-9._-]+)?$") | base.rlike(r"(?i)\.dockerfile$")


def is_workflow(path: Column) -> Column:
    return path.rlike(r"(?i)^\.github/workflows/[^/]+\.ya?ml$")


def is_terraform(path: Column) -> Column:
    return path.rlike(r"(?i)\.(tf|tfvars)$")


def is_yaml(path: Column) -> Column:
    return path.rlike(r"(?i)\.ya?ml$")


def is_helm_values(path: Column) -> Column:
    return basename(path).rlike(r"(?i)^values(?:[.-][\w.-]+)?\.ya?ml$")


def is_kubernetes(content: Column) -> Column:
    return content.rlike(r"(?m)^apiVersion:\s*\S") & content.rlike(r"(?m)^kind:\s*\S")


def is_cloudformation(content: Column) -> Column:
    return content.contains("AWSTemplateFormatVersion") | (
        content.rlike(r"(^|\n)\s*\"?Resources\"?\s*:") & content.rlike(r"\"?Type\"?\s*:\s*[\"']?AWS::")
    )


def file_class(path: Column) -> Column:
    """Dispatch of the infrastructure packs; each file gets exactly one class."""
    return (
        F.when(is_dockerfile(path), "dockerfile")
        .when(is_workflow(path), "workflow")
        .when(is_terraform(path), "terraform")
        .when(is_yaml(path), "yaml")
        .when(path.rlike(r"(?i)\.json$"), "json")
        .otherwise("other")
    )


def scannable_files(files: DataFrame) -> DataFrame:
    """Files every content detector reads: scannable by name and not binary."""
    return files.where(is_scannable(F.col("path"), F.col("size"))).where(~looks_binary(F.col("content")))


# Directories and shapes that set the scan order of files.
SOURCE_DIRS = [
    "src", "lib", "libs", "app", "pages", "server", "servers", "api", "apis", "services", "service", "routes",
    "controllers", "controller", "handlers", "handler", "models", "model", "core", "internal", "internals",
    "packages", "modules", "components", "domain",
]
ROOT_OR_CI = [r"^[^/]+$", r"(?i)^\.github/workflows/", r"(?i)^\.github/actions/"]


def priority_tier(path: Column) -> Column:
    """1 source, 2 root and CI files, 3 the rest, 4 tests, fixtures and docs."""
    from fleetrisk.functions.paths import TEST_PATH_PATTERNS

    return (
        F.when(any_match(path, [*TEST_PATH_PATTERNS, r"(?i)^docs?/"]), 4)
        .when(F.lower(path).rlike(r"(^|/)(" + "|".join(SOURCE_DIRS) + r")/"), 1)
        .when(any_match(path, ROOT_OR_CI), 2)
        .otherwise(3)
    )


def prioritized(files: DataFrame, max_files: int | None = None) -> DataFrame:
    """Adds the tier; with ``max_files`` also keeps the best that many of each scan, ranked.

    Unlimited, the order is a plain ``orderBy(repo, scan_id, tier, path)``, which range
    partitions and so survives one repository holding most files. Limited, the rank filter
    lets Spark cut every input partition to ``max_files`` per scan before the shuffle.
    """
    out = files.withColumn("tier", priority_tier(F.col("path")))
    if max_files is None:
        return out
    w = Window.partitionBy("repo", "scan_id").orderBy("tier", "path")
    return out.withColumn("scan_rank", F.row_number().over(w)).where(F.col("scan_rank") <= max_files)


def scan_coverage(files: DataFrame, max_files: int | None = None) -> DataFrame:
    """files_scanned / files_skipped / truncated per scan, from names and sizes alone."""
    ok = is_scannable(F.col("path"), F.col("size"))
    n = F.count_if(ok)
    scanned = n if max_files is None else F.least(n, F.lit(max_files))
    return files.groupBy("repo", "scan_id").agg(
        scanned.cast("bigint").alias("files_scanned"),
        (F.count(F.lit(1)) - scanned).cast("bigint").alias("files_skipped"),
        (n > scanned).alias("truncated"),
    )


# Identifier checks used as data-quality filters.
_SAFE_NAME = r"^[A-Za-z0-9._-]+$"


def is_safe_owner_repo(value: Column) -> Column:
    return value.rlike(_SAFE_NAME) & (F.length(value) <= 100) & ~value.rlike(r"^\.+$")


def is_safe_repo_path(value: Column) -> Column:
    """Relative, trimmed, no parent segments, backslashes, NULs or URL schemes."""
    bad = (
        value.startswith("/") | value.contains("\\") | value.contains("\0") | value.contains("://")
        | value.isin("", ".", "./") | value.rlike(r"(^|/)\.\.(/|$)") | value.rlike(r"^\s|\s$")
    )
    return (F.length(value) <= 1024) & ~bad


def is_safe_git_ref(value: Column) -> Column:
    bad = (
        value.startswith("/") | value.endswith("/") | value.startswith("-") | value.contains("//")
        | value.contains("..") | value.rlike(r"(^|/)@(/|$)")
    )
    return value.rlike(r"^[A-Za-z0-9._/-]+$") & (F.length(value) <= 255) & ~bad


def is_iam_candidate(path: Column, size: Column, max_size: int | None = None) -> Column:
    """Files that may declare cloud identity policies: Terraform, serverless, hinted JSON/YAML."""
    from fleetrisk.rules.iam import CANDIDATE_HINTS

    p = F.lower(path)
    named = p.rlike(r"\.tf$") | p.rlike(r"(^|/)serverless\.ya?ml$") | (
        p.rlike(r"\.(json|ya?ml)$") & p.rlike("(" + "|".join(CANDIDATE_HINTS) + ")")
    )
    return named if max_size is None else named & (F.coalesce(size, F.lit(0)) <= max_size)
