"""Reading the fleet: checkouts, commits, snapshots, settings. Schemas are explicit, never inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fleetrisk import schemas as S


def files_table(spark: SparkSession, path: str) -> DataFrame:
    """The lake table of file versions (Parquet)."""
    return spark.read.schema(S.FILES).parquet(path)


def checkouts(spark: SparkSession, root: str, scan_id: str = "head", depth: int = 2) -> DataFrame:
    """Files of checkouts as text; see ``text_files`` for what is no text."""
    return text_files(raw_checkouts(spark, root, scan_id, depth))[0]


def raw_checkouts(spark: SparkSession, root: str, scan_id: str = "head", depth: int = 2) -> DataFrame:
    """Raw checkouts below ``root/<owner>/<repo>/…`` as files rows; executors read the files.

    ``depth`` is the number of directories that name a repository. Each file is one row, so a
    large repository spreads over tasks by size like any other data.
    """
    b = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    at = F.regexp_replace(F.url_decode("path"), "^[a-z]+:/*", "/")
    tail = F.substring_index(at, root.rstrip("/").rsplit("/", 1)[-1] + "/", -1)
    parts = F.split(tail, "/")
    repo = F.array_join(F.slice(parts, 1, depth), "/")
    path = F.array_join(F.slice(parts, depth + 1, F.size(parts)), "/")
    return b.select(repo.alias("repo"), F.lit(scan_id).alias("scan_id"), path.alias("path"), F.col("length").alias("size"),
                    "content")


def text_files(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files, rejected) of rows with bytes as content: text is decoded for paths that a scan reads, and only if it is UTF-8.

    Pictures, archives and the like are told by their path and never decoded; their row stays, with null content, for the
    detectors that read names. The rejected are scannable paths whose bytes are no UTF-8: their invalid parts are replaced in files.
    """
    from fleetrisk.operators.gates import is_scannable

    read = is_scannable(F.col("path"), F.col("size"))
    valid = F.try_validate_utf8(F.col("content").cast("string")).isNotNull()
    files = raw.withColumn("content", F.when(read, F.make_valid_utf8(F.col("content").cast("string"))))
    return files, raw.where(read & ~valid).drop("content")


def safe_files(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) by the identifier checks on owner, repository and path."""
    from fleetrisk.operators.gates import is_safe_owner_repo, is_safe_repo_path

    owner, name = F.substring_index("repo", "/", 1), F.substring_index("repo", "/", -1)
    ok = F.coalesce(is_safe_owner_repo(owner) & is_safe_owner_repo(name) & is_safe_repo_path(F.col("path")), F.lit(False))
    return files.where(ok), files.where(~ok)


def in_scope(files: DataFrame, prefix: str | None) -> DataFrame:
    """Files at or below a path prefix; the test is a pushed-down StartsWith."""
    from fleetrisk.functions.paths import in_prefix

    return files if not prefix else files.where(in_prefix(F.col("path"), prefix))


def commits(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(S.COMMITS).json(path)


def osv_dump(spark: SparkSession, path: str) -> DataFrame:
    """The public advisory dump: one JSON document per advisory."""
    return spark.read.schema(S.OSV_ADVISORIES).option("multiLine", True).json(path)


def npm_bulk(spark: SparkSession, path: str) -> DataFrame:
    """Bulk advisories: a map from package to its advisories, as flat rows."""
    adv = "array<struct<severity:string,title:string,vulnerable_versions:string,url:string,cvss:struct<score:double>>>"
    text = spark.read.option("wholetext", True).text(path)
    m = text.select(F.explode(F.from_json("value", f"map<string,{adv}>")).alias("package", "advs")).select("package", F.explode("advs").alias("a"))
    return m.select("package", "a.severity", "a.title", "a.vulnerable_versions", "a.url", F.col("a.cvss.score").alias("cvss_score"))


def package_licenses(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(S.PACKAGE_LICENSES).json(path)


def registry_meta(spark: SparkSession, path: str) -> DataFrame:
    """Registry answers ``{name, status, body}`` reduced to what the signals use.

    A package is deprecated when its latest version is; an answer other than 200 keeps only its status.
    """
    body = ("struct<time:struct<created:timestamp>,maintainers:array<struct<name:string>>,"
            "`dist-tags`:struct<latest:string>,versions:map<string,struct<deprecated:string>>>")
    r = spark.read.schema("name string, status int, body string").json(path).withColumn("b", F.from_json("body", body))
    ok = F.col("status") == 200
    dep = F.coalesce(F.length(F.try_element_at("b.versions", F.col("b.dist-tags.latest"))["deprecated"]) > 0, F.lit(False))
    return r.select("name", "status", F.when(ok, F.col("b.time.created")).alias("created"),
                    F.when(ok, F.transform("b.maintainers", lambda m: m["name"])).alias("maintainers"), (ok & dep).alias("deprecated"))


def popular_packages(spark: SparkSession, path: str, ecosystem: str, limit: int) -> DataFrame:
    """A ranked name list; rank is the position in the list."""
    t = spark.read.option("wholetext", True).text(path)
    names = F.from_json("value", "struct<packages:array<struct<name:string>>>")["packages"]
    return t.select(F.posexplode(F.slice(names, 1, limit)).alias("pos", "p")).select(
        F.lit(ecosystem).alias("ecosystem"), F.col("p.name").alias("name"), (F.col("pos") + 1).alias("rank"))


def repo_settings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(S.REPO_SETTINGS).json(path)


def with_posture_inputs(settings: DataFrame, file_flags: DataFrame, signed: DataFrame | None = None, rulesets: DataFrame | None = None) -> DataFrame:
    """Settings completed with what files, commits and rulesets say about the same repository."""
    def left(df: DataFrame, side: DataFrame, cols: list[str]) -> DataFrame:
        key = [k for k in ("repo", "scan_id") if k in df.columns and k in side.columns]
        s = side.select(*key, *[F.col(c).alias(f"_{c}") for c in cols])
        j = df.join(s, key, "left")
        pick = {c: F.coalesce(F.col(f"_{c}"), F.col(c)) if c in df.columns else F.col(f"_{c}") for c in cols}
        return j.withColumns(pick).drop(*[f"_{c}" for c in cols])

    out = left(settings, file_flags, [c for c in file_flags.columns if c not in ("repo", "scan_id")])
    if signed is not None:
        out = left(out, signed, ["signed_commits_ratio"])
    if rulesets is not None:
        cols = ["pr_required", "status_checks_required", "signed_commits_required", "no_bypass_actors"]
        out = left(out, rulesets.select("repo", F.struct(*cols).alias("ruleset")), ["ruleset"])
    return out


def scans_table(spark: SparkSession, path: str) -> DataFrame:
    """Scan rows of every age; columns added later read as null."""
    return spark.read.schema(S.SCANS + ", scan_date date").option("mergeSchema", True).parquet(path)


def suppression_rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(S.SUPPRESSION_ROWS).parquet(path)


def repo_from_url(url: Column) -> Column:
    """``owner/name`` of a github.com address, with or without scheme, ``.git`` or a deeper path; else null."""
    m = r"^(?i:(?:https?://)?github\.com)/+([A-Za-z0-9._-]+)/+([A-Za-z0-9._-]+)(?:[/?#].*)?$"
    t = F.trim(url)
    return F.when(t.rlike(m), F.concat(F.regexp_extract(t, m, 1), F.lit("/"), F.regexp_replace(F.regexp_extract(t, m, 2), r"\.git$", "")))
