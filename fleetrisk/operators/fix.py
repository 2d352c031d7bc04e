"""Deterministic fix proposals: which findings have one, and the patched file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fleetrisk.functions.text import bound, strip
from fleetrisk.functions.paths import JS_EXTENSIONS

# Assignment shapes, safe-version pattern, supported base-image tags.
JS_ASSIGNMENT = r"^(\s*)(const|let|var)\s+([A-Za-z_$][A-Za-z0-9_$]*)\s*=\s*(['\"])([^'\"]+)\4(\s*;?\s*)$"
PY_ASSIGNMENT = r"^(\s*)([A-Za-z_][A-Za-z0-9_]*)\s*=\s*(['\"])([^'\"]+)\3(\s*)$"
SAFE_VERSION = r"<\s*(\d+\.\d+\.\d+(?:[-+][0-9A-Za-z.-]+)?)"
CURRENT_TAG = {"node": "22", "python": "3.12", "ruby": "3.3", "php": "8.3", "golang": "1.22", "debian": "12",
               "ubuntu": "24.04", "alpine": "3.20"}
WRITE_ALL = r"(?i)^(\s*)permissions\s*:\s*write-all\s*$"


def safe_version(range_text: Column) -> Column:
    return F.nullif(F.regexp_extract(range_text, SAFE_VERSION, 1), F.lit(""))


def _ext(path: Column) -> Column:
    return F.substring_index(path, ".", -1)


def _extractable(path: Column, line: Column) -> Column:
    js = _ext(path).isin(JS_EXTENSIONS) & line.rlike(JS_ASSIGNMENT)
    return js | ((_ext(path) == "py") & line.rlike(PY_ASSIGNMENT))


def from_ref(line: Column) -> Column:
    """struct(image with registry, tag, short lower-case name) of a FROM line; tag empty without one."""
    rest = F.regexp_extract(line, r"(?i)^\s*FROM\s+(.+?)\s*$", 1)
    rest = F.regexp_replace(F.regexp_replace(rest, r"(?i)^--platform=\S+\s+", ""), r"(?i)\s+AS\s+\S+\s*$", "")

    def parts(ref: Column) -> Column:
        last = F.substring_index(ref, "/", -1)
        tag = F.when(last.contains(":"), F.substring_index(last, ":", -1)).otherwise("")
        image = F.when(tag != "", F.substr(ref, F.lit(1), F.length(ref) - F.length(tag) - 1)).otherwise(ref)
        return F.struct(image.alias("image"), tag.alias("tag"), F.lower(F.regexp_replace(last, r":[^:]*$", "")).alias("name"))

    return bound(F.substring_index(strip(rest), "@", 1), parts)


def _bumpable(line: Column) -> Column:
    known = lambda r: r["name"].isin(list(CURRENT_TAG)) & r["tag"].rlike(r"^\d")
    return line.rlike(r"(?i)^\s*FROM\s") & bound(from_ref(line), known)


def fix_kind() -> Column:
    kind, path, line = F.col("kind"), F.col("file_path"), F.col("line_content")
    fixture = F.coalesce("likely_test_fixture", F.lit(False))
    dep = (~F.coalesce("is_transitive", F.lit(False)) & F.col("source").isin("package.json", "requirements.txt")
           & safe_version(F.col("vulnerable_versions")).isNotNull())
    secret = (kind == "secret") & (F.coalesce("source", F.lit("tree")) != "history")
    code = (kind == "code") & (F.col("category") == "hardcoded-creds")
    return (
        F.when((kind == "dependency") & dep, "dep-bump")
        .when((secret | code) & ~fixture & _extractable(path, line), "secret-extract")
        .when((kind == "iac") & ~fixture & (F.col("rule_id") == "dockerfile-base-image-eol") & _bumpable(line),
              "dockerfile-baseimage-bump")
        .when((kind == "iac") & ~fixture & (F.col("rule_id") == "gha-permissions-write-all"), "gha-permissions-fix")
    )


def _rewrite(line_no: Column, new: Column) -> Column:
    """File text with one 1-based line replaced; its lines are in the column lines."""
    lines = F.col("lines")
    whole = F.concat(F.slice(lines, 1, line_no - 1), F.array(new), F.slice(lines, line_no + 1, F.greatest(F.lit(0), F.size(lines) - line_no)))
    return F.when(line_no.between(1, F.size(lines)), F.array_join(whole, "\n"))


def _first_line(test) -> Column:
    """1-based number of the first line passing ``test``, or null."""
    at = F.filter(F.transform("lines", lambda l, i: F.when(test(l), i + 1)), lambda n: n.isNotNull())
    return F.get(at, F.lit(0))


def patches(findings: DataFrame, files: DataFrame) -> DataFrame:
    """(repo, scan_id, ord, fix_kind, path, summary, content): one patched file per fixable finding.

    Only fixable findings meet the files, by (repo, scan, path); the rewrite happens in the row. Each step is a column of its own, computed
    once: the lines, the number of the line to edit, that line, what it becomes, and at last the file.
    """
    f = findings.withColumn("fix_kind", fix_kind()).where(F.col("fix_kind").isNotNull())
    f = f.withColumn("path", F.when(F.col("kind") == "dependency", F.col("source")).otherwise(F.col("file_path")))
    f = f.select("repo", "scan_id", "ord", "fix_kind", "path", "line_no", "package", safe_version(F.col("vulnerable_versions")).alias("safe"))
    j = f.join(files.select("repo", "scan_id", "path", "content"), ["repo", "scan_id", "path"])
    kind, n, pkg, safe, old = F.col("fix_kind"), F.col("line_no"), F.col("package"), F.col("safe"), F.col("old")
    is_dep, is_docker, is_gha = kind == "dep-bump", kind == "dockerfile-baseimage-bump", kind == "gha-permissions-fix"

    # The line to edit: the recorded one, else the first that can be: a supported FROM, a write-all.
    j = once(j, lines=F.split("content", "\n", -1))
    j = once(j, said=F.get("lines", n - 1))
    j = once(j, at=F.when(is_docker, F.when(_bumpable(F.col("said")), n).otherwise(_first_line(_bumpable)))
             .when(is_gha, F.when(F.col("said").rlike(WRITE_ALL), n).otherwise(_first_line(lambda l: l.rlike(WRITE_ALL)))).when(~is_dep, n))
    j = once(j, old=F.get("lines", F.col("at") - 1))

    # Base image: the tag's number becomes the supported one. Literal: read from the environment under the variable's upper-snake name.
    current = F.create_map(*[F.lit(x) for kv in CURRENT_TAG.items() for x in kv])
    py = F.col("path").endswith(".py")
    var = F.when(py, F.regexp_extract(old, PY_ASSIGNMENT, 2)).otherwise(F.regexp_extract(old, JS_ASSIGNMENT, 3))
    j = once(j, ref=F.when(is_docker, from_ref(old)), var=F.when(~is_dep & ~is_docker & ~is_gha, var))
    image, var = F.concat("ref.image", F.lit(":")), F.col("var")
    new_tag = F.concat(F.try_element_at(current, F.col("ref.name")), F.regexp_extract("ref.tag", r"^\d+(?:\.\d+)*(.*)$", 1))
    j = once(j, new_ref=F.concat(image, new_tag), env=F.upper(F.regexp_replace(var, r"([a-z0-9])([A-Z])", "$1_$2")))
    env = F.col("env")
    js_new = F.concat(F.regexp_extract(old, JS_ASSIGNMENT, 1), F.regexp_extract(old, JS_ASSIGNMENT, 2), F.lit(" "), var,
                      F.lit(" = process.env."), env, F.regexp_extract(old, JS_ASSIGNMENT, 6))
    py_new = F.concat(F.regexp_extract(old, PY_ASSIGNMENT, 1), var, F.lit(" = os.environ['"), env, F.lit("']"))
    j = once(j, new=F.when(is_docker, F.replace(old, F.concat(image, F.col("ref.tag")), F.col("new_ref")))
             .when(is_gha, F.regexp_replace(old, WRITE_ALL, "$1permissions:\n$1  contents: read"))
             .when(var != "", F.when(py, py_new).otherwise(js_new)))

    # Dependency bumps: the spec of the named package, its ^ or ~ kept; requirements lines become ==.
    quoted = F.regexp_replace(pkg, r"([.+*?^$()\[\]{}|\\])", r"\\$1")
    npm = F.regexp_replace("content", F.concat(F.lit('("'), quoted, F.lit(r'"\s*:\s*")([\^~]?)[^"]*"')),
                           F.concat(F.lit("$1$2"), safe, F.lit('"')))

    def req(l: Column) -> Column:
        name = F.regexp_extract(strip(l), r"^([A-Za-z0-9_.\-]+)\s*(?:[=<>!~]=|>|<)\s*.+$", 1)
        bumped = bound(name, lambda x: F.when((x != "") & (F.lower(x) == F.lower(pkg)), F.concat(x, F.lit("=="), safe)).otherwise(l))
        return F.when(F.contains(F.lower(l), F.lower(pkg)), bumped).otherwise(l)  # only lines that hold the name are taken apart

    pip = F.array_join(F.transform("lines", req), "\n")
    dep = F.when(F.col("path").endswith("package.json"), npm).otherwise(pip)
    j = once(j, patched=F.when(is_dep, dep).when(F.col("new").isNotNull(), _rewrite(F.col("at"), F.col("new"))))

    summary = (F.when(is_dep, F.concat(F.lit("Bump "), pkg, F.lit(" to "), safe))
               .when(is_docker, F.concat(F.lit("Bump end-of-life base image to "), "new_ref"))
               .when(is_gha, F.lit("Replace permissions: write-all with least-privilege contents: read"))
               .otherwise(F.concat(F.lit("Extract hardcoded secret into "),
                                   F.when(py, F.concat(F.lit("os.environ['"), env, F.lit("']")))
                                   .otherwise(F.concat(F.lit("process.env."), env)))))
    env_line = F.when(kind == "secret-extract", F.concat(env, F.lit("=")))
    j = j.where(F.col("patched").isNotNull() & (F.col("patched") != F.col("content")))
    return j.select("repo", "scan_id", "ord", "fix_kind", "path", summary.alias("summary"), env_line.alias("env_example_line"), "patched")


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """df with the columns, which later steps read and do not compute again: a generator of one row is not merged into what follows."""
    row = F.struct(*[c.alias(name) for name, c in columns.items()])
    return df.select("*", F.inline(F.array(row)))
