"""Supply-chain signals: typosquats, install hooks, registry metadata, scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from fleetrisk.functions.text import strip
from fleetrisk.functions.paths import basename
from fleetrisk.operators.iac import package_scripts
from fleetrisk.operators.lines import numbered
from fleetrisk.plans.derived import dealt
from fleetrisk.schemas import FILE_KEY

CATEGORIES = ["typosquatting", "postinstall", "dependency-confusion", "recently-published", "suspicious-maintainer"]
PENALTY = {"HIGH": 25, "MEDIUM": 10, "LOW": 3}
NPM_SECTIONS = ["dependencies", "devDependencies", "optionalDependencies", "peerDependencies"]
#: Parts that the signals of one scan are spread over.
SALTS = 16
OUT = ["repo", "scan_id", "category", "severity", "package", "file", "pattern", "evidence"]


def _sections(files: DataFrame) -> DataFrame:
    """(file, name, spec) of every dependency map of every package.json."""
    j = F.from_json("content", ", ".join(f"{s} map<string,string>" for s in NPM_SECTIONS))
    f = files.where(F.lower(basename(F.col("path"))) == "package.json").select(*FILE_KEY, j.alias("j"))
    every = F.flatten(F.array_compact(F.array(*[F.map_entries(f"j.{s}") for s in NPM_SECTIONS])))
    return f.select(*FILE_KEY, F.explode(every).alias("e")).select(*FILE_KEY, F.col("e.key").alias("name"), F.col("e.value").alias("spec"))


def declared_names(files: DataFrame) -> DataFrame:
    """(repo, scan_id, path, ecosystem, name), distinct per file, for typosquat matching."""
    base = F.lower(basename(F.col("path")))
    npm = _sections(files).where(~F.col("name").startswith("@")).select(*FILE_KEY, F.lit("npm").alias("ecosystem"), "name")
    word = r"['\"]([A-Za-z0-9_.\-]+)"
    req = F.filter(F.transform(F.split("content", r"\r?\n", -1), lambda l: F.when(
        ~strip(l).rlike(r"^[#-]"), F.regexp_extract(strip(l), r"^([A-Za-z0-9_.\-]+)", 1))), lambda n: n != "")
    project = F.regexp_extract("content", r"(?s)(\[project\].*?)(?:\n\[|\z)", 1)
    toml = F.regexp_extract_all(F.regexp_extract(project, r"(?s)dependencies\s*=\s*\[(.*?)\]", 1), F.lit(word), F.lit(1))
    setup = F.regexp_extract_all(F.regexp_extract("content", r"(?s)install_requires\s*=\s*\[(.*?)\]", 1), F.lit(word), F.lit(1))
    names = F.when(base == "requirements.txt", req).when(base == "pyproject.toml", toml).when(base == "setup.py", setup)
    py = files.where(base.isin("requirements.txt", "pyproject.toml", "setup.py")).select(
        *FILE_KEY, F.lit("pypi").alias("ecosystem"), F.explode(names).alias("name"))
    return npm.unionByName(py).distinct()


def _swaps(s: Column) -> Column:
    """Every form of ``s`` with two neighbours exchanged."""
    i = F.sequence(F.lit(1), F.greatest(F.length(s) - 1, F.lit(1)))
    return F.transform(i, lambda k: F.concat(F.substr(s, F.lit(1), k - 1), F.substr(s, k + 1, F.lit(1)),
                                             F.substr(s, k, F.lit(1)), F.substr(s, k + 2)))


def osa_distance(a: Column, b: Column) -> Column:
    """Optimal string alignment distance when 2 or less, else null.

    Without a swap it is ``levenshtein``. With one, the strings split around it (the places
    differ by at most one) and the two remainders may cost one edit together.
    """
    def rest(x: Column, y: Column) -> Column:
        one = (F.levenshtein(x, y, 1) == 1) | ((F.length(x) == F.length(y)) & F.exists(_swaps(x), lambda s: s == y))
        return F.when(x == y, 0).when(one, 1).otherwise(9)

    def around(k: Column, d: int) -> Column:
        j = k + d
        swap = (j >= 1) & (F.substr(a, k, F.lit(1)) == F.substr(b, j + 1, F.lit(1))) & (
            F.substr(a, k + 1, F.lit(1)) == F.substr(b, j, F.lit(1))) & (j < F.length(b))
        cost = rest(F.substr(a, F.lit(1), k - 1), F.substr(b, F.lit(1), j - 1)) + rest(F.substr(a, k + 2), F.substr(b, j + 2))
        return F.when(swap, cost + 1)

    ks = F.sequence(F.lit(1), F.greatest(F.length(a) - 1, F.lit(1)))
    swapped = F.array_min(F.transform(ks, lambda k: F.least(around(k, -1), around(k, 0), around(k, 1))))
    lev = F.levenshtein(a, b, 2)
    best = F.least(F.when(lev >= 0, lev), swapped)
    return F.when(a == b, 0).when(best <= 2, best)


def _drop_one(w: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(w), F.lit(1))),
                       lambda k: F.concat(F.substr(w, F.lit(1), k - 1), F.substr(w, k + 1)))


def near_keys(s: Column) -> Column:
    """Keys two names share when they are one edit apart, or two apart behind the same three letters.

    Words within n edits (swaps included) have an equal form after removing at most n
    characters each, so an equi-join on the forms replaces comparing all pairs.
    """
    one = F.transform(F.concat(F.array(s), _drop_one(s)), lambda f: F.concat(F.lit("1|"), f))
    tail = F.substr(s, F.lit(4))
    forms = F.concat(F.array(tail), _drop_one(tail), F.flatten(F.transform(_drop_one(tail), _drop_one)))
    two = F.transform(forms, lambda f: F.concat(F.lit("2|"), F.substring(s, 1, 3), F.lit("|"), f))
    return F.array_distinct(F.when(F.length(s) >= 3, F.concat(one, two)).otherwise(one))


def typosquats(files: DataFrame, popular: DataFrame) -> DataFrame:
    """Declared names that nearly equal a popular one.

    Distinct names of the fleet are matched once, through an equi-join on shared forms; the
    nearest (distance, rank) target per name returns to the declaring files.
    """
    decl = declared_names(files)
    pop = popular.select(F.lower("ecosystem").alias("ecosystem"), F.col("name").alias("target"), "rank").withColumn("tl", F.lower("target"))
    names = decl.select("ecosystem", "name").distinct().withColumn("nl", F.lower("name"))
    exact = names.join(pop, (names.ecosystem == pop.ecosystem) & (F.col("nl") == F.col("tl"))).select(
        names.ecosystem, "name", "nl", "target", "rank")
    folded = exact.where(F.col("name") != F.col("target")).groupBy("ecosystem", "name").agg(
        F.min_by(F.struct("target", "rank", F.lit(0).alias("distance"), F.lit("case-fold").alias("pattern")), "rank").alias("m"))
    rest = names.join(exact.select("ecosystem", "nl").distinct(), ["ecosystem", "nl"], "left_anti")
    left = rest.withColumn("form", F.explode(near_keys(F.col("nl"))))
    right = pop.withColumn("form", F.explode(near_keys(F.col("tl"))))
    cand = left.join(right, ["ecosystem", "form"]).where(F.abs(F.length("nl") - F.length("tl")) <= 2)
    cand = cand.select("ecosystem", "name", "nl", "target", "tl", "rank").distinct().withColumn("d", osa_distance(F.col("nl"), F.col("tl")))
    prefix = (F.length("nl") >= 3) & (F.length("tl") >= 3) & (F.substring("nl", 1, 3) == F.substring("tl", 1, 3))
    pat = F.when(F.col("d") == 1, "edit-distance-1").when((F.col("d") == 2) & prefix, "edit-distance-2-prefix")
    near = cand.withColumn("p", pat).where(F.col("p").isNotNull()).groupBy("ecosystem", "name").agg(
        F.min_by(F.struct("target", "rank", F.col("d").alias("distance"), F.col("p").alias("pattern")),
                 F.struct("d", "rank", "target")).alias("m"))
    best = folded.unionByName(near)
    r, pattern = F.col("m.rank"), F.col("m.pattern")
    severity = (F.when(pattern == "case-fold", "HIGH")
                .when(pattern == "edit-distance-1", F.when(r <= 100, "HIGH").when(r <= 1000, "MEDIUM").otherwise("LOW"))
                .otherwise(F.when(r <= 100, "MEDIUM").otherwise("LOW")))
    return decl.join(best, ["ecosystem", "name"]).select(
        "repo", "scan_id", F.lit("typosquatting").alias("category"), severity.alias("severity"), F.col("name").alias("package"),
        F.col("path").alias("file"), pattern.alias("pattern"),
        F.concat("name", F.lit(" -> "), "m.target", F.lit(" (distance="), F.col("m.distance").cast("string"),
                 F.lit(", ecosystem="), "ecosystem", F.lit(")")).alias("evidence"))


# Hooks and patterns of npm install scripts.
NPM_HOOKS = ["preinstall", "install", "postinstall", "prepare", "prepublish", "prepublishOnly", "prerestart", "prestart", "predev"]
NPM_PATTERNS = {
    "pipe": r"(?i)\b(?:curl|wget)\b[^|;]*\|\s*(?:ba)?sh\b", "eval": r"(?i)\beval\s*\(",
    "decode": r"(?i)(\batob\s*\(|\bBuffer\.from\s*\([^)]*['\"]base64['\"])", "env": r"(?i)\bprocess\.env\b",
    "net": r"(?i)(\bfetch\s*\(|\bhttps?\.(?:get|request|post|put|delete)\s*\(|\baxios\s*[\(.]|\brequire\s*\(\s*['\"]https?['\"])",
    "shell_net": r"(?i)\b(?:wget|curl)\b", "remote_require": r"(?i)\brequire\s*\(\s*['\"]https?:",
}
# Setuptools command classes and patterns of Python build hooks.
PY_PARENTS = ["install", "develop", "build_py", "build_ext", "build_clib", "build_scripts", "sdist", "bdist_egg",
              "bdist_wheel", "egg_info", "install_lib", "install_scripts", "install_data", "install_headers", "test"]
_SHELL = r"\b(?:subprocess\.[a-zA-Z_]+|os\.(?:system|popen))\s*\("
PY_PATTERNS = {
    "pipe": r"(?i)" + _SHELL + r"\s*[fr]?[\"'][^\"']*\b(?:curl|wget)\b[^\"']*\|\s*(?:ba)?sh\b",
    "eval": r"\b(?:eval|exec)\s*\(", "decode": r"\b(?:base64\.b64decode|codecs\.decode)\s*\(", "env": r"\bos\.environ(?:\b|\.)",
    "net": r"\b(?:urllib(?:\.\w+)*\.urlopen|urllib\.request\.\w+|requests\.(?:get|post|put|delete|request|head|patch)|socket\.socket|httpx?\.(?:get|post|put|delete|request|head|patch|stream|Client|AsyncClient)|http\.client\.\w+|urllib3\.\w+|aiohttp\.\w+)",
    "shell_net": r"(?i)" + _SHELL + r"\s*[fr]?[\"'][^\"']*\b(?:curl|wget)\b",
}


def _hook_findings(df: DataFrame, body: Column, p: dict[str, str], chain: Column, preview: Column) -> DataFrame:
    """HIGH patterns; the network pattern only without a HIGH one; long chains always."""
    has = {k: body.rlike(v) for k, v in p.items()}
    pipe, decode, exfil = has["pipe"], has["eval"] & has["decode"], has["env"] & has["net"]
    network = reduce(lambda a, b: a | b, [has[k] for k in ("net", "shell_net", "remote_require") if k in has])
    rules = [(pipe, "HIGH", "pipe-to-shell"), (decode, "HIGH", "decode-and-exec"), (exfil, "HIGH", "env-exfil"),
             (network & ~(pipe | decode | exfil), "MEDIUM", "network-in-hook"), (chain, "LOW", "command-chain")]
    hits = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(s).alias("severity"), F.lit(n).alias("pattern"))) for c, s, n in rules]))
    cut = F.when(F.length(preview) > 120, F.concat(F.substring(preview, 1, 120), F.lit("..."))).otherwise(preview)
    df = df.withColumn("_e", F.concat(F.lit("hook="), "hook", F.lit(": "), cut)).withColumn("h", F.explode(hits))
    return df.select("repo", "scan_id", F.lit("postinstall").alias("category"), "h.severity", F.lit(None).cast("string").alias("package"),
                     F.col("path").alias("file"), "h.pattern", F.col("_e").alias("evidence"))


def npm_hooks(files: DataFrame) -> DataFrame:
    s = package_scripts(files.where(~F.col("path").contains("node_modules/")))
    s = s.where(F.col("hook").isin(NPM_HOOKS) & (strip("script") != ""))
    segs = F.filter(F.split("script", r"\s*(?:&&|\|\||;)\s*"), lambda x: strip(x).rlike(r"^[a-zA-Z][a-zA-Z0-9_\-]*\b"))
    return _hook_findings(s, F.col("script"), NPM_PATTERNS, F.size(segs) >= 4, F.col("script"))


def python_hooks(files: DataFrame) -> DataFrame:
    """Bodies of setuptools command classes in setup.py, and pyproject.toml as one body.

    Blocks are cut inside the file's row: a class line opens one, the next line that starts in
    column one closes it.
    """
    base = F.lower(basename(F.col("path")))
    f = files.where(base.isin("setup.py", "pyproject.toml") & ~F.col("path").contains("node_modules/"))
    rows = numbered(F.col("content"), lambda l: {
        "hook": F.regexp_extract(F.regexp_extract(l, r"^class\s+\w+\s*\(([^)]*)\)\s*:", 1), r"\b(" + "|".join(PY_PARENTS) + r")\b", 1),
        "top": l.rlike(r"^[A-Za-z_@]")})
    f = f.select(*FILE_KEY, "content", base.alias("b"), rows.alias("rows"))
    opens = F.filter("rows", lambda x: x["hook"] != "")

    def block(o: Column) -> Column:
        after = F.slice("rows", o["n"] + 1, F.size("rows"))
        end = F.get(F.filter(after, lambda x: x["top"]), F.lit(0))["n"]
        size = F.coalesce(end, F.size("rows") + 1) - o["n"] - 1
        body = F.array_join(F.transform(F.slice("rows", o["n"] + 1, size), lambda x: x["line"]), "\n")
        return F.struct(o["hook"].alias("hook"), body.alias("body"))

    whole = F.array(F.struct(F.lit("pyproject").alias("hook"), F.col("content").alias("body")))
    hooks = F.when(F.col("b") == "setup.py", F.transform(opens, block)).otherwise(whole)
    h = f.select(*FILE_KEY, F.explode(hooks).alias("x")).select(*FILE_KEY, "x.*").where(strip("body") != "")
    calls = F.size(F.regexp_extract_all("body", F.lit(f"({_SHELL})"), F.lit(1)))
    lines = F.filter(F.transform(F.split("body", "\n"), lambda l: strip(l)), lambda l: l != "")
    shown = F.filter(lines, lambda l: ~l.rlike(r"^(?:def\s|class\s|@|#|\"\"\"|''')"))
    preview = F.coalesce(F.get(shown, F.lit(0)), F.get(lines, F.lit(0)), F.lit(""))
    return _hook_findings(h, F.col("body"), PY_PATTERNS, calls >= 4, preview)


def is_registry_spec(spec: Column) -> Column:
    s = strip(spec)
    return (s != "") & ~s.rlike(r"(?i)^(?:file:|link:|workspace:|git\+|github:|git:|https?:|\.{0,2}/|portal:)")


def registry_names(files: DataFrame) -> DataFrame:
    """Names resolved from the registry, with the first declaring file per repository."""
    d = _sections(files).where(is_registry_spec(F.col("spec"))).select("repo", "scan_id", "name", "path")
    return dealt(d, "repo", "scan_id", "name").groupBy("repo", "scan_id", "name").agg(F.min("path").alias("file"))


def registry_signals(files: DataFrame, meta: DataFrame, as_of: Column) -> DataFrame:
    """Unpublished, newly published, deprecated or unmaintained dependencies. Unknown names give nothing."""
    d = registry_names(files).join(meta, "name")
    age = (F.unix_timestamp(as_of) - F.unix_timestamp("created")) / 86400
    ok = F.col("status") == 200
    n = F.coalesce(F.when(F.size("maintainers") >= 0, F.size("maintainers")), F.lit(0))
    dep = F.coalesce("deprecated", F.lit(False))
    s = lambda cat, sv, pat, ev: F.struct(F.lit(cat).alias("category"), sv.alias("severity"), pat.alias("pattern"), ev.alias("evidence"))
    rules = [
        F.when(F.col("status") == 404, s("dependency-confusion", F.lit("HIGH"), F.lit("name-unpublished-on-public-registry"),
                                         F.concat(F.lit("GET "), "name", F.lit(" → 404")))),
        F.when(ok & age.between(0, 30), s("recently-published", F.lit("MEDIUM"), F.lit("package-recently-created"),
                                          F.concat(F.lit("registry time.created = "), F.col("created").cast("string")))),
        F.when(ok & (dep | (n == 0)), s("suspicious-maintainer", F.when(dep, "MEDIUM").otherwise("LOW"),
                                        F.when(dep, "package-deprecated").otherwise("no-maintainers-listed"),
                                        F.when(dep, "dist-tags.latest is deprecated").otherwise("maintainers = []"))),
    ]
    return d.select("repo", "scan_id", F.col("name").alias("package"), "file", F.explode(F.array_compact(F.array(*rules))).alias("h")).select(
        "repo", "scan_id", "h.category", "h.severity", "package", "file", "h.pattern", "h.evidence")


def level(score: Column) -> Column:
    return F.when(score >= 90, "excellent").when(score >= 70, "good").when(score >= 50, "needs-attention").otherwise("critical")


def _points(severity: Column) -> Column:
    return reduce(lambda c, kv: c.when(severity == kv[0], kv[1]), PENALTY.items(), F.when(F.lit(False), 0)).otherwise(0)


def _score(cost: Column) -> Column:
    return F.greatest(F.lit(0), 100 - cost).cast("int")


def _per_scan(findings: DataFrame, scans: DataFrame | None, sums: dict[str, Column]) -> DataFrame:
    """(repo, scan_id, sums) of the signals of every scan; a scan of ``scans`` without a signal has zeros.

    Scans are as many as the fleet has, so the rows are dealt as wide as the session's shuffles, whatever size adaptive execution would
    join the parts to: what a task holds is its share of the scans. A scan with very many signals is summed in salted parts first.
    """
    salt = F.pmod(F.xxhash64(*[c for c in ("file", "package", "evidence") if c in findings.columns]), F.lit(SALTS))
    f = dealt(findings.select("repo", "scan_id", "category", "severity", salt.alias("salt")), "repo", "scan_id", "salt")
    rows = f.groupBy("repo", "scan_id", "salt").agg(*[F.sum(c.cast("bigint")).alias(k) for k, c in sums.items()]).drop("salt")
    if scans is not None:
        rows = rows.unionByName(scans.select("repo", "scan_id").distinct().select("repo", "scan_id", *[F.lit(0).cast("bigint").alias(k) for k in sums]))
    return dealt(rows, "repo", "scan_id").groupBy("repo", "scan_id").agg(*[F.sum(k).alias(k) for k in sums])


def supply_scores(findings: DataFrame, scans: DataFrame | None = None) -> DataFrame:
    """Score, signals and level per scan; with ``scans`` those without a signal score 100."""
    severity = F.col("severity")
    f = _per_scan(findings, scans, {"cost": _points(severity), "n": F.when(severity.isNotNull(), 1).otherwise(0)})
    return f.select("repo", "scan_id", _score(F.col("cost")).alias("score"), "n").withColumn("level", level(F.col("score")))


def supply_breakdown(findings: DataFrame, scans: DataFrame | None = None) -> DataFrame:
    """Score and severity counts for each of the five categories; empty ones score 100."""
    def count(cond: Column) -> Column:
        return F.when(cond, 1).otherwise(0)

    mine = {f"c{i}": F.col("category") == c for i, c in enumerate(CATEGORIES)}
    sums = {k: count(m) for k, m in mine.items()} | {f"{k}_{s}": count(m & (F.col("severity") == s)) for k, m in mine.items() for s in PENALTY}
    per = []
    for k, c in zip(mine, CATEGORIES):
        cost = reduce(lambda a, b: a + b, [F.col(f"{k}_{s}") * p for s, p in PENALTY.items()])
        per.append(F.struct(F.lit(c).alias("category"), _score(cost).alias("score"), F.col(k).alias("n"), *[F.col(f"{k}_{s}").alias(s.lower()) for s in PENALTY]))
    return _per_scan(findings, scans, sums).select("repo", "scan_id", F.inline(F.array(*per)))


def manifests_scanned(files: DataFrame) -> DataFrame:
    b = F.lower(basename(F.col("path")))
    return files.groupBy("repo", "scan_id").agg(
        F.count_if(b == "package.json").alias("package_json"), F.count_if(b == "setup.py").alias("setup_py"),
        F.count_if(b == "pyproject.toml").alias("pyproject"))


def worst(findings: DataFrame, k: int = 5) -> DataFrame:
    """The first ``k`` per scan by severity."""
    from pyspark.sql import Window
    rank = F.when(F.col("severity") == "HIGH", 0).when(F.col("severity") == "MEDIUM", 1).otherwise(2)
    w = Window.partitionBy("repo", "scan_id").orderBy(rank, "category", "file", "package", "pattern", "evidence")
    return findings.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
