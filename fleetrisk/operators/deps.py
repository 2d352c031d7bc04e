"""Dependency inventory from manifests, and advisory joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from fleetrisk.functions.text import bound, strip
from fleetrisk.functions import severity as sev
from fleetrisk.functions.versions import in_interval, in_range, interval_text, intervals, keyed, parse_range, version_key
from fleetrisk.operators.lines import explode_lines, fold_hits
from fleetrisk.operators.score import every_scan
from fleetrisk.plans.materialise import materialise
from fleetrisk.schemas import DEPENDENCIES, as_findings, conform

KEY = ["repo", "scan_id"]
# Manifest to ecosystem.
ECOSYSTEM = {
    "package.json": "npm", "package-lock.json": "npm", "requirements.txt": "PyPI", "pyproject.toml": "PyPI",
    "Pipfile": "PyPI", "go.mod": "Go", "Gemfile.lock": "RubyGems", "pom.xml": "Maven", "build.gradle": "Maven",
    "build.gradle.kts": "Maven", "composer.lock": "Packagist",
}
#: Heights of the tree over a package's versions: up to 2^30 of them.
_HEIGHTS = 30
_NAME = r"[A-Za-z0-9][A-Za-z0-9._-]*"
_PINNED = r"==\s*([0-9][A-Za-z0-9._+!-]*)"
_SEMVER_IN = r"\d+(?:\.\d+){0,2}(?:-[A-Za-z0-9.-]+)?"


def _root(files: DataFrame, *names: str) -> DataFrame:
    return files.where(F.col("path").isin(*names))


def _deps(df: DataFrame, source: str, name: Column, version: Column, transitive: Column | None = None,
          dev: Column | None = None) -> DataFrame:
    f = F.lit(False)
    d = conform(df, DEPENDENCIES, ecosystem=F.lit(ECOSYSTEM[source]), name=name, version=version, source=F.lit(source),
                is_transitive=transitive if transitive is not None else f, is_dev=dev if dev is not None else f)
    return d.where((F.col("name") != "") & (F.col("version") != ""))


def package_json(files: DataFrame) -> DataFrame:
    """dependencies, devDependencies and optionalDependencies with the first X.Y.Z of each spec."""
    sections = [("dependencies", False), ("devDependencies", True), ("optionalDependencies", False)]
    j = F.from_json("content", ", ".join(f"{s} map<string,string>" for s, _ in sections))
    f = _root(files, "package.json").select(*KEY, j.alias("j"))

    def entries(section: str, dev: bool) -> Column:
        return F.transform(F.map_entries(f"j.{section}"),
                           lambda e: F.struct(e["key"].alias("name"), e["value"].alias("spec"), F.lit(dev).alias("dev")))

    every = F.flatten(F.array_compact(F.array(*[entries(*s) for s in sections])))
    d = f.select(*KEY, F.explode(every).alias("d"))
    return _deps(d, "package.json", F.col("d.name"), F.regexp_extract("d.spec", f"({_SEMVER_IN})", 1), dev=F.col("d.dev"))


LOCK_PACKAGES = "packages map<string,struct<version:string,dev:boolean,devOptional:boolean,license:string>>"


def lock_packages(files: DataFrame) -> DataFrame:
    """(repo, scan_id, path_in_lock, name, e) per entry of a v2/v3 npm lockfile."""
    f = _root(files, "package-lock.json").select(*KEY, F.from_json("content", LOCK_PACKAGES)["packages"].alias("p"))
    f = f.select(*KEY, F.explode("p").alias("lock_path", "e"))
    return f.where(F.col("lock_path").contains("node_modules/")).withColumn("name", F.substring_index("lock_path", "node_modules/", -1))


def nested_in_lock(lock_path: Column) -> Column:
    """More than one node_modules segment: brought in by another package."""
    return F.instr(lock_path, "node_modules/") < F.length(lock_path) - F.length(F.substring_index(lock_path, "node_modules/", -1)) - 12


def _v1(old: DataFrame) -> DataFrame:
    """Entries of v1 lockfiles, which nest to any depth: the ``dependencies`` text of a level's entries is opened as the next level.

    An object is read as a map of texts first, so that an entry that is no object is only left out itself. As many rounds as the deepest file.
    """
    def opened(rows: DataFrame, text: Column, depth: int) -> DataFrame:
        each = rows.select(*KEY, F.explode(F.from_json(text, "map<string,string>")).alias("name", "raw")).where(F.trim("raw").startswith("{"))
        return each.select(*KEY, "name", F.from_json("raw", "version string, dev string, dependencies string").alias("e"), F.lit(depth > 0).alias("is_transitive"))

    level, found, depth = materialise(opened(old, F.from_json("content", "dependencies string")["dependencies"], 0)), [], 0
    while True:
        found.append(level.where(F.col("e.version") != "").select(*KEY, "name", F.col("e.version").alias("version"), "is_transitive", (F.col("e.dev") == "true").alias("is_dev")))
        below = level.where(F.trim("e.dependencies").startswith("{"))
        if below.isEmpty():
            return reduce(DataFrame.unionByName, found)
        depth += 1
        level = materialise(opened(below, F.col("e.dependencies"), depth))


def package_lock(files: DataFrame) -> DataFrame:
    """v2/v3 through from_json; files without a packages map fall back to the nested v1 form."""
    p = lock_packages(files)
    v2 = _deps(p, "package-lock.json", F.col("name"), F.col("e.version"), nested_in_lock(F.col("lock_path")),
               F.coalesce(F.col("e.dev"), F.lit(False)))
    old = _root(files, "package-lock.json").where(
        F.coalesce(F.size(F.from_json("content", LOCK_PACKAGES)["packages"]), F.lit(0)) <= 0)
    v1 = _v1(old.select(*KEY, "content"))
    return v2.unionByName(_deps(v1, "package-lock.json", F.col("name"), F.col("version"), F.col("is_transitive"), F.coalesce("is_dev", F.lit(False))))


def requirements_txt(files: DataFrame) -> DataFrame:
    """Only ``==`` pins; comments, options, markers and hashes are dropped."""
    lines = explode_lines(_root(files, "requirements.txt"))
    t = strip(F.replace("line", F.lit("\r"), F.lit("")))
    lines = lines.where(t.contains("==") & (t != "") & ~t.startswith("#") & ~t.startswith("-"))
    body = F.substring_index(F.substring_index(F.regexp_replace(t, r"\s#.*$", ""), ";", 1), " --hash=", 1)

    def pin(body: Column) -> Column:
        return bound(F.regexp_extract(body, f"^({_NAME})", 1), lambda name: F.struct(
            F.lower(name).alias("name"), F.regexp_extract(F.substr(body, F.length(name) + 1), _PINNED, 1).alias("version")))

    # A generator of one row: the filter on the columns stays above it, so that no line is taken apart a second time for it.
    lines = lines.select(*KEY, F.inline(F.array(bound(body, pin))))
    return _deps(lines, "requirements.txt", F.col("name"), F.col("version"))


def _table_entries(files: DataFrame, source: str, header: str, version) -> DataFrame:
    """``name = "spec"`` lines below a TOML header, up to the next header."""
    rows = fold_hits(
        _root(files, source),
        lambda l: {"head": l.startswith("["), "mine": l.rlike(header), "kv": l.rlike(rf"^\s*{_NAME}\s*=\s*[\"'][^\"']+[\"']")},
        {"inside": F.lit(False)},
        lambda s, x: ({"inside": F.when(x["mine"], True).when(x["head"], False).otherwise(s["inside"])},
                      s["inside"] & ~x["head"] & x["kv"]))
    name = F.lower(F.regexp_extract("line", rf"^\s*({_NAME})\s*=", 1))
    spec = strip(F.regexp_extract("line", r"=\s*[\"']([^\"']+)[\"']", 1))
    return _deps(rows, source, name, version(spec))


def _pin(spec: Column, ops: str) -> Column:
    bare = F.when(spec.startswith("=="), spec).otherwise(F.concat(F.lit("=="), F.regexp_replace(spec, ops, "")))
    return F.regexp_extract(bare, _PINNED, 1)


def pyproject_toml(files: DataFrame) -> DataFrame:
    """PEP 621 dependency arrays (exact pins) and Poetry tables (operators stripped)."""
    f = _root(files, "pyproject.toml")
    block = F.regexp_extract("content", r"(?s)dependencies\s*=\s*\[(.*?)\]", 1)
    items = f.select(*KEY, F.explode(F.regexp_extract_all(block, F.lit(r'"([^"]+)"'), F.lit(1))).alias("i"))
    i = strip("i")
    name = F.regexp_extract(i, f"^({_NAME})", 1)
    pep = _deps(items, "pyproject.toml", F.lower(name), F.regexp_extract(F.substr(i, F.length(name) + 1), _PINNED, 1))
    poetry = _table_entries(files, "pyproject.toml", r"^\[tool\.poetry\.(?:dev-)?dependencies\]", lambda s: _pin(s, r"^[\^~>=<!]+"))
    return pep.unionByName(poetry.where(F.col("name") != "python"))


def pipfile(files: DataFrame) -> DataFrame:
    return _table_entries(files, "Pipfile", r"^\[(?:dev-)?packages\]", lambda s: _pin(s, r"^[\^~>=<!*]+"))


def go_mod(files: DataFrame) -> DataFrame:
    """Block and single requires; leading v and +incompatible stripped."""
    rows = fold_hits(
        _root(files, "go.mod"),
        lambda l: {"skip": (strip(l) == "") | strip(l).startswith("//"), "open": strip(l).startswith("require ("),
                   "close": strip(l) == ")", "single": strip(l).startswith("require ")},
        {"inside": F.lit(False)},
        lambda s, x: ({"inside": F.when(x["open"], True).when(x["close"], False).otherwise(s["inside"])},
                      ~x["skip"] & ~x["open"] & ((s["inside"] & ~x["close"]) | (~s["inside"] & x["single"]))))
    t = strip(F.regexp_replace(strip(F.regexp_replace("line", r"\s+", " ")), r"^require ", ""))
    parts = F.split(strip(F.regexp_replace(t, r"//.*$", "")), " ")
    version = F.coalesce(F.get(parts, F.lit(1)), F.lit(""))
    rows = rows.withColumn("n", F.get(parts, F.lit(0))).withColumn("v", version).where(F.col("v").startswith("v"))
    return _deps(rows, "go.mod", F.col("n"), F.regexp_replace(F.regexp_replace("v", "^v", ""), r"\+incompatible$", ""))


def gemfile_lock(files: DataFrame) -> DataFrame:
    """Entries indented by exactly four spaces below ``specs:``."""
    entry = rf"^ {{4}}({_NAME}) \(([0-9][A-Za-z0-9._-]*)\)\s*$"
    rows = fold_hits(
        _root(files, "Gemfile.lock"),
        lambda l: {"open": strip(l) == "specs:", "end": (strip(l) == "") | l.rlike("^[A-Z]"), "gem": l.rlike(entry)},
        {"inside": F.lit(False)},
        lambda s, x: ({"inside": F.when(x["open"], True).when(x["end"], False).otherwise(s["inside"])}, s["inside"] & ~x["open"] & ~x["end"] & x["gem"]))
    return _deps(rows, "Gemfile.lock", F.regexp_extract("line", entry, 1), F.regexp_extract("line", entry, 2))


def pom_xml(files: DataFrame) -> DataFrame:
    blocks = _root(files, "pom.xml").select(*KEY, F.explode(F.regexp_extract_all(
        "content", F.lit(r"(?s)(<dependency>.*?</dependency>)"), F.lit(1))).alias("b"))

    def tag(t: str) -> Column:
        return strip(F.regexp_extract("b", rf"<{t}>\s*([^<\s][^<]*?)\s*</{t}>", 1))

    blocks = blocks.where((tag("groupId") != "") & (tag("artifactId") != "") & ~tag("version").contains("${"))
    return _deps(blocks, "pom.xml", F.concat(tag("groupId"), F.lit(":"), tag("artifactId")), tag("version"))


def gradle(files: DataFrame) -> DataFrame:
    """'group:name:version' strings and the map form; dynamic versions skipped."""
    f = _root(files, "build.gradle", "build.gradle.kts")
    coord = r"['\"]([A-Za-z0-9_.-]+):([A-Za-z0-9_.-]+):([A-Za-z0-9_.+-]+?)(?::[A-Za-z0-9_.-]+)?['\"]"
    hits = f.select(*KEY, F.explode(F.regexp_extract_all("content", F.lit(coord), F.lit(0))).alias("c"))
    strings = hits.select(*KEY, *[F.regexp_extract("c", coord, i).alias(n) for i, n in ((1, "g"), (2, "a"), (3, "v"))])
    field = lambda k: F.regexp_extract("line", rf"\b{k}\s*[:=]\s*['\"]([^'\"]+)['\"]", 1)
    maps = explode_lines(f, KEY).where(F.col("line").rlike(r"\bgroup\s*[:=]") & F.col("line").rlike(r"\bname\s*[:=]"))
    maps = maps.select(*KEY, field("group").alias("g"), field("name").alias("a"), field("version").alias("v"))
    both = strings.unionByName(maps).where((F.col("g") != "") & (F.col("a") != "") & ~F.col("v").rlike(r"(?i)[$+]|latest"))
    return _deps(both, "build.gradle", F.concat("g", F.lit(":"), "a"), F.col("v"))


def composer_lock(files: DataFrame) -> DataFrame:
    """packages and packages-dev; a leading v stripped, branch versions skipped."""
    pkg = "array<struct<name:string,version:string>>"
    f = _root(files, "composer.lock").select(*KEY, F.from_json("content", f"packages {pkg}, `packages-dev` {pkg}").alias("j"))
    empty = F.expr(f"cast(array() as {pkg})")
    d = f.select(*KEY, F.explode(F.concat(F.coalesce("j.packages", empty), F.coalesce("j.packages-dev", empty))).alias("d"))
    v = strip(F.regexp_replace("d.version", "^v", ""))
    return _deps(d.where(~v.startswith("dev-") & ~v.contains("@")), "composer.lock", F.col("d.name"), v)


def npm_inventory(files: DataFrame) -> DataFrame:
    """Lockfile rows; scans whose lockfile yields nothing fall back to package.json."""
    lock = package_lock(files)
    return lock.unionByName(package_json(files).join(lock.select(*KEY).distinct(), KEY, "left_anti"))


def inventory(files: DataFrame) -> DataFrame:
    parts = [npm_inventory(files), requirements_txt(files), pyproject_toml(files), pipfile(files), go_mod(files),
             gemfile_lock(files), pom_xml(files), gradle(files), composer_lock(files)]
    return reduce(lambda a, b: a.unionByName(b), parts)


def dedupe(deps: DataFrame, cap: int | None = None) -> DataFrame:
    """One row per name@version: direct over transitive, production over dev. The cap is optional."""
    d = deps.groupBy(*KEY, "ecosystem", "name", "version").agg(
        F.bool_and("is_transitive").alias("is_transitive"), F.bool_and("is_dev").alias("is_dev"),
        F.min("source").alias("source"))
    if cap is not None:
        w = Window.partitionBy(*KEY, "ecosystem").orderBy("name", "version")
        d = d.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= cap).drop("_n")
    return conform(d, DEPENDENCIES)


# ---- advisories

def npm_findings(deps: DataFrame, advisories: DataFrame, strict: bool = True) -> DataFrame:
    """npm advisories per installed version; ``strict`` tests the vulnerable range.

    Distinct (name, version) pairs of the whole fleet meet the advisories once; the matches
    then return to the repositories. A package half the fleet uses is a single row in that join.
    """
    npm = deps.where(F.col("ecosystem") == "npm")
    adv = advisories.withColumnRenamed("package", "name").withColumn("_range", parse_range(F.col("vulnerable_versions")))
    uniq = npm.select("name", "version").distinct().withColumn("_vk", version_key(F.col("version")))
    m = uniq.join(adv, "name")
    if strict:
        m = m.where(in_range(F.col("_vk"), F.col("_range")))
    m = m.drop("_vk", "_range")
    j = npm.join(m, ["name", "version"])
    return as_findings(j, "dependency", rule_id=F.col("name"), package=F.col("name"), severity=sev.normalize(F.col("severity")),
                       ghsa=F.nullif(F.regexp_extract("url", r"(GHSA-[\w-]+)", 1), F.lit("")))


def osv_affected(osv: DataFrame) -> DataFrame:
    """One row per (advisory, package): ecosystem, name, intervals, versions, range text and details."""
    a = osv.select("id", "summary", "aliases", "severity", "database_specific", "references", F.explode("affected").alias("a"))
    ranged = F.filter(F.coalesce("a.ranges", F.expr("cast(array() as array<struct<type:string,events:array<struct<introduced:string,fixed:string,last_affected:string>>>>)")),
                      lambda r: F.coalesce(r["type"], F.lit("")) != "GIT")
    iv = F.flatten(F.transform(ranged, lambda r: intervals(r["events"])))
    a = a.withColumn("iv", iv)
    text = F.array_join(F.transform("iv", interval_text), " or ")
    ghsa = F.coalesce(F.when(F.col("id").startswith("GHSA-"), F.col("id")), F.get(F.filter("aliases", lambda x: x.startswith("GHSA-")), F.lit(0)))
    cvss = F.get(F.filter("severity", lambda s: s["type"].startswith("CVSS")), F.lit(0))["score"].try_cast("double")
    db = F.col("database_specific.severity")
    ref = F.get(F.filter("references", lambda r: r["type"] == "ADVISORY"), F.lit(0))["url"]
    url = (F.when(ghsa.isNotNull(), F.concat(F.lit("https://github.com/advisories/"), ghsa))
           .when(F.col("id").startswith("GO-"), F.concat(F.lit("https://pkg.go.dev/vuln/"), "id"))
           .otherwise(F.coalesce(ref, F.concat(F.lit("https://osv.dev/vulnerability/"), "id"))))
    return a.select(
        "id", F.col("a.package.ecosystem").alias("ecosystem"), F.col("a.package.name").alias("name"), keyed(F.col("iv")).alias("iv"),
        F.col("a.versions").alias("versions"), F.when(text == "", "unknown").otherwise(text).alias("vulnerable_versions"),
        F.coalesce("summary", "id").alias("title"), ghsa.alias("ghsa"), cvss.alias("cvss_score"), url.alias("url"),
        F.when(db.isNotNull() | cvss.isNull(), sev.normalize(db)).otherwise(sev.from_cvss(cvss)).alias("severity"),
        (db.isNull() & cvss.isNull()).alias("severity_unknown"))


def is_affected() -> Column:
    """The installed version lies in one of the advisory's intervals or in its version list."""
    listed = F.coalesce(F.array_contains("versions", F.col("version")), F.lit(False))
    return listed | F.exists("iv", lambda x: in_interval(F.col("vk"), x))


def version_matches(versions: DataFrame, affected: DataFrame) -> DataFrame:
    """(ecosystem, name, version, adv): each version of a package with each advisory row that affects it, once.

    ``versions(ecosystem, name, version)`` distinct, ``affected`` of ``osv_affected`` with a row number ``adv``. Not each version of a package
    with each of its advisories: versions are ranked once in the order of their keys, an interval becomes a range of ranks, a range the few
    nodes of a binary tree over the ranks that make it up, and a version meets the nodes above it by an equi-join. Every row that this join
    gives is a match; work follows the versions, the intervals and the matches.
    """
    pkg = ["ecosystem", "name"]
    # Kept: a filter on the keys would be pushed below the distinct and make a key for each row of the inventory, in each of the readings below.
    v = materialise(versions.withColumn("vk", version_key(F.col("version"))))
    listed = affected.select(*pkg, "adv", F.explode("versions").alias("version")).join(v.select(*pkg, "version"), [*pkg, "version"])
    iv = affected.select(*pkg, "adv", F.posexplode("iv").alias("nth", "x"))
    # A bound that cannot be read satisfies nothing.
    iv = iv.where((F.col("x.open_lo") | F.col("x.lo").isNotNull()) & (~F.col("x.has_fixed") | F.col("x.fixed").isNotNull()) & (~F.col("x.has_last") | F.col("x.last").isNotNull()))
    unbounded = F.col("x.open_lo") & ~F.col("x.has_fixed") & ~F.col("x.has_last")
    any_version = v.where("vk IS NULL").select(*pkg, "version").join(iv.where(unbounded).select(*pkg, "adv"), pkg)

    # Versions and bounds in one order; a bound's rank is the number of versions before it: below the first and an exclusive end, up to an inclusive one.
    none = F.lit(None).cast("bigint")
    bound = lambda side, tie, key: F.when(key.isNotNull(), F.struct(F.lit(side).alias("side"), F.lit(tie).alias("tie"), key.alias("vk")))
    ends = F.array_compact(F.array(bound("lo", 0, F.when(~F.col("x.open_lo"), F.col("x.lo"))), bound("fixed", 0, F.col("x.fixed")), bound("last", 2, F.col("x.last"))))
    points = iv.select(*pkg, "adv", "nth", F.explode(ends).alias("e")).select(*pkg, "e.vk", "e.tie", "e.side", "adv", "nth", F.lit(None).cast("string").alias("version"))
    points = points.unionByName(v.where("vk IS NOT NULL").select(*pkg, "vk", F.lit(1).alias("tie"), F.lit("v").alias("side"), none.alias("adv"), F.lit(None).cast("int").alias("nth"), "version"))
    is_version = (F.col("tie") == 1).cast("bigint")
    before = F.sum(is_version).over(Window.partitionBy(*pkg).orderBy("vk", "tie", "version").rowsBetween(Window.unboundedPreceding, 0)) - is_version
    points = points.withColumn("rank", before)
    ranked = points.where("tie = 1").select(*pkg, "version", "rank")
    bounds = points.where("tie <> 1").groupBy(*pkg, "adv", "nth").agg(*[F.max(F.when(F.col("side") == s, F.col("rank"))).alias(s) for s in ("lo", "fixed", "last")])
    many = ranked.groupBy(*pkg).agg(F.count("*").alias("many"))
    ranges = iv.select(*pkg, "adv", "nth").join(bounds, [*pkg, "adv", "nth"], "left").join(many, pkg)
    ranges = ranges.select(*pkg, "adv", F.coalesce("lo", F.lit(0)).alias("a"), F.least("fixed", "last", "many").alias("b")).where("a < b")

    def nodes(i: Column) -> Column:
        """At height i: the leftmost and the rightmost node that lie in [a, b) and in no higher one."""
        size = F.call_function("shiftleft", F.lit(1).cast("bigint"), i)
        l, r = F.floor((F.col("a") + size - 1) / size), F.floor(F.col("b") / size)
        node = lambda ok, n: F.when((l < r) & ok, F.struct(i.alias("height"), n.alias("node")))
        return F.array(node(l % 2 == 1, l), node(r % 2 == 1, r - 1))

    made_of = F.array_compact(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(_HEIGHTS)), nodes)))
    parts = ranges.select(*pkg, "adv", F.inline(made_of))
    above = ranked.join(many, pkg).select(*pkg, "version", "rank", F.explode(F.sequence(F.lit(0), F.ceil(F.log2("many")).cast("int"))).alias("height"))
    above = above.select(*pkg, "version", "height", F.floor(F.col("rank") / F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("height"))).alias("node"))
    inside = above.join(parts, [*pkg, "height", "node"])
    cols = [*pkg, "version", "adv"]
    return inside.select(*cols).unionByName(listed.select(*cols)).unionByName(any_version.select(*cols)).distinct()


def osv_findings(deps: DataFrame, osv: DataFrame) -> DataFrame:
    """OSV advisories per dependency: matched on the fleet's distinct versions, then returned to the repositories by equality."""
    # Read twice, for its distinct versions and for its repositories.
    d = materialise(deps.where(F.col("ecosystem") != "npm"))
    # The snapshot's rows are numbered, so they must not be made anew.
    affected = materialise(osv_affected(osv).withColumn("adv", F.monotonically_increasing_id()))
    m = version_matches(d.select("ecosystem", "name", "version").distinct(), affected)
    m = m.join(affected.drop("ecosystem", "name", "iv", "versions"), "adv").drop("adv")
    # A merge join holds a key's rows of the right side: the narrow ones, not the advisories' texts.
    j = m.join(d, ["ecosystem", "name", "version"])
    return as_findings(j, "dependency", rule_id=F.col("id"), package=F.col("name"))


def unparseable_versions(deps: DataFrame) -> DataFrame:
    """Versions the range test cannot order; reported, not dropped silently."""
    return deps.where(version_key(F.col("version")).isNull())


def vuln_counts(findings: DataFrame, scans: DataFrame | None = None) -> DataFrame:
    """Vulnerabilities per ecosystem and the total, per scan: zeros for a scan without any, and for one of ``scans`` without findings."""
    names = ["npm", "PyPI", "Go", "RubyGems", "Maven", "Packagist", "Container"]
    dep = F.col("kind") == "dependency"
    return every_scan(scans, findings.groupBy("repo", "scan_id").agg(
        *[F.count_if(dep & (F.col("ecosystem") == n)).alias(n.lower()) for n in names], F.count_if(dep).alias("deps_count")))


def degraded(deps: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Health rows for ecosystems in use whose snapshot is missing. ``snapshots(ecosystem, detector)``."""
    need = deps.select(*KEY, "ecosystem").distinct()
    missing = need.join(snapshots.select("ecosystem").distinct(), "ecosystem", "left_anti")
    return missing.select(*KEY, F.when(F.col("ecosystem") == "npm", "npm-audit").otherwise("osv").alias("detector"),
                          F.concat(F.lit("No advisory snapshot for "), "ecosystem", F.lit("; its vulnerabilities were not checked.")).alias("reason"))


# Fixed value: order of the health roll-up.
HEALTH_ORDER = ["history", "npm-audit", "osv", "blob-fetch", "suppressions-file", "license-registry", "container-scan"]


def health_rollup(parts: list[DataFrame]) -> DataFrame:
    """All health rows in the fixed detector order."""
    rank = F.array_position(F.array(*[F.lit(d) for d in HEALTH_ORDER]), F.col("detector"))
    return reduce(lambda a, b: a.unionByName(b), parts).withColumn("ord", rank.cast("int"))
