"""Versions, advisories, licences, supply chain, posture, identity statements."""

import random

from pyspark.sql import functions as F

from fleetrisk.functions.versions import satisfies, version_key
from fleetrisk.operators import deps, iam, licenses, posture, supply


def test_version_order(spark):
    ordered = ["0.9", "1.0.0-alpha", "1.0.0-alpha.2", "1.0.0-beta", "1.0.0rc1", "1.0.0", "1.0.0.post1", "1.0.1", "1.2", "1.10.0", "2.0.0"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(ordered)], "i int, v string")
    assert [r.i for r in df.orderBy(version_key(F.col("v"))).collect()] == list(range(len(ordered)))
    assert deps.unparseable_versions(spark.createDataFrame([("main",), ("1",)], "version string")).count() == 1


def test_npm_ranges(spark):
    cases = [("1.2.3", ">=1.0.0 <1.2.4", 1), ("1.2.4", ">=1.0.0 <1.2.4", 0), ("3.0.0", "<1.0.0 || >=2.5.0", 1), ("2.0.0", "*", 1), ("1.0.0", "=1.0.0", 1), ("1.0.0-rc.1", "<1.0.0", 1), ("x", "<1.0.0", 0)]
    df = spark.createDataFrame(cases, "v string, r string, want int")
    assert df.where(satisfies(F.col("v"), F.col("r")).cast("int") != F.col("want")).count() == 0


def test_osv_intervals_and_text(spark):
    ev = lambda **k: (k.get("i"), k.get("f"), k.get("l"))
    osv = spark.createDataFrame([("X-1", None, None, ["GHSA-aa"], [("CVSS_V3", "9.1")], None, [(("p", "PyPI"), [("ECOSYSTEM", [ev(i="0"), ev(f="1.2"), ev(i="2.0"), ev(l="2.3")]), ("GIT", [ev(i="0")])], ["9.9"])], None)],
                                "id string, summary string, details string, aliases array<string>, severity array<struct<type:string,score:string>>, database_specific struct<severity:string,cwe_ids:array<string>>, "
                                "affected array<struct<package:struct<name:string,ecosystem:string>,ranges:array<struct<type:string,events:array<struct<introduced:string,fixed:string,last_affected:string>>>>,versions:array<string>>>, references array<struct<type:string,url:string>>")
    d = spark.createDataFrame([("o/r", "s", "PyPI", "p", v, "requirements.txt", False, False) for v in ("1.1", "1.2", "2.3", "2.3.1", "9.9")],
                              "repo string, scan_id string, ecosystem string, name string, version string, source string, is_transitive boolean, is_dev boolean")
    rows = deps.osv_findings(d, osv).collect()
    assert sorted(r.version for r in rows) == ["1.1", "2.3", "9.9"]
    assert rows[0].vulnerable_versions == "< 1.2 or >= 2.0, <= 2.3" and rows[0].severity == "critical" and rows[0].ghsa == "GHSA-aa"


def test_npm_strict_and_faithful(spark):
    d = spark.createDataFrame([("o/r", "s", "npm", "p", v, "package-lock.json", False, False) for v in ("1.0.0", "2.0.0")],
                              "repo string, scan_id string, ecosystem string, name string, version string, source string, is_transitive boolean, is_dev boolean")
    adv = spark.createDataFrame([("p", "moderate", "t", "<1.5.0", "https://x/GHSA-ab-cd", None)], "package string, severity string, title string, vulnerable_versions string, url string, cvss_score double")
    assert [(r.version, r.ghsa, r.severity) for r in deps.npm_findings(d, adv).collect()] == [("1.0.0", "GHSA-ab-cd", "medium")]
    assert deps.npm_findings(d, adv, strict=False).count() == 2


def test_old_lockfile_nests(files):
    text = '{"lockfileVersion":1,"dependencies":{"a":{"version":"1.0.0","dependencies":{"b":{"version":"2.0.0","dev":true,"dependencies":{"c":{"version":"3.0.0"}}}}}}}'
    got = sorted((r.name, r.is_transitive, r.is_dev) for r in deps.npm_inventory(files(("package-lock.json", text), ("package.json", '{"dependencies":{"z":"1.0.0"}}'))).collect())
    assert got == [("a", False, False), ("b", True, True), ("c", True, False)]


def test_broken_lockfile_falls_back(files):
    got = [r.name for r in deps.npm_inventory(files(("package-lock.json", "{oops"), ("package.json", '{"dependencies":{"z":"^1.0.0"}}'))).collect()]
    assert got == ["z"]


def test_licences(spark):
    cases = {"MIT": None, "": None, None: None, "GPL-3.0": "copyleft-strong", "LGPL-3.0": "copyleft-weak", "(MIT OR GPL-2.0)": None, "MIT AND GPL-2.0": "copyleft-strong", "AGPL-3.0": "copyleft-strong",
             "UNLICENSED": "non-standard", "Proprietary EULA": "non-standard", "MPL-2.0": "copyleft-weak", "Custom": None}
    df = spark.createDataFrame([(k, v) for k, v in cases.items()], "l string, want string")
    assert df.where(~licenses.classify(F.col("l")).eqNullSafe(F.col("want"))).collect() == []


def osa(a, b):
    d = [[i + j if i * j == 0 else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def test_typosquats_against_brute_force(spark, files):
    rnd = random.Random(7)
    word = lambda: "".join(rnd.choice("abc-") for _ in range(rnd.randint(3, 8)))
    popular = sorted({"".join(("a", word())) for _ in range(40)})
    names = {"".join(("a", word())) for _ in range(150)} | {p[0].upper() + p[1:] for p in popular[:5]} | {"ca", "abc"}
    names = {n for n in names if n[0].isalnum()}
    pop = spark.createDataFrame([("pypi", p, i + 1) for i, p in enumerate(popular)], "ecosystem string, name string, rank int")
    got = {r.package: r.evidence for r in supply.typosquats(files(("requirements.txt", "\n".join(f"{n}==1" for n in sorted(names)))), pop).collect()}
    want = {}
    low = {p.lower(): p for p in popular}
    for n in names:
        if n.lower() in low:
            if n != low[n.lower()]:
                want[n] = (0, low[n.lower()])
            continue
        best = min(((osa(n.lower(), p), i, p) for i, p in enumerate(popular) if abs(len(n) - len(p)) <= 2 and
                    (osa(n.lower(), p) == 1 or (osa(n.lower(), p) == 2 and len(n) > 2 and n.lower()[:3] == p[:3]))), default=None)
        if best:
            want[n] = (best[0], best[2])
    assert got == {n: f"{n} -> {t} (distance={d}, ecosystem=pypi)" for n, (d, t) in want.items()} and len(got) > 30


def test_posture_half_points_and_unknowns(spark):
    from fleetrisk.schemas import REPO_SETTINGS
    from pyspark.sql import Row
    base = dict(repo="a", branch_protected=True, bp_details=None, has_security_md=False, has_license=True, has_codeowners=False, readme="x" * 500, has_dependabot_or_renovate=False, has_lockfile=True, gitignore="node_modules\n.env",
                signed_commits_ratio=0.6, mfa_state="na-user-repo", secret_scanning="unknown", workflow_perms="read", release_provenance="absent", ruleset=None, degraded=False)
    s = posture.posture_signals(spark.createDataFrame([base], REPO_SETTINGS))
    by = {r.signal: r for r in s.collect()}
    assert len(by) == 17 and by["signed-commits"].points_earned == 5 and by["branch-pr-required"].unknown and by["mfa-org"].unknown
    assert posture.posture_scores(s).first().posture_score == round(100 * (15 + 8 + 4 + 8 + 5 + 5 + 5) / (115 - 15 - 5 - 6))
    assert [r.signal for r in posture.quick_wins(s).orderBy("rank").collect()] == ["auto-updates", "security-md", "signed-commits", "codeowners", "release-provenance"]


def test_identity_statements(files):
    hcl = 'data "aws_iam_policy_document" "d" {\n  statement {\n    not_actions = ["s3:*"]\n    resources = ["*"]\n    principals { type = "AWS" identifiers = ["*"] }\n  }\n}\n'
    yml = "Resources:\n  P:\n    Statement:\n      - Effect: Allow\n        Action: [iam:PassRole, \"ec2:RunInstances\"]\n        Resource: '*'\n      - Effect: Deny\n        Action: \"*\"\n        Resource: \"*\"\n"
    doc = 'x = jsonencode({"Statement": {"Effect": "Allow", "Action": "*", "Resource": "*"}})\n'
    st = {(r.path, r.stmt_no): r for r in iam.iam_statements(files(("a.tf", hcl), ("role.yaml", yml), ("b.tf", doc), ("other.json", "{}"), ("iam.json", "[broken"))).collect()}
    assert st[("a.tf", 0)].actions == ["!s3:*"] and st[("a.tf", 0)].principal == '{"AWS": ["*"]}'
    assert st[("role.yaml", 0)].actions == ["iam:PassRole", "ec2:RunInstances"] and st[("role.yaml", 1)].effect == "Deny"
    assert st[("b.tf", 0)].actions == ["*"] and len(st) == 4


def test_identity_statements_of_nested_blocks_and_lists():
    hcl = """data "aws_iam_policy_document" "d" {
  statement {
    principals {
      type = "AWS"
      identifiers = ["*"]
    }
    # a brace } in a comment
    actions = ["s3:Get*", "iam:PassRole"] // x
    resources = [
      "*", # all
      "arn:${var.x}",
    ]
    condition {
      test = "StringLike"
      variable = "token.actions.githubusercontent.com:sub"
      values = ["repo:o/*:*"]
    }
  }
}
resource "p" "q" {
  policy = jsonencode({ Statement = [{ Action = "ec2:*", Effect = "Allow", Resource = "*" }, { Effect = "Deny", Action = ["a:b"], Resource = aws_s3.b.arn }] })
}
"""
    got = iam.statements_of("a.tf", hcl)
    assert [(s["effect"], s["actions"], s["resources"], s["source_line"]) for s in got] == [("Allow", ["s3:Get*", "iam:PassRole"], ["*", "arn:${var.x}"], 2), ("Allow", ["ec2:*"], ["*"], 21), ("Deny", ["a:b"], ["aws_s3.b.arn"], 21)]
    assert got[0]["principal"] == '{"AWS": ["*"]}' and got[0]["conditions"] == '{"StringLike": {"token.actions.githubusercontent.com:sub": ["repo:o/*:*"]}}'
    yml = "S:\n  Statement:\n  - Action:\n      - iam:PassRole\n    Effect: Allow\n    Principal:\n      Service: [x.com]\n  - Effect: Deny\n    NotAction: '*'\n    Resource:\n    - a\n    - b\n  Other: 1\n"
    got = iam.statements_of("role.yml", yml)
    assert [(s["effect"], s["actions"], s["resources"], s["principal"]) for s in got] == [("Allow", ["iam:PassRole"], [], '{"Service": ["x.com"]}'), ("Deny", ["!*"], ["a", "b"], None)]


def test_identity_statements_of_a_long_file_take_linear_time():
    import time
    start = time.perf_counter()
    assert len(iam.statements_of("p.json", '{"Statement":[' + ",".join(['{"Effect":"Allow","Action":"s3:Get","Resource":"*"}'] * 20_000) + "]}")) == 20_000
    iam.statements_of("p.tf", "x = [{" * 200_000)
    assert time.perf_counter() - start < 10


def test_versions_meet_intervals_as_by_each_with_each(spark):
    """The tree over ranked versions gives what is_affected() gives for every pair: open, half-open, empty and unreadable bounds, listed versions."""
    rnd = random.Random(2)
    version = lambda: rnd.choice(["{}.{}".format(rnd.randint(0, 9), rnd.randint(0, 9)), "{}.0-rc{}".format(rnd.randint(0, 9), rnd.randint(1, 3)), "v{}".format(rnd.randint(0, 9)), "main"])
    event = lambda: {"introduced": rnd.choice(["0", "0", version(), "odd"]), "fixed": rnd.choice([None, None, version(), "odd"]), "last_affected": rnd.choice([None, None, version()])}
    osv = [{"id": f"A{i}", "affected": [{"package": {"ecosystem": "PyPI", "name": rnd.choice("ab")}, "ranges": [{"type": "ECOSYSTEM", "events": [event() for _ in range(rnd.randint(0, 2))]}],
                                         "versions": [version() for _ in range(rnd.randint(0, 2))]}]} for i in range(120)]
    schema = ("id string, summary string, aliases array<string>, severity array<struct<type:string,score:string>>, database_specific struct<severity:string>, references array<struct<type:string,url:string>>, "
              "affected array<struct<package:struct<ecosystem:string,name:string>,ranges:array<struct<type:string,events:array<struct<introduced:string,fixed:string,last_affected:string>>>>,versions:array<string>>>")
    affected = deps.osv_affected(spark.createDataFrame([(o["id"], None, None, None, None, None, o["affected"]) for o in osv], schema)).withColumn("adv", F.substring("id", 2, 9).cast("bigint"))
    versions = spark.createDataFrame([("PyPI", n, v) for n in "abc" for v in sorted({version() for _ in range(150)})], "ecosystem string, name string, version string")
    pairs = versions.withColumn("vk", version_key(F.col("version"))).join(affected, ["ecosystem", "name"]).where(deps.is_affected())
    key = lambda rows: sorted((r.name, r.version, r.adv) for r in rows.collect())
    want = key(pairs)
    assert key(deps.version_matches(versions, affected)) == want and len(want) > 500
    assert deps.version_matches(versions.limit(0), affected).count() == 0


def test_a_package_with_many_versions_and_advisories(spark):
    """10^4 versions and 10^4 narrow advisories of one package: 3 * 10^4 matches, not 10^8 pairs."""
    n = F.col("id")
    versions = spark.range(10_000).select(F.lit("PyPI").alias("ecosystem"), F.lit("p").alias("name"), F.concat(F.lit("1."), n).alias("version"))
    x = F.struct(version_key(F.concat(F.lit("1."), n)).alias("lo"), F.lit(False).alias("open_lo"), version_key(F.concat(F.lit("1."), n + 3)).alias("fixed"), F.lit(True).alias("has_fixed"),
                 F.lit(None).cast("array<bigint>").alias("last"), F.lit(False).alias("has_last"))
    affected = spark.range(10_000).select(F.lit("PyPI").alias("ecosystem"), F.lit("p").alias("name"), n.alias("adv"), F.array(x).alias("iv"), F.array().cast("array<string>").alias("versions"))
    got = deps.version_matches(versions, affected)
    assert got.count() == 29_997 and got.where("CAST(substring(version, 3) AS INT) - adv NOT BETWEEN 0 AND 2").count() == 0


def test_osv_keys_are_made_once_for_each_version(spark):
    """The inventory and the versions' keys are kept: no later reading of them tests or makes a key for each row of the inventory."""
    end = "introduced string, fixed string, last_affected string"
    osv = spark.createDataFrame([("X-1", None, None, None, None, None, [(("p", "PyPI"), [("ECOSYSTEM", [("0", None, None), (None, "2.0", None)])], ["odd"])])],
                                "id string, summary string, aliases array<string>, severity array<struct<type:string,score:string>>, database_specific struct<severity:string>, references array<struct<type:string,url:string>>, "
                                f"affected array<struct<package:struct<name:string,ecosystem:string>,ranges:array<struct<type:string,events:array<struct<{end}>>>>,versions:array<string>>>")
    rows = [(r, "s", "PyPI", "p", v, "requirements.txt", False, False) for r in ("a", "b", "b") for v in ("1.0", "2.0", "odd")]
    rows += [("a", "s", "npm", "p", "1.0", "package.json", False, False)]
    d = spark.createDataFrame(rows, "repo string, scan_id string, ecosystem string, name string, version string, source string, is_transitive boolean, is_dev boolean")
    got = deps.osv_findings(d, osv)
    assert r"\d+!" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.repo, r.version) for r in got.collect()) == [(r, v) for r in ("a", "b") for v in ("1.0", "odd") for _ in range(1 if r == "a" else 2)]
