"""Streaming twins, sources and sinks, the whole scan."""

import datetime
import json
import random
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import functions as F

from fleetrisk.operators import suppress
from fleetrisk.plans import fleet_scan
from fleetrisk.schemas import SUPPRESSION_ROWS
from fleetrisk.sources import log, sinks, tables
from fleetrisk.streaming import incremental, quota


def events(n=300, seed=3):
    rnd, t = random.Random(seed), datetime.datetime(2024, 1, 1)
    out = []
    for i in range(n):
        t += datetime.timedelta(seconds=rnd.randint(1, 900))
        out.append((str(i), rnd.choice(["hot", "hot", "a", "b"]), t))
    return out


def brute(rows, limit, window=3600):
    state, out = {}, {}
    for i, key, ts in sorted(rows, key=lambda r: r[2]):
        c, s = state.get(key, (0, None))
        if s is None or (ts - s).total_seconds() >= window:
            c, s = 0, ts
        out[i] = c < limit
        state[key] = (c + 1, s) if c < limit else (c, s)
    return out


def test_quota_equals_brute_force(spark):
    rows = events()
    got = quota.quota(spark.createDataFrame(rows, "id string, key string, ts timestamp"), quota.Policy(3)).collect()
    assert {r.id: r.allowed for r in got} == brute(rows, 3)
    assert all((r.retry_after_s > 0) != r.allowed for r in got)


def decisions(rows, policy):
    """decide() applied event by event."""
    state, out = {}, []
    for i, key, ts in sorted(rows, key=lambda r: (r[2], r[0])):
        ms = (ts - datetime.datetime(1970, 1, 1)) // datetime.timedelta(milliseconds=1)
        state[key], *rest = quota.decide(state.get(key), ms, policy)
        out.append((i, key, *rest))
    return sorted(out, key=str)


def test_quota_by_jumps_equals_decide(spark):
    """Long keys by pointer doubling, short ones in a row, the same decisions: gaps, bursts, regular times, equal times, null keys."""
    rnd, start = random.Random(5), datetime.datetime(2024, 3, 1, 0, 0, 0, 500)
    rows = []
    for key, step in (("regular", lambda: 24 * 60_000), ("burst", lambda: rnd.choice([0, 0, 1, 1000, 7_200_000])), ("random", lambda: rnd.randint(0, 4_000_000)), (None, lambda: rnd.randint(0, 600_000)),
                      ("edge", lambda: rnd.choice([3_599_999, 3_600_000, 3_600_001, 1])), ("rare", lambda: 10_000_000_000)):
        t = start
        for n in range(150):
            t += datetime.timedelta(milliseconds=step())
            rows.append((f"{key}-{n:04}", key, t))
    rows.append(("before-1970", "old", datetime.datetime(1969, 12, 31, 22, 30)))
    rows.append(("before-1970-2", "old", datetime.datetime(1969, 12, 31, 23, 29)))
    df = spark.createDataFrame(rows, "id string, key string, ts timestamp")
    for policy in (quota.Policy(3), quota.Policy(1, 60_000)):
        want = decisions(rows, policy)
        for small in (0, 100, 10_000):
            got = quota.quota(df, policy, small).collect()
            assert sorted([(r.id, r.key, r.allowed, r.remaining, r.retry_after_s) for r in got], key=str) == want
    assert quota.quota(df.limit(0), quota.Policy(3), 0).count() == 0


def test_quota_runs_without_python(spark):
    df = spark.createDataFrame(events(), "id string, key string, ts timestamp")
    plan = quota.quota(df, quota.Policy(3), 10)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InPandas" not in plan


def test_two_stages(spark):
    rows = [(i, k, "o/r", t) for i, k, t in events(120)]
    got = {r.id: r.allowed for r in quota.two_stage(spark.createDataFrame(rows, "id string, address string, repo string, ts timestamp"), quota.Policy(2), quota.Policy(3)).collect()}
    first = brute([(i, k, t) for i, k, _, t in rows], 2)
    second = brute([(i, r, t) for i, _, r, t in rows if first[i]], 3)
    assert got == {i: first[i] and second.get(i, False) for i in first}


def test_quota_stream_equals_batch(spark, tmp_path):
    rows = sorted(events(90), key=lambda r: r[2])
    src = tmp_path / "in"
    schema = "id string, key string, ts timestamp"
    for n in range(3):
        spark.createDataFrame(rows[n * 30:(n + 1) * 30], schema).coalesce(1).write.mode("append").parquet(str(src))
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(src))
    q = quota.quota_stream(s, quota.Policy(3)).writeStream.format("parquet").option("path", str(tmp_path / "out")).option(
        "checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(180)
    got = {r.id: r.allowed for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == brute(rows, 3)


def test_incremental_scan(spark, tmp_path):
    src = str(tmp_path / "files")
    row = lambda p, c: ("o/r", "s", p, len(c), c)
    schema = "repo string, scan_id string, path string, size bigint, content string"
    spark.createDataFrame([row("a.ts", "eval(x)"), row("b.py", "obj = pickle.loads(b)")], schema).write.mode("append").parquet(src)
    run = lambda: incremental.append_findings(incremental.stream_findings(incremental.read_files(spark, src)), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    run()
    spark.createDataFrame([row("c.ts", "eval(y)")], schema).write.mode("append").parquet(src)
    run()
    got = {(r.file_path, r.rule_id) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {("a.ts", "js-eval"), ("b.py", "py-pickle-loads"), ("c.ts", "js-eval")}


def test_checkouts_and_scope(spark, tmp_path):
    for p, c in {"o/r/src/a b.ts": "eval(x)", "o/r/README.md": "hi", "o/q/lib/b.py": "x"}.items():
        f = tmp_path / "fleet" / p
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(c)
    df = tables.checkouts(spark, str(tmp_path / "fleet"))
    assert {(r.repo, r.path, r.content) for r in df.collect()} == {("o/r", "src/a b.ts", "eval(x)"), ("o/r", "README.md", "hi"), ("o/q", "lib/b.py", "x")}
    assert [r.path for r in tables.in_scope(df, "src/").collect()] == ["src/a b.ts"]
    ok, bad = tables.safe_files(df.unionByName(df.limit(1).withColumn("path", F.lit("../x"))))
    assert ok.count() == 3 and bad.count() == 1


def test_snapshots(spark, tmp_path):
    (tmp_path / "npm.json").write_text(json.dumps({"p": [{"severity": "high", "title": "t", "vulnerable_versions": "<1", "url": "u", "cvss": {"score": 7.5}}]}))
    assert [(r.package, r.cvss_score) for r in tables.npm_bulk(spark, str(tmp_path / "npm.json")).collect()] == [("p", 7.5)]
    (tmp_path / "pop.json").write_text(json.dumps({"meta": {}, "packages": [{"name": n} for n in "abc"]}))
    assert [(r.name, r["rank"]) for r in tables.popular_packages(spark, str(tmp_path / "pop.json"), "npm", 2).collect()] == [("a", 1), ("b", 2)]
    body = json.dumps({"time": {"created": "2024-01-01T00:00:00Z"}, "maintainers": [], "dist-tags": {"latest": "1"}, "versions": {"1": {"deprecated": "use x"}}})
    (tmp_path / "reg.json").write_text("\n".join(json.dumps(x) for x in [{"name": "a", "status": 200, "body": body}, {"name": "b", "status": 404}]))
    got = {r.name: (r.status, r.deprecated, r.maintainers) for r in tables.registry_meta(spark, str(tmp_path / "reg.json")).collect()}
    assert got == {"a": (200, True, []), "b": (404, False, None)}


def test_scan_rows_round_trip(spark, tmp_path):
    t = datetime.datetime(2024, 3, 1, 12)
    s = spark.createDataFrame([("1", "u", "o", "r", t, 5, 7)], "id string, user_id string, owner string, repo string, scanned_at timestamp, duration_ms bigint, risk_score int").selectExpr(
        "*", "1 as files_scanned", "2 as secrets_count", "3 as deps_count")
    sinks.append_scans(s, str(tmp_path / "scans"))
    sinks.append_scans(s.withColumn("id", F.lit("2")), str(tmp_path / "scans"))
    back = tables.scans_table(spark, str(tmp_path / "scans")).orderBy("id").collect()
    assert [(r.id, r.risk_score, r.iam_score) for r in back] == [("1", 7, None), ("2", 7, None)]
    sinks.append_scan_events(s, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).first().ok is True


def test_suppression_table(spark, tmp_path):
    rows = [("1", "u", "o", "r", "src/**", None, "x", None, datetime.datetime(2024, 1, 1)), ("2", "u", "o", "r", "a.ts", "code/*", None, datetime.datetime(2025, 1, 1), datetime.datetime(2024, 2, 1))]
    df = spark.createDataFrame(rows, "id string, user_id string, owner string, repo string, path_glob string, rule_glob string, reason string, expires_at timestamp, created_at timestamp")
    got = {r.path_glob: (r.repo, r.source_line, r.expires) for r in suppress.from_table(df).collect()}
    assert got == {"a.ts": ("o/r", 100000, datetime.date(2025, 1, 1)), "src/**": ("o/r", 100001, None)}
    ok, bad = suppress.valid_input(df.withColumn("path_glob", F.when(F.col("id") == "1", F.repeat(F.lit("x"), 501)).otherwise(F.col("path_glob"))))
    assert [r.id for r in ok.collect()] == ["2"] and [r.id for r in bad.collect()] == ["1"]


def test_whole_scan(spark, files):
    f = files(("src/routes/a.ts", "const k = 'ghp_" + "a1" * 18 + "'\neval(req.query.x)\n"), ("Dockerfile", "FROM node:14\nUSER node"), ("requirements.txt", "flask==1.0\n"),
              ("app.py", "app.run(debug=True)"), ("tests/t.ts", "eval(x)"), (".scanignore", "Dockerfile [rule=iac/*] [reason=later]\n"), ("img.png", "x"))
    applied = fleet_scan.scan(f, fleet_scan.Snapshots(), F.lit("2025-06-01").cast("date"))
    got = {(r.rule_id, r.file_path) for r in applied.where("not suppressed").collect()}
    assert {("github-pat", "src/routes/a.ts"), ("js-eval", "src/routes/a.ts"), ("ast/eval-user-input", "src/routes/a.ts"), ("flask-debug-run", "app.py"), ("js-eval", "tests/t.ts")} <= got
    assert [r.rule_id for r in applied.where("suppressed").collect()] == ["dockerfile-base-image-eol"]
    row = fleet_scan.scan_rows(suppress.kept(applied), f).first()
    assert row.secrets_count == 1 and row.files_scanned == 5 and row.risk_score > 0 and row.fixture > 0


def test_sql_table_functions(spark, files):
    from fleetrisk.functions import sql

    sql.register(spark)
    files(("a.ts", "eval(x)\nnew Foo(1, 2)"), ("iam.json", '{"Statement":[{"Effect":"Allow","Action":"*","Resource":"*"}]}')).createOrReplaceTempView("f")
    calls = spark.sql("SELECT c.* FROM f, LATERAL call_sites(content) c WHERE path = 'a.ts' ORDER BY line_no").collect()
    assert [(r.line_no, r.kind, r.callee, r.n_args) for r in calls] == [(1, "call", "eval", 1), (2, "new", "Foo", 2)]
    assert spark.sql("SELECT s.actions FROM f, LATERAL iam_statements(path, content) s").first()[0] == ["*"]


def test_alerts_only_for_unknown_findings(spark, tmp_path):
    from fleetrisk.schemas import FINDINGS, conform

    t = datetime.datetime(2024, 1, 1)
    raw = spark.createDataFrame([("o/r", "code", "js-eval", p, 1, t) for p in ("a.ts", "b.ts", "b.ts")], "repo string, kind string, rule_id string, file_path string, line_no int, seen_at timestamp")
    rows = conform(raw, FINDINGS + ", seen_at timestamp")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    known = lambda: rows.where("file_path = 'a.ts'").drop("seen_at")
    incremental.alerts(stream, known, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert [r.file_path for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["b.ts"]


def test_checkouts_with_pictures_and_other_encodings(spark, tmp_path):
    from fleetrisk.sources import tables
    root = tmp_path / "co" / "o" / "r"
    root.mkdir(parents=True)
    (root / "a.ts").write_text("const x = 1")
    (root / "logo.png").write_bytes(b"\x89PNG\r\n\x1a\n\xff\xfe\x00")
    (root / "latin.py").write_bytes("x = 'é'".encode("latin-1"))
    files, rejected = tables.text_files(tables.raw_checkouts(spark, str(tmp_path / "co")))
    got = {r.path: r.content for r in files.collect()}
    assert got["a.ts"] == "const x = 1" and got["logo.png"] is None and got["latin.py"].startswith("x = '") and [r.path for r in rejected.collect()] == ["latin.py"]
    assert tables.checkouts(spark, str(tmp_path / "co")).count() == 3


def test_nothing_is_capped_by_default(spark, files):
    from pyspark.sql import functions as F

    from fleetrisk.operators import gates, secrets
    big = "x = 1\n" * 400_000 + "key = sk_live_" + "a1B2c3D4e5F6g7H8i9J0k1L2m3N4o5P6"[:32]
    assert secrets.token_secrets(gates.scannable_files(files(("big.ts", big)))).count() == 1
    patch = "@@ -1 +1 @@\n" + "+plain line\n" * 30_000 + "+key = sk_live_" + "a1B2c3D4e5F6g7H8i9J0k1L2m3N4o5P6"[:32]
    rows = spark.range(40).select(F.lit("o/r").alias("repo"), F.lit("s").alias("scan_id"), F.concat(F.lit("c"), "id").alias("sha"), F.lit("d").alias("author_name"), F.timestamp_seconds(F.col("id")).alias("author_date"),
                                  F.lit(None).cast("string").alias("committer_name"), F.lit(None).cast("timestamp").alias("committer_date"), F.lit(True).alias("verified"),
                                  F.array(F.struct(F.concat(F.lit("f"), "id", F.lit(".ts")).alias("filename"), F.lit("modified").alias("status"), F.when(F.col("id") == 0, F.lit(patch)).otherwise("@@ -1 +1 @@\n+x = 1").alias("patch"))).alias("files"))
    tree = secrets.token_secrets(files(("a.ts", "x = 1")))
    assert [r.commit_sha for r in secrets.history_secrets(rows, tree).collect()] == ["c0"]


def test_scans_without_findings_keep_their_rows(spark, files):
    from fleetrisk.operators import iam, score, secrets, supply
    scans = files(("a.ts", "x = 1"))
    none = secrets.token_secrets(scans)
    flat = score.flatten({"x": none})
    assert [(r.risk_score, r.findings) for r in score.breakdown(flat, scans).collect()] == [(0, 0)]
    assert [(r.critical, r.total) for r in score.severity_counts(flat, scans).collect()] == [(0, 0)]
    assert {r.n for r in score.detector_counts(flat, scans).collect()} == {0} and score.detector_counts(flat, scans).count() == len(score.DETECTORS)
    hooks = supply.npm_hooks(scans)
    assert [(r.score, r.n, r.level) for r in supply.supply_scores(hooks, scans).collect()] == [(100, 0, "excellent")]
    assert {(r.score, r.n) for r in supply.supply_breakdown(hooks, scans).collect()} == {(100, 0)}
    assert {(r.n, r.worst) for r in iam.iam_breakdown(iam.iam_findings(iam.iam_statements(scans)), scans).collect()} == {(0, None)}


def test_inventory_is_read_once_by_its_detectors(spark, files):
    f = files(("requirements.txt", "django==1.2.0\n"), ("a.ts", "x = 1"), ("package-lock.json", '{"lockfileVersion":3,"packages":{"node_modules/p":{"version":"1.0.0"}}}'))
    licences = spark.createDataFrame([("PyPI", "django", "1.2.0", ["GPL-3.0"])], "ecosystem string, name string, version string, licenses array<string>")
    found = fleet_scan.detect(f, fleet_scan.kept_small(f), fleet_scan.Snapshots(package_licenses=licences), F.lit("2025-06-01").cast("date"))
    assert [(r.package, r.license) for r in found["license"].collect()] == [("django", "GPL-3.0")]
    # What the detector reads is the kept inventory, not ten parsers of the small files.
    assert "from_json" not in found["license"]._jdf.queryExecution().optimizedPlan().toString()
    assert fleet_scan.kept_small(f.repartition(40)).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_supply_sums_are_dealt_as_wide_as_the_session(spark):
    from fleetrisk.operators import supply
    cats, sevs = [*supply.CATEGORIES, "other", None], ["HIGH", "MEDIUM", "LOW", "odd", None]
    rnd = random.Random(5)
    rows = [(rnd.choice(["hot", "hot", "a", "b", None]), rnd.choice(["s", None]), rnd.choice(cats), rnd.choice(sevs), f"p{rnd.randint(0, 30)}", "package.json", "x", "e") for _ in range(400)]
    f = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in supply.OUT))
    scans = spark.createDataFrame([("hot", "s"), ("hot", "s"), ("none", "s"), (None, None)], "repo string, scan_id string")
    keys = {(r[0], r[1]) for r in rows} | {("hot", "s"), ("none", "s"), (None, None)}
    points = lambda k, c: sum(supply.PENALTY.get(r[3], 0) for r in rows if (r[0], r[1]) == k and c in (None, r[2]))
    count = lambda k, c, s=0: sum((r[0], r[1]) == k and r[2] == c and s in (0, r[3]) for r in rows)
    got, more = supply.supply_scores(f, scans), supply.supply_breakdown(f, scans)
    assert sorted((str(r.repo), str(r.scan_id), r.score, r.n) for r in got.collect()) == sorted(
        (str(k[0]), str(k[1]), max(0, 100 - points(k, None)), sum((r[0], r[1]) == k and r[3] is not None for r in rows)) for k in keys)
    assert sorted(map(str, more.collect())) == sorted(map(str, [
        type(r)(**r.asDict() | dict(score=max(0, 100 - points((r.repo, r.scan_id), r.category)), n=count((r.repo, r.scan_id), r.category),
                                    **{s.lower(): count((r.repo, r.scan_id), r.category, s) for s in supply.PENALTY})) for r in more.collect()]))
    assert more.count() == len(keys) * len(supply.CATEGORIES)
    # A task's share of the scans does not follow what adaptive execution would join.
    wide = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert got.rdd.getNumPartitions() == wide and more.rdd.getNumPartitions() == wide


def test_a_stream_of_files_meets_every_family(spark, files, tmp_path):
    from pyspark.sql import functions as F

    from fleetrisk.streaming import incremental
    rows = files(("Dockerfile", "FROM node:14\nUSER root"), ("src/a.ts", "eval(userInput)"), ("app.env", "api_key=q8Zk3LmN7pRt5VxW2yAbC9dE"), ("infra/m.tf", 'acl = "public-read"'))
    rows.write.parquet(str(tmp_path / "in"))
    incremental.append_scan(incremental.read_files(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck"), F.lit("2025-06-01").cast("date")).awaitTermination()
    kinds = {(r.kind, r.rule_id.split("-")[0]) for r in spark.read.parquet(str(tmp_path / "out")).select("kind", "rule_id").collect()}
    assert {k for k, _ in kinds} == {"secret", "code", "iac"} and ("secret", "entropy") in kinds


def stored(spark, *rows):
    return spark.createDataFrame([(i, u, "o", "r", g, None, None, None, None) for i, u, g in rows], SUPPRESSION_ROWS)


def test_suppression_log(spark, tmp_path):
    """Additions and deletions are merged on read; a deletion writes its own rows only and never touches another user's."""
    path = str(tmp_path / "log")
    state = lambda: sorted((r.id, r.user_id, r.path_glob) for r in log.read(spark, path).collect())
    assert state() == []
    log.append(stored(spark, ("1", "u1", "a"), ("2", "u2", "b"), ("3", "u1", "c")), path)
    before = {p: p.read_bytes() for p in tmp_path.rglob("*.parquet")}
    asked = spark.createDataFrame([("1", "u1"), ("2", "u1"), ("9", "u1")], "id string, user_id string")
    name = log.delete(asked, path)
    assert state() == [("2", "u2", "b"), ("3", "u1", "c")] and all(p.read_bytes() == x for p, x in before.items())
    assert spark.read.parquet(f"{path}/{name}").count() == 3
    log.append(stored(spark, ("1", "u1", "again"), ("3", "u1", "new")), path)
    want = [("1", "u1", "again"), ("2", "u2", "b"), ("3", "u1", "new")]
    assert state() == want
    # The whole again as plain operators.
    assert sorted(r.id for r in suppress.delete_rows(log.read(spark, path), asked).collect()) == ["2", "3"]
    done = log.compact(spark, path)
    assert state() == want and log.commits(spark, path) == [done]
    log.delete(spark.createDataFrame([("2", "u2")], "id string, user_id string"), path)
    assert state() == [("1", "u1", "again"), ("3", "u1", "new")]
    log.compact(spark, path)
    assert state() == [("1", "u1", "again"), ("3", "u1", "new")] and len(log.commits(spark, path)) == 1
    # A commit of an earlier time that finishes only now loses to what was deleted later.
    log.append(stored(spark, ("2", "u2", "late")), path, seq=1)
    assert state() == [("1", "u1", "again"), ("3", "u1", "new")]


def test_suppression_log_after_a_crash_and_with_two_writers(spark, tmp_path):
    path = tmp_path / "log"
    log.append(stored(spark, ("1", "u1", "a")), str(path))
    # A writer that died between its files has no marker.
    torn = path / log.append(stored(spark, ("2", "u1", "torn")), str(path))
    (torn / "_SUCCESS").unlink()
    assert [r.id for r in log.read(spark, str(path)).collect()] == ["1"]
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda k: log.append(stored(spark, (f"w{k}", "u", "x")), str(path)), range(4)))
    assert sorted(r.id for r in log.read(spark, str(path)).collect()) == ["1", "w0", "w1", "w2", "w3"]
