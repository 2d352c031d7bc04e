"""What keeps queries in proportion on large tables."""

import json
import random
import time

from pyspark.sql import functions as F

from fleetrisk.functions.structs import packed, unpacked
from fleetrisk.operators import deps, fix, iac, iam, sarif
from fleetrisk.plans import derived as D, registry as R, views as V
from fleetrisk.schemas import FINDINGS, conform

SF = "/root/testdata/sf0.001"


def test_no_stage_runs_a_method_too_long_for_the_jvm_to_compile(spark):
    spark.conf.unset(D.LIMIT)
    R.findings(spark, SF)
    assert spark.conf.get(D.LIMIT) == D.METHOD_BYTES
    spark.conf.set(D.LIMIT, "7000")
    R.findings(spark, SF)
    assert spark.conf.get(D.LIMIT) == "7000"
    spark.conf.unset(D.LIMIT)


def test_stages_of_a_dockerfile_are_parsed_once(files, spark):
    stages = [f"FROM node:14 AS s{i}" for i in range(300)]
    f = files(("Dockerfile", "\n".join([*stages, "FROM s7", "FROM --platform=linux/amd64 python:3.7", "FROM unknown:1"])))
    start = time.perf_counter()
    got = [(r.line_no, r.severity) for r in iac.eol_base_images(f, F.lit("2025-06-01").cast("date")).orderBy("line_no").collect()]
    assert got == [*[(i + 1, "high") for i in range(300)], (302, "high")]
    plan = iac.eol_base_images(f, F.lit("2025-06-01").cast("date"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("--platform") == 1 and time.perf_counter() - start < 60


def test_lines_of_a_dockerfile_are_cut_once_for_all_rules(files):
    rows = ["from node:18", "RUN x | sh", "RUN curl x | sh", "env TOKEN=abcdefgh1", "ADD HTTPS://x/y .", "RUN apt-get install a=1", "RUN apt install b", "RUN chmod 777 /x", "User root"]
    f = files(("Dockerfile", "\n".join(rows)), ("a/Dockerfile", "FROM node:18\nUSER app"), ("b/Dockerfile", "RUN x"), ("c/Dockerfile", ""))
    d = iac.dockerfile(f)
    got = sorted((r.file_path, r.line_no, r.rule_id.removeprefix("dockerfile-")) for r in d.collect())
    assert got == [("Dockerfile", 1, "user-root"), ("Dockerfile", 3, "curl-pipe-sh"), ("Dockerfile", 4, "secret-in-env"), ("Dockerfile", 5, "add-url"), ("Dockerfile", 7, "apt-noconfirm-no-pin"),
                   ("Dockerfile", 8, "chmod-777"), ("Dockerfile", 9, "user-root-explicit"), ("b/Dockerfile", 1, "user-root"), ("c/Dockerfile", 1, "user-root")]
    # Once for the rules, once for the lines that are scanned.
    assert d._jdf.queryExecution().optimizedPlan().toString().count("split(content") <= 3


def test_workflow_conditions_test_a_literal_first(files):
    lines = ["jobs:", "  steps:", "    - USES: someone/tool@main", "    - uses: docker/login@v1", "    - run: |", "        echo ${{ github.head_ref }}", "    - name: x",
             "        echo ${{ github.head_ref }}", "    - run: echo ${{ github.event.issue.title }}", "  Api_Key: abcdef", "  TOKEN_EXPIRY: 3600", "permissions: write-all"]
    f = files((".github/workflows/a.yml", "\n".join(lines)))
    got = {(r.line_no, r.rule_id) for r in iac.github_actions(f).collect()}
    assert got == {(3, "gha-unpinned-action"), (6, "gha-script-injection"), (9, "gha-script-injection"), (10, "gha-hardcoded-secret-env"), (12, "gha-permissions-write-all")}
    plan = iac.github_actions(f)._jdf.queryExecution().optimizedPlan().toString()
    assert "Contains(_lower" in plan and "uses:)" in plan


def made(rnd: random.Random, depth: int):
    kind = rnd.randrange(8 if depth else 5)
    if kind < 5:
        return rnd.choice(["*", "s3:Get*", "a b", "Statement: [{}]", "# c", "//", "{", "é'x", "x,]", 1, -2.5, 1e20, True, False, None])
    if kind == 5:
        return [made(rnd, depth - 1) for _ in range(rnd.randrange(4))]
    keys = ["Effect", "Action", "NotAction", "Resource", "Principal", "Condition", "Statement", "a Statement", "Sid", "x", "effect"]
    return {rnd.choice(keys): made(rnd, depth - 1) for _ in range(rnd.randrange(6))}


def test_json_policies_read_by_the_decoder_are_those_of_the_braced_reader():
    rnd, read = random.Random(5), 0
    for _ in range(3000):
        text = json.dumps({"Statement": made(rnd, 4), "other": made(rnd, 3)}, indent=rnd.choice([None, 1]), ensure_ascii=False)
        if rnd.randrange(3) == 0:
            text = text.replace('"effect"', '"Effect"').replace('"x"', '"Action"')  # keys that come again
        got = iam.plain_json(text)
        read += bool(got)
        assert got is None or got == iam.braced(text), text
    assert read > 500
    assert iam.plain_json('{"Statement": {"Sid": "a\\n"}}') is None and iam.plain_json('{"Statement": {"Sid": ""}}') is None
    assert iam.plain_json('{"Statement": {"Sid": "a\tb"}}') is None and iam.statements_of("a.json", '{"Statement": [') == []


def test_requirement_lines_are_taken_apart_once(files):
    text = "Django==4.2.1\nflask>=2.0\nnumpy =\r= 1.26.4  # pinned\n# x==1\n-r y==2\nUvicorn[standard]==0.30.1\npandas==2.2.0 --hash=sha256:a\nreq==1 ; python_version==\"3\""
    f = files(("requirements.txt", text))
    d = deps.requirements_txt(f)
    assert sorted((r.name, r.version) for r in d.collect()) == [("django", "4.2.1"), ("numpy", "1.26.4"), ("pandas", "2.2.0"), ("req", "1"), ("uvicorn", "0.30.1")]
    assert d._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract") <= 2
    found = conform(d.where("name = 'django'"), FINDINGS, kind=F.lit("dependency"), package=F.col("name"), vulnerable_versions=F.lit("< 9.9.1"), ord=F.col("name"))
    assert [r.patched for r in fix.patches(found, f).collect()] == [text.replace("Django==4.2.1", "Django==9.9.1")]


def test_findings_move_once_on_their_way_to_sarif_documents(spark):
    def moves(df):
        plan = df._jdf.queryExecution().executedPlan().toString()
        return plan.count("Exchange hashpartitioning") + plan.count("Exchange RoundRobin")

    f = conform(spark.createDataFrame([("o/r", f"s{i % 2}", f"{i:03}", "secret", f"r{i % 5}", "n", "high", f"f{i}") for i in range(300)],
                                      "repo string, scan_id string, ord string, kind string, rule_id string, rule_name string, severity string, file_path string"),
                FINDINGS, line_no=F.lit(1))
    d = sarif.documents(f, parts=4, max_results=10)
    # One for the counts of the scans, which holds a row for each, and one for the findings.
    assert moves(d) == 2 and "SortMergeJoin" not in d._jdf.queryExecution().executedPlan().toString()
    rows = d.withColumn("r", F.from_json("document", "runs array<struct<results:array<struct<ruleId:string,message:struct<text:string>>>>>")["runs"][0]["results"]).collect()
    assert {r.parts for r in rows} == {15} and sorted(m.message.text for r in rows for m in r.r) == sorted(f"n matched in f{i}:1" for i in range(300))
    assert all([m.message.text for m in r.r] == sorted((m.message.text for m in r.r), key=lambda t: int(t[14:-2])) for r in rows)


def test_tables_read_in_many_parts_are_not_moved_before_a_move(spark, tmp_path):
    spark.range(64).selectExpr("id as l_orderkey").repartition(16).write.parquet(f"{tmp_path}/lineitem.parquet")
    moved = lambda **how: "Exchange" in V.view(spark, str(tmp_path), "SELECT l_orderkey FROM {lineitem}", **how)._jdf.queryExecution().executedPlan().toString()
    assert moved() and not moved(moved=True)
    spark.range(64).selectExpr("id as l_orderkey").coalesce(1).write.parquet(f"{tmp_path}/one/lineitem.parquet")
    assert "Exchange" in V.view(spark, f"{tmp_path}/one", "SELECT l_orderkey FROM {lineitem}", moved=True)._jdf.queryExecution().executedPlan().toString()


def test_packed_texts_come_back(spark):
    texts = [None, "", "a", "\u0001", "\u0002", "\u0002s", "\u0002n", "\u0001\u0002e\u0001", "e\u0002\u0002\u0001s", "é\n\u0000"]
    rows = [(a, b, texts[(i + j) % 10]) for i, a in enumerate(texts) for j, b in enumerate(texts)]
    df = spark.createDataFrame(rows, "a string, b string, c string")
    got = df.withColumn("x", unpacked(packed(F.col("a"), F.col("b"), F.col("c")), ["a", "b", "c"]))
    assert all((r.a, r.b, r.c) == tuple(r.x) for r in got.collect())
