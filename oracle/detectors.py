"""Check SQL of the file, secret, source-code and infrastructure detectors."""

from __future__ import annotations

from fleetrisk.functions import paths as P
from fleetrisk.functions.text import TOKEN_SHAPES
from fleetrisk.operators import gates as G, iac as IO, sast as SO
from fleetrisk.plans import derived as D, registry as R, snippets as S
from fleetrisk.rules import iac as I, sast as C, secrets as X, sensitive as N
from oracle.base import (
    DOCUMENT_FILES, LINES, any_rx, base, ext, is_in, mask, prose, q, repo_of, rule_hits, rx, self_reference,
    snippet_files, token_files, with_ctes,
)

OUT = "repo, path AS file_path, line_no, rule_id, severity"
REAL = f"NOT {self_reference('line', 'pos')}"
LANG = (f"CASE WHEN {is_in(ext(), P.JS_EXTENSIONS)} THEN 'js' WHEN {is_in(ext(), P.PY_EXTENSIONS)} THEN 'python' "
        f"WHEN {is_in(ext(), P.JAVA_EXTENSIONS)} THEN 'java' WHEN {ext()} = 'php' THEN 'php' WHEN {ext()} = 'rb' THEN 'ruby' END")


def code_gate(gate) -> str:
    if gate == ("any",):
        return is_in(ext(), P.SOURCE_EXTENSIONS)
    if gate == ("config",):
        return is_in(ext(), P.CONFIG_EXTENSIONS)
    return is_in(f"({LANG})", list(gate))


COMMENT = "regexp_matches(line, '^\\s*(//|\\*|#)')"


def _code(items, paths, rules, extra="TRUE", skip=None, gate=code_gate, where=REAL, out=OUT):
    hits = f"hits AS ({rule_hits(rules, gate, skip=skip)})"
    return with_ctes(snippet_files(items, paths), LINES, hits, select=f"SELECT {out} FROM hits WHERE {where} AND {extra}")


def _iac(items, paths, rules, gate=lambda g: "TRUE", where="TRUE", b=3, sp=5, files_where="TRUE", union="", skip=None):
    files = snippet_files(items, paths, base=b, spread=sp).replace("files AS (", "raw_files AS (", 1)
    hits = rule_hits(rules, gate, skip=skip)
    return with_ctes(files, f"files AS (SELECT * FROM raw_files WHERE {files_where})", LINES,
                     f"hits AS ({hits})" if rules else "hits AS (SELECT *, '' AS rule_id, '' AS severity, '' AS category, 0 AS pos FROM lines WHERE FALSE)",
                     select=f"SELECT {OUT} FROM hits WHERE {where}" + union)


W = "OVER (PARTITION BY repo, scan_id, path ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND {})"
UPTO, BEFORE = W.format("CURRENT ROW"), W.format("1 PRECEDING")


def _rule(r, line_no="line_no") -> str:
    return f"repo, path AS file_path, {line_no} AS line_no, {q(r.id)} AS rule_id, {q(r.severity)} AS severity"


def dockerfile() -> str:
    parts = []
    for r in I.DOCKER_RULES:
        cond = rx("line", r.pattern) + (f" AND NOT {rx('line', r.suppress)}" if r.suppress else "")
        parts.append(f"SELECT {_rule(r, 'min(line_no)')} FROM lines WHERE {cond} GROUP BY repo, path")
    root = I.DOCKER_USER_ROOT
    parts.append(
        f"SELECT {_rule(root, f'''coalesce(min(line_no) FILTER ({rx('line', root.pattern)}), 1)''')} FROM lines GROUP BY repo, path "
        f"HAVING count(*) FILTER ({rx('line', I.DOCKER_NON_ROOT_USER)} AND NOT {rx('line', I.DOCKER_ROOT_USER)}) = 0")
    return with_ctes(snippet_files(S.DOCKER, R.DOCKER_PATHS), LINES, select=" UNION ALL ".join(parts))


def base_images() -> str:
    eol = ", ".join(f"({q(i)}, {q(k)}, {q(key)}, DATE {q(d)})" for i, k, key, d in I.BASE_IMAGE_EOL)
    return with_ctes(
        snippet_files(S.DOCKER, R.DOCKER_PATHS), LINES,
        "f0 AS (SELECT *, regexp_replace(regexp_extract(line, '(?i)^\\s*FROM\\s+(.+?)\\s*$', 1), '(?i)^--platform=\\S+\\s+', '') AS rest FROM lines WHERE regexp_matches(line, '(?i)^\\s*FROM\\s+.*\\S'))",
        "f1 AS (SELECT *, lower(regexp_extract(rest, '(?i)\\s+AS\\s+(\\S+)\\s*$', 1)) AS al, trim(regexp_replace(rest, '(?i)\\s+AS\\s+\\S+\\s*$', '')) AS ref FROM f0)",
        f"f2 AS (SELECT *, list(al) {BEFORE} AS earlier FROM f1)",
        "f3 AS (SELECT *, split_part(ref, '@', 1) AS raw FROM f2 WHERE NOT coalesce(list_contains(list_filter(earlier, lambda a: a <> ''), lower(ref)), FALSE) AND lower(ref) <> 'scratch' AND NOT starts_with(ref, '$'))",
        "f4 AS (SELECT *, lower(regexp_replace(regexp_replace(raw, '^.*/', ''), ':[^:]*$', '')) AS image, CASE WHEN contains(regexp_replace(raw, '^.*/', ''), ':') THEN lower(regexp_extract(raw, ':([^:]*)$', 1)) ELSE '' END AS tag FROM f3)",
        f"eol(image, kind, k, d) AS (VALUES {eol})",
        "m AS (SELECT f4.*, eol.d, row_number() OVER (PARTITION BY f4.repo, f4.path, f4.line_no ORDER BY CASE kind WHEN 'name' THEN 1 WHEN 'minor' THEN 2 WHEN 'major' THEN 3 ELSE 4 END) AS rn "
        "FROM f4 JOIN eol ON f4.image = eol.image AND CASE kind WHEN 'any' THEN TRUE WHEN 'name' THEN starts_with(tag, k) "
        "WHEN 'raw' THEN regexp_extract(tag, '^\\d+\\.\\d+') = k WHEN 'major' THEN regexp_extract(tag, '^\\d+') = k "
        "ELSE regexp_extract(tag, '^\\d+\\.\\d+') = k END WHERE tag <> '')",
        select="SELECT repo, path AS file_path, line_no, 'dockerfile-base-image-eol' AS rule_id, "
        f"CASE WHEN date_diff('day', d, DATE {q(R.AS_OF)}) > 365 THEN 'high' ELSE 'medium' END AS severity FROM m WHERE rn = 1 AND d <= DATE {q(R.AS_OF)}")


def github_actions() -> str:
    pr = (f"SELECT {_rule(I.GHA_PR_TARGET)} FROM (SELECT *, {rx('line', I.GHA_PR_TARGET.pattern)} AND NOT ck AND NOT st AS bad, "
          f"max(CASE WHEN ck THEN line_no END) {BEFORE} AS c, max(CASE WHEN st AND NOT ck THEN line_no END) {BEFORE} AS s, "
          f"max(CASE WHEN {rx('line', I.GHA_PR_TARGET.pattern)} AND NOT ck AND NOT st THEN line_no END) {BEFORE} AS b FROM "
          f"(SELECT l.*, {rx('line', I.GHA_CHECKOUT)} AS ck, {rx('line', I.GHA_STEP)} AS st FROM lines l JOIN files f USING (repo, scan_id, path) "
          f"WHERE {rx('content', I.GHA_PR_TARGET_TRIGGER)})) WHERE bad AND c IS NOT NULL AND coalesce(s, 0) < c AND coalesce(b, 0) < c")
    inj = (f"SELECT {_rule(I.GHA_INJECTION)} FROM (SELECT *, max(CASE WHEN blk THEN line_no END) {BEFORE} AS b, "
           f"max(CASE WHEN st AND NOT blk THEN line_no END) {UPTO} AS s FROM (SELECT *, {rx('line', I.GHA_RUN_BLOCK)} AS blk, {rx('line', I.GHA_STEP)} AS st FROM lines)) "
           f"WHERE NOT blk AND {rx('line', I.GHA_INJECTION.pattern)} AND ((b IS NOT NULL AND coalesce(s, 0) < b) OR {rx('line', I.GHA_RUN_INLINE)})")
    uses = f"regexp_extract(line, {q(I.GHA_UNPINNED.pattern)}, 1)"
    ref = f"regexp_extract(line, {q(I.GHA_UNPINNED.pattern)}, 2)"
    unp = f"SELECT {_rule(I.GHA_UNPINNED)} FROM lines WHERE {uses} <> '' AND NOT {rx(uses, I.GHA_FIRST_PARTY)} AND NOT {rx(ref, I.GHA_SHA)}"
    wa = f"SELECT {_rule(I.GHA_WRITE_ALL)} FROM lines WHERE {rx('line', I.GHA_WRITE_ALL.pattern)}"
    env = (f"SELECT {_rule(I.GHA_ENV_SECRET)} FROM (SELECT *, regexp_replace(regexp_replace(v0, '^\"(.*)\"$', '\\1'), '^''(.*)''$', '\\1') AS v FROM "
           f"(SELECT *, regexp_extract(line, {q(I.GHA_ENV_SECRET.pattern)}, 1) AS k, trim(regexp_extract(line, {q(I.GHA_ENV_SECRET.pattern)}, 2)) AS v0 FROM lines)) "
           f"WHERE k <> '' AND NOT {rx('k', I.GHA_CONFIG_KEY)} AND NOT starts_with(v0, '#') AND v <> '' AND NOT contains(v, '${{{{') "
           f"AND NOT starts_with(v, '$') AND NOT {rx('v', I.GHA_PLAIN_VALUE)}")
    return with_ctes(snippet_files(S.WORKFLOW, R.WORKFLOW_PATHS, base=8, spread=9), LINES, select=" UNION ALL ".join([pr, inj, unp, wa, env]))


def terraform() -> str:
    # Inside an ingress block when some earlier opening line has no close back to its depth since.
    opens = "length(regexp_replace(line, '[^{\\[]', '', 'g'))"
    closes = "length(regexp_replace(line, '[^}\\]]', '', 'g'))"
    low = ("list_min(list_transform(range(1, length(line) + 1), lambda i: CASE WHEN substr(line, i, 1) IN ('}', ']') THEN "
           "length(regexp_replace(substr(line, 1, i), '[^{\\[]', '', 'g')) - length(regexp_replace(substr(line, 1, i), '[^}\\]]', '', 'g')) END))")
    extra = (
        f" UNION ALL SELECT {_rule(I.TF_INGRESS)} FROM d WHERE {rx('line', '(?i)cidr_blocks')} AND {rx('line', I.TF_INGRESS.pattern)} AND EXISTS ("
        f"SELECT 1 FROM d s WHERE s.path = d.path AND s.line_no <= d.line_no AND {rx('s.line', I.TF_INGRESS_OPEN)} AND NOT EXISTS ("
        "SELECT 1 FROM d e WHERE e.path = d.path AND e.line_no >= s.line_no AND e.line_no < d.line_no AND e.depth + e.low <= s.depth))")
    sql = _iac(S.TERRAFORM, R.TERRAFORM_PATHS, I.TERRAFORM_LINE_RULES, b=8, sp=9, union=extra)
    d = (f"d AS (SELECT *, coalesce(sum({opens} - {closes}) {BEFORE}, 0) AS depth, {low} AS low FROM lines)")
    return sql.replace("hits AS (", d + ", hits AS (", 1)


def cloudformation() -> str:
    mode = f"CASE WHEN {rx('line', I.CFN_ENTER_INGRESS)} THEN 1 WHEN {rx('line', I.CFN_ENTER_EGRESS)} THEN 2 END"
    extra = (f" UNION ALL SELECT {_rule(I.CFN_INGRESS)} FROM (SELECT *, last_value({mode} IGNORE NULLS) {UPTO} AS m FROM lines) "
             f"WHERE coalesce(m, 0) <> 2 AND {rx('line', I.CFN_INGRESS.pattern)} AND {rx('line', I.CFN_OPEN_CIDR)}")
    where = ("(contains(content, 'AWSTemplateFormatVersion') OR (regexp_matches(content, '(^|\\n)\\s*\"?Resources\"?\\s*:') "
             "AND regexp_matches(content, '\"?Type\"?\\s*:\\s*[\"'']?AWS::')))")
    return _iac(S.CLOUDFORMATION, R.CFN_PATHS, I.CLOUDFORMATION_LINE_RULES, b=6, sp=7, files_where=where, union=extra)


def kubernetes() -> str:
    where = "regexp_matches(content, '(?m)^apiVersion:\\s*\\S') AND regexp_matches(content, '(?m)^kind:\\s*\\S')"
    ind = "length(regexp_extract(line, '^(\\s*)', 1))"
    block, inline = rx("line", I.K8S_ADD_BLOCK), f"regexp_extract(line, {q(I.K8S_ADD_INLINE)}, 1)"
    item = "regexp_matches(line, '^\\s*-\\s+\\S')"
    live = "NOT contains(line, '{{')"
    # A listed item counts when the latest block above it has not been closed by an outdented line since.
    listed = f"SELECT {_rule(I.K8S_CAPS)} FROM k WHERE item AND inl = '' AND ind > bi AND coalesce(closed, 0) <= bn AND {rx('line', I.K8S_CAPS.pattern)}"
    inl = f"SELECT {_rule(I.K8S_CAPS)} FROM k WHERE inl <> '' AND {rx('inl', I.K8S_CAPS.pattern)}"
    sql = _iac(S.KUBERNETES, R.K8S_PATHS, I.KUBERNETES_LINE_RULES, b=10, sp=9, files_where=where, skip="contains(line, '{{')",
               union=f" UNION ALL {listed} UNION ALL {inl}")
    k = (f"k0 AS (SELECT *, {ind} AS ind, {block} AS blk, {inline} AS inl, {item} AS item FROM lines WHERE {live}), "
         f"k1 AS (SELECT *, max(CASE WHEN blk THEN line_no END) {BEFORE} AS bn, last_value(CASE WHEN blk THEN ind END IGNORE NULLS) {BEFORE} AS bi FROM k0), "
         f"k AS (SELECT *, max(CASE WHEN NOT item AND NOT blk AND inl = '' AND trim(line) <> '' AND ind <= bi THEN line_no END) {BEFORE} AS closed FROM k1)")
    return sql.replace("hits AS (", k + ", hits AS (", 1)


def iam_policies() -> str:
    lines = ("lines AS (SELECT repo, scan_id, path, aws, azure, unnest(range(1, len(ls) + 1))::INTEGER AS line_no, unnest(ls) AS line FROM "
             f"(SELECT *, string_split(content, chr(10)) AS ls, {rx('content', I.AWS_CONTEXT[0])} AND {rx('content', I.AWS_CONTEXT[1])} AS aws, "
             f"{rx('content', I.AZURE_CONTEXT)} AS azure FROM files WHERE NOT {rx('path', I.IAM_POLICY_SKIP)}))")
    of = {"aws": "aws", "azure": "azure", "not-azure": "NOT azure", "any": "TRUE"}
    hits = f"hits AS ({rule_hits(I.IAM_POLICY_RULES, lambda g: of[g[0]])})"
    return with_ctes(snippet_files(S.IAM_POLICY, R.IAM_POLICY_PATHS, base=5, spread=6), lines, hits, select=f"SELECT {OUT} FROM hits")


def sensitive() -> str:
    whens = []
    for kind, _, sev, tests in N.SENSITIVE_FILES:
        conds = []
        for subject, pattern, unless in tests:
            s = "path" if subject == "path" else base()
            conds.append("(" + rx(s, pattern) + (f" AND NOT {rx(s, unless)}" if unless else "") + ")")
        c = "(" + " OR ".join(conds) + ")"
        if kind == "database-dump":
            c += f" AND NOT {rx('path', N.MIGRATION_PATH)} AND NOT {rx(base(), N.MIGRATION_BASE)}"
        whens.append(f"WHEN {c} THEN '{kind}|{sev}'")
    return with_ctes(
        snippet_files([""], S.SENSITIVE_PATHS), f"m AS (SELECT *, CASE {' '.join(whens)} END AS r FROM files WHERE NOT {any_rx('path', N.SENSITIVE_SKIP)})",
        select="SELECT repo, path AS file_path, split_part(r, '|', 1) AS rule_id, split_part(r, '|', 2) AS severity FROM m WHERE r IS NOT NULL")


def token_secrets() -> str:
    parts = []
    for r in X.SECRET_RULES:
        parts.append(f"SELECT repo, path, line_no, line, {q(r.id)} AS rule_id, {q(r.severity)} AS severity, "
                     f"unnest(regexp_extract_all(line, {q(r.pattern)})) AS m, unnest(range(1, len(regexp_extract_all(line, {q(r.pattern)})) + 1)) AS n "
                     f"FROM lines WHERE {rx('line', r.pattern)}")
    # Every repeated match in these lines differs, so its first occurrence is its position.
    return with_ctes(token_files(D.TOKEN_LINES, S.SCAN_PATHS), LINES, f"hits AS ({' UNION ALL '.join(parts)})",
                     "pos AS (SELECT *, strpos(line, m) AS pos FROM hits)",
                     select=f"SELECT repo, path AS file_path, line_no, rule_id, severity, trim(replace(line, m, {mask('m')})) AS line_content FROM pos WHERE {REAL}")


def entropy_secrets(min_entropy: float) -> str:
    kv = X.KEY_VALUE
    placeholder = any_rx("value", X.PLACEHOLDERS)
    ent = ("list_sum(list_transform(list_distinct(string_split(value, '')), lambda c: -((length(value) - length(replace(value, c, ''))) / length(value)) "
           "* log2((length(value) - length(replace(value, c, ''))) / length(value))))")
    return with_ctes(
        DOCUMENT_FILES, LINES,
        f"kv AS (SELECT *, regexp_extract(ltrim(line), {q(kv)}, 1) AS key, trim(regexp_extract(ltrim(line), {q(kv)}, 2)) AS raw FROM lines "
        f"WHERE NOT regexp_matches(ltrim(line), '^(#|;|//|$)') AND {rx('ltrim(line)', kv)})",
        "kv2 AS (SELECT *, regexp_replace(CASE WHEN (raw LIKE '\"%\"') OR (raw LIKE '''%''') THEN substr(raw, 2, greatest(length(raw) - 2, 0)) ELSE raw END, '(.)\\s+#.*$', '\\1') AS value FROM kv)",
        f"kv3 AS (SELECT *, {ent} AS entropy FROM kv2 WHERE length(value) >= 20 AND {rx('key', X.SECRET_KEY)} AND NOT {placeholder})",
        f"kv4 AS (SELECT *, row_number() OVER (PARTITION BY repo, path, key, value ORDER BY line_no) AS rn FROM kv3 WHERE entropy >= {min_entropy})",
        select=f"SELECT repo, path AS file_path, line_no, CASE WHEN entropy >= 4.5 THEN 'high' ELSE 'medium' END AS severity, "
        f"trim(replace(line, value, {mask('value')})) AS line_content FROM kv4 WHERE rn = 1")


def document_scores() -> str:
    tok = " UNION ALL ".join(
        f"SELECT repo, path, line_no, {q(r.severity)} AS severity, unnest(regexp_extract_all(line, {q(r.pattern)})) AS m, line FROM lines WHERE {rx('line', r.pattern)}"
        for r in X.SECRET_RULES)
    ent = entropy_secrets(R.DOC_ENTROPY)
    cut = ent.rindex(" SELECT repo, path AS file_path")
    return (ent[:cut] + f", tk AS ({tok}), tk2 AS (SELECT repo, path, severity, strpos(line, m) AS pos, line FROM tk), "
            f"a AS (SELECT repo, severity, {any_rx('path', P.TEST_PATH_PATTERNS)} AS fx FROM tk2 WHERE {REAL} UNION ALL SELECT repo, CASE WHEN entropy >= 4.5 THEN 'high' ELSE 'medium' END, FALSE FROM kv4 WHERE rn = 1), "
            "s AS (SELECT repo, count(*) AS findings, sum(CASE WHEN severity = 'critical' THEN 40.0 ELSE 0 END) AS c, sum(CASE WHEN severity = 'high' THEN 15.0 ELSE 0 END) AS h, "
            "sum(CASE WHEN severity = 'medium' THEN 5.0 ELSE 0 END) AS m, sum(CASE WHEN severity = 'low' THEN 1.0 ELSE 0 END) AS l FROM a GROUP BY repo), "
            "z AS (SELECT *, least(100, round(25 * log10(1 + (c + h + m + l)::DOUBLE)))::INTEGER AS risk_score FROM s) "
            "SELECT repo, coalesce(findings, 0) AS findings, coalesce(h, 0)::DOUBLE AS high, coalesce(m, 0)::DOUBLE AS medium, coalesce(risk_score, 0) AS risk_score, CASE WHEN 100 - risk_score >= 90 THEN 'Excellent' WHEN 100 - risk_score >= 70 THEN 'Good' "
            "WHEN 100 - risk_score >= 50 THEN 'Needs attention' WHEN 100 - risk_score < 50 THEN 'Critical' ELSE 'Excellent' END AS label FROM (SELECT DISTINCT repo FROM files) LEFT JOIN z USING (repo)")


def framework_rules() -> str:
    fw = "CASE " + " ".join(f"WHEN rule_id = {q(r.id)} THEN {q(r.framework)}" for r in C.FRAMEWORK_RULES) + " END"
    return with_ctes(
        snippet_files(S.JS + S.PY + S.OTHER_CODE, R.FRAMEWORK_PATHS), LINES, R.ORACLE_FRAMEWORKS,
        f"hits AS ({rule_hits(C.FRAMEWORK_RULES, code_gate)})",
        select=f"SELECT {OUT} FROM hits WHERE {REAL} AND EXISTS (SELECT 1 FROM fw WHERE fw.repo = hits.repo AND fw.framework = {fw})")


def scannable(size: str = "size") -> str:
    name = f"lower({base()})"
    return (f"(NOT {any_rx('path', G.SKIP_PATHS)} AND (CASE WHEN contains({base()}, '.') THEN {is_in(ext(), G.SCANNABLE_EXTENSIONS)} "
            f"ELSE {name} IN ('dockerfile', 'makefile') END OR starts_with({name}, '.env')))")


def tier() -> str:
    return (f"CASE WHEN {any_rx('path', [*P.TEST_PATH_PATTERNS, '(?i)^docs?/'])} THEN 4 "
            f"WHEN regexp_matches(lower(path), '(^|/)({'|'.join(G.SOURCE_DIRS)})/') THEN 1 WHEN {any_rx('path', G.ROOT_OR_CI)} THEN 2 ELSE 3 END")


def path_facts() -> str:
    cls = (f"CASE WHEN regexp_matches({base()}, '(?i)^Dockerfile(\\.[A-Za-z0-9._-]+)?$') OR regexp_matches({base()}, '(?i)\\.dockerfile$') THEN 'dockerfile' "
           "WHEN regexp_matches(path, '(?i)^\\.github/workflows/[^/]+\\.ya?ml$') THEN 'workflow' WHEN regexp_matches(path, '(?i)\\.(tf|tfvars)$') THEN 'terraform' "
           "WHEN regexp_matches(path, '(?i)\\.ya?ml$') THEN 'yaml' WHEN regexp_matches(path, '(?i)\\.json$') THEN 'json' ELSE 'other' END")
    return with_ctes(
        snippet_files([""], S.SCAN_PATHS + S.SENSITIVE_PATHS), "f AS (SELECT *, length(content) AS size FROM files)",
        select=f"SELECT repo, path AS file_path, {scannable()} AS scannable, {any_rx('path', P.TEST_PATH_PATTERNS)} AS test_like, "
        f"{any_rx('lower(path)', P.PUBLIC_ROUTE_PATTERNS)} AS public_route, {LANG} AS lang, {cls} AS file_class, ({tier()})::INTEGER AS tier, "
        "(path = 'src' OR starts_with(path, 'src/')) AS in_src FROM f")


def coverage() -> str:
    return with_ctes(snippet_files([""], S.SCAN_PATHS), "f AS (SELECT *, length(content) AS size FROM files)",
                     select=f"SELECT repo, count(*) FILTER ({scannable()}) AS files_scanned, count(*) FILTER (NOT {scannable()}) AS files_skipped, FALSE AS truncated FROM f GROUP BY repo")


def priority() -> str:
    return with_ctes(snippet_files([""], S.SCAN_PATHS), "f AS (SELECT *, length(content) AS size FROM files)",
                     select=f"SELECT repo, path AS file_path, ({tier()})::INTEGER AS tier FROM f WHERE {scannable()}")


REAL_TEXTS = {
    "pages": "files AS (SELECT 'web/pages' AS repo, 's1' AS scan_id, 'src/page_' || page_id || '.js' AS path, coalesce(html, '') AS content FROM pages)",
    "conversations": "files AS (SELECT 'web/conversations' AS repo, 's1' AS scan_id, 'src/conv_' || conv_id || '_' || turn || '.py' AS path, coalesce(text, '') AS content FROM conversations)",
    "documents": "files AS (SELECT 'web/documents' AS repo, 's1' AS scan_id, 'src/doc_' || doc_id || '.py' AS path, coalesce(text, '') AS content FROM documents)",
}


def real_tokens(name: str) -> str:
    parts = [f"SELECT repo, path, line_no, line, {q(r.id)} AS rule_id, {q(r.severity)} AS severity, unnest(regexp_extract_all(line, {q(r.pattern)})) AS m FROM lines WHERE {rx('line', r.pattern)}" for r in X.SECRET_RULES]
    return with_ctes(REAL_TEXTS[name], LINES, f"hits AS ({' UNION ALL '.join(parts)})", "pos AS (SELECT *, strpos(line, m) AS pos FROM hits)",
                     select=f"SELECT rule_id, severity, count(*) AS n FROM pos WHERE {REAL} GROUP BY ALL")


def real_code(name: str) -> str:
    hits = f"hits AS ({rule_hits(C.SAST_RULES, code_gate, skip=COMMENT)} UNION ALL {rule_hits(C.AI_RULES, code_gate)})"
    ai = ", ".join(q(r.id) for r in C.AI_RULES)
    return with_ctes(REAL_TEXTS[name], LINES, hits, select=f"SELECT path AS file_path, line_no, rule_id, severity FROM hits WHERE {REAL} AND (rule_id NOT IN ({ai}) OR NOT {prose('line', 'pos')})")


def sql() -> dict[str, str]:
    js_py = S.JS + S.PY
    ai_shown = f"NOT {prose('line', 'pos')}"
    return {
        "fleet_scan_scores": document_scores(), "flt_path_facts": path_facts(), "flt_coverage": coverage(), "top_2_file_priority": priority(),
        "sfn_1_sensitive_files": sensitive(), "sec_1_token_secrets": token_secrets(), "sec_3_entropy_secrets": entropy_secrets(R.DOC_ENTROPY),
        "sast_1_code_vulns": _code(js_py, R.CODE_PATHS, C.SAST_RULES, skip=COMMENT),
        "biz_1_business_logic": _code(js_py, R.CODE_PATHS, C.BIZ_RULES, skip=f"regexp_matches(line, '^\\s*(//|\\*)') OR ({LANG} = 'python' AND regexp_matches(line, '^\\s*#'))"),
        "ai_1_scaffold_tells": _code(js_py, R.CODE_PATHS, C.AI_RULES, extra=ai_shown),
        "fw_3_framework_rules": framework_rules(),
        "iac_d_dockerfile": dockerfile(), "iac_e_base_images": base_images(), "iac_g_github_actions": github_actions(),
        "iac_t_terraform": terraform(), "iac_c_cloudformation": cloudformation(), "iac_k_kubernetes": kubernetes(),
        **{f"sec_1_real_{n}": real_tokens(n) for n in REAL_TEXTS}, **{f"sast_1_real_{n}": real_code(n) for n in REAL_TEXTS},
        "iac_h_helm_values": _iac(S.HELM, R.HELM_PATHS, I.HELM_RULES), "iac_p_iam_policies": iam_policies(),
    }
