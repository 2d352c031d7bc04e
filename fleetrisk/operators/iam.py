"""Identity-policy statements and the rules over them.

Policies come in two kinds of syntax. Braced ones (JSON, Terraform blocks and objects, policies in here-documents) are read by one reader:
matching brackets give the extent of every statement, and its entries are the ``key: value``, ``key = value`` and ``key {…}`` at its top
level. Indented ones (YAML) are read as paths of keys. Either way a statement becomes the same fields, so the rules are plain columns.
A file is one row with an array of its statements, so rules that compare the statements of a file need no join.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from fleetrisk.functions import severity as sev
from fleetrisk.functions.brackets import pairs
from fleetrisk.operators.gates import is_iam_candidate
from fleetrisk.rules import iam as R
from fleetrisk.schemas import FILE_KEY

#: A key in quotes or bare with a separator and a value, or with a block.
ENTRY = re.compile(r"""(?:"(?P<quoted>[^"\n]+)"|(?P<bare>[A-Za-z_][\w-]*))\s*(?:(?P<sep>[:=])\s*(?=\S)|(?=(?P<block>\{)))""")
STRING = re.compile(r"""\"((?:\\.|[^"\\])*)\"|'([^'\n]*)'""")
WORD = re.compile(r"[^\s,\]}#]+")
YAML_LINE = re.compile(r"^(?P<indent> *)(?P<dashes>(?:- +|-$)*)(?:(?P<key>\"[^\"]+\"|'[^']+'|[\w.:*/-]+?)\s*:(?=\s|$)\s*)?(?P<value>.*?)\s*(?:\s#.*)?$")
FIELDS = {"effect": "effect", "action": "actions", "actions": "actions", "notaction": "not_actions", "notactions": "not_actions", "resource": "resources", "resources": "resources",
          "principal": "principal", "principals": "principal", "condition": "conditions", "conditions": "conditions"}
#: Characters of a statement that are kept as evidence; the rules read the whole statement.
EVIDENCE = 300


def _texts(v) -> list[str]:
    return [v] if isinstance(v, str) else [x for x in v if isinstance(x, str)] if isinstance(v, list) else []


def _value(text: str, close: dict[int, int], at: int):
    """The value that begins at ``at`` and the place after it."""
    if text[at] in "[{" and at in close:
        end = close[at]
        return (_list if text[at] == "[" else _entries)(text, close, at + 1, end - 1), end
    if m := STRING.match(text, at):
        return (json.loads(m.group(), strict=False) if m.group(1) is not None and "\\" in m.group() and _is_json(m.group()) else m.group(1) if m.group(1) is not None else m.group(2)), m.end()
    m = WORD.match(text, at)
    return (m.group(), m.end()) if m else (None, at + 1)


def _is_json(text: str) -> bool:
    try:
        json.loads(text, strict=False)
    except ValueError:
        return False
    return True


def _list(text: str, close: dict[int, int], at: int, end: int) -> list:
    out = []
    while at < end:
        if text[at] in " \t\r\n,":
            at += 1
        elif text[at] == "#":
            at = text.find("\n", at) if "\n" in text[at:end] else end
        else:
            v, at = _value(text, close, at)
            out.append(v)
    return out


def _entries(text: str, close: dict[int, int], at: int, end: int) -> dict:
    """Entries at the top level of a braced text; a key that comes again gathers its values."""
    out: dict = {}
    while at < end:
        m = ENTRY.match(text, at, end)
        if m:
            v, at = _value(text, close, m.end())
            key = m["quoted"] or m["bare"]
            out[key] = v if key not in out else (out[key] if isinstance(out[key], list) else [out[key]]) + [v]
        elif text[at] in "#/" and text[at : at + 2] in ("//", "# ") or text[at] == "#":
            stop = text.find("\n", at)
            at = end if stop < 0 else stop
        else:
            at = close[at] if at in close else STRING.match(text, at).end() if text[at] in "\"'" and STRING.match(text, at) else at + 1
    return out


def _fields(entries: dict) -> dict:
    """Entries under the names of the statement's columns, however the syntax spells them."""
    out: dict = {}
    for key, v in entries.items():
        if field := FIELDS.get(key.replace("_", "").lower()):
            out[field] = v
    return out


def _blocks(v, name: str) -> list[dict]:
    return [x for x in (v if isinstance(v, list) else [v]) if isinstance(x, dict) and name in x]


def _statement(entries: dict, line: int | None, evidence: str, effect: str | None = None) -> dict:
    f = _fields(entries)
    who, cond = f.get("principal"), f.get("conditions")
    if found := _blocks(who, "identifiers"):  # blocks of a type and identifiers
        by: dict = {}
        for b in found:
            by.setdefault(str(b.get("type", "AWS")), []).extend(_texts(b["identifiers"]))
        who = by
    if found := _blocks(cond, "variable"):  # blocks of a test, a variable and values
        cond = {}
        for b in found:
            cond.setdefault(str(b.get("test", "")), {})[str(b["variable"])] = _texts(b.get("values"))
    effect = f.get("effect") if isinstance(f.get("effect"), str) else effect
    return {"effect": effect, "principal": None if who is None else json.dumps(who), "actions": ["!" + a for a in _texts(f.get("not_actions"))] or _texts(f.get("actions")),
            "resources": _texts(f.get("resources")), "conditions": None if cond is None else json.dumps(cond), "source_line": line, "raw_snippet": evidence[:EVIDENCE]}


#: Where the statements of a policy begin.
STATEMENTS = re.compile(r"""(?<![\w"])"?Statement"?\s*[:=]\s*(?=[\[{])""")


def _word(v):
    """A JSON value as the braced reader gives it: words stay text."""
    return "true" if v is True else "false" if v is False else "null" if v is None else [_word(x) for x in v] if type(v) is list else v


def _gathered(entries: list[tuple]) -> dict:
    out: dict = {}
    for key, v in entries:
        v = v if type(v) is str else _word(v)
        out[key] = v if key not in out else (out[key] if isinstance(out[key], list) else [out[key]]) + [v]
    return out


_JSON = json.JSONDecoder(object_pairs_hook=_gathered, parse_int=str, parse_float=str, parse_constant=str)


def plain_json(content: str) -> list[dict] | None:
    """What ``braced`` gives for JSON without escapes, empty strings and control characters in strings, read by the JSON decoder; None for other texts."""
    if "\\" in content or '""' in content:
        return None
    found: dict[int, tuple[dict, int]] = {}
    try:
        for m in STATEMENTS.finditer(content):
            at = m.end()
            if content.count('"', 0, at) % 2:  # within a string
                continue
            if content[at] == "{":
                found[at] = _JSON.raw_decode(content, at)
                continue
            at += 1
            while True:
                while content[at] in " \t\r\n,":
                    at += 1
                if content[at] == "]":
                    break
                v, end = _JSON.raw_decode(content, at)
                if content[at] == "{":
                    found[at] = v, end
                at = end
    except ValueError:
        return None
    out, at, line = [], 0, 1
    for begin in sorted(found):
        line, at = line + content.count("\n", at, begin), begin
        entries, end = found[begin]
        out.append(_statement(entries, line, content[begin:end]))
    return out


def braced(content: str) -> list[dict]:
    """Statements of JSON and Terraform texts: what stands under a key Statement, and the statement blocks of policy documents."""
    close = pairs(content)
    out, found = [], []
    for m in STATEMENTS.finditer(content):
        begin = m.end()
        if begin in close:
            inside = [begin] if content[begin] == "{" else [i for i in _children(content, close, begin) if content[i] == "{"]
            found += [(i, None) for i in inside]
    documents = [(m.end() - 1, close[m.end() - 1]) for m in re.finditer(r'data\s+"aws_iam_policy_document"\s+"[^"]*"\s*\{', content) if m.end() - 1 in close]
    for m in re.finditer(r"(?<!\w)statement\s*\{", content):
        if m.end() - 1 in close and any(a < m.start() < b for a, b in documents):
            found.append((m.end() - 1, "Allow"))  # the default of such blocks
    at, line = 0, 1
    for begin, effect in sorted(found):
        line, at = line + content.count("\n", at, begin), begin
        out.append(_statement(_entries(content, close, begin + 1, close[begin] - 1), line, content[begin : close[begin]], effect))
    return out


def _children(content: str, close: dict[int, int], begin: int) -> Iterator[int]:
    """The brackets directly within one."""
    at, end = begin + 1, close[begin] - 1
    while at < end:
        if at in close:
            yield at
            at = close[at]
        else:
            m = STRING.match(content, at) if content[at] in "\"'" else None
            at = m.end() if m else at + 1


def _scalar(text: str):
    text = text.strip()
    if text[:1] in "[{":
        return _value(text, pairs(text), 0)[0]
    return text[1:-1] if len(text) > 1 and text[0] == text[-1] and text[0] in "\"'" else text


def _tree(lines: list[tuple[int, str | None, bool, str]]):
    """Nested values of lines (indent, key, whether an item begins, value) that lie below one key."""
    if not lines:
        return None
    top = lines[0][0]
    parts: list[list] = []
    for row in lines:
        if row[0] <= top and (lines[0][2] or not row[2]):  # items may stand as deep as the key they belong to
            parts.append([row])
        else:
            parts[-1].append(row)
    if lines[0][2]:
        return [_item(p) for p in parts]
    out = {}
    for (_, key, _, value), *below in parts:
        if key is not None:
            out[key] = _scalar(value) if value else _tree(below)
    return out if out else _scalar(" ".join(r[3] for r in lines))


def _item(part: list):
    (indent, key, _, value), *below = part
    if key is None:
        return _scalar(value) if value else _tree(below)
    inner = min((r[0] for r in below), default=indent + 2)
    # The first entry stands beside the dash; its own values are deeper than the entries after it.
    return _tree([(inner if not value and below and below[0][2] else min(inner, indent + 2), key, False, value), *below]) if value else _tree([(indent + 2, key, False, value), *below])


def indented(content: str) -> list[dict]:
    """Statements of YAML texts: the items below each key Statement."""
    rows = []
    for n, line in enumerate(content.split("\n")):
        m = YAML_LINE.match(line.rstrip("\r"))
        if m and line.strip() and not line.lstrip().startswith("#"):
            key = m["key"].strip("\"'") if m["key"] else None
            dash = bool(m["dashes"])
            rows.append((n + 1, len(m["indent"]), dash, key, m["value"], line))
    out = []
    for i, (_, indent, dash, key, value, _) in enumerate(rows):
        if key != "Statement" or value:
            continue
        base = indent + (2 if dash else 0)
        j = i + 1
        while j < len(rows) and (rows[j][1] > base or rows[j][1] == base and rows[j][2]):
            j += 1
        body = rows[i + 1 : j]
        top = min((r[1] for r in body), default=0)
        starts = [k for k, r in enumerate(body) if r[1] == top and r[2]] or ([0] if body else [])
        for a, b in zip(starts, [*starts[1:], len(body)]):
            own = body[a:b]
            tree = _tree([(r[1] + (2 if k == 0 and r[2] else 0), r[3], r[2] and k > 0, r[4]) for k, r in enumerate(own)])
            if isinstance(tree, dict):
                out.append(_statement(tree, own[0][0], "\n".join(r[5] for r in own)))
    return out


def statements_of(path: str, content: str) -> list[dict]:
    p = path.lower()
    if p.endswith(".json"):
        if not _is_json(content):
            return []
        return braced(content) if (plain := plain_json(content)) is None else plain
    if p.endswith(".tf"):
        return braced(content)
    return indented(content) if p.endswith((".yml", ".yaml")) else []


STATEMENT = "struct<effect:string,principal:string,actions:array<string>,resources:array<string>,conditions:string,source_line:int,raw_snippet:string>"


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    text = pa.string()
    kind = pa.list_(pa.struct([("effect", text), ("principal", text), ("actions", pa.list_(text)), ("resources", pa.list_(text)), ("conditions", text), ("source_line", pa.int32()), ("raw_snippet", text)]))
    for batch in batches:
        found = [statements_of(p or "", c or "") for p, c in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(found, kind)], [*FILE_KEY, "statements"])


def iam_files(files: DataFrame) -> DataFrame:
    """Candidate files (JSON, Terraform, YAML) with the array of their statements. NotAction entries carry a ``!``.

    Files without the word are passed over before Python sees them.
    """
    skip = reduce(lambda a, b: a | b, [F.lower("path").rlike(p) for p in R.CANDIDATE_SKIP])
    f = files.where(is_iam_candidate(F.col("path"), F.col("size")) & ~skip & F.col("content").rlike("(?i)statement"))
    return f.select(*FILE_KEY, "content").mapInArrow(_extract, f"repo string, scan_id string, path string, statements array<{STATEMENT}>")


def iam_statements(files: DataFrame) -> DataFrame:
    """One row per statement; ``creates`` names the compute-creating actions that any statement of its file grants."""
    f = iam_files(files).withColumn("creates", F.array_join(F.array_sort(F.array_distinct(F.flatten(F.transform("statements", _creates)))), ", "))
    return f.select(*FILE_KEY, "creates", F.posexplode("statements").alias("stmt_no", "s")).select(*FILE_KEY, "stmt_no", "s.*", "creates")


def _creates(s: Column) -> Column:
    """Compute-creating actions that a statement grants."""
    plain = F.coalesce(F.lower(s["effect"]) == "allow", F.lit(False)) & ~F.exists(s["actions"], lambda a: a.startswith("!"))
    return F.array_compact(F.array(*[F.when(plain & _grants_any([t], s["actions"]), F.lit(t)) for t in R.CREATE_COMPUTE]))


def _grants(action: Column, target: str) -> Column:
    """Exact, ``*`` or trailing-star prefix."""
    a = F.lower(action)
    return (a == "*") | (a == target) | (a.endswith("*") & F.lit(target).startswith(F.regexp_replace(a, r"\*$", "")))


def _grants_any(targets: list[str], actions: Column | str = "actions") -> Column:
    return F.exists(actions, lambda a: reduce(lambda x, y: x | y, [_grants(a, t) for t in targets]))


def _named(rule_id: str) -> Column:
    r = next(r for r in R.IAM_RULES if r[0] == rule_id)
    return F.struct(F.lit(r[0]).alias("rule_id"), F.lit(r[1]).alias("rule_name"), F.lit(r[2]).alias("severity"), F.lit(r[3]).alias("category"))


def iam_findings(statements: DataFrame) -> DataFrame:
    """(repo, scan_id, path, line, rule, severity, category, detail, evidence), one per statement and rule."""
    allow = F.lower("effect") == "allow"
    negated = F.exists("actions", lambda a: a.startswith("!"))
    plain = F.coalesce(allow, F.lit(False)) & ~negated
    star = F.array_contains("resources", "*")
    who, cond = F.col("principal"), F.col("conditions")
    # Wildcard principals: the literal "*", or "*" alone or in a list under a key.
    any_star = who.rlike(r'^"\*"$|^\{.*:\s*(?:"\*"|\[[^\]]*"\*"[^\]]*\])')
    aws_star = who.rlike(r'^"\*"$|(?i)"aws":\s*(?:"\*"|\[[^\]]*"\*"[^\]]*\])')
    services = F.array_sort(F.array_distinct(F.filter(F.transform("actions", lambda a: F.split(F.lower(a), ":")[0]),
                                                      lambda s: s.isin(R.SENSITIVE_SERVICES))))
    services = F.filter(services, lambda s: F.exists("actions", lambda a: F.lower(a).startswith(F.concat(s, F.lit(":")))))
    full = F.exists("actions", lambda a: a == "*")
    wide = F.size(F.filter("actions", lambda a: (a != "*") & a.endswith(":*")))

    # GitHub OIDC trust: the first weakness wins.
    trust = (F.coalesce(allow, F.lit(True)) & F.exists("actions", lambda a: a.rlike("(?i)sts:AssumeRoleWithWebIdentity"))
             & F.lower(who).contains(R.OIDC_HOST))
    sub = F.regexp_extract(cond, r'(?i)"token\.actions\.githubusercontent\.com:sub":\s*\[?\s*"([^"]*)"', 1)
    oidc = F.when(trust & cond.isNull(), _named("iam-oidc-no-condition")).when(
        trust & (sub != ""),
        F.when(sub.rlike(r"^repo:[^/:]*/\*:|^repo:\*:"), _named("iam-oidc-wildcard-repo"))
        .when(F.lower(sub).endswith(":pull_request"), _named("iam-oidc-pull-request-trust"))
        .when(sub.rlike(r"^repo:[^/:]+/[^:]+:ref:\*") | sub.endswith(":*"), _named("iam-oidc-wildcard-ref")))
    pass_role = plain & _grants_any(["iam:passrole"])
    rules = [
        oidc, F.when(pass_role & star, _named("iam-passrole-wildcard")),
        F.when(plain & star & _grants_any(R.SELF_MANAGING), _named("iam-self-managing")),
        F.when(plain & _grants_any(["sts:assumerole"]) & cond.isNull() & (star | F.coalesce(any_star, F.lit(False))), _named("iam-assume-role-no-condition")),
        F.when(allow & negated, _named("iam-not-action-allow")),
        F.when(plain & star & (full | (wide >= R.SERVICE_WILDCARDS)), _named("iam-action-resource-wildcard")),
        F.when(plain & star & ~full & (F.size(services) > 0), _named("iam-sensitive-service-wildcard")),
        F.when(allow & aws_star & cond.isNull(), _named("iam-principal-wildcard")),
        F.when(pass_role & (F.col("creates") != ""), _named("iam-passrole-with-create-compute")),
    ]
    out = statements.withColumn("r", F.explode(F.array_compact(F.array(*rules)))).withColumn("services", F.when(F.size(services) > 0, F.array_join(services, ", ")))
    detail = F.when(F.col("r.rule_id") == "iam-sensitive-service-wildcard", F.col("services")).when(F.col("r.rule_id") == "iam-passrole-with-create-compute", F.col("creates"))
    return out.select(*FILE_KEY, "stmt_no", F.col("source_line").alias("line_no"), "r.rule_id", "r.rule_name", "r.severity", "r.category",
                      detail.alias("detail"), F.col("raw_snippet").alias("evidence"))


def iam_scores(findings: DataFrame, scans: DataFrame) -> DataFrame:
    """Score and level per scan; scans without findings score 100."""
    cost = reduce(lambda c, kv: c.when(F.col("severity") == kv[0], kv[1]), R.DEDUCTION.items(), F.when(F.lit(False), 0)).otherwise(0)
    f = findings.groupBy("repo", "scan_id").agg(F.sum(cost).alias("_cost"), F.count(F.lit(1)).alias("n"))
    out = scans.select("repo", "scan_id").distinct().join(f, ["repo", "scan_id"], "left")
    score = F.greatest(F.lit(0), 100 - F.coalesce("_cost", F.lit(0))).cast("int")
    level = F.when(score >= 90, "low").when(score >= 70, "medium").when(score >= 50, "high").otherwise("critical")
    return out.select("repo", "scan_id", score.alias("iam_score"), level.alias("iam_level"), F.coalesce("n", F.lit(0)).alias("findings"))


def iam_breakdown(findings: DataFrame, scans: DataFrame | None = None) -> DataFrame:
    """Findings and worst severity for each of the three categories, zero when absent."""
    per = []
    for c in R.CATEGORIES:
        mine = F.when(F.col("category") == c, sev.rank(F.col("severity")))
        per.append(F.struct(F.lit(c).alias("category"), F.count(mine).alias("n"),
                            F.min_by("severity", mine).alias("_s"), F.min(mine).alias("_r")))
    f = findings.select("repo", "scan_id", "category", "severity")
    if scans is not None:
        none = F.lit(None).cast("string")
        f = f.unionByName(scans.select("repo", "scan_id").distinct().select("repo", "scan_id", none.alias("category"), none.alias("severity")))
    g = f.groupBy("repo", "scan_id").agg(F.array(*per).alias("x")).select("repo", "scan_id", F.inline("x"))
    return g.select("repo", "scan_id", "category", "n", F.when(F.col("_r").isNotNull(), F.col("_s")).alias("worst"))


def worst_first(findings: DataFrame) -> DataFrame:
    return findings.orderBy("repo", "scan_id", sev.rank(F.col("severity")), "category", "path")
