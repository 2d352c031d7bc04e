"""Many detectors in one reading of the files.

A :class:`Family` says which files it wants, which line rules and file rules it runs and how it
shows a line. :func:`scan_files` turns any set of families into one projection: each file is
read and split once, rules run behind the family's gates, and only hits leave the stage.
Nothing is shuffled, so the cost is one pass over the content whatever the number of families.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from fleetrisk.functions.needles import may_match
from fleetrisk.functions.paths import is_test_like
from fleetrisk.functions.structs import named, sql_map, sql_str
from fleetrisk.functions.text import clip, self_reference
from fleetrisk.operators.rulescan import Rule, metadata
from fleetrisk.schemas import FILE_KEY, FINDINGS, conform

HIT = "struct<rule_id:string,pos:int,n:int,line:string,severity:string,description:string>"


@dataclass(frozen=True)
class Family:
    name: str
    kind: str
    gate: Callable[[], Column]  # on path, content and file columns
    rules: list[Rule] = field(default_factory=list)
    rule_gate: Callable[[tuple[str, ...]], Column] = lambda _: F.lit(True)  # on file columns
    skip: Callable[[], Column] | None = None  # on line and file columns
    conditions: list[tuple[Rule, Callable[[], Column]]] = field(default_factory=list)  # rules that are no single pattern
    reports: list[Rule] = field(default_factory=list)  # rules of file_rules
    file_rules: Callable[[], list[Column]] | None = None  # arrays of hits from the whole text
    columns: Callable[[], dict[str, Column]] | None = None  # file columns the gates need
    show: Callable[[], Column] = lambda: clip(F.col("line"))
    own_patterns: bool = True  # drop hits inside detector definitions
    matches: bool = False  # every match of a rule is a hit of its own

    def all_rules(self) -> list[Rule]:
        return [*self.rules, *[r for r, _ in self.conditions], *self.reports]


def file_hit(rule_id: str, at: Column, severity: Column | None = None, description: Column | None = None) -> Column:
    """``at`` is a struct with n and line."""
    none = F.lit(None).cast("string")
    return named(rule_id=F.lit(rule_id), pos=F.lit(1), n=at["n"], line=at["line"],
                 severity=none if severity is None else severity, description=none if description is None else description)


def _empty() -> Column:
    return F.array().cast(f"array<{HIT}>")


def _gates(fam: Family) -> dict[str, Column]:
    """File columns that say whether the family, and each gate of its rules, applies."""
    own = F.coalesce(fam.gate(), F.lit(False))
    by_gate = {f"_g_{fam.name}_{'_'.join(g)}": F.coalesce(fam.rule_gate(g), F.lit(False)) for g in {r.gate for r in fam.rules}}
    return {f"_g_{fam.name}": own, **by_gate}


def _line_hits(fam: Family) -> list[Column]:
    """Hits of one family on a line as text, ``id:offset,`` each; empty without a hit.

    A miss costs a literal test and allocates nothing; offsets are computed on hits only, and not here (0) where every match is wanted:
    those are placed one by one later.
    """
    live = f"`_v_{fam.name}`"
    found = []
    for r in fam.rules:
        p = sql_str(r.pattern)
        gate = f"_g_{fam.name}_{'_'.join(r.gate)}"
        tests = [f"`{gate}`", may_match("_lower", r.pattern), f"line RLIKE {p}", f"NOT line RLIKE {sql_str(r.suppress)}" if r.suppress else ""]
        hit = sql_str(r.id + ":0,") if fam.matches else f"concat({sql_str(r.id + ':')}, CAST(regexp_instr(line, {p}) AS STRING), ',')"
        found.append(f"CASE WHEN {' AND '.join(t for t in tests if t)} THEN {hit} END")
    out = [F.expr(f"CASE WHEN {live} THEN concat_ws('', {', '.join(found)}) END")] if found else []
    return out + [F.when(F.col(f"_v_{fam.name}") & cond(), F.lit(f"{r.id}:1,")) for r, cond in fam.conditions]


def scan_files(files: DataFrame, families: list[Family]) -> DataFrame:
    """(file, pack, rule_id, pos, line_no, line, severity, description) of every rule hit."""
    f = files
    for fam in families:
        if fam.columns:
            f = f.withColumns(fam.columns())
    extra = [c for c in f.columns if c not in (*files.columns, "content")]
    flags = {k: v for fam in families for k, v in _gates(fam).items()}
    f = f.withColumns(flags).where(reduce(lambda a, b: a | b, [F.col(f"_g_{fam.name}") for fam in families]))
    whole = [F.when(F.col(f"_g_{fam.name}"), F.concat(*fam.file_rules())).otherwise(_empty()) for fam in families if fam.file_rules]
    if whole:
        f = f.withColumn("_fh", F.concat(*whole))
    keep = [*FILE_KEY, *extra, *flags, *(["_fh"] if whole else [])]
    f = f.select(*keep, F.posexplode(F.split("content", "\n", -1)).alias("_p", "line"))
    h = _hits_of(f, families, [*FILE_KEY, *extra, "_p"], bool(whole))
    return h.select(*FILE_KEY, *extra, "pack", F.col("h.rule_id").alias("rule_id"), F.col("h.pos").alias("pos"),
                    F.coalesce("h.n", F.col("_p") + 1).alias("line_no"), F.coalesce("h.line", "_line").alias("line"),
                    F.col("h.severity").alias("_sev"), F.col("h.description").alias("description"))


def scan_lines(lines: DataFrame, family: Family) -> DataFrame:
    """Hits of one family on a table that already has a ``line`` column; every match when it wants them."""
    keep = [c for c in lines.columns if c != "line"]
    f = lines.withColumns({**_gates(family), "_p": F.lit(0)})
    h = _hits_of(f, [family], keep, False)
    h = h.select(*keep, "pack", F.col("_line").alias("line"), F.col("h.rule_id").alias("rule_id"), F.col("h.pos").alias("pos"))
    return _every_match(h, [family])


def _hits_of(f: DataFrame, families: list[Family], keep: list[str], whole: bool) -> DataFrame:
    """``keep``, pack, _line and h, one row per hit of the lines in ``f``."""
    with_rules = [fam for fam in families if fam.rules or fam.conditions]
    live = {f"_v_{fam.name}": F.col(f"_g_{fam.name}") & ~fam.skip() if fam.skip else F.col(f"_g_{fam.name}") for fam in with_rules}
    f = f.withColumns({"_lower": F.lower("line"), **live})
    # A higher-order function keeps this projection out of whole-stage code: one fused method with
    # hundreds of rules is too long for the JIT, separate short ones are not.
    f = f.withColumns({"_hits": F.concat_ws("", *[h for fam in with_rules for h in _line_hits(fam)]) if with_rules else F.lit(""),
                       "_read": F.exists(F.array("_p"), lambda p: p >= 0)})

    def parse(token: Column) -> Column:
        none = F.lit(None).cast("string")
        return named(rule_id=F.substring_index(token, ":", 1), pos=F.substring_index(token, ":", -1).cast("int"), n=F.lit(None).cast("int"),
                     line=none, severity=none, description=none)

    # The explode is the only filter: a where() on the hits would be pushed below and run every rule twice.
    some = (F.col("_hits") != "") & F.col("_read")
    packs = {i: fam.name for fam in families for i in dict.fromkeys(r.id for r in fam.all_rules())}
    pack = F.lit(families[0].name) if len(families) == 1 else F.element_at(sql_map(list(packs.items())), F.col("h.rule_id"))
    keep = [*keep, F.col("line").alias("_line")]
    if whole:
        hits = F.when(some, F.transform(F.filter(F.split("_hits", ","), lambda t: t != ""), parse))
        own = F.when((F.col("_p") == 0) & (F.size("_fh") > 0), F.col("_fh"))
        hits = F.when(own.isNull(), hits).otherwise(F.concat(F.coalesce(hits, _empty()), own))
        h = f.select(*keep, F.explode(hits).alias("h"))
    else:
        # Hits leave as texts and are read in their own rows, so that no lambda is interpreted for them.
        h = f.select(*keep, F.explode(F.when(some, F.split(F.expr("substr(_hits, 1, length(_hits) - 1)"), ","))).alias("_t"))
        h = h.withColumn("h", parse(F.col("_t"))).drop("_t")
    return h.withColumn("pack", pack)


def _every_match(hits: DataFrame, families: list[Family]) -> DataFrame:
    """One row per match for the families that want it; offsets searched left to right."""
    many = [fam for fam in families if fam.matches]
    if not many:
        return hits.withColumn("match", F.lit(None).cast("string"))
    start = named(out=F.array().cast("array<struct<m:string,at:int>>"), next=F.lit(1))

    def placed(m: Column, start: Column) -> Column:
        return F.call_function("locate", m, F.col("line"), start)

    def step(acc: Column, m: Column) -> Column:
        at = placed(m, acc["next"])
        return named(out=F.concat(acc["out"], F.array(named(m=m, at=at))), next=at + F.length(m))

    # Each pattern is a literal, compiled once in a task; one looked up for each row is compiled anew whenever the rule changes.
    wanted = F.col("pack").isin([fam.name for fam in many])
    found = _by_rule(many, lambda r: F.regexp_extract_all(F.col("line"), F.lit(r.pattern), F.lit(0)))
    hits = hits.withColumn("_found", F.when(wanted, found))
    one = F.array(named(m=F.col("_found")[0], at=placed(F.col("_found")[0], F.lit(1))))
    pairs = F.when(~wanted, F.array(named(m=F.lit(None).cast("string"), at=F.col("pos")))).when(F.size("_found") == 1, one).otherwise(
        F.aggregate("_found", start, step)["out"])
    hits = hits.withColumn("_pairs", pairs).drop("_found")
    # Not the bare column: Spark would test its size below, and so make it twice.
    pairs = F.when(F.col("rule_id") != "", F.col("_pairs"))
    cols = [c for c in hits.columns if c not in ("pos", "_pairs")]
    out = hits.select(*cols, F.explode(pairs).alias("_z"))
    return out.select(*cols, F.col("_z.m").alias("match"), F.col("_z.at").alias("pos")).where(F.coalesce(F.length("match"), F.lit(1)) > 0)


def _by_rule(families: list[Family], value: Callable[[Rule], Column]) -> Column:
    out = None
    for r in {r.id: r for fam in families for r in fam.rules}.values():
        cond = F.col("rule_id") == r.id
        out = F.when(cond, value(r)) if out is None else out.when(cond, value(r))
    return F.array().cast("array<string>") if out is None else out


def _by_pack(families: list[Family], value: Callable[[Family], Column | None]) -> Column:
    out = None
    for fam in families:
        v = value(fam)
        if v is not None:
            cond = F.col("pack") == fam.name
            out = F.when(cond, v) if out is None else out.when(cond, v)
    return out


def to_findings(hits: DataFrame, families: list[Family]) -> DataFrame:
    """Hits as canonical findings, self-references dropped where the family asks for it."""
    h = _every_match(hits, families)
    checked = [fam.name for fam in families if fam.own_patterns]
    if checked:
        h = h.where(~(F.col("pack").isin(checked) & self_reference(F.col("line"), F.col("pos"))))
    rules = [r for fam in families for r in fam.all_rules()]
    m = F.element_at(metadata(rules, "name", "severity", "category", "cwe"), F.col("rule_id"))
    h = h.withColumn("_m", m)
    return conform(
        h, FINDINGS, kind=_by_pack(families, lambda fam: F.lit(fam.kind)), rule_name=F.col("_m.name"),
        severity=F.coalesce("_sev", "_m.severity"), category=F.col("_m.category"), cwe=F.col("_m.cwe"), file_path=F.col("path"),
        line_content=_by_pack(families, lambda fam: fam.show()), likely_test_fixture=is_test_like(F.col("path")),
        source=_by_pack(families, lambda fam: F.lit("tree" if fam.kind == "secret" else None).cast("string")))


def detect(files: DataFrame, families: list[Family]) -> DataFrame:
    return to_findings(scan_files(files, families), families)
