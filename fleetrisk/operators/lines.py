"""Files to lines, and state carried along the lines of one file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fleetrisk.functions.structs import named
from fleetrisk.schemas import FILE_KEY


def explode_lines(files: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """One row per line, 1-based. The content column is dropped with the generator.

    Narrow: lines are produced where the file was read, nothing is shuffled, so one
    repository holding most of the files does not matter here.
    """
    keep = FILE_KEY if keep is None else keep
    return files.select(*keep, F.posexplode(F.split("content", "\n", -1)).alias("_p", "line")).select(
        *keep, (F.col("_p") + 1).alias("line_no"), "line"
    )


def numbered(content: Column, facts=None) -> Column:
    """Array of (n, line, facts…) of one file, without leaving its row."""

    def one(line: Column, i: Column) -> Column:
        return named(n=i + 1, line=line, **(facts(line) if facts else {}))

    return F.transform(F.split(content, "\n", -1), one)


def fold(content: Column, facts, init: dict[str, Column], step) -> Column:
    """Run a small state machine over the lines of a text; array of (n, line) it reports.

    ``facts(line)`` names booleans or numbers per line, ``step(state, fact)`` returns the
    next state (dict) and whether the line is a hit. The fold stays inside the file's own row,
    so block context costs no shuffle.
    """
    zero = named(**init, hits=F.array().cast("array<struct<n:int,line:string>>"))

    def merge(acc: Column, x: Column) -> Column:
        nxt, hit = step(acc, x)
        hits = F.when(hit, F.concat(acc["hits"], F.array(named(n=x["n"], line=x["line"])))).otherwise(acc["hits"])
        return named(**{k: nxt[k] for k in init}, hits=hits)

    return F.aggregate(numbered(content, facts), zero, merge)["hits"]


def fold_hits(files: DataFrame, facts, init: dict[str, Column], step) -> DataFrame:
    """One row per line the state machine reports."""
    return files.select(*FILE_KEY, F.explode(fold(F.col("content"), facts, init, step)).alias("_h")).select(
        *FILE_KEY, F.col("_h.n").alias("line_no"), F.col("_h.line").alias("line"))
