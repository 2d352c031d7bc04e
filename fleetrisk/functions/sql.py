"""Table functions for SQL users: ``SELECT * FROM files, LATERAL call_sites(content)``."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from fleetrisk.operators.calls import sites_of
from fleetrisk.operators.iam import statements_of


@udtf(returnType="line_no int, kind string, callee string, n_args int, line string")
class CallSites:
    def eval(self, content: str) -> Iterator[tuple]:
        for s in sites_of(content or ""):
            yield s["line_no"], s["kind"], s.get("callee"), len(s.get("args", [])), s["line"]


@udtf(returnType="stmt_no int, effect string, principal string, actions array<string>, resources array<string>, conditions string, source_line int")
class IamStatements:
    def eval(self, path: str, content: str) -> Iterator[tuple]:
        for i, s in enumerate(statements_of(path or "", content or "")):
            yield i, s["effect"], s["principal"], s["actions"], s["resources"], s["conditions"], s["source_line"]


def register(spark: SparkSession) -> None:
    spark.udtf.register("call_sites", CallSites)
    spark.udtf.register("iam_statements", IamStatements)
