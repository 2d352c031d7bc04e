"""Fleet-shaped views of the driver's tables: files, findings, scans, dependencies, settings.

Each view is a narrow projection of one table (or a key join of two), so its size follows
the tables and every derived query scales with them. One repository always gets a third
of the rows, which keeps a hot key in every test.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fleetrisk.functions.structs import sql_array

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


#: The longest method that HotSpot compiles, in bytes. Spark makes longer ones, which would be interpreted for each row.
METHOD_BYTES = "8000"
LIMIT = "spark.sql.codegen.hugeMethodLimit"


def compiled(spark: SparkSession) -> None:
    """Stages whose one method would be too long to be compiled run operator by operator, whose code Spark splits. A limit that the session
    has set itself stays."""
    if spark.conf.get(LIMIT) == "65535":
        spark.conf.set(LIMIT, METHOD_BYTES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    compiled(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Keys dealt by their hash before text is built on them: the few bytes of a key move, not the text, and the work on it is as wide as
    the session's shuffles, however the table is stored."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def repo_of(key: Column) -> Column:
    """A third of all keys belong to one repository."""
    return F.when(key % 3 == 0, F.lit("acme/mono")).otherwise(
        F.concat(F.lit("org"), (key % 5).cast("string"), F.lit("/svc"), (key % 11).cast("string"))
    )


def pick(items: list[str], index: Column) -> Column:
    return F.element_at(sql_array(items), (index % len(items) + 1).cast("int"))


def path_of(paths: list[tuple[str, str]], key: Column) -> Column:
    return F.concat(pick([p for p, _ in paths], key), key.cast("string"), pick([s for _, s in paths], key))


def snippet_text(items: list[str], key: Column, base: int = 3, spread: int = 5) -> Column:
    n = (F.lit(base) + key % spread).cast("int")
    return F.array_join(F.transform(F.sequence(F.lit(1), n), lambda i: pick(items, key * 31 + i * (17 + key % 7))), "\n")


def snippet_files(spark: SparkSession, sf_dir: str, items: list[str], paths: list[tuple[str, str]],
                  source: str = "orders", key: str = "o_orderkey", base: int = 3, spread: int = 5) -> DataFrame:
    """One file per row of ``source``; content and path follow the key."""
    k = F.col(key)
    text = snippet_text(items, k, base, spread)
    return dealt(table(spark, sf_dir, source).select(key), key).select(
        repo_of(k).alias("repo"), F.lit("s1").alias("scan_id"), path_of(paths, k).alias("path"),
        F.length(text).cast("bigint").alias("size"), text.alias("content"),
    )


# Token-shaped lines; {n} is replaced by n characters of a hash of the key.
TOKEN_LINES = [
    "const a = 'ghp_{36}'", "key = sk_live_{32}", "export NPM_TOKEN=npm_{36}", "SECRET: shpat_{32}",
    "url: postgres://admin:{12}@db.internal:5432/app", "x = 1", "a = 'hvs.{32}' # b = 'hvs.zz{24}'",
    "// pattern: glpat-{20}", "dd_api_key = \"{32}\"", "Authorization: Basic none", "slack: xoxb-{24}",
    "k: /ghp_{36}/", "hook = https://hooks.slack.com/services/T0AB/B0CD/{24}", "{32}-us12",
]


def token_files(spark: SparkSession, sf_dir: str, paths: list[tuple[str, str]]) -> DataFrame:
    """Files of token-shaped lines, the tokens hashed from the key."""
    k = F.col("o_orderkey")
    hexed = F.concat(F.md5(k.cast("string")), F.md5((k + 1).cast("string")))
    text = snippet_text(TOKEN_LINES, k)
    for n in (12, 20, 24, 32, 36):
        text = F.replace(text, F.lit("{%d}" % n), F.substring(hexed, 1, n))
    return dealt(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey").select(
        repo_of(k).alias("repo"), F.lit("s1").alias("scan_id"), path_of(paths, k).alias("path"),
        F.length(text).cast("bigint").alias("size"), text.alias("content"),
    )


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as configuration files: planted tokens move to key/value lines, whole texts kept."""
    text = F.regexp_replace("text", r" ?token = \"([0-9a-f]{40})\"", "\napi_key = \"$1\"\nplain = 1\n")
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    return d.select(
        F.concat(F.lit("docs/"), "source").alias("repo"), F.lit("s1").alias("scan_id"),
        F.concat("lang", F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit(".conf")).alias("path"),
        F.col("n_chars").alias("size"), text.alias("content"),
    )
