"""Column expressions on repository paths. All stay inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

# Path shapes that mark tests, fixtures, examples and demos.
TEST_PATH_PATTERNS = [
    r"(?i)(^|/)(tests?|__tests?__|specs?|fixtures?|mocks?|examples?|samples?|testdata|stubs?|cypress|e2e|demos?)/",
    r"(?i)\.(test|spec)\.[a-z0-9]+$",
    r"(?i)_test\.[a-z0-9]+$",
    r"(?i)_spec\.[a-z0-9]+$",
]

# HTTP entry points by path.
PUBLIC_ROUTE_PATTERNS = [
    r"(^|/)(routes?|controllers?|handlers?|endpoints?|resolvers?)/",
    r"(^|/)pages/api/",
    r"(^|/)app/.*/route\.[tj]sx?$",
    r"\.(controller|route|routes|handler|resolver|endpoint)\.[a-z]+$",
]

# Extensions per language.
JS_EXTENSIONS = ["js", "jsx", "ts", "tsx", "mjs", "cjs"]
PY_EXTENSIONS = ["py", "pyi"]
JAVA_EXTENSIONS = ["java", "kt"]
SOURCE_EXTENSIONS = [
    "js", "jsx", "ts", "tsx", "mjs", "cjs", "py", "pyi", "java", "kt", "go",
    "rb", "php", "cs", "rs", "c", "cpp", "h", "hpp", "swift", "scala",
]
CONFIG_EXTENSIONS = ["properties", "yml", "yaml", "conf", "config", "env", "ini", "toml"]


def any_match(col: Column, patterns: list[str]) -> Column:
    """True when any of the literal patterns is found in ``col``."""
    return reduce(lambda a, b: a | b, [col.rlike(p) for p in patterns])


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """Lower-case text after the last dot of the whole path (the path itself without one)."""
    return F.substring_index(F.lower(path), ".", -1)


def has_extension(path: Column) -> Column:
    return basename(path).contains(".")


def depth(path: Column) -> Column:
    return F.size(F.split(path, "/"))


def is_test_like(path: Column) -> Column:
    return any_match(path, TEST_PATH_PATTERNS)


def is_public_route(path: Column) -> Column:
    return any_match(F.lower(path), PUBLIC_ROUTE_PATTERNS)


def language(path: Column) -> Column:
    """js / python / java / php / ruby, or null."""
    ext = extension(path)
    return (
        F.when(ext.isin(JS_EXTENSIONS), "js")
        .when(ext.isin(PY_EXTENSIONS), "python")
        .when(ext.isin(JAVA_EXTENSIONS), "java")
        .when(ext == "php", "php")
        .when(ext == "rb", "ruby")
    )


def in_prefix(path: Column, prefix: str) -> Column:
    """The path itself or anything below it; trailing slashes of ``prefix`` are ignored."""
    p = prefix.rstrip("/")
    return (path == p) | path.startswith(p + "/")
