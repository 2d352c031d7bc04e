"""Path globs as regular expressions, computed once per (small) suppression row, and as keys for an equi-join with paths."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def has_glob(glob: Column) -> Column:
    return glob.rlike(r"[*?\[{]")


def glob_regex(glob: Column) -> Column:
    """``*`` stays in a segment, ``**`` spans segments, ``?``, ``[..]`` and ``{a,b}``; dots match too."""
    g = F.regexp_replace(glob, r"([.+^$()|\\])", r"\\$1")
    g = F.regexp_replace(g, r"\[(?:!|\\\^)", "[^")
    g = F.regexp_replace(g, r",(?=[^{}]*\})", "|")
    g = F.regexp_replace(g, r"\{([^{}]*\|[^{}]*)\}", "(?:$1)")
    g = F.regexp_replace(g, r"(?<=^|/)\*\*/", "\u0001")
    g = F.regexp_replace(g, r"(?<=^|/)\*\*$", "\u0002")
    g = F.regexp_replace(g, r"(?<=^|/|\x01)\*+(?=/|$)", "\u0003")
    g = F.regexp_replace(g, r"\*+", "[^/]*")
    g = F.regexp_replace(g, r"(?<!\()\?(?!:)", "[^/]")
    g = F.replace(g, F.lit("\u0001"), F.lit("(?:.*/)?"))
    g = F.replace(g, F.lit("\u0002"), F.lit(".+"))
    g = F.replace(g, F.lit("\u0003"), F.lit("[^/]+"))
    return F.concat(F.lit("\\A"), g, F.lit("\\z"))


#: Lengths that literal heads and tails are cut to.
_LENGTHS = [32, 16, 8, 4, 2, 1]
KINDS = ["directory", "file", "segment", *[f"tail{n}" for n in _LENGTHS], *[f"head{n}" for n in _LENGTHS], "any"]


def glob_key(glob: Column) -> Column:
    """struct(kind, text): the most telling literal that every path of a glob has.

    Its leading directories, else its file name, else a whole directory somewhere, else the end or the beginning as far as literal; only a glob
    without any (``*``, ``**``, ``[ab]?``) has the kind "any".
    """
    head = F.regexp_extract(glob, r"^([^*?\[{]*)", 1)
    lead = F.regexp_extract(head, r"^(.*)/", 1)
    tail = F.regexp_extract(glob, r"([^*?\[\]{}]*)$", 1)
    base = F.substring_index(tail, "/", -1)
    # A brace that holds a slash may make a directory optional.
    segment = F.when(glob.rlike(r"\{[^{}]*/"), "").otherwise(F.regexp_extract(glob, r"(?:^|/)([^*?\[\]{}/]+)/", 1))
    key = lambda kind, text: F.struct(F.lit(kind).alias("kind"), text.alias("text"))
    cases = [(lead != "", key("directory", lead)), (tail.contains("/"), key("file", base)), (segment != "", key("segment", segment))]
    cases += [(F.length(tail) >= n, key(f"tail{n}", F.right(tail, F.lit(n)))) for n in _LENGTHS]
    cases += [(F.length(head) >= n, key(f"head{n}", F.left(head, F.lit(n)))) for n in _LENGTHS]
    out = F.when(*cases[0])
    for case in cases[1:]:
        out = out.when(*case)
    return out.otherwise(key("any", F.lit("")))


def path_keys(path: Column, kinds: Column) -> Column:
    """array<struct(kind, text)>: the keys of those kinds that a glob matching the path may have."""
    parts = F.split(path, "/")
    base = F.element_at(parts, -1)
    dirs = F.slice(parts, 1, F.size(parts) - 1)
    # The directories from the first on, each one segment longer: "a", "a/b", "a/b/c".
    leads = F.transform(dirs, lambda x, i: F.array_join(F.slice(parts, 1, i + 1), "/"))
    of = lambda kind, texts: F.transform(texts, lambda t: F.struct(F.lit(kind).alias("kind"), t.alias("text")))
    none = F.array().cast("array<struct<kind:string,text:string>>")
    have = lambda kind, texts: F.when(F.array_contains(kinds, kind), of(kind, texts)).otherwise(none)
    lists = [have("directory", leads), have("file", F.array(base)), have("segment", F.array_distinct(dirs)), have("any", F.array(F.lit("")))]
    lists += [F.when(F.array_contains(kinds, f"tail{n}") & (F.length(base) >= n), of(f"tail{n}", F.array(F.right(base, F.lit(n))))).otherwise(none) for n in _LENGTHS]
    lists += [F.when(F.array_contains(kinds, f"head{n}") & (F.length(path) >= n), of(f"head{n}", F.array(F.left(path, F.lit(n))))).otherwise(none) for n in _LENGTHS]
    return F.concat(*lists)
