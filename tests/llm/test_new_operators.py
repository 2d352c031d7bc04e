"""The URL filter, the resampling and the lexical search against brute force, on the smallest tables and on awkward rows."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fleetrisk.llm import op11_urls, op12_resample, op13_search, queries

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"w{i % 977} of{i % 31}" for i in range(30_000))
LINES = "\n".join(f"line {i % 50} é{i % 7}" for i in range(5_000))
TEXTS = [(1, "The cat\nsat on the mat, THE cat"), (2, None), (3, ""), (4, " \n\t \n"), (5, LONG), (6, LINES), (7, "Straße ÄÖ é the ٣٤ cat\u0085mat"), (8, "tie word " * 12),
         (9, "tie word " * 12), (9, "tie word " * 12), (None, "tie word " * 12), (None, "tie word " * 12), (None, None), (10, "the cat " * 15 + "\n" + "the cat " * 15), (0, "tie word " * 12)]
ITEMS = [(1, "the cat sat"), (2, "tie word nowhere"), (3, None), (4, ""), (5, "w1 w2 of3 é1 LINE line"), (2, "mat"), (None, "straße cat"), (6, "nowhere at all"), (7, "TIE")]
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def clashing(rows, *names):
    for name in names:
        rows = rows.withColumn(name, F.lit("clash"))
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return clashing(spark.createDataFrame(TEXTS, "doc_id bigint, text string").repartition(4), "line", "key", "split", "score", "rank", "n", "term", "item_id", "place", "first", "crossed")


@pytest.fixture(scope="module")
def items(spark):
    return clashing(spark.createDataFrame(ITEMS, "item_id bigint, text string"), "doc_id", "item", "term", "rank", "line", "crossed")


# ---- lexical search

def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def ranking(documents, wanted, k=10, a=100, b=90):
    found = [(d, collections.Counter(terms(t))) for d, t in documents if terms(t)]
    n, total = len(found), sum(sum(c.values()) for _, c in found)
    df = collections.Counter(t for _, c in found for t in c)
    of = collections.defaultdict(set)
    for i, t in wanted:
        of[i] |= set(terms(t))
    out = []
    for i, ts in of.items():
        scores = []
        for d, c in found:
            m = a - b + (b * sum(c.values()) * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in ts if c[t])
            if s > 0:
                scores.append((s, d))
        scores.sort(key=lambda x: (-x[0], x[1] is None, x[1] or 0))
        out += [(i, r, d, s) for r, (s, d) in enumerate(scores[:k], 1)]
    return sorted(out, key=str)


def collected(df):
    return sorted([tuple(r) for r in df.collect()], key=str)


def test_search_awkward(docs, items):
    want = ranking(TEXTS, ITEMS)
    assert collected(op13_search.search(docs, items)) == want
    assert any(d is None for _, _, d, _ in want) and sum(i == 2 for i, *_ in want) > 5
    # Many blocks of items, and another number of results.
    assert collected(op13_search.search(docs, items, k=2, block=60)) == ranking(TEXTS, ITEMS, k=2)


def test_search_empty(spark, docs, items):
    assert op13_search.search(docs.limit(0), items).count() == 0
    assert op13_search.search(docs, items.limit(0)).count() == 0
    assert op13_search.search(docs.where("doc_id IN (2, 3, 4)"), items).count() == 0


def test_search_whole_tables(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    wanted = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert collected(queries.op13_ranked_search(spark, SF)) == ranking(rows, wanted)


def test_pieces_of_long_texts(monkeypatch):
    monkeypatch.setattr(op13_search, "PIECE", 7)
    text = "Ab cd, efghijklmnopqrst é uv!! wxyz "
    assert [t.decode() for p in op13_search.terms(text.encode()) for t in p] == terms(text)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 5), min_size=1, max_size=8), min_size=1, max_size=40), st.sets(st.integers(0, 5), min_size=1), st.integers(1, 4), st.lists(st.integers(1, 4000), max_size=4))
def test_bounds_close_on_exact_scores(held, wanted, k, floor):
    """All of the best k come back with exact scores, however short the reads."""
    counts = [collections.Counter(x) for x in held]
    n, total = len(held), sum(map(len, held))
    weights = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * sum(t in c for c in counts) + 1))) for t in range(6)], np.int64)
    rows = pa.table({"doc_id": pa.array(range(n), pa.int64()), "n": pa.array([len(x) for x in held], pa.int64()),
                     "term": pa.array([list(c) for c in counts], pa.list_(pa.int32())), "tf": pa.array([list(c.values()) for c in counts], pa.list_(pa.int64()))})
    want = np.array(sorted(t for t in wanted if weights[t] > 0), np.int64)
    floor = np.array(floor, np.int64) * 100_000
    old, op13_search.FIRST_READ = op13_search.FIRST_READ, 1
    try:
        left, score = op13_search.Shard(rows, (n, total), weights, 100, 90).best(want, k, floor)
    finally:
        op13_search.FIRST_READ = old
    exact = [sum(int(weights[t]) * ((10**9 * c[t]) // (1000 * c[t] + 8 * (10 + (90 * sum(c.values()) * n) // total))) for t in want if c[t]) for c in counts]
    assert all(exact[d] == s for d, s in zip(left.tolist(), score.tolist()))
    pooled = sorted([(-s, 0) for s in floor.tolist()] + [(-s, 1, d) for d, s in enumerate(exact) if s > 0])[:k]
    assert {x[2] for x in pooled if x[1]} <= set(left.tolist())


# ---- resampling

def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def resampled(documents, target, percent, least, buckets, longest):
    def places(text):
        w = words(text)
        return [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, longest + 1) for i in range(len(w) - k + 1)]

    s, t = collections.Counter(), collections.Counter()
    for _, x in documents:
        s.update(places(x))
    for _, x in target:
        t.update(places(x))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in range(buckets)]
    rows = []
    for d, x in documents:
        h = int(hashlib.sha256(f"2024:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        p = places(x)
        weight = sum(gain[b] for b in p)
        rows.append([d, len(p), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words(x)) >= least])
    able = sorted((r for r in rows if r[5]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for i, r in enumerate(able[: len(able) * percent // 100], 1):
        r[4] = i
    return sorted([tuple(r[:5]) for r in rows], key=str)


@pytest.mark.parametrize("longest,buckets,percent", [(1, 10_000, 10), (2, 97, 50), (3, 1000, 100)])
def test_resampling_awkward(docs, items, longest, buckets, percent):
    got = collected(op12_resample.resample(docs, items, percent=percent, buckets=buckets, longest=longest))
    want = resampled(TEXTS, ITEMS, percent, 20, buckets, longest)
    # Equal rows share ranks in any order.
    assert got == want


def test_resampling_empty(spark, docs, items):
    assert op12_resample.resample(docs.limit(0), items).count() == 0
    rows = collected(op12_resample.resample(docs, items.limit(0)))
    assert rows == resampled(TEXTS, [], 10, 20, 10_000, 1)


def test_resampling_whole_tables(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    wanted = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert collected(queries.op12_importance_resampling(spark, SF)) == resampled(rows, wanted, 10, 20, 10_000, 1)


def test_common_line_is_counted_once(spark):
    """A line that all documents share is one row of the segments, with its occurrences."""
    rows = spark.createDataFrame([(i, f"common notice here\nown{i}") for i in range(500)], "doc_id bigint, text string").withColumn("crossed", F.array().cast("array<int>"))
    parts = {r.times: r.n_words for r in op12_resample.segments(rows, 100, 1).where("n_words = 3").collect()}
    assert parts == {500: 3}


# ---- URL filter

URLS = [(1, "http://Example.COM/en/1"), (2, None), (3, ""), (4, "no scheme"), (5, "https://www.example.com/en/x?y#z"), (6, "https://a.net/es/1"), (6, "https://a.net/es/1"), (7, "http://net/fr/"), (8, "http://x.org/en/" + "a/b" * 20_000),
        (9, "ftp://com"), (10, "://com/x"), (11, "http://notcom/x"), (12, "http://a.com?x=/en/"), (13, "http://example.com/EN/"), (14, "http://b.org/ü\U0001F600/\n2"), (None, "http://c.com/de/1"), (15, "a://b.com/x://example.com/en/"),
        (16, "http://www.example.com/en/2"), (17, "http://blog.www.example.com/en/2"), (18, "http://c.net/es/2"), (19, "http://d.com/fr/1"), (20, "http://e.com/it/1"), (21, "http://f.net/fr/3")]


def judged(rows, rules, order=4):
    urls = collections.Counter(u or "" for _, u in rows)

    def split(u):
        rest = u.split("://", 1)[1] if "://" in u else ""
        host = re.match(r"[^/?#]*", rest).group()
        return host.translate(LOWER), re.match(r"[^?#]*", rest[len(host) :]).group()

    def fit(u):
        h, p = split(u)
        return max([(len(rh + rp), rh + rp, v) for v, rh, rp in rules if (h == rh or h.endswith("." + rh)) and p.startswith(rp)], default=(0, None, None))[1:]

    runs = lambda u: [("\2" * order + u + "\3")[i : i + order + 1] for i in range(len(u) + 1)]
    counts = {v: [collections.Counter() for _ in range(order + 1)] for v in ("allow", "block")}
    learned = {u: zlib.crc32(u.encode()) % 5 != 0 for u in urls}
    for u, n in urls.items():
        v = fit(u)[1]
        if v and learned[u]:
            for g in runs(u):
                for k in range(order + 1):
                    counts[v][k][g[order - k :]] += n
    contexts = {v: [collections.defaultdict(list) for _ in range(order + 1)] for v in counts}
    for v in counts:
        for k, c in enumerate(counts[v]):
            for g, n in c.items():
                contexts[v][k][g[:-1]].append(n)

    def chance(v, g):
        p = 1 / 65536
        for k in range(order + 1):
            s = g[order - k :]
            after = contexts[v][k].get(s[:-1], [])
            if after:
                p = (counts[v][k][s] + len(after) * p) / (sum(after) + len(after))
        return p

    score = {u: math.floor(sum(round((math.log(chance("allow", g)) - math.log(chance("block", g))) * 1e6) for g in runs(u)) / (len(u) + 1)) for u in urls}
    step = {u: max(-500, min(500, s // 10_000)) for u, s in score.items()}
    held = [(step[u], fit(u)[1], n) for u, n in urls.items() if fit(u)[1] and not learned[u]]
    yes, no = (sum(n for _, v, n in held if v == w) for w in ("allow", "block"))
    cutoff = min(range(-500, 502), key=lambda t: (sum(n for s, v, n in held if v == "allow" and s < t) * no + sum(n for s, v, n in held if v == "block" and s >= t) * yes, abs(t), t)) if yes and no else 0
    out = []
    for i, u in rows:
        rule, verdict = fit(u or "")
        out.append((i, *split(u or ""), rule, verdict or ("allow" if step[u or ""] >= cutoff else "block")))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def pages(spark):
    return clashing(spark.createDataFrame(URLS, "page_id bigint, url string").repartition(3), "host", "path", "rule", "verdict", "score", "run", "n", "model", "html")


def test_rules(spark):
    rows = {u: (h, p, r) for _, u, h, p, r, *_ in ((x.page_id, x.url, x.host, x.path, x.rule) for x in op11_urls.judge(spark.createDataFrame(URLS, "page_id bigint, url string")).collect())}
    assert rows["http://Example.COM/en/1"] == ("example.com", "/en/1", "example.com/en/")
    assert rows["https://www.example.com/en/x?y#z"] == ("www.example.com", "/en/x", "www.example.com/en/")
    assert rows["http://net/fr/"] == ("net", "/fr/", "net/fr/")
    assert rows["ftp://com"] == ("com", "", None) and rows["http://notcom/x"][2] is None and rows["http://a.com?x=/en/"] == ("a.com", "", None)
    assert rows["no scheme"] == ("", "", None) and rows["http://example.com/EN/"][2] == "com/"


def test_urls_awkward(pages):
    columns = ["page_id", "host", "path", "rule", "verdict"]
    assert collected(op11_urls.judge(pages).select(columns)) == judged(URLS, op11_urls.RULES)
    few = [("allow", "com", "/")]
    assert collected(op11_urls.judge(pages, few, order=2).select(columns)) == judged(URLS, few, 2)
    assert op11_urls.judge(pages.limit(0)).count() == 0


def test_urls_whole_tables(spark):
    rows = [(r.page_id, r.url) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    assert collected(queries.op11_url_filter(spark, SF)) == judged(rows, op11_urls.RULES)


def test_urls_without_python(pages):
    plan = op11_urls.judge(pages)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
