"""The operators against brute force, on the smallest tables and on awkward rows."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fleetrisk.llm import op1_suffix, op2_exact, op3_simhash, op4_toxicity, op5_html, op6_quality, op7_substring, op8_packing, op9_decontaminate, op10_token_counts, queries, tokens

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LONG = " ".join(f"w{i % 977} of{i % 31}" for i in range(30_000))
AWKWARD = [(1, "a b c d e f g h i j k l m n o p q r s t u v w x y z " * 3), (2, None), (3, ""), (4, "  \n\t "), (5, LONG), (6, LONG + " end"), (7, "Straße ÄÖ é <|endoftext|> don't 's !'s x!!'s"),
           (8, "a b c d e f g h i j k l m n o p q r s t u v w x y z " * 3), (9, "tie"), (9, "tie"), (None, "no id"), (None, None), (10, "a b c \u0085 d"), (11, "tie")]


@pytest.fixture(scope="module")
def awkward(spark):
    rows = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in AWKWARD], SCHEMA)
    for name in ("chunk", "bucket", "fp", "score", "digest", "worker", "row_", "key_", "id", "h", "kept", "salt_"):
        rows = rows.withColumn(name, F.lit("clash"))
    return rows


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def rows_of(df):
    return [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]


def words(text):
    return re.findall("[^\x20\x09-\x0d]+", text)


def spans(flags):
    return sum(1 for k, f in enumerate(flags) if f and not (k and flags[k - 1]))


def brute_bytes(rows, length=50):
    first, out = {}, []
    rows = [(2**63 - 1 if i is None else i, i, t.encode()) for i, t in rows]
    for key, _, b in rows:
        for k in range(len(b) - length + 1):
            first[b[k : k + length]] = min(key, first.get(b[k : k + length], key))
    for key, i, b in rows:
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if first[b[k : k + length]] < key:
                gone[k : k + length] = b"\1" * length
        out.append((str(i), len(b), sum(gone), spans(gone), bytes(c for c, g in zip(b, gone) if not g)))
    return sorted(out)


@pytest.mark.parametrize("table", ["docs", "awkward"])
def test_suffix_dedup(table, request):
    df = request.getfixturevalue(table)
    if table == "awkward":
        df = df.where("doc_id IS NULL OR doc_id NOT IN (5, 6)")
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in op1_suffix.remove(df).collect())
    assert got == brute_bytes(rows_of(df))


def test_suffix_dedup_of_a_long_text(awkward):
    got = {r.doc_id: r for r in op1_suffix.remove(awkward.where("doc_id IN (5, 6)")).collect()}
    assert got[5].n_removed == 0 and bytes(got[6].kept) == b" end" and got[6].spans[0].past == len(LONG)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text("ab", min_size=1, max_size=50), min_size=2, max_size=30), st.integers(0, 3))
def test_suffix_order(texts, groups):
    group = np.sort(np.arange(len(texts)) % (groups + 1))
    width = 50
    rows = np.zeros((len(texts), width), np.uint8)
    for row, t in zip(rows, texts):
        row[: len(t)] = np.frombuffer(t.encode(), np.uint8)
    order, common = op1_suffix.suffix_order(rows, np.array([len(t) for t in texts]), group)
    assert [(group[i], texts[i]) for i in order] == sorted((g, t) for g, t in zip(group, texts))
    for k in range(1, len(order)):
        a, b = texts[order[k - 1]], texts[order[k]]
        same = next((x for x in range(min(len(a), len(b))) if a[x] != b[x]), min(len(a), len(b)))
        assert common[k] == (same if group[order[k]] == group[order[k - 1]] else -1)


def test_suffix_order_survives_colliding_hashes(monkeypatch):
    monkeypatch.setattr(op1_suffix, "BASE", 0)
    rows = np.frombuffer(b"abcdxbcdaacd", np.uint8).reshape(3, 4).copy()
    order, common = op1_suffix.suffix_order(rows, np.array([4, 4, 4]), np.zeros(3, np.int64))
    assert order.tolist() == [2, 0, 1] and common.tolist() == [-1, 1, 0]


@pytest.mark.parametrize("table", ["docs", "awkward"])
def test_exact_dedup(table, request):
    df = request.getfixturevalue(table)
    rows = rows_of(df)
    by_text = collections.defaultdict(list)
    for i, t in rows:
        by_text[t].append(i)
    got = op2_exact.duplicates(df).collect()
    assert len(got) == len(rows)
    best = lambda t: max((i for i in by_text[t] if i is not None), default=None)
    key = lambda x: tuple(str(v) for v in x)
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=key) == sorted(((i, best(t), len(by_text[t]), hashlib.sha256(t.encode()).hexdigest()) for i, t in rows), key=key)
    kept = [r for r in got if r.kept]
    assert len(kept) == len(by_text) and all(r.doc_id == r.keep_id for r in kept)
    stay = op2_exact.keep(df)
    assert stay.columns == df.columns and sorted(t for _, t in rows_of(stay)) == sorted(by_text)


def test_exact_dedup_nonmembers(spark):
    old = spark.createDataFrame([(1, "x"), (7, "y")], "doc_id bigint, text string")
    new = spark.createDataFrame([(2, "x"), (3, "z"), (4, "z"), (5, "u")], "doc_id bigint, text string")
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.known) for r in op2_exact.dedup(new, old).collect()}
    assert got == {2: (1, 1, False, True), 3: (4, 2, False, False), 4: (4, 2, True, False), 5: (5, 1, True, False)}
    assert op2_exact.dedup(new, old.limit(0)).where("known").count() == 0 and op2_exact.dedup(new.limit(0), old).count() == 0


def test_exact_dedup_members_and_nonmembers_decide(spark):
    """Both halves of the table win some texts, known ones as well as others; nothing but the largest id decides."""
    rows = spark.createDataFrame([(i, f"text {i % 40}") for i in range(200)] + [(None, "text 1"), (None, "only without id"), (None, "only without id"), (199, "text 39")], "doc_id bigint, text string")
    got = op2_exact.duplicates(rows).collect()
    assert len(got) == 204 and {r.known for r in got} == {True, False} or all(r.known for r in got)
    for r in got:
        if r.doc_id is not None:
            assert r.keep_id == 160 + r.doc_id % 40 and r.group_size == 5 + (r.doc_id % 40 in (1, 39))
    kept = [r for r in got if r.kept]
    assert len(kept) == 41 and sorted(str(r.doc_id) for r in kept) == sorted([str(i) for i in range(160, 200)] + ["None"])
    single = spark.createDataFrame([(i, f"own {i}") for i in range(100)], "doc_id bigint, text string")
    assert {r.known for r in op2_exact.duplicates(single).collect()} == {True, False}


@settings(max_examples=30, deadline=None)
@given(st.integers(1, 3000), st.integers(0, 10**6))
def test_perfect_hash(n, seed):
    keys = np.random.default_rng(seed).integers(0, 2**63, (n, 4)).astype(np.uint64)
    assert sorted(op2_exact.slot(keys, op2_exact.perfect_hash(keys), n)) == list(range(n))


def brute_simhash(text):
    w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    parts = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, radius=3):
    root = {i: i for i, _ in fps}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, (i, f) in enumerate(fps):
        for j, g in fps[k + 1 :]:
            if bin(f ^ g).count("1") <= radius:
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
    return {i: top(i) for i, _ in fps}


@pytest.mark.parametrize("table", ["docs", "awkward"])
def test_simhash(table, request):
    df = request.getfixturevalue(table)
    last = 2**63 - 1
    fps = [(last if i is None else i, brute_simhash(t)) for i, t in rows_of(df)]
    roots = brute_components(sorted(set(fps)))
    got = sorted((last if r.doc_id is None else r.doc_id, r.fp % 2**64, last if r.component_id is None else r.component_id) for r in op3_simhash.near_duplicates(df).collect())
    if table == "docs":
        assert got == sorted((i, f, roots[i]) for i, f in fps)
    else:  # rows that share an id may lie in different groups
        assert [g[:2] for g in got] == sorted(fps) and {i: c for i, _, c in got if i != last} == {i: c for i, c in roots.items() if i != last}
    stay = op3_simhash.keep(df)
    assert stay.columns == df.columns


def test_simhash_keeps_one_row_of_each_group(spark, awkward):
    far = ["alpha beta gamma delta", "one two three four five", "red green blue black white"]
    more = [(None, far[0]), (None, far[1]), (None, far[2]), (20, far[0].upper()), (21, "left right up down"), (21, "north south east west"), (None, far[1].title())]
    rows = awkward.select("doc_id", "text", "lang", "source", "n_chars").unionByName(spark.createDataFrame([(i, t, "en", "s", 0) for i, t in more], SCHEMA))
    for df in (rows, rows.withColumn("doc_id", F.lit(None).cast("bigint"))):
        have = {(i, t) for i, t in rows_of(df)}
        roots = brute_components([(f, f) for f in sorted({brute_simhash(t) for _, t in have})])
        best = {}
        signed = lambda f: f - 2**64 if f >= 2**63 else f
        for i, t in have:
            f = brute_simhash(t)
            rank = (i is None, i or 0, signed(f), hashlib.sha256(t.encode()).hexdigest())
            best[roots[f]] = min(best.get(roots[f], (rank, i, t)), (rank, i, t), key=lambda x: x[0])
        assert sorted(map(str, rows_of(op3_simhash.keep(df)))) == sorted(str((i, t)) for _, i, t in best.values())
        least = {}
        for i, t in have:
            root = roots[brute_simhash(t)]
            least[root] = min(least.get(root, 2**63), 2**63 if i is None else i)
        want = sorted((str(i), signed(brute_simhash(t)), least[roots[brute_simhash(t)]]) for i, t in rows_of(df))
        assert sorted((str(r.doc_id), r.fp, 2**63 if r.component_id is None else r.component_id) for r in op3_simhash.near_duplicates(df).collect()) == want


def test_simhash_links_lose_nothing(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 60).astype(np.uint64)
    fps = list(base)
    for f in base:
        for n in (1, 2, 3, 4, 3):
            for b in rng.choice(64, n, replace=False):
                f = f ^ (np.uint64(1) << np.uint64(b))
            fps.append(f)
    fps = sorted({int(f) for f in fps})
    df = spark.createDataFrame([(f - 2**64 if f >= 2**63 else f,) for f in fps], "fp bigint")
    roots = brute_components([(f, f) for f in fps])
    links = [(r.a % 2**64, r.b % 2**64) for r in op3_simhash.links(df).collect()]
    assert all(bin(a ^ b).count("1") <= 3 for a, b in links)
    mine = {f: f for f in fps}

    def top(i):
        while mine[i] != i:
            i = mine[i]
        return i

    for a, b in links:
        x, y = top(a), top(b)
        mine[max(x, y)] = min(x, y)
    assert {f: top(f) for f in fps} == roots


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, i) for i in range(101, 160)] + [(300, 300)]
    got = {r.node: r.root for r in op3_simhash.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert all(got.get(i, i) == 1 for i in range(1, 61)) and all(got.get(i, i) == 100 for i in range(100, 160))


def test_components_hold_their_roots(spark):
    got = {r.node: r.root for r in op3_simhash.components(spark.createDataFrame([(1, 2), (2, 3), (7, 9)], "a bigint, b bigint")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 7: 7, 9: 7}


def test_simhash_names_the_root_by_the_smallest_id(spark):
    signed = lambda f: f - 2**64 if f >= 2**63 else f
    words_ = [f"w{i}" for i in range(400)]
    others = (" ".join([*words_[:k], "other", *words_[k + 1 :]]) for k in range(400))
    near = next(t for t in others if 0 < bin(brute_simhash(" ".join(words_)) ^ brute_simhash(t)).count("1") <= 3)
    pair = sorted([" ".join(words_), near], key=lambda t: signed(brute_simhash(t)))
    for ids in ((5, 3), (3, 5)):  # the least fingerprint, which is the component's root, has the larger id, then the smaller one
        df = spark.createDataFrame(list(zip(ids, pair)), "doc_id bigint, text string")
        assert {r.doc_id: r.component_id for r in op3_simhash.near_duplicates(df).collect()} == {3: 3, 5: 3}


def test_classifiers(spark, awkward, empty):
    labels = spark.createDataFrame([(1, 1, 0), (8, 0, 1), (None, 1, 1), (9, None, None), (5, 1, 0), (6, 0, 1)], "doc_id bigint, quality int, toxic int")
    for out in (op4_toxicity.toxicity(awkward, labels), op6_quality.quality(awkward, labels)):
        got = out.collect()
        assert len(got) == len(AWKWARD) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    assert {r.doc_id: r.held_out for r in op4_toxicity.toxicity(awkward, labels).collect() if r.doc_id is not None} == {i: zlib.crc32(str(i).encode()) % 3 == 1 for i, _ in AWKWARD if i is not None}
    none = labels.limit(0)
    assert all(r.score == 0.5 for r in op4_toxicity.toxicity(awkward, none).collect() + op6_quality.quality(awkward, none).collect())
    assert op4_toxicity.toxicity(empty, labels).count() == op6_quality.quality(empty, labels).count() == 0
    assert op6_quality.keep(awkward, awkward, labels).columns == awkward.columns


def test_quality_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = op6_quality.quality(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in got) >= 0.95 * len(got)


def test_toxicity_learns_words(spark):
    texts = [(i, f"the {'awful' if i % 3 == 0 else 'fine'} thing of day {i} and night {i % 17}") for i in range(600)]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 3 = 0 as int) toxic")
    got = op4_toxicity.toxicity(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert got and all(r.predicted == r.toxic for r in got)


def test_labels_of_held_out_rows_are_not_read(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    turned = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = ({r.doc_id: r.score for r in op4_toxicity.toxicity(docs, x).collect()} for x in (labels, turned))
    assert a == b


def test_gradients_of_the_attention_network():
    rng = np.random.default_rng(0)
    net = op6_quality.Network()
    x, many, y, weight = rng.normal(size=(9, op6_quality.N_FEATURES)), np.array([2, 4, 3]), np.array([1.0, 0.0, 1.0]), np.array([1.0, 2.0, 1.0])

    def loss():
        s = net.forward(x, many)["s"]
        return -(weight * (y * np.log(s) + (1 - y) * np.log(1 - s))).sum() / weight.sum()

    for k, g in net.gradients(net.forward(x, many), y, weight).items():
        at = tuple(rng.integers(0, n) for n in g.shape)
        net.p[k][at] += 1e-6
        up = loss()
        net.p[k][at] -= 2e-6
        assert (up - loss()) / 2e-6 == pytest.approx(g[at], abs=1e-5)
        net.p[k][at] += 1e-6


def page(body):
    return f"<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>var t='</p>';</script></head><body>{body}</body></html>"


def test_html(spark):
    article = "<article><h1>A &amp; B</h1><p><b>First   one.<br><p>Second&nbsp;one.</p><div class='advert'>Buy!</div><p>Third.</article>"
    body = f"<nav><ul><li><a href='/x'>x</a></li></ul></nav><div class='cookie-notice'>We use cookies. Accept.</div>{article}<section class='comments'><article><p>Nice text. Thanks for it.</p></article></section><form>Name</form><footer>&copy; x</footer>"
    rows = [(1, "u", page(body)), (2, None, None), (None, "u", ""), (3, "u", "<p>only"), (4, "u", "<nav>a</nav><p>Cut off in a ta<foo"), (1, "u", page(body)), (5, "u", "<!-- never closed <p>a")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("text", F.lit("clash")).withColumn("n_chars", F.lit("clash"))
    got = op5_html.extract(df).collect()
    want = "A & B\nFirst one.\nSecond one.\nThird."
    assert sorted((str(r.page_id), r.text, r.n_chars) for r in got) == sorted([("1", want, len(want))] * 2 + [("2", "", 0), ("None", "", 0), ("3", "only", 4), ("4", "Cut off in a ta", 15), ("5", "", 0)])
    assert op5_html.extract(df.limit(0)).count() == 0


@pytest.mark.parametrize("html, want", [
    ("<html><head><title>t</title><meta charset=utf-8><body><p>The text stays.</p></body>", "The text stays."),
    ("<head><title>t</title><link rel=x><p>No body tag.</p>", "No body tag."),
    ("<body><p>Before it.</p><datalist id=d><option value=a><option value=b>B</datalist><p>After it.</p></body>", "Before it.\nAfter it."),
    ("<div><p>One.</p><datalist><option>a <b>b</b> c<option>d</datalist><p>Two.</p></div><p>Three.</p>", "One.\nTwo.\nThree."),
    ("<p>One.</p><select><option>a<option>b</select><p>Two.</p>", "One.\nTwo."),
    ("<p>One.</p><datalist><option>a</option><optgroup label=x><option>b</optgroup></datalist><p>Two.</p>", "One.\nTwo."),
    ("<html><head><script>if(i<n /2) x(); // don't</script></head><body><p>It's all here.</p></body>", "It's all here."),
    ("<svg><style>a<b 'c</style></svg><p>It's here.</p>", "It's here."),
    ("<p>So <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds.</p>", "So x=1 holds."),
])
def test_html_loses_no_text_after_open_tags(html, want):
    assert op5_html.main_text(html) == want


FIVE = [f"Paragraph number {i} of the article has some words, and it ends here." for i in range(5)]
PLAIN = "".join(f"<p>{x}</p>" for x in FIVE)
ARTICLE = f"<article>{PLAIN}</article>"
NAV, FOOT = "<nav><ul><li><a href=/a>Home</a></li><li><a href=/b>About us</a></li></ul></nav>", "<footer>&copy; me 2020</footer>"
WRAPPERS = ["layout has-sidebar", "no-ads", "with-comments", "social-science", "popular-science story", "search-results", "login-required", "toolbar-layout", "main-content newsletter-enabled", "sidebar", "overlay", "hasSidebar"]


@pytest.mark.parametrize("body", [f"{NAV}<div class='{c}'>{inner}</div>{FOOT}" for c in WRAPPERS for inner in (ARTICLE, PLAIN)] + [
    f"<form method=post><input type=hidden name=v>{NAV}<div>{PLAIN}</div>{FOOT}</form>", f"<form><input type=hidden name=v><input name=q>{NAV}<div>{ARTICLE}</div>{FOOT}</form>",
    *[f"{NAV}<{t} x=1>{inner}{FOOT}" for t in ("svg", "select", "video", "object", "canvas", "audio") for inner in (ARTICLE, PLAIN)],
    *[f"{NAV}<{t} x=1>{ARTICLE}<{t}>junk</{t}>{FOOT}" for t in ("svg", "select", "video")],
    *[f"{NAV}<{t} x=1><p>Your browser cannot show this element, sorry for that.</p></{t}>{ARTICLE}{FOOT}" for t in ("video", "audio", "object", "canvas")],
])
def test_html_keeps_the_article_whatever_is_around_it(body):
    assert op5_html.main_text(page(body)) == "\n".join(FIVE)


@pytest.mark.parametrize("body", [
    f"{NAV}<div id=main>{PLAIN}</div><div class='comments'>" + "<div class=comment-body><p>I like this very long text, thanks a lot to the author for it. It is good to read it again.</p></div>" * 9 + f"</div>{FOOT}",
    f"{NAV}{ARTICLE}<div class='related-posts'><article><h3><a href=x>Other post</a></h3><p>A teaser of another text.</p></article></div>{FOOT}",
    f"{NAV}{ARTICLE}<form><label>Email</label><input name=e><button>Subscribe</button>Get our weekly mail with all that is new.</form>{FOOT}",
    f"{NAV}<div class=wrap><div class='content'>{PLAIN}</div><div class='sidebar'><p>We are a small team of people who write.</p></div></div>{FOOT}",
    f"{NAV}<div class=adBox><p>Buy this now. It is very good.</p></div>{ARTICLE}<div class='social-share'><a href=x>Share</a> this text.</div>{FOOT}",
])
def test_html_drops_what_is_not_the_article(body):
    assert op5_html.main_text(page(body)) == "\n".join(FIVE)


def test_html_in_time_that_follows_the_length():
    import time

    began = time.time()
    assert op5_html.main_text("<div>" * 20_000 + PLAIN) == "\n".join(FIVE)
    op5_html.main_text("".join(f"<div>text of {i} words here" for i in range(20_000)))
    op5_html.main_text("<video>" * 20_000 + PLAIN)
    text = op5_html.main_text("".join(f"<p>Sentence {i} of a very long page.</p>" for i in range(50_000)))
    assert text.count("\n") == 49_999 and time.time() - began < 20


def test_html_weights_are_learned(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    weights = op5_html.fit(pages)
    assert weights != op5_html.LOOKS and weights[1] > 0 > weights[3]
    # Nothing marked: the stated weights.
    plain = spark.createDataFrame([(1, "u", f"<div>{PLAIN}</div>")], "page_id bigint, url string, html string")
    assert op5_html.fit(plain) == op5_html.LOOKS and op5_html.fit(plain.limit(0)) == op5_html.LOOKS
    # The sample's size changes no label of these pages' blocks.
    one, two = (sorted(map(tuple, op5_html.extract(pages, w).select("page_id", "text").collect())) for w in (weights, op5_html.LOOKS))
    assert one == two


def test_regression_is_the_least_loss():
    rng = np.random.default_rng(3)
    x = np.column_stack((np.ones(400), rng.uniform(0, 1, size=(400, 4))))
    y = (x @ [-1.0, 3.0, 1.0, -4.0, 1.0] + rng.logistic(size=400) > 0).astype(int)
    weight = np.where(y == 1, 0.5 / y.sum(), 0.5 / (400 - y.sum())) * 400
    loss = lambda w: (weight * np.logaddexp(0, -(2 * y - 1) * (x @ w))).sum() + 10 * ((w - np.array(op5_html.LOOKS)) ** 2).sum()
    w = op5_html.newton(x, y)
    assert all(loss(w) <= loss(w + d) for d in np.vstack((np.eye(5)[1:], -np.eye(5)[1:])) * 1e-3)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.floats(-5, 5), min_size=1, max_size=9), st.lists(st.tuples(st.integers(0, 8), st.integers(0, 8), st.floats(0, 3)), max_size=24), st.sampled_from([1.0, 0.2]))
def test_minimum_cut(odds, edges, scale):
    odds = [o * scale for o in odds]
    edges = [(a, b, w) for a, b, w in edges if a != b and max(a, b) < len(odds)]
    cost = lambda side: sum(max(0, -o) if s else max(0, o) for o, s in zip(odds, side)) + sum(w for a, b, w in edges if side[a] != side[b])
    best = min(cost([bool(k >> i & 1) for i in range(len(odds))]) for k in range(1 << len(odds)))
    assert cost(op5_html.minimum_cut(odds, edges)) == pytest.approx(best, abs=1e-6)


@settings(max_examples=100, deadline=None)
@given(st.text("<>/pdivscrt \"'=!-&a;", max_size=80))
def test_html_of_anything(html):
    op5_html.main_text(html)


@pytest.mark.parametrize("table", ["docs", "awkward"])
def test_substring_dedup(table, request):
    df = request.getfixturevalue(table)
    rows = [(i, words(t)) for i, t in rows_of(df)]
    seen = collections.Counter(tuple(w[k : k + 35]) for _, w in rows for k in range(len(w) - 34))
    want = []
    for i, w in rows:
        gone = [False] * len(w)
        for k in range(len(w) - 34):
            if seen[tuple(w[k : k + 35])] > 1:
                gone[k : k + 35] = [True] * 35
        want.append((str(i), len(w), sum(gone), spans(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, len(r.spans), r.kept) for r in op7_substring.remove(df).collect()) == sorted(want)


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


@pytest.mark.parametrize("table", ["docs", "awkward"])
def test_packing(table, request, tokenizer):
    df = request.getfixturevalue(table)
    ids = collections.defaultdict(list)
    for i, t in rows_of(df):
        ids[str(i)].append(np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 1], "<u4"))
    got = op8_packing.pack(df).collect()
    assert sum(r.length for r in got) == sum(len(x) for v in ids.values() for x in v)
    for r in got:
        assert any(len(x) == r.doc_tokens and zlib.crc32(x[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for x in ids[str(r.doc_id)])
    by = collections.defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at and length > 0
            at += length
        assert at <= 2048


@settings(max_examples=100, deadline=None)
@given(st.integers(1, 10_000))
def test_cuts_hold_every_id_once(n):
    got = op8_packing.cuts(n, 2048, 1 / 64, 24)
    assert sum(got) == n and all(0 < x <= 2048 for x in got)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_encoder_is_the_tokenizer(tokenizer, text):
    import pyarrow as pa
    import public_tokenizers

    from fleetrisk.llm.common import flat

    global _ENCODER
    _ENCODER = globals().get("_ENCODER") or tokens.Encoder(open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read())
    raw, at = flat(pa.chunked_array([[text]]))
    want = tokenizer.encode(text, add_special_tokens=False).ids
    assert next(_ENCODER.ids(raw, at)).tolist() == want and _ENCODER.lengths(raw, at).tolist() == [len(want)]


@pytest.mark.parametrize("table", ["docs", "awkward"])
def test_token_counts(spark, table, request, tokenizer):
    df = request.getfixturevalue(table)
    n = np.array([len(tokenizer.encode(t, add_special_tokens=False).ids) for _, t in rows_of(df)])
    whole = op10_token_counts.token_counts(df)
    for r in whole.collect():
        assert (r.n_docs, r.docs_over, r.tokens_over, r.tokens_cut, r.tokens_all) == ((n == r.n_tokens).sum(), (n > r.n_tokens).sum(), n[n > r.n_tokens].sum(), np.minimum(n, r.n_tokens).sum(), n.sum())
        assert (r.docs_to, r.tokens_whole) == ((n <= r.n_tokens).sum(), n[n <= r.n_tokens].sum())
    assert whole.count() == len(set(n.tolist()))
    limits = spark.createDataFrame([(0,), (5,), (2048,), (10**7,)], "context_limit long")
    assert {r.context_limit: r.tokens_cut for r in op10_token_counts.at_limits(whole, limits).collect()} == {k: np.minimum(n, k).sum() for k in (0, 5, 2048, 10**7)}
    assert op10_token_counts.quantiles(whole, [0.5]).collect()[0].n_tokens == np.sort(n)[-(-len(n) // 2) - 1]


def test_decontamination(spark):
    passage = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    filler = " ".join(f"x{i}" for i in range(5000))
    docs = [(1, f"{filler} {passage.upper()} {filler}"), (2, filler), (3, None), (4, passage.replace("seven", "7")), (5, f"a short item {filler}"), (None, passage), (1, passage), (6, " ".join(passage.split()[:12]))]
    items = [(10, passage), (11, "short  item"), (12, ""), (13, None), (None, "x1 x2 x3 x4 x5"), (10, passage)]
    out = op9_decontaminate.find(spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("id", F.lit("clash")), spark.createDataFrame(items, "item_id bigint, text string"))
    assert sorted((str(r.doc_id), r.item_id, r.shared, r.n_shingles) for r in out.collect()) == sorted([("1", 10, 10, 10), ("None", 10, 10, 10), ("6", 10, 8, 10)])
    rows = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("key_", F.lit("clash"))
    clean = op9_decontaminate.clean(rows, spark.createDataFrame(items, "item_id bigint, text string"))
    assert clean.columns == rows.columns and sorted(r.doc_id for r in clean.collect()) == [2, 3, 4, 5]
    # An item of fewer words than a shingle is named, not searched: it would be found in clean documents.
    assert sorted(str(r.item_id) for r in op9_decontaminate.short_items(spark.createDataFrame(items, "item_id bigint, text string")).collect()) == ["11", "12", "13", "None"]


def thue_morse(n, a, b):
    out = [a]
    while len(out) < n:
        out += [b if x == a else a for x in out]
    return "".join(out[:n])


#: Two words that a polynomial hash modulo 2^64 takes for one, whatever its base.
TWINS = thue_morse(2048, "a", "b"), thue_morse(2048, "b", "a")


def test_words_that_collide_are_told_apart(spark):
    one, two = TWINS
    same = " ".join(f"w{i}" for i in range(34))
    rows = spark.createDataFrame([(1, f"{one} {same}"), (2, f"{two} {same}")], "doc_id bigint, text string")
    assert [(r.doc_id, r.n_removed) for r in op7_substring.remove(rows).orderBy("doc_id").collect()] == [(1, 0), (2, 0)]
    tokenizer = tokenizer_of()
    for name, text in ((1, one), (2, two)):
        want = tokenizer.encode(f"{text} {same}", add_special_tokens=False).ids
        pieces = op8_packing.pack(rows).where(F.col("doc_id") == name).select("doc_tokens").first()
        assert pieces.doc_tokens == len(want) + 1
    items = spark.createDataFrame([(1, f"{one} x1 x2 x3 x4")], "item_id bigint, text string")
    found = op9_decontaminate.find(spark.createDataFrame([(1, f"{two} x1 x2 x3 x4 and {one} x1 x2 x3 x4"), (2, f"{two} x1 x2 x3 x4")], "doc_id bigint, text string"), items)
    assert [r.doc_id for r in found.collect()] == [1]


def tokenizer_of():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def test_encoder_compares_bytes(monkeypatch):
    """Ids are the tokenizer's also where every piece has one hash."""
    import pyarrow as pa
    from fleetrisk.llm.common import flat, word_blocks

    monkeypatch.setattr(tokens, "word_blocks", lambda *a: ((i, j, np.full(len(h), 7, np.uint64), f, l, n) for i, j, h, f, l, n in word_blocks(*a)))
    texts = ["alpha beta", "beta", "", "gamma's x-y alpha", "Alpha"]
    tokenizer = tokenizer_of()
    encoder = tokens.Encoder(tokenizer.to_str())
    want = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    raw, at = flat(pa.chunked_array([texts]))
    assert [x.tolist() for x in encoder.ids(raw, at)] == want and encoder.lengths(raw, at).tolist() == [len(x) for x in want]


def test_quality_filter_without_labels_keeps_all(spark, docs, awkward):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert op6_quality.keep(awkward, docs, none).count() == awkward.count()


def test_decontamination_takes_each_row_by_itself(spark):
    passage = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    half, rest = " ".join(passage.split()[:9]), " ".join(passage.split()[5:])
    docs = spark.createDataFrame([(None, passage), (None, "a clean text"), (None, half), (None, rest), (7, half), (7, rest), (8, f"x {passage}"), (8, "clean as well"), (9, None)], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, passage)], "item_id bigint, text string")
    assert sorted((str(r.doc_id), r.item_id, r.shared) for r in op9_decontaminate.find(docs, items).collect()) == [("8", 1, 10), ("None", 1, 10)]
    want = [(None, "a clean text"), (None, half), (None, rest), (7, half), (7, rest), (8, "clean as well"), (9, "")]
    assert sorted(map(str, rows_of(op9_decontaminate.clean(docs, items)))) == sorted(map(str, want))


def test_empty_tables(spark, empty):
    items = spark.createDataFrame([(1, "one two three four five six")], "item_id bigint, text string")
    for out in (op1_suffix.remove(empty), op2_exact.duplicates(empty), op2_exact.keep(empty), op3_simhash.near_duplicates(empty), op3_simhash.keep(empty), op7_substring.remove(empty), op8_packing.pack(empty),
                op9_decontaminate.find(empty, items), op9_decontaminate.find(empty, items.limit(0)), op9_decontaminate.clean(empty, items), op10_token_counts.token_counts(empty)):
        assert out.count() == 0


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_registered_queries_return_the_columns_asked_for(spark, name):
    asked = {1: "doc_id n_bytes n_removed n_spans kept_sha256", 2: "doc_id keep_id group_size kept text_sha256", 3: "doc_id fingerprint component_id", 4: "doc_id held_out score predicted", 5: "page_id url text n_chars",
             6: "doc_id held_out score predicted", 7: "doc_id n_words n_removed kept_sha256", 8: "doc_id start length ids_crc32 doc_tokens sequence_id offset"}
    n = int(re.match(r"op(\d+)_", name)[1])
    out = queries.QUERIES[name](spark, SF)
    assert set(asked.get(n, "").split()) <= set(out.columns) and out.count() > 0
