"""DuckDB SQL for the URL filter, the resampling and the lexical search, over whole tables."""

from __future__ import annotations

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: crc32 of a text's UTF-8 bytes, by the table of the reversed polynomial.
_CRC = """crc AS MATERIALIZED (
        SELECT list(list_reduce(range(8), lambda c, b: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i) ORDER BY i) AS t FROM range(256) r(i))"""


def crc32(text: str) -> str:
    """Of a text column, in a query that has crc in its FROM."""
    codes = f"list_transform(range(0, octet_length(encode({text}))), lambda k: ('0x' || substr(hex(encode({text})), 2 * k + 1, 2))::BIGINT)"
    return f"xor(list_reduce({codes}, lambda c, b: xor(c // 256, crc.t[xor(c % 256, b) + 1]), 4294967295::BIGINT), 4294967295)"


def resample(percent: int = 10, least: int = 20, seed: str = "2024", buckets: int = 10_000) -> str:
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    tokens = f"regexp_extract_all({_LOWER.format('coalesce(text, chr(32))')}, '{word}')"
    return f"""
        WITH {_CRC},
        d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {tokens} AS w FROM documents),
        dw AS MATERIALIZED (SELECT r, word, count(*) AS n FROM (SELECT r, unnest(w) AS word FROM d) GROUP BY r, word),
        bw AS MATERIALIZED (SELECT word, count(*) AS n FROM (SELECT unnest({tokens}) AS word FROM benchmark) GROUP BY word),
        place AS MATERIALIZED (SELECT word, {crc32('word')} % {buckets} AS b FROM (SELECT word FROM dw UNION SELECT word FROM bw), crc),
        s AS (SELECT b, sum(n) AS s FROM dw JOIN place USING (word) GROUP BY b),
        t AS (SELECT b, sum(n) AS t FROM bw JOIN place USING (word) GROUP BY b),
        all_ AS (SELECT (SELECT coalesce(sum(n), 0) FROM dw)::DOUBLE AS s_all, (SELECT coalesce(sum(n), 0) FROM bw)::DOUBLE AS t_all),
        gain AS MATERIALIZED (SELECT b, floor(1000 * ln((coalesce(t, 0) + 1.0::DOUBLE) * (s_all + {buckets}) / ((s + 1.0::DOUBLE) * (t_all + {buckets}))))::BIGINT AS g FROM s LEFT JOIN t USING (b), all_),
        weight AS (SELECT r, sum(n * g)::BIGINT AS weight FROM dw JOIN place USING (word) JOIN gain USING (b) GROUP BY r),
        scored AS (
            SELECT r, doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
                   coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{seed}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS score
            FROM d LEFT JOIN weight USING (r)),
        ranked AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, weight DESC) AS k, count(*) OVER () AS n FROM scored WHERE n_features >= {least})
        SELECT doc_id, n_features, weight, score, CASE WHEN k <= n * {percent} // 100 THEN k END AS rank FROM scored LEFT JOIN ranked USING (r)"""


def search(k: int = 10, a: int = 100, b: int = 90) -> str:
    term = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    tokens = f"regexp_extract_all({_LOWER.format('coalesce(text, chr(32))')}, '{term}')"
    return f"""
        WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {tokens} AS w FROM documents),
        size AS (SELECT count(*) FILTER (len(w) > 0) AS n_docs, sum(len(w))::BIGINT AS n_terms FROM d),
        asked AS MATERIALIZED (SELECT DISTINCT item_id, unnest({tokens}) AS term FROM benchmark),
        tf AS MATERIALIZED (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM asked) GROUP BY r, term),
        weight AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), size),
        m AS (SELECT r, doc_id, {a} - {b} + ({b} * len(w)::BIGINT * n_docs) // n_terms AS m FROM d, size WHERE len(w) > 0),
        scored AS (
            SELECT item_id, r, any_value(doc_id) AS doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
            FROM asked JOIN weight USING (term) JOIN tf USING (term) JOIN m USING (r) GROUP BY item_id, r)
        SELECT item_id, rank, doc_id, score FROM (
            SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank, doc_id, score FROM scored WHERE score > 0)
        WHERE rank <= {k}"""


def urls(order: int = 4, folds: int = 5, alphabet: int = 65536, step: int = 10_000, steps: int = 500) -> str:
    host = _LOWER.format("regexp_extract(rest, '^[^/?#]*')")
    rules = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
    rows = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in rules)
    chance = lambda c, shorter: f"CASE WHEN {c}_all + {c}_kinds > 0 THEN ({c} + {c}_kinds * {shorter}) / ({c}_all + {c}_kinds)::DOUBLE ELSE {shorter} END AS p_{c}"
    known = [f"known1 AS (SELECT part, {chance('yes', f'(1.0::DOUBLE / {alphabet})')}, {chance('no', f'(1.0::DOUBLE / {alphabet})')} FROM wide WHERE k = 1)"]
    for k in range(2, order + 2):
        known.append(f"known{k} AS MATERIALIZED (SELECT w.part, {chance('yes', 's.p_yes')}, {chance('no', 's.p_no')} FROM wide w JOIN known{k - 1} s ON s.part = right(w.part, {k - 1}) WHERE k = {k})")
    return f"""
        WITH {_CRC},
        urls AS (SELECT url, count(*) AS n, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM (SELECT coalesce(url, '') AS url FROM pages) GROUP BY url),
        parts AS (SELECT url, n, {host} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM urls),
        rules(v, h, p) AS (VALUES {rows}),
        ruled AS MATERIALIZED (
            SELECT url, any_value(n) AS n, any_value(host) AS host, any_value(path) AS path, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS verdict,
                   any_value(coalesce({crc32('url')}, 0) % {folds} <> 0) AS learned
            FROM parts CROSS JOIN crc LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY url),
        runs AS MATERIALIZED (
            SELECT url, n, verdict, learned, unnest(list_transform(range(1, length(x) - {order} + 1), lambda i: substr(x, i, {order + 1}))) AS run
            FROM (SELECT *, repeat(chr(2), {order}) || url || chr(3) AS x FROM ruled)),
        counted AS MATERIALIZED (
            SELECT run, sum(CASE WHEN learned AND verdict = 'allow' THEN n ELSE 0 END)::BIGINT AS yes, sum(CASE WHEN learned AND verdict = 'block' THEN n ELSE 0 END)::BIGINT AS no FROM runs GROUP BY run),
        sums AS (SELECT k, right(run, k) AS part, sum(yes)::BIGINT AS yes, sum(no)::BIGINT AS no FROM counted, range(1, {order + 2}) r(k) GROUP BY ALL),
        wide AS MATERIALIZED (
            SELECT *, sum(yes) OVER c::BIGINT AS yes_all, sum(no) OVER c::BIGINT AS no_all, count(*) FILTER (yes > 0) OVER c AS yes_kinds, count(*) FILTER (no > 0) OVER c AS no_kinds
            FROM sums WINDOW c AS (PARTITION BY k, left(part, k - 1))),
        {', '.join(known)},
        model AS (SELECT part AS run, round((ln(p_yes) - ln(p_no)) * 1000000)::BIGINT AS diff FROM known{order + 1}),
        scored AS MATERIALIZED (SELECT url, floor(sum(diff)::DOUBLE / count(*))::BIGINT AS score FROM runs JOIN model USING (run) GROUP BY url),
        stepped AS MATERIALIZED (SELECT *, greatest(-{steps}, least({steps}, floor(score / {step}.0)::BIGINT)) AS step FROM ruled JOIN scored USING (url)),
        held AS (SELECT step, CASE WHEN verdict = 'allow' THEN n ELSE 0 END AS yes, CASE WHEN verdict = 'block' THEN n ELSE 0 END AS no FROM stepped WHERE NOT learned AND verdict IS NOT NULL),
        rated AS (
            SELECT t.t AS step, sum(CASE WHEN held.step < t THEN yes ELSE 0 END)::HUGEINT AS lost, sum(CASE WHEN held.step >= t THEN no ELSE 0 END)::HUGEINT AS kept, sum(yes)::HUGEINT AS yes, sum(no)::HUGEINT AS no
            FROM range(-{steps}, {steps + 2}) t(t) CROSS JOIN held GROUP BY t.t HAVING sum(yes) > 0 AND sum(no) > 0),
        best AS (SELECT coalesce((SELECT step FROM rated ORDER BY lost * no + kept * yes, abs(step), step LIMIT 1), 0) AS step)
        SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN s.step >= best.step THEN 'allow' ELSE 'block' END) AS verdict
        FROM pages JOIN stepped s ON coalesce(pages.url, '') = s.url, best"""
