"""DuckDB SQL of the queries that SQL can express over whole tables.

Token blocks, hash-tree sharding (checksums), the classifier chain, suffix
arrays, the Jaccard join and lattice hashing have none: they are tested
against brute force.
"""

from __future__ import annotations

from .poisson_mix import PART, TERMS
from .secret_scan import RULES, Rule
from .url_ratio import ALPHABET, COUNTS, ORDER
from .url_ratio import RULES as URL_RULES

LETTERS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def urls() -> str:
    rule = action = "NULL"
    for r in sorted(URL_RULES, key=lambda r: (len(r.text), r.text)):
        fits = f"((host = {quoted(r.host)} OR ends_with(host, {quoted('.' + r.host)})) AND starts_with(path, {quoted(r.path)}))"
        rule, action = f"CASE WHEN {fits} THEN {quoted(r.text)} ELSE {rule} END", f"CASE WHEN {fits} THEN {quoted(r.action)} ELSE {action} END"
    levels, columns = [], []
    names = [c for pair in COUNTS.values() for c in pair]
    for k in range(ORDER + 1):
        levels.append(f"""
g{k} AS (SELECT substr(gram, {ORDER + 1 - k}) AS g, {', '.join(f'sum({c}) AS c_{c}' for c in names)} FROM counts GROUP BY 1),
c{k} AS (SELECT g[:{k}] AS c, {', '.join(f'sum(c_{c}) AS n_{c}, count(*) FILTER (WHERE c_{c} > 0) AS t_{c}' for c in names)} FROM g{k} GROUP BY 1)""")
        before = {c: f"p{k - 1}.p_{c}" if k else f"(CAST(1 AS DOUBLE) / {ALPHABET})" for c in names}
        mixes = [f"CASE WHEN c.n_{c} > 0 THEN (g.c_{c} + c.t_{c} * {before[c]}) / (c.n_{c} + c.t_{c}) ELSE {before[c]} END AS p_{c}" for c in names]
        columns.append(f"""
p{k} AS (SELECT x.gram, {', '.join(mixes)}
       FROM counts x JOIN g{k} g ON g.g = substr(x.gram, {ORDER + 1 - k}) JOIN c{k} c ON c.c = g.g[:{k}]
       {f'JOIN p{k - 1} ON p{k - 1}.gram = x.gram' if k else ''})""")

    def weight(action: str, part: str) -> str:
        return f"sum(CASE WHEN action = '{action}'{f' AND half = {part}' if part else ''} THEN n ELSE 0 END)"

    sums = ", ".join(f"{weight(action, part)} AS {c}" for part, pair in COUNTS.items() for action, c in zip(("allow", "block"), pair))
    return f"""
WITH a AS (
  SELECT page_id, url, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), {LETTERS}) AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
parts AS (
  SELECT *, {rule} AS rule, {action} AS action,
         coalesce(CASE WHEN contains(url, '://') THEN regexp_extract(url, '(?s)^(.*?://)[^/?#]*(.*)$', 1) || host
                       || regexp_extract(url, '(?s)^(.*?://)[^/?#]*(.*)$', 2) ELSE url END, '') AS s FROM a),
spelled AS (SELECT s, action, CAST('0x' || substr(md5(s), 1, 1) AS INTEGER) % 2 AS half, count(*) AS n FROM parts GROUP BY ALL),
per AS (SELECT s, action, half, n, substr(repeat(chr(2), {ORDER}) || s, CAST(i AS INTEGER), {ORDER + 1}) AS gram
        FROM (SELECT *, unnest(range(1, length(s) + 1)) AS i FROM spelled)),
counts AS (SELECT gram, {sums}
           FROM per GROUP BY 1),{','.join(levels)},{','.join(columns)},
scores AS (SELECT s, avg(ln(p_acc) - ln(p_rej)) AS score, avg(CASE WHEN half = 0 THEN ln(p_acc1) - ln(p_rej1) ELSE ln(p_acc0) - ln(p_rej0) END) AS unseen
           FROM per JOIN p{ORDER} USING (gram) GROUP BY 1),
scored AS (SELECT x.*, coalesce(score, 0) AS score, coalesce(unseen, 0) AS unseen FROM spelled x LEFT JOIN scores USING (s)),
stat AS (SELECT action, sum(n * unseen) / sum(n) AS m, sqrt(greatest(sum(n * unseen * unseen) / sum(n) - (sum(n * unseen) / sum(n)) ** 2, 0)) AS sd
         FROM scored WHERE action IS NOT NULL GROUP BY 1),
cut AS (SELECT (x.m * y.sd + y.m * x.sd) / (x.sd + y.sd) AS t FROM stat x, stat y WHERE x.action = 'allow' AND y.action = 'block')
SELECT p.page_id, p.host, p.path, p.rule,
       coalesce(p.action, CASE WHEN NOT EXISTS (FROM cut) OR x.score >= (SELECT t FROM cut) THEN 'allow' ELSE 'block' END) AS verdict
FROM parts p JOIN scored x USING (s)
"""


def mixed(weights: dict[str, float]) -> str:
    listed = "".join(f" WHEN '{k}' THEN CAST({v} AS DOUBLE)" for k, v in sorted(weights.items()))
    return f"""
WITH src AS (SELECT coalesce(source, '') AS s, sum(strlen(coalesce(text, ''))) AS size,
                    CASE coalesce(source, ''){listed} ELSE CAST(1 AS DOUBLE) END AS w FROM documents GROUP BY 1),
lam AS (SELECT s, CASE WHEN size > 0 THEN w / (SELECT sum(w) FROM src) * CAST((SELECT sum(size) FROM src) AS DOUBLE) / size ELSE 0 END AS lam FROM src),
part AS (SELECT *, CAST(greatest(ceil(lam / {PART}), 1) AS INTEGER) AS parts FROM lam),
cdf AS (SELECT s, j, sum(exp(-lam / parts) * pow(lam / parts, j) / gamma(j + 1)) OVER (PARTITION BY s ORDER BY j) AS c
        FROM part, range({TERMS + 1}) t(j)),
draw AS (
  SELECT doc_id, s, (CAST('0x' || substr(md5('mix|' || coalesce(CAST(doc_id AS VARCHAR), 'null') || '|' || i), 1, 13) AS BIGINT) + 0.5::DOUBLE)
                    / 4503599627370496::DOUBLE AS u
  FROM (SELECT d.doc_id, p.s, unnest(range(1, p.parts + 1)) AS i FROM documents d JOIN part p ON p.s = coalesce(d.source, ''))),
n AS (SELECT doc_id, CAST(count(*) AS INTEGER) AS n_copies FROM draw JOIN cdf ON cdf.s = draw.s AND cdf.c <= draw.u GROUP BY 1)
SELECT d.*, n.n_copies, CAST(unnest(range(1, n.n_copies + 1)) AS INTEGER) AS copy FROM documents d JOIN n USING (doc_id)
"""


CONTAMINATED = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {LETTERS}), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), {LETTERS}), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
      FROM benchmark),
iw AS (SELECT item, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM iw),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
hits AS (SELECT doc_id, i, n, item FROM dw JOIN win USING (n, win)),
marks AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY 1),
named AS (SELECT doc_id, list_sort(list(DISTINCT item)) AS items FROM hits GROUP BY 1)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(len(items), 0) AS n_items,
       sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN marks USING (doc_id) LEFT JOIN named USING (doc_id)
"""


def secrets() -> str:
    def found(k: int, r: Rule) -> str:
        rx = quoted(r.regex)
        return f"""
SELECT doc_id, {k} AS k, '{r.kind}' AS kind, i, g, m, p FROM (
  SELECT doc_id, unnest(range(len(regexp_extract_all(t, {rx}, 0)))) AS i, unnest(regexp_extract_all(t, {rx}, 0)) AS m,
         unnest(regexp_extract_all(t, {rx}, {r.group})) AS p, unnest(string_split_regex(t, {rx})[:len(regexp_extract_all(t, {rx}, 0))]) AS g
  FROM d WHERE regexp_matches(t, {rx}))"""

    least = "".join(f" WHEN '{r.kind}' THEN {r.min_length}" for r in RULES)
    base = ", ".join(f"'{r.kind}'" for r in RULES if r.base)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
f AS ({' UNION ALL '.join(found(k, r) for k, r in enumerate(RULES))}),
place AS (SELECT *, sum(length(g) + length(m)) OVER (PARTITION BY doc_id, k ORDER BY i) AS e FROM f),
s AS (SELECT doc_id, k, kind, CAST(e - length(m) AS BIGINT) AS b, kind || ':' || CAST(e - length(m) AS BIGINT) || ':' || CAST(e AS BIGINT) AS span
      FROM place WHERE length(p) >= CASE kind{least} END),
x AS (SELECT doc_id, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access,
             count(*) FILTER (WHERE kind = 'hex') AS n_hex, string_agg(span, ',' ORDER BY b, k) FILTER (WHERE kind IN ({base})) AS base,
             string_agg(span, ',' ORDER BY b, k) AS spans FROM s GROUP BY 1)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN x USING (doc_id)
"""


#: Fill-in-middle outputs: draws by sha256, cuts by code points, and the order of the parts.
FILLED = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS h FROM documents),
e AS (
  SELECT doc_id, t, length(t) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
         CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM d),
f AS (
  SELECT doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
              WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM e),
g AS (SELECT *, substr(t, 1, a) AS p, substr(t, a + 1, b - a) AS m, substr(t, b + 1) AS s FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM g
"""

#: Hard negatives: exact inner products of every anchor with every row, ranked by windows.
NEGATIVES = """
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id AS id, a.label = c.label AS same, CAST(list_dot_product(a.v, c.v) AS BIGINT) AS score
  FROM r a JOIN r c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
n AS (
  SELECT anchor_id, positive_id, id AS negative_id, positive_score, score AS negative_score,
         row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS rank
  FROM s JOIN p USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""
