"""DuckDB SQL for those ``opN`` queries that SQL can state, over the whole tables."""

from __future__ import annotations

from . import decontaminate, linededup, mix, phrases, quality, topk

WORD = r"[^\x20\x09-\x0D]+"
BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

OP1 = rf"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size,
         md5(concat_ws('|', coalesce(doc_id::VARCHAR, ''), coalesce(text, ''))) AS h
  FROM documents),
u AS (
  SELECT doc_id, source, size, ('0x' || substr(h, 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u,
         ('0x' || substr(h, 14, 12))::BIGINT AS t FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM u GROUP BY source),
w AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 2.0 ELSE 3.0 END::DOUBLE AS w,
         3.0::DOUBLE * source_size AS cap FROM s),
run AS (
  SELECT *, ((SELECT sum(source_size::DOUBLE) FROM w) - coalesce(sum(cap) OVER b, 0.0))
         / ((SELECT sum(w) FROM w) - coalesce(sum(w) OVER b, 0.0)) AS level FROM w
  WINDOW b AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
lv AS (SELECT arg_min(level, cap / w) AS level FROM run WHERE level * w <= cap),
t AS (SELECT source, source_size, least(cap, coalesce((SELECT level FROM lv) * w, cap)) AS target FROM w),
p AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 3) ELSE 0 END::BIGINT AS whole FROM t),
r AS (SELECT *, greatest(target - whole * source_size, 0.0) AS rest FROM p),
q AS (
  SELECT u.*, r.source_size, r.target, r.whole, r.rest,
         CASE WHEN r.rest > 0 AND r.rest < r.source_size AND u.size > 0
              THEN u.u / (1 - u.u) / ((r.rest / r.source_size) / (1 - r.rest / r.source_size)) END AS q
  FROM u JOIN r ON u.source IS NOT DISTINCT FROM r.source),
c AS (SELECT *, CASE WHEN q IS NOT NULL THEN sum(size) OVER (PARTITION BY source, q IS NULL ORDER BY q, t) END AS cum FROM q),
g0 AS (SELECT source, any_value(rest) - coalesce(max(cum) FILTER (WHERE cum <= rest), 0) AS gap
      FROM c WHERE q IS NOT NULL GROUP BY source),
{{fits}}
SELECT c.doc_id, c.size, c.source_size, c.target, copies * c.size AS taken, copies
FROM (SELECT c.*, least(whole + CASE WHEN c.q IS NULL THEN 0 WHEN cum <= rest THEN 1
                                     WHEN {{chosen}} THEN 1 ELSE 0 END, 3)::BIGINT AS copies
      FROM c {{joins}}) c
"""


def _op1() -> str:
    """The gap is filled by ``mix.FITS`` documents a source, one CTE each."""
    same = "c.source IS NOT DISTINCT FROM"
    taken = lambda k: f"(f{k}.x.q IS NOT NULL AND c.q = f{k}.x.q AND c.t = f{k}.x.t)"
    joins = lambda n: " ".join(f"LEFT JOIN f{k} ON {same} f{k}.source" for k in range(n))
    out = []
    for k in range(mix.FITS):
        fits = f"abs(g{k}.gap - c.size) < g{k}.gap" if k == mix.FITS - 1 else f"c.size <= g{k}.gap"
        free = " AND ".join(["c.q IS NOT NULL", "c.cum > c.rest", fits] + [f"NOT {taken(j)}" for j in range(k)])
        key = f"{{'a': abs(g{k}.gap - c.size), 'q': c.q, 't': c.t}}"
        out.append(f"f{k} AS (SELECT c.source, arg_min({{'q': c.q, 't': c.t, 'n': c.size}}, {key}) AS x "
                   f"FROM c JOIN g{k} ON {same} g{k}.source {joins(k)} WHERE {free} GROUP BY c.source)")
        out.append(f"g{k + 1} AS (SELECT c.source, c.gap - coalesce(f{k}.x.n, 0) AS gap FROM g{k} c "
                   f"LEFT JOIN f{k} ON {same} f{k}.source)")
    return OP1.format(fits=",\n".join(out), chosen=" OR ".join(taken(k) for k in range(mix.FITS)), joins=joins(mix.FITS))

OP2 = f"""
WITH l AS (
  SELECT doc_id, text, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
n AS (
  SELECT *, trim(line, {BLANKS}) AS s,
         sum((trim(line, {BLANKS}) <> '')::INT) OVER (PARTITION BY doc_id ORDER BY i) - 1 AS p FROM l),
solid AS (SELECT doc_id, p, s FROM n WHERE s <> ''),
win AS (
  SELECT doc_id, p, {" || chr(10) || ".join(f"lead(s, {k}) OVER w" for k in range(linededup.WINDOW))} AS h
  FROM solid WINDOW w AS (PARTITION BY doc_id ORDER BY p)),
later AS (
  SELECT doc_id, p FROM (
    SELECT doc_id, p, row_number() OVER (PARTITION BY h ORDER BY doc_id, p) AS k FROM win WHERE h IS NOT NULL) WHERE k > 1),
cov AS (SELECT DISTINCT doc_id, p + unnest(range(0, {linededup.WINDOW})) AS p FROM later),
marked AS (
  SELECT n.*, s <> '' AND cov.p IS NOT NULL AS gone FROM n LEFT JOIN cov ON n.doc_id = cov.doc_id AND n.p = cov.p AND n.s <> '')
SELECT doc_id, count(*) FILTER (WHERE s <> '') AS n_lines, count(*) FILTER (WHERE gone) AS n_removed,
       md5(CASE WHEN count(*) FILTER (WHERE gone) = 0 THEN any_value(text)
                ELSE coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '') END) AS clean_md5
FROM marked GROUP BY doc_id
"""


def _shingles(table: str, ident: str) -> str:
    n = decontaminate.WORDS
    return rf"""
  SELECT {ident}, n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: list_aggregate(w[i:i + n - 1], 'string_agg', ' '))) AS s
  FROM (SELECT {ident}, w, {n} AS n FROM (
    SELECT {ident}, list_filter(string_split(trim(regexp_replace(lower(text), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' '), lambda x: x <> '') AS w
    FROM {table}))"""


OP4 = f"""
WITH i AS (SELECT DISTINCT item_id, s FROM ({_shingles("benchmark", "item_id")})),
size AS (SELECT item_id, count(*) AS item_shingles FROM i GROUP BY item_id),
d AS (SELECT DISTINCT doc_id, s FROM ({_shingles("documents", "doc_id")}) WHERE s IN (SELECT s FROM i)),
hit AS (SELECT d.doc_id, i.item_id, count(*) AS shared FROM d JOIN i USING (s) GROUP BY d.doc_id, i.item_id)
SELECT doc_id, item_id, shared, item_shingles, shared / item_shingles::DOUBLE AS containment
FROM hit JOIN size USING (item_id) WHERE shared >= {decontaminate.CONTAINMENT} * item_shingles - 1e-9
"""

OP10 = r"""
WITH r(verdict, rh, rp) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
                                   ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
p AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN translate(regexp_extract(url, '://([^/?#]*)', 1),
                  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
         CASE WHEN contains(url, '://') THEN regexp_extract(url, '://[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM pages),
m AS (
  SELECT p.*, r.rh || r.rp AS rule, r.verdict,
         row_number() OVER (PARTITION BY page_id ORDER BY length(r.rh || r.rp) DESC NULLS LAST) AS k
  FROM p LEFT JOIN r ON (p.host = r.rh OR ends_with(p.host, '.' || r.rh)) AND starts_with(p.path, r.rp))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE k = 1
"""


def _op7() -> str:
    """The concentration steps of ``quality.estimate``, one CTE a step."""
    q, dims = quality, range(len(quality.VECTOR))
    x, pairs = [f"x{i}" for i in dims], [(i, j) for i in dims for j in range(i + 1)]
    ctes = [rf"""
w AS (
  SELECT doc_id, lang, source, text, coalesce(regexp_extract_all(text, '{WORD}'), []) AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: trim(l, {BLANKS}) <> '') AS ls FROM documents),
tri AS (
  SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, a, b, c) AS k FROM (
    SELECT doc_id, p, w[p] AS a, w[p + 1] AS b, w[p + 2] AS c FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS p FROM w))),
rep AS (SELECT doc_id, count(DISTINCT p + o) AS n FROM tri, range(0, 3) AS t(o) WHERE k > 1 GROUP BY doc_id),
st AS (
  SELECT w.doc_id, lang, source, len(w)::BIGINT AS n_words,
         coalesce(length(translate(text, {BLANKS}, '')), 0)::BIGINT AS word_chars,
         coalesce(length(text) - length(translate(text, '{q.SYMBOLS}', '')), 0)::BIGINT AS n_symbols,
         len(ls) AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
         coalesce(rep.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN rep ON w.doc_id = rep.doc_id),
b AS (SELECT *, n_words < {q.MIN_WORDS} OR 100 * n_repeat_words > {q.MAX_REPEAT_PCT} * n_words AS base_failed FROM st),
v AS (
  SELECT doc_id, lang, source, ln(1 + n_words::DOUBLE) AS x0, word_chars / n_words::DOUBLE AS x1,
         sqrt(n_symbols / greatest(word_chars, 1)::DOUBLE) AS x2, sqrt(n_dup_lines / greatest(n_lines, 1)::DOUBLE) AS x3,
         sqrt(n_repeat_words / n_words::DOUBLE) AS x4 FROM b WHERE NOT base_failed),
c1 AS (SELECT lang, source, count(*) AS c FROM v GROUP BY ALL),
c2 AS (SELECT lang, sum(c) AS c FROM c1 WHERE c < {q.MIN_ROWS} GROUP BY lang),
g AS (
  SELECT v.*, CASE WHEN c1.c >= {q.MIN_ROWS} THEN 'ls:' || coalesce(v.lang, '?') || ':' || coalesce(v.source, '?')
                   WHEN c2.c >= {q.MIN_ROWS} THEN 'l:' || coalesce(v.lang, '?') ELSE '' END AS g
  FROM v JOIN c1 ON v.lang IS NOT DISTINCT FROM c1.lang AND v.source IS NOT DISTINCT FROM c1.source
  LEFT JOIN c2 ON v.lang IS NOT DISTINCT FROM c2.lang)"""]

    def median(table: str, value: str, name: str) -> str:
        return f"""
  SELECT g, (min(b) + 0.5::DOUBLE) / {q.BINS_PER_UNIT} AS {name} FROM (
    SELECT g, b, sum(c) OVER (PARTITION BY g ORDER BY b) AS up, sum(c) OVER (PARTITION BY g) AS total FROM (
      SELECT g, floor({value} * {q.BINS_PER_UNIT}) AS b, count(*) AS c FROM {table} GROUP BY ALL))
  WHERE up * 2 >= total GROUP BY g"""

    def cholesky(source: str, name: str) -> list[str]:
        out, last = [], source
        for i, j in pairs:
            v = f"s{i}{j}" + (f" + {q.FLOORS[i] ** 2!r}::DOUBLE" if i == j else "")
            v += "".join(f" - l{i}{k} * l{j}{k}" for k in range(j))
            v = f"sqrt(greatest({v}, {q.FLOORS[i] ** 2 * 1e-6!r}))" if i == j else f"({v}) / l{j}{j}"
            out.append(f"{name}_{i}{j} AS (SELECT *, {v} AS l{i}{j} FROM {last})")
            last = f"{name}_{i}{j}"
        return out + [f"{name} AS MATERIALIZED (SELECT * FROM {last})"]

    def distance(est: str, name: str) -> list[str]:
        out, last = [], f"{name}_j"
        ls = ", ".join(f"e.l{i}{j}" for i, j in pairs)
        out.append(f"{name}_j AS (SELECT g.*, {', '.join(f'e.m{i}' for i in dims)}, {ls} FROM g JOIN {est} e USING (g))")
        for i in dims:
            z = f"(x{i} - m{i}" + "".join(f" - l{i}{j} * z{j}" for j in range(i)) + f") / l{i}{i}"
            out.append(f"{name}_{i} AS (SELECT *, {z} AS z{i} FROM {last})")
            last = f"{name}_{i}"
        total = " + ".join(f"z{i} * z{i}" for i in dims)
        out.append(f"{name} AS MATERIALIZED (SELECT doc_id, g, {', '.join(x)}, {total} AS d2 FROM {last})")
        return out

    moments = ", ".join([f"avg(x{i}) AS m{i}" for i in dims] + [f"covar_pop(x{i}, x{j}) AS s{i}{j}" for i, j in pairs])
    for i in dims:
        ctes.append(f"med{i} AS ({median('g', x[i], f'm{i}')})")
    ctes.append("med AS MATERIALIZED (SELECT * FROM " + " ".join(
        ["med0"] + [f"JOIN med{i} USING (g)" for i in dims if i]) + ")")
    for i in dims:
        dev = f"(SELECT g, abs(x{i} - m{i}) AS v FROM g JOIN med USING (g))"
        ctes.append(f"mad{i} AS ({median(dev, 'v', f'v{i}')})")
    start = ", ".join(f"pow(v{i} * 1.4826, 2) AS s{i}{j}" if i == j else f"0.0::DOUBLE AS s{i}{j}" for i, j in pairs)
    ctes.append(f"e0s AS (SELECT med.*, {start} FROM med " + " ".join(f"JOIN mad{i} USING (g)" for i in dims) + ")")
    ctes += cholesky("e0s", "e0")
    for k in range(q.STEPS):
        ctes += distance(f"e{k}", f"d{k}")
        ctes.append(f"""d{k}b AS (SELECT *, floor(log2(d2 + 1e-6) * {q.BINS_PER_OCTAVE}) AS b FROM d{k}),
d{k}e AS (
  SELECT g, min(b) AS edge FROM (
    SELECT g, b, sum(c) OVER (PARTITION BY g ORDER BY b) AS up, sum(c) OVER (PARTITION BY g) AS total
    FROM (SELECT g, b, count(*) AS c FROM d{k}b GROUP BY ALL)) WHERE up >= total * {q.NEAREST} GROUP BY g),
e{k + 1}s AS (SELECT g, {moments} FROM d{k}b JOIN d{k}e USING (g) WHERE b <= edge GROUP BY g)""")
        ctes += cholesky(f"e{k + 1}s", f"e{k + 1}")
    ctes += distance(f"e{q.STEPS}", "dl")
    ctes.append(f"fs AS (SELECT g, {moments} FROM dl WHERE d2 <= {q.REWEIGHT} GROUP BY g)")
    ctes += cholesky("fs", "f1")
    cols = ", ".join(["g"] + [f"m{i}" for i in dims] + [f"l{i}{j}" for i, j in pairs])
    ctes.append(f"f AS MATERIALIZED (SELECT {cols} FROM f1 UNION ALL SELECT {cols} FROM e{q.STEPS} "
                "WHERE g NOT IN (SELECT g FROM f1))")
    ctes += distance("f", "fin")
    return "WITH " + ",\n".join(ctes) + f"""
SELECT b.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND coalesce(fin.d2, 0) <= {q.LIMIT} AS kept
FROM b LEFT JOIN fin ON b.doc_id = fin.doc_id
"""


OP7 = _op7()

# CRC-32 of the decimal id: bytes in turn, eight bit steps a byte.
CRC = ("xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], [ascii(ch)::BIGINT for ch in string_split(c::VARCHAR, '')]), "
       "lambda acc, b: list_reduce(list_concat([xor(acc, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), "
       "lambda x, y: xor(x >> 1, (x & 1) * 3988292384::BIGINT))))")

OP11 = rf"""
WITH t AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
         {{'role': coalesce(role, ''), 'text': coalesce(text, '')}} AS x
  FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT c, list(x ORDER BY i) AS xs FROM t GROUP BY c),
h AS (SELECT c, xs, c - c % 20 AS b, {CRC} % 4 AS h FROM o),
r AS (
  SELECT h.c, list_concat(coalesce(o.xs[1:h.h], []), CASE WHEN len(h.xs) > h.h THEN h.xs[h.h + 1:] ELSE [] END) AS xs
  FROM h LEFT JOIN o ON o.c = h.b),
p AS (SELECT c, d, xs[1:d] AS k, d = len(xs) AS ends FROM (SELECT c, xs, unnest(range(0, len(xs) + 1)) AS d FROM r)),
n AS (
  SELECT k, d, min(c) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE ends), '')) AS ends_sha256
  FROM p GROUP BY k, d),
m AS (
  SELECT *, CASE WHEN d > 0 THEN k[1:d - 1] END AS up,
         (n_convs - 1) * CASE WHEN d > 0 THEN len(regexp_extract_all(k[d].text, '{WORD}')) ELSE 0 END AS tokens FROM n),
f AS (SELECT m.*, (SELECT count(*) FROM m AS q WHERE q.d = m.d + 1 AND q.up = m.k) AS n_children FROM m)
SELECT u.conv_id, u.d::BIGINT AS depth, any_value(w.conv_id) AS parent_conv_id, u.n_convs, u.n_children,
       count(*) FILTER (WHERE v.n_children = 0) AS n_leaves, sum(v.tokens)::BIGINT AS saved_tokens, u.ends_sha256
FROM f AS u JOIN f AS v ON v.d >= u.d AND v.k[1:u.d] = u.k LEFT JOIN f AS w ON w.d = u.d - 1 AND w.k = u.up
GROUP BY u.k, u.conv_id, u.d, u.n_convs, u.n_children, u.ends_sha256
"""

OP12 = rf"""
WITH t AS (
  SELECT coalesce(lang, 'und') AS lang,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (SELECT lang, regexp_extract_all(unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w FROM t),
s AS (SELECT lang, w, unnest(range(1, {phrases.MAX_WORDS + 1})) AS m FROM p),
g AS (SELECT lang, m, w, unnest(range(1, len(w) - m + 2)) AS i FROM s WHERE len(w) >= m),
f AS (SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, sum(f)::HUGEINT AS n FROM f WHERE m = 1 GROUP BY lang),
q AS (SELECT * FROM f WHERE f >= {phrases.MIN_COUNT}),
c AS (SELECT lang, phrase, f AS a, string_split(phrase, ' ') AS w FROM q WHERE m > 1),
k AS (SELECT *, unnest(range(1, len(w))) AS k FROM c),
x AS (
  SELECT k.lang, k.phrase, k.a, k, l.f AS l, r.f AS r, n, (1000::HUGEINT * k.a * n) // (l.f::HUGEINT * r.f) AS score
  FROM k JOIN n ON k.lang = n.lang
  JOIN q AS l ON l.lang = k.lang AND l.phrase = array_to_string(w[1:k.k], ' ')
  JOIN q AS r ON r.lang = k.lang AND r.phrase = array_to_string(w[k.k + 1:], ' ')),
y AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
z AS (
  SELECT y.* FROM y WHERE NOT EXISTS (
    SELECT 1 FROM c WHERE c.lang = y.lang AND c.phrase <> y.phrase AND c.a * 100 >= y.a * {phrases.INSIDE}
    AND contains(' ' || c.phrase || ' ', ' ' || y.phrase || ' ')))
SELECT lang, row_number() OVER w AS rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score FROM z
WINDOW w AS (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)
QUALIFY rank <= {phrases.TOP}
"""

OP13 = f"""
WITH v AS (
  SELECT vec_id AS id, row_number() OVER () AS line, [floor({topk.SCALE}.0::DOUBLE * x::DOUBLE) for x in embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT q.id AS query_id, q.line, c.id AS vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM v AS q JOIN v AS c ON c.line <> q.line WHERE q.id % 100 = 0)
SELECT query_id, (row_number() OVER w)::INT AS rank, vec_id, score FROM s
WINDOW w AS (PARTITION BY query_id, line ORDER BY score DESC, vec_id NULLS LAST)
QUALIFY rank <= {topk.K}
"""

ORACLE: dict[str, str] = {
    "op1_mix": _op1(),
    "op2_line_dedup": OP2,
    "op4_decontaminate": OP4,
    "op7_quality_rules": OP7,
    "op10_url_filter": OP10,
    "op11_prefix_trie": OP11,
    "op12_phrases": OP12,
    "op13_topk": OP13,
}
