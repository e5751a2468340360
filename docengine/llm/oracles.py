"""DuckDB SQL for the queries that SQL can express."""

WORD = r"[^\x20\x09-\x0D]+"

OP2 = rf"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS BIGINT) AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight, 3 * CAST(source_size AS HUGEINT) AS cap,
         sum(source_size) OVER () AS total FROM s
), f AS (
  SELECT *, cap * sum(weight) OVER (ORDER BY source_size * (6 // weight), source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
            <= weight * (total - coalesce(sum(cap) OVER (ORDER BY source_size * (6 // weight), source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS at_cap
  FROM w
), t AS (
  SELECT source, source_size,
         CASE WHEN at_cap THEN CAST(cap AS DOUBLE)
              ELSE CAST(total - coalesce(sum(cap) FILTER (at_cap) OVER (), 0) AS DOUBLE) * CAST(weight AS DOUBLE) / CAST(sum(weight) FILTER (NOT at_cap) OVER () AS DOUBLE) END AS target
  FROM f
), r AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / CAST(t.source_size AS DOUBLE) ELSE 0.0 END AS rate,
         CAST(CAST('0x' || substr(md5('mix:' || coalesce(CAST(d.doc_id AS VARCHAR), '')), 1, 13) AS UBIGINT) AS DOUBLE) / 4503599627370496.0 AS coin
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       CAST((CAST(floor(rate) AS BIGINT) + CASE WHEN coin < rate - floor(rate) THEN 1 ELSE 0 END) * size AS BIGINT) AS taken
FROM r
"""


OP5 = """
WITH v AS (
  SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: CAST(floor(64.0 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
  SELECT q.n, q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.n <> c.n WHERE q.vec_id % 20 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT * FROM r WHERE rank <= 20
"""


def _spans(name: str, pattern: str, kind: str, rank: int, condition: str = "true") -> str:
    """Rows doc_id, start, rank, kind, stop, m of the matches in d, from the lengths of pieces and matches."""
    quoted = pattern.replace("'", "''")
    return f"""
{name}_m AS (
  SELECT doc_id, regexp_extract_all(text, '{quoted}') AS m, string_split_regex(text, '{quoted}') AS p FROM d WHERE regexp_matches(text, '{quoted}')
), {name}_i AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM {name}_m
), {name} AS (
  SELECT doc_id, CAST(list_sum(list_transform(p[1:i], lambda x: len(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: len(x))), 0) AS INTEGER) AS start, {rank} AS rank, '{kind}' AS kind, m[i] AS m
  FROM {name}_i WHERE {condition.replace("$m", "m[i]")}
)"""


def _op3() -> str:
    from docengine.llm import secrets as s

    f = "[" + ", ".join(map(str, s.weights()[1:])) + "]"
    allowed = " OR ".join(f"regexp_matches(m, '{p}')" for p in s.ALLOWED)
    assign = s.ASSIGN.replace("'", "''")
    wide = "[A-Za-z0-9+/_=-]{%d,}" % s.WINDOW
    blanked = "m"
    for part in s.ALLOWED_PARTS:
        blanked = f"replace({blanked}, '{part}', '{' ' * len(part)}')"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
{_spans("a", s.ASSIGN, "assign", 0, f"len(regexp_extract($m, '{assign}', 2)) >= 6")},
{_spans("k", "AKIA[A-Z0-9]+", "access", 1, "len($m) >= 20")},
{_spans("h", "[0-9a-f]+", "hex", 2, "len($m) >= 24")},
{_spans("c", wide, "entropy", 3, "(regexp_matches($m, '[0-9]') OR (regexp_matches($m, '[a-z]') AND regexp_matches($m, '[A-Z]')))")},
w AS (
  SELECT doc_id, start, {blanked} AS m, unnest(range(0, len(m) - {s.WINDOW} + 1)) AS i,
         CASE WHEN regexp_matches(m, '^([0-9a-f]+|[0-9A-F]+)$') THEN {s.limit(s.HEX_BITS)} ELSE {s.limit(s.WIDE_BITS)} END AS most
  FROM c WHERE NOT ({allowed})
), x AS (
  SELECT doc_id, start, i, most, substr(m, CAST(i + 1 AS BIGINT), {s.WINDOW}) AS v FROM w
), y AS (
  SELECT doc_id, start, i FROM x WHERE NOT contains(v, ' ') AND list_sum(list_transform(list_distinct(string_split(v, '')), lambda q: {f}[{s.WINDOW} - len(replace(v, q, ''))])) <= most
), e AS (
  SELECT doc_id, CAST(start + min(i) AS INTEGER) AS start, 3 AS rank, 'entropy' AS kind, CAST(start + max(i) + {s.WINDOW} AS INTEGER) AS stop FROM y GROUP BY doc_id, start
), b AS (
  SELECT doc_id, start, rank, kind, start + len(m) AS stop FROM (SELECT * FROM a UNION ALL SELECT * FROM k UNION ALL SELECT * FROM h)
), g AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
         string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS s FROM b GROUP BY doc_id
), z AS (
  SELECT doc_id, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS s FROM (SELECT * FROM b UNION ALL SELECT * FROM e) GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(g.s, '')) AS base_sha256, coalesce(z.s, '') AS spans
FROM d LEFT JOIN g ON d.doc_id = g.doc_id LEFT JOIN z ON d.doc_id = z.doc_id
"""


def _edits(n: str) -> str:
    from docengine.llm.line_dedup import EDITS

    return "(CASE " + " ".join(f"WHEN {n} < {below} THEN {t}" for below, t in EDITS) + " END)"


def _step(o: int) -> str:
    """The distance between the first i + 1 characters of a and as many and o of b, from those before (c) and beside it (e)."""
    j, k = f"(i + 1 + {o})", o + 3
    ways = [f"c{k} + CASE WHEN substr(a, i + 1, 1) = substr(b, CAST({j} AS BIGINT), 1) THEN 0 ELSE 1 END"]
    ways += [f"c{k + 1} + 1"] if k < 6 else []
    ways += [f"e{k - 1} + 1"] if k > 0 else []
    return f"CASE WHEN {j} < 0 OR {j} > m THEN 99 WHEN {j} = 0 THEN i + 1 ELSE least({', '.join(ways)}) END AS e{k}"


def _op10() -> str:
    """Near texts by segments of equal length, distances by rows of the table three off its diagonal, and one text after the other."""
    size = f"(n // ({_edits('n')} + 1))"
    return rf"""
WITH RECURSIVE l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS pos FROM documents WHERE text IS NOT NULL
), o AS (SELECT * FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), t AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY first, line) AS r FROM (SELECT line, len(line) AS n, min(doc_id) AS first FROM o GROUP BY line)
), ix AS MATERIALIZED (SELECT r, line, n, k, substr(line, CAST(k * {size} + 1 AS BIGINT), CAST({size} AS BIGINT)) AS seg FROM (SELECT *, unnest(range(0, {_edits('n')} + 1)) AS k FROM t WHERE {_edits('n')} > 0)
), pn AS (SELECT r, line, m, n, unnest(range(0, {_edits('n')} + 1)) AS k FROM (SELECT r, line, n AS m, n - unnest(range(0, 4)) AS n FROM t) WHERE {_edits('n')} > 0 AND m - n <= {_edits('n')}
), ps AS (SELECT *, unnest(range(-{_edits('n')}, {_edits('n')} + 1)) AS s FROM pn
), pr AS (SELECT r, line, m, n, k, substr(line, CAST(k * {size} + s + 1 AS BIGINT), CAST({size} AS BIGINT)) AS seg FROM ps WHERE k * {size} + s >= 0
), c AS MATERIALIZED (
  SELECT DISTINCT ix.r AS ar, pr.r AS br, ix.line AS a, pr.line AS b, ix.n AS n, pr.m AS m FROM ix JOIN pr ON ix.n = pr.n AND ix.k = pr.k AND ix.seg = pr.seg
  WHERE ix.r <> pr.r AND (pr.m > ix.n OR ix.r < pr.r)
), dp AS (
  SELECT ar, br, a, b, n, m, CAST(0 AS BIGINT) AS i, 99 AS c0, 99 AS c1, 99 AS c2, 0 AS c3, 1 AS c4, 2 AS c5, 3 AS c6 FROM c
  UNION ALL
  SELECT ar, br, a, b, n, m, i + 1, e0, e1, e2, e3, e4, e5, e6 FROM (SELECT *, {", ".join(map(_step, range(-3, 4)))} FROM dp WHERE i < n AND least(c0, c1, c2, c3, c4, c5, c6) <= 3)
), k AS MATERIALIZED (
  SELECT greatest(ar, br) AS later, least(ar, br) AS earlier FROM dp WHERE i = n AND CASE m - n WHEN 0 THEN c3 WHEN 1 THEN c4 WHEN 2 THEN c5 ELSE c6 END <= {_edits('n')}
), q AS MATERIALIZED (
  SELECT r, row_number() OVER (ORDER BY r) AS i, coalesce(list(k.earlier) FILTER (k.earlier IS NOT NULL), []) AS before
  FROM (SELECT later AS r FROM k UNION SELECT earlier FROM k) LEFT JOIN k ON r = k.later GROUP BY r
), w AS (
  SELECT CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS kept
  UNION ALL
  SELECT q.i, CASE WHEN list_has_any(kept, before) THEN kept ELSE list_append(kept, r) END FROM w JOIN q ON q.i = w.i + 1
), near AS (
  SELECT line FROM t JOIN q ON t.r = q.r WHERE NOT list_contains((SELECT arg_max(kept, i) FROM w), q.r)
), u AS (
  SELECT o.doc_id, o.pos, o.line, near.line IS NOT NULL AS near,
         near.line IS NOT NULL OR o.doc_id <> t.first OR row_number() OVER (PARTITION BY o.doc_id, o.line ORDER BY o.pos) > 1 AS gone
  FROM o JOIN t ON o.line = t.line LEFT JOIN near ON o.line = near.line
), g AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone AND NOT near) AS n_exact, count(*) FILTER (gone AND near) AS n_near FROM u GROUP BY doc_id
), x AS (
  SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.pos) AS text FROM l LEFT JOIN u ON l.doc_id = u.doc_id AND l.pos = u.pos WHERE coalesce(NOT u.gone, true) GROUP BY l.doc_id
)
SELECT d.doc_id, coalesce(g.n_lines, 0) AS n_lines, coalesce(g.n_exact, 0) AS n_exact, coalesce(g.n_near, 0) AS n_near, sha256(coalesce(x.text, '')) AS text_sha256
FROM documents d LEFT JOIN g ON d.doc_id = g.doc_id LEFT JOIN x ON d.doc_id = x.doc_id
"""


OP8 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN w IS NULL OR len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                      ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) END AS s FROM w
), n AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM s
), x AS (SELECT doc_id, unnest(s) AS h FROM s
), o AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM x a JOIN x b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY ALL
), k AS (
  SELECT o.a, o.b FROM o JOIN n p ON o.a = p.doc_id JOIN n q ON o.b = q.doc_id WHERE 100 * shared >= 75 * (p.n + q.n - shared)
), e AS (SELECT a, b FROM k UNION ALL SELECT b, a FROM k
), r(doc_id, other) AS (
  SELECT doc_id, doc_id FROM n UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.other = e.a
)
SELECT n.doc_id, n.n AS n_shingles, min(r.other) AS component_id FROM n JOIN r ON n.doc_id = r.doc_id GROUP BY ALL
"""

ORACLES: dict[str, str] = {"op2_mix": OP2, "op3_secrets": _op3(), "op5_topk": OP5, "op8_ngram_join": OP8, "op10_line_dedup": _op10()}
