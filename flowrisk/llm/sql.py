"""SQL counterparts of the licence scan, the source audit and the vector codes, written from their laws without any index."""

from __future__ import annotations

from flowrisk.llm import divergence, licenses, vector_codes

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _found(letters: str) -> str:
    return f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[{letters}\\x{{80}}-\\x{{10FFFF}}]+')"


def licenses_sql(templates: tuple[licenses.Template, ...] = licenses.TEMPLATES) -> str:
    """Every template is laid at every place where the first word of its key phrases stands."""
    laid, rows = [], []
    for number, t in enumerate(templates):
        text, keys = t.words(), t.key_places()
        same = " AND ".join(f"w[i + {k - keys[0] + 1}] = '{text[k]}'" for k in keys)
        laid.append(
            f"SELECT id, {number} AS template, i - {keys[0]} AS start FROM "
            f"(SELECT id, unnest(list_filter(range(0, len(w)), lambda i: {same})) AS i FROM d)"
        )
        rows += [f"({number}, '{t.label}', {str(t.base).lower()}, {i}, '{x}')" for i, x in enumerate(text)]
    vocabulary = sorted({w for t in templates for w in t.words()})
    listed = "(a.matched * 100 >= a.whole * {}) OR base".format(licenses.MATCHED)
    return f"""
    WITH d AS MATERIALIZED (SELECT row_number() OVER () AS id, doc_id, {_found("0-9a-z")} AS w FROM documents),
    df AS (SELECT word, count(*) AS n FROM (
      SELECT unnest(list_filter(list_distinct(w), lambda x: x IN ({", ".join(f"'{v}'" for v in vocabulary)}))) AS word FROM d) GROUP BY word),
    t AS (SELECT v.*, (SELECT count(*) FROM d) // (coalesce(df.n, 0) + 1) AS odds
      FROM (VALUES {", ".join(rows)}) v(template, label, base, off, word) LEFT JOIN df USING (word)),
    weighed AS (SELECT *, CASE WHEN odds = 0 THEN 0 ELSE length(bin(odds)) END AS bits FROM t),
    r AS (SELECT *, CASE WHEN max(bits) OVER (PARTITION BY template) = 0 THEN 1 ELSE bits END AS weight FROM weighed),
    laid AS ({" UNION ALL ".join(laid)}),
    a AS (SELECT id, template, start, any_value(label) AS label, any_value(base) AS base, sum(weight) AS whole,
        sum(CASE WHEN start + off >= 0 AND w[start + off + 1] = word THEN weight ELSE 0 END) AS matched
      FROM laid JOIN d USING (id) JOIN r USING (template) GROUP BY ALL),
    s AS (SELECT id, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
        array_to_string(list_sort(list(DISTINCT label) FILTER (base)), ',') AS base_labels,
        array_to_string(list_sort(list(DISTINCT label)), ',') AS labels, max(CAST(matched AS DOUBLE) / CAST(whole AS DOUBLE)) AS score
      FROM a WHERE {listed} GROUP BY id)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word,
      CAST(last_word AS BIGINT) AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
    FROM d LEFT JOIN s USING (id)"""


def audit_sql() -> str:
    """Every group meets every kept term of its language, and every other group on it."""
    unit, smooth = divergence.UNIT, divergence.SMOOTH

    def share(count: str, total: str) -> str:
        return f"1 + (CAST({unit} AS HUGEINT) * ({count} + {smooth})) // ({total} + {smooth} * v)"

    def gap(p: str, q: str) -> str:
        return f"(({p} - {q}) * ({p} - {q})) // ({p} + {q})"

    return f"""
    WITH d AS MATERIALIZED (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {_found("a-z")} AS t FROM documents),
    w AS MATERIALIZED (SELECT id, lang, source, unnest(t) AS term FROM d),
    kept AS MATERIALIZED (SELECT lang, term, count(*) AS total FROM w GROUP BY ALL HAVING count(DISTINCT id) >= {divergence.LEAST_DOCS}),
    sizes AS (SELECT lang, count(*) AS v, sum(total) AS lang_total FROM kept GROUP BY lang),
    g AS (SELECT DISTINCT lang, source FROM d),
    c AS (SELECT lang, source, term, count(*) AS n FROM w GROUP BY ALL),
    f AS MATERIALIZED (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, k.total, v, lang_total, sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang, g.source) AS own
      FROM g JOIN kept k USING (lang) JOIN sizes USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
    p AS MATERIALIZED (SELECT lang, source, term, n, CAST({share("n", "own")} AS BIGINT) AS p, CAST({share("total", "lang_total")} AS BIGINT) AS q FROM f),
    met AS (SELECT a.lang, a.source, b.source AS item, sum({gap("a.p", "b.p")}) AS value
      FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
    pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(m.value, 0) AS BIGINT) AS value
      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
      LEFT JOIN met m ON m.lang = a.lang AND m.source = a.source AND m.item = b.source),
    terms AS (SELECT lang, source, 'term' AS part, term AS item, CAST({gap("p", "q")} AS BIGINT) AS value FROM p WHERE n > 0 AND p > q),
    ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
      FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
    SELECT * FROM ranked WHERE part = 'pair' OR rank <= {divergence.TOP_TERMS}"""


def codes_sql(how: vector_codes.Settings = vector_codes.DEFAULT) -> str:
    """All rounds unrolled; every part meets every entry, component by component."""
    def assigned(r: int) -> str:
        return (
            f"d{r} AS (SELECT e.vec_id, e.p, c.k, sum((e.x - c.x) * (e.x - c.x)) AS dist FROM e JOIN c{r} c ON e.p = c.p AND e.j = c.j GROUP BY ALL), "
            f"s{r} AS MATERIALIZED (SELECT vec_id, p, min(dist) AS dist, arg_min(k, dist * {how.entries} + k) AS k FROM d{r} GROUP BY ALL)"
        )

    steps = [
        "kept AS (SELECT vec_id, label, embedding FROM embeddings WHERE embedding IS NOT NULL "
        "AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0)",
        f"w AS (SELECT max(len(embedding)) // {how.parts} AS w FROM kept)",
        f"flat AS (SELECT vec_id, unnest(range(0, len(embedding))) AS i, CAST(floor({how.scale} * CAST(unnest(embedding) AS DOUBLE)) AS BIGINT) AS x FROM kept)",
        "e AS MATERIALIZED (SELECT vec_id, i // w AS p, i % w AS j, x FROM flat, w)",
        f"f AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS k FROM kept ORDER BY vec_id LIMIT {how.entries})",
        "c0 AS MATERIALIZED (SELECT p, k, j, x FROM e JOIN f USING (vec_id))",
    ]
    for r in range(how.rounds):
        steps.append(assigned(r))
        steps.append(
            f"m{r} AS (SELECT e.p, k, j, CAST(sum(x) AS BIGINT) AS t, count(*) AS n FROM e JOIN s{r} USING (vec_id, p) GROUP BY ALL), "
            f"c{r + 1} AS MATERIALIZED (SELECT p, k, j, CASE WHEN n IS NULL THEN x ELSE (t - ((t % n) + n) % n) // n END AS x FROM c{r} LEFT JOIN m{r} USING (p, k, j))"
        )
    last = how.rounds
    steps.append(assigned(last))
    return f"""
    WITH {", ".join(steps)},
    o AS (SELECT vec_id, string_agg(format('{{:02x}}', k), '' ORDER BY p) AS code, CAST(sum(dist) AS BIGINT) AS error FROM s{last} GROUP BY vec_id)
    SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
      (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY p, k, j)) FROM c{last}) AS codebooks_sha256
    FROM o JOIN kept USING (vec_id)"""
