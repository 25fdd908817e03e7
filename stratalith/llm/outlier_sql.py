"""The outlier query as one DuckDB statement: the same counts, estimates and verdict, step by step."""

from __future__ import annotations

from .robust_outliers import CONSISTENCY, CUTOFF, DIMENSIONS, FLOOR, GRID, GROUP_ROWS, KEEP, STEPS, UNITS

_D = range(len(DIMENSIONS))
_XS = ", ".join(DIMENSIONS)

_COUNTS = rf"""d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
w AS MATERIALIZED (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
win AS (SELECT rid, unnest(range(1, len(ws) - 3)) AS i, unnest(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) AS s FROM w WHERE len(ws) >= 5),
rep AS (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS after FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, s) AS c FROM win) WHERE c > 1),
cov AS (SELECT rid, sum(least(5, coalesce(after - i, 5))) AS covered FROM rep GROUP BY rid),
c AS MATERIALIZED (SELECT rid, doc_id, lang, source, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(covered, 0) AS BIGINT) AS n_repeat_words, len(ls) AS n_lines FROM w LEFT JOIN cov USING (rid))"""


def _share(part: str, whole: str) -> str:
    return f"asin(sqrt(least(1e0, {part} / greatest(1, {whole}))))"


def _distance() -> str:
    """Solved values ``y`` as columns, each from those before it, and their squares' sum."""
    lines = []
    for i in _D:
        top = f"({DIMENSIONS[i]} - m{i})" + "".join(f" - l{i}{k} * y{k}" for k in range(i))
        lines.append(f"({top}) / l{i}{i} AS y{i}")
    return ", ".join(lines) + ", " + " + ".join(f"y{i} * y{i}" for i in _D) + " AS dist"


def _moments(source: str) -> str:
    sums = ", ".join(f"CAST(sum({x}) AS DOUBLE) / count(*) AS m{i}" for i, x in enumerate(DIMENSIONS))
    pairs = [(i, j) for i in _D for j in range(i + 1)]
    products = ", ".join(f"CAST(sum({DIMENSIONS[i]} * {DIMENSIONS[j]}) AS DOUBLE) / count(*) AS p{i}{j}" for i, j in pairs)
    cover = ", ".join(f"(p{i}{j} - m{i} * m{j}) * {CONSISTENCY}e0 + {FLOOR ** 2 if i == j else 0} AS c{i}{j}" for i, j in pairs)
    factor = []
    for j in _D:
        left = lambda i, j=j: f"c{i}{j}" + "".join(f" - l{i}{k} * l{j}{k}" for k in range(j))
        factor.append(f"sqrt(greatest({left(j)}, 1e0)) AS l{j}{j}")
        factor += [f"({left(i)}) / l{j}{j} AS l{i}{j}" for i in range(j + 1, len(DIMENSIONS))]
    kept = ", ".join([*(f"m{i}" for i in _D), *(f"l{i}{j}" for i, j in pairs)])
    return f"SELECT grp, {kept} FROM (SELECT *, {', '.join(factor)} FROM (SELECT *, {cover} FROM (SELECT grp, {sums}, {products} FROM {source} GROUP BY grp)))"


def _medians() -> str:
    parts = [f"""q{i} AS (SELECT grp, min(v) FILTER (reached >= total * 0.5) AS m, (min(v) FILTER (reached >= total * 0.75) - min(v) FILTER (reached >= total * 0.25)) / 1.349e0 AS d
  FROM (SELECT grp, v, sum(n) OVER (PARTITION BY grp ORDER BY v) AS reached, sum(n) OVER (PARTITION BY grp) AS total FROM (SELECT grp, {x} AS v, count(*) AS n FROM used GROUP BY ALL)) GROUP BY grp)""" for i, x in enumerate(DIMENSIONS)]
    columns = [f"CAST(q{i}.m AS DOUBLE) AS m{i}" for i in _D] + [f"greatest({FLOOR}e0, q{i}.d) AS l{i}{j}" if i == j else f"0e0 AS l{i}{j}" for i in _D for j in range(i + 1)]
    joins = "q0" + "".join(f" JOIN q{i} USING (grp)" for i in _D if i)
    return ",\n".join(parts) + f",\ne0 AS MATERIALIZED (SELECT grp, {', '.join(columns)} FROM {joins})"


def outliers() -> str:
    raw = ("ln(1e0 + n_words) / 4", "ln(1e0 + word_chars / greatest(1, n_words))", _share("n_symbols", "word_chars"), _share("n_dup_lines", "n_lines"), _share("n_repeat_words", "n_words"))
    vector = ", ".join(f"CAST(round(({x}) * {UNITS}) AS BIGINT) AS {name}" for x, name in zip(raw, DIMENSIONS))
    steps = [f"""f{k} AS MATERIALIZED (SELECT *, floor(ln(1e0 + dist) * {GRID}) AS cell FROM (SELECT grp, {_XS}, {_distance()} FROM used JOIN e{k} USING (grp))),
g{k} AS (SELECT grp, min(cell) AS edge FROM (SELECT grp, cell, sum(n) OVER (PARTITION BY grp ORDER BY cell) AS reached, sum(n) OVER (PARTITION BY grp) AS total
  FROM (SELECT grp, cell, count(*) AS n FROM f{k} GROUP BY ALL)) WHERE reached >= total * {KEEP} GROUP BY grp),
i{k} AS (SELECT grp, {_XS} FROM f{k} JOIN g{k} USING (grp) WHERE cell <= edge),
e{k + 1} AS MATERIALIZED ({_moments(f"i{k}")})""" for k in range(STEPS)]
    return f"""WITH {_COUNTS},
b AS MATERIALIZED (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, {vector} FROM c),
level AS (SELECT lang, source, CASE WHEN n >= {GROUP_ROWS} THEN 's:' || lang || ':' || source WHEN sum(n) OVER (PARTITION BY lang) >= {GROUP_ROWS} THEN 'l:' || lang ELSE 'a:' END AS grp
  FROM (SELECT lang, source, count(*) AS n FROM b WHERE NOT base_failed GROUP BY ALL)),
own AS MATERIALIZED (SELECT b.*, grp FROM b JOIN level USING (lang, source) WHERE NOT base_failed),
used AS MATERIALIZED (SELECT * FROM (SELECT {_XS}, unnest(['s:' || lang || ':' || source, 'l:' || lang, 'a:']) AS grp FROM own) WHERE grp IN (SELECT grp FROM level)),
{_medians()},
{", ".join(steps)},
far AS (SELECT rid, {_distance()} FROM own JOIN e{STEPS} USING (grp))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(dist, 0) <= {CUTOFF} AS kept FROM b LEFT JOIN far USING (rid)"""
