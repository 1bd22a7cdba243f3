"""SQL for DuckDB that computes what each query must return, from the same parquet tables.

`_NAMED` holds the views as named queries; each oracle lists the ones it needs.
"""

from __future__ import annotations

from semaspan.functions import distributions as dist
from semaspan.operators import hypothesis as hyp
from semaspan.workload.queries import N_PERM
from semaspan.workload.views import (
    DIMENSION, EXCLUDE_FIRST, FREQ_MIN, LIGHT_VERBS, MIN_LENGTH, NOMINALS, PLAIN_VERBS, TAG_BY_LENGTH,
    TAGGED_WORDS, UNCLASSIFIED_FROM, VOCABULARY, WINDOW,
)


def _tag_sql(w: str) -> str:
    cases = [f"WHEN regexp_matches({w}, '^[0-9]') THEN 'ADJ'"]
    for tag, words in TAGGED_WORDS.items():
        listed = ", ".join(f"'{x}'" for x in words)
        cases.append(f"WHEN {w} IN ({listed}) THEN '{tag}'")
    cases.append(f"WHEN length({w}) >= {UNCLASSIFIED_FROM} THEN 'UNC'")
    for rest, tag in enumerate(TAG_BY_LENGTH[:-1]):
        cases.append(f"WHEN length({w}) % 4 = {rest} THEN '{tag}'")
    return f"CASE {' '.join(cases)} ELSE '{TAG_BY_LENGTH[-1]}' END"


def _simpson_sql(low: str, high: str, f) -> str:
    """Simpson's rule with 2000 intervals; `f` maps the SQL of a point to the SQL of its value."""
    at = f"(({low}) + k * (({high}) - ({low})) / 2000.0::DOUBLE)"
    weight = "CASE WHEN k = 0 OR k = 2000 THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END"
    return (
        f"(list_sum(list_transform(range(0, 2001), lambda k: ({weight}) * {f(at)}))"
        f" * (({high}) - ({low})) / 2000.0::DOUBLE / 3)"
    )


def _cos_area(low: str, high: str, df: str) -> str:
    return _simpson_sql(low, high, lambda at: f"pow(abs(cos({at})), {df} - 1)")


def _t_two_sided_sql(t: str, df: str) -> str:
    angle = f"atan(abs({t}) / sqrt({df}))"
    return f"least(1, {_cos_area(angle, 'pi() / 2', df)} / {_cos_area('0', 'pi() / 2', df)})"


def _t_upper_sql(t: str, two_sided: str) -> str:
    return f"CASE WHEN {t} >= 0 THEN {two_sided} / 2 ELSE 1 - {two_sided} / 2 END"


def _t_quantile_ctes(source: str, df: str, p: float = 0.975) -> str:
    """Named queries q0, q1, ...: the angle of the t quantile closes in by bisection."""
    parts = [
        f"q0 AS (SELECT *, 0::DOUBLE AS lo, pi() / 2 AS hi, {2 * p - 1} * {_cos_area('0', 'pi() / 2', df)} AS goal FROM {source})"
    ]
    rounds = 45
    for i in range(rounds):
        area = _cos_area("0", "(lo + hi) / 2", df)
        parts.append(
            f"q{i + 1} AS MATERIALIZED (SELECT * EXCLUDE (lo, hi, below), CASE WHEN below THEN (lo + hi) / 2 ELSE lo END AS lo,"
            f" CASE WHEN below THEN hi ELSE (lo + hi) / 2 END AS hi FROM (SELECT *, {area} < goal AS below FROM q{i}))"
        )
    parts.append(f"quantiled AS (SELECT *, sqrt({df}) * tan((lo + hi) / 2) AS t_q FROM q{rounds})")
    return ",\n".join(parts)


_TAG = _tag_sql("w")

# name -> (names it builds on, body)
# Total orders are numbered with rank(): DuckDB 2.0 loses a row when it pushes a bound below row_number() - 1.
_NAMED: dict[str, tuple[tuple[str, ...], str]] = {
    "lines": ((), """
        SELECT doc_id, source, lang, CAST(i - 1 AS BIGINT) AS line_no, parts[i] AS line
        FROM (SELECT doc_id, source, lang, string_split(text, chr(10)) AS parts,
                     unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)"""),
    "spelled": (("lines",), r"""
        SELECT *, regexp_extract_all(lower(line), '\p{L}+|[0-9]+') AS words FROM lines"""),
    "tokens": (("spelled",), f"""
        SELECT *, w || '_' || {_TAG} AS lemma_pos, {_TAG} AS tag FROM (
            SELECT doc_id, source, lang, line_no, len(words) AS n_tokens, CAST(i - 1 AS BIGINT) AS pos, words[i] AS w
            FROM (SELECT *, unnest(range(1, len(words) + 1)) AS i FROM spelled))"""),
    "joined": (("lines", "tokens"), """
        SELECT l.doc_id, l.source, l.lang, l.line_no, coalesce(t.tagged, '') AS tagged, coalesce(t.plain, '') AS plain,
               coalesce(t.n, 0) AS n
        FROM lines l LEFT JOIN (
            SELECT doc_id, line_no, string_agg(lemma_pos, ' ' ORDER BY pos) AS tagged,
                   string_agg(w, ' ' ORDER BY pos) AS plain, count(*) AS n
            FROM tokens GROUP BY doc_id, line_no) t ON l.doc_id = t.doc_id AND l.line_no = t.line_no"""),
    "freqs": (("tokens",), "SELECT lemma_pos, count(*) AS freq FROM tokens GROUP BY lemma_pos"),
    "ranked": (("freqs",), """
        SELECT rank() OVER (ORDER BY freq DESC, lemma_pos DESC) AS rank, freq, lemma_pos FROM freqs"""),
    "basis": (("freqs",), f"""
        SELECT rk - {EXCLUDE_FIRST} AS basis_index, lemma_pos FROM (
            SELECT lemma_pos, rank() OVER (ORDER BY freq DESC, lemma_pos DESC) - 1 AS rk FROM freqs
            WHERE regexp_matches(lemma_pos, '^(--anon|[a-zA-Z])+_[A-Z]+$')
              AND NOT regexp_matches(lemma_pos, '_(STOP|PREP|PRON|CONJ)')
              AND NOT regexp_matches(lemma_pos, '^[a-z]_[A-Z]+$'))
        WHERE rk >= {EXCLUDE_FIRST} AND rk < {EXCLUDE_FIRST + DIMENSION}"""),
    "targets": (("freqs",), f"""
        SELECT rk AS voc_index, lemma_pos FROM (
            SELECT lemma_pos, rank() OVER (ORDER BY freq DESC, lemma_pos DESC) - 1 AS rk FROM freqs
            WHERE freq >= {FREQ_MIN})
        WHERE rk < {VOCABULARY}"""),
    "cells": (("tokens", "targets", "basis"), f"""
        SELECT a.lemma_pos, b.basis_index, count(*) AS n
        FROM (SELECT doc_id, line_no, pos, lemma_pos FROM tokens JOIN targets USING (lemma_pos) WHERE n_tokens > {MIN_LENGTH}) a
        JOIN (SELECT doc_id, line_no, pos, lemma_pos, basis_index FROM tokens JOIN basis USING (lemma_pos)) b
          ON a.doc_id = b.doc_id AND a.line_no = b.line_no AND abs(a.pos - b.pos) <= {WINDOW} AND a.lemma_pos <> b.lemma_pos
        GROUP BY a.lemma_pos, b.basis_index"""),
    "ppmi": (("cells",), """
        SELECT * FROM (
            SELECT lemma_pos, basis_index, log2((n / t) / ((r / t) * (c / t))) AS ppmi FROM (
                SELECT lemma_pos, basis_index, n::DOUBLE AS n, r::DOUBLE AS r, c::DOUBLE AS c, t::DOUBLE AS t FROM cells
                JOIN (SELECT lemma_pos, sum(n) AS r FROM cells GROUP BY lemma_pos) USING (lemma_pos)
                JOIN (SELECT basis_index, sum(n) AS c FROM cells GROUP BY basis_index) USING (basis_index)
                CROSS JOIN (SELECT sum(n) AS t FROM cells)))
        WHERE ppmi > 0"""),
    "nouns": (("targets",), """
        SELECT rank() OVER (ORDER BY voc_index) - 1 AS i, lemma_pos FROM targets WHERE lemma_pos LIKE '%\\_SUBST' ESCAPE '\\'"""),
    "verbs": (("targets",), """
        SELECT rank() OVER (ORDER BY voc_index) - 1 AS i, lemma_pos FROM targets WHERE lemma_pos LIKE '%\\_VERB' ESCAPE '\\'"""),
    "pairs": (("nouns", "verbs"), f"""
        SELECT l.lemma_pos AS lv_pos, n.lemma_pos AS nominal_pos, f.lemma_pos AS fvc_pos
        FROM verbs l JOIN nouns n ON l.i < {LIGHT_VERBS} AND n.i < {NOMINALS}
        JOIN verbs f ON f.i = {LIGHT_VERBS} + (l.i * {NOMINALS} + n.i) % {PLAIN_VERBS}"""),
    "gap_pairs": (("pairs",), """
        SELECT lv_pos, CASE WHEN length(nominal_pos) % 5 = 0 THEN 'zzz_SUBST' ELSE nominal_pos END AS nominal_pos, fvc_pos FROM pairs"""),
    "seeds": (("nouns",), "SELECT lemma_pos, CASE WHEN i < 7 THEN 1 ELSE 2 END AS category FROM nouns WHERE i < 13"),
    "ratings": (("nouns",), """
        SELECT word1, CASE WHEN i % 10 = 9 THEN 'zzz_SUBST' ELSE partner END AS word2, (i * 7 % 50)::DOUBLE AS human
        FROM (SELECT i, lemma_pos AS word1, lead(lemma_pos) OVER (ORDER BY i) AS partner FROM nouns) WHERE partner IS NOT NULL"""),
    "annotated": (("tokens",), """
        SELECT doc_id, line_no, pos + 1 AS id, w AS lemma, upos,
               CASE WHEN upos = 'NOUN' AND verb IS NOT NULL THEN 'obj' ELSE 'dep' END AS deprel,
               CASE WHEN upos = 'NOUN' AND verb IS NOT NULL THEN verb ELSE 0 END AS head
        FROM (SELECT *, CASE WHEN regexp_matches(w, '^[0-9]') OR (w = 'on' AND line_no = 0) THEN 'NUM'
                             WHEN tag = 'SUBST' THEN 'NOUN' WHEN tag = 'VERB' THEN 'VERB' ELSE 'X' END AS upos,
                     CASE WHEN lag(tag, 1) OVER s = 'VERB' THEN pos WHEN lag(tag, 2) OVER s = 'VERB' THEN pos - 1
                          WHEN lag(tag, 3) OVER s = 'VERB' THEN pos - 2 END AS verb
              FROM tokens WINDOW s AS (PARTITION BY doc_id, line_no ORDER BY pos))"""),
    "lexicon": (("annotated",), "SELECT DISTINCT doc_id, lemma FROM annotated WHERE upos = 'NUM'"),
    "objects": (("annotated", "pairs"), """
        SELECT o.doc_id, o.line_no, o.id, v.lemma || '_VERB' AS lv, o.lemma || '_SUBST' AS nominal
        FROM annotated o JOIN annotated v ON o.doc_id = v.doc_id AND o.line_no = v.line_no AND o.head = v.id
        WHERE o.upos = 'NOUN' AND o.deprel = 'obj' AND EXISTS (
            SELECT 1 FROM pairs p WHERE p.lv_pos = v.lemma || '_VERB' AND p.nominal_pos = o.lemma || '_SUBST')"""),
    "plain_verbs": (("annotated", "pairs"), """
        SELECT doc_id, line_no, id, lemma || '_VERB' AS fvc FROM annotated
        WHERE upos = 'VERB' AND lemma || '_VERB' IN (SELECT fvc_pos FROM pairs)"""),
    "groups": (("objects", "plain_verbs"), """
        SELECT doc_id, line_no, lv || '_' || nominal AS construction, 'LVC' AS kind FROM objects
        UNION ALL SELECT doc_id, line_no, fvc, 'FVC' FROM plain_verbs"""),
    "grouped": (("groups", "joined"), """
        SELECT construction, kind, doc_id, line_no, tagged AS sentence FROM groups JOIN joined USING (doc_id, line_no)"""),
    "seen": (("groups",), """
        SELECT DISTINCT construction, kind, split_part(construction, '_', 1) || '_' || split_part(construction, '_', 2) AS verb,
               CASE WHEN kind = 'LVC' THEN split_part(construction, '_', 3) || '_' || split_part(construction, '_', 4) ELSE '' END AS nominal
        FROM groups"""),
    "means": (("seeds", "ppmi"), """
        SELECT category, basis_index, sum(ppmi) / any_value(members) AS mean FROM seeds JOIN ppmi USING (lemma_pos)
        JOIN (SELECT category, count(*) AS members FROM seeds GROUP BY category) USING (category)
        GROUP BY category, basis_index"""),
    "scale": (("means",), """
        SELECT basis_index, sum(CASE WHEN category = 1 THEN mean ELSE -mean END) AS weight FROM means GROUP BY basis_index"""),
    "projected": (("targets", "ppmi", "scale"), """
        SELECT lemma_pos, coalesce(p, 0) AS projection FROM targets LEFT JOIN (
            SELECT lemma_pos, sum(ppmi * weight) / (SELECT sqrt(sum(weight * weight)) FROM scale) AS p
            FROM ppmi JOIN scale USING (basis_index) GROUP BY lemma_pos) USING (lemma_pos)"""),
    "group_scores": (("groups", "tokens", "projected"), """
        SELECT * EXCLUDE (fine) FROM (SELECT DISTINCT construction, kind, doc_id, line_no FROM groups) JOIN (
            SELECT doc_id, line_no, bool_and(projection IS NOT NULL) AS fine, -sum(projection) AS x
            FROM tokens LEFT JOIN projected USING (lemma_pos) GROUP BY doc_id, line_no) USING (doc_id, line_no) WHERE fine"""),
    "found_pairs": (("ratings", "targets"), """
        SELECT * FROM ratings WHERE word1 IN (SELECT lemma_pos FROM targets) AND word2 IN (SELECT lemma_pos FROM targets)"""),
    "measured": (("found_pairs", "ppmi"), """
        SELECT word1, word2, human, coalesce(d, 0) AS dot, coalesce(d, 0) / greatest(sqrt(coalesce(aa, 0)) * sqrt(coalesce(bb, 0)), 1e-8) AS cosine,
               sqrt(coalesce(aa, 0) + coalesce(bb, 0) - coalesce(both_a, 0) - coalesce(both_b, 0) + coalesce(dd, 0)) AS euclidean
        FROM found_pairs
        LEFT JOIN (SELECT lemma_pos AS word1, sum(ppmi * ppmi) AS aa FROM ppmi GROUP BY lemma_pos) USING (word1)
        LEFT JOIN (SELECT lemma_pos AS word2, sum(ppmi * ppmi) AS bb FROM ppmi GROUP BY lemma_pos) USING (word2)
        LEFT JOIN (SELECT word1, word2, sum(a.ppmi * b.ppmi) AS d, sum(a.ppmi * a.ppmi) AS both_a, sum(b.ppmi * b.ppmi) AS both_b,
                          sum((a.ppmi - b.ppmi) * (a.ppmi - b.ppmi)) AS dd
                   FROM found_pairs JOIN ppmi a ON a.lemma_pos = word1
                   JOIN ppmi b ON b.lemma_pos = word2 AND b.basis_index = a.basis_index GROUP BY word1, word2) USING (word1, word2)"""),
    "rho": (("measured",), """
        SELECT measure, count(*) AS n, corr(rs, rh) AS rho FROM (
            SELECT measure,
                   rank() OVER (PARTITION BY measure ORDER BY score) + (count(*) OVER (PARTITION BY measure, score) - 1) / 2.0::DOUBLE AS rs,
                   rank() OVER (PARTITION BY measure ORDER BY human) + (count(*) OVER (PARTITION BY measure, human) - 1) / 2.0::DOUBLE AS rh
            FROM (SELECT 'cosine' AS measure, round(cosine, 9) AS score, human FROM measured
                  UNION ALL SELECT 'euclidean', round(euclidean, 9), human FROM measured
                  UNION ALL SELECT 'dot', round(dot, 9), human FROM measured))
        GROUP BY measure"""),
    "dense": ((), """
        SELECT a.vec_id AS id1, b.vec_id AS id2, list_transform(a.embedding, lambda x: x::DOUBLE) AS a,
               list_transform(b.embedding, lambda x: x::DOUBLE) AS b
        FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"""),
    "scores": ((), """
        SELECT event_type || '_' || (user_id % 5) AS pair, CASE WHEN event_id % 2 = 1 THEN 'LVC' ELSE 'FVC' END AS kind,
               event_id AS row, value AS score FROM events"""),
    "flagged": (("scores",), """
        SELECT pair, kind, row, score, score < q1 - 1.5 * (q3 - q1) OR score > q3 + 1.5 * (q3 - q1) AS is_outlier,
               score < q1 - 3 * (q3 - q1) OR score > q3 + 3 * (q3 - q1) AS is_extreme
        FROM scores JOIN (SELECT pair, kind, quantile_cont(score, 0.25) AS q1, quantile_cont(score, 0.75) AS q3
                          FROM scores GROUP BY pair, kind) USING (pair, kind)"""),
    "modes": ((), "SELECT unnest(['none', 'extreme', 'all']) AS mode"),
    "ranks": (("scores",), """
        SELECT pair, kind, score,
               rank() OVER (PARTITION BY pair ORDER BY score) + (count(*) OVER (PARTITION BY pair, score) - 1) / 2.0::DOUBLE AS r,
               rank() OVER (PARTITION BY pair, kind ORDER BY score) + (count(*) OVER (PARTITION BY pair, kind, score) - 1) / 2.0::DOUBLE AS ri
        FROM scores"""),
    "bm": (("ranks",), """
        SELECT *, nx * ny * (my - mx) / ((nx + ny) * sqrt(nx * sx + ny * sy)) AS statistic,
               pow(nx * sx + ny * sy, 2) / (pow(nx * sx, 2) / (nx - 1) + pow(ny * sy, 2) / (ny - 1)) AS df,
               (my - mx) / (nx + ny) + 0.5 AS relative_effect, sqrt(sx / (nx * ny * ny) + sy / (ny * nx * nx)) AS se
        FROM (SELECT pair, any_value(nx)::DOUBLE AS nx, any_value(ny)::DOUBLE AS ny, any_value(mx) AS mx, any_value(my) AS my,
                     sum(CASE WHEN kind = 'FVC' THEN pow(r - ri - mx + (nx + 1) / 2.0::DOUBLE, 2) END) / (any_value(nx) - 1) AS sx,
                     sum(CASE WHEN kind = 'LVC' THEN pow(r - ri - my + (ny + 1) / 2.0::DOUBLE, 2) END) / (any_value(ny) - 1) AS sy
              FROM ranks JOIN (SELECT pair, count(*) FILTER (kind = 'FVC') AS nx, count(*) FILTER (kind = 'LVC') AS ny,
                                      avg(r) FILTER (kind = 'FVC') AS mx, avg(r) FILTER (kind = 'LVC') AS my
                               FROM ranks GROUP BY pair) USING (pair) GROUP BY pair)"""),
    "bm_p": (("bm",), f"""
        SELECT *, {_t_upper_sql('statistic', 'p_two_sided')} AS p_greater
        FROM (SELECT *, {_t_two_sided_sql('statistic', 'df')} AS p_two_sided FROM bm)"""),
    "tests": (("bm_p",), "SELECT pair, split_part(pair, '_', 1) AS family, round(p_greater, 9) AS p_value FROM bm_p"),
    "paired": ((), """
        SELECT l_suppkey AS id, avg(l_extendedprice) FILTER (l_returnflag = 'A') AS fvc,
               avg(l_extendedprice) FILTER (l_returnflag = 'R') AS lvc
        FROM lineitem GROUP BY l_suppkey HAVING fvc IS NOT NULL AND lvc IS NOT NULL"""),
    "paired_stats": (("paired",), """
        SELECT count(*) AS n, avg(lvc - fvc) AS m, stddev_samp(lvc - fvc) AS sd, corr(lvc, fvc) AS r,
               (count(*) - 1)::DOUBLE AS df, avg(lvc - fvc) / (stddev_samp(lvc - fvc) / sqrt(count(*))) AS t FROM paired"""),
}


def _sql(needs: tuple[str, ...], select: str, extra: str = "") -> str:
    """A select with the named queries it needs, each after the ones it builds on."""
    listed: list[str] = []

    def add(name: str) -> None:
        for below in _NAMED[name][0]:
            add(below)
        if name not in listed:
            listed.append(name)

    for name in needs:
        add(name)
    named = [f"{n} AS MATERIALIZED ({_NAMED[n][1]})" for n in listed]  # ranks must see all rows
    if extra:
        named.append(extra)
    return (f"WITH {','.join(named)}\n" if named else "") + select


def _r(c: str, name: str | None = None) -> str:
    return f"round({c}, 6) + 0.0::DOUBLE AS {name or c}"


def _big(c: str) -> str:
    return f"{c}::BIGINT AS {c}"


_CELL = "lemma_pos, basis_index::BIGINT AS basis_index"
_XML = (
    "'<s n=\"' || line_no || '\">' || coalesce(body, '') || '<c c5=\"PUN\">.</c></s>'"
)
_XML_BODY = (
    "string_agg(CASE WHEN pos % 50 = 49 THEN '<trunc>' ELSE '' END || '<w c5=\"X\" hw=\"' || w || '\" pos=\"' || tag || '\">' || w || ' </w>'"
    " || CASE WHEN pos % 50 = 49 THEN '</trunc>' ELSE '' END, '' ORDER BY pos)"
)
_KEPT = "pos % 50 <> 49 AND tag NOT IN ('UNC', 'ART', 'INTERJ')"
_IS_NUMBER = "(regexp_matches(w, '^[0-9]') OR w IN (SELECT lemma FROM lexicon WHERE lexicon.doc_id = tokens.doc_id))"
_STRAY = """
    SELECT construction, sentence FROM grouped
    UNION ALL SELECT split_part(sentence, '_', 1) || '_VERB', sentence FROM grouped"""

_PERMUTED = f"""
    perms AS (SELECT unnest(range(1, {N_PERM + 1})) AS perm),
    drawn AS (
        SELECT pair, perm, score, CASE WHEN row_number() OVER (
            PARTITION BY pair, perm ORDER BY md5(concat_ws('|', 1, perm, pair, row))) <= nx THEN 'FVC' ELSE 'LVC' END AS kind
        FROM scores CROSS JOIN perms JOIN (SELECT pair, nx FROM bm) USING (pair)),
    pranks AS (
        SELECT pair, perm, kind,
               rank() OVER (PARTITION BY pair, perm ORDER BY score) + (count(*) OVER (PARTITION BY pair, perm, score) - 1) / 2.0::DOUBLE AS r,
               rank() OVER (PARTITION BY pair, perm, kind ORDER BY score) + (count(*) OVER (PARTITION BY pair, perm, kind, score) - 1) / 2.0::DOUBLE AS ri
        FROM drawn),
    pbm AS (
        SELECT pair, perm, nx * ny * (my - mx) / ((nx + ny) * sqrt(nx * sx + ny * sy)) AS w
        FROM (SELECT pair, perm, any_value(nx)::DOUBLE AS nx, any_value(ny)::DOUBLE AS ny, any_value(mx) AS mx, any_value(my) AS my,
                     sum(CASE WHEN kind = 'FVC' THEN pow(r - ri - mx + (nx + 1) / 2.0::DOUBLE, 2) END) / (any_value(nx) - 1) AS sx,
                     sum(CASE WHEN kind = 'LVC' THEN pow(r - ri - my + (ny + 1) / 2.0::DOUBLE, 2) END) / (any_value(ny) - 1) AS sy
              FROM pranks JOIN (SELECT pair, perm, count(*) FILTER (kind = 'FVC') AS nx, count(*) FILTER (kind = 'LVC') AS ny,
                                       avg(r) FILTER (kind = 'FVC') AS mx, avg(r) FILTER (kind = 'LVC') AS my
                                FROM pranks GROUP BY pair, perm) USING (pair, perm) GROUP BY pair, perm)),
    psum AS (
        SELECT pair, avg(CASE WHEN w >= statistic THEN 1.0::DOUBLE ELSE 0 END) AS share,
               quantile_cont(w, 0.025) AS low, quantile_cont(w, 0.975) AS high
        FROM pbm JOIN (SELECT pair, statistic FROM bm) USING (pair) GROUP BY pair)"""


def _bh(source: str, p: str, family: str, name: str) -> str:
    """Benjamini-Hochberg of p in families, as an extra column of `source`."""
    return (
        f"SELECT *, least(1, min({p} * n_tests / rk) OVER (PARTITION BY {family} ORDER BY {p} DESC"
        f" RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS {name} FROM ("
        f"SELECT *, count(*) OVER (PARTITION BY {family}) AS n_tests,"
        f" count(*) OVER (PARTITION BY {family} ORDER BY {p} RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS rk FROM {source})"
    )


def _poly_sql(coefficients: list[float], x: str) -> str:
    """coefficients[0] + coefficients[1] * x + ... in nested form."""
    value = f"{coefficients[-1]!r}::DOUBLE"
    for c in reversed(coefficients[:-1]):
        value = f"({value} * ({x}) + {c!r}::DOUBLE)"
    return value


def _normal_quantile_sql(p: str) -> str:
    """The rational approximation of the normal quantile, without its part for far tails."""
    q, tail = f"({p} - 0.5)", f"sqrt(-ln(least({p}, 1 - {p})))"
    centre = f"{q} * {_poly_sql(dist._CENTRE_NUM, f'0.180625 - {q} * {q}')} / {_poly_sql(dist._CENTRE_DEN, f'0.180625 - {q} * {q}')}"
    middle = f"{_poly_sql(dist._MIDDLE_NUM, f'{tail} - 1.6')} / {_poly_sql(dist._MIDDLE_DEN, f'{tail} - 1.6')}"
    return f"CASE WHEN abs({q}) <= 0.425 THEN {centre} ELSE sign({q}) * {middle} END"


_SHAPIRO = f"""
    placed AS (SELECT fvc - lvc AS v, row_number() OVER (ORDER BY fvc - lvc) AS i, count(*) OVER () AS n FROM paired),
    scored AS (SELECT v, i, n, {_normal_quantile_sql('((i - 0.375::DOUBLE) / (n + 0.25::DOUBLE))')} AS m FROM placed),
    outer_weights AS (
        SELECT n, mm, {_poly_sql(hyp._LAST_WEIGHT, '1 / sqrt(n)')} + m1 / sqrt(mm) AS a1,
               {_poly_sql(hyp._SECOND_WEIGHT, '1 / sqrt(n)')} + m2 / sqrt(mm) AS a2, m1, m2
        FROM (SELECT any_value(n) AS n, sum(m * m) AS mm, max(m) AS m1, max(CASE WHEN i = n - 1 THEN m END) AS m2 FROM scored)),
    weighted AS (
        SELECT s.v, s.n, CASE WHEN i = s.n THEN a1 WHEN i = 1 THEN -a1 WHEN s.n > 5 AND i = s.n - 1 THEN a2 WHEN s.n > 5 AND i = 2 THEN -a2
               WHEN s.n > 5 THEN m / sqrt((mm - 2 * m1 * m1 - 2 * m2 * m2) / (1 - 2 * a1 * a1 - 2 * a2 * a2))
               ELSE m / sqrt((mm - 2 * m1 * m1) / (1 - 2 * a1 * a1)) END AS a
        FROM scored s CROSS JOIN outer_weights),
    w AS (SELECT any_value(n) AS n, pow(sum(a * v), 2) / (var_pop(v) * count(*)) AS w FROM weighted),
    z AS (SELECT n, w, CASE WHEN n <= 11
               THEN (-ln({_poly_sql(hyp._SMALL_BOUND, 'n')} - ln(1 - w)) - {_poly_sql(hyp._SMALL_MEAN, 'n')}) / exp({_poly_sql(hyp._SMALL_SD, 'n')})
               ELSE (ln(1 - w) - {_poly_sql(hyp._LARGE_MEAN, 'ln(n)')}) / exp({_poly_sql(hyp._LARGE_SD, 'ln(n)')}) END AS z FROM w)"""


def _interval_sql(needs: str, df: str, columns: str) -> str:
    return _sql((needs,), f"SELECT {columns} FROM quantiled", _t_quantile_ctes(needs, df))


def _pca_sql(values: str, dimension: int, key: str, needs: tuple[str, ...] = (), squarings: int = 18) -> str:
    """First two principal components by squaring the covariance matrix until one direction is left.

    values: SQL of (vec_id, i, x), with a row for each place of each vector.
    The rows of a symmetric matrix are its columns, so a square is the dot products of its rows.
    """
    parts = [f"""
        long AS MATERIALIZED (
            SELECT vec_id, i, x - avg(x) OVER (PARTITION BY i) AS x FROM ({values})),
        centred AS MATERIALIZED (SELECT vec_id, list(x ORDER BY i) AS x FROM long GROUP BY vec_id),
        c1 AS MATERIALIZED (
            SELECT list(r ORDER BY i) AS m FROM (
                SELECT i, list(c ORDER BY j) AS r FROM (
                    SELECT a.i AS i, b.i AS j, sum(a.x * b.x) AS c FROM long a JOIN long b USING (vec_id) GROUP BY a.i, b.i)
                GROUP BY i))"""]
    for c in (1, 2):
        trace = f"list_sum(list_transform(range({dimension}), lambda i: m[i + 1][i + 1]))"
        parts.append(f"s{c}_0 AS MATERIALIZED (SELECT list_transform(m, lambda r: list_transform(r, lambda x: x / {trace})) AS m FROM c{c})")
        for k in range(squarings):
            parts.append(
                f"q{c}_{k} AS MATERIALIZED (SELECT list_transform(m, lambda r: list_transform(m, lambda q: list_dot_product(r, q))) AS m FROM s{c}_{k}),"
                f"s{c}_{k + 1} AS MATERIALIZED (SELECT list_transform(m, lambda r: list_transform(r, lambda x: x / {trace})) AS m FROM q{c}_{k})"
            )
        # the longest row of what is left, at length one, its largest loading positive
        parts.append(f"""
            r{c} AS MATERIALIZED (SELECT r FROM (SELECT unnest(m) AS r FROM s{c}_{squarings}) ORDER BY list_dot_product(r, r) DESC LIMIT 1),
            l{c} AS MATERIALIZED (
                SELECT list_transform(r, lambda x: x / sqrt(list_dot_product(r, r))
                    * sign(r[list_position(list_transform(r, lambda y: abs(y)), list_max(list_transform(r, lambda y: abs(y))))])) AS v FROM r{c})""")
        if c == 1:
            parts.append(f"""
            e1 AS MATERIALIZED (SELECT m, v, list_dot_product(v, list_transform(m, lambda r: list_dot_product(r, v))) AS size FROM c1, l1),
            c2 AS MATERIALIZED (
                SELECT list_transform(range({dimension}), lambda i: list_transform(range({dimension}), lambda j: m[i + 1][j + 1] - size * v[i + 1] * v[j + 1])) AS m
                FROM e1)""")
    scores = f"{_r('list_dot_product(x, l1.v)', 'pc1')}, {_r('list_dot_product(x, l2.v)', 'pc2')}"
    return _sql(needs, ("" if needs else "WITH " + ",".join(parts)) + f" SELECT vec_id AS {key}, {scores} FROM centred, l1, l2", ",".join(parts) if needs else "")


ORACLES: dict[str, str] = {
    # sources and sinks
    "corpus_scan": _sql(("lines",), "SELECT doc_id, line_no, line FROM lines"),
    "freq_source": _sql(("ranked",), "SELECT rank, freq, lemma_pos FROM ranked"),
    "vs_source": _sql(("cells",), f"SELECT {_CELL}, n FROM cells"),
    "ppmi_source": _sql(("ppmi",), f"SELECT {_CELL}, {_r('ppmi')} FROM ppmi"),
    "scale_source": _sql(("means",), f"SELECT 'category' || category AS category, {_big('basis_index')}, {_r('mean')} FROM means"),
    "ratings_source": _sql(("ratings",), "SELECT word1, word2, human FROM ratings"),
    "xml_scan": _sql(("lines", "tokens"), f"""
        SELECT {_XML} AS xml FROM lines LEFT JOIN (
            SELECT doc_id, line_no, {_XML_BODY} AS body FROM tokens GROUP BY doc_id, line_no) USING (doc_id, line_no)"""),
    "group_scan": _sql(("grouped",), "SELECT construction, sentence FROM grouped"),
    "group_folders": _sql(("grouped",), "SELECT construction, sentence FROM grouped"),
    "sink_roundtrip": _sql(("targets",), f"SELECT {_big('voc_index')}, lemma_pos FROM targets"),
    # tokens of XML and of lines
    "xml_tokens": _sql(("joined", "tokens"), """
        SELECT doc_id, line_no, pos AS i, 'word' AS kind, tag AS pos, w AS lemma, w || ' ' AS text, pos % 50 = 49 AS truncated FROM tokens
        UNION ALL SELECT doc_id, line_no, n, 'punctuation', NULL, NULL, '.', false FROM joined"""),
    "token_filter": _sql(("tokens",), f"""
        SELECT doc_id, line_no, row_number() OVER (PARTITION BY doc_id, line_no ORDER BY pos) - 1 AS i, w AS lemma, tag AS pos
        FROM tokens WHERE {_KEPT}"""),
    "token_render": _sql(("joined",), "SELECT doc_id, line_no, replace(CASE WHEN n > 0 THEN tagged || ' ' ELSE '' END, ' ', '|') || '._PUNC' AS forms FROM joined"),
    "sentence_assemble": _sql(("tokens",), f"""
        SELECT doc_id, line_no, string_agg(lemma_pos, ' ' ORDER BY pos) || ' ' AS value FROM tokens WHERE {_KEPT} GROUP BY doc_id, line_no"""),
    "line_tokens": _sql(("joined", "tokens"), """
        SELECT doc_id, line_no, pos, lemma_pos FROM tokens UNION ALL SELECT doc_id, line_no, 0, '' FROM joined WHERE n = 0"""),
    "min_length": _sql(("joined",), f"SELECT doc_id, line_no, n AS n_tokens FROM joined WHERE n > {MIN_LENGTH}"),
    "pos_map": _sql(("tokens",), """
        SELECT DISTINCT lemma_pos, w || '_' || CASE tag WHEN 'ADJ' THEN 'JJ' WHEN 'SUBST' THEN 'NN' WHEN 'VERB' THEN 'VB' WHEN 'ADV' THEN 'RB' END AS short_pos
        FROM tokens"""),
    "lemma_of": _sql(("tokens",), "SELECT DISTINCT lemma_pos, w AS lemma FROM tokens"),
    "repair_anon": _sql(("lines", "tokens"), """
        SELECT doc_id, line_no, coalesce(words, '') AS words FROM lines LEFT JOIN (
            SELECT doc_id, line_no, string_agg(CASE WHEN number AND nth = 1 THEN '--anonx' || w WHEN number THEN '-- AnonX' || w ELSE w END, ' ' ORDER BY pos) AS words
            FROM (SELECT *, regexp_matches(w, '^[0-9]') AS number,
                         sum(CASE WHEN regexp_matches(w, '^[0-9]') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, line_no ORDER BY pos) AS nth FROM tokens)
            GROUP BY doc_id, line_no) USING (doc_id, line_no)"""),
    "anon_numerals_corpus": _sql(("lines", "tokens", "lexicon"), f"""
        SELECT doc_id, line_no, coalesce(value, '') AS value FROM lines LEFT JOIN (
            SELECT doc_id, line_no, string_agg(CASE WHEN {_IS_NUMBER} THEN '--anonnumeral_' || tag ELSE lemma_pos END, ' ' ORDER BY pos) AS value
            FROM tokens GROUP BY doc_id, line_no) USING (doc_id, line_no)"""),
    "unique_tokens": _sql(("tokens",), "SELECT DISTINCT lemma_pos AS token FROM tokens"),
    "group_key_parse": _sql(("seen",), "SELECT construction, verb, nominal, kind FROM seen"),
    # frequencies and vocabulary
    "token_freq": _sql(("freqs",), "SELECT lemma_pos, freq FROM freqs"),
    "freq_rank": _sql(("ranked",), "SELECT rank, freq, lemma_pos FROM ranked"),
    "freq_fold_numerals": _sql(("freqs", "lexicon"), """
        SELECT rank() OVER (ORDER BY freq DESC, lemma_pos DESC) AS rank, freq, lemma_pos FROM (
            SELECT sum(freq)::BIGINT AS freq, CASE WHEN split_part(lemma_pos, '_', 1) IN (SELECT lemma FROM lexicon)
                   THEN '--anonnumeral_' || split_part(lemma_pos, '_', 2) ELSE lemma_pos END AS lemma_pos FROM freqs GROUP BY 2)"""),
    "basis_select": _sql(("basis",), f"SELECT {_big('basis_index')}, lemma_pos FROM basis"),
    "target_words": _sql(("targets",), f"SELECT {_big('voc_index')}, lemma_pos FROM targets"),
    "vocab_join": _sql(("tokens", "targets"), f"SELECT doc_id, line_no, pos, lemma_pos, {_big('voc_index')} FROM tokens JOIN targets USING (lemma_pos)"),
    # counts, weights, vectors
    "cooccurrence": _sql(("cells",), f"SELECT {_CELL}, n FROM cells"),
    "count_vectors": _sql(("targets", "cells"), f"""
        SELECT {_big('voc_index')}, lemma_pos, coalesce(vector, '') AS vector FROM targets LEFT JOIN (
            SELECT lemma_pos, string_agg(basis_index || ':' || n, ' ' ORDER BY basis_index) AS vector FROM cells GROUP BY lemma_pos) USING (lemma_pos)"""),
    "vector_sum": _sql(("cells",), f"SELECT {_CELL}, n FROM cells"),
    "marginals": _sql(("cells",), """
        SELECT lemma_pos, basis_index::BIGINT AS basis_index, sum(n)::BIGINT AS total FROM cells
        GROUP BY GROUPING SETS ((lemma_pos), (basis_index), ())"""),
    "ppmi": _sql(("ppmi",), f"SELECT {_CELL}, {_r('ppmi')} FROM ppmi"),
    "vector_pivot": _sql(("ppmi",), f"SELECT {_CELL}, {_r('ppmi')} FROM ppmi"),
    "vector_lookup": _sql(("ppmi", "nouns"), f"SELECT {_CELL}, {_r('ppmi')} FROM ppmi WHERE lemma_pos IN (SELECT lemma_pos FROM nouns)"),
    "dim_subset": _sql(("ppmi", "basis"), f"""
        SELECT lemma_pos, new_index::BIGINT AS basis_index, {_r('ppmi')} FROM ppmi JOIN (
            SELECT basis_index, rank() OVER (ORDER BY basis_index DESC) - 1 AS new_index FROM basis WHERE lemma_pos LIKE '%\\_SUBST' ESCAPE '\\')
        USING (basis_index)"""),
    # similarity and validation
    "cosine_pairs": _sql(("dense",), f"SELECT id1, id2, {_r('list_inner_product(a, b) / greatest(sqrt(list_inner_product(a, a)) * sqrt(list_inner_product(b, b)), 1e-8)', 'cosine')} FROM dense"),
    "euclid_pairs": _sql(("dense",), f"SELECT id1, id2, {_r('list_distance(a, b)', 'euclidean')} FROM dense"),
    "dot_pairs": _sql(("dense",), f"SELECT id1, id2, {_r('list_inner_product(a, b)', 'dot')} FROM dense"),
    "ratings_normalise": _sql(("ratings",), """
        SELECT lower(split_part(word1, '_', 1)) || '_' || tag AS word1, lower(split_part(word2, '_', 1)) || '_' || tag AS word2, human, form
        FROM (SELECT word1, word2, human, form, CASE form WHEN 'NN' THEN 'SUBST' WHEN 'VB' THEN 'VERB' ELSE
                     CASE WHEN human < 20 THEN 'SUBST' WHEN human < 40 THEN 'ADJ' ELSE 'VERB' END END AS tag
              FROM ratings CROSS JOIN (SELECT unnest(['NN', 'VB', 'pos-column', 'suffix']) AS form))"""),
    "pair_scores": _sql(("measured",), f"SELECT word1, word2, human, {_r('cosine')}, {_r('euclidean')}, {_r('dot')} FROM measured"),
    "spearman": _sql(("rho",), f"SELECT measure, n, {_r('rho')} FROM rho"),
    "spearman_p": _sql(("rho",), f"""
        SELECT measure, {_r(_t_two_sided_sql('t', 'df'), 'p_value')}
        FROM (SELECT measure, (n - 2)::DOUBLE AS df, rho * sqrt((n - 2) / (1 - rho * rho)) AS t FROM rho)"""),
    "coverage": _sql(("ratings", "targets"), """
        SELECT count(*) AS pairs, count(*) FILTER (k1 AND k2) AS pairs_scored,
               round(count(*) FILTER (k1 AND k2) / count(*) * 100, 2) AS percent_scored,
               (SELECT count(DISTINCT w) FROM (SELECT unnest([word1, word2]) AS w FROM ratings)
                WHERE w NOT IN (SELECT lemma_pos FROM targets)) AS words_missing
        FROM (SELECT word1 IN (SELECT lemma_pos FROM targets) AS k1, word2 IN (SELECT lemma_pos FROM targets) AS k2 FROM ratings)"""),
    # projection
    "category_mean": _sql(("means",), f"SELECT {_big('category')}, {_big('basis_index')}, {_r('mean')} FROM means"),
    "scale_vector": _sql(("scale",), f"SELECT {_big('basis_index')}, {_r('-weight', 'weight')} FROM scale"),
    "vector_norm": _sql(("ppmi",), f"SELECT lemma_pos, {_r('sqrt(sum(ppmi * ppmi))', 'norm')} FROM ppmi GROUP BY lemma_pos"),
    "scalar_projection": f"""
        WITH long AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings),
        scale AS (SELECT i, avg(x) FILTER (label = 0) - avg(x) FILTER (label = 1) AS s FROM long WHERE label IN (0, 1) GROUP BY i)
        SELECT vec_id, {_r('sum(x * s) / (SELECT sqrt(sum(s * s)) FROM scale)', 'projection')} FROM long JOIN scale USING (i) GROUP BY vec_id""",
    "word_projection": _sql(("projected", "ratings"), f"""
        SELECT lemma_pos, p.projection IS NOT NULL AS found, {_r('p.projection', 'projection')}
        FROM (SELECT DISTINCT unnest([word1, word2]) AS lemma_pos FROM ratings) LEFT JOIN projected p USING (lemma_pos)"""),
    "pair_projection": _sql(("projected", "gap_pairs"), f"""
        SELECT fvc_pos AS fvc, {_r('f.projection', 'fvc_projection')}, lv_pos AS lv, nominal_pos AS lv_noun, {_r('l.projection + n.projection', 'lvc_projection')}
        FROM gap_pairs JOIN projected f ON f.lemma_pos = fvc_pos JOIN projected l ON l.lemma_pos = lv_pos JOIN projected n ON n.lemma_pos = nominal_pos
        WHERE fvc_pos <> lv_pos AND lv_pos <> nominal_pos AND fvc_pos <> nominal_pos"""),
    "missing_words": _sql(("gap_pairs", "targets"), """
        SELECT lemma_pos FROM (SELECT unnest(list_distinct([fvc_pos, lv_pos, nominal_pos])) AS lemma_pos FROM gap_pairs)
        WHERE lemma_pos NOT IN (SELECT lemma_pos FROM targets)"""),
    "sentence_vector": _sql(("lines", "tokens", "targets", "ppmi"), f"""
        SELECT doc_id, line_no, basis_index::BIGINT AS basis_index, {_r('coalesce(x, 0)', 'ppmi')} FROM (
            SELECT l.doc_id, l.line_no FROM lines l LEFT JOIN (
                SELECT doc_id, line_no, bool_and(lemma_pos IN (SELECT lemma_pos FROM targets)) AS fine FROM tokens GROUP BY doc_id, line_no) k
            USING (doc_id, line_no) WHERE coalesce(fine, true)) LEFT JOIN (
            SELECT doc_id, line_no, basis_index, sum(ppmi) AS x FROM tokens JOIN ppmi USING (lemma_pos) GROUP BY doc_id, line_no, basis_index)
        USING (doc_id, line_no)"""),
    "sentence_projection": _sql(("lines", "tokens", "projected"), f"""
        SELECT source, doc_id, line_no, {_r('coalesce(x, 0)', 'projection')} FROM lines LEFT JOIN (
            SELECT doc_id, line_no, bool_and(projection IS NOT NULL) AS fine, -sum(projection) AS x
            FROM tokens LEFT JOIN projected USING (lemma_pos) GROUP BY doc_id, line_no) USING (doc_id, line_no)
        WHERE coalesce(fine, true)"""),
    "pca_2d": _pca_sql("SELECT vec_id, unnest(range(64)) AS i, unnest(embedding::DOUBLE[]) AS x FROM embeddings", 64, "vec_id"),
    "pca_words": _pca_sql(f"""
        SELECT vec_id, i, coalesce(any_value(v), 0) AS x
        FROM (SELECT DISTINCT lemma_pos AS vec_id FROM seeds UNION ALL SELECT DISTINCT 'scale_end_' || category FROM means)
        CROSS JOIN (SELECT unnest(range({DIMENSION})) AS i) LEFT JOIN (
            SELECT lemma_pos AS vec_id, basis_index AS i, ppmi AS v FROM ppmi UNION ALL SELECT 'scale_end_' || category, basis_index, mean FROM means)
        USING (vec_id, i) GROUP BY vec_id, i""", DIMENSION, "word", ("seeds", "ppmi", "means")),
    "scale_endpoints": _sql(("means", "scale"), f"""
        SELECT {_big('category')}, {_r('sum(mean * weight) / (SELECT sqrt(sum(weight * weight)) FROM scale)', 'projection')}
        FROM means JOIN scale USING (basis_index) GROUP BY category"""),
    # constructions
    "obj_construction_match": _sql(("objects",), "SELECT doc_id, line_no, id, lv, nominal FROM objects"),
    "verb_match": _sql(("plain_verbs",), "SELECT doc_id, line_no, id, fvc FROM plain_verbs"),
    "numeral_lexicon": _sql(("lexicon",), "SELECT doc_id, lemma FROM lexicon"),
    "align_renditions": _sql(("joined",), "SELECT doc_id, line_no, tagged, plain FROM joined"),
    "in_vocabulary": _sql(("lines", "tokens", "targets"), """
        SELECT doc_id, line_no FROM lines LEFT JOIN (
            SELECT doc_id, line_no, bool_and(regexp_matches(w, '[0-9]') OR lemma_pos IN (SELECT lemma_pos FROM targets)) AS fine
            FROM tokens GROUP BY doc_id, line_no) USING (doc_id, line_no) WHERE coalesce(fine, true)"""),
    "group_merge": _sql(("groups",), "SELECT construction, kind, count(*) AS n FROM groups GROUP BY construction, kind"),
    "pair_maps": _sql(("pairs",), """
        SELECT 'noun_of_light_verb' AS relation, split_part(lv_pos, '_', 1) AS key, split_part(nominal_pos, '_', 1) AS member FROM pairs
        UNION SELECT 'verb_of_construction', split_part(lv_pos, '_', 1) || '_' || split_part(nominal_pos, '_', 1), fvc_pos FROM pairs
        UNION SELECT 'construction_of_verb', fvc_pos, lv_pos || '_' || nominal_pos FROM pairs"""),
    "corresponding_groups": _sql(("seen", "pairs"), """
        SELECT s.verb AS lv_pos, s.nominal AS nominal_pos, p.fvc_pos,
               p.fvc_pos IS NOT NULL AND p.fvc_pos IN (SELECT verb FROM seen WHERE kind = 'FVC') AS fvc_observed
        FROM seen s LEFT JOIN (SELECT DISTINCT * FROM pairs) p ON p.lv_pos = s.verb AND p.nominal_pos = s.nominal WHERE s.kind = 'LVC'"""),
    "strict_pairs": _sql(("seen", "pairs"), """
        SELECT DISTINCT fvc_pos, lv_pos, nominal_pos FROM pairs
        WHERE EXISTS (SELECT 1 FROM seen WHERE kind = 'LVC' AND verb = lv_pos AND nominal = nominal_pos)
          AND fvc_pos IN (SELECT verb FROM seen WHERE kind = 'FVC')"""),
    "extract_sentences": _sql(("groups", "tokens", "lexicon", "targets"), f"""
        SELECT construction, kind, doc_id, line_no, sentence FROM groups JOIN (
            SELECT doc_id, line_no, string_agg(CASE WHEN {_IS_NUMBER} THEN '--anonnumeral_' || tag ELSE lemma_pos END, ' ' ORDER BY pos) AS sentence,
                   bool_and({_IS_NUMBER} OR lemma_pos IN (SELECT lemma_pos FROM targets)) AS fine
            FROM tokens GROUP BY doc_id, line_no) USING (doc_id, line_no) WHERE fine"""),
    "group_projection": _sql(("group_scores",), f"SELECT construction, kind, doc_id, line_no, {_r('x', 'projection')} FROM group_scores"),
    "score_table": _sql(("group_scores", "seen", "pairs"), f"""
        SELECT * FROM (WITH verbs AS (
            SELECT fvc_pos, lead(fvc_pos) OVER (ORDER BY fvc_pos) AS other FROM (SELECT DISTINCT fvc_pos FROM pairs)),
        listed AS (
            SELECT lv_pos, nominal_pos, fvc_pos FROM pairs
            UNION SELECT lv_pos, nominal_pos, other FROM pairs JOIN verbs USING (fvc_pos) WHERE other IS NOT NULL),
        roles AS (
            SELECT DISTINCT lv_pos || '_' || nominal_pos AS lvc, lv_pos || '_' || nominal_pos || '_' || fvc_pos AS pair, fvc_pos FROM listed
            JOIN seen s ON s.kind = 'LVC' AND s.verb = lv_pos AND s.nominal = nominal_pos
            WHERE fvc_pos IN (SELECT verb FROM seen WHERE kind = 'FVC'))
        SELECT DISTINCT pair, kind, doc_id, line_no, {_r('x', 'projection')} FROM roles JOIN group_scores g
        ON (g.kind = 'LVC' AND g.construction = lvc) OR (g.kind = 'FVC' AND g.construction = fvc_pos))"""),
    "clean_groups": _sql(("grouped",), f"""
        SELECT DISTINCT construction, sentence FROM ({_STRAY}) WHERE
            contains(' ' || sentence || ' ', ' ' || split_part(construction, '_', 1) || '_' || split_part(construction, '_', 2) || ' ')
            AND (split_part(construction, '_', 3) = '' OR
                 contains(' ' || sentence || ' ', ' ' || split_part(construction, '_', 3) || '_' || split_part(construction, '_', 4) || ' '))"""),
    "clean_groups_compat": _sql(("grouped",), f"""
        SELECT DISTINCT construction, sentence FROM ({_STRAY}) WHERE
            contains(sentence, split_part(construction, '_', 1) || '_' || split_part(construction, '_', 2))
            AND (split_part(construction, '_', 3) = '' OR
                 contains(sentence, split_part(construction, '_', 3) || '_' || split_part(construction, '_', 4)))"""),
    "unprocessed_anti": """
        SELECT DISTINCT 'corpus/' || doc_id || '.txt' AS path FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""",
    # grouped statistics
    "sentence_length": _sql(("joined",), "SELECT doc_id, line_no, n AS length FROM joined"),
    "length_summary": _sql(("grouped", "joined"), f"""
        SELECT CASE WHEN grouping(construction) = 0 THEN 'construction' WHEN grouping(kind) = 0 THEN 'kind' ELSE 'all' END AS level,
               construction, kind, count(*) AS n, {_r('min(len)::DOUBLE', 'min')}, {_r('quantile_cont(len::DOUBLE, 0.25)', 'q1')},
               {_r('quantile_cont(len::DOUBLE, 0.5)', 'median')}, {_r('avg(len)', 'mean')},
               {_r('CASE WHEN count(*) > 1 THEN stddev_samp(len) END', 'sd')}, {_r('quantile_cont(len::DOUBLE, 0.75)', 'q3')}, {_r('max(len)::DOUBLE', 'max')}
        FROM (SELECT construction, kind, n AS len FROM groups JOIN joined USING (doc_id, line_no))
        GROUP BY GROUPING SETS ((construction, kind), (kind), ())"""),
    "column_summary": f"""
        SELECT variable, count(x) AS n, {_r('min(x)', 'min')}, {_r('quantile_cont(x, 0.25)', 'q1')}, {_r('quantile_cont(x, 0.5)', 'median')},
               {_r('avg(x)', 'mean')}, {_r('quantile_cont(x, 0.75)', 'q3')}, {_r('max(x)', 'max')}
        FROM (SELECT 'l_quantity' AS variable, l_quantity AS x FROM lineitem UNION ALL SELECT 'l_extendedprice', l_extendedprice FROM lineitem
              UNION ALL SELECT 'l_discount', l_discount FROM lineitem UNION ALL SELECT 'l_tax', l_tax FROM lineitem) GROUP BY variable""",
    "iqr_outliers": _sql(("flagged",), "SELECT pair, kind, row, score, is_extreme FROM flagged WHERE is_outlier"),
    "outlier_removal": _sql(("flagged", "modes"), """
        SELECT pair, kind, row, score, mode FROM flagged CROSS JOIN modes
        WHERE mode = 'none' OR (mode = 'extreme' AND NOT is_extreme) OR (mode = 'all' AND NOT is_outlier)"""),
    "pair_notes": _sql(("flagged", "modes"), """
        SELECT pair, CASE WHEN fvc_n < 2 OR lvc_n < 2 THEN 'insufficient observations'
                          WHEN mode = 'extreme' AND ex THEN 'EXTREME OUTLIERS REMOVED' WHEN mode = 'extreme' THEN ''
                          WHEN ex THEN 'EXTREME OUTLIERS PRESENT' WHEN mode = 'all' THEN 'ALL OUTLIERS REMOVED' ELSE '' END AS note, fvc_n, lvc_n, mode
        FROM (SELECT pair, mode, bool_or(is_extreme) AS ex,
                     count(*) FILTER (kind = 'FVC' AND NOT (mode = 'extreme' AND is_extreme) AND NOT (mode = 'all' AND is_outlier)) AS fvc_n,
                     count(*) FILTER (kind = 'LVC' AND NOT (mode = 'extreme' AND is_extreme) AND NOT (mode = 'all' AND is_outlier)) AS lvc_n
              FROM flagged CROSS JOIN modes GROUP BY pair, mode)"""),
    "brunner_munzel": _interval_sql("bm_p", "df", f"""pair, {_r('statistic')}, {_r('df')}, {_r('p_greater')}, {_r('p_two_sided')},
        {_r('relative_effect')}, {_r('relative_effect - t_q * se', 'ci_lower')}, {_r('relative_effect + t_q * se', 'ci_upper')},
        nx::BIGINT AS fvc_n, ny::BIGINT AS lvc_n"""),
    "bm_permutation": _sql(("scores", "bm"), f"""
        SELECT pair, {_r('statistic')}, {_r('share', 'p_greater')}, {_r('relative_effect')}, {_r('relative_effect - high * se', 'ci_lower')},
               {_r('relative_effect - low * se', 'ci_upper')}, nx::BIGINT AS fvc_n, ny::BIGINT AS lvc_n FROM bm JOIN psum USING (pair)""", _PERMUTED),
    "p_bonferroni": _sql(("tests",), f"SELECT pair, family, {_r('p_value')}, {_r('least(1, p_value * count(*) OVER ())', 'p_bonferroni')} FROM tests"),
    "p_bh": _sql(("tests",), f"""
        SELECT pair, family, {_r('p_value')}, {_r('p_bh_all')}, {_r('p_bh')} FROM (
            {_bh('(SELECT * EXCLUDE (n_tests, rk) FROM (' + _bh('tests', 'p_value', "'all'", 'p_bh_all') + '))', 'p_value', 'family', 'p_bh')})"""),
    "wide_to_long": _sql(("paired",), f"""
        SELECT row_id, construction, {_r('projection')} FROM (
            SELECT row_id, unnest(['fvc', 'lvc']) AS construction, unnest([fvc, lvc]) AS projection
            FROM (SELECT *, row_number() OVER (ORDER BY id) - 1 AS row_id FROM paired))"""),
    "paired_diff": _sql(("paired",), f"""
        SELECT id, {_r('d', 'difference')}, d < q1 - 1.5 * (q3 - q1) OR d > q3 + 1.5 * (q3 - q1) AS is_outlier,
               d < q1 - 3 * (q3 - q1) OR d > q3 + 3 * (q3 - q1) AS is_extreme
        FROM (SELECT id, fvc - lvc AS d FROM paired)
        CROSS JOIN (SELECT quantile_cont(fvc - lvc, 0.25) AS q1, quantile_cont(fvc - lvc, 0.75) AS q3 FROM paired)"""),
    "shapiro_wilk": _sql(("paired",), f"""
        SELECT n, {_r('w')}, {_r(f"CASE WHEN z >= 0 THEN 0.5 - half ELSE 0.5 + half END", 'p_value')}, n <= 5000 AS calibrated
        FROM (SELECT *, {_simpson_sql('0', 'least(abs(z), 12)', lambda at: f"exp(-{at} * {at} / 2)")} / sqrt(2 * pi()) AS half FROM z)""", _SHAPIRO),
    "paired_t": _interval_sql("paired_stats", "df", f"""n, {_r('m', 'mean_difference')}, {_r('t')}, {_r('df')},
        {_r(_t_two_sided_sql('t', 'df'), 'p_two_sided')}, {_r(_t_upper_sql('t', _t_two_sided_sql('t', 'df')), 'p_greater')},
        {_r('m - t_q * sd / sqrt(n)', 'ci_lower')}, {_r('m + t_q * sd / sqrt(n)', 'ci_upper')}"""),
    "cohen_d_paired": _sql(("paired_stats",), f"SELECT n, {_r('m / (sd / sqrt(2 * (1 - r)))', 'cohen_d')} FROM paired_stats"),
}
