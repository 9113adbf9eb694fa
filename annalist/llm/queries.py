"""The registered queries of the training-data operators and the SQL that checks those that SQL can express."""

from __future__ import annotations

from annalist.llm.clusters import op13_clusters
from annalist.llm.html import op6_html
from annalist.llm.jaccard import op5_jaccard
from annalist.llm.langid import op3_language
from annalist.llm.mixing import op7_mixing
from annalist.llm.negatives import op12_negatives
from annalist.llm.neighbours import op9_neighbours
from annalist.llm.packing import op10_packing
from annalist.llm.pii import op4_pii
from annalist.llm.quality import op2_quality
from annalist.llm.scoring import op1_scoring
from annalist.llm.secrets import op8_secrets
from annalist.llm.toxicity import op11_toxicity

QUERIES = {
    f.__name__: f
    for f in (op1_scoring, op2_quality, op3_language, op4_pii, op5_jaccard, op6_html, op7_mixing, op8_secrets, op9_neighbours, op10_packing, op11_toxicity, op12_negatives, op13_clusters)
}

_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"


def quality_sql() -> str:
    names = "symbol_rate, dup_line_rate, repeat_rate, word_length, letter_rate"

    def quartiles(name: str, keys: str) -> str:
        sep = ", " if keys else ""
        return f"""{name}_c AS (SELECT {keys}{sep}metric, bin, count(*) AS n FROM long GROUP BY ALL),
        {name}_w AS (SELECT *, sum(n) OVER (PARTITION BY {keys}{sep}metric) AS total, sum(n) OVER (PARTITION BY {keys}{sep}metric ORDER BY bin) AS up_to FROM {name}_c),
        {name} AS (SELECT {keys}{sep}metric, min(bin) FILTER (up_to * 4 >= total) AS q1, min(bin) FILTER (up_to * 4 >= total * 2) AS q2, min(bin) FILTER (up_to * 4 >= total * 3) AS q3, max(total) AS total FROM {name}_w GROUP BY ALL)"""

    def rate(name: str, part: str, whole: str, times: int = 1000) -> str:
        return f"CAST(CASE WHEN {whole} > 0 THEN least(1999, floor({times} * {part} / {whole})) ELSE 0 END AS INTEGER) AS {name}"

    def used(q: str) -> str:
        return f"CASE WHEN own.total >= 100 THEN own.{q} WHEN by_lang.total >= 100 THEN by_lang.{q} ELSE of_all.{q} END AS {q}"

    words = _WORDS.format("coalesce(text, '')")
    return rf"""
    WITH t AS (SELECT row_number() OVER () AS k, doc_id, lang, source, coalesce(text, '') AS text, {words} AS w FROM documents),
    lines AS (SELECT k, line, count(*) AS n FROM (SELECT k, unnest(string_split(text, chr(10))) AS line FROM t) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY ALL),
    line_counts AS (SELECT k, sum(n) AS n_lines, sum(n - 1) AS n_dup_lines FROM lines GROUP BY k),
    windows AS (SELECT k, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s FROM (SELECT k, w, unnest(range(1, len(w) - 1)) AS i FROM t WHERE len(w) >= 3)),
    again AS (SELECT k, i FROM windows QUALIFY count(*) OVER (PARTITION BY k, s) > 1),
    repeated AS (SELECT k, count(DISTINCT p) AS n FROM (SELECT k, unnest([i, i + 1, i + 2]) AS p FROM again) GROUP BY k),
    m AS (SELECT t.k, doc_id, lang, source, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS word_chars,
        len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(repeated.n, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines,
        length(regexp_replace(text, '\P{{L}}+', '', 'g')) AS n_letters
        FROM t LEFT JOIN line_counts USING (k) LEFT JOIN repeated USING (k)),
    r AS (SELECT *, {rate("symbol_rate", "n_symbols", "n_words")}, {rate("dup_line_rate", "n_dup_lines", "n_lines")}, {rate("repeat_rate", "n_repeat_words", "n_words")},
        {rate("word_length", "word_chars", "n_words", 100)}, {rate("letter_rate", "n_letters", "word_chars")}, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM m),
    long AS (SELECT lang, source, metric, bin FROM (UNPIVOT (SELECT lang, source, {names} FROM r WHERE NOT base_failed) ON {names} INTO NAME metric VALUE bin)),
    {quartiles("own", "lang, source")}, {quartiles("by_lang", "lang")}, {quartiles("of_all", "")},
    f AS (SELECT own.lang, own.source, own.metric, {used("q1")}, {used("q2")}, {used("q3")}
        FROM own JOIN by_lang ON own.lang IS NOT DISTINCT FROM by_lang.lang AND own.metric = by_lang.metric JOIN of_all ON own.metric = of_all.metric),
    fenced AS (SELECT lang, source,
        max(q3 + 12 * greatest(q3 - q2, 1)) FILTER (metric = 'word_length') AS longest, max(q1 - 12 * greatest(q2 - q1, 1)) FILTER (metric = 'word_length') AS shortest,
        max(q1 - 12 * greatest(q2 - q1, 1)) FILTER (metric = 'letter_rate') AS letters, max(greatest(20, q3 + 12 * greatest(q3 - q2, 1))) FILTER (metric = 'symbol_rate') AS symbols,
        max(greatest(400, q3 + 12 * greatest(q3 - q2, 1))) FILTER (metric = 'dup_line_rate') AS dup_lines, max(greatest(400, q3 + 12 * greatest(q3 - q2, 1))) FILTER (metric = 'repeat_rate') AS repeats
        FROM f GROUP BY ALL)
    SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
        CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
        (NOT base_failed AND coalesce(word_length BETWEEN shortest AND longest AND dup_line_rate <= dup_lines AND repeat_rate <= repeats AND (letter_rate >= letters OR symbol_rate <= symbols), false)) AS kept
    FROM r LEFT JOIN fenced ON r.lang IS NOT DISTINCT FROM fenced.lang AND r.source IS NOT DISTINCT FROM fenced.source
    """


def jaccard_sql(words: int = 3, percent: int = 90) -> str:
    lowered = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    run = " || ' ' || ".join(f"w[i + {j}]" for j in range(words))
    return rf"""
    WITH RECURSIVE t AS (SELECT doc_id, {_WORDS.format(lowered)} AS w FROM documents),
    s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {words} THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - {words - 2}), lambda i: {run}) END) AS sh FROM t),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b USING (sh) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
    e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= {percent} * (x.n + y.n - i)),
    r(doc_id, c) AS (SELECT doc_id, doc_id FROM t UNION SELECT e.b, r.c FROM r JOIN e ON r.doc_id = e.a WHERE r.c < e.b)
    SELECT t.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id
    FROM t LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id) c USING (doc_id)
    """


_FINITE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0"
_WHOLE = "list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT))"


def negatives_sql(every: int = 100, positives: int = 5, negatives: int = 5, low: int = 80) -> str:
    return f"""
    WITH v AS MATERIALIZED (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, {_WHOLE} AS x
        FROM embeddings WHERE label IS NOT NULL AND {_FINITE}),
    s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, v.vec_id, v.label = a.label AS same, CAST(list_sum(list_transform(list_zip(a.x, v.x), lambda p: p[1] * p[2])) AS BIGINT) AS score
        FROM v AS a JOIN v ON a.vec_id <> v.vec_id WHERE a.vec_id % {every} = 0),
    p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {positives})
    SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
    FROM p JOIN s USING (anchor_id) WHERE NOT same AND {low} * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
    QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) <= {negatives}
    """


def clusters_sql(clusters: int = 40, rounds: int = 5, dimensions: int = 64, seed: int = 2) -> str:
    """Centroids as rows (k, i, c); each round assigns by the whole distance table and takes exact floored means."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""l{r} AS MATERIALIZED (SELECT k, list(c ORDER BY i) AS c FROM c{r} GROUP BY k),
        a{r} AS MATERIALIZED (SELECT n, vec_id, x, k, d FROM (SELECT n, vec_id, x, k, list_sum(list_transform(list_zip(x, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM v, l{r}) QUALIFY row_number() OVER (PARTITION BY n ORDER BY d, k) = 1)""")
        if r < rounds:
            steps.append(f"""m{r} AS (SELECT k, i, sum(e) AS s, count(*) AS m FROM (SELECT k, unnest(x) AS e, unnest(range(1, {dimensions + 1})) AS i FROM a{r}) GROUP BY ALL),
        c{r + 1} AS MATERIALIZED (SELECT k, i, coalesce(CAST((s - ((s % m) + m) % m) // m AS BIGINT), c) AS c FROM c{r} LEFT JOIN m{r} USING (k, i))""")
    return f"""
    WITH v AS MATERIALIZED (SELECT row_number() OVER () AS n, vec_id, {_WHOLE} AS x FROM embeddings WHERE len(embedding) = {dimensions} AND {_FINITE}),
    f AS (SELECT x, row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), x) - 1 AS k FROM v QUALIFY k < {clusters}),
    c0 AS MATERIALIZED (SELECT k, unnest(range(1, {dimensions + 1})) AS i, unnest(x) AS c FROM f),
    {", ".join(steps)}
    SELECT vec_id, CAST(k AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
    FROM a{rounds} JOIN l{rounds} USING (k)
    """


ORACLE = {"op2_quality": quality_sql(), "op5_jaccard": jaccard_sql(), "op12_negatives": negatives_sql(), "op13_clusters": clusters_sql()}
