"""SQL twins of the queries that SQL can express."""

from __future__ import annotations

import math

from earmark.llm import quality

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

REPEATS = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {WORDS} AS w FROM documents),
starts AS (SELECT rid, doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d),
windows AS (SELECT rid, doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM starts),
lost AS (SELECT rid, i FROM (SELECT rid, doc_id, i, min(doc_id) OVER (PARTITION BY h) AS low FROM windows) WHERE low < doc_id),
gone AS (SELECT DISTINCT rid, unnest(range(i, i + 50)) AS j FROM lost),
words AS (SELECT rid, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS j FROM d),
kept AS (SELECT rid, string_agg(word, ' ' ORDER BY j) AS t, count(*) AS n FROM words ANTI JOIN gone USING (rid, j) GROUP BY rid)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, (len(d.w) - coalesce(k.n, 0))::BIGINT AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256
FROM d LEFT JOIN kept k USING (rid)
"""


def _quality() -> str:
    low = math.floor(math.log(quality.SMALLEST) / math.log(quality.RATIO))
    ratio, step = f"{quality.RATIO}::DOUBLE", repr(math.log(quality.RATIO))
    value = lambda b: f"CASE WHEN {b} <= {low} THEN 0.0::DOUBLE ELSE 2 * pow({ratio}, {b}) / ({ratio} + 1) END"
    rates = [m for m, n in quality.METRICS.items() if n]
    at = lambda q: value(f"b[ceil(n * {q}::DOUBLE)::BIGINT]")
    usual = f"CASE WHEN z < n THEN (n - z) / n::DOUBLE * {value('b[z + ceil((n - z) * 0.5::DOUBLE)::BIGINT]')} ELSE 0.0::DOUBLE END"
    level = lambda by: (
        f"SELECT *, CASE WHEN metric IN ({', '.join(map(repr, rates))}) THEN usual ELSE q3 END AS place, greatest(q3 - q1, q3 * {quality.RATIO - 1!r}::DOUBLE) AS spread FROM ("
        f"SELECT {by}metric, n, {at(0.25)} AS q1, {at(0.75)} AS q3, {usual} AS usual FROM ("
        f"SELECT {by}metric, count(*) AS n, count(*) FILTER (bucket <= {low}) AS z, list_sort(list(bucket)) AS b FROM sketch GROUP BY {by}metric))"
    )
    m = quality.SMOOTHING
    smooth = lambda inner, outer, c: f"({inner}.n * {inner}.{c} + {m} * {outer}) / ({inner}.n + {m})"
    both = ", ".join(f"{smooth('o', smooth('l', f'a.{c}', c), c)} AS {c}" for c in ("place", "spread"))
    spreads, errors = f"{quality.SPREADS}::DOUBLE", f"{quality.ERRORS}::DOUBLE"
    pivot = ", ".join(
        f"max(CASE WHEN metric = '{m}' THEN {'place' if n else f'place + {spreads} * spread'} END) AS {m}_{'usual' if n else 'limit'}" for m, n in quality.METRICS.items()
    )
    error = lambda m, n: f"CASE WHEN c.{n} > 0 THEN {m}_usual + {errors} * sqrt({m}_usual / c.{n}) + {errors} * {errors} / c.{n} END"
    bound = {m: error(m, n) if n else f"{m}_limit" for m, n in quality.METRICS.items()}
    within = " AND ".join(f"coalesce({m} <= {b}, true)" for m, b in bound.items())
    shown = ", ".join(f"round({b}, 6) AS {m}_limit" for m, b in bound.items())
    return rf"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS text, {WORDS} AS w FROM documents),
starts AS (SELECT rid, w, unnest(range(1, len(w) - 3)) AS i FROM t),
windows AS (SELECT rid, i, array_to_string(w[i:i + 4], ' ') AS h FROM starts),
twice AS (SELECT rid, i FROM windows QUALIFY count(*) OVER (PARTITION BY rid, h) > 1),
repeated AS (SELECT rid, count(DISTINCT j) AS n_repeat FROM (SELECT rid, unnest(range(i, i + 5)) AS j FROM twice) GROUP BY rid),
lines AS (SELECT rid, [x FOR x IN string_split(text, chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS l FROM t),
counts AS (
  SELECT t.*, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(l) AS n_lines,
    len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n_repeat, 0) AS n_repeat_words
  FROM t JOIN lines USING (rid) LEFT JOIN repeated USING (rid)),
metrics AS (
  SELECT *, n_symbols / n_words::DOUBLE AS symbol_rate, CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines::DOUBLE END AS dup_line_share,
    word_chars / n_words::DOUBLE AS word_length FROM counts WHERE n_words > 0),
long AS (UNPIVOT (SELECT lang, source, symbol_rate, dup_line_share, word_length FROM metrics) ON symbol_rate, dup_line_share, word_length INTO NAME metric VALUE v),
sketch AS (SELECT lang, source, metric, CASE WHEN v <= {quality.SMALLEST}::DOUBLE THEN {low} ELSE ceil(ln(v) / {step}::DOUBLE)::INT END AS bucket FROM long),
own AS ({level('lang, source, ')}), of_lang AS ({level('lang, ')}), of_all AS ({level('')}),
chosen AS (
  SELECT o.lang, o.source, o.metric, {both}
  FROM own o JOIN of_lang l ON o.lang IS NOT DISTINCT FROM l.lang AND o.metric = l.metric JOIN of_all a ON o.metric = a.metric),
limits AS (SELECT lang, source, {pivot} FROM chosen GROUP BY lang, source),
judged AS (
  SELECT c.doc_id, c.n_words, c.word_chars, c.n_symbols, c.n_dup_lines, c.n_repeat_words,
    c.n_words < {quality.MIN_WORDS} OR 100 * c.n_repeat_words > {quality.MAX_REPEATED} * c.n_words AS base_failed, {within} AS passed, {shown}
  FROM counts c LEFT JOIN metrics m USING (rid)
  LEFT JOIN limits b ON c.lang IS NOT DISTINCT FROM b.lang AND c.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, base_failed, NOT base_failed AND passed AS kept, {', '.join(f'{m}_limit' for m in quality.METRICS)}
FROM judged
"""


QUALITY = _quality()

COLLOCATIONS = r"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
pieces AS (SELECT lang, regexp_extract_all(unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w FROM t),
runs AS (SELECT lang, w, unnest(range(1, 6)) AS k FROM pieces WHERE len(w) > 0),
grams AS (SELECT lang, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM runs WHERE k <= len(w)),
f AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS p, count(*) AS f FROM grams GROUP BY ALL),
sums AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, p, f AS a, string_split(p, ' ') AS w FROM f WHERE k > 1 AND f >= 100),
inner_ AS (
  SELECT DISTINCT lang, array_to_string(w[i:i + m - 1], ' ') AS p, a
  FROM (SELECT lang, w, a, m, unnest(range(1, k - m + 2)) AS i FROM (SELECT lang, k, w, a, unnest(range(2, k)) AS m FROM c))),
cuts AS (
  SELECT c.*, j, array_to_string(w[1:j], ' ') AS lp, array_to_string(w[j + 1:], ' ') AS rp
  FROM (SELECT c.*, unnest(range(1, k)) AS j FROM c ANTI JOIN inner_ USING (lang, p, a)) c),
scored AS (
  SELECT c.lang, c.p, c.a, c.j, l.f AS l, r.f AS r, s.n, (1000::HUGEINT * c.a * s.n // (l.f::HUGEINT * r.f))::BIGINT AS score
  FROM cuts c JOIN sums s USING (lang)
  JOIN f l ON l.lang = c.lang AND l.k = c.j AND l.p = c.lp JOIN f r ON r.lang = c.lang AND r.k = c.k - c.j AND r.p = c.rp),
low AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, j) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, p) AS rank, p AS phrase, a, l, r, n, score
FROM low QUALIFY rank <= 2000
"""
