"""DuckDB forms of the queries that SQL can express."""

_WORD = r"[^\x20\x09-\x0D]+"

_RATE = "round(({f} + m_{f} * mu_{f}) / (n + m_{f}), 9)"
_RULES = {
    "few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > word_chars",
    "repeated_lines": "10 * n_dup_lines > 3 * n_lines",
    "word_length": "word_chars < 2 * n_words OR word_chars > 20 * n_words",
}
_MEANS = ", ".join(f"sum({r})::DOUBLE / sum(n) AS mu_{r}" for r in _RULES)
_BETWEEN = ", ".join(
    f"sum(n * (({r}::DOUBLE / n - mu_{r}) ** 2)) / sum(n)"
    f" - any_value(mu_{r} * (1 - mu_{r})) * (count(*) - 1) / sum(n) AS v_{r}" for r in _RULES)
_WEIGHTS = ", ".join(
    f"CASE WHEN v_{r} > 0 THEN least(1e6, greatest(1.0, mu_{r} * (1 - mu_{r}) / v_{r} - 1)) ELSE 1e6 END AS m_{r}"
    for r in _RULES)
_SHRUNK = ", ".join(f"({r} + m_{r} * mu_{r}) / (n + m_{r})" for r in _RULES)

QUALITY = f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, row_number() OVER () AS rid FROM documents),
w AS (SELECT rid, regexp_extract_all(text, '{_WORD}') AS ws FROM d),
win AS (SELECT rid, i, ws[i] || chr(10) || ws[i + 1] || chr(10) || ws[i + 2] AS g
        FROM w, LATERAL unnest(range(1, len(ws) - 1)) AS t(i) WHERE len(ws) >= 3),
twice AS (SELECT rid, i FROM win QUALIFY count(*) OVER (PARTITION BY rid, g) > 1),
covered AS (SELECT rid, count(DISTINCT i + o) AS n_repeat_words
            FROM twice, (SELECT unnest([0, 1, 2]) AS o) GROUP BY rid),
lines AS (SELECT rid, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS ls FROM d),
s AS (SELECT d.doc_id, d.source AS host, len(ws)::BIGINT AS n_words,
             length(array_to_string(ws, ''))::BIGINT AS word_chars,
             len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
             len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
             coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
      FROM d JOIN w USING (rid) JOIN lines USING (rid) LEFT JOIN covered USING (rid)),
h AS (SELECT host, count(*) AS n, {", ".join(f"sum(({c})::INT) AS {r}" for r, c in _RULES.items())} FROM s GROUP BY host),
mu AS (SELECT {_MEANS} FROM h),
v AS (SELECT {_BETWEEN} FROM h, mu),
rate AS (SELECT host, greatest({_SHRUNK}) AS r FROM h, mu, (SELECT {_WEIGHTS} FROM v, mu))
SELECT doc_id, s.host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed, round(r, 9) AS host_rate,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND r <= 0.5 AS kept
FROM s JOIN rate ON s.host IS NOT DISTINCT FROM rate.host
"""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

PHRASES = f"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang,
                  unnest(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[.,;:!?\\x0A-\\x0D]')) AS piece
           FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS ws FROM p),
total AS (SELECT lang, sum(len(ws)) AS n FROM w GROUP BY lang),
pos AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
f AS (SELECT lang, ws[i:i + k - 1] AS ph, count(*) AS f
      FROM pos, (SELECT unnest([1, 2, 3, 4, 5]) AS k) WHERE i + k - 1 <= len(ws) GROUP BY ALL HAVING count(*) >= 100),
cut AS (SELECT f.lang, f.ph, f.f AS a, k, h.f AS l, t.f AS r, total.n AS n,
               ((1000::HUGEINT * f.f::HUGEINT * total.n::HUGEINT) // (h.f::HUGEINT * t.f::HUGEINT))::BIGINT AS score
        FROM f JOIN total USING (lang), (SELECT unnest([1, 2, 3, 4]) AS k), f AS h, f AS t
        WHERE k < len(f.ph) AND h.lang = f.lang AND h.ph = f.ph[1:k] AND t.lang = f.lang AND t.ph = f.ph[k + 1:]),
best AS (SELECT lang, ph, a, l, r, n, score FROM cut QUALIFY row_number() OVER (PARTITION BY lang, ph ORDER BY score, k) = 1),
longer AS (SELECT lang, sub AS ph, max(f) AS f
           FROM (SELECT lang, f, unnest([ph[2:], ph[:len(ph) - 1]]) AS sub FROM f WHERE len(ph) > 2) GROUP BY ALL),
kept AS (SELECT best.lang, array_to_string(best.ph, ' ') AS phrase, a, l, r, n, score FROM best LEFT JOIN longer USING (lang, ph)
         WHERE longer.f IS NULL OR 100 * longer.f < 100 * a)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept) WHERE rank <= 2000
"""

_HOST = f"translate(regexp_extract({{u}}, '(?s)^.*?://([^/?#]*)', 1), '{_UPPER}', '{_LOWER}')"
_PATH = "regexp_extract({u}, '(?s)^.*?://[^/?#]*([^?#]*)', 1)"


def _rule(url: str, found: str) -> str:
    """The longest rule of the five that fits, or its verdict."""
    host, path = _HOST.format(u=url), _PATH.format(u=url)
    rules = [("block", "example.org", "/en/1"), ("block", "example.org", "/es/"), ("allow", "com", "/fr/"), ("block", "com", "/de/"),
             ("allow", "org", "/")]
    whens = " ".join(f"WHEN ({host} = '{h}' OR ends_with({host}, '.{h}')) AND starts_with({path}, '{p}') THEN "
                     f"'{h + p if found == 'rule' else v}'" for v, h, p in rules)
    return f"CASE {whens} END"


#: Links are taken from absolute canonical and refresh URLs only; the operator also resolves relative ones.
URLS = f"""
WITH RECURSIVE u AS (SELECT page_id, coalesce(url, '') AS url, regexp_replace(coalesce(url, ''), '(?s)#.*$', '') AS page, html FROM pages),
link AS (SELECT page AS a, regexp_replace(unnest(
             regexp_extract_all(html, '(?i)<link[^>]*rel=["'']?canonical["'']?[^>]*href=["'']?([^"''\\s>]*://[^"''\\s>]*)', 1)
             || regexp_extract_all(html, '(?i)<meta[^>]*http-equiv=["'']?refresh["'']?[^>]*url=[''"]?([^"''\\s>]*://[^"''\\s>]*)', 1)),
             '(?s)#.*$', '') AS b FROM u WHERE contains(page, '://')),
edge AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
bad AS (SELECT a AS page FROM edge WHERE {_rule("a", "verdict")} = 'block' UNION SELECT b FROM edge JOIN bad ON edge.a = bad.page)
SELECT page_id, {_HOST.format(u="u.url")} AS host, {_PATH.format(u="u.url")} AS path, {_rule("u.url", "rule")} AS rule,
       coalesce({_rule("u.url", "verdict")}, CASE WHEN bad.page IS NOT NULL THEN 'block' END, 'allow') AS verdict
FROM u LEFT JOIN bad ON u.page = bad.page AND contains(u.page, '://')
"""

ORACLE_SQL = {"op10_quality_rules": QUALITY, "op11_phrase_collocations": PHRASES, "op13_url_filter": URLS}
