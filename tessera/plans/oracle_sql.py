"""DuckDB SQL expressions equal to the Spark column expressions, used to write
the oracle query of each registered query."""

from __future__ import annotations

from tessera.functions import constants as K

WS = K.PY_WHITESPACE_CLASS


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '\\A{WS}+|{WS}+\\z', '', 'g')"


def norm(x: str) -> str:
    return f"strip_accents({strip(f'lower({x})')})"


def term(x: str) -> str:
    cleaned = f"regexp_replace({strip(x)}, '(?i)\\A{K.QUERY_PREFIX_BODY}', '')"
    t = strip(f"string_split_regex({cleaned}, '{K.TERM_CUT_CLASS}')[1]")
    return f"(CASE WHEN length({t}) > 2 THEN {t} ELSE '' END)"


def words(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '{K.WORD_PATTERN}')"


def word_set(x: str) -> str:
    return f"list_distinct({words(x)})"


def ws_tokens(x: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({x}), '{WS}+'), lambda t: t <> '')"


def ws_count(x: str) -> str:
    return f"length(list_filter(regexp_split_to_array({x}, '{WS}+'), lambda t: t <> ''))"


def stopwords() -> str:
    return "[" + ", ".join(lit(w) for w in dict.fromkeys(K.STOPWORDS)) + "]"


def keywords(x: str) -> str:
    return (f"list_filter({word_set(x)}, lambda w: length(w) > 2 AND NOT list_contains({stopwords()}, w))")


def connectors() -> str:
    return "[" + ", ".join(lit(c) for c in K.CONNECTORS) + "]"


def jaccard(a: str, b: str) -> str:
    """On two distinct-token lists."""
    return (f"(CASE WHEN length(list_distinct(list_concat({a}, {b}))) = 0 THEN 0.0 ELSE "
            f"length(list_intersect({a}, {b}))::DOUBLE / length(list_distinct(list_concat({a}, {b}))) END)")


def definition_questions() -> str:
    """SQL of ``tessera.plans.inputs.definition_questions`` over ``part``."""
    name = "p_name"
    half = f"(length({name}) // 2)"
    edited = f"(substr({name}, 1, {half}) || 'x' || substr({name}, {half} + 2))"
    tmpl = "['qué es el ', '¿Qué significa ', 'define ', 'significado de ', 'Que son las ']"
    q0 = f"({tmpl}[(p_partkey % 5) + 1] || {name} || '?')"
    q1 = f"('qué es ' || {edited})"
    return (f"SELECT p_partkey * 3 + i AS query_id, [{q0}, {q1}, {name}][i + 1] AS query "
            f"FROM part, range(3) r(i)")


def bucket(t: str, dim: int = 256) -> str:
    return f"(('0x' || substr(md5({t}), 1, 8))::BIGINT % {dim})"


def unit_vectors(name: str, src: str, id_col: str, text_col: str, dim: int = 256) -> str:
    """CTEs ``{name}`` (id, b, w): hashed bag-of-words unit vector, float32 weights."""
    return f"""{name}_tok AS (SELECT {id_col} AS id, unnest({words(text_col)}) AS t FROM {src}),
{name}_cnt AS (SELECT id, {bucket('t', dim)} AS b, count(*) AS c FROM {name}_tok GROUP BY 1, 2),
{name}_nrm AS (SELECT id, sqrt(sum(c * c)) AS nrm FROM {name}_cnt GROUP BY 1),
{name} AS (SELECT c.id, c.b, (c.c / n.nrm)::FLOAT::DOUBLE AS w FROM {name}_cnt c JOIN {name}_nrm n USING (id))"""


def weighted_vectors(name: str, src: str, id_col: str, text_col: str, idf: str, dim: int = 256) -> str:
    """CTEs ``{name}`` (id, b, w): unit vectors of counts times ``{idf}``(b, idf), float32 weights."""
    return f"""{name}_tok AS (SELECT {id_col} AS id, unnest({words(text_col)}) AS t FROM {src}),
{name}_cnt AS (SELECT id, b, c * idf AS c FROM (SELECT id, {bucket('t', dim)} AS b, count(*) AS c FROM {name}_tok GROUP BY 1, 2) JOIN {idf} USING (b)),
{name}_nrm AS (SELECT id, sqrt(sum(c * c)) AS nrm FROM {name}_cnt GROUP BY 1),
{name} AS (SELECT c.id, c.b, (c.c / n.nrm)::FLOAT::DOUBLE AS w FROM {name}_cnt c JOIN {name}_nrm n USING (id))"""


def text_fragments(queries_sql: str, k: int = 5, threshold: float = 0.3) -> str:
    """CTEs ending in ``frag(query_id, rank, source_id, text, score, ord)``:
    documents scored against ``queries_sql(query_id, query)``."""
    return f"""qsrc AS ({queries_sql}),
dsrc AS (SELECT doc_id AS ord, CAST(doc_id AS VARCHAR) AS source_id,
                CASE WHEN text IS NOT NULL AND text <> '' THEN text ELSE CAST(to_json({{'id': CAST(doc_id AS VARCHAR)}}) AS VARCHAR) END AS text
         FROM documents),
{unit_vectors('qv', 'qsrc', 'query_id', 'query')},
{unit_vectors('dv', 'dsrc', 'ord', 'text')},
sc AS (SELECT q.id AS query_id, d.id AS ord, round(sum(q.w * d.w), 6) AS score
       FROM qv q JOIN dv d ON q.b = d.b GROUP BY 1, 2),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ord) AS rank
       FROM sc WHERE score >= {threshold}),
frag AS (SELECT rk.query_id, rk.rank, dsrc.source_id, dsrc.text, rk.score, rk.ord
         FROM rk JOIN dsrc USING (ord) WHERE rk.rank <= {k})"""


def rewrite(qsrc: str = "qsrc", frag: str = "frag", cap: int = 2) -> str:
    """CTEs ending in ``rw(query_id, response)`` (SYN-5) over ``frag`` and ``qsrc(query_id, query)``."""
    t = "q.term"
    return f"""qf AS (SELECT query_id, {term('query')} AS term, {keywords('query')} AS kw FROM {qsrc}),
foc AS (SELECT * FROM (
  SELECT f.query_id, f.text, q.kw, row_number() OVER (PARTITION BY f.query_id ORDER BY
    CASE WHEN {t} = '' THEN 2
         WHEN f.source_id IS NOT NULL AND f.source_id <> '' AND {norm('f.source_id')} = {norm(t)} THEN 0
         WHEN starts_with({norm(f'substr(f.text, 1, length({t}) + 3)')}, {norm(t)}) THEN 1 ELSE 2 END,
    f.rank) AS fr
  FROM {frag} f JOIN qf q USING (query_id)) WHERE fr = 1),
sp AS (SELECT query_id, kw, string_split_regex(text, '[.!?;]+') AS p FROM foc),
se AS (SELECT query_id, kw, i AS pos, {strip('p[i + 1]')} AS sentence
       FROM (SELECT *, unnest(range(length(p))) AS i FROM sp)),
sd AS (SELECT query_id, sentence, min(pos) AS pos, any_value(kw) AS kw FROM se
       WHERE length(sentence) > 8 GROUP BY 1, 2),
ss AS (SELECT *, CASE WHEN length(ws) = 0 THEN 0.0 ELSE length(list_intersect(ws, kw))::DOUBLE / length(ws) END AS s
       FROM (SELECT *, {word_set('sentence')} AS ws FROM sd)),
st AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, pos) AS n FROM ss)
       WHERE n <= {cap}),
ch AS (SELECT query_id, string_agg(CASE WHEN n = 1 THEN (CASE WHEN ends_with(sentence, '.') THEN sentence ELSE sentence || '.' END)
         ELSE {connectors()}[((n - 2) % 7) + 1] || ' ' ||
              (CASE WHEN ends_with(lower(substr(sentence, 1, 1)) || substr(sentence, 2), '.')
                    THEN lower(substr(sentence, 1, 1)) || substr(sentence, 2)
                    ELSE lower(substr(sentence, 1, 1)) || substr(sentence, 2) || '.' END) END, ' ' ORDER BY n) AS response
       FROM st GROUP BY 1),
rw AS (SELECT foc.query_id, coalesce(ch.response, '') AS response FROM foc LEFT JOIN ch USING (query_id))"""


def answer(qsrc: str = "qsrc", frag: str = "frag") -> str:
    """CTE ``ans(query_id, mode, response)`` (PIP-2 without a generator); needs ``rw``."""
    return f"""ans AS (SELECT q.query_id,
    CASE WHEN nf.query_id IS NULL THEN 'empty' ELSE 'statistical' END AS mode,
    CASE WHEN nf.query_id IS NULL THEN {lit(K.NOTHING_FOUND)}
         WHEN coalesce(rw.response, '') = '' THEN {lit(K.NOT_ENOUGH)} ELSE rw.response END AS response
  FROM {qsrc} q LEFT JOIN (SELECT DISTINCT query_id FROM {frag}) nf USING (query_id)
  LEFT JOIN rw USING (query_id))"""


def minhash_sig(text: str) -> str:
    """AGG-7 signature (null when the text has no token)."""
    from tessera.operators.minhash import PRIME, hash_params
    ps = hash_params()
    a = "[" + ", ".join(f"{x}::BIGINT" if i == 0 else str(x) for i, (x, _) in enumerate(ps)) + "]"
    b = "[" + ", ".join(f"{y}::BIGINT" if i == 0 else str(y) for i, (_, y) in enumerate(ps)) + "]"
    hs = f"list_transform(list_distinct({ws_tokens(text)}), lambda t: ('0x' || substr(md5(t), 1, 8))::BIGINT)"
    return (f"(CASE WHEN length({hs}) > 0 THEN list_transform(range(1, {len(ps) + 1}), lambda i: "
            f"list_min(list_transform({hs}, lambda x: ({a}[i] * x + {b}[i]) % {PRIME}))) END)")
