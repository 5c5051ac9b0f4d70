"""Fixed values that must equal the reference behaviour for equal results.

FIXED VALUES — keep verbatim, in this order.
"""

# Stopwords removed from query keywords (Spanish + English), as given.
STOPWORDS = (
    "de", "la", "el", "en", "a", "que", "y", "los", "las", "un", "una",
    "es", "se", "su", "con", "por", "para", "como", "del", "al", "lo",
    "the", "is", "of", "in", "a", "an", "to", "and", "or", "for",
)

# Connectors the statistical rewriter may put between sentences, in order.
CONNECTORS = (
    "Además,",
    "Asimismo,",
    "Por otro lado,",
    "En este sentido,",
    "Cabe destacar que",
    "De acuerdo con la información disponible,",
    "Finalmente,",
)

# Leading definition phrase stripped from a query (case-insensitive).
QUERY_PREFIX = r"(?:qu[eé]\s+(?:significa|es|son|quiere\s+decir)\s+(?:la\s+|el\s+|los\s+|las\s+|un\s+|una\s+)?|defin[ei]\S*\s+(?:de\s+)?|significado\s+de\s+)"

# The same for engines whose \s is ASCII only: Unicode white space spelled out.
_WS = r"[\t\n\x{0b}\f\r\x{1c}-\x{1f} \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
QUERY_PREFIX_BODY = QUERY_PREFIX.replace(r"\S", _WS.replace("[", "[^", 1)).replace(r"\s", _WS)

# Characters Python's str.strip()/str.split() treat as whitespace.
PY_WHITESPACE_CLASS = _WS
PY_WHITESPACE_CHARS = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
                       + "".join(chr(c) for c in range(0x2000, 0x200B)) + "\u2028\u2029\u202f\u205f\u3000")

# A query term is cut at the first of these characters.
TERM_CUT_CLASS = r"[,?.]"

# Sentence boundaries: runs of these characters.
SENTENCE_SPLIT = r"[.!?;]+"

# Word characters of Python's Unicode ``\w``: letters, numbers, underscore.
WORD_PATTERN = r"[\p{L}\p{N}_]+"

# Fallback answers.
NOTHING_FOUND = "No se encontró información relevante en el corpus para esta consulta."
NOT_ENOUGH = "No se encontró información suficiente en el corpus para responder esta consulta."

# Prompt of the grounded (guided) generator mode.
GUIDED_SYSTEM_PROMPT = (
    "Eres un reformateador de texto. Tu única tarea es combinar "
    "la información del CONTEXTO en una respuesta fluida y natural. "
    "REGLAS ABSOLUTAS:\n"
    "1. SOLO usa información del CONTEXTO. Cero inventos.\n"
    "2. NO añadas datos, ejemplos, ni explicaciones externas.\n"
    "3. Si el CONTEXTO no responde la pregunta, di exactamente: "
    "'La información disponible no cubre este tema.'\n"
    "4. Respuesta breve: máximo 3 oraciones."
)
# Default system prompt of the free (ungrounded) generator mode; the assistant
# name is left out and can be set per row through the ``system_prompt`` column.
FREE_SYSTEM_PROMPT = "Eres un asistente inteligente. Responde de forma natural, útil y concisa."
