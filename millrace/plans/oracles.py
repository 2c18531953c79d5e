"""Pieces of the DuckDB oracles: the same definitions, written for another engine."""

from __future__ import annotations

from millrace.functions.text import CONTROL, HANGUL_LATIN, LATIN, PUNCTUATION, SPACE, WS
from millrace.operators.quality import FilterConfig
from millrace.operators.split import BUCKETS, MASK, MULTIPLIER

LF = "chr(10)"


def normalize(x: str) -> str:
    x = f"nfc_normalize({x})"
    for pattern, by in ((r"\r\n?", LF), (CONTROL, "''"), (rf"[{WS}]+\n", LF), (r"\n{3,}", f"{LF}||{LF}"), (rf"\A{SPACE}+|{SPACE}+\z", "''")):
        x = f"regexp_replace({x}, '{pattern}', {by}, 'g')"
    return x


def ratio(x: str, pattern: str) -> str:
    return f"((length({x}) - length(regexp_replace({x}, '{pattern}', '', 'g')))::DOUBLE / nullif(length({x}), 0))"


def english(x: str) -> str:
    return f"coalesce(lower(trim({x})) IN ('en', 'english') OR lower(trim({x})) LIKE 'en-%', false)"


def runs(table: str, key: str = "doc_id") -> str:
    """(key, run): the longest run of one character, by gaps and islands."""
    return f"""SELECT {key}, max(c) AS run FROM (SELECT {key}, ch, i - r AS g, count(*) AS c FROM
      (SELECT {key}, ch, i, row_number() OVER (PARTITION BY {key}, ch ORDER BY i) AS r FROM
        (SELECT {key}, unnest(string_split(text, '')) AS ch, generate_subscripts(string_split(text, ''), 1) AS i FROM {table} WHERE text <> '')) GROUP BY ALL) GROUP BY {key}"""


def reason(config: FilterConfig = FilterConfig()) -> str:
    """The CASE over columns text, language and run."""
    out = f"WHEN text = '' THEN 'empty' WHEN length(text) < {config.min_chars} THEN 'too_short' "
    if config.max_chars is not None:
        out += f"WHEN length(text) > {config.max_chars} THEN 'too_long' "
    if config.enable_repetition:
        out += f"WHEN run::DOUBLE / length(text) > {config.max_repeat_ratio} THEN 'repetition' "
    if config.enable_whitespace:
        out += f"WHEN {ratio('text', SPACE)} > {config.max_whitespace_ratio} THEN 'excessive_whitespace' "
    if config.enable_punct:
        out += f"WHEN {ratio('text', PUNCTUATION)} > {config.max_punct_ratio} THEN 'excessive_punctuation' "
    if config.enable_alpha_hangul:
        t = config.min_alpha_hangul_ratio
        out += f"WHEN {english('language')} AND {ratio('text', LATIN)} < {t} THEN 'low_alpha' "
        out += f"WHEN NOT {english('language')} AND {ratio('text', HANGUL_LATIN)} < {t} THEN 'low_alpha_hangul' "
    return f"CASE {out} END"


def bucket(x: str, seed: int = 42) -> str:
    return f"(xor(('0x' || substr({x}, 1, 8))::BIGINT, {(seed * MULTIPLIER) & MASK}::BIGINT) % {BUCKETS})"


def corpus(source: str = "SELECT doc_id, source, lang AS language, text FROM documents", config: FilterConfig = FilterConfig(), ratio_: float = 0.2) -> str:
    """CTEs of the funnel: raw, n(ormalized), c(lassified), k(ept), d(eduplicated, ranked), u(nique), s(plit)."""
    return f"""WITH raw AS ({source}),
n AS (SELECT * REPLACE ({normalize("text")} AS text) FROM raw),
runs AS ({runs("n")}),
c AS (SELECT *, {reason(config)} AS reason FROM (SELECT n.*, coalesce(runs.run, 1) AS run FROM n LEFT JOIN runs USING (doc_id))),
k AS (SELECT doc_id, source, language, text, sha256(source || {LF} || text) AS document_id, length(text) AS chars FROM c WHERE reason IS NULL),
d AS (SELECT *, row_number() OVER (PARTITION BY sha256(text) ORDER BY source, document_id, doc_id) AS rank FROM k),
u AS (SELECT * FROM d WHERE rank = 1),
s AS (SELECT *, CASE WHEN {bucket("document_id")} < {int(ratio_ * BUCKETS)} THEN 'val' ELSE 'train' END AS split FROM u)
"""


#: The sources of the mixing queries and their weights; one has no documents, one no weight.
WEIGHTS = (("chat", 0.2), ("bench", 0.1), ("web", 0.2), ("docs", 0.5), ("nothing", 0.0))
MIXED = """SELECT 'd' || doc_id AS doc_id, 'docs' AS source, lang AS language, text FROM documents
UNION ALL SELECT 'c' || conv_id || '.' || turn, 'chat', 'unknown', text FROM conversations
UNION ALL SELECT 'b' || item_id, 'bench', 'en', text FROM benchmark
UNION ALL SELECT 'p' || page_id, 'web', 'unknown', html FROM pages
UNION ALL SELECT 'x' || item_id, 'unweighted', 'en', text || ' again' FROM benchmark"""


def mixed(oversample: int) -> str:
    """CTEs m (rows taken) and g (all weighted sources) over the train side of MIXED."""
    values = ", ".join(f"('{n}', {w}::DOUBLE)" for n, w in WEIGHTS)
    return (
        corpus(MIXED, ratio_=0.01)
        + f""", w(source, weight) AS (VALUES {values}),
t AS (SELECT * FROM s WHERE split = 'train'),
g AS (SELECT source, weight / (SELECT sum(weight) FROM w) AS target_weight, weight / (SELECT sum(weight) FROM w) * (SELECT greatest(sum(chars), 1) FROM t) AS target FROM w),
p AS (SELECT t.source, t.document_id, t.chars, g.target, g.target_weight, pass,
        row_number() OVER (PARTITION BY t.source ORDER BY pass, t.document_id) AS rn,
        sum(t.chars) OVER (PARTITION BY t.source ORDER BY pass, t.document_id) - t.chars AS before
      FROM t JOIN g USING (source), (SELECT unnest(range({max(oversample, 1)})) AS pass)),
m AS (SELECT * FROM p WHERE before < target OR rn = 1)
"""
    )
