"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

import math

from segpanel.llm.licenses import PHRASES, TEMPLATES, word_set

_FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_HASH = "CAST('0x' || substr(md5({}), 1, 13) AS BIGINT) / pow(16, 13)"

MIXING = f"""WITH d AS (SELECT *, coalesce(source, '') AS k, strlen(coalesce(text, '')) + 1 AS b FROM documents),
s AS (SELECT k, sum(b) AS bytes, sqrt(sum(b)) AS w FROM d GROUP BY k),
r AS (SELECT k, w / sum(w) OVER () * sum(bytes) OVER () / bytes AS rate FROM s),
c AS (SELECT k, sum(exp(-rate + i * ln(rate) - lgamma(i + 1))) OVER (PARTITION BY k ORDER BY i) AS cdf FROM r, range(0, 200) t(i)),
u AS (SELECT *, {_HASH.format("'copies7|' || doc_id")} AS u FROM d),
h AS (SELECT u.doc_id, count(*) AS n_copies FROM u JOIN c ON c.k = u.k AND c.cdf <= u.u GROUP BY u.doc_id),
e AS (SELECT u.doc_id, u.text, u.lang, u.source, u.n_chars, CAST(h.n_copies AS INTEGER) AS n_copies, CAST(unnest(range(h.n_copies)) AS INTEGER) AS copy FROM u JOIN h ON u.doc_id = h.doc_id)
SELECT *, {_HASH.format("'order7|' || doc_id || '|' || copy")} AS order_key FROM e"""


def _quoted(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def licences(threshold: float = 0.9) -> str:
    """Every line against every template, and the phrases word by word."""
    templates = ", ".join(
        f"({k}, '{t.label}', {_quoted(ws)}, {max(1, math.ceil(threshold * len(ws) - 1e-9))})"
        for k, t in enumerate(TEMPLATES) for ws in [word_set(t.text)])
    places = " UNION ALL ".join(
        f"SELECT doc_id, '{label}' AS label, unnest(list_filter(range(len(ws)), lambda i: "
        + " AND ".join(f"ws[i + {j + 1}] = '{w}'" for j, w in enumerate(phrase.split())) + ")) AS place FROM w" for phrase, label in PHRASES.items())
    split = "list_filter(regexp_split_to_array({}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
    return f"""WITH w AS (SELECT doc_id, {split.format(_FOLD)} AS ws FROM documents),
p AS ({places}),
b AS (SELECT doc_id, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, list(DISTINCT label) AS base FROM p GROUP BY doc_id),
l AS (SELECT doc_id, unnest(string_split({_FOLD}, chr(10))) AS line, generate_subscripts(string_split({_FOLD}, chr(10)), 1) AS line_no FROM documents),
lw AS (SELECT doc_id, line_no, list_distinct({split.format("line")}) AS ws FROM l),
t(k, label, words, need) AS (VALUES {templates}),
m AS (SELECT doc_id, line_no, label, len(list_intersect(lw.ws, t.words)) / len(t.words) AS share FROM lw, t WHERE len(list_intersect(lw.ws, t.words)) >= t.need),
f AS (SELECT doc_id, list(DISTINCT label) AS found, max(share) AS best, count(DISTINCT line_no) AS n_blocks FROM m GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w.ws) AS BIGINT) AS n_words, coalesce(b.n_base, 0) AS n_base, b.first_word, b.last_word,
  coalesce(array_to_string(list_sort(b.base), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(b.base, []), coalesce(f.found, [])))), ','), '') AS labels,
  CASE WHEN b.n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(f.best, 0.0)::DOUBLE END AS score, coalesce(f.n_blocks, 0) AS n_blocks
FROM w LEFT JOIN b ON w.doc_id = b.doc_id LEFT JOIN f ON w.doc_id = f.doc_id"""


# Sets of five-word shingles, pairs by shared shingles, and the least id reachable by links.
JACCARD = f"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array({_FOLD}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) BETWEEN 1 AND 4 THEN [array_to_string(ws, ' ')]
  ELSE list_transform(range(1, greatest(len(ws) - 3, 1)), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS shingle FROM w WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
both_in AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM both_in JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
reach(a, b) AS (SELECT doc_id, doc_id FROM w UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, r.c AS component_id
FROM w LEFT JOIN n ON w.doc_id = n.doc_id JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) r ON r.a = w.doc_id"""
